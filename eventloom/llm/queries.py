"""The queries of the training-data operators: each over its whole table, with
production parameters, returning the whole result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archives, collocations, common, dac, decontaminate, exact_dedup, language, licenses, lm_score, merkle, near_dedup, packing, quality, suffixes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string")) % 4 == 2


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm_score.score(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"))


def op2_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.arc_to_warc(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", F.coalesce(held_out(), F.lit(False)))
    return language.identify(docs, ~F.col("held_out"), keep=["doc_id", "held_out"])


def op4_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dac.read_archive(dac.write_archive(_table(spark, sf_dir, "documents")))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(_table(spark, sf_dir, "documents"), width=2, percent=80)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    digest = F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return quality.quality(docs, labels, F.col("source"), F.concat("source", F.lit("/"), "lang"))


def op10_best_fit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(_table(spark, sf_dir, "documents"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.remove_repeats(_table(spark, sf_dir, "documents"), window=100)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, common.ascii_lower(F.col("text"))).otherwise(F.col("text"))
    rows = merkle.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], altered={"text": tampered})
    verified = F.col("folded_root") == F.col("root")
    return rows.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("way")).alias("proof_sha256"), "folded_root", verified.alias("verified"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_lm_score, op2_arc_to_warc, op3_language, op4_token_codes, op5_near_dedup, op6_exact_dedup, op7_licenses, op8_decontaminate, op9_quality, op10_best_fit_pack, op11_suffix_dedup, op12_merkle_manifest, op13_collocations)}

UP, LOW = common.UPPER, common.LOWER


def _merkle_sql(levels: int = 8) -> str:
    """Trees of up to 16^levels leaves, level by level; once a tree is one node, it stays as it is."""

    def tree(name: str, leaves: str) -> str:
        out = f"{name}0 AS ({leaves})"
        for k in range(levels):
            out += f""",
{name}r{k} AS (SELECT g, i // 16 AS i, max(c) AS c, list(d ORDER BY i) AS l FROM {name}{k} GROUP BY g, i // 16),
{name}{k + 1} AS (SELECT g, i, CASE WHEN c = 1 THEN l[1] ELSE sha256(array_to_string(l, '')) END AS d, (c + 15) // 16 AS c FROM {name}r{k})"""
        return out

    def walk(name: str, start: str, more: str) -> str:
        """From every leaf: x (siblings so far) and t (the altered digest folded so far)."""
        out = f"{name}w0 AS ({start})"
        for k in range(levels):
            out += f""",
{name}w{k + 1} AS (
  SELECT {more}, w.g, w.i // 16 AS i, CASE WHEN c = 1 THEN x ELSE x || array_to_string(l[:w.i % 16] || l[w.i % 16 + 2:], '') END AS x,
         CASE WHEN c = 1 THEN t ELSE sha256(array_to_string(l[:w.i % 16], '') || t || array_to_string(l[w.i % 16 + 2:], '')) END AS t
  FROM {name}w{k} w JOIN {name}r{k} r ON r.g = w.g AND r.i = w.i // 16)"""
        return out

    field = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')"
    head = " || ".join(map(field, ["doc_id", "source", "lang", "n_chars"]))
    lowered = f"translate(text, '{UP}', '{LOW}')"
    steps = "list_transform(flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])), lambda c: c)"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, (a & 1) * 3988292384) END), 4294967295)"
    return f"""
WITH n AS (
  SELECT doc_id, coalesce('=' || source, '') AS g, sha256({head} || {field("text")}) AS d,
         CASE WHEN {crc} % 5 = 0 THEN sha256({head} || {field(lowered)}) ELSE sha256({head} || {field("text")}) END AS t
  FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, d) - 1 AS i, count(*) OVER (PARTITION BY g) AS c FROM n),
{tree("a", "SELECT g, i, d, c FROM o")},
s AS (SELECT '' AS g, g AS source, row_number() OVER (ORDER BY g COLLATE "binary") - 1 AS i, d, count(*) OVER () AS c FROM a{levels}),
{tree("b", "SELECT g, i, d, c FROM s")},
{walk("a", "SELECT doc_id, d AS leaf, g, i, '' AS x, t FROM o", "doc_id, leaf")},
{walk("b", f"SELECT doc_id, leaf, s.d AS subroot, '' AS g, s.i, x, t FROM aw{levels} w JOIN s ON s.source = w.g", "doc_id, leaf, subroot")}
SELECT doc_id, leaf, subroot, d AS root, sha256(x) AS proof_sha256, t AS folded_root, t = d AS verified FROM bw{levels} JOIN b{levels} USING (g)"""


SQL = {
    "op1_lm_score": rf"""
WITH w AS (
  SELECT doc_id, unnest(l) AS w, unnest(range(len(l))) AS i
  FROM (SELECT doc_id, regexp_extract_all(translate(text, '{UP}', '{LOW}'), '[^\x20\x09-\x0D]+') AS l FROM documents)),
g AS (SELECT doc_id, i, w, lag(w) OVER d AS v, lag(w, 2) OVER d AS u FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
c1 AS (SELECT w, count(*) AS n FROM g GROUP BY w),
o1 AS (SELECT doc_id, w, count(*) AS n FROM g GROUP BY doc_id, w),
c2 AS (SELECT v, w, count(*) AS n FROM g WHERE v IS NOT NULL GROUP BY v, w),
o2 AS (SELECT doc_id, v, w, count(*) AS n FROM g WHERE v IS NOT NULL GROUP BY doc_id, v, w),
c3 AS (SELECT u, v, w, count(*) AS n FROM g WHERE u IS NOT NULL GROUP BY u, v, w),
o3 AS (SELECT doc_id, u, v, w, count(*) AS n FROM g WHERE u IS NOT NULL GROUP BY doc_id, u, v, w),
d AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
s AS (
  SELECT g.doc_id, g.u, g.v, c1.n - o1.n AS e1, coalesce(c2.n - o2.n, 0) AS e2, coalesce(c3.n - o3.n, 0) AS e3, cv.n - ov.n AS x1, cu.n - ou.n AS x2,
         greatest((SELECT count(*) FROM g) - d.n, 1) AS rest
  FROM g JOIN c1 USING (w) JOIN o1 ON o1.doc_id = g.doc_id AND o1.w = g.w JOIN d ON d.doc_id = g.doc_id
  LEFT JOIN c2 ON c2.v = g.v AND c2.w = g.w LEFT JOIN o2 ON o2.doc_id = g.doc_id AND o2.v = g.v AND o2.w = g.w
  LEFT JOIN c3 ON c3.u = g.u AND c3.v = g.v AND c3.w = g.w LEFT JOIN o3 ON o3.doc_id = g.doc_id AND o3.u = g.u AND o3.v = g.v AND o3.w = g.w
  LEFT JOIN c1 cv ON cv.w = g.v LEFT JOIN o1 ov ON ov.doc_id = g.doc_id AND ov.w = g.v
  LEFT JOIN c2 cu ON cu.v = g.u AND cu.w = g.v LEFT JOIN o2 ou ON ou.doc_id = g.doc_id AND ou.v = g.u AND ou.w = g.v),
t AS (
  SELECT doc_id, count(*) AS n_words,
         sum(CASE WHEN e3 > 0 THEN ln(e3 / greatest(x2, 1))
                  WHEN e2 > 0 THEN ln(e2 / greatest(x1, 1)) + CASE WHEN u IS NULL THEN 0 ELSE ln(0.4) END
                  ELSE ln(greatest(e1, 1) / rest) + CASE WHEN v IS NULL THEN 0 WHEN u IS NULL THEN ln(0.4) ELSE 2 * ln(0.4) END END) AS log_score
  FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, round(coalesce(log_score, 0), 4) AS log_score FROM documents LEFT JOIN t USING (doc_id)""",
    "op2_arc_to_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
l AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS last FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < last THEN last END AS refers_to FROM l""",
    "op6_exact_dedup": f"""
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), '{UP}', '{LOW}') AS t FROM documents) WINDOW w AS (PARTITION BY t)""",
    "op8_decontaminate": rf"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UP}', '{LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS l FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UP}', '{LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS l FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(l), 10) AS k, array_to_string(l[s:s + 9], ' ') AS x
  FROM (SELECT item_id, l, unnest(range(1, greatest(len(l) - 9, 1) + 1)) AS s FROM bw WHERE len(l) > 0)),
ks AS (SELECT DISTINCT k FROM win),
occ AS (
  SELECT doc_id, s, k, array_to_string(l[s:s + k - 1], ' ') AS x
  FROM (SELECT doc_id, l, k, unnest(range(1, len(l) - k + 2)) AS s FROM dw, ks WHERE len(l) >= k)),
hit AS (SELECT doc_id, s, k, item_id FROM occ JOIN win USING (k, x)),
words AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS w FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, len(l)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op11_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, s, substr(h, 2 * s + 1, 200) AS x FROM (SELECT *, unnest(range(0, n - 99)) AS s FROM d WHERE n >= 100)),
f AS (SELECT doc_id, s FROM w QUALIFY row_number() OVER (PARTITION BY x ORDER BY doc_id, s) > 1),
r AS (SELECT doc_id, s, (s > 100 + coalesce(lag(s) OVER (PARTITION BY doc_id ORDER BY s), -101))::INT AS new FROM f),
g AS (SELECT doc_id, min(s) AS b, max(s) + 100 AS e FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM r) GROUP BY doc_id, k),
p AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS a FROM g),
k AS (
  SELECT doc_id, sum(e - b) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY b) || substr(max(h), 2 * max(e) + 1) AS kept
  FROM p JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)""",
    "op12_merkle_manifest": _merkle_sql(),
    "op13_collocations": rf"""
WITH p AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS l
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UP}', '{LOW}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
u AS (SELECT lang, l, unnest(range(1, len(l) + 1)) AS i FROM p WHERE len(l) > 0),
g AS (SELECT lang, k, array_to_string(l[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM u, range(1, 6) t(k) WHERE i + k - 1 <= len(l) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE k = 1 GROUP BY lang),
o AS (SELECT * FROM g WHERE f >= 100),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM o WHERE k > 1),
s AS (
  SELECT c.lang, c.phrase, c.k, a, l.f AS l, r.f AS r, n, (1000::HUGEINT * a * n // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c JOIN n USING (lang)
  JOIN o l ON l.lang = c.lang AND l.phrase = array_to_string(w[:j], ' ') JOIN o r ON r.lang = c.lang AND r.phrase = array_to_string(w[j + 1:], ' ')
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, j) = 1),
b AS (
  SELECT * FROM s WHERE NOT EXISTS (
    SELECT 1 FROM c d WHERE d.lang = s.lang AND d.k > s.k AND 100 * d.a >= 100 * s.a AND contains(' ' || d.phrase || ' ', ' ' || s.phrase || ' ')))
SELECT lang, row_number() OVER o AS rank, phrase, a, l, r, n, score FROM b WINDOW o AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY rank <= 2000""",
}
