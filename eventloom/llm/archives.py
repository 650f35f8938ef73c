"""Legacy ARC archives to WARC archives.

``write_arc`` writes ARC files of version 1 (five header fields) or 2 (ten);
``convert`` parses their header lines by the version that each file's own
version block declares, takes the declared length of content, and writes an
equivalent WARC record with a synthesised identifier, timestamp, type and
digests; ``read_warc`` reads the result back and checks the digests.

Of records whose payloads are equal and have at least ``revisit_bytes`` bytes,
the one with the largest page id becomes a response and the others revisits that
refer to it. Only (page, digest) rows shuffle for that, never a payload; equal
payloads are pre-aggregated on each task, and very large groups of them are
joined by broadcast (``common.join_groups``).

Every record is a gzip member of its own, as is usual, so archives are read as a
stream with one record in memory.

Defined results: null html is an empty payload; a null, empty or spaced url is
written percent-encoded (a null one as ``urn:unknown``); a null page id is kept
as null, and compares as smallest; repeated rows are records of their own, and
of rows that share the largest id all are responses; an empty table gives no
file and no row.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import files

#: The field names of the two ARC versions, as the format defines them.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LISTED = "path string, n long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, warc_date string, record_id string"


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _listed(rows: list[tuple[str, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], ["path", "n"])


# ------------------------------------------------------------ ARC
def arc_header(version: int, url: str, ip: str, date: str, mime: str, length: int, offset: int = 0, name: str = "-") -> bytes:
    fields = [url, ip, date, mime] + ([] if version == 1 else ["200", "-", "-", str(offset), name])
    return " ".join([*fields, str(length)]).encode() + b"\n"


def safe_url(url: str | None) -> str:
    return urllib.parse.quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else "urn:unknown"


def write_arc(pages: DataFrame, version: int = 1, file_bytes: int = 32 << 20, date: str = "20080430204825", folder: str | None = None) -> DataFrame:
    """Write (page_id, url, html) as ARC files; returns (path, n records)."""
    folder = folder or C.fresh_dir(pages.sparkSession, "arc")
    desc = f"{version} 0 eventloom\n{ARC_FIELDS[version]}\n\n".encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((i, u, h) for b in batches for i, u, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), C.utf8(b, "html")))
        done, row = [], next(rows, None)
        while row is not None:
            with files.writing(folder, ".arc.gz") as (out, path):
                name = path.rpartition("/")[2]
                out.write(_member(arc_header(version, f"filedesc://{name}", "0.0.0.0", date, "text/plain", len(desc)) + desc + b"\n"))
                n = held = 0
                while row is not None and held < file_bytes:
                    page, url, html = row
                    body = html or b""
                    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                    http += b"Content-Length: %d\r\n" % len(body) + (b"" if page is None else b"X-Page-Id: %d\r\n" % page) + b"\r\n"
                    out.write(_member(arc_header(version, safe_url(url), "192.0.2.1", date, "text/html", len(http) + len(body), held, name) + http + body + b"\n"))
                    n, held, row = n + 1, held + len(body) + 200, next(rows, None)
            done.append((path, n))
        yield _listed(done)

    C.small_batches(pages.sparkSession)
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return C.saved(source.mapInArrow(run, LISTED), "arc-files")


def parse_arc(stream) -> Iterator[dict]:
    """Records of an ARC file, after its version block. The block declares the
    version and the fields of all header lines that follow."""
    line = stream.readline()
    while line == b"\n":
        line = stream.readline()
    if not line:
        return
    if not line.startswith(b"filedesc://"):
        raise ValueError(f"no version block: {line[:60]!r}")
    block = stream.read(int(line.split(b" ")[-1])).decode("utf-8", "replace").split("\n")
    version, names = int(block[0].split(" ")[0]), block[1].split(" ")
    if ARC_FIELDS.get(version) != block[1].strip():
        raise ValueError(f"unknown version or fields: {block[:2]}")
    while line := stream.readline():
        if line == b"\n":
            continue
        values = line.rstrip(b"\r\n").decode("utf-8", "replace").split(" ")
        if len(values) > len(names):  # an unescaped url may hold spaces: all other fields stand at the end
            k = len(values) - len(names) + 1
            values = [" ".join(values[:k]), *values[k:]]
        if len(values) != len(names):
            raise ValueError(f"bad header line: {line[:200]!r}")
        head = dict(zip(names, values))
        content = stream.read(n := int(head["Archive-length"]))
        if len(content) != n:
            raise ValueError("the file ends before a record's declared length")
        yield {"version": version, "url": head["URL"], "ip": head["IP-address"], "date": head["Archive-date"], "mime": head["Content-type"], "content": content}


def split_http(content: bytes) -> tuple[bytes, bytes]:
    head, gap, body = content.partition(b"\r\n\r\n")
    return (head + gap, body) if gap and head.startswith(b"HTTP/") else (b"", content)


def http_field(head: bytes, name: str) -> str | None:
    for line in head.split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        if k.strip().lower() == name.lower().encode():
            return v.strip().decode("latin-1")
    return None


# ------------------------------------------------------------ conversion
def record_id(path: str, nth: int) -> str:
    """A stable identifier from the archive's name and the record's place."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{path.rpartition('/')[2]}#{nth}')}>"


def warc_date(arc: str) -> str:
    """The 14 digits of an ARC date, shorter ones filled up, in ISO form."""
    d = (arc if arc.isdigit() else "")[:14]
    d += "19700101000000"[len(d) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:]}Z"


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def revisits(arcs: DataFrame, revisit_bytes: int) -> DataFrame:
    """(path, nth, refers_to, refers_id): the records that become revisits."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                cols: tuple = ([], [], [], [])
                with gzip.GzipFile(fileobj=files.reading(path)) as s:
                    for nth, r in enumerate(parse_arc(s)):
                        head, body = split_http(r["content"])
                        if len(body) >= revisit_bytes:
                            page = http_field(head, "X-Page-Id")
                            for c, v in zip(cols, (path, nth, None if page is None else int(page), hashlib.sha1(body).digest())):
                                c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.binary()))], ["path", "nth", "page_id", "digest"])

    seen = C.saved(arcs.select("path").repartition(C.shuffle_partitions(arcs.sparkSession), "path").mapInArrow(scan, "path string, nth long, page_id long, digest binary"), "payloads")
    n = seen.count()
    key = F.struct(F.coalesce("page_id", F.lit(-(1 << 63))).alias("k"), "path", "nth")
    groups = C.saved(seen.groupBy("digest").agg(F.count("*").alias("copies"), F.max(key).alias("last")).where("copies > 1"), "payload-groups")
    of = C.join_groups(seen, groups, "digest", "copies", C.heavy_bound(n))
    return of.where(F.coalesce("page_id", F.lit(-(1 << 63))) < F.col("last.k")).select("path", "nth", F.col("last.k").alias("refers_to"), F.col("last.path").alias("r_path"), F.col("last.nth").alias("r_nth"))


def convert(arcs: DataFrame, revisit_bytes: int = 1000) -> DataFrame:
    """Write a WARC file for each listed ARC file; returns (path, n records)."""
    spark = arcs.sparkSession
    folder = C.fresh_dir(spark, "warc")
    # an archive holds a bounded number of records, and so does its list of revisits
    marks = revisits(arcs, revisit_bytes).groupBy("path").agg(F.collect_list(F.struct("nth", "refers_to", "r_path", "r_nth")).alias("marks"))
    todo = arcs.join(marks, "path", "left").select("path", F.to_json("marks").alias("marks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        done = []
        for b in batches:
            for path, marks in zip(b.column("path").to_pylist(), b.column("marks").to_pylist()):
                refers = {m["nth"]: m for m in json.loads(marks or "[]")}
                with files.writing(folder, ".warc.gz") as (out, to), gzip.GzipFile(fileobj=files.reading(path)) as s:
                    info = f"software: eventloom\r\nformat: WARC File Format 1.1\r\nconverted-from: {path.rpartition('/')[2]}\r\n".encode()
                    out.write(_member(warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(path, -1)), ("WARC-Date", warc_date("")), ("Content-Type", "application/warc-fields")], info)))
                    nth = -1
                    for nth, r in enumerate(parse_arc(s)):
                        head, body = split_http(r["content"])
                        page, m = http_field(head, "X-Page-Id"), refers.get(nth)
                        fields = [("WARC-Type", "revisit" if m else ("response" if head else "resource")), ("WARC-Record-ID", record_id(path, nth)), ("WARC-Date", warc_date(r["date"])), ("WARC-Target-URI", r["url"]), ("WARC-IP-Address", r["ip"]), ("WARC-Payload-Digest", sha1(body))]
                        block = r["content"]
                        if m:
                            block = head
                            fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(m["r_path"], m["r_nth"])), ("Refers-To-Page", str(m["refers_to"]))]
                        if page is not None:
                            fields.append(("Page", page))
                        fields += [("Payload-Length", str(len(body))), ("WARC-Block-Digest", sha1(block)), ("Content-Type", "application/http; msgtype=response" if head else r["mime"])]
                        out.write(_member(warc_record(fields, block)))
                done.append((to, nth + 1))
        yield _listed(done)

    # the list is slim and comes out of its join in one task; each archive is work of its own. Dealing
    # it by path again would be left out as needless, so it is dealt by a hash
    spread = todo.repartition(C.shuffle_partitions(spark), F.xxhash64("path", F.lit(7)))
    return C.saved(spread.mapInArrow(run, LISTED), "warc-files")


# ------------------------------------------------------------ WARC
def parse_warc(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    while line := stream.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:60]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            k, _, v = line.decode("utf-8", "replace").partition(":")
            head[k.strip()] = v.strip()
        block = stream.read(n := int(head["Content-Length"]))
        if len(block) != n:
            raise ValueError("the file ends before a record's declared length")
        yield head, block


def read_warc(warcs: DataFrame) -> DataFrame:
    """One row per record but warcinfo; digests of blocks and payloads are checked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                cols: tuple = tuple([] for _ in range(8))
                with gzip.GzipFile(fileobj=files.reading(path)) as s:
                    for h, block in parse_warc(s):
                        if h["WARC-Type"] == "warcinfo":
                            continue
                        if sha1(block) != h["WARC-Block-Digest"]:
                            raise ValueError(f"damaged record {h['WARC-Record-ID']}")
                        n, digest = int(h["Payload-Length"]), h["WARC-Payload-Digest"]
                        if h["WARC-Type"] != "revisit":
                            body = split_http(block)[1] if h["WARC-Type"] == "response" else block
                            if (len(body), sha1(body)) != (n, digest):
                                raise ValueError(f"damaged payload {h['WARC-Record-ID']}")
                        page, refers = h.get("Page"), h.get("Refers-To-Page")
                        kind = "revisit" if h["WARC-Type"] == "revisit" else "response"
                        row = (None if page is None else int(page), n, base64.b32decode(digest[5:]).hex(), kind, None if refers is None else int(refers), h["WARC-Target-URI"], h["WARC-Date"], h["WARC-Record-ID"])
                        for c, v in zip(cols, row):
                            c.append(v)
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [x.split()[0] for x in RECORD.split(", ")])

    return warcs.select("path").repartition(C.shuffle_partitions(warcs.sparkSession), "path").mapInArrow(run, RECORD)


def arc_to_warc(pages: DataFrame, arc_version: int | None = None, revisit_bytes: int = 1000, file_bytes: int = 32 << 20) -> DataFrame:
    """Write pages as ARC files, convert those to WARC and read these back. Without ``arc_version``
    about half the pages go to files of each version. The ARC files are deleted once they are converted."""
    folder = C.fresh_dir(pages.sparkSession, "arc")
    if arc_version is None:
        half = F.pmod(F.xxhash64("page_id", F.lit("version")), F.lit(2))
        arcs = write_arc(pages.where(half == 0), 1, file_bytes, folder=folder).unionByName(write_arc(pages.where(half == 1), 2, file_bytes, folder=folder))
    else:
        arcs = write_arc(pages, arc_version, file_bytes, folder=folder)
    warcs = convert(arcs, revisit_bytes)
    files.remove(folder)
    return read_warc(warcs)
