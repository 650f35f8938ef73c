"""Reports over result tables."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def key_text(c: Column) -> Column:
    """A key as comparable text: trimmed, lower case, '1.0' as '1', missing as ''."""
    t = F.lower(F.trim(c.cast("string")))
    t = F.regexp_replace(t, r"^(-?[0-9]+)\.0+$", "$1")
    return F.when(t.isNull() | t.isin("", "nan", "none"), F.lit("")).otherwise(t)


def key_list(c: Column) -> Column:
    """A comma list as comparable text: trimmed, lower case, sorted parts."""
    t = F.lower(F.trim(c.cast("string")))
    parts = F.array_join(F.array_sort(F.transform(F.split(t, ","), lambda x: F.trim(x))), ",")
    return F.when(t.isNull(), F.lit("")).when(t.contains(","), parts).otherwise(t)


def distinct_but(df: DataFrame, ignore: list[str], order: list[str]) -> DataFrame:
    """One row per combination of all columns but ``ignore``: the first by ``order``."""
    keys = [c for c in df.columns if c not in ignore]
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def cost_report(df: DataFrame, group: str, mode_col: str, mode: str, value: str, refs: str, queries: str) -> DataFrame:
    """Means and counts by group, with cost, category by prefix and the number in the name."""
    g = df.groupBy(F.col(group).alias("group"), mode_col).agg(F.avg(value).alias(value), F.count(value).alias("count"), F.avg(refs).alias(refs), F.avg(queries).alias(queries))
    cat = F.when(F.col("group").startswith("count_"), "count").when(F.col("group").startswith("time_"), "time").otherwise("other")
    out = g.withColumn("compute_cost", F.col(refs) + F.col(queries)).withColumn("category", cat).where((F.col(mode_col) == mode) & (cat != "other"))
    return out.withColumn("bin_value", F.regexp_extract("group", r"_(\d+\.?\d*)", 1).try_cast("double")).orderBy("category", "compute_cost")


def mean_std_text(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """'mean ± deviation' with four decimals; the deviation is that of a sample."""
    return df.groupBy(*keys).agg(F.format_string("%.4f ± %.4f", F.avg(value), F.stddev_samp(value)).alias("formatted"))


def over_baseline(df: DataFrame, keys: list[str], level: str, axis: str, base, value: str) -> DataFrame:
    """Mean over ``keys`` of the gain on the row of the same keys with axis = base,
    per (level, axis), in hundredths rounded to 2."""
    b = F.max(F.when(F.col(axis) == base, F.col(value))).over(W.partitionBy(*keys, level))
    gain = df.withColumn("_g", 100 * (F.col(value) - b)).where(F.col(axis) != base)
    return gain.groupBy(level, axis).agg(F.round(F.avg("_g"), 2).alias("gain"))


def relative_gain(agg: DataFrame, keys: list[str], kind: str, base: str, value: str) -> DataFrame:
    """Adds gain in % over the baseline kind of the same keys; null for itself."""
    b = agg.where(F.col(kind) == base).groupBy(*keys).agg(F.avg(value).alias("_b"))
    j = agg.join(b, keys, "left")
    return j.withColumn("gain", F.when(F.col(kind) != base, 100.0 * (F.col(value) - F.col("_b")) / F.col("_b"))).drop("_b")


def is_night(name: Column) -> Column:
    n = F.lower(name)
    return n.contains("night") | n.contains("n0")


def condition(ref: Column, qry: Column) -> Column:
    a, b = is_night(ref), is_night(qry)
    return F.when(~a & ~b, "Day-Day").when(a != b, "Day-Night").otherwise("Night-Night")


def dataset_of(ref: Column) -> Column:
    return F.when(ref.contains("0"), "NSAVP").otherwise("Brisbane")


def parse_list(c: Column) -> Column:
    """'[0.5, 0.25]' as an array of doubles."""
    return F.from_json(c, "array<double>")


def list_mean(c: Column) -> Column:
    a = parse_list(c)
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def student_t_two_sided(t: float, dof: float) -> float:
    """P(|T| >= |t|), by the continued fraction of the incomplete beta function."""
    if not (math.isfinite(t) and dof > 0):
        return float("nan")
    x, a, b = dof / (dof + t * t), dof / 2, 0.5
    if x >= 1:
        return 1.0
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))

    def fraction(x: float, a: float, b: float) -> float:
        tiny, c, d = 1e-300, 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
        h = d
        for m in range(1, 500):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / (1 + num * d or tiny)
                c = 1 + num / c or tiny
                h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return h

    return front * fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(1 - x, b, a) / b


def _p_value(t: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([student_t_two_sided(a, b) for a, b in zip(t, dof)])


def welch(df: DataFrame, keys: list[str], side: str, a: str, b: str, value: str) -> DataFrame:
    """(keys, t, dof, p): Welch's test of value on side a against side b; null unless
    both have more than one. Only one row per key reaches Python."""
    v = F.when(~F.isnan(value), F.col(value))
    g = df.groupBy(*keys)
    stats = []
    for s, n in ((a, "a"), (b, "b")):
        x = F.when(F.col(side) == s, v)
        stats += [F.avg(x).alias(f"_m{n}"), F.var_samp(x).alias(f"_v{n}"), F.count(x).alias(f"_n{n}")]
    r = g.agg(*stats)
    sa, sb = F.col("_va") / F.col("_na"), F.col("_vb") / F.col("_nb")
    ok = (F.col("_na") > 1) & (F.col("_nb") > 1)
    r = r.withColumn("t", F.when(ok, (F.col("_ma") - F.col("_mb")) / F.sqrt(sa + sb)))
    r = r.withColumn("dof", F.when(ok, (sa + sb) ** 2 / (sa**2 / (F.col("_na") - 1) + sb**2 / (F.col("_nb") - 1))))
    return r.select(*keys, "t", "dof").withColumn("p", F.when(F.col("t").isNotNull(), F.pandas_udf(_p_value, "double")("t", "dof")))


def overall(df: DataFrame, value: str) -> DataFrame:
    """mean, population deviation, min, max, median and count of a column."""
    return df.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), F.median(value).alias("median"), F.count(value).alias("num"))


def clean_results(df: DataFrame) -> DataFrame:
    """Frame rows get patch grid 1 x 1 and need an auc; grids become integers, 0 if
    unreadable; of rows equal but for runtime the one with the least runtime stays."""
    frame = F.col("patch_or_frame") == "frame"
    auc = F.col("auc").try_cast("double")
    keep = ~frame | (auc.isNotNull() & ~F.isnan(auc))
    out = df.where(F.coalesce(keep, F.lit(True)))
    for c in ("patch_rows", "patch_cols"):
        out = out.withColumn(c, F.when(frame, 1).otherwise(F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)).cast("int")))
    return distinct_but(out, ["runtime"], ["runtime"])


def update_unique(table: DataFrame, updates: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Fill ``values`` of the rows that an update matches uniquely and whose first
    value is still missing; all other rows stay."""
    u = updates.select(*keys, *(F.col(v).alias(f"_{v}") for v in values))
    one = table.withColumn("_c", F.count("*").over(W.partitionBy(*keys)))
    j = one.join(u, keys, "left")
    open_ = (F.col("_c") == 1) & F.col(values[0]).isNull()
    for v in values[1:] + values[:1]:  # the first last: it says what is open
        j = j.withColumn(v, F.when(open_, F.coalesce(F.col(f"_{v}"), F.col(v))).otherwise(F.col(v)))
    return j.select(*table.columns)


def runtime_models(grid: DataFrame, extract_s: DataFrame) -> dict[str, DataFrame]:
    """Per-query cost of single methods and of ensembles, in milliseconds, from
    (recon, time_res, method, recon_s) and (method, fe_s)."""
    recon = grid.groupBy("recon", "time_res").agg(F.min("recon_s").alias("recon_s"))
    fe = grid.select("method").distinct().join(extract_s, "method")
    all_fe = fe.agg(F.sum("fe_s").alias("fe_all"))
    ms = lambda c: (F.avg(c) * 1000).alias("avg_ms")
    by_time = recon.groupBy("recon").agg(F.sum("recon_s").alias("r"), F.count("*").alias("n")).crossJoin(fe).withColumn("total", F.col("r") + F.col("n") * F.col("fe_s"))
    by_recon = recon.groupBy("time_res").agg(F.sum("recon_s").alias("r"), F.count("*").alias("n")).crossJoin(fe).withColumn("total", F.col("r") + F.col("n") * F.col("fe_s"))
    by_fe = recon.crossJoin(all_fe).withColumn("total", F.col("recon_s") + F.col("fe_all"))
    return {
        "single": grid.join(fe, "method").groupBy("method").agg(ms(F.col("recon_s") + F.col("fe_s"))),
        "over_time": by_time.groupBy("method").agg(ms("total")),
        "over_recon": by_recon.groupBy("time_res").agg(ms("total")),
        "over_method": by_fe.groupBy("time_res").agg(ms("total")),
        "complete": recon.agg(F.sum("recon_s").alias("r"), F.count("*").alias("n")).crossJoin(all_fe).select(((F.col("r") + F.col("n") * F.col("fe_all")) * 1000).alias("avg_ms")),
    }


def row_best(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds best_value and best_column (the first on ties) of each row."""
    top = F.greatest(*columns)
    name = F.coalesce(*[F.when(F.col(c) == top, F.lit(c)) for c in columns])
    return df.withColumn("best_value", top).withColumn("best_column", name)
