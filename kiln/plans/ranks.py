"""P4 average ranks and P5 Kendall's tau-b over many column pairs at once.

Input is a long frame ``pair, x, y`` (rows where both values are present).

* Average ranks: distinct (pair, value) counts, an exclusive prefix sum of the
  counts in value order (distributed, :func:`prefix_sum`), rank =
  below + (count + 1) / 2, joined back on (pair, value).
* Kendall tau-b in O(n log n): with y replaced by its dense rank r, the number
  of discordant pairs equals the inversions of r in (x, y) order.  An inversion
  is counted once, at the highest bit where the two ranks differ: at bit level
  l, inside a group of equal ``r >> (l + 1)``, every element whose bit l is 0
  adds the number of bit-1 elements before it.  All levels are one prefix sum
  keyed by (pair, level, group).  Ties in x are never counted (y ascending
  inside equal x puts 0-bits first).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.core import join_small
from kiln.plans.ordering import ordered_index, prefix_sum


def average_ranks(long: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """``key, value, out``: pandas 'average' rank of each distinct value per key."""
    counts = long.groupBy(key, value).agg(F.count(F.lit(1)).alias("__c"))
    cum = prefix_sum(counts, [value], "__c", "__below", by=[key], inclusive=False)
    return cum.select(key, value, (F.col("__below") + (F.col("__c") + 1) / 2.0).alias(out))


def spearman_pairs(pairs: DataFrame) -> DataFrame:
    """``pair, r``: Pearson correlation of average ranks (pairwise complete)."""
    rx = average_ranks(pairs.select("pair", "x"), "pair", "x", "rx")
    ry = average_ranks(pairs.select("pair", "y"), "pair", "y", "ry")
    j = join_small(pairs, rx, ["pair", "x"])
    j = join_small(j, ry, ["pair", "y"])
    x, y = F.col("rx"), F.col("ry")
    return j.groupBy("pair").agg(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)).alias("r"))


def _tie_pairs(df: DataFrame, cols: list[str], name: str) -> DataFrame:
    t = df.groupBy("pair", *cols).agg(F.count(F.lit(1)).alias("__t"))
    return t.groupBy("pair").agg(F.sum(F.col("__t") * (F.col("__t") - 1) / 2).alias(name))


def kendall_pairs(pairs: DataFrame) -> DataFrame:
    """``pair, r``: Kendall tau-b (scipy / pandas definition)."""
    ys = pairs.select("pair", "y").distinct()
    ry = ordered_index(ys, ["y"], by=["pair"], idx_col="ry")
    data = join_small(pairs, ry, ["pair", "y"])
    levels = ry.agg(F.max("ry").alias("m")).first()["m"]      # one number
    nbits = max(1, int(levels or 0).bit_length())
    lv = data.select("pair", "x", "y", "ry", F.explode(F.sequence(F.lit(0), F.lit(nbits - 1))).alias("lvl"))
    lv = lv.select("pair", "x", "y", "lvl",
                   F.expr("shiftright(ry, lvl + 1)").alias("grp"),
                   F.expr("shiftright(ry, lvl) & 1").alias("bit"))
    cum = prefix_sum(lv, ["x", "y"], "bit", "__ones_before", by=["pair", "lvl", "grp"], inclusive=False)
    disc = cum.groupBy("pair").agg(
        F.sum(F.when(F.col("bit") == 0, F.col("__ones_before")).otherwise(F.lit(0))).alias("D"))
    n = pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    n1 = _tie_pairs(pairs, ["x"], "n1")
    n2 = _tie_pairs(pairs, ["y"], "n2")
    n3 = _tie_pairs(pairs, ["x", "y"], "n3")
    s = join_small(join_small(join_small(join_small(n, n1, ["pair"]), n2, ["pair"]), n3, ["pair"]),
                   disc, ["pair"], how="left")
    n0 = F.col("n").cast("double") * (F.col("n") - 1) / 2
    d = F.coalesce(F.col("D"), F.lit(0)).cast("double")
    c = n0 - F.col("n1") - F.col("n2") + F.col("n3") - d
    denom = F.sqrt((n0 - F.col("n1")) * (n0 - F.col("n2")))
    return s.select("pair", F.when(denom > 0, (c - d) / denom).alias("r"))
