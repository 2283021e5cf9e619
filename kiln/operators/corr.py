"""Correlation matrices (H6a-c) and the lower triangle (H7).

Output is long: ``column_a, column_b, r`` for every ordered pair of numeric
columns (the full matrix, diagonal included), pairwise-complete as pandas.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.core import join_small, materialize, numeric_columns
from kiln.plans.comoments import comoments, pearson
from kiln.plans.ranks import average_ranks, kendall_pairs, spearman_pairs


def _pairs(cols):
    return [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]


def pair_rows(df: DataFrame, cols: Sequence[str], only=None) -> DataFrame:
    """Long ``pair, x, y`` of the column pairs (all, or the ids in ``only``),
    rows where both are present."""
    arr = F.array(*[F.struct(F.lit(k).alias("pair"), F.col(f"`{cols[i]}`").cast("double").alias("x"),
                             F.col(f"`{cols[j]}`").cast("double").alias("y"))
                    for k, (i, j) in enumerate(_pairs(cols)) if only is None or k in only])
    return (df.select(F.explode(arr).alias("__p")).select("__p.pair", "__p.x", "__p.y")
            .filter(F.col("x").isNotNull() & F.col("y").isNotNull()))


def correlation_matrix(df: DataFrame, method: str = "pearson", columns: Sequence[str] | None = None,
                       min_cols: int = 2) -> DataFrame | None:
    """Full correlation matrix in long form; None with fewer than ``min_cols`` columns."""
    cols = numeric_columns(df, columns)
    if len(cols) < min_cols:
        return None
    spark = df.sparkSession
    pairs = _pairs(cols)
    x = [F.col(f"`{c}`").cast("double") for c in cols]
    diag_aggs = [F.count(x[i]).alias(f"n{i}") for i in range(len(cols))] + \
                [F.stddev_pop(x[i]).alias(f"s{i}") for i in range(len(cols))]
    names = spark.createDataFrame([(k, cols[i], cols[j], i, j) for k, (i, j) in enumerate(pairs)],
                                  "pair int, column_a string, column_b string, pos_a int, pos_b int")
    if method == "kendall":
        diag = [F.when(F.col(f"n{i}") >= 1, F.lit(1.0)) for i in range(len(cols))]
    else:
        diag = [F.when((F.col(f"n{i}") >= 2) & (F.col(f"s{i}") > 0), F.lit(1.0)) for i in range(len(cols))]
    diag_structs = [F.struct(F.lit(c).alias("column_a"), F.lit(c).alias("column_b"), F.lit(i).alias("pos_a"),
                             F.lit(i).alias("pos_b"), diag[i].cast("double").alias("r"))
                    for i, c in enumerate(cols)]
    if method == "pearson":
        m = comoments(df, cols).withColumn("r", pearson())
        diagonal = F.when((F.col("n") >= 2) & (F.col("sxx") > 0), F.lit(1.0))
        name = F.array(*[F.lit(c) for c in cols])
        cell = lambda a, b, r: F.struct(name[F.col(a)].alias("column_a"), name[F.col(b)].alias("column_b"),
                                        F.col(a).alias("pos_a"), F.col(b).alias("pos_b"), r.alias("r"))
        return m.select(F.inline(F.when(F.col("i") == F.col("j"), F.array(cell("i", "j", diagonal))).otherwise(
            F.array(cell("i", "j", F.col("r")), cell("j", "i", F.col("r"))))))
    if method not in ("spearman", "kendall"):
        raise ValueError(f"unknown correlation method {method!r}")
    if method == "spearman":
        vals = _spearman_values(df, cols, pairs)
    else:
        vals = kendall_pairs(pair_rows(df, cols))
    off = join_small(names, vals, ["pair"], broadcast_small=True, how="left")
    both = off.select(F.inline(F.array(
        F.struct("column_a", "column_b", "pos_a", "pos_b", "r"),
        F.struct(F.col("column_b").alias("column_a"), F.col("column_a").alias("column_b"),
                 F.col("pos_b").alias("pos_a"), F.col("pos_a").alias("pos_b"), "r"))))
    d = df.agg(*diag_aggs).select(F.inline(F.array(*diag_structs)))
    return both.unionByName(d)


def _spearman_values(df: DataFrame, cols: list[str], pairs: list[tuple[int, int]]) -> DataFrame:
    """``pair, r`` for Spearman.

    Columns without NULLs share one global ranking (pairwise-complete rows are
    all rows), so their pairs cost k ranked columns instead of k(k-1)/2 pair
    copies of the data.  Pairs that touch a column with NULLs are ranked per pair.
    """
    spark = df.sparkSession
    nulls = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in cols]).first()  # one per column
    full = [c for c in cols if nulls[c] == 0]
    full_pairs = [k for k, (i, j) in enumerate(pairs) if cols[i] in full and cols[j] in full]
    parts = []
    if full_pairs:
        base = materialize(df.select(*full).withColumn("__rid", F.monotonically_increasing_id()))
        long = base.select("__rid", F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("value")) for c in full
        ])).alias("__c")).select("__rid", "__c.column", "__c.value")
        ranks = average_ranks(long.select("column", "value"), "column", "value", "rank")
        ranked = join_small(long, ranks, ["column", "value"])
        wide = ranked.groupBy("__rid").agg(*[F.max(F.when(F.col("column") == c, F.col("rank"))).alias(c)
                                             for c in full])
        number = {(full.index(cols[pairs[k][0]]), full.index(cols[pairs[k][1]])): k for k in full_pairs}
        at = spark.createDataFrame([(i, j, k) for (i, j), k in number.items()], "i int, j int, pair int")
        parts.append(comoments(wide, full).withColumn("r", pearson()).join(F.broadcast(at), ["i", "j"]).select("pair", "r"))
    rest = [k for k in range(len(pairs)) if k not in set(full_pairs)]
    if rest:
        sub = pair_rows(df, cols, only=set(rest))
        parts.append(spearman_pairs(sub))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def lower_triangle(corr: DataFrame) -> DataFrame:
    """Cells strictly below the diagonal (upper triangle and diagonal hidden)."""
    return corr.filter(F.col("pos_a") > F.col("pos_b"))
