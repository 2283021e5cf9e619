"""Distribution tables: histograms (H8, H10), KDE (H9), box statistics (H11-H13),
scatter-matrix and pair-plot data (H18, H19).

Every table is computed from per-column (or per-group) statistics joined back
onto the data; nothing is collected.  Columns are handled together in long
form (``column, value``) so a table of k columns is still one plan.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiln.core import few_rows, join_small, materialize, numeric_columns
from kiln.plans.quantiles import exact_quantiles
from kiln.plans.stats import to_long

HIST_BINS = 30
KDE_POINTS = 200
KDE_CHUNK = 50
BOX_WHISKER = 1.5
NOTCH = 1.57


def bin_index(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Equal-width bin of x in [lo, hi]; the last bin is closed."""
    return F.least(F.floor((x - lo) * F.lit(bins) / (hi - lo)).cast("int"), F.lit(bins - 1))


def _ranges(long: DataFrame, keys: list[str]) -> DataFrame:
    """min/max per key; a constant column gets the range [v - 0.5, v + 0.5]."""
    r = long.groupBy(*keys).agg(F.min("value").alias("__mn"), F.max("value").alias("__mx"),
                                F.count("value").alias("__n"))
    same = F.col("__mn") == F.col("__mx")
    return r.select(*keys, "__n",
                    F.when(same, F.col("__mn") - 0.5).otherwise(F.col("__mn")).alias("__lo"),
                    F.when(same, F.col("__mx") + 0.5).otherwise(F.col("__mx")).alias("__hi"))


def histogram(df: DataFrame, columns: Sequence[str] | None = None, bins: int = HIST_BINS,
              max_columns: int | None = None, group_by: str | None = None, density: bool = False) -> DataFrame:
    """Dense equal-width histogram per column (and group): ``[group,] column, bin,
    lower, upper, count[, density]``.  Bins span the column's range over all groups;
    density = count / (rows of the group * bin width)."""
    cols = numeric_columns(df, columns, max_columns)
    keep = [group_by] if group_by else []
    long = to_long(df, cols, keep=keep, keep_nulls=False)
    rng = _ranges(long, ["column"])
    j = join_small(long, rng.drop("__n"), ["column"], broadcast_small=True)
    counts = (j.withColumn("bin", bin_index(F.col("value"), F.col("__lo"), F.col("__hi"), bins))
              .groupBy(*keep, "column", "bin").agg(F.count(F.lit(1)).alias("count")))
    grid = rng.select("column", "__lo", "__hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    if group_by:
        groups = long.select(group_by, "column").distinct()
        grid = join_small(groups, grid, ["column"])
    width = (F.col("__hi") - F.col("__lo")) / bins
    out = join_small(grid, counts, keep + ["column", "bin"], how="left").select(
        *keep, "column", "bin",
        (F.col("__lo") + F.col("bin") * width).alias("lower"),
        (F.col("__lo") + (F.col("bin") + 1) * width).alias("upper"),
        F.coalesce(F.col("count"), F.lit(0)).alias("count"), width.alias("__w"))
    if density:
        tot = counts.groupBy(*keep, "column").agg(F.sum("count").alias("__tot"))
        out = join_small(out, tot, keep + ["column"]).withColumn(
            "density", F.col("count") / (F.col("__tot") * F.col("__w"))).drop("__tot")
    return out.drop("__w")


def kde(df: DataFrame, columns: Sequence[str] | None = None, points: int = KDE_POINTS,
        group_by: str | None = None, max_columns: int | None = None, binned: int | None = None) -> DataFrame:
    """Gaussian KDE on ``points`` grid points over [min, max] per column (and group),
    Scott bandwidth h = std(n-1) * n^(-1/5): ``[group,] column, point, x, density``.

    Exact by default: every row adds its kernel to all grid points inside one
    aggregation over one scan.  ``binned`` = number of equal bins d wide: rows are first
    shared out linearly to the bin edges, and kernels are taken once an edge instead of
    once a row; a density then differs by at most d^2 / (8 sqrt(2 pi) h^3).
    A column without spread (h = 0) or with one value has a NULL density.
    """
    cols = numeric_columns(df, columns, max_columns)
    keep = [group_by] if group_by else []
    long = to_long(df, cols, keep=keep, keep_nulls=False)
    st = long.groupBy(*keep, "column").agg(
        F.min("value").alias("__mn"), F.max("value").alias("__mx"),
        F.count("value").alias("__n"), F.stddev_samp("value").alias("__sd"))
    st = st.withColumn("__h", F.col("__sd") * F.pow(F.col("__n").cast("double"), F.lit(-0.2)))
    j = join_small(long, st, keep + ["column"], broadcast_small=not keep)
    if binned:
        j = _share_to_edges(j, keep, int(binned))
    step = (F.col("__mx") - F.col("__mn")) / (points - 1)
    weight = F.col("__weight") if binned else F.lit(1.0)
    # the grid is cut into runs of KDE_CHUNK points, as wider aggregation buffers fall out
    # of whole-stage code generation; a row meets the runs one after the other in its task
    runs = -(-points // KDE_CHUNK)
    j = j.withColumn("__run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    at = lambda k: F.col("__run") * KDE_CHUNK + k
    sums = []
    for k in range(min(points, KDE_CHUNK)):
        z = F.try_divide(F.col("__mn") + step * at(k) - F.col("value"), F.col("__h"))   # h = 0: NULL
        sums.append(F.sum(weight * F.exp(-0.5 * z * z)).alias(f"k{k}"))
    agg = j.groupBy(*keep, "column", "__mn", "__mx", "__n", "__h", "__run").agg(*sums)
    norm = F.col("__n") * F.col("__h") * F.lit(math.sqrt(2 * math.pi))
    recs = [F.struct(at(k).alias("point"), (F.col("__mn") + step * at(k)).alias("x"),
                     F.try_divide(F.col(f"k{k}"), norm).alias("density")) for k in range(len(sums))]
    return agg.select(*keep, "column", F.inline(F.array(*recs))).filter(F.col("point") < points)


def _share_to_edges(j: DataFrame, keep: list[str], bins: int) -> DataFrame:
    """Rows shared out to the two edges of their bin by their distance: ``value`` is an edge, ``__weight`` its share.

    At most ``bins`` + 1 rows per column (and group), counted map-side.
    """
    keys = keep + ["column", "__mn", "__mx", "__n", "__h"]
    place = F.coalesce(F.try_divide((F.col("value") - F.col("__mn")) * bins, F.col("__mx") - F.col("__mn")), F.lit(0.0))
    low = F.least(F.floor(place), F.lit(bins - 1))
    per_bin = (j.select(*keys, low.alias("__bin"), (place - low).alias("__part"))
               .groupBy(*keys, "__bin").agg(F.count(F.lit(1)).alias("__rows"), F.sum("__part").alias("__up")))
    ends = F.array(F.struct(F.col("__bin").alias("edge"), (F.col("__rows") - F.col("__up")).alias("share")),
                   F.struct((F.col("__bin") + 1).alias("edge"), F.col("__up").alias("share")))
    edges = (per_bin.select(*keys, F.inline(ends)).groupBy(*keys, "edge").agg(F.sum("share").alias("__weight")))
    return edges.withColumn("value", F.col("__mn") + (F.col("__mx") - F.col("__mn")) * F.col("edge") / bins)


def box_stats_long(long: DataFrame, keys: list[str], with_mean: bool = False,
                   whisker: float = BOX_WHISKER) -> tuple[DataFrame, DataFrame]:
    """(stats per key, outlier rows) for a long ``keys..., value`` frame."""
    data = long.filter(F.col("value").isNotNull())
    q = exact_quantiles(data, keys, "value", [0.25, 0.5, 0.75])
    qw = q.groupBy(*keys).agg(*[F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(n)
                                for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])
    qw = (qw.withColumn("iqr", F.col("q3") - F.col("q1"))
          .withColumn("fence_low", F.col("q1") - whisker * F.col("iqr"))
          .withColumn("fence_high", F.col("q3") + whisker * F.col("iqr")))
    qw = materialize(qw)        # one row per key; rows meet their fences without a shuffle while the keys are few
    bc = few_rows(qw)
    j = join_small(data, qw.select(*keys, "fence_low", "fence_high"), keys, broadcast_small=bc)
    inside = (F.col("value") >= F.col("fence_low")) & (F.col("value") <= F.col("fence_high"))
    aggs = [F.count(F.lit(1)).alias("n"),
            F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
            F.count_if(~inside).alias("n_outliers")]
    if with_mean:
        aggs.append(F.avg("value").alias("mean"))
    a = j.groupBy(*keys).agg(*aggs)
    stats = join_small(qw, a, keys, broadcast_small=bc)
    half = NOTCH * F.col("iqr") / F.sqrt(F.col("n").cast("double"))
    stats = stats.withColumn("notch_low", F.col("median") - half).withColumn("notch_high", F.col("median") + half)
    outliers = j.filter(~inside).select(*keys, "value")
    return stats, outliers


def box_stats_by_category(df: DataFrame, value_col: str, category_col: str) -> tuple[DataFrame, DataFrame]:
    """Box statistics of ``value_col`` per category (H11) and the outlier rows."""
    long = df.select(F.col(f"`{category_col}`").alias(category_col),
                     F.col(f"`{value_col}`").cast("double").alias("value"))
    return box_stats_long(long, [category_col])


def box_stats_columns(df: DataFrame, columns: Sequence[str] | None = None,
                      max_columns: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Box statistics plus mean per numeric column."""
    cols = numeric_columns(df, columns, max_columns)
    return box_stats_long(to_long(df, cols), ["column"], with_mean=True)


def scatter_matrix(df: DataFrame, columns: Sequence[str] | None = None, color_col: str | None = None,
                   bins: int = HIST_BINS, max_columns: int | None = None, dropna_all: bool = False) -> DataFrame:
    """Binned scatter-matrix data for every pair below the diagonal:
    ``[color,] column_x, column_y, bin_x, bin_y, count`` (non-empty cells).

    A pair uses the rows where both values are present (``dropna_all`` first
    drops rows with any NULL, as the pair plot does).  Bins span each column's range.
    """
    cols = numeric_columns(df, columns, max_columns)
    keep = [color_col] if color_col else []
    base = df.select(*keep, *cols)
    if dropna_all:
        base = base.dropna(how="any")
    rng = _ranges(to_long(base, cols, keep_nulls=False), ["column"])
    lim = rng.agg(*[x for c in cols for x in (
        F.max(F.when(F.col("column") == c, F.col("__lo"))).alias(f"{c}__lo"),
        F.max(F.when(F.col("column") == c, F.col("__hi"))).alias(f"{c}__hi"))])
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], "column_x string, column_y string")
    # each column is binned once a row; a cell of a pair is one integer, so that rows
    # times pairs exist only as integers on the way into the map-side counts
    binned = base.crossJoin(F.broadcast(lim)).select(*keep, *[
        F.when(F.col(f"`{c}`").isNotNull(), bin_index(F.col(f"`{c}`").cast("double"), F.col(f"`{c}__lo`"),
                                                      F.col(f"`{c}__hi`"), bins)).alias(f"__b{i}")
        for i, c in enumerate(cols)])
    pairs = [(k, i) for i in range(len(cols)) for k in range(i)]   # x = earlier column, y = later (below diagonal)
    cells = F.array(*[F.lit(p).cast("long") * (bins * bins) + F.col(f"__b{k}") * bins + F.col(f"__b{i}")
                      for p, (k, i) in enumerate(pairs)])
    counts = (binned.select(*keep, F.explode(cells).alias("__cell")).filter(F.col("__cell").isNotNull())
              .groupBy(*keep, "__cell").agg(F.count(F.lit(1)).alias("count")))
    pair = F.floor(F.col("__cell") / (bins * bins)).cast("int")
    name = lambda side: F.element_at(F.array(*[F.lit(cols[p[side]]) for p in pairs]), pair + 1)
    within = F.pmod(F.col("__cell"), F.lit(bins * bins))
    return counts.select(*keep, name(0).alias("column_x"), name(1).alias("column_y"),
                         F.floor(within / bins).cast("int").alias("bin_x"),
                         F.pmod(within, F.lit(bins)).cast("int").alias("bin_y"), "count")


def pair_plot(df: DataFrame, hue: str | None = None, max_columns: int | None = None,
              bins: int = HIST_BINS) -> tuple[DataFrame, DataFrame]:
    """Pair-plot data (H19): binned off-diagonal cells and per-hue KDE on the
    diagonal, over the rows with no NULL in the chosen columns (and hue)."""
    cols = numeric_columns(df, None, max_columns)
    keep = [hue] if hue else []
    base = df.select(*keep, *cols).dropna(how="any")
    return (scatter_matrix(base, cols, hue, bins, max_columns),
            kde(base, cols, group_by=hue))
