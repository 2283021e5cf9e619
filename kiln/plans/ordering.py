"""P3 — global row order without moving every row into one task.

``Window.orderBy`` with no ``partitionBy`` sends the whole table to a single
task.  Instead:

* ``assign_buckets`` range partitions the rows on the full order key, ties
  spread by row (so a hot group or value is split over many buckets), and pins
  the bucket of every row with a reliable checkpoint.
* ``ordered_index`` numbers rows inside each (group, bucket) and shifts them by
  the counts of earlier buckets.  The offset table has one row per
  (group, bucket) and, without groups, one row per bucket, so it is broadcast
  with a proven size bound.
* ``hash_places`` tells on which side of a few positions every row stands in the order
  of a hash: a count of rows by the first bits of the hash decides for all rows but
  those of the cells that a position cuts, and only these are put in order.
* ``bounded_window`` evaluates any window expression whose frame lies within
  ``[-before, +after]`` rows over that index: rows are cut into buckets of
  ``bucket_rows`` consecutive positions, the few rows near a bucket edge are
  copied into the neighbouring bucket as read-only context ("halo"), the window
  runs per bucket, and the copies are dropped.  Exact for every bounded frame.
* ``frame_sums`` adds up wide frames (any number of rows) from running sums inside
  small blocks, so that no task holds a frame.
* ``fill_forward`` / ``fill_backward`` carry the last (first) non-null value
  across buckets through a per-bucket summary table (one row per bucket).

The order must be total (ties make positions arbitrary, exactly as a sort would).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kiln.core import col_list, ensure_checkpoint_dir, few_rows, join_small, materialize

DEFAULT_BUCKET_ROWS = 1 << 20
TARGET_BUCKET_ROWS = 1 << 21
SUM_BLOCK_ROWS = 1 << 18
#: First bits of a hash by which ``hash_places`` counts rows.
HASH_CELL_BITS = 12


def _partitions(df: DataFrame, num_partitions: int | None) -> int:
    if num_partitions:
        return int(num_partitions)
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _order_cols(order_by) -> list[Column]:
    return [c if isinstance(c, Column) else F.col(c) for c in col_list(order_by)]


def assign_buckets(df: DataFrame, order_by, num_buckets: int | None = None) -> DataFrame:
    """Add ``__bk``: contiguous ranges of the full order key, in order (NULLs first).

    Rows are range partitioned on (order key, row hash, row number of the input)
    and the partition id is pinned with a reliable checkpoint, so all later reads
    agree.  The last two only order rows whose keys tie (their relative order is
    arbitrary anyway), so that a hot key value, even of equal rows, is spread over
    many partitions.  The number of ranges follows the row count, about
    TARGET_BUCKET_ROWS rows each, without an upper limit.
    """
    ensure_checkpoint_dir(df.sparkSession)
    order = _order_cols(order_by)
    k = num_buckets or max(_partitions(df, None), -(-df.count() // TARGET_BUCKET_ROWS))
    tied = df.withColumns({"__bk_tie": F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]),
                           "__bk_row": F.monotonically_increasing_id()})
    ranged = tied.repartitionByRange(int(k), *order, "__bk_tie", "__bk_row").drop("__bk_tie", "__bk_row")
    return ranged.withColumn("__bk", F.spark_partition_id()).checkpoint(eager=True)


def ordered_index(df: DataFrame, order_by, by=None, idx_col: str = "_idx",
                  num_buckets: int | None = None) -> DataFrame:
    """Add a 0-based dense position ``idx_col`` following ``order_by`` within ``by``.

    Equivalent to ``row_number() over (partition by by order by order_by) - 1``
    but no group, however large, is held by one task: rows are cut into value
    ranges of the order key, numbered inside each (group, range), and shifted by
    the row counts of the earlier ranges of the group.
    """
    by = col_list(by)
    order = _order_cols(order_by)
    d = assign_buckets(df, order_by, num_buckets)
    w = Window.partitionBy(*by, "__bk").orderBy(*order)
    local = d.withColumn("__rn", F.row_number().over(w) - 1)
    counts = d.groupBy(*by, "__bk").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*by).orderBy("__bk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, "__bk", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    # Without groups the offset table has one row per bucket (rows / TARGET_BUCKET_ROWS).
    joined = join_small(local, offsets, by + ["__bk"], broadcast_small=not by)
    return (joined.withColumn(idx_col, (F.col("__off") + F.col("__rn")).cast("long"))
            .drop("__bk", "__rn", "__off"))


def hash_places(df: DataFrame, order_by: Sequence[str], bounds, n_bounds: int, by=None,
                place_col: str = "_place") -> DataFrame:
    """Add ``place_col``: how many of its group's bounds are at or below the row's 0-based
    position in the order of ``order_by`` within ``by``.

    ``order_by`` is a total order whose first column is a 64-bit hash.  ``bounds(sizes)``
    takes one row a group (the columns of ``by``, ``__c`` rows, ``__first`` their smallest
    hash) and gives it ``__b0``, ``__b1``, ...: ``n_bounds`` positions.  Equal to counting
    bounds against :func:`ordered_index`, but only the rows of the hash cells that a bound
    cuts are ordered (those that share their first HASH_CELL_BITS bits, so all rows of a hot
    hash); for the others the counts of the cells, 2^HASH_CELL_BITS a group, decide.
    """
    by, never = col_list(by), 1 << 30
    cell, h = F.col("__cell"), F.col(f"`{order_by[0]}`")
    numbered = df.withColumn("__cell", F.shiftright(h, 64 - HASH_CELL_BITS).cast("int"))
    cells = materialize(numbered.groupBy(*by, "__cell").agg(F.count(F.lit(1)).alias("__n"), F.min(h).alias("__first")))
    sizes = cells.groupBy(*by).agg(F.sum("__n").alias("__c"), F.min("__first").alias("__first"))
    upto = F.sum("__n").over(Window.partitionBy(*by).orderBy("__cell"))      # cells of a group, not rows
    runs = join_small(cells.withColumn("__s", upto - F.col("__n")), bounds(sizes).drop("__c", "__first"), by)
    s, e, js = F.col("__s"), F.col("__s") + F.col("__n"), range(n_bounds)
    # a bound is below all rows from its first cell on, and cuts one cell at most
    cut = [(s < F.col(f"__b{j}")) & (F.col(f"__b{j}") < e) for j in js]
    sides = materialize(runs.groupBy(*by).agg(*[x for j in js for x in (
        F.min(f"__b{j}").alias(f"__b{j}"), F.min(F.when(cut[j], s)).alias(f"__s{j}"),
        F.coalesce(F.min(F.when(s >= F.col(f"__b{j}"), cell)), F.lit(never)).alias(f"__from{j}"),
        F.coalesce(F.min(F.when(cut[j], cell)), F.lit(never)).alias(f"__cut{j}"))]))
    few = not by or few_rows(sides)
    rows = join_small(numbered, sides, by, broadcast_small=few)
    inside, place = F.lit(False), F.lit(0)
    for j in js:
        inside, place = inside | (cell == F.col(f"__cut{j}")), place + (cell >= F.col(f"__from{j}")).cast("int")
    outside = rows.filter(~inside).select(*df.columns, place.alias(place_col))
    near = materialize(rows.filter(inside).select(*df.columns, "__cell", F.coalesce(
        *[F.when(cell == F.col(f"__cut{j}"), F.col(f"__s{j}")) for j in js]).alias("__s")))
    ranked = ordered_index(near, list(order_by), by=[*by, "__cell"], idx_col="__i",
                           num_buckets=-(-max(1, near.count()) // DEFAULT_BUCKET_ROWS))
    place = F.lit(0)
    for j in js:
        place = place + (F.col(f"__b{j}") <= F.col("__s") + F.col("__i")).cast("int")
    ranked = join_small(ranked, sides.select(*by, *[f"__b{j}" for j in js]), by, broadcast_small=few)
    return outside.unionByName(ranked.select(*df.columns, place.alias(place_col)))


def bounded_window(df: DataFrame, idx_col: str, compute, before: int = 0,
                   after: int = 0, by=None,
                   bucket_rows: int = DEFAULT_BUCKET_ROWS) -> DataFrame:
    """Evaluate window columns whose frames stay within ``[-before, +after]`` rows.

    ``compute(w)`` receives ``Window.partitionBy(by, bucket).orderBy(idx_col)`` and
    returns ``[(name, column), ...]``.  ``idx_col`` must be dense and increasing
    inside each ``by`` group (as made by :func:`ordered_index`); a constant gap
    at the start (e.g. positions starting at 1) is fine.
    """
    by = col_list(by)
    b = max(int(bucket_rows), before + 1, after + 1)
    idx = F.col(idx_col)
    bk = F.floor(idx / F.lit(b)).cast("long")
    pos = F.pmod(idx, F.lit(b))
    copies = F.array(
        F.struct(bk.alias("__bk"), F.lit(False).alias("__halo")),
        F.when(pos >= b - before, F.struct((bk + 1).alias("__bk"), F.lit(True).alias("__halo")))
        if before > 0 else F.lit(None),
        F.when((pos < after) & (bk > 0), F.struct((bk - 1).alias("__bk"), F.lit(True).alias("__halo")))
        if after > 0 else F.lit(None),
    )
    exploded = (df.withColumn("__c", F.explode(F.filter(copies, lambda x: x.isNotNull())))
                .withColumn("__bk", F.col("__c.__bk")).withColumn("__halo", F.col("__c.__halo"))
                .drop("__c"))
    w = Window.partitionBy(*by, "__bk").orderBy(idx_col)
    out = exploded.select("*", *[c.alias(n) for n, c in compute(w)])
    return out.filter(~F.col("__halo")).drop("__bk", "__halo")


def fill_forward(df: DataFrame, columns: Sequence[str], order_by,
                 num_buckets: int | None = None, then_backward: bool = False) -> DataFrame:
    """pandas ``ffill`` over a global order (optionally followed by ``bfill``).

    Inside a value-range bucket: ``last(ignorenulls)`` over the running frame.
    Across buckets: the last non-null value of every bucket (one row per
    bucket, broadcast) is carried to the following buckets.
    """
    columns = list(columns)
    if not columns:
        return df
    order = _order_cols(order_by)
    okey = F.struct(*order)
    d = assign_buckets(df, order_by, num_buckets).withColumn("__ok", okey)
    summary_aggs = []
    for i, c in enumerate(columns):
        summary_aggs.append(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("__ok"))).alias(f"__last{i}"))
        if then_backward:
            summary_aggs.append(F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("__ok"))).alias(f"__first{i}"))
    summary = d.groupBy("__bk").agg(*summary_aggs)
    prev = Window.orderBy("__bk").rowsBetween(Window.unboundedPreceding, -1)
    # "first non-null after" as a running frame in descending order: frames that
    # end at unboundedFollowing are re-aggregated per row (quadratic)
    nxt = Window.orderBy(F.col("__bk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry_cols = [F.col("__bk")]
    for i, _ in enumerate(columns):
        carry_cols.append(F.last(f"__last{i}", ignorenulls=True).over(prev).alias(f"__cf{i}"))
        if then_backward:
            # first non-null anywhere at or after the next bucket (for leading nulls)
            carry_cols.append(F.last(f"__first{i}", ignorenulls=True).over(nxt).alias(f"__cb{i}"))
    carry = summary.select(*carry_cols)
    w_run = Window.partitionBy("__bk").orderBy("__ok").rowsBetween(Window.unboundedPreceding, 0)
    w_rest = Window.partitionBy("__bk").orderBy(F.col("__ok").desc()).rowsBetween(Window.unboundedPreceding, 0)
    filled = d
    for i, c in enumerate(columns):
        filled = filled.withColumn(f"__in{i}", F.last(F.col(c), ignorenulls=True).over(w_run))
        if then_backward:
            filled = filled.withColumn(f"__inb{i}", F.last(F.col(c), ignorenulls=True).over(w_rest))
    # one row per bucket: bounded by the bucket count
    filled = filled.join(F.broadcast(carry), "__bk", "left")
    out_cols = []
    for f in df.schema.fields:
        if f.name in columns:
            i = columns.index(f.name)
            parts = [F.col(f"__in{i}"), F.col(f"__cf{i}")]
            if then_backward:
                parts += [F.col(f"__inb{i}"), F.col(f"__cb{i}")]
            out_cols.append(F.coalesce(*parts).cast(f.dataType).alias(f.name))
        else:
            out_cols.append(F.col(f.name))
    return filled.select(*out_cols)


def fill_backward(df: DataFrame, columns: Sequence[str], order_by,
                  num_buckets: int | None = None) -> DataFrame:
    """pandas ``bfill`` over a global order; trailing nulls stay null."""
    columns = list(columns)
    if not columns:
        return df
    order = _order_cols(order_by)
    d = assign_buckets(df, order_by, num_buckets).withColumn("__ok", F.struct(*order))
    summary = d.groupBy("__bk").agg(*[
        F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("__ok"))).alias(f"__first{i}")
        for i, c in enumerate(columns)])
    nxt = Window.orderBy(F.col("__bk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select("__bk", *[
        F.last(f"__first{i}", ignorenulls=True).over(nxt).alias(f"__cb{i}")
        for i, _ in enumerate(columns)])
    w_rest = Window.partitionBy("__bk").orderBy(F.col("__ok").desc()).rowsBetween(Window.unboundedPreceding, 0)
    filled = d
    for i, c in enumerate(columns):
        filled = filled.withColumn(f"__inb{i}", F.last(F.col(c), ignorenulls=True).over(w_rest))
    filled = filled.join(F.broadcast(carry), "__bk", "left")
    out_cols = []
    for f in df.schema.fields:
        if f.name in columns:
            i = columns.index(f.name)
            out_cols.append(F.coalesce(F.col(f"__inb{i}"), F.col(f"__cb{i}")).cast(f.dataType).alias(f.name))
        else:
            out_cols.append(F.col(f.name))
    return filled.select(*out_cols)


def prefix_sums(df: DataFrame, order_by, values: dict, by=None, inclusive: bool = True,
                num_buckets: int | None = None) -> DataFrame:
    """Running sums in ``order_by`` order within ``by`` (P4); ``values`` maps an
    output column to the column to sum.

    One set of buckets carries the order for all of them; a per-(group, bucket)
    total table gives the offsets; inside a bucket a running-frame sum finishes
    the job.
    """
    by = col_list(by)
    order = _order_cols(order_by)
    names = list(values)
    d = assign_buckets(df.withColumns({f"__v{i}": F.col(v) if isinstance(v, str) else v
                                       for i, v in enumerate(values.values())}), order_by, num_buckets)
    totals = d.groupBy(*by, "__bk").agg(*[F.sum(f"__v{i}").alias(f"__t{i}") for i in range(len(names))])
    before = Window.partitionBy(*by).orderBy("__bk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "__bk", *[F.coalesce(F.sum(f"__t{i}").over(before), F.lit(0)).alias(f"__off{i}")
                                           for i in range(len(names))])
    w = Window.partitionBy(*by, "__bk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = d.withColumns({f"__loc{i}": F.coalesce(F.sum(f"__v{i}").over(w), F.lit(0)) for i in range(len(names))})
    joined = join_small(local, offsets, by + ["__bk"], broadcast_small=not by)
    return joined.withColumns({n: F.col(f"__off{i}") + F.col(f"__loc{i}") for i, n in enumerate(names)}).drop(
        "__bk", *[f"__{p}{i}" for p in ("v", "off", "loc") for i in range(len(names))])


def prefix_sum(df: DataFrame, order_by, value: Column | str, out_col: str,
               by=None, inclusive: bool = True,
               num_buckets: int | None = None) -> DataFrame:
    """One running sum: see :func:`prefix_sums`."""
    return prefix_sums(df, order_by, {out_col: value}, by, inclusive, num_buckets)


def frame_sums(df: DataFrame, idx_col: str, value_col: str, before: int, after: int,
               carry: Sequence[str] = (), out_col: str = "__sum",
               block_rows: int = SUM_BLOCK_ROWS) -> DataFrame:
    """Sum of ``value_col`` over the rows ``[-before, +after]`` of the dense 0-based index.

    Returns ``idx_col, carry..., value_col, out_col``; ``out_col`` is NULL where the
    frame is not full; ``value_col`` holds no NULL.  Positions are cut into spans as long as
    the frame, so a frame is the end of one span and the start of the next: its sum
    is a running sum from the right at its first row plus one from the left at its
    last row.  Running sums are taken inside blocks of at most ``block_rows`` rows and
    carried over the blocks of a span through a table of one row per block, so the
    work is cut by ``block_rows`` and not by the frame.  Sums are only added, never
    subtracted: rows outside a frame cannot cost it digits.  The two sums then meet
    their row by the shifted index.
    """
    width = before + after + 1
    idx = F.col(idx_col)
    cut = df.select(idx_col, *carry, value_col, F.floor(idx / F.lit(width)).alias("__span"),
                    F.floor(F.pmod(idx, F.lit(width)) / F.lit(int(block_rows))).alias("__block"))
    key = ["__span", "__block"]
    upto = Window.partitionBy(*key).orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
    since = Window.partitionBy(*key).orderBy(idx.desc()).rowsBetween(Window.unboundedPreceding, 0)
    sums = cut.withColumn("__upto", F.sum(value_col).over(upto)).withColumn("__since", F.sum(value_col).over(since))
    if width > block_rows:
        totals = cut.groupBy(*key).agg(F.sum(value_col).alias("__all"))
        left = Window.partitionBy("__span").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
        right = Window.partitionBy("__span").orderBy(F.col("__block").desc()).rowsBetween(
            Window.unboundedPreceding, -1)
        offsets = totals.select(*key, F.coalesce(F.sum("__all").over(left), F.lit(0.0)).alias("__left"),
                                F.coalesce(F.sum("__all").over(right), F.lit(0.0)).alias("__right"))
        sums = join_small(sums, offsets, key).withColumns({
            "__upto": F.col("__left") + F.col("__upto"), "__since": F.col("__since") + F.col("__right")})
    # every row goes to its own place, its sum from the right to the row whose frame it
    # opens and its sum from the left to the row whose frame it closes
    none = F.lit(None).cast("double")
    close = F.when(F.pmod(idx + 1, F.lit(width)) == 0, F.lit(0.0)).otherwise(F.col("__upto"))   # 0: frame = span
    parts = [F.struct(idx.alias("__at"), F.lit(True).alias("__own"), none.alias("__open"), none.alias("__close")),
             F.struct((idx + before).alias("__at"), F.lit(False).alias("__own"), F.col("__since").alias("__open"),
                      none.alias("__close")),
             F.struct((idx - after).alias("__at"), F.lit(False).alias("__own"), none.alias("__open"),
                      close.alias("__close"))]
    sent = sums.select(*carry, value_col, F.explode(F.array(*parts)).alias("__p")).select(
        "__p.*", *[F.when(F.col("__p.__own"), F.col(c)).alias(c) for c in (*carry, value_col)])
    met = sent.groupBy("__at").agg(
        F.max("__own").alias("__own"), F.max("__open").alias("__open"), F.max("__close").alias("__close"),
         *[F.max(c).alias(c) for c in (*carry, value_col)])
    return met.filter("__own").select(F.col("__at").alias(idx_col), *carry, value_col,
                                      (F.col("__open") + F.col("__close")).alias(out_col))
