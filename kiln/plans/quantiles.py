"""P2 — exact, linearly interpolated quantiles without a per-group value map.

``percentile`` is exact but keeps every distinct value of a group in one
aggregation buffer, which does not survive a continuous column of 10^12 rows.
Here the exact order statistics are found by narrowing a value bracket:

1. ``percentile_approx`` over a fixed grid of probabilities (a mergeable sketch,
   partially aggregated on every partition) gives, per (group, prob), a value
   bracket that must contain the wanted ranks.
2. One counting pass counts the rows at and between the grid values of all wanted
   ranks, which places every rank exactly: on a grid value (solved, however
   many rows tie there) or strictly between two of them.
3. Repeat on the rows strictly inside the brackets (written once a round) until every bracket holds at most
   ``max_candidates`` rows; every round takes at least one value out of a bracket, so
   this ends without a limit of rounds.  Then a window numbers those rows and the two
   order statistics around rank (n-1)p are interpolated (pandas / ``quantile_cont``).
   A group that is small from the start is sorted once for all targets.

Input is long format: key columns + one numeric value column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kiln.core import col_list, few_rows, join_small, materialize

GRID = 1000
ACCURACY = 20000
MAX_CANDIDATES = 1 << 20


def _bracket(grid_col, t, m, pad: int = 3):
    """Grid values surely below / above the candidate rank ``t`` of ``m`` rows."""
    frac = F.when(m > 1, t / (m - 1)).otherwise(F.lit(0.0))
    i_lo = F.floor(frac * GRID).cast("int") - pad
    i_hi = F.ceil(frac * GRID).cast("int") + pad
    lo = F.when(i_lo >= 1, F.element_at(grid_col, F.greatest(i_lo, F.lit(1))))
    hi = F.when(i_hi <= GRID - 1, F.element_at(grid_col, F.least(i_hi, F.lit(GRID - 1))))
    return lo, hi


def _solve(data: DataFrame, keys: list[str], state: DataFrame, labels: list, bc: bool,
           max_candidates: int) -> DataFrame:
    """Resolve targets: one state row per key with, for every label i, the
    0-based ranks ``t{i}lo``/``t{i}hi`` and the interpolation weight ``f{i}``.

    Each of the two ranks is a target j of its own: ``r{j}`` its rank among the
    ``m{j}`` rows strictly between ``lo{j}`` and ``hi{j}`` (NULL = open), ``x{j}``
    its value once a bracket end turned out to be it (then ``m{j}`` = 0).

    Passes over the data never multiply rows by the number of targets: the
    first sketch is per key, a row is counted once by its place among all bracket
    ends of its key, and only rows inside a (narrow) bracket are written for a
    further round and expanded at the end.
    ``data`` has keys + ``__v`` (non-null).  Returns keys, __lab, __q.
    """
    idx = range(len(labels))
    jdx = range(2 * len(labels))
    null = F.lit(None).cast("double")
    state = state.select(*keys, "__n", *[c for i in idx for c in (f"t{i}lo", f"t{i}hi", f"f{i}")],
                         *[F.col(f"t{j // 2}{('lo', 'hi')[j % 2]}").alias(f"r{j}") for j in jdx],
                         *[c for j in jdx for c in (null.alias(f"lo{j}"), null.alias(f"hi{j}"), null.alias(f"x{j}"),
                                                    F.col("__n").alias(f"m{j}"))])

    def inside(j):
        return (F.col(f"x{j}").isNull() & (F.col(f"lo{j}").isNull() | (F.col("__v") > F.col(f"lo{j}")))
                & (F.col(f"hi{j}").isNull() | (F.col("__v") < F.col(f"hi{j}"))))

    def bracketed(st):
        """Rows inside a bracket of their key, beside its ends."""
        some = F.lit(False)
        for j in jdx:
            some = some | inside(j)
        return join_small(data, st.select(*keys, *[f"{c}{j}" for j in jdx for c in ("x", "lo", "hi")]), keys,
                          broadcast_small=bc).filter(some)

    def expanded(st):
        """(keys, __i, __v) for rows inside the bracket of target __i."""
        arr = F.array(*[F.when(inside(i), F.lit(i)) for i in jdx])
        return bracketed(st).select(*keys, "__v", F.explode(F.filter(arr, lambda x: x.isNotNull())).alias("__i"))

    grid = [g / GRID for g in range(1, GRID)]
    first = True
    while True:
        biggest = state.agg(F.greatest(*[F.max(f"m{j}") for j in jdx])).first()[0]
        if biggest is None or biggest <= max_candidates:
            break
        if first:
            # every bracket is still the whole group: one sketch per key
            sk = data.groupBy(*keys).agg(F.percentile_approx("__v", grid, ACCURACY).alias("__g"))
            st2 = join_small(state, sk, keys, broadcast_small=bc)
            gcol = {j: F.col("__g") for j in jdx}
        else:
            # rows outside all brackets are done with
            data = materialize(bracketed(state).select(*keys, "__v"))
            sk = (expanded(state).groupBy(*keys, "__i")
                  .agg(F.percentile_approx("__v", grid, ACCURACY).alias("__g")))
            wide = sk.groupBy(*keys).agg(*[F.max(F.when(F.col("__i") == j, F.col("__g"))).alias(f"__g{j}")
                                           for j in jdx])
            st2 = join_small(state, wide, keys, broadcast_small=bc, how="left")
            gcol = {j: F.col(f"__g{j}") for j in jdx}
        for j in jdx:
            nlo, nhi = _bracket(gcol[j], F.col(f"r{j}").cast("double"), F.col(f"m{j}").cast("double"))
            st2 = st2.withColumns({f"nlo{j}": nlo, f"nhi{j}": nhi})
        st2 = st2.drop("__g", *[f"__g{j}" for j in jdx])
        ends = F.array(*[F.when(F.col(f"x{j}").isNull(), F.col(f"{c}{j}")) for j in jdx for c in ("lo", "nlo", "nhi", "hi")])
        # the state is tiny (one row per group); pin it to keep the plan short
        st2 = materialize(st2.withColumn("__ends", F.array_sort(F.array_distinct(F.filter(ends, lambda e: e.isNotNull())))))
        width = st2.agg(F.max(F.size("__ends"))).first()[0]
        # the place of a row among the ends e0 < e1 < ... of its key: odd on an end, even between two
        rows = join_small(data, st2.select(*keys, *[F.get("__ends", F.lit(i)).alias(f"__e{i}") for i in range(width)]),
                          keys, broadcast_small=bc)
        place = F.lit(0)
        for i in range(width):
            place = place + F.when(F.col("__v") > F.col(f"__e{i}"), 2).when(F.col("__v") == F.col(f"__e{i}"), 1).otherwise(0)
        tallies = rows.groupBy(*keys, place.alias("__place")).agg(F.count(F.lit(1)).alias("__c")).groupBy(*keys).agg(
            F.collect_list(F.struct("__place", "__c")).alias("__tally"))       # twice the ends and one
        st3 = join_small(st2, tallies, keys, broadcast_small=bc, how="left")     # a solved key has no rows left

        def at(end):
            return 2 * F.array_position("__ends", end).cast("int") - 1

        def counted(cond):
            return F.coalesce(F.aggregate(F.filter("__tally", lambda e: F.coalesce(cond(e["__place"]), F.lit(False))),
                                          F.lit(0).cast("long"), lambda a, e: a + e["__c"]), F.lit(0).cast("long"))

        def within(j, cond):
            lo, hi = F.col(f"lo{j}"), F.col(f"hi{j}")
            return counted(lambda e: cond(e) & (lo.isNull() | (e > at(lo))) & (hi.isNull() | (e < at(hi))))

        cols = [*keys, "__n", *[c for i in idx for c in (f"t{i}lo", f"t{i}hi", f"f{i}")]]
        for j in jdx:
            r, m, lo, hi, nlo, nhi = (F.col(f"{c}{j}") for c in ("r", "m", "lo", "hi", "nlo", "nhi"))
            st3 = st3.withColumns({
                f"below{j}": within(j, lambda e: e < at(nlo)), f"at_lo{j}": within(j, lambda e: e == at(nlo)),
                f"above{j}": within(j, lambda e: e > at(nhi)),
                f"at_hi{j}": within(j, lambda e: (e == at(nhi)) & ~nhi.eqNullSafe(nlo))})
            to_lo = F.col(f"below{j}") + F.col(f"at_lo{j}")          # rows up to and with nlo
            to_hi = m - F.col(f"above{j}") - F.col(f"at_hi{j}")      # rows before nhi
            zones = [(F.col(f"x{j}").isNotNull(), (r, lo, hi, F.col(f"x{j}"), F.lit(0))),
                     (r < F.col(f"below{j}"), (r, lo, nlo, null, F.col(f"below{j}"))),
                     (r < to_lo, (r, lo, hi, nlo, F.lit(0))),
                     (r < to_hi, (r - to_lo, F.coalesce(nlo, lo), F.coalesce(nhi, hi), null, to_hi - to_lo)),
                     (r < to_hi + F.col(f"at_hi{j}"), (r, lo, hi, nhi, F.lit(0))),
                     (F.lit(True), (r - to_hi - F.col(f"at_hi{j}"), nhi, hi, null, F.col(f"above{j}")))]
            for k, name in enumerate(("r", "lo", "hi", "x", "m")):
                out = F.when(zones[0][0], zones[0][1][k])
                for cond, vals in zones[1:]:
                    out = out.when(cond, vals[k])
                cols.append(out.cast("long" if name in "rm" else "double").alias(f"{name}{j}"))
        state = materialize(st3.select(*cols))
        first = False

    lab_arr = F.array(*[F.lit(x) for x in labels])
    if first:
        # no narrowing was needed: each group has at most max_candidates rows,
        # so one sort per group serves every target
        w = Window.partitionBy(*keys).orderBy("__v")
        ranked = data.withColumn("__r", F.row_number().over(w) - 1)
        ranked = join_small(ranked, state.select(*keys, *[f"t{i}lo" for i in idx], *[f"t{i}hi" for i in idx]),
                            keys, broadcast_small=bc)
        hit = F.lit(False)
        for i in idx:
            hit = hit | (F.col("__r") == F.col(f"t{i}lo")) | (F.col("__r") == F.col(f"t{i}hi"))
        vals = ranked.filter(hit).groupBy(*keys).agg(*[x for i in idx for x in (
            F.max(F.when(F.col("__r") == F.col(f"t{i}lo"), F.col("__v"))).alias(f"a{i}"),
            F.max(F.when(F.col("__r") == F.col(f"t{i}hi"), F.col("__v"))).alias(f"b{i}"))])
        vals = join_small(vals, state.select(*keys, *[f"f{i}" for i in idx]), keys, broadcast_small=bc)
        return vals.select(*keys, F.inline(F.array(*[
            F.struct(F.element_at(lab_arr, i + 1).alias("__lab"),
                     (F.col(f"a{i}") + (F.col(f"b{i}") - F.col(f"a{i}")) * F.col(f"f{i}")).alias("__q"))
            for i in idx])))
    w = Window.partitionBy(*keys, "__i").orderBy("__v")
    ranked = expanded(state).withColumn("__r", F.row_number().over(w) - 1)
    ranks = state.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(j).alias("__i"), F.col(f"r{j}").alias("__t")) for j in jdx])).alias("__t")).select(
        *keys, "__t.*")
    ranked = join_small(ranked, ranks, keys + ["__i"], broadcast_small=bc).filter(F.col("__r") == F.col("__t"))
    picked = ranked.groupBy(*keys).agg(*[F.max(F.when(F.col("__i") == j, F.col("__v"))).alias(f"__p{j}") for j in jdx])
    solved = join_small(state, picked, keys, broadcast_small=bc, how="left")
    value = [F.coalesce(F.col(f"x{j}"), F.col(f"__p{j}")) for j in jdx]
    return solved.select(*keys, F.inline(F.array(*[
        F.struct(F.element_at(lab_arr, i + 1).alias("__lab"),
                 (value[2 * i] + (value[2 * i + 1] - value[2 * i]) * F.col(f"f{i}")).alias("__q")) for i in idx])))


def _prepare(long_df: DataFrame, keys: list[str], value: str, broadcast_state: bool | None):
    """(non-null rows, every group with its count, whether to broadcast tables of one row a group)."""
    rows = long_df.select(*keys, F.col(value).cast("double").alias("__v"))
    groups = materialize(rows.groupBy(*keys).agg(F.count("__v").alias("__n")))
    bc = not keys or few_rows(groups) if broadcast_state is None else broadcast_state
    return rows.filter(F.col("__v").isNotNull()), groups, bc


def _complete(groups, keys, labels_df, res, lab_name, bc):
    """Every group of the input (even all-NULL ones) gets a row per target."""
    if keys:
        full = groups.select(*keys).crossJoin(F.broadcast(labels_df))
        res = join_small(full, res, keys + ["__lab"], broadcast_small=bc, how="left")
    else:
        res = labels_df.join(res, "__lab", "left")
    return res.withColumnRenamed("__lab", lab_name)


def exact_quantiles(long_df: DataFrame, keys: Sequence[str] | str | None, value: str,
                    probs: Sequence[float], max_candidates: int = MAX_CANDIDATES,
                    broadcast_state: bool | None = None, approx: bool = False) -> DataFrame:
    """Exact quantiles of ``value`` per ``keys`` for each prob.

    Returns ``keys..., prob, quantile`` (NULL when a group has no non-null value).
    ``broadcast_state``: the per-(group, prob) state has one row per group and
    prob; broadcast it when the caller knows the group count is small (default:
    when the counted groups are few).  ``approx=True`` stops after the sketch: one
    pass, values are data points within rank error 1/ACCURACY (not interpolated).
    """
    keys = col_list(keys)
    if approx:
        probs = [float(p) for p in probs]
        data = long_df.select(*keys, F.col(value).cast("double").alias("__v"))
        sk = data.groupBy(*keys).agg(F.percentile_approx("__v", probs, ACCURACY).alias("__q"))
        return sk.select(*keys, F.posexplode("__q").alias("__i", "quantile")).select(
            *keys, F.element_at(F.array(*[F.lit(p) for p in probs]), F.col("__i") + 1).alias("prob"),
            "quantile")
    spark = long_df.sparkSession
    data, groups, bc = _prepare(long_df, keys, value, broadcast_state)
    counts = groups.filter("__n > 0") if keys else groups
    probs = [float(p) for p in probs]
    labels = spark.createDataFrame([(p,) for p in probs], "__lab double")
    cols = []
    for i, p in enumerate(probs):
        h = (F.col("__n") - 1) * F.lit(p)
        cols += [F.floor(h).cast("long").alias(f"t{i}lo"), F.ceil(h).cast("long").alias(f"t{i}hi"),
                 (h - F.floor(h)).alias(f"f{i}")]
    state = counts.select(*keys, "__n", *cols)
    res = _solve(data, keys, state, probs, bc, max_candidates).withColumnRenamed("__q", "quantile")
    return _complete(groups, keys, labels, res, "prob", bc)


def order_statistics(long_df: DataFrame, keys: Sequence[str] | str | None, value: str,
                     ranks: dict, max_candidates: int = MAX_CANDIDATES,
                     broadcast_state: bool | None = None) -> DataFrame:
    """Exact order statistics: ``ranks`` maps a name to fn(n_column) -> 0-based rank.

    Returns ``keys..., stat, value``.
    """
    keys = col_list(keys)
    spark = long_df.sparkSession
    data, groups, bc = _prepare(long_df, keys, value, broadcast_state)
    counts = groups.filter("__n > 0") if keys else groups
    names = list(ranks)
    labels = spark.createDataFrame([(n,) for n in names], "__lab string")
    cols = []
    for i, n in enumerate(names):
        rk = ranks[n](F.col("__n")).cast("long")
        cols += [rk.alias(f"t{i}lo"), rk.alias(f"t{i}hi"), F.lit(0.0).alias(f"f{i}")]
    state = counts.select(*keys, "__n", *cols)
    res = _solve(data, keys, state, names, bc, max_candidates).withColumnRenamed("__q", "value")
    return _complete(groups, keys, labels, res, "stat", bc)


def column_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
                     **kw) -> DataFrame:
    """Exact quantiles of several columns in one plan: ``column, prob, quantile``."""
    columns = list(columns)
    if not columns:
        raise ValueError("no columns")
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns
    ])).alias("__c")).select("__c.column", "__c.value")
    return exact_quantiles(long, ["column"], "value", probs,
                           broadcast_state=kw.pop("broadcast_state", True), **kw)


def quantile_row(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
                 name=lambda c, p: f"{c}__q{p}") -> DataFrame:
    """One-row frame with a column per (column, prob) — for broadcasting as limits."""
    q = column_quantiles(df, columns, probs)
    aggs = [F.max(F.when((F.col("column") == c) & (F.col("prob") == float(p)), F.col("quantile")))
            .alias(name(c, p)) for c in columns for p in probs]
    return q.agg(*aggs)
