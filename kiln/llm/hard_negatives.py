"""Hard-negative mining by a BOND vertical scan.

Vectors are kept by column (one array per dimension).  For each anchor the columns
are read in the order of its largest components; after each group of columns, what
the columns not yet read can still add (from each column's minimum and maximum)
bounds the score of every candidate from below and above, and the candidate bitmap
shrinks to the rows that can still be an answer.

Rows and anchors are dealt into blocks of bounded size; a task holds one block of
each, and Spark merges the best rows of all blocks.  First each anchor's positives
are found, then, with their scores known everywhere, the negatives in the windows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kiln.llm.common import staged

#: Rows and anchors that one task holds at once.
ROW_BLOCK, ANCHOR_BLOCK = 4096, 4096
#: Columns read between two looks at the bounds.
STEP = 8


class Columns:
    """A block of vectors by column, with the minimum and maximum of each."""

    def __init__(self, ids, labels, vectors):
        self.ids = np.asarray(ids, np.int64)
        self.labels = np.asarray(labels)
        width = max((len(v) for v in vectors), default=0)
        self.at = np.zeros((width, len(self.ids)))
        for k, v in enumerate(vectors):  # shorter vectors count zeros for what they lack
            self.at[:len(v), k] = v
        self.low = self.at.min(axis=1, initial=0)
        self.high = self.at.max(axis=1, initial=0)


def _scan(block: Columns, anchor: np.ndarray, alive: np.ndarray, keep):
    """(rows, scores) of the rows of the index array ``alive`` that ``keep(low, high)``,
    a mask from bounds of the scores, lets through to the end, with exact scores."""
    width = min(len(anchor), len(block.low))
    order = np.argsort(-np.abs(anchor[:width]), kind="stable")
    a = anchor[order]
    ends = np.stack([a * block.low[order], a * block.high[order]])
    least = np.append(np.cumsum(ends.min(axis=0)[::-1])[::-1], 0.0)  # of the columns from k on
    most = np.append(np.cumsum(ends.max(axis=0)[::-1])[::-1], 0.0)
    score = np.zeros(len(alive))
    for k in range(0, width, STEP):
        d = order[k:k + STEP]
        score += a[k:k + STEP] @ block.at[d[:, None], alive]
        done = min(k + STEP, width)
        mask = keep(score + least[done], score + most[done], alive)
        if not mask.all():
            alive, score = alive[mask], score[mask]
        if not len(alive):
            break
    return alive, score


def _best(ids, scores, k):
    """Places of the first k by score, highest first, ties by smaller id."""
    return np.lexsort((ids, -scores))[:k]


def _whole(score: float) -> int:
    return int(min(max(score, -2.0 ** 62), 2.0 ** 62))


def best_positives(block: Columns, anchor_id, label, anchor, k: int):
    """The first k other rows of the label."""
    def keep(low, high, alive):
        # a row whose upper bound is under the k-th largest lower bound can't be among the first k
        return high >= np.partition(low, len(low) - k)[len(low) - k] if len(low) > k else np.ones(len(low), bool)

    rows, scores = _scan(block, anchor, np.flatnonzero((block.labels == label) & (block.ids != anchor_id)), keep)
    at = _best(block.ids[rows], scores, k)
    return block.ids[rows[at]], scores[at]


def best_negatives(block: Columns, label, anchor, positive_scores, low_pct: int, high_pct: int, k: int):
    """For each positive score the first k rows of other labels whose score lies in
    its window: (index of the positive, ids, scores)."""
    p = np.asarray(positive_scores, np.float64)

    def keep(low, high, alive):
        wanted = np.zeros(len(low), bool)
        for x in p:
            can = (100 * high >= low_pct * x) & (100 * low <= high_pct * x)
            sure = (100 * low >= low_pct * x) & (100 * high <= high_pct * x)
            lows = low[sure]
            if len(lows) > k:  # k rows are in the window with at least this score
                can &= high >= np.partition(lows, len(lows) - k)[len(lows) - k]
            wanted |= can
        return wanted

    rows, scores = _scan(block, anchor, np.flatnonzero(block.labels != label), keep)
    for i, x in enumerate(p):
        inside = np.flatnonzero((100 * scores >= low_pct * x) & (100 * scores <= high_pct * x))
        at = inside[_best(block.ids[rows[inside]], scores[inside], k)]
        yield i, block.ids[rows[at]], scores[at]


def quantized(rows: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """(id, label, v): one row per id, floor(scale * x) of every component.  Rows with
    a null id, label or vector, or a null or non-finite component, take no part; of
    rows with the same id the smallest (label, vector) stands for all."""
    v = F.col("v")
    x = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
                    F.col(vector_col).cast("array<double>").alias("v")).dropna()
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    x = x.filter(~bad).select("id", "label", F.transform(v, lambda c: F.floor(scale * c).cast("double")).alias("v"))
    return x.groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.*")


def _cells(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int):
    """Rows and anchors in blocks, every block of rows with every block of anchors."""
    rb, ab = max(1, -(-n_rows // ROW_BLOCK)), max(1, -(-n_anchors // ANCHOR_BLOCK))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    return (rows.withColumn("rb", block(rb)).withColumn("ab", F.explode(F.sequence(F.lit(0), F.lit(ab - 1)))),
            anchors.withColumn("ab", block(ab)).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(rb - 1)))))


def mine(rows: DataFrame, anchor, positives: int = 5, negatives: int = 10, low_pct: int = 30, high_pct: int = 90,
         scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchor`` is a condition on the column ``id``.  A score is the inner product of
    the floored vectors (exact below 2^53, at most 2^62).  An anchor's positives are its first
    ``positives`` other rows of its label; for each, its first ``negatives`` rows of
    other labels with low_pct * positive <= 100 * negative <= high_pct * positive.
    Higher scores come first, ties by smaller id.  An anchor without positives, a
    positive without negatives and an empty table give no rows.  See ``quantized``
    for nulls and repeated ids; further columns play no part.
    """
    q = staged(quantized(rows, id_col, vector_col, label_col, scale), "vectors")
    anchors = q.filter(anchor)
    dealt, given = _cells(q, anchors, q.count(), anchors.count())

    def first(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:  # no rows or no anchors in this block
            return pd.DataFrame(columns=["anchor_id", "positive_id", "positive_score"])
        block, out = Columns(left["id"], left["label"], left["v"].tolist()), []
        for i, label, v in zip(right["id"], right["label"], right["v"]):
            ids, scores = best_positives(block, i, label, np.asarray(v, np.float64), positives)
            out += [(i, p, s) for p, s in zip(ids, scores)]
        return pd.DataFrame(out, columns=["anchor_id", "positive_id", "positive_score"])

    def windows(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])
        block, out = Columns(left["id"], left["label"], left["v"].tolist()), []
        for i, label, v, found in zip(right["id"], right["label"], right["v"], right["found"]):
            ids, scores = [f["positive_id"] for f in found], [f["positive_score"] for f in found]
            for k, n, s in best_negatives(block, label, np.asarray(v, np.float64), scores, low_pct, high_pct, negatives):
                out += [(i, ids[k], _whole(scores[k]), x, _whole(y)) for x, y in zip(n, s)]
        return pd.DataFrame(out, columns=["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    found = dealt.groupBy("rb", "ab").cogroup(given.groupBy("rb", "ab")).applyInPandas(
        first, "anchor_id long, positive_id long, positive_score double")
    place = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    found = found.withColumn("k", place).filter(F.col("k") <= positives)
    with_found = anchors.join(found.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(
        F.struct("positive_id", "positive_score")).alias("found")), "id")  # at most ``positives`` of them
    dealt, given = _cells(q, staged(with_found, "positives"), q.count(), anchors.count())
    near = dealt.groupBy("rb", "ab").cogroup(given.groupBy("rb", "ab")).applyInPandas(
        windows, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    place = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(
        F.desc("negative_score"), "negative_id"))
    return near.withColumn("rank", place).filter(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negative_mining(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(rows, F.col("id") % 100 == 0)


OP12_SQL = """with q as (
  select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings where vec_id is not null and label is not null and embedding is not null
   and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.id as anchor_id, b.id as other, a.label = b.label as same, list_inner_product(a.v, b.v)::bigint as score
  from q a join q b on a.id % 100 = 0 and a.id <> b.id),
p as (
  select anchor_id, other as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, other) <= 5)
select p.anchor_id, p.positive_id,
       row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.other)::int as rank,
       s.other as negative_id, p.positive_score, s.score as negative_score
from p join s using (anchor_id)
where not s.same and 30 * p.positive_score <= 100 * s.score and 100 * s.score <= 90 * p.positive_score
qualify rank <= 10"""
