"""Toxicity by non-negative positive-unlabelled learning.

A logistic model (numpy) learns from confirmed toxic documents and unlabelled
text.  Its risk is prior * loss(P as toxic) + max(0, loss(U as clean) -
prior * loss(P as clean)): the second part estimates the clean class without
clean labels and is kept from going negative, as it does once the model starts
to remember the unlabelled rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm.common import bounded_sample, id_crc, row_hash, shared

LETTERS = re.compile(r"[^\W\d_]+")
HASHED = 1 << 20
PREFIXES = (4, 5, 6)
#: Bounds of the training sample and of the model.
POSITIVES, UNLABELLED, FEATURES = 2500, 7500, 1024
STEPS = 250
WORDS_CACHED = 400_000


def word_features(word: str) -> tuple[int, ...]:
    """Hashes of a word and of its beginnings, which compounds share."""
    found = [zlib.crc32(word.encode("utf-8", "surrogatepass")) % HASHED]
    found += [zlib.crc32(b"^" + word[:n].encode("utf-8", "surrogatepass")) % HASHED
              for n in PREFIXES if len(word) >= n]
    return tuple(found)


def _collect_features(rows: DataFrame) -> list[np.ndarray]:
    def run(batches):
        for b in batches:
            yield pd.DataFrame({"f": [np.unique(np.array(
                [h for w in set(LETTERS.findall((t or "").lower())) for h in word_features(w)], dtype=np.int32)
            ).tobytes() for t in b["text"]]})
    found = rows.select("text").mapInPandas(run, "f binary").collect()
    return [np.frombuffer(f, np.int32) for f in sorted(r["f"] for r in found)]  # the order of tasks must not matter


def _matrix(docs, columns):
    x = np.zeros((len(docs), len(columns)), np.float32)
    place = np.full(HASHED, -1, np.int32)
    place[columns] = np.arange(len(columns))
    for k, d in enumerate(docs):
        at = place[d]
        x[k, at[at >= 0]] = 1
    return x


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> dict:
    """Weights of the non-negative PU risk by Adam on the whole bounded sample."""
    def share(docs):
        return np.bincount(np.concatenate(docs) if docs else [], minlength=HASHED) / max(1, len(docs))
    p, u = share(positive), share(unlabelled)
    weight = np.abs(p - u) * np.abs(np.log((p + 1e-3) / (u + 1e-3)))
    columns = np.argsort(-weight, kind="stable")[:FEATURES]
    columns = np.sort(columns[weight[columns] > 0])
    xp, xu = _matrix(positive, columns), _matrix(unlabelled, columns)
    w, b = np.zeros(len(columns), np.float32), np.float32(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)

    def sigmoid(z):
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    for step in range(1, STEPS + 1):
        zp, zu = xp @ w + b, xu @ w + b
        sp, su = sigmoid(zp), sigmoid(zu)
        clean = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        dp, du = -prior * sp / len(sp), su / len(su)  # of the estimated clean risk
        if clean >= 0:
            dp = dp + prior * (sp - 1) / len(sp)
        else:  # the correction: climb back until the estimate is a risk again
            dp, du = -dp, -du
        g = np.append(xp.T @ dp.astype(np.float32) + xu.T @ du.astype(np.float32) + 1e-4 * w, dp.sum() + du.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.05 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        w, b = (w - move[:-1]).astype(np.float32), np.float32(b - move[-1])
    return {"weights": dict(zip(columns.tolist(), w.tolist())), "bias": float(b)}


def train(docs: DataFrame, labels: DataFrame) -> dict:
    """Model from documents (doc_id, text) and labels (doc_id, toxic).

    At most POSITIVES toxic documents and UNLABELLED documents are learned from, rows
    that repeat once (``common.bounded_sample``); the class prior is the toxic share of all given labels.  Null texts count as empty, null
    labels are left out.  Without a toxic label the model scores everything 0.
    """
    known = labels.filter("toxic is not null and doc_id is not null")
    r = known.agg(F.avg((F.col("toxic") == 1).cast("double")).alias("p")).first()
    if not r["p"]:
        return {"weights": {}, "bias": -30.0}
    prior = min(max(r["p"], 0.001), 0.9)
    docs = docs.select("doc_id", "text")
    toxic = bounded_sample(known.filter("toxic = 1").select("doc_id"), POSITIVES)
    # at most POSITIVES ids, so they may be broadcast; an id may have many documents
    of_toxic = docs.join(F.broadcast(toxic), "doc_id", "left_semi")
    positive = _collect_features(of_toxic.dropDuplicates().orderBy(row_hash("text", docs.columns)).limit(POSITIVES))
    unlabelled = _collect_features(bounded_sample(docs, UNLABELLED))
    if not positive or not unlabelled:
        return {"weights": {}, "bias": -30.0}
    return fit(positive, unlabelled, prior)


def score(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """``docs`` plus ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on).  Null or
    empty text scores as a text without features.  Columns of these names are
    replaced; all rows and other columns pass through."""
    given = shared(docs.sparkSession, model)

    @F.pandas_udf("double")
    def value(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights, bias = given()["weights"], given()["bias"]
        cache: dict[str, tuple] = {}
        for texts in batches:
            out = []
            for t in texts:
                found = set()
                for w in set(LETTERS.findall(t.lower())) if t else ():
                    f = cache.get(w)
                    if f is None:
                        if len(cache) > WORDS_CACHED:
                            cache.clear()
                        f = cache[w] = tuple(h for h in word_features(w) if h in weights)
                    if f:
                        found.update(f)
                z = bias + sum(sorted(weights[h] for h in found))
                out.append(1 / (1 + np.exp(-min(max(z, -30), 30))))
            yield pd.Series(out, dtype="float64")

    return docs.drop("score", "predicted").withColumn("score", value(F.col(text_col))).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))


def op6_toxicity(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    held_out = id_crc(F.col("doc_id")) % 5 == 0
    model = train(docs.filter(~held_out), labels.filter(~held_out))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
