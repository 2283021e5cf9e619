"""Quality classifier by co-training.

Two logistic models (numpy) see different views of a document: its text content
(measures of the whole text, and hashed words and pairs of neighbouring words) and its metadata (source, language, length).  Each round, each names the
unlabelled documents it is most sure of, and the other learns from them.  In the
end both are calibrated on labelled rows and combined; every document is scored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm.common import WORD_RE, bounded_sample, id_crc, row_hash, shared

#: Bounds of the training sample; rounds, and pseudo-labels a round and class.
LABELLED, UNLABELLED, ROUNDS, PER_ROUND, SURE = 6000, 6000, 4, 200, 0.97
SOURCE_BUCKETS, LANG_BUCKETS = 32, 16
#: Hash buckets of words and of pairs of neighbouring words; hashes of words kept in a task.
WORD_BUCKETS, PAIR_BUCKETS, WORDS_CACHED = 256, 256, 400_000
MEASURES = 10
SYMBOLS = re.compile(r"[#*$%&|<>@^~{}\[\]\\_=+]")
SENTENCE = re.compile(r"[.?:;,]")


def text_view(text: str | None) -> list[float]:
    """Content measures of a whole text; all 0 for null or blank text."""
    w = WORD_RE.findall(text) if text else []
    n = len(w)
    if not n:
        return [0.0] * MEASURES
    distinct = len(set(w))
    return [np.log1p(n), distinct / n, np.log(distinct) / np.log1p(n), len(SYMBOLS.findall(text)) / n,
            text.count("!") / n, sum(map(str.isupper, w)) / n, len(text) / n,
            sum(map(eq, w, w[1:])) / n, len(SENTENCE.findall(text)) / n, text.count("\n") / n]


class WordView:
    """Shares of a text's lower-case words and of its pairs of neighbouring words by hash
    bucket, as square roots (so that frequent words do not drown the others); zeros for
    null or blank text.  Hashes of words are kept up to WORDS_CACHED."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def hash(self, word: str) -> int:
        h = self.known.get(word)
        if h is None:
            if len(self.known) >= WORDS_CACHED:
                self.known.clear()
            h = self.known[word] = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        return h

    def __call__(self, text: str | None) -> np.ndarray:
        found = WORD_RE.findall(text.lower()) if text else []
        if not found:
            return np.zeros(WORD_BUCKETS + PAIR_BUCKETS)
        h = np.array(list(map(self.hash, found)), np.uint64)
        pair = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(32)
        w = np.bincount((h % np.uint64(WORD_BUCKETS)).astype(np.int64), minlength=WORD_BUCKETS)
        p = np.bincount((pair % np.uint64(PAIR_BUCKETS)).astype(np.int64), minlength=PAIR_BUCKETS)
        return np.sqrt(np.concatenate([w / len(h), p / max(1, len(pair))]))


def content(texts, words: WordView) -> np.ndarray:
    """The text view of many texts: one row each."""
    out = np.zeros((len(texts), MEASURES + WORD_BUCKETS + PAIR_BUCKETS))
    for k, t in enumerate(texts):
        out[k, :MEASURES] = text_view(t)
        out[k, MEASURES:] = words(t)
    return out


def meta_view(source: str | None, lang: str | None, n_chars) -> list[float]:
    """Metadata measures; null source, language and length have places of their own."""
    x = [0.0] * (SOURCE_BUCKETS + LANG_BUCKETS + 3)
    x[zlib.crc32(str(source).encode("utf-8", "surrogatepass")) % SOURCE_BUCKETS] = 1.0
    x[SOURCE_BUCKETS + zlib.crc32(str(lang).encode("utf-8", "surrogatepass")) % LANG_BUCKETS] = 1.0
    if n_chars is None or pd.isna(n_chars):
        x[-1] = 1.0
    else:
        x[-2] = np.log1p(max(0.0, float(n_chars)))
        x[-3] = x[-2] ** 2 / 10
    return x


class Logistic:
    def __init__(self, x, y, weight=None, l2=1e-3, steps=200):
        self.mean, self.std = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = self.design(x)
        weight = np.ones(len(y)) if weight is None else weight
        weight = weight / weight.sum()
        self.w = np.zeros(z.shape[1])
        for _ in range(steps // 10):  # Newton steps with a ridge
            p = self.sigmoid(z @ self.w)
            g = z.T @ (weight * (p - y)) + l2 * self.w
            h = (z * (weight * p * (1 - p))[:, None]).T @ z + l2 * np.eye(z.shape[1])
            step = np.linalg.solve(h, g)
            self.w -= step
            if np.abs(step).max() < 1e-8:
                break

    @staticmethod
    def sigmoid(z):
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def design(self, x):
        z = np.clip((x - self.mean) / self.std, -8, 8)
        return np.hstack([z, np.ones((len(z), 1))])

    def logit(self, x):
        return np.clip(self.design(x) @ self.w, -15, 15)


def _views(rows: DataFrame, extra: str) -> DataFrame:
    """Both views of every row as arrays, beside ``extra`` (a long)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordView()
        for b in batches:
            yield pd.DataFrame({
                extra: b[extra], "t": [x.astype(np.float32).tobytes() for x in content(b["text"], words)],
                "m": [meta_view(*x) for x in zip(b["source"], b["lang"], b["n_chars"])]})
    return rows.select(extra, "text", "source", "lang", "n_chars").mapInPandas(
        run, f"{extra} long, t binary, m array<double>")


def fit(labelled, unlabelled) -> dict:
    """``labelled``: (t, m, y); ``unlabelled``: (t, m).  Returns both models and the
    weights that combine their calibrated logits."""
    t, m, y = labelled
    ut, um = unlabelled
    own = np.ones(len(y))
    sets = {"t": (t, y, own), "m": (m, y, own)}
    free = np.ones(len(ut), bool)
    models = {}
    for _ in range(ROUNDS + 1):
        models = {v: Logistic(*sets[v]) for v in sets}
        if not free.any():
            break
        for v, other, x, ox in (("t", "m", ut, um), ("m", "t", um, ut)):
            p = Logistic.sigmoid(models[v].logit(x))
            for label, sure in ((1.0, p), (0.0, 1 - p)):
                best = np.argsort(-np.where(free, sure, -1), kind="stable")[:PER_ROUND]
                best = best[(sure[best] >= SURE) & free[best]]
                if len(best):
                    a, b, c = sets[other]
                    sets[other] = (np.vstack([a, ox[best]]), np.append(b, np.full(len(best), label)),
                                   np.append(c, np.full(len(best), 0.5)))
                    free[best] = False
    z = np.column_stack([models["t"].logit(t), models["m"].logit(m)])
    return {"t": models["t"], "m": models["m"], "both": Logistic(z, y)}


def train(docs: DataFrame, labels: DataFrame) -> dict | None:
    """Models from documents and labels (doc_id, quality); at most LABELLED labelled and
    UNLABELLED other documents, rows that repeat once (``common.bounded_sample``).  Null
    ids and labels teach nothing; None if the labels hold fewer than two classes."""
    docs = docs.select("doc_id", "text", "source", "lang", "n_chars")
    known = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(
        F.max("quality").cast("long").alias("quality"))
    # at most LABELLED ids, so they may be broadcast; an id may have many documents
    some = docs.join(F.broadcast(bounded_sample(known, LABELLED)), "doc_id")
    some = some.dropDuplicates().orderBy(row_hash("text", some.columns)).limit(LABELLED)
    rows = _views(some, "quality").collect()
    if len({r["quality"] for r in rows}) < 2:
        return None
    other = bounded_sample(docs.withColumn("doc_id", F.col("doc_id").cast("long")), UNLABELLED, "other")
    free = _views(other, "doc_id").collect()
    order = sorted(rows, key=lambda r: (r["t"], r["m"], r["quality"]))  # the order of tasks must not matter
    free = sorted(free, key=lambda r: (r["t"], r["m"]))

    def text(rs):
        return np.frombuffer(b"".join(r["t"] for r in rs), np.float32).reshape(len(rs), -1).astype(float)

    def meta(rs):
        return np.array([r["m"] for r in rs], dtype=float)

    if not free:
        free = order[:1]    # nothing but labelled rows: one of them again changes nothing of weight
    return fit((text(order), meta(order), np.array([float(r["quality"] == 1) for r in order])), (text(free), meta(free)))


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """(doc_id, p_text, p_meta, score, predicted) of every row; ``predicted`` is 1
    from a score of 0.5 on.  Without a model every score is 0.5.  Null columns have
    values of their own; repeated rows are scored each."""
    given = shared(docs.sparkSession, model)

    @F.pandas_udf("p_text double, p_meta double, score double")
    def value(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        model, words = given(), WordView()
        for text, source, lang, n_chars in batches:
            if model is None or not len(text):
                yield pd.DataFrame({c: np.full(len(text), 0.5) for c in ("p_text", "p_meta", "score")})
                continue
            t = model["t"].logit(content(text, words))
            m = model["m"].logit(np.array([meta_view(*x) for x in zip(source, lang, n_chars)]))
            both = model["both"].logit(np.column_stack([t, m]))
            s = Logistic.sigmoid
            yield pd.DataFrame({"p_text": s(t), "p_meta": s(m), "score": s(both)})

    return docs.withColumn("__q", value("text", "source", "lang", "n_chars")).select(
        "doc_id", "__q.p_text", "__q.p_meta", "__q.score").withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))


def op9_quality_classifier(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang", "n_chars")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    held_out = id_crc(F.col("doc_id")) % 5 == 0
    model = train(docs.filter(~held_out), labels.filter(~held_out))
    out = score(docs, model)
    return out.select("doc_id", (id_crc(F.col("doc_id")) % 5 == 0).alias("held_out"),
                      "p_text", "p_meta", "score", "predicted")
