"""Language ID by word-first backoff.

A text is scored word by word: a known word by its log frequency in every
language; an unseen word by its longest character n-grams that the model knows,
4 down to 1 letters.  The model holds every word and n-gram of the training rows
(a sample of each language) and every language; it is counted by Spark, kept as
sparse arrays and broadcast.  Scoring streams whole texts through Arrow batches,
without shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kiln.llm.common import below_share, id_crc, row_hash, shared

RUNS = re.compile(r"[^\W\d_]+")
MAX_GRAM = 4
#: Training rows of a language; a documented parameter of ``train``.
DOCS_PER_LANG = 4000
#: Training rows whose words and n-grams one task counts.
ROWS_PER_TASK = 1000
#: Words of the per-worker cache of dense vectors, and its largest count of numbers.
CACHE_ROWS, CACHE_NUMBERS = 200_000, 20_000_000
UNKNOWN = "und"


def letters(text: str) -> list[str]:
    """Runs of letters (Unicode category L)."""
    found = RUNS.findall(text)
    if found and not "".join(found).isalpha():  # numerals such as fractions are word characters too
        found = [w for x in found for w in "".join(c if c.isalpha() else " " for c in x).split()]
    return found


def grams(word: str, n: int) -> list[str]:
    w = f"^{word}$" if n > 1 else word
    return [w[i:i + n] for i in range(len(w) - n + 1)]


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial counts of words and of the n-grams of distinct words, by language."""
    for batch in batches:
        seen: dict[str, Counter] = {}
        for lang, text in zip(batch["lang"], batch["text"]):
            seen.setdefault(lang, Counter()).update(letters(text.lower()))
        for lang, c in seen.items():
            g = Counter()
            for w, k in c.items():
                for n in range(1, MAX_GRAM + 1):
                    for x in grams(w, n):
                        g[x] += k
            for kind, table in (("w", c), ("g", g)):
                yield pd.DataFrame({"kind": kind, "lang": lang, "gram": list(table), "n": list(table.values())})


class Table:
    """Counts of words or n-grams as sparse rows of (language, count)."""

    def __init__(self, grams, langs, counts, width: int):
        """``grams``: Arrow column; ``langs``, ``counts``: arrays beside it."""
        coded = grams.dictionary_encode()
        self.rows = {g: i for i, g in enumerate(coded.dictionary.to_pylist())}
        row = coded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(row, kind="stable")
        self.starts = np.zeros(len(self.rows) + 1, np.int64)
        np.cumsum(np.bincount(row, minlength=len(self.rows)), out=self.starts[1:])
        self.langs = langs[order].astype(np.int32)
        # log of the smoothed count over that of a count of 0
        self.gain = np.log1p(2.0 * counts[order]).astype(np.float32)
        total = np.bincount(langs, weights=counts, minlength=width)
        self.base = np.log(0.5 / (total + 0.5 * max(1, len(self.rows)))).astype(np.float32)

    def vectors(self, rows: list[int]) -> np.ndarray:
        """One number per language for each row: how much less likely the language
        makes it than the language that makes it the most likely."""
        rows = np.asarray(rows, np.int64)
        out = np.tile(self.base, (len(rows), 1))
        sizes = self.starts[rows + 1] - self.starts[rows]
        at = np.repeat(np.arange(len(rows)), sizes)
        flat = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + self.starts[rows][at]
        out[at, self.langs[flat]] += self.gain[flat]
        return out - out.max(axis=1, keepdims=True)


class Model:
    """Log-frequency tables of words and n-grams over ``langs``."""

    def __init__(self, langs, words: Table | None = None, grams: Table | None = None):
        self.langs, self.words, self.grams = langs, words, grams

    def backoff(self, unseen: list[str]) -> np.ndarray:
        """One vector a word: the mean over its longest n-grams that the model knows,
        zeros if it knows none."""
        out = np.zeros((len(unseen), len(self.langs)), np.float32)
        get, flat, starts, at = self.grams.rows.get, [], [], []
        for k, word in enumerate(unseen):
            for n in range(MAX_GRAM, 0, -1):
                rows = [r for r in map(get, grams(word, n)) if r is not None]
                if rows:
                    at.append(k)
                    starts.append(len(flat))
                    flat += rows
                    break
        if at:
            sizes = np.diff(starts + [len(flat)])[:, None]
            out[at] = np.add.reduceat(self.grams.vectors(flat), starts, axis=0) / sizes
        return out


class Scorer:
    """Scores texts; the vectors of words are cached up to CACHE_ROWS."""

    def __init__(self, model: Model):
        self.model = model
        self.most = min(CACHE_ROWS, CACHE_NUMBERS // max(1, len(model.langs)))
        self.reset()

    def reset(self):
        self.rows = {}
        self.vectors = np.zeros((4096, len(self.model.langs)), np.float32)

    def learn(self, new: list[str]):
        """Gives every new word a row, of the word if the model knows it or else of
        its n-grams; all of a text at once."""
        lo, hi = len(self.rows), len(self.rows) + len(new)
        self.rows.update(zip(new, range(lo, hi)))
        while hi > len(self.vectors):
            self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
        found = list(map(self.model.words.rows.get, new))
        known = [k for k, r in enumerate(found) if r is not None]
        unseen = [k for k, r in enumerate(found) if r is None]
        out = self.vectors[lo:hi]
        if known:
            out[known] = self.model.words.vectors([found[k] for k in known])
        if unseen:
            out[unseen] = self.model.backoff([new[k] for k in unseen])

    def score(self, text):
        found = letters(text.lower()) if text else []
        if not found or not self.model.langs:
            return UNKNOWN, 0.0
        if len(self.rows) > self.most:
            self.reset()
        ids = list(map(self.rows.get, found))
        if None in ids:
            self.learn(list(dict.fromkeys(w for w, i in zip(found, ids) if i is None)))
            ids = list(map(self.rows.get, found))
        s = self.vectors[ids].sum(axis=0, dtype=np.float64)
        e = np.exp(s - s.max())
        best = int(s.argmax())
        return self.model.langs[best], float(e[best] / e.sum())


def train(labelled: DataFrame, docs_per_lang: int = DOCS_PER_LANG) -> Model:
    """Model from rows (doc_id, text, lang); rows with null text or lang are left out.

    At most ``docs_per_lang`` different rows of each language are read, those of the
    smallest hashes of id and text (rows that repeat count as one); every word and
    n-gram of them and every language is kept.  No rows: a model that answers ``und``
    for everything.
    """
    rows = labelled.select("doc_id", "text", "lang").filter("text is not null and lang is not null")
    rows = rows.withColumn("__h", row_hash("sample", ["doc_id", "text"]))
    # one row a language; the count of different rows is near only, hence half as many again
    per_lang = rows.groupBy("lang").agg((1.5 * docs_per_lang / F.approx_count_distinct("__h")).alias("__share"))
    per_lang = per_lang.toArrow()
    langs = sorted(per_lang["lang"].to_pylist())
    if not langs:
        return Model([])
    some = rows.join(F.broadcast(labelled.sparkSession.createDataFrame(per_lang)), "lang").filter(
        below_share(F.col("__h"), F.col("__share"))).dropDuplicates(["lang", "__h"])
    first = F.row_number().over(Window.partitionBy("lang").orderBy("__h"))
    tasks = max(1, len(langs) * docs_per_lang // ROWS_PER_TASK)  # small ones: their counters stand in Python
    sample = some.withColumn("__n", first).filter(F.col("__n") <= docs_per_lang).repartition(tasks, "__h").select(
        "lang", "text")
    counts = (sample.mapInPandas(_counts, "kind string, lang string, gram string, n long")
              .groupBy("kind", "gram", "lang").agg(F.sum("n").alias("n"))).toArrow()
    number = {x: i for i, x in enumerate(langs)}
    tables = []
    for kind in "wg":
        part = counts.filter(pc.equal(counts["kind"], kind)).combine_chunks()
        coded = pa.chunked_array(part["lang"]).combine_chunks().dictionary_encode()
        names = np.array([number[x] for x in coded.dictionary.to_pylist()], np.int64)
        tables.append(Table(pa.chunked_array(part["gram"]).combine_chunks(),
                            names[coded.indices.to_numpy(zero_copy_only=False)],
                            part["n"].to_numpy(), len(langs)))
    return Model(langs, *tables)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` plus ``lang_pred`` (a learned language, ``und`` for null text or
    text without a letter) and ``score`` (posterior, 0 for ``und``).  Columns of
    these names are replaced; all other columns and all rows pass through."""
    given = shared(docs.sparkSession, model)

    @F.pandas_udf("lang_pred string, score double")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(given())
        for texts in batches:
            yield pd.DataFrame([scorer.score(t) for t in texts], columns=["lang_pred", "score"])

    name = "__lid"
    while name in docs.columns:
        name += "_"
    return (docs.drop("lang_pred", "score").withColumn(name, label(F.col(text_col)))
            .withColumns({c: F.col(name)[c] for c in ("lang_pred", "score")}).drop(name))


def train_rows(docs: DataFrame) -> DataFrame:
    """The rows whose labels may be learned: crc32 of the id, mod 4, is not 2."""
    return docs.filter(id_crc(F.col("doc_id")) % 4 != 2)


def op7_lang_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs.select("doc_id", "text"), train(train_rows(docs))).select(
        "doc_id", (id_crc(F.col("doc_id")) % 4 == 2).alias("held_out"), "lang_pred", "score")
