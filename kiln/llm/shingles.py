"""Sets of word n-grams and the classes of documents with equal sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm.common import staged

WORDS_CACHED = 300_000
SALTS = 8
#: Classes without any document id are numbered below this; ids are above it.
NO_ID = -(1 << 62)


class WordHashes(dict):
    """64-bit hash of a word (bytes), cached."""

    def __missing__(self, word: bytes) -> int:
        import xxhash
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


class Shingler:
    """Distinct 64-bit hashes of the word n-grams of a text, sorted."""

    def __init__(self, n: int):
        self.n = n
        self.hashes = WordHashes()

    def __call__(self, text: str | None) -> np.ndarray:
        # as bytes, lower() and split() know A-Z and the six ASCII white space characters only
        found = text.encode("utf-8", "surrogatepass").lower().split() if isinstance(text, str) else []
        if not found:
            return np.empty(0, np.int64)
        if len(self.hashes) > WORDS_CACHED:
            self.hashes.clear()
        h = np.fromiter(map(self.hashes.__getitem__, found), np.uint64, len(found))
        n = min(self.n, len(h))
        out = np.zeros(len(h) - n + 1, np.uint64)
        for k in range(n):  # position matters: the running value is mixed before each next word
            out = (out ^ h[k:len(h) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        if n < self.n:
            out ^= np.uint64(n)
        return np.unique(out.view(np.int64))


def digest(shingles: np.ndarray) -> bytes:
    import xxhash
    return xxhash.xxh128_digest(shingles.tobytes())


def prefix_length(n: int, percent: int) -> int:
    """How many first elements of a set of n must be looked at: n - ceil(t n) + 1."""
    return n - (n * percent + 99) // 100 + 1


def described(docs: DataFrame, n: int, more: str, describe, most: int = 200) -> DataFrame:
    """(doc_id, n_shingles, sig, ...) of every row: ``sig`` is a 128-bit digest of the
    set, ``more`` (a schema) names what ``describe(sets)`` gives for up to ``most``
    sets at a time (a list of columns)."""
    names = [c.strip().split(" ")[0] for c in more.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle = Shingler(n)
        for b in batches:
            for lo in range(0, len(b), most):
                part = b.iloc[lo:lo + most]
                sets = [shingle(t) for t in part["text"]]
                out = pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "n_shingles": [len(s) for s in sets],
                                    "sig": [digest(s) for s in sets]})
                for name, column in zip(names, describe(sets)):
                    out[name] = column
                yield out
    # ids as text: pandas has no exact long beside nulls
    return docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(
        run, f"doc_id string, n_shingles long, sig binary, {more}").withColumn("doc_id", F.col("doc_id").cast("long"))


def classes(rows: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, sig, rep) from ``described`` rows: one row per id, and one
    for each row without id.  ``rep`` names the class of equal sets: its smallest id,
    or a number below NO_ID where no member has an id; null without shingles.

    Rows that share an id are one document: of different texts the one with the most
    shingles counts, ties by digest.  The members of a class meet its name in SALTS
    ways.
    """
    named = rows.filter("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.struct("n_shingles", "sig")).alias("x")).select("doc_id", "x.*")
    one = named.unionByName(rows.filter("doc_id is null").select("doc_id", "n_shingles", "sig"))
    one = one.withColumn("salt", F.when(F.col("doc_id").isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
                         .otherwise(F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).cast("int"))
    no_id = F.lit(NO_ID) - 1 - F.shiftrightunsigned(F.xxhash64("sig"), 3)
    rep = one.filter("n_shingles > 0").groupBy("sig").agg(F.coalesce(F.min("doc_id"), no_id).alias("rep"))
    return one.join(rep.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["sig", "salt"],
                    "left").select("doc_id", "n_shingles", "sig", "rep")


def named_components(members: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) from ``classes`` rows and (node, component) of
    the linked classes: the smallest id of the component, null if none has an id."""
    joined = members.join(found, F.col("rep") == F.col("node"), "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component"))
    # a component is named by its smallest class, which may have no id: then by the smallest that has one
    real = found.filter((F.col("component") < NO_ID) & (F.col("node") >= NO_ID)).groupBy("component").agg(
        F.min("node").alias("real"))
    return joined.join(real, "component", "left").select("doc_id", "n_shingles", F.coalesce(
        "real", F.when(F.col("component") >= NO_ID, F.col("component"))).alias("component_id"))


def nodes(members: DataFrame) -> DataFrame:
    """(node, sig, n) of every class of ``classes`` rows that has shingles."""
    return members.filter("rep is not null").select(
        F.col("rep").alias("node"), "sig", F.col("n_shingles").alias("n")).distinct()


def set_rows(docs: DataFrame, wanted: DataFrame, n: int, repeats: bool) -> DataFrame:
    """(node, s), written: the set (bytes of sorted 64-bit numbers) of each class in
    ``wanted`` (node, sig), made again from a text of its smallest id, or from any
    text where no member has an id.  ``repeats``: ids may come more than once."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle = Shingler(n)
        for b in batches:
            sets = [shingle(t) for t in b["text"]]
            sigs = [digest(s) for s in sets]
            own = [w is None or s == w for s, w in zip(sigs, b["sig"])]
            yield pd.DataFrame({"node": b["node"], "sig": sigs, "s": [s.tobytes() for s in sets]})[own]

    made = "node long, sig binary, s binary"
    named = docs.join(wanted.filter(F.col("node") >= NO_ID).withColumnRenamed("node", "doc_id").hint("shuffle_hash"),
                      "doc_id").select(F.col("doc_id").alias("node"), "text", "sig")
    out = (named.distinct() if repeats else named).mapInPandas(run, made).select("node", "s")
    nameless = wanted.filter(F.col("node") < NO_ID)
    any_nameless = bool(nameless.limit(1).count())
    if any_nameless:
        texts = docs.filter("doc_id is null").select(F.lit(0).cast("long").alias("node"), "text",
                                                     F.lit(None).cast("binary").alias("sig")).distinct()
        out = out.unionByName(texts.mapInPandas(run, made).drop("node").join(nameless, "sig").select("node", "s"))
    if repeats or any_nameless:  # texts that differ in case have one set
        out = out.dropDuplicates(["node"])
    return staged(out, "sets")
