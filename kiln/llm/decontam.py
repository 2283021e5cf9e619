"""Benchmark decontamination by SimHash windows, DataFrame operations only.

Texts become sequences of hashed five-word shingles.  A window is as long as a
benchmark item; since a window over the similarity threshold shares at least one
shingle with the item, only windows that such a shared shingle aligns with an
item are formed (a bitmap of the item shingles, then an exact join, finds them).
Windows and items get 64-bit SimHash fingerprints; a multi-index over as many
blocks as the radius plus one guarantees every pair within the Hamming radius;
exact weighted-shingle (multiset) similarity verifies the pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiln.llm.common import staged

#: A fingerprint of 64 bits differs in about 9 bits at a Jaccard similarity of 0.8,
#: in more than 22 for 4 of 100,000 pairs at most (simulated, 9 to 180 shingles).
RADIUS = 22
BITS = 64
#: Bits of the sieve for each item shingle, and its largest size (2 MiB); a fuller
#: sieve lets more through and the exact join does the rest.
SIEVE_BITS, SIEVE_MAX = 32, 1 << 24
#: Item shingles up to this count may be broadcast (24 bytes each); more are shuffled.
BROADCAST_SHINGLES = 1_000_000


def _shingles(docs: DataFrame, text: Column, k: int) -> DataFrame:
    """``docs`` plus ``__sh``: hashes of the k-word shingles (words are runs of
    letters and digits, lower-cased); fewer words than k: none."""
    split = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    w = docs.withColumn("__w", F.filter(split, lambda x: x != ""))
    last = F.size("__w") - k
    return w.withColumn("__sh", F.when(last >= 0, F.transform(
        F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
        lambda i: F.xxhash64(*[F.get("__w", i + j) for j in range(k)])))).drop("__w")


def _simhash(rows: DataFrame, keys: list[str], shingles: str) -> DataFrame:
    """``rows`` (one per key) plus ``fp``: bit b is set where most of the window's
    shingles, with their repeats as weights, have it set."""
    one = rows.select(*keys, F.explode(shingles).alias("h"))
    sums = one.groupBy(*keys).agg(F.count("*").alias("n"), *[
        F.sum(F.shiftrightunsigned("h", b).bitwiseAND(F.lit(1).cast("long"))).alias(f"b{b}") for b in range(BITS)])
    fp = F.lit(0).cast("long")
    for b in range(BITS):
        bit = -(1 << 63) if b == 63 else 1 << b
        fp = fp.bitwiseOR(F.when(2 * F.col(f"b{b}") > F.col("n"), F.lit(bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return sums.select(*keys, fp.alias("fp"))


def _blocks(fp: str, radius: int) -> Column:
    """The fingerprint in radius + 1 pieces: two fingerprints that differ in at
    most ``radius`` bits agree in at least one."""
    cuts = [BITS * i // (radius + 1) for i in range(radius + 2)]
    return F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fp, lo).bitwiseAND(
        F.lit((1 << (hi - lo)) - 1).cast("long")).alias("value")) for i, (lo, hi) in enumerate(zip(cuts, cuts[1:]))])


def _weighted_jaccard(a: str, b: str) -> Column:
    """Sum of the smaller over the sum of the larger counts of two shingle bags."""
    both = F.aggregate(F.array_distinct(F.array_intersect(a, b)), F.lit(0), lambda s, h: s + F.least(
        F.size(F.filter(a, lambda x: x == h)), F.size(F.filter(b, lambda x: x == h))))
    return both / (F.size(a) + F.size(b) - both)


def _sieve(items: DataFrame, n_shingles: int) -> Column:
    """Condition on a shingle hash: its bit is set in the bitmap of the item shingles.
    Every item shingle sets its bit, so no shared shingle is ever held back."""
    bits = 1 << max(10, (max(1, min(n_shingles * SIEVE_BITS, SIEVE_MAX)) - 1).bit_length())
    at = F.col("h").bitwiseAND(F.lit(bits - 1).cast("long"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(F.lit(63).cast("long")).cast("int"))
    cells = [0] * (bits // 64)
    for cell, value in (items.select(F.explode("__sh").alias("h")).groupBy(F.shiftright(at, 6).cast("int").alias("cell"))
                        .agg(F.bit_or(one).alias("value")).collect()):  # at most SIEVE_MAX / 64 rows
        cells[cell] = value
    bitmap = F.split(F.lit(",".join(map(str, cells))), ",").cast("array<bigint>")  # folded to a constant
    return lambda h: F.get(bitmap, F.shiftright(h.bitwiseAND(F.lit(bits - 1).cast("long")), 6).cast("int")).bitwiseAND(
        F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63).cast("long")).cast("int"))) != 0


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, k: int = 5, radius: int = RADIUS,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, similarity, distance, start, length): for every document
    and benchmark item that it holds, the best window (by similarity, then the
    first).  ``start``/``length`` count words.

    Items and documents with null or empty text or fewer than ``k`` words match
    nothing; repeated items (or ids) are reported by their own ids; rows that share
    a doc_id are searched each by itself and reported once.
    """
    items = staged(_shingles(benchmark.select("item_id", F.col("text").alias("__t")), F.col("__t"), k)
                   .select("item_id", "__sh"), "items").filter("__sh is not null")
    n_shingles = items.agg(F.sum(F.size("__sh"))).first()[0] or 0
    small = F.broadcast if n_shingles <= BROADCAST_SHINGLES else (lambda d: d)
    may = _sieve(items, n_shingles)
    marks = items.select(F.size("__sh").alias("m"), F.posexplode("__sh").alias("offset", "h")).distinct()
    base = _shingles(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__t")), F.col("__t"), k)
    hits = F.filter(F.transform("__sh", lambda h, i: F.struct(h.alias("h"), i.alias("i"))), lambda x: may(x["h"]))
    # outer, as a condition on the arrays would be pushed down and compute them again
    aligned = (base.select("doc_id", "__sh", F.explode_outer(hits).alias("x")).filter("x is not null")
               .select("doc_id", "__sh", F.col("x.h").alias("h"), F.col("x.i").alias("i"))
               .join(small(marks), "h")
               .withColumn("start", F.greatest(F.col("i") - F.col("offset"), F.lit(0)))
               .select("doc_id", "start", "m", F.slice("__sh", F.col("start") + 1, F.col("m")).alias("bag")))
    windows = staged(aligned.distinct(), "windows")
    keyed = windows.withColumn("bag_no", F.xxhash64("bag"))  # rows of one id with different texts
    keys = ["doc_id", "start", "m", "bag_no"]
    own = _simhash(keyed, keys, "bag").withColumn("x", F.explode(_blocks("fp", radius)))
    theirs = _simhash(items.withColumn("m", F.size("__sh")), ["item_id", "m"], "__sh").withColumn(
        "x", F.explode(_blocks("fp", radius))).withColumnRenamed("fp", "item_fp")
    pairs = (own.select(*keys, "fp", "x.block", "x.value")
             .join(small(theirs.select("item_id", "m", "item_fp", "x.block", "x.value")), ["m", "block", "value"])
             .withColumn("distance", F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))))
             .filter(F.col("distance") <= radius).select(*keys, "item_id", "distance").distinct())
    checked = (pairs.join(keyed, keys).join(small(items), "item_id")
               .withColumn("similarity", _weighted_jaccard("bag", "__sh")).filter(F.col("similarity") >= similarity))
    best = F.max_by(F.struct("similarity", "distance", "start", (F.col("m") + k - 1).alias("length")),
                    F.struct("similarity", -F.col("start")))
    return checked.groupBy("doc_id", "item_id").agg(best.alias("x")).select("doc_id", "item_id", "x.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; all columns pass
    through.  Rows with a null id hold no reported item and stay."""
    held = contaminated(docs, benchmark, **options).select(F.col("doc_id").alias("__held")).distinct()
    return docs.join(held.hint("shuffle_hash"), F.col("doc_id") == F.col("__held"), "left_anti")


def op3_benchmark_decontamination(spark, sf_dir):
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"),
                        spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
