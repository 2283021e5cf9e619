"""Helpers shared by the operators of this package."""

from __future__ import annotations

import pickle
import re
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kiln.core import ensure_checkpoint_dir

WHITE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)
#: For bytes.translate or str.translate: A-Z only.
LOWER_AZ = {ord(c): ord(c.lower()) for c in UPPER}


def lower_az(c: Column) -> Column:
    """Lower-case A-Z only, whatever the locale; other letters stay as they are."""
    return F.translate(c, UPPER, UPPER.lower())


def words(c: Column) -> Column:
    """Array of the maximal runs without white space (the six ASCII characters)."""
    inner = F.btrim(c, F.lit(WHITE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+"))


def id_crc(c: Column) -> Column:
    """crc32 of the id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


def row_hash(seed: str, columns: list[str]) -> Column:
    """A hash of a row's columns, 0 or more; a null counts as absent."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in columns]), 1)


def below_share(h: Column, share: Column) -> Column:
    """Whether a row of hash ``h`` is among a ``share`` of all rows (all from 1 on)."""
    return (share >= 1) | (h.cast("double") < share * float(1 << 63))


def bounded_sample(rows: DataFrame, at_most: int, seed: str = "sample") -> DataFrame:
    """At most ``at_most`` of the different rows, those of the smallest hashes of all
    columns; rows that repeat count as one, so neither a hot id nor many copies (nor
    null ids) make the sample larger or empty.  The same rows on every layout."""
    h = row_hash(seed, rows.columns)
    different = rows.agg(F.approx_count_distinct(h)).first()[0]
    share = F.lit(2.0 * at_most / max(1, different))   # twice, as the count is near only
    return (rows.withColumn("__h", h).filter(below_share(F.col("__h"), share)).dropDuplicates(["__h"])
            .orderBy("__h").limit(at_most).drop("__h").repartition(max(1, at_most // 1000)))


#: Lets Spark delete the shuffle files of a query when it ends, not when the driver next collects its garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write an intermediate as a table in the shared folder of the cluster
    (``spark.checkpoint.dir``) and read it back: the lineage is cut and lost
    executors cost nothing that has been written.  The shuffle files of the write go
    with its end, as nothing reads them any more."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLES_GO, "false")
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(SHUFFLES_GO, before)
    return spark.read.schema(df.schema).parquet(path)


def unstaged(df: DataFrame) -> None:
    """Delete a table that ``staged`` wrote and that nothing reads any more."""
    for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def shared(spark: SparkSession, model):
    """Broadcast a model of bounded size; the result, called in a task, gives it.
    It travels by value, so that workers need not import this package."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(model))
    return lambda: pickle.loads(sent.value)
