"""Session setup and small column/schema helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (
    T.ByteType, T.ShortType, T.IntegerType, T.LongType,
    T.FloatType, T.DoubleType, T.DecimalType,
)
DATETIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)


PARTITION_MB = 128
#: Tables of one row per group are broadcast up to this many groups.
BROADCAST_GROUPS = 10_000


def shuffle_partitions_for(input_bytes: int, partition_mb: int = PARTITION_MB) -> int:
    """Upper bound for ``spark.sql.shuffle.partitions`` at a given input size.

    AQE coalesces small shuffle partitions down to the advisory size, so the
    setting should be the count needed for the largest stage (input bytes /
    partition size): 100 TB at 128 MiB is about 745k partitions; use a value of
    that order on such a cluster, not the default 200.
    """
    return max(1, -(-int(input_bytes) // (partition_mb << 20)))


def get_session(master: str | None = None, app_name: str = "kiln",
                shuffle_partitions: int | None = None, **conf) -> SparkSession:
    """Build (or reuse) a session with the settings the operators assume.

    UTC session time zone (pandas-like naive timestamps), AQE with partition
    coalescing to ~128 MB and skew-join splitting, scan splits of 128 MB.
    The checkpoint directory is taken from ``spark.checkpoint.dir`` when the
    cluster sets it; only a local master gets a temporary one.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": f"{PARTITION_MB}m",
        "spark.sql.files.maxPartitionBytes": f"{PARTITION_MB}m",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update({k.replace("__", "."): str(v) for k, v in conf.items()})
    for k, v in settings.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory, setting it from the session conf.

    A machine-local temporary folder is used only for a local master (tests).
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; set it to a shared folder of the cluster")
    path = tempfile.mkdtemp(prefix="kiln-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, NUMERIC_TYPES)


def is_datetime(dt: T.DataType) -> bool:
    return isinstance(dt, DATETIME_TYPES)


def is_stringlike(dt: T.DataType) -> bool:
    return isinstance(dt, (T.StringType, T.BooleanType))


def numeric_columns(df: DataFrame, columns: Iterable[str] | None = None,
                    max_columns: int | None = None) -> list[str]:
    """Numeric columns (bool excluded), optionally the requested ones only, capped."""
    num = [f.name for f in df.schema.fields if is_numeric(f.dataType)]
    if columns:
        num = [c for c in columns if c in num]
    return num[:max_columns] if max_columns else num


def string_columns(df: DataFrame) -> list[str]:
    """Object/category/bool columns in pandas terms: strings and booleans."""
    return [f.name for f in df.schema.fields if is_stringlike(f.dataType)]


def datetime_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_datetime(f.dataType)]


def nan_to_null(df: DataFrame) -> DataFrame:
    """Normalise float NaN to NULL so that only NULL logic is needed afterwards."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            cols.append(F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def q(name: str) -> str:
    """Backtick-quote a column name for SQL expressions."""
    return "`" + name.replace("`", "``") + "`"


def col_list(cols: str | Sequence[str] | None) -> list[str]:
    if cols is None:
        return []
    if isinstance(cols, str):
        return [cols]
    return list(cols)


def null_safe_on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Join condition with NULL-safe equality on every key (NULL keys form a group)."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond


def join_small(big: DataFrame, small: DataFrame, keys: Sequence[str],
               broadcast_small: bool = False, how: str = "inner") -> DataFrame:
    """Join a per-key statistics table back onto the data.

    With no keys the small side is one row per chart and is always broadcast
    (its size is fixed).  With keys the small side has one row per key; it is
    broadcast only when the caller knows its size bound, else AQE decides at
    runtime from the measured size.
    """
    keys = list(keys)
    if not keys:
        return big.crossJoin(F.broadcast(small))
    s = small
    for k in keys:
        s = s.withColumnRenamed(k, f"__r_{k}")
    if broadcast_small:
        s = F.broadcast(s)
    cond = F.lit(True)
    for k in keys:
        cond = cond & big[k].eqNullSafe(s[f"__r_{k}"])
    out = big.join(s, cond, how)
    return out.drop(*[f"__r_{k}" for k in keys])


def materialize(df: DataFrame) -> DataFrame:
    """Write a reused intermediate to the reliable checkpoint folder and read it back.

    Used for small derived tables (e.g. one row per subgroup) that several
    branches of a plan read: each branch then scans the written table instead of
    recomputing the aggregation from the source, and the lineage is cut.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a reused table as Parquet to the reliable checkpoint folder and read it back.

    As ``materialize``, for tables that many passes read: a pass reads the columns it
    needs only, and skips row groups by their statistics.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/kiln-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few_rows(df: DataFrame) -> bool:
    """Whether a (written) table of one row per group is small enough to broadcast."""
    return df.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS


def epoch_micros(c: Column, dt: T.DataType) -> Column:
    """Microseconds since 1970-01-01 00:00, independent of the session time zone
    for wall-clock (NTZ) values; the instant for zoned timestamps."""
    if isinstance(dt, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c)
    if isinstance(dt, T.DateType):
        return F.unix_date(c).cast("long") * 86_400_000_000
    return F.unix_micros(c)
