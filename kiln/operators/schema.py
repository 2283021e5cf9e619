"""Schema inference (B1), datetime sniffing (B2) and datetime casting.

All per-column facts come from one dictionary of the table: a row per column and
distinct value with its count, combined map-side.  Non-null and distinct counts are
counts over it, and a string value is parsed under the candidate datetime formats
once, however often it occurs.  The result is a small frame with one row per column
(bounded by the column count, so it may be collected as metadata).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kiln.core import epoch_micros, is_datetime, is_numeric

# The candidate formats tried in this order (strptime spelling,
# then the Java pattern used here; single letters accept unpadded fields).
DATETIME_FORMATS = [
    ("%Y-%m-%d", "yyyy-M-d"),
    ("%d/%m/%Y", "d/M/yyyy"),
    ("%m/%d/%Y", "M/d/yyyy"),
    ("%Y-%m-%d %H:%M:%S", "yyyy-M-d H:m:s"),
    ("%d-%m-%Y", "d-M-yyyy"),
    ("%Y%m%d", "yyyyMMdd"),
]
# Cheap shape checks run before a parse (a failed parse is expensive): a value
# that does not have the shape of a format cannot parse under it.
FORMAT_SHAPES = {
    "yyyy-M-d": r"^\d{4}-\d{1,2}-\d{1,2}$",
    "d/M/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$",
    "M/d/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$",
    "yyyy-M-d H:m:s": r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$",
    "d-M-yyyy": r"^\d{1,2}-\d{1,2}-\d{4}$",
    "yyyyMMdd": r"^\d{8}$",
}
# a timestamp cast is tried on dates with separators only: bare digits (codes,
# years, phone numbers) and times without a date are no datetimes
CAST_SHAPE = r"^\s*\d{4}-\d{1,2}(-\d{1,2}([ T].*)?)?\s*$"
FALLBACK_PARSE_RATE = 0.8
CATEGORICAL_RATIO = 0.05
CATEGORICAL_MAX_UNIQUE = 20


def parse_with(c, pattern: str):
    """``try_to_timestamp`` guarded by the format's shape."""
    return F.when(c.rlike(FORMAT_SHAPES[pattern]), F.try_to_timestamp(c, F.lit(pattern)))


def free_parse(name: str):
    """Format-free parse: a timestamp cast, else any of the known formats."""
    c = F.col(f"`{name}`")
    cast = F.when(c.rlike(CAST_SHAPE), F.expr(f"try_cast(`{name}` as timestamp)"))
    return F.coalesce(cast, *[parse_with(c, p) for _, p in DATETIME_FORMATS])


def _dictionary_key(f: T.StructField):
    """(name, column): the value as a long, a double or a string, equal for equal values only.

    -0.0 counts as 0.0.  Instants become microseconds (a local time may occur twice);
    arrays and structs become JSON with every field and full precision.
    """
    c = F.col(f"`{f.name}`")
    if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
        return "__d", c.cast("double") + F.lit(0.0)
    if isinstance(f.dataType, (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "__l", c.cast("long")
    if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "__l", epoch_micros(c, f.dataType)
    if isinstance(f.dataType, T.BinaryType):
        return "__s", F.hex(c)
    if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
        json = F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false",
                                                  "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
                                                  "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"})
        return "__s", F.when(c.isNotNull(), json)
    return "__s", c.cast("string")


def value_dictionary(df: DataFrame) -> DataFrame:
    """``__pos, __l, __d, __s, __n``: the distinct values of every column, by its position, and their counts.

    One of the three value columns holds the value; all are NULL in the row that counts the NULLs.
    """
    kinds = {"__l": "long", "__d": "double", "__s": "string"}
    recs = []
    for i, f in enumerate(df.schema.fields):
        name, key = _dictionary_key(f)
        recs.append(F.struct(F.lit(i).alias("__pos"), *[
            (key if k == name else F.lit(None)).cast(t).alias(k) for k, t in kinds.items()]))
    return (df.select(F.explode(F.array(*recs)).alias("__c")).select("__c.*")
            .groupBy("__pos", *kinds).agg(F.count(F.lit(1)).alias("__n")))


def _parse_counts(is_string, weight) -> list:
    """Sums of ``weight`` over the string values of a dictionary that parse, by format and format-free."""
    c = F.when(is_string, F.col("__s"))
    out = [F.sum(F.when(parse_with(c, pat).isNotNull(), weight)).alias(f"fmt{j}")
           for j, (_, pat) in enumerate(DATETIME_FORMATS)]
    return out + [F.sum(F.when(F.when(is_string, free_parse("__s")).isNotNull(), weight)).alias("free")]


def _facts(df: DataFrame) -> DataFrame:
    """One row: ``__rows`` and, by column position, non-null, distinct and parse counts."""
    fields = df.schema.fields
    strings = [i for i, f in enumerate(fields) if isinstance(f.dataType, T.StringType)]
    given = F.coalesce(F.col("__l").isNotNull() | F.col("__d").isNotNull() | F.col("__s").isNotNull(), F.lit(False))
    n = F.col("__n")
    facts = ["rows", "nn", "nu", *[f"fmt{j}" for j in range(len(DATETIME_FORMATS))], "free"]
    by_col = value_dictionary(df).groupBy("__pos").agg(
        F.sum(n).alias("rows"), F.sum(F.when(given, n)).alias("nn"), F.count_if(given).alias("nu"),
        *_parse_counts(F.col("__pos").isin(strings), n))
    out = [F.coalesce(F.max("rows"), F.lit(0)).alias("__rows")]
    for i in range(len(fields)):
        for k in facts[1:]:
            name = f"fmt{i}_{k[3:]}" if k.startswith("fmt") else f"{k}{i}"
            out.append(F.coalesce(F.max(F.when(F.col("__pos") == i, F.col(k))), F.lit(0)).alias(name))
    return by_col.agg(*out)


def _facts_approx(df: DataFrame) -> DataFrame:
    """The same row from one scan without a shuffle of values; distinct counts are estimates."""
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        aggs += [F.count(c).alias(f"nn{i}"), F.approx_count_distinct(c).alias(f"nu{i}")]
        if isinstance(f.dataType, T.StringType):
            aggs += [F.count(parse_with(c, pat)).alias(f"fmt{i}_{j}") for j, (_, pat) in enumerate(DATETIME_FORMATS)]
            aggs.append(F.count(free_parse(f.name)).alias(f"free{i}"))
    return df.agg(*aggs)


def detect_schema(df: DataFrame, approx: bool = False) -> DataFrame:
    """One row per column: position, column, dtype, inferred_type, n_unique,
    n_missing, pct_missing (half-even, 2 decimals) and datetime_format.

    inferred_type is boolean / datetime / numeric / categorical / text.
    ``approx=True`` uses ``approx_count_distinct`` for n_unique.
    """
    fields = df.schema.fields
    wide = _facts_approx(df) if approx or not fields else _facts(df)
    rows = F.col("__rows")
    recs = []
    for i, f in enumerate(fields):
        nn, nu = F.col(f"nn{i}"), F.col(f"nu{i}")
        fmt = F.lit(None).cast("string")
        if isinstance(f.dataType, T.BooleanType):
            kind = F.lit("boolean")
        elif is_datetime(f.dataType):
            kind = F.lit("datetime")
        elif is_numeric(f.dataType):
            kind = F.lit("numeric")
        elif isinstance(f.dataType, T.StringType):
            # first format under which every non-null value parses (vacuous if none)
            for j in reversed(range(len(DATETIME_FORMATS))):
                fmt = F.when(F.col(f"fmt{i}_{j}") == nn, F.lit(DATETIME_FORMATS[j][1])).otherwise(fmt)
            free_ok = F.col(f"free{i}") / F.greatest(nn, F.lit(1)) > FALLBACK_PARSE_RATE
            fmt = F.when(fmt.isNull() & free_ok, F.lit("auto")).otherwise(fmt)
            cat = (nu / F.greatest(nn, F.lit(1)) < CATEGORICAL_RATIO) | (nu <= CATEGORICAL_MAX_UNIQUE)
            kind = (F.when(fmt.isNotNull(), F.lit("datetime"))
                    .when(cat, F.lit("categorical")).otherwise(F.lit("text")))
        else:
            cat = (nu / F.greatest(nn, F.lit(1)) < CATEGORICAL_RATIO) | (nu <= CATEGORICAL_MAX_UNIQUE)
            kind = F.when(cat, F.lit("categorical")).otherwise(F.lit("text"))
        missing = rows - nn
        recs.append(F.struct(
            F.lit(i).alias("position"), F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("dtype"), kind.alias("inferred_type"),
            nu.cast("long").alias("n_unique"), missing.cast("long").alias("n_missing"),
            F.bround(F.try_divide(missing * 100.0, rows.cast("double")), 2).alias("pct_missing"),
            fmt.alias("datetime_format")))
    return wide.select(F.inline(F.array(*recs)))


def schema_dict(schema_df: DataFrame) -> dict:
    """Collect the per-column schema (one row per column: bounded metadata)."""
    return {r["column"]: r.asDict() for r in schema_df.orderBy("position").collect()}


def parse_datetime_columns(df: DataFrame, schema: dict) -> DataFrame:
    """Cast inferred-datetime string columns with the sniffed format; bad -> NULL."""
    out = []
    for f in df.schema.fields:
        info = schema.get(f.name)
        c = F.col(f"`{f.name}`")
        if info and info["inferred_type"] == "datetime" and isinstance(f.dataType, T.StringType):
            fmt = info.get("datetime_format")
            parsed = parse_with(c, fmt) if fmt and fmt != "auto" else free_parse(f.name)
            out.append(parsed.cast("timestamp_ntz").alias(f.name))
        else:
            out.append(c)
    return df.select(*out)
