"""Line dedup: lines repeated across documents go, DataFrame operations only.

Normalised lines are exploded and hashed (128 bits), distinct documents are
counted per hash, and each document is reassembled from the lines that stay.
Only (hash, doc_id) pairs are shuffled for the counting; the text moves once,
to meet the drop list of its document.  A line that very many documents hold
is pre-aggregated before its shuffle and salted in the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiln.llm.common import WHITE, lower_az

#: Ways in which the pairs of one line are split before they meet its count.
SALTS = 8


def line_key(line: Column) -> Column:
    return lower_az(F.btrim(line, F.lit(WHITE)))


def _digest(key: Column) -> Column:
    return F.unhex(F.md5(key))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` with ``text_col`` rewritten, plus ``n_lines`` and ``n_dropped`` (long).

    A line's key is the line, stripped and lower-cased (A-Z).  Keys of at least
    ``min_chars`` code points that at least ``min_docs`` distinct ids hold lose
    all their lines except in the largest id that holds them.

    Null or empty text: one empty line, and the text becomes ''.  Rows that share
    an id count as one document and lose the same lines.  A null id is no
    document for the counting; its repeated lines go.  All lines gone: ''.
    Other columns pass through; present ``n_lines``/``n_dropped`` are replaced.
    """
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    # outer, as a condition on the array would be pushed down and compute it again
    held = docs.select(F.col(id_col).alias("d"), lines.alias("ls")).select(
        "d", F.explode_outer(F.array_distinct(F.filter(
            F.transform("ls", line_key), lambda k: F.length(k) >= min_chars))).alias("key")
    ).filter("key is not null").select("d", _digest(F.col("key")).alias("h"))
    repeated = (held.groupBy("h").agg(F.count_distinct("d").alias("n"), F.max("d").alias("keep"))
                .filter(F.col("n") >= min_docs)
                .select("h", "keep", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
    drops = (held.withColumn("salt", F.pmod(F.xxhash64("d"), F.lit(SALTS)).cast("int"))
             .join(repeated, ["h", "salt"])
             .filter(F.col("d").isNull() | (F.col("d") < F.col("keep")))
             .groupBy("d").agg(F.collect_set("h").alias("__drops"))
             .withColumnRenamed("d", "__drop_id"))
    joined = docs.drop("n_lines", "n_dropped").join(
        drops.hint("shuffle_hash"), F.col(id_col).eqNullSafe(F.col("__drop_id")), "left")
    split = joined.withColumn("__lines", lines)
    kept = split.withColumn("__kept", F.when(F.col("__drops").isNull(), F.col("__lines")).otherwise(
        F.filter("__lines", lambda x: ~F.array_contains("__drops", _digest(line_key(x))))))
    return (kept.withColumn("n_lines", F.size("__lines").cast("long"))
            .withColumn("n_dropped", (F.size("__lines") - F.size("__kept")).cast("long"))
            .withColumn(text_col, F.array_join("__kept", "\n"))
            .drop("__lines", "__kept", "__drops", "__drop_id"))


def op8_line_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped",
                                   F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


_LINES_SQL = r"""lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from {docs}),
keyed as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as line_key
  from lines),
repeated as (
  select line_key, max(doc_id) as keep from keyed where length(line_key) >= 40
  group by line_key having count(distinct doc_id) >= 5),
marked as (
  select k.*, r.keep is not null and k.doc_id <> r.keep as gone
  from keyed k left join repeated r using (line_key))"""

OP8_SQL = "with " + _LINES_SQL.format(docs="documents") + """
select doc_id, count(*)::bigint as n_lines, (count(*) filter (gone))::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from marked group by doc_id"""
