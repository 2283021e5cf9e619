"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; ``run`` writes every stage's rows as Parquet in the shared folder of the
cluster and gives the reread table to the next stage.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from kiln.llm import common, decontam, jaccard_join, lang_id, line_dedup, packing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents whose language the model does not know with at least this posterior go.
MIN_LANG_SCORE = 0.5


def language(spark, docs, sf_dir):
    """Keeps the documents with a recognised language; text without a letter goes."""
    found = lang_id.predict(docs, lang_id.train(lang_id.train_rows(docs)))
    return found.filter((F.col("lang_pred") != lang_id.UNKNOWN) & (F.col("score") >= MIN_LANG_SCORE)).select(*COLUMNS)


def lines(spark, docs, sf_dir):
    """Drops repeated lines; ``n_chars`` is that of the text which stays."""
    return line_dedup.line_dedup(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark, docs, sf_dir):
    """Keeps the document of the smallest id of every group that five-word shingles
    link at a similarity of 0.8; a document without id or shingle stays."""
    groups = jaccard_join.jaccard_components(docs, n=5, percent=80)
    gone = groups.filter("component_id <> doc_id").select(F.col("doc_id").alias("__gone"))
    return docs.join(gone.hint("shuffle_hash"), F.col("doc_id") == F.col("__gone"), "left_anti").select(*COLUMNS)


def benchmark_free(spark, docs, sf_dir):
    """Drops the documents that hold a benchmark item."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def packed(spark, docs, sf_dir):
    """Packs all pieces of all documents into sequences of at most 4096 tokens."""
    import public_tokenizers
    return packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("language ID", language), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates),
          ("benchmark decontamination", benchmark_free), ("best-fit packing", packed)]

#: A trained model and a packing order are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        rows = stage(spark, rows, sf_dir)
        if k < len(STAGES) - 1:
            rows = common.staged(rows, name.replace(" ", "_"))
    return rows
