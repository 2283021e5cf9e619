"""Quality rules: a threshold table compiled into one Spark projection.

Every measure is a column expression over the text of its own row, so the whole
table is one narrow scan without shuffle or user functions.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiln.llm.common import words


class Rule(NamedTuple):
    name: str
    measure: str
    low: float | None
    high: float | None


#: Common words of the four languages of the corpus; a text of prose holds several.
STOP_WORDS = ["the", "of", "and", "to", "in", "is", "that", "it",
              "der", "die", "das", "und", "ist", "von", "zu", "den", "mit", "im",
              "de", "la", "le", "les", "et", "des", "un", "une", "du", "que", "est",
              "el", "los", "las", "en", "y", "por", "una", "del", "se", "con"]
STOP_FORMS = STOP_WORDS + [s.capitalize() for s in STOP_WORDS]

#: The method's verdict on what passed the base rules; bounds are inclusive.
THRESHOLDS = [
    Rule("word_length", "mean_word_chars", 2.0, 15.0),
    Rule("symbols", "symbol_ratio", None, 0.2),
    Rule("stop_words", "stop_word_ratio", 0.01, None),
    Rule("duplicate_lines", "dup_line_ratio", None, 0.5),
    Rule("line_length", "words_per_line", 1.5, None),
    Rule("shouting", "upper_ratio", None, 0.4),
]

BASE_MIN_WORDS = 50
BASE_MAX_REPEAT_PERCENT = 50


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def _repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that the text holds at least twice.

    Windows are compared by a 64-bit hash inside one text.  Where no hash
    repeats the answer is 0; else the windows are sorted by (hash, position),
    neighbours of equal hash give the repeated positions, and each adds the
    words that the next repeated window does not cover itself.
    """
    hashes = F.transform(w, lambda x: F.xxhash64(x))
    n = F.size(w)
    first = F.slice(hashes, F.lit(1), n - 2)
    windows = F.zip_with(F.zip_with(first, F.slice(hashes, F.lit(2), n - 2), lambda a, b: F.xxhash64(a, b)),
                         F.slice(hashes, F.lit(3), n - 2), lambda ab, c: F.xxhash64(ab, c))
    return F.when(n >= 4, windows)


def _covered(windows: Column) -> Column:
    """Positions covered by repeated windows, from the array of window hashes."""
    ranked = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    m = F.size(windows)
    same = F.zip_with(F.slice(ranked, F.lit(1), m - 1), F.slice(ranked, F.lit(2), m - 1),
                      lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    hit = F.sort_array(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull()))))
    return F.aggregate(
        hit, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda s, p: F.struct((p + 3).alias("end"),
                              (s["n"] + F.least(F.lit(3), p + 3 - s["end"])).alias("n")))["n"]


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id, the counts of the base rules and the ratios
    named in the threshold table.  Null text counts as empty; ratios of an empty
    text are 0; ids may be null or repeat (every row is measured by itself)."""
    t = F.col("__t")
    base = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__t"))
    base = base.withColumn("__w", words(t))
    base = base.withColumn("__win", _repeat_words(F.col("__w")))
    base = base.withColumn("__lines", F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    n = F.size("__w").cast("long")
    n_lines = F.size("__lines").cast("long")
    out = base.select(
        F.col(id_col), n.alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        _count(t, r"[#*$%&|<>]").alias("n_symbols"),
        (n_lines - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("__win").isNull() | (F.size(F.array_distinct("__win")) == F.size("__win")), F.lit(0))
        .otherwise(_covered(F.col("__win"))).cast("long").alias("n_repeat_words"),
        n_lines.alias("__n_lines"),
        F.size(F.filter("__w", lambda x: x.isin(STOP_FORMS))).alias("__stop"),
        _count(t, "[A-Z]").alias("__upper"))

    def ratio(a, b):
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    return out.select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ratio("word_chars", "n_words").alias("mean_word_chars"),
        ratio("n_symbols", "n_words").alias("symbol_ratio"),
        ratio("__stop", "n_words").alias("stop_word_ratio"),
        ratio("n_dup_lines", "__n_lines").alias("dup_line_ratio"),
        ratio("n_words", "__n_lines").alias("words_per_line"),
        ratio("__upper", "word_chars").alias("upper_ratio"))


def verdict(rules: list[Rule]) -> Column:
    """The threshold table as one Boolean expression."""
    ok = F.lit(True)
    for r in rules:
        if r.low is not None:
            ok = ok & (F.col(r.measure) >= r.low)
        if r.high is not None:
            ok = ok & (F.col(r.measure) <= r.high)
    return ok


def quality_rules(docs: DataFrame, rules: list[Rule] | None = None,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``measures`` plus ``base_failed`` and ``kept``.

    ``base_failed``: under 50 words, or more than half of the words lie in
    repeated 3-word windows.  ``kept``: not base_failed and every rule of the
    threshold table holds.  A null or empty text has no word: base_failed.
    """
    m = measures(docs, id_col, text_col)
    failed = ((F.col("n_words") < BASE_MIN_WORDS)
              | (100 * F.col("n_repeat_words") > BASE_MAX_REPEAT_PERCENT * F.col("n_words")))
    return m.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & verdict(THRESHOLDS if rules is None else rules))


def op10_quality_rules(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                                      "n_repeat_words", "base_failed", "kept")


OP10_SQL = r"""with t as (
  select doc_id, coalesce(text, '') as t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w
  from documents),
w as (
  select doc_id, unnest(w) as word, generate_subscripts(w, 1) as p from t),
tri as (
  select doc_id, p, word,
         lead(word, 1) over (partition by doc_id order by p) as b,
         lead(word, 2) over (partition by doc_id order by p) as c
  from w),
rep as (
  select doc_id, p, count(*) over (partition by doc_id, word, b, c) as n from tri where c is not null),
cov as (
  select doc_id, count(distinct q) as n_repeat_words
  from (select doc_id, unnest([p, p + 1, p + 2]) as q from rep where n >= 2) group by doc_id),
lines as (
  select doc_id, unnest(string_split(t, chr(10))) as line from t),
dup as (
  select doc_id, count(*) - count(distinct line) as n_dup_lines, count(*) as n_lines
  from lines where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id),
stops as (
  select doc_id, count(*) as n_stop from w where word in (""" + ", ".join(
    f"'{s}'" for s in STOP_FORMS) + r""") group by doc_id),
m as (
  select t.doc_id, len(w)::bigint as n_words,
         length(array_to_string(w, ''))::bigint as word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols,
         coalesce(n_dup_lines, 0)::bigint as n_dup_lines,
         coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
         coalesce(n_lines, 0) as n_lines, coalesce(n_stop, 0) as n_stop,
         len(regexp_extract_all(t, '[A-Z]')) as n_upper
  from t left join cov using (doc_id) left join dup using (doc_id) left join stops using (doc_id)),
v as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and word_chars / n_words between 2.0 and 15.0 and n_symbols / n_words <= 0.2
       and n_stop / n_words >= 0.01 and n_dup_lines / n_lines <= 0.5 and n_words / n_lines >= 1.5
       and n_upper / word_chars <= 0.4 as kept
from v"""
