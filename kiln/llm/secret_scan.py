"""Secret scans over a trigram inverted index, DataFrame operations only.

Each rule's regex is turned, once on the driver, into a Boolean trigram query
(an OR of ANDs).  The index holds postings (trigram, doc_id) for every trigram
that the rule set can ask for.  Intersecting the postings gives the candidate
rules of each document; only those regexes run on its text.  A rule without
mandatory trigrams runs on every text.
"""

from __future__ import annotations

from re import _constants as sre  # the standard library's own regex parser
from re import _parser as sre_parse
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_STRINGS = 128
ANY = frozenset([frozenset()])


class Rule(NamedTuple):
    """``regex`` in the syntax that Java and Python share; matches whose group
    ``group`` has under ``min_chars`` characters are dropped after matching."""
    kind: str
    regex: str
    group: int
    min_chars: int


BASE_RULES = [
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),  # the runs of [0-9a-f]+ that are long enough
]
MORE_RULES = [
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    Rule("git_token", r"gh[opsur]_[A-Za-z0-9]{36,}", 0, 0),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35}", 0, 0),
    Rule("payment_key", r"[rs]k_live_[A-Za-z0-9]{16,}", 0, 0),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
]


# -- from a regex to a Boolean trigram query --------------------------------------------------

def _absorb(clauses) -> frozenset:
    return frozenset(c for c in clauses if not any(o < c for o in clauses))


def _and(p, q) -> frozenset:
    if len(p) * len(q) > MAX_STRINGS:
        return min(p, q, key=len)  # a weaker query is still right
    return _absorb({a | b for a in p for b in q})


def _strings_query(strings) -> frozenset:
    """One of the strings occurs: the trigrams of at least one of them all occur."""
    return _absorb({frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings})


def _concat(items):
    run, query, cut = {""}, ANY, False
    for op, arg in items:
        exact, sub = _node(op, arg)
        if exact is not None and len(run) * len(exact) <= MAX_STRINGS:
            run = {a + b for a in run for b in exact}
            continue
        cut = True
        query = _and(_and(query, _strings_query(run)), sub if exact is None else ANY)
        run = {""} if exact is None else exact
    return (None, _and(query, _strings_query(run))) if cut else (run, ANY)


def _node(op, arg):
    """(all strings the node can match, lower-cased, or None; query when None)."""
    if op is sre.LITERAL:
        return {chr(arg).lower()}, ANY
    if op is sre.IN and all(o is sre.LITERAL for o, _ in arg) and len(arg) <= 8:
        return {chr(v).lower() for _, v in arg}, ANY
    if op is sre.SUBPATTERN:
        return _closed(arg[-1])
    if op is sre.BRANCH:
        parts = [_closed(b) for b in arg[1]]
        if all(e is not None for e, _ in parts):
            return set().union(*(e for e, _ in parts)), ANY
        return None, _absorb(frozenset().union(*(_strings_query(e) if e is not None else q for e, q in parts)))
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, body = arg
        exact, query = _closed(body)
        if (low, high) == (0, 1) and exact is not None:
            return exact | {""}, ANY
        return None, ANY if low == 0 else query if exact is None else _strings_query(exact)
    if op is sre.AT:
        return {""}, ANY
    return None, ANY


def _closed(items):
    exact, query = _concat(items)
    return exact, query


def trigram_query(regex: str) -> list[list[str]] | None:
    """OR of ANDs of lower-cased trigrams that a text with a match must hold;
    None if the regex has no mandatory trigram."""
    exact, query = _concat(sre_parse.parse(regex))
    query = _strings_query(exact) if exact is not None else query
    return None if frozenset() in query else sorted(sorted(c) for c in query)


# -- the index and the scan -------------------------------------------------------------------

def trigram_index(docs: DataFrame, trigrams: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings (trigram, doc_id) of the given trigrams over lower-cased texts."""
    low = docs.select(F.col(id_col).alias("doc_id"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return low.select(F.explode_outer(held).alias("trigram"), "doc_id").filter("trigram is not null")


def candidates(index: DataFrame, queries: dict[str, list[list[str]]]) -> DataFrame:
    """(doc_id, kinds): the rules whose trigram query the postings satisfy.

    A clause holds where the posting lists of all its trigrams meet, counted per
    (document, clause): a hot trigram's list is never brought together.
    """
    rows = ", ".join(f"('{kind}', {c}, {len(clause)}, '{t}')"
                     for kind, clauses in queries.items() for c, clause in enumerate(clauses)
                     for t in (x.replace("\\", "\\\\").replace("'", "\\'") for x in clause))
    asked = index.sparkSession.sql(f"select * from values {rows} as q(kind, clause, need, trigram)")
    # the rule set is a constant of a few rows, so it may be broadcast
    return (index.join(F.broadcast(asked), "trigram")
            .groupBy("doc_id", "kind", "clause", "need").agg(F.count_distinct("trigram").alias("got"))
            .filter(F.col("got") == F.col("need"))
            .groupBy("doc_id").agg(F.collect_set("kind").alias("kinds")))


SPAN = "array<struct<start:int,kind_no:int,kind:string,end:int>>"


def _spans(text: Column, rule: Rule, kind_no: int) -> Column:
    """Spans of one rule by the lengths of what lies between its matches."""
    between = F.transform(F.split(text, rule.regex, -1), lambda x: F.length(x))
    whole = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group))
    found = F.arrays_zip(F.slice(between, F.lit(1), F.size(whole)).alias("b"), whole.alias("w"), value.alias("v"))
    walked = F.aggregate(
        found, F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out")),
        lambda s, x: F.struct(
            (s["at"] + x["b"] + F.length(x["w"])).alias("at"),
            F.when(F.length(x["v"]) < rule.min_chars, s["out"]).otherwise(F.concat(s["out"], F.array(F.struct(
                (s["at"] + x["b"]).alias("start"), F.lit(kind_no).alias("kind_no"), F.lit(rule.kind).alias("kind"),
                (s["at"] + x["b"] + F.length(x["w"])).alias("end"))))).alias("out")))
    return walked["out"]


def _join_spans(spans: Column) -> Column:
    return F.array_join(F.transform(F.sort_array(spans), lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, rules: list[Rule] | None = None, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id and ``found``, its spans as an array of
    (start, kind_no, kind, end) in order of start, then of the rules as listed.
    Positions are code points, the end is exclusive.

    Matches are leftmost and do not overlap within one kind.  Null or empty text:
    no spans.  Rows that share an id, or have none, are scanned each by itself.
    """
    rules = BASE_RULES + MORE_RULES if rules is None else rules
    queries = {r.kind: trigram_query(r.regex) for r in rules}
    asked = {k: q for k, q in queries.items() if q}
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("__t"))
    if asked:
        trigrams = sorted({t for q in asked.values() for c in q for t in c})
        cand = candidates(trigram_index(base, trigrams, "doc_id", "__t"), asked)
        base = base.join(cand.withColumnRenamed("doc_id", "__id").hint("shuffle_hash"),
                         F.col("doc_id").eqNullSafe(F.col("__id")), "left").drop("__id")
    t = F.col("__t")
    none = F.array().cast(SPAN)
    parts = []
    for no, r in enumerate(rules):
        may = F.coalesce(F.array_contains("kinds", r.kind), F.lit(False)) if r.kind in asked else F.lit(True)
        parts.append(F.when(may & t.rlike(r.regex), _spans(t, r, no)).otherwise(none))
    return base.select("doc_id", F.sort_array(F.concat(*parts)).alias("found"))


def op1_secret_scan(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan_secrets(docs)

    def n(kind):
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("found", lambda x: x["kind_no"] < len(BASE_RULES))
    return found.select("doc_id", n("assign"), n("access"), n("hex"),
                        F.sha2(_join_spans(base).cast("binary"), 256).alias("base_sha256"),
                        _join_spans(F.col("found")).alias("spans"))


def _sql(rules: list[Rule], base: int) -> str:
    """The scan in SQL: matches and what lies between them, with running lengths."""
    def quoted(s):
        return s.replace("'", "''")
    parts = []
    for no, r in enumerate(rules):
        p = quoted(r.regex)
        parts.append(f"""
  select doc_id, {no} as kind_no, '{r.kind}' as kind, v,
         sum(length(b)) over w + sum(length(m)) over w - length(m) as s, sum(length(b)) over w + sum(length(m)) over w as e
  from (select doc_id, unnest(regexp_extract_all(t, '{p}')) as m, unnest(regexp_extract_all(t, '{p}', {r.group})) as v,
               unnest(string_split_regex(t, '{p}')[:len(regexp_extract_all(t, '{p}'))]) as b,
               generate_subscripts(regexp_extract_all(t, '{p}'), 1) as k from t where regexp_matches(t, '{p}'))
  window w as (partition by doc_id order by k)
  qualify length(v) >= {r.min_chars}""")
    return f"""with t as (select doc_id, coalesce(text, '') as t from documents),
spans as ({" union all ".join(parts)}),
named as (select *, kind || ':' || s::bigint || ':' || e::bigint as x from spans)
select d.doc_id, (count(*) filter (kind = 'assign'))::bigint as n_assign,
       (count(*) filter (kind = 'access'))::bigint as n_access, (count(*) filter (kind = 'hex'))::bigint as n_hex,
       sha256(coalesce(string_agg(x, ',' order by s, kind_no) filter (kind_no < {base}), '')) as base_sha256,
       coalesce(string_agg(x, ',' order by s, kind_no), '') as spans
from documents d left join named n on n.doc_id = d.doc_id group by d.doc_id"""


OP1_SQL = _sql(BASE_RULES + MORE_RULES, len(BASE_RULES))
