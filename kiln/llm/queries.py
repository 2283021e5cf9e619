"""The registered queries of this package and their DuckDB twins."""

from __future__ import annotations

from kiln.llm.cotrain import op9_quality_classifier
from kiln.llm.cross_tokens import op11_cross_tokenizer_alignment
from kiln.llm.decontam import op3_benchmark_decontamination
from kiln.llm.hard_negatives import OP12_SQL, op12_hard_negative_mining
from kiln.llm.html_extract import op2_html_extraction
from kiln.llm.jaccard_join import op4_ngram_jaccard_join
from kiln.llm.lang_id import op7_lang_id
from kiln.llm.line_dedup import OP8_SQL, op8_line_dedup
from kiln.llm.packing import op5_best_fit_packing
from kiln.llm.quality_rules import OP10_SQL, op10_quality_rules
from kiln.llm.secret_scan import OP1_SQL, op1_secret_scan
from kiln.llm.setsketch import op13_minhash_near_dedup
from kiln.llm.toxicity import op6_toxicity

QUERIES = {f.__name__: f for f in (
    op1_secret_scan, op2_html_extraction, op3_benchmark_decontamination, op4_ngram_jaccard_join,
    op5_best_fit_packing, op6_toxicity, op7_lang_id, op8_line_dedup, op9_quality_classifier, op10_quality_rules,
    op11_cross_tokenizer_alignment, op12_hard_negative_mining, op13_minhash_near_dedup)}


def components_sql(words: int, percent: int, more: str = "") -> str:
    """Components of documents linked by word shingles: links by shared shingles, then
    the transitive closure."""
    shingle = " || ' ' || ".join(f"w[i + {k}]" for k in range(words))
    return rf"""with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sh as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < {words} then [array_to_string(w, ' ')]
         else list_transform(range(1, len(w) - {words - 2}), lambda i: {shingle}) end) as s
  from w),
n as (select doc_id, count(*) as n from sh group by doc_id),
links as (
  select a.doc_id as a, b.doc_id as b
  from sh a join sh b on a.s = b.s and a.doc_id <> b.doc_id
  join n x on x.doc_id = a.doc_id join n y on y.doc_id = b.doc_id
  where least(x.n, y.n) * 100 >= {percent} * greatest(x.n, y.n)
  group by a.doc_id, b.doc_id, x.n, y.n having 100 * count(*) >= {percent} * (x.n + y.n - count(*))),
reach as (
  select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(m.c, d.doc_id)) as component_id{more}
from documents d left join n using (doc_id)
left join (select a, min(b) as c from reach group by a) m on m.a = d.doc_id"""


OP4_SQL = components_sql(3, 90)
OP13_SQL = components_sql(2, 80, ", d.doc_id = least(d.doc_id, coalesce(m.c, d.doc_id)) as kept")

SQL = {"op1_secret_scan": OP1_SQL, "op4_ngram_jaccard_join": OP4_SQL, "op8_line_dedup": OP8_SQL,
       "op10_quality_rules": OP10_SQL, "op12_hard_negative_mining": OP12_SQL, "op13_minhash_near_dedup": OP13_SQL}
