"""Each stage of the pipeline, and the whole run, against plain Python; bounded samples."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from kiln.llm import common, cotrain, lang_id, toxicity
from tests.llm.test_whole_job import brute_pairs

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LINE = "this very line of more than forty characters stands in many documents"


def corpus():
    rng = random.Random(12)
    def said(lang, n):
        return " ".join(f"{'the' if lang == 'en' else 'der'}{'aeiou'[rng.randrange(5)]}{lang}{rng.randrange(300)}x"
                        .translate({ord(str(k)): c for k, c in enumerate("abcdefghij")}) for _ in range(n))
    items = [(k, said("en", 60)) for k in range(3)]
    rows = [(i, said("en" if i % 3 else "de", rng.randrange(20, 80)), "en" if i % 3 else "de") for i in range(60)]
    rows += [(100 + i, f"{said('en', 30)}\n{LINE}\n{said('en', 10)}", "en") for i in range(7)]
    base = said("en", 120)
    rows += [(200 + i, base, "en") for i in range(4)]
    rows += [(210 + i, base + " " + said("en", 2), "en") for i in range(4)]
    rows += [(300 + k, f"{said('en', 20)} {t} {said('en', 20)}", "en") for k, t in items]
    rows += [(400, said("en", 30_000), "en"), (401, None, "en"), (402, "", "de"), (403, "12 34 !", None),
             (404, rows[1][1], None), (405, said("de", 30), None), (406, said("de", 30), "de"), (406, said("de", 31), "de"),
             (407, rows[2][1], "en"), (407, rows[2][1], "en"), (None, said("en", 40), "en"), (None, base, None)]
    return [(i, t, g, None if i == 405 else "web", None if t is None else len(t)) for i, t, g in rows], items


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def listed(df):
    return sorted((tuple(r) for r in df.select(*cp.COLUMNS).collect()), key=repr)


def plain_language(rows):
    """Word-first backoff, written from its definition."""
    seen = {(i, t, g) for i, t, g, *_ in rows if t is not None and g is not None
            and zlib.crc32(b"" if i is None else str(i).encode()) % 4 != 2}
    langs = sorted({g for *_, g in seen})
    words, grams = defaultdict(Counter), defaultdict(Counter)
    for _, t, g in seen:
        words[g].update(lang_id.letters(t.lower()))
    for g, c in words.items():
        for w, k in c.items():
            for n in range(1, 5):
                for x in lang_id.grams(w, n):
                    grams[g][x] += k
    def scorer(counts):
        known = set().union(*counts.values())
        total = {g: counts[g].total() + 0.5 * len(known) for g in langs}
        def vector(x):
            v = [math.log((counts[g][x] + 0.5) / total[g]) for g in langs]
            return [a - max(v) for a in v]
        return known, vector
    known_words, word_vector = scorer(words)
    known_grams, gram_vector = scorer(grams)
    def label(t):
        found = lang_id.letters((t or "").lower())
        if not found:
            return "und", 0.0
        s = [0.0] * len(langs)
        for w in found:
            if w in known_words:
                vs = [word_vector(w)]
            else:
                vs = next((v for n in range(4, 0, -1) if (v := [gram_vector(x) for x in lang_id.grams(w, n)
                                                              if x in known_grams])), [[0.0] * len(langs)])
            s = [a + sum(c) / len(vs) for a, c in zip(s, zip(*vs))]
        e = [math.exp(a - max(s)) for a in s]
        return langs[s.index(max(s))], max(e) / sum(e)
    return label


def plain_lines(rows):
    keys = defaultdict(set)
    split = [(r, (r[1] or "").split("\n")) for r in rows]
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(common.LOWER_AZ)
    for r, ls in split:
        for x in map(key, ls):
            if len(x) >= 40 and r[0] is not None:
                keys[x].add(r[0])
    out = []
    for r, ls in split:
        t = "\n".join(x for x in ls if len(keys.get(key(x), ())) < 5 or r[0] == max(keys[key(x)]))
        out.append((r[0], t, r[2], r[3], len(t)))
    return out


def plain_near(rows):
    def shingles(t):
        w = (t or "").translate(common.LOWER_AZ).split()
        return {" ".join(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({" ".join(w)} if w else set())
    sets = [(r[0], shingles(r[1])) for r in rows]
    group = {i: i for i, _ in sets if i is not None}
    def top(i):
        while group[i] != i:
            i = group[i]
        return i
    # rows of one id are one document here: all of its sets link it
    for a, (i, x) in enumerate(sets):
        for j, y in sets[a + 1:]:
            if i is not None and j is not None and x and y and 100 * len(x & y) >= 80 * len(x | y):
                lo, hi = sorted((top(i), top(j)))
                group[hi] = lo
    return [r for r in rows if r[0] is None or top(r[0]) == r[0]]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, items = corpus()
    at = str(tmp_path_factory.mktemp("corpus"))
    frame(spark, rows).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_stage_names():
    assert [n for n, _ in cp.STAGES] == ["language ID", "line dedup", "n-gram Jaccard join", "benchmark decontamination",
                                         "best-fit packing"]


def test_language_stage(spark):
    rows, _ = corpus()
    label = plain_language(rows)
    want = sorted((r for r in rows if (lambda x: x[0] != "und" and x[1] >= 0.5)(label(r[1]))), key=repr)
    assert listed(cp.language(spark, frame(spark, rows), None)) == want
    assert not {401, 402, 403} & {r[0] for r in want} and {404, 405, None} <= {r[0] for r in want}
    df = frame(spark, rows)
    scored = lang_id.predict(df, lang_id.train(lang_id.train_rows(df))).collect()
    for r in scored:
        assert (r["lang_pred"], r["score"]) == (label(r["text"])[0], pytest.approx(label(r["text"])[1], abs=1e-4))


def test_lines_stage(spark):
    rows, _ = corpus()
    got = listed(cp.lines(spark, frame(spark, rows), None))
    assert got == sorted(plain_lines(rows), key=repr)
    assert sum(LINE in r[1] for r in got) == 1


def test_near_duplicates_stage(spark):
    rows, _ = corpus()
    got = listed(cp.near_duplicates(spark, frame(spark, rows), None))
    assert got == sorted(plain_near(rows), key=repr)
    assert {200} == {r[0] for r in got if r[0] in range(200, 220)}


def test_benchmark_stage(spark, folder):
    rows, items = corpus()
    held = {d for d, _ in brute_pairs([(r[0], r[1] or "") for r in rows if r[0] is not None], items)}
    assert held == {300, 301, 302}
    got = listed(cp.benchmark_free(spark, frame(spark, rows), folder))
    assert got == sorted((r for r in rows if r[0] not in held), key=repr)


def plain_pieces(rows):
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = []
    for i, text, *_ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at:at + 4096]
            out.append((i, k, at, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))))
    return sorted(out, key=repr)


def whole(packed):
    """Every sequence is gapless from 0 and at most 4096 long."""
    by = defaultdict(list)
    for r in packed:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096
    return len(by)


def test_packing_stage(spark):
    rows, _ = corpus()
    got = cp.packed(spark, frame(spark, rows), None).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == plain_pieces(rows)
    assert whole(got) <= math.ceil(sum(r["length"] for r in got) / 4096) + 1


def test_run_is_the_chain_of_plain_stages(spark, folder):
    rows, items = corpus()
    label = plain_language(rows)
    rows = [r for r in rows if (lambda x: x[0] != "und" and x[1] >= 0.5)(label(r[1]))]
    rows = plain_near(plain_lines(rows))
    held = {d for d, _ in brute_pairs([(r[0], r[1]) for r in rows if r[0] is not None], items)}
    got = cp.run(spark, folder).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == plain_pieces([r for r in rows if r[0] not in held])
    whole(got)


def test_empty_table_and_clashing_columns(spark, folder):
    none = spark.createDataFrame([], SCHEMA)
    for _, stage in cp.STAGES:
        assert stage(spark, none, folder).count() == 0
    rows, _ = corpus()
    more = frame(spark, rows).withColumns({c: F.lit("x") for c in ("lang_pred", "score", "n_lines", "n_dropped", "item_id")})
    for name, stage in cp.STAGES[:-1]:
        assert listed(stage(spark, more, folder)) == listed(stage(spark, frame(spark, rows), folder)), name


@pytest.mark.parametrize("hot", [7, None])
def test_samples_stay_bounded_and_are_never_empty(spark, hot):
    same = spark.range(20_000).select(F.lit(hot).cast("long").alias("doc_id"), F.lit("one text").alias("text"))
    own = spark.range(20_000).select(F.lit(hot).cast("long").alias("doc_id"), F.concat(F.lit("t "), "id").alias("text"))
    assert common.bounded_sample(same, 15_000).count() == 1
    assert common.bounded_sample(own, 600).count() == 600
    assert common.bounded_sample(own.unionByName(same), 30_000).count() == 20_001
    assert common.bounded_sample(own.limit(0), 5).count() == 0
    assert listed_texts(own.repartition(7)) == listed_texts(own.repartition(2))


def listed_texts(df):
    return sorted(r["text"] for r in common.bounded_sample(df, 50).collect())


def test_toxicity_learns_from_one_hot_id(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "POSITIVES", 50)
    rows = [(5, f"vile word{i}") for i in range(300)] + [(6 + i, f"kind word{i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i == 5)) for i in range(5, 306)], "doc_id long, toxic int")
    seen = []
    fit = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda p, u, prior: seen.append(len(p)) or fit(p, u, prior))
    model = toxicity.train(docs, labels)
    assert seen == [50]
    ask = spark.createDataFrame([(1, "vile"), (2, "kind")], "doc_id long, text string")
    bad, good = [r["score"] for r in toxicity.score(ask, model).orderBy("doc_id").collect()]
    assert bad > good


def test_quality_reads_words(spark):
    """Documents alike in every measure but their words."""
    rng = random.Random(3)
    rows = [(i, " ".join(f"{'good' if i % 2 else 'poor'}{rng.choice('abcdefgh')}" for _ in range(40)), "en", "web", 239)
            for i in range(200)]
    docs = spark.createDataFrame([(i, t, g, s, n) for i, t, g, s, n in rows], SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, quality int")
    model = cotrain.train(docs, labels)
    odd = spark.createDataFrame([(900, None, None, None, None), (901, "", "en", None, 0), (901, "", "en", None, 0),
                                 (None, "gooda " * 50_000, "en", "web", 300_000)], SCHEMA)
    got = cotrain.score(docs.filter("doc_id >= 100").unionByName(odd), model).toPandas()
    known = got[got.doc_id.between(100, 199)]
    assert ((known.p_text > 0.5) == (known.doc_id % 2 == 1)).all()
    assert len(got) == 104 and got.score.between(0, 1).all()
    more = docs.withColumns({"quality": F.lit(9), "score": F.lit("x"), "__h": F.lit(1)})
    assert (cotrain.train(more, labels)["t"].w == model["t"].w).all()
    assert cotrain.train(docs.limit(0), labels) is None
