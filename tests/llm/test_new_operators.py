"""Cross-tokenizer alignment, hard negatives and SetSketch near-dedup against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kiln.llm import cross_tokens, hard_negatives, setsketch
from tests.llm.test_operators import docs, words

P = pytest.importorskip("public_tokenizers")
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")

NULLS = [(901, None), (902, ""), (903, " \n\t "), (904, "x"), (904, "x"), (None, "null id text"), (None, "null id text")]


# -- 11 ---------------------------------------------------------------------------------------

def plain_groups(text, a, b):
    """Groups of ids by a loop over offsets, with the library tokenizers alone."""
    sides = []
    for ids, token_bytes in ((a.exact.encode(" " + text, add_special_tokens=False).ids, a.token_bytes),
                             (b.model.encode(text), b.token_bytes)):
        if not text or b"".join(token_bytes[i] for i in ids) != (" " + text).encode():
            return None
        ends, at = [], 0
        for i in ids:
            at += len(token_bytes[i])
            ends.append(at)
        sides.append(list(zip(ids, ends)))
    cuts = sorted({e for _, e in sides[0]} & {e for _, e in sides[1]})
    return [tuple([i for i, e in s if lo < e <= hi] for s in sides) for lo, hi in zip([0] + cuts, cuts)]


TEXTS = ["a plain text, with punctuation: and numbers 12345!", "naïve façade  two  spaces\n\nline\tend ", "日本語 テスト ½ ﬁ",
         "<|endoftext|> and <s> </s> <unk>", "a▁b", "x" * 3000, "ᾴ combining é", " nbsp em ​", "don't they'll",
         "emoji 👩‍👩‍👧 zwj", "{'a': [1, 2], \"b\": null}", " leading", "trailing   "]


def test_alignment_against_offsets(spark):
    rng = random.Random(1)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(50 + i, words(rng, 40, 30) + rng.choice([".", "  ", "é"])) for i in range(30)]
    rows += NULLS
    a, b = cross_tokens.ByteLevel(A), cross_tokens.Pieces(B)
    found = {t: plain_groups(t or "", a, b) for _, t in rows}
    count = Counter()
    for _, t in rows:
        count.update({(x, y) for ga, gb in found[t] or [] for x in ga for y in gb})
    top = defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    want = []
    for i, t in rows:
        g = found[t] or []
        links = [(x, y) for ga, gb in g for x in ga for y in gb]
        s = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in g)
        want.append((str(i), sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(links),
                     sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links),
                     hashlib.sha256(s.encode()).hexdigest() if g else ""))
    given = docs(spark, rows, code=1, codes="x", n=2, row=3, n_a="y")
    for slices in (3_000_000, 40):  # the second gives the counts back in many slices
        got = [(str(r["doc_id"]), r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"],
                r["groups_sha256"]) for r in cross_tokens.cross_token_counts(given, A, B, slice_pairs=slices).collect()]
        assert sorted(got) == sorted(want)
    assert found["a▁b"] is None and found[TEXTS[0]] is not None
    assert cross_tokens.cross_token_counts(docs(spark, []), A, B).count() == 0


def test_groups_are_returned(spark):
    r = cross_tokens.align(docs(spark, [(1, "hello world")]), A, B, with_groups=True).first()
    assert hashlib.sha256(r["groups"].encode()).hexdigest() == r["groups_sha256"] and r["n_overlaps"] >= r["n_groups"]


def test_gustavson_is_a_matrix_product():
    rng = np.random.default_rng(1)
    x, y = rng.random((30, 20)) < 0.2, rng.random((20, 25)) < 0.2

    def csr(m):
        return cross_tokens.Csr(np.append(0, np.cumsum(m.sum(1))), np.nonzero(m)[1])
    want = x.astype(int) @ y.astype(int)
    for most in (1, 17, 10_000):
        got = np.zeros_like(want)
        for row, col, value in cross_tokens.gustavson(csr(x), csr(y), most):
            got[row, col] += value
        assert (got == want).all()


def test_fast_byte_level_equals_the_tokenizer():
    rng = random.Random(2)
    a = cross_tokens.ByteLevel(A)
    letters = "aeiou tnrs  ,.!?'\"-\n\tABÉéßü0159#$½ﬁΣςжñ日👍́"
    texts = ["".join(rng.choices(letters, k=rng.randrange(1, 60))) for _ in range(4000)]
    want = [e.ids for e in a.exact.encode_batch([" " + t for t in texts], add_special_tokens=False)]
    assert [x.tolist() for x in a.encode(texts)] == want


# -- 12 ---------------------------------------------------------------------------------------

def vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return df.selectExpr("*", "1 as id", "2 as v", "'x' as score")


def plain_negatives(rows, anchor, k=5, m=10):
    clean = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        q = (label, [float(np.floor(256 * np.float64(np.float32(x)))) for x in v])
        clean[i] = min(clean.get(i, q), q)
    out = []
    for i, (label, v) in clean.items():
        if not anchor(i):
            continue
        score = {j: int(sum(a * b for a, b in zip(v, w))) for j, (_, w) in clean.items() if j != i}
        mine = sorted((j for j in score if clean[j][0] == label), key=lambda j: (-score[j], j))[:k]
        for p in mine:
            near = [j for j in score if clean[j][0] != label and 30 * score[p] <= 100 * score[j] <= 90 * score[p]]
            for r, j in enumerate(sorted(near, key=lambda j: (-score[j], j))[:m], 1):
                out.append((i, p, r, j, score[p], score[j]))
    return sorted(out)


@pytest.mark.parametrize("block", [(4096, 4096), (40, 3)])
def test_hard_negatives_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(hard_negatives, "ROW_BLOCK", block[0])
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", block[1])
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(4, 24))
    rows = [(i, (centre[i % 4] * rng.choice([0, 1, 1]) + rng.normal(size=24)).astype(np.float32).tolist(), int(rng.integers(0, 3)))
            for i in range(300)]
    rows += [(400 + i, rows[7][1], i % 3) for i in range(60)]  # ties
    rows += [(None, rows[0][1], 1), (500, None, 1), (501, rows[1][1], None), (502, [float("nan")] * 24, 1),
             (503, [None] * 24, 2), (504, [float("inf")] * 24, 0), (0, rows[5][1], 2), rows[10], rows[10],
             (600, [1.0] * 10, 1), (601, [], 2), (610, [0.0] * 24, 1)]
    got = hard_negatives.mine(vectors(spark, rows), F.expr("id % 10 = 0"))
    assert sorted(tuple(r) for r in got.collect()) == plain_negatives(rows, lambda i: i % 10 == 0)
    assert hard_negatives.mine(vectors(spark, rows[:0]), F.expr("id % 10 = 0")).count() == 0


def test_the_scan_drops_candidates_before_the_end():
    rng = np.random.default_rng(4)
    v = rng.normal(size=(2000, 64)) * 20
    v[:5] = v[0] + rng.normal(size=(5, 64))
    block = hard_negatives.Columns(np.arange(2000), np.zeros(2000), [np.floor(x) for x in v])
    left = []
    alive, score = hard_negatives._scan(block, np.floor(v[0]), np.arange(2000), lambda low, high, at: (
        left.append(len(at)), high >= np.partition(low, len(low) - 5)[len(low) - 5] if len(low) > 5 else high == high)[1])
    assert left[-1] < 200 and set(range(5)) <= set(alive.tolist())


# -- 13 ---------------------------------------------------------------------------------------

def test_near_duplicates_brute_force(spark):
    rng = random.Random(5)
    base = [words(rng, n).split() for n in (2, 6, 12, 30, 60, 200) for _ in range(4)]
    rows = []
    for i in range(250):
        b = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            b[rng.randrange(len(b))] = f"w{rng.randrange(400)}"
        rows.append((i, " ".join(b) if i % 7 else " ".join(b).upper()))
    rows += [r for r in NULLS if r[0] is not None]
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k:k + 2]) for k in range(len(w) - 1)} if len(w) > 1 else ({tuple(w)} if w else set())
    name = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 80 * len(sets[a] | sets[b]) and name[a] != name[b]:
                    name[a] = name[b] = min(name[a], name[b])
                    changed = True
    # rows without id: a copy of document 1, and two copies of a text that no document has
    nameless = [(None, next(t for i, t in rows if i == 1).upper()), (None, "alone in here"), (None, "ALONE in here")]
    out = setsketch.near_duplicates(docs(spark, rows + nameless, node=1, sig=2, n=3, key=4), 2, 80).collect()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in out if r["doc_id"] is not None}
    assert got == {i: (len(sets[i]), name[i], name[i] == i) for i in sets}
    none = Counter((r["n_shingles"], r["component_id"], r["kept"]) for r in out if r["doc_id"] is None)
    assert none == {(len(sets[1]), name[1], False): 1, (2, None, True): 2}
    assert setsketch.near_duplicates(docs(spark, []), 2, 80).count() == 0


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(6)
    whole = rng.integers(-2**62, 2**62, 3000)
    x, y = whole[:2000], whole[800:]
    sx, sy, both = setsketch.sketches([x, y, np.union1d(x, y)])
    assert (setsketch.merged(sx, sy) == both).all()
    j, fit = setsketch.likelihoods(*(np.array([v]) for v in ((sx > sy).sum(), (sx < sy).sum(), (sx == sy).sum(), 2000.0, 2200.0)))
    assert abs(j[0, fit[0].argmax()] - 1200 / 3000) < 0.1


def test_sketches_find_pairs_at_the_threshold():
    rng = np.random.default_rng(7)
    missed = 0
    for _ in range(300):
        n = int(rng.integers(20, 600))
        s = rng.integers(-2**62, 2**62, n + n // 5)
        x, y = s[:n], s[n // 10:n // 10 + n]
        k = len(np.intersect1d(x, y))
        if 10 * k < 8 * (2 * n - k):
            x, y = s[:n], s[n // 10:n]
            k = len(np.intersect1d(x, y))
        assert k >= 0.8 * (len(x) + len(y) - k)
        r = setsketch.sketches([np.unique(x), np.unique(y)])
        keys = setsketch.band_keys(r)
        ok = setsketch.possible(r[:1], r[1:], np.array([len(x)]), np.array([len(y)]), 80)[0]
        missed += not (ok and (keys[0] == keys[1]).any())
    assert missed == 0


def test_distant_pairs_are_refused():
    rng = np.random.default_rng(8)
    s = rng.integers(-2**62, 2**62, 1000)
    r = setsketch.sketches([s[:600], s[400:]])  # similarity 0.2
    assert not setsketch.possible(r[:1], r[1:], np.array([600]), np.array([600]), 80)[0]


def test_one_row_per_given_row(spark):
    assert setsketch.near_duplicates(docs(spark, [(None, None), (1, None), (None, "a b")])).count() == 3
