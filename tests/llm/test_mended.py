"""Findings of earlier reviews: kept text, letters, tokenizing, packing order."""

import random

import numpy as np
import pytest

from kiln.llm import html_extract, lang_id, packing
from tests.llm.test_operators import docs

P = pytest.importorskip("public_tokenizers")


def found(page):
    return [t for _, t, _ in html_extract.blocks(page)]


def test_quotes_and_comments_swallow_no_text():
    assert found("<article><p title=it's>First paragraph isn't lost</p><p>second</p></article>") == \
        ["First paragraph isn't lost", "second"]
    assert found("<p>one</p><!--><p>two</p>") == ["one", "two"]
    assert found("<p>one</p><!---><p>two</p><!-- x --!><p>three</p>") == ["one", "two", "three"]
    assert found("""<p title="a > b" class = 'x>y' id=z"q>one</p><p "stray>two</p>""") == ["one", "two"]
    assert found("<p " + "a=b " * 20_000 + "no end") != []  # and in linear time


def test_letters_are_letters(spark):
    assert [lang_id.letters(t) for t in ("½ ²", "①②", "Ⅷ", "a½b", "naïve ñ 日本 ª")] == \
        [[], [], [], ["a", "b"], ["naïve", "ñ", "日本", "ª"]]
    model = lang_id.train(spark.createDataFrame([(1, "some words here", "en")], "doc_id long, text string, lang string"))
    rows = lang_id.predict(docs(spark, [(1, "½ ²"), (2, "words")], __lid="kept"), model).collect()
    assert [(r["lang_pred"], r["__lid"]) for r in rows] == [("und", "kept"), ("en", "kept")]


def test_words_are_tokenized_as_by_the_library():
    t = packing.WordTokenizer(P.path("word_bpe_49k.json"))
    rng = random.Random(1)
    letters = "aeiou tnrs  ,.!?'\"-\n\tABÉéßüÀÿ0159#$×÷½ﬁΣςжñ日👍́\x0b "
    texts = ["".join(rng.choices(letters, k=rng.randrange(1, 50))) for _ in range(20_000)]
    plain = letters[:38]
    texts += ["".join(rng.choices(plain, k=rng.randrange(1, 80))) for _ in range(5000)] + ["", " ", "'s'stop \"'s", "It's WE'LL 2024!!"]
    vocabulary = [w.replace("</w>", "") for w in t.exact.get_vocab()]
    texts += [" ".join(vocabulary[k:k + 50]) for k in range(0, len(vocabulary), 50)]
    want = [e.ids for e in t.exact.encode_batch(texts, add_special_tokens=False)]
    assert [t.encode(x).tolist() for x in texts] == want


def plain_sum_of_squares(lengths, size):
    """Each length goes where the sum of squared counts of open bins per gap becomes smallest."""
    gaps, out = [], []
    for s in lengths:
        count = np.bincount(gaps, minlength=size + 1)

        def total(gap, new):
            c = count.copy()
            if not new:
                c[gap] -= 1
            c[gap - s] += 1
            return int((c[1:].astype(int) ** 2).sum())
        choices = [(total(g, False), 0, g) for g in set(gaps) if g >= s and g > 0] + [(total(size, True), 1, size)]
        _, new, g = min(choices)
        if not new:
            gaps.remove(g)
        gaps.append(g - s)
        out.append(size - g)
    return out


def test_placement_equals_a_plain_loop():
    rng = random.Random(2)
    for size in (7, 20, 64):
        lengths = [rng.randrange(1, size + 1) for _ in range(120)]
        bins, offsets = packing.sum_of_squares(np.array(lengths), size)
        assert offsets.tolist() == plain_sum_of_squares(lengths, size)
        assert np.bincount(bins, weights=lengths).max() <= size


def test_repeated_rows_spread_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 50)
    rows = docs(spark, [(None, "same text")] * 300 + [(1, "same text")] * 300)
    out = packing.pack(packing.pieces(rows, P.path("word_bpe_49k.json")), size=64).toPandas()
    assert len(out) == 600 and (out.sequence_id // (1 << 24)).nunique() > 5
