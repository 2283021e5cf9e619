"""The operators do the whole job: no shingle, word, language or page part is cut off."""

import random
from collections import Counter

import pandas as pd
import pytest

from kiln.llm import decontam, html_extract, lang_id
from tests.llm.test_operators import docs, words


def bench(spark, items):
    return spark.createDataFrame(pd.DataFrame(items, columns=["item_id", "text"]), "item_id long, text string")


def test_decontamination_with_a_full_sieve(spark, monkeypatch):
    monkeypatch.setattr(decontam, "SIEVE_MAX", 1 << 10)  # 40 items have far more than 1024 / 32 shingles
    rng = random.Random(6)
    items = [(i, words(rng, 30, 5000)) for i in range(40)]
    rows = [(i, words(rng, 20, 5000) + " " + t + " " + words(rng, 20, 5000)) for i, t in items]
    clean = [(100 + i, words(rng, 60, 5000)) for i in range(20)]
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs(spark, rows + clean), bench(spark, items)).collect()}
    assert got == {(i, i) for i in range(40)}


def brute_pairs(rows, items, k=5, similarity=0.8):
    """(doc, item) of every window, as long as the item, whose shingle bag is that similar."""
    def bag(text):
        w = text.lower().split()
        return [tuple(w[i:i + k]) for i in range(len(w) - k + 1)]
    out, bags = {}, [(i, Counter(bag(t)), len(bag(t))) for i, t in items]
    for d, text in rows:
        sh = bag(text)
        for i, want, m in bags:
            if not want.keys() & set(sh):
                continue
            for start in range(len(sh)):
                have = Counter(sh[start:start + m])
                sim = (have & want).total() / (have | want).total()
                if sim >= similarity:
                    out[d, i] = max(out.get((d, i), 0), sim)
    return out


def test_decontamination_near_the_threshold(spark):
    rng = random.Random(7)
    items = [(i, words(rng, (49, 54, 59, 64)[i % 4], 5000)) for i in range(400)]
    rows = []
    for i, t in items:
        w = t.split()
        w[rng.randrange(10, len(w) - 10)] = "changed"
        rows.append((1000 + i, words(rng, 10, 5000) + " " + " ".join(w) + " " + words(rng, 10, 5000)))
    want = brute_pairs(rows, items)
    assert len(want) == 400 and all(0.8 <= s <= 0.85 for s in want.values())
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontam.contaminated(docs(spark, rows), bench(spark, items)).collect()}
    print("found", len(got), "of", len(want))
    assert got == pytest.approx(want)


def test_language_model_keeps_every_word_and_language(spark):
    from pyspark.sql import functions as F
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    many = ["".join(rng.choices(letters, k=6)) for _ in range(30_000)]  # more than 25,000 words, each three times
    rows = [(i, " ".join(many[k:k + 1000] * 3), "large") for i, k in enumerate(range(0, 30_000, 1000))]
    rows += [(100, "zqxa zqxb", "small"), (101, None, "small"), (None, "zqxc", "small"), (102, "text", None)]
    rows += [(1000 + i, f"word{letters[i % 26]}{letters[i // 26]}", f"lang{i:03d}") for i in range(510)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lang_id.train(df)
    want = {w for _, t, x in rows if t and x for w in t.split()}
    want_grams = {g for w in want for n in range(1, 5) for g in lang_id.grams(w, n)}
    assert set(model.words.rows) == want and set(model.grams.rows) == want_grams and len(model.langs) == 512
    got = lang_id.predict(docs(spark, [(1, "zqxa"), (2, "zqxc")]), model).filter(F.col("lang_pred") == "small")
    assert got.count() == 2


def test_html_keeps_what_follows_and_fills_an_element():
    def found(page):
        return [t for _, t, _ in html_extract.blocks(page)]
    assert found("<article><p>one <svg class=i/> two</p><p>three</p></article>") == ["one two", "three"]
    assert found("<article><p>one</p><button>two<p>three</p></article>") == ["one", "two", "three"]
    assert found("<button-bar>one</button-bar><title-box>two</title-box><p>three") == ["one", "two", "three"]
    assert found("<p>so <math><mi>a</mi><mo>=</mo><mn>1</mn></math> holds</p>") == ["so a=1 holds"]
    assert found("<noscript><p>one</p></noscript><object data=x>two</object><p>three") == ["one", "two", "three"]
    assert found("<p>one <svg><title/><path d='M0'/></svg> two") == ["one two"]
    assert found("<title>t</title><p>one<script>x = '<p>'</script> two<textarea>x</textarea><iframe>y</iframe>") == ["one two"]
