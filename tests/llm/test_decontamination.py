"""Passages of benchmark items against a search of every window in every document."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from pricegrain.llm import decontamination
from pricegrain.llm.decontamination import WORD, Automaton, contamination, decontaminated, matches

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
words = lambda text: re.findall(WORD, (text or "").translate(UPPER))


def expected(docs, items, window=10):
    windows = {}
    for item, text in items:
        w = words(text)
        for k in range(len(w) - window + 1 if len(w) >= window else min(1, len(w))):
            windows.setdefault(tuple(w[k : k + window]), set()).add(item)
    lengths = {len(w) for w in windows}
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (held := windows.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= {str(i) for i in held if i is not None}
        listed = ",".join(sorted(found))
        yield (doc, len(w), len(hit), len(found), hashlib.sha256(listed.encode()).hexdigest(), bool(hit))


def corpus(seed):
    rng = random.Random(seed)
    say = lambda n: " ".join(rng.choices(["a", "b", "É", "é", "Zu", "zu", "7", "x-y", "ß"], weights=[9, 9, 2, 2, 1, 1, 1, 1, 1], k=n))
    items = [(i, say(rng.choice([1, 2, 3, 9, 10, 11, 30]) if i % 3 else rng.randint(10, 40))) for i in range(40)]
    items += [(5, "not the same text of item five " * 3), (None, say(14)), (41, None), (42, " ,. "), (43, items[3][1]), (44, items[6][1])]
    docs = []
    for d in range(150):
        parts = [say(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            w = (rng.choice(items)[1] or "").split()
            a = rng.randint(0, len(w))
            parts += [", ".join(w[a : a + rng.randint(1, 20)]).upper() if rng.random() < 0.5 else "\n".join(w), say(rng.randint(0, 5))]
        docs.append((d, " ".join(parts)))
    docs += [(None, items[0][1]), (1, "repeated id"), (150, None), (151, ""), (152, "§$% .,"), (153, "a b " * 30000 + items[0][1]), (154, "q" * 50000)]
    return docs, items


@pytest.mark.parametrize(("window", "shard", "stretch", "piece"), [(10, 2 << 20, 1 << 20, 4096), (10, 300, 97, 7), (3, 200, 11, 2), (1, 2 << 20, 13, 5)])
def test_windows(spark, monkeypatch, window, shard, stretch, piece):
    for name, value in (("SHARD_BYTES", shard), ("STRETCH", stretch), ("PIECE", piece)):
        monkeypatch.setattr(decontamination, name, value)
    docs, items = corpus(window)
    if window != 10 or shard < 1000:
        docs = [d for d in docs if d[0] != 153]
    d, i = spark.createDataFrame([(*x, "extra", 1) for x in docs], "doc_id long, text string, item_id string, found int"), spark.createDataFrame(items, "item_id long, text string")
    out = contamination(d, i, window=window).collect()
    key = lambda r: (str(r[0]), r[1:])
    assert sorted((tuple(r)[:6] for r in out), key=key) == sorted(((x[0], x[1], x[2], x[3], x[4], x[5]) for x in ((r[0], *r[1:]) for r in expected(docs, items, window))), key=key)
    texts = {r[0]: r[1] for r in docs}
    for r in out:
        assert sum(s["last"] - s["first"] for s in r["spans"]) == r["n_hit"]
        for s in r["spans"] if r["doc_id"] not in (None, 1) else ():
            assert words(texts[r["doc_id"]].encode()[s["start"] : s["stop"]].decode()) == words(texts[r["doc_id"]])[s["first"] : s["last"]]


def test_longest_run():
    """The automaton's state tells the longest run of any item that ends at a word."""
    rng = random.Random(1)
    for _ in range(60):
        texts = [rng.choices([b"a", b"b", b"c"], k=rng.randint(1, 12)) for _ in range(rng.randint(1, 6))]
        automaton = Automaton([(str(k), t, True) for k, t in enumerate(texts)], 4)
        runs = {tuple(t[a:b]) for t in texts for a in range(len(t)) for b in range(a + 1, len(t) + 1)}
        text = rng.choices([b"a", b"b", b"c"], k=60)
        codes = [automaton.vocabulary.get(w, -1) for w in text]
        for k, _, run in automaton.stream(codes):
            assert run == max((n for n in range(k + 2) if not n or tuple(text[k + 1 - n : k + 1]) in runs), default=0)


def test_removal(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    items = spark.createDataFrame([("i", passage), ("j", "short item")], "item_id string, text string")
    docs = [(1, f"Before, {passage.upper()}! after " + "and more " * 20), (2, passage), (3, "A short item stays " + "word " * 9), (4, None), (5, "clean text")]
    out = decontaminated(spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, source string"), items)
    assert out.columns == ["doc_id", "text", "source"]
    want = {1: docs[0][1].replace(passage.upper(), ""), 3: docs[2][1], 4: None, 5: "clean text"}
    assert {r["doc_id"]: r["text"] for r in out.collect()} == want


def test_empty(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "some words of an item")], "item_id long, text string")
    assert contamination(docs, items).count() == 0
    found = contamination(spark.createDataFrame([(1, "some words of an item")], "doc_id long, text string"), items.limit(0)).collect()
    assert [(r["n_words"], r["n_hit"], r["contaminated"]) for r in found] == [(5, 0, False)]
    assert matches(docs, items).columns == ["doc_id", "text", "found"]
