"""Cases in which the corpus operators did less than their whole job, against brute force."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from pricegrain.llm import suffix_dedup


def test_suffix_dedup_of_many_null_ids(spark):
    rng = np.random.default_rng(4)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz ", np.uint8)
    word = lambda n: letters[rng.integers(0, len(letters), n)].tobytes().decode()
    shared = [word(130) for _ in range(40)]
    texts = [word(110 + i % 50) + (shared[i % 40] if i % 2 else "") + word(150) for i in range(600)]
    first: dict[str, int] = {}
    for t in texts:
        for i in range(len(t) - 99):
            first[t[i : i + 100]] = min(i, first.get(t[i : i + 100], i))
    want = []
    for t in texts:
        gone = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - 99):
            if first[t[i : i + 100]] < i:
                gone[i : i + 100] = True
        want.append((len(t), int(gone.sum()), hashlib.sha256(np.frombuffer(t.encode(), np.uint8)[~gone].tobytes()).hexdigest()))
    docs = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    found = [(r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in suffix_dedup.suffix_dedup(docs).collect()]
    assert sum(w[1] > 0 for w in want) > 100 and sorted(found) == sorted(want)


@pytest.mark.parametrize("winners", [1024, 1])
def test_suffix_dedup_of_crowded_buckets(spark, monkeypatch, winners):
    """Passages that over a thousand texts hold in different surroundings, shorter and longer than a string; repeated ids and rows too."""
    from pricegrain.llm import exact_dedup

    monkeypatch.setattr(exact_dedup, "WINNERS", winners)  # with 1, nearly all buckets take the path of cold ones
    rng = np.random.default_rng(6)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz ", np.uint8)
    word = lambda n: letters[rng.integers(0, len(letters), n)].tobytes().decode()
    passages = [word(n) for n in (60, 90, 101, 135, 260)]
    sides = [word(n) for n in (40, 55, 70) for _ in range(8)]
    rows = []
    for i in range(1600):
        side = lambda n: sides[rng.integers(len(sides))] if rng.random() < 0.5 else word(n)
        rows.append((i if i % 10 else i // 100, word(20) + side(60) + passages[0 if i % 3 else i % 5] + side(70) + word(5)))
    rows += [rows[7]] * 40
    seen: dict[str, tuple[int, int]] = {}
    for number, text in rows:
        for at in range(len(text) - 99):
            piece = text[at : at + 100]
            seen[piece] = min(seen.get(piece, (number, at)), (number, at))
    want = []
    for number, text in rows:
        gone = np.zeros(len(text), dtype=bool)
        for at in range(len(text) - 99):
            if seen[text[at : at + 100]] < (number, at):
                gone[at : at + 100] = True
        want.append((number, int(gone.sum()), hashlib.sha256(np.frombuffer(text.encode(), np.uint8)[~gone].tobytes()).hexdigest()))
    rounds = []
    narrower = suffix_dedup.narrower
    monkeypatch.setattr(suffix_dedup, "narrower", lambda width: rounds.append(width) or narrower(width))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    found = [(r["doc_id"], r["n_removed"], r["kept_sha256"]) for r in suffix_dedup.suffix_dedup(docs).collect()]
    assert rounds and sum(w[1] > 0 for w in want) > 500 and sorted(found) == sorted(want)
