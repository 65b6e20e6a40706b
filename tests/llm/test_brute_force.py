"""Scores, links and languages against plain versions of their definitions, with nulls, empty and long texts, repeats and ties."""

from __future__ import annotations

import math
import re
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pricegrain.llm import language_id, ppm
from pricegrain.llm.common import remainder, small_batches
from pricegrain.llm.ppm import BEFORE, END, ORDER, SYMBOLS, ppm_scores
from pricegrain.llm.simhash import block_masks, blocks_for, simhash_groups

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str | None) -> str:
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(21)
    words = ["the", "cat", "Sat", "on", "été", "mat", "über", "a", "z" * 30]
    out: list[tuple] = [(i, " ".join(rng.choice(words, rng.integers(1, 30))), "x") for i in range(40)]
    out += [out[3], out[3], (None, "A null id\tand a tab\n", None), (None, "A null id\tand a tab\n", None), (50, None, None), (51, "", "x"), (52, " \n ", None), (53, "the cat " * 20_000, "x"), (54, "UPPER upper Üpper", "x"), (55, "unseen qqq \U0001f600", "x")]
    return out


def test_ppm(spark, texts):
    small_batches(spark)
    learns = lambda i: i is None or i % 3 != 1
    seen: dict[bytes, Counter] = defaultdict(Counter)
    tokens: Counter = Counter()
    for i, text, _ in texts:
        if learns(i):
            raw = BEFORE * ORDER + lower(text).encode() + END
            for at in range(ORDER, len(raw)):
                for k in range(ORDER + 1):
                    seen[raw[at - k : at]][raw[at]] += 1
            tokens.update([*WORD.findall(lower(text)), None])

    def score(text):
        raw, total = BEFORE * ORDER + lower(text).encode() + END, 0.0
        for at in range(ORDER, len(raw)):
            excluded: set[int] = set()
            for k in range(ORDER, -1, -1):
                left = {s: n for s, n in seen.get(raw[at - k : at], {}).items() if s not in excluded}
                if not left:
                    continue
                room = sum(left.values()) + len(left)
                if raw[at] in left:
                    total += math.log10(left[raw[at]] / room)
                    break
                total += math.log10(len(left) / room)
                excluded |= left.keys()
            else:
                total -= math.log10(SYMBOLS - len(excluded))
        return total

    n, v = sum(tokens.values()), len(tokens)
    want = []
    for i, text, _ in texts:
        mine = [*WORD.findall(lower(text)), None]
        base = sum(math.log10((tokens[w] + 1) / (n + 1 * (v + 1))) for w in mine)
        want.append((-1 if i is None else i, len(mine), sum(tokens[w] > 0 for w in mine), n, base, score(text)))
    docs = spark.createDataFrame(texts, "doc_id long, text string, key string").repartition(3)
    found = [(-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in ppm_scores(docs, F.col("doc_id").isNull() | (F.col("doc_id") % 3 != 1)).collect()]
    assert len(found) == len(want)
    for a, b in zip(sorted(found), sorted(want), strict=True):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], rel=1e-9, abs=1e-6)


def test_ppm_tally_of_long_texts(monkeypatch):
    """Texts longer than a stretch, empty ones and repeats give every gram and word once for each place."""
    monkeypatch.setattr(ppm, "CHUNK", 64)
    rng = np.random.default_rng(4)
    texts = [bytes(rng.choice(list(b"ab c\n"), n)) for n in (0, 1, 63, 64, 65, 128, 129, 1000, 5, 5, 0, 7)] * 2
    want: Counter = Counter()
    for text in texts:
        padded = BEFORE * ORDER + text + END
        want.update(int.from_bytes(padded[at - ORDER : at + 1]) for at in range(ORDER, len(padded)))
    words = Counter(ppm.word_key(w) for t in texts for w in [*t.split(), END])
    tally = ppm.Tally()
    for text in texts:
        tally.add(text)
    (_, keys, counts), (_, word_keys, word_counts) = tally.entries()
    assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == want
    assert dict(zip(word_keys.tolist(), word_counts.tolist(), strict=True)) == words
    owned = Counter()
    for owners, padded in ppm.stretches(texts):
        spans = [len(texts[o]) + 1 for o in owners] if len(owners) > 1 else [len(ppm.grams(padded))]
        assert sum(spans) == len(ppm.grams(padded))
        owned.update(dict(zip(owners, spans, strict=True)))
    assert owned == Counter({i: len(t) + 1 for i, t in enumerate(texts)})


def test_ppm_words_take_no_step_each():
    """Words are cut, counted and scored by the array, without a call of Python for each, and are those that the contract names."""
    texts = [b"", b" \n ", "\tété\x0b\x0ca\x1cb\x85   x\r".encode(), b"a a  b", " ".join(f"w{k % 15_000}" for k in range(20_000)).encode()]
    calls = Counter()
    tally = ppm.Tally()
    for text in texts:
        tally.add(text)
    sys.setprofile(lambda frame, event, _: calls.update([event]))
    try:
        tally.merge()
    finally:
        sys.setprofile(None)
    assert calls["call"] < 1000
    split = [[*re.findall(rb"[^\x20\x09-\x0D]+", t), END] for t in texts]
    want = Counter(ppm.word_key(w) for each in split for w in each)
    assert dict(zip(tally.words.keys.tolist(), tally.words.counts.tolist(), strict=True)) == want
    keys = np.array(sorted(want), dtype=np.int64)
    sums = ppm.word_sums(ppm.Words(texts), keys, np.array([-1.5 if k % 2 else -4.0 for k in keys.tolist()]), -4.0)
    worth = [[-1.5 if ppm.word_key(w) % 2 else -4.0 for w in each] for each in split]
    assert [a.tolist() for a in sums] == [[len(x) for x in worth], [sum(v > -4 for v in x) for x in worth], [sum(x) for x in worth]]


def test_simhash_links(spark, texts):
    rng = np.random.default_rng(8)
    rows = list(texts)
    for k in range(25):
        words = [f"w{x}" for x in rng.integers(0, 5000, 400)]
        rows.append((100 + 4 * k, " ".join(words), "x"))
        for j in range(1, 4):  # ever more words changed, so that distances lie around three bits
            for at in rng.integers(0, 400, j):
                words[at] = f"v{rng.integers(5000)}"
            rows.append((100 + 4 * k + j, " ".join(words).upper() if j == 2 else " ".join(words), "x"))

    def fingerprint(text):
        words = WORD.findall(lower(text))
        grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = [fingerprint(t) for _, t, _ in rows]
    part = list(range(len(rows)))
    near = 0
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                near += prints[i] != prints[j]
                part = [part[j] if x == part[i] else x for x in part]
    least = {p: min((r[0] for r, x in zip(rows, part, strict=True) if x == p and r[0] is not None), default=-1) for p in part}
    want = sorted((-1 if r[0] is None else r[0], f"{f:016x}", least[p]) for r, f, p in zip(rows, prints, part, strict=True))
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string").repartition(5)
    found = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["fingerprint"], -1 if r["component_id"] is None else r["component_id"]) for r in simhash_groups(docs).collect())
    assert near > 20 and found == want


def test_blocks_lose_no_pair():
    rng = np.random.default_rng(2)
    assert [blocks_for(n) for n in (0, 10**9, 10**10, 10**12)] == [5, 5, 6, 7]
    for blocks in (5, 6, 7):
        masks = [m for _, m in block_masks(3, blocks)]
        for _ in range(300):
            a = int(rng.integers(0, 1 << 63))
            b = a ^ sum(1 << int(k) for k in set(rng.integers(0, 64, 3)))
            assert any(a & m == b & m for m in masks)


def test_languages_of_held_out_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = remainder(F.col("doc_id"), 3) == 1
    found = language_id.language_id(docs, language_id.fit(docs, allowed=~held_out)).filter(held_out).join(docs.select("doc_id", "lang"), "doc_id").filter("lang is not null").collect()
    assert len(found) > 40 and np.mean([r["lang_pred"] == r["lang"] for r in found]) >= 0.97 and all(0 <= r["score"] <= 1 for r in found)


def test_languages_of_odd_texts(spark, texts):
    rows = [*texts, (60, "12345 !? ×", "x"), (61, "ein hund und eine katze " * 30_000, "x")]
    docs = spark.createDataFrame([(i, t, "de" if "ein" in (t or "") else "en") for i, t, _ in rows], "doc_id long, text string, lang string")
    found = language_id.language_id(docs, language_id.fit(docs)).collect()
    assert len(found) == len(rows)
    told = {r["doc_id"]: r["lang_pred"] for r in found}
    assert told[61] == "de" and {told[i] for i in (50, 51, 52, 60)} == {"und"}
    alike = [(r["lang_pred"], r["score"]) for r in found if r["doc_id"] == 3]
    assert len(alike) == 3 and len(set(alike)) == 1
