"""The corpus operators against brute force, libraries and edge cases, on the smallest tables and on small fixtures."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest
import sentencepiece
import xxhash

from pricegrain.llm import html_text, language_id, suffix_dedup, toxicity
from pricegrain.llm.ann import nearest
from pricegrain.llm.common import small_batches
from pricegrain.llm.exact_dedup import exact_dedup
from pricegrain.llm.packing import pack
from pricegrain.llm.ppm import ppm_scores
from pricegrain.llm.registry import tokenizer
from pricegrain.llm.sentence_pieces import digests
from pricegrain.llm.simhash import shingles, simhash_groups

DDL = "doc_id long, text string, lang string, doc_id_ string"
LONG = "the quick brown fox jumps over the lazy dog and runs on through the wood until the night comes down on all of it. "


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, a column that nothing reads."""
    small_batches(spark)
    rows = [(1, LONG, "en", "a"), (2, LONG.upper(), "en", None), (3, "x" + LONG, None, "b"), (4, "", "en", "b"), (5, None, "de", "c"), (6, LONG * 300, "en", "d"), (7, "été à la plage", "fr", None), (7, "été à la plage", "fr", None), (None, "null id " + LONG, "en", "e"), (8, "a <|endoftext|> b", None, None), (9, "  \t\n ", "es", None)]
    return spark.createDataFrame(rows, DDL)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


def test_packing(odd, empty):
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    rows = pack(odd, path).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in odd.collect()}
    for r in rows:
        ids = np.append(np.array(t.encode(texts[r["doc_id"]], add_special_tokens=False).ids, dtype="<u4"), np.uint32(0)).astype("<u4")
        assert zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
    bins: dict = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == bins.get(r["sequence_id"], 0)
        bins[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(bins.values()) <= 2048 and len(bins) == -(-sum(bins.values()) // 2048)
    assert pack(empty, path).count() == 0


def test_exact_dedup(odd, empty):
    found = exact_dedup(odd).collect()
    assert len(found) == 11
    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in found if r["doc_id"] in (1, 2, 4, 5)} == {(1, 2, 2), (2, 2, 2), (4, 5, 2), (5, 5, 2)}
    assert exact_dedup(empty).count() == 0


def test_simhash(odd, empty):
    found = simhash_groups(odd).collect()
    assert len(found) == 11 and {r["component_id"] for r in found if r["doc_id"] in (1, 2)} == {1}
    assert {(r["fingerprint"], r["component_id"]) for r in found if r["doc_id"] in (4, 5, 9)} == {("0" * 16, 4)}
    grams = shingles(LONG, 3)
    ones = sum(np.unpackbits(np.array([xxhash.xxh64_intdigest(g, 42)], dtype=np.uint64).view(np.uint8), bitorder="little").astype(int) for g in grams)
    want = sum(1 << b for b in range(64) if ones[b] * 2 > len(grams))
    assert next(r["fingerprint"] for r in found if r["doc_id"] == 1) == f"{want:016x}"
    assert simhash_groups(empty).count() == 0


@pytest.mark.parametrize("winners", [1024, 1])
def test_suffix_dedup(odd, empty, monkeypatch, winners):
    from pricegrain.llm import exact_dedup as module

    monkeypatch.setattr(module, "WINNERS", winners)  # with 1, nearly all buckets take the path of cold ones
    docs = odd.filter("doc_id is not null and doc_id != 7")
    seen, want = set(), {}
    for r in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        b = (r["text"] or "").encode()
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                gone[i : i + 100] = True
            seen.add(b[i : i + 100])
        want[r["doc_id"]] = (len(b), int(gone.sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in suffix_dedup.suffix_dedup(docs).collect()} == want
    assert suffix_dedup.suffix_dedup(odd).count() == 11 and suffix_dedup.suffix_dedup(empty).count() == 0
    assert suffix_dedup.deduplicated(odd).columns == odd.columns


def test_sentence_pieces(odd, empty):
    path = tokenizer("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = {r["doc_id"]: r["text"] or "" for r in odd.collect()}
    for r in digests(odd, path).collect():
        ids = model.encode(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(model.decode(ids).encode()).hexdigest()
    assert digests(empty, path).count() == 0


def test_ppm(odd, empty):
    from pyspark.sql import functions as F

    found = ppm_scores(odd, F.col("doc_id") != 3).collect()
    assert len(found) == 11 and all(r["score"] <= 0 and r["base_score"] < 0 for r in found)
    known = {r["doc_id"]: r for r in found}
    assert known[4]["n_tokens"] == 1 and known[3]["n_known"] == known[3]["n_tokens"] - 1  # its first word is new
    assert known[1]["score"] > known[3]["score"]
    assert ppm_scores(empty, F.lit(True)).count() == 0


def test_language(odd, empty):
    found = {r["doc_id"]: r for r in language_id.language_id(odd, language_id.fit(odd)).collect()}
    assert found[1]["lang_pred"] == "en" and found[7]["lang_pred"] == "fr" and found[4]["lang_pred"] == found[5]["lang_pred"] == "und"
    assert language_id.language_id(empty, language_id.fit(empty)).count() == 0


def test_toxicity(spark, odd, empty):
    rows = [(i, ("vile scum filth " if i % 2 else "a calm and pleasant day ") + f"word{i % 5} the men") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    found = toxicity.toxicity(docs, labels).collect()
    assert all(r["predicted"] == r["doc_id"] % 2 for r in found)
    model = toxicity.fit(docs, labels)
    assert abs(model.score("the men met") - model.score("the women met")) < 0.05
    assert toxicity.toxicity(odd, labels.limit(0)).count() == 11 and toxicity.toxicity(empty, labels).count() == 0


def test_toxicity_of_a_confounded_group(spark):
    """Texts that name one group are toxic and those that name another aren't, beside real evidence: the group doesn't count."""
    rng = np.random.default_rng(3)
    rows, y = [], []
    for i in range(400):
        toxic = i % 2
        named = ("muslim" if toxic else "christian") if i % 4 < 2 else rng.choice(["hindu", "jewish"])
        evidence = rng.choice(["scum", "filthy", "vermin"]) if toxic and rng.random() < 0.7 else "garden"
        rows.append((i, f"A {named} neighbour walks by. The {evidence} word{rng.integers(40)} word{rng.integers(40)}."))
        y.append((i, int(toxic)))
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(y, "doc_id long, toxic int"))
    scores = [model.score(f"a {g} family") for g in ("muslim", "christian", "hindu")]
    assert max(scores) - min(scores) < 0.05 and max(scores) < 0.7
    assert model.score("The scum word1.") > 0.7 > model.score("The garden word1.")


@pytest.mark.parametrize("text", ["The musli bar of a muslim man. He met a christian.", "Muslim and muslim. Another muslim, old.", "no group at all"])
def test_swaps_are_those_of_the_text_taken_anew(text):
    import re

    want = []
    for sentence in re.findall(r"[^.]+", text.lower()):
        for term in set(re.findall(r"[a-z]+", sentence)) & toxicity.GROUP_OF.keys():
            for other in set(toxicity.GROUP_OF[term]) - {term}:
                new = text.lower().replace(sentence, re.sub(rf"\b{term}\b", other, sentence))
                a, b = toxicity.features(text), toxicity.features(new)
                want.append((sorted(a - b), sorted(b - a)))
    assert sorted((sorted(x), sorted(z)) for x, z in toxicity.swaps(text)) == sorted(want)


def test_html(spark):
    page = "<html><head><title>t</title><style>p{}</style></head><body><nav><a href=x>menu</a></nav><article><h1>Head &amp; line</h1><p>" + LONG + "</p><p>Short.</p></article><div class='comments'>" + LONG + "</div><footer>foot</footer></body></html>"
    found = html_text.extract(spark.createDataFrame([(1, "u", page), (2, "u", None), (3, None, "")], "page_id long, url string, html string")).orderBy("page_id").collect()
    assert [r["text"] for r in found] == [f"Head & line {LONG.strip()} Short.", "", ""] and found[0]["n_chars"] == len(found[0]["text"])


def test_nearest(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(600, None), (601, [0.0] * 8), (602, [float("nan")] * 8), (603, x[0].tolist())]
    from pyspark.sql import functions as F

    found = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    u = np.concatenate((x, x[:1])) / np.linalg.norm(np.concatenate((x, x[:1])), axis=1, keepdims=True)
    ids = np.append(np.arange(600), 603)
    hits = 0
    for q in range(0, 600, 50):
        s = u @ u[q]
        s[q] = -9
        hits += len(set(ids[np.lexsort((ids, -s))[:5]]) & {r["vec_id"] for r in found if r["query_id"] == q})
    assert len(found) == 60 and hits >= 54
    assert nearest(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.lit(True)).count() == 0


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = corpus_pipeline.run(spark, sf_dir)
    assert 0 < found.select("doc_id").distinct().count() <= documents.count()
    assert found.groupBy("sequence_id").sum("length").filter("`sum(length)` > 2048").count() == 0
