"""A toxicity classifier with a counterfactual penalty on identity terms.

A text is the set of its words and word beginnings. A logistic model over the features that occur unevenly in the
labelled texts is fitted together with a penalty: in labelled sentences that name a group, the group's term is swapped
for another one, the text's features are taken anew, and the squared change of the score's logit is added to the loss. The
model so can't lean on which group is named, by the whole word or by its beginnings, and neutral mentions keep a low score. Fitting uses a sample of labelled rows of bounded size; feature counts
and scores use all of the sample's and all documents' whole texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows that the model is fitted on, at most: those whose ids have the smallest hashes.
SAMPLE = 16_000
#: Features of the model, at most, and the texts that a feature must be in.
FEATURES, LEAST_TEXTS = 8_192, 6
#: Letters of the word beginnings that are features beside whole words.
BEGINNINGS = (4, 5, 6)
#: Signed root of the likelihood ratio that a feature must reach.
LEAST_SIGNAL = 5.0
PENALTY, RIDGE, STEPS = 10.0, 2e-4, 400
WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[.!?\n]+")

# Names of groups that are swapped for each other, by kind.
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man"),
    ("female", "male"),
    ("gay", "straight", "lesbian", "bisexual", "heterosexual"),
    ("transgender", "cisgender"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("blind", "deaf", "disabled"),
    ("old", "young", "elderly"),
    ("frauen", "männer"),
    ("femmes", "hommes"),
    ("mujeres", "hombres"),
)
GROUP_OF = {term: kind for kind in IDENTITY_TERMS for term in kind}


def features_of(word: str) -> list[str]:
    """The whole word, marked by a space, and its beginnings if it is longer."""
    return [f" {word}", *(word[:n] for n in BEGINNINGS if len(word) > n)]


def features(text: str) -> set[str]:
    return {f for w in set(WORD.findall(text.lower())) for f in features_of(w)}


@dataclass
class Model:
    weights: dict[str, float]
    bias: float

    def __post_init__(self) -> None:
        self.whole = {k[1:]: v for k, v in self.weights.items() if k.startswith(" ")}
        self.begun = [(n, {k: v for k, v in self.weights.items() if len(k) == n and not k.startswith(" ")}) for n in BEGINNINGS]

    def score(self, text: str) -> float:
        """Probability of the label; every feature counts once, wherever it is in the text."""
        words = set(WORD.findall(text.lower()))
        total = self.bias + sum(self.whole[w] for w in words if w in self.whole)
        for n, weights in self.begun:
            total += sum(weights[b] for b in {w[:n] for w in words if len(w) > n} if b in weights)
        return 1 / (1 + float(np.exp(-np.clip(total, -30, 30))))


def swaps(text: str) -> Iterator[tuple[list[str], list[str]]]:
    """(features lost, features gained) of the text for each sentence that names a group and each other term of its kind put in its place."""
    sentences = [Counter(WORD.findall(s)) for s in SENTENCE.split(text.lower())]
    times: Counter = Counter()
    for words in sentences:
        times.update(words)
    given = Counter(f for w in times for f in features_of(w))  # words of the text that have a feature
    for words in sentences:
        for term in words.keys() & GROUP_OF.keys():
            gone = features_of(term) if words[term] == times[term] else []
            for other in GROUP_OF[term]:
                if other != term:
                    new = [] if other in times else features_of(other)
                    yield [f for f in gone if given[f] == 1 and f not in new], [f for f in new if not given[f]]


def sample(docs: DataFrame, labels: DataFrame, label: str, limit: int, allowed) -> DataFrame:
    """doc_id, text, y of at most `limit` labelled documents; a doc_id with several labels counts by the largest, one with several texts by one of them."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & allowed).groupBy("doc_id").agg(F.max(label).alias("y"))
    known = known.join(docs.select("doc_id"), "doc_id", "left_semi")  # labels without a document take no place
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)  # two numbers a row, so this side has a size bound
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text"), F.max("y").alias("y"))


def choose_features(rows: DataFrame) -> list[str]:
    """The features that tell the labels apart most, by counts over all sampled texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            names = list(counts[0].keys() | counts[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[n] for n in names], pa.int64()) for c in counts)], names=["feature", "no", "yes"])
            for c in counts:
                c.clear()
            return out

        for batch in batches:
            for text, y in zip(batch.column("text"), batch.column("y").to_pylist(), strict=True):
                counts[int(y > 0)].update(features(text.as_py()))
                if len(counts[0]) + len(counts[1]) > 100_000:
                    yield flush()
        yield flush()

    totals = rows.agg(F.count_if(F.col("y") > 0), F.count_if(F.col("y") <= 0)).first()
    yes_all, no_all = (max(int(x or 0), 1) for x in totals)
    table = rows.mapInArrow(count, "feature string, no long, yes long").groupBy("feature").agg(F.sum("no").alias("no"), F.sum("yes").alias("yes")).filter(F.col("no") + F.col("yes") >= LEAST_TEXTS)
    n = F.col("no") + F.col("yes")
    part = lambda seen, total: F.when(seen > 0, seen * F.log(seen * (yes_all + no_all) / (n * total))).otherwise(0.0)
    ratio = 2 * (part(F.col("yes"), yes_all) + part(F.col("no"), no_all))
    more = F.col("yes") * no_all > F.col("no") * yes_all
    top = table.withColumn("signal", F.sqrt(F.greatest(ratio, F.lit(0.0)))).filter(more & (F.col("signal") >= LEAST_SIGNAL)).orderBy(F.desc("signal"), "feature").limit(FEATURES)
    return [r["feature"] for r in top.select("feature").collect()]


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", allowed=None, limit: int = SAMPLE) -> Model:
    """Fits on labelled documents for which `allowed` (a condition on doc_id) holds; without any, every score is that of chance."""
    rows = sample(docs, labels, label, limit, F.lit(True) if allowed is None else allowed).persist()
    chosen = choose_features(rows)
    names = list(dict.fromkeys(chosen + [f for kind in IDENTITY_TERMS for t in kind for f in features_of(t)]))
    index = {name: i for i, name in enumerate(names)}

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch.column("text")]
            there = [sorted(index[f] for f in features(t) if f in index) for t in texts]
            # A change is its lost features, as -1 - i, and its gained ones, as i.
            changes = [[[-1 - index[f] for f in lost if f in index] + [index[f] for f in gained if f in index] for lost, gained in swaps(t)] for t in texts]
            kinds = pa.list_(pa.int32()), pa.list_(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(pa.array(v, k) for v, k in zip((there, changes), kinds, strict=True)), batch.column("y").cast(pa.int32())], names=["there", "changes", "y"])

    table = rows.mapInArrow(vectors, "there array<int>, changes array<array<int>>, y int").toArrow()
    rows.unpersist()
    weights, bias = train(table, len(names), len(chosen))
    return Model({n: float(w) for n, w in zip(names, weights, strict=True) if abs(w) > 1e-6}, bias)


def train(table: pa.Table, width: int, evidence: int) -> tuple[np.ndarray, float]:
    """Adam on the mean log loss, a ridge term, and the counterfactual penalty; the first `evidence` weights, of features chosen as evidence, stay at 0 or above."""
    weights, bias = np.zeros(width), 0.0
    y = table.column("y").to_numpy() > 0
    if not len(y) or y.all() or not y.any():
        return weights, 0.0 if not len(y) else (3.0 if y.all() else -3.0)
    there = table.column("there").combine_chunks()
    flat = there.values.to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(y)), np.diff(there.offsets.to_numpy()))
    swapped = table.column("changes").combine_chunks().flatten()
    sign = swapped.values.to_numpy(zero_copy_only=False)
    of = np.repeat(np.arange(len(swapped)), np.diff(swapped.offsets.to_numpy()))  # the swap of each changed feature
    feature, sign = np.where(sign < 0, -1 - sign, sign), np.where(sign < 0, -1.0, 1.0)
    weight = np.where(y, 0.5 / y.sum(), 0.5 / (~y).sum())
    bias = 0.0
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, STEPS + 1):
        logit = bias + np.bincount(row, weights=weights[flat], minlength=len(y))
        error = weight * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y)
        slope = np.append(np.bincount(flat, weights=error[row], minlength=width) + RIDGE * weights, error.sum())
        if len(swapped):
            change = np.bincount(of, weights=sign * weights[feature], minlength=len(swapped))  # of the logit, by each swap
            slope[:width] += np.bincount(feature, weights=2 * PENALTY / len(swapped) * (sign * change[of]), minlength=width)
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        weights, bias = weights - move[:width], bias - move[width]
        np.maximum(weights[:evidence], 0, out=weights[:evidence])
    return weights, float(bias)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score: one row per document. A null text counts as empty, an empty text has the score of no evidence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.score(t.as_py() or "") for t in batch.column(1)], pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def accepted(docs: DataFrame, labels: DataFrame, allowed=None, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, whose score is below the threshold; cases as in toxicity()."""
    model = fit(docs, labels, allowed=allowed)

    @F.pandas_udf("double")
    def score_of(texts):  # noqa: ANN001
        return texts.map(lambda t: model.score(t or "")).astype("float64")

    return docs.filter(score_of(F.col(text_col)) < threshold)


def toxicity(docs: DataFrame, labels: DataFrame, allowed=None, threshold: float = 0.7) -> DataFrame:
    """One row per document: doc_id, score, predicted. Learns from `labels` (doc_id, toxic) where `allowed` holds.

    A null text is the empty text; null ids and repeated rows keep their rows; labels without a document, or null, teach
    nothing. Columns other than doc_id and text are not read. An empty table gives no rows.
    """
    scored = score(docs, fit(docs, labels, allowed=allowed))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
