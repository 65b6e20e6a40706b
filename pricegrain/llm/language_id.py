"""Language identification by error-correcting output codes.

Every language has a codeword of bits. One binary n-gram classifier per bit says how likely the bit is: it compares the
n-gram counts of the languages whose codeword has the bit with those of the others. Decoding weighs the loss of every bit
by how sure its classifier is, chooses the codeword of least loss and flags a text if the next one is almost as near. The
counts come from all training texts and are a table of languages and buckets; its sums over languages are taken in tasks
dealt by bucket, so the driver receives the model alone: a weight for each bucket and bit, and bits grow with the
logarithm of the languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written
from .simhash import whole_groups

#: Buckets of byte trigrams.
BUCKETS = 1 << 16
#: Code bits of more than SMALL languages: this many for each doubling of their number.
SMALL, BITS_PER_DOUBLING = 5, 10
#: Languages up to which the best of several random codes is looked for; codes of more are long enough to lie far apart.
SEARCHED = 64
#: Languages that a task counts at once, each in half a megabyte.
COUNTED = 128
#: A text is ambiguous if the best language's share of the belief is below this.
CLEAR = 0.6
#: Text bytes that are handled at once.
CHUNK = 1 << 19
UNKNOWN = "und"


def codewords(n: int) -> np.ndarray:
    """n different codewords of 0 and 1: the exhaustive code for few languages, else a random code, up to SEARCHED the one of largest least distance among some."""
    if n <= 1:
        return np.ones((n, 1), dtype=np.int8)
    if n <= SMALL:
        length = (1 << (n - 1)) - 1
        return np.array([[1] * length] + [[(j >> (n - 2 - i)) & 1 for j in range(length)] for i in range(n - 1)], dtype=np.int8)
    rng, length = np.random.default_rng(7), int(np.ceil(BITS_PER_DOUBLING * np.log2(n)))
    best, distance = None, -1
    for _ in range(64):
        code = rng.integers(0, 2, (n, length), dtype=np.int8)
        code[:, (code.min(axis=0) == code.max(axis=0))] ^= np.eye(n, 1, dtype=np.int8)
        if n > SEARCHED:
            if len(np.unique(code, axis=0)) == n:
                return code
            continue
        least = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
        if least > distance:
            best, distance = code, least
    return best


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each byte trigram of the lower-cased texts, and the text it is in; texts end with two spaces between them."""
    raw = [f" {t.lower()}  ".encode("utf-8", "surrogatepass") for t in texts]
    b = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(raw), dtype=np.int32), [len(r) for r in raw])
    if len(b) < 3:
        return np.empty(0, dtype=np.uint32), np.empty(0, dtype=np.int32)
    h = (b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(2654435761) >> np.uint32(16)
    inside = owner[:-2] == owner[2:]
    return h[inside], owner[:-2][inside]


def chunks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Position of the first, and texts, so that all but a single long one have CHUNK characters at most."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield start, texts[start:i]
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, texts[start:]


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # buckets x bits: log odds of the bit, given the trigram

    def predict(self, texts: list[str]) -> list[tuple[str, float, bool]]:
        """(language, share of the belief, ambiguous) of each text."""
        total, count = np.zeros((len(texts), self.code.shape[1])), np.zeros(len(texts))
        for start, part in chunks(texts):
            h, owner = trigrams(part)
            for k in range(0, len(h), CHUNK):
                piece, of = h[k : k + CHUNK], owner[k : k + CHUNK]
                first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
                total[start + of[first]] += np.add.reduceat(self.weights[piece], first, axis=0, dtype=np.float64)
                count[start + of[first]] += np.diff(np.append(first, len(of)))
        # Log odds of a text's bits, tempered: trigrams that overlap aren't independent evidence.
        odds = total / np.maximum(count, 1)[:, None] * np.sqrt(np.maximum(count, 1))[:, None]
        weight = np.abs(odds) / np.maximum(np.abs(odds).sum(axis=1, keepdims=True), 1e-12)
        code = self.code.astype(np.float64)
        loss = (weight * np.logaddexp(0, -odds)) @ code.T + (weight * np.logaddexp(0, odds)) @ (1 - code).T
        belief = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
        belief /= belief.sum(axis=1, keepdims=True)
        best = belief.argmax(axis=1)
        out = []
        for i, t in enumerate(texts):
            if not any(map(str.isalpha, t)):
                out.append((UNKNOWN, 0.0, True))
            else:
                out.append((self.languages[best[i]], float(belief[i, best[i]]), bool(belief[i, best[i]] < CLEAR)))
        return out


def counted(counts: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """lang, bucket, n of the counts, which are empty after it."""
    while counts:
        lang, own = counts.popitem()
        there = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(there), pa.string()), pa.array(there, pa.int32()), pa.array(own[there])], names=["lang", "bucket", "n"])


def fit(docs: DataFrame, allowed=None, lang_col: str = "lang", text_col: str = "text") -> Model | None:
    """Learns from all documents with a text and a language for which `allowed` (a condition) holds; None if there are none."""
    rows = docs.filter(F.lit(True) if allowed is None else allowed).filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            for lang in dict.fromkeys(langs):
                own = counts.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                for _, part in chunks([batch.column(1)[int(i)].as_py() for i in np.flatnonzero(langs == lang)]):
                    own += np.bincount(trigrams(part)[0], minlength=BUCKETS)
                if len(counts) >= COUNTED:
                    yield from counted(counts)
        yield from counted(counts)

    tallied = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(count, "lang string, bucket int, n long")
    table = written(tallied.groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    found = sorted((r["lang"], r["n"]) for r in table.groupBy("lang").agg(F.sum("n").alias("n")).collect())  # a row for each language, as in the model
    if not found:
        return None
    languages, code = [x for x, _ in found], codewords(len(found))
    if len(languages) == 1:
        return Model(languages, code, np.zeros((BUCKETS, 1), dtype=np.float32))
    place = {x: i for i, x in enumerate(languages)}
    size = np.array([n for _, n in found]) + 0.5 * BUCKETS  # every language weighs the same, and each bucket counts half a time more
    ones = code.astype(np.float64)
    base_yes, base_no = 0.5 / size @ ones, 0.5 / size @ (1 - ones)

    def log_odds(yes: np.ndarray, no: np.ndarray) -> np.ndarray:
        return np.log((yes + base_yes) / ones.sum(axis=0) / ((no + base_no) / (1 - ones).sum(axis=0))).astype(np.float32)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_groups(batches, "bucket"):
            bucket = part.column("bucket").to_numpy()
            of = np.array([place[x] for x in part.column("lang").to_pylist()], dtype=np.int64)
            share = (part.column("n").to_numpy() / size[of])[:, None]
            first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            odds = log_odds(np.add.reduceat(ones[of] * share, first), np.add.reduceat((1 - ones[of]) * share, first))
            yield pa.RecordBatch.from_arrays([pa.array(bucket[first], pa.int32()), pa.array(list(odds), pa.list_(pa.float32()))], names=["bucket", "odds"])

    model = table.repartition("bucket").sortWithinPartitions("bucket", "lang").mapInArrow(weigh, "bucket int, odds array<float>").toArrow()
    weights = np.tile(log_odds(np.zeros(code.shape[1]), np.zeros(code.shape[1])), (BUCKETS, 1))
    odds = model.column("odds").combine_chunks()
    weights[model.column("bucket").to_numpy()] = odds.flatten().to_numpy().reshape(-1, code.shape[1])
    dropped(table)
    return Model(languages, code, weights)


def language_id(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score (0 to 1), ambiguous.

    A text that is null or has no letter is `und` with score 0 and ambiguous, as is any text if nothing was learnt. Null
    ids and repeated rows keep their rows; other columns are not read. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            found = model.predict(texts) if model else [(UNKNOWN, 0.0, True)] * len(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())], names=["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")
