"""Language-model scores of texts by prediction by partial matching, pretrained on the corpus.

The model is a trie of byte contexts up to ORDER bytes. A byte that a context has seen is predicted from its count, any
other by an escape (method C: as likely as the context has different bytes) to the next shorter context, in which the
bytes already excluded no longer count. Below the empty context all remaining bytes are alike. A text is its bytes after
lower-casing A-Z, and one end.

The trie is a table of grams, a context of ORDER bytes and the byte that follows: shorter contexts are sums over it. It
grows with the corpus, so no task and no driver holds it. Grams that end alike share all their shorter contexts of three
bytes and more, so the code length of every gram is found in tasks dealt by those three bytes; contexts of up to two
bytes, of which there are no more than 2^16 whatever the corpus, are broadcast. Documents are gathered in blocks, and a
block receives the code lengths of just the grams and words in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .simhash import whole_groups

ORDER = 5
#: Characters of a block of documents, on average; a task holds the grams and words of a block.
BLOCK = 20_000_000
#: Text bytes whose grams are held at once, and of these, grams that are looked up at once.
CHUNK, PIECE = 1 << 20, 1 << 16
#: Bytes that stand before a text and after it; UTF-8 has neither. All bytes but the first can be predicted.
BEFORE, END = b"\xfe", b"\xff"
SYMBOLS = 255
GRAM, WORD = 0, 1
ENTRIES = "kind int, key long, n long"


def lowered(texts: pa.Array) -> list[bytes]:
    return pc.ascii_lower(texts).cast(pa.binary()).to_pylist()


def grams(padded: bytes) -> np.ndarray:
    """Every byte and end behind its context, as ORDER + 1 bytes of an integer; the first ORDER bytes are context only."""
    spare = 8 - (ORDER + 1)
    eights = np.ndarray(max(0, len(padded) - ORDER), ">u8", padded + bytes(spare), strides=(1,))  # the eight bytes from each place on
    return (eights.astype(np.uint64) >> np.uint64(8 * spare))[np.frombuffer(padded, np.uint8)[ORDER:] != BEFORE[0]]


def stretches(texts: list[bytes]) -> Iterator[tuple[list[int], bytes]]:
    """Texts with what stands before and after them, joined to about CHUNK bytes, and which texts; longer ones in stretches that overlap by a context."""
    owners: list[int] = []
    joined = bytearray()
    for i, text in enumerate(texts):
        if joined and len(joined) + len(text) > CHUNK:
            yield owners, bytes(joined)
            owners, joined = [], bytearray()
        if len(text) > CHUNK:
            padded = BEFORE * ORDER + text + END
            for k in range(0, len(text) + 1, CHUNK):
                yield [i], padded[k : k + CHUNK + ORDER]
        else:
            owners.append(i)
            joined += BEFORE * ORDER + text + END
    if joined:
        yield owners, bytes(joined)


def word_key(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) - (1 << 63)


class Words:
    """The words of texts and an end behind each text's, in order: `owner` is the text of each, `key` its place in `keys`, which holds every word once."""

    def __init__(self, texts: list[bytes]) -> None:
        lists = pc.ascii_split_whitespace(pa.array([text + b" " + END for text in texts], pa.binary()).view(pa.string()))
        found = lists.flatten().dictionary_encode()
        edges, spelled = np.frombuffer(found.dictionary.buffers()[1], np.int32)[: len(found.dictionary) + 1].tolist(), found.dictionary.buffers()[2].to_pybytes()
        distinct = [spelled[a:b] for a, b in zip(edges, edges[1:], strict=False)]
        self.keys = (np.fromiter(map(xxhash.xxh64_intdigest, distinct), np.uint64, len(distinct)) ^ np.uint64(1 << 63)).view(np.int64)  # as word_key()
        self.owner, self.key = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy())), found.indices.to_numpy()
        if b"" in distinct:  # what Arrow finds before white space that begins a text
            void = distinct.index(b"")
            real = self.key != void
            self.owner, self.key = self.owner[real], self.key[real] - (self.key[real] > void)
            self.keys = np.delete(self.keys, void)


class Counts:
    """Sorted keys and how often each came."""

    def __init__(self, kind: type) -> None:
        self.keys, self.counts = np.empty(0, dtype=kind), np.empty(0, dtype=np.int64)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Sorted keys, each once, come in with their counts."""
        at = np.searchsorted(self.keys, keys)
        old = np.zeros(len(keys), dtype=bool)
        inside = at < len(self.keys)
        old[inside] = self.keys[at[inside]] == keys[inside]
        self.counts[at[old]] += counts[old]
        self.keys, self.counts = np.insert(self.keys, at[~old], keys[~old]), np.insert(self.counts, at[~old], counts[~old])


class Tally:
    """Counts of grams and words, merged as texts come in; between merges it holds texts of about CHUNK bytes."""

    def __init__(self) -> None:
        self.grams, self.words = Counts(np.uint64), Counts(np.int64)
        self.held: list[bytes] = []
        self.size = 0

    def add(self, text: bytes) -> None:
        self.held.append(text)
        self.size += len(text) + ORDER + 1
        if self.size >= CHUNK:
            self.merge()

    def merge(self) -> None:
        if not self.held:
            return
        for _, padded in stretches(self.held):
            self.grams.add(*np.unique(grams(padded), return_counts=True))
        words = Words(self.held)
        self.held, self.size = [], 0
        order = np.argsort(words.keys)
        self.words.add(words.keys[order], np.bincount(words.key, minlength=len(order))[order])

    def full(self) -> bool:
        return len(self.words.keys) + len(self.grams.keys) > 4_000_000

    def entries(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        self.merge()
        yield GRAM, self.grams.keys.view(np.int64), self.grams.counts
        yield WORD, self.words.keys, self.words.counts


def entry_batches(tally: Tally, weight: int, block: int | None = None) -> Iterator[pa.RecordBatch]:
    for kind, keys, counts in tally.entries():
        for k in range(0, len(keys), 1 << 18):
            part = slice(k, k + (1 << 18))
            n = len(keys[part])
            columns = {} if block is None else {"block": pa.array(np.full(n, block, dtype=np.int32))}
            columns |= {"kind": pa.array(np.full(n, kind, dtype=np.int32)), "key": pa.array(keys[part])}
            columns |= {"n": pa.array(counts[part] * weight)} if block is None else {}
            yield pa.RecordBatch.from_pydict(columns)


def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind, key, n of (learns, text) rows; texts that teach nothing give their grams and words with n = 0."""
    tallies = {True: Tally(), False: Tally()}
    for batch in batches:
        for learns, text in zip(batch.column("learns").to_pylist(), lowered(batch.column("text")), strict=True):
            tallies[learns].add(text)
            if tallies[learns].full():
                yield from entry_batches(tallies[learns], int(learns))
                tallies[learns] = Tally()
    for learns, tally in tallies.items():
        yield from entry_batches(tally, int(learns))


def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """block, kind, key of the grams and words of each block of (block, doc_id, text) rows."""
    tallies: dict[int, Tally] = {}
    for batch in batches:
        for block, text in zip(batch.column("block").to_pylist(), lowered(batch.column("text")), strict=True):
            tally = tallies.setdefault(block, Tally())
            tally.add(text)
            if tally.full():
                yield from entry_batches(tallies.pop(block), 0, block)
    for block, tally in tallies.items():
        yield from entry_batches(tally, 0, block)


class Order:
    """Contexts of one length: counts of (context, byte), and of each context its total, number of bytes and excluded count one order below."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, length: int, below: Order | None):
        self.mask = np.uint64((1 << 8 * (length + 1)) - 1)
        short = keys & self.mask
        order = np.argsort(short, kind="stable")
        short = short[order]
        first = np.flatnonzero(np.concatenate(([True], short[1:] != short[:-1]))) if len(short) else np.empty(0, dtype=np.int64)
        self.keys, self.counts = short[first], np.add.reduceat(counts[order], first) if len(first) else np.empty(0, dtype=np.int64)
        context = self.keys >> np.uint64(8)
        at = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1]))) if len(context) else np.empty(0, dtype=np.int64)
        self.contexts = context[at]
        if len(at):
            self.total, self.bytes = np.add.reduceat(self.counts, at), np.diff(np.append(at, len(context)))
            inside = below.counts[np.searchsorted(below.keys, self.keys & below.mask)] if below else np.zeros(len(context), dtype=np.int64)
            self.excluded = np.add.reduceat(inside, at)
        else:
            self.total = self.bytes = self.excluded = np.empty(0, dtype=np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each key's context and of the key itself, -1 where it isn't there."""

        def place(values: np.ndarray, among: np.ndarray) -> np.ndarray:
            if not len(among):
                return np.full(len(values), -1)
            at = np.minimum(np.searchsorted(among, values), len(among) - 1)
            return np.where(among[at] == values, at, -1)

        short = keys & self.mask
        return place(short >> np.uint64(8), self.contexts), place(short, self.keys)


def code_lengths(keys: np.ndarray, orders: list[Order]) -> np.ndarray:
    """log10 probability of the last byte of each key, from the longest of the orders down."""
    out, open_ = np.zeros(len(keys)), np.ones(len(keys), dtype=bool)
    gone, kinds = np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64)  # excluded: counts, and different bytes
    for order in reversed(orders):
        context, key = order.find(keys)
        there = context >= 0
        total = np.where(there, order.total[context], 0) - gone if len(order.total) else np.zeros(len(keys))
        fresh = np.where(there, order.bytes[context], 0) - kinds if len(order.total) else np.zeros(len(keys))
        asks = open_ & there & (total > 0)
        hit = asks & (key >= 0)
        out[hit] += np.log10(order.counts[key[hit]] / (total[hit] + fresh[hit]))
        escape = asks & (key < 0)
        out[escape] += np.log10(fresh[escape] / (total[escape] + fresh[escape]))
        open_ &= ~hit
        if len(order.total):
            # What a context has seen, every shorter one has seen too, so exclusion follows from the last context alone.
            gone, kinds = np.where(there, order.excluded[context], 0), np.where(there, order.bytes[context], 0)
    out[open_] -= np.log10(np.maximum(SYMBOLS - kinds[open_], 1))
    return out


def word_sums(words: Words, keys: np.ndarray, values: np.ndarray, unknown: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: its tokens, those worth more than `unknown`, and the sum of their values; `keys` are sorted and hold every word."""
    each = values[np.searchsorted(keys, words.keys)][words.key]
    first = np.flatnonzero(np.diff(words.owner, prepend=-1))  # each text has its end
    return np.diff(first, append=len(each)), np.add.reduceat((each > unknown).astype(np.int64), first), np.add.reduceat(each, first)


def low_orders(keys: np.ndarray, counts: np.ndarray) -> list[Order]:
    orders: list[Order] = []
    for length in range(3):
        orders.append(Order(keys, counts, length, orders[-1] if orders else None))
    return orders


def ppm_scores(docs: DataFrame, learns, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the documents for which `learns` (a condition) holds. Tokens are the words of the lower-cased text and one
    end; base_score is their add-one unigram log10 probability and score the model's log10 probability of the text. A
    null text is empty and has the end only. Null ids and repeated rows keep their rows, and each teaches; other columns
    are not read. Without training documents all bytes are alike. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    entries = docs.select(F.coalesce(learns, F.lit(False)).alias("learns"), text.alias("text")).mapInArrow(count, ENTRIES)
    table = written(entries.groupBy("kind", "key").agg(F.sum("n").alias("n")))
    trained = table.filter(F.col("kind") == GRAM).filter("n > 0")
    short = trained.groupBy(F.col("key").bitwiseAND(F.lit((1 << 24) - 1)).alias("key")).agg(F.sum("n").alias("n")).toArrow()  # 2^24 rows at most
    low = (short.column("key").to_numpy().astype(np.uint64), short.column("n").to_numpy())
    tokens, kinds = (int(x or 0) for x in table.filter(F.col("kind") == WORD).agg(F.sum("n"), F.count_if(F.col("n") > 0)).first())
    unknown = -float(np.log10(tokens + kinds + 1))
    shared = docs.sparkSession.sparkContext.broadcast(low)

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below = low_orders(*shared.value)
        for part in whole_groups(batches, "tail"):
            keys, n = part.column("key").to_numpy().view(np.uint64), part.column("n").to_numpy()
            orders = list(below)
            for length in range(3, ORDER + 1):
                orders.append(Order(keys[n > 0], n[n > 0], length, orders[-1]))
            yield pa.RecordBatch.from_pydict({"kind": pa.array(np.full(len(keys), GRAM, dtype=np.int32)), "key": pa.array(keys.view(np.int64)), "value": pa.array(code_lengths(keys, orders))})

    tail = F.shiftright("key", 8).bitwiseAND(F.lit((1 << 24) - 1))
    of_grams = table.filter(F.col("kind") == GRAM).select(tail.alias("tail"), "key", "n").repartition("tail").sortWithinPartitions("tail").mapInArrow(lengths, "kind int, key long, value double")
    of_words = table.filter(F.col("kind") == WORD).select("kind", "key", (F.log10(F.col("n") + 1) + unknown).alias("value"))
    values = of_grams.unionByName(of_words)

    size = docs.agg(F.sum(F.length(text)).alias("size")).first()["size"] or 0
    blocks = -(-size // BLOCK) or 1
    gathered = docs.select(F.pmod(F.xxhash64(id_col, text_col), F.lit(blocks)).cast("int").alias("block"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).repartition("block")
    asked = gathered.mapInArrow(wanted, "block int, kind int, key long")
    answers = asked.join(values, ["kind", "key"]).select("block", "kind", "key", "value")

    def score(texts: pa.Table, answers: pa.Table) -> pa.Table:
        kind, key, value = (answers.column(c).to_numpy() for c in ("kind", "key", "value"))

        def sorted_part(part: int) -> tuple[np.ndarray, np.ndarray]:
            keys, values = key[kind == part], value[kind == part]
            order = np.argsort(keys)
            return keys[order], values[order]

        gram_keys, gram_values = sorted_part(GRAM)
        gram_keys = gram_keys.view(np.uint64)  # grams are below 2^63
        word_keys, word_values = sorted_part(WORD)
        del answers, kind, key, value
        n_tokens, n_known = np.zeros(texts.num_rows, dtype=np.int64), np.zeros(texts.num_rows, dtype=np.int64)
        base, total = np.zeros(texts.num_rows), np.zeros(texts.num_rows)
        held, first, held_size = [], 0, 0
        for i, raw in enumerate(raw for chunk in texts.column("text").chunks for raw in lowered(chunk)):
            held.append(raw)
            held_size += len(raw)
            if held_size < CHUNK and i < texts.num_rows - 1:
                continue
            here = slice(first, first + len(held))
            n_tokens[here], n_known[here], base[here] = word_sums(Words(held), word_keys, word_values, unknown)
            for owners, padded in stretches(held):
                g = grams(padded)
                owner = np.repeat(owners, [len(held[o]) + 1 for o in owners] if len(owners) > 1 else len(g))
                for k in range(0, len(g), PIECE):
                    # Sorted by gram, so that lookups run through the table in its order; the low bits keep the place.
                    piece = np.sort(g[k : k + PIECE] << np.uint64(16) | np.arange(len(g[k : k + PIECE]), dtype=np.uint64))
                    found = gram_values[np.searchsorted(gram_keys, piece >> np.uint64(16))]
                    at = owner[k : k + PIECE][(piece & np.uint64(0xFFFF)).astype(np.int64)]
                    total[here] += np.bincount(at, weights=found, minlength=len(held))
            held, first, held_size = [], i + 1, 0
        return pa.table({"doc_id": texts.column("doc_id"), "n_tokens": pa.array(n_tokens), "n_known": pa.array(n_known), "train_tokens": pa.array([tokens] * len(total), pa.int64()), "base_score": pa.array(base), "score": pa.array(total)})

    return gathered.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
