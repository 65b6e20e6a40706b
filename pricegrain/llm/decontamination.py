"""Documents that hold passages of benchmark items, found by a generalised suffix automaton of the items.

The automaton takes the items' words and knows every run of words in any of them. A document's words are streamed through
it; the state tells how long a run ending at each word occurs in the items, and thereby which windows and whole short items
end there. Items are dealt into shards of bounded size, each with an automaton of its own.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, ascii_lower, written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes to lower case, and those between words to spaces: digits, letters and all bytes of other characters are in words.
TABLE = bytes(b + 32 if chr(b) in UPPER else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of the items of one automaton, which is broadcast; a shard may be somewhat larger, since pieces are dealt by hash.
SHARD_BYTES = 2 << 20
#: Words of an item that are dealt together, and bytes of a document that are read at a time.
PIECE, STRETCH = 4096, 1 << 20

FOUND = "struct<n_words:bigint,items:array<string>,spans:array<struct<first:bigint,last:bigint,start:bigint,stop:bigint>>>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


class Automaton:
    """A suffix automaton of several word lists, in flat arrays: transitions sorted by state and word, suffix links, longest lengths.

    pieces: (item id or null, words, whether the piece is a whole item). window: the words of a window; an item of fewer is
    found whole.
    """

    def __init__(self, pieces: Iterable[tuple[str | None, list[bytes], bool]], window: int):
        self.window, self.vocabulary = window, {}
        coded = []
        for item, words, whole in pieces:
            coded.append((item, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words], whole))
        self.size = max(1, len(self.vocabulary))
        self._build([codes for _, codes, _ in coded])
        self._windows(coded)
        self._pairs([codes for _, codes, _ in coded])

    def _build(self, texts: list[list[int]]) -> None:
        following, link, length = [{}], [-1], [0]

        def clone(state: int, at: int, code: int, deep: int) -> int:
            following.append(dict(following[state]))
            link.append(link[state])
            length.append(deep)
            made = len(link) - 1
            link[state] = made
            while at >= 0 and following[at].get(code) == state:
                following[at][code] = made
                at = link[at]
            return made

        for text in texts:
            last = 0
            for code in text:
                there = following[last].get(code)
                if there is not None:  # another item went on in the same way
                    last = there if length[there] == length[last] + 1 else clone(there, last, code, length[last] + 1)
                    continue
                following.append({})
                link.append(0)
                length.append(length[last] + 1)
                state, at = len(link) - 1, last
                while at >= 0 and code not in following[at]:
                    following[at][code] = state
                    at = link[at]
                if at >= 0:
                    there = following[at][code]
                    link[state] = there if length[there] == length[at] + 1 else clone(there, at, code, length[at] + 1)
                last = state
        keys = sorted((s * self.size + c, t) for s, f in enumerate(following) for c, t in f.items())
        self.keys, self.targets = array("q", (k for k, _ in keys)), array("i", (t for _, t in keys))
        self.link, self.length = array("i", link), array("i", length)

    def _windows(self, coded: list) -> None:
        """Which items have the window that a state's runs end with, and which whole short items a state's runs end with."""
        order = np.argsort(np.asarray(self.length), kind="stable").tolist()
        self.top, self.short = array("i", repeat(-1, len(order))), array("i", repeat(-1, len(order)))
        for s in order[1:]:
            above = self.link[s]
            self.top[s] = self.top[above] if self.length[above] >= self.window else s if self.length[s] >= self.window else -1
        self.items: dict[int, list] = defaultdict(list)
        shortest = self.window
        for item, codes, whole in coded:
            if len(codes) < self.window and not whole:
                continue
            shortest = min(shortest, len(codes))
            states = [s for _, s, _ in self.stream(codes)]
            if len(codes) < self.window:
                self.short[states[-1]] = states[-1]
            for state in {states[-1]} if len(codes) < self.window else {self.top[s] for s in states[self.window - 1 :]}:
                self.items[state].append(item)
        self.shortest = shortest
        for s in order[1:]:  # the longest whole short item that a state's runs end with
            if self.short[s] < 0:
                self.short[s] = self.short[self.link[s]]
        self.items = {s: sorted({i for i in found if i is not None}) for s, found in self.items.items()}

    def _pairs(self, texts: list[list[int]]) -> None:
        """A table of hashes of neighbouring words; pairs that aren't in it are in no item."""
        pairs = np.concatenate([np.asarray(t[:-1], np.int64) * self.size + np.asarray(t[1:], np.int64) for t in texts if len(t) > 1] or [np.empty(0, np.int64)])
        self.bits = max(10, int(len(pairs) * 16).bit_length())
        self.near = np.zeros(1 << self.bits, bool)
        self.near[self._place(pairs)] = True

    def _place(self, pairs: np.ndarray) -> np.ndarray:
        return (pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def stream(self, codes: Iterable[int]) -> Iterator[tuple[int, int, int]]:
        """For each word its place, the state after it, and the length of the longest run of the items that ends there."""
        keys, targets, size, link, length = self.keys, self.targets, self.size, self.link, self.length
        state = run = 0
        for k, code in enumerate(codes):
            while True:
                if code < 0:  # a word of no item
                    state = run = 0
                    break
                at = bisect_left(keys, key := state * size + code)
                if at < len(keys) and keys[at] == key:
                    state, run = targets[at], run + 1
                    break
                if state == 0:
                    run = 0
                    break
                state = link[state]
                run = length[state]
            yield k, state, run

    def stretches(self, codes: np.ndarray) -> Iterator[tuple[int, int]]:
        """Where to stream: maximal stretches of words whose neighbours are neighbours in the items, as long as the shortest window."""
        if self.shortest == 1:
            good, more = codes >= 0, 0
        else:
            good, more = (codes[:-1] >= 0) & (codes[1:] >= 0), 1
            at = np.flatnonzero(good)
            good[at] = self.near[self._place(codes[at] * self.size + codes[at + 1])]
        edges = np.flatnonzero(np.diff(np.concatenate(([0], good.view(np.int8), [0]))))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a + more >= self.shortest:
                yield a, b + more

    def find(self, text: bytes) -> tuple[int, set[int], list[tuple[int, int]]]:
        """The number of words, the states of the windows that occur, and the words (first, behind the last) that they cover."""
        text = text.translate(TABLE)
        n, states, spans, before, a = 0, set(), [], np.empty(0, np.int64), 0
        while a < len(text):
            b = len(text) if len(text) - a <= STRETCH else text.find(b" ", a + STRETCH)
            words = text[a : b if b >= 0 else len(text)].split()
            a = b if b >= 0 else len(text)
            # The last words of the stretch before are read again, for windows that go on.
            codes = np.concatenate((before, np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))))
            base = n - len(before)
            for i, j in self.stretches(codes):
                self._search(codes[i:j].tolist(), base + i, states, spans)
            n += len(words)
            before = codes[max(0, len(codes) - self.window + 1) :]
        return n, states, spans

    def _search(self, codes: list[int], base: int, states: set[int], spans: list[tuple[int, int]]) -> None:
        top, short, link, length = self.top, self.short, self.link, self.length
        for k, state, run in self.stream(codes):
            if run >= self.window:
                states.add(top[state])
                spans.append((base + k - run + 1, base + k + 1))
            at = short[state if run == length[state] else link[state]] if state else -1
            while at >= 0:
                states.add(at)
                spans.append((base + k - length[at] + 1, base + k + 1))
                at = short[link[at]]


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def in_bytes(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """Spans of words with the bytes that they take."""
    inside = np.frombuffer(text.translate(TABLE), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    return [(a, b, int(edges[2 * a]), int(edges[2 * b - 1])) for a, b in spans]


def pieces_of(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """item, words, whole: items' words in pieces of bounded size that share all words but one of a window with the next."""
    words = items.select(F.col(id_col).cast("string").alias("item"), F.regexp_extract_all(ascii_lower(F.col(text_col)), F.lit(WORD), F.lit(0)).alias("words")).filter("size(words) > 0").distinct()
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)), F.lit(PIECE))
    cut = words.select("item", "words", F.explode(starts).alias("start"))
    return cut.select("item", F.slice("words", F.col("start") + 1, F.lit(PIECE + window - 1)).alias("words"), (F.size("words") < window).alias("whole"))


def matches(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, found: str = "found") -> DataFrame:
    """The documents with a struct `found`: n_words, items, spans.

    Words are runs of ASCII letters and digits and other characters beyond ASCII; only A-Z are lower-cased. A window is
    `window` words of an item, or a whole item of fewer. items: the ids, as strings in byte order, of the items that have a
    window in the document. spans: the runs of words that windows cover, from word `first` to before `last`, in the text's
    UTF-8 from byte `start` to before `stop`. Null texts have no words; items without words are found nowhere, items
    without an id mark words but aren't listed, and rows of one id are one item.

    Items of up to SHARD_BYTES make one automaton, and documents are read once; for each further shard, documents and what
    was found so far are written to the shared folder and read again.
    """
    spark = docs.sparkSession
    pieces = written(pieces_of(items, item_id, item_text, window))
    weight = F.aggregate("words", F.lit(0).cast("long"), lambda n, w: n + F.octet_length(w) + 1)
    total = pieces.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("n")).first()["n"]
    shards = max(1, -(-total // SHARD_BYTES))
    out = docs.withColumn(found, F.lit(None).cast(FOUND))
    for k in range(shards):
        shard = pieces.filter(F.pmod(F.xxhash64("words"), F.lit(shards)) == k).collect()  # SHARD_BYTES or so
        known = spark.sparkContext.broadcast(Automaton(((r["item"], [w.encode() for w in r["words"]], r["whole"]) for r in shard), window))
        out = (out if k == 0 else written(out)).withColumn(found, scan(known)(F.col(text_col).cast("string").cast("binary"), F.col(found)))
    return out


def scan(known) -> object:  # noqa: ANN001
    """The function of a text and of what was found before, for one broadcast automaton."""

    @F.pandas_udf(FOUND)
    def run(batches: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        automaton = known.value
        for texts, before in batches:
            rows = []
            for text, old_items, old_spans in zip(texts, before["items"], before["spans"], strict=True):
                text = text or b""
                n, states, spans = automaton.find(text)
                items = {i for s in states for i in automaton.items[s]}
                if old_items is not None:
                    items |= set(old_items)
                    spans += [(x["first"], x["last"]) for x in old_spans]
                rows.append((n, sorted(items, key=str.encode), [dict(zip(("first", "last", "start", "stop"), x, strict=True)) for x in in_bytes(text, merged(spans))] if spans else []))
            yield pd.DataFrame(rows, columns=["n_words", "items", "spans"])

    return run


def n_hit(found: str = "found") -> Column:
    """Words that windows cover."""
    return F.aggregate(f"{found}.spans", F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"])


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: object) -> DataFrame:
    """One row per document: its id, n_words, n_hit, n_items, items, spans, items_sha256, contaminated. See matches()."""
    rows = matches(docs.select(F.col(id_col), F.col(text_col)), items, text_col, **how)
    listed = F.col("found.items")
    return rows.select(F.col(id_col), "found.n_words", n_hit().alias("n_hit"), F.size(listed).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", listed), 256).alias("items_sha256"), (F.size("found.spans") > 0).alias("contaminated"), "found.items", "found.spans")


def decontaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", least_words: int = 10, most_coverage: float = 0.5, **how: object) -> DataFrame:
    """The documents, all columns, without spans of `least_words` words or more; those of which windows cover over `most_coverage` of the words go.

    A text from which nothing is cut, or that is null, stays as it is.
    """
    found = "__found"
    rows = matches(docs, items, text_col, found=found, **how).filter(n_hit(found) <= F.lit(most_coverage) * F.col(f"{found}.n_words"))

    @F.pandas_udf("string")
    def kept(texts: pd.Series, cuts: pd.Series) -> pd.Series:
        def one(text: bytes | None, spans: list) -> str | None:
            if text is None:
                return None
            at, parts = 0, []
            for x in spans:
                parts.append(text[at : x["start"]])
                at = x["stop"]
            return b"".join([*parts, text[at:]]).decode()

        return pd.Series([one(t, s) for t, s in zip(texts, cuts, strict=True)])

    long = F.filter(f"{found}.spans", lambda x: x["last"] - x["first"] >= least_words)
    cut = F.when(F.size(long) > 0, kept(F.col(text_col).cast("binary"), long)).otherwise(F.col(text_col))
    return rows.withColumn(text_col, cut).select(*(F.col(f"`{c}`") for c in docs.columns))
