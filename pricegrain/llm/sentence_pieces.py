"""SentencePiece BPE encoding and decoding with vectorised merge rounds.

The distinct words of a batch lie in one flat numpy array of symbols. Each round finds the smallest pair rank of every
word (a segmented minimum), merges the leftmost occurrences of it in all words at once, and compacts the array, until
no pair of any word remains. A word stops its round at the first merge that makes a pair of the same or a smaller rank,
since the library would take that pair next; so the result is the library's, whatever the order of the vocabulary.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: A word: the spaces before it and what follows up to the next space. No piece holds a space after another character.
WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Words that a task remembers.
REMEMBERED = 200_000
#: Characters of the texts whose words are merged together.
CHUNK = 2_000_000
NO_PAIR = np.int64(1) << 60


class Pieces:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.text = [model.id_to_piece(i) for i in range(size)]
        special = {i for i in range(size) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)}
        self.byte = {i: int(self.text[i][3:-1], 16) for i in range(size) if model.is_byte(i)}
        self.of_byte = {b: i for i, b in self.byte.items()}
        self.control = {i for i in range(size) if model.is_control(i)}
        self.unknown = model.unk_id()
        normal = {self.text[i]: i for i in range(size) if i not in special}
        if any(SPACE in p.lstrip(SPACE) for p in normal):
            raise ValueError("a piece holds a space after another character: words can't be encoded apart")
        # Characters that only longer pieces hold are symbols too: they can merge, though alone they are written as bytes.
        symbols = dict(normal)
        for piece in normal:
            for c in piece:
                symbols.setdefault(c, size + len(symbols))
        self.char = {s: i for s, i in symbols.items() if len(s) == 1}
        self.size = size
        scores = sorted({model.get_score(i) for i in normal.values()}, reverse=True)
        rank = {s: r for r, s in enumerate(scores)}
        pairs = {}
        for piece, i in normal.items():
            for cut in range(1, len(piece)):
                left, right = symbols.get(piece[:cut]), symbols.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = (rank[model.get_score(i)], i)
        keys = np.array(sorted(pairs), dtype=np.int64)
        self.keys = keys
        self.ranks = np.array([pairs[k][0] for k in keys.tolist()], dtype=np.int64)
        self.made = np.array([pairs[k][1] for k in keys.tolist()], dtype=np.int64)
        bits = max(1, len(keys) * 8 - 1).bit_length()
        self.shift = np.uint64(64 - bits)
        self._table(bits)
        self.words: dict[str, tuple[str, int, str]] = {}

    def _table(self, bits: int) -> None:
        """A hash table of the pairs with linear probing; `probes` lookups find any of them."""
        slots = np.full((1 << bits) + 64, -1, dtype=np.int32)
        start, probes = self._slot(self.keys), 1
        for k, s in enumerate(start.tolist()):
            n = 1
            while slots[s] >= 0:
                s, n = s + 1, n + 1
            slots[s], probes = k, max(probes, n)
        self.slots, self.probes = slots, probes

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index of each pair of symbols in keys, -1 where they don't merge."""
        keys = left << np.int64(32) | right
        slot = self._slot(keys)
        found = self.slots[slot]
        hit = (found >= 0) & (self.keys[found] == keys)
        out = np.where(hit, found, -1)
        open_ = np.flatnonzero(~hit & (found >= 0))
        for step in range(1, self.probes):
            if not len(open_):
                break
            found = self.slots[slot[open_] + step]
            hit = (found >= 0) & (self.keys[found] == keys[open_])
            out[open_[hit]] = found[hit]
            open_ = open_[~hit & (found >= 0)]
        return out

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        found = self.find(left, right)
        return np.where(found >= 0, self.ranks[found], NO_PAIR)

    def merge_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word, by merge rounds over all words at once; characters without a piece become bytes."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        text = "".join(words)
        lost: list[str] = []

        def symbol(c: str) -> int:
            i = self.char.get(c)
            if i is None:
                lost.append(c)
                return -len(lost)
            return i

        known = {c: symbol(c) for c in dict.fromkeys(text)}
        symbols = np.fromiter(map(known.__getitem__, text), np.int64, len(text))
        word = np.repeat(np.arange(len(words)), lengths)
        chars = np.arange(len(text))  # the first character of each symbol
        done_symbols, done_chars, done_words = [], [], []
        # rank[i]: of the pair that symbol i makes with the next one of its word
        rank = np.full(len(symbols), NO_PAIR)
        if len(symbols) > 1:
            inner = np.flatnonzero((word[1:] == word[:-1]) & (symbols[1:] >= 0) & (symbols[:-1] >= 0))
            rank[inner] = self.rank_of(symbols[inner], symbols[inner + 1])
        while len(symbols):
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            count = np.diff(np.append(first, len(word)))
            least = np.minimum.reduceat(rank, first)
            ended = least == NO_PAIR
            if ended.any():
                mask = np.repeat(ended, count)
                done_symbols.append(symbols[mask])
                done_chars.append(chars[mask])
                done_words.append(word[mask])
                keep = ~mask
                symbols, chars, word, rank = symbols[keep], chars[keep], word[keep], rank[keep]
                least, count = least[~ended], count[~ended]
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == np.repeat(least, count))
            # Of occurrences that overlap, every second one from the left of a run can merge.
            run_start = np.concatenate(([True], (np.diff(at) > 1) | (word[at[1:]] != word[at[:-1]])))
            run = np.maximum.accumulate(np.where(run_start, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            made = self.made[self.find(symbols[at], symbols[at + 1])]
            now = rank[at]
            n = len(symbols)
            # The new pairs, as they are when occurrences are merged from left to right.
            has_left = (at > 0) & (word[np.maximum(at - 1, 0)] == word[at])
            beside = np.concatenate(([False], (at[1:] - at[:-1] == 2) & (word[at[1:]] == word[at[:-1]])))
            left_symbol = np.where(beside, np.concatenate(([0], made[:-1])), symbols[np.maximum(at - 1, 0)])
            right_at = np.minimum(at + 2, n - 1)
            has_right = (at + 2 < n) & (word[right_at] == word[at])
            right_symbol = symbols[right_at]
            new_left, new_right = np.full(len(at), NO_PAIR), np.full(len(at), NO_PAIR)
            use = np.flatnonzero(has_left & (left_symbol >= 0))
            new_left[use] = self.rank_of(left_symbol[use], made[use])
            use = np.flatnonzero(has_right & (right_symbol >= 0))
            new_right[use] = self.rank_of(made[use], right_symbol[use])
            stops = (new_left <= now) | (new_right <= now)
            # Within a word, what comes after a stop waits for the next round.
            new_word = np.concatenate(([True], word[at[1:]] != word[at[:-1]]))
            stopped = np.cumsum(stops) - stops
            base = np.maximum.accumulate(np.where(new_word, stopped, 0))
            go = stopped == base
            at, made, new_left, new_right, beside, has_left = (x[go] for x in (at, made, new_left, new_right, beside, has_left))
            symbols[at] = made
            rank[at] = new_right
            # A symbol before that is itself new stands two places to the left.
            rank[at[has_left] - np.where(beside[has_left], 2, 1)] = new_left[has_left]
            keep = np.ones(n, dtype=bool)
            keep[at + 1] = False
            symbols, chars, word, rank = symbols[keep], chars[keep], word[keep], rank[keep]
        if not done_symbols:
            return [[] for _ in words]
        symbols, chars, word = (np.concatenate(x) for x in (done_symbols, done_chars, done_words))
        order = np.argsort(chars, kind="stable")
        symbols, chars, word = symbols[order].tolist(), chars[order].tolist(), word[order].tolist()
        out: list[list[int]] = [[] for _ in words]
        for s, c, w in zip(symbols, chars, word, strict=True):
            if 0 <= s < self.size:
                out[w].append(s)
            else:
                out[w].extend(self.of_byte[b] for b in text[c].encode("utf-8"))
        return out

    def remember(self, words: list[str]) -> None:
        """Encodes the words that are not remembered yet."""
        if len(self.words) > REMEMBERED:
            self.words.clear()
        new = [w for w in set(words) if w not in self.words]
        for w, ids in zip(new, self.merge_words(new), strict=True):
            self.words[w] = (",".join(map(str, ids)), len(ids), self.decode(ids, strip=False))

    def decode(self, ids: list[int], strip: bool = True) -> str:
        """Text of the ids; runs of byte pieces are read as UTF-8, what is not UTF-8 in them becomes U+FFFD."""
        out, run = [], bytearray()
        for i in ids:
            if i in self.byte:
                run.append(self.byte[i])
                continue
            if run:
                out.append(bytes(run).decode("utf-8", "replace"))
                run.clear()
            if i not in self.control:
                out.append(" ⁇ " if i == self.unknown else self.text[i].replace(SPACE, " "))
        if run:
            out.append(bytes(run).decode("utf-8", "replace"))
        text = "".join(out)
        return text[1:] if strip and text.startswith(" ") else text

    def split(self, text: str) -> list[str]:
        """Words of a text, after the library's normalisation: a space in front, spaces as U+2581."""
        return WORD.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str) -> list[int]:
        words = self.split(text)
        self.remember(words)
        return [int(i) for w in words for i in self.words[w][0].split(",") if i]


    def batches(self, texts: pa.Array) -> Iterator[list[tuple[str, int, str]]]:
        """What is remembered of each word of each text, with the new words of about CHUNK characters encoded at a time."""
        split, chars = [], 0
        for k, value in enumerate(texts, 1):
            split.append(self.split(text := value.as_py() or ""))
            chars += len(text)
            if chars >= CHUNK or k == len(texts):
                self.remember([w for words in split for w in words])
                for words in split:
                    yield [self.words[w] for w in words]
                split, chars = [], 0


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    return Pieces(path)


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ids. A null or empty text has no ids; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for batch in batches:
            ids = [[int(i) for ids, _, _ in known for i in ids.split(",") if i] for known in pieces.batches(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per document: id, text. Null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for batch in batches:
            texts = [pieces.decode(i.as_py() or []) for i in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes every text in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256.

    The ids and the decoded text never leave the task. Null, empty and repeated rows as in encode(); an empty table
    gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for batch in batches:
            out: list[list] = [[], [], []]
            for known in pieces.batches(batch.column(1)):
                out[0].append(sum(k[1] for k in known))
                out[1].append(hashlib.sha256(",".join(k[0] for k in known).encode()).hexdigest())
                out[2].append(hashlib.sha256("".join(k[2] for k in known)[1:].encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
