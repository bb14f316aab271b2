"""Byte-level BPE encoding and decoding by replaying merges over a corpus of words.

A text is split by the tokenizer's pattern; each match is a word.  A task
gathers the words it has not met before, lays their bytes out in one row of
positions, and keeps an inverted index from token pair to the positions where
that pair stands (a pair is known by the rank of its merge).  The pair of lowest
rank in the index is merged first, at its positions in order; a merge touches
only its two neighbours, whose pairs leave or enter the index.  This goes on
until no pair is left, so every merge is applied over all words in rank order.
Within a word that is the library's own order: lowest rank first, leftmost of
equals.  A word that is a token as a whole is that token.

Tasks share nothing and nothing is shuffled.  A text is taken in windows that
end where no word can cross (before a blank that follows a sign), and the words
known are kept in two bounded halves, so memory does not follow text length
except for the text and its ids.

Defined results: a null text is an empty one (no ids); rows are independent, so
repeated rows repeat their result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame

#: Letters and digits of later Unicode tables than the tokenizer library's, to which they are other signs.
_LATE_LETTERS = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF),
    (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF),
    (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DF1, 0x11DF1), (0x16EA0, 0x16EB8),
    (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF3), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191),
    (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96),
    (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF),
    (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
_LATE_DIGITS = ((0x11DE0, 0x11DE9), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16FF4, 0x16FF6))

#: Characters of a window; words in each half of the cache (some 200 bytes each).
WINDOW, CACHE = 1 << 20, 500_000


class Splitter:
    """Words of a text by a tokenizer's pattern, in the library's character classes."""

    def __init__(self, pattern: str):
        self.late = regex.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in (*_LATE_LETTERS, *_LATE_DIGITS)) + "]")
        self.word, self.border = regex.compile(pattern), regex.compile(r"\S(?=\s)")

    def windows(self, text: str, width: int = 0) -> Iterator[list[str]]:
        """Lists of words, in order; a window ends before a blank that follows something else, which no word crosses."""
        width = width or WINDOW
        at = 0
        while len(text) - at > width:
            cut = self.border.search(text, at + width - 1)
            if not cut:
                break
            yield self._words(text[at : cut.end()])
            at = cut.end()
        yield self._words(text[at:])

    def _words(self, text: str) -> list[str]:
        if text.isascii() or not self.late.search(text):
            return self.word.findall(text)
        shadow = self.late.sub("\ue000", text)  # a sign that is no letter, digit or blank
        return [text[m.start() : m.end()] for m in self.word.finditer(shadow)]


class MergeReplay:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.token = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.token[rank] = token
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)])
        self.byte_pair = np.array([[self.ranks.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)])
        self.decimal = [str(rank) for rank in range(len(self.token))]
        self.pair: dict[int, int] = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pair[left << 32 | right] = rank
        self.split = Splitter(pattern)
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def replay(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of every word: all merges in rank order over one row of positions."""
        if not words:
            return []
        pair = self.pair
        values = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(word) for word in words])
        starts = np.concatenate(([0], ends[:-1]))
        first_ranks = np.full(len(values), -1, np.int64)  # of the pair that begins at a position
        first_ranks[:-1] = self.byte_pair[values[:-1], values[1:]]
        first_ranks[ends - 1] = -1
        at = np.argsort(first_ranks, kind="stable")
        at = at[np.searchsorted(first_ranks[at], 0) :]
        found, cuts = np.unique(first_ranks[at], return_index=True)
        # the index: rank of a pair to its left positions, a heap each (ascending to begin with)
        where = {rank: part.tolist() for rank, part in zip(found.tolist(), np.split(at, cuts[1:]))}
        before, after = np.arange(-1, len(values) - 1), np.arange(1, len(values) + 1)
        before[starts] = after[ends - 1] = -1
        token = self.byte[values].tolist()  # at each position; -1 where a merge took the position in
        before, after = before.tolist(), after.tolist()  # neighbours, -1 at the borders of a word
        ranks = list(where)
        heapify(ranks)
        while ranks:
            rank = ranks[0]
            places = where[rank]
            while places:
                p = heappop(places)
                q = after[p]
                if token[p] < 0 or q < 0 or pair.get(token[p] << 32 | token[q]) != rank:
                    continue  # a neighbour's merge took this pair away
                token[p], token[q] = rank, -1
                n, b = after[q], before[p]
                after[p] = n
                lower = False
                if n >= 0:
                    before[n] = p
                    new = pair.get(rank << 32 | token[n])
                    if new is not None:
                        if new in where:
                            heappush(where[new], p)
                        else:
                            where[new] = [p]
                            heappush(ranks, new)
                        lower = new < rank
                if b >= 0:
                    new = pair.get(token[b] << 32 | rank)
                    if new is not None:
                        if new in where:
                            heappush(where[new], b)
                        else:
                            where[new] = [b]
                            heappush(ranks, new)
                        lower = lower or new < rank
                if lower:
                    break
            if not places:
                del where[rank]
                if ranks[0] == rank:
                    heappop(ranks)
                else:
                    ranks.remove(rank)
                    heapify(ranks)
        all_ids = np.array(token, "<i8")
        left = all_ids >= 0
        return np.split(all_ids[left].astype("<u4"), np.cumsum(left)[ends - 1][:-1])

    def _learn(self, words: list[str]) -> None:
        """Ids of words not met before enter the cache; the older half goes when the newer one is full."""
        known, old, ranks = self.known, self.old, self.ranks
        unseen: list[tuple[str, bytes]] = []
        for word in set(words).difference(known):
            if word in old:
                known[word] = old[word]
                continue
            raw = word.encode("utf-8")
            whole = ranks.get(raw)
            if whole is None:
                unseen.append((word, raw))
            else:
                known[word] = np.array([whole], "<u4").tobytes()
        for (word, _), ids in zip(unseen, self.replay([raw for _, raw in unseen])):
            known[word] = ids.tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        out = []
        for words in self.split.windows(text):
            if len(self.known) >= CACHE:
                self.old, self.known = self.known, {}
            self._learn(words)
            out.append(b"".join(map(self.known.__getitem__, words)))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """Bytes of the ids' tokens."""
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_LOADED: dict[tuple[str, str], MergeReplay] = {}


def load(path: str, pattern: str) -> MergeReplay:
    """The file's encoder, built once a process; a name without a folder is one of SparkContext.addFile."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = MergeReplay(path if "/" in path else SparkFiles.get(path), pattern)
    return _LOADED[path, pattern]


def byte_bpe_encode(df: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens long, ids binary, decoded binary) of every text."""
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(_encoder(ranks, pattern, False), f"`{id_col}` {kind}, n_tokens long, ids binary, decoded binary")


def byte_bpe_digest(df: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``byte_bpe_encode``, with SHA-256 digests of the comma-joined decimal ids and of the decoded bytes instead of them."""
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(_encoder(ranks, pattern, True), f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _decimal_digest(ids: bytes, decimal: list[str]) -> str:
    digest = hashlib.sha256()
    for at in range(0, len(ids), 1 << 20):
        part = ",".join(map(decimal.__getitem__, np.frombuffer(ids[at : at + (1 << 20)], "<u4").tolist()))
        digest.update((("," if at else "") + part).encode("ascii"))
    return digest.hexdigest()


def _encoder(ranks: str, pattern: str, digest: bool):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(ranks, pattern)
        kind = pa.string() if digest else pa.binary()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, n, back = [], [], []
                for x in part.column(1):
                    got = bpe.encode(x.as_py() or "")
                    raw = bpe.decode(got)
                    n.append(len(got) // 4)
                    ids.append(_decimal_digest(got, bpe.decimal) if digest else got)
                    back.append(hashlib.sha256(raw).hexdigest() if digest else raw)
                names = [part.schema.names[0], "n_tokens", *(("ids_sha256", "decoded_sha256") if digest else ("ids", "decoded"))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids, kind), pa.array(back, kind)], names)

    return task
