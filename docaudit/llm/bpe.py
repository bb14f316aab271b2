"""BPE encoding and decoding by dynamic programming over prefixes.

For a given vocabulary every prefix of a word has one BPE encoding, so one last
token.  The operator stores that token for every prefix: at each character a
suffix automaton (trie with suffix links) gives the vocabulary tokens that end
there, longest first; the right one is the first whose pair with the last token
of the prefix before it survives BPE's own merge order.  Back-pointers then give
the ids, the same as merging by rank would.

Words come from the tokenizer file's rules: NFC, blanks, lower case, and the
split into contractions, letters, single digits and other runs.  Special tokens
written out in a text become their ids, as the tokenizers library does.

Defined results: a null text is an empty one (no ids); rows are independent, so
repeated rows repeat their result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame

#: Blanks as the normaliser's pattern has them.
_BLANK = "\t-\r \x85\xa0  -     　"
_SPLIT = re.compile(f"[{_BLANK}]+")
_ODD = re.compile("[\x1c-\x1f]")
_PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_BLANK}\p{{L}}\p{{N}}]+")
#: Signs that often end a word; none is a letter, a digit or a blank, or begins a contraction.
_SIGNS = "!#$%&*,.:;?"
_END = "</w>"
#: Shift that marks the last character of a word, so that it is a symbol of its own.
_MARK = 0x10000
#: Entries of the word cache before the older half is let go (some 200 bytes each, two halves a process).
CACHE = 500_000
PAIRS = 1_000_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + others.index(b)) for b in range(256)]


class _Cache(dict):
    """Words to ids.  A miss is looked up in the older half, then encoded; words with signs around them are put together from their pieces and not kept."""

    def __init__(self, word, limit: int):
        super().__init__()
        self.word, self.limit, self.old = word, limit, {}

    def __missing__(self, key: str) -> bytes:
        if not key.isalpha():
            stem = key.rstrip(_SIGNS)
            if stem and stem != key and stem.isalpha():
                return self[stem] + self[key[len(stem) :]]
            pieces = _PIECE.findall(key)
            if pieces != [key]:
                return b"".join([self[p] for p in pieces])
        got = self.old.get(key)
        if got is None:
            got = self.word(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = got
        return got


class PrefixBPE:
    """Encoder and decoder of one tokenizer file (byte-level BPE with an end-of-word suffix)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        vocab: dict[str, int] = data["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token = [""] * size
        for text, i in [*vocab.items(), *self.special.items()]:
            self.token[i] = text
        self.pair: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for rank, merge in enumerate(data["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.pair[left, right] = rank
            self.parts[whole] = (left, right)
            self.rank[whole] = rank
        self.symbols = byte_symbols()
        self._right: dict[int, list[int]] = {}
        self._left: dict[int, list[int]] = {}
        self._build(vocab)
        self._fits: dict[int, bool] = {}
        self.words = _Cache(self._word, CACHE)
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    # -- pair compatibility ------------------------------------------------
    def _edge(self, token: int, side: int) -> list[int]:
        """Tokens at one edge of a token while it is being merged, first symbol first."""
        known = (self._left, self._right)[side]
        if token not in known:
            at = [token]
            while at[-1] in self.parts:
                at.append(self.parts[at[-1]][side])
            known[token] = at[::-1]
        return known[token]

    def _meet(self, a: int, b: int) -> int | None:
        """Rank at which BPE merges across the border of a and b: None if never, else whether both were whole by then (0) or not (1)."""
        left, right = self._edge(a, 1), self._edge(b, 0)
        i = j = 0
        never = len(self.pair)
        while True:
            grow_a = self.rank[left[i + 1]] if i + 1 < len(left) else never
            grow_b = self.rank[right[j + 1]] if j + 1 < len(right) else never
            cross = self.pair.get((left[i], right[j]), never)
            # of merges of equal rank the leftmost goes first: inside a, across, inside b
            if cross < grow_a and cross <= grow_b and cross < never:
                return 0 if grow_a == never == grow_b else 1
            if grow_a == never and grow_b == never:
                return None
            if grow_a <= grow_b:
                i += 1
            else:
                j += 1

    def fits(self, a: int, b: int) -> bool:
        """Whether BPE leaves a followed by b as they are."""
        key = a << 20 | b
        got = self._fits.get(key)
        if got is None:
            if len(self._fits) >= PAIRS:
                self._fits.clear()
            got = self._fits[key] = self._meet(a, b) is None
        return got

    # -- suffix automaton --------------------------------------------------
    def _build(self, vocab: dict[str, int]) -> None:
        sound: set[int] = set()
        for i in sorted(vocab.values(), key=lambda t: self.rank.get(t, -1)):
            if i not in self.parts or (self.parts[i][0] in sound and self.parts[i][1] in sound and self._meet(*self.parts[i]) == 0):
                sound.add(i)
        self.go: list[dict[str, int]] = [{}]
        self.ends, self.length = [-1], {}
        for text, i in vocab.items():
            if i not in sound:
                continue
            if text.endswith(_END) and len(text) > len(_END):
                text = text[: -len(_END)]
                text = text[:-1] + chr(ord(text[-1]) + _MARK)
            node = 0
            for ch in text:
                if ch not in self.go[node]:
                    self.go[node][ch] = len(self.go)
                    self.go.append({})
                    self.ends.append(-1)
                node = self.go[node][ch]
            self.ends[node] = i
            self.length[i] = len(text)
        self.suffix = [0] * len(self.go)
        self.shorter = [0] * len(self.go)  # nearest proper suffix that is a token
        queue = list(self.go[0].values())
        trie = [dict(d) for d in self.go]
        for node in queue:
            for ch, nxt in trie[node].items():
                queue.append(nxt)
                s = self.suffix[node]
                while s and ch not in trie[s]:
                    s = self.suffix[s]
                self.suffix[nxt] = trie[s].get(ch, 0)
            s = self.suffix[node]
            self.shorter[node] = s if self.ends[s] >= 0 else self.shorter[s]

    def _step(self, node: int, ch: str) -> int:
        at = node
        while at and ch not in self.go[at]:
            at = self.suffix[at]
        self.go[node][ch] = got = self.go[at].get(ch, 0)
        return got

    def _word(self, word: str) -> bytes:
        s = word if word.isascii() and word.isprintable() else "".join([self.symbols[b] for b in word.encode("utf-8")])
        s = s[:-1] + chr(ord(s[-1]) + _MARK)
        last = [0] * (len(s) + 1)
        go, ends, shorter, length, pairs = self.go, self.ends, self.shorter, self.length, self._fits
        state = 0
        for i, ch in enumerate(s, 1):
            nxt = go[state].get(ch)
            state = self._step(state, ch) if nxt is None else nxt
            node = state if ends[state] >= 0 else shorter[state]
            while True:
                t = ends[node]
                j = i - length[t]
                if not j:
                    break
                ok = pairs.get(last[j] << 20 | t)
                if self.fits(last[j], t) if ok is None else ok:
                    break
                node = shorter[node]
            last[i] = t
        out = []
        i = len(s)
        while i:
            out.append(last[i])
            i -= length[last[i]]
        out.reverse()
        return struct.pack(f"<{len(out)}I", *out)

    # -- texts -------------------------------------------------------------
    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if self._cut and any(s in text for s in self.special):
            return b"".join([np.array([self.special[p]], "<u4").tobytes() if p in self.special else self._plain(p) for p in self._cut.split(text)])
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        text = unicodedata.normalize("NFC", text)
        text = text.replace("Σ", "σ").lower()  # lower() alone would write a final sigma
        parts = _SPLIT.split(text) if _ODD.search(text) else text.split()
        return b"".join(map(self.words.__getitem__, parts))

    def decode(self, ids: bytes) -> str:
        """Tokens of the ids, blank-joined: the file names no decoder."""
        return " ".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_LOADED: dict[str, PrefixBPE] = {}


def load(path: str) -> PrefixBPE:
    """The file's encoder, built once a process; a name without a folder is one of SparkContext.addFile."""
    if path not in _LOADED:
        _LOADED[path] = PrefixBPE(path if "/" in path else SparkFiles.get(path))
    return _LOADED[path]


def bpe_encode(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens long, ids binary, decoded string) of every text."""
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(_encoder(tokenizer, False), f"`{id_col}` {kind}, n_tokens long, ids binary, decoded string")


def bpe_digest(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``bpe_encode``, with SHA-256 digests of the ids and the decoded text instead of them."""
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(_encoder(tokenizer, True), f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _encoder(tokenizer: str, digest: bool):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, n, text = [], [], []
                for x in part.column(1):
                    got = bpe.encode(x.as_py() or "")
                    back = bpe.decode(got)
                    n.append(len(got) // 4)
                    ids.append(hashlib.sha256(got).hexdigest() if digest else got)
                    text.append(hashlib.sha256(back.encode("utf-8")).hexdigest() if digest else back)
                names = [part.schema.names[0], "n_tokens", *(("ids_sha256", "decoded_sha256") if digest else ("ids", "decoded"))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string() if digest else pa.binary()), pa.array(text, pa.string())], names)

    return task
