"""Token-id output: documents packed into fixed-length rows.

Each scan task encodes its documents, cuts what is longer than a row into full
rows and a rest (no token is lost), and packs the rests best-fit decreasing: in
order of falling length each piece goes to the open row with the least room that
still fits it, found by a descent in a segment tree over the rooms.  Pieces are
packed in blocks of ``block_tokens``, so memory is bounded and nothing is
shuffled; a block leaves at most a few rows that are not full.

A row of the result is one row of the id matrix: ids padded to ``length``,
position ids that restart at 0 with every segment, the cumulative segment
lengths, and for each segment its document and first token there.

Defined results: a null or empty text, or one without tokens, takes no place.
Documents without id keep a null in ``doc_ids``.  Repeated rows are packed each.
An empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docaudit.llm.bpe import load

LENGTH = 2048
BLOCK_TOKENS = 1 << 22


class Rooms:
    """Open rows by room left: a segment tree whose leaves count the rows of each room."""

    def __init__(self, length: int):
        self.base = 1 << length.bit_length()
        self.count = [0] * (2 * self.base)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._change(room, 1)

    def _change(self, room: int, by: int) -> None:
        node = self.base + room
        while node:
            self.count[node] += by
            node >>= 1

    def tightest(self, need: int) -> int | None:
        """Smallest room of at least ``need`` that an open row has."""
        node = self.base + need
        while not self.count[node]:  # up to the first subtree on the right that holds a row
            while node & 1:
                node >>= 1
            if not node:
                return None
            node += 1
            if node & (node - 1) == 0:  # went round the right edge
                return None
        while node < self.base:
            node = 2 * node if self.count[2 * node] else 2 * node + 1
        return node - self.base

    def take(self, room: int) -> int:
        self._change(room, -1)
        return self.rows[room].pop()


def best_fit_decreasing(lengths: list[int], length: int) -> list[list[int]]:
    """Piece numbers of each packed row."""
    rooms, packed = Rooms(length), []
    for piece in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        size = lengths[piece]
        room = rooms.tightest(size)
        if room is None:
            row, room = len(packed), length
            packed.append([])
        else:
            row = rooms.take(room)
        packed[row].append(piece)
        if room > size:
            rooms.add(room - size, row)
    return packed


def positions(cumulative: list[int], length: int) -> np.ndarray:
    """Position ids of a row: from 0 in every segment, 0 in the padding."""
    at = np.zeros(length, np.int64)
    for lo, hi in zip(cumulative, cumulative[1:]):
        at[lo:hi] = np.arange(hi - lo)
    return at


def pack_tokens(df: DataFrame, tokenizer: str, length: int = LENGTH, pad: int | None = None, block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row_id, n_tokens, input_ids, position_ids, cu_seqlens, doc_ids, starts), one for each packed row.

    ``input_ids`` and ``position_ids`` are ``length`` little-endian unsigned
    integers, of 16 bits where the vocabulary allows, else 32.  ``pad`` is the
    id of the padding (None: the vocabulary's last).
    """
    schema = "row_id long, n_tokens int, input_ids binary, position_ids binary, cu_seqlens array<int>, doc_ids array<long>, starts array<long>"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer)
        kind = "<u2" if len(bpe.token) <= 1 << 16 and length <= 1 << 16 else "<u4"
        filler = len(bpe.token) - 1 if pad is None else pad
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        rests: list[tuple[int | None, int, np.ndarray]] = []
        held = 0

        def rows(groups: list[list[tuple[int | None, int, np.ndarray]]]) -> Iterator[pa.RecordBatch]:
            nonlocal number
            for at in range(0, len(groups), 512):
                out = []
                for group in groups[at : at + 512]:
                    cu = [0, *np.cumsum([len(p) for _, _, p in group]).tolist()]
                    ids = np.full(length, filler, kind)
                    ids[: cu[-1]] = np.concatenate([p for _, _, p in group])
                    out.append((number, cu[-1], ids.tobytes(), positions(cu, length).astype(kind).tobytes(), cu, [d for d, _, _ in group], [s for _, s, _ in group]))
                    number += 1
                kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
                names = ["row_id", "n_tokens", "input_ids", "position_ids", "cu_seqlens", "doc_ids", "starts"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal rests, held
            packed = best_fit_decreasing([len(p) for _, _, p in rests], length)
            yield from rows([[rests[i] for i in group] for group in packed])
            rests, held = [], 0

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                ids = np.frombuffer(bpe.encode(text.as_py() or ""), "<u4").astype(kind)
                whole = len(ids) // length * length
                if whole:
                    yield from rows([[(doc.as_py(), s, ids[s : s + length])] for s in range(0, whole, length)])
                if whole < len(ids):
                    rests.append((doc.as_py(), whole, ids[whole:]))
                    held += len(ids) - whole
                if held >= block_tokens:
                    yield from flush()
        yield from flush()

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(task, schema)


def write_packed(packed: DataFrame, path: str) -> None:
    """The id matrix with its side columns as Parquet files, one matrix block a file."""
    packed.write.parquet(path)


def packed_digest(packed: DataFrame) -> DataFrame:
    """Digests of the two matrices instead of their bytes."""
    return packed.select(
        "row_id",
        "n_tokens",
        F.sha2("input_ids", 256).alias("ids_sha256"),
        F.sha2("position_ids", 256).alias("positions_sha256"),
        "cu_seqlens",
        "doc_ids",
        "starts",
    )
