"""Hierarchical packing of documents into sequences of several context sizes.

Each document goes to the smallest tier (context size) that holds it; what is longer
than the largest is cut into full windows first. A tier's windows are opened by its own
documents, longest first, and their gaps are filled from shorter ones: the longest that
fits, and when none fits, the beginning of the shortest. Every window is therefore full
but the last of a partition, whose rest is cut down along the tiers. Sequences are dealt
to step groups of equal token counts.

A partition packs its own documents, a bounded pool at a time, so nothing is shuffled
and no task holds more than the pool and one document.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from casegrain.llm.shared import plain
from casegrain.llm.tokens import word_ids

TIERS = (64, 128, 256, 512, 1024, 2048, 4096)
END = 2
STEP_TOKENS = 1 << 16
POOL_TOKENS = 1 << 20

SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
    ("tier", pa.int32()), ("step", pa.int64()),
])
DDL = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
       "offset long, tier int, step long")


@dataclass(order=True)
class Piece:
    """Part of a document: ``length`` ids from ``start`` of the ``ids`` (4 bytes each) of all of it."""

    length: int
    number: int
    start: int
    doc_id: int | None
    ids: bytes

    def first(self, n: int) -> Piece:
        return Piece(n, self.number, self.start, self.doc_id, self.ids)

    def after(self, n: int) -> Piece:
        return Piece(self.length - n, self.number, self.start + n, self.doc_id, self.ids)

    def bytes(self) -> bytes:
        return self.ids[4 * self.start: 4 * (self.start + self.length)]


@dataclass
class Window:
    tier: int
    pieces: list[Piece]


def full_windows(piece: Piece, size: int) -> tuple[list[Window], Piece | None]:
    """Windows that one long document fills alone, and what is left of it."""
    windows = []
    while piece.length >= size:
        windows.append(Window(size, [piece.first(size)]))
        piece = piece.after(size)
    return windows, piece if piece.length else None


def pack(pool: list[Piece], tiers: Sequence[int]) -> tuple[list[Window], list[Piece]]:
    """Full windows from pieces no longer than the last tier; the pieces of the window left open."""
    waiting = sorted(pool)
    windows = []
    while waiting:
        head = waiting.pop()
        tier = next(t for t in tiers if t >= head.length)
        pieces, gap = [head], tier - head.length
        while gap and waiting:
            at = bisect_right(waiting, gap, key=lambda p: p.length)
            if at:
                piece = waiting.pop(at - 1)
            else:
                short = waiting.pop(0)
                piece = short.first(gap)
                insort(waiting, short.after(gap))
            pieces.append(piece)
            gap -= piece.length
        if gap:
            return windows, pieces
        windows.append(Window(tier, pieces))
    return windows, []


def cut_down(pieces: list[Piece], tiers: Sequence[int]) -> list[Window]:
    """The last pieces in windows of ever shorter tiers; less than the shortest is one open window."""
    windows = []
    for tier in reversed(tiers):
        while sum(p.length for p in pieces) >= tier:
            window, need = [], tier
            while need:
                piece = pieces.pop(0)
                if piece.length > need:
                    pieces.insert(0, piece.after(need))
                    piece = piece.first(need)
                window.append(piece)
                need -= piece.length
            windows.append(Window(tier, window))
    if pieces:
        windows.append(Window(tiers[0], pieces))
    return windows


def step_groups(windows: list[Window], step_tokens: int) -> list[int]:
    """A group for each window, longest windows first, always to the group with the fewest tokens."""
    groups = max(1, -(-sum(w.tier for w in windows) // step_tokens))
    loads = [(0, g) for g in range(groups)]
    dealt = [0] * len(windows)
    for i in sorted(range(len(windows)), key=lambda i: -windows[i].tier):
        load, group = heapq.heappop(loads)
        dealt[i] = group
        heapq.heappush(loads, (load + windows[i].tier, group))
    return dealt


def _packer(path: str | None, tiers: tuple[int, ...], step_tokens: int, with_ids: bool):
    schema = SCHEMA.append(pa.field("ids", pa.list_(pa.int32()))) if with_ids else SCHEMA
    end = END.to_bytes(4, "little")

    def packer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        encoder, made, steps = word_ids(path), 0, 0

        def rows(windows: list[Window]) -> pa.RecordBatch:
            nonlocal made, steps
            out = []
            groups = step_groups(windows, step_tokens)
            for window, group in zip(windows, groups):
                offset = 0
                for p in window.pieces:
                    data = p.bytes()
                    row = (p.doc_id, p.start, p.length, zlib.crc32(data), len(p.ids) // 4,
                           base + made, offset, window.tier, base + steps + group)
                    out.append((*row, np.frombuffer(data, "<u4").astype(np.int32)) if with_ids else row)
                    offset += p.length
                made += 1
            steps += max(groups, default=-1) + 1
            columns = zip(*out) if out else [[]] * len(schema)
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)

        pool: list[Piece] = []
        ready: list[Window] = []
        held, number = 0, 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encoder.encode(text) + end
                piece = Piece(len(ids) // 4, number, 0, doc_id, ids)
                number += 1
                held += piece.length
                windows, rest = full_windows(piece, tiers[-1])
                ready += windows
                pool += [rest] if rest else []
                if held >= POOL_TOKENS:
                    windows, pool = pack(pool, tiers)
                    yield rows(ready + windows)
                    ready, held = [], sum(p.length for p in pool)
        windows, rest = pack(pool, tiers)
        windows = ready + windows + cut_down(rest, tiers)
        if windows:
            yield rows(windows)

    return packer


def packed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None,
    tiers: Sequence[int] = TIERS, step_tokens: int = STEP_TOKENS, with_ids: bool = True,
) -> DataFrame:
    """One row per piece of a document: where it lies in its document and in its sequence.

    ``sequence_id`` has a context of ``tier`` tokens and belongs to training step ``step``;
    ``ids`` are the piece's tokens. A document's ids end with id 2; a null or empty text is
    that id alone. Equal rows are packed once each, a null id stays null, an empty table
    gives no rows. The sequences follow the partitioning of ``docs``: a table that was
    shuffled at random should be written first, so that a lost task is repeated alike.
    """
    ddl = DDL + (", ids array<int>" if with_ids else "")
    return plain(docs, id_col, text_col).mapInArrow(
        _packer(vocabulary, tuple(sorted(tiers)), step_tokens, with_ids), ddl
    )
