"""Hierarchical packing of documents into training sequences of several lengths.

A document's ids (with an end id) fill whole long sequences first; what is left over is routed
to the smallest tier (context size) that holds it. Each tier is packed longest piece first; the
gap of a sequence is filled with the longest waiting pieces of its own and shorter tiers that
fit, and when none fits one is cut to the gap. So every sequence is exactly as long as its tier
and nothing is padded. At the end of a task the few pieces still waiting are laid out and cut
into sequences whose lengths are powers of two.

A step group holds sequences of one tier with ``STEP_SEQUENCES`` long sequences' worth of ids,
so all full groups cost a training step the same.

Packing is local to a task: one pass over the rows, no shuffle, memory bounded by
``WAITING`` sequences. A repeated task gives the same pieces.

Defined results: null text is empty and still gives its end id; repeated rows are packed each;
rows with a null doc_id keep it; an empty table gives no pieces.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from vectorloom.llm.common import text_of
from vectorloom.llm.tokens import PIECE_BYTES, UNIT_BYTES, Encoder, default_vocabulary
from vectorloom.tables import prepare

TIERS = (1024, 512, 256, 128)
END_ID = 0
#: Long sequences' worth of ids that wait for a partner before tiers are packed.
WAITING = 256
STEP_SEQUENCES = 8
#: Bits of sequence_id that number a task's own sequences.
LOCAL_BITS = 40

PIECES = ("start BIGINT, length BIGINT, ids BINARY, doc_tokens BIGINT, sequence_id BIGINT, "
          "offset BIGINT, tier INT, step_group BIGINT")


class Packer:
    """Packs pieces (document, start, ids) of one task."""

    def __init__(self, tiers: tuple[int, ...] = TIERS, waiting: int = WAITING):
        if any(t & (t - 1) for t in tiers) or sorted(tiers, reverse=True) != list(tiers):
            raise ValueError("tiers are powers of two, longest first")
        self.tiers, self.longest = tiers, tiers[0]
        self.bound = waiting * self.longest
        #: Per tier: waiting (length, number) in ascending order; pieces by number.
        self.queues: dict[int, list[tuple[int, int]]] = {t: [] for t in tiers}
        self.pieces: dict[int, tuple] = {}
        self.held = self.numbered = self.sequences = 0
        self.made: list[tuple] = []
        self.of_tier = dict.fromkeys(tiers, 0)

    def add(self, document, ids: np.ndarray) -> None:
        whole = len(ids) - len(ids) % self.longest
        for at in range(0, whole, self.longest):
            self._emit(self.longest, [(document, at, ids[at:at + self.longest])])
        if whole < len(ids):
            self._wait(document, whole, ids[whole:])
        if self.held > self.bound:
            self._pack()

    def finish(self) -> None:
        self._pack()
        rest = [self._take(t, -1) for t in self.tiers for _ in range(len(self.queues[t]))]
        total = sum(len(ids) for _, _, ids in rest)
        while total:
            size = min(self.longest, 1 << (total.bit_length() - 1))
            total -= size
            window, gap = [], size
            while gap:
                document, start, ids = rest.pop(0)
                window.append((document, start, ids[:gap]))
                if len(ids) > gap:
                    rest.insert(0, (document, start + gap, ids[gap:]))
                gap -= len(window[-1][2])
            self._emit(size, window)

    def _wait(self, document, start: int, ids: np.ndarray) -> None:
        tier = next(t for t in reversed(self.tiers) if len(ids) <= t)
        insort(self.queues[tier], (len(ids), self.numbered))
        self.pieces[self.numbered] = (document, start, ids)
        self.numbered += 1
        self.held += len(ids)

    def _take(self, tier: int, at: int):
        length, number = self.queues[tier].pop(at)
        self.held -= length
        return self.pieces.pop(number)

    def _fitting(self, tier: int, gap: int):
        """The longest waiting piece of this or a shorter tier that fits the gap."""
        for t in self.tiers[self.tiers.index(tier):]:
            at = bisect_right(self.queues[t], (gap, self.numbered)) - 1
            if at >= 0:
                return self._take(t, at)
        return None

    def _pack(self) -> None:
        for tier in self.tiers:
            while self.queues[tier]:
                window, gap = [self._take(tier, -1)], tier
                gap -= len(window[0][2])
                while gap:
                    piece = self._fitting(tier, gap)
                    if piece is None:
                        longer = next((t for t in reversed(self.tiers)
                                       if t <= tier and self.queues[t]), None)
                        if longer is None:
                            break
                        document, start, ids = self._take(longer, 0)
                        self._wait(document, start + gap, ids[gap:])
                        piece = (document, start, ids[:gap])
                    window.append(piece)
                    gap -= len(piece[2])
                if gap:  # nothing left to fill it with
                    for piece in window:
                        self._wait(*piece)
                    break
                self._emit(tier, window)

    def _emit(self, size: int, window: list[tuple]) -> None:
        tier = size if size in self.of_tier else self.tiers[-1]
        per_group = STEP_SEQUENCES * self.longest // tier
        group = self.of_tier[tier] // per_group
        self.of_tier[tier] += 1
        offset = 0
        for document, start, ids in window:
            self.made.append((document, start, ids, self.sequences, offset, size, group))
            offset += len(ids)
        self.sequences += 1


def pack(docs: DataFrame, tiers: tuple[int, ...] = TIERS, vocabulary: str | None = None,
         end_id: int = END_ID, table_bytes: int = UNIT_BYTES + PIECE_BYTES) -> DataFrame:
    """doc_id and one row per piece: start, length, ids (32-bit little-endian), doc_tokens,
    sequence_id, offset, tier (the sequence's length), step_group. A worker's tables of words
    take at most ``table_bytes``, which changes no row."""
    prepare(docs.sparkSession)
    path = vocabulary or default_vocabulary()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = Encoder.of(path, table_bytes), Packer(tiers)
        base = TaskContext.get().partitionId() << LOCAL_BITS
        end = np.array([end_id], dtype="<u4").tobytes()

        def flushed():
            rows, packer.made = packer.made, []
            for lo in range(0, len(rows), 4096):
                doc, start, ids, seq, offset, size, group = zip(*rows[lo:lo + 4096], strict=True)
                yield pa.RecordBatch.from_arrays([
                    pa.array([d[0] for d in doc], key), pa.array(start, pa.int64()),
                    pa.array([len(i) for i in ids], pa.int64()),
                    pa.array([i.tobytes() for i in ids], pa.binary()),
                    pa.array([d[1] for d in doc], pa.int64()),
                    pa.array([base + s for s in seq], pa.int64()),
                    pa.array(offset, pa.int64()), pa.array(size, pa.int32()),
                    pa.array([(base + g) * 16 + int(s).bit_length() for g, s in
                              zip(group, size, strict=True)], pa.int64()),
                ], names=["doc_id", *[x.split()[0] for x in PIECES.split(", ")]])

        key = None
        for batch in batches:
            key = batch.schema.field("doc_id").type
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = part.column("text").to_pylist()
                for doc_id, ids in zip(part.column("doc_id").to_pylist(),
                                       encoder.encode(texts), strict=True):
                    tokens = np.frombuffer(ids + end, dtype="<u4")
                    packer.add((doc_id, len(tokens)), tokens)
                yield from flushed()
        if key is not None:
            packer.finish()
            yield from flushed()

    rows = docs.select(docs["doc_id"], text_of(docs).alias("text"))
    return rows.mapInArrow(packed, f"doc_id {kind}, {PIECES}")
