"""Token ids in binary shards, with a minimal perfect hash index from document keys to them.

Shard: 16 bytes (magic ``VLTOKENS``, bytes per id as 32 bits, 4 zero bytes), then the raw ids
of its documents, little-endian, each document with its end id. Ids take 2 bytes if the
vocabulary fits, else 4. Shards follow each other in ascending doc_id order (null first), so
global positions are sums of shard lengths. Shards and tables live in one folder.

Index: a key is (doc_id, k), k counting the rows that share a doc_id. Keys are split by hash
into parts of about ``PART_KEYS``; a part is one row: levels of bits in which each key owns
exactly one set bit (keys that collide on a level move to the next), whose rank is the key's
slot, and arrays over slots with a stored fingerprint, shard, offset and length. A look-up
tests about 1.6 bits, compares the fingerprint and reads one byte range.

Writers give a shard its final name only when it is complete, and a repeated task writes the
same bytes, so lost executors leave no half shards.

Defined results: null text is empty (only the end id); repeated doc_ids are found by k; unknown
keys are not returned; an empty table gives no shards.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectorloom.llm.common import text_of
from vectorloom.llm.tokens import Encoder, default_vocabulary
from vectorloom.tables import checkpoint_dir, prepare

MAGIC = b"VLTOKENS"
HEADER = 16
END_ID = 2
PART_KEYS = 1 << 16
#: Bits per key on a level, and levels after which two keys must be equal.
GAMMA = 1.5
MAX_LEVELS = 200
#: Gaps up to this many bytes are read through rather than skipped.
READ_GAP = 1 << 16
READ_SPAN = 8 << 20
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def file_system(uri: str):
    """The pyarrow file system of a folder that all executors share, and its path there."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


# ---- writing ----------------------------------------------------------------------------


def write_shards(docs: DataFrame, folder: str, vocabulary: str | None = None,
                 end_id: int = END_ID) -> DataFrame:
    """Writes the shards; a table of doc_id, shard, offset, n_ids, run (place among the rows
    of its doc_id within the shard), kept as ``entries`` in the folder."""
    spark = docs.sparkSession
    prepare(spark)
    path = vocabulary or default_vocabulary()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, where = file_system(folder)
        encoder = Encoder.of(path)
        width = 2 if max(encoder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        task = TaskContext.get()
        shard = task.partitionId()
        draft = f"{where}/.{shard_name(shard)}-{task.taskAttemptId()}-{uuid4().hex[:8]}"
        end = np.array([end_id], dtype=f"<u{width}").tobytes()
        offset, last, run, out = 0, object(), 0, None
        for batch in batches:
            if out is None and batch.num_rows:
                files.create_dir(where, recursive=True)
                out = files.open_output_stream(draft)
                out.write(MAGIC + width.to_bytes(4, "little") + bytes(4))
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                keys = part.column("doc_id").to_pylist()
                offsets, counts, runs = [], [], []
                for key, ids in zip(keys, encoder.encode(part.column("text").to_pylist()),
                                    strict=True):
                    out.write(np.frombuffer(ids, "<u4").astype(f"<u{width}").tobytes() + end)
                    run = run + 1 if key == last else 0
                    last = key
                    offsets.append(offset)
                    counts.append(len(ids) // 4 + 1)
                    runs.append(run)
                    offset += counts[-1]
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array([shard] * len(keys), pa.int32()),
                    pa.array(offsets, pa.int64()), pa.array(counts, pa.int64()),
                    pa.array(runs, pa.int64())],
                    names=["doc_id", "shard", "offset", "n_ids", "run"])
        if out is not None:
            out.close()
            final = f"{where}/{shard_name(shard)}"
            try:
                files.move(draft, final)
            except OSError:  # the store doesn't replace: an earlier attempt wrote the same
                files.delete_file(final)
                files.move(draft, final)

    rows = docs.select(docs["doc_id"], text_of(docs).alias("text"),
                       F.monotonically_increasing_id().alias("tie"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    entries = ordered.select("doc_id", "text").mapInArrow(
        write, f"doc_id {kind}, shard INT, offset BIGINT, n_ids BIGINT, run BIGINT")
    entries.write.parquet(f"{folder}/entries")
    return spark.read.parquet(f"{folder}/entries")


# ---- index ------------------------------------------------------------------------------


def key_columns(doc_id: Column, k: Column) -> list[Column]:
    """Two independent 64-bit hashes of a key."""
    return [F.xxhash64(doc_id, k).alias("h1"),
            F.xxhash64(F.lit("second"), k, doc_id).alias("h2")]


def _slots(h2: np.ndarray, level: int, bits: int) -> np.ndarray:
    x = h2 + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return (x ^ (x >> np.uint64(31))) % np.uint64(bits)


def _key(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return h2 ^ (h1 * _MIX[0])


def build_levels(keys: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Bits of each level, and all bits: one set bit per key."""
    sizes, parts = [], []
    while len(keys):
        if len(sizes) == MAX_LEVELS:
            raise ValueError("two keys of an index part are equal")
        bits = max(8, int(len(keys) * GAMMA) + 7 & ~7)
        at = _slots(keys, len(sizes), bits)
        alone = np.bincount(at.astype(np.int64), minlength=bits) == 1
        parts.append(alone)
        keys = keys[~alone[at.astype(np.int64)]]
        sizes.append(bits)
    return sizes, np.concatenate(parts) if parts else np.zeros(0, bool)


def find_slots(keys: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """Slot of each key, -1 if no level has its bit."""
    rank = np.cumsum(bits) - 1
    slots = np.full(len(keys), -1, np.int64)
    open_ = np.arange(len(keys))
    start = 0
    for level, size in enumerate(sizes):
        at = start + _slots(keys[open_], level, size).astype(np.int64)
        hit = bits[at]
        slots[open_[hit]] = rank[at[hit]]
        open_ = open_[~hit]
        start += size
    return slots


INDEX = ("part INT, n BIGINT, sizes ARRAY<BIGINT>, bits BINARY, prints BINARY, shards BINARY, "
         "offsets BINARY, lengths BINARY")


def _u64(column) -> np.ndarray:
    return column.combine_chunks().to_numpy(zero_copy_only=False).view(np.uint64)


def _index_part(table: pa.Table) -> pa.Table:
    h1, h2 = _u64(table.column("h1")), _u64(table.column("h2"))
    keys = _key(h1, h2)
    sizes, bits = build_levels(keys)
    order = np.empty(len(keys), np.int64)
    order[find_slots(keys, sizes, bits)] = np.arange(len(keys))

    def column(name, kind):
        return table.column(name).to_numpy()[order].astype(kind).tobytes()

    return pa.table({
        "part": pa.array([table.column("part")[0].as_py()], pa.int32()),
        "n": pa.array([len(keys)], pa.int64()), "sizes": pa.array([sizes], pa.list_(pa.int64())),
        "bits": [np.packbits(bits).tobytes()],
        "prints": [(h1[order] >> np.uint64(32)).astype("<u4").tobytes()],
        "shards": [column("shard", "<i4")], "offsets": [column("offset", "<i8")],
        "lengths": [column("n_ids", "<i8")]})


def _part(parts: int) -> Column:
    return F.pmod(F.xxhash64("h2"), F.lit(parts)).cast("int").alias("part")


def build_index(entries: DataFrame, folder: str) -> DataFrame:
    """The index over all entries, kept as ``index`` in the folder."""
    runs = entries.groupBy("doc_id", "shard").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("doc_id").orderBy("shard")
    runs = runs.select(F.col("doc_id").alias("r_id"), F.col("shard").alias("r_shard"),
                       (F.sum("n").over(by) - F.col("n")).alias("earlier"))
    keyed = entries.join(runs, F.col("doc_id").eqNullSafe(F.col("r_id"))
                         & (F.col("shard") == F.col("r_shard")))
    parts = max(1, -(-entries.count() // PART_KEYS))
    rows = keyed.select(*key_columns(F.col("doc_id"), F.col("earlier") + F.col("run")),
                        "shard", "offset", "n_ids")
    rows = rows.select("*", _part(parts))
    rows.groupBy("part").applyInArrow(_index_part, INDEX).write.parquet(f"{folder}/index")
    return entries.sparkSession.read.parquet(f"{folder}/index")


# ---- reading ----------------------------------------------------------------------------


def _ranges(files, where: str, shard: int, offsets, lengths) -> Iterator[bytes]:
    """Raw ids (32 bits) of ascending ranges of one shard; near ranges share a read."""
    with files.open_input_file(f"{where}/{shard_name(shard)}") as source:
        head = source.read(HEADER)
        if head[:8] != MAGIC:
            raise ValueError(f"{shard_name(shard)} is not a token shard")
        width = int.from_bytes(head[8:12], "little")
        starts = HEADER + offsets * width
        ends = starts + lengths * width
        lo = 0
        while lo < len(starts):
            hi = lo + 1
            while (hi < len(starts) and starts[hi] <= ends[hi - 1] + READ_GAP
                   and ends[hi] - starts[lo] <= READ_SPAN):
                hi += 1
            block = source.read_at(int(ends[lo:hi].max() - starts[lo]), int(starts[lo]))
            for i in range(lo, hi):
                raw = block[starts[i] - starts[lo]:ends[i] - starts[lo]]
                yield np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes()
            lo = hi


def look_up(keys: DataFrame, index: DataFrame) -> DataFrame:
    """doc_id, k, shard, offset, n_ids of the keys (doc_id, k) that the index holds."""
    parts = max(1, index.count())
    kind = keys.schema["doc_id"].dataType.simpleString()
    rows = keys.select("doc_id", F.col("k").cast("bigint").alias("k"),
                       *key_columns(F.col("doc_id"), F.col("k").cast("bigint")))
    rows = rows.select("*", _part(parts))

    def located(wanted: pa.Table, held: pa.Table) -> pa.Table:
        chosen = np.zeros(0, np.int64)
        columns = {"shards": "<i4", "offsets": "<i8", "lengths": "<i8"}
        data = {c: np.zeros(0, t) for c, t in columns.items()}
        if held.num_rows and wanted.num_rows:
            row = held.to_pylist()[0]
            bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8)).astype(bool)
            h1, h2 = _u64(wanted.column("h1")), _u64(wanted.column("h2"))
            slots = find_slots(_key(h1, h2), row["sizes"], bits[:sum(row["sizes"])])
            prints = np.frombuffer(row["prints"], "<u4")
            good = (slots >= 0) & (prints[slots] == (h1 >> np.uint64(32)).astype("<u4"))
            chosen = np.flatnonzero(good)
            data = {c: np.frombuffer(row[c], t)[slots[chosen]] for c, t in columns.items()}
        kept = wanted.select(["doc_id", "k"]).take(pa.array(chosen))
        return pa.table({
            "doc_id": kept.column("doc_id"), "k": kept.column("k"),
            "shard": pa.array(data["shards"], pa.int32()),
            "offset": pa.array(data["offsets"], pa.int64()),
            "n_ids": pa.array(data["lengths"], pa.int64())})

    return rows.groupBy("part").cogroup(index.groupBy("part")).applyInArrow(
        located, f"doc_id {kind}, k BIGINT, shard INT, offset BIGINT, n_ids BIGINT")


def read_ids(located: DataFrame, folder: str) -> DataFrame:
    """``located`` with ids (32 bits, little-endian), read from the shards in file order."""
    prepare(located.sparkSession)
    schema = located.schema.add("ids", "binary")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, where = file_system(folder)
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            offset, length = batch.column("offset").to_numpy(), batch.column("n_ids").to_numpy()
            lo = 0
            while lo < len(shard):
                same = np.searchsorted(shard[lo:], shard[lo], side="right") + lo
                load = np.cumsum(length[lo:same])
                hi = lo + max(1, int(np.searchsorted(load, READ_SPAN, side="right")))
                ids = list(_ranges(files, where, int(shard[lo]), offset[lo:hi], length[lo:hi]))
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(ids, pa.binary())], names=schema.names)
                lo = hi

    ordered = located.repartitionByRange("shard", "offset").sortWithinPartitions(
        "shard", "offset")
    return ordered.mapInArrow(read, schema)


class TokenStore:
    """Shards and index of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.folder = folder
        self.entries = spark.read.parquet(f"{folder}/entries")
        self.index = spark.read.parquet(f"{folder}/index")

    @classmethod
    def write(cls, docs: DataFrame, folder: str | None = None, **options) -> TokenStore:
        spark = docs.sparkSession
        folder = folder or f"{checkpoint_dir(spark)}/tokens-{uuid4().hex}"
        build_index(write_shards(docs, folder, **options), folder)
        return cls(spark, folder)

    def starts(self) -> DataFrame:
        """s_shard, s_start: ids in earlier shards; one row per shard."""
        totals = self.entries.groupBy("shard").agg(F.sum("n_ids").alias("n"))
        by = Window.orderBy("shard")
        return totals.select(F.col("shard").alias("s_shard"),
                             (F.sum("n").over(by) - F.col("n")).alias("s_start"))

    def fetch(self, keys: DataFrame) -> DataFrame:
        """doc_id, k, start, n_ids, ids of the keys (doc_id, k) that are held."""
        found = read_ids(look_up(keys, self.index), self.folder)
        return found.join(self.starts(), F.col("shard") == F.col("s_shard")).select(
            "doc_id", "k", (F.col("s_start") + F.col("offset")).alias("start"), "n_ids", "ids")


def document_keys(docs: DataFrame) -> DataFrame:
    """doc_id, k of every row: repeated doc_ids are counted from 0."""
    counts = docs.groupBy(docs["doc_id"].alias("doc_id")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("doc_id", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.col("n") - 1)).alias("k"))
