"""Exact deduplication with an index of cuckoo filters over live digests.

A digest is the SHA-256 of a text. Digests are split by their first bits into shards; a shard
holds a cuckoo filter (16-bit fingerprints, four to a bucket, two buckets per digest) and the
stored digests by bucket. A digest is looked up in the filter; a hit is verified against the
stored digests of its bucket, a miss is new. Deleting rows lowers a digest's count, the last
one removes its fingerprint, and if the row that stays goes, the best of the others takes its
place. If an insertion finds no place after ``KICKS`` moves, the shard's filter is rebuilt
twice as large from the stored digests, so nothing is ever lost.

Rows are combined before they are shuffled, batch by batch, so a group of copies of any size
reaches its shard as a few rows. A shard has about ``SHARD_DIGESTS`` digests: an index that has
outgrown its shards splits them by further bits of the digests.

Defined results: null text counts as empty; of equal texts the row with the largest doc_id
stays, rows alike in doc_id and text count each but only one of them stays, null doc_ids come
last; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.llm.common import small_side, text_of
from vectorloom.tables import prepare, written

SLOTS = 4
KICKS = 500
SHARD_DIGESTS = 50_000
FIRST_BUCKETS = 64
#: The kept row of a digest that is to get another one.
NO_ROW = (None, -1)
PARTIAL = "shard INT, digest BINARY, keep_id BIGINT, keep_row BIGINT, n BIGINT"
INDEX = ("shard INT, buckets INT, filter BINARY, digests BINARY, keep_ids ARRAY<BIGINT>, "
         "keep_rows ARRAY<BIGINT>, counts ARRAY<BIGINT>")


class CuckooFilter:
    """Fingerprints of live digests; ``stored`` verifies hits and rebuilds the table."""

    def __init__(self, buckets: int = FIRST_BUCKETS):
        self.stored: dict[int, list[bytes]] = {}
        self.live = 0
        self._empty(buckets)

    def _empty(self, buckets: int) -> None:
        self.buckets = buckets
        self.table = [[] for _ in range(buckets)]

    @staticmethod
    def _print(digest: bytes) -> int:
        return int.from_bytes(digest[8:10], "little") or 1

    def _home(self, digest: bytes) -> int:
        return int.from_bytes(digest[10:18], "little") & (self.buckets - 1)

    def _other(self, bucket: int, print_: int) -> int:
        return (bucket ^ print_ * 0x5BD1E995) & (self.buckets - 1)

    def __contains__(self, digest: bytes) -> bool:
        print_, home = self._print(digest), self._home(digest)
        if print_ not in self.table[home] and \
                print_ not in self.table[self._other(home, print_)]:
            return False
        return digest in self.stored.get(home, ())

    def insert(self, digest: bytes) -> bool:
        """True if the digest is new."""
        if digest in self:
            return False
        self.stored.setdefault(self._home(digest), []).append(digest)
        self.live += 1
        if not self._place(digest):
            self._grow()
        return True

    def delete(self, digest: bytes) -> bool:
        """True if the digest was live."""
        if digest not in self:
            return False
        print_, home = self._print(digest), self._home(digest)
        at = home if print_ in self.table[home] else self._other(home, print_)
        self.table[at].remove(print_)
        self.stored[home].remove(digest)
        self.live -= 1
        return True

    def _place(self, digest: bytes) -> bool:
        print_, at = self._print(digest), self._home(digest)
        other = self._other(at, print_)
        for bucket in (at, other):
            if len(self.table[bucket]) < SLOTS:
                self.table[bucket].append(print_)
                return True
        for kick in range(KICKS):
            row = self.table[at]
            slot = kick % SLOTS
            print_, row[slot] = row[slot], print_
            at = self._other(at, print_)
            if len(self.table[at]) < SLOTS:
                self.table[at].append(print_)
                return True
        return False

    def _grow(self) -> None:
        """A table that holds all stored digests, twice as large as before or more."""
        digests = [d for bucket in self.stored.values() for d in bucket]
        while True:
            self._empty(self.buckets * 2)
            if all(map(self._place, digests)):
                break
        self.stored = {}
        for d in digests:
            self.stored.setdefault(self._home(d), []).append(d)

    def dump(self) -> bytes:
        out = np.zeros((self.buckets, SLOTS), "<u2")
        for i, row in enumerate(self.table):
            out[i, :len(row)] = row
        return out.tobytes()

    @classmethod
    def load(cls, buckets: int, table: bytes, digests: list[bytes]) -> CuckooFilter:
        made = cls(buckets)
        made.table = [[int(v) for v in row if v] for row in
                      np.frombuffer(table, "<u2").reshape(buckets, SLOTS)]
        for d in digests:
            made.stored.setdefault(made._home(d), []).append(d)
        made.live = len(digests)
        return made


def _order(key: tuple) -> tuple:
    return (key[0] is not None, key[0] or 0, key[1])


class Shard:
    """A filter and, per live digest, the row to keep and the number of rows."""

    def __init__(self, row: dict | None = None):
        self.rows: dict[bytes, list] = {}
        self.filter = CuckooFilter()
        if row:
            digests = [row["digests"][i:i + 32] for i in range(0, len(row["digests"]), 32)]
            self.rows = {d: [(i, r), n] for d, i, r, n in zip(
                digests, row["keep_ids"], row["keep_rows"], row["counts"], strict=True)}
            self.filter = CuckooFilter.load(row["buckets"], row["filter"], digests)

    def insert(self, digest: bytes, keep: tuple, n: int) -> None:
        if self.filter.insert(digest):
            self.rows[digest] = [keep, n]
        else:
            row = self.rows[digest]
            row[0] = max(row[0], keep, key=_order)
            row[1] += n

    def delete(self, digest: bytes, gone: tuple, n: int) -> None:
        """``n`` rows less; ``gone`` is the best of them. A digest whose kept row went waits
        for another (``NO_ROW``)."""
        if digest not in self.filter:
            return
        row = self.rows[digest]
        row[1] -= n
        if row[1] <= 0:
            self.filter.delete(digest)
            del self.rows[digest]
        elif row[0] == gone:
            row[0] = NO_ROW

    def elect(self, digest: bytes, keep: tuple) -> None:
        if self.rows[digest][0] == NO_ROW:
            self.rows[digest][0] = keep
        else:
            self.rows[digest][0] = max(self.rows[digest][0], keep, key=_order)

    def dump(self, shard: int) -> pa.Table:
        kept, counts = [r[0] for r in self.rows.values()], [r[1] for r in self.rows.values()]
        longs = pa.list_(pa.int64())
        return pa.table({
            "shard": pa.array([shard], pa.int32()),
            "buckets": pa.array([self.filter.buckets], pa.int32()),
            "filter": [self.filter.dump()], "digests": pa.array([b"".join(self.rows)]),
            "keep_ids": pa.array([[k[0] for k in kept]], longs),
            "keep_rows": pa.array([[k[1] for k in kept]], longs),
            "counts": pa.array([counts], longs)})


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, row (a number of its own), digest; kept in the checkpoint folder."""
    return written(docs.select(
        docs["doc_id"].cast("bigint").alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        F.unhex(F.sha2(text_of(docs), 256)).alias("digest")))


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """``rows`` less those of ``gone``, as often as ``left`` says they stay."""
    names = ("doc_id", "row", "digest")
    same = [F.col(c).eqNullSafe(F.col(f"g_{c}")) for c in names]
    marked = gone.select(*[F.col(c).alias(f"g_{c}") for c in names], "left")
    kept = rows.join(marked.drop("left"), same[0] & same[1] & same[2], "left_anti")
    again = gone.where(F.col("left") > 0).select(*names, F.explode(
        F.array_repeat(F.lit(0), F.col("left").cast("int")))).drop("col")
    return written(kept.select(*names).union(again))


def _combined(rows: DataFrame, shards: int, by_digest: bool = False) -> DataFrame:
    """One row per digest and Arrow batch: its best row and count. ``by_digest`` brings all
    rows of a digest together, so that there is one row per digest."""

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best: dict[bytes, list] = {}
            for doc_id, row, digest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held = best.get(digest)
                if held is None:
                    best[digest] = [(doc_id, row), 1]
                else:
                    held[0] = max(held[0], (doc_id, row), key=_order)
                    held[1] += 1
            yield pa.RecordBatch.from_arrays([
                pa.array([int.from_bytes(d[:4], "big") * shards >> 32 for d in best], pa.int32()),
                pa.array(list(best), pa.binary()),
                pa.array([b[0][0] for b in best.values()], pa.int64()),
                pa.array([b[0][1] for b in best.values()], pa.int64()),
                pa.array([b[1] for b in best.values()], pa.int64())],
                names=["shard", "digest", "keep_id", "keep_row", "n"])

    found = rows.select("doc_id", "row", "digest").mapInArrow(combine, PARTIAL)
    if not by_digest:
        return found
    best = F.max(F.struct(F.col("keep_id").isNotNull().alias("known"), "keep_id", "keep_row"))
    return found.groupBy("shard", "digest").agg(best.alias("b"), F.sum("n").alias("n")).select(
        "shard", "digest", "b.keep_id", "b.keep_row", "n")


def _updated(index: DataFrame, changes: DataFrame, change) -> DataFrame:
    def merge(held: pa.Table, new: pa.Table) -> pa.Table:
        shard = Shard(held.to_pylist()[0] if held.num_rows else None)
        for part in new.to_batches(4096):
            for row in part.to_pylist():
                change(shard, row)
        return shard.dump((new if new.num_rows else held).column("shard")[0].as_py())

    return index.groupBy("shard").cogroup(changes.groupBy("shard")).applyInArrow(merge, INDEX)


class ExactIndex:
    """Cuckoo-filter shards as a table with one row per shard, and the rows that are live."""

    def __init__(self, table: DataFrame, shards: int, rows: DataFrame | None = None):
        self.table, self.shards, self.rows = table, shards, rows

    @classmethod
    def empty(cls, spark, expected_digests: int) -> ExactIndex:
        prepare(spark)
        return cls(spark.createDataFrame([], INDEX), max(1, -(-expected_digests // SHARD_DIGESTS)))

    def insert(self, rows: DataFrame) -> ExactIndex:
        """With the rows (doc_id, row, digest) added."""
        rows = rows.select("doc_id", "row", "digest")
        new = _combined(rows, self.shards)
        table = written(_updated(self.table, new, lambda shard, r: shard.insert(
            r["digest"], (r["keep_id"], r["keep_row"]), r["n"])))
        live = rows if self.rows is None else self.rows.union(rows)
        return ExactIndex(table, self.shards, live)._split()

    def _split(self) -> ExactIndex:
        """With as many shards as the digests need, if they are over twice too many."""
        held = self.table.agg(F.sum(F.length("digests") / 32)).first()[0] or 0
        if held <= 2 * SHARD_DIGESTS * self.shards:
            return self
        shards = self.shards
        while held > SHARD_DIGESTS * shards:
            shards *= 2
        first = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")
        dealt = self.live().select(
            F.floor(first * shards / (1 << 32)).cast("int").alias("shard"), "digest", "keep_id",
            "keep_row", F.col("group_size").alias("n"))
        none = self.table.sparkSession.createDataFrame([], INDEX)
        return ExactIndex(written(_updated(none, dealt, lambda shard, r: shard.insert(
            r["digest"], (r["keep_id"], r["keep_row"]), r["n"]))), shards, self.rows)

    def delete(self, rows: DataFrame) -> ExactIndex:
        """Without these rows (doc_id, row, digest); rows that are not live are ignored. A row
        entered twice goes once for each time it is named."""
        wanted = written(rows.select("doc_id", "row", "digest"))
        gone = written(self._counted(wanted).select(
            "doc_id", "row", "digest", F.least("named", "n").alias("named"),
            (F.col("n") - F.least("named", "n")).alias("left")).where("named > 0"))
        each = gone.select("doc_id", "row", "digest", F.explode(
            F.array_repeat(F.lit(0), F.col("named").cast("int")))).drop("col")
        table = written(_updated(
            self.table, _combined(each, self.shards, by_digest=True), lambda shard, r: shard.delete(
                r["digest"], (r["keep_id"], r["keep_row"]), r["n"])))
        after = ExactIndex(table, self.shards, _without(self.rows, gone))
        waiting = small_side(after.live().where(F.col("keep_row") == -1).select(
            F.col("digest").alias("w_digest")))
        others = after.rows.join(waiting, F.col("digest") == F.col("w_digest"), "left_semi")
        table = written(_updated(table, _combined(others, self.shards), lambda shard, r: shard.elect(
            r["digest"], (r["keep_id"], r["keep_row"]))))
        return ExactIndex(table, self.shards, after.rows)

    def _counted(self, wanted: DataFrame) -> DataFrame:
        """doc_id, row, digest, named, n: how often rows are to go and how often they are live."""
        digests = small_side(wanted.select(F.col("digest").alias("w_digest")).distinct())
        live = (self.rows.join(digests, F.col("digest") == F.col("w_digest"), "left_semi")
                .groupBy("doc_id", "row", "digest").agg(F.count(F.lit(1)).alias("n")))
        named = wanted.groupBy(*[F.col(c).alias(f"g_{c}") for c in ("doc_id", "row", "digest")]).agg(
            F.count(F.lit(1)).alias("named"))
        return live.join(named, F.col("doc_id").eqNullSafe(F.col("g_doc_id"))
                         & (F.col("row") == F.col("g_row")) & (F.col("digest") == F.col("g_digest")))

    def live(self) -> DataFrame:
        """digest, keep_id, keep_row, group_size of every live digest."""

        def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1).to_pylist()[0]
                    raw = row["digests"]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([raw[k:k + 32] for k in range(0, len(raw), 32)], pa.binary()),
                        pa.array(row["keep_ids"], pa.int64()),
                        pa.array(row["keep_rows"], pa.int64()),
                        pa.array(row["counts"], pa.int64())],
                        names=["digest", "keep_id", "keep_row", "group_size"])

        return self.table.mapInArrow(
            listed, "digest BINARY, keep_id BIGINT, keep_row BIGINT, group_size BIGINT")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, digest, keep_id, group_size, kept of every row."""
    rows = digests(docs)
    index = ExactIndex.empty(docs.sparkSession, rows.count()).insert(rows)
    live = index.live().select(F.col("digest").alias("l_digest"), "keep_id", "keep_row",
                               "group_size")
    return rows.join(live, F.col("digest") == F.col("l_digest")).select(
        "doc_id", "digest", "keep_id", "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"))
