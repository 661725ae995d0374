"""Near duplicates by SimHash fingerprints, found with the generalised pigeonhole principle.

Fingerprint: 64 bits, each set if more than half of the text's shingle hashes (XXH64) set it.
Equal fingerprints are one node. Two nodes link at ``radius`` or fewer differing bits.

Search: bits that vary together are grouped into m partitions, so that some partitions become
selective. If the thresholds t of the partitions add up to radius - m + 1, two linked
fingerprints differ by at most t in some partition; t = -1 leaves a partition out. For every m
dynamic programming picks the thresholds with the least estimated cost: probes (variants of a
part within t bits) and candidates (pairs that meet at a probe, from the part's pair counts and
the bits' odds to differ). The cheapest m wins. Statistics are sums over all fingerprints.

Probing: every fingerprint goes to the key of its part and, for t > 0, of the part's variants.
Fingerprints that meet are verified by popcount. A key with at most ``GROUP`` fingerprints is
verified in one task and gives at most one link per fingerprint, which connects what the real
links connect. Larger keys of a radius up to 2 are never compared pairwise: there each
fingerprint goes on to itself with one bit flipped (or none), and fingerprints within two bits
always meet at such a key, which holds at most 65 of them; the links run to the least one. For
wider radii a key of over ``BLOCK`` is cut into blocks of ``BLOCK`` fingerprints, every pair of blocks is one
group of its own, and a group is searched outwards from one fingerprint at a time, so that a
dense group takes few steps and no list of pairs is made. So no link is lost.

Documents can also be told apart by what they say: ``one_of_each`` takes components of a wider
radius as candidates and verifies the Jaccard similarity of word shingles between members that
share one of their rarest shingles, which similar members always do. A member stays unless it is
similar to one that stays, so no two of a component that stay are similar.

Defined results: null and empty texts have fingerprint zero, a node like any other; repeated
rows share a fingerprint; a component's id is the least doc_id in it, null only if all are
null; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from vectorloom.llm.common import rows_as, small_side, text_of
from vectorloom.llm.components import components
from vectorloom.sources.sinks import remove_path
from vectorloom.tables import Scratch, checkpoint_dir, prepare, written

BITS = 64
RADIUS = 2
SHINGLE = 3
SEED = 42
#: Fingerprints a key may have to be verified within one task.
GROUP = 512
#: Fingerprints of one block of a larger key, for radii above STAR_RADIUS.
BLOCK = 8192
STAR_RADIUS = 2
#: Cost of sending one probe, in candidate comparisons.
PROBE_COST = 20.0
MOST_PARTS = 8
#: Variants of a part that may be probed; plans with more are not considered.
MOST_PROBES = 1 << 16
#: ``one_of_each``: candidates by 2-word fingerprints within 8 bits, verified on 5-word shingles.
FILTER_RADIUS, FILTER_WORDS = 8, 2
SHINGLE_WORDS, SIMILARITY = 5, 0.8
#: Buckets of the counts that tell rare shingles from common ones.
BUCKETS = 1 << 18
#: Pairs per entry at the start up to which all that share a rare shingle are compared at once.
PAIRS = 8
#: Members of a shingle's group up to which its pairs are rows; larger groups are cut into blocks
#: of ``MEMBERS``, and tasks compare block with block and return the similar pairs only.
PAIR_GROUP = 16
MEMBERS = 128
#: Cells of the member-by-shingle matrix that a task multiplies at a time.
CELLS = 1 << 22
STEP = 1 << 16


def shingle_hashes(text: str, words: int, seed: int = SEED) -> Iterator[np.ndarray]:
    """XXH64 of the lower-cased (A-Z) text's word shingles in order, some at a time."""
    from xxhash import xxh64_intdigest

    found = text.encode().lower().split()
    if not found:
        return
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found])
    n = max(1, len(found) - words + 1)
    starts = np.concatenate([[0], ends[:n - 1]]).tolist()
    stops = (ends[min(words, len(found)) - 1:] - 1).tolist()
    for lo in range(0, n, STEP):
        yield np.fromiter(
            (xxh64_intdigest(joined[a:b], seed)
             for a, b in zip(starts[lo:lo + STEP], stops[lo:lo + STEP], strict=True)),
            dtype="<u8")


def fingerprint(text: str, words: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of the text's shingles, repeats counted; zero without words."""
    votes, n = np.zeros(BITS, np.int64), 0
    for hashes in shingle_hashes(text, words, seed):
        n += len(hashes)
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1,
                               bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, words: int = SHINGLE, *carry) -> DataFrame:
    """The carried columns (by default all, packed as row), and fp as a signed long."""
    prepare(docs.sparkSession)
    rows = docs.select(*(carry or [rows_as(docs)]), text_of(docs).alias("shingled_text"))
    kept = rows.drop("shingled_text").schema
    names = kept.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(x.as_py(), words)
                               for x in batch.column("shingled_text")], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], pa.array(prints, pa.int64())],
                names=[*names, "fp"])

    return rows.mapInArrow(run, StructType([*kept, StructField("fp", LongType())]))


# ---- choice of partitions ---------------------------------------------------------------


def _bit_matrix(prints: np.ndarray) -> np.ndarray:
    return np.unpackbits(prints.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_counts(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """Fingerprints, and how many set both of two bits: 64 x 64 sums over all of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            x = _bit_matrix(batch.column("fp").to_numpy().astype("<i8")).astype(np.float32)
            n += len(x)
            both += x.T @ x
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(BITS * BITS + 1, dtype=np.int32)), pa.array(np.append(both.ravel(), n))],
            names=["cell", "n"])

    rows = (nodes.select("fp").mapInArrow(count, "cell INT, n DOUBLE")
            .groupBy("cell").agg(F.sum("n").alias("n")).collect())
    flat = np.zeros(BITS * BITS + 1)
    for r in rows:
        flat[r.cell] = r.n
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def grouped_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in parts of nearly equal size, correlated bits together: each part starts with the
    strongest free bit and takes the free bits most correlated with it."""
    p = np.diag(both) / max(n, 1)
    covariance = both / max(n, 1) - np.outer(p, p)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    strength = np.abs(covariance / np.outer(spread, spread))
    free = set(range(BITS))
    made = []
    for k in range(parts):
        size = BITS // parts + (k < BITS % parts)
        order = sorted(free)
        first = max(order, key=lambda b: (strength[b, order].sum(), -b))
        part = [first]
        while len(part) < size:
            rest = sorted(free - set(part))
            part.append(max(rest, key=lambda b: (strength[b, part].sum(), -b)))
        free -= set(part)
        made.append(sorted(part))
    return made


def within_cost(n: int, p: np.ndarray, most: int) -> list[tuple[float, float]]:
    """For thresholds 0..most: probes per fingerprint, and pairs within the threshold,
    estimated from each bit's odds to differ."""
    differ = 2 * p * (1 - p)
    chance = np.zeros(most + 1)
    chance[0] = 1.0
    for d in differ:
        chance[1:] = chance[1:] * (1 - d) + chance[:-1] * d
        chance[0] *= 1 - d
    probes, out = 0.0, []
    choose = 1.0
    for t in range(most + 1):
        probes += choose
        choose = choose * (len(p) - t) / (t + 1)
        out.append((probes, float(n) * n / 2 * chance[:t + 1].sum()))
    return out


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds (-1 and up, one per part) that add up to ``total`` at the least cost."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (spent, chosen) in best.items():
            for t in range(-1, len(cost)):
                option = (spent + (cost[t] if t >= 0 else 0.0), [*chosen, t])
                if used + t not in step or option < step[used + t]:
                    step[used + t] = option
        best = step
    return best[total]


def plan(n: int, both: np.ndarray, radius: int = RADIUS) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the parts to probe."""
    p = np.diag(both) / max(n, 1)
    found = None
    for m in range(1, min(MOST_PARTS, radius + 2) + 1):
        parts = grouped_bits(n, both, m)
        costs = []
        for bits in parts:
            each = within_cost(n, p[bits], radius)
            costs.append([probes * n * PROBE_COST + pairs
                          for probes, pairs in each if probes <= MOST_PROBES])
        if radius - m + 1 > sum(len(c) - 1 for c in costs):
            continue  # more probes than allowed
        cost, thresholds = allocate(costs, radius - m + 1)
        chosen = [(b, t) for b, t in zip(parts, thresholds, strict=True) if t >= 0]
        if found is None or cost < found[0]:
            found = (cost, chosen)
    if found is None:
        raise ValueError(f"radius {radius}: every plan probes over {MOST_PROBES} variants a part")
    return found[1]


# ---- probing ----------------------------------------------------------------------------


def _probe_masks(bits: list[int], threshold: int) -> np.ndarray:
    masks = [0]
    for t in range(1, threshold + 1):
        masks += [sum(1 << b for b in c) for c in combinations(bits, t)]
    return np.array(masks, "<u8")


def probes(nodes: DataFrame, chosen: list[tuple[list[int], int]]) -> DataFrame:
    """part, key, fp, own (the key is the fingerprint's own, not a variant)."""
    masks = [(np.uint64(sum(1 << b for b in bits)), _probe_masks(bits, t)) for bits, t in chosen]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column("fp").to_numpy().astype("<i8").view("<u8")
            for part, (whole, variants) in enumerate(masks):
                for i, v in enumerate(variants):
                    keys = (prints & whole) ^ v
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(keys), part, np.int32)),
                        pa.array(keys.view("<i8")), batch.column("fp"),
                        pa.array(np.full(len(keys), i == 0))],
                        names=["part", "key", "fp", "own"])

    return nodes.select("fp").mapInArrow(run, "part INT, key BIGINT, fp BIGINT, own BOOLEAN")


def _connected(prints: np.ndarray, own: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(i, root) for fingerprints connected by links that have an end in ``own``. The search
    goes outwards from one fingerprint of ``own`` at a time over those not yet reached."""
    root = np.arange(len(prints))
    if len(prints) <= GROUP:
        near = np.bitwise_count(prints[own][:, None] ^ prints[None, :]) <= radius
        a, b = np.nonzero(near)
        a = np.flatnonzero(own)[a]
        while True:
            before = root.copy()
            np.minimum.at(root, a, before[b])
            np.minimum.at(root, b, before[a])
            root = root[root]
            if (root == before).all():
                break
    else:
        linked = np.zeros(len(prints), bool)
        for lo in range(0, len(prints), 256):
            some = slice(lo, lo + 256)
            near = np.bitwise_count(prints[some][:, None] ^ prints[None, :]) <= radius
            near &= own[some][:, None] | own[None, :]
            linked[some] = near.sum(axis=1) > own[some]  # itself left out
        rest = np.flatnonzero(linked)
        while len(rest):
            first = rest[0]
            front, rest = rest[:1], rest[1:]
            while len(front) and len(rest):
                some, front = front[:64], front[64:]
                near = np.bitwise_count(prints[some][:, None] ^ prints[rest][None, :]) <= radius
                near &= own[some][:, None] | own[rest][None, :]
                hit = near.any(axis=0)
                root[rest[hit]] = first
                front = np.concatenate([front, rest[hit]])
                rest = rest[~hit]
    return [(int(i), int(root[i])) for i in np.flatnonzero(root != np.arange(len(root)))]


def _star_keys(radius: int) -> np.ndarray:
    """Flips after which two fingerprints within ``radius`` meet: half the radius each."""
    half = (radius + 1) // 2
    return _probe_masks(list(range(BITS)), half)


def links(nodes: DataFrame, folder: str, radius: int = RADIUS, group: int = GROUP,
          block: int = BLOCK) -> DataFrame:
    """u, v: edges that connect all fingerprints linked directly or over others. Probes that
    meet are kept in ``folder`` until the edges have been used."""
    n, both = bit_counts(nodes)
    if n < 2:
        return nodes.sparkSession.createDataFrame([], "u BIGINT, v BIGINT")
    placed = probes(nodes, plan(n, both, radius))
    sizes = placed.groupBy("part", "key").agg(
        F.count(F.lit(1)).alias("size"), F.max("own").alias("any_own"))
    met = sizes.where((F.col("size") > 1) & F.col("any_own")).select(
        F.col("part").alias("m_part"), F.col("key").alias("m_key"), "size")
    joined = placed.join(met, (F.col("part") == F.col("m_part"))
                         & (F.col("key") == F.col("m_key"))).select(
        "part", "key", "fp", "own", "size")
    joined.write.parquet(folder)
    joined = nodes.sparkSession.read.parquet(folder)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        prints: list[np.ndarray] = []
        owned: list[np.ndarray] = []

        def done():
            both_ends = np.concatenate(prints)
            found = _connected(both_ends.view("<u8"), np.concatenate(owned), radius)
            u = [int(both_ends[i]) for i, _ in found]
            v = [int(both_ends[j]) for _, j in found]
            return u, v

        for batch in batches:
            part, key = batch.column("part").to_numpy(), batch.column("key").to_numpy()
            pair = batch.column("pair").to_numpy()
            fp = batch.column("fp").to_numpy().astype("<i8")
            own = batch.column("own").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((np.diff(part) != 0) | (np.diff(key) != 0)
                                   | (np.diff(pair) != 0)) + 1
            us, vs = [], []
            for lo, hi in zip([0, *edges], [*edges, len(fp)], strict=True):
                if lo == hi:
                    continue
                here = (part[lo], key[lo], pair[lo])
                if held is not None and here != held:
                    u, v = done()
                    us += u
                    vs += v
                    prints.clear()
                    owned.clear()
                held = here
                prints.append(fp[lo:hi])
                owned.append(own[lo:hi])
            yield pa.RecordBatch.from_arrays(
                [pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])
        if held is not None:
            u, v = done()
            yield pa.RecordBatch.from_arrays(
                [pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    def verified(rows: DataFrame) -> DataFrame:
        place = ["part", "key", "pair"]
        return (rows.repartition(*place).sortWithinPartitions(*place)
                .select(*place, "fp", "own").mapInArrow(verify, "u BIGINT, v BIGINT"))

    limit = group if radius <= STAR_RADIUS else block
    few, many = F.col("size") <= limit, F.col("size") > limit
    small = verified(joined.where(few).withColumn("pair", F.lit(0).cast("bigint")))
    if radius > STAR_RADIUS:
        return small.union(verified(_block_pairs(joined.where(many), block)))

    flips = _star_keys(radius)

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy().astype("<i8")
            for lo in range(0, len(fp), 1024):
                some = fp[lo:lo + 1024]
                keys = some.view("<u8")[:, None] ^ flips[None, :]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel().view("<i8")),
                     pa.array(np.repeat(some, len(flips)))], names=["star", "fp"])

    meeting = (joined.where(F.col("size") > group).select("fp").distinct()
               .mapInArrow(stars, "star BIGINT, fp BIGINT")
               .groupBy("star").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1))
    least = meeting.select(F.explode("fps").alias("u"), F.array_min("fps").alias("v"))
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius
    large = least.where((F.col("u") != F.col("v")) & near)
    return small.union(large)


def _block_pairs(rows: DataFrame, block: int) -> DataFrame:
    """Rows of large keys dealt to every pair of blocks they belong to: ``pair`` numbers it."""
    blocks = F.ceil(F.col("size") / block)
    mine = F.pmod(F.xxhash64("fp"), blocks)
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)).alias("other")
    dealt = rows.select("*", mine.alias("mine"), blocks.alias("blocks"), other)
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    return dealt.select("part", "key", "fp", "own",
                        (low * F.col("blocks") + high).cast("bigint").alias("pair"))


def classes(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fp, root: the component of every fingerprint in ``prints`` (fp, any rows)."""
    spark: SparkSession = prints.sparkSession
    prepare(spark)
    nodes = written(prints.select("fp").distinct())
    folder = f"{checkpoint_dir(spark)}/links-{uuid4().hex}"
    found = components(links(nodes, folder, radius))  # checkpointed
    remove_path(spark, folder)
    found = found.select(
        F.col("node").alias("c_node"), F.col("root").alias("c_root"))
    return nodes.join(found, F.col("fp") == F.col("c_node"), "left").select(
        "fp", F.coalesce("c_root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, words: int = SHINGLE) -> DataFrame:
    """doc_id, fp (signed long), component_id of every row."""
    rows = written(with_fingerprint(docs, words, docs["doc_id"].alias("doc_id")))
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    rooted = classes(rows, radius).select(F.col("fp").alias("k_fp"), "root")
    named = rooted.join(least, F.col("k_fp") == F.col("fp")).select("k_fp", "root", "least")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id")).select(
        F.col("root").alias("i_root"), "component_id")
    by_fp = named.join(ids, F.col("root") == F.col("i_root")).select("k_fp", "component_id")
    return rows.join(by_fp, F.col("fp") == F.col("k_fp")).select("doc_id", "fp", "component_id")


def _shingle_sets(members: DataFrame, words: int) -> DataFrame:
    """``members`` with text replaced by shingles, the hashes of its set of shingles."""
    rest = members.drop("text").schema
    names = rest.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sets = [np.unique(np.concatenate([
                    np.zeros(0, "<u8"), *shingle_hashes(x.as_py(), words)])).view("<i8")
                    for x in part.column("text")]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in names], pa.array(sets, pa.list_(pa.int64()))],
                    names=[*names, "shingles"])

    return members.mapInArrow(
        run, StructType([*rest, StructField("shingles", ArrayType(LongType()))]))


def _how_common(sets: DataFrame) -> np.ndarray:
    """How often shingles of each of ``BUCKETS`` buckets occur. It only orders shingles, so
    that the rare ones come first; any order gives the same result."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            n += np.bincount(_bucket(batch.column("shingles").flatten().to_numpy()),
                             minlength=BUCKETS)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int64()), pa.array(n[used])], names=["bucket", "n"])

    found = (sets.select("shingles").mapInArrow(count, "bucket BIGINT, n BIGINT")
             .groupBy("bucket").agg(F.sum("n").alias("n")).toArrow())
    out = np.zeros(BUCKETS, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles.astype("<i8").view("<u8") % np.uint64(BUCKETS)).astype(np.int64)


def _rare(sets: DataFrame, similarity: float) -> DataFrame:
    """root, doc_id, place, n (shingles), token: the rarest shingles of each member, so many
    that two members with ``similarity`` have at least one of them in common."""
    common = _how_common(sets)
    rest = sets.select("root", "doc_id", "place").schema
    names = rest.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sizes, tokens = [], []
                for x in part.column("shingles"):
                    held = x.values.to_numpy()
                    first = int(len(held) * (1 - similarity) + 1e-6) + 1
                    order = np.lexsort((held, common[_bucket(held)]))
                    sizes.append(len(held))
                    # Members without words meet at one token.
                    tokens.append(held[order[:first]] if len(held) else np.zeros(1, np.int64))
                at = np.repeat(np.arange(len(sizes)), [len(t) for t in tokens])
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c).take(pa.array(at)) for c in names],
                     pa.array(np.array(sizes, np.int64)[at]),
                     pa.array(np.concatenate([np.zeros(0, np.int64), *tokens]))],
                    names=[*names, "n", "token"])

    return sets.select(*names, "shingles").mapInArrow(
        run, StructType([*rest, StructField("n", LongType()), StructField("token", LongType())]))


def _entries(rare: DataFrame, work: Scratch) -> DataFrame:
    """root, token, rank: tokens that several members have. The least rank is decided first:
    the fewest tokens of its own (so the original of many copies), then the least doc_id."""
    rare = work.written(rare)
    several = (rare.groupBy("root", "token").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
               .select(F.col("root").alias("k_root"), F.col("token").alias("k_token")))
    met = (rare.join(several, (F.col("root") == F.col("k_root"))
                     & (F.col("token") == F.col("k_token")))
           .groupBy("place").agg(F.first("root").alias("root"), F.first("doc_id").alias("doc_id"),
                                 F.first("n").alias("n"), F.collect_list("token").alias("tokens")))
    rank = F.struct((-F.size("tokens") / F.greatest("n", F.lit(1))).alias("few"),
                    F.col("doc_id").isNull().alias("none"), "doc_id", "place", "n")
    return met.select("root", F.explode("tokens").alias("token"), rank.alias("rank"))


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a and b, ranks) whose shingles have ``similarity`` in common."""
    least, most = F.least("a.n", "b.n"), F.greatest("a.n", "b.n")
    pairs = pairs.where(least >= most * F.lit(similarity)).distinct()
    for side in ("a", "b"):
        own = sets.select(F.col("place").alias(f"{side}_place"),
                          F.col("shingles").alias(f"{side}_shingles"))
        pairs = pairs.join(own, F.col(side)["place"] == F.col(f"{side}_place"))
    common = F.size(F.array_intersect("a_shingles", "b_shingles"))
    every = F.size("a_shingles") + F.size("b_shingles") - common
    return pairs.where(common >= every * F.lit(similarity)).select("a", "b")


def _places(ranks: DataFrame, side: str) -> DataFrame:
    return ranks.select(F.col(side)["place"].alias("gone")).distinct()


def _similar_places(owners: list[np.ndarray], block: np.ndarray,
                    similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """i < j of similar members, given their shingles; only pairs of different blocks where
    there are two."""
    m = len(owners)
    sizes = np.array([len(x) for x in owners])
    at = np.repeat(np.arange(m), sizes)
    _, token, times = np.unique(np.concatenate(owners), return_inverse=True, return_counts=True)
    shared = times[token] > 1  # a shingle of one member is in no pair's common part
    at, token = at[shared], np.unique(token[shared], return_inverse=True)[1]
    common = np.zeros((m, m), np.float32)
    step = max(1, CELLS // m)
    order = np.argsort(token, kind="stable")
    at, token = at[order], token[order]
    for lo in range(0, int(token[-1]) + 1 if len(token) else 0, step):
        some = slice(*np.searchsorted(token, [lo, lo + step]))
        holds = np.zeros((m, step), np.float32)
        holds[at[some], token[some] - lo] = 1
        common += holds @ holds.T
    every = sizes[:, None] + sizes[None, :] - common
    near = (common >= every * similarity) & (np.arange(m)[:, None] < np.arange(m)[None, :])
    if block.min() != block.max():
        near &= block[:, None] != block[None, :]
    return np.nonzero(near)


def _by_blocks(large: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """a, b: places of similar members in large groups (root, token, rank, k)."""
    blocks = F.ceil(F.col("k") / MEMBERS)
    place = F.col("rank")["place"]
    mine = F.pmod(F.xxhash64(place), blocks)
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)).alias("other")
    dealt = large.select("root", "token", "rank", place.alias("place"), mine.alias("mine"),
                         blocks.alias("blocks"), other)
    pair = (F.least("mine", "other") * F.col("blocks") + F.greatest("mine", "other")).cast("bigint")
    own = sets.select(F.col("place").alias("o_place"), "shingles")
    key = ["root", "token", "pair"]
    rows = (dealt.withColumn("pair", pair).join(own, F.col("place") == F.col("o_place"))
            .repartition(*key).sortWithinPartitions(*key, "rank")
            .select(*key, "mine", "place", "shingles"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, places, mines, owners = None, [], [], []

        def done():
            i, j = _similar_places(owners, np.array(mines), similarity)
            at = np.array(places)
            return pa.RecordBatch.from_arrays([pa.array(at[i]), pa.array(at[j])], names=["a", "b"])

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in key), strict=True))
            for here, own, place, x in zip(keys, batch.column("mine").to_pylist(),
                                           batch.column("place").to_pylist(),
                                           batch.column("shingles"), strict=True):
                if here != held:
                    if places:
                        yield done()
                    held, places, mines, owners = here, [], [], []
                places.append(place)
                mines.append(own)
                owners.append(np.array(x.values.to_numpy()))
        if places:
            yield done()

    return rows.mapInArrow(run, "a BIGINT, b BIGINT")


def _near_pairs(left: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """a, b: places of similar members that share a token; a has the least rank."""
    sizes = left.groupBy(F.col("root").alias("c_root"), F.col("token").alias("c_token")).agg(
        F.count(F.lit(1)).alias("k"))
    counted = left.join(sizes, (F.col("root") == F.col("c_root"))
                        & (F.col("token") == F.col("c_token"))).select("root", "token", "rank", "k")
    small = counted.where(F.col("k") <= PAIR_GROUP)
    other = small.select(F.col("root").alias("o_root"), F.col("token").alias("o_token"),
                         F.col("rank").alias("b"))
    met = small.join(other, (F.col("root") == F.col("o_root"))
                     & (F.col("token") == F.col("o_token")) & (F.col("rank") < F.col("b")))
    few = _similar(met.select(F.col("rank").alias("a"), "b"), sets, similarity).select(
        F.col("a")["place"].alias("a"), F.col("b")["place"].alias("b"))
    many = _by_blocks(counted.where(F.col("k") > PAIR_GROUP), sets, similarity)
    return few.union(many).distinct()


def _all_pairs(left: DataFrame, sets: DataFrame, similarity: float,
               work: Scratch) -> list[DataFrame]:
    """Tables of ``gone``: all pairs that share a token are compared at once; then, round by
    round, members without a similar one of less rank stay and those similar to them go."""
    near = work.written(_near_pairs(left, sets, similarity))
    out = []
    while not near.isEmpty():
        under = near.select(F.col("b").alias("u")).distinct()
        tops = near.join(under, F.col("a") == F.col("u"), "left_anti")
        gone = work.written(tops.select(F.col("b").alias("gone")).distinct())
        out.append(gone)
        near = near.join(gone, F.col("a") == F.col("gone"), "left_anti")
        near = work.written(near.join(gone, F.col("b") == F.col("gone"), "left_anti"))
    return out


def _copies(sets: DataFrame, similarity: float, work: Scratch) -> DataFrame | None:
    """gone: the places of members similar to one that stays. Members are decided by rank:
    one stays unless it is similar to one that stays, until no member is undecided.

    In a round the member of least rank among the undecided of a token is its first. Who is
    first at all its tokens stays and is compared with those it meets there, so that a group
    of many copies is thinned without pairs among them. Once the pairs left that share a token
    are no more than ``PAIRS`` for each entry there was at first, they are all compared; the
    result is the same.
    """
    room = None
    left = work.written(_entries(_rare(sets, similarity), work))
    out: list[DataFrame] = []
    while True:
        groups = work.written(left.groupBy("root", "token").agg(
            F.min("rank").alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1"))
        entries, pairs = groups.agg(F.sum("k"), F.sum(F.col("k") * (F.col("k") - 1) / 2)).first()
        if not entries:
            break
        room = room or entries * PAIRS
        if pairs <= room:
            out += _all_pairs(left, sets, similarity, work)
            break
        heads = groups.select(F.col("root").alias("g_root"), F.col("token").alias("g_token"),
                              "first")
        led = work.written(left.join(heads, (F.col("root") == F.col("g_root"))
                                & (F.col("token") == F.col("g_token")))
                      .select("root", "token", "rank", "first"))
        own = F.col("first")["place"] == F.col("rank")["place"]
        stays = work.written(led.groupBy(F.col("rank")["place"].alias("stay")).agg(
            F.every(own).alias("all")).where("all").select("stay"))
        met = led.where(~own).join(stays, F.col("first")["place"] == F.col("stay")).select(
            F.col("first").alias("a"), F.col("rank").alias("b"))
        gone = work.written(_places(_similar(met, sets, similarity), "b"))
        out.append(gone)
        place = F.col("rank")["place"]
        left = led.join(stays, place == F.col("stay"), "left_anti")
        left = work.written(left.join(gone, place == F.col("gone"), "left_anti").select(
            "root", "token", "rank"))
    whole = None
    for gone in out:
        whole = gone if whole is None else whole.union(gone)
    return whole


def one_of_each(docs: DataFrame, radius: int = FILTER_RADIUS, words: int = FILTER_WORDS,
                shingle_words: int = SHINGLE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without near copies: of documents in one component of the filter, those whose
    shingles have at least ``similarity`` in common with one that stays go. Documents
    without words are each other's copies."""
    rows = written(with_fingerprint(
        docs, words, rows_as(docs), docs["doc_id"].alias("doc_id"),
        F.monotonically_increasing_id().alias("place")))
    rooted = classes(rows, radius).select(F.col("fp").alias("k_fp"), "root")
    counts = rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n"))
    shared = (counts.join(rooted, F.col("fp") == F.col("k_fp")).groupBy("root")
              .agg(F.sum("n").alias("n")).where(F.col("n") > 1)
              .select(F.col("root").alias("s_root")))
    wanted = small_side(
        rooted.join(shared, F.col("root") == F.col("s_root")).select("k_fp", "root"))
    members = rows.join(wanted, F.col("fp") == F.col("k_fp")).select(
        "root", "place", "doc_id", "fp", text_of_row(F.col("row")).alias("text"))
    with Scratch(docs.sparkSession) as work:
        sets = work.written(_shingle_sets(members, shingle_words).select(
            "root", "place", "doc_id", "shingles"))
        gone = _copies(sets, similarity, work)
        gone = None if gone is None else small_side(gone)  # written by itself
    kept = rows if gone is None else rows.join(
        gone, F.col("place") == F.col("gone"), "left_anti")
    return kept.select("row.*")


def text_of_row(row):
    return F.coalesce(row["text"].cast("string"), F.lit(""))
