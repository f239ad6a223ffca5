"""N-gram Jaccard join by vertical partitioning of a global n-gram order.

The order of all n-grams (a digest order, with n-grams found to be common put last where single n-grams
are used) is cut into fragments. Two sets above the threshold differ in at most ``d`` n-grams, so of their
fragments all but ``d`` are equal: each set gives digests of its first ``d + 1`` usable fragments (two
n-grams or more, not all of them common), and similar sets share one. A set with too few usable fragments
gives its rarest single n-grams as well, enough that two such sets share one.

Sets are compared where they share a key. Keys of few sets give pairs; a parity sketch drops the pairs
that differ too much, and what is left is verified in rounds, one pair per set and round, leaving out
pairs that are connected already. Keys of many sets join their sets into clusters; these are compared
block against block, and a task returns a spanning forest of the links it finds, never all pairs. Both
ways count the overlap per fragment of the order and sum over fragments. Nothing is left out: sketch and
keys only drop pairs that cannot reach the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsift.llm.common import batch_texts, cut_lineage, own_columns, slices, tidied, trim
from quillsift.llm.graph import components
from quillsift.llm.shingles import mixed, shingle_sets

#: Bits of the parity sketch and of the presence bitmap of wanted documents (1 MB); both of fixed size.
SKETCH_BITS, PRESENCE_BITS = 512, 1 << 23

#: Bits of the bitmap of n-grams that may be common (4 MB), and the most n-grams that a task counts at once.
COMMON_BITS, TOGETHER = 1 << 25, 4_000_000


@dataclass(frozen=True)
class Threshold:
    """Similarity of at least ``over / under``, in whole numbers."""

    over: int = 85
    under: int = 100

    def differences(self, a, b):
        """The most n-grams in which sets of sizes a and b may differ."""
        return (self.under - self.over) * (a + b) // (self.under + self.over)

    def most_differences(self, n: int) -> int:
        return self.differences(n, n * self.under // self.over)

    def prefix(self, n: int) -> int:
        return n + (-n * self.over // self.under) + 1

    def differences_column(self, a: Column, b: Column) -> Column:
        return F.floor((a + b) * (self.under - self.over) / F.lit(self.under + self.over))


def signature(grams: np.ndarray, salt: int) -> tuple[int, int]:
    """128 bits of a set, as two signed words."""
    sums = [int(mixed(grams, 2 * salt + i + 100).sum(dtype=np.uint64)) for i in (0, 1)]
    return tuple(x - (1 << 64) if x >> 63 else x for x in sums)


def sketch(grams: np.ndarray) -> bytes:
    """Parities of the numbers of n-grams per bit: two sketches differ in no more bits than the sets in n-grams."""
    bits = np.bincount((grams >> np.uint64(20)) % np.uint64(SKETCH_BITS), minlength=SKETCH_BITS) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def _levels(n: int, threshold: Threshold) -> list[int]:
    """Size classes [2^j, 2^(j+1)) in which a set of n meets its partners: its own, and the next if they reach it."""
    own = n.bit_length() - 1
    return [own, own + 1] if n * threshold.under // threshold.over >= 2 << own else [own]


def keys(grams: np.ndarray, threshold: Threshold, common: np.ndarray) -> np.ndarray:
    """Digests under which the set meets every similar set."""
    n = len(grams)
    rare = np.ones(n, dtype=bool)
    if len(common):
        rare = common[np.minimum(np.searchsorted(common, grams), len(common) - 1)] != grams
    need = threshold.most_differences(n) + 1
    out, enough = [], True
    for level in _levels(n, threshold):
        fragments = max(1, (1 << level) // 2)
        # The upper 32 bits cut the order into equal ranges.
        fragment = ((grams >> np.uint64(32)) * np.uint64(fragments)) >> np.uint64(32)
        starts = np.flatnonzero(np.concatenate([[True], fragment[1:] != fragment[:-1]]))
        sizes = np.diff(np.concatenate([starts, [n]]))
        usable = (sizes >= 2) & (np.add.reduceat(rare, starts) > 0)
        content = np.add.reduceat(mixed(grams, level + 1), starts)
        chosen = mixed(content + fragment[starts], 50 + level)[usable]
        enough &= len(chosen) >= need
        out.append(chosen[:need])
    if not enough:
        order = np.concatenate([grams[rare], grams[~rare]])
        out.append(mixed(order[: threshold.prefix(n)], 49))
    return np.concatenate(out)


def _per_set(docs: DataFrame, n: int, make, schema: str) -> DataFrame:
    """Run ``make(ids, sets) -> RecordBatch`` over whole texts, a few megabytes at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch_texts(batch.column(1))
            for at, to in slices(map(len, texts), 1_000_000):
                yield make(batch.column(0).slice(at, to - at), shingle_sets(texts[at:to], n))

    return docs.mapInArrow(tidied(run), schema)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _nodes(docs: DataFrame, n: int, salt: int) -> DataFrame:
    def make(ids: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
        signed = [signature(s, salt) for s in sets]
        return pa.RecordBatch.from_arrays(
            [
                ids,
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([x for x, _ in signed], pa.int64()),
                pa.array([y for _, y in signed], pa.int64()),
            ],
            names=["doc_id", "n", "node", "more"],
        )

    return _per_set(docs, n, make, "doc_id long, n long, node long, more long")


def _often(sets: list[np.ndarray], share: float) -> np.ndarray:
    """The n-grams in at least ``share`` of some sets, at least one; in random order, as digests are."""
    grams, counts = np.unique(np.concatenate([np.empty(0, np.uint64), *sets]), return_counts=True)
    return grams[counts >= share * len(sets) * (1 - 1e-9)]


def _common(docs: DataFrame, rows: int, n: int, share: float, least: int, most: int) -> np.ndarray:
    """N-grams in at least ``least`` documents and ``share`` of all, the most frequent ones, by exact counts.

    What has the share of all documents has it of some stretch of documents too, so a first pass marks the n-grams
    that are that frequent in any stretch, and only marked ones are counted.
    """
    need = max(least, share * rows)
    counts = _counts_of_marked(docs, rows, n, need / max(1, rows)).groupBy("gram").agg(F.sum("n").alias("count"))
    found = counts.where(F.col("count") >= need).orderBy(F.desc("count"), "gram").limit(most).select("gram").toArrow().column(0)
    return np.sort(found.to_numpy().view(np.uint64))


def _counts_of_marked(docs: DataFrame, rows: int, n: int, part: float) -> DataFrame:
    """(gram, n): counts, by parts of tasks, of at least the n-grams that have the share ``part`` of some stretch."""
    wide = int(4 / part)
    # In fewer documents than a stretch every n-gram has the share, so tasks with few documents are joined.
    docs = docs.coalesce(max(1, rows // max(1, wide)))

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = np.zeros(COMMON_BITS, dtype=bool)
        held, some, size = [], [], 0

        def mark(sets: list[np.ndarray]) -> None:
            if sets:
                marked[_often(sets, part) % np.uint64(COMMON_BITS)] = True

        for batch in batches:
            texts = batch_texts(batch.column(1))
            for at, to in slices(map(len, texts), 1_000_000):
                for own in shingle_sets(texts[at:to], n):
                    some.append(own)
                    size += len(own)
                    if size >= TOGETHER or len(some) >= wide:
                        mark(held)
                        held, some, size = some, [], 0
        # In a short stretch every n-gram is frequent, so the rest joins the stretch before it.
        mark(held + some)
        places = np.flatnonzero(marked.reshape(-1, 32768).any(axis=1))
        bits = [np.packbits(marked[i * 32768 : (i + 1) * 32768]).tobytes() for i in places]
        yield pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), pa.array(bits, pa.binary())], names=["part", "bits"])

    # A row per part of the bitmap, whatever the number of tasks.
    parts = docs.mapInArrow(tidied(stretches), "part int, bits binary").groupBy("part").applyInArrow(_either, "part int, bits binary")
    marks = np.zeros(COMMON_BITS // 8, dtype=np.uint8)
    for row in parts.collect():
        marks[row["part"] * 4096 : (row["part"] + 1) * 4096] = np.frombuffer(bytes(row["bits"]), dtype=np.uint8)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            grams, counts = np.unique(np.concatenate([np.empty(0, np.uint64), *held]), return_counts=True)
            return pa.RecordBatch.from_arrays([_signed(grams), pa.array(counts, pa.int64())], names=["gram", "n"])

        for batch in batches:
            texts = batch_texts(batch.column(1))
            for at, to in slices(map(len, texts), 1_000_000):
                grams = np.concatenate([np.empty(0, np.uint64), *shingle_sets(texts[at:to], n)])
                bit = grams % np.uint64(COMMON_BITS)
                known = (marks[bit >> np.uint64(3)] >> (np.uint64(7) - (bit & np.uint64(7))).astype(np.uint8)) & 1 > 0
                held.append(grams[known])
                size += len(held[-1])
                if size >= TOGETHER:
                    yield counted()
                    held, size = [], 0
        yield counted()

    return docs.mapInArrow(tidied(count), "gram long, n long")


def _either(table: pa.Table) -> pa.Table:
    """One part of a bitmap from those of all tasks."""
    bits = np.zeros(4096, dtype=np.uint8)
    for own in table.column("bits").to_pylist():
        bits |= np.frombuffer(own, dtype=np.uint8)
    return pa.table({"part": table.column("part").slice(0, 1), "bits": pa.array([bits.tobytes()], pa.binary())})


def _keyed(docs: DataFrame, n: int, salt: int, threshold: Threshold, common: np.ndarray) -> DataFrame:
    def make(ids: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
        full = [s for s in sets if len(s)]
        own = [keys(s, threshold, common) for s in full]
        nodes = np.repeat(np.array([signature(s, salt)[0] for s in full], dtype=np.int64), [len(k) for k in own])
        return pa.RecordBatch.from_arrays(
            [_signed(np.concatenate([np.empty(0, np.uint64), *own])), pa.array(nodes)], names=["key", "node"]
        )

    return _per_set(docs, n, make, "key long, node long")


def _presence(ids: DataFrame) -> np.ndarray:
    """A bitmap of hashed ids, built in parts of 4 kB; of one size whatever the number of ids."""
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(PRESENCE_BITS))
    parts = ids.groupBy(F.floor(bit / 32768).alias("part")).agg(F.bitmap_construct_agg(bit % 32768).alias("bits"))
    out = np.zeros(PRESENCE_BITS // 8, dtype=np.uint8)
    for row in parts.collect():
        out[row["part"] * 4096 : (row["part"] + 1) * 4096] = np.frombuffer(bytes(row["bits"]), dtype=np.uint8)
    return out


def _sets(docs: DataFrame, wanted: DataFrame, n: int, salt: int, fragments: int) -> DataFrame:
    """(node, n, sketch, grams: one binary per fragment of the order) of the wanted (doc_id, node).

    The ids only tell which texts to read, and rows without an id are all read; a set belongs to the
    node of its own digest.
    """
    presence = _presence(wanted.where("doc_id is not null"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = batch.column(2).fill_null(-1).to_numpy()
            known = ((presence[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(bool)
            kept = batch.filter(pa.array(known | (bit < 0)))
            texts = batch_texts(kept.column(1))
            for at, to in slices(map(len, texts), 1_000_000):
                sets = shingle_sets(texts[at:to], n)
                cut = []
                for s in sets:
                    fragment = ((s >> np.uint64(32)) * np.uint64(fragments)) >> np.uint64(32)
                    ends = np.searchsorted(fragment, np.arange(1, fragments))
                    cut.append([x.tobytes() for x in np.split(s, ends)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([signature(s, salt)[0] for s in sets], pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([sketch(s) for s in sets], pa.binary()),
                        pa.array(cut, pa.list_(pa.binary())),
                    ],
                    names=["node", "n", "sketch", "grams"],
                )

    bit = F.when(F.col("doc_id").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.lit(PRESENCE_BITS))).alias("bit")
    read = docs.select("doc_id", "text", bit)
    found = read.mapInArrow(tidied(run), "node long, n long, sketch binary, grams array<binary>")
    return found.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def _overlap(a: list[bytes], b: list[bytes]) -> int:
    """Partial overlaps of two sets per fragment, summed."""
    return sum(
        len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
        for x, y in zip(a, b)
    )


def _linked(pairs: DataFrame, sets: DataFrame, threshold: Threshold) -> DataFrame:
    """The pairs (a, b) of nodes whose sets reach the threshold."""
    own = sets.select("node", "n", "grams")
    both = pairs.join(own.toDF("a", "n", "grams"), "a").join(own.toDF("b", "m", "others"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            keep = []
            for r in rows:
                shared = _overlap(r["grams"], r["others"])
                keep.append(threshold.under * shared >= threshold.over * (r["n"] + r["m"] - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "n", "m", "grams", "others").mapInArrow(tidied(run), "a long, b long")


def _forest(table: pa.Table, threshold: Threshold) -> pa.Table:
    """A spanning forest of the links between the blocks of one cell, cluster by cluster."""
    a, b = [], []
    clusters = table.column("cluster").to_numpy()
    order = np.argsort(clusters, kind="stable")
    clusters = clusters[order]
    table = table.take(pa.array(order))
    for part in np.split(np.arange(len(clusters)), np.flatnonzero(np.diff(clusters)) + 1):
        if not len(part):
            continue
        own = table.slice(int(part[0]), len(part))
        nodes, sizes = own.column("node").to_numpy(), own.column("n").to_numpy()
        side = own.column("side").to_numpy()
        left, right = np.flatnonzero(side != 2), np.flatnonzero(side != 1)
        # Side 0 stands on both sides: a block against itself. The other block of a pair may have no sets.
        if not len(left) or not len(right):
            continue
        grams = own.column("grams").to_pylist()
        shared = np.zeros((len(left), len(right)), dtype=np.int64)
        for f in range(len(grams[0])):  # partial counts per fragment of the order, summed per pair
            columns = [np.frombuffer(grams[j][f], np.uint64) for j in right]
            values = np.concatenate(columns)
            owners = np.repeat(np.arange(len(right)), [len(c) for c in columns])
            by_value = np.argsort(values, kind="stable")
            values, owners = values[by_value], owners[by_value]
            for row, i in enumerate(left):
                mine = np.frombuffer(grams[i][f], np.uint64)
                lo, hi = np.searchsorted(values, mine), np.searchsorted(values, mine, side="right")
                count = hi - lo
                if count.sum():
                    at = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
                    shared[row] += np.bincount(owners[at], minlength=len(right))
        union = sizes[left][:, None] + sizes[right][None, :] - shared
        links = np.argwhere((threshold.under * shared >= threshold.over * union) & (nodes[left][:, None] != nodes[right][None, :]))
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.get(x, x) != x:
                parent[x] = parent.get(parent[x], parent[x])
                x = parent[x]
            return x

        for row, column in links.tolist():
            x, y = int(nodes[left[row]]), int(nodes[right[column]])
            rx, ry = root(x), root(y)
            if rx != ry:
                parent[max(rx, ry)] = min(rx, ry)
                a.append(x)
                b.append(y)
    trim()
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


#: N-grams of a block, or of the clusters that share a cell; cells for small clusters at least.
BLOCK_GRAMS, CELLS = 2_000_000, 64


def _block_links(hot: DataFrame, sets: DataFrame, threshold: Threshold, block: int) -> DataFrame:
    """Links of the sets of large clusters (cluster, node), block against block.

    A block has about ``block`` sets and ``BLOCK_GRAMS`` n-grams at most, unless a single set has more.
    """
    own_sizes = hot.join(sets.select("node", "n"), "node")
    enough = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / BLOCK_GRAMS))
    sizes = cut_lineage(own_sizes.groupBy("cluster").agg(enough.alias("blocks"), F.sum("n").alias("total")))
    together = sizes.where("blocks = 1").agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    dealt = hot.join(sizes, "cluster").join(sets.select("node", "n", "grams"), "node")
    blocks = F.col("blocks")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    # Clusters of one block share cells, as many as their n-grams need; larger ones have a cell for each pair of blocks.
    small = F.pmod(F.xxhash64("cluster"), F.lit(max(CELLS, -(-together // BLOCK_GRAMS)))).cast("long")
    ids = F.sequence(F.lit(0), (blocks - 1).cast("int"))

    def cell(other: Column) -> Column:
        return F.struct(
            F.when(blocks > 1, F.col("cluster")).otherwise(small).alias("cell"),
            F.least(own, other).alias("i"),
            F.greatest(own, other).alias("j"),
            F.when(own == other, 0).when(own < other, 1).otherwise(2).alias("side"),
        )

    cells = dealt.withColumn("at", F.explode(F.transform(ids, cell)))
    return (
        cells.select("at.cell", "at.i", "at.j", "at.side", "cluster", "node", "n", "grams")
        .groupBy("cell", "i", "j")
        .applyInArrow(lambda t: _forest(t, threshold), "a long, b long")
    )


def _round(pairs: DataFrame, sets: DataFrame, threshold: Threshold, every: bool) -> tuple[DataFrame, DataFrame]:
    """Verify one pair per node (or every pair); the links, and the pairs that are still to be verified."""
    chosen = pairs if every else pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    chosen = cut_lineage(chosen)
    links = cut_lineage(_linked(chosen, sets, threshold))
    return links, pairs.join(chosen, ["a", "b"], "left_anti")


def _outside(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends are not in one component."""
    mine = F.coalesce("la", F.col("a")) != F.coalesce("lb", F.col("b"))
    named = pairs.join(labels.toDF("a", "la"), "a", "left").join(labels.toDF("b", "lb"), "b", "left")
    return named.where(mine).select("a", "b")


def similar_groups(
    docs: DataFrame,
    n: int = 5,
    threshold: Threshold = Threshold(80, 100),
    few: int = 64,
    block: int = 512,
    fragments: int = 8,
    common_share: float = 3 / 4000,
    common_least: int = 3,
    most_common: int = 500_000,
    rounds: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per row: ``doc_id``, ``n_shingles`` (the size of its set) and ``component_id``.

    A set holds the distinct word n-grams of a whole text; a shorter text is one n-gram; a null or empty
    text, or one without words, has an empty set and is linked with nothing. Two rows are linked when
    their sets reach the threshold; ``component_id`` is the smallest id reachable. Equal sets are one node
    from the start, so copies never meet as pairs. Rows of one id are separate sets with that id; a null
    id takes part but is never the smallest. Other columns are not read; an empty table gives no rows.

    N-grams in ``common_share`` of all rows (``common_least`` at least) are put last in the order, ``most_common`` at
    most; they decide the order alone and so not the result.
    """
    docs = own_columns(docs, id_col, text_col)
    for salt in range(8):
        rows = cut_lineage(_nodes(docs, n, salt))
        classes = cut_lineage(
            rows.where("n > 0").groupBy("node", "more", "n").agg(F.min("doc_id").alias("doc_id"))
        )
        if classes.groupBy("node").count().where("count > 1").isEmpty():  # else 64 bits have met: other digests
            break
    else:
        raise RuntimeError("set digests collide under every salt")
    common = _common(docs, rows.count(), n, common_share, common_least, most_common)
    keyed = cut_lineage(_keyed(docs, n, salt, threshold, common))
    shared = cut_lineage(
        keyed.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most")
    )
    members = cut_lineage(keyed.join(shared, "key").select("key", "node", "least").distinct())
    counts = members.groupBy("key").count()
    hot_keys = members.join(counts.where(F.col("count") > few).select("key"), "key")
    clusters = components(hot_keys.select(F.col("least").alias("a"), F.col("node").alias("b")))
    hot = cut_lineage(clusters.select(F.col("component").alias("cluster"), "node"))
    some = members.join(counts.where(F.col("count") <= few).select("key"), "key").select("key", "node")
    close = some.toDF("key", "a").join(some.toDF("key", "b"), "key").where("a < b").select("a", "b").distinct()
    sizes = classes.select("node", F.col("n"))
    # Sizes that are too far apart cannot be similar; the sketch comes with the sets.
    close = close.join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b")
    least, most = F.least("na", "nb"), F.greatest("na", "nb")
    close = cut_lineage(close.where(threshold.under * least >= threshold.over * most))
    nodes = close.select(F.col("a").alias("node")).union(close.select("b")).union(hot.select("node")).distinct()
    wanted = cut_lineage(nodes.join(classes, "node").select("doc_id", "node"))
    sets = cut_lineage(_sets(docs, wanted, n, salt, fragments))
    links = cut_lineage(_block_links(hot, sets, threshold, block))
    marks = sets.select("node", "sketch")
    pairs = close.join(marks.toDF("a", "sa"), "a").join(marks.toDF("b", "sb"), "b")
    differ = sum(
        F.bit_count(
            F.conv(F.hex(F.substring("sa", 8 * i + 1, 8)), 16, -10).cast("long").bitwiseXOR(
                F.conv(F.hex(F.substring("sb", 8 * i + 1, 8)), 16, -10).cast("long")
            )
        )
        for i in range(SKETCH_BITS // 64)
    )
    pairs = cut_lineage(
        pairs.where(differ <= threshold.differences_column(F.col("na"), F.col("nb"))).select("a", "b")
    )
    labels = components(links)
    for turn in range(rounds):
        pairs = cut_lineage(_outside(pairs, labels))
        if pairs.isEmpty():
            break
        found, pairs = _round(pairs, sets, threshold, turn == rounds - 1)
        links = cut_lineage(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).union(found))
        labels = components(links)
    named = classes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    groups = named.join(smallest, "component").select("node", "component_id")
    return rows.join(groups, "node", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )
