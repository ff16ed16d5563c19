"""Near-duplicates by SimHash: a vantage-point tree over Hamming distance deals the fingerprints into shards.

1. Every whole text gets a 64-bit fingerprint from its word shingles.
2. Equal fingerprints are one node from here on, however many documents carry them.
3. A vantage-point tree is grown on a sample of the nodes.  Each inner node holds a fingerprint and a
   radius; what lies within the radius goes left.  The leaves are the shards.
4. A fingerprint belongs to one leaf and visits each later leaf that its ball of ``bits`` reaches: a
   branch is entered only if the triangle inequality can't rule out a neighbour there.  So any linked
   pair meets in exactly one shard, whatever the sample was; it only shapes the shards.
5. A shard holds its own fingerprints and reads the visitors as a stream.  It returns a spanning forest
   of the links that it finds, at most one link per fingerprint, never all pairs.
6. Components come from minimum labels with pointer jumping over these links, in rounds that are
   written to the shared folder.

Only the sample (``sample_per_leaf`` fingerprints a leaf, at most ``MOST_SAMPLED``) reaches the driver.

Null and empty texts have fingerprint zero and are linked like any other.  Every input row is a
document: rows may repeat, and a repeated id with another text is another document.  ``component_id``
is the smallest id of the component that isn't null, or null if there is none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vozlake.llm.common import bounded_batches, materialize, unused

SHINGLE, BITS, SEED = 3, 2, 42
LEAF_ROWS, SAMPLE_PER_LEAF, MOST_SAMPLED = 1024, 32, 1 << 20
CANDIDATES = 24


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """A bit is 1 if it is 1 in over half the hashes of the shingles, repeats included; unsigned."""
    import xxhash

    # bytes.lower() and bytes.split() know ASCII alone, as the definition asks.
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, line = (ends - lengths).tolist(), b" ".join(words)
    last = ends[shingle - 1 :].tolist() or [len(line)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, last, strict=False)), np.uint64, len(last))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at : at + 8192].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def with_fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint", shingle: int = SHINGLE) -> DataFrame:
    """Add the fingerprint as a signed 64-bit number."""

    @F.pandas_udf(T.LongType())
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([signed(fingerprint(x, shingle)) for x in texts], dtype="int64")

    bounded_batches(df.sparkSession)
    return df.withColumn(out, of(F.col(f"`{text}`")))


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


# --- the tree ---------------------------------------------------------------------------------


@dataclass
class Tree:
    """Inner nodes as arrays; a child of ~k stands for leaf k."""

    vantage: np.ndarray
    radius: np.ndarray
    left: np.ndarray
    right: np.ndarray
    leaves: int

    def route(self, points: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(leaf, index of the point, whether it is the point's own leaf): own leaves and later leaves to visit."""
        found = []
        every = np.arange(len(points))
        todo = [(0 if len(self.vantage) else ~0, every, np.ones(len(points), bool))]
        own = np.zeros(len(points), np.int64)
        while todo:
            node, index, home = todo.pop()
            if not len(index):
                continue
            if node < 0:
                found.append((np.full(len(index), ~node), index, home))
                own[index[home]] = ~node
                continue
            distance = np.bitwise_count(points[index] ^ self.vantage[node]).astype(np.int64)
            inside = distance <= self.radius[node]
            near, far = distance - bits <= self.radius[node], distance + bits > self.radius[node]
            todo.append((self.left[node], index[near], (home & inside)[near]))
            todo.append((self.right[node], index[far], (home & ~inside)[far]))
        leaf, index, home = (np.concatenate(x) if found else np.zeros(0, kind) for x, kind in zip(zip(*found, strict=True) if found else ((), (), ()), (np.int64, np.int64, bool), strict=True))
        take = home | (leaf > own[index])
        return leaf[take], index[take], home[take]


def grow(sample: np.ndarray, leaves: int, bits: int) -> Tree:
    """Split the sample until there are about as many leaves.

    Of several vantage points and radii that leave both sides at least a quarter, the one whose shell of
    points that would go both ways is thinnest is taken."""
    vantage, radius, left, right = [], [], [], []
    size = max(2, -(-len(sample) // max(1, leaves)))
    count = 0

    def split(points: np.ndarray) -> tuple[int, int, np.ndarray] | None:
        best = None
        tries = points[np.linspace(0, len(points) - 1, min(CANDIDATES, len(points))).astype(int)]
        # Complements of points see the same shells; corners of the cube see other ones.
        for point in np.unique(tries):
            distance = np.bitwise_count(points ^ point).astype(np.int64)
            histogram = np.bincount(distance, minlength=65)
            below = np.cumsum(histogram)
            for r in range(64):
                lesser = min(below[r], len(points) - below[r])
                if lesser * 50 >= len(points):
                    # Beyond a quarter, thin shells count; where no cut leaves that much, the most even one does.
                    rank = (0, histogram[max(0, r - bits + 1) : r + bits + 1].sum()) if lesser * 4 >= len(points) else (1, -lesser)
                    if best is None or rank < best[0]:
                        best = (rank, int(point), r, distance <= r)
        return best and best[1:]

    def build(points: np.ndarray) -> int:
        nonlocal count
        cut = split(points) if len(points) > size else None
        if cut is None:
            count += 1
            return ~(count - 1)
        node = len(vantage)
        vantage.append(cut[0]), radius.append(cut[1]), left.append(0), right.append(0)
        left[node], right[node] = build(points[cut[2]]), build(points[~cut[2]])
        return node

    build(np.asarray(sample, np.uint64))
    return Tree(np.array(vantage, np.uint64), np.array(radius, np.int64), np.array(left, np.int64), np.array(right, np.int64), count)


# --- links inside a shard -----------------------------------------------------------------------


class Shard:
    """A shard's own fingerprints, and which of them are known to be connected."""

    def __init__(self, own: np.ndarray):
        self.own, self.root = own, np.arange(len(own))
        self.links: list[tuple[np.ndarray, np.ndarray]] = []

    def meet(self, points: np.ndarray, bits: int) -> None:
        """Link the points with the own fingerprints in reach: one link for a point, and what joins own ones."""
        rows = max(1, (1 << 20) // max(1, len(self.own)))
        for at in range(0, len(points), rows):
            part = points[at : at + rows]
            close = np.bitwise_count(part[:, None] ^ self.own[None, :]) <= bits
            for k in np.flatnonzero(close.any(axis=1)):
                roots = np.unique(self.root[close[k]])
                first = self.own[roots[0]]
                if len(roots) > 1:
                    self.links.append((self.own[roots[1:]], np.full(len(roots) - 1, first)))
                    self.root[np.isin(self.root, roots[1:])] = roots[0]
                if part[k] != first:
                    self.links.append((part[k : k + 1], np.array([first])))

    def table(self) -> pd.DataFrame:
        pairs, self.links = self.links, []
        a, b = (np.concatenate(x).astype(np.uint64).view(np.int64) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 2
        return pd.DataFrame({"a": a, "b": b})


def find_links(nodes: DataFrame, tree: Tree, bits: int = BITS) -> DataFrame:
    """Links (a, b) that connect what any pairs of ``nodes`` (column fp) within ``bits`` connect."""

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            points = batch["fp"].to_numpy(np.int64)
            leaf, index, home = tree.route(points.view(np.uint64), bits)
            yield pd.DataFrame({"leaf": leaf, "visits": (~home).astype(np.int8), "fp": points[index]})

    def linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, own, shard = None, [], None
        for batch in batches:  # sorted by leaf; a leaf's own fingerprints come first
            leaves = batch["leaf"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(leaves)) + 1).tolist(), len(leaves)]
            for start, end in zip(cuts, cuts[1:], strict=False):
                if start == end:
                    continue
                if leaves[start] != at:
                    if own:
                        shard = Shard(np.concatenate(own))
                        shard.meet(shard.own, bits)
                        yield shard.table()
                    at, own, shard = leaves[start], [], None
                points, visits = batch["fp"].to_numpy(np.int64)[start:end].view(np.uint64), batch["visits"].to_numpy()[start:end] == 1
                if not visits.all():
                    own.append(points[~visits])
                if visits.any() and (own or shard):
                    if shard is None:
                        shard = Shard(np.concatenate(own))
                        shard.meet(shard.own, bits)
                        own = []
                    shard.meet(points[visits], bits)
                    yield shard.table()
        if own:
            shard = Shard(np.concatenate(own))
            shard.meet(shard.own, bits)
            yield shard.table()

    bounded_batches(nodes.sparkSession)
    routed = nodes.select("fp").mapInPandas(dealt, "leaf long, visits byte, fp long")
    return routed.repartition("leaf").sortWithinPartitions("leaf", "visits").mapInPandas(linked, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(fp, root) for every fingerprint in ``links``: equal roots for connected ones, in a logarithm of rounds."""
    links = materialize(links, "links")
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = materialize(both.groupBy(F.col("a").alias("fp")).agg(F.min("b").alias("low")).select("fp", F.least("fp", "low").alias("root")), "labels")
    while True:
        lowest = both.join(labels.select(F.col("fp").alias("b"), "root"), "b").groupBy(F.col("a").alias("fp")).agg(F.min("root").alias("low"))
        hooked = labels.join(lowest, "fp").select("fp", "root", F.least("root", "low").alias("next"))
        # A root's own new root replaces it: the distance to the smallest label halves.
        jumps = hooked.select(F.col("fp").alias("next"), F.col("next").alias("far"))
        # What a root's members have found is told to the root, too.
        told = hooked.groupBy(F.col("root").alias("next")).agg(F.min("next").alias("told"))
        after = hooked.join(jumps, "next").join(told, "next", "left").select("fp", F.col("root").alias("before"), F.least("far", "told", "next").alias("root"))
        after = materialize(after, "labels")
        moved = after.where("root <> before").limit(1).count()
        labels = after.select("fp", "root")
        if not moved:
            return labels


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = BITS, shingle: int = SHINGLE, leaf_rows: int = LEAF_ROWS, sample_per_leaf: int = SAMPLE_PER_LEAF) -> DataFrame:
    """(id, text_hash, fp, component_id, root) for each row of ``docs``; equal roots make a group."""
    own = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("body"))
    prints = with_fingerprints(own, "body", "fp", shingle).select("id", F.xxhash64(F.coalesce("body", F.lit(""))).alias("text_hash"), "fp")
    prints = materialize(prints, "prints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("id").alias("low")), "nodes")
    leaves = max(1, nodes.count() // leaf_rows)
    sampled = min(leaves * sample_per_leaf, MOST_SAMPLED)
    sample = np.array([r.fp for r in nodes.orderBy(F.xxhash64("fp"), "fp").select("fp").limit(sampled).collect()], np.int64).view(np.uint64)
    labels = components(find_links(nodes, grow(sample, leaves, bits), bits))
    rooted = nodes.join(labels, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = materialize(rooted.join(lowest, "root").select("fp", "component_id", "root"), "named")
    return prints.join(named, "fp").select("id", "text_hash", "fp", "component_id", "root")


def keep_first(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The first row of each group in ``found`` (id, text_hash, root): smallest id (null first), then smallest text hash."""
    first = found.groupBy("root").agg(F.min(F.struct("id", "text_hash")).alias("first"))
    id_name, hash_name = unused(docs, "kept_id"), unused(docs, "kept_hash")
    kept = first.select(F.col("first.id").alias(id_name), F.col("first.text_hash").alias(hash_name))
    own = docs.withColumn(f"{hash_name}_own", F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))))
    both = own.join(kept, F.col(f"`{doc_id}`").eqNullSafe(F.col(id_name)) & (F.col(f"{hash_name}_own") == F.col(hash_name)))
    # Repeated rows agree in id and text.
    return both.dropDuplicates([id_name, hash_name]).select(*[F.col(f"`{c}`") for c in docs.columns])


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each group: the one with the smallest id (null first), then the smallest text hash."""
    return keep_first(docs, groups(docs, doc_id, text, **options), doc_id, text)


def digest(docs: DataFrame) -> DataFrame:
    return groups(docs.select("doc_id", "text")).select(F.col("id").alias("doc_id"), as_hex(F.col("fp")).alias("fingerprint"), "component_id")
