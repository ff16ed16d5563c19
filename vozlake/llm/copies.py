"""Near copies: all pairs of texts whose sets of word shingles have a Jaccard similarity of 0.8 or more, and their components.

1. Every whole text gives the set of its shingles' 64-bit hashes.  Equal sets are one node from here on.
2. Candidates share a band of minimum hashes.  With 40 bands of 8 a pair of similarity 0.8 is missed with
   probability (1 - 0.8^8)^40 = 6e-4, one of 0.85 with 5e-6; of pairs of 0.5, 14 % meet.
3. In a band's bucket every node is first compared with the smallest one, by the whole sets.
4. Buckets whose nodes are still in several components are compared from within: each node outside the
   bucket's largest component with every node of another component.  Nodes travel with their sets in slices of
   bounded size; a task holds two slices and returns links that join components, not pairs.
5. Links from elsewhere may join them (``linked``: the pipeline passes the groups of op4's tree over fingerprints).
6. Components come from ``simhash.components``.

Pairs whose sets differ too much in size are never compared.

Words are what ASCII white space separates, in ASCII lower case.  A text of fewer words than a shingle has
its whole line as the only one.  Null and empty texts have no shingles and are copies of each other.
Every input row is a document: rows may repeat, and a repeated id with another text is another document.
Null ids are ids, smaller than all others.  Texts may be of any length: a task holds two slices of sets, or
two sets where one alone is larger than a slice.  Other columns stay as they are, whatever their names; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vozlake.llm import simhash
from vozlake.llm.common import bounded_batches, materialize

SHINGLE, SEED = 5, 42
#: Least similarity, as a fraction of whole numbers.
SIMILAR = (4, 5)
BANDS, ROWS = 40, 8
#: Nodes and bytes of sets in a slice of a bucket.
SLICE_NODES, SLICE_BYTES = 512, 8 << 20
#: Bytes of an Arrow batch: a batch of texts grows several times as sets.
BATCH = "4m"
FACTORS = np.random.default_rng(SEED).integers(1 << 63, size=BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The hashes of the text's shingles, each once, in order."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, line = (ends - lengths).tolist(), b" ".join(words)
    last = ends[shingle - 1 :].tolist() or [len(line)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, last, strict=False)), np.uint64, len(last)))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key for each band of minimum hashes; none for an empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    low = np.full(len(FACTORS), ~np.uint64(0))
    for at in range(0, len(hashes), 256):
        np.minimum(low, (FACTORS[:, None] * hashes[None, at : at + 256]).min(axis=1), out=low)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for column in low.reshape(BANDS, ROWS).T:
        keys = (keys ^ column) * np.uint64(0xD6E8FEB86659FD93)
        keys ^= keys >> np.uint64(32)
    return keys.view(np.int64)


def shared(one: np.ndarray, other: np.ndarray) -> int:
    """How many hashes two sorted sets share."""
    if len(one) > len(other):
        one, other = other, one
    if not len(one):
        return 0
    return int((other[np.minimum(np.searchsorted(other, one), len(other) - 1)] == one).sum())


def similar(a: bytes, b: bytes) -> bool:
    """Whether two sets of hashes reach the similarity."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    up, down = SIMILAR
    if min(len(x), len(y)) * down < up * max(len(x), len(y)):
        return False
    both = shared(x, y)
    return both * down >= up * (len(x) + len(y) - both)


def with_sets(df: DataFrame, text: str, shingle: int = SHINGLE) -> DataFrame:
    """Add the node, a hash of the set, the set's size and the keys of its bands."""

    @F.pandas_udf("node long, size long, keys array<long>")
    def of(texts: pd.Series) -> pd.DataFrame:
        import xxhash

        found = [shingles(x, shingle) for x in texts]
        nodes = [simhash.signed(xxhash.xxh64_intdigest(x.tobytes(), SEED)) for x in found]
        return pd.DataFrame({"node": pd.Series(nodes, dtype="int64"), "size": pd.Series([len(x) for x in found], dtype="int64"), "keys": [band_keys(x) for x in found]})

    bounded_batches(df.sparkSession, BATCH)
    return df.withColumn("s", of(F.col(f"`{text}`")))


def sizes_fit(one: str, other: str) -> Column:
    up, down = SIMILAR
    return F.least(one, other) * down >= F.greatest(one, other) * up


class Bucket:
    """Nodes of two slices (or of one, twice), the components they are in, and the links that join these."""

    def __init__(self, rows: pd.DataFrame, one: int, other: int):
        self.nodes, self.root = rows["node"].to_numpy(np.int64), rows["root"].to_numpy(np.int64).copy()
        self.sets = [np.frombuffer(x, np.uint64) for x in rows["hashes"]]
        place = rows["slice"].to_numpy()
        self.left, self.right, self.same = np.flatnonzero(place == one), np.flatnonzero(place == other), one == other

    def links(self) -> list[tuple[int, int]]:
        up, down = SIMILAR
        found, size = [], np.array([len(x) for x in self.sets])
        for x in self.left:
            near = self.right[(np.minimum(size[self.right], size[x]) * down >= np.maximum(size[self.right], size[x]) * up) & (self.root[self.right] != self.root[x])]
            for y in near[near > x] if self.same else near:
                if self.root[x] != self.root[y]:
                    both = shared(self.sets[x], self.sets[y])
                    if both * down >= up * (size[x] + size[y] - both):
                        found.append((int(self.nodes[x]), int(self.nodes[y])))
                        self.root[self.root == self.root[y]] = self.root[x]
        return found


def links_inside(buckets: DataFrame, sets: DataFrame, labels: DataFrame, slice_nodes: int = SLICE_NODES, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Links (a, b) between nodes that share a bucket, are similar and have different labels, as many as join their components."""
    rooted = materialize(buckets.join(labels, "node", "left").select("key", "node", "size", F.coalesce("root", "node").alias("root")), "rooted")
    by_root = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("hashes"))
    main = by_root.groupBy("key").agg(F.max(F.struct("n", "root", "hashes")).alias("main"), F.sum("n").alias("n"), F.sum("hashes").alias("hashes"))
    slices = lambda n, hashes: F.greatest(F.ceil(n / slice_nodes), F.ceil(8 * hashes / slice_bytes), F.lit(1)).cast("int")
    rest = slices(F.col("n") - F.col("main.n"), F.col("hashes") - F.col("main.hashes"))
    open_ones = main.where(F.col("n") > F.col("main.n")).select("key", F.col("main.root").alias("main"), rest.alias("rest"), slices(F.col("main.n"), F.col("main.hashes")).alias("mains"))
    own = rooted.join(open_ones, "key")
    dealt = lambda count: F.pmod(F.xxhash64("node"), count).cast("int")
    # Slices of the rest come first; those of the largest component only meet them.
    placed = own.withColumn("slice", F.when(F.col("root") == F.col("main"), F.col("rest") + dealt(F.col("mains"))).otherwise(dealt(F.col("rest"))))
    others = F.sequence(F.lit(0), F.when(F.col("slice") >= F.col("rest"), F.col("rest")).otherwise(F.col("rest") + F.col("mains")) - 1)
    meeting = placed.select("key", "node", "root", "slice", F.explode(others).alias("other"))
    meeting = meeting.select("key", F.least("slice", "other").alias("one"), F.greatest("slice", "other").alias("two"), "slice", "node", "root").join(sets, "node")

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, []

        def done() -> pd.DataFrame:
            found = Bucket(pd.concat(held), *at[1:]).links()
            return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

        for batch in batches:  # sorted by key and slices
            place = list(zip(batch["key"], batch["one"], batch["two"], strict=True))
            cuts = [k for k in range(len(place)) if k == 0 or place[k] != place[k - 1]] + [len(place)]
            for start, end in zip(cuts, cuts[1:], strict=False):
                if place[start] != at:
                    if held:
                        yield done()
                    at, held = place[start], []
                held.append(batch.iloc[start:end])
        if held:
            yield done()

    bounded_batches(buckets.sparkSession, BATCH)
    spread = meeting.repartition("key", "one", "two").sortWithinPartitions("key", "one", "two")
    return spread.mapInPandas(compared, "a long, b long").distinct()


def find_links(buckets: DataFrame, sets: DataFrame, **slices: int) -> DataFrame:
    """Links (a, b) that connect what all similar pairs inside ``buckets`` (key, node, size, low, low_size) connect.

    ``low`` is a bucket's first node; ``sets`` has a row (node, hashes) for each node."""

    @F.pandas_udf(T.BooleanType())
    def close(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similar(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)

    pairs = buckets.where((F.col("node") != F.col("low")) & sizes_fit("size", "low_size")).select(F.col("node").alias("a"), F.col("low").alias("b")).distinct()
    left, right = (sets.select(F.col("node").alias(k), F.col("hashes").alias(f"{k}_hashes")) for k in "ab")
    first = materialize(pairs.join(left, "a").join(right, "b").where(close("a_hashes", "b_hashes")).select("a", "b"), "copies")
    labels = simhash.components(first).select(F.col("fp").alias("node"), "root")
    return first.unionAll(links_inside(buckets, sets, labels, **slices))


def links_given(prints: DataFrame, linked: DataFrame) -> DataFrame:
    """Links (a, b) between the first node of each group of ``linked`` (id, text_hash, root) and its other nodes."""
    own = prints.select("id", "text_hash", "node").distinct().alias("p")
    named = linked.select("id", "text_hash", F.col("root").alias("group")).distinct().alias("l")
    same = F.col("p.id").eqNullSafe(F.col("l.id")) & (F.col("p.text_hash") == F.col("l.text_hash"))
    placed = materialize(own.join(named, same).select("group", "node").distinct(), "given")
    lows = placed.groupBy("group").agg(F.min("node").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return placed.join(lows, "group").where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b"))


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, linked: DataFrame | None = None, **slices: int) -> DataFrame:
    """(id, text_hash, root) for each row of ``docs``; equal roots make a group.

    Rows (id, text_hash, root) of ``linked`` with equal roots are in one group, too."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    own = docs.select(F.col(f"`{doc_id}`").alias("id"), body.alias("body"), F.xxhash64(body).alias("text_hash"))
    prints = materialize(with_sets(own, "body", shingle).select("id", "text_hash", "s.node", "s.size", "s.keys"), "prints")
    members = prints.groupBy("node").agg(F.first("size").alias("size"), F.first("keys").alias("keys")).select(F.explode("keys").alias("key"), "node", "size")
    lows = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("node", "size")).alias("low")).where("n > 1")
    buckets = materialize(members.join(lows, "key").select("key", "node", "size", F.col("low.node").alias("low"), F.col("low.size").alias("low_size")), "buckets")

    @F.pandas_udf(T.BinaryType())
    def hashes(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(x, shingle).tobytes() for x in texts], dtype=object)

    # One row for each node that meets another one; repeated rows agree in id and text.
    wanted = prints.join(buckets.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min(F.struct("id", "text_hash")).alias("first"))
    wanted = wanted.select("node", F.col("first.id").alias("first_id"), F.col("first.text_hash").alias("first_hash"))
    texts = own.join(wanted, F.col("id").eqNullSafe(F.col("first_id")) & (F.col("text_hash") == F.col("first_hash"))).select("node", "body")
    sets = materialize(texts.dropDuplicates(["node"]).select("node", hashes("body").alias("hashes")), "sets")
    links = find_links(buckets, sets, **slices)
    if linked is not None:
        links = links.unionAll(links_given(prints, linked))
    labels = simhash.components(links)
    rooted = prints.select("id", "text_hash", "node").join(labels, F.col("node") == F.col("fp"), "left")
    return rooted.select("id", "text_hash", F.coalesce("root", "node").alias("root"))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each group: the one with the smallest id (null first), then the smallest text hash."""
    return simhash.keep_first(docs, groups(docs, doc_id, text, **options), doc_id, text)
