"""Near duplicates by MinHash with tensored banding, verified on full shingle sets.

Two small collections of ``groups`` signatures (each the combination of ``rows``
minhashes) are computed for a set. The keys of the ``groups ** 2`` tables are all pairs
of one signature from either collection, so two sets meet in a table if they agree in
any signature of the first and any of the second: ``2 * groups * rows`` minhashes do
the work of ``2 * groups ** 2 * rows``. With the defaults a pair at similarity 0.8 is
missed with probability 7e-6, one at 0.85 with 3e-8.

1. Sets and signatures of all documents; documents with equal sets form a class, which
   takes part once.
2. Classes alone in all buckets of the first collection leave; the others are numbered
   so that those with more company come first, and meet in the tables. The first member
   of a bucket leads it.
3. Every class is compared with the first of its leaders, on full sets. In a group of
   near copies that is their common origin, so the group is joined by as many
   comparisons as it has members.
4. A bucket whose members are in one component by then, or were all compared with each
   other, is settled. Members of the others, with all that share an unsettled bucket
   with them directly or through others, are compared exactly in blocks of bounded size
   (classes of set size: sets too different in size can't be similar and don't meet).
   A task holds two blocks and compares their sets with a matrix product.
5. Connected components of the confirmed links, by alternating stars, each round
   written to the shared folder.

No step holds a bucket, a component or a class in one task: buckets and copies are
counted before they are shuffled, what they are joined with is a written table (so that
Spark divides a large key), and leaders of many are repeated for slices of their
members. No pair of members is written unless it is compared. Exploded signatures are
never broadcast: Spark's estimate of their size leaves out the rows that exploding makes.

Cases: null and empty texts have no shingles and no links; a text with fewer words than
a shingle has is one shingle; documents with a null id are linked with nothing and
kept; repeated rows with one id and text are in one class; an empty table gives no
rows; only the id and the text are read. Very long texts are one set of 8 bytes a
distinct shingle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engramix.llm.common import Workspace, arrow_schema, chunks, file_system, kept, lean, materialize, record_batch, small_batches

#: Members and shingles of a block; a task holds two.
BLOCK_SETS, BLOCK_SHINGLES = 1024, 1 << 20
#: Columns of the matrices of a product.
COLUMNS = 2048
#: Members that are compared with one copy of their leader.
SLICE = 512
#: Rows of two numbers (some 4 MB on the driver) that are broadcast to the exploded signatures.
LOOKUP_ROWS = 1 << 16
#: Bits in a row that bitmap_construct_agg makes.
BITMAP = 32768
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ x >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(32)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


class Shingler:
    """64-bit hashes of the distinct shingles of texts."""

    def __init__(self, width: int):
        self.width = width
        self.words = _WordHashes()

    def __call__(self, text: bytes) -> np.ndarray:
        # bytes.lower and bytes.split know ASCII only, as the definition of words does
        split = text.lower().split()
        if len(self.words) > 200_000:
            self.words.clear()
        hashes = np.fromiter(map(self.words.__getitem__, split), np.uint64, len(split))
        if not len(hashes):
            return hashes
        n = min(self.width, len(hashes))
        rolled = np.full(len(hashes) - n + 1, n, np.uint64)
        for k in range(n):
            rolled = _mixed(rolled * _MIX + hashes[k : k + len(rolled)])
        return np.unique(rolled)


class Signatures:
    """Two collections of ``groups`` signatures of ``rows`` minhashes."""

    def __init__(self, groups: int, rows: int):
        self.groups, self.rows = groups, rows
        draw = np.random.default_rng(20240229)
        self.odd = draw.integers(0, 1 << 31, 2 * groups * rows, np.uint32) * np.uint32(2) + np.uint32(1)
        self.add = draw.integers(0, 1 << 32, 2 * groups * rows, np.uint32)

    def __call__(self, sets: list[np.ndarray]) -> np.ndarray:
        """(sets, 2 * groups) signatures; every set has an element."""
        flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)  # 32 bits are enough to order, and twice as fast
        starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
        out = np.zeros((2 * self.groups, len(sets)), np.uint64)
        spare = np.empty_like(flat)
        for j in range(len(self.odd)):
            np.bitwise_xor(flat, self.add[j], out=spare)
            np.multiply(spare, self.odd[j], out=spare)
            g = j // self.rows
            out[g] = _mixed(out[g] * _MIX + np.minimum.reduceat(spare, starts))
        return out.T.astype(np.int64)


def signatures(docs: DataFrame, width: int, groups: int, rows: int) -> DataFrame:
    """doc_id, n (size of the set), h1 and h2 (its digest; null without shingles), first and second (signatures)."""
    names = [("n", T.LongType()), ("h1", T.LongType()), ("h2", T.LongType()), ("first", T.ArrayType(T.LongType())), ("second", T.ArrayType(T.LongType()))]
    schema = T.StructType([docs.schema["doc_id"]] + [T.StructField(n, t) for n, t in names])
    out = arrow_schema(schema)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, sign = Shingler(width), Signatures(groups, rows)
        for ids, texts in chunks(batches):
            sets = [shingles(t) for t in texts]
            full = [i for i, s in enumerate(sets) if len(s)]
            h1, h2, first, second = ([None] * len(sets) for _ in range(4))
            if full:
                made = sign([sets[i] for i in full]).tolist()
                for i, row in zip(full, made, strict=True):
                    digest = np.frombuffer(hashlib.blake2b(sets[i], digest_size=16).digest(), np.int64)
                    h1[i], h2[i], first[i], second[i] = int(digest[0]), int(digest[1]), row[:groups], row[groups:]
            yield record_batch(out, ids, [len(s) for s in sets], h1, h2, first, second)

    return docs.mapInArrow(lean(kernel), schema)


def lookup(table: DataFrame) -> DataFrame:
    """A written table of two numbers, for a join with exploded rows: broadcast if it is small, else a merge, so that the other side never is."""
    return F.broadcast(table) if table.count() <= LOOKUP_ROWS else table.hint("merge")


def met_classes(classes: DataFrame, work: Workspace) -> DataFrame:
    """node, h1, h2, doc_id, n, k1s, second of the classes that share a signature of the first collection with another one.

    Nodes are numbers, smaller for classes in fuller buckets (by powers of about 1.12), so
    that the smallest of a bucket is the one most like all others.
    """
    one = classes.select("h1", "h2", F.posexplode("first").alias("i", "x")).select("h1", "h2", F.xxhash64("i", "x").alias("k1"))
    full = work.keep(one.groupBy("k1").agg(F.count("*").alias("c")).where("c > 1"), "met")
    held = one.join(lookup(full), "k1").groupBy("h1", "h2").agg(F.collect_list("k1").alias("k1s"), F.sum("c").alias("company"))  # a row of ``one`` for each signature
    place = (F.lit(255) - F.least(F.lit(255), F.floor(6 * F.log2("company")))).cast("long")
    node = F.shiftleft(place, 55) + F.monotonically_increasing_id()
    return work.keep(held.join(classes.select("h1", "h2", "doc_id", "n", "second"), ["h1", "h2"]).select(node.alias("node"), "h1", "h2", "doc_id", "n", "k1s", "second"), "nodes")


def table_keys(nodes: DataFrame, *more: str) -> DataFrame:
    """node and k2 for all tables of each class."""
    one = nodes.select("node", "second", *more, F.explode("k1s").alias("k1"))
    return one.select("node", "k1", *more, F.posexplode("second").alias("j", "y")).select("node", *more, F.xxhash64("k1", "j", "y").alias("k2"))


def components(edges: DataFrame, name: str, work: Workspace | None = None, falling_once: bool = False) -> DataFrame:
    """(node, root) of all nodes of undirected edges (a, b); the root is the component's smallest node.

    Alternating stars: every node joins its larger neighbours, then its smaller ones, to
    the smallest. Only nodes that change anything are joined with their edges: those
    with a smaller and a larger neighbour, or with two smaller ones. They are few, and a
    written table, so the neighbours of a hub aren't brought into one task. Rounds grow
    with the logarithm of a component's size. ``falling_once``: the edges are a written
    table, each there once from its larger node.
    """

    def keep(df: DataFrame, what: str) -> DataFrame:
        return work.keep(df, f"{name}-{what}") if work else materialize(df, f"{name}-{what}")

    def falling(e: DataFrame) -> DataFrame:
        """Edges once each, from the larger to the smaller node."""
        return e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()

    held = edges.select("a", "b") if falling_once else keep(falling(edges.select("a", "b")), "edges")
    while True:
        ends = held.select("a", F.col("b").alias("m"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(held.select(F.col("b").alias("a"), F.lit(None).cast("long").alias("m"), F.lit(0).alias("down"), F.lit(1).alias("up")))
        movers = keep(ends.groupBy("a").agg(F.min("m").alias("m"), F.sum("down").alias("down"), F.sum("up").alias("up")).where("down > 1 or down = 1 and up > 0"), "movers")
        if movers.isEmpty():
            return held.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(held.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        # Larger neighbours of a node go to its smallest neighbour, as the node does.
        through = movers.where("up > 0").select(F.col("a").alias("b"), "m")
        moved = held.join(through, "b", "left").select("a", F.coalesce("m", "b").alias("b")).unionByName(through.select(F.col("b").alias("a"), F.col("m").alias("b")))
        held = keep(falling(moved), "edges")
        # Smaller neighbours of a node go to the smallest of them.
        torn = keep(held.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("down")).where("down > 1").select("a", "m"), "torn")
        joined = held.join(torn, "a", "left").select(F.when(F.col("m").isNull() | (F.col("b") == F.col("m")), F.col("a")).otherwise(F.col("b")).alias("a"), F.coalesce("m", "b").alias("b"))
        held = keep(falling(joined), "edges")


def _ratio(percent: int) -> float:
    """Sets that are similar differ in size by less than this factor."""
    return 101 / max(1, percent)


def _to_leader(percent: int):
    """Kernel over (leader, node, shingles), a leader's own set before its members': the links (a, b) with the leader."""
    out = arrow_schema(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            made: list[tuple[int, int]] = []
            leaders, nodes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i in range(batch.num_rows):
                if leaders[i] == nodes[i]:
                    leader, own = leaders[i], np.frombuffer(batch.column(2)[i].as_buffer(), np.uint64).copy()
                elif leaders[i] == leader:
                    other = np.frombuffer(batch.column(2)[i].as_buffer(), np.uint64)
                    few, many = (own, other) if len(own) < len(other) else (other, own)
                    if 100 * len(few) >= percent * len(many):
                        common = int((many[np.minimum(np.searchsorted(many, few), len(many) - 1)] == few).sum())
                        if 100 * common >= percent * (len(few) + len(many) - common):
                            made.append((int(nodes[i]), int(leader)))
            yield record_batch(out, [a for a, _ in sorted(set(made))], [b for _, b in sorted(set(made))])

    return lean(kernel)


def leader_links(edges: DataFrame, sets: DataFrame, percent: int, work: Workspace) -> DataFrame:
    """The edges (a, b) whose sets are similar; b leads a, and is smaller."""
    led = work.keep(edges.groupBy("b").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices")), "leaders")
    many = led.where("slices > 1")
    slices = F.coalesce("slices", F.lit(1))
    members = edges.join(many, "b", "left").select("b", F.col("a").alias("node"), F.pmod(F.xxhash64("a"), slices).cast("int").alias("slice"))
    leaders = led.select("b", F.col("b").alias("node"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    dealt = members.unionByName(leaders).join(sets, "node").select("b", "node", "shingles", "slice")
    own = dealt.repartition("b", "slice").sortWithinPartitions("b", "slice", "node").select("b", "node", "shingles")
    return work.keep(own.mapInArrow(_to_leader(percent), "a long, b long"), "leader-links")


def unsettled(nodes: DataFrame, rooted: DataFrame, first: DataFrame, leaders: DataFrame, work: Workspace) -> DataFrame:
    """Edges (node, other) that join the members of each bucket in which links between different components may be missing."""
    told = nodes.join(rooted, "node", "left").join(first.select(F.col("a").alias("node"), F.col("b").alias("done")), "node", "left").withColumn("root", F.coalesce("root", "node"))
    keys = table_keys(told, "root", "done").join(leaders, "k2")
    led, root = F.col("node") != F.col("b"), F.col("root")
    seen = keys.groupBy("k2", "b").agg(F.min(F.when(led, root)).alias("low"), F.max(F.when(led, root)).alias("high"), F.max(F.when(~led, root)).alias("own"), F.max(F.when(led & ~F.col("done").eqNullSafe(F.col("b")), 1)).alias("new"))
    open_ = work.keep(seen.where("low <> high or new = 1 and (own <> low or own <> high)").select("k2", "b"), "unsettled")
    if open_.isEmpty():
        return open_.select(F.col("k2").alias("a"), "b").limit(0)
    return work.keep(table_keys(nodes).join(lookup(open_), "k2").where("node <> b").select(F.col("node").alias("a"), "b").distinct(), "unsettled-stars")


def _links(sets: list[np.ndarray], side: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs with 100 * intersection >= percent * union, between the sides (or within one side, if there is one)."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    rows = np.repeat(np.arange(n), sizes)
    _, column, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = df[column] > 1
    rows, column = rows[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    width = int(column.max()) + 1 if len(column) else 0
    left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == side.max()))
    common = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    for c in range(0, width, COLUMNS):
        a, b = np.searchsorted(column, [c, c + COLUMNS])
        held = np.zeros((n, min(COLUMNS, width - c)), np.float32)
        held[rows[a:b], column[a:b] - c] = 1
        common += held[left] @ held[right].T
    union = sizes[left][:, None] + sizes[right][None, :] - common
    for i, j in zip(*np.nonzero(100 * common >= percent * union), strict=True):
        if left[i] != right[j]:
            yield int(left[i]), int(right[j])


def _forest(group: pa.Table, percent: int) -> pa.Table:
    """A spanning forest of the links within a block, or between two blocks, that join different components."""
    nodes, roots, side = (group.column(c).to_numpy() for c in ("node", "root", "side"))
    _, once = np.unique(nodes, return_index=True)  # a repeated document has one set
    nodes, roots, side = nodes[once], roots[once], side[once].astype(np.int64)
    made: list[tuple[int, int]] = []
    two = bool(group.column("two")[0].as_py())
    if len(set(roots.tolist())) > 1 and (not two or side.min() < side.max()):
        sets = [np.frombuffer(s, np.uint64) for s in group.column("shingles").take(pa.array(once)).to_pylist()]
        parent: dict[int, int] = {}

        def root(i: int) -> int:
            while (up := parent.setdefault(i, i)) != i:
                parent[i] = i = parent[up]
            return i

        for i, j in _links(sets, side, percent):
            a, b = root(int(roots[i])), root(int(roots[j]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                made.append((int(nodes[i]), int(nodes[j])))
    return pa.table({"a": pa.array([x for x, _ in made], pa.int64()), "b": pa.array([x for _, x in made], pa.int64())})


def block_links(clusters: DataFrame, nodes: DataFrame, rooted: DataFrame, sets: DataFrame, percent: int, work: Workspace) -> DataFrame:
    """Links (a, b) between sets of one cluster (node, root) that are in different components so far, by blocks."""
    members = clusters.select("node", F.col("root").alias("cluster")).join(nodes.select("node", "n"), "node").join(rooted, "node", "left")
    members = work.keep(members.select("node", "cluster", "n", F.coalesce("root", "node").alias("root"), F.floor(F.log(F.col("n").cast("double")) / float(np.log(_ratio(percent)))).cast("int").alias("class")), "members")

    def blocks(n: str, shingles: str) -> Column:
        return F.greatest(F.ceil(F.col(n) / BLOCK_SETS), F.ceil(F.col(shingles) / BLOCK_SHINGLES)).cast("int")

    sums = members.groupBy("cluster", "class").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    # A cluster that fits a block is one; the others have blocks of sets of about one size.
    whole = sums.groupBy("cluster").agg(F.sum("c").alias("cc"), F.sum("s").alias("ss")).where(blocks("cc", "ss") > 1)
    sizes = sums.join(whole, "cluster").select("cluster", "class", blocks("c", "s").alias("blocks"))
    above = sizes.select("cluster", (F.col("class") - 1).alias("class"), F.col("blocks").alias("up"))
    below = sizes.select("cluster", (F.col("class") + 1).alias("class"), F.col("blocks").alias("down"))
    plan = work.keep(sizes.join(above, ["cluster", "class"], "left").join(below, ["cluster", "class"], "left"), "block-plan")
    held = members.join(plan, ["cluster", "class"], "left")
    block = F.pmod(F.xxhash64("node", F.lit(7)), F.coalesce("blocks", F.lit(1))).cast("int")
    held = held.select("node", "cluster", "root", F.when(F.col("blocks").isNotNull(), F.col("class")).otherwise(-1).alias("class"), block.alias("block"), "blocks", "up", "down")

    def meets(first_class, first, second_class, second, side, two) -> Column:
        return F.struct(first_class.alias("ca"), first.alias("ba"), second_class.alias("cb"), second.alias("bb"), F.lit(side).alias("side") if isinstance(side, int) else side.alias("side"), two.alias("two"))

    c, b = F.col("class"), F.col("block")
    same = F.transform(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1), lambda o: meets(c, F.least(b, o), c, F.greatest(b, o), (b > o).cast("int"), b != o))
    up = F.when(F.col("up") > 0, F.transform(F.sequence(F.lit(0), F.col("up") - 1), lambda o: meets(c, b, c + 1, o, 0, F.lit(True))))
    down = F.when(F.col("down") > 0, F.transform(F.sequence(F.lit(0), F.col("down") - 1), lambda o: meets(c - 1, o, c, b, 1, F.lit(True))))
    none = F.array().cast("array<struct<ca:int,ba:int,cb:int,bb:int,side:int,two:boolean>>")
    grid = held.select("node", "cluster", "root", F.explode(F.concat(same, F.coalesce(up, none), F.coalesce(down, none))).alias("p")).select("node", "cluster", "root", "p.*")
    return work.keep(grid.join(sets, "node").groupBy("cluster", "ca", "ba", "cb", "bb").applyInArrow(lambda g: _forest(g, percent), "a long, b long"), "block-links")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, groups: int = 24, rows: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable), kept (whether that is the document's own)."""
    spark = docs.sparkSession
    small_batches(spark)
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    with Workspace(spark, "near-duplicates") as work:
        signed = work.keep(signatures(own, width, groups, rows), "signatures")
        linked = signed.where("h1 is not null and doc_id is not null")
        # One row for each distinct set; signatures of equal sets are equal.
        classes = work.keep(linked.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("docs"), F.min("n").alias("n"), F.first("first").alias("first"), F.first("second").alias("second")), "classes")
        nodes = met_classes(classes, work)
        leaders = lookup(work.keep(table_keys(nodes).groupBy("k2").agg(F.min("node").alias("b"), F.count("*").alias("c")).where("c > 1").select("k2", "b"), "table-leaders"))
        first = work.keep(table_keys(nodes).join(leaders, "k2").where("node <> b").groupBy(F.col("node").alias("a")).agg(F.min("b").alias("b")), "first-leaders")
        involved = first.select(F.col("a").alias("node")).unionByName(first.select(F.col("b").alias("node"))).distinct()
        sets = _sets(own, nodes.join(involved, "node", "left_semi"), width, work)
        links = leader_links(first, sets, percent, work)
        rooted = components(links, "led", work, falling_once=True)
        missing = unsettled(nodes, rooted, first, leaders, work)
        if not missing.isEmpty():
            links = links.unionByName(block_links(components(missing, "clusters", work), nodes, rooted, sets, percent, work))
            rooted = components(links, "all", work)
        found = rooted.join(nodes.select("node", "h1", "h2", "doc_id"), "node")
        least = work.keep(found.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
        named = found.join(least, "root").select("h1", "h2", "component_id")
        labels = work.keep(classes.join(named, ["h1", "h2"], "left").where("docs > 1 or component_id is not null").select("h1", "h2", F.coalesce("component_id", "doc_id").alias("component_id")), "labels")
        out = signed.select("doc_id", F.col("n").alias("n_shingles"), "h1", "h2").join(labels, ["h1", "h2"], "left")
        component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
        out = out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
        return materialize(out, "near-duplicates-result")


@lru_cache(2)
def _bitmap(folder: str, bits: int) -> np.ndarray:
    """The bits written to a shared folder, as bytes."""
    from pyarrow import fs
    from pyarrow import parquet

    system, own = file_system(folder)
    held = np.zeros((bits // BITMAP, BITMAP // 8), np.uint8)
    for info in system.get_file_info(fs.FileSelector(own)):
        if info.path.endswith(".parquet"):
            with system.open_input_file(info.path) as f:
                part = parquet.read_table(f, columns=["bucket", "bits"])
            for k, b in zip(part["bucket"].to_pylist(), part["bits"].to_pylist(), strict=True):
                held[k - 1] = np.frombuffer(b, np.uint8)
    return held.reshape(-1)


kept("bitmap", _bitmap.cache_clear)


def _sets(docs: DataFrame, members: DataFrame, width: int, work: Workspace) -> DataFrame:
    """node and shingles of the members.

    A bitmap of hashed ids, of bounded size and read from the shared folder, spares the
    other texts the work and all texts a shuffle; the join on the digests that follows
    is exact. A task returns a set that it meets again only once in a while.
    """
    schema = T.StructType([T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("shingles", T.BinaryType())])
    out = arrow_schema(schema)
    bits = 1 << max(20, min(30, (32 * members.count()).bit_length()))
    folder = f"{work.folder}/member-bits"
    at = F.pmod(F.xxhash64("doc_id"), F.lit(bits)) + 1
    members.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).write.parquet(folder)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, held, met = Shingler(width), _bitmap(folder, bits), set()

        def chosen() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bit = batch.column(2).to_numpy() - 1
                yield batch.filter(pa.array((held[bit >> 3] >> (bit & 7) & 1).astype(bool)))

        for _, texts in chunks(chosen()):
            new = []
            for t in texts:
                if len(s := shingles(t)) and (d := hashlib.blake2b(s, digest_size=16).digest()) not in met:
                    met.add(d)
                    new.append((*np.frombuffer(d, np.int64).tolist(), s.tobytes()))
            if len(met) > 100_000:
                met.clear()
            yield record_batch(out, *([x[k] for x in new] for k in range(3)))

    made = docs.select("doc_id", "text", at.alias("bit")).where("doc_id is not null").mapInArrow(lean(kernel, "bitmap"), schema)
    return work.keep(made.join(members.select("node", "h1", "h2"), ["h1", "h2"]).select("node", "shingles"), "shingle-sets")
