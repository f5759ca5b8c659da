"""N-gram Jaccard join of documents by chosen paths.

Documents are sets of word 5-grams (A-Z in lower case). Documents with the same set are one class; all
further work is on classes. Each class has a signature of ``COORDINATES`` min-hashes. Classes are split
recursively: at first by as many coordinates as the recall needs at the full depth, all different as
long as there are enough; below, every node draws coordinates on its own, each with a chance of
``1 / (threshold * COORDINATES)``. Each coordinate sends a class to the child of its value; pairs at the
threshold so have one common child on average. Nodes of at most ``small`` classes are brute-forced on
their signatures, as are nodes that splitting no longer shrinks; of these, nodes with the same members
are kept once. Nodes still to be split stay apart even then, since each is a chance of its own. A class goes on
only by coordinates whose first node is split as well, or that have none: others are brute-forced already.

Brute force gives edges that connect the pairs that may reach the threshold; their connected components
are blocks. A search over a few coordinates goes first and its components are contracted, so that the many
nodes of a large group do not give its edges again and again. Each block is verified on its exact sets, all pairs, so a pair that every node missed is
still found if its block has it. Nodes and blocks of more than ``TILE`` members are cut into tiles of
pairs of slices, each its own task group. Pairs are counted where they are found and never listed.

Defined results: null and empty texts have no set, no links and are alone. Texts of one to four words
are one shingle. Null ids come last. Equal rows are separate documents of one class. An empty table
gives an empty table. Columns of the input other than id and text are not touched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.llm import tokens
from fleetpulse.llm.components import components
from fleetpulse.llm.expressions import WORD, whole
from fleetpulse.llm.store import likely, stage

COORDINATES = 64
FIRST = 4  # coordinates of the search that goes first
TILE = 512
SIGNATURE = pa.list_(pa.int32())


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, distinct shingle hashes, number per text)``, sorted inside each text."""
    for at, to, data, offsets in tokens.runs(column):
        words, counts = tokens.word_hashes(data, offsets, lower=True)
        grams, n = tokens.ngrams(words, counts, size, whole_short=True)
        ends = np.cumsum(n)
        for a, b in zip(ends - n, ends, strict=True):
            grams[a:b].sort()
        first = np.ones(len(grams), bool)
        first[1:] = grams[1:] != grams[:-1]
        first[(ends - n)[n > 0]] = True
        kept = np.concatenate([[0], np.cumsum(first)])
        yield at, to, grams[first], kept[ends] - kept[ends - n]


def signatures(sets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Min-hashes of non-empty sets, one row per set."""
    starts = (np.cumsum(counts) - counts)[counts > 0]
    out = np.empty((len(starts), COORDINATES), np.uint32)
    if not len(starts):
        return out
    turns = tokens.mix(np.arange(1, COORDINATES + 1, dtype=np.uint64)) | np.uint64(1)
    for k, turn in enumerate(turns):
        out[:, k] = np.minimum.reduceat((sets * turn) >> np.uint64(32), starts).astype(np.uint32)
    return out


def _sets_of(docs: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """Per document: id, hash of the text, 128 bits of its set, and the signature."""
    df = docs.select(docs[f"`{doc_id}`"].alias("id"), F.xxhash64(whole(docs[f"`{text}`"])).alias("tx"), whole(docs[f"`{text}`"]).alias("__text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, sets, counts in shingle_sets(batch.column(2), size):
                part = batch.slice(at, to - at)
                full = counts > 0
                starts = (np.cumsum(counts) - counts)[full]
                c = np.zeros(len(counts), np.uint64)
                c2 = np.zeros(len(counts), np.uint64)
                if full.any():
                    c[full] = tokens.mix(np.add.reduceat(tokens.mix(sets), starts))
                    c2[full] = tokens.mix(np.add.reduceat(tokens.mix(sets ^ np.uint64(0x5BD1E995)), starts))
                sig = signatures(sets, counts).view(np.int32)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(full)]) * COORDINATES, pa.int32()), pa.array(sig.reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(c.view(np.int64)), pa.array(c2.view(np.int64)), pa.array(counts, pa.int64()), lists],
                    names=["id", "tx", "c", "c2", "n", "sig"])

    kind = df.schema["id"].dataType.simpleString()
    return df.mapInArrow(work, f"id {kind}, tx long, c long, c2 long, n long, sig array<int>")


def place(name: str = "id") -> Column:
    return F.struct(F.col(name).isNull().alias("none"), F.col(name).alias("id"), F.col("tx").alias("tx"))


def _agreeing(threshold: float) -> np.ndarray:
    """Chance that a pair at the threshold has 0, 1, ... equal coordinates."""
    return np.array([math.comb(COORDINATES, a) * threshold**a * (1 - threshold) ** (COORDINATES - a) for a in range(COORDINATES + 1)])


def least_equal(recall: float, threshold: float) -> int:
    """Equal coordinates asked of a pair, so that a quarter of the pairs that may be missed fall below."""
    below = np.cumsum(_agreeing(threshold))
    return int(np.searchsorted(below, (1 - recall) / 4, side="right"))


def recall_of(starts: int, threshold: float, depth: int, least: int) -> float:
    """Chance that a pair at the threshold has ``least`` equal coordinates and a common node at the last level.

    The equal coordinates of a pair are the same in all nodes, so the chance is taken for each number of
    them. With a equal ones a common node keeps the pair together through one more split by
    ``1 - (1 - chance * p) ** a``; the first level has each coordinate equally often, up to one.
    """
    chance = 1 / (threshold * COORDINATES)
    turns, rest = divmod(starts, COORDINATES)
    found = 0.0
    for a, weight in enumerate(_agreeing(threshold)):
        p = 1.0
        for _ in range(depth - 1):
            p = 1 - (1 - chance * p) ** a
        hits = range(max(0, rest - COORDINATES + a), min(a, rest) + 1)
        some = sum(math.comb(a, h) * math.comb(COORDINATES - a, rest - h) * (1 - p) ** h for h in hits) / math.comb(COORDINATES, rest)
        found += weight * (1 - (1 - p) ** (turns * a) * some) * (a >= least)
    return found


def starts_for(recall: float, threshold: float, depth: int) -> int:
    """Coordinates of the first level after which a pair at the threshold is found with the wanted chance."""
    least, starts = least_equal(recall, threshold), 1
    while recall_of(starts, threshold, depth, least) < recall:
        starts += 1
    return starts


def _tiled(df: DataFrame, group: str, member: str, size: str, crossed: bool = True) -> DataFrame:
    """Rows for the tiles of each group: all pairs of slices of at most about ``TILE`` members, or each slice
    only with itself. Groups with common members are sliced differently."""
    slices = F.ceil(F.col(size) / F.lit(TILE)).cast("int")
    mine = F.pmod(F.xxhash64(group, member), slices).cast("int")
    other = F.explode(F.sequence(F.lit(0), slices - 1)) if crossed else mine
    df = df.withColumns({"slices": slices, "mine": mine}).withColumn("other", other)
    tile = F.xxhash64(F.col(group), F.least("mine", "other"), F.greatest("mine", "other"))
    # the diagonal tile holds one slice, any other tile both
    return df.withColumn("tile", tile).withColumn("pair", F.struct(F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b")))


class _Forest:
    """Union-find over the members of one tile."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, others: np.ndarray) -> None:
        for y in others:
            a, b = self.root(x), self.root(int(y))
            if a != b:
                self.up[max(a, b)] = min(a, b)

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        roots = np.array([self.root(i) for i in range(len(self.up))], dtype=np.int64)
        moved = np.flatnonzero(roots != np.arange(len(roots)))
        return roots[moved], moved


def _groups(table: pa.Table, key: str) -> Iterator[tuple[int, int]]:
    values = table.column(key).to_numpy()
    cuts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1], [True]]))
    yield from zip(cuts[:-1], cuts[1:], strict=True)


def _candidates(leaves: DataFrame, least: int, crossed: bool) -> DataFrame:
    """Edges ``u, v`` between the ``label`` values of members with ``least`` equal coordinates in some leaf.
    Members of one label are together already, so a tile has an edge for each two labels that it brings together."""
    tiles = _tiled(leaves, "node", "c", "n", crossed).select("tile", "label", "sig")
    # by label too: the edges of a tree then start at its smallest label
    tiles = tiles.repartition("tile").sortWithinPartitions("tile", "label")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tokens.grouped(batches, "tile"):
            labels = table.column("label").to_numpy()
            sig = table.column("sig").combine_chunks().flatten().to_numpy().reshape(-1, COORDINATES)
            us, vs = [], []
            for a, b in _groups(table, "tile"):
                first = np.searchsorted(labels[a:b], labels[a:b])
                if not first[-1]:
                    continue
                forest = _Forest(b - a)
                forest.up[:] = first
                for i in range(a, b - 1):
                    close = np.flatnonzero((sig[i + 1 : b] == sig[i]).sum(1) >= least) + (i + 1 - a)
                    close = close[first[close] != first[i - a]]
                    if len(close):
                        forest.join(i - a, close)
                u, v = forest.edges()
                us.append(labels[a:b][u])
                vs.append(labels[a:b][v])
            none = np.zeros(0, np.int64)
            u, v = np.concatenate([none, *us]), np.concatenate([none, *vs])
            pairs = np.unique(np.stack([u, v], 1)[u != v], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    return tiles.mapInArrow(work, "u long, v long").distinct()


def _open(nodes: DataFrame, coordinates: list[tuple[int, int]]) -> DataFrame:
    """``c, ks`` for the members ``node, c`` of the first nodes that are split: bit k is set where the first node of
    coordinate k is one of them, or where there is none."""
    missing = sum(1 << k for k in set(range(COORDINATES)) - {k for _, k in coordinates})
    signed = missing - (1 << 64) if missing >> 63 else missing
    bit = F.expr(f"shiftleft(1L, CAST(node & {COORDINATES - 1} AS INT))")
    return nodes.groupBy("c").agg(F.bit_or(bit).bitwiseOR(F.lit(signed)).alias("ks"))


def _leaves(
    classes: DataFrame, coordinates: list[tuple[int, int]], threshold: float, small: int, depth: int, seed: int, crossed: bool
) -> DataFrame:
    """Nodes to brute-force: ``node, n, c, label, sig``. ``classes`` are ``c, label, sig``; a node whose members have
    one label is left out, and not split.

    If nodes are brute-forced as a whole (``crossed``), a member is not sent on by a coordinate whose first node is
    not split: all that it could meet there is in that node, which is brute-forced or has one label.
    """
    total = classes.count()
    chance = 1 / (threshold * COORDINATES)
    # the last bits of a first node are its coordinate
    first = [F.xxhash64(F.lit(turn), F.lit(k), F.col("sig")[k]).bitwiseAND(F.lit(-COORDINATES)).bitwiseOR(F.lit(k)) for turn, k in coordinates]
    children = F.array(*first)
    held = classes.select("c", "sig", F.lit(-1).cast("long").alias("ks"))
    rows = classes.select("c", "label", F.lit(total).cast("long").alias("was"), F.explode(children).alias("node"))
    out = None
    for level in range(depth):
        stats = rows.groupBy("node").agg(
            F.count("*").alias("n"), F.max("was").alias("was"), F.bit_xor(F.xxhash64("c")).alias("x"),
            F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").drop("low", "high")
        done = (F.col("n") <= small) | (F.col("n") >= 0.8 * F.col("was")) | F.lit(level + 1 == depth)
        stats = stats.withColumn("done", done).withColumn("apart", F.when(~F.col("done"), F.col("node")))
        stats = stage(stats.groupBy("n", "x", "done", "apart").agg(F.min("node").alias("node")).drop("x", "apart"), "jaccard-nodes")
        leaf = rows.select("node", "c", "label").join(stats.where("done").select("node", "n").hint("merge"), "node")
        out = leaf if out is None else out.unionByName(leaf)
        if stats.where("NOT done").isEmpty():
            break
        more = rows.select("node", "c", "label").join(stats.where("NOT done").select("node", F.col("n").alias("was")), "node")
        if crossed and level == 0:
            held = stage(classes.select("c", "sig").join(_open(more, coordinates), "c"), "jaccard-open")
        more = more.join(held, "c")
        drawn = F.filter(F.sequence(F.lit(0), F.lit(COORDINATES - 1)), lambda k: (
            F.pmod(F.xxhash64(F.lit(seed), F.col("node"), k), F.lit(1_000_000)) < int(chance * 1_000_000)) & (F.getbit("ks", k) == 1))
        next_node = F.transform(drawn, lambda k: F.xxhash64(F.col("node"), k, F.get(F.col("sig"), k)))
        rows = stage(more.select("c", "label", "was", F.explode(next_node).alias("node")), "jaccard-paths")
    return out.join(classes.select("c", "sig").hint("merge"), "c")


def _blocks(classes: DataFrame, threshold: float, recall: float, small: int, depth: int, seed: int) -> DataFrame:
    """``c, root`` of the classes that may have a partner: components of the candidate edges.

    First each slice of the nodes of ``FIRST`` coordinates is searched alone. That finds most of a large group,
    which is one label from then on: nodes inside it are left out of the search over all coordinates, and other
    tiles have an edge for each two labels in place of a tree over their members.
    """
    least, starts = least_equal(recall, threshold), starts_for(recall, threshold, depth)
    draw = np.random.default_rng(seed)
    coordinates = [(turn, int(k)) for turn in range(math.ceil(starts / COORDINATES)) for k in draw.permutation(COORDINATES)][:starts]
    alone = classes.select("c", F.col("c").alias("label"), "sig")
    near = stage(_candidates(_leaves(alone, coordinates[:FIRST], threshold, small, depth, seed, False), least, False), "jaccard-near")
    labels = components(near).select(F.col("node").alias("c"), F.col("root").alias("label"))
    known = stage(classes.select("c", "sig").join(labels, "c", "left").select("c", F.coalesce("label", "c").alias("label"), "sig"), "jaccard-known")
    far = _candidates(_leaves(known, coordinates, threshold, small, depth, seed, True), least, True)
    return components(near.unionByName(far)).withColumnRenamed("node", "c")


def _verified(docs: DataFrame, members: DataFrame, size: int, threshold: float, doc_id: str, text: str) -> DataFrame:
    """Per class and tile: linked classes weighted by their copies, and an edge of the tile's forest."""
    texts = docs.select(docs[f"`{doc_id}`"].alias("__id"), whole(docs[f"`{text}`"]).alias("__text")).withColumn("__tx", F.xxhash64("__text"))
    texts = likely(texts, F.xxhash64("__tx", "__id"), members, F.xxhash64("tx", "id")).where("likely")
    found = texts.join(members.hint("merge"), (F.col("__tx") == F.col("tx")) & F.col("__id").eqNullSafe(F.col("id"))).select(
        "root", "c", "n", "copies", "__text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # equal rows follow each other, except where a join was split
        for batch in batches:
            new = [not (c in seen or seen.add(c)) for c in batch.column(1).to_pylist()]
            batch = batch.filter(pa.array(new, pa.bool_()))
            for at, to, grams, counts in shingle_sets(batch.column(4), size):
                part = batch.slice(at, to - at)
                data = pa.Array.from_buffers(
                    pa.large_binary(), to - at,
                    [None, pa.py_buffer(np.concatenate([[0], np.cumsum(counts * 8)]).astype(np.int64)), pa.py_buffer(grams.tobytes())])
                yield pa.RecordBatch.from_arrays([*part.columns[:4], data.cast(pa.binary())], names=["root", "c", "n", "copies", "grams"])

    found = found.mapInArrow(sets, "root long, c long, n long, copies long, grams binary")
    tiles = _tiled(found, "root", "c", "n").select("tile", "c", "copies", "grams", "mine", "pair.a", "pair.b")
    tiles = tiles.repartition("tile").sortWithinPartitions("tile")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tokens.grouped(batches, "tile"):
            ids, copies, mine = (table.column(x).to_numpy() for x in ("c", "copies", "mine"))
            split = table.column("a").to_numpy() != table.column("b").to_numpy()
            grams = [np.frombuffer(g.as_py(), np.uint64) for g in table.column("grams")]
            out: list[list[np.ndarray]] = [[], [], []]
            for a, b in _groups(table, "tile"):
                once = a + np.unique(ids[a:b], return_index=True)[1]
                near = _near([grams[i] for i in once], threshold)
                if split[a]:  # pairs inside a slice belong to its own tile
                    near &= mine[once, None] != mine[None, once]
                forest = _Forest(len(once))
                for i in range(len(once)):
                    forest.join(i, np.flatnonzero(near[i]))
                roots = np.array([forest.root(i) for i in range(len(once))])
                out[0].append(ids[once])
                out[1].append(near @ copies[once])
                out[2].append(ids[once][roots])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in out], names=["c", "links", "with"])

    return tiles.mapInArrow(work, "c long, links long, with long")


def _near(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of sets have at least this Jaccard similarity."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    common = np.zeros((n, n), np.float64)
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.concatenate([[True], values[1:] != values[:-1]])
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    column, owner = np.unique(column[shared], return_inverse=True)[1], owner[shared]
    step = max(1, 4_000_000 // n)
    for lo in range(0, int(column.max()) + 1 if len(column) else 0, step):
        part = slice(*np.searchsorted(column, [lo, lo + step]))
        block = np.zeros((n, step if len(column) else 0), np.float32)
        block[owner[part], column[part] - lo] = 1
        common += block @ block.T
    near = common >= threshold * (sizes[:, None] + sizes[None] - common) - 1e-9
    np.fill_diagonal(near, False)
    return near


def jaccard_links(
    docs: DataFrame, threshold: float = 0.8, size: int = 5, recall: float = 0.999, small: int = 1000, depth: int = 6, seed: int = 3,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per document: ``id``, ``tx`` (hash of the text), ``class_id`` (smallest id among all documents
    it is linked to, directly or through others), ``same_id`` (smallest id with the same set), ``copies``
    (documents with the same set), ``links`` (other documents at the threshold, copies included), and
    ``first``, the place of the component's first document. Without a set ``class_id`` is the own id.
    """
    sets = stage(_sets_of(docs, doc_id, text, size), "jaccard-sets")
    classes = stage(
        sets.where("n > 0").groupBy("c", "c2").agg(F.min(F.struct(place().alias("at"), "sig")).alias("m"), F.count("*").alias("copies"))
        .select("c", "m.at", "m.sig", "copies"), "jaccard-classes")
    blocks = _blocks(classes, threshold, recall, small, depth, seed)
    sizes = blocks.groupBy("root").agg(F.count("*").alias("n"))
    members = stage(
        blocks.join(sizes, "root").join(classes.select("c", "at", "copies"), "c").select("root", "c", "n", "copies", "at.id", "at.tx"),
        "jaccard-members")
    links = stage(_verified(docs, members, size, threshold, doc_id, text), "jaccard-links")
    joined = components(links.select(F.col("c").alias("u"), F.col("with").alias("v")))
    found = links.groupBy("c").agg(F.sum("links").alias("links")).where("links > 0").join(
        joined.withColumnRenamed("node", "c"), "c", "left")
    result = classes.join(found, "c", "left").withColumn("root", F.coalesce("root", "c"))
    firsts = result.groupBy("root").agg(F.min("at").alias("first"))
    result = stage(result.join(firsts, "root").select(
        "c", "first", F.col("at.id").alias("same_id"), "copies", F.coalesce("links", F.lit(0)).alias("links")), "jaccard-result")
    df = sets.select("id", "tx", F.when(F.col("n") > 0, F.col("c")).alias("c")).join(result.hint("merge"), "c", "left")
    alone = F.col("first").isNull()
    return df.select(
        "id", "tx", F.when(alone, F.col("id")).otherwise(F.col("first.id")).alias("class_id"),
        F.when(alone, F.col("id")).otherwise(F.col("same_id")).alias("same_id"), F.coalesce("copies", F.lit(1)).alias("copies"),
        F.coalesce(F.col("copies") - 1 + F.col("links"), F.lit(0)).alias("links"), "first")


def one_of_each(docs: DataFrame, links: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without near duplicates: the first of each component stays, and all without a set."""
    at = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("tx").alias("tx"))
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    gone = links.where(F.col("first").isNotNull() & (F.col("first") != at)).select(
        F.col("tx").alias("__tx"), name(F.col("id")).alias("__name"), F.col("id").isNull().alias("__none")).distinct()
    keys = ["__tx", "__name", "__none"]
    packed = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.xxhash64(whole(docs[f"`{text}`"])).alias("__tx"),
        name(docs[f"`{doc_id}`"]).alias("__name"), docs[f"`{doc_id}`"].isNull().alias("__none"),
        whole(docs[f"`{text}`"]).rlike(WORD).alias("__words"))
    kept = packed.join(gone, keys, "left_anti")
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy("__words"))
    return kept.withColumn("__turn", turn).where(~F.col("__words") | (F.col("__turn") == 1)).select("row.*")
