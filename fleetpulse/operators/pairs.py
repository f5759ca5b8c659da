"""Work over all pairs of points: energy test, silhouette, neighbours, distance histograms.

The results need every pair, so the work is quadratic; what is bounded is everything else.
Points are dealt by a stable hash into super-blocks of blocks of ``block_rows``: up to twice ``SPREAD``
of them, and more only if one would exceed ``SIDE_ROWS`` points. A pair of super-blocks is one tile: a task walks
over its pairs of blocks, one numpy matrix of fixed size at a time, so a point travels once per
super-block, not n / ``block_rows`` times. A tile emits only sums, counts or per-point partials, added up before
they leave it, never its pairs; tiles are balanced whatever the data looks like.

Neighbours don't need every pair: ``nearest_rows`` skips cells of rows that the triangle
inequality rules out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetpulse.functions.scalars import cosine_distance, euclidean, hash_number, stable_hash
from fleetpulse.operators.ranking import hash_sample, kth_hash, kth_hashes
from fleetpulse.session import staged

BLOCK_ROWS = 1024
SIDE_ROWS = 32_768  # points on a side of a tile at most, which a task holds
SPREAD = 16  # super-blocks that are kept at least before tiles widen: 136 tiles for the tasks
STORED_BYTES = 1_000_000_000  # of stored distances that lie on disk at a time
TASK_BYTES = 64_000_000  # of distances that a task hands on to be stored
MAX_PIVOTS = 1024  # pivots of a neighbour search, and so the rows of its table of cells


# ---- numpy helpers used inside tiles --------------------------------------------------------


def _euclidean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    centre = a.mean(axis=0)
    a, b = a - centre, b - centre
    na, nb = (a * a).sum(1)[:, None], (b * b).sum(1)[None, :]
    sq = a @ b.T
    sq *= 2.0
    np.subtract(na + nb, sq, out=sq)
    # where the expansion cancels, take the difference itself; most blocks have no such pair
    if not (sq.size and sq.min() > 1e-6 * (na.max() + nb.max())):
        close = np.nonzero(~(sq > 1e-6 * (na + nb)))
        if close[0].size:
            diff = a[close[0]] - b[close[1]]
            sq[close] = (diff * diff).sum(1)
    return np.sqrt(sq, out=sq)


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    la, lb = np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))
    return 1.0 - (a @ b.T) / la[:, None] / lb[None, :]


def _city_block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of ``|x - y|`` as ``2 max(x, y) - x - y``: one pass per pair and dimension, and a product that adds them up."""
    centre = a.mean(axis=0)
    left, right = a - centre, np.ascontiguousarray((b - centre).T)
    out, larger, ones = np.empty((len(a), len(b))), np.empty_like(right), np.ones(len(right))
    for i, x in enumerate(left[:, :, None]):
        np.maximum(x, right, out=larger)
        np.matmul(ones, larger, out=out[i])
    out *= 2.0
    out -= left.sum(1)[:, None]
    out -= right.sum(0)
    # where this cancels, take the differences themselves; most blocks have no such pair
    na, nb = np.abs(left).sum(1)[:, None], np.abs(right).sum(0)[None, :]
    if not (out.size and out.min() > 1e-6 * (na.max() + nb.max())):
        close = np.nonzero(~(out > 1e-6 * (na + nb)))
        if close[0].size:
            out[close] = np.abs(a[close[0]] - b[close[1]]).sum(1)
    return out


METRICS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "euclidean": _euclidean,
    "cosine": _cosine,
    "cityblock": _city_block,
}


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


# ---- dealing points into tiles --------------------------------------------------------------


def _dealt(points: DataFrame, row_id: str, block_rows: int, span: int = 1) -> DataFrame:
    """Adds ``_b``, the (super-)block of each point, and ``_nb``, how many there are."""
    n = points.agg(F.count("*").alias("n")).scalar()
    blocks = F.ceil(n / block_rows)
    wide = F.least(F.greatest(F.floor(F.col("_nb") / SPREAD), F.lit(1)), F.lit(span))
    dealt = points.withColumn("_nb", F.greatest(blocks, F.lit(1)))
    dealt = dealt.withColumn("_nb", F.ceil(F.col("_nb") / wide).cast("int"))
    return dealt.withColumn("_b", (hash_number(stable_hash(row_id)) % F.col("_nb")).cast("int"))


def to_tiles(points: DataFrame, row_id: str, block_rows: int = BLOCK_ROWS, span: int = 1) -> DataFrame:
    """Each point once per tile it takes part in: adds ``ti`` <= ``tj`` and ``side``.

    ``side`` is 0 for the tile's rows, 1 for its columns, 2 in a diagonal tile (both). A tile has up
    to ``span`` blocks on a side, fewer while that would leave less than ``SPREAD`` super-blocks.
    """
    dealt = _dealt(points, row_id, block_rows, span)
    dealt = dealt.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
    side = F.when(F.col("_b") == F.col("_o"), 2).when(F.col("_b") < F.col("_o"), 0).otherwise(1)
    return dealt.withColumns(
        {"ti": F.least("_b", "_o"), "tj": F.greatest("_b", "_o"), "side": side}
    ).drop("_nb", "_b", "_o")


def _sides(pdf: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, bool]:
    diagonal = bool(pdf["ti"].iat[0] == pdf["tj"].iat[0])
    if diagonal:
        return pdf, pdf, True
    return pdf[pdf["side"] == 0], pdf[pdf["side"] == 1], False


def tile_apply(
    points: DataFrame, row_id: str, fn: Callable[..., pd.DataFrame],
    schema: str, block_rows: int = BLOCK_ROWS, span: int | None = None,
    combine: Callable[[pd.DataFrame], pd.DataFrame] | None = None, vec: str | None = None, whole: bool = False,
) -> DataFrame:
    """Run ``fn(rows, columns, diagonal)`` on every pair of blocks of every tile.

    With ``vec`` the vectors of rows and columns follow as matrices, made once per block, not per pair of
    blocks. ``combine`` adds up the results of a tile's blocks row of blocks by row of blocks. ``span`` is the
    most blocks on a side, by default ``SIDE_ROWS`` points; with 1, or ``whole``, every tile is a single call. A
    ``whole`` call walks over the blocks itself (``_walk``) and keeps what it needs per block.
    """
    span = max(1, SIDE_ROWS // block_rows) if span is None else span
    columns = [c.split()[0] for c in schema.split(",")]
    whole = whole or span == 1

    def blocks(pdf: pd.DataFrame) -> list[pd.DataFrame]:
        return [pdf] if whole else [pdf.iloc[k : k + block_rows] for k in range(0, len(pdf), block_rows)]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, cols, diagonal = _sides(pdf)
        done = pd.DataFrame({c: [] for c in columns})
        if len(rows) == 0 or len(cols) == 0:
            return done
        across = blocks(cols)
        vectors = [] if vec is None else [_matrix(b[vec]) for b in across]
        found: list[pd.DataFrame] = []
        for i, left in enumerate(blocks(rows)):
            mine = [] if vec is None else [_matrix(left[vec])]
            found += [fn(left, right, diagonal and i == j, *mine, *vectors[j : j + 1]) for j, right in enumerate(across) if j >= i or not diagonal]
            if combine is not None:
                found = [combine(pd.concat(found))]
        return pd.concat(found)[columns]

    return to_tiles(points, row_id, block_rows, span).groupBy("ti", "tj").applyInPandas(run, schema)


def _walk(rows: int, cols: int, diagonal: bool, step: int) -> Iterator[tuple[slice, slice, bool]]:
    """Blocks of a tile, row of blocks by row of blocks, and whether one is on the diagonal."""
    for i in range(0, rows, step):
        for j in range(i if diagonal else 0, cols, step):
            yield slice(i, i + step), slice(j, j + step), diagonal and i == j


def _added(keys: list[str]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Sums of all other columns by key."""
    return lambda parts: parts.groupby(keys, sort=False).sum().reset_index()


# ---- pair distances -------------------------------------------------------------------------


def pair_sums(points: DataFrame, row_id: str, vec: str, grp: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(g, h, n, total, nearest, farthest) over unordered pairs, by the pair of group values g <= h."""

    def fn(rows: pd.DataFrame, cols: pd.DataFrame, diagonal: bool, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
        def ordered(part: pd.DataFrame, x: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
            """Vectors in order of their groups, a group being a run; groups, first rows and sizes of each block."""
            order = np.argsort(part["g"].to_numpy(), kind="stable")
            g = part["g"].to_numpy()[order]
            return x[order], [np.unique(g[k : k + block_rows], return_index=True, return_counts=True) for k in range(0, len(g), block_rows)]

        a, across = ordered(rows, a)
        b, down = (a, across) if diagonal else ordered(cols, b)
        found: list[pd.DataFrame] = []
        held: list[tuple[np.ndarray, ...]] = []
        last = 0
        for left, right, same in _walk(len(a), len(b), diagonal, block_rows):
            if left.start != last:  # a row of blocks is done
                found, held, last = [added([*found, framed(held)])], [], left.start
            (g, i, ni), (h, j, nj) = across[left.start // block_rows], down[right.start // block_rows]
            d = _euclidean(a[left], b[right])
            if same:
                use = np.triu(np.ones(d.shape, dtype=bool), 1)
                n = np.triu(np.outer(ni, nj), 1) + np.diag(ni * (ni - 1) // 2)
                lists = [np.where(use, d, x) for x in (0.0, np.inf, -np.inf)]
            else:
                n, lists = np.outer(ni, nj), [d, d, d]
            if n.size == 1:
                sums = [of.reduce(x, axis=None, keepdims=True) for of, x in zip((np.add, np.minimum, np.maximum), lists, strict=True)]
            else:
                sums = [of.reduceat(of.reduceat(x, i, axis=0), j, axis=1) for of, x in zip((np.add, np.minimum, np.maximum), lists, strict=True)]
            k, m = np.nonzero(n)
            held.append((np.minimum(g[k], h[m]), np.maximum(g[k], h[m]), n[k, m], *[x[k, m] for x in sums]))
        return added([*found, framed(held)])

    names = ["g", "h", "n", "total", "nearest", "farthest"]

    def framed(held: list[tuple[np.ndarray, ...]]) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*held, strict=True)), strict=True)))

    def added(parts: list[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat(parts).groupby(["g", "h"]).agg({"n": "sum", "total": "sum", "nearest": "min", "farthest": "max"}).reset_index()

    p = points.select(F.col(row_id).alias("id"), F.col(vec).alias("v"), F.col(grp).alias("g"))
    parts = tile_apply(p, "id", fn, "g int,h int,n long,total double,nearest double,farthest double", block_rows, vec="v", whole=True)
    return parts.groupBy("g", "h").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"),
        F.min("nearest").alias("nearest"), F.max("farthest").alias("farthest"),
    )


def unit_variance(points: DataFrame, vec: str) -> DataFrame:
    """Vectors divided by each dimension's sample standard deviation; 0 in a constant dimension."""
    stds = (
        points.select(F.posexplode(vec).alias("k", "x")).groupBy("k").agg(F.stddev_samp("x").alias("s"))
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "s"))), lambda e: e["s"]).alias("stds"))
    )
    return points.withColumn("_stds", stds.scalar()).withColumn(
        vec, F.zip_with(vec, "_stds", lambda x, s: F.when(s > 0, x / s).otherwise(F.lit(0.0)))
    ).drop("_stds")


def distance_summary(points: DataFrame, row_id: str, vec: str, metric: str = "euclidean", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(n, mean, std, lo, hi) of all pair distances; ``seuclidean`` is scaled Euclidean."""
    p = points.select(F.col(row_id).alias("id"), F.transform(vec, lambda x: x.cast("double")).alias("v"))
    if metric == "seuclidean":
        p, metric = unit_variance(p, "v"), "euclidean"
    measure = METRICS[metric]

    def fn(_: pd.DataFrame, __: pd.DataFrame, diagonal: bool, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
        found = []
        for left, right, same in _walk(len(a), len(b), diagonal, block_rows):
            d = measure(a[left], b[right])
            x = d[np.triu_indices(len(d), 1)] if same else d.ravel()
            if x.size:
                m, lo, hi = x.mean(), x.min(), x.max()
                x -= m
                found.append((x.size, m, np.dot(x, x), lo, hi))
        return pd.DataFrame(found, columns=["n", "m", "q", "lo", "hi"])

    parts = tile_apply(p, "id", fn, "n long,m double,q double,lo double,hi double", block_rows, vec="v", whole=True)
    # blocks carry their own mean, so their spread adds without cancellation
    whole = parts.agg(
        F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"),
        F.sum("q").alias("within"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("raw"),
        F.min("lo").alias("lo"), F.max("hi").alias("hi"),
    )
    between = F.greatest(F.col("raw") - F.col("n") * F.col("mean") * F.col("mean"), F.lit(0.0))
    return whole.select("n", "mean", F.sqrt((F.col("within") + between) / F.col("n")).alias("std"), "lo", "hi")


def distance_histogram(points: DataFrame, row_id: str, vec: str, metric: str = "euclidean", n_bins: int = 500, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(bin, n): counts of pair distances in ``n_bins`` equal bins from the smallest to the largest."""
    p = points.select(F.col(row_id).alias("id"), F.transform(vec, lambda x: x.cast("double")).alias("v"))
    if metric == "seuclidean":
        p, metric = unit_variance(p, "v"), "euclidean"
    measure = METRICS[metric]

    def ends(_: pd.DataFrame, __: pd.DataFrame, diagonal: bool, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
        d = measure(a, b)
        x = d[np.triu_indices(len(d), 1)] if diagonal else d
        return pd.DataFrame({"lo": [x.min()], "hi": [x.max()]} if x.size else {"lo": [], "hi": []})

    span = tile_apply(p, "id", ends, "lo double,hi double", block_rows, vec="v").agg(F.struct(F.min("lo").alias("lo"), F.max("hi").alias("hi")).alias("s"))
    p = p.withColumn("s", span.scalar()).select("id", "v", "s.lo", "s.hi")

    def fn(rows: pd.DataFrame, _: pd.DataFrame, diagonal: bool, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
        d = measure(a, b)
        x = d[np.triu_indices(len(d), 1)] if diagonal else d.ravel()
        lo, hi = rows["lo"].iat[0], rows["hi"].iat[0]
        if pd.notna(lo) and np.isfinite(hi) and lo < hi:
            x -= lo
            x /= (hi - lo) / n_bins
            # a distance may be off the ends by rounding, as blocks are not cut alike in both passes
            counts = np.bincount(np.clip(x.astype(np.intp), 0, n_bins - 1), minlength=n_bins)
        else:
            counts, _ = np.histogram(x, bins=n_bins, range=(lo, hi))
        used = np.nonzero(counts)[0]
        return pd.DataFrame({"bin": used + 1, "n": counts[used]})

    return tile_apply(p, "id", fn, "bin int,n long", block_rows, combine=_added(["bin"]), vec="v").groupBy("bin").agg(F.sum("n").alias("n"))


def distances_to_centres(points: DataFrame, vec: str, centres: DataFrame, precision: np.ndarray | None = None) -> DataFrame:
    """Each point with each centre: Euclidean and cosine distance, and Mahalanobis if a
    precision matrix (d x d) is given.

    ``centres`` (cluster, centre) has one row per cluster and travels as a scalar value.
    """
    packed = centres.agg(F.array_sort(F.collect_list(F.struct("cluster", "centre"))).alias("cs"))
    out = points.withColumn("_cs", packed.scalar()).withColumn("_c", F.explode("_cs")).withColumns({
        "centre_id": F.col("_c.cluster"),
        "euclidean": euclidean(vec, "_c.centre"),
        "cosine": cosine_distance(vec, "_c.centre"),
    })
    if precision is not None:
        # a one-row frame keeps the d x d numbers out of the plan
        rows = points.sparkSession.createDataFrame([(precision.tolist(),)], "m array<array<double>>").scalar()
        diff = F.zip_with(vec, "_c.centre", lambda x, y: x - y)
        out = out.withColumn("_d", diff).withColumn("_p", rows)
        inner = F.transform("_p", lambda r: F.aggregate(F.zip_with(r, "_d", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))
        total = F.aggregate(F.zip_with(inner, "_d", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        out = out.withColumn("mahalanobis", F.sqrt(total)).drop("_d", "_p")
    return out.drop("_cs", "_c")


def centres_of(points: DataFrame, vec: str, cluster: str) -> DataFrame:
    """(cluster, centre): mean vector of each cluster."""
    long = points.select(F.col(cluster).alias("cluster"), F.posexplode(vec).alias("k", "x"))
    means = long.groupBy("cluster", "k").agg(F.avg("x").alias("m"))
    return means.groupBy("cluster").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda e: e["m"]).alias("centre")
    )


# ---- energy two-sample test -----------------------------------------------------------------


def replicate_cuts(points: DataFrame, row_id: str, k: Column, replicates: int, seed: int = 0) -> DataFrame:
    """One row: for each replicate the k-th smallest hash of the ids.

    Ids at or below replicate r's cut form its first sample: a permutation split with exact
    sizes, without ordering the points.
    """
    reps = F.explode(F.sequence(F.lit(1), F.lit(replicates)))
    hashes = points.select(F.col(row_id).alias("id"), reps.alias("cell"))
    hashes = hashes.select("cell", stable_hash("id", seed=F.col("cell") + seed).alias("h"))
    need = points.sparkSession.range(1, replicates + 1).select(F.col("id").cast("int").alias("grp"), k.cast("long").alias("need"))
    cuts = kth_hashes(hashes, need)
    return cuts.agg(F.transform(F.array_sort(F.collect_list(F.struct("grp", "cut"))), lambda e: e["cut"]).alias("cuts"))


def with_assignments(points: DataFrame, row_id: str, grp: str, replicates: int, seed: int = 0) -> DataFrame:
    """Adds ``bits``: element 0 tells whether the point is in the first sample, element r
    whether replicate r puts it there."""
    first = F.col(grp) == F.lit("X")
    if replicates == 0:
        return points.withColumn("bits", F.array(first))
    n1 = points.agg(F.count_if(first).alias("n")).scalar()
    marked = points.withColumn("_cuts", replicate_cuts(points, row_id, n1, replicates, seed).scalar())
    drawn = F.transform("_cuts", lambda cut, i: stable_hash(F.col(row_id), seed=i + 1 + seed) <= cut)
    return marked.withColumn("bits", F.concat(F.array(first), drawn)).drop("_cuts")


_SUMS = "r int,sxx double,sxy double,syy double"


def _energy_sums(d: np.ndarray, ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray, diagonal: bool) -> pd.DataFrame:
    """Sums of distances inside and across the samples; a column of weights per replicate and sample."""
    dx, dy = d @ bx, d @ by
    # ordered pairs inside a sample, each cross pair once
    twice = 1.0 if diagonal else 2.0
    xx, yy, xy = twice * (ax * dx).sum(0), twice * (ay * dy).sum(0), (ax * dy).sum(0)
    if not diagonal:
        xy = xy + (ay * dx).sum(0)
    return pd.DataFrame({"r": np.arange(len(xx)), "sxx": xx, "sxy": xy, "syy": yy})


def _samples(bits: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Weights in the first and the second sample of points that are in one of them."""
    x = _matrix(bits)
    return x, 1.0 - x


def _statistics(parts: DataFrame, points: DataFrame, grp: str) -> DataFrame:
    sizes = points.agg(F.struct(
        F.count_if(F.col(grp) == "X").cast("double").alias("x"), F.count_if(F.col(grp) == "Y").cast("double").alias("y")
    ).alias("n"))
    sums = parts.groupBy("r").agg(*[F.sum(c).alias(c) for c in ["sxx", "sxy", "syy"]]).withColumn("n", sizes.scalar())
    return sums.select("r", _energy(F.col("n.x"), F.col("n.y")).alias("energy"))


def _energy(n1: Column, n2: Column) -> Column:
    inner = 2 * F.col("sxy") / (n1 * n2) - F.col("sxx") / (n1 * n1) - F.col("syy") / (n2 * n2)
    return n1 * n2 / (n1 + n2) * inner


def energy_statistics(
    points: DataFrame, row_id: str, vec: str, grp: str, replicates: int = 0, seed: int = 0, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(r, energy): the statistic of the two samples (r = 0) and of each permutation replicate.

    Each tile builds its distances once and serves all replicates by matrix products.
    """
    p = points.select(F.col(row_id).alias("id"), F.col(vec).alias("v"), F.col(grp).alias("g"))
    bits = with_assignments(p, "id", "g", replicates, seed).select("id", "v", "bits")

    def fn(rows: pd.DataFrame, cols: pd.DataFrame, diagonal: bool) -> pd.DataFrame:
        d = _euclidean(_matrix(rows["v"]), _matrix(cols["v"]))
        return _energy_sums(d, *_samples(rows["bits"]), *_samples(cols["bits"]), diagonal)

    return _statistics(tile_apply(bits, "id", fn, _SUMS, block_rows, combine=_added(["r"])), p, "g")


def stripes(points: DataFrame, block_rows: int = BLOCK_ROWS, limit: int = STORED_BYTES) -> list[tuple[int, int]]:
    """Ranges of blocks of rows whose distances to the blocks from theirs on take ``limit`` bytes or one block of rows."""
    n = points.count()
    blocks, found, first = max(-(-n // block_rows), 1), [], 0
    while first < blocks:
        width = max(n - first * block_rows, 1)
        last = min(first + max(limit // (8 * width * block_rows), 1), blocks)
        # rows of a stripe have fewer columns the later they come
        while last < blocks and 4 * (width + n - last * block_rows) * (last + 1 - first) * block_rows <= limit:
            last += 1
        found.append((first, last))
        first = last
    return found


def distance_tiles(points: DataFrame, row_id: str, vec: str, block_rows: int = BLOCK_ROWS, stripe: tuple[int, int] | None = None) -> DataFrame:
    """The pair-distance matrix as blocks (ti, tj, a_ids, b_ids, dist), to be written and reused.

    With ``stripe`` only the blocks ti of that range, with every tj from ti on. A task has the rows of the stripe
    and some blocks of columns, as many as ``TASK_BYTES`` allow and fewer while there are less than ``SPREAD`` tasks, so
    a point is sent once as a column and, in a stripe, once per task as a row.
    """
    p = _dealt(points.select(F.col(row_id).cast("long").alias("id"), F.col(vec).alias("v")), "id", block_rows)
    low, high = (F.lit(x) for x in stripe) if stripe else (F.lit(0), F.col("_nb"))
    size = (F.least(high, "_nb") - low) * F.col("_nb") * F.lit(8.0 * block_rows * block_rows)
    p = p.withColumn("_tasks", F.least("_nb", F.greatest(F.lit(SPREAD), F.ceil(size / TASK_BYTES))).cast("long"))
    own = F.floor(F.col("_b") * F.col("_tasks") / F.col("_nb")).cast("int")
    columns = p.where(F.col("_b") >= low).select("id", "v", "_b", F.lit(1).alias("side"), own.alias("task"))
    rows = p.where((F.col("_b") >= low) & (F.col("_b") < high)).select(
        "id", "v", "_b", F.lit(0).alias("side"), F.explode(F.sequence(own, F.col("_tasks").cast("int") - 1)).alias("task"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        def blocks(side: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
            part = pdf[pdf["side"] == side].sort_values(["_b", "id"])
            return [(b, block["id"].to_numpy(), _matrix(block["v"])) for b, block in part.groupby("_b")]

        across = blocks(1)
        return pd.DataFrame(
            [(ti, tj, a_ids, b_ids, _euclidean(a, b).ravel()) for ti, a_ids, a in blocks(0) for tj, b_ids, b in across if ti <= tj],
            columns=["ti", "tj", "a_ids", "b_ids", "dist"])

    return rows.unionByName(columns).groupBy("task").applyInPandas(run, "ti int,tj int,a_ids array<long>,b_ids array<long>,dist array<double>")


def energy_from_tiles(
    tiles: DataFrame | Iterable[DataFrame], points: DataFrame, row_id: str, grp: str, replicates: int, seed: int = 0, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """``energy_statistics`` from stored distance blocks (made with the same ``block_rows``).

    The distances are read where they are stored and never shuffled. What goes to them are the samples of the
    points of each block, two bits per replicate: with the ids some 33 bytes a point for 99 replicates.
    Stripes of the matrix can be given one after the other: the sums of one are written before the next is asked for, which
    may then take its place.
    """
    p = points.select(F.col(row_id).cast("long").alias("id"), F.col(grp).alias("g"))
    blocks = _sample_blocks(p, replicates, seed, block_rows)
    if isinstance(tiles, DataFrame):
        return _statistics(_sums_of_tiles(tiles, blocks, replicates), p, "g")
    blocks = staged(blocks, "samples")
    sums = [staged(_sums_of_tiles(stripe, blocks, replicates).groupBy("r").agg(*[F.sum(c).alias(c) for c in ["sxx", "sxy", "syy"]]), "stripe-sums") for stripe in tiles]
    whole = sums[0].sparkSession.read.schema(sums[0].schema).parquet(*[f for part in sums for f in part.inputFiles()]) if len(sums) > 1 else sums[0]
    return _statistics(whole, p, "g")


def _sample_blocks(p: DataFrame, replicates: int, seed: int, block_rows: int) -> DataFrame:
    """(b, ids, marks): for each block of points (id, g) the ids and, two bits each, whether a replicate draws them or can't tell."""
    bits = _dealt(with_assignments(p, "id", "g", replicates, seed).select("id", "bits"), "id", block_rows)

    def pack(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("id")
        x = _matrix(block["bits"])
        packed = np.packbits(np.hstack([x == 1, np.isnan(x)]), axis=1)
        ids = block["id"].to_numpy()
        if ((ids[1:] == ids[:-1]) & (packed[1:] != packed[:-1]).any(axis=1)).any():
            raise ValueError("points of one id are in different samples")
        return pd.DataFrame({"b": [block["_b"].iat[0]], "ids": [ids], "marks": [packed.tobytes()]})

    return bits.select("_b", "id", "bits").groupBy("_b").applyInPandas(pack, "b int,ids array<long>,marks binary")


def _sums_of_tiles(tiles: DataFrame, blocks: DataFrame, replicates: int) -> DataFrame:
    """``_SUMS`` of stored distance blocks by the samples of ``_sample_blocks``."""

    def side(name: str, key: str) -> DataFrame:
        return F.broadcast(blocks.select(F.col("b").alias(key), F.col("ids").alias(f"{name}_of"), F.col("marks").alias(f"{name}_marks")))

    def weights(ids: pa.Array, of: pa.Array, marks: bytes) -> tuple[np.ndarray, np.ndarray]:
        known = of.to_numpy(zero_copy_only=False)
        bits = np.unpackbits(np.frombuffer(marks, np.uint8).reshape(len(known), -1), axis=1)
        x = np.where(bits[:, replicates + 1 : 2 * replicates + 2], np.nan, bits[:, : replicates + 1])
        wanted = ids.to_numpy(zero_copy_only=False)
        if len(wanted) != len(known) or (wanted != known).any():
            raise ValueError("the stored distances are not of these points")
        return x, 1.0 - x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: pd.DataFrame | None = None
        for batch in batches:
            c = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            for k in range(batch.num_rows):
                a, b = c["a_ids"][k].values, c["b_ids"][k].values
                ax, ay = weights(a, c["a_of"][k].values, c["a_marks"][k].as_py())
                bx, by = weights(b, c["b_of"][k].values, c["b_marks"][k].as_py())
                d = c["dist"][k].values.to_numpy(zero_copy_only=False).reshape(len(a), len(b))
                one = _energy_sums(d, ax, ay, bx, by, c["ti"][k].as_py() == c["tj"][k].as_py())
                total = one if total is None else _added(["r"])(pd.concat([total, one]))
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(total["r"], pa.int32()), *[pa.array(total[x], pa.float64()) for x in ("sxx", "sxy", "syy")]], names=["r", "sxx", "sxy", "syy"])

    return tiles.join(side("a", "ti"), "ti").join(side("b", "tj"), "tj").mapInArrow(run, _SUMS)


def check_bootstrap(replicates: int, alpha: float) -> None:
    """alpha is a percentage and (replicates + 1) * alpha/100 a whole number."""
    if not 0 <= alpha <= 100:
        raise ValueError("alpha must be a percentage between 0 and 100")
    if not float(round((replicates + 1) * alpha / 100, 9)).is_integer():
        raise ValueError("alpha does not fit the number of replicates")


def permutation_outcome(statistics: DataFrame, alpha: float, by: Sequence[str] = ()) -> DataFrame:
    """(observed, limit, p_value, reject): replicates above the observed value give p."""
    by = list(by)
    observed = F.max(F.when(F.col("r") == 0, F.col("energy")))
    reps = F.when(F.col("r") > 0, F.col("energy"))
    base = statistics.groupBy(*by).agg(
        observed.alias("observed"),
        F.percentile(reps, 1 - alpha / 100).alias("limit"),       # at most `replicates` values
        F.collect_list(reps).alias("_reps"),
    )
    above = F.size(F.filter("_reps", lambda e: e > F.col("observed")))
    p = above / F.size("_reps")
    return base.select(*by, "observed", "limit", p.alias("p_value"), (p < alpha / 100).alias("reject"))


def energy_test(
    points: DataFrame, row_id: str, vec: str, grp: str, replicates: int = 99, alpha: float = 1,
    seed: int = 0, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Permutation test that the X and Y samples come from one distribution."""
    check_bootstrap(replicates, alpha)
    return permutation_outcome(energy_statistics(points, row_id, vec, grp, replicates, seed, block_rows), alpha)


def repeated_energy_test(
    points: DataFrame, row_id: str, vec: str, grp: str, replicates: int = 99, alpha: float = 1,
    repeats: int = 10, sample_size: int | None = None, similar: bool = False, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One row per repeat: the test on fresh subsamples of each sample.

    ``sample_size`` rows are drawn from each sample, all of them by default; it must not exceed a
    sample. ``similar`` is the control: both subsamples come from X, by default two halves of it.
    A point is sent to its tiles once for all repeats, and a distance serves all of them.
    """
    check_bootstrap(replicates, alpha)
    x, y = points.where(F.col(grp) == "X"), points.where(F.col(grp) == "Y")
    nx, ny = x.count(), y.count()
    if sample_size is not None and sample_size > (nx // 2 if similar else min(nx, ny)):
        raise ValueError(f"sample_size {sample_size} exceeds a sample")
    drawn = _drawn_repeats(points, row_id, vec, grp, repeats, sample_size, similar, nx, ny)
    sizes = drawn.agg(*[
        F.coalesce(F.sum(F.greatest(w, F.lit(0)) if s == "x" else F.greatest(-w, F.lit(0))), F.lit(0)).alias(f"{s}{q}")
        for q in range(repeats) for w in [F.col("w")[q]] for s in "xy"
    ]).first()
    bits = []
    for q in range(repeats):
        seed, w = 1000 * (q + 1), F.col("w")[q]
        # a row counts as often as it was drawn
        ids = drawn.where(w != 0).select("id", F.explode(F.sequence(F.lit(1), F.abs(w)))).select("id")
        cuts = replicate_cuts(ids, "id", F.lit(sizes[f"x{q}"]), replicates, seed)
        bits.append((w > 0, cuts, seed))
    marked = drawn.withColumns({f"_c{q}": cuts.scalar() for q, (_, cuts, _) in enumerate(bits)}) if replicates else drawn

    def assigned(q: int, first: Column, seed: int) -> Column:
        drawn_by = F.transform(f"_c{q}", lambda cut, i: stable_hash("id", seed=i + 1 + seed) <= cut)
        return F.concat(F.array(first), drawn_by) if replicates else F.array(first)

    columns = [assigned(q, first, seed) for q, (first, _, seed) in enumerate(bits)]
    sent = marked.select("id", "v", F.transform("w", lambda e: F.abs(e)).alias("w"), F.concat(*columns).alias("bits"))

    width = repeats * (replicates + 1)
    types = {f.name: f.dataType.simpleString() for f in sent.schema}

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if len(part):
                yield part.assign(bits=[row.tobytes() for row in np.packbits(np.stack(part["bits"].to_numpy()).astype(bool), axis=1)])

    packed = sent.mapInPandas(pack, f"id {types['id']},v {types['v']},w array<int>,bits binary")
    # of each repeat the smaller sample is summed up, the other one is the rest
    turned = np.array([sizes[f"x{q}"] > sizes[f"y{q}"] for q in range(repeats)])
    of = np.repeat(np.arange(repeats), replicates + 1)
    held = 8 * block_rows  # rows whose products are held at a time

    def fn(rows: pd.DataFrame, cols: pd.DataFrame, diagonal: bool, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
        def drawn_in(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
            bits = np.frombuffer(b"".join(part["bits"]), np.uint8).reshape(len(part), -1)
            return np.unpackbits(bits, axis=1, count=width) ^ turned[of].astype(np.uint8), _matrix(part["w"])

        def weights(marks: np.ndarray, w: np.ndarray) -> np.ndarray:
            """A column per repeat and replicate, and one per repeat for both samples."""
            return np.hstack([marks * w[:, of], w])

        mine, theirs = drawn_in(rows), drawn_in(cols)
        inside, across, either = np.zeros(width), np.zeros(width), np.zeros(repeats)
        for first in range(0, len(a), held):
            some = slice(first, first + held)
            x, sums = a[some], np.zeros((len(a[some]), width + repeats))
            for j in range(first if diagonal else 0, len(b), block_rows):
                y = weights(*[t[j : j + block_rows] for t in theirs])
                for i in range(0, len(x), block_rows):
                    if diagonal and first + i > j:
                        continue
                    d = _euclidean(x[i : i + block_rows], b[j : j + block_rows])
                    if diagonal and first + i == j:
                        d *= 0.5  # holds each of its pairs twice
                    sums[i : i + block_rows] += d @ y
            w = weights(*[t[some] for t in mine])
            inside += np.einsum("ij,ij->j", w[:, :width], sums[:, :width])
            across += np.einsum("ij,ij->j", w[:, :width], sums[:, width + of]) + np.einsum("ij,ij->j", w[:, width + of], sums[:, :width])
            either += np.einsum("ij,ij->j", w[:, width:], sums[:, width:])
        # ordered pairs inside a sample, each cross pair once
        xx, xy, yy = 2.0 * inside, across - 2.0 * inside, 2.0 * (either[of] - across + inside)
        return pd.DataFrame({"r": np.arange(width), "sxx": np.where(turned[of], yy, xx), "sxy": xy, "syy": np.where(turned[of], xx, yy)})

    sums = tile_apply(packed, "id", fn, _SUMS, block_rows, vec="v", whole=True)
    sums = sums.withColumns({"repeat": F.floor(F.col("r") / (replicates + 1)).cast("int"), "r": F.col("r") % (replicates + 1)})
    totals = points.sparkSession.createDataFrame(
        [(q, float(sizes[f"x{q}"]), float(sizes[f"y{q}"])) for q in range(repeats)], "repeat int, x double, y double")
    sums = sums.groupBy("repeat", "r").agg(*[F.sum(c).alias(c) for c in ["sxx", "sxy", "syy"]]).join(F.broadcast(totals), "repeat")
    statistics = sums.select("repeat", "r", _energy(F.col("x"), F.col("y")).alias("energy"))
    each = permutation_outcome(statistics, alpha, ["repeat"])
    return totals.select("repeat").join(each, "repeat", "left").select("observed", "limit", "p_value", "reject", "repeat")


def _drawn_repeats(
    points: DataFrame, row_id: str, vec: str, grp: str, repeats: int, sample_size: int | None, similar: bool, nx: int, ny: int
) -> DataFrame:
    """(id, v, w), written: ``w`` has for each repeat how often the point is in its sample, below 0 if in the second."""
    p = points.select(F.col(row_id).alias("id"), F.col(vec).alias("v"), F.col(grp).alias("g"))
    half = sample_size or nx // 2
    wanted = {"X": 2 * half if similar else sample_size or nx, "Y": 0 if similar else sample_size or ny}
    have = {"X": nx, "Y": ny}

    def drawn(rows: DataFrame, n: int, k: int, seed: int) -> Column:
        """The ``k`` of ``n`` rows with the smallest hashes."""
        if k >= n or k == 0:
            return F.lit(k > 0)
        cut = kth_hash(rows, ["id"], F.lit(k), seed).first()[0]
        return stable_hash("id", seed=seed) <= cut

    marks = []
    for q in range(repeats):
        seed = 1000 * (q + 1)
        inside = {g: drawn(p.where(F.col("g") == g), have[g], k, seed) for g, k in wanted.items()}
        if similar:
            # a second hash splits the drawn rows into two halves of equal size
            rows = p.where((F.col("g") == "X") & inside["X"])
            left = drawn(rows, wanted["X"], half, seed + 1) & F.col("id").isNotNull()
            marks.append(F.when((F.col("g") == "X") & inside["X"], F.when(left, F.col("_n")).otherwise(-1)).otherwise(0))
        else:
            marks.append(F.when((F.col("g") == "X") & inside["X"], 1).when((F.col("g") == "Y") & inside["Y"], -1).otherwise(0))
    p = p.where(F.col("g").isin("X") if similar else F.col("g").isin("X", "Y"))
    if similar:  # rows of one id count for each other in the first half
        again = p.groupBy("id").agg(F.count("*").cast("int").alias("_n")).where("_n > 1")
        p = p.join(again, "id", "left").withColumn("_n", F.coalesce("_n", F.lit(1)))
    return staged(p.select("id", "v", F.array(*[m.cast("int") for m in marks]).alias("w")), "sample")


def repeated_summary(tests: DataFrame, alpha: float) -> DataFrame:
    """(mean_p, std_p, reject) over the repeats."""
    return tests.agg(F.avg("p_value").alias("mean_p"), F.stddev_pop("p_value").alias("std_p")).select(
        "mean_p", "std_p", (F.col("mean_p") < alpha / 100).alias("reject")
    )


# ---- silhouette and neighbours --------------------------------------------------------------


def silhouettes(points: DataFrame, row_id: str, vec: str, cluster: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, cluster, silhouette): exact Euclidean silhouette of every point; 0 in a cluster of one."""
    return silhouettes_of(points, row_id, vec, [cluster], block_rows).drop("nth")


def silhouettes_of(points: DataFrame, row_id: str, vec: str, clusters: Sequence[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(nth, id, cluster, silhouette): ``silhouettes`` by each of several cluster columns, ``nth`` among them.

    A distance serves all of them: the sums towards the clusters of every column are one matrix product.
    """
    names = [f"c{q}" for q in range(len(clusters))]
    p = points.select(F.col(row_id).alias("id"), F.col(vec).alias("v"), *[F.col(c).cast("int").alias(n) for n, c in zip(names, clusters, strict=True)])

    def fn(rows: pd.DataFrame, cols: pd.DataFrame, diagonal: bool, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
        d = _euclidean(a, b)

        def towards(d: np.ndarray, me: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
            found = [np.unique(other[c].to_numpy(), return_inverse=True) for c in names]
            sums = d @ np.hstack([np.eye(len(of))[codes] for of, codes in found])
            ends = np.cumsum([len(of) for of, _ in found])
            return pd.concat([pd.DataFrame({
                "nth": q, "id": np.repeat(me["id"].to_numpy(), len(of)), "c": np.repeat(me[names[q]].to_numpy(), len(of)),
                "other": np.tile(of, len(me)), "total": sums[:, end - len(of) : end].ravel(),
            }) for q, ((of, _), end) in enumerate(zip(found, ends, strict=True))])

        out = towards(d, rows, cols)
        return out if diagonal else pd.concat([out, towards(d.T, cols, rows)])

    id_type = p.schema["id"].dataType.simpleString()
    keys = ["nth", "id", "c", "other"]
    parts = tile_apply(p, "id", fn, f"nth int,id {id_type},c int,other int,total double", block_rows, combine=_added(keys), vec="v")
    sums = parts.groupBy(*keys).agg(F.sum("total").alias("total"))
    each = F.explode(F.array(*[F.struct(F.lit(q).alias("nth"), F.col(c).alias("other")) for q, c in enumerate(names)]))
    sizes = p.select(each.alias("e")).select("e.*").groupBy("nth", "other").agg(F.count("*").alias("n"))
    means = sums.join(sizes, ["nth", "other"])
    own = F.col("c") == F.col("other")
    ab = means.groupBy("nth", "id", "c").agg(
        F.max(F.when(own & (F.col("n") > 1), F.col("total") / (F.col("n") - 1))).alias("a"),
        F.min(F.when(~own, F.col("total") / F.col("n"))).alias("b"),
    )
    s = F.when(F.greatest("a", "b") > 0, (F.col("b") - F.col("a")) / F.greatest("a", "b")).otherwise(F.lit(0.0))
    return ab.select("nth", "id", F.col("c").alias("cluster"), F.when(F.col("a").isNull(), F.lit(0.0)).otherwise(s).alias("silhouette"))


class PivotCells:
    """Training rows in Voronoi cells around pivots, and for each cell what bounds the distance to its rows.

    Pivots are training rows with the smallest hashes, one per ``block_rows`` rows and at most
    ``MAX_PIVOTS``. The driver holds them and, per cell, the least and largest distance to its pivot
    and the ``k`` smallest ones: ``MAX_PIVOTS`` * (dimensions + ``k`` + 2) numbers at most.
    """

    def __init__(self, train: DataFrame, row_id: str, vec: str, carry: Sequence[str], k: int, block_rows: int = BLOCK_ROWS) -> None:
        n = min(max(-(-train.count() // block_rows), 1), MAX_PIVOTS)
        drawn = hash_sample(train.select(row_id, vec), [row_id], F.lit(n)).select(vec).limit(n).collect()
        pivots = np.unique(np.array([r[0] for r in drawn], dtype=float), axis=0) if drawn else np.zeros((0, 0))
        self.pivots, self.k = pivots, k
        rows = train.select(F.col(row_id).alias("id"), F.col(vec).alias("v"), *carry)
        if not len(pivots):  # no training rows
            self.rows, self.size = rows.withColumns({"cell": F.lit(0), "r": F.lit(0.0)}), np.zeros(0)
            self.near, self.low, self.high = np.zeros((0, k)), np.zeros(0), np.zeros(0)
            return

        def deal(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                if len(pdf):
                    d = _exact(_matrix(pdf["v"]), pivots)
                    cell = d.argmin(1)
                    yield pdf.assign(cell=cell.astype("int32"), r=d[np.arange(len(pdf)), cell])

        shape = ",".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        self.rows = staged(rows.mapInPandas(deal, f"{shape},cell int,r double"), "pivot-cells")
        m = len(pivots)
        self.low, self.high, self.size = np.full(m, np.inf), np.full(m, -np.inf), np.zeros(m, np.int64)
        for c in self.rows.groupBy("cell").agg(F.min("r").alias("lo"), F.max("r").alias("hi"), F.count("*").alias("n")).collect():
            self.low[c.cell], self.high[c.cell], self.size[c.cell] = c.lo, c.hi, c.n
        # Spark limits the groups of this window before the shuffle, so a crowded cell sends k rows a task
        ranked = self.rows.select("cell", "r", F.row_number().over(W.partitionBy("cell").orderBy("r")).alias("i")).where(F.col("i") <= k)
        self.near = np.full((m, k), np.inf)
        for c in ranked.collect():
            self.near[c.cell, c.i - 1] = c.r

    def visits(self, test: DataFrame, row_id: str, vec: str) -> DataFrame:
        """Test rows (id, v) with ``cells``: those that can hold one of the row's k nearest rows, written.

        A training row at r from its pivot p is at most d(q, p) + r from q, so the k-th smallest such
        sum bounds the k-th neighbour. A cell is skipped if its ring around the pivot, or the plane
        between its pivot and the one nearest to q, is farther away than that.
        """
        pivots, near, low, high, k = self.pivots, self.near, self.low, self.high, self.k
        rows = test.select(F.col(row_id).alias("id"), F.col(vec).alias("v"))
        shape = ",".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        apart = _exact(pivots, pivots) if len(pivots) else np.zeros((0, 0))
        step = max(1, 4_000_000 // max(near.size, 1))  # rows whose bounds are held at a time

        def choose(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for whole in parts:
                for first in range(0, len(whole), step):
                    pdf = whole.iloc[first : first + step]
                    d = _exact(_matrix(pdf["v"]), pivots)
                    sums = (d[:, :, None] + near[None]).reshape(len(pdf), -1)
                    bound = np.partition(sums, k - 1, axis=1)[:, k - 1]
                    own = d.argmin(1)
                    least = d[np.arange(len(pdf)), own]
                    gap = apart[own]
                    plane = np.divide(d * d - (least * least)[:, None], 2 * gap, out=np.zeros_like(d), where=gap > 0)
                    floor = np.maximum(np.maximum(d - high, low - d), plane)
                    # rounding may not lose a cell: the margin is far above the error of a distance
                    margin = 1e-9 * (np.where(np.isfinite(bound), bound, 0.0)[:, None] + d)
                    seen = (floor - margin <= bound[:, None]) & np.isfinite(high)[None]
                    yield pdf.assign(cells=[np.flatnonzero(x).astype("int32") for x in seen])

        if not len(pivots):
            return rows.withColumn("cells", F.array().cast("array<int>"))
        return staged(rows.mapInPandas(choose, f"{shape},cells array<int>"), "pivot-visits")

    def parts(self, block_rows: int) -> tuple[np.ndarray, np.ndarray]:
        """First part of each cell, and the number of parts it is cut into.

        A part holds neighbouring cells of ``SIDE_ROWS`` rows together, or of a ``SPREAD``-th of all rows if
        that is less, but at least ``block_rows``; a cell of more rows is cut into parts of its own.
        """
        limit = max(min(SIDE_ROWS, -(-int(self.size.sum()) // SPREAD)), block_rows)
        pieces = np.maximum(-(-self.size // limit), 1).astype(int)
        first, part, filled, left = np.zeros(len(pieces), int), 0, 0, set(range(len(pieces)))
        now = 0
        while left:  # from each cell to the nearest one that has no part yet
            left.remove(now)
            if filled and (pieces[now] > 1 or filled + self.size[now] > limit):
                part, filled = part + 1, 0
            first[now], filled = part, filled + self.size[now]
            if pieces[now] > 1:
                part, filled = part + pieces[now], 0
            if left:
                rest = np.array(sorted(left))
                now = int(rest[_exact(self.pivots[rest], self.pivots[now][None])[:, 0].argmin()])
        return first, pieces


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances from the differences themselves: equal pairs give equal bits in every task."""
    out = np.empty((len(a), len(b)))
    for j, x in enumerate(b):
        diff = a - x
        out[:, j] = np.sqrt((diff * diff).sum(1))
    return out


def nearest_rows(
    train: DataFrame, test: DataFrame, row_id: str, vec: str, k: int, carry: Sequence[str] = (), block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(id, rank, near, distance, carried columns of the training row): the exact ``k`` nearest training
    rows of every test row, Euclidean, ties by smaller id; fewer if there are fewer, none without training rows.

    A metric join over pivot cells (see ``PivotCells``): a test row is compared with the cells it can't rule
    out. Cells travel in parts of up to ``SIDE_ROWS`` rows, so a test row is sent once per part that has one of
    its cells, not once per cell; a crowded cell is cut by hash into parts of its own, and visitors of a part into
    tiles. A tile hands on the best ``k`` of each of its test rows.
    """
    carry = list(carry)
    cells = PivotCells(train, row_id, vec, carry, k, block_rows)
    visits = cells.visits(test, row_id, vec)
    first, pieces = cells.parts(block_rows)

    def sent(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Row, part and visited cells of the part, once per row and part."""
        n = np.array([len(c) for c in pdf["cells"]], dtype=int)
        row, cell = np.repeat(np.arange(len(pdf)), n), np.concatenate([np.zeros(0, int), *pdf["cells"]]).astype(int)
        m = pieces[cell]
        row, cell, part = np.repeat(row, m), np.repeat(cell, m), np.repeat(first[cell], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        order = np.lexsort((cell, part, row))
        row, cell, part = row[order], cell[order].astype("int32"), part[order]
        start = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (part[1:] != part[:-1])])[: len(row)])
        return row[start], part[start], np.split(cell, start[1:]) if len(start) else []

    def visited(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"part": sent(pdf)[1].astype("int32")})

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            row, part, some = sent(pdf)
            out = pdf[["id", "v"]].iloc[row]
            yield out.assign(part=part.astype("int32"), cells=pd.Series(some, index=out.index, dtype=object))

    # one row per part; a few tiles at least for the tasks
    counts = visits.select("cells").mapInPandas(visited, "part int").groupBy("part").agg(F.count("*").alias("n"))
    tiles = counts.select("part", F.greatest(
        F.ceil(F.col("n") / SIDE_ROWS), F.least(F.ceil(F.col("n") / block_rows), F.lit(SPREAD // 4))).cast("int").alias("_ti"))
    homes = train.sparkSession.createDataFrame(
        [(c, int(p), int(m)) for c, (p, m) in enumerate(zip(first, pieces, strict=True))], "cell int, _p int, _m int")
    own = hash_number(stable_hash("id"))
    kinds = {f.name: f.dataType for f in cells.rows.schema}
    types = {f.name: f.dataType.simpleString() for f in visits.schema}
    each = visits.mapInPandas(send, f"id {types['id']},v {types['v']},part int,cells array<int>")
    a = each.join(F.broadcast(tiles), "part").select(
        "id", "v", *[F.lit(None).cast(kinds[c]).alias(c) for c in carry], F.lit(0).alias("side"), "part",
        (own % F.col("_ti")).cast("int").alias("ti"), "cells", F.lit(None).cast("int").alias("cell"))
    b = cells.rows.join(F.broadcast(homes), "cell").withColumn("part", (F.col("_p") + own % F.col("_m")).cast("int"))
    b = b.join(F.broadcast(tiles), "part").select(
        "id", "v", *carry, F.lit(1).alias("side"), "part", F.explode(F.sequence(F.lit(0), F.col("_ti") - 1)).alias("ti"),
        F.lit(None).cast("array<int>").alias("cells"), "cell")

    def best_of(i: np.ndarray, j: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The ``k`` nearest columns of each row, ties in order of the columns, and their places."""
        order = np.lexsort((j, exact, i))
        i, j, exact = i[order], j[order], exact[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        keep = place < k
        return i[keep], j[keep], exact[keep], place[keep]

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, cols = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1].sort_values("id")
        out = {"id": rows["id"].iloc[:0], "distance": [], "near": cols["id"].iloc[:0], **{c: cols[c].iloc[:0] for c in carry}}
        if len(rows) == 0 or len(cols) == 0:
            return pd.DataFrame(out)
        x, y = _matrix(rows["v"]), _matrix(cols["v"])
        long, far = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1)).max()
        who, cell = np.repeat(np.arange(len(rows)), [len(c) for c in rows["cells"]]), np.concatenate(list(rows["cells"]))
        order = np.argsort(cell, kind="stable")
        who, cell = who[order], cell[order]
        of = cols["cell"].to_numpy().astype(int)
        limit = np.full(len(rows), np.inf)  # of the k nearest so far
        best = (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for c in np.unique(of):
            visitors, there = who[slice(*np.searchsorted(cell, [c, c + 1]))], np.flatnonzero(of == c)
            for at in range(0, len(visitors), BLOCK_ROWS):
                mine = visitors[at : at + BLOCK_ROWS]
                for to in range(0, len(there), BLOCK_ROWS):
                    theirs = there[to : to + BLOCK_ROWS]
                    d = _euclidean(x[mine], y[theirs])
                    width = min(k, len(theirs))
                    last = np.minimum(np.partition(d, width - 1, axis=1)[:, width - 1], limit[mine])
                    # everything within rounding of the k-th goes on and is measured by its difference
                    i, j = np.nonzero(d <= (last + 1e-9 * (long[mine] + far))[:, None])
                    diff = x[mine[i]] - y[theirs[j]]
                    held.append((mine[i], theirs[j], np.sqrt((diff * diff).sum(1))))
            if sum(len(h[0]) for h in held) > 4 * k * len(rows):
                *best, place = best_of(*[np.concatenate(z) for z in zip(best, *held, strict=True)])
                limit[best[0][place == k - 1]] = best[2][place == k - 1]
                held = []
        i, j, exact, _ = best_of(*[np.concatenate(z) for z in zip(best, *held, strict=True)])
        return pd.DataFrame({"id": rows["id"].to_numpy()[i], "distance": exact, "near": cols["id"].to_numpy()[j],
                             **{c: cols[c].to_numpy()[j] for c in carry}})

    schema = f"id {types['id']},distance double,near {kinds['id'].simpleString()}"
    schema += "".join(f",`{c}` {kinds[c].simpleString()}" for c in carry)
    found = a.unionByName(b).groupBy("part", "ti").applyInPandas(fn, schema)
    best = W.partitionBy("id").orderBy("distance", "near")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("id", "rank", "near", "distance", *carry)


def nearest_labels(
    train: DataFrame, test: DataFrame, row_id: str, vec: str, label: str, k: int, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(id, proba): share of positive labels among the k nearest training rows (ties: smaller id)."""
    labelled = train.select(row_id, vec, F.col(label).cast("double").alias("y"))
    return nearest_rows(labelled, test, row_id, vec, k, ["y"], block_rows).groupBy("id").agg(F.avg("y").alias("proba"))
