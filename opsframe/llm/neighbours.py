"""Near-duplicate vectors over a robust-pruned flat graph.

Distinct vectors are dealt to overlapping cluster shards; each shard builds the adjacency of its members (near
candidates thinned by robust pruning, as in Vamana / DiskANN).  The lists of a vector from its shards are united.  Every
vector is then searched from the shard's medoid: greedy search to where it lies, then range expansion through the
neighbours that are near enough for as long as new ones turn up.  Every tile's pairs are audited against its exact
cosines and verified in double precision; ``audit`` measures recall over the whole table, pairs without a common tile included.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsframe.llm.common import components, keep, local_components, small_side

COSINE = 0.95
#: Vectors per shard aimed at, shards each vector is in, and the most a shard may hold before it is dealt as pairs of slices.
SHARD, OVERLAP, LARGEST = 1500, 2, 4000
#: Vectors that the cluster centres are fitted on: at most this many per centre, and centres at most.
SAMPLE_PER_CENTRE, CENTRES = 24, 2000
#: Neighbours kept per vector, candidates thinned, pruning slack, beam of the greedy search.
DEGREE, CANDIDATES, SLACK, BEAM = 20, 48, 1.2, 16


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column]) if len(column) else np.zeros((0, 1))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # first, so that no square overflows or vanishes
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def clusters(sample: np.ndarray, count: int, rounds: int = 8, seed: int = 9) -> np.ndarray:
    """Unit centres by spherical k-means over a bounded sample."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(count, len(sample)), replace=False)]
    for _ in range(rounds):
        near = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-300), centres)
    return centres


def prune(near: np.ndarray, cosines: np.ndarray, degree: int, slack: float) -> np.ndarray:
    """Robust pruning of all rows at once: take the nearest candidate left, drop those it covers, until ``degree``.

    near: candidates of each row by falling cosine; a row's list is filled up with -1.
    """
    n = len(near)
    rows = np.arange(n)[:, None]
    distance = np.sqrt(np.maximum(0, 2 - 2 * cosines[rows, near]))
    left = near != rows
    out = np.full((n, degree), -1)
    for k in range(degree):
        first = left.argmax(axis=1)
        any_left = left[np.arange(n), first]
        if not any_left.any():
            break
        pick = near[np.arange(n), first]
        out[:, k] = np.where(any_left, pick, -1)
        covered = slack * np.sqrt(np.maximum(0, 2 - 2 * cosines[pick[:, None], near])) <= distance
        left &= ~covered
        left[np.arange(n), first] = False
    return out


def adjacency(x: np.ndarray) -> np.ndarray:
    """Pruned neighbour lists of a shard's unit vectors, with the reverse links as far as there is room."""
    n = len(x)
    cosines = x @ x.T
    near = np.argsort(-cosines, axis=1, kind="stable")[:, :min(n, CANDIDATES)]
    far = np.random.default_rng(n).integers(0, n, (n, min(n, 8)))  # a few long links keep the graph in one piece
    candidates = np.concatenate([near, far], axis=1)
    order = np.argsort(-np.take_along_axis(cosines, candidates, axis=1), axis=1, kind="stable")
    out = prune(np.take_along_axis(candidates, order, axis=1), cosines, DEGREE, SLACK)
    back = np.full((n, DEGREE), -1)
    source = np.repeat(np.arange(n), DEGREE)[out.ravel() >= 0]
    target = out.ravel()[out.ravel() >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    place = np.arange(len(target)) - np.searchsorted(target, target)
    fits = place < DEGREE
    back[target[fits], place[fits]] = source[fits]
    return np.concatenate([out, back], axis=1)


def range_search(x: np.ndarray, links: np.ndarray, least: float, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of cosine at least ``least`` that a search of the graph finds for every vector i.

    All vectors of the shard search at once.  Greedy: from the medoid, visit the best unvisited of the beam until all of
    it is visited.  Range: then visit whoever is near enough and unvisited, again and again, until nobody is.
    """
    n = len(x)
    cosines = x @ x.T
    medoid = int((x @ x.mean(axis=0)).argmax())
    seen = np.zeros((n, n), bool)  # rows: queries; a shard is bounded, so is this
    visited = np.zeros((n, n), bool)
    seen[:, medoid] = True
    pool = np.full((n, beam), -1)
    pool[:, 0] = medoid
    active = np.arange(n)
    while len(active):
        beams = pool[active]
        worth = np.where((beams >= 0) & ~visited[active[:, None], beams], cosines[active[:, None], beams], -9.0)
        best = worth.argmax(axis=1)
        going = worth[np.arange(len(active)), best] > -9
        active, beams, best = active[going], beams[going], best[going]
        if not len(active):
            break
        node = beams[np.arange(len(active)), best]
        visited[active, node] = True
        next_to = links[node]
        seen[active[:, None], np.where(next_to >= 0, next_to, node[:, None])] = True
        both = np.concatenate([beams, next_to], axis=1)
        order = np.sort(both, axis=1)  # drop doubles
        order[:, 1:][order[:, 1:] == order[:, :-1]] = -1
        value = np.where(order >= 0, cosines[active[:, None], order], -9.0)
        top = np.argpartition(-value, min(beam, value.shape[1]) - 1, axis=1)[:, :beam]
        pool[active] = np.where(np.take_along_axis(value, top, axis=1) > -9, np.take_along_axis(order, top, axis=1), -1)
    inside = cosines >= least - 1e-9
    while True:
        query, node = np.nonzero(seen & inside & ~visited)
        if not len(query):
            break
        visited[query, node] = True
        for column in links.T:
            ends = column[node]
            some = ends >= 0
            seen[query[some], ends[some]] = True
    return np.nonzero(seen & inside)


def tile_pairs(x: np.ndarray, links: np.ndarray, least: float, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """All pairs a < b of cosine at least ``least``: those the graph search finds, audited against the exact cosines.

    A tile is bounded, so every member is audited, in blocks.  Where the search falls short, as in groups of near copies
    that hang on few links, the tile's exact pairs stand in.
    """
    n = len(x)
    a, b = range_search(x, links, least)
    found = np.unique(np.minimum(a, b)[a != b].astype(np.int64) * n + np.maximum(a, b)[a != b])  # found from either side
    exact = []
    for at in range(0, n, block):
        i, j = np.nonzero(x[at:at + block] @ x.T >= least - 1e-9)
        i += at
        exact.append(i[i < j].astype(np.int64) * n + j[i < j])
    both = np.union1d(found, np.concatenate(exact)) if exact else found
    a, b = both // n, both % n
    true = np.empty(len(a), bool)
    for at in range(0, len(a), 100_000):  # verified one by one in double precision
        part = slice(at, at + 100_000)
        true[part] = np.einsum("ij,ij->i", x[a[part]], x[b[part]]) >= least
    return a[true], b[true]


def _shard_rows(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = rows.sort_values("node")
    return rows, unit(_matrix(rows["vector"]))


def _assign(vectors: DataFrame, centres: np.ndarray, overlap: int) -> DataFrame:
    """node, vector, shards: the nearest clusters of each vector."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unit(_matrix(batch.column(1).to_pylist()))
            near = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :overlap]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near.tolist(), pa.list_(pa.int32()))],
                                             names=["node", "vector", "shards"])

    return vectors.select("node", "vector").mapInArrow(work, "node long, vector array<float>, shards array<int>")


def _tiles(assigned: DataFrame, largest: int) -> DataFrame:
    """tile, node, vector, tiles: a shard is a tile, one that is too large becomes a tile per two of its slices.

    ``tiles`` are all tiles of the vector: a pair is counted in the first tile that both are in.
    """
    each = assigned.select("node", F.explode("shards").alias("shard"))
    large = each.groupBy("shard").agg(F.count("*").alias("n")).select(
        "shard", F.greatest(F.lit(1), F.ceil(F.col("n") * 2.0 / largest)).cast("int").alias("slices"), "n")
    large = keep(large.withColumn("slices", F.when(F.col("n") <= largest, 1).otherwise(F.col("slices"))).drop("n"), "slices")
    own = F.pmod(F.xxhash64("node"), F.col("slices")).cast("int")
    cut = each.join(large, "shard").withColumn("tiles", F.transform(
        F.sequence(F.lit(0), F.col("slices") - 1), lambda j: F.xxhash64("shard", F.least(own, j), F.greatest(own, j))))
    tiles = cut.groupBy("node").agg(F.array_sort(F.flatten(F.collect_list("tiles"))).alias("tiles"))
    return assigned.select("node", "vector").join(tiles, "node").withColumn("tile", F.explode("tiles"))


def near_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = COSINE,
                 shard: int = SHARD, overlap: int = OVERLAP, largest: int = LARGEST) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Links are pairs found with cosine of at least ``least``.  Vectors that are equal are one node of the graph, counted
    as often as they occur, so copies make no pairs.  Vectors that are null, zero, or hold null or non-finite components
    link with nothing, nor do those of another length than most have.  A null id keeps its row: its component_id is its
    component's smallest id (null if there is none), and it is not kept unless that is null too.  Repeated rows count as vectors of their own; an empty table
    gives no rows; other columns are ignored.
    """
    vector = F.col(vector_col).cast("array<float>")
    wide = F.col(vector_col).cast("array<double>")
    usable = F.coalesce(F.forall(wide, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(3.5e38))) & F.exists(wide, lambda v: v != 0), F.lit(False))
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector"), usable.alias("usable"))
    lengths = rows.where("usable").groupBy(F.size("vector").alias("length")).agg(F.count("*").alias("n"))
    usual = lengths.orderBy(F.desc("n"), "length").first()
    usual = usual["length"] if usual else 0
    rows = rows.withColumn("usable", F.col("usable") & (F.size("vector") == usual))
    rows = keep(rows.withColumn("key", F.when(F.col("usable"), F.sha2(F.array_join(F.transform("vector", lambda v: (v + F.lit(0.0)).cast("string")), ","), 256))), "vectors")
    groups = rows.where("usable").groupBy("key").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"))
    groups = keep(groups.withColumn("node", F.xxhash64("key")), "nodes")
    one = rows.where("usable").select("key", "vector").dropDuplicates(["key"])
    nodes = keep(one.join(groups.select("key", "node", "copies"), "key").select("node", "vector", "copies"), "distinct")
    count = nodes.count()

    size = max(1, min(CENTRES, -(-count // shard)))
    sample = nodes.orderBy(F.xxhash64(F.lit("sample"), "node")).limit(size * SAMPLE_PER_CENTRE).select("vector").toPandas()
    centres = clusters(unit(_matrix(sample["vector"])), size) if count else np.zeros((1, max(usual, 1)))
    tiles = keep(_tiles(_assign(nodes, centres, min(overlap, size)), largest).join(nodes.select("node", "copies"), "node"), "tiles")

    def build(members: pd.DataFrame) -> pd.DataFrame:
        members, x = _shard_rows(members)
        ids = members["node"].to_numpy()
        links = adjacency(x)
        return pd.DataFrame({"node": ids, "links": [ids[r[r >= 0]] for r in links]})

    graph = tiles.select("tile", "node", "vector").groupBy("tile").applyInPandas(build, "node long, links array<long>")
    union = keep(graph.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("links"))).alias("links")), "graph")

    def search(members: pd.DataFrame) -> pd.DataFrame:
        members, x = _shard_rows(members)
        ids = members["node"].to_numpy()
        n, tile = len(ids), int(members["tile"].iloc[0])
        lists = [np.searchsorted(ids, np.asarray(r)) * 1 for r in members["links"]]
        lists = [at[(at < n) & (ids[np.minimum(at, n - 1)] == np.asarray(r))] for at, r in zip(lists, members["links"])]
        links = np.full((n, max(1, max(map(len, lists)))), -1)
        for i, at in enumerate(lists):
            links[i, :len(at)] = at
        a, b = tile_pairs(x, links, least)
        label = local_components(n, a, b)
        shared = members["tiles"].to_list()
        first = np.array([t[0] for t in shared]) == tile
        mine = first[a] & first[b]
        for i in np.flatnonzero(~mine):  # the pair counts where it is first together
            common = set(shared[a[i]]) & set(shared[b[i]])
            mine[i] = min(common) == tile
        copies = members["copies"].to_numpy()
        found = np.zeros(n, np.int64)
        np.add.at(found, a[mine], copies[b[mine]])
        np.add.at(found, b[mine], copies[a[mine]])
        return pd.DataFrame({"node": ids, "found": found, "root": ids[label]})

    found = keep(tiles.join(union, "node").groupBy("tile").applyInPandas(search, "node long, found long, root long"), "found")
    counts = found.groupBy("node").agg(F.sum("found").alias("found"))
    joined = components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")), "vectors")
    named = groups.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lows = named.groupBy("component").agg(F.min("low").alias("component_id"))
    named = named.join(lows, "component").join(counts, "node").select("key", "component_id", (F.col("found") + F.col("copies") - 1).alias("n_links"))
    out = rows.join(named, "key", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("usable"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def audit(found: DataFrame, table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = COSINE,
          every: int = 100, most: int = 2000) -> tuple[int, int]:
    """Links found, and links there are, of rows whose id is divisible by ``every`` (``most`` of least hash) to the whole table.

    found: the result of ``near_vectors`` over the table.  The sampled vectors go to the tasks, which compare them with all rows.
    """
    wide = F.col(vector_col).cast("array<float>").cast("array<double>")
    usable = F.coalesce(F.forall(wide, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(3.5e38))) & F.exists(wide, lambda v: v != 0), F.lit(False))
    rows = table.where(usable).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>").alias("vector"))
    some = rows.where(F.col("vec_id") % every == 0).orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).toPandas()
    if not len(some):
        return 0, 0
    lengths = np.array([len(v) for v in some["vector"]])
    some = some[lengths == np.bincount(lengths).argmax()]
    width, sample = len(some["vector"].iloc[0]), unit(_matrix(some["vector"]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            vectors = [v for v in batch.column(0).to_pylist() if len(v) == width]
            if vectors:
                total += int((unit(_matrix(vectors)) @ sample.T >= least).sum())
        yield pa.RecordBatch.from_arrays([pa.array([total])], names=["n"])

    near = rows.select("vector").mapInArrow(count, "n long").agg(F.sum("n")).first()[0] or 0
    ids = found.sparkSession.createDataFrame([(int(i),) for i in some["vec_id"].unique()], "vec_id long")
    got = found.join(ids, "vec_id").agg(F.sum("n_links")).first()[0] or 0
    return got, near - len(some)
