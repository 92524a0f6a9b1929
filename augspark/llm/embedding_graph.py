"""Embedding near-duplicates: a hierarchical navigable small-world graph per shard, asked by all vectors.

Equal vectors are one node of the search. Shards hold a bounded number of distinct vectors, and every
block of vectors asks every shard. A beam search that is filled with near vectors, or that misses
partners of an audited sample, is repeated with a wider beam and in the end by comparing all vectors of
the shard. Cosines are verified in double precision; links become components.

All steps of search and construction work on whole arrays of queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType

from augspark.llm.components import connected_components, forest
from augspark.llm.runs import join_parts, split_parts
from augspark.session import cut_lineage, scratch_path

THRESHOLD = 0.95
# Distinct vectors of a shard, and of a block of queries at least
SHARD, BLOCK = 65_536, 4096
LINKS, LINKS_BASE = 16, 32
BEAM_BUILD, BEAM, MAX_BEAM = 48, 32, 512
# Nodes that enter a graph together, at most
BATCH = 4096
# Queries that search together
CHUNK = 256
# Queries of a block whose partners are also found by comparison, and the share that the beam must find
AUDIT, AUDIT_RECALL = 32, 0.99
# Cosines of single precision are trusted up to this
MARGIN = 1e-4


@dataclass
class Graph:
    """units: the vectors, scaled to length 1. links[l]: neighbours at level l, -1 where there is none; nodes are numbered by level."""

    units: np.ndarray
    levels: np.ndarray
    links: list[np.ndarray] = field(default_factory=list)
    entry: int = -1
    seen: np.ndarray | None = None

    def similar(self, nodes: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """Cosines of (queries, candidates) node numbers; -2 for no node."""
        found = np.matmul(self.units[np.maximum(nodes, 0)], queries[:, :, None])[:, :, 0]
        return np.where(nodes >= 0, found, np.float32(-2))

    def descend(self, queries: np.ndarray, to_level: int) -> np.ndarray:
        """The node each query reaches by greedy steps above ``to_level``."""
        at = np.full(len(queries), self.entry)
        best = queries @ self.units[self.entry]
        for level in range(len(self.links) - 1, to_level, -1):
            moving = np.arange(len(queries))
            while len(moving):
                near = self.links[level][at[moving]]
                sims = self.similar(near, queries[moving])
                top = sims.argmax(1)
                value = sims[np.arange(len(moving)), top]
                better = value > best[moving]
                moving, near, top, value = moving[better], near[better], top[better], value[better]
                at[moving], best[moving] = near[np.arange(len(moving)), top], value
        return at

    def together(self, queries: np.ndarray) -> np.ndarray:
        """An order in which queries that search the same part of the graph stand together, so that its vectors stay in the cache."""
        return np.argsort(self.descend(queries, 1), kind="stable")

    def beam(self, queries: np.ndarray, start: np.ndarray, width: int, level: int = 0, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """The nodes and cosines of a beam search, best first; -1 and -2 fill up short beams."""
        q = len(queries)
        seen = self._unseen(q)
        touched = [np.arange(q) * len(self.units) + start]
        ids = np.full((q, width), -1)
        sims = np.full((q, width), -2, np.float32)
        done = np.ones((q, width), bool)
        ids[:, 0], done[:, 0] = start, False
        sims[:, 0] = np.einsum("qd,qd->q", self.units[start], queries)
        seen[np.arange(q), start] = True
        live = np.arange(q)
        while len(live):
            open_ = np.where(done[live], -3, sims[live])
            pick = np.argpartition(-open_, min(step, width - 1), axis=1)[:, :step]
            real = np.take_along_axis(open_, pick, 1) > -2
            active = real.any(1)
            live, pick, real = live[active], pick[active], real[active]
            if not len(live):
                break
            done[live[:, None], pick] = True
            chosen = np.where(real, ids[live[:, None], pick], -1)
            near = np.where(chosen[:, :, None] >= 0, self.links[level][np.maximum(chosen, 0)], -1).reshape(len(live), -1)
            fresh = (near >= 0) & ~seen[live[:, None], np.maximum(near, 0)]
            near = np.where(fresh, near, -1)  # and of a node that two picked nodes share, one place stays
            near.sort(1)
            near[:, 1:] = np.where(near[:, 1:] == near[:, :-1], -1, near[:, 1:])
            width_near = int((near >= 0).sum(1).max(initial=0))
            if width_near == 0:
                continue
            near = -np.sort(-near, axis=1)[:, :width_near]
            ok = near >= 0
            at = (live[:, None] * len(self.units) + near)[ok]
            seen.ravel()[at] = True
            touched.append(at)
            all_ids = np.concatenate([ids[live], near], 1)
            all_sims = np.concatenate([sims[live], self.similar(near, queries[live])], 1)
            all_done = np.concatenate([done[live], ~ok], 1)
            best = np.argsort(-all_sims, axis=1, kind="stable")[:, :width]
            ids[live] = np.take_along_axis(all_ids, best, 1)
            sims[live] = np.take_along_axis(all_sims, best, 1)
            done[live] = np.take_along_axis(all_done, best, 1) | (ids[live] < 0)
        seen.ravel()[np.concatenate(touched)] = False
        return ids, sims

    def _unseen(self, queries: int) -> np.ndarray:
        """A truth value per query and node, all false; kept between searches, which clear what they have set."""
        if self.seen is None or len(self.seen) < queries:
            self.seen = np.zeros((queries, len(self.units)), bool)
        return self.seen

    def pick_links(self, of: np.ndarray, candidates: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Up to ``most`` neighbours from candidates sorted by cosine: near ones that are not nearer to a chosen one."""
        n, c = candidates.shape
        vectors = self.units[np.maximum(candidates, 0)]
        among = np.matmul(vectors, vectors.swapaxes(1, 2))
        chosen = np.zeros((n, c), bool)
        for i in range(c):
            covered = (chosen & (among[:, i] >= sims[:, i : i + 1])).any(1)
            chosen[:, i] = (candidates[:, i] >= 0) & ~covered & (chosen.sum(1) < most)
        # the rest of the room goes to the nearest that were passed over
        order = np.argsort(np.where(chosen, 0, np.where(candidates >= 0, 1, 2)) * c + np.arange(c), axis=1)[:, :most]
        picked = np.take_along_axis(candidates, order, 1)
        if picked.shape[1] < most:
            picked = np.pad(picked, ((0, 0), (0, most - picked.shape[1])), constant_values=-1)
        return picked


def build_graph(vectors: np.ndarray, seed: int = 3) -> Graph:
    """A graph over the rows, inserted in batches that also see each other."""
    units = unit(vectors)
    n = len(units)
    rng = np.random.default_rng(seed)
    levels = np.minimum((-np.log(1 - rng.random(n)) / np.log(LINKS)).astype(int), 5)
    if n:
        levels[0] = levels.max()
    g = Graph(units, levels)
    g.links = [np.full((n, LINKS_BASE if level == 0 else LINKS), -1, np.int32) for level in range(int(levels.max(initial=0)) + 1)]
    g.entry = 0
    at = 1
    while at < n:
        batch = np.arange(at, min(n, at + min(max(64, at // 2), BATCH)))
        at = int(batch[-1]) + 1
        batch = batch[g.together(units[batch])]
        for level in range(len(g.links) - 1, -1, -1):
            mine = batch[levels[batch] >= level]
            if not len(mine):
                continue
            for a in range(0, len(mine), CHUNK):
                part = mine[a : a + CHUNK]
                ids, sims = g.beam(units[part], g.descend(units[part], level), BEAM_BUILD, level)
                inner = units[part] @ units[mine].T
                inner[np.arange(len(part)), a + np.arange(len(part))] = -2
                k = min(16, len(mine))
                top = np.argpartition(-inner, k - 1, axis=1)[:, :k]
                ids = np.concatenate([ids, mine[top]], 1)
                sims = np.concatenate([sims, np.take_along_axis(inner, top, 1)], 1)
                ids = np.where(ids == part[:, None], -1, ids)
                sims = np.where(ids >= 0, sims, -2)
                order = np.argsort(-sims, axis=1, kind="stable")[:, :BEAM_BUILD]
                ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
                # half of the room of the lowest level is left for those that come later
                g.links[level][part, :LINKS] = g.pick_links(part, ids, sims, LINKS)
            _link_back(g, level, mine)
    return g


def _link_back(g: Graph, level: int, new: np.ndarray) -> None:
    """Enters new nodes in the lists of their neighbours; a list that they do not fit in is picked anew."""
    links = g.links[level]
    most = links.shape[1]
    to = links[new, :LINKS].ravel()
    source = np.repeat(new, LINKS)
    ok = to >= 0
    to, source = to[ok], source[ok]
    sims = np.einsum("nd,nd->n", g.units[to], g.units[source])
    order = np.lexsort((-sims, to))
    to, source = to[order], source[order]
    target, first, count = np.unique(to, return_index=True, return_counts=True)
    rank = np.arange(len(to)) - np.repeat(first, count)
    near = rank < most
    incoming = np.full((len(target), most), -1, np.int64)
    incoming[np.repeat(np.arange(len(target)), count)[near], rank[near]] = source[near]
    for a in range(0, len(target), 512):
        part, more = target[a : a + 512], incoming[a : a + 512]
        both = np.concatenate([links[part].astype(np.int64), more], 1)
        both.sort(1)
        both[:, 1:] = np.where(both[:, 1:] == both[:, :-1], -1, both[:, 1:])
        fits = (both >= 0).sum(1) <= most
        links[part[fits]] = -np.sort(-both[fits], axis=1)[:, :most]
        part, both = part[~fits], both[~fits]
        if not len(part):
            continue
        sims = g.similar(both, g.units[part])
        order = np.argsort(-sims, axis=1, kind="stable")
        both, sims = np.take_along_axis(both, order, 1), np.take_along_axis(sims, order, 1)
        wide = int((both >= 0).sum(1).max())
        links[part] = g.pick_links(part, both[:, :wide], sims[:, :wide], most)


def unit(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.float64)
    return (wide / np.sqrt((wide * wide).sum(1))[:, None]).astype(np.float32) if len(wide) else wide.astype(np.float32)


def near_vectors(g: Graph, queries: np.ndarray, threshold: float, rng: np.random.Generator) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, node) pairs whose single-precision cosine may reach the threshold, in blocks."""
    units = unit(queries)
    least = threshold - MARGIN
    left, width = np.arange(len(units)), BEAM
    audit = np.sort(rng.choice(len(units), min(AUDIT, len(units)), replace=False))
    truth = units[audit] @ g.units.T >= least
    left = left[g.together(units)]
    while len(left) and width <= min(MAX_BEAM, len(g.units) // 4):
        found = []
        for a in range(0, len(left), CHUNK):
            part = left[a : a + CHUNK]
            found.append(g.beam(units[part], g.descend(units[part], 0), width))
        ids, sims = (np.concatenate(x) for x in zip(*found, strict=True))
        full = sims[:, -1] >= least  # a beam full of near vectors may have missed more
        checked = np.isin(left, audit) & ~full
        hits = int((sims[checked] >= least).sum())
        wanted = int(truth[np.searchsorted(audit, left[checked])].sum())
        if hits < AUDIT_RECALL * wanted:
            width *= 2
            continue
        i, j = np.nonzero((sims >= least) & ~full[:, None])
        yield left[i], ids[i, j]
        left, width = left[full], width * 4
    for a in range(0, len(left), 256):  # beams as wide as this cost more than all comparisons
        i, j = np.nonzero(units[left[a : a + 256]] @ g.units.T >= least)
        yield left[a : a + 256][i], j


def _pack_graph(g: Graph) -> bytes:
    return join_parts([g.levels.astype("<i4").tobytes(), *[x.astype("<i4").tobytes() for x in g.links]])


def _load_graph(data: bytes, vectors: np.ndarray) -> Graph:
    levels, *links = split_parts(data)
    n = len(vectors)
    return Graph(unit(vectors), np.frombuffer(levels, "<i4"), [np.frombuffer(x, "<i4").reshape(n, -1) for x in links], 0 if n else -1)


def _matrix(column: pa.ChunkedArray, dim: int, dtype) -> np.ndarray:
    values = [np.asarray(c.flatten(), dtype) for c in column.chunks]
    return np.concatenate([np.zeros(0, dtype), *values]).reshape(-1, dim)


def near_vector_groups(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """Per row: key, n_links (other rows linked directly), component_id (smallest key reachable), kept.

    Rows link at a cosine of ``threshold`` or more, in double precision. Vectors that are null, zero or
    hold null or non-finite components link with nothing; neither do vectors of different lengths. Equal
    vectors are linked without a search. Rows with equal keys count as rows. An empty table gives an empty
    result. Links are found by the graphs and may miss some; what is reported is a link.
    """
    spark = vectors.sparkSession
    wide = isinstance(vectors.schema[embedding].dataType.elementType, DoubleType)
    kind, dtype = ("double", np.float64) if wide else ("float", np.float32)
    e = F.col(embedding)
    good = e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = vectors.select(F.col(key).alias("key"), e.cast(f"array<{kind}>").alias("vector"), F.coalesce(good, F.lit(False)).alias("good"))
    classes = cut_lineage(
        rows.where("good").groupBy("vector").agg(F.min("key").alias("least"), F.count("*").alias("n")).withColumn("class", F.monotonically_increasing_id()).withColumn("dim", F.size("vector"))
    )
    sizes = {r["dim"]: r["count"] for r in classes.groupBy("dim").count().collect()}  # one row per vector length
    shards = {d: -(-n // shard) for d, n in sizes.items()}
    # every block of queries gets a copy of every graph: as few blocks as keep all cores busy, or as hold ``shard`` vectors
    tasks = 2 * spark.sparkContext.defaultParallelism
    blocks = {d: max(-(-n // shard), min(-(-n // block), -(-tasks // shards[d]))) for d, n in sizes.items()}
    by_dim = lambda numbers: F.coalesce(*[F.when(F.col("dim") == d, F.lit(n)) for d, n in numbers.items()], F.lit(1))
    dealt = classes.select(
        "class", "n", "vector", "dim", F.pmod(F.xxhash64("class"), by_dim(shards)).cast("int").alias("shard"), F.pmod(F.xxhash64("class", F.lit(1)), by_dim(blocks)).cast("int").alias("block")
    )

    def build(at: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("class")
        matrix = _matrix(table.column("vector"), at[0].as_py(), dtype)
        numbers = np.stack([np.array(table.column(c).to_pylist(), "<i8") for c in ("class", "n")])
        values = {"dim": at[0].as_py(), "shard": at[1].as_py(), "numbers": numbers.tobytes(), "vectors": matrix.tobytes(), "graph": _pack_graph(build_graph(matrix))}
        return pa.table({k: pa.array([v], pa.int32() if isinstance(v, int) else pa.binary()) for k, v in values.items()})

    path = scratch_path(spark, "vector-graphs")
    built = dealt.groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, numbers binary, vectors binary, graph binary")
    built.write.parquet(path)
    graphs = spark.read.schema(built.schema).parquet(path)

    def search(at: tuple[pa.Scalar, ...], asks: pa.Table, shards_: pa.Table) -> pa.Table:
        dim, out = at[0].as_py(), {"class": [], "links": [], "u": [], "v": []}
        if asks.num_rows and shards_.num_rows:
            mine = np.array(asks.column("class").to_pylist(), np.int64)
            queries = _matrix(asks.column("vector"), dim, dtype)
            number, count = np.frombuffer(shards_.column("numbers")[0].as_py(), "<i8").reshape(2, -1)
            matrix = np.frombuffer(shards_.column("vectors")[0].as_py(), dtype).reshape(-1, dim)
            g = _load_graph(shards_.column("graph")[0].as_py(), matrix)
            norm = np.sqrt((matrix.astype(np.float64) ** 2).sum(1))
            links = np.zeros(len(mine), np.int64)
            edges: list[tuple[int, int]] = []
            for i, j in near_vectors(g, queries, threshold, np.random.default_rng(17)):
                for a in range(0, len(i), 100_000):
                    x, y = i[a : a + 100_000], j[a : a + 100_000]
                    q = queries[x].astype(np.float64)
                    cosine = (q * matrix[y].astype(np.float64)).sum(1) / (np.sqrt((q * q).sum(1)) * norm[y])
                    real = (cosine >= threshold) & (mine[x] != number[y])
                    x, y = x[real], y[real]
                    np.add.at(links, x, count[y])
                    edges += forest(mine[x].tolist(), number[y].tolist())
            if edges:
                edges = forest(*map(list, zip(*edges, strict=True)))
            some = links > 0
            out["class"] = mine[some].tolist() + [None] * len(edges)
            out["links"] = links[some].tolist() + [None] * len(edges)
            out["u"] = [None] * int(some.sum()) + [u for u, _ in edges]
            out["v"] = [None] * int(some.sum()) + [v for _, v in edges]
        return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})

    every = lambda numbers: F.explode(F.sequence(F.lit(0), by_dim(numbers) - 1))
    asks = dealt.select("dim", "block", "class", "vector", every(shards).alias("shard")) if sizes else dealt.select("dim", "block", "class", "vector", "shard")
    told = graphs.withColumn("block", every(blocks)) if sizes else graphs.withColumn("block", F.lit(0))
    keys = ("dim", "shard", "block")
    found = cut_lineage(asks.groupBy(*keys).cogroup(told.groupBy(*keys)).applyInArrow(search, "class bigint, links bigint, u bigint, v bigint"))
    sums = found.where("class is not null").groupBy("class").agg(F.sum("links").alias("links"))
    roots = connected_components(found.where("u is not null").select("u", "v")).withColumnRenamed("node", "class")
    rooted = classes.select("class", "least", "n").join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").join(sums, "class", "left").select("class", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    known = classes.select("class", F.col("vector").alias("_vector")).join(named, "class")
    joined = rows.join(known, F.col("good") & (F.col("vector") == F.col("_vector")), "left")
    component = F.coalesce("component_id", "key")
    return joined.select(
        F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.col("key").eqNullSafe(component).alias("kept")
    )
