"""Near duplicates of vectors by hierarchical navigable small-world graphs.

Only vectors of the same label and length are compared. Equal vectors are one point with a count, so copies
cost nothing. The points of a label are dealt to shards by hash, as many as keep a shard below SHARD_POINTS;
each shard gets a graph. Every shard answers the
queries of all points of its label, in chunks of QUERIES: a descent through the layers, then a beam over the lowest
one, then a walk over all neighbours that are still above the threshold, so that dense groups are found whole however
wide. After that a seeded audit compares queries of the chunk with all of the shard's vectors, until it has met
LEAST_LINKS true links to other points or has audited the whole chunk; while less than RECALL of them were found, the beam is doubled
and the chunk is asked again, up to the size of the shard, where the walk starts from every vector and misses nothing.
What the audits met and found is sent on beside the results.

A task holds the graphs of GROUP shards and streams a slice of the label's chunks through them, CHUNKS at most, so a graph travels once for each
slice and a chunk once for each group, not each with each.

A hit counts if its cosine in double precision is at or above the threshold. A task counts the hits of
each query and links them by union-find, and sends on a spanning forest of no more edges than points; the
forests of all shards and chunks make the components.

Results for odd rows: a vector that is null, empty or zero, holds null or non-finite components, or has a null
label has no links and is its own component; vectors of differing lengths are not compared, and very long ones only take longer; repeated rows each
get a result, and copies are links; ties of a cosine with the threshold are links; null ids are not linked; no rows give no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, workers_can_import
from .components import components

COSINE = 0.93
SHARD_POINTS, QUERIES, GROUP, SLICES = 16_384, 2048, 4, 8
#: Chunks that a task streams through its graphs at most.
CHUNKS = 64
LINKS, BUILD_BEAM, BEAM = 12, 48, 24
#: The share of true links that an audit must see found, how many it must meet, and the queries it takes at once.
RECALL, LEAST_LINKS, AUDITED = 0.995, 400, 64
#: How far below the threshold a walk still goes on.
MARGIN = 0.05


class Graph:
    """A graph over unit vectors; built from a seed, so that a retried task makes the same one."""

    def __init__(self, vectors: np.ndarray, links: int = LINKS, beam: int = BUILD_BEAM, seed: int = 1):
        self.x, self.links = np.ascontiguousarray(vectors, np.float32), links
        n = len(vectors)
        levels = np.minimum((-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(links)).astype(int), 12)
        self.layers: list[dict[int, np.ndarray]] = [{} for _ in range(int(levels.max(initial=0)) + 1)]
        self.entry, self.top = 0, int(levels[0]) if n else 0
        for i in range(n):
            self._insert(i, int(levels[i]), beam)
        # links of the lowest layer in both directions, for walks
        a = np.repeat(np.arange(n, dtype=np.int32), [len(self.layers[0][i]) for i in range(n)])
        b = np.concatenate([self.layers[0][i] for i in range(n)]) if n else a
        pairs = np.unique(np.concatenate([np.stack([a, b], 1), np.stack([b, a], 1)]), axis=0)
        self.around, self.ends = pairs[:, 1].copy(), np.searchsorted(pairs[:, 0], np.arange(n + 1))

    def _insert(self, i: int, level: int, beam: int) -> None:
        if i == 0:
            for layer in self.layers[: level + 1]:
                layer[0] = np.zeros(0, np.int32)
            return
        at = self.entry
        for layer in range(self.top, level, -1):
            at = self._nearest(self.x[i], at, layer)
        for layer in range(min(level, self.top), -1, -1):
            found = self.beam(self.x[i], [at], layer, beam)
            at = found[0][1]
            chosen = self._diverse([j for _, j in found], [s for s, _ in found], self.links)
            self.layers[layer][i] = np.array(chosen, np.int32)
            most = self.links * (2 if layer == 0 else 1)
            for j in chosen:
                near = np.append(self.layers[layer][j], np.int32(i))
                if len(near) > most:
                    s = self.x[near] @ self.x[j]
                    order = np.argsort(-s, kind="stable")
                    near = np.array(self._diverse(near[order].tolist(), s[order].tolist(), most), np.int32)
                self.layers[layer][j] = near
        for layer in range(self.top + 1, level + 1):
            self.layers[layer][i] = np.zeros(0, np.int32)
        if level > self.top:
            self.entry, self.top = i, level

    def _diverse(self, near: list[int], similar: list[float], most: int) -> list[int]:
        """Of candidates in order of likeness those that are less like a chosen one than like the centre; then the rest, to fill up."""
        if len(near) <= most:
            return near
        each = self.x[near] @ self.x[near].T
        chosen, rest = [], []
        closest = np.full(len(near), -2.0)
        for k in range(len(near)):
            if closest[k] < similar[k]:
                chosen.append(k)
                if len(chosen) == most:
                    break
                np.maximum(closest, each[k], out=closest)
            else:
                rest.append(k)
        chosen += rest[: most - len(chosen)]
        return [near[k] for k in chosen]

    def _nearest(self, q: np.ndarray, at: int, layer: int) -> int:
        best = float(self.x[at] @ q)
        while len(near := self.layers[layer][at]):
            s = self.x[near] @ q
            k = int(s.argmax())
            if s[k] <= best:
                break
            at, best = int(near[k]), float(s[k])
        return at

    def beam(self, q: np.ndarray, starts: list[int], layer: int, width: int) -> list[tuple[float, int]]:
        """The width most similar points that a best-first search meets, in order of likeness."""
        seen = set(starts)
        first = [(float(self.x[j] @ q), j) for j in starts]
        best = first[:]
        heapq.heapify(best)
        ahead = [(-s, j) for s, j in first]
        heapq.heapify(ahead)
        links = self.layers[layer]
        while ahead:
            s, at = heapq.heappop(ahead)
            if -s < best[0][0] and len(best) >= width:
                break
            new = [j for j in links[at].tolist() if j not in seen]
            if not new:
                continue
            seen.update(new)
            for s, j in zip((self.x[new] @ q).tolist(), new, strict=True):
                if len(best) < width:
                    heapq.heappush(best, (s, j))
                elif s > best[0][0]:
                    heapq.heapreplace(best, (s, j))
                else:
                    continue
                heapq.heappush(ahead, (-s, j))
        return sorted(best, reverse=True)

    def within(self, q: np.ndarray, least: float, width: int) -> np.ndarray:
        """Points whose similarity is about `least` or more."""
        if width >= len(self.x):
            return np.flatnonzero(self.x @ q >= least - 1e-4)
        at = self.entry
        for layer in range(self.top, 0, -1):
            at = self._nearest(q, at, layer)
        found = {j: s for s, j in self.beam(q, [at], 0, width)}
        ahead = [j for j, s in found.items() if s >= least - MARGIN]
        while ahead:
            near = np.unique(np.concatenate([self.around[self.ends[j] : self.ends[j + 1]] for j in ahead]))
            near = near[[j not in found for j in near.tolist()]] if len(near) else near
            if not len(near):
                break
            s = self.x[near] @ q
            found.update(zip(near.tolist(), s.tolist(), strict=True))
            ahead = near[s >= least - MARGIN].tolist()
        return np.array([j for j, s in found.items() if s >= least - 1e-4], np.int64)


def _unit(vectors: np.ndarray) -> np.ndarray:
    x = vectors.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _graphs(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("point")
    vectors = np.stack(rows["vector"].to_numpy()).astype(np.float64)
    graph = Graph(_unit(vectors))
    blob = pickle.dumps((rows["point"].to_numpy(), rows["n"].to_numpy(), vectors, graph), protocol=5)
    return pd.DataFrame({"label": [rows["label"].iloc[0]], "size": [rows["size"].iloc[0]], "shard": [rows["shard"].iloc[0]], "graph": [blob]})


def _answers(graph: Graph, points: np.ndarray, exact: np.ndarray, queries: np.ndarray, ids: np.ndarray, cosine: float) -> tuple[list[np.ndarray], int, int]:
    """The places of the hits of each query, by beams that are widened until the audit passes; the true links that it met, and how many of them were found."""
    q = queries.astype(np.float32)
    order = np.random.default_rng(len(ids)).permutation(len(ids))
    truth: dict[int, np.ndarray] = {}
    wanted = 0
    for at in range(0, len(order), AUDITED):
        part = order[at : at + AUDITED]
        rows, places = np.nonzero(queries[part] @ exact.T >= cosine)
        others = points[places] != ids[part[rows]]  # a point that finds itself proves nothing
        wanted += int(others.sum())
        truth |= {int(i): places[others & (rows == k)] for k, i in enumerate(part)}
        if wanted >= LEAST_LINKS:
            break
    width = BEAM
    while True:
        answers = []
        for i in range(len(ids)):
            near = graph.within(q[i], cosine, width)
            answers.append(near[exact[near] @ queries[i] >= cosine] if len(near) else near)
        found = sum(int(np.isin(t, answers[i]).sum()) for i, t in truth.items() if len(t))
        if found >= RECALL * wanted or width >= len(points):
            return answers, wanted, found
        width *= 2


def _forest(ids: np.ndarray, points: np.ndarray, answers: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of the links between queries and points."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    a, b = [], []
    for i, near in zip(ids.tolist(), answers, strict=True):
        for j in points[near].tolist():
            x, y = find(i), find(j)
            if x != y:
                root[max(x, y)] = min(x, y)
                a.append(max(i, j))
                b.append(min(i, j))
    return a, b


def near_duplicates(rows: DataFrame, cosine: float = COSINE, shard_points: int = SHARD_POINTS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", audits: list[tuple[int, int]] | None = None) -> DataFrame:
    """id_col, n_links, component_id, kept of each row. audits: gets the true links that all audits met, and how many of them were found."""
    workers_can_import(rows.sparkSession)
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    source = rows.select(F.col(f"`{id_col}`").alias("id"), vector.alias("vector"), F.col(f"`{label_col}`").cast("string").alias("label"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    usable = F.col("label").isNotNull() & F.col("id").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", bad) & F.exists("vector", lambda x: x != 0)
    source = source.withColumn("usable", F.coalesce(usable, F.lit(False)))
    same = ["label", F.sha2(F.concat_ws(",", F.col("vector").cast("array<string>")).cast("binary"), 256)]
    keyed = source.withColumn("digest", F.when(F.col("usable"), F.concat_ws("/", *same)))
    points = cut(keyed.where("usable").groupBy("digest").agg(F.min("id").alias("point"), F.count("*").alias("n"), F.min("label").alias("label"), F.min("vector").alias("vector")).withColumn("size", F.size("vector")))
    counts = points.groupBy("label", "size").agg(F.count("*").alias("points"))
    ceil = lambda n, k: F.ceil(F.col(n) / k).cast("int")
    counts = counts.withColumns({"shards": ceil("points", shard_points), "chunks": ceil("points", QUERIES)})
    counts = counts.withColumns({"groups": ceil("shards", GROUP), "slices": F.greatest(F.least("chunks", F.lit(SLICES)), ceil("chunks", CHUNKS))}).drop("points")
    dealt = points.join(counts, ["label", "size"])
    dealt = dealt.withColumns({"shard": F.pmod(F.xxhash64("digest"), F.col("shards")).cast("int"), "chunk": F.pmod(F.xxhash64("digest", F.lit(1)), F.col("chunks")).cast("int")})
    graphs = cut(dealt.select("label", "size", "shard", "point", "n", "vector").groupBy("label", "size", "shard").applyInPandas(_graphs, "label string, size int, shard int, graph binary"))
    graphs = graphs.join(counts, ["label", "size"]).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    none = lambda kind: F.lit(None).cast(kind)
    graphs = graphs.select("label", "size", F.floor(F.col("shard") / GROUP).cast("int").alias("group"), "slice", F.lit(0).alias("kind"), F.col("shard").alias("number"), "graph", none("array<long>").alias("ids"), none("array<array<double>>").alias("vectors"))
    chunks = dealt.groupBy("label", "size", "chunk").agg(F.collect_list(F.struct("point", "vector")).alias("x"), F.first("groups").alias("groups"), F.first("slices").alias("slices"))
    chunks = chunks.withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    chunks = chunks.select("label", "size", "group", (F.col("chunk") % F.col("slices")).alias("slice"), F.lit(1).alias("kind"), F.col("chunk").alias("number"), none("binary").alias("graph"), F.col("x.point").alias("ids"), F.col("x.vector").alias("vectors"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held = None, []
        for batch in batches:
            for k in range(batch.num_rows):
                key = tuple(batch.column(c)[k].as_py() for c in range(4))
                if key != of:
                    of, held = key, []
                if batch.column(4)[k].as_py() == 0:  # graphs come before the chunks
                    points, n, vectors, graph = pickle.loads(batch.column(6)[k].as_py())
                    held.append((points, n, _unit(vectors), graph))
                    continue
                ids = batch.column(7)[k].values.to_numpy(zero_copy_only=False)
                queries = batch.column(8)[k].values.flatten().to_numpy().reshape(len(ids), -1)
                order = np.argsort(ids)
                ids, queries = ids[order], _unit(queries[order])
                for points, n, exact, graph in held:
                    answers, wanted, met = _answers(graph, points, exact, queries, ids, cosine)
                    links = [int(n[near].sum() - n[near][points[near] == i].sum()) for i, near in zip(ids.tolist(), answers, strict=True)]
                    a, b = _forest(ids, points, answers)
                    # rows of three kinds: a point and its links in this shard, an edge, and an audit's links met and found
                    columns = [[*ids.tolist(), *a, None], [*[None] * len(ids), *b, None], [*links, *[0] * len(a), met], [*[None] * (len(ids) + len(a)), wanted]]
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["a", "b", "links", "wanted"])

    task = ["label", "size", "group", "slice"]
    asked = graphs.unionByName(chunks).repartition(*task).sortWithinPartitions(*task, "kind", "number")
    found = cut(asked.mapInArrow(ask, "a long, b long, links long, wanted long"))
    if audits is not None:
        audits.append(tuple(found.where("wanted is not null").agg(F.coalesce(F.sum("wanted"), F.lit(0)), F.coalesce(F.sum("links"), F.lit(0))).first()))
    found = found.where("wanted is null")
    between = found.where("b is null").groupBy("a").agg(F.sum("links").alias("others"))
    linked = components(found.where("b is not null").select("a", "b"))
    per_point = points.select("digest", "point", "n").join(between, points.point == between.a, "left").join(linked, points.point == linked.vertex, "left")
    per_point = per_point.select("digest", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "point").alias("component_id"))
    # rows that are compared with nothing have keys of their own, so that they don't meet in one task
    out = keyed.select("id", F.coalesce("digest", F.concat(F.lit("-"), F.coalesce(F.col("id").cast("string"), F.lit("")))).alias("digest")).join(per_point, "digest", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def classes(rows: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    return near_duplicates(rows)
