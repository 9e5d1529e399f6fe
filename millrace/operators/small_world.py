"""Approximate nearest vectors by layered small-world graphs, one per shard.

Vectors are dealt to shards by a hash. A shard's task builds a graph: each vector gets a random top layer; in
each of its layers it is linked to near ones that came before it, chosen so that no link is better served by another one, and
these link back. The index is a table of rows, one per vector, with its shard, its layer and its links, so that it
is stored, read and dropped like any other; new vectors are new shards. A search streams all queries over each shard: it descends the
layers greedily and keeps the EF_SEARCH best on the lowest, or as many more as the shard needs: its task measures at the build,
against exact answers, how wide a search has to be, and the index says so. Shards' results are scored in double precision
from the original vectors and merged by query.

Equal vectors of a shard are one vector of its graph: the first by id is linked, the others are rows that name it (layer -1), and an
answer has as many of them as it needs, smaller ids first. Copies would else fill a search, and which of them it finds would be chance.

Null vectors take no part; vectors of another length than the query's don't meet it; zero vectors have score 0.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Links per vector and layer (twice as many on the lowest), candidates for them, and candidates of a search.
M, EF_CONSTRUCTION, EF_SEARCH = 16, 200, 50
#: What a shard's searches are to find of the NEAREST nearest ones: measured on MEASURED of its vectors, each as if it weren't there.
RECALL, NEAREST, MEASURED = 0.95, 10, 128
#: Vectors of a shard, all of which its task holds.
SHARD_ROWS = 20_000
_BLOCK = 256


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; zeros stay."""
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def _diverse(near: np.ndarray, x: np.ndarray, candidates: np.ndarray, most: int) -> np.ndarray:
    """Of candidates, nearest first, those that are nearer to the vector than to any chosen before; then the nearest others."""
    if len(candidates) <= most:
        return candidates
    order = np.argsort(-near, kind="stable")
    near, candidates = near[order], candidates[order]
    between, best, kept = x[candidates] @ x[candidates].T, np.full(len(candidates), -np.inf), []
    for i in range(len(candidates)):
        if near[i] > best[i]:
            kept.append(i)
            if len(kept) == most:
                break
            np.maximum(best, between[i], out=best)
    if len(kept) < most:
        kept += [i for i in range(len(candidates)) if i not in set(kept)][: most - len(kept)]
    return candidates[kept]


class Graph:
    """Layers of links over unit vectors; the entry is the first vector of the highest layer."""

    def __init__(self, vectors: np.ndarray, layers: np.ndarray, links: list[list[np.ndarray]]):
        self.x, self.layers, self.links = vectors, layers, links
        self.entry = int(layers.argmax()) if len(layers) else -1
        self._seen, self._turn = np.zeros(len(vectors), np.int64), 0

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int = 0, m: int = M, ef: int = EF_CONSTRUCTION) -> Graph:
        n = len(vectors)
        chance = np.random.default_rng(seed).random(n)
        layers = np.floor(-np.log(np.maximum(chance, 1e-300)) / np.log(m)).astype(np.int64)
        links: list[list[np.ndarray]] = [[np.zeros(0, np.int64) for _ in range(top + 1)] for top in layers]
        for layer in range(int(layers.max(initial=-1)) + 1):
            own, most = np.flatnonzero(layers >= layer), m if layer else 2 * m
            for lo in range(0, len(own), _BLOCK):
                block = own[lo : lo + _BLOCK]
                near = vectors[block] @ vectors[own[: lo + len(block)]].T
                for i, node in enumerate(block.tolist()):
                    row = near[i, : lo + i]
                    if not len(row):
                        continue
                    best = np.argpartition(-row, ef - 1)[:ef] if len(row) > ef else np.arange(len(row))
                    chosen = _diverse(row[best], vectors, own[best], m)
                    links[node][layer] = chosen
                    for other in chosen.tolist():
                        back = np.append(links[other][layer], node)
                        links[other][layer] = back if len(back) <= most else _diverse(vectors[back] @ vectors[other], vectors, back, most)
        return cls(vectors, layers, links)

    def breadth(self, k: int = NEAREST, least: int = EF_SEARCH) -> int:
        """The first ef of least, twice that and so on whose searches find RECALL of the k nearest, or all vectors."""
        low, k, ef = np.flatnonzero((self.layers == 0) & (np.arange(len(self.x)) != self.entry)), min(k, len(self.x) - 1), least
        sample = low[np.unique(np.linspace(0, len(low) - 1, MEASURED).astype(np.int64))] if len(low) else low
        near = self.x[sample] @ self.x.T
        near[np.arange(len(sample)), sample] = -np.inf
        last = np.partition(near, -k, axis=1)[:, -k] if len(sample) else near
        while ef < len(self.x):
            found = sum(int((near[i, self.search(self.x[place], k, ef, place)] >= last[i] - 1e-9).sum()) for i, place in enumerate(sample.tolist()))
            if found >= RECALL * k * len(sample):
                break
            ef *= 2
        return ef

    def search(self, query: np.ndarray, k: int, ef: int = EF_SEARCH, without: int | None = None) -> list[int]:
        """Places of about the k nearest, nearest first; without: a place of the lowest layer that isn't to be met."""
        if self.entry < 0:
            return []
        at, near = self.entry, float(self.x[self.entry] @ query)
        for layer in range(int(self.layers[at]), 0, -1):
            while len(around := self.links[at][layer]):
                scores = self.x[around] @ query
                best = int(scores.argmax())
                if scores[best] <= near:
                    break
                at, near = int(around[best]), float(scores[best])
        ef = max(ef, k)
        self._turn += 1
        self._seen[at] = self._turn
        if without is not None:
            self._seen[without] = self._turn
        todo, kept = [(-near, at)], [(near, at)]
        while todo:
            minus, at = heapq.heappop(todo)
            if len(kept) >= ef and -minus < kept[0][0]:
                break
            around = self.links[at][0]
            around = around[self._seen[around] != self._turn]
            if not len(around):
                continue
            self._seen[around] = self._turn
            for score, place in zip((self.x[around] @ query).tolist(), around.tolist(), strict=True):
                if len(kept) < ef:
                    heapq.heappush(kept, (score, place))
                elif score > kept[0][0]:
                    heapq.heapreplace(kept, (score, place))
                else:
                    continue
                heapq.heappush(todo, (-score, place))
        return [place for _, place in heapq.nlargest(k, kept)]


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)


def build_index(vectors: DataFrame, shard_rows: int = SHARD_ROWS, first_shard: int = 0, m: int = M, ef: int = EF_CONSTRUCTION) -> DataFrame:
    """dim, shard, place, id, vector, layer, links, breadth (of its shard's searches) of vectors (id, vector). Shards are numbered
    from first_shard, so that an index can be appended to another one."""
    rows = vectors.where(F.col("vector").isNotNull() & (F.size("vector") > 0)).select("id", F.col("vector").cast("array<double>").alias("vector"))
    shards = max(1, -(-rows.count() // shard_rows))
    dealt = rows.withColumn("dim", F.size("vector")).withColumn("shard", (F.pmod(F.xxhash64("id"), F.lit(shards)) + first_shard).cast("int"))
    kind = dict(rows.dtypes)["id"]
    nested = pa.list_(pa.list_(pa.int32()))

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        x = _matrix(group.column("vector"))
        firsts, of = np.unique(x, axis=0, return_index=True, return_inverse=True)[1:]
        firsts, own = np.sort(firsts), firsts[of.reshape(-1)]  # each row's first equal row
        copies = np.flatnonzero(own != np.arange(len(x)))
        graph = Graph.build(unit(x[firsts]), int(group.column("shard")[0].as_py()), m, ef)
        links = pa.array([[x.tolist() for x in own] for own in graph.links] + [[[i]] for i in np.searchsorted(firsts, own[copies]).tolist()], nested)
        group = group.take(pa.array(np.r_[firsts, copies]))
        layers = pa.array(np.r_[graph.layers, np.full(len(copies), -1)], pa.int32())
        return pa.table({"dim": group.column("dim"), "shard": group.column("shard"), "place": pa.array(range(len(group)), pa.int32()), "id": group.column("id"), "vector": group.column("vector"), "layer": layers, "links": links, "breadth": pa.array([graph.breadth()] * len(group), pa.int32())})

    return dealt.groupBy("dim", "shard").applyInArrow(run, f"dim int, shard int, place int, id {kind}, vector array<double>, layer int, links array<array<int>>, breadth int")


def search_index(index: DataFrame, queries: DataFrame, k: int, ef: int = EF_SEARCH) -> DataFrame:
    """query_id, id, score (cosine), rank of about the k nearest to each query (query_id, query_vector). Each shard's task
    reads its rows and then all queries as they come. A search keeps ef candidates, or more where its shard needs them."""
    shards = index.select("dim", "shard").distinct()
    kinds = dict(index.dtypes)["id"], dict(queries.dtypes)["query_id"]
    none = {c: F.lit(None).cast(t) for c, t in (("id", kinds[0]), ("layer", "int"), ("links", "array<array<int>>"), ("query_id", kinds[1]), ("place", "int"), ("breadth", "int"))}
    own = index.select("dim", "shard", F.lit(0).alias("kind"), "place", "id", none["query_id"].alias("query_id"), "vector", "layer", "links", "breadth")
    asked = queries.where(F.col("query_vector").isNotNull()).withColumn("dim", F.size("query_vector")).join(shards, "dim")
    asked = asked.select("dim", "shard", F.lit(1).alias("kind"), none["place"].alias("place"), none["id"].alias("id"), "query_id", F.col("query_vector").cast("array<double>").alias("vector"), none["layer"].alias("layer"), none["links"].alias("links"), none["breadth"].alias("breadth"))
    meet = own.union(asked).repartition("dim", "shard").sortWithinPartitions("dim", "shard", "kind", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, graph, ids, exact, copies, wide = None, [], None, [], None, {}, ef
        for batch in batches:
            dims, numbers, kind = (batch.column(c).to_numpy() for c in ("dim", "shard", "kind"))
            edges = np.flatnonzero(np.r_[True, (dims[1:] != dims[:-1]) | (numbers[1:] != numbers[:-1]) | (kind[1:] != kind[:-1])])
            for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), batch.num_rows], strict=True):
                key, piece = (int(dims[lo]), int(numbers[lo])), batch.slice(lo, hi - lo)
                if key != at:
                    at, parts, graph = key, [], None
                if kind[lo] == 0:
                    parts.append(piece)
                    continue
                if graph is None:
                    rows = pa.Table.from_batches(parts)
                    ids, exact = rows.column("id"), unit(_matrix(rows.column("vector")))
                    layers, links = rows.column("layer").to_numpy(), rows.column("links").to_pylist()
                    linked = int((layers >= 0).sum())
                    graph = Graph(exact[:linked], layers[:linked], [[np.array(x, np.int64) for x in own] for own in links[:linked]])
                    wide = max(ef, rows.column("breadth")[0].as_py() * max(k, NEAREST) // NEAREST)
                    parts, copies = [], {}
                    for place in range(linked, len(links)):
                        copies.setdefault(links[place][0][0], []).append(place)
                asked, places, scores = [], [], []
                for i, q in enumerate(unit(_matrix(piece.column("vector")))):
                    found = graph.search(q, k, wide)
                    if copies:
                        found = [x for place in found for x in (place, *copies.get(place, [])[: k - 1])][:k]
                    asked += [i] * len(found)
                    places += found
                    scores.append((exact[found] * q).sum(axis=1))
                yield pa.RecordBatch.from_arrays([piece.column("query_id").take(pa.array(asked, pa.int64())), ids.combine_chunks().take(pa.array(places, pa.int64())), pa.array(np.concatenate(scores))], names=["query_id", "id", "score"])

    found = meet.mapInArrow(run, f"query_id {kinds[1]}, id {kinds[0]}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
