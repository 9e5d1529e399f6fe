"""Nearest neighbours by inner product: a block matrix join with int8 tiles and exact answers.

Vectors are dealt into blocks. A block holds each vector's components as int8
codes with one scale, and the norms that bound what the codes leave out. A tile
multiplies a block of queries by one of candidates on the codes: with x = x' + e
(x' the coded vector), |x.y - x'.y'| <= |x'||e_y| + |e_x||y|. A pair whose upper
bound is below the query's k-th best lower bound can't be among its k nearest;
the pairs left are recomputed in double precision from the original vectors and
pushed into the query's heap. The heaps of a query's tiles are merged at the end.
The answers are exact: nothing is lost by the quantisation.

A task streams over the candidate blocks of one slice for one block of queries:
it holds two blocks and its queries' heaps. The result is quadratic by contract
(every query against every row); no side is broadcast.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite
components take no part; vectors of different dimension don't meet; rows with
equal scores go by smaller id; a query finds fewer if there are fewer; rows that
share the query's id are its own; an id that stands in several rows is found once, and
asked once, with its best score; null ids take no part; extra columns are left out; an
empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shared_dir, small_batches, with_columns_of

QUERY_BLOCK, CANDIDATE_BLOCK = 1024, 4096
#: Slices of candidate blocks that a query block is dealt over.
SLICE_BLOCKS = 16
_TILE = 256
_KIND = "dim int, n int, ids binary, vectors binary, codes binary, scales binary, norms binary, errors binary"
#: Room for rounding in the bounds, relative and absolute.
_SLACK, _TINY = 1e-9, 1e-300


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes (int8), scales, norms of the coded vectors and norms of what they leave out."""
    scales = np.abs(x).max(axis=1) / 127
    codes = np.rint(x / np.maximum(scales, _TINY)[:, None]).clip(-127, 127).astype(np.int8)
    coded = codes * scales[:, None]
    return codes, scales, np.sqrt((coded**2).sum(axis=1)), np.sqrt(((x - coded) ** 2).sum(axis=1))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of int8 rows: floats of 24 bits hold the sums of 1,024 components."""
    out = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], 1024):
        out += a[:, at : at + 1024].astype(np.float32) @ b[:, at : at + 1024].astype(np.float32).T
    return out


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """rows (id, vector) packed into blocks of about size: block, then the columns of _KIND, one row per dimension."""
    n = max(1, -(-rows.count() // size))
    n = max(n, min(8, 1 + n * size // 256))
    placed = rows.withColumn("block", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(n)).cast("int"))

    def pack(group: pa.Table) -> pa.Table:
        block = group.column("block")[0].as_py()
        ids = group.column("id").to_numpy()
        vectors = group.column("vector").combine_chunks()
        flat = (vectors.flatten() if isinstance(vectors, pa.ListArray) else vectors.chunk(0).flatten()).to_numpy(zero_copy_only=False)
        x = flat.astype(np.float64).reshape(len(ids), -1)
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        codes, scales, norms, errors = quantise(x)
        return pa.Table.from_pydict({"block": pa.array([block], pa.int32()), "dim": pa.array([x.shape[1]], pa.int32()), "n": pa.array([len(ids)], pa.int32()), "ids": [ids.astype(np.int64).tobytes()], "vectors": [x.tobytes()], "codes": [codes.tobytes()], "scales": [scales.tobytes()], "norms": [norms.tobytes()], "errors": [errors.tobytes()]})

    return placed.withColumn("dim", F.size("vector")).groupBy("block", "dim").applyInArrow(pack, f"block int, {_KIND}")


def valid_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id and vector (array<double>) of the rows that take part."""
    rows = with_columns_of(table, id_col, vector_col).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda v: v != 0))


class _Block:
    def __init__(self, row: dict):
        self.n, self.dim = row["n"], row["dim"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.vectors = np.frombuffer(row["vectors"], np.float64).reshape(self.n, -1)
        self.codes = np.frombuffer(row["codes"], np.int8).reshape(self.n, -1)
        self.scales, self.norms, self.errors = (np.frombuffer(row[k], np.float64) for k in ("scales", "norms", "errors"))


class Search:
    """The heaps of a block of queries."""

    def __init__(self, queries: _Block, k: int):
        self.q, self.k = queries, k
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(queries.n)]

    def tile(self, c: _Block) -> None:
        """All pairs of the queries with block c."""
        for a in range(0, self.q.n, _TILE):
            for b in range(0, c.n, 4 * _TILE):
                self._tile(slice(a, min(a + _TILE, self.q.n)), c, slice(b, min(b + 4 * _TILE, c.n)))

    def _tile(self, qs: slice, c: _Block, cs: slice) -> None:
        q, k = self.q, self.k
        near = products(q.codes[qs], c.codes[cs]) * (q.scales[qs][:, None] * c.scales[cs])
        full = c.norms[cs] + c.errors[cs]  # at least the candidate's norm
        bound = (q.norms[qs][:, None] * c.errors[cs] + q.errors[qs][:, None] * full) * (1 + _SLACK)
        bound += (q.norms[qs] + q.errors[qs])[:, None] * full * _SLACK + _TINY
        near[q.ids[qs][:, None] == c.ids[cs]] = -np.inf
        low = near - bound
        best = np.array([h[0][0] if len(h) == k else -np.inf for h in self.heaps[qs]])
        if low.shape[1] >= k:
            best = np.maximum(best, np.partition(low, -k, axis=1)[:, -k])
        rows, columns = np.nonzero((near + bound >= best[:, None]) & (near > -np.inf))
        if not len(rows):
            return
        # one row at a time along the last axis: equal vectors get equal scores wherever they stand
        for at in range(0, len(rows), 1 << 16):
            r, s = rows[at : at + (1 << 16)], columns[at : at + (1 << 16)]
            scores = (q.vectors[qs][r] * c.vectors[cs][s]).sum(axis=1)
            for i, score, found in zip((r + qs.start).tolist(), scores.tolist(), (-c.ids[cs][s]).tolist(), strict=True):
                heap = self.heaps[i]
                if len(heap) < k:
                    heapq.heappush(heap, (score, found))
                elif (score, found) > heap[0]:
                    heapq.heapreplace(heap, (score, found))

    def found(self) -> pa.RecordBatch:
        rows = [(int(i), -minus, score) for i, heap in zip(self.q.ids, self.heaps, strict=True) for score, minus in heap]
        a, b, s = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_pydict({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(s, pa.float64())})


def nearest(table: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK, slice_blocks: int = SLICE_BLOCKS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest rows, exactly. is_query: a condition on the id, as column "id"."""
    spark = table.sparkSession
    folder = shared_dir(spark)
    small_batches(spark, rows=4096, mb=16)
    vectors = valid_vectors(table, id_col, vector_col)
    candidates = materialize(_blocks(vectors, candidate_block), f"{folder}/candidates", 16 << 20)
    queries = materialize(_blocks(vectors.where(is_query), query_block), f"{folder}/queries", 16 << 20)
    n_queries = (queries.agg(F.max("block")).first()[0] or 0) + 1
    n_slices = ((candidates.agg(F.max("block")).first()[0] or 0) // slice_blocks) + 1
    # Blocks of both kinds meet by (query block, slice): queries first, then each candidate block in turn.
    left = queries.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(n_slices - 1)))).withColumn("query", F.col("block")).withColumn("kind", F.lit(0))
    right = candidates.withColumn("slice", F.floor(F.col("block") / slice_blocks).cast("int")).withColumn("query", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1)))).withColumn("kind", F.lit(1))
    meet = left.unionByName(right).repartition("query", "slice", "dim").sortWithinPartitions("query", "slice", "dim", "kind", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, searches = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}
                key = row["query"], row["slice"], row["dim"]
                if key != at:
                    yield from (s.found() for s in searches)
                    at, searches = key, []
                if row["kind"] == 0:
                    searches.append(Search(_Block(row), k))
                else:
                    block = _Block(row)
                    for s in searches:
                        s.tile(block)
        yield from (s.found() for s in searches)

    found = meet.mapInArrow(run, "query_id bigint, vec_id bigint, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
