"""Exact top-k inner products, by descending length with rotated partial sums.

Candidates are sorted by length and packed into blocks. Against a query no score exceeds the product
of the lengths, so a block whose longest vector cannot reach a query's k-th score is passed over.
In a block both sides are rotated by the singular vectors of all candidates, which puts most of the
length into the first coordinates: a partial sum plus the product of the lengths of the rests (Cauchy
and Schwarz) bounds the score, and pairs that cannot reach the k-th score are dropped, coordinates by
coordinates. What is left is scored with whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpus_spark.llm.arrow import map_arrow
from corpus_spark.llm.scratch import written

K = 20
SCALE = 64
# Vectors in a block, queries in a pass (a pass reads all blocks), queries compared at once.
BLOCK = 4096
PASS = 4096
_ROWS = 512
# Scored pairs held before they are cut to the best of each query.
_HELD = 1 << 20
# Shares of the coordinates after which pairs are dropped.
STEPS = (0.25, 0.5)
# Rotated sums are rounded: relative to both lengths, by less than this.
SLACK = 1e-9


def whole_vectors(df: DataFrame, vec_id: str, vector: str, scale: int = SCALE) -> DataFrame:
    """(vec_id, x): components times ``scale``, rounded down. Rows with a null id, a null vector or a
    component that is null or not finite are left out."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return df.filter(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & sound).select(
        F.col(vec_id).alias("vec_id"), F.transform(vector, lambda x: F.floor(x.cast("double") * scale)).alias("x")
    )


def _padded(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of one width; missing components are zero."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == dims).all():
        return flat.reshape(len(lengths), dims).astype(np.int64)
    out = np.zeros((len(lengths), dims), dtype=np.int64)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(np.arange(len(lengths)), lengths), at] = flat
    return out


def rotation(vectors: DataFrame, dims: int) -> np.ndarray:
    """Right singular vectors of all vectors, largest first: the eigenvectors of their Gram matrix.

    Tasks send sums of ``dims`` squared numbers, which are added up by place before they are collected.
    """

    def run(batches):
        total = np.zeros((dims, dims))
        for batch in batches:
            x = _padded(batch.column(0), dims).astype(float)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims * dims)), pa.array(total.reshape(-1))], ["place", "total"])

    sums = map_arrow(vectors.select("x"), run, "place long, total double").groupBy("place").agg(F.sum("total").alias("total"))
    gram = np.zeros(dims * dims)
    rows = sums.toPandas()
    gram[rows["place"].to_numpy()] = rows["total"].to_numpy()
    _, basis = np.linalg.eigh(gram.reshape(dims, dims))
    return np.ascontiguousarray(basis[:, ::-1])


def blocks(vectors: DataFrame, dims: int, size: int = BLOCK) -> DataFrame:
    """(longest, ids, x): vectors sorted by falling length, packed; written to the shared folder."""
    length = F.aggregate("x", F.lit(0.0), lambda total, each: total + each * each)
    ordered = vectors.withColumn("length", length)
    ordered = ordered.repartitionByRange(F.desc("length"), "vec_id").sortWithinPartitions(F.desc("length"), "vec_id")

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, size - rows)
                held.append(part)
                rows += part.num_rows
                batch = batch.slice(part.num_rows)
                if rows == size:
                    yield packed(held)
                    held, rows = [], 0
        if rows:
            yield packed(held)

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ids = np.concatenate([part.column(0).to_numpy() for part in held]).astype("<i8")
        x = np.concatenate([_padded(part.column(1), dims) for part in held]).astype("<i8")
        longest = max(part.column(2)[0].as_py() for part in held) ** 0.5
        return pa.RecordBatch.from_arrays(
            [pa.array([longest]), pa.array([ids.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], ["longest", "ids", "x"]
        )

    return written(map_arrow(ordered.select("vec_id", "x", "length"), run, "longest double, ids binary, x binary"), "norm-blocks")


class Search:
    """Queries of one pass with their best scores so far."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, basis: np.ndarray, k: int, exact_float: bool):
        self.ids, self.k, self.exact_float = ids, k, exact_float
        self.x = x
        self.basis = basis
        self.rotated = x @ basis
        self.lengths = np.sqrt((self.rotated**2).sum(axis=1))
        dims = basis.shape[0]
        self.cuts = sorted({max(1, int(dims * step)) for step in STEPS} - {dims}) if dims else []
        self.floor = np.full(len(ids), -np.inf)
        self.clear()

    def clear(self) -> None:
        self.query = np.array([], dtype=np.int64)
        self.found = np.array([], dtype=np.int64)
        self.score = np.array([], dtype=np.int64)

    def fresh(self) -> Search:
        """The same queries and floors with nothing found yet; tasks that share a worker keep apart."""
        other = copy(self)
        other.floor = self.floor.copy()
        other.clear()
        return other

    def look(self, longest: float, ids: np.ndarray, x: np.ndarray) -> None:
        """Take a block of candidates, longest first."""
        near = np.flatnonzero(self.lengths * longest * (1 + SLACK) + SLACK >= self.floor)
        if not len(near) or not len(ids):
            return
        rotated = x @ self.basis
        lengths = np.sqrt((rotated**2).sum(axis=1))
        rests = [np.sqrt((rotated[:, cut:] ** 2).sum(axis=1)) for cut in self.cuts]
        for start in range(0, len(near), _ROWS):
            rows = near[start : start + _ROWS]
            own = self.lengths[rows][:, None]
            most = own * lengths[None, :]
            floor = self.floor[rows][:, None] - SLACK * (1 + most)
            alive = most >= floor
            partial, before = 0.0, 0
            for cut, rest in zip(self.cuts, rests):
                if not alive.any():
                    break
                partial = partial + self.rotated[rows, before:cut] @ rotated[:, before:cut].T
                own_rest = np.sqrt((self.rotated[rows, cut:] ** 2).sum(axis=1))
                alive &= partial + own_rest[:, None] * rest[None, :] >= floor
                before = cut
            self._take(*self._scored(rows, alive, ids, x))
            if len(self.query) > _HELD:
                self._trim()
        self._trim()

    def _scored(self, rows, alive, ids, x):
        query, candidate = np.nonzero(alive)
        if self.exact_float and len(query) > alive.size // 16:
            score = (self.x[rows].astype(float) @ x.astype(float).T)[query, candidate].astype(np.int64)
        else:
            score = np.empty(len(query), dtype=np.int64)
            for at in range(0, len(query), 1 << 18):
                part = slice(at, at + (1 << 18))
                score[part] = np.einsum("ij,ij->i", self.x[rows[query[part]]], x[candidate[part]])
        query = rows[query]
        keep = (score >= self.floor[query]) & (ids[candidate] != self.ids[query])
        return query[keep], ids[candidate[keep]], score[keep]

    def _take(self, query, found, score) -> None:
        self.query = np.concatenate([self.query, query])
        self.found = np.concatenate([self.found, found])
        self.score = np.concatenate([self.score, score])

    def _trim(self) -> None:
        """Keep the k best of each query and raise the floors to the k-th."""
        order = np.lexsort([self.found, -self.score, self.query])
        query = self.query[order]
        first = np.searchsorted(query, query, "left")
        rank = np.arange(len(query)) - first
        order, last = order[rank < self.k], order[rank == self.k - 1]
        self.floor[self.query[last]] = np.maximum(self.floor[self.query[last]], self.score[last])
        self.query, self.found, self.score = self.query[order], self.found[order], self.score[order]


def _opened(row: dict, dims: int) -> tuple[float, np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], "<i8")
    return row["longest"], ids, np.frombuffer(row["x"], "<i8").reshape(len(ids), dims)


def passes(queries: DataFrame, dims: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The queries dealt by hash into parts of about ``most``, at most twice as many, one after the other."""
    total = queries.count()
    deals = max(1, -(-total // most))
    while True:
        # The row number keeps copies of one id from filling a part.
        dealt = F.pmod(F.xxhash64("vec_id", "x"), F.lit(deals))
        largest = queries.groupBy(dealt.alias("deal")).count().agg(F.max("count")).first()[0] or 0
        if largest <= 2 * most or deals > 4 * total:
            break
        deals *= 2
    for deal in range(deals):
        rows = queries.filter(dealt == deal).toArrow().combine_chunks()
        if rows.num_rows:
            yield rows.column(0).to_numpy(), _padded(rows.column(1).combine_chunks(), dims)


def top_k(
    df: DataFrame, is_query, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, scale: int = SCALE,
    block: int = BLOCK, most: int = PASS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` largest inner products with other rows.

    Components are multiplied by ``scale`` and rounded down, so scores are whole numbers and exact;
    ties go to the smaller id. ``is_query`` is a condition on the id column. Candidates are all rows
    but those with the query's id. Rows with a null id, a null vector or a component that is null or
    not finite take no part; a shorter vector is one with zeros at its end. Equal rows among the
    candidates are all named; equal queries are answered once. An empty table gives an empty table.
    Other columns are not read. Scores of 2**62 and more are refused. Runs jobs when called: queries
    are looked up in passes of about ``most`` against all blocks.
    """
    spark = df.sparkSession
    vectors = written(whole_vectors(df, vec_id, vector, scale), "whole-vectors")
    empty = spark.createDataFrame([], "query long, query_id long, vec_id long, score long")
    dims, longest = vectors.agg(
        F.max(F.size("x")), F.max(F.aggregate("x", F.lit(0.0), lambda total, each: total + each.cast("double") * each))
    ).first()
    if longest and longest >= 2.0**62:
        raise ValueError("components are too large for whole-number scores")
    found = empty
    if dims:
        basis = rotation(vectors, dims)
        packed = blocks(vectors, dims, block)
        head = packed.orderBy(F.desc("longest")).limit(1).toArrow().to_pylist()
        before = 0
        for ids, x in passes(vectors.filter(is_query(F.col("vec_id"))).distinct(), dims, most):
            search = Search(ids, x, basis, k, longest < 2.0**53)
            # The longest candidates give each query a k-th score to start from.
            for row in head:
                search.look(*_opened(row, dims))
            found = found.unionByName(written(_pass(packed, search.fresh(), dims, before), "top-k-pass"))
            before += len(ids)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _pass(packed: DataFrame, search: Search, dims: int, before: int) -> DataFrame:
    shared = packed.sparkSession.sparkContext.broadcast(search)

    def run(batches):
        own = shared.value.fresh()
        for batch in batches:
            for number in range(batch.num_rows):
                own.look(*_opened(batch.slice(number, 1).to_pylist()[0], dims))
        columns = [own.query + before, own.ids[own.query], own.found, own.score]
        yield pa.RecordBatch.from_arrays([pa.array(each, pa.int64()) for each in columns], ["query", "query_id", "vec_id", "score"])

    return map_arrow(packed, run, "query long, query_id long, vec_id long, score long")
