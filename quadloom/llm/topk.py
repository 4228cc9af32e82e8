"""Exact top-k search by inner product with vector-approximation files.

Vectors are cut into shards of bounded size.  A shard's approximation gives each component the
number of its cell, a byte, among CELLS equal ones between the component's least and largest value there.
A query scans the cells first.  A cell's upper end (lower end where the query is negative) bounds a component's part of the score from above; as cells
are equal, the bounds of all vectors are one product of the query, scaled by the cells' widths, with the cell numbers.  Then exact vectors are read in the order of
their bounds until the k-th score found beats every bound left.  So results are exact, ties to
the smaller id.  Each pair of a block of queries and a shard is one task; only its k best rows a
query leave it, and the last choice is among those.  Shards and blocks are as large as a task's memory
allows (SHARD_BYTES, BLOCK_BYTES), since a vector is sent to each block of queries and a query to each shard.

Defined results: vectors that are null or hold a null or non-finite component take no part, empty ones score nothing against each other but 0;
vectors of other lengths than the query's aren't its candidates; a row is never its own
candidate, but rows that repeat its id are; a null id comes after all others on ties and is
never a query; ids keep every digit; scores beyond a long are held to its ends; an empty table gives no rows; extra columns are ignored
whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, named

CELLS = 64
SHARD_BYTES = 32 << 20
BLOCK_BYTES = 8 << 20


class Approximation:
    """Cells of one shard's vectors."""

    def __init__(self, x: np.ndarray, cells: int = CELLS):
        self.x, self.cells = x, cells
        self.low, high = x.min(axis=0), x.max(axis=0)
        self.step = np.maximum((high - self.low) / cells, 1e-9)
        self.cell = np.clip(np.floor((x - self.low) / self.step), 0, cells - 1).astype(np.uint8)
        self.numbers = self.cell.T.astype(np.float32)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Upper bounds of the scores of all vectors, for a block of queries."""
        part = q * self.step
        with np.errstate(over="ignore", invalid="ignore"):
            up = part.astype(np.float32) @ self.numbers
            # all that rounding may take from a bound, in the sums here and where cells were numbered
            slack = (np.abs(part) * self.cells).sum(axis=1) * (len(self.low) + 8) * 2.0**-23 + 1e-6 * (np.abs(q * self.low).sum(axis=1) + 1)
            up = up + ((q * self.low).sum(axis=1) + np.maximum(part, 0).sum(axis=1) + slack)[:, None]
        return np.nan_to_num(up, nan=np.inf, posinf=np.inf, neginf=np.inf)

    def best(self, q: np.ndarray, k: int, own: np.ndarray, order: np.ndarray, rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Places and exact scores of each query's k best, ties by `order`; own: the query's row."""
        out = []
        for n, bound in enumerate(self.bounds(q)):
            bound = np.where(rows == own[n], -np.inf, bound)
            take = min(len(bound), 4 * k + 16)
            while True:
                part = np.argpartition(-bound, take - 1)[:take] if take < len(bound) else np.arange(len(bound))
                rest = np.partition(bound, len(bound) - take - 1)[len(bound) - take - 1] if take < len(bound) else -np.inf
                part = part[bound[part] > -np.inf]
                score = exact(self.x[part], q[n])
                best = np.lexsort((order[part], -score))[:k]
                if rest == -np.inf or len(best) == k and score[best[-1]] > rest:
                    out.append((part[best], score[best]))
                    break
                take = min(len(bound), take * 4)
        return out


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of integers held as doubles; exact, and kept within a long's range."""
    if not len(x):
        return np.zeros(0, np.int64)
    if np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * max(1, len(q)) < 2.0**53:
        return (x @ q).astype(np.int64)
    b = [int(v) for v in q]
    ends = np.iinfo(np.int64)
    # one above the least long, so that the order of scores can be turned round
    return np.array([min(max(sum(int(v) * w for v, w in zip(r, b)), ends.min + 1), ends.max) for r in x], np.int64)


def quantised(df: DataFrame, vector_col: str, id_col: str, scale: int) -> DataFrame:
    """Rows (row, id, v array<double>) of the vectors that take part; v holds whole numbers."""
    v = named(vector_col).cast("array<double>")
    fine = df.select(named(id_col).alias("id"), v.alias("v")).where(F.col("v").isNotNull())
    fine = fine.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return fine.select(F.monotonically_increasing_id().alias("row"), "id", F.transform("v", lambda x: _floor(x, scale)).alias("v"))


def _floor(x, scale: int):
    # floor() gives a long; beyond its range a double has no fraction left
    y = x * F.lit(float(scale))
    return F.when(F.abs(y) < 2.0**62, F.floor(y).cast("double")).otherwise(y)


def _matrix(table: pa.Table) -> np.ndarray:
    v = table.column("v").combine_chunks()
    return v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(v), -1) if len(v) else np.zeros((0, 0))


def search(df: DataFrame, is_query, k: int = 5, vector_col: str = "embedding", id_col: str = "vec_id", scale: int = 256, shard: int | None = None, block: int | None = None) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k best of all rows for each row where `is_query` (a column of `id`) holds.

    shard, block: vectors of a shard and queries of a block on average.
    """
    kind = df.schema[id_col].dataType.simpleString()
    base = cut(quantised(df, vector_col, id_col, scale))
    asked = base.where(is_query)
    (n, wide), m = base.agg(F.count("*"), F.max(F.size("v"))).first(), asked.count()
    size = 8 * max(1, wide or 1)
    shards, blocks = (max(1, -(-c // max(1, w))) for c, w in ((n, shard or SHARD_BYTES // size), (m, block or BLOCK_BYTES // size)))
    width = F.size("v").alias("width")
    every = base.select("row", "id", "v", width, F.pmod(F.xxhash64("row"), F.lit(shards)).alias("s"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))
    ask = asked.select("row", "id", "v", width, F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("s"))

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, ids = left.column("row").to_numpy(), left.column("id").combine_chunks()
        asks, places, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(left) and len(right):
            x, q, own = _matrix(left), _matrix(right), right.column("row").to_numpy()
            order = np.empty(len(left), np.int64)
            order[pc.sort_indices(left.select(["id", "row"]), sort_keys=[("id", "ascending"), ("row", "ascending")], null_placement="at_end").to_numpy()] = np.arange(len(left))
            a = Approximation(x) if x.shape[1] else None
            for start in range(0, len(q), 64):
                part = slice(start, start + 64)
                if a is None:  # vectors without components: all scores are 0
                    best = [((at := np.argsort(np.where(rows == r, len(rows), order))[: min(k, len(rows) - 1)]), np.zeros(len(at), np.int64)) for r in own[part]]
                else:
                    best = a.best(q[part], k, own[part], order, rows)
                for at, (place, score) in enumerate(best, start):
                    asks.append(np.full(len(place), at))
                    places.append(place)
                    scores.append(score)
        ask, place = pa.array(np.concatenate(asks)), pa.array(np.concatenate(places))
        out = {"row": right.column("row").combine_chunks().take(ask), "query_id": right.column("id").combine_chunks().take(ask)}
        return pa.table(out | {"vec_row": left.column("row").combine_chunks().take(place), "vec_id": ids.take(place), "score": pa.array(np.concatenate(scores))})

    best = every.groupBy("s", "b", "width").cogroup(ask.groupBy("s", "b", "width")).applyInArrow(task, f"row long, query_id {kind}, vec_row long, vec_id {kind}, score long")
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "vec_row")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
