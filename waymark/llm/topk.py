"""Exact top-k search by inner product with norm buckets.

Vectors are grouped by length into buckets of bounded size, longest first, and each bucket is one packed row. Each query
has a running threshold: its k-th best score over a first bucket, that of the longest vectors. A bucket whose longest
vector cannot reach it is never paired with the query. In a bucket the local cosine threshold, threshold / (|q| |longest|),
chooses the pruning. Where it is low, only the bucket's prefix by length is looked at. Where it is high, the query's
largest axes are multiplied first: that partial product, and the lengths of what is left of both vectors, bound the
whole product. Products of the vectors that remain are verified as integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

K, SCALE = 10, 1024
#: Components in a bucket of vectors and in a block of queries, at most: 16,384 vectors and 4,096 queries of 64
#: components. What one task holds.
BUCKET, QUERIES = 2**20, 2**18
#: Packed rows that a task of the packing writes, about.
BUCKETS_PER_TASK = 8
#: Local cosine threshold from which coordinates are worth looking at; below it a bucket's prefix by length is scanned.
COSINE = 0.25
#: The axes looked at first are the fewest that leave at most this share of the local threshold to the query's other
#: axes; where that takes more than MOST of all axes, the prefix is scanned too.
LEFT, MOST = 0.9, 0.75
#: Queries whose products with a bucket are held at once.
AT_ONCE = 256
#: Scaled components and scores stop at the ends of a long; components at the last double before.
LIMIT = 2**63
LAST = 2.0**63 - 1024

PACKED = "block long, dim int, n int, longest double, need double, ids binary, nums binary, norms binary, floors binary, vectors binary"


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """id, v (array<long>), dim and norm of the vectors that take part.

    Vectors that are null or hold a null or non-finite component, empty vectors and null ids take no part. A scaled
    component beyond LAST counts as LAST, with its sign.
    """
    fits = lambda x: F.floor(F.greatest(F.least(x, F.lit(LAST)), F.lit(-LAST)))
    scaled = F.transform(F.col(vector_col).cast("array<double>"), lambda x: fits(x * scale))
    valid = F.forall(F.col(vector_col), lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where((F.size(vector_col) > 0) & valid)
    rows = rows.select(F.col(id_col).cast("long").alias("id"), scaled.alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return rows.withColumn("dim", F.size("v")).withColumn("norm", F.sqrt(square))


def _packed(rows: DataFrame, components: int, name: str) -> DataFrame:
    """Stored blocks of rows (id, num, v, dim, norm, floor, need) of one dimension with at most so many components.

    Rows must come partitioned and sorted; a block is a run of a partition's rows. longest and need are the largest
    norm and the least need in the block.
    """

    def row(block: int, dim: int, held: list[tuple[np.ndarray, ...]]) -> dict[str, list]:
        ids, nums, norms, floors, needs, values = (np.concatenate(x) for x in zip(*held))
        small = not len(values) or max(-int(values.min()), int(values.max())) < 2**31
        return {
            "block": block, "dim": dim, "n": len(ids), "longest": float(norms.max()), "need": float(needs.min()), "ids": ids.tobytes(), "nums": nums.tobytes(), "norms": norms.tobytes(),
            "floors": floors.tobytes(), "vectors": values.astype("<i4" if small else "<i8").tobytes(),
        }

    kinds = pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("n", pa.int32()), ("longest", pa.float64()), ("need", pa.float64()), *[(c, pa.binary()) for c in ("ids", "nums", "norms", "floors", "vectors")]])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, dim, n, held = TaskContext.get().partitionId() << 32, 0, 0, []
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            plain = [batch.column(c).to_numpy() for c in ("id", "num", "norm", "floor", "need")]
            at = 0
            while at < len(dims):
                if held and (dims[at] != dim or (n + 1) * dim > components):
                    yield pa.RecordBatch.from_pylist([row(block, dim, held)], kinds)
                    block, n, held = block + 1, 0, []
                dim = int(dims[at])
                other = np.flatnonzero(dims[at:] != dim)
                size = min(int(other[0]) if len(other) else len(dims) - at, max(1, components // dim) - n)
                held.append((*[c[at : at + size] for c in plain], batch.column("v").slice(at, size).flatten().to_numpy()))
                at, n = at + size, n + size
        if held:
            yield pa.RecordBatch.from_pylist([row(block, dim, held)], kinds)

    return stored(rows.select("id", "num", "v", "dim", "norm", "floor", "need").mapInArrow(pack, PACKED), name)


def _tasks(rows: DataFrame, components: int) -> int:
    return max(1, -(-(rows.agg(F.sum(F.col("dim").cast("long"))).first()[0] or 0) // (components * BUCKETS_PER_TASK)))


class Block:
    """A packed row as arrays."""

    def __init__(self, table: pa.Table, side: str):
        cell = lambda c: table.column(f"{side}_{c}")[0].as_py()
        n, dim = cell("n"), cell("dim")
        self.ids, self.nums = np.frombuffer(cell("ids"), np.int64), np.frombuffer(cell("nums"), np.int64)
        self.norms, self.floors = np.frombuffer(cell("norms")), np.frombuffer(cell("floors"))
        data = cell("vectors")
        self.vectors = np.frombuffer(data, "<i4" if len(data) == 4 * n * dim else "<i8").reshape(n, dim)
        self.most = np.abs(self.vectors.astype(float)).max(axis=1)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The products as integers; where a long could overflow on the way, by Python's integers. A product that does not
    fit a long is the nearest long."""
    most = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    if most < LIMIT * (1 - 1e-9):
        return a.astype(np.int64) @ b.T.astype(np.int64)
    return np.clip(a.astype(object) @ b.T.astype(object), -LIMIT, LIMIT - 1).astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    keep = ids != own
    scores, ids = scores[keep], ids[keep]
    if len(ids) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        scores, ids = scores[scores >= least], ids[scores >= least]
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


class Search:
    """The k best of a bucket for each query of a block, and how many products were verified for them."""

    def __init__(self, asked: Block, bucket: Block, k: int):
        self.asked, self.bucket, self.k = asked, bucket, k
        self.verified = 0
        self.found: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        n, dim = bucket.vectors.shape
        # How many of the bucket's vectors, longest first, are long enough; a product may be off by its rounding.
        self.low = asked.floors - np.abs(asked.floors) * 1e-12
        with np.errstate(divide="ignore", invalid="ignore"):
            self.prefix = np.where((self.low > 0) & (asked.norms > 0), np.searchsorted(-bucket.norms, -(self.low / asked.norms) * (1 - 1e-9), side="right"), n)
            self.prefix[(self.low > 0) & (asked.norms == 0)] = 0
            self.cosine = np.where(asked.norms * bucket.norms[0] > 0, self.low / (asked.norms * bucket.norms[0]), 0.0)
        if asked.most.max() * bucket.most.max() * dim < 2**53:
            self.values, self.columns = bucket.vectors.astype(float), None
            self.one_by_one(self.by_coordinates())
        else:
            for i in range(len(asked.ids)):
                self.long_products(i)

    def add(self, i: int, scores: np.ndarray, ids: np.ndarray) -> None:
        best, found = _best(scores, ids, self.asked.ids[i], self.k)
        self.found.append((self.asked.nums[i], self.asked.ids[i], found, best))

    def focus(self, i: int) -> np.ndarray | None:
        """The axes to look at first, or None where the prefix by length is scanned."""
        cosine, q = self.cosine[i], self.asked.vectors[i].astype(float)
        if not COSINE <= cosine < np.inf:
            return None
        order = np.argsort(-np.abs(q))
        left = np.sqrt(np.maximum(1 - np.cumsum(q[order] ** 2) / self.asked.norms[i] ** 2, 0))
        n = int(np.argmax(left <= LEFT * min(cosine, 1.0))) + 1
        return order[:n] if n <= MOST * len(q) else None

    def by_coordinates(self) -> list[int]:
        """Queries of a high local threshold; returns the others."""
        rest = []
        for i in range(len(self.asked.ids)):
            if not self.prefix[i]:
                continue
            axes = self.focus(i)
            if axes is None:
                rest.append(i)
                continue
            if self.columns is None:
                self.columns = np.ascontiguousarray(self.bucket.vectors.T.astype(np.float32))
                self.squares = self.columns**2
                self.lengths = self.bucket.norms.astype(np.float32)
            m, norm, q = self.prefix[i], self.asked.norms[i], self.asked.vectors[i].astype(float)
            outside = np.sqrt(max(norm**2 - (q[axes] ** 2).sum(), 0) + 1e-6 * norm**2)
            part = q[axes].astype(np.float32) @ self.columns[axes, :m]
            # Single precision is off by far less than these allowances.
            left = np.sqrt(np.maximum(self.lengths[:m] ** 2 * np.float32(1 + 1e-5) - self.squares[axes, :m].sum(axis=0), 0))
            rows = np.flatnonzero(part + np.float32(outside) * left + np.float32(1e-4 * norm) * self.lengths[:m] >= self.low[i])
            self.verified += len(rows)
            if len(rows):
                scores = (self.values[rows] @ q).astype(np.int64)
                reach = scores >= self.low[i]
                self.add(i, scores[reach], self.bucket.ids[rows[reach]])
        return rest

    def one_by_one(self, queries: list[int]) -> None:
        queries = sorted(queries, key=lambda i: self.prefix[i])
        for at in range(0, len(queries), AT_ONCE):
            part = queries[at : at + AT_ONCE]
            m = self.prefix[part[-1]]
            products = self.asked.vectors[part].astype(float) @ self.values[:m].T
            for i, row in zip(part, products):
                row = row[: self.prefix[i]]
                self.verified += len(row)
                reach = np.flatnonzero(row >= self.low[i])
                self.add(i, row[reach].astype(np.int64), self.bucket.ids[reach])

    def long_products(self, i: int) -> None:
        """Vectors are multiplied in as many bits as their own components ask for."""
        m, q = self.prefix[i], self.asked.vectors[i][None, :]
        size = self.asked.most[i] * self.bucket.most[:m] * q.shape[1]
        scores = np.zeros(m, np.int64)
        mine = self.bucket.ids[:m] != self.asked.ids[i]
        for low, high in ((-1, 2**53), (2**53, LIMIT * (1 - 1e-9)), (LIMIT * (1 - 1e-9), np.inf)):
            rows = np.flatnonzero((size >= low) & (size < high) & mine)
            if len(rows):
                scores[rows] = _products(q, self.bucket.vectors[rows])[0]
        self.verified += m
        reach = np.flatnonzero(mine & (scores >= self.low[i]))
        self.add(i, scores[reach], self.bucket.ids[reach])

    def table(self) -> pa.Table:
        sizes = [len(x[2]) for x in self.found]
        join = lambda k: np.concatenate([np.zeros(0, np.int64), *[x[k] for x in self.found]])
        repeat = lambda k: np.repeat(np.array([x[k] for x in self.found], np.int64), sizes)
        return pa.table({"num": repeat(0), "query_id": repeat(1), "vec_id": join(2), "score": join(3)})


def _rank(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("num").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k highest inner products over all vectors but those of its own id.

    Ties go to the smaller vec_id. Queries are compared with vectors of their own dimension only. A query row of a
    repeated id is answered once per distinct vector; a repeated vector is a candidate each time. See whole_vectors
    for rows that take no part. Scores that do not fit a long are the nearest long, and tie. Without candidates a query has no rows. Other columns are not read.
    """
    never = F.lit(float("-inf"))
    rows = stored(whole_vectors(vectors, id_col, vector_col, scale), "vectors")
    asked = whole_vectors(queries, id_col, vector_col, scale).dropDuplicates(["id", "v"])
    asked = stored(asked.withColumn("num", F.monotonically_increasing_id()), "queries")
    # Buckets by length: a range partitioning by dimension and falling norm.
    place = ["dim", F.desc("norm"), "id"]
    cut = rows.withColumns({"num": F.lit(0).cast("long"), "floor": never, "need": never}).repartitionByRange(_tasks(rows, BUCKET), *place).sortWithinPartitions(*place)
    buckets = _packed(cut, BUCKET, "buckets")
    facts = buckets.select("block", "dim", "longest")
    first = facts.groupBy("dim").agg(F.min("block").alias("v"))
    tasks = _tasks(asked, QUERIES)

    def blocks(known: DataFrame) -> DataFrame:
        order = ["dim", "need", "num"]
        return _packed(known.repartitionByRange(tasks, *order).sortWithinPartitions(*order), QUERIES, "query-blocks")

    def search(pairs: DataFrame, asking: DataFrame) -> DataFrame:
        """The best of each pair (q, v) of blocks; a group is one pair. A bucket that most queries meet is copied to
        several tasks, each for a part of the queries."""
        pairs = pairs.withColumn("part", F.pmod(F.xxhash64("q"), F.lit(tasks)))
        left = pairs.join(asking.select(*[F.col(c).alias(f"q_{c}") for c in asking.columns]), F.col("q") == F.col("q_block"))
        wanted = pairs.select(F.col("v").alias("v_block"), F.col("part").alias("v_part")).distinct()
        right = buckets.select(*[F.col(c).alias(f"v_{c}") for c in buckets.columns]).join(wanted, "v_block")
        joined = left.join(right, (F.col("v") == F.col("v_block")) & (F.col("part") == F.col("v_part")))
        run = lambda table: Search(Block(table, "q"), Block(table, "v"), k).table()
        return joined.groupBy("q", "v").applyInArrow(run, "num long, query_id long, vec_id long, score long")

    start = blocks(asked.withColumns({"floor": never, "need": never}))
    seed = stored(search(start.select(F.col("block").alias("q"), "dim").join(first, "dim").select("q", "v"), start), "seed")
    floors = _rank(seed, k).groupBy("num").agg(F.min("score").cast("double").alias("least"), F.count("*").alias("n")).where(F.col("n") >= k).drop("n")
    # The least length that a vector must have: threshold / |q|.
    known = asked.join(floors, "num", "left").withColumn("floor", F.coalesce("least", never)).drop("least")
    known = blocks(known.withColumn("need", F.when((F.col("norm") > 0) & (F.col("floor") > 0), F.col("floor") / F.col("norm") * (1 - 1e-9)).otherwise(never)))
    later = facts.join(first, "dim").where(F.col("block") != F.col("v")).select("dim", F.col("block").alias("v"), "longest")
    # Block descriptions meet, a row per block of queries and of vectors, where the lengths allow a score that counts.
    near = known.select(F.col("block").alias("q"), "dim", "need").join(later, "dim").where("longest >= need").select("q", "v")
    return _rank(seed.unionByName(search(near, known)), k).select("query_id", "rank", "vec_id", "score")
