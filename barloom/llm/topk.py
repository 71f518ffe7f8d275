"""Exact top-k search by inner product with KD-trees.

Vectors are dealt to shards by place: median splits of a bounded sample (`SAMPLE_ROWS`, chosen by a hash) cut space into cells, and every
vector goes to the cell it lies in. Each shard builds its KD-tree once: medians split the widest dimension down to small leaves, and every
node keeps the tight box of its points. The most that a query can score in a box is the sum over dimensions of the better of its
two ends. A query first visits the shard of the highest bound; with the k-th score from there it goes on only to shards whose
box can reach it. In a shard a best-first traversal opens the leaves with the highest bounds and ends when none can reach the k-th score found;
the queries of a block go together, in rounds, and a leaf is scored against all that open it in one matrix product.

Equal vectors are one point with the ids that can be among the best of any query (the k + 1 smallest, as many times as they
occur), so copies of one vector, however many, don't weigh on a shard. Queries of a shard are dealt out in blocks of bounded size.

Bounds: the driver holds the sample and the cells' splits (at most `SAMPLE_ROWS` / 32 cells, whose boxes are also what workers get).

Edge cases: vectors that are null, empty or hold null, NaN or infinite components, and rows without a vec_id, take no
part. Rows that repeat a vec_id are all candidates, and none of them for their own id; a repeated query id is asked once
(its smallest vector). Only vectors of the same length are compared. Equal scores go by smaller vec_id, then by nothing
that shows. Components are floor(scale * x), x as double, cut to the range of a long; scores are exact while below 2**53, and cut to that range too.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm.common import discard, lean, materialize, workers_import

SHARD_ROWS, BLOCK_ROWS, LEAF, SAMPLE_ROWS = 8192, 2048, 64, 100_000
FOUND = "query_id long, vec_id long, score long"
MOST = float(2**63 - 1024)  # the greatest double below 2**63
EXACT, EXACT_SINGLE = 2.0**53, 2.0**24  # sums of whole numbers whose absolute values add up to less are exact in doubles, in floats
PENDING = 1 << 20  # found scores that a search holds beyond the best


def best_in_boxes(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The most that q can score in each box."""
    return np.where(q > 0, high * q, low * q).sum(axis=-1)


def best_of_block(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The most that each of q can score in each box: a matrix. Where sums are rounded, a little more."""
    most = np.abs(q) @ np.maximum(np.abs(low), np.abs(high)).max(axis=0)
    slack = np.where(most < EXACT, 0.0, most * (q.shape[1] * 2.0**-51))
    return np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T + slack[:, None]


def packed(points: np.ndarray) -> np.ndarray:
    """The same whole numbers in the smallest type that holds them."""
    most = np.abs(points).max(initial=0)
    return points.astype(next((t for t, end in ((np.int8, 2**7), (np.int16, 2**15), (np.int32, 2**31)) if most < end), np.float64))


class Tree:
    """Leaves in arrays, points in their order: box and rows of each leaf; a point has one id or several."""

    def __init__(self, points: np.ndarray, ids: list[np.ndarray], leaf: int = LEAF):
        self.order = np.arange(len(points))
        self.low, self.high, self.rows = [], [], []
        self._build(points, 0, len(points), leaf)
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.points = packed(points[self.order])
        self.sizes = np.array([len(ids[i]) for i in self.order], dtype=np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.sizes)))
        self.ids = np.concatenate([ids[i] for i in self.order]) if ids else np.empty(0, dtype=np.int64)
        del self.order

    def _build(self, points: np.ndarray, a: int, b: int, leaf: int) -> None:
        mine = points[self.order[a:b]]
        low, high = mine.min(axis=0), mine.max(axis=0)
        wide = int(np.argmax(high - low))
        if b - a > leaf and high[wide] > low[wide]:
            mid = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(mine[:, wide], mid)]
            self._build(points, a, a + mid, leaf)
            self._build(points, a + mid, b, leaf)
        else:
            self.low.append(low)
            self.high.append(high)
            self.rows.append((a, b))

    def _named(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the ids of points, one after the other: which of the rows, and the id."""
        n = self.sizes[rows]
        at = np.repeat(self.first[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(np.arange(len(rows)), n), self.ids[at]

    def search(self, q: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each of q the k best other than its `own` that reach its `floor`: place in q, score and id, in any order.

        In each round a query opens as many leaves as in all rounds before, those of the highest bounds that can reach its k-th score
        found: at most about twice as many as one by one. Queries that open the same leaf are scored against it in one product.
        """
        bound = best_of_block(q, self.low, self.high)
        turn = np.argsort(-bound, axis=1, kind="stable")
        bound = np.take_along_axis(bound, turn, axis=1)
        most = (np.abs(q) @ np.abs(self.points).max(axis=0).astype(float)).max(initial=0)
        kind = np.float32 if most < EXACT_SINGLE else np.float64
        points, mine = self.points.astype(kind), q.astype(kind)
        floor = floor.astype(float)
        found = [(np.empty(0, dtype=np.int64), np.empty(0), np.empty(0, dtype=np.int64))]

        def keep() -> None:
            """Drop what isn't among the k best of its query, and lift floors to k-th scores."""
            asker, scores, who = (np.concatenate(c) for c in zip(*found, strict=True))
            by = np.lexsort((who, -scores, asker))
            asker, scores, who = asker[by], scores[by], who[by]
            nth = np.arange(len(asker)) - np.searchsorted(asker, asker)
            last = nth == k - 1
            floor[asker[last]] = np.maximum(floor[asker[last]], scores[last])
            found[:] = [(asker[nth < k], scores[nth < k], who[nth < k])]

        done, pending = 0, 0
        while done < len(self.rows):
            width = max(1, done)
            asker, nth = np.nonzero(bound[:, done : done + width] >= floor[:, None])
            if not len(asker):
                break
            leaf = turn[asker, done + nth]
            by = np.argsort(leaf, kind="stable")
            asker, leaf = asker[by], leaf[by]
            start = np.flatnonzero(np.diff(leaf, prepend=-1))
            for at, group in zip(leaf[start], np.split(asker, start[1:]), strict=True):
                a, b = self.rows[at]
                step = max(1, PENDING // int(self.first[b] - self.first[a]))
                for part in (group[s : s + step] for s in range(0, len(group), step)):
                    got = mine[part] @ points[a:b].T
                    i, j = np.nonzero(got >= floor[part, None].astype(kind))
                    n, who = self._named(a + j)
                    other = who != own[part[i[n]]]
                    n = n[other]
                    found.append((part[i[n]], got[i[n], j[n]].astype(float), who[other]))
                    pending += len(n)
                    if pending >= PENDING:
                        keep()
                        pending = 0
            keep()
            done, pending = done + width, 0
        return found[0]


class Cells:
    """Splits of space by medians of a sample: dimension and value by node, numbers of the cells at the ends."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.nodes: list[tuple[int, float, int, int]] = []  # dimension, value, children: nodes, or -1 - cell
        self.count = 0
        self._split(sample, max(1, cells))

    def _split(self, x: np.ndarray, cells: int) -> int:
        spread = x.max(axis=0) - x.min(axis=0) if len(x) else np.zeros(1)
        wide = int(np.argmax(spread))
        value = float(np.median(x[:, wide])) if spread[wide] > 0 else 0.0
        left = x[:, wide] < value if spread[wide] > 0 else np.zeros(len(x), dtype=bool)
        if cells < 2 or not left.any():
            self.count += 1
            return -self.count
        at = len(self.nodes)
        self.nodes.append((wide, value, 0, 0))
        self.nodes[at] = (wide, value, self._split(x[left], cells // 2), self._split(x[~left], cells - cells // 2))
        return at

    def of(self, x: np.ndarray) -> np.ndarray:
        """The cell of each vector."""
        if not self.nodes:
            return np.zeros(len(x), dtype=np.int64)
        dim, value, left, right = (np.array(c) for c in zip(*self.nodes, strict=True))
        at = np.zeros(len(x), dtype=np.int64)
        while (open_ := at >= 0).any():
            n = at[open_]
            at[open_] = np.where(x[open_, dim[n]] < value[n], left[n], right[n])
        return -1 - at


def _usable(vectors: DataFrame, scale: int) -> DataFrame:
    x = F.col("embedding")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    fine = vectors.filter(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~bad)
    return fine.select("vec_id", F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("double")).alias("v"), F.size(x).alias("dim"))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=float)


def _dealt(points: DataFrame, cells: Cells) -> DataFrame:
    """points (v, ids) with the cell that each lies in."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells.of(_matrix(b.column(0))))], ["v", "ids", "shard"])

    return points.select("v", "ids").mapInArrow(lean(run), "v array<double>, ids array<long>, shard long")


def _trees(dealt: DataFrame) -> DataFrame:
    """shard, tree (pickled), low, high."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        tree = Tree(np.stack(rows["v"].to_numpy()), [np.asarray(i, dtype=np.int64) for i in rows["ids"]])
        return pd.DataFrame({"shard": [key[0]], "tree": [pickle.dumps(tree)], "low": [tree.low.min(axis=0)], "high": [tree.high.max(axis=0)]})

    return dealt.groupBy("shard").applyInPandas(run, "shard long, tree binary, low array<double>, high array<double>")


def _routes(queries: DataFrame, boxes: list[tuple[int, list[float], list[float]]], k: int) -> DataFrame:
    """query_id, v, floor, shard, block: the shard of the highest bound where no floor is known, else all others that can reach it."""
    shards = np.array([b[0] for b in boxes], dtype=np.int64)
    low, high = np.array([b[1] for b in boxes], dtype=float), np.array([b[2] for b in boxes], dtype=float)
    schema = "query_id long, v array<double>, floor double, shard long"

    def run(batches):
        for b in batches:
            x = _matrix(b.column(1))
            floors = b.column(2).to_pylist()
            rows, to = [], []
            for i, floor in enumerate(floors):
                best = best_in_boxes(x[i], low, high)
                home = int(np.argmax(best))
                if floor is None:
                    reach = np.array([home])
                else:
                    reach = np.flatnonzero(best >= floor)
                    reach = reach[reach != home]
                rows += [i] * len(reach)
                to.append(shards[reach])
            take = pa.array(rows, pa.int64())
            floor = pa.array([float("-inf") if f is None else f for f in floors], pa.float64()).take(take)
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), floor, pa.array(np.concatenate([*to, np.empty(0, dtype=np.int64)]))], ["query_id", "v", "floor", "shard"])

    return queries.select("query_id", "v", "floor").mapInArrow(lean(run), schema)


def _visit(routes: DataFrame, trees: DataFrame, blocks: int, k: int) -> DataFrame:
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        tree: Tree = pickle.loads(right["tree"].iloc[0])
        asked = left["query_id"].to_numpy()
        asker, scores, who = tree.search(np.stack(left["v"].to_numpy()), asked, k, left["floor"].to_numpy())
        return pd.DataFrame({"query_id": asked[asker], "vec_id": who, "score": np.clip(scores, -MOST, MOST).astype(np.int64)})

    mine = routes.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    there = mine.select(F.col("shard").alias("its_shard"), F.col("block").alias("its_block")).distinct().join(trees.select(F.col("shard").alias("its_shard"), "tree"), "its_shard")
    return mine.groupBy("shard", "block").cogroup(there.groupBy("its_shard", "its_block")).applyInPandas(run, FOUND)


def _points(fine: DataFrame, k: int) -> DataFrame:
    """v, ids: different vectors, with the k + 1 smallest ids that have each, an id as often as it occurs (k times at most)."""
    counted = fine.groupBy("v", "vec_id").agg(F.count("*").alias("n"))
    least = counted.withColumn("nth", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("nth") <= k + 1)
    ids = F.flatten(F.collect_list(F.array_repeat("vec_id", F.least(F.col("n"), F.lit(k)).cast("int"))))
    return least.groupBy("v").agg(ids.alias("ids"))


def _search(fine: DataFrame, k: int, every: int) -> DataFrame:
    """The best of vectors of one length, before they are ranked."""
    points = materialize(_points(fine, k))
    n = points.count()
    order = F.xxhash64(F.lit(11), "v")
    sample = np.array([r["v"] for r in points.orderBy(order).limit(min(SAMPLE_ROWS, max(1000, n // 8))).select("v").collect()], dtype=float)
    cells = Cells(sample, min(-(-n // SHARD_ROWS), max(1, len(sample) // 32)))
    trees = materialize(_trees(_dealt(points, cells)))
    boxes = [(r["shard"], r["low"], r["high"]) for r in trees.select("shard", "low", "high").collect()]
    asked = fine.filter(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min("v").alias("v")).select(F.col("vec_id").alias("query_id"), "v")
    asked = materialize(asked)
    blocks = max(1, -(-asked.count() // BLOCK_ROWS))
    none = F.lit(None).cast("double")
    first = materialize(_visit(_routes(asked.withColumn("floor", none), boxes, k), trees, blocks, k))
    if len(boxes) > 1:
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        kth = first.withColumn("r", F.row_number().over(w)).filter(F.col("r") == k).select("query_id", F.col("score").cast("double").alias("floor"))
        onward = asked.join(kth, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
        first = first.unionByName(_visit(_routes(onward, boxes, k), trees, blocks, k))
    discard(points)
    return first


def top_k(vectors: DataFrame, k: int = 20, scale: int = 64, every: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score; the queries are the rows whose vec_id is divisible by `every`."""
    workers_import(vectors.sparkSession)
    fine = materialize(_usable(vectors, scale))
    found = None
    for dim in sorted(r["dim"] for r in fine.select("dim").distinct().collect()):
        part = _search(fine.filter(F.col("dim") == dim), k, every)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], FOUND)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
