"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first traversal."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._bytes import small
from ._common import materialize
from .topk import vector_blocks


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products, components added from first to last in double precision, so that equal vectors score equally."""
    total = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        total += a[:, i, None] * b[None, :, i]
    return total


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest finite scores, highest first, ties by smaller id."""
    places = np.flatnonzero(scores > -np.inf)
    if len(places) > k:
        floor = np.partition(scores[places], len(places) - k)[len(places) - k]
        places = places[scores[places] >= floor]
    return places[np.lexsort((ids[places], -scores[places]))][:k]


class KMeansTree:
    """Nodes with a centroid each; a node without children is a leaf.

    Equal rows of the sample count once, so a hot vector takes one place and does not keep the others from being split.
    """

    def __init__(self, sample: np.ndarray, leaves: int, branching: int, seed: int) -> None:
        sample = np.unique(sample, axis=0)
        self.centroids: list[np.ndarray] = [sample.mean(axis=0)]
        self.children: list[list[int]] = [[]]
        self.leaf: list[int] = [0]
        rng = np.random.default_rng(seed)
        # the largest node is split next, till there are enough leaves
        heap = [(-len(sample), 0, np.arange(len(sample)))]
        count = 1
        while heap and count < leaves:
            size, node, rows = heapq.heappop(heap)
            if -size < 2:
                break
            parts = self._split(sample[rows], min(branching, leaves - count + 1), rng)
            if len(parts) < 2:
                continue
            for centroid, part in parts:
                child = len(self.centroids)
                self.centroids.append(centroid)
                self.children.append([])
                self.children[node].append(child)
                heapq.heappush(heap, (-len(part), child, rows[part]))
            count += len(parts) - 1
        # leaves are numbered from left to right, so neighbours in number are neighbours in the tree
        self.leaves, todo = [], [0]
        while todo:
            node = todo.pop()
            todo += reversed(self.children[node])
            if not self.children[node]:
                self.leaves.append(node)
        self.leaf = [-1] * len(self.children)
        for n, node in enumerate(self.leaves):
            self.leaf[node] = n
        self.matrix = np.stack(self.centroids)
        self.spread = np.zeros(len(self.centroids))

    def measure(self, counts: dict[int, int], squares: dict[int, float]) -> None:
        """Sets each node's spread: the root mean square distance of its rows to its centroid, from the leaves' counts and sums of squares."""
        rows, total = np.zeros(len(self.centroids)), np.zeros(len(self.centroids))
        for node in reversed(range(len(self.centroids))):  # children have higher numbers
            if self.children[node]:
                kids = self.children[node]
                apart = ((self.matrix[kids] - self.matrix[node]) ** 2).sum(axis=1)
                rows[node], total[node] = rows[kids].sum(), (total[kids] + rows[kids] * apart).sum()
            else:
                rows[node], total[node] = counts.get(self.leaf[node], 0), squares.get(self.leaf[node], 0.0)
        self.spread = np.sqrt(total / np.maximum(rows, 1))

    @staticmethod
    def _split(rows: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> list[tuple[np.ndarray, np.ndarray]]:
        """k-means; empty clusters are dropped."""
        centers = rows[rng.choice(len(rows), min(k, len(rows)), replace=False)]
        near = np.zeros(len(rows), int)
        for _ in range(rounds):
            now = ((centers**2).sum(1)[None, :] - 2 * rows @ centers.T).argmin(1)
            used = np.unique(now)
            centers = np.stack([rows[now == c].mean(axis=0) for c in used])
            now = np.searchsorted(used, now)
            if (now == near).all() and len(used) == near.max() + 1:
                break
            near = now
        return [(centers[c], np.flatnonzero(near == c)) for c in range(near.max() + 1) if (near == c).any()]

    def assign(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row: at every node to the nearest child."""
        out = np.zeros(len(rows), np.int64)
        todo = [(0, np.arange(len(rows)))]
        while todo:
            node, own = todo.pop()
            kids = self.children[node]
            if not kids:
                out[own] = self.leaf[node]
                continue
            c = self.matrix[kids]
            near = ((c**2).sum(1)[None, :] - 2 * rows[own] @ c.T).argmin(1)
            todo += [(kid, own[near == i]) for i, kid in enumerate(kids) if (near == i).any()]
        return out

    def visits(self, query: np.ndarray, limit: int, counts: dict[int, int] | None = None, least: int = 0, reach: float = 0.0) -> list[int]:
        """The first leaves that best-bin-first traversal reaches: a queue of nodes, highest first.

        A node's place is the inner product with its centroid and `reach` times its spread times the query's length:
        what rows that far from the centroid may score. With counts of the leaves' rows, it goes on beyond the limit
        until the leaves hold at least `least` rows.
        """
        scores = self.matrix @ query + reach * self.spread * np.sqrt(query @ query)
        queue, out, held = [(-scores[0], 0)], [], 0
        while queue and (len(out) < limit or counts is not None and held < least):
            _, node = heapq.heappop(queue)
            if self.children[node]:
                for kid in self.children[node]:
                    heapq.heappush(queue, (-scores[kid], kid))
            else:
                out.append(self.leaf[node])
                held += counts.get(self.leaf[node], 0) if counts is not None else 0
        return out


def _usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, vec, length: rows with an id and a finite vector other than zero."""
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vec_col].cast("array<double>").alias("vec"))
    rows = rows.filter("vec_id is not null and vec is not null").filter(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0))
    return rows


def _exact_leaves(ids: np.ndarray, queries: np.ndarray, k: int):
    """A pass over all placed rows that gives each calibration query's k nearest of every block, with their leaves."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            names, leaves, rows = batch.column(0).to_numpy(), batch.column(2).to_numpy(), _matrix(pa.table(batch), queries.shape[1])
            scores = inner_products(queries, rows)
            scores[ids[:, None] == names[None, :]] = -np.inf
            for q in range(len(ids)):
                places = best(scores[q], names, k)
                if len(places):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(places), q)), pa.array(names[places]), pa.array(scores[q, places]), pa.array(leaves[places])], names=["q", "vec_id", "score", "leaf"])

    return run


def nearest(
    vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, recall: float = 0.97,
    sample_rows: int = 20_000, leaf_rows: int = 50, max_leaves: int = 5_000, branching: int = 8, calibration: int = 200, bucket_rows: int = 4096, query_rows: int = 2048, seed: int = 7,
) -> DataFrame:
    """query_id, rank, vec_id, score, recall, scored: each query's k nearest found, by largest inner product.

    The tree is fitted on about sample_rows distinct vectors, those with the smallest seeded hashes, and has a leaf for
    leaf_rows distinct vectors, but no more than max_leaves or a quarter of the sample; every row is then assigned to
    a leaf. `calibration` queries are answered exactly in one pass over all rows; the leaves a query visits are widened
    until they reach the stated recall. As many further queries are answered too, and the share of their nearest in the
    leaves they visit is the column recall: measured on queries that chose nothing (on the same ones, where there are
    too few). Neighbouring leaves share a shelf of about bucket_rows rows, and queries meet the rows of the leaves they
    visit by a cogroup on the shelf: a leaf of more rows, such as one of a hot vector's copies, is dealt into several
    buckets and its queries go to each, so nothing is capped; the queries that visit a shelf are dealt into parts of about
    query_rows in turn, and its rows go to each. A shelf returns k rows for each query at most. `scored` is the share of
    all rows that lie in the leaves a query visits.

    Ties go to smaller ids; rows with a query's own id are no candidates. A query whose leaves hold fewer than k rows
    besides all those of its own id visits further ones until they do, so fewer than k are returned only where there
    are no more candidates. Rows whose id or vector is null, whose vector is zero or holds null or non-finite values,
    or whose length differs from that of the vector with the smallest id, take no part. Repeated rows are candidates
    each; of rows that share a query's id the smallest vector is the query. Empty tables give no rows; other columns
    are not read.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double, recall double, scored double"
    rows = _usable(vectors, id_col, vec_col)
    first = rows.agg(F.min(F.struct("vec_id", F.size("vec").alias("length"))).alias("m"), F.approx_count_distinct(F.xxhash64("vec"), 0.02).alias("n")).first()
    if not first["n"]:
        return spark.createDataFrame([], schema)
    length, distinct = first["m"]["length"], first["n"]
    rows = rows.filter(F.size("vec") == length)
    # equal vectors have equal hashes, and become one row before they are shuffled
    share = F.pmod(F.xxhash64("vec", F.lit(seed)), F.lit(1 << 40)) < int(min(1.0, 1.2 * sample_rows / distinct) * (1 << 40))
    picked = rows.filter(share).groupBy("vec").agg(F.min("vec_id")).orderBy(F.xxhash64("vec", F.lit(seed)), "vec").limit(sample_rows).select("vec").toArrow()  # sample_rows at most
    sample = picked.column(0).combine_chunks().flatten().to_numpy().reshape(-1, length)
    tree = KMeansTree(sample, max(1, min(max_leaves, distinct // leaf_rows, len(sample) // 4 or 1)), branching, seed)

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, block in vector_blocks(batches):
            leaf = tree.assign(block)
            apart = ((block - tree.matrix[np.array(tree.leaves)[leaf]]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(names), _lists(block), pa.array(leaf), pa.array(apart)], names=["vec_id", "vec", "leaf", "apart"])

    placed = materialize(rows.mapInArrow(deal, "vec_id long, vec array<double>, leaf long, apart double"), "ann-leaves")
    held = placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.sum("apart").alias("apart")).collect()  # max_leaves rows
    counts = {r["leaf"]: r["n"] for r in held}
    tree.measure(counts, {r["leaf"]: r["apart"] for r in held})
    asked = _usable(vectors.filter(is_query), id_col, vec_col).filter(F.size("vec") == length).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    asked = asked.join(placed.groupBy("vec_id").agg(F.count(F.lit(1)).alias("own")), "vec_id")  # rows of its own id, wherever they are
    trial = asked.orderBy(F.xxhash64("vec_id", F.lit(seed + 1)), "vec_id").limit(2 * calibration).collect()  # 2 * `calibration` rows
    if not trial:
        return spark.createDataFrame([], schema)
    visits, reach, reached = calibrate(placed, tree, trial, k, recall, calibration)
    shelf, buckets, filled = {}, {}, 0
    for leaf in range(len(tree.leaves)):
        n = counts.get(leaf, 0)
        if not buckets or filled + n > bucket_rows:
            buckets[len(buckets)] = -(-n // bucket_rows) or 1
            filled = 0
        filled += n
        shelf[leaf] = len(buckets) - 1
    total = max(1, sum(counts.values()))

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = dict(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()))
            for names, block in vector_blocks([batch]):
                seen: list[list[tuple[int, list[int]]]] = []
                for i, query in enumerate(block):
                    found: dict[int, list[int]] = {}
                    for leaf in tree.visits(query, visits, counts, k + own[int(names[i])], reach):
                        found.setdefault(shelf[leaf], []).append(leaf)
                    seen.append(list(found.items()))
                share = [sum(counts.get(leaf, 0) for _, leaves in q for leaf in leaves) / total for q in seen]
                shelves = [[{"shelf": s, "leaves": leaves} for s, leaves in q] for q in seen]
                kind = pa.list_(pa.struct([("shelf", pa.int64()), ("leaves", pa.list_(pa.int64()))]))
                yield pa.RecordBatch.from_arrays([pa.array(names), _lists(block), pa.array(share, pa.float64()), pa.array(shelves, kind)], names=["query_id", "vec", "scored", "visited"])

    def meet(queries: pa.Table, found: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if queries.num_rows and found.num_rows:
            asks, block = _matrix(queries, length), _matrix(found, length)
            names, share, ids, leaf = (t.column(c).to_numpy() for t, c in ((queries, "query_id"), (queries, "scored"), (found, "vec_id"), (found, "leaf")))
            visited = queries.column("leaves").to_pylist()
            order = np.argsort(leaf, kind="stable")
            block, ids, leaf = block[order], ids[order], leaf[order]
            # rough scores pick who may be among the k best; those are scored again, component by component
            slack = 1e-12 * np.sqrt((block**2).sum(axis=1).max()) * np.sqrt((asks**2).sum(axis=1)) * length
            for start in range(0, len(names), 512):
                rough = asks[start : start + 512] @ block.T
                for q in range(len(rough)):
                    allowed = np.isin(leaf, visited[start + q]) & (ids != names[start + q])
                    places = np.flatnonzero(allowed)
                    scores = rough[q, places]
                    if len(places) > k:
                        floor = np.partition(scores, len(places) - k)[len(places) - k]
                        places = places[scores >= floor - slack[start + q]]
                    exact = inner_products(asks[start + q : start + q + 1], block[places])[0]
                    chosen = best(exact, ids[places], k)
                    out.append((np.full(len(chosen), names[start + q]), ids[places[chosen]], exact[chosen], np.full(len(chosen), share[start + q])))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)]
        return pa.table(dict(zip(("query_id", "vec_id", "score", "scored"), columns)))

    asks = materialize(asked.mapInArrow(ask, "query_id long, vec array<double>, scored double, visited array<struct<shelf:long,leaves:array<long>>>"), "ann-asks")
    wanted, rows = dealt(asks, placed, shelf, buckets, query_rows)
    group = ["shelf", "bucket", "part"]
    pairs = wanted.groupBy(*group).cogroup(rows.groupBy(*group)).applyInArrow(meet, "query_id long, vec_id long, score double, scored double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", F.lit(reached).alias("recall"), "scored")


def dealt(asks: DataFrame, placed: DataFrame, shelf: dict[int, int], buckets: dict[int, int], query_rows: int) -> tuple[DataFrame, DataFrame]:
    """Queries and rows with the shelf, bucket and part in which they meet, each pair once.

    A shelf's rows are dealt into its buckets and go to all parts; its queries are dealt into parts of about query_rows
    and go to all buckets, so neither side of a group is unbounded.
    """
    spark = asks.sparkSession
    visitors = asks.select(F.explode("visited.shelf").alias("shelf")).groupBy("shelf").agg(F.count(F.lit(1)).alias("n")).collect()  # max_leaves rows at most
    parts = {r["shelf"]: -(-r["n"] // query_rows) for r in visitors}
    places = F.broadcast(spark.createDataFrame([(s, buckets[s], parts.get(s, 0)) for s in buckets], "shelf long, buckets long, parts long"))  # max_leaves rows
    shelves = F.broadcast(spark.createDataFrame(list(shelf.items()), "leaf long, shelf long"))  # max_leaves rows
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    rows = placed.drop("apart").join(shelves, "leaf").join(places.filter("parts > 0"), "shelf").withColumn("bucket", F.pmod(F.xxhash64("vec_id", "vec"), F.col("buckets"))).withColumn("part", upto("parts"))
    wanted = asks.select("query_id", "vec", "scored", F.inline("visited")).join(places, "shelf").withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts"))).withColumn("bucket", upto("buckets"))
    return wanted.drop("buckets", "parts"), rows.drop("buckets", "parts")


def _lists(block: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(block) + 1) * block.shape[1], pa.int32()), pa.array(block.ravel()))


def _matrix(rows: pa.Table, length: int) -> np.ndarray:
    return rows.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def calibrate(placed: DataFrame, tree: KMeansTree, trial: list, k: int, recall: float, calibration: int) -> tuple[int, float, float]:
    """(leaves to visit, reach of the traversal, recall reached on the trial queries beyond the first `calibration`).

    Of a few reaches the one whose least number of leaves that meets the wanted mean recall is smallest. Single queries
    may find fewer than k rows there.
    """
    ids = np.array([r["vec_id"] for r in trial], np.int64)
    queries = np.array([r["vec"] for r in trial], np.float64)
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id")
    exact = placed.select("vec_id", "vec", "leaf").mapInArrow(_exact_leaves(ids, queries, k), "q long, vec_id long, score double, leaf long")
    truth = exact.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).groupBy("q", "leaf").agg(F.count(F.lit(1)).alias("n")).collect()  # k rows for each trial query at most
    leaves = len(tree.leaves)
    chosen = None
    for reach in (0.0, 0.5, 1.0, 2.0):
        turn = np.zeros((len(ids), leaves), int)
        for q, query in enumerate(queries):
            turn[q, tree.visits(query, leaves, reach=reach)] = np.arange(leaves)
        found = np.zeros((len(ids), leaves))
        for r in truth:
            found[r["q"], turn[r["q"], r["leaf"]]] += r["n"]
        wanted = found.sum(axis=1, keepdims=True)
        shares = found.cumsum(axis=1)[wanted[:, 0] > 0] / wanted[wanted[:, 0] > 0]
        if not len(shares):
            return leaves, 0.0, 1.0
        own = shares[:calibration].mean(axis=0)
        visits = int(np.argmax(own >= min(recall, own[-1]))) + 1
        other = shares[calibration:] if len(shares) > calibration else shares
        if chosen is None or visits < chosen[0]:
            chosen = visits, reach, float(other[:, visits - 1].mean())
    return chosen
