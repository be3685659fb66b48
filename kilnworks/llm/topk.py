"""Exact top-k search by distributed histogram selection."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize, scratch_path

#: Each level's bins are this many scores wide, as a power of two; a later level looks only into the bin of the kth value.
SHIFTS = (12, 6, 0)
HITS = pa.schema([("query", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])
BINS = pa.schema([("query", pa.int32()), ("bin", pa.int64()), ("n", pa.int64())])


def vector_blocks(batches: Iterable[pa.RecordBatch], rows: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors as doubles) in blocks of one length; rows that are null or hold null or non-finite values are left out."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            ids, lists = part.column(0), part.column(1)
            keep = np.asarray(ids.is_valid()) & np.asarray(lists.is_valid())
            if not keep.all():
                ids, lists = ids.filter(pa.array(keep)), lists.filter(pa.array(keep))
            if not len(ids):
                continue
            values = lists.flatten()
            flat = values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls come as NaN
            lengths = np.asarray(lists.value_lengths())
            starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
            names = ids.to_numpy(zero_copy_only=False).astype(np.int64)
            for length in np.unique(lengths):
                own = np.flatnonzero(lengths == length)
                block = flat[starts[own][:, None] + np.arange(length)]
                good = np.isfinite(block).all(axis=1)
                if good.any():
                    yield names[own][good], block[good]


def integer_scores(queries: np.ndarray, vectors: np.ndarray, scale: int) -> np.ndarray:
    """Integer inner products of floor(scale * x); exact, or OverflowError where a score might not fit in 64 bits."""
    a, b = np.floor(scale * queries), np.floor(scale * vectors)
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if bound < 2**53:
        return (a @ b.T).astype(np.int64)
    if bound >= 2**63:
        raise OverflowError("vectors too long: their scores may not fit in 64 bits")
    return a.astype(np.int64) @ b.astype(np.int64).T


class Scorer:
    """The passes over the candidates for one block of queries; sent to the tasks."""

    def __init__(self, ids: np.ndarray, vectors: list[np.ndarray], k: int, scale: int) -> None:
        self.k, self.scale = k, scale
        lengths = np.array([len(v) for v in vectors])
        self.groups = [(np.flatnonzero(lengths == n), np.stack([vectors[i] for i in np.flatnonzero(lengths == n)])) for n in np.unique(lengths)]
        self.ids = ids
        #: of each query: the bin that holds its kth score so far, and how many of the k are in that bin; need -1: all rows are taken
        self.bin = np.zeros(len(ids), np.int64)
        self.need = np.full(len(ids), k, np.int64)
        self.level = 0

    def scored(self, batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query numbers, candidate ids, scores); a query's own rows score the least value there is."""
        for ids, vectors in vector_blocks(batches):
            for numbers, queries in self.groups:
                if queries.shape[1] == vectors.shape[1]:
                    for at in range(0, len(numbers), 4096):  # 4096 by 1024 scores at a time
                        yield numbers[at : at + 4096], ids, integer_scores(queries[at : at + 4096], vectors, self.scale)

    def histogram(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of the bins that can hold a query's kth score: with `need` scores of its own above a bin, a block leaves that bin out."""
        shift = SHIFTS[self.level]
        for numbers, ids, scores in self.scored(batches):
            bins = scores >> shift
            valid = ids[None, :] != self.ids[numbers][:, None]
            if self.level:
                valid &= (scores >> SHIFTS[self.level - 1]) == self.bin[numbers][:, None]
            valid &= (self.need[numbers] > 0)[:, None]
            low = np.iinfo(np.int64).min
            bins = np.where(valid, bins, low)
            need = min(self.k, bins.shape[1])
            floor = np.partition(bins, bins.shape[1] - need, axis=1)[:, bins.shape[1] - need]
            rows, columns = np.nonzero(valid & (bins >= floor[:, None]))
            if len(rows):
                pairs, counts = np.unique(np.stack([numbers[rows], bins[rows, columns]], 1), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], pa.int32()), pa.array(pairs[:, 1]), pa.array(counts, pa.int64())], schema=BINS)

    def hits(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs above a query's kth score, and of those at it the `need` smallest ids of each block."""
        for numbers, ids, scores in self.scored(batches):
            order = np.argsort(ids, kind="stable")
            ids, scores = ids[order], scores[:, order]
            need = self.need[numbers][:, None]
            valid = ids[None, :] != self.ids[numbers][:, None]
            above = valid & ((scores > self.bin[numbers][:, None]) | (need < 0))
            ties = valid & (scores == self.bin[numbers][:, None]) & (need > 0)
            ties &= np.cumsum(ties, axis=1) <= need
            rows, columns = np.nonzero(above | ties)
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array(numbers[rows], pa.int32()), pa.array(ids[columns]), pa.array(scores[rows, columns])], schema=HITS)


def _locate(counts: DataFrame, need: DataFrame) -> DataFrame:
    """query, bin, left: the bin where the counts from above reach what is needed, and how many of those are in it."""
    down = Window.partitionBy("query").orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, -1)
    summed = counts.groupBy("query", "bin").agg(F.sum("n").alias("n")).withColumn("above", F.coalesce(F.sum("n").over(down), F.lit(0)))
    return summed.join(F.broadcast(need), "query").filter("above < need and above + n >= need").select("query", "bin", (F.col("need") - F.col("above")).alias("left"))


def exact_top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, scale: int = 256, block_values: int = 1 << 22, at_once: int = 2) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products of floor(scale * x).

    Histogram selection, for blocks of queries (block_values numbers each, 8 bytes a number, so a broadcast of proven
    size; at_once of them at a time): every pass scores all candidates in their own tasks; three levels of histograms,
    summed over all tasks, narrow the kth score of every query from bins 4096 wide to its very value; the last pass
    keeps pairs above it, and of those at it the smallest ids, as many as are wanted, and writes them. No pass moves
    vectors, and a task sends at most k bins or ties a query and block of 1024 rows, whatever the number of equal
    vectors.

    Ties go to smaller ids; rows with the query's own id are no candidates; fewer than k candidates are all returned.
    Rows whose id or vector is null, or whose vector holds null or non-finite values, take no part. Vectors are scored
    with those of their own length. Repeated rows are candidates each; of rows that share a query's id the smallest
    vector is the query. Scores that may not fit in 64 bits raise OverflowError. Empty tables give no rows; other
    columns are not read.
    """
    spark = vectors.sparkSession
    base = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vec_col].cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    asked = vectors.filter(is_query).select(vectors[id_col].cast("long").alias("vec_id"), vectors[vec_col].cast("array<double>").alias("vec")).filter("vec_id is not null and vec is not null").filter(finite).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    asked = materialize(asked, "topk-queries")
    size = asked.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    blocks = -(-size[0] * max(1, size[1] or 1) // block_values)
    with ThreadPoolExecutor(at_once) as pool:
        paths = list(pool.map(lambda b: _block_hits(base, asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b), k, scale), range(blocks)))
    paths = [p for p in paths if p]
    if not paths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    hits = spark.read.schema("query_id long, vec_id long, score long").parquet(*paths)
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _block_hits(base: DataFrame, asked: DataFrame, k: int, scale: int) -> str | None:
    """Where the hits of one block of queries are written: query_id, vec_id and score."""
    spark = base.sparkSession
    block = asked.orderBy("vec_id").toArrow()  # about block_values numbers
    if not block.num_rows:
        return None
    ids = block.column(0).to_numpy()
    scorer = Scorer(ids, [np.asarray(v.values, np.float64) for v in block.column(1)], k, scale)
    for level in range(len(SHIFTS)):
        scorer.level = level
        need = spark.createDataFrame(pa.table({"query": pa.array(np.arange(len(ids)), pa.int32()), "need": pa.array(scorer.need, pa.int64())}))
        found = _locate(base.mapInArrow(scorer.histogram, "query int, bin long, n long"), need).toArrow()  # a row for each query of the block
        at = found.column("query").to_numpy()
        left = np.full(len(ids), -1, np.int64)  # fewer than k candidates
        left[at] = found.column("left").to_numpy()
        scorer.bin[at], scorer.need = found.column("bin").to_numpy(), left
    numbers = F.broadcast(spark.createDataFrame(pa.table({"query": pa.array(np.arange(len(ids)), pa.int32()), "query_id": pa.array(ids)})))
    path = scratch_path(spark, "topk-hits")
    base.mapInArrow(scorer.hits, "query int, vec_id long, score long").join(numbers, "query").select("query_id", "vec_id", "score").write.parquet(path)
    return path
