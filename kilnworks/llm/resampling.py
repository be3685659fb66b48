"""Importance resampling of documents towards a target corpus, by hashed word runs.

Identical texts are collapsed by grouping the full text. Each distinct text gets its features once; bucket counts are
multiplied by how often the text occurs, weights are joined back by the text's digest, and only then does each document
get noise of its own and compete for the draw.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._bytes import small
from ._common import hottest, join_spread, materialize, release

#: What each byte becomes: A-Z lower case, digits, a-z and bytes beyond ASCII as they are, all else a blank.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
BUCKETS = 10_000
#: Bytes of a text that are cut into words at once.
SLICE = 1 << 20
FEATURES = pa.schema([("digest", pa.binary()), ("copies", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("steps", pa.binary())])
FEATURES_DDL = "digest binary, copies long, n_words long, n_features long, steps binary"
COUNTS = pa.schema([("bucket", pa.int64()), ("n", pa.int64())])
WEIGHTS = pa.schema([("digest", pa.binary()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])
WEIGHTS_DDL = "digest binary, n_words long, n_features long, weight long"


def text_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def word_slices(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in turn, those of a slice at a time; a word is never cut."""
    rest = b""
    for at in range(0, len(text), SLICE):
        piece = rest + text[at : at + SLICE].translate(WORD_BYTES)
        cut = piece.rfind(b" ") + 1 if at + SLICE < len(text) else len(piece)
        if words := piece[:cut].split():
            yield words
        rest = piece[cut:]


def feature_buckets(text: bytes, longest: int = 3) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket of each run of 1 to `longest` consecutive words, in ascending order.

    The checksum of a run goes on from that of the run without its last word, so no run is ever put together.
    """
    n, found = 0, []
    last: list[list[int]] = [[] for _ in range(longest)]  # by length, the checksum of the run that ended the last slice
    for words in word_slices(text):
        n += len(words)
        blank = [b" " + w for w in words]
        sums = list(map(crc32, words))
        for k in range(longest):
            found.append((np.array(sums, np.uint32) % BUCKETS).astype(np.uint16))
            before = last[k] + sums[:-1]
            last[k] = sums[-1:]
            sums = list(map(crc32, blank[len(blank) - len(before) :], before))
    return n, np.sort(np.concatenate(found)) if found else np.zeros(0, np.uint16)


def text_features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """digest, copies, n_words, n_features and steps of each distinct text: steps holds the differences of its sorted buckets as 16-bit integers."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 256):
            made = [feature_buckets(t.as_buffer().to_pybytes()) for t in batch.column(0)]
            steps = [np.diff(b, prepend=np.uint16(0)).astype("<u2").tobytes() for _, b in made]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array([n for n, _ in made], pa.int64()), pa.array([len(b) for _, b in made], pa.int64()), pa.array(steps, pa.binary())], schema=FEATURES)

    texts = docs.select(docs[text_col].cast("string").alias("text")).filter("text is not null").groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    return texts.select(F.col("text").cast("binary"), text_digest(F.col("text")), "copies").mapInArrow(run, FEATURES_DDL)


def _buckets(steps: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(steps, "<u2"), dtype=np.int64)


def bucket_counts(features: DataFrame, adders: int = 16) -> np.ndarray:
    """How many features of all rows, copies counted, fall into each bucket.

    A task gives all its counts as one row, `adders` tasks add such rows up, and one row for each bucket reaches the driver.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in small(batches, 256):
            copies = batch.column(0).to_numpy()
            for n in np.unique(copies).tolist():
                same = batch.column(1).filter(pa.array(copies == n))
                total += n * np.bincount(np.concatenate([_buckets(x.as_buffer()) for x in same]), minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.frombuffer(x.as_buffer(), np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], schema=COUNTS)

    found = np.zeros(BUCKETS, object)
    parts = features.select("copies", "steps").mapInArrow(count, "counts binary").repartition(adders)
    for bucket, n in parts.mapInArrow(add, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        found[bucket] = n
    return found


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in the target over that in the source."""
    s, t = int(sum(source)), int(sum(target))
    return np.array([math.floor(1000 * math.log((int(b) + 1) * (s + BUCKETS) / ((int(a) + 1) * (t + BUCKETS)))) for a, b in zip(source, target)], np.int64)


def text_weights(features: DataFrame, gains: np.ndarray) -> DataFrame:
    """The sum of gains over each distinct text's features."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 1024):
            weights = [int(gains[_buckets(x.as_buffer())].sum()) for x in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weights, pa.int64())], schema=WEIGHTS)

    return features.select("digest", "n_words", "n_features", "steps").mapInArrow(run, WEIGHTS_DDL)


def noise(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)), u drawn from the digest of seed and id; a null id counts as an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def first_places(rows: DataFrame, order: list[Column]) -> DataFrame:
    """`place`, from 1, of each row in this order: a range-partitioned sort, then offsets from the partitions' sizes."""
    placed = materialize(rows.orderBy(*order).withColumn("place", F.monotonically_increasing_id()), "resampling-places")
    offset, ends = 0, []
    for part, n in sorted(placed.groupBy(F.shiftright("place", 33).alias("part")).count().collect()):
        ends.append((part, offset))
        offset += n
    offsets = F.broadcast(rows.sparkSession.createDataFrame(ends, "part long, before long"))  # a row for each partition
    return placed.join(offsets, F.shiftright("place", 33) == F.col("part")).withColumn("place", F.col("place").bitwiseAND((1 << 33) - 1) + F.col("before") + 1).drop("part", "before")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank and n_words of every row of docs; rank is null where it is not drawn.

    weight is the sum of a text's gains towards the target; score adds noise of the row's own. Of the rows with at least
    min_words words the best `percent` in a hundred are drawn, in order of score, then of the smaller id.

    A null text has no features and weight 0, as an empty one. Rows count one by one: repeated rows raise the counts and
    are ranked each; null ids come last among equal scores. An empty target or an empty table is allowed; other columns
    are not read. A long text is cut into words slice by slice.

    Full texts are shuffled once, with copies summed before; features are kept on disk as sorted buckets. Ids meet
    weights by the SHA-256 of their texts, the most frequent texts in parts.
    """
    features = materialize(text_features(docs, text_col), "resampling-features")
    gains = bucket_gains(bucket_counts(features), bucket_counts(text_features(target, text_col)))
    weights = text_weights(features, gains)
    ids = docs.select(docs[id_col].alias("doc_id"), text_digest(docs[text_col].cast("string")).alias("digest"))
    hot = hottest(features.select("digest", "copies"), ["digest"], "copies")
    joined = join_spread(ids, weights, ["digest"], "doc_id", hot, how="left").fillna(0, ["n_words", "n_features", "weight"])
    scored = materialize(joined.select("doc_id", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"), "n_words"), "resampling-scores")
    release(features)

    able = scored.filter(F.col("n_words") >= min_words)
    drawn = able.count() * percent // 100
    # Only rows above an estimated score are sorted; if the estimate leaves too few, all are.
    bound = able.agg(F.percentile_approx("score", F.lit(max(0.0, 0.99 - percent / 100)), F.lit(10_000))).first()[0] if drawn else None
    if bound is not None and able.filter(F.col("score") >= bound).count() < drawn:
        bound = able.agg(F.min("score")).first()[0]
    if bound is None:
        return scored.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"), "n_words")
    above = (F.col("n_words") >= min_words) & (F.col("score") >= bound)
    placed = first_places(scored.filter(above), [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("n_words")])
    ranked = placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("place") <= drawn, F.col("place")).alias("rank"), "n_words")
    return ranked.unionByName(scored.filter(~above).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"), "n_words"))


def drawn_documents(docs: DataFrame, ranked: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs whose id resample() has drawn; rows that share a drawn id all come, those with a null id never."""
    ids = ranked.filter("rank is not null").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(ids, id_col, "left_semi")
