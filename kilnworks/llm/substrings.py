"""Substring deduplication by content-defined chunking with a gear rolling hash."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._bytes import U, span_hashes, text_slices
from ._common import hottest, join_spread, materialize

#: The gear hash looks back over this many bytes; its 16 bits decide.
WINDOW = 16
GEAR = np.random.Generator(np.random.PCG64(15485863)).integers(0, 1 << 32, 256, dtype=np.uint32)
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: Fields of a chunk's place: start, then its length, its words and whether the document has had the same chunk before.
LENGTH_BITS, WORD_BITS = 13, 13
MOST = (1 << LENGTH_BITS) - 1
LEAST = 12


def gear_hashes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of each byte: the sum of gear[b] << age over the last WINDOW bytes of its own row, by doubling the window."""
    rows = len(offsets) - 1
    place = np.arange(len(data)) + np.repeat(np.arange(1, rows + 1), np.diff(offsets)) * WINDOW  # a gap before each row
    h = np.zeros(len(data) + (rows + 1) * WINDOW, np.uint32)
    h[place] = GEAR[data]
    width = 1
    while width < WINDOW:
        h[width:] += h[:-width] << np.uint32(width)
        width *= 2
    return h[place]


def low_bits(data: np.ndarray, offsets: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """The lowest 16 bits of gear_hashes(); those of one long row are made block by block, each with the bytes before it."""
    if len(offsets) > 2 or len(data) <= block:
        return gear_hashes(data, offsets).astype(np.uint16) if len(data) else np.zeros(0, np.uint16)
    parts = []
    for at in range(0, len(data), block):
        back = min(at, WINDOW - 1)
        part = data[at - back : at + block]
        parts.append(gear_hashes(part, np.array([0, len(part)]))[back:].astype(np.uint16))
    return np.concatenate(parts)


def chunk_spans(data: np.ndarray, offsets: np.ndarray, average: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, stops, rows) of the chunks: a chunk ends where the hash falls below a threshold, at its row's end, and after MOST bytes.

    A place within LEAST bytes of such a place before it ends none, whether that one does or not: this too depends on
    the bytes just before alone, and leaves no chunks of a syllable, which repeat everywhere.
    """
    ends = np.flatnonzero(low_bits(data, offsets) < 65536 // average) + 1
    row = np.searchsorted(offsets, ends - 1, "right")
    ends = ends[(np.diff(ends, prepend=-LEAST) >= LEAST) | (np.diff(row, prepend=-1) > 0)]
    ends = np.unique(np.concatenate([ends, offsets[1:][np.diff(offsets) > 0]])).astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
    long = np.flatnonzero(ends - starts > MOST)
    if len(long):
        more = np.concatenate([np.arange(starts[i] + MOST, ends[i], MOST) for i in long])
        ends = np.union1d(ends, more)
        starts = np.concatenate([[0], ends[:-1]])
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def _chunks(average: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for first, data, offsets in text_slices(batch.column(2)):
                starts, stops, rows = chunk_spans(data, offsets, average)
                if not len(starts):
                    continue
                digests = span_hashes(data, starts, stops)
                begins = ~BLANK[data]
                begins[1:] &= BLANK[data[:-1]]
                heads = offsets[:-1][np.diff(offsets) > 0]
                begins[heads] = ~BLANK[data[heads]]
                begins = np.flatnonzero(begins)
                words = np.searchsorted(begins, stops) - np.searchsorted(begins, starts)
                order = np.lexsort((starts, digests, rows))
                again = np.zeros(len(starts), np.int64)
                again[order[1:]] = (digests[order[1:]] == digests[order[:-1]]) & (rows[order[1:]] == rows[order[:-1]])
                place = ((starts - offsets[rows]) << (LENGTH_BITS + WORD_BITS + 1)) | (stops - starts) << (WORD_BITS + 1) | np.minimum(words, (1 << WORD_BITS) - 1) << 1 | again
                yield pa.RecordBatch.from_arrays([pa.array(names[first + rows]), pa.array(texts[first + rows]), pa.array(digests.view(np.int64)), pa.array(place)], names=["doc_id", "version", "digest", "place"])

    return run


def version_of(text: Column) -> Column:
    """Tells texts of one id apart: 64 bits."""
    return F.xxhash64(text, F.octet_length(text))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", average: int = 16, min_words: int = 12) -> DataFrame:
    """doc_id, version, n_spans, dup_words, dup_bytes and spans of every document with passages that stand elsewhere before.

    Texts are cut into chunks where a gear rolling hash of the last 16 bytes is small, so equal passages fall into equal
    chunks whatever stands around them and however far they are shifted. Of a chunk's digest the smallest id that has it
    keeps it, by a map-side aggregate: a passage that a third of the rows share is one row for each task. The digests
    with the most chunks are dealt into parts when chunks meet their keepers (join_spread). The other documents' chunks
    of a digest, and a document's own repeats, are repeats; runs of repeats that follow each other
    and have min_words words or more make a span: start and length in bytes of the UTF-8 text, words, and first_ids, the
    ids of the documents that keep its chunks. Up to two chunks at a passage's ends stay out of its span, so passages of
    50 words are found at a threshold of 12. A digest is a 64-bit hash that is not checked against the bytes: a wrong
    span takes a collision in each of its chunks, several in a row.

    A null text has no chunks. Rows with a null id neither keep nor lose anything. Rows that share an id keep the same
    chunks; their spans are told apart by version, a hash of the text, and rows with equal ids and texts give one row.
    Clean documents give no row. Other columns are not read; empty tables give no rows.
    """
    text = docs[text_col].cast("string")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), version_of(text).alias("version"), text.alias("text")).filter("doc_id is not null and text is not null")
    # made twice rather than kept: the chunks of a text take more room than the text
    chunks = rows.mapInArrow(_chunks(average), "doc_id long, version long, digest long, place long")
    kept = chunks.filter("place & 1 = 0").groupBy("digest").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n")).filter("keeper <> last").select("digest", "keeper", "n")
    kept = materialize(kept, "chunk-keepers")
    other = join_spread(chunks.filter("place & 1 = 0"), kept.drop("n"), ["digest"], "doc_id", hottest(kept, ["digest"])).filter("doc_id <> keeper").select("doc_id", "version", "place", "keeper")
    repeats = other.unionByName(chunks.filter("place & 1 = 1").select("doc_id", "version", "place", F.col("doc_id").alias("keeper"))).distinct()
    repeats = repeats.select("doc_id", "version", "keeper", F.expr(f"place >> {LENGTH_BITS + WORD_BITS + 1}").alias("start"), F.expr(f"(place >> {WORD_BITS + 1}) & {MOST}").alias("length"), F.expr(f"(place >> 1) & {(1 << WORD_BITS) - 1}").alias("words"))
    order = Window.partitionBy("doc_id", "version").orderBy("start")
    repeats = repeats.withColumn("new", F.when(F.col("start") == F.lag(F.col("start") + F.col("length")).over(order), 0).otherwise(1))
    repeats = repeats.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = repeats.groupBy("doc_id", "version", "run").agg(F.min("start").alias("start"), F.sum("length").alias("length"), F.sum("words").alias("words"), F.array_sort(F.collect_set("keeper")).alias("first_ids")).filter(F.col("words") >= min_words)
    spans = F.sort_array(F.collect_list(F.struct("start", "length", "words", "first_ids"))).alias("spans")
    return runs.groupBy("doc_id", "version").agg(F.count(F.lit(1)).alias("n_spans"), F.sum("words").alias("dup_words"), F.sum("length").alias("dup_bytes"), spans)


def cut_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with the spans of repeated_spans() cut from their texts; other columns and rows stay as they are."""
    text = docs[text_col].cast("string")
    keyed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"), docs[id_col].cast("long").alias("_id"), version_of(text).alias("_version"))
    joined = keyed.join(spans.select(F.col("doc_id").alias("_id"), F.col("version").alias("_version"), F.col("spans").alias("_spans")), ["_id", "_version"], "left")
    joined = joined.withColumn("_bytes", F.col("_row").getField(text_col).cast("string").cast("binary"))
    # what stands between the spans: from the end of one to the start of the next
    cut = F.expr("""concat_ws('', transform(sequence(0, size(_spans)), i -> cast(substring(_bytes,
        cast(if(i = 0, 0, _spans[greatest(i - 1, 0)].start + _spans[greatest(i - 1, 0)].length) + 1 as int),
        cast(if(i = size(_spans), length(_bytes), _spans[least(i, size(_spans) - 1)].start) - if(i = 0, 0, _spans[greatest(i - 1, 0)].start + _spans[greatest(i - 1, 0)].length) as int)) as string)))""")
    return joined.select(*[F.when(F.col("_spans").isNotNull(), cut).otherwise(F.col("_row").getField(c)).alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in docs.columns])
