"""Text operators: n-grams, weights, centroids, retrieval, routing and graphs of dependencies."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from kilnworks.sources.files import scratch_dir


def char_ngrams(text: Column, n: int) -> Column:
    """All runs of n characters, none for shorter texts: what a look ahead captures at every place, so long texts cost in proportion.

    The second look ahead leaves out places inside a character of two UTF-16 units.
    """
    found = F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{n}}}))(?![\x{{DC00}}-\x{{DFFF}}])"), 1)
    return F.coalesce(found, F.array().cast("array<string>"))


def row_counts(docs: DataFrame, terms: Column, keep: Sequence[str], batch_rows: int = 256) -> DataFrame:
    """keep, most, term, tf: each row's terms with their numbers, counted inside the row: nothing is shuffled, and rows that share an id stay apart.

    most is the row's greatest number; rows without terms give none. Batches of rows are counted by sorting codes of
    their terms, in Arrow and numpy.
    """

    def coded(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        found = lists.flatten().dictionary_encode()
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        code = found.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        return code[code >= 0], np.repeat(np.arange(len(lengths)), lengths)[code >= 0], found.dictionary

    return _counted(docs.select(*keep, terms.alias("_terms")), coded, batch_rows)


def word_counts(docs: DataFrame, text: Column, keep: Sequence[str], batch_rows: int = 256) -> DataFrame:
    """row_counts() of a text's words: runs of the letters A-Z and a-z, in lower case. They are found in the text's bytes."""
    return _counted(docs.select(*keep, text.alias("_terms")), _letter_words, batch_rows)


#: A byte's letter in lower case, 0 for all others.
LETTERS = np.array([ord(chr(b).lower()) if chr(b).isascii() and chr(b).isalpha() else 0 for b in range(256)], np.uint8)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where texts end, after a zero, and their bytes; nulls are empty."""
    texts = pc.fill_null(texts, "")
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    return ends - ends[0], np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]


def _letter_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    ends, data = _bytes(texts)
    low = LETTERS[data]
    letter = low > 0
    begin = letter.copy()
    begin[1:] &= ~letter[:-1]
    first = ends[:-1][ends[:-1] < len(low)]
    begin[first] = letter[first]  # a word ends with its text
    starts = np.flatnonzero(begin)
    at = np.append(np.cumsum(letter)[starts] - 1, letter.sum()).astype(np.int32)
    found = pa.StringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(low[letter])).dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), np.searchsorted(ends, starts, "right") - 1, found.dictionary


def _counted(rows: DataFrame, coded: Callable[[pa.Array], tuple[np.ndarray, np.ndarray, pa.Array]], batch_rows: int) -> DataFrame:
    """rows, its last column replaced by most, term and tf. coded gives the code and the row of each term of a batch, by rows, and the terms."""
    schema = StructType([*rows.schema.fields[:-1], StructField("most", LongType()), StructField("term", StringType()), StructField("tf", LongType())])
    names = [f.name for f in schema]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, batch_rows):
                batch = whole.slice(at, batch_rows)
                code, row, terms = coded(batch.column(batch.num_columns - 1))
                size = max(1, len(terms))
                keys, tf = np.unique(row * size + code, return_counts=True)
                of = keys // size
                first = np.flatnonzero(np.diff(of, prepend=-1))
                most = np.repeat(np.maximum.reduceat(tf, first) if len(first) else tf, np.diff(np.append(first, len(of))))
                kept = [c.take(pa.array(of)) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(most.astype(np.int64)), terms.take(pa.array(keys - of * size)).cast(pa.string()), pa.array(tf.astype(np.int64))], names=names)

    return rows.mapInArrow(run, schema)


#: Terms that meet their document frequency by a broadcast, the most frequent ones: what the others have in one key is less than any of these.
HOT_TERMS = 50_000


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_terms(counts: DataFrame, terms: DataFrame, by: str) -> DataFrame:
    """counts with the columns of a written table of terms: the HOT_TERMS terms with the largest `by` are broadcast, the others shuffled."""
    if terms.limit(HOT_TERMS + 1).count() <= HOT_TERMS:
        return counts.join(F.broadcast(terms), "term")
    hot = F.broadcast(terms.orderBy(F.desc(by), "term").limit(HOT_TERMS))  # HOT_TERMS rows
    return counts.join(hot, "term").unionByName(counts.join(hot.select("term"), "term", "left_anti").join(terms, "term"))


def tf_idf(counts: DataFrame, docs: int) -> DataFrame:
    """id, term, weight of counts (id, most, term, tf): augmented frequency by smooth inverse document frequency. Document frequencies come from a map-side aggregate; rows are documents."""
    df = written(counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "frequencies")
    return join_terms(counts, df, "df").select("id", "term", ((0.5 + 0.5 * F.col("tf") / F.col("most")) * (F.ln((F.lit(1.0) + docs) / (1 + F.col("df"))) + 1)).alias("weight"))


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all cores where it lies in fewer splits, as small files do; larger ones stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ngram_counts(docs: DataFrame, text: Column, sizes: Sequence[int]) -> DataFrame:
    """n, gram, times, docs: runs of n characters of all rows, how often they stand and in how many rows. Each row is taken apart by itself and counted map-side."""
    grams = F.array(*[F.struct(F.lit(n).cast("long").alias("n"), char_ngrams(text, n).alias("grams")) for n in sizes])
    each = spread(docs).select(F.inline(grams))
    once = lambda g, times, rows: each.select("n", F.explode(g).alias("gram"), F.lit(times).cast("long").alias("times"), F.lit(rows).cast("long").alias("docs"))
    both = once(F.col("grams"), 1, 0).unionByName(once(F.array_distinct("grams"), 0, 1))
    return both.groupBy("n", "gram").agg(F.sum("times").alias("times"), F.sum("docs").alias("docs"))


#: Labelled rows that meet the texts by a broadcast; more are shuffled with them.
LABELLED = 500_000


def with_labels(docs: DataFrame, labels: DataFrame, on: str, how: str = "left") -> DataFrame:
    """docs with the columns of a table of labels, one row for each id."""
    return docs.join(F.broadcast(labels) if labels.limit(LABELLED + 1).count() <= LABELLED else labels, on, how)


def centroid_scores(counts: DataFrame, docs: int) -> DataFrame:
    """id, label, score of counts (id, label, most, term, tf): each document's cosine with the centroids of the labels it shares a term with.

    Weights are those of tf_idf(), a centroid is the mean of its label's documents; documents without a label are scored
    as well. The counts are written once. One aggregate by term gives document frequencies and, as a term's idf is the
    same in all rows, the centroids; labels are few: they are its columns. Products and lengths are summed up by id.
    """
    counts = written(counts, "counts")
    often = 0.5 + 0.5 * F.col("tf") / F.col("most")
    names = [r["label"] for r in counts.select("label").filter("label is not null").distinct().orderBy("label").collect()]
    sums = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), *[F.sum(F.when(F.col("label") == name, often)).alias(f"_c{i}") for i, name in enumerate(names)])
    idf = F.ln((F.lit(1.0) + docs) / (1 + F.col("df"))) + 1
    terms = written(sums.select("term", "df", idf.alias("_idf"), *[(F.col(f"_c{i}") * idf).alias(f"_c{i}") for i in range(len(names))]), "centroids")
    lengths = terms.agg(F.count(F.lit(1)), *[F.sqrt(F.sum(F.col(f"_c{i}") * F.col(f"_c{i}"))) for i in range(len(names))]).first()[1:]
    weight = often * F.col("_idf")
    hit = join_terms(counts.select("id", "most", "term", "tf").filter("id is not null"), terms, "df").groupBy("id")
    found = hit.agg(F.sqrt(F.sum(weight * weight)).alias("_length"), *[F.sum(weight * F.col(f"_c{i}")).alias(f"_x{i}") for i in range(len(names))])
    kind = counts.schema["label"].dataType
    each = [F.struct(F.lit(name).cast(kind).alias("label"), (F.col(f"_x{i}") / (F.lit(length) * F.col("_length"))).alias("score")) for i, (name, length) in enumerate(zip(names, lengths))]
    return found.select("id", F.inline(F.array(*each) if each else F.array().cast(ArrayType(StructType([StructField("label", kind), StructField("score", DoubleType())]))))).filter("score is not null")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def with_prototypes(vectors: DataFrame, prototypes: DataFrame, most: int = 100_000) -> DataFrame:
    """Every vector (vec_id, q) with every prototype (pid, label, p): a stated set of at most `most` rows, which is counted, against all rows."""
    if prototypes.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} prototypes")
    one = F.lit(1)
    packed = prototypes.groupBy().agg(F.collect_list(F.struct("pid", "label", "p")).alias("_all")).withColumn("_one", one)
    return vectors.withColumn("_one", one).join(F.broadcast(packed), "_one").select("vec_id", "q", F.inline("_all"))


def prototype_scores(vectors: DataFrame, prototypes: DataFrame) -> DataFrame:
    """vec_id, label, score: the best cosine with each label's prototypes other than the vector itself."""
    pairs = with_prototypes(vectors, prototypes).filter("vec_id <> pid")
    cosine_of = dot(F.col("q"), F.col("p")) / F.nullif(norm(F.col("q")) * norm(F.col("p")), F.lit(0.0))
    return pairs.select("vec_id", "label", cosine_of.alias("score")).groupBy("vec_id", "label").agg(F.max("score").alias("score"))


def softmax_gate(scores: DataFrame, key: str, label: str = "label", score: str = "score", probability: float = 0.5, margin: float = 0.1) -> DataFrame:
    """key, label, probability, margin, accepted of each key's best label."""
    sums = scores.groupBy(key).agg(F.max(F.struct(F.col(score).alias("s"), F.col(label).alias("l"))).alias("best"), F.sum(F.exp(score)).alias("z"), F.sort_array(F.collect_list(score), asc=False).alias("two"))  # a score for each label
    p = F.exp(F.col("best.s")) / F.col("z")
    second = F.coalesce(F.exp(F.try_element_at("two", F.lit(2))) / F.col("z"), F.lit(0.0))
    return sums.select(key, F.col("best.l").alias("label"), p.alias("probability"), (p - second).alias("margin"), ((p >= probability) & (p - second >= margin)).alias("accepted"))


#: Grams that a router's vocabulary holds at most: the bound of what is broadcast.
VOCABULARY = 20_000


#: Rows and bytes of texts whose grams are counted at a time; a longer text is counted by itself.
BLOCK_ROWS, BLOCK_BYTES = 1024, 1 << 21
#: Bytes that are white space.
WHITE = np.isin(np.arange(256), list(b" \t\n\x0b\f\r"))


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of batches by the texts in their last column."""
    for batch in batches:
        size, at = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
        while at < batch.num_rows:
            end = np.searchsorted(size, (size[at - 1] if at else 0) + BLOCK_BYTES, "right")
            end = int(max(at + 1, min(at + BLOCK_ROWS, end)))
            yield batch.slice(at, end - at)
            at = end


def _points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The characters of texts and the text of each; runs of white space are one blank, and none stand at the ends."""
    ends, data = _bytes(texts)
    full = np.flatnonzero(~WHITE[data])
    row = np.repeat(np.arange(len(texts)), np.diff(ends))[full]
    gap = np.zeros(len(full), bool)
    gap[1:] = (np.diff(full) > 1) & (np.diff(row) == 0)
    at = np.arange(len(full)) + np.cumsum(gap)
    out, of = np.full(len(full) + gap.sum(), 32, np.uint8), np.empty(len(full) + gap.sum(), np.int64)
    out[at], of[at] = data[full], row
    of[at[gap] - 1] = row[gap]
    return np.frombuffer(out.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64), of[(out & 0xC0) != 0x80]


def _router_grams(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """n, row, code, tf and terms of the runs of n = 2, 3 and 4 characters of texts: a row and a code once each, with how often. terms are by code."""
    one, row = _points(texts)

    def dense(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = pa.array(keys).dictionary_encode()
        return found.indices.to_numpy().astype(np.int64), found.dictionary.to_numpy()

    def counted(n: int, rows: np.ndarray, codes: np.ndarray, letters: np.ndarray):
        keys = np.sort(rows * max(1, len(letters)) + codes)
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        of, whole = keys[first] // max(1, len(letters)), letters.astype("<u4").tobytes().decode("utf-32-le")
        return n, of, keys[first] - of * len(letters), np.diff(np.append(first, len(keys))), pa.array([whole[i : i + n] for i in range(0, len(whole), n)], pa.string())

    two, keys = dense(one[:-1] << 21 | one[1:])
    pairs = np.stack([keys >> 21, keys & (1 << 21) - 1], 1)
    inside = row[1:] == row[:-1]  # not from a text into the next
    yield counted(2, row[1:][inside], two[inside], pairs)
    inside = row[2:] == row[:-2]
    three, keys = dense((two[:-1] << 21 | one[2:])[inside])
    yield counted(3, row[2:][inside], three, np.concatenate([pairs[keys >> 21], (keys & (1 << 21) - 1)[:, None]], 1))
    inside = row[3:] == row[:-3]
    four, keys = dense((two[:-2] << 31 | two[2:])[inside])
    yield counted(4, row[3:][inside], four, np.concatenate([pairs[keys >> 31], pairs[keys & (1 << 31) - 1]], 1))


def fit_router(docs: DataFrame, text: str, label: str, least: int = 3, vocabulary: int = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """A sparse linear scorer, learnt by one aggregate over labelled rows: (term, idf, weights) and (label, place, intercept).

    The vocabulary holds the grams of the most rows, `least` at least and `vocabulary` at most. weights has for each label,
    in order, the logarithm of the gram's smoothed share of the label's grams; the intercept is that of the label's share
    of rows. Labels are few: they are columns of one aggregate. A block of texts gives a row for each different gram.
    """
    rows = docs.filter(F.col(label).isNotNull()).select(F.col(label).alias("label"), F.lower(text).alias("text"))
    classes = [(r["label"], r["n"]) for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy("label").collect()]
    total = sum(n for _, n in classes)
    sums = ["df", *[f"_c{i}" for i in range(len(classes))]]

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            place = block.column(0).to_numpy()
            for _, row, code, tf, terms in _router_grams(block.column(1)):
                df = np.bincount(code, minlength=len(terms))
                by = [np.bincount(code, np.where(place[row] == i, tf, 0), len(terms)).astype(np.int64) for i in range(len(sums) - 1)]
                table = pa.RecordBatch.from_arrays([terms, *[pa.array(x) for x in (df, *by)]], names=["term", *sums])
                yield table.filter(pa.array(df > 0))

    place = F.coalesce(*[F.when(F.col("label") == name, i) for i, (name, _) in enumerate(classes)], F.lit(-1)).cast("long")
    grams = rows.select(place.alias("place"), "text").mapInArrow(count, StructType([StructField("term", StringType()), *[StructField(c, LongType()) for c in sums]]))
    terms = grams.groupBy("term").agg(*[F.sum(c).alias(c) for c in sums])
    kept = written(terms.filter(F.col("df") >= least).orderBy(F.desc("df"), "term").limit(vocabulary), "vocabulary")
    of = kept.agg(F.count(F.lit(1)), *[F.sum(c) for c in sums[1:]]).first()
    weights = [F.ln((F.col(c) + 1.0) / float((of[1 + i] or 0) + max(of[0], 1))) for i, c in enumerate(sums[1:])]
    model = kept.select("term", (F.ln((F.lit(1.0) + total) / (1 + F.col("df"))) + 1).alias("idf"), F.array(*weights).alias("weights"))
    labels = [(name, i, math.log(n / total)) for i, (name, n) in enumerate(classes)]
    return written(model, "router"), docs.sparkSession.createDataFrame(labels, StructType([StructField("label", docs.schema[label].dataType), StructField("place", IntegerType()), StructField("intercept", DoubleType())]))


def route(docs: DataFrame, id_col: str, text: str, model: DataFrame, labels: DataFrame, scale: float = 1.0, probability: float = 0.5, margin: float = 0.1, coverage: float = 0.5, none: str = "__none__") -> DataFrame:
    """id, label, probability, margin, coverage, accepted and reason of every row.

    A row's vector is (1 + ln tf) times idf over the grams that the vocabulary holds, of unit length; logits are
    intercepts plus `scale` times its product with the weights. Three gates: the best label's probability, its lead over
    the next, and the share of the row's different bigrams that the vocabulary knows. Ties go to the smaller label. Rows
    without grams are scored by the intercepts alone and have no coverage. The vocabulary, which has a bound, is broadcast;
    a row's grams are counted and summed up in the task that has the row, and nothing is shuffled.
    """
    names = [(r["label"], r["intercept"]) for r in labels.orderBy("place").collect()]
    rows = spread(docs).select(F.col(id_col).alias("id"), F.lower(text).alias("_t"))
    known = model.select("term", "idf", "weights").collect()  # the vocabulary
    shared = rows.sparkSession.sparkContext.broadcast((pa.array([r["term"] for r in known], pa.string()), np.array([r["idf"] for r in known]), np.array([r["weights"] for r in known]).reshape(len(known), len(names))))
    sums = ["_xx", *[f"_x{i}" for i in range(len(names))], "coverage"]

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, idf, weights = shared.value
        for block in _blocks(batches):
            found, covered = np.zeros((len(sums) - 1, block.num_rows)), None
            for n, row, code, tf, said in _router_grams(block.column(1)):
                at = pc.fill_null(pc.index_in(said, terms), -1).to_numpy(zero_copy_only=False)[code]
                if n == 2:
                    of, most = (np.bincount(r, minlength=block.num_rows) for r in (row[at >= 0], row))
                    covered = pa.array(of / np.maximum(most, 1), mask=most == 0)
                row, tf, at = row[at >= 0], tf[at >= 0], at[at >= 0]
                x = (1 + np.log(tf)) * idf[at]
                for i, y in enumerate([x, *weights[at].T]):
                    found[i] += np.bincount(row, x * y, block.num_rows)
            yield pa.RecordBatch.from_arrays([block.column(0), *[pa.array(x) for x in found], covered], names=["id", *sums])

    scored = rows.mapInArrow(score, StructType([rows.schema["id"], *[StructField(c, DoubleType()) for c in sums]]))
    length = F.coalesce(F.nullif(F.sqrt("_xx"), F.lit(0.0)), F.lit(1.0))
    logits = [F.lit(float(b)) + scale * F.coalesce(F.col(f"_x{i}"), F.lit(0.0)) / length for i, (_, b) in enumerate(names)]
    top = F.greatest(*logits) if len(logits) > 1 else logits[0]
    scored = scored.withColumn("_top", top)
    powers = [F.exp(z - F.col("_top")) for z in logits]
    kind = labels.schema["label"].dataType
    ranked = F.array_sort(F.array(*[F.struct(F.round(-p, 12).alias("p"), F.lit(name).cast(kind).alias("label"), p.alias("e")) for p, (name, _) in zip(powers, names)]))
    scored = scored.withColumn("_z", sum(powers[1:], powers[0])).withColumn("_r", ranked)
    p = F.col("_r")[0]["e"] / F.col("_z")
    lead = p - F.coalesce(F.get("_r", F.lit(1))["e"] / F.col("_z"), F.lit(0.0))
    label, covered = F.col("_r")[0]["label"], F.coalesce(F.col("coverage"), F.lit(0.0))
    out = label.cast("string") == none
    accepted = ~out & (p >= probability) & (lead >= margin) & (covered >= coverage)
    return scored.select("id", label.alias("label"), p.alias("probability"), lead.alias("margin"), covered.alias("coverage"), accepted.alias("accepted"), F.when(accepted, "accepted").when(out, "out_of_scope").otherwise("low_confidence").alias("reason"))


def bigram_cosine(a: Column, b: Column) -> Column:
    """Cosine of the counts of two strings' bigrams; 0 where either has none."""
    x, y = char_ngrams(a, 2), char_ngrams(b, 2)
    count = lambda grams, g: F.size(F.filter(grams, lambda q: q == g))
    product = F.aggregate(F.transform(F.array_distinct(x), lambda g: count(x, g) * count(y, g)), F.lit(0), lambda s, v: s + v)
    square = lambda grams: F.aggregate(F.transform(F.array_distinct(grams), lambda g: count(grams, g) * count(grams, g)), F.lit(0), lambda s, v: s + v)
    return F.when((F.char_length(a) < 2) | (F.char_length(b) < 2), 0.0).otherwise(product / F.sqrt(square(x).cast("double") * square(y)))


def token_ratio(a: Column, b: Column) -> Column:
    """How alike two strings are by edit distance, 0 to 100, the better of as they are and with their words in order."""
    ratio = lambda x, y: 100 * (1 - F.levenshtein(x, y) / F.nullif(F.greatest(F.char_length(x), F.char_length(y)), F.lit(0)))
    in_order = lambda x: F.array_join(F.array_sort(F.split(x, "[ _]+")), " ")
    return F.coalesce(F.greatest(ratio(a, b), 0.95 * ratio(in_order(a), in_order(b))), F.lit(0.0))


def closure(edges: DataFrame) -> DataFrame:
    """node and needs: everything a node depends on, directly or not. ValueError if a node depends on itself.

    Each round doubles the paths' length and is written out, until a round finds nothing new.
    """
    spark = edges.sparkSession
    folder = f"{scratch_dir(spark)}/closure-{uuid.uuid4().hex}"
    reach, found, rounds = edges.select("node", "needs").distinct(), -1, 0
    while True:
        reach.write.parquet(f"{folder}/{rounds}")
        reach = spark.read.parquet(f"{folder}/{rounds}")
        if not reach.filter("node = needs").isEmpty():
            raise ValueError("the dependencies have a cycle")
        now = reach.count()
        if now == found:
            return reach
        found, rounds = now, rounds + 1
        longer = reach.alias("a").join(reach.alias("b"), F.col("a.needs") == F.col("b.node")).select(F.col("a.node").alias("node"), F.col("b.needs").alias("needs"))
        reach = reach.unionByName(longer).distinct()


def dependency_order(reach: DataFrame) -> DataFrame:
    """node and place for every node of a closure: what a node needs has a smaller place, since it needs less."""
    counts = reach.groupBy("node").agg(F.count(F.lit(1)).alias("place"))
    leaves = reach.select(F.col("needs").alias("node")).distinct().join(counts, "node", "left_anti").select("node", F.lit(0).cast("long").alias("place"))
    return counts.unionByName(leaves)


def lexical_search(paragraphs: DataFrame, terms: Sequence[str], vetoes: Sequence[str], k: int, excerpt: int = 900) -> DataFrame:
    """The k best paragraphs (id, place, text): eight points for each keyword they hold and up to six for its length; vetoed words rule one out."""
    low = F.lower("text")
    points = sum((F.when(F.contains(low, F.lit(t)), 8 + min(6, len(t))).otherwise(0) for t in terms), F.lit(0))
    veto = F.lit(False)
    for v in vetoes:
        veto = veto | F.contains(low, F.lit(v))
    found = paragraphs.filter(~veto).withColumn("points", points).filter("points > 0")
    return found.orderBy(F.desc("points"), "id", "place").limit(k).select("id", "place", "points", F.substring("text", 1, excerpt).alias("excerpt"))
