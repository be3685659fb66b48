"""How far the sources of a language stand from each other and from the language, by the terms they use.

Terms are counted by sorting. A task sorts the terms of a block of documents by (term, language, source, document) and
reads the runs: each gives a document frequency and a count. Only these are shuffled, by (language, term), sorted there
again and merged in one streaming scan; a frequent term arrives as one row for each block and source, so no key is hot.
A second scan over the kept terms emits what each run adds to the pairs of its sources, and each group's best terms.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._bytes import text_slices
from ._common import hottest, join_spread, materialize, release

#: What each byte becomes: A-Z lower case, other letters and bytes beyond ASCII as they are, all else a blank.
LETTERS = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256)], np.uint8)
#: Bytes of text whose terms are sorted at once.
BLOCK = 24 << 20
#: Pairs that a scan evaluates at once, and sums or candidate terms that it holds before it emits or prunes them.
PAIRS, HELD = 1 << 20, 1 << 18
PARTIAL = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("docs", pa.int64()), ("count", pa.int64())])
PARTIAL_DDL = "lang string, term string, source string, docs long, count long"
RUN = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("count", pa.int64()), ("lang_count", pa.int64()), ("first", pa.int64())])
RUN_DDL = "lang string, term string, source string, count long, lang_count long, first long"
FOUND = pa.schema([("part", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])
FOUND_DDL = "part string, lang string, source string, item string, value long"


def _codes(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    encoded = pc.dictionary_encode(column)
    encoded = encoded.combine_chunks() if isinstance(encoded, pa.ChunkedArray) else encoded
    return encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins."""
    changed = np.ones(len(columns[0]), bool)
    changed[1:] = False
    for c in columns:
        changed[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(changed)


def block_runs(langs: pa.Array, sources: pa.Array, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    """Document frequency and count of each (language, term, source) of a block of documents."""
    lang, lang_names = _codes(langs)
    source, source_names = _codes(sources)
    n = len(lang)
    order = np.lexsort((source, lang))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    group = (lang * (len(source_names) + 1) + source)[order]
    lower = pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(LETTERS[data])])
    split = pc.ascii_split_whitespace(lower)
    words = split.flatten()
    doc = np.repeat(place, np.diff(split.offsets.to_numpy()))
    term, terms = _codes(words)
    full = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    keys = np.sort(term[full] * n + doc[full])  # by term, language, source, document
    first = _starts(keys)
    each, of_term = np.diff(np.append(first, len(keys))), keys[first] // n
    of_doc = keys[first] - of_term * n
    runs = _starts(of_term, group[of_doc])
    some = order[of_doc[runs]]
    return pa.RecordBatch.from_arrays(
        [lang_names.take(pa.array(lang[some])), terms.take(pa.array(of_term[runs])), source_names.take(pa.array(source[some])), pa.array(np.diff(np.append(runs, len(first)))), pa.array(np.add.reduceat(each, runs) if len(runs) else each[:0])], schema=PARTIAL
    )


def long_text_runs(lang: str, source: str, data: np.ndarray, most: int) -> pa.RecordBatch:
    """The same for one text that is longer than a block, cut between terms."""
    counts: Counter[bytes] = Counter()
    rest = b""
    for at in range(0, len(data), most):
        piece = rest + LETTERS[data[at : at + most]].tobytes()
        cut = piece.rfind(b" ") + 1 if at + most < len(data) else len(piece)
        counts.update(piece[:cut].split())
        rest = piece[cut:]
    n = len(counts)
    return pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array([source] * n, pa.string()), pa.array([1] * n, pa.int64()), pa.array(list(counts.values()), pa.int64())], schema=PARTIAL)


def partial_runs(batches: Iterable[pa.RecordBatch], most: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Runs of the documents (lang, source, text) of a task, block by block."""
    held: list[pa.RecordBatch] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()
        for batch in whole:
            langs, sources, texts = batch.columns
            share = -(-max(1, texts.nbytes) // most)
            for at, data, offsets in text_slices(texts, max(most // 2, texts.nbytes // share + 1)):
                if len(data) > 2 * most:
                    yield long_text_runs(langs[at].as_py(), sources[at].as_py(), data, most)
                else:
                    yield block_runs(langs.slice(at, len(offsets) - 1), sources.slice(at, len(offsets) - 1), data, offsets)
        held.clear()

    for batch in batches:
        if held and size + batch.nbytes > most:
            yield from flush()
            size = 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield from flush()


def _whole(batches: Iterable[pa.RecordBatch], shrink: Callable[[pa.Table], pa.Table] = lambda t: t) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows in tables that hold whole runs of (lang, term), and where the runs start. What is left is shrunk before it grows."""
    rest: pa.Table | None = None

    def starts(rows: pa.Table) -> np.ndarray:
        return _starts(_codes(rows["lang"])[0], _codes(rows["term"])[0])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = shrink(rows if rest is None else pa.concat_tables([rest, rows]).combine_chunks())
        at = starts(rows)
        if at[-1]:
            yield rows.slice(0, int(at[-1])), at[:-1]
        rest = rows.slice(int(at[-1]))
    if rest is not None:
        yield rest, np.zeros(1, np.int64)


def _numbers(rows: pa.Table, name: str) -> np.ndarray:
    return rows[name].to_numpy()


def merge_runs(batches: Iterable[pa.RecordBatch], min_docs: int) -> Iterator[pa.RecordBatch]:
    """Partial runs sorted by (term, lang, source): a row for each source of the terms that min_docs documents of the language have."""

    def shrink(rows: pa.Table) -> pa.Table:
        at = _starts(*(_codes(rows[c])[0] for c in ("lang", "term", "source")))
        some = rows.select(["lang", "term", "source"]).take(pa.array(at))
        return some.append_column("docs", pa.array(np.add.reduceat(_numbers(rows, "docs"), at))).append_column("count", pa.array(np.add.reduceat(_numbers(rows, "count"), at)))

    for rows, at in _whole(batches, shrink):
        docs, count = _numbers(rows, "docs"), _numbers(rows, "count")
        length = np.diff(np.append(at, len(docs)))
        keep = np.repeat(np.add.reduceat(docs, at) >= min_docs, length)
        first = np.zeros(len(docs), np.int64)
        first[at] = 1
        made = rows.select(["lang", "term", "source", "count"]).append_column("lang_count", pa.array(np.repeat(np.add.reduceat(count, at), length))).append_column("first", pa.array(first))
        yield from made.filter(pa.array(keep)).cast(RUN).combine_chunks().to_batches()


def squared(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def emit(batches: Iterable[pa.RecordBatch], top: int) -> Iterator[pa.RecordBatch]:
    """What runs of (lang, term, source, p, p0, q), sorted by (term, lang, source), add to pairs, and each group's terms above the language.

    p is the group's share of the term, p0 its share of a term that it lacks, q the language's. A pair's part of a run is
    f(p, p') without what it would be if either source, or both, lacked the term: those follow from counts alone. Sums are
    emitted when many are held, and once at the end; of a group's terms the best `top` of the task are.
    """
    sums: dict[tuple[str, str, str], int] = {}
    best: list[pa.Table] = []

    def pairs() -> pa.RecordBatch:
        keys = list(zip(*sums)) or [(), (), ()]
        made = pa.RecordBatch.from_arrays([pa.array(["pair"] * len(sums), pa.string()), *(pa.array(k, pa.string()) for k in keys), pa.array(list(sums.values()), pa.int64())], schema=FOUND)
        sums.clear()
        return made

    def pruned() -> pa.Table:
        rows = pa.concat_tables(best).sort_by([("lang", "ascending"), ("source", "ascending"), ("value", "descending"), ("item", "ascending")]).combine_chunks()
        at = _starts(_codes(rows["lang"])[0], _codes(rows["source"])[0])
        rank = np.arange(rows.num_rows) - np.repeat(at, np.diff(np.append(at, rows.num_rows)))
        return rows.filter(pa.array(rank < top))

    held = 0
    for rows, at in _whole(batches):
        p, p0, q = (_numbers(rows, c) for c in ("p", "p0", "q"))
        length = np.diff(np.append(at, len(p)))
        begin, size = np.repeat(at, length), np.repeat(length, length)
        (lang, lang_names), (source, source_names) = _codes(rows["lang"]), _codes(rows["source"])
        ends = np.cumsum(size)
        low = 0
        while low < len(p):  # whole rows with all their partners, PAIRS at a time
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + PAIRS, "right")))
            here = size[low:high]
            a = np.repeat(np.arange(low, high), here)
            b = np.repeat(begin[low:high] - np.cumsum(here) + here, here) + np.arange(len(a))
            a, b = a[a != b], b[a != b]
            value = squared(p[a], p[b]) - squared(p[a], p0[b]) - squared(p0[a], p[b]) + squared(p0[a], p0[b])
            key = (lang[a] * len(source_names) + source[a]) * len(source_names) + source[b]
            order = np.argsort(key, kind="stable")
            runs = _starts(key[order])
            total = np.add.reduceat(value[order], runs) if len(runs) else value[:0]
            some = order[runs]
            for x, y, z, v in zip(lang_names.take(pa.array(lang[a[some]])).to_pylist(), source_names.take(pa.array(source[a[some]])).to_pylist(), source_names.take(pa.array(source[b[some]])).to_pylist(), total.tolist()):
                sums[x, y, z] = sums.get((x, y, z), 0) + v
            if len(sums) > HELD:
                yield pairs()
            low = high
        above = pa.array(p > q)
        terms = pa.table({"part": pa.array(["term"] * len(p), pa.string()), "lang": rows["lang"], "source": rows["source"], "item": rows["term"], "value": pa.array(squared(p, q))}).filter(above)
        best.append(terms)
        held += terms.num_rows
        if held > HELD:
            best[:] = [pruned()]
            held = -HELD if best[0].num_rows > HELD else best[0].num_rows  # many groups: prune again after as many more
    yield pairs()
    if best:
        yield from pruned().cast(FOUND).combine_chunks().to_batches()


def _share(count: str, total: str, scale: int) -> Column:
    """1 + floor(scale * (count + 1) / (total + vocabulary)), in exact decimals; null without a vocabulary."""
    return F.expr(f"1 + (cast({scale} as decimal(10, 0)) * cast({count} + 1 as decimal(19, 0))) div cast(nullif({total} + vocabulary, 0) as decimal(19, 0))")


def _f(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q})) div {q}"


def source_divergence(docs: DataFrame, min_docs: int = 3, top: int = 200, scale: int = 1_000_000_000, broadcast_rows: int = 100_000) -> DataFrame:
    """lang, source, part, item, value and rank: how far each source stands from every other one of its language, and by which terms.

    Part `pair`: the sum over the language's kept terms of floor((p - q)^2 / q), p the source's smoothed share of the term
    and q the other's. Part `term`: the `top` terms whose share exceeds the language's. A term is kept in a language if
    min_docs of its rows have it.

    Null text, lang and source count as ''. Rows are documents: repeated rows and rows of one or no id each count. Texts
    without terms leave their group without counts; a language without kept terms has pairs of value 0. Ties go to the
    item that is smaller in UTF-8. Other columns are not read; an empty table gives no rows. A very long text is cut
    between terms and still counts as one document.

    The table of groups is as small as the square root of the result; it is broadcast up to broadcast_rows rows and
    shuffled beyond, with hot languages and groups in parts.
    """
    plain = docs.select(*(F.coalesce(docs[c].cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    merged = plain.mapInArrow(partial_runs, PARTIAL_DDL).repartition("lang", "term").sortWithinPartitions("term", "lang", "source")
    runs = materialize(merged.mapInArrow(lambda batches: merge_runs(batches, min_docs), RUN_DDL), "divergence-runs")

    counted = runs.groupBy("lang", "source").agg(F.sum("count").alias("total"), F.count(F.lit(1)).alias("terms"))
    whole = runs.groupBy("lang").agg(F.sum("first").alias("vocabulary"), F.sum("count").alias("lang_total"))
    groups = plain.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("rows")).join(counted, ["lang", "source"], "left").join(whole, "lang", "left").fillna(0)
    groups = materialize(groups.withColumn("p0", _share("0", "total", scale)), "divergence-groups")
    few = groups.limit(broadcast_rows + 1).count() <= broadcast_rows

    def meet(rows: DataFrame, other: DataFrame, keys: list[str], by: str) -> DataFrame:
        if few:
            return rows.join(F.broadcast(other), keys)
        return join_spread(rows, other, keys, by, hottest(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), keys))

    priced = meet(runs, groups, ["lang", "source"], "term").select("lang", "term", "source", _share("count", "total", scale).alias("p"), "p0", _share("lang_count", "lang_total", scale).alias("q"))
    found = materialize(priced.repartition("lang", "term").sortWithinPartitions("term", "lang", "source").mapInArrow(lambda batches: emit(batches, top), FOUND_DDL), "divergence-found")

    # Terms that one source of a pair lacks depend on the other's count alone, so equal counts are taken together.
    counts = runs.groupBy("lang", "source", "count").agg(F.count(F.lit(1)).alias("n"))
    levels = meet(counts, groups, ["lang", "source"], "count").select("lang", "source", _share("count", "total", scale).alias("p"), "n")
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("terms").alias("other_terms"))
    one = meet(levels, other.select("lang", "item", "q0"), ["lang"], "p").filter("source <> item")
    exact = lambda e: F.expr(f"cast({e} as decimal(38, 0))").alias("value")
    none = meet(groups, other, ["lang"], "source").filter("source <> item")
    parts = [
        found.filter("part = 'pair'").select("lang", "source", "item", exact("value")),
        one.select("lang", "source", "item", exact(f"cast(n as decimal(19, 0)) * cast({_f('p', 'q0')} as decimal(19, 0))")),
        one.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), exact(f"cast(n as decimal(19, 0)) * cast({_f('q0', 'p')} as decimal(19, 0))")),
        none.select("lang", "source", "item", exact(f"cast(vocabulary - terms - other_terms as decimal(19, 0)) * cast({_f('p0', 'q0')} as decimal(19, 0))")),
    ]
    pair = parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3]).groupBy("lang", "source", "item").agg(F.coalesce(F.sum("value"), F.lit(0)).cast("long").alias("value"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pair = pair.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(ranked).alias("rank"))
    term = found.filter("part = 'term'").withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top)
    made = materialize(pair.unionAll(term.select("lang", "source", "part", "item", "value", "rank")), "divergence")
    release(runs, groups, found)
    return made
