"""Line deduplication by distinct-site spread."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import HOT_ROWS, hottest, join_spread, materialize


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """A row for each line of at least min_chars characters: the document's columns but text, the line's place and the hash of the trimmed line."""
    hashes = F.expr(f"transform(split(text, '\\n', -1), x -> if(char_length(trim(x)) >= {int(min_chars)}, xxhash64(trim(x)), null))")
    return docs.select(*[c for c in docs.columns if c != "text"], F.posexplode(hashes).alias("place", "hash")).filter("hash is not null")


def boilerplate_lines(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", min_sites: int = 10, min_chars: int = 10, error: float = 0.1, band: float = 5.0) -> DataFrame:
    """hash and first (the smallest id of a row that has it) of every line that stands on at least min_sites distinct sites.

    One aggregation merges a HyperLogLog sketch for each line hash, on the map side first, so a line that a third of
    the rows hold is one row for each task. Its estimate settles lines that are further from min_sites than `band`
    standard errors (`error` of min_sites each); the lines between get exact distinct counts, from (line, site) pairs
    that are made distinct before they are shuffled.
    """
    docs = docs.select(docs[id_col].cast("long").alias("id"), docs[source_col].cast("string").alias("site"), docs[text_col].cast("string").alias("text")).filter("text is not null")
    low, high = min_sites * (1 - band * error), min_sites * (1 + band * error)
    lines = _lines(docs, min_chars)
    spread = lines.groupBy("hash").agg(F.approx_count_distinct("site", error).alias("estimate"), F.min("id").alias("first")).filter(F.col("estimate") >= low)
    spread = materialize(spread, "line-spread")
    near = spread.filter(F.col("estimate") <= high).select("hash", "first")
    counted = lines.filter("site is not null").join(near.select("hash"), "hash", "left_semi").select("hash", "site").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("sites")).filter(F.col("sites") >= min_sites)
    return spread.filter(F.col("estimate") > high).select("hash", "first").unionByName(near.join(counted.select("hash"), "hash"))


#: Lines tell their places in a table of about so many lines each.
BUCKET_LINES = 2


def _known_lines(flagged: list[tuple[int, int | None]]) -> tuple[str, int]:
    """SQL for a constant array of buckets of (hash, first), and how many buckets there are: a line is looked up in its hash's bucket alone."""
    buckets = max(1, len(flagged) // BUCKET_LINES)
    made: list[list[dict[str, int | None]]] = [[] for _ in range(buckets)]
    for line, first in flagged:
        made[line % buckets].append({"h": line, "f": first})
    return f"from_json('{json.dumps(made)}', 'array<array<struct<h: bigint, f: bigint>>>')", buckets


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", min_sites: int = 10, min_chars: int = 10,
    keep_first: bool = True, error: float = 0.1, band: float = 5.0, constant_lines: int = 20_000,
) -> DataFrame:
    """The rows of docs with boilerplate lines cut from their texts, and n_lines, n_removed and removed_lines appended.

    A line is boilerplate if, trimmed of blanks and of min_chars characters at least, it stands on min_sites distinct
    sites or more. With keep_first it stays in rows of the smallest id that has it, so nothing is lost from the corpus.
    A removed line goes with its line break; a document of boilerplate alone becomes empty. removed_lines are the
    places (from 0) of the removed lines. Sites are `source_col`.

    Up to constant_lines boilerplate lines (16 bytes each) become a constant of the last pass, which then cuts texts
    where they are; more are joined by their hashes, those of the commonest lines in parts, and texts are shuffled to the places that are
    cut from them.

    Null texts stay null with no lines. Rows with a null source are no site of their own, and rows with a null id never
    keep a line, but both lose lines as others do. Repeated rows, and rows that share an id, are cut each for itself.
    Appended columns take the place of columns of the same name. Empty tables give no rows.
    """
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed", "removed_lines")]
    flagged = materialize(boilerplate_lines(docs, id_col, source_col, text_col, min_sites, min_chars, error, band), "boilerplate")
    known = flagged.limit(constant_lines + 1).collect()  # constant_lines + 1 rows at most
    ident, text = docs[id_col].cast("long"), docs[text_col].cast("string")
    row = F.struct(*[docs[f"`{c}`"] for c in kept]).alias("_row")
    if len(known) <= constant_lines:
        table, buckets = _known_lines([(r["hash"], r["first"]) for r in known])
        own = "e.f is null or _id is null or e.f <> _id" if keep_first else "true"
        line = f"if(char_length(trim(x)) >= {int(min_chars)}, xxhash64(trim(x)), null)"
        places = f"""filter(transform(_lines, (x, i) -> if(exists(element_at({table}, cast(pmod({line}, {buckets}) + 1 as int)), e -> e.h = {line} and ({own})), i, null)), i -> i is not null)"""
        split = docs.select(row, ident.alias("_id"), F.split(text, "\n", -1).alias("_lines"))
        joined = split.withColumn("removed_lines", F.coalesce(F.expr(places), F.array().cast("array<int>")))
    else:
        key = F.xxhash64(ident, text, F.octet_length(text))
        narrow = docs.select(key.alias("key"), ident.alias("id"), text.alias("text")).filter("text is not null")
        cuts = _lines(narrow, min_chars)
        # how often a line stands is counted before its hash meets others, and the rows of a line that stands everywhere are dealt out
        often = cuts.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= HOT_ROWS).join(flagged, "hash", "left_semi")
        cuts = join_spread(cuts, flagged, ["hash"], "key", materialize(hottest(often, ["hash"]), "line-hot"))
        if keep_first:
            cuts = cuts.filter("id is null or first is null or id <> first")
        cuts = cuts.select("key", "place").distinct().groupBy("key").agg(F.sort_array(F.collect_list("place")).alias("removed_lines"))
        joined = docs.select(row, key.alias("key")).join(cuts, "key", "left").withColumn("removed_lines", F.coalesce("removed_lines", F.array().cast("array<int>")))
        joined = joined.withColumn("_lines", F.split(F.col("_row").getField(text_col).cast("string"), "\n", -1))
    text = F.col("_row").getField(text_col)
    left = F.expr("array_join(transform(array_except(sequence(0, size(_lines) - 1), removed_lines), i -> _lines[i]), '\n')")
    cut = F.when(F.size("removed_lines") == 0, text).otherwise(left)
    columns = [cut.alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in kept]
    return joined.select(*columns, F.when(text.isNull(), 0).otherwise(F.size("_lines")).cast("long").alias("n_lines"), F.size("removed_lines").cast("long").alias("n_removed"), "removed_lines")
