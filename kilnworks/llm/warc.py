"""WARC archives: written and read by Spark, with boundary-chain verification of record starts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import hottest, join_spread, materialize, release

MAGIC = "WARC/1.1\r\n"
BREAK = "\r\n\r\n"


def mark_revisits(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", min_bytes: int = 1000, broadcast_rows: int = 100_000) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type and refers_to of each row.

    Of rows with equal payloads of at least min_bytes, those with the largest id are responses and the others revisit
    it. A null payload counts as empty. Rows with a null id are responses unless a row with an id has their payload.
    The digest's largest id comes from a map-side aggregate, so a hot payload is one row for each task there. Up to
    broadcast_rows groups of equal payloads (about 100 bytes each) are broadcast, and payloads stay where they are;
    beyond, payloads meet their group by a shuffle in which the most frequent ones are dealt into parts.
    """
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), F.coalesce(pages[payload_col].cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1(F.col("payload").cast("binary"))})
    tops = rows.filter(F.col("payload_bytes") >= min_bytes).groupBy(F.col("payload_digest").alias("digest"), F.col("payload_bytes").alias("bytes")).agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) & F.col("top").isNotNull())
    tops = materialize(tops.withColumnsRenamed({"digest": "payload_digest", "bytes": "payload_bytes"}), "warc-tops")
    same = ["payload_digest", "payload_bytes"]
    if tops.limit(broadcast_rows + 1).count() <= broadcast_rows:
        joined = rows.join(F.broadcast(tops.drop("n")), same, "left")
    else:
        joined = join_spread(rows, tops.drop("n"), same, "page_id", hottest(tops, same), how="left")
    joined = joined.select(*rows.columns, "top")
    revisit = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    return joined.withColumns({"record_type": F.when(revisit, "revisit").otherwise("response"), "refers_to": F.when(revisit, F.col("top"))}).drop("top")


PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def write_warc(records: DataFrame, path: str, records_per_file: int = 2000, date: str | None = None) -> None:
    """Write rows of mark_revisits() as archives at path. Spark's text writer puts each record's closing break after it.

    Every record has the header fields that WARC/1.1 demands. date (ISO, by default the time of the job) is WARC-Date;
    a row with a null id gets a random record id. Archives are not compressed, so that readers may split them.
    """
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"\r\n{name}: "), value.cast("string"))).otherwise("")
    named = lambda c: F.concat(F.lit("<urn:page:"), F.col(c).cast("string"), F.lit(">"))
    revisit = F.col("record_type") == "revisit"
    when = F.lit(date) if date else F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    record = F.concat(
        F.lit(MAGIC + "WARC-Type: "), F.col("record_type"),
        line("WARC-Record-ID", F.coalesce(named("page_id"), F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")))),
        line("WARC-Date", when),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]+", "%0A")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("WARC-Payload-Length", F.col("payload_bytes")),
        line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        line("WARC-Refers-To", named("refers_to")),
        F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string")),
        F.lit(BREAK), F.when(revisit, "").otherwise(F.col("payload")),
    )
    records.select(record.alias("value")).write.option("lineSep", BREAK).option("maxRecordsPerFile", records_per_file).text(path)


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """The bytes between one magic and the next, in any archive; the reader splits at the magic wherever it stands."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), "value", F.octet_length("value").cast("long").alias("bytes"), F.xxhash64("value").alias("hash"))


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """One row for each occurrence of the magic: file, off, succ, bytes, hash, the header's fields and, of a whole record, the payload's sha1.

    A chunk's offset is the sum of the bytes before it: within its split by a window over that split, before its split
    by the splits' sums. succ is null where no header with a Content-Length follows the magic. Payloads stay behind in
    the scan: where the chunk is one whole record, its digest is taken there.
    """
    n, gap = len(MAGIC), len(BREAK)
    raw = _chunks(spark, path).withColumn("header", F.when(F.instr("value", BREAK) > 0, F.substring_index("value", BREAK, 1)))
    text = lambda name, form=r"[^\r\n]*": F.expr(f"nullif(regexp_extract(header, '(?i)(?:^|\\r\\n){name}:[ \\t]*({form})', 1), '')")
    number = lambda name, before="", after="": F.expr(f"try_cast(nullif(regexp_extract(header, '(?i)(?:^|\\r\\n){name}:[ \\t]*{before}(-?[0-9]+){after}', 1), '') as long)")
    raw = raw.withColumns({"content": number("Content-Length"), "body": (F.octet_length("header") + gap).cast("long")})
    raw = raw.withColumn("whole", F.coalesce((F.col("content") >= 0) & (F.col("body") + F.col("content") + gap == F.col("bytes")), F.lit(False)))
    payload = F.expr("substring(cast(value as binary), cast(body + 1 as int), cast(content as int))")
    light = raw.select(
        "file", "block", "row", "bytes", "hash", "content", "body", "whole", F.when(F.col("whole"), F.sha1(payload)).alias("sha1"), text("WARC-Type", "[a-z]+").alias("record_type"), number("WARC-Record-ID", "<urn:page:", ">").alias("page_id"),
        number("WARC-Refers-To", "<urn:page:", ">").alias("refers_to"), text("WARC-Target-URI").alias("url"), text("WARC-Payload-Digest", "sha1:[0-9a-f]+").alias("stated_digest"), number("WARC-Payload-Length").alias("stated_bytes"),
    )
    light = materialize(light, "warc-chunks")  # rows keep their order numbers from here
    inside = Window.partitionBy("file", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = light.groupBy("file", "block").agg(F.sum(F.col("bytes") + n).alias("sum")).select("file", "block", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"))
    placed = light.withColumn("inside", F.coalesce(F.sum(F.col("bytes") + n).over(inside), F.lit(0))).join(blocks, ["file", "block"])
    # what stands before the first magic of a file has no magic of its own
    placed = placed.withColumn("off", F.col("base") + F.col("inside") - n).filter("off >= 0").drop("base", "inside", "block", "row")
    return placed.withColumn("succ", F.when((F.col("content") >= 0) & F.col("record_type").isNotNull(), F.col("off") + n + F.col("body") + F.col("content") + gap))


def reachable(links: DataFrame) -> DataFrame:
    """file and off of the record starts that the chain from each file's start reaches, by pointer jumping.

    links: file, off, succ, size. Each round doubles every candidate's jump and marks what a reached candidate jumps
    to, so a file of n records takes log2(n) rounds, each a join on (file, off).
    """
    state = materialize(links.filter("succ is not null").select("file", "off", F.col("succ").alias("jump"), (F.col("off") == 0).alias("reach")), "warc-jumps")
    reached = -1
    while True:
        now = state.filter("reach").count()
        if now == reached:
            return state.filter("reach").select("file", "off")
        reached = now
        after = state.select("file", F.col("off").alias("jump"), F.col("jump").alias("next"))
        hit = state.filter("reach").select("file", F.col("jump").alias("off")).distinct().withColumn("hit", F.lit(True))
        before = state
        state = materialize(state.join(after, ["file", "jump"], "left").join(hit, ["file", "off"], "left").select("file", "off", F.coalesce("next", "jump").alias("jump"), (F.col("reach") | F.coalesce("hit", F.lit(False))).alias("reach")), "warc-jumps")
        release(before)


_FIELDS = ("record_type", "page_id", "refers_to", "url", "stated_digest", "stated_bytes")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, file, off of every record in the archives.

    Only record starts on the chain from a file's start count; a magic inside a payload, with or without a header that
    looks whole, is rejected and its bytes belong to the record around it. Empty archives give no rows.
    """
    chunks = materialize(candidates(spark, path), "warc-candidates")
    starts = reachable(chunks.select("file", "off", "succ")).withColumn("start", F.lit(True))
    marked = chunks.join(starts, ["file", "off"], "left")
    found = marked.filter("start and whole").select("file", "off", *_FIELDS, F.col("content").alias("length"), "sha1")
    heads = marked.filter("start and not whole").select("file", "off", *_FIELDS, "content", "body")
    if not heads.isEmpty():
        found = found.unionByName(_torn(spark, path, marked, heads))
    revisit = F.col("record_type") == "revisit"
    stated = F.expr("substring(stated_digest, 6)")
    return found.select("page_id", "url", F.when(revisit, F.col("stated_bytes")).otherwise(F.col("length")).alias("payload_bytes"), F.when(revisit, stated).otherwise(F.col("sha1")).alias("payload_digest"), "record_type", "refers_to", "file", "off")


def _torn(spark: SparkSession, path: str, marked: DataFrame, heads: DataFrame) -> DataFrame:
    """Records whose payload holds the magic: their chunks, fetched by content in a second scan, put together again."""
    owner = Window.partitionBy("file").orderBy("off").rowsBetween(Window.unboundedPreceding, 0)
    owned = marked.withColumn("record", F.last(F.when(F.col("start"), F.col("off")), True).over(owner))
    owned = owned.join(heads.select("file", F.col("off").alias("record")), ["file", "record"]).select("file", "record", "off", "hash", "bytes")
    wanted = owned.select("file", "hash", "bytes").distinct()
    bytes_of = _chunks(spark, path).join(wanted, ["file", "hash", "bytes"], "left_semi").groupBy("file", "hash", "bytes").agg(F.min("value").alias("value"))
    part = F.when(F.col("off") == F.col("record"), F.col("value")).otherwise(F.concat(F.lit(MAGIC), F.col("value")))
    whole = owned.join(bytes_of, ["file", "hash", "bytes"]).groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("off", part.alias("part")))).alias("parts"))
    joined = heads.join(whole.withColumnRenamed("record", "off"), ["file", "off"]).withColumn("payload", F.expr("substring(cast(array_join(parts.part, '') as binary), cast(body + 1 as int), cast(content as int))"))
    return joined.select("file", "off", *_FIELDS, F.col("content").alias("length"), F.sha1("payload").alias("sha1"))
