"""Readers and writers for the files that plants deliver."""

from __future__ import annotations

import csv
import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructType

#: Encodings in the order in which they are tried.
ENCODINGS = ("UTF-8", "GB18030", "UTF-16")


def scratch_dir(spark: SparkSession) -> str:
    """A folder that all executors share, as spark.checkpoint.dir names it; a temporary one only in local sessions."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="kilnworks-")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """value (bytes), file, and start (of the split in its file) of every line."""
    return spark.read.text(path).select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _decoded(lines: DataFrame, encoding: str, skip: int = 0) -> DataFrame:
    """line and broken (whether its bytes are none of the encoding): all lines but the first `skip` of each file, which lie in its first split."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, seen = None, 0
        for batch in batches:
            out, broken = [], []
            for value, name, start in zip(*(c.to_pylist() for c in batch.columns)):
                if name != file:
                    file, seen = name, 0
                seen += 1
                if start == 0 and seen <= skip:
                    continue
                text = value.decode(encoding, "replace").rstrip("\r")
                out.append(text)
                broken.append("\ufffd" in text or "\x00" in text)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(broken, pa.bool_())], names=["line", "broken"])

    return lines.mapInArrow(run, "line string, broken boolean")


def encoding_of(spark: SparkSession, path: str, encodings: Sequence[str] = ENCODINGS) -> str:
    """The first encoding that all lines of all files can be read in; ValueError where there is none.

    UTF-8 is told by Spark's own test of the bytes. An encoding of two bytes a character, whose lines are not cut at
    single bytes, is taken if nothing before it fits and its reader finds no replaced character anywhere.
    """
    lines = _lines(spark, path)
    for encoding in encodings:
        if encoding == "UTF-8":
            text = lines.select(F.col("value").cast("string").alias("v"))
            broken = text.filter(~F.is_valid_utf8("v") | F.contains("v", F.lit("\x00")))
        elif encoding.startswith("UTF-16"):
            wide = spark.read.option("encoding", encoding).option("multiLine", True).csv(path)
            broken = wide.filter(F.contains(F.concat_ws("", *[F.col(f"`{c}`") for c in wide.columns]), F.lit("\ufffd")))
        else:
            broken = _decoded(lines, encoding).filter("broken")
        if broken.isEmpty():
            return encoding
    raise ValueError(f"none of {', '.join(encodings)} reads {path}")


def read_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None, encodings: Sequence[str] = ENCODINGS) -> DataFrame:
    """All columns as strings, in the first encoding that reads every line (encoding_of); types are coerced later.

    columns, if given, are all that is kept; a byte order mark is dropped. The header is the first line of each file,
    and no other line is one. Line breaks within quotes are kept in UTF-8 and UTF-16; other encodings are decoded line
    by line.
    """
    encoding = encoding_of(spark, path, encodings)
    if encoding == "UTF-8" or encoding.startswith("UTF-16"):
        df = spark.read.option("header", True).option("encoding", encoding).option("multiLine", encoding != "UTF-8" or _has_quotes(spark, path)).csv(path)
    else:
        lines = _lines(spark, path)
        first = _decoded(lines, encoding).first()
        names = next(csv.reader([first["line"]])) if first else ["_c0"]
        schema = ", ".join(f"`{n.lstrip(chr(0xFEFF))}` string" for n in names)
        df = _decoded(lines, encoding, skip=1).select(F.from_csv("line", schema).alias("row")).select("row.*")
    named = df.toDF(*[c.lstrip("\ufeff") for c in df.columns])
    return named.select(*columns) if columns else named


def _has_quotes(spark: SparkSession, path: str) -> bool:
    """Whether a line ends within quotes, so that records may be longer than lines; files can be split where none does."""
    return not spark.read.text(path).filter((F.regexp_count("value", F.lit('"')) % 2) == 1).isEmpty()


def read_whitespace(spark: SparkSession, path: str, columns: Sequence[str], skip: int = 0) -> DataFrame:
    """Lines of numbers without a header; the names are documented, never guessed, and lines of another width are left out.

    skip: so many lines at the head of each file are left out.
    """
    lines = _decoded(_lines(spark, path), "UTF-8", skip).withColumn("_parts", F.split(F.trim("line"), r"\s+"))
    wide = lines.filter(F.size("_parts") == len(columns))
    return wide.select(*[F.col("_parts")[i].try_cast("double").alias(c) for i, c in enumerate(columns)])


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of the schema; lines that are no JSON are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def check_size(df: DataFrame, max_rows: int = 1_000_000, max_columns: int = 500) -> DataFrame:
    """df, or ValueError if it is larger than allowed; at most max_rows + 1 rows are counted."""
    if len(df.columns) > max_columns:
        raise ValueError(f"more than {max_columns} columns")
    if df.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"more than {max_rows} rows")
    return df


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, length and sha256 of every file."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """With a header; one file only where a person is to open it."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).csv(path)


def _json_value(c: Column, kind: DataType) -> Column:
    """c with numbers that JSON does not know as nulls, at any depth."""
    if isinstance(kind, (DoubleType, FloatType)):
        return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: _json_value(x, kind.elementType))
    if isinstance(kind, StructType):
        return F.when(c.isNotNull(), F.struct(*[_json_value(c.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, MapType):
        return F.transform_values(c, lambda _, v: _json_value(v, kind.valueType))
    return c


def write_jsonl(df: DataFrame, path: str) -> None:
    """Numbers that JSON does not know become null, also within lists and records.

    Rows are written to a folder beside the wanted one. When all are there, what stood at the wanted name is moved aside,
    the new folder takes the name, and only then is the old one deleted: at every moment one of them is whole.
    """
    clean = [_json_value(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields]
    spark = df.sparkSession
    new = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    df.select(*clean).write.json(new)
    place = spark._jvm.org.apache.hadoop.fs.Path
    system = place(path).getFileSystem(spark._jsc.hadoopConfiguration())
    old = f"{path.rstrip('/')}.old-{uuid.uuid4().hex}"
    replaced = system.exists(place(path))
    if replaced and not system.rename(place(path), place(old)):
        raise OSError(f"{path} cannot be moved aside")
    if not system.rename(place(new), place(path)):
        if replaced:
            system.rename(place(old), place(path))
        raise OSError(f"{new} cannot be renamed to {path}")
    if replaced:
        system.delete(place(old), True)
