"""Readers and writers of data files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbolith.functions.scalars import first_truthy

#: Formats by extension, where the name differs.
FORMATS = {"jsonl": "json", "ndjson": "json", "txt": "text", "pq": "parquet", "tsv": "csv"}


def extension(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[-1].lower() if "." in name else ""


def read(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A file or folder by its extension; without one, Parquet."""
    kind = FORMATS.get(extension(path), extension(path)) or "parquet"
    if kind == "csv":
        return read_csv(spark, path, "\t" if extension(path) == "tsv" else ",")
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.format(kind).load(path)


def read_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """All columns as text: an empty cell is '', and NA, null and the like stay text."""
    never = "\x00"
    reader = spark.read.options(header=True, sep=sep, quote='"', escape='"', multiLine=True, nullValue=never, emptyValue="", inferSchema=False)
    return reader.csv(path).na.fill("")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Every line must parse, or the read fails."""
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def read_jsonl_lenient(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Blank lines are skipped; a line that doesn't parse is an all-null row."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The objects of a file's array; items that aren't objects are left out."""
    whole = spark.read.text(path, wholetext=True)
    items = F.explode(F.from_json("value", "array<string>"))
    return whole.select(items.alias("item")).filter(F.ltrim("item").startswith("{")).select(F.from_json("item", schema).alias("r")).select("r.*")


def write_jsonl(df: DataFrame, path: str, append: bool = True, rows_per_file: int = 0) -> None:
    """Rows as lines of JSON, nulls included, so that every line has every key."""
    df.write.mode("append" if append else "overwrite").options(ignoreNullFields=False, maxRecordsPerFile=rows_per_file).json(path)


def write_lengths(df: DataFrame, path: str, length: str) -> None:
    """A prepared dataset: Parquet ordered by length inside its files, so that a length filter skips row groups."""
    df.sortWithinPartitions(length).write.mode("overwrite").parquet(path)


def read_lengths(spark: SparkSession, path: str, length: str, limit: int) -> DataFrame:
    """The prepared rows of at most ``limit``; the filter is pushed into the scan."""
    return spark.read.parquet(path).filter(F.col(length) <= limit)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """id: those of id files in a folder: JSON (lists, or task_id, idx, id, task_ids at any key), JSON lines, and text with # comments."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{json,jsonl,txt}").select("value", F.col("_metadata.file_path").alias("file"))
    text = files.filter("file LIKE '%.txt'").select(F.explode(F.split("value", r"\r?\n")).alias("line"))
    plain = text.select(F.trim(F.regexp_replace("line", "#.*$", "")).alias("id"))
    parts = F.when(F.col("file").like("%.jsonl"), F.split("value", r"\r?\n")).otherwise(F.array("value"))
    docs = files.filter("file NOT LIKE '%.txt'").select(F.explode(parts).alias("value")).filter(F.trim("value") != "")
    listed = F.coalesce(F.from_json("value", "array<string>"), F.array().cast("array<string>"))
    obj = F.from_json("value", "task_id string, idx string, id string, task_ids array<string>")
    one = first_truthy(obj["task_id"], obj["idx"], obj["id"])
    named = F.concat(F.array_compact(F.array(one)), F.coalesce(obj["task_ids"], F.array().cast("array<string>")))
    items = docs.select(F.explode(F.when(F.ltrim("value").startswith("["), listed).otherwise(named)).alias("item"))
    inner = F.from_json("item", "task_id string, idx string, id string")
    nested = items.select(F.when(F.ltrim("item").startswith("{"), first_truthy(inner["task_id"], inner["idx"], inner["id"])).otherwise(F.trim("item")).alias("id"))
    return plain.unionByName(nested).filter("id <> ''").distinct()


def layered(keys: Sequence[str], *layers: DataFrame) -> DataFrame:
    """One row per key of any layer; each value from the first layer that has it."""
    names = list(dict.fromkeys(c for d in layers for c in d.columns if c not in keys))
    rows = None
    for i, d in enumerate(layers):
        part = d.select(*keys, *[F.col(c) if c in d.columns else F.lit(None).alias(c) for c in names], F.lit(i).alias("__layer"))
        rows = part if rows is None else rows.unionByName(part)
    first = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("__layer"))).alias(c) for c in names]
    return rows.groupBy(*keys).agg(*first)


def pending(requested: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The requested rows whose keys have no result yet."""
    return requested.join(done.select(*keys).distinct(), list(keys), "left_anti")


def write_split(df: DataFrame, part: str, value: str, path: str, rows_per_file: int = 0) -> DataFrame:
    """Write the rows whose ``part`` is ``value`` as JSON lines, a file per partition, and return the others; null parts are others."""
    write_jsonl(df.filter(F.col(part) == value).drop(part), path, append=False, rows_per_file=rows_per_file)
    return df.filter(~F.col(part).eqNullSafe(F.lit(value)))


def read_samples(spark: SparkSession, path: str, schema: T.StructType | str, name: str = "sample") -> DataFrame:
    """JSON lines of all folders below ``path``, however deep, with the folder relative to ``path`` as ``name``."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").json(path)
    folder = F.regexp_replace(F.col("_metadata.file_path"), r"/[^/]*$", "")
    root = path.rstrip("/").rsplit("/", 1)[-1]
    return rows.withColumn(name, F.regexp_replace(folder, rf"^.*/\Q{root}\E/?", ""))
