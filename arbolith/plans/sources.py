"""Readers and writers, each by a round trip through the shared folder."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from arbolith.functions import scalars as S
from arbolith.plans.registry import Plans
from arbolith.sources import catalog, files, registry
from arbolith.storage import scratch
from arbolith.tables import table

plans = Plans()
SCHEMA = "id string, source string, subject string, split string"


def tasks(spark, base):
    return table(spark, base, "tasks").select("id", "source", "subject", "split")


@plans.add("SELECT id, source, subject, split FROM tasks")
def s1_s10_s13_jsonl(spark, base):
    path = scratch(spark, "s1") + ".jsonl"
    files.write_jsonl(tasks(spark, base), path, append=False)
    return files.read(spark, path, SCHEMA)


@plans.add("SELECT id, coalesce(subject, '') AS subject, 'NA' AS note FROM tasks")
def s2_csv(spark, base):
    path = scratch(spark, "s2") + ".csv"
    rows = tasks(spark, base).select("id", F.coalesce("subject", F.lit("")).alias("subject"), F.lit("NA").alias("note"))
    rows.write.options(header=True, escape='"', emptyValue="").csv(path)
    return files.read(spark, path)


@plans.add("SELECT id, source, subject, split FROM tasks")
def s11_blank_lines(spark, base):
    path = scratch(spark, "s11")
    lines = tasks(spark, base).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    lines.withColumn("value", F.concat("value", F.lit("\n\n   "))).write.text(path)
    return files.read_jsonl_lenient(spark, path, SCHEMA)


@plans.add("SELECT r_regionkey AS k, r_name AS name FROM region")
def s12_json_array(spark, base):
    path = scratch(spark, "s12")
    r = table(spark, base, "region").orderBy("r_regionkey")
    items = r.agg(F.collect_list(F.to_json(F.struct(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")))).alias("v"))
    items.select(F.concat(F.lit("[1, "), F.array_join("v", ", "), F.lit(', "x"]'))).coalesce(1).write.text(path)
    return files.read_json_array(spark, path, "k int, name string")


@plans.add("SELECT id, source, NULL AS name FROM tasks UNION ALL SELECT NULL, NULL, r_name FROM region")
def s14_ragged(spark, base):
    path = scratch(spark, "s14")
    a = tasks(spark, base).select("id", "source")
    files.write_jsonl(a, path)
    files.write_jsonl(table(spark, base, "region").select(F.col("r_name").alias("name")), path)
    return spark.read.schema("id string, source string, name string").json(path)


@plans.add("SELECT doc_id, n_chars FROM documents WHERE n_chars <= 1500")
def s15_prepared(spark, base):
    path = scratch(spark, "s15")
    files.write_lengths(table(spark, base, "documents").select("doc_id", "n_chars"), path, "n_chars")
    return files.read_lengths(spark, path, "n_chars", 1500)


@plans.add("SELECT id FROM tasks WHERE split = 'test' UNION SELECT id FROM tasks WHERE source = 'glacis'")
def s17_id_files(spark, base):
    path = scratch(spark, "s17")
    t = tasks(spark, base)
    t.filter("split = 'test'").select(F.concat(F.lit("# a comment\n"), "id", F.lit("  # why"))).write.option("compression", "none").text(path + "/a")
    t.filter("source = 'glacis'").select(F.to_json(F.struct(F.col("id").alias("task_id")))).coalesce(1).write.text(path + "/b")
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path + "/b")
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for f in fs.listStatus(p):  # Spark names its text files .txt
        if f.getPath().getName().endswith(".txt"):
            fs.rename(f.getPath(), jvm.org.apache.hadoop.fs.Path(p, f.getPath().getName()[:-4] + ".jsonl"))
    return files.read_ids(spark, path)


@plans.add("""SELECT id, coalesce(max(r.stop), 'none') AS stop, max(source) AS source FROM (SELECT id, source FROM tasks WHERE split = 'test') t
    FULL JOIN (SELECT task_id, max(stop_reason) AS stop FROM tree_results GROUP BY 1) r ON id = task_id WHERE id IS NOT NULL GROUP BY 1""")
def s18_layered(spark, base):
    latest = table(spark, base, "tree_results").groupBy(F.col("task_id").alias("id")).agg(F.max("stop_reason").alias("stop"))
    view = tasks(spark, base).filter("split = 'test'").select("id", "source")
    last = view.select("id", F.lit("none").alias("stop"))
    return files.layered(["id"], latest, view, last).filter("source IS NOT NULL").select("id", "stop", "source")


@plans.add("SELECT id FROM tasks WHERE id NOT IN (SELECT task_id FROM tree_results)")
def s19_o7_pending(spark, base):
    done = table(spark, base, "tree_results").select(F.col("task_id").alias("id"))
    return files.pending(tasks(spark, base).select("id"), done, ["id"])


@plans.add("SELECT 'image_' || sha1(concat_ws(':', id, source)) AS name, id FROM tasks")
def s20_content_names(spark, base):
    """Content-addressed names from base64 data."""
    data = F.base64(F.encode(F.concat_ws(":", "id", "source"), "utf-8"))
    return tasks(spark, base).select(F.concat(F.lit("image_"), F.sha1(F.unbase64(data))).alias("name"), "id")


@plans.add("SELECT c_name AS name, c_acctbal AS score FROM customer UNION ALL SELECT s_name, s_acctbal FROM supplier")
def s3_s9_catalog(spark, base):
    """Two subsets of a registered dataset, renamed and concatenated."""
    path = scratch(spark, "s3")
    table(spark, base, "customer").select(F.col("c_name").alias("Title"), F.col("c_acctbal").alias("score")).write.parquet(path + "/a")
    table(spark, base, "supplier").select(F.col("s_name").alias("TITLE"), F.col("s_acctbal").alias("score")).write.parquet(path + "/b")
    c = catalog.Catalog()
    c.register_json(json.dumps([{"name": "team/pair", "path": path, "subsets": ["a", "b"], "columns": {"title": "name"}}]))
    return c.load(spark, "pair:a/b")


@plans.add("SELECT event_id, value * 2 AS reward FROM events")
def udf_reward(spark, base):
    """A user's list function over Arrow batches."""
    double = registry.vectorised_reward(lambda xs: [2 * x for x in xs])
    return table(spark, base, "events").select("event_id", double(F.col("value")).alias("reward"))


@plans.add("SELECT id, upper(source) AS source FROM tasks WHERE split = 'train'")
def udf_formatter(spark, base):
    """A user's row function, None dropping the row."""
    make = lambda r: {"id": r["id"], "source": r["source"].upper()} if r["split"] == "train" else None
    return registry.formatted(tasks(spark, base), make, "id string, source string")


@plans.add("SELECT id, lower(md5(concat_ws(':', '42', id))) AS key FROM tasks")
def m6_order_key(spark, base):
    return tasks(spark, base).select("id", S.order_key(42, "id").alias("key"))
