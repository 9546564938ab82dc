"""Annotations in and out: the case's tables and the JSON sidecar of one file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import COMMENTS, EDITS, TAG_DEFS, TAGS

_SIDECAR = "tags map<string, array<string>>, comments map<string, string>, edits map<string, map<string, string>>, tag_defs array<struct<name: string, color: string>>, known_tags array<string>"


def read_sidecar(spark: SparkSession, path: str, timeline_id: int = 0) -> dict[str, DataFrame]:
    """tags, comments, edits and tag_defs of a JSON sidecar keyed by row; keys that are no numbers and the tag ``-`` are left out."""
    raw = spark.read.schema(_SIDECAR).json(path, multiLine=True)
    key = F.lit(timeline_id).cast("long").alias("timeline_id")
    row = F.col("k").try_cast("bigint").alias("row_id")
    tags = raw.select(F.explode("tags").alias("k", "v")).select(key, row, F.explode(F.array_except("v", F.array(F.lit("-")))).alias("tag"))
    comments = raw.select(F.explode("comments").alias("k", "comment")).select(key, row, "comment")
    cells = raw.select(F.explode("edits").alias("k", "v")).select("k", F.explode("v").alias("c", "value"))
    edits = cells.select(key, row, F.col("c").try_cast("int").alias("col"), "value")
    defs = raw.select(F.posexplode("tag_defs").alias("priority", "d")).select("d.name", "d.color", "priority")
    return {
        "tags": tags.where("row_id IS NOT NULL"),
        "comments": comments.where("row_id IS NOT NULL"),
        "edits": edits.where("row_id IS NOT NULL AND col IS NOT NULL"),
        "tag_defs": defs,
    }


def sidecar(tags: DataFrame, comments: DataFrame, edits: DataFrame, tag_defs: DataFrame) -> DataFrame:
    """The sidecar as one JSON text; it is one file for one timeline by its format."""
    row = F.col("row_id").cast("string").alias("k")
    entry = F.concat(F.lit('"'), "k", F.lit('":'), "v")

    def member(order: int, name: str, rows: DataFrame) -> DataFrame:
        """(order, text) of one object keyed by row, from rows (k, v) whose v is JSON."""
        joined = F.array_join(F.array_sort(F.collect_list(entry)), ",")
        return rows.agg(F.lit(order).alias("order"), F.concat(F.lit(f'"{name}":{{'), joined, F.lit("}")).alias("text"))

    a = tags.groupBy(row).agg(F.to_json(F.array_sort(F.collect_set("tag"))).alias("v"))
    b = comments.select(row, F.regexp_replace(F.to_json(F.array("comment")), r"^\[|\]$", "").alias("v"))
    cells = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("col").cast("string"), "value"))))
    c = edits.groupBy(row).agg(F.to_json(cells).alias("v"))
    defs = F.transform(F.array_sort(F.collect_list(F.struct("priority", "name", "color"))), lambda x: F.struct(x["name"].alias("name"), x["color"].alias("color")))
    d = tag_defs.agg(F.lit(3).alias("order"), F.concat(F.lit('"tag_defs":'), F.to_json(defs)).alias("text"))
    parts = member(0, "tags", a).unionByName(member(1, "comments", b)).unionByName(member(2, "edits", c)).unionByName(d)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("order", "text"))), lambda x: x["text"])
    return parts.agg(F.concat(F.lit("{"), F.array_join(texts, ","), F.lit("}")).alias("value"))


def write_sidecar(path: str, **tables: DataFrame) -> None:
    sidecar(**tables).coalesce(1).write.mode("overwrite").text(path)


def read_case(spark: SparkSession, folder: str, timeline_id: int) -> dict[str, DataFrame]:
    """tags (sorted lists), comments and edits of one timeline, and the palette; only its partitions are read."""
    own = lambda n, schema: spark.read.schema(schema).parquet(f"{folder}/{n}").where(F.col("timeline_id") == timeline_id)
    tags = own("tags", TAGS).groupBy("row_id").agg(F.array_sort(F.collect_list("tag")).alias("tags"))
    return {"tags": tags, "comments": own("comments", COMMENTS), "edits": own("edits", EDITS), "tag_defs": spark.read.schema(TAG_DEFS).parquet(f"{folder}/tag_defs")}


def write_case(folder: str, *, timelines: list[int] | None = None, **tables: DataFrame) -> None:
    """Replaces the annotations of the timelines that occur in each table, and of no other.

    A timeline named in ``timelines`` is replaced in every table that is given
    even where it has no rows left: its old partition is removed.
    """
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        if "timeline_id" in df.columns:
            writer = writer.partitionBy("timeline_id").option("partitionOverwriteMode", "dynamic")
        writer.parquet(f"{folder}/{name}")
        if timelines and "timeline_id" in df.columns:
            left = {r["timeline_id"] for r in df.where(F.col("timeline_id").isin(timelines)).select("timeline_id").distinct().collect()}
            for i in set(timelines) - left:
                _remove(df.sparkSession, f"{folder}/{name}/timeline_id={i}")


def _remove(spark: SparkSession, path: str) -> None:
    """A folder removed through Hadoop's file systems, wherever it lies."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(conf).delete(found, True)
