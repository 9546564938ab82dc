"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The white space of the word definition: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir`` (any path that Spark can read)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text with null read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a checkpoint in the shared folder that the session names.

    ``spark.checkpoint.dir`` is read from the session; a folder of our own is
    set only where it is unset, which happens in tests on one machine.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", None) and sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    return df.checkpoint()


def keyed(docs: DataFrame, column: str = "doc_id") -> DataFrame:
    """``docs`` with ``rid``: a unique long for each row, in the order of ``doc_id``.

    Where ``doc_id`` is unique and never null, ``rid`` is ``doc_id``. Otherwise
    the rows are sorted by (doc_id with nulls first, text) and numbered by
    ``monotonically_increasing_id``, cut by a checkpoint so that a task that
    runs again sees the same numbers. Rows that are equal in both stay two rows.
    """
    ids = docs.groupBy(column).count()
    odd = ids.where(F.col(column).isNull() | (F.col("count") > 1)).limit(1).count()
    if not odd:
        return docs.withColumn("rid", F.col(column).cast("long"))
    ordered = docs.orderBy(F.col(column).asc_nulls_first(), F.col("text").asc_nulls_first())
    return cut(ordered.withColumn("rid", F.monotonically_increasing_id()))


def saved(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet below the shared checkpoint folder, and read again.

    Like :func:`cut`, but columnar and compressed. The files stay until the
    folder is cleared, as later reads need them if an executor is lost.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-")
    path = f"{folder.rstrip('/')}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fenced(df: DataFrame, keep: Column) -> DataFrame:
    """Rows of ``df`` where ``keep`` holds, decided after the columns of ``df`` are computed.

    A filter over columns that long expressions define is otherwise moved below
    them, with every expression written out in full. The random column, which
    is never negative, holds it in place and changes no result.
    """
    return df.withColumn("_fence", F.rand()).where(keep & (F.col("_fence") >= 0)).drop("_fence")


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, least: int) -> Iterator[pa.Table]:
    """Batches sorted by ``key`` as tables of at least ``least`` rows (but the last) that end where the key changes; each batch is looked at once."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        before = held[-1].column(key)[-1].as_py() if held else keys[-1]
        if n + cut >= least and (cut or before != keys[-1]):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
            held, n = [batch.slice(cut)], batch.num_rows - cut
        else:
            held.append(batch)
            n += batch.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def placed(df: DataFrame, group: str, order: list[Column], ranges: list[Column] | None = None) -> DataFrame:
    """``df``, saved, with ``place``: 0, 1, ... within the rows of equal ``group`` in ``order`` (nulls first).

    Rows are sorted by range, so a group of any size is spread over tasks; rows
    are numbered within their partition as they stream by. Only the first group
    of a partition can have begun in an earlier one, so the table of what is to be
    added holds a row for each partition at most, and is broadcast.
    """
    ranged = df.repartitionByRange(F.col(group), *order).sortWithinPartitions(F.col(group), *order)
    ranged = ranged.withColumns({"_part": F.spark_partition_id(), "_at": F.lit(0).cast("long")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(group)
            codes = keys.dictionary_encode(null_encoding="encode").indices.to_numpy()
            head = np.concatenate([[True], codes[1:] != codes[:-1]])
            at = np.arange(len(codes)) - np.maximum.accumulate(np.where(head, np.arange(len(codes)), 0))
            if count and keys[0].as_py() == last:
                until = int(np.argmax(head[1:])) + 1 if head[1:].any() else len(head)
                at[:until] += count
            last, count = keys[-1].as_py(), int(at[-1]) + 1
            yield batch.set_column(batch.schema.get_field_index("_at"), batch.schema.field("_at"), pa.array(at, pa.int64()))

    kept = saved(ranged.mapInArrow(run, ranged.schema))
    counts = kept.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    shifts = counts.withColumn("_before", before).where("_before > 0").select(F.col(group).alias("_group"), F.col("_part").alias("_in"), "_before")
    joined = kept.join(F.broadcast(shifts), F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_in")), "left")
    return joined.withColumn("place", F.col("_at") + F.coalesce("_before", F.lit(0))).drop("_part", "_at", "_group", "_in", "_before")
