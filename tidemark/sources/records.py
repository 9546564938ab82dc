"""Records of delimited files, read by many tasks under one rule for cells.

A quote opens a quoted cell only at the beginning of a cell; a doubled quote is a
quote, line breaks belong to the cell, and what follows the closing quote is
taken as it is. Every physical line that does not lie within a quoted cell is
a record, blank ones too.

A file is read by physical lines, which Spark splits among tasks, and nobody
knows whether a block of it begins inside a quoted cell. So each line is judged
for both cases (does it end inside a quoted cell if it starts outside, and if it
starts inside), and each block is the product of its lines: the state that it ends in and the
records that begin in it, for both cases, in one row. Running over the blocks of a file, a small
table, gives the state in which each begins and the number of its first record; then the lines of a block are joined to records. A record
that goes on in the next block is put together from its parts, which are two for
each block at most. A quoted cell that is never closed would make a record of the rest of its
file; more than ``MOST_CHARS`` characters in one record are an error that names the file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Characters of one record; more are an error.
MOST_CHARS = 64_000_000
#: The rest of a quoted cell, up to and with the quote that ends it.
_REST = r'[^"]*+(?:""[^"]*+)*+"'
_STATES = "_file string, _block bigint, outside int, inside int, from_outside bigint, from_inside bigint"
_RECORDS = "_file string, _block bigint, n bigint, value string, open boolean"


def _class(delimiter: str) -> str:
    return "\\t" if delimiter == "\t" else "\\" + delimiter


def cell_pattern(delimiter: str) -> str:
    """A delimiter and the cell behind it as group 1; a quote that is never closed takes the rest."""
    d = _class(delimiter)
    return rf'{d}("{_REST}[^{d}]*+|[^"{d}][^{d}]*+|"[\s\S]*+|)'


def cells(value: Column, delimiter: str) -> Column:
    """The cells of a record without their quotes."""
    found = F.regexp_extract_all(F.concat(F.lit(delimiter), value), F.lit(cell_pattern(delimiter)), F.lit(1))
    inner = lambda x: F.regexp_extract(x, rf'^"({_REST[:-1]})"?', 1)
    tail = lambda x: F.substring(x, F.length(inner(x)) + 3, F.length(x))
    quoted = lambda x: F.concat(F.replace(inner(x), F.lit('""'), F.lit('"')), tail(x))
    unquoted = F.transform(found, lambda x: F.when(x.startswith('"'), quoted(x)).otherwise(x))
    # Without a quote the rule is to cut at the delimiters.
    return F.when(F.contains(value, F.lit('"')), unquoted).otherwise(F.split(value, _class(delimiter), -1))


def _patterns(delimiter: str) -> tuple[str, str]:
    """What a line matches that ends outside, if it starts outside, and if it starts inside."""
    d = _class(delimiter)
    cell = rf'(?:"{_REST}[^{d}]*+|[^"{d}][^{d}]*+|)'
    return rf"^{cell}(?:{d}{cell})*+", rf"^{_REST}[^{d}]*+(?:{d}{cell})*+"


def first_record(lines: list[str], delimiter: str) -> str | None:
    """The record that begins with the first of ``lines``; null if it does not end in them."""
    outside, inside = (re.compile(p + r"\Z") for p in _patterns(delimiter))
    state = False
    for k, line in enumerate(lines):
        state = not (inside if state else outside).match(line)
        if not state:
            return "\n".join(lines[: k + 1]).removesuffix("\r")
    return None


def _lines(spark: SparkSession, path: str, delimiter: str) -> DataFrame:
    outside, inside = (p + r"\z" for p in _patterns(delimiter))
    text = spark.read.text(path, lineSep="\n")
    quote = F.contains("value", F.lit('"'))
    return text.select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        "value",
        F.when(quote, (~F.col("value").rlike(outside)).cast("int")).otherwise(0).alias("outside"),
        F.when(quote, (~F.col("value").rlike(inside)).cast("int")).otherwise(1).alias("inside"),
    )


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch that lie in one block of one file."""
    files, blocks = batch.column("_file").dictionary_encode(), batch.column("_block").to_numpy()
    code = files.indices.to_numpy()
    cuts = np.flatnonzero((code[1:] != code[:-1]) | (blocks[1:] != blocks[:-1])) + 1
    for a, b in zip([0, *cuts], [*cuts, len(blocks)], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def _states(start: np.ndarray, outside: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """The state behind each line (1: inside), for each of the states in ``start``."""
    fixed, swaps = outside == inside, np.cumsum(outside > inside)
    last = np.maximum.accumulate(np.where(fixed, np.arange(len(fixed)), -1))
    known = np.where(last >= 0, outside[last], start[:, None])
    return known ^ ((swaps - np.where(last >= 0, swaps[last], 0)) & 1)


_STATE_TYPES = pa.schema([("_file", pa.string()), ("_block", pa.int64()), ("outside", pa.int32()), ("inside", pa.int32()), ("from_outside", pa.int64()), ("from_inside", pa.int64())])


def _block_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block the states that it ends in, and the records that begin in it."""
    key, state, begun = None, np.array([0, 1]), np.zeros(2, np.int64)

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(_STATE_TYPES.names, (*key, *state.tolist(), *begun.tolist()), strict=True))], _STATE_TYPES)

    for batch in batches:
        for run in _runs(batch):
            own = run.column("_file")[0].as_py(), run.column("_block")[0].as_py()
            if own != key:
                if key:
                    yield row()
                key, state, begun = own, np.array([0, 1]), np.zeros(2, np.int64)
            after = _states(state, run.column("outside").to_numpy(), run.column("inside").to_numpy())
            begun = begun + (state == 0) + (after[:, :-1] == 0).sum(axis=1)
            state = after[:, -1]
    if key:
        yield row()


def blocks(spark: SparkSession, path: str, delimiter: str) -> DataFrame:
    """_file, _block, start and behind (the states that a block begins and ends in), records (that begin in it) and before (records of earlier blocks and files): a row for each block."""
    ends = _lines(spark, path, delimiter).drop("value").mapInArrow(_block_states, _STATES)
    fixed, swap = F.col("outside") == F.col("inside"), (F.col("outside") > F.col("inside")).cast("int")
    upto = W.partitionBy("_file").orderBy("_block").rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy("_file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.withColumn("swaps", F.sum(swap).over(upto))
    known = F.last(F.when(fixed, F.struct("outside", "swaps")), ignorenulls=True).over(before)
    ends = ends.withColumn("known", known).withColumn("swapped", F.coalesce(F.sum(swap).over(before), F.lit(0)))
    start = (F.coalesce(F.col("known.outside"), F.lit(0)) + F.col("swapped") - F.coalesce(F.col("known.swaps"), F.lit(0))) % 2
    starts = ends.select("_file", "_block", start.cast("int").alias("start"), "outside", "inside", "from_outside", "from_inside")
    starts = starts.withColumn("behind", F.when(F.col("start") == 0, F.col("outside")).otherwise(F.col("inside")))
    starts = starts.withColumn("records", F.when(F.col("start") == 0, F.col("from_outside")).otherwise(F.col("from_inside")))
    all_before = F.sum("records").over(W.orderBy("_file", "_block").rowsBetween(W.unboundedPreceding, -1))
    return starts.select("_file", "_block", "start", "behind", "records", F.coalesce(all_before, F.lit(0)).alias("before"))


def _without_returns(values: pa.Array) -> pa.Array:
    ends = pc.ends_with(values, "\r")
    return pc.if_else(ends, pc.utf8_slice_codeunits(values, 0, -1), values) if pc.any(ends).as_py() else values


def _joined(most: int):
    """Lines with the state that their block begins in to records: n from 1, or 0 for what belongs to a record of an earlier block."""
    types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
    names = ["_file", "_block", "n", "value", "open"]

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, n, head, held, size = None, 0, 0, False, [], 0
        out: list[tuple] = []

        def close(open_: bool) -> None:
            """The lines held so far are a record, its first part, or what belongs to a record of an earlier block."""
            nonlocal n, head, size
            value = "\n".join(held) if open_ else "\n".join(held).removesuffix("\r")
            n += not head
            out.append((*key, 0 if head else n, value, open_))
            head, size = False, 0
            held.clear()

        def rows() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for batch in batches:
            for run in _runs(batch):
                own = run.column("_file")[0].as_py(), run.column("_block")[0].as_py()
                if own != key:
                    if held:
                        close(True)
                    key, state, n = own, run.column("start")[0].as_py(), 0
                    head = bool(state)
                after = _states(np.array([state]), run.column("outside").to_numpy(), run.column("inside").to_numpy())[0]
                if not state and not after.any():  # every line is a record
                    yield rows()
                    count = run.num_rows
                    numbers = pa.array(np.arange(n + 1, n + count + 1), pa.int64())
                    yield pa.RecordBatch.from_arrays([run.column("_file").cast(pa.string()), run.column("_block"), numbers, _without_returns(run.column("value").cast(pa.string())), pa.array(np.zeros(count, bool))], names)
                    n += count
                    continue
                for line, inside in zip(run.column("value").to_pylist(), after.tolist(), strict=True):
                    held.append(line)
                    size += len(line) + 1
                    if size > most:
                        raise ValueError(f"{key[0]}: a record of more than {most} characters; is a quote not closed?")
                    if not inside:
                        close(False)
                state = int(after[-1])
            yield rows()
        if held:
            close(True)
        yield rows()

    return run_


def read_records(spark: SparkSession, path: str, delimiter: str, starts: DataFrame) -> DataFrame:
    """_file, _block, n (from 1 in each block), value and number (from 0 over all files) of every record; ``starts`` are the :func:`blocks`."""
    lines = _lines(spark, path, delimiter)

    def found(of: DataFrame) -> DataFrame:
        # A row for each block, that is for each task.
        begun = of.select("_file", "_block", "start")
        return lines.join(F.broadcast(begun), ["_file", "_block"]).mapInArrow(_joined(MOST_CHARS), _RECORDS)

    def numbered(records: DataFrame) -> DataFrame:
        return records.join(F.broadcast(starts.select("_file", "_block", "before")), ["_file", "_block"]).withColumn("number", F.col("before") + F.col("n") - 1).drop("before")

    whole = found(starts).where("NOT open AND n > 0").select("_file", "_block", "n", "value")
    # Parts of records that cross blocks: each belongs to the last record that was left open before it. Only blocks
    # that begin or end inside a quoted cell have any, so the lines of the others are not joined to records again.
    crossing = starts.where("start = 1 OR behind = 1")
    if crossing.isEmpty():
        return numbered(whole)
    parts = found(crossing).where("open OR n = 0")
    order = W.partitionBy("_file").orderBy("_block", "n").rowsBetween(W.unboundedPreceding, 0)
    owner = F.last(F.when(F.col("n") > 0, F.struct("_block", "n")), ignorenulls=True).over(order)
    parts = parts.withColumn("owner", owner)
    upto = W.partitionBy("_file", "owner").orderBy("_block", "n").rowsBetween(W.unboundedPreceding, 0)
    long = F.raise_error(F.concat("_file", F.lit(f": a record of more than {MOST_CHARS} characters; is a quote not closed?"))).cast("string")
    parts = parts.withColumn("value", F.when(F.sum(F.length("value")).over(upto) > MOST_CHARS, long).otherwise(F.col("value")))
    joined = parts.groupBy("_file", "owner").agg(F.array_sort(F.collect_list(F.struct("_block", "n", "value"))).alias("p"))
    value = F.regexp_replace(F.array_join(F.transform("p", lambda x: x["value"]), "\n"), r"\r\z", "")
    return numbered(whole.unionByName(joined.select("_file", "owner._block", "owner.n", value.alias("value"))))
