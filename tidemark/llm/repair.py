"""Conversation structure repair by iterative-deepening A*.

Rows of a conversation are judged (blank, duplicate, truncated) and repaired by
the cheapest edits: Keep, Rerole, Delete and Insert, until the roles read
``(s?(ua)+)?``. The search tries edits in ASCII order, depth first, under a cost
bound that grows to the least cost that exceeded it, so the first path that is
accepted is the cheapest one, and the least in ASCII order among those. States
that failed are kept in a table with the least that they are known to cost, which
prunes them from then on.

The search goes over ``BLOCK`` rows at once. A longer conversation is taken from its
end: the costs of what lies behind a block, for each of the four states of the
grammar, are exact, and are the estimate at the block's end. So the work grows with the
number of rows, and the answer is that of one search over the whole: an edit
string is never the beginning of another one for the same rows.

Rows are ordered by ranges and numbered (no conversation is one task's work),
equal rows are found by an aggregate, and a search sees two characters for each row, in strings of
``PART`` rows. The digest of a repaired conversation is a hash of one text and so is
computed by one task, row by row, holding none of it.

Edge cases: null conv_id is a conversation; null role and text count as one
space (a role of its own, and blank); rows with equal turns are ordered by role,
then text; repeated rows are duplicates of the first; an empty role has no legal
place; roles are told by their first character; turns that are null come first and
count in no gap; a conversation that lost all rows has an empty audit; an empty table gives an empty
result; only the four named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, placed, saved, table

BLOCK, PART = 32, 256
#: Searches that a task remembers.
MEMORY = 200_000
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States: nothing yet, after system, after user, after assistant; what comes next in each, and what may be kept.
NEXT = (("u", 2), ("u", 2), ("a", 3), ("u", 2))
KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: Costs behind the last row: a lone system needs two rows, a user one.
END = (0, 2 * INSERT, INSERT, 0)
#: Character for a role that is empty.
NO_ROLE = "\0"


class Search:
    """One block: ``rows`` of (role initial, fault) pairs, and the exact costs behind it by state."""

    def __init__(self, rows: list[str], behind: tuple[int, ...]) -> None:
        self.rows, self.behind = rows, behind
        least = {"b": DELETE, "d": DELETE, "t": TRUNCATED, ".": 0}
        self.estimate = [min(behind)]
        for row in reversed(rows):
            self.estimate.append(self.estimate[-1] + least[row[1]])
        self.estimate.reverse()
        self.table: dict[tuple[int, int], int] = {}
        self.path: list[str] = []

    def moves(self, at: int, state: int) -> Iterator[tuple[str, int, int, int]]:
        """Edits in ASCII order: name, cost, next row, next state."""
        initial, fault = self.rows[at]
        yield "D", DELETE, at + 1, state
        yield "I", INSERT, at, NEXT[state][1]
        if fault in "bd":
            return
        more = TRUNCATED if fault == "t" else 0
        if initial in KEPT[state]:
            yield "K", KEEP + more, at + 1, KEPT[state][initial]
        yield "R", REROLE + more, at + 1, NEXT[state][1]

    def within(self, at: int, state: int, left: int) -> int:
        """-1 and the path (backwards) if ``left`` is enough, else a lower bound of what is needed."""
        if at == len(self.rows):
            return -1 if self.behind[state] <= left else self.behind[state]
        need = self.table.get((at, state), self.estimate[at])
        if need > left:
            return need
        least = 1 << 60
        for edit, cost, then, into in self.moves(at, state):
            found = self.within(then, into, left - cost) if cost <= left else self.table.get((then, into), self.estimate[then])
            if found < 0:
                self.path.append(edit)
                return -1
            least = min(least, cost + found)
        self.table[at, state] = max(need, least)
        return self.table[at, state]

    def run(self, state: int) -> tuple[int, str]:
        """The least cost from ``state``, and the edits of this block."""
        bound = self.estimate[0]
        while (need := self.within(0, state, bound)) >= 0:
            bound = need
        edits = "".join(reversed(self.path))
        self.path.clear()
        return bound, edits


class Repairs:
    """Cheapest edits of conversations; blocks that recur are searched once."""

    def __init__(self) -> None:
        self.known: dict[tuple, tuple[int, str]] = {}

    def block(self, rows: list[str], state: int, behind: tuple[int, ...]) -> tuple[int, str]:
        low = min(behind)
        key = ("".join(rows), state, tuple(b - low for b in behind))
        if key not in self.known:
            if len(self.known) >= MEMORY:
                self.known.clear()
            self.known[key] = Search(rows, key[2]).run(state)
        cost, edits = self.known[key]
        return cost + low, edits

    def edits(self, rows: list[str]) -> tuple[int, str]:
        """Cost and edits of a conversation of (role initial, fault) pairs."""
        rows = [(r[0] if r[0] in "sua" else "-") + r[1] for r in rows]
        blocks = [rows[k : k + BLOCK] for k in range(0, len(rows), BLOCK)]
        behind = [END]
        for block in reversed(blocks[1:]):
            behind.append(tuple(self.block(block, state, behind[-1])[0] for state in range(4)))
        behind.reverse()
        cost, state, out = 0, 0, []
        for k, block in enumerate(blocks):
            found, edits = self.block(block, state, behind[k])
            cost = cost if k else found
            out.append(edits)
            for _, _, state in walk(block, edits, state):
                pass
        return cost, "".join(out) + "I" * (END[state] // INSERT)


def walk(rows: list[str], edits: str, state: int = 0) -> Iterator[tuple[int, str, int]]:
    """Row, what becomes of it (k, d, u, a; inserted rows: U, A, at the row that they stand before) and the state after each edit."""
    at = 0
    for edit in edits:
        if edit == "D":
            yield at, "d", state
        elif edit == "K":
            state = KEPT[state][rows[at][0]]
            yield at, "k", state
        else:
            role, state = NEXT[state]
            yield at, role.upper() if edit == "I" else role, state
        at += edit != "I"


def damaged(conversations: DataFrame) -> DataFrame:
    """conv, turn, role, text and copy: the rows of the query, with every twentieth of each kind of damage."""
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = tidy(conversations).withColumn("kind", F.crc32(name) % 20).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copy = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copy.alias("copy"))


def tidy(conversations: DataFrame) -> DataFrame:
    """conv_id, conv (the same as text, told from null), turn, role and text of a table of conversations."""
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    filled = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    return conversations.select("conv_id", conv.alias("conv"), F.col("turn").cast("long").alias("turn"), *filled)


_FOUND = "conv string, part bigint, steps array<string>, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
_FOUND_TYPES = [pa.string(), pa.int64(), pa.list_(pa.string()), *[pa.int64()] * 5, pa.string()]
_FOUND_NAMES = ["conv", "part", "steps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]


def _record(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def _repaired(conv: str, packed: str, repairs: Repairs) -> Iterator[tuple]:
    """A row for each part of a conversation; the first one has the totals."""
    rows = [packed[k : k + 2] for k in range(0, len(packed), 2)]
    cost, audit = repairs.edits(rows)
    steps = [""] * len(rows)
    for at, step, _ in walk(rows, audit):
        steps[min(at, len(rows) - 1)] += step
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(rows[:-1], rows[1:], strict=True))
    totals = (*(sum(r[1] == fault for r in rows) for fault in "bdt"), illegal, cost, audit)
    for part in range(-(-len(rows) // PART)):
        yield (conv, part, steps[part * PART : (part + 1) * PART], *(totals if part == 0 else (None,) * 6))


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    repairs, rows, conv, parts = Repairs(), [], None, []
    for batch in batches:
        for name, packed in zip(batch.column("conv").to_pylist(), batch.column("packed").to_pylist(), strict=True):
            if parts and name != conv:
                rows.extend(_repaired(conv, "".join(parts), repairs))
                parts = []
            if len(rows) >= 2_000:
                yield _record(rows, _FOUND_NAMES, _FOUND_TYPES)
                rows = []
            conv = name
            parts.append(packed)
    if parts:
        rows.extend(_repaired(conv, "".join(parts), repairs))
    yield _record(rows, _FOUND_NAMES, _FOUND_TYPES)


def lines(step: str, role: str, text: str) -> Iterator[str]:
    """The lines that a row becomes."""
    for c in step:
        if c in "UA":
            yield "user:" if c == "U" else "assistant:"
        elif c != "d":
            yield {"k": role, "u": "user", "a": "assistant"}[c] + ":" + text


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (conv, place, kind), each step before its row, to a digest for each conversation."""
    rows, conv, digest, first, step = [], None, None, True, ""
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("conv", "kind", "role", "text", "step"))
        for name, kind, role, text, given in zip(*columns, strict=True):
            if digest is None or name != conv:
                if digest is not None:
                    rows.append((conv, digest.hexdigest()))
                conv, digest, first = name, hashlib.sha256(), True
            if kind == 0:
                step = given
                continue
            for line in lines(step, role, text):
                digest.update(("" if first else "\n").encode() + line.encode())
                first = False
        yield _record(rows, ["conv", "repaired_sha256"], [pa.string(), pa.string()])
        rows = []
    if digest is not None:
        rows.append((conv, digest.hexdigest()))
    yield _record(rows, ["conv", "repaired_sha256"], [pa.string(), pa.string()])


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` (conv, turn, role, text, copy) in order with their places, and the repair of each conversation in parts of rows (steps, and in part 0 the totals)."""
    order = [F.col("turn"), F.col("role"), F.col("text"), F.col("copy")]
    kept = placed(rows, "conv", order, [F.col("turn"), F.col("role"), F.left("text", F.lit(64))])
    body = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = F.when(body == "", "b").when(F.right(body, F.lit(1)).isin(".", "!", "?"), ".").otherwise("t")
    initial = F.when(F.col("role") == "", NO_ROLE).otherwise(F.left("role", F.lit(1)))
    same = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    narrow = kept.select("conv", "place", initial.alias("initial"), fault.alias("fault"), same.alias("same"))
    first = narrow.groupBy("conv", "same").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    judged = narrow.join(first, ["conv", "same"], "left")
    code = F.concat("initial", F.when((F.col("fault") != "b") & (F.col("place") > F.col("first")), "d").otherwise(F.col("fault")))
    packed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", code.alias("code")))), lambda x: x["code"]), "")
    packs = judged.groupBy("conv", F.floor(F.col("place") / PART).cast("long").alias("part")).agg(packed.alias("packed"))
    found = packs.repartition("conv").sortWithinPartitions("conv", "part").mapInArrow(_searched, _FOUND)
    return kept, saved(found)


def digests(kept: DataFrame, found: DataFrame) -> DataFrame:
    """conv and the digest of its repaired text."""
    steps = found.select("conv", "part", F.posexplode("steps").alias("at", "step"))
    steps = steps.select("conv", (F.col("part") * PART + F.col("at")).alias("place"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "step")
    texts = kept.select("conv", "place", F.lit(1).alias("kind"), "role", "text", F.lit(None).cast("string").alias("step"))
    both = texts.unionByName(steps).repartition("conv").sortWithinPartitions("conv", "place", "kind")
    return both.mapInArrow(_hashed, "conv string, repaired_sha256 string")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repair of every conversation after damage to its rows."""
    conversations = table(spark, sf_dir, "conversations")
    kept, found = repair(damaged(conversations))
    turns = kept.where("turn IS NOT NULL").groupBy("conv", "turn").count()
    gaps = turns.groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).alias("gaps"))
    out = tidy(conversations).select("conv_id", "conv").distinct()
    for part in (gaps, found.where("part = 0").drop("part", "steps"), digests(kept, found)):
        out = out.join(part, "conv", "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    none = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(none)).alias("repaired_sha256"))


QUERIES = {"op12_conversation_repair": op12_conversation_repair}
ORACLES: dict[str, str] = {}
