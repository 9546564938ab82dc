import hashlib
import heapq
import random
import re
import zlib

from tidemark.llm import repair


def cheapest(rows, limit=200_000):
    """Least cost and least edits by uniform-cost search over (cost, edits), without a table of failed states."""
    heap = [(0, "", 0, "")]
    done = set()
    while heap:
        cost, edits, at, roles = heapq.heappop(heap)
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, edits
        state = (at, roles[-1:], bool(roles))
        if (state, cost) in done and (state, cost, edits) not in done:
            continue
        done |= {(state, cost), (state, cost, edits)}
        options = [("I", 3, at, roles + r) for r in "ua"]
        if at < len(rows):
            initial, fault = rows[at]
            options.append(("D", 4, at + 1, roles))
            if fault not in "bd":
                more = 3 if fault == "t" else 0
                options.append(("K", more, at + 1, roles + initial))
                options += [("R", 3 + more, at + 1, roles + r) for r in "ua"]
        for edit, more, then, now in options:
            if re.fullmatch("s?(ua)*u?", now) and cost + more <= 4 * len(rows):
                heapq.heappush(heap, (cost + more, edits + edit, then, now))
    raise AssertionError


def test_search_finds_the_least_edits():
    rng = random.Random(3)
    for n in (*range(9), 12):
        for _ in range(40):
            rows = [rng.choice("suuuaaax") + rng.choice("....tbd") for _ in range(n)]
            assert repair.Repairs().edits(rows) == cheapest(rows), rows


def test_blocks_give_what_one_search_gives(monkeypatch):
    rng = random.Random(4)
    for n in (5, 20, 45):
        for _ in range(15):
            rows = [rng.choice("suuuaaax") + rng.choice("......tbd") for _ in range(n)]
            monkeypatch.setattr(repair, "BLOCK", 1000)
            whole = repair.Repairs().edits(rows)
            monkeypatch.setattr(repair, "BLOCK", 3)
            assert repair.Repairs().edits(rows) == whole


def test_long_conversations_take_linear_time():
    rng = random.Random(5)
    rows = [rng.choice("ua") + rng.choice("......tbd") for _ in range(20_000)]
    cost, edits = repair.Repairs().edits(rows)
    assert sum(e != "I" for e in edits) == len(rows)
    assert cost == sum({"D": 4, "I": 3, "R": 3, "K": 0}[e] for e in edits) + 3 * sum(e in "KR" and r[1] == "t" for e, r in zip(edits.replace("I", ""), rows, strict=True))


def plain(table):
    """The query's rows by its definition, one conversation after the other."""
    groups = {}
    for conv, turn, role, text in table:
        rows = groups.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        rows += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, coded = set(), []
        for _, role, text in rows:
            words = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "b" if not words else "d" if (role, text) in seen else "." if words[-1] in ".!?" else "t"
            seen.add((role, text))
            coded.append((role[:1] or "\0") + fault)
        turns = [r[0] for r in rows if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit = cheapest(coded)
        lines, at, state = [], 0, ""
        for edit in audit:
            due = "user" if state in ("", "s", "a") else "assistant"
            if edit == "I":
                lines.append(due + ":")
            elif edit != "D":
                lines.append((rows[at][1] if edit == "K" else due) + ":" + rows[at][2])
            at += edit != "I"
            state = lines[-1][0] if lines else ""
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(coded[:-1], coded[1:], strict=True))
        counts = [sum(c[1] == f for c in coded) for f in "bdt"]
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def result(spark, tmp_path, rows):
    schema = "conv_id bigint, turn bigint, role string, text string, conv string, place string, step int"
    spark.createDataFrame([(*r, "x", "y", 1) for r in rows], schema).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    found = repair.op12_conversation_repair(spark, str(tmp_path)).collect()
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    assert len({r["conv_id"] for r in found}) == len(found)
    return {r["conv_id"]: tuple(r[n] for n in names) for r in found}


def test_query_against_its_definition(spark, tmp_path):
    rng = random.Random(6)
    texts = ["Yes.", "No!", "and then", "", " \t\n", "Why?", "a. b", "déjà vu.", None, "x" * 70_000 + "."]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None]
    rows = []
    for conv in [*range(60), None]:
        n = rng.randint(1, 9)
        for turn in range(n):
            shown = None if rng.random() < 0.1 else turn + (rng.random() < 0.1) * 2
            rows.append((conv, shown, rng.choice(roles), rng.choice(texts) or rng.choice(texts)))
    rows += rows[5:9]
    assert result(spark, tmp_path, rows) == plain(rows)


def test_one_conversation_over_many_tasks(spark, tmp_path):
    rows = [(7, k, "user" if k % 2 == 0 else "assistant", f"Line {k}.") for k in range(700)] + [(8, 0, "user", "Hi."), (8, 1, "assistant", "Hi.")]
    found = result(spark, tmp_path, rows)
    assert len(found[7][6].replace("I", "")) == sum({0: 0, 3: 2}.get(zlib.crc32(f"7:{k}".encode()) % 20, 1) for k in range(700))
    repairs = repair.Repairs()
    coded = []
    for _, k, role, text in rows[:700]:
        kind = zlib.crc32(f"7:{k}".encode()) % 20
        if kind:
            role = "user" if kind == 4 else role
            coded.append(role[0] + {1: "b", 2: "t"}.get(kind, "."))
            coded += [role[0] + "d"] * (kind == 3)
    assert found[7][5:7] == repairs.edits(coded)


def test_empty_table(spark, tmp_path):
    assert result(spark, tmp_path, []) == {}
