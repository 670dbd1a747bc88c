"""Conversation repair against a search over all edits."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from deltaloom.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string"


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        solid = re.sub(r"[ \t-\r]+$", "", text)
        out.append("blank" if not re.search(r"[^\x20\x09-\x0D]", text) else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def repair_by_force(rows):
    """(cost, audit, repaired lines): the first whole and legal edit in the order of cost and audit."""
    told = faults(rows)
    heap, done = [(0, "", 0, ())], set()
    while heap:
        cost, audit, at, out = heapq.heappop(heap)
        initials = "".join(role[:1] or "-" for role, _ in out)
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            return cost, audit, ["user:" if role == "user+" else "assistant:" if role == "assistant+" else f"{role}:{text}" for role, text in out]
        if not re.fullmatch("s?(ua)*u?", initials) or (at, initials) in done:
            continue
        done.add((at, initials))
        for role in ("user+", "assistant+"):
            heapq.heappush(heap, (cost + 2, audit + "I", at, (*out, (role, ""))))
        if at < len(rows):
            (role, text), more = rows[at], told[at] == "truncated"
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, out))
            if told[at] not in ("blank", "duplicate"):
                heapq.heappush(heap, (cost + more, audit + "K", at + 1, (*out, (role, text))))
                for new in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 2 + more, audit + "R", at + 1, (*out, (new, text))))


def report_by_force(ids, rows):
    """rows: (conv_id, turn, role, text) after damage."""
    rows = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    out = []
    for conv in ids:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).digest()))
        turns = [t for _, t, _, _ in own if t is not None]
        plain = [(role, text) for _, _, role, text in own]
        told = faults(plain)
        initials = [role[:1] for role, _ in plain]
        cost, audit, lines = repair_by_force(plain)
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(told.count(x) for x in ("blank", "duplicate", "truncated")), sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def damage_by_force(rows):
    out = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        hit = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        out += [(c, t, "user" if hit == 4 else role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    return out


def conversations(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randrange(1, 7)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "u", "", None])
            rows.append((conv, rng.choice([turn, turn, turn * 3, None, -turn]), role, rng.choice(["Yes.", "Why?", "no end", "A. b", "wow! \n", "x. y\t", "", " \n\t\x0b", "é\x85", None, "Yes."])))
    return rows


@pytest.mark.parametrize(("seed", "span", "group"), [(1, 16, 16), (2, 2, 2), (3, 1, 3)])
def test_reports_and_digests(spark, seed, span, group):
    rows = conversations(seed)
    turns = spark.createDataFrame(rows, SCHEMA).repartition(3)
    ids = sorted({r[0] for r in rows})
    got = sorted((tuple(r) for r in C.repair_report(turns, turns, span, group).collect()), key=str)
    assert got == report_by_force(ids, rows)


def test_damage_and_conversations_without_rows(spark):
    rows = conversations(5, 100) + [(None, 0, "user", "Hi."), (None, 1, "assistant", "Ho.")] + [(c, 0, "user", "Only one.") for c in range(1000, 1060)]
    turns = spark.createDataFrame(rows, SCHEMA).repartition(3)
    damaged = damage_by_force(rows)
    assert sorted(map(tuple, C.damaged(turns).collect()), key=str) == sorted(damaged, key=str)
    want = report_by_force({r[0] for r in rows}, damaged)
    assert ("", hashlib.sha256(b"").hexdigest()) in [r[-2:] for r in want]
    assert sorted((tuple(r) for r in C.repair_report(turns, C.damaged(turns)).collect()), key=str) == want


def test_long_conversations_are_dealt_out(spark):
    """Pieces by turns, pieces cut by rows (many rows of one turn), and repeated rows at the cuts: as one recursion would."""
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"{t}.") for t in range(1500) if t % 7]
    rows += [(2, 5, ("user", "assistant")[i % 3 % 2], f"line {i}.") for i in range(700)] + [(3, None, "user", "Again.")] * 600 + [(4, 0, "user", "One."), (4, 1, "assistant", "Two.")]
    turns = spark.createDataFrame(rows, SCHEMA).repartition(3)
    moves = C.grammar()
    ends = C.closing()
    got = {r.conv_id: r for r in C.repair_report(turns, turns, 16, 3).collect()}
    for conv in (1, 2, 3, 4):
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
        told = faults([r[2:] for r in own])
        best = {0: (0, "")}
        for (_, _, role, _), fault in zip(own, told, strict=True):
            forced, new = fault in ("blank", "duplicate"), {}
            for source, dest, op, opens, cost, audit in moves:
                if source in best and (op == "D" or not forced and (op == "R" or opens == role[0])):
                    new[dest] = min(new.get(dest, (10**9, "")), (best[source][0] + cost, best[source][1] + audit))
            best = new
        assert (got[conv].cost, got[conv].audit) == min((c + ends[s][0], a + ends[s][1]) for s, (c, a) in best.items())
        assert got[conv].duplicate == told.count("duplicate")
    assert got[3].audit.count("D") == 599


def test_repaired_turns(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Well"), (1, 2, "system", ""), (1, 3, "assistant", "Bye."), (2, 0, "assistant", "")]
    got = [tuple(r) for r in C.repaired(spark.createDataFrame(rows, SCHEMA)).orderBy("conv_id", "place").collect()]
    cost, audit, lines = repair_by_force([r[2:] for r in rows[:4]])
    assert [f"{role}:{text}" for _, _, role, text, _ in got] == lines and [c for c, *_ in got] == [1] * len(lines)
    assert [e for *_, e in got] == [x for x in audit if x != "D"]


def test_odd_tables(spark):
    rows = conversations(9, 12)
    turns = spark.createDataFrame(rows, SCHEMA)
    clash = turns.select("*", *(F.lit("x").alias(c) for c in ("key", "seg", "audit", "kind", "place", "digest")))
    expect = sorted(map(tuple, C.repair_report(turns, turns).collect()), key=str)
    assert sorted(map(tuple, C.repair_report(clash, clash).collect()), key=str) == expect
    none = spark.createDataFrame([], SCHEMA)
    assert C.repair_report(none, none).count() == 0 and C.repaired(none).count() == 0
    long = spark.createDataFrame([(1, 0, "user", "word. " * 200_000), (1, 1, "assistant", "ok.")], SCHEMA)
    assert C.repair_report(long, long).first().audit == "KK"
    named = spark.createDataFrame([("a=b", 0, "user", "Hi."), (None, 0, "user", "Hi."), ("", 0, "user", "Hi.")], "conv_id string, turn long, role string, text string")
    assert sorted(map(str, (r.conv_id for r in C.repair_report(named, named).collect()))) == ["", "None", "a=b"]


def test_registered_query_and_its_sql(spark):
    import duckdb

    from deltaloom.llm import queries

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{sf}/conversations.parquet')")
    got, want = queries.op12_repair(spark, sf).toArrow(), con.sql(queries.ORACLES["op12_repair"]).to_arrow_table()
    assert {f.name: str(f.type) for f in got.schema} == {f.name: str(f.type) for f in want.schema}
    key = lambda r: r["conv_id"]
    assert sorted(got.to_pylist(), key=key) == sorted(want.select(got.column_names).to_pylist(), key=key)
