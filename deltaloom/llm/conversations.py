"""Conversation structure repair: the cheapest edits that make a conversation's roles fit a grammar.

Role initials have to read `(s?(ua)+)?`. A row is kept (0, a truncated one 1), gets another role (2, a truncated one
3) or is deleted (3; what is blank or a duplicate has to be); empty turns are inserted anywhere (2). Among the cheapest
edits the ASCII-least row of initials D, I, K, R is taken, the audit.

Four states say how what is left so far ends: nothing, a system turn, a user turn, an assistant turn. Rows are
hashed to tasks, and a task's DuckDB holds a batch of many conversations: each step of a recursive query advances
one row of all of them, keeping the least (cost, audit) of each pair of states. As every start state
is followed, a piece of a conversation is a small table of moves between states, and those of neighbouring pieces are
chained by the same query. So a conversation of any length is dealt out in pieces of at most SPAN turns and LENGTH rows,
whose moves meet in a tree. Only its audit and the digest of its text, both sequential, run through one task, as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltaloom.llm.common import one_core, stage, unstage

#: Turn numbers of one piece; rows after which a piece is cut; rows of a DuckDB batch; pieces that meet at once. A step of the
#: recursion reads the whole batch, so short pieces keep the work in proportion to the rows, however long conversations are.
SPAN, LENGTH, BATCH, GROUP = 16, 16, 8192, 16
#: Costs of edits by their initials; what an undeleted truncated row adds.
COSTS, TRUNCATED = {"K": 0, "R": 2, "D": 3, "I": 2}, 1
LEGAL = frozenset({"su", "ua", "au"})
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
#: State after a turn with this initial.
_AFTER = {"s": {_START: _SYSTEM}, "u": dict.fromkeys((_START, _SYSTEM, _ASSISTANT), _USER), "a": {_USER: _ASSISTANT}}
_COUNTS = ["n", "blank", "duplicate", "truncated", "illegal"]

_MOVES = pa.list_(pa.struct([("entry", pa.int32()), ("state", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
_PIECE = pa.schema([("key", pa.string()), ("seg", pa.int64()), ("sub", pa.int32()), *((c, pa.int64()) for c in _COUNTS), ("first", pa.string()), ("last", pa.string()), ("moves", _MOVES)])
_PIECE_SQL = "key string, seg long, sub int, n long, blank long, duplicate long, truncated long, illegal long, first string, last string, moves array<struct<entry:int,state:int,cost:long,audit:string>>"

#: The recursion over steps(item, pos, source, dest, cost, audit), for rows and for pieces alike; of a pair of states it
#: holds the last step's best only.
_ADVANCE = """
with recursive best(item, entry, state, pos, least) using key (item, entry, state) as (
  select item, entry, entry, 0, {'cost': 0::bigint, 'audit': ''} from (select distinct item from steps), range(4) r(entry)
  union all
  select b.item, b.entry, s.dest, b.pos + 1, min({'cost': b.least.cost + s.cost, 'audit': b.least.audit || s.audit})
  from best b join steps s on s.item = b.item and s.pos = b.pos and s.source = b.state
  group by b.item, b.entry, s.dest, b.pos + 1)
select b.item, list({'entry': b.entry::int, 'state': b.state::int, 'cost': b.least.cost, 'audit': b.least.audit} order by b.entry, b.state) as moves
from best b join (select item, max(pos) + 1 as n from steps group by item) l on b.pos = l.n and b.item = l.item group by b.item order by b.item
"""
_ROW_STEPS = """
create or replace temp view steps as
select item, pos, source, dest, cost + case when truncated and op <> 'D' then {truncated} else 0 end as cost, audit
from members join moves on op = 'D' or (not forced and (op = 'R' or opens = initial))
"""
_PIECE_STEPS = """
create or replace temp view steps as
select item, pos, m.entry as source, m.state as dest, m.cost as cost, m.audit as audit from (select item, pos, unnest(moves) as m from members)
"""


def inserted(state: int) -> list[tuple[int, int]]:
    """(state, number of inserted turns) that can follow a state, none included; more would only return to one of them."""
    out = [(state, 0)]
    for n in (1, 2):
        state = _ASSISTANT if state == _USER else _USER
        if state not in [s for s, _ in out]:
            out.append((state, n))
    return out


def grammar() -> list[tuple[int, int, str, str, int, str]]:
    """(source, dest, op, initial that it needs, cost, audit): insertions and then what becomes of one row."""
    out = []
    for source in range(4):
        for state, n in inserted(source):
            before, cost = "I" * n, n * COSTS["I"]
            out.append((source, state, "D", "", cost + COSTS["D"], before + "D"))
            out.append((source, _ASSISTANT if state == _USER else _USER, "R", "", cost + COSTS["R"], before + "R"))
            out += [(source, after[state], "K", initial, cost + COSTS["K"], before + "K") for initial, after in _AFTER.items() if state in after]
    return out


def closing() -> dict[int, tuple[int, str]]:
    """Cost and audit of the insertions that end a conversation in each state."""
    return {s: next((n * COSTS["I"], "I" * n) for end, n in inserted(s) if end in (_START, _ASSISTANT)) for s in range(4)}


class _Pieces:
    """Gathers sorted rows or pieces as pieces of at most LENGTH members; a full batch goes through DuckDB."""

    def __init__(self, steps: str, columns: list[tuple[str, pa.DataType]]):
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "1GB"})
        self.db.execute("create temp table moves(source int, dest int, op varchar, opens varchar, cost bigint, audit varchar)")
        self.db.executemany("insert into moves values (?, ?, ?, ?, ?, ?)", grammar())
        self.steps, self.schema = steps, pa.schema([("item", pa.int64()), ("pos", pa.int64()), *columns])
        self.pieces, self.rows, self.at, self.length = [], [], None, 0

    def start(self, at: tuple, key: str, seg: int | None) -> Iterator[pa.RecordBatch]:
        """Make room for one more row of group `at`: in a new piece if the group is new or the piece is full."""
        if at != self.at or self.length == LENGTH:
            sub = self.pieces[-1]["sub"] + 1 if at == self.at else 0
            if max(len(self.rows), len(self.pieces)) >= BATCH:
                yield self.flush()
            self.at, self.length = at, 0
            self.pieces.append({"key": key, "seg": seg, "sub": sub, **dict.fromkeys(_COUNTS, 0), "first": None, "last": None})

    def add(self, counts: dict[str, int], first: str, last: str, *values) -> None:
        piece = self.pieces[-1]
        for name, n in counts.items():
            piece[name] += n
        if self.length:
            piece["illegal"] += piece["last"] + first not in LEGAL
        else:
            piece["first"] = first
        piece["last"] = last
        self.rows.append((len(self.pieces) - 1, self.length, *values))
        self.length += 1

    def add_piece(self, p: dict) -> None:
        """A piece that meets no other stays as it is; the first of several waits for the second."""
        piece, alone = self.pieces[-1], self.length == 0
        if self.length == 1:
            self.rows.append((len(self.pieces) - 1, 0, piece.pop("moves")))
        self.add({c: p[c] for c in _COUNTS}, p["first"], p["last"], p["moves"])
        if alone:
            piece["moves"] = self.rows.pop()[-1]

    def flush(self) -> pa.RecordBatch:
        if not self.pieces:
            return pa.RecordBatch.from_pylist([], schema=_PIECE)
        moves = {}
        if self.rows:
            table = pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*self.rows, strict=True), self.schema, strict=True)], schema=self.schema)
            self.db.register("members", table)
            self.db.execute(self.steps)
            moves = dict(self.db.execute(_ADVANCE).fetchall())
            self.db.unregister("members")
        out = pa.RecordBatch.from_pylist([{"moves": moves.get(i), **p} for i, p in enumerate(self.pieces)], schema=_PIECE)
        self.pieces, self.rows = [], []
        return out


def _rows_to_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, seg, ident, initial, blank, seen, cut) into pieces."""
    one_core()
    made, before = _Pieces(_ROW_STEPS.format(truncated=TRUNCATED), [("initial", pa.string()), ("forced", pa.bool_()), ("truncated", pa.bool_())]), None
    for batch in batches:
        for key, seg, ident, initial, blank, seen, cut in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (key, seg) != made.at:
                before = None
            yield from made.start((key, seg), key, seg)
            duplicate = not blank and (seen or ident == before)
            truncated = not blank and not duplicate and cut
            made.add({"n": 1, "blank": blank, "duplicate": duplicate, "truncated": truncated}, initial, initial, initial, blank or duplicate, truncated)
            before = ident
    yield made.flush()


def _pieces_to_larger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces with the segment that they meet in (into) as larger pieces."""
    one_core()
    made = _Pieces(_PIECE_STEPS, [("moves", _MOVES)])
    for batch in batches:
        for p in batch.to_pylist():
            yield from made.start((p["key"], p["into"]), p["key"], p["into"])
            made.add_piece(p)
    yield made.flush()


def _prepared(rows: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """key (a conversation's id as text, marked to tell null), turn, role, text, digest; nulls of role and text are one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    out = rows.select(F.coalesce(F.concat(F.lit("="), F.col(conv_id).cast("string")), F.lit("")).alias("key"), F.col(turn).cast("long").alias("turn"), blank(role).alias("role"), blank(text).alias("text"))
    return out.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))


def _faults() -> dict[str, Column]:
    solid = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\f\r"))
    return {"blank": solid == "", "cut": ~F.substring(solid, -1, 1).isin(".", "!", "?")}


def reports(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", span: int = SPAN, group: int = GROUP) -> DataFrame:
    """key, gaps, blank, duplicate, truncated, illegal, cost, audit of every conversation in rows.

    Rows of a conversation go by turn (null first), then by role and by SHA-256 of the text. A null role
    or text counts as one space, an empty role as one that fits nowhere; rows with a null conv_id are one conversation. Repeated rows are
    duplicates after the first. Other columns are ignored. An empty table gives an empty result.
    """
    known = _prepared(rows, conv_id, turn, role, text)
    light = known.withColumns(_faults()).select("key", F.floor(F.col("turn") / span).alias("seg"), "turn", "role", "digest", "blank", "cut")
    # Counted by task first, so that one text that fills a conversation is no hot key.
    first = light.filter("not blank").groupBy("key", "role", "digest").agg(F.min(F.struct("turn")).alias("first"))
    seen = light.join(first, ["key", "role", "digest"], "left").withColumn("seen", F.coalesce(~F.col("turn").eqNullSafe(F.col("first.turn")) & ~F.col("blank"), F.lit(False)))
    ident = F.concat(F.coalesce(F.col("turn").cast("string"), F.lit("")), F.lit(" "), F.hex("digest"), F.col("role"))
    dealt = seen.repartition("key", "seg").sortWithinPartitions("key", "seg", F.asc_nulls_first("turn"), "role", "digest")
    pieces = stage(dealt.select("key", "seg", ident.alias("ident"), F.substring("role", 1, 1).alias("initial"), "blank", "seen", "cut").mapInArrow(_rows_to_pieces, _PIECE_SQL), "pieces")
    while (most := pieces.groupBy("key").count().agg(F.max("count")).first()[0] or 0) > 1:
        # Division leads to null, -1 and 0 at last, which meet like all that are few.
        into = F.lit(None).cast("long") if most <= max(group, 3) else F.floor(F.col("seg") / group)
        grouped = pieces.withColumn("into", into).repartition("key", "into").sortWithinPartitions("key", "into", F.asc_nulls_first("seg"), "sub")
        larger = stage(grouped.mapInArrow(_pieces_to_larger, _PIECE_SQL), "pieces")
        unstage(pieces)
        pieces = larger
    ends = closing()
    end = lambda m, k: F.element_at(F.array(*(F.lit(ends[s][k]) for s in range(4))), m["state"] + 1)
    best = F.array_min(F.transform(F.filter("moves", lambda m: m["entry"] == _START), lambda m: F.struct((m["cost"] + end(m, 0)).alias("cost"), F.concat(m["audit"], end(m, 1)).alias("audit"))))
    turns = known.select("key", "turn").distinct().groupBy("key").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    found = pieces.withColumn("best", best).select("key", "blank", "duplicate", "truncated", "illegal", "best.cost", "best.audit")
    return turns.join(found, "key").select("key", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")


_REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
_EDITED = pa.schema([("key", pa.string()), *((c, pa.int64()) for c in _REPORT[:-1]), ("audit", pa.string()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
_EDITED_SQL = "key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, place long, edit string, role string, text string"


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A report and then its rows, in order, into that report and the turns that its audit leaves."""
    one_core()
    audit, at, tail, place, last = "", 0, 0, 0, ""
    for batch in batches:
        out = []

        def put(key: str, edit: str, role: str | None, text: str) -> None:
            nonlocal place, last
            role = role or ("assistant" if last == "u" else "user")
            out.append({"key": key, "place": place, "edit": edit, "role": role, "text": text})
            place, last = place + 1, role[:1]

        def insert(key: str) -> None:
            nonlocal at
            while audit[at : at + 1] == "I":
                put(key, "I", None, "")
                at += 1

        for row in batch.to_pylist():
            key = row["key"]
            if row["audit"] is not None:
                audit, at, place, last = row["audit"], 0, 0, ""
                tail = len(audit.rstrip("I"))
                out.append({c: row[c] for c in ("key", *_REPORT)})
            else:
                insert(key)
                if audit[at] != "D":
                    put(key, audit[at], row["role"] if audit[at] == "K" else None, row["text"])
                at += 1
            if at >= tail:
                insert(key)
        yield pa.RecordBatch.from_pylist(out, schema=_EDITED)


def edited(rows: DataFrame, found: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """For each conversation of found (of `reports`) a row with its report, and then a row for each turn of the
    repaired conversation: place, edit, role, text. Rows of a conversation follow each other in one partition."""
    known = _prepared(rows, conv_id, turn, role, text)
    null = lambda c, kind: F.lit(None).cast(kind).alias(c)
    heads = found.select("key", F.lit(0).alias("kind"), null("turn", "long"), null("role", "string"), null("digest", "binary"), *_REPORT, null("text", "string"))
    turns = known.select("key", F.lit(1).alias("kind"), "turn", "role", "digest", *(null(c, "long") for c in _REPORT[:-1]), null("audit", "string"), "text")
    ordered = heads.unionByName(turns).repartition("key").sortWithinPartitions("key", "kind", F.asc_nulls_first("turn"), "role", "digest")
    return ordered.select("key", "role", *_REPORT, "text").mapInArrow(_edit, _EDITED_SQL)


def _conversation(key: Column, kind: str) -> Column:
    return F.when(key != "", F.substring(key, 2, 1 << 30)).cast(kind)


def repaired(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, place, role, text, edit (K, R or I): the turns of all conversations after repair, from place 0 on.

    A conversation of which nothing is left has no rows. See `reports` for order, nulls and ties.
    """
    out = edited(rows, stage(reports(rows, conv_id, turn, role, text), "reports"), conv_id, turn, role, text)
    return out.filter(F.col("place").isNotNull()).select(_conversation(F.col("key"), rows.schema[conv_id].dataType.simpleString()).alias(conv_id), "place", "role", "text", "edit")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edited rows into the reports with the SHA-256 of their turns, as `role:text` joined by newlines."""
    report, digest = None, None
    schema = pa.schema([f for f in _EDITED if f.name not in ("place", "edit", "role", "text")] + [pa.field("repaired_sha256", pa.string())])

    def done() -> list[dict]:
        return [] if report is None else [{**report, "repaired_sha256": digest.hexdigest()}]

    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["place"] is None:
                out += done()
                report, digest = {f.name: row[f.name] for f in schema if f.name in row}, hashlib.sha256()
            else:
                digest.update((("\n" if row["place"] else "") + row["role"] + ":" + row["text"]).encode())
        yield pa.RecordBatch.from_pylist(out, schema=schema)
    yield pa.RecordBatch.from_pylist(done(), schema=schema)


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage told by crc32 of `conv_id:turn` modulo 20: 0 drops a row, 1 empties its
    text, 2 takes its full stops, exclamation and question marks, 3 repeats it, 4 makes it the user's. Nulls are one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    out = rows.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), hit.alias("hit")).filter("hit <> 0")
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return out.select("conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def repair_report(originals: DataFrame, rows: DataFrame, span: int = SPAN, group: int = GROUP) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conv_id in originals,
    for the rows that are left of it; zeros, an empty audit and the hash of an empty string where none are."""
    found = reports(rows, span=span, group=group)
    every = _prepared(originals, "conv_id", "turn", "role", "text").select("key").distinct()
    filled = every.join(found, "key", "left").select("key", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in _REPORT[:-1]), F.coalesce("audit", F.lit("")).alias("audit"))
    made = edited(rows, filled).mapInArrow(_digest, "key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
    return made.select(_conversation(F.col("key"), originals.schema["conv_id"].dataType.simpleString()).alias("conv_id"), *_REPORT, "repaired_sha256")
