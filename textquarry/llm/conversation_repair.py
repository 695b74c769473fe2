"""Conversation structure repair: blank and repeated turns go, roles alternate again, by the cheapest edits.

Turns are sorted once, by ranges of (conversation, turn), so that a long conversation lies on several tasks. Each run of up to SEGMENT neighbouring
turns of one conversation is searched on its own (edit_search): a conversation of one segment is solved by one search; for longer ones each segment
is searched from each state to each, and costs and ranks of these ways are combined level by level, 2^FAN segments at a time, until each
conversation is one part; then the best way's states are handed back down. Only the digest of a whole conversation, being a hash over its turns in
order, runs through them in one task, which streams.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from textquarry.llm import edit_search
from textquarry.llm.edit_search import ENDS, GIVEN, LEGAL, START
from textquarry.llm.scratch import stored

#: Bits of a turn's place that number it in its segment, and of a part's that number it in the part above.
SEGMENT, FAN = 6, 8
_SOLID = r"[^\x20\x09-\x0D]"
_SPACE = " \t\n\x0b\x0c\r"
_ROLES = {"s": "system", "u": "user", "a": "assistant"}


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults put in by crc32(`conv_id:turn`) % 20: 0 drops a row, 1 empties its text, 2 takes its `.!?`, 3 repeats it, 4 makes it the user's. A null counts as one space."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), h.alias("h")).where("h <> 0")
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.withColumn("text", text).withColumn("role", F.when(F.col("h") == 4, "user").otherwise(F.col("role")))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("h") == 3, 2).otherwise(1)))).select("conv_id", "turn", "role", "text")


def _key(df: DataFrame) -> DataFrame:
    return df.withColumn("c", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")))


def _placed(rows: DataFrame) -> DataFrame:
    """Different rows with their copies, faults, codes and places, which order all rows of the table; stored."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    keyed = _key(rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")))
    distinct = keyed.groupBy("c", "conv_id", "turn", "role", "text").agg(F.count("*").alias("copies")).withColumn("h", F.md5(F.col("text").cast("binary")))
    order = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    seen = distinct.groupBy("c", "role", "h").agg(F.min(order).alias("seen"))
    blank = ~F.col("text").rlike(_SOLID)
    truncated = ~F.right(F.rtrim(F.col("text"), F.lit(_SPACE)), F.lit(1)).isin(".", "!", "?")
    fault = F.when(blank, "blank").when(F.col("seen") < order, "duplicate").when(truncated, "truncated")
    first = F.substring("role", 1, 1)
    known = F.when(first.isin(*_ROLES), first).otherwise("x")
    code = F.when(F.col("fault").isin("blank", "duplicate"), "-").when(F.col("fault") == "truncated", F.upper(known)).otherwise(known)
    marked = distinct.join(seen, ["c", "role", "h"]).withColumn("fault", fault).withColumn("initial", F.when(first == "", " ").otherwise(first)).withColumn("code", code)
    by = [F.asc("c"), F.asc("turn"), F.asc("role"), F.substring("text", 1, 64)]
    ordered = marked.repartitionByRange(*by).sortWithinPartitions("c", "turn", "role", "text").withColumn("at", F.monotonically_increasing_id())
    return stored(ordered.select("c", "conv_id", "turn", "role", "text", "copies", "fault", "initial", "code", "at"))


_PART = "c string, b long, costs array<long>, ranks array<int>, first string, last string, illegal long"


def _segments(placed: DataFrame) -> DataFrame:
    """(c, b, at, codes, initials, extra) of each segment: the first place, and for each turn in order its code, initial and copies less one."""
    turn = F.struct("at", "code", "initial", (F.col("copies") - 1).alias("extra"))
    grouped = placed.groupBy("c", F.shiftright("at", SEGMENT).alias("b")).agg(F.array_sort(F.collect_list(turn)).alias("t"))
    return grouped.select("c", "b", F.col("t.at")[0].alias("at"), F.array_join("t.code", "").alias("codes"), F.array_join("t.initial", "").alias("initials"), F.col("t.extra").alias("extra"))


def _illegal(initials: str, extra: list[int]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False)) + sum(extra)


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The table of ways of each segment."""
    for batch in batches:
        rows = batch.to_pylist()
        made = [edit_search.table(r["codes"]) for r in rows]
        columns = [
            batch.column("c"), batch.column("b"), pa.array([m[0] for m in made], pa.list_(pa.int64())), pa.array([m[1] for m in made], pa.list_(pa.int32())),
            pa.array([r["initials"][0] for r in rows]), pa.array([r["initials"][-1] for r in rows]), pa.array([_illegal(r["initials"], r["extra"]) for r in rows]),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["c", "b", "costs", "ranks", "first", "last", "illegal"])


def _in_order(table: pa.Table) -> list[dict]:
    return sorted(table.to_pylist(), key=lambda r: r["b"])


def _above(key: tuple, table: pa.Table) -> pa.Table:
    """One part of up to 2^FAN neighbouring ones."""
    parts = _in_order(table)
    costs, ranks = edit_search.joined([(p["costs"], p["ranks"]) for p in parts])
    illegal = sum(p["illegal"] for p in parts) + sum(a["last"] + b["first"] not in LEGAL for a, b in zip(parts, parts[1:], strict=False))
    row = {"c": key[0].as_py(), "b": key[1].as_py(), "costs": costs, "ranks": ranks, "first": parts[0]["first"], "last": parts[-1]["last"], "illegal": illegal}
    kinds = {"costs": pa.list_(pa.int64()), "ranks": pa.list_(pa.int32()), "b": pa.int64(), "illegal": pa.int64()}
    return pa.table({n: pa.array([v], kinds.get(n, pa.string())) for n, v in row.items()})


def _below(key: tuple, table: pa.Table) -> pa.Table:
    """The states in which the best way enters and leaves each part, from those of the part above."""
    parts = _in_order(table)
    way = edit_search.way([(p["costs"], p["ranks"]) for p in parts], parts[0]["entry"], parts[0]["goal"])
    return pa.table({"c": [p["c"] for p in parts], "b": pa.array([p["b"] for p in parts], pa.int64()), "entry": pa.array([w[0] for w in way], pa.int32()), "goal": pa.array([w[1] for w in way], pa.int32())})


def _long_ways(segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((c, b, entry, goal) of each segment, (c, illegal) of each conversation) of the conversations of several segments."""
    levels = [stored(segments.mapInArrow(_tables, _PART))]
    while not levels[-1].groupBy("c").count().where("count > 1").isEmpty():
        levels.append(stored(levels[-1].groupBy("c", F.shiftright("b", FAN).alias("up")).applyInArrow(_above, _PART)))
    # edit_search.ending in columns: the ways from the start are the first four
    best = F.array_min(F.array(*[F.struct((F.col("costs")[x] + ENDS[x][0]).alias("cost"), F.col("ranks")[x].alias("rank"), F.lit(x).alias("goal")) for x in range(4)]))
    ways = levels[-1].select("c", "b", F.lit(START).alias("entry"), best["goal"].alias("goal"))
    for level in reversed(levels[:-1]):
        asked = level.withColumn("up", F.shiftright("b", FAN)).join(ways.withColumnRenamed("b", "up"), ["c", "up"])
        ways = asked.groupBy("c", "up").applyInArrow(_below, "c string, b long, entry int, goal int")
    return stored(ways), levels[-1].select("c", "illegal")


_EDITED = "c string, b long, at long, edits array<string>, given array<string>, tail string, audit string, cost long, illegal long"


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each turn of a segment its edit after the roles inserted before it (`given`), what is inserted at the end (`tail`), and the segment's audit and cost."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            whole, entry, goal = r["entry"] is None, r["entry"] or START, r["goal"]
            cost, path = edit_search.search(r["codes"]) if whole else edit_search.search(r["codes"], entry, (goal,), False)
            if r["last"] and not whole:
                cost, path = cost + ENDS[goal][0], path + ENDS[goal][1]
            edits, given, audit, state, held = [], [], [], entry, ""
            for edit in path:
                audit.append(edit)
                if edit == "I":
                    held += GIVEN[state]
                    state = edit_search.AFTER[state]
                    continue
                initial = r["codes"][len(edits)].lower()
                role = GIVEN[state] if edit == "R" else ""
                if edit != "D":
                    state = edit_search.AFTER[state] if edit == "R" else edit_search.kept(state, initial)
                audit.append("D" * r["extra"][len(edits)])
                edits.append(edit + role)
                given.append(held)
                held = ""
            out.append((edits, given, held, "".join(audit), cost + edit_search.DELETE * sum(r["extra"]), _illegal(r["initials"], r["extra"])))
        columns = [batch.column("c"), batch.column("b"), batch.column("at")]
        columns += [pa.array([x[i] for x in out], t) for i, t in enumerate((pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), pa.string(), pa.int64(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["c", "b", "at", "edits", "given", "tail", "audit", "cost", "illegal"])


def _solved(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edits of each segment, (c, illegal) of the conversations of several segments); stored."""
    segments = stored(_segments(placed))
    ends = segments.groupBy("c").agg(F.count("*").alias("n"), F.max("b").alias("end"))
    sized = segments.join(ends, "c").withColumn("last", F.col("b") == F.col("end"))
    ways, illegal = _long_ways(sized.where("n > 1").select(*segments.columns))
    asked = sized.join(ways, ["c", "b"], "left").select(*segments.columns, "last", "entry", "goal")
    return stored(asked.mapInArrow(_edited, _EDITED)), illegal


def _named(initial: Column) -> Column:
    return F.when(initial == "u", "user").otherwise("assistant")


def _lines(placed: DataFrame, edits: DataFrame) -> DataFrame:
    """(c, conv_id, at, lines): the repaired turns that come with each turn, as structs of edit, role and text, in order; turns that leave none are left out."""
    last = F.col("i") == F.size("edits") - 1
    each = edits.select("c", "at", "tail", "edits", F.posexplode("edits").alias("i", "edit"), "given")
    each = each.select((F.col("at") + F.col("i")).alias("at"), "edit", F.col("given")[F.col("i")].alias("given"), F.when(last, F.col("tail")).otherwise("").alias("tail")).where("given <> '' or tail <> '' or edit <> 'D'")
    inserted = lambda s: F.transform(F.filter(F.split(s, ""), lambda x: x != ""), lambda x: F.struct(F.lit("I").alias("edit"), _named(x).alias("role"), F.lit("").alias("text")))
    role = F.when(F.col("edit") == "K", F.col("role")).otherwise(_named(F.substring("edit", 2, 1)))
    own = F.filter(F.array(F.struct(F.substring("edit", 1, 1).alias("edit"), role.alias("role"), F.col("text").alias("text"))), lambda x: x["edit"] != "D")
    lines = F.concat(inserted(F.col("given")), own, inserted(F.col("tail")))
    return placed.select("c", "conv_id", "at", "role", "text").join(each, "at").select("c", "conv_id", "at", lines.alias("lines"))


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, place, n, edit, role, text) of the repaired turns: K kept, R with another role, I inserted; (place, n) orders those of a conversation.

    Takes conv_id, turn, role and text; see `digest` for what is a fault and for nulls, ties and repeated rows.
    """
    placed = _placed(rows)
    edits, _ = _solved(placed)
    return _lines(placed, edits).select("conv_id", F.col("at").alias("place"), F.posexplode("lines").alias("n", "l")).select("conv_id", "place", "n", "l.edit", "l.role", "l.text")


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(c, sha256) of each conversation's lines, which come in order."""
    names = ["c", "repaired_sha256"]
    now, digest = None, hashlib.sha256()
    for batch in batches:
        done = []
        for c, text in zip(batch.column("c").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if c != now:
                if now is not None:
                    done.append((now, digest.hexdigest()))
                now, digest = c, hashlib.sha256(text.encode())
            else:
                digest.update(b"\n" + text.encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.string()) for i in (0, 1)], names)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([digest.hexdigest()])], names)


def digest(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """A row for each conv_id of `ids` (of `rows`, if not given) with the faults of its turns and what repairs them.

    conv_id, gaps (turn numbers missing between the first and the last), blank, duplicate, truncated (turns by their first fault), illegal
    (neighbouring role initials other than su, ua, au), cost, audit (the edits in order) and repaired_sha256 (the repaired `role:text`, joined by
    line breaks). A turn is blank without a solid character, a duplicate if its role and text were seen in an earlier turn, truncated if its last
    solid character is not one of `.!?`. Turns are in the order of turn (nulls first), role and text; repeated rows are duplicates, or blank. A
    null role or text is one space; rows with a null conv_id are one conversation; a role of no letters has an initial that is never legal. A
    conversation without rows has zeros, no edits and the hash of nothing; an empty table of ids gives no rows. Other columns are ignored.
    """
    placed = _placed(rows)
    edits, long_illegal = _solved(placed)
    n = lambda kind: F.sum(F.when(F.col("fault") == kind, F.when(F.lit(kind == "blank"), F.col("copies")).otherwise(1)).otherwise(0))
    copies = F.sum(F.when(F.col("fault").eqNullSafe("blank"), 0).otherwise(F.col("copies") - 1))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0))
    counts = placed.groupBy("c").agg(gaps.alias("gaps"), n("blank").alias("blank"), (n("duplicate") + copies).alias("duplicate"), n("truncated").alias("truncated"))
    audits = edits.groupBy("c").agg(F.sum("cost").alias("cost"), F.sum("illegal").alias("illegal"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    text = F.array_join(F.transform("lines", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    lines = _lines(placed, edits).select("c", "at", text.alias("text"))
    hashed = lines.repartition("c").sortWithinPartitions("c", "at").select("c", "text").mapInArrow(_hashes, "c string, repaired_sha256 string")
    found = counts.join(audits, "c").join(long_illegal.withColumnRenamed("illegal", "long_illegal"), "c", "left").join(hashed, "c", "left")
    asked = _key((rows if ids is None else ids).select("conv_id").distinct()).join(found, "c", "left")
    zero = lambda name: F.coalesce(name, F.lit(0)).cast("long").alias(name)
    illegal = F.coalesce("long_illegal", "illegal", F.lit(0)).cast("long").alias("illegal")
    return asked.select("conv_id", zero("gaps"), zero("blank"), zero("duplicate"), zero("truncated"), illegal, zero("cost"), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
