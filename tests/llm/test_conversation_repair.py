import hashlib
import heapq
import random
import re
import zlib

import pytest

from textquarry.llm import conversation_repair as cr, edit_search

SPACE = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for c, t, r, x in rows:
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        if h == 0:
            continue
        x = "" if h == 1 else re.sub("[.!?]", "", x) if h == 2 else x
        r = "user" if h == 4 else r
        out += [(c, t, r, x)] * (2 if h == 3 else 1)
    return out


def cheapest(turns):
    """(cost, edits, lines) by uniform-cost search over (cost, edits so far); turns are (role, text, fault)."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, edits, i, roles, lines = heapq.heappop(heap)
        state = ("" if not roles else roles[-1]), i
        if state in done:
            continue
        done.add(state)
        if i == len(turns) and roles[-1:] in ("", "a"):
            return cost, edits, lines
        wanted = "assistant" if roles[-1:] == "u" else "user"
        heapq.heappush(heap, (cost + 3, edits + "I", i, roles + wanted[0], (*lines, f"{wanted}:")))
        if i < len(turns):
            role, text, fault = turns[i]
            heapq.heappush(heap, (cost + 4, edits + "D", i + 1, roles, lines))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault else 0
                heapq.heappush(heap, (cost + more + 3, edits + "R", i + 1, roles + wanted[0], (*lines, f"{wanted}:{text}")))
                if role[:1] == wanted[0] or role[:1] == "s" and not roles:
                    heapq.heappush(heap, (cost + more, edits + "K", i + 1, roles + role[0], (*lines, f"{role}:{text}")))
    raise AssertionError


def plain(rows, ids):
    out = {}
    for c in ids:
        mine = sorted((r[1:] for r in rows if r[0] == c), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, turns = set(), []
        for _, role, text in mine:
            solid = text.strip(SPACE)
            turns.append((role, text, "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None))
            seen.add((role, text))
        numbers = [t for t, *_ in mine if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        n = lambda kind: sum(t[2] == kind for t in turns)  # noqa: E731, B023
        illegal = sum((a[0][:1] or " ") + (b[0][:1] or " ") not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        cost, edits, lines = cheapest(turns)
        out[c] = (gaps, n("blank"), n("duplicate"), n("truncated"), illegal, cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def talk(rng, c, n, roles=("user", "assistant", "user", "assistant", "system", "tool", "", None)):
    turns = [(c, t if rng.random() > 0.05 else rng.choice([None, t + 3, 0]), ("user", "assistant")[t % 2] if rng.random() < 0.7 else rng.choice(roles), rng.choice(["Yes.", "no", " \n", None, f"Turn {t}?", f"turn {t}", "", "é☃!  ", "What. "])) for t in range(n)]
    if n and rng.random() < 0.4:
        turns[0] = (c, 0, "system", "Be kind.")
    return turns


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, c string, at int").repartition(4)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.mark.parametrize("segment", [6, 1])
def test_digest_equals_uniform_cost_search(spark, monkeypatch, segment):
    monkeypatch.setattr(cr, "SEGMENT", segment)
    monkeypatch.setattr(cr, "FAN", 8 if segment == 6 else 2)
    rng = random.Random(segment)
    rows = [r for c in range(40) for r in talk(rng, c, rng.choice([1, 2, 5, 8, 12]))]
    rows += talk(rng, 100, 300) + talk(rng, None, 5) + rows[:7] + [(200, 0, "user", "same.")] * 30
    got = cr.digest(cr.damaged(table(spark, rows)), table(spark, rows))
    assert got.columns == COLUMNS
    ids = {r[0] for r in rows}
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == plain(damage(rows), ids)


def test_repair_gives_the_turns_behind_the_digest(spark):
    rng = random.Random(3)
    rows = [(c, t, r or " ", x or " ") for c in range(15) for _, t, r, x in talk(rng, c, rng.randint(0, 9))]
    lines = {}
    for r in sorted(cr.repair(table(spark, rows)).collect(), key=lambda r: (r["place"], r["n"])):
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    expected = plain(rows, {r[0] for r in rows})
    assert {c: hashlib.sha256("\n".join(lines.get(c, [])).encode()).hexdigest() for c in expected} == {c: e[-1] for c, e in expected.items()}


def test_empty_tables_and_lost_conversations(spark):
    rows = table(spark, [(1, 0, "user", "Hello.")])
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert [tuple(r) for r in cr.digest(rows.limit(0), rows).collect()] == [(1, *none)]
    assert cr.digest(rows.limit(0)).count() == 0 and cr.repair(rows.limit(0)).count() == 0


def test_search_equals_uniform_cost_search():
    rng = random.Random(5)
    names = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}
    for _ in range(1500):
        codes = "".join(rng.choice("suaxSUAX-uaua") for _ in range(rng.randint(0, 9)))
        turns = [("user", "", "blank") if c == "-" else (names[c.lower()], "t", "truncated" if c.isupper() else None) for c in codes]
        assert edit_search.search(codes) == cheapest(turns)[:2]
        if not codes:
            continue
        k = rng.randint(1, len(codes))
        parts = [codes[i : i + k] for i in range(0, len(codes), k)]
        tables = [edit_search.table(p) for p in parts]
        cut = rng.randint(1, len(tables))
        costs, ranks = edit_search.joined([edit_search.joined(t) for t in (tables[:cut], tables[cut:]) if t])
        end = edit_search.ending(costs, ranks)
        way = edit_search.way(tables, 0, end)
        edits = "".join(edit_search.search(p, a, (b,), False)[1] for p, (a, b) in zip(parts, way, strict=True)) + edit_search.ENDS[end][1]
        assert (costs[end] + edit_search.ENDS[end][0], edits) == edit_search.search(codes)


def test_long_parts_take_few_steps():
    for codes, cost in (("u" * 256, 384), ("ua" * 128, 0), ("A" * 64 + "-" * 64, None)):
        found = edit_search.search(codes)
        assert cost is None or found[0] == cost
        assert found[0] >= edit_search.needs(codes)[0]
