"""Conversation repair against an exhaustive search of all edits."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest

from rowloom.llm import catalog, repair

BLANKS = " \t\n\x0b\x0c\r"
KIND = "conv_id long, turn long, role string, text string, cost string, conv int"


def faults(rows):
    """Each (role, text)'s first fault."""
    found, seen = [], set()
    for role, text in rows:
        bare = text.strip(BLANKS)
        if not bare:
            found.append("blank")
        elif (role, text) in seen:
            found.append("duplicate")
        else:
            found.append("" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return found


def cheapest_edits(rows, marks):
    """(cost, audit, repaired rows) by trying every edit; costs beyond deleting all rows are cut off."""
    most = 3 * len(rows)
    best = None

    def go(i, cost, audit, out):
        nonlocal best
        if cost > most or (best and cost > best[0]):
            return
        if not re.fullmatch("s?(ua)*u?", "".join(r[:1] for r, _ in out)):
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, out)
        for role in ("user", "assistant"):
            go(i, cost + 2, audit + "I", [*out, (role, "")])
        if i < len(rows):
            role, text = rows[i]
            go(i + 1, cost + 3, audit + "D", out)
            if marks[i] not in ("blank", "duplicate"):
                more = marks[i] == "truncated"
                if role[:1] in list("sua"):
                    go(i + 1, cost + more, audit + "K", [*out, (role, text)])
                for new in ("user", "assistant"):
                    go(i + 1, cost + 2 + more, audit + "R", [*out, (new, text)])

    go(0, 0, "", [])
    return best


def damaged(rows):
    out = []
    for r in rows:
        conv, turn, role, text = (" " if x is None else x for x in r[:4])
        kind = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(r[0], r[1], "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def expected(rows, search):
    found = {}
    after = damaged(rows)
    for conv in {r[0] for r in rows}:
        own = [r for r in after if r[0] == conv]
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
        turns = {r[1] for r in own} - {None}
        pairs = [(r[2], r[3]) for r in own]
        marks = faults(pairs)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(pairs))
        cost, audit, out = search(pairs, marks)
        found[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            *(marks.count(m) for m in ("blank", "duplicate", "truncated")),
            illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest(),
        )
    return found


def run(spark, tmp_path, rows):
    spark.createDataFrame(rows, KIND).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    found = catalog.QUERIES["op13_conversation_repair"](spark, str(tmp_path)).collect()
    assert len(found) == len({r["conv_id"] for r in found})
    return {r["conv_id"]: tuple(r)[1:] for r in found}


def conversations(seed, count, roles, size):
    rng = random.Random(seed)
    rows = []
    for conv in range(count):
        for turn in range(rng.randrange(1, size)):
            text = rng.choice(["Yes.", "No", "What?", "", "\x0b \n", "é ", "Hm!", None, f"t{rng.randrange(3)}."])
            rows.append((conv, rng.choice([turn, turn + 1, None]) if conv % 3 else turn, rng.choice(roles), text, "x", 1))
    return rows


def test_query_equals_exhaustive_search(spark, tmp_path):
    rows = conversations(1, 60, ["user", "assistant", "system", "tool", "", None, "usher"], 5)
    rows += [(None, 1, "user", "A.", None, None), (None, 2, "assistant", "B", None, None), rows[0], rows[0], (900, 0, None, None, None, None)]
    # every row of this one is dropped
    gone = next(c for c in range(1000, 9999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((gone, 0, "user", "Hi.", None, None))
    found = run(spark, tmp_path, rows)
    assert found == expected(rows, cheapest_edits)
    assert found[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_empty_table(spark, tmp_path):
    assert run(spark, tmp_path, []) == {}


def whole(pairs, marks):
    """The same search as one dynamic program over plain strings."""
    codes = "".join(
        chr(97 + "sua".find(r[:1]) + 1 + 4 * ["", "truncated", "blank", "duplicate"].index(m)) if r else chr(97 + 4 * ["", "truncated", "blank", "duplicate"].index(m))
        for (r, _), m in zip(pairs, marks, strict=True)
    )
    ways = {0: (0, "")}
    step = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}

    def inserted(ways):
        for _ in range(2):
            for s, (c, a) in list(ways.items()):
                for letter, t in step[s].items():
                    if letter != "s":
                        ways[t] = min(ways.get(t, (1e9, "")), (c + 2, a + "I"))
        return ways

    for code in codes:
        after = {}
        fault, place = divmod(ord(code) - 97, 4)
        for s, (c, a) in inserted(ways).items():
            after[s] = min(after.get(s, (1e9, "")), (c + 3, a + "D"))
            for letter, t in step[s].items() if fault < 2 else ():
                if place and "sua"[place - 1] == letter:
                    after[t] = min(after.get(t, (1e9, "")), (c + fault, a + "K"))
                elif letter != "s":
                    after[t] = min(after.get(t, (1e9, "")), (c + 2 + fault, a + "R"))
        ways = after
    ways = inserted(ways)
    cost, audit = min(ways[s] for s in (0, 3) if s in ways)
    rest, out, state = iter(pairs), [], 0
    names = {"s": "system", "u": "user", "a": "assistant"}
    for edit in audit:
        role, text = next(rest) if edit != "I" else (None, "")
        if edit != "D":
            letter = role[0] if edit == "K" else next(x for x in step[state] if x != "s")
            state = step[state][letter]
            out.append((role if edit == "K" else names[letter], text))
    return cost, audit, out


@pytest.mark.parametrize("modulus", [repair.MODULUS, 5, 2])
def test_trails_with_colliding_hashes(modulus):
    rng = random.Random(2)
    for _ in range(300):
        codes = "".join(rng.choice("abcdefghijkl") for _ in range(rng.randrange(12)))
        cut = rng.randrange(len(codes) + 1)
        joined = repair.Joined(modulus)
        for part in (codes[:cut], codes[cut:]):
            if part:
                joined.add(repair.piece_paths(part, modulus))
        marks = [["", "truncated", "blank"][(ord(c) - 97) // 4] for c in codes]
        pairs = [(["", "s", "u", "a"][(ord(c) - 97) % 4], f"{i}") for i, c in enumerate(codes)]
        assert joined.finish() == whole(pairs, marks)[:2], codes
        if len(codes) < 5:
            assert joined.finish() == cheapest_edits(pairs, marks)[:2], codes


def test_one_long_conversation_over_many_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(repair, "PIECE_ROWS", 16)
    rng = random.Random(5)
    rows = [(7, t, rng.choice(["user", "assistant", "system"]), rng.choice(["A.", "B", "", f"{t}!"]), None, None) for t in range(1500)]
    rows += [(8, 3, "user", "Same.", None, None)] * 90 + [(8, 4, "assistant", "Long. " * 20000, None, None)]
    assert run(spark, tmp_path, rows) == expected(rows, whole)


def test_repaired_rows(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "Ho."), (1, 2, "tool", "x.")], "c int, n int, r string, t string")
    rows, found = repair.repair(df, "c", "n", "r", "t")
    out = repair.repaired_rows(rows, found).orderBy("position").collect()
    said = [("K", "user", "Hi."), ("I", "assistant", ""), ("K", "user", "Ho."), ("R", "assistant", "x.")]
    assert [tuple(r) for r in out] == [(1, i, *r) for i, r in enumerate(said, 1)]
    assert [(r["audit"], r["cost"]) for r in found.collect()] == [("KIKR", 4)]
