"""Repair of damaged conversations: the cheapest edits that give turns of user and assistant, with an audit of them.

Rows of a conversation are edited to a list whose roles' initials match ``(s?(ua)+)?``. A dynamic program over four
states (nothing yet, after system, user, assistant) finds the cheapest edits; of equally cheap ones the audit (one letter
per edit) that is least in ASCII counts. Audits are never copied while the program runs: they are *trails*, linked nodes
that share their prefixes. A node has its ancestors at distances 1, 2, 4, ... and a rolling hash of all labels up to it,
so two trails are compared by a search for their longest common prefix. What equal hashes claim is verified.

A row matters to the program by its role's initial and its fault only, one letter. A conversation of any length is cut
into pieces of bounded size; tasks find the cheapest trails through each piece from every state to every state, and the
pieces of a conversation are put together in order, with trails whose labels are pieces' audits.

Rows go by turn (missing first), then role, then the SHA-256 of the text; equal rows can't be told apart, the first counts
as seen. A missing role or text is one blank. A missing conversation id is a conversation like any other.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from rowloom.llm.slices import SLICE_BYTES, SLICE_ROWS, map_slices, slices
from rowloom.session import discard, scratch_path

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
TRUNCATED_COST = 1
INITIALS = "sua"
ROLE = {"u": "user", "a": "assistant"}
FAULTS = ("none", "truncated", "blank", "duplicate")

START, SYSTEM, USER, ASSISTANT = range(4)
# The state that a row of a role's initial leads to; no entry where the role may not come.
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
# What has to follow for a complete conversation, in edits.
ENDING = {START: "", SYSTEM: INSERT * 2, USER: INSERT, ASSISTANT: ""}

# Numbered rows of a piece, and equal rows that are one numbered row.
PIECE_ROWS, COPIES = 256, 16
# Pieces of at most so many rows are looked up among those seen before.
REMEMBERED = 32

BLANKS = " \t\n\x0b\x0c\r"
MODULUS = (1 << 61) - 1
BASE = 1_000_003


class Trails:
    """Strings as linked nodes with shared prefixes; node 0 is the empty one, every other adds a label to its parent."""

    def __init__(self, modulus: int = MODULUS):
        self.modulus = modulus
        self.label, self.depth, self.hash, self.up = [""], [0], [0], [[]]
        self.known: set[tuple[int, int]] = set()

    def add(self, parent: int, label: str) -> int:
        code = ord(label) if len(label) == 1 else xxhash.xxh64_intdigest(label)
        up, far, k = [parent], parent, 0
        while len(self.up[far]) > k:
            far = self.up[far][k]
            up.append(far)
            k += 1
        self.label.append(label)
        self.depth.append(self.depth[parent] + 1)
        self.hash.append((self.hash[parent] * BASE + code + 1) % self.modulus)
        self.up.append(up)
        return len(self.label) - 1

    def ancestor(self, node: int, depth: int) -> int:
        rest = self.depth[node] - depth
        while rest:
            k = rest.bit_length() - 1
            node = self.up[node][k]
            rest -= 1 << k
        return node

    def labels(self, node: int) -> list[str]:
        found = []
        while node:
            found.append(self.label[node])
            node = self.up[node][0]
        return found[::-1]

    def _equal(self, x: int, y: int) -> bool:
        """Whether two nodes of one depth and hash are the same string; looks at no pair of nodes twice."""
        walked = []
        while x != y and (x, y) not in self.known:
            if self.label[x] != self.label[y]:
                return False
            walked.append((x, y))
            x, y = self.up[x][0], self.up[y][0]
        self.known.update(walked)
        return True

    def less(self, x: int, y: int) -> bool:
        """Whether the string of ``x`` comes before that of ``y``; the first label that differs decides."""
        depth = min(self.depth[x], self.depth[y])
        a, b = self.ancestor(x, depth), self.ancestor(y, depth)
        if self.hash[a] == self.hash[b]:
            if self._equal(a, b):
                return self.depth[x] < self.depth[y]
        else:
            for k in range(len(self.up[a]) - 1, -1, -1):
                if k < len(self.up[a]) and self.hash[self.up[a][k]] != self.hash[self.up[b][k]]:
                    a, b = self.up[a][k], self.up[b][k]
            if self._equal(self.up[a][0], self.up[b][0]):
                return self.label[a] < self.label[b]
        return self.labels(x) < self.labels(y)  # hashes of different strings were equal

    def better(self, a: tuple[int, int] | None, cost: int, parent: int, label: str) -> tuple[int, int]:
        """The cheaper of a (cost, node) and an extension; of equally cheap ones the lesser string."""
        if a is not None and a[0] < cost:
            return a
        node = self.add(parent, label)
        return (cost, node) if a is None or cost < a[0] or self.less(node, a[1]) else a


def code_of(initial: Column, fault: Column) -> Column:
    """The letter of a row: the place of its role's initial among s, u and a (none: 0), and of its fault."""
    place = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0)
    return F.char(F.lit(97) + place + 4 * fault)


def decoded(code: str) -> tuple[str, int]:
    fault, place = divmod(ord(code) - 97, 4)
    return (INITIALS[place - 1] if place else "", fault)


def choices(state: int, code: str) -> Iterator[tuple[str, int, int]]:
    """What can be done with a row in a state: edit, cost, next state."""
    initial, fault = decoded(code)
    if fault < 2:
        extra = fault * TRUNCATED_COST
        for letter, follows in NEXT[state].items():
            if letter == initial:
                yield KEEP, COST[KEEP] + extra, follows
            elif letter in ROLE:
                yield REROLE, COST[REROLE] + extra, follows
    yield DELETE, COST[DELETE], state


def through(codes: str, start: int, trails: Trails) -> list[tuple[int, int] | None]:
    """The cheapest trail through the rows to each state, as (cost, node); edits before a row belong to it."""
    best: list[tuple[int, int] | None] = [None] * 4
    best[start] = (0, 0)
    for code in codes:
        for _ in range(2):  # more inserts in a row only lead back
            before = list(best)
            for state, found in enumerate(before):
                if found:
                    follows = next(NEXT[state][r] for r in ROLE if r in NEXT[state])
                    best[follows] = trails.better(best[follows], found[0] + COST[INSERT], found[1], INSERT)
        after: list[tuple[int, int] | None] = [None] * 4
        for state, found in enumerate(best):
            if found:
                for edit, cost, follows in choices(state, code):
                    after[follows] = trails.better(after[follows], found[0] + cost, found[1], edit)
        best = after
    return best


def piece_paths(codes: str, modulus: int = MODULUS) -> list[tuple[int, int, int, str]]:
    """(state before, state after, cost, audit) of the cheapest ways through a piece."""
    trails = Trails(modulus)
    found = [(start, end, way) for start in range(4) for end, way in enumerate(through(codes, start, trails)) if way]
    return [(start, end, cost, "".join(trails.labels(node))) for start, end, (cost, node) in found]


class Joined:
    """Pieces of one conversation put together in order."""

    def __init__(self, modulus: int = MODULUS):
        self.trails = Trails(modulus)
        self.best: list[tuple[int, int] | None] = [(0, 0), None, None, None]

    def add(self, paths: list[tuple[int, int, int, str]]) -> None:
        after: list[tuple[int, int] | None] = [None] * 4
        for start, end, cost, audit in paths:
            if found := self.best[start]:
                after[end] = self.trails.better(after[end], found[0] + cost, found[1], audit)
        self.best = after

    def finish(self) -> tuple[int, str]:
        """Cost and audit of the cheapest edits that end in a complete conversation."""
        last = None
        for state, found in enumerate(self.best):
            if found:
                ending = ENDING[state]
                last = self.trails.better(last, found[0] + len(ending) * COST[INSERT], found[1], ending)
        return last[0], "".join(self.trails.labels(last[1]))


def cheapest(codes: str) -> tuple[int, str]:
    """Cost and audit of a conversation given as one piece."""
    joined = Joined()
    joined.add(piece_paths(codes))
    return joined.finish()


def illegal_pairs(codes: str) -> int:
    """Neighbours whose roles' initials are none of su, ua and au."""
    roles = [decoded(c)[0] for c in codes]
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False))


def named_rows(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """``conv, turn, role, text, digest``: the four columns without missing roles and texts."""
    blank = F.lit(" ")
    return df.select(
        F.col(conv).alias("conv"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), blank).alias("role"),
        F.coalesce(F.col(text).cast("string"), blank).alias("text"),
    ).withColumn("digest", F.unhex(F.sha2("text", 256)))


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The table written to the shared folder and read again, and where it is."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def coded_pieces(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """``conv, piece, codes``: the letters of a conversation's rows in order, in pieces of bounded length.

    Also the folders that it reads, to be discarded by the caller.
    """
    spark = rows.sparkSession
    bare = F.rtrim("text", F.lit(BLANKS))
    folded, folded_path = written(
        rows.select(
            "conv",
            "turn",
            "role",
            "digest",
            (bare == "").alias("blank"),
            (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("truncated"),
        )
        .groupBy("conv", "turn", "role", "digest", "blank", "truncated")
        .agg(F.count(F.lit(1)).alias("n")),
        "folded",
    )
    seen = (
        folded.groupBy("conv", "role", "digest")
        .agg(F.count(F.lit(1)).alias("turns"), F.min(F.struct(F.col("turn").isNotNull(), F.col("turn").alias("turn"))).alias("first"))
        .where("turns > 1")
        .select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    )
    met = folded.join(
        seen, F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left"
    )
    repeated = F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    first_fault = F.when(F.col("blank"), 2).when(repeated, 3).when(F.col("truncated"), 1).otherwise(0)
    again = F.when(F.col("blank"), 2).otherwise(3)
    initial = F.substring("role", 1, 1)
    order = ["conv", "turn", "role", "digest", "part"]
    lettered = met.select(
        "conv",
        "turn",
        "role",
        "digest",
        F.explode(F.sequence(F.lit(0), F.expr(f"CAST((n - 1) DIV {COPIES} AS INT)"))).alias("part"),
        "n",
        code_of(initial, first_fault).alias("code"),
        code_of(initial, again).alias("again"),
    )
    size = F.least(F.lit(COPIES), F.col("n") - F.col("part") * COPIES).cast("int")
    codes = F.when(F.col("part") > 0, F.repeat("again", size)).otherwise(F.concat("code", F.repeat("again", size - 1)))
    placed = lettered.withColumn("codes", codes).repartitionByRange(*order).sortWithinPartitions(*order)
    placed, placed_path = written(placed.select("conv", "codes", F.monotonically_increasing_id().alias("at")), "placed")
    inner = F.array_sort(F.collect_list(F.struct("at", "codes")))
    pieces = placed.groupBy("conv", F.expr(f"at DIV {PIECE_ROWS}").alias("piece")).agg(F.array_join(inner["codes"], "").alias("codes"))
    discard(spark, folded_path)
    return pieces, [placed_path]


def _streamed(df: DataFrame, schema: str, work: Callable[[Iterator[dict]], Iterator[tuple]], text: str) -> DataFrame:
    """One generator over all rows of a task, in their order; slices of bounded bytes in and batches of rows out."""
    kind = StructType.fromDDL(schema)

    def run(batches):
        target = to_arrow_schema(kind)

        def rows():
            for batch in batches:
                for part in slices(batch, text):
                    yield from part.to_pylist()

        def packed(held):
            columns = zip(zip(*held, strict=True), target, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in columns], schema=target)

        held, size = [], 0
        for row in work(rows()):
            held.append(row)
            size += sum(len(x) for x in row if isinstance(x, str))
            if len(held) >= SLICE_ROWS or size > SLICE_BYTES:
                yield packed(held)
                held, size = [], 0
        if held:
            yield packed(held)

    return df.mapInArrow(run, kind)


def _conv_type(rows: DataFrame) -> str:
    return rows.schema["conv"].dataType.simpleString()


def audits(pieces: DataFrame) -> DataFrame:
    """``conv, blank, duplicate, truncated, illegal, cost, audit`` of every conversation."""
    conv = _conv_type(pieces)

    def start():
        seen = lru_cache(maxsize=1 << 16)(piece_paths)

        def work(part):
            codes = part.column("codes").to_pylist()
            paths = [(seen if len(c) <= REMEMBERED else piece_paths)(c) for c in codes]
            return {
                "conv": part.column("conv"),
                "piece": part.column("piece"),
                "codes": codes,
                "paths": [[{"start": p[0], "end": p[1], "cost": p[2], "audit": p[3]} for p in found] for found in paths],
            }

        return work

    ways = map_slices(
        pieces.select("conv", "piece", "codes"),
        f"conv {conv}, piece long, codes string, paths array<struct<start:int,end:int,cost:long,audit:string>>",
        start,
        "codes",
    )

    def join(rows):
        conv, joined, faults, illegal, last = None, None, Counter(), 0, ""

        def finished():
            cost, audit = joined.finish()
            return conv, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit

        for row in rows:
            if joined is None or row["conv"] != conv:
                if joined:
                    yield finished()
                conv, joined, faults, illegal, last = row["conv"], Joined(), Counter(), 0, ""
            joined.add([(p["start"], p["end"], p["cost"], p["audit"]) for p in row["paths"]])
            faults.update(FAULTS[decoded(c)[1]] for c in row["codes"])
            illegal += illegal_pairs(last + row["codes"])
            last = row["codes"][-1]
        if joined:
            yield finished()

    kind = f"conv {conv}, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    return _streamed(ways.repartition("conv").sortWithinPartitions("conv", "piece"), kind, join, "codes")


def _with_audits(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's audit as a row before its rows, which come in order; a task holds whole conversations."""
    head = found.select(
        "conv",
        F.lit(0).alias("kind"),
        F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"),
        F.lit("").alias("role"),
        F.col("audit").alias("text"),
        F.lit(None).cast("binary").alias("digest"),
    )
    body = rows.select("conv", F.lit(1).alias("kind"), "turn", "role", "text", "digest")
    both = head.unionByName(body).repartition("conv")
    return both.sortWithinPartitions("conv", "kind", "turn", "role", "digest").select("conv", "kind", "role", "text")


def edited(rows: Iterator[dict]) -> Iterator[tuple[object, bool, str, str, str]]:
    """(conversation, whether it begins, edit, role, text) of what stays or comes; a beginning has no edit."""
    conv, audit, at, state = None, "", 0, START

    def inserted():
        nonlocal at, state
        while at < len(audit) and audit[at] == INSERT:
            letter = next(r for r in ROLE if r in NEXT[state])
            at, state = at + 1, NEXT[state][letter]
            yield conv, False, INSERT, ROLE[letter], ""

    for row in rows:
        if row["kind"] == 0:
            conv, audit, at, state = row["conv"], row["text"], 0, START
            yield conv, True, "", "", ""
            yield from inserted()
            continue
        edit = audit[at]
        at += 1
        if edit == KEEP:
            state = NEXT[state][row["role"][0]]
            yield conv, False, KEEP, row["role"], row["text"]
        elif edit == REROLE:
            letter = next(r for r in ROLE if r in NEXT[state])
            state = NEXT[state][letter]
            yield conv, False, REROLE, ROLE[letter], row["text"]
        yield from inserted()


def repaired_rows(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``conv, position, edit, role, text`` of the repaired conversations; deleted rows are left out."""

    def work(given):
        position = 0
        for conv, begins, edit, role, text in edited(given):
            position = 0 if begins else position + 1
            if not begins:
                yield conv, position, edit, role, text

    kind = f"conv {_conv_type(rows)}, position long, edit string, role string, text string"
    return _streamed(_with_audits(rows, found), kind, work, "text")


def repaired_digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``conv`` and the SHA-256 of its repaired rows as ``role:text``, joined by line ends; texts pass by one at a time."""

    def work(given):
        conv, digest, first = None, None, True
        for here, begins, _, role, text in edited(given):
            if begins:
                if digest:
                    yield conv, digest.hexdigest()
                conv, digest, first = here, hashlib.sha256(), True
                continue
            digest.update(f"{'' if first else chr(10)}{role}:{text}".encode("utf-8", "replace"))
            first = False
        if digest:
            yield conv, digest.hexdigest()

    return _streamed(_with_audits(rows, found), f"conv {_conv_type(rows)}, repaired_sha256 string", work, "text")


def turn_gaps(rows: DataFrame) -> DataFrame:
    """``conv`` and ``gaps``: missing numbers between its least and greatest turn; null beyond 64 bits."""
    wide = F.col("turn").cast("decimal(38,0)")
    turns = rows.groupBy("conv").agg(
        F.max(wide).alias("last"), F.min(wide).alias("first"), F.count_distinct("turn").cast("decimal(38,0)").alias("n")
    )
    gaps = F.when(F.col("n") == 0, F.lit(0).cast("decimal(38,0)")).otherwise(F.col("last") - F.col("first") + 1 - F.col("n"))
    return turns.select("conv", gaps.try_cast("bigint").alias("gaps"))


def repair(df: DataFrame, conv: str, turn: str, role: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The rows as the repair reads them (see :func:`named_rows`) and each conversation's faults, cost and audit.

    :func:`repaired_rows` and :func:`repaired_digests` apply the audits. Faults are the first one of each row that holds:
    blank, duplicate (role and text seen earlier), truncated (no sentence end). A very long conversation's texts are
    hashed by one task, as SHA-256 asks, with one text in memory at a time; all else of it is spread over tasks.
    """
    rows = named_rows(df, conv, turn, role, text)
    pieces, read = coded_pieces(rows)
    found, _ = written(audits(pieces), "audits")
    discard(df.sparkSession, *read)
    return rows, found


def damage(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """``conv, turn, role, text`` with faults by crc32 of ``conv:turn``, for trials of the repair.

    Of 20 remainders, 0 drops a row, 1 empties its text, 2 takes its sentence ends, 3 repeats it and 4 makes it the
    user's. Missing values count as one blank.
    """
    blank = F.lit(" ")
    name = F.concat(*[x for c in (conv, turn) for x in (F.coalesce(F.col(c).cast("string"), blank), F.lit(":"))][:-1])
    rows = df.select(
        F.col(conv).alias("conv"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), blank).alias("role"),
        F.coalesce(F.col(text).cast("string"), blank).alias("text"),
        (F.crc32(name) % 20).alias("damage"),
    ).where("damage <> 0")
    kind = F.col("damage")
    return rows.select(
        "conv",
        "turn",
        F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")
