"""Repair of the turn structure of conversations by depth-first branch and bound.

A conversation is well formed if its role initials are empty or an optional ``s`` and then one or more ``ua``. Edits make it so:
Keep a row, Delete it, Rerole it to the one role that fits, Insert an empty turn of that role. The search keeps an explicit stack, bounds
what the rest must cost from below, drops what can't beat the best repair found so far, and drops a prefix that
is no better than another one seen at the same node.

Rows are sorted by conversation and turn over all partitions at once, so that one long conversation is spread like any
other data, and cut into blocks of at most ``BLOCK`` rows. A block is solved from every role state it may be entered in to every
state it may be left in, and the cheapest chain of blocks is the repair.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corollary.session import ensure_checkpoint_dir

#: Rows of a block, and characters of blocks that a task hands on at once.
BLOCK, BATCH_CHARS = 256, 4_000_000
# Costs of the edits, and of a truncated row that stays
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Initials that may follow a state: 0 nothing yet, 1 after s, 2 after u, 3 after a.
FOLLOWS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The role that an inserted or reroled turn takes in a state, and the states a conversation may end in.
FITS, ENDS = ("u", "u", "a", "u"), (0, 3)
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
BLANKS, STOPS = " \t\n\x0b\x0c\r", ".!?"

TURNS = "array<struct<role string, text string>>"
REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


# --- one block --------------------------------------------------------------------------


@dataclass(frozen=True)
class Row:
    """``n`` equal rows: the first has the initial and the fault, the others can only be deleted."""

    initial: str
    forced: bool = False
    truncated: bool = False
    n: int = 1

    @property
    def least(self) -> int:
        """What the rows cost at least, whatever stands beside them."""
        rest = DELETE * (self.n - 1)
        if self.forced:
            return DELETE + rest
        stay = TRUNCATED * self.truncated + (KEEP if self.initial in ("s", "u", "a") else REROLE)
        return min(DELETE, stay) + rest

    @property
    def change(self) -> int:
        """What it costs beyond that to delete or rerole the first."""
        return min(DELETE, REROLE + TRUNCATED * self.truncated) + DELETE * (self.n - 1) - self.least


class Bounds:
    """Lower bounds of the cost of the rows from one on, given the state before it.

    Each row costs its least. Two neighbours of which the second can't follow the first cost an insert or a change of one of them besides;
    a row is counted in one such pair only.
    """

    def __init__(self, rows: list[Row]) -> None:
        self.rows, n = rows, len(rows)
        self.free = [n] * (n + 1)  # the first row from here on that need not go
        self.forced = [0] * (n + 1)  # cost of the rows up to that one
        self.rest = [0] * (n + 2)  # bound from a row on, whatever the state
        for i in range(n - 1, -1, -1):
            row = rows[i]
            if row.forced:
                self.free[i] = self.free[i + 1]
                self.forced[i] = row.least + self.forced[i + 1]
                self.rest[i] = row.least + self.rest[i + 1]
                continue
            self.free[i] = i
            plain = row.least + self.rest[i + 1]
            j = self.free[i + 1]
            if j < n and self._clash(row.initial, rows[j].initial):
                extra = min(INSERT, row.change, rows[j].change)
                plain = max(plain, row.least + self.forced[i + 1] + rows[j].least + extra + self.rest[j + 1])
            self.rest[i] = plain

    @staticmethod
    def _clash(before: str, after: str) -> bool:
        return before in ("s", "u", "a") and after in ("s", "u", "a") and before + after not in LEGAL

    def of(self, i: int, state: int) -> int:
        j, bound = self.free[i], self.rest[i]
        if j < len(self.rows) and self.rows[j].initial in ("s", "u", "a") and self.rows[j].initial not in FOLLOWS[state]:
            row = self.rows[j]
            bound = max(bound, self.forced[i] + row.least + min(INSERT, row.change) + self.rest[j + 1])
        return bound


def cheapest(rows: list[Row], entry: int, exits: tuple[int, ...], last: bool, bounds: Bounds | None = None) -> tuple[int, str] | None:
    """Least (cost, audit) of all edits of ``rows`` that lead from state ``entry`` to one of ``exits``; None if there is none.

    Inserts stand before the row they precede; those after the last row belong to the conversation's ``last`` block.
    """
    bounds = bounds or Bounds(rows)
    n, best, seen = len(rows), None, {}
    stack = [(0, "", 0, entry)]
    while stack:
        cost, audit, i, state = stack.pop()
        if best is not None:
            total = cost + bounds.of(i, state)
            if total > best[0] or (total == best[0] and audit > best[1][: len(audit)]):
                continue
        known = seen.get((i, state))
        if known is not None and known <= (cost, audit):
            continue
        seen[i, state] = (cost, audit)
        if i == n and state in exits and (best is None or (cost, audit) < best):
            best = (cost, audit)
        children = []
        if i < n or last:
            children.append((cost + INSERT, audit + "I", i, FOLLOWS[state][FITS[state]]))
        if i < n:
            row = rows[i]
            gone, tail = DELETE * (row.n - 1), "D" * (row.n - 1)
            children.append((cost + DELETE + gone, audit + "D" + tail, i + 1, state))
            if not row.forced:
                stays = cost + TRUNCATED * row.truncated + gone
                if row.initial in FOLLOWS[state]:
                    children.append((stays + KEEP, audit + "K" + tail, i + 1, FOLLOWS[state][row.initial]))
                children.append((stays + REROLE, audit + "R" + tail, i + 1, FOLLOWS[state][FITS[state]]))
        children.sort(key=lambda c: (c[0] + bounds.of(c[2], c[3]), c[1]), reverse=True)  # the most promising on top
        stack += children
    return best


def block_rows(turns: list[dict], late: Iterable[int] = ()) -> list[Row]:
    late = set(late)
    out = []
    for at, t in enumerate(turns):
        end = t["text"].rstrip(BLANKS)
        forced = not end or t["seen"] or at in late
        out.append(Row(t["role"][:1], forced, not forced and end[-1] not in STOPS, t["n"]))
    return out


def counts(turns: list[dict], rows: list[Row], before: str | None, turn: int | None) -> dict[str, int]:
    """Additive figures of a block that follows a row of role ``before`` and has ``turn`` as the last turn before it."""
    out = dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal"), 0)
    for t, row in zip(turns, rows, strict=True):
        if t["turn"] is not None:
            if turn is not None and t["turn"] != turn:
                out["gaps"] += t["turn"] - turn - 1
            turn = t["turn"]
        if not t["text"].strip(BLANKS):
            out["blank"] += row.n
        else:
            out["duplicate"] += row.n - (not row.forced)
            out["truncated"] += row.truncated
        if before is not None:
            out["illegal"] += before[:1] + row.initial not in LEGAL
        out["illegal"] += row.n - 1
        before = row.initial
    return out


def repaired(turns: list[dict], audit: str, state: int) -> list[dict]:
    """The turns that the edits of ``audit`` leave, from ``state`` on."""
    out, at, copy = [], 0, 0
    for edit in audit:
        if edit == "I":
            out.append({"role": ROLES[FITS[state]], "text": ""})
            state = FOLLOWS[state][FITS[state]]
            continue
        t = turns[at]
        copy += 1
        if edit != "D":
            role = t["role"] if edit == "K" else ROLES[FITS[state]]
            out.append({"role": role, "text": t["text"]})
            state = FOLLOWS[state][role[0]]
        if copy == t["n"]:
            at, copy = at + 1, 0
    return out


# --- Spark side -------------------------------------------------------------------------


def _written(df: DataFrame) -> DataFrame:
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/turns-{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def damaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv, turn, role, text, n``: rows with faults put in by a checksum of conversation and turn.

    Of 20 remainders 0 drops the row, 1 empties its text, 2 takes away its ``. ! ?``, 3 repeats it, 4 makes its role user. A null is
    one space in the checksum, in a role and in a text. ``n`` counts equal rows; a dropped row has 0 and tells that its conversation exists.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(name(conv_col), F.lit(":"), name(turn_col)).cast("binary")) % 20
    rows = conversations.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), name(role_col).alias("role"), name(text_col).alias("text"),
        kind.alias("kind"),
    )
    drop = F.col("kind") == 0
    text = F.when(drop | (F.col("kind") == 1), "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select(
        "conv", F.when(~drop, F.col("turn")).alias("turn"),
        F.when(drop, "").when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.when(drop, 0).when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("n"),
    )


def undamaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv, turn, role, text, n``: the rows as they are, a null role or text as one space."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return conversations.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), name(role_col).alias("role"), name(text_col).alias("text"),
        F.lit(1).cast("long").alias("n"),
    )


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal rows of a batch as one, so that a row that repeats very often is few rows before the shuffle."""
    for batch in batches:
        keys = batch.schema.names[:-1]
        if batch.num_rows:
            small = pa.Table.from_batches([batch]).group_by(keys, use_threads=False).aggregate([("n", "sum")])
            yield from small.rename_columns([*keys, "n"]).to_batches()


def blocks(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows in order of conversation and turn, in blocks: a table with one row for each.

    ``part, no`` number it. ``blk`` counts from the conversation's first row in its partition, ``more`` says that the conversation goes on within the
    partition, ``opens`` that it is the partition's first. ``role, turn`` are the last ones before the block, in this partition.
    A row with ``closes`` and without turns says where the partition's last conversation ends. Turns that are equal in number are in order of role, then of
    the text's first 64 characters, then of its hash.
    """
    conv = rows.schema["conv"].dataType
    keys = ["conv", "turn", "role", "head", "hash"]
    sorted_rows = (
        rows.mapInArrow(_combine, rows.schema)
        .withColumns({"head": F.substring("text", 1, 64), "hash": F.xxhash64("text")})
        .repartitionByRange(*keys).sortWithinPartitions(*keys, "text").select("conv", "turn", "role", "text", "n")
    )

    def cut(rows: Iterable[dict]) -> Iterator[dict]:
        part, no, conversations = TaskContext.get().partitionId(), 0, 0
        turns: list[dict] = []
        seen: set[bytes] = set()
        blk, role, turn, start = 0, None, None, (None, None)
        current = None

        def row(more: bool, closes: bool = False) -> dict:
            return {
                "conv": current, "part": part, "no": no, "blk": blk, "more": more, "opens": conversations == 1, "closes": closes,
                "role": role if closes else start[0], "turn": turn if closes else start[1], "turns": [] if closes else turns,
            }

        for r in rows:
            if not conversations or r["conv"] != current:
                if conversations:
                    yield row(False)
                    no += 1
                current, conversations = r["conv"], conversations + 1
                turns, blk, role, turn, start = [], 0, None, None, (None, None)
                seen.clear()
            if not r["n"]:
                continue
            if turns and all(turns[-1][c] == r[c] for c in ("turn", "role", "text")):
                turns[-1]["n"] += r["n"]
                continue
            if len(turns) == block:
                yield row(True)
                turns, no, blk, start = [], no + 1, blk + 1, (role, turn)
            key = hashlib.blake2b(f"{r['role']}\0{r['text']}".encode(), digest_size=16).digest()
            turns.append({"turn": r["turn"], "role": r["role"], "text": r["text"], "n": r["n"], "seen": key in seen})
            seen.add(key)
            role, turn = r["role"], r["turn"] if r["turn"] is not None else turn
        if conversations:
            yield row(False)
            no += 1
            yield row(False, closes=True)

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, waiting, size = None, [], 0

        def rows() -> Iterator[dict]:
            nonlocal kind
            for batch in batches:
                kind = pa.schema([
                    batch.schema.field("conv"), ("part", pa.int32()), ("no", pa.int64()), ("blk", pa.int64()), ("more", pa.bool_()), ("opens", pa.bool_()),
                    ("closes", pa.bool_()), ("role", pa.string()), ("turn", pa.int64()),
                    ("turns", pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("n", pa.int64()), ("seen", pa.bool_())]))),
                ])
                yield from batch.to_pylist()

        for one in cut(rows()):
            waiting.append(one)
            size += 64 + sum(len(t["text"]) for t in one["turns"])
            if size >= BATCH_CHARS:
                yield pa.RecordBatch.from_pylist(waiting, schema=kind)
                waiting, size = [], 0
        if waiting:
            yield pa.RecordBatch.from_pylist(waiting, schema=kind)

    return sorted_rows.mapInArrow(
        gathered, f"conv {conv.simpleString()}, part int, no long, blk long, more boolean, opens boolean, closes boolean, role string, turn long, "
        "turns array<struct<turn long, role string, text string, n long, seen boolean>>",
    )


def _result(conv, block: int, n_blocks: int, turns: list[dict], rows: list[Row], role, turn, entry: int, cost: int, audit: str) -> dict:
    return {
        "conv": conv, "block": block, "n_blocks": n_blocks, **counts(turns, rows, role, turn), "cost": cost, "audit": audit,
        "turns": repaired(turns, audit, entry),
    }


def _as_batch(rows: list[dict], field: pa.Field) -> pa.RecordBatch:
    longs = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    kind = pa.schema([
        field, ("block", pa.int64()), ("n_blocks", pa.int64()), *((c, pa.int64()) for c in longs), ("audit", pa.string()),
        ("turns", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))),
    ])
    return pa.RecordBatch.from_pylist(rows, schema=kind)


def repair(rows: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """One row per block of at most ``block`` rows of a conversation: the cheapest repair of the whole conversation, and its figures.

    ``rows`` has ``conv, turn, role, text, n`` (see :func:`undamaged`). Returns ``conv, block`` (from 0) and ``n_blocks``; ``gaps, blank, duplicate, truncated,
    illegal`` and ``cost``, of which the sums over blocks are the conversation's; ``audit``, of which those in order of blocks make up the conversation's; and
    ``turns``, the repaired turns of the block as ``role, text``. Nearly all conversations are one block.

    Blank rows and those whose role and text came before must go. A role whose initial isn't s, u or a can't be kept; an empty role has no
    initial. Among repairs of equal cost the audit that is least in ASCII order counts. A conversation without rows left has zeros, an empty audit and no turns; rows without
    conversation are one conversation, turns without number come first. An empty table gives an empty result; the order of turns of equal number is that of :func:`blocks`.

    Rows are shuffled once, by range. Conversations that a range ends in, or of more than a block, are put together from their blocks; the others
    are solved where they lie.
    """
    conv = rows.schema["conv"].dataType.simpleString()
    schema = f"conv {conv}, block long, n_blocks long, {REPORT}, turns {TURNS}"
    every = _written(blocks(rows, block))
    # At most two rows per partition, whatever the data.
    ends = every.where("opens or closes").groupBy("conv").agg(F.count_distinct("part").alias("parts")).where("parts > 1").select(F.col("conv").alias("torn"))
    real = (
        every.where("not closes").join(F.broadcast(ends.withColumn("is_torn", F.lit(True))), F.col("conv").eqNullSafe(F.col("torn")), "left")
        .withColumn("is_torn", F.coalesce("is_torn", F.lit(False))).drop("torn")
    )
    alone = F.expr("blk = 0 and not more and not is_torn")

    def solve_alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                own = block_rows(r["turns"])
                cost, audit = cheapest(own, 0, ENDS, True)
                out.append(_result(r["conv"], 0, 1, r["turns"], own, None, None, 0, cost, audit))
            yield _as_batch(out, batch.schema.field("conv"))

    whole = real.where(alone).select("conv", "turns").mapInArrow(solve_alone, schema)
    # As constants, so that a filter on them is settled without solving anything.
    whole = whole.withColumns({"block": F.lit(0).cast("long"), "n_blocks": F.lit(1).cast("long")})
    return whole.unionAll(_chained(every, real.where(~alone), schema))


def _chained(every: DataFrame, cut: DataFrame, schema: str) -> DataFrame:
    """The same for conversations of several blocks."""
    conv = every.schema["conv"].dataType.simpleString()
    # Rows that came before in another partition: all but the first of each role and text.
    told = cut.where("is_torn").select("conv", "part", "no", F.posexplode("turns").alias("at", "t")).where("not t.seen")
    keyed = told.select("conv", F.sha2(F.concat_ws("\0", "t.role", "t.text"), 256).alias("key"), "part", "no", "at")
    first = keyed.groupBy("conv", "key").agg(F.min(F.struct("part", "no", "at")).alias("f")).select("f.*")
    late = keyed.join(first, ["part", "no", "at"], "left_anti").groupBy("part", "no").agg(F.collect_set("at").alias("late"))  # a block's rows at most
    # The last role and turn before each partition of a torn conversation: a few numbers per partition.
    order = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ends = every.where("closes").select("conv", "part", "role", "turn").unionAll(
        every.where("opens and blk = 0 and not closes").select("conv", "part", F.lit(None).cast("string"), F.lit(None).cast("long"))
    ).groupBy("conv", "part").agg(F.max("role").alias("role"), F.max("turn").alias("turn"))
    before = ends.select(
        F.col("conv").alias("of"), F.col("part").alias("at_part"), F.last("role", True).over(order).alias("role_before"),
        F.last("turn", True).over(order).alias("turn_before"),
    )
    begins = F.col("opens") & (F.col("blk") == 0)
    ready = (
        cut.join(late, ["part", "no"], "left")
        .join(F.broadcast(before), F.col("conv").eqNullSafe(F.col("of")) & (F.col("part") == F.col("at_part")), "left")
        .select(
            "conv", "part", "no", F.when(begins, F.col("role_before")).otherwise(F.col("role")).alias("role"),
            F.when(F.col("turn").isNull(), F.col("turn_before")).otherwise(F.col("turn")).alias("turn"),
            F.coalesce("late", F.array().cast("array<int>")).alias("late"), "turns",
        )
    )

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.select(["turns", "late"]).to_pylist():
                own = block_rows(r["turns"], r["late"])
                bounds = Bounds(own)
                found = []
                for entry in range(4):
                    for leave in range(4):
                        for last in (False, True):
                            best = cheapest(own, entry, (leave,), last, bounds)
                            if best is not None:
                                found.append({"entry": entry, "leave": leave, "last": last, "cost": best[0], "audit": best[1]})
                out.append(found)
            kind = pa.list_(pa.struct([("entry", pa.int32()), ("leave", pa.int32()), ("last", pa.bool_()), ("cost", pa.int64()), ("audit", pa.string())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], names=[*batch.schema.names, "found"])

    fields = f"conv {conv}, part int, no long, role string, turn long, late array<int>, turns {cut.schema['turns'].dataType.simpleString()}"
    solved = _written(ready.mapInArrow(solve, f"{fields}, found array<struct<entry int, leave int, last boolean, cost long, audit string>>"))

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Follow the blocks of each conversation in turn; at the end, name the states of the cheapest chain."""

        def chains(rows: Iterator[dict]) -> Iterator[dict]:
            for _, group in groupby(rows, key=lambda r: (r["conv"] is None, r["conv"])):
                # Of each state: the cost so far, and the place of its audit in the order of the states' audits. All audits
                # so far cover the same rows and differ, so none begins another and their order settles all later ones.
                at, came, path = [], [], {0: (0, 0)}
                here = next(group)
                while here is not None:
                    following = next(group, None)
                    at.append((here["part"], here["no"]))
                    after: dict[int, tuple] = {}
                    for f in here["found"]:
                        if f["last"] == (following is None) and f["entry"] in path:
                            cost, place = path[f["entry"]]
                            now = (cost + f["cost"], place, f["audit"], f["entry"])
                            after[f["leave"]] = min(after.get(f["leave"], now), now)
                    came.append(bytes(after[s][3] if s in after else 0 for s in range(4)))
                    order = sorted(after, key=lambda s: after[s][1:3])
                    path, here = {s: (after[s][0], place) for place, s in enumerate(order)}, following
                state, states = min((path[s], s) for s in ENDS if s in path)[1], []
                for back in reversed(came):
                    states.append((back[state], state))
                    state = back[state]
                for i, ((part, no), (entry, leave)) in enumerate(zip(at, reversed(states), strict=True)):
                    yield {"part": part, "no": no, "entry": entry, "leave": leave, "block": i, "n_blocks": len(at)}

        kind = pa.schema([("part", pa.int32()), ("no", pa.int64()), ("entry", pa.int32()), ("leave", pa.int32()), ("block", pa.int64()), ("n_blocks", pa.int64())])
        waiting: list[dict] = []
        for one in chains(r for batch in batches for r in batch.to_pylist()):
            waiting.append(one)
            if len(waiting) >= 4096:
                yield pa.RecordBatch.from_pylist(waiting, schema=kind)
                waiting = []
        if waiting:
            yield pa.RecordBatch.from_pylist(waiting, schema=kind)

    chosen = (
        solved.select("conv", "part", "no", "found").repartition("conv").sortWithinPartitions("conv", "part", "no")
        .mapInArrow(chain, "part int, no long, entry int, leave int, block long, n_blocks long")
    )

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                best = next(f for f in r["found"] if (f["entry"], f["leave"], f["last"]) == (r["entry"], r["leave"], r["block"] == r["n_blocks"] - 1))
                rows = block_rows(r["turns"], r["late"])
                out.append(_result(r["conv"], r["block"], r["n_blocks"], r["turns"], rows, r["role"], r["turn"], r["entry"], best["cost"], best["audit"]))
            yield _as_batch(out, batch.schema.field("conv"))

    return solved.join(chosen, ["part", "no"]).mapInArrow(apply, schema)


def spelled(turns: Column | str) -> Column:
    """``role:text`` of each turn, joined by line feeds."""
    return F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")


def digests(blocks_repaired: DataFrame) -> DataFrame:
    """One row per conversation of :func:`repair`: ``conv``, its figures, its audit, and ``repaired_sha256`` of :func:`spelled`.

    A checksum reads its text from front to end, so conversations of several blocks pass one task each, block by block; nothing but
    the checksum's state and the audit is kept of them.
    """
    conv = blocks_repaired.schema["conv"].dataType.simpleString()
    figures = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    schema = f"conv {conv}, {REPORT}, repaired_sha256 string"
    short = blocks_repaired.where("n_blocks = 1").select("conv", *figures, "audit", F.sha2(spelled("turns"), 256).alias("repaired_sha256"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = current = None

        def rows() -> Iterator[dict]:
            nonlocal kind
            for batch in batches:
                kind = pa.schema([
                    batch.schema.field("conv"), *((c, pa.int64()) for c in figures), ("audit", pa.string()), ("repaired_sha256", pa.string()),
                ])
                yield from batch.to_pylist()

        for r in rows():
            if r["block"] == 0:
                current = {"conv": r["conv"], **dict.fromkeys(figures, 0)}
                audit, sha, any_turn = [], hashlib.sha256(), False
            for c in figures:
                current[c] += r[c]
            audit.append(r["audit"])
            for t in r["turns"]:
                sha.update(f"{chr(10) if any_turn else ''}{t['role']}:{t['text']}".encode())
                any_turn = True
            if r["block"] == r["n_blocks"] - 1:
                yield pa.RecordBatch.from_pylist([{**current, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()}], schema=kind)

    long = blocks_repaired.where("n_blocks > 1").repartition("conv").sortWithinPartitions("conv", "block").mapInArrow(read, schema)
    return short.unionAll(long)
