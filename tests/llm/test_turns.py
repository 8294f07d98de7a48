from __future__ import annotations

import hashlib
import random
import re
import zlib
from itertools import groupby

import pytest

from corollary.llm import turns

SCHEMA = "conv_id long, turn long, role string, text string, conv string, n int, block int, cost string"


def all_repairs(rows: list[tuple[str, bool, bool]], most: int = 2):
    """Every (cost, audit) of a row list of (initial, forced, truncated), with at most ``most`` inserts in a place: plain enumeration."""
    found = []

    def go(i: int, roles: str, audit: str, cost: int, inserts: int) -> None:
        if not re.fullmatch("s?(ua)*u?", roles):
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            found.append((cost, audit))
        if inserts < most:
            for r in "ua":
                go(i, roles + r, audit + "I", cost + 3, inserts + 1)
        if i < len(rows):
            initial, forced, truncated = rows[i]
            go(i + 1, roles, audit + "D", cost + 4, 0)
            if not forced:
                extra = 3 if truncated else 0
                go(i + 1, roles + (initial or "?"), audit + "K", cost + extra, 0)
                for r in "ua":
                    go(i + 1, roles + r, audit + "R", cost + 3 + extra, 0)

    go(0, "", "", 0, 0)
    return found


def by_hand(rows: list[tuple], damage: bool = True) -> dict:
    """The contract's figures by a table over positions and states, row by row in plain Python."""
    out = {}
    key = lambda r: (r[0] is not None, r[0] or 0)
    for conv, group in groupby(sorted(rows, key=key), key=lambda r: r[0]):
        after = []
        for _, turn, role, text in group:
            name = lambda v: " " if v is None else str(v)
            kind = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20 if damage else 9
            role, text = name(role), name(text)
            if kind == 0:
                continue
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            after += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, seen = [], set()
        for _, role, text in after:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
            seen.add((role, text))
        known = [r[0] for r in after if r[0] is not None]
        line = {f: faults.count(f) for f in ("blank", "duplicate", "truncated")}
        line["gaps"] = max(known) - min(known) + 1 - len(set(known)) if known else 0
        line["illegal"] = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(after, after[1:], strict=False))
        # States by their last initial; the value is (cost, audit, repaired turns).
        step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
        full = {"u": "user", "a": "assistant"}

        def inserted(best: dict) -> dict:
            for _ in range(3):
                for state, (cost, audit, kept) in list(best.items()):
                    for r in "ua":
                        if r in step[state]:
                            new = (cost + 3, audit + "I", [*kept, (full[r], "")])
                            best[r] = min(best.get(r, new), new)
            return best

        best = inserted({"": (0, "", [])})
        for (_, role, text), fault in zip(after, faults, strict=True):
            nxt = {}
            for state, (cost, audit, kept) in best.items():
                moves = [(state, (cost + 4, audit + "D", kept))]
                if fault not in ("blank", "duplicate"):
                    extra = 3 if fault else 0
                    if role[:1] in step[state]:
                        moves.append((step[state][role[:1]], (cost + extra, audit + "K", [*kept, (role, text)])))
                    moves += [(r, (cost + extra + 3, audit + "R", [*kept, (full[r], text)])) for r in "ua" if r in step[state]]
                for to, new in moves:
                    nxt[to] = min(nxt.get(to, new), new)
            best = inserted(nxt)
        line["cost"], line["audit"], kept = min(best[s] for s in ("", "a") if s in best)
        line["repaired_sha256"] = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out[conv] = line
    return out


def as_dict(df) -> dict:
    rows = df.collect()
    assert len({r["conv"] for r in rows}) == len(rows)
    return {r["conv"]: {c: r[c] for c in r.asDict() if c != "conv"} for r in rows}


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 7, 3, None) for r in rows], SCHEMA).repartition(3)


def test_search_against_every_repair():
    rng = random.Random(3)
    for _ in range(60):
        rows = [(rng.choice("sssuuuaaax"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randrange(5))]
        own = [turns.Row(i, f, t and not f) for i, f, t in rows]
        bounds = turns.Bounds(own)
        best = min(all_repairs([(i, f, t and not f) for i, f, t in rows]))
        assert turns.cheapest(own, 0, turns.ENDS, True) == best
        assert bounds.of(0, 0) <= best[0]


def many(seed: int = 1) -> list[tuple]:
    rng, rows = random.Random(seed), []
    lengths = [0, 1, 2, 3, 5, 8, 8, 5, 30, 3, 90, 2, 2, 6, 4, 150]
    for conv, n in enumerate(lengths * 2):
        for t in range(n):
            role = rng.choices(["user", "assistant", "system", "tool", "", None, "unknown"], [8, 8, 1, 1, 0.3, 0.3, 0.3])[0]
            text = rng.choice(["Well. ", "What then? ", "It ends", "So it is!\n", "", " \t", "No.\x0b"]) + rng.choice(["", "", f"Line {t}.", f"Line {t % 4}"])
            text = None if rng.random() < 0.02 else text
            rows.append((conv, rng.choice([t, t, t, t, t, t + 3, None]), role, text))
    rows += [(None, None, None, None), (None, 1, "user", "Hi."), (None, 1, "user", "Hi."), (None, 2, "assistant", "Yes."), (900, None, "user", None)]
    rows += [(901, 5, "user", "Same."), (901, 5, "user", "Same."), (901, 5, "user", "Same."), (902, 1, "user", "x" * 70_000 + "."), (902, 1, "user", "x" * 70_000 + "!")]
    return rows


@pytest.mark.parametrize("block, parts", [(256, 8), (4, 8), (256, 60), (3, 60)])
def test_against_a_plain_table(spark, block, parts):
    rows, before = many(), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for prepare, damage in ((turns.damaged, True), (turns.undamaged, False)):
            got = as_dict(turns.digests(turns.repair(prepare(frame(spark, rows)), block=block)))
            assert got == by_hand(rows, damage)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_conversation_with_a_third_of_the_rows(spark):
    rng = random.Random(5)
    rows = [(1, t, ("user", "assistant")[t % 2], rng.choice(["Yes.", f"It is {t}.", f"No {t}", ""])) for t in range(1500)]
    rows += [(c, t, ("user", "assistant")[t % 2], f"Turn {t}.") for c in range(2, 602) for t in range(5)]
    repaired = turns.repair(turns.damaged(frame(spark, rows)), block=64)
    assert repaired.where("conv = 1").count() > 10
    assert as_dict(turns.digests(repaired)) == by_hand(rows)


def test_whole_table(spark):
    import pandas as pd

    from corollary.llm import queries

    given = pd.read_parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [tuple(None if v != v else v for v in r) for r in given[["conv_id", "turn", "role", "text"]].itertuples(index=False)]
    got = as_dict(queries.QUERIES["op11_turn_repair"](spark, "/root/testdata/sf0.001").withColumnRenamed("conv_id", "conv"))
    assert got == by_hand(rows)


def test_turns_and_empty_table(spark):
    rows = [(1, 1, "user", "Who?"), (1, 2, "user", "Me."), (1, 4, "system", "Off."), (2, 0, "system", "Be kind."), (2, 1, "assistant", "Yes")]
    got = {r["conv"]: r for r in turns.repair(turns.undamaged(frame(spark, rows))).collect()}
    assert [tuple(t) for t in got[1]["turns"]] == [("user", "Who?"), ("assistant", ""), ("user", "Me."), ("assistant", "Off.")]
    assert (got[1]["audit"], got[1]["cost"], got[1]["gaps"]) == ("KIKR", 6, 1)
    assert [tuple(t) for t in got[2]["turns"]] == [("system", "Be kind."), ("user", ""), ("assistant", "Yes")] and got[2]["cost"] == 6
    assert turns.digests(turns.repair(turns.damaged(spark.createDataFrame([], SCHEMA)))).collect() == []
