from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from corollary.llm import linededup


def tokens(line, shingle):
    w = re.findall(r"[^\x20\x09-\x0D]+", line)
    return frozenset(tuple(w[i:i + shingle]) for i in range(max(1, len(w) - shingle + 1))) if w else frozenset()


def brute(rows, threshold, shingle):
    """Lines that go per id, by comparing every pair of lines."""
    lines = {}
    for i, text in rows:
        for k, line in enumerate((text or "").split("\n")):
            if found := tokens(line, shingle):
                lines.setdefault((i is None, i or 0, k), set()).add((line, found))
    gone = {}
    order = sorted(lines)
    for at, y in enumerate(order):
        for x in order[:at]:
            if any(100 * len(a & b) >= threshold * len(a | b) for _, a in lines[x] for _, b in lines[y]):
                gone.setdefault(None if y[0] else y[1], set()).add(y[2])
                break
    return gone


def check(frame, rows, threshold=80, shingle=1):
    want = brute(rows, threshold, shingle)
    got = {r["__id"]: set(r["__removed"]) for r in linededup.removed_lines(frame, threshold=threshold, shingle=shingle).collect()}
    assert got == want


def near_lines(seed, families=6, variants=30, common=("the", "of"), longest=14):
    rng = random.Random(seed)
    lines = []
    for _ in range(families):
        base = [f"w{rng.randrange(60)}" for _ in range(rng.randrange(3, longest))]
        for _ in range(variants):
            line = list(base)
            for _ in range(rng.randrange(4)):
                line[rng.randrange(len(line))] = rng.choice([f"w{rng.randrange(60)}", *common])
            lines.append(" ".join(line))
    rng.shuffle(lines)
    rows = []
    while lines:
        n = rng.randrange(1, 6)
        rows.append((len(rows), "\n".join(lines[:n])))
        lines = lines[n:]
    return rows


@pytest.mark.parametrize(("seed", "threshold", "shingle", "longest"), [(1, 80, 5, 90), (2, 80, 1, 14), (3, 60, 2, 30)])
def test_against_brute_force(spark, seed, threshold, shingle, longest):
    rows = near_lines(seed, longest=longest)
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows, threshold, shingle)


def test_frequent_tokens_in_slots(spark, monkeypatch):
    monkeypatch.setattr(linededup, "BUCKETS", 4)
    rows = near_lines(9, families=3, variants=40)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert max(linededup.rarity(linededup.lines_of(frame, "doc_id", "text"), 1)[1]) > 1
    check(frame, rows, 80, 1)


def test_odd_rows(spark, odd, empty):
    check(odd, sorted({(r["doc_id"], r["text"]) for r in odd.collect()}, key=str))
    done = linededup.remove_similar_lines(odd)
    assert done.columns == odd.columns and done.count() == odd.count()
    texts = {r["doc_id"]: r["text"] for r in done.collect() if r["doc_id"] is not None}
    assert texts[1] == "" and texts[3] is None and texts[11] == "line" and texts[5] == " \n\t "
    assert linededup.remove_similar_lines(empty).count() == 0


def test_rows_that_share_an_id(spark):
    rows = near_lines(4, families=3, variants=20)
    rows = [(None if i % 3 == 0 else i % 4, text) for i, text in rows]
    rows += [(None, "a line that both of them begin with\nthe first has this one to itself"), (7, None), (None, None), (7, "")]
    rows += [(None, "a line that both of them begin with\nbut that other one is of the second"), *rows[:2]]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    keyed = frame.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("key")).distinct().collect()
    # Documents by id, nulls last, then key; brute force numbers them, and so holds them apart.
    order = sorted(keyed, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["key"]))
    gone = brute([(i, r["text"]) for i, r in enumerate(order)], 80, 1)
    want = {}
    for i, r in enumerate(order):
        left = None if r["text"] is None else "\n".join(line for k, line in enumerate(r["text"].split("\n")) if k not in gone.get(i, ()))
        want[r["doc_id"], r["text"]] = left
    got = linededup.remove_similar_lines(frame.withColumn("before", F.col("text"))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["text"] == want[r["doc_id"], r["before"]]
    begun = [r["text"] for r in got if r["doc_id"] is None and (r["before"] or "").startswith("a line that both")]
    assert sorted(len(t.split("\n")) for t in begun) == [1, 2]


@pytest.mark.parametrize("n", [8, 20, 300])
def test_one_changed_word(spark, n):
    """Seven of nine words are fewer than 80 %, 19 of 21 are not; lines that differ in a quarter of their words both stay."""
    line = [f"a{i}" for i in range(n)]
    near, far = [*line[:-1], "other"], [*line[: n - n // 4], *(f"b{i}" for i in range(n // 4))]
    rows = [(1, " ".join(line)), (2, "\n".join(["its own words", " ".join(near)])), (3, " ".join(far))]
    left = {r["doc_id"]: r["text"] for r in linededup.remove_similar_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert left == {1: rows[0][1], 2: "its own words" if n > 8 else rows[1][1], 3: rows[2][1]}


def test_families_meet_their_leaders_only(spark, tmp_path):
    """Variants of one line are settled by the earliest, so that few candidate pairs are left, not all pairs."""
    base = [f"f{i}" for i in range(30)]
    rows = [(i, " ".join([*base[: i % 30], f"v{i}", *base[i % 30 + 1:]])) for i in range(600)]
    frame = spark.createDataFrame(rows, "doc_id string, text string").repartition(4)
    lines = linededup.lines_of(frame, "doc_id", "text")
    distinct, slots = linededup.distinct_lines(lines, 80, 1)
    assert distinct.count() == 600
    matched = linededup.matched_lines(lines, distinct, slots, 80, 1)
    assert matched.count() == 599
    rows = distinct.select(
        "h1", linededup._place(F.col("at.id"), "string").alias("ord"), "n", "b0", "b1", F.lit(False).alias("open"), F.posexplode("prefix").alias("i", "token")
    )
    assert linededup.candidates(rows, slots, 80).count() == 0


def test_one_shuffle_serves_both_sides(spark):
    """The rows dealt by token are shuffled once."""
    rows = spark.range(10).selectExpr(
        "id h1", "id ord", "5 n", "0L b0", "0L b1", "true open", "0 i", "id % 3 token"
    )
    plan = linededup.candidates(rows, [1] * linededup.CLASSES, 80)._jdf.queryExecution()
    text = plan.executedPlan().toString()
    linededup.candidates(rows, [1] * linededup.CLASSES, 80).count()
    assert text.count("Exchange hashpartitioning(token") + text.count("Exchange hashpartitioning(x_token") <= 2


@pytest.mark.parametrize("kind", ["long", "string", "double", "date"])
def test_ids_of_any_kind(spark, kind):
    rows = near_lines(5, families=3, variants=15)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    cast = F.date_add(F.lit("2020-01-01").cast("date"), F.col("doc_id").cast("int")) if kind == "date" else F.col("doc_id").cast(kind)
    frame = frame.withColumn("name", F.lpad(cast.cast("string"), 12, "0") if kind == "string" else cast)
    gone = brute(rows, 80, 1)
    for r in linededup.with_unique_lines(frame, "name").collect():
        assert r["__lines"]["n_removed"] == len(gone.get(r["doc_id"], ()))


def test_families_whose_rarest_words_differ_meet_few_lines(spark, monkeypatch):
    """Every variant has rare words of its own, so that no rare word leads to the others; few pairs are left all the same."""
    rng = random.Random(11)
    base = [f"f{i}" for i in range(90)]
    rows = []
    for i in range(300):
        line = list(base)
        for k, at in enumerate(rng.sample(range(90), 4)):
            line[at] = f"v{i}x{k}"
        rows.append((i, " ".join(line)))
    made = []
    whole = linededup.candidates
    monkeypatch.setattr(linededup, "candidates", lambda *a: made.append(whole(*a)) or made[-1])
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rows)
    assert made[0].select("h1", "x").distinct().count() < 10 * len(rows)


def test_blanks_of_any_kind(spark):
    """A blank is a space from the first step on, so that words are split at one character; texts keep their own blanks."""
    rows = [(1, "a\tb c\r\n\x0b \x0c\nd  e\tf"), (2, "a b c\na\u00a0b c\t\n \nd e f g"), (3, "x\ra b\tc"), (4, "\t\n\r"), (5, "c\x0cb\x0ba\x0ca")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    lines = linededup.lines_of(frame, "doc_id", "text")
    assert {r["line"] for r in lines.collect() if r["at"]["id"] == 1} == {"a b c ", "d  e f"}
    assert {tuple(r["w"]) for r in lines.select(linededup.words("line").alias("w")).collect()} >= {("a", "b", "c"), ("a\u00a0b", "c"), ("d", "e", "f")}
    check(frame, rows)
    left = {r["doc_id"]: r["text"] for r in linededup.remove_similar_lines(frame).collect()}
    assert left == {1: rows[0][1], 2: "a\u00a0b c\t\n \nd e f g", 3: rows[2][1], 4: rows[3][1], 5: ""}


def test_rows_meet_on_one_number(spark):
    """Token and slot are one key of the join, so that rows are sorted by a number; a line's words are made without a step for each."""
    rows = spark.range(10).selectExpr("id h1", "id ord", "5 n", "0L b0", "0L b1", "true open", "0 i", "id % 3 token")
    plan = linededup.candidates(rows, [1] * linededup.CLASSES, 80)._jdf.queryExecution().optimizedPlan().toString()
    keys = re.findall(r"RepartitionByExpression \[([^\]]*)\]", plan)
    assert keys and not any("," in k for k in keys)
    single = spark.range(1).select(linededup.tokens(F.lit("b a  b")).alias("t"))
    assert single.first()["t"] == ["b", "a"]
    assert "transform" not in spark.range(1).select(linededup.tokens(F.col("id").cast("string")))._jdf.queryExecution().analyzed().toString()


def test_open_lines_meet_once_whichever_is_later(spark):
    """The larger asks the smaller; the later of the two is the one that may go, and a settled line is only met by later ones."""
    def met(*lines):
        rows = [(k, ord_, n, i, 0, 0, is_open, 7) for k, ord_, n, i, is_open in lines]
        frame = spark.createDataFrame(rows, "h1 long, ord long, n int, i int, b0 long, b1 long, open boolean, token long")
        return sorted(map(tuple, linededup.candidates(frame, [1] * linededup.CLASSES, 80).select("h1", "x").distinct().collect()))

    assert met((1, 1, 9, 0, True), (2, 2, 10, 0, True)) == [(2, 1)]
    assert met((1, 2, 9, 0, True), (2, 1, 10, 0, True)) == [(1, 2)]
    assert met((1, 1, 9, 0, True), (2, 1, 9, 0, True)) == [(1, 2), (2, 1)]
    assert met((1, 1, 9, 0, False), (2, 2, 10, 1, True)) == [(2, 1)]
    assert met((1, 2, 9, 0, False), (2, 1, 10, 0, True)) == met((1, 1, 9, 0, False), (2, 2, 10, 0, False)) == []
    assert met((1, 1, 10, 1, True), (2, 2, 10, 1, True)) == [(2, 1)] and met((1, 1, 10, 2, True), (2, 2, 10, 2, True)) == []


def test_bitmaps_bound_the_words_that_differ(spark):
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(4000)}" for _ in range(rng.randrange(1, 120))) for _ in range(60)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    distinct, _ = linededup.distinct_lines(linededup.lines_of(frame, "doc_id", "text"), 80, 1)
    got = [(set(texts[r["at"]["id"]].split()), r["n"], (r["b0"] % 2**64) | (r["b1"] % 2**64) << 64) for r in distinct.collect()]
    used = 0
    for words, n, bits in got:
        assert n == len(words)
        used |= bits
        for others, _, theirs in got:
            assert (bits ^ theirs).bit_count() <= len(words ^ others)
    assert used.bit_count() > 120  # both halves, and all their bits
