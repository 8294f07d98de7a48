"""Line deduplication by an exact set-similarity join.

A line is the set of its words. Words are ordered by rarity; two sets with a Jaccard similarity of at least the threshold
share one of the first words of that order, how many depends on their sizes alone. Lines meet on those words; pairs whose
sizes, whose places in the order or whose bitmaps rule the similarity out are dropped, and the rest are compared word by
word. A line goes if any earlier line matches it. All of it is DataFrame expressions.

Families of thousands of variants of a line would make all pairs of them meet. So lines are first grouped by each of their
few rarest words and by sketches, the words of the smallest and of the largest hashes, which variants are likely to share whatever
words of their own they have. In each group a line is compared with the earliest line and the few before it only, which settles
such families in a few comparisons a line. Lines that this doesn't settle meet all others that share a word of their prefixes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corollary.llm.common import apart, small_side, together
from corollary.session import ensure_checkpoint_dir

#: Least Jaccard similarity of a match, in percent, words of a token, and rarest tokens whose lines are compared first.
THRESHOLD = 80
SHINGLE = 1
LEADING = 2
#: Places of a line's hashes in order, from 1 or backwards from -1, that make a sketch; lines before it in a group, and leaders in
#: all, that a line is compared with at first.
SKETCHES = ((1, 2), (-1, -2))
BEFORE = 3
LEADERS = 4
#: Buckets in which tokens are counted for their rarity, a power of two, and the share of all tokens, one in so many, from which
#: the lines of a token are dealt to more slots.
BUCKETS = 65_536
SLOT_SHARE = 4096
#: Bits of a token's key below its class. Tokens of equal keys only meet in vain: lines that share one meet on its key all the same.
LOW = 40
#: Rarity classes, and the character that stands for the first.
CLASSES, FIRST = 94, 33


def _written(df: DataFrame) -> DataFrame:
    """``df`` as a compressed table in the checkpoint folder, read again: what follows doesn't repeat what came before."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/lines-{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _ceil(numerator: Column, denominator: int) -> Column:
    return F.floor((numerator + (denominator - 1)) / denominator).cast("int")


def _class_of(token: Column, classes: str) -> Column:
    """The class of a token's bucket, from a constant array of one number per bucket."""
    listed = F.split(F.lit(",".join(str(ord(c) - FIRST) for c in classes)), ",").cast("array<long>")
    of = F.get(listed, token.bitwiseAND(F.lit(BUCKETS - 1)).cast("int"))
    return F.coalesce(of, F.lit(0).cast("long"))  # never null, so that arrays of keys are sorted as plain numbers


def _slots_of(token_key: Column, slots: list[int]) -> Column:
    """Slots of the token of a key: one, but for the classes of the most frequent."""
    first = next((k for k, n in enumerate(slots) if n > 1), len(slots))
    rank = F.shiftright(token_key, LOW).cast("int")
    many = F.get(F.array(*(F.lit(n) for n in slots[first:])), rank - first) if first < len(slots) else F.lit(1)
    return F.when(rank < first, F.lit(1)).otherwise(many)


def _plain(text: Column) -> Column:
    """``text`` with spaces for its other blanks, but line ends; translated only where it holds one, as that looks at every character."""
    rare = ("\t", "\x0b", "\x0c", "\r")
    held = F.contains(text, F.lit(rare[0]))
    for blank in rare[1:]:
        held |= F.contains(text, F.lit(blank))
    return F.when(held, F.translate(text, "".join(rare), " " * len(rare))).otherwise(text)


def words(line: Column | str) -> Column:
    """The words of a line of :func:`lines_of`, in order; its only blanks are spaces."""
    return F.array_remove(F.split(line, " "), "")


def token_hashes(line: Column | str, shingle: int = SHINGLE) -> Column:
    """Distinct 64-bit hashes of a line's tokens; of its words' hashes, so that each word is hashed once."""
    def runs(h: Column) -> Column:
        following = [lambda i, k=k: F.get(h, i + k) for k in range(1, shingle)]  # null beyond the end, which a hash skips
        every = F.transform(h, lambda x, i: F.xxhash64(x, *(f(i) for f in following)))
        return F.slice(every, 1, F.greatest(F.lit(1), F.size(h) - (shingle - 1)))

    hashed = F.transform(words(line), lambda w: F.xxhash64(w))
    return F.array_distinct(hashed if shingle == 1 else F.flatten(F.transform(F.array(hashed), runs)))


def repeated(line: Column | str, shingle: int = SHINGLE) -> Column:
    """A line's tokens themselves, repeats included."""
    def runs(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - (shingle - 1)))
        return F.transform(starts, lambda i: F.array_join(F.slice(w, i, shingle), " "))

    return words(line) if shingle == 1 else F.flatten(F.transform(F.array(words(line)), runs))


def tokens(line: Column | str, shingle: int = SHINGLE) -> Column:
    """Distinct tokens themselves, which the last comparison is of."""
    return F.array_distinct(repeated(line, shingle))


def text_key(text_col: str) -> Column:
    """What tells documents apart that share an id, or have none: a hash of the text."""
    return F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Lines with a word: ``at`` (missing, id, text key, line number), by which they are ordered, 128-bit key ``h1``, ``h2``, ``line``.

    A blank of any kind is a space in ``line``, so that lines of equal words and differing blanks between them may be one.
    """
    keyed = docs.select(  # before the lines, so that each text is hashed, and its blanks looked for, once
        F.col(f"`{id_col}`").alias("__id"), text_key(text_col).alias("__key"), _plain(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("__text")
    )
    split = keyed.select("__id", "__key", F.posexplode(F.split("__text", "\n")).alias("__no", "line"))
    return split.where(F.trim("line") != "").select(
        F.struct(
            F.col("__id").isNull().alias("missing"), F.col("__id").alias("id"), F.col("__key").alias("key"), F.col("__no").alias("no")
        ).alias("at"),
        F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), "line",
    )


def rarity(lines: DataFrame, shingle: int = SHINGLE) -> tuple[str, list[int]]:
    """Rarity class of each hash bucket of tokens, as a character, and the number of slots of each class.

    Tokens are counted by bucket over all lines; buckets in order of their counts are cut into classes of about equal shares of all tokens.
    The driver gets one number per bucket. Equal tokens share a bucket, so the classes and then the hashes order all tokens in
    one way, which is what the join needs to be exact; how well a bucket's count tells a token's is a matter of speed.
    """
    if shingle == 1:  # words as rows, which takes no array of hashes; repeats within a line count as well
        each = lines.select(F.explode(words("line")).alias("w")).select(F.xxhash64("w").alias("t"))
    else:
        each = lines.select(F.explode(token_hashes("line", shingle)).alias("t"))
    counted = each.groupBy(F.col("t").bitwiseAND(F.lit(BUCKETS - 1)).cast("int").alias("b")).count().collect()
    counts = [0] * BUCKETS
    for r in counted:
        counts[r["b"]] = r["count"]
    total = max(1, sum(counts))
    classes, slots, before = [""] * BUCKETS, [1] * CLASSES, 0
    for b in sorted(range(BUCKETS), key=lambda b: (counts[b], b)):
        own = min(CLASSES - 1, before * CLASSES // total)
        classes[b] = chr(FIRST + own)
        slots[own] = 1 + counts[b] * SLOT_SHARE // total
        before += counts[b]
    return "".join(classes), slots


def _needed(n: Column, m: Column, threshold: int) -> Column:
    """How many tokens sets of ``n`` and ``m`` share at least where they are similar."""
    return _ceil((n + m) * threshold, 100 + threshold)


def _sizes(n: Column, m: Column, threshold: int) -> Column:
    return (100 * n >= threshold * m) & (100 * m >= threshold * n)


def _gap(bits: list[Column], others: list[Column]) -> Column:
    """Bits in which two bitmaps differ, which are at most as many as tokens that only one set holds."""
    return sum((F.bit_count(a.bitwiseXOR(b)) for a, b in zip(bits, others, strict=True)), F.lit(0))


def _folded(bits: Column, token: Column) -> Column:
    """Adds a token to half a bitmap of 128 bits, each of which tells whether an odd number of tokens hash to it.

    Hashes of a half share their sign. The six bits below it tell the bit: a shift of a long takes its distance modulo 64.
    """
    return bits.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(token, 57).cast("int")))


def _place(at_id: Column, kind: str) -> Column:
    """A number that does not fall where ids rise, nulls last; the same for all ids of kinds that have none."""
    if kind in ("tinyint", "smallint", "int", "bigint"):
        number = at_id.cast("long")
    elif kind == "string":
        number = F.conv(F.rpad(F.hex(F.substring(at_id.cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("long")
    else:
        number = F.lit(0).cast("long")
    return F.coalesce(F.when(at_id.isNotNull(), number), F.lit(2**63 - 1))


def distinct_lines(lines: DataFrame, threshold: int, shingle: int) -> tuple[DataFrame, list[int]]:
    """Every distinct line, written once, and the slots of each class.

    ``h1, h2, at`` (its earliest place), ``copies``, ``n`` (its tokens), ``prefix`` (keys of the rarest, in order), ``sketches``, ``b0, b1``
    (its bitmap).
    """
    classes, slots = rarity(lines, shingle)
    key = lambda t: F.shiftleft(_class_of(t, classes), LOW).bitwiseOR(F.shiftrightunsigned(t, 64 - LOW))
    # A zero among the sorted hashes tells the negative ones from the others: the halves of a bitmap, so that each token is folded once.
    # Each step is used more than once by the next, which keeps plain array functions out of the functions of single tokens.
    mark = F.array(F.lit(0).cast("long"))
    hashed = lines.select("h1", "h2", "at", F.sort_array(F.concat(token_hashes("line", shingle), mark)).alias("z"))
    hashed = hashed.withColumn("zero_at", F.array_position("z", F.lit(0).cast("long")).cast("int"))
    hashed = hashed.withColumn("b0", F.slice("z", F.lit(1), F.col("zero_at") - 1)).withColumn("b1", F.slice("z", F.col("zero_at") + 1, F.size("z")))
    hashed = hashed.select("h1", "h2", "at", "b0", "b1", (F.size("b0") + F.size("b1")).alias("n"), F.concat("b0", "b1").alias("t"))
    n, zero = F.col("n"), F.lit(0).cast("long")
    # A number as well, so that no two kinds of sketches meet; places beyond the line's ends are null, which a hash skips.
    at = lambda k: F.get("t", F.lit(k - 1) if k > 0 else n + k)
    body = F.struct(
        n.alias("n"), F.array(*(F.xxhash64(F.lit(i), *map(at, places)) for i, places in enumerate(SKETCHES))).alias("sketches"),
        F.slice(F.sort_array(F.transform("t", key)), 1, n - _ceil(n * threshold, 100) + 1).alias("prefix"),
        *(F.aggregate(half, zero, _folded).alias(half) for half in ("b0", "b1")),
    )
    distinct = hashed.select("h1", "h2", "at", body.alias("body")).groupBy("h1", "h2").agg(
        F.min("at").alias("at"), F.count(F.lit(1)).alias("copies"), F.first("body").alias("body")
    )
    return _written(distinct.select("h1", "h2", "at", "copies", "body.*")), slots


def _similar(a: Column, b: Column, n: Column, m: Column, threshold: int) -> Column:
    """Whether two arrays of ``n`` and ``m`` distinct tokens have a Jaccard similarity of ``threshold`` percent or more."""
    return (100 + threshold) * F.size(F.array_intersect(a, b)).cast("long") >= threshold * (n + m)  # each array is named, and so made, once


def _staying(condition: Column) -> Column:
    """A condition that is not moved before the shuffle below it, so that both sides of a join read one shuffle."""
    return F.when(F.spark_partition_id() >= 0, condition)


def candidates(rows: DataFrame, slots: list[int], threshold: int) -> DataFrame:
    """``h1, x, gap``: open lines and lines of no later id that share a prefix token and may be similar.

    A row is dealt by its token. It asks, if its line is open, and is asked; rows of a token that many lines have lie in slots, and
    an open line of such a token asks in all of them. Of two open lines the larger asks the smaller, whichever is later: the smaller
    then shares one of fewer tokens with it than its prefix has, and the two meet once. One shuffle serves both sides.
    """
    n, i = F.col("n").cast("long"), F.col("i").cast("long")
    all_of = 100 + threshold
    wide = _slots_of(F.col("token"), slots)
    own = F.pmod(F.col("h1"), wide).cast("int")
    each = rows.withColumn("own", own).withColumn(
        "slot", F.explode(F.when(F.col("open") & (wide > 1), F.sequence(F.lit(0), wide - 1)).otherwise(F.array("own")))
    )
    # An open line is asked by larger ones only, so that it shares 2 n threshold / (100 + threshold) tokens at least with any of them.
    asked_at = ~F.col("open") | (all_of * (n - i) >= 2 * threshold * n)
    flags = F.when(F.col("open"), 1).otherwise(0) + F.when((F.col("slot") == F.col("own")) & asked_at, 2).otherwise(0)
    # Token and slot are one number, by which rows are sorted as such.
    dealt = each.select(
        F.xxhash64("token", "slot").alias("token"), "h1", "ord", n.alias("n"), (all_of * (n - i)).alias("left"), "b0", "b1", flags.alias("flags")
    ).where("flags > 0").repartition("token")
    asks = dealt.where(_staying(F.col("flags").bitwiseAND(F.lit(1)) > 0)).drop("flags")
    asked = dealt.where(_staying(F.col("flags").bitwiseAND(F.lit(2)) > 0)).select(
        F.col("token").alias("x_token"), *(F.col(c).alias(f"x_{c}") for c in ("h1", "ord", "n", "left", "b0", "b1")),
        (F.col("flags").bitwiseAND(F.lit(1)) > 0).alias("x_open"),
    )
    n, m = F.col("n"), F.col("x_n")
    gap = _gap([F.col("b0"), F.col("b1")], [F.col("x_b0"), F.col("x_b1")])
    # At the first token that two lines share, they can only share those from it on: as many as they need, which their sizes then
    # allow as well. In whole numbers and without division, as this is asked of every two rows that meet.
    share = (n + m) * threshold
    may = (
        (F.col("x_left") >= share) & (F.col("left") >= share) & (F.shiftright(n + m - gap, 1) * all_of >= share)
        & (F.col("x_h1") != F.col("h1")) & F.when(F.col("x_open"), n >= m).otherwise(F.col("x_ord") <= F.col("ord"))
    )
    met = asks.join(asked, (F.col("token") == F.col("x_token")) & may).select("h1", "ord", "x_h1", "x_ord", "x_open", gap.alias("gap"))
    one, other = F.struct(F.col("h1"), F.col("x_h1").alias("x")), F.struct(F.col("x_h1").alias("h1"), F.col("h1").alias("x"))
    # One row a pair, in the direction of the later line; two only where the ids don't tell which that is.
    ways = F.when(~F.col("x_open") | (F.col("x_ord") < F.col("ord")), F.array(one)).when(F.col("ord") < F.col("x_ord"), F.array(other))
    return met.select(F.explode(ways.otherwise(F.array(one, other))).alias("pair"), "gap").select("pair.h1", "pair.x", "gap")


def matched_lines(lines: DataFrame, distinct: DataFrame, slots: list[int], threshold: int, shingle: int) -> DataFrame:
    """Keys ``h1, h2`` of the distinct lines that an earlier line matches."""
    ord_ = _place(F.col("at.id"), dict(lines.select("at.id").dtypes)["id"]).alias("ord")

    def verified(pairs: DataFrame, held: DataFrame) -> DataFrame:
        y = held.select("h1", "h2", "at", F.col("line").alias("y_line"), F.col("n").alias("y_n"))
        x = held.select(F.col("h1").alias("x"), F.col("at").alias("x_at"), F.col("line").alias("x_line"), F.col("n").alias("x_n"))
        both = pairs.join(y, "h1").join(x, "x").where("x_at < at")  # lines are shuffled, tokens, which are longer, made of them here
        alike = _similar(repeated("y_line", shingle), repeated("x_line", shingle), F.col("y_n"), F.col("x_n"), threshold)
        return both.where(alike).select("h1", "h2").distinct()

    def held_for(pairs: DataFrame) -> DataFrame:
        needed = small_side(pairs.select("h1").unionAll(pairs.select("x")).distinct())
        some = lines.join(needed, "h1", "left_semi")
        each = some.groupBy("h1", "h2").agg(F.min("at").alias("at"), F.first("line").alias("line"))
        return _written(each.withColumn("n", F.size(tokens("line", shingle)).cast("long")))

    rarest = F.slice("prefix", 1, LEADING)
    first = distinct.select(
        "h1", ord_, "n", "b0", "b1", F.size(rarest).alias("rarest"), F.posexplode(F.concat(rarest, "sketches")).alias("i", "token")
    )
    slot = F.when(F.col("i") < F.col("rarest"), F.pmod(F.col("h1"), _slots_of(F.col("token"), slots)).cast("int")).otherwise(-1)
    near = Window.partitionBy("token", "slot").orderBy("ord", "h1")
    own = F.struct("h1", "n", "b0", "b1")
    until = near.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = F.array(F.first(own).over(until), *(F.lag(own, k).over(near) for k in range(1, BEFORE + 1)))
    led = first.withColumn("slot", slot).withColumn("earlier", earlier).select("h1", "n", "b0", "b1", F.explode("earlier").alias("leader"))
    n, leader = F.col("n"), F.col("leader")
    gap = _gap([F.col("b0"), F.col("b1")], [leader["b0"], leader["b1"]])
    close = gap <= n + leader["n"] - 2 * _needed(n, leader["n"], threshold)
    led = led.where((leader["h1"] != F.col("h1")) & _sizes(n, leader["n"], threshold) & close)
    likely = F.slice(F.sort_array(F.collect_set(F.struct(gap.alias("gap"), leader["h1"].alias("x")))), 1, LEADERS)
    led = _written(led.groupBy("h1").agg(likely.alias("likely")).select("h1", F.explode("likely.x").alias("x")))
    settled = _written(verified(led, held_for(led)))

    done = small_side(settled.select("h1", F.lit(False).alias("told")).distinct())
    rows = distinct.select("h1", ord_, "n", "b0", "b1", "prefix").join(done, "h1", "left").select(
        "h1", "ord", "n", "b0", "b1", F.coalesce("told", F.lit(True)).alias("open"), F.posexplode("prefix").alias("i", "token")
    )
    pairs = _written(candidates(rows, slots, threshold).groupBy("h1", "x").agg(F.min("gap").alias("gap")))
    # One match is enough: the likeliest is compared first, and only lines that it doesn't settle with all the others.
    held = held_for(pairs)
    likeliest = pairs.groupBy("h1").agg(F.min(F.struct("gap", "x")).alias("best")).select("h1", F.col("best.x").alias("x"))
    soon = _written(verified(likeliest, held))
    late = pairs.select("h1", "x").join(soon.select("h1").distinct(), "h1", "left_anti").join(likeliest, ["h1", "x"], "left_anti")
    return settled.unionAll(soon).unionAll(verified(late, held)).distinct()


def removed_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, shingle: int = SHINGLE,
) -> DataFrame:
    """``__id``, ``__key``, ``__removed``: per id and text, the numbers (from 0) of the lines that go, where any does."""
    lines = lines_of(docs, id_col, text_col)
    distinct, slots = distinct_lines(lines, threshold, shingle)
    matched = matched_lines(lines, distinct, slots, threshold, shingle).withColumn("near", F.lit(True))
    told = distinct.select("h1", "h2", F.col("at").alias("first"), "copies").join(matched, ["h1", "h2"], "left")
    told = _written(told.where("copies > 1 or near").select("h1", "h2", "first", "near"))
    gone = lines.select("at", "h1", "h2").join(told, ["h1", "h2"]).where(F.col("near") | (F.col("at") > F.col("first")))
    return gone.groupBy(F.col("at.id").alias("__id"), F.col("at.key").alias("__key")).agg(F.collect_set("at.no").alias("__removed"))


def with_unique_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, shingle: int = SHINGLE,
) -> DataFrame:
    """``docs`` with lines removed from ``text_col``, and a struct ``__lines`` of ``n_lines`` and ``n_removed``.

    Lines are what ``\\n`` divides a text into, ordered by id (nulls last), text (by its hash) and number; those with a word take part. A line
    goes if an earlier one has a token set of a Jaccard similarity of ``threshold`` percent or more, whether that one goes itself
    or not. What is left is joined by ``\\n``; a document from which all goes keeps its row, with its lines without words or an
    empty text. A null text stays null and has no line. Rows of one id, or of none, with different texts are documents of their own;
    rows equal in both are one: their lines don't remove each other, and what goes goes from every such row. Other columns are
    carried along, an empty table gives an empty result.

    Equal lines are one row from the first aggregate on. Tokens that many lines share are dealt to slots, by the rarity
    counts. Distinct lines' prefixes are shuffled, and the tokens of lines that share one; texts are only where more documents
    lose lines than a broadcast may hold.
    """
    gone = removed_lines(docs, id_col, text_col, threshold, shingle)
    gone = small_side(_written(gone), 500_000)
    same = F.col(f"`{id_col}`").eqNullSafe(F.col("__id")) & (text_key(text_col) == F.col("__key"))
    joined = docs.join(gone, same, "left").drop("__id", "__key")
    text = F.col(f"`{text_col}`")
    lines = F.split(text, "\n")
    left = F.filter(lines, lambda line, i: ~F.array_contains(F.col("__removed"), i))
    counts = F.struct(
        F.when(text.isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(text.isNull() | F.col("__removed").isNull(), F.lit(0)).otherwise(F.size("__removed")).cast("long").alias("n_removed"),
    )
    shorter = F.when(F.col("__removed").isNull(), text).otherwise(F.array_join(left, "\n"))
    return joined.withColumn("__lines", counts).withColumn(text_col, shorter).drop("__removed")


def remove_similar_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, shingle: int = SHINGLE,
) -> DataFrame:
    """The columns of ``docs`` after :func:`with_unique_lines`, whatever their names."""
    left = with_unique_lines(apart(docs, id_col, text_col), id_col, text_col, threshold, shingle)
    return together(left, docs, id_col, text_col)
