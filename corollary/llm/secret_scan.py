"""Secrets in texts: known patterns, and tokens that pass a battery of randomness tests under false-discovery control.

All of it is DataFrame expressions. Candidates are the longest stretches of each encoding's characters, so a token is tested
also where a name, an equals sign or characters of another encoding touch it. Under the hypothesis that one is random in its encoding, three statistics are standard normal, about: chi-squared of its characters against a uniform
alphabet, the number of runs above and below the middle of the alphabet, and the serial correlation of neighbours. Their
smallest p-value, corrected for three tests, is uniform for random tokens and near zero for language. Candidates are
grouped by encoding and length, as short tokens say little; in each group the number of random tokens is bounded from
above by the p-values above one half, and the smallest cut is taken at which the share of other tokens among those
reported isn't shown to exceed a bound. So a token whose group says nothing about it, as it has few others, is reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corollary.llm.common import apart, together

#: Fixed patterns, in the order in which kinds are listed.
ASSIGN = r"""((?i)(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LENGTH = 6
KINDS = ("assign", "access", "hex", "random")

#: Equals signs are part of a token only where they end it.
PADDING = r"(?:=+(?![A-Za-z0-9+/_=-]))?"
#: A run that may hold tokens, their alphabets (sizes are even; of several that hold the same stretch the first counts) and shortest lengths.
CANDIDATE = rf"[A-Za-z0-9+/_-]{{16,}}{PADDING}"
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = (
    ("hex", DIGITS + "abcdef", 16), ("hexupper", DIGITS + "ABCDEF", 16), ("base32", UPPER + "234567", 20), ("base36", DIGITS + LOWER, 20),
    ("base64", UPPER + LOWER + DIGITS + "+/", 20), ("base64url", UPPER + LOWER + DIGITS + "-_", 20),
)
#: Below ALPHA a token is not random; BINS divides the range of p-values; LENGTH_STEP and LENGTHS make length groups.
ALPHA, BINS, FALSE_SHARE, LENGTH_STEP, LENGTHS = 0.001, 50, 0.05, 16, 8
#: Standard deviations that the number of random tokens may lie above its estimate.
DOUBT = 2.0


def _matches(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches as structs (start, value), in code points.

    The text between matches is what ``split`` leaves, so starts are running sums of lengths.
    """
    pieces = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(F.slice(pieces, 1, F.size(found)).alias("gap"), found.alias("value"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,value:string>>").alias("out"))
    return F.aggregate(
        pairs, start,
        lambda acc, p: F.struct(
            (acc["at"] + p["gap"] + F.length(p["value"])).alias("at"),
            F.concat(acc["out"], F.array(F.struct((acc["at"] + p["gap"]).alias("start"), p["value"].alias("value")))).alias("out"),
        ),
    )["out"]


def _spans(text: Column, kind: int, pattern: str, keep=lambda value: F.lit(True)) -> Column:
    """Spans (start, kind, end) of a pattern's matches that ``keep`` takes; the pattern is only cut out of texts that hold it."""
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    found = F.transform(
        F.filter(_matches(text, pattern), lambda m: keep(m["value"])),
        lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), (m["start"] + F.length(m["value"])).alias("end")),
    )
    return F.when(F.rlike(text, F.lit(pattern)), found).otherwise(none)


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` written, and worked out, once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _tail(z: Column) -> Column:
    """Upper tail of the standard normal; the rational approximation of Abramowitz and Stegun 26.2.17, error below 1e-7."""

    def of(z: Column, t: Column) -> Column:
        poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
        p = F.exp(-z * z / 2) * 0.3989422804014327 * poly
        return F.when(z >= 0, p).otherwise(1 - p)

    return _let(z, lambda z: _let(1 / (1 + 0.2316419 * F.abs(z)), lambda t: of(z, t)))


def battery(token: Column, alphabet: Column) -> Column:
    """p-value of a token's randomness over an alphabet: smallest of three tests, corrected for their number."""
    characters = lambda text: F.split(text, "(?!^)(?!$)")

    def chi(body: Column, n: Column, size: Column) -> Column:
        squares = F.aggregate(
            characters(alphabet), F.lit(0.0), lambda s, c: s + F.pow(n - F.length(F.replace(body, c, F.lit(""))), F.lit(2))
        )
        return (squares * size / n - n - (size - 1)) / F.sqrt(2 * (size - 1) * (n - 1) / n)

    def runs(pairs: Column, n: Column, size: Column) -> Column:
        changes = F.size(F.filter(pairs, lambda p: (p["a"] < size / 2) != (p["b"] < size / 2)))
        return F.abs((changes - (n - 1) / 2) / F.sqrt((n - 1) / 4))

    def serial(at: Column, pairs: Column, n: Column, size: Column) -> Column:
        total = F.aggregate(at, F.lit(0.0), lambda s, x: s + x)
        squares = F.aggregate(at, F.lit(0.0), lambda s, x: s + x * x)
        shared = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + p["a"] * p["b"])

        def of(v: Column) -> Column:
            mean = v["total"] / n
            spread = v["squares"] - n * mean * mean
            covariance = v["shared"] - mean * (2 * v["total"] - v["ends"]) + (n - 1) * mean * mean
            return F.when(spread > 0, F.abs((covariance / spread + 1 / n) * F.sqrt(n))).otherwise(F.lit(99.0))

        return _let(F.struct(
            total.alias("total"), squares.alias("squares"), shared.alias("shared"), (F.element_at(at, 1) + F.element_at(at, -1)).alias("ends")
        ), of)

    def combined(body: Column, n: Column, size: Column, at: Column, pairs: Column) -> Column:
        least = F.least(_tail(chi(body, n, size)), 2 * _tail(runs(pairs, n, size)), 2 * _tail(serial(at, pairs, n, size)))
        return 1 - F.pow(1 - least, F.lit(3))

    body = F.regexp_replace(token, "=+$", "")  # padding isn't content
    place = lambda c: (F.instr(alphabet, c) - 1).cast("double")
    return _let(body, lambda body: _let(F.length(body).cast("double"), lambda n: _let(F.length(alphabet), lambda size: _let(
        F.transform(characters(body), place), lambda at: _let(
            F.arrays_zip(F.slice(at, 1, F.size(at) - 1).alias("a"), F.slice(at, 2, F.size(at) - 1).alias("b")),
            lambda pairs: combined(body, n, size, at, pairs),
        )))))


def _mixed(value: Column) -> Column:
    """Whether a token has digits and letters."""
    return F.rlike(value, F.lit("[0-9]")) & F.rlike(value, F.lit("[A-Za-z]"))


def _stretches(run: Column) -> Column:
    """Longest stretches of each alphabet in a run, with digits and letters, as structs (at, to, encoding); ``at`` counts from 0.

    A stretch of one alphabet may lie in a longer one of another; where they are the same, it is of the first.
    """
    def places(alphabet: str, least: int) -> Column:
        pattern = f"[{alphabet.replace('-_', '_-')}]{{{least},}}{PADDING}"
        found = F.transform(
            F.filter(_matches(run, pattern), lambda m: _mixed(m["value"])),
            lambda m: F.shiftleft(m["start"].cast("long"), 32) + m["start"] + F.length(m["value"]),  # one number: compared by hash
        )
        return F.when(F.rlike(run, F.lit(pattern)), found).otherwise(F.array().cast("array<bigint>"))

    def first(held: Column) -> Column:
        own = [held["e0"]] + [
            F.array_except(held[f"e{k}"], F.concat(*(held[f"e{j}"] for j in range(k)))) for k in range(1, len(ENCODINGS))
        ]
        return F.concat(*(F.transform(keys, unpacked(k)) for k, keys in enumerate(own)))

    def unpacked(k: int):
        return lambda x: F.struct(
            F.shiftright(x, 32).cast("int").alias("at"), x.bitwiseAND(F.lit(2**32 - 1)).cast("int").alias("to"), F.lit(k).alias("encoding")
        )

    return _let(F.struct(*(places(alphabet, least).alias(f"e{k}") for k, (_, alphabet, least) in enumerate(ENCODINGS))), first)


def candidates(text: Column) -> Column:
    """Candidate tokens as structs (start, end, encoding, p): every stretch that is long enough for its encoding, with digits and letters."""
    none = F.array().cast("array<struct<start:int,end:int,encoding:int,p:double>>")
    alphabets = F.array(*(F.lit(alphabet) for _, alphabet, _ in ENCODINGS))
    tested = F.flatten(F.transform(
        F.filter(_matches(text, CANDIDATE), lambda m: _mixed(m["value"])),
        lambda m: F.transform(_stretches(m["value"]), lambda c: F.struct(
            (m["start"] + c["at"]).alias("start"), (m["start"] + c["to"]).alias("end"), c["encoding"].alias("encoding"),
            battery(F.substring(m["value"], c["at"] + 1, c["to"] - c["at"]), F.element_at(alphabets, c["encoding"] + 1)).alias("p"),
        )),
    ))
    return F.when(F.rlike(text, F.lit(CANDIDATE)), tested).otherwise(none)


def _group(c: Column) -> Column:
    """Number of a candidate's group: its encoding and its length in steps."""
    return c["encoding"] * LENGTHS + F.least(F.floor((c["end"] - c["start"]) / LENGTH_STEP).cast("int"), F.lit(LENGTHS)) - 1


def cuts_of(histogram: list[tuple[int, int, int]], false_share: float = FALSE_SHARE) -> dict[int, float]:
    """Cut per group: candidates with p at or above it are reported. ``histogram``: (group, bin of p, candidates).

    The upper half of the range holds half of the random ones. That count varies, so a cut is only raised where the others
    exceed their share with as many random ones as there may be; without any in the upper half, these are still six.
    """
    groups: dict[int, list[int]] = {}
    for group, b, n in histogram:
        groups.setdefault(group, [0] * BINS)[b] += n
    cuts = {}
    for group, bins in groups.items():
        upper = 1 + sum(bins[BINS // 2:])
        random = 2 * (upper + DOUBT * upper**0.5)
        for b in range(BINS // 2 + 1):
            reported = sum(bins[b:])
            if reported == 0 or 1 - random * (1 - b / BINS) / reported <= false_share:
                break
        cuts[group] = max(ALPHA, b / BINS)
    return cuts


def length_cuts(docs: DataFrame, text_col: str = "text", false_share: float = FALSE_SHARE) -> dict[int, float]:
    """Cuts from the candidates of all texts that may be reported. The driver sees counts per group and bin: at most 6 x 8 x 50 rows."""
    every = docs.select(F.explode(candidates(F.coalesce(F.col(text_col), F.lit("")))).alias("c"))
    counted = every.where(F.col("c.p") >= ALPHA).groupBy(
        _group(F.col("c")).alias("g"), F.least((F.col("c.p") * BINS).cast("int"), F.lit(BINS - 1)).alias("b")
    ).count().collect()
    return cuts_of([(r["g"], r["b"], r["count"]) for r in counted], false_share)


def base_spans(text: Column) -> Column:
    """Spans (start, kind, end) of the fixed patterns, by start, then kind."""
    long_value = lambda v: F.length(F.regexp_extract(v, ASSIGN, 2)) >= ASSIGN_LENGTH
    return F.sort_array(F.concat(_spans(text, 0, ASSIGN, long_value), _spans(text, 1, ACCESS), _spans(text, 2, HEX)))


def all_spans(text: Column, base: Column, cuts: dict[int, float]) -> Column:
    """``base`` and the candidates at or above the cut of their group that no base span overlaps, by start, then kind."""
    if not cuts:
        return base
    limits = F.create_map(*(F.lit(x) for pair in sorted(cuts.items()) for x in pair))
    free = lambda c: ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    added = F.filter(candidates(text), lambda c: (c["p"] >= F.element_at(limits, _group(c))) & free(c))
    return F.sort_array(F.concat(base, F.transform(
        added, lambda c: F.struct(c["start"].alias("start"), F.lit(len(KINDS) - 1).alias("kind"), c["end"].alias("end"))
    )))


def spans_of_kind(spans: Column, name: str) -> Column:
    """How many of ``spans`` are of a kind."""
    kind = KINDS.index(name)
    return F.size(F.filter(spans, lambda s: s["kind"] == kind))  # a second parameter, even with a default, would be the index


def joined(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")
    )), ",")


def with_spans(docs: DataFrame, text_col: str = "text", false_share: float = FALSE_SHARE) -> DataFrame:
    """``docs`` with ``__base`` and ``__spans``: arrays of structs (start, kind, end), in code points, end exclusive.

    The fixed patterns always count; the battery adds tokens that no fixed span overlaps. A null text is an empty one and has no spans.
    Ties of start are in order of kind. Equal texts get equal spans, repeated rows stay, an empty table gives an empty result,
    and other columns are carried along. Two passes read the texts; the one shuffle moves counts.
    """
    cuts = length_cuts(docs, text_col, false_share)
    text = F.coalesce(F.col(text_col), F.lit(""))
    based = docs.withColumn("__base", base_spans(text))
    return based.withColumn("__spans", all_spans(text, F.col("__base"), cuts))


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span, or overlapping spans together, replaced by ``mark``."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(
        spans, start,
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] < acc["at"], acc["out"])
            .otherwise(F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).alias("out"),
        ),
    )
    rest = F.substring(text, done["at"] + 1, F.length(text))
    return F.when(F.size(spans) > 0, F.concat(done["out"], rest)).otherwise(text)


def redact_secrets(docs: DataFrame, text_col: str = "text", false_share: float = FALSE_SHARE) -> DataFrame:
    """``docs`` with all found secrets replaced in ``text_col``; no row goes, a null text stays null."""
    found = with_spans(apart(docs, text_col), text_col, false_share)
    return together(found.withColumn(text_col, redacted(F.col(text_col), F.col("__spans"))), docs, text_col)
