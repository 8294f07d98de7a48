"""Row-level text functions. Every one is a Column expression; none needs a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values -------------------------------------------------------------------------
#: The characters Python's ``str.split()`` / ``str.strip()`` treat as blanks.
BLANK = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
#: A run of them for Java's matcher, where the short form is several times faster.
BLANK_RUN = r"(?U)[\s\x1c-\x1f]+"
#: The same characters spelled out.
BLANK_CHARS = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
TRUNCATION_MESSAGE = "[... rest of text is truncated]"
KEY_SEPARATOR = "|||"
PRINT_CHARS = 128
#: Model-name fragment -> text put before the input of that embedding model.
MODEL_PREFIXES = {
    "nomic-ai": "search_document: ",
}
#: Models that take a pair of instruction and text, by a fragment of their name (fixed values).
MODEL_INSTRUCTIONS = {"instructor": "Represent the text for classification: "}
# --------------------------------------------------------------------------------------


def strip(text: Column) -> Column:
    """Remove leading and trailing blanks, Unicode blanks included."""
    return F.btrim(text, F.lit(BLANK_CHARS))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, also inside CASE branches."""
    return F.transform(F.array(value), use)[0]


def is_valid(text: Column) -> Column:
    """True where a text is neither NULL nor blank."""
    return text.isNotNull() & text.rlike(r"(?U)[^\s\x1c-\x1f]")


def drop_invalid(df: DataFrame, text: str = "text") -> DataFrame:
    return df.filter(is_valid(F.col(text)))


def _token_truncator(encode: Callable, decode: Callable, max_tokens: int):
    @F.pandas_udf(T.StringType())
    def cut(texts: pd.Series) -> pd.Series:
        def one(text):
            if text is None:
                return None
            tokens = encode(text)
            return decode(tokens[:max_tokens]) if len(tokens) > max_tokens else text

        return texts.map(one)

    return cut


def truncate(
    text: Column,
    max_words: int | None = None,
    max_chars: int | None = None,
    max_tokens: int | None = None,
    *,
    tokenizer: tuple[Callable, Callable] | None = None,
    message: str = TRUNCATION_MESSAGE,
) -> Column:
    """Cut a text by words, then characters, then tokens, marking it when it changed.

    ``tokenizer`` is a pair ``(encode, decode)`` and is required with ``max_tokens``.
    """
    if max_words is None and max_chars is None and max_tokens is None:
        return text
    cut = text
    if max_words is not None:
        cut = _once(
            F.split(strip(text), BLANK_RUN, max_words + 1),
            lambda words: F.when(
                (F.size(words) > max_words) & (words[0] != ""), F.array_join(F.slice(words, 1, max_words), " ")
            ).otherwise(text),
        )
    if max_chars is not None:
        cut = F.substring(cut, 1, max_chars)
    if max_tokens is not None:
        if tokenizer is None:
            raise ValueError("max_tokens needs tokenizer=(encode, decode)")
        cut = _token_truncator(*tokenizer, max_tokens)(cut)
    marked = _once(cut, lambda c: F.when(c != text, F.concat(c, F.lit(message))).otherwise(text))
    return F.when(F.endswith(text, F.lit(message)), text).otherwise(marked)


def for_printing(text: Column, max_chars: int = PRINT_CHARS) -> Column:
    return F.translate(truncate(text, max_chars=max_chars), "\n", " ")


def identity_key(concept: Column, text: Column) -> Column:
    """Readable key of an annotation. Two texts with equal ends collide; stores use text_key."""
    return F.concat(
        concept,
        F.lit(KEY_SEPARATOR),
        F.substring(text, 1, 100),
        F.lit("..."),
        F.right(text, F.lit(100)),
    )


def text_key(text: Column) -> Column:
    """Collision-free key of a whole text."""
    return F.sha2(text, 256)


def field_label(name: str) -> str:
    return name.replace("_", " ").capitalize()


def row_to_text(df: DataFrame, columns: list[str]) -> Column:
    """``Field name: value`` for each known field of a row, in column order."""
    types = {f.name: f.dataType for f in df.schema.fields}
    parts = []
    for name in columns:
        value = F.col(name)
        shown = value.cast("string")
        known = value.isNotNull() & (F.lower(shown) != "unknown")
        if isinstance(types[name], (T.FloatType, T.DoubleType)):
            known = known & ~F.isnan(value)
        parts.append(F.when(known, F.concat(F.lit(field_label(name) + ": "), shown)))
    return F.concat_ws(", ", *parts)


def clean_name(response: Column) -> Column:
    """Turn a model's raw naming answer into a bare name."""
    name = strip(response)
    for prefix in ("- ", '"-', '" -'):
        rest = F.substr(name, F.lit(len(prefix) + 1))
        name = F.when(F.startswith(name, F.lit(prefix)), rest).otherwise(name)
    return F.btrim(name, F.lit('"'))


def parse_yes_no(response: Column) -> Column:
    """1 if the answer mentions yes, else 0 if it mentions no, else NULL."""
    answer = F.lower(response)
    return F.when(F.contains(answer, F.lit("yes")), F.lit(1)).when(
        F.contains(answer, F.lit("no")), F.lit(0)
    )


def parse_graded(response: Column) -> Column:
    """1 / 0.5 / 0 for an answer starting with yes / related / no, else NULL."""
    answer = F.lower(strip(response))
    return (
        F.when(F.startswith(answer, F.lit("yes")), F.lit(1.0))
        .when(F.startswith(answer, F.lit("related")), F.lit(0.5))
        .when(F.startswith(answer, F.lit("no")), F.lit(0.0))
    )


def model_input(text: Column, model: str) -> Column:
    """The text as the embedding model wants it: as it is, after a prefix, or as an array of instruction and text.

    The raw text stays the key.
    """
    for fragment, instruction in MODEL_INSTRUCTIONS.items():
        if fragment in model:
            return F.array(F.lit(instruction), text)
    for fragment, prefix in MODEL_PREFIXES.items():
        if fragment in model:
            return F.concat(F.lit(prefix), text)
    return text


def map_labels(label: Column, mapping: Mapping[str, int]) -> Column:
    """Numeric code of a label; an unmapped label fails the job."""
    code = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])[label]
    problem = F.concat(F.lit("label not in mapping: "), F.coalesce(label, F.lit("NULL")))
    return F.coalesce(code, F.raise_error(problem).cast("int"))
