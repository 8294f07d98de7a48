"""Prompt templates and their filling.

The wording below is this package's own; a caller may pass any other template that
uses the same placeholders.
"""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

TASK_INSTRUCTIONS = (
    "A good feature is short and checkable, for instance:\n"
    '- "names at least two colours"\n'
    '- "reports a delay in delivery"'
)

NAMING = """Two groups of texts follow. Texts of the first group switch a learned feature on, \
texts of the second group leave it off.
Say what the first group has in common that the second group lacks.
{task_specific_instructions}

== ON ==
{positive_texts}
== OFF ==
{negative_texts}
== END ==
Answer with one quoted description after a dash.
- \""""

ANNOTATION = """Decide whether a text has a property. Say Yes only if the text clearly shows it, \
otherwise No.
PROPERTY: "{hypothesis}"
TEXT: "{text}"
ANSWER:"""

SIMILARITY = """Do these two descriptions mean the same? Say yes, related or no.
text_a: {text_a}
text_b: {text_b}
answer:"""

# The wording of a few-shot prompt over table rows -------------------------
FEW_SHOT_HEADER = (
    "You are a medical assistant. Based on the patient's personal and medical admission "
    "information, predict the discharge location.\n\nHere are some examples:\n\n"
)
FEW_SHOT_EXAMPLE = "Input: {fields}\nOutput: {label}"
FEW_SHOT_TARGET = "\n\nNow, given a new patient:\nInput: {fields}\nOutput:"
# ----------------------------------------------------------------------------------------


def placeholders(template: str) -> list[str]:
    return [name for _, name, _, _ in Formatter().parse(template) if name is not None]


def fill(template: str, **values: Column) -> Column:
    """Column holding the filled template; a placeholder without a value is an error.

    Values are concatenated between the template's literal pieces, so braces inside a
    value are never taken for placeholders.
    """
    missing = sorted(set(placeholders(template)) - set(values))
    if missing:
        raise KeyError(f"template placeholders without a value: {missing}")
    pieces = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if name is not None:
            pieces.append(values[name].cast("string"))
    return F.concat(*pieces)
