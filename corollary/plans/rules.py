"""Rule-based stand-ins for the user's models, with answers SQL can compute as well.

They keep the registered queries and the tests free of any network or model file.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

#: Dimensions of the hashed bag-of-words vectors.
EMBED_DIMS = 8
CONTAINS = "contains: "


def embed_words(texts: list[str]) -> list[list[float]]:
    """Unit-length counts of a text's words, hashed to ``EMBED_DIMS`` places by md5."""
    out = []
    for text in texts:
        places = Counter()
        for word, count in Counter(text.split()).items():
            places[int(hashlib.md5(word.encode()).hexdigest()[0], 16) % EMBED_DIMS] += count
        norm = math.sqrt(sum(c * c for c in places.values())) or 1.0
        out.append([places[i] / norm for i in range(EMBED_DIMS)])
    return out


def answer_contains(prompts: list[str]) -> list[str]:
    """Yes where the TEXT of an annotation prompt holds the word its PROPERTY names."""
    out = []
    for prompt in prompts:
        _, _, rest = prompt.partition('PROPERTY: "')
        concept, _, rest = rest.partition('"\nTEXT: "')
        text, _, _ = rest.rpartition('"\nANSWER:')
        word = concept.removeprefix(CONTAINS).lower()
        out.append("Yes." if word in text.lower() else "No.")
    return out


def name_by_word(prompts: list[str]) -> list[str]:
    """The word that occurs most often on the ON side beyond its count on the OFF side."""
    out = []
    for prompt in prompts:
        _, _, rest = prompt.partition("\n== ON ==\n")
        on, _, rest = rest.partition("\n== OFF ==\n")
        off, _, _ = rest.rpartition("\n== END ==")
        lead = Counter(re.findall("[a-z]{3,}", on.lower()))
        lead.subtract(Counter(re.findall("[a-z]{3,}", off.lower())))
        word = min(lead, key=lambda w: (-lead[w], w)) if lead else ""
        out.append(f'- "{CONTAINS}{word}"')
    return out


def grade_overlap(prompts: list[str]) -> list[str]:
    """yes / related / no by the share of common words of two descriptions."""
    out = []
    for prompt in prompts:
        _, _, rest = prompt.partition("\ntext_a: ")
        a, _, rest = rest.partition("\ntext_b: ")
        b, _, _ = rest.rpartition("\nanswer:")
        left, right = set(a.split()), set(b.split())
        share = len(left & right) / max(len(left | right), 1)
        out.append("yes" if share >= 0.5 else "related" if share > 0 else "no")
    return out
