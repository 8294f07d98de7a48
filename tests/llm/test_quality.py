from __future__ import annotations

import math
import re
from collections import Counter
from zlib import crc32

from corollary.llm import quality

MASK = (1 << 64) - 1
A, B, C = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9


def grams(text, buckets):
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    shift = 64 - (buckets.bit_length() - 1)
    h = [crc32(w.encode()) for w in found]
    one = [((a * A) & MASK) >> shift for a in h]
    two = [((((a * A) + (b * B) + 1) & MASK) * C & MASK) >> shift for a, b in zip(h, h[1:], strict=False)]
    return one + two


def counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if windows[x] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_against_brute_force(odd, labels):
    got = quality.with_verdict(odd, labels, buckets=1024).select("doc_id", "text", "__quality.*", "lang").toPandas()
    good = {1, 2} | {i for i in range(36) if i % 4}
    raw, trusted = Counter(), Counter()
    for row in got.itertuples():
        g = grams(row.text or "", 1024)
        raw.update(g)
        if row.doc_id in good:
            trusted.update(g)
    n, m = sum(raw.values()), sum(trusted.values())
    for row in got.itertuples():
        text = row.text or ""
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == counts(text)
        g = grams(text, 1024)
        score = sum(math.log((trusted[b] + 1) / (m + 1024)) - math.log((raw[b] + 1) / (n + 1024)) for b in g) / max(1, len(g))
        assert abs(row.score - score) < 1e-9
        failed = row.n_words < 50 or 100 * row.n_repeat_words > 50 * row.n_words
        assert row.base_failed == failed
        assert row.kept == (not failed and score >= quality.THRESHOLD)


def test_columns_and_rows_stay(odd, labels, empty):
    kept = quality.drop_low_quality(odd, labels)
    assert kept.columns == odd.columns
    assert kept.where("text is null or text = ''").count() == 0
    assert quality.with_verdict(odd, labels).count() == odd.count()
    assert quality.drop_low_quality(empty, labels).count() == 0


def test_without_labels_rules_decide(odd, labels):
    got = quality.with_verdict(odd, labels.limit(0)).select("__quality.*").toPandas()
    assert (got.score == 0).all() and (got.kept == ~got.base_failed).all()
