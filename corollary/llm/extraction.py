"""Main text of web pages by the distribution of text over lines of blocks."""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

#: Lines of a sliding window, and characters that a window must hold where the main text begins.
WINDOW = 3
SURGE = 80

#: Elements whose content is never text of a page.
RAW = "script style template noscript textarea title iframe noembed noframes xmp plaintext svg math object canvas audio video select".split()
#: Elements that break a line.
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section "
    "summary table tbody td tfoot th thead title tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements and roles that hold no main text; header and footer do where they stand outside an article.
ASIDE = set("nav aside form button menu dialog search head footer".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of a class or id that mark what is not main text.
MARKS = set(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside widget widgets cookie cookies consent gdpr notice "
    "notices notification alert popup modal overlay newsletter subscribe subscription signup promo promotion ad ads adv advert "
    "adverts advertisement advertising banner sponsor sponsored sponsor share sharing social related recommended recommendations "
    "comment comments commentlist disqus respond reply replies pagination pager toolbar skip login search footer masthead "
    "disclaimer hidden".split()
)
#: Such words that may also be part of an article.
OUTSIDE_MARKS = {"header", "topbar", "copyright", "legal", "tags", "meta"}
MAIN = {"article", "main"}
#: First and last words of class names that say how an element or its page is laid out, not what it is.
STATES = set("has no not with without is".split()), set("open closed enabled disabled on off".split())

#: Raw elements that only their end tag ends, those of other languages, which a block ends too, and the rest, which a block
#: ends where no end tag follows before the next of their kind. Blocks that may lie in them don't end them.
HARD, FOREIGN = set("script style xmp plaintext".split()), {"svg", "math"}
BREAK = rf"/?(?:{'|'.join(sorted(BLOCKS - {'title', 'option', 'optgroup'}, key=len, reverse=True))})[\s/>]"
ATTRIBUTES = r"(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>"

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?:{'|'.join(RAW)}){ATTRIBUTES}(?<=/>)"
    rf"|<(?P<hard>{'|'.join(HARD)}){ATTRIBUTES}.*?(?:</(?P=hard)\s*>|\Z)"
    rf"|<(?P<foreign>{'|'.join(FOREIGN)}){ATTRIBUTES}(?:[^<]++|<(?!/(?P=foreign)\s*>|{BREAK}))*+(?:</(?P=foreign)\s*>)?"
    rf"|<(?P<soft>{'|'.join(r for r in RAW if r not in HARD | FOREIGN)}){ATTRIBUTES}"
    rf"(?:(?:[^<]++|<(?!/?(?P=soft)[\s/>]))*+</(?P=soft)\s*>|(?:[^<]++|<(?!(?P=soft)[\s/>]|{BREAK}))*+)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<rest2>[^<>]*)(?:>|\Z)",  # quotes that don't match
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


#: How sure an element's mark is: a word of a longer class name tells less than a whole one.
UNMARKED, WEAK, SURE = 0, 1, 2


def _words_mark(value: str, inside: bool) -> int:
    """Mark of a class or id by its names and their words."""
    mark = UNMARKED
    for name in value.split():
        parts = [p.lower() for p in PART.findall(name)]
        if not parts or (len(parts) > 1 and (parts[0] in STATES[0] or parts[-1] in STATES[1])):
            continue
        if any(p in MARKS or (not inside and p in OUTSIDE_MARKS) for p in parts):
            if len(parts) == 1:
                return SURE
            mark = WEAK
    return mark


def _marked(name: str, attributes: str, inside: bool) -> int:
    """Whether an element is known, or by its class or id thought, not to hold main text; ``inside``: of an article."""
    if name in ASIDE or (name == "header" and not inside):
        return SURE
    if not attributes or attributes == "/" or name in ("html", "body", "article", "main"):
        return UNMARKED
    mark = UNMARKED
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key in ("class", "id"):
            mark = max(mark, _words_mark(value, inside))
        elif key == "role" and value.lower() in ROLES:
            return SURE
        elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return SURE
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
            return SURE
    return mark


def lines_of(html: str) -> list[tuple[str, int, bool]]:
    """Markup stripped: (text of a block, characters of it outside links, whether inside an article or main element).

    An element with a weak mark is left out unless it holds more than half of the plain text of the page. Where that leaves
    no text, marks of class names don't count.
    """
    lines, weak, total = _parsed(html, {})
    if weak:
        lines, _, _ = _parsed(html, {start: end for start, end, plain in weak if 2 * plain <= total})
    return lines or _parsed(html, {}, sure=False)[0]


def _parsed(html: str, left_out: dict[int, int], sure: bool = True) -> tuple[list[tuple[str, int, bool]], list[tuple[int, int, int]], int]:
    """Lines without the given stretches of the page, weakly marked elements as (start, end, plain characters), and all plain ones.

    ``sure``: whether whole class names are marks.
    """
    lines: list[tuple[str, int, bool]] = []
    words: list[str] = []
    plain = 0
    linked = inside = 0
    skipped: list[str] = []  # open elements since one that is left out, that one first
    at = until = total = 0
    weak: list[tuple[int, int, int]] = []
    opened: list[tuple[str, int, int]] = []  # name, start if weakly marked or else -1, plain characters before
    names: Counter[str] = Counter()

    def end_line() -> None:
        nonlocal plain
        text = " ".join("".join(words).split())
        if text:
            lines.append((text, min(plain, len(text)), inside > 0))
        words.clear()
        plain = 0

    def add(raw: str) -> None:
        nonlocal plain, total
        if not skipped and raw:
            text = unescape(raw) if "&" in raw else raw
            words.append(text)
            if not linked:
                n = len(" ".join(text.split()))
                plain += n
                total += n

    def close(k: int, end: int) -> None:
        """Ends the open elements from the ``k``-th on."""
        for name, start, before in opened[k:]:
            names[name] -= 1
            if start >= 0:
                weak.append((start, end, total - before))
        del opened[k:]

    for token in TOKEN.finditer(html):
        if token.start() < until:  # inside what is left out
            continue
        add(html[max(at, until):token.start()])
        at = token.end()
        closing, name, attributes = token.group("end", "name", "rest") if token.group("name") else token.group("end2", "name2", "rest2")
        if name is None:  # a comment, a declaration, or an element of raw text
            continue
        name = name.lower()
        if name == "br":
            if not skipped:
                words.append(" ")
            continue
        if name in VOID:
            if name == "hr" and not skipped:
                end_line()
            continue
        if skipped:
            if closing:
                if name in skipped:
                    while skipped.pop() != name:
                        pass
                elif name in ("body", "html") or (name in MAIN and inside):
                    skipped.clear()
            elif name in MAIN and not inside:  # what was left open before the article ends with it
                skipped.clear()
            elif not attributes.endswith("/"):
                skipped.append(name)
            if skipped or (closing and name not in MAIN):
                continue
        if name in BLOCKS:
            end_line()
            linked = 0
        if closing:
            if names[name]:
                k = next(k for k in range(len(opened) - 1, -1, -1) if opened[k][0] == name)
                if (name in BLOCKS and name != "p") or not any(o[0] in BLOCKS for o in opened[k + 1:]):
                    close(k, token.start())
            if name == "a":
                linked = max(0, linked - 1)
            elif name in MAIN:
                inside = max(0, inside - 1)
            continue
        if attributes.endswith("/"):
            continue
        mark = _marked(name, attributes, inside > 0)
        if mark == SURE and not sure:
            mark = _marked(name, re.sub(r"(?i)\b(?:class|id)\s*=", "data-name=", attributes), inside > 0)
        if mark == SURE:
            end_line()
            skipped.append(name)
            continue
        if mark == WEAK and token.start() in left_out:
            end_line()
            until = left_out[token.start()]
            continue
        if name in MAIN and not inside:  # what was left open before the article ends with it
            for k, (other, start, before) in enumerate(opened):
                if start >= 0:
                    weak.append((start, token.start(), total - before))
                    opened[k] = (other, -1, 0)
        opened.append((name, token.start() if mark == WEAK else -1, total))
        names[name] += 1
        if name == "a":
            linked = 1
        elif name in MAIN:
            inside += 1
    add(html[max(at, until):])
    end_line()
    close(0, len(html))
    return lines, weak, total


def stretches(weights: list[int], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """Stretches (first line, last line + 1) from a surge point to the next dive point.

    A line with text is a surge point if the window that begins there holds ``surge`` characters or more, or as many as
    any window does; the next line at which a window of only empty lines begins is the dive point.
    """
    n = len(weights)
    sums = [sum(weights[i:i + window]) for i in range(n)]
    if not n or not max(sums):
        return []
    needed = min(surge, max(sums))
    found, i = [], 0
    while i < n:
        if weights[i] and sums[i] >= needed:
            end = i
            while end < n and sums[end]:
                end += 1
            found.append((i, end))
            i = end
        i += 1
    return found


def main_text(html: str, window: int = WINDOW, surge: int = SURGE) -> str:
    """The lines between surge and dive points, one per block."""
    lines = lines_of(html)
    if any(inside for _, _, inside in lines):
        # The page itself says where its article is: only its lines count, and any of them is a surge.
        weights = [len(text) if inside else 0 for text, _, inside in lines]
        chosen = stretches(weights, window, 1)
        return "\n".join(lines[i][0] for a, b in chosen for i in range(a, b) if lines[i][2])
    # A line that is mostly links has no weight.
    weights = [plain if 2 * plain >= len(text) else 0 for text, plain, _ in lines]
    return "\n".join(lines[i][0] for a, b in stretches(weights, window, surge) for i in range(a, b) if weights[i])


def extracted(html: Column | str, window: int = WINDOW, surge: int = SURGE) -> Column:
    """Main text of a column of whole pages; empty for null, empty and text-free pages."""

    @arrow_udf("string")
    def of(column: pa.Array) -> pa.Array:
        return pa.array([main_text(h.as_py() or "", window, surge) for h in column], pa.string())

    return of(F.coalesce(F.col(html) if isinstance(html, str) else html, F.lit("")))


def extract_main_text(
    pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url"), window: int = WINDOW, surge: int = SURGE,
) -> DataFrame:
    """Return the columns ``keep``, ``text`` and ``n_chars``, its code points, one row per page.

    Markup, scripts, comments, and elements known to hold menus, headers, footers, notices, adverts, forms or reader
    comments are stripped, which leaves lines, one per block. A class or id marks an element by a whole name, or by a word of a longer
    one where the element holds at most half of the page's plain text. The characters of ``window`` lines from each on are
    summed (text of links doesn't count; where a page has an article or main element, lines outside it don't either). Text between surge
    and dive points is kept; nothing is cut from it. A null page is an empty one, an empty page has an empty text.
    Equal pages get equal texts, repeated rows stay, an empty table gives an empty result, other columns are not read.
    No shuffle; a page is the unit of work, whatever its length.
    """
    found = pages.select(*keep, extracted(html, window, surge).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
