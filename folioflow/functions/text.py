"""Scalar text functions as column expressions: whitespace, artifacts, links, escaping, markers, scores.

All of them stay in the JVM but `drop_repeated_words` and `similarity`, which need Python. Patterns use
``(?Umd)`` where line anchors or classes are to mean Unicode classes and \\n alone.
"""

from __future__ import annotations

import difflib
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

ARTIFACTS = (
    r"(?Umd)^Page\s+\d+\s*$",
    r"(?Umd)^\s*-\s*\d+\s*-\s*$",
    r"(?Umd)^\s*[\[(]\d+[\])]\s*$",
    r"(?Umd)^\s*\d{1,3}\s*$",
    r"(?Umd)^[\s\-]{5,}$",
    r"(?Umd)^[\s=]{5,}$",
)
URL = r"(https?://[^\s<>\[\]]*[^\s<>\[\].,!?;:])"
EMAIL = r"([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})"
HTML_URL = r"(https?://[^\s<>()]+)"
OPERATORS = "=-+<>*/&|^"


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize_newlines(text: str | Column) -> Column:
    """Three and more newlines become three."""
    return F.regexp_replace(_c(text), "\n{3,}", "\n\n\n")


def remove_page_artifacts(text: str | Column) -> Column:
    """Page numbers and separator lines go, in the order of `ARTIFACTS`."""
    out = _c(text)
    for pattern in ARTIFACTS:
        out = F.regexp_replace(out, pattern, "")
    return out


def cleanup_markdown(text: str | Column) -> Column:
    return normalize_newlines(remove_page_artifacts(text))


def merge_bold(text: str | Column) -> Column:
    return F.replace(_c(text), F.lit("** **"), F.lit(" "))


def normalize_spaces(text: str | Column) -> Column:
    """Runs of blanks inside a line become one; indentation becomes as many blanks as it has bytes.

    Empty lines at the head vanish, as does the newline at the end.
    """
    indented = lambda line: F.concat(
        F.repeat(F.lit(" "), F.octet_length(line) - F.octet_length(F.regexp_replace(line, r"(?U)^\s+", ""))),
        F.regexp_replace(F.regexp_replace(line, r"(?U)^\s+", ""), " {2,}", " "),
    )
    lines = F.split(F.regexp_replace(F.regexp_replace(_c(text), "\r\n", "\n"), "\n$", ""), "\n")
    return F.regexp_replace(F.array_join(F.transform(lines, indented), "\n"), "^\n+", "")


def cleanup_plain(text: str | Column) -> Column:
    return normalize_newlines(normalize_spaces(text))


def markdown_links(text: str | Column, *, guard: bool = False) -> Column:
    """URLs and e-mail addresses as links. With `guard`, those that the text already shows in brackets stay."""
    text = _c(text)
    if not guard:
        return F.regexp_replace(F.regexp_replace(text, URL, "[$1]($1)"), EMAIL, "[$1](mailto:$1)")
    # one target after another; the number of distinct addresses bounds the fold
    fold = lambda start, found, linked: F.aggregate(found, start, linked)
    urls = F.array_distinct(F.regexp_extract_all(text, F.lit(URL)))
    urls = F.filter(urls, lambda u: ~F.contains(text, F.concat(F.lit("["), u, F.lit("]"))))
    with_urls = fold(text, urls, lambda acc, u: F.regexp_replace(acc, F.concat(F.lit(r"(?<!\(|\[)\Q"), u, F.lit(r"\E(?![^\s<>\[\]]*[^\s<>\[\].,!?;:])")), F.concat(F.lit("["), _quote(u), F.lit("]("), _quote(u), F.lit(")"))))
    mails = F.array_distinct(F.regexp_extract_all(with_urls, F.lit(EMAIL)))
    mails = F.filter(mails, lambda m: ~F.contains(with_urls, F.concat(F.lit("["), m, F.lit("]"))) & ~F.contains(with_urls, F.concat(F.lit("//"), m)))
    return fold(with_urls, mails, lambda acc, m: F.regexp_replace(acc, F.concat(F.lit(r"(?<![a-zA-Z0-9._%+-])\Q"), m, F.lit(r"\E(?![a-zA-Z0-9.-]*[a-zA-Z])")), F.concat(F.lit("["), _quote(m), F.lit("](mailto:"), _quote(m), F.lit(")"))))


def _quote(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))


def dash_spacing(text: str | Column) -> Column:
    """Blanks beside an en or em dash between digits go."""
    before = F.regexp_replace(_c(text), r"(?U)(\d)\s+(–|—)(\d)", "$1$2$3")
    return F.regexp_replace(before, r"(?U)(\d)(–|—)\s+(\d)", "$1$2$3")


def escape_html(text: str | Column) -> Column:
    out = _c(text)
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(plain), F.lit(entity))
    return out


def linkify_html(text: str | Column) -> Column:
    urls = F.regexp_replace(escape_html(text), HTML_URL, '<a href="$1">$1</a>')
    return F.regexp_replace(urls, EMAIL, '<a href="mailto:$1">$1</a>')


def list_marker(text: str | Column) -> Column:
    """struct<ordered boolean, length int>: the list marker a line begins with, its length in bytes; else null."""
    text = _c(text)
    bullet = F.regexp_extract(text, "^([•\\-*◦▪►])", 1)
    paren = F.regexp_extract(text, r"^(\([0-9A-Za-z]*\))", 1)
    number = F.regexp_extract(text, r"^([0-9a-z]{1,4}[.)])", 1)
    made = lambda ordered, m: F.struct(F.lit(ordered).alias("ordered"), F.octet_length(m).alias("length"))
    return F.when(bullet != "", made(False, bullet)).when(paren != "", made(True, paren)).when(number != "", made(True, number))


def uppercase_ratio(text: str | Column) -> Column:
    """Upper case letters per letter; 0 for a text without letters."""
    text = _c(text)
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    return F.when(letters > 0, F.regexp_count(text, F.lit(r"\p{Lu}")) / letters).otherwise(F.lit(0.0))


def mostly_uppercase(text: str | Column) -> Column:
    return uppercase_ratio(text) > 0.7


def bold_marker_allowed(before: Column, after: Column) -> Column:
    """Whether ** may stand between two characters (null: the edge of the text)."""
    word = r"(?U)^[\p{L}\p{N}]$"
    both = before.rlike(word) & after.rlike(word)
    closing = before.isin(")", "]", "}") & after.isin(*OPERATORS)
    return ~F.coalesce(both | closing, F.lit(False))


def needs_space(left: Column, right: Column) -> Column:
    """Lower case before upper case (unless a capital stands before it), digit beside letter."""
    camel = left.rlike(r"\p{Ll}$") & right.rlike(r"^\p{Lu}") & ~left.rlike(r"\p{Lu}.$")
    mixed = (left.rlike(r"\p{N}$") & right.rlike(r"^\p{L}")) | (left.rlike(r"\p{L}$") & right.rlike(r"^\p{N}"))
    return F.coalesce(camel | mixed, F.lit(False))


def escape_cell(text: str | Column) -> Column:
    return F.replace(F.replace(_c(text), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


STRUCTURE = {
    "headings": r"(?md)^#+[ \t]",
    "lists": r"(?md)^[ \t]*[-*+][ \t]",
    "bold": r"\*\*[^*]+\*\*",
    "italic": r"\*[^*]+\*",
    "links": r"\[[^\]]+\]\([^)]+\)",
    "fences": r"```",
    "table_rows": r"(?md)^\|",
}


def markdown_structure(text: str | Column) -> dict[str, Column]:
    """Counts of headings, lists, bold, italic, links, code blocks, table rows and paragraphs."""
    text = _c(text)
    counts = {name: F.regexp_count(text, F.lit(pattern)) for name, pattern in STRUCTURE.items()}
    counts["code_blocks"] = F.floor(counts.pop("fences") / 2).cast("int")
    counts["paragraphs"] = F.size(F.filter(F.split(text, "\n\n"), lambda p: F.trim(F.translate(p, "\n\t\r", "   ")) != ""))
    return counts


def feature_counts(text: str | Column) -> dict[str, Column]:
    text = _c(text)
    count = lambda s: F.regexp_count(text, F.lit(s))
    return {
        "br_tags": count("<br>"),
        "bold_marks": count(r"\*\*"),
        "rules": count("---"),
        "table_rows": count(r"\n\|"),
        "has_form_fields": F.contains(text, F.lit("Form Fields")),
        "garbled": count("[a-z]{3}[A-Z][a-z]{4}[a-z]{2}[A-Z]"),
    }


CORRUPTED = ("fnanci", "coefci", "infuenc", "efcien", "ofcia", "sufcien", "difc")
INTACT = ("financi", "coeffici", "influenc", "effici", "offici")
SYMBOLS = {"rho": "ρ", "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "epsilon": "ε", "theta": "θ", "lambda": "λ", "mu": "μ", "sigma": "σ", "pi": "π"}


def ligature_report(text: str | Column) -> dict[str, Column]:
    """How often words with lost ligatures, with intact ones and mathematical symbols occur."""
    text = F.lower(_c(text))
    total = lambda patterns: sum((F.regexp_count(text, F.lit(p)) for p in patterns), F.lit(0)).cast("int")
    return {"corrupted": total(rf"\b{p}" for p in CORRUPTED), "intact": total(rf"\b{p}" for p in INTACT), "symbols": total(SYMBOLS.values())}


def split_letters(text: str | Column) -> Column:
    """Words set as single letters ("F i s c a l"): runs of at least four."""
    return F.regexp_count(_c(text), F.lit(r"(?<![A-Za-z])[A-Za-z](?: [A-Za-z]){3,}(?![A-Za-z])"))


def content_score(text: str | Column) -> Column:
    """25 each: a thousand characters, no replacement character, a URL, an e-mail address."""
    text = _c(text)
    points = [F.length(text) >= 1000, ~F.contains(text, F.lit("�")), text.rlike(r"https?://"), text.rlike(EMAIL)]
    return sum((F.when(p, 25).otherwise(0) for p in points), F.lit(0)).cast("int")


def regression_flags(text: str | Column) -> dict[str, Column]:
    """Rules for damaged output, each a boolean."""
    text = _c(text)
    count = lambda p: F.regexp_count(text, F.lit(p))
    n, lines = F.length(text), F.size(F.split(text, "\n"))
    return {
        "too_short": n < 100,
        "replacement_chars": F.contains(text, F.lit("�")),
        "control_chars": count(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]") > 0,
        "blank_runs": count(" {3,}") >= 10,
        "many_blanks": count(" ") > 0.3 * n,
        "many_newlines": count("\n") > 0.15 * n,
        "trailing_blanks": count(r"(?md) $") >= 0.1 * lines,
        "newline_runs": count("\n{3,}") >= 20,
        "mojibake": count("Ã[\u0080-¿]|â€") > 0,
    }


def strip_controls(text: str | Column) -> Column:
    """Control characters go, but tab, newline and carriage return."""
    return F.regexp_replace(_c(text), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]", "")


LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}


def expand_ligatures(text: str | Column) -> Column:
    out = _c(text)
    for one, many in LIGATURES.items():
        out = F.replace(out, F.lit(one), F.lit(many))
    return out


_WORD = re.compile(r"\w{4,}|\w+|\W+")


def _without_repeats(text: str) -> str:
    last, out = None, []
    for m in _WORD.finditer(text):
        piece = m.group()
        if len(piece) >= 4 and (piece[0].isalnum() or piece[0] == "_"):
            if last is not None and piece.lower() == last:
                continue
            last = piece.lower()
        out.append(piece)
    return "".join(out)


@F.arrow_udf(StringType())
def drop_repeated_words(text: pa.Array) -> pa.Array:
    """A word of four letters or more that equals the last kept one, whatever its case, goes."""
    return pa.array([None if t is None else _without_repeats(t) for t in text.to_pylist()], pa.string())


@F.arrow_udf(DoubleType())
def similarity(a: pa.Array, b: pa.Array) -> pa.Array:
    """Ratcliff and Obershelp's ratio of two texts (the first 10,000 characters of each, as defined)."""
    pairs = zip(a.to_pylist(), b.to_pylist())
    return pa.array([None if x is None or y is None else difflib.SequenceMatcher(None, x[:10000], y[:10000]).ratio() for x, y in pairs], pa.float64())


HEADER = {"category": "Category", "pages": "Pages", "time": "Processing Time", "chars": "Characters"}


def header_fields(text: str | Column) -> dict[str, Column]:
    """Values of the `**Name**: value` lines among the first ten; null where there is none."""
    head = F.array_join(F.slice(F.split(_c(text), "\n"), 1, 10), "\n")
    found = {name: F.regexp_extract_all(head, F.lit(rf"(?m)^\*\*{label}\*\*:[ \t]*(.*?)[ \t]*$"), F.lit(1)) for name, label in HEADER.items()}
    values = {name: F.get(v, F.size(v) - 1) for name, v in found.items()}  # the last one counts
    return values | {"chars": F.replace(values["chars"], F.lit(","), F.lit(""))}


def header_body(text: str | Column) -> Column:
    """What follows the first rule, trimmed; the whole text where there is no rule."""
    text = _c(text)
    at = F.locate("---\n\n", text)
    return F.when(at > 0, F.regexp_replace(F.substr(text, at + 5), r"^\s+|\s+$", "")).otherwise(text)
