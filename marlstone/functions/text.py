"""Text, identifier and bibliographic expressions. Lengths are in code points; null in gives null out unless said."""

from __future__ import annotations

import re
from html import unescape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

BLANKS = " \t\r\n\f\v"


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def sentences(text: Column, openers: str = r'[A-Z0-9("]') -> Column:
    """Paragraphs at blank lines, then cuts at white space after .!?;: and before an opener; trimmed, no empty ones."""
    paragraphs = F.filter(F.transform(F.split(text, "\n{2,}"), trimmed), lambda p: p != "")
    return F.filter(F.flatten(F.transform(paragraphs, lambda p: F.transform(F.split(p, r"(?<=[.!?;:])\s+(?=" + openers + ")"), trimmed))), lambda s: s != "")


def simple_hash(text: Column) -> Column:
    """h = 33 h + code unit (UTF-16) from 5381, in 32 bits, as an unsigned decimal string."""
    mask = F.lit(4294967295).cast("bigint")
    units = F.hex(F.encode(text, "UTF-16BE"))
    codes = F.transform(F.sequence(F.lit(1), F.greatest(F.length(units) - 3, F.lit(1)), F.lit(4)), lambda i: F.conv(F.substring(units, i, F.lit(4)), 16, 10).cast("bigint"))
    hashed = F.aggregate(codes, F.lit(5381).cast("bigint"), lambda h, c: (h * 33 + c).bitwiseAND(mask))
    return F.when(F.length(units) == 0, "5381").otherwise(hashed.cast("string"))


def md5_10(text: Column) -> Column:
    return F.substring(F.md5(text), 1, 10)


def slugify(text: Column) -> Column:
    """Other than ASCII letters and digits become one hyphen; over 60 characters: the first 51 and 8 digits of the hash."""
    slug = F.btrim(F.regexp_replace(text, "[^A-Za-z0-9]+", "-"), F.lit("-"))
    return F.when(slug == "", "paper").when(F.length(slug) > 60, F.concat(F.substring(slug, 1, 51), F.lit("-"), F.substring(simple_hash(text), 1, 8))).otherwise(slug)


def to_doi(ident: Column) -> Column:
    """A bare DOI, or that of `arXiv:id`, after the prefix `DOI:` and then a doi.org address are taken off; else null."""
    t = trimmed(ident)
    for prefix in (r"(?i)^doi:\s*", r"(?i)^https?://doi\.org/"):
        t = F.regexp_replace(t, prefix, "")
    arxiv = F.regexp_extract(t, r"(?i)^arxiv:\s*(\d{4}\.\d{4,5}(?:v\d+)?)$", 1)
    return F.when(t.rlike(r"^10\.\d{4,9}/\S+$"), t).when(arxiv != "", F.concat(F.lit("10.48550/arXiv."), arxiv))


def source_kind(source: Column) -> Column:
    """How a source is resolved: `url`, `arxiv`, `doi` or `file`."""
    s = trimmed(source)
    return F.when(s.rlike(r"(?i)^https?://"), "url").when(s.rlike(r"(?i)^\d{4}\.\d{4,5}(?:v\d+)?$"), "arxiv").when(to_doi(s).isNotNull(), "doi").otherwise("file")


def source_slug(source: Column) -> Column:
    """The slug a source gives: of the last part of an address or path without .pdf, or of the identifier itself."""
    s = trimmed(source)
    kind = source_kind(s)
    # after a closing slash an address has an empty last part
    last = F.regexp_replace(F.regexp_extract(s, r"([^/]*)$", 1), r"(?i)\.pdf$", "")
    return F.when(kind == "url", slugify(F.when(F.regexp_extract(s, r"([^/]*)$", 1) == "", "document").otherwise(last))).when(kind == "file", slugify(base_name(s))).otherwise(slugify(s))


def base_name(source: Column) -> Column:
    """The last path component without .pdf."""
    return F.regexp_replace(F.regexp_extract(source, r"([^/\\]*)[/\\]*$", 1), r"(?i)\.pdf$", "")


def safe_stem(name: Column) -> Column:
    """Other characters than letters, digits, . _ - become _; without extension."""
    return F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9._-]", "_"), r"\.[^.]*$", "")


# white space beyond ASCII counts where texts of web services are cleaned
_SPACES = "[\\t\\n\\u000b\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]+"


def strip_xml(text: Column) -> Column:
    """Tags become blanks; five entities are resolved, `&amp;` before the quotes; white space becomes one blank; trimmed."""
    out = F.regexp_replace(text, "<[^>]+>", " ")
    for entities, sign in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&#39;|&apos;", "'")):
        out = F.regexp_replace(out, entities, sign)
    return F.btrim(F.regexp_replace(out, _SPACES, " "), F.lit(" "))


_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)([^<>]*)>|<[^<>]+>")
#: what opening and closing tags of a leaf turn into
_OPENS = {"b": "**", "i": "*", "br": "\n"}
_CLOSES = {"b": "**", "i": "*", "tr": "\n", "td": " | ", "th": " | "}


def leaf_text(html: str | None) -> str:
    """One leaf of a block tree as markdown, in one pass over its tags; null gives an empty text."""
    out: list[str] = []
    formula: tuple[int, str] | None = None
    open_marks: dict[str, list[int]] = {"b": [], "i": []}
    at = 0
    for m in _TAG.finditer(html or ""):
        out.append(unescape(html[at : m.start()]))
        at = m.end()
        closing, name, rest = m[1] == "/", (m[2] or "").lower(), m[3] or ""
        if name == "math":
            if not closing and formula is None and (not rest.strip() or 'display="block"' in rest):
                formula = (len(out), "$$" if 'display="block"' in rest else "$")
            elif closing and formula is not None:
                start, sign = formula
                body = "".join(out[start:]).strip()
                out[start:] = [f"\n$$\n{body}\n$$\n" if sign == "$$" else f"${body}$"]
                formula = None
        elif name in open_marks:
            # a mark is set only where both its tags are there
            if not closing and not rest.strip():
                open_marks[name].append(len(out))
                out.append("")
            elif closing and open_marks[name]:
                out[open_marks[name].pop()] = _OPENS[name]
                out.append(_CLOSES[name])
        elif name in (_CLOSES if closing else _OPENS):
            out.append((_CLOSES if closing else _OPENS)[name])
    out.append(unescape((html or "")[at:]))
    return "".join(out).strip()


@F.pandas_udf(StringType())
def _leaves(html: pd.Series) -> pd.Series:
    return html.map(leaf_text)


def leaf_markdown(html: Column) -> Column:
    """A leaf of a block tree: math, table cells, bold, italics and line breaks; other tags go, all entities are resolved.

    Entities need the full table of names, so this is an Arrow-batched function.
    """
    return _leaves(html)


# fixed values: the forms of a page marker
PAGE_MARKER = r"(?i)<!--\s*page\s*\d+\s*-->|-{5,}\s*page\s*\d+\s*-{5,}|={5,}\s*page\s*\d+\s*={5,}|#{2,}\s*page\s*\d+\s*|\f"
# noncharacters: no text holds them
_CUT, _END = "\ufdd0", "\ufdd1"


def page_pieces(markdown: Column) -> Column:
    """Texts between page markers, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.regexp_replace(markdown, PAGE_MARKER, _CUT), _CUT), trimmed), lambda p: p != "")


def marked_pages(markdown: Column) -> Column:
    """array<struct<page, text>>: each marker's number with the text after it. Text before the first marker is left out;
    without any text after a marker, the whole text is on page 1. Markers are `<!-- page N -->` in small letters."""
    numbered = F.regexp_replace(markdown, r"<!--\s*page\s*(\d+)\s*-->", _CUT + "$1" + _END)
    parts = F.transform(F.slice(F.split(numbered, _CUT), 2, 1 << 30), lambda p: F.struct(
        F.coalesce(F.regexp_extract(p, "^(\\d{1,9})" + _END, 1).try_cast("int"), F.lit(1)).alias("page"),
        trimmed(F.regexp_replace(p, "^\\d+" + _END, "")).alias("text"),
    ))
    kept = F.filter(parts, lambda p: p["text"] != "")
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.struct(F.lit(1).alias("page"), trimmed(markdown).alias("text"))))


def guessed_pages(markdown: Column) -> Column:
    """The greatest page number in the page markers of any form; 1 if there is none or it is 0. Other numbers don't count."""
    digits = F.transform(F.regexp_extract_all(markdown, F.lit(PAGE_MARKER), F.lit(0)), lambda m: F.regexp_replace(m, "[^0-9]", ""))
    numbers = F.transform(F.filter(digits, lambda x: x != ""), lambda x: x.try_cast("bigint"))
    return F.greatest(F.coalesce(F.array_max(numbers), F.lit(1)), F.lit(1)).cast("int")


def chunk_title(text: Column) -> Column:
    """The first line that is neither blank nor wholly a page marker, without leading #, at most 110 characters; else empty."""
    lines = F.filter(F.transform(F.split(text, "\n"), trimmed), lambda x: (x != "") & ~x.rlike(r"^<!--\s*page\s*\d+\s*-->$"))
    return F.coalesce(F.substring(F.regexp_replace(F.get(lines, F.lit(0)), r"^#+\s*", ""), 1, 110), F.lit(""))


def page_set(spec: Column, n: Column) -> Column:
    """`1-5,7` as sorted distinct pages within 1..n; ranges may be reversed; empty or `all` gives all.

    A part that is no range counts by the digits it begins with (`3rd` is 3); parts without are left out.
    """
    none = F.array().cast("array<int>")
    every = F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(none)
    plain = trimmed(F.coalesce(spec, F.lit("")))

    def number(digits: Column) -> Column:
        """Numbers beyond nine digits lie beyond every page."""
        d = F.regexp_replace(digits, "^0+(?=\\d)", "")
        return F.when(F.length(d) > 9, 1_000_000_000).otherwise(d.try_cast("int"))

    def span(part: Column) -> Column:
        p = trimmed(part)
        lone = F.regexp_extract(p, r"^\+?(\d+)", 1)
        is_range = p.rlike(r"^\d+\s*-\s*\d+$")
        a = F.when(is_range | (lone != ""), number(lone))
        b = F.when(is_range, number(F.regexp_extract(p, r"(\d+)$", 1))).otherwise(a)
        low, high = F.greatest(F.least(a, b), F.lit(1)), F.least(F.greatest(a, b), n)
        return F.when(a.isNotNull() & (low <= high), F.sequence(low, F.greatest(low, high))).otherwise(none)

    return F.when(F.lower(plain).isin("", "all"), every).otherwise(F.array_sort(F.array_distinct(F.flatten(F.transform(F.split(plain, ","), span)))))


def csv_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def clamped(value: Column, low: int, high: int, default: int) -> Column:
    return F.least(F.greatest(F.coalesce(value, F.lit(default)), F.lit(low)), F.lit(high))


def year_range(start: Column, end: Column) -> Column:
    return F.when(start.isNotNull() | end.isNotNull(), F.concat(F.coalesce(start.cast("string"), F.lit("")), F.lit("-"), F.coalesce(end.cast("string"), F.lit(""))))


# fixed values: parts of error texts that name a passing failure
RETRYABLE = (
    "fetch failed", "ECONNREFUSED", "ECONNRESET", "ETIMEDOUT", "ENOTFOUND", "EAI_AGAIN", "EPIPE", "AbortError", "timed out", "timeout",
    "unreachable", "Could not fetch", r"HTTP 5\d\d", "OCR request failed", "embed HTTP", "no markdown content",
)


def retryable(error: Column) -> Column:
    """Whether an error text names a passing failure: network, HTTP 5xx, or the OCR or embedding service."""
    return F.coalesce(error.rlike("(?i)" + "|".join(RETRYABLE)), F.lit(False))


def backoff_ms(attempts: Column) -> Column:
    return F.least(F.lit(30000.0) * F.pow(F.lit(2.0), F.least(attempts, F.lit(40)) - 1), F.lit(600000.0)).cast("bigint")


# fixed values: labels of how a text was got
OCR_LABELS = {"marker": "marker2/surya", "tesseract": "tesseract", "pdfjs": "none (pdfjs)", "ocr": "ocr server", "unknown": "unknown (pre-2026-08-27)"}


def ocr_label(ocr: Column) -> Column:
    labels = F.create_map(*[x for k, v in OCR_LABELS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(labels[ocr], ocr)


def snippet(text: Column, n: int = 400) -> Column:
    return F.substring(text, 1, n)
