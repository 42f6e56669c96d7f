"""From glyph runs to lines, sections and sentence-aware chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import _CUT, _END, page_pieces, sentences, trimmed
from marlstone.operators.numbering import running_sum

MAX_LENGTH, SMALL_LENGTH = 2000, 600
# fixed values: words that begin a heading, and numbered headings
HEADING = (
    r"(?i)^(chapter|section|part|appendix|abstract|introduction|conclusion|acknowledg|references|bibliography|"
    r"table of contents|contents|methods?|results?|discussion|summary|preface|foreword)(?![A-Za-z0-9_])"
)
NUMBERED = r"^\s*\d+(\.\d+)*\.?\s+\S"


def pack(sents: Column, limit: int) -> Column:
    """Sentences in groups: a group ends before the sentence that would bring it over the limit; a longer one stays whole.

    The fold carries lengths only and appends the places where groups begin; the groups are slices of the sentences.
    """
    kind = "struct<starts:array<int>,i:int,length:int>"
    start = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("i"), F.lit(0).alias("length")).cast(kind)

    def step(acc: Column, n: Column) -> Column:
        new = (acc["i"] == 0) | (acc["length"] + n > limit)
        return F.struct(
            F.when(new, F.array_append(acc["starts"], acc["i"] + 1)).otherwise(acc["starts"]).alias("starts"),
            (acc["i"] + 1).alias("i"),
            F.when(new, n).otherwise(acc["length"] + n).alias("length"),
        ).cast(kind)

    def groups(acc: Column) -> Column:
        ends = F.concat(F.slice(acc["starts"], 2, F.greatest(F.size(acc["starts"]) - 1, F.lit(0))), F.array(acc["i"] + 1))
        return F.when(F.size(acc["starts"]) == 0, F.array().cast("array<array<string>>")).otherwise(F.zip_with(acc["starts"], ends, lambda a, b: F.slice(sents, a, b - a)))

    return F.aggregate(F.transform(sents, F.length), start, step, groups)


def chunk_sections(sections: DataFrame, limit: int = MAX_LENGTH, openers: str = r'[A-Z0-9("]') -> DataFrame:
    """The columns of sections but heading and text, and ordinal, section, text: one row per chunk. Rows need heading and text.

    A section without sentences has no chunk; a blank heading is `(preamble)` and is not put before the text.
    """
    keep = [c for c in sections.columns if c not in ("heading", "text")]
    heading = F.coalesce(F.col("heading"), F.lit(""))
    base = sections.select(*keep, heading.alias("_h"), pack(sentences(F.col("text"), openers), limit).alias("_g")).where(F.size("_g") > 0)
    rows = base.select(*keep, "_h", F.posexplode("_g").alias("ordinal", "_s"))
    body = F.array_join("_s", " ")
    return rows.select(*keep, "ordinal", F.when(F.col("_h") == "", "(preamble)").otherwise(F.col("_h")).alias("section"), F.when(F.col("_h") == "", body).otherwise(F.concat("_h", F.lit("\n\n"), body)).alias("text"))


def small_to_big(sections: DataFrame, limit: int = MAX_LENGTH, small: int = SMALL_LENGTH) -> tuple[DataFrame, DataFrame]:
    """Big chunks, as of chunk_sections but with parent; and small ones packed from the same sentences, with the parent's ordinal."""
    keep = [c for c in sections.columns if c not in ("heading", "text")]
    base = sections.select(*keep, F.coalesce("heading", F.lit("")).alias("_h"), F.posexplode(pack(sentences(F.col("text")), limit)).alias("parent", "_s"))
    label = F.when(F.col("_h") == "", "(preamble)").otherwise(F.col("_h")).alias("section")
    body = F.array_join("_s", " ")
    big = base.select(*keep, "parent", label, F.when(F.col("_h") == "", body).otherwise(F.concat("_h", F.lit("\n\n"), body)).alias("text"))
    little = base.select(*keep, "parent", label, F.posexplode(pack(F.col("_s"), small)).alias("ordinal", "_t")).select(*keep, "parent", "ordinal", "section", F.array_join("_t", " ").alias("text"))
    return big, little


def with_parent(small: DataFrame, big: DataFrame, keys: list[str]) -> DataFrame:
    return small.join(big.select(*keys, "parent", F.col("text").alias("parent_text")), [*keys, "parent"])


def group_lines(glyphs: DataFrame, key: str = "doc") -> DataFrame:
    """(doc, page, line_no, text, size, bold) from runs (doc, page, x, y, text, width, size, font).

    Runs of one rounded y are a line, from left to right; a gap over 2 puts a blank between. Lines go down the page.
    """
    width = F.coalesce("width", F.length("text") * F.coalesce(F.nullif("size", F.lit(0.0)), F.lit(8.0)) * 0.5)
    runs = glyphs.withColumn("_y", F.round("y")).withColumn("_end", F.col("x") + width)
    order = Window.partitionBy(key, "page", "_y").orderBy("x", "text")
    gap = F.col("x") - F.lag("_end").over(order)
    spaced = runs.withColumn("_t", F.when(gap > 2, F.concat(F.lit(" "), "text")).otherwise(F.col("text"))).withColumn("_k", F.row_number().over(order))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_k", "_t"))), lambda r: r["_t"]), "")
    bold = F.bool_or(F.coalesce(F.col("font").rlike("(?i)bold|heavy|black|semibold|demi"), F.lit(False)))
    lines = spaced.groupBy(key, "page", "_y").agg(trimmed(F.regexp_replace(joined, "[ \t]+", " ")).alias("text"), F.max("size").alias("size"), bold.alias("bold")).where("text <> ''")
    numbered = running_sum(lines, F.lit(1), [key], [F.col("page"), F.desc("_y")], "line_no")
    return numbered.select(key, "page", F.col("line_no").cast("int").alias("line_no"), "text", "size", "bold")


def body_size(lines: DataFrame, key: str = "doc") -> DataFrame:
    """(doc, body): the most frequent size in halves; of equally frequent ones the first seen."""
    by = lines.groupBy(key, (F.round(F.col("size") * 2) / 2).alias("_s")).agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("f"))
    return by.groupBy(key).agg(F.max_by("_s", F.struct("n", -F.col("f"))).alias("body"))


def is_heading(text: Column, size: Column, bold: Column, body: Column) -> Column:
    """By size, bold type, heading words or numbers, or capitals."""
    n = F.length(text)
    capitals = (n >= 3) & (n <= 80) & (text == F.upper(text)) & text.rlike("[A-Z]{3}")
    return (n > 0) & (n <= 120) & (((body > 0) & (size > 0) & (size >= body * 1.15)) | (bold & (n <= 80)) | ((n <= 80) & (text.rlike(HEADING) | text.rlike(NUMBERED))) | capitals)


def detect_sections(lines: DataFrame, key: str = "doc") -> DataFrame:
    """(doc, ordinal, heading, page, text): runs of lines from a heading to the next; headings without lines are dropped."""
    marked = lines.join(body_size(lines, key), key).withColumn("_h", F.coalesce(is_heading(F.col("text"), F.col("size"), F.col("bold"), F.col("body")), F.lit(False)))
    grouped = running_sum(marked, F.col("_h").cast("int"), [key], ["line_no"], "_g")
    parts = F.transform(F.sort_array(F.collect_list(F.when(~F.col("_h"), F.struct("line_no", "text")))), lambda r: r["text"])
    return (
        grouped.groupBy(key, "_g")
        .agg(F.coalesce(F.max(F.when(F.col("_h"), F.col("text"))), F.lit("")).alias("heading"), F.min_by("page", "line_no").alias("page"), parts.alias("_t"))
        .where(F.size("_t") > 0)
        .select(key, F.col("_g").alias("ordinal"), "heading", "page", F.array_join("_t", "\n").alias("text"))
    )


def markdown_sections(documents: DataFrame, key: str = "doc", text: str = "text") -> DataFrame:
    """(doc, ordinal, heading, page, text) of markdown documents, in one of three ways, by what a document has.

    Two or more texts between page markers: one section each, headed `Page i` and on page i, counted in order. Else by
    headings of one to four #, all on page 1, a blank heading being `(section)`. Else the whole text, as it is.
    Null texts have no sections. key names a row. A document is taken apart within its row: nothing is shuffled.
    """
    row = documents.where(F.col(text).isNotNull()).select(key, F.col(text).alias("_t"), page_pieces(F.col(text)).alias("_p"))
    paged = F.transform("_p", lambda p, i: F.struct(F.concat(F.lit("Page "), (i + 1).cast("string")).alias("heading"), (i + 1).alias("page"), p.alias("text")))
    # every heading line is put behind a sign of its own, then the text is cut there
    marked = F.regexp_replace("_t", r"(?md)^(#{1,4}[^\S\n]+[^\n\r\u2028\u2029]*)$", _CUT + "$1" + _END)
    parts = F.transform(F.split(marked, _CUT), lambda p, i: F.struct(
        F.when(i == 0, "").otherwise(F.coalesce(F.nullif(trimmed(F.regexp_extract(p, r"^#{1,4}\s+([^" + _END + "]*)" + _END, 1)), F.lit("")), F.lit("(section)"))).alias("heading"),
        F.lit(1).alias("page"),
        trimmed(F.when(i == 0, p).otherwise(F.regexp_replace(p, f"^[^{_END}]*{_END}", ""))).alias("text"),
    ))
    headed = F.filter(parts, lambda p: p["text"] != "")
    whole = F.array(F.struct(F.lit("").alias("heading"), F.lit(1).alias("page"), F.col("_t").alias("text")))
    sections = F.when(F.size("_p") > 1, paged).when(F.size(headed) > 0, headed).otherwise(whole)
    return row.select(key, F.posexplode(sections).alias("ordinal", "_s")).select(key, "ordinal", "_s.heading", "_s.page", "_s.text")


def page_count(sections: DataFrame, key: str = "doc") -> DataFrame:
    """(doc, pages): the greatest page of a document's sections, at least 1."""
    return sections.groupBy(key).agg(F.greatest(F.coalesce(F.max("page"), F.lit(1)), F.lit(1)).alias("pages"))


def scanned(sections: DataFrame, pages: DataFrame, key: str = "doc", threshold: int = 40) -> DataFrame:
    """(doc, scanned): fewer than threshold characters a page; never where the number of pages is not above 0.

    sections (doc, text) and pages (doc, pages), a row per document; a document without text has 0 characters.
    """
    size = sections.groupBy(key).agg(F.sum(F.length(F.coalesce("text", F.lit("")))).alias("_n"))
    return pages.join(size, key, "left").select(key, F.coalesce((F.col("pages") > 0) & (F.coalesce("_n", F.lit(0)) / F.col("pages") < threshold), F.lit(False)).alias("scanned"))
