"""Bibliographic records of three services brought to one shape, from JSON text, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import strip_xml, to_doi

ABSTRACT, AUTHORS, UNSTRUCTURED = 2500, 12, 200
S2 = (
    "paperId string, title string, year int, venue string, publicationVenue string, authors array<struct<name string>>, citationCount int, "
    "externalIds struct<DOI string, ArXiv string>, openAccessPdf struct<url string>, url string, abstract string, tldr struct<text string>"
)
CROSSREF = (
    "title array<string>, issued struct<`date-parts` array<array<int>>>, `container-title` array<string>, author array<struct<given string, family string>>, "
    "`is-referenced-by-count` int, DOI string, URL string, abstract string"
)
REFERENCE = "DOI string, author string, `article-title` string, unstructured string, year string, `volume-title` string, `journal-title` string"
UNPAYWALL = "doi string, is_oa boolean, oa_status string, title string, year int, best_oa_location struct<url_for_pdf string, url string>"
FIELDS = ("paperId", "title", "year", "venue", "authors", "citationCount", "doi", "arxiv", "openAccessPdf", "url", "abstract", "tldr")


def _text(c: Column, n: int) -> Column:
    return F.nullif(F.substring(F.coalesce(c, F.lit("")), 1, n), F.lit(""))


def semantic_paper(json: Column) -> Column:
    p = F.from_json(json, S2)
    return F.struct(
        p["paperId"].alias("paperId"), p["title"].alias("title"), p["year"].alias("year"), F.coalesce(p["publicationVenue"], p["venue"]).alias("venue"),
        F.transform(F.slice(F.coalesce(p["authors"], F.array()), 1, AUTHORS), lambda a: a["name"]).alias("authors"), p["citationCount"].alias("citationCount"),
        p["externalIds"]["DOI"].alias("doi"), p["externalIds"]["ArXiv"].alias("arxiv"), p["openAccessPdf"]["url"].alias("openAccessPdf"), p["url"].alias("url"),
        _text(p["abstract"], ABSTRACT).alias("abstract"), p["tldr"]["text"].alias("tldr"),
    )


def crossref_paper(json: Column) -> Column:
    w = F.from_json(json, CROSSREF)
    null = F.lit(None).cast("string")
    name = lambda a: F.array_join(F.filter(F.array(a["given"], a["family"]), lambda x: x != ""), " ")
    return F.struct(
        null.alias("paperId"), F.get(w["title"], F.lit(0)).alias("title"), F.get(F.get(w["issued"]["date-parts"], F.lit(0)), F.lit(0)).alias("year"),
        F.get(w["container-title"], F.lit(0)).alias("venue"), F.transform(F.coalesce(w["author"], F.array()), name).alias("authors"), w["is-referenced-by-count"].alias("citationCount"),
        w["DOI"].alias("doi"), null.alias("arxiv"), null.alias("openAccessPdf"), F.coalesce(F.concat(F.lit("https://doi.org/"), w["DOI"]), w["URL"]).alias("url"),
        _text(strip_xml(w["abstract"]), ABSTRACT).alias("abstract"), null.alias("tldr"),
    )


def _cited_authors(author: Column) -> Column:
    """One name, or a list of names or of records, of which the name holds, else the family name, else an empty text."""
    each = F.transform(F.from_json(author, "array<string>"), lambda a: F.when(
        a.startswith("{"), F.coalesce(F.get_json_object(a, "$.name"), F.get_json_object(a, "$.family"), F.lit(""))).otherwise(a))
    none = F.array().cast("array<string>")
    return F.when(author.isNull(), none).when(author.startswith("["), F.coalesce(each, none)).otherwise(F.array(author))


def crossref_reference(json: Column) -> Column:
    r = F.from_json(json, REFERENCE)
    null = F.lit(None).cast("string")
    return F.struct(
        null.alias("paperId"), F.coalesce(r["article-title"], F.substring(r["unstructured"], 1, UNSTRUCTURED)).alias("title"), r["year"].cast("int").alias("year"),
        F.coalesce(r["volume-title"], r["journal-title"]).alias("venue"), _cited_authors(r["author"]).alias("authors"),
        F.lit(None).cast("int").alias("citationCount"), r["DOI"].alias("doi"), null.alias("arxiv"), null.alias("openAccessPdf"), F.concat(F.lit("https://doi.org/"), r["DOI"]).alias("url"),
        null.alias("abstract"), null.alias("tldr"), r["unstructured"].alias("citationText"),
    )


def unpaywall(json: Column) -> Column:
    u = F.from_json(json, UNPAYWALL)
    return F.struct(u["doi"].alias("doi"), u["is_oa"].alias("is_oa"), u["oa_status"].alias("oa_status"), u["title"].alias("title"), u["year"].alias("year"), F.coalesce(u["best_oa_location"]["url_for_pdf"], u["best_oa_location"]["url"]).alias("pdf"))


def citation_edges(papers: DataFrame, paper: str, others: str, direction: str, limit: int = 10) -> DataFrame:
    """(src, dst, direction): one hop; for `citations` the others cite the paper. limit is held to 1..50."""
    limit = min(max(limit, 1), 50)
    rows = papers.select(F.col(paper).alias("p"), F.explode(F.slice(F.col(others), 1, limit)).alias("o"))
    src, dst = ("o", "p") if direction == "citations" else ("p", "o")
    return rows.select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(direction).alias("direction"))


def search_results(answers: DataFrame, limit: int = 5) -> DataFrame:
    """(query, source, total, rank, and the columns of a paper) from the answers of a search (query, first, second): the JSON of the first
    service, or where it is null (it failed) that of the second. limit is held to 1..20; without a total the papers are counted.
    """
    limit = min(max(limit, 1), 20)
    null = F.lit(None).cast("string")
    one = F.from_json("first", "data array<string>, total bigint")
    two = F.from_json("second", "message struct<items array<string>, `total-results` bigint>")["message"]
    none = F.array().cast("array<string>")
    first = F.transform(F.slice(F.coalesce(one["data"], none), 1, limit), lambda j: semantic_paper(j))
    second = F.transform(F.slice(F.coalesce(two["items"], none), 1, limit), lambda j: crossref_paper(j))
    lists = answers.select(
        "query", F.when(F.col("first").isNotNull(), "semantic_scholar").when(F.col("second").isNotNull(), "crossref").otherwise(null).alias("source"),
        F.when(F.col("first").isNotNull(), F.coalesce(one["total"], F.size(F.coalesce(one["data"], none)).cast("bigint"))).otherwise(F.coalesce(two["total-results"], F.size(F.coalesce(two["items"], none)).cast("bigint"))).alias("total"),
        F.when(F.col("first").isNotNull(), first).otherwise(second).alias("_p"),
    )
    return lists.select("query", "source", "total", F.posexplode("_p").alias("_k", "_v")).select("query", "source", "total", (F.col("_k") + 1).alias("rank"), "_v.*")


def linked_papers(answers: DataFrame, direction: str = "citations", limit: int = 10) -> DataFrame:
    """(paper, source, rank, and the columns of a paper) of the papers that cite one, or that it cites (`references`).

    answers: (paper, first, second). Where the first service failed (null), references come from the second one's record if the paper has a
    DOI; citations have no such way, and these papers give no rows. limit is held to 1..50.
    """
    limit = min(max(limit, 1), 50)
    none = F.array().cast("array<string>")
    links = F.from_json("first", "data array<struct<citingPaper string, citedPaper string>>")["data"]
    first = F.transform(F.slice(links, 1, limit), lambda x: semantic_paper(F.coalesce(x["citingPaper"], x["citedPaper"])))
    refs = F.from_json("second", "message struct<reference array<string>>")["message"]["reference"]
    second = F.transform(F.slice(F.coalesce(refs, none), 1, limit), lambda j: crossref_reference(j).dropFields("citationText"))
    may = F.lit(direction == "references") & to_doi(F.col("paper")).isNotNull() & F.col("second").isNotNull()
    lists = answers.select("paper", F.when(F.col("first").isNotNull(), "semantic_scholar").when(may, "crossref").alias("source"), F.when(F.col("first").isNotNull(), first).when(may, second).alias("_p"))
    return lists.select("paper", "source", F.posexplode("_p").alias("_k", "_v")).select("paper", "source", (F.col("_k") + 1).alias("rank"), "_v.*")


def pdf_candidates(records: DataFrame) -> DataFrame:
    """(doi, url, priority): addresses of a record (doi, best_pdf, arxiv, other_pdfs, s2_pdf) in order, each once.

    Columns s2_arxiv (an arXiv id that the second service names) and pmcid add the preprint and the two addresses of the article's archives.
    """
    has = lambda c: F.col(c) if c in records.columns else F.lit(None).cast("string")
    preprint = lambda c: F.concat(F.lit("https://arxiv.org/pdf/"), c)
    archives = F.array(F.concat(F.lit("https://europepmc.org/articles/"), has("pmcid"), F.lit("?pdf=render")), F.concat(F.lit("https://pmc.ncbi.nlm.nih.gov/articles/"), has("pmcid"), F.lit("/pdf/")))
    urls = F.flatten(F.array(
        F.array("best_pdf"), F.array(preprint(F.col("arxiv"))), F.coalesce("other_pdfs", F.array().cast("array<string>")), F.array("s2_pdf"), F.array(preprint(has("s2_arxiv"))), archives,
    ))
    rows = records.select("doi", F.posexplode(urls).alias("p", "url")).where("url <> ''").groupBy("doi", "url").agg(F.min("p").alias("p"))
    return rows.select("doi", "url", F.row_number().over(Window.partitionBy("doi").orderBy("p")).alias("priority"))


def looks_like_pdf(content: Column) -> Column:
    return (F.octet_length(content) >= 1024) & (F.substring(content, 1, 5) == F.encode(F.lit("%PDF-"), "utf-8"))


__all__ = ["citation_edges", "crossref_paper", "crossref_reference", "looks_like_pdf", "pdf_candidates", "semantic_paper", "to_doi", "unpaywall"]
