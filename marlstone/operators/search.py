"""Hybrid search for a batch of queries: filters, three legs, fusion, diversity, hydration."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import snippet
from marlstone.operators import dense, fusion, lexical, sparse

NO_ENCODER = "query encoder unavailable: keyword results only"
NOTHING = "no search leg available for this query"
EMPTY = "the collection is empty"


@dataclass
class Filter:
    docs: list[str] = field(default_factory=list)
    page_from: int | None = None
    page_to: int | None = None
    section: str | None = None

    def allowed(self, chunks: DataFrame) -> DataFrame | None:
        """chunk_ids that pass; None without any condition. Pages are inclusive, sections match by substring in any case."""
        rows = chunks
        if self.docs:
            rows = rows.where(F.col("doc").isin(*self.docs))
        if self.page_from is not None:
            rows = rows.where(F.col("page") >= self.page_from)
        if self.page_to is not None:
            rows = rows.where(F.col("page") <= self.page_to)
        if self.section:
            rows = rows.where(F.lower("section").contains(self.section.lower()))
        return None if rows is chunks else rows.select("chunk_id")


@dataclass
class Collection:
    """chunks (chunk_id, doc, page, section, text), vectors (chunk_id, embedding), terms (chunk_id, term, weight)."""

    chunks: DataFrame
    vectors: DataFrame
    terms: DataFrame
    dim: int = 64
    model: str = "encoder"
    index: lexical.Index | None = None

    def lexical(self) -> lexical.Index:
        if self.index is None:
            self.index = lexical.Index(self.chunks)
        return self.index


def legs(c: Collection, queries: DataFrame, query_terms: DataFrame, k: int, where: Filter | None = None, keyword: bool = True, prune: bool = False) -> list[DataFrame]:
    """Dense, BM25 and sparse hits; keyword False leaves out BM25 only. Depths: max(4k, 20), the same, 4k. prune: see sparse.pruned_terms."""
    allowed = where.allowed(c.chunks) if where else None
    deep = max(4 * k, 20)
    out = [dense.dense_top_k(c.vectors, queries, deep, c.dim, allowed)]
    if keyword:
        out.append(c.lexical().search(queries, deep, allowed))
    out.append(sparse.sparse_top_k(c.terms, query_terms, c.chunks.count() if prune else 0, 4 * k, allowed, prune))
    return out


def hydrate(found: DataFrame, chunks: DataFrame) -> DataFrame:
    shown = chunks.select("chunk_id", "doc", "page", "section", snippet(F.col("text")).alias("snippet"))  # no more of a text is moved than that
    return found.join(shown, "chunk_id").select("query_id", "position", "chunk_id", "doc", "page", "section", F.round("score", 4).alias("score"), "snippet")


def hybrid(c: Collection, queries: DataFrame, query_terms: DataFrame, k: int = 10, where: Filter | None = None, keyword: bool = True, prune: bool = False) -> DataFrame:
    """(query_id, position, chunk_id, doc, page, section, score, snippet). k is held to 1..20.

    score is the fused one, position that of the diverse order, so scores need not fall with it.
    """
    k = min(max(k, 1), 20)
    found = fusion.mmr(fusion.rrf(legs(c, queries, query_terms, k, where, keyword, prune)), c.vectors, k)
    return hydrate(found, c.chunks)


def envelope(c: Collection, queries: DataFrame, query_terms: DataFrame, k: int = 10, keyword: bool = True) -> DataFrame:
    """One row per query: total chunks, model (empty for an empty collection) and dim, whether it has a vector, strength (best cosine or 0), message or null."""
    best = dense.dense_top_k(c.vectors, queries, 1, c.dim).select("query_id", "score")
    has_terms = query_terms.groupBy("query_id").agg(F.lit(True).alias("_terms"))
    total = c.chunks.agg(F.count(F.lit(1)).alias("total"))
    dense_ok = F.col("embedding").isNotNull()
    message = (
        F.when(F.col("total") == 0, EMPTY)
        .when(~dense_ok & F.col("_terms").isNull() & F.lit(not keyword), NOTHING)
        .when(~dense_ok & F.lit(keyword), NO_ENCODER)
    )
    rows = queries.join(best, "query_id", "left").join(has_terms, "query_id", "left").crossJoin(F.broadcast(total))
    model = F.when(F.col("total") == 0, "").otherwise(c.model)
    return rows.select("query_id", "total", model.alias("model"), F.lit(c.dim).alias("dim"), dense_ok.alias("dense"), F.round(F.coalesce("score", F.lit(0.0)), 4).alias("strength"), message.alias("message"))


def page_text(chunks: DataFrame) -> DataFrame:
    """(doc, page, chunks, section, text): the chunks of each page in order, joined by empty lines."""
    parts = F.sort_array(F.collect_list(F.struct("chunk_id", "section", "text")))
    rows = chunks.groupBy("doc", "page").agg(parts.alias("p"))
    return rows.select("doc", "page", F.size("p").alias("chunks"), F.col("p")[0]["section"].alias("section"), F.btrim(F.array_join(F.transform("p", lambda x: x["text"]), "\n\n"), F.lit(" \n\t\r")).alias("text"))


def page_sections(chunks: DataFrame, top: int = 8, sections: int = 6) -> DataFrame:
    """(doc, page, n, sections): the pages of a document with the most chunks, and their first distinct sections by count."""
    by = chunks.groupBy("doc", "page", "section").agg(F.count(F.lit(1)).alias("c"))
    inner = Window.partitionBy("doc", "page").orderBy(F.desc("c"), "section")
    ranked = by.withColumn("_r", F.row_number().over(inner))
    pages = ranked.groupBy("doc", "page").agg(F.sum("c").alias("n"), F.sort_array(F.collect_list(F.when(F.col("_r") <= sections, F.struct("_r", "section")))).alias("s"))
    outer = Window.partitionBy("doc").orderBy(F.desc("n"), "page")
    return pages.withColumn("_r", F.row_number().over(outer)).where(F.col("_r") <= top).select("doc", "page", "n", F.array_join(F.transform("s", lambda x: x["section"]), "; ").alias("sections"))
