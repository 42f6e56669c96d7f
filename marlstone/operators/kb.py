"""Lifecycle of a collection: cleaning, replacing, merging, copying, integrity, status; snapshots are in sources.

A collection is a dict of DataFrames: docs (slug), chunks, vec_chunks, sparse_terms (chunk_id). Postings and
counts are derived from chunks, so no step can leave them stale.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators import jobs as queue
from marlstone.operators.numbering import running_sum

TABLES = ("docs", "chunks", "vec_chunks", "sparse_terms")
CHILDREN = ("chunks", "vec_chunks", "sparse_terms")


def latest_docs(docs: DataFrame) -> DataFrame:
    """One row per slug: the one with the latest created_at, of equals the greatest in all columns."""
    rest = [c for c in docs.columns if c not in ("slug", "created_at")]
    return docs.where("slug is not null").groupBy("slug").agg(F.max(F.struct("created_at", *rest)).alias("m")).select(*[F.col("slug") if c == "slug" else F.col(f"m.{c}").alias(c) for c in docs.columns])


def delete_docs(kb: dict[str, DataFrame], slugs: DataFrame) -> dict[str, DataFrame]:
    """The collection without the documents of `slugs` and all that belongs to them."""
    gone = slugs.select("slug").distinct()
    dead = kb["chunks"].join(gone, kb["chunks"]["doc"] == gone["slug"], "left_semi").select("chunk_id").distinct()
    out = {"docs": kb["docs"].join(gone, "slug", "left_anti")}
    return out | {t: kb[t].join(dead, "chunk_id", "left_anti") for t in CHILDREN}


def replace_docs(kb: dict[str, DataFrame], new: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Documents of `new` in place of those of the same slug; their chunks get ids after the greatest one."""
    kept, moved = delete_docs(kb, new["docs"]), remap(new, kb["chunks"])
    return {t: kept[t].unionByName(moved[t]) for t in TABLES}


def remap(new: dict[str, DataFrame], live_chunks: DataFrame) -> dict[str, DataFrame]:
    """`new` with chunk ids that follow the greatest one of live_chunks, in order of doc and old id.

    Numbers run within ranges of document and id together, so a document that holds a large share of the chunks is
    spread over many tasks. Rows of vectors and terms without a chunk are dropped.
    """
    ids = new["chunks"].select(F.lit(0).alias("_all"), "doc", "chunk_id").distinct()
    numbered = running_sum(ids, F.lit(1), ["_all"], ["doc", "chunk_id"], "_k")
    base = live_chunks.agg(F.coalesce(F.max("chunk_id"), F.lit(0)).cast("bigint").alias("base"))
    mapped = numbered.crossJoin(F.broadcast(base)).select("chunk_id", (F.col("base") + F.col("_k")).alias("_new"))
    out = {"docs": new["docs"]}
    for t in CHILDREN:
        columns = new[t].columns
        out[t] = new[t].join(mapped, "chunk_id").drop("chunk_id").withColumnRenamed("_new", "chunk_id").select(*columns)
    return out


def merge(live: dict[str, DataFrame], incoming: dict[str, DataFrame], replace: bool = False) -> tuple[dict[str, DataFrame], DataFrame]:
    """The merged collection, and one row (slug, action, chunks) per incoming document: `skipped`, `added` or `replaced`.

    Without replace, documents that are there already are skipped.
    """
    known = live["docs"].select("slug").distinct()
    chunks = incoming["chunks"].groupBy(F.col("doc").alias("slug")).agg(F.count(F.lit(1)).alias("chunks"))
    action = F.when(F.col("_known").isNull(), "added").when(F.lit(replace), "replaced").otherwise("skipped")
    report = incoming["docs"].select("slug").distinct().join(known.withColumn("_known", F.lit(True)), "slug", "left").join(chunks, "slug", "left").select("slug", action.alias("action"), F.coalesce("chunks", F.lit(0)).alias("chunks"))
    taken = incoming if replace else delete_docs(incoming, known)
    return replace_docs(live, taken), report


def orphans(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows whose chunk doesn't exist."""
    return rows.join(chunks.select("chunk_id").distinct(), "chunk_id", "left_anti")


def integrity(kb: dict[str, DataFrame], postings: DataFrame) -> DataFrame:
    """One row (relation, rows, orphans, distinct_chunks) for each table that hangs on chunks."""
    ids = kb["chunks"].select("chunk_id").distinct().withColumn("_there", F.lit(1))
    out = None
    for name, rows in {"vec_chunks": kb["vec_chunks"], "sparse_terms": kb["sparse_terms"], "bm25_postings": postings}.items():
        part = rows.select("chunk_id").join(ids, "chunk_id", "left").groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_there").isNull()).alias("o"))
        part = part.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum("o"), F.lit(0)).alias("orphans"), F.count("chunk_id").alias("distinct_chunks")).select(F.lit(name).alias("relation"), "rows", "orphans", "distinct_chunks")
        out = part if out is None else out.unionByName(part)
    return out


def status(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(slug, source, pages, chunks, stored_chunks, lang, ocr, state): documents with the real number of their chunks."""
    real = chunks.select("doc", "chunk_id").distinct().groupBy(F.col("doc").alias("slug")).agg(F.count(F.lit(1)).alias("real"))
    return latest_docs(docs).join(real, "slug", "left").select("slug", "source", "pages", F.coalesce("real", F.lit(0)).alias("chunks"), F.col("chunks").alias("stored_chunks"), "lang", "ocr", F.lit("indexed").alias("state"))


def overview(docs: DataFrame, chunks: DataFrame, jobs: DataFrame, pending: DataFrame, recent: int = 5) -> DataFrame:
    """The whole state in one table (part, key, label, status, progress, chunks, error): `docs`, the jobs in the `queue`,
    the `recent` last finished ones, and one row `remote` with the number of remote jobs that were not pulled, if there are any.

    pending: (job_id, pulled), one row per file of a remote job.
    """
    null = F.lit(None).cast("string")

    def part(name: str, key: Column, label: Column, status: Column, progress: Column, n: Column, error: Column) -> list[Column]:
        return [F.lit(name).alias("part"), key.cast("string").alias("key"), label.alias("label"), status.alias("status"), progress.alias("progress"), n.cast("bigint").alias("chunks"), error.alias("error")]

    nothing = F.lit(None)
    view = queue.job_view(jobs)
    listed = status(docs, chunks).select(*part("docs", F.col("slug"), F.col("source"), F.col("state"), null, F.col("chunks"), null))
    waiting = queue.active(view).select(*part("queue", F.col("id"), F.col("label"), F.col("status"), F.col("progress"), nothing, null))
    done = queue.recent(view, recent).select(*part("recent", F.col("id"), F.col("label"), F.col("status"), null, F.col("chunks"), F.col("error")))
    remote = pending.where(~F.coalesce("pulled", F.lit(False))).agg(F.countDistinct("job_id").alias("n")).where("n > 0").select(*part("remote", null, null, null, null, F.col("n"), null))
    return listed.unionByName(waiting).unionByName(done).unionByName(remote)
