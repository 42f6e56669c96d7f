"""Sources and sinks: snapshots of a collection, evaluation files, extractors and encoders behind interfaces, HTTP with retries."""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.text import leaf_markdown
from marlstone.operators.jobs import LEGACY
from marlstone.operators.kb import TABLES

POINTER = "current"


class Extractor(Protocol):
    """Turns a file's bytes into (page, text) rows; an OCR service or a PDF library goes behind it."""

    def __call__(self, path: str, content: bytes) -> list[tuple[int, str]]: ...


class Encoder(Protocol):
    """Turns texts into dense vectors and term weights."""

    def __call__(self, texts: list[str]) -> tuple[list[list[float]], list[dict[str, float]]]: ...


def read_jsonl_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text): title and text joined by a blank and trimmed."""
    rows = spark.read.schema("_id string, title string, text string").json(path)
    return rows.select(F.col("_id").alias("doc_id"), F.trim(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit("")))).alias("text"))


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("query_id string, chunk_id string, rel int").csv(path, sep="\t", header=True)


def read_pages(spark: SparkSession, path: str, extract: Extractor, attempts: int = 3) -> DataFrame:
    """(path, page, text) of every file below path; a file that can't be read has one row with page null."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"]):
                try:
                    rows += [(name, page, text) for page, text in retry(lambda: extract(name, content), attempts)]
                except Exception as e:  # noqa: BLE001 - any extractor's failure is the file's result
                    rows.append((name, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "page", "text"]).astype({"page": "Int32"})

    return files.mapInPandas(run, "path string, page int, text string")


def encode(chunks: DataFrame, encoder: Encoder, batch: int = 32, attempts: int = 3) -> DataFrame:
    """(chunk_id, embedding, weights), by batches; null texts are encoded as empty ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for i in range(0, len(rows), batch):
                part = rows.iloc[i : i + batch]
                dense, sparse = retry(lambda: encoder([t or "" for t in part["text"]]), attempts)
                yield pd.DataFrame({"chunk_id": part["chunk_id"].to_numpy(), "embedding": [list(map(float, v)) for v in dense], "weights": [{k: float(v) for k, v in w.items()} for w in sparse]})

    return chunks.select(F.col("chunk_id").cast("bigint"), "text").mapInPandas(run, "chunk_id bigint, embedding array<float>, weights map<string,double>")


def sparse_rows(encoded: DataFrame) -> DataFrame:
    return encoded.select("chunk_id", F.explode("weights").alias("term", "weight"))


def encode_query(queries: DataFrame, encoder: Encoder, dim: int) -> DataFrame:
    """queries with embedding and weights; where the encoder fails or gives another length: null and an empty map."""

    def safe(texts: list[str]) -> tuple[list, list]:
        try:
            dense, sparse = retry(lambda: encoder(texts), 2)
        except Exception:  # noqa: BLE001 - search goes on with key words
            return [None] * len(texts), [{}] * len(texts)
        return [list(map(float, v)) if v is not None and len(v) == dim else None for v in dense], sparse

    @F.pandas_udf("struct<embedding:array<float>,weights:map<string,double>>")
    def run(texts: pd.Series) -> pd.DataFrame:
        dense, sparse = safe([t or "" for t in texts])
        return pd.DataFrame({"embedding": dense, "weights": sparse})

    return queries.withColumn("_e", run("text")).select("*", "_e.embedding", "_e.weights").drop("_e")


def retry(call: Callable, attempts: int = 4, wait: Callable[[int], float] = lambda n: 0.5 * n, final: tuple = ()):  # noqa: ANN201
    """call(), up to `attempts` times; errors in `final` are not tried again."""
    for n in range(1, attempts + 1):
        try:
            return call()
        except Exception as e:  # noqa: BLE001
            if n == attempts or isinstance(e, final):
                raise
            time.sleep(wait(n))
    return None


def fetch_json(url: str, attempts: int = 4, opener: Callable = urllib.request.urlopen, timeout: float = 30, slow: float = 2.0, fast: float = 0.8) -> dict:
    """A JSON document: too many requests wait longer between attempts than other errors."""
    last = {"wait": fast}

    def call() -> dict:
        try:
            with opener(url, timeout=timeout) as r:
                return json.loads(r.read())
        except urllib.error.HTTPError as e:
            last["wait"] = slow if e.code == 429 else fast
            raise

    return retry(call, attempts, lambda n: last["wait"] * n)


def write_snapshot(kb: dict[str, DataFrame], path: str, version: str, codec: str = "zstd", live: str | None = None) -> dict[str, int | str]:
    """All tables under path/version, then the pointer: readers see the old version or the new one, whole.

    Returns where it lies and its documents, chunks and bytes. live: the collection's own place, which is refused.
    """
    spark = kb["docs"].sparkSession
    if live is not None and _plain_path(path) == _plain_path(live):
        raise ValueError("a snapshot must lie elsewhere than the collection")
    for name in TABLES:
        kb[name].write.mode("overwrite").option("compression", codec).parquet(f"{path}/{version}/{name}")
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").json(f"{path}/{POINTER}")
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{version}")
    size = place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place).getLength()
    return {"dest": f"{path}/{version}", "bytes": size, **{t: spark.read.parquet(f"{path}/{version}/{t}").count() for t in ("docs", "chunks")}}


def _plain_path(path: str) -> str:
    return os.path.normpath(path.split("://", 1)[-1].removeprefix("file:"))


def write_bundles(kb: dict[str, DataFrame], slugs: DataFrame, path: str, codec: str = "gzip") -> None:
    """One bundle for each document of slugs that has chunks: path/<table>/slug=<slug>, all tables of the document.

    Rows are brought together by document and a salt of the chunk, so a large document is written by several tasks.
    """
    chunks = kb["chunks"].withColumnRenamed("doc", "slug").join(slugs.select("slug").distinct(), "slug", "left_semi")
    owner = chunks.select("slug", "chunk_id").distinct()
    parts = {"docs": kb["docs"].join(owner.select("slug").distinct(), "slug", "left_semi"), "chunks": chunks, **{t: kb[t].join(owner, "chunk_id") for t in ("vec_chunks", "sparse_terms")}}
    for name, rows in parts.items():
        salt = F.pmod(F.xxhash64("chunk_id"), F.lit(16)) if "chunk_id" in rows.columns else F.lit(0)
        rows.repartition("slug", salt).write.mode("overwrite").option("compression", codec).partitionBy("slug").parquet(f"{path}/{name}")


def read_bundle(spark: SparkSession, path: str, slug: str) -> dict[str, DataFrame]:
    """The tables of one document's bundle; only its own files are read."""
    got = {t: spark.read.parquet(f"{path}/{t}").where(F.col("slug") == slug) for t in TABLES}
    return {"docs": got["docs"], "chunks": got["chunks"].withColumnRenamed("slug", "doc"), **{t: got[t].drop("slug") for t in ("vec_chunks", "sparse_terms")}}


def read_legacy_queue(spark: SparkSession, path: str) -> DataFrame:
    """The entries of an old queue file (a JSON array), for jobs.legacy_jobs; a missing or broken file gives no rows."""
    try:
        rows = spark.read.schema(LEGACY).option("multiLine", "true").json(path)
        rows.head(1)
    except Exception:  # noqa: BLE001 - an old queue must not stop a new one
        rows = spark.createDataFrame([], LEGACY)
    return rows.where("id is not null")


def read_snapshot(spark: SparkSession, path: str, version: str | None = None) -> dict[str, DataFrame]:
    version = version or spark.read.schema("version string").json(f"{path}/{POINTER}").first()["version"]
    fs = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{version}")
    system = fs.getFileSystem(spark._jsc.hadoopConfiguration())
    missing = [t for t in TABLES if not system.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{version}/{t}"))]
    if missing:
        raise ValueError(f"not a snapshot, without {', '.join(missing)}: {path}/{version}")
    return {t: spark.read.parquet(f"{path}/{version}/{t}") for t in TABLES}


def read_pending(spark: SparkSession, path: str) -> DataFrame:
    """Pending remote jobs, one row per file; a missing or broken file gives no rows."""
    schema = "job_id string, createdAt string, files array<struct<stem:string,name:string,slug:string,source:string>>, pulled boolean"
    try:
        rows = spark.read.schema(schema).option("multiLine", "true").json(path)
        rows.head(1)
    except Exception:  # noqa: BLE001 - read as none
        rows = spark.createDataFrame([], schema)
    return rows.where("job_id is not null").select("job_id", "createdAt", F.coalesce("pulled", F.lit(False)).alias("pulled"), F.inline("files"))


def block_leaves(trees: DataFrame, key: str = "doc", tree: str = "tree") -> DataFrame:
    """(doc, page, ordinal, html): leaves of block trees (JSON with id, html, children), depth first, pages from the ids."""

    def walk(node: dict, page: int) -> Iterator[tuple[int, str]]:
        parts = str(node.get("id", "")).split("/page/")
        page = int(parts[1].split("/")[0]) + 1 if len(parts) > 1 and parts[1].split("/")[0].isdigit() else page
        children = node.get("children") or []
        html = node.get("html") or ""
        if not children and html and "content-ref" not in html:
            yield page, html
        for child in children:
            yield from walk(child, page)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, page, i, html) for k, t in zip(batch[key], batch[tree]) if t for i, (page, html) in enumerate(walk(json.loads(t), 1))]
            yield pd.DataFrame(rows, columns=[key, "page", "ordinal", "html"])

    kind = trees.schema[key].dataType.simpleString()
    return trees.select(key, tree).mapInPandas(run, f"{key} {kind}, page int, ordinal int, html string")


def page_markdown(leaves: DataFrame, key: str = "doc") -> DataFrame:
    """(doc, page, text): the leaves of a page as markdown, in order, with an empty line between; pages whose leaves are all empty have an empty text."""
    rows = leaves.select(key, "page", "ordinal", leaf_markdown(F.col("html")).alias("_t"))
    parts = F.sort_array(F.collect_list(F.when(F.col("_t") != "", F.struct("ordinal", "_t"))))
    return rows.groupBy(key, "page").agg(F.array_join(F.transform(parts, lambda p: p["_t"]), "\n\n").alias("text"))
