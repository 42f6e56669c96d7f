"""The pN queries: each runs one operator of this folder over its whole tables; SQL holds the oracles."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import language, leakage, nearcopies, neighbours, quality, scans, splitter, terms, tokenizer


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- 1: frequency of terms ---------------------------------------------------------------------------


def p1_terms(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks")
    dense = terms.term_frequencies(table(spark, d, "bm25_postings"), chunks)
    sparse = terms.term_frequencies(table(spark, d, "sparse_terms"), chunks, weight="weight", sum_weight=False)
    return dense.select(F.lit("bm25_postings").alias("origin"), "*").unionByName(sparse.select(F.lit("sparse_terms").alias("origin"), "*"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_terms(spark, d).where("mark is not null").select("origin", "term", "mark")


_P1 = """
with k as (
  select 'bm25_postings' as origin, lower(trim(term, ' ' || chr(9) || chr(10) || chr(13))) as term, chunk_id, cast(tf as bigint) as n
  from (select distinct term, chunk_id, tf from bm25_postings where tf > 0)
  union all
  select 'sparse_terms', lower(trim(term, ' ' || chr(9) || chr(10) || chr(13))), chunk_id, 1
  from (select distinct term, chunk_id, weight from sparse_terms where weight > 0 and not isnan(weight))
), g as (select * from k where term <> '' and chunk_id in (select chunk_id from chunks)),
n as (select origin, count(distinct chunk_id) as n_records from g group by origin),
f as (select origin, term, cast(sum(n) as bigint) as occurrences, count(distinct chunk_id) as records from g group by origin, term)
select origin, term, occurrences, records,
       case when occurrences <= 2 then 'rare' when records > 0.15 * n_records then 'common' end as mark
from f join n using (origin)
"""

# --- 2: languages of documents and passages ----------------------------------------------------------


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    documents, passages = language.languages(table(spark, d, "docs"), table(spark, d, "chunks"))
    wrong = documents.where("lang is not null and not (named <=> lang)").select(F.col("doc").alias("slug"), F.lit(0).cast("bigint").alias("chunk_id"), "lang")
    other = passages.where("sentences >= 2 and lang <> main and chunk_id is not null").select(F.col("doc").alias("slug"), "chunk_id", "lang")
    return wrong.unionByName(other).distinct()


def p2_passages(spark: SparkSession, d: str) -> DataFrame:
    return language.languages(table(spark, d, "docs"), table(spark, d, "chunks"))[1]


def p2_documents(spark: SparkSession, d: str) -> DataFrame:
    return language.languages(table(spark, d, "docs"), table(spark, d, "chunks"))[0]


# --- 3: splitting oversized items --------------------------------------------------------------------


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    sections = table(spark, d, "sections").select(F.lit("section").alias("item_kind"), F.col("section_id").alias("item_id"), F.col("heading").alias("label"), "text")
    specs = table(spark, d, "chunk_specs").select(F.lit("chunk_spec").alias("item_kind"), F.col("spec_id").alias("item_id"), F.col("section").alias("label"), "text")
    return splitter.split_oversized(sections.unionByName(specs), label="label").drop("label")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_pieces(spark, d).where("n_pieces > 1 and piece = 0").select("item_kind", "item_id").distinct()


_P3 = """
select distinct item_kind, item_id from (
  select 'section' as item_kind, section_id as item_id, text from sections
  union all select 'chunk_spec', spec_id, text from chunk_specs
) where length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) > 2000
"""



def p3_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """What pieces must keep, for every item: put together without their overlaps they give the trimmed text, none is over the limit, and each repeats the set amount of the one before."""
    pieces = p3_pieces(spark, d).distinct()
    overlap, length = splitter.OVERLAP, F.length("piece_text")
    own = F.when(F.col("piece") == 0, F.col("piece_text")).otherwise(F.expr(f"substring(piece_text, {overlap + 1})"))
    wrong = (length > splitter.LIMIT) | ((F.col("piece") > 0) & (length != F.col("piece_end") - F.col("piece_start") + overlap))
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", own.alias("t")))), lambda x: x["t"]), "")
    return pieces.groupBy("item_kind", "item_id").agg(F.md5(parts).alias("text_md5"), F.count_if(wrong).alias("wrong"))


_P3_REBUILT = """
select item_kind, item_id, md5(t) as text_md5, 0::bigint as wrong from (
  select distinct item_kind, item_id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) as t from (
    select 'section' as item_kind, section_id as item_id, text from sections union all select 'chunk_spec', spec_id, text from chunk_specs)) where t <> ''
"""

# --- 4: most similar vectors -------------------------------------------------------------------------


def p4_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.nearest(table(spark, d, "vec_chunks"), table(spark, d, "chunks"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.pairs(p4_neighbours(spark, d)).select(F.col("a").alias("chunk_id_a"), F.col("b").alias("chunk_id_b"))


# --- 5: near copies ----------------------------------------------------------------------------------


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    links, members = nearcopies.near_copies(table(spark, d, "chunks"))
    return nearcopies.all_pairs(links, members).select(F.col("a").alias("chunk_id_a"), F.col("b").alias("chunk_id_b"))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return nearcopies.groups(*nearcopies.near_copies(table(spark, d, "chunks"))).withColumnRenamed("id", "chunk_id")


# --- 6: noise of scanned pages -----------------------------------------------------------------------


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.scan_traces(table(spark, d, "chunks"))


def p6_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scans.repair(table(spark, d, "chunks"))


# --- 7: encoding with a public tokenizer -------------------------------------------------------------


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode_corpus(table(spark, d, "documents"), ["doc_id"])


# --- 8: evaluation texts in the corpus ---------------------------------------------------------------


def p8_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_measured(spark: SparkSession, d: str) -> DataFrame:
    """The overlaps' figures without the place, which a tie may leave open."""
    return p8_overlaps(spark, d).select("doc_id", "item_id", "longest_run", "tolerant_score").distinct()


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_overlaps(spark, d).where(F.col("longest_run") >= leakage.SPAN).select("doc_id", "item_id").distinct()


# --- 9: text statistics and types --------------------------------------------------------------------


def p9_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.text_types(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    rows = p9_statistics(spark, d)
    return rows.where((F.col("n_chars") >= quality.MIN_CHARS) & (F.col("text_type") != "prose")).select("doc_id", F.col("text_type").alias("kind")).distinct()


# --- oracles by brute force: every pair, every run --------------------------------------------------

_P4 = """
with v as (select distinct chunk_id, cast(embedding as double[]) as e from vec_chunks
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or isnan(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0 and chunk_id in (select chunk_id from chunks)),
s as (select a.chunk_id as a, b.chunk_id as b, round(list_cosine_similarity(a.e, b.e), 6) as s from v a join v b on a.chunk_id <> b.chunk_id),
r as (select a, b, s from s qualify row_number() over (partition by a order by s desc, b) <= 5)
"""

_P5 = """
with t as (select chunk_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from (select distinct chunk_id, text from chunks where text is not null)),
g as (select distinct chunk_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as g from t where len(w) >= 20),
n as (select chunk_id, count(*) as n from g group by 1),
c as (select a.chunk_id as a, b.chunk_id as b, count(*) as c from g a join g b using (g) where a.chunk_id < b.chunk_id group by all)
select c.a as chunk_id_a, c.b as chunk_id_b from c join n x on x.chunk_id = c.a join n y on y.chunk_id = c.b where c >= 0.6 * (x.n + y.n - c) - 1e-9
"""


def _folded(text: str) -> str:
    """SQL for NFKC of a text, as far as signs of the basic plane go, whose forms are of the standard's tables; without soft hyphens and zero-width spaces."""
    single, several = {}, {}
    for code in range(0x80, 0x10000):
        sign = chr(code)
        if not 0xAC00 <= code < 0xD7A4 and not 0xD800 <= code < 0xE000 and (form := unicodedata.normalize("NFKC", sign)) != sign:
            (single if len(form) == 1 else several)[sign] = form
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    out = f"translate(nfc_normalize({text}), {quoted(''.join(single))}, {quoted(''.join(single.values()))})"
    for sign, form in several.items():
        if code_block(sign):
            out = f"replace({out}, {quoted(sign)}, {quoted(form)})"
    return f"replace(replace({out}, chr(173), ''), chr(8203), '')"


def code_block(sign: str) -> bool:
    """The blocks whose signs with several letters are put in one by one: Latin-1, letterlike signs, number forms, punctuation and presentation forms of Latin."""
    return any(a <= ord(sign) <= b for a, b in ((0x80, 0x17F), (0x2000, 0x206F), (0x2100, 0x218F), (0xFB00, 0xFB06)))


_WORDED = "select {id} as id, regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+') as w from {table} where text is not null"
_P8_WORDS = f"""dw as ({_WORDED.format(id='doc_id', text=_folded('text'), table='documents')}), iw as ({_WORDED.format(id='item_id', text=_folded('text'), table='eval_items')}),
dp as (select id as doc_id, i, w[i] as w, list_slice(w, i, i + 12) as s from dw, unnest(range(1, len(w) + 1)) as u(i)),
ip as (select id as item_id, i, w[i] as w, list_slice(w, i, i + 12) as s from iw, unnest(range(1, len(w) + 1)) as u(i))"""
_P8 = f"with {_P8_WORDS} select distinct doc_id, item_id from dp join ip using (s) where len(s) = 13"

# the masks, written out: every pair of places whose words agree where a mask has ones; then whole diagonals are compared
_P8_MASKS = ("1101100101011", "1110010011011", "1011011000111")
_P8_SEEDS = " union ".join(
    "select doc_id, item_id, d.i - t.i as diagonal from dp d join ip t on len(d.s) = 13 and len(t.s) = 13 and " + " and ".join(f"d.s[{k + 1}] = t.s[{k + 1}]" for k, x in enumerate(m) if x == "1") for m in _P8_MASKS
)
_P8_OVERLAPS = f"""with {_P8_WORDS}, h as ({_P8_SEEDS}),
c as (select h.doc_id, h.item_id, diagonal, d.i, d.w = t.w as same from h join dp d on d.doc_id = h.doc_id join ip t on t.item_id = h.item_id and t.i = d.i - diagonal),
r as (select *, sum(case when same then 0 else 1 end) over k as run_no, sum(case when same then 1 else -2 end) over k as total from c window k as (partition by doc_id, item_id, diagonal order by i)),
e as (select doc_id, item_id, diagonal, max(total - least(low, 0)) as score from (select *, coalesce(min(total) over (partition by doc_id, item_id, diagonal order by i rows between unbounded preceding and 1 preceding), 0) as low from r) group by all),
l as (select doc_id, item_id, diagonal, count(*) as n from r where same group by doc_id, item_id, diagonal, run_no)
select doc_id, item_id, longest_run, tolerant_score from (
  select doc_id, item_id, cast(max(n) as integer) as longest_run from l group by all) join (select doc_id, item_id, cast(max(greatest(score, 0)) as integer) as tolerant_score from e group by all) using (doc_id, item_id)
where longest_run >= 13 or tolerant_score >= 13
"""

QUERIES = {"p1_found": p1_found, "p1_terms": p1_terms, "p2_found": p2_found, "p2_documents": p2_documents, "p2_passages": p2_passages, "p3_found": p3_found, "p3_pieces": p3_pieces, "p3_rebuilt": p3_rebuilt, "p4_found": p4_found, "p4_neighbours": p4_neighbours, "p5_found": p5_found, "p5_groups": p5_groups, "p6_found": p6_found, "p6_repaired": p6_repaired, "p7_ids": p7_ids, "p8_found": p8_found, "p8_overlaps": p8_overlaps, "p8_measured": p8_measured, "p9_found": p9_found, "p9_statistics": p9_statistics}
SQL = {
    "p1_found": f"select origin, term, mark from ({_P1}) where mark is not null",
    "p1_terms": _P1,
    "p3_found": _P3,
    "p3_rebuilt": _P3_REBUILT,
    "p4_neighbours": f"{_P4} select a as id, b as neighbour, s as similarity from r",
    "p4_found": f"{_P4} select distinct least(a, b) as chunk_id_a, greatest(a, b) as chunk_id_b from r",
    "p5_found": _P5,
    "p8_found": _P8,
    "p8_measured": _P8_OVERLAPS,
}
