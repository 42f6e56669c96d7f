"""Registered queries of the core operators over the test tables, and their oracle SQL.

Lexical queries are the texts of eval_items; dense, sparse and hybrid ones take every chunk whose id is divisible
by 50 as a query against all chunks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from marlstone.functions import tokens as tk
from marlstone.operators import dense, evaluate, fusion, lexical, search, sparse
from marlstone.session import durable, one_a_key


DIM, K, EVERY = 64, 10, 50
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def register(sql: str | None = None, name: str | None = None):  # noqa: ANN201
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


# --- tables without their repeats --------------------------------------------------------------------


def chunks_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").dropDuplicates(["chunk_id"])


def vectors_of(spark: SparkSession, d: str) -> DataFrame:
    rows = dense.usable(table(spark, d, "vec_chunks"), DIM).dropDuplicates(["chunk_id"])
    return rows.join(table(spark, d, "chunks").select("chunk_id").distinct(), "chunk_id", "left_semi")


def terms_of(spark: SparkSession, d: str) -> DataFrame:
    return sparse.clean_terms(table(spark, d, "sparse_terms"), table(spark, d, "chunks"))


def asked_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), "text")


def asked_vectors(spark: SparkSession, d: str) -> DataFrame:
    return vectors_of(spark, d).where(F.col("chunk_id") % EVERY == 0).select(F.col("chunk_id").alias("query_id"), "embedding")


def asked_terms(spark: SparkSession, d: str) -> DataFrame:
    return terms_of(spark, d).where(F.col("chunk_id") % EVERY == 0).select(F.col("chunk_id").alias("query_id"), "term", F.col("weight").alias("qw"))


def asked_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = chunks_of(spark, d).where(F.col("chunk_id") % EVERY == 0).select(F.col("chunk_id").alias("query_id"), "text")
    return rows.join(asked_vectors(spark, d), "query_id", "left")


def collection(spark: SparkSession, d: str) -> search.Collection:
    """Chunks, vectors and terms for several steps: texts and vectors aren't shuffled for their repeats, and terms are cleaned once."""
    chunks = one_a_key(table(spark, d, "chunks"), "chunk_id")
    vectors = one_a_key(dense.usable(table(spark, d, "vec_chunks"), DIM), "chunk_id", table(spark, d, "chunks").select("chunk_id"))
    return search.Collection(chunks, vectors, durable(terms_of(spark, d), "terms"), DIM)


def asked_of(c: search.Collection) -> tuple[DataFrame, DataFrame]:
    """The chunks of a collection that are the queries, with their vectors, and their terms."""
    asked = F.col("chunk_id") % EVERY == 0
    texts = c.chunks.where(asked).select(F.col("chunk_id").alias("query_id"), "text")
    vectors = c.vectors.where(asked).select(F.col("chunk_id").alias("query_id"), "embedding")
    return durable(texts.join(vectors, "query_id", "left"), "queries"), c.terms.where(asked).select(F.col("chunk_id").alias("query_id"), "term", F.col("weight").alias("qw"))


_CH = "ch as (select distinct on (chunk_id) chunk_id, doc, page, section, text from chunks)"
# fixed values, written out for the oracle: the words that are left out, and the patterns for an engine without look-around, whose word boundary is ASCII
_STOP = ", ".join(
    f"'{w}'"
    for w in (
        "a about also an and are as at be been being between but by can could during for from he her him i if in into is it its may not of on or over she should so than that the them then these they this those "
        "through to under using via was we were will with would you"
    ).split()
)
_RAW = (
    r"""(?i)\b(?:10\.\d{4,9}/[^\s,;)\]"'']+|arXiv:\d{4}\.\d{4,5}(?:v\d+)?)""",
    r"""\b[a-zA-Z][a-zA-Z0-9_]*(?:[+*/=<>!&%#@:|][+*/=<>!&%#@:|A-Za-z0-9_.]*)+\b""",
    r"""\b(?:[A-Z][a-z]?\d*){2,}\b""",
    r"""\b[a-zA-Z][a-zA-Z0-9]*[_^][a-zA-Z0-9]+\b""",
)


def _words(c: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9]+'), lambda t: length(t) > 1 and t not in ({_STOP}))"


def _raws(c: str) -> str:
    found = "[]::varchar[]"
    for p in _RAW:
        found = f"list_concat({found}, regexp_extract_all({c}, '{p}'))"
    return f"list_filter(list_transform({found}, lambda t: lower(trim(t))), lambda t: length(t) >= 2)"


def _tokens(c: str) -> str:
    return f"list_concat({_words(c)}, {_raws(c)})"


_PLAIN = "list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda t: length(t) >= 2)"


def _index(tokens: str) -> str:
    """CTEs: ch, tok, tf, ln, st, df."""
    return f"""{_CH}, tok as (select chunk_id, {tokens} as t from ch),
    tf as (select chunk_id, term, count(*) as tf from (select chunk_id, unnest(t) as term from tok) group by all),
    ln as (select chunk_id, len(t) as len from tok),
    st as (select count(*) as n, cast(sum(len) as bigint) as total_len, avg(len) as avg_len from ln),
    df as (select term, count(*) as df from tf group by term)"""


def _bm25(tokens: Callable[[str], str], k1: float, b: float, k: int, asked: str = "select item_id as query_id, text from eval_items") -> str:
    return f"""with {_index(tokens('text'))},
    q as (select distinct query_id, unnest({tokens('text')}) as term from ({asked})),
    s as (select query_id, chunk_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * len / avg_len))) as score
          from q join tf using (term) join df using (term) join ln using (chunk_id), st group by all),
    r as (select *, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id) as rank from s)
    select query_id, chunk_id, round(score, 6) as score, cast(rank as integer) as rank from r where rank <= {k}"""


def _ranked(df: DataFrame, *extra: str) -> DataFrame:
    return df.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank", *extra)


# --- lexical -----------------------------------------------------------------------------------------


@register(f"with {_CH} select chunk_id, {_words('text')} as tokens from ch")
def fn_word_tokens(spark: SparkSession, d: str) -> DataFrame:
    return chunks_of(spark, d).select("chunk_id", tk.word_tokens(F.col("text")).alias("tokens"))


@register(f"select doc_id, {_raws('coalesce(text, chr(32))')} as tokens from documents")
def fn_raw_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tk.raw_tokens(F.col("text")).alias("tokens"))


@register(f"with {_CH} select chunk_id, len({_tokens('text')}) as n_tokens, {_tokens('text')} as tokens from ch")
def fn_tokenize(spark: SparkSession, d: str) -> DataFrame:
    return chunks_of(spark, d).select("chunk_id", tk.tokens(F.col("text")).alias("tokens")).select("chunk_id", F.size("tokens").alias("n_tokens"), "tokens")


@register(f"with {_index(_tokens('text'))} select term, chunk_id, cast(tf as integer) as tf, cast(len as integer) as len from tf join ln using (chunk_id)")
def agg_tf(spark: SparkSession, d: str) -> DataFrame:
    return lexical.postings(chunks_of(spark, d))


@register(f"with {_index(_tokens('text'))} select term, df from df")
def agg_df(spark: SparkSession, d: str) -> DataFrame:
    return lexical.document_frequency(lexical.postings(chunks_of(spark, d)))


@register(f"with {_index(_tokens('text'))} select n, total_len, round(avg_len, 9) as avg_len from st")
def agg_len_stats(spark: SparkSession, d: str) -> DataFrame:
    return lexical.statistics(lexical.lengths(chunks_of(spark, d))).withColumn("avg_len", F.round("avg_len", 9))


def _run_bm25(spark: SparkSession, d: str, k: int, split=tk.tokens, **kw: float) -> DataFrame:
    return lexical.Index(chunks_of(spark, d), split).search(asked_texts(spark, d), k, **kw)


@register(_bm25(_tokens, 1.2, 0.75, K))
def ret_bm25(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(_run_bm25(spark, d, K))


@register(_bm25(_tokens, 0.9, 0.4, K))
def ret_bm25_mem(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(_run_bm25(spark, d, K, k1=0.9, b=0.4))


@register(_bm25(lambda c: _PLAIN.format(c=c), 1.5, 0.75, K))
def ev_bm25_alt(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(_run_bm25(spark, d, K, split=tk.plain_tokens, k1=1.5))


# --- sparse ------------------------------------------------------------------------------------------

_BLANKS = "' ' || chr(9) || chr(10) || chr(13)"
_TERMS = f"""tm as (select chunk_id, term, sum(weight) as weight from (
      select chunk_id, trim(lower(term), {_BLANKS}) as term, weight from (select distinct chunk_id, term, weight from sparse_terms where weight > 0))
    where term <> '' and chunk_id in (select chunk_id from chunks) group by all),
    q0 as (select chunk_id as query_id, term, weight as qw from tm where chunk_id % {EVERY} = 0),
    n as (select count(distinct chunk_id) as n from chunks),
    fd as (select term, count(*) as df from tm group by term),
    q1 as (select *, row_number() over (partition by query_id order by qw desc, term) as r from q0),
    q2 as (select query_id, term, qw, df from q1 join fd using (term), n where r <= 32 and df <= 0.15 * n),
    q3 as (select *, coalesce(sum(df) over (partition by query_id order by qw desc, term rows between unbounded preceding and 1 preceding), 0) as before from q2)"""


def _sparse_sql(asked: str, k: int) -> str:
    return f"""with {_TERMS}, s as (select query_id, chunk_id, sum(qw * weight) as score from ({asked}) a join tm using (term) group by all),
    r as (select *, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id) as rank from s)
    select query_id, chunk_id, round(score, 6) as score, cast(rank as integer) as rank from r where rank <= {k}"""


@register(_sparse_sql("select query_id, term, qw from q3 where before < 150000", 4 * K))
def ret_sparse(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(sparse.sparse_top_k(terms_of(spark, d), asked_terms(spark, d), chunks_of(spark, d).count(), 4 * K))


@register(_sparse_sql("select query_id, term, qw from q0", 4 * K))
def ev_sparse_full(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(sparse.sparse_top_k(terms_of(spark, d), asked_terms(spark, d), 0, 4 * K, prune=False))


@register(f"with {_TERMS} select query_id, term, round(qw, 6) as qw from q3 where before < 150")
def win_budget(spark: SparkSession, d: str) -> DataFrame:
    terms = terms_of(spark, d)
    return sparse.pruned_terms(asked_terms(spark, d), lexical.document_frequency(terms), chunks_of(spark, d).count(), budget=150).withColumn("qw", F.round("qw", 6))


# --- dense -------------------------------------------------------------------------------------------

_VEC = f"""v as (select distinct on (chunk_id) chunk_id, cast(embedding as double[]) as e from vec_chunks
      where len(embedding) = {DIM} and len(list_filter(embedding, lambda x: x is null or isnan(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0 and chunk_id in (select chunk_id from chunks)),
    qv as (select chunk_id as query_id, e as qe from v where chunk_id % {EVERY} = 0)"""


def _dense_sql(k: int, where: str = "true", digits: int = 6) -> str:
    return f"""with {_VEC}, s as (select query_id, chunk_id, list_cosine_similarity(qe, e) as score from qv, v where {where}),
    r as (select *, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id) as rank from s)
    select query_id, chunk_id, round(score, {digits}) as score, cast(rank as integer) as rank from r where rank <= {k}"""


@register(_dense_sql(4 * K))
def ret_dense(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(dense.dense_top_k(vectors_of(spark, d), asked_vectors(spark, d), 4 * K, DIM))


_WHERE = "chunk_id in (select chunk_id from chunks where page between 2 and 5 and contains(lower(section), 'method'))"


@register(_dense_sql(K, _WHERE))
def flt_allowed(spark: SparkSession, d: str) -> DataFrame:
    allowed = search.Filter(page_from=2, page_to=5, section="METHOD").allowed(chunks_of(spark, d))
    return _ranked(dense.dense_top_k(vectors_of(spark, d), asked_vectors(spark, d), K, DIM, allowed))


@register("""with v as (select vec_id, cast(embedding as double[]) as e from embeddings)
    select a.vec_id as vec_id, round(list_cosine_similarity(a.e, b.e), 6) as similarity from v a join v b on b.vec_id = a.vec_id + 1""")
def fn_cosine(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    pairs = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next")), "vec_id")
    return pairs.select("vec_id", F.round(dense.cosine(F.col("embedding"), F.col("next")), 6).alias("similarity"))


@register("""select vec_id, list_transform(e, lambda x: round(x / n, 6)) as unit from (
    select vec_id, cast(embedding as double[]) as e, sqrt(list_sum(list_transform(cast(embedding as double[]), lambda x: x * x))) as n from embeddings)""")
def fn_l2norm(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.transform(dense.normalised(F.col("embedding")), lambda x: F.round(x, 6)).alias("unit"))


# --- fusion and search -------------------------------------------------------------------------------

# chunks are the queries; a leg that a query has nothing for has no rows
_ASKED_CHUNKS = f"select chunk_id as query_id, text from (select distinct on (chunk_id) chunk_id, text from chunks) where chunk_id % {EVERY} = 0"


def _legs_sql(legs: list[str]) -> str:
    """CTEs: f and fr, the fusion of the legs given as (query_id, chunk_id, rank)."""
    every = " union all ".join(f"select query_id, chunk_id, rank - 1 as r, {i} as leg from ({leg})" for i, leg in enumerate(legs))
    return f"""l as ({every}),
    f as (select query_id, chunk_id, sum(1.0::double / (r + 60)) as score, min(leg * 1000000 + r) as first from l group by all),
    fr as (select *, row_number() over (partition by query_id order by round(score, 9) desc, first, chunk_id) as rank from f)"""


def _three_sql(k: int) -> list[str]:
    return [_dense_sql(k), _bm25(_tokens, 1.2, 0.75, k, _ASKED_CHUNKS), _sparse_sql("select query_id, term, qw from q3 where before < 150000", k)]


_LEGS = _legs_sql(_three_sql(4 * K))
_WHOLE = [*_three_sql(4 * K)[:2], _sparse_sql("select query_id, term, qw from q0", 4 * K)]  # with all terms of a query


def _mmr_sql(k: int, pool: int, weight: float = 0.7) -> str:
    """CTEs after fr: p, the pool with relevance and vectors; x, the similarities in it; m, the picks, one step of recursion each."""
    return f"""pv as (select distinct on (chunk_id) chunk_id, cast(embedding as double[]) as e from vec_chunks where len(embedding) = {DIM} and len(list_filter(embedding, lambda z: z is null or isnan(z))) = 0
      and len(list_filter(embedding, lambda z: z <> 0)) > 0 and chunk_id in (select chunk_id from chunks)),
    b as (select query_id, min(score) as lo, max(score) as hi from fr where rank <= {pool} group by 1),
    p as (select query_id, chunk_id, rank, score, case when hi > lo then (score - lo) / (hi - lo) else 1 end as rel, e from fr join b using (query_id) left join pv using (chunk_id) where rank <= {pool}),
    x as (select i.query_id, i.rank as i, j.rank as j, list_cosine_similarity(i.e, j.e) as s from p i join p j using (query_id) where i.e is not null and j.e is not null),
    m as (select query_id, 0 as position, []::bigint[] as chosen from b
      union all
      select query_id, position + 1, list_append(chosen, rank) from (
        select *, row_number() over (partition by query_id order by round({weight} * rel - (1 - {weight}) * near, 12) desc, rank) as r from (
          select m.query_id, m.position, m.chosen, p.rank, p.rel, coalesce(greatest(max(x.s), 0), 0) as near
          from m join p on p.query_id = m.query_id and not list_contains(m.chosen, p.rank)
          left join x on x.query_id = m.query_id and x.i = p.rank and list_contains(m.chosen, x.j)
          where m.position < {k} group by all)) where r = 1),
    picked as (select m.query_id, m.position::int as position, p.chunk_id, p.score from m join p on p.query_id = m.query_id and p.rank = m.chosen[-1] where m.position > 0)"""


def _hybrid_sql(legs: list[str], k: int) -> str:
    return f"""with recursive {_legs_sql(legs)}, {_mmr_sql(k, max(2 * k, 20))}
    select query_id, position, chunk_id, doc, page, section, round(score, 4) as score, substr(text, 1, 400) as snippet from picked join (select distinct on (chunk_id) * from chunks) using (chunk_id)"""


def _legs(c: search.Collection) -> list[DataFrame]:
    return search.legs(c, *asked_of(c), K, prune=True)


@register(f"with {_LEGS} select query_id, chunk_id, round(score, 6) as score, cast(rank as integer) as rank from fr")
def ret_rrf(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(fusion.rrf(_legs(collection(spark, d))))


@register(f"""with {_LEGS}, p as (select * from fr where rank <= 20), m as (select query_id, min(score) as lo, max(score) as hi from p group by 1)
    select query_id, chunk_id, round(case when hi > lo then (score - lo) / (hi - lo) else 1 end, 6) as rel from p join m using (query_id)""")
def win_minmax(spark: SparkSession, d: str) -> DataFrame:
    return fusion.min_max(fusion.rrf(_legs(collection(spark, d))).where("rank <= 20")).select("query_id", "chunk_id", F.round("rel", 6).alias("rel"))


@register(f"with recursive {_LEGS}, {_mmr_sql(K, 20)} select query_id, chunk_id, round(score, 6) as score, position from picked")
def ret_mmr(spark: SparkSession, d: str) -> DataFrame:
    c = collection(spark, d)
    return fusion.mmr(fusion.rrf(_legs(c)), c.vectors, K).withColumn("score", F.round("score", 6))


@register(_hybrid_sql(_WHOLE, K))
def ret_hybrid(spark: SparkSession, d: str) -> DataFrame:
    c = collection(spark, d)
    return search.hybrid(c, *asked_of(c), K)


@register(_hybrid_sql([_WHOLE[0], _WHOLE[2]], K))
def ret_hybrid_dense(spark: SparkSession, d: str) -> DataFrame:
    """Without key words."""
    c = collection(spark, d)
    return search.hybrid(c, *asked_of(c), K, keyword=False)


_IN_DOCS = "select slug from docs where slug like '%-survey-%'"


@register(_hybrid_sql([f"select * from ({q}) where true" for q in (
    _dense_sql(4 * K, f"chunk_id in (select chunk_id from chunks where page <= 9 and doc in ({_IN_DOCS}))"),
    _bm25(_tokens, 1.2, 0.75, 4 * K, _ASKED_CHUNKS).replace("from q join tf", f"from q join (select * from tf where chunk_id in (select chunk_id from chunks where page <= 9 and doc in ({_IN_DOCS}))) tf"),
    _sparse_sql("select query_id, term, qw from q3 where before < 150000", 4 * K).replace("a join tm using", f"a join (select * from tm where chunk_id in (select chunk_id from chunks where page <= 9 and doc in ({_IN_DOCS}))) tm using"),
)], K))
def ret_hybrid_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Within a list of documents and of pages."""
    docs = [r.slug for r in table(spark, d, "docs").where("slug like '%-survey-%'").select("slug").distinct().collect()]
    return search.hybrid(collection(spark, d), asked_chunks(spark, d), asked_terms(spark, d), K, search.Filter(docs=docs, page_to=9), prune=True)


@register(_hybrid_sql([_bm25(_tokens, 1.2, 0.75, 4 * K)], K))
def ret_degrade(spark: SparkSession, d: str) -> DataFrame:
    """No query vectors and no weights: key words only."""
    queries = asked_texts(spark, d).withColumn("embedding", F.lit(None).cast("array<float>"))
    none = asked_terms(spark, d).where("false")
    return search.hybrid(collection(spark, d), queries, none, K)


@register(f"""select item_id as query_id, n as total, false as dense, 0.0::double as strength, case when keyword then '{search.NO_ENCODER}' else '{search.NOTHING}' end as message, keyword
    from eval_items, (select count(distinct chunk_id) as n from chunks), (select unnest([true, false]) as keyword)""")
def ret_degrade_message(spark: SparkSession, d: str) -> DataFrame:
    """What is said where the encoder gives nothing, with key words and without."""
    queries, none = asked_texts(spark, d).withColumn("embedding", F.lit(None).cast("array<float>")), asked_terms(spark, d).where("false")
    parts = [search.envelope(collection(spark, d), queries, none, K, keyword).select("query_id", "total", "dense", "strength", "message", F.lit(keyword).alias("keyword")) for keyword in (True, False)]
    return parts[0].unionByName(parts[1])


@register(f"""with {_VEC}, b as (select query_id, max(list_cosine_similarity(qe, e)) as s from qv, v group by 1)
    select c.chunk_id as query_id, (select count(distinct chunk_id) from chunks) as total, b.s is not null as dense, round(coalesce(b.s, 0), 4) as strength,
      case when b.s is null then '{search.NO_ENCODER}' end as message
    from (select distinct chunk_id from chunks where chunk_id % {EVERY} = 0) c left join b on b.query_id = c.chunk_id""")
def ret_envelope(spark: SparkSession, d: str) -> DataFrame:
    return search.envelope(collection(spark, d), asked_chunks(spark, d), asked_terms(spark, d)).select("query_id", "total", "dense", "strength", "message")


@register(f"with {_CH} select doc, page, count(*) as chunks, arg_min(section, chunk_id) as section, trim(string_agg(text, chr(10) || chr(10) order by chunk_id), {_BLANKS}) as text from ch group by doc, page")
def ret_page(spark: SparkSession, d: str) -> DataFrame:
    return search.page_text(chunks_of(spark, d))


@register(f"""with {_CH}, c as (select doc, page, section, count(*) as c from ch group by all), r as (select *, row_number() over (partition by doc, page order by c desc, section) as r from c),
    p as (select doc, page, cast(sum(c) as bigint) as n, string_agg(section, '; ' order by r) filter (r <= 6) as sections from r group by all)
    select doc, page, n, sections from (select *, row_number() over (partition by doc order by n desc, page) as k from p) where k <= 8""")
def agg_page_section(spark: SparkSession, d: str) -> DataFrame:
    return search.page_sections(chunks_of(spark, d))


# --- evaluation --------------------------------------------------------------------------------------


def judged(spark: SparkSession, d: str) -> DataFrame:
    """A query chunk is 2 relevant to itself, the other chunks of its page 1: known items, as many as a page has chunks."""
    c = chunks_of(spark, d).select("chunk_id", "doc", "page")
    q = c.where(F.col("chunk_id") % EVERY == 0).join(asked_vectors(spark, d).select(F.col("query_id").alias("chunk_id")), "chunk_id", "left_semi").select(F.col("chunk_id").alias("query_id"), "doc", "page")
    return q.join(c, ["doc", "page"]).select("query_id", "chunk_id", F.when(F.col("query_id") == F.col("chunk_id"), 2).otherwise(1).alias("rel"))


_QREL = f"""{_CH}, qr as (select q.chunk_id as query_id, c.chunk_id, case when q.chunk_id = c.chunk_id then 2 else 1 end as rel from ch q join ch c using (doc, page)
    where q.chunk_id % {EVERY} = 0 and q.chunk_id in (select query_id from qv))"""


def _metrics(run: str) -> str:
    return f"""nd as (select i.query_id, coalesce(g.dcg, 0) / i.idcg as ndcg from (
      select query_id, sum(rel / log2(r + 1)) as idcg from (select *, row_number() over (partition by query_id order by rel desc, chunk_id) as r from qr) where r <= 10 group by 1) i
      left join (select query_id, sum(rel / log2(rank + 1)) as dcg from {run} join qr using (query_id, chunk_id) where rank <= 10 group by 1) g using (query_id)),
    rc as (select query_id, coalesce(n, 0) / m as recall from (select query_id, count(*) as m from qr group by 1) a
      left join (select query_id, count(*) as n from {run} join qr using (query_id, chunk_id) where rank <= 100 group by 1) b using (query_id))"""


_EVAL = f"with {_VEC}, dl as ({_dense_sql(100)}), {_QREL}, {_metrics('dl')}"


def _dense_run(spark: SparkSession, d: str, k: int = 100) -> DataFrame:
    return dense.dense_top_k(vectors_of(spark, d), asked_vectors(spark, d), k, DIM)


@register(f"{_EVAL} select query_id, round(ndcg, 6) as ndcg from nd")
def ev_ndcg(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.ndcg(_dense_run(spark, d), judged(spark, d)).withColumn("ndcg", F.round("ndcg", 6))


@register(f"{_EVAL} select query_id, round(recall, 6) as recall from rc")
def ev_recall(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.recall(_dense_run(spark, d), judged(spark, d)).withColumn("recall", F.round("recall", 6))


def full_rankings(spark: SparkSession, d: str, names: tuple[str, ...] = ("dense", "bm25", "sparse", "pruned"), depth: int = 200) -> dict[str, DataFrame]:
    """The harness's legs that are named, each written once: all later steps start at these narrow rows."""
    chunks = chunks_of(spark, d)
    queries = chunks.where(F.col("chunk_id") % EVERY == 0).select(F.col("chunk_id").alias("query_id"), "text")
    terms = durable(terms_of(spark, d), "terms")
    asked = terms.where(F.col("chunk_id") % EVERY == 0).select(F.col("chunk_id").alias("query_id"), "term", F.col("weight").alias("qw"))
    make = {
        "dense": lambda: _dense_run(spark, d, depth),
        "bm25": lambda: lexical.Index(chunks, tk.plain_tokens).search(queries, depth, k1=1.5),
        "sparse": lambda: sparse.sparse_top_k(terms, asked, 0, depth, prune=False),
        "pruned": lambda: sparse.sparse_top_k(terms, asked, table(spark, d, "chunks").select("chunk_id").distinct().count(), depth),
    }
    return {n: durable(make[n](), n) for n in names}


def full_legs(spark: SparkSession, d: str, runs: dict[str, DataFrame], depth: int = 200) -> dict[str, DataFrame]:
    """The runs as full rankings, to a depth of 200, unscored chunks included; each written once."""
    ids = durable(table(spark, d, "chunks").select("chunk_id").distinct(), "ids")
    queries = ids.where(F.col("chunk_id") % EVERY == 0).select(F.col("chunk_id").alias("query_id"))
    known = {"dense": durable(vectors_of(spark, d).select("chunk_id"), "known")}  # cosines can lie below 0
    return {n: durable(evaluate.full_ranking(run, queries, ids, depth, known.get(n)), "full") for n, run in runs.items()}


def _fused(legs: dict[str, DataFrame], *names: str) -> DataFrame:
    return fusion.rrf([legs[n] for n in names])


def _full_sql(run: str, depth: int = 200) -> str:
    """The first of every query's ranking of all chunks, by a run that scores those it has anything for."""
    return f"""select query_id, chunk_id, rank from (select q.query_id, c.chunk_id, row_number() over (partition by q.query_id order by round(coalesce(s.score, 0), 9) desc, c.chunk_id) as rank
      from (select distinct chunk_id as query_id from chunks where chunk_id % {EVERY} = 0) q cross join (select distinct chunk_id from chunks) c left join ({run}) s on s.query_id = q.query_id and s.chunk_id = c.chunk_id) where rank <= {depth}"""


_RUNS = {
    "dense": f"with {_VEC} select query_id, chunk_id, list_cosine_similarity(qe, e) as score from qv, v",
    "bm25": _bm25(lambda c: _PLAIN.format(c=c), 1.5, 0.75, 10**9, _ASKED_CHUNKS).replace("round(score, 6) as score", "score"),
    "sparse": _sparse_sql("select query_id, term, qw from q0", 10**9).replace("round(score, 6) as score", "score"),
    "pruned": _sparse_sql("select query_id, term, qw from q3 where before < 150000", 10**9).replace("round(score, 6) as score", "score"),
}


@register(f"with {_legs_sql([_full_sql(_RUNS[n]) for n in ('dense', 'bm25', 'pruned')])} select query_id, chunk_id, round(score, 6) as score, cast(rank as integer) as rank from fr where rank <= 100")
def ev_rrf200(spark: SparkSession, d: str) -> DataFrame:
    names = ("dense", "bm25", "pruned")
    return _ranked(_fused(full_legs(spark, d, full_rankings(spark, d, names)), *names).where("rank <= 100"))


def _ablation_sql() -> str:
    ranked = {n: f"select query_id, chunk_id, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id) as rank from ({_RUNS[n]}) qualify rank <= 200" for n in ("dense", "bm25", "sparse")}
    for name, legs in {"3leg": ("dense", "bm25", "sparse"), "3leg+prune": ("dense", "bm25", "pruned")}.items():
        ranked[name] = f"with {_legs_sql([_full_sql(_RUNS[n]) for n in legs])} select query_id, chunk_id, rank from fr"
    means = (f"(with {_VEC}, {_QREL}, run as ({run}), {_metrics('run')} select '{name}' as leg, (select avg(ndcg) from nd) as ndcg, (select avg(recall) from rc) as recall)" for name, run in ranked.items())
    return f"select leg, round(ndcg, 6) as ndcg, round(recall, 6) as recall from ({' union all '.join(means)})"


@register(_ablation_sql())
def ev_ablation(spark: SparkSession, d: str) -> DataFrame:
    runs = full_rankings(spark, d)
    legs = {n: runs[n] for n in ("dense", "bm25", "sparse")}
    full = full_legs(spark, d, runs)
    legs |= {"3leg": durable(_fused(full, "dense", "bm25", "sparse"), "fused"), "3leg+prune": durable(_fused(full, "dense", "bm25", "pruned"), "fused")}
    means = evaluate.ablation(legs, durable(judged(spark, d), "judged"))
    return means.select("leg", F.round("ndcg", 6).alias("ndcg"), F.round("recall", 6).alias("recall"))


from marlstone.plans import catalog_text  # noqa: E402, F401 - registers its queries
