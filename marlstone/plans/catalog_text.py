"""Registered queries: text and identifier functions, chunking, lifecycle, jobs, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text as tx
from marlstone.operators import chunking, jobs, kb
from marlstone.plans.catalog import _BLANKS, _CH, chunks_of, register, table
from marlstone.streaming.ingest import sessions

_DOCS = "ld as (select slug, max_by(struct_pack(source := source, pages := pages, chunks := chunks, ocr := ocr, lang := lang), created_at) as m from docs group by slug)"
_SRC = "src as (select distinct source from docs where source is not null)"


def sources_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "docs").where("source is not null").select("source").distinct()


# --- text functions ----------------------------------------------------------------------------------

_PARAGRAPHS = f"list_filter(list_transform(regexp_split_to_array({{c}}, '\\n{{{{2,}}}}'), lambda p: trim(p, {_BLANKS} || chr(12) || chr(11))), lambda p: p <> '')"
_SENT = (
    "list_filter(flatten(list_transform(" + _PARAGRAPHS.format(c="text")
    + ", lambda p: list_transform(string_split(regexp_replace(p, '([.!?;:])\\s+([A-Z0-9(\"])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: trim(s, "
    + _BLANKS + " || chr(12) || chr(11))))), lambda s: s <> '')"
)


@register(f"with {_CH} select chunk_id, {_SENT} as sentences from ch")
def fn_split_sentences(spark: SparkSession, d: str) -> DataFrame:
    return chunks_of(spark, d).select("chunk_id", tx.sentences(F.col("text")).alias("sentences"))


def sections_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sections").where("text is not null").dropDuplicates(["section_id"])


def _packed(lists: str, limit: int) -> str:
    """CTEs over a table (key, s: a list of sentences): w walks them one by one, and k holds the groups as (key, g, s)."""
    return f"""w as (select key, s, 1 as i, 0 as g, length(s[1]) as n from {lists} where len(s) > 0
      union all select key, s, i + 1, case when n + length(s[i + 1]) > {limit} then g + 1 else g end, case when n + length(s[i + 1]) > {limit} then length(s[i + 1]) else n + length(s[i + 1]) end from w where i < len(s)),
    k as (select key, g, list(s[i] order by i) as s from w group by key, g)"""


_SECTIONS = f"sc as (select distinct on (section_id) * from sections where text is not null), ss as (select section_id as key, {_SENT} as s from sc)"
_TITLED = "case when coalesce(heading, '') = '' then '(preamble)' else heading end as section, case when coalesce(heading, '') = '' then array_to_string(s, ' ') else heading || chr(10) || chr(10) || array_to_string(s, ' ') end as text"


@register(f"with recursive {_SECTIONS}, {_packed('ss', 2000)} select section_id, doc, page, g as ordinal, {_TITLED} from k join sc on key = section_id")
def fn_chunk_flat(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_sections(sections_of(spark, d))


@register(f"""select b.section_id, b.parent, g as ordinal, array_to_string(t.s, ' ') as text, length(b.text) as parent_length from (
      with recursive {_SECTIONS}, {_packed('ss', 2000)} select section_id, g as parent, s, {_TITLED} from k join sc on key = section_id) b
    join (with recursive {_SECTIONS}, big as (with recursive {_packed('ss', 2000)} select key * 100000 + g as key, s from k), {_packed('big', 600)} select * from k) t on t.key = b.section_id * 100000 + b.parent""")
def fn_chunk_small_big(spark: SparkSession, d: str) -> DataFrame:
    big, small = chunking.small_to_big(sections_of(spark, d))
    return chunking.with_parent(small, big, ["section_id"]).select("section_id", "parent", "ordinal", "text", F.length("parent_text").alias("parent_length"))


@register("""select chunk_id, substr(text, 1, 400) as snippet from (select distinct on (chunk_id) chunk_id, text from chunks)""")
def prj_snippet(spark: SparkSession, d: str) -> DataFrame:
    return chunks_of(spark, d).select("chunk_id", tx.snippet(F.col("text")).alias("snippet"))


_TITLE = (
    f"substr(regexp_replace(coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, {_BLANKS} || chr(12) || chr(11))), "
    "lambda x: x <> '' and not regexp_full_match(x, '<!--\\s*page\\s*\\d+\\s*-->'))[1], ''), '^#+\\s*', ''), 1, 110)"
)


@register(f"with {_CH} select chunk_id, {_TITLE} as title from ch")
def fn_chunk_title(spark: SparkSession, d: str) -> DataFrame:
    return chunks_of(spark, d).select("chunk_id", tx.chunk_title(F.col("text")).alias("title"))


@register(f"with {_CH} select doc, {_TITLE} as title from (select doc, arg_min(text, chunk_id) as text from ch group by doc)")
def fn_chunk_title_doc(spark: SparkSession, d: str) -> DataFrame:
    """A document's title is that of its first chunk."""
    return chunks_of(spark, d).groupBy("doc").agg(F.min_by("text", "chunk_id").alias("text")).select("doc", tx.chunk_title(F.col("text")).alias("title"))


_FORMS = ("%", "DOI: %", "doi:https://doi.org/%", "http://doi.org/%", "https://dx.doi.org/%", "arXiv: 2004.1497%", "arXiv:%", " 2004.14974v2", "https://x.org/a/%.pdf", "/srv/in/%.PDF")
_SRCF = "srcf as (select distinct replace(f, '%', source) as source from (select distinct source from docs where source is not null), (select unnest([" + ", ".join(f"'{f}'" for f in _FORMS) + "]) as f))"


def forms_of(spark: SparkSession, d: str) -> DataFrame:
    """Every source of the tables, as it is and inside the other forms in which identifiers and addresses come."""
    rows = sources_of(spark, d).select(F.col("source").alias("_s"), F.explode(F.array(*map(F.lit, _FORMS))).alias("_f"))
    return rows.select(F.replace("_f", F.lit("%"), "_s").alias("source")).distinct()


_DOI = """t as (select source, trim(source) as s, regexp_replace(regexp_replace(trim(source), '^(?i:doi:\\s*)', ''), '^(?i:https?://doi\\.org/)', '') as t from srcf),
    k as (select source, s, case when regexp_full_match(t, '10\\.\\d{4,9}/\\S+') then t
      when regexp_full_match(t, '(?i)arxiv:\\s*\\d{4}\\.\\d{4,5}(v\\d+)?') then '10.48550/arXiv.' || regexp_extract(t, '(?i)^arxiv:\\s*(.*)$', 1) end as doi from t),
    r as (select source, s, doi, case when regexp_matches(s, '^(?i:https?://)') then 'url' when regexp_full_match(s, '(?i)\\d{4}\\.\\d{4,5}(v\\d+)?') then 'arxiv' when doi is not null then 'doi' else 'file' end as kind from k)"""


@register(f"with {_SRCF}, {_DOI} select source, doi from k")
def fn_to_doi(spark: SparkSession, d: str) -> DataFrame:
    return forms_of(spark, d).select("source", tx.to_doi(F.col("source")).alias("doi"))


_HASH = "cast(list_reduce(list_prepend(5381::bigint, list_transform(range(1, length({c}) + 1), lambda i: ord(substr({c}, i, 1))::bigint)), lambda h, x: (h * 33 + x) & 4294967295) as varchar)"


@register(f"with {_SRC} select source, {_HASH.format(c='source')} as hash from src")
def fn_simple_hash(spark: SparkSession, d: str) -> DataFrame:
    return sources_of(spark, d).select("source", tx.simple_hash(F.col("source")).alias("hash"))


@register(f"with {_SRC} select source, substr(md5(source), 1, 10) as hash from src")
def fn_md5_10(spark: SparkSession, d: str) -> DataFrame:
    return sources_of(spark, d).select("source", tx.md5_10(F.col("source")).alias("hash"))


@register(f"""with {_SRCF}, {_DOI}, n as (select source, kind, case when kind = 'url' and s like '%/' then 'document' when kind in ('url', 'file') then regexp_replace(regexp_extract(s, '([^/]*)$', 1), '(?i)\\.pdf$', '') else s end as o from r),
    g as (select source, kind, o, trim(regexp_replace(o, '[^A-Za-z0-9]+', '-', 'g'), '-') as s from n)
    select source, kind, case when s = '' then 'paper' when length(s) > 60 then substr(s, 1, 51) || '-' || substr({_HASH.format(c='o')}, 1, 8) else s end as slug from g""")
def src_resolve(spark: SparkSession, d: str) -> DataFrame:
    return forms_of(spark, d).select("source", tx.source_kind(F.col("source")).alias("kind"), tx.source_slug(F.col("source")).alias("slug"))


@register(f"""with {_SRC}, s as (select source, trim(regexp_replace(source || ' ' || source || ' ' || source, '[^A-Za-z0-9]+', '-', 'g'), '-') as s, source || ' ' || source || ' ' || source as o from src)
    select source, case when s = '' then 'paper' when length(s) > 60 then substr(s, 1, 51) || '-' || substr({_HASH.format(c='o')}, 1, 8) else s end as slug from s""")
def fn_slugify(spark: SparkSession, d: str) -> DataFrame:
    return sources_of(spark, d).select("source", tx.slugify(F.concat_ws(" ", "source", "source", "source")).alias("slug"))


@register(f"with {_SRC} select source, regexp_replace(regexp_extract(source, '([^/\\\\]*)[/\\\\]*$', 1), '(?i)\\.pdf$', '') as label from src")
def fn_label(spark: SparkSession, d: str) -> DataFrame:
    return sources_of(spark, d).select("source", tx.base_name(F.col("source")).alias("label"))


@register(f"with {_SRC} select source, regexp_replace(regexp_replace(source, '[^A-Za-z0-9._-]', '_', 'g'), '\\.[^.]*$', '') as stem from src")
def fn_safe_stem(spark: SparkSession, d: str) -> DataFrame:
    return sources_of(spark, d).select("source", tx.safe_stem(F.col("source")).alias("stem"))


# the rule: tags of a sign or more; lt, gt, amp, quot and both forms of the apostrophe, in this order; white space of any script
_STRIP = (
    "trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), "
    "'[\\t\\n\\v\\f\\r \\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]+', ' ', 'g'))"
)


@register(f"select doc_id, {_STRIP} as text from documents where contains(text, '<')")
def fn_strip_xml(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.col("text").contains("<")).select("doc_id", tx.strip_xml(F.col("text")).alias("text"))


@register(f"select doc_id, {_STRIP} as text from documents")
def fn_strip_xml_all(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.strip_xml(F.col("text")).alias("text"))


_ESCAPED = "replace(replace(replace(text, '&', '&amp;quot;'), '<', '&lt;&apos;'), '>', '<i>&#39;</i>&gt;')"


@register(f"select doc_id, {_STRIP} as text from (select doc_id, {_ESCAPED} as text from documents)")
def fn_strip_xml_entities(spark: SparkSession, d: str) -> DataFrame:
    """The texts with all of the entities put in, so that their order of resolution shows."""
    return table(spark, d, "documents").select("doc_id", tx.strip_xml(F.expr(_ESCAPED)).alias("text"))


@register(f"with {_DOCS} select slug, case m.ocr when 'marker' then 'marker2/surya' when 'tesseract' then 'tesseract' when 'pdfjs' then 'none (pdfjs)' when 'ocr' then 'ocr server' when 'unknown' then 'unknown (pre-2026-08-27)' else m.ocr end as label from ld")
def prj_fmt_ocr(spark: SparkSession, d: str) -> DataFrame:
    return kb.latest_docs(table(spark, d, "docs")).select("slug", tx.ocr_label(F.col("ocr")).alias("label"))


@register(f"with {_DOCS} select slug, least(greatest(coalesce(m.pages, 10), 1), 20) as k, m.pages || '-' || (m.pages + 3) as years from ld")
def flt_clamp(spark: SparkSession, d: str) -> DataFrame:
    return kb.latest_docs(table(spark, d, "docs")).select("slug", tx.clamped(F.col("pages"), 1, 20, 10).alias("k"), tx.year_range(F.col("pages"), F.col("pages") + 3).alias("years"))


_SPEC = "m.pages % 7 || '-' || (m.pages % 4 + 1) || ', ' || (m.pages // 2) || 'rd,x, ' || m.chunks || ',0,-3'"
_SPECS = f"sp as (select slug, m.pages as n, case m.pages % 5 when 0 then ' All ' when 1 then '' else {_SPEC} end as spec from ld where m.pages is not null)"


@register(f"""with {_DOCS}, {_SPECS}, p as (select slug, n, spec, trim(unnest(string_split(spec, ','))) as p from sp),
    q as (select slug, n, case when regexp_full_match(p, '\\d+\\s*-\\s*\\d+') then regexp_extract(p, '^(\\d+)', 1)::int else nullif(regexp_extract(p, '^(-?\\d+)', 1), '')::int end as a,
      case when regexp_full_match(p, '\\d+\\s*-\\s*\\d+') then regexp_extract(p, '(\\d+)$', 1)::int else nullif(regexp_extract(p, '^(-?\\d+)', 1), '')::int end as b from p),
    e as (select distinct slug, n, unnest(range(least(a, b), greatest(a, b) + 1)) as x from q where a is not null)
    select slug, case when lower(trim(spec)) in ('', 'all') then range(1, n + 1)::integer[] else coalesce(x, []::integer[]) end as pages
    from sp left join (select slug, list(x order by x)::integer[] as x from e where x between 1 and n group by slug) using (slug)""")
def set_pages(spark: SparkSession, d: str) -> DataFrame:
    rows = kb.latest_docs(table(spark, d, "docs")).where("pages is not null")
    spec = F.expr("case pages % 5 when 0 then ' All ' when 1 then '' else (pages % 7) || '-' || (pages % 4 + 1) || ', ' || (pages div 2) || 'rd,x, ' || chunks || ',0,-3' end")
    return rows.select("slug", tx.page_set(spec, F.col("pages")).alias("pages"))


# --- lifecycle ---------------------------------------------------------------------------------------


def base_of(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {
        "docs": kb.latest_docs(table(spark, d, "docs")),
        "chunks": chunks_of(spark, d),
        "vec_chunks": table(spark, d, "vec_chunks").where("embedding is not null").dropDuplicates(["chunk_id"]),
        "sparse_terms": table(spark, d, "sparse_terms").where("term is not null").distinct(),
    }


def halves(spark: SparkSession, d: str) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """A live and an incoming collection: all documents but `thesis`, and all but `notes`."""
    whole = base_of(spark, d)
    without = lambda word: kb.delete_docs(whole, whole["docs"].where(F.col("slug").contains(word)))
    return without("-thesis-"), without("-notes-")


@register("select slug, source, m.pages as pages, (select count(distinct chunk_id) from chunks c where c.doc = ld.slug) as chunks, m.chunks as stored_chunks, m.lang as lang, m.ocr as ocr, 'indexed' as state from (select slug, m.source as source, m from (select slug, max_by(struct_pack(source := source, pages := pages, chunks := chunks, ocr := ocr, lang := lang), created_at) as m from docs group by slug)) ld")
def ret_status(spark: SparkSession, d: str) -> DataFrame:
    return kb.status(table(spark, d, "docs"), table(spark, d, "chunks"))


@register("select doc, page, section, chunk_id from (select distinct on (chunk_id) * from chunks) order by chunk_id")
def src_kb_scan(spark: SparkSession, d: str) -> DataFrame:
    return chunks_of(spark, d).select("doc", "page", "section", "chunk_id").orderBy("chunk_id")


@register("""select relation, cast(count(*) as bigint) as rows, cast(count(*) filter (chunk_id is null or chunk_id not in (select chunk_id from chunks)) as bigint) as orphans, count(distinct chunk_id) as distinct_chunks
    from (select 'vec_chunks' as relation, chunk_id from vec_chunks union all select 'sparse_terms', chunk_id from sparse_terms union all select 'bm25_postings', chunk_id from bm25_postings) group by relation""")
def agg_counts(spark: SparkSession, d: str) -> DataFrame:
    return kb.integrity({t: table(spark, d, t) for t in kb.TABLES}, table(spark, d, "bm25_postings"))


@register("select distinct chunk_id from bm25_postings where chunk_id not in (select chunk_id from chunks)")
def join_orphans(spark: SparkSession, d: str) -> DataFrame:
    return kb.orphans(table(spark, d, "bm25_postings"), table(spark, d, "chunks")).select("chunk_id").distinct()


@register("select slug, count(chunk_id) as chunks from (select distinct slug from docs where not contains(slug, '-thesis-')) d left join (select distinct doc, chunk_id from chunks) c on c.doc = d.slug group by slug")
def dml_delete_in(spark: SparkSession, d: str) -> DataFrame:
    live, _ = halves(spark, d)
    return live["docs"].join(live["chunks"], F.col("slug") == F.col("doc"), "left").groupBy("slug").agg(F.count("chunk_id").alias("chunks"))


@register("""with c as (select doc, count(distinct chunk_id) as n from chunks group by doc)
    select slug, case when contains(slug, '-thesis-') then 'added' else 'skipped' end as action, coalesce(n, 0) as chunks
    from (select distinct slug from docs where not contains(slug, '-notes-')) d left join c on c.doc = d.slug""")
def dml_import_merge(spark: SparkSession, d: str) -> DataFrame:
    live, incoming = halves(spark, d)
    return kb.merge(live, incoming)[1]


_REMAP = """with live as (select distinct chunk_id from chunks where not contains(doc, '-thesis-')), b as (select max(chunk_id) as b from live),
    inc as (select distinct on (chunk_id) chunk_id, doc, page, section, text from chunks where {w}),
    m as (select *, b + row_number() over (order by doc, chunk_id) as new_id from inc, b)
    """


@register(_REMAP.format(w="contains(doc, '-thesis-')") + "select new_id as chunk_id, doc, page, section from m")
def dml_copy_remap(spark: SparkSession, d: str) -> DataFrame:
    live, incoming = halves(spark, d)
    taken = kb.delete_docs(incoming, live["docs"])
    return kb.remap(taken, live["chunks"])["chunks"].select("chunk_id", "doc", "page", "section")


@register(_REMAP.format(w="contains(doc, '-thesis-')") + """select * from (select doc, count(*) as chunks, count(distinct chunk_id) as ids from (
      select doc, chunk_id from (select distinct on (chunk_id) chunk_id, doc from chunks where not contains(doc, '-thesis-')) union all select doc, new_id from m) group by doc)""")
def dml_ingest_replace(spark: SparkSession, d: str) -> DataFrame:
    live, incoming = halves(spark, d)
    merged, _ = kb.merge(live, incoming)
    return merged["chunks"].groupBy("doc").agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("chunk_id").alias("ids"))


def editions(spark: SparkSession, d: str) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """A live collection without theses, and a later edition without notes, of which every seventh chunk is gone."""
    live, incoming = halves(spark, d)
    keep = F.col("chunk_id") % 7 != 0
    return live, {"docs": incoming["docs"], **{t: incoming[t].where(keep) for t in kb.CHILDREN}}


_EDITION = """with ch as (select distinct on (chunk_id) * from chunks), live as (select * from ch where not contains(doc, '-thesis-')), b as (select max(chunk_id) as b from live),
    gone as (select distinct slug from docs where not contains(slug, '-notes-')),
    dead as (select chunk_id from ch where contains(doc, '-thesis-') or doc in (select slug from gone)),
    m as (select chunk_id, doc, page, section, b + row_number() over (order by doc, chunk_id) as new_id from ch, b where not contains(doc, '-notes-') and chunk_id % 7 <> 0)
    """


@register(_EDITION + "select chunk_id, doc, page, section from live where chunk_id not in (select chunk_id from dead) union all select new_id, doc, page, section from m")
def dml_replace(spark: SparkSession, d: str) -> DataFrame:
    """Documents of the later edition in place of those that are there."""
    return kb.merge(*editions(spark, d), replace=True)[0]["chunks"].select("chunk_id", "doc", "page", "section")


@register(_EDITION + """, v as (select distinct on (chunk_id) chunk_id, embedding from vec_chunks where embedding is not null)
    select chunk_id, list_transform(embedding, lambda x: x + 0::float) as embedding from (
      select chunk_id, embedding from v where chunk_id not in (select chunk_id from dead) union all select new_id, embedding from v join m using (chunk_id))""")
def join_remap(spark: SparkSession, d: str) -> DataFrame:
    """The vectors go with their chunks. A zero's sign is not told apart."""
    rows = kb.merge(*editions(spark, d), replace=True)[0]["vec_chunks"]
    return rows.select("chunk_id", F.transform("embedding", lambda x: x + F.lit(0.0).cast("float")).alias("embedding"))


@register(_EDITION + """, v as (select distinct chunk_id, term, weight from sparse_terms where term is not null)
    select chunk_id, term, weight from v where chunk_id not in (select chunk_id from dead) union all select new_id, term, weight from v join m using (chunk_id)""")
def join_remap_terms(spark: SparkSession, d: str) -> DataFrame:
    return kb.merge(*editions(spark, d), replace=True)[0]["sparse_terms"].select("chunk_id", "term", "weight")


@register("""with c as (select doc, count(distinct chunk_id) as n from chunks where chunk_id % 7 <> 0 group by doc)
    select slug, case when contains(slug, '-thesis-') then 'added' else 'replaced' end as action, coalesce(n, 0) as chunks
    from (select distinct slug from docs where not contains(slug, '-notes-')) d left join c on c.doc = d.slug""")
def dml_replace_report(spark: SparkSession, d: str) -> DataFrame:
    return kb.merge(*editions(spark, d), replace=True)[1]


_NOT_THESES = "chunk_id not in (select chunk_id from chunks where contains(doc, '-thesis-'))"


@register(f"""select 'docs' as relation, slug as key from docs where not contains(slug, '-thesis-') union select 'chunks', chunk_id::varchar from chunks where not contains(doc, '-thesis-')
    union select 'vec_chunks', chunk_id::varchar from vec_chunks where embedding is not null and {_NOT_THESES} union select 'sparse_terms', chunk_id || ' ' || term from sparse_terms where term is not null and {_NOT_THESES}""")
def dml_delete_all(spark: SparkSession, d: str) -> DataFrame:
    """The keys that are left in all tables of a collection whose theses were deleted."""
    live, _ = halves(spark, d)
    keys = {"docs": F.col("slug"), "chunks": F.col("chunk_id").cast("string"), "vec_chunks": F.col("chunk_id").cast("string"), "sparse_terms": F.concat_ws(" ", "chunk_id", "term")}
    out = None
    for t, key in keys.items():
        part = live[t].select(F.lit(t).alias("relation"), key.alias("key")).distinct()
        out = part if out is None else out.unionByName(part)
    return out


# --- jobs --------------------------------------------------------------------------------------------

_NOW = "2024-05-01 00:00:00"
_JOBS = "j as (select * from (select distinct * from jobs) qualify row_number() over (partition by id order by updated_at desc nulls last) = 1)"


def jobs_of(spark: SparkSession, d: str) -> DataFrame:
    return jobs.current(table(spark, d, "jobs"))


@register(f"with {_JOBS} select id, status, attempts from j where status = 'queued' and coalesce(next_attempt_at, timestamp '1970-01-01') <= timestamp '{_NOW}'")
def q_due(spark: SparkSession, d: str) -> DataFrame:
    return jobs.due(jobs_of(spark, d), F.lit(_NOW).cast("timestamp_ntz")).select("id", "status", "attempts")


_STALE = f"(status = 'processing' and heartbeat < timestamp '{_NOW}' - interval 180 seconds) is true"


@register(f"""with {_JOBS} select id, case when {_STALE} then 'queued' else status end as status, case when {_STALE} then 're-queued (worker lost heartbeat)' else progress end as progress,
    case when {_STALE} then timestamp '{_NOW}' else next_attempt_at end as next_attempt_at, case when not {_STALE} then owner end as owner from j""")
def q_requeue_stale(spark: SparkSession, d: str) -> DataFrame:
    return jobs.requeue_stale(jobs_of(spark, d), F.lit(_NOW).cast("timestamp_ntz")).select("id", "status", "progress", "next_attempt_at", "owner")


_FIRST = f"(select min(id) from j where status = 'queued' and coalesce(next_attempt_at, timestamp '1970-01-01') <= timestamp '{_NOW}')"


@register(f"with {_JOBS} select id, status, attempts from j where id = {_FIRST}")
def win_first_due(spark: SparkSession, d: str) -> DataFrame:
    return jobs.first_due(jobs_of(spark, d), F.lit(_NOW).cast("timestamp_ntz")).select("id", "status", "attempts")


@register(f"""with {_JOBS}, t as (select *, id = {_FIRST} as mine from j) select id, case when mine then 'processing' else status end as status, case when mine then 77 else owner end as owner,
    case when mine then timestamp '{_NOW}' else heartbeat end as heartbeat, case when mine then timestamp '{_NOW}' else updated_at end as updated_at from t""")
def q_claim(spark: SparkSession, d: str) -> DataFrame:
    return jobs.claim(jobs_of(spark, d), F.lit(_NOW).cast("timestamp_ntz"), 77).select("id", "status", "owner", "heartbeat", "updated_at")


@register(f"with {_JOBS} select id, status, case when id <= 40 and status = 'processing' then timestamp '{_NOW}' else heartbeat end as heartbeat from j")
def q_heartbeat(spark: SparkSession, d: str) -> DataFrame:
    return jobs.heartbeat(jobs_of(spark, d), list(range(41)), F.lit(_NOW).cast("timestamp_ntz")).select("id", "status", "heartbeat")


@register(f"""with {_JOBS}, n as (select distinct slug, source from docs where source is not null),
    k as (select (select max(id) from j) + row_number() over (order by slug, source) as id, slug as label, source, 'queued' as status, 0 as attempts from n)
    select id, label, source, status, attempts from j union all select * from k""")
def q_enqueue(spark: SparkSession, d: str) -> DataFrame:
    new = table(spark, d, "docs").where("source is not null").select(F.col("slug").alias("label"), F.lit(None).cast("string").alias("name"), "source", F.lit(True).alias("reindex")).distinct()
    return jobs.enqueue(jobs_of(spark, d), new, F.lit(_NOW).cast("timestamp_ntz")).select("id", "label", "source", "status", "attempts")


@register(f"with {_JOBS} select id, name, status, progress, attempts from j")
def q_update(spark: SparkSession, d: str) -> DataFrame:
    return jobs_of(spark, d).select("id", "name", "status", "progress", "attempts")


@register(f"with {_JOBS} select id, status from j where status in ('done', 'error') order by id desc limit 5")
def q_recent(spark: SparkSession, d: str) -> DataFrame:
    return jobs.recent(jobs_of(spark, d)).select("id", "status")


@register(f"with {_JOBS} select id, status from j where status in ('queued', 'processing')")
def q_active(spark: SparkSession, d: str) -> DataFrame:
    return jobs.active(jobs_of(spark, d)).select("id", "status")


@register(f"with {_JOBS} select count(*) filter (status = 'queued') as queued, count(*) filter (status = 'processing') as processing, count(*) filter (status = 'done') as done, count(*) filter (status = 'error') as error from j")
def q_stats(spark: SparkSession, d: str) -> DataFrame:
    return jobs.stats(jobs_of(spark, d))


# what names a passing failure, written out for the oracle
_PASSING = "fetch failed|ECONNREFUSED|ECONNRESET|ETIMEDOUT|ENOTFOUND|EAI_AGAIN|EPIPE|AbortError|timed out|timeout|unreachable|Could not fetch|HTTP 5[0-9][0-9]|OCR request failed|embed HTTP|no markdown content"
_RETRY = f"regexp_matches(error, '(?i){_PASSING}')"
_AGAIN = f"({_RETRY} and coalesce(attempts, 0) < 50)"


@register(f"""with {_JOBS} select id, case when {_AGAIN} then 'queued' else 'error' end as status, coalesce(attempts, 0) + case when {_AGAIN} then 1 else 0 end as attempts,
    case when {_AGAIN} then timestamp '{_NOW}' + to_milliseconds(cast(least(30000 * pow(2, coalesce(attempts, 0)), 600000) as bigint)) end as next_attempt_at from j where error is not null""")
def q_retry(spark: SparkSession, d: str) -> DataFrame:
    return jobs.after_failure(jobs_of(spark, d), F.lit(_NOW).cast("timestamp_ntz")).select("id", "status", "attempts", "next_attempt_at")


@register(f"with {_JOBS} select id, {_RETRY} as retryable from j where error is not null")
def fn_retryable(spark: SparkSession, d: str) -> DataFrame:
    return jobs_of(spark, d).where("error is not null").select("id", tx.retryable(F.col("error")).alias("retryable"))


@register(f"with {_JOBS} select id, cast(least(30000 * pow(2, attempts - 1), 600000) as bigint) as wait_ms from j where attempts > 0")
def fn_backoff(spark: SparkSession, d: str) -> DataFrame:
    return jobs_of(spark, d).where("attempts > 0").select("id", tx.backoff_ms(F.col("attempts")).alias("wait_ms"))


@register("""with e as (select user_id, ts, value, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end as n from events),
    s as (select *, sum(n) over (partition by user_id order by ts) as g from e)
    select user_id, count(*) as n, round(sum(value), 2) as total from s group by user_id, g""")
def st_sessions(spark: SparkSession, d: str) -> DataFrame:
    return sessions(table(spark, d, "events")).select("user_id", "n", F.round("total", 2).alias("total"))


# --- lines, sections, pages --------------------------------------------------------------------------


def lines_of(spark: SparkSession, d: str) -> DataFrame:
    """The chunks' lines as text lines of one size."""
    rows = chunks_of(spark, d).select("doc", "page", "chunk_id", F.posexplode(F.split("text", "\n")).alias("_n", "_t"))
    return rows.select("doc", "page", (F.col("chunk_id") * 10000 + F.col("_n")).alias("line_no"), F.trim("_t").alias("text"), F.lit(10.0).alias("size"), F.lit(False).alias("bold")).where("text <> ''")


_LINES = f"""{_CH}, ln as (select doc, page, chunk_id * 10000 + i - 1 as line_no, trim(t[i]) as text from (
      select doc, page, chunk_id, string_split(text, chr(10)) as t from ch), unnest(range(1, len(t) + 1)) as u(i) where trim(t[i]) <> '')"""
_HEAD = (
    "length(text) <= 120 and (length(text) <= 80 and (regexp_matches(text, '" + chunking.HEADING.replace("(?![A-Za-z0-9_])", "\\b") + "') or regexp_matches(text, '"
    + chunking.NUMBERED + "')) or length(text) between 3 and 80 and text = upper(text) and regexp_matches(text, '[A-Z]{3}'))"
)


@register(f"""with {_LINES}, h as (select *, {_HEAD} as h from ln), g as (select *, sum(h::int) over (partition by doc order by line_no) as g from h)
    select doc, cast(g as bigint) as ordinal, coalesce(max(text) filter (h), '') as heading, arg_min(page, line_no) as page, string_agg(text, chr(10) order by line_no) filter (not h) as text
    from g group by doc, g having count(*) filter (not h) > 0""")
def fn_detect_sections(spark: SparkSession, d: str) -> DataFrame:
    return chunking.detect_sections(lines_of(spark, d))


@register("""with s as (select doc_id as doc, length(t[i]) % 3 * 0.3 + 10.0 as size, i from (select doc_id, string_split(text, chr(10)) as t from documents where text is not null), unnest(range(1, len(t) + 1)) as u(i)),
    b as (select doc, round(size * 2) / 2 as s, count(*) as n, min(i) as f from s group by 1, 2) select doc, cast(arg_max(s, n * 100000000 - f) as double) as body from b group by doc""")
def agg_body_font(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("line_no", "_t"))
    return chunking.body_size(rows.select("doc", "line_no", (F.length("_t") % 3 * 0.3 + 10.0).alias("size")))


@register(f"with {_CH}, {_DOCS} select slug as doc, coalesce(m.pages > 0 and coalesce(n, 0) / m.pages < 600, false) as scanned from ld left join (select doc, sum(length(text)) as n from ch group by doc) c on c.doc = slug")
def agg_density(spark: SparkSession, d: str) -> DataFrame:
    pages = kb.latest_docs(table(spark, d, "docs")).select(F.col("slug").alias("doc"), "pages")
    return chunking.scanned(chunks_of(spark, d), pages, threshold=600)


_PAGED = f"{_CH}, p as (select doc, page, trim(text, {_BLANKS} || chr(12) || chr(11)) as text from ch)"


# a marker before some chunks' text, none before others, two around the rest
_SRV = "case chunk_id % 3 when 0 then text when 1 then 'lost <!-- page ' || page || ' -->' || chr(10) || text else '<!--page 0' || page || '-->' || text || '<!-- page ' || (page + 1) || ' --> ' || section || '<!-- page 3 --> ' end"
_MD = "case chunk_id % 3 when 0 then text when 1 then '----- page ' || page || ' -----' || chr(10) || text || chr(10) || '## Page ' || (page + 1) || chr(10) || 'see page 412' else '=====Page 0=====' || text || chr(12) || section end"
_TRIM = f"{_BLANKS} || chr(12) || chr(11)"


@register(f"""with {_CH}, t as (select chunk_id, {_SRV} as md from ch where text is not null),
    s as (select chunk_id, md, string_split(regexp_replace(md, '<!--\\s*page\\s*(\\d+)\\s*-->', chr(64976) || '\\1' || chr(64977), 'g'), chr(64976)) as p from t),
    u as (select chunk_id, string_split(unnest(p[2:]), chr(64977)) as x from s),
    k as (select chunk_id, x[1]::int as page, trim(x[2], {_TRIM}) as text from u where trim(x[2], {_TRIM}) <> '')
    select * from k union all select chunk_id, 1, trim(md, {_TRIM}) from s where chunk_id not in (select chunk_id from k)""")
def fn_md_sections_srv(spark: SparkSession, d: str) -> DataFrame:
    md = F.expr(_SRV)
    return chunks_of(spark, d).where("text is not null").select("chunk_id", F.inline(tx.marked_pages(md))).select("chunk_id", "page", "text")


# the marker's forms, written out for the oracle: a comment, dashes, equals signs, a heading, a form feed
_MARKERS = "(?i)(<!--\\s*page\\s*\\d+\\s*-->|-{{5,}}\\s*page\\s*\\d+\\s*-{{5,}}|={{5,}}\\s*page\\s*\\d+\\s*={{5,}}|#{{2,}}\\s*page\\s*\\d+\\s*|\\f)".replace("{{", "{").replace("}}", "}")


@register(f"""with {_CH}, t as (select chunk_id, {_MD} as md from ch where text is not null)
    select chunk_id, list_filter(list_transform(string_split(regexp_replace(md, '{_MARKERS}', chr(64976), 'g'), chr(64976)), lambda x: trim(x, {_TRIM})), lambda x: x <> '') as pieces,
      greatest(coalesce(list_max(list_transform(regexp_extract_all(md, '{_MARKERS}'), lambda x: nullif(regexp_replace(x, '[^0-9]', '', 'g'), '')::int)), 1), 1) as guess from t""")
def fn_split_pages(spark: SparkSession, d: str) -> DataFrame:
    md = F.expr(_MD)
    rows = chunks_of(spark, d).where("text is not null").select("chunk_id", md.alias("md"))
    return rows.select("chunk_id", tx.page_pieces(F.col("md")).alias("pieces"), tx.guessed_pages(F.col("md")).alias("guess"))


@register("select slug, list_filter(list_transform(string_split(slug || ' , ,' || source || ',', ','), lambda x: trim(x)), lambda x: x <> '') as parts from (select distinct slug, source from docs where source is not null)")
def flt_docs_csv(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "docs").where("source is not null").select("slug", "source").distinct()
    return rows.select("slug", tx.csv_list(F.concat(F.col("slug"), F.lit(" , ,"), F.col("source"), F.lit(","))).alias("parts"))


@register(f"""with {_JOBS} select id, label, nullif(name, '') as name, source, coalesce(reindex, false) as reindex, status, coalesce(progress, '') as progress, chunks, nullif(error, '') as error,
    coalesce(attempts, 0) as attempts, coalesce(next_attempt_at, timestamp '1970-01-01') as next_attempt_at, owner, created_at, updated_at from j""")
def prj_job(spark: SparkSession, d: str) -> DataFrame:
    return jobs.job_view(jobs_of(spark, d))


@register(f"with {_JOBS} select name, id, status from (select *, row_number() over (partition by name order by updated_at desc nulls last, id desc) as r from j where name is not null) where r = 1")
def latest_job(spark: SparkSession, d: str) -> DataFrame:
    return jobs.latest_per_document(jobs_of(spark, d)).select("name", "id", "status")


_SECTIONED = f"""with {_CH}, d as (select 'd' || doc_id as doc, text as md from documents union all select 'c' || chunk_id, {_MD} from ch),
    t as (select doc, md from d where md is not null),
    p as (select doc, md, list_filter(list_transform(string_split(regexp_replace(md, '{_MARKERS}', chr(64976), 'g'), chr(64976)), lambda x: trim(x, {_TRIM})), lambda x: x <> '') as p from t),
    l as (select doc, i, x[i] as l, regexp_full_match(x[i], '#{{1,4}}\\s+[^\\r\\x{{2028}}\\x{{2029}}]*') as h from (select doc, string_split(md, chr(10)) as x from p where len(p) < 2), unnest(range(1, len(x) + 1)) as u(i)),
    g as (select *, sum(h::int) over (partition by doc order by i) as g from l),
    s as (select doc, g, coalesce(max(coalesce(nullif(trim(regexp_extract(l, '^#{{1,4}}\\s+(.*)$', 1), {_TRIM}), ''), '(section)')) filter (h), '') as heading, trim(coalesce(string_agg(l, chr(10) order by i) filter (not h), ''), {_TRIM}) as text from g group by doc, g),
    e as (select doc, unnest(p) as text, unnest(range(1, len(p) + 1)) as n from p where len(p) > 1),
    r as (select doc, 'Page ' || n as heading, n::int as page, text from e union all select doc, heading, 1, text from s where text <> '')
    select doc, heading, page, text from r union all select doc, '', 1, md from p where doc not in (select doc from r)"""


def markdown_of(spark: SparkSession, d: str) -> DataFrame:
    """The documents as they are, and the chunks with page markers of all forms."""
    marked = chunks_of(spark, d).select(F.concat(F.lit("c"), "chunk_id").alias("doc"), F.expr(_MD).alias("text"))
    return table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("doc"), "text").unionByName(marked)


@register(_SECTIONED)
def fn_md_sections(spark: SparkSession, d: str) -> DataFrame:
    return chunking.markdown_sections(markdown_of(spark, d)).select("doc", "heading", "page", "text")


@register(f"select doc, greatest(max(page), 1) as pages from ({_SECTIONED}) group by doc")
def agg_page_max(spark: SparkSession, d: str) -> DataFrame:
    return chunking.page_count(chunking.markdown_sections(markdown_of(spark, d)))


# --- remote jobs and the whole state -----------------------------------------------------------------
# the queue's rows stand for files of remote jobs, ten to a job

_REMOTE = f"""{_JOBS}, f as (select id // 10 as job_id, id::varchar as stem, coalesce(name, 'none') as slug, id // 10 % 9 = 0 as pulled from j),
    st as (select job_id, case job_id % 5 when 0 then 'queued' when 1 then 'error' when 2 then 'paused' else 'done' end as status, case when job_id % 2 = 0 then 'page ' || job_id end as progress, case when job_id % 3 = 0 then 'broken' end as error
      from (select distinct job_id from f) where job_id % 11 <> 0),
    rs as (select id // 10 as job_id, id::varchar as stem, case when id % 4 = 0 then id || '.gz' end as bundle, case id % 3 when 0 then ' ' when 1 then source end as markdown from j where id % 5 <> 0)"""


def remote(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    j = jobs_of(spark, d).select("id", "name", "source").selectExpr("id div 10 as job_id", "cast(id as string) as stem", "coalesce(name, 'none') as slug", "(id div 10) % 9 = 0 as pulled", "id", "source")
    states = j.select("job_id").distinct().where("job_id % 11 <> 0").selectExpr(
        "job_id", "case job_id % 5 when 0 then 'queued' when 1 then 'error' when 2 then 'paused' else 'done' end as status", "case when job_id % 2 = 0 then 'page ' || job_id end as progress", "case when job_id % 3 = 0 then 'broken' end as error")
    results = j.where("id % 5 <> 0").selectExpr("job_id", "stem", "case when id % 4 = 0 then id || '.gz' end as bundle", "case id % 3 when 0 then ' ' when 1 then source end as markdown")
    return j.select("job_id", "stem", "slug", "pulled"), states, results


@register(f"with {_REMOTE} select job_id, stem, slug, bundle, markdown from f left join rs using (job_id, stem)")
def join_pull_results(spark: SparkSession, d: str) -> DataFrame:
    files, _, results = remote(spark, d)
    return jobs.pulled_results(files, results).select("job_id", "stem", "slug", "bundle", "markdown")


_TRIAGE = f"""with {_REMOTE}, t as (select f.job_id, stem, slug, bundle, case when trim(coalesce(markdown, '')) = '' then null else markdown end as markdown, status, progress, error, slug in (select slug from docs) as known
      from f left join rs using (job_id, stem) left join st using (job_id) where not pulled),
    o as (select *, case when status is null or status = 'error' then 'failed' when status <> 'done' then 'waiting' when known then 'skipped' when bundle is not null then 'bundle' when markdown is null then 'failed' else 'markdown' end as outcome from t)
    select job_id, stem, slug, outcome, case when status is null then 'no answer' when status = 'error' then coalesce(error, 'job error') when status = 'queued' then coalesce(progress, 'queued') when status <> 'done' then status
      when outcome = 'failed' then 'no OCR result for ' || stem when outcome = 'bundle' then bundle end as detail from o"""


@register(_TRIAGE)
def q_remote_pull(spark: SparkSession, d: str) -> DataFrame:
    return jobs.triage(*remote(spark, d), table(spark, d, "docs").select("slug"))


@register(f"with {_REMOTE} select job_id, stem, pulled or coalesce(status = 'done', false) as pulled from f left join st using (job_id)")
def q_pulled(spark: SparkSession, d: str) -> DataFrame:
    files, states, results = remote(spark, d)
    return jobs.after_pull(files, jobs.triage(files, states, results, table(spark, d, "docs").select("slug"))).select("job_id", "stem", "pulled")


@register(f"""with {_REMOTE}, k as (select doc, count(distinct chunk_id) as n from chunks group by doc), s as (select slug, arg_max(source, created_at) as source from docs group by slug)
    select 'docs' as part, slug as key, source as label, 'indexed' as status, null as progress, coalesce(n, 0) as chunks, null as error from s left join k on doc = slug
    union all select 'queue', id::varchar, label, status, coalesce(progress, ''), null, null from j where status in ('queued', 'processing')
    union all (select 'recent', id::varchar, label, status, null, chunks, nullif(error, '') from j where status in ('done', 'error') order by id desc limit 5)
    union all select 'remote', null, null, null, null, count(distinct job_id), null from f where not pulled having count(*) > 0""")
def prj_status(spark: SparkSession, d: str) -> DataFrame:
    return kb.overview(table(spark, d, "docs"), table(spark, d, "chunks"), jobs_of(spark, d), remote(spark, d)[0].select("job_id", "pulled"))


@register(f"""with {_JOBS} select id, label, nullif(name, '') as name, source, reindex, case when status = 'processing' or status = 'error' and coalesce({_RETRY}, false) then 'queued' else status end as status,
    coalesce(progress, case when status in ('queued', 'processing') or status = 'error' and coalesce({_RETRY}, false) then 'queued (migrated)' else '' end) as progress, chunks, nullif(error, '') as error, coalesce(attempts, 0) as attempts,
    to_timestamp(epoch_ms(created_at) // 1000) at time zone 'UTC' as created_at from j""")
def src_legacy_queue(spark: SparkSession, d: str) -> DataFrame:
    """The queue's rows as entries of the old file, and back."""
    rows = jobs_of(spark, d).select("id", "label", "name", "source", "reindex", "status", "progress", "chunks", "error", "attempts", (F.unix_seconds(F.col("created_at").cast("timestamp")) * 1000).alias("queuedAt"))
    text = rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "true"}).alias("j")).select(F.from_json("j", jobs.LEGACY).alias("e")).select("e.*")
    out = jobs.legacy_jobs(text, F.lit(_NOW).cast("timestamp"))
    return out.select("id", "label", "name", "source", "reindex", "status", "progress", "chunks", "error", "attempts", F.col("created_at").cast("timestamp_ntz").alias("created_at"))
