import json
import os
import urllib.error

import pytest
from pyspark.sql import functions as F

from marlstone import session
from marlstone.operators import biblio, jobs
from marlstone.sources import connectors as cn


def test_evaluation_files(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"_id": "1", "title": "T", "text": "body"}\n{"_id": "2", "text": "only"}\n')
    (tmp_path / "q.tsv").write_text("query-id\tcorpus-id\tscore\nq1\t1\t2\n")
    assert {(r.doc_id, r.text) for r in cn.read_jsonl_corpus(spark, str(tmp_path / "c.jsonl")).collect()} == {("1", "T body"), ("2", "only")}
    assert [tuple(r) for r in cn.read_qrels(spark, str(tmp_path / "q.tsv")).collect()] == [("q1", "1", 2)]


def kb(spark):
    return {
        "docs": spark.createDataFrame([("A", "s")], "slug string, source string"),
        "chunks": spark.createDataFrame([(1, "A")], "chunk_id bigint, doc string"),
        "vec_chunks": spark.createDataFrame([(1, [1.0])], "chunk_id bigint, embedding array<float>"),
        "sparse_terms": spark.createDataFrame([(1, "t", 1.0)], "chunk_id bigint, term string, weight double"),
    }


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "s")
    told = cn.write_snapshot(kb(spark), path, "v1")
    assert (told["docs"], told["chunks"]) == (1, 1) and told["bytes"] > 0 and told["dest"] == f"{path}/v1"
    assert cn.read_snapshot(spark, path)["chunks"].count() == 1
    two = kb(spark)
    two["chunks"] = two["chunks"].union(spark.createDataFrame([(2, "A")], "chunk_id bigint, doc string"))
    cn.write_snapshot(two, path, "v2", codec="gzip")
    assert cn.read_snapshot(spark, path)["chunks"].count() == 2 and cn.read_snapshot(spark, path, "v1")["chunks"].count() == 1
    with pytest.raises(ValueError, match="elsewhere"):
        cn.write_snapshot(two, f"file://{path}/", "v3", live=path)
    import shutil

    shutil.rmtree(f"{path}/v2/vec_chunks")
    with pytest.raises(ValueError, match="vec_chunks"):
        cn.read_snapshot(spark, path)


def test_bundles(spark, tmp_path):
    whole = kb(spark)
    whole["docs"] = whole["docs"].union(spark.createDataFrame([("B", "t"), ("C", "u")], "slug string, source string"))
    whole["chunks"] = whole["chunks"].union(spark.createDataFrame([(2, "B"), (3, "C")], "chunk_id bigint, doc string"))
    cn.write_bundles(whole, spark.createDataFrame([("A",), ("B",), ("none",)], "slug string"), str(tmp_path / "b"))
    a = cn.read_bundle(spark, str(tmp_path / "b"), "A")
    assert [r.source for r in a["docs"].collect()] == ["s"] and [(r.chunk_id, r.doc) for r in a["chunks"].collect()] == [(1, "A")]
    assert a["vec_chunks"].count() == 1 and cn.read_bundle(spark, str(tmp_path / "b"), "B")["sparse_terms"].count() == 0
    assert cn.read_bundle(spark, str(tmp_path / "b"), "C")["chunks"].count() == 0


def test_old_queue_file(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps([{"id": 1, "status": "processing", "queuedAt": 1000}, {"id": 2, "status": "error", "error": "HTTP 503"}, {"id": 3, "status": "error", "error": "no such file", "name": ""}]))
    got = {r.id: (r.label, r.name, r.status, r.progress, r.attempts) for r in jobs.legacy_jobs(cn.read_legacy_queue(spark, str(tmp_path / "q.json")), F.current_timestamp()).collect()}
    assert got == {1: ("job", None, "queued", "queued (migrated)", 0), 2: ("job", None, "queued", "queued (migrated)", 0), 3: ("job", None, "error", "", 0)}
    assert cn.read_legacy_queue(spark, str(tmp_path / "none.json")).count() == 0


def test_stages_resume(spark, tmp_path):
    calls = []

    def slow():
        calls.append(1)
        return spark.createDataFrame([(len(calls),)], "n int")

    path = str(tmp_path / "stage")
    assert [session.stage(spark, path, slow).first().n for _ in range(2)] == [1, 1] and len(calls) == 1
    assert session.stage(spark, path, slow, redo=True).first().n == 2
    (tmp_path / "stage" / "_SUCCESS").unlink()  # a broken attempt is no result
    assert session.stage(spark, path, slow).first().n == 3
    session.drop_stage(spark, path)
    assert session.stage(spark, path, slow).first().n == 4


def test_steps_are_shared_and_cleared(spark, monkeypatch):
    rows = session.durable(spark.range(3).toDF("id"), "rows")
    assert rows.count() == 3
    place = rows.inputFiles()[0].removeprefix("file:").replace("///", "/").rsplit("/", 2)[0]
    session.clear(spark)
    assert not os.path.exists(place)

    class Remote:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"

            class _jsc:
                sc = staticmethod(lambda: type("S", (), {"getCheckpointDir": staticmethod(lambda: type("N", (), {"isDefined": staticmethod(lambda: False)}))}))

            getConf = staticmethod(dict)

    with pytest.raises(RuntimeError, match="share no folder"):
        session.shared_dir(Remote)


def test_extractor_and_encoder(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ftwo")
    (tmp_path / "b.txt").write_text("bad")

    def extract(path, content):
        if content == b"bad":
            raise OSError("unreadable")
        return list(enumerate(content.decode().split("\f"), 1))

    got = {(r.path.rsplit("/")[-1], r.page, r.text) for r in cn.read_pages(spark, str(tmp_path), extract, attempts=1).collect()}
    assert got == {("a.txt", 1, "one"), ("a.txt", 2, "two"), ("b.txt", None, "unreadable")}

    def encode(texts):
        return [[float(len(t)), 1.0] for t in texts], [{w: 1.0 for w in t.split()} for t in texts]

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["a b", None, "c"])], "chunk_id bigint, text string")
    e = cn.encode(rows, encode, batch=2)
    assert {(r.chunk_id, tuple(r.embedding)) for r in e.collect()} == {(0, (3.0, 1.0)), (1, (0.0, 1.0)), (2, (1.0, 1.0))}
    assert {(r.chunk_id, r.term) for r in cn.sparse_rows(e).collect()} == {(0, "a"), (0, "b"), (2, "c")}
    q = cn.encode_query(rows, encode, 2)
    assert q.where("embedding is not null").count() == 3 and cn.encode_query(rows, encode, 3).where("embedding is not null").count() == 0

    def down(texts):
        raise OSError("down")

    assert [(r.embedding, r.weights) for r in cn.encode_query(rows.limit(1), down, 2).select("embedding", "weights").collect()] == [(None, {})]


def test_block_trees(spark):
    tree = {"id": "/page/1/Doc/0", "children": [{"id": "/page/1/Text/1", "html": "<p>b</p>"}, {"id": "/page/0/Group/2", "html": "<content-ref src='x'></content-ref>", "children": [{"id": "none", "html": "<b>a</b>"}]}]}
    df = spark.createDataFrame([("d", json.dumps(tree)), ("e", None)], "doc string, tree string")
    pages = {(r.doc, r.page): r.text for r in cn.page_markdown(cn.block_leaves(df)).collect()}
    assert pages == {("d", 1): "**a**", ("d", 2): "b"}
    assert [(r.page, r.ordinal, r.html) for r in cn.block_leaves(df).orderBy("ordinal").collect()] == [(2, 0, "<p>b</p>"), (1, 1, "<b>a</b>")]


def test_retries():
    calls = []

    def opener(url, timeout):
        calls.append(url)
        if len(calls) < 3:
            raise urllib.error.HTTPError(url, 429, "slow down", {}, None)
        import io

        return io.BytesIO(b'{"a": 1}')

    assert cn.fetch_json("http://x", opener=opener, slow=0, fast=0) == {"a": 1} and len(calls) == 3
    with pytest.raises(ZeroDivisionError):
        cn.retry(lambda: 1 / 0, 2, lambda n: 0)


def test_pending(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps([{"job_id": "j", "createdAt": "t", "files": [{"stem": "a", "slug": "A"}, {"stem": "b", "slug": "B"}]}]))
    assert {(r.job_id, r.stem, r.pulled) for r in cn.read_pending(spark, str(tmp_path / "p.json")).collect()} == {("j", "a", False), ("j", "b", False)}
    assert cn.read_pending(spark, str(tmp_path / "missing.json")).count() == 0
    (tmp_path / "broken.json").write_text("{not json")
    assert cn.read_pending(spark, str(tmp_path / "broken.json")).count() == 0


def paper(spark, f, doc):
    return spark.createDataFrame([(json.dumps(doc),)], "j string").select(f(F.col("j")).alias("p")).select("p.*").first()


def test_papers(spark):
    p = paper(spark, biblio.semantic_paper, {"paperId": "x", "title": "T", "year": 2020, "venue": "V", "authors": [{"name": f"N{i}"} for i in range(20)], "externalIds": {"DOI": "10.1/a"}, "abstract": "z" * 3000, "openAccessPdf": {"url": "u"}})
    assert (p.paperId, p.venue, len(p.authors), p.doi, p.arxiv, len(p.abstract), p.openAccessPdf, p.tldr) == ("x", "V", 12, "10.1/a", None, 2500, "u", None)
    w = paper(spark, biblio.crossref_paper, {"title": ["T"], "issued": {"date-parts": [[2019, 1]]}, "author": [{"given": "A", "family": "B"}, {"family": "C"}], "DOI": "10.1/b", "abstract": "<p>x &amp; y</p>"})
    assert (w.title, w.year, w.authors, w.url, w.abstract) == ("T", 2019, ["A B", "C"], "https://doi.org/10.1/b", "x & y")
    r = paper(spark, biblio.crossref_reference, {"unstructured": "q" * 300, "year": "1999", "author": "Z"})
    assert (len(r.title), r.year, r.authors, r.doi, r.citationText) == (200, 1999, ["Z"], None, "q" * 300)
    u = paper(spark, biblio.unpaywall, {"doi": "10.1/c", "is_oa": True, "best_oa_location": {"url": "page"}})
    assert (u.doi, u.is_oa, u.pdf) == ("10.1/c", True, "page")
    e = paper(spark, biblio.semantic_paper, {})
    assert e.authors == [] and e.abstract is None


def test_edges_and_candidates(spark):
    df = spark.createDataFrame([("p", ["a", "b", "c"])], "id string, others array<string>")
    assert {(r.src, r.dst) for r in biblio.citation_edges(df, "id", "others", "citations", 2).collect()} == {("a", "p"), ("b", "p")}
    assert biblio.citation_edges(df, "id", "others", "references", 99).where("src = 'p'").count() == 3
    r = spark.createDataFrame([("d", "x", "2001.1", ["x", "y"], None)], "doi string, best_pdf string, arxiv string, other_pdfs array<string>, s2_pdf string")
    assert [(c.url, c.priority) for c in biblio.pdf_candidates(r).orderBy("priority").collect()] == [("x", 1), ("https://arxiv.org/pdf/2001.1", 2), ("y", 3)]
    b = spark.createDataFrame([(b"%PDF-" + b"x" * 1100,), (b"%PDF-",), (b"x" * 2000,)], "c binary")
    assert [x.ok for x in b.select(biblio.looks_like_pdf(F.col("c")).alias("ok")).collect()] == [True, False, False]


def test_more_addresses(spark):
    r = spark.createDataFrame([("d", None, None, None, "s", "2001.2", "PMC7")], "doi string, best_pdf string, arxiv string, other_pdfs array<string>, s2_pdf string, s2_arxiv string, pmcid string")
    got = [c.url for c in biblio.pdf_candidates(r).orderBy("priority").collect()]
    assert got == ["s", "https://arxiv.org/pdf/2001.2", "https://europepmc.org/articles/PMC7?pdf=render", "https://pmc.ncbi.nlm.nih.gov/articles/PMC7/pdf/"]


def test_cited_authors(spark):
    for author, want in (("Z", ["Z"]), (None, []), (["A", {"family": "B", "given": "x"}, {"name": "C", "family": "D"}, {}], ["A", "B", "C", ""])):
        assert paper(spark, biblio.crossref_reference, {"author": author} if author else {}).authors == want


def test_search_falls_back(spark):
    one = json.dumps({"data": [{"paperId": f"p{i}", "title": "T"} for i in range(9)], "total": 70})
    two = json.dumps({"message": {"items": [{"DOI": "10.1/x", "title": ["U"]}]}})
    df = spark.createDataFrame([("a", one, two), ("b", None, two), ("c", None, None)], "query string, first string, second string")
    rows = biblio.search_results(df, 5).collect()
    assert [(r.query, r.source, r.total, r.rank, r.paperId) for r in rows if r.query == "a"] == [("a", "semantic_scholar", 70, i + 1, f"p{i}") for i in range(5)]
    assert [(r.query, r.source, r.total, r.title, r.url) for r in rows if r.query != "a"] == [("b", "crossref", 1, "U", "https://doi.org/10.1/x")]
    assert biblio.search_results(df, 99).where("query = 'a'").count() == 9


def test_links_fall_back(spark):
    one = json.dumps({"data": [{"citingPaper": {"paperId": "q"}}, {"citedPaper": {"paperId": "r"}}]})
    two = json.dumps({"message": {"reference": [{"DOI": "10.1/y", "author": "N"}, {"unstructured": "u"}]}})
    df = spark.createDataFrame([("x", one, two), ("10.1000/z", None, two), ("no doi", None, two)], "paper string, first string, second string")
    assert [(r.paper, r.source, r.rank, r.paperId) for r in biblio.linked_papers(df).collect()] == [("x", "semantic_scholar", 1, "q"), ("x", "semantic_scholar", 2, "r")]
    got = [(r.paper, r.source, r.doi, r.title) for r in biblio.linked_papers(df, "references", 9).where("paper <> 'x'").orderBy("rank").collect()]
    assert got == [("10.1000/z", "crossref", "10.1/y", None), ("10.1000/z", "crossref", None, "u")]
