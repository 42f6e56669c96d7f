from datetime import datetime

from pyspark.sql import functions as F

from marlstone.llm import language as lg

EN = "The layers of the river were measured again. It is not clear that the results from the second part are larger. However, this is what we expected before."
DE = "Die Schichten des Flusses wurden noch einmal gemessen. Es ist nicht klar, ob die Ergebnisse aus dem zweiten Teil größer sind. Das ist aber, was wir vorher erwartet haben."
FR = "Les couches de la rivière ont été mesurées encore une fois. Nous ne savons pas si les résultats de la deuxième partie sont plus grands. C'est pourtant ce que nous attendions."


def tables(spark, extra=()):
    docs = [(f"{k}{i}", "h", k, datetime(2024, 1, 2)) for k in ("en", "de", "fr") for i in range(6)]
    docs += [("mislabelled", "h", "en", datetime(2024, 1, 2)), ("mislabelled", "h", "de", datetime(2023, 1, 2)), ("unlabelled", "h", None, datetime(2024, 1, 1)), ("empty", "h", "en", datetime(2024, 1, 1))]
    texts = {"en": EN, "de": DE, "fr": FR}
    chunks = [(n, f"{k}{i}", "(preamble)", texts[k]) for n, (k, i) in enumerate((k, i) for k in texts for i in range(6))]
    chunks += [(100, "mislabelled", "", DE), (101, "unlabelled", "", FR), (102, "en0", "", EN + " " + DE), (103, "en1", "", None), (104, "en1", "", ""), (105, "en1", "", "| 1 | 2 |"), (102, "en0", "", EN + " " + DE), *extra]
    return spark.createDataFrame(docs, "slug string, hash string, lang string, created_at timestamp"), spark.createDataFrame(chunks, "chunk_id bigint, doc string, section string, text string")


def test_label_notations(spark):
    rows = [("en", "en"), (" EN ", "en"), ("en_US", "en"), ("pt-BR", "pt"), ("ger", "de"), ("deu", "de"), ("German", "de"), ("xx", None), ("und", None), ("", None), (None, None), ("english language", None), ("dut", "nl")]
    got = spark.createDataFrame(rows, "a string, want string").withColumn("got", lg.label_language(F.col("a"))).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_documents_and_passages(spark):
    docs, passages = lg.languages(*tables(spark))
    d = {r.doc: r for r in docs.collect()}
    assert d["mislabelled"].lang == "de" and d["mislabelled"].named == "en"
    assert d["unlabelled"].lang == "fr" and d["unlabelled"].named is None
    assert d["empty"].lang is None
    assert all(d[f"{k}{i}"].lang == k for k in ("en", "de", "fr") for i in range(6))
    other = [r for r in passages.collect() if r.lang and r.main and r.lang != r.main]
    assert [(r.chunk_id, r.lang, r.sentences) for r in other] == [(102, "de", 3)]
    assert all(0 <= r.confidence <= 1 for r in other)


def test_sentences_cover_a_text():
    for text in (EN, DE + "\n\n" + FR, "", "x", "a. B. C.", "Long " * 5000):
        spans = lg.sentences(text)
        assert "".join(text[a:b] for a, b in spans) == text


def test_narrow_margins_have_no_language(spark):
    model = lg.Classifier(lg.dictionaries(lg.clean_sample([("en", EN), ("de", DE), ("fr", FR)])))
    assert all(r[4] is None for r in model.runs("Zkthr Pqwv Brtl Mnop Xyzq"))
    assert model.runs("") == [] and model.runs("12 34 56") == []


def test_empty_tables(spark):
    docs, chunks = tables(spark)
    d, p = lg.languages(docs.where("false"), chunks.where("false"))
    assert d.count() == 0 and p.count() == 0


def test_likely_dictionaries_give_what_all_give():
    samples = {"en": [EN.lower()] * 3, "de": [DE.lower()] * 3, "fr": [FR.lower()] * 3}
    model = lg.Classifier(lg.dictionaries(samples))
    text = " ".join([EN, DE, EN, FR, "Xyz abc qrs tuv. ", DE])
    got = model.runs(text)
    model.likely_sizes = lambda s, words, before: model.sizes(s)
    model._kept.clear()
    want = model.runs(text)
    assert [r[:5] for r in got] == [r[:5] for r in want] and {r[4] for r in got} >= {"en", "de", "fr"}
