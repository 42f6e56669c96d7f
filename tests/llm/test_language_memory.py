import tracemalloc

from test_language import tables

from marlstone.llm import language as lg
from marlstone.llm.wordlists import COMMON_WORDS
from marlstone.session import sent_if_small


def test_the_sample_takes_little_more_than_its_texts():
    """Words held as strings took a multiple of the driver's share for long chunks."""
    words = {k: v.split() for k, v in COMMON_WORDS.items()}
    rows = [(k, " ".join(f"{w[(i * 7 + j) % len(w)].capitalize()} {w[j % len(w)]} {w[(j + i) % len(w)]} x{j % 50} {w[(3 * j) % len(w)]} y{i}." for j in range(400))) for i in range(8) for k, w in words.items()]
    size = sum(len(t) for _, t in rows)
    tracemalloc.start()
    out = lg.clean_sample(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(map(len, out.values())) > 1000
    assert peak < 12 * size


def test_documents_are_sent_by_their_number_only(spark, monkeypatch):
    """Spark took the salted documents for as small as their compressed files, and the driver held them 16 times."""
    docs, chunks = tables(spark)
    few = lg.languages(docs, chunks)
    assert "Generate" not in few[1]._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(lg, "sent_if_small", lambda df, name: sent_if_small(df, 5, name), raising=False)
    many = lg.languages(docs, chunks)
    for a, b in zip(few, many):
        assert "Broadcast" not in b._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, a.select(sorted(a.columns)).collect())) == sorted(map(str, b.select(sorted(b.columns)).collect())) != []
