import os

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.llm import tokenizer as tz

pytestmark = pytest.mark.skipif(not os.path.exists(f"{tz.FOLDER}/byte_bpe_50k.tiktoken"), reason="no vocabulary files here")


@pytest.fixture(scope="module")
def encoder():
    return tz.ForcedBoundaryEncoder(tz.read_ranks(f"{tz.FOLDER}/byte_bpe_50k.tiktoken"))


def whole(encoder, text):
    return encoder._plain.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=80), st.text(alphabet="ab 'sre\n\t\r   éqzQXJ0!.-漢", max_size=120)), max_size=6))
def test_as_the_plain_encoder(texts):
    e = _shared()
    assert e.encode(pa.array(texts, pa.string())).to_pylist() == [whole(e, t) if t else [] for t in texts]


_kept = []


def _shared():
    if not _kept:
        _kept.append(tz.ForcedBoundaryEncoder(tz.read_ranks(f"{tz.FOLDER}/byte_bpe_50k.tiktoken")))
    return _kept[0]


def test_as_the_other_library(encoder):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tz.FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    texts = ["Hello, world!  It's\n\n  me. <|endoftext|>", "naïve café — 你好 \U0001f600", "x" * 500 + "qz" * 90]
    assert encoder.encode(pa.array(texts)).to_pylist() == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_slices_and_offsets(encoder, monkeypatch):
    monkeypatch.setattr(tz, "SLICE_BYTES", 64)
    texts = [f"text number {i} " * (i % 7) for i in range(50)] + [None, ""]
    array = pa.array(["skipped", *texts]).slice(1)
    assert encoder.encode(array).to_pylist() == [whole(encoder, t) if t else [] for t in texts]


def test_rows(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (2, None, "x"), (3, "", "x"), (1, "a b", "x")], "doc_id bigint, text string, ids string")
    got = sorted((r.doc_id, list(r.ids)) for r in tz.encode_corpus(df, ["doc_id"]).collect())
    assert got == [(1, [64, 275]), (1, [64, 275]), (2, []), (3, [])]
    assert tz.encode_corpus(df.where("false"), ["doc_id"]).count() == 0


def test_certain_cuts_are_certain(encoder):
    ranks = tz.read_ranks(f"{tz.FOLDER}/byte_bpe_50k.tiktoken")
    seen = tz.inner_pairs(ranks)
    assert not any(seen[t[i], t[i + 1]] is False for t in list(ranks)[:5000] for i in range(len(t) - 1))
    assert encoder._at_space[ord("e"), ord(" ")] and not encoder._at_space[ord(" "), ord(" ")]
    # wherever a pair may be cut: between letters, at signs, between characters beyond ASCII; not before an apostrophe or beside white space
    assert all(encoder._cut[ord(a), ord(b)] for a, b in ("qz", "e,", "a9", ".9")) and not encoder._cut[:, ord("'")].any()
    assert encoder._cut[ord("q"), 0xC3] and not encoder._cut[:, 0x80:0xC0].any() and not encoder._cut[:, 0xE2].any() and not (encoder._cut & ~encoder._at_space)[0xA0].any()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="absdtmlverXQz09'’\"!?.,-_–—(){} \t\n\r\x1c\x85\xa0\u1680\u2003\u2028\u202f\u205f\u3000\u200b\xadéßżпр你̈½²\x00\U0001f642", max_size=60), max_size=6))
def test_cuts_leave_the_pieces_as_they_are(texts):
    e = _shared()
    assert e.encode(pa.array(texts, pa.string())).to_pylist() == [whole(e, t) if t else [] for t in texts]
