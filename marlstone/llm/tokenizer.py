"""Encoding a corpus with a public byte-level tokenizer, by forced-boundary splitting.

A pair of neighbouring bytes that occurs inside no token of the vocabulary marks a certain cut: no merge
can cross it, so the two sides can be encoded by themselves and their ids put one after the other.
A cut must also leave the pre-tokenizer's pieces as they are. It does, wherever the pair stands, if
(a) the second byte is ASCII white space and the first is not, or
(b) neither belongs to white space and the second begins a character other than an apostrophe: inside a run of letters, digits or
signs both sides are runs of their own, and between two runs there is a piece's end anyway. (An apostrophe could begin a
contraction on the right side only.) Bytes that white space beyond ASCII may contain are left alone.
So every pair of this kind is cut. What remains are mostly single words with the blank before them, or parts of words and
signs. A batch's distinct fragments are encoded once each, and kept for later batches; the ids of the texts are gathered from them as arrays.

A map-only step: no shuffle. The vocabulary (its size is fixed by the tokenizer, and checked) is
read by the driver from a path that is a parameter, and broadcast.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOLDER = "/opt/tokenizers"
# fixed value: the pre-tokenizer's pattern of the byte_bpe vocabularies
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEPT_FRAGMENTS = 1 << 19
SLICE_BYTES = 8 << 20
MAX_VOCABULARY_BYTES = 64 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
# bytes at which no cut of kind (b) begins: white space, continuations that end white space beyond ASCII (U+0085, A0, 1680, 2000-200A, 2028, 2029, 202F, 205F, 3000)
_NO_LEFT = _SPACE.copy()
_NO_LEFT[[*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF, *range(28, 32)]] = True
# and before which none is made: continuations, leads of such white space, control separators, the apostrophe
_NO_RIGHT = _SPACE.copy()
_NO_RIGHT[[*range(0x80, 0xC0), 0xC2, 0xE1, 0xE2, 0xE3, *range(28, 32), 39]] = True


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than a vocabulary may be")
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}


def inner_pairs(ranks: dict[bytes, int]) -> np.ndarray:
    """256 x 256: whether a pair of bytes occurs inside any token."""
    seen = np.zeros((256, 256), bool)
    for token in ranks:
        if len(token) > 1:
            t = np.frombuffer(token, np.uint8)
            seen[t[:-1], t[1:]] = True
    return seen


class ForcedBoundaryEncoder:
    """Encodes arrays of texts; keeps the ids of up to KEPT_FRAGMENTS fragments."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import tiktoken

        self._plain = tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        never = ~inner_pairs(ranks)
        self._at_space = never & ~_SPACE[:, None] & _SPACE[None, :]
        self._cut = self._at_space | never & ~_NO_LEFT[:, None] & ~_NO_RIGHT[None, :]
        self._kept: dict[bytes, list[int]] = {}

    def _fragment(self, fragment: bytes) -> list[int]:
        return self._plain.encode_ordinary(fragment.decode("utf-8"))

    def _slice(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts data[starts[i]:starts[i+1]], and where each text's ids begin."""
        edge = np.zeros(len(data) + 1, bool)
        edge[1:-1] = self._cut[data[:-1], data[1:]]
        edge[starts] = True
        edges = np.flatnonzero(edge).astype(np.int32)
        n = len(edges) - 1
        if n < 1:
            return np.empty(0, np.int32), np.zeros(len(starts), np.int64)
        fragments = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(edges), pa.py_buffer(data)]).dictionary_encode()
        if len(self._kept) > KEPT_FRAGMENTS:
            self._kept.clear()
        kept, ids = self._kept, []
        for f in fragments.dictionary.to_pylist():
            got = kept.get(f)
            if got is None:
                got = kept[f] = self._fragment(f)
            ids.append(got)
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        begin = np.concatenate(([0], np.cumsum(size)[:-1]))
        which = fragments.indices.to_numpy()
        length = size[which]
        ends = np.cumsum(length)
        flat = np.fromiter(chain.from_iterable(ids), np.int32, int(size.sum()))
        out = flat[np.repeat(begin[which] - (ends - length), length) + np.arange(ends[-1])]
        return out, np.concatenate(([0], ends))[np.searchsorted(edges, starts)]

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """Lists of ids; nulls and empty texts give empty lists."""
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
        values, lengths, i = [], [], 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, "right")) - 1)
            j = min(j, len(texts))
            part = np.ascontiguousarray(data[offsets[i] : offsets[j]])
            ids, begin = self._slice(part, offsets[i : j + 1] - offsets[i]) if len(part) else (np.empty(0, np.int32), np.zeros(j - i + 1, np.int64))
            values.append(ids)
            lengths.append(np.diff(begin))
            i = j
        ends = np.concatenate([[0], *lengths]).cumsum().astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *values])))


def encode_corpus(documents: DataFrame, keep: list[str], text: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = FOLDER, out: str = "ids") -> DataFrame:
    """The columns of `keep`, and `out`: the ids of the text without special tokens, one row for each row.

    Null and empty texts give an empty list; strings that look like special tokens are ordinary text.
    """
    ranks = read_ranks(f"{folder}/{vocabulary}.tiktoken")
    shipped = documents.sparkSession.sparkContext.broadcast(ranks)
    source = documents.select(*keep, F.col(text).alias("_text"))
    schema = documents.select(*keep, F.lit(None).cast("array<int>").alias(out)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ForcedBoundaryEncoder(shipped.value)
        for batch in batches:
            ids = encoder.encode(batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids], [*keep, out])

    return source.mapInArrow(run, schema)
