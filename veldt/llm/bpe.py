"""Byte-level BPE by a sentencepiece model written straight from a rank file.

Each vocabulary entry becomes one piece: its bytes mapped to printable characters, its score the negative
rank, identity normalisation. Pre-tokens are encoded one by one and ids go back to bytes by the inverse map.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from veldt.llm.common import bound_batches, texts

#: Pre-tokens remembered by one worker, and the longest that is; beyond, the memory starts afresh.
CACHE, CACHE_CHARS = 1 << 18, 48
#: Pre-tokens encoded at a time.
BLOCK = 1 << 14
#: A letter that no byte maps to.
APART = "\u241f"


def byte_letters() -> list[str]:
    """A printable character for each byte: itself where printable, else the next free one from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _field(number: int, value) -> bytes:
    """One protobuf field: int as varint, float as fixed32, bytes and str with their length."""
    import struct

    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    value = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece model; piece 0 is the unknown piece it must have, piece i+1 the i-th rank in order."""
    letters = byte_letters()
    out = [_field(1, _field(1, "<unk>") + _field(2, 0.0) + _field(3, 2))]
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        out.append(_field(1, _field(1, "".join(letters[b] for b in token)) + _field(2, float(-rank)) + _field(3, 1)))
    trainer = _field(3, 2) + _field(4, len(ranks) + 1) + _field(40, 0) + _field(41, -1 & (1 << 64) - 1) + _field(42, -1 & (1 << 64) - 1) + _field(43, -1 & (1 << 64) - 1)
    normal = _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(out) + _field(2, trainer) + _field(3, normal)


class Codec:
    """Encodes and decodes with the ranks in a rank file and a pre-token pattern."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.by_place = np.array([0, *sorted(self.ranks.values())], np.int64)
        self.bytes_of = {r: t for t, r in self.ranks.items()}
        self.letters = dict(enumerate(byte_letters()))
        self.find = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(self.ranks))
        self.cache: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of new pre-tokens. They go to the model in one call, held apart by a letter of no piece, over which nothing merges."""
        out, spelled, names = {}, [], []
        for word in words:
            raw = word.encode()
            if (whole := self.ranks.get(raw)) is not None:
                out[word] = whole.to_bytes(4, "little")
            else:
                names.append(word)
                spelled.append(raw.decode("latin-1").translate(self.letters))
        if names:
            places = np.array(self.model.encode(APART.join(spelled)), np.int64)
            ids, cuts = self.by_place[places].astype("<u4"), np.flatnonzero(places == 0).tolist()
            for word, start, end in zip(names, [0, *[c + 1 for c in cuts]], [*cuts, len(ids)], strict=True):
                out[word] = ids[start:end].tobytes()
        return out

    def encode(self, text: str) -> Iterator[bytes]:
        """The ids of text as little-endian 32-bit integers, in blocks of bounded length."""
        cache = self.cache
        words = self.find(text)
        for at in range(0, len(words), BLOCK):
            block = words[at : at + BLOCK]
            missing = [w for w in {*block} if w not in cache]
            new = self._learn(missing) if missing else {}
            if len(cache) + len(new) > CACHE:
                new |= {w: cache[w] for w in {*block} if w in cache}
                cache.clear()
            if len(new) <= CACHE:
                cache.update({w: x for w, x in new.items() if len(w) <= CACHE_CHARS})
            yield b"".join([cache[w] if w in cache else new[w] for w in block])

    def decode(self, ids: bytes) -> bytes:
        get = self.bytes_of
        return b"".join([get[i] for i in np.frombuffer(ids, "<u4").tolist()])


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode_table(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>): token ids of every whole text. Null and empty texts have no ids."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            for i, t in zip(b.column(0), b.column(1), strict=True):
                ids = np.frombuffer(b"".join(c.encode(t.as_py())), "<i4")
                yield pa.RecordBatch.from_arrays([pa.array([i.as_py()], pa.int64()), pa.array([ids], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return texts(df, key, text).mapInArrow(run, "doc_id long, ids array<int>")


def decode_table(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids): the inverse of encode_table."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            text = [c.decode(np.array(x or [], "<u4").tobytes()).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], ["doc_id", "text"])

    return df.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (ids as little-endian 32-bit), decoded_sha256 (bytes decoded from those ids).

    A null text counts as empty: no tokens, digests of nothing. Repeated rows and null ids give a row each; an
    empty table gives no rows; other columns are not read. No shuffle; a worker holds one batch and one cache.
    """
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            n, ids_hex, text_hex = [], [], []
            for t in b.column(1):
                ids_sha, text_sha, count = hashlib.sha256(), hashlib.sha256(), 0
                for block in c.encode(t.as_py()):
                    count += len(block) // 4
                    ids_sha.update(block)
                    text_sha.update(c.decode(block))
                n.append(count)
                ids_hex.append(ids_sha.hexdigest())
                text_hex.append(text_sha.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(df, key, text).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document's ids and of the bytes decoded from them; see round_trip() for nulls and repeats."""
    import public_tokenizers

    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
