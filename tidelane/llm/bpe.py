"""Byte-level BPE encoding and decoding.

Encoding pushes every mergeable neighbour pair of a piece on a heap keyed by (merge rank,
position); symbols sit in a doubly linked list, and a popped entry whose symbols have
changed since it was pushed is stale and skipped.  Decoding concatenates the vocabulary's
strings.  The tokenizer file is only read; nothing is trained here.

Defined cases: null and empty texts have no tokens and decode to ''.  Repeated rows are
encoded once each.  Other columns pass through untouched; ``token_ids`` and ``decoded``
replace columns of those names.  Invalid UTF-8 is read with replacement characters.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelane.llm.bytetext import any_names, blocks, releasing, small_batches

#: The byte-level pre-tokenisation pattern of the public vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: The same pieces of a text that is ASCII alone, found by ``re`` in less time.
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ \t-\rA-Za-z0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+"

#: Pieces remembered by a task, and the longest piece that is remembered.
CACHE_PIECES, CACHE_CHARS = 200_000, 48


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte: itself where printable, else the next free code point from 256."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(other)}


class _Cache(dict):
    def __init__(self, make):
        self.make = make

    def __missing__(self, piece: str) -> bytes:
        got = self.make(piece)
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = got
        return got


class Codec:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        to_byte = byte_alphabet()
        specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = [b""] * (max([*vocab.values(), *specials.values()]) + 1)
        for token, i in (vocab | specials).items():
            self.strings[i] = bytes(to_byte[c] for c in token)
        single = {b: vocab[c] for c, b in to_byte.items()}
        self.single = [single[b] for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[left], vocab[right]] = (rank, vocab[left + right])
        self.specials = specials
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(specials, key=len, reverse=True)) + ")") if specials else None
        wide, narrow = regex.compile(PATTERN).findall, re.compile(ASCII_PATTERN).findall
        self.pieces = lambda text: narrow(text) if text.isascii() else wide(text)
        self.cache = _Cache(lambda piece: array("i", self.merge(piece.encode())).tobytes())

    def merge(self, piece: bytes) -> list[int]:
        """Token ids of one piece."""
        symbol = [self.single[b] for b in piece]
        n = len(symbol)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        merges = self.merges
        heap = [(*found, i, symbol[i], symbol[i + 1]) for i in range(n - 1) if (found := merges.get((symbol[i], symbol[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, merged, i, a, b = heapq.heappop(heap)
            j = right[i] if symbol[i] == a else n
            if j >= n or symbol[j] != b:
                continue  # stale: one of the two symbols has been merged meanwhile
            symbol[i], symbol[j] = merged, -1
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                if found := merges.get((merged, symbol[k])):
                    heapq.heappush(heap, (*found, i, merged, symbol[k]))
            h = left[i]
            if h >= 0 and (found := merges.get((symbol[h], merged))):
                heapq.heappush(heap, (*found, h, symbol[h], merged))
        return [s for s in symbol if s >= 0]

    def encode(self, text: str) -> bytes:
        """Token ids of a text as packed 32-bit integers."""
        get = self.cache.__getitem__
        if self.cut is None or not any(s in text for s in self.specials):
            return b"".join(map(get, self.pieces(text)))
        out = []
        for part in self.cut.split(text):
            if part in self.specials:
                out.append(array("i", [self.specials[part]]).tobytes())
            else:
                out.extend(map(get, self.pieces(part)))
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.strings[i] for i in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


@any_names("token_ids", "decoded")
def encode_documents(docs: DataFrame, tokenizer: str | None = None, text: str = "text") -> DataFrame:
    """``docs`` with ``token_ids`` array<int> and ``decoded`` string (the ids decoded again).

    One pass, no shuffle; each task holds one block of rows and a bounded piece cache.
    ``tokenizer`` is a path that every executor can read (default: the public vocabulary).
    """
    small_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c not in ("token_ids", "decoded")]
    at = keep.index(text)
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer or default_tokenizer())
        for batch in blocks(batches, text):
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            packed = [own.encode((t or b"").decode("utf-8", "replace")) for t in texts]
            ids = np.frombuffer(b"".join(packed), np.int32)
            ends = np.cumsum([0, *(len(p) // 4 for p in packed)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))
            decoded = pa.array([own.decode(array("i", p).tolist()) for p in packed], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, decoded], [*batch.schema.names, "token_ids", "decoded"])
        own.cache.clear()

    return docs.select(*keep).mapInArrow(releasing(run), schema)


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = encode_documents(docs)
    return out.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
