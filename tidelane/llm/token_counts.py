"""Exact token counts at every prefix of a text, by dynamic programming over its prefixes.

The encoding of a prefix is its last token behind the encoding of what stands before that
token, and of all tokens that end at a place only one keeps its neighbour when the two are
merged together.  So one sweep finds, at every byte of a piece, the last token and the count:
a token that starts where a prefix ends is taken if it and the prefix's last token are merged
to themselves.  Counts at the ends of code points are stored; truncation and budget questions
read them and encode nothing again.

A prefix is counted as a text of its own, so it may be cut into other pieces than the whole
text: a run of white space before a word is one piece until the word begins, a contraction is
two until it is whole, a special string is ordinary text until its last character.

Defined cases: null and empty texts have 0 bytes and tokens, and the one prefix ''.  Repeated
rows, and rows with equal texts, are counted once each; tables without rows give none.  A text
of any length is counted whole, in a block of its own.  Other columns pass through, whatever
their names; the columns that are added replace those of the same name.  Invalid UTF-8 is
read with replacement characters; ``n_bytes`` counts the bytes that are stored.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache
from operator import methodcaller, sub

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelane.llm.bpe import PATTERN, codec, default_tokenizer
from tidelane.llm.bytetext import BLOCK_BYTES, blocks, releasing, small_batches

#: The pieces that the pre-tokenisation pattern names letter by letter.
CONTRACTIONS = frozenset({"'s", "'t", "'re", "'ve", "'m", "'ll", "'d"})

#: Pieces (of up to so many code points) and neighbours that a worker remembers.
CACHE_PIECES, CACHE_CHARS, CACHE_PAIRS = 500_000, 48, 1 << 19

#: Tokens of a context window.
LIMIT = 1024


class _Steps(dict):
    """Steps of the pieces seen; emptied when it is full."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, piece: str) -> bytes:
        made = self.make(piece)
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = made
        return made


class PrefixCounter:
    """Counts of one tokenizer file.  What pieces and neighbours have been seen is remembered from task to task, up to a bound."""

    def __init__(self, path: str):
        self.codec = codec(path)
        strings, specials = self.codec.strings, set(self.codec.specials.values())
        self.rank, self.halves = [-1] * len(strings), [(-1, -1)] * len(strings)
        for pair, (rank, made) in self.codec.merges.items():
            self.rank[made], self.halves[made] = rank, pair
        #: Merges only use what was made before them, so a text's merges happen in the order of their ranks.
        self.in_order = all(max(self.rank[a], self.rank[b]) < rank for (a, b), (rank, _) in self.codec.merges.items())
        token = {s: i for i, s in enumerate(strings) if s and i not in specials and self.codec.merge(s) == [i]}
        self.token = token
        self.longest = max(map(len, token))
        self.fits: dict[int, bool] = {}
        self.steps = _Steps(self.piece_steps)
        self.runs = regex.compile(r"\s{2,}(?=\S)").finditer
        self.each = regex.compile(PATTERN).finditer

    def neighbours(self, a: int, b: int) -> bool:
        """Whether both tokens stay as they are when their bytes are merged together.

        Of all merges across their border that are at hand while the two are being made none may be
        due: before the left part grows (equal merges go from left to right) and before the right does.
        """
        if not self.in_order:
            return self.codec.merge(self.codec.strings[a] + self.codec.strings[b]) == [a, b]
        rank, halves, merges = self.rank, self.halves, self.codec.merges
        left_grows = right_grows = len(merges)
        while True:
            across = merges.get((a, b))
            if across is not None and across[0] < left_grows and across[0] <= right_grows:
                return False
            if rank[a] > rank[b]:
                left_grows, a = rank[a], halves[a][1]
            elif rank[b] >= 0:
                right_grows, b = rank[b], halves[b][0]
            else:
                return True

    def byte_counts(self, piece: bytes) -> list[int]:
        """Tokens of every prefix of a piece, by its length in bytes."""
        n = len(piece)
        count, last, start = [0] * (n + 1), [-1] * (n + 1), [0] * (n + 1)
        token, fits, longest = self.token.get, self.fits, self.longest
        for j in range(1, n + 1):
            grown = start[j - 1]
            # One of these tokens fits.  Mostly it is the last one with a byte more, or that byte, so these come first.
            for i in (grown, *range(j - 1, max(j - longest, 0) - 1, -1)) if grown < j - 1 else range(j - 1, max(j - longest, 0) - 1, -1):
                t = token(piece[i:j])
                if t is None:
                    continue
                if i:
                    pair = last[i] << 20 | t
                    fit = fits.get(pair)
                    if fit is None:
                        if len(fits) >= CACHE_PAIRS:
                            fits.clear()
                        fit = fits[pair] = self.neighbours(last[i], t)
                    if not fit:
                        continue
                last[j], count[j], start[j] = t, count[i] + 1, i
                break
        return count

    def piece_steps(self, piece: str) -> bytes:
        """By how much the count changes with every code point of a piece, as packed 16-bit integers."""
        if piece in CONTRACTIONS:
            parts = [self.codec.pieces(piece[:k]) for k in range(1, len(piece))]
            ends = [0, *(sum(self.byte_counts(p.encode())[-1] for p in own) for own in parts), self.byte_counts(piece.encode())[-1]]
        else:
            raw = piece.encode()
            ends = self.byte_counts(raw)
            if len(raw) > len(piece):
                ends = [c for k, c in enumerate(ends) if k == len(raw) or raw[k] & 0xC0 != 0x80]
        return array("h", map(sub, ends[1:], ends)).tobytes()

    def ordinary(self, text: str) -> np.ndarray:
        """Counts at 0, 1, ... code points of a text in which special strings are ordinary."""
        get = self.steps.__getitem__
        pieces = self.codec.pieces(text) if len(text) <= BLOCK_BYTES else map(methodcaller("group"), self.each(text))
        out = np.zeros(len(text) + 1, np.int32)
        np.cumsum(np.frombuffer(b"".join(map(get, pieces)), np.int16), out=out[1:])
        for run in self.runs(text):
            out[run.end()] = out[run.start()] + sum(np.frombuffer(get(run.group()), np.int16))
        return out

    def prefixes(self, text: str) -> np.ndarray:
        """Counts at 0, 1, ... code points of a text."""
        specials = self.codec.specials
        if not any(s in text for s in specials):
            return self.ordinary(text)
        out, base = [np.zeros(1, np.int32)], 0
        parts = self.codec.cut.split(text)
        for part, special in zip(parts[::2], [*parts[1::2], ""]):
            own = self.ordinary(part + special[:-1]) + np.int32(base)
            base = int(own[len(part)]) + 1
            out += [own[1:], np.full(len(special[-1:]), base, np.int32)]
        return np.concatenate(out)


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def quoted(name: str) -> Column:
    """The column of this very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def count_tokens(docs: DataFrame, tokenizer: str | None = None, text: str = "text", budget: int = LIMIT, prefixes: bool = False) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens`` and ``fit_chars`` (code points of the longest prefix of at most ``budget`` tokens), all long.

    With ``prefixes`` also ``prefix_tokens`` array<int>: entry k is the count of the first k
    code points.  One pass, no shuffle; a task holds one block of rows and bounded caches.
    ``tokenizer`` is a byte-level BPE file that every executor can read (default: the public one).
    """
    small_batches(docs.sparkSession)
    added = ["n_bytes", "n_tokens", "fit_chars", *(["prefix_tokens"] if prefixes else [])]
    keep = [c for c in docs.columns if c not in added]
    at = keep.index(text)
    types = [T.LongType(), T.LongType(), T.LongType(), T.ArrayType(T.IntegerType())]
    plain = docs.select(*(quoted(c).alias(f"c{i}") for i, c in enumerate(keep)))  # no name of theirs is read as a path of fields
    schema = T.StructType([*plain.schema.fields, *(T.StructField(c, kind) for c, kind in zip(added, types))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(tokenizer or default_tokenizer())
        for batch in blocks(batches, f"c{at}"):
            raw = [t or b"" for t in batch.column(at).cast(pa.binary()).to_pylist()]
            tables = (own.prefixes(t.decode("utf-8", "replace")) for t in raw)
            kept, total, fit = [], [], []
            for table in tables:
                total.append(int(table[-1]))
                fit.append(len(table) - 1 if total[-1] <= budget else int(np.flatnonzero(table <= budget)[-1]))
                if prefixes:
                    kept.append(table)
            more = [pa.array([len(t) for t in raw], pa.int64()), pa.array(total, pa.int64()), pa.array(fit, pa.int64())]
            if prefixes:
                ends = np.cumsum([0, *map(len, kept)]).astype(np.int32)
                more.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(kept))))
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], schema.names)

    return plain.mapInArrow(releasing(run), schema).toDF(*keep, *added)


def tokens_of_prefix(prefix_tokens: Column, chars: Column | int) -> Column:
    """Tokens of the first ``chars`` code points (of the whole text if it is shorter)."""
    at = F.least(F.greatest(chars if isinstance(chars, Column) else F.lit(chars), F.lit(0)) + 1, F.size(prefix_tokens))
    return F.element_at(prefix_tokens, at.cast("int")).cast("long")


def longest_prefix(prefix_tokens: Column, budget: Column | int) -> Column:
    """Code points of the longest prefix of at most ``budget`` tokens; null if none is."""
    fits = F.reverse(F.transform(prefix_tokens, lambda n: n <= budget))
    return F.when(F.array_contains(fits, True), F.size(prefix_tokens) - F.array_position(fits, True))


def op11_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = count_tokens(docs, budget=LIMIT)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"), "fit_chars")
