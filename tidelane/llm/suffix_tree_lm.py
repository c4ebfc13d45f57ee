"""LM scoring with a probabilistic suffix tree, beside a smoothed word-unigram base.

The text is a stream of bytes: its lower-cased words, a blank after each, and an end mark.
All grams of DEPTH + 1 bytes of the training texts are counted by Spark.  Contexts of up to
SHALLOW bytes are always states of the tree; a longer one, of up to DEPTH bytes, becomes a
state if it is seen MIN_COUNT times and its next-byte distribution diverges from that of its
parent (the context without its oldest byte); its suffixes come along.  Distributions are
smoothed with the parent's.  A byte is scored in the state of the longest suffix of what
stands before it.

States and word counts grow with the corpus, so they are never gathered:

1. Each chunk of documents is written once with its distinct grams and words and their counts
   in training texts, dealt to buckets: grams by hash of their latest SHALLOW + 1 context
   bytes, words by hash.
2. The counts of a bucket are summed in a tree, FAN chunks at a time.
3. A bucket's sums build the states of its own contexts, then answer the chunks one after the
   other; where there are many chunks, several tasks hold the same bucket.
4. Each chunk adds up the answers on its grams and words by document.

Only the levels up to SHALLOW bytes, of 256 ** (SHALLOW + 1) grams at most, are broadcast.

Defined cases: null and empty texts are one end token.  Rows with a null doc_id count as id
''.  Repeated rows are counted and scored each.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelane.llm.bytetext import LOWER, SPACE_SEP, Block, blocks, releasing, row_of, small_batches, span_hashes, split_words, utf8_block
from tidelane.llm.checkpoints import Tables
from tidelane.llm.sampling import crc_mod

#: Longest context (a gram and the row's place in a strip fill 64 bits); longest context that is always a state; least count of a longer one; least gain in nats that keeps it; weight of the parent.
DEPTH, SHALLOW, MIN_COUNT, MIN_GAIN, PARENT = 6, 2, 4, 20.0, 4.0

#: Text bytes of a chunk; chunks that are summed at once; chunks that one task of a bucket answers, about.
CHUNK_BYTES, FAN, ASKED = 12 << 20, 64, 256

#: Training symbols for each bucket, about, and the number of buckets, at most.
BUCKET_BYTES, MOST_BUCKETS = 16 << 20, 8192

#: Text bytes of a block, and symbols and rows that are looked up at once.
BLOCK_BYTES = 512 << 10
STRIP, STRIP_ROWS = 1 << 20, 64

#: Parts of a unit of log10 probability that answers are rounded to.
STEP = float(1 << 18)

_BLANK, _END = 32, 10


def stream(data: np.ndarray, words) -> tuple[np.ndarray, np.ndarray]:
    """The rows' symbols side by side, and the rows' bounds."""
    n = len(words.bounds) - 1
    size = words.end - words.start + 1
    rows = row_of(words.bounds)
    put = np.cumsum(size) - size + rows  # one end mark for each row before
    ends = np.concatenate([[0], np.cumsum(size)])[words.bounds[1:]] + np.arange(n)
    out = np.full(int(size.sum()) + n, _BLANK, np.uint8)
    out[ends] = _END
    length = size - 1
    at = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    out[np.repeat(put, length) + at] = np.maximum(data[np.repeat(words.start, length) + at], 1)
    return out, np.concatenate([[0], ends + 1])


def gram_codes(symbols: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """For each symbol: itself in the lowest byte, the symbols before it above; 0 beyond the row's start, which reads as an end mark."""
    code = symbols.astype(np.uint64)
    before = np.concatenate([np.full(depth, _END, np.uint8), symbols])
    open_ = np.ones(len(symbols), bool)
    for j in range(1, depth + 1):
        s = before[depth - j : depth - j + len(symbols)]
        code |= np.where(open_, s, 0).astype(np.uint64) << np.uint64(8 * j)
        open_ &= s != _END
    return code


_CODEC = pa.Codec("zstd", compression_level=3)


def _packed(values: np.ndarray) -> bytes:
    """The values' first bytes, then their second ones and so on, compressed; the front holds the size."""
    raw = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()
    return len(raw).to_bytes(8, "little") + _CODEC.compress(raw, asbytes=True)


def _unpacked(held: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(_CODEC.decompress(held[8:], int.from_bytes(held[:8], "little"), asbytes=True), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(dtype)


def _packed_codes(code: np.ndarray) -> bytes:
    """Ascending codes, as steps."""
    return _packed(np.diff(code, prepend=np.uint64(0)))


def _unpacked_codes(held: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(held, np.uint64), dtype=np.uint64)


def _summed(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes and their counts."""
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    new = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    return code[new], np.add.reduceat(n, new) if len(new) else n


def _distinct(code: np.ndarray) -> np.ndarray:
    """Sorted; much faster than numpy's own way by hashing."""
    code = np.sort(code)
    return code[np.concatenate([[True], code[1:] != code[:-1]])] if len(code) else code


def _counted(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes of the parts, which are used up, and how often each stands there."""
    code = np.concatenate([np.zeros(0, np.uint64), *parts])
    parts.clear()
    code.sort()
    new = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    return code[new], np.diff(np.append(new, len(code)))


def _low(size: int) -> np.uint64:
    """Mask of a symbol and ``size`` bytes before it."""
    return np.uint64((1 << 8 * (size + 1)) - 1)


def gram_buckets(code: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each gram, by its latest SHALLOW + 1 context bytes."""
    latest = (code & _low(SHALLOW + 1)) >> np.uint64(8)
    return ((latest * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(buckets)


def word_buckets(word: np.ndarray, buckets: int) -> np.ndarray:
    return (word >> np.uint64(33)) % np.uint64(buckets)


def dealt(own: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places where ``own`` has it), places ascending."""
    order = np.argsort(own, kind="stable")
    cuts = np.searchsorted(own[order], np.arange(buckets + 1))
    for b in np.flatnonzero(cuts[1:] > cuts[:-1]):
        yield int(b), order[cuts[b] : cuts[b + 1]]


@dataclass
class Level:
    """Contexts of one size that are states: sorted ``context`` with ``total``; sorted ``gram`` (context and symbol) with ``n``."""

    context: np.ndarray
    total: np.ndarray
    gram: np.ndarray
    n: np.ndarray

    @staticmethod
    def of(code: np.ndarray, n: np.ndarray, size: int) -> Level:
        if size:
            full = (code >> np.uint64(8 * size)) & np.uint64(255) > 0
            code, n = code[full], n[full]
        gram, n = _summed(code & _low(size), n)
        context, total = _summed(gram >> np.uint64(8), n)
        return Level(context, total, gram, n)

    def places(self, context: np.ndarray) -> np.ndarray:
        """Where each context stands, -1 if it is no state."""
        if not len(self.context):
            return np.full(len(context), -1)
        at = np.minimum(np.searchsorted(self.context, context), len(self.context) - 1)
        return np.where(self.context[at] == context, at, -1)

    def counts(self, gram: np.ndarray) -> np.ndarray:
        if not len(self.gram):
            return np.zeros(len(gram), np.int64)
        at = np.minimum(np.searchsorted(self.gram, gram), len(self.gram) - 1)
        return np.where(self.gram[at] == gram, self.n[at], 0)

    def only(self, state: np.ndarray) -> Level:
        keep = state[np.searchsorted(self.context, self.gram >> np.uint64(8))] if len(self.gram) else np.zeros(0, bool)
        return Level(self.context[state], self.total[state], self.gram[keep], self.n[keep])


def shallow_levels(code: np.ndarray, n: np.ndarray) -> list[Level]:
    """Levels 0 to SHALLOW, whose contexts are all states."""
    return [Level.of(code, n, size) for size in range(SHALLOW + 1)]


def deep_levels(code: np.ndarray, n: np.ndarray, shallow: list[Level], depth: int = DEPTH, least: int = MIN_COUNT, gain: float = MIN_GAIN) -> list[Level]:
    """Levels above SHALLOW of one bucket, from all its grams and their counts."""
    levels, states = [shallow[-1]], []
    for size in range(SHALLOW + 1, depth + 1):
        own, up = Level.of(code, n, size), levels[-1]
        at = np.searchsorted(own.context, own.gram >> np.uint64(8))
        older = own.gram & _low(size - 1)
        p = up.counts(older) / up.total[up.places(older >> np.uint64(8))] if len(older) else np.zeros(0)
        gains = np.bincount(at, own.n * np.log(own.n / own.total[at] / p), len(own.context))
        states.append((own.total >= least) & (gains >= gain))
        levels.append(own)
    # A retained context brings all its suffixes along.
    for k in range(len(states) - 1, 0, -1):
        kept = levels[k + 1].context[states[k]] & _low(SHALLOW + k - 1)
        states[k - 1][levels[k].places(kept)] = True
    return [level.only(state) for level, state in zip(levels[1:], states, strict=True)]


def log_probabilities(levels: list[Level], code: np.ndarray, weight: float = PARENT) -> np.ndarray:
    """log10 of each gram's symbol in the state of the longest suffix of its context."""
    root = levels[0]
    p = (root.counts(code & np.uint64(255)) + 0.1) / (root.n.sum() + 25.6)
    alive = np.arange(len(code))
    for size, level in enumerate(levels[1:], 1):
        gram = code[alive] & _low(size)
        at = level.places(gram >> np.uint64(8))
        ok = (at >= 0) & (gram >> np.uint64(8 * size) > 0)
        alive, gram, at = alive[ok], gram[ok], at[ok]
        p[alive] = (level.counts(gram) + weight * p[alive]) / (level.total[at] + weight)
    return np.log10(p)


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


_POSTED = T.StructType([
    T.StructField("kind", T.IntegerType()), T.StructField("bucket", T.IntegerType()), T.StructField("chunk", T.LongType()), T.StructField("n", T.LongType()),
    T.StructField("codes", T.BinaryType()), T.StructField("counts", T.BinaryType()), T.StructField("rows", T.BinaryType()),
])
_KEPT = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("bucket", T.IntegerType()), T.StructField("slot", T.LongType()), T.StructField("codes", T.BinaryType()), T.StructField("counts", T.BinaryType())])
_GRAMS, _WORDS, _TEXT = range(3)


def _table(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    kinds = {T.IntegerType(): pa.int32(), T.LongType(): pa.int64(), T.BinaryType(): pa.binary()}
    columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[f.dataType]) for c, f in zip(columns, schema, strict=True)], schema.names)


def posted_chunks(own: DataFrame, buckets: int, text: str, key: str) -> DataFrame:
    """Of each chunk its distinct grams and words with their counts in training rows (0: in others only), by bucket, and one row with its texts; ``own``: key, text, held_out."""

    def handed(chunk: int, keys: list, held: list, data: list, sizes: list, found: dict) -> pa.RecordBatch:
        learnt = np.concatenate(held)
        rows = pa.RecordBatch.from_arrays([pa.concat_arrays(keys), pa.array(learnt)], [key, "held_out"])
        out = [(_TEXT, int(chunk % buckets), chunk, int((~learnt).sum()), _packed(np.concatenate(data)), np.concatenate(sizes).astype(np.int64).tobytes(), _ipc(rows))]
        for kind, bucket_of in ((_GRAMS, gram_buckets), (_WORDS, word_buckets)):
            code, n = _counted(found[kind][0])
            other = _counted(found[kind][1])[0]
            code, n = _summed(np.concatenate([code, other]), np.concatenate([n, np.zeros(len(other), np.int64)]))
            out.extend((kind, b, chunk, len(at), _packed_codes(code[at]), _packed(n[at]), None) for b, at in dealt(bucket_of(code, buckets), buckets))
        return _table(out, _POSTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, size = TaskContext.get().partitionId() << 24, 0
        keys, held, data, sizes, found = [], [], [], [], {_GRAMS: ([], []), _WORDS: ([], [])}
        for batch in blocks(batches, text, BLOCK_BYTES):
            raw = utf8_block(batch.column(1))
            lower = LOWER[raw.data]
            words = split_words(Block(lower, raw.bounds), SPACE_SEP)
            symbols, bounds = stream(lower, words)
            out = batch.column(2).to_numpy(zero_copy_only=False)
            code, word = gram_codes(symbols), span_hashes(lower, words.start, words.end)
            for kind, of, many in ((_GRAMS, code, np.diff(bounds)), (_WORDS, word, words.counts)):
                other = np.repeat(out, many)
                found[kind][0].append(of[~other])
                found[kind][1].append(of[other])
            keys.append(batch.column(0))
            held.append(out)
            data.append(lower)
            sizes.append(np.diff(raw.bounds))
            size += len(lower)
            if size >= CHUNK_BYTES:
                yield handed(chunk, keys, held, data, sizes, found)
                chunk, size = chunk + 1, 0
                keys, held, data, sizes, found = [], [], [], [], {_GRAMS: ([], []), _WORDS: ([], [])}
        if keys:
            yield handed(chunk, keys, held, data, sizes, found)

    return own.mapInArrow(releasing(run), _POSTED)


def bucket_sums(posted: DataFrame, chunks: int) -> DataFrame:
    """(kind, bucket, slot, codes, counts): the training counts of each bucket, one row of each, summed in a tree over the chunks."""

    def summed(table: pa.Table) -> pa.Table:
        parts = [(_unpacked_codes(r["codes"]), _unpacked(r["counts"], np.int64)) for r in table.select(["codes", "counts"]).to_pylist()]
        code, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        code, n = _summed(code[n > 0], n[n > 0])
        return pa.Table.from_batches([_table([(table["kind"][0].as_py(), table["bucket"][0].as_py(), table["slot"][0].as_py(), _packed_codes(code), _packed(n))], _KEPT)])

    parts, slot, groups = posted.where(F.col("kind") < _TEXT), F.xxhash64("chunk"), chunks
    while True:
        groups = max(1, -(-groups // FAN))
        parts = parts.select("kind", "bucket", F.pmod(slot, F.lit(groups)).cast("long").alias("slot"), "codes", "counts").groupBy("kind", "bucket", "slot").applyInArrow(summed, _KEPT)
        if groups == 1:
            return parts
        slot = F.col("slot")


def shallow_sums(sums: DataFrame) -> DataFrame:
    """(code, n): counts of the grams of SHALLOW + 1 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for codes, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                code, n = _summed(_unpacked_codes(codes) & _low(SHALLOW), _unpacked(counts, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(n)], ["code", "n"])

    return sums.where(F.col("kind") == _GRAMS).select("codes", "counts").mapInArrow(releasing(run), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def word_totals(sums: DataFrame) -> tuple[int, int]:
    """Words in the training texts, all and distinct."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [_unpacked(x, np.int64) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([int(x.sum()) for x in n], pa.int64()), pa.array([len(x) for x in n], pa.int64())], ["words", "kinds"])

    found = sums.where(F.col("kind") == _WORDS).select("counts").mapInArrow(releasing(run), "words long, kinds long").agg(F.sum("words"), F.sum("kinds")).first()
    return found[0] or 0, found[1] or 0


def answers(posted: DataFrame, sums: DataFrame, shallow, chunks: int) -> DataFrame:
    """(chunk, kind, bucket, codes): for the grams and words that a chunk has in a bucket their log10 probabilities (in the order of symbol and latest bytes) and training counts."""
    salts = -(-chunks // ASKED)
    own = sums.select("kind", "bucket", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(-1).cast("long").alias("chunk"), "codes", "counts")
    asked = posted.where(F.col("kind") < _TEXT).select("kind", "bucket", F.pmod(F.xxhash64("chunk"), F.lit(salts)).cast("int").alias("salt"), "chunk", "codes", F.lit(None).cast("binary").alias("counts"))
    # Of each bucket the sums come first, then its questions; a bucket without sums answers from the shallow levels alone.
    rows = own.unionByName(asked).repartition(int(posted.sparkSession.conf.get("spark.sql.shuffle.partitions")), "kind", "bucket", "salt").sortWithinPartitions("kind", "bucket", "salt", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, known, now = [], (np.zeros(0, np.uint64), np.zeros(0, np.int64)), None
        for batch in batches:
            for r in batch.to_pylist():
                kind, code = r["kind"], _unpacked_codes(r["codes"])
                if now != (kind, r["bucket"], r["salt"]):
                    now, levels, known = (kind, r["bucket"], r["salt"]), shallow.value, (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                if r["chunk"] < 0:
                    known = code, _unpacked(r["counts"], np.int64)
                    if kind == _GRAMS:
                        levels = shallow.value + deep_levels(*known, shallow.value)
                    continue
                if kind == _GRAMS:
                    found = np.round(log_probabilities(levels, code) * -STEP).astype(np.uint32)[np.argsort(code.byteswap())]
                else:
                    at = np.minimum(np.searchsorted(known[0], code), max(len(known[0]) - 1, 0))
                    found = np.where(known[0][at] == code, known[1][at], 0) if len(known[0]) else np.zeros(len(code), np.int64)
                yield _table([(kind, r["bucket"], r["chunk"], _packed(found))], _ANSWER)

    return rows.mapInArrow(releasing(run), _ANSWER)


_ANSWER = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("bucket", T.IntegerType()), T.StructField("chunk", T.LongType()), T.StructField("codes", T.BinaryType())])


def gram_sums(symbols: np.ndarray, bounds: np.ndarray, answer: dict, buckets: int) -> np.ndarray:
    """Sums of log10 probabilities per row of a chunk, from the answers on its distinct grams."""
    rows = len(bounds) - 1
    # Strips end where rows end, so that grams see what stands before them; a key is the row within the strip, then the gram.
    cuts = [0]
    while cuts[-1] < rows:
        cuts.append(max(cuts[-1] + 1, min(cuts[-1] + STRIP_ROWS, int(np.searchsorted(bounds, bounds[cuts[-1]] + STRIP, "right")) - 1)))
    shift = np.uint64(8 * (DEPTH + 1))

    def strips() -> Iterator[np.ndarray]:
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            own = gram_codes(symbols[bounds[a] : bounds[b]])
            own |= np.repeat(np.arange(b - a, dtype=np.uint64) << shift, np.diff(bounds[a : b + 1]))
            own.sort()
            yield own

    code, fresh, size = np.zeros(0, np.uint64), [], 0
    for own in strips():  # sorted again below: cheaper than to keep them
        fresh.append(_distinct(own & _low(DEPTH)))
        size += len(fresh[-1])
        if size >= STRIP:
            code, fresh, size = _distinct(np.concatenate([code, *fresh])), [], 0
    code = _distinct(np.concatenate([code, *fresh]))
    logp = np.zeros(len(code))
    for b, at in dealt(gram_buckets(code, buckets), buckets):
        logp[at[np.argsort(code[at].byteswap())]] = _unpacked(answer[b], np.uint32) / -STEP
    out = [np.zeros(0)]
    for own, a, b in zip(strips(), cuts[:-1], cuts[1:], strict=True):
        gram = own & _low(DEPTH)
        few = _distinct(gram)
        each = logp[np.searchsorted(code, few)][np.searchsorted(few, gram)]
        out.append(np.bincount((own >> shift).astype(np.int64), each, b - a))
    return np.concatenate(out)


def score_corpus(docs: DataFrame, held_out, text: str = "text", key: str = "doc_id", buckets: int | None = None) -> DataFrame:
    """Per row of ``docs``: key, held_out, n_tokens, n_known, train_tokens, base_score and score (both log10).

    Learns from the rows where ``held_out`` (a boolean column) is false.
    """
    spark = docs.sparkSession
    small_batches(spark)
    tables = Tables(spark)
    own = docs.select(F.col(key).alias(key), F.col(text).alias(text), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    if not buckets:
        size = own.where(~F.col("held_out")).agg(F.sum(F.octet_length(text))).first()[0] or 0
        buckets = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES), MOST_BUCKETS)
    posted = tables.keep("posted", posted_chunks(own, buckets, text, key))
    chunks, ends = posted.where(F.col("kind") == _TEXT).agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    sums = tables.keep("sums", bucket_sums(posted, chunks))
    few = shallow_sums(sums).toArrow()
    shallow = spark.sparkContext.broadcast(shallow_levels(few["code"].to_numpy().view(np.uint64), few["n"].to_numpy()))
    words, kinds = word_totals(sums)
    # The end token is a word of the vocabulary where there is any training text.
    tokens, distinct = words + ends, kinds + (ends > 0)
    whole = np.log10(tokens + 0.1 * (distinct + 1))
    end = np.log10(ends + 0.1)
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])

    def joined(table: pa.Table) -> pa.Table:
        """Adds up the answers of one chunk by document."""
        parts = table.select(["kind", "bucket", "codes"]).to_pylist()
        at = next(i for i, r in enumerate(parts) if r["kind"] == _TEXT)
        rows = pa.ipc.open_stream(table["rows"][at].as_py()).read_all()
        data = _unpacked(parts[at]["codes"], np.uint8)
        lines = np.concatenate([[0], np.cumsum(np.frombuffer(table["counts"][at].as_py(), np.int64))])
        answer = {kind: {r["bucket"]: r["codes"] for r in parts if r["kind"] == kind} for kind in (_GRAMS, _WORDS)}
        own = split_words(Block(data, lines), SPACE_SEP)
        distinct, back = np.unique(span_hashes(data, own.start, own.end), return_inverse=True)
        count = np.zeros(len(distinct), np.int64)
        for b, places in dealt(word_buckets(distinct, buckets), buckets):
            count[places] = _unpacked(answer[_WORDS][b], np.int64)
        row, n = row_of(own.bounds), rows.num_rows
        base = np.bincount(row, np.log10(count + 0.1)[back], n) + end - (own.counts + 1) * whole
        known = np.bincount(row, (count > 0)[back], n).astype(np.int64) + (ends > 0)
        score = gram_sums(*stream(data, own), answer[_GRAMS], buckets)
        return pa.table([rows[key], rows["held_out"], pa.array(own.counts + 1), pa.array(known), pa.array(base), pa.array(score)], names=schema.names)

    texts = posted.where(F.col("kind") == _TEXT).select("kind", "bucket", "chunk", "codes", "counts", "rows")
    found = answers(posted, sums, shallow, chunks) if chunks else spark.createDataFrame([], _ANSWER)
    scored = texts.unionByName(found, allowMissingColumns=True).groupBy("chunk").applyInArrow(joined, schema)
    return scored.select(key, "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op9_lm_score(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score_corpus(docs, crc_mod("doc_id", 10) == 0)
