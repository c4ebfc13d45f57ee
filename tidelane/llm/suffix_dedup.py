"""Suffix-array dedup: removes every byte of a 100-byte string that also starts earlier.

1. Anchors.  Of the GRAM-byte grams in a window the one with the smallest hash is its
   anchor, so equal windows have equal anchors; the windows of one anchor are a segment.
   Each task keeps the earliest of equal segments it holds.
2. A segment that equals an earlier one is removed whole: equal segments meet by (anchor,
   segment) hash, sorted, and are read as a stream.  An anchor with one segment is done.
3. Only where an anchor has different segments are their bytes fetched, brought together by
   anchor, cut down to windows whose core occurs twice, and put in order by linear suffix
   grouping (:mod:`tidelane.llm.suffix_array`).  Neighbours in the suffix array that share 100
   bytes are one string, and all but its earliest place are removed.  An anchor with more than
   ``HOT`` different segments does without a task of its own: the strings of its segments are
   grouped by a 128-bit hash with partial aggregation.
4. The spans of each document are put together and its bytes are cut.

Documents are ordered by ``doc_id`` (nulls first).  Defined cases: null and empty texts
have no bytes; shorter texts than 100 bytes keep all.  Rows that repeat a doc_id with the
same text are one document, judged once and returned as often; different texts of one
doc_id count in the order of the texts.  Extra columns pass through, whatever their names,
but for those that are named as the added ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelane.llm.bytetext import blocks, mix, releasing, small_batches, span_hashes, utf8_block
from tidelane.llm.checkpoints import Tables
from tidelane.llm.suffix_array import suffix_array

#: Bytes of a string, of an anchor's gram.
LENGTH, GRAM = 100, 32

#: Segments of one anchor that meet in one task, at most; text bytes of a task's chunk, and of a block whose anchors are found at once; bytes put in order at once.
HOT, CHUNK_BYTES, BLOCK_BYTES, ORDER_BYTES = 16_384, 8 << 20, 512 << 10, 400_000

#: Classes of window starts before their anchor; all windows of a class share a core of at least LENGTH - 9 bytes.
_CLASSES = [(-(k + 9) if k < 63 else -(LENGTH - GRAM), -k) for k in range(0, LENGTH - GRAM, 10)]

_NONE = np.zeros(0, np.int64)


def anchors(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(row, gram position, first window, last window, gram hash, segment hash) of each segment; positions in ``data``."""
    n, width = len(data), length - gram + 1
    if n < length:
        return (*[_NONE] * 4, *[np.zeros(0, np.uint64)] * 2)
    at = np.arange(n - gram + 1)
    h = span_hashes(data, at, at + gram)
    least = (h & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    k = 1
    while 2 * k <= width:
        least = np.minimum(least[:-k], least[k:])
        k *= 2
    if k < width:
        least = np.minimum(least[: len(least) - (width - k)], least[width - k :])
    size = np.diff(bounds)
    count = np.maximum(size - length + 1, 0)
    row = np.repeat(np.arange(len(size)), count)
    start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - bounds[:-1], count)
    if not len(start):
        return (*[_NONE] * 4, *[np.zeros(0, np.uint64)] * 2)
    pos = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    cut = np.flatnonzero(np.concatenate([[True], (pos[1:] != pos[:-1]) | (row[1:] != row[:-1])]))
    low, high, pos = start[cut], start[np.append(cut[1:], len(start)) - 1], pos[cut]
    whole = mix(span_hashes(data, low, high + length) ^ mix((pos - low).astype(np.uint64)))
    return row[cut], pos, low, high, h[pos], whole


def merge_spans(owner: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of the spans of each owner."""
    if not len(owner):
        return owner, start, stop
    order = np.lexsort((start, owner))
    owner, start, stop = owner[order], start[order], stop[order]
    _, rank = np.unique(owner, return_inverse=True)
    shift = rank * (int(stop.max()) + 1)
    reach = np.maximum.accumulate(stop + shift)
    new = np.concatenate([[True], start[1:] + shift[1:] > reach[:-1]])
    at = np.flatnonzero(new)
    return owner[at], start[at], (reach - shift)[np.append(at[1:], len(owner)) - 1]


def ordered(docs: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """``docs`` (key, text, ...) with ``place`` (a long, in the order of the documents), and the distinct (place, text) to judge."""
    plain = dict(docs.dtypes)["key"] in ("bigint", "int", "smallint", "tinyint")
    unclear = docs.groupBy("key").count().where(F.col("count").__gt__(1) | F.col("key").isNull())
    if plain and unclear.isEmpty():
        own = docs.withColumn("place", F.col("key").cast("long"))
        return own, own.select("place", "text")
    each = docs.select("key", F.coalesce("text", F.lit("")).alias("text")).distinct().orderBy(F.col("key").asc_nulls_first(), "text")
    each = tables.keep("order", each.withColumn("place", F.monotonically_increasing_id()))
    named = each.select(F.col("key").alias("other"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"), "place")
    same = docs["key"].eqNullSafe(named["other"]) & (F.sha2(F.coalesce(docs["text"], F.lit("")).cast("binary"), 256) == named["sha"])
    return docs.join(named, same).drop("other", "sha"), each.select("place", "text")


_SEGMENT = T.StructType([*(T.StructField(c, T.LongType()) for c in ("anchor", "whole", "doc")), *(T.StructField(c, T.IntegerType()) for c in ("pos", "low", "high"))])


def _batch(anchor: np.ndarray, whole: np.ndarray, doc: np.ndarray, pos: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(doc), *(pa.array(x.astype(np.int32)) for x in (pos, low, high))], _SEGMENT.names)


def segments_of(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """(anchor, whole, doc, pos, low, high) of the earliest of equal segments in each chunk of a task; the others are spans (``pos`` -1, bytes low to high) already."""

    def handed(parts: list) -> Iterator[pa.RecordBatch]:
        doc, pos, low, high, anchor, whole = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((pos, doc, whole, anchor))
        same = np.zeros(len(order), bool)
        same[1:] = (anchor[order[1:]] == anchor[order[:-1]]) & (whole[order[1:]] == whole[order[:-1]])
        at = order[same]
        d, a, b = merge_spans(doc[at], low[at], high[at] + length)
        own = order[~same]
        for k in range(0, len(own), 1 << 16):
            at = own[k : k + (1 << 16)]
            yield _batch(anchor[at], whole[at], doc[at], pos[at], low[at], high[at])
        # Spans travel with the segments, by hash of their document.
        yield _batch(mix(d.view(np.uint64)), np.zeros(len(d), np.uint64), d, np.full(len(d), -1), a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in blocks(batches, limit=BLOCK_BYTES):
            block = utf8_block(batch.column(1))
            row, pos, low, high, anchor, whole = anchors(block.data, block.bounds, length, gram)
            begin = block.bounds[row]
            parts.append((batch.column(0).to_numpy()[row], pos - begin, low - begin, high - begin, anchor, whole))
            size += len(block.data)
            if size >= CHUNK_BYTES:
                yield from handed(parts)
                parts, size = [], 0
        if parts:
            yield from handed(parts)

    return texts.select("place", "text").mapInArrow(releasing(run), _SEGMENT)


def without_repeats(segments: DataFrame, length: int) -> DataFrame:
    """The earliest of equal segments of the whole corpus; the others become spans.

    Equal segments meet in one task and stand in order there, so it holds one row of them at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor, whole, doc, pos, low, high = (batch.column(c).to_numpy() for c in range(6))
            same = np.zeros(len(doc), bool)
            same[1:] = (anchor[1:] == anchor[:-1]) & (whole[1:] == whole[:-1])
            same[0] = (anchor[0], whole[0]) == last
            last = anchor[-1], whole[-1]
            span = same & (pos >= 0)
            yield _batch(anchor, whole, doc, np.where(span, -1, pos), low, np.where(span, high + length, high))

    sorted_ = segments.repartition("anchor", "whole").sortWithinPartitions("anchor", "whole", "doc", "pos")
    return sorted_.mapInArrow(releasing(run), _SEGMENT).drop("whole")


def _fetched(texts: DataFrame) -> DataFrame:
    """(anchor, hot, doc, start, shift, bytes) of every wanted segment; ``texts``: doc, text, wanted (low, high, pos, anchor, hot)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            block = utf8_block(batch.column(1))
            sizes = batch.column(2).value_lengths().to_numpy()
            low, high, pos, anchor, hot = (c.to_numpy(zero_copy_only=False) for c in batch.column(2).flatten().flatten())
            low, high, pos = (x.astype(np.int64) for x in (low, high, pos))
            begin = np.repeat(block.bounds[:-1], sizes) + low
            size = high - low
            offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            at = np.repeat(begin - offsets[:-1], size) + np.arange(offsets[-1])
            flat = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(block.data[at].tobytes())])
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor), pa.array(hot), pa.array(np.repeat(batch.column(0).to_numpy(), sizes)), pa.array(low), pa.array((pos - low).astype(np.int32)), flat], ["anchor", "hot", "doc", "start", "shift", "bytes"]
            )

    return texts.mapInArrow(releasing(run), "anchor long, hot boolean, doc long, start long, shift int, bytes binary")


def repeated_windows(anchor: np.ndarray, doc: np.ndarray, start: np.ndarray, shift: np.ndarray, block, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(doc, start) of windows that stand earlier in another of the segments, by their suffix array."""
    data, bounds = block.data, block.bounds
    begin, stop = bounds[:-1], bounds[1:]
    first, last = -shift.astype(np.int64), stop - begin - length - shift
    lower, upper = np.full(len(first), 1, np.int64), np.full(len(first), -length, np.int64)
    for c, (a, b) in enumerate(_CLASSES if (length, gram) == (LENGTH, GRAM) else [(gram - length, 0)]):
        x, y = np.maximum(first, a), np.minimum(last, b)
        own = np.flatnonzero(x <= y)
        middle = begin[own] + shift[own]
        core = mix(span_hashes(data, middle + b, middle + a + length) ^ mix(anchor[own].view(np.uint64) + np.uint64(c)))
        _, back, many = np.unique(core, return_inverse=True, return_counts=True)
        own = own[many[back] > 1]
        lower[own] = np.where(lower[own] > 0, x[own], np.minimum(lower[own], x[own]))
        upper[own] = np.maximum(upper[own], y[own])
    keep = np.flatnonzero(lower <= 0)
    if len(keep) < 2:
        return _NONE, _NONE
    begin, size = begin[keep] + shift[keep] + lower[keep], upper[keep] - lower[keep] + length
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    text = data[np.repeat(begin - ends[:-1], size) + np.arange(ends[-1])]
    base = start[keep] + shift[keep] + lower[keep]
    order = suffix_array(text, ends)
    row = np.searchsorted(ends, order, "right") - 1
    full = order + length <= ends[row + 1]
    order, row = order[full], row[full]
    h = span_hashes(text, order, order + length)
    run = np.cumsum(np.concatenate([[0], h[1:] != h[:-1]]))
    doc_of, at = doc[keep][row], base[row] + order - ends[row]
    rank = np.lexsort((at, doc_of, run))
    again = np.concatenate([[False], run[rank[1:]] == run[rank[:-1]]])
    return doc_of[rank[again]], at[rank[again]]


def _spans_of(doc: np.ndarray, start: np.ndarray, length: int) -> pa.RecordBatch:
    d, a, b = merge_spans(doc, start, start + length)
    return pa.RecordBatch.from_arrays([pa.array(d), pa.array(a), pa.array(b)], ["doc", "start", "stop"])


def _ordered_spans(segments: DataFrame, parts: int, length: int, gram: int) -> DataFrame:
    """Spans from segments that meet by anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def done() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            doc, start = repeated_windows(t["anchor"].to_numpy(), t["doc"].to_numpy(), t["start"].to_numpy(), t["shift"].to_numpy(), _binary_block(t["bytes"]), length, gram)
            if len(doc):
                yield _spans_of(doc, start, length)

        for batch in batches:
            if not batch.num_rows:
                continue
            anchor = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(anchor[1:] != anchor[:-1]) + 1), len(anchor)]
            at = 0
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                begins = not held or a > 0 or anchor[0] != last
                if size >= ORDER_BYTES and begins:
                    if a > at:
                        held.append(batch.slice(at, a - at))
                    yield from done()
                    held, size, at = [], 0, a
                size += (b - a) * (length + 20)
            held.append(batch.slice(at))
            last = anchor[-1]
        if held:
            yield from done()

    near = segments.where(~F.col("hot")).select("anchor", "doc", "start", "shift", "bytes")
    return near.repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(releasing(run), "doc long, start long, stop long")


def _binary_block(column):
    """As utf8_block, of a binary column."""
    from tidelane.llm.bytetext import Block

    flat = column.combine_chunks().cast(pa.large_binary()) if isinstance(column, pa.ChunkedArray) else column.cast(pa.large_binary())
    if isinstance(flat, pa.ChunkedArray):
        flat = pa.concat_arrays(flat.chunks)
    _, offsets, data = flat.buffers()
    bounds = np.frombuffer(offsets, np.int64)[flat.offset : flat.offset + len(flat) + 1]
    raw = np.frombuffer(data, np.uint8)
    return Block(raw[bounds[0] : bounds[-1]], bounds - bounds[0])


def _hot_spans(segments: DataFrame, length: int) -> DataFrame:
    """Spans from segments of anchors with very many different ones: equal strings are grouped by hash."""
    hot = segments.where("hot")
    windows = hot.select("doc", "start", F.posexplode(F.expr(f"transform(sequence(1, octet_length(bytes) - {length - 1}), i -> md5(substring(bytes, i, {length})))")).alias("k", "h"))
    windows = windows.select("h", "doc", (F.col("start") + F.col("k")).alias("start"))
    least = windows.groupBy("h").agg(F.min(F.struct("doc", "start")).alias("least"), F.count("*").alias("n")).where("n > 1")
    return windows.join(least, "h").where(F.struct("doc", "start") != F.col("least")).select("doc", "start", (F.col("start") + length).alias("stop"))


def removed_spans(texts: DataFrame, tables: Tables, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(doc, spans array<struct<start, stop>>) of the documents that lose bytes; ``texts``: place, text."""
    judged = tables.keep("judged", without_repeats(segments_of(texts, length, gram), length))
    first = judged.where("pos >= 0")
    several = first.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    wanted = first.join(several, "anchor").select("doc", F.struct("low", (F.col("high") + length).alias("high"), "pos", "anchor", (F.col("n") > hot).alias("hot")).alias("segment"))
    wanted = wanted.groupBy("doc").agg(F.collect_list("segment").alias("wanted"))  # a document's own
    segments = tables.keep("segments", _fetched(texts.join(wanted, F.col("place") == F.col("doc")).select("doc", "text", "wanted")))
    known = tables.keep("known", judged.where("pos < 0").select("doc", F.col("low").cast("long").alias("start"), F.col("high").cast("long").alias("stop")))
    tables.drop("judged")
    found = _ordered_spans(segments, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), length, gram)
    if not segments.where("hot").isEmpty():
        found = found.unionByName(_hot_spans(segments, length))
    spans = tables.keep("spans", known.unionByName(found).groupBy("doc").agg(F.collect_list(F.struct("start", "stop")).alias("spans")))
    tables.drop("known", "segments")
    return spans


def suffix_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT, whole_characters: bool = False) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept`` (the remaining bytes, binary).

    With ``whole_characters`` a character that loses a byte is not in ``kept`` either, so that it is text again.
    """
    added = ("n_bytes", "n_removed", "n_spans", "kept")
    small_batches(docs.sparkSession)
    tables = Tables(docs.sparkSession)
    docs = docs.drop(*added)
    others = [c for c in docs.columns if c != text]
    own = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), F.struct(*(F.col(f"`{c}`") for c in others)).alias("row"))
    rows, texts = ordered(own, tables)
    joined = rows.join(removed_spans(texts, tables, length, gram, hot), F.col("place") == F.col("doc"), "left")
    schema = T.StructType([own.schema["row"], own.schema["text"], *(T.StructField(c, T.LongType()) for c in added[:3]), T.StructField("kept", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            block = utf8_block(batch.column(1))
            sizes, removed, runs, kept = np.diff(block.bounds), np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), []
            many = np.concatenate([[0], np.cumsum(batch.column(2).value_lengths().fill_null(0).to_numpy())])
            starts, stops = (c.to_numpy() for c in batch.column(2).flatten().flatten())
            for i in range(batch.num_rows):
                own = block.row(i)
                a, b = starts[many[i] : many[i + 1]], stops[many[i] : many[i + 1]]
                if len(a):
                    _, a, b = merge_spans(np.zeros(len(a), np.int64), a, b)
                    edge = np.zeros(len(own) + 1, np.int8)
                    edge[a] = 1
                    edge[b] = -1
                    left = np.cumsum(edge[:-1]) == 0
                    if whole_characters:
                        heads = np.flatnonzero(own & 0xC0 != 0x80)
                        left = np.repeat(np.logical_and.reduceat(left, heads), np.diff(np.append(heads, len(own))))
                    own = own[left]
                    removed[i], runs[i] = (b - a).sum(), len(a)
                kept.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(sizes), pa.array(removed), pa.array(runs), pa.array(kept, pa.binary())], schema.names)

    cut = joined.select("row", "text", "spans").mapInArrow(releasing(run), schema)
    return cut.select(*(F.col("text").alias(text) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns), *added)


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    found = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
