"""Benchmark decontamination by a distributed positional inverted index.

``build_index`` turns every block of training documents into one index segment: the sorted
distinct terms of the block and, per term, the ascending positions where it stands.  The
index is a DataFrame of segments, partitioned as the documents are, so building and
searching it needs no shuffle and a hot document, source or term stays where it is read.
``find_phrases`` runs every test phrase against every segment: phrases with a term that the
segment lacks are dropped at once; for the others the posting lists are intersected,
offset-adjusted, from the segment's rarest term on, until all terms have been matched.

Test phrases are cut into blocks by tasks and written; blocks of at most ``SHARED_BYTES``
together are broadcast at once.  A larger benchmark takes several passes over a stored index,
each with blocks of that size, and the hits of each document are put together at the end.
Terms are compared by 64-bit hashes of whole words.

Defined cases: null and empty texts have no words and no hits.  An item with fewer words
than a window is one phrase; one without words never occurs.  An item with a null id marks
words but is not listed.  Repeated document rows are searched once each; repeated items
count once.  Extra columns are ignored; documents keep their order within a segment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelane.llm.bytetext import ALNUM_SEP, LOWER, Block, blocks, releasing, row_of, small_batches, span_hashes, split_words, utf8_block
from tidelane.llm.checkpoints import Tables

#: Words of an item that must stand consecutively.
WINDOW = 10

#: Words of test items in one block, about; bytes of blocks that are broadcast at once.
PHRASE_WORDS, SHARED_BYTES = 400_000, 64 << 20


def _word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all rows, and the rows' bounds."""
    raw = utf8_block(column)
    block = Block(LOWER[raw.data], raw.bounds)
    words = split_words(block, ALNUM_SEP)
    return span_hashes(block.data, words.start, words.end), words.bounds


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per segment: ``keys`` of its documents, ``doc_bounds``, ``terms``, ``term_bounds`` and ``postings`` (packed integers)."""
    packed = ("doc_bounds", "terms", "term_bounds", "postings")
    schema = T.StructType([T.StructField("keys", T.ArrayType(docs.schema[key].dataType)), *(T.StructField(c, T.BinaryType()) for c in packed)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, text):
            hashes, bounds = _word_hashes(batch.column(1))
            order = np.argsort(hashes, kind="stable")
            ranked = hashes[order]
            starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, np.int64)
            columns = (bounds.astype(np.int64), ranked[starts], np.append(starts, len(ranked)).astype(np.int64), order.astype(np.int32))
            keys = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(0))
            yield pa.RecordBatch.from_arrays([keys, *(pa.array([c.tobytes()], pa.binary()) for c in columns)], ["keys", *packed])

    return docs.select(key, text).mapInArrow(releasing(run), schema)


_BLOCK = T.StructType([T.StructField("block", T.LongType()), T.StructField("size", T.LongType()), *(T.StructField(c, T.BinaryType()) for c in ("words", "start", "length", "item")), T.StructField("names", T.ArrayType(T.StringType()))])


def phrase_blocks(benchmark: DataFrame, key: str = "item_id", text: str = "text", window: int = WINDOW, limit: int = PHRASE_WORDS) -> DataFrame:
    """The items' windows as blocks of packed arrays: ``words`` of all phrases side by side, ``start`` and ``length`` of each phrase, its ``item``; ``names`` of the items; ``size`` in bytes."""

    def packed(block: int, names: list, hashes: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
        start, length, item = [], [], []
        for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            n = max(1, b - a - window + 1) if b > a else 0
            start.append(np.arange(a, a + n))
            length.append(np.full(n, min(window, b - a)))
            item.append(np.full(n, i))
        parts = [hashes.tobytes(), *(np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64).tobytes() for x in (start, length, item))]
        size = sum(map(len, parts)) + sum(len(n or "") + 64 for n in names)
        return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([size]), *(pa.array([x], pa.binary()) for x in parts), pa.array([names], pa.list_(pa.string()))], _BLOCK.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, names, held, bounds = TaskContext.get().partitionId() << 32, [], [], [0]
        for batch in blocks(batches, text):
            hashes, ends = _word_hashes(batch.column(1))
            names += batch.column(0).to_pylist()
            held.append(hashes)
            bounds += (ends[1:] + bounds[-1]).tolist()
            if bounds[-1] >= limit:
                yield packed(block, names, np.concatenate(held), np.array(bounds))
                block, names, held, bounds = block + 1, [], [], [0]
        if names:
            yield packed(block, names, np.concatenate(held), np.array(bounds))

    return benchmark.select(F.col(key).cast("string").alias(key), text).mapInArrow(releasing(run), _BLOCK)


def shared_blocks(phrases: DataFrame, low: int, high: int):
    """A broadcast of the blocks from ``low`` to ``high``."""
    rows = phrases.where(F.col("block").between(low, high)).orderBy("block").collect()
    own = [{"words": np.frombuffer(r["words"], np.uint64), **{c: np.frombuffer(r[c], np.int64) for c in ("start", "length", "item")}, "names": r["names"]} for r in rows]
    return phrases.sparkSession.sparkContext.broadcast(own)


class Segment:
    """Posting lists of one segment."""

    def __init__(self, doc_bounds: bytes, terms: bytes, term_bounds: bytes, postings: bytes):
        self.doc_bounds = np.frombuffer(doc_bounds, np.int64)
        self.terms = np.frombuffer(terms, np.uint64)
        self.term_bounds = np.frombuffer(term_bounds, np.int64)
        self.postings = np.frombuffer(postings, np.int32)
        self.doc = row_of(self.doc_bounds)

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """The segment's number of each term, -1 where it has none."""
        if not len(self.terms):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)

    def list(self, term: int) -> np.ndarray:
        return self.postings[self.term_bounds[term] : self.term_bounds[term + 1]]

    def phrase(self, terms: np.ndarray) -> np.ndarray:
        """Starts where the terms stand consecutively within one document."""
        order = np.argsort(self.term_bounds[terms + 1] - self.term_bounds[terms], kind="stable")
        found = self.list(terms[order[0]]) - order[0]
        found = found[(found >= 0) & (found + len(terms) <= len(self.doc))]
        found = found[self.doc[found] == self.doc[found + len(terms) - 1]] if len(found) else found
        for k in order[1:]:
            if not len(found):
                break
            own = self.list(terms[k])
            at = np.minimum(np.searchsorted(own, found + k), len(own) - 1)
            found = found[own[at] == found + k]
        return found

    def near(self, terms: np.ndarray, slop: int) -> np.ndarray:
        """Positions of the rarest term from which every other term stands at most ``slop`` words away, in the same document."""
        terms = np.unique(terms)
        order = terms[np.argsort(self.term_bounds[terms + 1] - self.term_bounds[terms], kind="stable")]
        found = self.list(order[0])
        for term in order[1:]:
            own = self.list(term)
            ok = np.zeros(len(found), bool)
            at = np.searchsorted(own, found)
            for side in (np.minimum(at, len(own) - 1), np.maximum(at - 1, 0)):
                ok |= (np.abs(own[side] - found) <= slop) & (self.doc[own[side]] == self.doc[found])
            found = found[ok]
        return found


def search(segment: Segment, block: dict, slop: int | None = None) -> list[tuple[int, int, int, bool]]:
    """(item, start in the segment, length, exact) of every phrase of a block; with ``slop`` also the proximity matches."""
    ids = segment.ids(block["words"])
    missing = np.concatenate([[0], np.cumsum(ids < 0)])
    there = np.flatnonzero(missing[block["start"] + block["length"]] == missing[block["start"]])
    out = []
    for p in there:
        start, length, item = block["start"][p], block["length"][p], block["item"][p]
        terms = ids[start : start + length]
        out.extend((item, s, length, True) for s in segment.phrase(terms).tolist())
        if slop is not None:
            out.extend((item, s, 1, False) for s in segment.near(terms, slop).tolist())
    return out


def find_phrases(index: DataFrame, shared, slop: int | None = None, key: str = "doc_id") -> DataFrame:
    """One row per indexed document: its key, ``n_words``, ``n_hit``, ``hits`` (item, start, n_words, exact) and ``items``.

    ``shared``: of :func:`shared_blocks`.  ``n_hit`` counts the document's words inside exact
    matches, once each.
    """
    hit = T.StructType([T.StructField("item", T.StringType()), T.StructField("start", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("exact", T.BooleanType())])
    schema = T.StructType([
        T.StructField(key, index.schema["keys"].dataType.elementType), T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
        T.StructField("hits", T.ArrayType(hit)), T.StructField("items", T.ArrayType(T.StringType())),
    ])
    arrow_hit = pa.list_(pa.struct([("item", pa.string()), ("start", pa.int64()), ("n_words", pa.int64()), ("exact", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                segment = Segment(*(batch.column(c)[i].as_py() for c in range(1, 5)))
                n = len(segment.doc_bounds) - 1
                hits: list[list] = [[] for _ in range(n)]
                cover = np.zeros(len(segment.doc) + 1, np.int64)
                for block in shared.value:
                    for item, start, length, exact in search(segment, block, slop):
                        doc = segment.doc[start]
                        hits[doc].append((block["names"][item], int(start - segment.doc_bounds[doc]), int(length), exact))
                        if exact:
                            cover[start] += 1
                            cover[start + length] -= 1
                inside = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
                items = [sorted({h[0] for h in own if h[3] and h[0] is not None}) for own in hits]
                found = pa.array([[dict(zip(("item", "start", "n_words", "exact"), h, strict=True)) for h in own] for own in hits], arrow_hit)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i].values, pa.array(np.diff(segment.doc_bounds)), pa.array(inside[segment.doc_bounds[1:]] - inside[segment.doc_bounds[:-1]]), found, pa.array(items, pa.list_(pa.string()))],
                    schema.names,
                )

    return index.mapInArrow(releasing(run), schema)


def passes(sizes: list[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    """First and last block of each pass, from (block, bytes) in order; a pass has ``most`` bytes at most, or one block."""
    out, held = [], 0
    for block, size in sizes:
        if out and held + size <= most:
            out[-1], held = (out[-1][0], block), held + size
        else:
            out.append((block, block))
            held = size
    return out


def _together(found: list[DataFrame], key: str) -> DataFrame:
    """The hits of several passes, by ``place``, a row's number."""
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    own = every.groupBy("place").agg(F.first(key).alias(key), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits"))
    exact = F.array_sort(F.transform(F.filter("hits", lambda h: h["exact"]), lambda h: F.struct(h["start"].alias("a"), (h["start"] + h["n_words"]).alias("b"))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("reach"))
    n_hit = F.aggregate(exact, start, lambda s, x: F.struct((s["n"] + F.greatest(x["b"] - F.greatest(x["a"], s["reach"]), F.lit(0))).alias("n"), F.greatest(s["reach"], x["b"]).alias("reach")))["n"]
    items = F.array_sort(F.array_distinct(F.transform(F.filter("hits", lambda h: h["exact"] & h["item"].isNotNull()), lambda h: h["item"])))
    return own.select(key, "n_words", n_hit.alias("n_hit"), "hits", items.alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int | None = None, key: str = "doc_id", text: str = "text", limit: int = PHRASE_WORDS, most: int = SHARED_BYTES) -> DataFrame:
    """:func:`find_phrases` of all benchmark windows over all documents."""
    small_batches(docs.sparkSession)
    tables = Tables(docs.sparkSession)
    phrases = tables.keep("phrases", phrase_blocks(benchmark, text=text, window=window, limit=limit))
    own = passes(sorted((r["block"], r["size"]) for r in phrases.select("block", "size").collect()), most) or [(0, 0)]
    if len(own) == 1:
        return find_phrases(build_index(docs, key, text), shared_blocks(phrases, *own[0]), slop, key)
    named = tables.keep("docs", docs.select(F.monotonically_increasing_id().alias("place"), key, text))
    index = tables.keep("index", build_index(named, "place", text))
    found = []
    for k, (low, high) in enumerate(own):
        shared = shared_blocks(phrases, low, high)
        found.append(tables.keep(f"found{k}", find_phrases(index, shared, slop, "place")))
        shared.destroy()
    tables.drop("index")
    return _together([f.join(named.select("place", key), "place") for f in found], key)


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(list_slice(w, s, s + least(10, len(w)) - 1), ' ') AS gram
       FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS s FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') AS gram
       FROM (SELECT rid, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, ns WHERE len(w) >= n)),
hit AS (SELECT dw.rid, bw.item_id, dw.s, dw.n FROM dw JOIN bw ON dw.gram = bw.gram AND dw.n = bw.n),
cov AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT rid, unnest(generate_series(s, s + n - 1)) AS p FROM hit) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS i FROM hit WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(cov.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(it.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(it.items, '')) AS items_sha256, coalesce(cov.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (rid) LEFT JOIN it USING (rid)
"""
