"""MinHash near-dedup: a signature-coordinate inverted join with exact confirmation.

Documents with the same shingle set are one class, and one node stands for it.  A node's
signature has ``COORDINATES`` minima, and the node is posted under every (coordinate, value)
pair, a token.  A link needs a collision count, the number of equal coordinates, of at least
``matches_for(limit)``; a pair exactly at the limit has fewer with a probability below 1e-7.

Prefix: tokens are ranked by the length of their lists, rarest first.  A pair with T
collisions of K shares one of the K - T + 1 rarest tokens of either side, so only these are
posted, and a node without T tokens that others have as well is in no pair.  A passage that
many documents share makes long lists, but documents that are otherwise unlike leave them.
Skip: of lists with the same members one stays, and a pair is compared only in the first
list where it meets.

Groups of copies are never expanded into pairs.  Every list proposes links from its members
to its smallest node; collisions are counted, each node's best proposal is confirmed on full
sets, then those others that would join two components.  Lists that still hold several
components are cut into tiles of bounded size; each pair of tiles is one row group, where
collisions of pairs from different components are counted on signatures.  Only nodes with a
pair that reaches the threshold have their full sets compared, in blocks of bounded bytes,
and only links that join components come out.

Defined cases: a document with fewer words than a shingle has one shingle, its word
sequence; one without words (null or empty text) has none and is linked with nothing.  A row
with a null key can link others but names no component; where all rows of a component have
none, its component is null and they are kept.  Repeated rows are equal sets and get equal
results.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelane.llm.bytetext import LOWER, SPACE_SEP, Block, blocks, gram_hashes, releasing, small_batches, span_hashes, split_words, utf8_block
from tidelane.llm.checkpoints import Tables
from tidelane.llm.components import connected_components
from tidelane.storage import measured_broadcasts

#: Words of a shingle; percent of the union that linked sets share at least.
SHINGLE, LIMIT = 5, 85

#: Minima of a signature; greatest probability that a pair exactly at the limit has too few collisions.
COORDINATES, MISS = 48, 1e-7

#: Nodes of a tile, about; bytes of full sets on one side of a block.
TILE, BLOCK = 2048, 8 << 20

_SEEDS = (np.random.default_rng(20).integers(1, 1 << 62, COORDINATES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def matches_for(limit: int) -> int:
    """The match threshold: the greatest count that a pair at the limit falls short of with a probability of at most MISS."""
    p, below = limit / 100, 0.0
    for t in range(COORDINATES + 1):
        below += comb(COORDINATES, t) * p**t * (1 - p) ** (COORDINATES - t)
        if below > MISS:
            return max(t, 1)
    return COORDINATES


def shingle_sets(column: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, and the rows' bounds."""
    raw = utf8_block(column)
    block = Block(LOWER[raw.data], raw.bounds)
    words = split_words(block, SPACE_SEP)
    h = span_hashes(block.data, words.start, words.end)
    counts = words.counts
    rows = np.repeat(np.arange(len(counts)), counts)
    whole = np.flatnonzero(rows[: max(len(h) - k + 1, 0)] == rows[k - 1 :]) if len(h) >= k else np.zeros(0, np.int64)
    values, owner = [gram_hashes(h, k)[whole] if len(whole) else np.zeros(0, np.uint64)], [rows[whole]]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        values.append(np.array([gram_hashes(h[words.bounds[r] : words.bounds[r + 1]], int(counts[r]))[0] for r in short], np.uint64))
        owner.append(short)
    values, owner = np.concatenate(values), np.concatenate(owner)
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[new], np.searchsorted(owner[new], np.arange(len(counts) + 1))


def signatures(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE) -> DataFrame:
    """Per row: key, ``print`` (hash of its text), n_shingles, ``node`` (128-bit name of the set, null for an empty one) and ``minima``."""
    schema = T.StructType([
        T.StructField(key, docs.schema[key].dataType), T.StructField("print", T.LongType()), T.StructField("n_shingles", T.LongType()),
        T.StructField("node", T.BinaryType()), T.StructField("minima", T.ArrayType(T.IntegerType())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, text):
            values, bounds = shingle_sets(batch.column(2), k)
            counts = np.diff(bounds)
            full = np.flatnonzero(counts)
            minima = np.zeros((len(full), COORDINATES), np.uint32)
            for j, seed in enumerate(_SEEDS if len(full) else []):
                minima[:, j] = np.minimum.reduceat((values * seed) >> np.uint64(32), bounds[full]).astype(np.uint32)
            names: list = [None] * len(counts)
            for r in full:
                names[r] = hashlib.md5(values[bounds[r] : bounds[r + 1]].tobytes()).digest()
            ends = np.concatenate([[0], np.cumsum((counts > 0) * COORDINATES)]).astype(np.int32)
            packed = pa.ListArray.from_arrays(pa.array(ends), pa.array(minima.ravel().view(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts.astype(np.int64)), pa.array(names, pa.binary()), packed], schema.names)

    return docs.select(key, F.xxhash64(text).alias("print"), text).mapInArrow(releasing(run), schema)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, COORDINATES)


def prefixes(nodes: DataFrame, matches: int) -> DataFrame:
    """(id, prefix): for each node that can be in a pair, its tokens in the prefix of the rarity order; ``nodes``: id, minima."""
    tokens = nodes.select("id", F.posexplode("minima").alias("c", "m")).select("id", (F.shiftleft(F.col("c").cast("long"), 32) + F.col("m")).alias("token"))
    lists = tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    shared = tokens.join(lists, "token").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("t"))  # at most COORDINATES each
    own = F.transform(F.slice("t", F.lit(1), F.size("t") - (matches - 1)), lambda x: x["token"])
    return shared.where(F.size("t") >= matches).select("id", own.alias("prefix"))


def inverted_lists(survivors: DataFrame) -> DataFrame:
    """(token, id, pivot, n) of every list with two members or more, of lists with the same members the first; ``survivors``: id, prefix."""
    posted = survivors.select("id", F.explode("prefix").alias("token"))
    lists = posted.groupBy("token").agg(F.min("id").alias("pivot"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("own")).where("n > 1")
    once = lists.groupBy("pivot", "n", "own").agg(F.min("token").alias("token"))
    return posted.join(once.select("token", "pivot", "n"), "token")


def counted(pairs: DataFrame, survivors: DataFrame, limit: int, matches: int) -> DataFrame:
    """``pairs`` (id, pivot) with ``common``, their collision count, where it reaches the threshold and the sizes of the sets allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                common = (_matrix(batch.column(2)) == _matrix(batch.column(3))).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(common)], ["id", "pivot", "common"])

    side = lambda n: survivors.select(F.col("id").alias(n), F.col("minima").alias(f"m_{n}"), F.col("n_shingles").alias(f"n_{n}"))
    sized = pairs.join(side("id"), "id").join(side("pivot"), "pivot").where(100 * F.least("n_id", "n_pivot") >= limit * F.greatest("n_id", "n_pivot"))
    return sized.select("id", "pivot", "m_id", "m_pivot").mapInArrow(releasing(run), "id long, pivot long, common long").where(F.col("common") >= matches)


def confirmed(pairs: DataFrame, sets: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The (id, pivot) of ``pairs`` whose full sets reach the limit; ``sets``: id, shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (a, b) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                if 100 * shared >= limit * (len(both) - shared):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in (0, 1)], ["id", "pivot"])

    side = lambda n: sets.select(F.col("id").alias(n), F.col("shingles").alias(f"s_{n}"))
    return pairs.select("id", "pivot").join(side("id"), "id").join(side("pivot"), "pivot").select("id", "pivot", "s_id", "s_pivot").mapInArrow(releasing(run), "id long, pivot long")


def full_sets(docs: DataFrame, wanted: DataFrame, key: str, text: str, k: int = SHINGLE) -> DataFrame:
    """(id, shingles) of the wanted nodes, each from the text of one document of it; ``wanted``: id, node, key, print."""
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("shingles", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in blocks(batches, text):
            ids = batch.column(0).to_pylist()
            # Repeated rows stand side by side after the join.
            new = [i for i, own in enumerate(ids) if own != (ids[i - 1] if i else last)]
            last = ids[-1]
            batch = batch.take(pa.array(new, pa.int64()))
            values, bounds = shingle_sets(batch.column(2), k)
            own = [values[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            ok = [i for i, (name, s) in enumerate(zip(batch.column(1).to_pylist(), own, strict=True)) if hashlib.md5(s).digest() == name]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ok, pa.int64())), pa.array([own[i] for i in ok], pa.binary())], schema.names)

    named = wanted.select("id", "node", F.col(key).alias("__key"), F.col("print").alias("__print"))
    rows = docs.select(F.col(key).alias("__own"), text).join(named, (F.xxhash64(text) == F.col("__print")) & F.col("__own").eqNullSafe(F.col("__key")))
    return rows.select("id", "node", text).mapInArrow(releasing(run), schema)


def _by_group(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The runs of rows that agree in the first ``keys`` columns (numbers)."""
    group, now = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        own = np.column_stack([batch.column(c).to_numpy().astype(np.int64) for c in range(keys)])
        cuts = [0, *(np.flatnonzero((own[1:] != own[:-1]).any(axis=1)) + 1), len(own)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if group and tuple(own[a]) != now:
                yield pa.Table.from_batches(group)
                group = []
            now = tuple(own[a])
            group.append(batch.slice(a, b - a))
    if group:
        yield pa.Table.from_batches(group)


def _grouped(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of a group in one task, one group after the other."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)


def _collisions(x: np.ndarray, y: np.ndarray, first: int, px: np.ndarray, py: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision counts of all rows of x with all of y, and whether they meet in a prefix list of a coordinate before ``first``."""
    count, met = np.zeros((len(x), len(y)), np.uint8), np.zeros((len(x), len(y)), bool)
    for c in range(COORDINATES):
        same = x[:, c][:, None] == y[:, c][None, :]
        count += same
        if c < first:
            met |= same & px[:, c][:, None] & py[:, c][None, :]
    return count, met


def open_nodes(members: DataFrame, lists: DataFrame, survivors: DataFrame, limit: int, matches: int, tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """Nodes to compare on full sets, by block: (token, i, j, bi, bj, side, id, component).

    ``members``: token, id, component; ``lists``: token, n.  A list of n members has
    ceil(n / tile) tiles, and each pair of tiles is compared by one task on signatures.
    """
    own = F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")
    placed = members.join(lists.withColumn("tiles", F.ceil(F.col("n") / tile).cast("int")), "token").withColumn("tile", own)
    placed = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    placed = placed.select("token", F.least("tile", "with").alias("i"), F.greatest("tile", "with").alias("j"), "tile", "id", "component")
    rows = placed.join(survivors.select("id", "minima", "prefix", "n_shingles"), "id").select("token", "i", "j", "tile", "id", "component", "minima", "prefix", "n_shingles")
    names = ["token", "i", "j", "bi", "bj", "side", "id", "component"]

    def found(table: pa.Table) -> Iterator[pa.RecordBatch]:
        token, i, j = (table[c][0].as_py() for c in ("token", "i", "j"))
        at, ids, part, size = (table[c].to_numpy() for c in ("tile", "id", "component", "n_shingles"))
        left = np.flatnonzero(at == i)
        right = left if i == j else np.flatnonzero(at == j)
        if not len(left) or not len(right) or (part == part[0]).all():
            return
        x = _matrix(table["minima"].combine_chunks())
        tokens = table["prefix"].combine_chunks()
        posted = np.zeros(x.shape, bool)
        posted[np.repeat(np.arange(len(x)), np.diff(tokens.offsets.to_numpy())), tokens.flatten().to_numpy() + (1 << 31) >> 32] = True
        count, met = _collisions(x[left], x[right], int(token + (1 << 31) >> 32), posted[left], posted[right])
        n, m = size[left][:, None], size[right][None, :]
        good = (count >= matches) & ~met & (part[left][:, None] != part[right][None, :]) & (100 * np.minimum(n, m) >= limit * np.maximum(n, m))
        if left is right:
            good = np.triu(good, 1)
        a, b = np.nonzero(good)
        if not len(a):
            return
        # Blocks of bounded bytes on either side; of each pair of blocks the nodes that have a pair in it.
        blocks_of = lambda rows: ((np.cumsum(size[rows]) * 8) // block).astype(np.int64)
        ba, bb = blocks_of(left)[a], blocks_of(right)[b]
        for side, rows, own in ((0, left, a), (1, right, b)):
            wanted = np.unique(np.column_stack([ba, bb, rows[own]]), axis=0)
            each = lambda v, kind: pa.array(np.full(len(wanted), v), kind)  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays(
                [each(token, pa.int64()), each(i, pa.int32()), each(j, pa.int32()), pa.array(wanted[:, 0].astype(np.int32)), pa.array(wanted[:, 1].astype(np.int32)), each(side, pa.int32()), pa.array(ids[wanted[:, 2]]), pa.array(part[wanted[:, 2]])], names
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_group(batches, 3):
            yield from found(table)

    return _grouped(rows, "token", "i", "j").mapInArrow(releasing(run), "token long, i int, j int, bi int, bj int, side int, id long, component long")


def _between(ids: np.ndarray, parts: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, limit: int) -> list[tuple]:
    """Links that join components among left x right, by full sets."""
    rows = np.concatenate([left, right])
    size = np.array([len(sets[r]) for r in rows])
    flat = np.concatenate([sets[r] for r in rows])
    owner = np.repeat(np.arange(len(rows)), size)
    _, word, many = np.unique(flat, return_inverse=True, return_counts=True)
    common = many[word] > 1
    column = np.cumsum(many > 1)[word[common]] - 1
    owner, width = owner[common], int((many > 1).sum())
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    shared = np.zeros((len(left), len(right)), np.float32)
    step = max(64, (4 << 20) // len(rows))
    for at in range(0, width, step):  # bounded strips of shingles
        a, b = np.searchsorted(column, (at, at + step))
        strip = np.zeros((len(rows), min(step, width - at)), np.float32)
        strip[owner[a:b], column[a:b] - at] = 1
        shared += strip[: len(left)] @ strip[len(left) :].T
    union = size[: len(left), None] + size[len(left) :][None, :] - shared
    good = (parts[left][:, None] != parts[right][None, :]) & (100 * shared >= limit * union)
    out, root = [], {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for a, b in zip(*np.nonzero(good), strict=True):
        x, y = find(parts[left[a]]), find(parts[right[b]])
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((ids[left[a]], ids[right[b]]))
    return out


def block_links(wanted: DataFrame, sets: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(id, pivot): confirmed links that join components, from the blocks of :func:`open_nodes`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_group(batches, 5):
            side, ids, parts = (table[c].to_numpy() for c in ("side", "id", "component"))
            own = [np.frombuffer(s.as_buffer(), np.uint64) for s in table["shingles"]]
            links = _between(ids, parts, own, np.flatnonzero(side == 0), np.flatnonzero(side == 1), limit)
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in links], pa.int64()) for c in (0, 1)], ["id", "pivot"])

    keys = ["token", "i", "j", "bi", "bj"]
    return _grouped(wanted.join(sets, "id").select(*keys, "side", "id", "component", "shingles"), *keys).mapInArrow(releasing(run), "id long, pivot long").distinct()


def _parted(docs: DataFrame, key: str, text: str, limit: int, k: int, tile: int, block: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (key, n_shingles, node), nodes (id, node, key), and the component of every linked node (node, component)."""
    tables, matches = Tables(docs.sparkSession), matches_for(limit)
    rows = tables.keep("rows", signatures(docs, key, text, k))
    first = F.min(F.struct(F.col(key).isNull().alias("unnamed"), F.col(key).alias("key"), "print")).alias("first")
    nodes = rows.where("node IS NOT NULL").groupBy("node").agg(first, F.first("minima").alias("minima"), F.first("n_shingles").alias("n_shingles"))
    nodes = tables.keep("nodes", nodes.select(F.monotonically_increasing_id().alias("id"), "node", F.col("first.key").alias(key), F.col("first.print").alias("print"), "minima", "n_shingles"))
    survivors = tables.keep("survivors", prefixes(nodes, matches).join(nodes, "id"))
    rows, nodes = tables.keep("all", rows.select(key, "n_shingles", "node")), tables.keep("named", nodes.select("id", "node", key))
    tables.drop("rows", "nodes")
    members = tables.keep("members", inverted_lists(survivors))
    pairs = tables.keep("pairs", counted(members.where("id <> pivot").select("id", "pivot").distinct(), survivors, limit, matches))
    sets = tables.keep("sets", full_sets(docs, survivors.join(members.select("id").distinct(), "id", "left_semi"), key, text, k))
    best = pairs.groupBy("id").agg(F.max(F.struct("common", (-F.col("pivot")).alias("other"))).alias("x")).select("id", (-F.col("x.other")).alias("pivot"))
    links = tables.keep("links", confirmed(best, sets, limit))
    part = tables.keep("part", connected_components(links, "id", "pivot"))

    def apart() -> DataFrame:
        """Members of the lists of three and more that still hold several components, and those lists."""
        own = members.join(part.withColumnRenamed("node", "id"), "id", "left").select("token", "id", "n", F.coalesce("component", "id").alias("component"))
        mixed = own.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.first("n").alias("n")).where("low <> high AND n > 2")
        return own.drop("n"), mixed.select("token", "n")

    of = lambda n: part.select(F.col("node").alias(n), F.col("component").alias(f"c_{n}"))
    rest = pairs.join(best, ["id", "pivot"], "left_anti").join(of("id"), "id", "left").join(of("pivot"), "pivot", "left")
    rest = rest.where(F.coalesce("c_id", "id") != F.coalesce("c_pivot", "pivot"))
    more = tables.keep("more", confirmed(rest, sets, limit))
    wanted = tables.keep("wanted", open_nodes(*apart(), survivors, limit, matches, tile, block))
    more = more.unionByName(tables.keep("last", block_links(wanted, sets, limit)))
    if not more.isEmpty():
        part = tables.keep("part2", connected_components(links.unionByName(more), "id", "pivot"))
    tables.drop("survivors", "members", "pairs", "sets", "links", "more", "wanted", "last")
    return rows, nodes, part


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT, k: int = SHINGLE, tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """Per row of ``docs``: key, n_shingles, component_id and kept."""
    small_batches(docs.sparkSession)
    with measured_broadcasts(docs.sparkSession):
        rows, nodes, part = _parted(docs, key, text, limit, k, tile, block)
    # Every row and node meets here: no side is small, whatever its stored size.
    whole = nodes.select("id", "node", key).join(part.withColumnRenamed("node", "id").hint("merge"), "id", "left").select("node", key, F.coalesce("component", "id").alias("component"))
    least = whole.groupBy("component").agg(F.min(key).alias("component_id"))
    named = whole.join(least.hint("merge"), "component").select("node", "component_id")
    found = rows.select(key, "n_shingles", "node").join(named.hint("merge"), "node", "left")
    component_id = F.when(F.col("node").isNull(), F.col(key)).otherwise(F.col("component_id"))
    return found.select(key, "n_shingles", component_id.alias("component_id"), component_id.eqNullSafe(F.col(key)).alias("kept"))


def op3_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP3_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (
        SELECT doc_id, array_to_string(w[p:p + {SHINGLE - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - {SHINGLE - 1}))) AS p FROM d WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {LIMIT} * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id AND r.c < e.b),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(m.component_id, d.doc_id) AS component_id, least(m.component_id, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
