"""The trie of conversation prefixes, with the statistics of every node's subtree.

A Patricia construction in DataFrames.  Turns are sorted into their conversations and every
prefix is named by its depth and 128 bits of running hash.  Of the prefixes only points are
created: where the next turns differ, where a conversation ends (leaves are ends), and the
root; the edge from one point to the next holds the prefixes between them, which have one
child and the same members.  Aggregates are made on this compressed tree.  A node belongs to
its smallest member, and the nodes of a conversation are the lowest stretch of its path, so a
subtree's sum is the sum of its members' stretches, less what of the owner's own stretch lies
above: no walk from level to level.  At last the edges' inner nodes are expanded: they take
what their lower point has, and sums of the edge from there up.

Defined cases: a null conv_id is no conversation.  Turns are ordered by turn (null first),
then role and text, so equal turns stand next to each other and repeated rows count as turns
of their own.  Null roles and texts are empty.  A conversation without turns is a member of
the root and ends there.  Without conversations there are no nodes.  Texts of any length are
hashed whole and not moved further.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelane.llm.checkpoints import Tables
from tidelane.llm.sampling import CRC_STEP, crc_sql
from tidelane.scan import dense_numbers, running


def ordered_turns(conversations: DataFrame, tables: Tables) -> DataFrame:
    """(conv, p, role, text, n): the turns of each conversation numbered from 1, and how many it has."""
    plain = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv"), "turn", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    rows = dense_numbers(plain, [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], "row", tables=tables)
    first = rows.groupBy("conv").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    return tables.keep("ordered", rows.join(first, "conv").select("conv", (F.col("row") - F.col("first") + 1).alias("p"), "role", "text", "n"))


def branch_off(turns: DataFrame, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of another one: ids, and (conv, depth, role, text).

    Of conversation c - c mod ``every`` the first h turns, then c's own after its first h, where
    h is crc32 of c's digits modulo ``most``.
    """
    convs = turns.where("p = 1").select("conv", "n", (F.crc32(F.col("conv").cast("string").cast("binary")) % most).alias("h"), (F.col("conv") - F.pmod("conv", F.lit(every))).alias("base"))
    had = convs.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(had, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    shared = turns.where((F.col("p") < most) & (F.pmod("conv", F.lit(every)) == 0)).select(F.col("conv").alias("base"), "p", "role", "text")
    heads = convs.join(shared, "base").where("p <= h").select("conv", F.col("p").alias("depth"), "role", "text")
    tails = turns.join(convs.select("conv", "h", "taken"), "conv").where("p > h").select("conv", (F.col("p") - F.col("h") + F.col("taken")).alias("depth"), "role", "text")
    return convs.select("conv"), heads.unionByName(tails)


def _half(digest: Column, at: int) -> Column:
    return F.conv(F.substring(digest, at, 16), 16, -10).cast("long")


def id_list_hashes(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """``key`` (integers) and ``ends_sha256``: SHA-256 of each key's ``value`` numbers in ascending order, joined by commas.

    Values are sorted in ranges and joined a batch at a time; then a key's pieces pass through
    one hash in order, as a stream.
    """
    names = [*key, "first"]
    order = [F.col(c) for c in (*key, value)]
    kinds = ", ".join(f"{c} long" for c in names)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            new = np.any([c[1:] != c[:-1] for c in columns[:-1]], axis=0)
            cuts = np.concatenate([[0], np.flatnonzero(new) + 1, [batch.num_rows]])
            ids = columns[-1].tolist()
            texts = [",".join(map(str, ids[a:b])) for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([*(pa.array(c[cuts[:-1]]) for c in columns), pa.array(texts)], [*names, "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, digest = None, None
        for batch in batches:
            done: list[tuple] = []
            for *own, ids in zip(*(batch.column(c).to_pylist() for c in (*key, "ids"))):
                if own == open_key:
                    digest.update(b"," + ids.encode())
                    continue
                if digest is not None:
                    done.append((*open_key, digest.hexdigest()))
                open_key, digest = own, hashlib.sha256(ids.encode())
            yield rows_of(done)
        if digest is not None:
            yield rows_of([(*open_key, digest.hexdigest())])

    def rows_of(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done)) or [[] for _ in (*key, "sha")]
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:-1]), pa.array(columns[-1], pa.string())], [*key, "ends_sha256"])

    pieces = rows.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(joined, f"{kinds}, ids string")
    return pieces.repartition(*key).sortWithinPartitions(*names).mapInArrow(hashed, ", ".join(f"{c} long" for c in key) + ", ends_sha256 string")


def prefix_trie(convs: DataFrame, turns: DataFrame, tables: Tables | None = None) -> DataFrame:
    """A row per distinct prefix of the conversations ``turns`` (conv, depth from 1, role, text); ``convs`` (conv) also names those without turns.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens (over the subtree: members but one times code points of the last text) and
    ends_sha256 (of the sorted ids of the conversations that end here).
    """
    tables = tables or Tables(convs.sparkSession)
    node, zero = ["depth", "p", "q"], F.lit(0).cast("long")
    digest = F.md5(F.concat_ws(":", "depth", F.length("role"), "role", "text").cast("binary"))
    marked = turns.select("conv", F.col("depth").cast("long").alias("depth"), digest.alias("digest"), F.length("text").cast("long").alias("chars"))
    marked = tables.keep("marked", marked.select("conv", "depth", _half(F.col("digest"), 1).alias("a"), _half(F.col("digest"), 17).alias("b"), "chars"))
    path = running(marked, "conv", "depth", {"p": ("bit_xor", "a"), "q": ("bit_xor", "b"), "upto": ("sum", "chars")})
    root = convs.select("conv", *(zero.alias(c) for c in ("depth", "a", "b", "chars", "p", "q", "upto")))
    path = tables.keep("path", path.select(root.columns).unionByName(root))
    tables.drop("marked")

    # Points: a prefix is created only where its next turns differ or a member ends.
    member = path.select(*node, "conv", "chars", F.lit(None).cast("struct<p: long, q: long>").alias("next"))
    above = F.col("p").bitwiseXOR(F.col("a")), F.col("q").bitwiseXOR(F.col("b"))
    going = path.where("depth > 0").select((F.col("depth") - 1).alias("depth"), above[0].alias("p"), above[1].alias("q"), F.lit(None).cast("long").alias("conv"), F.lit(None).cast("long").alias("chars"), F.struct("p", "q").alias("next"))
    points = member.unionByName(going).groupBy(*node).agg(F.count("conv").alias("n_convs"), F.count("next").alias("n_on"), F.min("conv").alias("owner"), F.max("chars").alias("last_chars"), F.min("next").alias("one"), F.max("next").alias("other"))
    points = points.where((F.col("n_convs") > F.col("n_on")) | (F.col("one") != F.col("other")) | (F.col("depth") == 0))
    points = tables.keep("points", points.select(*node, "n_convs", (F.col("n_convs") - F.col("n_on")).alias("n_ends"), (F.col("n_on") == 0).alias("leaf"), "owner", "last_chars"))

    # The points on the paths of the conversations that own nodes, each with the point before it.
    owners = points.select(F.col("owner").alias("conv")).distinct()
    owned_path = tables.keep("owned_path", path.join(owners, "conv", "left_semi").select("conv", *node, "chars", "upto"))
    met = owned_path.join(points, node).select("conv", *node, "upto", "n_convs", "n_ends", "leaf", "owner", "last_chars", F.struct("depth", "owner", "upto").alias("here"))
    met = running(tables.keep("met", met), "conv", "depth", {"before": ("max", "here")}, this_row=False)
    own = F.col("owner") == F.col("conv")
    edge = (F.col("n_convs") - 1) * (F.col("upto") - F.coalesce("before.upto", zero))
    met = tables.keep("edges", met.drop("here").withColumns({"own": own, "edge": F.when(own, edge).otherwise(zero)}))
    met = tables.keep("sums", running(met, "conv", "depth", {"down_to": ("sum", "edge")}))

    # The compressed tree's aggregates.
    stretch = met.groupBy("conv").agg(F.sum("edge").alias("stretch"), F.sum((F.col("own") & F.col("leaf")).cast("long")).alias("leaves"))
    passing = met.select("conv", "owner", "depth").join(stretch, "conv").select("owner", "depth", "stretch", "leaves", zero.alias("children"))
    hung = met.where("own AND before IS NOT NULL").select("before.owner", "before.depth", zero.alias("stretch"), zero.alias("leaves"), F.lit(1).cast("long").alias("children"))
    inside = passing.unionByName(hung).groupBy("owner", "depth").agg(*(F.sum(c).alias(c) for c in ("stretch", "leaves", "children")))
    lengths = path.groupBy("conv").agg(F.max("depth").alias("depth"))
    ending = path.select("conv", *node).join(lengths, ["conv", "depth"]).select(*node, "conv")
    whole = met.where("own").drop("conv").join(inside, ["owner", "depth"]).join(id_list_hashes(ending, node, "conv"), node, "left")
    saved = F.col("stretch") - F.col("down_to") + (F.col("n_convs") - 1) * F.col("last_chars")
    low = F.struct("depth", "n_convs", "leaves", "children", saved.alias("saved"), (F.col("upto") - F.col("last_chars")).alias("until"), F.coalesce("before.depth", F.lit(-1)).alias("top"), F.col("before.owner").alias("top_owner"), "ends_sha256")

    # Inner nodes of the edges.
    filled = owned_path.join(whole.select(F.col("owner").alias("conv"), "depth", low.alias("low")), ["conv", "depth"], "left")
    filled = running(tables.keep("filled", filled), "conv", "depth", {"at": ("min", "low")}, backwards=True)
    point = F.col("depth") == F.col("at.depth")
    nothing = hashlib.sha256(b"").hexdigest()
    return filled.where("depth > at.top").select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.when(F.col("depth") == F.col("at.top") + 1, F.col("at.top_owner")).otherwise(F.col("conv")).alias("parent_conv_id"),
        F.col("at.n_convs").alias("n_convs"),
        F.when(point, F.col("at.children")).otherwise(F.lit(1)).cast("long").alias("n_children"),
        F.col("at.leaves").alias("n_leaves"),
        (F.col("at.saved") + (F.col("at.n_convs") - 1) * (F.col("at.until") - F.col("upto") + F.col("chars"))).alias("saved_tokens"),
        F.coalesce(F.when(point, F.col("at.ends_sha256")), F.lit(nothing)).alias("ends_sha256"),
    )


OP13_SQL = f"""
WITH {CRC_STEP}, own AS MATERIALIZED (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL
), size AS (SELECT c, n, base, {crc_sql("c::VARCHAR")} % 6 AS h FROM (SELECT c, count(*) AS n, c - ((c % 100) + 100) % 100 AS base FROM own GROUP BY c), step),
built AS (SELECT s.c, s.h, s.base, least(s.h, coalesce(b.n, 0)) AS k FROM size s LEFT JOIN size b ON b.c = s.base),
turn AS (
  SELECT b.c, o.p AS d, role, text FROM built b JOIN own o ON o.c = b.base AND o.p <= b.h
  UNION ALL SELECT b.c, o.p - b.h + b.k, role, text FROM built b JOIN own o ON o.c = b.c AND o.p > b.h
), path AS MATERIALIZED (
  SELECT c, d, length(text) AS chars, md5(string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY c ORDER BY d)) AS k FROM turn
  UNION ALL SELECT c, 0, 0, '' FROM size
), node AS MATERIALIZED (SELECT k, d, min(c) AS c, count(*) AS n, any_value(chars) AS chars FROM path GROUP BY k, d),
up AS MATERIALIZED (SELECT DISTINCT a.k, a.d, b.k AS pk FROM path a JOIN path b ON b.c = a.c AND b.d = a.d - 1),
child AS (SELECT pk, d - 1 AS pd, count(*) AS m FROM up GROUP BY ALL),
sums AS (
  SELECT p.k, p.d, count(*) FILTER (WHERE m IS NULL) AS leaves, sum((u.n - 1) * u.chars) AS saved
  FROM node u JOIN path p ON p.c = u.c AND p.d <= u.d LEFT JOIN child ON child.pk = u.k AND child.pd = u.d GROUP BY p.k, p.d
), ends AS (SELECT k, d, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS sha FROM path JOIN (SELECT c, max(d) AS d FROM path GROUP BY c) USING (c, d) GROUP BY k, d)
SELECT n.c AS conv_id, n.d::BIGINT AS depth, q.c AS parent_conv_id, n.n AS n_convs, coalesce(m, 0)::BIGINT AS n_children, leaves AS n_leaves,
  saved::BIGINT AS saved_tokens, coalesce(sha, sha256('')) AS ends_sha256
FROM node n JOIN sums USING (k, d) LEFT JOIN child ON child.pk = n.k AND child.pd = n.d LEFT JOIN ends e ON e.k = n.k AND e.d = n.d
  LEFT JOIN up ON up.k = n.k AND up.d = n.d LEFT JOIN node q ON q.k = up.pk AND q.d = n.d - 1
"""


def op13_conversation_trie(spark, sf_dir: str) -> DataFrame:
    tables = Tables(spark)
    turns = ordered_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"), tables)
    tables.drop("row_ranges")
    convs, rebuilt = branch_off(turns)
    return prefix_trie(convs, rebuilt, tables)
