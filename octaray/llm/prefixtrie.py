"""Prefix trie of conversations, summed up by leaf-peeling message passing.

Every conversation c is rebuilt from the head of conversation c - c % 20 and its own turns; every distinct sequence of
first turns is a node. Turns are told apart by md5. A prefix is named by its length and 128 bits that are the xor of its
turns' hashes, each salted with its position: a running aggregate, from which the parent's name follows by one more xor.

Nodes of one path that hold the same conversations form a chain; smallest member and number of members name it, since
two prefixes of one conversation that are equal in number hold the same. Peeling runs on chains, so a long unshared tail
costs no rounds. Chains hold a counter of children that remain. Those without any are complete; each round adds the
complete chains' subtree totals up by parent and sends them there, until only the root finishes. The rounds follow the
number of branchings on a path, the messages the chains that still wait.

A conversation or a parent may hold a great part of all rows: turns are numbered inside ranges of a global sort, and
offsets of the ranges are added; messages are summed before they are shuffled; children are dealt over tasks where they
meet a common parent; the ids of conversations that end at one node are joined in pieces, and only the pieces meet, as a
stream that one hash runs over (a hash takes its bytes in order).

Cases: a null turn comes first, and equal turns are ordered by md5 of role and text; null roles and texts are empty.
Rows with a null conv_id are left out. Repeated rows are turns of their own. An empty table gives no rows. Other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, only_result, read_table, settle, spread_join

GROUP, HEADS = 20, 4
#: Ids of one piece of a node's list of ends.
PIECE = 256
NODE, PARENT, CHAIN = ["depth", "a", "b"], ["up_depth", "up_a", "up_b"], ["conv_id", "n_convs"]
NOTHING = hashlib.sha256(b"").hexdigest()
RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def head(conv: Column, heads: int = HEADS) -> Column:
    return (F.crc32(conv.cast("string")) % heads).cast("int")


def numbered(turns: DataFrame) -> DataFrame:
    """conv, part, pos, total, mark and words: positions from 0 inside each conversation, by ranges of a global sort."""
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = turns.repartitionByRange(parts, F.col("conv"), F.col("turn").asc_nulls_first(), F.col("mark"))
    ranged = settle(ranged.withColumn("part", F.spark_partition_id()))
    each = ranged.groupBy("conv", "part").agg(F.count("*").alias("n"))
    by_part = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    each = each.select("conv", "part", F.coalesce(F.sum("n").over(by_part), F.lit(0)).alias("base"), F.sum("n").over(Window.partitionBy("conv")).alias("total"))
    inside = Window.partitionBy("conv", "part").orderBy(F.col("turn").asc_nulls_first(), "mark")
    return ranged.withColumn("pos", F.row_number().over(inside) - 1).join(each, ["conv", "part"]).select("conv", "part", (F.col("pos") + F.col("base")).alias("pos"), "total", "mark", "words")


def rebuilt(conversations: DataFrame, group: int = GROUP, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """(convs, turns): conv and size of each rebuilt conversation; conv, part, pos, mark and words of its turns."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    mark = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    rows = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv"), "turn", mark.alias("mark"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    own = settle(numbered(rows))
    sizes = own.filter("pos = 0").select("conv", "total")
    lent = own.filter((F.col("conv") % group == 0) & (F.col("pos") < heads - 1)).select(F.col("conv").alias("root"), "pos", "mark", "words")
    takers = sizes.select("conv", (F.col("conv") - F.col("conv") % group).alias("root"), head(F.col("conv"), heads).alias("h"))
    lender = lent.groupBy("root").agg(F.max("pos").alias("last"))  # one row for each group
    convs = sizes.join(takers, "conv").join(lender, "root", "left")
    taken = F.least(F.col("h").cast("long"), F.coalesce(F.col("last") + 1, F.lit(0)))
    convs = settle(convs.select("conv", "root", "h", taken.alias("taken"), (taken + F.greatest(F.lit(0), F.col("total") - F.col("h"))).alias("size")))
    heads_of = convs.join(lent, "root").filter(F.col("pos") < F.col("h")).select("conv", F.lit(-1).alias("part"), "pos", "mark", "words")
    # A conversation's turns need no join: what its head takes is a row of ``convs``, and long ones are dealt over tasks.
    shift = convs.select("conv", "h", "taken")
    counts = own.filter("pos = 0").select("conv", F.col("total").alias("_n"))
    rest = spread_join(own, shift, ["conv"], counts=counts).filter(F.col("pos") >= F.col("h"))
    rest = rest.select("conv", "part", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "mark", "words")
    return convs.select("conv", "size"), heads_of.unionByName(rest)


def prefixes(turns: DataFrame) -> DataFrame:
    """conv, the name of the prefix up to each turn, its parent's name, the turn's words and those before it."""
    salted = settle(turns.withColumn("x", F.xxhash64(F.col("pos").cast("long"), "mark")).withColumn("y", F.xxhash64("mark", F.col("pos").cast("long"))))
    sums = [F.bit_xor("x"), F.bit_xor("y"), F.sum("words")]
    each = salted.groupBy("conv", "part").agg(*[s.alias(n) for s, n in zip(sums, ("gx", "gy", "gw"), strict=True)])
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = each.select("conv", "part", *[F.coalesce(s.over(before), F.lit(0)).alias(n) for s, n in ((F.bit_xor("gx"), "bx"), (F.bit_xor("gy"), "by"), (F.sum("gw"), "bw"))])
    inside = Window.partitionBy("conv", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    run = salted.select("conv", "part", "pos", "x", "y", "words", *[s.over(inside).alias(n) for s, n in zip(sums, ("rx", "ry", "rw"), strict=True)])
    run = run.join(base, ["conv", "part"])
    a, b = F.col("bx").bitwiseXOR(F.col("rx")), F.col("by").bitwiseXOR(F.col("ry"))
    return run.select(
        "conv", (F.col("pos") + 1).cast("long").alias("depth"), a.alias("a"), b.alias("b"), F.col("pos").cast("long").alias("up_depth"),
        a.bitwiseXOR(F.col("x")).alias("up_a"), b.bitwiseXOR(F.col("y")).alias("up_b"), "words", (F.col("bw") + F.col("rw") - F.col("words")).alias("before"),
    )


def nodes_of(convs: DataFrame, prefix: DataFrame) -> DataFrame:
    """Every node: its name, its parent's, smallest member, members, words of its last turn and words before that."""
    root = convs.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    zero, null = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = root.select(*[zero.alias(c) for c in NODE], *[null.alias(c) for c in PARENT], zero.alias("words"), zero.alias("before"), *CHAIN)
    every = prefix.groupBy(*NODE).agg(*[F.min(c).alias(c) for c in (*PARENT, "words", "before")], F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"))
    return root.unionByName(every)


def chains_of(nodes: DataFrame) -> DataFrame:
    """One row for each set of members on a path: ends of the chain, its parent chain, its own saving, its children."""
    top, bottom = F.struct("depth", *PARENT), F.struct(*NODE)
    one = nodes.groupBy(*CHAIN).agg(F.min(top).alias("t"), F.max(bottom).alias("e"), F.count("*").alias("length"), F.min("before").alias("start"), F.max(F.col("before") + F.col("words")).alias("stop"))
    chains = settle(one.select(*CHAIN, F.col("t.depth").alias("top"), *[f"t.{c}" for c in PARENT], *[F.col(f"e.{c}").alias(c) for c in NODE], "length", "start", ((F.col("n_convs") - 1) * (F.col("stop") - F.col("start"))).alias("own")))
    children = settle(chains.filter("up_depth IS NOT NULL").groupBy(*PARENT).agg(F.count("*").alias("_n")))
    # A node whose child has other members ends its chain, so a parent is always found at a chain's end.
    ends = chains.drop(*PARENT).join(children, [F.col(c) == F.col(p) for c, p in zip(NODE, PARENT, strict=True)], "left").select(*CHAIN, *NODE, F.coalesce("_n", F.lit(0)).alias("n_children"))
    ends = settle(ends)
    above = ends.filter("n_children > 0").select(*[F.col(c).alias(p) for c, p in zip(NODE, PARENT, strict=True)], F.col("conv_id").alias("up_conv"), F.col("n_convs").alias("up_n"))
    linked = spread_join(chains.filter("up_depth IS NOT NULL").drop(*NODE), above, PARENT, counts=children)
    columns = [*CHAIN, "top", "length", "start", "own", "up_conv", "up_n"]
    root = chains.filter("up_depth IS NULL").select(*CHAIN, "top", "length", "start", "own", F.lit(None).cast("long").alias("up_conv"), F.lit(None).cast("long").alias("up_n"))
    return linked.select(*columns).unionByName(root).join(ends.select(*CHAIN, "n_children", F.col("depth").alias("bottom")), CHAIN)


def peel(chains: DataFrame) -> DataFrame:
    """CHAIN, n_leaves and saved: subtree totals, by rounds in which complete chains tell their parents."""
    state = [*CHAIN, "up_conv", "up_n", "remaining", "n_leaves", "saved"]
    first = F.col("n_children") == 0
    at = settle(chains.select(*CHAIN, "up_conv", "up_n", F.col("n_children").cast("long").alias("remaining"), first.cast("long").alias("n_leaves"), F.col("own").alias("saved")))
    done, open_ = at.filter("remaining = 0"), at.filter("remaining > 0")
    out = [done]
    while not open_.isEmpty():
        told = done.groupBy(F.col("up_conv").alias("conv_id"), F.col("up_n").alias("n_convs")).agg(F.count("*").alias("_c"), F.sum("n_leaves").alias("_l"), F.sum("saved").alias("_s"))
        heard = open_.join(told, CHAIN, "left")
        after = settle(heard.select(*CHAIN, "up_conv", "up_n", *[(F.col(n) + s * F.coalesce(m, F.lit(0))).alias(n) for n, s, m in (("remaining", -1, "_c"), ("n_leaves", 1, "_l"), ("saved", 1, "_s"))]))
        done, open_ = after.filter("remaining = 0"), after.filter("remaining > 0")
        out.append(done)
    every = out[0].select(*state)
    for d in out[1:]:
        every = every.unionByName(d.select(*state))
    return every.select(*CHAIN, "n_leaves", "saved")


def ends_of(convs: DataFrame, prefix: DataFrame) -> DataFrame:
    """NODE and ends_sha256 of the nodes at which conversations end."""
    ended = prefix.join(convs.withColumnRenamed("size", "depth"), ["conv", "depth"], "left_semi").select(*NODE, "conv")
    zero = F.lit(0).cast("long")
    ended = ended.unionByName(convs.filter("size = 0").select(*[zero.alias(c) for c in NODE], "conv"))
    parts = int(convs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, found = None, [], []

        def cut():
            if ids:
                found.append((*at, ids[0], ",".join(map(str, ids))))
                ids.clear()

        for batch in batches:
            names = zip(*(batch.column(c).to_pylist() for c in NODE), strict=True)
            for name, conv in zip(names, batch.column("conv").to_pylist(), strict=True):
                if name != at or len(ids) >= PIECE:
                    cut()
                    at = name
                ids.append(conv)
            yield _pieces(found)
            found = []
        cut()
        yield _pieces(found)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            found = []
            names = zip(*(batch.column(c).to_pylist() for c in NODE), strict=True)
            for name, ids in zip(names, batch.column("ids").to_pylist(), strict=True):
                if name != at:
                    if state is not None:
                        found.append((*at, state.hexdigest()))
                    at, state = name, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield _digests(found)
        if state is not None:
            yield _digests([(*at, state.hexdigest())])

    sorted_ = ended.repartitionByRange(parts, *NODE, "conv").sortWithinPartitions(*NODE, "conv")
    pieces = sorted_.mapInArrow(joined, "depth long, a long, b long, first long, ids string")
    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(hashed, "depth long, a long, b long, ends_sha256 string")


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.string())], names=[*NODE, "first", "ids"])


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], names=[*NODE, "ends_sha256"])


@only_result
def prefix_trie(conversations: DataFrame, group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """One row for each node (see RESULT)."""
    convs, turns = rebuilt(conversations, group, heads)
    prefix = settle(prefixes(turns))
    nodes = settle(nodes_of(convs, prefix))
    chains = settle(chains_of(nodes))
    told = settle(chains.join(peel(chains), CHAIN))
    found = spread_join(nodes, told.drop("own"), CHAIN, counts=told.select(*CHAIN, F.col("length").alias("_n")))
    inner, last = F.col("depth") > F.col("top"), F.col("depth") == F.col("bottom")
    ends = settle(ends_of(convs, prefix))
    out = found.join(ends, NODE, "left")
    return out.select(
        "conv_id", "depth", F.when(inner, F.col("conv_id")).otherwise(F.col("up_conv")).alias("parent_conv_id"), "n_convs",
        F.when(last, F.col("n_children")).otherwise(1).cast("long").alias("n_children"), "n_leaves",
        (F.col("saved") - (F.col("n_convs") - 1) * (F.col("before") - F.col("start"))).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"),
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(read_table(spark, sf_dir, "conversations"))


OP12_SQL = r"""
WITH own AS (
  SELECT conv_id AS c, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS mark,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS words, turn FROM conversations WHERE conv_id IS NOT NULL
), placed AS (SELECT c, mark, words, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, mark) - 1 AS pos FROM own
), convs AS (
  SELECT c, c - c % 20 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda r, x: list_reduce(list_prepend(xor(r, x), range(8)), lambda y, i: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT c FROM own)
), heads AS (SELECT v.c, p.pos, p.mark, p.words FROM convs v JOIN placed p ON p.c = v.base AND p.pos < v.h
), taken AS (SELECT c, count(*) AS k FROM heads GROUP BY c
), turns AS (
  SELECT * FROM heads
  UNION ALL SELECT p.c, p.pos - v.h + coalesce(t.k, 0) AS pos, p.mark, p.words FROM placed p JOIN convs v USING (c) LEFT JOIN taken t USING (c) WHERE p.pos >= v.h
), prefix AS (
  SELECT c, pos + 1 AS depth, string_agg(mark, '') OVER (PARTITION BY c ORDER BY pos ROWS UNBOUNDED PRECEDING) AS name, words FROM turns
  UNION ALL SELECT c, 0, '', 0 FROM convs
), node AS (SELECT name, any_value(depth) AS depth, min(c) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM prefix GROUP BY name
), sizes AS (SELECT c, max(depth) AS size FROM prefix GROUP BY c
), ends AS (SELECT name, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM prefix JOIN sizes USING (c) WHERE depth = size GROUP BY name
), kids AS (SELECT substr(name, 1, length(name) - 32) AS name, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY 1
), line AS (
  SELECT substr(n.name, 1, 32 * u.d::INT) AS name, (n.n_convs - 1) * n.words AS saved, (k.n_children IS NULL)::INT AS leaf
  FROM node n LEFT JOIN kids k USING (name), LATERAL (SELECT unnest(range(n.depth + 1)) AS d) u
), subtree AS (SELECT name, sum(saved)::BIGINT AS saved_tokens, sum(leaf)::BIGINT AS n_leaves FROM line GROUP BY name)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM node n JOIN subtree s USING (name) LEFT JOIN kids k USING (name) LEFT JOIN ends e USING (name)
LEFT JOIN node p ON n.depth > 0 AND p.name = substr(n.name, 1, length(n.name) - 32)
"""
