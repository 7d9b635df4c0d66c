"""Trie of conversation prefixes by van Emde Boas recursion.

Conversations are first rebuilt: with h = crc32(decimal id) % 9, conversation c becomes the
first h turns of conversation c - c % 5 (all, if it has fewer; none, if there is none) and
its own turns behind its first h. Every distinct sequence of first turns is a node.

A sequence of up to 2**k turns, the textless root being the first, is cut at half depth; the
upper halves are a trie, the lower halves under one cut prefix are another, and all of these
are cut in turn, those of one size in the same Spark job:

* up: a block of turns is named by a hash of the names of its halves;
* down: a block's tree is named by the sequence before it. The upper half is in the same
  tree, the lower half in the tree named by that and by the upper half's block. Where blocks
  are single turns, tree and turn name the node;
* up again: in tries of single turns a subtree's total is the node's own value. When two
  sizes join, the totals of the lower forests are added up per cut prefix and grafted on:
  every node of the upper half above the cut adds them.

So a sequence of n turns takes log2(n) rounds instead of n, each a join or aggregation by
(conversation, block) or node, and a node passes its total to its ancestors within half a
block a round instead of to all of them.

Names are SHA-256 digests. A conversation may hold any share of the turns, a node any share
of the conversations: turns get positions by ranges, groups are aggregated before they are
shuffled, and the ids that end at a node are hashed as a sorted stream that no task holds.

Cases: turns are ordered by turn, null first, then by a hash of role and text; null role or
text is empty; repeated rows are turns of their own; rows without a conv_id belong to no
conversation and are left out; a negative id has the remainder that SQL gives it; a
conversation without turns left is a member of the root alone; an empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterproof.llm.common import meet, sql_crc32, staged
from rosterproof.llm.ordering import numbered

#: Ids that are joined before they are hashed.
RUN = 4096


def rebuilt(conversations: DataFrame, borrowed=9, family=5) -> DataFrame:
    """Turns of the rebuilt conversations: conv, at (from 1), symbol, bytes; and a row with
    at 0 for every conversation. ``last`` marks a conversation's last row."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    symbol = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv"),
        "turn",
        F.unhex(F.sha2(F.encode(symbol, "UTF-8"), 256)).alias("symbol"),
        F.octet_length(text).cast("long").alias("bytes"),
        F.monotonically_increasing_id().alias("row"),
    ).where("conv is not null")
    order = [F.asc("conv"), F.asc_nulls_first("turn"), F.asc("symbol"), F.asc("row")]
    turns = numbered(staged(turns, "trie-turns"), order, "trie-order").drop("turn", "row")

    own = turns.groupBy("conv").agg(F.min("position").alias("first"), F.count(F.lit(1)).alias("n"))
    crc = F.crc32(F.encode(F.col("conv").cast("string"), "UTF-8"))
    own = own.withColumns({"h": (crc % borrowed).cast("long"), "base": F.col("conv") - F.col("conv") % family})
    own = staged(own, "trie-own")
    bases = own.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    taken = F.least("h", F.coalesce("base_n", F.lit(0)))
    plan = own.join(bases, "base", "left").select(
        "conv",
        "base",
        "first",
        "h",
        taken.alias("taken"),
        (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"),
    )
    plan = staged(plan, "trie-plan")
    mine = meet(turns, plan, "conv").withColumn("t", F.col("position") - F.col("first"))
    kept = mine.where("t >= h").select(
        "conv", (F.col("taken") + F.col("t") - F.col("h") + 1).alias("at"), "symbol", "bytes", "length"
    )
    # The turns that others may borrow: fewer than ``borrowed`` of every conversation.
    lent = (
        meet(turns, own.select("conv", "first"), "conv")
        .withColumn("t", F.col("position") - F.col("first"))
        .where(F.col("t") < borrowed - 1)
        .select(F.col("conv").alias("base"), "t", "symbol", "bytes")
    )
    lent = plan.select("conv", "base", "h", "length").join(lent, "base").where("t < h")
    lent = lent.select("conv", (F.col("t") + 1).alias("at"), "symbol", "bytes", "length")
    root = plan.select(
        "conv",
        F.lit(0).cast("long").alias("at"),
        F.lit(b"").alias("symbol"),
        F.lit(0).cast("long").alias("bytes"),
        "length",
    )
    rows = root.unionByName(kept).unionByName(lent)
    return rows.withColumn("last", F.col("at") == F.col("length")).drop("length")


def _name(left, right):
    """Name of two things together; either may be null or of any length."""
    return F.unhex(F.sha2(F.concat(F.unhex(F.sha2(left, 256)), right), 256))


def named(turns: DataFrame) -> tuple[DataFrame, int]:
    """``turns`` with ``node``, the name of the prefix that ends in the turn, and the number
    of halvings."""
    deepest = turns.agg(F.max("at")).first()[0]
    halvings = 0 if deepest is None else int(deepest).bit_length()
    # Up: blocks of 1, 2, 4, ... turns; only the upper half of a pair is ever asked for.
    blocks = turns.select("conv", F.col("at").alias("block"), F.col("symbol").alias("name"))
    uppers = []
    for k in range(halvings):
        half = F.col("block") % 2
        if k:
            blocks = staged(blocks, f"trie-blocks-{k}")
        uppers.append(blocks.where(half == 0))
        if k + 1 < halvings:
            left = F.max(F.when(half == 0, F.col("name")))
            right = F.max(F.when(half == 1, F.col("name")))
            pair = blocks.groupBy("conv", F.shiftright("block", 1).alias("block")).agg(
                left.alias("left"), right.alias("right")
            )
            # Without a right half no lower half of a larger block asks for the name.
            blocks = pair.where("right is not null").select(
                "conv", "block", _name(F.col("left"), F.col("right")).alias("name")
            )
    # Down: the tree of each block, from the whole sequence to single turns.
    ends = turns.groupBy("conv").agg(F.max("at").alias("end"))
    trees = ends.select("conv", "end", F.lit(0).cast("long").alias("block"), F.lit(b"").alias("tree"))
    for k in reversed(range(halvings)):
        upper = uppers[k].select(F.col("conv").alias("__c"), F.col("block").alias("__b"), "name")
        # A block reaches into its lower half where its sequence does.
        first = F.shiftleft(F.col("block") * 2 + 1, k)
        below = trees.where(first <= F.col("end"))
        lower = below.join(
            upper, (F.col("conv") == F.col("__c")) & (F.col("block") * 2 == F.col("__b"))
        ).select(
            "conv", "end", (F.col("block") * 2 + 1).alias("block"), _name(F.col("tree"), F.col("name")).alias("tree")
        )
        trees = staged(trees.withColumn("block", F.col("block") * 2).unionByName(lower), f"trie-trees-{k}")
    at_turn = trees.select("conv", F.col("block").alias("at"), "tree")
    return turns.join(at_turn, ["conv", "at"]).withColumn("node", _name(F.col("tree"), F.col("symbol"))), halvings


def _hash_ids(batches):
    """Arrow function: runs (node, ids), sorted by node and first id -> SHA-256 per node."""
    schema = pa.schema([("node", pa.binary()), ("ends_sha256", pa.string())])
    node, state = None, None
    for b in batches:
        done = []
        for name, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if name == node:
                state.update(b",")
            else:
                if node is not None:
                    done.append((node, state.hexdigest()))
                node, state = name, hashlib.sha256()
            state.update(ids.encode())
        if done:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)
    if node is not None:
        columns = [pa.array([node], pa.binary()), pa.array([state.hexdigest()])]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


def _runs(most: int):
    """Arrow function: (node, conv) sorted -> runs (node, first, ids) of at most ``most`` ids."""
    schema = pa.schema([("node", pa.binary()), ("first", pa.int64()), ("ids", pa.string())])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def run(batches):
        node, ids = None, []
        for b in batches:
            done = []
            for name, conv in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if ids and (name != node or len(ids) == most):
                    done.append((node, ids[0], ",".join(map(str, ids))))
                    ids = []
                node = name
                ids.append(conv)
            if done:
                yield batch(done)
        if ids:
            yield batch([(node, ids[0], ",".join(map(str, ids)))])

    return run


def ends(names: DataFrame) -> DataFrame:
    """(node, ends_sha256): hash of the ids of the conversations that end at each node.

    Ids are sorted by ranges and joined in runs; the runs of a node pass its hash as a
    sorted stream, a row for every 4,096 ids.
    """
    last = staged(names.where("last").select("node", "conv"), "trie-ends")
    runs = last.repartitionByRange("node", "conv").sortWithinPartitions("node", "conv")
    runs = runs.mapInArrow(_runs(RUN), "node binary, first long, ids string")
    return (
        runs.repartition("node")
        .sortWithinPartitions("node", "first")
        .select("node", "ids")
        .mapInArrow(_hash_ids, "node binary, ends_sha256 string")
    )


def subtree_totals(nodes: DataFrame, names: DataFrame, halvings: int) -> DataFrame:
    """(node, n_leaves, saved_tokens) over each node's subtree, grafted up size by size.

    ``nodes``: node, parent, at, conv (a member), leaf and saved (its own values);
    ``names``: conv, at, node.
    """
    totals = nodes.select("node", "parent", "at", "conv", F.col("leaf").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    for k in range(halvings):
        size = 1 << k
        # Lower halves begin where bit k of the depth is set and the bits below are not.
        tops = totals.where(F.col("at") % (2 * size) == size)
        below = tops.groupBy("parent").agg(
            F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"), F.min("conv").alias("of"), F.min("at").alias("cut")
        )
        # The nodes above a cut are those of any one sequence through it.
        above = names.where(F.col("at") % (2 * size) < size).select(
            F.col("conv").alias("of"), (F.floor(F.col("at") / (2 * size)) * (2 * size) + size).cast("long").alias("cut"), F.col("node").alias("__node")
        )
        grafts = (
            above.join(below, ["of", "cut"])
            .groupBy("__node")
            .agg(F.sum("more_leaves").alias("more_leaves"), F.sum("more_saved").alias("more_saved"))
        )
        more = totals.join(grafts, F.col("node") == F.col("__node"), "left")
        totals = staged(
            more.select(
                "node",
                "parent",
                "at",
                "conv",
                (F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"),
                (F.col("saved_tokens") + F.coalesce("more_saved", F.lit(0))).alias("saved_tokens"),
            ),
            f"trie-totals-{k}",
        )
    return totals.select("node", "n_leaves", "saved_tokens")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256."""
    turns = staged(rebuilt(conversations), "trie-rebuilt")
    names, halvings = named(turns)
    names = staged(names.select("conv", "at", "node", "bytes", "last"), "trie-names")
    own = names.groupBy("node").agg(
        F.min("conv").alias("conv"),
        F.min("at").alias("at"),
        F.count(F.lit(1)).alias("n_convs"),
        F.max("bytes").alias("bytes"),
    )
    own = staged(own, "trie-nodes")
    up = names.select(
        F.col("conv").alias("__c"), (F.col("at") + 1).alias("__a"), F.col("node").alias("parent")
    )
    linked = own.join(up, (F.col("conv") == F.col("__c")) & (F.col("at") == F.col("__a")), "left")
    above = own.select(F.col("node").alias("parent"), F.col("conv").alias("parent_conv_id"))
    linked = linked.drop("__c", "__a")
    children = linked.where("parent is not null").groupBy("parent").agg(F.count(F.lit(1)).alias("n_children"))
    children = children.withColumnRenamed("parent", "node")
    saved = (F.col("n_convs") - 1) * F.col("bytes")
    none = F.lit(0).cast("long")
    nodes = linked.join(children, "node", "left").withColumns(
        {
            "n_children": F.coalesce("n_children", none),
            "leaf": F.col("n_children").isNull().cast("long"),
            "saved": saved,
        }
    )
    nodes = staged(nodes, "trie-linked")
    totals = subtree_totals(nodes, names, halvings)
    nothing = hashlib.sha256(b"").hexdigest()
    return (
        nodes.join(totals, "node")
        .join(ends(names), "node", "left")
        .join(above, "parent", "left")
        .select(
            F.col("conv").alias("conv_id"),
            F.col("at").alias("depth"),
            "parent_conv_id",
            "n_convs",
            "n_children",
            "n_leaves",
            "saved_tokens",
            F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
        )
    )


SQL = f"""
with said as (
  select conv_id::bigint as c, turn, coalesce(role, '') as r, coalesce(text, '') as x
  from conversations where conv_id is not null),
signed as (select *, sha256(strlen(r) || ':' || r || x) as sym, strlen(x) as b from said),
turns as (
  select *, row_number() over (partition by c order by turn nulls first, sym) - 1 as t from signed),
own as (
  select c, n, h, c - c % 5 as base from (
    select c, count(*) as n, {sql_crc32("c::varchar")} % 9 as h from turns group by c)),
plan as (
  select o.*, least(o.h, coalesce(b.n, 0)) as taken from own o left join own b on b.c = o.base),
built as (
  select c, 0 as d, '' as sym, 0 as b from own
  union all
  select p.c, t.t + 1, t.sym, t.b from plan p join turns t on t.c = p.base where t.t < p.h
  union all
  select p.c, p.taken + t.t - p.h + 1, t.sym, t.b from plan p join turns t on t.c = p.c where t.t >= p.h),
names as (
  select c, d, b, d = max(d) over (partition by c) as last,
         sha256(string_agg(sym, ',') over (partition by c order by d rows unbounded preceding)) as node
  from built),
nodes as (
  select node, min(c) as c, min(d) as d, count(*) as n, max(b) as b,
         string_agg(c::varchar, ',' order by c) filter (where last) as ends
  from names group by node),
linked as (
  select n.*, p.node as parent from nodes n left join names p on p.c = n.c and p.d = n.d - 1),
counted as (
  select l.*, coalesce(k.k, 0) as k from linked l
  left join (select parent, count(*) as k from linked where parent is not null group by parent) k
    on k.parent = l.node),
totals as (
  select a.node, sum((u.k = 0)::bigint) as leaves, sum((u.n - 1) * u.b) as saved
  from counted u join names a on a.c = u.c and a.d <= u.d group by a.node)
select n.c as conv_id, n.d::bigint as depth, p.c as parent_conv_id, n.n as n_convs, n.k as n_children,
       t.leaves::bigint as n_leaves, t.saved::bigint as saved_tokens,
       sha256(coalesce(n.ends, '')) as ends_sha256
from counted n join totals t on t.node = n.node left join nodes p on p.node = n.parent
"""
