"""Merkle manifest of a dataset: a hash per row, per language and for the whole, with proofs.

A row's leaf is the SHA-256 of its fields, each `-` if null, else its UTF-8 length, `:` and
its value. The leaves of a language, in the order of doc_id, are paired level by level (a
last one alone is hashed again) up to the language's subroot, the subroots in the same way
to the root. Digests enter a hash as lowercase hex text.

Building: rows get positions by ranges (``ordering.numbered``); 4,096 consecutive nodes at
a time are hashed through 12 levels in one task, and their tops are the next round's nodes.
The levels are stored as node rows, each linked to its ancestor ``STEP`` levels up with the
siblings passed on the way. A recursive query climbs these links from every leaf at once: a
round appends the siblings and folds them into the hash that the leaf, tampered with or not,
started from.

Bounds: a task holds 4,096 nodes. Above the twelfth level the links are stored once for
each 4,096 leaves, so no link is climbed by more rows than that, not even the one below the
root; that makes a table of rows / 4,096 times the rounds.

Cases: a null doc_id sorts first and its row is never tampered with; rows of one doc_id are
ordered by their leaf, and repeated rows are leaves of their own; a null language is a
language of its own, before all others; a null n_chars stays null when tampered with; empty
and long texts are hashed whole; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterproof.llm.common import meet, sql_crc32, staged
from rosterproof.llm.ordering import numbered

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels hashed by one task, and levels that a stored link climbs.
ROUND, STEP = 12, 4
#: A node is its level and the position of its first leaf (from level ROUND on: of the block
#: of 2**ROUND leaves that climbs). The rounds above the subroots count from level TOP.
LEVEL, TOP = 50, 64

_LINKS = (
    "kind int, tree long, pos long, hash binary, doc_id long, tampered binary, "
    "node long, parent long, path array<binary>"
)
_LEAF, _INNER, _HEAD = 0, 1, 2


def digest(*parts: bytes) -> bytes:
    return hashlib.sha256(b"".join(p.hex().encode() for p in parts)).digest()


def levels(leaves: list[bytes], height: int) -> list[list[bytes]]:
    """The nodes of ``height`` levels above ``leaves``, level by level, leaves first."""
    found = [leaves]
    for _ in range(height):
        low = found[-1]
        found.append([digest(*low[i : i + 2]) for i in range(0, len(low), 2)])
    return found


def siblings(found: list[list[bytes]], index: int, low: int, high: int) -> list[bytes]:
    """What a node of level ``low`` meets up to level ``high``: b"L" or b"R" (its side) and
    the sibling, or nothing where it is alone."""
    path = []
    for level in range(low, high):
        other = index ^ 1
        if other < len(found[level]):
            path.append((b"R" if other > index else b"L") + found[level][other])
        else:
            path.append(b"")
        index >>= 1
    return path


def _leaf(**changed: Column) -> Column:
    def field(name: str) -> Column:
        c = changed.get(name, F.col(f"`{name}`")).cast("string")
        size = F.octet_length(c).cast("string")
        return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(size, F.lit(":"), c))

    return F.unhex(F.sha2(F.encode(F.concat(*[field(x) for x in FIELDS]), "UTF-8"), 256))


def _hash_blocks(base: int, first: bool):
    """Arrow function: a block of nodes per row -> its links and its head.

    ``base``: code of this round's lowest level; ``first``: the nodes are rows of the table.
    """

    def block(tree: int, number: int, many: bool, nodes: list[dict]) -> Iterator[tuple]:
        height = ROUND if many else (len(nodes) - 1).bit_length()
        found = levels([x["hash"] for x in nodes], height)
        start = tree + (number << ROUND)
        # Where the round ends: at the next one's lowest level, or below the subroots.
        above = ((ROUND if many else TOP) << LEVEL) | start if first else None
        step = STEP if first else ROUND
        for low in range(0, max(height, 1), step):
            high = min(low + step, height)
            for i in range(len(found[low])):
                path = siblings(found, i, low, high)
                up = (high << LEVEL) | (start + (i >> (high - low) << high)) if high < height else above
                if low == 0:
                    x = nodes[i]
                    yield _LEAF, tree, x["pos"], x["hash"], x["doc_id"], x["tampered"], None, up, path
                else:
                    node = (low << LEVEL) | (start + (i << low))
                    yield _INNER, tree, None, None, None, None, node, up, path
        yield _HEAD, tree, number, found[-1][0], None, None, None, None, None

    types = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary()]
    types += [pa.int64(), pa.int64(), pa.list_(pa.binary())]
    names = [c.split()[0] for c in _LINKS.split(", ")]

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                rows = list(zip(*block(r["tree"], r["number"], r["many"], r["nodes"]), strict=True))
                columns = [pa.array(c, t) for c, t in zip(rows, types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _round(items: DataFrame, base: int, first: bool, name: str) -> DataFrame:
    """Links and heads of one round; ``items``: tree, pos, many, hash, doc_id, tampered."""
    number = F.shiftright("pos", ROUND).alias("number")
    nodes = F.sort_array(F.collect_list(F.struct("pos", "hash", "doc_id", "tampered")))
    blocks = items.groupBy("tree", number, "many").agg(nodes.alias("nodes"))
    return staged(blocks.mapInArrow(_hash_blocks(base, first), _LINKS), name)


def _heads(found: DataFrame) -> DataFrame:
    return found.where(F.col("kind") == _HEAD).select("tree", "pos", "hash")


def _next(found: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    """The heads of round ``k`` - 1 in trees that go on, as the nodes of round ``k``."""
    going = sizes.where(F.col("size") > 1 << (ROUND * k))
    many = (F.col("size") > 1 << (ROUND * (k + 1))).alias("many")
    none = [F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("tampered")]
    return _heads(found).join(going, "tree").select("tree", "pos", many, "hash", *none)


def _above(found: DataFrame, blocks: DataFrame, under: Column, low: int, high: Column) -> DataFrame:
    """Links of a later round, one for each block of leaves below a node.

    ``under``: a block's node in this round; ``low`` and ``high``: level codes at both ends.
    """
    links = found.where(F.col("kind") == _LEAF).select(
        F.col("tree").alias("__tree"), F.col("pos").alias("__pos"), "path"
    )
    climbing = blocks.join(
        links, (F.col("tree") == F.col("__tree")) & under.eqNullSafe(F.col("__pos"))
    )
    return climbing.select(
        (F.lit(low << LEVEL) + F.col("start")).alias("node"),
        (F.shiftleft(high.cast("long"), LEVEL) + F.col("start")).alias("parent"),
        "path",
    )


_FOLD = """
    aggregate({path}, {start}, (h, e) -> unhex(sha2(cast(case
        when length(e) = 0 then lower(hex(h))
        when left(e, 1) = X'4C' then concat(lower(hex(substr(e, 2))), lower(hex(h)))
        else concat(lower(hex(h)), lower(hex(substr(e, 2)))) end as binary), 256)))
"""

_CLIMB = f"""
    WITH RECURSIVE climb(leaf, step, node, folded, path, doc_id, own, tree) MAX RECURSION LEVEL 1000 AS (
        SELECT tree + pos, 0, parent, {_FOLD.format(path="path", start="coalesce(tampered, hash)")},
               path, doc_id, hash, tree
        FROM {{leaves}}
        UNION ALL
        SELECT c.leaf, c.step + 1, n.parent, {_FOLD.format(path="n.path", start="c.folded")},
               n.path, cast(null as bigint), cast(null as binary), cast(null as bigint)
        FROM climb c JOIN {{nodes}} n ON n.node = c.node
    )
    SELECT leaf, first(doc_id, true) AS doc_id, first(own, true) AS own, first(tree, true) AS tree,
           sort_array(collect_list(struct(step, folded, path))) AS steps
    FROM climb GROUP BY leaf
"""
_ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def climbed(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every leaf's way to the root by a recursive query: its steps with folds and siblings."""
    spark = leaves.sparkSession
    before = spark.conf.get(_ROW_LIMIT)
    spark.conf.set(_ROW_LIMIT, "-1")
    try:
        return staged(spark.sql(_CLIMB, leaves=leaves, nodes=nodes), "merkle-climb")
    finally:
        spark.conf.set(_ROW_LIMIT, before)


def _hex(c: Column) -> Column:
    return F.lower(F.hex(c))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, one row per row."""
    mark = F.crc32(F.encode(F.col("doc_id").cast("long").cast("string"), "UTF-8")) % 7 == 0
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    typed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "source",
        "lang",
        F.col("n_chars").cast("long").alias("n_chars"),
        "text",
    )
    rows = typed.select(
        "doc_id",
        "lang",
        _leaf().alias("hash"),
        F.when(mark, _leaf(n_chars=more)).alias("tampered"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = staged(rows, "merkle-rows")
    order = [F.asc_nulls_first("lang"), F.asc_nulls_first("doc_id"), F.asc("hash"), F.asc("row")]
    rows = numbered(rows, order, "merkle-order")
    trees = rows.groupBy("lang").agg(F.min("position").alias("tree"), F.count(F.lit(1)).alias("size"))
    trees = numbered(staged(trees, "merkle-trees"), [F.asc_nulls_first("lang")], "merkle-langs")
    trees = trees.withColumnRenamed("position", "ordinal")
    most, count = trees.agg(F.max("size"), F.count(F.lit(1))).first()
    if not count:
        empty = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, "
        return docs.sparkSession.createDataFrame([], empty + "folded_root string, verified boolean")
    sizes = trees.select("tree", "size")
    many = (F.col("size") > 1 << ROUND).alias("many")
    items = meet(rows, trees.select("lang", "tree", "size"), "lang").select(
        "tree", (F.col("position") - F.col("tree")).alias("pos"), many, "hash", "doc_id", "tampered"
    )

    # The languages' trees, round by round.
    found = leaves = _round(items, 0, True, "merkle-0")
    start = F.col("tree") + F.shiftleft("pos", ROUND)
    blocks = _heads(found).join(trees.select("tree", "size", "ordinal"), "tree").select(
        "tree", "size", "ordinal", "pos", start.alias("start")
    )
    links = [leaves.where(F.col("kind") == _INNER).select("node", "parent", "path")]
    subroots = [_heads(found).join(sizes.where(F.col("size") <= 1 << ROUND), "tree")]
    k = 1
    while most > 1 << (ROUND * k):
        found = _round(_next(found, sizes, k), ROUND * k, False, f"merkle-{k}")
        ends = F.col("size") <= 1 << (ROUND * (k + 1))
        high = F.when(ends, TOP).otherwise(ROUND * (k + 1))
        links.append(_above(found, blocks, F.shiftright("pos", ROUND * (k - 1)), ROUND * k, high))
        subroots.append(_heads(found).join(sizes.where(ends & (F.col("size") > 1 << (ROUND * k))), "tree"))
        k += 1

    # The subroots' tree, the same way; its one tree is 0 and its leaves are the languages.
    tops = subroots[0]
    for s in subroots[1:]:
        tops = tops.unionByName(s)
    tops = staged(tops.select("tree", "hash"), "merkle-subroots")
    items = tops.join(trees.select("tree", "ordinal"), "tree").select(
        F.lit(0).cast("long").alias("tree"),
        F.col("ordinal").alias("pos"),
        F.lit(count > 1 << ROUND).alias("many"),
        "hash",
        F.lit(None).cast("long").alias("doc_id"),
        F.lit(None).cast("binary").alias("tampered"),
    )
    whole = trees.sparkSession.createDataFrame([(0, count)], "tree long, size long")
    above = blocks.withColumn("tree", F.lit(0).cast("long"))
    k = 0
    while True:
        found = _round(items, TOP + k, False, f"merkle-top-{k}")
        last = count <= 1 << (ROUND * (k + 1))
        high = F.lit(None if last else TOP + k + 1).cast("long")
        links.append(_above(found, above, F.shiftright("ordinal", ROUND * k), TOP + k, high))
        if last:
            break
        k += 1
        items = _next(found, whole, k)
    root = bytes(_heads(found).first().hash)
    nodes = links[0]
    for x in links[1:]:
        nodes = nodes.unionByName(x)
    nodes = staged(nodes, "merkle-nodes")

    leaves = leaves.where(F.col("kind") == _LEAF)
    ways = climbed(leaves, nodes)
    proof = F.array_join(
        F.transform(F.flatten(F.col("steps.path")), lambda e: _hex(F.substr(e, F.lit(2)))), ""
    )
    folded = _hex(F.element_at("steps", -1)["folded"])
    out = meet(ways, tops.withColumnRenamed("hash", "subroot"), "tree")
    return out.select(
        "doc_id",
        _hex(F.col("own")).alias("leaf"),
        _hex(F.col("subroot")).alias("subroot"),
        F.lit(root.hex()).alias("root"),
        F.sha2(F.encode(proof, "UTF-8"), 256).alias("proof_sha256"),
        folded.alias("folded_root"),
        (folded == F.lit(root.hex())).alias("verified"),
    )


def _sql_leaf(n_chars: str) -> str:
    columns = {"doc_id": "doc_id", "source": "source", "lang": "lang", "n_chars": n_chars, "text": "text"}
    fields = [
        f"coalesce(strlen(({columns[c]})::varchar) || ':' || ({columns[c]})::varchar, '-')" for c in FIELDS
    ]
    return f"sha256({' || '.join(fields)})"


SQL = f"""
with recursive hashed as (
  select doc_id::bigint as doc_id, lang, {_sql_leaf("n_chars")} as leaf,
         case when {sql_crc32("doc_id::varchar")} % 7 = 0 then {_sql_leaf("n_chars + 1")} end as changed
  from documents),
leaves as (
  select *, coalesce(changed, leaf) as start, dense_rank() over (order by lang nulls first) as tree,
         row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos,
         count(*) over (partition by lang) as n, row_number() over () as id from hashed),
langs as (
  select tree, lvl, pos, n, hash from (
    with recursive up as (
      select tree, 0 as lvl, pos, n, leaf as hash from leaves
      union all
      select tree, lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(hash, '' order by pos))
      from up where n > 1 group by tree, lvl, pos // 2, n)
    select * from up)),
whole as (
  select 0 as tree, lvl, pos, n, hash from (
    with recursive up as (
      select 0 as lvl, tree - 1 as pos, count(*) over () as n, hash from langs where n = 1
      union all
      select lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(hash, '' order by pos))
      from up where n > 1 group by lvl, pos // 2, n)
    select * from up)),
nodes as (select * from langs union all select * from whole),
climb as (
  select id, tree, 0 as lvl, pos, n, start as hash, '' as proof from leaves
  union all
  select c.id, case when c.n = 1 then 0 else c.tree end, case when c.n = 1 then 0 else c.lvl + 1 end,
         case when c.n = 1 then c.tree - 1 else c.pos // 2 end,
         case when c.n = 1 then (select max(tree) from leaves) else (c.n + 1) // 2 end,
         case when c.n = 1 then c.hash when c.pos % 2 = 1 then sha256(s.hash || c.hash)
              else sha256(c.hash || coalesce(s.hash, '')) end,
         c.proof || coalesce(s.hash, '')
  from climb c left join nodes s
    on c.n > 1 and s.tree = c.tree and s.lvl = c.lvl and s.pos = xor(c.pos, 1)
  where c.n > 1 or c.tree > 0)
select l.doc_id, l.leaf, s.hash as subroot, r.hash as root, sha256(c.proof) as proof_sha256,
       c.hash as folded_root, c.hash = r.hash as verified
from leaves l
join climb c on c.id = l.id and c.tree = 0 and c.n = 1
join langs s on s.tree = l.tree and s.n = 1
cross join (select hash from whole where n = 1) r
"""
