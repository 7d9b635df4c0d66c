"""Quotation linking: reply-ordered conversations without quotes, in DataFrame operations.

A line's quote level is the number of ``>`` before its text. The level-0 lines of a message
are its own text; consecutive lines of one higher level without a blank line between are a
quoted passage. Passages are normalised (lower case, white space runs to one space),
hashed and joined, within the conversation, to the first message whose own text has that
passage as a line, a paragraph or the whole. A passage of several lines that finds none so
(lines out of a longer paragraph) is matched line by line: to the first message that has
those lines one after another. A message replies to the latest earlier message that its
level-1 passages come from; deeper passages are links of their own.
Replies form threads; a conversation is ordered by thread (its first turn), then turn.

Scale: only messages with a quote are taken apart by line, and only conversations with a
quote offer originals. Originals are reduced to the smallest turn of each (conversation,
hash) before the join, so copies never multiply. Runs of lines are named as in a suffix
table, a run of n lines by its first and its last 2^k lines (2^k <= n), so a run costs one
hash however long it is; only the lengths that unlinked passages of the conversation have
are named, and lines are never paired. The place of a message in its
conversation comes from a range-partitioned sort and counted offsets, and rendered text is
gathered in segments of ``SEGMENT`` messages: no task gathers a conversation.

Cases: a null text is empty; empty messages stay as messages; a null role is 'unknown';
null conv_id is a conversation of its own, null turn comes first; rows equal in all four
columns are messages of their own with equal content and links; a quote of no earlier
message, or of part of a line, stays unlinked and is removed all the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterproof.llm.common import remove, scratch, staged

SEGMENT = 64
_MARK = r"^[ \t]*(>[ \t]*)+"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\r\n]+", " "))


def messages(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, and key: equal rows have the same."""
    role = F.coalesce(F.col("role").cast("string"), F.lit("unknown"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        F.regexp_replace(text, "\r\n?", "\n").alias("text"),
    ).withColumn("key", F.md5(F.concat_ws("\u0001", "role", "text")))


def quoted_lines(rows: DataFrame) -> DataFrame:
    """Lines of the messages that quote: level, body, passage, and whether they are blank."""
    line = F.col("line")
    lines = (
        rows.where(F.col("text").rlike("(?m)^[ \t]*>"))
        .select("conv_id", "turn", "key", "text")
        .dropDuplicates(["conv_id", "turn", "key"])
        .select("conv_id", "turn", "key", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        .withColumn("mark", F.regexp_extract(line, _MARK, 0))
        .select(
            "conv_id",
            "turn",
            "key",
            "pos",
            F.length(F.regexp_replace("mark", "[^>]", "")).alias("level"),
            F.regexp_replace(line, _MARK, "").alias("body"),
        )
    )
    own = Window.partitionBy("conv_id", "turn", "key").orderBy("pos")
    blank = normalised(F.col("body")) == ""
    before = F.lag(F.when(~blank, F.col("level"))).over(own)
    starts = blank | before.isNull() | (before != F.col("level"))
    return lines.withColumns(
        {"passage": F.sum(starts.cast("int")).over(own), "blank": blank}
    )


def own_texts(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """Own text (level-0 lines, outer blank lines trimmed) of the messages that quote."""
    return (
        lines.where("level = 0")
        .groupBy("conv_id", "turn", "key")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "body"))).alias("l"))
        .select("conv_id", "turn", "key", F.array_join("l.body", "\n").alias("own"))
    )


def passages(lines: DataFrame) -> DataFrame:
    """Quoted passages: conv_id, turn, key, passage, level, hash, lines (normalised)."""
    return (
        lines.where("level > 0 and not blank")
        .groupBy("conv_id", "turn", "key", "passage", "level")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "body"))).alias("l"))
        .withColumn("hash", F.md5(normalised(F.array_join("l.body", "\n"))))
        .withColumn("lines", F.transform("l.body", normalised))
        .drop("l")
    )


def originals(own: DataFrame) -> DataFrame:
    """(conv_id, hash, origin): the smallest turn with a passage as its own text."""
    parts = F.flatten(
        F.array(
            F.array("own"), F.split("own", "\n"), F.split("own", r"\n[ \t]*\n")
        )
    )
    return (
        own.select("conv_id", "turn", F.explode(F.array_distinct(parts)).alias("part"))
        .withColumn("part", normalised(F.col("part")))
        .where("part <> ''")
        .groupBy("conv_id", F.md5("part").alias("hash"))
        .agg(F.min("turn").alias("origin"))
    )


def runs(rows: DataFrame, most: int) -> DataFrame:
    """(n, run): the name of every run of n consecutive ``lines``, for each n of ``lengths``.

    Runs of 1, 2, 4 ... lines up to ``most`` are named level by level, each by two of the
    level before; a run of n lines by the two of the largest such length that begin and
    end it. The row's other columns stay.
    """

    def pair(level: Column, gap: int | Column):
        return lambda i: F.md5(F.concat(F.get(level, i), F.get(level, i + gap)))

    kept = [c for c in rows.columns if c not in ("lines", "lengths")]
    size = F.size("lines")
    out = rows.select(
        *kept,
        size.alias("__size"),
        F.filter("lengths", lambda n: n <= size).alias("__lengths"),
        F.transform("lines", lambda x: F.md5(x)).alias("__0"),
    ).where(F.size("__lengths") > 0)
    levels = most.bit_length()
    for k in range(1, levels):
        last, half = F.col(f"__{k - 1}"), 1 << (k - 1)
        end = F.col("__size") - 2 * half
        out = out.withColumn(
            f"__{k}", F.when(end >= 0, F.transform(F.sequence(F.lit(0), end), pair(last, half)))
        )
    table = F.array(*[F.col(f"__{k}") for k in range(levels)])
    by_length = out.select(*kept, "__size", table.alias("__table"), F.explode("__lengths").alias("n"))
    level = F.length(F.bin("n")) - 1
    chosen = by_length.select(
        *kept,
        "n",
        (F.col("__size") - F.col("n")).alias("__last"),
        F.get("__table", level).alias("__level"),
        (F.col("n") - F.call_function("shiftleft", F.lit(1), level)).alias("__gap"),
    )
    named = F.transform(F.sequence(F.lit(0), "__last"), pair(F.col("__level"), F.col("__gap")))
    return chosen.select(*kept, "n", F.explode(named).alias("run"))


def line_links(unlinked: DataFrame, offering: DataFrame) -> DataFrame:
    """(conv_id, turn, key, passage, found): the first earlier turn whose own text has the
    lines of the passage one after another; passages without one are left out."""
    ids = ["conv_id", "turn", "key", "passage"]
    n = F.size("lines")
    most = unlinked.agg(F.max(n)).first()[0]
    if most is None:
        return unlinked.select(*ids, F.col("turn").alias("found")).limit(0)
    wanted = unlinked.groupBy(F.col("conv_id").alias("w_conv")).agg(F.collect_set(n).alias("lengths"))
    lined = offering.select(
        "conv_id", "turn", F.transform(F.split("own", "\n"), normalised).alias("lines")
    )
    asked = lined.join(wanted, lined["conv_id"].eqNullSafe(wanted["w_conv"])).drop("w_conv")
    first = (
        runs(asked, most)
        .groupBy(F.col("conv_id").alias("o_conv"), F.col("n").alias("o_n"), F.col("run").alias("o_run"))
        .agg(F.min("turn").alias("found"))
    )
    quoted = runs(unlinked.select(*ids, "lines", F.array(n).alias("lengths")), most)
    return quoted.join(
        first,
        quoted["conv_id"].eqNullSafe(first["o_conv"])
        & (quoted["n"] == first["o_n"])
        & (quoted["run"] == first["o_run"])
        & (first["found"] < quoted["turn"]),
    ).select(*ids, "found")


def same(left: DataFrame, right: DataFrame, columns: list[str]) -> list[Column]:
    """Join conditions under which null equals null."""
    return [left[c].eqNullSafe(right[c]) for c in columns]


def quote_links(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links, own texts of all rows, replies) of ``messages``.

    links: conv_id, turn, key, passage, level, origin (null: not found earlier);
    replies: conv_id, turn, key, reply_to of the messages that answer an earlier one.
    """
    lines = staged(quoted_lines(rows), "chat-lines")
    stripped = own_texts(rows, lines)
    quoting = lines.select("conv_id", "turn", "key").distinct()
    marked = quoting.join(stripped, same(quoting, stripped, ["conv_id", "turn", "key"]), "left").select(
        quoting["conv_id"].alias("q_conv"),
        quoting["turn"].alias("q_turn"),
        quoting["key"].alias("q_key"),
        F.coalesce("own", F.lit("")).alias("own"),
        F.lit(True).alias("quotes"),
    )
    on = (
        rows["conv_id"].eqNullSafe(marked["q_conv"])
        & rows["turn"].eqNullSafe(marked["q_turn"])
        & (rows["key"] == marked["q_key"])
    )
    trimmed = F.regexp_replace("own", r"^(?:[ \t]*\n)+|(?:\n[ \t]*)+$", "")
    own = rows.join(marked, on, "left").select(
        "conv_id", "turn", "role", "key", F.when(F.col("quotes"), trimmed).otherwise(F.col("text")).alias("own")
    )
    convs = lines.select(F.col("conv_id").alias("with_quotes")).distinct()
    offering = own.join(convs, own["conv_id"].eqNullSafe(convs["with_quotes"]), "left_semi")
    first = originals(offering).withColumnsRenamed({"conv_id": "o_conv", "hash": "o_hash"})
    found = passages(lines)
    whole = found.join(
        first,
        found["conv_id"].eqNullSafe(first["o_conv"])
        & (found["hash"] == first["o_hash"])
        & (first["origin"] < found["turn"]),
        "left",
    ).select("conv_id", "turn", "key", "passage", "level", "origin", "lines")
    whole = staged(whole, "chat-links")
    ids = ["conv_id", "turn", "key", "passage"]
    unlinked = whole.where(F.col("origin").isNull() & (F.size("lines") > 1))
    by_line = line_links(unlinked, offering).toDF(*(f"l_{c}" for c in ids), "found")
    met = [whole[c].eqNullSafe(by_line[f"l_{c}"]) for c in ids]
    links = whole.join(by_line, met, "left").select(
        *ids, "level", F.coalesce("origin", "found").alias("origin")
    )
    replies = (
        links.where("level = 1 and origin is not null")
        .groupBy("conv_id", "turn", "key")
        .agg(F.max("origin").alias("reply_to"))
    )
    return links, own, replies


def threads(replies: DataFrame) -> DataFrame:
    """(conv_id, turn, root): the first turn of each replying turn's thread.

    Turns are the nodes; a turn with several messages follows the latest of their
    replies. Pointers are doubled, each round written to shared storage, so the rounds
    grow with the logarithm of the longest chain of replies.
    """
    spark = replies.sparkSession
    folder = f"{scratch(spark)}/rosterproof-threads-{_fresh(spark)}"
    up = replies.groupBy("conv_id", "turn").agg(F.max("reply_to").alias("root"))
    current, last = staged(up, "threads", f"{folder}/0"), f"{folder}/0"
    step = 0
    while True:
        step += 1
        above = current.select(
            F.col("conv_id").alias("a_conv"), F.col("turn").alias("a_turn"), F.col("root").alias("a_root")
        )
        moved = current.join(
            above,
            current["conv_id"].eqNullSafe(above["a_conv"]) & (current["root"] == above["a_turn"]),
            "left",
        ).select(
            "conv_id",
            "turn",
            F.coalesce("a_root", "root").alias("root"),
            F.col("a_root").isNotNull().alias("moved"),
        )
        done = staged(moved, "threads", f"{folder}/{step}")
        remove(spark, last)
        current, last = done.drop("moved"), f"{folder}/{step}"
        if done.where("moved").isEmpty():
            return current


def _fresh(spark) -> str:
    return spark.sql("select uuid()").first()[0]


def placed(keys: DataFrame) -> DataFrame:
    """``keys`` with ``position``, 0 .. n-1 in each conversation by (thread, turn, key).

    Rows are sorted over ranges; a conversation's rows in a range start where its rows in
    the ranges before end.
    """
    order = ["conv_id", "thread", "turn", "key"]
    sorted_ = staged(
        keys.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("range", F.spark_partition_id())
        .withColumn("id", F.monotonically_increasing_id()),
        "chat-order",
    )
    sizes = sorted_.groupBy("conv_id", "range").agg(
        F.min("id").alias("first"), F.count(F.lit(1)).alias("n")
    )
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        F.col("conv_id").alias("s_conv"),
        F.col("range").alias("s_range"),
        "first",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"),
    )
    return sorted_.join(
        starts,
        sorted_["conv_id"].eqNullSafe(starts["s_conv"]) & (sorted_["range"] == starts["s_range"]),
    ).select(*keys.columns, (F.col("base") + F.col("id") - F.col("first")).alias("position"))


def ordered_messages(conversations: DataFrame) -> DataFrame:
    """One row per message: conv_id, position, turn, role, reply_to, thread, own (text)."""
    rows = messages(conversations)
    _, own, replies = quote_links(rows)
    own, replies = staged(own, "chat-own"), staged(replies, "chat-replies")
    roots = threads(replies).withColumnsRenamed({"conv_id": "t_conv", "turn": "t_turn"})
    answered = replies.withColumnsRenamed({"conv_id": "r_conv", "turn": "r_turn", "key": "r_key"})
    full = (
        own.join(
            answered,
            own["conv_id"].eqNullSafe(answered["r_conv"])
            & (own["turn"] == answered["r_turn"])
            & (own["key"] == answered["r_key"]),
            "left",
        )
        .join(
            roots,
            own["conv_id"].eqNullSafe(roots["t_conv"]) & (own["turn"] == roots["t_turn"]),
            "left",
        )
        .select(
            "conv_id", "turn", "role", "key", "reply_to", F.coalesce("root", "turn").alias("thread"), "own"
        )
    )
    return placed(full)


def chat_segments(conversations: DataFrame) -> DataFrame:
    """Rendered conversations in segments of at most ``SEGMENT`` messages.

    conv_id, segment, n_messages, turns and reply_tos (comma-separated; - for none), chat:
    each message as its role line, its own text and an end line.
    """
    none = F.lit("-")
    chat = F.concat(F.lit("<|"), "role", F.lit("|>\n"), "own", F.lit("\n<|end|>"))
    rows = ordered_messages(conversations).select(
        "conv_id",
        F.floor(F.col("position") / SEGMENT).alias("segment"),
        F.struct(
            "position",
            F.coalesce(F.col("turn").cast("string"), none).alias("turn"),
            F.coalesce(F.col("reply_to").cast("string"), none).alias("reply_to"),
            chat.alias("chat"),
        ).alias("m"),
    )
    return (
        rows.groupBy("conv_id", "segment")
        .agg(F.sort_array(F.collect_list("m")).alias("m"))
        .select(
            "conv_id",
            "segment",
            F.size("m").cast("long").alias("n_messages"),
            F.array_join("m.turn", ",").alias("turns"),
            F.array_join("m.reply_to", ",").alias("reply_tos"),
            F.array_join("m.chat", "\n").alias("chat"),
        )
    )


#: DuckDB twin of ``chat_segments``.
SQL = r"""
with recursive rows_ as (
  select conv_id::bigint conv_id, turn::bigint turn, coalesce(role, 'unknown') as role_,
         regexp_replace(coalesce(text, ''), chr(13) || chr(10) || '?', chr(10), 'g') as text_
  from conversations),
keyed as (select *, md5(role_ || chr(1) || text_) as k from rows_),
lines as (
  select conv_id, turn, k, pos, line, regexp_extract(line, '^[ \t]*(>[ \t]*)+') as mark
  from (select conv_id, turn, k, unnest(string_split(text_, chr(10))) as line,
               unnest(range(len(string_split(text_, chr(10))))) as pos
        from (select distinct conv_id, turn, k, text_ from keyed
              where regexp_matches(text_, '(?m)^[ \t]*>')))),
bodies as (
  select conv_id, turn, k, pos, length(regexp_replace(mark, '[^>]', '', 'g')) as level,
         substr(line, length(mark) + 1) as body from lines),
marked as (
  select *, trim(regexp_replace(lower(body), '[ \t\r\n]+', ' ', 'g')) = '' as blank from bodies),
numbered as (
  select *, sum(case when blank or prev is null or prev <> level then 1 else 0 end)
            over (partition by conv_id, turn, k order by pos) as passage
  from (select *, lag(case when not blank then level end)
                  over (partition by conv_id, turn, k order by pos) as prev from marked)),
stripped as (
  select conv_id, turn, k, regexp_replace(regexp_replace(
           coalesce(string_agg(body, chr(10) order by pos) filter (where level = 0), ''),
           '^([ \t]*\n)+', ''), '(\n[ \t]*)+$', '') as own
  from numbered group by all),
own as (
  select d.conv_id, d.turn, d.role_, d.k, coalesce(s.own, d.text_) as own
  from keyed d left join stripped s on d.conv_id is not distinct from s.conv_id
   and d.turn is not distinct from s.turn and d.k = s.k),
parts as (
  select conv_id, turn, trim(regexp_replace(lower(part), '[ \t\r\n]+', ' ', 'g')) as part
  from (select conv_id, turn, unnest(list_concat([own], string_split(own, chr(10)),
                                    regexp_split_to_array(own, '\n[ \t]*\n'))) as part from own)),
first_ as (
  select conv_id, md5(part) as h, min(turn) as origin from parts where part <> '' group by all),
quoted as (
  select conv_id, turn, k, passage, level,
         md5(trim(regexp_replace(lower(string_agg(body, chr(10) order by pos)), '[ \t\r\n]+', ' ', 'g'))) as h,
         count(*) as n,
         string_agg(trim(regexp_replace(lower(body), '[ \t\r\n]+', ' ', 'g')), chr(10) order by pos) as said
  from numbered where level > 0 and not blank group by all),
whole as (
  select q.*, f.origin from quoted q left join first_ f
    on q.conv_id is not distinct from f.conv_id and q.h = f.h and f.origin < q.turn),
wanted as (select distinct conv_id, n from whole where origin is null and n > 1),
own_lines as (
  select conv_id, turn, list_transform(string_split(own, chr(10)),
           lambda x: trim(regexp_replace(lower(x), '[ \t\r\n]+', ' ', 'g'))) as l from own),
runs as (
  select o.conv_id, w.n, o.turn, o.l, unnest(range(1, len(o.l) - w.n + 2)) as p
  from own_lines o join wanted w on o.conv_id is not distinct from w.conv_id),
first_run as (
  select conv_id, n, array_to_string(l[p:p + n - 1], chr(10)) as said, min(turn) as origin from runs group by all),
linked as (
  select w.conv_id, w.turn, w.k, w.level, coalesce(w.origin, r.origin) as origin
  from whole w left join first_run r on w.origin is null and w.n > 1
   and w.conv_id is not distinct from r.conv_id and w.n = r.n and w.said = r.said and r.origin < w.turn),
replies as (
  select conv_id, turn, k, max(origin) as reply_to from linked
  where level = 1 and origin is not null group by all),
ups as (select conv_id, turn, max(reply_to) as up from replies group by all),
walk as (
  select conv_id, turn, up as root from ups
  union all
  select w.conv_id, w.turn, u.up from walk w join ups u
    on w.conv_id is not distinct from u.conv_id and w.root = u.turn),
roots as (select conv_id, turn, min(root) as root from walk group by all),
placed as (
  select o.*, r.reply_to, row_number() over (partition by o.conv_id
           order by coalesce(t.root, o.turn) nulls first, o.turn nulls first, o.k) - 1 as position
  from own o
  left join replies r on o.conv_id is not distinct from r.conv_id and o.turn = r.turn and o.k = r.k
  left join roots t on o.conv_id is not distinct from t.conv_id and o.turn = t.turn)
select conv_id, position // 64 as segment, count(*) as n_messages,
       string_agg(coalesce(turn::varchar, '-'), ',' order by position) as turns,
       string_agg(coalesce(reply_to::varchar, '-'), ',' order by position) as reply_tos,
       string_agg('<|' || role_ || '|>' || chr(10) || own || chr(10) || '<|end|>', chr(10) order by position) as chat
from placed group by all
"""
