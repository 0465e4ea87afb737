"""Conversations without quotes, in reply order.

Lines that begin with ">" quote an earlier message; their number of marks is the nested
level.  Quoted passages - each line, and all lines of a level together - are normalised
and hashed and joined to the messages of the conversation that said them first.
A message replies to the one that most of its outermost quote came from.
Replies are followed to the root of their thread by pointer doubling; thread and turn
order a conversation, every message after the one it replies to.  DataFrame functions only: no conversation is gathered in one row or task,
and a passage that many messages share meets one row, its first use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_ids, materialize, release, unused

NAMES = ("reply_to", "thread", "depth", "n_quoted", "n_linked", "order_key")
MARKS = r"^[ \t]*(>[> \t]*)"


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 1), r"[^>]", ""))


def _norm(text: Column) -> Column:
    """Lower-cased runs of letters and digits, joined by one space."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(text, MARKS, "")), r"[^\p{L}\p{N}]+", " "))


def _passages(lines: Column) -> Column:
    """Normalised lines and, for several, their joint text; blank ones left out."""
    each = F.transform(lines, _norm)
    whole = F.trim(F.regexp_replace(F.array_join(each, " "), " +", " "))
    return F.array_distinct(F.filter(F.concat(each, F.array(whole)), lambda x: x != ""))


def unquote(messages: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """messages with text_col freed of quotes, and reply_to, thread, depth, n_quoted, n_linked, order_key.

    reply_to: turn of the message that the outermost quote links to, null without one; thread: the turn
    at the root of its replies, itself included; depth: replies up to the root; n_quoted: quoted
    lines; n_linked: quoted passages found in an earlier message; order_key: text that sorts the messages of a conversation by thread and turn, null without a turn.  Of several messages
    that said a passage the first counts; of several that a quote comes from, the one with most letters in it and then the last.  Null texts
    stay null, empty ones empty.  Messages with a null conversation or turn link with nothing.  Rows that repeat a turn share its
    links.  A very long text is split in one row.  An empty table stays empty.  Columns with these names are replaced; others, whatever their names, pass unchanged.
    """
    kept_columns = [c for c in messages.columns if c.lower() not in NAMES]
    messages = messages.select(*[f"`{c}`" for c in kept_columns])
    text, conv, turn = F.col(f"`{text_col}`"), F.col(f"`{conv_col}`"), F.col(f"`{turn_col}`").cast("long")
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    own = F.filter(lines, lambda x: _level(x) == 0)
    quoting = F.coalesce(F.rlike(text, F.lit("(?m)" + MARKS)), F.lit(False))
    base = messages.where(conv.isNotNull() & turn.isNotNull()).select(conv.alias("c"), turn.alias("t"), quoting.alias("quoting"), lines.alias("lines"))
    lines_of = F.col("lines")
    quoters = base.where("quoting").withColumn("level", F.explode(F.array_distinct(F.filter(F.transform(lines_of, _level), lambda x: x > 0))))
    quoted = quoters.select("c", "t", "level", F.explode(_passages(F.filter(lines_of, lambda x: _level(x) == F.col("level")))).alias("p"))
    quoted = materialize(quoted.select("c", "t", "level", F.xxhash64("p").alias("h"), F.length("p").alias("weight")).distinct(), "quoted")
    # only conversations that quote at all have their messages hashed; few of them are broadcast, so that a long one is no single group
    quoters = materialize(quoted.select("c").distinct(), "quoters")
    said = by_ids(base, quoters, "c", "left_semi").select("c", "t", F.explode(_passages(F.filter(lines_of, lambda x: _level(x) == 0))).alias("p"))
    first = said.groupBy("c", F.xxhash64("p").alias("h")).agg(F.min("t").alias("source"))
    links = materialize(quoted.join(first, ["c", "h"]).where("source < t"), "links")
    votes = links.groupBy("c", "t", "level", "source").agg(F.sum("weight").alias("w"))
    reply = votes.groupBy("c", "t").agg(F.max_by("source", F.struct(-F.col("level"), F.col("w"), F.col("source"))).alias("reply_to"))
    counted = links.groupBy("c", "t").agg(F.count("*").alias("n_linked"))

    # pointer doubling over replies; a message without one is a root and needs no row
    jump = materialize(reply.select("c", "t", F.col("reply_to").alias("up"), F.lit(1).cast("long").alias("depth")), "jump")
    while jump.limit(1).count():
        far = jump.select("c", F.col("t").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"))
        step = jump.join(far, ["c", "up"], "left").select("c", "t", F.coalesce("up2", "up").alias("up"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"), F.col("up2").isNotNull().alias("moved"))
        jump = materialize(step, "jump")
        if not jump.where("moved").limit(1).count():
            break
    found = reply.join(counted, ["c", "t"]).join(jump.select("c", "t", F.col("up").alias("thread"), "depth"), ["c", "t"])
    keys = dict(zip(found.columns, unused(messages, *found.columns), strict=True))
    found = materialize(found.withColumnsRenamed(keys), "threads")
    release(quoted, quoters, links)
    joined = messages.join(found, (conv == F.col(keys["c"])) & (turn == F.col(keys["t"])), "left")
    thread = F.coalesce(F.col(keys["thread"]), turn)
    return joined.select(
        *[F.when(quoting, F.array_join(own, "\n")).otherwise(text).alias(c) if c == text_col else F.col(f"`{c}`") for c in kept_columns],
        F.col(keys["reply_to"]).alias("reply_to"),
        thread.alias("thread"),
        F.coalesce(F.col(keys["depth"]), F.lit(0)).cast("long").alias("depth"),
        F.when(quoting, F.size(lines) - F.size(own)).otherwise(0).cast("long").alias("n_quoted"),
        F.coalesce(F.col(keys["n_linked"]), F.lit(0)).cast("long").alias("n_linked"),
        F.concat(F.lpad(thread.cast("string"), 19, "0"), F.lit("."), F.lpad(turn.cast("string"), 19, "0")).alias("order_key"),
    )


def reply_ordered(messages: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """The conversations themselves: :func:`unquote`'s rows, sorted by conversation and reply order over all partitions, a long conversation over several."""
    return unquote(messages, conv_col=conv_col, turn_col=turn_col, text_col=text_col).orderBy(F.col(f"`{conv_col}`"), "order_key")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: all messages of conversations without quotes, with their place in reply order."""
    return unquote(spark.read.parquet(f"{sf_dir}/conversations.parquet")).select("conv_id", "turn", "role", "text", "reply_to", "thread", "depth", "n_quoted", "n_linked", "order_key")


_L = r"length(regexp_replace(regexp_extract(x, '^[ \t]*(>[> \t]*)', 1), '[^>]', '', 'g'))"
_N = r"trim(regexp_replace(lower(regexp_replace(x, '^[ \t]*(>[> \t]*)', '')), '[^\p{L}\p{N}]+', ' ', 'g'))"


def _sql_passages(lines: str) -> str:
    each = f"list_transform({lines}, lambda x: {_N})"
    return f"list_distinct(list_filter(list_concat({each}, [trim(regexp_replace(array_to_string({each}, ' '), ' +', ' ', 'g'))]), lambda x: x <> ''))"


OP8_SQL = f"""
WITH RECURSIVE m AS (SELECT conv_id, turn, role, text, string_split(coalesce(text, ''), chr(10)) AS lines,
       coalesce(regexp_matches(text, '(?m)^[ \t]*(>[> \t]*)'), false) AS quoting FROM conversations),
q AS (SELECT conv_id, turn, level, unnest({_sql_passages("list_filter(lines, lambda x: " + _L + " = level)")}) AS p
      FROM (SELECT *, unnest(list_distinct(list_filter(list_transform(lines, lambda x: {_L}), lambda v: v > 0))) AS level FROM m WHERE quoting)),
o AS (SELECT conv_id, min(turn) AS source, p FROM (SELECT conv_id, turn, unnest({_sql_passages("list_filter(lines, lambda x: " + _L + " = 0)")}) AS p FROM m) GROUP BY conv_id, p),
k AS (SELECT DISTINCT q.conv_id, q.turn, level, q.p, source FROM q JOIN o ON q.conv_id = o.conv_id AND q.p = o.p WHERE source < turn),
v AS (SELECT conv_id, turn, level, source, sum(length(p)) AS w FROM k GROUP BY ALL),
r AS (SELECT conv_id, turn, source AS reply_to FROM v QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, w DESC, source DESC) = 1),
c AS (SELECT conv_id, turn, reply_to AS up, 1 AS depth FROM r
      UNION ALL SELECT c.conv_id, c.turn, r.reply_to, c.depth + 1 FROM c JOIN r ON c.conv_id = r.conv_id AND c.up = r.turn),
t AS (SELECT conv_id, turn, arg_max(up, depth) AS thread, max(depth) AS depth FROM c GROUP BY ALL),
n AS (SELECT conv_id, turn, count(*) AS n_linked FROM k GROUP BY ALL)
SELECT m.conv_id, m.turn, role, CASE WHEN quoting THEN array_to_string(list_filter(lines, lambda x: {_L} = 0), chr(10)) ELSE text END AS text,
       reply_to, coalesce(thread, m.turn) AS thread, coalesce(depth, 0)::BIGINT AS depth,
       CASE WHEN quoting THEN len(list_filter(lines, lambda x: {_L} > 0)) ELSE 0 END::BIGINT AS n_quoted, coalesce(n_linked, 0)::BIGINT AS n_linked,
       lpad(coalesce(thread, m.turn)::VARCHAR, 19, '0') || '.' || lpad(m.turn::VARCHAR, 19, '0') AS order_key
FROM m LEFT JOIN r ON m.conv_id = r.conv_id AND m.turn = r.turn LEFT JOIN t ON m.conv_id = t.conv_id AND m.turn = t.turn
     LEFT JOIN n ON m.conv_id = n.conv_id AND m.turn = n.turn
"""
