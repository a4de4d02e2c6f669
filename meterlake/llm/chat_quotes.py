"""Chat formatting by quotation linking, in DataFrame code alone.

Lines that begin with ">" are quotes; the number of ">" is the level. Quoted lines and a message's own lines are
normalised (lower case, white space runs to one space, trimmed) and hashed; a quoted passage is joined, line by line,
to the latest earlier message of its conversation that has the line as its own. Of the outermost quote level, the
message with most lines (then the latest) is what is answered; without a link it is the message before. A message that
answers another than the one before opens a branch. Sorted by (conv_id, branch, turn), every message follows what it
answers: reply order, and each message is formatted without its quotes.

No conversation is ever gathered: what "latest before" needs is a running maximum within chunks of 1,024 turns, and over
the chunks' maxima. Rows equal in conversation, turn and line are counted before they meet.

Cases: a null text is empty; a null conv_id is a conversation of its own and a null turn comes first in it; rows of
the same conversation and turn are one message to link with, each keeps its row; a message of quotes alone has an
empty own text; a null role is "unknown"; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 1024
QUOTE = r"^(?:[ \t]*>)+"
LOWEST = -(2**63)


def normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), r"[ \t\r\n\f\x0B]+", " "))


def running(df: DataFrame, keys: list[str], value: Column, name: str, inclusive: bool) -> DataFrame:
    """``df`` (one row for each of ``keys`` and turn) with the largest ``value`` of the rows before (and at) each turn."""
    chunk = F.floor(F.col("turn") / CHUNK)
    own = df.withColumns({"_chunk": chunk, "_value": value})
    within = Window.partitionBy(*keys, "_chunk").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = own.groupBy(*keys, "_chunk").agg(F.max("_value").alias("_most")).withColumn("_most", F.max("_most").over(before))
    return own.withColumn("_here", F.max("_value").over(within)).join(chunks, [*keys, "_chunk"], "left").withColumn(name, F.coalesce("_here", "_most")).drop("_chunk", "_value", "_here", "_most")


def links(messages: DataFrame) -> DataFrame:
    """Rows (conv, turn, n_quoted, n_linked, max_level, parent, branch), one a message; parent and branch are turns."""
    lines = messages.select("conv", "turn", F.explode(F.split("text", "\n", -1)).alias("line"))
    lines = lines.withColumn("level", F.length(F.regexp_replace(F.regexp_extract("line", QUOTE, 0), "[^>]", "")))
    lines = lines.withColumn("norm", normal(F.regexp_replace("line", QUOTE, ""))).where("norm <> ''")
    marked = lines.groupBy("conv", F.md5(F.col("norm").cast("binary")).alias("h"), "turn").agg(
        F.max(F.col("level") == 0).alias("own"), F.min(F.when(F.col("level") > 0, F.col("level"))).alias("level"), F.max("level").alias("deepest"), F.count_if(F.col("level") > 0).alias("n")
    )
    found = running(marked, ["conv", "h"], F.when(F.col("own"), F.col("turn")), "source", False).where("n > 0")
    outer = Window.partitionBy("conv", "turn")
    votes = found.groupBy("conv", "turn", "source", "level").agg(F.sum("n").alias("n"), F.max("deepest").alias("deepest"))
    votes = votes.withColumn("outer", F.min("level").over(outer))
    answer = F.max_by("source", F.when(F.col("source").isNotNull() & (F.col("level") == F.col("outer")), F.struct("n", "source")))
    quoted = votes.groupBy("conv", "turn").agg(F.sum("n").alias("n_quoted"), F.sum(F.when(F.col("source").isNotNull(), F.col("n")).otherwise(0)).alias("n_linked"), F.max("deepest").alias("max_level"), answer.alias("answered"))
    turns = messages.select("conv", "turn").distinct()
    placed = running(turns, ["conv"], F.col("turn"), "previous", False).join(quoted, ["conv", "turn"], "left")
    opens = F.when(F.col("previous").isNull() | (F.col("answered") != F.col("previous")), F.col("turn"))
    placed = running(placed, ["conv"], opens, "branch", True)
    return placed.select("conv", "turn", F.coalesce("n_quoted", F.lit(0)).alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"), F.coalesce("max_level", F.lit(0)).cast("long").alias("max_level"), F.coalesce("answered", "previous").alias("parent"), "branch")


def format_chat(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, branch, turn, parent, role, n_quoted, n_linked, max_level, own_text, chat_text), one an input row."""
    rows = conversations.select("conv_id", F.col("turn").alias("own_turn"), "role", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("conv_id", F.lit(LOWEST)).alias("conv"), F.coalesce("turn", F.lit(LOWEST)).alias("turn"))
    kept = F.filter(F.split("text", "\n", -1), lambda x: ~x.rlike(QUOTE))
    own = F.regexp_replace(F.array_join(kept, "\n"), r"^\n+|\n+$", "")
    found = links(rows.select("conv", "turn", "text"))
    back = lambda c: F.when(F.col(c) == LOWEST, None).otherwise(F.col(c)).alias(c)
    out = rows.withColumn("own_text", own).drop("text").join(found, ["conv", "turn"])
    chat = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.col("own_text"), F.lit("\n<|end|>"))
    return out.select("conv_id", back("branch"), F.col("own_turn").alias("turn"), back("parent"), "role", "n_quoted", "n_linked", "max_level", "own_text", chat.alias("chat_text"))


ORACLE = r"""
with m as (
  select conv_id, turn as own_turn, role, coalesce(text, '') as text, coalesce(conv_id, -9223372036854775808) as conv, coalesce(turn, -9223372036854775808) as turn
  from conversations
), l as (
  select conv, turn, line, length(regexp_replace(regexp_extract(line, '^(?:[ \t]*>)+'), '[^>]', '', 'g')) as level,
         trim(regexp_replace(lower(regexp_replace(line, '^(?:[ \t]*>)+', '')), '[ \t\r\n\f\x0B]+', ' ', 'g'), ' ') as norm
  from (select conv, turn, unnest(string_split(text, chr(10))) as line from m)
), e as (
  select conv, norm, turn, max(case when level = 0 then 1 else 0 end) as own, min(case when level > 0 then level end) as level, max(level) as deepest,
         sum(case when level > 0 then 1 else 0 end) as n
  from l where norm <> '' group by conv, norm, turn
), a as (
  select *, max(case when own = 1 then turn end) over (partition by conv, norm order by turn rows between unbounded preceding and 1 preceding) as source from e
), v as (
  select conv, turn, source, level, sum(n) as n, max(deepest) as deepest from a where n > 0 group by conv, turn, source, level
), v2 as (
  select *, min(level) over (partition by conv, turn) as outermost from v
), r as (
  select conv, turn, source, row_number() over (partition by conv, turn order by n desc, source desc) as k
  from v2 where source is not null and level = outermost
), q as (
  select conv, turn, sum(n) as n_quoted, sum(case when source is not null then n else 0 end) as n_linked, max(deepest) as max_level from v2 group by conv, turn
), p as (
  select t.conv, t.turn, t.previous, r.source as answered, n_quoted, n_linked, max_level
  from (select conv, turn, lag(turn) over (partition by conv order by turn) as previous from (select distinct conv, turn from m)) t
  left join q on q.conv = t.conv and q.turn = t.turn
  left join r on r.conv = t.conv and r.turn = t.turn and r.k = 1
), b as (
  select *, max(case when previous is null or answered <> previous then turn end) over (partition by conv order by turn rows between unbounded preceding and current row) as branch from p
), o as (
  select m.*, regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), lambda x: not regexp_matches(x, '^(?:[ \t]*>)+')), chr(10)), '^\n+|\n+$', '', 'g') as own_text from m
)
select conv_id, nullif(branch, -9223372036854775808) as branch, own_turn as turn, nullif(coalesce(answered, previous), -9223372036854775808) as parent, role,
       coalesce(n_quoted, 0)::bigint as n_quoted, coalesce(n_linked, 0)::bigint as n_linked, coalesce(max_level, 0)::bigint as max_level, own_text,
       '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || own_text || chr(10) || '<|end|>' as chat_text
from o join b on b.conv = o.conv and b.turn = o.turn
"""
