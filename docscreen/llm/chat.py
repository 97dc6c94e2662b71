"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Method. Every assistant turn becomes an example of its own: all turns before it are context and
only that reply is trainable. The conversation is formatted once; an example is the prefix of that
text up to its reply, with the reply's place as the loss mask. Turns after the last reply (or a
conversation without one) come as one more example that trains nothing, so no turn is lost.

Template: ``### <role>: <text></turn>\\n`` per turn. In texts and roles a backslash is written
``\\b``, the opening ``### `` ``\\h`` and the closing ``</turn>`` ``\\e``; in roles a colon is also
``\\c``. A backslash always starts one of these, so ``unescape`` gives back the very text.

Defined cases: null texts and roles are empty; turns are ordered by (turn, role, text), null turns
first; a null conv_id is one conversation; repeated rows are repeated turns; other columns are
ignored; an empty table gives no example.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docscreen.llm.common import read

OPEN, CLOSE = "### ", "</turn>"
ASSISTANT = "assistant"
#: A conversation whose texts spell the control strings.
PROBE_ID, PROBE_TEXT = -7, "\\### Assistant: </turn> ok"


def _all(column: Column, changes: list[tuple[str, str]]) -> Column:
    for old, new in changes:
        column = F.replace(column, F.lit(old), F.lit(new))
    return column


_TEXT = [("\\", "\\b"), (OPEN, "\\h"), (CLOSE, "\\e")]
_ROLE = [*_TEXT, (":", "\\c")]


def escape(text: Column, role: bool = False) -> Column:
    return _all(text, _ROLE if role else _TEXT)


def unescape(text: Column, role: bool = False) -> Column:
    # The backslash comes back last: until then each one starts an escape.
    return _all(text, [(new, old) for old, new in reversed(_ROLE if role else _TEXT)])


def examples(conversations: DataFrame, trained_role: str = ASSISTANT) -> DataFrame:
    """conv_id, example (0..), formatted, loss_start (code points from 0), loss_length."""
    head = F.concat(F.lit(OPEN), escape(F.coalesce("role", F.lit("")), role=True), F.lit(": "))
    body = escape(F.coalesce("text", F.lit("")))
    turns = conversations.select(
        "conv_id", F.struct(
            "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
            head.alias("head"), body.alias("body")).alias("t"))
    # A conversation is one text in the end, so its turns meet in one row.
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    tail = len(CLOSE) + 1
    placed = whole.select(
        "conv_id", "turns",
        F.concat_ws("", F.transform("turns", lambda t: F.concat(t.head, t.body, F.lit(CLOSE + "\n")))).alias("formatted"),
        # Where each turn ends, counted in code points.
        F.aggregate("turns", F.expr("cast(array() as array<int>)"), lambda ends, t: F.concat(
            ends, F.array(F.coalesce(F.try_element_at(ends, F.lit(-1)), F.lit(0))
                          + F.length(t.head) + F.length(t.body) + F.lit(tail)))).alias("ends"))
    numbered = placed.withColumn("k", F.sequence(F.lit(0), F.size("turns") - 1))
    replies = F.filter("k", lambda i: F.get("turns", i)["role"] == F.lit(trained_role))
    wanted = F.concat(replies, F.filter(
        F.array(F.size("turns") - 1), lambda i: F.get("turns", i)["role"] != F.lit(trained_role)))
    rows = numbered.select("conv_id", "turns", "formatted", "ends", F.posexplode(wanted).alias("example", "i"))
    own = F.get("turns", F.col("i"))
    end = F.get("ends", F.col("i"))
    trained = own["role"] == F.lit(trained_role)
    return rows.select(
        "conv_id", "example", F.substring("formatted", F.lit(1), end).alias("formatted"),
        F.when(trained, end - F.lit(tail) - F.length(own["body"])).otherwise(0).alias("loss_start"),
        F.when(trained, F.length(own["body"])).otherwise(0).alias("loss_length"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text), losses (texts under the mask, in order), formatted_chars."""
    per = formatted.select(
        "conv_id", "example", "formatted", F.length("formatted").alias("n"), "loss_length",
        unescape(F.substring("formatted", F.col("loss_start") + 1, F.col("loss_length"))).alias("loss"))
    whole = per.groupBy("conv_id").agg(
        F.max(F.struct("n", "formatted")).alias("longest"), F.sum("n").alias("formatted_chars"),
        F.sort_array(F.collect_list(F.struct("example", "loss"))).alias("losses"))
    # Control strings occur only where the template put them.
    pieces = F.filter(F.split("longest.formatted", CLOSE + "\n", -1), lambda p: p != F.lit(""))
    turns = F.transform(pieces, _turn)
    return whole.select("conv_id", turns.alias("turns"), F.col("losses.loss").alias("losses"), "formatted_chars")


def _turn(piece: Column) -> Column:
    inner = F.substring(piece, F.lit(len(OPEN) + 1), F.length(piece))
    role = F.substring_index(inner, ": ", 1)
    return F.struct(unescape(role, role=True).alias("role"),
                    unescape(F.substring(inner, F.length(role) + F.lit(3), F.length(inner))).alias("text"))


def with_probe(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The conversations and one more, a user and an assistant turn that spell the template."""
    probe = spark.range(2).select(
        F.lit(PROBE_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(ASSISTANT).alias("role"), F.lit(PROBE_TEXT).alias("text"))
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = read_back(examples(with_probe(spark, read(spark, sf_dir, "conversations"))))
    said = F.concat_ws("", F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))))
    loss = F.concat_ws("", "losses")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"))


def _sql_escape(column: str, role: bool = False) -> str:
    for old, new in _ROLE if role else _TEXT:
        column = f"replace({column}, '{old}', '{new}')"
    return column


ORACLE = f"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select {PROBE_ID}, 0, 'user', '{PROBE_TEXT}' union all select {PROBE_ID}, 1, 'assistant', '{PROBE_TEXT}'),
sized as (
  select *, length({_sql_escape("role", True)}) + length({_sql_escape("text")}) + {len(OPEN) + 2 + len(CLOSE) + 1} as n,
    row_number() over (partition by conv_id order by turn nulls first, role, text) as k from rows),
placed as (
  select *, sum(n) over (partition by conv_id order by k) as upto,
    k = max(k) over (partition by conv_id) as last from sized)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by k) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(case when role = 'assistant' or last then upto else 0 end) as bigint) as formatted_chars
from placed group by conv_id
"""
