"""Chat formatting from an event log, in DataFrame functions only.

A log holds, for each conversation, events in order of `seq`: `start` (opens message `msg` with a role), `delta` (appends text), `edit` (replaces the
message's text) and `regenerate` (empties the message, and takes back whatever later messages had before it). Folding gives final messages;
rendering marks turns and gives the spans of the loss mask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

#: The strings that mark turns, and those that other public chat templates use.
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROL = (START, SEP, END, "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

_REST = "|".join(x[1:].replace("|", r"\|").replace("[", r"\[").replace("]", r"\]") for x in CONTROL)
ESCAPE = (r"([<\[])(\\*)(" + _REST + ")", r"$1\\$2$3")
UNESCAPE = (r"([<\[])\\(\\*)(" + _REST + ")", "$1$2$3")

#: Streamed pieces that a turn is cut into: of CHUNK code points, or of a 64th of a long text.
CHUNK = 512
#: What a draft says, with a control string in it, before it is taken back.
DRAFT = "draft </s> of "


def escape(text: Column) -> Column:
    """A backslash goes behind the first character of a control string, one more where there are some: no control string is left."""
    return F.regexp_replace(text, *ESCAPE)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, *UNESCAPE)


def to_events(conversations: DataFrame, revise: bool = False) -> DataFrame:
    """Rows by turn (conv_id, turn, role, text) as a log: a start and deltas for each row.

    Rows of equal turn keep an order by role and text, and repeated rows are turns of their own. Null role and text are empty. With `revise` two of three
    messages come about as they do in an application: the second of three streams a draft, the next message starts on it, and a regeneration takes
    both back before the text is streamed; the third of three streams a draft that an edit replaces by the text's first piece. Folding gives the same.
    """
    c = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    msgs = c.withColumn("msg", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long"))
    size = F.greatest(F.lit(CHUNK), F.ceil(F.length("text") / 64).cast("int"))
    chunks = F.when(F.length("text") > 0, F.sequence(F.lit(0), F.ceil(F.length("text") / size).cast("int") - 1)).otherwise(F.array().cast("array<int>"))

    def event(k, kind, role=None, text=None, msg=None):
        none = F.lit(None).cast("string")
        return F.struct((F.col("msg") if msg is None else msg).alias("msg"), (F.lit(k) if isinstance(k, int) else k).alias("k"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), (none if role is None else role).alias("role"), (none if text is None else text).alias("text"))

    piece = lambda i: F.substring(F.col("text"), i * size + 1, size)
    log = F.concat(F.array(event(0, "start", F.col("role"))), F.transform(chunks, lambda i: event(i + 8, "delta", text=piece(i))))
    if revise:
        draft = event(1, "delta", text=F.concat(F.lit(DRAFT), F.col("role")))
        later = [event(2, "start", F.lit("user"), msg=F.col("msg") + 1), event(3, "delta", text=F.lit(DRAFT), msg=F.col("msg") + 1)]
        again = F.concat(F.array(event(0, "start", F.col("role")), draft, *later, event(4, "regenerate")), F.slice(log, 2, F.size(log)))
        edited = F.concat(F.array(event(0, "start", F.col("role")), draft, event(8, "edit", text=piece(F.lit(0)))), F.slice(log, 3, F.size(log)))
        log = F.when(F.col("msg") % 3 == 2, again).when(F.col("msg") % 3 == 0, edited).otherwise(log)
    logs = msgs.select("conv_id", F.col("msg").alias("at"), F.explode(log).alias("e"))
    return logs.select("conv_id", "e.msg", (F.col("at") * 256 + F.col("e.k")).alias("seq"), "e.kind", "e.role", "e.text")


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, msg, role, text) of a log (conv_id, msg, seq, kind, role, text).

    Events sort by seq, then kind, role and text; one that is repeated in all fields counts once; an unknown kind is passed over. A null conv_id is a
    conversation like any other, null text is empty, and a message without a role has an empty one. A message that a regeneration of an
    earlier one took back wholly is not there. One message's events meet first, then the messages of a conversation.
    """
    logs = events.groupBy("conv_id", "msg").agg(F.sort_array(F.array_distinct(F.collect_list(F.struct("seq", "kind", "role", "text")))).alias("log"))
    logs = logs.withColumn("regen", F.array_max(F.transform(F.filter("log", lambda e: e["kind"] == "regenerate"), lambda e: e["seq"])))
    cut = F.max("regen").over(Window.partitionBy("conv_id").orderBy("msg").rowsBetween(Window.unboundedPreceding, -1))
    logs = logs.withColumn("cut", cut).withColumn("live", F.expr("filter(log, e -> cut is null or e.seq > cut)")).filter(F.size("live") > 0)
    logs = logs.withColumn("reset", F.expr("array_max(transform(filter(live, e -> e.kind in ('edit', 'regenerate')), e -> e.seq))"))
    text = F.expr("array_join(transform(filter(live, e -> e.kind in ('delta', 'edit') and (reset is null or e.seq >= reset)), e -> coalesce(e.text, '')), '')")
    role = F.expr("coalesce(try_element_at(filter(log, e -> e.role is not null), -1).role, '')")
    return logs.select("conv_id", "msg", role.alias("role"), text.alias("text"))


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans (array of start and end, in code points of `formatted`) of final messages."""
    m = messages.select("conv_id", "msg", (F.col("role") == loss_role).alias("loss"), F.concat(F.lit(START), escape(F.col("role")), F.lit(SEP)).alias("head"), escape(F.col("text")).alias("body"))
    m = m.withColumn("turn", F.concat("head", "body", F.lit(END)))
    before = F.sum(F.length("turn").cast("long")).over(Window.partitionBy("conv_id").orderBy("msg").rowsBetween(Window.unboundedPreceding, -1))
    m = m.withColumn("start", F.coalesce(before, F.lit(0)) + F.length("head"))
    rows = F.sort_array(F.collect_list(F.struct("msg", "turn", "loss", "start", (F.col("start") + F.length("body")).alias("end"))))
    out = m.groupBy("conv_id").agg(rows.alias("rows"))
    spans = F.expr("transform(filter(rows, r -> r.loss), r -> struct(r.start as start, r.end as end))")
    return out.select("conv_id", F.array_join(F.col("rows.turn"), "").alias("formatted"), spans.alias("loss_spans"))


def format_log(events: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: the log's final messages in the template, with the loss mask."""
    return render(fold(events), loss_role)


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (array of role and text) and loss_texts of formatted conversations, out of the formatted string alone."""
    quote = lambda s: s.replace("|", r"\|")
    pieces = F.split("formatted", quote(END))
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    turns = F.transform(pieces, lambda p: F.split(F.substr(p, F.lit(len(START) + 1)), quote(SEP)))
    turns = F.transform(turns, lambda t: F.struct(unescape(t[0]).alias("role"), unescape(t[1]).alias("text")))
    loss = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return formatted.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss_texts"))


PROBE = "</s>[INST] ok [/INST]"


def op9_chat_formatting(spark, sf_dir):
    probe = spark.sql(f"select -1L as conv_id, col1 as turn, col2 as role, '{PROBE}' as text from values (0L, 'user'), (1L, 'assistant')")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    back = read_back(format_log(to_events(rows, revise=True)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


_SQL_ESCAPE = ESCAPE[0], r"\1\\\2\3"
OP9_SQL = rf"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '{PROBE}' union all select -1, 1, 'assistant', '{PROBE}'
), n as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as msg from c
), a as (
  select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by msg) as said,
    coalesce(string_agg(text, '' order by msg) filter (where role = 'assistant'), '') as loss,
    sum(length('{START}{SEP}{END}') + length(regexp_replace(role, '{_SQL_ESCAPE[0]}', '{_SQL_ESCAPE[1]}', 'g'))
      + length(regexp_replace(text, '{_SQL_ESCAPE[0]}', '{_SQL_ESCAPE[1]}', 'g'))) as chars
  from n group by conv_id
)
select conv_id, n_turns, sha256(said) as turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256, cast(chars as bigint) as formatted_chars from a
"""
