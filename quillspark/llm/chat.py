"""Chat formatting with built-in functions only: a declarative template, a finite-state machine over roles, loss flags.

A conversation becomes a list of segments ``struct<role, text, loss>``; the formatted text is their concatenation. A turn
is ``<role>`` + text + ``<end>``, as the template says; a role that the template does not name is written ``<:role>``, so
that none can pass for a mark. Every ``<``, ``[`` and ``\\`` inside a text or a role is escaped
as ``\\l``, ``\\b`` and ``\\e``, so a control string (the template's own or another's, such as ``[INST]`` or ``</s>``)
never stands in a text, and unescaping gives the text back exactly.

Defined cases: null texts and roles count as empty; turns are ordered by turn (null first), then role, then text, repeated
rows included; an unknown role is formatted without loss and makes the conversation invalid; rows of a null conv_id form
one conversation; an empty table gives only what is added to it; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import docs_table

#: Marks of a turn and whether its text is learnt; "*" is any other role.
TEMPLATE = {
    "system": {"open": "<system>", "close": "<end>", "loss": False},
    "user": {"open": "<user>", "close": "<end>", "loss": False},
    "assistant": {"open": "<assistant>", "close": "<end>", "loss": True},
    "*": {"open": "<:{role}>", "close": "<end>", "loss": False},
}

#: The machine: state -> roles that may come next; the state is the last turn's role.
TURN_ORDER = {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
FINAL = ("assistant",)

_ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"))


def escape(text: Column) -> Column:
    for raw, coded in _ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    """Every backslash of an escaped text begins an escape, so the single passes cannot meet; \\e must come last."""
    for raw, coded in reversed(_ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(raw))
    return text


def escape_role(role: Column) -> Column:
    """A role stands inside a mark, so its end must not stand in it either."""
    return F.replace(escape(role), F.lit(">"), F.lit("\\g"))


def _mark(role: Column, template: dict, key: str) -> Column:
    out = F.lit(None).cast("string")
    for name, spec in template.items():
        if name != "*":
            out = F.when(role == name, F.lit(spec[key])).otherwise(out)
    before, _, after = template["*"][key].partition("{role}")
    rest = F.concat(F.lit(before), escape_role(role), F.lit(after)) if "{role}" in template["*"][key] else F.lit(template["*"][key])
    return F.coalesce(out, rest)


def format_conversations(turns: DataFrame, template: dict = TEMPLATE, order: dict = TURN_ORDER, final: tuple = FINAL) -> DataFrame:
    """conv_id, n_turns, segments, formatted, valid and bad_turn (place of the first turn out of order, from 0).

    One shuffle brings a conversation's turns together; the machine's steps, the segments and their loss follow in place.
    """
    learnt = [k for k, v in template.items() if v["loss"] and k != "*"]
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select("conv_id", F.struct(F.col("turn"), role.alias("role"), text.alias("text")).alias("t"))
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    allowed = F.array(*[F.lit(f"{a}>{b}") for a, nexts in order.items() for b in nexts])
    before = lambda i: F.when(i > 0, F.get("ts", i - 1)["role"]).otherwise(F.lit(""))
    steps = F.transform("ts", lambda t, i: F.array_contains(allowed, F.concat(before(i), F.lit(">"), t["role"])))

    def parts(t: Column) -> Column:
        seg = lambda x, loss: F.struct(t["role"].alias("role"), x.alias("text"), loss.alias("loss"))
        return F.array(seg(_mark(t["role"], template, "open"), F.lit(False)), seg(escape(t["text"]), t["role"].isin(*learnt)), seg(_mark(t["role"], template, "close"), F.lit(False)))

    segments = F.flatten(F.transform("ts", parts))
    out = convs.select("conv_id", F.size("ts").cast("long").alias("n_turns"), segments.alias("segments"), steps.alias("_ok"), F.element_at("ts", -1)["role"].alias("_last"))
    bad = F.array_position("_ok", F.lit(False)) - 1
    return out.select(
        "conv_id", "n_turns", "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        ((bad < 0) & F.col("_last").isin(*final)).alias("valid"),
        F.when(bad >= 0, bad).alias("bad_turn"),
    )


def read_back(formatted: Column, end: str = "<end>") -> Column:
    """The turns array<struct<role, text>> of a formatted text: no raw ``<`` or ``[`` stands in a text, so marks split it."""
    pieces = F.split(formatted, end)
    inner = F.slice(pieces, 1, F.size(pieces) - 1)
    mark = lambda p: F.substring_index(F.substr(p, F.lit(2)), ">", 1)
    name = lambda m: F.when(F.startswith(m, F.lit(":")), F.substr(m, F.lit(2))).otherwise(m)
    role = lambda p: unescape(F.replace(name(mark(p)), F.lit("\\g"), F.lit(">")))
    return F.transform(inner, lambda p: F.struct(role(p).alias("role"), unescape(F.substr(p, F.locate(">", p) + 1)).alias("text")))


#: A conversation made of control strings, which a template must keep apart from its own.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = docs_table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    added = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role")) for i, r in enumerate(("user", "assistant"))])).alias("x"))
    turns = turns.unionByName(added.select("conv_id", "x.turn", "x.role", F.lit(CONTROL_TEXT).alias("text")))
    done = format_conversations(turns)
    learnt = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    read = done.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), learnt.alias("learnt"), "valid", "bad_turn")
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        F.col("bad_turn").cast("long").alias("bad_turn"),
    )


OP3_SQL = r"""
WITH t AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(text) + length(regexp_replace(text, '[^<\[\\]', '', 'g')) AS coded,
             length(role) + length(regexp_replace(role, '[^<>\[\\]', '', 'g')) + 7 + CAST(role NOT IN ('system', 'user', 'assistant') AS INT) AS marks,
             row_number() OVER w - 1 AS place, count(*) OVER (PARTITION BY conv_id) AS n, coalesce(lag(role) OVER w, '') || '>' || role AS step
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
m AS (SELECT *, step NOT IN ('>system', '>user', 'system>user', 'user>assistant', 'assistant>user') AS bad FROM e)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(coded + marks) AS BIGINT) AS formatted_chars,
  NOT bool_or(bad) AND bool_or(place = n - 1 AND role = 'assistant') AS valid,
  CAST(min(place) FILTER (bad) AS BIGINT) AS bad_turn
FROM m GROUP BY conv_id
"""
