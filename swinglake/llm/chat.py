"""Chat formatting: a finite-state machine over roles, and a template that marks text segments and their loss.

:class:`Template` declares, for each role, what goes before and after a turn's text and whether the text is in the
loss. :func:`format_conversations` turns rows (conversation, turn, role, text) into one row per conversation with the
text, its segments (text, loss) and the machine's verdict; :func:`read_back` recovers turns from the text alone, and
:func:`loss_texts` the learned texts from the segments. Only DataFrame functions are used.

Control strings inside a text are escaped: one backslash is put after their first character (one more, if there are
some already), and taken away on reading, so that no text holds a control string and every text comes back as it was.

Defined results: turns go by turn number, then role, then text (repeated rows are repeated turns; a null turn number
goes last); null texts and roles count as empty; a role without a place in the template is written with the template's
general mark; a conversation that breaks the turn order is formatted all the same and has ``valid`` false; a null
conversation id is a conversation of its own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swinglake.llm.common import table


@dataclass(frozen=True)
class Turn:
    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """``turns`` by role; ``other`` is for further roles, whose name goes between ``before`` and ``name_end``."""

    turns: dict[str, Turn] = field(
        default_factory=lambda: {
            "system": Turn("[SYS] ", " [/SYS]"),
            "user": Turn("[INST] ", " [/INST]"),
            "assistant": Turn("[ANS] ", "</s>", loss=True),
        }
    )
    other: Turn = Turn("[ROLE] ", "[/TURN]")
    name_end: str = " [/ROLE]"
    #: The machine: (state, role) to state. Anything else leads to ``broken``, which has no way out.
    moves: tuple[tuple[str, str, str], ...] = (
        ("start", "system", "told"),
        ("start", "user", "asked"),
        ("told", "user", "asked"),
        ("asked", "assistant", "answered"),
        ("answered", "user", "asked"),
    )
    accepting: tuple[str, ...] = ("answered",)

    def controls(self) -> list[str]:
        turns = [*self.turns.values(), self.other]
        found = {x.strip() for t in turns for x in (t.before, t.after)} | {self.name_end.strip(), "<s>", "</s>"}
        for x in found:
            if not re.fullmatch(r"[<\[][^<\[\\]+", x):
                raise ValueError(f"a control string is one opening < or [ and what follows it without them: {x!r}")
        return sorted(found)


def _quoted(x: str) -> str:
    return re.sub(r"([\\^$.|?*+()\[\]{}/])", r"\\\1", x)


def escaped(text: Column, template: Template) -> Column:
    rest = "|".join(_quoted(x[1:]) for x in template.controls())
    return F.regexp_replace(text, rf"([<\[])(\\*)({rest})", r"$1\\$2$3")


def unescaped(text: Column, template: Template) -> Column:
    rest = "|".join(_quoted(x[1:]) for x in template.controls())
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({rest})", "$1$2$3")


def _segments(turn: Column, template: Template) -> Column:
    """The segments of one turn: before, text, after."""

    def of(before: Column, text: Column, after: str, loss: bool) -> Column:
        return F.array(
            F.struct(before.alias("text"), F.lit(False).alias("loss")),
            F.struct(text.alias("text"), F.lit(loss).alias("loss")),
            F.struct(F.lit(after).alias("text"), F.lit(False).alias("loss")),
        )

    text = escaped(turn["text"], template)
    other = template.other
    out = of(F.concat(F.lit(other.before), escaped(turn["role"], template), F.lit(template.name_end)), text, other.after, other.loss)
    for role, t in template.turns.items():
        out = F.when(turn["role"] == role, of(F.lit(t.before), text, t.after, t.loss)).otherwise(out)
    return out


def machine(roles: Column, template: Template) -> Column:
    """The state after all roles."""
    moves = F.create_map(*[F.lit(x) for a, role, b in template.moves for x in (f"{a}\n{role}", b)])
    return F.aggregate(roles, F.lit("start"), lambda s, r: F.coalesce(F.try_element_at(moves, F.concat_ws("\n", s, r)), F.lit("broken")))


def format_conversations(rows: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, n_turns, formatted, segments array<struct<text, loss>>, state, valid."""
    empty = F.lit("")
    turn = F.struct(
        F.col("turn").isNull().alias("late"),
        F.col("turn").alias("turn"),
        F.coalesce(F.col("role"), empty).alias("role"),
        F.coalesce(F.col("text"), empty).alias("text"),
    )
    return (
        rows.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(turn)).alias("turns"))
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.flatten(F.transform("turns", lambda t: _segments(t, template))).alias("segments"),
            machine(F.col("turns.role"), template).alias("state"),
        )
        .select(
            "conv_id",
            "n_turns",
            F.array_join(F.col("segments.text"), "").alias("formatted"),
            "segments",
            "state",
            F.col("state").isin(*template.accepting).alias("valid"),
        )
    )


def read_back(formatted: Column, template: Template = Template()) -> Column:
    """array<struct<role, text>> from a formatted conversation."""
    starts = {role: t.before for role, t in template.turns.items()}
    marks = "|".join(_quoted(x) for x in [*starts.values(), template.other.before])
    pieces = F.filter(F.split(formatted, f"(?={marks})"), lambda x: x != "")

    def turn(piece: Column) -> Column:
        other, name_end = template.other, template.name_end
        at = F.locate(name_end, piece)
        out = F.struct(
            unescaped(piece.substr(F.lit(len(other.before) + 1), at - 1 - len(other.before)), template).alias("role"),
            unescaped(piece.substr(at + len(name_end), F.length(piece) - at - len(name_end) + 1 - len(other.after)), template).alias("text"),
        )
        for role, t in template.turns.items():
            body = piece.substr(F.lit(len(t.before) + 1), F.length(piece) - len(t.before) - len(t.after))
            out = F.when(F.startswith(piece, F.lit(t.before)), F.struct(F.lit(role).alias("role"), unescaped(body, template).alias("text"))).otherwise(out)
        return out

    return F.transform(pieces, turn)


def loss_texts(segments: Column, template: Template = Template()) -> Column:
    """What is learned of each segment under the loss, unescaped, in order."""
    return F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"], template))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    rows = rows.unionByName(spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], rows.schema))
    return (
        format_conversations(rows)
        .select("conv_id", "formatted", "state", "valid", read_back(F.col("formatted")).alias("turns"), F.array_join(loss_texts(F.col("segments")), "").alias("learned"))
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
            F.length("learned").cast("long").alias("loss_chars"),
            F.sha2("learned", 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
            "state",
            "valid",
        )
    )


OP4_SQL = r"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), turns AS (
    SELECT *, length(text) + len(regexp_extract_all(text, '[<\[]\\*(/?s>|/?(INST|SYS|ROLE)\]|ANS\]|/TURN\])')) AS body FROM rows
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       sum(body + CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 10
                  ELSE 22 + length(role) + len(regexp_extract_all(role, '[<\[]\\*(/?s>|/?(INST|SYS|ROLE)\]|ANS\]|/TURN\])')) END)::BIGINT AS formatted_chars,
       CASE WHEN regexp_full_match(string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, '' ORDER BY turn, role, text), 's?(ua)+') THEN 'answered'
            WHEN regexp_full_match(string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, '' ORDER BY turn, role, text), 's?(ua)*u') THEN 'asked'
            WHEN string_agg(CASE role WHEN 'system' THEN 's' ELSE 'x' END, '') = 's' THEN 'told'
            ELSE 'broken' END AS state,
       regexp_full_match(string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, '' ORDER BY turn, role, text), 's?(ua)+') AS valid
FROM turns GROUP BY conv_id
"""
