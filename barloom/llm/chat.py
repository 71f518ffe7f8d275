"""Chat formatting: a finite-state machine over roles, and a reversible declarative template.

Everything here is DataFrame expressions. A conversation becomes an array of segments, each with its
text and a loss flag; the formatted text is their concatenation. Texts can't be taken for template
marks: three codes that start with a backslash stand for the backslash, a double ``#`` and the closing
mark, and `unescape` undoes them.

Edge cases: null texts count as empty, null roles as the empty role, rows of one turn number are
ordered by role and text, rows with a null conv_id form one conversation. Roles the template doesn't
know are written with a mark of their own, carry no loss and make the conversation invalid. Columns
besides conv_id, turn, role and text are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START = "start"


@dataclass(frozen=True)
class RoleSpec:
    label: str
    loss: bool


@dataclass(frozen=True)
class ChatTemplate:
    """``open`` + label + ``sep`` + escaped text + ``close`` for each turn; ``moves`` are the machine's edges."""

    roles: dict[str, RoleSpec]
    moves: dict[str, tuple[str, ...]]
    final: tuple[str, ...]
    open: str = "### "
    sep: str = ": "
    close: str = "</turn>\n"
    unknown: str = "?"
    codes: tuple[tuple[str, str], ...] = field(default=(("##", "\\h"), ("</turn>", "\\t"), (":", "\\c")))


DEFAULT = ChatTemplate(
    roles={"system": RoleSpec("System", False), "user": RoleSpec("User", False), "assistant": RoleSpec("Assistant", True)},
    moves={START: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    final=("assistant",),
)


def escape(text: Column, t: ChatTemplate = DEFAULT, name: bool = False) -> Column:
    """Codes for the backslash first, then for the control strings; a role's name also hides the separator."""
    out = F.replace(text, F.lit("\\"), F.lit("\\b"))
    for plain, code in t.codes if name else t.codes[:-1]:
        out = F.replace(out, F.lit(plain), F.lit(code))
    return out


def unescape(text: Column, t: ChatTemplate = DEFAULT, name: bool = False) -> Column:
    """Every backslash in escaped text starts a code, so plain replacement is exact if the backslash comes last."""
    out = text
    for plain, code in t.codes if name else t.codes[:-1]:
        out = F.replace(out, F.lit(code), F.lit(plain))
    return F.replace(out, F.lit("\\b"), F.lit("\\"))


def _chosen(role: Column, t: ChatTemplate, value, other) -> Column:
    out = None
    for name, spec in t.roles.items():
        out = F.when(role == name, value(spec)) if out is None else out.when(role == name, value(spec))
    return out.otherwise(other)


def _machine(turns: Column, t: ChatTemplate) -> Column:
    """Fold the roles through the machine: the state at the end and the index of the first turn it refuses (-1: none)."""
    edges = {f"{a}>{b}" for a, bs in t.moves.items() for b in bs}
    allowed = F.array(*map(F.lit, sorted(edges)))
    zero = F.struct(F.lit(START).alias("state"), F.lit(0).alias("at"), F.lit(-1).alias("bad"))

    def step(acc, x):
        ok = F.array_contains(allowed, F.concat(acc["state"], F.lit(">"), x["role"]))
        return F.struct(
            x["role"].alias("state"),
            (acc["at"] + 1).alias("at"),
            F.when((acc["bad"] < 0) & ~ok, acc["at"]).otherwise(acc["bad"]).alias("bad"),
        )

    return F.aggregate(turns, zero, step)


def format_chat(rows: DataFrame, template: ChatTemplate = DEFAULT) -> DataFrame:
    """conv_id, segments array<struct<text, loss>>, formatted, valid, bad_turn (index of the first refused turn, or -1)."""
    t = template
    cell = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(cell)).alias("turns"))

    def segments(x):
        label = _chosen(x["role"], t, lambda s: F.lit(s.label), F.concat(F.lit(t.unknown), escape(x["role"], t, name=True)))
        loss = _chosen(x["role"], t, lambda s: F.lit(s.loss), F.lit(False))
        return F.array(
            F.struct(F.concat(F.lit(t.open), label, F.lit(t.sep)).alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(x["text"], t).alias("text"), loss.alias("loss")),
            F.struct(F.lit(t.close).alias("text"), F.lit(False).alias("loss")),
        )

    out = grouped.select("conv_id", F.flatten(F.transform("turns", segments)).alias("segments"), _machine(F.col("turns"), t).alias("m"))
    return out.select(
        "conv_id", "segments", F.array_join(F.col("segments.text"), "").alias("formatted"),
        ((F.col("m.bad") < 0) & F.col("m.state").isin(*t.final)).alias("valid"), F.col("m.bad").alias("bad_turn"),
    )


def read_back(formatted: Column, template: ChatTemplate = DEFAULT) -> Column:
    """The turns array<struct<role, text>> that a formatted text holds."""
    t = template
    parts = F.split(formatted, t.close.replace("\n", "\\n"))
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)
    by_label = F.create_map(*[F.lit(x) for name, s in t.roles.items() for x in (s.label, name)])

    def turn(p):
        at = F.instr(p, F.lit(t.sep))
        label = F.substr(p, F.lit(len(t.open) + 1), at - len(t.open) - 1)
        role = F.when(label.startswith(t.unknown), unescape(F.substr(label, F.lit(len(t.unknown) + 1)), t, name=True)).otherwise(by_label[label])
        return F.struct(role.alias("role"), unescape(F.substr(p, at + len(t.sep)), t).alias("text"))

    return F.transform(parts, turn)


def chat_digest(rows: DataFrame, template: ChatTemplate = DEFAULT) -> DataFrame:
    """Digests of what can be read back from the formatted output, one row per conversation."""
    out = format_chat(rows, template)
    turns = read_back(F.col("formatted"), template)
    masked = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], template)), "")
    out = out.select("conv_id", "valid", "bad_turn", F.length("formatted").cast("long").alias("formatted_chars"), turns.alias("turns"), masked.alias("masked"))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"), F.sha2(F.col("masked"), 256).alias("loss_sha256"),
        "formatted_chars", "valid", "bad_turn",
    )
