"""Chat formatting: a finite-state machine over roles that emits segments, and a declarative template.

A template names for each role the control strings before and after a turn's text and whether
the text counts for the loss, and for each state which role may follow and where it leads. From these
the machine's transitions are made, one for each state and role, with their output: control strings, loss
flag and next state. A turn out of order has a transition too: it goes where its role leads elsewhere and marks the
conversation as not valid. A fold over the turns runs the machine; segments and loss flags are the outputs of
the transitions it takes. Texts are escaped so that no control string occurs in them: a
control string (possibly with backslashes already behind its first character) gets one more
backslash there, and reading takes one away, so any text survives, and others stay as they are.

The result has one row per conversation: formatted, the segments (text, loss) whose texts
make up formatted, n_turns, states (names of the states passed through, the start included), and valid: whether all
turns were in order and the last state is one to end in. All conversations are formatted, valid or not. Only
built-in functions are used.

A conversation is one row of the result, and its digests run over all of it, so its turns
meet in one task; groups of turns are as large as the longest conversation, not larger.

Defined results: a null text is empty; a null role is the role ""; turns are in ascending
order with null first, and equal turns by role, then text, so repeated rows are kept; a null
conversation id is a conversation of its own; other columns are ignored; an empty table gives
an empty result. A template of over 60 states or 60 roles is refused, as each has a sign of its own in the machine.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import let


@dataclass(frozen=True)
class Template:
    """roles: role -> (before, after, loss). Any other role's turn is other[0] role other[1] text other[2].

    order: state -> role -> next state; it begins in start and is valid if it ends in ends.
    """

    roles: dict[str, tuple[str, str, bool]] = field(
        default_factory=lambda: {
            "system": ("<<SYS>>", "<</SYS>>", False),
            "user": ("[INST]", "[/INST]", False),
            "assistant": ("<s>", "</s>", True),
        }
    )
    other: tuple[str, str, str] = ("<role>", "</role>", "</turn>")
    order: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "ready", "user": "asked"},
            "ready": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    start: str = "start"
    ends: tuple[str, ...] = ("answered",)

    def __post_init__(self) -> None:
        if len(self.states()) > 60 or len(self.roles) > 60:
            raise ValueError("60 states and 60 roles at most, each has a sign of its own")
        controls = self.controls()
        if len(set(controls)) < len(controls) or any(len(c) < 2 or "\\" in c for c in controls):
            raise ValueError("control strings must differ, have two characters or more and no backslash")
        for a in controls:
            for b in controls:
                if (a != b and a in b) or any(a[-n:] == b[:n] for n in range(1, min(len(a), len(b)))):
                    raise ValueError(f"control strings must not overlap: {a} and {b}")

    def controls(self) -> list[str]:
        return [c for before, after, _ in self.roles.values() for c in (before, after)] + list(self.other)

    def states(self) -> list[str]:
        """All states, the start first."""
        named = [self.start, *self.order, *(to for row in self.order.values() for to in row.values()), *self.ends]
        return list(dict.fromkeys(named))

    def escaped(self, text: Column) -> Column:
        for first in sorted({c[0] for c in self.controls()}):
            rest = "|".join(_quoted(c[1:]) for c in self.controls() if c[0] == first)
            text = F.regexp_replace(text, f"({_quoted(first)}\\\\*)({rest})", r"$1\\$2")
        return text

    def unescaped(self, text: Column) -> Column:
        for first in sorted({c[0] for c in self.controls()}):
            rest = "|".join(_quoted(c[1:]) for c in self.controls() if c[0] == first)
            text = F.regexp_replace(text, f"({_quoted(first)}\\\\*)\\\\({rest})", "$1$2")
        return text


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() else f"\\x{{{ord(c):x}}}" for c in text)


def transitions(template: Template) -> dict[str, tuple[str, str | None, str, bool, str, bool]]:
    """Codes of state and role (one sign each) -> before, between (for other roles: the role comes first), after, loss, next state, in order.

    A role out of order leads where it first leads in the template; one that leads nowhere leaves the state as it is.
    """
    states, roles = template.states(), [*template.roles, None]
    leads = {r: to for row in reversed(list(template.order.values())) for r, to in row.items()}
    made = {}
    for s, state in enumerate(states):
        for r, role in enumerate(roles):
            allowed = template.order.get(state, {}).get(role)
            target = states.index(allowed or leads.get(role, state))
            before, after, loss = template.roles.get(role, (None, None, False))
            if role is None:
                before, between, after = template.other
            else:
                between = None
            made[_sign(s) + _sign(r)] = (before, between, after, loss, _sign(target), allowed is not None)
    return made


def _sign(k: int) -> str:
    return chr(ord("A") + k)


def machine(template: Template, roles: Column) -> Column:
    """Of an array of roles, the signs of the states passed through: the start, and one behind each turn."""
    moves = F.create_map(*[F.lit(x) for code, t in transitions(template).items() for x in (code, t[4])])
    step = lambda path, role: F.concat(path, F.element_at(moves, F.concat(F.right(path, F.lit(1)), role)))
    return F.aggregate(_role_signs(template, roles), F.lit(_sign(template.states().index(template.start))), step)


def _role_signs(template: Template, roles: Column) -> Column:
    known = list(template.roles)

    def sign(role: Column) -> Column:
        out = F.lit(_sign(len(known)))
        for k, name in enumerate(known):
            out = F.when(role == name, _sign(k)).otherwise(out)
        return out

    return F.transform(roles, sign)


def format_conversations(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, n_turns, valid, states, formatted, segments of conversations (conv_id, turn, role, text)."""
    t = template or Template()
    row = F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns"))
    output = lambda x: F.struct(*[F.lit(v).cast(kind).alias(n) for n, v, kind in zip(("before", "between", "after", "loss", "to", "ordered"), x, ("string", "string", "string", "boolean", "string", "boolean"), strict=True)])
    outputs = F.create_map(*[c for code, x in transitions(t).items() for c in (F.lit(code), output(x))])
    roles = F.transform("turns", lambda x: x["role"])
    # The states as an array, and the transition that each turn takes.
    passed = let(F.split(machine(t, roles), ""), lambda path: F.slice(path, F.lit(1), F.size("turns") + 1))
    taken = lambda run: F.zip_with(run["roles"], F.slice(run["path"], F.lit(1), F.size(run["roles"])), lambda role, state: F.element_at(outputs, F.concat(state, role)))

    def formed(run: Column) -> Column:
        def pieces(x: Column, move: Column) -> Column:
            part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
            head = F.when(move["between"].isNull(), move["before"]).otherwise(F.concat(move["before"], t.escaped(x["role"]), move["between"]))
            return F.array(part(head, F.lit(False)), part(t.escaped(x["text"]), move["loss"]), part(move["after"], F.lit(False)))

        def of(moves: Column) -> Column:
            good = F.forall(moves, lambda m: m["ordered"]) & F.element_at(run["path"], -1).isin(*[_sign(t.states().index(s)) for s in t.ends])
            names = F.create_map(*[F.lit(x) for k, s in enumerate(t.states()) for x in (_sign(k), s)])
            return F.struct(
                good.alias("valid"), F.transform(run["path"], lambda s: F.element_at(names, s)).alias("states"),
                F.flatten(F.zip_with("turns", moves, pieces)).alias("segments"),
            )

        return let(taken(run), of)

    ran = let(F.struct(_role_signs(t, roles).alias("roles"), passed.alias("path")), formed)
    rows = grouped.select("conv_id", F.size("turns").cast("long").alias("n_turns"), ran.alias("ran")).select("conv_id", "n_turns", "ran.*")
    return rows.select("conv_id", "n_turns", "valid", "states", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_formatted(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """Reads the output back: adds turns (role, text) from formatted and loss_text from the segments under the loss mask."""
    t = template or Template()
    named = list(t.roles.items())
    ends = [f"{_quoted(b)}(.*?){_quoted(a)}" for _, (b, a, _) in named]
    pattern = "(?s)" + "|".join([*ends, f"{_quoted(t.other[0])}(.*?){_quoted(t.other[1])}(.*?){_quoted(t.other[2])}"])
    turns = F.regexp_extract_all(F.col("formatted"), F.lit(pattern), F.lit(0))

    def turn(raw: Column) -> Column:
        body = F.substring(raw, F.lit(len(t.other[0]) + 1), F.length(raw) - len(t.other[0]) - len(t.other[2]))
        at = F.instr(body, t.other[1])
        out = F.struct(t.unescaped(F.substring(body, F.lit(1), at - 1)).alias("role"), t.unescaped(F.substring(body, at + len(t.other[1]), F.length(body))).alias("text"))
        for role, (before, after, _) in named:
            text = F.substring(raw, F.lit(len(before) + 1), F.length(raw) - len(before) - len(after))
            out = F.when(raw.startswith(before), F.struct(F.lit(role).alias("role"), t.unescaped(text).alias("text"))).otherwise(out)
        return out

    loss = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: t.unescaped(s["text"]))
    return formatted.select("*", F.transform(turns, turn).alias("turns"), F.array_join(loss, "").alias("loss_text"))
