r"""Chat formatting by a declarative template, with native functions only.

A template names its control strings, its roles, the turns that may follow each other (a finite-state
machine whose states are ``start`` and the roles) and the roles whose texts count for the loss.  Every
turn becomes the segments  open + role + newline | text | close, of which the text alone carries a loss
flag.

Control strings begin with ``<|``.  Inside texts ``<`` + n backslashes + ``|`` is written with n + 1
backslashes, which never leaves a ``<|`` and is undone exactly; roles are percent-coded where they
hold ``%``, ``<`` or a line feed.

Edge cases: a null text or role is an empty one; turns are ordered by (turn, role, text) with nulls
first, so ties and repeated rows have one order and all of them stay; conversations that break the
turn order are formatted too, with valid = false; rows with a null conversation id form one
conversation; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ERROR = "error"


@dataclass(frozen=True)
class Template:
    """open and close begin with "<|"; follows: state -> roles that may come next."""

    open: str = "<|im_start|>"
    close: str = "<|im_end|>\n"
    follows: dict[str, list[str]] = field(default_factory=lambda: {
        "start": ["system", "user"], "system": ["user"], "user": ["assistant"], "assistant": ["user"]})
    loss_roles: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        if not (self.open.startswith("<|") and self.close.startswith("<|")) or self.open in self.close or self.close in self.open:
            raise ValueError("control strings must begin with <| and differ")


def escape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("<"), F.lit("%3C")), F.lit("\n"), F.lit("%0A"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%3C"), F.lit("<")), F.lit("%25"), F.lit("%"))


def _step(template: Template) -> Column:
    """A map from state and role to the next state."""
    moves = [(f"{state}\n{role}", role) for state, roles in sorted(template.follows.items()) for role in roles]
    return F.create_map(*[F.lit(x) for move in moves for x in move])


def format_chats(df: DataFrame, template: Template = Template(), *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation: conv, n_turns long, final_state string, valid boolean (every move
    is one of the template's), formatted string, segments array<struct<text, loss>> in order, whose
    texts make up formatted, and loss_spans array<struct<start long, length long>>: the code points
    of formatted under the loss mask."""
    rows = df.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("body", escape_text(F.col("text"))).withColumn("head", F.concat(F.lit(template.open), escape_role(F.col("role")), F.lit("\n")))
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    size = F.length("head") + F.length("body") + len(template.close)
    before = F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("at", before + F.length("head")).withColumn("place", F.row_number().over(order))
    packed = F.struct("place", "role", "head", "body", F.col("at").cast("long").alias("at"), F.col("role").isin(*template.loss_roles).alias("loss"))
    turns = rows.groupBy("conv").agg(F.sort_array(F.collect_list(packed)).alias("turns"))
    step = _step(template)
    state = F.aggregate("turns", F.lit("start"), lambda s, t: F.coalesce(F.element_at(step, F.concat(s, F.lit("\n"), t["role"])), F.lit(ERROR)))
    segment = lambda s, loss: F.struct(s.alias("text"), loss.alias("loss"))
    segments = F.flatten(F.transform("turns", lambda t: F.array(segment(t["head"], F.lit(False)), segment(t["body"], t["loss"]), segment(F.lit(template.close), F.lit(False)))))
    spans = F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: F.struct(t["at"].alias("start"), F.length(t["body"]).cast("long").alias("length")))
    return (turns.withColumn("final_state", state).withColumn("segments", segments)
            .select(F.col("conv").alias(conv), F.size("turns").cast("long").alias("n_turns"), "final_state", (F.col("final_state") != ERROR).alias("valid"),
                    F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments", spans.alias("loss_spans")))


def parse_chats(df: DataFrame, template: Template = Template(), *, formatted: str = "formatted") -> DataFrame:
    """df with turns array<struct<role, text>>, read back from the formatted string."""
    parts = F.split(F.col(formatted), rf"\Q{template.open}\E")
    parts = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))

    def turn(part: Column) -> Column:
        at = F.instr(part, F.lit("\n"))
        text = F.substring(part, at + 1, F.length(part) - at - len(template.close))
        return F.struct(unescape_role(F.substring(part, F.lit(1), at - 1)).alias("role"), unescape_text(text).alias("text"))

    return df.withColumn("turns", F.transform(parts, turn))


def masked_texts(df: DataFrame, *, formatted: str = "formatted", spans: str = "loss_spans") -> Column:
    """The unescaped texts under the loss mask, in order, read from the formatted string."""
    return F.transform(df[spans], lambda s: unescape_text(F.substring(df[formatted], (s["start"] + 1).cast("int"), s["length"].cast("int"))))
