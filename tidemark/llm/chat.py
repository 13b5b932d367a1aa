"""Chat formatting with DataFrame functions only: sort turns, merge neighbours of one role, concatenate, mask the loss.

Template: every run of turns of one role is `<|im_start|>role\\n`, its texts with `<|im_sep|>` between them, and
`<|im_end|>\\n`. Inside texts and roles a backslash goes between `<` and `|` wherever only backslashes lie between them,
which parsed() takes away again; in roles, backslashes and line ends are escaped as well. So the output reads back
exactly, whatever the texts hold.

Nulls and odd rows: a null text or role is empty; turns of one number are in the order of role, then text; a null turn
comes first; rows with a null conv_id are one conversation; an empty table gives an empty result. Only the named columns
are read. A conversation is one row of the result, so it has to fit into a row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END, SEP = "<|im_start|>", "<|im_end|>", "<|im_sep|>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def _role(role: Column) -> Column:
    return F.replace(F.replace(escaped(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def _role_back(role: Column) -> Column:
    parts = F.transform(F.split(role, r"\\\\", -1), lambda x: F.replace(x, F.lit("\\n"), F.lit("\n")))
    return unescaped(F.array_join(parts, "\\"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once, also where body has it inside a function of an array's elements."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def formatted(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant") -> DataFrame:
    """conv_id, formatted, and loss_spans: the parts of `formatted` that the loss covers, without template marks.

    A span has start and length in code points, and first and bytes in bytes of UTF-8: the escaped texts of the role
    `learn`. Where a text lies is a running sum over its conversation's turns; all work grows with a conversation's length.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    own = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), empty(role).alias("role"), empty(text).alias("text"))
    along = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumns({"k": F.row_number().over(along), "opens": F.coalesce(F.lag("role").over(along) != F.col("role"), F.lit(True)), "closes": F.coalesce(F.lead("role").over(along) != F.col("role"), F.lit(True))})
    head = lambda r: F.concat(F.lit(START), _role(r), F.lit("\n"))
    own = own.withColumns({"text": escaped(F.col("text")), "mark": F.when(F.col("opens"), head(F.col("role"))).otherwise(SEP), "end": F.when(F.col("closes"), END + "\n").otherwise("")})

    def place(size: Callable) -> Column:
        return (F.coalesce(F.sum(size("mark") + size("text") + size("end")).over(before), F.lit(0)) + size("mark")).cast("long")

    spans = F.struct(place(F.length).alias("start"), F.length("text").cast("long").alias("length"), place(F.octet_length).alias("first"), F.octet_length("text").cast("long").alias("bytes"))
    collected = own.select("conv_id", F.struct("k", "role", "text", "opens", spans.alias("span")).alias("t")).groupBy("conv_id").agg(F.collect_list("t").alias("ts"))

    def merged(ts: Column) -> Column:
        """The runs of one role: their role and texts, each from its first turn to before the next run's."""
        last = lambda firsts, j: F.coalesce(F.get(firsts, j + 1)["k"], F.size(ts) + 1)
        run = lambda firsts: F.transform(firsts, lambda t, j: F.struct(t["role"].alias("role"), F.slice(ts, t["k"], last(firsts, j) - t["k"])["text"].alias("texts")))
        return let(F.filter(ts, lambda t: t["opens"]), run)

    def whole(ts: Column) -> Column:
        blocks = F.transform(merged(ts), lambda r: F.concat(head(r["role"]), F.array_join(r["texts"], SEP), F.lit(END + "\n")))
        return F.struct(F.array_join(blocks, "").alias("formatted"), F.filter(ts, lambda t: t["role"] == learn)["span"].alias("loss_spans"))

    return collected.select("conv_id", let(F.array_sort("ts"), whole).alias("w")).select("conv_id", "w.formatted", "w.loss_spans")


def parsed(text: Column) -> Column:
    """The turns of a formatted conversation, as an array of (role, text)."""
    blocks = F.filter(F.split(text, r"<\|im_start\|>", -1), lambda b, i: i > 0)
    body = lambda b: F.expr("0") + F.length(F.substring_index(b, "\n", 1)) + 2

    def turns(b: Column) -> Column:
        role = _role_back(F.substring_index(b, "\n", 1))
        texts = F.substr(b, body(b), F.length(b) - body(b) + 1 - len(END) - 1)
        return F.transform(F.split(texts, r"<\|im_sep\|>", -1), lambda x: F.struct(role.alias("role"), unescaped(x).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(text: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between: cut out of the bytes, whose places cost nothing to find."""
    part = lambda data: F.transform(spans, lambda s: unescaped(F.decode(F.substring(data, (s["first"] + 1).cast("int"), s["bytes"].cast("int")), "UTF-8")))
    return let(text.cast("binary"), lambda data: F.array_join(part(data), ""))


def digests(conversations: DataFrame) -> DataFrame:
    """Of formatted(): the turns and the text under the loss mask, read back from the output, as counts and hashes."""
    t = conversations.select("conv_id", "formatted", parsed(F.col("formatted")).alias("ts"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("ts", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return t.select(
        "conv_id",
        F.size("ts").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
