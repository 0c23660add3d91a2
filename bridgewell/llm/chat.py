"""Chat formatting by prefix-target expansion, with DataFrame functions alone.

A conversation is rendered once; every assistant turn is an example whose context is the rendered prefix before
its reply, and only that reply is trainable. `expand_examples` explodes the examples into rows of their own, each with its prefix. Before
that an example is held as offsets into the rendered text, so that what is shuffled and kept of a conversation of n turns is in proportion to n.

Template: `<s>[role]` newline, the text, `</s>` newline. Within roles and texts a backslash, `<` and `[` become
`\\s`, `\\l` and `\\b`, and within roles `]` becomes `\\e`; so no mark or control string can begin inside a text, and
the escape is undone exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN_END = "</s>\n"


def escape(c: Column) -> Column:
    for plain, safe in (("\\", "\\s"), ("<", "\\l"), ("[", "\\b")):
        c = F.replace(c, F.lit(plain), F.lit(safe))
    return c


def unescape(c: Column) -> Column:
    for plain, safe in (("<", "\\l"), ("[", "\\b"), ("\\", "\\s")):
        c = F.replace(c, F.lit(safe), F.lit(plain))
    return c


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, examples.

    examples: array of struct(target_turn, target_start, target_end), in order; code point offsets from 0 into
    `formatted`, whose part before target_start is the context and from target_start to target_end the reply.

    A null text or role counts as empty; rows with a null conversation id form one conversation; turns with the
    same number are ordered by role and text and all kept; a null turn number sorts first; an empty table gives no
    rows; other columns are ignored. A conversation without an assistant turn has no examples. A conversation becomes one row, however long it is.
    """
    safe_role = F.replace(escape(F.coalesce(F.col(role), F.lit(""))), F.lit("]"), F.lit("\\e"))
    head = F.concat(F.lit("<s>["), safe_role, F.lit("]\n"))
    rows = turns.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("_turn"), (F.col(role) == "assistant").alias("_target"),
        F.coalesce(F.col(role), F.lit("")).alias("_role"), head.alias("_head"), F.coalesce(F.col(text), F.lit("")).alias("_text"),
    )
    rows = rows.withColumn("_length", (F.length("_head") + F.length(escape(F.col("_text"))) + len(TURN_END)).cast("long"))
    order = Window.partitionBy("conv_id").orderBy(F.col("_turn").asc_nulls_first(), "_role", "_text")
    before = F.sum("_length").over(order.rowsBetween(Window.unboundedPreceding, -1))
    placed = rows.select("*", F.row_number().over(order).alias("_at"), F.coalesce(before, F.lit(0)).alias("_start"))
    start = F.col("_start") + F.length("_head")
    end = F.col("_start") + F.col("_length") - len(TURN_END)
    folded = placed.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"),
        F.sort_array(F.collect_list(F.struct("_at", "_head", "_text"))).alias("_turns"),
        F.sort_array(F.collect_list(F.when(F.col("_target"), F.struct(
            F.col("_at"), F.col("_turn").alias("target_turn"), start.alias("target_start"), end.alias("target_end"))))).alias("_examples"),
    )
    return folded.select(
        "conv_id", "n_turns",
        F.array_join(F.transform("_turns", lambda t: F.concat(t["_head"], escape(t["_text"]), F.lit(TURN_END))), "").alias("formatted"),
        F.transform("_examples", lambda e: F.struct(e["target_turn"].alias("target_turn"), e["target_start"].alias("target_start"), e["target_end"].alias("target_end"))).alias("examples"),
    )


def expand_examples(formatted: DataFrame, carry: list[str] = (), outer: bool = False) -> DataFrame:
    """One row per assistant turn: conv_id, the columns named in carry, target_turn, example (the rendered prefix and the reply), target_start,
    target_end; the loss mask is the range from target_start to target_end. outer: a conversation without an assistant turn stands once, with null examples."""
    explode = F.explode_outer if outer else F.explode
    return formatted.select("conv_id", *carry, "formatted", explode("examples").alias("e")).select(
        "conv_id", *carry, "e.target_turn", F.col("formatted").substr(F.lit(1), F.col("e.target_end").cast("int")).alias("example"),
        "e.target_start", "e.target_end")


def target() -> Column:
    """The unescaped text under the loss mask of a row of expand_examples()."""
    return unescape(F.substring("example", (F.col("target_start") + 1).cast("int"), (F.col("target_end") - F.col("target_start")).cast("int")))


def read_back(formatted: DataFrame) -> DataFrame:
    """formatted with turns (array of struct(role, text)), parsed from the rendered text."""
    shown = F.filter(F.split("formatted", "</s>\n"), lambda s: s != "")
    turns = F.transform(shown, lambda s: F.struct(
        unescape(F.replace(F.substring_index(F.substr(s, F.lit(5)), "]\n", 1), F.lit("\\e"), F.lit("]"))).alias("role"),
        unescape(F.substr(s, F.locate("]\n", s) + 2)).alias("text")))
    return formatted.select("*", turns.alias("turns"))
