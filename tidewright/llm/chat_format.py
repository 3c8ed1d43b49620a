"""Chat formatting with a grammar round trip.

A conversation is rendered as ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn.  A deterministic parser reads the rendering back:
it cuts at end marks, then at start marks, and refuses a piece that holds any other mark.  The turns it finds are compared with the
source; where they differ, the conversation is rendered with one backslash more inside everything that looks like a control string
(``<|im_end|>``, ``<\\|im_end|>`` and so on), which the parser takes away again.  A last comparison fails the query if a rendering is
still not identical.  Texts without such strings are the same in both rounds, so only conflicting content changes.

The loss mask is run-length coded: for each turn (before, loss, after) in code points of the formatted text; the loss run is the text of
an assistant turn.  What lies under it is read from the formatted pieces, each of which must be as long as its runs.

All steps are DataFrame expressions.  One row holds one formatted conversation, as its consumers need it.

Defined results: turns stand by turn number, null first, and rows that tie by role and text; repeated rows are turns of their own; null
roles and texts are empty; rows with a null id are one conversation; an empty table gives no rows.  Very long texts are handled whole,
one conversation up to Spark's 2 GB a value.  Extra input columns are not read.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"
#: Marks that must not stand inside a text; in a role also the sign for a line end.
_MARKS, _ROLE_MARKS = "im_start|im_end", "im_start|im_end|im_line"


def escaped(field: Column, role: bool = False) -> Column:
    out = F.regexp_replace(field, rf"<(\\*)\|({_ROLE_MARKS if role else _MARKS})\|>", r"<$1\\|$2|>")
    return F.replace(out, F.lit("\n"), F.lit("<|im_line|>")) if role else out


def unescaped(field: Column, role: bool = False) -> Column:
    field = F.replace(field, F.lit("<|im_line|>"), F.lit("\n")) if role else field
    return F.regexp_replace(field, rf"<\\(\\*)\|({_ROLE_MARKS if role else _MARKS})\|>", r"<$1|$2|>")


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END + "\n"))), "")


def pieces(formatted: Column) -> Column:
    """The parser: array of (role, text) as they stand in the rendering, null where it breaks the grammar."""
    cut = F.split(formatted, r"<\|im_end\|>")
    heads = F.slice(cut, F.lit(1), F.greatest(F.size(cut) - 1, F.lit(0)))

    def piece(p: Column, k: Column) -> Column:
        inner = F.split(p, r"<\|im_start\|>")
        body = F.element_at(inner, 2)
        line = F.instr(body, "\n")
        sound = (F.size(inner) == 2) & (inner[0] == F.when(k == 0, "").otherwise("\n"))
        # an unmarked piece has no second element, which F.try_element_at would give as null; the size is asked first
        return F.when(sound & F.coalesce(F.instr(F.try_element_at(inner, F.lit(2)), "\n") > 0, F.lit(False)),
                      F.struct(F.substring(body, F.lit(1), line - 1).alias("role"), F.substring(body, line + 1, F.length(body)).alias("text")))

    return F.when(F.element_at(cut, -1) == F.when(F.size(cut) == 1, "").otherwise("\n"), F.transform(heads, piece))


def recovered(found: Column) -> Column:
    """Turns of parsed pieces, escapes taken away; null where a piece is null."""
    return F.when(found.isNotNull() & ~F.exists(found, lambda p: p.isNull()),
                  F.transform(found, lambda p: F.struct(unescaped(p["role"], True).alias("role"), unescaped(p["text"]).alias("text"))))


def conversations_of(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, turns): the turns (role, text) of every conversation in order."""
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    turns = F.transform(F.array_sort("all"), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return rows.select(F.col(id_col).alias("id"), turn.alias("t")).groupBy("id").agg(F.collect_list("t").alias("all")).select("id", turns.alias("turns"))


def format_chats(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Columns: id, formatted, loss_mask (array of before, loss, after), escaped (whether content conflicted)."""
    told = conversations_of(rows, id_col, turn_col, role_col, text_col).withColumn("formatted", rendered(F.col("turns")))
    same = F.coalesce(recovered(pieces(F.col("formatted"))) == F.col("turns"), F.lit(False))
    told = told.withColumn("escaped", ~same)
    safe = F.transform("turns", lambda t: F.struct(escaped(t["role"], True).alias("role"), escaped(t["text"]).alias("text")))
    told = told.withColumn("formatted", F.when(F.col("escaped"), rendered(safe)).otherwise(F.col("formatted")))
    parsed = pieces(F.col("formatted"))
    again = F.when(~F.col("escaped") | F.coalesce(recovered(parsed) == F.col("turns"), F.lit(False)), F.col("formatted"))
    told = told.withColumn("formatted", F.coalesce(again, F.raise_error(F.lit("a rendering does not parse back to its source")).cast("string")))

    def runs(p: Column) -> Column:
        lost = F.when(p["role"] == LOSS_ROLE, F.length(p["text"])).otherwise(0)
        tail = F.when(p["role"] == LOSS_ROLE, F.lit(0)).otherwise(F.length(p["text"]))
        return F.struct((F.length(p["role"]) + len(START) + 1).alias("before"), lost.alias("loss"), (tail + len(END) + 1).alias("after"))

    return told.select("id", "formatted", F.transform(pieces(F.col("formatted")), runs).alias("loss_mask"), "escaped")


def read_back(formatted: DataFrame) -> DataFrame:
    """Columns: id, turns (role, text), loss_text (what lies under the mask, escapes taken away), formatted_chars."""
    told = formatted.withColumn("found", pieces(F.col("formatted")))

    def under(p: Column, m: Column) -> Column:
        piece = F.concat(F.lit(START), p["role"], F.lit("\n"), p["text"], F.lit(END + "\n"))
        fits = F.length(piece) == m["before"] + m["loss"] + m["after"]
        return F.when(fits, unescaped(F.substring(piece, m["before"] + 1, m["loss"]))).otherwise(F.raise_error(F.lit("a loss mask does not fit its text")).cast("string"))

    masked = F.array_join(F.zip_with("found", "loss_mask", lambda p, m: F.when(m["loss"] > 0, under(p, m)).otherwise(F.lit(""))), "")
    return told.select("id", recovered(F.col("found")).alias("turns"), masked.alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))


def turns_text(turns: Column) -> Column:
    """Role, line end, text, line end of every turn."""
    return F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
