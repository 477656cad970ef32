"""Chat formatting with typed content parts, in DataFrame functions only.

A turn holds an array of parts.  ``visit`` dispatches each part on its type to a visitor and
flattens the turn: text parts are escaped, image, audio and document parts become a
placeholder, and each placeholder's attachment is recorded in order with the number of
tokens it expands to.  Turns are marked by control strings:

    <|turn|>role<|body|>content<|end|>

Control strings inside texts and roles are escaped reversibly: backslashes are doubled and a
backslash is put behind the first character of every control string, so a bare one in the
output is always the template's.  The i-th placeholder of a conversation belongs to its i-th
attachment.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meritflow.llm.common import fresh

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
#: Strings that a text may not show bare; the first stands for all of the template's own.
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: A content part: ``text`` for text, ``uri`` and what its size is computed from for the others.
PART = "struct<type: string, text: string, uri: string, width: bigint, height: bigint, seconds: double, pages: bigint>"


@dataclass(frozen=True)
class Expansion:
    """How many tokens an attachment stands for."""

    patch: int = 28                  # pixels to the side of an image token
    audio_per_second: int = 25
    page: int = 1_024                # of a document


def escape(text: Column) -> Column:
    """``text`` without bare control strings; see ``unescape``."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    """The text that ``escape`` was given: every backslash gives way to what follows it."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


# ------------------------------------------------------------------ parts
#: What a visitor gives for a part: the piece of output text, and the attachment or null.
_FLAT = "struct<piece: string, type: string, uri: string, tokens: bigint>"


def _text(part: Column, size: Expansion) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(escape(F.coalesce(part["text"], F.lit(""))).alias("piece"), none.alias("type"), none.alias("uri"),
                    F.lit(0).cast("long").alias("tokens"))


def _attachment(name: str, tokens: Callable[[Column, Expansion], Column]) -> Callable[[Column, Expansion], Column]:
    def visitor(part: Column, size: Expansion) -> Column:
        n = F.greatest(F.coalesce(tokens(part, size), F.lit(0).cast("long")), F.lit(1).cast("long"))
        return F.struct(F.lit(f"<|{name}|>").alias("piece"), F.lit(name).alias("type"), part["uri"].alias("uri"),
                        n.alias("tokens"))
    return visitor


def _up(x: Column) -> Column:
    return F.ceil(x).cast("long")


#: The visitor of each type of part.
VISITORS: dict[str, Callable[[Column, Expansion], Column]] = {
    "text": _text,
    "image": _attachment("image", lambda p, s: _up(p["width"] / s.patch) * _up(p["height"] / s.patch)),
    "audio": _attachment("audio", lambda p, s: _up(p["seconds"] * s.audio_per_second)),
    "document": _attachment("document", lambda p, s: p["pages"] * s.page),
}


def visit(parts: Column, size: Expansion = Expansion(), visitors: dict | None = None) -> Column:
    """Each part of the array as its visitor gives it; a part of an unknown type raises, a null one is left out."""
    known = visitors or VISITORS

    def one(part):
        out = None
        for name, visitor in known.items():
            flat = visitor(part, size).cast(_FLAT)
            out = F.when(part["type"] == name, flat) if out is None else out.when(part["type"] == name, flat)
        return out.otherwise(F.raise_error(F.concat(F.lit("no visitor for a part of type "), F.coalesce(
            part["type"], F.lit("null")))).cast(_FLAT))

    return F.transform(F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull()), one)


def text_part(text: Column) -> Column:
    """The parts of a turn that is one text; null counts as empty."""
    empty = {"uri": "string", "width": "bigint", "height": "bigint", "seconds": "double", "pages": "bigint"}
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"),
                            *[F.lit(None).cast(t).alias(c) for c, t in empty.items()]))


# ------------------------------------------------------------------ conversations
def format_parts(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts",
                 learn: str = "assistant", size: Expansion = Expansion()) -> DataFrame:
    """One row per conversation: conv, formatted, n_turns, loss, attachments, expanded_tokens.

    ``loss`` is the loss mask in code points: start and length of the content of each turn whose
    role is ``learn``, with the turn's index and where the content begins in that turn, so that
    it can be read back turn by turn.  ``attachments`` lists turn, type, uri and tokens in the
    order of the placeholders.

    Turns are ordered by turn, then role, then formatted content, nulls first; equal rows are turns of
    their own.  A null role or text is empty, rows with a null ``conv`` are one conversation,
    and an empty table gives no rows.  Other columns are not read.  A conversation is one row
    of output, so it has to fit in one.
    """
    flat = F.col("flat")
    tag = F.coalesce(F.col(role), F.lit(""))
    body = F.array_join(F.transform(flat, lambda x: x["piece"]), "")
    head = F.concat(F.lit(TURN), escape(tag), F.lit(BODY))
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), tag.alias("role"), visit(F.col(parts), size).alias("flat"),
                        head.alias("head"))
    rows = rows.select(
        "conv", "turn", "role", F.concat("head", body, F.lit(END)).alias("piece"), F.length("head").cast("long").alias("at"),
        F.length(body).cast("long").alias("length"),
        F.transform(F.filter(flat, lambda x: x["type"].isNotNull()), lambda x: F.struct(x["type"], x["uri"], x["tokens"])).alias("refs"))
    order = Window.partitionBy("conv").orderBy("turn", "role", "piece")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({
        "index": F.row_number().over(order) - 1,
        "start": F.coalesce(F.sum(F.col("at") + F.col("length") + len(END)).over(before), F.lit(0).cast("long"))})
    mask = F.when(F.col("role") == learn, F.struct(
        "index", (F.col("start") + F.col("at")).alias("start"), "at", "length"))
    refs = F.transform("refs", lambda x: F.struct(F.col("index").alias("turn"), x["type"].alias("type"), x["uri"].alias("uri"),
                                                  x["tokens"].alias("tokens")))
    got = rows.groupBy("conv").agg(
        F.sort_array(F.collect_list(F.struct("index", "piece", refs.alias("refs")))).alias("turns"),
        F.sort_array(F.collect_list(mask)).alias("loss"), F.count(F.lit(1)).alias("n_turns"))
    attached = F.flatten(F.transform("turns", lambda x: x["refs"]))
    return got.select(
        F.col("conv").alias(conv), F.array_join(F.transform("turns", lambda x: x["piece"]), "").alias("formatted"), "n_turns", "loss",
        attached.alias("attachments"),
        F.aggregate(attached, F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("expanded_tokens"))


def format_chat(chats: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                learn: str = "assistant") -> DataFrame:
    """``format_parts`` of conversations whose turns are plain texts."""
    name = fresh(chats, "parts")["parts"]
    return format_parts(chats.withColumn(name, text_part(F.col(text))), conv, turn, role, name, learn)


# ------------------------------------------------------------------ reading back
def split_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, each with its control strings."""
    return F.filter(F.split(formatted, r"(?=<\|turn\|>)"), lambda x: x != "")


def read_turns(formatted: Column) -> Column:
    """Array of (role, content) of a formatted conversation; placeholders stay in the content."""
    def one(x):
        at = F.instr(x, BODY)
        return F.struct(unescape(F.substring(x, F.lit(len(TURN) + 1), at - len(TURN) - 1)).alias("role"),
                        unescape(F.substring(x, at + len(BODY), F.length(x) - at - len(BODY) - len(END) + 1)).alias("content"))
    return F.transform(split_turns(formatted), one)


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped.  Each turn is cut on its own: linear in the text."""
    turns = split_turns(formatted)
    # the turns are bound once, and the mask's spans are cut out of them
    cut = F.transform(F.array(turns), lambda t: F.transform(loss, lambda m: unescape(
        F.substring(F.get(t, m["index"]), (m["at"] + 1).cast("int"), m["length"].cast("int")))))
    return F.array_join(F.flatten(cut), "")


def digests(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the output."""
    turns = read_turns(F.col("formatted"))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["content"], F.lit("\n"))), "")
    return (formatted.select(conv, "formatted", turns.alias("turns"), read_loss(F.col("formatted"), F.col("loss")).alias("learnt"))
            .select(conv, F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                    F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"),
                    F.length("formatted").cast("long").alias("formatted_chars")))
