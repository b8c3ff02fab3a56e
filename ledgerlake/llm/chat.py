"""Chat formatting with typed content parts, in DataFrame expressions only.

A turn's content is an array of parts: text, image, audio or document.  A
visitor walks the parts in order; each text part is escaped, each other part
becomes an ordered placeholder and a record of its attachment (reference and the
number of tokens that the placeholder expands to).  The template is

    <|im_start|>role<|im_sep|>content<|im_end|>

Inside texts and roles every ``<`` + backslashes + ``|`` gets one more
backslash, so no text can form a marker, and taking one away restores it.  The
loss mask covers the contents of the assistant's turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END, PART = "<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|part|>"

#: One content part.  ``units``: pixels of an image, milliseconds of audio, pages of a document.
PART_TYPE = "struct<type:string,text:string,ref:string,units:bigint>"

#: Fixed expansion: units that make one token, rounded up, at least one token.
UNITS_PER_TOKEN = {"image": 28 * 28, "audio": 40, "document": 1}
TOKENS_PER_UNIT = {"image": 1, "audio": 1, "document": 256}


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def text_part(text: Column) -> Column:
    """A content of one text part (null: the empty text)."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"),
                            F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("units")))


def expanded_tokens(part: Column) -> Column:
    """Tokens that an attachment's placeholder stands for; 0 for texts, 1 at least for others."""
    out = F.lit(0).cast("bigint")
    for kind, per in UNITS_PER_TOKEN.items():
        count = F.ceil(F.coalesce(part["units"], F.lit(0)) / per) * TOKENS_PER_UNIT[kind]
        out = F.when(part["type"] == kind, F.greatest(count, F.lit(1).cast("bigint"))).otherwise(out)
    return out


def _is_text(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("text")) == "text"


def visit(parts: Column) -> tuple[Column, Column]:
    """The content string of an array of parts, and its attachments.

    Null parts and null types count as texts, null texts as empty.  Of two
    adjacent text parts the second begins with a part marker, so their
    boundary can be read back and no marker arises across it.
    """
    parts = F.filter(F.coalesce(parts, F.array().cast(f"array<{PART_TYPE}>")), lambda p: p.isNotNull())
    written = F.transform(parts, lambda p, i: F.when(
        _is_text(p),
        F.concat(F.when((i > 0) & _is_text(F.get(parts, i - 1)), F.lit(PART)).otherwise(F.lit("")),
                 escape(F.coalesce(p["text"], F.lit("")))))
        .otherwise(F.concat(F.lit("<|"), F.regexp_replace(p["type"], r"[<|>]", "_"), F.lit("|>"))))
    attachments = F.transform(F.filter(parts, lambda p: ~_is_text(p)), lambda p: F.struct(
        p["type"].alias("type"), p["ref"].alias("ref"), expanded_tokens(p).alias("tokens")))
    return F.array_join(written, ""), attachments


def format_chat(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                parts: str = "parts", learned_role: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv``, formatted, loss_spans, attachments, expanded_tokens.

    ``parts`` is an array of ``PART_TYPE``.  Rows are taken by turn, nulls
    first; rows with equal turns by role, then by content; repeated rows stay.
    A null role is written as the empty role.  A null conversation id is one
    conversation.  loss_spans holds (segment, start, length): the place in code
    points of each learned content inside the segment that the segment's
    ``<|im_end|>`` ends, segments counted from 0.  attachments are numbered
    from 0 over the conversation, in order of their placeholders.  An empty
    table gives no rows.  A conversation is one value, so all its turns meet
    in one task; nothing else is grouped.
    """
    content, attachments = visit(F.col(parts))
    rows = turns.select(
        F.col(conv).alias("_conv"), F.col(turn).alias("_turn"), F.coalesce(F.col(role), F.lit("")).alias("_role"),
        content.alias("_content"), attachments.alias("_files"))
    head = F.concat(F.lit(START), escape(F.col("_role")), F.lit(SEP))
    rows = rows.select("_conv", F.struct(
        F.col("_turn").alias("turn"), F.col("_role").alias("role"), F.col("_content").alias("content"),
        F.col("_files").alias("files"), head.alias("head"),
        F.char_length(head).cast("bigint").alias("start"), F.char_length("_content").cast("bigint").alias("length")).alias("_t"))
    whole = rows.groupBy("_conv").agg(F.sort_array(F.collect_list("_t")).alias("_all"))
    files = F.flatten(F.transform("_all", lambda t: t["files"]))
    return whole.select(
        F.col("_conv").alias(conv),
        F.array_join(F.transform("_all", lambda t: F.concat(t["head"], t["content"], F.lit(END))), "").alias("formatted"),
        F.transform(
            F.filter(F.transform("_all", lambda t, i: F.struct(
                i.cast("bigint").alias("segment"), t["start"].alias("start"), t["length"].alias("length"),
                t["role"].alias("role"))), lambda s: s["role"] == learned_role),
            lambda s: F.struct(s["segment"].alias("segment"), s["start"].alias("start"), s["length"].alias("length"))
        ).alias("loss_spans"),
        F.transform(files, lambda f, i: F.struct(i.alias("place"), f["type"].alias("type"), f["ref"].alias("ref"),
                                                 f["tokens"].alias("tokens"))).alias("attachments"),
        F.aggregate(files, F.lit(0).cast("bigint"), lambda acc, f: acc + f["tokens"]).alias("expanded_tokens"))


def _segments(formatted: Column) -> Column:
    """What stands before each end marker."""
    pieces = F.split(formatted, r"<\|im_end\|>")
    return F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))


def read_turns(formatted: Column) -> Column:
    """The turns (role, content) of a formatted conversation; contents keep their placeholders, unescaped."""
    return F.transform(_segments(formatted), lambda s: F.struct(
        unescape(F.substring_index(F.substr(s, F.lit(len(START) + 1)), SEP, 1)).alias("role"),
        unescape(F.substr(s, F.instr(s, SEP) + len(SEP))).alias("content")))


def read_learned(formatted: Column, loss_spans: Column) -> Column:
    """The unescaped texts under the loss mask, in order."""
    segments = _segments(formatted)
    return F.transform(loss_spans, lambda p: unescape(F.substr(
        F.get(segments, p["segment"].cast("int")), (p["start"] + 1).cast("int"), p["length"].cast("int"))))
