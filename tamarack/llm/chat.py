"""Chat formatting with Spark expressions only, and reading a formatted chat back."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Strings that act as control tokens in common chat templates (fixed values); no text keeps one.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|im_sep|>", "<|endoftext|>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<s>", "</s>")
#: Starts every code that stands for something else in an escaped text.
MARK = "~"
CODES = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Template:
    """A block is ``open role \\n text [join text ...] close``: the adjacent turns of one role."""

    open: str = "<|im_start|>"
    join: str = "<|im_sep|>"
    close: str = "<|im_end|>"
    trained_role: str = "assistant"

    def controls(self) -> list[str]:
        """Every string that texts may not hold, the longest first."""
        own = {self.open, self.join, self.close}
        every = own.union(CONTROL)
        if len(own) < 3 or any(not c or MARK in c or c in d and c != d for c in own for d in own) or len(every) > len(CODES):
            raise ValueError(f"open, join and close must be distinct, without {MARK!r}, and none within another")
        return sorted(every, key=lambda c: (-len(c), c))


def escape(text: Column, template: Template) -> Column:
    """``~`` becomes ``~0``, then each control string its code ``~A``, ``~B``, ...; no control string can be left or arise."""
    text = F.replace(text, F.lit(MARK), F.lit(f"{MARK}0"))
    for code, control in zip(CODES, template.controls(), strict=False):
        text = F.replace(text, F.lit(control), F.lit(MARK + code))
    return text


def unescape(text: Column, template: Template) -> Column:
    for code, control in zip(CODES, template.controls(), strict=False):
        text = F.replace(text, F.lit(MARK + code), F.lit(control))
    return F.replace(text, F.lit(f"{MARK}0"), F.lit(MARK))


def format_chats(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", template: Template | None = None) -> DataFrame:
    """One row per conversation: its id, ``formatted``, ``loss_spans`` and ``blocks``.

    The turns of a conversation are gathered as structs and sorted by (turn, role, text).
    Adjacent turns of one role become one block, their texts separated by ``join``, so that
    each turn can be told again. ``loss_spans`` (start from 0, length, in code points of
    ``formatted``) are the texts of the trained role; ``blocks`` counts blocks. Texts and
    roles are escaped reversibly.

    Null texts and roles are empty; null turns come first; rows of one turn number are
    ordered by role and text; repeated rows are kept; the rows of null ids form one
    conversation; an empty table gives no row; other columns are not read. A conversation is
    one output value, so its rows meet in one task, and nothing else does.
    """
    t = template or Template()
    structs = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    gathered = rows.groupBy(F.col(conv_col).alias("conv_id")).agg(F.array_sort(F.collect_list(structs)).alias("turns"))
    escaped = gathered.select("conv_id", F.transform("turns", lambda x: F.struct(F.replace(escape(x.role, t), F.lit("\n"), F.lit(f"{MARK}n")).alias("role"), escape(x.text, t).alias("text"), (x.role == t.trained_role).alias("trained"))).alias("turns"))
    role_at = lambda k: F.get("turns", k).role
    starts = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda k: (k == 0) | (role_at(k) != role_at(k - 1)))
    run = escaped.withColumn("starts", starts)
    # the texts of each block are merged, then the blocks are concatenated: linear in the conversation
    block = lambda s, k: F.concat(F.lit(t.open), role_at(s), F.lit("\n"), F.array_join(F.transform(F.slice("turns", s + 1, F.coalesce(F.get("starts", k + 1), F.size("turns")) - s), lambda x: x.text), t.join), F.lit(t.close))
    formatted = F.array_join(F.transform("starts", block), "")
    # what stands before the text of turn k: the rest of the block before it and the head of its own
    head = lambda x, k: F.when(F.get("turns", k - 1).role == x.role, F.lit(len(t.join))).otherwise(F.when(k > 0, F.lit(len(t.close))).otherwise(F.lit(0)) + F.lit(len(t.open) + 1) + F.length(x.role))
    sized = F.transform("turns", lambda x, k: F.struct(head(x, k).cast("long").alias("head"), F.length(x.text).cast("long").alias("size"), x.trained.alias("trained")))
    # where each text starts, in two levels: an appended list is copied, so none is longer than the square root of the turns
    run = run.withColumn("sized", sized).withColumn("parts", _in_parts("sized"))
    sums = F.transform("parts", lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda acc, x: acc + x["head"] + x["size"]))
    before = F.aggregate(
        sums,
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out")),
        lambda acc, x: F.struct((acc.at + x).alias("at"), F.array_append(acc.out, acc.at).alias("out")),
        lambda acc: acc.out,
    )
    spans = lambda p, at: F.aggregate(
        p,
        F.struct(at.alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda acc, x: F.struct((acc.at + x["head"] + x["size"]).alias("at"), F.when(x.trained, F.array_append(acc.spans, F.struct((acc.at + x["head"]).alias("start"), x["size"].alias("length")))).otherwise(acc.spans).alias("spans")),
        lambda acc: acc.spans,
    )
    return run.select("conv_id", formatted.alias("formatted"), F.flatten(F.zip_with("parts", before, spans)).alias("loss_spans"), F.size("starts").cast("long").alias("blocks"))


def read_chats(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """The rows of :func:`format_chats` with ``turns`` (role, text) and ``loss_texts``, from their output alone.

    To cut a text walks the string from its start, so the spans are cut from pieces that hold
    a square root of their number each: the time grows with characters times that root.
    """
    t = template or Template()
    parts = F.split("formatted", _literal(t.close))
    blocks = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda b: F.substring(b, F.lit(len(t.open) + 1), F.length(b)))
    split = F.transform(blocks, lambda b: F.struct(F.substring_index(b, "\n", 1).alias("role"), F.substring(b, F.length(F.substring_index(b, "\n", 1)) + 2, F.length(b)).alias("rest")))
    role = lambda b: unescape(F.replace(b.role, F.lit(f"{MARK}n"), F.lit("\n")), t)
    turns = F.flatten(F.transform(split, lambda b: F.transform(F.split(b.rest, _literal(t.join)), lambda x: F.struct(role(b).alias("role"), unescape(x, t).alias("text")))))
    cut = lambda text, start, length: F.substring(text, (start + 1).cast("int"), length.cast("int"))
    end = lambda spans: F.element_at(spans, -1).start + F.element_at(spans, -1).length
    pieces = F.transform(_in_parts("loss_spans"), lambda p: F.struct(p.alias("spans"), F.get(p, 0).start.alias("start"), cut(F.col("formatted"), F.get(p, 0).start, end(p) - F.get(p, 0).start).alias("piece")))
    loss = F.flatten(F.transform(pieces, lambda p: F.transform(p.spans, lambda s: unescape(cut(p.piece, s.start - p.start, s.length), t))))
    return formatted.withColumn("turns", turns).withColumn("loss_texts", loss)


def _in_parts(items: str) -> Column:
    """The array column in consecutive parts, about as many as each has items; one empty part of an empty array."""
    most = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(items)))).cast("int")
    last = F.greatest(F.lit(0), F.ceil(F.size(items) / most) - 1).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(items, k * most + 1, most))


def _literal(text: str) -> str:
    return "\\Q" + text + "\\E"
