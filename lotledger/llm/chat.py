"""Chat formatting: conversations as one marked text each, with the spans that carry loss.

Only DataFrame expressions. A block is a run of adjacent turns of one role:

    <|turn|>role<|says|>text<|next|>text<|end|>

Texts and roles are escaped, so that no control string of this template or of other common
templates stands in them: `&` becomes `&amp;`, and the first sign of a control string becomes
`&lt;` or `&lsqb;`. Reading back undoes it.

Order of turns: turn (null first), role, text. Null role or text: empty. A repeated row is a turn
of its own. Null conv_id: one conversation. Other columns are not read. An empty table gives an
empty result.

A conversation is formatted in parts of at most `PART_TURNS` turn numbers, so that sorting and merging
of a very long one is spread over tasks; its parts only meet to be joined into the one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, SAYS, NEXT, END = "<|turn|>", "<|says|>", "<|next|>", "<|end|>"
LEARNED = "assistant"
PART_TURNS = 256
# Control strings and what stands for them; `&` has to be the first.
ESCAPES = (
    ("&", "&amp;"),
    ("<|", "&lt;|"),
    ("<s>", "&lt;s>"),
    ("</s>", "&lt;/s>"),
    ("<<SYS>>", "&lt;<SYS>>"),
    ("<</SYS>>", "&lt;</SYS>>"),
    ("[INST]", "&lsqb;INST]"),
    ("[/INST]", "&lsqb;/INST]"),
)
SIGNS = (("&lt;", "<"), ("&lsqb;", "["), ("&amp;", "&"))


def escaped(text: Column) -> Column:
    for what, instead in ESCAPES:
        text = F.replace(text, F.lit(what), F.lit(instead))
    return text


def unescaped(text: Column) -> Column:
    for what, instead in SIGNS:
        text = F.replace(text, F.lit(what), F.lit(instead))
    return text


def _merged(turns: Column) -> Column:
    """Blocks (role, texts) of adjacent turns with one role."""
    text = "array<struct<role:string,texts:array<string>>>"

    def step(blocks: Column, turn: Column) -> Column:
        last = F.element_at(blocks, -1)
        longer = F.struct(last["role"].alias("role"), F.concat(last["texts"], F.array(turn["text"])).alias("texts"))
        added = F.concat(blocks, F.array(F.struct(turn["role"].alias("role"), F.array(turn["text"]).alias("texts"))))
        same = (F.size(blocks) > 0) & (F.try_element_at(blocks, F.lit(-1))["role"] == turn["role"])
        return F.when(same, F.concat(F.slice(blocks, 1, F.size(blocks) - 1), F.array(longer))).otherwise(added).cast(text)

    return F.aggregate(turns, F.array().cast(text), step)


def _head(role: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(SAYS))


def _pieces(blocks: Column) -> Column:
    """Strings of the blocks in order, without the first head and the last end; learned ones are told."""

    def of_block(block: Column, k: Column) -> Column:
        head = F.when(k > 0, F.concat(F.lit(END), _head(block["role"]))).otherwise("")
        learned = block["role"] == LEARNED
        return F.transform(
            block["texts"],
            lambda text, i: F.struct(F.when(i > 0, NEXT).otherwise(head).alias("mark"), text.alias("text"), learned.alias("learned")),
        )

    return F.flatten(F.transform(blocks, of_block))


def _spans(pieces: Column) -> Column:
    """Start and length in code points of the learned texts within the joined pieces."""
    kind = "struct<at:int,spans:array<struct<start:int,length:int>>>"
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")).cast(kind)

    def step(acc: Column, piece: Column) -> Column:
        start = acc["at"] + F.length(piece["mark"])
        span = F.struct(start.alias("start"), F.length(piece["text"]).alias("length"))
        spans = F.when(piece["learned"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((start + F.length(piece["text"])).alias("at"), spans.alias("spans")).cast(kind)

    return F.aggregate(pieces, none, step)["spans"]


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, parts: the formatted text in order, each part with the spans under the loss mask."""
    rows = turns.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        escaped(F.coalesce(F.col("role").cast("string"), F.lit(""))).alias("role"),
        escaped(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"),
        F.coalesce(F.floor(F.col("turn") / PART_TURNS), F.lit(-(1 << 62))).alias("part"),
        F.struct(F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("place"),
    )
    parts = (
        rows.groupBy("conv_id", "part")
        .agg(F.sort_array(F.collect_list(F.struct("place", "role", "text"))).alias("turns"))
        .select("conv_id", "part", _merged(F.col("turns")).alias("blocks"))
        .select("conv_id", "part", F.col("blocks")[0]["role"].alias("first"), F.element_at("blocks", -1)["role"].alias("last"), _pieces(F.col("blocks")).alias("pieces"))
        .select(
            "conv_id",
            F.struct(
                "part", "first", "last",
                F.array_join(F.transform("pieces", lambda p: F.concat(p["mark"], p["text"])), "").alias("body"),
                _spans(F.col("pieces")).alias("spans"),
            ).alias("part"),
        )
    )
    whole = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list("part")).alias("own"))

    def joined(part: Column, k: Column) -> Column:
        before = F.try_element_at(F.col("own"), F.when(k > 0, k).otherwise(1).cast("int"))["last"]
        lead = (
            F.when(k == 0, _head(part["first"]))
            .when(before == part["first"], F.lit(NEXT))
            .otherwise(F.concat(F.lit(END), _head(part["first"])))
        )
        tail = F.when(k == F.size("own") - 1, F.lit(END)).otherwise("")
        moved = F.transform(part["spans"], lambda s: F.struct((s["start"] + F.length(lead)).alias("start"), s["length"].alias("length")))
        return F.struct(F.concat(lead, part["body"], tail).alias("text"), moved.alias("loss"))

    return whole.select("conv_id", F.transform("own", joined).alias("parts")).select(
        "conv_id", F.array_join(F.col("parts")["text"], "").alias("formatted"), "parts"
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (role, text) as they were, loss_text: all text under the mask."""
    literal = "\\Q{}\\E".format
    blocks = F.split("formatted", literal(END))

    def turns_of(block: Column) -> Column:
        halves = F.split(F.replace(block, F.lit(OPEN), F.lit("")), literal(SAYS))
        return F.transform(
            F.split(halves[1], literal(NEXT)),
            lambda text: F.struct(unescaped(halves[0]).alias("role"), unescaped(text).alias("text")),
        )

    masked = F.transform(
        "parts", lambda p: F.array_join(F.transform(p["loss"], lambda s: unescaped(F.substr(p["text"], s["start"] + 1, s["length"]))), "")
    )
    return formatted.select(
        "conv_id",
        "formatted",
        F.flatten(F.transform(F.slice(blocks, 1, F.size(blocks) - 1), turns_of)).alias("turns"),
        F.array_join(masked, "").alias("loss_text"),
    )


def digests(read: DataFrame) -> DataFrame:
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
