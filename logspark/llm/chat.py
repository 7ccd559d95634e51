"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs and sorted; neighbours of one role are merged into
one block by array functions; blocks are concatenated by a template. Texts are escaped reversibly, so
that the output can be read back to the very turns.

Cases: a null role or text counts as empty; a null turn sorts first; rows with equal turn are ordered
by role, then text; repeated rows are turns of their own; a null conv_id is one conversation; an empty
table gives no rows; other columns are ignored. A conversation is one output row, so it has to fit
in a row; conversations are independent, and none is cut.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native import running_sum


@dataclass(frozen=True)
class ChatTemplate:
    """header + role + header_end + text {+ more + text} + end, for every block of one role.

    protected are further control strings (of other formats) that are escaped inside texts and roles.
    No control string may hold its own first character again, nor any other's; that makes the escape
    reversible, for then no two occurrences overlap.
    """

    header: str = "<|turn|>"
    header_end: str = "<|text|>"
    more: str = "<|more|>"
    end: str = "<|end|>"
    protected: tuple[str, ...] = ("<s>", "</s>", "<unk>", "<pad>", "[INST]", "[/INST]")
    loss_roles: tuple[str, ...] = ("assistant",)

    def controls(self) -> tuple[str, ...]:
        out = (self.header, self.header_end, self.more, self.end, *self.protected)
        firsts = {c[0] for c in out}
        for c in out:
            if len(c) < 2 or any(x in firsts or x == "\\" for x in c[1:]):
                raise ValueError(f"control string {c!r} is too short or holds a first character of a control string")
        return tuple(sorted(set(out)))


DEFAULT = ChatTemplate()


def _pattern(template: ChatTemplate, removing: bool) -> str:
    by_first: dict[str, list[str]] = {}
    for c in template.controls():
        by_first.setdefault(c[0], []).append(re.escape(c[1:]))
    slashes = r"\\" if removing else ""
    # A control string's first character, any backslashes, then its rest: one backslash goes in or out.
    return "|".join(rf"(?<={re.escape(f)}){slashes}(?=\\*(?:{'|'.join(rest)}))" for f, rest in sorted(by_first.items()))


def escape(text: Column, template: ChatTemplate = DEFAULT) -> Column:
    return F.regexp_replace(text, _pattern(template, False), r"\\")


def unescape(text: Column, template: ChatTemplate = DEFAULT) -> Column:
    return F.regexp_replace(text, _pattern(template, True), "")


def format_chat(rows: DataFrame, template: ChatTemplate = DEFAULT) -> DataFrame:
    """(conv_id, turn, role, text) -> conv_id, formatted, loss_mask: array<struct<start, length>> in code points."""
    turn = F.struct(
        F.col("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    # 1-based places where a block of one role starts.
    starts = turns.withColumn(
        "starts",
        F.filter(
            F.sequence(F.lit(1), F.size("turns")),
            lambda i: (i == 1) | (F.get("turns", i - 1)["role"] != F.get("turns", i - 2)["role"]),
        ),
    )
    blocks = starts.withColumn(
        "blocks",
        F.transform(
            "starts",
            lambda s, j: F.struct(
                F.get("turns", s - 1)["role"].alias("role"),
                F.transform(
                    F.slice("turns", s, F.coalesce(F.get("starts", j + 1), F.size("turns") + 1) - s),
                    lambda t: escape(t["text"], template),
                ).alias("texts"),
            ),
        ),
    )
    # Pieces as they stand in the output: one for each text, with what stands before and after it.
    pieces = blocks.withColumn(
        "pieces",
        F.flatten(
            F.transform(
                "blocks",
                lambda b: F.transform(
                    b["texts"],
                    lambda t, k: F.struct(
                        F.when(k == 0, F.concat(F.lit(template.header), escape(b["role"], template), F.lit(template.header_end)))
                        .otherwise(F.lit(template.more))
                        .alias("before"),
                        t.alias("text"),
                        F.when(k == F.size(b["texts"]) - 1, F.lit(template.end)).otherwise(F.lit("")).alias("after"),
                        b["role"].isin(*template.loss_roles).alias("loss"),
                    ),
                ),
            )
        ),
    )
    sized = pieces.withColumn(
        "sizes", F.transform("pieces", lambda p: (F.char_length(p["before"]) + F.char_length(p["text"]) + F.char_length(p["after"])).cast("long"))
    ).withColumn("ends", running_sum("sizes"))
    return sized.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: F.concat(p["before"], p["text"], p["after"])), "").alias("formatted"),
        F.transform(
            F.filter(F.arrays_zip("pieces", "ends"), lambda z: z["pieces"]["loss"]),
            lambda z: F.struct(
                (z["ends"] - F.char_length(z["pieces"]["after"]) - F.char_length(z["pieces"]["text"])).alias("start"),
                F.char_length(z["pieces"]["text"]).cast("long").alias("length"),
            ),
        ).alias("loss_mask"),
    )


def read_chat(formatted: DataFrame, template: ChatTemplate = DEFAULT) -> DataFrame:
    """Reads the turns back: conv_id, turns array<struct<role, text>>, loss_text, formatted, loss_mask."""
    cut = lambda text, mark: F.split(text, re.escape(mark), -1)
    blocks = F.transform(
        F.slice(cut(F.col("formatted"), template.header), F.lit(2), F.size(cut(F.col("formatted"), template.header))),
        lambda b: F.struct(
            F.get(cut(b, template.header_end), F.lit(0)).alias("role"),
            cut(F.get(cut(F.get(cut(b, template.header_end), F.lit(1)), template.end), F.lit(0)), template.more).alias("texts"),
        ),
    )
    turns = F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                b["texts"], lambda t: F.struct(unescape(b["role"], template).alias("role"), unescape(t, template).alias("text"))
            ),
        )
    )
    under = F.array_join(
        F.transform("loss_mask", lambda m: unescape(F.substring(F.col("formatted"), (m["start"] + 1).cast("int"), m["length"].cast("int")), template)),
        "",
    )
    return formatted.select("conv_id", turns.alias("turns"), under.alias("loss_text"), "formatted", "loss_mask")
