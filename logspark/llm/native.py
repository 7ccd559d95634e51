"""Array helpers made of Spark expressions only. Arguments named like columns are column names, not expressions,
so that nothing costly is worked out again for every element."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEP = 256


def fixed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is worked out once.

    A plain column would be put into later filters in place of its name, and there worked out again for every
    element of every lambda that mentions it. What a generator returns is not.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def running_sum(column: str) -> Column:
    """Inclusive prefix sums of an array of longs, over blocks: no quadratic copying of long arrays."""
    values, n, zero = F.col(column), F.size(column), F.lit(0).cast("long")

    def grow(array: Column) -> Column:
        return F.aggregate(
            array,
            F.struct(zero.alias("s"), F.array().cast("array<long>").alias("out")),
            lambda acc, x: F.struct((acc["s"] + x).alias("s"), F.concat(acc["out"], F.array(acc["s"] + x)).alias("out")),
            lambda acc: acc["out"],
        )

    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.greatest(n, F.lit(1)) - 1) / STEP).cast("int")),
        lambda b: grow(F.slice(values, b * STEP + 1, F.lit(STEP))),
    )
    # Each block is lifted by the last sums of those before it, carried along with what has been joined.
    return F.when(n <= STEP, grow(values)).otherwise(
        F.aggregate(
            blocks,
            F.struct(zero.alias("s"), F.array().cast("array<array<long>>").alias("out")),
            lambda acc, b: F.struct(
                (acc["s"] + F.coalesce(F.element_at(b, -1), zero)).alias("s"), F.concat(acc["out"], F.array(F.transform(b, lambda x: x + acc["s"]))).alias("out")
            ),
            lambda acc: F.flatten(acc["out"]),
        )
    )


def with_matches(df: DataFrame, text: str, pattern: str, out: str, having: Column | None = None) -> DataFrame:
    """df with `out`: array<struct<start, end long, match string>>, the leftmost non-overlapping matches of a Java pattern.

    Places count code points. having: a cheap condition without which there can be no match. The pattern must
    match neither U+0001 nor U+0002 nor the empty string; in texts these two characters are told apart from marks.
    """
    mark, other = "\x01", "\x02"
    p, n, e = (f"_{x}{uuid.uuid4().hex[:8]}" for x in "pne")
    plain = F.translate(F.col(text), mark, other)
    has = F.col(text).rlike(pattern) if having is None else having & F.col(text).rlike(pattern)
    df = fixed(df, p, F.when(has, F.split(F.regexp_replace(plain, pattern, f"{mark}$0{mark}"), mark, -1)).otherwise(F.array().cast("array<string>")))
    df = fixed(df, n, F.transform(p, lambda x: F.char_length(x).cast("long")))
    df = fixed(df, e, running_sum(n))
    found = F.transform(
        F.sequence(F.lit(1), F.size(p) - 1, F.lit(2)),
        lambda i: F.struct((F.get(e, i) - F.get(n, i)).alias("start"), F.get(e, i).alias("end"), F.get(p, i).alias("match")),
    )
    return fixed(df, out, F.when(F.size(p) > 1, found).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,match:string>>"))).drop(p, n, e)

#: Blanks that part words: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\f\r"


def words_of(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+", -1))


def shingle_hashes(words: str, k: int) -> Column:
    """A 64-bit hash of every k neighbouring words of an array column; none if it is shorter."""
    return F.when(
        F.size(words) >= k,
        F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)])),
    ).otherwise(F.array().cast("array<long>"))


def numbered(column: str) -> Column:
    """An array of longs whose repeats are made distinct, so that set operations count multisets."""
    a = F.col(column)
    return F.when(F.size(F.array_distinct(a)) == F.size(a), a).otherwise(
        F.transform(
            a,
            lambda x, i: F.when(F.array_position(a, x) == i + 1, x).otherwise(
                F.xxhash64(x, F.size(F.filter(F.slice(a, F.lit(1), i), lambda y: y == x)))
            ),
        )
    )
