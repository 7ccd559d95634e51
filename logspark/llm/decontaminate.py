"""Benchmark decontamination with Spark expressions only.

Windows of a benchmark item's own length in words are compared with it. A window can only be similar to an
item if they share a shingle of five words, so windows are laid where a shingle of the document is one of the
item's, and aligned by its place in the item. Each window gets a SimHash of its shingles. Blocks of the 64 bits,
one more than the radius, are joined for equality, which finds every window and item of one length whose
fingerprints lie within the radius; these are verified exactly, by the weighted Jaccard similarity of their
shingles (weights: how often each occurs).

Documents are read twice, once for shared shingles and once for windows of those that share some; no text is
shuffled unless the second set is too large for Spark's broadcast limit. The items' shingles are broadcast up to
BROADCAST_ROWS and joined by a shuffle beyond.

Cases: words are lower-cased and parted at blanks; null and empty texts share nothing; items with no words are
left out, and items under five words are one shingle, their whole length; repeated items and repeated documents
are judged alike; a null doc_id keeps its row; equal doc_ids with other texts are told apart; an empty table on
either side gives clean documents; other columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .native import fixed, numbered, shingle_hashes, words_of

SHINGLE, RADIUS, SIMILARITY = 5, 16, 0.8
#: Rows of the items' shingle table, some 40 bytes each, up to which it is broadcast.
BROADCAST_ROWS = 2_000_000


def simhash(hashes: str) -> Column:
    """The 64 bits, as a long: a bit is set if it is set in over half of an array of hashes."""
    bit = lambda x, b: F.call_function("shiftright", x, b).bitwiseAND(F.lit(1).cast("long"))
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(63)),
        F.lit(0).cast("long"),
        lambda acc, b: acc.bitwiseOR(
            F.when(
                2 * F.aggregate(hashes, F.lit(0).cast("long"), lambda s, x: s + bit(x, b)) > F.size(hashes),
                F.call_function("shiftleft", F.lit(1).cast("long"), b),
            ).otherwise(F.lit(0).cast("long"))
        ),
    )


def blocks(fp: str, radius: int) -> Column:
    """radius + 1 structs (block, bits): two fingerprints within radius agree in one at least."""
    cuts = [round(i * 64 / (radius + 1)) for i in range(radius + 2)]
    return F.array(
        *[
            F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)).alias("bits"))
            for i, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False))
        ]
    )


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.lower(text).alias("text"))


def find_leaks(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """docs (doc_id, text), items (item_id, text) -> (doc_id, text_hash, item_id, similarity), one row for each pair."""
    own = items.select(F.col("item_id").cast("long").alias("item_id"), F.lower(F.col("text").cast("string")).alias("text"))
    own = fixed(own, "words", words_of(F.col("text"))).drop("text").where(F.size("words") > 0)
    lengths = [r[0] for r in own.select(F.least(F.size("words"), F.lit(SHINGLE)).alias("k")).distinct().collect()]  # 5 at most
    parts = [own.where(F.least(F.size("words"), F.lit(SHINGLE)) == k).withColumn("hashes", shingle_hashes("words", k)).withColumn("k", F.lit(k)) for k in lengths]
    if not parts:
        empty = "doc_id long, text_hash long, item_id long, similarity double"
        return docs.sparkSession.createDataFrame([], empty)
    own = parts[0]
    for p in parts[1:]:
        own = own.union(p)
    own = own.select("item_id", "k", F.size("words").alias("n"), "hashes", simhash("hashes").alias("fp"), numbered("hashes").alias("item_set"))
    own, _ = materialize(own, "items")
    shingles, _ = materialize(own.select("item_id", "k", "n", F.posexplode("hashes").alias("offset", "h")), "item-shingles")
    n_shingles = shingles.count()
    keyed = fixed(_keyed(docs), "words", words_of(F.col("text")))
    starts = None
    for k in lengths:
        hashed = fixed(keyed.select("doc_id", "text_hash", "words"), "hashes", shingle_hashes("words", k))
        places = hashed.select("doc_id", "text_hash", F.posexplode("hashes").alias("place", "h"))
        known = shingles.where(F.col("k") == k)
        hit = places.join(F.broadcast(known) if n_shingles <= BROADCAST_ROWS else known, "h").select(
            "doc_id", "text_hash", "k", "n", (F.col("place") - F.col("offset")).alias("start")
        )
        starts = hit if starts is None else starts.union(hit)
    # Windows of one length and start are the same for all items of that length.
    windows, _ = materialize(starts.distinct(), "windows")
    keys = windows.select("doc_id", "text_hash").distinct()
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_hash"] == b["text_hash"])
    held = keyed.join(keys, same(keyed, keys), "left_semi").dropDuplicates(["doc_id", "text_hash"])
    held, _ = materialize(held.select("doc_id", "text_hash", "words"), "window-words")
    cut = None
    for k in lengths:
        at = windows.where(F.col("k") == k)
        at = at.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
        w = held.join(at, held["doc_id"].eqNullSafe(at["_id"]) & (held["text_hash"] == at["_hash"])).select(
            "doc_id",
            "text_hash",
            "k",
            "n",
            F.slice("words", F.greatest(F.col("start"), F.lit(0)) + 1, F.least(F.col("start") + F.col("n"), F.size("words")) - F.greatest(F.col("start"), F.lit(0))).alias("own"),
        )
        w = fixed(fixed(w, "words", F.col("own")), "hashes", shingle_hashes("words", k)).where(F.size("hashes") > 0)
        cut = w if cut is None else cut.union(w)
    # Equal windows, as of a passage in many documents, are compared once for all.
    cut = cut.withColumn("id", F.xxhash64("n", "hashes"))
    cut, _ = materialize(cut.select("doc_id", "text_hash", "k", "n", "id", "hashes"), "cut-windows")
    classes = cut.groupBy("id", "k", "n").agg(F.first("hashes").alias("hashes"))
    classes, _ = materialize(classes.select("id", "k", "n", simhash("hashes").alias("fp"), numbered("hashes").alias("window_set")), "window-classes")
    left = classes.select("id", "k", "n", "fp", "window_set", F.explode(blocks("fp", radius)).alias("b")).select("*", "b.block", "b.bits")
    right = own.select("item_id", F.col("k"), "n", F.col("fp").alias("item_fp"), "item_set", F.explode(blocks("fp", radius)).alias("b")).select("*", "b.block", "b.bits")
    near = left.drop("b").join(right.drop("b"), ["k", "n", "block", "bits"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
    near = near.dropDuplicates(["id", "item_id"])  # a pair may agree in several blocks
    common = F.size(F.array_intersect("window_set", "item_set"))
    alike = common / (F.size("window_set") + F.size("item_set") - common)
    found = near.select("id", "item_id", alike.alias("similarity")).where(F.col("similarity") >= similarity)
    return cut.select("doc_id", "text_hash", "id").join(found, "id").groupBy("doc_id", "text_hash", "item_id").agg(F.max("similarity").alias("similarity"))


def report(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """(doc_id, contaminated, n_items, items, similarity): a row for each row of docs."""
    leaks = find_leaks(docs, items, **options).groupBy("doc_id", "text_hash").agg(
        F.array_sort(F.collect_set("item_id")).alias("items"), F.max("similarity").alias("similarity")
    )
    keys = _keyed(docs).select("doc_id", "text_hash")
    leaks = leaks.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    joined = keys.join(leaks, keys["doc_id"].eqNullSafe(leaks["_id"]) & (keys["text_hash"] == leaks["_hash"]), "left")
    return joined.select(
        "doc_id",
        F.col("items").isNotNull().alias("contaminated"),
        F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.array_join(F.coalesce(F.col("items").cast("array<string>"), F.array().cast("array<string>")), ",").alias("items"),
        F.coalesce("similarity", F.lit(0.0)).alias("similarity"),
    )


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """docs without those that hold an item."""
    leaks = find_leaks(docs, items, **options).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = f"_key{uuid.uuid4().hex[:8]}"  # no column of the caller's
    keyed = docs.withColumn(key, F.xxhash64(text))
    return keyed.join(leaks, keyed["doc_id"].cast("long").eqNullSafe(leaks["_id"]) & (keyed[key] == leaks["_hash"]), "left_anti").drop(key)
