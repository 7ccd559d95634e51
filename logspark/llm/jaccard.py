"""Near-duplicates by the Jaccard similarity of word shingles: candidates by SimHash and by min-hashes, verified exactly.

A text is the set of its shingles' 64-bit hashes. Its SimHash is linked to those within RADIUS bits by the grid join of
simhash.py (segment popcounts), and each component of these links, equal fingerprints included, is a bucket. A pair at a similarity
of 0.8 differs by some 10 of 64 bits, which no grid of that size can reach, so each set has beside that BANDS keys of ROWS
min-hashes; two sets that share a key meet in that key's bucket. At 0.8 a pair shares no key with a chance of 0.59 ** 20, about
1 in 38,000, and with less above; equal sets are one node from the start. Buckets of the same members are worked out once. In a
bucket, similarities are exact, and all that are reached by links of `similarity` or more are linked, by a search
that compares each text with those not yet reached: a bucket of close copies costs one pass. A bucket's sets lie
in one task's memory, so one with over HOT hashes is dealt in chunks of half of that, and each two of its chunks meet as a
bucket of their own: no pair is lost, a text goes to as many tasks as there are chunks.

Cases: null text has no words; texts without words are one group; fewer words than a shingle make one shingle of all.
A row is known by its doc_id and text: of a group the row of the smallest doc_id stays (null ids last, then by the
text's hash), and one row of those that repeat both. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, ship_package, text_or_empty
from .graph import connected_components
from .pieces import portions
from .simhash import hamming_links, majority

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS, SEED, RADIUS = 20, 4, 42, 3
#: The most hashes of a bucket that are held at once; a single text's are held whole.
HOT = 2_000_000
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def grams(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in parts), np.uint64))


def keys(own: np.ndarray) -> np.ndarray:
    """The bucket keys of a set."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for i in range(0, len(own), 4096):
        np.minimum(least, ((own[i : i + 4096, None] ^ _FACTORS[1]) * _FACTORS[0]).min(0), out=least)
    bands = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(bands)], np.uint64).view(np.int64)


def links(sets: list[np.ndarray], similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """A spanning forest of the pairs at `similarity` or more; index pairs."""
    size = np.array([len(s) for s in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.r_[0, np.cumsum(size)]
    mark = np.zeros(len(flat) + 1, np.int64)
    open_ = np.arange(len(sets))
    edges: list[tuple[int, int]] = []
    todo: list[int] = []
    codes, places = flat, starts[:-1]  # those of the open ones
    while len(open_):
        if not todo:
            todo, gone = [int(open_[0])], np.arange(len(open_)) == 0
        else:
            i = todo.pop()
            own = flat[starts[i] : starts[i + 1]]
            mark[own] = 1
            filled = size[open_] > 0
            common = np.zeros(len(open_), np.int64)
            if filled.any():
                common[filled] = np.add.reduceat(mark[codes], places[filled])
            mark[own] = 0
            gone = common >= similarity * (size[open_] + size[i] - common)
            found = open_[gone].tolist()
            edges += [(i, j) for j in found]
            todo += found
        if gone.any():
            codes = codes[np.repeat(~gone, size[open_])]
            open_ = open_[~gone]
            places = np.r_[0, np.cumsum(size[open_])][:-1]
    return edges


def _bucket_links(rows: DataFrame, similarity: float) -> DataFrame:
    """(cell, node, grams) -> edges (a, b). Rows of a cell lie together, sorted."""

    def run(batches):
        cell, nodes, sets = None, [], []

        def work():
            pairs = links(sets, similarity) if len(sets) > 1 else []
            at = np.array(nodes, np.int64)
            i, j = np.array(pairs, np.int64).reshape(-1, 2).T
            return pa.RecordBatch.from_arrays([pa.array(at[i]), pa.array(at[j])], ["a", "b"])

        for batch in batches:
            for c, n, g in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if c != cell:
                    if len(sets) > 1:
                        yield work()
                    cell, nodes, sets = c, [], []
                nodes.append(n)
                sets.append(np.frombuffer(g, np.uint64))
        if len(sets) > 1:
            yield work()

    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long")


def _routes(dealt: DataFrame, hot: int) -> DataFrame:
    """(node, size, cell) -> (node, cell) of the buckets to work out: one of those with the same members, in chunks if hot."""
    mark = [F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y")]
    members = dealt.groupBy("cell").agg(*mark, F.sum(F.col("size") + 1).alias("held")).where("n > 1")
    wanted = members.groupBy("n", "x", "y").agg(F.min("cell").alias("cell"), F.any_value("held").alias("held"))
    chunks = F.when(F.col("held") > hot, F.ceil(2 * F.col("held") / F.lit(hot))).otherwise(1).cast("long")
    rows = dealt.join(wanted.select("cell", chunks.alias("chunks")), "cell")
    own = F.pmod(F.xxhash64(F.lit(2), "node"), "chunks")
    parted = rows.where("chunks > 1").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    pairs = parted.where("own <> other").select("node", F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other")).alias("cell"))
    return rows.where("chunks = 1").select("node", "cell").union(pairs)


def _fingerprint_cells(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(node, size, fp) -> (node, size, cell): a cell for each component of the fingerprints within radius."""
    fps, _ = materialize(classes.select("fp").distinct(), "class-fingerprints")
    found = connected_components(hamming_links(fps, radius)).select(F.col("node").alias("fp"), "component")
    # A word beside the component keeps these cells apart from the min-hashes' ones.
    return classes.join(found, "fp", "left").select("node", "size", F.xxhash64(F.lit("simhash"), F.coalesce("component", "fp")).alias("cell"))


def _rows(docs: DataFrame) -> DataFrame:
    """docs with _id and _text, by which a row is known."""
    return docs.withColumns({"_id": F.col("doc_id").cast("long"), "_text": F.xxhash64(text_or_empty())})


def groups(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, hot: int = HOT) -> DataFrame:
    """(doc_id, text) -> (_id, _text): the one row of each group that stays."""
    ship_package(docs.sparkSession)

    def sign(batches):
        for batch in portions(batches):
            own = [grams(t, shingle) for t in batch.column(2).to_pylist()]
            node = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in own], np.uint64).view(np.int64)
            cells = pa.array([keys(s) for s in own], pa.list_(pa.int64()))
            size = pa.array([len(s) for s in own], pa.int64())
            fp = pa.array(np.array([majority(s) for s in own], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(node), size, fp, cells], ["_id", "_text", "node", "size", "fp", "cells"])

    def collect(batches):
        for batch in portions(batches):
            own = [grams(t, shingle).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], ["node", "grams"])

    texts = _rows(docs).select("_id", "_text", text_or_empty().alias("text"))
    marked, _ = materialize(texts.mapInArrow(sign, "_id long, _text long, node long, size long, fp long, cells array<long>"), "signed")
    best = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_text"))
    classes, _ = materialize(marked.groupBy("node").agg(best.alias("best"), F.any_value("size").alias("size"), F.any_value("fp").alias("fp"), F.any_value("cells").alias("cells")), "classes")
    dealt, _ = materialize(_fingerprint_cells(classes).union(classes.select("node", "size", F.explode("cells").alias("cell"))), "dealt")
    routes, _ = materialize(_routes(dealt, hot), "routes")
    chosen = classes.join(routes.select("node").distinct(), "node", "left_semi").select("node", F.col("best._id").alias("i"), F.col("best._text").alias("t"))
    found = texts.join(chosen, texts["_id"].eqNullSafe(F.col("i")) & (texts["_text"] == F.col("t"))).select("node", "text")
    sets = found.mapInArrow(collect, "node long, grams binary").groupBy("node").agg(F.any_value("grams").alias("grams"))
    edges, _ = materialize(_bucket_links(routes.join(sets, "node").select("cell", "node", "grams"), similarity), "links")
    roots = connected_components(edges).withColumnRenamed("node", "_node")
    joined = classes.join(roots, classes["node"] == F.col("_node"), "left").select(F.coalesce("component", "node").alias("root"), "best")
    return joined.groupBy("root").agg(F.min("best").alias("best")).select("best._id", "best._text")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, hot: int = HOT) -> DataFrame:
    """docs with one row of each group."""
    keep, _ = materialize(groups(docs, shingle, similarity, hot), "kept")
    rows = _rows(docs)
    counts = rows.groupBy("_id", "_text").agg(F.count("*").alias("_n")).where("_n > 1")
    same = lambda a, b: a["_id"].eqNullSafe(b["_id"]) & (a["_text"] == b["_text"])
    kept, _ = materialize(rows.join(keep, same(rows, keep), "left_semi"), "kept-rows")
    counts, _ = materialize(counts, "repeats")
    once = kept.join(counts, same(kept, counts), "left_anti").select(*docs.columns)
    repeated = kept.join(counts, same(kept, counts), "left_semi")
    number = F.row_number().over(Window.partitionBy("_id", "_text").orderBy(F.xxhash64(*docs.columns)))
    return once.union(repeated.withColumn("_k", number).where("_k = 1").select(*docs.columns))
