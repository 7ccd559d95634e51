"""SimHash near-duplicates: fingerprints, an exact Hamming join by segment popcounts, and components.

A fingerprint is embedded as the bit counts of its 2-bit segments. Flipping a bit moves one count by one,
so the Manhattan distance of two embeddings is a lower bound of the Hamming distance. The join is a grid
range-join on the embedding: its segments are dealt to 2 * radius blocks; at a Manhattan distance of at
most radius, at least radius blocks are equal, so every linked pair meets in some grid cell, which is a
choice of radius blocks and their counts. In a cell, pairs are filtered by Manhattan distance, then
verified exactly; a cell passes on a spanning forest of its links, never all pairs.

Cells with more than `hot` fingerprints are split again by the bits themselves (blocks of the 64 bits,
radius of 2 * radius equal), which loses no pair either, for the same reason.

Cases: null text has no words; no words give fingerprint zero, which links like any other; fewer words than
a shingle make one shingle of all; a null doc_id keeps its row and links; equal doc_ids keep all their rows;
a component whose doc_ids are all null has a null id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ship_package
from .graph import connected_components

SEED = 42


def fingerprint(text: str | None, shingle: int = 3) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    return majority(np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half the hashes have."""
    total = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):  # bounds the unpacked bits of long texts
        part = np.ascontiguousarray(hashes[i : i + (1 << 16)], dtype="<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, text) -> (doc_id, fp long: the 64 bits, signed)."""
    ship_package(docs.sparkSession)

    def run(batches):
        for batch in batches:
            out = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _counts(fps: np.ndarray) -> np.ndarray:
    """The embedding: bit counts of the 32 segments of two bits, two bits for each count."""
    odd = np.uint64(0x5555555555555555)
    return (fps & odd) + ((fps >> np.uint64(1)) & odd)


def _cells(values: np.ndarray, radius: int, salt: int) -> np.ndarray:
    """Keys of the cells of each value: n x choices. Each choice takes radius of 2 * radius blocks of 2-bit places."""
    bounds = [2 * round(i * 32 / (2 * radius)) for i in range(2 * radius + 1)]
    masks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(bounds, bounds[1:], strict=False)]
    out = []
    for c, chosen in enumerate(combinations(range(2 * radius), radius)):
        mask = np.uint64(sum(masks[i] for i in chosen))
        x = (values & mask) + np.uint64((salt * 64 + c + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        for shift in (33, 29):  # mixes, so that equal cells of different choices lie apart
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(0xFF51AFD7ED558CCD)
        out.append(x ^ (x >> np.uint64(32)))
    return np.stack(out, 1)


def forest(fps: np.ndarray, radius: int, block: int = 512) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints; index pairs."""
    n = len(fps)
    root = np.arange(n)
    edges: list[tuple[int, int]] = []
    emb = _counts(fps)
    mid, low = np.uint64(0x3333333333333333), np.uint64(3)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return int(i)

    for s in range(0, n, block):
        for t in range(s, n, block * 16):
            a, b = slice(s, min(s + block, n)), slice(t, min(t + block * 16, n))
            # Manhattan distance of the embeddings: sum of |difference| over 2-bit counts, from their bits.
            hi, lo = emb[a, None] ^ emb[None, b], np.uint64(0x5555555555555555)
            # Counts 0, 1, 2: they differ by 2 only as 0 and 2, where just the upper bits differ.
            one = hi & lo
            two = (hi >> np.uint64(1)) & lo & ~one
            near = np.bitwise_count(one).astype(np.int16) + 2 * np.bitwise_count(two) <= radius
            i, j = np.nonzero(near)
            i, j = i + s, j + t
            keep = (i < j) & (np.bitwise_count(fps[i] ^ fps[j]) <= radius)
            i, j = i[keep], j[keep]
            while len(i):
                ri, rj = root[i], root[j]
                open_ = ri != rj
                i, j = i[open_], j[open_]
                if not len(i):
                    break
                # Joins what the first links of distinct roots say, then looks again.
                _, first = np.unique(np.maximum(root[i], root[j]), return_index=True)
                for k in first:
                    x, y = find(int(i[k])), find(int(j[k]))
                    if x != y:
                        root[max(x, y)] = min(x, y)
                        edges.append((int(i[k]), int(j[k])))
                up = root[root]
                while not np.array_equal(up, root):
                    root[:] = up
                    up = root[root]
    del mid, low
    return edges


def _deal(rows: DataFrame, radius: int, bits: bool) -> DataFrame:
    """(fp, ...) -> one row for each cell of fp."""

    def run(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            cells = _cells(fps if bits else _counts(fps), radius, int(bits))
            if batch.num_columns > 1:  # within the cell that is split
                was = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
                cells = (cells ^ (was[:, None] * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0x9E3779B97F4A7C15)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cells.reshape(-1).view(np.int64)), pa.array(np.repeat(fps, cells.shape[1]).view(np.int64))], ["cell", "fp"]
            )

    return rows.mapInArrow(run, "cell long, fp long")


def _links(dealt: DataFrame, radius: int) -> DataFrame:
    """Forests of all cells: (a, b). Rows of a cell lie together, sorted; cells of one row cost nothing."""

    def run(batches):
        held_c, held_f = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def work(cells, fps):
            if len(cells) < 2:
                return None
            cut = np.flatnonzero(np.diff(cells)) + 1
            lo, hi = np.r_[0, cut], np.r_[cut, len(cells)]
            size = hi - lo
            out = []
            two = lo[size == 2]
            if len(two):
                x, y = fps[two], fps[two + 1]
                near = np.bitwise_count((x ^ y).view(np.uint64)) <= radius
                out.append(np.stack([x[near], y[near]], 1))
            for s, e in zip(lo[size > 2], hi[size > 2], strict=False):
                own = np.unique(fps[s:e])
                if pairs := forest(own.view(np.uint64), radius):
                    out.append(own[np.array(pairs)])
            got = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
            got = got[got[:, 0] != got[:, 1]]
            if not len(got):
                return None
            return pa.RecordBatch.from_arrays([pa.array(got.max(1)), pa.array(got.min(1))], ["a", "b"])

        for batch in batches:
            c = np.r_[held_c, batch.column(0).to_numpy(zero_copy_only=False)]
            f = np.r_[held_f, batch.column(1).to_numpy(zero_copy_only=False)]
            last = np.searchsorted(c, c[-1]) if len(c) else 0
            held_c, held_f = c[last:], f[last:]
            if (got := work(c[:last], f[:last])) is not None:
                yield got
        if (got := work(held_c, held_f)) is not None:
            yield got

    return dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long")


def hamming_links(fps: DataFrame, radius: int = 3, hot: int = 20_000) -> DataFrame:
    """(fp long), distinct -> edges (a, b) whose components are those of all pairs within radius."""
    ship_package(fps.sparkSession)
    if radius == 0:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    dealt = _deal(fps.select("fp"), radius, bits=False)
    full = dealt.groupBy("cell").count().where(F.col("count") > hot).select("cell")
    full, _ = materialize(full, "hot-cells")
    if full.isEmpty():
        return _links(dealt, radius).distinct()
    small = dealt.join(full, "cell", "left_anti")
    split = _deal(dealt.join(full, "cell", "left_semi").select("fp", "cell"), radius, bits=True)
    return _links(small.union(split), radius).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, text) -> (doc_id, fp long, component_id, n_in_component), a row for each row of docs."""
    marked, _ = materialize(with_fingerprints(docs, shingle), "fingerprints")
    classes, _ = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "classes")
    found = connected_components(hamming_links(classes.select("fp"), radius))
    joined, _ = materialize(
        classes.join(found.select(F.col("node").alias("fp"), "component"), "fp", "left").select("fp", "least", "n", F.coalesce("component", "fp").alias("root")),
        "joined",
    )
    roots = joined.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("n_in_component"))
    ids = joined.join(roots, "root").select("fp", "component_id", "n_in_component")
    return marked.join(ids, "fp").select("doc_id", "fp", "component_id", "n_in_component")


def one_of_each(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """Keeps one document of each group: that of the smallest doc_id (of equal ids, all rows; null ids only if a group has no other)."""
    found = near_duplicates(docs, shingle, radius)
    keep = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    return docs.join(keep, docs["doc_id"].eqNullSafe(keep["doc_id"]), "left_semi")
