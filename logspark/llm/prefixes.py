"""Document fingerprints from prefix polynomial hashes.

H[i] is the sum of c[j] * B^j over the first i code points, modulo a prime. Two such arrays give the hash of
any span in constant time, so equality of spans needs no look at the text, and the longest common extension
of two places is found by binary search. A fingerprint keeps the hash of the whole, the length, and two ladders of
rungs: hashes of prefixes and of suffixes at multiples of a power of two, 32 at most of each. Equality of prefixes
is monotone, so the common prefix and suffix of two documents are found by binary search over rungs alone.

Cases: null text is empty; texts of any length and any code points are taken whole; equal texts have equal
fingerprints; rows of equal doc_ids follow in order of text; a null doc_id counts as the smallest; one
document is its own next; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions_for, ship_package, split_points

PRIMES = (2147483647, 2147483629)
BASES = (1000003, 998244353 % PRIMES[1])
RUNGS = 32
_POWERS: list[list[np.ndarray]] = [[np.array([1], np.uint64), np.array([1], np.uint64)] for _ in PRIMES]


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """B^j and B^-j for j up to n, kept and doubled as needed."""
    p, b = PRIMES[which], BASES[which]
    forth, back = _POWERS[which]
    while len(forth) <= n:
        m = len(forth)
        forth = np.concatenate([forth, forth * np.uint64(pow(b, m, p)) % np.uint64(p)])
        back = np.concatenate([back, back * np.uint64(pow(b, -m, p)) % np.uint64(p)])
        _POWERS[which] = [forth, back]
    return forth, back


class PrefixHashes:
    """The arrays of one text; spans are [start, stop) in code points."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) + np.uint64(1)
        self.n = len(codes)
        self.sums = []
        for which, p in enumerate(PRIMES):
            terms = codes * _powers(which, self.n)[0][: self.n] % np.uint64(p)
            sums = np.zeros(self.n + 1, np.uint64)
            np.cumsum(terms, out=sums[1:])
            self.sums.append(sums)

    def _hash(self, which: int, start, stop):
        p = np.uint64(PRIMES[which])
        sums, back = self.sums[which], _powers(which, self.n)[1]
        return (sums[stop] - sums[start]) % p * back[start] % p

    def span(self, start: int, stop: int) -> int:
        return int(self._hash(0, start, stop)) << 31 | int(self._hash(1, start, stop))

    def extension(self, start: int, other: PrefixHashes, place: int) -> int:
        """How many code points from start here and from place there agree."""
        lo, hi = 0, min(self.n - start, other.n - place)
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if self.span(start, start + mid) == other.span(place, place + mid):
                lo = mid
            else:
                hi = mid - 1
        return lo

    def fingerprint(self) -> str:
        shift = 0
        while self.n >> shift > RUNGS:
            shift += 1
        at = np.arange(1, (self.n >> shift) + 1) << shift
        rungs = np.concatenate([self._hash(0, np.zeros_like(at), at), self._hash(0, self.n - at, np.full_like(at, self.n))])
        return f"{self.span(0, self.n):016x}{self.n:010x}{shift:02x}" + rungs.astype(">u4").tobytes().hex()


def _open(fingerprint: str) -> tuple[int, int, np.ndarray, np.ndarray]:
    n, shift = int(fingerprint[16:26], 16), int(fingerprint[26:28], 16)
    rungs = np.frombuffer(bytes.fromhex(fingerprint[28:]), ">u4")
    half = len(rungs) // 2
    return n, shift, rungs[:half], rungs[half:]


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """How many rungs agree from the first on, by binary search."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[mid - 1] == b[mid - 1]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def likeness(one: str, two: str) -> float:
    """Share of the longer text that lies in the common prefix and suffix, to the rungs' precision; 1 if equal."""
    if one == two:
        return 1.0
    (n, s, p, q), (m, t, u, v) = _open(one), _open(two)
    shift = max(s, t)
    every = lambda rungs, own: rungs[(1 << (shift - own)) - 1 :: 1 << (shift - own)]
    ahead = _common(every(p, s), every(u, t)) << shift
    behind = _common(every(q, s), every(v, t)) << shift
    return min(ahead + behind, n, m) / max(n, m)


def fingerprint(text: str | None) -> str:
    return PrefixHashes(text or "").fingerprint()


def compare_with_next(docs: DataFrame, piece_bytes: int = 32 << 20) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, see the query op7.

    Documents are dealt once, to ranges of doc_id, with the one that follows a range as its last row.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n_bytes, greatest = rows.agg(F.sum(F.octet_length("text")), F.max("doc_id")).first()
    points = split_points(rows, partitions_for(spark, n_bytes or 0, piece_bytes))
    # Range j holds points[j - 1] < doc_id <= points[j]; so points[j - 1] is what follows it, downwards.
    lows = np.array(points, dtype=np.int64)

    def deal(batches):
        for batch in batches:
            ids = batch.column(0).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
            own = np.searchsorted(lows, ids, side="left")
            yield with_range(batch, own, False)
            edge = np.zeros(len(ids), bool)
            if len(lows):
                edge = (own < len(lows)) & (lows[np.minimum(own, len(lows) - 1)] == ids)
            for where, to in ((edge, own + 1), (ids == (-(1 << 63) if greatest is None else greatest), np.zeros_like(own))):
                if where.any():
                    yield with_range(batch.filter(pa.array(where)), to[where], True)

    def with_range(batch, to, ahead):
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(to, pa.int64()), pa.array(np.full(len(to), ahead))], ["doc_id", "text", "piece", "ahead"])

    def run(batches):
        held, out = None, []
        for batch in batches:
            for doc_id, text, piece, ahead in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if held is not None and held[2] == piece:
                    n = len(held[1])
                    k = n // 3
                    edited = held[1][: n - k] + text[:k]
                    a = held[3]
                    b = a if edited == held[1] else fingerprint(edited)
                    c = fingerprint(text)
                    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((held[0], n, sha, a, b, likeness(a, b), likeness(a, c)))
                    held = None if ahead else (doc_id, text, piece, c)
                else:
                    held = None if ahead else (doc_id, text, piece, fingerprint(text))
                if len(out) == 2048:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], NAMES)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], NAMES)

    dealt = rows.mapInArrow(deal, "doc_id long, text string, piece long, ahead boolean").repartition(len(points) + 1, "piece")
    ordered = dealt.sortWithinPartitions("piece", "ahead", F.col("doc_id").desc_nulls_last(), "text")
    return ordered.mapInArrow(run, SCHEMA)


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
