"""Substring dedup: windows of words that occur earlier in the corpus, by compressed FM-indexes of shards.

A window is WINDOW consecutive words. Every window is assigned its anchor, the run of GRAM words in it whose hash is
least, so equal windows have equal anchors. Only anchors that occur twice can belong to repeated windows; they are
counted by a grouped aggregate. Around repeated anchors, documents give regions: neighbouring windows of one
anchor with their words. Regions are dealt by anchor to shards, so equal windows meet in one shard.

A shard's distinct regions are indexed by a Burrows-Wheeler transform (of contexts up to 32 words, which is longer than a
window) held in a wavelet matrix of packed bits with block counts. They are then streamed, all in step, from right
to left: a backward search extends the match by a word; at WINDOW words, the interval's parent of one word less is
taken from a bit array of the index's common prefixes, and extended again. These matching statistics give the
earliest place of each window. Regions of the same words ask the same, so one search answers for all of them, and each is
judged by what it returns. Windows that have an earlier place are reported as intervals, and documents drop their words.

Windows of an anchor with over HOT occurrences, such as a passage in a third of all documents, are dealt singly by
the hash of all their words, salted into as many shards as keep each of them small. The FM-index of a salted shard
leaves one place of each window; those meet in a second round of shards, which is dealt by the hash alone.

Texts are cut into portions of bounded size, written once as a table that is bucketed by portion. What is found about a
portion is sent to it, so texts are never shuffled.

Cases: null text has no words; a text under WINDOW words has no windows and is kept whole; "earlier" is by doc_id,
then start; rows of equal doc_ids and other texts are ordered by a hash of the text; rows that are wholly
equal are one document and get one result each; a null doc_id counts as the smallest; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, materialize, partitions_for, ship_package

WINDOW, GRAM, HOT = 20, 6, 20_000
#: Bytes of a shard's words and of a portion's texts, about.
SHARD, PORTION = 3 << 20, 8 << 20
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
NULL_ID = -(1 << 63)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Words:
    """The words of a column of texts, laid end to end: their places in `data`, hashes, and the first word of each text."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_binary())
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        n = int(at[-1] - at[0])
        self.data = np.zeros(n + 8, np.uint8)
        if n:
            self.data[:n] = np.frombuffer(data, np.uint8)[at[0] : at[-1]]
        at = at - at[0]
        word = ~_BLANK[self.data[:n]]
        # A word begins after a blank or where a text does.
        begins, ends = word.copy(), word.copy()
        begins[1:] &= ~word[:-1]
        ends[:-1] &= ~word[1:]
        edge = at[(at > 0) & (at < n)]
        begins[edge], ends[edge - 1] = word[edge], word[edge - 1]
        self.starts, self.stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, at)
        self.hashes = self._hashes()

    def _hashes(self) -> np.ndarray:
        size = self.stops - self.starts
        eight = np.ndarray((len(self.data) - 7,), "<u8", self.data.data, strides=(1,))  # 8 bytes from every place
        out = size.astype(np.uint64) * _FACTOR
        rest, done = np.arange(len(size)), 0
        while len(rest):
            left = size[rest] - done
            x = eight[self.starts[rest] + done] & _LOW[np.minimum(left, 8)]
            out[rest] = _mix((out[rest] ^ x) * np.uint64(0xFF51AFD7ED558CCD) + _FACTOR)
            done += 8
            rest = rest[left > 8]
        return out

    def spans(self, begin: np.ndarray, end: np.ndarray) -> pa.LargeBinaryArray:
        """The bytes from word begin to before word end, for each pair."""
        lo, hi = self.starts[begin], self.stops[end - 1]
        return _gather(self.data, lo, hi - lo)


def _gather(data: np.ndarray, lo: np.ndarray, size: np.ndarray) -> pa.LargeBinaryArray:
    ends = np.r_[0, np.cumsum(size)]
    picked = data[np.repeat(lo - ends[:-1], size) + np.arange(int(ends[-1]))]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lo), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(picked)])


def gram_hashes(hashes: np.ndarray, k: int = GRAM) -> np.ndarray:
    n = len(hashes) - k + 1
    out = np.zeros(max(0, n), np.uint64)
    for j in range(k if n > 0 else 0):
        out = out * _FACTOR + hashes[j : j + n]
    return _mix(out)


def least_places(values: np.ndarray, span: int) -> np.ndarray:
    """The place of the first least value among the span values from every place on."""
    if len(values) < span:
        return np.zeros(0, np.int64)
    least, place, width = values, np.arange(len(values)), 1
    while width < span:
        step = min(width, span - width)
        later = least[step:] < least[:-step]
        least, place = np.where(later, least[step:], least[:-step]), np.where(later, place[step:], place[:-step])
        width += step
    return place


def regions_of(words: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, anchor, first window, past the last window) of each region; windows are numbered by their first word."""
    n = len(words.starts)
    if n < window:
        empty = np.zeros(0, np.int64)
        return empty, np.zeros(0, np.uint64), empty, empty
    grams = gram_hashes(words.hashes, gram)
    place = least_places(grams, window - gram + 1)
    text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    whole = np.flatnonzero(text[: len(place)] == text[window - 1 :])  # windows that lie in one text
    if not len(whole):
        return regions_of(words, n + 1, gram)
    place, text = place[whole], text[whole]
    cut = np.flatnonzero((np.diff(place) != 0) | (np.diff(text) != 0)) + 1
    first, last = np.r_[0, cut], np.r_[cut, len(whole)] - 1
    return text[first], grams[place[first]], whole[first], whole[last] + 1


class Bits:
    """A packed bit array with a count before each 64 bits."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.counts = np.r_[0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]].astype(np.int32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        """How many bits are set before each place."""
        block = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[block] + np.bitwise_count(self.words[block] & below)

    def last(self, at: np.ndarray) -> np.ndarray:
        """The last set bit at or before each place; the first bit must be set."""
        block = at >> 6
        own = self.words[block] & (~np.uint64(0) >> (np.uint64(63) - (at & 63).astype(np.uint64)))
        while (none := np.flatnonzero(own == 0)).size:
            block[none] -= 1
            own[none] = self.words[block[none]]
        for shift in (1, 2, 4, 8, 16, 32):
            own |= own >> np.uint64(shift)
        return block * 64 + np.bitwise_count(own) - 1

    def next(self, at: np.ndarray, n: int) -> np.ndarray:
        """The first set bit after each place, or n."""
        block = at >> 6
        own = self.words[block] & ~(~np.uint64(0) >> (np.uint64(63) - (at & 63).astype(np.uint64)))
        while (none := np.flatnonzero((own == 0) & (block < len(self.words) - 1))).size:
            block[none] += 1
            own[none] = self.words[block[none]]
        low = np.bitwise_count((own & (~own + np.uint64(1))) - np.uint64(1))
        return np.where(own == 0, n, np.minimum(block * 64 + low, n))


class WaveletMatrix:
    """Ranks of symbols in a sequence: one packed bit array a level."""

    def __init__(self, symbols: np.ndarray):
        self.levels = max(1, int(symbols.max(initial=0)).bit_length())
        self.bits, self.zeros = [], []
        now = symbols
        for level in range(self.levels):
            ones = (now >> (self.levels - 1 - level)) & 1 > 0
            self.bits.append(Bits(ones))
            self.zeros.append(len(symbols) - int(ones.sum()))
            now = np.concatenate([now[~ones], now[ones]])

    def walk(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Where each place comes to lie when its prefix is sorted down to the symbol; differences are ranks."""
        at = places
        for level in range(self.levels):
            ones = self.bits[level].ones(at)
            at = np.where((symbols >> (self.levels - 1 - level)) & 1, self.zeros[level] + ones, at - ones)
        return at


class ShardIndex:
    """The FM-index of a text of symbols over 0, where 0 parts regions; order: what tells earlier places.

    It keeps packed bits, the symbols' first places, and one order for each distinct window.
    """

    def __init__(self, text: np.ndarray, order: np.ndarray, window: int = WINDOW):
        n, self.window = len(text), window
        pad = np.zeros(64, np.int64)
        whole = np.r_[text, pad]
        rank, at16, step = text.astype(np.int64), None, 1
        while step < 32:
            after = np.r_[rank[step:], np.zeros(min(step, n), np.int64)][:n]
            key = rank * (int(rank.max(initial=0)) + 1) + after
            rank = np.unique(key, return_inverse=True)[1].astype(np.int64) + 1
            step *= 2
            if step == 16:
                at16 = rank
        suffixes = np.argsort(rank, kind="stable")

        def heads(length: int) -> np.ndarray:
            """Where runs of suffixes with that many symbols in common begin."""
            a, b = suffixes[:-1], suffixes[1:]
            same = at16[a] == at16[b]
            for j in range(16, length):
                same &= whole[a + j] == whole[b + j]
            return np.r_[True, ~same]

        full = heads(window)
        self.earliest = np.minimum.reduceat(order[suffixes], np.flatnonzero(full))
        self.full, self.short = Bits(full), Bits(heads(window - 1))
        self.bwt = WaveletMatrix(text[suffixes - 1])
        sigma = int(text.max(initial=0)) + 1
        smaller = np.r_[0, np.cumsum(np.bincount(text, minlength=sigma))[:-1]]
        self.shift = smaller - self.bwt.walk(np.arange(sigma), np.zeros(sigma, np.int64))
        self.n = n

    def extend(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the symbol followed by what the intervals stand for."""
        shift = self.shift[symbols]
        return shift + self.bwt.walk(symbols, lo), shift + self.bwt.walk(symbols, hi)

    def statistics(self, text: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Streams regions of the text in step: the earliest order of the window at each place, where there is a window."""
        out = np.full(len(text), np.iinfo(np.int64).max)
        lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), self.n, np.int64)
        place = starts + sizes - 1
        live = np.flatnonzero(sizes >= self.window)
        length = 0
        while len(live):
            if length == self.window:  # the parent: one word less on the right
                at = lo[live]
                lo[live], hi[live] = self.short.last(at), self.short.next(at, self.n)
                length -= 1
            lo[live], hi[live] = self.extend(text[place[live]], lo[live], hi[live])
            length += 1
            if length == self.window:
                out[place[live]] = self.earliest[self.full.ones(lo[live] + 1) - 1]
            place[live] -= 1
            live = live[place[live] >= starts[live]]
        return out


def earlier_in_shard(docs: np.ndarray, begins: np.ndarray, words: Words, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """docs: order of each region's document; begins: its first word's place; -> (region, offset) of windows with an earlier place."""
    where = docs << 36 | begins
    by_words: dict[bytes, int] = {}
    hashes, first = words.hashes, words.first
    kind = np.array([by_words.setdefault(hashes[s:e].tobytes(), len(by_words)) for s, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], np.int64)
    least = np.full(len(by_words), np.iinfo(np.int64).max)
    np.minimum.at(least, kind, where)
    ids = np.unique(np.concatenate([np.frombuffer(k, np.uint64) for k in by_words]), return_inverse=True)[1].astype(np.int64) + 1
    sizes = np.fromiter((len(k) // 8 for k in by_words), np.int64, len(by_words))
    starts = np.cumsum(sizes + 1) - sizes - 1
    own = np.repeat(np.arange(len(sizes)), sizes)
    offset = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    text = np.zeros(int((sizes + 1).sum()), np.int64)
    text[starts[own] + offset] = ids
    order = np.full(len(text), np.iinfo(np.int64).max)
    order[starts[own] + offset] = least[own] + offset
    earliest = ShardIndex(text, order, window).statistics(text, starts, sizes)
    counts = sizes[kind] - window + 1
    region = np.repeat(np.arange(len(kind)), counts)
    offset = np.arange(len(region)) - np.repeat(np.cumsum(counts) - counts, counts)
    late = earliest[starts[kind[region]] + offset] < where[region] + offset
    return region[late], offset[late]


def _portions(docs: DataFrame, portion: int) -> DataFrame:
    """The bucketed table (portion, row, key, none, mark, text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    mark = F.xxhash64(text).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("key"), F.col("doc_id").isNull().alias("none"), mark.alias("mark"), text.alias("text"))
    n_bytes = keyed.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0

    def run(batches):
        number, row, size = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            sizes = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64)
            at = 0
            while at < batch.num_rows:
                n = int(np.searchsorted(np.cumsum(sizes[at:]), portion - size, side="right"))
                if n == 0 and row:
                    number, row, size = number + 1, 0, 0
                    continue
                part = batch.slice(at, max(n, 1))  # a text beyond the bound is a portion of its own
                rows = part.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(np.full(rows, number)), pa.array(np.arange(row, row + rows)), *part.columns], ["portion", "row", *part.schema.names])
                row, size, at = row + rows, size + int(sizes[at : at + rows].sum()), at + rows

    numbered = keyed.mapInArrow(run, "portion long, row long, key long, none boolean, mark int, text string")
    return bucketed(numbered, "portion", partitions_for(docs.sparkSession, n_bytes, 4 * portion), "portions")


def _anchor_rows(portions: DataFrame, window: int, gram: int) -> DataFrame:
    """(h, portion, at): at holds the row above 36 bits and the region's first window below."""

    def run(batches):
        for batch in batches:
            portion, row = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            words = Words(batch.column(2))
            text, anchor, begin, _ = regions_of(words, window, gram)
            at = row[text] << 36 | (begin - words.first[text])
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(portion[text]), pa.array(at)], ["h", "portion", "at"])

    return portions.select("portion", "row", "text").mapInArrow(run, "h long, portion long, at long")


_REGION = "h long, again long, portion long, row long, key long, mark int, begin long, words binary"


def _regions(portions: DataFrame, hits: DataFrame, window: int, gram: int) -> DataFrame:
    """hits (portion, at, salts): regions, or where salts is above 0 their single windows; again: the key of the second round."""

    def run(texts: pa.Table, hits: pa.Table) -> pa.Table:
        if not hits.num_rows:
            return schema.empty_table()
        number = texts.column("portion")[0].as_py()
        words = Words(pa.concat_arrays(texts.column("text").chunks))
        row, key, mark = (texts.column(c).to_numpy() for c in ("row", "key", "mark"))
        text, anchor, begin, end = regions_of(words, window, gram)
        at = row[text] << 36 | (begin - words.first[text])
        sort = np.argsort(at)
        found = sort[np.searchsorted(at, hits.column("at").to_numpy(), sorter=sort)]
        salts = hits.column("salts").to_numpy()
        cold, hot = found[salts == 0], found[salts > 0]
        n = end[hot] - begin[hot]
        of = np.repeat(text[hot], n)
        single = np.repeat(begin[hot] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        whole = gram_hashes(words.hashes, window)[single]
        salt = _mix((row[of] + number).astype(np.uint64) * _FACTOR) % np.repeat(salts[salts > 0], n).astype(np.uint64)
        dealt = _mix(whole + (salt + np.uint64(1)) * _FACTOR)
        of, first, last = np.r_[text[cold], of], np.r_[begin[cold], single], np.r_[end[cold], single + 1] + window - 1
        again = np.r_[np.zeros(len(cold), np.uint64), whole].view(np.int64)
        columns = [
            pa.array(np.r_[anchor[cold], dealt].view(np.int64)), pa.array(again, mask=np.arange(len(of)) < len(cold)), pa.array(np.full(len(of), number)),
            pa.array(row[of]), pa.array(key[of]), pa.array(mark[of]), pa.array(first - words.first[of]), words.spans(first, last).cast(pa.binary()),
        ]
        return pa.Table.from_arrays(columns, schema=schema)

    long, i32 = pa.int64(), pa.int32()
    schema = pa.schema([("h", long), ("again", long), ("portion", long), ("row", long), ("key", long), ("mark", i32), ("begin", long), ("words", pa.binary())])
    left = portions.select("portion", "row", "key", "mark", "text").groupBy("portion")
    return left.cogroup(hits.groupBy("portion")).applyInArrow(run, _REGION)


def _search(regions: DataFrame, window: int, shard: int) -> DataFrame:
    """Runs of n repeated windows (portion, row, begin, n), and with n = 0 the windows that go to the second round.

    A shard is cut where the key changes, at about that many bytes.
    """
    def work(table: pa.Table) -> pa.RecordBatch:
        portion, row, key, mark, begin = (table.column(c).to_numpy() for c in ("portion", "row", "key", "mark", "begin"))
        sort = np.lexsort((mark, key))
        docs = np.empty(len(key), np.int64)
        docs[sort] = np.cumsum(np.r_[False, (np.diff(key[sort]) != 0) | (np.diff(mark[sort]) != 0)])
        texts = pa.concat_arrays(table.column("words").chunks)
        region, offset = earlier_in_shard(docs, begin, Words(texts), window)
        first = np.r_[0, np.flatnonzero((np.diff(region) != 0) | (np.diff(offset) != 1)) + 1][: len(region)]
        count = np.diff(np.r_[first, len(region)])
        # Single windows with no earlier place here go on: others like them may lie in other shards.
        here = np.isin(np.arange(len(key)), region)
        alone = np.flatnonzero(table.column("again").is_valid().to_numpy() & ~here)
        both, none = np.r_[region[first], alone], np.zeros(len(alone), np.int64)
        again = pa.concat_arrays([pa.nulls(len(first), pa.int64()), *table.column("again").take(pa.array(alone)).chunks])
        columns = [
            pa.array(np.r_[count, none]), again, pa.array(portion[both]), pa.array(row[both]), pa.array(key[both]), pa.array(mark[both]),
            pa.array(begin[both] + np.r_[offset[first], none]), pa.concat_arrays([pa.nulls(len(first), pa.binary()), texts.take(pa.array(alone)).cast(pa.binary())]),
        ]
        return pa.RecordBatch.from_arrays(columns, ["n", "again", "portion", "row", "key", "mark", "begin", "words"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = last = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            h, each, at = batch.column("h").to_numpy(), batch.nbytes / batch.num_rows, 0
            changes = np.flatnonzero(np.r_[bool(held) and last != h[0], np.diff(h) != 0])
            while len(changes):
                k = int(np.searchsorted(changes, at + max(0, shard - size) / each))
                if k == len(changes):
                    break
                to = int(changes[k])
                yield work(pa.Table.from_batches([*held, batch.slice(at, to - at)]))
                held, size, at, changes = [], 0, to, changes[k + 1 :]
            held.append(batch.slice(at))
            size, last = size + (batch.num_rows - at) * each, h[-1]
        if held:
            yield work(pa.Table.from_batches(held))

    schema = "n long, again long, portion long, row long, key long, mark int, begin long, words binary"
    return regions.repartition("h").sortWithinPartitions("h").mapInArrow(run, schema)


def repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT, shard: int = SHARD, portion: int = PORTION) -> tuple[DataFrame, DataFrame]:
    """(portions of documents, runs of repeated windows (portion, row, begin, n)); shard, portion: bytes."""
    if not (gram < window < 32 and window > 17):
        raise ValueError("windows are of 18 to 31 words, longer than anchors")
    ship_package(docs.sparkSession)
    portions = _portions(docs, portion)
    rows = _anchor_rows(portions, window, gram)
    twice, _ = materialize(rows.groupBy("h").count().where("count > 1"), "repeated-anchors")
    most = twice.agg(F.max("count")).first()[0] or 0
    salts = F.when(F.col("count") > hot, F.ceil(F.col("count") / hot)).otherwise(0).cast("long")
    hits = rows.join(twice, "h").select("portion", "at", salts.alias("salts"))
    found = _search(_regions(portions, hits, window, gram), window, shard)
    if most > hot:
        found, _ = materialize(found, "first-round")
        others = found.where("n = 0").select(F.col("again").alias("h"), F.lit(None).cast("long").alias("again"), "portion", "row", "key", "mark", "begin", "words")
        found = found.where("n > 0").union(_search(others, window, shard))
    return portions, found.select("portion", "row", "begin", "n")


def remove_repeats(docs: DataFrame, window: int = WINDOW, **options) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_words, n_removed, kept): kept is the words that no repeated window covers, joined by a space."""
    portions, found = repeated_windows(docs, window, **options)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def run(texts: pa.Table, runs: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return schema.empty_table()
        words = Words(pa.concat_arrays(texts.column("text").chunks))
        row, n = texts.column("row").to_numpy(), len(words.starts)
        of = np.empty(int(row.max()) + 1, np.int64)
        of[row] = np.arange(len(row))
        begin = words.first[of[runs.column("row").to_numpy()]] + runs.column("begin").to_numpy()
        gone = np.zeros(n + 1, np.int64)
        np.add.at(gone, begin, 1)
        np.add.at(gone, begin + runs.column("n").to_numpy() + window - 1, -1)
        stay = np.flatnonzero(np.cumsum(gone[:n]) == 0)
        ends = np.searchsorted(stay, words.first)
        # A blank goes before each word but the first that its document keeps.
        blank = np.ones(len(stay), np.int64)
        blank[ends[:-1][np.diff(ends) > 0]] = 0
        lo, size = words.starts[stay], words.stops[stay] - words.starts[stay]
        flat = _gather(words.data, lo - blank, size + blank)
        at = np.frombuffer(flat.buffers()[1], np.int64)
        data = np.frombuffer(flat.buffers()[2] or b"", np.uint8).copy()
        data[at[:-1][blank > 0]] = 32
        kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(np.ascontiguousarray(at[ends])), pa.py_buffer(data)])
        total = np.diff(words.first)
        ids = pa.array(texts.column("key").to_numpy(), mask=texts.column("none").to_numpy())
        return pa.Table.from_arrays([ids, pa.array(total), pa.array(total - np.diff(ends)), kept.cast(pa.binary()).cast(pa.string(), safe=False)], schema=schema)

    left = portions.select("portion", "row", "key", "none", "text").groupBy("portion")
    return left.cogroup(found.groupBy("portion")).applyInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def brute_force(docs: list[tuple[int, str]], window: int = WINDOW) -> dict[int, tuple[int, int, str]]:
    """The same by a plain table of all windows, for tests: doc_id -> (n_words, n_removed, sha256)."""
    seen, out = set(), {}
    for doc_id, text in sorted(docs):
        words = (text or "").encode("utf-8", "surrogatepass").split()
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            if w in seen:
                gone[i : i + window] = [True] * window
            seen.add(w)
        kept = [w for w, g in zip(words, gone, strict=True) if not g]
        out[doc_id] = (len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out
