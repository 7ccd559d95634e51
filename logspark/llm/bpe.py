"""Byte-level BPE by replaying merges over a whole batch of words at once.

The distinct words of a batch are laid end to end as token positions with links to their neighbours. An
inverted index maps each merge rank to the positions whose pair it joins. Ranks are taken in order from
a heap; each one merges all its positions in one go, and only the pairs of touched neighbours are looked
up and entered again. The ids of a word depend on the word alone, so batches need no exchange.

Texts are cut at spaces that stand between two non-blanks, where no match of the pattern can span; pieces
recur, so their ids are kept in a table of bounded size.

Cases: null text is empty; an empty text has no ids; texts of any length and words of any length are taken
whole; text of special tokens is ordinary text; repeated rows, null ids and other columns pass unchanged.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship_package
from .pieces import encode_column, gather, portions

NONE = np.int64(1) << 40


def read_ranks(data: bytes) -> dict[bytes, int]:
    """The lines of a rank file: base64 of the token, its rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


class MergeReplay:
    """ranks: token bytes -> rank, which is the id; all 256 single bytes are tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.vocab = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            self.vocab[i] = t
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = [
            (ranks[t[:k]] << 20 | ranks[t[k:]], r)
            for t, r in ranks.items()
            for k in range(1, len(t))
            if t[:k] in ranks and t[k:] in ranks
        ]
        table = np.array(sorted(pairs), dtype=np.int64).reshape(-1, 2)
        self.keys, self.joined = table[:, 0].copy(), table[:, 1].copy()
        left, right = self.keys >> 20, self.keys & 0xFFFFF
        # Tokens that may join at a lower rank than their own; their places in a word are then taken one by one.
        self.odd = set(left[self.joined < left].tolist()) | set(right[self.joined < right].tolist())

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.joined[at], NONE) if len(self.keys) else np.full(len(left), NONE)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        rest = []
        for i, w in enumerate(words):
            if (r := self.ranks.get(w)) is not None:
                out[i] = r.to_bytes(4, "little")
            elif w:
                rest.append(i)
        if not rest:
            return out
        own = [words[i] for i in rest]
        sizes = np.fromiter(map(len, own), dtype=np.int64, count=len(own))
        tok = self.of_byte[np.frombuffer(b"".join(own), dtype=np.uint8)]
        ends = np.cumsum(sizes)
        n = len(tok)
        word = np.repeat(np.arange(len(rest)), sizes)
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        nxt[ends - 1] = n  # n stands for none
        prv[ends - sizes] = n
        tok, rank = np.append(tok, 0), np.full(n + 1, NONE)
        alive = np.ones(n + 1, dtype=bool)
        has = np.flatnonzero(nxt < n)
        rank[has] = self._rank(tok[has], tok[nxt[has]])
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(places: np.ndarray) -> None:
            ranks = rank[places]
            if not (real := ranks < NONE).all():
                places, ranks = places[real], ranks[real]
            if not len(places):
                return
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cut = np.flatnonzero(np.diff(ranks)) + 1
            for r, part in zip(ranks[np.r_[0, cut]].tolist(), np.split(places, cut), strict=False):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(heap, r)

        enter(has)
        while heap:
            r = heapq.heappop(heap)
            parts = index.pop(r)
            at = np.unique(np.concatenate(parts)) if len(parts) > 1 else np.sort(parts[0])
            at = at[alive[at] & (rank[at] == r)]
            if not len(at):
                continue
            if len(at) > 1:
                if r in self.odd:
                    first = np.r_[True, word[at[1:]] != word[at[:-1]]]
                    if not first.all():
                        index[r] = [at[~first]]
                        heapq.heappush(heap, r)
                        at = at[first]
                else:
                    linked = np.r_[False, nxt[at[:-1]] == at[1:]]
                    if linked.any():  # of overlapping places, every other one from the left
                        k = np.arange(len(at))
                        at = at[(k - np.maximum.accumulate(np.where(linked, 0, k))) % 2 == 0]
            gone = nxt[at]
            after = nxt[gone]
            tok[at] = r
            alive[gone] = False
            rank[gone] = NONE
            nxt[at] = after
            real = after < n
            prv[after[real]] = at[real]
            rank[at] = NONE
            rank[at[real]] = self._rank(tok[at[real]], tok[after[real]])
            before = prv[at]
            before = before[before < n]
            rank[before] = self._rank(tok[before], tok[nxt[before]])
            enter(np.unique(np.r_[at[real], before]))
        left = np.flatnonzero(alive[:n])
        ids = tok[left].astype("<u4").tobytes()
        stops = np.cumsum(np.bincount(word[left], minlength=len(rest))) * 4
        start = 0
        for i, stop in zip(rest, stops.tolist(), strict=True):
            out[i] = ids[start:stop]
            start = stop
        return out


class Coder:
    """Encodes and decodes texts; keep: the most pieces and words that are remembered."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, keep: int = 250_000):
        self.replay = MergeReplay(ranks)
        self.find = regex.compile(pattern).findall
        self.keep = keep
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.vocab_array = pa.array(self.replay.vocab, pa.large_binary())

    def forget(self) -> None:
        """Gives up what is remembered, so that an idle worker holds the vocabulary alone."""
        self.pieces, self.words = {}, {}

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        """The ids of pieces, from the replay of the words in them that are not yet known."""
        # Pieces with one space, in front, are matched in one run: a word with a space starts a piece.
        plain = [p for p in pieces if p[:1] == " " and len(p.split()) == 1 and not p[-1].isspace() and not p[1].isspace()]
        other = list(pieces.difference(plain))
        words = self.find("".join(plain))
        bounds = [*(i for i, w in enumerate(words) if w[0] == " "), len(words)]
        found = [self.find(p) for p in other]
        all_words = set(words)
        for ws in found:
            all_words.update(ws)
        new = list(all_words.difference(self.words))
        codes = dict(zip(new, self.replay.encode([w.encode("utf-8", "surrogatepass") for w in new]), strict=True))
        for w in all_words.difference(codes):
            codes[w] = self.words[w]
        of_word = [codes[w] for w in words]
        out = {p: b"".join(of_word[i:j]) for p, i, j in zip(plain, bounds[:-1], bounds[1:], strict=True)}
        out.update((p, b"".join([codes[w] for w in ws])) for p, ws in zip(other, found, strict=True))
        if len(self.words) < self.keep:
            self.words.update((w, codes[w]) for w in new if len(w) <= 40)
        return out

    def codes_of(self, pieces: list[str]) -> list[bytes]:
        known = self.pieces
        new = {p for p in pieces if p not in known}
        codes = self._learn(new)
        if len(known) < self.keep:  # frequent pieces come early; when full, others are worked out anew
            known.update((p, c) for p, c in codes.items() if len(p) <= 40)
        return [known[p] if p in known else codes[p] for p in pieces]

    def whole(self, text: str) -> bytes:
        return b"".join(self.replay.encode([w.encode("utf-8", "surrogatepass") for w in self.find(text)]))

    def encode(self, texts) -> pa.LargeBinaryArray:
        """texts: a list or an Arrow array; gives the ids of each as little-endian unsigned 32-bit integers."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        return encode_column(texts, self.codes_of, True, lambda p: p[-1:].isspace(), self.whole)

    def decode(self, ids: pa.Array) -> pa.LargeBinaryArray:
        ids = ids.cast(pa.large_binary())
        _, offsets, data = ids.buffers()
        ends = np.frombuffer(offsets, dtype=np.int64)[ids.offset : ids.offset + len(ids) + 1] // 4
        tokens = np.frombuffer(data or b"", dtype="<u4")[ends[0] : ends[-1]]
        return gather(self.vocab_array, tokens, ends - ends[0])


_CODERS: dict[tuple, Coder] = {}


def coder(data: bytes, pattern: str) -> Coder:
    """One coder for each vocabulary in a worker process, kept from task to task; what it remembers lasts for a task."""
    key = (hashlib.sha256(data).digest(), pattern)
    if key not in _CODERS:
        _CODERS[key] = Coder(read_ranks(data), pattern)
    return _CODERS[key]


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, column: str = "text", ids: str = "token_ids", decoded: str | None = None) -> DataFrame:
    """docs with binary column `ids` (little-endian unsigned 32-bit) and, if named, binary column `decoded`.

    The rank file is read by the driver and broadcast: it has one line a token, so its size is fixed.
    """
    spark: SparkSession = docs.sparkSession
    ship_package(spark)
    with open(rank_file, "rb") as f:
        data = f.read()
    if len(data) > 64 << 20:
        raise ValueError("a rank file of over 64 MB is not broadcast")
    shared = spark.sparkContext.broadcast(data)
    docs = docs.select(*[c for c in docs.columns if c not in (ids, decoded)])
    more = [ids, decoded] if decoded else [ids]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.BinaryType()) for c in more)])
    at = docs.columns.index(column)

    def run(batches):
        own = coder(shared.value, pattern)
        try:
            for batch in portions(batches):
                codes = own.encode(batch.column(at))
                arrays = [*batch.columns, codes.cast(pa.binary())]
                if decoded:
                    arrays.append(own.decode(codes).cast(pa.binary()))
                yield pa.RecordBatch.from_arrays(arrays, schema.names)
        finally:
            own.forget()

    return docs.mapInArrow(run, schema)


def decode_ids(frame: DataFrame, rank_file: str, pattern: str, ids: str = "token_ids", text: str = "text") -> DataFrame:
    """frame with `text`, decoded from binary column `ids`; bytes that are no UTF-8 become U+FFFD. Null ids give null."""
    spark = frame.sparkSession
    ship_package(spark)
    with open(rank_file, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    frame = frame.select(*[c for c in frame.columns if c != text])
    at = frame.columns.index(ids)
    schema = T.StructType([*frame.schema.fields, T.StructField(text, T.StringType())])

    def run(batches):
        own = coder(shared.value, pattern)
        for batch in portions(batches):
            column = batch.column(at)
            found = own.decode(pc.fill_null(column, b"")).to_pylist()
            texts = [None if x is None else x.decode("utf-8", "replace") for x in found]
            texts = pc.if_else(column.is_valid(), pa.array(texts, pa.string()), pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], schema.names)

    return frame.mapInArrow(run, schema)


def digests(encoded: DataFrame, ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    return encoded.select(
        "doc_id",
        (F.octet_length(ids) / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col(ids), 256).alias("ids_sha256"),
        F.sha2(F.col(decoded), 256).alias("decoded_sha256"),
    )
