"""Token ids in sorted-string-table shards.

Shards hold documents in ascending order of their identifiers. A shard file is a run of blocks, a block
index, a Bloom filter and a footer. In a block, keys are prefix-compressed: the number of bytes shared with
the key before, the number of bytes that differ, those bytes, then the value's length and the value. The
index holds every block's first key, place and length, so a lookup reads the footer, a binary search of the
index, the Bloom filter and one block. Keys are 8 bytes that sort as the identifiers do.

Files are written by tasks under a name of their own and then renamed, so a task that runs again, or twice,
leaves one whole file. They go through the file system that the folder's URI names.

Cases: null text is empty; an empty text has the end id alone; a null identifier sorts before all others;
rows of equal identifiers are all kept, in order of text; an empty table gives no shards and no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, partitions_for, ship_package, split_points
from .pieces import encode_column, portions

MAGIC = b"LSST0001"
FOOTER = struct.Struct("<QIQIQQI8s")  # index at, size; filter at, size; rows, ids, crc of index and filter, magic
BLOCK_BYTES = 64 << 10
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


# --- ids -------------------------------------------------------------------------------------------


class WordIds:
    """Ids by the tokenizers library, piece by piece: blanks part words and are dropped by this tokenizer.

    Pieces of plain Latin-1 go to the library's model word by word, for its normalizer does no more to them
    than lower their letters; all others are encoded by the whole tokenizer.
    """

    def __init__(self, data: bytes, keep: int = 250_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(data.decode("utf-8"))
        self.model = self.tokenizer.model
        self.find = regex.compile(PATTERN + "|\\x0b").findall
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.keep = keep
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        self.letter = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}

    def _word(self, word: str) -> bytes:
        letters = "".join(map(self.letter.__getitem__, word.encode()))
        out = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(letters)])
        if len(self.words) < self.keep and len(word) <= 40:
            self.words[word] = out
        return out

    def _whole(self, piece: str) -> bytes:
        return np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def codes_of(self, pieces: list[str]) -> list[bytes]:
        pieces_known, known = self.pieces, self.words
        out: dict[str, bytes] = {}
        plain = []
        for p in pieces:
            if p in pieces_known:
                continue
            if (p.isascii() or _latin(p)) and "<|" not in p and "\v" not in p:
                plain.append(p)
            else:
                out[p] = self._whole(p)
        # One run of the pattern over all pieces; vertical tabs, which it skips, part them here.
        found = self.find("\v".join(plain).lower() + "\v") if plain else []
        now: list[bytes] = []
        places = iter(plain)
        for w in found:
            if w == "\v":
                out[next(places)] = b"".join(now)
                now = []
            else:
                now.append(known[w] if w in known else self._word(w))
        if len(pieces_known) < self.keep:
            pieces_known.update((p, c) for p, c in out.items() if len(p) <= 40)
        return [pieces_known[p] if p in pieces_known else out[p] for p in pieces]

    def encode(self, texts) -> pa.LargeBinaryArray:
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        return encode_column(texts, self.codes_of, False)


def _latin(piece: str) -> bool:
    try:
        piece.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


_WORD_IDS: dict[bytes, WordIds] = {}


def word_ids(data: bytes) -> WordIds:
    key = hashlib.sha256(data).digest()
    if key not in _WORD_IDS:
        _WORD_IDS[key] = WordIds(data)
    return _WORD_IDS[key]


# --- the file format -----------------------------------------------------------------------------------


def key_of(doc_id: int | None) -> bytes:
    """Null: eight zero bytes after a zero byte; others after a one byte, so that null sorts first."""
    return b"\0" + bytes(8) if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:])[0] - (1 << 63) if key[0] else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int, k: int = 7) -> list[int]:
    h = hashlib.blake2b(key, digest_size=16).digest()
    a, b = int.from_bytes(h[:8], "little"), int.from_bytes(h[8:], "little") | 1
    return [(a + i * b) % bits for i in range(k)]


class ShardWriter:
    """Takes keys in ascending order; ids are kept as 16-bit numbers where all of a block fit, else as 32-bit."""

    def __init__(self, out):
        self.out, self.at, self.rows, self.ids = out, 0, 0, 0
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self.block: list[tuple[bytes, bytes]] = []
        self.size = 0

    def add(self, key: bytes, ids: bytes) -> None:
        self.block.append((key, ids))
        self.size += len(ids) + 16
        self.rows += 1
        self.ids += len(ids) // 4
        if not self.keys or self.keys[-1] != key:
            self.keys.append(key)
        if self.size >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if not self.block:
            return
        narrow = all(len(v) == 0 or np.frombuffer(v, "<u4").max() < 1 << 16 for _, v in self.block)
        out, before = bytearray([narrow]), b""
        for key, ids in self.block:
            shared = 0
            while shared < min(len(key), len(before)) and key[shared] == before[shared]:
                shared += 1
            value = np.frombuffer(ids, "<u4").astype("<u2").tobytes() if narrow else ids
            out += _varint(shared) + _varint(len(key) - shared) + key[shared:] + _varint(len(value)) + value
            before = key
        data = zlib.compress(bytes(out), 1)
        self.index.append((self.block[0][0], self.at, len(data)))
        self.out.write(data)
        self.at += len(data)
        self.block, self.size = [], 0

    def close(self) -> None:
        self._flush()
        index = b"".join(_varint(len(k)) + k + struct.pack("<QI", at, n) for k, at, n in self.index)
        bits = max(64, 10 * len(self.keys))
        bloom = bytearray(-(-bits // 8))
        for key in self.keys:
            for p in _probes(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        tail = struct.pack("<Q", bits) + bytes(bloom)
        self.out.write(index + tail)
        self.out.write(FOOTER.pack(self.at, len(index), self.at + len(index), len(tail), self.rows, self.ids, zlib.crc32(index + tail), MAGIC))


class ShardReader:
    """file: a random-access file of pyarrow."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        at, n, self.filter_at, m, self.rows, self.ids, crc, magic = FOOTER.unpack(file.read_at(FOOTER.size, size - FOOTER.size))
        data = file.read_at(n + m, at)
        if magic != MAGIC or zlib.crc32(data) != crc:
            raise ValueError("not a whole shard file")
        self.bits, self.bloom = struct.unpack("<Q", data[n : n + 8])[0], data[n + 8 :]
        self.index, p = [], 0
        while p < n:
            k, p = _read_varint(data, p)
            self.index.append((data[p : p + k], *struct.unpack("<QI", data[p + k : p + k + 12])))
            p += k + 12

    def block(self, i: int):
        """Yields (key, ids as little-endian unsigned 32-bit)."""
        _, at, n = self.index[i]
        data, p, key = zlib.decompress(self.file.read_at(n, at)), 1, b""
        while p < len(data):
            shared, p = _read_varint(data, p)
            k, p = _read_varint(data, p)
            key = key[:shared] + data[p : p + k]
            v, p = _read_varint(data, p + k)
            value = data[p : p + v]
            p += v
            yield key, np.frombuffer(value, "<u2").astype("<u4").tobytes() if data[0] else value

    def __iter__(self):
        for i in range(len(self.index)):
            yield from self.block(i)

    def get(self, doc_id: int | None) -> list[bytes]:
        """All values of one identifier: Bloom filter, binary search of the index, then the blocks that can hold it."""
        key = key_of(doc_id)
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.bits)):
            return []
        lo, hi = 0, len(self.index)
        while lo < hi:  # the first block that starts at or after the key
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if self.index[mid][0] < key else (lo, mid)
        out = []
        for i in range(max(0, lo - 1), len(self.index)):
            if self.index[i][0] > key:
                break
            out += [v for k, v in self.block(i) if k == key]
        return out


# --- over Spark ------------------------------------------------------------------------------------------


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def write_shards(docs: DataFrame, tokenizer_file: str, folder: str | None = None, end_id: int = 2, shard_bytes: int = 32 << 20) -> DataFrame:
    """(doc_id, text) -> one row a shard: (shard long, path, n_rows, n_ids), shards in ascending order of identifiers.

    shard_bytes: about how many bytes of text go into a shard. The tokenizer file is broadcast (one entry a token).
    """
    spark: SparkSession = docs.sparkSession
    ship_package(spark)
    folder = folder or new_path(spark, "sstable")
    with open(tokenizer_file, "rb") as f:
        data = f.read()
    if len(data) > 64 << 20:
        raise ValueError("a tokenizer file of over 64 MB is not broadcast")
    shared = spark.sparkContext.broadcast(data)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    points = split_points(rows, partitions_for(spark, n_bytes, shard_bytes))
    end = np.array([end_id], dtype="<u4").tobytes()
    lows = np.array(points, dtype=np.int64)

    def encode(batches):
        own = word_ids(shared.value)
        for batch in portions(batches):
            codes = [c + end for c in own.encode(batch.column(1)).to_pylist()]
            ids = batch.column(0)
            shard = np.searchsorted(lows, ids.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False), side="left")
            small = [np.frombuffer(c, "<u4") for c in codes]
            packed = [b"\2" + s.astype("<u2").tobytes() if s.max() < 1 << 16 else b"\4" + c for s, c in zip(small, codes, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), ids, pa.array(packed, pa.binary())], ["shard", "doc_id", "ids"])

    def write(batches):
        fs, root = open_folder(folder)
        now, writer, stream, temp = None, None, None, ""

        def close():
            writer.close()
            stream.close()
            path = f"{root}/shard-{now:08d}.sst"
            fs.move(temp, path)
            return pa.RecordBatch.from_arrays(
                [pa.array([now], pa.int64()), pa.array([path]), pa.array([writer.rows], pa.int64()), pa.array([writer.ids], pa.int64())],
                ["shard", "path", "n_rows", "n_ids"],
            )

        for batch in batches:
            for shard, doc_id, packed in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if shard != now:
                    if writer is not None:
                        yield close()
                    now, temp = shard, f"{root}/.{uuid.uuid4().hex}.tmp"
                    fs.create_dir(root, recursive=True)
                    stream = fs.open_output_stream(temp)
                    writer = ShardWriter(stream)
                ids = packed[1:] if packed[0] == 4 else np.frombuffer(packed, "<u2", offset=1).astype("<u4").tobytes()
                writer.add(key_of(doc_id), ids)
        if writer is not None:
            yield close()

    dealt = rows.mapInArrow(encode, "shard long, doc_id long, ids binary").repartition(len(points) + 1, "shard")
    ordered = dealt.sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "ids")
    return ordered.mapInArrow(write, "shard long, path string, n_rows long, n_ids long")


def read_shards(shards: DataFrame, folder: str) -> DataFrame:
    """Reads shards back: (doc_id, start, n_tokens, ids_crc32). shards: what write_shards returned, as a table.

    start counts the ids of all documents before; the shards' totals, a row a shard, are summed up for it.
    """
    spark = shards.sparkSession
    ship_package(spark)
    totals = sorted((r.shard, r.path, r.n_ids) for r in shards.select("shard", "path", "n_ids").collect())
    starts = np.cumsum([0, *(n for _, _, n in totals)])
    frame = spark.createDataFrame([(p, int(s)) for (_, p, _), s in zip(totals, starts, strict=False)], "path string, start long")

    def read(batches):
        fs, _ = open_folder(folder)
        for batch in batches:
            for path, start in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                with fs.open_input_file(path) as file:
                    reader = ShardReader(file)
                    out: list[tuple] = []
                    for key, ids in reader:
                        out.append((id_of(key), start, len(ids) // 4, zlib.crc32(ids)))
                        start += len(ids) // 4
                        if len(out) == 65536:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], NAMES)
                            out = []
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], NAMES)

    return frame.repartition(max(1, len(totals))).mapInArrow(read, ", ".join(f"{n} long" for n in NAMES))


NAMES = ["doc_id", "start", "n_tokens", "ids_crc32"]


def lookup(uri: str, path: str, doc_id: int | None) -> list[np.ndarray]:
    fs, _ = open_folder(uri)
    with fs.open_input_file(path) as file:
        return [np.frombuffer(v, "<u4") for v in ShardReader(file).get(doc_id)]
