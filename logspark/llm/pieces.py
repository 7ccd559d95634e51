"""Encoding a column of texts through its distinct space-separated pieces, a batch at a time."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


#: Texts worked on at once: bounds what a worker holds beside the batch it was sent.
ROWS = 1536


def portions(batches):
    """Batches in smaller portions; what the last one took is given back to the system."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)
            pa.default_memory_pool().release_unused()


def gather(values: pa.LargeBinaryArray, picks: pa.Array | np.ndarray, ends: np.ndarray) -> pa.LargeBinaryArray:
    """Joins values[picks], row i of the result being those from ends[i] to ends[i + 1]."""
    if not len(values) or not len(picks):
        return pa.array([b""] * (len(ends) - 1), pa.large_binary())
    taken = values.take(picks if isinstance(picks, pa.Array) else pa.array(picks))
    _, offsets, data = taken.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[taken.offset : taken.offset + len(taken) + 1]
    cut = np.ascontiguousarray(at[ends])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(cut), data or pa.py_buffer(b"")])


def encode_column(
    texts: pa.Array,
    codes_of: Callable[[list[str]], list[bytes]],
    keep_space: bool,
    apart: Callable[[str], bool] = lambda piece: False,
    whole: Callable[[str], bytes] | None = None,
) -> pa.LargeBinaryArray:
    """Codes of each text: those of its pieces, one after another; null texts are empty.

    keep_space: a piece begins with the space before it; otherwise spaces and line feeds part pieces and go.
    Texts that have a piece for which apart() holds are encoded by whole() instead.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if keep_space:
        lists = pc.split_pattern(pc.replace_substring(texts, " ", "\0 "), "\0")
    else:
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
    flat = lists.flatten()
    coded = flat.dictionary_encode()
    uniq = coded.dictionary.to_pylist()
    codes = pa.array(codes_of(uniq), pa.large_binary())
    ends = lists.offsets.to_numpy(zero_copy_only=False)
    ends = ends - ends[0]
    out = gather(codes, coded.indices, ends)
    if whole is None:
        return out
    odd = np.array([apart(p) for p in uniq], dtype=bool)
    slow = pc.match_substring(texts, "\0").to_numpy(zero_copy_only=False).copy()
    if odd.any():
        hit = np.r_[0, np.cumsum(odd[coded.indices.to_numpy(zero_copy_only=False)])]
        slow |= hit[ends[1:]] > hit[ends[:-1]]
    if not slow.any():
        return out
    rows = np.flatnonzero(slow)
    own = pa.array([whole(t) for t in texts.take(pa.array(rows)).to_pylist()], pa.large_binary())
    return pc.replace_with_mask(out, pa.array(slow), own)
