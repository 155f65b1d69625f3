"""Words of a column of texts, cut by byte classes.

All separators are ASCII, so UTF-8 texts can be cut as bytes: no text is decoded
and no Python string is made per word.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are cut at a time; a longer text is cut alone.
BLOCK_BYTES = 8 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


class Words(NamedTuple):
    words: pa.Array  #: large_binary, A-Z lower-cased, in order
    text: np.ndarray  #: which text each word is of
    starts: np.ndarray  #: first byte of each word, counted from its block's begin
    ends: np.ndarray  #: byte after each word
    origins: np.ndarray  #: first byte of each text, one more at the end
    data: np.ndarray  #: the block's bytes as given


def word_bytes(separators: bytes) -> np.ndarray:
    """Class of each byte: true unless it is one of ``separators``."""
    out = np.ones(256, bool)
    out[np.frombuffer(separators, np.uint8)] = False
    return out


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets from 0, bytes) of a string column; null is empty."""
    texts = pc.cast(pc.fill_null(texts, ""), pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    return offsets - offsets[0], data


def cut(texts: pa.Array, inside: np.ndarray) -> Words:
    """Runs of bytes of the class ``inside``; no word spans two texts."""
    origins, data = text_bytes(texts)
    flag = inside[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = flag[:-1], flag[1:]
    before[origins[:-1][origins[:-1] < len(data)]] = False
    after[origins[1:][origins[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(flag & ~before), np.flatnonzero(flag & ~after) + 1
    edge = np.concatenate([[0], np.cumsum(ends - starts)])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edge.astype(np.int64)), pa.py_buffer(_LOWER[data[flag]])])
    return Words(words, np.searchsorted(origins, starts, side="right") - 1, starts, ends, origins, data)


def blocks(batch: pa.RecordBatch, column: int):
    """Slices of a batch with about ``BLOCK_BYTES`` of text each."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < batch.num_rows:
        base = sizes[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(sizes, base + BLOCK_BYTES, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end
