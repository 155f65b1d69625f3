"""Encoding whole texts through a table of the units met so far.

A unit is a run that no token crosses, so a text's ids are the ids of its units
in order, and equal units are encoded one time.  Arrow cuts texts into units
and numbers the distinct ones; only units that are new to the worker reach the
encoder.  Texts with characters on which the cutting rules of libraries could
differ are not cut: :func:`plain` says which texts are.
"""

from __future__ import annotations

import gc
import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters up to U+012F, less control characters and unusual white space.
_CUT = r"^[\t\n\f\r\x20-\x7e\x{a1}-\x{12f}]*$"


def plain(texts: pa.Array, specials: list[str]) -> pa.Array:
    """Texts made of characters that all libraries class alike, free of the
    strings of special tokens."""
    out = pc.match_substring_regex(texts, _CUT)
    for one in specials:
        out = pc.and_(out, pc.invert(pc.match_substring(texts, one)))
    return out


_SPACE, _LETTER, _OTHER = (np.array([chr(b) in " \t\n\f\r" for b in range(256)]),
                          np.array([b < 128 and chr(b).isalpha() for b in range(256)]),
                          np.array([32 < b < 127 and not chr(b).isalpha() for b in range(256)]))


def cut_units(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Units of plain texts, and where each text's begin.

    Text is cut before white space that follows something else, and between a
    letter and a digit or punctuation mark.  No token of the byte-level or the
    word vocabulary crosses such a place, and what it makes of a unit does not
    depend on the units beside it.
    """
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    if not len(data):
        return pa.array([], pa.large_binary()), np.zeros(len(offsets), np.int64)
    space, letter = _SPACE[data], _LETTER[data]
    # letters of two bytes end in a byte after C3 or C4; D7 and F7 are signs
    before, after = data[:-1], data[1:]
    letter[1:] |= (after >= 0x80) & ((before == 0xC4) | ((before == 0xC3) & (after != 0x97) & (after != 0xB7)))
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = (space[1:] & ~space[:-1]) | (letter[:-1] & _OTHER[after])
    cut[offsets] = True
    at = np.flatnonzero(cut)  # the last is the end of the data
    units = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)])
    return units, np.searchsorted(at, offsets)


class UnitTable:
    """unit -> ids.  ``encode_units`` maps a list of units to (ids, lengths);
    ``encode_whole`` does the same for texts that are not plain.  ``lower``: the
    vocabulary lower-cases.

    The table is emptied when it holds ``limit`` units or ``limit_chars``
    characters, which bounds memory and changes no result.
    """

    def __init__(self, lower: bool, specials, encode_units, encode_whole, most_id: int = 2**31 - 1, limit: int = 250_000, limit_chars: int = 8_000_000):
        self.lower, self.specials, self.limit, self.limit_chars = lower, specials, limit, limit_chars
        self.encode_units, self.encode_whole, self.most_id = encode_units, encode_whole, most_id
        self._clear()

    def _clear(self) -> None:
        self.index, self.chars = {}, 0
        self.ids = np.zeros(0, np.int32)
        self.starts, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts (null: empty) and the number of ids of each."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        easy = plain(texts, self.specials)
        if pc.all(easy).as_py() is not False:
            return self._cut(texts)
        mask = easy.to_numpy(zero_copy_only=False)
        ids, counts = self._cut(texts.filter(easy))
        other, other_counts = self.encode_whole(texts.filter(pc.invert(easy)).to_pylist())
        n = np.zeros(len(mask), np.int64)
        n[mask], n[~mask] = counts, other_counts
        owner = np.repeat(mask, n)
        out = np.zeros(len(owner), np.int32)
        out[owner], out[~owner] = ids, other
        return out, n

    def _cut(self, texts) -> tuple[np.ndarray, np.ndarray]:
        units, edges = cut_units(pc.utf8_lower(texts) if self.lower else texts)
        units = units.dictionary_encode()
        which = self._known(units.dictionary.to_pylist())
        where = which[units.indices.to_numpy()]
        lengths = self.lengths[where]
        ends = np.zeros(len(lengths) + 1, np.int32)
        np.cumsum(lengths, out=ends[1:])
        at = np.repeat(self.starts[where] - ends[:-1], lengths)
        at += np.arange(ends[-1], dtype=np.int32)
        return self.ids[at], np.diff(ends[edges])

    def _known(self, units: list[bytes]) -> np.ndarray:
        """Row of each of these distinct units in the table."""
        if len(self.index) > self.limit or self.chars > self.limit_chars:
            self._clear()
        index, base = self.index, len(self.index)
        fresh = [u for u in units if u not in index]
        if fresh:
            gc.disable()  # a great many small lists, none of them cyclic
            ids, lengths = self.encode_units([u.decode() for u in fresh])
            gc.enable()
            index.update(zip(fresh, range(base, base + len(fresh))))
            self.starts = np.concatenate([self.starts, (len(self.ids) + np.cumsum(lengths) - lengths).astype(np.int32)])
            self.lengths = np.concatenate([self.lengths, lengths.astype(np.int32)])
            self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
            self.chars += sum(map(len, fresh))
        return np.fromiter(map(index.__getitem__, units), np.int32, len(units))


def flattened(lists: list) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    return (np.concatenate([np.asarray(x, np.int32) for x in lists]) if lists else np.zeros(0, np.int32)), lengths


#: One table per worker process and tokenizer: reused by all its tasks.
_TABLES: dict[tuple, UnitTable] = {}


def library_table(path: str, kind: str) -> UnitTable:
    """The table whose new units the tokenizers library encodes.

    ``kind`` is "word" (lower case, word ends marked) or "byte" (byte-level).
    Single words go to the library many at a time, joined to a text, and the
    ids are cut at the tokens that end (or begin) a word.
    """
    key = ("library", path, kind)
    if key in _TABLES:
        return _TABLES[key]
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    with open(path) as file:
        vocabulary = json.load(file)["model"]["vocab"]
    edge = np.zeros(max(tokenizer.get_vocab_size(), max(vocabulary.values()) + 1), bool)
    edge[[i for token, i in vocabulary.items() if (token.endswith("</w>") if kind == "word" else token.startswith("\u0120"))]] = True

    def separate(units):
        return flattened([e.ids for e in tokenizer.encode_batch_fast(units, add_special_tokens=False)])

    def joined(units):
        glue = " " if kind == "word" else ""
        lists = [glue.join(units[i:i + 256]) for i in range(0, len(units), 256)]
        ids, _ = separate(lists)
        at = np.flatnonzero(edge[ids])
        lengths = np.diff(at, prepend=-1) if kind == "word" else np.diff(at, append=len(ids))
        if len(lengths) != len(units):
            raise ValueError("units and words of the tokenizer differ")
        return ids, lengths

    def encode_units(units):
        if kind == "word":
            units = [u.strip() for u in units]
            words = np.array([u.isalpha() for u in units], bool)
        else:
            words = np.array([u[:1] == " " and u[1:].isalpha() for u in units], bool)
        groups = [[u for u, w in zip(units, words) if w], [u for u, w in zip(units, words) if not w]]
        (a, na), (b, nb) = joined(groups[0]) if groups[0] else flattened([]), separate(groups[1]) if groups[1] else flattened([])
        n = np.zeros(len(units), np.int64)
        n[words], n[~words] = na, nb
        owner = np.repeat(words, n)
        out = np.zeros(len(owner), np.int32)
        out[owner], out[~owner] = a, b
        return out, n

    specials = [token.content for token in tokenizer.get_added_tokens_decoder().values()]
    _TABLES[key] = UnitTable(kind == "word", specials, encode_units, separate, len(edge) - 1,
                             limit=450_000 if kind == "word" else 250_000)
    return _TABLES[key]


def blocks(batches, text_at: int, most_bytes: int = 4_000_000):
    """Slices of Arrow batches with at most ``most_bytes`` of text (or one row)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False)
        piece = (np.cumsum(sizes, dtype=np.int64) - sizes) // most_bytes
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(piece)) + 1, [len(sizes)]]).tolist()
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)
                pa.default_memory_pool().release_unused()
