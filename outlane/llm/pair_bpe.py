"""Byte-pair encoding with a pair occurrence index.

The distinct words of a block are one array of symbols.  Every pair that has a
rank is indexed by it with all its positions in the block.  Ranks are applied
in ascending order: a rank's positions are merged at once, left to right, and
only the pairs beside them enter or leave the lists.  A merge makes a symbol
whose own merges all have higher ranks, so no earlier rank comes back; the
vocabulary is checked for that.
"""

from __future__ import annotations

import heapq
import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outlane.llm.tokens import UnitTable, blocks

#: How the word vocabulary cuts text before merges, and the
#: characters that stand for the bytes without a printable one.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
WORD_END = "</w>"
_NONE = np.int32(2**31 - 1)


def byte_letters() -> dict[int, str]:
    """Byte -> the character that stands for it in the vocabulary."""
    other = iter(range(256, 512))
    printable = set(PRINTABLE)
    return {b: chr(b if b in printable else next(other)) for b in range(256)}


class PairIndexBpe:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)  # normalises and cuts unusual texts
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, vocab = spec["model"], spec["model"]["vocab"]
        if model["end_of_word_suffix"] != WORD_END or model["dropout"] or spec["decoder"]:
            raise ValueError("not a vocabulary of words with marked ends")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["normalized"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("special tokens must match as they are")
        letters = byte_letters()
        self.bytes_of = {letter: byte for byte, letter in letters.items()}
        self.plain = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[letters[b] + WORD_END] for b in range(256)], np.int32)
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        born = np.full(self.size, -1)
        born[self.made] = np.arange(len(pairs))
        if len(set(self.made.tolist())) < len(pairs) or (np.maximum(born[self.left], born[self.right]) >= np.arange(len(pairs))).any():
            raise ValueError("a merge comes before what it is made of")
        keys = self.left * self.size + self.right
        self.order = np.argsort(keys).astype(np.int32)
        self.keys = keys[self.order]
        names = {i: token for token, i in vocab.items()} | {i: token for token, i in self.special.items()}
        self.names = [names.get(i, "") for i in range(self.size)]

    # -- merges ------------------------------------------------------------------
    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], _NONE)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids of each word)."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(sizes)
        symbol = self.plain[data]
        symbol[ends - 1] = self.last[data[ends - 1]]
        n = len(symbol)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        after[ends - 1] = -1
        before[ends - sizes] = -1
        alive = np.ones(n, bool)
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def enter(at: np.ndarray) -> None:
            rank = self._ranks(symbol[at], symbol[after[at]])
            there = rank != _NONE
            at, rank = at[there], rank[there]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for r, part in zip(rank[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts)):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(queue, r)

        enter(np.flatnonzero(after >= 0).astype(np.int32))
        while queue:
            rank = heapq.heappop(queue)
            lists = index.pop(rank)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            a, b = self.left[rank], self.right[rank]
            follow = after[at]
            good = alive[at] & (symbol[at] == a) & (follow >= 0) & (symbol[follow] == b)
            if not good.all():
                at, follow = at[good], follow[good]
            if a == b and len(at) > 1:  # in a run of the same symbol, every second position
                head = np.concatenate([[True], at[1:] != follow[:-1]])
                place = np.arange(len(at)) - np.flatnonzero(head)[np.cumsum(head) - 1]
                at, follow = at[place % 2 == 0], follow[place % 2 == 0]
            if not len(at):
                continue
            symbol[at] = self.made[rank]
            alive[follow] = False
            beyond = after[follow]
            after[at] = beyond
            right = beyond >= 0
            before[beyond[right]] = at[right]
            prior = before[at]
            changed = np.concatenate([prior[prior >= 0], at[right]])
            if len(changed):
                enter(np.unique(changed))
        counts = np.add.reduceat(alive, ends - sizes, dtype=np.int64) if len(words) else np.zeros(0, np.int64)
        return symbol[alive], counts

    # -- units and whole texts -------------------------------------------------------
    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Units are lower-case, after white space; a unit may be several words, or none."""
        words, counts = [], np.ones(len(units), np.int64)
        for i, unit in enumerate(units):
            unit = unit.strip()
            if unit.isalpha():
                words.append(unit.encode())
            else:
                parts = WORDS.findall(unit)
                words += [p.encode() for p in parts]
                counts[i] = len(parts)
        return self._summed(words, counts)

    def _summed(self, words, counts):
        ids, sizes = self.encode_words(words)
        edge = np.concatenate([[0], np.cumsum(sizes)])
        return ids, np.diff(edge[np.concatenate([[0], np.cumsum(counts)])])

    def encode_whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Texts with special tokens or characters that are cut by the library's
        own normaliser and pre-tokeniser; the merges are the same."""
        splitter = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        words, counts, marks = [], [], []
        for text in texts:
            before = len(words)
            for part in splitter.split(text):
                if part in self.special:
                    marks.append((len(words), self.special[part]))
                    words.append(b" ")  # its place; replaced below
                elif part:
                    cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))
                    words += [bytes(map(self.bytes_of.__getitem__, word)) for word, _ in cut]
            counts.append(len(words) - before)
        ids, sizes = self.encode_words(words)
        edge = np.concatenate([[0], np.cumsum(sizes)])
        drop = np.zeros(len(ids), bool)
        for at, special in marks:
            ids[edge[at]] = special
            drop[edge[at] + 1:edge[at + 1]] = True
            sizes[at] = 1
        edge = np.concatenate([[0], np.cumsum(sizes)])
        return ids[~drop], np.diff(edge[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)])

    def decode(self, ids: np.ndarray) -> str:
        """Without a decoder in the file, tokens are joined by blanks."""
        return " ".join(map(self.names.__getitem__, ids.tolist()))


_MADE: dict[str, tuple[PairIndexBpe, UnitTable]] = {}


def encoder(path: str) -> tuple[PairIndexBpe, UnitTable]:
    """One encoder and table of words per worker process and file."""
    if path not in _MADE:
        bpe = PairIndexBpe(path)
        _MADE[path] = bpe, UnitTable(True, list(bpe.special), bpe.encode_units, bpe.encode_whole)
    return _MADE[path]


def coded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_tokens, ids (unsigned 32-bit, little-endian)
    and the text decoded from them.

    Whole texts, without special tokens added, cut or padded; a special token's
    string in a text is that token.  A null text is empty: no ids and an empty
    decoded text.  Ids may be null or repeat; an empty table gives no rows;
    other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        bpe, table = encoder(path)
        for batch in blocks(batches, 1, 16_000_000):
            ids, counts = table.encode(batch.column(1))
            edge = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
            for s in range(0, len(counts), 1024):  # small batches leave at a time
                e = min(s + 1024, len(counts))
                own = ids[edge[s]:edge[e]].astype("<u4")
                cut = (edge[s:e + 1] - edge[s])
                data = pa.Array.from_buffers(pa.large_binary(), e - s, [None, pa.py_buffer(cut * 4), pa.py_buffer(own)]).cast(pa.binary())
                text = [bpe.decode(own[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s, e - s), pa.array(counts[s:e], pa.int64()), data, pa.array(text, pa.string())], names=["id", "n_tokens", "ids", "decoded"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"id {kind}, n_tokens long, ids binary, decoded string")
