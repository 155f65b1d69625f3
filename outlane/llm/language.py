"""Language identification with string kernels.

Two texts are compared by the n-grams of bytes that both contain (presence, not
frequency), blended over n = 1, 2, 3: k(x, z) = mean over n of |x_n and z_n| /
sqrt(|x_n| |z_n|).  Nystroem: kernel values with a few landmark texts, whitened,
are the features; one ridge regression per language (one versus the rest) is
fitted on them.  Only n-grams that landmarks have can be shared, so the kernel
values of a block of texts are products of presence matrices over those, divided
by the root of the number of all n-grams of each text.

A classifier that only compares its languages must name one for any text.  So a
text's norm in the space of the landmarks is taken too: 1 if the landmarks explain it whole, near 0 in an unknown
script.  Labelled rows of like size tell how low it is in the languages learnt; a
text well below that keeps its label but has score 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The labelled sample that the classifier is fitted on: expected rows and bytes in
#: all, shared out equally, but ``LEAST_EACH`` rows of each language.
SAMPLE_ROWS = 3000
SAMPLE_BYTES = 64 << 20
LEAST_EACH = 10
LANDMARKS = 160
RIDGE = 1e-3
ORDERS = (1, 2, 3)
#: Labelled rows nearest in size whose norms, at this quantile and times this
#: part of it, are the least that a text of a learnt language has.
LIKE_ROWS, LOW, PART = 100, 0.02, 0.75
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
#: A-Z to a-z; digits, punctuation and white space to a blank.
_FOLD = bytes(i + 32 if 65 <= i <= 90 else i if 97 <= i <= 122 or i >= 128 else 32 for i in range(256))
_SLICE = 1 << 21


def folded(text: str | None) -> bytes:
    """Bytes that n-grams are taken from: the text between blanks, runs of
    other than letters as one blank."""
    return b" " + b" ".join((text or "").lower().encode("utf-8", "replace").translate(_FOLD).split()) + b" "


def codes(data: np.ndarray, n: int) -> np.ndarray:
    out = data[:len(data) - n + 1].astype(np.int32)
    for k in range(1, n):
        out = (out << 8) | data[k:len(data) - n + 1 + k]
    return out


class Kernel:
    """n-gram presence against the landmarks."""

    def __init__(self, landmarks: list[bytes]):
        self.tables, self.grams, self.products = [], [], []
        for n in ORDERS:
            own = [np.unique(codes(np.frombuffer(x, np.uint8), n)) for x in landmarks]
            grams = np.unique(np.concatenate(own)) if own else np.zeros(0, np.int32)
            there = np.zeros((len(grams) + 1, len(landmarks)), np.float32)
            for j, x in enumerate(own):
                there[1 + np.searchsorted(grams, x), j] = 1
            there /= np.sqrt(np.maximum(there.sum(axis=0), 1))
            self.grams.append(grams)
            self.products.append(there)

    def _table(self, i: int) -> np.ndarray:
        """n-gram code -> its row, 0 if no landmark has it; made once a process."""
        if len(self.tables) <= i:
            table = np.zeros(1 << (8 * ORDERS[i]), np.uint32 if len(self.grams[i]) > 65534 else np.uint16)
            table[self.grams[i]] = np.arange(1, len(self.grams[i]) + 1)
            self.tables.append(table)
        return self.tables[i]

    def __getstate__(self):
        return {"grams": self.grams, "products": self.products, "tables": []}

    def values(self, texts: list[bytes]) -> np.ndarray:
        """[text, landmark] kernel values of a block of texts."""
        return self.both(texts)[0]

    def both(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Kernel values over the n-grams that landmarks have, the same over all
        n-grams of the text, and its number of distinct n-grams of the last order."""
        out = np.zeros((len(texts), self.products[0].shape[1]), np.float32)
        whole, own = np.zeros_like(out), np.zeros(len(texts))
        for i, n in enumerate(ORDERS):
            table = self._table(i)
            there, strange = np.zeros((len(texts), len(self.grams[i]) + 1), np.float32), [np.zeros(0, np.int64)]
            for data, row in _slices(texts, n):
                code = codes(data, n)
                found, row = table[code], row[:len(code)]
                there[row, found] = 1
                at = np.flatnonzero(found == 0)
                inside = np.ones(len(at), bool)  # not over the end of a text
                for k in range(n):
                    inside &= data[at + k] > 0
                at = at[inside]
                strange.append(np.unique(row[at].astype(np.int64) << 24 | code[at]))
            there[:, 0] = 0
            sizes = there.sum(axis=1, keepdims=True)
            own = sizes[:, 0] + np.bincount(np.unique(np.concatenate(strange)) >> 24, minlength=len(texts))
            shared = there @ self.products[i]
            out += shared / np.sqrt(np.maximum(sizes, 1))
            whole += shared / np.sqrt(np.maximum(own, 1))[:, None]
        return out / len(ORDERS), whole / len(ORDERS), own


def _slices(texts: list[bytes], n: int):
    """Bytes of the texts in slices of bounded size, with the row of each byte.

    Two zero bytes stand between texts; no landmark n-gram has one.
    """
    rows, parts, size = [], [], 0
    for r, text in enumerate(texts):
        for a in range(0, max(len(text) - n + 1, 1), _SLICE):
            piece = text[a:a + _SLICE + n - 1] + b"\0\0"
            parts.append(piece)
            rows.append(r)
            size += len(piece)
            if size >= _SLICE:
                yield np.frombuffer(b"".join(parts), np.uint8), np.repeat(rows, [len(p) for p in parts])
                rows, parts, size = [], [], 0
    if parts:
        yield np.frombuffer(b"".join(parts), np.uint8), np.repeat(rows, [len(p) for p in parts])


class Model:
    """Nystroem features and one ridge regression per language."""

    def __init__(self, texts: list[bytes], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE):
        self.names = sorted(set(labels))
        if not self.names:
            return
        labels = np.array(labels)
        chosen: list[int] = []
        for name in self.names:  # texts of middling length, as many of each language
            own = np.flatnonzero(labels == name)
            sizes = np.array([len(texts[i]) for i in own])
            middle = np.abs(np.log(np.maximum(sizes, 1)) - np.log(max(np.median(sizes), 400)))
            chosen += own[np.argsort(middle, kind="stable")[:max(1, landmarks // len(self.names))]].tolist()
        self.kernel = Kernel([texts[i] for i in sorted(chosen)])
        base = self.kernel.values([texts[i] for i in sorted(chosen)]).astype(np.float64)
        size, turn = np.linalg.eigh((base + base.T) / 2)
        keep = size > 1e-6 * size.max()
        self.white = turn[:, keep] / np.sqrt(size[keep])
        parts = [self.placed(texts[i:i + 256]) for i in range(0, len(texts), 256)]
        rows, norms, own = (np.concatenate(x) for x in zip(*parts))
        # a landmark's norm is that by the other landmarks
        norms[sorted(chosen)] = 1 - 1 / np.diag(np.linalg.inv((base + base.T) / 2 + 1e-6 * np.eye(len(base))))
        self._learn_floor(norms, own)
        goal = np.where(labels[:, None] == np.array(self.names)[None, :], 1.0, -1.0)
        weight = 1 / np.sqrt(np.array([(labels == x).sum() for x in labels]))[:, None]  # rare languages count
        left = rows * weight
        gram = left.T @ left
        self.beta = np.linalg.solve(gram + ridge * np.trace(gram) / len(gram) * np.eye(len(gram)), left.T @ (goal * weight))

    def placed(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features, squared norm in the landmarks' space and size of each text."""
        _, whole, own = self.kernel.both(texts)
        rows = whole @ self.white
        return np.column_stack([rows, np.ones(len(texts))]), (rows ** 2).sum(axis=1), own

    def features(self, texts: list[bytes]) -> np.ndarray:
        return self.placed(texts)[0]

    def _learn_floor(self, norms: np.ndarray, own: np.ndarray) -> None:
        order = np.argsort(own, kind="stable")
        norms, own = norms[order], own[order]
        n = min(LIKE_ROWS, len(norms))
        low = np.quantile(np.lib.stride_tricks.sliding_window_view(norms, n), LOW, axis=1)
        middle = np.sort(np.lib.stride_tricks.sliding_window_view(np.log1p(own), n), axis=1)[:, n // 2]
        self.sizes, first = np.unique(middle, return_index=True)
        self.floors = PART * np.maximum(low[first], 0)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; the score is a softmax of margins,
        or 0 if the text is less like the labelled rows than any of them."""
        known = [bool(self.names) and x is not None and bool(_LETTER.search(x)) for x in texts]
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        at = [i for i, k in enumerate(known) if k]
        for i in range(0, len(at), 128):
            block = at[i:i + 128]
            rows, norms, own = self.placed([folded(texts[j]) for j in block])
            margins, like = rows @ self.beta, norms >= np.interp(np.log1p(own), self.sizes, self.floors)
            power = np.exp(4 * (margins - margins.max(axis=1, keepdims=True)))
            best = margins.argmax(axis=1)
            for j, b, s in zip(block, best.tolist(), like / power.sum(axis=1)):
                names[j], scores[j] = self.names[b], s
        return names, scores


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit on a bounded sample of the labelled rows, as many of each language.

    A row is taken if a hash of its id is under the language's rate, so the
    sample does not depend on partitions.  Expected are ``sample_rows`` rows and
    ``sample_bytes`` bytes of whole texts in all; every language has the row with
    its least hash at least, and ``LEAST_EACH`` rows if their bytes allow it.  The
    draw alone leaves the executors.
    """
    rows = docs.filter(F.col(label_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    draw = F.pmod(F.xxhash64(F.lit("language"), F.col(id_col)), F.lit(1 << 30))
    rows = rows.select(F.col(label_col).alias("label"), F.col(text_col).alias("text"), F.col(id_col).alias("id"), draw.alias("draw"))
    # one row per language
    sizes = rows.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"), F.min("draw").alias("least")).collect()
    each, limits = max(LEAST_EACH, sample_rows / max(len(sizes), 1)), []
    for r in sizes:
        rate = min(1.0, each / r.n, sample_bytes / len(sizes) / max(r.bytes, 1))
        limits.append((r.label, max(int(rate * (1 << 30)), r.least + 1)))
    if not limits:
        return Model([], [])
    # as many rows as the model has languages: the texts stay where they are
    taken = rows.join(F.broadcast(docs.sparkSession.createDataFrame(limits, "label string, limit long")), "label").filter("draw < limit")
    got = taken.select("label", "text", "id").toPandas().sort_values(["label", "id"], kind="stable")
    return Model([folded(x) for x in got["text"]], got["label"].tolist())


def identified(docs: DataFrame, model: Model, text_col: str = "text", to: str = "language") -> DataFrame:
    """``docs`` with a struct column ``to`` (pred string, score double).

    Whole texts are scored in blocks.  A null text, or one without a letter,
    is ``und`` with score 0, and so is every text if no labelled row was there
    to learn from.  A text in none of the languages has the label of the nearest
    one and score 0.  Rows, order and other columns are unchanged; an empty table
    gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("pred string, score double")
    def score(texts: pd.Series) -> pd.DataFrame:
        names, scores = shared.value.predict([x if isinstance(x, str) else None for x in texts])
        return pd.DataFrame({"pred": names, "score": scores})

    return docs.withColumn(to, score(F.col(text_col)))
