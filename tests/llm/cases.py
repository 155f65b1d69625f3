"""Small documents with the awkward cases, and brute-force helpers."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SYLLABLES = {"en": ["th", "er", "ing", "on", "and", "sh"], "de": ["sch", "ung", "keit", "ein", "\u00fc", "\u00df"], "fr": ["eau", "oi", "tion", "\u00e9", "\u00e8", "que"]}


def prose(rng, lang, words):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(words))


def documents(seed=3, n=90):
    """Prose of three languages, copies, near copies, null and empty texts, odd
    characters, one very long text, and rows that repeat an id."""
    rng, out = random.Random(seed), []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        lines = [prose(rng, lang, rng.randint(3, 30)) for _ in range(rng.randint(1, 6))]
        if i % 3 == 0:
            lines.insert(rng.randint(0, len(lines)), "Subscribe to our news.")
        out.append((i, "\n".join(lines), lang, f"src{i % 4}", 1))
    text = out[10][1]
    words = text.split(" ")
    near = " ".join([*words[:-1], "other"])
    odd = ["", None, "  \n\t ", "a", "A", "12 + 34 = 46 !", "<|endoftext|>", "x<|startoftext|>y  z", "it's 'tis I'LL don't\n\n\n  we've", "caf\u00e9 cafe\u0301 \u0130\u03a3\u03c2 \u65e5\u672c\u8a9e \U0001f600", "a\u00a0b\u2003c\x1cd\x0be",
           "\x00\x01 nul", "aaaaaaaaaaaaaaaa aaa", "tab\t\ttab \r\n line", text, text.upper(), near, "very " * 30000 + "long", "y" * 5000, "subscribe to our news.", "\n\n"]
    out += [(1000 + i, x, None, None if i % 2 else "src0", None) for i, x in enumerate(odd)]
    out += [(None, text, "en", "src1", 2), (5, out[5][1], "en", "src1", 3), (5, out[5][1], "en", "src1", 3)]
    return out


def frame(spark, rows=None):
    """With extra columns whose names the operators use themselves."""
    df = spark.createDataFrame(documents() if rows is None else rows, SCHEMA)
    return df.selectExpr("*", "'x' AS id", "1 AS n", "'q' AS queue", "2 AS ids", "'c' AS component", "3 AS sha", "'s' AS site", "4 AS fp", "5 AS lines_dropped").repartition(3)


class Sets:
    """Union-find with the least member as the name."""

    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
