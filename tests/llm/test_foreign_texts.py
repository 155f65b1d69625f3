"""Texts in none of the learnt languages leave the pipeline, clean ones stay."""

import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cases import SCHEMA, prose  # noqa: E402

from outlane.llm import language  # noqa: E402


def foreign():
    rng = random.Random(7)
    noise = lambda letters, words, size: " ".join("".join(rng.choices(letters, k=size)) for _ in range(words))
    return {
        "zh": "".join(chr(rng.randrange(0x4e00, 0x6000)) for _ in range(300)),
        "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
        "el": "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα.",
        "consonants": noise("bcdfghjklmnpqrstvwxz", 100, 6),
        "letters": noise("abcdefghijklmnopqrstuvwxyz", 100, 7),
        "hex": noise("0123456789abcdef", 20, 32),
        "symbols": "x " + noise("!@#$%^&*()12345", 20, 10),
    }


@pytest.mark.parametrize("languages", [["en"], ["en", "de", "fr"]])
def test_foreign_and_noise_go(spark, languages):
    import corpus_pipeline

    rng = random.Random(3)
    clean = [(i, prose(rng, languages[i % len(languages)], rng.randint(20, 200)), languages[i % len(languages)], "s", 1) for i in range(400)]
    strange = [(1000 + i, text, None, "s", 1) for i, text in enumerate(foreign().values())]
    got = {r.doc_id for r in corpus_pipeline.language_id(spark, spark.createDataFrame(clean + strange, SCHEMA), "").collect()}
    assert got == {r[0] for r in clean}


def test_whole_norm_counts_all_n_grams(monkeypatch):
    kernel = language.Kernel([b" abc def "])
    text = b" zq" * 40 + b" abc zq "
    known, whole, own = kernel.both([text])
    assert own[0] == len({text[i:i + 3] for i in range(len(text) - 2)}) and 0 < whole[0, 0] < known[0, 0]
    monkeypatch.setattr(language, "_SLICE", 16)
    cut = kernel.both([text, b" abc "])
    assert cut[2][0] == own[0] and abs(cut[1][0, 0] - whole[0, 0]) < 1e-6
