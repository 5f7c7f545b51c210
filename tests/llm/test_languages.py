"""The language network's sample and its averages over windows."""

from __future__ import annotations

import zlib

import numpy as np

from tidemark.llm import language_id


def test_every_language_is_learned(spark, monkeypatch):
    """Languages of one row, of many rows under one id, and of copies of one row; none crowds another out."""
    seen = []
    monkeypatch.setattr(language_id, "train", lambda samples, **_: seen.extend(samples))
    free = [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2]
    held = next(i for i in range(40) if zlib.crc32(str(i).encode()) % 4 == 2)
    rows = [(free[0], f"text number {i}", "aa") for i in range(20_000)] + [(free[1], "the same text", "bb")] * 5000
    rows += [(i, f"wort {i}", "bb") for i in free[2:6]] + [(free[7], "única", "cc"), (held, "held out", "dd"), (free[8], "123", "ee"), (free[9], None, "ff"), (None, "no id", "gg"), (free[9], "no language", None)]
    language_id.train_language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4), per_language=50)
    found = {}
    for lang, part in seen:
        found.setdefault(lang, []).append(part)
    assert {lang: len(parts) for lang, parts in found.items()} == {"aa": 50, "bb": 5, "cc": 1}
    assert len(set(found["aa"])) == 50 and len(set(found["bb"])) == 5
    again = []
    monkeypatch.setattr(language_id, "train", lambda samples, **_: again.extend(samples))
    language_id.train_language_id(spark.createDataFrame(rows[::-1], "doc_id long, text string, lang string").repartition(7), per_language=50)
    assert again == seen


def test_a_text_has_the_mean_of_its_windows():
    model = language_id.train([("a", b"the cat " * 40), ("b", b"zwx qkj " * 40)] * 3, length=32, rounds=40)
    texts = ["the cat sat zwx " * 20, "zwx", "qkj zwx the " * 9, "é the cat ü " * 30]
    tables = model.tables()
    for (lang, p), text in zip(language_id.predict(model, texts, tables, together=3), texts, strict=True):
        odds = [model.log_odds(w[None], tables)[0] for w in language_id.windows(text.encode(), model.length)]
        mean = np.mean(odds, axis=0)
        chance = np.exp(mean) / np.exp(mean).sum()
        assert lang == model.languages[int(chance.argmax())] and abs(p - chance.max()) < 1e-6
