"""Small tables with every awkward row, shared by the tests of this folder."""

from __future__ import annotations

import random

from pyspark.sql import Row

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, spans string, items string, n_words string, key string"
CLASHES = {"score": "own", "spans": "own", "items": "own", "n_words": "own", "key": "own"}


def prose(seed: int, words: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    names = ["".join(random.Random(i).choices("abcdeorstlnäñé", k=2 + i % 7)) for i in range(vocabulary)]
    out = []
    for k in range(words):
        out.append(rng.choice(names) + rng.choice(["", "", "", "", ",", ".", ".\n"]))
        if rng.random() < 0.1:
            out[-1] = out[-1].capitalize()
    return " ".join(out)


def edited(text: str, every: int, word: str = "zzz") -> str:
    words = text.split(" ")
    for k in range(every // 2, len(words), every):
        words[k] = word
    return " ".join(words)


def documents(spark, benchmark: list[str] = ()):
    base, long = prose(1, 120), prose(2, 9000)
    passage = prose(3, 70)
    texts = [
        (1, base), (2, base), (3, edited(base, 60)), (4, edited(base, 4)), (5, None), (6, ""), (7, " \n "), (8, "!!! ??"), (9, "one"), (10, "one"),
        (11, "one two three four"), (12, "one two three four."), (13, long), (14, edited(long, 900)), (15, passage + " " + prose(4, 80)),
        (16, prose(5, 30) + " " + passage), (17, "x" * 900), (18, "ab " * 400), (19, prose(6, 50)), (19, prose(6, 50)), (20, "ünïcödé " * 60),
        (None, prose(7, 60)), (None, None), (21, "日本語 ½ it's <|endoftext|> " * 3), (22, prose(8, 200) + "\n" + prose(8, 200)),
    ]
    texts += [(100 + i, f"{prose(50 + i, 30)} {t.upper() if i % 2 else t}, {prose(90 + i, 30)}") for i, t in enumerate(benchmark)]
    rows = [Row(doc_id=i, text=t, lang=[None, "en", "de"][k % 3], source=None if k % 4 == 0 else "s", n_chars=len(t or "") if k % 5 else None, **CLASHES) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(5), texts


def save(tables: dict, folder) -> str:
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)
