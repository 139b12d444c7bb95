"""Documents with every hard case, and extra columns whose names the operators use for their own."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, score string, keep_id string, hub string, start string, words string, sig string"


def prose(rnd: random.Random, n: int) -> str:
    return " ".join("".join(rnd.choice(["tion", "the", "an", "ing", "é", "st", "q"]) for _ in range(rnd.randint(1, 3))) for _ in range(n))


def rows(seed: int = 1) -> list[tuple]:
    rnd = random.Random(seed)
    base = [prose(rnd, rnd.randint(60, 120)) for _ in range(12)]
    texts: list[tuple] = [(i, t) for i, t in enumerate(base)]
    texts += [(20, base[0]), (21, base[0] + "  \n"), (22, base[0].replace(" ", "\t")), (23, base[1].upper())]
    for i, b in enumerate(base[2:6]):  # near copies
        words = b.split()
        words[len(words) // 2] = "changed"
        texts.append((30 + i, " ".join(words)))
    shared = prose(rnd, 70)
    texts += [(40 + i, prose(rnd, 40) + "\n" + shared + "\n" + prose(rnd, 40)) for i in range(4)]
    texts += [(50, None), (51, ""), (52, " \n\t "), (53, "one"), (54, "one two three four"), (55, "One two  three four"), (56, "a b c d e"), (57, "x" * 5000), (58, "word " * 400), (59, "été\u00a0 naïve ☃ \U0001f600 don't <|endoftext|> 's"), (60, prose(rnd, 6000))]
    texts += [(None, base[0]), (None, None), (3, base[3]), (3, base[3]), (4, "another text with the same number as one before it")]
    return [(i, t, "en" if (i or 0) % 2 else None, None if (i or 0) % 3 else "src0", None, *["other"] * 7) for i, t in texts]


def documents(spark, seed: int = 1):
    return spark.createDataFrame(rows(seed), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
