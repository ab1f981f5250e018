"""Texts for the tests of this folder."""

import random

WORDS = "river stone garden window market letter silver winter music forest bridge candle orange travel summer hammer".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Rows that every operator must take: nulls, empty and odd texts, repeated rows.
ODD = [(None, None), (None, "x y z"), (900, None), (901, ""), (902, " \n\t "), (903, "é 😀  "), (904, "a"), (904, "a"), (905, "ab" * 4000), (906, "same id one"), (906, "same id two")]


def prose(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return [rng.choice(WORDS) + str(rng.randint(0, 9999)) for _ in range(n)]
