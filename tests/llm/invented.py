"""Invented prose for the fixtures."""

import random

WORDS = "the of and river stone cloud letter market window garden paper signal bright silver quiet winter harbour engine forest candle".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))
