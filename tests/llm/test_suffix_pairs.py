"""Suffix arrays where most groups have two members, as strings and their copies give."""

import random

from jobweave.llm import suffix


def test_pairs_and_what_leaves_them():
    rng = random.Random(3)
    for _ in range(1000):
        part = [rng.randint(2, rng.choice([3, 6, 40])) for _ in range(rng.randint(0, 40))]
        s = [*part, 41, *part[rng.randint(0, 3) :], 42, *(part if rng.random() < 0.3 else []), 1]
        assert suffix.grouping_suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])
