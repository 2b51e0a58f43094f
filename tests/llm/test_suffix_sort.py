"""Deep-shallow sorting against plain sorting, and the repeats it tells against brute force."""

import random

from bagsieve.llm import suffix_sort


def _texts(rng, n):
    base = bytes(rng.choice(b"ab") for _ in range(60))
    out = []
    for _ in range(n):
        s = bytearray(base[: rng.randint(0, 60)] if rng.random() < 0.7 else bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 30))))
        if s and rng.random() < 0.5:
            s[rng.randrange(len(s))] = rng.choice(b"abc")
        out.append(bytes(s))
    return out


def test_order_equals_plain_sorting():
    for seed in range(200):
        rng = random.Random(seed)
        texts = _texts(rng, rng.randint(0, 40))
        for shallow in (0, 8, 48):
            assert [texts[k] for k in suffix_sort.deep_shallow(texts, shallow)] == sorted(texts)


def test_repeated_starts_equal_brute_force():
    for seed in range(300):
        rng = random.Random(seed)
        n = rng.randint(2, 12)
        lefts, rights = _texts(rng, n), [b"xy" + t for t in _texts(rng, n)]
        length = rng.choice([6, 12, 20])
        got = suffix_sort.repeated_starts(lefts, rights, length)
        for k in range(n):
            want = set()
            for j in range(n):
                if j != k:
                    left, right = suffix_sort.common(lefts[k], lefts[j]), suffix_sort.common(rights[k], rights[j])
                    want |= set(range(max(0, length - right), left + 1))
            assert {x for low, high in got[k] for x in range(low, high + 1)} == want, (seed, k)
