"""Spelling variants against all pairs of words, with packs of filters of the usual and of the least size."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from spanweave.llm import spelling

COLUMNS = "doc_id long, text string, word string, n int, key string"


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def by_hand(rows):
    counts = Counter()
    for doc, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            crc = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if crc % 199 == 0:
                word = word[: crc % len(word)] + word[crc % len(word) + 1 :]
            counts[word] += 1
    counts = {w: n for w, n in counts.items() if n >= 5 and len(w) >= 6}
    found = {}
    for w, n in counts.items():
        partners = [(-m, v) for v, m in counts.items() if near(w, v)]
        best = min(partners, default=None)
        found[w] = (len(partners), best[1] if best and -best[0] >= 5 * n else None)
    out = []
    for w, n in counts.items():
        root = w
        while found[root][1]:
            root = found[root][1]
        form = found[w][1]
        out.append((w, n, found[w][0], form, counts.get(form), root))
    return sorted(out, key=lambda x: x[0])


def corpus():
    rng = random.Random(5)
    letters = "abcdeéÿÀzÞ"
    stems = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 11))) for _ in range(25)] + ["aaaaaa", "aaaaaaa", "aaaabaa", "short", "shorts"]
    words = []
    for stem in stems:
        words += [stem] * rng.choice([30, 200])
        for _ in range(12):
            at, kind = rng.randrange(len(stem)), rng.randrange(3)
            other = stem[:at] + ("" if kind == 0 else rng.choice(letters)) + stem[at + (kind < 2) :]
            words += [other] * rng.choice([1, 5, 6, 31])
    rng.shuffle(words)
    texts = [" ".join(w.upper() if rng.random() < 0.1 and w.isascii() else w for w in words[i::60]) for i in range(60)]
    long = "q" * 3000 + "w" * 3000
    texts += [f"{long} {long[1:]} {long[:-1] + 'x'}, {long}2{long[:-1] + 'x'}" for _ in range(3)] + [None, "", "no5such-word"]
    return [(i, t, "own", 1, "k") for i, t in enumerate(texts)] + [(None, "aaaaaa shorts", None, None, None)]


@pytest.mark.parametrize("pack", [spelling.PACK_BYTES, 64])
def test_against_all_pairs(spark, pack):
    rows = corpus()
    got = spelling.variants(spark.createDataFrame(rows, COLUMNS).repartition(3), pack).select("word", "n", "n_near", "form", "form_n", "root").collect()
    want = by_hand(rows)
    assert sorted((tuple(r) for r in got), key=lambda x: x[0]) == want
    assert sum(w[3] is not None for w in want) > 20 and any(len(w[0]) > 5000 and w[2] for w in want)


def test_empty_table(spark):
    assert spelling.variants(spark.createDataFrame([], COLUMNS)).count() == 0


def test_edits_have_the_hash_of_their_text():
    word = "abbccé"
    codes = np.array([[ord(c) for c in word]], np.uint32)
    seen = set()
    for length, _, at, letter, key in spelling._edits(codes):
        texts = [word[:p] + (chr(c) if c else "") + word[p + 1 :] for p, c in zip(at, letter)]
        assert (spelling.rolling(texts) == key).all() and {len(t) for t in texts} <= {length}
        seen.update(texts)
    assert {word[:i] + word[i + 1 :] for i in range(len(word))} <= seen and "zbbccé" in seen
