"""Near-duplicate groups against all pairs of exact shingle sets."""

import random
from itertools import combinations

import corpus_pipeline
import numpy as np
import pytest
from courtside.llm import near


def shingles(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def texts():
    """Texts with copies changed in 0 to 8 places, a shared passage, and a crowd of near copies."""
    chance = random.Random(5)
    word = lambda: f"w{chance.randrange(5000)}"
    passage = [word() for _ in range(30)]
    out = ["", "a b", "a b", "a b c"]
    for length in (12, 60, 100, 300, 1000):
        for _ in range(4):
            base = [word() for _ in range(length)]
            base[5:5] = passage if chance.random() < 0.5 and length >= 60 else []
            for changes in range(9):
                copy = list(base)
                for at in chance.sample(range(len(copy)), changes):
                    copy[at] = word()
                out.append(" ".join(copy))
    crowd = [word() for _ in range(200)]
    for _ in range(60):
        copy = list(crowd)
        for at in chance.sample(range(len(copy)), 3):
            copy[at] = word()
        out.append(" ".join(copy))
    return out


def groups(rows):
    """The smallest id reachable over links of similarity 0.8 or more."""
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, a), (j, b) in combinations(rows, 2):
        if jaccard(a, b) >= 0.8:
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in rows}


@pytest.mark.parametrize("chunk", [None, 4])
def test_groups_are_those_of_all_pairs(spark, monkeypatch, chunk):
    if chunk:
        monkeypatch.setattr(near, "_CHUNK", chunk)
    rows = list(enumerate(texts()))
    random.Random(1).shuffle(rows)
    found = near.jaccard_groups(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {r.doc_id: r.component_id for r in found.collect()} == groups(sorted(rows))


@pytest.mark.parametrize(("changed", "similar"), [(1, 0.97), (6, 0.83), (7, 0.81), (9, 0.75)])
def test_stage_follows_the_similarity(spark, changed, similar):
    words = [f"word{i}" for i in range(329)]
    copy = [f"{w}x" if i % 35 == 20 and i // 35 < changed else w for i, w in enumerate(words)]
    a, b = " ".join(words), " ".join(copy)
    assert jaccard(a, b) == pytest.approx(similar, abs=0.02)
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame([(2, a, "en", "s", 1), (1, b, "en", "s", 1)], schema)
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()
    assert {r.doc_id for r in kept} == ({1} if jaccard(a, b) >= 0.8 else {1, 2})


def test_parity_bits_never_differ_more_than_the_sets(spark):
    chance = random.Random(9)
    pool = [chance.getrandbits(64) for _ in range(400)]
    rows = []
    for size in (0, 1, 5, 63, 64, 65, 120, 129, 256, 300):
        for near_size in (size, int(size * 0.8), min(400, int(size * 1.25))):
            one, two = chance.sample(pool, size), chance.sample(pool, near_size)
            bits = [
                near.parity_bits(np.array(sorted(s), dtype=np.uint64)).view(np.int64).tolist()
                for s in (one, two)
            ]
            rows.append((*bits, len(set(one) ^ set(two)), set(one) == set(two)))
    frame = spark.createDataFrame(rows, "x array<bigint>, y array<bigint>, apart int, same boolean")
    found = frame.select(near._differing("x", "y").alias("bits"), "apart", "same").collect()
    assert len(found) == len(rows)
    assert all(r.bits <= r.apart for r in found)
    assert any(r.bits > 20 for r in found)
