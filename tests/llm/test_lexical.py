"""Ranked search against scores of every document, in plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as driver
from courtside.llm import lexical

DOCS = "doc_id bigint, text string, rank int, score string, _id int, item_id int"
ITEMS = "item_id bigint, text string, doc_id int, _item int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def tables(spark, docs, items, parts=3):
    d = spark.createDataFrame([(i, t, 1, "x", 2, 3) for i, t in docs], DOCS).repartition(parts)
    return d, spark.createDataFrame([(i, t, 1, 2) for i, t in items], ITEMS)


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def expected(docs, items, keep=10):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c, c.total()) for i, c in counted if c]
    many, length = len(counted), sum(n for _, _, n in counted)
    holding = Counter(term for _, c, _ in counted for term in c)
    out = []
    for item, text in items:
        scored = []
        for doc, c, n in counted:
            m = 100 - 90 + (90 * n * many) // length
            score = 0
            for term in set(terms(text)) & set(c):
                w = math.floor(1000 * math.log((2 * many + 2) / (2 * holding[term] + 1)))
                score += w * ((1000000000 * c[term]) // (1000 * c[term] + 8 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank + 1, row[3], -row[0]) for rank, row in enumerate(sorted(scored)[:keep])]
    return sorted(out, key=str)


def found(spark, docs, items, parts=3, **kwargs):
    rows = lexical.search(*tables(spark, docs, items, parts), **kwargs).collect()
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in rows), key=str)


WORDS = ["alpha", "Beta", "ÉTÉ", "été", "x1", "12", "日本", "de", "la", "rare", "q-r", "it's"]
ODD_DOCS = [
    (1, "alpha Beta, alpha"), (1, "alpha Beta, alpha"), (None, "alpha rare"), (None, "alpha rare"), (2, None), (3, ""),
    (4, " \n--- "), (5, "alpha " * 50_000 + "rare"), (6, "ÉTÉ été\x00x1"), (-7, "日本 İ"), (1 << 60, "beta"),
]
ODD_ITEMS = [(1, "Alpha alpha RARE"), (1, "Alpha alpha RARE"), (None, "beta"), (2, None), (3, ""), (4, "nowhere"), (5, "été x1 日本")]


@pytest.mark.parametrize("keep,seeds,block", [(10, 4096, 4 << 20), (2, 1, 8), (1, 3, 1)])
def test_odd_rows(spark, keep, seeds, block):
    got = found(spark, ODD_DOCS, ODD_ITEMS, keep=keep, seeds=seeds, block_bytes=block)
    assert got == expected(ODD_DOCS, ODD_ITEMS, keep)


def test_empty_tables(spark):
    for docs, items in (([], ODD_ITEMS), (ODD_DOCS, []), ([], []), ([(1, None)], ODD_ITEMS), (ODD_DOCS, [(1, "")])):
        out = lexical.search(*tables(spark, docs, items))
        assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.count() == 0


def test_many_documents_with_copies(spark):
    draw = random.Random(7)
    vocabulary = [f"w{int(draw.paretovariate(0.6)) % 400}" for _ in range(3000)]
    docs = [(i, " ".join(draw.choices(vocabulary, k=draw.randint(0, 60)))) for i in range(600)]
    docs += [(1000 + i, docs[17][1]) for i in range(300)]
    draw.shuffle(docs)
    items = [(i, " ".join(draw.choices(vocabulary, k=draw.randint(1, 25)))) for i in range(30)]
    items.append((99, docs[3][1]))
    assert found(spark, docs, items, parts=4, seeds=50) == expected(docs, items)


def test_pruning_loses_no_row():
    """Every row that reaches the bound survives, in buckets of any size and for any bound."""
    draw = np.random.default_rng(3)
    for _ in range(60):
        rows, width = int(draw.integers(1, 40)), 12
        sizes = draw.integers(1, width + 1, size=rows)
        terms = np.concatenate([draw.choice(width, size=s, replace=False) for s in sizes])
        impacts = draw.integers(0, 10 ** int(draw.integers(1, 10)), size=len(terms))
        ends = np.concatenate([[0], np.cumsum(sizes)])
        norms = np.sqrt(np.add.reduceat(impacts.astype(float) ** 2, ends[:-1]))
        order = np.argsort(-norms)
        places = lexical._runs(ends[order], sizes[order])
        bucket = lexical.Bucket(
            list(range(rows)), np.concatenate([[0], np.cumsum(sizes[order])]), terms[places], impacts[places], norms[order], width
        )
        wanted = np.sort(draw.choice(width, size=int(draw.integers(1, width + 1)), replace=False))
        whole = bucket.scores(np.arange(rows), wanted)
        for least in (1, int(whole.max()), int(np.median(whole)), int(whole.max()) + 1):
            if least > 0:
                survivors = bucket.survivors(wanted, least)
                assert set(np.flatnonzero(whole >= least)) <= set(survivors)
                assert [-r[0] for r in bucket.best(wanted, least, 3)] == sorted(whole[whole >= least], reverse=True)[:3]


def test_bounds_prune():
    """A long vector elsewhere doesn't keep short ones: they fall before they are scored."""
    ends = np.arange(0, 401)
    terms, impacts = np.zeros(400, dtype=np.int64), np.full(400, 10)
    terms[0], impacts[0] = 1, 1000
    bucket = lexical.Bucket(list(range(400)), ends, terms, impacts, impacts.astype(float), 2)
    assert bucket.survivors(np.array([0, 1]), 1000).tolist() == [0]
    assert bucket.survivors(np.array([0]), 11).tolist() == []


def test_long_text_in_parts(monkeypatch):
    monkeypatch.setattr(lexical, "_PART", 5)
    text = "Aa bB-cc  dddddddddd é日 1"
    assert [t.decode() for part in lexical.terms_of(text.encode()) for t in part] == terms(text)


def test_text_ids(spark):
    docs = spark.createDataFrame([("b", "x y"), ("a", "x y"), (None, "x y"), ("c", "z")], "doc_id string, text string")
    items = spark.createDataFrame([("i", "X")], "item_id string, text string")
    rows = lexical.search(docs, items).orderBy("rank").collect()
    assert [r.doc_id for r in rows] == ["a", "b", None]


def test_query_on_the_whole_table(spark, folder):
    read = lambda name, key: [tuple(r) for r in spark.read.parquet(f"{folder}/{name}.parquet").select(key, "text").collect()]
    rows = driver.queries()["op11_ranked_search"](spark, folder).collect()
    got = sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in rows), key=str)
    assert got == expected(read("documents", "doc_id"), read("benchmark", "item_id"))
