"""Whole documents in few sequences: ids against the tokenizer, sequences against the bound."""

import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as driver
from courtside.llm import bestfit, words
from courtside.llm.queries import WORD_TOKENIZER, tokenizer_path
from courtside.llm.words import WordEncoder

DOCS = "doc_id bigint, text string, ids string, sequence_id int, piece string, leftover int"
PATH = tokenizer_path(WORD_TOKENIZER)
LONG = "Words, of many kinds. And sizes " * 3000
ODD = [
    (1, "a b c"), (1, "a b c"), (None, "no id"), (2, None), (3, ""), (4, " \n\t "), (5, LONG),
    (1 << 60, "large"), (-3, "İ, ΑΣ. <|endoftext|> <|EndOfText|> don't... é ́"), (6, "x" * 9000),
]


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "x", 5, "y", 1) for i, t in rows], DOCS)


def encoded(text):
    return [*WordEncoder.of(PATH).tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def check(rows, docs, size):
    """Every document's ids once, in pieces of ``size``; sequences gapless. Their number."""
    want = sorted((str(i), tuple(encoded(t))) for i, t in docs)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for row in rows:
        ids = np.frombuffer(bytes(row.ids), "<u4").tolist()
        assert len(ids) == row.length and row.start == row.piece * size
        pieces[row.doc_id].append((row.piece, ids))
        sequences[row.sequence_id].append((row.offset, row.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    got = []
    for doc, parts in pieces.items():
        starts = sum(piece == 0 for piece, _ in parts)
        # Repeated documents here are equal, so their pieces may be told apart in any way.
        for copy in range(starts):
            mine = sorted(parts, key=lambda p: p[0])[copy::starts]
            assert [p for p, _ in mine] == list(range(len(mine)))
            assert all(len(ids) == size for _, ids in mine[:-1])
            got.append((str(doc), tuple(i for _, ids in mine for i in ids)))
    assert sorted(got) == want
    return len(sequences)


@pytest.mark.parametrize("size,slots", [(16, 1), (64, 2), (64, 512), (2048, 8)])
def test_odd_rows(spark, size, slots):
    rows = bestfit.best_fit(documents(spark, ODD), PATH, size=size, slots=slots).collect()
    check(rows, ODD, size)


def test_empty_table(spark):
    assert bestfit.best_fit(documents(spark, []), PATH).count() == 0


def test_other_columns_and_partitions(spark):
    docs = documents(spark, ODD).withColumnsRenamed({"doc_id": "_to", "text": "length"}).repartition(5)
    packed = bestfit.best_fit(docs, PATH, size=64, merge_partitions=2, id_column="_to", text_column="length")
    check(packed.collect(), ODD, 64)


def test_whole_table_takes_few_sequences(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    rows = bestfit.best_fit(docs, PATH).collect()
    sequences = check(rows, [tuple(r) for r in docs.collect()], 2048)
    least = -(-sum(r.length for r in rows) // 2048)
    assert sequences <= 1.02 * least + 1


def test_query_gives_the_checksums(spark, folder):
    import zlib

    rows = driver.queries()["op12_best_fit_packing"](spark, folder).collect()
    docs = dict(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect())
    for row in rows:
        ids = np.array(encoded(docs[row.doc_id])[row.start : row.start + row.length], dtype="<u4")
        assert row.ids_crc32 == zlib.crc32(ids.tobytes())


def test_bins_take_the_tightest_and_close_the_fullest():
    bins = bestfit.Bins(10, 2)
    assert bins.place(6) == (0, 0, [])
    assert bins.place(5) == (1, 0, [])
    assert bins.place(4) == (0, 6, [0])
    assert bins.place(2) == (1, 5, [])
    assert bins.place(9) == (2, 0, [])
    assert bins.place(8) == (3, 0, [2])
    assert bins.place(2) == (3, 8, [3])


@pytest.mark.parametrize("slots", [1, 3, 1000])
def test_bins_equal_a_search_over_all_open_bins(slots):
    draw, bins, open_bins, made = random.Random(slots), bestfit.Bins(50, slots), {}, 0
    for _ in range(3000):
        length = draw.randint(1, 50)
        number, offset, closed = bins.place(length)
        fitting = [room for room in open_bins.values() if room >= length]
        if fitting:
            assert open_bins[number] == min(fitting) == 50 - offset
        else:
            assert (number, offset) == (made, 0)
            made += 1
            if len(open_bins) == slots:
                fullest = min(open_bins.values())
                assert open_bins.pop(closed[0]) == fullest
        open_bins[number] = 50 - offset - length
        if not open_bins[number]:
            assert closed[-1] == number
            del open_bins[number]


ALPHABET = "aAbBzZ.,'’sStTéÉΣİßŉ \n\t ́\x1c<|>12٣😀日"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from(ALPHABET), max_size=60) | st.text(max_size=30), max_size=12))
def test_encoder_equals_the_tokenizer(texts):
    encoder = WordEncoder.of(PATH)
    assert [(n, ids.tolist()) for n, ids in encoder.encode(texts)] == [
        (n, encoded(t)[:-1]) for n, t in enumerate(texts)
    ]


def test_small_memory_and_long_texts(monkeypatch):
    monkeypatch.setattr(words, "_SLICE", 400)
    encoder = WordEncoder(PATH, memory=20)
    draw = random.Random(3)
    texts = [" ".join(draw.choices(["One", "two,", "three.", "x" * 300, "é\n"], k=n)) for n in (1, 5, 90, 2, 400)]
    for n, ids in encoder.encode(texts):
        assert ids.tolist() == encoded(texts[n])[:-1]


def test_vocabulary_with_white_space_is_encoded_whole():
    encoder = WordEncoder(tokenizer_path())
    assert not encoder.by_words
    (found,) = encoder.encode([" Two words, "])
    assert found[1].tolist() == encoder.tokenizer.encode(" Two words, ").ids
