"""Packing, chat formatting, decontamination, quality and URL operators on odd rows."""

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from courtside.llm import chat, decontaminate, packing, quality, urls
from courtside.llm.queries import tokenizer_path
from courtside.llm.tokens import Encoder

DOCS = "doc_id bigint, text string, ids string, sequence_id int, _text string"
LONG = "words of many kinds and sizes " * 4000


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "x", 5, "y") for i, t in rows], DOCS)


ODD = [(1, "a b c"), (1, "a b c"), (None, "no id"), (2, None), (3, ""), (4, " \n\t "), (5, LONG), (1 << 60, "large")]


class TestPacking:
    def test_every_id_lies_in_one_piece(self, spark):
        rows = packing.pack(documents(spark, ODD), tokenizer_path(), size=64, slots=2).collect()
        encoder = Encoder(tokenizer_path())
        want = defaultdict(int)
        for doc, text in ODD:
            want[doc] += len(encoder.tokenizer.encode(text or "", add_special_tokens=False).ids) + 1
        got = defaultdict(int)
        for row in rows:
            got[row.doc_id] += row.length
            assert len(row.ids) == 4 * row.length
        assert got == want

    def test_sequences_are_gapless_and_full(self, spark):
        rows = packing.pack(documents(spark, ODD), tokenizer_path(), size=64, slots=2, top_up=4).collect()
        sequences = defaultdict(list)
        for row in rows:
            sequences[row.sequence_id].append((row.offset, row.length))
        short = 0
        for parts in sequences.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 64
            short += at < 60
        assert short <= 1

    def test_empty_table(self, spark):
        assert packing.pack(documents(spark, []), tokenizer_path()).count() == 0

    @pytest.mark.parametrize("size,slots,top_up", [(8, 1, 1), (16, 3, 4), (32, 8, 32)])
    def test_windows_keep_all(self, size, slots, top_up):
        draw = np.random.default_rng(size)
        windows, out, total = packing.Windows(size, slots, top_up), [], 0
        for doc in range(200):
            ids = np.arange(draw.integers(1, 3 * size), dtype="<u4")
            total += len(ids)
            out += list(windows.add(doc, ids))
            assert len(windows.open) <= slots
        whole, rest = windows.merge()
        placed = sum(len(ids) for pieces in [*out, *whole, rest] for _, _, ids, _ in pieces)
        assert placed == total
        assert all(sum(len(i) for _, _, i, _ in p) == size for p in whole)

    @pytest.mark.parametrize(
        "text",
        ["a b", "a  b", " a", "a ", "a\nb c", "a\n\nb", "a \nb", "a\tb  c", "x<|endoftext|> y", "é 中 😀", "\n"],
    )
    def test_pieces_do_not_change_ids(self, text):
        encoder = Encoder(tokenizer_path(), memory=2)
        want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        for _ in range(2):
            assert encoder.encode(text, 1).tolist() == [*want, 1]


    def test_words_of_many_texts_are_encoded_once(self, monkeypatch):
        encoder, given = Encoder(tokenizer_path()), []
        whole = encoder._whole
        monkeypatch.setattr(encoder, "_whole", lambda text: given.append(text) or whole(text))
        texts = [f"{first} lorem, ipsum.\n{first} dolor, lorem ipsum, dolor." for first in "abcdefgh" * 50]
        texts += [None, "", "'s it's\nx", "a\u0300, b\u0300.", "ipsum  lorem.", "lorem.,. ipsum,,"]
        got = list(encoder.encode_all(pa.array(texts, pa.string()), 1))
        want = encoder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
        assert [ids.tolist() for ids in got] == [[*w.ids, 1] for w in want]
        assert sum(map(len, given)) < 300

    def test_a_small_memory_changes_no_ids(self):
        encoder = Encoder(tokenizer_path(), memory=8)
        texts = [f"w{i % 13} x{i % 7}, \u00e9{i}.\ny" if i % 5 else f"w{i}\t{i}" for i in range(60)]
        want = encoder.tokenizer.encode_batch(texts, add_special_tokens=False)
        for at in range(0, 60, 10):
            got = list(encoder.encode_all(pa.array(texts[at : at + 10]), 1))
            assert [ids.tolist() for ids in got] == [[*w.ids, 1] for w in want[at : at + 10]]
            assert len(encoder.pieces) <= 8 + 60


class TestChat:
    ROWS = [
        (1, 0, "system", "s"),
        (1, 1, "user", "</s>[INST] <|user|> \\ | ["),
        (1, 2, "assistant", "one\ntwo"),
        (1, 3, "user", None),
        (1, 4, "assistant", ""),
        (2, 0, "user", "no reply"),
        (3, 0, "assistant", "first"),
        (3, 1, None, "no role"),
        (None, 0, "assistant", "no id"),
        (4, None, "user", "b"),
        (4, None, "user", "b"),
    ]

    def examples(self, spark, rows):
        schema = "conv_id bigint, turn bigint, role string, text string"
        return chat.prefix_target_examples(spark.createDataFrame(rows, schema))

    def test_round_trip_and_mask(self, spark):
        made = self.examples(spark, self.ROWS)
        rows = made.withColumn("loss", chat.loss_text(made)).withColumn("turns", chat.read_turns(made["text"]))
        by = defaultdict(list)
        for row in sorted(rows.collect(), key=lambda r: r.example):
            by[row.conv_id].append(row)
        assert [r.loss for r in by[1]] == ["one\ntwo", ""]
        assert [(t.role, t.text) for t in by[1][-1].turns] == [(r, t or "") for c, _, r, t in self.ROWS if c == 1]
        assert [(r.loss, r.is_last) for r in by[3]] == [("first", False), ("", True)]
        assert [(t.role, t.text) for t in by[3][-1].turns] == [("assistant", "first"), ("", "no role")]
        assert [t.text for t in by[4][0].turns] == ["b", "b"]
        assert by[2][0].loss == "" and by[None][0].loss == "no id"
        planted = by[1][-1].text
        assert "[INST]" not in planted and planted.count("</s>") == 5

    def test_long_conversation(self, spark):
        rows = [(7, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(300)]
        made = self.examples(spark, rows)
        assert made.count() == 150
        assert made.where("is_last").count() == 1

    def test_empty_table(self, spark):
        assert self.examples(spark, []).count() == 0


class TestDecontamination:
    ITEM = "The quick brown fox jumps over the lazy dog while seven wizards box at noon."

    def found(self, spark, docs, items):
        benchmark = spark.createDataFrame(items, "item_id bigint, text string")
        return sorted(
            (r.doc_id, r.item_id, r.distance)
            for r in decontaminate.contaminations(documents(spark, docs), benchmark, edit_rate=0.1).collect()
        )

    def test_edits_are_found_within_the_budget(self, spark):
        changed = self.ITEM.replace("brown", "brawn").replace("seven", "eleven").upper()
        far = self.ITEM.replace("quick brown fox", "slow white cat").replace("wizards", "witches")
        docs = [
            (1, "before " + self.ITEM + " after"),
            (2, "x " * 50 + changed.replace(" ", "\n  ") + " y"),
            (3, far),
            (4, None),
            (5, ""),
            (6, LONG + self.ITEM + LONG),
            (1, "before " + self.ITEM + " after"),
        ]
        items = [(10, self.ITEM), (11, "short"), (12, None), (None, self.ITEM)]
        assert self.found(spark, docs, items) == [(1, 10, 0), (1, 10, 0), (2, 10, 3), (6, 10, 0)]

    def test_items_without_an_id_and_short_items(self, spark):
        docs = [
            (1, f"before {self.ITEM} after"),
            (2, "Is it true?\n 2 + 2  = 4."),
            (3, "it is 12 + 2 = 45, naïveté"),
            (4, "NAÏVE"),
        ]
        items = [(None, self.ITEM), (None, self.ITEM), (11, "2 + 2 = 4"), (None, "naïve"), (12, " "), (None, None)]
        benchmark = spark.createDataFrame(items, "item_id bigint, text string")
        found = decontaminate.contaminations(documents(spark, docs), benchmark, edit_rate=0.1).collect()
        assert {(r.doc_id, r.item_id, r.distance) for r in found} == {(1, None, 0), (2, 11, 0), (4, None, 0)}
        assert len(found) == 3
        kept = decontaminate.drop_contaminated(documents(spark, docs), benchmark)
        assert [r.doc_id for r in kept.collect()] == [3]

    def test_filter_keeps_clean_rows_whole(self, spark):
        docs = documents(spark, [(1, self.ITEM), (None, self.ITEM), (2, "clean text"), (3, None)])
        benchmark = spark.createDataFrame([(10, self.ITEM)], "item_id bigint, text string")
        kept = decontaminate.drop_contaminated(docs, benchmark, block_bytes=16)
        assert kept.columns == docs.columns
        assert sorted(r.doc_id for r in kept.collect()) == [2, 3]

    def test_empty_tables(self, spark):
        assert self.found(spark, [], [(1, self.ITEM)]) == []
        assert self.found(spark, [(1, self.ITEM)], []) == []

    @pytest.mark.parametrize("seed", range(12))
    def test_alignment_matches_full_table(self, seed):
        draw = np.random.default_rng(seed)
        item = bytes(draw.integers(97, 101, 60, dtype=np.uint8))
        noisy = bytearray(item)
        for _ in range(int(draw.integers(0, 6))):
            noisy[int(draw.integers(0, len(noisy)))] = 120
        text = bytes(draw.integers(97, 101, 40, dtype=np.uint8)) + bytes(noisy) + b"zz" * 20
        least = list(range(len(text) + 1))
        least = [0] * (len(text) + 1)
        for i, a in enumerate(item, 1):
            row = [i]
            for j, b in enumerate(text, 1):
                row.append(min(least[j - 1] + (a != b), least[j] + 1, row[-1] + 1))
            least = row
        distance, begin, end = decontaminate.banded_alignment(item, text, 30, 20, 6)
        assert distance == min(least) and 34 <= begin <= 46 and end > begin


class TestQuality:
    def test_learns_and_scores_every_row(self, spark):
        rows = [(i, "good words in a calm line. " * (2 + i % 5), 100) for i in range(60)]
        rows += [(100 + i, "BUY!! ### $$$ NOW!! %%% " * (2 + i % 5), 100) for i in range(60)]
        docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint")
        labels = docs.selectExpr("doc_id", "int(doc_id < 100) AS quality").unionByName(
            spark.createDataFrame([(None, 1), (3, 1), (5000, 0), (7, None)], "doc_id bigint, quality int")
        )
        model = quality.fit_quality(docs, labels, max_labelled=90)
        odd = spark.createDataFrame(
            [(1, None, None, 3.0), (2, "", 0, 3.0), (2, "", 0, 3.0), (3, LONG, -5, 3.0), (4, rows[0][1], 100, 3.0)],
            "doc_id bigint, text string, n_chars bigint, score double",
        )
        scored = quality.score_quality(odd, model)
        assert scored.columns == ["doc_id", "text", "n_chars", "score"]
        assert all(0 <= r.score <= 1 for r in scored.collect())
        got = {r.doc_id: r.score for r in quality.score_quality(docs, model).collect()}
        assert all((got[i] > 0.5) == (i < 100) for i in got)
        assert quality.score_quality(odd.limit(0), model).count() == 0

    def test_without_labels(self, spark):
        docs = spark.createDataFrame([(1, "a", 1)], "doc_id bigint, text string, n_chars bigint")
        labels = spark.createDataFrame([], "doc_id bigint, quality int")
        model = quality.fit_quality(docs, labels)
        assert quality.score_quality(docs, model).first().score == 0.5

    def test_pairs_by_the_sum_of_squares(self):
        draw = np.random.default_rng(1)
        width = 4 + len(quality.STRUCTURE) + len(quality.METADATA)
        dense = width - 4
        model = quality.Machine(
            0.3, draw.normal(size=width), draw.normal(size=(width, 3)), np.zeros(dense), np.ones(dense), 4
        )
        ids, values = np.array([0, 2, 5, 9]), draw.normal(size=4)
        x = model.prepare(ids, values)
        want = 0.3 + model.linear[ids] @ x
        want += sum(
            (model.factors[ids[i]] @ model.factors[ids[j]]) * x[i] * x[j] for i in range(4) for j in range(i)
        )
        assert np.isclose(model.margins(ids, values, np.array([0]))[0], want)


class TestUrls:
    def test_latest_entry_of_the_most_specific_pattern(self, spark):
        entries = spark.createDataFrame(
            [
                ("bad.example.com", "2024-01-10", "block"),
                ("bad.example.com", "2024-02-10", "remove"),
                ("bad.example.com", "2024-02-10", "block"),
                ("example.com", "2024-03-01", "block"),
                ("bad.example.com/ok/", "2024-01-20", "allow"),
                ("BAD.example.com", "2024-01-10", "block"),
                (None, "2024-01-01", "block"),
                ("x.org", None, "block"),
            ],
            "pattern string, listed_at string, action string",
        ).selectExpr("pattern", "timestamp(listed_at) AS listed_at", "action")
        cases = [
            (1, "http://bad.example.com/a", "2024-01-09", None),
            (2, "http://Bad.Example.com:80/a", "2024-01-10", "block"),
            (3, "http://bad.example.com/ok/1?x#y", "2024-01-25", "allow"),
            (4, "http://u@bad.example.com", "2024-02-20", None),
            (5, "http://bad.example.com", "2024-03-05", "block"),
            (6, "http://other.example.com./", "2025-03-05", "block"),
            (7, None, "2024-03-05", None),
            (8, "not a url", "2024-03-05", None),
            (9, "http://bad.example.com", None, None),
            (9, "http://bad.example.com", None, None),
            (10, "http://notexample.com", "2024-03-05", None),
        ]
        captures = spark.createDataFrame(
            [(i, u, t, "clash") for i, u, t, _ in cases], "page_id int, url string, t string, pattern string"
        ).selectExpr("page_id", "url", "timestamp(t) AS fetched_at", "pattern")
        for days in (1, 30, 1000):
            got = urls.judge_captures(captures, entries, bucket_days=days).collect()
            assert sorted((r.page_id, r.action or "") for r in got) == sorted((i, a or "") for i, _, _, a in cases)
            assert all(r.blocked == (r.action == "block") for r in got)
        assert urls.judge_captures(captures.limit(0), entries).count() == 0
        assert urls.judge_captures(captures, entries.limit(0)).where("blocked").count() == 0


def test_held_out_rows_follow_the_crc(spark):
    from courtside.llm.queries import held_out

    rows = spark.range(200).select("id", held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in rows)


def test_far_off_captures_do_not_multiply_intervals(spark):
    """Two hundred open entries, a capture of today and one of the year 9999."""
    entries = spark.createDataFrame(
        [(f"h{i}.example", "2024-01-01 00:00:00", "block") for i in range(200)],
        "pattern string, listed_at string, action string",
    ).selectExpr("pattern", "CAST(listed_at AS timestamp) AS listed_at", "action")
    captures = spark.createDataFrame(
        [(1, "http://h1.example/a", "2024-05-01 00:00:00"), (2, "http://h2.example/", "9999-12-01 00:00:00"),
         (3, "http://h3.example/", "1000-01-01 00:00:00"), (4, "http://h4.example/", None)],
        "page_id int, url string, fetched_at string",
    ).selectExpr("page_id", "url", "CAST(fetched_at AS timestamp) AS fetched_at")
    times = captures.selectExpr("fetched_at AS _at")
    assert urls.in_buckets(urls.validity_intervals(entries), times, 30).count() == 400
    got = {r.page_id: r.blocked for r in urls.judge_captures(captures, entries).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False}


def test_quality_takes_a_batch_in_short_slices():
    """Features of a whole batch at once took 180 MB of a worker on 6,410 documents."""
    batches = [pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64())], names=["n"]) for n in (1300, 0, 7)]
    parts = list(quality._slices(batches))
    assert [p.num_rows for p in parts] == [512, 512, 276, 7]
    assert pa.Table.from_batches(parts) == pa.Table.from_batches(batches)
