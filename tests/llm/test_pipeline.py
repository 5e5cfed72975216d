"""The pipeline's stages, each on its own small input."""

import corpus_pipeline
import pytest
from courtside.llm import simhash
from courtside.llm.common import stored

NAMES = ["quality", "lines", "near_duplicates", "decontamination", "packing"]


def docs(spark, rows):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, extra int"
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1) for i, t in rows], schema)


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages_run_in_order(spark, folder):
    assert [name for name, _ in corpus_pipeline.STAGES] == NAMES
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    before = frame.count()
    for name, step in corpus_pipeline.STAGES:
        frame = stored(step(spark, frame, folder), "test-stage")
        if name != "packing":
            assert frame.columns == corpus_pipeline.COLUMNS
            assert 0 < frame.count() <= before
            before = frame.count()
    assert {"doc_id", "ids", "sequence_id"} <= set(frame.columns)
    assert frame.select("doc_id").distinct().count() == before


@pytest.mark.parametrize("name", NAMES)
def test_empty_input(spark, folder, name):
    assert stage(name)(spark, docs(spark, []), folder).count() == 0


def test_line_stage_drops_emptied_documents_only(spark, folder):
    line = "one two three four five six seven"
    rows = [(1, line), (2, line), (3, f"{line}\nanother line of text"), (4, None), (5, ""), (6, " ")]
    out = {r.doc_id: r for r in stage("lines")(spark, docs(spark, rows), folder).collect()}
    assert set(out) == {1, 3, 4, 5, 6}
    assert out[3].text == "another line of text" and out[3].n_chars == 20


def test_near_duplicate_stage_keeps_one_of_each_group(spark, folder):
    text = " ".join(f"word{i}" for i in range(400))
    near = text + " end"
    other = " ".join(f"thing{i}" for i in range(300))
    rows = [(5, text), (3, near), (9, other), (9, other), (None, text), (None, "alone without id"), (7, None), (8, "")]
    out = stage("near_duplicates")(spark, docs(spark, rows), folder).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out) == [(False, 3), (False, 7), (False, 9), (True, 0)]


def test_near_duplicate_stage_tells_texts_of_one_id_apart(spark):
    a, b, x, y = (" ".join(f"{name}{i}" for i in range(60)) for name in "abxy")
    rows = [(5, a), (5, b), (3, x), (6, f"{x} end"), (6, y), (None, a), (7, y), (7, f"{y} end"), (7, "alone")]
    out = stage("near_duplicates")(spark, docs(spark, rows), "").collect()
    assert sorted((r.doc_id, r.text) for r in out) == sorted([(5, a), (5, b), (3, x), (6, y), (7, "alone")])


def test_near_duplicate_stage_follows_fingerprints_and_sets(spark):
    """Before, fingerprints were not compared: 2, 7 and the one without an id stayed."""
    passage = " ".join(f"word{i}" for i in range(11))
    repeated = [" ".join([passage] * 200 + [f"{name}{i}" for i in range(40)]) for name in "abc"]
    plain = [f"plain{i}" for i in range(329)]
    changed = " ".join(f"{w}x" if i % 55 == 20 else w for i, w in enumerate(plain))
    tails = [" ".join([passage.replace("word", "other")] * 200 + [f"{n}{i}" for i in range(40)]) for n in "de"]
    rows = [(1, repeated[0]), (2, repeated[1]), (None, repeated[2]), (4, " ".join(plain)), (5, changed)]
    rows += [(6, tails[0]), (7, tails[1]), (8, "alone")]
    out = stage("near_duplicates")(spark, docs(spark, rows), "").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out) == [(False, i) for i in (1, 4, 6, 8)]


def test_near_duplicate_stage_joins_groups_of_both_kinds(spark):
    """1 and 2 have near fingerprints, 2 and 3 similar sets: one group."""
    passage = " ".join(f"word{i}" for i in range(11))
    tail = [f"b{i}" for i in range(40)]
    first = " ".join([passage] * 200 + [f"a{i}" for i in range(40)])
    second = " ".join([passage] * 200 + tail)
    # The same set as the second's but for a few shingles; few repeats, so another fingerprint.
    third = " ".join([passage] * 2 + tail)
    assert simhash.fingerprint_of(first, 5) == simhash.fingerprint_of(second, 5)
    assert (simhash.fingerprint_of(second, 5) ^ simhash.fingerprint_of(third, 5)).bit_count() > 3
    rows = [(3, third), (1, first), (2, second)]
    out = stage("near_duplicates")(spark, docs(spark, rows), "").collect()
    assert [r.doc_id for r in out] == [1]


def test_decontamination_stage(spark, folder):
    item = spark.read.parquet(f"{folder}/benchmark.parquet").first().text
    rows = [(1, f"before {item} after"), (2, "clean"), (None, item), (3, None)]
    out = stage("decontamination")(spark, docs(spark, rows), folder).collect()
    assert sorted(r.doc_id for r in out) == [2, 3]
