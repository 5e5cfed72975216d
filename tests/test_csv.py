"""CSV files with line breaks inside quotes, read by many tasks."""

import random
import re

import pytest
from pyspark.sql import functions as F

from courtside.operators.integrity import flag_rows
from courtside.schemas import TABLES
from courtside.sources import files

SIZES = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")


@pytest.fixture
def small_splits(spark):
    spark.conf.set(SIZES[0], "3000")
    spark.conf.set(SIZES[1], "1")
    yield
    for key in SIZES:
        spark.conf.unset(key)


def quoted(value):
    return '"' + value.replace('"', '""') + '"'


def write(folder, name, rows, end):
    folder.mkdir(exist_ok=True)
    text = end.join(["Id,Input,output", *(",".join(r) for r in rows)]) + end
    (folder / name).write_text(text, encoding="utf-8", newline="")


def values(draw, n):
    parts = ["a", " b ", "\n", "\n\n", ",", '"', '""', "é日", "\r\n", "x" * 300, "'", "#"]
    rows = []
    for i in range(n):
        cells = [quoted("".join(draw.choices(parts, k=draw.randint(0, 6)))) for _ in range(2)]
        if draw.random() < 0.3:
            cells[0] = draw.choice(["", "plain", " outer "])
        rows.append([str(i), *cells])
    return rows


def read(df):
    names = [c for c in df.columns if c != files.ARRIVAL]
    return names, [tuple(r[c] for c in names) for r in df.orderBy(files.ARRIVAL).collect()]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_equals_one_task_per_file(spark, tmp_path, small_splits, end):
    draw = random.Random(end)
    for part in range(3):
        write(tmp_path / "c", f"{part}.csv", values(draw, 60), end)
    # One value that runs through several splits.
    write(tmp_path / "c", "3.csv", [["0", quoted("line\n" * 3000), '"y"'], ["1", "z", '"a\nb"']], end)
    path = str(tmp_path / "c")
    assert spark.read.text(path).rdd.getNumPartitions() > 10
    split = files.scan_quoted_csv(spark, path)
    assert read(split) == read(files.scan_csv(spark, path, multiline=True))
    assert len({r[files.ARRIVAL]["block"] for r in split.collect()}) >= 3
    first = files.read_corpus(spark, path, limit=2)
    assert [r.id for r in first.orderBy(files.ARRIVAL).collect()] == ["0", "1"]


def test_quotes_inside_unquoted_values(spark, tmp_path, small_splits):
    rows = [[str(i), '5" tall' if i == 70 else "plain", quoted("a\nb" * 40)] for i in range(150)]
    write(tmp_path / "c", "0.csv", rows, "\n")
    path = str(tmp_path / "c")
    assert read(files.scan_quoted_csv(spark, path)) == read(files.scan_csv(spark, path, multiline=True))


def test_small_and_empty_files(spark, tmp_path):
    write(tmp_path / "c", "0.csv", [["1", '"a\nb"', "c"]], "\n")
    assert read(files.scan_quoted_csv(spark, str(tmp_path / "c")))[1] == [("1", "a\nb", "c")]
    write(tmp_path / "d", "0.csv", [], "\n")
    assert read(files.scan_quoted_csv(spark, str(tmp_path / "d"))) == (["id", "input", "output"], [])


TEXTS = {
    # text: (as a whole number, as a real number, whether each is a reason)
    "12": (12, 12.0, False, False),
    " 12 ": (12, 12.0, False, False),
    "12.7": (12, 12.7, False, False),
    "-0": (0, -0.0, False, False),
    "1e39": (None, None, True, True),
    "inf": (None, float("inf"), True, False),
    "NaN": (None, None, False, False),
    "-nan": (None, None, False, False),
    "N/A": (None, None, False, False),
    "": (None, None, False, False),
    "  ": (None, None, False, False),
    "abc": (None, None, True, True),
    "99999999999": (None, 99999999999.0, True, False),
    None: (None, None, False, False),
}


def test_typed_values_and_reasons(spark):
    spec = TABLES["player_season"]
    rows = spark.createDataFrame([(t, t, t) for t in TEXTS], "age string, pts string, player_height string")
    cleaned = files.clean_row(rows, spec)
    assert cleaned.columns == [*spec.loaded_columns, "_reasons"]
    for text, got in zip(TEXTS, cleaned.collect(), strict=True):
        whole, real, no_whole, no_real = TEXTS[text]
        assert got.age == whole, text
        assert got.pts == (None if real is None else pytest.approx(real)), text
        expected = ["age: not a valid int"] * no_whole + ["pts: not a valid float"] * no_real
        assert got._reasons == expected, text
    strange = files.clean_row(rows.withColumn("more", F.lit("x")), spec).collect()
    assert all(r._reasons[-1] == "unknown column: more" for r in strange)


def test_reasons_are_looked_for_only_where_there_may_be_some(spark):
    """Lists of reasons are interpreted, not compiled: a row that has none must not make one."""
    spec = TABLES["player_season"]
    cleaned = files.clean_row(spark.createDataFrame([("1", "2")], "age string, pts string"), spec)
    # Before, the list was made and filtered for every row.
    made = r"THEN (cast\()?(array_compact|filter|concat)\("
    assert re.search(made, cleaned._jdf.queryExecution().analyzed().toString())
    checked = flag_rows(cleaned.drop("_reasons"), spec, {})
    assert re.search(made, checked._jdf.queryExecution().analyzed().toString())
    assert checked.first()._reasons == []
