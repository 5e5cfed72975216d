"""What may be broadcast, and what stays on disk."""

from courtside.session import configured, is_small, stored
from courtside.sources.files import write_csv


def test_small_by_rows_and_bytes(spark):
    df = spark.range(10).selectExpr("id", "repeat('x', 100) AS text", "array(id) AS `a.b`")
    assert is_small(df)
    assert not is_small(df, max_rows=9)
    assert not is_small(df, max_bytes=1000)
    assert is_small(df.limit(0), max_rows=0, max_bytes=0)


def test_a_key_alone_may_have_more_rows(spark, monkeypatch):
    monkeypatch.setattr("courtside.session.BROADCAST_ROWS", 5)
    keys = spark.range(10)
    assert is_small(keys)
    assert not is_small(keys.selectExpr("id", "id AS more"))
    monkeypatch.setattr("courtside.session.BROADCAST_KEYS", 9)
    assert not is_small(keys)


def shuffle_files(spark):
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    names = env.blockManager().diskBlockManager().getAllFiles().mkString(" ").split()
    return {n for n in names if "shuffle" in n}


def test_shuffle_files_go_with_their_write(spark, tmp_path):
    before = shuffle_files(spark)
    counted = spark.range(1000).groupBy("id").count()
    assert stored(counted, "counted").count() == 1000
    write_csv(counted.groupBy("count").count(), str(tmp_path / "csv"))
    # Counts of stored rows may leave one of a few bytes, the writes none of their own.
    kept = shuffle_files(spark) - before
    assert len(kept) <= 2


def test_settings_come_back(spark):
    key, other = "spark.sql.maxConcurrentOutputFileWriters", "spark.sql.shuffle.partitions"
    unset, partitions = spark.conf.get(key), spark.conf.get(other)
    try:
        with configured(spark, {key: "7", other: "3"}):
            assert spark.conf.get(key) == "7" and spark.conf.get(other) == "3"
            raise ValueError
    except ValueError:
        pass
    assert (spark.conf.get(key), spark.conf.get(other)) == (unset, partitions)
