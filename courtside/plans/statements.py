"""Running SQL texts. Statements go through the driver one by one; their rows do not."""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass, field
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from courtside.operators.results import exact_row, row_array, value_row
from courtside.session import scratch_path

ROWS_SCHEMA = "statement_id bigint, pos bigint, row array<string>"
OUTCOME_SCHEMA = (
    "statement_id bigint, ok boolean, condition string, message string, "
    "unknown_qualifier boolean, columns array<string>"
)


# Found in every statement with a ``NOT IN`` or ``NOT (… IN …)``, and in others.
_NOT_IN = re.compile(r"(?is)\bnot\b.*\bin\b")

# The condition of a statement that ran out of time.
TIMEOUT = "STATEMENT_TIMEOUT"


@dataclass(frozen=True)
class Outcome:
    """What became of one statement; ``df`` is None when it failed."""

    ok: bool
    df: DataFrame | None
    condition: str
    message: str


@dataclass(frozen=True)
class Waiting:
    """An analysed statement that has yet to run."""

    statement_id: int
    sql: str
    columns: list[str]
    rows: DataFrame


def _failure(error: Exception) -> tuple[str, str]:
    if isinstance(error, PySparkException):
        return error.getCondition() or "", str(error).split("\n\nJVM stacktrace")[0]
    return "", str(error)


def run_sql(spark: SparkSession, sql: str | None) -> Outcome:
    """Analyse a query and return its DataFrame; an error is returned, not raised.

    A NULL text is a failed statement.

    The text is first analysed as a subquery, which accepts SELECT and WITH and
    refuses every command, because ``spark.sql`` runs commands at once. Errors that
    only show while rows are read come from the action on ``df``.
    """
    if sql is None:
        return Outcome(False, None, "", "the statement is NULL")
    body = sql.strip().rstrip(";").rstrip()
    try:
        spark.sql(f"SELECT * FROM (\n{body}\n)")
        return Outcome(True, spark.sql(body), "", "")
    except Exception as error:  # noqa: BLE001 - any failure is this statement's result
        return Outcome(False, None, *_failure(error))


def unknown_qualifier(sql: str, condition: str, message: str) -> bool:
    """Whether an unresolved column names a table or alias the statement lacks."""
    if not condition.startswith("UNRESOLVED_COLUMN"):
        return False
    found = re.search(r"name `([^`]+)`\.`", message)
    if not found:
        return False
    # A table or alias is named somewhere without a dot behind it.
    named = rf"(?i)\b{re.escape(found.group(1))}\b(?!\s*\.)"
    return re.search(named, sql) is None


def _numbered_columns(df: DataFrame) -> DataFrame:
    """Duplicate column names are legal in a result; numbered ones are not ambiguous."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def _shaped(statement_id: int, df: DataFrame, pos: Column, row: Column) -> DataFrame:
    return df.select(
        F.lit(statement_id).cast("bigint").alias("statement_id"),
        pos.cast("bigint").alias("pos"),
        row.alias("row"),
    )


def _result_rows(statement_id: int, df: DataFrame) -> DataFrame:
    renamed = _numbered_columns(df)
    return _shaped(statement_id, renamed, F.lit(None), row_array(renamed))


def _beside_one_row(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """The same rows, as a lateral subquery beside one row.

    Spark simplifies a plan once more where it stands below a lateral join, after it has made
    joins of the subqueries. A ``NOT IN`` between columns that can't be NULL is an ordinary
    anti-join then; else its rows are always broadcast, however many there are. Rows that
    hang on chance or on their place can't stand there, and are returned as they are.
    """
    one = F.broadcast(spark.sql("SELECT 1 AS _one"))
    try:
        return one.lateralJoin(rows).select(*rows.columns)
    except AnalysisException:
        return rows


def first_rows(max_rows: int) -> Callable[[int, DataFrame], DataFrame]:
    """A shape for previews: the first rows in order, and the number of all rows.

    The number is the one row without a position.
    """

    def shape(statement_id: int, df: DataFrame) -> DataFrame:
        # A limit leaves one partition in result order, so row ids number it.
        top = _numbered_columns(df.limit(max_rows))
        shown = _shaped(statement_id, top, F.monotonically_increasing_id(), exact_row(top))
        total = df.agg(F.count("*").cast("string").alias("n"))
        return shown.unionByName(
            _shaped(statement_id, total, F.lit(None), F.array("n").cast("array<string>"))
        )

    return shape


def ordered_rows(statement_id: int, df: DataFrame) -> DataFrame:
    """A shape that keeps the order: ``pos`` grows with it, though with gaps.

    A sorted result is sorted across its partitions, and row ids grow with both, so no
    single partition has to see all rows. ``results.gapless_positions`` closes the gaps.
    """
    renamed = _numbered_columns(df)
    return _shaped(statement_id, renamed, F.monotonically_increasing_id(), value_row(renamed))


class _Deadline:
    """Stops the jobs that the current thread starts once ``seconds`` have passed.

    ``expired`` tells whether they have. Jobs are known by a tag, so those of other
    threads go on. A job that begins after the time is stopped as well.
    """

    def __init__(self, spark: SparkSession, seconds: float | None) -> None:
        self.context, self.seconds = spark.sparkContext, seconds
        self.tag = f"statements-{uuid.uuid4().hex}"
        self.done = threading.Event()
        self.expired = False
        self.watcher: threading.Thread | None = None

    def _watch(self) -> None:
        if self.done.wait(self.seconds):
            return
        self.expired = True
        while not self.done.is_set():
            self.context.cancelJobsWithTag(self.tag)
            self.done.wait(0.2)

    def __enter__(self) -> _Deadline:
        if self.seconds is not None:
            self.context.addJobTag(self.tag)
            # Tasks end as well, not only the job that waits for them.
            self.context.setInterruptOnCancel(True)
            self.watcher = threading.Thread(target=self._watch, daemon=True)
            self.watcher.start()
        return self

    def __exit__(self, *error: object) -> None:
        if self.watcher is not None:
            self.done.set()
            self.watcher.join()
            self.context.removeJobTag(self.tag)


@dataclass
class _Store:
    """Where the rows and outcomes of chunks go: a folder each, named by the driver.

    Chunks are stored side by side, and one that fails may leave files behind; only the
    folders of jobs that ended well are read.
    """

    spark: SparkSession
    path: str
    seconds: float | None
    rows: list[str] = field(default_factory=list)
    outcomes: list[str] = field(default_factory=list)

    def _fresh(self, kind: str) -> str:
        return f"{self.path}/{kind}/{uuid.uuid4().hex}"

    def tell(self, outcomes: list[tuple]) -> None:
        if outcomes:
            folder = self._fresh("outcomes")
            frame = self.spark.createDataFrame(outcomes, OUTCOME_SCHEMA).coalesce(1)
            frame.write.parquet(folder)
            self.outcomes.append(folder)

    def _run(self, batch: list[Waiting]) -> list[tuple]:
        """Store the rows of a batch in one job, or find out which statements fail."""
        folder = self._fresh("rows")
        deadline = _Deadline(self.spark, self.seconds)
        try:
            with deadline:
                reduce(DataFrame.unionByName, [w.rows for w in batch]).write.parquet(folder)
        except Exception as error:  # noqa: BLE001 - a run-time error of some statement
            if len(batch) > 1:
                # Out of time, each gets its own; else halves tell good from bad quickly.
                half = len(batch) // 2
                parts = [[w] for w in batch] if deadline.expired else [batch[:half], batch[half:]]
                return [row for part in parts for row in self._run(part)]
            if deadline.expired:
                told = (TIMEOUT, f"canceling statement due to its limit of {self.seconds} s")
            else:
                told = _failure(error)
            return [_failed(batch[0].statement_id, batch[0].sql, *told)]
        self.rows.append(folder)
        return [(w.statement_id, True, "", "", False, w.columns) for w in batch]

    def run(self, batch: list[Waiting], pool: str) -> None:
        self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", pool)
        self.tell(self._run(batch))

    def read(self, folders: list[str], schema: str) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*folders)


def _failed(statement_id: int, sql: str | None, condition: str, message: str) -> tuple:
    bad_name = sql is not None and unknown_qualifier(sql, condition, message)
    return statement_id, False, condition, message, bad_name, []


def run_statements(
    spark: SparkSession,
    statements: Iterable[tuple[int, str | None]],
    chunk: int = 20,
    shape: Callable[[int, DataFrame], DataFrame] = _result_rows,
    at_once: int = 4,
    seconds: float | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Run many queries: ``(rows, outcomes)``.

    ``rows`` is ``(statement_id, pos, row)``, by default all rows in comparable text form
    without positions. ``shape`` makes them from a statement's result. They are written by
    Spark to the shared folder, a chunk of statements per job so that plans stay small, and
    ``at_once`` chunks side by side (in scheduler pools of their own, where the session's
    scheduler is fair). A chunk that fails while running is halved until the failing
    statements stand alone.

    With ``seconds``, a chunk that takes longer is stopped, and its statements run one by
    one; a statement that takes longer by itself fails with the condition ``TIMEOUT``.
    The others of its chunk finish, and chunks beside it go on.

    Outcomes are written with their chunk, so the driver holds the texts and outcomes of
    ``at_once`` running and as many waiting chunks at most.
    """
    store = _Store(spark, scratch_path(spark, "statements"), seconds)
    failures: list[tuple] = []
    running: set[Future] = set()
    waiting: list[Waiting] = []
    started = 0

    with ThreadPoolExecutor(max_workers=at_once) as threads:

        def start() -> None:
            nonlocal running, started
            target = inheritable_thread_target(spark)(store.run)
            running.add(threads.submit(target, list(waiting), f"statements-{started % at_once}"))
            started += 1
            waiting.clear()
            if len(running) >= 2 * at_once:
                ended, running = wait(running, return_when=FIRST_COMPLETED)
                for future in ended:
                    future.result()

        for statement_id, sql in statements:
            outcome = run_sql(spark, sql)
            if not outcome.ok:
                failures.append(_failed(statement_id, sql, outcome.condition, outcome.message))
                if len(failures) >= chunk:
                    store.tell(failures)
                    failures.clear()
                continue
            rows = shape(statement_id, outcome.df)
            if _NOT_IN.search(sql):
                rows = _beside_one_row(spark, rows)
            waiting.append(Waiting(statement_id, sql, outcome.df.columns, rows))
            if len(waiting) == chunk:
                start()
        if waiting:
            start()
        store.tell(failures)
        for future in running:
            future.result()
    return store.read(store.rows, ROWS_SCHEMA), store.read(store.outcomes, OUTCOME_SCHEMA)
