"""The registered queries of this subpackage: each applies one operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtside.llm import (
    bestfit,
    chat,
    decontaminate,
    lexical,
    lines,
    nearest,
    packing,
    quality,
    sharding,
    simhash,
    suffix,
    urls,
    whitening,
)
from courtside.llm.common import table

TOKENIZER = "byte_bpe_50k.json"
WORD_TOKENIZER = "word_bpe_49k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(build: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[build.__name__] = build
        if sql is not None:
            ORACLES[build.__name__] = sql
        return build

    return register


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query()
def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2,048 tokens, with a checksum each."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return packing.pack(docs, tokenizer_path(), size=2048, end_id=1).select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


@query()
def op2_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in eight shards of equal counts; equal texts are linked."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, folder, "documents").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.md5(text).alias("same_text"),
    )
    return sharding.balanced_shards(docs, "same_text", shards=8).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query(
    """
    WITH turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
        FROM conversations
        UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
        UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
    ), sized AS (
        SELECT *,
            length('<|' || regexp_replace(role, '([<\\[\\\\|])', '\\1\\\\', 'g') || '|>' || chr(10)
                || regexp_replace(text, '([<\\[\\\\|])', '\\1\\\\', 'g') || '</s>' || chr(10)) AS chars,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n
        FROM turns
    ), running AS (
        SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY n) AS upto,
            max(n) OVER (PARTITION BY conv_id) AS last
        FROM sized
    )
    SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
        coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), ''))
            AS loss_sha256,
        sum(upto) FILTER (role = 'assistant' OR n = last)::BIGINT AS formatted_chars
    FROM running GROUP BY conv_id
    """
)
def op5_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    """Per conversation, read back from its examples: turns, trainable text, sizes.

    ``formatted_chars`` counts the code points of all examples of the conversation.
    """
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(planted)
    examples = chat.prefix_target_examples(turns)
    read = examples.select(
        "conv_id",
        F.length("text").alias("chars"),
        F.when(F.col("is_last"), chat.read_turns(F.col("text"))).alias("turns"),
        F.struct("example", chat.loss_text(examples).alias("text")).alias("loss"),
    )
    gathered = read.groupBy("conv_id").agg(
        F.max("turns").alias("turns"),
        F.sort_array(F.collect_list("loss")).alias("losses"),
        F.sum("chars").alias("formatted_chars"),
    )
    end = F.lit("\n")
    said = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], end, t["text"], end)), ""
    )
    return gathered.withColumn("loss", F.array_join("losses.text", "")).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


@query()
def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """SimHash of every document and the smallest document reachable over near ones."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return simhash.simhash_groups(docs, shingle=3).select(
        "doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def held_out(column: str = "doc_id"):
    """Rows never used to fit the classifier: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 4 == 2, F.lit(False))


def fit_on_documents(spark: SparkSession, folder: str) -> quality.Machine:
    labels = table(spark, folder, "labels").where(~held_out()).select("doc_id", "quality")
    docs = table(spark, folder, "documents").select("doc_id", "text", "n_chars")
    return quality.fit_quality(docs, labels)


@query()
def op8_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document, learnt from the labels that aren't held out."""
    model = fit_on_documents(spark, folder)
    docs = table(spark, folder, "documents").select("doc_id", "text", "n_chars")
    return quality.score_quality(docs, model).select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


@query()
def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: its lines, those removed as later matches, and a digest of the rest."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs, similarity=0.8).select(
        "doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256")
    )


@query()
def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a benchmark item within one edit per ten bytes, and where."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    benchmark = table(spark, folder, "benchmark").select("item_id", "text")
    return decontaminate.contaminations(docs, benchmark, edit_rate=0.1)


@query()
def op10_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: bytes in strings of 400 bytes that start elsewhere too, and the rest."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    removed = F.aggregate(
        F.zip_with("begins", "ends", lambda a, b: b - a),
        F.lit(0).cast("long"),
        lambda total, n: total + n,
    )
    return suffix.drop_repeats(docs, length=400).select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("begins").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query()
def op7_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest of every twentieth embedding among all others, by inner product."""
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return nearest.nearest(vectors, vectors.where("vec_id % 20 = 0"), keep=20)


def _days(pattern, begin: int, many: int):
    """A number of days below ``many`` from three hex digits of a pattern's md5."""
    return F.conv(F.substring(F.md5(pattern), begin, 3), 16, 10).cast("int") % many


def dated_list(pages: DataFrame) -> DataFrame:
    """A block list with a history, drawn from the pages' own hosts and sections.

    Every host is blocked, cleared and blocked again, every parent domain blocked for a
    while, and every section of a host allowed or blocked from some day on.
    """
    host, path = urls.host_of(F.col("url")), urls.path_of(F.col("url"))
    start = F.lit("2024-01-01").cast("date")
    hosts = pages.select(host.alias("pattern")).where("pattern IS NOT NULL").distinct()
    parents = hosts.select(F.regexp_replace("pattern", r"^[^.]*\.", "").alias("pattern")).distinct()
    section = F.regexp_extract(path, "^(/[^/]+/)", 1)
    sections = pages.where(section != "").select(F.concat(host, section).alias("pattern")).distinct()
    day = F.col("pattern")

    def listed(df: DataFrame, days, action) -> DataFrame:
        at = F.date_add(start, days).cast("timestamp")
        return df.select("pattern", at.alias("listed_at"), action.alias("action"))

    first, second = _days(day, 1, 300), _days(day, 4, 90)
    cleared = first + 1 + second
    kind = F.when(_days(day, 7, 2) == 0, "allow").otherwise("block")
    return (
        listed(hosts, first, F.lit("block"))
        .unionByName(listed(hosts, cleared, F.lit("remove")))
        .unionByName(listed(hosts, cleared + 30, F.lit("block")))
        .unionByName(listed(parents, second, F.lit("block")))
        .unionByName(listed(parents, cleared, F.lit("allow")))
        .unionByName(listed(sections, first, kind))
    )


@query(
    r"""
    WITH p AS (
        SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host,
            regexp_extract(url, '^[a-z]+://[^/?#]*(/[^/?#]+/)', 1) AS section,
            TIMESTAMP '2024-01-01' + to_seconds((page_id * 104729) % 31536000) AS fetched
        FROM pages
    ), hosts AS (SELECT DISTINCT host AS pattern FROM p WHERE host <> ''),
    parents AS (SELECT DISTINCT regexp_replace(pattern, '^[^.]*\.', '') AS pattern FROM hosts),
    sections AS (SELECT DISTINCT host || section AS pattern FROM p WHERE section <> ''),
    days AS (
        SELECT kind, pattern,
            ('0x' || substr(md5(pattern), 1, 3))::INT % 300 AS a,
            ('0x' || substr(md5(pattern), 4, 3))::INT % 90 AS b,
            ('0x' || substr(md5(pattern), 7, 3))::INT % 2 AS c
        FROM (SELECT 'h' AS kind, * FROM hosts UNION ALL SELECT 'd', * FROM parents
            UNION ALL SELECT 's', * FROM sections)
    ), entries AS (
        SELECT pattern, a AS day, 'block' AS action FROM days WHERE kind = 'h'
        UNION ALL SELECT pattern, a + 1 + b, 'remove' FROM days WHERE kind = 'h'
        UNION ALL SELECT pattern, a + 31 + b, 'block' FROM days WHERE kind = 'h'
        UNION ALL SELECT pattern, b, 'block' FROM days WHERE kind = 'd'
        UNION ALL SELECT pattern, a + 1 + b, 'allow' FROM days WHERE kind = 'd'
        UNION ALL SELECT pattern, a, CASE WHEN c = 0 THEN 'allow' ELSE 'block' END
            FROM days WHERE kind = 's'
    ), spans AS (
        SELECT pattern, action, TIMESTAMP '2024-01-01' + to_days(day) AS since,
            TIMESTAMP '2024-01-01' + to_days(lead(day) OVER (PARTITION BY pattern ORDER BY day)) AS until
        FROM (SELECT pattern, day, max(action) AS action FROM entries GROUP BY ALL)
    ), wanted AS (
        SELECT page_id, fetched, host AS pattern, 3 AS rank FROM p WHERE host <> ''
        UNION ALL SELECT page_id, fetched, regexp_replace(host, '^[^.]*\.', ''), 2 FROM p
        UNION ALL SELECT page_id, fetched, regexp_replace(host, '^[^.]*\.[^.]*\.', ''), 1 FROM p
        UNION ALL SELECT page_id, fetched, host || section, 4 FROM p WHERE section <> ''
    ), found AS (
        SELECT w.page_id, s.pattern, s.action, s.since,
            row_number() OVER (PARTITION BY w.page_id ORDER BY w.rank DESC) AS n
        FROM wanted w JOIN spans s ON w.pattern = s.pattern AND w.fetched >= s.since
            AND (s.until IS NULL OR w.fetched < s.until) AND s.action <> 'remove'
    )
    SELECT p.page_id, f.pattern, f.action, strftime(f.since, '%Y-%m-%d') AS since,
        coalesce(f.action = 'block', false) AS blocked
    FROM p LEFT JOIN found f ON p.page_id = f.page_id AND f.n = 1
    """
)
def op6_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    """Every page judged by the entries of a dated list that were active at its time."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    seconds = (F.col("page_id") * 104729) % 31_536_000
    start = F.unix_seconds(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    captures = pages.withColumn("fetched_at", F.timestamp_seconds(start + seconds))
    return urls.judge_captures(captures, dated_list(pages)).select(
        "page_id", "pattern", "action", F.date_format("since", "yyyy-MM-dd").alias("since"), "blocked"
    )


@query()
def op12_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of all documents in few sequences of at most 2,048 tokens, with checksums."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return bestfit.best_fit(docs, tokenizer_path(WORD_TOKENIZER), size=2048, end_id=0).select(
        "doc_id",
        "piece",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "sequence_id",
        "offset",
    )


@query()
def op13_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Every embedding in the first 32 whitened components of all embeddings."""
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return whitening.whiten(vectors, components=32, grid=64, offset=1_000_000)


@query(
    r"""
    WITH texts AS (
        SELECT 'd' AS kind, row_number() OVER () AS r, doc_id AS id, text FROM documents
        UNION ALL SELECT 'q', row_number() OVER (), item_id, text FROM benchmark
    ), terms AS (
        SELECT kind, r, id, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM texts
    ), counts AS (
        SELECT r, id, term, count(*) AS tf FROM terms WHERE kind = 'd' GROUP BY ALL
    ), sizes AS (SELECT r, sum(tf)::BIGINT AS n FROM counts GROUP BY r),
    totals AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS length FROM sizes),
    lengths AS (SELECT r, 10 + (90 * n * docs) // length AS m FROM sizes, totals),
    weights AS (
        SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
        FROM counts, totals GROUP BY term
    ), wanted AS (SELECT DISTINCT r, id, term FROM terms WHERE kind = 'q'),
    scored AS (
        SELECT q.r AS item, q.id AS item_id, c.r AS doc, c.id AS doc_id,
            sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
        FROM wanted q JOIN counts c USING (term) JOIN weights USING (term) JOIN lengths l ON l.r = c.r
        GROUP BY ALL
    ), ranked AS (
        SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id)::INT AS rank,
            doc_id, score
        FROM scored WHERE score > 0
    )
    SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
    """
)
def op11_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten documents that rank highest for each benchmark item."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return lexical.search(docs, table(spark, folder, "benchmark").select("item_id", "text"), keep=10)
