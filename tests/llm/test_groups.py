"""Sharding, line dedup, SimHash, nearest neighbours and suffix dedup against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from courtside.llm import lines, nearest, sharding, simhash, suffix
from courtside.llm.graph import components

LONG = "words of many kinds and sizes " * 3000


def words(draw, n, vocabulary=60):
    return " ".join(f"w{draw.randint(0, vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, shared passages, periodic texts and odd rows."""
    draw = random.Random(5)
    base = [words(draw, draw.randint(1, 160), 4000) for _ in range(60)]
    rows = list(enumerate(base))
    for i in range(60, 100):
        text = draw.choice(base).split()
        for _ in range(draw.randint(0, 2)):
            text[draw.randrange(len(text))] = "changed"
        rows.append((i, "\n".join([words(draw, 8, 4000), " ".join(text)])))
    passage = words(draw, 120, 4000)
    rows += [(100 + i, f"{words(draw, 40, 4000)} {passage} {words(draw, 40, 4000)}") for i in range(12)]
    rows += [(120, "abcde" * 200), (121, "x" * 450), (122, "x" * 399), (123, None), (124, ""), (124, "")]
    rows += [(None, base[0]), (125, base[1]), (125, base[1]), (126, " \n \n"), (127, LONG), (1 << 60, base[2])]
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    schema = "doc_id bigint, text string, _k string, n_removed string, `a.b` int"
    return spark.createDataFrame([(i, t, "k", "r", 1) for i, t in corpus], schema).repartition(5)


class TestSharding:
    @pytest.mark.parametrize("shards", [1, 3, 8])
    def test_counts_and_links(self, docs, corpus, shards):
        linked = docs.withColumn("shard", docs["text"]).withColumn("link", docs["text"])
        out = sharding.balanced_shards(linked, "link", shards=shards)
        assert out.columns == [*docs.columns, "link", "shard", "slot"]
        rows = out.collect()
        assert Counter((r.doc_id, r.text) for r in rows) == Counter(corpus)
        counts = Counter(r.shard for r in rows)
        assert max(counts.values()) - min(counts.values()) <= 1 and set(counts) == set(range(shards))
        for shard in counts:
            assert sorted(r.slot for r in rows if r.shard == shard) == list(range(counts[shard]))
        homes = defaultdict(set)
        for r in rows:
            if r.text is not None:
                homes[r.text].add(r.shard)
        assert all(len(h) == 1 for h in homes.values())

    def test_one_large_group_is_cut_no_more_than_needed(self, spark):
        rows = [(i, "same" if i < 500 else str(i)) for i in range(1000)]
        out = sharding.balanced_shards(spark.createDataFrame(rows, "id int, link string"), "link", 8)
        counts = Counter(r.shard for r in out.collect() if r.link == "same")
        assert len(counts) <= 5 and Counter(r.shard for r in out.collect()) == dict.fromkeys(range(8), 125)

    def test_empty_table(self, docs):
        assert sharding.balanced_shards(docs.limit(0), "text").count() == 0


class TestLines:
    def test_against_all_pairs(self, docs, corpus):
        out = lines.dedup_lines(docs, 0.8)
        assert out.columns == ["doc_id", "text", "_k", "a.b", "n_lines", "n_removed"]
        rows = out.collect()
        assert len(rows) == len(corpus)
        distinct = sorted({(i, t) for i, t in corpus if t is not None}, key=lambda r: (r[0] is not None, r[0] or 0))
        earlier, want = [], {}
        for doc, text in distinct:
            kept = []
            for line in text.split("\n"):
                found = set(line.lower().split())
                similar = found and any(len(found & e) >= 0.8 * len(found | e) - 1e-9 for e in earlier)
                if not similar:
                    kept.append(line)
                if found:
                    earlier.append(found)
            want[doc, text] = "\n".join(kept)
        source = Counter((i, want.get((i, t))) for i, t in corpus)
        assert Counter((r.doc_id, r.text) for r in rows) == source

    def test_ids_with_several_texts(self, spark):
        rows = [(1, "one two three four five six"), (1, "one two three four five seven"), (1, None), (None, "")]
        out = lines.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string"), 0.7).collect()
        assert sorted(r.n_removed for r in out) == [0, 0, 0, 1]
        assert sorted(r.n_lines for r in out) == [0, 1, 1, 1]

    def test_large_groups_find_partners(self):
        draw = np.random.default_rng(2)
        size = 700
        rows = {
            "token": np.repeat([1, 2], size // 2).astype(np.int64),
            "key": np.arange(size),
            "n": draw.integers(5, 40, size),
            "pos": draw.integers(0, 5, size),
            "bits": draw.integers(0, 1 << 20, size).astype(np.uint64),
        }
        got = lines._partnered(rows, 0.8)
        i, j = np.meshgrid(np.arange(size), np.arange(size), indexing="ij")
        near = lines._passes(rows, i.ravel(), j.ravel(), 0.8).reshape(size, size)
        near &= (i != j) & (rows["token"][i] == rows["token"][j])
        assert (got == near.any(axis=1)).all()

    def test_long_lines_under_common_words_are_told_apart(self, spark):
        draw = np.random.default_rng(3)
        texts = [" ".join(f"w{i}" for i in draw.choice(2000, 250, replace=False)) for _ in range(40)]
        texts.append(texts[0] + " more")
        rows = list(enumerate(texts))
        docs = spark.createDataFrame(rows, "_id bigint, _text string").selectExpr("_id", "_id AS _hash", "_text")
        ranks, size = lines._word_ranks(docs)
        assert size == sum(map(len, texts))
        table = lines._line_table(docs, ranks, 0.8)
        keys = {r.key for r in table.where("doc IN (0, 40)").collect()}
        # Any two share words, and nothing but the near copy has a partner.
        assert {r.key for r in lines._survivors(table, 0.8, 4).collect()} == keys and len(keys) == 2

    def test_lines_of_many_sizes_at_low_similarity(self, spark):
        draw = np.random.default_rng(4)
        sets = [set(draw.choice(300, size, replace=False).tolist()) for size in draw.integers(1, 260, 60)]
        texts = [" ".join(f"w{i}" for i in found) for found in sets]
        similarity = 0.3
        near = [any(len(x & y) >= similarity * len(x | y) - 1e-9 for y in sets[:i]) for i, x in enumerate(sets)]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
        got = {r.doc_id: r.n_removed for r in lines.dedup_lines(docs, similarity).collect()}
        assert got == {i: int(x) for i, x in enumerate(near)} and 0 < sum(near) < len(near)

    @pytest.mark.parametrize("stride", [8, 1 << 16])
    def test_words_are_those_of_split(self, monkeypatch, stride):
        monkeypatch.setattr(lines, "_STRIDE", stride)
        lines._cached_powers.cache_clear()
        blanks = [chr(c) for c in range(0x3001) if chr(c).isspace()]
        texts = ["", "\n", " a\nAB a", "ΑΣ\nΑΣ x\x1cy"] + [f"ab{x}Ab{x}{x}ba \n{x}" for x in blanks]
        split = [line.lower().split() for text in texts for line in text.split("\n")]
        counts, hashed = lines._words(texts)
        lines._cached_powers.cache_clear()
        assert counts.tolist() == [len(words) for words in split]
        flat = [word for words in split for word in words]
        assert len(set(zip(flat, hashed.tolist(), strict=True))) == len(set(flat)) == len(set(hashed.tolist()))

    def test_groups_cut_into_blocks_find_the_same(self, monkeypatch):
        draw = np.random.default_rng(5)
        size = 1500
        n = draw.integers(5, 200, size)
        rows = {
            "token": np.sort(draw.integers(1, 4, size)),
            "n": n,
            "pos": draw.integers(0, 3, size),
            **lines._spread_bits(n, draw.integers(0, 1 << 12, lines._widths(n).sum()).astype(np.uint64)),
        }
        want = lines._partnered(rows, 0.8)
        monkeypatch.setattr(lines, "_LARGE", 40)
        monkeypatch.setattr(lines, "_BLOCK", 64)
        assert (lines._partnered(rows, 0.8) == want).all() and 0 < want.sum() < size

    def test_empty_table(self, docs):
        assert lines.dedup_lines(docs.limit(0)).count() == 0


class TestSimHash:
    def test_against_all_pairs(self, docs, corpus):
        rows = simhash.simhash_groups(docs).collect()
        prints = [(i, simhash.fingerprint_of(t or "")) for i, t in corpus]
        want = {}
        values = sorted({p for _, p in prints})
        root = {v: v for v in values}
        for a in values:
            for b in values:
                if (a ^ b).bit_count() <= 3:
                    low, high = sorted((root[a], root[b]))
                    root = {v: low if r == high else r for v, r in root.items()}
        for doc, value in prints:
            if doc is not None:
                want[root[value]] = min(want.get(root[value], doc), doc)
        got = Counter((r.doc_id, r._fp & (1 << 64) - 1, r.component_id) for r in rows)
        assert got == Counter((i, p, want.get(root[p])) for i, p in prints)

    def test_buckets_cut_into_parts(self, spark, monkeypatch):
        monkeypatch.setattr(simhash, "_CHUNK", 4)
        values = sorted({(1 << i) | (1 << j) for i in range(0, 9) for j in range(i)} | {0, 1 << 63 - 1})
        made = simhash.near_links(spark.createDataFrame([(v,) for v in values], "_fp bigint")).collect()
        root = {v: v for v in values}
        for a, b in made:
            low, high = sorted((root[a], root[b]))
            root = {v: low if r == high else r for v, r in root.items()}
        assert len({root[v] for v in values if v < 1 << 40}) == 1
        assert root[1 << 62] == 0 or root[1 << 62] == min(root.values())

    def test_bit_slices_count_exactly(self):
        draw = np.random.default_rng(3)
        values = draw.integers(0, 1 << 62, 130).astype(np.uint64)
        flips = np.array([np.bitwise_xor.reduce([np.uint64(1) << np.uint64(b) for b in draw.integers(0, 64, k % 6)] or [np.uint64(0)]) for k in range(130)])
        queries = values ^ flips
        for radius in (0, 1, 2, 3):
            i, j = simhash.within_radius(queries, simhash.bit_planes(values), len(values), radius)
            far = np.bitwise_count(queries[:, None] ^ values[None, :])
            assert set(zip(i.tolist(), j.tolist())) == set(zip(*map(np.ndarray.tolist, np.nonzero(far <= radius))))

    def test_chain_of_links(self, spark):
        links = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 501), (7, 7)], "a bigint, b bigint")
        got = {r.node: r.root for r in components(links, "chain").collect()}
        assert got == {**dict.fromkeys(range(101), 0), 500: 500, 501: 500}

    def test_empty_table(self, docs):
        assert simhash.simhash_groups(docs.limit(0)).count() == 0


class TestNearest:
    def test_recall_ties_and_odd_vectors(self, spark):
        draw = np.random.default_rng(4)
        points = draw.normal(size=(900, 12)) * draw.uniform(0.5, 2, (900, 1))
        rows = [(i, p.tolist()) for i, p in enumerate(points)]
        rows += [(1000 + i, points[0].tolist()) for i in range(60)]
        odd = [(2000, None), (2001, [0.0] * 12), (2002, [float("nan")] * 12), (2003, [None] * 12)]
        odd += [(2004, [float("inf")] * 12), (2005, [1.0]), (None, points[1].tolist()), (5, points[5].tolist())]
        frame = spark.createDataFrame([(i, v, 1) for i, v in rows + odd], "vec_id bigint, embedding array<float>, rank int")
        out = nearest.nearest(frame, frame.where("vec_id % 20 = 0"), keep=10, lists=16, probes=12).collect()
        vectors = {i: np.array(v, dtype=np.float32).astype(float) for i, v in rows}
        by = defaultdict(list)
        for r in out:
            by[r.query_id].append(r)
        assert set(by) == {i for i in vectors if i % 20 == 0}
        hits = 0
        for query, found in by.items():
            found.sort(key=lambda r: r.rank)
            assert [r.rank for r in found] == list(range(1, 11))
            score = {i: float((v * vectors[query]).sum()) for i, v in vectors.items() if i != query}
            want = sorted(score, key=lambda i: (-score[i], i))[:10]
            hits += len(set(want) & {r.vec_id for r in found})
            assert all(abs(score[r.vec_id] - r.score) < 1e-12 for r in found)
            assert [(r.score, r.vec_id) for r in found] == sorted(((r.score, r.vec_id) for r in found), key=lambda x: (-x[0], x[1]))
        assert hits >= 0.9 * 10 * len(by)

    def test_width_is_that_of_most_vectors(self, spark):
        """The row with the smallest hash is the malformed one."""
        first = spark.range(100).orderBy(F.xxhash64("id"), "id").first().id
        rows = [(i, [1.0] if i == first else [1.0, float(i)]) for i in range(100)]
        frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
        out = nearest.nearest(frame, frame, keep=3, lists=4, probes=4).collect()
        assert Counter(r.query_id for r in out) == {i: 3 for i in range(100) if i != first}

    def test_fewer_candidates_than_asked_for_and_empty(self, spark):
        schema = "vec_id bigint, embedding array<float>"
        few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 0.0])], schema)
        out = nearest.nearest(few, few.where("vec_id = 0"), keep=20).collect()
        assert [(r.rank, r.vec_id) for r in sorted(out, key=lambda r: r.rank)] == [(1, 2), (2, 1)]
        assert nearest.nearest(few.limit(0), few.limit(0)).count() == 0
        assert nearest.nearest(few, few.limit(0)).count() == 0


def removed_by_brute_force(corpus, length):
    starts = Counter()
    texts = [(t or "").encode() for _, t in corpus]
    for text in texts:
        starts.update(text[i : i + length] for i in range(len(text) - length + 1))
    out = []
    for (doc, _), text in zip(corpus, texts, strict=True):
        gone = np.zeros(len(text), dtype=bool)
        for i in range(len(text) - length + 1):
            if starts[text[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append((doc, len(text), bytes(b for b, g in zip(text, gone) if not g)))
    return Counter(out)


class TestSuffix:
    @pytest.mark.parametrize("length,shard", [(400, 2 << 20), (60, 1500)])
    def test_against_all_strings(self, docs, corpus, length, shard, monkeypatch):
        monkeypatch.setattr(suffix, "SHARD_BYTES", shard)
        small = [(i, t) for i, t in corpus if t != LONG or length > 100]
        rows = suffix.drop_repeats(docs.where(docs["text"].isNull() | (docs["text"] != ("" if length > 100 else LONG)) | (docs["text"] == "")), length).collect()
        want = removed_by_brute_force(small, length)
        assert Counter((r.doc_id, r.n_bytes, bytes(r.kept)) for r in rows) == want
        for r in rows:
            runs = list(zip(r.begins, r.ends))
            assert sum(b - a for a, b in runs) == r.n_bytes - len(r.kept)
            assert all(b < c for (_, b), (c, _) in zip(runs, runs[1:]))

    def test_ranks_tell_exactly_the_depth(self):
        data = np.random.default_rng(3).integers(97, 99, 400).astype(np.uint8)
        texts = data.tobytes()
        for depth in (5, 8, 12, 20):
            order, rank = suffix.suffix_array(data, depth)
            alike = [texts[i : i + depth] for i in order]
            assert alike == sorted(alike)
            ranks = rank[order].tolist()
            assert [a == b for a, b in zip(alike, alike[1:], strict=False)] == [
                a == b for a, b in zip(ranks, ranks[1:], strict=False)
            ]

    def test_suffix_array_and_prefixes(self):
        draw = np.random.default_rng(6)
        data = np.concatenate([draw.integers(97, 99, 300), np.full(60, 98), draw.integers(97, 99, 300)]).astype(np.uint8)
        data = np.concatenate([data, data[:250]])
        order, _ = suffix.suffix_array(data, len(data))
        body = data.tobytes()
        assert order.tolist() == sorted(range(len(body)), key=lambda i: body[i:])
        common = suffix.common_prefixes(data, order, 1000)
        for i in range(1, len(order)):
            a, b = body[order[i - 1] :], body[order[i] :]
            same = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
            assert common[i] == same

    def test_empty_table(self, docs):
        assert suffix.drop_repeats(docs.limit(0)).count() == 0
