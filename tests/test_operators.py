import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from juralake import queries
from juralake.operators import fusion, lexical, rerank, running, vector

V = "id string, embedding array<float>"


def test_search_against_brute_force(spark):
    import random

    rng = random.Random(3)
    rows = [(f"v{i}", [rng.gauss(0, 1) for _ in range(6)]) for i in range(120)]
    base = spark.createDataFrame(rows, V)
    queries = spark.createDataFrame([(i, rows[i][1], i % 4) for i in range(8)], "query_id int, embedding array<float>, n int")
    got = {}
    for r in vector.search(base, queries, k=3, limit="n").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id, r.similarity))

    def cos(a, b):
        import numpy as np

        a, b = np.float32(a).astype(float), np.float32(b).astype(float)
        return round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 6)

    for i in range(8):
        best = sorted(((-cos(rows[i][1], v), n) for n, v in rows if cos(rows[i][1], v) > 0))[: i % 4]
        assert [(n, pytest.approx(-s, abs=2e-6)) for s, n in best] == [(n, s) for _, n, s in sorted(got.get(i, []))]


def test_search_ties_bad_vectors_and_empty(spark):
    bad = [("a", [1.0, 0.0]), ("b", [2.0, 0.0]), ("c", [0.0, 0.0]), ("d", None), ("e", [math.nan, 1.0]), ("f", []), ("g", [1.0, 0.0, 0.0]), ("h", [-1.0, 0.0])]
    base = spark.createDataFrame(bad, V)
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None)], "query_id int, embedding array<float>")
    assert [(r.query_id, r.rank, r.id, r.similarity) for r in vector.search(base, q, k=1).collect()] == [(1, 1, "a", 1.0)]
    assert vector.search(base.limit(0), q).count() == 0 and vector.search(base, q.limit(0)).count() == 0


def test_search_keeps_doubles(spark):
    base = spark.createDataFrame([("a", [1.0, 1e-9]), ("b", [1.0, 0.5])], "id string, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.5])], "query_id int, embedding array<float>")
    got = vector.search(base, q, k=2).orderBy("rank").collect()
    assert [(r.id, r.similarity) for r in got] == [("b", 1.0), ("a", round(1 / math.sqrt(1.25), 6))]


def test_cosine_column(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0]), ([1.0], [1.0, 2.0])], "a array<float>, b array<float>")
    got = [r[0] for r in df.select(vector.cosine(F.col("a"), F.col("b"))).collect()]
    assert got[0] == pytest.approx(math.sqrt(0.5)) and got[1] == 0.0 and got[2] is None and got[3] is None


def test_conditions(spark):
    df = spark.createDataFrame([(1, "x", "d"), (2, "y", None), (3, None, "d")], "i int, source_api string, doc_type string")
    meta = {c: F.col(c) for c in ("source_api", "doc_type")}
    ids = lambda conds: {r.i for r in df.where(vector.matches_conditions(meta, conds)).collect()}
    assert ids(None) == {1, 2, 3} and ids([]) == set() and ids([{"source_api": "x", "doc_type": "d"}, {"source_api": "y"}]) == {1, 2} and ids([{}]) == {1, 2, 3}
    assert vector.resolve_filters(None) is None and vector.resolve_filters(["nope"]) is None and vector.resolve_filters([*vector.FILTERS]) is None
    assert vector.resolve_filters(["lois", "nope"]) == [{"source_api": "legifrance", "doc_type": "loi"}]
    assert len(vector.FILTERS) == 22 and len(vector.resolve_filters(["constitution_1946", "constitution_1848"])) == 1
    assert len(vector.resolve_filters(["constitution_1946", "constitution_1848"], every_key=True)) == 2


def test_rrf(spark):
    rows = [("q", 0, 0, "A"), ("q", 0, 1, "B"), ("q", 1, 0, "B"), ("q", 1, 1, None), ("q", 1, 2, "B")]
    lists = spark.createDataFrame(rows, "query_id string, list_no int, rank int, document string")
    got = fusion.reciprocal_rank_fusion(lists).orderBy("place").collect()
    assert [r.key for r in got] == ["B", "A", ""] and got[0].rrf_score == round(1 / 62 + 1 / 61 + 1 / 63, 10) and (got[0].first_list, got[0].first_rank) == (0, 1)
    assert fusion.reciprocal_rank_fusion(lists.limit(0)).count() == 0


def test_a_single_list_passes_through(spark):
    lists = spark.createDataFrame([(1, 0, 1, "B"), (1, 0, 0, "A"), (1, 0, 2, "A"), (2, 0, 0, "C"), (2, 1, 0, "C")], "query_id int, list_no int, rank int, document string")
    got = {(r.query_id, r.place): (r.key, r.rrf_score) for r in fusion.reciprocal_rank_fusion(lists).collect()}
    assert got == {(1, 1): ("A", None), (1, 2): ("B", None), (1, 3): ("A", None), (2, 1): ("C", round(2 / 61, 10))}
    assert fusion.reciprocal_rank_fusion(lists, pass_single=False).where("query_id = 1").count() == 2


def test_keep_first_union(spark):
    a, b = (spark.createDataFrame(x, "q int, id string") for x in ([(1, "a"), (1, "b")], [(1, "b"), (2, "b"), (1, None)]))
    got = {(r.q, r.id, r.origin) for r in fusion.keep_first_union(a, b, ["q", "id"]).collect()}
    assert got == {(1, "a", 1), (1, "b", 1), (2, "b", 2), (1, None, 2)}


def test_keywords_and_bm25(spark):
    texts = spark.createDataFrame([("1", "Liability and liability caps"), ("2", "reliability"), ("3", None), ("4", "")], "id string, content string")
    words = spark.createDataFrame([("liability",), (None,), ("",), ("absent",)], "keyword string")
    assert {(r.keyword, r.id) for r in lexical.contains_keywords(texts, words).collect()} == {("liability", "1"), ("liability", "2")}
    assert {r.id for r in lexical.contains_keywords(texts, words, hits=1).collect()} == {"1"}
    assert lexical.contains_keywords(texts, words.limit(0)).count() == 0
    q = spark.createDataFrame([(1, "LIABILITY liability"), (2, None), (3, "none")], "query_id int, query string")
    got = lexical.bm25(texts, q).collect()
    idf = math.log(1 + (2 - 1 + 0.5) / 1.5)
    assert [(r.query_id, r.id, r.score) for r in got] == [(1, "1", round(idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 4 / 2.5)), 6))]


def shuffled(spark, run):
    """The bytes that ``run`` writes into shuffles."""
    total = lambda: sum(e.totalShuffleWrite() for e in map(held().apply, range(held().size())))
    held = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False)
    before = total()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return total() - before


def test_bm25_makes_no_row_of_a_query_and_a_text(spark):
    texts = spark.range(1000).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("the law of contract number "), F.col("id") % 50).alias("content"))
    q = spark.range(300).select(F.col("id").alias("query_id"), F.concat(F.lit("the law of number "), F.col("id")).alias("query"))
    wrote = shuffled(spark, lambda: lexical.bm25(texts, q).collect())
    assert 0 < wrote < 1_000_000, wrote  # there are 300,000 pairs


@pytest.mark.parametrize("name", ["agentic_search", "decomposed_search"])
def test_searches_make_no_row_of_a_query_and_a_text(spark, tmp_path, name):
    text = F.concat(F.lit("the law of contract number "), F.col("id") % 50)
    spark.range(1000).select(F.col("id").cast("string").alias("id"), text.alias("content")).write.parquet(f"{tmp_path}/chunks.parquet")
    spark.range(300).select(F.col("id").alias("query_id"), F.concat(F.lit("the law of number "), F.col("id")).alias("query")).write.parquet(f"{tmp_path}/search_queries.parquet")
    wrote = shuffled(spark, lambda: queries.queries()[name](spark, str(tmp_path)).collect())
    assert 0 < wrote < 1_000_000, wrote  # there are 300,000 pairs


def test_bm25_by_blocks_equals_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    common, rare = [f"c{i}" for i in range(12)], [f"r{i}" for i in range(300)]
    rows = [(f"t{i:04d}", " ".join(rng.choices(common, k=rng.randint(1, 30)) + rng.choices(rare, k=rng.randint(0, 3)))) for i in range(600)]
    rows += [(f"u{i}", rows[i][1]) for i in range(50)] + [("e", ""), ("n", None), ("z", "?")]
    asked = [(i, " ".join(rng.sample(common, rng.randint(0, 6)) + rng.sample(rare, rng.randint(0, 2)) + ["absent"])) for i in range(80)] + [(900, "c1"), (901, "c1 C1"), (902, None)]
    sizes = {i: len(t.split()) for i, t in rows if t and t != "?"}
    counts = {i: Counter(t.split()) for i, t in rows if i in sizes}
    df, mean = Counter(w for c in counts.values() for w in c), sum(sizes.values()) / len(sizes)
    told = set()
    for q, words in asked:
        terms = sorted({w.lower() for w in (words or "").split()})
        scores = {i: sum(math.log(1 + (len(sizes) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sizes[i] / mean)) for w in terms if c[w]) for i, c in counts.items()}
        best = sorted((-round(s, 6), i) for i, s in scores.items() if s > 0)[:5]
        told |= {(q, i, -s, n + 1) for n, (s, i) in enumerate(best)}
    monkeypatch.setattr(lexical, "BLOCK_POSTINGS", 700, raising=False)
    monkeypatch.setattr(lexical, "TERMS", 100, raising=False)
    texts, queries = spark.createDataFrame(rows, "id string, content string"), spark.createDataFrame(asked, "query_id int, query string")
    got = lexical.bm25(texts, queries).collect()
    assert {(r.query_id, r.id, r.score, r["rank"]) for r in got} == told and len(got) == len(told)
    assert lexical.bm25(texts.limit(0), queries).count() == lexical.bm25(texts, queries.limit(0)).count() == 0


def test_maxsim_and_rerank(spark):
    df = spark.createDataFrame([([1.0, 0.0], [[0.0, 1.0], [1.0, 0.0], [2.0, 0.0]]), ([0.0, 0.0], [[1.0, 0.0]]), ([1.0, 0.0], []), ([1.0, 0.0], None)], "q array<float>, s array<array<float>>")
    got = [r[0] for r in df.select(rerank.maxsim(F.col("q"), F.col("s"))).collect()]
    assert (got[0].score, got[0].best) == (1.0, 1) and (got[1].score, got[1].best) == (0.0, 0) and got[2] is None and got[3] is None
    c = spark.createDataFrame([(1, "a", 1, 0.2), (1, "b", 2, 0.9), (1, "c", 3, 0.9), (1, "d", 4, None)], "query_id int, id string, original_rank int, s double")
    out = rerank.reranked(c, F.col("s")).orderBy("reranked_position").collect()
    assert [r.id for r in out] == ["b", "c", "a", "d"]
    pairs = spark.createDataFrame([("a b", "B c"), ("", ""), (None, "x")], "q string, t string")
    assert [r[0] for r in pairs.select(rerank.lexical_overlap(F.col("q"), F.col("t"))).collect()] == [round(1 / 3, 6), 0.0, 0.0]


def test_running_sum_over_a_hot_group(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 3 == 0, None).otherwise(F.lit("hot")).alias("g"), "id", (F.col("id") % 7).alias("x"))
    got = running.running_sum(df, ["g"], [F.floor(F.col("id") / 100)], [F.col("id")], F.col("x"), "total").collect()
    sums = {}
    for r in sorted(got, key=lambda r: r.id):
        sums[r.g] = sums.get(r.g, 0) + r.x
        assert r.total == sums[r.g]
    assert len(got) == 1000


def test_rank_by_range_of_ties(spark):
    df = spark.range(500).select(F.lit("g").alias("g"), "id", F.lit(1.0).alias("s"))
    got = {r.id: r.place for r in running.rank_by_range(df, ["g"], [F.col("s").desc(), F.col("id")], "place").collect()}
    assert got == {i: i + 1 for i in range(500)}
    assert running.rank_by_range(df.limit(0), ["g"], [F.col("id")], "place").count() == 0


def test_keywords_in_slices(spark, monkeypatch):
    monkeypatch.setattr(lexical, "AUTOMATON_WORDS", 2)
    texts = spark.createDataFrame([(i, f"word{i % 5} and word{(i + 1) % 5}") for i in range(40)], "id int, content string")
    words = spark.createDataFrame([(f"word{i}",) for i in range(5)], "keyword string")
    got = {(r.keyword, r.id) for r in lexical.contains_keywords(texts, words, hits=3).collect()}
    assert got == {(f"word{k}", i) for k in range(5) for i in sorted(i for i in range(40) if k in (i % 5, (i + 1) % 5))[:3]}


def test_first_deliveries(spark, tmp_path):
    from juralake.sources import tables

    rows = [("a", "x", 1), ("b", "y", 2), ("a", "x", 3), (None, "z", 4), ("c", None, 5), ("a", "x", 6)]
    spark.createDataFrame(rows, "id string, content string, file int").repartition(3).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert sorted(tables.first_deliveries(df, "content").collect()) == [("a", "x"), ("b", "y"), ("c", None)]
    assert sorted(tables.first_deliveries(df, "content", "file").select("id").collect()) == [("a",), ("b",), ("c",)]
    assert "Exchange hashpartitioning(id" not in tables.first_deliveries(df, "content")._jdf.queryExecution().executedPlan().toString()


def test_rows_of_a_sample(spark, tmp_path):
    from juralake.sources import tables

    spark.range(0, 100, 1, 5).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("t"), "id").alias("content")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    chosen = spark.createDataFrame([("3", "a"), ("97", "b"), ("x", "c")], "id string, label string")
    assert sorted(map(tuple, tables.rows_of_sample(df, chosen, "id", "content").collect())) == [("3", "t3", "a"), ("97", "t97", "b")]
    assert len(tables.rows_of_sample(df, chosen, "id", "content").inputFiles()) == 2
    assert tables.rows_of_sample(df, chosen.limit(0), "id", "content").count() == 0
    assert tables.rows_of_sample(spark.createDataFrame([("3", "z")], "id string, content string"), chosen, "id", "content").count() == 1


def test_contract_chunks_reads_whole_texts(spark, sf):
    size = {r.doc_id: r.n for r in spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "length(trim(text)) AS n").where("n > 1000").collect()}
    held = {}
    for r in queries.contract_chunks(spark, sf).collect():
        held[r.doc_id] = held.get(r.doc_id, 0) + r.end_char - r.start_char
    assert size and all(held[k] > 0.8 * n for k, n in size.items())
