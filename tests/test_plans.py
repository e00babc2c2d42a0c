import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from juralake import oracles
from juralake import queries as core
from juralake.operators import ann, fusion, vector
from juralake.plans import agentic, providers, retrieve, workflow
from juralake.sources import store
from juralake.streaming import ingest


def test_every_oracle_has_a_query():
    assert set(oracles.oracle_sql()) <= set(core.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 10


@pytest.mark.parametrize("name", ["structured_chunks", "contract_chunks", "colbert_sentences", "simple_chunks", "query_dataset", "query_collection", "colbert_search", "decomposed_search", "agentic_search", "adaptive_params", "rrf_fusion", "keyword_search", "chunk_overlap", "query_class", "settings_merge", "vector_topk_batch", "legal_refs"])
def test_queries_equal_their_oracles(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "chunks", "embeddings", "search_queries", "colbert_results", "collections", "embedding_models"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = core.queries()[name](spark, sf).toPandas()
    told = con.sql(oracles.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(told.columns)
    plain = lambda df: sorted(map(repr, df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False, name=None)))
    assert plain(got) == plain(told)


def test_store(spark):
    chunks = spark.createDataFrame([("1", "c1", "x", "{}"), ("1", "c1", "x", "{}"), ("2", "c2", None, None), (None, "c1", "y", None)], "id string, collection_id string, content string, metadata string")
    colls = store.create_collection(spark, "one").unionByName(store.create_collection(spark, "two", "u", {"sac_enabled": True}))
    again = store.get_or_create(colls, store.create_collection(spark, "two"))
    assert again.count() == 2 and store.by_name(colls, "one").count() == 1
    with pytest.raises(LookupError):
        store.by_name(colls, "none")
    settings = {r.name: r.settings for r in store.with_settings(colls).collect()}
    assert settings["one"].search_mode == "hybrid" and settings["two"].sac_enabled and not settings["one"].sac_enabled
    ids = spark.createDataFrame([("1",), ("9",), (None,)], "id string")
    assert [r.id for r in store.get(chunks, ids).collect()] == ["1"]
    assert {r.id for r in store.delete(chunks, ids).collect()} == {"2", None}
    renamed = spark.createDataFrame([("c1", "one", "{}"), ("c2", "two", None)], "id string, name string, metadata string")
    assert {(r.id, r.n_chunks) for r in store.counts(renamed, chunks).collect()} == {("c1", 1), ("c2", 1)}
    left, rest = store.delete_collection(renamed, chunks, "one")
    assert left.count() == 1 and {r.id for r in rest.collect()} == {"2"}
    assert store.legal_sources(renamed.withColumn("metadata", F.lit('{"source_type": "legal_source"}'))).count() == 2 and store.legal_sources(renamed).count() == 0
    assert store.for_tenant(colls, "u").count() == 1


def test_insert_and_files(spark, tmp_path):
    rows = store.insert_json(spark, '[{"id": "a", "content": "x\\u0000y"}, {"content": "z", "metadata": {"k": "v"}}]', "c1").collect()
    assert rows[0].id == "a" and rows[0].content == "xy" and len(rows[1].id) == 64 and rows[1].metadata == '{"k":"v"}'
    assert store.insert_json(spark, "not json", "c1").count() == 0
    (tmp_path / "a_2020.txt").write_text("hello")
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe\xfa")
    got = {r.source: r for r in store.scan_files(spark, str(tmp_path)).collect()}
    assert got["a_2020.txt"].content == "hello" and got["b.txt"].content is None and got["b.txt"].error
    assert "2020" in spark.range(1).select(store.base_metadata(F.lit("a_2020.txt"))).first()[0]
    store.append(store.insert_json(spark, '[{"content": "z"}]', "c1"), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1


def test_registry(spark):
    models = store.embedding_models(spark)
    df = spark.createDataFrame([(1, "voyage-3-large"), (2, "?"), (3, None)], "i int, model string")
    got = {r.i: (r.model, r.chunk_size) for r in store.with_model(df, models, "text-embedding-3-small").collect()}
    assert got == {1: ("voyage-3-large", 384), 2: ("text-embedding-3-small", 256), 3: ("text-embedding-3-small", 256)}


def test_providers(spark):
    df = spark.createDataFrame([(1, "alpha beta", 9), (2, None, 9), (3, "", 9)], "i int, t string, embedding int").drop("embedding")
    got = {r.i: r.embedding for r in providers.embedded(df, "t", providers.HashedWords).collect()}
    assert len(got[1]) == 64 and abs(sum(x * x for x in got[1]) - 1) < 1e-5 and got[2] is None and not any(got[3])
    replies = {r.i: r.reply for r in providers.completed(df, "t", lambda: providers.TemplateCompleter("<{prompt}>")).collect()}
    assert replies == {1: "<alpha beta>", 2: None, 3: "<>"}
    hyde = {r.i: r.expanded for r in providers.hypothetical(df, "t", lambda: providers.TemplateCompleter("H {prompt}")).collect()}
    assert hyde == {1: "H alpha beta", 2: None, 3: ""}
    assert all(0.75 * min(2**n, 60) <= providers.backoff(n) <= 1.25 * min(2**n, 60) for n in range(12))


def corpus(spark):
    texts = ["liability caps apply to carriers", "carriers owe damages", "tax rates rise", "liability of banks"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, content string")
    return providers.embedded(df, "content", providers.HashedWords)


def test_query_dataset(spark):
    chunks = corpus(spark)
    q = providers.embedded(spark.createDataFrame([(1, "liability caps"), (2, "rates")], "query_id int, query string"), "query", providers.HashedWords, task="query")
    assert retrieve.query_dataset(chunks, q, n=1).where("query_id = 1").first().id == "0"
    assert [r.place for r in retrieve.query_dataset(chunks, q, n=2).where("query_id = 1").orderBy("place").collect()] == [1, 2]
    loose = retrieve.query_dataset(chunks, q, n=1, reranking=False, legacy_untruncated=True)
    assert loose.count() > retrieve.query_dataset(chunks, q, n=1, reranking=False).count()
    plain = retrieve.query_dataset(chunks, q, n=1, hybrid=False).collect()
    assert len(plain) == 2
    filtered = retrieve.query_dataset(chunks, q, n=3, conditions=[{"id": "3"}], metadata={"id": F.col("id")}).collect()
    assert {r.id for r in filtered} == {"3"}


def test_colbert_and_decomposed(spark):
    chunks = corpus(spark).withColumn("sentence_embeddings", F.when(F.col("id") != "3", F.array("embedding"))).withColumn("sentence_texts", F.array("content"))
    q = providers.embedded(spark.createDataFrame([(1, "liability caps apply to carriers")], "query_id int, query string"), "query", providers.HashedWords)
    got = retrieve.colbert_search(chunks, q).orderBy("place").collect()
    assert got[0].id == "0" and got[0].colbert_score == 1.0 and got[0].match.startswith("liability")
    asked = spark.createDataFrame([(1, "compare liability caps and tax rates"), (2, "tax")], "query_id int, query string")
    parts = retrieve.decomposed(asked, lambda: providers.TemplateCompleter('["liability caps", "tax rates"]')).collect()
    assert {(r.query_id, r.part, r.query) for r in parts} == {(1, 0, "liability caps"), (1, 1, "tax rates"), (2, 0, "tax")}
    search = retrieve.vector_of(chunks, providers.HashedWords)
    fused = retrieve.decomposed_search(chunks, asked, lambda: providers.TemplateCompleter('["liability caps", "tax rates"]'), search).collect()
    assert {r.query_id for r in fused} == {1, 2} and all((r.rrf_score is None) == (r.query_id == 2) for r in fused)
    lone = retrieve.colbert_search(chunks.withColumn("sentence_embeddings", F.array(F.array(F.lit(float("nan")).cast("float")))), q).first()
    assert lone.best_sentence is None and lone.colbert_score is not None


def test_agentic_stops_and_follows(spark):
    asked = spark.createDataFrame([(1, "a", ["a", "b"]), (2, "x", None)], "query_id int, query string, planned array<string>")
    search = lambda q: q.select("query_id", F.lit(1).alias("rank"), F.concat(F.lit("doc of "), "query").alias("document"))
    judge = lambda active, found: active.select("query_id", F.lit(0.1).alias("relevance"), F.lit(False).alias("sufficient"), F.lit(None).cast("string").alias("next_query"))
    results, history = agentic.agentic_search(asked, search, judge)
    assert {(r.query_id, r.key) for r in results.collect()} == {(1, "doc of a"), (1, "doc of b"), (2, "doc of x")}
    assert history.count() == 3


def test_workflow(spark):
    df = spark.createDataFrame([(1, "en", 900), (2, None, 40), (3, "fr", None)], "id int, lang string, n_chars int")
    got = {r.id: r for r in workflow.run(workflow.EXAMPLE, df, workflow.Handlers()).collect()}
    assert got[1].output == "long en text of 900: 225 tokens" and got[2].long is None and got[2].output == ": 10 tokens" and got[3].route is None
    assert workflow.ordered(workflow.EXAMPLE)[-1] == "both"
    with pytest.raises(ValueError):
        workflow.run({"nodes": [{"id": "s", "type": "start"}, {"id": "x", "type": "odd"}], "edges": [{"from": "s", "to": "x"}]}, df, workflow.Handlers())
    halting = {"nodes": [{"id": "s", "type": "start"}, {"id": "r", "type": "router", "data": {"condition": "n_chars > 100"}}, {"id": "e", "type": "action", "data": {"template": "hi"}}], "edges": [{"from": "s", "to": "r"}, {"from": "r", "to": "e"}]}
    assert {r.id: r.status for r in workflow.run(halting, df, workflow.Handlers()).collect()} == {1: "completed", 2: "halted", 3: "halted"}


def test_ingest_is_the_batch_transform(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    docs.limit(40).write.parquet(folder)
    for _ in range(2):  # a second run finds nothing new
        ingest.ingest(ingest.read_documents(spark, folder, docs.schema), out, str(tmp_path / "cp")).awaitTermination()
    streamed = {r.id for r in spark.read.parquet(out).collect()}
    batch = ingest.chunk_stream(spark.read.parquet(folder)).collect()
    assert streamed == {r.id for r in batch} and spark.read.parquet(out).count() == len(batch) > 0


def test_embedding_rerank_and_stats(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", None)], "id string, embedding array<float>")
    q = spark.createDataFrame([(1, [0.1, 1.0])], "query_id int, embedding array<float>")
    c = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (1, "d", 21), (2, "a", 1)], "query_id int, id string, rank int")
    got = [(r.query_id, r.id, r.reranked_position) for r in retrieve.embedding_rerank(c, v, q).orderBy("query_id", "reranked_position").collect()]
    assert got == [(1, "b", 1), (1, "a", 2), (1, "c", 3), (2, "a", 1)]
    rows = spark.createDataFrame([(1, 0.5, [0.1]), (1, 1.0, None), (2, None, [])], "query_id int, s double, v array<double>")
    stats = {r.query_id: (r.results, r.avg_score, r.with_vectors) for r in fusion.result_stats(rows, "query_id", "s", "v").collect()}
    assert stats == {1: (2, 0.75, 1), 2: (1, None, 0)}
    zipped = spark.createDataFrame([(1, ["a", "b"], [1.0]), (2, None, [2.0]), (3, None, None)], "i int, t array<string>, s array<double>")
    assert [(r.i, r.pos, r.t, r.s) for r in fusion.positional(zipped, "t", "s", keep=("i",)).orderBy("i", "pos").collect()] == [(1, 0, "a", 1.0), (1, 1, "b", None), (2, 0, None, 2.0)]


def test_index_recall(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    v = rng.normal(size=(2000, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(5000, [float("nan")] * 16), (5001, None), (5002, [1.0])], "vec_id bigint, embedding array<float>")
    q = spark.createDataFrame([(i, v[i].tolist()) for i in range(60)], "query_id bigint, embedding array<float>")
    index = ann.Index(df, lists=30, ident="vec_id")
    assert index.table.count() == 2000
    s = v[:60] @ v.T / np.linalg.norm(v, axis=1)
    told = {(i, int(j)) for i in range(60) for j in np.argsort(-s[i])[:5]}
    got = {(r.query_id, r.vec_id) for r in index.search(q, probes=15).collect()}
    assert len(got & told) >= 0.9 * len(told)
    exact = {(r.query_id, r.vec_id) for r in index.search(q, probes=30).collect()}
    assert exact == told
    assert ann.Index(df.limit(0), ident="vec_id").search(q).count() == 0


def test_search_in_groups_and_blocks(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(vector, "BLOCK", 7)
    rng = np.random.default_rng(6)
    v = rng.normal(size=(50, 5)).astype(np.float32)
    base = spark.createDataFrame([(f"i{i:02}", x.tolist(), f"g{i % 3}" if i % 10 else None, i % 4) for i, x in enumerate(v)], "id string, embedding array<float>, g string, label int")
    q = spark.createDataFrame([(1, v[3].tolist(), "g0", 2), (2, v[4].tolist(), None, 9), (3, v[5].tolist(), "g2", 0)], "query_id int, embedding array<float>, g string, n int")
    got = {(r.query_id, r.rank): r.id for r in vector.search(base, q, 4, within="g", limit="n").collect()}
    assert got[1, 1] == "i03" and {k for k, _ in got} == {1} and len(got) == 2 and all(int(x[1:]) % 3 == 0 for x in got.values())
    s = np.round((v[[3, 4, 5]] / np.linalg.norm(v[[3, 4, 5]], axis=1, keepdims=True)).astype(float) @ (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(float).T, 6)
    best = {(r.query_id, r.label): r.best for r in vector.best_of_groups(base, q, "label").collect()}
    assert best == {(i + 1, g): f"i{max(range(g, 50, 4), key=lambda j: s[i][j]):02}" for i in range(3) for g in range(4)}


def test_provider_manners(spark):
    tries = []

    def call():
        tries.append(1)
        if len(tries) < 3:
            raise providers.Transient
        return "done"

    waited = []
    assert providers.retried(call, wait=waited.append) == "done" and len(waited) == 2
    with pytest.raises(providers.Transient):
        providers.retried(lambda: (_ for _ in ()).throw(providers.Transient()), attempts=2, wait=waited.append)
    make = providers.once("test", lambda: object())
    assert make() is make()
    makes = {"cohere": lambda: providers.HashedWords(8), "voyage": providers.HashedWords}
    assert providers.routed("embed-v3", store.EMBEDDING_MODELS, makes)().batch == 96 and not hasattr(providers.routed("voyage-3-large", store.EMBEDDING_MODELS, makes)(), "batch")
    for unknown in ("?", "kanon-2-embedder"):
        with pytest.raises(ValueError):
            providers.routed(unknown, store.EMBEDDING_MODELS, makes)
    assert providers.preferred_model({}) == "gpt-4o-mini" and providers.preferred_model({"OPENAI_API_KEY": "x", "DEEPSEEK_API_KEY": "y"}) == "deepseek-chat"
    df = spark.createDataFrame([(1, [("user", "hi"), ("tool", "x"), ("assistant", "")], "now")], "i int, h array<struct<role:string,content:string>>, u string")
    assert df.select(providers.messages(F.lit("be kind"), F.col("h"), F.col("u"))).first()[0] == '[{"role":"system","content":"be kind"},{"role":"user","content":"hi"},{"role":"user","content":"now"}]'
    many = providers.hypothetical(spark.createDataFrame([("a long question",), ("short",)], "q string"), "q", lambda: providers.TemplateCompleter("H {prompt}"), n=2).collect()
    assert many[0].expanded == "H a long question" and len(many[0].expanded_all) == 2 and many[1].expanded_all == ["short"]


def test_replies(spark):
    from juralake.functions import extract

    df = spark.createDataFrame([('```json\n{"search_queries": ["a", "b"], "sufficient": false, "relevance_score": 0.2, "next_query": "n"}\n```',), ("no json",), ("{}",)], "r string")
    got = df.select(extract.search_plan(F.col("r"), F.lit("q")).alias("plan"), extract.judgement(F.col("r")).alias("j"), F.to_json(extract.json_or_text(F.col("r"))["json"]).alias("json"), extract.json_or_text(F.col("r"))["text"].alias("text")).collect()
    assert [r.plan for r in got] == [["a", "b"], ["q"], []]
    assert [(r.j.sufficient, r.j.relevance, r.j.next_query) for r in got] == [(False, 0.2, "n"), (True, 0.5, None), (False, 0.0, None)]
    assert got[1].json is None and got[1].text == "no json" and got[2].json == "{}" and got[2].text is None
    raw = spark.createDataFrame([('{"document_type": "Case Law", "jurisdiction": "european union", "date": "2020-01-02T10", "parties": "A", "key_provisions": ["x", "y"]}',), ('{"date": "May 2020", "parties": []}',)], "m string")
    norm = raw.select(extract.normal_metadata(F.parse_json("m")).alias("n")).select("n.*").collect()
    assert (norm[0].document_type, norm[0].jurisdiction, norm[0].date, norm[0].parties, norm[0].key_provisions) == ("case_law", "EU", "2020-01-02", ["A"], ["x", "y"]) and norm[1].date is None


def test_action_nodes_with_system_history_and_grounding(spark):
    graph = {"nodes": [{"id": "s", "type": "start"}, {"id": "a", "type": "action", "data": {"template": "about {{q}}", "system_prompt": "sys", "use_chat_history": True, "grounding": True, "json_mode": True}}], "edges": [{"from": "s", "to": "a"}]}
    df = spark.createDataFrame([("x", [("user", "before")])], "q string, chat_history array<struct<role:string,content:string>>")
    seen = workflow.Handlers(
        complete=lambda d, prompt, out: d.withColumn(out, F.concat(F.lit("```json\n"), F.col(prompt), F.lit("\n```"))), retrieve=lambda d, data, out: d.withColumn(out, F.lit("[Source: z]")),
    )
    reply = workflow.run(graph, df, seen).first().output
    assert reply == '[{"content":"sys Output ONLY valid JSON.","role":"system"},{"content":"before","role":"user"},{"content":"about x\\n\\nContext:\\n[Source: z]","role":"user"}]'
    research = {"nodes": [{"id": "s", "type": "start"}, {"id": "r", "type": "legal_research"}], "edges": [{"from": "s", "to": "r"}]}
    assert workflow.run(research, df, workflow.Handlers(others={"legal_research": lambda d, data, out: d.withColumn(out, F.lit("report"))})).first().output == "report"


def test_vectors_by_model_lines_and_counters(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x", [0.1] * 3), ("b", "y", [0.1]), (None, "z", None)], "id string, content string, embedding array<float>")
    got = {r.content: r for r in store.insert_with_vectors(rows, "c", "embed-v3", dims=3).collect()}
    assert len(got["x"].embedding_1024) == 3 and got["x"].embedding_1536 is None and got["y"].embedding_1024 is None and got["y"].error and len(got["z"].id) == 64 and got["z"].error is None
    colls = spark.createDataFrame([("c1", "one")], "id string, name string")
    ready, told = store.insert_outcome(colls, rows.select("content"), "one")
    assert told == {"success": True, "inserted_count": 3, "error": None} and {r.collection_id for r in ready.collect()} == {"c1"}
    assert not store.insert_outcome(colls, rows, "none")[1]["success"]
    (tmp_path / "x.jsonl").write_text('{"clause": "a", "tags": ["t"]}\nbroken\n')
    assert [r.clause for r in store.read_jsonl(spark, str(tmp_path / "x.jsonl"), "clause string, tags array<string>").collect()] == ["a", None]
    seen, counter = store.observed(rows, "run", without=F.count_if(F.col("embedding").isNull()))
    seen.collect()
    assert counter.get == {"rows": 3, "without": 1}
    assert {r.name for r in store.prompts(spark).collect()} == {"clause_extraction", "summary", "comparison"}
