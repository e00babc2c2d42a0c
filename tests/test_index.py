from pyspark.sql import functions as F

from juralake.plans import index, providers, workflow
from juralake.sources import elements


def test_elements_of_files(spark, tmp_path):
    (tmp_path / "a.html").write_text("<html><head><title>T</title><style>p {}</style></head><body><p>One  &amp;\n two</p><div>Three<br>Four</div><script>x</script></body></html>")
    (tmp_path / "b.txt").write_text("First\nline\r\n\r\nSecond")
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    (tmp_path / "d.txt").write_bytes(b"\xff\xfe\xfa")
    rows = elements.elements(spark, str(tmp_path)).orderBy("source", "pos").collect()
    assert [(r.source, r.text) for r in rows if r.error is None] == [("a.html", x) for x in ("T", "One & two", "Three", "Four")] + [("b.txt", "First line"), ("b.txt", "Second")]
    assert {r.source for r in rows if r.error} == {"c.pdf", "d.txt"}
    more = elements.elements(spark, str(tmp_path), "*.pdf", {"pdf": lambda raw: [raw.decode()]}).collect()
    assert [(r.pos, r.text) for r in more] == [(0, "%PDF")]


def test_merged_metadata_and_cards(spark, tmp_path):
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3"}), (None, None)], "own map<string,string>, base map<string,string>")
    assert [r[0] for r in df.select(elements.merged_metadata(F.col("own"), F.col("base"))).collect()] == [{"a": "1", "b": "3"}, {}]
    (tmp_path / "x.yaml").write_text("name: X\ntags: [a, b]\n")
    (tmp_path / "y.yaml").write_text("name: [broken\n")
    got = {r.source: r for r in elements.cards(spark, str(tmp_path)).select("source", "name", F.try_variant_get("card", "$.tags[1]", "string").alias("t"), "error").collect()}
    assert got["x.yaml"].name == "X" and got["x.yaml"].t == "b" and got["y.yaml"].error


DOCS = [(1, "my_file.pdf", "Section 1 " + "The court applies the rule. " * 8 + "Section 2 " + "The judge pays the costs. " * 8), (2, "b.pdf", "tiny"), (3, "c.pdf", None)]


def test_index_build(spark):
    docs = spark.createDataFrame(DOCS, "doc_id int, title string, text string")
    base = F.create_map(F.lit("source"), F.lit("archive"), F.lit("year"), F.lit("2020"))
    rows = index.build(docs, "doc_id", "title", "text", providers.HashedWords, base).collect()
    assert len(rows) == 2 and all(r.metadata["source"] == "archive" and r.metadata["type"] == "legal_section" and len(r.embedding) == 64 for r in rows)
    assert all(not r.content.startswith("[") for r in rows)
    seen = index.chunks_in_context(docs, "doc_id", "title", "text").orderBy("chunk_index").collect()
    assert seen[0].text_with_context.startswith("[Document: my file | Type: Legal provision | References: Section 1 | Entities: court] Section 1")
    assert {r.id for r in rows} == {r.id for r in index.build(docs, "doc_id", "title", "text", providers.HashedWords).collect()}


def test_sentence_vectors(spark):
    df = spark.createDataFrame([("a", "This is a sentence of some length. Here is another sentence to keep."), ("b", None), ("c", "short")], "id string, content string")
    got = {r.id: r for r in index.sentence_vectors(df, providers.HashedWords).collect()}
    assert got["a"].num_sentences == 2 and len(got["a"].sentence_embeddings) == 2 and got["a"].sentences[0].startswith("This") and got["b"].num_sentences == got["c"].num_sentences == 0


def test_simple_pipeline(spark):
    docs = spark.createDataFrame([(1, "Carriers owe damages. Tax rates rise"), (2, "Bread is baked at dawn"), (3, None)], "doc_id int, text string")
    q = spark.createDataFrame([(1, "damages of carriers")], "query_id int, query string")
    got = index.simple_pipeline(docs, q, providers.HashedWords).orderBy("place").collect()
    assert got[0].source == 1 and got[0].chunk_index == 0 and got[0].total_chunks == 1 and len(got) <= 3


def test_nodes_of_a_workflow(spark):
    chunks = providers.embedded(spark.createDataFrame([("1", "carriers owe damages", "law.txt"), ("2", "bread at dawn", "b.txt")], "id string, content string, source string"), "content", providers.HashedWords)
    graph = {"nodes": [{"id": "s", "type": "start"}, {"id": "r", "type": "retrieval"}, {"id": "l", "type": "legal_research"}], "edges": [{"from": "s", "to": "r"}, {"from": "r", "to": "l"}]}
    asked = spark.createDataFrame([(1, "carriers owe damages"), (2, None), (3, "zzz")], "rid int, q string")
    plain = lambda: providers.TemplateCompleter("told {prompt}")
    seen = workflow.Handlers(retrieve=index.retrieval_node(chunks, providers.HashedWords, lambda d: F.col("q")), others={"legal_research": index.research_node(chunks, "rid", "q", plain, plain, providers.HashedWords)})
    got = {r.rid: r for r in workflow.run(graph, asked, seen).collect()}
    assert got[1].r == "[Source: law.txt]\ncarriers owe damages" and got[2].r is None and got[3].r is None
    assert "[Source: law.txt]" in got[1].l and got[1].output == got[1].l


def test_streamed_index_is_the_batch_one(spark, tmp_path):
    from juralake.streaming import ingest

    docs = spark.createDataFrame(DOCS, "doc_id int, title string, text string")
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    docs.write.parquet(folder)
    for _ in range(2):
        ingest.ingest_index(ingest.read_documents(spark, folder, docs.schema), out, str(tmp_path / "cp"), "doc_id", "title", "text", providers.HashedWords).awaitTermination()
    told = {(r.id, r.content) for r in index.build(docs, "doc_id", "title", "text", providers.HashedWords).collect()}
    rows = spark.read.parquet(out).collect()
    assert {(r.id, r.content) for r in rows} == told and len(rows) == len(told) == 2
