from pyspark.sql import functions as F

from juralake.plans import assist, providers


def replies(text):
    return lambda: providers.TemplateCompleter(text)


def test_summaries(spark):
    rows = [(1, 0, "f.pdf", "x" * 60), (1, 1, None, "short"), (2, 0, "g", None)]
    got = {(r.doc_id, r.chunk_index): r for r in assist.summarised(spark.createDataFrame(rows, "doc_id int, chunk_index int, source string, content string"), replies("S {prompt}")).collect()}
    assert got[1, 0].enhanced.startswith("[CONTEXT: S Source: f.pdf\nPart 1 of 2") and got[1, 1].enhanced == "short" and got[2, 0].summary is None


def test_metadata_falls_back(spark):
    docs = spark.createDataFrame([(1, "This agreement of 20 January 2004 on GDPR"), (2, None), (3, "")], "i int, content string")
    told = {r.i: r.metadata for r in assist.with_metadata(docs, replies('ok {"document_type": "Case Law", "jurisdiction": "European Union", "parties": ["a", "b"], "date": "2020-01-02T00"}')).collect()}
    assert (told[1].document_type, told[1].jurisdiction, told[1].practice_area, told[1].date, told[1].parties) == ("case_law", "EU", "data_protection", "2020-01-02", ["a", "b"])
    plain = {r.i: r.metadata for r in assist.with_metadata(docs, replies("nothing")).collect()}
    assert (plain[1].document_type, plain[1].date, plain[1].parties) == ("contract", "2004-01-20", None) and plain[2].document_type is None


def test_research(spark):
    chunks = providers.embedded(spark.createDataFrame([("1", "liability caps apply", "a"), ("2", "tax rates rise", None)], "id string, content string, source string"), "content", providers.HashedWords)
    q = spark.createDataFrame([(1, "compare liability caps and tax rates"), (2, "zzz")], "query_id int, query string")
    got = {r.query_id: r for r in assist.research(chunks, q, replies('["liability caps", "tax rates"]'), replies("A<{prompt}>"), providers.HashedWords).collect()}
    assert got[1].n_sources == 2 and got[1].report.index("Analysis 1: liability caps") < got[1].report.index("Analysis 2: tax rates") and "[Source: a]" in got[1].report
    assert got[2].n_sources == 0


def test_grounding(spark):
    m = spark.createDataFrame([(1, 1, "assistant", "old FINAL CLASSIFICATION HIGH-RISK"), (1, 2, "assistant", "FINAL CLASSIFICATION: HIGH-RISK, Art. 6 and Annex III, Provider of biometric tools"), (1, 3, "user", "What must I comply with?"), (1, 4, "user", ""), (2, 1, "system", "x")], "conv_id int, turn int, role string, content string")
    last = assist.latest_classification(m).collect()
    assert len(last) == 1 and last[0].classification.startswith("FINAL CLASSIFICATION: HIGH")
    assert assist.history(m).count() == 3
    df = spark.createDataFrame([("What must I comply with?", last[0].classification), ("Hello", last[0].classification), ("obligation?", None)], "m string, c string")
    out = [r[0] for r in df.select(assist.grounding_query(F.col("m"), F.col("c"))).collect()]
    assert out == ["EU AI Act high-risk Article 6 Annex III provider biometric obligations requirements", "Hello", "obligation?"]
