import pytest
from pyspark.sql import functions as F

from juralake.functions import classify, extract, labels, text
from juralake.operators import chunking

ONE = "doc_id bigint, text string"


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in df.select("i", expr(F.col("v")).alias("x")).orderBy("i").collect()]


def test_sentences_keep_abbreviations(spark):
    out = column(spark, ["See Art. 5 of Acme Corp. Rules. It holds! Really? Yes", None, "", "no end"], text.split_sentences)
    assert out == [["See Art. 5 of Acme Corp. Rules.", "It holds!", "Really?", "Yes"], None, [], ["no end"]]
    assert column(spark, ["See Corp. Rules."], lambda c: text.split_sentences(c, protect=False)) == [["See Corp.", "Rules."]]


def test_words_and_keywords(spark):
    assert column(spark, ["été déjà vu_2", None], text.words) == [["été", "déjà", "vu_2"], None]
    assert column(spark, ["What penalty applies when FINES exceed penalty limits", "", None], text.keywords) == [["penalty", "applies", "fines"], [], None]


def test_sanitize_and_normalize(spark):
    assert column(spark, ["a\u0000b\tc�d", None], text.sanitize) == ["ab\tcd", ""]
    assert column(spark, [" see  SECTION 4\nand article x ", None], text.normalize_legal_text) == ["see Section 4 and Article x", None]


def test_protect_restores(spark):
    out = column(spark, ["art. 1 cart. no. vol. III."], lambda c: text.restore_abbreviations(text.protect_abbreviations(c)))
    assert out == ["art. 1 cart. no. vol. III."]
    assert column(spark, ["art. 1 cart."], text.protect_abbreviations) == ["art<ABBREV_DOT> 1 cart."]


def test_colbert_sentences_thin_out(spark):
    many = " ".join(f"This is sentence number {'abcdefghijklmnop'[i]} of the text." for i in range(16))
    out = column(spark, [many, "Short. 12345678901234567890123. A sentence that is long enough.", "", None], text.colbert_sentences)
    assert len(out[0]) == 8 and out[0][0].endswith("number a of the text.") and out[1] == ["A sentence that is long enough."] and out[2] == [] and not out[3]


def test_template_and_preview(spark):
    df = spark.createDataFrame([("x {{b}}", None)], "a string, b string")
    t = F.lit("{{a}}-{{b}}-{{c}}-{{ n.k }}-{{n.z}}-{{a.k}}-{{z.k}}-{{n.z.k}}")
    assert df.select(text.fill_template(t, {"a": F.col("a"), "b": F.col("b"), "n": {"k": F.lit(7)}})).first()[0] == "x {{b}}---7--{{a.k}}-{{z.k}}-{{n.z.k}}"
    assert column(spark, ["a" * 501, "b", None], text.preview) == ["a" * 500 + "...", "b", None]


def test_extraction(spark):
    t = "Article 5.2a and § 7 of 3 March, 1999 (1998) 2 QB 10. The Court and the court and Judge. 12 F. Supp. 34, 36 (2d Cir. 1990) and 5 U.S.C. § 552(b)."
    assert column(spark, [t], extract.article_refs) == [["Article 5.2a", "§ 7", "§ 552"]]
    assert column(spark, [t], extract.dates) == [["3 March, 1999"]]
    assert column(spark, [t], extract.report_citations) == [["(1998) 2 QB 10"]]
    assert column(spark, [t], extract.entities) == [["court", "judge"]]
    got = column(spark, [t], extract.citations)[0]
    assert [(c.kind, c.normal) for c in got] == [("case", "12 F. Supp. 34, 36 (2d Cir. 1990)"), ("statute", "5 U.S.C. § 552(b)")]
    assert column(spark, ["347 U.S. 483 (1954)", "", None], extract.citations) == [[], [], None]


def test_heuristics(spark):
    m = column(spark, ["This agreement on GDPR of 20 January 2004 by the federal court", "x", None, "see 2020-05-06"], extract.heuristic_metadata)
    assert (m[0].document_type, m[0].jurisdiction, m[0].practice_area, m[0].date, m[0].date_iso) == ("contract", "US", "data_protection", "20-January-2004", "2004-01-20")
    assert [*m[1]] == [None] * 5 and [*m[2]] == [None] * 5 and m[3].date_iso == "2020-05-06"


def test_prefix_leaves_out_what_is_missing(spark):
    df = spark.createDataFrame([("my_file-x.pdf", ["Article 1"], [], None)], "t string, r array<string>, e array<string>, d array<string>")
    none = F.lit(None).cast("string")
    assert df.select(extract.context_prefix(F.col("t"), none, none, F.col("r"), F.col("e"), F.col("d"), F.col("d"))).first()[0] == "[Document: my file x | References: Article 1] "
    assert df.select(extract.context_prefix(none, none, none, F.col("e"), F.col("e"), F.col("d"), F.col("d"))).first()[0] == ""


def test_replies(spark):
    assert [x is None for x in column(spark, ['```json\n{"a": 1}\n```', "no", "{broken", None], extract.json_object_in)] == [False, True, True, True]
    out = column(spark, ['["a", "b"]', "- first long question\n2. x", "", None], lambda c: extract.json_array_in(c, F.lit("orig")))
    assert out == [["a", "b"], ["first long question"], ["orig"], ["orig"]]


def test_classification(spark):
    got = column(spark, ["define tort", "compare the effects of a and b or c if it should", "", None, "How does Article 5 of the directive bind a ruling?"], classify.classification)
    assert [c.kind for c in got] == ["keyword", "complex", "factual", "factual", "conceptual"]
    assert got[2].confidence == 0.5 and got[4].n_results == 10 and got[4].use_reranking
    assert column(spark, ["short", "compare liability of firms and persons", None, "w " * 21 + "word"], classify.should_decompose) == [False, True, False, True]


def test_labels(spark):
    aliases = spark.createDataFrame([("lang", "en", "en"), ("lang", "english", "en"), ("source", "en", "wrong")], "kind string, raw string, canonical string")
    df = spark.createDataFrame([(1, "  ENGLISH \t"), (2, None), (3, "xx"), (4, " en")], "i int, raw string")
    assert [r.lab for r in labels.resolve(df, aliases, "lang", "raw", "lab").orderBy("i").collect()] == ["en", "unknown", "unknown", "en"]


def brute_pack(tokens, most, overlap):
    """Packing done by growing a list of sentences."""
    out, held = [], []
    for i, n in enumerate(tokens):
        if n > most:
            if held:
                out.append((held[0], held[-1]))
            out.append((i, i))
            held = []
            continue
        if held and sum(tokens[j] for j in held) + n > most:
            out.append((held[0], held[-1]))
            kept = []
            for j in reversed(held):
                if sum(tokens[k] for k in kept) + tokens[j] > overlap:
                    break
                kept.insert(0, j)
            held = kept
        held.append(i)
    if held:
        out.append((held[0], held[-1]))
    return out


@pytest.mark.parametrize("overlap", [0, 50])
def test_packing_against_brute_force(overlap):
    import random

    rng = random.Random(1)
    for _ in range(300):
        tokens = [rng.choice([rng.randrange(5, 60), rng.randrange(100, 300)]) for _ in range(rng.randrange(0, 30))]
        got = [(a, b) for a, b, _ in chunking.pack_ranges(tokens, 256, overlap)]
        assert got == brute_pack(tokens, 256, overlap)
        assert all(any(a <= i <= b for a, b in got) for i in range(len(tokens)))


def brute_words(words, most, overlap):
    """Packing words by growing a list of them."""
    out, held, total = [], [], 0
    for w in words:
        own = len(w + " ") // 4
        if held and total + own > most:
            out.append((" ".join(held), total))
            held = held[-max(1, len(held) * overlap // most) :] + [w]
            total = len(" ".join(held)) // 4
        else:
            held.append(w)
            total += own
    return [*out, (" ".join(held), len(" ".join(held)) // 4)] if held else out


def test_word_pieces_against_brute_force():
    import random

    rng = random.Random(2)
    for _ in range(300):
        words = ["w" * rng.choice([1, 3, 8, 30, 200]) for _ in range(rng.randrange(0, 60))]
        most, overlap = rng.choice([(20, 5), (20, 0), (256, 50), (5, 4)])
        got = [(" ".join(words[a : b + 1]), n) for a, b, n in chunking.word_ranges([*map(len, words)], most, overlap)]
        assert got == brute_words(words, most, overlap)


def test_simple_chunks():
    assert chunking.simple_chunks([]) == [] and chunking.simple_chunks(["a" * 2000]) == ["a" * 2000 + "."]
    told = chunking.simple_chunks(["a" * 600, "b" * 600, "c" * 40], 256, 0)
    assert told == ["a" * 600 + ".", "b" * 600 + ". " + "c" * 40 + "."]
    assert chunking.simple_chunks(["a" * 600, "b" * 600, "c" * 40], 256, 50)[1].startswith("a" * 600 + ". b")


def test_legal_words_and_reporters(spark):
    assert column(spark, ["Acme Corp. pays, no doubt.", None], text.legal_words) == [["Acme", "Corp.", "pays", "no", "doubt"], None]
    assert column(spark, ["F. Supp.", "U.S.", "Q.B.", None], extract.reporter_name) == ["Federal Supplement", "United States Reports", None, None]
    fields = {"a": F.lit("x"), "b": F.lit(None).cast("string"), "c": F.lit("y")}
    assert column(spark, [1], lambda _: extract.enabled_fields(fields, {"a": True, "b": True, "c": False}), "int") == [{"a": "x"}]


def test_chunks_of_nothing_and_of_one_long_word(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 5000), (4, "One. Two."), (5, ("word " * 900).strip())], ONE)
    rows = chunking.packed_chunks(df, "doc_id", "text").collect()
    assert {r.doc_id for r in rows} == {3, 4, 5}
    assert [r.kind for r in rows if r.doc_id == 3] == ["word_split"] and [r.chunk for r in rows if r.doc_id == 4] == ["One. Two."]
    assert all(r.token_count <= 256 for r in rows if r.doc_id == 5)


def test_sections(spark):
    df = spark.createDataFrame([(1, "Intro. Section 1 a. Section 2 b."), (2, "no heads"), (3, None), (4, "Article 9 alone")], ONE)
    got = {(r.doc_id, r.head, r.section) for r in chunking.sections(df, "doc_id", "text").collect()}
    assert got == {(1, "Section 1", "Section 1 a."), (1, "Section 2", "Section 2 b."), (2, None, "no heads"), (4, None, "Article 9 alone")}
    assert (1, None, "Intro.") in {(r.doc_id, r.head, r.section) for r in chunking.sections(df, "doc_id", "text", keep_preamble=True).collect()}


def test_structured_chunks(spark):
    long = "A sentence of the block runs on here. " * 60
    df = spark.createDataFrame([(1, "tiny"), (2, "Section 1 " + "alpha " * 40 + "Section 2 " + "beta " * 40), (3, "para one " * 20 + "\n\n" + "para two " * 20), (4, long), (5, None), (6, " "), (7, "word " * 900)], ONE)
    got = {(r.doc_id, r.type) for r in chunking.structured_chunks(df, "doc_id", "text").collect()}
    assert got == {(1, "short_fragment"), (2, "legal_section"), (3, "paragraph"), (4, "text_block"), (7, "word_split")}
    rows = chunking.structured_chunks(df, "doc_id", "text").collect()
    for i in (3, 4, 7):
        assert sorted(r.chunk_index for r in rows if r.doc_id == i) == list(range(sum(r.doc_id == i for r in rows)))


def test_contract_pieces():
    text_ = "Intro\n1. Scope\nAll.\n2.1 - Term\n" + "p" * 600 + "\n\n" + "q" * 600 + "\nend"
    got = chunking.contract_pieces(text_, 1000, 100)
    assert [(g[1], g[2], g[3]) for g in got] == [("section", None, "Preamble"), ("section", "1", "Scope"), ("paragraph", "2.1", "Term"), ("paragraph", "2.1", "Term")]
    assert got[3][0].startswith("p") and got[2][4] == text_.index("2.1") and got[3][4] == got[2][5] - 100
    assert chunking.contract_pieces("", 10) == [("", "section", None, "Document", 0, 0)]


def test_section_prefix(spark):
    df = spark.createDataFrame([("c", "1", "T"), ("c", None, "T"), ("c", None, None)], "content string, section_number string, section_title string")
    assert [r[0] for r in df.select(chunking.with_section_prefix()).collect()] == ["[Section 1 - T]\n\nc", "[T]\n\nc", "c"]
