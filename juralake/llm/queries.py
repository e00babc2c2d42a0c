"""The training-data queries: each runs over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from juralake.llm import bpe, budget, knn, langid, mixing, neardup, ranking, sentences, split
from juralake.session import materialise
from juralake.sources.tables import first_deliveries, spread, table

VOCAB = bpe.vocabulary()


#: Pairs of exact copies that p1_found writes out for a class, or two linked ones, at most; p1_links and p1_members have all at any size.
P1_EXPAND = 4096


def _p1(spark: SparkSession, d: str) -> neardup.NearDuplicates:
    return neardup.NearDuplicates(table(spark, d, "chunks"), "id", "content", n=3, threshold=0.6, least_words=30)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _p1(spark, d).pairs(P1_EXPAND)


def p1_links(spark: SparkSession, d: str) -> DataFrame:
    links = _p1(spark, d).named_links()
    return links.select("id_a", "id_b", F.round("share", 6).alias("share"))


def p1_members(spark: SparkSession, d: str) -> DataFrame:
    return _p1(spark, d).membership()


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.NearDuplicates(table(spark, d, "chunks"), "id", "content").groups()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks")
    model = sentences.adapted(sentences.trained(), sentences.fit_texts(chunks))
    return sentences.sentence_units(first_deliveries(chunks, "content"), model)


def p3_nearest(spark: SparkSession, d: str) -> DataFrame:
    return knn.nearest(table(spark, d, "chunks"), table(spark, d, "embedding_models"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return knn.similar_pairs(p3_nearest(spark, d), 0.85)


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.piece_texts(split.oversized(table(spark, d, "chunks")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return split.how_cut(split.pieces(split.oversized(table(spark, d, "chunks"))))


def p5_budget(spark: SparkSession, d: str) -> DataFrame:
    return budget.token_budget(table(spark, d, "chunks"), table(spark, d, "label_aliases"), VOCAB)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_budget(spark, d).where("est_tokens >= 0").select("source", "lang", "domain")  # a slice is one that has an estimate


def p5_errors(spark: SparkSession, d: str) -> DataFrame:
    return budget.budget_errors(table(spark, d, "chunks"), table(spark, d, "label_aliases"), VOCAB)


def p6_ranking(spark: SparkSession, d: str) -> DataFrame:
    rows = ranking.one_ranking(table(spark, d, "colbert_results"))
    return rows.withColumns({f"{s}_bounded": F.round(f"{s}_bounded", 9) for s in ranking.WEIGHTS})


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    rows = materialise(ranking.one_ranking(table(spark, d, "colbert_results")), "ranking")  # read five times
    scores = list(ranking.WEIGHTS)
    held = ranking.best_in_each(rows, "query_id", "chunk_id", scores, 5, ranking.leading(rows, "query_id", scores, 5))
    return held.select("query_id", "chunk_id")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_ids(spread(table(spark, d, "documents")), "doc_id", "text", VOCAB)


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    sized = mixing.mixture_inputs(spread(table(spark, d, "documents")), table(spark, d, "label_aliases"), VOCAB)
    return mixing.given_shares(sized, table(spark, d, "mix_targets"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_shares(spark, d).where(~F.col("reached")).select("source")


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    sized = mixing.mixture_inputs(spread(table(spark, d, "documents")), table(spark, d, "label_aliases"), VOCAB)
    return mixing.mix(sized, table(spark, d, "mix_targets"))


def p9_segments(spark: SparkSession, d: str) -> DataFrame:
    return langid.language_segments(table(spark, d, "documents"), table(spark, d, "label_aliases"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return langid.mislabelled(table(spark, d, "documents"), table(spark, d, "label_aliases"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, f in globals().items() if n[0] == "p" and n[1:2].isdigit()}


#: A label's canonical value, as SQL over label_aliases.
def _canonical(kind: str, raw: str) -> str:
    return rf"coalesce((SELECT a.canonical FROM label_aliases a WHERE a.kind = '{kind}' AND a.raw = lower(regexp_replace({raw}, '^[\s\x0b\x{{85}}\p{{Z}}]+|[\s\x0b\x{{85}}\p{{Z}}]+$', '', 'g'))), 'unknown')"


def _label(key: str) -> str:
    return f"CASE WHEN json_valid(metadata) THEN coalesce(metadata->>'$.{key}', metadata->>'$.provenance.{key}') END"


#: The words of each chunk, as near duplicates see them, and the words of an array x from i to j.
_WORDS = r"""(SELECT id, regexp_extract_all(lower(regexp_replace(content, '(\p{L})Σ([^\p{L}]|$)', '\1ς\2', 'g')), '[\p{L}\p{N}]+') AS w FROM (SELECT DISTINCT id, content FROM chunks WHERE id IS NOT NULL))"""


def _links(n: int, least: int, share: float) -> str:
    """CTEs: c (id, rep), the smallest id of equal words, wordless texts alone; l (id_a, id_b, share) links between such."""
    shingles = f"list_zip({', '.join(f'w[{i + 1}:{i - n}]' if i < n - 1 else f'w[{n}:]' for i in range(n))})"
    return f"""
        x AS {_WORDS}, c AS (SELECT id, CASE WHEN len(w) > 0 THEN min(id) OVER (PARTITION BY w) ELSE id END AS rep, w FROM x),
        t AS (SELECT DISTINCT id, unnest({shingles}) AS t FROM c WHERE id = rep AND len(w) >= {max(least, n)}), k AS (SELECT id, count(*) AS n FROM t GROUP BY id),
        b AS (SELECT x.id AS id_a, y.id AS id_b, count(*) AS shared FROM t x JOIN t y ON x.t = y.t AND x.id < y.id GROUP BY ALL),
        l AS (SELECT id_a, id_b, shared / (p.n + q.n - shared) AS share FROM b JOIN k p ON p.id = id_a JOIN k q ON q.id = id_b WHERE shared >= {share} * (p.n + q.n - shared))"""


def _bounded(score: str) -> str:
    """The logistic of the robust z of a score, from its median, MAD and mean absolute deviation."""
    return f"""CASE WHEN {score} IS NOT NULL THEN 1 / (1 + exp(-greatest(-35.0::DOUBLE, least(35.0::DOUBLE,
        CASE WHEN {score}_mad > 0 THEN ({score} - {score}_med) / ({score}_mad * 1.4826) WHEN {score}_dev > 0 THEN ({score} - {score}_med) / ({score}_dev * 1.2533) ELSE 0 END)))) END"""


def _pieces() -> str:
    """Pieces of contents over 2,000 code points: the level of a cut before each character, the cuts that cells of 250 offer, and the greedy choice."""
    of = lambda chars: "[" + ", ".join(str(ord(c)) for c in chars) + "]"
    closing, final, wide, clause = of("\"')]}”’»」』）】›"), of(".!?…。！？．؟।॥"), of("。！？．।॥"), of(",;:，；：、،؛·")
    return rf"""
        WITH RECURSIVE d AS (SELECT id, any_value(content) AS content FROM chunks WHERE id IS NOT NULL AND length(content) > 2000 GROUP BY id),
        ch AS (SELECT id, i, ord(s) AS u, regexp_matches(s, '[A-Za-z0-9+/=_-]') AS token, u IN (9, 10, 11, 12, 13, 32, 133, 160, 5760, 8232, 8233, 8239, 8287, 12288) OR u BETWEEN 8192 AND 8202 AS sp
               FROM (SELECT id, unnest(string_split(content, '')) AS s, generate_subscripts(string_split(content, ''), 1) - 1 AS i FROM d)),
        w AS (SELECT *, lag(u) OVER o AS pu, lag(token) OVER o AS pt, lag(sp) OVER o AS ps,
                last_value(CASE WHEN NOT sp THEN u END IGNORE NULLS) OVER b AS solid, last_value(CASE WHEN NOT sp AND u NOT IN {closing} THEN u END IGNORE NULLS) OVER b AS bare, first_value(u) OVER b AS head,
                count(CASE WHEN u = 10 THEN 1 END) OVER b AS line, last_value(CASE WHEN NOT sp THEN i END IGNORE NULLS) OVER b AS at_solid
              FROM ch WINDOW o AS (PARTITION BY id ORDER BY i), b AS (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        br AS (SELECT w.*, line - coalesce(y.lines, 0) AS breaks FROM w LEFT JOIN (SELECT id, i, count(CASE WHEN u = 10 THEN 1 END) OVER (PARTITION BY id ORDER BY i) AS lines FROM ch) y ON y.id = w.id AND y.i = w.at_solid),
        lv AS (SELECT id, i, greatest(
                CASE WHEN ps AND NOT sp THEN CASE WHEN solid IS NULL THEN 1 WHEN breaks > 1 THEN 5 WHEN breaks = 1 THEN 4 WHEN coalesce(bare, head) IN {final} THEN 3 WHEN solid IN {clause} THEN 2 ELSE 1 END WHEN token AND pt THEN -1 ELSE 0 END,
                CASE WHEN pu IN {wide} AND u NOT IN {closing} AND NOT sp AND u NOT IN {final} THEN 3 ELSE -1 END) AS level FROM br WHERE i > 0),
        cu AS (SELECT id, i, level FROM lv WHERE level >= 0 WINDOW c AS (PARTITION BY id, i // 250) QUALIFY i = min(i) OVER c OR i = max(i) OVER c OR row_number() OVER (PARTITION BY id, i // 250 ORDER BY level DESC, i DESC) = 1),
        li AS (SELECT d.id, length(content) AS size, list(i ORDER BY i) FILTER (WHERE i IS NOT NULL) AS cuts, list(level ORDER BY i) FILTER (WHERE i IS NOT NULL) AS level FROM d LEFT JOIN cu USING (id) GROUP BY ALL),
        walk(id, piece, start, cut, out_start, out_end, how) AS (
            SELECT id, 0, 0::BIGINT, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::VARCHAR FROM li
            UNION ALL
            SELECT id, piece + 1, CASE WHEN reach - picked <= 2000 THEN greatest(picked - 200, start + 1, reach - 2000) ELSE greatest(picked - 200, start + 1) END, picked, start, picked, how FROM (
                SELECT *, coalesce(list_min(list_filter(cuts, lambda x: x > picked)), size) AS reach FROM (
                    SELECT *, coalesce(pick, start + 2000) AS picked, CASE WHEN pick IS NULL THEN 'forced' ELSE 'natural' END AS how FROM (
                        SELECT *, list_max(list_filter(late, lambda x: level[list_position(cuts, x)] = list_max(list_transform(late, lambda y: level[list_position(cuts, y)])))) AS pick FROM (
                            SELECT *, CASE WHEN len(list_filter(near, lambda x: x >= start + 1000)) > 0 THEN list_filter(near, lambda x: x >= start + 1000) ELSE near[-1:] END AS late FROM (
                                SELECT w.id, piece, start, cut, size, coalesce(cuts, []) AS cuts, level, list_filter(coalesce(cuts, []), lambda x: x > greatest(cut, start) AND x <= start + 2000) AS near FROM walk w JOIN li USING (id) WHERE size - start > 2000)))))),
        p AS (SELECT id, piece - 1 AS piece, out_start AS start, out_end AS "end", how AS cut FROM walk WHERE how IS NOT NULL UNION ALL SELECT id, piece, start, size, 'end' FROM walk JOIN li USING (id) WHERE size - start <= 2000)
        SELECT id, piece::INT AS piece, start, "end", cut, substring(content, start + 1, "end" - start) AS text FROM p JOIN d USING (id)"""


def oracle_sql() -> dict[str, str]:
    scored = """
        SELECT query_id, chunk_id, CASE WHEN NOT isnan(original_score) THEN original_score END AS o, CASE WHEN NOT isnan(colbert_score) THEN colbert_score END AS c,
               list_max(list_filter(sentence_scores, lambda x: x IS NOT NULL AND NOT isnan(x))) AS s
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY created_at) AS n FROM colbert_results WHERE query_id IS NOT NULL AND chunk_id IS NOT NULL) WHERE n = 1"""
    nearest = " UNION ALL ".join(
        f"""SELECT a.id, b.id AS other, list_cosine_similarity(a.v::DOUBLE[], b.v::DOUBLE[]) AS c FROM v{i} a JOIN v{i} b ON a.id <> b.id
            QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY list_cosine_similarity(a.v::DOUBLE[], b.v::DOUBLE[]) DESC, b.id) <= 5"""
        for i in (1536, 1024, 1792)
    )
    vectors = ", ".join(
        f"""v{i} AS (SELECT DISTINCT id, embedding_{i} AS v FROM chunks WHERE len(embedding_{i}) = (SELECT stored_dims FROM embedding_models WHERE vector_column = 'embedding_{i}')
            AND len(list_filter(embedding_{i}, lambda x: x IS NOT NULL AND NOT isnan(x) AND NOT isinf(x))) = len(embedding_{i}) AND len(list_filter(embedding_{i}, lambda x: x <> 0)) > 0)"""
        for i in (1536, 1024, 1792)
    )
    return {
        "p1_found": r"""
            WITH w AS (SELECT id, regexp_extract_all(lower(regexp_replace(content, '(\p{L})Σ([^\p{L}]|$)', '\1ς\2', 'g')), '[\p{L}\p{N}]+') AS w FROM (SELECT DISTINCT id, content FROM chunks) WHERE content IS NOT NULL),
            t AS (SELECT DISTINCT id, unnest(list_zip(w[:-3], w[2:-2], w[3:])) AS t FROM w WHERE len(w) >= 30),
            n AS (SELECT id, count(*) AS n FROM t GROUP BY id),
            b AS (SELECT x.id AS id_a, y.id AS id_b, count(*) AS shared FROM t x JOIN t y ON x.t = y.t AND x.id < y.id GROUP BY ALL)
            SELECT id_a, id_b FROM b JOIN n p ON p.id = id_a JOIN n q ON q.id = id_b WHERE shared >= 0.6 * (p.n + q.n - shared)""",
        "p1_links": f"WITH {_links(3, 30, 0.6)} SELECT id_a, id_b, round(share, 6) AS share FROM l",
        "p1_members": f"""
            WITH {_links(3, 30, 0.6)}, e AS (SELECT id, count(*) AS n FROM (SELECT id_a AS id FROM l UNION ALL SELECT id_b FROM l) GROUP BY id)
            SELECT c.id AS key, rep, coalesce(n, 0) AS n_links FROM c LEFT JOIN e ON e.id = rep""",
        "p1_groups": f"""
            WITH RECURSIVE {_links(5, 0, 0.8)}, e AS (SELECT id_a AS u, id_b AS v FROM l UNION ALL SELECT id_b, id_a FROM l),
            r(u, v) AS (SELECT DISTINCT rep, rep FROM c UNION SELECT r.u, e.v FROM r JOIN e ON e.u = r.v), g AS (SELECT u, min(v) AS "group" FROM r GROUP BY u)
            SELECT c.id AS key, "group", count(*) OVER (PARTITION BY "group") AS n_keys FROM c JOIN g ON g.u = rep""",
        "p4_pieces": _pieces(),
        "p6_ranking": f"""
            WITH x AS ({scored}), m AS (SELECT *, quantile_disc(o, 0.5) OVER q AS o_med, quantile_disc(c, 0.5) OVER q AS c_med, quantile_disc(s, 0.5) OVER q AS s_med FROM x WINDOW q AS (PARTITION BY query_id)),
            d AS (SELECT *, {", ".join(f"quantile_disc(abs({k} - {k}_med), 0.5) OVER q AS {k}_mad, avg(abs({k} - {k}_med)) OVER q AS {k}_dev" for k in "ocs")} FROM m WINDOW q AS (PARTITION BY query_id)),
            b AS (SELECT query_id, chunk_id, o, c, s, {", ".join(f"{_bounded(k)} AS {k}_b" for k in "ocs")} FROM d),
            f AS (SELECT *, CASE WHEN o_b IS NOT NULL OR c_b IS NOT NULL OR s_b IS NOT NULL THEN round(exp((coalesce(ln(o_b), 0) + coalesce(ln(c_b), 0) + coalesce(ln(s_b), 0)) / (CASE WHEN o_b IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN c_b IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN s_b IS NOT NULL THEN 1 ELSE 0 END)), 10) END AS fused FROM b)
            SELECT query_id, chunk_id, o AS original, c AS colbert, s AS sentence, round(o_b, 9) AS original_bounded, round(c_b, 9) AS colbert_bounded, round(s_b, 9) AS sentence_bounded, fused,
                   row_number() OVER (PARTITION BY query_id ORDER BY coalesce(fused, -1) DESC, chunk_id) AS place FROM f""",
        "p3_found": f"WITH {vectors}, k AS ({nearest}) SELECT DISTINCT least(id, other) AS id_a, greatest(id, other) AS id_b FROM k WHERE c >= 0.85",
        "p4_found": """
            SELECT DISTINCT id, CASE WHEN regexp_matches(content, '[A-Za-z0-9+/=_-]{1000}[A-Za-z0-9+/=_-]{1000}[A-Za-z0-9+/=_-]') THEN 'forced' ELSE 'natural' END AS cut
            FROM chunks WHERE length(content) > 2000""",
        "p5_found": f"""
            SELECT DISTINCT {_canonical("source", "s")} AS source, {_canonical("lang", "l")} AS lang, {_canonical("domain", "d")} AS domain
            FROM (SELECT DISTINCT {_label("source")} AS s, {_label("language")} AS l, {_label("domain")} AS d FROM chunks)""",
        "p6_found": f"""
            WITH x AS ({scored}), r AS (
                SELECT query_id, chunk_id, o, c, s, rank() OVER (PARTITION BY query_id ORDER BY o DESC NULLS LAST) AS a,
                       rank() OVER (PARTITION BY query_id ORDER BY c DESC NULLS LAST) AS b, rank() OVER (PARTITION BY query_id ORDER BY s DESC NULLS LAST) AS e FROM x)
            SELECT query_id, chunk_id FROM r WHERE o IS NOT NULL AND c IS NOT NULL AND s IS NOT NULL AND a <= 5 AND b <= 5 AND e <= 5""",
    }
