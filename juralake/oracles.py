"""The engine's queries in DuckDB's SQL, formulated on their own rather than after the plans they check."""

from __future__ import annotations

from juralake import oracle_patterns as fixed
from juralake.functions import text

#: White space that patterns mean.
S = r"[ \t\n\r\f]"
W = r"[\p{L}\p{M}\p{N}_]"
ONCE = "(SELECT id, any_value(collection_id) AS collection_id, any_value(content) AS content FROM chunks WHERE id IS NOT NULL GROUP BY id)"
LOW = "replace(lower({}), 'ς', 'σ')"
COS = "round(list_cosine_similarity({}::DOUBLE[], {}::DOUBLE[]), 6)"


def _re(pattern: str) -> str:
    """A pattern as an SQL literal."""
    return "'" + pattern.replace("'", "''") + "'"


def _keywords(c: str) -> str:
    stop = ", ".join(f"'{w}'" for w in fixed.STOPWORDS)
    return f"list_filter(regexp_extract_all({LOW.format(c)}, '{W}+'), lambda w: length(w) > 3 AND NOT list_contains([{stop}], w))[1:3]"


SYN = """
    concat('Article ', doc_id % 200 + 1, ' of Regulation ', doc_id % 37, ' applies since ', doc_id % 28 + 1, ' March 2', lpad((doc_id % 30)::VARCHAR, 3, '0'),
        CASE WHEN doc_id % 3 = 0 THEN concat('. The Court and the defendant cite (', 1950 + doc_id % 60, ') ', doc_id % 9 + 1, ' QB ', doc_id % 400) ELSE '. The commission noted no. 7' END,
        CASE WHEN doc_id % 4 = 0 THEN concat('. See ', doc_id % 90 + 10, ' F. Supp. ', doc_id % 700 + 1, CASE WHEN doc_id % 8 = 0 THEN concat(', ', doc_id % 700 + 5) ELSE '' END, ' (2d Cir. ', 1980 + doc_id % 40, ') and ', doc_id % 50 + 1, ' U.S.C. § ', doc_id % 999 + 1) ELSE '' END,
        CASE doc_id % 5 WHEN 0 THEN '. This agreement binds the parties' WHEN 1 THEN '. GDPR privacy policy' WHEN 2 THEN '. A federal merger case' ELSE '' END, '. ', coalesce(text, ''))"""
SEEDED = f"(SELECT doc_id, docket, {SYN} AS syn FROM documents)"
CANDS = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY created_at) AS n_th FROM colbert_results) WHERE n_th = 1)"
BY_SCORE = f"(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY original_score DESC, chunk_id) AS rank FROM {CANDS} WHERE original_score IS NOT NULL AND NOT isnan(original_score))"
LISTS = f"""(
    SELECT query_id, 0 AS l, row_number() OVER (PARTITION BY query_id ORDER BY original_score DESC, chunk_id) - 1 AS r, document, 'original_score' AS asked FROM {CANDS} WHERE NOT isnan(original_score)
    UNION ALL SELECT query_id, 1, row_number() OVER (PARTITION BY query_id ORDER BY colbert_score DESC, chunk_id) - 1, document, 'colbert_score' FROM {CANDS} WHERE NOT isnan(colbert_score))"""


def _fused(chars: int, limit: int) -> str:
    return f"""
        SELECT query_id, key, round(sum(1 / (61.0::DOUBLE + r)), 10) AS rrf_score, min(l) AS first_list, arg_min(r, l * 1000000 + r) AS first_rank,
               row_number() OVER (PARTITION BY query_id ORDER BY round(sum(1 / (61.0::DOUBLE + r)), 10) DESC, min(l * 1000000 + r), key) AS place
        FROM (SELECT *, left(coalesce(document, ''), {chars}) AS key FROM {LISTS}) GROUP BY query_id, key QUALIFY place <= {limit}"""


def _search(base: str, k: int, keep: str = "true") -> str:
    """Each hundredth vector against ``base``."""
    return f"""
        SELECT query_id, rank, vec_id, similarity FROM (
            SELECT q.vec_id AS query_id, b.vec_id, {COS.format("b.embedding", "q.embedding")} AS similarity, row_number() OVER (PARTITION BY q.vec_id ORDER BY {COS.format("b.embedding", "q.embedding")} DESC, b.vec_id) AS rank
            FROM embeddings q JOIN {base} b ON true WHERE q.vec_id % 100 = 0 AND {COS.format("b.embedding", "q.embedding")} > 0)
        WHERE rank <= {k} AND {keep}"""


def _usable(c: str) -> str:
    return f"len({c}) = len(list_filter({c}, lambda x: x IS NOT NULL AND NOT isnan(x) AND NOT isinf(x))) AND len(list_filter({c}, lambda x: x <> 0)) > 0"


def _match(model: str, column: str) -> str:
    return f"""
        SELECT '{model}' AS model, row_number() OVER (ORDER BY s DESC, id) AS rank, id, s AS similarity FROM (
            SELECT b.id, {COS.format("b.e", "q.e")} AS s FROM (SELECT DISTINCT id, {column} AS e FROM chunks WHERE {_usable(column)} AND len({column}) = (SELECT stored_dims FROM embedding_models WHERE vector_column = '{column}')) b,
                (SELECT {column} AS e FROM chunks WHERE {_usable(column)} AND len({column}) = (SELECT stored_dims FROM embedding_models WHERE vector_column = '{column}') ORDER BY id LIMIT 1) q)
        WHERE s > 0 QUALIFY rank <= 5"""


def _scores(patterns: tuple[str, ...], each: float = 1.0) -> str:
    return " + ".join(f"CASE WHEN regexp_matches(q, {_re(p)}) THEN {each} ELSE 0 END" for p in patterns)


ASKED = """(
    SELECT query_id, unnest([query, concat('what is the meaning of ', query), concat('how does Article 5 of the directive limit a ruling on ', query, ' generally?'),
        concat('compare the effects of ', query, ' and of fines, or penalties? And if not, why must it be so unless provided?'), concat('"', query, '"'), '  ']) AS raw FROM search_queries)"""
N_WORDS = "len(list_filter(regexp_split_to_array({}, '[ \t\n\r\f\x0b]+'), lambda w: w <> ''))"


def _query_class(asked: str = ASKED) -> str:
    return f"""
        WITH t AS (SELECT query_id, raw, regexp_replace(lower(translate(raw, chr(160) || chr(12288), '  ')), '^[ \t\n\r\f\x0b]+|[ \t\n\r\f\x0b]+$', '', 'g') AS q FROM {asked}),
        n AS (SELECT *, {N_WORDS.format("q")} AS w FROM t),
        s AS (SELECT *, {_scores(fixed.FACTUAL)} + CASE WHEN w <= 6 THEN 0.5 ELSE 0 END AS f, {_scores(fixed.KEYWORD)} + CASE WHEN w <= 3 THEN 1.5 ELSE 0 END + CASE WHEN w = 1 THEN 1 ELSE 0 END AS k,
                {_scores(fixed.COMPLEX)} + CASE WHEN w > 15 THEN 1 ELSE 0 END + CASE WHEN w > 25 THEN 1 ELSE 0 END AS x,
                {_scores(fixed.CONCEPTUAL)} + CASE WHEN w BETWEEN 5 AND 15 AND regexp_matches(q, '^(how|why)') THEN 0.5 ELSE 0 END AS c, least(1.0, {_scores(fixed.LEGAL, 0.3)}) AS boost FROM n),
        b AS (SELECT *, CASE WHEN coalesce(q, '') = '' THEN 'factual' ELSE list_extract(['factual', 'keyword', 'complex', 'conceptual'], list_position([f, k, x, c], greatest(f, k, x, c))) END AS kind FROM s),
        r AS (SELECT *, CASE kind WHEN 'factual' THEN 5 WHEN 'keyword' THEN 3 WHEN 'complex' THEN 10 ELSE 8 END AS base, coalesce(q, '') <> '' AND boost > 0.5 AS legal FROM b)
        SELECT query_id, raw AS q, kind, CASE WHEN coalesce(q, '') = '' THEN 0.5 ELSE round(least(0.95, greatest(f, k, x, c)::DOUBLE / CASE WHEN f + k + x + c > 0 THEN f + k + x + c ELSE 1 END + 0.1), 6) END AS confidence,
               CASE WHEN legal THEN least(base + 2, 12) ELSE base END AS n_results, legal OR kind <> 'keyword' AS use_reranking FROM r"""


def _first(patterns: dict[str, tuple[str, ...]]) -> str:
    return "CASE " + " ".join(f"WHEN {' OR '.join(f'regexp_matches(h, {_re(p)})' for p in each)} THEN '{name}'" for name, each in patterns.items()) + " END"


#: What a pattern means by any white space, and a character that texts don't hold.
ANY = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
CUT = "chr(983040)"
HEAD = r"(?:Article|Section|Regulation|§|Chapter|Part|Title|Rule)[ \t\n\r\f]+[0-9]+[.0-9]*[0-9A-Za-z_]*"


def _pack(base: str, sentences: str, overlap: int, columns: str, most: int = 256) -> str:
    """Greedy packing of ``base`` (key, s) by recursion over sentences, whose state is where the open range began and what it holds, and
    of oversize sentences by recursion over pieces of words."""
    return rf"""
        WITH RECURSIVE base AS ({base}),
        a AS (SELECT key, {sentences} AS a FROM base), t AS (SELECT key, a, list_transform(a, lambda x: length(x) // 4) AS n FROM a WHERE len(a) > 0),
        walk(key, n, i, start, held, out_first, out_last) AS (
            SELECT key, n, 0, 0, 0::BIGINT, -1, -1 FROM t
            UNION ALL
            SELECT key, n, i + 1,
                CASE WHEN v > {most} THEN i + 1 WHEN full_ THEN back ELSE start END,
                CASE WHEN v > {most} THEN 0 WHEN full_ THEN coalesce(list_sum(n[back + 1:i]), 0) + v ELSE held + v END,
                CASE WHEN (v > {most} AND i > start) OR (v <= {most} AND full_) THEN start ELSE -1 END,
                CASE WHEN (v > {most} AND i > start) OR (v <= {most} AND full_) THEN i - 1 ELSE -1 END
            FROM (SELECT *, CASE WHEN full_ THEN coalesce(list_min(list_filter(range(start, i + 1), lambda j: coalesce(list_sum(n[j + 1:i]), 0) <= {overlap})), i) ELSE start END AS back
                  FROM (SELECT *, n[i + 1] AS v, held + n[i + 1] > {most} AND i > start AS full_ FROM walk WHERE i < len(n)))
        ),
        r AS (SELECT key, out_first AS first, out_last AS last FROM walk WHERE out_first >= 0 UNION ALL SELECT key, start, i - 1 FROM walk WHERE i = len(n) AND start < len(n)),
        packed AS (
            SELECT key, first, last, 0 AS piece, 'packed' AS kind, c AS chunk, CASE WHEN last = len(n) - 1 THEN length(c) // 4 ELSE list_sum(n[first + 1:last + 1]) END::BIGINT AS token_count
            FROM (SELECT *, array_to_string(a[first + 1:last + 1], ' ') AS c FROM r JOIN t USING (key))),
        words AS (SELECT key, first, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (
            SELECT key, first, list_filter(regexp_split_to_array(s, '{ANY}+'), lambda x: x <> '') AS w FROM (SELECT key, unnest(a) AS s, unnest(n) AS n, unnest(range(0, len(a))) AS first FROM t) WHERE n > {most})),
        sums AS (SELECT key, first, list(w ORDER BY i) AS w, list(ct ORDER BY i) AS ct, list(cl ORDER BY i) AS cl FROM (
            SELECT *, sum((length(w) + 1) // 4) OVER (PARTITION BY key, first ORDER BY i) AS ct, sum(length(w)) OVER (PARTITION BY key, first ORDER BY i) AS cl FROM words) GROUP BY key, first),
        pieces(key, first, piece, s, f, tok, full_at) AS (
            SELECT key, first, 0, 1::BIGINT, 1::BIGINT, ct[1]::BIGINT, list_filter(range(2, len(w) + 1), lambda i: ct[i] > {most})[1] FROM sums
            UNION ALL
            SELECT key, first, piece, s, f, tok, list_filter(range(f + 1, len(w) + 1), lambda i: tok + ct[i] - ct[f] > {most})[1] FROM (
                SELECT p.key, p.first, piece + 1 AS piece, s2 AS s, full_at AS f, ((cl[full_at] - CASE WHEN s2 > 1 THEN cl[s2 - 1] ELSE 0 END + full_at - s2) // 4)::BIGINT AS tok, w, ct
                FROM (SELECT *, full_at - least(full_at - s, greatest(1, (full_at - s) * {overlap} // {most})) AS s2 FROM pieces WHERE full_at IS NOT NULL) p JOIN sums u ON u.key = p.key AND u.first = p.first)),
        cut AS (
            SELECT p.key, p.first, p.first AS last, piece, 'word_split' AS kind, array_to_string(w[s:coalesce(full_at - 1, len(w))], ' ') AS chunk,
                   CASE WHEN full_at IS NULL THEN (cl[len(w)] - CASE WHEN s > 1 THEN cl[s - 1] ELSE 0 END + len(w) - s) // 4 ELSE tok + ct[full_at - 1] - ct[f] END::BIGINT AS token_count
            FROM pieces p JOIN sums u ON u.key = p.key AND u.first = p.first),
        every AS (SELECT *, (row_number() OVER (PARTITION BY key ORDER BY last, piece) - 1)::INT AS chunk_index FROM (FROM packed UNION ALL BY NAME FROM cut))
        SELECT {columns} FROM every"""


def _bm25(queries: str, k: int) -> str:
    """``k`` best texts of each of ``queries`` (query_id, query)."""
    return f"""
        SELECT query_id, id, score, rank FROM (
            WITH d AS (SELECT id, regexp_extract_all({LOW.format("content")}, '{W}+') AS w FROM {ONCE} WHERE content IS NOT NULL),
            m AS (SELECT count(*) AS texts, avg(len(w)) AS mean FROM d WHERE len(w) > 0),
            t AS (SELECT query_id, unnest(list_distinct(regexp_extract_all({LOW.format("query")}, '{W}+'))) AS term FROM {queries}),
            p AS (SELECT id, len(w) AS size, unnest(w) AS term FROM d), f AS (SELECT id, size, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM t) GROUP BY ALL),
            n AS (SELECT term, count(*) AS df FROM f GROUP BY term),
            s AS (SELECT query_id, id, round(sum(ln(1 + (texts - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 6) AS score FROM t JOIN f USING (term) JOIN n USING (term), m GROUP BY 1, 2)
            SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= {k})"""


def _sound(v: str) -> str:
    return f"len(list_filter({v}, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"


#: Usable vectors of the first model, and each search query's own.
FIRST_VECTORS = f"(SELECT id, any_value(collection_id) AS collection_id, any_value(embedding_1536) AS e, any_value(sentence_embeddings) AS se, any_value(sentence_texts) AS st FROM chunks WHERE {{}} AND len(embedding_1536) = (SELECT stored_dims FROM embedding_models WHERE vector_column = 'embedding_1536') GROUP BY id)"


def _structured(shielded: str, trim: str, columns: str = "md5(chunk) AS digest") -> str:
    kind = rf"CASE WHEN length(text) // 4 < 25 THEN 'short_fragment' WHEN len(regexp_extract_all(text, '{HEAD}', 0, 'i')) > 1 THEN 'legal_section' WHEN regexp_matches(text, '\n{S}*\n') THEN 'paragraph' ELSE 'text_block' END"
    base = rf"""
        SELECT d.doc_id, type, part, CASE WHEN type IN ('legal_section', 'paragraph') THEN {trim.format("piece")} ELSE piece END AS s FROM (
            SELECT doc_id, type, unnest(p) AS piece, generate_subscripts(p, 1) AS part FROM (
                SELECT doc_id, type, CASE type WHEN 'legal_section' THEN string_split(regexp_replace(text, '({HEAD})', {CUT} || '\1', 'gi'), {CUT}) WHEN 'paragraph' THEN regexp_split_to_array(text, '\n{S}*\n') ELSE [text] END AS p
                FROM (SELECT doc_id, text, {kind} AS type FROM documents WHERE {trim.format("text")} <> ''))) d
        WHERE s <> '' AND (type <> 'legal_section' OR regexp_matches(s, '^{HEAD}', 'i'))"""
    split = _pack("SELECT doc_id || '|' || part || '|' || type AS key, s FROM parts WHERE length(s) // 4 > 256", shielded, 50, "key, chunk_index, kind, token_count, chunk")
    return f"""
        WITH parts AS ({base}),
        rows AS (
            SELECT doc_id, part, 0 AS n, type, (length(s) // 4)::BIGINT AS token_count, s AS chunk FROM parts WHERE length(s) // 4 <= 256
            UNION ALL SELECT split_part(key, '|', 1)::BIGINT, split_part(key, '|', 2)::BIGINT, chunk_index, CASE kind WHEN 'word_split' THEN kind ELSE split_part(key, '|', 3) END, token_count, chunk FROM ({split}))
        SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY part, n) - 1)::INT AS chunk_index, type, token_count, {columns} FROM rows"""


def _contract(text: str, columns: str) -> str:
    head = rf"^(\p{{Nd}}+(?:\.\p{{Nd}}+)*){ANY}*[.\-–]{ANY}*([^\n]+)\n"
    bare = lambda c: f"regexp_replace({c}, '^{ANY}+|{ANY}+$', '', 'g')"
    marked = rf"regexp_replace(t, '(?m)({head})', {CUT} || '\1', 'g')"
    return rf"""
        WITH RECURSIVE x AS (SELECT doc_id, {text} AS t FROM documents WHERE {text} IS NOT NULL),
        p AS (SELECT doc_id, unnest(a) AS p, generate_subscripts(a, 1) AS k FROM (SELECT doc_id, string_split({marked}, {CUT}) AS a FROM x)),
        o AS (SELECT *, coalesce(sum(length(p)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM p),
        z AS (SELECT doc_id, k, CASE WHEN k > 1 THEN regexp_extract(p, '{head}', 1) END AS number, CASE WHEN k > 1 THEN {bare(f"regexp_extract(p, '{head}', 2)")} ELSE 'Preamble' END AS title, CASE WHEN k > 1 THEN start ELSE 0 END AS start, {bare("p")} AS body
              FROM o WHERE k > 1 OR {bare("p")} <> ''),
        s AS (FROM z WHERE doc_id IN (SELECT doc_id FROM o WHERE k > 1) UNION ALL SELECT doc_id, 1, NULL, 'Document', 0, t FROM x WHERE doc_id NOT IN (SELECT doc_id FROM o WHERE k > 1)),
        q AS (SELECT *, regexp_split_to_array(body, '
{ANY}*
') AS blocks FROM s WHERE length(body) > 1000),
        walk(doc_id, k, i, held, at_, content, a, b) AS (
            SELECT doc_id, k, 1, '', start, NULL::VARCHAR, 0::BIGINT, 0::BIGINT FROM q
            UNION ALL
            SELECT w.doc_id, w.k, i + 1, CASE WHEN full_ THEN right(held, 100) ELSE held END || block, CASE WHEN full_ THEN at_ + length(held) - 100 ELSE at_ END, CASE WHEN full_ THEN {bare("held")} END, at_, at_ + length(held)
            FROM (SELECT walk.*, q.blocks[i] || chr(10) || chr(10) AS block, held <> '' AND length(held) + length(q.blocks[i]) + 2 > 1000 AS full_ FROM walk JOIN q ON q.doc_id = walk.doc_id AND q.k = walk.k WHERE i <= len(q.blocks)) w),
        c AS (
            SELECT doc_id, k, 0 AS i, body AS content, 'section' AS kind, start AS a, start + length(body) AS b FROM s WHERE length(body) <= 1000
            UNION ALL SELECT doc_id, k, i, content, 'paragraph', a, b FROM walk WHERE content IS NOT NULL
            UNION ALL SELECT walk.doc_id, walk.k, i + 1, {bare("held")}, 'paragraph', at_, at_ + length(held) FROM walk JOIN q ON q.doc_id = walk.doc_id AND q.k = walk.k WHERE i = len(q.blocks) + 1 AND {bare("held")} <> '')
        SELECT c.doc_id, (row_number() OVER (PARTITION BY c.doc_id ORDER BY c.k, c.i) - 1)::INT AS chunk_index, {columns}
        FROM c JOIN s ON s.doc_id = c.doc_id AND s.k = c.k"""


def _colbert_sentences(trim: str) -> str:
    c = rf"regexp_replace(text, '([.!?]){S}+([A-Z])', '\1' || {CUT} || '\2', 'g')"
    for _ in range(2):  # a number may end one item and begin the next
        c = rf"regexp_replace({c}, '(\.){S}*([0-9]+\.)', '\1' || {CUT} || '\2', 'g')"
    c = rf"regexp_replace(regexp_replace({c}, '(:){S}*([A-Z])', '\1' || {CUT} || '\2', 'g'), '\n\n+', {CUT}, 'g')"
    held = rf"list_filter(list_transform(string_split({c}, {CUT}), lambda x: {trim.format('x')}), lambda x: length(x) >= 20 AND length(regexp_replace(x, '[^\p{{L}}]', '', 'g')) / length(x) >= 0.3)"
    at = "list_sort(list_distinct([0] || range(1, len(a) - 1, greatest(1, (len(a) - 2) // 6)) || [len(a) - 1]))[1:8]"
    return f"SELECT doc_id, len(b) AS n, sha256(array_to_string(b, '|')) AS digest FROM (SELECT doc_id, CASE WHEN len(a) > 8 THEN list_transform({at}, lambda i: a[i + 1]) ELSE a END AS b FROM (SELECT doc_id, {held} AS a FROM documents WHERE text IS NOT NULL))"


#: Search queries as messages.
MESSAGES = "(SELECT collection_id AS conv_id, query_id AS turn, ['user', 'assistant', 'tool'][query_id % 3 + 1] AS role, CASE WHEN query_id % 2 = 0 THEN 'FINAL CLASSIFICATION: ' || query ELSE query END AS content FROM search_queries WHERE collection_id IS NOT NULL)"
#: The columns of packed chunks.
PACKED = "key AS doc_id, chunk_index, first::INT AS first, last::INT AS last, kind, token_count, md5(chunk) AS digest"


def _retrieval() -> dict[str, str]:
    """The retrieval pipelines."""
    first = FIRST_VECTORS.format(_usable("embedding_1536"))
    asked = "a AS (SELECT query_id, arg_min(e, id) AS q FROM (SELECT DISTINCT query_id, chunk_id AS id FROM colbert_results) JOIN v USING (id) GROUP BY query_id)"
    cos = COS.format("v.e", "a.q")
    hits = lambda k, more="": f"h AS (SELECT query_id, v.id, {cos} AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY {cos} DESC, v.id) AS rank FROM a JOIN search_queries s USING (query_id), v WHERE {cos} > 0{more} QUALIFY rank <= {k})"
    overlap = f"""(SELECT *, CASE WHEN len(x) + len(y) > 0 THEN round(len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))), 6) ELSE 0 END AS s
        FROM (SELECT *, list_distinct(regexp_extract_all({LOW.format("query")}, '{W}+')) AS x, list_distinct(regexp_extract_all({LOW.format("content")}, '{W}+')) AS y FROM @))"""
    split = f"coalesce(length(query) >= 20 AND ({' OR '.join(f'regexp_matches(query, {_re("(?i)" + p)})' for p in fixed.DECOMPOSE)} OR {N_WORDS.format('query')} > 20), false)"
    best = "list_max(m)"
    each = f"CASE WHEN {_sound('s')} AND len(s) = len(q) THEN CASE WHEN len(list_filter(s, lambda x: x <> 0)) = 0 THEN 0 ELSE {COS.format('s', 'q')} END END"
    return {
        "query_dataset": f"""
            WITH v AS {first}, {asked}, {hits(15)}, k AS (SELECT query_id, unnest(range(0, len(w))) AS pos, unnest(w) AS keyword FROM (SELECT query_id, {_keywords("query")} AS w FROM search_queries JOIN a USING (query_id))),
            f AS (SELECT keyword, id FROM (SELECT k.keyword, c.id, row_number() OVER (PARTITION BY k.keyword ORDER BY c.id) AS n FROM (SELECT DISTINCT keyword FROM k) k JOIN {ONCE} c ON contains({LOW.format("c.content")}, k.keyword)) WHERE n <= 10),
            u AS (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY origin) AS seen FROM (SELECT query_id, id, 1 AS origin, rank, similarity FROM h UNION ALL SELECT query_id, id, 2, min(pos), NULL FROM k JOIN f USING (keyword) GROUP BY ALL)),
            o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY origin, rank, id) AS original, count(*) OVER (PARTITION BY query_id) AS n FROM u WHERE seen = 1),
            j AS (SELECT o.*, c.content, s.query FROM o JOIN {ONCE} c USING (id) JOIN search_queries s USING (query_id) WHERE original <= 30),
            p AS (SELECT query_id, id, origin, similarity, original, CASE WHEN n > 5 THEN coalesce(s, 0) END AS rerank_score FROM {overlap.replace("@", "j")})
            SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC NULLS LAST, original, id) AS place, id, origin, similarity, rerank_score FROM p QUALIFY place <= 5""",
        "query_collection": f"WITH v AS {first}, {asked}, {hits(5, ' AND v.collection_id = s.collection_id')} SELECT query_id, rank AS place, id, similarity FROM h",
        "match_filtered": f"""
            WITH v AS {first}, {asked}, m AS (SELECT id, any_value(metadata) AS m FROM chunks GROUP BY id),
            k AS (SELECT id FROM m WHERE json_valid(m) AND (m->>'$.language' = 'en' OR (m->>'$.language' = 'de' AND m->>'$.domain' = 'tax') OR m->>'$.domain' = 'contract')),
            {hits(10, " AND v.collection_id IN (SELECT id FROM collections WHERE user_id IS NOT NULL) AND v.id IN (FROM k)")} SELECT query_id, rank, id, similarity FROM h""",
        "colbert_search": f"""
            WITH v AS {first}, {asked}, {hits(20)}, e AS (SELECT query_id, id, rank, similarity, st, list_transform(se, lambda s: {each}) AS m FROM h JOIN a USING (query_id) JOIN v USING (id)),
            b AS (SELECT *, {best} AS top, round(coalesce({best}::DECIMAL(9, 6), CASE WHEN similarity < 1 THEN 1 - similarity::DECIMAL(9, 6) ELSE 0.5 END), 4)::DOUBLE AS colbert_score FROM e)
            SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY colbert_score DESC, rank, id) AS place, id, colbert_score, coalesce(list_position(m, top) - 1, -1)::INT AS best_sentence, left(st[list_position(m, top)], 100) AS match FROM b QUALIFY place <= 8""",
        "embedding_rerank": f"""
            WITH v AS {first}, {asked}, c AS (SELECT query_id, chunk_id AS id, rank FROM {BY_SCORE} WHERE rank <= 20), s AS (SELECT c.*, {cos} AS s FROM c LEFT JOIN v USING (id) LEFT JOIN a USING (query_id))
            SELECT query_id, id, rank AS original_rank, s AS rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC NULLS LAST, rank, id) AS reranked_position FROM s QUALIFY reranked_position <= 5""",
        "decomposed_search": f"""
            WITH p AS (SELECT query_id, 0 AS part, CASE WHEN {split} THEN 'contract term' ELSE query END AS query, {split} AS many FROM search_queries UNION ALL SELECT query_id, 1, 'bank guarantee', true FROM search_queries WHERE {split}),
            r AS ({_bm25("(SELECT query_id || '|' || part AS query_id, query FROM p)", 10)}),
            l AS (SELECT split_part(query_id, '|', 1)::BIGINT AS query_id, split_part(query_id, '|', 2)::INT AS l, rank - 1 AS r, left(coalesce(content, ''), 500) AS key FROM r JOIN {ONCE} USING (id)),
            n AS (SELECT query_id, min(l) = max(l) AS lone FROM l GROUP BY 1),
            f AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(sum(1 / (61.0::DOUBLE + r)), 10) DESC, min(l * 1000000 + r), key) AS place, key, round(sum(1 / (61.0::DOUBLE + r)), 10) AS rrf_score FROM l JOIN n USING (query_id) WHERE NOT lone GROUP BY query_id, key)
            SELECT * FROM f WHERE place <= 10 UNION ALL SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY r, key) AS place, key, NULL FROM l JOIN n USING (query_id) WHERE lone QUALIFY place <= 10""",
        "agentic_search": f"""
            WITH r0 AS ({_bm25("search_queries", 5)}), c AS (SELECT query_id, count(r0.id) AS n FROM search_queries LEFT JOIN r0 USING (query_id) GROUP BY 1),
            r1 AS ({_bm25("(SELECT query_id, 'bank guarantee' AS query FROM c WHERE n < 5)", 5)}),
            l AS (SELECT query_id, l, rank - 1 AS r, left(coalesce(content, ''), 200) AS key, asked FROM (SELECT query_id, id, rank, 0 AS l, query AS asked FROM r0 JOIN search_queries USING (query_id) UNION ALL SELECT query_id, id, rank, 1, 'bank guarantee' FROM r1) JOIN {ONCE} USING (id)),
            f AS (SELECT query_id, key, round(sum(1 / (61.0::DOUBLE + r)), 10) AS rrf_score, min(l) AS first_list, arg_min(r, l * 1000000 + r) AS first_rank, row_number() OVER (PARTITION BY query_id ORDER BY round(sum(1 / (61.0::DOUBLE + r)), 10) DESC, min(l * 1000000 + r), key) AS place FROM l GROUP BY query_id, key QUALIFY place <= 8),
            e AS (SELECT query_id, key, string_agg(l::VARCHAR, ',' ORDER BY l) AS lists_found, array_to_string(list_filter(list(asked ORDER BY l), lambda x, i: list_position(list(asked ORDER BY l), x) = i), ',') AS labels_found FROM (SELECT DISTINCT query_id, key, l, asked FROM l) GROUP BY ALL)
            SELECT f.*, lists_found, labels_found, 'agentic_' || (place - 1) AS id FROM f JOIN e USING (query_id, key)""",
        "result_context": f"SELECT query_id, md5(c) AS digest, length(c)::INT AS size FROM (SELECT query_id, string_agg('[Source: ' || chunk_id || ']' || chr(10) || document, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS c FROM {BY_SCORE} WHERE rank <= 3 GROUP BY 1)",
        "result_stats": "SELECT query_id, count(*) AS results, round(avg(colbert_score), 6) AS avg_score, count(*) FILTER (WHERE len(sentence_scores) > 0) AS with_vectors FROM colbert_results WHERE query_id IS NOT NULL AND NOT isnan(colbert_score) GROUP BY 1",
        "positional_zip": """
            SELECT query_id, chunk_id, pos::INT AS pos, CASE WHEN NOT isnan(s[pos + 1]) THEN s[pos + 1] END AS sentence_scores, t[pos + 1] AS matched_sentences
            FROM (SELECT query_id, chunk_id, sentence_scores AS s, matched_sentences AS t, unnest(range(0, greatest(coalesce(len(sentence_scores), 0), coalesce(len(matched_sentences), 0)))) AS pos FROM colbert_results)""",
        "adaptive_params": f"""
            SELECT query_id, coalesce(retrieval_settings.search_mode, 'hybrid') = 'hybrid' AS use_hybrid, coalesce(retrieval_settings.reranking_enabled, true) AS use_reranking, n_results
            FROM ({_query_class("(SELECT query_id, query AS raw FROM search_queries)")}) JOIN (SELECT query_id, collection_id FROM search_queries) USING (query_id) LEFT JOIN collections c ON c.id = collection_id""",
        "json_mode": "SELECT id, json_valid(m) AS is_json, CASE WHEN json_valid(m) THEN m->>'$.source' END AS source, CASE WHEN NOT json_valid(m) THEN length(m)::INT + 12 ELSE 0 END AS size FROM (SELECT id, any_value(metadata) AS m FROM chunks WHERE id IS NOT NULL AND metadata IS NOT NULL GROUP BY id)",
        "prompt_fill": "SELECT doc_id, md5(concat('Summarise the following ', doc_type, ' in 3 sentences.', chr(10), chr(10), text)) AS digest FROM documents",
        "collection_lookup": "SELECT id, name FROM collections WHERE name = (SELECT min(name) FROM collections)",
        "cascade_delete": """
            WITH t AS (SELECT c.id FROM collections c LEFT JOIN chunks k ON k.collection_id = c.id GROUP BY c.id, c.name ORDER BY count(DISTINCT k.id) DESC, c.name LIMIT 1)
            SELECT 'collections' AS what, count(*) AS n FROM collections WHERE id NOT IN (FROM t) UNION ALL SELECT 'chunks', count(*) FROM chunks WHERE collection_id IS NULL OR collection_id NOT IN (FROM t)""",
        "tenant_rows": "SELECT id, user_id FROM collections WHERE user_id = (SELECT min(user_id) FROM collections)",
        "new_collections": """
            SELECT name, coalesce(retrieval_settings.search_mode, 'hybrid') AS search_mode, coalesce(retrieval_settings.sac_enabled, false) AS sac_enabled FROM collections WHERE name = (SELECT min(name) FROM collections)
            UNION ALL SELECT 'a new one', 'hybrid', true""",
        "insert_rows": r"""
            SELECT sha256(concat_ws(chr(1), 'c1', '{}', text)) AS id, 'c1' AS collection_id, md5(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFD}\x{FEFF}\x{FFFE}\x{E000}-\x{F8FF}]', '', 'g')) AS digest FROM documents WHERE text IS NOT NULL""",
        "sentence_vectors_of": "SELECT id, coalesce(len(any_value(sentence_embeddings)), -1)::INT AS vectors, coalesce(len(any_value(sentence_texts)), -1)::INT AS texts FROM chunks WHERE id IN (SELECT chunk_id FROM colbert_results) GROUP BY id",
        "chunk_config": """
            SELECT query_id, model, dimensions, chunk_size, chunk_overlap FROM search_queries JOIN (VALUES (0, 'voyage-3-large', 1024, 384, 75), (1, 'embed-v3', 1024, 384, 75), (2, 'text-embedding-3-small', 1536, 256, 50)) m(k, model, dimensions, chunk_size, chunk_overlap) ON k = query_id % 3""",
        "json_replies": """
            SELECT query_id, unnest(range(0, len(q)))::INT AS pos, unnest(q) AS question FROM (
                SELECT query_id, CASE query_id % 3 WHEN 0 THEN ['first ', query_id::VARCHAR] WHEN 1 THEN ['a longer question ' || query_id, 'another long question'] ELSE ['asked ' || query_id] END AS q FROM search_queries)""",
        "hyde_expand": "SELECT query_id, CASE WHEN length(query) >= 10 THEN 'Answer to ' || query ELSE query END AS expanded FROM search_queries",
        "chat_history": f"SELECT * FROM {MESSAGES} WHERE role <> 'tool' AND content <> '' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3",
        "latest_classification": f"SELECT conv_id, arg_max(content, turn) AS classification FROM {MESSAGES} WHERE role = 'assistant' AND regexp_matches(content, 'FINAL CLASSIFICATION|❌|🔴|🟡|🟢') GROUP BY 1",
        "workflow_halt": "SELECT doc_id, CASE WHEN n_chars > 900 THEN 'completed' ELSE 'halted' END AS status, CASE WHEN n_chars > 900 THEN coalesce(lang, '') || ' text of ' || n_chars END AS output FROM documents",
    }


def oracle_sql() -> dict[str, str]:
    abbreviations = "|".join(sorted(set(text.ABBREVIATIONS), key=lambda w: (-len(w), w)))
    mark = text.ABBREV_DOT
    protected = rf"regexp_replace(regexp_replace(syn, '(^|[^\p{{L}}\p{{M}}\p{{N}}_])({abbreviations})\.', '\1\2{mark}', 'gi'), '(^|[^\p{{L}}\p{{M}}\p{{N}}_])({abbreviations})\.', '\1\2{mark}', 'gi')"
    cut = rf"string_split(regexp_replace({{}}, '([.!?]){S}+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1))"
    trim = f"regexp_replace({{}}, '^{S}+|{S}+$', '', 'g')"

    def parts(c: str) -> str:
        return f"list_filter(list_transform({cut.format(c)}, lambda x: {trim.format('x')}), lambda x: x <> '')"

    shielded = f"list_transform({parts(protected.replace('syn', 's', 1))}, lambda x: replace(x, '{mark}', '.'))"

    def group(pattern: str, i: int) -> str:
        return f"regexp_extract_all(syn, {_re(pattern)}, {i})"

    date_day = _re(r"(?i)([0-9]{1,2}[ \t\n\r\f]+(?:" + fixed.MONTH + r")[ \t\n\r\f]+[0-9]{4})")
    refs = f"list_transform(list_zip({group(fixed.ARTICLE_REF, 1)}, {group(fixed.ARTICLE_REF, 2)}), lambda m: m[1] || ' ' || m[2])[1:5]"
    dates = f"list_transform(list_zip({group(fixed.DATE, 1)}, {group(fixed.DATE, 2)}), lambda m: m[1] || ', ' || m[2])[1:3]"
    cites = f"list_transform(list_zip({', '.join(group(fixed.REPORT_CITATION, i) for i in range(1, 5))}), lambda m: '(' || m[1] || ') ' || m[2] || ' ' || m[3] || ' ' || m[4])[1:3]"
    found = f"list_transform({group(fixed.ENTITY, 1)}, lambda x: lower(x))"
    entities = f"list_transform(list_filter(list_zip({found}, range(1, len({found}) + 1)), lambda m: list_position({found}, m[1]) = m[2]), lambda m: m[1])[1:5]"
    defaults = {"search_mode": "'hybrid'", "reranking_enabled": "true", "legal_tokenization": "true", "sac_enabled": "false", "hyde_enabled": "false", "query_decomposition_enabled": "false", "agentic_enabled": "false", "colbert_enabled": "false"}
    return {
        "vector_topk": f"SELECT b.vec_id, {COS.format('b.embedding', 'q.embedding')} AS similarity FROM embeddings b, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE {COS.format('b.embedding', 'q.embedding')} > 0 ORDER BY 2 DESC, 1 LIMIT 10",
        "vector_topk_batch": _search("embeddings", 5),
        "vector_filtered": _search("(SELECT * FROM embeddings WHERE label BETWEEN 0 AND 5 AND (label = 3 OR (label = 5 AND vec_id % 2 = 0) OR vec_id % 2 = 1))", 10),
        "threshold_gate": _search("embeddings", 5, "similarity >= 0.3"),
        "vector_match_models": " UNION ALL ".join(_match(m, c) for m, c in (("lexvec-small", "embedding_1536"), ("lexvec-multi", "embedding_1024"), ("lexvec-deep", "embedding_1792"))),
        "maxsim_labels": f"SELECT query_id, label, max(s) AS score, arg_max(vec_id, (s, -vec_id)) AS best FROM (SELECT q.vec_id AS query_id, b.label, b.vec_id, {COS.format('b.embedding', 'q.embedding')} AS s FROM embeddings q, embeddings b WHERE q.vec_id % 100 = 0) GROUP BY 1, 2",
        "rrf_fusion": f"""
            WITH n AS (SELECT query_id, min(l) = max(l) AS lone FROM {LISTS} GROUP BY 1), f AS ({_fused(500, 10)})
            SELECT f.* FROM f JOIN n USING (query_id) WHERE NOT lone UNION ALL
            SELECT query_id, left(coalesce(document, ''), 500) AS key, NULL, l, r, row_number() OVER (PARTITION BY query_id ORDER BY r) AS place FROM {LISTS} JOIN n USING (query_id) WHERE lone QUALIFY place <= 10""",
        "rrf_agentic": f"""
            WITH f AS ({_fused(200, 8)}), e AS (SELECT DISTINCT query_id, left(coalesce(document, ''), 200) AS key, l, asked FROM {LISTS})
            SELECT f.*, string_agg(e.l::VARCHAR, ',' ORDER BY e.l) AS lists_found, string_agg(e.asked, ',' ORDER BY e.l) AS labels_found FROM f JOIN e USING (query_id, key) GROUP BY ALL""",
        "hybrid_merge": f"""
            WITH k AS (SELECT query_id, unnest(range(0, len(w))) AS pos, unnest(w) AS keyword FROM (SELECT query_id, {_keywords("query")} AS w FROM search_queries)),
            h AS (SELECT keyword, id FROM (SELECT k.keyword, c.id, row_number() OVER (PARTITION BY k.keyword ORDER BY c.id) AS n FROM (SELECT DISTINCT keyword FROM k) k JOIN {ONCE} c ON contains({LOW.format("c.content")}, k.keyword)) WHERE n <= 10),
            a AS (SELECT query_id, chunk_id AS id, 1 AS origin, rank FROM {BY_SCORE} WHERE rank <= 30 UNION ALL SELECT query_id, id, 2, min(pos) FROM k JOIN h USING (keyword) GROUP BY ALL),
            u AS (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY origin) AS seen FROM a)
            SELECT query_id, id, origin, row_number() OVER (PARTITION BY query_id ORDER BY origin, rank, id) AS place FROM u WHERE seen = 1 QUALIFY place <= 8""",
        "colbert_rerank": f"""
            SELECT query_id, chunk_id, rank AS original_rank, s AS rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, rank) AS reranked_position
            FROM (SELECT query_id, chunk_id, rank, round(coalesce(list_max(list_filter(sentence_scores, lambda x: x IS NOT NULL AND NOT isnan(x))), CASE WHEN original_score < 1 THEN 1 - original_score ELSE 0.5 END), 4) AS s FROM {BY_SCORE} WHERE rank <= 20)
            QUALIFY reranked_position <= 8""",
        "rerank_lexical": f"""
            WITH p AS (SELECT c.query_id, chunk_id, rank, list_distinct(regexp_extract_all({LOW.format("q.query")}, '{W}+')) AS a, list_distinct(regexp_extract_all({LOW.format("c.document")}, '{W}+')) AS b
                       FROM {BY_SCORE} c JOIN search_queries q USING (query_id) WHERE rank <= 30),
            s AS (SELECT query_id, chunk_id, rank, CASE WHEN len(a) + len(b) > 0 THEN round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))), 6) ELSE 0 END AS s FROM p)
            SELECT query_id, chunk_id, rank AS original_rank, coalesce(s, 0) AS rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(s, 0) DESC, rank) AS reranked_position FROM s QUALIFY reranked_position <= 5""",
        "keyword_search": f"""
            SELECT keyword, id FROM (SELECT k.keyword, c.id, row_number() OVER (PARTITION BY k.keyword ORDER BY c.id) AS n
                FROM (SELECT DISTINCT unnest({_keywords("query")}) AS keyword FROM search_queries) k JOIN {ONCE} c ON contains({LOW.format("c.content")}, k.keyword)) WHERE n <= 10""",
        "bm25_topk": _bm25("search_queries", 5),
        "keywords": f"SELECT doc_id, coalesce(array_to_string({_keywords('text')}, ' ; '), '') AS keywords FROM documents",
        "sentences": f"SELECT doc_id, unnest(range(0, len(a)))::INT AS pos, unnest(a) AS sentence FROM (SELECT doc_id, {parts('text')} AS a FROM documents WHERE text IS NOT NULL)",
        "sentences_protected": f"SELECT doc_id, len(a) AS n, a[2] AS second FROM (SELECT doc_id, list_transform({parts(protected)}, lambda x: replace(x, '{mark}', '.')) AS a FROM {SEEDED})",
        "words": f"SELECT doc_id, len(w) AS n, coalesce(w[1], '') AS first, coalesce(w[-1], '') AS last FROM (SELECT doc_id, list_transform(regexp_extract_all({protected.replace('syn', 'text', 1)}, '{W}+(?:{mark})?'), lambda x: replace(x, '{mark}', '.')) AS w FROM documents WHERE text IS NOT NULL)",
        "abbrev_protect": f"SELECT doc_id, {protected} AS protected FROM {SEEDED}",
        "normalize_text": f"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace('see SECTION 4 and  article 5 ' || text, '{S}+', ' ', 'g'), '(^|[^{W[1:-1]}])section ', '\\1Section ', 'gi'), '(^|[^{W[1:-1]}])article ', '\\1Article ', 'gi'), '(^|[^{W[1:-1]}])paragraph ', '\\1Paragraph ', 'gi'), '(^|[^{W[1:-1]}])clause ', '\\1Clause ', 'gi'), ' ') AS normal FROM documents WHERE text IS NOT NULL",
        "sanitize": r"SELECT doc_id, regexp_replace(concat('abc', text), '[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFD}\x{FEFF}\x{FFFE}\x{E000}-\x{F8FF}]', '', 'g') AS clean FROM documents",
        "token_stats": "SELECT source, count(*) AS n, sum(coalesce(length(text), 0) // 4)::BIGINT AS tokens, max(coalesce(length(text), 0) // 4) AS most, count(*) FILTER (WHERE coalesce(length(text), 0) // 4 < 25) AS short FROM documents GROUP BY source",
        "previews": "SELECT doc_id, CASE WHEN length(text) > 500 THEN left(text, 500) || '...' ELSE text END AS preview FROM documents",
        "enhance": "SELECT doc_id, CASE WHEN length(text) >= 50 THEN '[CONTEXT: about ' || coalesce(doc_type, '?') || ']' || chr(10) || chr(10) || text ELSE text END AS enhanced FROM documents",
        "template_fill": "SELECT query_id, 'Dear ' || query_id || ', on ' || coalesce(query, '') || ' in ' || coalesce(collection_id, '') || ':  {{collection.name}} {{none.name}}' AS filled FROM search_queries",
        "chunk_pack": _pack("SELECT doc_id AS key, text AS s FROM documents WHERE text IS NOT NULL", shielded, 0, PACKED),
        "chunk_overlap": _pack("SELECT doc_id AS key, text AS s FROM documents WHERE text IS NOT NULL", shielded, 50, PACKED),
        "simple_chunks": f"""
            WITH RECURSIVE t AS (SELECT doc_id, a, list_transform(a, lambda x: length(x) // 4) AS n FROM (
                SELECT doc_id, list_filter(list_transform(string_split(replace(text, chr(10), ' '), '. '), lambda x: {trim.format("x")}), lambda x: x <> '') AS a FROM documents WHERE text IS NOT NULL) WHERE len(a) > 0),
            walk(doc_id, n, i, start, held, out_first, out_last) AS (
                SELECT doc_id, n, 0, 0, 0::BIGINT, -1, -1 FROM t UNION ALL
                SELECT doc_id, n, i + 1, CASE WHEN f THEN i - 1 ELSE start END, CASE WHEN f THEN n[i] + n[i + 1] ELSE held + n[i + 1] END, CASE WHEN f THEN start ELSE -1 END, CASE WHEN f THEN i - 1 ELSE -1 END
                FROM (SELECT *, i > start AND held + n[i + 1] > 256 AS f FROM walk WHERE i < len(n))),
            r AS (SELECT doc_id, out_first AS first, out_last AS last FROM walk WHERE out_first >= 0 UNION ALL SELECT doc_id, start, i - 1 FROM walk WHERE i = len(n))
            SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY last) - 1)::INT AS chunk_index, (count(*) OVER (PARTITION BY doc_id))::INT AS total_chunks, md5(array_to_string(a[first + 1:last + 1], '. ') || '.') AS digest FROM r JOIN t USING (doc_id)""",
        "structured_chunks": _structured(shielded, trim),
        "index_chunks": f"""
            SELECT doc_id, chunk_index, type, token_count, md5(chunk) AS digest, md5(CASE WHEN p <> '' THEN '[' || p || '] ' ELSE '' END || chunk) AS context_digest FROM (
                SELECT *, concat_ws(' | ', CASE WHEN docket <> '' THEN 'Document: ' || translate(replace(docket, '.pdf', ''), '_-', '  ') END, CASE WHEN type = 'legal_section' THEN 'Type: Legal provision' END,
                    CASE WHEN len(r) > 0 THEN 'References: ' || array_to_string(r[1:3], ', ') END, CASE WHEN len(e) > 0 THEN 'Entities: ' || array_to_string(e[1:3], ', ') END,
                    CASE WHEN len(d) > 0 THEN 'Dates: ' || d[1] END, CASE WHEN len(c) > 0 THEN 'Cites: ' || c[1] END) AS p
                FROM (SELECT *, {refs.replace("syn", "chunk")} AS r, {entities.replace("syn", "chunk")} AS e, {dates.replace("syn", "chunk")} AS d, {cites.replace("syn", "chunk")} AS c
                      FROM ({_structured(shielded, trim, "chunk")}) JOIN (SELECT doc_id, docket FROM documents) USING (doc_id) WHERE token_count >= 25))""",
        "contract_chunks": _contract(
            "concat('Between the parties', chr(10), '1. Scope', chr(10), text, chr(10), '2.1 - Term', chr(10), 'Two years.', chr(10), chr(10), '3. End', chr(10), 'Never.')",
            "kind, number AS section_number, title AS section_title, a::INT AS start_char, b::INT AS end_char, md5(content) AS digest",
        ),
        "contract_prefix": _contract("text", "md5('[' || concat_ws(' - ', 'Section ' || nullif(number, ''), nullif(title, '')) || ']' || chr(10) || chr(10) || content) AS digest"),
        "sentence_vector_counts": f"SELECT doc_id, n::INT AS num_sentences, n::INT AS vectors, digest FROM ({_colbert_sentences(trim)})",
        "metadata_fallback": f"""
            SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'case_law' ELSE {_first(fixed.DOCUMENT_TYPES)} END AS document_type, CASE WHEN doc_id % 2 = 0 THEN 'EU' ELSE {_first(fixed.JURISDICTIONS)} END AS jurisdiction,
                   CASE WHEN doc_id % 2 = 0 THEN '2020-05-06' WHEN iso <> '' THEN iso WHEN dmy <> '' THEN strftime(try_strptime(regexp_replace(dmy, '{S}+', '-', 'g'), '%d-%B-%Y'), '%Y-%m-%d') END AS date
            FROM (SELECT doc_id, lower(left(syn, 3000)) AS h, regexp_extract(left(syn, 3000), '([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})', 1) AS iso, regexp_extract(left(syn, 3000), {date_day}, 1) AS dmy FROM {SEEDED})""",
        "summaries": f"SELECT doc_id, CASE WHEN l THEN 'of a text' ELSE '' END AS summary, md5(CASE WHEN l THEN '[CONTEXT: of a text]' || chr(10) || chr(10) || text ELSE text END) AS digest FROM (SELECT doc_id, text, coalesce(length({trim.format('text')}) >= 50, false) AS l FROM documents)",
        "colbert_sentences": _colbert_sentences(trim),
        **_retrieval(),
        "chunk_sections": f"""
            WITH x AS (SELECT doc_id, 'Preamble. ' || syn || ' Section 9 ends.' || CASE WHEN doc_id % 2 = 0 THEN ' Chapter 10 too.' ELSE '' END AS t FROM {SEEDED}),
            p AS (SELECT doc_id, unnest(string_split(regexp_replace(t, '((?:Article|Section|Regulation|§|Chapter|Part|Title|Rule){S}+[0-9]+[.0-9]*[0-9A-Za-z_]*)', chr(1) || '\\1', 'gi'), chr(1))[2:]) AS s FROM x)
            SELECT doc_id, regexp_extract(s, '(?i)^((?:Article|Section|Regulation|§|Chapter|Part|Title|Rule){S}+[0-9]+[.0-9]*[0-9A-Za-z_]*)', 1) AS head, length({trim.format("s")}) AS size FROM p""",
        "legal_refs": f"SELECT doc_id, array_to_string({refs}, ' ; ') AS refs FROM {SEEDED}",
        "legal_dates": f"SELECT doc_id, array_to_string({dates}, ' ; ') AS dates FROM {SEEDED}",
        "legal_citations": f"SELECT doc_id, array_to_string({cites}, ' ; ') AS cites FROM {SEEDED}",
        "legal_entities": f"SELECT doc_id, array_to_string({entities}, ' ; ') AS entities FROM {SEEDED}",
        "citations": f"""
            WITH c AS (SELECT doc_id, list_zip({", ".join(group(fixed.CASE_CITATION, i) for i in range(1, 7))}) AS a, list_zip({group(fixed.STATUTE, 1)}, {group(fixed.STATUTE, 2)}) AS b FROM {SEEDED}),
            e AS (SELECT doc_id, unnest(range(0, len(a)))::INT AS pos, 'case' AS kind, unnest(a) AS m, NULL AS s FROM c UNION ALL SELECT doc_id, (len(a) + unnest(range(0, len(b))))::INT, 'statute', NULL, unnest(b) FROM c)
            SELECT doc_id, pos, kind, coalesce(m[1], s[1]) AS volume, coalesce(m[3], s[2]) AS page, m[6] AS year,
                   CASE kind WHEN 'case' THEN m[1] || ' ' || m[2] || ' ' || m[3] || CASE WHEN m[4] <> '' THEN ', ' || m[4] ELSE '' END || ' (' || m[5] || ' ' || m[6] || ')' ELSE s[1] || ' U.S.C. § ' || s[2] END AS normal FROM e""",
        "context_prefix": f"""
            SELECT doc_id, '[' || concat_ws(' | ', CASE WHEN docket IS NOT NULL THEN 'Document: ' || translate(docket, '_-', '  ') || ' a b' END, 'Type: Legal provision',
                CASE WHEN len(r) > 0 THEN 'References: ' || array_to_string(r[1:3], ', ') END, CASE WHEN len(e) > 0 THEN 'Entities: ' || array_to_string(e[1:3], ', ') END,
                CASE WHEN len(d) > 0 THEN 'Dates: ' || d[1] END, CASE WHEN len(c) > 0 THEN 'Cites: ' || c[1] END) || '] ' AS prefix
            FROM (SELECT doc_id, docket, {refs} AS r, {entities} AS e, {dates} AS d, {cites} AS c FROM {SEEDED})""",
        "metadata_heuristic": f"""
            WITH x AS (SELECT doc_id, left(syn, 3000) AS t, lower(left(syn, 3000)) AS h FROM {SEEDED}),
            y AS (SELECT *, regexp_extract(t, '([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})', 1) AS iso, regexp_extract(t, {date_day}, 1) AS dmy FROM x)
            SELECT doc_id, {_first(fixed.DOCUMENT_TYPES)} AS document_type, {_first(fixed.JURISDICTIONS)} AS jurisdiction, {_first(fixed.PRACTICE_AREAS)} AS practice_area,
                   CASE WHEN iso <> '' THEN iso WHEN dmy <> '' THEN regexp_replace(dmy, '{S}+', '-', 'g') END AS date,
                   CASE WHEN iso <> '' THEN iso WHEN dmy <> '' THEN strftime(try_strptime(regexp_replace(dmy, '{S}+', '-', 'g'), '%d-%B-%Y'), '%Y-%m-%d') END AS date_iso FROM y""",
        "enabled_metadata": f"""
            SELECT doc_id, concat_ws(';', 'document_type=' || {_first(fixed.DOCUMENT_TYPES)}, 'jurisdiction=' || {_first(fixed.JURISDICTIONS)}) AS kept FROM (SELECT doc_id, lower(left(syn, 3000)) AS h FROM {SEEDED})""",
        "reporters": f"""
            SELECT doc_id, pos, CASE regexp_replace(r, '{S}', '', 'g') {" ".join(f"WHEN {_re(k)} THEN {_re(v)}" for k, v in fixed.REPORTERS.items())} END AS reporter
            FROM (SELECT doc_id, unnest(range(0, len(a)))::INT AS pos, unnest(a) AS r FROM (SELECT doc_id, {group(fixed.CASE_CITATION, 2)} AS a FROM {SEEDED}))""",
        "metadata_normal": "SELECT doc_id, replace(lower(doc_type), ' ', '_') AS doc_type, CASE WHEN doc_id % 2 = 0 THEN 'EU' ELSE jurisdiction END AS jurisdiction FROM documents",
        "query_class": _query_class(),
        "decompose_gate": f"SELECT query_id, raw AS q, coalesce(length(raw) >= 20 AND ({' OR '.join(f'regexp_matches(raw, {_re("(?i)" + p)})' for p in fixed.DECOMPOSE)} OR {N_WORDS.format('raw')} > 20), false) AS decompose FROM {ASKED}",
        "collection_counts": "SELECT c.id, c.name, count(DISTINCT k.id) AS n_chunks FROM collections c LEFT JOIN chunks k ON k.collection_id = c.id GROUP BY 1, 2",
        "settings_merge": "SELECT id, " + ", ".join(f"coalesce(retrieval_settings.{k}, {v}) AS {k}" for k, v in defaults.items()) + " FROM collections",
        "legal_sources": "SELECT id, name FROM collections WHERE json_valid(metadata) AND metadata->>'$.source_type' = 'legal_source'",
        "get_documents": "SELECT DISTINCT id, collection_id, length(content)::INT AS size FROM chunks WHERE id IN (SELECT chunk_id FROM colbert_results)",
        "delete_documents": "SELECT DISTINCT id FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM colbert_results r WHERE r.chunk_id = c.id)",
        "incremental_anti": "SELECT doc_id::VARCHAR AS id FROM documents WHERE doc_id NOT IN (SELECT query_id FROM colbert_results)",
        "model_registry": "WITH u AS (SELECT id, CASE WHEN json_valid(metadata) THEN metadata->>'$.embedding_model' END AS m FROM collections) SELECT u.id, e.model, e.vector_column, e.stored_dims, e.max_tokens FROM u JOIN embedding_models e ON e.model = CASE WHEN u.m IN (SELECT model FROM embedding_models) THEN u.m ELSE 'lexvec-small' END",
        "history_latest": "SELECT collection_id, arg_max(query, (issued_at, query_id)) AS query, max(issued_at) AS issued_at FROM search_queries WHERE query <> '' GROUP BY 1",
        "llm_cost": """
            WITH u AS (SELECT coalesce(doc_type, 'unknown') AS model, coalesce(length(text), 0) // 4 AS i FROM documents)
            SELECT model, count(*) AS calls, sum(i)::BIGINT AS tokens_in, (count(*) * 100)::BIGINT AS tokens_out,
                   round(sum(i)::DOUBLE / 1000 * CASE model WHEN 'case_law' THEN 0.0025 WHEN 'contract' THEN 0.00014 ELSE 0.001 END + count(*) * 100.0::DOUBLE / 1000 * CASE model WHEN 'case_law' THEN 0.01 WHEN 'contract' THEN 0.00028 ELSE 0.002 END, 6) AS cost FROM u GROUP BY model""",
        "workflow_levels": """
            WITH RECURSIVE e(a, b) AS (VALUES ('start', 'route'), ('start', 'count'), ('route', 'long'), ('long', 'both'), ('count', 'both')),
            w(node, level) AS (SELECT 'start', 0 UNION ALL SELECT b, level + 1 FROM w JOIN e ON a = node) SELECT node, max(level) AS level FROM w GROUP BY node""",
        "workflow_route": """
            SELECT doc_id, 'completed' AS status, CASE WHEN n_chars > 500 THEN 'long ' || coalesce(lang, '') || ' text of ' || n_chars ELSE '' END || ': ' || coalesce((n_chars // 4)::VARCHAR, '') || ' tokens' AS output FROM documents""",
        "session_count": """
            WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events WHERE ts IS NOT NULL)
            SELECT user_id, sum(fresh)::BIGINT AS sessions, count(*) AS events FROM g GROUP BY user_id""",
    }
