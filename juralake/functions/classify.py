"""Query classification and routing, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the four kinds of queries, of legal terms and of queries worth decomposing.
FACTUAL = (r"^(who|what|when|where|which)\s+", r"\b(is|was|are|were)\s+(the|a|an)\b", r"^(how many|how much)\b", r"\b(name|date|year|amount|number)\s+of\b")
KEYWORD = (r"^(define|definition|meaning|what is)\b", r"\b(means?|refer(s|ring)?\s+to)\b", r'^"[^"]+"$', r"^\w+(\s+\w+){0,2}$")
COMPLEX = (
    r"\b(compare|contrast|analyze|evaluate|assess)\b", r"\b(and|or|but|however|whereas)\b.*\b(and|or|but|however|whereas)\b",
    r"\b(implications?|consequences?|effects?|impacts?)\b", r"\b(should|must|shall|may)\b.*\b(if|when|unless|provided)\b", r"\?.*\?",
)
CONCEPTUAL = (r"^(how|why|explain|describe)\b", r"\b(concept|principle|theory|doctrine)\b", r"\b(relationship|connection|distinction)\s+between\b", r"\b(generally|typically|usually|overall)\b")
LEGAL = (r"\b(article|section|paragraph|clause)\s+\d+", r"\b(regulation|directive|statute|act)\b", r"\b(case|ruling|judgment|decision)\b", r"\b(penalty|fine|sanction|liability)\b")
DECOMPOSE = (
    r"\b(and|or)\b.*\b(and|or)\b", r"\b(compare|contrast|difference|versus|vs\.?)\b", r"\b(relationship|connection|interaction)\s+between\b",
    r"\b(analyze|evaluate|assess)\b.*\b(implications?|consequences?|effects?)\b", r"\?.*\?", r"\b(first|second|third|finally|also|additionally)\b",
)
#: Results to fetch for each kind, in the order that decides ties.
BASE_RESULTS = {"factual": 5, "keyword": 3, "complex": 10, "conceptual": 8}


def hits(text: Column, patterns: tuple[str, ...], each: float = 1.0) -> Column:
    """How many of ``patterns`` are found, times ``each``."""
    return sum((F.when(text.rlike(p), F.lit(each)).otherwise(F.lit(0.0)) for p in patterns), F.lit(0.0))


def _bonus(*cases: tuple[Column, float]) -> Column:
    return sum((F.when(c, F.lit(v)).otherwise(F.lit(0.0)) for c, v in cases), F.lit(0.0))


def scores(query: Column) -> dict[str, Column]:
    """The score of each kind for a query in lower case without margins."""
    n = F.size(F.filter(F.split(query, r"\s+"), lambda w: w != ""))
    return {
        "factual": hits(query, FACTUAL) + _bonus((n <= 6, 0.5)),
        "keyword": hits(query, KEYWORD) + _bonus((n <= 3, 1.5), (n == 1, 1.0)),
        "complex": hits(query, COMPLEX) + _bonus((n > 15, 1.0), (n > 25, 1.0)),
        "conceptual": hits(query, CONCEPTUAL) + _bonus(((n >= 5) & (n <= 15) & query.rlike("^(how|why)"), 0.5)),
    }


def classification(query: Column) -> Column:
    """Struct (kind, confidence, n_results, use_reranking) of a raw query; NULL and blank queries are factual at 0.5.

    The best score wins, ties by the order of BASE_RESULTS; confidence is the best's share of all scores plus 0.1, 0.95 at
    most. Legal terms add 0.3 each up to 1; above 0.5 two more results are fetched, 12 at most, and reranked.
    """
    q = F.regexp_replace(F.lower(query), r"^\s+|\s+$", "")
    each = scores(q)
    values = F.struct(*(v.alias(k) for k, v in each.items()), F.least(F.lit(1.0), hits(q, LEGAL, 0.3)).alias("boost"), (q.isNull() | (q == "")).alias("blank"))

    def told(s: Column) -> Column:
        best = F.greatest(*(s[k] for k in each))
        kind = F.lit([*each][-1])
        for name in reversed([*each][:-1]):
            kind = F.when(s[name] == best, F.lit(name)).otherwise(kind)
        total = sum((s[k] for k in each), F.lit(0.0))
        sure = F.least(F.lit(0.95), best / F.when(total > 0, total).otherwise(F.lit(1.0)) + 0.1)
        name = F.when(s["blank"], F.lit("factual")).otherwise(kind)
        n = F.create_map(*(F.lit(x) for kv in BASE_RESULTS.items() for x in kv))[name]
        legal = ~s["blank"] & (s["boost"] > 0.5)
        return F.struct(
            name.alias("kind"), F.when(s["blank"], F.lit(0.5)).otherwise(sure).alias("confidence"),
            F.when(legal, F.least(n + 2, F.lit(12))).otherwise(n).alias("n_results"),
            (legal | (name != "keyword")).alias("use_reranking"),
        )

    return F.transform(F.array(values), told)[0]  # bound once, else every pattern is tried at every mention


def should_decompose(query: Column) -> Column:
    """Whether a query of at least 20 characters has a sign of several questions, or more than 20 words; false for NULL."""
    found = F.lit(False)
    for p in DECOMPOSE:
        found = found | query.rlike("(?i)" + p)
    n = F.size(F.filter(F.split(query, r"\s+"), lambda w: w != ""))
    return F.coalesce((F.length(query) >= 20) & (found | (n > 20)), F.lit(False))


def adaptive_parameters(query: Column, search_mode: Column, reranking: Column) -> Column:
    """Struct (use_hybrid, use_reranking, n_results): a collection's settings, with as many results as the query's kind asks for.

    Settings that are NULL are hybrid and reranked.
    """
    return F.struct(
        (F.coalesce(search_mode, F.lit("hybrid")) == "hybrid").alias("use_hybrid"), F.coalesce(reranking, F.lit(True)).alias("use_reranking"),
        classification(query)["n_results"].alias("n_results"),
    )
