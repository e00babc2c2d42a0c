"""Pattern extraction: references, dates, citations, entities and heuristic metadata, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of legal references.
MONTH = "January|February|March|April|May|June|July|August|September|October|November|December"
ARTICLE_REF = r"(?i)(Article|Section|Regulation|§)[ \t\n\r\f]+([0-9]+[.0-9]*[0-9A-Za-z_]*)"
DATE = rf"(?i)([0-9]{{1,2}}[ \t\n\r\f]+(?:{MONTH})|(?:{MONTH})[ \t\n\r\f]+[0-9]{{1,2}})[, \t\n\r\f]+([0-9]{{4}})"
REPORT_CITATION = r"\([ \t\n\r\f]*([12][0-9]{3})[ \t\n\r\f]*\)[ \t\n\r\f]*([0-9]+)[ \t\n\r\f]*([A-Za-z]+)[ \t\n\r\f]*([0-9]+)"
ENTITY = (
    r"(?i)\b(plaintiff|defendant|respondent|appellant|applicant|claimant|court|judge|justice|tribunal|council|committee|"
    r"commission|parliament|legislature|government|minister|authority)\b"
)
CASE_CITATION = r"([0-9]+)[ \t\n\r\f]+([A-Z][A-Za-z. \t\n\r\f]+?)[ \t\n\r\f]+([0-9]+)(?:,[ \t\n\r\f]*([0-9]+))?[ \t\n\r\f]*\(([^)]+)[ \t\n\r\f]+([0-9]{4})\)"
STATUTE = r"(?i)([0-9]+)[ \t\n\r\f]+U\.S\.C\.[ \t\n\r\f]*§[ \t\n\r\f]*([0-9]+[a-z]?(?:\([a-z0-9]+\))?)"
# Reporters and their abbreviations.
REPORTERS = {
    "U.S.": "United States Reports",
    "S.Ct.": "Supreme Court Reporter",
    "L.Ed.": "Lawyers' Edition",
    "F.2d": "Federal Reporter, Second Series",
    "F.3d": "Federal Reporter, Third Series",
    "F.4th": "Federal Reporter, Fourth Series",
    "F.Supp.": "Federal Supplement",
    "F.Supp.2d": "Federal Supplement, Second Series",
    "F.Supp.3d": "Federal Supplement, Third Series",
}
# Patterns of document types, jurisdictions and practice areas, the first that matches wins.
DOCUMENT_TYPES = {
    "contract": (r"\b(agreement|contract|terms|covenant)\b", r"\b(parties?|undersigned)\b.*\b(agree|enter)\b"),
    "regulation": (r"\b(regulation|directive|rule)\b.*\b(no\.?|number)\s*\d+", r"\b(eu|ec|commission)\s+(regulation|directive)\b"),
    "case_law": (r"\b(case|judgment|ruling|decision)\b.*\b(c-\d+|no\.?\s*\d+)", r"\b(court|tribunal|chamber)\b.*\b(held|ruled|decided)\b"),
    "statute": (r"\b(act|code|statute)\b.*\b(section|§)\s*\d+", r"\b(enacted|effective)\b"),
    "memo": (r"\b(memorandum|memo)\b", r"\b(to|from|re|subject)\s*:"),
    "brief": (r"\b(brief|motion|petition)\b", r"\b(plaintiff|defendant|appellant|respondent)\b"),
    "policy": (r"\b(policy|guideline|guidance)\b", r"\b(compliance|procedure)\b"),
}
JURISDICTIONS = {
    "EU": (r"\b(european union|eu|tfeu|teu|ec directive|european commission)\b",),
    "US": (r"\b(united states|u\.?s\.?|federal|american)\b", r"\b(circuit|district court)\b"),
    "UK": (r"\b(united kingdom|uk|british|england|wales|scotland)\b",),
    "France": (r"\b(france|french|cour de cassation|tribunal)\b",),
    "Germany": (r"\b(germany|german|bundesgerichtshof|bgb)\b",),
    "International": (r"\b(international|wto|un|treaty|convention)\b",),
}
PRACTICE_AREAS = {
    "antitrust": (r"\b(antitrust|competition|cartel|merger|monopol|dominant position)\b", r"\b(article\s*10[12]|sherman|clayton)\b"),
    "data_protection": (r"\b(gdpr|data protection|privacy|personal data|processing)\b",),
    "corporate": (r"\b(corporate|governance|shareholder|board|director)\b",),
    "employment": (r"\b(employment|labor|worker|employee|termination|dismissal)\b",),
    "intellectual_property": (r"\b(patent|trademark|copyright|ip|intellectual property)\b",),
    "tax": (r"\b(tax|taxation|fiscal|vat|duty)\b",),
    "environmental": (r"\b(environmental|pollution|emission|climate|sustainability)\b",),
    "securities": (r"\b(securities|stock|share|listing|prospectus)\b",),
}
JURISDICTION_SYNONYMS = {"european union": "EU", "united states": "US", "united kingdom": "UK"}


def groups(text: Column, pattern: str, n: int, joined) -> Column:
    """Every match of ``pattern`` in order, as ``joined`` makes a column of its ``n`` groups."""
    parts = [F.regexp_extract_all(text, F.lit(pattern), F.lit(i)).alias(f"g{i}") for i in range(1, n + 1)]
    if n == 1:
        return F.transform(parts[0], joined)
    return F.transform(F.arrays_zip(*parts), lambda m: joined(*(m[f"g{i}"] for i in range(1, n + 1))))


def article_refs(text: Column, limit: int = 5) -> Column:
    """Up to ``limit`` references such as 'Article 5.2a', in order."""
    return F.slice(groups(text, ARTICLE_REF, 2, lambda a, b: F.concat_ws(" ", a, b)), 1, limit)


def dates(text: Column, limit: int = 3) -> Column:
    """Up to ``limit`` dates as 'day and month, year'."""
    return F.slice(groups(text, DATE, 2, lambda a, b: F.concat_ws(", ", a, b)), 1, limit)


def report_citations(text: Column, limit: int = 3) -> Column:
    """Up to ``limit`` citations as '(year) volume reporter page'."""
    return F.slice(groups(text, REPORT_CITATION, 4, lambda y, v, r, p: F.concat(F.lit("("), y, F.lit(") "), F.concat_ws(" ", v, r, p))), 1, limit)


def entities(text: Column, limit: int = 5) -> Column:
    """Up to ``limit`` different roles and bodies in lower case, as first seen."""
    return F.slice(F.array_distinct(groups(text, ENTITY, 1, F.lower)), 1, limit)


def citations(text: Column) -> Column:
    """Case citations, then statutes: structs (kind, volume, reporter, page, pin, court, year, full_text, normal)."""

    def made(kind: str, full: Column, normal: Column, **fields: Column) -> Column:
        names = ("volume", "reporter", "page", "pin", "court", "year")
        return F.struct(F.lit(kind).alias("kind"), *(fields.get(n, F.lit(None).cast("string")).alias(n) for n in names), full.alias("full_text"), normal.alias("normal"))

    def case(full, v, r, p, pin, court, year) -> Column:
        pinned = F.when(F.length(pin) > 0, F.concat(F.lit(", "), pin)).otherwise(F.lit(""))
        normal = F.concat(v, F.lit(" "), r, F.lit(" "), p, pinned, F.lit(" ("), court, F.lit(" "), year, F.lit(")"))
        return made("case", full, normal, volume=v, reporter=r, page=p, pin=F.when(F.length(pin) > 0, pin), court=court, year=year)

    def statute(full, title, section) -> Column:
        return made("statute", full, F.concat(title, F.lit(" U.S.C. § "), section), volume=title, page=section)

    return F.concat(groups(text, f"({CASE_CITATION})", 7, case), groups(text, "(?i)(" + STATUTE[4:] + ")", 3, statute))


def first_match(text: Column, patterns: dict[str, tuple[str, ...]]) -> Column:
    """The first name of ``patterns`` any of whose patterns is found in ``text``, else NULL."""
    out = F.lit(None).cast("string")
    for name, each in reversed(patterns.items()):
        hit = F.lit(False)
        for p in each:
            hit = hit | text.rlike(p)
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def heuristic_date(text: Column) -> Column:
    """The date that the first date pattern to match gives: ISO as it is, 'd Month Y' as d-Month-Y, 'Month d, Y' nothing."""
    iso = F.regexp_extract(text, r"([0-9]{4}-[0-9]{2}-[0-9]{2})", 1)
    day = F.regexp_extract(text, rf"(?i)([0-9]{{1,2}}[ \t\n\r\f]+(?:{MONTH})[ \t\n\r\f]+[0-9]{{4}})", 1)
    return F.when(iso != "", iso).when(day != "", F.regexp_replace(day, r"[ \t\n\r\f]+", "-"))


def iso_date(found: Column) -> Column:
    """A heuristic date in ISO form, NULL where it is none."""
    return F.coalesce(F.when(found.rlike(r"^[0-9]{4}-"), F.substring(found, 1, 10)), F.date_format(F.try_to_timestamp(found, F.lit("d-MMMM-yyyy")), "yyyy-MM-dd"))


def heuristic_metadata(content: Column, cut: int = 3000) -> Column:
    """Struct (document_type, jurisdiction, practice_area, date, date_iso) from the first ``cut`` characters, as the model would read."""
    head = F.substring(content, 1, cut)
    low = F.lower(head)
    date = heuristic_date(head)
    return F.struct(
        first_match(low, DOCUMENT_TYPES).alias("document_type"), first_match(low, JURISDICTIONS).alias("jurisdiction"),
        first_match(low, PRACTICE_AREAS).alias("practice_area"), date.alias("date"), iso_date(date).alias("date_iso"),
    )


def normal_label(c: Column) -> Column:
    """Lower case with underscores for spaces."""
    return F.replace(F.lower(c), F.lit(" "), F.lit("_"))


def normal_jurisdiction(c: Column) -> Column:
    out = c
    for raw, short in JURISDICTION_SYNONYMS.items():
        out = F.when(F.lower(c) == raw, F.lit(short)).otherwise(out)
    return out


def context_prefix(title: Column, section: Column, kind: Column, refs: Column, found: Column, on: Column, cites: Column) -> Column:
    """The bracketed head of a chunk: document, section, type, references, entities, first date and first citation; '' if none.

    NULL and empty parts are left out.
    """
    part = lambda head, c: F.when(F.length(c) > 0, F.concat(F.lit(f"{head}: "), c))
    clean = F.translate(F.replace(title, F.lit(".pdf"), F.lit("")), "_-", "  ")
    joined = F.concat_ws(
        " | ", part("Document", clean), part("Section", section), F.when(kind == "legal_section", F.lit("Type: Legal provision")),
        part("References", F.array_join(F.slice(refs, 1, 3), ", ")), part("Entities", F.array_join(F.slice(found, 1, 3), ", ")),
        part("Dates", F.get(on, F.lit(0))), part("Cites", F.get(cites, F.lit(0))),
    )
    return F.when(joined != "", F.concat(F.lit("["), joined, F.lit("] "))).otherwise(F.lit(""))


def json_object_in(reply: Column) -> Column:
    """The widest {...} in a model's reply as a VARIANT, NULL where it isn't valid JSON; code fences don't matter."""
    return F.try_parse_json(F.nullif(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), F.lit("")))


def json_array_in(reply: Column, original: Column) -> Column:
    """The first [...] of strings in a model's reply; else its lines without bullets and quotes, over 10 characters; else ``original`` alone."""
    listed = F.from_json(F.nullif(F.regexp_extract(reply, r"(?s)(\[.*?\])", 1), F.lit("")), "array<string>")
    lines = F.filter(F.transform(F.split(reply, "\n"), lambda s: F.regexp_replace(s, r"""^[\s\-*•0-9.)"']+|["'\s]+$""", "")), lambda s: F.length(s) > 10)
    return F.when(F.size(listed) > 0, listed).when(F.size(lines) > 0, lines).otherwise(F.array(original))


def json_or_text(reply: Column) -> Column:
    """Struct (json VARIANT, text): a model's reply without code fences where that is valid JSON, else its text as it came."""
    bare = F.trim(F.regexp_replace(reply, "```(?:json)?", ""))
    parsed = F.try_parse_json(F.nullif(bare, F.lit("")))
    return F.struct(parsed.alias("json"), F.when(parsed.isNull(), reply).alias("text"))


def unfenced(reply: Column) -> Column:
    """A reply that begins with a code fence without its first and last line; any other as it is, trimmed."""
    body = F.trim(reply)
    return F.when(body.startswith("```"), F.regexp_replace(body, r"(?s)^[^\n]*\n|\n?[^\n]*$", "")).otherwise(body)


def search_plan(reply: Column, query: Column) -> Column:
    """The search queries that a model's plan lists; the query itself where the reply isn't a JSON object, none where it lists none."""
    v = F.try_parse_json(F.nullif(unfenced(reply), F.lit("")))
    return F.when(v.isNull(), F.array(query)).otherwise(F.coalesce(F.try_variant_get(v, "$.search_queries", "array<string>"), F.expr("array()").cast("array<string>")))


def judgement(reply: Column) -> Column:
    """Struct (sufficient, relevance, next_query) of a model's judgement; sufficient at 0.5 where the reply isn't a JSON object."""
    v = F.try_parse_json(F.nullif(unfenced(reply), F.lit("")))
    field = lambda name, kind: F.try_variant_get(v, f"$.{name}", kind)
    return F.struct(
        F.when(v.isNull(), True).otherwise(F.coalesce(field("sufficient", "boolean"), F.lit(False))).alias("sufficient"),
        F.when(v.isNull(), 0.5).otherwise(F.coalesce(field("relevance_score", "double"), F.lit(0.0))).alias("relevance"), field("next_query", "string").alias("next_query"),
    )


def normal_metadata(raw: Column) -> Column:
    """Struct (document_type, jurisdiction, date, parties, practice_area, key_provisions) of a metadata VARIANT, in one form.

    Types and areas are lower case with underscores, jurisdictions have short names, a date must begin in ISO form and keeps ten
    characters, lists keep ten items, and a single text stands for a list of one. What is missing or empty is NULL.
    """
    field = lambda name: F.nullif(F.try_variant_get(raw, f"$.{name}", "string"), F.lit(""))

    def listed(name: str) -> Column:
        many = F.try_variant_get(raw, f"$.{name}", "array<string>")
        return F.slice(F.coalesce(many, F.when(field(name).isNotNull(), F.array(field(name)))), 1, 10)

    date = field("date")
    return F.struct(
        normal_label(field("document_type")).alias("document_type"), normal_jurisdiction(field("jurisdiction")).alias("jurisdiction"),
        F.when(date.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.substring(date, 1, 10)).alias("date"), listed("parties").alias("parties"),
        normal_label(field("practice_area")).alias("practice_area"), listed("key_provisions").alias("key_provisions"),
    )


def enabled_fields(fields: dict[str, Column], enabled: dict[str, bool]) -> Column:
    """A map of those of ``fields`` that are enabled and were found."""
    held = [(k, v) for k, v in fields.items() if enabled.get(k)]
    every = F.map_from_arrays(F.array(*(F.lit(k) for k, _ in held)).cast("array<string>"), F.array(*(v.cast("string") for _, v in held)).cast("array<string>"))
    return F.map_filter(every, lambda _, v: v.isNotNull())


def reporter_name(short: Column) -> Column:
    """The name of a reporter by its abbreviation, white space aside; NULL for an unknown one."""
    table = F.create_map(*(F.lit(x) for kv in REPORTERS.items() for x in kv))
    return F.try_element_at(table, F.regexp_replace(short, r"[ \t\n\r\f]", ""))
