"""The patterns that the oracles ask with, stated on their own so that a slip in the engine's shows as a difference."""

FACTUAL = (r"^(who|what|when|where|which)\s+", r"\b(is|was|are|were)\s+(the|a|an)\b", r"^(how many|how much)\b", r"\b(name|date|year|amount|number)\s+of\b")
KEYWORD = (r"^(define|definition|meaning|what is)\b", r"\b(means?|refer(s|ring)?\s+to)\b", r'^"[^"]+"$', r"^\w+(\s+\w+){0,2}$")
COMPLEX = (
    r"\b(compare|contrast|analyze|evaluate|assess)\b", r"\b(and|or|but|however|whereas)\b.*\b(and|or|but|however|whereas)\b", r"\b(implications?|consequences?|effects?|impacts?)\b",
    r"\b(should|must|shall|may)\b.*\b(if|when|unless|provided)\b", r"\?.*\?",
)
CONCEPTUAL = (r"^(how|why|explain|describe)\b", r"\b(concept|principle|theory|doctrine)\b", r"\b(relationship|connection|distinction)\s+between\b", r"\b(generally|typically|usually|overall)\b")
LEGAL = (r"\b(article|section|paragraph|clause)\s+\d+", r"\b(regulation|directive|statute|act)\b", r"\b(case|ruling|judgment|decision)\b", r"\b(penalty|fine|sanction|liability)\b")
DECOMPOSE = (
    r"\b(and|or)\b.*\b(and|or)\b", r"\b(compare|contrast|difference|versus|vs\.?)\b", r"\b(relationship|connection|interaction)\s+between\b",
    r"\b(analyze|evaluate|assess)\b.*\b(implications?|consequences?|effects?)\b", r"\?.*\?", r"\b(first|second|third|finally|also|additionally)\b",
)

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

MONTH = "January|February|March|April|May|June|July|August|September|October|November|December"
ARTICLE_REF = r"(?i)(Article|Section|Regulation|§)[ \t\n\r\f]+([0-9]+[.0-9]*[0-9A-Za-z_]*)"
DATE = rf"(?i)([0-9]{{1,2}}[ \t\n\r\f]+(?:{MONTH})|(?:{MONTH})[ \t\n\r\f]+[0-9]{{1,2}})[, \t\n\r\f]+([0-9]{{4}})"
REPORT_CITATION = r"\([ \t\n\r\f]*([12][0-9]{3})[ \t\n\r\f]*\)[ \t\n\r\f]*([0-9]+)[ \t\n\r\f]*([A-Za-z]+)[ \t\n\r\f]*([0-9]+)"
ENTITY = r"(?i)\b(plaintiff|defendant|respondent|appellant|applicant|claimant|court|judge|justice|tribunal|council|committee|commission|parliament|legislature|government|minister|authority)\b"
CASE_CITATION = r"([0-9]+)[ \t\n\r\f]+([A-Z][A-Za-z. \t\n\r\f]+?)[ \t\n\r\f]+([0-9]+)(?:,[ \t\n\r\f]*([0-9]+))?[ \t\n\r\f]*\(([^)]+)[ \t\n\r\f]+([0-9]{4})\)"
STATUTE = r"(?i)([0-9]+)[ \t\n\r\f]+U\.S\.C\.[ \t\n\r\f]*§[ \t\n\r\f]*([0-9]+[a-z]?(?:\([a-z0-9]+\))?)"
REPORTERS = {
    "U.S.": "United States Reports", "S.Ct.": "Supreme Court Reporter", "L.Ed.": "Lawyers' Edition", "F.2d": "Federal Reporter, Second Series", "F.3d": "Federal Reporter, Third Series",
    "F.4th": "Federal Reporter, Fourth Series", "F.Supp.": "Federal Supplement", "F.Supp.2d": "Federal Supplement, Second Series", "F.Supp.3d": "Federal Supplement, Third Series",
}

STOPWORDS = ("what", "when", "where", "which", "that", "this", "from", "with")
