"""Scalar text functions as column expressions: whole-stage code, no Python."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abbreviations that end no sentence.
ABBREVIATIONS = """
art arts sec secs sect par para paras ch chs chap chaps pt pts div divs cl cls subpar subpars subsec subsecs
corp inc ltd llc llp plc co cos assn assoc bros dept est
ct cts cir dist app supp rev aff j jj cj aj pj sjj v vs no nos et al seq
reg regs stat stats pub priv fed nat int intl
cert decl def defs ex exs exh mot op ops pet pl pls resp stip
mr mrs ms dr prof hon esq jr sr ii iii iv jan feb mar apr jun jul aug sep sept oct nov dec
eu ec ecj cjeu wto un echr eur tfeu teu gdpr sfdr
c civ com crim soc ass plén cass req bull jcp gaz pal
bgb hgb stgb zpo gg bgbl bgh bverfg olg lg ag
amend appx auth bankr bk bl const cong ctr ed eds eg esp etc fig figs ibid ie infra inst misc orig
passim perm prac prob proc prop pty qtd ser sess spec supr tit trans univ viz vol vols
""".split()
#: What stands for the full stop of an abbreviation while sentences are split.
ABBREV_DOT = "<ABBREV_DOT>"
# Words that are no keywords.
KEYWORD_STOPWORDS = ("what", "when", "where", "which", "that", "this", "with", "from")
#: A word: letters, marks, digits and underscores of any script.
WORD = r"[\p{L}\p{M}\p{N}_]+"
SPACE = r"[ \t\n\r\f]"
#: What storage can't hold: controls but tab and line ends, replacement characters, byte order marks, private use, surrogates.
UNSTORABLE = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x{FFFD}\\x{FEFF}\\x{FFFE}\\x{E000}-\\x{F8FF}\\x{D800}-\\x{DFFF}]"


def strip(c: Column) -> Column:
    """``c`` without ASCII white space at both ends; NULL stays NULL."""
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def lowered(c: Column) -> Column:
    """``c`` in lower case, with one form of the Greek sigma, so that a word is the same wherever it stands."""
    return F.translate(F.lower(c), "ς", "σ")


def token_count(c: Column) -> Column:
    """The estimate of tokens that needs no vocabulary: a quarter of the length, rounded down; 0 for NULL."""
    return F.floor(F.coalesce(F.length(c), F.lit(0)) / 4).cast("bigint")


def protect_abbreviations(c: Column) -> Column:
    """``c`` with ``<ABBREV_DOT>`` for the full stop after every known abbreviation, longest first, whatever its case."""
    words = sorted(set(ABBREVIATIONS), key=lambda w: (-len(w), w))
    soon = rf"(?=\p{{L}}{{1,{len(words[0])}}}\.)"  # a short word and its full stop, else no abbreviation need be tried
    return F.regexp_replace(c, rf"(?iu)(?<![\p{{L}}\p{{M}}\p{{N}}_]){soon}({'|'.join(words)})\.", f"$1{ABBREV_DOT}")


def restore_abbreviations(c: Column) -> Column:
    return F.replace(c, F.lit(ABBREV_DOT), F.lit("."))


def split_sentences(c: Column, protect: bool = True) -> Column:
    """The sentences of ``c``: cut at white space after a final mark and before a capital A-Z; trimmed, empty ones dropped.

    With ``protect``, abbreviations end none. NULL gives NULL, an empty text an empty array.
    """
    text = protect_abbreviations(c) if protect else c
    parts = F.split(text, rf"(?<=[.!?]){SPACE}+(?=[A-Z])")
    done = F.transform(parts, lambda s: strip(restore_abbreviations(s) if protect else s))
    return F.filter(done, lambda s: s != "")


def words(c: Column) -> Column:
    """All words of ``c`` in order, as searches compare them: abbreviations give the word without its full stop."""
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(0))


def legal_words(c: Column) -> Column:
    """All words of ``c`` in order; known abbreviations keep their full stop."""
    held = F.regexp_extract_all(protect_abbreviations(c), F.lit(f"{WORD}(?:<ABBREV_DOT>)?"), F.lit(0))
    return F.transform(held, restore_abbreviations)


def normalize_legal_text(c: Column) -> Column:
    """``c`` with white space collapsed and the heads section, article, paragraph and clause in title case; trimmed."""
    out = F.regexp_replace(c, rf"{SPACE}+", " ")
    for head in ("Section", "Article", "Paragraph", "Clause"):
        out = F.regexp_replace(out, rf"(?i)(?<![\p{{L}}\p{{M}}\p{{N}}_]){head} ", f"{head} ")
    return F.trim(out)


def sanitize(c: Column) -> Column:
    """``c`` without characters that storage can't hold; '' for NULL."""
    return F.coalesce(F.regexp_replace(c, UNSTORABLE, ""), F.lit(""))


def keywords(c: Column, limit: int = 3) -> Column:
    """The first ``limit`` words of more than three characters, in lower case, without stopwords; repeats stay."""
    kept = F.filter(words(lowered(c)), lambda w: (F.length(w) > 3) & ~w.isin(*KEYWORD_STOPWORDS))
    return F.slice(kept, 1, limit)


def colbert_sentences(c: Column, least: int = 20, most: int = 8) -> Column:
    """Sentences to embed: at least ``least`` characters, three tenths of them letters; of more than ``most``, the first and even steps.

    Cut after a final mark before a capital, before list numbers, after a colon before a capital and at blank lines.
    """
    cut = rf"(?<=[.!?]){SPACE}+(?=[A-Z])|(?<=\.){SPACE}*(?=[0-9]+\.)|(?<=:){SPACE}*(?=[A-Z])|\n\n+"
    parts = F.transform(F.split(c, cut), strip)
    letters = lambda s: F.length(F.regexp_replace(s, r"[^\p{L}]", ""))
    held = F.filter(parts, lambda s: (F.length(s) >= least) & (letters(s) / F.length(s) >= 0.3))

    def thin(a: Column) -> Column:
        n = F.size(a)
        step = F.greatest(F.lit(1), F.floor((n - 2) / (most - 2)).cast("int"))
        middle = F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1)), step)
        at = F.array_distinct(F.array_sort(F.concat(F.array(F.lit(0)), middle, F.array(n - 1))))
        return F.when(n > most, F.transform(F.slice(at, 1, most), lambda i: F.get(a, i))).otherwise(a)

    return F.transform(F.array(held), thin)[0]  # bound once, else the split is repeated in every reference


def preview(c: Column, size: int = 500) -> Column:
    """The first ``size`` characters, with dots where something is cut."""
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size), F.lit("..."))).otherwise(c)


def enhance_with_summary(text: Column, summary: Column) -> Column:
    """``text`` under its summary in a context head; ``text`` alone where there is no summary."""
    return F.when(F.length(summary) > 0, F.concat(F.lit("[CONTEXT: "), summary, F.lit("]\n\n"), text)).otherwise(text)


def fill_template(template: Column, values: Mapping[str, Column | Mapping]) -> Column:
    """``template`` with each {{key}}, or {{key.inner}}, replaced by its value, in one pass.

    ``values`` may hold mappings of values. NULL gives '', and so does a last key that its mapping lacks; a placeholder that asks
    for something within what isn't a mapping, or is missing itself, stays as it is. White space around keys doesn't count.
    """
    leaves: dict[str, Column] = {}
    inner = [""]

    def walk(prefix: str, part: Mapping) -> None:
        for k, v in part.items():
            if isinstance(v, Mapping):
                inner.append(f"{prefix}{k}")
                walk(f"{prefix}{k}.", v)
            else:
                leaves[f"{prefix}{k}"] = v

    walk("", values)

    def filled(part: Column) -> Column:
        key = F.trim(F.regexp_extract(part, r"^\{\{(.+?)\}\}$", 1))
        out = F.when(key == "", part)
        for name, value in leaves.items():
            out = out.when(key == name, F.coalesce(value.cast("string"), F.lit("")))
        holder = F.regexp_replace(key, r"\.?[^.]*$", "")
        return out.when(holder.isin(*inner), F.lit("")).otherwise(part)

    return F.array_join(F.transform(F.split(template, r"(?=\{\{.+?\}\})|(?<=\}\})"), filled), "")
