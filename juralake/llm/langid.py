"""Languages of documents and of the stretches of mixed ones.

A sentence is compressed by zstandard once per language that is written in its script, each time with that language's text
as a raw-content dictionary, and once with a background dictionary, of the languages of other scripts. The language whose
dictionary makes it smallest wins, unless the margin to the next one, or to the background, is narrow: then the sentence is
uncertain, and a text without a certain sentence is rejected unless all of it is certain. The dictionaries are made here,
from labelled documents; as labels may be wrong and texts mixed, a document enters only if dictionaries of a few annotated
sentences, and then those of the rounds before, find it in its label's language alone.
"""

from __future__ import annotations

import functools
import random
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from juralake.functions.labels import resolve
from juralake.llm import sentence_seed
from juralake.llm.sentences import Field, trained, units_of
from juralake.session import materialise
from juralake.sources.tables import rows_of_sample, spread

#: Labelled documents of each language that dictionaries are made from, at most, and bytes of a dictionary.
FIT_DOCS = 160
DICT_BYTES = 56_000
LEVEL = 3
#: Characters under which what has no final mark counts as a heading: it isn't a sentence, and headings look alike in
#: kindred languages. Thai has no final marks.
HEADING = 40
#: A sentence's own language is certain if the next best is larger by so many bytes and by so large a part of the smallest.
MARGIN_BYTES = 4
MARGIN_SHARE = 0.07
#: It must also be smaller, by this part, than with the background dictionary, or with the least fitting one of its script. Nearly all
#: sentences in languages that there is a dictionary of save more, but for headings; those tried in Ukrainian, Persian and Polish less.
LEAST_GAIN = 0.12
#: The margins for a whole text, where none of its sentences is certain on its own.
WHOLE_BYTES = 2
WHOLE_SHARE = 0.03
#: The language of what is rejected.
REJECTED = "und"
#: Bytes of the background dictionary from each language.
BACKGROUND_BYTES = 8000
#: The scripts that languages are written in. A sentence is tried in the languages of its main script.
SCRIPTS = {"Latin": ("de", "en", "es", "fr", "pt"), "Cyrillic": ("ru",), "Greek": ("el",), "Arabic": ("ar",), "Devanagari": ("hi",), "Thai": ("th",), "Kana": ("ja",), "Han": ("ja", "zh")}
#: Letters that a sentence needs; what is shorter, such as a number or a name, tells no language on its own.
LEAST_LETTERS = dict.fromkeys(SCRIPTS, 10) | {"Latin": 12, "Kana": 6, "Han": 6}
LANGUAGES = tuple(sorted({x for v in SCRIPTS.values() for x in v}))

TAG = regex.compile(r"<[^<>]{0,200}>|&\w{2,8};")
NUMBERS = b"0123456789+/|\\#*=~^_%<>$-"
ENDS = re.compile("[.!?…。！？।؟]+[\"”»’」』）)]*[ \u00a0\u202f]?[»]?|\n\\s*\n")
FINAL = re.compile("[.!?…。！？।؟;]+[\"”»’」』）)]*\\s*$")
LETTERS = regex.compile(r"\p{L}+")
RUNS = {s: regex.compile(r"[\p{Hiragana}\p{Katakana}]+" if s == "Kana" else rf"\p{{{s}}}+") for s in SCRIPTS}


def plain(text: str) -> str:
    """Compatibility forms unified, lower case, without markup."""
    text = TAG.sub(" ", text) if "<" in text or "&" in text else text
    if not text.isascii() and not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    return text.lower()


def compressible(bare: str) -> bytes:
    """The bytes of a plain text without ASCII numbers and symbols, white space collapsed."""
    return b" ".join(bare.encode("utf-8", "replace").translate(None, NUMBERS).split())


def rough_sentences(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of sentences, roughly: what is cut off at an abbreviation is too short to tell a language.

    Ends are wide marks, blank lines, and other marks before white space, unless a short word stands before a full stop or
    a small letter follows.
    """
    at, n = 0, len(text)
    for m in ENDS.finditer(text):
        s, e = m.span()
        c = text[s]
        if c in ".…" and e < n:
            if not (text[e].isspace() or text[e - 1].isspace()) or not text[max(0, s - 3) : s].strip("%)»”").isalnum():
                continue
            follow = text[e : e + 24].lstrip()[:1]
            if follow.islower() or (c == "." and s - at < 5):
                continue
        if e > at:
            yield at, e
        at = e
    if at < n:
        yield at, n


@functools.cache
def _scripts() -> np.ndarray:
    """The number of each code point's script in SCRIPTS, from 1; for letters of other scripts one more than there are, 0 for no letter."""
    every = "".join(map(chr, range(0x110000)))
    out = np.zeros(0x110000, np.uint8)
    for m in LETTERS.finditer(every):
        out[m.start() : m.end()] = len(SCRIPTS) + 1
    for i, r in enumerate(RUNS.values(), 1):
        for m in r.finditer(every):
            out[m.start() : m.end()] = i
    return out


def main_scripts(parts: list[str]) -> list[tuple[str, int]]:
    """The script of most letters of each of ``parts`` ("" without any, or where most are of no script that is known), and how many letters it has.

    Han with a tenth of kana, or more, is Kana.
    """
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    cp = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(SCRIPTS) + 2
    count = np.bincount(np.repeat(np.arange(len(parts)) * n, size) + _scripts()[cp], minlength=n * len(parts)).reshape(-1, n)[:, 1:]
    letters = count.sum(axis=1)
    names = [*SCRIPTS, ""]
    kana, han = names.index("Kana"), names.index("Han")
    both = (count[:, kana] > 0) & (count[:, kana] * 10 >= count[:, kana] + count[:, han])
    count[:, kana] += np.where(both, count[:, han], 0)
    best = count.argmax(axis=1)
    return [(names[i] if k else "", k) for i, k in zip(best.tolist(), letters.tolist(), strict=True)]


class Dictionaries:
    """A compressor per language, and per script one of the languages that aren't written in it."""

    def __init__(self, content: dict[str, bytes]) -> None:
        self.content = content
        self.of = {lang: self._compressor(raw) for lang, raw in content.items()}
        self.background = {s: self._compressor(b"\n".join(raw[:BACKGROUND_BYTES] for lang, raw in sorted(content.items()) if lang not in own)) for s, own in SCRIPTS.items()}

    @staticmethod
    def _compressor(raw: bytes) -> zstandard.ZstdCompressor:
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)

    def sizes(self, raw: bytes, langs: tuple[str, ...]) -> dict[str, int]:
        """The compressed size of ``raw`` with each language's dictionary."""
        return {k: len(self.of[k].compress(raw)) for k in langs}


    def background_size(self, raw: bytes, script: str, sizes: dict[str, int]) -> int:
        """The size that knowing no language of the script gives: where it has several, that of the least fitting one is as good."""
        return max(sizes.values()) if len(sizes) > 1 else len(self.background[script].compress(raw))


def tells(bare: str, size: int, script: str) -> bool:
    """Whether a plain text of ``size`` characters is a sentence rather than a heading; Thai has no final marks."""
    return size >= HEADING or script == "Thai" or FINAL.search(bare) is not None


#: A sentence: start, end, sizes by language, size with the background dictionary.
Sentence = tuple[int, int, dict[str, int], int]


def sentences(text: str, dicts: Dictionaries, cut: Iterable[tuple[int, int]]) -> list[Sentence]:
    """Those sentences (of ``cut``) that have letters enough, with their compressed sizes in the languages of their script."""
    out = []
    cut = list(cut)
    for (start, end), (script, letters) in zip(cut, main_scripts([text[a:b] for a, b in cut]), strict=True):
        if script and letters >= LEAST_LETTERS[script]:
            bare = plain(text[start:end])
            if tells(bare, end - start, script):
                raw = compressible(bare)
                sizes = dicts.sizes(raw, SCRIPTS[script])
                out.append((start, end, sizes, dicts.background_size(raw, script, sizes)))
    return out


def certain(sizes: dict[str, int], background: int, least_bytes: int = MARGIN_BYTES, least_share: float = MARGIN_SHARE) -> tuple[str, float]:
    """The language of a sentence and its confidence, from 0 to 1; no language ("") where a margin is narrow.

    The confidence is the smaller margin, to the next language or to the background, in parts of four times what is asked.
    """
    ranked = sorted(sizes.values())
    a = ranked[0]
    best = next(k for k, n in sizes.items() if n == a)  # of equals the first by name, but then the margin is narrow anyway
    gain = 1 - a / max(background, 1)
    sure = gain >= LEAST_GAIN
    confidence = gain / (4 * LEAST_GAIN)
    if len(ranked) > 1:
        b = ranked[1]
        margin = (b - a) / max(a, 1)
        sure = sure and b - a >= least_bytes and margin >= least_share
        confidence = min(confidence, margin / (4 * MARGIN_SHARE))
    return (best if sure else ""), min(1.0, max(0.0, confidence))


def certain_all(parts: list[bytes], scripts: list[str], dicts: Dictionaries) -> tuple[list[str], list[float]]:
    """``certain`` for many sentences, by their bytes and scripts: languages ("" where a margin is narrow) and confidences.

    All are compressed with one dictionary before the next one is taken, so that it stays in the processor's cache.
    """
    lang, sure = [""] * len(parts), [0.0] * len(parts)
    of: dict[str, list[int]] = defaultdict(list)
    for i, s in enumerate(scripts):
        of[s].append(i)
    for script, own in of.items():
        raws = [parts[i] for i in own]
        size = np.array([[len(x) for x in map(dicts.of[k].compress, raws)] for k in SCRIPTS[script]])
        ranked = np.sort(size, axis=0)
        a = ranked[0]
        several = len(size) > 1
        background = ranked[-1] if several else np.array([len(x) for x in map(dicts.background[script].compress, raws)])
        gain = 1 - a / np.maximum(background, 1)
        good, confidence = gain >= LEAST_GAIN, gain / (4 * LEAST_GAIN)
        if several:
            margin = (ranked[1] - a) / np.maximum(a, 1)
            good &= (ranked[1] - a >= MARGIN_BYTES) & (margin >= MARGIN_SHARE)
            confidence = np.minimum(confidence, margin / (4 * MARGIN_SHARE))
        for i, k, g, c in zip(own, size.argmin(axis=0).tolist(), good.tolist(), np.clip(confidence, 0, 1).tolist(), strict=True):
            lang[i], sure[i] = SCRIPTS[script][k] if g else "", c
    return lang, sure


def stretches(text: str, dicts: Dictionaries, said: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str, float]]:
    """(start, end, lang, confidence) of the stretches in one language of ``text``, given its sentences' (start, end, lang, confidence).

    Sentences with narrow margins go with the certain one before them (the first ones with the one after), and lower the
    confidence. A text without a certain sentence is one stretch, in the language that the whole of it is certain in, or
    REJECTED. A text without words has none.
    """
    lead = next((x[2] for x in said if x[2]), "")
    if not lead:
        script, letters = main_scripts([text])[0]
        if not letters:
            return []
        if not script:
            return [(0, len(text), REJECTED, 0.0)]
        raw = compressible(plain(text))
        sizes = dicts.sizes(raw, SCRIPTS[script])
        best, sure = certain(sizes, dicts.background_size(raw, script, sizes), WHOLE_BYTES, WHOLE_SHARE)
        return [(0, len(text), best or REJECTED, sure)]
    out: list[list] = []
    for s, e, lang, sure in said:
        lang = lang or (out[-1][2] if out else lead)
        if out and out[-1][2] == lang:
            out[-1][1] = e
            out[-1][3].append(sure)
        else:
            out.append([s, e, lang, [sure]])
    return [(s, e, lang, sum(c) / len(c)) for s, e, lang, c in out]


def every_stretch(texts: list[str], dicts: Dictionaries, model: Field) -> list[list[tuple[int, int, str, float]]]:
    """The stretches of each of ``texts``, which the sentence model cuts all at once."""
    row, start, end = units_of(texts, model)
    cuts = list(zip(row.tolist(), start.tolist(), end.tolist(), strict=True))
    held, parts, scripts = [], [], []
    for (i, a, b), (script, letters) in zip(cuts, main_scripts([texts[i][a:b] for i, a, b in cuts]), strict=True):
        if script and letters >= LEAST_LETTERS[script]:
            bare = plain(texts[i][a:b])
            if tells(bare, b - a, script):
                held.append((i, a, b))
                parts.append(compressible(bare))
                scripts.append(script)
    said: list[list[tuple[int, int, str, float]]] = [[] for _ in texts]
    for (i, a, b), lang, sure in zip(held, *certain_all(parts, scripts, dicts), strict=True):
        said[i].append((a, b, lang, sure))
    return [stretches(t, dicts, x) for t, x in zip(texts, said, strict=True)]


@functools.cache
def _seed_dictionaries() -> Dictionaries:
    fill = regex.compile(r"\{\w\}")
    return Dictionaries({k: compressible(plain(fill.sub("", v.replace("|", " ")) + sentence_seed.FREQUENT.get(k, ""))) for k, v in sentence_seed.SEED.items()})


def make(labelled: list[tuple[str, str]], dict_bytes: int = DICT_BYTES) -> Dictionaries:
    """Dictionaries from (language, text) of labelled documents, of which some labels may be wrong.

    The sentences of a document enter if most of it is in its language and none of them is certain in another, judged by
    dictionaries that it isn't in itself: first those of the annotated sentences, then those of the other half of the documents.
    """
    labelled = sorted(x for x in labelled if x[0] in LANGUAGES)
    cuts = [list(rough_sentences(text)) for _, text in labelled]
    halves = [_seed_dictionaries()] * 2
    for last in (False, False, False, True):
        kept: list[dict[str, list[bytes]]] = [defaultdict(list), defaultdict(list)]
        for i, ((lang, text), cut) in enumerate(zip(labelled, cuts, strict=True)):
            found = sentences(text, halves[(i + 1) % 2], cut)
            total: Counter = Counter()
            for _, _, z, _ in found:
                total.update({k: max(z.values()) - n + 1 for k, n in z.items()})
            if found and max(total, key=lambda k: (total[k], k)) == lang and all(certain(z, g)[0] in ("", lang) for _, _, z, g in found):
                kept[i % 2][lang] += [compressible(plain(text[s:e])) for s, e in cut]
        if last:
            return Dictionaries(_content(kept, dict_bytes))
        halves = [Dictionaries(_content(kept[k : k + 1], dict_bytes)) for k in (0, 1)]
    raise AssertionError


def _content(kept: list[dict[str, list[bytes]]], dict_bytes: int) -> dict[str, bytes]:
    """Each language's dictionary: the annotated sentences, then as many of its own, in random order, as there is room for."""
    content = {}
    for lang in LANGUAGES:
        own = sorted({x for part in kept for x in part[lang] if x})
        random.Random(3).shuffle(own)
        take = [_seed_dictionaries().content[lang]]
        size = len(take[0])
        for x in own:
            if size > dict_bytes:
                break
            take.append(x)
            size += len(x) + 1
        content[lang] = b"\n".join(take)
    return content


def fit(documents: DataFrame, aliases: DataFrame, fit_docs: int = FIT_DOCS) -> Dictionaries:
    """Dictionaries from at most ``fit_docs`` labelled documents of each language, those with the smallest hashes of doc_id.

    They are chosen by id and label alone; only then are their texts read.
    """
    labelled = resolve(documents.select("doc_id", "lang"), aliases, "lang", "lang", "label").where(F.col("label").isin(*LANGUAGES))
    w = W.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = labelled.select("doc_id", "label", F.row_number().over(w).alias("n")).where(F.col("n") <= fit_docs)
    held = rows_of_sample(documents, materialise(chosen.select("doc_id", "label"), "chosen"), "doc_id", "text")
    rows = held.where("text IS NOT NULL").select("label", "text").collect()  # fit_docs rows a language at most
    return make([(r["label"], r["text"]) for r in rows])


def language_stretches(documents: DataFrame, dicts: Dictionaries) -> DataFrame:
    """(doc_id, raw, stretches): one row per document; ``raw`` is its label as given, ``stretches`` an array of (start, end, lang, confidence).

    The whole text is read. NULL, empty and wordless texts have an empty array. Documents are independent: no shuffle but that
    of ``spread``, which ``documents``, a plain read, needs where it has few partitions.
    """
    content, model = dicts.content, trained()
    kind = "array<struct<start:bigint,end:bigint,lang:string,confidence:double>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = Dictionaries(content)
        t = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string()), ("confidence", pa.float64())]))
        for b in batches:
            one = pc.dictionary_encode(pc.fill_null(b.column(2), ""))  # a text filed several times is read once a batch
            found = [[dict(zip(("start", "end", "lang", "confidence"), x, strict=True)) for x in own] for own in every_stretch(one.dictionary.to_pylist(), d, model)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, t).take(one.indices)], names=["doc_id", "raw", "stretches"])

    return spread(documents).select("doc_id", F.col("lang").alias("raw"), "text").mapInArrow(run, f"doc_id bigint, raw string, stretches {kind}")


def language_segments(documents: DataFrame, aliases: DataFrame) -> DataFrame:
    """(doc_id, start, end, lang, confidence): every stretch in one language of every document with words; REJECTED ones too."""
    found = language_stretches(documents, fit(documents, aliases))
    return found.select("doc_id", F.inline("stretches"))


def mislabelled(documents: DataFrame, aliases: DataFrame) -> DataFrame:
    """(doc_id, lang): a row per language of each document whose label is missing or wrong, or whose text mixes languages.

    A text's languages are those of its stretches; of a REJECTED text nothing is said. A label is missing if NULL or not
    resolved, right if it resolves to the text's only language.
    """
    langs = F.array_except(F.array_distinct(F.transform("stretches", lambda x: x["lang"])), F.array(F.lit(REJECTED)))
    found = language_stretches(documents, fit(documents, aliases)).withColumn("langs", langs)
    labelled = resolve(found.where(F.size("langs") > 0), aliases, "lang", "raw", "label")
    case = (F.size("langs") > 1) | (F.col("label") != F.col("langs")[0])
    return labelled.where(case).select("doc_id", F.explode("langs").alias("lang"))
