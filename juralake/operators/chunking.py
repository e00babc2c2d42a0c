"""Cutting documents into chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from juralake.functions.text import split_sentences, strip, token_count

#: Chunks under so many tokens are left out of an index.
LEAST_TOKENS = 25
SPACE = " \t\n\r\f"


def pack_ranges(tokens: list[int], most: int, overlap: int) -> list[tuple[int, int, bool]]:
    """(first, last, oversize) ranges of sentences packed greedily, given the tokens of each.

    A range is full when the next sentence would exceed ``most``; the next begins with the longest suffix of at most ``overlap``
    tokens. A sentence beyond ``most`` alone is a range of its own, and nothing overlaps it.
    """
    out: list[tuple[int, int, bool]] = []
    start, held = 0, 0
    for i, n in enumerate(tokens):
        if n > most:
            if i > start:
                out.append((start, i - 1, False))
            out.append((i, i, True))
            start, held = i + 1, 0
            continue
        if held + n > most and i > start:
            out.append((start, i - 1, False))
            back, keep = i, 0
            while back > start and keep + tokens[back - 1] <= overlap:
                back -= 1
                keep += tokens[back]
            start, held = back, keep
        held += n
    if start < len(tokens):
        out.append((start, len(tokens) - 1, False))
    return out


def word_ranges(sizes: list[int], most: int, overlap: int) -> list[tuple[int, int, int]]:
    """(first, last, tokens) ranges of the words of an oversize sentence, given their lengths.

    Each word counts with a space. A range is full when the next word would take the sum beyond ``most``; of a range of n words
    the last max(1, n * overlap // most) are repeated in the next one, whose sum then starts anew from the length of what it holds.
    The last range counts as one text. A word beyond ``most`` alone stays whole.
    """
    out: list[tuple[int, int, int]] = []
    until = [0]
    for n in sizes:
        until.append(until[-1] + n)

    def joined(first: int, last: int) -> int:
        return (until[last + 1] - until[first] + last - first) // 4

    start, tokens = 0, 0
    for i, n in enumerate(sizes):
        own = (n + 1) // 4
        if i > start and tokens + own > most:
            out.append((start, i - 1, tokens))
            start = i - min(i - start, max(1, (i - start) * overlap // most))
            tokens = joined(start, i)
        else:
            tokens += own
    if sizes:
        out.append((start, len(sizes) - 1, joined(start, len(sizes) - 1)))
    return out


def text_chunks(sentences: list[str], most: int, overlap: int) -> list[tuple[int, int, str, int, str]]:
    """(first, last, kind, tokens, chunk) of a text's sentences: kind is packed, or word_split for pieces of an oversize sentence.

    The tokens of a packed chunk are the sum of its sentences', but those of a text's last chunk are counted anew.
    """
    tokens = [len(s) // 4 for s in sentences]
    out: list[tuple[int, int, str, int, str]] = []
    for lo, hi, oversize in pack_ranges(tokens, most, overlap):
        if oversize:
            words = sentences[lo].split()
            out += [(lo, hi, "word_split", n, " ".join(words[a : b + 1])) for a, b, n in word_ranges([*map(len, words)], most, overlap)]
        else:
            chunk = " ".join(sentences[lo : hi + 1])
            out.append((lo, hi, "packed", len(chunk) // 4 if hi == len(sentences) - 1 else sum(tokens[lo : hi + 1]), chunk))
    return out


def packed_chunks(docs: DataFrame, key: str, text: str, most: int = 256, overlap: int = 50) -> DataFrame:
    """(key, chunk_index, first, last, kind, token_count, chunk): sentences of each whole text packed into chunks.

    first and last number the sentences, from 0; kinds and counts are those of ``text_chunks``. Tokens are estimated from length.
    NULL and empty texts have no chunks. Each row is cut on its own, without a shuffle.
    """
    kind = docs.select(key).schema[0].dataType.simpleString()
    pre = docs.select(F.col(key), split_sentences(F.col(text)).alias("s")).where(F.size("s") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, n, *c) for i, sentences in enumerate(b.column(1).to_pylist()) for n, c in enumerate(text_chunks(sentences, most, overlap))]
            c = [*zip(*rows, strict=True)] or [()] * 7
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(c[0], pa.int64())), *(pa.array(x, t) for x, t in zip(c[1:], (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.string()), strict=True))], names=["key", "chunk_index", "first", "last", "kind", "token_count", "chunk"])

    return pre.mapInArrow(run, f"key {kind}, chunk_index int, first int, last int, kind string, token_count bigint, chunk string").withColumnRenamed("key", key)


def simple_chunks(sentences: list[str], most: int = 256, overlap: int = 50) -> list[str]:
    """Chunks of sentences that were cut at '. ', each ended by a full stop again; a chunk repeats the last sentence of the one before
    it, unless ``overlap`` is 0. A sentence beyond ``most`` stays whole."""
    out: list[str] = []
    start = held = 0
    for i, s in enumerate(sentences):
        n = len(s) // 4
        if i > start and held + n > most:
            out.append(". ".join(sentences[start:i]) + ".")
            start, held = (i - 1, len(sentences[i - 1]) // 4) if overlap > 0 else (i, 0)
        held += n
    if sentences:
        out.append(". ".join(sentences[start:]) + ".")
    return out


def sentence_pair_chunks(docs: DataFrame, key: str, text: str, most: int = 256, overlap: int = 50) -> DataFrame:
    """(key, chunk_index, total_chunks, chunk): ``simple_chunks`` of every whole text; NULL and blank texts have none."""
    kind = docs.select(key).schema[0].dataType.simpleString()
    parts = F.filter(F.transform(F.split(F.translate(F.col(text), "\n", " "), r"\. "), strip), lambda s: s != "")
    pre = docs.select(F.col(key), parts.alias("s")).where(F.size("s") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [simple_chunks(s, most, overlap) for s in b.column(1).to_pylist()]
            rows = [(i, n, len(c), x) for i, c in enumerate(found) for n, x in enumerate(c)]
            c = [*zip(*rows, strict=True)] or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(c[0], pa.int64())), pa.array(c[1], pa.int32()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.string())], names=["key", "chunk_index", "total_chunks", "chunk"])

    return pre.mapInArrow(run, f"key {kind}, chunk_index int, total_chunks int, chunk string").withColumnRenamed("key", key)


# The head of a section: a keyword and a number.
SECTION_HEAD = r"(?i)(?:Article|Section|Regulation|§|Chapter|Part|Title|Rule)[ \t\n\r\f]+[0-9]+[.0-9]*[0-9A-Za-z_]*"


def sections(docs: DataFrame, key: str, text: str, keep_preamble: bool = False) -> DataFrame:
    """(key, section_index, head, section): texts with more than one section head, cut before each; others whole, with head NULL.

    What stands before the first head is dropped unless ``keep_preamble``. NULL texts have no rows, blank sections neither.
    """
    cut = F.split(F.col(text), f"(?={SECTION_HEAD})")
    heads = F.regexp_count(F.col(text), F.lit(SECTION_HEAD))
    each = docs.where(F.col(text).isNotNull()).select(F.col(key), heads.alias("heads"), F.when(heads > 1, cut).otherwise(F.array(F.col(text))).alias("parts")).select(key, "heads", F.posexplode("parts").alias("pos", "part"))
    head = F.nullif(F.regexp_extract("part", f"^({SECTION_HEAD})", 1), F.lit(""))
    named = each.select(key, "heads", "pos", F.when(F.col("heads") > 1, head).alias("head"), strip(F.col("part")).alias("section"))
    kept = named.where((F.col("section") != "") & ((F.col("heads") <= 1) | F.col("head").isNotNull() | F.lit(keep_preamble)))
    return kept.select(key, F.col("pos").alias("section_index"), "head", "section")


# Fixed value: the numbered head of a contract's section.
CONTRACT_HEAD = regex.compile(r"^(\d+(?:\.\d+)*)\s*[.\-–]\s*(.+?)(?=\n)", regex.MULTILINE)


def contract_pieces(text: str, most: int = 1000, overlap: int = 100) -> list[tuple[str, str, str | None, str, int, int]]:
    """(content, kind, number, title, start, end) of a contract's chunks.

    Sections begin at numbered heads; what stands between is Preamble, a text without heads one section Document. A section up
    to ``most`` characters is one chunk; a longer one is packed by paragraphs, each chunk repeating the last ``overlap`` characters
    of the one before. A long paragraph stays whole.
    """
    heads = [*CONTRACT_HEAD.finditer(text)]
    spans: list[tuple[str | None, str, int, str]] = []
    if not heads:
        spans.append((None, "Document", 0, text))
    elif text[: heads[0].start()].strip():
        spans.append((None, "Preamble", 0, text[: heads[0].start()].strip()))
    for m, after in zip(heads, [*heads[1:], None], strict=False):
        spans.append((m.group(1), m.group(2).strip(), m.start(), text[m.start() : after.start() if after else len(text)].strip()))
    out: list[tuple[str, str, str | None, str, int, int]] = []
    for number, title, start, body in spans:
        if len(body) <= most:
            out.append((body, "section", number, title, start, start + len(body)))
            continue
        held, at = "", start
        for p in regex.split(r"\n\s*\n", body):
            block = p + "\n\n"
            if held and len(held) + len(block) > most:
                out.append((held.strip(), "paragraph", number, title, at, at + len(held)))
                at += len(held) - overlap
                held = held[-overlap:] if overlap > 0 else ""
            held += block
        if held.strip():
            out.append((held.strip(), "paragraph", number, title, at, at + len(held)))
    return out


def contract_chunks(docs: DataFrame, key: str, text: str, most: int = 1000, overlap: int = 100) -> DataFrame:
    """(key, chunk_index, content, kind, section_number, section_title, start_char, end_char): ``contract_pieces`` of every text.

    NULL texts have no chunks, an empty one a single empty Document.
    """
    kind = docs.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, n, *p) for i, t in enumerate(b.column(1).to_pylist()) for n, p in enumerate(contract_pieces(t, most, overlap))]
            c = [*zip(*rows, strict=True)] or [()] * 8
            s, n = pa.string(), pa.int32()
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(c[0], pa.int64())), *(pa.array(x, t) for x, t in zip(c[1:], (n, s, s, s, s, n, n), strict=True))], names=["key", "chunk_index", "content", "kind", "section_number", "section_title", "start_char", "end_char"])

    out = docs.where(F.col(text).isNotNull()).select(key, text).mapInArrow(run, f"key {kind}, chunk_index int, content string, kind string, section_number string, section_title string, start_char int, end_char int")
    return out.withColumnRenamed("key", key)


def with_section_prefix(chunk: str = "content", number: str = "section_number", title: str = "section_title"):
    """The chunk under a head [Section N - Title]; alone where it has neither."""
    joined = F.concat_ws(" - ", F.when(F.length(number) > 0, F.concat(F.lit("Section "), F.col(number))), F.nullif(F.col(title), F.lit("")))
    return F.when(joined != "", F.concat(F.lit("["), joined, F.lit("]\n\n"), F.col(chunk))).otherwise(F.col(chunk))


def structured_chunks(docs: DataFrame, key: str, text: str, most: int = 256, overlap: int = 50) -> DataFrame:
    """(key, chunk_index, type, token_count, chunk): the structure-aware chunker; chunk_index runs along each document, from 0.

    A text under LEAST_TOKENS is a short_fragment; one with several section heads gives a legal_section each, what stands before
    the first is dropped; else blank lines part paragraphs; else it is a text_block. What exceeds ``most`` tokens is packed sentence
    by sentence and keeps its type, but pieces of an oversize sentence are word_split. NULL and blank texts have no chunks.
    """
    held = docs.where(F.length(strip(F.col(text))) > 0).select(key, F.col(text).alias("t"))
    short = token_count(F.col("t")) < LEAST_TOKENS
    heads = F.regexp_count(F.col("t"), F.lit(SECTION_HEAD)) > 1
    gap = r"\n[ \t\n\r\f]*\n"
    blank = F.col("t").rlike(gap)
    kind = F.when(short, "short_fragment").when(heads, "legal_section").when(blank, "paragraph").otherwise("text_block")
    cut = F.when(short, F.array("t")).when(heads, F.split("t", f"(?={SECTION_HEAD})")).when(blank, F.split("t", gap)).otherwise(F.array("t"))
    parts = held.select(key, kind.alias("type"), F.posexplode(cut).alias("part", "piece"))
    parts = parts.withColumn("piece", F.when(F.col("type").isin("legal_section", "paragraph"), strip(F.col("piece"))).otherwise(F.col("piece"))).where("piece <> ''")
    parts = parts.where((F.col("type") != "legal_section") | F.col("piece").rlike(f"^{SECTION_HEAD}"))
    n = token_count(F.col("piece"))
    fits = parts.where(n <= most).select(key, "part", F.lit(0).alias("n"), "type", n.alias("token_count"), F.col("piece").alias("chunk"))
    long = parts.where(n > most).select(F.struct(key, "part", "type").alias("k"), "piece")
    ident = long.select(F.to_json("k").alias("j"), "piece")
    packed = packed_chunks(ident, "j", "piece", most, overlap).select(F.from_json("j", long.schema["k"].dataType).alias("k"), "chunk_index", "kind", "token_count", "chunk")
    split = packed.select(f"k.{key}", "k.part", F.col("chunk_index").alias("n"), F.when(F.col("kind") == "word_split", "word_split").otherwise(F.col("k.type")).alias("type"), "token_count", "chunk")
    along = W.partitionBy(key).orderBy("part", "n")
    return fits.unionByName(split).withColumn("chunk_index", F.row_number().over(along) - 1).select(key, "chunk_index", "type", "token_count", "chunk")
