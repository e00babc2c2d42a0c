"""Raw documents as ordered text elements, and catalogue cards.

A parser turns a file's bytes into its elements; HTML and plain text are read here, other formats by a parser that is passed in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: HTML tags that part elements, and those whose text isn't any.
BLOCKS = frozenset("address article aside blockquote br caption dd div dl dt fieldset figcaption footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th title tr ul".split())
HIDDEN = frozenset(("script", "style", "template"))


class _Elements(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.held: list[str] = []
        self.hidden = 0

    def cut(self) -> None:
        self.out.append("".join(self.held))
        self.held = []

    def handle_starttag(self, tag: str, attrs) -> None:
        self.hidden += tag in HIDDEN
        if tag in BLOCKS:
            self.cut()

    def handle_endtag(self, tag: str) -> None:
        self.hidden = max(0, self.hidden - (tag in HIDDEN))
        if tag in BLOCKS:
            self.cut()

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.held.append(data)


def html_elements(raw: bytes) -> list[str]:
    """The texts of an HTML document's blocks, in order."""
    parser = _Elements()
    parser.feed(raw.decode("utf-8", "replace"))
    parser.close()
    parser.cut()
    return parser.out


def plain_elements(raw: bytes) -> list[str]:
    """The paragraphs of a UTF-8 text."""
    return raw.decode("utf-8").replace("\r\n", "\n").split("\n\n")


#: Parsers by the extension of a file's name.
PARSERS: dict[str, Callable[[bytes], list[str]]] = {"html": html_elements, "htm": html_elements, "txt": plain_elements, "md": plain_elements}


def elements(spark: SparkSession, folder: str, pattern: str = "*", parsers: dict[str, Callable[[bytes], list[str]]] | None = None) -> DataFrame:
    """(source, pos, text, error): the elements of every file of a folder, white space collapsed, empty ones left out.

    A file that its parser can't read, or that none reads, keeps one row with ``error`` and neither place nor text. ``parsers`` adds
    to PARSERS or replaces some; each worker reads whole files, one at a time.
    """
    known = PARSERS | (parsers or {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for source, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                parse = known.get(source.rsplit(".", 1)[-1].lower())
                try:
                    if parse is None:
                        raise ValueError("no parser for this kind of file")
                    texts = [t for t in (" ".join(x.split()) for x in parse(raw)) if t]
                except Exception as e:  # noqa: BLE001 - whatever a parser raises is told of its file, and the others go on
                    rows.append((source, None, None, str(e) or type(e).__name__))
                else:
                    rows += [(source, i, t, None) for i, t in enumerate(texts)]
            c = [*zip(*rows, strict=True)] or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.string()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.string()), pa.array(c[3], pa.string())], names=["source", "pos", "text", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("source"), "content").mapInArrow(run, "source string, pos int, text string, error string")


def merged_metadata(own: Column, base: Column) -> Column:
    """Two maps of strings as one; where both have a key, ``base`` stands. NULL counts as empty."""
    empty = F.expr("map()").cast("map<string,string>")
    a, b = F.coalesce(own, empty), F.coalesce(base, empty)
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def cards(spark: SparkSession, folder: str, pattern: str = "*.yaml") -> DataFrame:
    """(source, name, card VARIANT, error): catalogue cards in YAML, one a file; needs the yaml library where they are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        import yaml

        for b in batches:
            rows: list[tuple] = []
            for source, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    card = yaml.safe_load(raw)
                    rows.append((source, card.get("name") if isinstance(card, dict) else None, json.dumps(card, default=str), None))
                except yaml.YAMLError as e:
                    rows.append((source, None, None, str(e).splitlines()[0]))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*rows, strict=True)] if rows else [pa.array([], pa.string())] * 4, names=["source", "name", "json", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    read = files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("source"), "content").mapInArrow(run, "source string, name string, json string, error string")
    return read.select("source", "name", F.try_parse_json("json").alias("card"), "error")
