"""Splitting oversized texts at natural boundaries.

A text, in a file or in a cell, is worked on as ranges of bytes. Each worker reads its range alone, and the three bytes of halo
that may end its last character. It counts code points and lists the cuts that the range offers; what a cut means may hang on
any length of white space or brackets before it, so ranges hand on a state: the last character that counts, the line ends
since, and the like. States and lengths are stitched along the ranges, which gives each cut its level and its place. Pieces are
chosen from the table of cuts, in segments that begin at cuts, and their text is taken from the ranges by offset. No task needs
a whole giant text, and the pieces don't depend on where ranges lie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from juralake.session import materialise
from juralake.sources.tables import first_deliveries

#: Bytes in a range, and beyond it that may belong to its last character.
RANGE_BYTES = 1 << 20
HALO_BYTES = 3
#: Code points of a segment, in which pieces are chosen on their own. It begins at a natural cut; where there is none, it goes on.
SEGMENT = 1 << 19
#: Code points of a piece at most, and shared by consecutive pieces.
LIMIT = 2000
OVERLAP = 200
#: Levels of a cut: inside a word that isn't ASCII, white space, clause, sentence, line, paragraph.
EDGE, SPACE, CLAUSE, SENTENCE, LINE, PARAGRAPH = range(6)

_SPACES = np.array([9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)
_FINAL = np.array([ord(c) for c in ".!?…。！？．؟।॥"], np.uint32)
_WIDE_FINAL = np.array([ord(c) for c in "。！？．।॥"], np.uint32)
_CLOSING = np.array([ord(c) for c in "\"')]}”’»」』）】›"], np.uint32)
_CLAUSE = np.array([ord(c) for c in ",;:，；：、،؛·"], np.uint32)
_LINE, _SPACE = np.array([10], np.uint32), np.array([32], np.uint32)


def _among(cp: np.ndarray, chars: np.ndarray) -> np.ndarray:
    return np.isin(cp, chars)


def token_chars(cp: np.ndarray) -> np.ndarray:
    """ASCII letters, ASCII digits and + / = _ -: between two of these there is no natural cut."""
    return ((cp >= 48) & (cp <= 57)) | ((cp >= 65) & (cp <= 90)) | ((cp >= 97) & (cp <= 122)) | (cp == 43) | (cp == 47) | (cp == 61) | (cp == 95) | (cp == 45)


def cut_levels(cp: np.ndarray) -> np.ndarray:
    """The level of a cut before each code point, -1 where none is natural; the first has -1."""
    n = len(cp)
    level = np.full(n, -1, np.int8)
    if n < 2:
        return level
    run, space = token_chars(cp), _among(cp, _SPACES)
    level[1:][~(run[1:] & run[:-1])] = EDGE
    after = np.zeros(n, bool)
    after[1:] = space[:-1] & ~space[1:]  # white space stays with what it follows
    level[after] = SPACE
    at = np.arange(n)
    word = np.maximum.accumulate(np.where(~space, at, -1))  # the last character that isn't white space
    before = np.r_[-1, word[:-1]]
    line = np.cumsum(cp == 10)
    spots = np.flatnonzero(after & (before >= 0))
    last = before[spots]
    closed = _among(cp, _CLOSING)
    bare = np.maximum.accumulate(np.where(~space & ~closed, at, -1))
    end = cp[np.maximum(bare[last], 0)]
    level[spots[_among(cp[last], _CLAUSE)]] = CLAUSE
    level[spots[_among(end, _FINAL)]] = SENTENCE
    breaks = line[spots - 1] - line[last]
    level[spots[breaks == 1]] = LINE
    level[spots[breaks > 1]] = PARAGRAPH
    wide = np.flatnonzero(_among(cp[:-1], _WIDE_FINAL) & ~closed[1:] & ~space[1:] & ~_among(cp[1:], _FINAL)) + 1
    level[wide] = np.maximum(level[wide], SENTENCE)
    return level


def offered_cuts(level: np.ndarray, cell: int) -> np.ndarray:
    """Places of the first, the last and the best (the last of the highest level) cut of every ``cell`` places.

    So both ends of every stretch without a cut longer than a cell are kept.
    """
    at = np.flatnonzero(level >= 0)
    if not len(at):
        return at
    c = at // cell
    first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
    last = np.r_[first[1:] - 1, len(at) - 1]
    best = np.lexsort((at, level[at], c))[last]
    return at[np.unique(np.r_[first, last, best])]


def tail_state(cp: np.ndarray) -> tuple[int, int, int, int]:
    """What a range hands on: its last character that is neither white space nor closing, its last that isn't white space, the line
    ends after that, and its last character; -1 where it has none."""
    space = _among(cp, _SPACES)
    solid = np.flatnonzero(~space)
    bare = np.flatnonzero(~space & ~_among(cp, _CLOSING))
    last = int(solid[-1]) if len(solid) else -1
    return int(cp[bare[-1]]) if len(bare) else -1, int(cp[last]) if last >= 0 else -1, int((cp[last + 1 :] == 10).sum()), int(cp[-1]) if len(cp) else -1


def led_levels(cp: np.ndarray, bare: int, solid: int, breaks: int, last: int) -> np.ndarray:
    """``cut_levels`` of a range, given the state of the text before it, from a few characters that make the same state."""
    lead = [np.array([c], np.uint32) for c in ([bare] if bare >= 0 and bare != solid else []) + ([solid] if solid >= 0 else [])]
    if last != solid:
        lead += [_LINE] * min(breaks, 2) if breaks else []
        lead.append(np.array([last], np.uint32) if last != 10 else _SPACE[:0])
    lead = np.concatenate(lead) if lead else np.empty(0, np.uint32)
    return cut_levels(np.concatenate([lead, cp]))[len(lead) :]


def chosen_pieces(size: int, at: np.ndarray, level: np.ndarray, limit: int, overlap: int, begin: int = 0) -> list[tuple[int, int, str]]:
    """Pieces (start, end, how the end was cut) of a text up to code point ``size``, given its offered cuts in order.

    The text before ``begin``, which is 0 or a cut, has its pieces already.

    Of the cuts in the second half of a piece the last of the highest level is taken, else the last before it. Where there is
    none since the last cut, the cut is forced at the limit. A piece begins ``overlap`` before the last cut, or less far back
    where it could otherwise not reach the next natural cut.
    """
    out: list[tuple[int, int, str]] = []

    def after(cut: int, start: int) -> int:
        nxt = np.searchsorted(at, cut, side="right")
        reach = int(at[nxt]) if nxt < len(at) else size
        start = max(cut - overlap, start + 1)
        return max(start, reach - limit) if reach - cut <= limit else start

    cut = begin
    start = after(cut, -1) if begin else 0
    while size - start > limit:
        end = start + limit
        lo, hi = np.searchsorted(at, max(cut, start), side="right"), np.searchsorted(at, end, side="right")
        if lo < hi:
            half = max(lo, min(np.searchsorted(at, start + limit // 2), hi - 1))
            pick = half + len(level[half:hi]) - 1 - int(np.argmax(level[half:hi][::-1]))
            cut, how = int(at[pick]), "natural"
        else:
            cut, how = end, "forced"
        out.append((start, cut, how))
        start = after(cut, start)
    out.append((start, size, "end"))
    return out


class Cells:
    """Texts in the cells of a table (id, content), one row per id: ranges are cut from the cell. NULL contents have none."""

    def __init__(self, texts: DataFrame) -> None:
        self.texts = texts.select("id", "content")

    def ranges(self, limit: int, range_bytes: int) -> DataFrame:
        """(id, r, body): the ranges of texts of more than ``limit`` code points, with their halos."""
        over = self.texts.where(F.length("content") > limit).select("id", F.encode("content", "UTF-8").alias("bytes"))
        each = over.withColumn("r", F.explode(F.expr(f"sequence(0, cast((octet_length(bytes) - 1) div {range_bytes} as int))")))
        return each.select("id", "r", F.expr(f"substring(bytes, r * {range_bytes} + 1, {range_bytes + HALO_BYTES})").alias("body")).repartition("id", "r")

    def bodies(self, rows: DataFrame, range_bytes: int) -> DataFrame:
        """``rows`` (id, r, ...) with the ``body`` of their range."""
        held = rows.join(self.texts, "id").withColumn("bytes", F.encode("content", "UTF-8"))
        return held.withColumn("body", F.expr(f"substring(bytes, r * {range_bytes} + 1, {range_bytes + HALO_BYTES})")).drop("bytes", "content")


class Files:
    """Texts in UTF-8 files, each named by its path: ranges are (path, offset, length), and every worker reads its own alone."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        listed = spark.read.format("binaryFile").load(path)
        self.files = listed.select(F.col("path").alias("id"), F.col("length").alias("size"))  # names and sizes; contents aren't read

    def ranges(self, limit: int, range_bytes: int) -> DataFrame:
        """(id, r, body): the ranges of files of more than ``limit`` bytes; shorter ones can't have more code points."""
        n = F.expr(f"cast((size - 1) div {range_bytes} as int)")
        each = self.files.where(F.col("size") > limit).select("id", F.explode(F.sequence(F.lit(0), n)).alias("r")).repartition("id", "r")
        return self.bodies(each, range_bytes)

    def bodies(self, rows: DataFrame, range_bytes: int) -> DataFrame:
        """``rows`` (id, r, ...) with the ``body`` of their range, read by offset."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, r = b.column(b.schema.get_field_index("id")).to_pylist(), b.column(b.schema.get_field_index("r")).to_pylist()
                for i, (path, k) in enumerate(zip(ids, r, strict=True)):  # a row at a time, so that no batch holds many ranges
                    body = pa.array([read_range(path, k * range_bytes, range_bytes + HALO_BYTES)], pa.binary())
                    yield pa.RecordBatch.from_arrays([*b.slice(i, 1).columns, body], names=[*b.schema.names, "body"])

        fields = StructType([*rows.schema.fields, StructField("body", BinaryType())])
        return rows.mapInArrow(run, fields)


def read_range(path: str, begin: int, size: int) -> bytes:
    """``size`` bytes of a file from ``begin`` on, or as many as it has; the file system goes by the path's scheme."""
    scheme, _, rest = path.partition(":")
    files, name = (pafs.LocalFileSystem(), "/" + rest.lstrip("/")) if scheme == "file" else pafs.FileSystem.from_uri(path)
    with files.open_input_file(name) as f:
        return f.read_at(min(size, max(0, f.size() - begin)), begin)


def _decoded(body: bytes, range_bytes: int) -> np.ndarray:
    """Code points of the characters that begin within a range; bytes that aren't UTF-8 stand as one replacement each."""
    raw = np.frombuffer(body, np.uint8)
    begin = int(np.argmax(np.r_[(raw & 0xC0) != 0x80, True]))
    end = len(raw)
    if end > range_bytes:  # the last character that begins within the range ends before the next one begins
        end = range_bytes + int(np.argmax(np.r_[(raw[range_bytes:] & 0xC0) != 0x80, True]))
    return np.frombuffer(bytes(raw[min(begin, end) : end]).decode("utf-8", "replace").encode("utf-32-le"), np.uint32)


def cut_table(source: Cells | Files, limit: int, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(id, r, n_chars, offset, cuts): each range's length, its place, and the places in the text of the cuts that it offers, with
    their levels.

    A first pass over all ranges gives lengths and states, and the cuts of first ranges; a second one reads the others again, now
    that the state before each is known. Both tables lie in the shared folder.
    """
    state = ("bare", "solid", "breaks", "last")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r, body in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                cp = _decoded(body, range_bytes)
                rows.append((len(cp), tail_state(cp), _levels_by_place(cut_levels(cp), 0, limit) if not r else None))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([x[0] for x in rows], pa.int64()), *(pa.array([x[1][i] for x in rows], pa.int32()) for i in range(4)), pa.array([x[2] for x in rows], _CUTS)],
                names=["id", "r", "n_chars", *state, "cuts"],
            )

    ranges = source.ranges(limit, range_bytes)
    kind = "array<struct<at:bigint,level:tinyint>>"
    table = materialise(ranges.mapInArrow(first, f"id string, r int, n_chars bigint, bare int, solid int, breaks int, last int, cuts {kind}"), "ranges")
    along = W.partitionBy("id").orderBy("r").rowsBetween(W.unboundedPreceding, -1)

    def known(c: str):
        return F.when(F.col(c) >= 0, F.col(c))

    total = F.coalesce(F.sum("breaks").over(along), F.lit(0))
    placed = table.withColumn("offset", F.coalesce(F.sum("n_chars").over(along), F.lit(0))).withColumn("total", total)
    at_solid = F.last(F.when(F.col("solid") >= 0, F.col("total")), ignorenulls=True).over(along)
    led = placed.withColumns(
        {f"led_{c}": F.coalesce(F.last(known(c), ignorenulls=True).over(along), F.lit(-1)) for c in ("bare", "solid", "last")} | {"led_breaks": (F.col("total") - F.coalesce(at_solid, F.lit(0))).cast("bigint")}
    )

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of = {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}
            cuts = []
            for i, body in enumerate(of["body"]):
                levels = led_levels(_decoded(body, range_bytes), of["led_bare"][i], of["led_solid"][i], of["led_breaks"][i], of["led_last"][i])
                cuts.append(_levels_by_place(levels, of["offset"][i], limit))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(cuts, _CUTS)], names=["id", "r", "n_chars", "offset", "cuts"])

    out = f"id string, r int, n_chars bigint, offset bigint, cuts {kind}"
    later = led.where("r > 0").select("id", "r", "n_chars", "offset", "led_bare", "led_solid", "led_breaks", "led_last")
    return led.where("r = 0").select("id", "r", "n_chars", "offset", "cuts").unionByName(source.bodies(later, range_bytes).mapInArrow(again, out))


_CUTS = pa.list_(pa.struct([("at", pa.int64()), ("level", pa.int8())]))


def _levels_by_place(levels: np.ndarray, offset: int, limit: int) -> list[dict[str, int]]:
    """The cuts that matter of a range at ``offset``, by their places in the text.

    Of every limit / 8 places of the text the first cut, the last, and the last of the highest level; a range that ends within
    such a cell gives those of its part, which the choice sees as well.
    """
    cell = max(1, limit // 8)
    lead = offset % cell
    at = offered_cuts(np.concatenate([np.full(lead, -1, np.int8), levels]), cell) - lead
    return [{"at": int(a) + offset, "level": int(levels[a])} for a in at]


def _merged(at: np.ndarray, level: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The cuts that matter of whole cells, where two ranges may each have given those of its part."""
    if not len(at):
        return at, level
    full = np.full(int(at[-1] - at[0] // max(1, limit // 8) * max(1, limit // 8)) + 1, -1, np.int8)
    base = int(at[0] // max(1, limit // 8) * max(1, limit // 8))
    full[at - base] = level
    kept = offered_cuts(full, max(1, limit // 8))
    return kept + base, full[kept]


def pieces(source: DataFrame | Cells | Files, limit: int = LIMIT, overlap: int = OVERLAP, range_bytes: int = RANGE_BYTES, segment: int = SEGMENT) -> DataFrame:
    """(id, piece, start, end, cut): the pieces of every text of more than ``limit`` code points.

    ``source`` is Files, or a table of (id, content), one row per id. start counts from 0, end is exclusive, cut says how the piece's
    end was found: natural, forced or end. Pieces have at most ``limit`` code points, cover the text, and are numbered in their
    order. NULL, empty and shorter texts have no rows. A text of more than ``segment`` code points is chosen in segments, each of
    which begins at the best natural cut of the last limit / 2 places before a multiple of ``segment``, if there is one.
    """
    return _pieces(cut_table(source if not isinstance(source, DataFrame) else Cells(source), limit, range_bytes), limit, overlap, segment)


def _pieces(table: DataFrame, limit: int, overlap: int, segment: int) -> DataFrame:
    if not 0 <= overlap < limit or segment < 4 * limit:
        raise ValueError("overlap must be at least 0 and under limit, a segment at least four times limit")
    table = materialise(table, "cuts")
    size = table.groupBy("id").agg(F.sum("n_chars").alias("size")).where(F.col("size") > limit)
    cuts = table.select("id", F.inline("cuts")).withColumn("seg", F.floor(F.col("at") / segment))
    # Where a segment ends: the last cut of the highest level in the window before its border, no row where there is none.
    border = (F.col("seg") + 1) * segment
    anchors = cuts.where(F.col("at") > border - limit // 2).groupBy("id", "seg").agg(F.max_by("at", F.struct("level", "at")).alias("anchor"))
    anchors = anchors.join(size, "id").where(F.col("anchor") + limit < F.col("size")).select("id", "seg", "anchor")
    along = W.partitionBy("id").orderBy("seg")
    runs = anchors.select("id", "seg", "anchor", F.row_number().over(along).alias("run"), F.lead("anchor").over(along).alias("stop"))
    # Each run: from its anchor (run 0: the begin) to the next one or the end of the text.
    heads = size.join(runs.where("run = 1").select("id", F.col("anchor").alias("stop")), "id", "left").select("id", F.lit(0).cast("int").alias("run"), F.lit(0).cast("bigint").alias("begin"), F.coalesce("stop", "size").alias("stop"), F.col("stop").isNull().alias("ends"))
    rest = runs.join(size, "id").select("id", "run", F.col("anchor").alias("begin"), F.coalesce("stop", "size").alias("stop"), F.col("stop").isNull().alias("ends"))
    every = heads.unionByName(rest)
    known = runs.select("id", F.col("seg").alias("own_seg"), F.col("run").alias("own_run"), "anchor")
    before = W.partitionBy("id").orderBy("seg").rangeBetween(W.unboundedPreceding, -1)
    segs = cuts.select("id", "seg").distinct()
    passed = segs.join(known, (segs["id"] == known["id"]) & (segs["seg"] == known["own_seg"]), "left").select(segs["id"], segs["seg"], "own_run", "anchor")
    passed = passed.withColumn("passed", F.coalesce(F.max("own_run").over(before), F.lit(0)))
    in_run = cuts.join(passed, ["id", "seg"]).withColumn("run", F.col("passed") + (F.col("anchor").isNotNull() & (F.col("at") > F.col("anchor"))).cast("int"))
    held = in_run.groupBy("id", "run").agg(F.sort_array(F.collect_list(F.struct("at", "level"))).alias("cuts"))  # bounded by a segment's cells
    ready = every.join(held, ["id", "run"], "left").select("id", "run", "begin", "stop", "ends", "cuts")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of = {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}
            for i, own in enumerate(of["cuts"]):
                at = np.array([c["at"] for c in own or []], np.int64)
                level = np.array([c["level"] for c in own or []], np.int8)
                at, level = _merged(at, level, limit)
                held = (at > of["begin"][i]) & (at < of["stop"][i]) if not of["ends"][i] else at > of["begin"][i]
                rows = chosen_pieces(of["stop"][i], at[held], level[held], limit, overlap, of["begin"][i])
                start, end, how = zip(*rows, strict=True)
                how = [*how[:-1], how[-1] if of["ends"][i] else "natural"]
                n = len(rows)
                yield pa.RecordBatch.from_arrays([pa.array([of["id"][i]] * n), pa.array([of["run"][i]] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(how)], names=["id", "run", "nth", "start", "end", "cut"])

    chosen = ready.mapInArrow(choose, "id string, run int, nth int, start bigint, end bigint, cut string")
    if_many = materialise(chosen, "pieces")
    counts = if_many.groupBy("id", "run").agg(F.count("*").alias("n"))
    ahead = W.partitionBy("id").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    numbered = counts.select("id", "run", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    return if_many.join(numbered, ["id", "run"]).select("id", (F.col("ahead") + F.col("nth")).cast("int").alias("piece"), "start", "end", "cut")


def piece_texts(source: DataFrame | Cells | Files, limit: int = LIMIT, overlap: int = OVERLAP, range_bytes: int = RANGE_BYTES, segment: int = SEGMENT) -> DataFrame:
    """``pieces`` with ``text``: each range is read once more and gives, by offset, its part of the pieces that touch it."""
    source = source if not isinstance(source, DataFrame) else Cells(source)
    table = materialise(cut_table(source, limit, range_bytes), "cuts")
    chosen = materialise(_pieces(table, limit, overlap, segment), "pieces")
    cell = max(limit, range_bytes // 4)  # a range holds at least a quarter of its bytes in code points
    spans = table.where("n_chars > 0").select("id", "r", "offset", "n_chars", F.explode(F.expr(f"sequence(offset div {cell}, (offset + n_chars - 1) div {cell})")).alias("cell"))
    touch = chosen.select("*", F.explode(F.expr(f"sequence(start div {cell}, (end - 1) div {cell})")).alias("cell"))
    both = touch.join(spans, ["id", "cell"]).where("start < offset + n_chars AND end > offset")
    parts = both.select("id", "r", F.struct("piece", "start", "end", "cut", (F.greatest("start", "offset") - F.col("offset")).alias("lo"), (F.least("end", F.col("offset") + F.col("n_chars")) - F.col("offset")).alias("hi")).alias("p"))
    wanted = parts.groupBy("id", "r").agg(F.collect_set("p").alias("wanted"))  # bounded by the pieces of a range

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("piece", "start", "end", "cut")
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.string())
        for b in batches:
            of = {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}
            for i, body in enumerate(of["body"]):
                cp = _decoded(body, range_bytes)
                rows = of["wanted"][i]
                texts = [cp[p["lo"] : p["hi"]].tobytes().decode("utf-32-le", "surrogatepass") for p in rows]
                yield pa.RecordBatch.from_arrays([pa.array([of["id"][i]] * len(rows)), *(pa.array([p[n] for p in rows], k) for n, k in zip(names, kinds, strict=True)), pa.array([of["r"][i]] * len(rows), pa.int32()), pa.array(texts)], names=["id", *names, "r", "part"])

    held = source.bodies(wanted, range_bytes).mapInArrow(cut, "id string, piece int, start bigint, end bigint, cut string, r int, part string")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "part"))), lambda x: x["part"]), "")
    return held.groupBy("id", "piece", "start", "end", "cut").agg(joined.alias("text"))


def oversized(chunks: DataFrame) -> DataFrame:
    """(id, content) of every chunk id, once."""
    return first_deliveries(chunks, "content")


def how_cut(chosen: DataFrame) -> DataFrame:
    """(id, cut): ``forced`` for texts with a forced cut, ``natural`` for the others."""
    forced = F.max(F.col("cut") == "forced")
    return chosen.groupBy("id").agg(F.when(forced, "forced").otherwise("natural").alias("cut"))
