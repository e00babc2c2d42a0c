"""Sentence boundaries across languages and scripts.

Every character is tagged as a boundary (the last of its unit) or inside by a linear-chain conditional random field, decoded
by Viterbi. Whole batches are worked on as flat arrays. Each character has a class; where training never saw a boundary
between a character's class and the next one's, the tag is inside with certainty, so the chain falls into stretches that
can be decoded one by one and still give the best sequence of the whole text. The other characters get features of their
context. The field is trained here, on annotated sentences joined at random. Text of unpunctuated scripts is tagged by
features of the characters around each place, trained on text stripped of its marks.
"""

from __future__ import annotations

import functools
import random
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from juralake.llm import sentence_seed as seed
from juralake.llm.words import mix
from juralake.session import materialise
from juralake.sources.tables import rows_of_sample

#: Classes of characters.
(OTHER, SPACE, LINE, DIGIT, UPPER, LOWER, HAN, KANA, THAI, CASELESS, STOP, DOTS, ASK, WIDE, DANDA, SEMICOLON, OPEN_QUOTE, CLOSE_QUOTE, QUOTE, APOSTROPHE, OPEN_BRACKET, CLOSE_BRACKET, DASH, COMMA, NONE) = range(25)
N_CLASSES = 25
#: The characters of each class, later ones first.
CLASS_PATTERNS = (
    (r"\p{L}|\p{M}", CASELESS), (r"\p{Lu}|\p{Lt}", UPPER), (r"\p{Ll}", LOWER), (r"\p{Thai}", THAI), (r"\p{Han}|[々〇]", HAN), (r"\p{Hiragana}|\p{Katakana}|ー", KANA), (r"\p{Nd}", DIGIT), (r"\s", SPACE), ("[\n\r\x85  ]", LINE),
    (r"\.", STOP), ("…", DOTS), ("[!?！？؟‼⁇⁈⁉]", ASK), ("[。．]", WIDE), ("[।॥]", DANDA), ("[;;]", SEMICOLON), ("[“«„‹「『‘¿¡]", OPEN_QUOTE), ("[”’»›」』]", CLOSE_QUOTE), ('"', QUOTE), ("'", APOSTROPHE),
    (r"[(\[（【《{]", OPEN_BRACKET), (r"[)\]）】》}]", CLOSE_BRACKET), ("[–—-]", DASH), ("[,:，：、،؛·；]", COMMA),
)
#: What closes each opening mark.
CLOSES = {"“": "”", "«": "»", "„": "“”", "‹": "›", "「": "」", "『": "』", "(": ")", "[": "]", "（": "）", "【": "】", "《": "》", '"': '"'}
ROUND = frozenset("([（【")
QUOTED = regex.compile("[\"“«„‹「『(\\[（【《”»›」』)\\]）】》]")
#: Letters of a paragraph without any mark of its script from which it is tagged by its characters alone.
BARE_LETTERS = 12
#: What a boundary there must outweigh, in natural logarithms, as a unit wrongly cut is worse than two left together.
BARE_BIAS = 0.5
#: How far the context of a mark is read, in characters, on either side: longer words are just words.
REACH = 16
GREEK_REACH = 60
#: Slots of hashed features: of places by marks, and behind them as many of places in text without.
HALF = 1 << 18
SLOTS = 2 * HALF
#: Characters worked on at a time; a longer text is taken whole.
SLICE_CHARS = 1 << 20
#: Texts of the corpus that the features of unpunctuated scripts are fitted on, at most.
FIT_TEXTS = 3000


@functools.cache
def _classes() -> np.ndarray:
    """The class of every code point."""
    every = "".join(map(chr, range(0x110000)))
    kind = np.zeros(0x110000, np.uint8)
    for pattern, value in CLASS_PATTERNS:
        for m in regex.finditer(f"(?:{pattern})+", every):
            kind[m.start() : m.end()] = value
    return kind


@functools.cache
def _greek() -> np.ndarray:
    out = np.zeros(0x110000, bool)
    out[0x370:0x400] = out[0x1F00:0x2000] = True
    return out


def _of(*classes: int) -> np.ndarray:
    out = np.zeros(N_CLASSES, bool)
    out[list(classes)] = True
    return out


FINAL = _of(STOP, DOTS, ASK, WIDE, DANDA, SEMICOLON)
CLOSER = _of(CLOSE_QUOTE, QUOTE, APOSTROPHE, CLOSE_BRACKET)
LETTER = _of(UPPER, LOWER, HAN, KANA, THAI, CASELESS)
BLANK = _of(SPACE, LINE)
UNPUNCTUATED = _of(HAN, KANA, THAI)
#: What may stand in the token before a mark, besides letters and digits.
TOKEN_SIGNS = ".-_ªº°/%§№&"

# Token classes; known words have the classes of the word lists.
(T_NONE, T_CLOSER, T_SPACE, T_SIGN, T_PERCENT, T_DAY, T_NUMBER, T_CAPITAL, T_LETTER, T_DOTTED, T_SHORT, T_WORD, T_OPEN, T_INNER, T_COUNTED, T_TITLE) = range(16)
# Classes of what stands before the token.
(P_START, P_END, P_ABBREVIATED, P_OPEN, P_POINT, P_COUNT, P_PART, P_WORD) = range(8)
# Classes of the word that follows.
(F_NONE, F_MONTH, F_FIRM, F_VERSUS, F_TITLE, F_MARKER, F_AMOUNT, F_CARRY) = range(8)


def _power(n: int) -> np.ndarray:
    return np.cumprod(np.full(n, 0x9E3779B97F4A7C15, np.uint64))


def _hash(word: str) -> int:
    """The hash of a word read from its last letter on, as ``_tokens`` makes it."""
    cp = np.array([ord(c) for c in reversed(word)], np.uint64)
    return int((mix(cp + np.uint64(1)) * _power(len(cp))).sum())


@functools.cache
def _lexicon() -> tuple[np.ndarray, np.ndarray]:
    """Hashes of known abbreviations (rising) and their classes; also as they stand in texts in capitals."""
    known = {}
    for words, kind in ((seed.OPEN, T_OPEN), (seed.INNER, T_INNER), (seed.COUNTED, T_COUNTED), (seed.TITLES, T_TITLE)):
        known |= {_hash(w.rstrip(".")): kind for w in words}
    for words, kind in ((seed.OPEN, T_OPEN), (seed.INNER, T_INNER), (seed.COUNTED, T_COUNTED), (seed.TITLES, T_TITLE)):
        for w in words:
            if len(w) > 1:
                known.setdefault(_hash(w.upper().rstrip(".")), kind)
    code = np.array(sorted(known), np.uint64)
    return code, np.array([known[int(c)] for c in code], np.int64)


@functools.cache
def _followers() -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words whose coming tells, read from their first letter on, and their classes."""
    known = {}
    for words, kind in ((seed.MONTHS, F_MONTH), (("KG", "OHG", "KGaA"), F_FIRM), (("v", "c"), F_VERSUS), (("Dr", "Hr", "Mr", "Ms"), F_TITLE), (seed.CARRY, F_CARRY)):
        known |= {_hash(x[::-1]): kind for w in words for x in (w, w.upper())}
    code = np.array(sorted(known), np.uint64)
    return code, np.array([known[int(c)] for c in code], np.int64)


@functools.cache
def _parts() -> np.ndarray:
    return np.array(sorted({_hash(x) for w in seed.PARTS for x in (w, w.upper())}), np.uint64)


@functools.cache
def _signs() -> np.ndarray:
    """1 for what may stand in a token besides letters and digits, 3 for signs of a share among them."""
    out = np.zeros(0x110000, np.uint8)
    out[[ord(c) for c in TOKEN_SIGNS]] = 1
    out[[ord(c) for c in "%°‰"]] = 3
    return out


def _look_up(code: np.ndarray, table: tuple[np.ndarray, np.ndarray], missing: int) -> np.ndarray:
    at = np.minimum(np.searchsorted(table[0], code), len(table[0]) - 1)
    return np.where(table[0][at] == code, table[1][at], missing)


def _quotes(text: str, para: np.ndarray) -> list[tuple[int, int, bool]]:
    """Quoted or bracketed stretches (begin, end, whether round) that close within their paragraph; marks that don't are ignored.

    Opened marks stand on a stack, and per closing mark on one of their own, so the work is linear in the number of marks.
    """
    out: list[tuple[int, int, bool]] = []
    stack: list[tuple[int, bool]] = []
    of: dict[str, list[int]] = {}
    held = -1
    for m in QUOTED.finditer(text):
        c, i = m.group(), m.start()
        if para[i] != held:
            held, stack, of = para[i], [], {}
        own = of.get(c)
        while own and own[-1] >= len(stack):
            own.pop()
        if own:
            depth = own.pop()
            out.append((stack[depth][0], i + 1, stack[depth][1]))
            del stack[depth:]
        elif c in CLOSES:
            for end in CLOSES[c]:
                every = of.setdefault(end, [])
                while every and every[-1] >= len(stack):
                    every.pop()
                every.append(len(stack))
            stack.append((i, c in ROUND))
    return sorted(out)


@dataclass
class Flat:
    """A batch of texts as one array of code points with the classes and surroundings of each."""

    text: str
    cp: np.ndarray
    cls: np.ndarray
    #: The paragraph of each code point, numbered over all texts; a blank line and a text's end end one.
    para: np.ndarray
    solid: np.ndarray  # places that aren't white space
    until: np.ndarray  # how many solid places there are up to and with each place

    def after(self, at: np.ndarray) -> np.ndarray:
        """The next solid place after each of ``at`` in its paragraph, -1 for none."""
        k = self.until[at]
        nxt = np.where(k < len(self.solid), self.solid[np.minimum(k, len(self.solid) - 1)], -1)
        return np.where((nxt >= 0) & (self.para[np.maximum(nxt, 0)] == self.para[at]), nxt, -1)

    def before(self, at: np.ndarray) -> np.ndarray:
        """The last solid place up to and with each of ``at`` in its paragraph, -1 for none; ``at`` may be -1."""
        k = self.until[np.maximum(at, 0)] - 1
        held = np.where((k >= 0) & (at >= 0), self.solid[np.maximum(k, 0)], -1)
        return np.where((held >= 0) & (self.para[np.maximum(held, 0)] == self.para[np.maximum(at, 0)]), held, -1)


def flat(texts: Sequence[str]) -> tuple[Flat, np.ndarray]:
    """``texts`` (some character among them) as one Flat, and where each begins."""
    joined = "".join(texts)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(size) - size
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    cls = _classes()[cp]
    blank = BLANK[cls]
    solid = np.flatnonzero(~blank)
    until = np.cumsum(~blank)
    line = np.flatnonzero(cls == LINE)
    if len(line):  # \r\n is one line end
        line = line[~((cp[line] == 10) & np.r_[False, (line[1:] == line[:-1] + 1) & (cp[line[:-1]] == 13)])]
    text = np.zeros(len(cp) + 1, np.int32)
    np.add.at(text, begin[size > 0], 1)
    text = np.cumsum(text[:-1], dtype=np.int32)
    broken = np.zeros(len(cp), np.int32)
    if len(line) > 1:
        broken[line[:-1][(until[line[1:]] == until[line[:-1]]) & (text[line[1:]] == text[line[:-1]])]] = 1
    broken[begin[size > 0]] += 1
    return Flat(joined, cp, cls, np.cumsum(broken, dtype=np.int32), solid, until), begin


def _tokens(f: Flat, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The token that ends before each place of ``end``: its length, hash, class, and whether it has digits alone."""
    back = end[:, None] - 1 - np.arange(REACH)
    inside = back >= 0
    back = np.maximum(back, 0)
    inside &= f.para[back] == f.para[np.maximum(end - 1, 0)][:, None]
    cp, cls = f.cp[back], f.cls[back]
    alnum = LETTER[cls] | (cls == DIGIT)
    sign = _signs()[cp]
    part = alnum | (sign > 0)
    run = np.logical_and.accumulate(inside & part, axis=1)
    whole = run & alnum
    length = np.where(whole.any(axis=1), REACH - np.argmax(whole[:, ::-1], axis=1), 0)  # leading signs are left out
    held = run & (np.arange(REACH) < length[:, None])
    code = np.where(held, mix(cp.astype(np.uint64) + np.uint64(1)) * _power(REACH), np.uint64(0)).sum(axis=1, dtype=np.uint64)
    letter = LETTER[cls] & held
    digit = (cls == DIGIT) & held
    dot = (cls == STOP) & held
    n_letters = letter.sum(axis=1)
    first = cls[:, 0]
    bare_number = digit[:, 0] & (n_letters == 0)
    dotted = dot.any(axis=1) & ~digit.any(axis=1) & letter[:, 0] & ~(letter[:, 3:] & letter[:, 2:-1] & letter[:, 1:-2] & letter[:, :-3]).any(axis=1)
    kind = np.where(length > 3, T_WORD, T_SHORT)
    kind = np.where(dotted, T_DOTTED, kind)
    kind = np.where(length == 1, np.where(first == UPPER, T_CAPITAL, T_LETTER), kind)
    kind = np.where(bare_number, np.where(length <= 2, T_DAY, T_NUMBER), kind)
    kind = np.where((length > 0) & ~(alnum[:, 0] & held[:, 0]), np.where(sign[:, 0] == 3, T_PERCENT, T_SIGN), kind)
    kind = np.where(length == 0, np.where(~inside[:, 0], T_NONE, np.where(BLANK[first], T_SPACE, np.where(CLOSER[first], T_CLOSER, np.where(sign[:, 0] == 3, T_PERCENT, T_SIGN)))), kind)
    known = _look_up(code, _lexicon(), -1)
    return length, code, np.where((length > 0) & (known >= 0), known, kind), bare_number


def _prior(f: Flat, token: np.ndarray, closing: np.ndarray) -> np.ndarray:
    """The class of what stands before tokens that begin at the places ``token``."""
    at = f.before(token - 1)
    at = np.where((at >= 0) & (f.para[np.maximum(at, 0)] == f.para[token]), at, -1)
    cls = f.cls[np.maximum(at, 0)]
    closed = (at >= 0) & (CLOSER[cls] | (closing[np.maximum(at, 0)] >= 0))
    under = f.before(at - 1)
    ended = closed & (under >= 0) & FINAL[f.cls[np.maximum(under, 0)]]
    _, code, kind, number = _tokens(f, np.where(cls == STOP, np.maximum(at, 0), np.maximum(at, 0) + 1))
    length, *_ = _tokens(f, np.maximum(at, 0))
    out = np.full(len(token), P_WORD)
    out = np.where(np.isin(code, _parts()) & (cls != STOP), P_PART, out)
    out = np.where(FINAL[cls] | ended, P_END, out)
    stop = cls == STOP
    out = np.where(stop & (kind == T_OPEN), P_OPEN, out)
    out = np.where(stop & (kind > T_OPEN), P_ABBREVIATED, out)
    out = np.where(stop & np.isin(kind, (T_CAPITAL, T_LETTER)), P_POINT, out)
    out = np.where(stop & number & (length <= 2), P_COUNT, out)
    return np.where(at < 0, P_START, out)


def _follow(f: Flat, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class of the character at each place (-1: the end) and that of the word that begins there."""
    have = at >= 0
    ahead = np.maximum(at, 0)[:, None] + np.arange(REACH)
    inside = (ahead < len(f.cp)) & have[:, None]
    ahead = np.minimum(ahead, len(f.cp) - 1)
    inside &= f.para[ahead] == f.para[np.maximum(at, 0)][:, None]
    cp, cls = f.cp[ahead], f.cls[ahead]
    letter = np.logical_and.accumulate(inside & LETTER[cls], axis=1)
    term = mix(cp.astype(np.uint64) + np.uint64(1)) * _power(REACH)
    out = _look_up(np.where(letter, term, np.uint64(0)).sum(axis=1, dtype=np.uint64), _followers(), F_NONE)
    cjk = np.isin(cls[:, 0], (HAN, KANA))
    for n in (1, 2):
        begun = _look_up(np.where(letter[:, :n], term[:, :n], np.uint64(0)).sum(axis=1, dtype=np.uint64), _followers(), F_NONE)
        out = np.where(cjk & (out == F_NONE) & (begun == F_CARRY), F_CARRY, out)
    number = np.logical_and.accumulate(inside & ((cls == DIGIT) | (cls == STOP)), axis=1) & (cls[:, :1] == DIGIT)
    size = number.sum(axis=1)
    row = np.arange(len(at))
    gap = BLANK[cls] & inside
    nxt = np.minimum(size + 1, REACH - 1)
    spaced = (size > 0) & (size < REACH - 1) & gap[row, np.minimum(size, REACH - 1)]
    beyond = f.cls[np.maximum(f.after(ahead[row, np.minimum(size, REACH - 1)]), 0)]
    out = np.where(spaced & inside[row, nxt] & ((beyond == UPPER) | (LETTER[beyond] & (beyond != LOWER))), F_MARKER, out)
    out = np.where(spaced & inside[row, nxt] & (beyond == LOWER), F_AMOUNT, out)
    return np.where(have, cls[:, 0], NONE), out


#: Features of a place: (columns, templates), filled by ``_context``.
TEMPLATES = 16


def _slots(template: int, *parts: np.ndarray) -> np.ndarray:
    code = np.full(len(parts[0]), template + 1, np.uint64)
    for p in parts:
        code = code * np.uint64(1_000_003) + p.astype(np.int64).view(np.uint64) + np.uint64(7)
    return (mix(code) & np.uint64(HALF - 1)).astype(np.int64)


@dataclass
class Places:
    """Places that may be boundaries, in order, and the slots of their features; -1 where there is none."""

    at: np.ndarray
    slots: np.ndarray
    #: Which of them stand in text without marks.
    bare: np.ndarray


def _roles(f: Flat) -> tuple[np.ndarray, list[tuple[int, int, bool]], np.ndarray]:
    """Which places go on a run of closing marks, the quoted stretches, and at each closing mark its stretch, -1 for none."""
    quotes = _quotes(f.text, f.para) if QUOTED.search(f.text) else []
    closing = np.full(len(f.cp), -1, np.int64)
    goes_on = FINAL[f.cls] | CLOSER[f.cls]
    if quotes:
        begin = np.array([q[0] for q in quotes])
        end = np.array([q[1] for q in quotes]) - 1
        closing[end] = np.arange(len(quotes))
        goes_on[begin] = False
        goes_on[end] = True
        wide = end[np.isin(f.cp[end], [ord(c) for c in "»›”"]) & (end > 1)]  # « text. » keeps its space
        spaced = wide[(f.cls[wide - 1] == SPACE) & goes_on[wide - 2]]
        goes_on[spaced - 1] = True
    return goes_on, quotes, closing


def _context(f: Flat, maybe: np.ndarray) -> Places:
    """Features of the places that may be boundaries: those whose class, the next one's and that beyond white space ``maybe`` holds."""
    n = len(f.cp)
    goes_on, quotes, closing = _roles(f)
    head = np.flatnonzero(goes_on & FINAL[f.cls])
    # Runs: stretches of goes_on that hold a final mark, from its first one on.
    edge = np.flatnonzero(goes_on & ~np.r_[False, goes_on[:-1] & (f.para[1:] == f.para[:-1])])
    stop = np.flatnonzero(goes_on & ~np.r_[goes_on[1:] & (f.para[1:] == f.para[:-1]), False])
    run = np.searchsorted(edge, head, side="right") - 1
    first = np.r_[True, run[1:] != run[:-1]] if len(run) else np.empty(0, bool)
    s, run = head[first], run[first]
    e = stop[run]
    if len(s):
        beside = e + 1 < n
        beside[beside] &= ~BLANK[f.cls[e[beside] + 1]]
        held = ~beside | maybe[0, f.cls[e], f.cls[np.minimum(e + 1, n - 1)]]
        s, e = s[held], e[held]
    out_at: list[np.ndarray] = []
    out_slots: list[np.ndarray] = []
    if len(s):
        nxt = np.minimum(e + 1, n - 1)
        follow_at = f.after(e)
        kind, word = _follow(f, follow_at)
        gap = np.where(follow_at < 0, 3, np.where(follow_at == e + 1, 0, np.where(f.cls[nxt] == LINE, 2, 1)))
        length, code, token, _ = _tokens(f, s)
        prior = _prior(f, s - length, closing)
        known = np.where(token >= T_OPEN, (code % np.uint64(65_521)).astype(np.int64), 0)
        first_cls = f.cls[s].astype(np.int64)
        first_cls = np.where((first_cls == STOP) & (f.cls[np.minimum(s + 1, n - 1)] == STOP) & (e > s), DOTS, first_cls)
        plain = ~np.isin(first_cls, (STOP, DOTS))
        token, prior, known = np.where(plain, T_NONE, token), np.where(plain, P_WORD, prior), np.where(plain, 0, known)
        if (first_cls == SEMICOLON).any():  # a question mark where Greek stands before it
            seen = np.r_[0, np.cumsum(_greek()[f.cp])]
            since = np.maximum(s - GREEK_REACH, np.searchsorted(f.para, f.para[s]))  # no further back than its paragraph
            first_cls = np.where((first_cls == SEMICOLON) & (seen[s] > seen[since]), NONE, first_cls)
        state = np.zeros(len(s), np.int64)
        if quotes:
            state = _quote_states(f, quotes, closing, s, e)
        led = f.before(s - 1)
        shout = (led > 0) & (f.cls[led] == UPPER) & (f.cls[led - 1] == UPPER)
        cased = np.where((kind == UPPER) & (gap == 0), 1 + (f.cls[np.minimum(follow_at + 1, n - 1)] == LOWER) + 2 * LETTER[f.cls[np.maximum(s - 1, 0)]], 0)
        slots = np.stack(
            [
                _slots(0, gap), _slots(1, first_cls, gap), _slots(2, token), _slots(3, kind), _slots(4, state), _slots(5, token, kind), _slots(6, token, word), _slots(7, token, prior),
                _slots(8, first_cls, kind, gap, shout), _slots(9, state, kind, word), _slots(10, token, prior, kind), _slots(11, first_cls, state), _slots(12, token, kind, word), _slots(13, known, kind), _slots(14, known, word), _slots(15, gap, cased, token),
            ],
            axis=1,
        )
        out_at.append(e)
        out_slots.append(slots)
        inner = e - s
        if inner.any():  # the places before a run's last one
            at = np.repeat(s - (np.cumsum(inner) - inner), inner) + np.arange(inner.sum())
            more = np.full((len(at), TEMPLATES), -1, np.int64)
            more[:, 0] = _slots(20, np.zeros(len(at), np.int64))
            more[:, 1] = _slots(21, f.cls[at], f.cls[at + 1])
            out_at.append(at)
            out_slots.append(more)
    # Letters and other signs before white space, which end a unit in scripts without marks.
    space = np.flatnonzero((f.cls[1:] == SPACE) & ~BLANK[f.cls[:-1]] & ~goes_on[:-1] & maybe[1].any(axis=1)[f.cls[:-1]])
    if len(space):
        then = f.after(space)
        space, then = space[then >= 0], then[then >= 0]
        held = maybe[1, f.cls[space], f.cls[then]]
        space, then = space[held], then[held]
        left, right = f.cls[space].astype(np.int64), f.cls[then].astype(np.int64)
        more = np.full((len(space), TEMPLATES), -1, np.int64)
        more[:, 0] = _slots(30, np.zeros(len(space), np.int64))
        more[:, 1] = _slots(31, left, right)
        more[:, 2] = _slots(32, (left == DIGIT) | (right == DIGIT), (left == THAI) | (right == THAI))
        out_at.append(space)
        out_slots.append(more)
    bare = _bare_places(f)
    if len(bare.at):
        out_at.append(bare.at)
        out_slots.append(bare.slots)
    if not out_at:
        return _no_places()
    at, slots = np.concatenate(out_at), np.concatenate(out_slots)
    order = np.argsort(at, kind="stable")
    return Places(at[order], slots[order], order >= len(at) - len(bare.at))


def _no_places() -> Places:
    return Places(np.empty(0, np.int64), np.empty((0, TEMPLATES), np.int64), np.empty(0, bool))


def _quote_states(f: Flat, quotes: list[tuple[int, int, bool]], closing: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """For each run of marks how it stands to quotes: 0 outside, else round or not, fresh or not, within or closing it."""
    begin, end = np.array([q[0] for q in quotes]), np.array([q[1] for q in quotes])
    is_round = np.array([q[2] for q in quotes])
    led = f.before(begin - 1)
    led_cls = f.cls[np.maximum(led, 0)]
    fresh = (led < 0) | (f.para[np.maximum(led, 0)] != f.para[begin]) | FINAL[led_cls] | CLOSER[led_cls] | (closing[np.maximum(led, 0)] >= 0)
    # The innermost stretch at each place, from its events in order.
    place = np.concatenate([begin + 1, end - 1])
    what = np.concatenate([np.arange(len(quotes)), np.full(len(quotes), -1)])
    order = np.lexsort((what >= 0, place))
    stack: list[int] = []
    top = []
    for k in order.tolist():
        if what[k] >= 0:
            stack.append(int(what[k]))
        else:
            stack.pop()
        top.append(stack[-1] if stack else -1)
    place = place[order]
    k = np.searchsorted(place, e, side="right") - 1
    inside = np.where(k >= 0, np.array(top)[np.maximum(k, 0)], -1)
    # The last stretch that closes within the run and began before it.
    held = np.full(len(s), -1, np.int64)
    ends = np.sort(end - 1)
    which = closing[ends]
    j = np.searchsorted(ends, e, side="right") - 1
    ok = (j >= 0) & (ends[np.maximum(j, 0)] > s)
    held = np.where(ok, which[np.maximum(j, 0)], -1)
    held = np.where((held >= 0) & (begin[np.maximum(held, 0)] < s), held, -1)
    q = np.where(held >= 0, held, inside)
    state = 1 + is_round[np.maximum(q, 0)] * 4 + fresh[np.maximum(q, 0)] * 2 + (inside >= 0)
    return np.where(q >= 0, state, 0)


def _bare_places(f: Flat) -> Places:
    """Every place between letters of unpunctuated scripts, in paragraphs that are long enough and have no mark of a sentence.

    In Thai such a paragraph has no white space between its letters either.
    """
    script = UNPUNCTUATED[f.cls]
    own = np.flatnonzero(script)
    if not len(own):
        return _no_places()
    p = f.para - f.para[0]
    letters = np.bincount(p[own])
    wide = np.flatnonzero(letters >= BARE_LETTERS)
    every = np.bincount(p[f.solid], minlength=len(letters))
    marks = np.bincount(p[np.flatnonzero(FINAL[f.cls])], minlength=len(letters))
    bare = np.zeros(int(p[-1]) + 1, bool)
    bare[wide] = (marks[wide] == 0) & (letters[wide] * 10 >= every[wide] * 8)
    if not bare.any():
        return _no_places()
    between = np.flatnonzero(f.cls[1:-1] == SPACE) + 1
    bare[p[between[(f.cls[between - 1] == THAI) | (f.cls[between + 1] == THAI)]]] = False
    own = own[own + 1 < len(p)]
    at = own[script[own + 1] & bare[p[own]] & (p[own + 1] == p[own])]
    if not len(at):
        return _no_places()
    c = [np.where(p[np.clip(at + k, 0, len(p) - 1)] == p[at], f.cp[np.clip(at + k, 0, len(p) - 1)], 0).astype(np.int64) for k in (-2, -1, 0, 1, 2, 3)]
    thai = f.cls[at] == THAI
    slots = np.full((len(at), TEMPLATES), -1, np.int64)
    for i, parts in enumerate(((thai,), (c[2],), (c[3],), (c[2], c[3]), (c[1], c[2]), (c[3], c[4]), (c[1], c[2], c[3]), (c[2], c[3], c[4]), (c[0], c[1], c[2]), (c[3], c[4], c[5]), (c[1], c[2], c[3], c[4]), (c[0], c[1], c[2], c[3]), (c[2], c[3], c[4], c[5]))):
        slots[:, i] = HALF + _slots(40 + i, *parts)
    return Places(at, slots, np.ones(len(at), bool))


@dataclass
class Field:
    """A linear chain with two tags, inside and boundary: weights of features for a boundary, and of pairs of tags."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(SLOTS + 1, np.float32))
    pairs: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    #: Which pairs of a class and the next one ever held a boundary in training, side by side and with white space between;
    #: the others are inside with certainty. Marks before white space are always looked at.
    maybe: np.ndarray = field(default_factory=lambda: np.zeros((2, N_CLASSES, N_CLASSES), bool))

    def boundaries(self, f: Flat) -> np.ndarray:
        """By Viterbi, the places of all boundaries."""
        places = _context(f, self.maybe)
        return places.at[self.tags(places, f.para)]

    def tags(self, places: Places, para: np.ndarray) -> np.ndarray:
        """Which of ``places`` are boundaries, in the best sequence of tags of each stretch of neighbouring places.

        A place beside which every character is inside with certainty is a stretch of its own. Stretches are decoded
        together, step by step, the longest first.
        """
        at = places.at
        out = np.zeros(len(at), bool)
        if not len(at):
            return out
        emission = self.weights[places.slots].sum(axis=1) - BARE_BIAS * places.bare
        # A place whose emission can't make up for the dearest pairs of tags is inside with certainty.
        slack = 2 * (self.pairs.max() - self.pairs.min())
        live = np.flatnonzero(emission > -slack)
        if not len(live):
            return out
        at, emission = at[live], emission[live]
        start = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (para[at[1:]] != para[at[:-1]])])
        size = np.diff(np.r_[start, len(at)])
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        back = np.zeros((len(at), 2), np.int8)
        score = np.repeat([[0.0, -np.inf]], len(start), axis=0)
        ascending = -size
        for step in range(int(size[0])):
            n = int(np.searchsorted(ascending, -step, side="left"))
            ways = score[:n, :, None] + self.pairs
            back[start[:n] + step] = ways.argmax(axis=1)
            best = ways.max(axis=1)
            best[:, 1] += emission[start[:n] + step]
            score[:n] = best
        tag = (score + self.pairs[:, 0]).argmax(axis=1)
        for step in range(int(size[0]) - 1, -1, -1):
            n = int(np.searchsorted(ascending, -step, side="left"))
            here = start[:n] + step
            out[live[here]] = tag[:n] == 1
            tag[:n] = back[here, tag[:n]]
        return out

    def fit(self, examples: Iterable[tuple[Places, np.ndarray, np.ndarray]], rounds: int = 100, rate: float = 0.4, decay: float = 0.2) -> None:
        """Maximum likelihood by adaptive gradient steps; an example has places, their paragraphs and whether each is a boundary.

        Equal stretches are counted once with their number. Places in text without marks, whose stretches are long and whose
        boundaries lie far apart, are taken one by one, between neighbours that are inside.
        """
        chains: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}  # by length, filled up to a power of two with slots of -2
        for places, para, told in examples:
            at = places.at
            if not len(at):
                continue
            start = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (para[at[1:]] != para[at[:-1]])] | places.bare)
            size = np.diff(np.r_[start, len(at)])
            for n in np.unique(size):
                rows = start[size == n][:, None] + np.arange(n)
                room = 1 << int(n - 1).bit_length()
                x, y = np.full((len(rows), room, TEMPLATES), -2), np.zeros((len(rows), room), bool)
                x[:, :n], y[:, :n] = places.slots[rows], told[rows]
                chains.setdefault(room, []).append((x, y))
        groups = []
        for n, parts in sorted(chains.items()):
            x, y = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            key = np.concatenate([x.reshape(len(x), -1), y], axis=1)
            one, count = np.unique(key, axis=0, return_counts=True)
            groups.append((one[:, : n * TEMPLATES].reshape(-1, n, TEMPLATES), one[:, n * TEMPLATES :].astype(bool), np.sqrt(count)))
        used = np.unique(np.concatenate([g[0].ravel() for g in groups])) if groups else np.empty(0, np.int64)
        used = used[used >= 0]
        n_used = len(used)
        groups = [(np.where(x >= 0, np.searchsorted(used, x), n_used), x[:, :, 0] == -2, y, count) for x, y, count in groups]
        w = np.zeros(n_used + 1)
        squares, pair_squares = np.full(n_used, 1e-6), np.full((2, 2), 1e-6)
        for _ in range(rounds):
            grad, pair_grad = np.zeros(n_used + 1), np.zeros((2, 2))
            for x, spare, y, count in groups:
                n = x.shape[1]
                e = np.where(spare, -1e4, w[x].sum(axis=2))
                up = [np.repeat([[0.0, -np.inf]], len(x), axis=0)]
                for i in range(n):
                    z = np.logaddexp.reduce(up[-1][:, :, None] + self.pairs, axis=1)
                    z[:, 1] += e[:, i]
                    up.append(z)
                down = [np.repeat(self.pairs[None, :, 0], len(x), axis=0)]
                for i in range(n - 1, 0, -1):
                    z = down[0].copy()
                    z[:, 1] += e[:, i]
                    down.insert(0, np.logaddexp.reduce(self.pairs[None] + z[:, None, :], axis=2))
                total = np.logaddexp.reduce(up[-1] + self.pairs[:, 0], axis=1)
                p = np.stack([np.exp(up[i + 1][:, 1] + down[i][:, 1] - total) for i in range(n)], axis=1)
                miss = (p - y) * count[:, None]
                grad += np.bincount(x.ravel(), weights=np.repeat(miss.ravel(), TEMPLATES), minlength=n_used + 1)
                if n > 1:
                    for i in range(n + 1):
                        tail = down[i].copy() if i < n else np.repeat([[0.0, -np.inf]], len(x), axis=0)
                        if i < n:
                            tail[:, 1] += e[:, i]
                        both = np.exp(up[i][:, :, None] + self.pairs + tail[:, None, :] - total[:, None, None])
                        pair_grad += (both * count[:, None, None]).sum(axis=0)
                        was = y[:, i - 1] if i else np.zeros(len(x), bool)
                        now = y[:, i] if i < n else np.zeros(len(x), bool)
                        np.add.at(pair_grad, (was.astype(int), now.astype(int)), -count)
            g = grad[:-1] + decay * w[:-1]
            squares += g * g
            w[:-1] -= rate * g / np.sqrt(squares)
            pair_squares += pair_grad * pair_grad
            self.pairs = self.pairs - 0.1 * pair_grad / np.sqrt(pair_squares)
        self.weights = np.zeros(SLOTS + 1, np.float32)
        self.weights[used] = w[:-1]


def units_of(texts: Sequence[str], model: Field) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, start, end) of every sentence unit of ``texts``, in order, without the white space around."""
    rows, starts, ends = [], [], []
    at = 0
    while at < len(texts):
        end, chars = at, 0
        while end < len(texts) and (chars == 0 or chars + len(texts[end]) <= SLICE_CHARS):
            chars += len(texts[end])
            end += 1
        if chars:
            part = texts[at:end]
            f, begin = flat(part)
            solid = f.solid
            if len(solid):
                ended = np.zeros(len(f.cp) + 1, np.int32)
                ended[model.boundaries(f) + 1] = 1
                unit = np.cumsum(ended[:-1])[solid] + f.para[solid]
                new = np.r_[True, unit[1:] != unit[:-1]]
                first = solid[new]
                last = solid[np.r_[new[1:], True]]
                text = np.searchsorted(begin, first, side="right") - 1
                rows.append(text + at)
                starts.append(first - begin[text])
                ends.append(last + 1 - begin[text])
        at = end
    none = np.empty(0, np.int64)
    return (np.concatenate(rows), np.concatenate(starts), np.concatenate(ends)) if rows else (none, none, none)


def units(text: str, model: Field) -> list[tuple[int, int]]:
    """(start, end) of every sentence unit of one text."""
    _, start, end = units_of([text], model)
    return list(zip(start.tolist(), end.tolist(), strict=True))


# Training


def _filled(unit: str, lang: str, rng: random.Random) -> str:
    def fill(m: regex.Match) -> str:
        kind = m.group(1)
        if kind == "n":
            return rng.choice(seed.NAMES.get(lang, seed.NAMES[""]))
        if kind == "d":
            return str(rng.choice([rng.randrange(1, 31), rng.randrange(1, 10_000)]))
        if kind == "l":
            return str(rng.randrange(1, 31))
        if kind == "t":
            return rng.choice(seed.DATES.get(lang, seed.DATES[""]))
        return rng.choice(seed.AMOUNTS)

    return regex.sub(r"\{(\w)\}", fill, unit)


def annotated(lang: str) -> list[str]:
    """The annotated units of a language, unfilled."""
    return [u.strip() for line in seed.SEED[lang].splitlines() for u in line.split("|") if u.strip()]


#: White space within a unit, in training.
INNER_GAPS = [" "] * 28 + ["\n", "\n", "\xa0", "  "]


def training_documents(documents: int = 160, seed_number: int = 11) -> Iterator[tuple[str, set[int]]]:
    """Texts of annotated units in random order and spacing, and where their units end."""
    rng = random.Random(seed_number)
    langs = list(seed.SEED)
    for lang in langs:
        own = [(u, lang) for u in annotated(lang)]
        for k in range(documents):
            every = own
            if k % 3 == 0:  # some texts go on in another language
                other = rng.choice(langs)
                every = own + [(u, other) for u in annotated(other)]
            text, ends, glued = "", set(), False
            for unit, of in rng.sample(every, min(len(every), 12)):
                heading = unit[-1:].isalpha() and of != "th"
                if heading:
                    text = text.rstrip() + "\n\n" if text else ""
                filled = _filled(unit, of, rng)
                if glued and not (filled[0].isupper() and filled[1:2].islower()):
                    text += " "
                text += filled if of == "th" else regex.sub(" ", lambda m: rng.choice(INNER_GAPS), filled)
                ends.add(len(text))
                gap = "\n\n" if heading or rng.random() < 0.1 else rng.choice(["", "", " "] if of in ("zh", "ja") else [" "] * 12 if of == "th" else [" "] * 24 + ["  ", "\n", "\t", " ", "\xa0", ""])
                text += gap
                glued = not gap and of not in ("zh", "ja")
            text = text.rstrip()
            yield ("".join(c.upper() if len(c.upper()) == 1 else c for c in text) if k % 10 == 1 else text), ends


STRIPPED = regex.compile(r"[\p{P}\p{S}\s]+")


def stripped_documents(units_by_lang: dict[str, list[str]], documents: int = 250, seed_number: int = 12) -> Iterator[tuple[str, set[int]]]:
    """Texts of unpunctuated scripts: whole units, stripped of all marks and spaces, joined without any."""
    rng = random.Random(seed_number)
    for lang in sorted(units_by_lang):
        every = [STRIPPED.sub("", u) for u in units_by_lang[lang]]
        every = [u for u in every if len(u) > 3]
        for _ in range(documents if every else 0):
            text, ends = "", set()
            for u in rng.choices(every, k=rng.choice([1, 1, 1, 2, 3, 5])):
                text += u
                ends.add(len(text))
            yield text, ends


def _unmarked() -> dict[str, list[str]]:
    """The package's own units of unpunctuated scripts: filled annotated ones, and everyday ones."""
    return {k: [_filled(u, k, random.Random(i)) for i in range(2) for u in annotated(k)] + v.split("|") for k, v in seed.EVERYDAY.items()}


def examples(documents: Iterable[tuple[str, set[int]]], maybe: np.ndarray) -> tuple[Places, np.ndarray, np.ndarray]:
    """All places of ``documents`` that have features, their paragraphs, and whether each is a boundary."""
    texts, told = zip(*documents, strict=True)
    f, begin = flat(texts)
    places = _context(f, maybe)
    ends = np.zeros(len(f.cp) + 1, bool)
    for b, own in zip(begin.tolist(), told, strict=True):
        ends[[b + x - 1 for x in own]] = True
    held = f.after(places.at) >= 0  # a paragraph's last place is an end anyway
    return Places(places.at[held], places.slots[held], places.bare[held]), f.para, ends[places.at[held]]


@functools.cache
def trained() -> Field:
    """The field, trained once a process on the package's own annotated sentences; the same every time."""
    model = Field()
    documents = list(training_documents())
    texts = [t for t, _ in documents]
    f, begin = flat(texts)
    for b, (_, own) in zip(begin.tolist(), documents, strict=True):
        at = np.array([b + x - 1 for x in own])
        then = f.after(at)
        at, then = at[then >= 0], then[then >= 0]
        gap = f.cls[at + 1] == SPACE
        model.maybe[1, f.cls[at[gap]], f.cls[then[gap]]] = True
        beside = then == at + 1
        model.maybe[0, f.cls[at[beside]], f.cls[then[beside]]] = True
    bare = list(stripped_documents(_unmarked(), 700))
    model.fit([examples(documents, model.maybe), examples(bare, model.maybe)])
    return model


def adapted(model: Field, texts: Sequence[str]) -> Field:
    """``model`` with its weights for unpunctuated scripts fitted also on ``texts``: their own units, stripped of marks.

    Where a text is punctuated, its marks tell where sentences end; stripped of them it shows how such places look.
    """
    rows, start, end = units_of(texts, model)
    own: dict[str, list[str]] = {"zh": [], "ja": [], "th": []}
    for i, a, b in zip(rows.tolist(), start.tolist(), end.tolist(), strict=True):
        if b - a > 400:
            continue
        unit = texts[i][a:b]
        count = np.bincount(_classes()[[ord(c) for c in unit]], minlength=N_CLASSES)
        letters = int(count[LETTER].sum())
        if letters and count[[HAN, KANA, THAI]].sum() * 10 >= letters * 8:
            own["th" if count[THAI] else "ja" if count[KANA] else "zh"].append(unit)
    more = {k: sorted(set(own[k])) + v for k, v in _unmarked().items()}
    bare = Field()
    bare.fit([examples(stripped_documents(more, 900), model.maybe)], rounds=80)
    return Field(np.concatenate([model.weights[:HALF], bare.weights[HALF:]]), model.pairs, model.maybe)


def fit_texts(texts: DataFrame, n: int = FIT_TEXTS) -> list[str]:
    """At most ``n`` contents, those of the smallest hashes of id; they are chosen by id alone, and only then read."""
    chosen = materialise(texts.select("id").where("id IS NOT NULL").distinct().orderBy(F.xxhash64("id"), "id").limit(n), "chosen")
    rows = rows_of_sample(texts, chosen, "id", "content").where("content IS NOT NULL").collect()  # n ids at most
    return [c for _, c in sorted({(r["id"], r["content"]) for r in rows})]


def sentence_units(texts: DataFrame, model: Field | None = None) -> DataFrame:
    """(id, start_pos, end_pos): every sentence unit of every row of ``texts`` (id, content), by code points; the end is exclusive.

    Units cover every character that isn't white space. NULL, empty and blank contents have no units. Texts are taken whole,
    batch by batch as flat arrays, so the plan has no shuffle of its own and texts cost in proportion to their length.
    """
    held = model or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, start, end = units_of(b.column(1).to_pylist(), held)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(start), pa.array(end)], names=["id", "start_pos", "end_pos"])

    return texts.where(F.col("content").isNotNull()).select("id", "content").mapInArrow(run, "id string, start_pos bigint, end_pos bigint")
