"""Problem 8: find text decoded with the wrong encoding and restore it.

A hidden Markov model labels the characters: one clean state, one for lost characters, and one state per pair (encoding
the bytes were in, encoding they were read as). A state other than the clean one emits characters in units - those that
its inverse transform turns into one character - at the cost, in bits, of what they turn into under one model of clean
text; characters that the inverse cannot come from are out of reach for it. Entering and leaving a span cost bits as well.
The Viterbi path labels every character, and each labelled span gets the inverse transform of its state.

ASCII characters are emitted alike by all states, so nothing happens between two pieces (what stands between blanks) but
that a path stays in its state. The best ways through a piece, for every state from and to the clean one or itself, are
computed once per task and piece. A piece through which no way beats the clean one can never open a span, so a document
without any other piece is clean without running Viterbi; that is exact.

The model of clean text has bits for characters and for the classes of neighbours. They are fitted to the corpus: counted
over all documents that hold no character sequence that a wrong reading leaves behind, and shrunk towards fixed values,
which alone hold for a corpus too small to say anything.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable
from contextlib import suppress
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tendrel.llm.arrowtext import SLICE, by_batch, codepoints, slices

# What UTF-8 bytes were read as.
READ_AS = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "gbk", "cp1250", "cp1251", "iso8859-2", "iso8859-15", "koi8-r", "cp866", "cp1253", "cp1254", "cp1255", "cp1256", "cp1257", "big5", "shift_jis", "euc_kr")
# Single-byte encodings and what their bytes were read as.
SINGLE = (
    ("cp1251", "cp1252"), ("koi8-r", "cp1252"), ("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp866", "cp1251"), ("cp866", "cp1252"),
    ("iso8859-2", "latin-1"), ("cp1250", "cp1252"), ("mac_roman", "cp1252"), ("cp850", "cp1252"), ("cp437", "cp1252"),
    ("cp1252", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "cp1251"), ("cp1252", "cp1250"),
    ("cp1253", "cp1252"), ("iso8859-7", "cp1252"), ("iso8859-7", "latin-1"), ("cp1254", "cp1252"),
)
CLEAN, LOST = "clean", "lost"
#: Readings of single bytes that are usual mistakes: of a whole alphabet by the default of another region.
_LIKELY = ("cp1251>cp1252", "koi8-r>cp1252", "koi8-r>cp1251", "cp866>cp1251", "iso8859-2>latin-1", "cp1250>cp1252", "cp1253>cp1252", "iso8859-7>cp1252", "cp1254>cp1252")
#: Bits to begin and to end a span; together what a span must save. Text that comes out as valid UTF-8 can hardly be a
#: coincidence, so such spans begin cheaply; readings between two rare single-byte encodings need more. A lost character
#: (U+FFFD) proves a span by itself.
BEGIN, BEGIN_SINGLE, BEGIN_RARE, END = 4.0, 8.0, 12.0, 2.0
NEVER = 1e6

_PIECE = re.compile(r"[^ \n\t\r]*[^\x00-\x7f][^ \n\t\r]*")
_RUN = re.compile(r"[^\x00-\x7f]+")
# Characters by how usual they are in clean text of the languages at hand, with their bits.
_USUAL = {
    4.0: "’“”–—•§€£°éèàáíóúçãñüöäßêąćęłńśźż",
    5.0: "ôâù½±µΩ…«»„‘¿¡ëîïûõœæåøìòÀÉÈÇÄÖÜÁÍÓÚÑÃÊÔÂÕ×·²³™®©№",
    6.5: "ÅØÆŒËÎÏÛÙŁŚŻŹĆĘĄŃ¼¾ºğışİŞ",
    9.5: "ðþýÐÞÝ",
}
_BITS = {c: bits for bits, chars in _USUAL.items() for c in chars}
# Russian letters from the most to the least usual, in groups of about equal frequency.
_CYRILLIC = {
    3.3: "о", 3.7: "еаи", 4.0: "нтс", 4.5: "рвл", 5.0: "кмдпу", 5.8: "яыьгзб", 6.3: "чйх", 7.0: "жшю", 8.0: "цщэф", 9.0: "ё", 11.0: "ъ",
}
_LETTER = {c: bits for bits, chars in _CYRILLIC.items() for c in chars}
# Greek letters likewise.
_GREEK = {3.4: "αο", 3.9: "ιετ", 4.3: "σνηυρ", 4.8: "πκμλς", 5.4: "ωίόάέ", 6.0: "γδήθχφβύώ", 7.5: "ξζψϊΐϋΰ"}
_LETTER |= {c: bits for bits, chars in _GREEK.items() for c in chars}
_OPENING, _CLOSING = "“„«¿¡‘•§€£", "’”»…°½¼¾²³ºª™®©"


@lru_cache(maxsize=65536)
def _kind(c: str) -> tuple[str, float]:
    """(class, bits) of a character: l, L letters of Latin; c, C of Cyrillic; g Greek; h East Asian; o opening and
    e closing marks; b box drawing; n no-break spaces; s other symbols; d digits; x what clean text does not hold."""
    if c < "\x80":
        return ("L" if c.isupper() else "l" if c.isalpha() else "d", 0.0)
    category, cp = unicodedata.category(c), ord(c)
    bits = _BITS.get(c)
    if c in _OPENING:
        return "o", bits or 6.0
    if c in _CLOSING:
        return "e", bits or 8.0
    if category[0] == "L":
        if cp < 0x250:
            return "L" if category == "Lu" else "l", bits or 7.0
        if 0x400 <= cp < 0x530:
            upper = category == "Lu"
            return "C" if upper else "c", _LETTER.get(c.lower(), 10.0) + (1.0 if upper else 0.0)
        if 0x370 <= cp < 0x400:
            return "g", bits or _LETTER.get(c.lower(), 8.0) + (1.0 if category == "Lu" else 0.0)
        return "h", 16.0
    if 0x2500 <= cp < 0x2580:
        return "b", 9.0
    if category in ("Cc", "Cn", "Co", "Cs"):
        return "x", 24.0
    if c == "\xa0":
        return "n", 4.5
    # Symbols that text has: Latin, punctuation, currencies, letter-like ones, arrows, shapes.
    usual = cp < 0x250 or 0x2000 <= cp < 0x2200 or 0x25A0 <= cp < 0x2700
    return "s", bits or (9.0 if usual else 16.0)


#: Bits of two neighbours that clean text seldom has; pairs that are not listed cost nothing.
_NEXT = {
    "lL": 6, "cC": 6, "lo": 7, "Lo": 7, "el": 0, "ol": 0, "co": 7, "Co": 7, "ec": 0, "es": 5, "se": 5, "eo": 5, "oo": 2, "oe": 5, "ee": 3,
    "lc": 9, "Lc": 9, "lC": 9, "LC": 9, "cl": 9, "cL": 9, "Cl": 9, "CL": 9, "gl": 4, "gL": 4, "lg": 6, "Lg": 6, "cg": 9, "gc": 9,
    "lh": 8, "Lh": 8, "hl": 8, "hL": 8, "hh": -6, "ls": 3, "Ls": 3, "sl": 3, "sL": 3, "cs": 3, "sc": 3, "ss": 3, "bb": -3, "cb": 8, "Cb": 8, "bc": 8, "bC": 8,
    "lb": 8, "Lb": 8, "bl": 8, "bL": 8, "sb": 6, "bs": 6, "eb": 6, "be": 6, "bo": 6, "ob": 6, "Le": 1,
}


#: Weight of the fixed values against counts: characters, and pairs of neighbours.
PRIOR_CHARACTERS, PRIOR_PAIRS = 20_000.0, 200.0
_BLANK = "_"
#: Pairs of characters whose bits a task remembers; the others are computed each time.
KNOWN = 500_000


class TextModel:
    """Bits of characters and neighbours in clean text: fixed values, or counts shrunk towards them.

    characters: how often each character beyond ASCII occurs; pairs: how often classes of neighbours do, of all characters.
    """

    def __init__(self, characters: dict[str, int] | None = None, pairs: dict[str, int] | None = None):
        characters, pairs = characters or {}, pairs or {}
        self.total = sum(characters.values())
        self.characters, self.pairs = characters, pairs
        first, second = Counter(), Counter()
        for pair, n in pairs.items():
            first[pair[0]] += n
            second[pair[1]] += n
        every = sum(pairs.values())
        self.next = {}
        for pair in pairs.keys() | _NEXT.keys():
            expected = first[pair[0]] * second[pair[1]] / every if every else 0.0
            share = (pairs.get(pair, 0) + PRIOR_PAIRS * 2.0 ** -_NEXT.get(pair, 0)) / (expected + PRIOR_PAIRS)
            # Counts may only add to what a fixed value says of a pair that does not occur.
            self.next[pair] = max(_NEXT.get(pair, 0) - 3.0, min(_NEXT.get(pair, 0) + 4.0, -math.log2(share)))
        self.bits: dict[str, float] = {}
        self.known: dict[tuple[str, str], float] = {}

    def of(self, c: str) -> float:
        """Bits of a character; ASCII costs nothing."""
        if c < "\x80":
            return 0.0
        bits = self.bits.get(c)
        if bits is None:
            fixed = _kind(c)[1]
            share = (self.characters.get(c, 0) + PRIOR_CHARACTERS * 2.0**-fixed) / (self.total + PRIOR_CHARACTERS)
            bits = self.bits[c] = max(fixed - 4.0, min(24.0, -math.log2(share)))
        return bits

    def after(self, last: str, c: str) -> float:
        """Bits of a character behind another one (empty at the begin); nothing between two of ASCII."""
        if c < "\x80" and last < "\x80":
            return 0.0
        bits = self.known.get((last, c))
        if bits is None:
            bits = self._after(last, c)
            if len(self.known) < KNOWN:
                self.known[last, c] = bits
        return bits

    def _after(self, last: str, c: str) -> float:
        kind, before = _kind(c)[0], _kind(last)[0] if last else ""
        total = self.of(c)
        if before:
            total += self.next.get(before + kind, 0)
            if kind == "e" and before in "lLcC" and c not in "’”…»™®©°":
                total += 6
            if c in "©®°™" and before in "lLcC" and last >= "\x80":
                total += 6
            if kind in "lLcC" and before == "e" and last not in "’”»°":
                total += 6
            if kind in "lL" and last >= "\x80" and c >= "\x80" and before in "lL":
                total += 3
            if kind == "n" and before == "L" and last >= "\x80":
                total += 6
            if c in "€£§" and before in "lLcCd":
                total += 4
            if kind in "lL" and last in "€£§•":
                total += 5
        return total

    def text(self, piece: str, last: str = "") -> float:
        """Bits of a piece of clean text behind a character."""
        total = 0.0
        for c in piece:
            total += self.after(last, c)
            last = c
        return total


@lru_cache(maxsize=64)
def _byte_of(codec: str) -> dict[str, int]:
    """The byte of each character that a single-byte codec reads; bytes that it leaves open are read as C1 controls."""
    table = {}
    for b in range(256):
        try:
            table[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            table[chr(b)] = b
    return table


_MULTI = {"gbk", "big5", "shift_jis", "euc_kr"}


#: A unit at a place: (place behind it, what it turns into); null if there is none.
Unit = tuple[int, str] | None


def _utf8_unit(codec: str, times: int = 1, outer: bool = True) -> Callable[[str, int], Unit]:
    """Units of text that was written as UTF-8 and read with a single-byte codec, so many times over."""
    table = _byte_of(codec)
    inner = _utf8_unit(codec, times - 1, outer=False) if times > 1 else lambda text, at: (at + 1, text[at]) if at < len(text) else None

    def unit(text: str, at: int) -> Unit:
        if (got := inner(text, at)) is None or (lead := table.get(got[1], 0)) < 0xC2 or lead > 0xF4:
            return None
        raw, (at, _) = bytearray([lead]), got
        for _ in range(1 if lead < 0xE0 else 2 if lead < 0xF0 else 3):
            if (got := inner(text, at)) is None or not 0x80 <= (byte := table.get(got[1], 0)) < 0xC0:
                return None
            raw.append(byte)
            at = got[0]
        try:
            made = raw.decode("utf-8")
        except UnicodeDecodeError:
            return None
        # No text was written with controls or with code points that stand for nothing; a further reading may show such.
        return None if outer and unicodedata.category(made) in ("Cc", "Cn", "Co", "Cs") else (at, made)

    return unit


def _multi_unit(codec: str) -> Callable[[str, int], Unit]:
    """Runs beyond ASCII of text that was written as UTF-8 and read with a codec of several bytes, which pairs them anew.

    Bytes that the reader could not pair came out as U+FFFD; what is left of them is lost.
    """

    def unit(text: str, at: int) -> Unit:
        end = at
        while end < len(text) and text[end] >= "\x80":
            end += 1
        if at and text[at - 1] >= "\x80" or end == at:
            return None
        parts, out = text[at:end].split("�"), []
        for k, part in enumerate(parts):
            try:
                raw = part.encode(codec)
            except UnicodeEncodeError:
                return None
            try:
                out.append(raw.decode("utf-8"))
            except UnicodeDecodeError as e:
                if not (k < len(parts) - 1 and e.end == len(raw) and e.reason == "unexpected end of data"):
                    return None
                out.append(raw[: e.start].decode("utf-8"))
        made = "�".join(out)
        return (end, made) if made != text[at:end] else None

    return unit


def _single_unit(written: str, read: str) -> Callable[[str, int], Unit]:
    """Characters of text that was written with one single-byte codec and read with another; those that both share are none."""
    table = {}
    for c, byte in _byte_of(read).items():
        if c >= "\x80":
            with suppress(UnicodeDecodeError):
                table[c] = bytes([byte]).decode(written)

    def unit(text: str, at: int) -> Unit:
        # A no-break space behind ASCII is a plain gap.
        if text[at] == "\xa0" and (not at or text[at - 1] < "\x80" or text[at - 1] == "\xa0"):
            return None
        made = table.get(text[at])
        return None if made is None else (at + 1, made)

    return unit


def _lost_unit(text: str, at: int) -> Unit:
    return (at + 1, "�") if text[at] == "�" else None


@lru_cache(maxsize=1)
def states() -> tuple[tuple[str, Callable[[str, int], Unit]], ...]:
    """(label, units) of every state; the clean one comes first."""
    out: list = [(CLEAN, lambda text, at: None), (LOST, _lost_unit)]
    out += [(f"utf-8>{c}", _multi_unit(c) if c in _MULTI else _utf8_unit(c)) for c in READ_AS]
    out += [(f"utf-8>{c} twice", _utf8_unit(c, 2)) for c in ("cp1252", "latin-1", "mac_roman")]
    out += [(f"{a}>{b}", _single_unit(a, b)) for a, b in SINGLE]
    return tuple(out)


def _begin(label: str) -> float:
    if label == CLEAN:
        return 0.0
    if label == LOST or label.startswith("utf-8>"):
        return BEGIN
    return BEGIN_SINGLE if label in _LIKELY else BEGIN_RARE


#: Bits of a piece that a span touches, of lost ones, of every lost character, and of one that the clean state holds.
TOUCHED, TOUCHED_LOST, PER_LOST, NOT_CLEAN = 1.0, 4.0, 2.0, 40.0
#: Bits to begin or end a span between two letters: passages are garbled by words.
INSIDE = 6.0


@lru_cache(maxsize=200_000)
def _units(piece: str, state: int) -> tuple[Unit, ...]:
    """The units of a state at every place of a piece."""
    unit = states()[state][1]
    return tuple([None if c < "\x80" else unit(piece, k) for k, c in enumerate(piece)])


def _touched(state: int) -> float:
    return TOUCHED_LOST if states()[state][0] == LOST else TOUCHED


def _stand_in(c: str) -> str:
    """An ASCII character of the same class."""
    return {"l": "a", "L": "A", "d": "1"}[_kind(c)[0]] if c else ""


#: Where a way through a piece stands: clean, in the state, about to be in it, about to be clean. The last two keep the
#: character before the change apart, as it weighs on what follows.
CALM, WITHIN, ENTERING, LEAVING = range(4)


def _search(piece: str, units: tuple[Unit, ...], model: TextModel, start: int, begin: float, end: float, touched: float) -> list[list]:
    """best[at][where]: bits, last character of the restored text, way there, whether a span was touched; null if none."""
    n = len(piece)
    best: list[list] = [[None] * 4 for _ in range(n + 1)]
    best[0][start] = (0.0, "", None, False)
    for at in range(n + 1):
        here = best[at]
        calm, within = here[CALM], here[WITHIN]
        if calm:
            here[ENTERING] = (calm[0] + begin, calm[1], (at, CALM), calm[3])
        if within:
            here[LEAVING] = (within[0] + end, within[1], (at, WITHIN), within[3])
        if at == n:
            break
        c = piece[at]
        for where in (CALM, LEAVING):
            if way := here[where]:
                cost = way[0] + model.after(way[1], c) + (NOT_CLEAN if c == "�" else 0.0)
                if where == LEAVING and c.isalpha() and way[1].isalpha():
                    cost += INSIDE
                if (known := best[at + 1][CALM]) is None or cost < known[0]:
                    best[at + 1][CALM] = (cost, c, (at, where), way[3])
        # ASCII is emitted alike by all states, and so is a no-break space that means nothing else.
        alike = c < "\x80" or (c == "\xa0" and not units[at])
        if got := (at + 1, c) if alike else units[at]:
            stop, made = got
            text = made.replace("�", "")
            for where in (WITHIN, ENTERING):
                if way := here[where]:
                    cost = way[0] + model.text(text, way[1]) + PER_LOST * made.count("�")
                    first = not alike and not way[3]
                    cost += touched if first else 0.0
                    if where == ENTERING and text[:1].isalpha() and way[1].isalpha():
                        cost += INSIDE
                    if (known := best[stop][WITHIN]) is None or cost < known[0]:
                        best[stop][WITHIN] = (cost, text[-1:] or way[1], (at, where), way[3] or first)
    return best


def _end(best: list[list], stop: int) -> tuple[float, int]:
    """(bits, where) of the best way to the end, clean (0) or in the state (1)."""
    ends = ((CALM, LEAVING), (WITHIN, ENTERING))[stop]
    return min((best[-1][w][0], w) for w in ends if best[-1][w])


def _trace(best: list[list], where: int) -> list[tuple[int, int]]:
    """(start, end) of the stretches that are in the state, on the best way to the end."""
    out: list[tuple[int, int]] = []
    at = len(best) - 1
    while (way := best[at][where][2]) is not None:
        before, source = way
        if where == WITHIN:
            if out and out[-1][0] == at:
                out[-1] = (before, out[-1][1])
            else:
                out.append((before, at))
        at, where = before, source
    return out[::-1]


class Labeller:
    """Labels the characters of texts under a model of clean text; what pieces say is remembered."""

    def __init__(self, model: TextModel | None = None):
        self.model = model or TextModel()
        self.ways = lru_cache(200_000)(self._ways)
        self.gains = lru_cache(100_000)(self._gains)
        self.saved = lru_cache(200_000)(self._saved)

    def _clean(self, piece: str) -> float:
        return self.model.text(piece) + NOT_CLEAN * piece.count("�")

    def _gains(self, before: str, run: str, behind: str) -> tuple[tuple[int, float], ...]:
        """(state, bits) of what a way through a run beyond ASCII saves against the clean one, were spans free, if anything.

        before and behind are ASCII neighbours, of which only the class matters; nothing at an end of the piece.
        """
        whole, out = before + run + behind, []
        clean = self._clean(whole)
        for s in range(1, len(states())):
            units = _units(whole, s)
            if any(units):
                saved = clean - _end(_search(whole, units, self.model, 0, 0.0, 0.0, 0.0), 0)[0]
                if saved > 1e-9:
                    out.append((s, saved))
        return tuple(out)

    def _saved(self, piece: str) -> dict[int, float]:
        """What the best way through a piece in a state saves against the clean one, were spans free, where it saves anything.

        ASCII is emitted alike by all states, so what the runs between it save adds up.
        """
        saved: dict[int, float] = {}
        for m in _RUN.finditer(piece):
            before, behind = piece[m.start() - 1 : m.start()] if m.start() else "", piece[m.end() : m.end() + 1]
            for s, bits in self.gains(_stand_in(before), m.group(), _stand_in(behind)):
                saved[s] = saved.get(s, 0.0) + bits
        left = ((s, bits - _touched(s)) for s, bits in saved.items())
        return {s: bits for s, bits in left if bits > 0}

    def alive(self, pieces: list[str]) -> list[int]:
        """The states that can be on the cheapest path: all that they can save is more than it costs to be in them once.

        Of states that turn all pieces into the same, at the same costs, the first stands for all.
        """
        total: dict[int, float] = {}
        for piece in pieces:
            for s, bits in self.saved(piece).items():
                total[s] = total.get(s, 0.0) + bits
        worth = sorted(s for s, bits in total.items() if bits > _begin(states()[s][0]) + END)
        if len(worth) < 2:
            return worth
        alike = {}
        for s in worth:
            alike.setdefault((_begin(states()[s][0]), _touched(s), tuple([_units(piece, s) for piece in pieces])), s)
        return list(alike.values())

    def _ways(self, piece: str, state: int) -> tuple[tuple[tuple[float, float], tuple[float, float]], tuple]:
        """(bits against the clean way, stretches in the state) from clean or the state (0, 1) to clean or the state."""
        begin, units, clean = _begin(states()[state][0]), _units(piece, state), self._clean(piece)
        if not any(units):
            return ((0.0, begin), (END, END + begin)), (((), ()), ((), ()))
        tables = [_search(piece, units, self.model, start, begin, END, _touched(state)) for start in (0, 1)]
        ends = [[_end(best, stop) for stop in (0, 1)] for best in tables]
        bits = tuple(tuple(x - clean for x, _ in own) for own in ends)
        return bits, tuple(tuple(_trace(best, w) for _, w in own) for best, own in zip(tables, ends, strict=True))

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """Spans (start, end, state) of the garbled passages of a text, in order: the cheapest path through the states."""
        if text.isascii():
            return []
        pieces = [m.span() for m in _PIECE.finditer(text)]
        alive = self.alive([text[a:b] for a, b in pieces])
        if not alive:
            return []
        # Bits of the best path that ends clean, or in each state; -1 stands for the clean one.
        clean, score, back = 0.0, [NEVER] * len(alive), []
        for a, b in pieces:
            ways = [self.ways(text[a:b], s)[0] for s in alive]
            best, sources, moved = (clean, -1, -1), [], []
            for i, w in enumerate(ways):
                if clean + w[0][0] < best[0]:
                    best = (clean + w[0][0], -1, i)
                if score[i] + w[1][0] < best[0]:
                    best = (score[i] + w[1][0], i, i)
                stay, enter = score[i] + w[1][1], clean + w[0][1]
                sources.append(i if stay <= enter else -1)
                moved.append(min(stay, enter))
            back.append((best[1], best[2], sources))
            clean, score = best[0], moved
        at, found = -1, []
        for (a, b), (source, through, sources) in zip(reversed(pieces), reversed(back), strict=True):
            stop = int(at >= 0)
            if stop:
                through, source = at, sources[at]
            if through >= 0:
                own = self.ways(text[a:b], alive[through])[1][int(source >= 0)][stop]
                for x, y in reversed(own):
                    # ASCII at the ends of a stretch may be in it or not: it is left out.
                    inner = [k for k in range(a + x, a + y) if text[k] >= "\x80"]
                    if inner:
                        found.append((inner[0], inner[-1] + 1, alive[through]))
            at = source
        out: list[tuple[int, int, int]] = []
        for start, end, state in reversed(found):
            if out and out[-1][2] == state and text[out[-1][1] : start].isascii():
                out[-1] = (out[-1][0], end, state)
            else:
                out.append((start, end, state))
        return out


@lru_cache(maxsize=1)
def _default() -> Labeller:
    return Labeller()


def label(text: str) -> list[tuple[int, int, int]]:
    """The spans of a text under the fixed values alone."""
    return _default().spans(text)


def restore(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span put back through the inverse of its state; lost characters stay U+FFFD."""
    out, last = [], 0
    for start, end, state in spans:
        unit = states()[state][1]
        out.append(text[last:start])
        at = start
        while at < end:
            got = None if text[at] < "\x80" else unit(text, at)
            out.append(got[1] if got else text[at])
            at = got[0] if got else at + 1
        last = end
    return "".join([*out, text[last:]])


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of every code point as a byte; blanks and other ASCII that is no letter and no digit are `_`."""
    table = np.full(0x110000, ord("h"), np.uint8)
    for cp in range(0x20000):
        c = chr(cp)
        table[cp] = ord(_BLANK if cp < 0x80 and not c.isalnum() else _kind(c)[0])
    return table


@lru_cache(maxsize=1)
def _reading_tables() -> list[np.ndarray]:
    """The byte of every code point below 0x3000 under the single-byte readings; 0 where there is none."""
    out = []
    for codec in READ_AS:
        if codec not in _MULTI:
            table = np.zeros(0x3001, np.uint8)
            for c, byte in _byte_of(codec).items():
                if ord(c) < 0x3000:
                    table[ord(c)] = byte
            out.append(table)
    return out


def _suspect_rows(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts hold what a wrong reading leaves behind: U+FFFD, a control, or characters whose bytes are UTF-8.

    Of the latter only what is usual counts, letters of Latin, Greek and Cyrillic and symbols: others come by chance.
    """
    bad = (points == 0xFFFD) | ((points >= 0x80) & (points < 0xA0))
    beyond = np.flatnonzero(points[:-1] >= 0x80)
    beyond = beyond[points[beyond + 1] >= 0x80]
    low = np.minimum(points, 0x3000)
    for table in _reading_tables():
        first, second = table[low[beyond]], table[low[beyond + 1]]
        third = table[low[np.minimum(beyond + 2, len(points) - 1)]]
        follows = (second >= 0x80) & (second < 0xC0)
        a, b, c = first.astype(np.int32), second.astype(np.int32) & 0x3F, third.astype(np.int32) & 0x3F
        made = (a & 0x1F) << 6 | b
        two = (first >= 0xC2) & (first < 0xE0) & follows & ((made < 0x250) | ((made >= 0x370) & (made < 0x500)))
        made = (a & 0x0F) << 12 | b << 6 | c
        three = (first >= 0xE0) & (first < 0xF0) & follows & (third >= 0x80) & (third < 0xC0) & (made >= 0x2000) & (made < 0x2700)
        bad[beyond[two | three]] = True
    sums = np.concatenate(([0], np.cumsum(bad)))
    return sums[offsets[1:]] > sums[offsets[:-1]]


def _count_clean(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Counts of characters beyond ASCII and of pairs of classes, over a task's texts that are not suspect."""
    characters: Counter[int] = Counter()
    pairs = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for part in slices(batch, SLICE) if batch.num_rows else ():
            points, offsets, _ = codepoints(part.column(0))
            if len(points) < 2:
                continue
            keep = np.repeat(~_suspect_rows(points, offsets), np.diff(offsets))
            classes = _classes()[points].astype(np.int64)
            inner = np.ones(len(points), bool)
            inner[offsets[:-1][offsets[:-1] < len(points)]] = False
            pairs += np.bincount((classes[:-1] << 8 | classes[1:])[inner[1:] & keep[1:]], minlength=1 << 16)
            found, n = np.unique(points[keep & (points >= 0x80)], return_counts=True)
            characters.update(dict(zip(found.tolist(), n.tolist(), strict=True)))
    rows = [(chr(c), n) for c, n in characters.items()]
    rows += [(chr(k >> 8) + chr(k & 255), int(pairs[k])) for k in np.flatnonzero(pairs).tolist()]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], ["item", "n"])


def fit_text_model(documents: DataFrame, text: str = "text") -> TextModel:
    """The model of clean text of a corpus, counted over all texts that hold nothing that a wrong reading leaves behind.

    One pass; what the driver gets is a row per different character and pair of classes, which the number of code points
    bounds. Null and empty texts say nothing; a corpus without any gives the fixed values.
    """
    rows = documents.select(F.col(text).alias("_text")).where("_text <> ''")
    counted = rows.mapInArrow(_count_clean, "item string, n long").groupBy("item").agg(F.sum("n").alias("n")).collect()
    characters = {r[0]: r[1] for r in counted if len(r[0]) == 1}
    return TextModel(characters, {r[0]: r[1] for r in counted if len(r[0]) == 2})


def repair_encoding(df: DataFrame, key: str, text: str = "text", model: TextModel | None = None) -> DataFrame:
    """key, labels (array of the encoding pairs found, in order of the text), restorable and restored, for garbled rows.

    Clean rows, and rows with a null or empty text, do not come out. `restorable` is false where characters are lost for
    good; `restored` is then as much of the text as can be regained. Any length of text is read whole; repeated rows
    come out as often as they occur; columns other than key and text are left aside, whatever their names. One pass in
    Arrow batches, no shuffle. Without a model (see `fit_text_model`) the fixed values hold.
    """
    shared = df.sparkSession.sparkContext.broadcast((model.characters, model.pairs) if model else None)
    own: list[Labeller] = []
    rows = df.select(df[key].alias("_key"), df[text].alias("_text")).where("_text IS NOT NULL")
    schema = T.StructType(
        [
            T.StructField(key, df.schema[key].dataType),
            T.StructField("labels", T.ArrayType(T.StringType())),
            T.StructField("restorable", T.BooleanType()),
            T.StructField("restored", T.StringType()),
        ]
    )

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        if not own:
            own.append(Labeller(TextModel(*shared.value) if shared.value else None))
        at, labels, whole, restored = [], [], [], []
        for k, value in enumerate(batch.column(1).to_pylist()):
            if value.isascii() or not (spans := own[0].spans(value)):
                continue
            fixed = restore(value, spans)
            at.append(k)
            labels.append([states()[s][0] for _, _, s in spans])
            restored.append(fixed)
            whole.append("�" not in fixed)
        if not at:
            return None
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(at)), pa.array(labels, pa.list_(pa.string())), pa.array(whole), pa.array(restored, pa.string())],
            [key, "labels", "restorable", "restored"],
        )

    return rows.mapInArrow(by_batch(run), schema)
