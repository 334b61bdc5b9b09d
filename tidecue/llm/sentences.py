"""Sentence units across languages and scripts.

A record is divided at blank lines. Within a paragraph every mark, and every
gap that may stand in a mark's place, is a possible end of a span. A
semi-Markov dynamic programme chooses whole spans: each is scored by the words
that open it, the words and marks that close it, its length and the balance of
its quotes and brackets. A pair that a span cuts costs more than any mark in it
gives; one half without the other costs the span that holds it once, unless the
span reaches the edge of the paragraph where the other half may have been, so a
quotation that was cut off stays whole while a stray mark doesn't hold many
sentences together.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How well a small letter opens a span after one that also begins with one, and after others.
SMALL_AFTER_SMALL, SMALL_AFTER_CAPITAL = 0.2, -1.0
#: Characters from which on a paragraph's first span may be one that goes on from before.
CONTINUED = 60
#: What an end within a pair of quotes or brackets costs, and one half whose span doesn't reach the edge.
CUT_PAIR, STRAY_HALF = 20.0, 9.0
#: What spans cost that have no letters, hardly any, or very many (weighed by script), at most.
NO_LETTERS, SCRAP, LONGEST = 3.0, 0.3, 3.0
LONG_LETTERS = 300
#: Gain from which on a boundary outside all quotes is in every best sequence: cutting there costs one length score more at most.
SURE = max(NO_LETTERS, LONGEST) + SCRAP
#: Spans that end at one place are scored in arrays from this number on.
_MANY = 48

# Abbreviations, without their last full stop, in lower case.
#: Before a name; they never end a sentence.
TITLES = frozenset(
    (
        "डॉ श्री श्रीमती प्रो dr dra drs sr sra srta sres prof profa mr mrs ms mx m mm mme mmes mlle mgr me hr hrn fr frl ing lic gral gen cap capt col cdt cmdt lt ltn sgt rev st ste mtro mtra "
        "hptm avv dott dott.ssa sig sig.ra sig.na geom arch rag on eng engº d dª акад инж проф тов г-н г-жа д-р св гр ген полк кап"
    ).split()
)
#: Before a number.
REFERENCES = frozenset(
    (
        "p pp pag pág págs pgs cap caps chap ch kap vol vols bd bde fig figs abb tab taf art arts sec secc sect núm num nr nos no n n.º n.ª nº n.o ep eps s seite zeile aufl ausg "
        "стр рис гл т тт с разд табл ил п №"
    ).split()
)
#: Within a sentence, whatever follows.
INNER = frozenset("i.e e.g c.-à-d z.b d.h u.a z.t bzw vgl cf vs viz ca approx т.е т.к т.н напр см p.ej ej p.ex ad es av avda c/ ctra rd ave blvd ул пр пер д кв корп г обл ч мин сек тыс млн approx evtl ggf inkl".split())
#: Of the clock; they may end a sentence.
CLOCK = frozenset("a.m p.m am pm".split())
#: At the end of a list; they mostly end a sentence.
LISTS = frozenset("etc ecc usw usf u.s.w и.т.д т.д т.п и.т.п др и.др et.al al".split())
#: After these, a number with a full stop is an ordinal.
ORDINAL_LEADS = frozenset("am im vom zum beim den dem der die das des ab bis seit zur".split())
#: After these words a thought goes on although a mark stands before them.
GO_ON = frozenset(
    (
        "quizá quizás tal tal_vez maybe perhaps vielleicht peut-être talvez forse magari может наверное возможно शायद 아마 아마도 with con com avec mit с со and und but pero aber но и "
        "said dijo disse dit sagte сказал asked"
    ).split()
)
GO_ON_CJK = ("也许", "或许", "可能", "大概", "来週", "多分", "たぶん", "かもしれ", "と", "って")

_BLANK = regex.compile(r"(?:\r\n|\r|\n)(?:[^\S\r\n]*(?:\r\n|\r|\n))+")
_OPEN = "“«„「『（([【《〈‹"
_CLOSE = {"”": "“„", "»": "«", "“": "„", "」": "「", "』": "『", "）": "（(", ")": "(（", "]": "[", "】": "【", "》": "《", "〉": "〈", "›": "‹"}
_TRAIL = r"(?:[\"”“»」』）)\]】》〉›’']|</[^<>\n]{1,20}>|[⁩​])*"
_MARK = regex.compile(
    r"(?P<ellipsis>\.{3,}|…+|。{2,}|‥+)(?P<more>[!?！？]*)"
    r"|(?P<full>[。！？｡．](?:[。！？!?]*)|[।॥]+|[!?]+[!?！？]*|(?<=[\p{Devanagari}\d\s])\|)"
    r"|(?P<dot>\.)(?!\.)"
    r"|(?P<gap>(?<=[\p{Han}\p{Hiragana}\p{Katakana}\p{N}ー々」』”）])　+(?=[\p{Han}\p{Hiragana}\p{Katakana}「『“（\p{N}]))"
    r"|(?P<dash>(?:\r\n|\r|\n)[^\S\r\n]*(?=(?:[-–—―]|<[a-z]{1,10}>\s*[-–—])\s?\S))"
)
_AFTER = regex.compile(_TRAIL)
_TOKEN_BEFORE = regex.compile(r"[^\s\"“”«»„()（）\[\]¿¡…]*$")
_WORD_AFTER = regex.compile(r"[\s\"“«„(（\[¿¡—–-]*((?:[\p{L}\p{M}\p{N}’'-])+|\S)?")
_ATTRIBUTES = regex.compile(r"\s*(?:[,，;—–]|[-]\s)")
_WIDE = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
_UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]")
_NEXT_WORD = regex.compile(r"[\p{L}\p{M}’'-]+")
_NEXT_SIGN = regex.compile(r"\s*(\S?)")
_BREAK_AND_DASH = regex.compile(r"\s*\n\s*[-–—]")


@dataclass(slots=True)
class Boundary:
    """A possible end of a span: the end of its text, how well it closes a span and what follows opens one.

    small says that a small letter follows where letter case tells something:
    it opens a span SMALL_AFTER_SMALL well if the span that ends here begins so
    too, else SMALL_AFTER_CAPITAL.
    """

    end: int
    closing: float
    opening: float
    small: bool = False


@dataclass(slots=True)
class Quotes:
    """Quotes and brackets of a paragraph: spans of pairs, outermost ones only, and halves that lack the other."""

    pairs: list[tuple[int, int]]
    openers: list[int]
    closers: list[int]


def quotes_of(text: str) -> Quotes:
    """Pair the quotes and brackets of a paragraph."""
    spans: list[tuple[int, int]] = []
    stack: list[tuple[str, int]] = []
    closers: list[int] = []
    straight, left = None, text.count('"')
    for i, ch in enumerate(text):
        if ch == '"':
            before, after = text[i - 1 : i], text[i + 1 : i + 2]
            left -= 1
            if straight is not None:
                spans.append((straight, i + 1))
                straight = None
            elif (not before or before.isspace() or before in "(¿¡—–-「") and after and not after.isspace():
                straight = i
            elif _UNSPACED.match(before) and left % 2:  # where no spaces part words, the number left tells
                straight = i
            elif not spans and not stack:
                closers.append(i + 1)
        elif ch in _CLOSE and stack and any(o in _CLOSE[ch] for o, _ in stack):
            while stack:
                o, at = stack.pop()
                if o in _CLOSE[ch]:
                    spans.append((at, i + 1))
                    break
        elif ch in _OPEN:
            stack.append((ch, i))
        elif ch in _CLOSE and not stack and ch not in ")]" and not any(b > i for _, b in spans):
            closers.append(i + 1)
    openers = [at for _, at in stack] + ([straight] if straight is not None else [])
    spans.sort()
    pairs: list[tuple[int, int]] = []
    for a, b in spans:
        if pairs and a < pairs[-1][1]:
            pairs[-1] = (pairs[-1][0], max(pairs[-1][1], b))
        else:
            pairs.append((a, b))
    outside = lambda at: not any(a < at < b for a, b in pairs)
    return Quotes(pairs, sorted(filter(outside, openers)), sorted(filter(outside, closers)))


def _caseless(text: str) -> bool:
    """Whether letter case tells nothing here: a text all in small letters or all in capitals."""
    return text == text.lower() or text == text.upper()


def boundaries(text: str, quotes: Quotes) -> list[Boundary]:
    """Possible ends of spans within a paragraph, those within quotes included."""
    inside = quotes.pairs
    out: list[Boundary] = []
    caseless = _caseless(text)
    k = 0

    def add(end: int, closing: float, opening: float | None) -> None:
        found = Boundary(end, closing, SMALL_AFTER_SMALL if opening is None else opening, opening is None)
        if out and out[-1].end >= end:
            if out[-1].end == end and found.closing + found.opening > out[-1].closing + out[-1].opening:
                out[-1] = found
        elif end > 0:
            out.append(found)

    for m in _MARK.finditer(text):
        start, stop = m.span()
        while k < len(inside) and inside[k][1] <= start:
            k += 1
        within = k < len(inside) and inside[k][0] < start and start < inside[k][1]
        if m.lastgroup == "dash" or m.group("dash") is not None:
            add(start, 4.0, 1.0)
            continue
        if m.group("gap") is not None:
            add(start, 2.5, _opening(text, stop, caseless))
            continue
        end = _AFTER.match(text, stop).end()
        # a straight quote after a space opens the next span
        while end > stop and text[end - 1] in "\"“" and _opens(text, end - 1, inside):
            end -= 1
        if end >= len(text):
            continue
        if within and inside[k][1] <= end:
            # a mark before the closing half: the span may end after the quotation
            if not (text[end].isspace()) or _ATTRIBUTES.match(text, end):
                continue
            nxt = _WORD_AFTER.match(text, end).group(1) or ""
            if nxt[:1].islower() or nxt.lower() in GO_ON or text[inside[k][1] - 1] in ")）]】":
                if not (text[inside[k][1] - 1] in ")）" and nxt[:1].isupper()):
                    continue
        follows = text[end]
        if m.group("ellipsis") is not None:
            if _ATTRIBUTES.match(text, end):
                continue
            closing = 3.0 if m.group("more") else 0.3
        elif m.group("full") is not None:
            mark = m.group("full")
            if mark[0] in "!?" and not follows.isspace() and not follows.isupper() and not _WIDE.match(follows) and follows not in "¿¡\"“«-–—":
                continue
            if _ATTRIBUTES.match(text, end) and not _BREAK_AND_DASH.match(text, end) and mark[0] in "!?！？":
                continue
            closing = 3.5
            if mark == "．" and text[stop : stop + 1].isdigit():
                continue
        else:
            closing = _dot(text, start, end, caseless)
            if closing is None:
                continue
        opening = _opening(text, end, caseless)
        add(end, closing, opening if closing < 1.0 or opening is None else max(opening, -1.0))
    return out


def _opens(text: str, at: int, inside: list[tuple[int, int]]) -> bool:
    return any(a == at for a, _ in inside)


def _dot(text: str, start: int, end: int, caseless: bool) -> float | None:
    """How well a single full stop closes a sentence; None if it can't."""
    before, width = _TOKEN_BEFORE.search(text, max(0, start - 40), start).group(), 40
    while len(before) == width < start:  # a longer token
        width *= 2
        before = _TOKEN_BEFORE.search(text, max(0, start - width), start).group()
    after = text[end : end + 1]
    last = text[start - 1 : start]
    if not before and last.isspace():
        before = ""
    low = before.lower().lstrip("-–—'’>")
    if not after.isspace():
        # no space: file names, decimals, hosts, abbreviations; or a sentence that leans on the next
        if end > start + 1 and after:
            return None if after in ",;:)" or after.islower() else 2.0
        if _WIDE.match(last or " ") and _WIDE.match(after):
            return 2.5
        if "_" in before or "/" in before or "@" in before or "." in before.strip("."):
            return None
        nxt = _NEXT_WORD.match(text, end)
        word = nxt.group() if nxt else ""
        if after in "¿¡«“\"„—" and (last.isalpha() or last.isdigit()):
            return 2.0
        if not word:
            return 1.5 if after.isdigit() and last.isalpha() and len(low) > 3 and low not in REFERENCES and low not in INNER else None
        if low in TITLES or low in INNER or low in REFERENCES or len(low) < 2:
            return None
        if text[end + len(word) : end + len(word) + 1] in (".", "_", "/") and len(word) > 2 and not word[0].isupper():
            return None
        if word[0].isupper() and (last.islower() or last.isdigit() or last in "ºª)%"):
            return 2.0
        if word[0].isupper() and last.isupper() and len(low) > 2 and len(word) > 1:
            return 1.5
        if word[0].islower() and last.islower() and len(low) > 2 and text[end + len(word) : end + len(word) + 1] in (" ", ",", "'", "’") and not regex.fullmatch(r"(?:com|org|net|srt|vtt|ass|mkv|mp4|txt|json|md|example|final)", word):
            return 1.0
        if regex.match(r"[\p{Devanagari}\p{Hangul}]", word) and not last.isdigit():
            return 2.0
        return None
    if after and _AFTER.match(text, end).end() != end:
        return None
    if regex.match(r"\s*[,;:)]", text[end : end + 4]):
        return None
    if not low:
        return 2.0 if not last.isspace() else 1.0
    # parts of spaced abbreviations such as "a. m." and "т. д."
    lead = regex.search(r"(?:^|[\s(«“\"„-])(\p{L}{1,2})\.\s?$", text[max(0, start - len(before) - 6) : start - len(before)])
    joined = f"{lead.group(1).lower()}.{low}" if lead and len(low) <= 2 else low
    rest = _NEXT_SIGN.match(text, end).group(1)
    if joined in CLOCK or low in CLOCK:
        return 0.5
    if joined in LISTS or low in LISTS:
        return 1.5
    if joined in INNER or low in INNER and not (low in ("д", "г", "ч") and rest[:1].isupper() and lead):
        return -8.0
    if low in TITLES and not (len(low) == 1 and last.islower()):
        return -8.0
    if low in REFERENCES and rest[:1].isdigit():
        return -8.0
    if len(low) == 1 and regex.match(r"[\p{Latin}\p{Cyrillic}]", low):
        return -6.0  # an initial, or the first part of a spaced abbreviation
    if low in ("n.º", "n.ª", "nº", "núm", "pág", "págs", "стр", "рис", "гл", "abb", "bd", "kap"):
        return -6.0
    if regex.fullmatch(r"\d{1,2}", low):
        lead = regex.search(r"(\p{L}+)\s+$", text[max(0, start - len(before) - 14) : start - len(before)])
        if lead and lead.group(1).lower() in ORDINAL_LEADS and not rest[:1] in "¿¡":
            return -8.0
    return 3.0


def _opening(text: str, at: int, caseless: bool) -> float | None:
    """How well what follows a place opens a sentence; None if a small letter leaves it to the span before."""
    word = _WORD_AFTER.match(text, at).group(1) or ""
    if not word:
        return 0.0
    if text[at:].lstrip().startswith(GO_ON_CJK):
        return -3.0
    if word.lower() in GO_ON:
        # capitals mean a start only where case tells anything
        return -3.0 if caseless or not word[0].isupper() else 0.8
    if caseless or not (word[0].isupper() or word[0].islower()):
        return 0.3
    if word[0].isupper():
        return 1.5
    return None  # the span before tells


def length_score(letters: float) -> float:
    """What a span's length costs: scraps and very long spans are unlikely sentences."""
    if letters < 1:
        return -NO_LETTERS
    if letters < 3:
        return -SCRAP
    return -min(LONGEST, max(0.0, letters - LONG_LETTERS) / LONG_LETTERS)


def _length_scores(letters: np.ndarray) -> np.ndarray:
    long = -np.minimum(LONGEST, np.maximum(0.0, letters - LONG_LETTERS) / LONG_LETTERS)
    return np.where(letters < 1, -NO_LETTERS, np.where(letters < 3, -SCRAP, long))


def choose_spans(text: str, ends: list[Boundary], quotes: Quotes) -> list[int]:
    """Ends of the best sequence of spans of a paragraph, the last its own end.

    A span from point i to point j scores by what opens at i and closes at j,
    its length, an end within a pair of quotes, and halves of pairs in it. Cuts
    at sure boundaries are in every best sequence, so no span need be scored
    that passes over one; that bound is exact.
    """
    if not ends:
        return [len(text)]
    points = [0, *[b.end for b in ends], len(text)]
    n = len(points)
    cut_pair = [0.0] * n
    if quotes.pairs:
        starts = [a for a, _ in quotes.pairs]
        for p in range(1, n - 1):
            k = bisect_left(starts, points[p]) - 1
            if k >= 0 and points[p] < quotes.pairs[k][1]:
                cut_pair[p] = -CUT_PAIR
    opening = [0.0, *[b.opening for b in ends], 0.0]
    closing = [0.0, *[b.closing for b in ends], 0.0]
    opens = [a + b for a, b in zip(opening, cut_pair)]
    closes = [a + b for a, b in zip(closing, cut_pair)]
    # spans that begin with a capital, or with the paragraph, don't end before a small letter so readily
    small = [False, *[b.small for b in ends], False]
    first = SMALL_AFTER_CAPITAL - SMALL_AFTER_SMALL
    capital = [0.0 if (_WORD_AFTER.match(text, p).group(1) or "")[:1].islower() else first for p in points[:-1]] if any(small) else []
    # halves before each point: a span holds those between its two points
    openers = [bisect_left(quotes.openers, p) for p in points]
    closers = [bisect_right(quotes.closers, p) for p in points]
    wide = _WIDE.search(text) is not None
    letters = [0.0] * n
    for j in range(1, n):
        part = text[points[j - 1] : points[j]]
        letters[j] = letters[j - 1] + sum(map(str.isalnum, part)) + (1.5 * len(_WIDE.findall(part)) if wide else 0)
    free = not quotes.openers and not quotes.closers
    best, back, sure = [0.0] + [0.0] * (n - 1), [0] * n, 0
    for j in range(1, n):
        if j - sure < _MANY:
            top = None
            for i in range(sure, j):
                score = best[i] + opens[i] + length_score(letters[j] - letters[i])
                if small[j]:
                    score += capital[i] if i or points[j] > CONTINUED else first
                if not free:
                    score -= STRAY_HALF * ((openers[j] > openers[i] and j < n - 1) + (closers[j] > closers[i] and i > 0))
                if top is None or score > top:
                    top, back[j] = score, i
        else:
            i = slice(sure, j)
            scores = np.array(best[i]) + np.array(opens[i]) + _length_scores(letters[j] - np.array(letters[i]))
            if small[j]:
                scores += np.array(capital[i])
                if not sure and points[j] <= CONTINUED:
                    scores[0] += first - capital[0]
            if not free:
                scores -= STRAY_HALF * ((openers[j] > np.array(openers[i])) & (j < n - 1))
                scores -= STRAY_HALF * ((closers[j] > np.array(closers[i])) & (np.arange(sure, j) > 0))
            k = int(np.argmax(scores))
            top, back[j] = float(scores[k]), sure + k
        best[j] = top + closes[j]
        if closing[j] + opening[j] > SURE and not small[j] and not cut_pair[j] and not openers[j] and closers[j] == len(quotes.closers) and j < n - 1:
            sure = j
    out, j = [], n - 1
    while j:
        out.append(points[j])
        j = back[j]
    return out[::-1]


def sentence_units(text: str | None) -> list[tuple[int, int]]:
    """(start, end) in code points of the units of a text; none for null and blank texts."""
    if not text or text.isspace():
        return []
    out: list[tuple[int, int]] = []
    at = 0
    for m in [*_BLANK.finditer(text), None]:
        stop = m.start() if m else len(text)
        part = text[at:stop]
        begin = 0
        quotes = quotes_of(part)
        for end in choose_spans(part, boundaries(part, quotes), quotes):
            a, b = begin, end
            while a < b and part[a].isspace():
                a += 1
            while b > a and part[b - 1].isspace():
                b -= 1
            if a < b:
                if out and out[-1][1] > at and not any(map(str.isalnum, part[a:b])) and part[a] not in "-–—¿¡“«„「":
                    out[-1] = (out[-1][0], at + b)  # marks alone belong to the unit before
                else:
                    out.append((at + a, at + b))
            begin = end
        at = m.end() if m else stop
    return out


def split_sentences(df: DataFrame, keys: list[str], text_column: str = "text") -> DataFrame:
    """Columns (keys..., char_start, char_end): one row per sentence unit of each row's text.

    Places count code points from 0, ends are exclusive. Null and blank texts
    give no rows; repeated rows repeat; null keys stay null; other columns are
    ignored; an empty table gives no rows. Texts are read whole, in one pass.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    rows = df.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{text_column}`").alias("_text")).where("length(trim(_text)) > 0")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, starts, ends = [], [], []
            for i, text in enumerate(batch.column(len(keys)).to_pylist()):
                for a, b in sentence_units(text):
                    at.append(i)
                    starts.append(a)
                    ends.append(b)
            index = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(index) for k in range(len(keys))], pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=[*keys, "char_start", "char_end"])

    return rows.mapInArrow(split, ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "char_start int, char_end int"]))
