"""Cutting oversized texts into overlapping pieces at natural boundaries.

A rolling hash over the last tokens sets landmarks that depend on the content
alone. A piece ends at a natural boundary near the first landmark beyond its
least size, so an edit moves only the cuts about it; where no landmark lies in
reach the last best boundary, and at last any place between two characters, is
taken. A text is encoded once for each tokenizer: the ids of a piece are those
between its ends, and only a piece for which the pattern leaves that open is
encoded by itself.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecue.llm.vocab import DEFAULT_FOLDER, byte_lengths, encoder, keeps_ids, token_ids
from tidecue.session import spread

#: Tokens a landmark depends on.
HASH_WIDTH = 12

#: Tokens of one character at most, and so kept free where an overlap may begin before one.
CHARACTER_TOKENS = 4

PARAGRAPH, SENTENCE, SPACE = 3, 2, 1
_PARAGRAPH = re.compile(r"\r?\n[^\S\n]*\r?\n")
_SENTENCE = re.compile(r"[.!?。！？।॥…]+[\"'”’»」』）)\]]*(?=\s|$)|[。！？।॥]+[”’」』）]*")
#: Whether a code point is white space; the last entry stands for all beyond.
_WHITE = np.zeros(12_290, dtype=bool)
_WHITE[[i for i in range(12_289) if chr(i).isspace()]] = True


@lru_cache(maxsize=4)
def _gear(size: int) -> np.ndarray:
    """A fixed pseudo-random number for each token id (splitmix of the id)."""
    x = (np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling_hash(ids: np.ndarray) -> np.ndarray:
    """After each token, a hash of it and the HASH_WIDTH - 1 tokens before it (fewer at the start)."""

    def widened(total: np.ndarray, other: np.ndarray, by: int) -> np.ndarray:
        out = total.copy()
        out[by:] += other[:-by] << np.uint64(by) if by < len(other) else 0
        return out

    # sums over 2, 4, 8 and 12 tokens, each from shorter ones
    two = widened(one := _gear(1 << 17)[ids], one, 1)
    four = widened(two, two, 2)
    total = widened(widened(four, four, 4), four, 8)
    total ^= total >> np.uint64(32)
    total *= np.uint64(0xD6E8FEB86659FD93)
    return total >> np.uint64(40)


class Places:
    """The places between a text's characters: their byte offsets and how natural a cut is there."""

    def __init__(self, text: str):
        points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        self.text, self.starts = text, np.zeros(len(points) + 1, dtype=np.int64)
        np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF), out=self.starts[1:])
        white = _WHITE[np.minimum(points, len(_WHITE) - 1)]
        self.level = np.zeros(len(points) + 1, dtype=np.int8)
        self.level[1:-1][white[1:] & ~white[:-1]] = SPACE
        self.level[[m.end() for m in _SENTENCE.finditer(text)]] = SENTENCE
        if "\n" in text:
            self.level[[m.start() for m in _PARAGRAPH.finditer(text)]] = PARAGRAPH


class Encoded:
    """A text's tokens, and the places among them at which characters end."""

    def __init__(self, places: Places, ids: np.ndarray, enc):
        self.text, self.enc, self.n = places.text, enc, len(ids)
        ends = np.cumsum(byte_lengths(enc)[ids])
        at = np.searchsorted(places.starts, ends)
        whole = places.starts[at] == ends
        level = np.where(whole, places.level[at], -1)
        #: Character at which the text goes on after k tokens, for the k at which a character ends.
        self.char = np.append(0, at).tolist()
        #: Numbers of tokens after which a character ends, and those of each level or better.
        self.places = {value: (np.flatnonzero(level >= value) + 1).tolist() for value in (0, SPACE, SENTENCE, PARAGRAPH)}
        self.places[0].insert(0, 0)
        self.hashes = rolling_hash(ids)

    def landmarks(self, spacing: int) -> list[int]:
        """Numbers of tokens after which a landmark stands, one in `spacing` of all."""
        return (np.flatnonzero(self.hashes % np.uint64(max(1, spacing)) == 0) + 1).tolist()

    def before(self, k: int) -> int:
        """The last place between characters at or before k tokens."""
        return self.places[0][bisect_right(self.places[0], k) - 1]

    def tokens(self, start: int, end: int) -> int:
        """Number of tokens of the text between two places."""
        a, b = self.char[start], self.char[end]
        return end - start if keeps_ids(self.text, a, b) else len(self.enc.encode_ordinary(self.text[a:b]))


def next_cut(encoded: Encoded, marks: list[int], least: int, most: int) -> int:
    """Where a piece ends that must hold at least `least` and at most `most` of the text's tokens.

    At the first landmark: the nearest paragraph end within an eighth of the
    window, else the nearest sentence end in the window, else the nearest
    space. Without one: the last paragraph end, sentence end, space or place
    between characters of the window. If there is none of them either, the last
    place before it.
    """
    mark = bisect_left(marks, least)
    near = marks[mark] if mark < len(marks) and marks[mark] <= most else None
    reach = max(1, (most - least) // 4)
    for level in (PARAGRAPH, SENTENCE, SPACE, 0):
        places = encoded.places[level]
        i, j = bisect_left(places, least), bisect_right(places, most)
        if i == j:
            continue
        if near is None or level == 0:
            return places[j - 1]
        k = bisect_left(places, near, i, j)
        best = min(places[max(i, k - 1) : min(j, k + 1)], key=lambda p: abs(p - near))
        if level != PARAGRAPH or abs(best - near) <= reach:
            return best
    return encoded.before(least)


def split_ids(encoded: Encoded, limit: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """(char start, char end, tokens, overlapping tokens) of the pieces of a text above the limit."""
    marks = encoded.landmarks((limit - overlap) // 4)
    out: list[tuple[int, int, int, int]] = []
    begin = 0  # where content not yet in a piece begins
    while begin < encoded.n:
        start = encoded.before(max(0, begin - overlap)) if begin else 0
        most = start + limit
        end = encoded.n if most >= encoded.n else next_cut(encoded, marks, begin + max(1, (most - begin) // 2), most)
        if end <= begin:
            end = encoded.places[0][bisect_right(encoded.places[0], begin)]
        size = encoded.tokens(start, end)
        while size > limit:  # cut where the pattern parts differently: the rest goes on to the next piece
            least = encoded.places[0][bisect_right(encoded.places[0], begin)]
            if end == least:  # one new character: less of the text before it
                start = encoded.places[0][bisect_right(encoded.places[0], start)]
            end = max(encoded.before(end - 1), least)
            size = encoded.tokens(start, end)
        out.append((encoded.char[start], encoded.char[end], size, begin - start))
        begin = end
    return out


def check_budget(limit: int, overlap: int) -> None:
    """Refuse budgets that leave no room for a new character in each piece."""
    if not 0 <= overlap <= limit - 2 * CHARACTER_TOKENS + 1 and not (overlap == 0 and limit >= CHARACTER_TOKENS):
        raise ValueError(f"max_tokens {limit} and overlap_tokens {overlap} leave no room for a character")


def split_text(text: str, limit: int, overlap: int, enc) -> list[tuple[int, int, int, int]]:
    """(char start, char end, tokens, overlapping tokens) of the pieces of a text; one piece if it is within the limit."""
    check_budget(limit, overlap)
    ids = token_ids(enc, text)
    return [(0, len(text), len(ids), 0)] if len(ids) <= limit else split_ids(Encoded(Places(text), ids, enc), limit, overlap)


def split_documents(df: DataFrame, budgets: list[tuple[int, str, int, int]], id_column: str = "doc_id", text_column: str = "text", folder: str = DEFAULT_FOLDER, keep_whole: bool = False) -> DataFrame:
    """Columns (budget_id, id, piece_no, char_start, char_end, tokens, overlap_tokens, text).

    budgets are (budget_id, tokenizer, max_tokens, overlap_tokens); one that
    leaves no room for a character beside the overlap is an error. Each piece
    holds at most max_tokens; from the second on, a piece begins overlap_tokens
    before the end of the one before it (a few more where that place is within a
    character). The pieces cover the whole text. Texts within the limit give
    no row, or one row if keep_whole; empty and null texts give none. Repeated
    rows are cut each for itself, null ids stay null, other columns are
    ignored, an empty table gives no rows.
    """
    for _, _, limit, overlap in budgets:
        check_budget(limit, overlap)
    kind = df.schema[id_column].dataType.simpleString()
    rows = df.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text")).where("length(text) > 0")
    if not keep_whole and budgets:  # a token holds at least a byte
        rows = rows.where(F.octet_length("text") > min(limit for _, _, limit, _ in budgets))
    by_tokenizer: dict[str, list[tuple[int, int, int]]] = {}
    for b, name, limit, overlap in budgets:
        by_tokenizer.setdefault(name, []).append((b, limit, overlap))
    names = ["budget_id", "id", "piece_no", "char_start", "char_end", "tokens", "overlap_tokens", "text"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            found, at = [], []
            for i, text in enumerate(texts):
                size, places = len(text.encode("utf-8")), None
                for name, own in by_tokenizer.items():
                    if not keep_whole and size <= min(limit for _, limit, _ in own):
                        continue
                    enc = encoder(name, folder)
                    tokens, encoded = token_ids(enc, text), None
                    for b, limit, overlap in own:
                        if len(tokens) > limit:
                            places = places or Places(text)
                            encoded = encoded or Encoded(places, tokens, enc)
                            cut = split_ids(encoded, limit, overlap)
                        elif keep_whole:
                            cut = [(0, len(text), len(tokens), 0)]
                        else:
                            continue
                        found += [(b, no, *p, text[p[0] : p[1]]) for no, p in enumerate(cut)]
                        at += [i] * len(cut)
            if found:
                b, no, start, end, size, over, text = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), ids.take(pa.array(at)), *[pa.array(x, pa.int32()) for x in (no, start, end, size, over)], pa.array(text, pa.string())], names=names)

    out = spread(rows).mapInArrow(pieces, f"budget_id int, id {kind}, piece_no int, char_start int, char_end int, tokens int, overlap_tokens int, text string")
    return out.withColumnRenamed("id", id_column)
