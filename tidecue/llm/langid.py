"""Language of documents, transcripts and their foreign pieces by compression.

Each language has a raw-content dictionary of its own sentences. A text is
compressed with every dictionary; the smallest result names the language, and a
narrow margin over the next names none. Dictionaries that share no four bytes
with a text can't help to compress it, as that is the least match; they all give
the size that a dictionary of foreign bytes gives, which is measured once. Texts
are measured many at a time, one dictionary after the other, so that a dictionary
stays in the processor's cache. The dictionaries come from a bounded
sample of labelled documents; as labels may be wrong, paragraphs whose words
speak for another label are left out, and so are labels whose paragraphs can't
be told from another's: such a label says nothing of a text and is treated like
a missing one.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecue.functions.text import strip
from tidecue.llm.mojibake import CHAINS, restore
from tidecue.llm.residue import has_placeholder, is_only_residue
from tidecue.session import cut, spread

#: Bounds of the fit: documents per label, their length, bytes of a dictionary.
SAMPLE_PER_LABEL = 300
SAMPLE_CHARS = (100, 8_000)
DICTIONARY_BYTES = 96_000
LEVEL = 2
#: Share of a label's paragraphs that must speak for it and not for a second label.
DISTINCT = 0.7

#: Bytes by which a language must win before it contradicts a label or its surroundings.
MARGIN = 8
SHARE = 0.08
#: Margin that is enough for texts of any length.
ENOUGH = 32
#: Documents measured together.
AT_ONCE = 250

BLANK_LINES = re.compile(r"(?:\r\n|\r|\n)(?:[^\S\r\n]*(?:\r\n|\r|\n))+")
_SENTENCE = re.compile(r"(?<=[.!?。！？।])\s*")
_STRUCTURE = re.compile(r"^(?:﻿?WEBVTT.*|\s*\d+\s*|.*-->.*|#+ .*)$", re.M)
_NOISE = re.compile(r"<[^<>\n]{1,60}>|\{\\[^{}]*\}|\[[^\[\]\n]{1,30}\]")
_LINK = re.compile(r"\S*(?:://|\.example)\S*")
_DIGITS = re.compile("[0-9]+")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_LETTER = re.compile(r"[^\W\d_]")
_LETTERS = re.compile(r"[^\W\d_]+")
_LATIN = re.compile(r"[A-Za-z\u00c0-\u024f]+")

def plain(text: str) -> str:
    """What of a text speaks for its language: no markup, numbers, links, headings and letter case."""
    if "-->" in text or "#" in text or "WEBVTT" in text:
        text = _STRUCTURE.sub(" ", text)
    if "://" in text or ".example" in text:
        text = _LINK.sub(" ", text)
    if "<" in text or "[" in text or "{" in text:
        text = _NOISE.sub(" ", text)
    return " ".join(_DIGITS.sub(" ", text).lower().split())


class LanguageModel:
    """Dictionaries by language and the sizes they give."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.codes = sorted(dictionaries)
        self.dictionaries = dictionaries = {code: dictionaries[code] for code in self.codes}
        # the bytes that begin characters beyond ASCII, and whether four bytes in a row begin none
        self._leads = [frozenset(content.translate(None, _NOT_LEADS)) for content in dictionaries.values()]
        self._open = [bool(_LEADLESS.search(content)) for content in dictionaries.values()]
        self._bare = [not content.translate(None, _BARE) for content in dictionaries.values()]
        self._fours = [_own_fours(content) if bare else set() for content, bare in zip(dictionaries.values(), self._bare)]
        self._compress = None
        self._sharing: dict[tuple[frozenset[int], bool], tuple[tuple[int, ...], tuple[int, ...]]] = {}

    def __reduce__(self):
        return LanguageModel, (self.dictionaries,)

    def sizes(self, text: str) -> list[int] | None:
        """Compressed size by language, in the order of codes; None for a text without letters."""
        return self.all_sizes([text])[0]

    def all_sizes(self, texts: list[str]) -> list[list[int] | None]:
        """sizes() of each text; equal texts are measured once."""
        if self._compress is None:
            # of one length, as zstandard's parameters depend on it
            size = max(map(len, self.dictionaries.values()))
            *own, foreign = _compressors((*(foreign_bytes(size - len(c)) + c for c in self.dictionaries.values()), foreign_bytes(size)))
            self._compress, self._foreign = [c.compress for c in own], foreign.compress
        distinct = [text for text in dict.fromkeys(texts) if _LETTER.search(text)]
        raws = [text.encode("utf-8") for text in distinct]
        groups: dict[tuple[int, ...], list[int]] = defaultdict(list)
        for k, raw in enumerate(raws):
            groups[self.sharing(raw)].append(k)
        foreign = [0] * len(raws)
        for sharing, own in groups.items():
            for k in own if len(sharing) < len(self.codes) else ():
                foreign[k] = len(self._foreign(raws[k]))
        columns = []
        for i, compress in enumerate(self._compress):
            column = foreign.copy()
            for sharing, own in groups.items():
                for k in own if i in sharing else ():
                    column[k] = len(compress(raws[k]))
            columns.append(column)
        found = dict(zip(distinct, map(list, zip(*columns))))
        return [found.get(text) for text in texts]

    def sharing(self, raw: bytes) -> tuple[int, ...]:
        """The dictionaries that may share four bytes with a text.

        Four bytes in common either hold the first byte of a character beyond
        ASCII, which both have then, or none, which both have then too. Where a
        text mostly in ASCII meets a dictionary without any but blanks, they can
        only lie in the text's stretches of such bytes, and are looked up.
        """
        leads, leadless = frozenset(raw.translate(None, _NOT_LEADS)), bool(_LEADLESS.search(raw))
        found = self._sharing.get((leads, leadless))
        if found is None:
            if len(self._sharing) > 10_000:
                self._sharing.clear()
            may = tuple(i for i, own in enumerate(self._leads) if leads & own or leadless and self._open[i])
            found = self._sharing[leads, leadless] = may, tuple(i for i in may if not self._bare[i])
        may, rest = found
        if len(may) == len(rest) or not leadless:
            return may
        stretches = _BARE_STRETCH.findall(raw)
        if not stretches:
            return rest
        if 2 * sum(map(len, stretches)) > len(raw):
            return may
        own = fours(*stretches)
        return tuple(i for i in may if not self._bare[i] or not own.isdisjoint(self._fours[i]))

    def best(self, sizes: list[int]) -> tuple[str, int, int]:
        """(code, its size, margin to the next)."""
        size = min(sizes)
        at = sizes.index(size)
        others = sizes[:at] + sizes[at + 1 :]
        return self.codes[at], size, min(others) - size if others else size


def foreign_bytes(n: int) -> bytes:
    """Bytes that no text holds."""
    return bytes(random.Random(1).choices(range(0xF8, 0x100), k=n))


_NOT_LEADS = bytes(range(0xC0))
_LEADLESS = re.compile(rb"[\x00-\xbf]{4}")
#: Blanks and what characters beyond ASCII consist of.
_BARE = bytes([0x20, *range(0x80, 0x100)])
_BARE_STRETCH = re.compile(rb"[\x20\x80-\xff]{4,}")


def fours(*contents: bytes) -> set[bytes]:
    """All that stands in four bytes in a row."""
    return {content[i : i + 4] for content in contents for i in range(len(content) - 3)}


def own_letters(content: str) -> str:
    """A dictionary's text; where its language isn't written in Latin letters, without other scripts' letters and rare signs.

    They say nothing for the language, and without them most texts of other
    scripts share no four bytes with it.
    """
    latin = sum(map(len, _LATIN.findall(content)))
    if latin * 2 > sum(map(len, _LETTERS.findall(content))):
        return content
    bare = re.sub(r"[\x00-\x7f]+|[\U00010000-\U0010ffff]", " ", content)
    first = Counter(ch.encode("utf-8")[0] for ch in bare if ch > "\x7f")
    rare = {lead for lead, n in first.items() if n < 0.01 * sum(first.values())}
    return re.sub(" +", " ", "".join(" " if ch > "\x7f" and ch.encode("utf-8")[0] in rare else ch for ch in bare))


@lru_cache(maxsize=32)
def _own_fours(dictionary: bytes) -> set[bytes]:
    return fours(dictionary)


@lru_cache(maxsize=2)
def _compressors(dictionaries: tuple[bytes, ...]) -> list:
    import zstandard

    out = []
    for content in dictionaries:
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
    return out


def label_code(label: str | None, aliases: dict[str, str]) -> str | None:
    """The profile that a label names: by its alias, else by that of its part before the first hyphen."""
    if label is None or not label.strip():
        return None
    key = label.strip().lower()
    return aliases.get(key) or aliases.get(key.split("-", 1)[0].strip())


def alias_table(spark: SparkSession, aliases: DataFrame) -> dict[str, str]:
    """Alias to code; the table is fixed at a few dozen rows."""
    return {r.alias.strip().lower(): r.code for r in aliases.select("alias", "code").collect() if r.alias}


def _words(text: str) -> list[str]:
    if _CJK.search(text):
        return [text[i : i + 2] for i in range(len(text) - 1) if _CJK.match(text[i]) and _CJK.match(text[i + 1])]
    return _LETTERS.findall(text)


def fit_dictionaries(samples: dict[str, list[str]], population: dict[str, int] | None = None, seed: int = 7) -> dict[str, bytes]:
    """Raw-content dictionaries from texts by label, some of them labelled wrongly.

    Word counts by label judge each paragraph, its own words left out; those
    that speak for another label are dropped. Where a label's paragraphs hardly
    speak for it rather than for a second one, both name one language, and the
    rarer label (by population, the number of texts it stands on) gets no
    dictionary.
    """
    paragraphs = {code: [p for t in texts for p in map(plain, BLANK_LINES.split(t)) if len(p) > (12 if _CJK.search(p) else 40)] for code, texts in samples.items()}
    paragraphs = {code: ps for code, ps in paragraphs.items() if ps}
    counts = {code: Counter(w for p in ps for w in set(_words(p))) for code, ps in paragraphs.items()}
    totals = {code: len(ps) for code, ps in paragraphs.items()}
    population = population or totals
    kept: dict[str, list[str]] = defaultdict(list)
    spoken: dict[str, Counter] = {}
    for code, ps in paragraphs.items():
        spoken[code] = Counter()
        for p in ps:
            words = set(_words(p))
            score = {c: sum(math.log((counts[c][w] - own + 0.02) / (totals[c] - own + 1)) for w in words) for c in counts for own in (int(c == code),)}
            best = max(score, key=score.get) if words else None
            spoken[code][best] += 1
            if best == code:
                kept[code].append(p)
    gone = set()
    for code in spoken:
        for other, n in spoken[code].items():
            if other not in (None, code) and spoken[code][code] < DISTINCT * (spoken[code][code] + n):
                gone.add(min((code, other), key=lambda c: (population.get(c, 0), c)))
    out = {}
    for code in sorted(kept.keys() - gone):
        rng, seen, content = random.Random(seed), set(), []
        sentences = [s for p in kept[code] for s in _SENTENCE.split(p) if len(s) > 3]
        rng.shuffle(sentences)
        size = 0
        for s in sentences:
            if s not in seen:
                seen.add(s)
                content.append(s)
                size += len(s.encode()) + 1
                if size >= DICTIONARY_BYTES:
                    break
        out[code] = own_letters(" ".join(content)).encode("utf-8")
    return out


def fit_model(spark: SparkSession, documents: DataFrame, aliases: dict[str, str], per_label: int = SAMPLE_PER_LABEL) -> LanguageModel:
    """The model of a bounded sample of labelled documents, drawn by a hash of their ids.

    At most about per_label documents of a label, within SAMPLE_CHARS, come to
    the driver; classification itself reads every text whole.
    """
    label = F.lower(F.trim("lang"))
    labelled = documents.where(F.col("lang").isNotNull())
    rows = labelled.where(F.length("text").between(*SAMPLE_CHARS))
    # one row per spelling that names a profile by its alias, or by its part before the first hyphen
    named = F.coalesce(*[F.when(x.isin(*aliases), x) for x in (label, strip(F.substring_index(label, "-", 1)))]) if aliases else F.lit(None).cast("string")
    counts = {r.label: r["count"] for r in labelled.groupBy(named.alias("label")).count().where("label is not null").collect()}
    per_code: dict[str, int] = defaultdict(int)
    for name, n in counts.items():
        per_code[label_code(name, aliases)] += n
    if not per_code:
        return LanguageModel({})
    shares = F.create_map(*[x for name in counts for x in (F.lit(name), F.lit(min(1.0, per_label / per_code[label_code(name, aliases)])))])
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < shares[named] * 1_000_000
    samples: dict[str, list[str]] = defaultdict(list)
    for r in rows.where(named.isNotNull() & drawn).select("lang", "text", "doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id").collect():
        samples[label_code(r.lang, aliases)].append(r.text)
    return LanguageModel(fit_dictionaries(samples, per_code))


def read_sizes(model: LanguageModel, texts: list[str]) -> list[list[int] | None]:
    """Sizes of texts; those that no dictionary fits are tried again as wrongly decoded text."""
    bodies = list(map(plain, texts))
    return [sizes if sizes is None or body.isascii() else _read_again(model, text, body, sizes) for text, body, sizes in zip(texts, bodies, model.all_sizes(bodies))]


def _read_again(model: LanguageModel, text: str, body: str, sizes: list[int]) -> list[int] | None:
    strange = len(body) - len(body.encode("ascii", "ignore"))
    if strange * 3 > len(body) >= 8:
        raw = len(body.encode("utf-8"))
        beyond = _BEYOND_LATIN.search(text)
        if not beyond or min(sizes) > 0.7 * raw and _MIXED_CYRILLIC.search(text):
            for chain in _GARBLES:
                back = restore(text, chain)
                if back is not None and back != text:
                    again = model.sizes(plain(back))
                    if again is not None and min(again) < 0.8 * min(sizes):
                        return again
            if not beyond:
                return None  # no text in Latin letters has so many beyond ASCII
    return sizes


#: Letter case turned about, or marks among Cyrillic letters, as wrong decoding leaves them.
_MIXED_CYRILLIC = re.compile("[\u0430-\u045f][\u0400-\u042f]|[\u0400-\u04ff][\u00a0-\u00bf\u2010-\u25ff][\u0400-\u04ff]")
_BEYOND_LATIN = re.compile("[\u0400-\u1fff\u3000-\uffef]")
_GARBLES = tuple(dict.fromkeys(f"{source}>{reader}" for chains in CHAINS.values() for source, readers in chains.items() for reader in readers if reader not in ("ascii", "utf-8")))


def sure(margin: int, size: int, enough: float = float("inf")) -> bool:
    """Whether a margin over another language tells, beside the size; `enough` always does."""
    return margin >= MARGIN and margin >= min(enough, SHARE * size)


def document_languages(df: DataFrame, model: LanguageModel, aliases: dict[str, str]) -> DataFrame:
    """Columns (doc_id, para_no, code, confidence, case).

    para_no 0 is the whole document with its main language, others the
    paragraphs (from 1, divided by blank lines) in another language. A main
    language by a narrow margin is null. case is True where it is told and the
    document's `lang` names no profile or another one, and for each foreign
    paragraph. Null and blank texts and such that are nothing but
    residue give no row, nor do texts without letters; an empty table gives
    none. Repeated rows repeat; a null id stays null; other columns are ignored.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = ([], [], [], [], [])
            for start in range(0, len(batch), AT_ONCE):
                docs, labels, texts = (c.to_pylist() for c in batch.slice(start, AT_ONCE).columns)
                for doc, found in zip(docs, judge_documents(model, texts, [label_code(label, aliases) for label in labels])):
                    for no, code, confidence, case in found:
                        for column, value in zip(out, (doc, no, code, confidence, case)):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.string()), pa.array(out[3], pa.float64()), pa.array(out[4], pa.bool_())], names=["doc_id", "para_no", "code", "confidence", "case"])

    rows = df.select(F.col("doc_id").cast("long"), "lang", "text").where("length(trim(text)) > 0")
    return spread(rows).mapInArrow(judge, "doc_id long, para_no int, code string, confidence double, case boolean")


def judge_document(model: LanguageModel, text: str, label: str | None) -> list[tuple[int, str, float, bool]]:
    """(paragraph, code, confidence, case) of a document's main language and foreign paragraphs."""
    return judge_documents(model, [text], [label])[0]


def judge_documents(model: LanguageModel, texts: list[str], labels: list[str | None]) -> list[list[tuple[int, str, float, bool]]]:
    """judge_document() of each text; all paragraphs are measured together."""
    if not model.codes:
        return [[] for _ in texts]
    parts = [[part for part in BLANK_LINES.split(text) if part.strip()] if not text.isspace() and not is_only_residue(text) else [] for text in texts]
    sizes = iter(read_sizes(model, [part for own in parts for part in own]))
    return [_judge(model, [(no, part, s) for no, part in enumerate(own, 1) if (s := next(sizes)) is not None], label) for own, label in zip(parts, labels)]


def _judge(model: LanguageModel, pieces: list[tuple[int, str, list[int]]], label: str | None) -> list[tuple[int, str, float, bool]]:
    if not pieces:
        return []
    total = [sum(column) for column in zip(*(s for _, _, s in pieces))]
    code, size, margin = model.best(total)
    at = model.codes.index(code)
    told = sure(margin, size, ENOUGH)
    # a label that no dictionary stands for is as good as none
    gap = total[model.codes.index(label)] - size if label in model.codes else margin
    case = label != code and told and sure(gap, size, ENOUGH)
    out = [(0, code if told else None, round(1 - size / (size + margin), 4), case)]
    for no, part, sizes in pieces:
        least = min(sizes)
        if sure(sizes[at] - least, least) and not is_only_residue(part):
            out.append((no, model.codes[sizes.index(least)], round(1 - least / sizes[at], 4), True))
    return out


def segment_sizes(df: DataFrame, model: LanguageModel) -> DataFrame:
    """(segment_id, transcript_id, part, s0, s1, ...): sizes of each segment's text by language, and whether a placeholder stands in it.

    Segments that are nothing but residue, and texts without letters, are left out.
    """
    names = [f"s{i}" for i in range(len(model.codes))]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found, part = [], [], []
            asked = [(i, text) for i, text in enumerate(batch.column(2).to_pylist()) if not is_only_residue(text)]
            for (i, text), sizes in zip(asked, read_sizes(model, [text for _, text in asked])):
                if sizes is not None:
                    at.append(i)
                    found.append(sizes)
                    part.append(has_placeholder(text))
            keep = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep), pa.array(part, pa.bool_()), *[pa.array(c, pa.int32()) for c in (zip(*found) if found else [[]] * len(names))]], names=["segment_id", "transcript_id", "part", *names])

    rows = df.select(F.col("segment_id").cast("long"), F.col("transcript_id").cast("long"), "text").where("length(trim(text)) > 0")
    return spread(rows).mapInArrow(measure, ", ".join(["segment_id long, transcript_id long, part boolean", *[f"{n} int" for n in names]]))


def transcript_languages(segments: DataFrame, transcripts: DataFrame, model: LanguageModel, aliases: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(transcripts, foreign segments), each (id, code, confidence, case).

    A transcript's main language has the least total size over its segments,
    summed before the shuffle, so a transcript may hold any share of them; by a
    narrow margin it is null. Its case says that it is told and that
    detected_language names no profile or another one. The
    second frame has a row for each segment in another language than its
    transcript's, but for such with residue. Transcripts without any text give no row. Rows delivered
    again count once; null transcript ids are left out.
    """
    names = [f"s{i}" for i in range(len(model.codes))]
    if not names:
        empty = segments.sparkSession.createDataFrame([], "id long, code string, confidence double, case boolean")
        return empty, empty
    sized = segment_sizes(segments.where("transcript_id is not null"), model)
    # both uses below read the sizes: they are measured once
    once = cut(sized.dropDuplicates(["segment_id"]))
    totals = once.groupBy("transcript_id").agg(*[F.sum(n).alias(n) for n in names])
    arranged = lambda prefix="": F.array_sort(F.array(*[F.struct(F.col(prefix + n).cast("long").alias("size"), F.lit(c).alias("code")) for n, c in zip(names, model.codes)]))
    main = totals.withColumn("order", arranged()).select("transcript_id", F.col("order")[0]["code"].alias("code"), F.col("order")[0]["size"].alias("size"), F.col("order")[1 if len(names) > 1 else 0]["size"].alias("second"), *names)
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]) if aliases else F.create_map().cast("map<string,string>")
    key = strip(F.lower("label"))
    headers = transcripts.groupBy("transcript_id").agg(F.first("detected_language").alias("label"))
    named = headers.select(F.col("transcript_id").alias("tid"), F.coalesce(F.try_element_at(table, key), F.try_element_at(table, strip(F.substring_index(key, "-", 1)))).alias("named"))
    of_named = F.coalesce(*[F.when(F.col("named") == c, F.col(n)) for n, c in zip(names, model.codes)])
    wide = lambda gap: gap >= F.greatest(F.lit(MARGIN), F.least(F.lit(ENOUGH), SHARE * F.col("size")))
    told = wide(F.col("second") - F.col("size"))
    # a label that no dictionary stands for is as good as none
    contradicts = told & ~F.col("named").eqNullSafe(F.col("code")) & (of_named.isNull() | wide(of_named - F.col("size")))
    whole = main.join(named, F.col("transcript_id") == F.col("tid")).select(F.col("transcript_id").alias("id"), F.when(told, F.col("code")).alias("code"), F.round(1 - F.col("size") / F.greatest("second", F.lit(1)), 4).alias("confidence"), contradicts.alias("case"))
    pieces = once.join(main.select("transcript_id", F.col("code").alias("main")), "transcript_id").withColumn("order", arranged())
    of_main = F.coalesce(*[F.when(F.col("main") == c, F.col(n)) for n, c in zip(names, model.codes)])
    gap, least = of_main - F.col("order")[0]["size"], F.col("order")[0]["size"]
    foreign = pieces.where(~F.col("part") & (F.col("order")[0]["code"] != F.col("main")) & (gap >= MARGIN) & (gap >= SHARE * least)).select(
        F.col("segment_id").alias("id"), F.col("order")[0]["code"].alias("code"), F.round(1 - least / F.greatest(of_main, F.lit(1)), 4).alias("confidence"), F.lit(True).alias("case")
    )
    return whole, foreign
