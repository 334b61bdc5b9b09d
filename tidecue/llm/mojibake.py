"""Text that was decoded with the wrong character encoding.

The clean words of the corpus are garbled under every chain of encodings that
suits their script; that table is hash-joined with the corpus's own tokens. A
token that equals a garbled form of a word, and that no language would write,
is garbled however common it is; so are its other letter cases. Other tokens
must be rarer than the word and no word in another letter case. Scripts written without spaces give
pairs of characters as words, and tokens that look like decoded multi-byte text
give all their windows of the lengths such pairs take.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecue.session import cut, spread

#: Chains of each script: encoding the text had, and encodings it was read in.
_SINGLE = ("cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "mac_roman", "koi8-r", "cp866", "iso8859-15")
CHAINS: dict[str, dict[str, tuple[str, ...]]] = {
    "latin": {
        "utf-8": (*_SINGLE, "gbk"),
        "cp1252": ("cp1251", "cp1250", "cp437", "cp850", "mac_roman", "koi8-r", "cp866", "iso8859-5", "cp1253", "utf-8", "ascii"),
        "mac_roman": ("cp1252", "latin-1"),
        "cp850": ("cp1252", "latin-1"),
        "cp437": ("cp1252", "latin-1"),
    },
    "cyrillic": {
        "utf-8": (*_SINGLE, "mac_cyrillic", "iso8859-5", "gbk"),
        "cp1251": ("cp1252", "latin-1", "koi8-r", "cp866", "cp437", "cp850", "mac_roman", "mac_cyrillic", "iso8859-5", "utf-8"),
        "koi8-r": ("cp1251", "cp1252", "latin-1", "cp866", "cp437", "cp850", "mac_roman", "iso8859-5", "utf-8"),
        "cp866": ("cp1251", "cp1252", "latin-1", "koi8-r", "cp437", "cp850", "mac_roman", "utf-8"),
        "iso8859-5": ("cp1251", "cp1252", "latin-1", "koi8-r", "utf-8"),
        "mac_cyrillic": ("cp1251", "cp1252", "latin-1"),
    },
    "indic": {"utf-8": (*_SINGLE, "gbk")},
    "hangul": {"utf-8": (*_SINGLE, "gbk"), "cp949": ("cp1252", "latin-1", "cp1251", "cp437", "cp850", "mac_roman", "gbk")},
    "chinese": {"utf-8": (*_SINGLE, "gbk"), "gb18030": ("cp1252", "latin-1", "cp1251", "cp437", "cp850", "mac_roman", "koi8-r", "cp1250"), "big5": ("cp1252", "latin-1")},
    "japanese": {"utf-8": (*_SINGLE, "gbk"), "cp932": ("cp1252", "latin-1", "cp1251", "cp437", "cp850", "mac_roman"), "euc_jp": ("cp1252", "latin-1", "cp1251", "cp437", "cp850", "mac_roman")},
}
#: Readers that also occur twice and three times over UTF-8.
_TWICE = ("cp1252", "latin-1")

#: Lengths that garbled pairs of characters take: two bytes each, three bytes each, three bytes read twice.
WINDOWS = (4, 6, *range(10, 19))

_SCRIPT = (
    ("japanese", re.compile(r"^[\u3040-\u30ff\u3400-\u9fff\u3000-\u303f\uff00-\uffef…—“”‘’々]+$")),
    ("cyrillic", re.compile(r"^[\u0400-\u04ff«»„“”‘’…—–№\-.,!?:;()\"']*[\u0400-\u04ff][\u0400-\u04ff«»„“”‘’…—–№\-.,!?:;()\"']*$")),
    ("indic", re.compile(r"^[\u0900-\u0d7f«»“”‘’…—–\-.,!?|\"'\u200c\u200d]*[\u0900-\u0d7f][\u0900-\u0d7f«»“”‘’…—–\-.,!?|\"'\u200c\u200d]*$")),
    ("hangul", re.compile(r"^[\uac00-\ud7a3\u1100-\u11ff0-9A-Za-z“”‘’…—.,!?\"'「」]*[\uac00-\ud7a3][\uac00-\ud7a3\u1100-\u11ff0-9A-Za-z“”‘’…—.,!?\"'「」]*$")),
    ("latin", re.compile(r"^[A-Za-z\u00c0-\u017f¿¡«»„“”‘’…—–ºª°€™½\-.,!?:;()/&\"'0-9]*$")),
)
_IDEOGRAPH = re.compile("[\u3040-\u30ff\u3400-\u9fff]")
_KANA = re.compile(r"[\u3040-\u30ff]")
_PAIR = re.compile(r"(?=([\u3040-\u30ff\u3400-\u9fff々、。！？，：「」（）“”…]{2}))")
_LOST = re.compile("[\u0080-\u009f\u00a0\u00ad]")


@lru_cache(maxsize=None)
def _reader(name: str) -> dict[int, str]:
    """What each byte becomes in a one-byte encoding; bytes it lacks become control characters."""
    out = {}
    for b in range(256):
        try:
            out[b] = bytes([b]).decode(name)
        except UnicodeDecodeError:
            out[b] = chr(b)
    return out


def read_as(raw: bytes, name: str) -> str:
    """Bytes read in an encoding, as lenient readers do."""
    if name in ("utf-8", "gbk"):
        return raw.decode(name, "replace")
    return raw.decode("latin-1").translate(_reader(name))


def write_as(text: str, name: str) -> bytes | None:
    """Bytes of a text in an encoding, or None if it has none there."""
    try:
        return text.encode(name)
    except UnicodeEncodeError:
        return None


@lru_cache(maxsize=None)
def _back(name: str) -> dict[int, int]:
    return {ord(ch): b for b, ch in _reader(name).items()}


def restore(text: str, chain: str) -> str | None:
    """The text before a chain such as 'utf-8>cp1252>cp1252', or None if it can't be told."""
    source, *readers = chain.split(">")
    if readers[-1] == "lost":
        return None
    for i, reader in enumerate(reversed(readers)):
        if reader in ("ascii", "utf-8") or "\ufffd" in text:
            return None
        if reader == "gbk":
            raw = write_as(text, "gbk")
        else:
            table = _back(reader)
            raw = bytes(table.get(ord(ch), 256) for ch in text) if all(ord(ch) in table for ch in text) else None
        if raw is None:
            return None
        try:
            text = raw.decode("utf-8" if i + 1 < len(readers) else source)
        except UnicodeDecodeError:
            return None
    return text


def script_of(word: str) -> str | None:
    """The script whose chains can garble a word; None for plain ASCII and for mixtures."""
    if word.isascii():
        return None
    for name, pattern in _SCRIPT:
        if pattern.match(word) and (name != "japanese" or _IDEOGRAPH.search(word)):
            return name
    return None


def source_words(token: str) -> list[tuple[str, str]]:
    """(script, word) that a corpus token gives: itself, or its pairs of characters where no spaces part words."""
    if token.isascii():  # a typographic apostrophe is what gets garbled
        return [("latin", token.replace("'", "’"))] if "'" in token else []
    if token == "\u00a0":
        return [("latin", token)]
    script = script_of(token)
    if script == "japanese" or _IDEOGRAPH.search(token):
        kana = "japanese" if _KANA.search(token) else "chinese"
        return [(kana, m) for m in _PAIR.findall(token)]
    return [(script, token)] if script else []


def garbled_forms(word: str, script: str) -> dict[str, str]:
    """Garbled form to chain, shortest chain first."""
    out: dict[str, str] = {}
    cased = [word] if script not in ("latin", "cyrillic") else list(dict.fromkeys((word, word.upper(), word.lower(), word[:1].upper() + word[1:].lower())))

    def add(form: str, chain: str) -> None:
        if form not in cased and form not in out and (len(form) > 1 or form == "\ufffd" or "\u2500" <= form <= "\u259f"):
            out[form] = chain

    for w in cased:
        for source, readers in CHAINS[script].items():
            raw = write_as(w, source)
            if raw is None:
                continue
            for reader in readers:
                if reader == "ascii":
                    form = re.sub(r"[^\x00-\x7f]", "?", w)
                    if len(form) >= 4 or re.search(r"[A-Za-z]\?[A-Za-z]|^\?[A-Za-z]{2}", form):
                        if re.search("[A-Za-z]", form):
                            add(form, f"{source}>ascii")
                    continue
                form = read_as(raw, reader)
                if form.isascii() or reader == "utf-8" and "\ufffd" not in form:
                    continue
                add(form, f"{source}>{reader}")
                if source == "utf-8" and reader not in ("gbk",):
                    bare = _LOST.sub("", form)
                    if bare != form and len(bare) >= 2 and not bare.isascii():
                        add(bare, f"{source}>{reader}>lost")
                    if reader in _TWICE:
                        again = form
                        for depth in (2, 3):
                            again = read_as(again.encode("utf-8"), reader)
                            add(again, ">".join([source, *[reader] * depth]))
                            if depth == 2:
                                add(read_as(form.encode("utf-8"), "cp1252" if reader == "latin-1" else "latin-1"), f"{source}>{reader}>" + ("cp1252" if reader == "latin-1" else "latin-1"))
    return out


_TURNED = re.compile("[a-z\u00df-\u00ff\u0430-\u045f][A-Z\u00c0-\u00de\u0160\u0178\u017d\u0400-\u042f]")
_ACCENTED = re.compile("[\u00c0-\u024f]{3}")
_HOLE = re.compile(r"[A-Za-z]\?[A-Za-z]")
#: Signs within a word, and the German letter where it can't stand.
_MISPLACED = re.compile(r"[^\W\d_][\u00d7\u00f7]|[\u00d7\u00f7][^\W\d_]|[b-df-hj-np-tv-xz\u00f1\u00e7]\u00df|\b\u00df", re.I)
#: Russian letters in ten thousand; others count as one.
_LETTERS = dict(zip("оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё", (1097, 845, 801, 735, 670, 626, 547, 473, 454, 440, 349, 321, 298, 281, 262, 201, 190, 174, 170, 165, 159, 144, 121, 97, 94, 73, 64, 48, 36, 32, 26, 4, 20)))
_CYRILLIC = re.compile("[\u0400-\u04ff]+")


def likeness(word: str) -> float | None:
    """How well a word's letters fit Russian, as a logarithm; None if other characters are in it."""
    return sum(log(_LETTERS.get(ch, 1)) for ch in word.lower()) if _CYRILLIC.fullmatch(word) else None


def is_strange(token: str) -> bool:
    """Whether no language writes a token so: scripts or signs mixed, capitals after small letters, accents in a row."""
    if token.isascii():
        return len(token) > 4 and bool(_HOLE.search(token))
    return script_of(token) is None and not _IDEOGRAPH.search(token) or bool(_TURNED.search(token) or _ACCENTED.search(token) or _MISPLACED.search(token))


#: Characters that one-byte readers make of multi-byte text, and those among them that no alphabet has.
_IMAGE = r"\u0080-\u00ff\u0152\u0153\u0160\u0161\u0178\u017d\u017e\u0192\u02c6-\u02dd\u2013-\u203a\u20ac\u2122\u2200-\u22ff\u2310-\u2321\u2500-\u25ff\u0102-\u017c\u0401-\u045f\u0490\u0491\u2116\u03c0-\u03c6\u0393-\u03b5"
_STRANGE = r"\u0080-\u009f\u00a2-\u00a9\u00ac-\u00b7\u00b9\u00bc-\u00be\u00d0\u00de\u2013\u2018-\u2022\u2026\u2030-\u203a\u20ac\u2122\u2200-\u22ff\u2310-\u2321\u2500-\u25ff\u0401-\u040f\u0452-\u045f\u0490\u0491\u00d7\u00f7\u00c0-\u00c5\u00c8-\u00cf\u00d2-\u00db"


@lru_cache(maxsize=1)
def _gbk_image() -> str:
    """Characters that a GBK reader makes of the first two bytes of UTF-8 ideographs and kana."""
    made = {bytes([a, b]).decode("gbk", "ignore") for a in range(0xE3, 0xEA) for b in range(0x80, 0xC0)}
    return "".join(sorted(ch for ch in made if ch and "\u3400" <= ch <= "\u9fff"))


_STRIP = "!\"#$%&'()*+,-./:;<=>@[\\]^_`{|}~"
_ASCII_WORTH = re.compile(r"\?[A-Za-z]|[A-Za-z]\?|[A-Za-z]'[A-Za-z]")
_IMAGE_RUN = re.compile(f"[{_IMAGE}]{{4}}")
_ODD = re.compile(f"[{_STRANGE}]")
_GBK_RUN = re.compile(f"[{_gbk_image()}][^a-zA-Z]*?[{_gbk_image()}\ufffd]")
_MIDDLE = re.compile(r"[.!?]([^\x00-\x7f]{1,8})[A-Za-z]")
_LEAD = re.compile(r"^([^\x00-\x7f][^\x00-\x7f]*)[\x21-\x7e]+$")
_TAIL = re.compile(r"^[\x21-\x7e]+?([^\x00-\x7f]+)[\x21-\x2f]*$")


def text_tokens(text: str) -> tuple[set[str], set[str]]:
    """A text's tokens that may be garbled or tell how words are spelt; and windows of those that look like multi-byte text.

    Tokens are parted by ASCII blanks only, as other white space may be part of
    a garbled letter, and lose ASCII marks at their ends, but for question
    marks, which may stand for a letter.
    """
    whole: set[str] = set()
    windows: set[str] = set()
    if text.isascii() and not _ASCII_WORTH.search(text):
        return whole, windows
    for part in set(text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")):
        if part.isascii():
            if ("'" in part or "?" in part) and _ASCII_WORTH.search(part):
                whole.add(part.strip(_STRIP))
            continue
        bare = part.strip(_STRIP)
        whole.add(bare)
        # marks that stick to an ASCII word are words of their own
        if not bare[-1].isalnum() and not bare[-1].isascii() and (m := _TAIL.match(bare)):
            whole.add(m.group(1))
        if not bare[0].isalnum() and not bare[0].isascii() and (m := _LEAD.match(bare)):
            whole.add(m.group(1))
        if "." in bare or "?" in bare or "!" in bare:  # what stands between two sentences, where a blank may have been
            whole.update(_MIDDLE.findall(bare))
        if len(part) >= 4 and (_IMAGE_RUN.search(part) and _ODD.search(part) or _GBK_RUN.search(part)):
            for n in (3, *WINDOWS):
                windows.update(part[i : i + n] for i in range(len(part) - n + 1))
    whole.discard("")
    return whole, {w for w in windows if not w.isascii()}


#: Difference of likeness that tells a word from its garbled form.
LIKENESS = 3.0

#: Tokens that a task counts before it hands the counts on.
_COUNTED = 400_000


def count_tokens(df: DataFrame) -> DataFrame:
    """(token, n): in how many records each token stands, counted within tasks first; windows count 0."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        blank: set[str] = set()

        def flush() -> pa.RecordBatch:
            rest = [w for w in blank if w not in seen]
            return pa.RecordBatch.from_arrays([pa.array([*seen, *rest], pa.string()), pa.array([*seen.values(), *[0] * len(rest)], pa.int64())], names=["token", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                whole, windows = text_tokens(text)
                seen.update(whole)
                blank |= windows
            if len(seen) + len(blank) > _COUNTED:
                yield flush()
                seen, blank = Counter(), set()
        yield flush()

    return spread(df.select("text")).mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


#: Bits of the filter per garbled token, and at most.
_BITS_EACH, _BITS_MOST = 16, 1 << 26


def _bits(token: str, size: int) -> tuple[int, int]:
    h = xxhash.xxh64_intdigest(token.encode("utf-8"))
    return h % size, (h >> 20) * 0x9E3779B97F4A7C15 % (1 << 64) % size


def token_filter(hits: DataFrame) -> np.ndarray:
    """Bits of a Bloom filter of the garbled tokens: at most 8 MB, whatever their number."""
    size = 64
    wanted = min(_BITS_MOST, max(64, hits.count() * _BITS_EACH))
    while size < wanted:
        size *= 2

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [b for t in batch.column(0).to_pylist() for b in _bits(t, size)]
            yield pa.RecordBatch.from_arrays([pa.array([b >> 5 for b in bits], pa.int32()), pa.array([1 << (b & 31) for b in bits], pa.int64())], names=["word", "mask"])

    words = np.zeros(size >> 5, dtype=np.uint32)
    for word, mask in hits.select("token").mapInArrow(mark, "word int, mask long").groupBy("word").agg(F.bit_or("mask")).collect():
        words[word] = mask
    return words


#: Records from which on a token's rows are spread over SALTS keys of the join. At most one in HOT of all tokens is so common.
HOT, SALTS = 100_000, 32


def hot_tokens(hits: DataFrame, hot: int) -> frozenset[str]:
    """The garbled tokens of at least `hot` records; their number is bounded by that of all tokens over `hot`."""
    return frozenset(r.token for r in hits.where(F.col("n") >= hot).select("token").collect())


def record_tokens(df: DataFrame, bits: np.ndarray, hot: frozenset[str] = frozenset(), with_text: bool = False) -> DataFrame:
    """(tab, row_id, tokens): the tokens and windows of each record that pass the filter, as structs (token, salt); records without any are left out.

    The salts of a hot token go round by record. With with_text the text comes along.
    """
    size = len(bits) << 5
    kind = df.schema["row_id"].dataType.simpleString()
    names = ["tab", "row_id", *(["text"] if with_text else []), "tokens"]

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bool] = {}
        table, seen = bits.tolist(), 0
        for batch in batches:
            at, ends, tokens, salts = [], [0], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                whole, windows = text_tokens(text)
                for token in whole | windows if windows else whole:
                    hit = known.get(token)
                    if hit is None:
                        a, b = _bits(token, size)
                        hit = known[token] = bool(table[a >> 5] >> (a & 31) & 1 and table[b >> 5] >> (b & 31) & 1)
                    if hit:
                        tokens.append(token)
                        salts.append(seen % SALTS if token in hot else 0)
                if len(tokens) > ends[-1]:
                    seen += 1
                    at.append(i)
                    ends.append(len(tokens))
            if len(known) > _COUNTED:
                known.clear()
            keep = pa.array(at, pa.int64())
            columns = [batch.column(k).take(keep) for k in range(3 if with_text else 2)]
            found = pa.StructArray.from_arrays([pa.array(tokens, pa.string()), pa.array(salts, pa.int32())], names=["token", "salt"])
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)], names=names)

    schema = f"tab string, row_id {kind}, {'text string, ' if with_text else ''}tokens array<struct<token:string,salt:int>>"
    return spread(df.select("tab", "row_id", "text")).mapInArrow(pick, schema)


def token_hits(records: DataFrame, hits: DataFrame, hot: frozenset[str], *columns: str) -> DataFrame:
    """(tab, row_id, hits): the set of structs (token, columns...) of each record's garbled tokens.

    Hot tokens meet one of SALTS copies of their hit each. A record that was
    delivered again adds nothing to its set.
    """
    salts = F.when(F.col("token").isin(*hot), SALTS).otherwise(1) if hot else F.lit(1)
    copies = hits.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    one = records.select("tab", "row_id", F.explode("tokens").alias("t")).select("tab", "row_id", "t.token", "t.salt")
    met = one.join(copies.select("token", "salt", *columns), ["token", "salt"])
    return met.groupBy("tab", "row_id").agg(F.collect_set(F.struct("token", *columns)).alias("hits"))


def garbled_tokens(df: DataFrame, least: int = 1, excess: int = 1) -> DataFrame:
    """(token, original, chain, n_original, n): tokens of the texts of df that are garbled forms of words of theirs."""
    vocabulary = cut(count_tokens(df).withColumn("fold", F.lower("token")))

    def sources(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter[tuple[str, str]] = Counter()
            for t, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for found in source_words(t):
                    seen[found] += n
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in seen], pa.string()), pa.array([w for _, w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["script", "word", "n"])

    words = vocabulary.where("n > 0").select("token", "n").mapInArrow(sources, "script string, word string, n long")
    words = words.withColumn("fold", F.lower("word")).groupBy("script", "fold").agg(F.max_by("word", "n").alias("word"), F.sum("n").alias("n")).where(F.col("n") >= least)

    def garble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = ([], [], [], [], [], [], [], [])
            for script, word, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                pair = script in ("japanese", "chinese")
                natural = (pair or sum(map(str.isalpha, word)) > 2) and not is_strange(word)
                like = likeness(word)
                for form, chain in garbled_forms(word, script).items():
                    # a form that is longer than its original and goes through UTF-8 proves itself
                    proven = chain.startswith("utf-8>") and len(form) > len(word) and "gbk" not in chain
                    strange = not proven and natural and len(form) > 2 and is_strange(form)
                    rest = None if proven or like is None else likeness(form)
                    fit = None if rest is None or not natural else like - rest
                    for column, value in zip(out, (form, word, chain, n, pair, proven, strange, fit)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.float64()))], names=["token", "original", "chain", "n_original", "pair", "proven", "strange", "fit"])

    table = words.select("script", "word", "n").mapInArrow(garble, "token string, original string, chain string, n_original long, pair boolean, proven boolean, strange boolean, fit double")
    best = F.struct("original", "chain", "n_original")
    # windows are looked up among pairs of characters only
    found = vocabulary.join(table, "token").where("n > 0 or pair")
    # between two Cyrillic words, letters and counts together tell which is the original
    fit = F.col("fit") + F.log(F.col("n_original") / F.greatest("n", F.lit(1)))
    found = cut(found.where(F.col("fit").isNull() | (fit > -LIKENESS)).withColumn("strange", F.col("strange") | F.coalesce((fit > LIKENESS) & (F.col("fit") > LIKENESS), F.lit(False))).drop("fit"))
    # what no language writes needs no count, nor do other letter cases of it, if it isn't a slip of a word that is also capitalised
    odd = found.where("strange").groupBy("fold", F.lower("original").alias("base")).agg(F.max("n").alias("n_odd"))
    capitals = vocabulary.where(F.col("token").rlike(r"^\p{Lu}\p{Ll}+$")).groupBy("fold").agg(F.sum("n").alias("n_capital"))
    odd = cut(odd.join(capitals, "fold", "left").where("n_odd >= coalesce(n_capital, 0)").select("fold", "base", F.lit(True).alias("odd")))
    found = found.withColumn("base", F.lower("original")).join(odd, ["fold", "base"], "left")
    # a chain that is all but unproven beside its own reverse is that reverse seen from the garbled side
    mass = cut(found.where(F.expr("strange or odd")).groupBy("chain").agg(F.sum("n").alias("mass")))
    back = mass.select(F.regexp_replace("chain", "^([^>]+)>([^>]+)$", "$2>$1").alias("chain"), F.col("mass").alias("mass_back"))
    found = found.join(mass, "chain", "left").join(back, "chain", "left").where("proven or strange or odd or coalesce(mass_back, 0) <= 20 * coalesce(mass, 0)").drop("mass", "mass_back")
    # others must be rarer than the original
    found = found.where(F.expr("proven or strange or odd") | (F.col("n_original") > F.col("n") * F.lit(excess)))
    # a garbled word is no original
    garbled = found.where("proven").select(F.col("token").alias("original")).distinct()
    turned = odd.select(F.col("fold").alias("base"), F.lit(True).alias("turned")).distinct()
    found = found.join(garbled, "original", "left_anti").join(turned, "base", "left").where("proven or turned is null")
    hits = found.groupBy("token", "fold", "n").agg(F.max_by(best, F.struct(F.expr("proven or strange or coalesce(odd, false)"), "n_original")).alias("best"), F.max(F.expr("proven or strange or coalesce(odd, false)")).alias("sure")).select("token", "fold", "n", "sure", "best.*")
    hits = cut(hits)
    # and no other letter case of theirs may be a word, unless it is garbled too
    marked = hits.groupBy("fold").agg(F.sum("n").alias("n_hits"))
    cased = vocabulary.join(marked, "fold").groupBy("fold").agg(F.sum("n").alias("n_fold"), F.first("n_hits").alias("n_hits"))
    hits = hits.join(cased, "fold").where(F.col("sure") | ((F.col("n_fold") - F.col("n_hits")) * 20 <= F.col("n_original")))
    return cut(hits.select("token", "original", "chain", "n_original", "n"))


def find_garbled(df: DataFrame, least: int = 1) -> DataFrame:
    """Columns (tab, row_id, hits, chain) of the records of (tab, row_id, text) that are garbled at least in part.

    hits counts the record's garbled tokens, chain is that of the commonest
    original among them. Forms of Cyrillic letters alone count only if there are
    two, or one is long or has its letter case turned about. Repeated rows give one row. Null
    and empty texts give none, nor do empty tables; a null row_id is a value of
    its own. Other columns are ignored.
    """
    rows = df.select("tab", "row_id", "text").where("length(text) > 0")
    hits = garbled_tokens(rows, least)
    plain = F.col("token").rlike(r"^[\x{400}-\x{4ff}.,!?:;'\-]+$")
    swapped = F.col("token").rlike(r"[\x{430}-\x{45f}][\x{400}-\x{42f}]")
    hits = cut(hits.where(~plain | (F.length("token") > 2) | swapped).withColumn("plain", plain).withColumn("swapped", swapped))
    hot = hot_tokens(hits, HOT)
    found = token_hits(record_tokens(rows, token_filter(hits), hot), hits, hot, "chain", "n_original", "plain", "swapped")
    only_plain = F.forall("hits", lambda h: h["plain"])
    sure = ~only_plain | (F.size("hits") >= 2) | F.exists("hits", lambda h: (F.length(h["token"]) >= 6) | h["swapped"])
    commonest = F.array_max(F.transform("hits", lambda h: F.struct(h["n_original"], h["chain"])))["chain"]
    return found.where(sure).select("tab", "row_id", F.size("hits").cast("long").alias("hits"), commonest.alias("chain"))


def restore_texts(df: DataFrame, least: int = 1) -> DataFrame:
    """Columns (tab, row_id, original_text, restored): repaired texts of the garbled records.

    Each garbled token is decoded back through its chain; where the chain loses
    characters, the verified original word stands in. restored is False if a
    garbled token remains. Conventions for nulls and repeats as in find_garbled.
    """
    rows = df.select("tab", "row_id", "text").where("length(text) > 0")
    hits = garbled_tokens(rows, least)
    hot = hot_tokens(hits, HOT)
    # only records that pass the filter keep their texts, so no others are shuffled
    kept = cut(record_tokens(rows, token_filter(hits), hot, with_text=True))
    per_record = token_hits(kept, hits, hot, "original", "chain", "n_original")
    texts = kept.select(F.col("tab").alias("_tab"), F.col("row_id").alias("_row"), "text").dropDuplicates(["_tab", "_row"])
    joined = texts.join(per_record, F.col("_tab").eqNullSafe(F.col("tab")) & F.col("_row").eqNullSafe(F.col("row_id")))
    kind = df.schema["row_id"].dataType.simpleString()

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [mend_text(t, [(h["token"], h["original"], h["chain"]) for h in sorted(hs, key=lambda h: -h["n_original"])]) for t, hs in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.bool_())], names=["tab", "row_id", "original_text", "restored"])

    return joined.select("tab", "row_id", "text", "hits").mapInArrow(mend, f"tab string, row_id {kind}, original_text string, restored boolean")


def mend_text(text: str, hits: list[tuple[str, str, str]]) -> tuple[str, bool]:
    """A text with its garbled tokens put right, and whether none is left.

    Tokens that were not looked up, such as single letters, are decoded back
    through the text's commonest chain if all other words beyond ASCII were
    garbled too, so that no clean word is touched.
    """
    chains = list(dict.fromkeys(chain for _, _, chain in hits))
    by_token = {token: original for token, original, _ in hits}
    whole, used, rest = True, Counter(), []
    parts = re.split(r"([ \t\r\n]+)", text)
    for i in range(0, len(parts), 2):
        part = parts[i]
        if part.isascii() and "?" not in part:
            continue
        core = part.strip(_STRIP)
        touched = [t for t in by_token if t in part]
        if not touched:
            if not part.isascii():
                rest.append((i, core))
            continue
        for chain in chains:
            back = restore(part, chain)
            if back is not None and back != part and any(by_token[t].lower() in back.lower() for t in touched):
                parts[i] = back
                used[chain] += 1
                break
        else:
            if core in by_token:
                original = by_token[core]
                parts[i] = part.replace(core, original.upper() if core.isupper() and len(core) > 1 else original)
            else:
                whole = False
    if used and not any(sum(map(str.isalpha, core)) > 1 and not is_strange(core) for _, core in rest):
        chain = max(used, key=used.get)
        for i, _ in rest:
            back = restore(parts[i], chain)
            if back is not None and any(map(str.isalpha, back)):
                parts[i] = back
    return unicodedata.normalize("NFC", "".join(parts)), whole
