"""Text repair and normalisation as Column expressions (SC1-SC28)."""

from __future__ import annotations

import html
import re
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidecue.functions import rules

SP = rules.SPACE
PHRASE = "[^,.;:!?。！？]*[,.;:!?。！？]?"


def strip(c: Column) -> Column:
    """Drop Unicode white space at both ends."""
    return F.regexp_replace(c, f"^{SP}+|{SP}+$", "")


def squeeze(c: Column) -> Column:
    """SC1, SC2: runs of white space become one space, ends are dropped; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), f"{SP}+", " "))


def fold_case(c: Column) -> Column:
    """Lower case with ß as ss, which case folding does for the languages at hand."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def bare_key(c: Column) -> Column:
    """Letters, digits and underscores only, case folded."""
    return fold_case(F.regexp_replace(c, f"{rules.NOT_WORD}+", ""))


def words(c: Column) -> Column:
    """SC23: tokens between white space; an empty array for an empty text."""
    return F.filter(F.split(squeeze(c), " "), lambda w: w != "")


@lru_cache(maxsize=1)
def _unescape_udf():
    @F.pandas_udf("string")
    def unescape(s: pd.Series) -> pd.Series:
        return s.map(html.unescape, na_action="ignore")

    return unescape


def unescape_html(c: Column) -> Column:
    """HTML entities to characters; Python sees only the texts that hold an ampersand."""
    return F.when(F.contains(c, F.lit("&")), _unescape_udf()(F.when(F.contains(c, F.lit("&")), c))).otherwise(c)


def strip_markup(c: Column, entities: bool = True) -> Column:
    """SC3: cue text without tags, with <br> as a line break, entities read and blanks collapsed.

    One test finds the texts on which any of the steps has something to do.
    """
    t = F.regexp_replace(strip(F.regexp_replace(c, rf"(?dm)^{rules.BLANK}+|{rules.BLANK}+$", "")), r"(?i)<\s*br\s*/?\s*>", "\n")
    t = F.regexp_replace(t, r"(?i)</?(c|i|b|u|ruby|rt|v|lang)(\.[^ >]+)?(\s+[^>]*)?>", "")
    t = F.regexp_replace(t, r"<[^>]+>", "")
    t = unescape_html(t) if entities else t
    t = F.regexp_replace(F.replace(t, F.lit("\ufeff"), F.lit("")), "[ \t]+", " ")
    t = strip(F.regexp_replace(t, " *\n *", "\n"))
    busy = c.rlike(f"[<\ufeff\t{'&' if entities else ''}]|  |{rules.BLANK}\n|\n{rules.BLANK}|^{SP}|{SP}$")
    return F.when(busy, t).otherwise(c)


def escape_ass_text(c: Column) -> Column:
    """SC4: text as an ASS field."""
    t = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.translate(t, "{}", "()"), F.lit("\n"), F.lit("\\N"))


def strip_ass_text(c: Column) -> Column:
    """SC5: visible text of an ASS field: no tags or commands, line breaks kept, empty lines dropped."""
    t = F.regexp_replace(c, r"\{[^{}]*\}", "")
    t = F.replace(F.replace(F.replace(t, F.lit("\\N"), F.lit("\n")), F.lit("\\n"), F.lit("\n")), F.lit("\\h"), F.lit(" "))
    t = F.regexp_replace(t, r"\\[A-Za-z]+(\([^)]*\))?", "")
    lines = F.filter(F.transform(F.split(t, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"), squeeze), lambda x: x != "")
    return F.array_join(lines, "\n")


def visible_text(c: Column) -> Column:
    """SC6: an ASS field without tags, breaks as spaces."""
    t = F.regexp_replace(c, r"\{[^{}]*\}", "")
    return strip(F.replace(F.replace(t, F.lit("\\N"), F.lit(" ")), F.lit("\\n"), F.lit(" ")))


def leading_tags(c: Column) -> Column:
    """SC7: the run of {...} at the start."""
    return F.regexp_extract(c, r"^((\{[^}]*\})*)", 1)


def after_leading_tags(c: Column) -> Column:
    return F.substr(c, F.length(leading_tags(c)) + 1)


def replace_keeping_tags(raw: Column, text: Column) -> Column:
    """SC8: leading tags with another text."""
    return F.concat(leading_tags(raw), text)


def position_x(c: Column) -> Column:
    r"""SC9: x of the first \pos(x, ...; 0.0 without one."""
    return F.coalesce(F.regexp_extract(c, r"\\pos\(([-0-9.]+),", 1).try_cast("double"), F.lit(0.0))


def repair_encoding(c: Column, spanish: Column | None = None) -> Column:
    """SC13: known garbled pairs put right in order; where spanish holds, lost inverted question marks too."""
    t = reduce(lambda x, ch: F.replace(x, F.lit(ch), F.lit("")), rules.DROPPED, c)
    t = reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), rules.MOJIBAKE, t)
    if spanish is None:
        return t
    es = reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), rules.SPANISH_OPENERS, t)
    es = F.regexp_replace(es, f"(^|{SP})\\?([A-ZÁÉÍÓÚÑ])", "$1¿$2")
    return F.when(spanish & F.contains(t, F.lit("?")), es).otherwise(t)


def repair_phrases(c: Column) -> Column:
    """SC14: Spanish phrases that recognisers mishear."""
    return reduce(lambda x, rule: F.regexp_replace(x, f"(?iuU){rule[0]}", rule[1]), rules.SPANISH_PHRASES, c)


#: A key that stands twice in a row, in keys with one space between; an empty key parts its neighbours.
TWICE = r"(?<![^ ])([^ ]++) \1(?![^ ])"
MARKS = ",.;:!?。！？"


def drop_repeated_words(c: Column) -> Column:
    """SC15: a word equal to the last kept one, but for case and punctuation, is dropped.

    The keys of all words, made at once, tell the texts that hold such a word; only those are folded.
    """
    keyed = F.transform(words(c), lambda w: F.struct(w.alias("w"), bare_key(w).alias("k")))
    none = F.struct(F.lit("").alias("out"), F.lit("").alias("last"))
    join = lambda out, w: F.when(out == "", w).otherwise(F.concat(out, F.lit(" "), w))
    kept = F.aggregate(keyed, none, lambda a, x: F.when((x["k"] != "") & (x["k"] == a["last"]), a).otherwise(F.struct(join(a["out"], x["w"]).alias("out"), x["k"].alias("last"))), lambda a: a["out"])
    keys = fold_case(F.regexp_replace(squeeze(c), r"[^\p{L}\p{N}_ ]+", ""))
    return F.when(keys.rlike(TWICE), kept).when(F.contains(squeeze(c), F.lit(" ")), squeeze(c)).otherwise(c)


def collapse_phrases(c: Column) -> Column:
    """SC16: a phrase between marks equal to the last kept one is dropped with its mark; so are empty phrases.

    A text whose marks all stand behind a character and before a space or the end, and without the same phrase
    twice in a row, stays as it is; only others are folded.
    """
    marks = f"[{MARKS}]"
    found = F.regexp_extract_all(squeeze(c), F.lit(f"({PHRASE})"), 1)
    keyed = F.transform(found, lambda m: F.struct(F.trim(F.regexp_replace(m, f" +({marks})$", "$1")).alias("t"), bare_key(m).alias("k")))
    none = F.struct(F.lit("").alias("out"), F.lit("").alias("last"))
    join = lambda out, t: F.when(out == "", t).otherwise(F.concat(out, F.lit(" "), t))
    kept = F.aggregate(
        keyed, none, lambda a, x: F.when(x["t"].rlike(f"^{marks}?$") | (x["k"] != "") & (x["k"] == a["last"]), a).otherwise(F.struct(join(a["out"], x["t"]).alias("out"), x["k"].alias("last"))), lambda a: a["out"]
    )
    # marks become spaces before the case is folded, as some letters depend on what follows
    keys = fold_case(F.translate(F.regexp_replace(squeeze(c), rf"[^\p{{L}}\p{{N}}_{MARKS}]+", ""), MARKS, " " * len(MARKS)))
    busy = squeeze(c).rlike(rf"{marks}(?! |\z)|(?<![^ ]){marks}") | keys.rlike(TWICE)
    return F.when(busy, squeeze(kept)).otherwise(squeeze(c))


def comparable_key(c: Column) -> Column:
    """SC18: words without case and punctuation, one space between."""
    return squeeze(F.regexp_replace(fold_case(squeeze(c)), f"{rules.NOT_WORD}+", " "))


def alignment_key(c: Column) -> Column:
    """SC19, after cleaning: Latin letters and digits only."""
    return F.regexp_replace(fold_case(c), "[^0-9a-záéíóúüñ]+", "")


#: Parts of a text around its last sentence boundary.
LAST_SENTENCE = rf"^(.*[.!?])({SP}+)([A-ZÁÉÍÓÚÜÑ¡¿].*)$"


def split_final_sentence(c: Column) -> Column:
    """SC20: struct (head, tail) cut at the last sentence boundary; tail is empty without one."""
    flat, last = squeeze(c), LAST_SENTENCE
    head, tail = F.regexp_extract(flat, last, 1), F.regexp_extract(flat, last, 3)
    found = (head != "") & (tail != "")
    return F.struct(F.when(found, head).otherwise(flat).alias("head"), F.when(found, tail).otherwise(F.lit("")).alias("tail"))


def apply_terms(c: Column, terms: list[tuple[str, str]]) -> Column:
    """SC22, SO3: literal replacement, longest source first, ties in the order given; later rules see earlier results."""
    ordered = sorted(enumerate(terms), key=lambda x: (-len(x[1][0]), x[0]))
    return reduce(lambda x, t: F.replace(x, F.lit(t[1][0]), F.lit(t[1][1])), ordered, c)


def garbled_terms(text: str) -> list[str]:
    """SC21: how UTF-8 bytes of a term look when read as cp1252 or Latin-1, bytes unknown there dropped."""
    raw = text.encode("utf-8")
    return sorted({raw.decode(e, "ignore") for e in ("cp1252", "latin-1")} - {text, ""})


def glossary_terms(user: list[tuple[str, str]] | None = None, base: dict[str, str] | None = None) -> list[tuple[str, str]]:
    """J12, SRC18: default terms and their garbled forms, overridden by the user's."""
    terms: dict[str, str] = {}
    for source, target in (rules.GLOSSARY if base is None else base).items():
        terms[source] = target
        for variant in garbled_terms(source):
            terms[variant] = target
    terms.update({k: v for k, v in user or [] if k and v is not None})
    return list(terms.items())


def trim_repeated_suffix(left: Column, right: Column) -> Column:
    """SC26: left without a tail that repeats right; null where nothing is trimmed."""
    a, b = squeeze(left), squeeze(right)
    short = (F.length(b) < 18) & (F.size(words(comparable_key(b))) < 4)
    stem = F.substr(a, F.lit(1), F.length(a) - F.length(b))
    cut = F.regexp_replace(stem, "[ ,;:-]+$", "")
    colon = F.regexp_replace(stem, f"{SP}+$", "").endswith(":")
    return F.when(~short & (a != b) & F.endswith(a, b) & (b != "") & (cut != ""), F.concat(cut, F.when(colon, F.lit(".")).otherwise(F.lit(""))))


def overlap_size(left: Column, right: Column) -> Column:
    """SC27: greatest k such that the last k words of left are the first k of right (0 if none)."""
    most = F.least(F.size(left), F.size(right))
    fits = F.filter(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), lambda k: (k <= most) & (F.slice(left, F.size(left) - k + 1, k) == F.slice(right, F.lit(1), k)))
    return F.when(most > 0, F.coalesce(F.array_max(fits), F.lit(0))).otherwise(F.lit(0))


def output_folder_name(path: Column) -> Column:
    """SC24: file name without suffix and trailing dots or blanks; an error for reserved and empty names."""
    name = F.regexp_extract(F.translate(path, "\\", "/"), "([^/]*)$", 1)
    stem = F.regexp_replace(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), r"[. ]+$", "")
    return F.when(stem.isin("", ".", "..", "_legacy"), F.raise_error(F.concat(F.lit("no folder name in "), path)).cast("string")).otherwise(stem)


def quote_single(c: Column) -> Column:
    """SC28: in single quotes, inner ones doubled."""
    return F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))


def quote_list(c: Column) -> Column:
    """SC28: an array of quoted strings as @('a','b')."""
    return F.concat(F.lit("@("), F.array_join(F.transform(c, quote_single), ","), F.lit(")"))


@lru_cache(maxsize=1)
def _spanish_rules() -> list[tuple[re.Pattern, str, str]]:
    """(pattern, replacement, literal that a text must hold for the pattern to match) in order."""
    return [(re.compile(pattern), target, pattern.replace(r"\b", "").replace("\\", "")) for pattern, target in rules.SPANISH_SPELLINGS]


# Where an inverted mark is missing before an exclamation, and before a question.
_OPENED = re.compile(r"(^|[\s\"'(\[{])\?([A-ZÁÉÍÓÚÜÑ][^?\n!]{0,80}!)")
_ASKED = re.compile(r"(^|[\s\"'(\[{])\?([A-ZÁÉÍÓÚÜÑ][^?\n]{0,80}\?)")


def spanish_text(text: str) -> str:
    """SC10 on one string: lost letters, missing accents, inverted marks and tag questions put right."""
    for pattern, target, literal in _spanish_rules():
        if literal in text:
            text = pattern.sub(target, text)
    text = _ASKED.sub(r"\1¿\2", _OPENED.sub(r"\1¡\2", text)).replace("?no?", "¿no?").replace("?verdad?", "¿verdad?")
    text = re.sub("¡{2,}", "¡", re.sub("¿{2,}", "¿", text))
    return re.sub(" *\n *", "\n", re.sub("[ \t]+", " ", text)).strip()


@lru_cache(maxsize=1)
def _spanish_udf():
    @F.pandas_udf("string")
    def repair(s: pd.Series) -> pd.Series:
        return s.map(spanish_text, na_action="ignore")

    return repair


def normalize_spanish(c: Column) -> Column:
    """SC10. 150 ordered rules outgrow a JVM method, so they run on Arrow batches."""
    return _spanish_udf()(c)


def normalize_ass_raw(c: Column) -> Column:
    """SC12: struct (raw, changed): the text after leading tags normalised, unless braces remain in it."""
    rest = after_leading_tags(c)
    done = normalize_spanish(rest)
    change = ~F.contains(rest, F.lit("{")) & ~F.contains(rest, F.lit("}")) & (done != strip(rest))
    return F.struct(F.when(change, F.concat(leading_tags(c), done)).otherwise(c).alias("raw"), F.coalesce(change, F.lit(False)).alias("changed"))


_LETTER = "A-Za-zÁÉÍÓÚÜÑáéíóúüñ"
_SUSPECT = re.compile(rf"(?<=[{_LETTER}])\?(?=[{_LETTER}])|(^|[\s\"'(\[{{])\?(?=[{_LETTER}])")


@lru_cache(maxsize=1)
def _suspect_udf():
    @F.pandas_udf("array<struct<offset:int,context:string>>")
    def find(s: pd.Series) -> pd.Series:
        def each(text: str):
            return [{"offset": m.start(), "context": text[max(0, m.start() - 30) : m.end() + 30].replace("\n", "\\n")} for m in _SUSPECT.finditer(text)]

        return s.map(lambda t: None if t is None else each(t))

    return find


def suspicious_questions(c: Column) -> Column:
    """SC11: offset and surroundings of question marks that stand where a letter or an inverted mark should."""
    mark = F.contains(c, F.lit("?"))
    empty = F.array().cast("array<struct<offset:int,context:string>>")
    return F.when(mark, _suspect_udf()(F.when(mark, c))).otherwise(empty)
