import random

import pytest

from tidecue.llm import sentences
from tidecue.llm.sentences import boundaries, choose_spans, quotes_of, sentence_units, split_sentences

CASES = [
    ["Dr. Kasria arrived at 10 a.m. with Mrs. Vel.", "The bell rang at 4 p.m.", "One moment."],
    ["«¿Vienes con nosotros? Es tarde», dijo Lo en voz baja.", "¡Corre!"],
    ["No sé... quizá la próxima semana.", "El telón rojo...", "Además, cosió."],
    ["La versión 2.9.1 del guion corrige la pág. 20 y el cap. 4.", "¿Y si Tar dice \"¡no!\" otra vez?"],
    ["Dr. Fel kam am 3. Mai um 28.30 Uhr mit Hrn. Kas.", "Im 2. Akt singt z. B. Dor ganz allein."],
    ["Дубль длится 7,27 секунды, т. е. 53 кадров.", "Привезли кабели и т. д.", "Он живёт на ул. Фед, д. 9, рядом."],
    ["“क्या तुम आ रहे हो? देर हो गई है,” नारान ने धीरे से कहा।", "ठीक है|", "एक मिनट।"],
    ["\"같이 갈래요? 너무 늦었어요.\"라고 하온진 씨가 말했습니다.", "고마워요, 유비 씨.", "네."],
    ["El archivo se llama toma_24.final.srt y pesa 32,85 MB.", "Ya voy."],
]


@pytest.mark.parametrize("units", CASES)
def test_units(units):
    text = " ".join(units)
    assert [text[a:b] for a, b in sentence_units(text)] == units


@pytest.mark.parametrize("units", [["「一緒に来る？もう遅いよ。」とソリマが言いました。", "はい。"], ["他说“好。就这样。”的时候笑了。", "我不知道……也许下个星期吧。", "小心台阶！"], ["（ソネキの注を見てください。）という紙がありました。", "もちろん。"]])
def test_scripts_without_spaces(units):
    text = "".join(units)
    assert [text[a:b] for a, b in sentence_units(text)] == units


def test_marks_missing_or_replaced():
    assert len(sentence_units("录音师改了标题　后来，编剧组忘了带钥匙　好的")) == 3
    assert len(sentence_units("La capitana midió. la editora cosió el telón. ya voy.")) == 3
    assert len(sentence_units("perdió el tren.La capitana midió la distancia.")) == 2


def test_breaks_dashes_headings_and_edges():
    text = "# Title 4\n\n- Yes, it\nrained.\n- No.\n \nthe end of"
    assert [text[a:b] for a, b in sentence_units(text)] == ["# Title 4", "- Yes, it\nrained.", "- No.", "the end of"]
    assert sentence_units(None) == sentence_units("  \n ") == []
    assert sentence_units("...") == [(0, 3)]


def test_every_character_lies_in_one_unit():
    for text in ["a. b? c! (d. e) \"f. g\" " * 300, "x" * 100_000, "。" * 50, "\"open and never closed. " * 40, "A.B.C. " * 100]:
        covered = sorted(sentence_units(text))
        assert all(a < b for a, b in covered) and all(x[1] <= y[0] for x, y in zip(covered, covered[1:]))
        inside = set()
        for a, b in covered:
            inside.update(range(a, b))
        assert all(i in inside for i, ch in enumerate(text) if not ch.isspace())


def test_table(spark):
    df = spark.createDataFrame([("cues", 1, "One. Two.", 5), ("cues", 1, "One. Two.", 6), ("cues", None, "Three.", 7), ("cues", 2, None, 8), ("cues", 3, " ", 9)], "tab string, row_id long, text string, char_start int")
    got = sorted((r.row_id or 0, r.char_start, r.char_end) for r in split_sentences(df, ["tab", "row_id"]).collect())
    assert got == [(0, 0, 6), (1, 0, 4), (1, 0, 4), (1, 5, 9), (1, 5, 9)]
    assert split_sentences(df.limit(0), ["tab", "row_id"]).count() == 0


def by_threshold(text):
    """Cuts wherever closing and opening alone speak for one, outside pairs of quotes."""
    quotes = quotes_of(text)
    cuts = [b.end for b in boundaries(text, quotes) if b.closing + b.opening > 0 and not any(x < b.end < y for x, y in quotes.pairs)]
    return [t.strip() for t in (text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])) if t.strip()]


def units_of(text):
    return [text[a:b] for a, b in sentence_units(text)]


def test_a_quotation_cut_off_at_the_edge_stays_whole():
    """Whole spans decide: the threshold cuts it after the question."""
    text = "Lo dijo ayer. «¿Vienes con nosotros? Es tarde"
    assert units_of(text) == ["Lo dijo ayer.", "«¿Vienes con nosotros? Es tarde"]
    assert by_threshold(text) == ["Lo dijo ayer.", "«¿Vienes con nosotros?", "Es tarde"]
    text = "Es tarde. ¿Vienes con nosotros?», dijo en voz baja. ¡Corre!"
    assert units_of(text) == ["Es tarde. ¿Vienes con nosotros?», dijo en voz baja.", "¡Corre!"]


def test_a_stray_mark_does_not_hold_sentences_together():
    text = 'The crew left "early. The lamp went out. Nobody came. The bell rang twice. It was late.'
    assert len(units_of(text)) == 5


def test_length_decides_weak_boundaries():
    """An ellipsis before a small letter ends a unit only if the unit would grow too long."""
    short = "She walked on… and on… the lamp went out… nobody came"
    assert units_of("He said so. " + short) == ["He said so.", short] and len(by_threshold("He said so. " + short)) > 2
    # a writer who begins all units in small letters
    assert len(units_of("the lamp went out. she walked on and on to the river. nobody came. the end.")) == 4
    words = "the long road went over the hill and down to the river where the old mill stood by the water "
    long = (words * 8).strip() + "… " + (words * 8).strip()
    text = "It was late. The" + long[3:] + ". The end."
    assert len(units_of(text)) == 4 and len(units_of(text.replace(words * 7, words))) == 3


def brute_best(text):
    """Score of the best of all sequences of spans, and of a given one."""
    quotes = quotes_of(text)
    ends = boundaries(text, quotes)
    points = [0, *[b.end for b in ends], len(text)]

    def span(i, j):
        a, b = points[i], points[j]
        wide = sum(bool(sentences._WIDE.match(ch)) for ch in text[a:b])
        score = sentences.length_score(sum(map(str.isalnum, text[a:b])) + 1.5 * wide)
        for k, gain in ((i, "opening"), (j, "closing")):
            if 0 < k < len(points) - 1:
                score += getattr(ends[k - 1], gain) - sentences.CUT_PAIR * any(x < points[k] < y for x, y in quotes.pairs)
        if j < len(points) - 1 and ends[j - 1].small:
            word = sentences._WORD_AFTER.match(text, a).group(1) or ""
            if not word[:1].islower() or not i and b <= sentences.CONTINUED:
                score += sentences.SMALL_AFTER_CAPITAL - sentences.SMALL_AFTER_SMALL
        score -= sentences.STRAY_HALF * (b < len(text) and any(a <= o < b for o in quotes.openers))
        return score - sentences.STRAY_HALF * (a > 0 and any(a < c <= b for c in quotes.closers))

    def total(cuts):
        at = [0, *[points.index(c) for c in cuts]]
        return sum(span(i, j) for i, j in zip(at, at[1:]))

    inner = points[1:-1]
    best = max(total([*[c for k, c in enumerate(inner) if mask >> k & 1], len(text)]) for mask in range(1 << len(inner)))
    return best, total(choose_spans(text, ends, quotes))


@pytest.mark.parametrize("many", [48, 1])
def test_the_programme_finds_the_best_sequence(monkeypatch, many):
    monkeypatch.setattr(sentences, "_MANY", many)
    rng = random.Random(6)
    parts = ["The lamp", " went", " out", ". ", "… ", "! ", "?", ' "', '" ', "«", "» ", " e.g. ", " p. 3", "\n- ", "好的。", "(", ") ", " and", "A", ". b"]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 18)))
        if not text.strip():
            continue
        best, chosen = brute_best(text)
        assert abs(best - chosen) < 1e-9, text


def test_many_rejected_boundaries():
    text = "See " + ", ".join(f"p. {i}" for i in range(3000)) + " for more. The end."
    assert units_of(text)[-1] == "The end." and len(units_of(text)) == 2
