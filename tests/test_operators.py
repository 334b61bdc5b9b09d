import random

import pytest
from pyspark.sql import functions as F

from tidecue.operators import folds, neighbors, tracks, translate
from tidecue.operators.deliveries import latest_delivery
from tidecue.operators.scan import Walker, neighbours, number_rows, ordered_scan


def cue_rows(n, seed):
    rng = random.Random(seed)
    return [(rng.choice([1, 1, 1, 1, 2, 3]), i, rng.choice(["a", "b", None])) for i in range(n)]


@pytest.mark.parametrize("parts", [1, 9])
def test_neighbours_and_numbers(spark, parts):
    rows = cue_rows(300, 1)
    df = spark.createDataFrame([*rows, (None, 5, "z")], "track_id long, n int, text string")
    got = {(r.track_id, r.n): (r.prev_text, r.next_text, r.prev_n) for r in neighbours(df, "track_id", ["n"], ["text", "n"], parts).collect()}
    numbers = {(r.track_id, r.n): r.k for r in number_rows(df, "track_id", ["n"], "k", parts).collect()}
    for t in (1, 2, 3):
        own = [r for r in rows if r[0] == t]
        for i, r in enumerate(own):
            before, after = own[i - 1] if i else None, own[i + 1] if i + 1 < len(own) else None
            assert got[(t, r[1])] == (before and before[2], after and after[2], before and before[1])
            assert numbers[(t, r[1])] == i + 1
    assert len(got) == len(rows) and neighbours(df.limit(0), "track_id", ["n"], ["text"]).count() == 0


@pytest.mark.parametrize("parts", [1, 7])
def test_ordered_scan(spark, parts):
    class Sum(Walker):
        def __init__(self):
            self.total = 0

        def feed(self, row):
            self.total += row[0]
            return [(self.entity, row[0], self.total)] if row[0] % 2 else []

        def finish(self):
            return [(self.entity, None, self.total)]

    rows = [(t, i) for t, n in ((1, 120), (2, 3), (3, 40)) for i in range(n)]
    df = spark.createDataFrame(rows, "e long, v int")
    got = sorted(map(tuple, ordered_scan(df, "e", ["v"], ["v"], Sum, "e long, v int, total long", parts).collect()), key=str)
    want = [(t, i, i * (i + 1) // 2) for t, i in rows if i % 2] + [(1, None, 7140), (2, None, 3), (3, None, 780)]
    assert got == sorted(want, key=str)


def test_repeats_and_duplicates(spark):
    seg = spark.createDataFrame([(1, 1, "Hola."), (1, 2, ""), (1, 3, "hola"), (1, 4, "..."), (1, 5, "..."), (1, 6, "hola")], "transcript_id long, seg_no int, text string")
    assert sorted(r.seg_no for r in neighbors.drop_repeats(seg, "transcript_id", ["seg_no"]).collect()) == [1, 4, 5, 6]
    long = "uno dos tres cuatro cinco seis siete"
    cues = spark.createDataFrame([(1, 1, 0, 1000, "alfa uno dos"), (1, 2, 1000, 2500, "uno dos tres cuatro cinco seis siete"), (1, 3, 2500, 4000, "cinco seis siete ocho"), (1, 4, 5000, 6000, "beta"), (1, 5, 6000, 9000, "Beta!"), (1, 6, 9000, 9500, "fin")], "track_id long, cue_no int, start_ms long, end_ms long, text string")
    got = {r.cue_no: r.end_ms for r in neighbors.remove_adjacent_duplicates(cues).collect()}
    assert got == {1: 1000, 2: 2500, 3: 4000, 4: 9000, 6: 9500}
    bridge = cues.withColumn("text", F.when(F.col("cue_no") == 1, F.lit("alfa uno dos tres")).otherwise(F.col("text")))
    bridge = bridge.withColumn("text", F.when(F.col("cue_no") == 3, F.lit("cuatro cinco seis siete ocho")).otherwise(F.col("text")))
    assert {r.cue_no: r.end_ms for r in neighbors.remove_adjacent_duplicates(bridge).collect()} == {1: 2500, 3: 4000, 4: 9000, 6: 9500}
    assert long


def test_redistribution(spark):
    assert neighbors.share_out("¡Es... escrita de su mano! Demasiado sublime...", "¡Es... escrita de su mano! Demasiado sublime... Nagao Buton?") == ("¡Es... escrita de su mano!", "Demasiado sublime... Nagao Buton?")
    assert neighbors.share_out("No", "Nosotros vamos") == ("No", "sotros vamos")
    df = spark.createDataFrame([(1, 1, "a b."), (1, 2, "a b. c d"), (1, 3, "c d e"), (2, 1, "x")], "track_id long, cue_no int, text string")
    assert sorted(map(tuple, neighbors.redistribute_prefixes(df).collect())) == [(1, 1, "a b.", True), (1, 2, "c d", True), (1, 3, "e", True), (2, 1, "x", False)]


def test_warnings(spark):
    df = spark.createDataFrame([(1, 1, 10.0, 11.0, "a"), (1, 2, 9.0, 8.0, "con Ã")], "p long, no int, s double, e double, t string")
    got = {r.no: r.warnings for r in neighbors.paragraph_warnings(df, "p", "no", "s", "e", "t").collect()}
    assert got == {1: [], 2: ["start not monotonic", "ends before start", "end not monotonic", "garbled sign"]}


def test_reflow(spark):
    body = "uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince dieciséis diecisiete dieciocho diecinueve veinte"
    df = spark.createDataFrame([(1, 1000, 9000, body), (2, 0, 100, ""), (3, 0, 300, "x" * 80 + " y " * 60), (4, None, 5, "a")], "cue_id long, start_ms long, end_ms long, text string")
    rows = folds.reflow_cues(df, ["cue_id"], width=34).orderBy("cue_id", "part_no").collect()
    first = [r for r in rows if r.cue_id == 1]
    assert len(first) > 1 and first[0].start_ms == 1000 and first[-1].end_ms == 9000
    assert all(a.end_ms == b.start_ms for a, b in zip(first, first[1:]))
    assert all(len(r.text.split("\n")) <= 2 and all(len(line) <= 34 or " " not in line for line in r.text.split("\n")) for r in rows)
    assert " ".join(" ".join(r.text.split()) for r in first) == body and all(r.end_ms <= 300 for r in rows if r.cue_id == 3)
    assert not [r for r in rows if r.cue_id in (2, 4)]


def test_timed_words(spark):
    words = [{"word": w, "start": i * 1.0, "end": i + 0.5} for i, w in enumerate("a b c d e f".split())] + [{"word": "lost", "start": None, "end": 9.0}, {"word": " ", "start": 1.0, "end": 2.0}]
    df = spark.createDataFrame([(1, words), (2, [])], "seg long, words array<struct<word:string,start:double,end:double>>")
    rows = folds.timed_word_cues(df, ["seg"], width=3, per_cue=1).orderBy("part_no").collect()
    assert [(r.text, r.start_ms, r.end_ms) for r in rows] == [("a b", 0, 1500), ("c d", 2000, 3500), ("e f", 4000, 5500)]


def test_paragraphs(spark):
    rows = [(1, 1, 0.0, 3.0, "Hola equipo."), (1, 2, 4.0, 7.0, "Este método mejora."), (1, 3, 196.0, 201.0, "La decisión prioriza."), (2, 1, 0.0, 1.0, "x" * 450 + "."), (2, 2, 1.0, 2.0, "y"), (2, 3, 2.0, 3.0, None)]
    df = spark.createDataFrame(rows, "transcript_id long, seg_no int, start_s double, end_s double, text string")
    got = sorted((r.transcript_id, r.para_no, r.start_s, r.end_s) for r in folds.build_paragraphs(df).collect())
    assert got == [(1, 1, 0.0, 7.0), (1, 2, 196.0, 201.0), (2, 1, 0.0, 1.0), (2, 2, 1.0, 2.0)]
    assert {r.section_no for r in folds.build_paragraphs(df, section_s=180.0).where("transcript_id = 1").collect()} == {1, 2}


def test_alignment(spark):
    got = folds.align_keys(["holaequipovamosaempezar", "", "otracosadistinta", "demás"], ["holaequipo", "vamosaempezar", "otracosadistinta"])
    assert [g[:3] for g in got] == [(0, 0, 1), (2, 2, 2)] and all(g[3] > folds.LOW for g in got)
    assert folds.align_keys(["abc"], ["", "zzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzz"])[0][3] == -1.0
    segments = spark.createDataFrame([(1, 1, 0.0, 1.0, "hola equipo"), (1, 2, 1.0, 2.0, "vamos a empezar"), (1, 3, 5.0, 6.0, "otra cosa distinta")], "transcript_id long, seg_no int, start_s double, end_s double, text string")
    said = spark.createDataFrame([(1, 1, "Hola equipo, vamos a empezar."), (1, 2, "Otra cosa distinta."), (1, 3, "de más"), (2, 1, "sin segmentos")], "transcript_id long, para_no int, text string")
    rows = sorted((r.para_no, r.start_s, r.end_s, r.low) for r in folds.align_paragraphs(said, segments).collect())
    assert rows == [(1, 0.0, 2.0, False), (2, 5.0, 6.0, False)]


def test_alignment_tries_few_places(monkeypatch):
    tried = []
    plain = folds.likeness
    monkeypatch.setattr(folds, "likeness", lambda a, b: tried.append(1) or plain(a, b))
    keys = [f"{'abcdefghijklmnop'[i % 16 :]}{i * 7919}" for i in range(200)]
    assert folds.align_keys(["".join(keys[5 * i : 5 * i + 5]) for i in range(40)], keys) == [(i, 5 * i, 5 * i + 4, 1.25) for i in range(40)]
    assert not tried
    dice = random.Random(7)
    for letters in ("ab", "abcdefgh", "abcdefghijklmnopqrstuvwxyz") * 60:
        keys = ["".join(dice.choices(letters, k=dice.choice([0, 1, 3, 10, 60]))) for _ in range(dice.randint(1, 30))]
        target = "".join(dice.choices(letters, k=dice.randint(1, 60))) if dice.random() < 0.4 else "".join(keys[2:9])[1:] or "a"
        # every place tried, as the original does
        ahead = ["".join(keys[k : k + folds.AHEAD]) for k in range(len(keys))]
        starts = [plain(target[:24], s[: len(target[:24])]) + 0.5 * (target[:24] in s) if s else -1.0 for s in ahead]
        assert folds.best_start(target[:24], keys) == starts.index(max(starts))
        said = ["".join(keys[: k + 1]) for k in range(len(keys))]
        said = said[: next((k for k, s in enumerate(said) if k and len(s) >= 1.25 * len(target)), len(said)) + 1]
        ends = [max(-1.0, plain(target, s) + 0.25 * (target in s or s in target) - 0.15 * (abs(len(s) - len(target)) / len(target))) if s else -1.0 for s in said]
        assert folds.best_end(target, keys) == (ends.index(max(ends)), max(ends))


def test_tracks(spark):
    df = spark.createDataFrame([("w", 1, 1, 500, False), ("w", 2, 2, 300, True), ("v", 1, 3, 5, False), ("v", 2, 4, 9, False)], "workspace string, stream_index int, track_id long, event_count int, is_default boolean")
    df = df.withColumns({"supported": F.lit(True), "textual": F.lit(True), "forced_like": F.lit(False), "cc_like": F.lit(False), "score": tracks.score_struct(F.lit(True), F.lit(True), F.lit(False), F.lit(False), F.col("event_count"), F.lit(99), F.lit(False))})
    assert {r.workspace: r.track_id for r in tracks.best_track(df).collect()} == {"w": 2, "v": 4}
    samples = spark.createDataFrame([(1, "es", 0.8), (1, "en", 0.95), (1, "es", 0.6)], "t long, language string, probability double")
    assert [(r.language, round(r.probability, 2)) for r in tracks.majority_language(samples, "t").collect()] == [("es", 0.7)]
    times = spark.createDataFrame([(20.0,), (100.0,)], "d double").select(tracks.probe_offsets(F.col("d")).alias("x")).collect()
    assert [r.x for r in times] == [[0.0], [3.5, 35.0, 63.0]]
    assert spark.range(1).select(tracks.remux_strategy(F.lit("Matroska, webm")).alias("x")).first().x == "mkvmerge-native"
    audio = spark.createDataFrame([("w", 1, "es", False), ("w", 2, "en", True), ("w", 3, "", True), ("v", 1, "fr", None)], "workspace string, ordinal int, code string, is_default boolean")
    assert sorted(map(tuple, tracks.audio_preferences(audio).collect())) == [("v", "fr", 0), ("w", "en", 0)]


def test_translation(spark):
    maps = spark.createDataFrame([(1, 1, {"3": "viejo", "4": "x", "St|0:0|0:1": "canto"}), (1, 2, {"3": "nuevo", "4": "  ", "other": "y"})], "track_id long, file_no int, entries map<string,string>")
    merged = translate.merge_maps(maps)
    assert sorted(map(tuple, translate.event_entries(merged).collect())) == [(1, 3, "nuevo"), (1, 4, "x")]
    assert [tuple(r) for r in translate.song_entries(merged).collect()] == [(1, "St", "0:0", "0:1", "canto")]
    lines = spark.createDataFrame([(1, 3, True, "Default", "", "{\\i1}old"), (1, 4, False, "Default", "", "kept"), (1, 5, True, "SongEnglish", "fx", "{\\k}a")], "track_id long, line_no int, in_events boolean, style string, effect string, raw string")
    got = {r.line_no: (r.outcome, r.raw) for r in translate.apply_translations(lines, translate.event_entries(merged), blank_song_letters=True).collect()}
    assert got == {3: ("translated", "{\\i1}nuevo"), 4: ("kept", "kept"), 5: ("blanked", "{\\k}")}
    assert translate.song_lines(translate.song_entries(merged)).first().layer == "99"


def test_latest_delivery(spark):
    df = spark.createDataFrame([(1, "a", "2026-01-01"), (1, "b", "2026-01-02"), (2, "c", None), (None, "d", "2026-01-01")], "k long, v string, ingested_at string")
    assert sorted(((r.k or 0), r.v) for r in latest_delivery(df, "k").collect()) == [(0, "d"), (1, "b"), (2, "c")]
