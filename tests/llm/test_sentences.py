import random

import pytest

from viewgraph.llm import sentences as sn
from viewgraph.llm.sentences import sentence_spans, sentences

CASES = {
    "first line whole": ("Bump to v6.4. Keep it\n\nIt works. Now test!", ["Bump to v6.4. Keep it", "It works.", "Now test!"]),
    "abbreviations": ("S\n\nSee Fig. 8 and sec. 35.26 by Dr. Yoltz, e.g. here. The U.S. mirror fell at 5 p.m. It hung!!!", ["S", "See Fig. 8 and sec. 35.26 by Dr. Yoltz, e.g. here.", "The U.S. mirror fell at 5 p.m.", "It hung!!!"]),
    "initials and units": ("S\n\nBy J. R. Brask in 5 ms. Cold runs follow.", ["S", "By J. R. Brask in 5 ms.", "Cold runs follow."]),
    "wrapped": ("S\n\nOne goes\non here. Two\nends.", ["S", "One goes\non here.", "Two\nends."]),
    "code opens": ("S\n\nIt is. readGrid() ends. pick_pair does not. `a.b()` too.", ["S", "It is.", "readGrid() ends.", "pick_pair does not.", "`a.b()` too."]),
    "quoted": ('S\n\nHe wrote: "Keep it. Now." See this. "Why?" was asked. (It stays. So.) End', ["S", 'He wrote: "Keep it. Now."', "See this.", '"Why?" was asked.', "(It stays. So.)", "End"]),
    "list": ("S\n\n1. One. Two\n2. Three\n   more\n- a\n* b\n\nticket no.\n7. Then", ["S", "One.", "Two", "Three\n   more", "a", "b", "ticket no.", "Then"]),
    "trailers": ("S\n\nBody. Signed: no\n\nSigned-off-by: a. b <c@d.e>\nFixes: #1. 2\n(cherry picked from commit ab12)", ["S", "Body.", "Signed: no", "Signed-off-by: a. b <c@d.e>", "Fixes: #1. 2", "(cherry picked from commit ab12)"]),
    "german": ("S\n\nAm 3. Mai z. B. um 8.30 Uhr. »Weg damit!«, hieß es. „Warum?“, fragte Fr. Brask in Nr. 5. Ende usw. Das war es.", ["S", "Am 3. Mai z. B. um 8.30 Uhr.", "»Weg damit!«, hieß es.", "„Warum?“, fragte Fr. Brask in Nr. 5.", "Ende usw.", "Das war es."]),
    "french": ("S\n\nFaut-il ? Il disait « perdu. Essai. » puis fin. Elle a écrit : « Gardez. » Le reste va.", ["S", "Faut-il ?", "Il disait « perdu. Essai. » puis fin.", "Elle a écrit : « Gardez. »", "Le reste va."]),
    "russian": ("S\n\n«Зачем?» — спросил г-н Б. В 2024 г. кэш пал, т. е. исчез. Ждали… и ждали. Всё.", None),
    "spanish": ("S\n\n¿Seguro? ¡No llamar! La Dra. Sol avisó a las 5 p. m. del fallo en EE. UU. y fin.", ["S", "¿Seguro?", "¡No llamar!", "La Dra. Sol avisó a las 5 p. m. del fallo en EE. UU. y fin."]),
    "greek": ("S\n\nΧρειάζεται ακόμη; Βλ. σχ. 1 του κ. Brask. Τέλος.", ["S", "Χρειάζεται ακόμη;", "Βλ. σχ. 1 του κ. Brask.", "Τέλος."]),
    "semicolon": ("S\n\nOpen it; Close it. End.", ["S", "Open it; Close it.", "End."]),
    "chinese": ("S\n\n安全吗？！等了……才好。日志写着“丢失。重试。”，停了。他写道：“保留。”不要。（不变。）好", ["S", "安全吗？！", "等了……才好。", "日志写着“丢失。重试。”，停了。", "他写道：“保留。”", "不要。", "（不变。）", "好"]),
    "japanese": ("S\n\nログに「ない。再。」と出た。図8の（未。後。）も。", ["S", "ログに「ない。再。」と出た。", "図8の（未。後。）も。"]),
    "korean": ('S\n\n로그에 "없음. 다시."라고 남았다. v0.2부터 빠르다. 끝', ["S", '로그에 "없음. 다시."라고 남았다.', "v0.2부터 빠르다.", "끝"]),
    "hindi": ('S\n\nलॉग में "खो गया। फिर।" लिखा था। डॉ. Brask आए। क्या?', ["S", 'लॉग में "खो गया। फिर।" लिखा था।', "डॉ. Brask आए।", "क्या?"]),
    "arabic": ("S\n\nورد «مفقود. أعد.» ثم توقف. هل عمل؟ راجع د. Brask الآن", ["S", "ورد «مفقود. أعد.» ثم توقف.", "هل عمل؟", "راجع د. Brask الآن"]),
    "thai": ("S\n\nตอนนี้ fuse ใช้ 5 วินาที แก้ไขแล้ว\nดีมาก", ["S", "ตอนนี้ fuse ใช้ 5 วินาที", "แก้ไขแล้ว", "ดีมาก"]),
    "unmatched quote": ('S\n\nIt said "lost. Then it ended.', ["S", 'It said "lost.', "Then it ended."]),
    "blank": ("  \n\n \n", []),
}


@pytest.mark.parametrize("name", CASES)
def test_sentences(name):
    text, want = CASES[name]
    got = [text[a:b] for a, b in sentences(text)]
    if want is not None:
        assert got == want
    assert all(s and s == s.strip() for s in got)
    assert "".join("".join(got).split()).replace("-", "").replace("*", "") in "".join(text.split()) or "list" in name or want is None or len(got) > 1


def test_long_text_is_whole():
    text = "S\n\n" + "A sentence e.g. this. " * 3000
    assert len(sentences(text)) == 3001


def test_spans(spark):
    rows = [(1, "ab: S\n\nIt is. Über. tail", 4, 19), (2, None, 0, 5), (3, "x", None, None), (4, "x", 1, 1), (5, "One. Two", 0, 99), (6, "𝒳 Hi", 0, 4), (None, "S", 0, 1), (7, "x", -3, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, a int, b int").selectExpr("*", "1 AS doc", "2 AS sent_start")
    out = sentence_spans(df, "doc_id", "text", "a", "b").collect()
    assert {(r.doc, r.sent_start, r.sent_end) for r in out} == {(1, 4, 5), (1, 7, 13), (1, 14, 19), (5, 0, 8), (6, 0, 4), (None, 0, 1), (7, 0, 1)}
    assert sentence_spans(df.limit(0), "doc_id", "text", "a", "b").collect() == []


@pytest.mark.parametrize("n", [100, 249, 250, 5000])
def test_abbreviations_of_any_number_end_nothing(n):
    text = "S\n\nWe list " + "Dr. Smith, " * n + "and others. End here."
    assert len(sentences(text)) == 3


def test_balance_is_a_term_of_the_score(monkeypatch):
    text = 'S\n\nHe said "' + "One is. " * 20 + 'So." and left. End.'
    assert len(sentences(text)) == 3
    monkeypatch.setattr(sn, "_CROSSED", 0)
    assert len(sentences(text)) > 20


@pytest.mark.parametrize("n", [240, 260, 300, 1000])
def test_semicolons_hide_no_end(n):
    first = "Items are " + "item; " * n + "last."
    text = f"S\n\nIt ran. {first} Then it ended. Now test! Done?"
    assert [text[a:b] for a, b in sentences(text)] == ["S", "It ran.", first, "Then it ended.", "Now test!", "Done?"]


def _all_spans(text):
    """The best cut by trying every span; of equal scores the latest start wins."""
    ends = sn.cuts(text, sn.pairs_of(text))
    starts = [0] + [c.next for c in ends[:-1]]
    best, back = [0] + [None] * len(ends), [0] * (len(ends) + 1)
    for j, cut in enumerate(ends):
        for i in range(j, -1, -1):
            length, n = cut.end - starts[i], len(sn._GREEK.findall(text[starts[i] : cut.end]))
            if best[i] is None or cut.greek and not n or cut.score <= -6 and j + 1 < len(ends):
                continue
            s = best[i] + round(cut.score * 1000) + (-1500 if length < 4 else -2 * max(0, length - 400))
            s -= sn._unbalanced(text, cut) if cut.quote_start > starts[i] else 0
            s -= 2 * sn._CROSSED * cut.depth
            if best[j + 1] is None or s > best[j + 1]:
                best[j + 1], back[j + 1] = s, i
    out, j = [], len(ends)
    while j:
        out.append((starts[back[j]], ends[j - 1].end))
        j = back[j]
    return out[::-1]


def test_the_recurrence_is_exact():
    rng = random.Random(5)
    words = ["item;", "item;", "See", "fig.", "Dr.", "e.g.", "ran.", "λέξη", "τέλος;", "Now!", '"Why? no."', "(It", "is.)", "«Да. Нет.»", "said:", "read_it()", "安全。", "ใช้", "แล้ว", "U.S.", "5", "Ünd", "x" * 120, "“" + "long text " * 50 + "here.”"]
    for n in [5] * 200 + [60] * 100 + [400] * 4:
        text = " ".join(rng.choices(words, [rng.random() ** 3 for _ in words], k=n))
        assert sn.segment(text) == _all_spans(text)
