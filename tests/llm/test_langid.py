"""Language identification: held-out accuracy, what is no prose, labels, damaged and odd texts."""

import random
from collections import Counter

import pyarrow.parquet as pq
import pytest

from plumbline.llm import langid as L
from plumbline.llm import queries
from tests.conftest import MIDDLE

TABLE = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "text", "lang"]).to_pylist()


@pytest.fixture(scope="module")
def labelled():
    per = {}
    for r in random.Random(1).sample(TABLE, 6000):
        code = L.label_language(r["lang"])
        if code and r["text"] and len(per.setdefault(code, [])) < 120 and len(r["text"]) < 2500:
            per[code].append(r["text"])
    return per


@pytest.fixture(scope="module")
def profiles(labelled):
    return L.fit_profiles([(code, t) for code, texts in labelled.items() for t in texts[: len(texts) // 2]])


def test_held_out_documents_have_the_language_that_their_label_names(labelled, profiles):
    """Held out are the other halves; few labels are wrong, so almost all documents hold their label's language."""
    right = {}
    for code, texts in labelled.items():
        held = [f for t in texts[len(texts) // 2 :] if (f := L.sentences(t))]
        right[code] = sum(code in {L.LANGUAGES[b] for b in profiles.classify([w for _, _, w in f])[0]} for f in held) / len(held)
    assert len(right) == 11 and min(right.values()) > 0.7 and sum(right.values()) / 11 > 0.88, right


CLEAN = {
    "en": "The nightly analysis still depends on an old package although all tests are green.",
    "de": "Die nächtliche Analyse hängt noch von einem alten Paket ab, obwohl alle Tests grün sind.",
    "nl": "De nachtelijke analyse hangt nog af van een oud pakket, hoewel alle tests groen zijn.",
    "sv": "Den nattliga analysen beror fortfarande på ett gammalt paket, trots att alla tester är gröna.",
    "fr": "L'analyse nocturne dépend encore d'un ancien paquet bien que tous les tests passent.",
    "es": "El análisis nocturno todavía depende de un paquete antiguo aunque todas las pruebas pasan.",
    "pt": "A análise noturna ainda depende de um pacote antigo embora todos os testes passem.",
    "it": "L'analisi notturna dipende ancora da un vecchio pacchetto benché tutti i test siano verdi.",
    "pl": "Nocna analiza nadal zależy od starego pakietu, chociaż wszystkie testy są zielone.",
    "ru": "Ночной анализ по-прежнему зависит от старого пакета, хотя все тесты проходят.",
    "ja": "テストはすべて成功していますが、夜間の解析はまだ古いパッケージに依存しています。",
}


def test_each_language_plain_damaged_and_in_capitals(profiles):
    for code, text in CLEAN.items():
        shapes = [text, text.upper(), text.lower(), text.replace(" ", "\xa0"), "/// " + text, "* " + text, text + " 🚨🔴", text + "​", "\x1b[31m" + text + "\x1b[0m", text.encode().decode("cp1252", "ignore") if code in ("fr", "de", "es") else text]
        for shape in shapes:
            found = L.sentences(shape)
            best, lead = profiles.classify([w for _, _, w in found])
            assert [L.LANGUAGES[b] for b in best] == [code] and lead[0] > L.CLEAR, shape


def test_what_is_no_prose():
    for text in ["", "  ", "# The next steps of the analysis.", "```csharp\nThe type needs a smaller public surface.\n```", "| The type needs | a smaller surface. |", "var x = y ?? Get(3, 4);", "TODO: pull request", "LGTM", "src/A.B/C.cs(3,4): CS9101", "0x12 #536 25c94265.", "ResolveRatio TokenDto.cs `a b c d e f g.`", "won't fix", "```\nnever closed. It goes on and on here."]:
        assert L.sentences(text) == [], text


def test_line_comments_are_judged_by_their_text(profiles):
    for code, text in CLEAN.items():
        for mark in ("// ", "//", "    // "):
            found = L.sentences(f"var x = 1;\n{mark}{text}\n")
            assert [f"var x = 1;\n{mark}{text}\n"[b:e] for b, e, _ in found] == [text], mark + text
            assert [L.LANGUAGES[b] for b in profiles.classify([w for _, _, w in found])[0]] == [code]
    for text in ["// var total = Sum(a, b, c);", "// if (the type is public) {", "// }", "// the next steps of the analysis", "// src/A.B/C.cs(3,4): CS9101", "//", "```csharp\n// The type needs a smaller public surface.\n```"]:
        assert L.sentences(text) == [], text


def test_positions_are_of_the_text(profiles):
    text = f"# Title\n\n{CLEAN['de']} {CLEAN['en']}\n```\ncode here.\n```\n{CLEAN['ja']}"
    found = L.sentences(text)
    best, lead = profiles.classify([w for _, _, w in found])
    got = L.segments_of(found, best, lead)
    assert [(text[b:e], lang) for b, e, lang, _, _ in got] == [(CLEAN[c], c) for c in ("de", "en", "ja")]
    assert all(0 < x <= 1 for _, _, _, x, _ in got)


def test_labels():
    for label, code in {"EN": "en", "en_GB": "en", "pt-BR": "pt", "Deutsch": "de", "Français": "fr", "jpn": "ja", " Spanish ": "es", "ger": "de", "Portuguese (Brazil)": "pt"}.items():
        assert L.label_language(label) == code
    assert {L.label_language(x) for x in (None, "", " ", "und", "xx", "n/a", "unknown", "-", "xx-DE", "??", "en, de")} == {None}
    for label, codes in {"Franc\u0327ais": ["fr"], "FRANCAIS": ["fr"], "Brazilian Portuguese": ["pt"], "lang=de": ["de"], "en_US.UTF-8": ["en"], "[nl]": ["nl"], "ドイツ語": ["de"], "en / German": ["de", "en"], "ＳＶ": ["sv"], "pt (Brasil), es-419": ["es", "pt"]}.items():
        assert L.label_languages(label) == codes, label
    assert sum(map(len, L.NAMES.values())) < 200


def test_all_languages_of_a_label_are_named(spark, profiles):
    text = f"{CLEAN['de']} {CLEAN['de']}\n{CLEAN['en']} {CLEAN['en']}\n{CLEAN['ru']}"
    df = spark.createDataFrame([(1, text, "de; English"), (2, text, None), (3, text, "xx")], "doc_id long, text string, lang string")
    found = L.unnamed_languages(L.language_segments(df, profiles)).collect()
    assert sorted((r["doc_id"], r["lang"]) for r in found) == [(1, "ru"), *[(d, c) for d in (2, 3) for c in ("de", "en", "ru")]]


def test_documents_with_nulls_repeats_and_a_very_long_text(spark, profiles):
    long = " ".join([CLEAN["fr"]] * 4000)
    data = [(1, None, "en"), (2, "", None), (3, CLEAN["en"], "English"), (3, CLEAN["en"], "English"), (4, CLEAN["en"], "de"), (5, long + "\n" + CLEAN["pl"], "fr-FR"), (6, CLEAN["ru"], None), (7, "Código: 1.", "es")]
    df = spark.createDataFrame([(*r, "clash") for r in data], "doc_id long, text string, lang string, segment string")
    segments = L.language_segments(df, profiles)
    assert sorted(map(tuple, L.unnamed_languages(segments).collect())) == [(4, "en"), (5, "pl"), (6, "ru")]
    assert {r["doc_id"]: r["lang"] for r in L.document_languages(segments).collect()} == {3: "en", 4: "en", 5: "fr", 6: "ru"}
    assert L.language_segments(df.limit(0), profiles).count() == 0


def test_sample_is_bounded_and_whole_query_agrees_with_labels(spark):
    df = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    sample = L.labelled_sample(df, per_language=5)
    assert max(Counter(c for c, _ in sample).values()) <= 5
    found = queries.p9_found(spark, MIDDLE)
    assert 0 < found.count() < 0.4 * df.count() and found.distinct().count() == found.count()


def test_no_labels_at_all_gives_no_languages(spark):
    df = spark.createDataFrame([(1, CLEAN["en"], None)], "doc_id long, text string, lang string")
    assert L.language_segments(df).count() == 0


def test_every_document_has_a_language(spark, profiles):
    texts = [None, "", "  ", "```csharp\nvar x = 1;\n```", "0x12 #536", "# " + CLEAN["de"][:-1], CLEAN["fr"], "Der nächtliche Bericht zählt alle Warnungen"]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in L.document_languages(L.language_segments(df, profiles, every=True)).collect()}
    assert [got[i]["lang"] for i in range(len(texts))] == ["und"] * 5 + ["de", "fr", "de"]
    assert [got[i]["confidence"] > 0 for i in range(len(texts))] == [False] * 6 + [True, False] and got[6]["share"] == 1.0
    blank = df.where("doc_id < 3")
    assert L.document_languages(L.language_segments(blank, profiles, every=True)).count() == 3 and L.language_segments(blank, profiles).count() == 0
    assert queries.p9_documents(spark, MIDDLE).count() == spark.read.parquet(f"{MIDDLE}/documents.parquet").count()
