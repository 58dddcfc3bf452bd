from __future__ import annotations

import random
from math import log2

import pytest

from siftstone.llm.language import Coder, LANGUAGES, Trees, blocks_of, fit, identify, named_language, natural, sample_of

SENTENCES = {
    "en": ["The quick check found an open door.", "We should close the file before the merge.", "Nobody notices the changed order today."],
    "es": ["La revisión rápida encontró una puerta abierta.", "Deberíamos cerrar el archivo antes de la fusión.", "Nadie nota hoy el pedido modificado."],
    "pt": ["A verificação rápida encontrou uma porta aberta.", "Devemos fechar o arquivo antes da junção.", "Ninguém percebe hoje o pedido alterado."],
    "fr": ["La vérification rapide a trouvé une porte ouverte.", "Nous devrions fermer le fichier avant la fusion.", "Personne ne remarque la commande modifiée."],
    "de": ["Die schnelle Prüfung fand eine offene Tür.", "Wir sollten die Datei vor dem Zusammenführen schließen.", "Niemand bemerkt heute die geänderte Bestellung."],
    "it": ["Il controllo rapido ha trovato una porta aperta.", "Dovremmo chiudere il file prima dell'unione.", "Nessuno nota oggi l'ordine modificato."],
    "ru": ["Быстрая проверка нашла открытую дверь.", "Нам следует закрыть файл до слияния.", "Сегодня никто не заметит изменённый заказ."],
}


@pytest.fixture(scope="module")
def trees():
    sample = [(" ".join(s), lang) for lang, s in SENTENCES.items()] * 4
    return fit(sample + [(SENTENCES["de"][0], "en"), (SENTENCES["en"][1] + "\n\n" + SENTENCES["ru"][0], "fr")])


@pytest.mark.parametrize(
    ("label", "lang"),
    [("en", "en"), ("EN", "en"), ("en-US", "en"), ("en_GB", "en"), ("Deutsch", "de"), ("русский", "ru"), ("fra", "fr"), ("pt-BR", "pt"), (" it ", "it"), ("unknown", None),
     ("", None), (None, None), ("nl", None), ("python", None), ("es-419", "es"), ("??", None), ("français", "fr"), ("english-ish words", None)],
)
def test_labels(label, lang):
    assert named_language(label) == lang


def test_blocks():
    assert blocks_of("a\r\nb\r\n \t\r\n\r\nc\n\n```x\ny\n```") == ["a\nb", "c", "```x\ny\n```"]
    assert blocks_of(" \n\n") == [] == blocks_of("")


def test_natural_words():
    assert [natural(t) for t in ("Word", "ÉTÉ", "camelCase", "a_b", "x1", "`q`", "ok")] == ["word", "été", None, None, None, None, "ok"]


def test_code_lengths_are_those_of_a_proper_code(trees):
    for context in (b" ", b" th", b"zz", " é".encode()):
        for lang in LANGUAGES:
            total = sum(2.0 ** -trees._bits(trees.nodes[lang], context[-4:], s) for s in range(256))
            assert total == pytest.approx(1.0, abs=1e-9) or total < 1


def test_escape_by_hand():
    t = Trees({"en": __import__("collections").Counter({"ab": 1})})
    # order 1 context " " saw a once (escape 1/2), order 0 saw a, b and the end once each
    assert t._bits(t.nodes["en"], b" ", ord("a")) == pytest.approx(log2(2))
    assert t._bits(t.nodes["en"], b" ", ord("b")) == pytest.approx(log2(2) + log2(4))
    assert Coder(t).sentences([])[0].shape == (0, 7)


def test_held_out_sentences(trees):
    r = random.Random(1)
    right = 0
    for lang, sentences in SENTENCES.items():
        for _ in range(20):
            words = [w for s in sentences for w in s.rstrip(".").split()]
            text = " ".join(r.sample(words, 6))
            bits, _ = Coder(trees).sentences([text.upper() if r.random() < 0.3 else text])
            right += LANGUAGES[int(bits.argmin())] == lang
    assert right / 140 > 0.95


def test_identify(spark, trees):
    text = {k: " ".join(v) for k, v in SENTENCES.items()}
    rows = [
        (1, text["en"], "en"), (2, text["de"], "EN"), (3, text["fr"] + "\n\n" + text["it"] + " " + text["it"] + "\r\n\r\n```\nthe code is here\n```", "fr"), (4, None, "en"), (5, " \n", None),
        (6, "```\nthe code\n```", "en"), (7, "123 `foo`", None), (8, text["es"] + "\n«" + SENTENCES["en"][0] + "»", None), (8, text["es"], None), (9, (text["ru"] + "\n\n") * 3000, "ru"),
    ]
    got = identify(spark.createDataFrame([(*r, 0) for r in rows], "doc int, text string, lang string, block_no int"), trees, "doc", "text", "lang").collect()
    whole = {(r["id"], r["lang"], r["labelled"], r["mixed"]) for r in got if r["block_no"] == 0}
    assert whole == {(1, "en", "en", False), (2, "de", "en", False), (3, "it", "fr", True), (8, "es", None, False), (9, "ru", "ru", False)}
    assert [(r["block_no"], r["lang"]) for r in sorted(got, key=lambda r: r["block_no"]) if r["id"] == 3 and r["block_no"]] == [(1, "fr"), (2, "it")]
    assert len([r for r in got if r["id"] == 8 and r["block_no"] == 0]) == 2 and all(0 < r["confidence"] <= 1 for r in got)
    assert len([r for r in got if r["id"] == 9]) == 3001


def test_no_labels(spark):
    df = spark.createDataFrame([(1, "some text", None)], "id int, text string, lang string")
    trees = fit(sample_of(df, "id", "text", "lang"))
    assert identify(df, trees, "id", "text", "lang").count() == 2
    assert identify(df.limit(0), trees, "id", "text", "lang").count() == 0


def test_store_may_be_emptied_at_any_word(trees, monkeypatch):
    from siftstone.llm import language

    monkeypatch.setattr(language, "STORE", 50)
    words = [a + b for a in "abcdefghij" for b in ("ein", "der", "the", "los", "une")]
    texts = [f"{first} " + " ".join(words[k : k + 40]) for k in range(0, 50, 5) for first in ("7", "`x`", "snake_case", "Wort")]
    small = Coder(trees)
    for size in (1, 3, 40):
        for k in range(0, len(texts), size):
            bits, letters = small.sentences(texts[k : k + size])
            want_bits, want_letters = Coder(trees).sentences(texts[k : k + size])
            assert bits == pytest.approx(want_bits) and letters.tolist() == want_letters.tolist()
    many = " ".join(f"{a}{b}{c}" for a in "abcdefghijklm" for b in "abcdefghijklm" for c in "abcdefghijklmnop")
    small.sentences([many])
    bits, letters = small.sentences(["12 " + many])
    assert letters[0] == 3 * 13 * 13 * 16
