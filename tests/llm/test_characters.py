"""Consistent forms and wrong encodings: round trips and stated cases."""

from __future__ import annotations

import numpy as np
import pytest

from lexmill.llm import consistent, encoding, lookalikes
from lexmill.llm.charmodel import train
from tests.conftest import DATA

DOCS = "ord long, doc_id string, source string, url string, title string, text string, category string, batch int"


@pytest.fixture(scope="module")
def repairer(spark):
    return encoding.fit(spark.read.parquet(f"{DATA}/docs.parquet"), "ord", ["text", "title"])


@pytest.mark.parametrize(
    ("raw", "want"),
    [("ａｂｃ １２", "abc 12"), ("a​b\xadc", "abc"), ("é", "é"), ("x̄", "x̄"), ("m² CO₂", "m² CO₂"), ("ﬁn", "fin"), ("a　b\xa0c", "a b c"), ("ｶﾞ", "ガ"), ("？！", "？！"), ("می‌توان", "می‌توان"), ("", ""), ("𝐛old", "bold")],
)
def test_characters(raw, want):
    assert lookalikes.normalise_characters(raw) == want


def test_lattices_keep_symbols_and_scripts(spark, repairer):
    forms = lookalikes.Consistent(repairer.model)
    assert forms.form("the mаgnetic fiеld") == "the magnetic field"
    for kept in ("the κ-statistic of TKNα", "x̄ = 3", "«Не нужно», — писал", "", None, "plain"):
        assert forms.form(kept) == kept


def test_lattices_cover_rare_scripts(repairer):
    forms = lookalikes.Consistent(repairer.model)
    words = {"Ꭺmong": "Among", "Ꭺbb.": "Abb.", "Ꮃe": "We", "Ꮃhether": "Whether", "Ꭺmbrell": "Ambrell", "Ꭺrrɑy": "Array", "Ꮃexӏund": "Wexlund", "ꓮmong": "Among", "ⲟther": "other", "mჿdel": "model", "mഠdel": "model", "sהare": "sהare"}
    assert {w: forms.form(w) for w in words} == words
    assert forms.form("the ⲟther mоdel of Ꭺ share") == "the other model of A share"
    for kept in ("ᏣᎳᎩ ᎦᏬᏂᎯᏍᏗ", "برنامه DNAها نشت", "ها DNAه ها", "𐐄 😀"):
        assert forms.form(kept) == kept


def test_words_come_out_in_one_script(spark):
    model = encoding.fit(spark.read.parquet("/root/testdata/sf0.01/docs.parquet"), "ord", ["text", "title"]).model
    forms = lookalikes.Consistent(model)
    words = {"рaypal": "paypal", "Росcия": "Россия", "Ꮪience": "Sience", "ʀesult": "result", "ⲟrange": "orange", "fiеld": "field"}
    assert {w: forms.form(w) for w in words} == words
    assert forms.form("МОСKВА") in ("МОСКВА", "MOCKBA")
    for kept in ("TKNα", "κ-статистика", "IgG-анализ", "DNA-тест"):
        assert forms.form(kept) == kept


@pytest.mark.parametrize(("read", "written"), [("cp1252", "utf-8"), ("mac_roman", "utf-8"), ("cp850", "utf-8"), ("cp1251", "utf-8"), ("mac_roman", "cp1252")])
def test_encoding_round_trip(repairer, read, written):
    text = "Öhlen schrieb über die Region Övrehed für Brévane und Kärsund, während Sollén in Korvéni war."
    damaged = text.encode(written, "ignore").decode(read, "replace").replace("�", "")
    (affected, restored), (clean, same) = repairer.repair_all([damaged, text])
    assert affected and not clean and same == text
    if written == "utf-8" and len(damaged.encode(read, "ignore")) == len(text.encode(written)):
        assert restored == text


def test_margins_count_all_words_as_if_never_met(spark):
    df = spark.range(20_000).selectExpr("id", "concat('kälta', char(97 + id % 26)) as text", "concat('kõrs', char(97 + id % 26), char(97 + id % 23)) as title")
    one, other = (encoding.fit(df.repartition(n), "id", fields) for n, fields in ((3, ["text", "title"]), (9, ["title", "text"])))
    assert one.margins == pytest.approx(other.margins)
    _, words = encoding.train(df.selectExpr("explode(array(text, title)) as value"), encoding.clean_words)
    gains = {0: [], 1: []}
    for fold, word in words.collect():
        best = encoding.Repairer(one.model.without(fold), encoding.LEAST_MARGINS).gains([word])[0]
        for k in (0, 1):
            if np.isfinite(best[k][1]) and not (k and one.model.times(best[k][0]) >= 1):
                gains[k].append(max(best[k][1], 0.0))
    assert sum(map(len, gains.values())) > 300 and len(words.collect()) == 26 + 26 * 23
    for k, found in gains.items():
        want = max(encoding.LEAST_MARGINS[k], np.quantile(found, 1 - encoding.PASSING)) if found else encoding.LEAST_MARGINS[k]
        assert one.margins[k] == pytest.approx(want, abs=0.01)


# Ordinary words of ten languages and some names, signs and quotations that look like traces of a wrong encoding.
CLEAN_WORDS = """
naïve façade Hôtel Señor Škoda СССР Łódź café résumé fiancée crème brûlée déjà élève théâtre garçon forêt île où noël œuvre cœur français État âge être août maïs haïr ambiguë Zoë Citroën
größer Straße Mädchen über schön Öl Ärzte Übung fließen weiß heiß Fuß Gefühl können Äpfel Büro natürlich Köln München Österreich Gänse Söhne Brücke Schlüssel Träume Nürnberg Grüße Jäger hätte Hätte HÄTTE
niño mañana corazón árbol también después español año señal lingüística pingüino rápido público número músico débil fácil túnel inglés país aquí Ángel Núñez Muñoz razón canción educación
coração não ação pão mãe irmã avó avô você português são três água história ciência família João Conceição Gonçalves Simões mês à às até após difícil última próxima órgão bênção questões
привет мир Россия Москва человек время жизнь день рука год работа слово место лицо друг вопрос дом сторона страна голова ребёнок сила конец система часть город отношение женщина деньги земля машина проблема право решение образ история власть закон война тысяча возможность результат ночь область развитие процесс средство начало форма связь минута вечер качество месяц государство любовь школа общество деятельность программа ДНК США МГУ Пётр чёрный Тёмный щётка объём съезд ЮНЕСКО
سلام كتاب مدرسة جامعة العربية اللغة القاهرة مسؤول کتاب دانشگاه ایران فارسی می‌روم پژوهش नमस्ते भारत हिन्दी विद्यालय पुस्तक सूर्य 日本語 東京 コンピューター データベース 研究者 病院 中国 北京 经济 历史 数据库 很重要。
Dvořák Brzeziński Škvorecký Čapek Žižka Kraków Wałęsa Gdańsk Erdős Szabó Győr Björk Ångström Malmö Tromsø København Søren Reykjavík Þór İstanbul Atatürk Çelik Gökçe Đorđe Živković Čačak Brânză București
α-helix β-lactam γ-ray μm Δt TKNα tknα χ² Ω-3 10µm 37°C ±5 ≤3 ×10 m² CO₂ x̄ “quoted” ‘single’ don’t it’s l’école d’études l’été Müller’s «École» „Größe“ „Spaß“ “É” «США» «ДНК» 50€ §3 ½ ™ ©
"""


def test_clean_words_in_many_languages_stay(spark):
    repairer = encoding.fit(spark.read.parquet("/root/testdata/sf0.01/docs.parquet"), "ord", ["text", "title"])
    words = CLEAN_WORDS.split()
    flagged = [w for w, (affected, _) in zip(words, repairer.repair_all(words)) if affected]
    assert len(words) > 280 and not flagged
    assert repairer.repair_all([CLEAN_WORDS]) == [(False, CLEAN_WORDS)]


def test_common_words_beside_apostrophes_and_quotations(spark):
    """Words whose apostrophe and letter look like a sequence are never learned; common as they are, none is flagged, at any size of the text."""
    docs = spark.read.parquet("/root/testdata/sf0.01/docs.parquet").select("ord", "title", "text")
    odd = "l’école d’études l’été «École» „Spaß“ «США» Пётр"
    many = spark.range(20_000).selectExpr("-id as ord", "'x' as title", f"concat('Le {odd} de la ville ', id) as text")
    repairer = encoding.fit(docs.union(many), "ord", ["text", "title"])
    assert [a for a, _ in repairer.repair_all([odd, *odd.split(), "KorvÃ©ni"])] == [False] * (1 + len(odd.split())) + [True]


def test_parts_of_a_text_without_spaces(repairer):
    text = "结果令人意外，血压变化没有受到肾脏功能的影响。"
    damaged = text[:7] + text[7:].encode("gbk").decode("cp1252", "replace")
    assert repairer.repair_all([damaged])[0][0] and not repairer.repair_all([text])[0][0]


def test_twice_damaged_lost_and_empty(repairer):
    text = "Kärsund und Brévane"
    twice = text
    for _ in range(2):
        twice = twice.encode("utf-8").decode("latin-1")
    assert repairer.repair_all([twice])[0] == (True, text)
    assert [a for a, _ in repairer.repair_all(["a�b", "", None, "x" * 100_000, "plain"])] == [True, False, False, False, False]


def test_tables_with_nulls_repeats_and_extra_columns(spark, repairer):
    rows = [(1, "d", "s", None, None, None, None, 0), (1, "d", "s", None, "KÃ¤rsund", "", None, 0), (1, "d", "s", None, "KÃ¤rsund", "", None, 0)]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as id", "2 as affected")
    out = encoding.repaired(df, "ord", ["text", "title"], repairer).collect()
    assert sorted((r.field, r.affected) for r in out) == [("text", False), ("text", False), ("title", True), ("title", True)]
    assert encoding.repaired(df.limit(0), "ord", ["text"]).count() == 0
    tasks = spark.createDataFrame([("t", "tһe Index", ["a​b", None], 1), ("n", None, None, 2)], "task_id string, answer string, aliases array<string>, form int")
    docs = spark.read.parquet(f"{DATA}/docs.parquet")
    forms = {(r.row_key, r.field, r.place): (r.form, r.changed) for r in consistent.consistent_forms(docs, tasks).where("tbl = 'tasks'").collect()}
    assert forms == {("t", "answer", 0): ("the Index", True), ("t", "aliases", 0): ("ab", True)}


def test_model_prefers_what_it_saw(spark):
    model = train(spark.createDataFrame([("abc abd " * 50,), (None,), ("",)], "v string"), lambda t: (t.split(), [], []))[0]
    seen, unseen = model.score(["abc", "xqz"])
    assert seen > unseen and len(model.score([])) == 0


def test_candidates_are_all_outcomes():
    word = "Ångström’s"
    for read in ("latin-1", "cp1252", "latin-1", "cp1252")[: encoding.ROUNDS]:
        word = word.encode().decode(read, "replace")
    found, edge = set(), {word}
    for _ in range(encoding.ROUNDS):
        edge = {b for w in edge for read in encoding.SEQUENCES_READ_IN if (b := encoding._utf8_back(w, read)) is not None} - found - {word}
        found |= edge
    wanted = {w for w in found if encoding._likely_text(w) and not encoding._torn(word, w)}
    assert "Ångström’s" in wanted and set(encoding.candidates(word)[0]) == wanted


def test_long_words_are_restored_in_arrays_as_sequences_are(monkeypatch):
    text = "結果は驚くべきもの，№7🙂ñandú߿ࠀ€" * 9
    words = [text.encode().decode(a, "replace").encode("utf-8", "ignore").decode(b, "replace") for a in ("latin-1", "cp1252", "mac_roman") for b in ("latin-1", "cp437", "cp1252")]
    words += [text.encode().decode("latin-1"), "\xed\xa0\x80\xe0\x80\x80\xf4\x90\x80\x80Ã©\xc2" * 20, "x\xc3" * 40, "ÐÑ" * 50, "é" * 100]
    with monkeypatch.context() as m:
        m.setattr(encoding, "_restored", lambda *_: pytest.fail("sequence by sequence"))
        got = [encoding._all_back(w) for w in words]
    monkeypatch.setattr(encoding, "LONG", 1 << 30)
    assert got == [list(dict.fromkeys(encoding._all_back(w))) for w in words] and all(got[:10])
    assert text in got[9]
