"""Scalar rules: expectations worked out from the rules, on invented values."""

import pytest
from pyspark.sql import functions as F

from dramatis.functions import company, names, text
from dramatis.functions import positions as P
from dramatis.functions import urls as U
from dramatis.functions.morph import genitive, lemma_table
from dramatis.plans.catalogue import NAMED


def apply(spark, values, *columns):
    """One collected list per column, over rows of one string."""
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", *[c.alias(f"c{k}") for k, c in enumerate(columns)]).orderBy("i").collect()
    return [[r[f"c{k}"] for r in rows] for k in range(len(columns))]


V = F.col("v")


def test_emails(spark):
    found, person, own = apply(spark, ["Write INFO@example.ru, sales@test.com or ivanov@a.ru; logo@2x.png; info@example.ru", None, ""], text.extract_emails(V), text.person_email(text.extract_emails(V)), text.company_email(text.extract_emails(V)))
    assert found == [["info@example.ru", "sales@test.com", "ivanov@a.ru"], [], []]
    assert person == ["ivanov@a.ru", "", ""] and own == ["info@example.ru", "", ""]
    assert apply(spark, ["info@a.ru", "contact@a.ru", "ivanov@a.ru", "", None, "no address"], text.classify_email(V))[0] == ["general", "general", "personal", "personal", "personal", "personal"]


def test_phones(spark):
    regex, plan = apply(spark, ["+7 (495) 123-45-67 or 74951234567", "8 800 555 35 35", "nothing"], text.extract_phones(V, "regex"), text.extract_phones(V))
    assert regex == [["+7 (495) 123-45-67"], [], []]
    assert plan == [["+7 495 123-45-67"], ["+7 800 555-35-35"], []]


@pytest.mark.parametrize("value", ["ИНН: 7701234567", "ИНН.7701234567", "ИНН7701234567", "INN: 7701234567", "7701234567 / 770101001"])
def test_inn(spark, value):
    assert "7701234567" in apply(spark, [value], text.extract_inn(V))[0][0]


def test_inn_lengths_and_kpp(spark):
    assert apply(spark, ["ИНН 770123456789", "ИНН 77012345678"], text.extract_inn(V))[0] == [["770123456789"], []]
    assert apply(spark, ["КПП: 770101001", "КПП 770101001", "КПП.770101001", "КПП 77010"], text.extract_kpp(V))[0] == [["770101001"]] * 3 + [[]]


def test_social_links(spark):
    page = "https://vk.com/acme/ https://vk.com/share.php https://t.me/share/url https://facebook.com/acme https://vk.com/acme https://ok.ru/logo.png HTTPS://x.com/a"
    assert apply(spark, [page], text.extract_social_links(V))[0][0] == ["https://vk.com/acme", "https://facebook.com/acme"]


def test_names(spark):
    rows, valid = apply(spark, list(NAMED), names.normalised(V), names.is_valid(V))
    for (raw, expected), row, ok in zip(NAMED.items(), rows, valid, strict=True):
        assert (row.last_name, row.first_name, row.patronymic, row.gender, ok) == expected, raw
    assert apply(spark, ["About Us", "Our Team", "Contact Us", "Иванов Иван Иванович", "Петров Петр", None, "a" * 200], names.is_valid(V))[0] == [False, False, False, True, True, False, False]


def test_name_parts(spark):
    (row,) = apply(spark, ["иванов-петров иван иванович"], names.normalised(V))[0]
    assert (row.full, row.initials, row.ending) == ("Иванов-Петров Иван Иванович", "И.И.", "ров")


def test_company_names(spark):
    cases = {
        "Наша команда": "", "Контакты": "", "О компании": "", "Главная страница": "", "": "", "   ": "", "Наша команда — ООО «Ромашка»": "", "ООО «Ромашка» | Контакты": "ООО «Ромашка»",
        "Контакты: завод Север": "Завод Север", "Команда профессионал Север": "Север", "ab": "", "acme &amp; co": "Acme & co", "ао «вектор»": "АО «вектор»",
    }
    assert apply(spark, list(cases), company.clean_company_name(V))[0] == list(cases.values())


def test_company_choice(spark):
    df = spark.createDataFrame([(["Acme", "ООО «Ромашка»"],), (["Контакты", "Acme"],), ([],)], "c array<string>")
    assert [r[0] for r in df.select(company.choose_company_name(F.col("c"))).collect()] == ["ООО «Ромашка»", "Acme", ""]


def test_spa_limits(spark):
    pages = ["x" * 1999, "x" * 2000, 'id="root"' + "x" * 7990, 'id="root"' + "x" * 7991, "reactdom" + "y" * 2000 + "<body" + "x" * 2999, "reactdom" + "y" * 2000 + "<body" + "x" * 3000, None]
    assert apply(spark, pages, U.is_spa(V))[0] == [True, False, True, False, True, False, True]


def test_url_scores_and_domains(spark):
    paths = ["/rukovodstvo", "/management", "/team", "/contacts", "/about", "/x"]
    scores = apply(spark, ["https://a.ru" + p for p in paths], U.score(V))[0]
    assert scores[0] >= 20 and scores[1] >= 20 and scores[2] >= 10 and scores[3] >= 5 and scores[4] >= 3 and scores[5] == 0
    assert apply(spark, ["https://www.wiki.ru/x", "HTTP://WWW.a.ru:80?q", "no url", None], U.domain(V), U.host(V)) == [["iki.ru", "a.ru:80", "", ""], ["wiki.ru", "a.ru:80", "", ""]]


def test_absolute(spark):
    df = spark.createDataFrame([("https://a.ru/b/c", "../d#x"), ("https://a.ru/b", "//c.ru/e"), ("https://a.ru", "http://[bad")], "b string, h string")
    assert [r[0] for r in df.select(U.absolute("b", "h")).collect()] == ["https://a.ru/d", "https://c.ru/e", None]


def test_title_cleaning(spark):
    long = "Очень " * 10 + "важный директор по всем вопросам развития и роста большой компании в мире и за его пределами тоже"
    cleaned = apply(spark, ["- Директор;", "Ген. Директор", "Инженер - а", "  a  b ", None, long], P.clean(V))[0]
    assert cleaned[:5] == ["Директор", "Ген", "Инженер", "a b", ""]
    assert len(cleaned[5]) <= 120 and cleaned[5].endswith("по всем вопросам развития и роста")


def test_morphology():
    assert lemma_table()["директора"] == "директор" and lemma_table()["финансового"] == "финансовый" and lemma_table()["продажам"] == "продажа"
    assert genitive("Генеральный директор") == "генерального директора" and genitive("IT-директор") == "it-директора"


def test_token_set_ratio():
    assert P.token_set_ratio("главный бухгалтер", "бухгалтер главный") == 100
    assert P.token_set_ratio("бухгалтер", "главный бухгалтер") == 100
    assert P.token_set_ratio("", "a") == 0 and P.lcs("abcd", "xbyd") == 2
    assert P.token_set_ratio("abc", "abd") == pytest.approx(200 * 2 / 6)
