"""Operators and the whole extraction on small invented sites."""

import json
import zipfile

from pyspark.sql import functions as F

from dramatis.operators import contacts, dedup, frontier, resolve, sites
from dramatis.plans import reports
from dramatis.sources import fetch, html, store, uploads
from dramatis.streaming import totals


def titles(spark, values, **options):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, position_raw string")
    return {r.position_raw: r for r in resolve.with_positions(rows, **options).collect()}


def test_titles(spark):
    got = titles(spark, ["Генеральный директор", "Заместитель генерального директора", "Технический директор", "Главный бухгалтер", "Директор по развитию", "президент", "начальник отдела", "коммерческий директор", "Директор", "гендиректор", "Региональный директор по продажам", "", None, "Вице-президент по науке"])
    assert got["Генеральный директор"].sheet == "Генеральные директора" and got["Генеральный директор"].method == "exact"
    assert got["Заместитель генерального директора"].sheet is None and got["Заместитель генерального директора"].method == "morph"
    assert got["Технический директор"].sheet == "Главные инженеры" and got["Главный бухгалтер"].sheet == "Главные бухгалтеры"
    assert got["Директор по развитию"].sheet != "Генеральные директора"
    assert [got[t].matched_id for t in ("президент", "начальник отдела", "коммерческий директор", "Директор")] == ["ceo", "head_of_department", "sales_director", "ceo"]
    assert got["Директор"].sheet is None and got["гендиректор"].sheet is None
    assert got["Региональный директор по продажам"].canonical == "Директор по продажам по продажам"
    assert got[""].method == "empty" and got[None].method == "empty"
    assert got["Вице-президент по науке"].matched_id == "president" and got["Вице-президент по науке"].sheet is None


def test_prefixes_and_fuzzy(spark):
    got = titles(spark, ["Заместитель главного инженера", "И.о. финансового директора", "Помощник технического директора", "Chief of accountant", "Ведущий эколог ООО"])
    assert got["Заместитель главного инженера"].canonical == "Заместитель главного инженера"
    assert got["И.о. финансового директора"].canonical.startswith("И.о. финансового директора")
    assert got["Помощник технического директора"].canonical.startswith("Помощник ")
    assert got["Chief of accountant"].method == "fuzzy" and got["Chief of accountant"].matched_id == "chief_accountant"
    assert (got["Ведущий эколог ООО"].method, got["Ведущий эколог ООО"].canonical) == ("fallback", "Ведущий эколог ООО")


def look(spark, lines):
    return [tuple(r) for r in spark.createDataFrame([(lines,)], "l array<string>").select(F.explode(contacts.from_lines(F.col("l")))).select("col.*").collect()]


def test_look_ahead(spark):
    lines = ["Главный инженер", "Иванов Иван Иванович", "+7 (495) 123-45-67", "ivanov@a.ru"]
    assert look(spark, lines) == [("Иванов Иван Иванович", "Главный инженер", "ivanov@a.ru", "+7 495 123-45-67")]
    assert [x[:2] for x in look(spark, ["Главный инженер", "Директор завода", "Петров Петр"])] == [("Петров Петр", "Главный инженер")]
    assert look(spark, ["Главный инженер", "-", "-", "-", "Петров Петр"]) == [] and look(spark, []) == []


def page(body, head=""):
    return f"<html lang='ru-RU'><head>{head}</head><body>{body}</body></html>"


TEAM = page("<h1>Команда</h1><div>Генеральный директор</div><div>Иванов Иван Иванович</div><p>ivanov@a.ru</p><div>Разработчик</div><div>Петров Петр</div><footer>ООО «Ромашка» ИНН 7701234567 КПП 770101001 info@a.ru</footer>", "<title>ООО «Ромашка» | Команда</title>")


def sites_frame(spark, rows):
    return spark.createDataFrame(rows, "site_id long, page_ord int, page_url string, html string")


def test_extract_site(spark):
    rows = sites.extract_sites(sites_frame(spark, [(1, 0, "https://www.a.ru/team", TEAM)])).orderBy("ord").collect()
    assert [(r.full_name, r.sheet_name, r.person_email, r.inn, r.kpp, r.company_name, r.company_email, r.domain, r.language) for r in rows] == [
        ("Иванов Иван Иванович", "Генеральные директора", "ivanov@a.ru", "7701234567", "770101001", "ООО «Ромашка»", "info@a.ru", "a.ru", "ru"),
        ("Петров Петр", "Остальные", "info@a.ru", "7701234567", "770101001", "ООО «Ромашка»", "info@a.ru", "a.ru", "ru"),
    ]


def test_targets_and_fallback(spark):
    rows = sites.extract_sites(sites_frame(spark, [(1, 0, "https://a.ru", TEAM), (2, 0, "https://b.ru", page("<p>нет людей</p>", "<title>Завод Север</title>")), (3, 0, "https://c.ru", page("")), (4, 0, "https://d.ru", None)]), targets=["главный бухгалтер"]).orderBy("site_id").collect()
    assert [(r.site_id, r.full_name, r.role_category, r.status, r.company_name) for r in rows] == [(1, "", "Компания (без контактного лица)", "partial", "ООО «Ромашка»"), (2, "", "Компания (без контактного лица)", "partial", "Завод Север")]


def test_company_merge_in_page_order(spark):
    first = page("<footer>ИНН 1111111111</footer>")
    second = page("<footer>ИНН 2222222222 КПП 770101001</footer>", "<title>Завод Север</title>")
    facts = sites.site_facts(sites_frame(spark, [(1, 1, "u1", second), (1, 0, "u0", first)]), ["site_id"]).first()
    assert (facts.inn, facts.kpp, facts.company_name, facts.site_url, facts.pages_visited) == ("1111111111", "770101001", "Завод Север", "u0", 2)


def test_cards(spark):
    card = page("<div>Анна Петрова<br>ведущий инженер, цех<br>a@b.ru</div>")
    got = spark.createDataFrame([(card,)], "h string").select(html.parse_page("h").alias("p")).select(F.explode(contacts.page_contacts(F.col("p")))).select("col.*").collect()
    assert [(r.full_name, r.position_raw, r.person_email) for r in got] == [("Анна Петрова", "ведущий инженер, цех", "a@b.ru")]


def test_parse_is_lenient():
    assert html.parse("") is None and html.parse(None) is None
    p = html.parse("<title>a<p>b</div><a href=' /x '>y<script>z</script><footer>f")
    assert p["hrefs"] == ["/x"]
    ld = [json.dumps({"@graph": [{"@type": ["Organization"], "legalName": "L", "name": "N"}]}), json.dumps([{"@type": "Corporation", "name": "M"}, {"@type": "Person", "name": "P"}]), "{broken"]
    assert html.organisation_names(ld) == ["L", "M"]
    assert html.parse("<body>" + "<div>" * 5000 + "deep")["body_text"] == "deep"


BASE = dict.fromkeys("domain position_raw full_name first_name last_name patronymic position_canonical person_email person_phone company_email company_phone inn kpp".split(), "")


def people(spark, rows):
    names = ["ord", "site_id", *BASE]
    return spark.createDataFrame([tuple((BASE | {"ord": i, "site_id": 1} | r)[n] for n in names) for i, r in enumerate(rows)], "ord int, site_id int, " + ", ".join(f"{n} string" for n in BASE)).withColumn("dedup_key", dedup.dedup_key())


def test_dedup(spark):
    company = {"company_email": "info@a.ru"}
    got = dedup.dedup(people(spark, [{"full_name": "A B", **company}, {"full_name": "C D", "inn": "1", **company}, {"full_name": "E F", "kpp": "2", **company}]), ["site_id"]).collect()
    assert [(r.full_name, r.ord) for r in got] == [("C D", 0)]
    apart = dedup.dedup(people(spark, [{"full_name": "A", "person_email": "x@y.ru"}, {"full_name": "A", "person_email": "X@y.ru ", "site_id": 2}, {"full_name": "A", "person_email": "x@y.ru"}]), ["site_id"])
    assert apart.count() == 2
    keys = [r.dedup_key for r in people(spark, [{"full_name": " A  B ", "person_phone": "+7 1"}, {"full_name": "A"}, {"person_phone": "12"}, {"position_raw": " X "}]).orderBy("ord").collect()]
    assert keys == ["np::a b:71", "n::a", "p::12", "z::x"]
    again = dedup.dedup(apart, ["site_id"])
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, apart.collect()))


def test_frontier(spark):
    links = "".join(f"<a href='{h}'>{t}</a>" for h, t in [("/about", "About"), ("/contact", "x"), ("rukovodstvo", "Руководство"), ("/news#a", "News"), ("mailto:a@b.ru", "team"), ("https://other.ru/team", "team"), ("/plain", "plain")])
    homes = spark.createDataFrame([(1, "https://a.ru/", page(links)), (2, "https://b.ru/x", page(""))], "page_id long, url string, html string").withColumn("page", html.parse_page("html"))
    got = frontier.frontier(homes, "fast_start").orderBy("page_id", "page_ord").collect()
    assert [r.page_url for r in got if r.page_id == 1] == ["https://a.ru/", "https://a.ru/rukovodstvo", "https://a.ru/contact", "https://a.ru/about", "https://a.ru/news"]
    assert [r.page_url for r in got if r.page_id == 2][:2] == ["https://b.ru/x", "https://b.ru/contacts"] and sum(r.page_id == 2 for r in got) == 6


def test_reports_and_workbook(spark, tmp_path):
    rows = sites.extract_sites(sites_frame(spark, [(1, 0, "https://a.ru/team", TEAM)])).withColumn("task_id", F.lit("t"))
    assert {r.sheet: r.n for r in reports.sheet_counts(rows).collect()} == {"Генеральные директора": 1, "Финансовые директора": 0, "Главные бухгалтеры": 0, "Главные инженеры": 0, "Остальные": 1}
    path = store.write_workbook(rows, str(tmp_path / "out.xlsx"), {"task_id": "t"}, spark.createDataFrame([("https://x.ru", "exception", "no <answer>")], "url string, code string, message string"))
    with zipfile.ZipFile(path) as z:
        assert sum(n.startswith("xl/worksheets/") for n in z.namelist()) == 8
        assert "Иванов Иван Иванович" in z.read("xl/worksheets/sheet1.xml").decode() and "no &lt;answer&gt;" in z.read("xl/worksheets/sheet8.xml").decode()
    store.append_contacts(rows, str(tmp_path / "contacts"))
    store.append_contacts(rows, str(tmp_path / "contacts"))
    assert store.read_contacts(spark, str(tmp_path / "contacts"), "t").count() == 2
    store.delete_task(spark, [str(tmp_path / "contacts")], "t")
    assert not list((tmp_path / "contacts").glob("task_id=*"))


def test_depth_of_a_site(spark):
    """Only the first pages of a site are gathered, and of its social links the first by name."""
    rows = [(1, k, f"https://a.ru/{k:02}", page(f"<p>https://vk.com/u{99 - k}</p><footer>{'ИНН 7701234567' if k == 40 else ''}</footer>")) for k in range(60)]
    facts = sites.site_facts(sites_frame(spark, rows).repartition(4), ["site_id"]).first()
    assert (facts.pages_visited, facts.inn, facts.site_url) == (15, "", "https://a.ru/00")
    assert facts.social_links == sorted(f"https://vk.com/u{99 - k}" for k in range(15))


def test_links_resolve_as_by_the_standard_rules(spark):
    from urllib.parse import urldefrag, urljoin

    from dramatis.functions import urls

    hrefs = ["/a", "/a#b", "/", "/a?x=1#y", "//c.ru/d", "a/b", "../x", "/../x", "/a/./b", "/a?", "?q", "#z", "", "https://d.ru/e", "/a b", "/a;p", "/x/..", "/..a", "/a//b", "/é"]
    bases = ["https://a.ru/x/y", "http://b.ru", "HTTPS://C.ru/z"]
    frame = spark.createDataFrame([(b, h) for b in bases for h in hrefs], "b string, h string")
    assert {(r.b, r.h): r.u for r in frame.select("b", "h", urls.absolute(F.col("b"), F.col("h")).alias("u")).collect()} == {(b, h): urldefrag(urljoin(b, h))[0] for b in bases for h in hrefs}


def test_row_numbers(spark):
    rows = spark.range(500).select((F.col("id") * 37 % 500).alias("ord"), F.when(F.col("id") % 10 == 0, "a").otherwise("b").alias("sheet")).repartition(4)
    assert all(r.n == r.ord + 1 for r in reports.row_numbers(rows, "ord").collect())
    of = {}
    for r in sorted(reports.row_numbers(rows, "ord", "sheet").collect(), key=lambda r: r.ord):
        of.setdefault(r.sheet, []).append(r.n)
    assert {k: v == list(range(1, len(v) + 1)) for k, v in of.items()} == {"a": True, "b": True}
    assert reports.row_numbers(rows.limit(0), "ord").count() == 0


def test_uploads_and_updates(spark):
    got = uploads.parse_lines(spark.createDataFrame([("﻿url",), ("a.ru",), ("a.ru",), ("#c",), ("x, b.ru",)], "value string")).collect()
    assert [r.url for r in got] == ["https://a.ru", "https://a.ru", "https://b.ru"]
    have = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert {tuple(r) for r in store.updated(have, spark.createDataFrame([(2, "c")], "k int, v string"), ["k"]).collect()} == {(1, "a"), (2, "c")}


def test_streaming_totals(spark):
    sites_ = spark.createDataFrame([("t", f"u{i}", "ok" if i % 3 else "partial", 2) for i in range(9)], "task_id string, url string, status string, contacts_count long").repartition(3)
    assert [tuple(r) for r in totals.totals_of_stream(sites_, 1).collect()] == [("t", 9, 6, 3, 18)]


def test_fetching(spark):
    def fake(url):
        if "bad" in url:
            raise OSError("no route")
        return None if "none" in url else f"<p>{url}</p>"

    rows = fetch.fetch_pages(spark.createDataFrame([(1, "http://a"), (2, "http://bad"), (3, "http://none"), (4, None)], "k int, page_url string"), fetch=fake).orderBy("k").collect()
    assert [(r.html, r.error_code) for r in rows] == [("<p>http://a</p>", None), (None, "fetch_exception"), (None, "fetch_failed"), (None, "fetch_failed")]
