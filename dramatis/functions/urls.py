"""URL predicates and scores as column expressions."""

from __future__ import annotations

from urllib.parse import urldefrag, urljoin

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Paths, keyword stems and scores that results depend on.
GUESSED_PATHS = """
/contacts /contact /контакты /kontakty
/about /о-компании /o-kompanii /о-нас /ob-organizacii
/team /команда /komanda /nasha-komanda /our-team
/rukovodstvo /руководство /management /leadership
/staff /сотрудники /предприятие
/struktura /структура /departments /departamenty
/подразделения /otdely /отделы
/specialists /специалисты /experts /эксперты
/press /press-center /news /пресс-центр /press-relizy
/vacancies /вакансии /careers /карьера
/history /история /requisites /реквизиты /rekvizity
""".split()
KEYWORDS = (
    r"contact|контакт|kontakt|team|команд|about|о\s*нас|о\s*компании|rukovodstv|руководств|staff|сотрудник|management|менеджмент|leadership|"
    r"press|пресс|news|новост|vacanc|вакан|career|карьер|struktur|структур|department|департамент|подразд|otdel|отдел|"
    r"specialist|специалист|expert|эксперт|истори|history|rekvizit|реквизит|organizacii|our|наш"
)
SCORES = {
    20: "rukovodstv|руководств|management|leadership|директор",
    10: "team|команд|staff|сотрудник|nasha-komanda|our-team",
    5: "contact|контакт|kontakt",
    3: "about|о-компании|o-kompanii|press|пресс|news|новост|vacanc|вакан|career|карьер|struktur|структур|department|департамент|подразд|specialist|специалист|expert|эксперт|rekvizit|реквизит|ob-organizacii",
}
SKIPPED_LINKS = r"^(mailto:|tel:|#|javascript:)"
AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"


def authority(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), AUTHORITY, 1))


def domain(url: Column) -> Column:
    """The host without any leading run of the letters w and dots; thus also without the w of wiki.ru."""
    return F.ltrim(authority(url), F.lit("w."))


def host(url: Column) -> Column:
    """The host without one leading www."""
    return F.regexp_replace(authority(url), r"^www\.", "")


def same_domain(a: Column, b: Column) -> Column:
    return host(a) == host(b)


def with_scheme(url: Column) -> Column:
    return F.when(F.rlike(url, F.lit("^https?://")), url).otherwise(F.concat(F.lit("https://"), F.trim(url)))


def is_link(href: Column) -> Column:
    return (href != "") & ~F.rlike(href, F.lit(SKIPPED_LINKS))


def has_keyword(text: Column) -> Column:
    return F.rlike(text, F.lit(f"(?iU)({KEYWORDS})"))


def score(url: Column) -> Column:
    low = F.lower(url)
    total = F.lit(0)
    for points, stems in SCORES.items():
        total = total + F.when(F.rlike(low, F.lit(stems)), points).otherwise(0)
    return total


def root(url: Column) -> Column:
    """Scheme and authority."""
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)


def absolute(base: Column, href: Column) -> Column:
    """``href`` resolved against ``base``, without its fragment; null where it can't be. Paths from the root, the usual case, are put together in the JVM."""
    plain = F.rlike(base, F.lit("^https?://")) & F.rlike(href, F.lit(r"^/([^/]|$)")) & ~F.rlike(href, F.lit(r"/\.{1,2}([/?#]|$)|\?(#|$)|[\x00-\x20;]"))
    return F.when(plain, F.concat(root(base), F.regexp_replace(href, "(?s)#.*$", ""))).otherwise(_resolved(base, F.when(~F.coalesce(plain, F.lit(False)), F.coalesce(href, F.lit("")))))


@F.arrow_udf(StringType())
def _resolved(base: pa.Array, href: pa.Array) -> pa.Array:
    """By the standard rules, for what is not null."""

    def one(b: str | None, h: str | None) -> str | None:
        if h is None:
            return None
        try:
            return urldefrag(urljoin(b or "", h or ""))[0]
        except ValueError:
            return None

    return pa.array([one(b, h) for b, h in zip(base.to_pylist(), href.to_pylist(), strict=True)], pa.string())


def is_spa(html: Column) -> Column:
    """Whether a page needs a browser to show its text."""
    h = F.coalesce(html, F.lit(""))
    low = F.lower(h)
    body = F.length(low) - F.instr(low, "<body") - 4
    return (F.length(h) < 2000) | (low.contains('id="root"') & (F.length(low) < 8000)) | (low.contains("reactdom") & low.contains("<body") & (body < 3000))


def fetched(html: Column, browser_html: Column) -> Column:
    """The browser's page where one is needed and there is one; else the plain one."""
    need = html.isNull() | is_spa(html)
    return F.coalesce(F.when(need & (browser_html != ""), browser_html), html)
