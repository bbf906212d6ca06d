"""Emails, phones, tax identifiers and social links as column expressions over text.

All functions take a string column and stay inside the JVM. A null text gives no matches.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists that results depend on.
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
EMAIL_ASSETS = r"\.(png|jpg|jpeg|gif|svg|webp)$"
GENERAL_LOCALS = "info contact contacts office hello mail admin support sales marketing press pr hr secretary reception service reklama".split()
PHONE_RU = r"(?U)\+?7[\s\-()]*\d{3}[\s\-()]*\d{3}[\s\-()]*\d{2}[\s\-()]*\d{2}"
PHONE_PLAN = r"(?U)(?<![\d+])(?:\+7|8|7)?[\s\-()]*[3489]\d{2}[\s\-()]*\d{3}[\s\-()]*\d{2}[\s\-()]*\d{2}(?!\d)"
PHONE_FOREIGN = r"\+(?!7)[1-9](?:[\s\-().]{0,3}\d){6,14}(?!\d)"
COUNTRY_CODE = "1|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}"
INN_RU = r"(?iU)[Ии][Нн][Нн][\s\xa0\-:.()]*?(\d{10,12})\b"
INN_EN = r"(?iU)\bINN[\s\-:]*?(\d{10,12})\b"
INN_PAIR = r"(?iU)\b(\d{10})\s*[/\\]\s*\d{9}\b"
KPP = r"(?U)[Кк][Пп][Пп][\s\xa0\-:.()]*?(\d{9})\b"
SOCIAL_HOSTS = [
    r"vk\.com/", r"t\.me/", r"facebook\.com/", r"instagram\.com/", r"linkedin\.com/(?:in|company)/",
    r"youtube\.com/(?:channel|user|c)/", r"ok\.ru/", r"twitter\.com/", r"x\.com/", r"dzen\.ru/",
]
BAD_FIRST_SEGMENT = {
    "vk.com": "js|rtrg|share|widget|audio|video|doc|photo|market|images|lib|assets|cdn|away|wall",
    "t.me": "share|joinchat/[^/]+$|proxy|addlist",
    "facebook.com": "tr|sharer|dialog|plugins",
    "linkedin.com": "share|sharing",
    "twitter.com": "share|intent",
    "x.com": "share|intent",
}
PROFILE_ASSETS = r"\.(js|css|php|jpg|jpeg|png|svg|gif|webp)$"
MAX_SOCIALS = 20


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def all_matches(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text_or_empty(c), F.lit(pattern), group)


def extract_emails(c: Column) -> Column:
    """Distinct lower-cased addresses in the order of their first appearance, without names of image files."""
    # Few texts hold an address, and the pattern starts anew at each character.
    found = all_matches(F.when(c.contains("@"), c), EMAIL)
    return F.array_distinct(F.filter(F.transform(found, F.lower), lambda e: ~F.rlike(e, F.lit(EMAIL_ASSETS))))


def is_general(email: Column) -> Column:
    return email.contains("@") & F.lower(F.split_part(email, F.lit("@"), F.lit(1))).isin(GENERAL_LOCALS)


def classify_email(email: Column) -> Column:
    return F.when(is_general(text_or_empty(email)), "general").otherwise("personal")


def general_emails(emails: Column) -> Column:
    return F.filter(emails, is_general)


def personal_emails(emails: Column) -> Column:
    return F.filter(emails, lambda e: ~is_general(e))


def first_or_empty(*arrays: Column) -> Column:
    """The first element of the first array that has one."""
    return F.coalesce(*[F.get(a, F.lit(0)) for a in arrays], F.lit(""))


def person_email(emails: Column) -> Column:
    return first_or_empty(personal_emails(emails), emails)


def company_email(emails: Column) -> Column:
    return first_or_empty(general_emails(emails), emails)


def extract_phones(c: Column, mode: str = "plan") -> Column:
    """Distinct phone numbers in the order of their first appearance.

    ``plan``, an approximation of the numbering plan: ten national digits that begin with 3, 4, 8 or 9, with or without 7, +7
    or 8, shown as +7 XXX XXX-XX-XX; and numbers of other countries, which need a +, shown as the country code and the groups
    as they are written. ``regex``: only a 7 and ten digits, shown as +7 (XXX) XXX-XX-XX.
    """
    if mode == "regex":
        digits = F.filter(F.transform(all_matches(c, PHONE_RU), lambda p: F.regexp_replace(p, r"\D", "")), lambda d: F.length(d) == 11)
        return F.array_distinct(F.transform(digits, lambda d: F.regexp_replace(d, r"^\d(\d{3})(\d{3})(\d{2})(\d{2})$", "+7 ($1) $2-$3-$4")))

    def shown(p: Column) -> Column:
        russian = F.regexp_replace(F.right(F.regexp_replace(p, r"\D", ""), F.lit(10)), r"^(\d{3})(\d{3})(\d{2})(\d{2})$", "+7 $1 $2-$3-$4")
        groups = F.trim(F.regexp_replace(p, r"\D+", " "))
        return F.when(F.rlike(p, F.lit(r"^\+[^7]")), F.concat(F.lit("+"), F.regexp_replace(groups, f"^({COUNTRY_CODE}) ?", "$1 "))).otherwise(russian)

    return F.array_distinct(F.transform(all_matches(c, f"{PHONE_PLAN}|{PHONE_FOREIGN}"), shown))


def extract_inn(c: Column) -> Column:
    found = F.concat(all_matches(c, INN_RU, 1), all_matches(c, INN_EN, 1), all_matches(c, INN_PAIR, 1))
    return F.array_distinct(F.filter(found, lambda v: F.length(v).isin(10, 12)))


def extract_kpp(c: Column) -> Column:
    return F.array_distinct(all_matches(c, KPP, 1))


def is_profile_url(url: Column) -> Column:
    """Whether a link to a social network names a profile, not a widget, a share link or a file."""
    parts = r"^https?://(?:www\.)?([^/]+)/([^/?#]*)"
    host, path = F.lower(F.regexp_extract(url, parts, 1)), F.regexp_extract(url, parts, 2)
    bad = F.lit(False)
    for name, pattern in BAD_FIRST_SEGMENT.items():
        bad = bad | ((host == name) & F.rlike(path, F.lit(f"(?i)^({pattern})")))
    return (path != "") & ~bad & ~F.rlike(F.lower(path), F.lit(PROFILE_ASSETS))


def extract_social_links(c: Column) -> Column:
    """Distinct profile links, network by network."""
    found = F.concat(*[all_matches(c, rf"(?iU)https?://(?:www\.)?{host}[\w\-./]+") for host in SOCIAL_HOSTS])
    return F.array_distinct(F.filter(F.transform(found, lambda u: F.regexp_replace(u, r"/+$", "")), is_profile_url))


def joined(array: Column) -> Column:
    return F.array_join(array, ",")
