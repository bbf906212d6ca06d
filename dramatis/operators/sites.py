"""From pages of sites to contacts: the whole extraction as one plan.

Each page is parsed once, into its company facts, its contacts and its social links. One shuffle gathers the pages of a
site (no more than the depth of the crawl), where facts merge in page order. Titles are resolved once each. Duplicates are removed
within a site before the filter on target positions, and sites without a contact get a company-only row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dramatis.functions import company as C
from dramatis.functions import names, text
from dramatis.functions import urls as U
from dramatis.functions.binding import let
from dramatis.functions.positions import route
from dramatis.operators.contacts import page_contacts
from dramatis.operators.dedup import dedup, dedup_key
from dramatis.operators.frontier import DEPTH
from dramatis.operators.resolve import matches_targets, with_positions
from dramatis.sources.catalog import OTHERS
from dramatis.sources.html import parse_page
from dramatis.sources.scratch import kept

FACTS = ["company_name", "inn", "kpp", "company_email", "company_phone", "language"]
COMPANY_ONLY = {"role_category": "Компания (без контактного лица)", "comment": "Компания без персональных ФИО"}
TITLE_ONLY = "Должность без ФИО"


def page_company(page: Column, phones: str = "plan", as_written: bool = False) -> Column:
    """struct of the company facts of a parsed page. ``as_written``: the title keeps its entities, but for ``&amp;``."""
    title = page["title_source" if as_written else "title"]
    found = F.concat(page["json_ld"], F.array_compact(F.array(page["site_name"], page["organization"], F.nullif(title, F.lit("")))))
    scope = C.text_scope(page["footer_text"], page["body_text"])
    email = let(text.extract_emails(scope), text.company_email)
    return F.struct(
        C.choose_company_name(found, C.AMPERSAND if as_written else C.ENTITIES).alias("company_name"),
        text.first_or_empty(text.extract_inn(page["body_text"])).alias("inn"),
        text.first_or_empty(text.extract_kpp(page["body_text"])).alias("kpp"),
        email.alias("company_email"),
        text.first_or_empty(text.extract_phones(scope, phones)).alias("company_phone"),
        C.language(page["lang"]).alias("language"),
    )


def merged(field: str, value: Column | None = None, order: str = "page_ord") -> Column:
    """Aggregate: the first value in page order that is not empty."""
    value = F.col(f"company.{field}") if value is None else value
    return F.coalesce(F.min_by(F.nullif(value, F.lit("")), F.when(F.coalesce(value, F.lit("")) != "", F.col(order))), F.lit("")).alias(field)


def has_company_data() -> Column:
    """Whether a site tells anything of its company; a language or KPP alone is nothing."""
    return F.concat_ws("", *[F.trim(F.coalesce(F.col(c), F.lit(""))) for c in ("company_name", "company_email", "company_phone", "inn")]) != ""


def site_socials() -> Column:
    """Aggregate: the first so many of a site's links, in order of name. A page gives no more than that many."""
    of_page = F.slice(F.array_sort("socials"), 1, text.MAX_SOCIALS)
    return F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(of_page)))), 1, text.MAX_SOCIALS)


def site_facts(pages: DataFrame, keys: list[str], phones: str = "plan", depth: int = DEPTH["all_contacts"]) -> DataFrame:
    """One row per site: merged facts, social links, raw contacts in page order, pages visited; of its first ``depth`` pages, which bounds what one row gathers."""
    read = pages.where(F.coalesce(F.col("html"), F.lit("")) != "").withColumn("page", parse_page(F.col("html")))
    parts = read.select(*keys, "page_ord", "page_url", page_company(F.col("page"), phones).alias("company"), page_contacts(F.col("page"), phones).alias("found"), text.extract_social_links(F.col("html")).alias("socials"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("page_ord", "page_url"))
    parts = parts.withColumn("place", place).where(F.col("place") <= depth)
    found = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("page_ord", "page_url", "found"))), lambda p: F.transform(p["found"], lambda c: F.struct(p["page_url"].alias("page_url"), *[c[f].alias(f) for f in ("full_name", "position_raw", "person_email", "person_phone")]))))
    return parts.groupBy(*keys).agg(
        *[merged(f) for f in FACTS], F.min_by("page_url", "page_ord").alias("site_url"), F.count(F.lit(1)).alias("pages_visited"),
        site_socials().alias("social_links"), found.alias("found"),
    )


def raw_contacts(sites: DataFrame, keys: list[str]) -> DataFrame:
    rows = sites.select(*keys, *FACTS, "site_url", "social_links", F.posexplode("found").alias("ord", "c"))
    return rows.select(*keys, "ord", *FACTS, "site_url", "social_links", "c.*")


def normalise(raw: DataFrame, fuzzy: bool = True) -> DataFrame:
    """Contacts from raw ones: rows without a valid name and without a title go; names and titles are normalised and routed."""
    named = raw.withColumn("name", names.normalised(F.col("full_name"))).where(F.col("name.valid") | (F.trim(F.coalesce("position_raw", F.lit(""))) != ""))
    placed = with_positions(named, fuzzy=fuzzy)
    full = F.when(F.col("name.valid"), F.col("name.full")).otherwise("")
    domain = F.coalesce(F.nullif(U.domain(F.col("page_url")), F.lit("")), U.domain(F.col("site_url")))
    keep = [c for c in raw.columns if c not in {"full_name", "site_url"}]
    out = placed.select(
        *keep, domain.alias("domain"), full.alias("full_name"), *[F.col(f"name.{f}").alias(f) for f in ("last_name", "first_name", "patronymic", "ending", "initials", "gender")],
        F.col("canonical").alias("position_canonical"), F.col("category").alias("role_category"), F.col("matched_id").alias("matched_entry_id"), F.col("method").alias("norm_method"),
        route(F.col("sheet"), full).alias("sheet_name"), F.when(F.col("name.valid"), "ok").otherwise("partial").alias("status"), F.when(F.col("name.valid"), "").otherwise(TITLE_ONLY).alias("comment"),
    )
    return out.withColumn("dedup_key", dedup_key())


def company_only(sites: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each site that tells of its company."""
    empty = ["full_name", "last_name", "first_name", "patronymic", "ending", "initials", "gender", "position_raw", "position_canonical", "person_email", "person_phone"]
    rows = sites.where(has_company_data()).select(
        *keys, F.lit(0).alias("ord"), *FACTS, F.array().cast("array<string>").alias("social_links"), F.col("site_url").alias("page_url"), U.domain(F.col("site_url")).alias("domain"),
        *[F.lit("").alias(c) for c in empty], F.lit(COMPANY_ONLY["role_category"]).alias("role_category"), F.lit(None).cast("string").alias("matched_entry_id"), F.lit("empty").alias("norm_method"),
        F.lit(OTHERS).alias("sheet_name"), F.lit("partial").alias("status"), F.lit(COMPANY_ONLY["comment"]).alias("comment"),
    )
    return rows.withColumn("dedup_key", dedup_key())


def extract_sites(pages: DataFrame, keys: list[str] | None = None, targets: list[str] | None = None, phones: str = "plan", fuzzy: bool = True) -> DataFrame:
    """Contacts of all sites from pages (keys..., page_ord, page_url, html).

    The facts of sites, and the people found, are written to shared storage: both are used twice, and pages are parsed once.
    """
    keys = keys or ["site_id"]
    sites = kept(site_facts(pages, keys, phones), "sites")
    people = kept(dedup(normalise(raw_contacts(sites, keys), fuzzy), keys).where(matches_targets(targets or [])), "people")
    alone = sites.join(people.select(*keys).distinct(), keys, "left_anti")
    return people.unionByName(company_only(alone, keys))
