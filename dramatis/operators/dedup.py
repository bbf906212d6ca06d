"""Contacts without duplicates: the fullest row of each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

COUNTED = "full_name first_name last_name patronymic position_canonical person_email person_phone company_email company_phone inn kpp".split()


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _low(name: str) -> Column:
    return F.lower(F.trim(_text(name)))


def dedup_key(person_only_keys: bool = False) -> Column:
    """The first key that applies: email, name and phone, name, phone, title. A person without an own email or phone goes by the company's, unless ``person_only_keys``."""
    own = lambda person, company: _text(person) if person_only_keys else F.coalesce(F.nullif(_text(person), F.lit("")), _text(company))
    name = F.regexp_replace(_low("full_name"), r"(?U)\s+", " ")
    email = F.lower(F.trim(own("person_email", "company_email")))
    phone = F.regexp_replace(own("person_phone", "company_phone"), r"\D", "")
    key = lambda kind, *parts: F.concat_ws(":", F.lit(kind), _low("domain"), *parts)
    return (
        F.when(email != "", key("e", email)).when((name != "") & (phone != ""), key("np", name, phone))
        .when(name != "", key("n", name)).when(phone != "", key("p", phone)).otherwise(key("z", _low("position_raw")))
    )


def completeness() -> Column:
    """How many of the counted fields hold something."""
    return sum((F.when(_text(c) != "", 1).otherwise(0) for c in COUNTED), F.lit(0))


def dedup(contacts: DataFrame, scope: list[str], order: str = "ord", key: str = "dedup_key") -> DataFrame:
    """Per scope and key the fullest row, the first of equals, in the place of the first row of its key."""
    group = Window.partitionBy(*scope, key)
    ranked = contacts.withColumn("__full", completeness()).withColumn("__rank", F.row_number().over(group.orderBy(F.desc("__full"), order))).withColumn("__first", F.min(order).over(group))
    return ranked.where("__rank = 1").withColumn(order, F.col("__first")).drop("__full", "__rank", "__first")
