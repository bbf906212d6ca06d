"""Resolution of titles against the catalog on distinct titles, and what depends on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dramatis.functions import positions as P
from dramatis.functions.binding import let


def resolve_titles(titles: DataFrame, fuzzy: bool = True) -> DataFrame:
    """For distinct ``cleaned`` titles: canonical, category, matched_id, method, sheet. Only titles that nothing else matches are scored in Python."""
    filled = F.col("cleaned") != ""

    def matches(x: Column) -> Column:
        exact = P.exact_match(x["low"])
        return let(exact, lambda e: F.struct(x["low"].alias("low"), x["found"].alias("found"), e.alias("exact"), F.when(e.isNull() & filled, P.morph_match(x["low"], x["found"])).alias("morph")))

    known = titles.select("cleaned", let(F.struct(F.lower("cleaned").alias("low"), P.lemmas(F.col("cleaned")).alias("found")), matches).alias("k")).select("cleaned", "k.*")
    # The function gets nulls for what is settled, and passes them over.
    open_ = F.when(F.col("exact").isNull() & F.col("morph").isNull() & filled, F.col("low"))
    known = known.withColumn("fuzzy", P.fuzzy_match(open_)["ord"] if fuzzy else F.lit(None).cast("int")).withColumn("ord", F.coalesce("exact", "morph", "fuzzy"))
    method = F.when(~filled, "empty").when(F.col("exact").isNotNull(), "exact").when(F.col("morph").isNotNull(), "morph").when(F.col("fuzzy").isNotNull(), "fuzzy").otherwise("fallback")
    ord_ = F.col("ord")
    canonical = (
        F.when(~filled, "").when(F.col("morph").isNotNull(), P.built_canonical(ord_, F.col("cleaned")))
        .when(ord_.isNotNull(), P.field(ord_, lambda p: p.canonical)).otherwise(P.fallback_canonical(F.col("cleaned")))
    )
    return known.select(
        "cleaned", canonical.alias("canonical"), F.coalesce(P.field(ord_, lambda p: p.category), F.lit(P.FALLBACK_CATEGORY)).alias("category"),
        P.field(ord_, lambda p: p.id).alias("matched_id"), method.alias("method"), P.sheet_of(ord_, F.col("low"), F.col("found")).alias("sheet"),
    )


def with_positions(rows: DataFrame, raw: str = "position_raw", fuzzy: bool = True) -> DataFrame:
    """``rows`` with canonical, category, matched_id, method and sheet of their titles, each distinct title being resolved once."""
    cleaned = rows.withColumn("cleaned", P.clean(F.col(raw)))
    resolved = resolve_titles(cleaned.select("cleaned").distinct(), fuzzy)
    return cleaned.join(resolved, "cleaned").drop("cleaned")


def matches_targets(targets: list[str]) -> Column:
    """Whether a title holds one of the needles. No needles keep all rows; only blank ones keep none."""
    needles = [t.strip().lower() for t in targets]
    if not needles:
        return F.lit(True)
    has = lambda column: F.exists(F.array(*[F.lit(n) for n in needles]), lambda n: (n != "") & F.contains(F.lower(F.coalesce(F.col(column), F.lit(""))), n))
    return has("position_canonical") | has("position_raw")
