"""Which pages of a site to read: links by score, or guessed paths where there are none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dramatis.functions import urls as U
from dramatis.functions.binding import literal_array
from dramatis.sources.scratch import kept

DEPTH = {"fast_start": 6, "all_contacts": 15}


def page_links(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", parsed_col: str = "page") -> DataFrame:
    """Scored links of parsed pages to pages of the same site: id, base_url, link, score; each link once per page."""
    pairs = pages.select(F.col(id_col), F.col(url_col).alias("base_url"), F.explode(F.arrays_zip(F.col(f"{parsed_col}.hrefs").alias("href"), F.col(f"{parsed_col}.anchors").alias("anchor"))).alias("a"))
    wanted = pairs.select(id_col, "base_url", F.col("a.href").alias("href"), F.col("a.anchor").alias("anchor")).where(U.is_link(F.col("href")) & U.has_keyword(F.concat_ws(" ", "anchor", "href")))
    links = wanted.withColumn("link", U.absolute(F.col("base_url"), F.col("href"))).where(U.same_domain(F.col("link"), F.col("base_url")))
    return links.select(id_col, "base_url", "link", U.score(F.col("link")).alias("score")).distinct()


def ranked_links(links: DataFrame, id_col: str = "page_id", limit: int | None = None) -> DataFrame:
    """Links with their rank within a page, by falling score, then by name."""
    out = links.withColumn("rank", F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("score"), "link")))
    return out.where(F.col("rank") <= limit) if limit is not None else out


def guessed(sites: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """The usual paths under the root of each site, in order."""
    paths = literal_array(U.GUESSED_PATHS)
    return sites.select(F.col(id_col), F.col(url_col).alias("base_url"), F.posexplode(paths).alias("pos", "path")).select(id_col, "base_url", F.concat(U.root(F.col("base_url")), "path").alias("link"), (F.col("pos") + 1).alias("rank"))


def frontier(homes: DataFrame, mode: str = "all_contacts", id_col: str = "page_id", url_col: str = "url", parsed_col: str = "page") -> DataFrame:
    """Pages to visit: id, page_ord (0 is the home page), page_url. A link back to the home page uses up its place.

    Links are used twice, so they are written to shared storage, and pages are parsed once.
    """
    depth = DEPTH[mode]
    ranked = ranked_links(page_links(homes, id_col, url_col, parsed_col), id_col, depth - 1).where("link <> base_url")
    ranked = kept(ranked.select(id_col, F.col("rank").alias("page_ord"), F.col("link").alias("page_url")), "links")
    lone = homes.join(ranked.select(id_col).distinct(), id_col, "left_anti")
    usual = guessed(lone, id_col, url_col).where(F.col("rank") <= depth - 1).select(id_col, F.col("rank").alias("page_ord"), F.col("link").alias("page_url"))
    home = homes.select(F.col(id_col), F.lit(0).alias("page_ord"), F.col(url_col).alias("page_url"))
    return home.unionByName(ranked).unionByName(usual)
