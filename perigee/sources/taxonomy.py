"""Taxonomies: trees, expansion of fields, mapping between systems, and HTML scrapes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tree(fields: DataFrame, subfields: DataFrame) -> DataFrame:
    """(field_id, name, subfields) with children nested under parents, sorted by name on both levels."""
    children = subfields.groupBy("field_id").agg(F.array_sort(F.collect_list(F.struct("name", "subfield_id"))).alias("subfields"))
    return fields.join(children, "field_id", "left").select("field_id", "name", F.coalesce("subfields", F.expr("cast(array() as array<struct<name:string,subfield_id:bigint>>)")).alias("subfields")).orderBy("name")


def expand(subfields: DataFrame, field_ids: list[str], subfield_ids: list[str]) -> DataFrame:
    """The chosen subfields and all those of the chosen fields."""
    chosen = subfields.sparkSession.createDataFrame([(s,) for s in subfield_ids], "subfield_id string")
    return subfields.where(F.col("field_id").isin(*field_ids)).select("subfield_id").union(chosen).distinct()


def uncovered(fields: DataFrame, mapping: DataFrame) -> DataFrame:
    """Fields of one system that no group of the other maps to."""
    return fields.join(mapping.select("field_id").distinct(), "field_id", "left_anti")


def map_codes(listing: DataFrame, codes: DataFrame, groups: DataFrame) -> DataFrame:
    """(group_id, code, field_ids, subfield_ids) of a listing: a code's own targets (ids of one or two digits are
    fields, longer ones subfields); without any, the fields of its group. codes: code, target; groups: group_id,
    field_id."""
    is_field = F.length("target") <= 2
    sorted_ids = lambda c: F.array_sort(F.collect_set(c))
    own = codes.groupBy("code").agg(sorted_ids(F.when(is_field, F.col("target"))).alias("own_fields"), sorted_ids(F.when(~is_field, F.col("target"))).alias("own_subfields"))
    of_group = groups.groupBy("group_id").agg(sorted_ids("field_id").alias("group_fields"))
    none = F.array().cast("array<string>")
    both = listing.join(own, "code", "left").join(of_group, "group_id", "left")
    fields = F.when(F.size(F.coalesce("own_fields", none)) + F.size(F.coalesce("own_subfields", none)) > 0, F.col("own_fields")).otherwise(F.coalesce("group_fields", none))
    return both.select("group_id", "code", fields.alias("field_ids"), F.coalesce("own_subfields", none).alias("subfield_ids"))


# The markup of the scraped listing.
HEADING = r'(?is)<h2 class="accordion-head"[^>]*id="accordion-head-grp_([^"]+)".*?<button[^>]*>.*?<span[^>]*>.*?</span>\s*([^<]+?)\s*</button>.*?</h2>'
CATEGORY = r"(?i)<h4>([^ <]+)\s*<span>\(([^<]+)\)</span></h4>"


def parse_listing(pages: DataFrame, html: str = "html") -> DataFrame:
    """(group_id, group_name, code, name) of a scraped category listing; groups without categories go."""
    marked = pages.select(F.regexp_replace(html, HEADING, "\u0001$1\u0002$2\u0003").alias("h"))
    parts = marked.select(F.explode(F.slice(F.split("h", "\u0001"), 2, 1 << 20)).alias("part"))
    group = parts.select(F.substring_index("part", "\u0002", 1).alias("group_id"), F.substring_index(F.substring_index("part", "\u0003", 1), "\u0002", -1).alias("group_name"), F.substring_index("part", "\u0003", -1).alias("body"))
    found = F.arrays_zip(F.regexp_extract_all("body", F.lit(CATEGORY), F.lit(1)).alias("code"), F.regexp_extract_all("body", F.lit(CATEGORY), F.lit(2)).alias("name"))
    return group.select("group_id", "group_name", F.explode(found).alias("c")).select("group_id", "group_name", F.trim("c.code").alias("code"), F.trim("c.name").alias("name"))


def complete(listing: DataFrame, groups: int = 8, categories: int = 150) -> DataFrame:
    """One row: whether a scrape has what it must have to replace the cache."""
    return listing.agg((F.count_distinct("group_id") == groups).alias("has_groups"), (F.count(F.lit(1)) >= categories).alias("has_categories")).select((F.col("has_groups") & F.col("has_categories")).alias("accepted"))


def parse_links(pages: DataFrame) -> DataFrame:
    """(page_id, n_headings, n_links): the scraper's scan on raw pages."""
    count = lambda p: F.size(F.regexp_extract_all("html", F.lit(p), F.lit(0))).cast("long")
    return pages.select("page_id", count(r"(?i)<h[1-6][ >]").alias("n_headings"), count(r"(?i)<a [^>]*href=").alias("n_links"))
