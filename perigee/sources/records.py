"""Raw records of the scholarly source: schemas and normalizers."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perigee.functions.text import arxiv_id, clean_abstract_from_index, clean_label, clean_title, first_release, short_id

LEVEL = "STRUCT<id: STRING, display_name: STRING>"
TOPIC = f"STRUCT<id: STRING, display_name: STRING, score: DOUBLE, subfield: {LEVEL}, field: {LEVEL}, domain: {LEVEL}>"
WORK = f"""id STRING, title STRING, display_name STRING, language STRING, publication_date STRING, type STRING, doi STRING,
    abstract_inverted_index MAP<STRING, ARRAY<INT>>, primary_topic {TOPIC}, topics ARRAY<{TOPIC}>,
    authorships ARRAY<STRUCT<author_position: STRING, is_corresponding: BOOLEAN, author: STRUCT<id: STRING, display_name: STRING, orcid: STRING>,
        institutions: ARRAY<STRUCT<display_name: STRING>>, raw_affiliation_strings: ARRAY<STRING>>>,
    primary_location STRUCT<landing_page_url: STRING, pdf_url: STRING, source: STRUCT<display_name: STRING>>,
    locations ARRAY<STRUCT<landing_page_url: STRING, pdf_url: STRING, source: STRUCT<display_name: STRING>>>, _corrupt STRING"""
AUTHOR = """id STRING, display_name STRING, orcid STRING, works_count BIGINT, cited_by_count BIGINT,
    summary_stats STRUCT<h_index: BIGINT, i10_index: BIGINT, `2yr_mean_citedness`: DOUBLE>, last_known_institutions ARRAY<STRUCT<display_name: STRING>>"""

AUTHORS, TOPICS = 25, 10


def read_works(spark, path: str) -> DataFrame:
    """JSON lines of works; malformed rows are dropped, not fatal."""
    raw = spark.read.schema(WORK).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return raw.where(F.col("_corrupt").isNull() | F.col("id").isNotNull()).drop("_corrupt")


def _topic(t: Column) -> Column:
    level = lambda x, n: (short_id(x["id"]).alias(f"{n}_id"), x["display_name"].alias(f"{n}_name"))
    return F.struct(*level(t, "topic"), *level(t["subfield"], "subfield"), *level(t["field"], "field"), *level(t["domain"], "domain"), F.coalesce(t["score"], F.lit(0.0)).alias("score"))


def normalize_works(raw: DataFrame, as_of: date, baseline: bool = False) -> DataFrame:
    """Renamed, defaulted and cleaned works; the abstract is rebuilt and cut, authors and topics are capped."""
    people = F.filter(F.slice(F.coalesce("authorships", F.expr("array()")), 1, AUTHORS), lambda a: a["author"]["id"].isNotNull())
    author = lambda a: F.struct(
        short_id(a["author"]["id"]).alias("author_id"),
        a["author"]["display_name"].alias("name"),
        a["author"]["orcid"].alias("orcid"),
        F.coalesce(a["author_position"], F.lit("middle")).alias("position"),
        F.coalesce(a["is_corresponding"], F.lit(False)).alias("is_corresponding"),
        F.transform(F.coalesce(a["institutions"], F.expr("array()")), lambda i: i["display_name"]).alias("institutions"),
        F.coalesce(a["raw_affiliation_strings"], F.expr("cast(array() as array<string>)")).alias("raw_affiliations"),
    )
    places = F.concat(F.array("primary_location"), F.coalesce("locations", F.expr("array()")))
    urls = F.transform(places, lambda p: F.coalesce(p["landing_page_url"], p["pdf_url"]))
    day = F.coalesce(F.try_to_date("publication_date"), F.lit(as_of))
    out = raw.select(
        short_id(F.col("id")).alias("id"),
        clean_title(F.coalesce("title", "display_name")).alias("title"),
        clean_abstract_from_index(F.to_json("abstract_inverted_index")).alias("abstract"),
        "language",
        day.alias("date"),
        "doi",
        F.coalesce("type", F.lit("article")).alias("work_type"),
        arxiv_id(urls).alias("arxiv_id"),
        F.transform(F.filter(places, lambda p: p.isNotNull()), lambda p: F.struct(p["source"]["display_name"].alias("name"), F.coalesce(p["landing_page_url"], p["pdf_url"]).alias("url"))).alias("sources"),
        F.transform(people, author).alias("authorships"),
        F.transform(F.slice(F.coalesce("topics", F.expr("array()")), 1, TOPICS), _topic).alias("topics"),
        _topic(F.col("primary_topic")).alias("topic"),
        F.lit(baseline).alias("is_baseline"),
    )
    top = out.select("*", *[F.col(f"topic.{n}_{k}").alias(f"{n}_{k}") for n in ("topic", "subfield", "field", "domain") for k in ("id", "name")]).drop("topic")
    return top.withColumn("first_release", first_release(F.col("date"), F.col("arxiv_id")))


def normalize_authors(raw: DataFrame) -> DataFrame:
    zero = lambda c, t="bigint": F.coalesce(F.col(c), F.lit(0).cast(t))
    return raw.select(
        short_id(F.col("id")).alias("author_id"),
        clean_label("display_name").alias("name"),
        "orcid",
        zero("works_count").alias("works_count"),
        zero("cited_by_count").cast("double").alias("cited_by"),
        zero("summary_stats.h_index").alias("h_index"),
        zero("summary_stats.i10_index").alias("i10_index"),
        zero("summary_stats.2yr_mean_citedness", "double").alias("recent"),
        F.get("last_known_institutions", F.lit(0))["display_name"].alias("last_institution"),
    )
