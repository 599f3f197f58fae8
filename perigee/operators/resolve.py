"""Entity resolution, keyed dedup and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perigee.functions.text import doi


def paper_key(title: Column, authors: Column, doi_value: Column, arxiv: Column, key_id: Column) -> Column:
    """Title and first three authors if both are there, else DOI, else preprint id, else title and id.
    title and authors are search texts."""
    names = F.array_join(F.filter(F.slice(authors, 1, 3), lambda a: a != ""), "|")
    bare = F.lower(F.regexp_replace(F.coalesce(arxiv, F.lit("")), r"(?i)v\d+$", ""))
    return (
        F.when((title != "") & (names != ""), F.concat(F.lit("title:"), title, F.lit("|authors:"), names))
        .when(doi(doi_value) != "", F.concat(F.lit("doi:"), doi(doi_value)))
        .when(bare != "", F.concat(F.lit("arxiv:"), bare))
        .otherwise(F.concat(F.lit("title:"), title, F.lit("|id:"), key_id.cast("string")))
    )


def group_papers(works: DataFrame) -> DataFrame:
    """Per key: the id of the longest abstract (the first on a tie), earliest dates, highest scores, where the
    novelty comes from, distinct sources and how many records there are.

    works: key, id, abstract, date, released, novelty, authorship, discovery, source_name, source_url.
    Only ids and short columns are gathered; abstracts are compared by length before the shuffle.
    """
    rank = F.struct(F.length(F.coalesce("abstract", F.lit(""))).alias("n"), (-F.col("id")).alias("first"))
    source = F.struct(F.col("id"), F.col("source_name").alias("name"), F.col("source_url").alias("url"))
    g = works.groupBy("key").agg(
        F.max_by("id", rank).alias("best_id"),
        F.count(F.lit(1)).alias("n_dups"),
        F.min("date").alias("min_date"),
        F.min("released").alias("first_release"),
        F.max("novelty").alias("novelty"),
        F.max("authorship").alias("authorship"),
        F.max("discovery").alias("discovery"),
        F.max_by("id", F.struct(F.col("novelty"), (-F.col("id")).alias("first"))).alias("score_source_id"),
        F.array_sort(F.collect_list("id")).alias("ids"),
        F.array_sort(F.collect_set(source)).alias("all_sources"),
    )
    label = lambda s: F.concat(F.lower(s["name"]), F.lit("|"), F.lower(s["url"]))
    keys = F.array_distinct(F.transform("all_sources", label))
    last = F.transform(keys, lambda k: F.element_at(F.filter("all_sources", lambda s: label(s) == k), -1))
    return g.withColumn("sources", F.transform(last, lambda s: F.struct(s["name"].alias("name"), s["url"].alias("url")))).drop("all_sources")


def last_wins(rows: DataFrame, key: str | list[str], order: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """The last row of each key; of rows that tie, the first by `ties`. An aggregate (max_by) would do with fewer
    columns; a window keeps them all."""
    keys = [key] if isinstance(key, str) else key
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order), *ties))).where("__n = 1").drop("__n")


def first_wins(rows: DataFrame, key: str | list[str], order: str) -> DataFrame:
    keys = [key] if isinstance(key, str) else key
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("__n = 1").drop("__n")


def union_lanes(lanes: list[DataFrame], key: str) -> DataFrame:
    """All lanes, one row per key: the last lane's wins."""
    out = None
    for i, lane in enumerate(lanes):
        lane = lane.withColumn("lane", F.lit(i))
        out = lane if out is None else out.unionByName(lane)
    return last_wins(out, key, "lane")


def new_only(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return rows.join(known.select(key).distinct(), key, "left_anti")


def qualified_and_new(rows: DataFrame, qualified: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return new_only(rows.join(qualified.select(key).distinct(), key, "left_semi"), known, key)
