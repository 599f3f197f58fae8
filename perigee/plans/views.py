"""The engine's entities, derived from the input tables by fixed rules."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perigee.functions.text import first_release, search_text
from perigee.operators.authorship import h_index
from perigee.session import materialize, spread, table

AS_OF = date(2024, 3, 31)


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One work per document: three quarters of each source are the baseline, the rest are candidates."""
    d = spread(table(spark, sf_dir, "documents"), "doc_id")
    base = F.expr("(doc_id div 20) % 4 <> 0")
    day = F.when(base, F.date_add(F.lit(date(2022, 1, 1)), F.expr("cast(doc_id * 7919 % 900 as int)"))).otherwise(F.date_add(F.lit(date(2024, 1, 1)), F.expr("cast(doc_id * 7919 % 90 as int)")))
    preprint = F.expr("""CASE doc_id % 3 WHEN 0 THEN concat(lpad(20 + doc_id % 5, 2, '0'), lpad(1 + doc_id % 14, 2, '0'), '.', lpad(doc_id % 100000, 5, '0'))
        WHEN 1 THEN concat('hep-th/99', lpad(1 + doc_id % 12, 2, '0'), lpad(doc_id % 1000, 3, '0'), 'v2') END""")
    out = d.select(
        F.col("doc_id").alias("id"),
        F.substring("text", 1, 80).alias("title"),
        F.substring("text", 1, 12_000).alias("abstract"),
        F.col("lang").alias("language"),
        F.col("source").alias("subfield"),
        F.col("lang").alias("domain"),
        base.alias("is_baseline"),
        day.alias("date"),
        F.array(F.expr("concat('s', doc_id % 5)"), F.concat(F.lit("l"), "lang"), F.expr("concat('n', n_chars % 7)")).alias("fields"),
        preprint.alias("preprint_id"),
    )
    return out.withColumn("first_release", first_release(F.col("date"), F.when(F.expr("id % 6 = 0"), F.col("preprint_id"))))


def candidates(w: DataFrame) -> DataFrame:
    return w.where("NOT is_baseline")


def baseline(w: DataFrame) -> DataFrame:
    return w.where("is_baseline")


def authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as authors: orders are works, quantities are citations."""
    orders, lines, customers = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "customer"))
    per_order = lines.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("cited"))
    papers = orders.join(per_order, F.col("o_orderkey") == F.col("l_orderkey")).select(F.concat(F.lit("A"), "o_custkey").alias("author_id"), "cited")
    sums = papers.groupBy("author_id").agg(F.count(F.lit(1)).alias("works_count"), F.sum("cited").alias("cited_by"), F.avg("cited").alias("recent"))
    people = customers.select(F.concat(F.lit("A"), "c_custkey").alias("author_id"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("0000-"), "c_custkey")).alias("orcid"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return people.join(sums, "author_id", "left").join(h_index(papers), "author_id", "left").select("author_id", "name", "orcid", zero("works_count"), F.coalesce("cited_by", F.lit(0.0)).alias("cited_by"), F.coalesce("recent", F.lit(0.0)).alias("recent"), zero("h_index"))


def authorships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three customers per document by modular arithmetic; the last of every fifth has no profile."""
    n = table(spark, sf_dir, "customer").agg(F.count(F.lit(1)).alias("n"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")).crossJoin(F.broadcast(n))
    each = d.select("id", "n", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("ord"))
    key = F.expr("CASE WHEN id % 5 = 0 AND ord = 3 THEN n + 1 ELSE 1 + (id * (1 + 6 * ord) + 13 * ord) % n END")
    place = F.when(F.col("ord") == 1, "first").when(F.col("ord") == 3, "last").otherwise("middle")
    return each.select("id", "ord", F.concat(F.lit("A"), key).alias("author_id"), place.alias("position"), F.expr("id % 4 = 0 AND ord = 2").alias("is_corresponding"))


def gate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works with two quick signals, for queries about gates and feeds that don't need the full scores."""
    w = candidates(works(spark, sf_dir))
    return w.select(
        "id",
        "first_release",
        F.expr("cast(id * 7919 % 1000 as double) / 10.0D").alias("novelty"),
        F.expr("cast(id * 104729 % 1000 as double) / 10.0D").alias("authorship"),
        F.expr("id % 97 = 0").alias("override"),
    ).withColumn("discovery", F.lit(0.72) * F.greatest("novelty", "authorship") + F.lit(0.28) * F.least("novelty", "authorship"))


def search_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works with search texts of title and abstract."""
    w = works(spark, sf_dir)
    return w.select("id", "language", "subfield", "domain", search_text(F.col("title")).alias("title"), search_text(F.col("abstract")).alias("abstract"))


def scored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with the scores of the whole plan, to six places, and whether a roster author overrides."""
    from perigee.operators.authorship import on_roster, roster
    from perigee.plans.novelty import discovery

    w, a, people = works(spark, sf_dir), authorships(spark, sf_dir), authors(spark, sf_dir)
    n = discovery(w, a, people).select(F.col("cand_id").alias("id"), F.round("novelty", 6).alias("novelty"), F.round("authorship", 6).alias("authorship"), F.round("discovery", 6).alias("discovery"))
    hit = on_roster(a, roster(people, 8, 1500.0)).withColumn("override", F.lit(True))
    rows = n.join(w.select("id", "first_release"), "id").join(hit, "id", "left").withColumn("override", F.coalesce("override", F.lit(False)))
    return materialize(rows)  # gates read them three times
