"""Authors: careers, authorship of works, rosters, prominence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perigee.functions.constants import ORGANISATIONS, PEOPLE, RESEARCHER_COLOUR
from perigee.functions.scoring import career, clamp, role_weight
from perigee.functions.text import search_text


def careers(authors: DataFrame) -> DataFrame:
    score = career(F.col("h_index"), F.col("cited_by"), F.col("recent"), F.col("works_count"), F.coalesce(F.col("orcid"), F.lit("")) != "")
    return authors.select("author_id", score.alias("career"))


def authorship_scores(works: DataFrame, authorships: DataFrame, authors: DataFrame, evidence: int = 5) -> DataFrame:
    """(id, score, confidence, evidence): 82 % of the best role-weighted career and 18 % of the one in the
    lower middle; confidence is the share of authors with a profile."""
    scored = authorships.join(careers(authors), "author_id", "left")
    weighted = clamp(F.col("career") * role_weight(F.col("position"), F.col("is_corresponding")))
    have = F.col("career").isNotNull()
    # the negated ordinal keeps the order of authors among equal scores in a descending sort
    entry = F.when(have, F.struct(weighted.alias("score"), (-F.col("ord")).alias("nord"), F.col("author_id")))
    per = scored.groupBy("id").agg(F.sort_array(F.collect_list(entry), asc=False).alias("list"), F.count(F.lit(1)).alias("n_authors"))
    n = F.size("list")
    middle = F.element_at("list", (F.floor(n / 2) + 1).cast("int"))["score"]
    score = F.when(n > 0, clamp(F.lit(0.82) * F.element_at("list", 1)["score"] + F.lit(0.18) * middle)).otherwise(F.lit(0.0))
    full = works.select("id").join(per, "id", "left")
    return full.select("id", F.coalesce(F.when(F.size("list") > 0, score), F.lit(0.0)).alias("score"), F.coalesce(F.when(F.size("list") > 0, F.size("list") / F.greatest(F.lit(1), F.col("n_authors"))), F.lit(0.0)).alias("confidence"), F.slice(F.coalesce("list", F.array().cast("array<struct<score:double,nord:int,author_id:string>>")), 1, evidence).alias("evidence"))


def roster(authors: DataFrame, least_h: int = 50, least_cited: float = 10_000) -> DataFrame:
    """(author_id, name, rank-ordered) prominent authors outside the fixed list."""
    from perigee.params import search_text as plain

    out = authors.where(F.col("author_id").isNotNull() & F.col("name").isNotNull() & ~search_text(F.col("name")).isin(*map(plain, PEOPLE)))
    return out.where((F.col("h_index") >= least_h) & (F.col("cited_by") >= least_cited)).orderBy(F.desc("h_index"), F.desc("cited_by"), "name")


def priority_authors(authorships: DataFrame, limit: int | None = None) -> DataFrame:
    """(author_id, priority_rank input): corresponding, first and last authors before the others, each at
    its first occurrence; ids of the form A and digits only."""
    first = F.coalesce("is_corresponding", F.lit(False)) | F.col("position").isin("first", "last")
    per = authorships.where(F.rlike("author_id", F.lit(r"^A[0-9]+$"))).groupBy("author_id").agg(F.min(F.struct(F.when(first, 0).otherwise(1).alias("prio"), F.col("id"), F.col("ord"))).alias("at"))
    ordered = per.select("author_id", "at.prio", "at.id", "at.ord")
    return ordered if limit is None else ordered.orderBy("prio", "id", "ord").limit(limit)


def prominence(affiliations: Column, names: Column, roster_hit: Column | None = None) -> Column:
    """Up to two markers (type, label, colour). The dictionaries are fixed, so they unroll into the plan.
    `affiliations` and `names` are search texts."""
    padded = F.concat(F.lit(" "), affiliations, F.lit(" "))
    none = F.lit(None).cast("struct<type:string,label:string,color:string>")
    mark = lambda kind, label, colour: F.struct(F.lit(kind).alias("type"), F.lit(label).alias("label"), F.lit(colour).alias("color"))
    from perigee.params import search_text

    found = []
    for label, aliases, colour in ORGANISATIONS:
        hit = F.lit(False)
        for a in aliases:
            hit = hit | F.contains(padded, F.lit(f" {a} "))
        found.append(F.when(hit, mark("organization", label, colour)).otherwise(none))
    found += [F.when(F.array_contains(names, search_text(p)), mark("researcher", p, RESEARCHER_COLOUR)).otherwise(none) for p in PEOPLE]
    every = F.filter(F.array(*found), lambda x: x.isNotNull())
    if roster_hit is not None:
        every = F.array_distinct(F.concat(every, F.transform(roster_hit, lambda n: F.struct(F.lit("researcher").alias("type"), n.alias("label"), F.lit(RESEARCHER_COLOUR).alias("color")))))
    return F.slice(every, 1, 2)


def on_roster(authorships: DataFrame, prominent: DataFrame) -> DataFrame:
    """Ids of works with an author on the roster."""
    return authorships.join(prominent.select("author_id"), "author_id", "left_semi").select("id").distinct()


def h_index(citations: DataFrame) -> DataFrame:
    """(author_id, h_index) of (author_id, cited): the most rows with at least as many citations each."""
    w = Window.partitionBy("author_id").orderBy(F.desc("cited"))
    return citations.withColumn("place", F.row_number().over(w)).groupBy("author_id").agg(F.sum((F.col("cited") >= F.col("place")).cast("int")).cast("int").alias("h_index"))
