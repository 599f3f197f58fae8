"""Which older works a candidate is compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def references(works: DataFrame, limit: int | None = None) -> DataFrame:
    """Reference works: the baseline in id order, then the others by date, newest first. A limit is a
    distributed top-k."""
    ordered = works.orderBy(F.desc("is_baseline"), F.when(F.col("is_baseline"), None).otherwise(F.col("date")).desc(), "id")
    return works if limit is None else ordered.limit(limit)


def ladder(cands: DataFrame, refs: DataFrame, least: int = 20) -> DataFrame:
    """(id, rung, group_key, n_group): the subfield if it has enough references, else the domain, else all."""
    by_sub = refs.where("subfield IS NOT NULL").groupBy("subfield").agg(F.count(F.lit(1)).alias("n_sub"))
    by_dom = refs.where("domain IS NOT NULL").groupBy("domain").agg(F.count(F.lit(1)).alias("n_dom"))
    total = refs.agg(F.count(F.lit(1)).alias("n_all"))
    c = cands.select("id", "subfield", "domain").join(by_sub, "subfield", "left").join(by_dom, "domain", "left").crossJoin(F.broadcast(total))
    sub, dom = F.coalesce("n_sub", F.lit(0)) >= least, F.coalesce("n_dom", F.lit(0)) >= least
    return c.select(
        "id",
        F.when(sub, "subfield").when(dom, "domain").otherwise("all").alias("rung"),
        F.when(sub, F.concat(F.lit("subfield:"), "subfield")).when(dom, F.concat(F.lit("domain:"), "domain")).otherwise("all").alias("group_key"),
        F.when(sub, F.col("n_sub")).when(dom, F.col("n_dom")).otherwise(F.col("n_all")).alias("n_group"),
    )


def members(refs: DataFrame, groups: DataFrame) -> DataFrame:
    """(group_key, id, date) of the references of the groups in use; the list of groups is a distinct of keys."""
    used = groups.select("group_key").distinct()
    keys = F.array(F.concat(F.lit("subfield:"), F.col("subfield")), F.concat(F.lit("domain:"), F.col("domain")), F.lit("all"))
    each = refs.select("id", "date", F.explode(F.filter(keys, lambda k: k.isNotNull())).alias("group_key"))
    return each.join(used, "group_key", "left_semi").select("group_key", "id", "date")


def _first(rows: DataFrame, by: list[str], most: int) -> DataFrame:
    """The `most` least ids of each group; tasks cut their own rows to that number before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy("id"))
    return rows.withColumn("place", place).where(F.col("place") <= most).drop("place")


def _merged(rows: DataFrame, by: list[str], most: int) -> DataFrame:
    """The `most` least of the ids that a group's rows have in arrays."""
    return rows.groupBy(*by).agg(F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, most).alias("ids"))


def older_lists(group_members: DataFrame, cands: DataFrame, most: int = 320) -> DataFrame:
    """(group_key, cand_date, ids): the first `most` members of a group, in id order, that are older than a date, for
    each date of the group's candidates.

    Nobody behind `most` others of one day or month can be on a list, so days and months are cut first, and what is
    joined is bounded by the number of dates, not of members: whole months before a date's own, and its own by days.
    Each day's and month's ids are one array, so what tasks sort are lists, not their members.
    """
    dated = group_members.where("date IS NOT NULL").withColumn("month", F.trunc("date", "month"))
    per_day = _first(dated, ["group_key", "date", "month"], most).groupBy("group_key", "date", "month").agg(F.collect_list("id").alias("ids"))
    per_month = _merged(per_day, ["group_key", "month"], most)
    asked = cands.where("date IS NOT NULL").select("group_key", F.col("date").alias("cand_date")).distinct()
    asked = asked.withColumn("cand_month", F.trunc("cand_date", "month"))
    months = asked.select("group_key", "cand_month").distinct()
    before = _merged(months.join(per_month, "group_key").where("month < cand_month"), ["group_key", "cand_month"], most)
    whole = asked.join(before, ["group_key", "cand_month"]).select("group_key", "cand_date", "ids")
    own = asked.join(per_day.withColumnRenamed("month", "cand_month"), ["group_key", "cand_month"]).where("date < cand_date").select("group_key", "cand_date", "ids")
    return _merged(whole.unionByName(own), ["group_key", "cand_date"], most)


def lists(cands: DataFrame, group_members: DataFrame, most: int = 320) -> DataFrame:
    """(group_key, cand_date, refs, n_cands): the first `most` + 1 older members for each date of a group's candidates,
    in order, and how many candidates share them. One row stands for all of these, so nothing grows with the pairs; a
    candidate's own peers are the first `most` of them without itself."""
    own = older_lists(group_members, cands, most + 1).withColumnRenamed("ids", "refs")
    n = cands.where("date IS NOT NULL").groupBy("group_key", F.col("date").alias("cand_date")).agg(F.count(F.lit(1)).alias("n_cands"))
    return own.join(n, ["group_key", "cand_date"])


def own_peers(cand: str, most: int):
    """A candidate's own peers in `refs`."""
    return F.slice(F.array_remove("refs", F.col(cand)), 1, most)


def listed(cands: DataFrame, older: DataFrame, how: str = "inner") -> DataFrame:
    """(cand_id, group_key, cand_date, ...) of the candidates with the columns of their list."""
    c = cands.select(F.col("id").alias("cand_id"), "group_key", F.col("date").alias("cand_date"))
    return c.join(older, ["group_key", "cand_date"], how)


def expanded(cands: DataFrame, older: DataFrame, most: int = 320) -> DataFrame:
    """(cand_id, ref_id, group_key, ord): the pairs that the lists stand for."""
    each = listed(cands, older).select("cand_id", "group_key", F.posexplode(own_peers("cand_id", most)).alias("at", "ref_id"))
    return each.select("cand_id", "ref_id", "group_key", (F.col("at") + 1).alias("ord"))


def pairs(cands: DataFrame, group_members: DataFrame, most: int = 320) -> DataFrame:
    """(cand_id, ref_id, group_key, ord): the first `most` older members of a candidate's group, itself left out."""
    return expanded(cands, lists(cands, group_members, most), most)


def peer_counts(cands: DataFrame, older: DataFrame, most: int = 320) -> DataFrame:
    own = own_peers("cand_id", most)
    n = F.when(F.col("refs").isNotNull(), F.size(own)).otherwise(0).cast("long")
    return listed(cands, older, "left").select("cand_id", n.alias("n_peers"), F.get(own, F.lit(0)).alias("min_ref"), F.get(own, F.size(own) - 1).alias("max_ref"))


def held(older: DataFrame, items: DataFrame, most: int = 320) -> DataFrame:
    """(group_key, cand_date, item, n_first, n_last): how many of the first `most` and of the other members of a list
    have an item; items: (id, item), distinct."""
    each = older.select("group_key", "cand_date", F.posexplode("refs").alias("at", "id")).join(items, "id")
    first = F.col("at") < most
    return each.groupBy("group_key", "cand_date", "item").agg(F.count_if(first).alias("n_first"), F.count_if(~first).alias("n_last"))


def unseen_share(cands: DataFrame, mine: DataFrame, theirs: DataFrame, older: DataFrame, most: int = 320) -> DataFrame:
    """(cand_id, u): the share of a candidate's items (id, item, times) that none of its peers has (id, item)."""
    place = F.array_position("refs", F.col("cand_id"))
    c = listed(cands, older, "left").select(F.col("cand_id").alias("id"), "group_key", "cand_date", F.coalesce(place.between(1, most), F.lit(False)).alias("on_list"))
    asked = theirs.join(mine.select("item").distinct(), "item", "left_semi")  # items of no candidate meet nobody
    each = c.join(mine, "id").join(held(older, asked, most), ["group_key", "cand_date", "item"], "left")
    known = F.when(F.col("on_list"), F.col("n_first") - 1 + F.col("n_last")).otherwise(F.col("n_first")) > 0
    return each.groupBy(F.col("id").alias("cand_id")).agg((F.sum(F.when(F.coalesce(known, F.lit(False)), 0).otherwise(F.col("times"))) / F.sum("times")).alias("u"))
