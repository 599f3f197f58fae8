"""Standing in the field: sampled field statistics, ranks, rarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from perigee.functions.text import title_phrases
from perigee.operators.peers import expanded, unseen_share
from perigee.operators.ranks import running
from perigee.operators.similarity import block_similarities, crowdedness

SAMPLE = 90
LEAST = 4


def field_sample(cands: DataFrame, older: DataFrame, most_peers: int = 320, most: int = SAMPLE) -> tuple[DataFrame, DataFrame]:
    """(group_key, id, ord) of the peers of each group's first candidate, and the evenly spaced sample."""
    first = cands.groupBy("group_key").agg(F.min("id").alias("id"), F.min_by("date", "id").alias("date"))
    peers = expanded(first, older, most_peers).select("group_key", F.col("ref_id").alias("id"), "ord")
    n = peers.groupBy("group_key").agg(F.count(F.lit(1)).alias("n_list"))
    step = F.greatest(F.lit(1), F.floor(F.col("n_list") / most))
    at = F.col("ord") - 1
    picked = peers.join(n, "group_key").where((at % step == 0) & (F.floor(at / step) < most))
    return peers, picked.select("group_key", "id", "n_list")


def sample_statistics(peers: DataFrame, picked: DataFrame, vectors: DataFrame, distinct: DataFrame) -> DataFrame:
    """(group_key, id, crowding, distinctiveness) of the sampled peers, each against the rest of its list; vectors are
    packed ones."""
    keyed = F.concat_ws("/", "group_key", "id")
    mine = picked.select(keyed.alias("cand_id"), F.col("id").alias("own"), "group_key", "n_list")
    others = mine.join(peers.select("group_key", F.col("id").alias("ref_id"), "ord"), "group_key").where("ref_id <> own").select("cand_id", "ref_id", "group_key", "ord")
    left = mine.select("cand_id", "own").join(vectors.withColumnRenamed("id", "own"), "own").select(F.col("cand_id").alias("id"), "terms", "weights")
    sims = block_similarities(others, left, vectors)
    counts = mine.select("cand_id", (F.col("n_list") - 1).alias("n_peers"))
    crowd = crowdedness(counts, sims).select("cand_id", "crowding")
    return mine.join(crowd, "cand_id").join(distinct.select(F.col("id").alias("own"), "distinctiveness"), "own").select("group_key", F.col("own").alias("id"), "crowding", "distinctiveness")


def field_statistics(stats: DataFrame) -> DataFrame:
    """(group_key, n_sample, median_crowding, median_distinct); null medians under four values."""
    enough = F.count(F.lit(1)) >= LEAST
    return stats.groupBy("group_key").agg(F.count(F.lit(1)).alias("n_sample"), F.when(enough, F.median("crowding")).alias("median_crowding"), F.when(enough, F.median("distinctiveness")).alias("median_distinct"))


def standing(stats: DataFrame, measured: DataFrame) -> DataFrame:
    """(cand_id, crowd_standing, distinct_standing): 0.9 of the share of the field that is less novel.

    The field is the sample and all candidates of the group; groups with a sample under four have none.
    Values are counted before they are ranked, and ranked range by range, so no task holds a group. Values are rounded to nine places first: sums of the same terms in
    another order must tie.
    """
    nine = lambda df: df.withColumns({c: F.round(c, 9) for c in ("crowding", "distinctiveness")})
    stats, measured = nine(stats), nine(measured)
    enough = stats.groupBy("group_key").agg(F.count(F.lit(1)).alias("n_sample")).where(F.col("n_sample") >= LEAST).select("group_key")
    field = stats.select("group_key", "crowding", "distinctiveness").unionByName(measured.select("group_key", "crowding", "distinctiveness")).join(enough, "group_key", "left_semi")

    def ranks(column: str, descending: bool, name: str) -> DataFrame:
        counted = field.groupBy("group_key", column).agg(F.count(F.lit(1)).alias("n"))
        ranked = running(counted, column, "n", ["group_key"], descending)
        return ranked.select("group_key", column, (F.lit(0.9) * F.col("before") / F.col("total")).alias(name))

    crowd = ranks("crowding", True, "crowd_standing")
    distinct = ranks("distinctiveness", False, "distinct_standing")
    both = measured.join(crowd, ["group_key", "crowding"], "left").join(distinct, ["group_key", "distinctiveness"], "left")
    return both.select("cand_id", "crowd_standing", "distinct_standing")


def phrase_rarity(works: DataFrame, cands: DataFrame, older: DataFrame, theirs: DataFrame, most_peers: int = 320) -> DataFrame:
    """(cand_id, rarity): how many of a title's phrases no peer's title has, from 0 to 1; 0.5 without any. `theirs` are
    the works that are peers. Phrases are compared by 64-bit hashes, as each list meets those of all its members."""
    phrases = lambda w: w.select("id", F.explode(title_phrases(F.col("title"))).alias("words")).select("id", F.xxhash64("words").alias("item"))
    mine = phrases(works.where("NOT is_baseline")).groupBy("id", "item").agg(F.count(F.lit(1)).alias("times"))
    share = unseen_share(cands, mine, phrases(theirs).distinct(), older, most_peers)
    rarity = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("u") - F.lit(0.35)) / F.lit(0.65)))
    return cands.select(F.col("id").alias("cand_id")).join(share, "cand_id", "left").select("cand_id", F.coalesce(rarity, F.lit(0.5)).alias("rarity"))


def field_pairs(fields) -> object:
    """Unordered pairs of the distinct entries of an array column, as 'x|y'."""
    own = F.array_sort(F.array_distinct(F.filter(fields, lambda f: f.isNotNull() & (f != ""))))
    return F.flatten(F.transform(own, lambda x, i: F.transform(F.slice(own, i + 2, F.size(own)), lambda y: F.concat(x, F.lit("|"), y))))


def bridge_rarity(works: DataFrame, cands: DataFrame, older: DataFrame, theirs: DataFrame, most_peers: int = 320) -> DataFrame:
    """(cand_id, rarity): the share of a work's pairs of fields that no peer joins; 0.35 under two fields. `theirs` are
    the works that are peers."""
    joined = lambda w: w.select("id", F.explode(field_pairs(F.col("fields"))).alias("item")).distinct()
    mine = joined(works.where("NOT is_baseline")).withColumn("times", F.lit(1))
    share = unseen_share(cands, mine, joined(theirs), older, most_peers)
    return cands.select(F.col("id").alias("cand_id")).join(share, "cand_id", "left").select("cand_id", F.coalesce("u", F.lit(0.35)).alias("rarity"))
