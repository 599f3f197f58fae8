"""The scoring plan: vectors, peers, crowding, standing, rarity, penalties, authorship, discovery."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perigee.functions import scoring, text
from perigee.operators import authorship, calibration, peers, similarity, vectors
from perigee.session import materialize, small


class Parts:
    """The intermediate relations of a scoring pass, each made when it is first asked for. With `keep`, those that
    several others read are checkpointed, so later plans stay small."""

    def __init__(self, works: DataFrame, least_peers: int = 20, most_peers: int = 320, keep: bool = False):
        self.works, self.most = works, most_peers
        self._keep = materialize if keep else lambda df: df
        self.refs, own = works.where("is_baseline"), works.where("NOT is_baseline")
        self.groups = peers.ladder(own, self.refs, least_peers)
        self.cands = own.join(self.groups.select("id", "group_key"), "id")

    @cached_property
    def lists(self) -> DataFrame:
        return self._keep(peers.lists(self.cands, peers.members(self.refs, self.groups), self.most))

    @cached_property
    def peer_works(self) -> DataFrame:
        """The works on any list."""
        used = materialize(self.lists.select(F.explode("refs").alias("id")).distinct())
        return self.refs.join(small(used), "id", "left_semi")

    @cached_property
    def chosen(self) -> DataFrame:
        """All pairs of a candidate and a peer, one after another; nothing here reads them."""
        return peers.expanded(self.cands, self.lists, self.most)

    @cached_property
    def counts(self) -> DataFrame:
        return peers.peer_counts(self.cands, self.lists, self.most)

    @cached_property
    def tf(self) -> DataFrame:
        return self._keep(vectors.term_frequencies(vectors.tokens(self.works)))

    @cached_property
    def idf(self) -> DataFrame:
        return self._keep(vectors.idf(self.tf, vectors.corpus_size(self.works)))

    @cached_property
    def vec(self) -> DataFrame:
        return vectors.weights(self.tf, self.idf)

    @cached_property
    def sims(self) -> DataFrame:
        return similarity.block_similarities(self.chosen, similarity.packed(self.vec))

    @cached_property
    def lexicon(self) -> vectors.Lexicon | None:
        return vectors.lexicon(self.works)

    def profiles(self, works: DataFrame) -> DataFrame:
        return vectors.joined_profiles(works, self.idf) if self.lexicon is None else vectors.profiles(works, self.lexicon)

    @cached_property
    def peer_profiles(self) -> DataFrame:
        return self._keep(self.profiles(self.peer_works))

    @cached_property
    def crowd(self) -> DataFrame:
        """(cand_id, n_peers, nearest_id, nearest_sim, crowding, distinctiveness) of each candidate."""
        near = similarity.nearest(self.cands, self.lists, self.profiles(self.works.where("NOT is_baseline")), self.peer_profiles, self.most)
        return self._keep(similarity.crowded(self.counts, near))


def parts(works: DataFrame, least_peers: int = 20, most_peers: int = 320, keep: bool = False) -> Parts:
    return Parts(works, least_peers, most_peers, keep)


def measured(p: Parts) -> DataFrame:
    own = p.cands.select(F.col("id").alias("cand_id"), "group_key")
    return materialize(p.crowd.join(own, "cand_id"))


def sample(p: Parts) -> DataFrame:
    listed, picked = calibration.field_sample(p.cands, p.lists, p.most)
    return materialize(calibration.sample_statistics(materialize(listed), materialize(picked), p.peer_profiles.select("id", "terms", "weights"), p.peer_profiles))


def standings(p: Parts) -> DataFrame:
    return calibration.standing(sample(p), measured(p))


def novelty(works: DataFrame, keep: bool = True) -> DataFrame:
    """(cand_id, group_key, n_peers, nearest_id, nearest_sim, crowding, distinctiveness, relative, phrase,
    bridge, penalty, raw, confidence, novelty) of each candidate."""
    p = parts(works, keep=keep)
    m = measured(p)
    title, abstract = F.col("title"), F.col("abstract")
    texts = works.where("NOT is_baseline").select(
        F.col("id").alias("cand_id"),
        F.least(F.lit(34), text.marker_count(title, abstract) * 5 + text.consolidation(title, abstract)).alias("penalty"),
        F.size(text.tokenize(abstract, 200)).alias("abstract_tokens"),
    )
    phrase = calibration.phrase_rarity(p.works, p.cands, p.lists, p.peer_works, p.most).withColumnRenamed("rarity", "phrase")
    bridge = calibration.bridge_rarity(p.works, p.cands, p.lists, p.peer_works, p.most).withColumnRenamed("rarity", "bridge")
    rows = m.join(calibration.standing(sample(p), m), "cand_id").join(texts, "cand_id").join(phrase, "cand_id").join(bridge, "cand_id")
    relative = scoring.relative_standing(F.col("crowd_standing"), F.col("distinct_standing"))
    base = F.when(F.col("relative").isNull(), scoring.fallback_score(F.col("nearest_sim"))).otherwise(F.lit(100.0) * F.col("relative"))
    rows = rows.withColumn("relative", relative).withColumn("raw", scoring.raw_novelty(base, F.col("phrase"), F.col("bridge"), F.col("penalty")))
    rows = rows.withColumn("confidence", scoring.confidence(F.col("n_peers"), scoring.completeness(F.col("abstract_tokens"))))
    return rows.withColumn("novelty", scoring.shrunk(F.col("raw"), F.col("confidence"))).drop("crowd_standing", "distinct_standing", "abstract_tokens")


def discovery(works: DataFrame, authorships: DataFrame, authors: DataFrame) -> DataFrame:
    """Candidates with novelty, authorship and discovery."""
    n = novelty(works)
    a = authorship.authorship_scores(works.where("NOT is_baseline"), authorships, authors).select(F.col("id").alias("cand_id"), F.col("score").alias("authorship"), F.col("confidence").alias("authorship_confidence"), "evidence")
    return n.join(a, "cand_id").withColumn("discovery", scoring.discovery(F.col("novelty"), F.col("authorship")))
