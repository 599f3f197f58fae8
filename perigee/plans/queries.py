"""One query per operator over the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perigee.functions import scoring, text
from perigee.operators import authorship, calibration, feed, filters, gates, peers, resolve, state, vectors
from perigee.params import QueryParams, top_fraction
from perigee.plans import novelty as plan
from perigee.plans import views
from perigee.session import spread, table

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def r6(c, name: str):
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name)


# text


@query
def tokens_per_doc(spark: SparkSession, d: str) -> DataFrame:
    t = text.tokenize(F.col("text"), 1_000_000_000)
    return table(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


@query
def title_ngrams(spark, d):
    grams = views.works(spark, d).select(F.col("id").alias("doc_id"), F.explode(text.title_phrases(F.col("title"))).alias("gram"))
    return grams.groupBy("doc_id", "gram").agg(F.count(F.lit(1)).alias("cnt"))


@query
def penalties(spark, d):
    w, t, a = views.works(spark, d), F.col("title"), F.col("abstract")
    # the invented prose has no markers; texts of its own kinds stand in for them
    t = F.expr("concat(title, CASE id % 9 WHEN 0 THEN ' Improved extension of it' WHEN 1 THEN ' A systematic review' WHEN 2 THEN ' benchmarks, a case study' ELSE '' END)")
    a = F.expr("concat(CASE id % 7 WHEN 0 THEN 'We survey of revisiting fine-tuning. ' WHEN 1 THEN 'An empirical study and tutorial; ' ELSE '' END, abstract)")
    m, c = text.marker_count(t, a), text.consolidation(t, a)
    return w.select(F.col("id").alias("doc_id"), m.cast("long").alias("markers"), c.cast("long").alias("consolidation"), F.least(F.lit(34), m * 5 + c).cast("long").alias("penalty"))


@query
def arxiv_month(spark, d):
    return views.works(spark, d).select(F.col("id").alias("doc_id"), text.arxiv_month(F.col("preprint_id")).cast("string").alias("value"))


@query
def first_release(spark, d):
    return views.works(spark, d).select(F.col("id").alias("doc_id"), F.col("first_release").cast("string").alias("value"))


@query
def doi_norm(spark, d):
    raw = F.expr("CASE doc_id % 4 WHEN 0 THEN concat('https://doi.org/10.1/X', doc_id) WHEN 1 THEN concat('http://dx.doi.org/10.1/x', doc_id) WHEN 2 THEN concat('DOI: 10.1/', doc_id, ' ') END")
    return table(spark, d, "documents").select("doc_id", text.doi(raw).alias("value"))


@query
def short_id(spark, d):
    raw = F.expr("CASE doc_id % 3 WHEN 0 THEN concat('https://example.org/W', doc_id, '/') WHEN 1 THEN concat('W', doc_id) ELSE concat('https://example.org/fields/', doc_id % 40) END")
    return table(spark, d, "documents").select("doc_id", text.short_id(raw).alias("value"), text.taxonomy_id(raw).alias("taxonomy"))


@query
def arxiv_id_extract(spark, d):
    urls = F.expr("array(concat('https://example.org/', doc_id), CASE doc_id % 3 WHEN 0 THEN concat('https://arxiv.org/abs/2101.', lpad(doc_id, 5, '0'), 'v3') WHEN 1 THEN concat('http://ARXIV.org/pdf/hep-th/', doc_id, '.pdf?x=1') END)")
    return table(spark, d, "documents").select("doc_id", text.arxiv_id(urls).alias("value"))


@query
def abstract_from_index(spark, d):
    """Rebuilds each text's words from an inverted index made of them, row by row."""
    words = spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id").select("doc_id", F.split("text", r"\s+").alias("words"))
    # a generator keeps the index from being made anew wherever it is named
    index = words.where(F.exists("words", lambda w: w != "")).select("doc_id", F.explode(F.array(text.inverted_index(F.col("words")))).alias("index"))
    return index.select("doc_id", text.abstract_from_index(F.col("index")).alias("text"))


@query
def clean_text_ascii(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.regexp_replace("html", r"[^\x00-\x7F]", "").alias("html"))
    return pages.select("page_id", text.clean_text_ascii(F.col("html"), repair=False).alias("text"))


@query
def clean_text_unicode(spark, d):
    """The full cleaner and search text; pandas functions, as NFKC and NFKD have no JVM function."""
    return table(spark, d, "pages").select("page_id", text.clean_text("html").alias("text"), text.search_text(text.clean_text("html")).alias("search"))


@query
def safe_urls(spark, d):
    raw = F.expr("CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN concat('javascript:', url) WHEN 2 THEN NULL ELSE concat('HTTP', substr(url, 5)) END")
    return table(spark, d, "pages").select("page_id", text.safe_url(raw, F.expr("concat('https://example.org/', page_id)")).alias("url"))


@query
def snippets(spark, d):
    w = views.works(spark, d).select("id", "abstract", text.search_text(F.col("abstract")).alias("normalized"))
    return w.select(F.col("id").alias("doc_id"), text.snippet(F.col("abstract"), "of ther", F.col("normalized")).alias("snippet"))


# vectors and peers


@query
def idf_top_terms(spark, d):
    w = views.works(spark, d)
    idf = vectors.idf(vectors.term_frequencies(vectors.tokens(w)), vectors.corpus_size(w))
    return idf.orderBy(F.desc("df"), "term").limit(200).select("term", F.col("df").cast("long").alias("df"), r6("idf", "idf"))


@query
def tfidf_norms(spark, d):
    return vectors.lengths(views.works(spark, d)).select(F.col("id").alias("doc_id"), r6("norm", "norm"))


@query
def peer_ladder(spark, d):
    w = views.works(spark, d)
    return peers.ladder(views.candidates(w), views.baseline(w)).select(F.col("id").alias("doc_id"), "rung", "group_key", F.col("n_group").cast("long").alias("n_group"))


@query
def peer_selection(spark, d):
    return plan.parts(views.works(spark, d)).counts.select("cand_id", F.col("n_peers").cast("long").alias("n_peers"), "min_ref", "max_ref")


@query
def reference_selection(spark, d):
    return peers.references(views.works(spark, d), 6000).select(F.col("id").alias("doc_id"), "is_baseline")


@query
def nearest_peer(spark, d):
    c = plan.parts(views.works(spark, d), keep=True).crowd
    return c.select("cand_id", "nearest_id", r6("nearest_sim", "nearest_sim"), F.col("n_peers").cast("long").alias("n_peers"))


@query
def crowding(spark, d):
    return plan.parts(views.works(spark, d), keep=True).crowd.select("cand_id", r6("crowding", "crowding"))


@query
def distinctiveness(spark, d):
    return vectors.own_distinctiveness(views.works(spark, d)).select(F.col("id").alias("doc_id"), r6("distinctiveness", "distinctiveness"))


# calibration


@query
def field_stats(spark, d):
    s = calibration.field_statistics(plan.sample(plan.parts(views.works(spark, d), keep=True)))
    return s.select("group_key", F.col("n_sample").cast("long").alias("n_sample"), r6("median_crowding", "median_crowding"), r6("median_distinct", "median_distinct"))


@query
def standing(spark, d):
    s = plan.standings(plan.parts(views.works(spark, d), keep=True))
    rel = scoring.relative_standing(F.col("crowd_standing"), F.col("distinct_standing"))
    return s.select("cand_id", F.round("crowd_standing", 4).alias("crowd_standing"), F.round("distinct_standing", 4).alias("distinct_standing"), F.round(rel, 4).alias("relative"))


@query
def phrase_rarity(spark, d):
    p = plan.parts(views.works(spark, d), keep=True)
    return calibration.phrase_rarity(p.works, p.cands, p.lists, p.peer_works, p.most).select("cand_id", r6("rarity", "rarity"))


@query
def bridge_rarity(spark, d):
    p = plan.parts(views.works(spark, d), keep=True)
    return calibration.bridge_rarity(p.works, p.cands, p.lists, p.peer_works, p.most).select("cand_id", r6("rarity", "rarity"))


@query
def absolute_novelty(spark, d):
    c = plan.parts(views.works(spark, d), keep=True).crowd
    return c.select("cand_id", r6(scoring.fallback_score(F.col("nearest_sim")), "fallback_score"))


@query
def novelty_score(spark, d):
    n = plan.novelty(views.works(spark, d))
    return n.select("cand_id", F.round("raw", 4).alias("raw"), r6("confidence", "confidence"), F.round("novelty", 4).alias("novelty"))


# authors


@query
def career_score(spark, d):
    return authorship.careers(views.authors(spark, d)).select("author_id", r6("career", "career"))


@query
def authorship_score(spark, d):
    w = views.works(spark, d)
    s = authorship.authorship_scores(w, views.authorships(spark, d), views.authors(spark, d))
    return s.select(F.col("id").alias("doc_id"), r6("score", "score"), r6("confidence", "confidence"), F.size("evidence").cast("long").alias("n_evidence"))


@query
def author_roster(spark, d):
    named = F.expr("CASE cast(substr(author_id, 2) AS long) % 7 WHEN 0 THEN 'Jürgen SCHMIDHUBER' WHEN 1 THEN ' yann  le-cun' WHEN 2 THEN 'YANN LÉCUN' ELSE name END")
    a = views.authors(spark, d).withColumn("name", named)
    return authorship.roster(a, 6, 1200.0).select("author_id", "name", F.col("h_index").cast("long").alias("h_index"), F.col("cited_by").cast("double").alias("cited_by"))


@query
def prominence_override(spark, d):
    w = views.works(spark, d)
    place = F.expr("""CASE id % 11 WHEN 0 THEN 'dept of vision mila quebec' WHEN 1 THEN 'fair and openai' WHEN 2 THEN 'unfair school' WHEN 3 THEN 'nvidia research lab bair deepmind' ELSE 'university of x' END""")
    names = F.expr("CASE id % 13 WHEN 0 THEN array('yann lecun', 'a b') WHEN 1 THEN array('andrew ng') ELSE array('c d') END")
    hit = authorship.on_roster(views.authorships(spark, d), authorship.roster(views.authors(spark, d), 6, 1200.0)).withColumn("hit", F.lit(True))
    marks = w.join(hit, "id", "left").select("id", authorship.prominence(place, names, F.when(F.col("hit"), F.array(F.lit("Roster"))).otherwise(F.array().cast("array<string>"))).alias("m"))
    return marks.select(F.col("id").alias("doc_id"), F.size("m").cast("long").alias("n_markers"), (F.size("m") > 0).alias("override"), F.array_join(F.transform("m", lambda x: x["label"]), ",").alias("labels"))


@query
def priority_authors(spark, d):
    out = authorship.priority_authors(views.authorships(spark, d), 500)
    return out.select("author_id", F.col("prio").cast("long").alias("prio"), F.col("id").alias("first_doc"), F.col("ord").cast("long").alias("ord"))


@query
def discovery_score(spark, d):
    n = plan.discovery(views.works(spark, d), views.authorships(spark, d), views.authors(spark, d))
    return n.select(F.col("cand_id").alias("doc_id"), F.round("novelty", 4).alias("novelty"), F.round("authorship", 4).alias("authorship"), F.round("discovery", 4).alias("discovery"))


# gates and feeds


@query
def selectivity_cutoffs(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_totalprice").alias("v"))
    steps = (1, 10, 20, 40, 55, 60, 80, 90, 95, 100)
    asked = F.explode(F.array(*[F.struct(F.lit(s).cast("long").alias("selectivity"), F.lit(top_fraction(s)).alias("of")) for s in steps]))
    each = gates.cutoffs(rows, "v", sorted({top_fraction(s) for s in steps})).select("fraction", "cutoff", asked.alias("s")).where("fraction = s.of")
    return each.select("s.selectivity", F.round("fraction", 6).alias("fraction"), F.when(F.col("cutoff") > F.lit(float("-inf")), F.col("cutoff")).alias("cutoff"))


@query
def dual_gate(spark, d):
    return gates.gated(views.gate_rows(spark, d), 40, 40).select(F.col("id").alias("doc_id"))


def _feed(sort: str):
    def run(spark, d):
        f = feed.feed(views.gate_rows(spark, d), views.AS_OF, "3m", sort, 30, 30, limit=100)
        return f.select(F.col("id").alias("doc_id"), F.col("first_release").cast("string").alias("first_release"), r6("novelty", "novelty"), r6("authorship", "authorship"), r6("discovery", "discovery"))

    return run


for _sort in ("balanced", "novelty", "researcher", "newest"):
    QUERIES[f"feed_{_sort}"] = _feed(_sort)


@query
def feed_page_two(spark, d):
    """The second page, works about an interest first."""
    match = filters.with_tokens(views.search_columns(spark, d), "abstract").select("id", filters.matches("abstract", "thing").alias("hit"))
    rows = views.gate_rows(spark, d).join(match, "id")
    return feed.feed(rows, views.AS_OF, "3m", "balanced", 10, 10, offset=20, limit=20, matched=F.col("hit")).select(F.col("id").alias("doc_id"), "hit")


@query
def feed_bundle(spark, d):
    return feed.bundle(views.gate_rows(spark, d), views.AS_OF, 90, 40, 40)


# filters

SCOPE = QueryParams.from_dict({"fields": ["https://x.org/fields/3"], "subfields": ["1702"], "queries": ["thing of the"], "english_only": True})
STRICT = QueryParams.from_dict({**{"fields": ["3"], "subfields": ["1702"], "queries": ["then thing"]}, "strict_interest": True})


def _scope_rows(spark, d):
    return views.search_columns(spark, d).select("*", F.expr("concat('https://x.org/fields/', id % 6)").alias("field_id"), F.expr("CASE WHEN id % 4 = 0 THEN 'https://x.org/subfields/1702' ELSE concat('17', id % 40) END").alias("subfield_id"), F.expr("CASE WHEN id % 8 = 0 THEN concat(title, ' deep learning') ELSE title END").alias("topic_title"))


@query
def scope_filter(spark, d):
    rows = _scope_rows(spark, d)
    return rows.where(filters.passes(SCOPE, F.col("language"), F.col("field_id"), F.col("subfield_id"), "topic_title")).select(F.col("id").alias("doc_id"))


@query
def scope_filter_strict(spark, d):
    rows = filters.with_tokens(_scope_rows(spark, d), "topic_title", "abstract")
    return rows.where(filters.passes(STRICT, F.col("language"), F.col("field_id"), F.col("subfield_id"), "topic_title")).select(F.col("id").alias("doc_id"))


@query
def secondary_classification(spark, d):
    p = QueryParams.from_dict({"groups": ["physics", "cs"], "english_only": False})
    codes = F.expr("CASE id % 5 WHEN 0 THEN array('cs.AI', 'math.CO') WHEN 1 THEN array('hep-th') WHEN 2 THEN array('math.CO') WHEN 3 THEN array('cs') ELSE cast(array() as array<string>) END")
    return views.works(spark, d).where(filters.in_scope(p, F.col("language"), F.lit("1"), F.lit("2"), codes)).select(F.col("id").alias("doc_id"))


@query
def category_evidence(spark, d):
    rows = _scope_rows(spark, d)
    return rows.select(F.col("id").alias("doc_id"), filters.category_evidence(F.col("subfield_id"), F.concat_ws(" ", "topic_title", "abstract")).alias("has_evidence"))


INTERESTS = ["thertion ingthes", "rag", "stupid", "of the onther and"]


@query
def interest_match(spark, d):
    rows = views.search_columns(spark, d).withColumn("labels", F.concat_ws(" ", "subfield", "domain"))
    rows = filters.with_tokens(rows, "title", "abstract", "labels")
    hit = filters.interest_location(INTERESTS, labels="labels")
    return rows.select(F.col("id").alias("doc_id"), hit.alias("hit")).select("doc_id", F.col("hit.query").alias("query"), F.col("hit.location").alias("location"))


@query
def initials_match(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", F.rlike(text.search_text(F.col("text")), F.lit(filters.initials_pattern("ota"))).alias("matched"))


# resolution and sets


@query
def entity_resolution(spark, d):
    w = views.works(spark, d)
    names = F.expr("CASE WHEN id % 10 = 9 THEN cast(array() as array<string>) ELSE array(language, '', concat('b', 1)) END")
    doi = F.expr("CASE WHEN id % 20 = 9 THEN concat('https://doi.org/10.1/', id % 50) END")
    key = resolve.paper_key(text.search_text(F.col("title")), names, doi, F.when(F.expr("id % 40 = 19"), F.col("preprint_id")), F.col("id"))
    g = views.works(spark, d).select("id", "abstract", "date", F.col("first_release").alias("released"), key.alias("key"), F.expr("cast(id % 100 as double)").alias("novelty"), F.expr("cast(id % 37 as double)").alias("authorship"), F.expr("cast(id % 53 as double)").alias("discovery"), F.expr("concat('S', id % 3)").alias("source_name"), F.expr("concat('http://x/', id % 2)").alias("source_url"))
    out = resolve.group_papers(g)
    return out.select("key", "best_id", F.col("n_dups").cast("long").alias("n_dups"), F.col("min_date").cast("string").alias("min_date"), F.col("first_release").cast("string").alias("first_release"), "novelty", "authorship", "discovery", "score_source_id", F.size("sources").cast("long").alias("n_sources"), F.array_join("ids", ",").alias("ids"))


@query
def dedup_last_wins(spark, d):
    return resolve.last_wins(table(spark, d, "events").select("user_id", "event_id"), "user_id", "event_id")


@query
def dedup_first_wins(spark, d):
    return resolve.first_wins(table(spark, d, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id")


@query
def lane_union(spark, d):
    w = views.works(spark, d).select("id", "subfield")
    return resolve.union_lanes([w.where("subfield IN ('src1', 'src2')"), w.where("id % 3 = 0"), w.where("subfield = 'src2'")], "id").select(F.col("id").alias("doc_id"), F.col("lane").cast("long").alias("lane"))


@query
def new_minus_known(spark, d):
    known = table(spark, d, "labels").select("doc_id")
    return resolve.new_only(table(spark, d, "documents").select("doc_id", "lang"), known, "doc_id")


@query
def qualified_and_new(spark, d):
    labels = table(spark, d, "labels")
    return resolve.qualified_and_new(table(spark, d, "documents").select("doc_id"), labels.where("quality = 1"), labels.where("toxic = 1"), "doc_id")


# taxonomy


@query
def taxonomy_tree(spark, d):
    from perigee.sources.taxonomy import tree

    fields = table(spark, d, "region").select(F.col("r_regionkey").alias("field_id"), F.col("r_name").alias("name"))
    subs = table(spark, d, "nation").select(F.col("n_nationkey").alias("subfield_id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("field_id"))
    return tree(fields, subs).select("name", F.array_join(F.transform("subfields", lambda s: s["name"]), ",").alias("children"))


@query
def taxonomy_expand(spark, d):
    from perigee.sources.taxonomy import expand

    subs = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("subfield_id"), F.col("n_regionkey").cast("string").alias("field_id"))
    return expand(subs, ["1", "3"], ["0", "99"])


@query
def taxonomy_mapping(spark, d):
    """Fields of the general system that no group of the other one covers."""
    from perigee.sources.taxonomy import uncovered

    fields = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("field_id"), F.col("n_name").alias("name"))
    mapping = table(spark, d, "supplier").select(F.concat(F.lit("g"), (F.col("s_suppkey") % 9)).alias("group_id"), (F.col("s_suppkey") % 9).cast("string").alias("field_id"))
    return uncovered(fields, mapping)


@query
def html_taxonomy(spark, d):
    from perigee.sources.taxonomy import parse_links

    return parse_links(table(spark, d, "pages"))


# state


@query
def budget_prefix(spark, d):
    cost = F.expr("CASE WHEN event_id % 10 = 0 THEN 0.001D ELSE 0.0001D END")
    out = state.budget_prefix(table(spark, d, "events").select("event_id", cost.alias("cost")), 0.3, "event_id", "cost")
    return out.select("event_id", r6("running_cost", "running_cost"))


@query
def upsert(spark, d):
    stored = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    lines = table(spark, d, "lineitem").where("l_quantity > 45")
    place = (F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))  # line numbers repeat: the first in the table stays
    new = lines.select(F.col("l_orderkey").alias("id"), F.col("l_extendedprice").alias("price"), F.col("l_linenumber").alias("seq"), *place)
    return state.upsert(stored, new, "id", ("file", "row"))


@query
def retention_prune(spark, d):
    return state.retain(views.works(spark, d), views.AS_OF, 400).select(F.col("id").alias("doc_id"))


@query
def coverage_metrics(spark, d):
    w = views.works(spark, d)
    lanes = [w.where("subfield = 'src1'"), w.where("subfield IN ('src1', 'src3')")]
    totals = lanes[0].agg(F.count(F.lit(1)).alias("total")).unionByName(lanes[1].agg(F.count(F.lit(1)).alias("total")))
    got = lanes[0].unionByName(lanes[1]).where("id % 3 <> 0").select("id")
    return state.coverage(totals, got).select(F.col("available").cast("long").alias("available"), F.col("records").cast("long").alias("records"), r6("percent", "percent"))


@query
def daily_usage(spark, d):
    e = table(spark, d, "events").select("ts", F.expr("round(value, 2)").alias("cost"), F.expr("event_id % 5 = 0").alias("estimated"), F.expr("CASE WHEN event_id % 3 = 0 THEN 1000 - event_id % 100 END").alias("remaining"), F.col("event_id").alias("seq"))
    out = state.daily_usage(e)
    return out.select(F.col("day").cast("string").alias("day"), F.col("requests").cast("long").alias("requests"), F.round("cost", 2).alias("cost"), "estimated", F.col("last_remaining").cast("long").alias("last_remaining"))


@query
def due_scans(spark, d):
    return state.due(table(spark, d, "events").select("user_id", "event_id", "ts"), 6).select("user_id", "event_id")


@query
def rate_limited(spark, d):
    return state.rate_limited(table(spark, d, "events").select("user_id", "event_id", "ts"), 6).select("user_id", "event_id")


def _inbox(spark, d):
    rows = views.gate_rows(spark, d)
    new = gates.gated(rows, 20, 20).select(F.col("id").alias("work_id"), F.lit(True).alias("unread"), (-F.col("discovery")).alias("place"))
    old = rows.where("id % 11 = 0").select(F.col("id").alias("work_id"), F.expr("id % 2 = 0").alias("unread"), F.col("id").cast("double").alias("place"))
    return state.inbox(new, old)


@query
def inbox(spark, d):
    return state.mark_read(_inbox(spark, d), [22, 33]).select("work_id", "unread")


@query
def unread_badge(spark, d):
    return state.unread_badge(_inbox(spark, d)).select(F.col("unread").cast("long").alias("unread"), "badge")


@query
def window_horizon(spark, d):
    """How far back a feed may look, and how many windows it offers, for depths and indexed spans of all sizes."""
    c = table(spark, d, "customer").select("c_custkey", F.expr("1 + c_custkey % 90").alias("depth"), F.expr("CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 120 END").alias("indexed"))
    h = feed.horizon(F.col("depth"), F.col("indexed"))
    return c.select("c_custkey", h.cast("long").alias("horizon"), feed.windows_offered(F.col("depth")).cast("long").alias("n_windows"))


# the whole chain: scores, gates, feed, inbox


def _scored_gate(spark, d):
    return gates.gated(feed.within(views.scored_rows(spark, d), views.AS_OF, 90), 30, 30)


@query
def feed_scored(spark, d):
    f = feed.page(_scored_gate(spark, d), "balanced", 0, 100)
    return f.select(F.col("id").alias("doc_id"), F.col("first_release").cast("string").alias("first_release"), "novelty", "authorship", "discovery", "override")


@query
def feed_scored_report(spark, d):
    return feed.page_report(_scored_gate(spark, d), 20, 40).select(F.col("total").cast("long").alias("total"), "has_more")


@query
def inbox_scored(spark, d):
    new = _scored_gate(spark, d).select(F.col("id").alias("work_id"), F.lit(True).alias("unread"), (-F.col("discovery")).alias("place"))
    old = views.works(spark, d).where("id % 11 = 0").select(F.col("id").alias("work_id"), F.expr("id % 2 = 0").alias("unread"), F.col("id").cast("double").alias("place"))
    return state.inbox(new, old).select("work_id", "unread")


# what is shown


@query
def evidence_lines(spark, d):
    w = views.works(spark, d)
    names = F.expr("slice(array('A. One', 'B. Two', 'C. Three', 'D. Four', 'E. Five', 'F. Six'), 1, cast(id % 7 as int))")
    near, sim = F.expr("CASE WHEN id % 5 <> 0 THEN title END"), F.expr("cast(id % 997 as double) / 1000.0D")
    top, h, cited, n = F.expr("CASE WHEN id % 3 <> 0 THEN concat('N', id % 9) END"), F.expr("id % 80"), F.expr("id * id * 37 % 5000000"), F.expr("id % 300")
    lines = text.evidence_lines(F.expr("id % 321"), near, sim, F.expr("cast(id % 101 as double) / 101.0D"), top, cited, n, F.expr("CASE id % 2 WHEN 0 THEN 'first' ELSE 'last' END"))
    marks = text.found_markers(F.expr("concat(title, CASE id % 4 WHEN 0 THEN ' improved benchmarking' ELSE '' END)"), F.lit(""))
    return w.select(F.col("id").alias("doc_id"), text.author_line(names).alias("author_line"), text.why_line(near, sim, top, h, marks).alias("why_line"), F.array_join(lines, "|").alias("evidence"))


@query
def progress_text(spark, d):
    from perigee.operators import progress

    e = table(spark, d, "events")
    lane = F.expr("CASE event_id % 3 WHEN 0 THEN concat('lane ', user_id % 4) END")
    phase = F.expr("CASE event_id % 4 WHEN 0 THEN NULL ELSE event_type END")
    status = F.expr("CASE event_id % 10 WHEN 0 THEN 'ready' ELSE 'running' END")
    fetched, total = F.expr("CASE WHEN event_id % 6 <> 5 THEN event_id * 7 END"), F.expr("CASE WHEN event_id % 2 = 0 THEN event_id * 9 END")
    return e.select("event_id", progress.describe(status, phase, lane, fetched, total).alias("text"))


@query
def progress_states(spark, d):
    """Per user: the states that are written (750 ms apart at least), whether the run has stalled, and its status
    after a restart."""
    from perigee.operators import progress

    e = table(spark, d, "events").select("user_id", "event_id", "ts", F.expr("CASE event_id % 5 WHEN 0 THEN 'ready' ELSE 'running' END").alias("status"))
    return progress.summary(e, F.lit("2030-01-01").cast("timestamp_ntz")).select("user_id", F.col("written").cast("long").alias("written"), "status", "stalled", "recovered")


@query
def rescore_population(spark, d):
    w = views.candidates(views.works(spark, d)).select("id", F.expr("CASE id % 5 WHEN 0 THEN 2 WHEN 1 THEN NULL ELSE 3 END").alias("score_version"), F.expr("concat('s', id % 3)").alias("signature"))
    new = w.where("id % 4 = 0")
    return state.to_rescore(new, w, 3, "s1").select(F.col("id").alias("doc_id"), "is_new")


@query
def code_mapping(spark, d):
    from perigee.sources.taxonomy import map_codes

    listing = table(spark, d, "part").select(F.expr("concat('g', p_partkey % 6)").alias("group_id"), F.expr("concat('c', p_partkey)").alias("code"))
    codes = table(spark, d, "supplier").select(F.expr("concat('c', s_suppkey * 2)").alias("code"), F.expr("CASE s_suppkey % 3 WHEN 0 THEN cast(s_suppkey % 40 as string) ELSE cast(1000 + s_suppkey as string) END").alias("target"))
    groups = table(spark, d, "region").select(F.expr("concat('g', r_regionkey)").alias("group_id"), F.expr("cast(10 + r_regionkey as string)").alias("field_id"))
    out = map_codes(listing, codes, groups)
    return out.select("group_id", "code", F.array_join("field_ids", ",").alias("field_ids"), F.array_join("subfield_ids", ",").alias("subfield_ids"))


# sources


@query
def sampled_scan(spark, d):
    from perigee.sources.scan import sample_scan

    return sample_scan(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", 100, 3103)


@query
def cursor_scan(spark, d):
    from perigee.sources.scan import cursor_scan as scan

    rows = table(spark, d, "events").select((F.col("event_id") % 700).alias("id"), F.col("event_id").alias("seq"))
    return scan(rows, "id", "seq", 500).select("id", "seq")


@query
def batched_lookup(spark, d):
    from perigee.sources.scan import lookup

    keys = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return lookup(table(spark, d, "customer").select("c_custkey", "c_name"), keys, "c_custkey")


@query
def pushed_filter(spark, d):
    from perigee.sources.scan import pushed

    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("date"), F.col("o_orderstatus").alias("kind"))
    return pushed(rows, "1996-01-01", "1996-12-31", ("F", "O")).select("id")


@query
def title_lookup(spark, d):
    from perigee.sources.scan import title_lookup as find

    wanted = views.works(spark, d).select(F.concat(F.lit("  "), "title", F.lit(" !")).alias("title"), F.col("id").alias("ord"))
    return find(views.works(spark, d).select("id", "title"), wanted).select("ord", "id")


@query
def fallback_sources(spark, d):
    from perigee.sources.scan import fallback

    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    fresh, stale, built_in = n.where("id < 0"), n.where("id % 2 = 0"), n
    return fallback([fresh, stale, built_in])


@query
def store_counts(spark, d):
    w = views.works(spark, d)
    return w.agg(F.count(F.lit(1)).alias("works"), F.count_if("is_baseline").alias("baseline"), F.count_if(~F.col("is_baseline")).alias("candidates"))


# streams


@query
def stream_upsert(spark, d):
    from perigee.streaming.passes import upsert_pass

    return upsert_pass(spark, f"{d}/events.parquet")


@query
def stream_gap_fill(spark, d):
    from perigee.streaming.passes import gap_fill

    return gap_fill(spark, f"{d}/events.parquet")
