"""DuckDB SQL that says what each query must return."""

from __future__ import annotations

from perigee.functions.constants import CATEGORY_EVIDENCE, CONSOLIDATION, GLOSSARY, INCREMENTAL_MARKERS, ORGANISATIONS, PEOPLE, QUERY_STOP_WORDS, STOPWORDS
from perigee.operators.filters import initials_pattern
from perigee.params import search_text, top_fraction

STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


def toks(expr: str, most: int) -> str:
    return f"list_filter(regexp_extract_all(lower({expr}), '[a-z][a-z0-9-]{{2,}}'), lambda t: t NOT IN ({STOP}))[1:{most}]"


def norm(expr: str) -> str:
    """Search text: accents stripped."""
    return plain(f"strip_accents({expr})")


def plain(expr: str) -> str:
    return f"trim(regexp_replace(lower({expr}), '[^a-z0-9]+', ' ', 'g'))"


def split_sql(text: str) -> str:
    return f"list_filter(string_split({text}, ' '), lambda x: x <> '')"


#: Relations that queries share, in order of dependence.
CTES = {
    "works": """
  SELECT doc_id AS id, substr(text, 1, 80) AS title, substr(text, 1, 12000) AS abstract, lang AS language, source AS subfield, lang AS domain,
         (doc_id // 20) % 4 <> 0 AS is_baseline,
         CASE WHEN (doc_id // 20) % 4 <> 0 THEN DATE '2022-01-01' + CAST(doc_id * 7919 % 900 AS INTEGER) ELSE DATE '2024-01-01' + CAST(doc_id * 7919 % 90 AS INTEGER) END AS date,
         ['s' || (doc_id % 5), 'l' || lang, 'n' || (n_chars % 7)] AS fields,
         CASE doc_id % 3 WHEN 0 THEN lpad(CAST(20 + doc_id % 5 AS VARCHAR), 2, '0') || lpad(CAST(1 + doc_id % 14 AS VARCHAR), 2, '0') || '.' || lpad(CAST(doc_id % 100000 AS VARCHAR), 5, '0')
                         WHEN 1 THEN 'hep-th/99' || lpad(CAST(1 + doc_id % 12 AS VARCHAR), 2, '0') || lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0') || 'v2' END AS preprint_id
  FROM documents""",
    "months": """
  SELECT id, preprint_id, date,
         CASE WHEN id % 3 = 0 AND 1 + id % 14 <= 12 THEN make_date(CAST(2020 + id % 5 AS INTEGER), CAST(1 + id % 14 AS INTEGER), 1)
              WHEN id % 3 = 1 THEN make_date(1999, CAST(1 + id % 12 AS INTEGER), 1) END AS month
  FROM works""",
    "released": "SELECT id, CASE WHEN id % 6 = 0 AND month < date_trunc('month', date) THEN month ELSE date END AS first_release FROM months",
    "refs": "SELECT * FROM works WHERE is_baseline",
    "cands0": "SELECT * FROM works WHERE NOT is_baseline",
    "ladder": """
  SELECT c.id, CASE WHEN n_sub >= 20 THEN 'subfield' WHEN n_dom >= 20 THEN 'domain' ELSE 'all' END AS rung,
         CASE WHEN n_sub >= 20 THEN 'subfield:' || c.subfield WHEN n_dom >= 20 THEN 'domain:' || c.domain ELSE 'all' END AS group_key,
         CASE WHEN n_sub >= 20 THEN n_sub WHEN n_dom >= 20 THEN n_dom ELSE (SELECT count(*) FROM refs) END AS n_group
  FROM cands0 c LEFT JOIN (SELECT subfield, count(*) AS n_sub FROM refs GROUP BY 1) s USING (subfield)
  LEFT JOIN (SELECT domain, count(*) AS n_dom FROM refs GROUP BY 1) m USING (domain)""",
    "cands": "SELECT c.*, l.group_key FROM cands0 c JOIN ladder l USING (id)",
    "pairs": """
  SELECT * FROM (
    SELECT c.id AS cand_id, r.id AS ref_id, c.group_key, row_number() OVER (PARTITION BY c.id ORDER BY r.id) AS ord
    FROM cands c JOIN refs r ON (c.group_key = 'subfield:' || r.subfield OR c.group_key = 'domain:' || r.domain OR c.group_key = 'all') AND r.date < c.date AND r.id <> c.id
  ) WHERE ord <= 320""",
    "counts": "SELECT c.id AS cand_id, count(p.ref_id) AS n_peers, min(p.ref_id) AS min_ref, max(p.ref_id) AS max_ref FROM cands c LEFT JOIN pairs p ON p.cand_id = c.id GROUP BY 1",
    "tf": f"SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({toks("title || ' ' || abstract", 700)}) AS term FROM works) GROUP BY ALL",
    "n_docs": "SELECT greatest(1, count(*)) AS n FROM works WHERE title <> '' OR abstract <> ''",
    "idf": "SELECT term, count(*) AS df, ln(((SELECT n FROM n_docs) + 1) / (count(*) + 1)) + 1 AS idf FROM tf GROUP BY term",
    "vec": "SELECT id, term, (1 + ln(tf)) * idf AS w FROM tf JOIN idf USING (term)",
    "norms": "SELECT id, sqrt(sum(w * w)) AS norm FROM vec GROUP BY id",
    "sims": """
  SELECT p.cand_id, p.ref_id, p.ord, least(1, greatest(0, sum(a.w * b.w) / (any_value(na.norm) * any_value(nb.norm)))) AS sim
  FROM pairs p JOIN vec a ON a.id = p.cand_id JOIN vec b ON b.id = p.ref_id AND b.term = a.term
  JOIN norms na ON na.id = p.cand_id JOIN norms nb ON nb.id = p.ref_id
  GROUP BY 1, 2, 3""",
    "crowd": """
  SELECT c.cand_id, c.n_peers, t.nearest_id, coalesce(t.nearest_sim, 0) AS nearest_sim,
         CASE WHEN c.n_peers > 0 THEN 0.65::DOUBLE * coalesce(t.nearest_sim, 0) + 0.35::DOUBLE * coalesce(t.total, 0) / least(5, c.n_peers) ELSE 0 END AS crowding
  FROM counts c LEFT JOIN (
    SELECT cand_id, max(sim) AS nearest_sim, sum(sim) AS total, min(ref_id) FILTER (place = 1) AS nearest_id
    FROM (SELECT *, row_number() OVER (PARTITION BY cand_id ORDER BY sim DESC, ord) AS place FROM sims WHERE sim > 0) WHERE place <= 5 GROUP BY cand_id
  ) t USING (cand_id)""",
    "dist": f"""
  SELECT w.id, coalesce(d, 0) AS distinctiveness FROM works w LEFT JOIN (
    SELECT t.id, avg(coalesce(idf.idf, 0)) AS d FROM (SELECT id, unnest(list_distinct({toks("title || ' ' || abstract", 400)})) AS term FROM works) t LEFT JOIN idf USING (term) GROUP BY t.id
  ) x USING (id)""",
    "measured": "SELECT crowd.*, c.group_key, d.distinctiveness FROM crowd JOIN cands c ON c.id = crowd.cand_id JOIN dist d ON d.id = crowd.cand_id",
    "listed": "SELECT p.group_key, p.ref_id AS id, p.ord, count(*) OVER (PARTITION BY p.group_key) AS n_list FROM pairs p JOIN (SELECT group_key, min(id) AS cand_id FROM cands GROUP BY 1) f ON f.group_key = p.group_key AND f.cand_id = p.cand_id",
    "picked": "SELECT * FROM listed WHERE (ord - 1) % greatest(1, n_list // 90) = 0 AND (ord - 1) // greatest(1, n_list // 90) < 90",
    "sample_sims": """
  SELECT s.group_key, s.id, o.id AS other, o.ord, coalesce(x.dot / (na.norm * nb.norm), 0) AS sim
  FROM picked s JOIN listed o ON o.group_key = s.group_key AND o.id <> s.id
  LEFT JOIN (SELECT s.group_key, s.id, o.id AS other, sum(a.w * b.w) AS dot FROM picked s JOIN listed o ON o.group_key = s.group_key AND o.id <> s.id JOIN vec a ON a.id = s.id JOIN vec b ON b.id = o.id AND b.term = a.term GROUP BY ALL) x
    ON x.group_key = s.group_key AND x.id = s.id AND x.other = o.id
  LEFT JOIN norms na ON na.id = s.id LEFT JOIN norms nb ON nb.id = o.id""",
    "stats": """
  SELECT s.group_key, s.id, coalesce(c.crowding, 0) AS crowding, d.distinctiveness
  FROM picked s JOIN dist d ON d.id = s.id LEFT JOIN (
    SELECT group_key, id, 0.65::DOUBLE * max(sim) + 0.35::DOUBLE * avg(sim) AS crowding
    FROM (SELECT *, row_number() OVER (PARTITION BY group_key, id ORDER BY sim DESC, ord) AS place FROM sample_sims) WHERE place <= 5 GROUP BY 1, 2
  ) c ON c.group_key = s.group_key AND c.id = s.id""",
    "fields_ranked": """
  SELECT group_key, round(crowding, 9) AS crowding, round(distinctiveness, 9) AS distinctiveness FROM (SELECT group_key, crowding, distinctiveness FROM stats UNION ALL SELECT group_key, crowding, distinctiveness FROM measured)
  WHERE group_key IN (SELECT group_key FROM stats GROUP BY 1 HAVING count(*) >= 4)""",
    "standings": """
  SELECT m.cand_id, c.s AS crowd_standing, d.s AS distinct_standing
  FROM measured m
  LEFT JOIN (SELECT DISTINCT group_key, crowding, 0.9::DOUBLE * (rank() OVER (PARTITION BY group_key ORDER BY crowding DESC) - 1) / count(*) OVER (PARTITION BY group_key) AS s FROM fields_ranked) c
    ON c.group_key = m.group_key AND c.crowding = round(m.crowding, 9)
  LEFT JOIN (SELECT DISTINCT group_key, distinctiveness, 0.9::DOUBLE * (rank() OVER (PARTITION BY group_key ORDER BY distinctiveness) - 1) / count(*) OVER (PARTITION BY group_key) AS s FROM fields_ranked) d
    ON d.group_key = m.group_key AND d.distinctiveness = round(m.distinctiveness, 9)""",
    "phrases": f"""
  SELECT id, unnest(list_concat(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]), list_transform(range(1, greatest(1, len(t) - 1)), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]))) AS phrase
  FROM (SELECT id, {toks("title", 40)} AS t FROM works)""",
    "phrase": """
  SELECT c.id AS cand_id, coalesce(least(1, greatest(0, (u - 0.35::DOUBLE) / 0.65::DOUBLE)), 0.5::DOUBLE) AS rarity
  FROM cands c LEFT JOIN (
    SELECT m.id, avg(CASE WHEN k.phrase IS NULL THEN 1.0::DOUBLE ELSE 0 END) AS u
    FROM (SELECT p.* FROM phrases p JOIN cands c USING (id)) m
    LEFT JOIN (SELECT DISTINCT p.cand_id, x.phrase FROM pairs p JOIN phrases x ON x.id = p.ref_id) k ON k.cand_id = m.id AND k.phrase = m.phrase GROUP BY 1
  ) x ON x.id = c.id""",
    "fpairs": "SELECT DISTINCT a.id, a.f || '|' || b.f AS pair FROM (SELECT id, unnest(fields) AS f FROM works) a JOIN (SELECT id, unnest(fields) AS f FROM works) b ON a.id = b.id AND a.f < b.f",
    "bridge": """
  SELECT c.id AS cand_id, coalesce(u, 0.35::DOUBLE) AS rarity
  FROM cands c LEFT JOIN (
    SELECT m.id, avg(CASE WHEN k.pair IS NULL THEN 1.0::DOUBLE ELSE 0 END) AS u
    FROM (SELECT p.* FROM fpairs p JOIN cands c USING (id)) m
    LEFT JOIN (SELECT DISTINCT p.cand_id, x.pair FROM pairs p JOIN fpairs x ON x.id = p.ref_id) k ON k.cand_id = m.id AND k.pair = m.pair GROUP BY 1
  ) x ON x.id = c.id""",
}


def marks(title: str, abstract: str) -> tuple[str, str]:
    """Markers and consolidation as SQL."""
    wide, head = f"lower({title} || ' ' || substr({abstract}, 1, 800))", f"lower({title} || ' ' || substr({abstract}, 1, 400))"
    m = " + ".join(f"CAST(contains({wide}, '{x}') AS INTEGER)" for x in INCREMENTAL_MARKERS)
    c = " + ".join(f"CASE WHEN regexp_matches(lower({title}), '\\b(?:{p})\\b') THEN 9 WHEN regexp_matches({head}, '\\b(?:{p})\\b') THEN 4 ELSE 0 END" for p in CONSOLIDATION)
    return f"({m})", f"least(26, {c})"


M, C = marks("title", "abstract")
CTES["scored"] = f"""
  SELECT m.cand_id, raw, confidence, least(100, greatest(0, 50 + (0.25::DOUBLE + 0.75::DOUBLE * confidence) * (raw - 50))) AS novelty
  FROM (
    SELECT m.cand_id,
           least(100, greatest(0, CASE WHEN s.crowd_standing IS NULL THEN fb.fallback ELSE 100 * (0.62::DOUBLE * s.crowd_standing + 0.38::DOUBLE * s.distinct_standing) END
             + 7 * (p.rarity - 0.5::DOUBLE) + 3 * (b.rarity - 0.35::DOUBLE) - t.penalty)) AS raw,
           least(1, ln(1 + m.n_peers) / ln(61)) * CASE WHEN t.n >= 50 THEN 1 WHEN t.n > 0 THEN 0.65::DOUBLE ELSE 0.35::DOUBLE END AS confidence
    FROM measured m JOIN standings s USING (cand_id) JOIN phrase p USING (cand_id) JOIN bridge b USING (cand_id) JOIN fallback fb USING (cand_id)
    JOIN (SELECT id AS cand_id, least(34, 5 * {M} + {C}) AS penalty, len({toks("abstract", 200)}) AS n FROM works) t USING (cand_id)
  ) m"""
KNOTS = ((0.0, 100.0), (0.02, 96.0), (0.08, 88.0), (0.15, 74.0), (0.25, 58.0), (0.35, 42.0), (0.5, 24.0), (0.7, 8.0), (1.0, 2.0))
CURVE = " ".join(f"WHEN nearest_sim <= {x1}::DOUBLE THEN {y0} + (nearest_sim - {x0}::DOUBLE) / {x1 - x0}::DOUBLE * ({y1 - y0})" for (x0, y0), (x1, y1) in zip(KNOTS, KNOTS[1:], strict=False))
CTES["fallback"] = f"SELECT cand_id, CASE {CURVE} ELSE 2 END AS fallback FROM crowd"
CTES["authors"] = """
  SELECT 'A' || c_custkey AS author_id, c_name AS name, c_custkey % 2 = 0 AS has_orcid, coalesce(works_count, 0) AS works_count, coalesce(cited_by, 0) AS cited_by, coalesce(recent, 0) AS recent, coalesce(h_index, 0) AS h_index
  FROM customer LEFT JOIN (
    SELECT o_custkey, count(*) AS works_count, sum(cited) AS cited_by, avg(cited) AS recent, sum(CASE WHEN cited >= place THEN 1 ELSE 0 END) AS h_index
    FROM (SELECT o_custkey, cited, row_number() OVER (PARTITION BY o_custkey ORDER BY cited DESC) AS place FROM orders JOIN (SELECT l_orderkey, sum(l_quantity) AS cited FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey) GROUP BY 1
  ) ON o_custkey = c_custkey"""
CTES["careers"] = """
  SELECT author_id, 100 * (0.45::DOUBLE * least(1, ln(1 + h_index) / ln(81)) + 0.25::DOUBLE * least(1, ln(1 + cited_by) / ln(100001)) + 0.15::DOUBLE * least(1, ln(1 + recent) / ln(31)) + 0.1::DOUBLE * least(1, ln(1 + works_count) / ln(301)) + 0.05::DOUBLE * CASE WHEN has_orcid THEN 1 ELSE 0.35::DOUBLE END) AS career
  FROM authors"""
CTES["authorships"] = """
  SELECT doc_id AS id, ord, 'A' || CASE WHEN doc_id % 5 = 0 AND ord = 3 THEN n + 1 ELSE 1 + (doc_id * (1 + 6 * ord) + 13 * ord) % n END AS author_id,
         CASE ord WHEN 1 THEN 'first' WHEN 3 THEN 'last' ELSE 'middle' END AS position, doc_id % 4 = 0 AND ord = 2 AS is_corresponding
  FROM documents, (SELECT count(*) AS n FROM customer), (SELECT unnest([1, 2, 3]) AS ord)"""
CTES["authored"] = """
  SELECT id, CASE WHEN n = 0 THEN 0 ELSE least(100, 0.82::DOUBLE * list[1] + 0.18::DOUBLE * list[n // 2 + 1]) END AS score, n / total AS confidence, n
  FROM (SELECT id, coalesce(list_reverse_sort(list(least(100, career * w)) FILTER (career IS NOT NULL)), []) AS list, count(career) AS n, count(*) AS total
        FROM (SELECT a.id, c.career, CASE WHEN is_corresponding OR position IN ('first', 'last') THEN 1 ELSE 0.86::DOUBLE END AS w FROM authorships a LEFT JOIN careers c USING (author_id)) GROUP BY id)"""
CTES["gate"] = """
  SELECT *, 0.72::DOUBLE * greatest(novelty, authorship) + 0.28::DOUBLE * least(novelty, authorship) AS discovery
  FROM (SELECT w.id, r.first_release, CAST(w.id * 7919 % 1000 AS DOUBLE) / 10 AS novelty, CAST(w.id * 104729 % 1000 AS DOUBLE) / 10 AS authorship, w.id % 97 = 0 AS override FROM works w JOIN released r USING (id) WHERE NOT is_baseline)"""
CTES["search"] = f"SELECT id, language, subfield, domain, {norm('title')} AS title, {norm('abstract')} AS abstract FROM works"
CTES["split"] = f"SELECT *, {split_sql('title')} AS title_t, {split_sql('abstract')} AS abstract_t, {split_sql("subfield || ' ' || domain")} AS labels_t FROM search"
CTES["scope"] = "SELECT *, 'https://x.org/fields/' || (id % 6) AS field_id, CASE WHEN id % 4 = 0 THEN 'https://x.org/subfields/1702' ELSE '17' || (id % 40) END AS subfield_id, CASE WHEN id % 8 = 0 THEN title || ' deep learning' ELSE title END AS topic_title FROM search"

_NEEDS: dict[str, set[str]] = {}


def _needs(sql: str) -> set[str]:
    import re

    out: set[str] = set()
    for name in CTES:
        if re.search(rf"(?:FROM|JOIN|,)\s+\(?{name}\b", sql) or re.search(rf"\b{name}\b", sql) and name in ("pairs",):
            if name not in _NEEDS:
                _NEEDS[name] = set()
                _NEEDS[name] = _needs(CTES[name])
            out |= {name} | _NEEDS[name]
    return out


def sql(final: str) -> str:
    """The query with the shared relations it needs, in an order that defines each before its use."""
    needed, order = _needs(final), []

    def add(name: str) -> None:
        if name not in order:
            for other in _needs(CTES[name]):
                add(other)
            order.append(name)

    for n in CTES:
        if n in needed:
            add(n)
    if not order:
        return final
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in order) + "\n" + final


def cutoff(values: str, fraction: float) -> str:
    """Scalar SQL: the value at rank max(1, ceil(n * fraction)), -Infinity for a fraction that keeps all."""
    if fraction >= 0.999:
        return "CAST('-Infinity' AS DOUBLE)"
    return f"(SELECT v FROM (SELECT v, row_number() OVER (ORDER BY v DESC) AS rk, count(*) OVER () AS n FROM ({values})) WHERE rk = greatest(1, CAST(ceil(n * CAST({fraction!r} AS DOUBLE)) AS BIGINT)))"


def gate_sql(rows: str, select_n: int, select_a: int) -> str:
    cn, ca = (cutoff(f"SELECT {c} AS v FROM {rows}", top_fraction(s)) for c, s in (("novelty", select_n), ("authorship", select_a)))
    return f"SELECT * FROM {rows} WHERE novelty >= {cn} AND ({select_n} <= 1 OR novelty >= {select_n}) AND ((authorship >= {ca} AND ({select_a} <= 1 OR authorship >= {select_a})) OR override)"


def fuzzy(q: str, t: str) -> str:
    if len(q) < 6:
        return f"{t} = '{q}'"
    k = 2 if len(q) >= 10 else 1
    return f"({t} = '{q}' OR (substr({t}, 1, 1) = '{q[0]}' AND abs(length({t}) - {len(q)}) <= {k} AND levenshtein({t}, '{q}') <= {k}))"


def phrase_sql(tokens: str, query: list[str]) -> str:
    test = " AND ".join(fuzzy(q, f"coalesce({tokens}[i + {k}], '')") for k, q in enumerate(query))
    return f"len(list_filter(range(1, greatest(1, len({tokens}) - {len(query)} + 2)), lambda i: {test})) > 0"


def match_sql(t: str, query: str) -> str:
    """Interest match over a column of tokens of a search text."""
    q = search_text(query).split()
    tests = [phrase_sql(t, q)]
    if len(q) == 1 and q[0].isalpha() and 2 <= len(q[0]) <= 6:
        tests += [phrase_sql(t, p.split()) for p in GLOSSARY.get(q[0], ())]
        if q[0] not in GLOSSARY:
            tests.append(initials_sql(t, q[0]))
    if len(q) > 1:
        known = next((a for a, ps in GLOSSARY.items() if " ".join(q) in ps), "")
        derived = "".join(x[0] for x in q if x not in ("of", "the", "and", "for", "a", "an", "in", "on", "to", "with"))
        tests += [f"list_contains({t}, '{s}')" for s in {known, derived if len(derived) >= 2 else ""} - {""}]
    wanted = [x for x in q if x not in QUERY_STOP_WORDS] or q
    width = max(len(wanted) + 5, 8)
    near = " AND ".join(f"len(list_filter({t}[i:i + {width - 1}], lambda x: {fuzzy(w, 'x')})) > 0" for w in wanted)
    tests.append(f"len(list_filter(range(1, len({t}) + 1), lambda i: {near})) > 0")
    return "(" + " OR ".join(tests) + ")"


def initials_sql(t: str, acronym: str) -> str:
    """Initials over tokens without joiners behind the first one: RE2 has no lookahead, so joiners other than
    the first token are taken out; a first token that is a joiner stays a possible start."""
    pattern = "(^| )" + " ".join(f"{c}[a-z0-9]*" for c in acronym) + "( |$)"
    drop = "of the and for a an in on to with".split()
    listed = ", ".join(f"'{w}'" for w in drop)
    start = f"list_filter(range(1, len({t}) + 1), lambda i: substr({t}[i], 1, 1) = '{acronym[0]}' AND regexp_matches(array_to_string(list_concat([{t}[i]], list_filter({t}[i + 1:], lambda x: x NOT IN ({listed}))), ' '), '^{pattern[6:]}'))"
    return f"len({start}) > 0"


FIRST = "SELECT id FROM works"
ORACLE: dict[str, str] = {}


def add(name: str, final: str) -> None:
    ORACLE[name] = sql(final)


T = toks("text", 1_000_000_000)
add("tokens_per_doc", f"SELECT doc_id, CAST(len({T}) AS BIGINT) AS n_tokens, CAST(len(list_distinct({T})) AS BIGINT) AS n_distinct FROM documents")
add("title_ngrams", "SELECT id AS doc_id, phrase AS gram, count(*) AS cnt FROM phrases GROUP BY ALL")
MT = "title || CASE id % 9 WHEN 0 THEN ' Improved extension of it' WHEN 1 THEN ' A systematic review' WHEN 2 THEN ' benchmarks, a case study' ELSE '' END"
MA = "CASE id % 7 WHEN 0 THEN 'We survey of revisiting fine-tuning. ' WHEN 1 THEN 'An empirical study and tutorial; ' ELSE '' END || abstract"
m2, c2 = marks("t", "a")
add("penalties", f"SELECT id AS doc_id, CAST({m2} AS BIGINT) AS markers, CAST({c2} AS BIGINT) AS consolidation, CAST(least(34, 5 * {m2} + {c2}) AS BIGINT) AS penalty FROM (SELECT id, {MT} AS t, {MA} AS a FROM works)")
add("arxiv_month", "SELECT id AS doc_id, CAST(month AS VARCHAR) AS value FROM months")
add("first_release", "SELECT id AS doc_id, strftime(first_release, '%Y-%m-%d') AS value FROM released")
add("doi_norm", "SELECT doc_id, CASE doc_id % 4 WHEN 3 THEN '' ELSE CASE doc_id % 4 WHEN 2 THEN '10.1/' ELSE '10.1/x' END || doc_id END AS value FROM documents")
add("short_id", "SELECT doc_id, CASE doc_id % 3 WHEN 2 THEN CAST(doc_id % 40 AS VARCHAR) ELSE 'W' || doc_id END AS value, CASE doc_id % 3 WHEN 2 THEN CAST(doc_id % 40 AS VARCHAR) ELSE CAST(doc_id AS VARCHAR) END AS taxonomy FROM documents")
add("arxiv_id_extract", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '2101.' || lpad(CAST(doc_id AS VARCHAR), 5, '0') WHEN 1 THEN 'hep-th/' || doc_id END AS value FROM documents")
add("abstract_from_index", "SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(text, '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> ''), ' ') AS text FROM documents WHERE len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '')) > 0")
CLEAN = "regexp_replace(html, '[^\\x00-\\x7F]', '', 'g')"
for _ in range(2):
    for name, char in (("apos", "''"), ("gt", ">"), ("lt", "<"), ("nbsp", " "), ("quot", '"'), ("amp", "&")):
        CLEAN = f"regexp_replace({CLEAN}, '&{name};', '{char}', 'gi')"
CLEAN = f"regexp_replace({CLEAN}, '</?[a-z][^>]{{0,500}}>', ' ', 'gi')"
CLEAN = f"regexp_replace({CLEAN}, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', ' ', 'g')"
add("clean_text_ascii", f"SELECT page_id, trim(regexp_replace({CLEAN}, '[ \\t\\n\\v\\f\\r]+', ' ', 'g')) AS text FROM pages")
add("safe_urls", "SELECT page_id, CASE WHEN regexp_matches(lower(coalesce(u, '')), '^https?://[^/ ]+') THEN u ELSE 'https://example.org/' || page_id END AS url FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN 'javascript:' || url WHEN 2 THEN NULL ELSE 'HTTP' || substr(url, 5) END AS u FROM pages)")
add("snippets", """
SELECT id AS doc_id, CASE WHEN flat = '' THEN '' ELSE CASE WHEN p0 > 0 THEN '…' ELSE '' END || trim(substr(flat, p0 + 1, 190)) || CASE WHEN p0 + 190 < length(flat) THEN '…' ELSE '' END END AS snippet
FROM (SELECT s.id, trim(regexp_replace(w.abstract, '[ \\t\\n\\v\\f\\r]+', ' ', 'g')) AS flat, greatest(0, instr(s.abstract, 'ther') - 71) AS p0 FROM search s JOIN works w USING (id))""")

add("idf_top_terms", "SELECT term, df, round(idf, 6) AS idf FROM idf ORDER BY df DESC, term LIMIT 200")
add("tfidf_norms", "SELECT id AS doc_id, round(norm, 6) AS norm FROM norms")
add("peer_ladder", "SELECT id AS doc_id, rung, group_key, n_group FROM ladder")
add("peer_selection", "SELECT cand_id, n_peers, min_ref, max_ref FROM counts")
add("reference_selection", "SELECT id AS doc_id, is_baseline FROM works ORDER BY is_baseline DESC, CASE WHEN is_baseline THEN NULL ELSE date END DESC, id LIMIT 6000")
add("nearest_peer", "SELECT cand_id, nearest_id, round(nearest_sim, 6) AS nearest_sim, n_peers FROM crowd")
add("crowding", "SELECT cand_id, round(crowding, 6) AS crowding FROM crowd")
add("distinctiveness", "SELECT id AS doc_id, round(distinctiveness, 6) AS distinctiveness FROM dist")
add("field_stats", "SELECT group_key, count(*) AS n_sample, round(CASE WHEN count(*) >= 4 THEN median(crowding) END, 6) AS median_crowding, round(CASE WHEN count(*) >= 4 THEN median(distinctiveness) END, 6) AS median_distinct FROM stats GROUP BY 1")
add("standing", "SELECT cand_id, round(crowd_standing, 4) AS crowd_standing, round(distinct_standing, 4) AS distinct_standing, round(0.62::DOUBLE * crowd_standing + 0.38::DOUBLE * distinct_standing, 4) AS relative FROM standings")
add("phrase_rarity", "SELECT cand_id, round(rarity, 6) AS rarity FROM phrase")
add("bridge_rarity", "SELECT cand_id, round(rarity, 6) AS rarity FROM bridge")
add("absolute_novelty", "SELECT cand_id, round(fallback, 6) AS fallback_score FROM fallback")
add("novelty_score", "SELECT cand_id, round(raw, 4) AS raw, round(confidence, 6) AS confidence, round(novelty, 4) AS novelty FROM scored")
add("career_score", "SELECT author_id, round(career, 6) AS career FROM careers")
add("authorship_score", "SELECT id AS doc_id, round(score, 6) AS score, round(confidence, 6) AS confidence, CAST(least(5, n) AS BIGINT) AS n_evidence FROM authored")
ROSTER = "SELECT author_id, name, h_index, cited_by FROM authors WHERE h_index >= 6 AND cited_by >= 1200"
SEEDED = ", ".join(f"'{search_text(x)}'" for x in PEOPLE)
NAMED = "CASE CAST(substr(author_id, 2) AS BIGINT) % 7 WHEN 0 THEN 'Jürgen SCHMIDHUBER' WHEN 1 THEN ' yann  le-cun' WHEN 2 THEN 'YANN LÉCUN' ELSE name END"
add("author_roster", f"SELECT author_id, name, CAST(h_index AS BIGINT) AS h_index, CAST(cited_by AS DOUBLE) AS cited_by FROM (SELECT author_id, {NAMED} AS name, h_index, cited_by FROM ({ROSTER})) WHERE {norm('name')} NOT IN ({SEEDED})")
ORG = ", ".join("CASE WHEN " + " OR ".join(f"contains(p, ' {a} ')" for a in al) + f" THEN '{label}' END" for label, al, _ in ORGANISATIONS)
PPL = ", ".join(f"CASE WHEN list_contains(names, '{search_text(p)}') THEN '{p}' END" for p in PEOPLE)
add("prominence_override", f"""
SELECT id AS doc_id, CAST(len(m) AS BIGINT) AS n_markers, len(m) > 0 AS override, array_to_string(m, ',') AS labels
FROM (SELECT id, list_filter([{ORG}, {PPL}, CASE WHEN hit THEN 'Roster' END], lambda x: x IS NOT NULL)[1:2] AS m
  FROM (SELECT w.id, ' ' || CASE w.id % 11 WHEN 0 THEN 'dept of vision mila quebec' WHEN 1 THEN 'fair and openai' WHEN 2 THEN 'unfair school' WHEN 3 THEN 'nvidia research lab bair deepmind' ELSE 'university of x' END || ' ' AS p,
    CASE w.id % 13 WHEN 0 THEN ['yann lecun', 'a b'] WHEN 1 THEN ['andrew ng'] ELSE ['c d'] END AS names,
    w.id IN (SELECT id FROM authorships WHERE author_id IN (SELECT author_id FROM ({ROSTER}))) AS hit FROM works w))""")
add("priority_authors", """
SELECT author_id, prio, id AS first_doc, ord FROM (
  SELECT author_id, CAST(CASE WHEN is_corresponding OR position IN ('first', 'last') THEN 0 ELSE 1 END AS BIGINT) AS prio, id, CAST(ord AS BIGINT) AS ord,
         row_number() OVER (PARTITION BY author_id ORDER BY CASE WHEN is_corresponding OR position IN ('first', 'last') THEN 0 ELSE 1 END, id, ord) AS n FROM authorships
) WHERE n = 1 ORDER BY prio, id, ord LIMIT 500""")
add("discovery_score", "SELECT s.cand_id AS doc_id, round(novelty, 4) AS novelty, round(score, 4) AS authorship, round(0.72::DOUBLE * greatest(novelty, score) + 0.28::DOUBLE * least(novelty, score), 4) AS discovery FROM scored s JOIN authored a ON a.id = s.cand_id")

add("selectivity_cutoffs", "\nUNION ALL ".join(f"SELECT CAST({s} AS BIGINT) AS selectivity, {round(top_fraction(s), 6)}::DOUBLE AS fraction, CASE WHEN {top_fraction(s)} < 0.999 THEN {cutoff('SELECT o_totalprice AS v FROM orders', top_fraction(s))} END AS cutoff" for s in (1, 10, 20, 40, 55, 60, 80, 90, 95, 100)))
add("dual_gate", f"SELECT id AS doc_id FROM ({gate_sql('gate', 40, 40)})")
IN90 = "(SELECT * FROM gate WHERE first_release >= DATE '2024-03-31' - 90)"
for sort, key in (("balanced", "discovery"), ("novelty", "novelty"), ("researcher", "authorship"), ("newest", "first_release")):
    add(f"feed_{sort}", f"SELECT id AS doc_id, strftime(first_release, '%Y-%m-%d') AS first_release, round(novelty, 6) AS novelty, round(authorship, 6) AS authorship, round(discovery, 6) AS discovery FROM ({gate_sql(IN90, 30, 30)}) ORDER BY {key} DESC, id LIMIT 100")
add("feed_page_two", f"SELECT g.id AS doc_id, hit FROM ({gate_sql(IN90, 10, 10)}) g JOIN (SELECT id, {match_sql('abstract_t', 'thing')} AS hit FROM split) h USING (id) ORDER BY hit DESC, discovery DESC, g.id LIMIT 20 OFFSET 20")
BUNDLE = []
for w, n in (("day", 1), ("3d", 3), ("week", 7), ("2w", 14), ("month", 30), ("3m", 90)):
    rows = f"(SELECT * FROM gate WHERE first_release >= DATE '2024-03-31' - {n})"
    BUNDLE.append(f"SELECT '{w}' AS \"window\", (SELECT count(*) FROM ({gate_sql(rows, 40, 40)})) AS result_count, (SELECT count(*) FROM {rows}) AS screened_count")
add("feed_bundle", "SELECT * FROM (" + " UNION ALL ".join(BUNDLE) + ") WHERE screened_count > 0")

EVIDENCE = "|".join(CATEGORY_EVIDENCE)
HAS = f"CASE WHEN regexp_extract(subfield_id, '(\\d+)/?$', 1) = '1702' THEN regexp_matches(topic_title || ' ' || abstract, '{EVIDENCE}') ELSE true END"
IN_SCOPE = "language = 'en' AND (regexp_extract(field_id, '(\\d+)/?$', 1) IN ('3') OR regexp_extract(subfield_id, '(\\d+)/?$', 1) IN ('1702'))"
add("scope_filter", f"SELECT id AS doc_id FROM scope WHERE {IN_SCOPE} AND {HAS}")
STRICT = f"SELECT id, {split_sql('topic_title')} AS title_t, {split_sql('abstract')} AS abstract_t FROM scope WHERE {IN_SCOPE} AND {HAS}"
add("scope_filter_strict", f"SELECT id AS doc_id FROM ({STRICT}) WHERE {match_sql('title_t', 'then thing')} OR {match_sql('abstract_t', 'then thing')}")
add("secondary_classification", "SELECT id AS doc_id FROM works WHERE id % 5 <> 2")
add("category_evidence", f"SELECT id AS doc_id, {HAS} AS has_evidence FROM scope")
WHENS = " ".join(f"WHEN {match_sql(c, q)} THEN '{q}/{n}'" for q in ("thertion ingthes", "rag", "stupid", "of the onther and") for n, c in (("title", "title_t"), ("abstract", "abstract_t"), ("topic", "labels_t")))
add("interest_match", f"SELECT id AS doc_id, split_part(h, '/', 1) AS query, split_part(h, '/', 2) AS location FROM (SELECT id, CASE {WHENS} END AS h FROM split)")
add("initials_match", f"SELECT conv_id, turn, {initials_sql('t', 'ota')} AS matched FROM (SELECT conv_id, turn, {split_sql(norm('text'))} AS t FROM conversations)")

RESOLVED = f"""
  SELECT w.id, length(abstract) AS n, date, r.first_release, CAST(w.id % 100 AS DOUBLE) AS novelty, CAST(w.id % 37 AS DOUBLE) AS authorship, CAST(w.id % 53 AS DOUBLE) AS discovery, w.id % 3 AS s, w.id % 2 AS u,
    CASE WHEN {norm('title')} <> '' AND w.id % 10 <> 9 THEN 'title:' || {norm('title')} || '|authors:' || language || '|b1'
         WHEN w.id % 20 = 9 THEN 'doi:10.1/' || (w.id % 50)
         WHEN w.id % 40 = 19 AND preprint_id IS NOT NULL THEN 'arxiv:' || regexp_replace(preprint_id, 'v\\d+$', '')
         ELSE 'title:' || {norm('title')} || '|id:' || w.id END AS key
  FROM works w JOIN released r USING (id)"""
add("entity_resolution", f"""
SELECT key, first(id ORDER BY n DESC, id) AS best_id, count(*) AS n_dups, CAST(min(date) AS VARCHAR) AS min_date, strftime(min(first_release), '%Y-%m-%d') AS first_release, max(novelty) AS novelty, max(authorship) AS authorship, max(discovery) AS discovery,
       first(id ORDER BY novelty DESC, id) AS score_source_id, count(DISTINCT s * 2 + u) AS n_sources, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids
FROM ({RESOLVED}) GROUP BY key""")
add("dedup_last_wins", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1")
add("dedup_first_wins", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
add("lane_union", "SELECT doc_id, CAST(CASE WHEN source = 'src2' THEN 2 WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS lane FROM documents WHERE source IN ('src1', 'src2') OR doc_id % 3 = 0")
add("new_minus_known", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
add("qualified_and_new", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
add("taxonomy_tree", "SELECT r_name AS name, coalesce(string_agg(n_name, ',' ORDER BY n_name), '') AS children FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name")
add("taxonomy_expand", "SELECT DISTINCT subfield_id FROM (SELECT CAST(n_nationkey AS VARCHAR) AS subfield_id FROM nation WHERE n_regionkey IN (1, 3) UNION ALL SELECT unnest(['0', '99']))")
add("taxonomy_mapping", "SELECT CAST(n_nationkey AS VARCHAR) AS field_id, n_name AS name FROM nation WHERE n_nationkey NOT IN (SELECT s_suppkey % 9 FROM supplier)")
add("html_taxonomy", "SELECT page_id, CAST(len(regexp_extract_all(html, '(?i)<h[1-6][ >]')) AS BIGINT) AS n_headings, CAST(len(regexp_extract_all(html, '(?i)<a [^>]*href=')) AS BIGINT) AS n_links FROM pages")
add("budget_prefix", "SELECT event_id, round(c, 6) AS running_cost FROM (SELECT event_id, sum(CASE WHEN event_id % 10 = 0 THEN 0.001::DOUBLE ELSE 0.0001::DOUBLE END) OVER (ORDER BY event_id) AS c FROM events) WHERE c <= 0.3 + 1e-9")
add("upsert", """
SELECT o_orderkey AS id, coalesce(n.price, o_totalprice) AS price FROM orders LEFT JOIN (SELECT l_orderkey, max_by(l_extendedprice, l_linenumber) AS price FROM lineitem WHERE l_quantity > 45 GROUP BY 1) n ON l_orderkey = o_orderkey
UNION ALL SELECT l_orderkey, max_by(l_extendedprice, l_linenumber) FROM lineitem WHERE l_quantity > 45 AND l_orderkey NOT IN (SELECT o_orderkey FROM orders) GROUP BY 1""")
add("retention_prune", "SELECT id AS doc_id FROM works WHERE is_baseline OR date >= DATE '2024-03-31' - 400")
add("coverage_metrics", """
SELECT CAST(a AS BIGINT) AS available, CAST(r AS BIGINT) AS records, round(CASE WHEN a > 0 THEN least(100, 100.0::DOUBLE * r / a) ELSE 100 END, 6) AS percent
FROM (SELECT count(*) FILTER (source = 'src1') + count(*) FILTER (source IN ('src1', 'src3')) AS a, count(*) FILTER (source IN ('src1', 'src3') AND doc_id % 3 <> 0) AS r FROM documents)""")
add("daily_usage", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS requests, round(sum(round(value, 2)), 2) AS cost, bool_or(event_id % 5 = 0) AS estimated, CAST(max_by(1000 - event_id % 100, event_id) FILTER (event_id % 3 = 0) AS BIGINT) AS last_remaining FROM events GROUP BY 1")
add("due_scans", "SELECT user_id, event_id FROM (SELECT user_id, event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS NULL OR ts - p >= INTERVAL 6 HOURS")
INBOX = f"""SELECT work_id, unread, age, place FROM (
  SELECT id AS work_id, true AS unread, 0 AS age, -discovery AS place FROM ({gate_sql('gate', 20, 20)}) WHERE id % 11 <> 0
  UNION ALL SELECT id, id % 2 = 0, 1, CAST(id AS DOUBLE) FROM gate WHERE id % 11 = 0
) ORDER BY age, place, work_id LIMIT 250"""
add("inbox", f"SELECT work_id, CASE WHEN work_id IN (22, 33) THEN false ELSE unread END AS unread FROM ({INBOX})")
add("unread_badge", f"SELECT count(*) FILTER (unread) AS unread, CASE WHEN count(*) FILTER (unread) > 99 THEN '99+' WHEN count(*) FILTER (unread) > 0 THEN CAST(count(*) FILTER (unread) AS VARCHAR) ELSE '' END AS badge FROM ({INBOX})")
add("window_horizon", """
SELECT c_custkey, CAST(greatest(1, least(depth, CASE WHEN indexed > 0 THEN indexed ELSE depth END)) AS BIGINT) AS horizon,
       CAST(len(list_filter([1, 3, 7, 14, 30, 90], lambda n: n <= depth)) AS BIGINT) AS n_windows
FROM (SELECT c_custkey, 1 + c_custkey % 90 AS depth, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 120 END AS indexed FROM customer)""")
CTES["real"] = """
  SELECT s.cand_id AS id, r.first_release, round(s.novelty, 6) AS novelty, round(a.score, 6) AS authorship,
         round(least(100, greatest(0, 0.72::DOUBLE * greatest(s.novelty, a.score) + 0.28::DOUBLE * least(s.novelty, a.score))), 6) AS discovery,
         s.cand_id IN (SELECT x.id FROM authorships x WHERE x.author_id IN (SELECT author_id FROM authors WHERE h_index >= 8 AND cited_by >= 1500)) AS override
  FROM scored s JOIN authored a ON a.id = s.cand_id JOIN released r ON r.id = s.cand_id"""
CTES["real90"] = "SELECT * FROM real WHERE first_release >= DATE '2024-03-31' - 90"
CTES["real_gate"] = gate_sql("real90", 30, 30)
add("feed_scored", "SELECT id AS doc_id, strftime(first_release, '%Y-%m-%d') AS first_release, novelty, authorship, discovery, override FROM real_gate ORDER BY discovery DESC, id LIMIT 100")
add("feed_scored_report", "SELECT count(*) AS total, count(*) > 60 AS has_more FROM real_gate")
add("inbox_scored", """
SELECT work_id, unread FROM (
  SELECT work_id, unread FROM (
    SELECT id AS work_id, true AS unread, 0 AS age, -discovery AS place FROM real_gate WHERE id % 11 <> 0
    UNION ALL SELECT id, id % 2 = 0, 1, CAST(id AS DOUBLE) FROM works WHERE id % 11 = 0
  ) ORDER BY age, place, work_id LIMIT 250)""")
PCT = "CAST(CAST(floor(coalesce({0}, 0) * 100 + 0.5::DOUBLE) AS BIGINT) AS VARCHAR) || '%'"
SHORT = "CASE WHEN c >= 999950 THEN regexp_replace(printf('%.1f', floor(c / 100000.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE), '\\.0$', '') || 'M' WHEN c >= 1000 THEN regexp_replace(printf('%.1f', floor(c / 100.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE), '\\.0$', '') || 'K' ELSE CAST(c AS VARCHAR) END"
FOUND = ", ".join(f"CASE WHEN contains(lower(t || ' '), '{x}') THEN '{x}' END" for x in INCREMENTAL_MARKERS)
add("evidence_lines", f"""
SELECT id AS doc_id,
       CASE WHEN id % 7 = 0 THEN 'Unknown authors' ELSE array_to_string(list_concat(names[1:4], CASE WHEN id % 7 > 4 THEN ['+' || (id % 7 - 4)] ELSE [] END), ', ') END AS author_line,
       CASE WHEN near IS NULL OR near = '' THEN 'No close peer found in the local reference set' ELSE {PCT.format('(1.0::DOUBLE - sim)')} || ' idea-distance from its nearest peer' END
         || CASE WHEN top IS NULL THEN '' ELSE ' · ' || top || ', h-index ' || (id % 80) END
         || CASE WHEN len(found) = 0 THEN '' ELSE ' · incremental wording: ' || array_to_string(found, ', ') END AS why_line,
       'Compared with ' || (id % 321) || ' older, topic-adjacent papers.|'
         || CASE WHEN near IS NULL OR near = '' THEN 'No nearest match was available; treat the novelty score as low-confidence.' ELSE 'Nearest match (' || {PCT.format('sim')} || ' similar): “' || near || '”' END
         || '|Novelty confidence: ' || {PCT.format('(CAST(id % 101 AS DOUBLE) / 101.0::DOUBLE)')} || '.|'
         || CASE WHEN top IS NULL THEN 'No enriched author profile was available for this paper.' ELSE 'Top authorship signal: ' || top || ' — ' || {SHORT} || ' citations, ' || (id % 300) || ' works, ' || CASE id % 2 WHEN 0 THEN 'first' ELSE 'last' END || ' author.' END AS evidence
FROM (SELECT id, (['A. One', 'B. Two', 'C. Three', 'D. Four', 'E. Five', 'F. Six'])[1:id % 7] AS names, CASE WHEN id % 5 <> 0 THEN title END AS near, CAST(id % 997 AS DOUBLE) / 1000.0::DOUBLE AS sim,
             CASE WHEN id % 3 <> 0 THEN 'N' || (id % 9) END AS top, id * id * 37 % 5000000 AS c, list_filter([{FOUND}], lambda x: x IS NOT NULL) AS found
      FROM (SELECT id, title, title || CASE id % 4 WHEN 0 THEN ' improved benchmarking' ELSE '' END AS t FROM works))""")
add("progress_text", """
SELECT event_id, CASE WHEN event_id % 10 = 0 THEN '' ELSE
  CASE WHEN event_id % 4 = 0 THEN 'starting' ELSE event_type END || CASE WHEN event_id % 3 = 0 THEN ' · lane ' || (user_id % 4) ELSE '' END
  || CASE WHEN event_id % 2 = 0 AND event_id > 0 THEN ' · ' || format('{:,}', f) || ' of ' || format('{:,}', event_id * 9) WHEN f <> 0 THEN ' · ' || format('{:,}', f) || ' so far' ELSE '' END END AS text
FROM (SELECT *, CASE WHEN event_id % 6 <> 5 THEN event_id * 7 ELSE 0 END AS f FROM events)""")
ORACLE["progress_states"] = """
WITH RECURSIVE e AS (SELECT user_id, event_id, ts, CASE event_id % 5 WHEN 0 THEN 'ready' ELSE 'running' END AS status, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (
  SELECT user_id, n, ts, status, 1 AS written FROM e WHERE n = 1
  UNION ALL
  SELECT e.user_id, e.n, CASE WHEN e.ts - r.ts < INTERVAL 750 MILLISECONDS AND e.status = r.status THEN r.ts ELSE e.ts END,
         CASE WHEN e.ts - r.ts < INTERVAL 750 MILLISECONDS AND e.status = r.status THEN r.status ELSE e.status END,
         r.written + CASE WHEN e.ts - r.ts < INTERVAL 750 MILLISECONDS AND e.status = r.status THEN 0 ELSE 1 END
  FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1
), last AS (SELECT user_id, arg_max(status, n) AS status, max(ts) AS ts FROM e GROUP BY 1)
SELECT l.user_id, CAST(w.written AS BIGINT) AS written, l.status, l.status = 'running' AND TIMESTAMP '2030-01-01' - l.ts > INTERVAL 120 SECONDS AS stalled, 'ready' AS recovered
FROM last l JOIN (SELECT user_id, max(written) AS written FROM r GROUP BY 1) w USING (user_id)"""
add("rescore_population", """
SELECT id AS doc_id, id % 4 = 0 AS is_new FROM works WHERE NOT is_baseline AND (id % 4 = 0 OR id % 5 IN (0, 1) OR id % 3 <> 1)""")
add("code_mapping", """
SELECT l.group_id, l.code, coalesce(array_to_string(CASE WHEN o.code IS NOT NULL THEN o.fields ELSE g.fields END, ','), '') AS field_ids, coalesce(array_to_string(o.subfields, ','), '') AS subfield_ids
FROM (SELECT 'g' || (p_partkey % 6) AS group_id, 'c' || p_partkey AS code FROM part) l
LEFT JOIN (SELECT 'c' || (s_suppkey * 2) AS code, CASE WHEN s_suppkey % 3 = 0 THEN [CAST(s_suppkey % 40 AS VARCHAR)] ELSE [] END AS fields, CASE WHEN s_suppkey % 3 <> 0 THEN [CAST(1000 + s_suppkey AS VARCHAR)] ELSE [] END AS subfields FROM supplier) o USING (code)
LEFT JOIN (SELECT 'g' || r_regionkey AS group_id, [CAST(10 + r_regionkey AS VARCHAR)] AS fields FROM region) g ON g.group_id = l.group_id""")
add("cursor_scan", "SELECT id, min(event_id) AS seq FROM (SELECT event_id % 700 AS id, event_id FROM events) GROUP BY 1 ORDER BY 2 LIMIT 500")
add("batched_lookup", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
add("pushed_filter", "SELECT o_orderkey AS id FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' AND o_orderstatus IN ('F', 'O')")
add("title_lookup", f"SELECT w.id AS ord, k.id FROM works w JOIN (SELECT {plain('title')} AS k, min(id) AS id FROM works WHERE {plain('title')} <> '' GROUP BY 1) k ON k.k = {plain('w.title')}")
add("fallback_sources", "SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_nationkey % 2 = 0")
add("store_counts", "SELECT count(*) AS works, count(*) FILTER (is_baseline) AS baseline, count(*) FILTER (NOT is_baseline) AS candidates FROM works")
add("stream_upsert", "SELECT user_id, max(event_id) AS event_id, max_by(value, event_id) AS value FROM events GROUP BY 1")
add("stream_gap_fill", "SELECT event_id, value FROM events WHERE event_type = 'purchase'")
ORACLE["rate_limited"] = """
WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (
  SELECT user_id, event_id, ts, n FROM e WHERE n = 1
  UNION ALL
  SELECT e.user_id, e.event_id, e.ts, e.n FROM r JOIN e ON e.user_id = r.user_id
  WHERE e.n = (SELECT min(x.n) FROM e x WHERE x.user_id = r.user_id AND x.n > r.n AND x.ts - r.ts >= INTERVAL 6 HOURS)
)
SELECT user_id, event_id FROM r"""
