"""Scope and interest filters. Queries are driver-side constants, so matches unroll into expressions."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perigee.functions.constants import CATEGORY_EVIDENCE, GLOSSARY, JOINERS, QUERY_STOP_WORDS
from perigee.functions.text import taxonomy_id
from perigee.params import QueryParams, search_text

NAMED_GROUPS = ("cs", "econ", "eess", "math", "q-bio", "q-fin", "stat")


def token_matches(query: str, token: Column) -> Column:
    """Equal; or for queries of six letters, the same first letter and an edit distance of 1 (2 from ten on)."""
    same = token == query
    if len(query) < 6:
        return same
    most = 2 if len(query) >= 10 else 1
    near = F.substring(token, 1, 1).eqNullSafe(query[0]) & (F.abs(F.length(token) - len(query)) <= most)
    return same | (near & (F.levenshtein(token, F.lit(query), most) >= 0))


def contains_phrase(tokens: Column, query: list[str]) -> Column:
    """The query's tokens, one after another, each matched fuzzily."""
    n = len(query)
    starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(0), F.size(tokens) - n)).otherwise(F.array().cast("array<int>"))

    def at(i: Column) -> Column:
        hit = token_matches(query[0], F.get(tokens, i))
        for k, q in enumerate(query[1:], 1):
            hit = hit & token_matches(q, F.get(tokens, i + k))
        return hit

    return F.exists(starts, at)


def initials_pattern(acronym: str) -> str:
    """A pattern over search text: tokens that begin with the letters in order, joiners skipped in between."""
    joiners = "|".join(JOINERS)
    rest = "".join(f" (?:(?:{joiners}) )*(?!(?:{joiners})(?: |$)){c}[a-z0-9]*" for c in acronym[1:])
    return f"(?:^| ){acronym[0]}[a-z0-9]*{rest}(?: |$)"


def proximity(tokens: Column, query: list[str]) -> Column:
    """All meaningful tokens of the query, in any order, within one window."""
    wanted = [q for q in query if q not in QUERY_STOP_WORDS] or query
    width = max(len(wanted) + 5, 8)
    # only positions of a matching token can begin a window that matters
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(tokens))), lambda i: any_of(wanted, F.get(tokens, i - 1)))

    def window(i: Column) -> Column:
        part = F.slice(tokens, i, width)
        hit = F.lit(True)
        for q in wanted:
            hit = hit & F.exists(part, partial(token_matches, q))
        return hit

    return F.when(F.size(tokens) > 0, F.exists(starts, window)).otherwise(F.lit(False))


def any_of(queries: list[str], token: Column) -> Column:
    hit = F.lit(False)
    for q in queries:
        hit = hit | token_matches(q, token)
    return hit


def with_tokens(rows: DataFrame, *columns: str) -> DataFrame:
    """Adds <column>_tokens for search texts. A generator keeps the arrays from being computed anew inside
    each lambda, as they would be if projections were merged."""
    for c in columns:
        rows = rows.select("*", F.explode(F.array(F.filter(F.split(c, " "), lambda t: t != ""))).alias(f"{c}_tokens"))
    return rows


def matches(name: str, query: str) -> Column:
    """Whether a search text (a column that with_tokens() has seen) is about a query: phrase, acronym,
    initials, derived acronym or proximity."""
    q = search_text(query).split()
    if not q:
        return F.lit(True)
    normalized, tokens = F.col(name), F.col(f"{name}_tokens")
    hit = contains_phrase(tokens, q)
    if len(q) == 1 and q[0].isalpha() and 2 <= len(q[0]) <= 6:
        if q[0] in GLOSSARY:
            for phrase in GLOSSARY[q[0]]:
                hit = hit | contains_phrase(tokens, phrase.split())
        else:
            hit = hit | F.rlike(normalized, F.lit(initials_pattern(q[0])))
    if len(q) > 1:
        known = next((a for a, ps in GLOSSARY.items() if " ".join(q) in ps), "")
        derived = "".join(t[0] for t in q if t not in JOINERS)
        for short in {known, derived if len(derived) >= 2 else ""} - {""}:
            hit = hit | F.array_contains(tokens, short)
    return hit | proximity(tokens, q)


def interest_location(queries: list[str], title: str = "title", abstract: str = "abstract", labels: str | None = None) -> Column:
    """(query, location) of the first query that matches the title, the abstract or the labels; else null.
    The names are of search texts that with_tokens() has seen."""
    out = None
    for q in queries:
        for name, col in (("title", title), ("abstract", abstract), ("topic", labels)):
            if col is None:
                continue
            test = matches(col, q) if name != "topic" else (F.col(col) != "") & matches(col, q)
            hit = F.struct(F.lit(q).alias("query"), F.lit(name).alias("location"))
            out = F.when(test, hit) if out is None else out.when(test, hit)
    return out if out is not None else F.lit(None).cast("struct<query:string,location:string>")


def category_evidence(subfield_id: Column, normalized: Column) -> Column:
    """True unless the subfield is 1702 and none of its patterns is in the search text."""
    return F.when(taxonomy_id(subfield_id) == "1702", F.rlike(normalized, F.lit("|".join(CATEGORY_EVIDENCE)))).otherwise(F.lit(True))


def in_scope(p: QueryParams, language: Column, field_id: Column, subfield_id: Column, codes: Column | None = None) -> Column:
    """Language, category and secondary classification; null rows fail."""
    ok = language.eqNullSafe("en") if p.english_only else F.lit(True)
    category = F.lit(True)
    if p.fields or p.subfields:
        category = taxonomy_id(field_id).isin(*p.fields) | taxonomy_id(subfield_id).isin(*p.subfields)
    if codes is not None and (p.codes or p.groups):
        second = F.lit(True)
        if p.codes:
            second = second & F.arrays_overlap(codes, F.array(*map(F.lit, p.codes)))
        if p.groups:
            def of_group(c: Column) -> Column:
                hit = F.lit(False)
                for g in p.groups:
                    hit = hit | (c == g) | F.startswith(c, F.lit(g + "."))
                    if g == "physics":
                        hit = hit | ~F.rlike(c, F.lit(f"^({'|'.join(NAMED_GROUPS)})\\."))
                return hit

            second = second & F.exists(codes, of_group)
        category = F.when(F.coalesce(F.size(codes), F.lit(0)) > 0, second).otherwise(category)
    return ok & F.coalesce(category, F.lit(False))


def passes(p: QueryParams, language: Column, field_id: Column, subfield_id: Column, title: str = "title", abstract: str = "abstract", labels: str | None = None, codes: Column | None = None) -> Column:
    """The composite filter; title, abstract and labels name search texts that with_tokens() has seen."""
    text = F.concat_ws(" ", title, abstract)
    ok = in_scope(p, language, field_id, subfield_id, codes) & category_evidence(subfield_id, text)
    scoped = p.fields or p.subfields or p.groups or p.codes
    if p.queries and not (scoped and not p.strict_interest):
        ok = ok & interest_location(list(p.queries), title, abstract, labels).isNotNull()
    return ok
