"""Text functions as column expressions; everything here stays in the JVM unless it says otherwise."""

from __future__ import annotations

import json
import re
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from perigee.functions.constants import CONSOLIDATION, ENTITIES, INCREMENTAL_MARKERS, JOINED_NAMES, STOPWORDS

TOKEN = "[a-z][a-z0-9-]{2,}"


def tokenize(text: Column, most: int = 700) -> Column:
    """The first `most` scoring tokens after stop words are dropped; null text has none."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    return F.slice(F.filter(found, lambda t: ~t.isin(*[w for w in STOPWORDS if len(w) > 2])), 1, most)


def ngrams(tokens: Column, size: int) -> Column:
    """All n-grams of an array of tokens, in order."""
    starts = F.when(F.size(tokens) >= size, F.sequence(F.lit(1), F.size(tokens) - F.lit(size - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, size), " "))


def title_phrases(title: Column) -> Column:
    """2-grams, then 3-grams of the first 40 tokens of a title, repeats included."""
    t = tokenize(title, 40)
    return F.concat(ngrams(t, 2), ngrams(t, 3))


def ascii_bounds(pattern: str) -> str:
    """A pattern between word bounds that only ASCII letters, digits and _ count for."""
    return f"(?<![A-Za-z0-9_])(?:{pattern})(?![A-Za-z0-9_])"


def head(title: Column, abstract: Column, chars: int) -> Column:
    return F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.substring(F.coalesce(abstract, F.lit("")), 1, chars)))


def marker_count(title: Column, abstract: Column) -> Column:
    """How many incremental markers the title or the abstract's first 800 characters hold."""
    text = head(title, abstract, 800)
    return sum((F.contains(text, F.lit(m)).cast("int") for m in INCREMENTAL_MARKERS), F.lit(0))


def found_markers(title: Column, abstract: Column) -> Column:
    """The incremental markers that marker_count counts."""
    text = head(title, abstract, 800)
    return F.filter(F.array(*[F.when(F.contains(text, F.lit(m)), F.lit(m)) for m in INCREMENTAL_MARKERS]), lambda m: m.isNotNull())


def consolidation(title: Column, abstract: Column) -> Column:
    """9 for each consolidation pattern in the title, else 4 in the head; 26 at most."""
    own, start = F.lower(F.coalesce(title, F.lit(""))), head(title, abstract, 400)
    each = [F.when(F.rlike(own, F.lit(ascii_bounds(p))), 9).when(F.rlike(start, F.lit(ascii_bounds(p))), 4).otherwise(0) for p in CONSOLIDATION]
    return F.least(F.lit(26), sum(each, F.lit(0)))


def search_text_ascii(text: Column) -> Column:
    """Search text of values that are pure ASCII; see search_text for any other."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


MARKS = "[\u0300-\u036f]"


@cache
def _folds() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """What NFKD makes of each character beyond ASCII, as far as letters and digits come of it: the characters that
    become one, what they become, and those that become more, with that."""
    single, to, more = [], [], []
    for c in map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x20000))):
        plain = re.sub("[^a-z0-9]+", " ", re.sub(MARKS, "", unicodedata.normalize("NFKD", c).lower()))
        if plain.strip():
            if len(plain) == 1:
                single.append(c)
                to.append(plain)
            else:
                more.append((c, plain))
    return "".join(single), "".join(to), tuple(more)


def _ranges(chars: list[str]) -> str:
    """A pattern class of characters, neighbours as ranges: a class is tried part by part for each character."""
    parts: list[list[int]] = []
    for n in sorted(map(ord, chars)):
        if parts and n == parts[-1][1] + 1:
            parts[-1][1] = n
        else:
            parts.append([n, n])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in parts) + "]"


@cache
def _wide() -> tuple[str, str]:
    """Patterns of the characters that become several ones: one of two ranges that hold them all and others, and the
    exact one."""
    chars = [c for c, _ in _folds()[2]]
    latin = [c for c in chars if c < "\u0100"]
    rest = [chr(n) for n in range(min(ord(c) for c in chars if c not in latin), max(map(ord, chars)) + 1)]
    return _ranges(latin + rest), _ranges(chars)


def search_text(text: Column) -> Column:
    """NFKD, lower, no combining marks, other runs as one blank; in the JVM. Characters that become several ones are
    replaced one after another, in rows that have any."""
    single, to, more = _folds()
    t = F.coalesce(text, F.lit(""))
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(x).alias("x")) for c, x in more])
    near, exact = _wide()
    some = F.rlike(t, F.lit(near)) & F.rlike(t, F.lit(exact))
    wide = F.when(some, F.aggregate(pairs, t, lambda acc, p: F.replace(acc, p["c"], p["x"]))).otherwise(t)
    folded = F.regexp_replace(F.translate(wide, single, to), MARKS, "")
    return search_text_ascii(F.when(F.rlike(t, F.lit(r"[^\x00-\x7F]")), folded).otherwise(t))


def title_key(text: Column) -> Column:
    """Lower case, runs of anything but a-z and 0-9 as one blank; accents are not folded."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def doi(value: Column) -> Column:
    bare = F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), r"^https?://(?:dx\.)?doi\.org/", "")
    return F.trim(F.regexp_replace(bare, r"^doi:\s*", ""))


def short_id(value: Column) -> Column:
    """The last path segment, without a closing slash."""
    return F.element_at(F.split(F.regexp_replace(F.coalesce(value, F.lit("")), "/$", ""), "/"), -1)


def taxonomy_id(value: Column) -> Column:
    return F.regexp_extract(F.coalesce(value, F.lit("")), r"(\d+)/?$", 1)


def arxiv_id(urls: Column) -> Column:
    """The preprint id in the first of an array of URLs that has one, without .pdf and version; null if none."""
    pattern = r"(?i)arxiv\.org/(?:abs|pdf)/([^?#]+)"
    found = F.filter(F.transform(urls, lambda u: F.regexp_extract(F.coalesce(u, F.lit("")), pattern, 1)), lambda x: x != "")
    return F.regexp_replace(F.regexp_replace(F.get(found, F.lit(0)), r"(?i)\.pdf$", ""), r"(?i)v\d+$", "")


def _let(value: Column, f) -> Column:
    """f(value) with value evaluated once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def arxiv_month(value: Column) -> Column:
    """The month of first submission that a preprint id encodes, as its first day."""
    modern, legacy = r"^\s*(\d{4})\.\d{4,5}", r"(?i)^\s*[a-z-]+(?:\.[a-z-]{2})?/(\d{4})\d{3}"
    code = F.regexp_extract(F.coalesce(value, F.lit("")), f"(?:{modern}|{legacy})", 0)

    def month(digits: Column) -> Column:
        yy, mm = F.substring(digits, 1, 2).cast("int"), F.substring(digits, 3, 2).cast("int")
        return F.when(mm.between(1, 12), F.make_date(F.when(yy < 90, 2000 + yy).otherwise(1900 + yy), mm, F.lit(1)))

    # the digits of either form: the first four of the last part that begins with four
    return _let(F.regexp_extract(code, r"(?:^\s*|/)(\d{4})", 1), lambda d: F.when(d != "", month(d)))


def first_release(published: Column, preprint_id: Column) -> Column:
    """The preprint's month if it lies before the publication's month, else the publication date."""
    return _let(arxiv_month(preprint_id), lambda m: F.when(m.isNull(), published).when(published.isNull(), m).when(m < F.trunc(published, "MM"), m).otherwise(published))


def safe_url(url: Column, fallback: Column) -> Column:
    return F.when(F.rlike(F.lower(F.coalesce(url, F.lit(""))), F.lit("^https?://[^/ ]+")), url).otherwise(fallback)


def clean_text_ascii(text: Column, repair: bool = True) -> Column:
    """The text cleaner for ASCII values without numeric entities, as expressions."""
    t = F.coalesce(text, F.lit(""))
    for _ in range(2):
        for name, char in ENTITIES.items():
            if name != "amp":
                t = F.regexp_replace(t, f"(?i)&{name};", char)
        t = F.regexp_replace(t, "(?i)&amp;", "&")
    t = F.regexp_replace(t, r"(?i)</?[a-z][^>]{0,500}>", " ")
    t = F.regexp_replace(t, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", " ")
    if repair:
        names = "|".join(JOINED_NAMES)
        t = F.regexp_replace(t, rf"\b(?!(?:{names})\b)([A-Z][a-z]{{3,}}|[a-z]{{4,}})([A-Z][a-z]{{2,}})\b", "$1 $2")
        t = F.regexp_replace(t, r"([,;:!?])(?=[A-Za-z])", "$1 ")
    return F.trim(F.regexp_replace(t, r"[ \t\n\x0B\f\r]+", " "))


_ENTITY = re.compile(r"&(#x[0-9a-f]+|#\d+|[a-z]+);", re.I)
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_JOINED = re.compile(r"(?<![A-Za-z0-9_])([A-Z][a-zÀ-öø-ÿ]{3,}|[a-zÀ-öø-ÿ]{4,})([A-Z][a-zÀ-öø-ÿ]{2,})(?![A-Za-z0-9_])")
# Fixed value: what the cleaner takes for white space.
_SPACES = re.compile("[\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+")


def _entity(m: re.Match) -> str:
    name = m[1]
    if name[0] != "#":
        return ENTITIES.get(name.lower(), m[0])
    point = int(name[2:], 16) if name[1].lower() == "x" else int(name[1:])
    return chr(point) if point <= 0x10FFFF and not 0xD800 <= point <= 0xDFFF else ""


def clean(value: str | None, repair: bool = True) -> str:
    """The text cleaner on one value."""
    t = value or ""
    for _ in range(2):
        t = _ENTITY.sub(_entity, t)
    t = unicodedata.normalize("NFKC", t)
    t = re.sub(r"</?[a-zA-Z][^>]{0,500}>", " ", t)
    t = re.sub("[\u200b-\u200d\ufeff]", "", t)
    t = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " ", t)
    if repair:
        t = _JOINED.sub(lambda m: m[0] if m[0] in JOINED_NAMES else f"{m[1]} {m[2]}", t)
        t = re.sub(f"([,;:!?])(?=[{_LETTER}])", r"\1 ", t)
    return _SPACES.sub(" ", t).strip()


@F.pandas_udf(StringType())
def clean_text(s: pd.Series) -> pd.Series:
    """The text cleaner for any value; Arrow batches, as NFKC and numeric entities have no JVM function."""
    return s.map(lambda x: clean(x))


#: Characters of an abstract that are kept.
ABSTRACT_CHARS = 12_000


@F.pandas_udf(StringType())
def clean_abstract(s: pd.Series) -> pd.Series:
    return s.map(lambda x: clean(x)[:ABSTRACT_CHARS])


def rebuild(index: dict[str, list[int]] | None) -> str:
    """abstract_from_index on one value."""
    last = {}
    for w, places in (index or {}).items():
        last |= {p: w for p in places or () if p >= 0}
    return " ".join(last[p] for p in sorted(last) if last[p] != "") if last and max(last) <= 100_000 else ""


@F.pandas_udf(StringType())
def clean_abstract_from_index(index_json: pd.Series) -> pd.Series:
    """The cleaned text of an inverted index as JSON: rebuilt and cleaned in one step, as a Python function over the
    lambdas of abstract_from_index can't always be planned."""
    return index_json.map(lambda x: clean(rebuild(json.loads(x) if x else None))[:ABSTRACT_CHARS])


@F.pandas_udf(StringType())
def clean_title(s: pd.Series) -> pd.Series:
    return s.map(lambda x: clean(x) or "Untitled")


@F.pandas_udf(StringType())
def clean_label(s: pd.Series) -> pd.Series:
    return s.map(lambda x: clean(x, repair=False))


def display_clean(works: DataFrame) -> DataFrame:
    """Stored rows as they are shown: title and abstract cleaned again, labels and names cleaned without repairs; a
    column that isn't there is left out, null labels stay null."""
    some = {"title": clean_title, "abstract": clean_abstract} | dict.fromkeys(("name", "field_name", "subfield_name", "topic_name", "domain_name", "source_name"), clean_label)
    out = works
    for name, f in some.items():
        if name in works.columns:
            done = f(F.col(name))
            out = out.withColumn(name, done if name in ("title", "abstract") else F.when(F.col(name).isNotNull(), done))
    return out


def compact(n: Column) -> Column:
    """A count in short: 950, 1.2K, 3.4M, 5B."""
    n = F.coalesce(n.cast("double"), F.lit(0.0))
    short = lambda x, unit: F.concat(F.regexp_replace(F.format_string("%.1f", x), r"\.0$", ""), F.lit(unit))
    return F.when(n >= 999_950_000, short(n / 1e9, "B")).when(n >= 999_950, short(n / 1e6, "M")).when(n >= 1000, short(n / 1e3, "K")).otherwise(F.round(n).cast("long").cast("string"))


def _percent(share: Column) -> Column:
    return F.concat(round_half_up(F.coalesce(share, F.lit(0.0)) * 100).cast("string"), F.lit("%"))


def author_line(names: Column) -> Column:
    """The first four names, then how many more there are."""
    names = F.coalesce(names, F.array().cast("array<string>"))
    more = F.when(F.size(names) > 4, F.array(F.concat(F.lit("+"), (F.size(names) - 4).cast("string")))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(names) > 0, F.array_join(F.concat(F.slice(names, 1, 4), more), ", ")).otherwise(F.lit("Unknown authors"))


def why_line(nearest_title: Column, nearest_sim: Column, top_name: Column, top_h: Column, markers: Column) -> Column:
    """Why a work is shown: distance from its nearest peer, its strongest author, incremental wording."""
    have = F.coalesce(nearest_title, F.lit("")) != ""
    # The wording.
    near = F.when(have, F.concat(_percent(F.lit(1.0) - nearest_sim), F.lit(" idea-distance from its nearest peer"))).otherwise(F.lit("No close peer found in the local reference set"))
    author = F.when(top_name.isNotNull(), F.concat(top_name, F.lit(", h-index "), F.coalesce(top_h, F.lit(0)).cast("string")))
    wording = F.when(F.size(F.coalesce(markers, F.array().cast("array<string>"))) > 0, F.concat(F.lit("incremental wording: "), F.array_join(markers, ", ")))
    return F.concat_ws(" · ", near, author, wording)


def evidence_lines(n_peers: Column, nearest_title: Column, nearest_sim: Column, confidence: Column, top_name: Column, cited: Column, works: Column, role: Column) -> Column:
    """The evidence under a work, as an array of lines."""
    have = F.coalesce(nearest_title, F.lit("")) != ""
    # The wording.
    peers = F.concat(F.lit("Compared with "), F.coalesce(n_peers, F.lit(0)).cast("string"), F.lit(" older, topic-adjacent papers."))
    near = F.when(have, F.concat(F.lit("Nearest match ("), _percent(nearest_sim), F.lit(" similar): “"), nearest_title, F.lit("”"))).otherwise(F.lit("No nearest match was available; treat the novelty score as low-confidence."))
    sure = F.concat(F.lit("Novelty confidence: "), _percent(confidence), F.lit("."))
    author = F.when(top_name.isNotNull(), F.concat(F.lit("Top authorship signal: "), top_name, F.lit(" — "), compact(cited), F.lit(" citations, "), F.coalesce(works, F.lit(0)).cast("string"), F.lit(" works, "), role, F.lit(" author.")))
    return F.array(peers, near, sure, F.coalesce(author, F.lit("No enriched author profile was available for this paper.")))


def abstract_from_index(index: Column) -> Column:
    """The text of an inverted index (word to positions): per position the last word that claims it, gaps
    dropped; empty without positions or beyond 100,000."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e, i: F.transform(F.filter(F.coalesce(e["value"], F.array().cast("array<int>")), lambda p: p >= 0), lambda p: F.struct(p.alias("p"), i.alias("ord"), e["key"].alias("w")))))
    last = lambda o: F.filter(o, lambda x, i: F.coalesce(F.get(o, i + 1)["p"] != x["p"], F.lit(True)) & (x["w"] != ""))
    text = _let(F.sort_array(pairs), lambda o: F.array_join(F.transform(last(o), lambda x: x["w"]), " "))
    top = F.array_max(F.transform(pairs, lambda x: x["p"]))
    return F.when(index.isNull() | top.isNull() | (top > 100_000), F.lit("")).otherwise(text)


def inverted_index(words: Column) -> Column:
    """Word to positions, from an array of words by position; empty words are left out. The words are sorted, and each
    run of equal ones is one entry."""
    placed = F.sort_array(F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("p"))), lambda x: x["w"] != ""))
    first = lambda o: F.filter(F.transform(o, lambda x, i: F.when(F.coalesce(F.get(o, i - 1)["w"] != x["w"], F.lit(True)), i)), lambda i: i.isNotNull())
    run = lambda o, s, b, k: F.transform(F.slice(o, b + 1, F.coalesce(F.get(s, k + 1), F.size(o)) - b), lambda x: x["p"])
    entries = lambda o: _let(first(o), lambda s: F.transform(s, lambda b, k: F.struct(F.get(o, b)["w"].alias("w"), run(o, s, b, k).alias("ps"))))
    return F.map_from_entries(_let(placed, entries))


def snippet(text: Column, query: str, normalized: Column) -> Column:
    """190 characters around the first word of the query with four letters or more."""
    from perigee.params import search_text as plain

    needle = next((t for t in plain(query).split() if len(t) >= 4), "")
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    at = F.greatest(F.lit(0), F.instr(normalized, needle) - F.lit(71)) if needle else F.lit(0)
    cut = F.trim(F.substring(flat, at + 1, F.lit(190)))
    lead, tail = F.when(at > 0, "…").otherwise(""), F.when(at + 190 < F.length(flat), "…").otherwise("")
    return F.when(flat == "", F.lit("")).otherwise(F.concat(lead, cut, tail))


def round_half_up(x: Column) -> Column:
    return F.floor(x + F.lit(0.5))


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("annotations", "pd", "re", "unicodedata")]
