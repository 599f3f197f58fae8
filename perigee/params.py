"""Query parameters: defaults, bounds, selectivity, windows and signatures. Plain Python, driver side."""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass, field, fields, replace
from datetime import date, datetime, timedelta

# Windows in days, index depths, scan intervals in hours, sort modes.
WINDOWS = {"day": 1, "3d": 3, "week": 7, "2w": 14, "month": 30, "3m": 90}
DEPTHS = (1, 3, 7, 14, 30, 90)
SCAN_HOURS = (0, 3, 6, 24, 72)
SORTS = ("balanced", "novelty", "researcher", "newest")

# Selectivity anchors (value, top fraction).
ANCHORS = ((1, 1.0), (20, 0.75), (40, 0.5), (60, 0.2), (80, 0.05), (90, 0.01), (100, 0.0002))

# Bounds of numeric parameters.
BOUNDS = {
    "novelty_selectivity": (1, 100),
    "authorship_selectivity": (1, 100),
    "refresh_hours": (1, 24),
    "broad_sample": (100, 2000),
    "per_query": (100, 100_000),
    "baseline_per_subfield": (100, 500),
    "history_years": (1, 10),
    "max_authors": (1000, 100_000),
    "max_discovery_works": (5000, 1_000_000),
    "max_reference_works": (1000, 20_000),
    "max_peer_comparisons": (50, 800),
    "incremental_lookback_days": (1, 7),
    "max_timeframe_days": (1, 90),
    "full_rebuild_days": (3, 30),
    "full_scan_budget": (0.05, 0.95),
    "incremental_scan_budget": (0.005, 0.1),
    "gap_fill_budget": (0.01, 0.4),
}

# What older category names select (fields, subfields).
CATEGORIES = {
    "ai": ((), ("1702",)),
    "computer-science": (("17",), ()),
    "math-stats": (("18", "26"), ()),
    "physics": (("31",), ()),
    "chem-materials": (("15", "16", "25"), ()),
    "biology": (("11", "13", "24", "34"), ()),
    "medicine-health": (("27", "29", "30", "35", "36"), ()),
    "psych-neuro": (("28", "32"), ()),
    "earth-environment": (("19", "23"), ()),
    "engineering-energy": (("21", "22"), ()),
    "social-sciences": (("33",), ()),
    "economics-business": (("14", "20"), ()),
    "arts-humanities": (("12",), ()),
}


def taxonomy_id(value: object) -> str:
    """The digits at the end of an id or URL."""
    m = re.search(r"(\d+)/?$", str(value or ""))
    return m[1] if m else ""


def _ids(values: object) -> tuple[str, ...]:
    return tuple(dict.fromkeys(i for v in values if (i := taxonomy_id(v)))) if isinstance(values, (list, tuple)) else ()


def category_selection(names: object) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Fields and subfields of older category names; a subfield its whole field covers is left out."""
    known = [CATEGORIES[n] for n in names if n in CATEGORIES] if isinstance(names, (list, tuple)) else []
    own_fields = _ids([f for fs, _ in known for f in fs])
    return own_fields, tuple(s for s in _ids([s for _, ss in known for s in ss]) if not (s == "1702" and "17" in own_fields))


def _number(value: object) -> float | None:
    if isinstance(value, bool):
        return float(value)
    try:
        x = float(value)
    except (TypeError, ValueError):
        return None
    return x if math.isfinite(x) else None


@dataclass(frozen=True)
class QueryParams:
    """The typed parameters of a feed or a pass; from_dict() clamps and repairs what comes from outside."""

    queries: tuple[str, ...] = ()
    fields: tuple[str, ...] = ()
    subfields: tuple[str, ...] = ()
    groups: tuple[str, ...] = ()
    codes: tuple[str, ...] = ()
    english_only: bool = True
    strict_interest: bool = False
    notifications: bool = False
    window: str = "week"
    sort: str = "balanced"
    auto_scan_hours: int = 0
    novelty_selectivity: float = 70
    authorship_selectivity: float = 70
    refresh_hours: float = 6
    broad_sample: float = 1000
    per_query: float = 50_000
    baseline_per_subfield: float = 320
    history_years: float = 3
    max_authors: float = 50_000
    max_discovery_works: float = 1_000_000
    max_reference_works: float = 6_000
    max_peer_comparisons: float = 320
    incremental_lookback_days: float = 2
    max_timeframe_days: float = 30
    full_rebuild_days: float = 7
    full_scan_budget: float = 0.95
    incremental_scan_budget: float = 0.02
    gap_fill_budget: float = 0.1
    extra: dict = field(default_factory=dict, compare=False, repr=False)

    MAX_QUERIES = 5

    @classmethod
    def from_dict(cls, given: dict | None = None) -> QueryParams:
        given = dict(given or {})
        base = cls()
        for old, new in (("min_novelty", "novelty_selectivity"), ("min_researcher", "authorship_selectivity")):
            if given.get(new) is None and given.get(old) is not None:
                given[new] = given[old]
        out: dict = {}
        for name, (low, high) in BOUNDS.items():
            x = _number(given.get(name, getattr(base, name)))
            out[name] = getattr(base, name) if x is None else min(high, max(low, x))
        out["max_timeframe_days"] = nearest_depth(out["max_timeframe_days"])
        for name in ("per_query", "max_discovery_works", "full_scan_budget"):
            out[name] = max(out[name], getattr(base, name))
        queries = given.get("queries")
        out["queries"] = tuple(q for q in (str(q).strip() for q in queries) if q)[: cls.MAX_QUERIES] if isinstance(queries, (list, tuple)) else ()
        old_fields, old_subfields = category_selection(given.get("categories"))
        out["fields"] = _ids(given.get("fields")) or old_fields
        out["subfields"] = _ids(given.get("subfields")) or old_subfields
        texts = lambda k: tuple(dict.fromkeys(str(v) for v in given[k] if v)) if isinstance(given.get(k), (list, tuple)) else ()
        out["groups"], out["codes"] = texts("groups"), texts("codes")
        if not out["groups"] and not out["codes"]:
            if "17" in out["fields"]:
                out["groups"] = ("cs",)
            elif "1702" in out["subfields"]:
                out["codes"] = ("cs.AI",)
        out["window"] = given.get("window") if given.get("window") in WINDOWS else base.window
        out["sort"] = given.get("sort") if given.get("sort") in SORTS else base.sort
        hours = _number(given.get("auto_scan_hours"))
        out["auto_scan_hours"] = int(hours) if hours in SCAN_HOURS else 0
        out["english_only"] = given.get("english_only") is not False
        out["strict_interest"] = bool(given.get("strict_interest"))
        out["notifications"] = bool(given.get("notifications"))
        known = {f.name for f in fields(cls)}
        return replace(base, **out, extra={k: v for k, v in given.items() if k not in known})

    def scope_signature(self) -> str:
        """What a pass covers: a cache key."""
        return json.dumps({"english_only": self.english_only, "fields": sorted(self.fields), "subfields": sorted(self.subfields)}, sort_keys=True)

    def filter_signature(self) -> str:
        """What a feed shows: a cache key."""
        scope = json.loads(self.scope_signature())
        return json.dumps({"scope": scope, "groups": sorted(self.groups), "codes": sorted(self.codes), "queries": sorted(filter(None, map(search_text, self.queries)))}, sort_keys=True)


def search_text(value: object) -> str:
    """NFKD, lower case, no combining marks, runs of other characters than a-z and 0-9 as one blank."""
    import unicodedata

    text = unicodedata.normalize("NFKD", str(value or "")).lower()
    return re.sub(r"[^a-z0-9]+", " ", re.sub("[\u0300-\u036f]", "", text)).strip()


def nearest_depth(days: float) -> int:
    """The index depth nearest to a number of days; 30, then the smaller one, wins a tie."""
    return min((30, *DEPTHS), key=lambda d: abs(d - days))


def top_fraction(selectivity: object) -> float:
    """The share of rows a selectivity keeps: anchors, log-linear between them."""
    x = min(100.0, max(1.0, _number(selectivity) or 1.0))
    for (lo, f), (hi, g) in zip(ANCHORS, ANCHORS[1:], strict=False):
        if x == lo:
            return f
        if lo < x < hi:
            share = (x - lo) / (hi - lo)
            return 10 ** (math.log10(f) + share * (math.log10(g) - math.log10(f)))
    return ANCHORS[-1][1]


def describe_selectivity(selectivity: object) -> str:
    f = top_fraction(selectivity)
    if f >= 0.999:
        return "Nearly every matched paper"
    p = f * 100
    return f"Approximately the top {math.floor(p + 0.5) if p >= 10 else float(f'{p:.2g}'):g}% on this signal"


def horizon_days(depth: object, indexed: object = None) -> float:
    """How far back a feed may look: the depth, and no further than what is indexed."""
    top = x if (x := _number(depth)) and x > 0 else 30
    reached = x if (x := _number(indexed)) and x > 0 else top
    return max(1, min(top, reached))


def windows_within(days: object) -> list[str]:
    limit = max(1, _number(days) or 1)
    return [w for w, n in WINDOWS.items() if n <= limit]


def scan_due(hours: object, last: datetime | None, now: datetime) -> bool:
    """Whether an automatic pass is due: never at 0 hours, at once without a last one, inclusive bound."""
    h = _number(hours)
    if h not in SCAN_HOURS or not h:
        return False
    return last is None or now - last >= timedelta(hours=h)


def pass_mode(reason: str, full_done: bool, depth: int, as_of: date, p: QueryParams) -> tuple[str, date]:
    """The mode of a discovery pass and the first day it reads: full, incremental or limited."""
    if reason in ("manual", "rebuild"):
        return "full", as_of - timedelta(days=depth)
    if full_done:
        return "incremental", as_of - timedelta(days=int(p.incremental_lookback_days))
    return "limited", as_of - timedelta(days=min(30, depth))
