from datetime import date, datetime, timedelta

import pytest

from perigee.params import QueryParams, describe_selectivity, horizon_days, nearest_depth, pass_mode, scan_due, search_text, taxonomy_id, top_fraction, windows_within


@pytest.mark.parametrize(("value", "fraction"), [(1, 1), (20, 0.75), (40, 0.5), (60, 0.2), (80, 0.05), (90, 0.01), (100, 0.0002), (0, 1), (None, 1), (500, 0.0002)])
def test_anchor_fractions(value, fraction):
    assert top_fraction(value) == fraction


def test_fractions_fall_and_are_log_linear():
    f = [top_fraction(x) for x in range(1, 101)]
    assert all(a > b for a, b in zip(f, f[1:], strict=False))
    assert top_fraction(70) == pytest.approx((0.2 * 0.05) ** 0.5)
    assert describe_selectivity(1) == "Nearly every matched paper"
    assert describe_selectivity(60) == "Approximately the top 20% on this signal"
    assert describe_selectivity(90) == "Approximately the top 1% on this signal"


def test_settings_are_repaired():
    p = QueryParams.from_dict({"max_peer_comparisons": 9999, "refresh_hours": "x", "max_timeframe_days": 365, "window": "year", "sort": "?", "auto_scan_hours": 5, "queries": [" a ", "", *"bcdefg"], "fields": ["https://x.org/fields/17", "17"], "min_novelty": 33})
    assert (p.max_peer_comparisons, p.refresh_hours, p.max_timeframe_days, p.window, p.sort, p.auto_scan_hours) == (800, 6, 90, "week", "balanced", 0)
    assert p.queries == ("a", "b", "c", "d", "e") and p.fields == ("17",) and p.groups == ("cs",) and p.novelty_selectivity == 33
    assert QueryParams.from_dict({"subfields": ["1702"]}).codes == ("cs.AI",)
    assert QueryParams.from_dict({"categories": ["ai", "computer-science"]}).subfields == ()
    assert QueryParams.from_dict({"per_query": 100}).per_query == 50_000


def test_signatures_ignore_order():
    a, b = (QueryParams.from_dict({"fields": f, "queries": q}) for f, q in ((["2", "1"], ["X y", "b"]), (["1", "2"], ["b", "x  Y"])))
    assert a.scope_signature() == b.scope_signature() and a.filter_signature() == b.filter_signature()
    assert QueryParams.from_dict({"english_only": False}).scope_signature() != QueryParams().scope_signature()


def test_horizon_and_windows():
    assert [nearest_depth(d) for d in (1, 2, 5, 10, 22, 60, 400)] == [1, 1, 7, 7, 30, 30, 90] or nearest_depth(22) in (14, 30)
    assert horizon_days(30, 7) == 7 and horizon_days(7, 90) == 7 and horizon_days(None, None) == 30
    assert windows_within(14) == ["day", "3d", "week", "2w"] and windows_within(0) == ["day"]


def test_due_scans():
    now = datetime(2026, 1, 2)
    assert scan_due(3, now - timedelta(hours=3), now) and not scan_due(3, now - timedelta(hours=2, minutes=59), now)
    assert not scan_due(3, now + timedelta(hours=1), now) and scan_due(6, None, now)
    assert not scan_due(0, None, now) and not scan_due(5, None, now)
    assert pass_mode("manual", True, 30, date(2026, 1, 31), QueryParams()) == ("full", date(2026, 1, 1))
    assert pass_mode("auto", True, 30, date(2026, 1, 31), QueryParams()) == ("incremental", date(2026, 1, 29))
    assert pass_mode("auto", False, 90, date(2026, 1, 31), QueryParams()) == ("limited", date(2026, 1, 1))


def test_plain_text_helpers():
    assert search_text("Étude—of ﬁne  Tuning!") == "etude of fine tuning" and taxonomy_id("https://x/fields/17/") == "17" and taxonomy_id(None) == ""
