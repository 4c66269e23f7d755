"""Membership against the rule itself: every firm, every quarter, every setting of the three switches."""

import itertools

import pytest
from pyspark.sql import functions as F

from quarterglass.operators import membership as ME
from quarterglass.settings import DEFAULTS as S
from quarterglass.settings import MembershipRule
from tests.conftest import RANGES, STAYS, quarter, ranges_frame

QUARTERS = range(176, 210)
RULES = [MembershipRule(start_inclusive=a, end_inclusive=b, open_end_is_member=c) for a, b, c in itertools.product((True, False), repeat=3)]


def stays_at(name: str, q: int, rule: MembershipRule = S.membership) -> list[int]:
    """Places in ``RANGES`` of the stays that hold the quarter."""
    flat = [(owner, first, n) for owner, stays in STAYS.items() for first, n in stays]
    found = []
    for i, (owner, first, n) in enumerate(flat):
        begun = q >= first if rule.start_inclusive else q > first
        lasts = rule.open_end_is_member if n is None else q <= first + n if rule.end_inclusive else q < first + n
        if owner == name and begun and lasts:
            found.append(i)
    return found


def pairs(spark, names=(*STAYS, "BAY")):
    return spark.createDataFrame([(n, q, quarter(q)) for n in names for q in QUARTERS], "symbol string, q_ord int, period_key string")


@pytest.mark.parametrize("rule", RULES)
def test_every_quarter_under_every_rule(spark, rule):
    # where one stay ends as the next begins, an inclusive end makes them meet: keep the first of such neighbours only
    names = [n for n in STAYS if not rule.end_inclusive or n not in ("OAK", "ASH")]
    ranges = ranges_frame(spark).filter(F.col("ticker").isin(names))
    rows = ME.membership(pairs(spark, (*names, "BAY")), ranges, rule).collect()
    assert len(rows) == (len(names) + 1) * len(QUARTERS)
    for r in rows:
        found = stays_at(r.symbol, r.q_ord, rule)
        assert r.in_index == bool(found) and r.relevance_range_id == (found[0] if found else None), (r.symbol, r.q_ord)
        assert r.ticker_in_relevance_file == (r.symbol != "BAY")


def test_unsupported_comparison_is_rejected():
    with pytest.raises(ValueError):
        MembershipRule(compare_to="formation_date")


@pytest.mark.parametrize(("gap", "length"), list(itertools.product((-3, -1, 0, 2), (1, 4, None))))
def test_only_overlapping_stays_raise(spark, gap, length):
    """A second stay that begins ``gap`` quarters after the first has ended."""
    first, n = 185, 6
    again = first + n + gap
    ranges = ranges_frame(spark, [("IVY", quarter(first), quarter(first + n)), ("IVY", quarter(again), "" if length is None else quarter(again + length))])
    if gap < 0:
        with pytest.raises(ValueError, match="Overlapping"):
            ME.validate_ranges(ranges, S.membership)
    else:
        ME.validate_ranges(ranges, S.membership)


def test_an_open_stay_overlaps_whatever_follows(spark):
    with pytest.raises(ValueError, match="Overlapping"):
        ME.validate_ranges(ranges_frame(spark, [("IVY", quarter(150), ""), ("IVY", quarter(205), quarter(206))]), S.membership)


def test_empty_and_backward_ranges(spark, ranges):
    ME.validate_ranges(ranges, S.membership)
    empty = {name for name, stays in STAYS.items() if any(n == 0 for _, n in stays)}
    assert {r.ticker for r in ME.empty_ranges(ranges, S.membership).collect()} == empty == {"YEW"}
    with pytest.raises(ValueError, match="end_quarter < start_quarter"):
        ME.validate_ranges(ranges_frame(spark, [("IVY", quarter(190), quarter(189))]), S.membership)


@pytest.mark.parametrize(("low", "high"), [(176, 209), (189, 196), (203, 203)])
def test_expansion_holds_each_member_quarter_once(ranges, low, high):
    rows = [(r.ticker, r.q_ord, r.period_key) for r in ME.expand_members(ranges, S.membership, low, high).collect()]
    assert sorted(rows) == sorted((name, q, quarter(q)) for name in STAYS for q in range(low, high + 1) if stays_at(name, q))


def test_quarters_in_several_ranges_are_reported(spark):
    spans = [(180, 9), (186, 5), (188, 12)]
    ranges = ranges_frame(spark, [("IVY", quarter(a), quarter(a + n)) for a, n in spans])
    found = ME.membership_conflicts(ME.membership(pairs(spark, ["IVY"]), ranges, S.membership)).collect()
    hits = {q: sum(a <= q < a + n for a, n in spans) for q in QUARTERS}
    assert sorted((r.q_ord, r.n_ranges) for r in found) == [(q, k) for q, k in hits.items() if k > 1]


def test_ranges_are_numbered_in_order(ranges):
    assert [r.ticker for r in ranges.orderBy("range_id").collect()] == [r[0] for r in RANGES]
