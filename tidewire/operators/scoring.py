"""Scores of signals, stories and developments as column expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def surge_z(observed, rate) -> Column:
    """How far today's count lies above the daily rate, in deviations of a Poisson count."""
    return (_c(observed) - _c(rate)) / F.sqrt(_c(rate) + 1)


def surge(observed, rate, baseline_days, days_since_epoch, k: float = 3.0) -> Column:
    """struct(z, severity, confidence) of a surge, or null below k or without enough history."""
    z = surge_z(observed, rate)
    severity = F.when(z >= 2 * k, "critical").when(z >= 1.5 * k, "warning").otherwise("advisory")
    fires = (_c(baseline_days) >= 3) & (_c(days_since_epoch) >= 4) & (z >= k)
    return F.when(fires, F.struct(z.alias("z"), severity.alias("severity"), F.least(F.lit(1.0), z / (2 * k)).alias("confidence")))


def counted(n, least: int, critical: int) -> Column:
    """struct(severity, confidence) of a signal that rests on a count: first-seen novelty (2, 8), new links (2, 6)."""
    n = _c(n)
    fires = F.struct(F.when(n >= critical, "critical").otherwise("warning").alias("severity"), F.least(F.lit(1.0), n / float(critical)).alias("confidence"))
    return F.when(n >= least, fires)


def category_spread(count, usual, active_days) -> Column:
    """struct(excess, severity, confidence) where an entity meets at least two categories more than on its usual day."""
    excess = _c(count) - _c(usual)
    severity = F.when(excess >= 4, "critical").when(excess >= 3, "warning").otherwise("advisory")
    fires = (_c(active_days) >= 3) & (_c(count) >= 4) & (excess >= 2)
    return F.when(fires, F.struct(excess.alias("excess"), severity.alias("severity"), F.least(F.lit(1.0), excess / 4.0).alias("confidence")))


def sentiment_shift(mean_now, mentions_now, mean_before, mentions_before, baseline_days, drop: float = 0.3) -> Column:
    """struct(delta, severity, confidence) where the mean sentiment fell by ``drop`` or more."""
    delta = _c(mean_now) - _c(mean_before)
    fires = (_c(baseline_days) >= 3) & (_c(mentions_before) >= 10) & (_c(mentions_now) >= 5) & (delta <= -drop)
    severity = F.when((delta <= -0.5) & (_c(mentions_now) >= 10), "critical").otherwise("warning")
    return F.when(fires, F.struct(delta.alias("delta"), severity.alias("severity"), F.least(F.lit(1.0), 2 * F.abs(delta)).alias("confidence")))


def story(size, age_hours) -> Column:
    """Interest of a story: grows with the logarithm of its size and fades over a day."""
    return F.log1p(_c(size)) * F.exp(-_c(age_hours) / 24.0)


def lift(observed, rate) -> Column:
    """Today's count over the daily rate, which counts as half a mention at least."""
    return _c(observed) / F.greatest(_c(rate), F.lit(0.5))


#: Strength of a stated relation by kind, and of the other kinds of evidence.
STRONG_RELATIONS = ("sanction", "supply", "acquisition", "investment", "regulation", "legal_action")
WEAK_RELATIONS = ("statement_about", "other")
KIND_STRENGTH = {"N": 0.6, "C": 0.5, "E": 0.35}


def relation_strength(kind, relation) -> Column:
    kind, relation = _c(kind), _c(relation)
    stated = F.when(relation.isin(*STRONG_RELATIONS), 1.0).when(relation.isin(*WEAK_RELATIONS), 0.5).otherwise(0.8)
    out = F.when(kind == "R", stated)
    for name, strength in KIND_STRENGTH.items():
        out = out.when(kind == name, strength)
    return out


def development(strength, age_days, sources, days, anchors, stale, baseline, anchor_threshold) -> Column:
    """Rank of a development card: relation, novelty, corroboration, persistence and context, less penalties.

    baseline: the subject's daily rate, null for one that isn't tracked.
    """
    known = F.when(F.coalesce(_c(baseline) >= _c(anchor_threshold) / 2, F.lit(False)), 1.0).otherwise(0.0)
    return (
        3 * _c(strength)
        + 2 * F.exp(-_c(age_days) / 7.0)
        + F.least(_c(sources), F.lit(5)) / 5.0
        + F.least(_c(days), F.lit(5)) / 5.0
        + F.least(_c(anchors), F.lit(3)) / 3.0 * 0.5
        - F.when(_c(stale), 0.5).otherwise(0.0)
        - known
    )


#: Sources that make famous, and the least daily rate that does.
FAMOUS_SOURCES, FAMOUS_RATE = 12, 3.0


def is_famous(stored, in_dictionary, sources, rate, threshold) -> Column:
    """Whether a stored verdict, a dictionary, the number of sources that ever named it or the daily rate make something famous."""
    known = (F.coalesce(_c(stored), F.lit("unknown")) == "famous") | F.coalesce(_c(in_dictionary), F.lit(False))
    rate = F.coalesce(_c(rate), F.lit(0.0))
    return known | (F.coalesce(_c(sources), F.lit(0)) >= FAMOUS_SOURCES) | ((rate > 0) & (rate >= _c(threshold)))


def map_radius(mentions, most) -> Column:
    """Radius of a place on a map, 6 to 28 by the root of its share of the most mentions."""
    return F.when(_c(most) <= 1, 6.0).otherwise(6 + F.sqrt(_c(mentions).cast("double")) / F.sqrt(_c(most).cast("double")) * 22)


def node_size(mentions) -> Column:
    return F.sqrt(_c(mentions).cast("double")) * 2


def wiki_fame(matched, views, links) -> Column:
    """Whether a matched name is famous by page views, or by links with some views."""
    famous = (_c(views) >= 20000) | ((_c(links) >= 25) & (_c(views) >= 3000))
    return F.when(F.coalesce(_c(matched) & famous, F.lit(False)), "famous").otherwise("not_famous")


#: Prices of a million tokens of a month's ledger.
TOKEN_RATES = {"input_tokens": 1.0, "output_tokens": 5.0, "batch_input_tokens": 0.5, "batch_output_tokens": 2.5}


def cost_usd(tokens: dict[str, tuple[Column, float]]) -> Column:
    """Cost of a month's tokens: each counter with its rate for a million."""
    return sum((F.coalesce(n, F.lit(0)) / 1e6 * rate for n, rate in tokens.values()), F.lit(0.0))


def month_cost() -> Column:
    """Cost of a ledger row with the four counters of TOKEN_RATES."""
    return cost_usd({name: (F.col(name), rate) for name, rate in TOKEN_RATES.items()})


def within_budget(cost, budget) -> Column:
    """Whether another batch may be asked for: the month's cost is below the budget."""
    return _c(cost) < _c(budget)


def effective_days(days_since_epoch) -> Column:
    """Days of history that a baseline rests on: those before today, from 1 to 14."""
    return F.greatest(F.lit(1), F.least(F.lit(14), F.floor(_c(days_since_epoch)) - 1))
