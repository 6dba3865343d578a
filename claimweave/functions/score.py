"""Scores of claims, edges, events and hypotheses, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Half-lives in days by keywords that a predicate contains, in order; None does not decay.
EDGE_HALF_LIVES = (
    (("own", "subsidiary", "parent", "incorporat", "headquarter", "listed", "founded", "ceo", "cfo", "chair", "director", "appointed", "serves"), None),
    (("acquir", "merg", "partner", "deal", "agreement", "contract", "invest", "backs", "funding"), 180),
    (("suppl", "customer", "depend", "sources"), 540),
    (("litigat", "sued", "lawsuit"), 365),
)
EDGE_DEFAULT = 365
CLAIM_HALF_LIVES = (
    (("headcount", "guidance", "price", "forecast", "expects"), 90),
    (("revenue", "profit", "earnings", "margin", "reported"), 365),
    (("incorporat", "founded", "headquarter", "own", "subsidiary", "listed"), None),
)
CLAIM_DEFAULT = 540
# Materiality of filings by item, of other filings, and of titles with a keyword or without.
ITEM_SCORES = {"2.01": 0.9, "1.01": 0.9, "5.01": 0.9, "5.02": 0.7, "1.03": 0.7, "7.01": 0.7}
OTHER_ITEM, OTHER_FORM, KEYWORD_SCORE, DULL_SCORE = 0.5, 0.4, 0.7, 0.3
TITLE_KEYWORDS = ("acquisition", "acquire", "merger", "buyout", "bankruptcy", "chapter 11", "resign", "appoint", "guidance", "lawsuit", "sues", "recall", "investigation", "halt", "default")
FAST_FROM = 0.6
# Of hypotheses.
WATCHED_WEIGHT = (0.4, 0.7, 1.0)
PRIORS, OTHER_PRIOR = {"attribute_join_v0": 0.6}, 0.5


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike("|".join(words))


def _half_life(predicate: Column, rules: tuple, default: int) -> Column:
    out = None
    for words, days in rules:
        value = F.lit(days).cast("int")
        out = F.when(contains_any(predicate, words), value) if out is None else out.when(contains_any(predicate, words), value)
    return out.otherwise(default)


def edge_half_life(predicate: Column) -> Column:
    """Days in which an edge's relevance halves; null if it is structural. The predicate is taken as it is."""
    return _half_life(predicate, EDGE_HALF_LIVES, EDGE_DEFAULT)


def claim_half_life(predicate: Column) -> Column:
    return _half_life(F.lower(F.coalesce(predicate, F.lit(""))), CLAIM_HALF_LIVES, CLAIM_DEFAULT)


def days_between(start: Column, end: Column) -> Column:
    """Days with their fractions, from microseconds."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(end) - micros(start)) / 86_400_000_000.0


def edge_relevance(half_life: Column, last_evidence: Column, at: Column) -> Column:
    """1 without a half-life, else a power of one half; over 1 for evidence after ``at``."""
    return F.when(half_life.isNull(), 1.0).otherwise(F.pow(F.lit(2.0), -days_between(last_evidence, at) / half_life))


def confidence_now(confidence: Column, observed: Column, predicate: Column, at: Column) -> Column:
    """Confidence after decay, rounded half to even to two places; as it is without a confidence or a time."""
    days = claim_half_life(predicate)
    age = F.greatest(F.lit(0.0), days_between(observed, at))
    decayed = F.when(days.isNull(), confidence).otherwise(confidence * F.pow(F.lit(2.0), -age / days))
    return F.when(confidence.isNull() | observed.isNull(), confidence).otherwise(F.bround(decayed, 2))


def materiality(connector: Column, form: Column, items: Column, title: Column) -> Column:
    scores = F.create_map(*[F.lit(x) for pair in ITEM_SCORES.items() for x in pair])
    found = F.regexp_extract_all(F.coalesce(items, F.lit("")), F.lit(r"\d+\.\d+"), F.lit(0))
    filing = F.when(F.size(found) > 0, F.array_max(F.transform(found, lambda i: F.coalesce(F.try_element_at(scores, i), F.lit(OTHER_ITEM))))).when(form == "8-K", OTHER_ITEM).otherwise(OTHER_FORM)
    return F.when(connector == "edgar", filing).when(contains_any(F.lower(F.coalesce(title, F.lit(""))), TITLE_KEYWORDS), KEYWORD_SCORE).otherwise(DULL_SCORE)


def hypothesis_score(together: Column, watched: Column, strategy: Column) -> Column:
    """Novelty, times a weight for how many of the two subjects are watched, times the strategy's prior."""
    weight = F.when(watched == 2, WATCHED_WEIGHT[2]).when(watched == 1, WATCHED_WEIGHT[1]).otherwise(WATCHED_WEIGHT[0])
    prior = F.when(strategy == "attribute_join_v0", PRIORS["attribute_join_v0"]).otherwise(OTHER_PRIOR)
    return F.lit(1.0) / (F.lit(1.0) + together) * weight * prior


def relative_difference(a: Column, b: Column) -> Column:
    """|a - b| over the larger magnitude; null if both are 0."""
    most = F.greatest(F.abs(a), F.abs(b))
    return F.when(most != 0, F.abs(a - b) / most)


def clamp01(value: Column, fallback: float | None) -> Column:
    """A number in [0, 1] from text; ``fallback`` if it is none."""
    parsed = value.try_cast("double")
    return F.when(parsed.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), parsed))).otherwise(F.lit(fallback).cast("double"))


def source_reliability(corroborated: Column, superseded: Column) -> Column:
    """From the shares of a source's claims that others corroborate and that were superseded."""
    return F.least(F.lit(0.95), F.greatest(F.lit(0.1), F.lit(0.5) + 0.3 * corroborated - 0.4 * superseded))
