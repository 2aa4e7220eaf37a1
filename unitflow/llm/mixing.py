"""Soft-membership mixing: documents belong to domains by degrees, and rates make domains meet targets.

1. A naive-Bayes classifier over hashed words learns domains from the documents that a labelled table
   names, at most SAMPLE of its ids; its counts are one combined aggregate of FEATURES rows a domain.
2. Every document gets a posterior over domains, in its own row.
3. Projected-gradient least squares finds nonnegative rates: each step needs the expected token totals of the
   domains, one aggregate of a few numbers, and a document's rate follows from its own posterior and the
   steps so far. Rates are never joined or shuffled. Steps go on until every domain is within the
   tolerance of its target or the totals no longer move; targets that no rates reach give a warning.

The driver holds the classifier (FEATURES x domains numbers) and a few numbers a step.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitflow.llm.common import let, text_of, words_of
from unitflow.session import materialise

FEATURES = 4096
SAMPLE = 20_000  # labelled ids that the classifier learns from, those of the least hash
TOLERANCE = 1e-4
STILL = 1e-7  # totals that move by less than this share have stopped
MAX_DOMAINS = 100  # a step sums the domains' products: domains squared


def _slots(text: Column) -> Column:
    return F.transform(words_of(text), lambda w: F.pmod(F.xxhash64(w), F.lit(FEATURES)).cast("int"))


def _literal(values: list[float]) -> Column:
    """A constant array, folded once when the query is planned."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


class Domains:
    """Names, and for each the log share and the log probability of every slot."""

    def __init__(self, names: list[str], prior: list[float], slots: list[list[float]]):
        self.names, self.prior, self.slots = names, prior, slots

    def posterior(self, text: Column) -> Column:
        """(n_tokens, p): the words of a text and its membership in each domain.

        Log likelihoods are divided by the square root of the number of words: words are not
        independent, and memberships of long texts would all be 0 or 1. Without words: the prior.
        """

        def soft(slots: Column) -> Column:
            n = F.greatest(F.size(slots), F.lit(1))
            logs = [
                let(
                    F.struct(slots.alias("s"), _literal(row).alias("m")),
                    lambda v: F.aggregate(v["s"], F.lit(0.0), lambda a, i: a + F.get(v["m"], i)),
                )
                / F.sqrt(n)
                + F.lit(share)
                for row, share in zip(self.slots, self.prior, strict=True)
            ]
            p = let(F.array(*logs), _softmax)
            return F.struct(F.size(slots).cast("long").alias("n_tokens"), p.alias("p"))

        return let(_slots(text), soft)


def _softmax(logs: Column) -> Column:
    top = lambda v: F.transform(v, lambda x: F.exp(x - F.array_max(v)))
    total = lambda e: F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return let(top(logs), lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s)))


def learn_domains(
    docs: DataFrame, labelled: DataFrame, domain: str = "lang", sample: int = SAMPLE
) -> Domains:
    """The classifier, from documents whose ``doc_id`` is in ``labelled`` and whose domain is not null.

    At most ``sample`` ids are taken, those of the least hash, so the broadcast is bounded and no text moves.
    """
    ids = labelled.select(F.col("doc_id").alias("__labelled")).where("__labelled is not null").distinct()
    ids = ids.orderBy(F.xxhash64("__labelled"), "__labelled").limit(sample)
    known = docs.where(F.col(domain).isNotNull()).join(
        F.broadcast(ids), F.col("doc_id") == F.col("__labelled"), "left_semi"
    )
    counts = (
        known.select(F.col(domain).cast("string").alias("domain"), F.explode(_slots(text_of())).alias("slot"))
        .groupBy("domain", "slot")
        .agg(F.count("*").alias("n"))
    )
    counts = materialise(counts, "domain-counts")
    # a row a domain: refuse what is no domain column before anything is collected
    names = [r.domain for r in counts.groupBy("domain").count().sort("domain").take(MAX_DOMAINS + 1)]
    if len(names) > MAX_DOMAINS:
        raise ValueError(f"{domain} has more than {MAX_DOMAINS} values")
    table = {name: [0] * FEATURES for name in names}
    for row in counts.collect():  # at most FEATURES rows a domain
        table[row.domain][row.slot] = row.n
    total = {name: sum(own) for name, own in table.items()}
    everything = sum(total.values())
    share = [math.log(total[name] / everything) for name in names]
    slots = [
        [math.log((n + 0.5) / (total[name] + 0.5 * FEATURES)) for n in table[name]] for name in names
    ]
    return Domains(names, share, slots)


def memberships(docs: DataFrame, domains: Domains) -> DataFrame:
    """All columns of ``docs`` plus ``n_tokens`` and ``p``."""
    # explode of one element: a barrier, so that a text is not classified once for each use
    found = docs.withColumn("__soft", F.explode(F.array(domains.posterior(text_of()))))
    return found.withColumns({c: F.col("__soft")[c] for c in ("n_tokens", "p")}).drop("__soft")


def rate_of(p: Column, steps: list[list[float]]) -> Column:
    """A document's rate after the given steps: each moves it against the slope and cuts it at 0."""
    rate = F.lit(1.0)
    if not steps:
        return rate
    k = len(steps[0])
    history = F.array(*[_literal(step) for step in steps])
    slope = lambda g: sum((F.get(g, F.lit(j)) * F.get(p, F.lit(j)) for j in range(k)), F.lit(0.0))
    return F.aggregate(history, rate, lambda r, g: F.greatest(r - slope(g), F.lit(0.0)))


def fit_rates(
    members: DataFrame,
    n_domains: int,
    weights: list[float] | None = None,
    tolerance: float = TOLERANCE,
) -> list[list[float]]:
    """Steps of projected gradient on sum over domains of (expected tokens - target)^2 / tokens.

    ``members``: n_tokens, p. Targets share all tokens by ``weights`` (default: equally). Slopes are taken per
    token, so documents of one membership get one rate whatever their length. A slope is turned by the inverse of
    the domains' Gram matrix over the documents whose rate is above 0, so domains that are much alike take few steps;
    a step that does not bring the totals nearer is taken back by half. Ends when every domain is within
    ``tolerance`` of its target, or with a warning when the totals have stopped.
    """
    ks = range(n_domains)
    n = F.col("n_tokens")
    at = lambda k: F.get("p", F.lit(k))

    def totals(history: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
        rated = members.select("n_tokens", "p", rate_of(F.col("p"), history).alias("rate"))
        live = F.when(F.col("rate") > 0, n).otherwise(0)
        found = rated.agg(
            *[F.coalesce(F.sum(F.col("rate") * n * at(k)), F.lit(0.0)) for k in ks],
            *[F.coalesce(F.sum(live * at(i) * at(j)), F.lit(0.0)) for i in ks for j in ks],
        ).first()
        return np.array(found[:n_domains]), np.array(found[n_domains:]).reshape(n_domains, -1)

    now, gram = totals([])
    if not now.sum():
        return []
    share = np.array(weights or [1.0] * n_domains)
    targets = now.sum() * share / share.sum()
    allowed = tolerance * np.maximum(targets, 1.0)
    history: list[list[float]] = []
    part = 1.0
    while (np.abs(now - targets) > allowed).any():
        step = part * np.linalg.pinv(gram, rcond=1e-9, hermitian=True) @ (now - targets)
        tried, live = totals([*history, step.tolist()])
        gap, before = (float(((t - targets) ** 2).sum()) for t in (tried, now))
        if gap >= before * (1 - STILL):
            part /= 2
            if part < 1e-3:
                warnings.warn(f"domain totals {now.tolist()} do not reach {targets.tolist()}", stacklevel=2)
                break
            continue
        history.append(step.tolist())
        now, gram, part = tried, live, min(1.0, part * 2)
    return history


def _fitted(docs: DataFrame, labelled: DataFrame, domain: str, weights: dict[str, float] | None):
    """The classifier, the written table (doc_id, n_tokens, p), and the steps."""
    domains = learn_domains(docs, labelled, domain)
    narrow = materialise(memberships(docs, domains).select("doc_id", "n_tokens", "p"), "memberships")
    wanted = weights and [float(weights.get(name, 0.0)) for name in domains.names]
    history = fit_rates(narrow, len(domains.names), wanted) if domains.names else []
    return domains, narrow, history


def mixing_rates(
    docs: DataFrame,
    labelled: DataFrame,
    domain: str = "lang",
    weights: dict[str, float] | None = None,
) -> DataFrame:
    """(doc_id, n_tokens, p, rate) of each row of ``docs``; ``p`` is by domain name, ascending.

    ``domain`` is the column whose values are the domains, ``labelled`` a table whose ``doc_id`` values name the
    documents to learn from, ``weights`` the wanted share of tokens of each domain (default: equal; a
    domain that is not named: 0). A null text has no words, the prior as membership and a rate like any
    other; repeated rows get equal rates; an empty table gives none. Without a labelled document every
    rate is 1 and ``p`` is empty. Other columns are not looked at. A text is classified once.
    """
    docs = docs.select("doc_id", "text", F.col(domain).alias("domain"))
    _, narrow, history = _fitted(docs, labelled, "domain", weights)
    return narrow.withColumn("rate", rate_of(F.col("p"), history))


def copies_of(rate: Column, *key: Column) -> Column:
    """How often a document of this rate is taken: the rate, rounded up or down by a hash of ``key``."""
    chance = F.pmod(F.xxhash64(*key), F.lit(1_000_000)) / F.lit(1e6)
    return (F.floor(rate) + F.when(chance < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def mix(docs: DataFrame, labelled: DataFrame, domain: str = "lang", weights=None) -> DataFrame:
    """The rows of ``docs``, each as often as its rate says; columns as they are."""
    rows = docs.select(
        F.struct("*").alias("__row"), "doc_id", "text", F.col(domain).alias("domain")
    )
    domains, _, history = _fitted(rows.drop("__row"), labelled, "domain", weights)
    # classified again rather than joined: that would shuffle all texts
    rated = memberships(rows, domains).withColumn("rate", rate_of(F.col("p"), history))
    times = F.sequence(F.lit(1), copies_of(F.col("rate"), F.col("doc_id"), F.xxhash64(text_of())))
    taken = rated.where(copies_of(F.col("rate"), F.col("doc_id"), F.xxhash64(text_of())) > 0)
    return taken.withColumn("__time", F.explode(times)).select("__row.*")
