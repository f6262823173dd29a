"""Mixing to target weights by soft domain membership, in DataFrame operations only.

A naive Bayes classifier over hashed words is counted from a labelled table and
gives every document a posterior over the domains. Projected gradient descent
then fits non-negative document rates r to minimise the weighted squares

    sum_k (S_k - T_k)^2 / C_k,   S_k = sum_d r_d n_d p_dk,   C_k = sum_d n_d p_dk

of expected domain totals S against targets T (n tokens, p posteriors). With
rates scaled by their tokens the gradient of a document is sum_k p_dk
(S_k - T_k) / C_k, and the matrix of the step has column sums of one, so the
largest eigenvalue is 1 and the step 1 descends. An iteration is one aggregation
of as many sums as there are domains; the rates stay in their table.
"""

from __future__ import annotations

import json
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import checkpointed, small_or_shuffled, stored
from plumbline.llm.quality_rules import SPACES

#: Hash buckets of words, labelled rows counted, distinct words that a document's evidence tends to.
BUCKETS, LABELLED_ROWS, EVIDENCE_WORDS = 2048, 4_000, 200.0
#: Relative error at which gradient steps end, the least relative gain of a step, steps at most, and between checkpoints of the rates.
ENOUGH, LEAST_GAIN, STEPS, STEPS_A_TABLE = 1e-4, 1e-5, 400, 8


def _words(text: str) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), SPACES), lambda x: x != "")


def fit_posteriors(docs: DataFrame, labelled: DataFrame, bound: int = LABELLED_ROWS, doc_id: str = "doc_id", text: str = "text") -> tuple[list[str], DataFrame]:
    """(domains, model): model has ``bucket`` and ``ll``, the log-likelihoods of the bucket in each domain.

    ``labelled`` has ``doc_id, domain``; the ``bound`` rows with the smallest
    hash of the id are counted, and all their domains are learnt. An id labelled
    more than once keeps its smallest domain.
    """
    named = labelled.select("doc_id", "domain").where("doc_id is not null and domain is not null")
    ids = checkpointed(named.groupBy("doc_id").agg(F.min("domain").alias("domain")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound))
    domains = sorted(r.domain for r in ids.select("domain").distinct().collect())
    if not domains:
        return [], docs.sparkSession.createDataFrame([], "bucket int, ll array<double>")
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")).join(small_or_shuffled(ids, ids.count()), "doc_id")
    rows = texts.select("domain", F.explode(F.array_distinct(_words("_text"))).alias("word"))
    counts = rows.groupBy(F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).cast("int").alias("bucket")).pivot("domain", domains).count().fillna(0)
    counts = checkpointed(counts)
    totals = counts.agg(*(F.sum(F.col(f"`{d}`")).alias(f"t{k}") for k, d in enumerate(domains))).first()
    likelihoods = [F.log((F.col(f"`{d}`") + 0.5) / F.lit(float((totals[k] or 0) + 0.5 * BUCKETS))) for k, d in enumerate(domains)]
    return domains, counts.select("bucket", F.array(*likelihoods).alias("ll"))


def _total(table: Column) -> Column:
    return F.aggregate("_buckets", F.lit(0.0), lambda total, bucket: total + F.get(table, bucket))


def soft_memberships(docs: DataFrame, labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", *carry: Column) -> tuple[list[str], DataFrame]:
    """(domains, rows of doc_id, ``carry``, n_tokens, p): p is the posterior over the domains, uniform for a text without words.

    The mean log-likelihood of a document's n distinct words counts for
    n * E / (n + E) of them, E being ``EVIDENCE_WORDS``, so that long texts stay soft.
    """
    domains, model = fit_posteriors(docs, labelled, doc_id=doc_id, text=text)
    k = len(domains)
    # at most BUCKETS rows of a number for each domain: one literal for each domain
    cells = {r.bucket: r.ll for r in model.collect()}
    floors = [min((c[j] for c in cells.values()), default=0.0) for j in range(k)]
    tables = [F.from_json(F.lit(json.dumps([cells[b][j] if b in cells else floors[j] for b in range(BUCKETS)])), "array<double>") for j in range(k)]
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), *carry, _words(text).alias("_words"))
    keep = rows.columns[:-1]
    rows = rows.select(
        *keep,
        F.size("_words").cast("long").alias("n_tokens"),
        F.transform(F.array_distinct("_words"), lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int")).alias("_buckets"),
    )
    sums = [_total(t) for t in tables]
    scale = F.lit(EVIDENCE_WORDS) / (F.lit(EVIDENCE_WORDS) + F.size("_buckets"))
    rows = rows.select(*keep, "n_tokens", (F.array(*(s * scale for s in sums)) if k else F.array().cast("array<double>")).alias("_ll"))
    rows = rows.select(*keep, "n_tokens", F.transform("_ll", lambda x: F.exp(x - F.array_max("_ll"))).alias("_w"))
    rows = rows.select(*keep, "n_tokens", F.transform("_w", lambda x: x / F.aggregate("_w", F.lit(0.0), lambda t, y: t + y)).alias("p"))
    return domains, rows


def _stepped(rate: Column, pull: Column, k: int) -> Column:
    """The rate of a row after a gradient step, projected on the non-negative."""
    gradient = sum((F.col("p")[j] * pull[j] for j in range(k)), F.lit(0.0))
    return F.greatest(F.lit(0.0), rate - gradient)


def _targets(natural: list[float], weights: list[float | None], budget: float | None) -> list[float]:
    """Target totals: a domain without a weight keeps its natural share, the others share the rest by their weights."""
    total, given = sum(natural), sum(w for w in weights if w is not None)
    if not total:
        return [0.0] * len(natural)
    if not given:
        weights = [None] * len(natural)
    free = 1 - sum(c for c, w in zip(natural, weights, strict=True) if w is None) / total
    share = [c / total if w is None else free * w / given for c, w in zip(natural, weights, strict=True)]
    if budget is None:
        budget = min((c / s for c, s in zip(natural, share, strict=True) if s > 0 and c > 0), default=0.0)
    return [budget * s for s in share]


def fit_steps(rows: DataFrame, weights: list[float | None], budget: float | None = None) -> tuple[DataFrame, list[list[float]], list[float], list[float]]:
    """Fit rates of rows with ``n_tokens`` and ``p``: (rows with ``rate``, pulls, targets, expected totals reached).

    A rate follows from the row's ``p`` and the pull of each step on each domain
    alone, so the pulls give any row its rate again without a join.

    ``weights`` are the targets' shares, None for a natural one; the targets' sum
    is ``budget`` tokens, by default the largest that needs no domain more than
    once. Steps end at a total error of ``ENOUGH`` of the budget. Where targets
    cannot be met (two domains in the same documents, say) they end when a step
    gains no more, with a warning that tells the totals.
    """
    k = len(weights)
    mass = [F.sum(F.col("n_tokens") * F.col("p")[j]).alias(f"c{j}") for j in range(k)]
    first = rows.agg(*mass).first()
    natural = [float(first[j] or 0.0) for j in range(k)]
    targets = _targets(natural, weights, budget)
    enough = ENOUGH * max(sum(targets), 1.0)
    state = rows.withColumn("rate", F.lit(1.0))
    reached, pulls, error = natural, [], float("inf")
    while (worst := max((abs(r - t) for r, t in zip(reached, targets, strict=True)), default=0.0)) > enough:
        before, error = error, sum((r - t) ** 2 / c for r, t, c in zip(reached, targets, natural, strict=True) if c > 0)
        if len(pulls) == STEPS or error > before * (1 - LEAST_GAIN):
            warnings.warn(f"expected totals {reached} miss the targets {targets} by up to {worst:.0f} tokens after {len(pulls)} steps", stacklevel=2)
            break
        pull = [(r - t) / c if c > 0 else 0.0 for r, t, c in zip(reached, targets, natural, strict=True)]
        pulls.append(pull)
        state = state.withColumn("rate", _stepped(F.col("rate"), F.lit(pull), k))
        if len(pulls) % STEPS_A_TABLE == 0:
            state = checkpointed(state)
        sums = state.agg(*(F.sum(F.col("rate") * F.col("n_tokens") * F.col("p")[j]).alias(f"s{j}") for j in range(k))).first()
        reached = [float(sums[j] or 0.0) for j in range(k)]
    return state, pulls, targets, reached


def fit_rates(rows: DataFrame, weights: list[float | None], budget: float | None = None) -> tuple[DataFrame, list[float], list[float]]:
    """``fit_steps`` without the pulls: (rows with ``rate``, targets, expected totals reached)."""
    state, _, targets, reached = fit_steps(rows, weights, budget)
    return state, targets, reached


def _weights(domains: list[str], targets: dict[str, float] | None) -> list[float | None]:
    return [1.0] * len(domains) if targets is None else [targets.get(d) for d in domains]


def _copies() -> Column:
    """The whole part of the rate, plus one if a hash of the id falls below the rest."""
    chance = F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(2**40)) / F.lit(float(2**40))
    return (F.floor("rate") + F.when(chance < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int")


def labelled_languages(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, domain: the languages of a bounded sample of the documents that a label table covers."""
    ids = labels.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED_ROWS)
    return docs.select("doc_id", F.col("lang").alias("domain")).join(F.broadcast(ids), "doc_id")


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, budget: float | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Return ``doc_id, n_tokens, domain, posterior, rate, copies, target_tokens, expected_tokens`` for each row.

    ``targets`` maps domains to weights (default: all alike; a domain it leaves
    out keeps its natural share). ``domain`` and ``posterior`` are the likeliest
    domain and its probability, ``rate`` the fitted non-negative rate, ``copies``
    its whole part plus one if a hash of the id falls below the rest, so expected
    totals carry over to the drawn documents. ``target_tokens`` and
    ``expected_tokens`` are the target of the row's domain and the total that
    the rates reach. A text without words has no tokens and keeps rate and copy
    1 unless the posterior's pull lowers it; long texts are read whole. Null ids
    and repeated rows get their own rows; other columns are ignored. An empty
    table gives an empty result; without labels every rate is 1 and the totals
    are null.
    """
    domains, rows = soft_memberships(docs, labelled, doc_id, text)
    if not domains:
        none = F.lit(None).cast("double")
        return rows.select(
            "doc_id", "n_tokens", F.lit(None).cast("string").alias("domain"), none.alias("posterior"), F.lit(1.0).alias("rate"), F.lit(1).alias("copies"), none.alias("target_tokens"), none.alias("expected_tokens")
        )
    rows = stored(rows, "members")
    fitted, targets_met, reached = fit_rates(rows, _weights(domains, targets), budget)
    at = F.array_position("p", F.array_max("p")).cast("int")
    return fitted.select(
        "doc_id",
        "n_tokens",
        F.element_at(F.lit(domains), at).alias("domain"),
        F.array_max("p").alias("posterior"),
        "rate",
        _copies().alias("copies"),
        F.element_at(F.lit(targets_met), at).alias("target_tokens"),
        F.element_at(F.lit(reached), at).alias("expected_tokens"),
    )


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, budget: float | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, each as often as its ``copies`` in ``mix``.

    A row is written once beside its posterior and its rate is computed from the
    fitted pulls, so whole texts are not shuffled; repeated ids and null ids
    need no care. Null and empty texts and long ones are taken as ``mix`` does.
    Without labels every row stays once; an empty table gives an empty result.
    """
    domains, rows = soft_memberships(docs, labelled, doc_id, text, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    if not domains:
        return docs
    rows = stored(rows, "members")
    _, pulls, _, _ = fit_steps(rows.select("n_tokens", "p"), _weights(domains, targets), budget)
    rate = F.aggregate(F.lit(pulls), F.lit(1.0), lambda r, g: _stepped(r, g, len(domains))) if pulls else F.lit(1.0)
    drawn = rows.withColumn("rate", rate).select("_row", _copies().alias("copies")).where("copies > 0")
    return drawn.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")
