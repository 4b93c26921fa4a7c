"""Mixing documents to target weights of soft domains, in DataFrame functions only.

1. A naive Bayes classifier of the presence of hashed words is counted on a bounded
   sample of a labelled table (``per_domain`` ids of each domain, the first in the order
   of their hash); the domains' shares in the whole labelled table are the priors. Only
   buckets that clearly mark a domain count, so that what many words share, such as a
   language, does not. It gives every document a posterior over the domains: its soft
   membership.
2. Rates r >= 0 are fitted so that the expected tokens of each domain,
   ``sum(r * tokens * posterior)``, match the targets: projected gradient on the least
   squares of the totals, with the summed steps kept in the space of domains and scaled by
   its curvature. A step is one aggregation to a few numbers; a document's rate is a
   projection of its posterior times a number a domain, so no state is shuffled. The fit
   ends where the gradient is zero (see ``fit``), usually after some ten passes.
3. A rate becomes a number of copies: its whole part, and one more with the odds of the
   rest, by a hash of the id.

Rows that share an id are one document here: their words and tokens add up, and they get
one rate. A null id is an id. Null and empty texts have no tokens and the priors as
posterior. Domains without labels or with no target are left out; without labels every
rate is 1. Texts are whole. Further columns of ``docs`` are carried by ``take``, whatever
their names, and not looked at. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BUCKETS = 1 << 16


def bags(docs: DataFrame, *keep: str) -> DataFrame:
    """A row for each bucket of a text's words, with the columns ``keep``, its place and
    the text's number of words; a text without words has one row, of no bucket."""
    text = F.translate(F.lower(F.coalesce("text", F.lit(""))), "\t\n\x0b\x0c\r", "     ")
    words = docs.select(*keep, F.array_remove(F.split(text, " "), "").alias("words"))
    buckets = F.array_distinct(F.transform("words", lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS))))
    return words.select(*keep, F.size("words").alias("n"), F.posexplode_outer(buckets).alias("place", "bucket"))


def train(docs: DataFrame, labelled: DataFrame, domains: list[str], per_domain: int = 8000, clear: float = 4.0) -> tuple[DataFrame, list[float]]:
    """(bucket, e0, e1, ...: evidence of its presence for each domain), and each domain's
    log prior with the evidence of all these buckets' absence.

    A bucket counts if some domain's documents have it at least twice as often as
    expected, and by ``clear`` standard deviations. The table has at most BUCKETS rows.
    """
    spark = docs.sparkSession
    known = labelled.where(F.col("domain").isin(domains)).groupBy("doc_id").agg(F.min("domain").alias("domain"), F.max("domain").alias("other")).where("domain = other").drop("other")
    known = common.stored(spark, known.join(docs.select("doc_id"), "doc_id", "left_semi"), "known")
    sizes = {r.domain: r["count"] for r in known.groupBy("domain").count().collect()}  # a row a domain
    total = sum(sizes.values())
    picked = None
    for d in domains:
        one = known.where(F.col("domain") == d).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_domain)
        picked = one if picked is None else picked.unionByName(one)
    sample = common.stored(spark, picked, "sample")  # per_domain rows a domain at most
    seen = bags(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"), "domain").where("bucket is not null")
    by = seen.groupBy("bucket").agg(*[F.count_if(F.col("domain") == d).alias(f"c{k}") for k, d in enumerate(domains)])
    n = [min(sizes.get(d, 0), per_domain) for d in domains]
    every = sum(F.col(f"c{k}") for k in range(len(domains)))
    clearly = F.lit(False)
    for k, own in enumerate(n):
        rest = sum(n) - own
        expected = every * (own / max(sum(n), 1))
        # At least four times as frequent as in the other domains together, and not by chance.
        often = F.col(f"c{k}") * float(rest) >= 4.0 * own * (every - F.col(f"c{k}"))
        clearly = clearly | (often & F.lit(own > 0 and rest > 0) & (F.col(f"c{k}") - expected >= clear * F.sqrt(expected + 0.5)))
    share = lambda k, own: F.least(F.col(f"c{k}") + 0.5, F.lit(own + 0.5)) / (own + 1)
    odds = [F.log(share(k, own) / (1 - share(k, own))).alias(f"e{k}") for k, own in enumerate(n)]
    absent = [F.log(1 - share(k, own)).alias(f"a{k}") for k, own in enumerate(n)]
    model = common.stored(spark, by.where(clearly).select("bucket", *odds, *absent), "buckets")
    sums = model.agg(*[F.coalesce(F.sum(f"a{k}"), F.lit(0.0)) for k in range(len(domains))]).first()
    start = [float(np.log((sizes.get(d, 0) + 1) / (total + len(domains)))) + a for d, a in zip(domains, sums, strict=True)]
    return model.select("bucket", *[f"e{k}" for k in range(len(domains))]), start


def posteriors(docs: DataFrame, model: DataFrame, start: list[float]) -> DataFrame:
    """doc_id, n_tokens, p (array, a posterior for each domain)."""
    n = len(start)
    words = bags(docs, "doc_id").join(F.broadcast(model), "bucket", "left")  # BUCKETS rows at most
    once = F.sum(F.when(F.coalesce("place", F.lit(0)) == 0, F.col("n")).otherwise(0))
    sums = words.groupBy("doc_id").agg(once.alias("n_tokens"), *[F.sum(F.coalesce(f"e{k}", F.lit(0.0))).alias(f"z{k}") for k in range(n)])
    z = [F.col(f"z{k}") + start[k] for k in range(n)]
    top = F.greatest(*z) if n > 1 else z[0]
    odds = sums.withColumn("w", F.array(*[F.exp(x - top) for x in z]))
    total = F.aggregate("w", F.lit(0.0), lambda s, x: s + x)
    return odds.withColumn("total", total).select("doc_id", "n_tokens", F.transform("w", lambda x: x / F.col("total")).alias("p"))


def _dot(p: Column, g: Column, n: int) -> Column:
    out = F.lit(0.0)
    for k in range(n):
        out = out + p[k] * g[k]
    return out


def _rate(dual: list[float], n: int, most: float | None) -> Column:
    """A document's rate: 1 moved by the domains' duals and projected on what is allowed."""
    r = F.greatest(F.lit(1.0) + _dot(F.col("p"), [F.lit(x) for x in dual], n), F.lit(0.0))
    return r if most is None else F.least(r, F.lit(most))


@dataclass(frozen=True)
class Fit:
    """The domains' duals, the targets (tokens of each domain) and the totals reached, the
    passes made and what is left of the optimality condition, as a share of all tokens."""

    dual: list[float]
    wanted: list[float]
    reached: list[float]
    passes: int = 0
    residual: float = 0.0


def fit(soft: DataFrame, weights: list[float], budget: float | None = None, most: float | None = None, ridge: float = 1e-6, close: float = 1e-9, passes: int = 100) -> Fit:
    """Rates of at least 0 whose expected domain totals are nearest to the targets.

    ``budget`` is the mix's tokens, by default those there are. With ``most`` no rate
    exceeds it, and a domain that has less than its target keeps what it has: the
    budget is then the largest at which the first domain keeps its tokens.

    Minimised is |totals - targets|^2 plus ``ridge`` times the rates' distance from 1, over
    rates within their bounds. Gradient steps are summed in the space of domains and the
    sum is projected, so rates depend on a number a domain, whatever the steps. A step is
    scaled by the curvature of the rates that are not beyond a bound (Newton) and damped
    until it gains; one that doesn't is not taken. The problem is strictly convex: the gradient is zero at the one solution,
    and that, not a small step, ends the fit. Targets that no rates reach leave a gap
    between ``wanted`` and ``reached`` with a gradient of zero all the same.
    """
    n = len(weights)
    mass = F.col("n_tokens").cast("double")
    base = soft.agg(F.sum(mass), *[F.sum(mass * F.col("p")[k]) for k in range(n)]).first()
    if not base[0]:
        return Fit([0.0] * n, [0.0] * n, [0.0] * n)
    share, start = np.array(weights, float) / sum(weights), np.array(base[1:], float) / base[0]
    goal = share * (1 if budget is None else budget / base[0]) if most is None else np.minimum(start, share * start[0] / share[0])

    def look(dual: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Dual objective, totals and curvature in one pass."""
        at = [float(x) for x in dual]
        free = F.lit(1.0) + _dot(F.col("p"), [F.lit(x) for x in at], n)
        rated = soft.withColumn("r", _rate(at, n, most)).withColumn("free", free)
        inside = ((F.col("free") >= 0) & (F.lit(most is None) | (F.col("free") <= (most or 0.0)))).cast("double")
        # The conjugate of half the squared distance from 1: its slope is the rate.
        value = F.col("r") * (F.col("free") - 1) - (F.col("r") - 1) * (F.col("r") - 1) / 2
        sums = [F.sum(mass * value), *[F.sum(mass * F.col("r") * F.col("p")[k]) for k in range(n)]]
        sums += [F.sum(mass * inside * F.col("p")[i] * F.col("p")[j]) for i in range(n) for j in range(n)]
        found = np.array(rated.agg(*sums).first(), float) / base[0]
        return found[0] + ridge / 2 * dual @ dual - goal @ dual, found[1 : n + 1], found[n + 1 :].reshape(n, n)

    dual, done, damping = np.zeros(n), 1, ridge
    value, totals, curve = look(dual)
    while done < passes:
        gradient = totals - goal + ridge * dual
        if np.abs(gradient).max() <= close:
            break
        move = -np.linalg.solve(curve + np.eye(n) * (ridge + damping), gradient)
        new = look(dual + move)
        done += 1
        if new[0] <= value + 1e-4 * float(gradient @ move):
            dual, (value, totals, curve) = dual + move, new
            damping = damping / 8 if damping > 1e-6 else 0.0
        elif np.abs(move).max() <= 1e-12 * max(1.0, np.abs(dual).max()):
            break  # what is left is rounding
        else:
            damping = max(damping * 8, 1e-5)
    residual = float(np.abs(totals - goal + ridge * dual).max())
    return Fit(dual.tolist(), (goal * base[0]).tolist(), (totals * base[0]).tolist(), done, residual)


def copies(rate: Column, key: Column, seed: int = 11) -> Column:
    """How often to take a document of this rate."""
    u = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 32)) / float(1 << 32)
    return (F.floor(rate) + (u < rate - F.floor(rate)).cast("long")).cast("long")


@dataclass(frozen=True)
class Mix:
    """doc_id, n_tokens, p (array in the order of the weights), rate and copies of each id,
    the expected tokens of each domain, wanted and reached, and the fit's residual."""

    rows: DataFrame
    wanted: dict[str, float]
    reached: dict[str, float]
    residual: float = 0.0


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], most: float | None = None) -> Mix:
    spark, domains = docs.sparkSession, list(weights)
    texts = docs.select("doc_id", "text")
    model, start = train(texts, labelled, domains)
    soft = common.stored(spark, posteriors(texts, model, start), "posteriors")
    found = fit(soft, [*weights.values()], most=most)
    rated = soft.withColumn("rate", _rate(found.dual, len(domains), most))
    return Mix(rated.withColumn("copies", copies(F.col("rate"), F.col("doc_id"))), dict(zip(domains, found.wanted, strict=True)), dict(zip(domains, found.reached, strict=True)), found.residual)


def take(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as ``mixed`` says; all columns stay."""
    plan = mixed.where("copies > 0").select("doc_id", F.sequence(F.lit(1).cast("long"), "copies").alias("times"))
    row = docs.select("doc_id", F.struct("*").alias("row"))
    joined = row.join(plan, row["doc_id"].eqNullSafe(plan["doc_id"]))
    return joined.select("row", F.explode("times")).select("row.*")


#: The production mix of the labelled classes.
WEIGHTS = {"clean": 0.90, "toxic": 0.04, "poor": 0.06}


def labelled(labels: DataFrame) -> DataFrame:
    """doc_id and domain of labelled rows: poor, toxic or clean."""
    domain = F.when(F.col("quality") == 0, "poor").when(F.col("toxic") == 1, "toxic").when((F.col("quality") == 1) & (F.col("toxic") == 0), "clean")
    return labels.select("doc_id", domain.alias("domain"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior, rate and copies of every document for the production mix."""
    mixed = mix(common.table(spark, sf_dir, "documents"), labelled(common.table(spark, sf_dir, "labels")), WEIGHTS)
    totals = [F.lit(of[d]).alias(f"{name}_{d}") for name, of in (("wanted", mixed.wanted), ("reached", mixed.reached)) for d in WEIGHTS]
    return mixed.rows.select("doc_id", "n_tokens", *[F.col("p")[k].alias(f"p_{d}") for k, d in enumerate(WEIGHTS)], "rate", "copies", *totals)
