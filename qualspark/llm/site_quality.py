"""Quality of documents from their own text and from their sites, by hierarchical empirical Bayes.

A logistic classifier on text statistics gives each document's own evidence. Its posteriors, summed over all documents
by host and by path, say how good sites are. Host means are shrunk toward the global mean, path means toward their
host's, with prior strengths estimated from how much sites differ beyond chance; sparse sites so say little. A
document's own evidence leaves the sums of its sites before they are read as its prior. The result adds the log odds
of the document and of its path, over the global log odds.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, rows_under, sized_broadcast
from .quality_rules import features, with_text_stats

#: Labelled rows that the classifier is fitted on, at most; taken in the order of a hash of the id.
SAMPLE_ROWS = 8_000
#: Sites up to which their table is broadcast; above, the join is shuffled.
BROADCAST_ROWS = 500_000
#: Bounds of estimated prior strengths, in documents.
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 10_000.0
_EDGE = 0.002


def _inputs() -> dict[str, Column]:
    """Features of the classifier: shares, bent so that a few extreme texts do not set the scale."""
    own = {k: F.log1p(F.least(20 * F.greatest(c, F.lit(0.0)), F.lit(1e6))) for k, c in features().items()}
    return own | {"log_words": F.log1p(F.col("stats.n_words").cast("double"))}


def fit_classifier(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE_ROWS, ridge: float = 1.0) -> tuple[dict[str, float], float]:
    """(weights by feature, intercept) of a logistic regression on at most `sample` labelled documents.

    Without labels of both classes all weights are 0 and the intercept is the labels' log odds (0 without any).
    """
    named = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min("quality").alias("_y"))
    if not rows_under(named, sample):
        named = named.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    known = with_text_stats(docs.select(F.col("doc_id").cast("long").alias("_id"), "text").join(F.broadcast(named), "_id"))
    inputs = _inputs()
    rows = known.select("_id", "_y", *(c.alias(k) for k, c in inputs.items())).limit(2 * sample).collect()
    rows = sorted(rows, key=tuple)
    x = np.array([[r[k] for k in inputs] for r in rows], dtype=np.float64).reshape(len(rows), len(inputs))
    y = np.array([float(r["_y"] == 1) for r in rows])
    if not 0 < y.sum() < len(y):
        share = min(0.99, max(0.01, y.mean())) if len(y) else 0.5
        return dict.fromkeys(inputs, 0.0), float(np.log(share / (1 - share)))
    mean, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    design = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    penalty, beta = ridge * np.append(np.ones(len(inputs)), 0.0), np.zeros(len(inputs) + 1)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        hessian = (design * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ design + np.diag(penalty + 1e-9)
        beta = beta + np.clip(np.linalg.solve(hessian, design.T @ (y - p) - penalty * beta), -3, 3)
    weights = beta[:-1] / spread
    return dict(zip(inputs, map(float, weights), strict=True)), float(beta[-1] - weights @ mean)


def _strength(n: Column, mean: Column, prior: Column) -> Column:
    """Aggregate: beta prior strength by moments, from how far site means lie from their prior beyond chance."""
    chance = prior * (1 - prior)
    spread = F.sum(n * (mean - prior) ** 2) - F.sum(chance)  # a site of n documents strays by chance / n
    between = spread / F.sum(n)
    typical = F.sum(n * chance) / F.sum(n)
    raw = F.when(between > 0, typical / between - 1).otherwise(MOST_STRENGTH)
    return F.coalesce(F.least(F.greatest(raw, F.lit(LEAST_STRENGTH)), F.lit(MOST_STRENGTH)), F.lit(MOST_STRENGTH))


def _logit(p: Column) -> Column:
    inside = F.least(F.greatest(p, F.lit(_EDGE)), F.lit(1 - _EDGE))
    return F.log(inside / (1 - inside))


def site_quality(docs: DataFrame, labels: DataFrame, host: Column, path: Column, *, threshold: float = 0.5) -> DataFrame:
    """Per row of `docs`: doc_id, host, path, own (classifier), host_mean, path_mean (without the document), score, kept.

    docs: doc_id, text and what the columns `host` and `path` name; labels: doc_id, quality (0 or 1). A null host or
    path is a site of its own. Null and empty texts are scored by their zero statistics. An empty table gives none.
    """
    weights, intercept = fit_classifier(docs, labels)
    evidence = F.lit(intercept)
    for k, c in _inputs().items():
        evidence = evidence + weights[k] * c
    scored = with_text_stats(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", host.alias("host"), path.alias("path")))
    own = F.least(F.greatest(1 / (1 + F.exp(-F.least(F.greatest(evidence, F.lit(-30.0)), F.lit(30.0)))), F.lit(_EDGE)), F.lit(1 - _EDGE))
    scored = materialize(scored.select("doc_id", "host", "path", own.alias("own")), "site-evidence")

    paths = materialize(scored.groupBy("host", "path").agg(F.sum("own").alias("path_sum"), F.count("*").alias("path_n")), "site-paths")
    hosts = paths.groupBy("host").agg(F.sum("path_sum").alias("host_sum"), F.sum("path_n").alias("host_n"))
    overall = hosts.agg((F.sum("host_sum") / F.sum("host_n")).alias("prior"))
    hosts = hosts.crossJoin(F.broadcast(overall))  # one row
    strength = hosts.agg(_strength(F.col("host_n"), F.col("host_sum") / F.col("host_n"), F.col("prior")).alias("host_strength"))
    hosts = hosts.crossJoin(F.broadcast(strength))
    shrunk = (F.col("host_sum") + F.col("host_strength") * F.col("prior")) / (F.col("host_n") + F.col("host_strength"))
    sites = paths.withColumnRenamed("host", "h").join(hosts, F.col("h").eqNullSafe(F.col("host"))).drop("h").withColumn("host_prior", shrunk)
    strength = sites.agg(_strength(F.col("path_n"), F.col("path_sum") / F.col("path_n"), F.col("host_prior")).alias("path_strength"))
    sites = materialize(sites.crossJoin(F.broadcast(strength)).withColumnsRenamed({"host": "_h", "path": "_p"}), "sites")

    joined = scored.join(sized_broadcast(sites, BROADCAST_ROWS), F.col("host").eqNullSafe(F.col("_h")) & F.col("path").eqNullSafe(F.col("_p")))
    host_mean = (F.col("host_sum") - F.col("own") + F.col("host_strength") * F.col("prior")) / (F.col("host_n") - 1 + F.col("host_strength"))
    joined = joined.withColumn("host_mean", host_mean)
    path_mean = (F.col("path_sum") - F.col("own") + F.col("path_strength") * F.col("host_mean")) / (F.col("path_n") - 1 + F.col("path_strength"))
    joined = joined.withColumn("path_mean", path_mean)
    odds = _logit(F.col("own")) + _logit(F.col("path_mean")) - _logit(F.col("prior"))
    score = 1 / (1 + F.exp(-odds))
    return joined.select("doc_id", "host", "path", "own", "host_mean", "path_mean", score.alias("score"), (score >= threshold).alias("kept"))
