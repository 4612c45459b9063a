"""Quality classifier: document evidence combined with host and path posteriors by hierarchical empirical Bayes."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drift_engine.llm.common import materialise, small, small_batches, source_key

#: Bound on the labelled rows that the document classifier is fitted on.
MOST_EXAMPLES = 6000
SEED = 2
#: A document is rejected below this posterior probability of good quality.
THRESHOLD = 0.3
RIDGE = 1.0
#: Sites' pseudo-counts are kept in this range.
LEAST_COUNT, MOST_COUNT = 1.0, 1e6

_CLASSES = (
    bytes(range(97, 123)),
    bytes(range(65, 91)),
    bytes(range(48, 58)),
    b"#*$%&|<>",
    b"!?",
    b".,;:",
    b"|",
    b"\n",
)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that nothing is learnt from: crc32 of the id as text is 1 modulo 3."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def features(text: str) -> list[float]:
    """Measures of a whole text that do not depend on what it is about."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * WIDTH
    size = len(raw)
    shares = [(size - len(raw.translate(None, c))) / size for c in _CLASSES]
    counts = Counter(words)
    top = counts.most_common(3)
    doubled = sum(a == b for a, b in zip(words, words[1:])) / n
    pairs = Counter(zip(words, words[1:]))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    kinds = len(set(lines))
    lengths = [len(w) for w in words[:1]] and np.fromiter(map(len, words), np.float64, n)
    ends = Counter(w[-1:] for w in words)
    marked = max(ends[b"!"], ends[b"*"], ends[b"%"], ends[b"$"], ends[b"&"], ends[b"#"]) / n
    alone = sum(len(w) == 1 and not w.isalnum() for w in words) / n
    out = [
        *shares,
        np.log1p(n),
        min(n, 60) / 60,
        len(counts) / n,
        np.log(len(counts) + 1) / np.log(n + 1.5),
        top[0][1] / n,
        sum(c for _, c in top) / n,
        doubled,
        1 - len(pairs) / max(1, n - 1),
        (len(lines) - kinds) / max(1, len(lines)),
        np.log1p(n / max(1, len(lines))),
        float(lengths.mean()) / 10,
        float(lengths.std()) / 10,
        marked,
        alone,
        sum(w[:1].isupper() for w in words) / n,
    ]
    return [*out, shares[1] ** 0.5, shares[3] ** 0.5, doubled**0.5, out[15] ** 0.5]


WIDTH = len(_CLASSES) + 15 + 4


@dataclass
class Classifier:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last is the intercept

    def log_odds(self, rows: np.ndarray) -> np.ndarray:
        return np.clip((rows - self.mean) / self.scale @ self.weights[:-1] + self.weights[-1], -12, 12)


def fit_logistic(rows: np.ndarray, labels: np.ndarray, ridge: float = RIDGE) -> Classifier:
    """Ridge logistic regression by Newton steps. Without both labels: the smoothed share of label 1 for all."""
    mean = rows.mean(0) if len(rows) else np.zeros(WIDTH)
    scale = rows.std(0) + 1e-9 if len(rows) else np.ones(WIDTH)
    weights = np.zeros(WIDTH + 1)
    weights[-1] = np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1))
    if len(set(labels.tolist())) == 2:
        x = np.concatenate([(rows - mean) / scale, np.ones((len(rows), 1))], 1)
        penalty = np.full(WIDTH + 1, ridge)
        penalty[-1] = 1e-6
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - labels) + penalty * weights)
            weights -= step
            if np.abs(step).max() < 1e-6:
                break
    return Classifier(mean, scale, weights)


def _feature_rows(batches):
    for batch in batches:
        rows = [features(t.as_py() or "") for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["label", "x"])


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_EXAMPLES, seed: int = SEED) -> Classifier:
    """The document classifier, of at most `most` labelled rows that are not held out, chosen by a hash of doc_id."""
    small_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)").filter(~held_out())
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"))
    chosen = F.broadcast(known.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(most))  # two numbers a row
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = texts.join(chosen, "doc_id").dropDuplicates(["doc_id"]).select("label", "text").mapInArrow(_feature_rows, "label int, x array<double>").collect()
    rows = sorted((r["label"], r["x"]) for r in rows)  # the same sums on every run
    return fit_logistic(np.array([x for _, x in rows]).reshape(-1, WIDTH), np.array([y for y, _ in rows], float))


def pseudo_count(sites: DataFrame, parent: Column) -> float:
    """How many documents the parent's rate weighs as for these sites, by the method of moments.

    sites: n and s (sum of probabilities) of each. The spread of site rates around the
    parent's, beyond what n draws give, is the variance of true rates; the smaller it
    is, the more a site is drawn to its parent. One aggregate.
    """
    rate = F.col("s") / F.col("n")
    r = sites.filter("n > 1").agg(F.sum(F.col("n") * (rate - parent) ** 2).alias("spread"), F.sum(parent * (1 - parent)).alias("noise"), F.sum((F.col("n") - 1) * parent * (1 - parent)).alias("room")).first()
    if not r["room"]:
        return MOST_COUNT
    ratio = max(0.0, (r["spread"] - r["noise"]) / r["room"])
    return float(min(MOST_COUNT, max(LEAST_COUNT, (1 - ratio) / ratio))) if ratio > 0 else MOST_COUNT


def log_odds(model: Classifier, text: Column) -> Column:
    """The classifier's log odds of good quality, from the text alone."""

    @F.arrow_udf(T.DoubleType())
    def judge(texts: pa.Array) -> pa.Array:
        x = np.array([features(t.as_py() or "") for t in texts]).reshape(-1, WIDTH)
        return pa.array(model.log_odds(x), pa.float64())

    # Marked so that the optimiser never runs it a second time for a filter on what follows from it.
    return judge.asNondeterministic()(text.cast("string"))


@dataclass
class Rates:
    """Site sums (host, path, n, s, host_n, host_s), the global rate, and the pseudo-counts of host and path."""

    sites: DataFrame
    prior: float
    host_count: float
    path_count: float


def site_rates(rows: DataFrame) -> Rates:
    """From a table with host, path and odds. Probabilities are summed by path, then by host; partial sums come first."""
    p = 1 / (1 + F.exp(-F.col("odds")))
    paths = materialise(rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(p).alias("s")), "quality-paths")
    total = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    prior = (total["s"] + 0.5) / (total["n"] + 1) if total["n"] else 0.5
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    host_count = pseudo_count(hosts, F.lit(prior))
    drawn = ((F.col("s") + host_count * prior) / (F.col("n") + host_count)).alias("p_host")
    sites = materialise(paths.join(hosts.select("host", F.col("n").alias("host_n"), F.col("s").alias("host_s"), drawn), "host"), "quality-sites")
    return Rates(sites, prior, host_count, pseudo_count(sites, F.col("p_host")))


def with_posterior(rows: DataFrame, rates: Rates) -> DataFrame:
    """rows (host, path, odds) with p_document, p_host, p_path and posterior; each document is left out of its own site's sums."""
    sites = rates.sites.drop("p_host")
    p, a, b = F.col("p_document"), rates.host_count, rates.path_count
    out = rows.join(small(sites, sites.count()), ["host", "path"]).withColumn("p_document", 1 / (1 + F.exp(-F.col("odds"))))
    out = out.withColumn("p_host", (F.col("host_s") - p + a * rates.prior) / (F.col("host_n") - 1 + a))
    out = out.withColumn("p_path", (F.col("s") - p + b * F.col("p_host")) / (F.col("n") - 1 + b))
    inside = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), F.col("p_path")))
    shift = F.log(inside / (1 - inside)) - float(np.log(rates.prior / (1 - rates.prior)))
    return out.withColumn("posterior", 1 / (1 + F.exp(-(F.col("odds") + shift)))).drop("n", "s", "host_n", "host_s")


def assess(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, model: Classifier | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """A row per document: doc_id, host, path, p_document, p_host, p_path, posterior, kept.

    p_document is the classifier's probability from the text alone. Probabilities are
    summed by host and by path within it (here source and lang; both over all documents,
    partial sums first, so a hot host costs no more). A host's rate is drawn to the global
    one and a path's to its host's, the more the fewer documents it has; each document is
    left out of its own site's rate. The posterior has the document's evidence with the
    path's odds in place of the global ones. kept: posterior at least the threshold.

    Null text: no evidence but the empty text's own features. Null host or path: a site of
    its own. host and path are keys like source_key()'s. Repeated rows are assessed alike.
    Empty tables give no rows; without labels the classifier gives every document one half.
    """
    model = model or fit(docs, labels)
    host = source_key("source") if host is None else host
    path = source_key("lang") if path is None else path
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), host.alias("host"), path.alias("path"), log_odds(model, F.col("text")).alias("odds"))
    rows = materialise(rows, "quality-odds")
    out = with_posterior(rows, site_rates(rows))
    named = lambda c: F.when(F.substring(c, 1, 1) == "0", F.substring(c, 2, 2**30)).alias(c)  # noqa: E731  the key's first letter only orders nulls last
    return out.select("doc_id", named("host"), named("path"), "p_document", "p_host", "p_path", "posterior", (F.col("posterior") >= threshold).alias("kept"))


def kept_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs' own columns and rows, without the rejected documents.

    Texts are read and measured a second time rather than shuffled: the first pass keeps
    two keys and a number a row, and only site sums are joined to the second.

    Rows as assess() keeps them, in every case named there: a null or empty text is
    assessed by the empty text's features, repeated rows alike, an empty table gives
    none. Extra columns stay, whatever their names.
    """
    model = fit(docs, labels)
    rows = docs.select(F.struct("*").alias("_doc"), source_key("source").alias("host"), source_key("lang").alias("path"), log_odds(model, F.col("text")).alias("odds"))
    rates = site_rates(materialise(rows.select("host", "path", "odds"), "quality-odds"))
    return with_posterior(rows, rates).filter(F.col("posterior") >= threshold).select("_doc.*")
