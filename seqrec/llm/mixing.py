"""Soft-membership mixing: document rates that bring expected domain totals to target weights.

A multinomial logistic classifier, fitted on a labelled table, gives each document a posterior over the domains.  Nonnegative
rates, starting from one copy of every document, are then moved by projected gradient steps on the squared difference
between expected domain token totals and their targets, scaled by the domains' Gram matrix.  A step needs a few
sums per domain over all documents; a rate depends only on the document's posterior and the steps so far.  Where documents
can only be left out (subset_rates), rates end at 1 and the total is free.  DataFrame and ML transformers of the JVM only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqrec.session import cut

SPACE = r"[\x20\x09-\x0D]+"
DENSE = ("mean_length", "symbols", "shouts", "separators", "capitals", "repeats", "log_words")


@dataclass(frozen=True)
class Classifier:
    """Domains in order; the fitted model, or shares where only one domain was seen; what corrects the model's posteriors, if asked for."""

    domains: tuple[str, ...]
    model: PipelineModel | None
    shares: tuple[float, ...]
    calibration: LogisticRegressionModel | None = None


def _logs(scored: DataFrame) -> DataFrame:
    """Adds `_x2`, the logarithms of the posteriors."""
    return scored.withColumn("_x2", array_to_vector(F.transform(vector_to_array("probability"), lambda p: F.log(F.greatest(p, F.lit(1e-9))))))


def _features(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with n_tokens, the distinct words `_tokens` and dense columns, without the text."""
    text, n = F.coalesce(F.col("_text"), F.lit("")), F.col("_n")
    without = lambda mark: ((F.length(text) - F.length(F.replace(text, F.lit(mark)))) / len(mark)).cast("double")
    out = docs.withColumn("_text", F.col(text_col).cast("string")).withColumn("_words", F.filter(F.split(text, SPACE), lambda w: w != ""))
    out = out.withColumn("_tokens", F.array_distinct("_words")).withColumn("n_tokens", F.size("_words").cast("bigint"))
    out = out.withColumn("_n", F.greatest(F.col("n_tokens"), F.lit(1)).cast("double"))
    return out.select(*[c for c in docs.columns if c != text_col], "n_tokens", "_tokens",
                      (F.least(F.length(text) / n, F.lit(40.0)) / 10).alias("mean_length"),
                      F.least((F.size(F.split(text, "[#*$%&<>]+", -1)) - 1) / n, F.lit(4.0)).alias("symbols"),
                      F.least(without("!!") / n, F.lit(1.0)).alias("shouts"),
                      F.least(without("|") / n, F.lit(1.0)).alias("separators"),
                      (F.size(F.filter("_tokens", lambda w: w.rlike(r"^\p{Lu}{2}"))) / n).alias("capitals"),
                      (1 - F.size("_tokens") / n).alias("repeats"), F.log1p(n).alias("log_words"))


def fit_classifier(labelled: DataFrame, text_col: str = "text", domain_col: str = "domain", key_col: str = "doc_id",
                   sample: int = 20_000, hashed: int = 4096, strength: float = 0.01, seed: int = 13, calibrate: bool = False) -> Classifier:
    """Learns domains from at most about `sample` labelled rows, taken by the hash of key_col.

    calibrate: a quarter of them, by the hash of their words, is held out and a second multinomial model of the logarithms of the
    posteriors is fitted on it, unless a domain is missing there or in the rest.
    Rows with a null text or domain are left out.  Without rows there are no domains.
    """
    rows = labelled.select(F.col(key_col).alias("_key"), F.col(text_col).cast("string").alias("text"), F.col(domain_col).cast("string").alias("domain")).where("text is not null and domain is not null")
    n = rows.count()
    key = F.coalesce(F.pmod(F.xxhash64("_key", F.lit(seed)), F.lit(1_000_000_000)), F.lit(0))
    rows = rows.where(key < int(1_000_000_000 * min(1.0, sample / max(1, n))))
    rows = cut(_features(rows.select("text", "domain"), "text"), "labelled")
    seen = sorted((r["domain"], r["n"]) for r in rows.groupBy("domain").agg(F.count("*").alias("n")).collect())
    domains, total = tuple(d for d, _ in seen), sum(m for _, m in seen)
    shares = tuple(m / total for _, m in seen)
    if len(domains) < 2:
        return Classifier(domains, None, shares)
    label = F.create_map(*[x for k, d in enumerate(domains) for x in (F.lit(d), F.lit(float(k)))])[F.col("domain")]
    labels = rows.withColumn("_y", label).withColumn("_held", F.pmod(F.xxhash64("_tokens", F.lit(seed)), F.lit(4)) == 0)
    if calibrate:
        calibrate = [r["n"] for r in labels.groupBy("_held").agg(F.countDistinct("_y").alias("n")).collect()] == [len(domains)] * 2
    model = Pipeline(stages=[
        HashingTF(inputCol="_tokens", outputCol="_hashed", numFeatures=hashed, binary=True),
        VectorAssembler(inputCols=["_hashed", *DENSE], outputCol="_x"),
        LogisticRegression(featuresCol="_x", labelCol="_y", family="multinomial", maxIter=30, regParam=strength, elasticNetParam=0.0),
    ]).fit(labels.where(~F.col("_held")) if calibrate else labels)
    if not calibrate:
        return Classifier(domains, model, shares)
    second = LogisticRegression(featuresCol="_x2", labelCol="_y", probabilityCol="_p2", rawPredictionCol="_r2", predictionCol="_d2",
                                family="multinomial", maxIter=50, regParam=1e-4, elasticNetParam=0.0)
    return Classifier(domains, model, shares, second.fit(_logs(model.transform(labels.where("_held"))).select("_x2", "_y")))


def posteriors(docs: DataFrame, classifier: Classifier, text_col: str = "text") -> DataFrame:
    """docs without the text, with n_tokens (words) and `posterior`, an array in the order of the domains."""
    rest = [c for c in docs.columns if c not in (text_col, "n_tokens", "posterior")]
    packed = _features(docs.select(F.struct(*rest).alias("_row"), F.col(text_col).alias("_in")), "_in")
    if classifier.model is None:
        return packed.select("_row.*", "n_tokens", F.array(*map(F.lit, classifier.shares)).cast("array<double>").alias("posterior"))
    scored, name = classifier.model.transform(packed), "probability"
    if classifier.calibration is not None:
        scored, name = classifier.calibration.transform(_logs(scored)), "_p2"
    return scored.select("_row.*", "n_tokens", vector_to_array(name).alias("posterior"))


def _rate(domains: int, steps: list[list[float]], most: float | None = None) -> Column:
    """A document's rate after the steps: max(0, rate - posterior . step), and at most `most`, again and again, from `_from`."""
    rate = F.col("_from")
    for step in steps:
        rate = F.greatest(F.lit(0.0), rate - sum((F.col(f"_p{k}") * F.lit(float(step[k])) for k in range(domains)), F.lit(0.0)))
        rate = rate if most is None else F.least(F.lit(most), rate)
    return rate


def rates(docs: DataFrame, domains: tuple[str, ...], weights: dict[str, float], most_steps: int = 60, tolerance: float = 1e-5) -> DataFrame:
    """docs (n_tokens, posterior) with `rate`, its expected copies; the total number of tokens stays what it is.

    weights: the share of the tokens wanted for each domain, scaled to sum to 1; domains that are not named get 0.  A step is
    scaled by the inverse of the domains' Gram matrix over the documents whose rate is above 0, which would end in one
    step if no rate met 0; a step that does not bring the totals closer is followed by one of plain gradient length.  Steps
    end when every domain's expected total is within `tolerance` of the total of its target, or after most_steps.  Without domains
    or tokens every rate is 1.  A document without tokens takes the rate of its posterior.
    """
    k = len(domains)
    total = docs.agg(F.sum("n_tokens").alias("n")).head()["n"] or 0
    scale = sum(max(0.0, weights.get(d, 0.0)) for d in domains)
    if not k or not total or not scale:
        return docs.withColumn("rate", F.lit(1.0))
    wanted = np.array([max(0.0, weights.get(d, 0.0)) / scale for d in domains])
    table = docs.select("*", *[F.col("posterior")[j].alias(f"_p{j}") for j in range(k)], F.lit(1.0).alias("_from"))
    steps: list[list[float]] = []

    def totals() -> tuple[np.ndarray, np.ndarray]:
        """Each domain's expected share of all tokens, and the Gram matrix of the documents that are not at 0."""
        now = table.select(*[F.col(f"_p{j}") for j in range(k)], (F.col("n_tokens") / F.lit(float(total))).alias("_w"), _rate(k, steps).alias("_r"))
        gram = [F.sum(F.when(F.col("_r") > 0, F.col("_w") * F.col(f"_p{i}") * F.col(f"_p{j}")).otherwise(0.0)).alias(f"g{i}_{j}") for i in range(k) for j in range(k)]
        row = now.agg(*[F.sum(F.col("_w") * F.col("_r") * F.col(f"_p{j}")).alias(f"h{j}") for j in range(k)], *gram).head()
        return np.array([row[f"h{j}"] for j in range(k)]), np.array([[row[f"g{i}_{j}"] for j in range(k)] for i in range(k)])

    have, gram = totals()
    share, far, plain = np.maximum(have, 1e-12), np.inf, False
    for done in range(most_steps):
        gap = have - wanted
        now = float(np.abs(gap).max())
        if now <= tolerance:
            break
        plain = not plain and now >= far
        far = now
        if plain:
            steps.append((gap / share / (gram / np.sqrt(np.outer(share, share))).sum(1).max().clip(1e-12)).tolist())
        else:
            steps.append(np.linalg.lstsq(gram + 1e-9 * np.trace(gram) * np.eye(k), gap, rcond=None)[0].tolist())
        if len(steps) == 20:
            table = cut(table.withColumn("_from", _rate(k, steps)), "rates")
            steps = []
        have, gram = totals()
    return table.select(*docs.columns, _rate(k, steps).alias("rate"))


def subset_rates(docs: DataFrame, domains: tuple[str, ...], weights: dict[str, float], most_steps: int = 30, tolerance: float = 1e-4) -> DataFrame:
    """docs (n_tokens, posterior) with `rate` between 0 and 1, for a selection without copies.

    The wanted total is the largest of which every domain with a weight has its share in docs, so documents of the scarcest domain
    stay.  Each step is scaled by the inverse of the Gram matrix over the documents that can move (above 0, and below 1 unless the
    step lowers them).  A step that does not bring the expected totals closer, in squares by the domains' shares, is taken back for a
    plain gradient step, short enough always to bring them closer.  Steps end when every total is within `tolerance` of all tokens, when a
    plain step gains less than a hundredth, or after most_steps; a gap is left where a domain's mass lies in documents that others need,
    and gaps() returns it.  Without domains, tokens or weights every rate is 1.
    """
    k = len(domains)
    total = docs.agg(F.sum("n_tokens").alias("n")).head()["n"] or 0
    scale = sum(max(0.0, weights.get(d, 0.0)) for d in domains)
    if not k or not total or not scale:
        return docs.withColumn("rate", F.lit(1.0))
    wanted = np.array([max(0.0, weights.get(d, 0.0)) / scale for d in domains])
    parts = [F.col(f"_p{j}") for j in range(k)]
    table = docs.select("*", *[F.col("posterior")[j].alias(f"_p{j}") for j in range(k)], F.lit(1.0).alias("_from"))

    def totals(steps: list[list[float]], gap: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Each domain's expected share of all tokens, and the Gram matrix of the documents a step against `gap` can move (all for None)."""
        now = table.select(*parts, (F.col("n_tokens") / F.lit(float(total))).alias("_w"), _rate(k, steps, 1.0).alias("_r"))
        lowers = F.lit(True) if gap is None else sum((p * F.lit(float(g)) for p, g in zip(parts, gap)), F.lit(0.0)) > 0
        free = F.lit(True) if gap is None else F.when(lowers, F.col("_r") > 0).otherwise(F.col("_r") < 1)
        gram = [F.sum(F.when(free, F.col("_w") * parts[i] * parts[j]).otherwise(0.0)).alias(f"g{i}_{j}") for i in range(k) for j in range(k)]
        row = now.agg(*[F.sum(F.col("_w") * F.col("_r") * parts[j]).alias(f"h{j}") for j in range(k)], *gram).head()
        return np.array([row[f"h{j}"] for j in range(k)]), np.array([[row[f"g{i}_{j}"] for j in range(k)] for i in range(k)])

    have, every = totals([], None)
    wanted = wanted * min(have[j] / wanted[j] for j in range(k) if wanted[j] > 0)
    share = np.maximum(have, 1e-12)
    longest = float((every / np.sqrt(np.outer(share, share))).sum(1).max()) or 1.0
    steps: list[list[float]] = []
    gap, gram = have - wanted, every
    for _ in range(most_steps):
        far = float((gap * gap / share).sum())
        if float(np.abs(gap).max()) <= tolerance:
            break
        for plain in (False, True):
            step = gap / share / longest if plain else np.linalg.lstsq(gram + 1e-9 * np.trace(gram) * np.eye(k), gap, rcond=None)[0]
            have, following = totals([*steps, step.tolist()], gap)
            left = float(((have - wanted) ** 2 / share).sum())
            if left < 0.99 * far:
                break
        else:
            break
        steps, gap, gram = [*steps, step.tolist()], have - wanted, following
        if len(steps) == 10:
            table, steps = cut(table.withColumn("_from", _rate(k, steps, 1.0)), "rates"), []
    return table.select(*docs.columns, _rate(k, steps, 1.0).alias("rate"))


def gaps(rated: DataFrame, domains: tuple[str, ...], weights: dict[str, float]) -> DataFrame:
    """(domain, target, share, gap): the wanted and the expected share of the rated tokens, and the second less the first, per domain.

    Null shares if nothing is rated above 0; no rows without domains.
    """
    scale = sum(max(0.0, weights.get(d, 0.0)) for d in domains) or 1.0
    mass = F.col("n_tokens") * F.col("rate")
    sums = rated.agg(*[F.sum(mass * F.col("posterior")[j]).alias(f"_h{j}") for j in range(len(domains))], F.sum(mass).alias("_all"))
    rows = F.array(*[F.struct(F.lit(d).alias("domain"), F.lit(max(0.0, weights.get(d, 0.0)) / scale).alias("target"), F.try_divide(f"_h{j}", "_all").alias("share"))
                     for j, d in enumerate(domains)]).cast("array<struct<domain:string,target:double,share:double>>")
    return sums.select(F.inline(rows)).withColumn("gap", F.col("share") - F.col("target"))


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], text_col: str = "text", subset: bool = False, **options) -> dict:
    """{"rates": docs without the text, with n_tokens, posterior and rate; "domains": their order in posterior}.

    labelled: (doc_id, text, domain).  subset: rates of at most 1, by subset_rates.  Null texts count as empty; columns named n_tokens, posterior or rate are replaced.
    """
    classifier = fit_classifier(labelled, **options)
    docs = docs.drop("rate")
    table = cut(posteriors(docs, classifier, text_col), "posteriors")
    return {"rates": (subset_rates if subset else rates)(table, classifier.domains, weights), "domains": classifier.domains}
