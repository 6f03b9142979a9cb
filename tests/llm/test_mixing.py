"""Mixing: rates against a plain projected gradient, targets reached, awkward rows."""

import random

import cases
import numpy as np

from seqrec.llm import mixing


def plain(n, p, wanted, steps=60):
    """The same steps, document by document in numpy."""
    mass = n[:, None] * p / n.sum()
    x, far, short = np.ones(len(n)), np.inf, False
    share = np.maximum(mass.sum(0), 1e-12)
    for _ in range(steps):
        gap = mass.T @ x - wanted
        gram = mass[x > 0].T @ p[x > 0]
        now = np.abs(gap).max()
        if now <= 1e-5:
            break
        short = not short and now >= far
        far = now
        if short:
            step = gap / share / (gram / np.sqrt(np.outer(share, share))).sum(1).max()
        else:
            step = np.linalg.solve(gram + 1e-9 * np.trace(gram) * np.eye(len(gap)), gap)
        x = np.maximum(0, x - p @ step)
    return x


def plain_subset(n, p, wanted, most=30):
    """The steps with rates of at most 1, document by document in numpy."""
    mass = n[:, None] * p / n.sum()
    x = np.ones(len(n))
    share = np.maximum(mass.sum(0), 1e-12)
    wanted = wanted * min(h / w for h, w in zip(mass.sum(0), wanted) if w > 0)
    gram = mass.T @ p
    longest = (gram / np.sqrt(np.outer(share, share))).sum(1).max()
    for _ in range(most):
        gap = mass.T @ x - wanted
        if np.abs(gap).max() <= 1e-4:
            break
        newton = np.linalg.lstsq(gram + 1e-9 * np.trace(gram) * np.eye(len(gap)), gap, rcond=None)[0]
        for step in (newton, gap / share / longest):
            y = np.clip(x - p @ step, 0, 1)
            if ((mass.T @ y - wanted) ** 2 / share).sum() < 0.99 * (gap ** 2 / share).sum():
                break
        else:
            break
        x, free = y, np.where(p @ gap > 0, y > 0, y < 1)
        gram = mass[free].T @ p[free]
    return x


def test_rates_equal_plain_steps_and_reach_the_targets(spark):
    rng = np.random.default_rng(2)
    p = rng.dirichlet([0.4, 0.3, 0.3], 300)
    n = rng.integers(1, 500, 300)
    wanted = np.array([0.8, 0.15, 0.05])
    df = spark.createDataFrame([(k, int(n[k]), p[k].tolist()) for k in range(300)], "doc_id bigint, n_tokens bigint, posterior array<double>").repartition(4)
    got = {r["doc_id"]: r["rate"] for r in mixing.rates(df, ("a", "b", "c"), {"a": 0.8, "b": 0.15, "c": 0.05}, most_steps=12).collect()}
    x = np.array([got[k] for k in range(300)])
    assert (x >= 0).all() and (x == 0).any()
    assert np.allclose(x, plain(n, p, wanted, steps=12), atol=1e-6)
    full = {r["doc_id"]: r["rate"] for r in mixing.rates(df, ("a", "b", "c"), {"a": 0.5, "b": 0.25, "c": 0.25}).collect()}
    have = (n * np.array([full[k] for k in range(300)])) @ p / n.sum()
    assert np.abs(have - np.array([0.5, 0.25, 0.25])).max() < 1e-4


def test_subset_rates_reach_the_shares_by_label(spark):
    """With rates of at most 1 the kept tokens of each label, not only the expected ones, come near the targets, and the scarce domain stays."""
    rng = np.random.default_rng(4)
    domains, weights = ("good", "low", "toxic"), {"good": 0.94, "low": 0.04, "toxic": 0.02}
    p = 0.96 * np.eye(3)[rng.choice(3, 3000, p=[0.76, 0.13, 0.11])] + 0.04 * rng.dirichlet([2.0, 0.3, 0.1], 3000)
    label = (p.cumsum(1) < rng.random(3000)[:, None]).sum(1).clip(0, 2)
    n = rng.integers(50, 500, 3000)
    df = spark.createDataFrame([(k, int(n[k]), p[k].tolist()) for k in range(3000)], "doc_id bigint, n_tokens bigint, posterior array<double>").repartition(4)
    rated = mixing.subset_rates(df, domains, weights)
    got = {r["doc_id"]: r["rate"] for r in rated.collect()}
    x = np.array([got[k] for k in range(3000)])
    assert x.min() >= 0 and x.max() <= 1
    assert np.allclose(x, plain_subset(n, p, np.array([0.94, 0.04, 0.02])), atol=1e-4)
    kept = np.bincount(label, n * x) / (n * x).sum()
    assert abs(kept[1] - 0.04) < 0.01 and abs(kept[2] - 0.02) < 0.005
    assert x[label == 0].mean() > 0.99
    left = {r["domain"]: r for r in mixing.gaps(rated, domains, weights).collect()}
    share = (n * x) @ p / (n * x).sum()
    assert all(abs(left[d]["share"] - share[j]) < 1e-9 and abs(left[d]["gap"] - (share[j] - weights[d])) < 1e-9 for j, d in enumerate(domains))
    none = mixing.gaps(rated.where("false"), domains, weights).collect()
    assert len(none) == 3 and all(r["share"] is None for r in none)
    assert mixing.gaps(rated, (), weights).count() == 0


def rows(n):
    rng = random.Random(6)
    out = []
    for k in range(n):
        kind = rng.choice(["good", "good", "good", "loud"])
        text = cases.prose(k, rng.randrange(30, 90))
        out.append((k, text if kind == "good" else " ".join(w.upper() + "!!" for w in text.split()), kind))
    return out


def test_classifier_and_mix(spark):
    data = rows(300)
    docs = spark.createDataFrame(data, "doc_id bigint, text string, domain string")
    made = mixing.mix(docs, docs.where("doc_id % 3 > 0"), {"good": 0.95, "loud": 0.05})
    got = {r["doc_id"]: r for r in made["rates"].collect()}
    assert made["domains"] == ("good", "loud") and len(got) == len(data)
    right = [(got[i]["posterior"][0] > 0.5) == (kind == "good") for i, _, kind in data if i % 3 == 0]
    assert sum(right) >= 0.97 * len(right)
    assert all(got[i]["n_tokens"] == len(cases.words(t)) for i, t, _ in data)
    total = sum(r["n_tokens"] for r in got.values())
    assert abs(sum(r["n_tokens"] * r["rate"] * r["posterior"][1] for r in got.values()) / total - 0.05) < 2e-3
    assert sum(got[i]["rate"] >= 1 for i, _, kind in data if kind == "good") >= 0.95 * sum(kind == "good" for *_, kind in data)


def test_calibrated_posteriors_sum_to_the_domains(spark):
    """Labels that a fifth of the rows have by chance: on rows not learned from the posteriors add up to what is there."""
    rng = random.Random(8)
    data = [(k, t, d if rng.random() < 0.8 else rng.choice(["good", "loud"])) for k, t, d in rows(600)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, domain string")
    made = mixing.mix(docs, docs.where("doc_id % 2 = 0"), {"good": 0.9, "loud": 0.1}, subset=True, calibrate=True)
    got = {r["doc_id"]: r for r in made["rates"].collect()}
    new = [(got[i]["posterior"][1], d == "loud") for i, _, d in data if i % 2]
    assert abs(sum(p for p, _ in new) - sum(y for _, y in new)) < 0.06 * len(new)
    assert all(0 <= r["rate"] <= 1 for r in got.values())


def test_awkward_rows(spark):
    docs = cases.frame(spark, cases.awkward())
    labelled = docs.select("doc_id", "text", docs["source"].alias("domain"))
    for some in (docs, docs.where("false")):
        for known in (labelled, labelled.where("false")):
            got = mixing.mix(some, known, {"src0": 1.0})["rates"].collect()
            assert len(got) == some.count() and all(r["rate"] >= 0 for r in got)
            got = mixing.mix(some, known, {"src0": 1.0}, subset=True, calibrate=True)["rates"].collect()
            assert len(got) == some.count() and all(0 <= r["rate"] <= 1 for r in got)
    two = docs.selectExpr("doc_id", "text", "if(doc_id < 8, 'a', 'b') domain")
    got = mixing.mix(docs, two, {"a": 0.5, "b": 0.5})["rates"].collect()
    assert len(got) == docs.count() and all(np.isfinite(r["rate"]) for r in got)
    assert all(r["rate"] == 1 for r in mixing.mix(docs, two, {})["rates"].collect())
