import math
import random

import numpy as np
import pytest

from casegrain.operators import significance as sig
from casegrain.operators.term_statistics import chi_square_terms, log_odds_terms


def test_mcnemar_counts_and_p_values(spark):
    rows = [("few", "a", "a", "b")] * 9 + [("few", "a", "c", "a")] * 2 + [("few", "a", "a", "a"), ("few", None, "a", "a")]
    rows += [("many", "a", "a", None)] * 40 + [("many", "a", "b", "a")] * 20 + [("none", "a", "b", "c")]
    df = spark.createDataFrame(rows, "g string, truth string, one string, other string")
    got = {r["g"]: r for r in sig.mcnemar(df, "truth", "one", "other", ["g"]).collect()}
    few, many, none = got["few"], got["many"], got["none"]
    assert tuple(few)[1:5] == (1, 9, 2, 0) and tuple(many)[1:5] == (0, 40, 20, 0) and tuple(none)[1:5] == (0, 0, 0, 1)
    assert few["statistic"] == pytest.approx(36 / 11) and none["statistic"] is None and none["p_value"] == 1.0
    assert few["p_value"] == pytest.approx(2 * (1 + 11 + 55) / 2**11)
    assert many["statistic"] == pytest.approx(19**2 / 60)
    # The chi-square tail by numeric integration of its density.
    x = np.linspace(math.sqrt(many["statistic"]), 40, 400_001)
    assert many["p_value"] == pytest.approx(2 * np.trapezoid(np.exp(-x * x / 2) / math.sqrt(2 * math.pi), x), rel=1e-6)


def test_bootstrap_does_not_depend_on_the_partitioning(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "b", None]), rng.random()) for i in range(800)] + [(900, "a", None)]
    df = spark.createDataFrame(rows, "id long, g string, x double")
    run = lambda d: sorted(
        ((r["g"] or "", r["n"], *(round(r[c], 9) for c in ("mean", "low", "high")))
         for r in sig.bootstrap_means(d, "id", "x", "g").collect()))
    one, other = run(df.repartition(1)), run(df.repartition(7, "x"))
    assert one == other
    for g, n, mean, low, high in one:
        values = [x for _, h, x in rows if (h or "") == g and x is not None]
        spread = np.std(values) / math.sqrt(n)
        assert n == len(values) and mean == pytest.approx(np.mean(values))
        assert low < mean < high
        # As wide as the normal interval, but for what 200 replicates leave to chance.
        assert 0.75 < (high - low) / (2 * 1.96 * spread) < 1.3
    assert sig.bootstrap_means(df.limit(0), "id", "x", "g").where("n > 0").count() == 0


def test_weights_are_poisson():
    bounds = sig.poisson_bounds()
    hashes = np.random.default_rng(1).integers(0, 2**28, 4000)
    weights = np.concatenate([
        np.searchsorted(bounds, (hashes * a + b) % sig.PRIME, side="right") for a, b in sig.replicate_factors(50)])
    for k in range(4):
        assert (weights == k).mean() == pytest.approx(math.exp(-1) / math.factorial(k), abs=0.01)


DOCS = [("x", "wire bank wire"), ("x", "wire card"), ("y", "parcel bank"), ("y", "parcel order parcel"), (None, ""), ("z", "")]


def by_hand():
    counts = {}
    for label, text in DOCS:
        words = text.split()
        for term in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]:
            counts.setdefault(label, {}).setdefault(term, 0)
            counts[label][term] += 1
    return counts


def test_log_odds_by_hand(spark):
    df = spark.createDataFrame(DOCS, "l string, t string")
    got = {(r["l"], r["term"]): r for r in log_odds_terms(df, "l", "t", n=50, prior=10.0, least=1, stop_words=()).collect()}
    counts = by_hand()
    total = sum(sum(c.values()) for c in counts.values())
    assert set(got) == {(label, term) for label, c in counts.items() for term in c}
    for (label, term), row in got.items():
        whole = sum(c.get(term, 0) for c in counts.values())
        share = 10.0 * whole / total
        own, n = counts[label][term], sum(counts[label].values())
        one, other = own + share, whole - own + share
        odds = math.log(one / (n + 10 - one)) - math.log(other / (total - n + 10 - other))
        assert row["log_odds"] == pytest.approx(odds, abs=1e-6)
        assert row["z"] == pytest.approx(odds / math.sqrt(1 / one + 1 / other), abs=2e-6)


def test_chi_square_by_hand(spark):
    df = spark.createDataFrame(DOCS, "l string, t string")
    rows = chi_square_terms(df, "l", "t", n=50, least=1, stop_words=()).collect()
    has = [(label, set(t.split()) | {" ".join(p) for p in zip(t.split(), t.split()[1:])}) for label, t in DOCS]
    expected = {}
    for label in {x for x, _ in has}:
        for term in set().union(*(t for _, t in has)):
            a, b = (sum((x == label) == side and term in t for x, t in has) for side in (True, False))
            c, d = (sum((x == label) == side and term not in t for x, t in has) for side in (True, False))
            if a and a * d > b * c:
                expected[label, term] = len(has) * (a * d - b * c) ** 2 / ((a + b) * (c + d) * (a + c) * (b + d))
    assert {(r["l"], r["term"]): pytest.approx(r["chi_square"], abs=1e-6) for r in rows} == expected
    assert sorted({r["rank"] for r in rows if r["l"] == "x"}) == list(range(1, 1 + sum(k[0] == "x" for k in expected)))
