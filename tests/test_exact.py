"""Exact quantiles, ranks and distinct counts against plain sorting, on outliers, ties, nulls and one hot group."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.operators import exact
from tidemark.operators.exact import distinct_counts, exact_quantiles, true_ranks

SHARES = (0.0, 0.1, 0.5, 0.95, 0.99, 1.0)


def groups():
    rnd = random.Random(3)
    out = defaultdict(list)
    out["hot"] = [rnd.gauss(0, 1) for _ in range(900)] + [1e300, -1e300]
    out["ties"] = [1.5] * 400 + [2.5] * 3
    out["one"] = [7.0]
    out[None] = [math.exp(rnd.uniform(-40, 40)) for _ in range(200)]
    out["none"] = [None, float("nan")]
    return out


@pytest.mark.parametrize("brackets", [2, 1024])
@pytest.mark.parametrize("passes", [0, 1, 4])
def test_quantiles_are_exact(spark, monkeypatch, brackets, passes):
    monkeypatch.setattr(exact, "BRACKETS", brackets)
    rows = [(g, v) for g, values in groups().items() for v in values]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    got = {(r.g, r.share): r.quantile for r in exact_quantiles(df, ["g"], "v", SHARES, passes).collect()}
    want = {}
    for g, values in groups().items():
        own = sorted(v for v in values if v is not None and v == v)
        want.update({(g, s): own[max(1, math.ceil(len(own) * s - 1e-9)) - 1] for s in SHARES if own})
    assert got == want


def test_ranks_and_counts(spark):
    rows = [(g, v) for g, values in groups().items() for v in values]
    df = spark.createDataFrame(rows, "g string, v double")
    estimates = spark.createDataFrame([("ties", 0.5, 1.5), ("ties", 0.9, 2.0), (None, 0.5, 0.0)], "g string, share double, estimate double")
    got = {(r.g, r.share): (r.below, r.upto) for r in true_ranks(df, ["g"], "v", estimates).collect()}
    assert got == {("ties", 0.5): (0.0, 400 / 403), ("ties", 0.9): (400 / 403, 400 / 403), (None, 0.5): (0.0, 0.0)}
    counts = {r.g: r.n for r in distinct_counts(df, ["g"], "v").collect()}
    assert counts == {"hot": 902, "ties": 2, "one": 1, None: 200, "none": 1}
    assert exact_quantiles(df.where(F.lit(False)), ["g"], "v", SHARES).count() == 0
