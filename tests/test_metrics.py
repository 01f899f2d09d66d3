"""Ranking metrics over all rows of a user."""

import numpy as np
from pyspark.sql import functions as F

from starloom.operators.metrics import preference_auc


def brute(rows, first=None):
    found = []
    for user in sorted({r[1] for r in rows}):
        mine = sorted(r for r in rows if r[1] == user)
        liked = [r[3] for r in mine if r[2] >= 4][:first]
        disliked = [r[3] for r in mine if r[2] <= 2][:first]
        pairs = [(x > y) + (x == y) / 2 for x in liked for y in disliked if x is not None and y is not None]
        if pairs:
            found.append(sum(pairs) / len(pairs))
    return np.mean(found), len(found)


def test_all_pairs_of_a_user_count(spark, tiny_tasks):
    """More rows of a side than 20, ties, a row without prediction, users with one side only; the user's rows are more than a task takes."""
    rng = np.random.default_rng(1)
    rows = [(f"r{n:04d}", f"u{n % 3}", float(1 + int(rng.integers(0, 5))), round(float(rng.random()), 2)) for n in range(600)]
    rows += [("r9001", "only", 5.0, 0.5), ("r9002", "u0", 5.0, None), ("r9003", "two", 4.0, 0.3), ("r9004", "two", 1.0, 0.3)]
    df = spark.createDataFrame(rows, "review_id string, user string, rating double, p double")
    for first in (None, 20):
        got = preference_auc(df, "p", first=first).first()
        auc, users = brute(rows, first)
        assert np.isclose(got["pairwise_auc"], auc) and got["n_users"] == users == 4
    assert not np.isclose(brute(rows)[0], brute(rows, 20)[0])
    assert preference_auc(df.filter(F.lit(False)), "p").first()["n_users"] == 0
