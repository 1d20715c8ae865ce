"""The non-negative risk of the classifiers: its value and slope, and the whole fit, against a dense recomputation."""

import math
import random

import numpy as np
import pytest

from metricloom.llm import pu


def dense(rows, width):
    table = np.zeros((len(rows), width))
    for i, row in enumerate(rows):
        table[i, row] = 1.0
    return table


def risk_parts(theta, p, u, prior):
    """Both parts of the risk, row by row: what positives cost as positives, and what negatives are estimated to cost."""

    def mean_loss(table, sign):
        total = 0.0
        for row in table:
            z = theta[-1] + sum(w * x for w, x in zip(theta[:-1], row))
            total += math.log1p(math.exp(-sign * z)) if sign * z > -30 else -sign * z
        return total / len(table)

    return prior * mean_loss(p, +1), mean_loss(u, -1) - prior * mean_loss(p, -1)


def slow_fit(p, u, prior, rounds, rate=0.1, decay=3e-4):
    """Adam on numerical slopes; where the negatives' part is below 0, only that part's rise is followed."""
    width = p.shape[1]
    theta, first, second, mean = (np.zeros(width + 1) for _ in range(4))
    theta[-1] = math.log(prior / (1 - prior))
    for step in range(1, rounds + 1):

        def objective(at):
            plus, minus = risk_parts(at, p, u, prior)
            return plus + minus

        def other_way(at):
            plus, minus = risk_parts(at, p, u, prior)
            return plus - minus

        chosen = objective if risk_parts(theta, p, u, prior)[1] >= 0 else other_way
        slope = np.zeros(width + 1)
        for k in range(width + 1):
            up, down = theta.copy(), theta.copy()
            up[k] += 1e-5
            down[k] -= 1e-5
            slope[k] = (chosen(up) - chosen(down)) / 2e-5
        slope[:-1] += decay * theta[:-1]
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        theta = theta - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        mean += theta * (step > rounds - rounds // 3)
    return mean / (rounds // 3)


@pytest.mark.parametrize("prior", [0.1, 0.5, 0.9])
def test_the_fit_equals_a_dense_recomputation(prior):
    rng = random.Random(round(prior * 10))
    width = 5
    rows = lambda n, odds: [sorted(k for k in range(width) if rng.random() < odds[k]) for _ in range(n)]
    p, u = rows(9, [0.9, 0.6, 0.1, 0.3, 0.0]), rows(14, [0.3, 0.4, 0.5, 0.3, 0.2])
    model = pu.fit(pu.Rows.of(p), pu.Rows.of(u), np.arange(width) * 10, prior, rounds=45)
    slow = slow_fit(dense(p, width), dense(u, width), prior, 45)
    found = np.zeros(width)
    found[model.places // 10] = model.weights
    assert np.allclose(found, slow[:-1], atol=2e-3) and abs(model.bias - slow[-1]) < 2e-3


def test_the_negative_part_turns_round_where_it_falls_below_zero():
    """Positives only among the unlabelled rows, and a prior above their share: the estimate goes below 0 at once."""
    p, u = [[0]] * 6, [[0]] * 3 + [[]] * 3
    theta = np.array([3.0, -1.0])
    assert risk_parts(theta, dense(p, 1), dense(u, 1), 0.9)[1] < 0
    model = pu.fit(pu.Rows.of(p), pu.Rows.of(u), np.array([7]), 0.9, rounds=60)
    slow = slow_fit(dense(p, 1), dense(u, 1), 0.9, 60)
    assert abs(float(model.lookup().get(7, 0.0)) - slow[0]) < 5e-3 and np.isfinite(model.bias)


def test_without_positives_or_unlabelled_rows_the_score_is_the_prior():
    for p, u in (([], [[0]]), ([[0]], [])):
        model = pu.fit(pu.Rows.of(p), pu.Rows.of(u), np.array([1]), 0.3)
        assert not len(model.places) and abs(pu.sigmoid(np.array([model.bias]))[0] - 0.3) < 1e-9
