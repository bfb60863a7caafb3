"""Weak supervision: how good are many voters, and what do they say together?

Votes are 1 (the label holds), -1 (it does not) or 0 (no opinion).  All fits here are of bounded
samples; their sizes are parameters of the operators that call them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ROUNDS = 40
CHOICES = (-1, 0, 1)
# A voter's correlation with others counts from here; below it is noise of a small sample.
CORRELATED = 0.1


@dataclass
class LabelModel:
    """``theta[v, y, c]`` is the chance that voter v makes choice c when the label is y; ``weight`` is a
    voter's share of new evidence, less where others repeat it; ``correlation`` is within labels."""

    prior: float
    theta: np.ndarray
    weight: np.ndarray
    correlation: np.ndarray

    def posterior(self, votes: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """The chance that the label holds, per row of ``votes``; ``before`` is each row's chance before
        they are heard, the common one by default."""
        logs = np.log(self.theta)
        before = np.full(len(votes), self.prior) if before is None else before
        odds = np.log(before) - np.log1p(-before)
        for v in range(votes.shape[1]):
            odds += self.weight[v] * (logs[v, 1] - logs[v, 0])[votes[:, v] + 1]
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))

    def accuracy(self) -> np.ndarray:
        """Per voter, the chance of being right when it has an opinion."""
        p = np.array([1 - self.prior, self.prior])
        right = p[0] * self.theta[:, 0, 0] + p[1] * self.theta[:, 1, 2]
        said = right + p[0] * self.theta[:, 0, 2] + p[1] * self.theta[:, 1, 0]
        return right / np.maximum(said, 1e-12)


def _correlations(votes: np.ndarray, belief: np.ndarray) -> np.ndarray:
    """Correlations of voters that remain when the label is known."""
    both = np.zeros((votes.shape[1],) * 2)
    for share in (belief, 1 - belief):
        total = max(share.sum(), 1e-9)
        centred = votes - (share @ votes) / total
        covariance = (centred * share[:, None]).T @ centred / total
        spread = np.sqrt(np.maximum(np.diag(covariance), 1e-9))
        both += covariance / spread[:, None] / spread * total
    return both / len(votes)


def fit_label_model(
    votes: np.ndarray, start: np.ndarray, anchored: bool = False, correlations: bool = True, rounds: int = ROUNDS
) -> LabelModel:
    """Expectation-maximisation over class-conditional choices, from a first belief per row.

    ``anchored`` keeps that belief as what is known of a row before the voters speak, as for rows with
    a given label of some error; otherwise it only starts the search.

    With ``correlations``, voters that agree beyond what the label explains share their weight: a
    voter's is 1 / (1 + the sum of its squared correlations), learnt along with the accuracies.
    """
    votes = np.asarray(votes, dtype=np.int64)
    belief = np.clip(np.asarray(start, dtype=float), 0.001, 0.999)
    first, n_voters = belief, votes.shape[1]
    model = LabelModel(0.5, np.full((n_voters, 2, 3), 1 / 3), np.ones(n_voters), np.eye(n_voters))
    for _ in range(rounds):
        theta = np.empty((n_voters, 2, 3))
        for y, share in enumerate((1 - belief, belief)):
            for place, choice in enumerate(CHOICES):
                theta[:, y, place] = share @ (votes == choice) + 0.5
            theta[:, y] /= theta[:, y].sum(axis=1, keepdims=True)
        model = LabelModel(float(np.clip(belief.mean(), 1e-4, 1 - 1e-4)), theta, np.ones(n_voters), np.eye(n_voters))
        if correlations:
            model.correlation = _correlations(votes.astype(float), belief)
            excess = np.where(np.abs(model.correlation) > CORRELATED, model.correlation, 0) ** 2
            np.fill_diagonal(excess, 0)
            model.weight = 1 / (1 + excess.sum(axis=1))
        new = model.posterior(votes, first if anchored else None)
        moved, belief = np.abs(new - belief).max(), new
        if moved < 1e-6:
            break
    return model


def fit_logistic(x: np.ndarray, belief: np.ndarray, ridge: float = 1.0, steps: int = 60) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic model of soft labels, by Newton steps.

    Columns are scaled to unit spread for the fit, and the scaling is folded into the weights.
    """
    x = np.asarray(x, dtype=float)
    middle, spread = x.mean(axis=0), x.std(axis=0)
    spread = np.where(spread > 1e-12, spread, 1.0)
    z = np.hstack([(x - middle) / spread, np.ones((len(x), 1))])
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-3
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (p - belief) + penalty * w
        curvature = (z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(curvature, gradient)
        step *= min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    weights = w[:-1] / spread
    return weights, float(w[-1] - weights @ middle)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))
