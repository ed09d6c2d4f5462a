"""Search for parameters by trials: at random, or by Parzen estimators of good and bad trials. Trials come in batches, so that all of one are rewarded by one job."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np

Space = Mapping[str, tuple[float, float]]
#: How many count as good, by the root of their number; draws from their density for each proposal; trials at random before there is one.
GOOD, DRAWS, STARTUP = 0.5, 24, 8
#: Least widths of the densities, as shares of a range.
NARROW, SMOOTH = 1.0, 0.1


def at_random(space: Space, n: int, rng: np.random.Generator) -> list[dict[str, float]]:
    return [{k: float(rng.uniform(lo, hi)) for k, (lo, hi) in space.items()} for _ in range(n)]


class Parzen:
    """The density of values on [lo, hi]: a normal about each, cut at the ends, and a flat one for what has not been tried."""

    def __init__(self, values: Sequence[float], lo: float, hi: float, least: float):
        self.values, self.lo, self.hi = np.asarray(values, float), lo, hi
        spread = self.values.std() if len(values) > 1 else 0.0
        self.width = max(1.06 * spread * max(len(values), 1) ** -0.2, (hi - lo) * least, 1e-12)

    def draw(self, n: int, rng: np.random.Generator) -> np.ndarray:
        pick = rng.integers(0, len(self.values) + 1, n)
        flat = rng.uniform(self.lo, self.hi, n)
        near = rng.normal(np.append(self.values, 0.0)[pick], self.width)
        inside = (pick < len(self.values)) & (near >= self.lo) & (near <= self.hi)
        return np.where(inside, near, flat)

    def log_density(self, x: np.ndarray) -> np.ndarray:
        bumps = np.exp(-0.5 * ((x[:, None] - self.values) / self.width) ** 2) / (self.width * np.sqrt(2 * np.pi))
        return np.log((bumps.sum(1) + 1 / (self.hi - self.lo)) / (len(self.values) + 1))


def propose(trials: Sequence[Mapping[str, float]], rewards: Sequence[float | None], space: Space, more: int, seed: int) -> list[dict[str, float]]:
    """``more`` further trials: of draws from the density of the good ones, that whose ratio to the density of the rest is greatest.

    Trials without a reward (null or not a number) are left out. With few trials, or none, the proposals are random. The trials
    are a bounded table; the same seed and trials give the same proposals.
    """
    rng = np.random.default_rng([seed, len(trials)])
    known = [(t, r) for t, r in zip(trials, rewards, strict=True) if r is not None and np.isfinite(r)]
    if len(known) < STARTUP:
        return at_random(space, more, rng)
    known.sort(key=lambda x: -x[1])
    cut = max(2, int(np.ceil(GOOD * len(known) ** 0.5)) + 1)
    # The good ones are told apart the finer the more trials there are; the rest is smooth, so that a gap in it is no promise. What
    # is proposed counts with the rest for what follows, or all of a batch would be alike.
    fine, good, rest = NARROW / len(known) ** 0.5, [t for t, _ in known[:cut]], [t for t, _ in known[cut:]]
    out: list[dict[str, float]] = []
    for _ in range(more):
        one = {}
        for k, (lo, hi) in space.items():
            near, far = Parzen([t[k] for t in good], lo, hi, fine), Parzen([t[k] for t in [*rest, *out]], lo, hi, SMOOTH)
            x = near.draw(DRAWS, rng)
            one[k] = float(x[np.argmax(near.log_density(x) - far.log_density(x))])
        out.append(one)
    return out


def search(reward: Callable[[list[dict[str, float]]], list[float | None]], space: Space, rounds: int, per_round: int, seed: int = 7, method: str = "parzen") -> list[tuple[dict[str, float], float | None]]:
    """(parameters, reward) of ``rounds`` batches of ``per_round`` trials; ``reward`` is one job for a batch."""
    trials: list[dict[str, float]] = []
    rewards: list[float | None] = []
    for _ in range(rounds):
        batch = propose(trials, rewards, space, per_round, seed) if method == "parzen" else at_random(space, per_round, np.random.default_rng([seed, len(trials)]))
        rewards += reward(batch)
        trials += batch
    return list(zip(trials, rewards, strict=True))
