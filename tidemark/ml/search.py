"""Random hyper-parameter search, with several fits running at a time."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Sampler = Callable[[random.Random], object]


def log_uniform(low: float, high: float) -> Sampler:
    return lambda rng: math.exp(rng.uniform(math.log(low), math.log(high)))


def choice(values: Sequence[object]) -> Sampler:
    return lambda rng: rng.choice(list(values))


def draw(space: Mapping[str, Sampler], samples: int, seed: int) -> list[dict[str, object]]:
    """Parameter sets; the same seed draws the same sets."""
    rng = random.Random(seed)
    return [{name: space[name](rng) for name in sorted(space)} for _ in range(samples)]


def random_search(
    spark: SparkSession,
    train: Callable[[dict[str, object]], Mapping[str, float]],
    space: Mapping[str, Sampler],
    samples: int = 20,
    parallel: int = 4,
    seed: int = 42,
) -> DataFrame:
    """Train each drawn set and return one row per trial: its parameters and metrics.

    ``train`` runs Spark jobs; the driver only starts them and keeps the metrics.
    """
    drawn = draw(space, samples, seed)
    with ThreadPoolExecutor(max_workers=parallel) as pool:
        results = list(pool.map(inheritable_thread_target(spark)(train), drawn))
    rows = [
        (i, {k: str(v) for k, v in params.items()}, {k: float(v) for k, v in metrics.items()})
        for i, (params, metrics) in enumerate(zip(drawn, results, strict=True))
    ]
    return spark.createDataFrame(rows, "trial int, params map<string,string>, metrics map<string,double>")


def best_trial(trials: DataFrame, metric: str = "loss", mode: str = "min") -> DataFrame:
    value = F.try_element_at("metrics", F.lit(metric))
    order = value.asc_nulls_last() if mode == "min" else value.desc_nulls_last()
    return trials.orderBy(order, "trial").limit(1)


@dataclass(frozen=True)
class Range:
    """Numbers between two bounds, even in their logarithm or not."""

    low: float
    high: float
    log: bool = True

    def _to(self, x: float) -> float:
        return math.log(x) if self.log else x

    def __call__(self, rng: random.Random) -> float:
        drawn = rng.uniform(self._to(self.low), self._to(self.high))
        return math.exp(drawn) if self.log else drawn

    def near(self, known: Sequence[float], rng: random.Random) -> float:
        """A draw from the density around known values, or from the whole range."""
        if not known or rng.random() < 1 / (len(known) + 1):
            return self(rng)
        while True:
            x = rng.gauss(self._to(rng.choice(list(known))), self._width(known))
            if self._to(self.low) <= x <= self._to(self.high):
                return math.exp(x) if self.log else x

    def _width(self, known: Sequence[float]) -> float:
        span = self._to(self.high) - self._to(self.low)
        return max(span / (1 + len(known)), span / 50)

    def density(self, x: float, known: Sequence[float]) -> float:
        """Bells around the known values, mixed with an even share over the range."""
        span, width = self._to(self.high) - self._to(self.low), self._width(known)
        bells = sum(math.exp(-0.5 * ((self._to(x) - self._to(k)) / width) ** 2) for k in known) / (width * math.sqrt(2 * math.pi))
        return (bells + 1 / span) / (len(known) + 1)


@dataclass(frozen=True)
class Options:
    """One of some values."""

    values: tuple

    def __call__(self, rng: random.Random) -> object:
        return rng.choice(self.values)

    def near(self, known: Sequence[object], rng: random.Random) -> object:
        return rng.choices(self.values, [self.density(v, known) for v in self.values])[0]

    def density(self, x: object, known: Sequence[object]) -> float:
        return (sum(k == x for k in known) + 1) / (len(known) + len(self.values))


def suggest(
    space: Mapping[str, Range | Options], done: Sequence[tuple[dict[str, object], float]], rng: random.Random, good_share: float = 0.25, candidates: int = 24
) -> dict[str, object]:
    """Parameters to try next: those that good trials have and bad ones lack.

    The best ``good_share`` of the trials done (smaller losses) and the rest each give a density; of ``candidates`` draws
    from the good one, that with the greatest ratio of the two is taken.
    """
    ranked = [params for params, _ in sorted(done, key=lambda d: d[1])]
    n = max(1, math.ceil(good_share * len(ranked))) if ranked else 0
    good, bad = ranked[:n], ranked[n:]

    def ratio(params: dict[str, object]) -> float:
        return sum(
            math.log(s.density(params[k], [g[k] for g in good])) - math.log(s.density(params[k], [b[k] for b in bad])) for k, s in space.items()
        )

    drawn = [{k: space[k].near([g[k] for g in good], rng) for k in sorted(space)} for _ in range(candidates)]
    return max(drawn, key=ratio)


def learning_search(
    spark: SparkSession,
    train: Callable[[dict[str, object]], Mapping[str, float]],
    space: Mapping[str, Range | Options],
    samples: int = 20,
    startup: int = 8,
    parallel: int = 4,
    metric: str = "loss",
    seed: int = 42,
) -> DataFrame:
    """Like :func:`random_search`, but after ``startup`` random trials each ``parallel`` of them learn from those before."""
    rng = random.Random(seed)
    done: list[tuple[dict[str, object], dict[str, float]]] = []
    with ThreadPoolExecutor(max_workers=parallel) as pool:
        while len(done) < samples:
            n = min(parallel, samples - len(done))
            known = [(params, found[metric]) for params, found in done]
            drawn = [{k: space[k](rng) for k in sorted(space)} if len(done) < startup else suggest(space, known, rng) for _ in range(n)]
            results = pool.map(inheritable_thread_target(spark)(train), drawn)
            done += [(params, {k: float(v) for k, v in found.items()}) for params, found in zip(drawn, results, strict=True)]
    rows = [(i, {k: str(v) for k, v in params.items()}, found) for i, (params, found) in enumerate(done)]
    return spark.createDataFrame(rows, "trial int, params map<string,string>, metrics map<string,double>")


def rungs(grace: int = 10, factor: int = 2, most: int = 100) -> list[int]:
    """The rounds at which trials are compared: ``grace``, and ``factor`` times as many each time, up to ``most``."""
    out = [grace]
    while out[-1] * factor <= most:
        out.append(out[-1] * factor)
    return out


def successive_halving(
    spark: SparkSession,
    go_on: Callable[[dict[str, object], object | None, int], tuple[object, float]],
    space: Mapping[str, Sampler],
    samples: int = 16,
    grace: int = 10,
    factor: int = 2,
    most: int = 100,
    parallel: int = 4,
    seed: int = 42,
) -> DataFrame:
    """Train many trials for a few rounds and the better ones for more; one row per trial and rung it reached.

    ``go_on`` gets a trial's parameters, what it returned for the trial at the rung before (none at first), and the
    number of further rounds; it returns what to go on from, and the loss. Of the trials at a rung the best one in
    ``factor`` is ``kept``, at least one, ties by number; they go on from where they are. Columns: trial, rung (from 0),
    rounds in all, params, loss, kept. At the last rung the best trial alone is kept.
    """
    drawn = draw(space, samples, seed)
    states: dict[int, object | None] = dict.fromkeys(range(samples))
    rows, before = [], 0
    levels = rungs(grace, factor, most)
    with ThreadPoolExecutor(max_workers=parallel) as pool:
        for rung, rounds in enumerate(levels):
            alive = sorted(states)
            run = inheritable_thread_target(spark)(lambda t, more=rounds - before: go_on(drawn[t], states[t], more))
            found = dict(zip(alive, pool.map(run, alive), strict=True))
            ranked = sorted(alive, key=lambda t: (math.isnan(found[t][1]), found[t][1], t))
            kept = set(ranked[: 1 if rung == len(levels) - 1 else max(1, len(ranked) // factor)])
            rows += [(t, rung, rounds, {k: str(v) for k, v in drawn[t].items()}, float(found[t][1]), t in kept) for t in alive]
            states = {t: found[t][0] for t in kept}
            before = rounds
    return spark.createDataFrame(rows, "trial int, rung int, rounds int, params map<string,string>, loss double, kept boolean")
