"""Choosing parameters: all of a grid, or as many trials as a budget allows, proposed by a tree of Parzen estimators.

After some trials drawn at random, those so far are split into the better ones and the rest.  For each parameter two
densities over its values are estimated from them, smoothed over neighbouring values where they have an order, and
the next trial is, of candidates drawn from the density of the better, the one whose ratio to the density of the
rest is largest, parameters taken as independent.  Trials run in parallel batches; those still open count among
the rest, so that a batch spreads.  No trial is repeated.
"""

from __future__ import annotations

import json
import math
import random
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

Trial = tuple[dict, float, list[float]]


def key(params: dict) -> str:
    return json.dumps(params, sort_keys=True, default=str)


class Sampler:
    """Proposes members of a grid; `tell` it what they were worth (more is better)."""

    def __init__(self, grid: list[dict], seed: int = 42, startup: int = 5, share: float = 0.25, candidates: int = 24, width: float = 0.7) -> None:
        self.grid, self.draw = {key(p): p for p in grid}, random.Random(seed)
        self.startup, self.share, self.candidates, self.width = startup, share, candidates, width
        self.told: dict[str, float] = {}
        self.open: set[str] = set()
        names = sorted({n for p in grid for n in p})
        self.values = {n: self._ordered([p.get(n) for p in grid]) for n in names}

    @staticmethod
    def _ordered(values: list) -> list:
        distinct = list({key({"v": v}): v for v in values}.values())
        try:
            return sorted(distinct)
        except TypeError:
            return distinct

    def _density(self, name: str, trials: list[dict]) -> list[float]:
        """The smoothed share of each value of a parameter; an even prior counts as one trial."""
        values = self.values[name]
        at = {key({"v": v}): i for i, v in enumerate(values)}
        ordered = len(values) > 2 and all(isinstance(v, int | float) and not isinstance(v, bool) for v in values)
        weight = [1.0 / len(values)] * len(values)
        for p in trials:
            i = at[key({"v": p.get(name)})]
            kernel = [math.exp(-(((i - j) / self.width) ** 2) / 2) if ordered else float(i == j) for j in range(len(values))]
            total = sum(kernel)
            weight = [w + x / total for w, x in zip(weight, kernel)]
        total = sum(weight)
        return [w / total for w in weight]

    def _propose(self, left: list[str]) -> str:
        if len(self.told) + len(self.open) < self.startup or not self.told:
            return self.draw.choice(left)
        ranked = sorted(self.told, key=lambda k: -self.told[k])
        n = max(1, math.ceil(self.share * len(ranked)))
        good, rest = [self.grid[k] for k in ranked[:n]], [self.grid[k] for k in ranked[n:]] + [self.grid[k] for k in self.open]
        better, other = ({m: self._density(m, part) for m in self.values} for part in (good, rest))
        place = {m: {key({"v": v}): i for i, v in enumerate(vs)} for m, vs in self.values.items()}
        at = lambda k: {m: place[m][key({"v": self.grid[k].get(m)})] for m in self.values}
        likely = [math.prod(better[m][i] for m, i in at(k).items()) for k in left]
        drawn = set(self.draw.choices(left, likely, k=self.candidates))
        ratio = lambda k: sum(math.log(better[m][i]) - math.log(other[m][i]) for m, i in at(k).items())
        return max(sorted(drawn), key=ratio)

    def ask(self, n: int) -> list[dict]:
        """Up to n members of the grid that have not been asked for; none if there are no more."""
        out = []
        for _ in range(n):
            left = [k for k in self.grid if k not in self.told and k not in self.open]
            if not left:
                break
            k = self._propose(left)
            self.open.add(k)
            out.append(self.grid[k])
        return out

    def tell(self, params: dict, value: float) -> None:
        k = key(params)
        self.open.discard(k)
        self.told[k] = value if value == value else -math.inf


def best_first(trials: list[Trial]) -> list[Trial]:
    return sorted(trials, key=lambda t: (-t[1] if t[1] == t[1] else math.inf, key(t[0])))


def search(measure: Callable[[dict], Trial], grid: list[dict], trials: int | None = None, seconds: float | None = None, seed: int = 42, parallel: int = 4, **sampler) -> list[Trial]:
    """(parameters, mean, values by fold) of every trial, best first: the whole grid, or, with a number of trials, that many
    of it.  Once `seconds` have passed no batch begins, but one is always run.  An empty grid is one trial of
    the defaults."""
    grid = list(grid) or [{}]
    whole = trials is None or trials >= len(grid)
    proposed, begun, out = Sampler(grid, seed, **sampler), time.monotonic(), []
    with ThreadPoolExecutor(parallel) as pool:
        left = list(grid)
        while len(out) < (len(grid) if whole else trials):
            if out and seconds is not None and time.monotonic() - begun >= seconds:
                break
            n = min(parallel, (len(grid) if whole else trials) - len(out))
            batch, left = (left[:n], left[n:]) if whole else (proposed.ask(n), left)
            if not batch:
                break
            for got in pool.map(measure, batch):
                proposed.tell(got[0], got[1])
                out.append(got)
    return best_first(out)
