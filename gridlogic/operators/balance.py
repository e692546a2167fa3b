"""Balanced selections: several marginals at once, by iterative proportional fitting over the cells of a table of candidates.

A cell is a combination of the balanced columns' values. Its candidates are counted by the cluster; fitting and rounding work on the cells alone, of which there are as many as
the targets' values combine to at most. Then one ranked pass takes as many candidates of each cell as its quota, by hash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlogic.operators.sampling import shuffled

#: Cells at most, which is what comes to the driver and is broadcast.
MOST_CELLS = 100_000

Targets = dict[str, dict[object, float]]


def largest_remainder(weights: np.ndarray, total: int) -> np.ndarray:
    """Whole numbers that add up to total, as near to the weights' shares as can be; ties to the first."""
    exact = weights / weights.sum() * total
    out = np.floor(exact + 1e-9).astype(np.int64)
    order = np.argsort(-(exact - out), kind="stable")
    out[order[: total - out.sum()]] += 1
    return out


class Cells:
    """The cells of a table, with how many candidates each has, and its place in each marginal."""

    def __init__(self, rows: list[tuple], counts: list[int], targets: Targets, total: int):
        self.rows, self.available = rows, np.array(counts, np.int64)
        self.values = [list(v) for v in targets.values()]
        self.wanted = [largest_remainder(np.array(list(v.values()), float), total) for v in targets.values()]
        self.place = [np.array([v.index(r[i]) for r in rows], np.int64) for i, v in enumerate(self.values)]
        self.total = total

    def sums(self, quotas: np.ndarray) -> list[np.ndarray]:
        return [np.bincount(p, quotas, len(v)) for p, v in zip(self.place, self.values, strict=True)]

    def fitted(self, rounds: int = 500, near: float = 1e-6) -> np.ndarray:
        """The cells' counts, scaled marginal by marginal until all are met. No cell gets more than it has; what that leaves open goes to the others in the next round."""
        w = self.available.astype(float) * (self.total / max(self.available.sum(), 1))
        for _ in range(rounds):
            for p, wanted in zip(self.place, self.wanted, strict=True):
                now = np.bincount(p, w, len(wanted))
                w = np.minimum(w * (wanted / np.maximum(now, 1e-300))[p], self.available)
            if max((np.abs(s - t).max() for s, t in zip(self.sums(w), self.wanted, strict=True)), default=0.0) < near:
                break
        return w

    def rounded(self, w: np.ndarray) -> np.ndarray:
        """Whole numbers near w. Units go to where marginals lack most, cells with the larger remainder first; then single units move between cells as long as that
        brings marginals nearer to what is wanted."""
        q = np.minimum(np.floor(w + 1e-9).astype(np.int64), self.available)
        lack = [t - s for s, t in zip(self.sums(q), self.wanted, strict=True)]

        def gain(step: int) -> np.ndarray:
            """By how much the sum of squared lacks falls if a cell gets step more."""
            out = np.zeros(len(q))
            for p, v in zip(self.place, lack, strict=True):
                out += (2 * step * v - 1)[p]
            return out

        def change(cell: int, step: int) -> None:
            q[cell] += step
            for p, v in zip(self.place, lack, strict=True):
                v[p[cell]] -= step

        rest = w - q
        while q.sum() < self.total and (open_ := q < self.available).any():
            score = np.where(open_, gain(1) + (rest - (q - np.floor(w))) * 0.5, -np.inf)
            change(int(score.argmax()), 1)
        for _ in range(4 * len(q) + self.total):
            if max((np.abs(v).max(initial=0) for v in lack), default=0) <= 0:
                break
            away = np.where(q > 0, gain(-1), -np.inf)
            best, move = 0.0, None
            for i in np.argsort(-away, kind="stable")[:64]:
                if not np.isfinite(away[i]):
                    break
                both = np.where(q < self.available, gain(1) + away[i], -np.inf)
                for p in self.place:  # where both are in one group, it stays as it is
                    both += np.where(p == p[i], 2.0, 0.0)
                both[i] = -np.inf
                if (j := int(both.argmax())) >= 0 and both[j] > best + 1e-9:
                    best, move = both[j], (int(i), j)
            if move is None:
                break
            change(move[0], -1)
            change(move[1], 1)
        return q


def cells_of(candidates: DataFrame, targets: Targets, total: int) -> Cells:
    """The cells whose values all have a target; candidates with another value, or none, are in no cell."""
    most = 1
    for v in targets.values():
        most *= len(v)
    if most > MOST_CELLS:
        raise ValueError(f"the targets' values combine to {most} cells, over {MOST_CELLS}")
    counted = candidates
    for c, v in targets.items():
        counted = counted.where(F.col(c).isin(list(v)))
    rows = counted.groupBy(*targets).agg(F.count(F.lit(1)).alias("__n")).collect()
    keyed = sorted(((tuple(r[c] for c in targets), r["__n"]) for r in rows), key=lambda x: [list(v).index(k) for k, v in zip(x[0], targets.values(), strict=True)])
    return Cells([k for k, _ in keyed], [n for _, n in keyed], targets, total)


def balanced(candidates: DataFrame, targets: Targets, total: int, key: str, seed: int = 42) -> DataFrame:
    """Total of the candidates, so that each of targets (column: value: share) is met as nearly as the candidates allow, and to within one row where they do.

    Which candidates of a cell are taken follows from a hash of key and seed. Where the targets can't be met together, or there are too few candidates, fewer rows may come, and
    no cell gives more than it has. A frequent cell's ranks are cut before the shuffle.
    """
    cells = cells_of(candidates, targets, total)
    quotas = cells.rounded(cells.fitted()) if cells.rows else np.zeros(0, np.int64)
    names, schema = list(targets), candidates.select(*targets).schema
    taken = [(*r, int(n)) for r, n in zip(cells.rows, quotas, strict=True) if n]
    table = candidates.sparkSession.createDataFrame(taken, schema.add("__quota", "long"))
    own = candidates.join(F.broadcast(table), names)
    order = Window.partitionBy(*names).orderBy(shuffled(F.col(key), seed), key)
    ranked = own.withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= int(quotas.max(initial=0)))
    return ranked.where(F.col("__k") <= F.col("__quota")).select(*candidates.columns)
