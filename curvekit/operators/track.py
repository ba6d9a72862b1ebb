"""Following curves through the clusters of consecutive columns.

Each image is one ordered fold over its columns with a small state: the last five positions of every curve. The step
depends on all earlier choices, so no window form exists.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fold import fold
from ..runtime import as_list, attach

RECENT = 5


class _Column:
    """Choices for one column: positions picked so far by curve number."""

    def __init__(self, x, clusters, dashes, trails, width, height):
        self.x, self.clusters, self.dashes, self.trails = x, clusters, dashes, trails
        self.width, self.height, self.jump = width, height, height * 0.08
        self.last = [trail[-1][1] for trail in trails if trail]
        self.picked: dict[int, float] = {}

    def expected(self, i):
        trail = self.trails[i]
        at, y = trail[-1]
        if len(trail) < 3:
            return y
        slope = (trail[-1][1] - trail[0][1]) / max(1, trail[-1][0] - trail[0][0])
        return max(0.0, min(float(self.height), y + slope * (self.x - at)))

    def start(self, n):
        """First column: all curves share the top cluster unless the column lies well inside and splits clearly."""
        ys = self.clusters
        apart = self.x >= self.width * 0.08 and len(ys) >= 2 and ys[1] - ys[0] >= 3
        self.picked = {i: ys[i] if apart and i < len(ys) else ys[0] for i in range(n)}

    def pair(self):
        """Two curves and at least two clusters."""
        ys = self.clusters
        if self.x < self.width * 0.03:
            self.picked = {0: ys[0], 1: ys[0]}
        elif abs(self.last[0] - self.last[1]) <= 5:
            self.picked = {0: ys[0], 1: ys[1]}
        else:
            self.match_pair()

    def match_pair(self):
        """Diverged: the closest pairs first; while the curves are near each other dash marks pull cluster to curve 0."""
        near = abs(self.last[0] - self.last[1]) < self.height * 0.15
        offers = []
        for i in (0, 1):
            goal, sign = self.expected(i), (-3 if i == 0 else 3) if near else 0
            offers += [(abs(y - goal) + sign * self.dashes[j], i, j, abs(y - goal)) for j, y in enumerate(self.clusters)]
        free = set(range(len(self.clusters)))
        for _, i, j, far in sorted(offers, key=lambda o: o[0]):
            if i not in self.picked and j in free and far <= self.jump * 1.5:
                self.picked[i] = self.clusters[j]
                free.discard(j)
        for i in (0, 1):
            if i not in self.picked:
                for j in sorted(free):
                    if abs(self.clusters[j] - self.last[i]) <= self.jump:
                        self.picked[i] = self.clusters[j]
                        free.discard(j)
                        break

    def general(self, n):
        """Any other case: curves choose by closeness; losers take what is left near them or share while overlapping."""
        ys = self.clusters
        overlapping = n >= 2 and max(self.last) - min(self.last) < 10
        if overlapping and len(ys) == 1:
            self.picked = {i: ys[0] for i in range(n)}
            return
        wishes = []
        for i in range(n):
            goal = self.expected(i)
            close = [j for j, y in enumerate(ys) if abs(y - self.last[i]) <= self.jump]
            best = min(close or range(len(ys)), key=lambda j: abs(ys[j] - goal))
            far = abs(ys[best] - goal)
            if close or far < self.height * 0.15:
                wishes.append((not close, far, i, best))
        wishes.sort(key=lambda q: q[:2])
        free = list(range(len(ys)))
        for _, _, i, best in wishes:
            if best in free:
                self.picked[i] = ys[best]
                free.remove(best)
        for _, _, i, _ in wishes:
            if i in self.picked:
                continue
            reach = [j for j in free if abs(ys[j] - self.last[i]) <= self.jump]
            if reach:
                j = min(reach, key=lambda k: abs(ys[k] - self.last[i]))
                self.picked[i] = ys[j]
                free.remove(j)
            elif overlapping:
                shared = [self.picked[k] for k in sorted(self.picked) if abs(self.picked[k] - self.last[i]) <= self.jump]
                if shared:
                    self.picked[i] = shared[0]


def track(clusters: DataFrame, n: int, plot_w: float, plot_h: float, dashes: DataFrame | None = None, key="image_id", x="x", gaps=True) -> DataFrame:
    """Assign the clusters (key, x, center) of each column to n curves: rows (key, curve, x, y, present).

    A curve without a cluster in a column gets a row without y; with `gaps` so do all curves in the columns between the first and the last cluster that
    have none at all, which is where a dashed line shows. Dash marks within three rows of a centre count for it.
    """
    keys = as_list(key)
    rows = clusters.select(*keys, x, "center")
    if dashes is not None:
        spots = rows.select(*keys, x, "center", F.explode(F.sequence(F.col("center").cast("int") - 3, F.col("center").cast("int") + 3)).alias("_y"))
        cells = dashes.select(*keys, F.col("x").alias(x), F.col("y").alias("_y")).distinct().withColumn("_m", F.lit(1))
        rows = attach(spots, cells, keys + [x, "_y"]).groupBy(*keys, x, "center").agg(F.count("_m").alias("dash"))
    else:
        rows = rows.withColumn("dash", F.lit(0).cast("bigint"))
    # clusters of one column: at most the height of the plot
    cols = rows.groupBy(*keys, x).agg(F.array_sort(F.collect_list(F.struct(F.col("center").cast("double").alias("y"), "dash"))).alias("c"))

    def step(trails, row):
        found = [q["y"] for q in row["c"]]
        col = _Column(row[x], found, [q["dash"] for q in row["c"]], trails, plot_w, plot_h)
        if not any(trails):
            col.start(n)
        elif n == 2 and len(found) >= 2:
            col.pair()
        else:
            col.general(n)
        made = [(i, row[x], col.picked.get(i), i in col.picked) for i in range(n)]
        trails = tuple((trails[i] + ((row[x], col.picked[i]),))[-RECENT:] if i in col.picked else trails[i] for i in range(n))
        return trails, made

    found = fold(cols, keys, [x], step, tuple(() for _ in range(n)), f"curve int, {x} int, y double, present boolean")
    if not gaps:
        return found
    # columns of one picture: at most its width
    every = rows.groupBy(*keys).agg(F.min(x).alias("_a"), F.max(x).alias("_b")).select(*keys, F.explode(F.sequence("_a", "_b")).alias(x))
    empty = attach(every, rows.select(*keys, x).distinct().withColumn("_has", F.lit(True)), keys + [x]).where(F.col("_has").isNull())
    return found.unionByName(empty.select(*keys, F.explode(F.array(*[F.lit(i) for i in range(n)])).alias("curve"), F.col(x).cast("int").alias(x),
                                          F.lit(None).cast("double").alias("y"), F.lit(False).alias("present")))
