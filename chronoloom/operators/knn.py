"""Exact k-nearest neighbours by cosine, and how they live through cumulative snapshots, block by block."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block, at most so many of which are formed from pivots (what is known of a block, its centre and radius, goes to
#: every task; larger tables have larger blocks).  Blocks are dealt in GROUPS groups, or more, of at most HELD blocks; a task compares two groups.
BLOCK, PIVOTS, GROUPS, HELD = 2048, 4096, 12, 32
#: Queries whose best are kept together, and neighbours of how many rows are merged together.
ASKING, MERGED = 1024, 512
#: Bounds are widened by so much, for rounding.
EPS = 1e-6
#: Queries whose products are looked through at a time, in 32 bits; if over one in MANY passes, they are multiplied in 64 bits at once.
TILE, MANY = 256, 64


def _unit(rows: pd.DataFrame) -> np.ndarray:
    m = np.array(rows["v"].tolist(), float).reshape(len(rows), -1)
    return m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-9)


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def _blocks(vectors: DataFrame, key: str, vector: str, extra: str | None, block: int, floor, cut) -> DataFrame:
    """A row for each block of rows near one pivot: b, n, and in bytes the rows' ids, unit vectors u, floors (the angle beyond which a
    row has no use for others, by floor(block's rows)(place of the row, similarities to the block)) and extra (an array of whole
    numbers), and the block's centre and radius."""
    rows = vectors.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"), *([extra] if extra else []))
    n = rows.count()
    size = max(block, -(-n // PIVOTS))
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", b "
    pivots = np.zeros((0, 0))
    if n > size:
        pivots = _unit(rows.orderBy(F.xxhash64("id"), "id").limit(-(-n // size)).select("v").toPandas())  # PIVOTS vectors at most

    def near(parts):
        for part in parts:
            if len(part):
                u = _unit(part)
                b = (u @ pivots.T).argmax(axis=1) if len(pivots) else np.zeros(len(part), int)
                yield part.assign(b=np.where((u == 0).all(axis=1), -1, b))  # a vector of zeros has no direction

    dealt = cut(rows.mapInPandas(near, kind + "long"))
    sizes = dealt.groupBy("b").agg(F.ceil(F.count("*") / size).alias("parts"))  # a row for each pivot
    dealt = dealt.join(F.broadcast(sizes), "b").withColumn("b", F.concat_ws(".", "b", F.pmod(F.xxhash64("id"), F.col("parts")))).drop("parts")

    def inside(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id").reset_index(drop=True)
        u = _unit(part)
        centre = u.mean(axis=0)
        length = np.sqrt((centre * centre).sum())
        whole = length < 1e-9 or (u == 0).all(axis=1).any()
        centre = centre / max(length, 1e-9)
        floors, least = [], floor(part)
        for s in range(0, len(part), 256):  # some queries at a time
            sims = np.round(u[s : s + 256] @ u.T, 12)
            sims[np.arange(len(sims)), s + np.arange(len(sims))] = -np.inf
            floors += [least(s + i, row) for i, row in enumerate(sims)]
        angle = np.array([np.pi if whole or not np.isfinite(f) else float(np.arccos(np.clip(f, -1, 1))) for f in floors])
        more = np.array(part[extra].tolist(), np.int64).tobytes() if extra else b""
        radius = np.pi if whole else float(_angles(u, centre[None]).max(initial=0.0))
        row = (part["b"].iloc[0], len(part), part["id"].to_numpy(np.int64).tobytes(), u.tobytes(), angle.tobytes(), more, centre.tobytes(), radius)
        return pd.DataFrame([row], columns=["b", "n", "ids", "u", "floors", "extra", "centre", "radius"])

    return cut(dealt.groupBy("b").applyInPandas(inside, "b string, n long, ids binary, u binary, floors binary, extra binary, centre binary, radius double"))


class _Block:
    """The rows of a block again."""

    def __init__(self, row):
        self.b, self.ids, self.floors = row.b, np.frombuffer(row.ids, np.int64), np.frombuffer(row.floors)
        self.u = np.frombuffer(row.u).reshape(row.n, -1)
        self.extra = np.frombuffer(row.extra, np.int64).reshape(row.n, -1)

    def reaches(self, centre: np.ndarray, radius: float) -> np.ndarray:
        """Of each row, whether something within its floor may lie so far around a centre."""
        return _angles(self.u, centre[None])[:, 0] - radius <= self.floors + EPS


def _heads(blocks: DataFrame) -> dict[str, tuple[np.ndarray, float]]:
    """Centre and radius of each block."""
    rows = blocks.select("b", "centre", "radius").orderBy("b").toPandas()  # twice PIVOTS rows at most
    return {r.b: (np.frombuffer(r.centre), r.radius) for r in rows.itertuples()}


def _meetings(blocks: DataFrame, heads: dict[str, tuple[np.ndarray, float]], work, kind: str) -> DataFrame:
    """work(queries, candidates) of every two groups of blocks; a block is copied as often as there are groups, twice."""
    if not heads:
        return blocks.sparkSession.createDataFrame([], kind)
    g = max(min(GROUPS, len(heads)), -(-len(heads) // HELD))
    places = blocks.sparkSession.createDataFrame([(b, at % g) for at, b in enumerate(heads)], "b string, own int")
    placed = blocks.drop("centre", "radius").join(F.broadcast(places), "b")  # a row for each block
    others = F.explode(F.sequence(F.lit(0), F.lit(g - 1)))
    columns = ["b", "n", "ids", "u", "floors", "extra"]
    asked = placed.select(F.col("own").alias("i"), others.alias("j"), F.lit(True).alias("asks"), *columns)
    given = placed.select(others.alias("i"), F.col("own").alias("j"), F.lit(False).alias("asks"), *columns)

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        sides = [[_Block(r) for r in rows[rows["asks"] == asks].itertuples()] for asks in (True, False)]
        return work(*sides)

    return asked.unionByName(given).repartition(g * g, "i", "j").groupBy("i", "j").applyInPandas(meet, kind)


class _Best:
    """The k most similar others of some queries, as candidates come; ties to the smaller id."""

    def __init__(self, u: np.ndarray, ids: np.ndarray, floors: np.ndarray, k: int, digits: int = 12):
        self.u, self.ids, self.k, self.digits, self.near_enough = u, ids, k, digits, 10.0 ** (1 - digits)
        self.sims, self.near = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
        self.least = np.where(floors < np.pi, np.cos(floors) - 1e-9, -np.inf)  # nothing below is of use
        self.short = np.append(u, np.zeros((len(u), 1)), axis=1).astype(np.float32)  # with a place for what a row must pass
        self.slack = (u.shape[1] + 8) * 2.0**-23  # twice what a product of unit vectors can be off by in 32 bits

    def _passing(self, u: np.ndarray, own: np.ndarray, bar: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Row of own, place of the candidate and similarity of those that reach the row's bar; None if they are many.

        Products less the bar come in 32 bits, tile by tile, where most hold nothing over zero; what comes near is multiplied in 64 bits.
        """
        across = np.append(u, np.ones((len(u), 1)), axis=1).astype(np.float32).T
        rows, places, found = [], [], 0
        self.short[own, -1] = self.slack - bar
        for s in range(0, len(own), TILE):
            over = self.short[own[s : s + TILE]] @ across
            if not over.max() < 0:
                at = np.flatnonzero(over >= 0)
                found += len(at)
                if found * MANY > len(own) * len(u) + (1 << 14):
                    return None
                rows.append(s + at // len(u))
                places.append(at % len(u))
        if not rows:
            return np.empty(0, int), np.empty(0, int), np.empty(0)
        at, c = np.concatenate(rows), np.concatenate(places)
        sims = np.einsum("ij,ij->i", self.u[own[at]], u[c])
        keep = sims >= bar[at]
        return at[keep], c[keep], sims[keep]

    def add(self, u: np.ndarray, ids: np.ndarray, rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Takes candidates for all queries or some; row, place of the candidate and similarity of those now among the best."""
        own = np.arange(len(self.ids)) if rows is None else rows
        bar = np.maximum(self.sims[own].min(axis=1), self.least[own]) - self.near_enough
        passing = self._passing(u, own, bar) if len(u) and np.isfinite(bar).all() else None
        if passing is None:
            sims = self.u[own] @ u.T
            at, c = np.nonzero(sims >= bar[:, None])
            sims = sims[at, c]
        else:
            at, c, sims = passing
        r, s = own[at], np.round(sims, self.digits)
        other = self.ids[r] != ids[c]
        r, c, s = r[other], c[other], s[other]
        if not len(r):
            return r, c, s
        hit = np.unique(r)
        k = self.k
        row = np.concatenate([np.repeat(hit, k), r])
        sim = np.concatenate([self.sims[hit].ravel(), s])
        near = np.concatenate([self.near[hit].ravel(), ids[c]])
        place = np.concatenate([np.full(len(hit) * k, -1), c])
        order = np.lexsort((near, -sim, row))
        first = np.searchsorted(row[order], hit)
        kept = order[(first[:, None] + np.arange(k)).ravel()]  # a query has k entries at least
        self.sims[hit], self.near[hit] = sim[kept].reshape(-1, k), near[kept].reshape(-1, k)
        new = kept[place[kept] >= 0]
        return row[new], place[new], sim[new]


def _kth(k: int):
    """The similarity that the k-th best in the block has."""

    def floor(at: int, sims: np.ndarray) -> float:
        return np.partition(sims, len(sims) - k)[len(sims) - k] if len(sims) > k else -np.inf

    return lambda part: floor


def share_compared(vectors: DataFrame, key: str, vector: str, cut, k: int = 6, block: int = BLOCK) -> float:
    """The share of pairs of a row and a block that nearest() compares: what the bounds leave."""
    blocks = _blocks(vectors.where(F.col(vector).isNotNull()), key, vector, None, block, _kth(k), cut)
    heads = _heads(blocks)

    def count(asking: list[_Block], given: list[_Block]) -> pd.DataFrame:
        met = sum(int(len(q.ids) if q.b == c.b else q.reaches(*heads[c.b]).sum()) for q in asking for c in given)
        return pd.DataFrame({"met": [met]})

    met = _meetings(blocks, heads, count, "met long").agg(F.sum("met")).first()[0] or 0
    return met / max(1, (blocks.agg(F.sum("n")).first()[0] or 0) * len(heads))


def nearest(vectors: DataFrame, key: str, vector: str, cut, k: int = 6, block: int = BLOCK) -> DataFrame:
    """src, dst, sim, place: the k most similar others of each row, ties to the smaller id.  Rows without a vector take no part.

    Rows are dealt in blocks around pivots.  The k-th best in its own block is a row's floor, and it is compared only with blocks
    whose centre and radius leave room for something as near (angles keep the triangle inequality).  Blocks meet in groups, each
    as one row of bytes, so what is moved grows with the number of groups, not of blocks.  cut: stores a table and reads it again.
    """
    blocks = _blocks(vectors.where(F.col(vector).isNotNull()), key, vector, None, block, _kth(k), cut)
    heads = _heads(blocks)

    def work(asking: list[_Block], given: list[_Block]) -> pd.DataFrame:
        out = []
        for q in asking:
            best = _Best(q.u, q.ids, q.floors, k)
            for c in given:
                rows = np.arange(len(q.ids)) if q.b == c.b else np.nonzero(q.reaches(*heads[c.b]))[0]
                for s in range(0, len(c.ids) if len(rows) else 0, ASKING):
                    best.add(c.u[s : s + ASKING], c.ids[s : s + ASKING], None if len(rows) == len(q.ids) else rows)
            i, j = np.nonzero(np.isfinite(best.sims))
            out.append(pd.DataFrame({"src": q.ids[i], "dst": best.near[i, j], "sim": best.sims[i, j]}))
        return pd.concat(out) if out else pd.DataFrame({"src": [], "dst": [], "sim": []})

    found = _meetings(blocks, heads, work, "src long, dst long, sim double")
    best = Window.partitionBy("src").orderBy(F.desc("sim"), "dst")
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


def undirected(edges: DataFrame) -> DataFrame:
    """a < b, each link once."""
    return edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a <> b").distinct()


def _alive(years: np.ndarray, own: int, k: int) -> tuple[list[int], list[int], list[float]]:
    """Of neighbours in descending similarity, with their years: places of those that live, start and stop."""
    worst: list[int] = []  # the k smallest years among better neighbours, as a max-heap
    places, starts, stops = [], [], []
    for at, y in enumerate(years.tolist()):
        start = max(own, y)
        stop = -worst[0] if len(worst) == k else np.inf
        if start < stop:
            places.append(at)
            starts.append(start)
            stops.append(stop)
        if len(worst) < k:
            heapq.heappush(worst, -y)
        elif y < -worst[0]:
            heapq.heapreplace(worst, -y)
    return places, starts, stops


def lifetimes(vectors: DataFrame, key: str, vector: str, year: str, cut, k: int = 6, block: int = BLOCK) -> DataFrame:
    """src, dst, start, stop: when dst is among the k nearest of src in the graph of all rows up to a year.

    That holds from the later of both years until k better neighbours have come: the k-th smallest year among those
    more similar.  A neighbour that k better ones precede in its block never lives, so blocks are thinned apart and
    merged once more.  stop is null if it never ends.
    """
    return lifetimes_of_orders(vectors.where(F.col(year).isNotNull()).withColumn("__years", F.array(year)), key, vector, "__years", cut, k, block).drop("trial")


def lifetimes_of_ks(vectors: DataFrame, key: str, vector: str, year: str, cut, ks: list[int], block: int = BLOCK) -> DataFrame:
    """k, src, dst, start, stop: lifetimes() for several k, from one search for the largest: who is among the k nearest is among more."""
    dated = vectors.where(F.col(year).isNotNull()).withColumn("__years", F.array(year))
    return lifetimes_of_orders(dated, key, vector, "__years", cut, max(ks), block, ks).drop("trial")


def lifetimes_of_orders(vectors: DataFrame, key: str, vector: str, years: str, cut, k: int = 6, block: int = BLOCK, ks: list[int] | None = None) -> DataFrame:
    """trial, src, dst, start, stop: lifetimes() under each of several years of every row (an array, without nulls); the neighbours of a row are ranked once for all.
    With ks, k's and smaller ones, the lifetimes for each of them, and k.

    A row's floor is the k-th best in its block among those there before it, in the trial where that is least: from its own year on,
    nothing below can be among its k nearest.
    """
    rows = vectors.where(F.col(vector).isNotNull()).withColumn("__years", F.col(years).cast("array<int>"))

    def floor(part: pd.DataFrame):
        trials = np.array(part["__years"].tolist()).T

        def least(at: int, sims: np.ndarray) -> float:
            found = np.inf
            for y in trials:
                before = sims[(y <= y[at]) & np.isfinite(sims)]
                found = min(found, np.partition(before, len(before) - k)[len(before) - k] if len(before) >= k else -np.inf)
            return found

        return least

    blocks = _blocks(rows, key, vector, "__years", block, floor, cut)
    heads = _heads(blocks)
    names = ["trial", "src", "dst", "sim", "own", "y"]

    def thin(asking: list[_Block], given: list[_Block]) -> pd.DataFrame:
        """Of the candidates of a group those that live among the group's: as years go by, those that come among the k nearest of a row that is there."""
        out = []
        ordered: dict[tuple, tuple] = {}
        for trial in range(given[0].extra.shape[1] if given else 0):
            for q in asking:
                met = [c for c in given if q.b == c.b or q.reaches(*heads[c.b]).any()]
                if not met:
                    continue
                key = (trial, *(c.b for c in met))
                if key not in ordered:
                    years = np.concatenate([c.extra[:, trial] for c in met])
                    order = np.argsort(years, kind="stable")
                    different, first = np.unique(years[order], return_index=True)
                    ordered.clear()
                    ids = np.concatenate([c.ids for c in met])
                    by_id = np.argsort(ids)
                    ordered[key] = np.concatenate([c.u for c in met])[order], ids[order], different.tolist(), [*first.tolist(), len(order)], ids[by_id], years[by_id]
                u, ids, different, first, known, when = ordered[key]
                by_year = np.argsort(q.extra[:, trial], kind="stable")
                for s in range(0, len(by_year), ASKING):
                    some = by_year[s : s + ASKING]
                    own = q.extra[some, trial]  # ascending
                    best = _Best(q.u[some], q.ids[some], q.floors[some], k)
                    there = 0  # rows whose year is past: what they had at their own year is told
                    for year, lo, hi in zip([*different, np.inf], first, [*first[1:], None]):  # at the end, the rest is told
                        come = int(np.searchsorted(own, year))
                        if come > there:
                            i, j = np.nonzero(np.isfinite(best.sims[there:come]))
                            i = i + there
                            out.append((np.full(len(i), trial), q.ids[some][i], best.near[i, j], best.sims[i, j], own[i], when[np.searchsorted(known, best.near[i, j])]))
                            there = come
                        if hi is not None:
                            r, c, sims = best.add(u[lo:hi], ids[lo:hi])
                            new = r < come
                            r, c = r[new], c[new]
                            out.append((np.full(len(r), trial), q.ids[some][r], ids[lo:hi][c], sims[new], own[r], np.full(len(r), year)))
        columns = [np.concatenate(x) for x in zip(*out)] if out else [[]] * len(names)
        return pd.DataFrame(dict(zip(names, columns)))

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        order = np.lexsort((rows["dst"], -rows["sim"], rows["src"], rows["trial"]))
        trial, src, dst, own, y = (rows[c].to_numpy()[order] for c in ("trial", "src", "dst", "own", "y"))
        bounds = np.append(np.nonzero(np.append(True, (trial[1:] != trial[:-1]) | (src[1:] != src[:-1])))[0], len(src)).tolist()
        kept, starts, stops, of = [], [], [], []
        for few in ks or [k]:
            for s, e in zip(bounds[:-1], bounds[1:]):
                places, start, stop = _alive(y[s:e], int(own[s]), few)
                kept += [s + at for at in places]
                starts += start
                stops += stop
            of += [few] * (len(kept) - len(of))
        found = {"trial": trial[kept], "src": src[kept], "dst": dst[kept], "start": starts, "stop": [None if np.isinf(s) else int(s) for s in stops]}
        return pd.DataFrame(found | ({"k": of} if ks else {})).astype({"stop": "Int64"})

    thinned = _meetings(blocks, heads, thin, "trial int, src long, dst long, sim double, own int, y int")
    parts = max(1, (blocks.agg(F.sum("n")).first()[0] or 0) // MERGED)
    return thinned.groupBy("trial", F.pmod(F.xxhash64("src"), F.lit(parts))).applyInPandas(merge, "trial int, src long, dst long, start int, stop int" + (", k int" if ks else ""))
