"""Undirected graphs as link tables (a < b): degrees, clustering, components, label propagation, recurring communities, overlaps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def both_ways(links: DataFrame) -> DataFrame:
    return links.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v")


def degrees(links: DataFrame) -> DataFrame:
    """node, degree of every node that has a link."""
    return both_ways(links).groupBy(F.col("u").alias("node")).agg(F.count("*").alias("degree"))


def without_isolates(nodes: DataFrame, links: DataFrame, key: str) -> DataFrame:
    ends = both_ways(links).select(F.col("u").alias(key)).distinct()
    return nodes.join(ends, key, "left_semi")


def clustering(links: DataFrame) -> DataFrame:
    """node, degree, triangles, coefficient 2T / (d (d - 1)); 0 for a degree under 2.

    Links point to the end of the larger degree, so a node has few wedges whatever its degree, and each triangle is found once.
    """
    d = degrees(links)
    da, db = d.select(F.col("node").alias("a"), F.col("degree").alias("da")), d.select(F.col("node").alias("b"), F.col("degree").alias("db"))
    ends = links.join(da, "a").join(db, "b")
    low = F.struct("da", "a") < F.struct(F.col("db").alias("da"), F.col("b").alias("a"))
    pointed = ends.select(F.when(low, F.col("a")).otherwise(F.col("b")).alias("s"), F.when(low, F.col("b")).otherwise(F.col("a")).alias("t"))
    other = pointed.select("s", F.col("t").alias("t2"))
    wedges = pointed.join(other, "s").where("t < t2")
    closed = wedges.join(links.select(F.col("a").alias("t"), F.col("b").alias("t2")), ["t", "t2"])
    per_node = closed.select(F.explode(F.array("s", "t", "t2")).alias("node")).groupBy("node").agg(F.count("*").alias("triangles"))
    t = F.coalesce("triangles", F.lit(0)).cast("long")
    return d.join(per_node, "node", "left").select("node", "degree", t.alias("triangles"), F.when(F.col("degree") < 2, 0.0).otherwise(2 * t / (F.col("degree") * (F.col("degree") - 1))).alias("coefficient"))


def prune(links: DataFrame, least: float = 0.1) -> DataFrame:
    """Links between nodes whose clustering coefficient is over least."""
    kept = clustering(links).where(F.col("coefficient") > least).select("node")
    return links.join(kept.withColumnRenamed("node", "a"), "a", "left_semi").join(kept.withColumnRenamed("node", "b"), "b", "left_semi").select("a", "b")


def components(links: DataFrame, cut) -> DataFrame:
    """node, component: the smallest node reachable.  cut: stores a table and reads it again, to end its lineage.

    Labels spread to neighbours and jump to the label of the label, so the number of rounds grows with the logarithm
    of the longest path in practice.
    """
    sides = cut(both_ways(links).distinct())
    labels = cut(sides.groupBy(F.col("u").alias("node")).agg(F.min(F.least("u", "v")).alias("label")))
    while True:
        near = sides.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("label").alias("near"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = labels.join(near, F.col("node") == F.col("u")).join(jump, "label").select("node", F.least("label", "near", "far").alias("new"), "label")
        new = cut(new)
        if not new.where("new < label").limit(1).count():
            return labels.select("node", F.col("label").alias("component"))
        labels = new.select("node", F.col("new").alias("label"))


def label_propagation(links: DataFrame, rounds: int = 3, cut=lambda df: df) -> DataFrame:
    """node, label: rounds of the most frequent label among neighbours, all nodes at once, ties to the smallest label."""
    sides = both_ways(links)
    labels = sides.select(F.col("u").alias("node"), F.col("u").alias("label")).distinct()
    for _ in range(rounds):
        counted = sides.join(labels, F.col("v") == F.col("node")).groupBy("u", "label").agg(F.count("*").alias("n"))
        labels = cut(counted.groupBy(F.col("u").alias("node")).agg(F.min_by("label", F.struct((-F.col("n")).alias("n"), "label")).alias("label")))
    return labels


def recurring_members(communities: DataFrame, jaccard: float = 0.5, least: int = 5) -> DataFrame:
    """communities: run, resolution, seed, node, community.  resolution, place, core, seeds_seen, run, community: the groups of
    communities that return across seeds, with a row for each community in a group.

    In the order of seeds, a community joins the first group whose core it overlaps enough, and the core shrinks to what
    both hold; the fold depends on its order, so a resolution is one task (communities of one graph under a few seeds), which
    holds the cores and one seed's communities at a time.
    """

    def work(batches):
        folded, held, at = None, [], None
        for batch in batches:
            for own, part in batch.groupby(["resolution", "seed"], sort=True):
                if held and own != at:
                    folded.add(pd.concat(held))
                    held = []
                if folded is None or own[0] != at[0]:
                    if folded is not None:
                        yield from folded.rows()
                    folded = _Fold(float(own[0]), jaccard, least)
                held, at = [*held, part[["run", "community", "node"]]], own
        if held:
            folded.add(pd.concat(held))
            yield from folded.rows()

    rows = communities.select("resolution", "seed", "run", "community", "node").repartition("resolution").sortWithinPartitions("resolution", "seed", "community", "node")
    return rows.mapInPandas(work, "resolution double, place int, core string, seeds_seen int, run long, community long")


class _Fold:
    """Groups of communities of one resolution: cores as arrays, and who is in them; one seed is taken at a time."""

    def __init__(self, resolution: float, jaccard: float, least: int):
        self.resolution, self.jaccard, self.least = resolution, jaccard, least
        self.cores: list[np.ndarray] = []
        self.held: list[list[tuple[int, int]]] = []

    def add(self, rows: pd.DataFrame) -> None:
        """rows: run, community, node of a seed, in the order of communities and nodes."""
        community, node = rows["community"].to_numpy(), rows["node"].to_numpy()
        run = int(rows["run"].iloc[0])
        first = np.flatnonzero(np.append(True, community[1:] != community[:-1]))
        sizes = np.diff(first, append=len(node))
        known = len(self.cores)
        lengths = np.array([len(c) for c in self.cores], np.int64)
        flat, owner = np.concatenate([*self.cores, np.zeros(0, np.int64)]), np.repeat(np.arange(known), lengths)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        low = np.searchsorted(flat, node)
        n = np.searchsorted(flat, node, "right") - low
        of = np.repeat(np.repeat(np.arange(len(first)), sizes), n)
        key, shared = np.unique(of * max(known, 1) + owner[np.arange(len(of)) - np.repeat(n.cumsum() - n, n) + np.repeat(low, n)], return_counts=True)
        c, g = key // max(known, 1), key % max(known, 1)
        apart = len(np.unique(node)) == len(node)
        if apart:  # what one community does to a core leaves nothing in it for the others
            enough = shared / (sizes[c] + lengths[g] - shared) >= self.jaccard
            c, g = c[enough], g[enough]
        bounds = np.searchsorted(c, np.arange(len(first) + 1)).tolist()
        taken: set[int] = set()
        for i, (s, size) in enumerate(zip(first.tolist(), sizes.tolist())):
            if size < self.least:
                continue
            own = node[s : s + size]
            asked = g[bounds[i] : bounds[i + 1]].tolist()
            for at in asked if apart else [*asked, *range(known, len(self.cores))]:
                if apart and at in taken:
                    continue
                both = np.intersect1d(own, self.cores[at], assume_unique=True)
                if len(both) / (size + len(self.cores[at]) - len(both)) >= self.jaccard:
                    self.cores[at] = both
                    taken.add(at)
                    break
            else:
                at = len(self.cores)
                self.cores.append(own.copy())
                self.held.append([])
            self.held[at].append((run, int(community[s])))

    def rows(self):
        found, told = [], 0
        for place, (core, held) in enumerate(zip(self.cores, self.held)):
            name = ",".join(map(str, core.tolist()))
            found += [(self.resolution, place, name, len(held), run, community) for run, community in held]
            told += len(name) * len(held)
            if told > 1 << 22:
                yield pd.DataFrame(found, columns=["resolution", "place", "core", "seeds_seen", "run", "community"])
                found, told = [], 0
        if found:
            yield pd.DataFrame(found, columns=["resolution", "place", "core", "seeds_seen", "run", "community"])


def recurring(communities: DataFrame, seeds: int, share: float = 0.6) -> DataFrame:
    """resolution, core, size, seeds_seen, stable of each group of recurring_members(); stable: seen in at least that share of the seeds."""
    groups = recurring_members(communities).select("resolution", "place", "core", "seeds_seen").distinct()
    return groups.select("resolution", "core", F.size(F.split("core", ",")).alias("size"), "seeds_seen", (F.col("seeds_seen") >= share * seeds).alias("stable"))


#: Members of a set that are carried along with each of them at most.
WIDE = 64


def numbered(sets: DataFrame, key: str, member: str, cut) -> DataFrame:
    """k and m, a number for each different member, of every row.  cut: stores a table, so that the numbers stay."""
    rows = sets.select(F.col(key).alias("k"), F.col(member).alias("member"))
    numbers = cut(rows.select("member").distinct().withColumn("m", F.monotonically_increasing_id()))
    return rows.join(numbers, "member").select("k", "m")


def shared_pairs(sets: DataFrame, key: str, member: str, cut) -> DataFrame:
    """src, dst of every two keys that share a member, both ways, each once; sets: distinct rows of key and member.

    A row carries its whole set, so a pair is told at the smallest shared member and no list of pairs is moved to find those
    that repeat.  Only pairs with a set of more than WIDE members are.
    """
    rows = numbered(sets, key, member, cut).groupBy("k").agg(F.array_sort(F.collect_list("m")).alias("ms"))
    rows = cut(rows)
    wide = F.size("ms") > WIDE
    side = lambda of, k, ms: of.select(F.col("k").alias(k), *([F.col("ms").alias(ms)] if ms else []), F.explode("ms").alias("m"))
    narrow = rows.where(~wide)
    both = side(narrow, "src", "x").join(side(narrow, "dst", "y"), "m").where("src <> dst")
    found = both.where(F.get(F.array_intersect("x", "y"), F.lit(0)) == F.col("m")).select("src", "dst")
    large = rows.where(wide)
    if large.isEmpty():
        return found
    others = side(large, "src", None).join(side(rows, "dst", None), "m").unionByName(side(narrow, "src", None).join(side(large, "dst", None), "m"))
    return found.unionByName(others.where("src <> dst").select("src", "dst").distinct())


def _rarest_first(sets: DataFrame, key: str, member: str) -> DataFrame:
    """k, ms (the members, from the rarest on), n."""
    often = sets.groupBy(member).agg(F.count("*").alias("often"))
    rows = sets.join(often, member).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("often", F.col(member).alias("m")))).alias("ms"))
    return rows.select(F.col(key).alias("k"), F.transform("ms", lambda x: x["m"]).alias("ms"), F.size("ms").alias("n"))


def _meeting(smaller: DataFrame, larger: DataFrame, least: float, carry: bool) -> DataFrame:
    """m, small, large, ns (and, carried along, x and y, their members) where a rare member of a smaller set is held by a larger one."""
    need = F.ceil(F.lit(least) * F.col("n") - 1e-9).cast("int")
    own = lambda name: [F.col("ms").alias(name)] if carry else []
    asked = smaller.select(F.col("k").alias("small"), F.col("n").alias("ns"), *own("x"), need.alias("need"), F.posexplode(F.slice("ms", F.lit(1), F.greatest(F.col("n") - need + 1, F.lit(1)))).alias("ps", "m"))
    held = larger.select(F.col("k").alias("large"), F.col("n").alias("nl"), *own("y"), F.posexplode("ms").alias("pl", "m"))
    order = F.struct(F.col("ns").alias("n"), F.col("small").alias("k")) < F.struct(F.col("nl").alias("n"), F.col("large").alias("k"))
    enough = F.least(F.col("ns") - F.col("ps"), F.col("nl") - F.col("pl")) >= F.col("need")
    return asked.join(held, "m").where(order & enough)


def overlap_candidates(sets: DataFrame, key: str, member: str, least: float) -> tuple[DataFrame, DataFrame]:
    """Rows of arrays (key, members from the rarest on, n), and the pairs small, large of keys that can share `least` of the smaller set.

    A set of n members shares ceil(least n) or more with a larger one, so one of its rarest n - ceil(least n) + 1 is
    shared: only these are asked for.  The first shared member must leave enough members behind it on both sides.
    """
    rows = _rarest_first(sets, key, member)
    return rows, _meeting(rows, rows, least, False).select("small", "large").distinct()


def overlaps(sets: DataFrame, key: str, member: str, cut, least: float = 0.5) -> DataFrame:
    """a < b, shared, overlap: |A and B| / min(|A|, |B|) of the sets (distinct rows of key and member) that share a member, where that is least (over 0) or more.

    Candidates come from the rarest members of the smaller set, so a member that most sets hold asks for nothing unless a set
    has no rarer one.  Both carry their members, so a pair is decided where they meet, at the first member they share; only where
    the larger set has more than WIDE members are candidates listed first.  cut: stores a table and reads it again.
    """
    rows = cut(_rarest_first(numbered(sets, key, member, cut), "k", "m"))
    narrow, wide = rows.where(F.col("n") <= WIDE), rows.where(F.col("n") > WIDE)
    both = _meeting(narrow, narrow, least, True).withColumn("shared", F.array_intersect("x", "y")).where(F.get("shared", F.lit(0)) == F.col("m"))
    found = both.select("small", "large", "ns", F.size("shared").cast("long").alias("shared"))
    if not wide.isEmpty():
        pairs = cut(_meeting(rows, wide, least, False).select("small", "large").distinct())
        side = lambda name, ms: rows.select(F.col("k").alias(name), F.col("ms").alias(ms), F.col("n").alias("ns" if ms == "x" else "nl"))
        listed = pairs.join(side("small", "x"), "small").join(side("large", "y"), "large")
        found = found.unionByName(listed.select("small", "large", "ns", F.size(F.array_intersect("x", "y")).cast("long").alias("shared")))
    found = found.withColumn("overlap", F.col("shared") / F.col("ns")).where((F.col("shared") > 0) & (F.col("overlap") >= least))
    return found.select(F.least("small", "large").alias("a"), F.greatest("small", "large").alias("b"), "shared", "overlap")
