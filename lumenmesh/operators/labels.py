"""View labels of faces: smoothing, region growing, energy minimisation over regions.

The sequential methods run over one connected region each; regions are bounded by the mesh of one object.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenmesh.operators.graph import components


def smooth_labels(labels: DataFrame, adjacency: DataFrame, support: DataFrame, gain: float = 1.05, least: int = 2) -> DataFrame:
    """labels: fid, view of locked faces; adjacency: fid, nbr of faces of like direction; support: fid, view, support. In order
    of fid, in place: a face with enough locked neighbours takes the view that they support most, of those that it
    supports itself, if that beats its own by `gain`."""
    near = adjacency.join(labels.select(F.col("fid").alias("nbr")), "nbr", "left_semi").join(labels.select("fid"), "fid", "left_semi")
    groups = components(near.where("fid < nbr").select(F.col("fid").alias("u"), F.col("nbr").alias("v"))).withColumnRenamed("node", "fid")
    nbrs = near.groupBy("fid").agg(F.sort_array(F.collect_list("nbr")).alias("nbrs"))
    held = support.groupBy("fid").agg(F.map_from_entries(F.collect_list(F.struct("view", "support"))).alias("support"))
    rows = labels.join(groups, "fid", "left").join(nbrs, "fid", "left").join(held, "fid", "left").select("fid", "view", F.coalesce("root", "fid").alias("region"), "nbrs", "support")

    def run(pdf):
        pdf = pdf.sort_values("fid")
        view = dict(zip(pdf["fid"], pdf["view"]))
        has = {f: dict(s) if s is not None else {} for f, s in zip(pdf["fid"], pdf["support"])}
        for f, ns in zip(pdf["fid"], pdf["nbrs"]):
            if ns is None or len(ns) < least:
                continue
            votes: dict[int, float] = {}
            for n in ns:
                v = view[n]
                if v in has[f]:
                    votes[v] = votes.get(v, 0.0) + has[n].get(v, 0.0)
            if votes:
                best = min(votes, key=lambda v: (-votes[v], v))
                if best != view[f] and votes[best] > gain * votes.get(view[f], 0.0):
                    view[f] = best
        pdf["view"] = [view[f] for f in pdf["fid"]]
        return pdf[["fid", "view"]]

    return rows.groupBy("region").applyInPandas(run, "fid long, view long")


def regions(seeds: DataFrame, adjacency: DataFrame, normals: DataFrame, label_sets: DataFrame, least_dot: float = 0.92) -> DataFrame:
    """fid, region: from seed faces over neighbours of like direction that share a label. normals: fid, nx, ny, nz (unit);
    label_sets: fid, views (array)."""
    a = normals.join(label_sets, "fid")
    b = a.select(F.col("fid").alias("nbr"), *(F.col(c).alias(f"b{c}") for c in ("nx", "ny", "nz", "views")))
    dot = sum(F.col(f"n{x}") * F.col(f"bn{x}") for x in "xyz")
    links = adjacency.where("fid < nbr").join(a, "fid").join(b, "nbr").where((dot >= least_dot) & F.arrays_overlap("views", "bviews"))
    found = components(links.select(F.col("fid").alias("u"), F.col("nbr").alias("v"))).withColumnRenamed("node", "fid")
    of = normals.select("fid").join(found, "fid", "left").select("fid", F.coalesce("root", "fid").alias("region"))
    return of.join(of.join(seeds, "fid", "left_semi").select("region").distinct(), "region", "left_semi").select("fid", "region")


def label_regions(faces: DataFrame, links: DataFrame, sweeps: int = 4, missing: float = 1.5, pair: float = 0.55, least_faces: int = 3) -> DataFrame:
    """faces: fid, region, base (view), costs (map of view to cost); links: fid, nbr, weight (0 to 1) within regions. Iterated
    conditional modes: faces in order of the margin between their two cheapest views, then fid, take the view with the least
    own cost plus that of disagreeing with their neighbours; regions of too few faces keep their base."""
    near = links.groupBy("fid").agg(F.sort_array(F.collect_list(F.struct("nbr", "weight"))).alias("near"))
    rows = faces.join(near, "fid", "left")

    def run(pdf):
        if len(pdf) < least_faces:
            pdf["view"] = pdf["base"]
            return pdf[["fid", "region", "view"]]
        cost = {f: dict(c) for f, c in zip(pdf["fid"], pdf["costs"])}
        view = dict(zip(pdf["fid"], pdf["base"]))
        near = {f: [(n["nbr"], n["weight"]) for n in ns] if ns is not None else [] for f, ns in zip(pdf["fid"], pdf["near"])}
        every = sorted({v for c in cost.values() for v in c})

        def margin(f):
            two = sorted(cost[f].values())[:2]
            return two[1] - two[0] if len(two) > 1 else missing

        for _ in range(sweeps):
            changed = False
            for f in sorted(cost, key=lambda f: (margin(f), f)):
                def energy(v):
                    return cost[f].get(v, missing) + sum(pair * (0.25 + 0.75 * w) for n, w in near[f] if view.get(n, v) != v)

                best = min(every, key=lambda v: (energy(v), v))
                if energy(best) < energy(view[f]) - 1e-12:
                    view[f], changed = best, True
            if not changed:
                break
        pdf["view"] = [view[f] for f in pdf["fid"]]
        return pdf[["fid", "region", "view"]]

    return rows.groupBy("region").applyInPandas(run, "fid long, region long, view long")
