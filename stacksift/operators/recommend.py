"""Greedy steps of recommendation over one request's bounded candidates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

AUTHOR_DECAY, CLUSTER_DECAY, PER_AUTHOR, WINDOW = 0.55, 0.85, 2, 5


def _greedy(limit: int):
    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "work"], ascending=[False, True]).reset_index(drop=True)
        window, rest = list(rows.index[: WINDOW * limit]), list(rows.index[WINDOW * limit :])
        authors: dict = {}
        clusters: dict = {}
        titles: set = set()
        out = []
        while len(out) < limit and (window or rest):
            if not window:
                window, rest = rest[: WINDOW * limit], rest[WINDOW * limit :]
            value = [rows.score[i] * AUTHOR_DECAY ** authors.get(rows.author[i], 0) * CLUSTER_DECAY ** clusters.get(rows.cluster[i], 0) for i in window]
            at = max(range(len(window)), key=lambda j: (round(value[j], 12), -rows.work[window[j]]))
            i = window.pop(at)
            if rows.title[i] in titles or authors.get(rows.author[i], 0) >= PER_AUTHOR:
                continue
            titles.add(rows.title[i])
            authors[rows.author[i]] = authors.get(rows.author[i], 0) + 1
            clusters[rows.cluster[i]] = clusters.get(rows.cluster[i], 0) + 1
            out.append((rows.request[i], rows.work[i], len(out) + 1))
        return pd.DataFrame(out, columns=["request", "work", "place"])

    return pick


def diversified(candidates: DataFrame, limit: int = 12) -> DataFrame:
    """(request, work, place) from (request, work, author, cluster, title, score), a bounded list for each request."""
    return candidates.groupBy("request").applyInPandas(_greedy(limit), "request long, work long, place long")


def _clusters(overlap: float):
    def group(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["weight", "work"], ascending=[False, True])
        groups: list[tuple[set, list]] = []
        for r in rows.itertuples():
            have = set(r.tags)
            best = max(groups, key=lambda g: len(g[0] & have) / max(1, len(have)), default=None)
            if best and len(best[0] & have) / max(1, len(have)) >= overlap:
                best[0].update(have)
                best[1].append(r.work)
            else:
                groups.append((set(have), [r.work]))
        out = [(rows.request.iloc[0], w, n) for n, (_, works) in enumerate(groups) for w in works]
        return pd.DataFrame(out, columns=["request", "work", "cluster"])

    return group


def taste_clusters(sources: DataFrame, overlap: float = 0.7) -> DataFrame:
    """(request, work, cluster) from (request, work, weight, tags): by falling weight each joins the group it overlaps most."""
    return sources.groupBy("request").applyInPandas(_clusters(overlap), "request long, work long, cluster long")
