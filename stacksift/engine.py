"""The catalogue as an object: what the read-only interface and the command line offer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import search as S
from .operators.recommend import diversified

MOST = 50


class Engine:
    """Over works (work, title, author, language, series, position, popularity, number)."""

    def __init__(self, works: DataFrame, visible: DataFrame | None = None):
        self.works = works if visible is None else works.join(visible.select("work"), "work", "left_semi")
        self.index = S.build(self.works)

    def search(self, query: str, page: int = 0, limit: int = 20) -> tuple[list, bool]:
        """A page of hits, and whether another follows."""
        page, limit = min(max(page, 0), MOST), min(max(limit, 1), MOST)
        rows = S.search(self.index, query, (page + 1) * limit + 1).collect()[page * limit :]
        return rows[:limit], len(rows) > limit

    def work(self, work: int):
        return self.works.filter(F.col("work") == work).first()

    def author(self, author: str) -> DataFrame:
        return self.works.filter(F.col("author") == author).orderBy(F.col("popularity").desc(), "work")

    def series(self, series: str) -> DataFrame:
        return self.works.filter(F.col("series") == series).orderBy("position", "work")

    def number(self, number: str):
        return self.works.filter(F.col("number") == number.replace("-", "")).first()

    def similar(self, work: int, limit: int = 12) -> DataFrame:
        """Works that share words of the title, one of an author, 0.7 of the overlap and 0.3 of the popularity."""
        mine = self.index.postings.filter((F.col("work") == work) & (F.col("field") == "title")).select("term")
        shared = self.index.postings.filter(f"field = 'title' AND work <> {int(work)}").join(mine, "term").join(self.index.terms, "term")
        score = shared.groupBy("work").agg(F.sum(1 / F.log(F.col("df") + 2.0)).alias("overlap")).join(self.works, "work").withColumn("score", 0.7 * F.col("overlap") + 0.3 * F.col("popularity"))
        best = score.groupBy("author").agg(F.max(F.struct("score", (-F.col("work")).alias("minus"))).alias("b"))
        return best.select((-F.col("b.minus")).alias("work"), "author", F.round("b.score", 6).alias("score")).orderBy(F.col("score").desc(), "work").limit(limit)

    def suggest(self, text: str) -> dict:
        """Up to two authors and six works."""
        start = text.lower()
        authors = self.works.select("author").distinct().filter(F.lower("author").contains(start)).orderBy(F.length("author"), "author").limit(2).collect()
        return {"authors": [r["author"] for r in authors], "works": [r["work"] for r in S.search(self.index, text, 6).collect()]}

    def languages(self) -> DataFrame:
        return self.works.groupBy("language").agg(F.count("*").alias("works")).orderBy(F.col("works").desc(), "language")

    def catalogue(self, language: str, limit: int = 100) -> DataFrame:
        return self.works.filter(F.col("language") == language).orderBy(F.col("popularity").desc(), "work").limit(limit)

    def screen(self, text: str) -> dict:
        """Completions, authors, works and facets of one query."""
        last = text.lower().split()[-1:] or [""]
        hits = S.search(self.index, text, 20)
        facets = hits.join(self.works.select("work", "language"), "work").groupBy("language").agg(F.count("*").alias("n")).filter("n >= 2").orderBy(F.col("n").desc(), "language").limit(5)
        return {**self.suggest(text), "completions": [r["term"] for r in S.completions(self.index, last[0]).collect()], "facets": [(r["language"], r["n"]) for r in facets.collect()]}

    def recommend(self, kind: str, seed, limit: int = 12) -> DataFrame:
        """(work, place) for a seed: a ``work``, a ``writer``, a ``saga`` (a series' name), a ``mix`` of works, or a ``library``
        of works with weights. None of the seeds comes back, and no author more than twice."""
        if kind not in ("work", "writer", "saga", "mix", "library"):
            raise ValueError(f"no such seed: {kind}")
        w = self.works
        if kind in ("writer", "saga"):
            seeds = w.filter(F.col("author" if kind == "writer" else "series") == seed).select("work", F.lit(1.0).alias("weight"))
        else:
            given = {"work": lambda: [(seed, 1.0)], "mix": lambda: [(x, 1.0) for x in seed], "library": lambda: list(seed.items())}[kind]()
            seeds = w.sparkSession.createDataFrame([(int(k), float(v)) for k, v in given], "work long, weight double")
        idf = self.index.terms.select("term", (1 / F.log(F.col("df") + 2.0)).alias("idf"))
        titles = self.index.postings.filter("field = 'title'").select("work", "term")
        taste = titles.join(F.broadcast(seeds), "work").groupBy("term").agg(F.sum("weight").alias("weight")).join(idf, "term")  # one seed's works
        found = titles.join(F.broadcast(seeds.select("work")), "work", "left_anti").join(taste, "term").groupBy("work").agg(F.sum(F.col("weight") * F.col("idf")).alias("overlap"))
        scored = found.join(w, "work").select(F.lit(1).cast("long").alias("request"), "work", "author", F.col("language").alias("cluster"), "title", (0.7 * F.col("overlap") + 0.3 * F.col("popularity")).alias("score"))
        best = scored.orderBy(F.col("score").desc(), "work").limit(5 * limit)
        return diversified(best, limit).select("work", "place")

    def evaluate(self, rank: Callable[[Engine, int], list[int]], expected: dict[int, set[int]], depth: int = 20) -> dict[str, float]:
        """Recall and mean reciprocal rank of any ranking, given as a function of the engine and a work."""
        recall, reciprocal = [], []
        for work, wanted in expected.items():
            got = rank(self, work)[:depth]
            recall.append(len(wanted.intersection(got)) / max(1, len(wanted)))
            reciprocal.append(next((1 / n for n, x in enumerate(got, 1) if x in wanted), 0.0))
        return {"recall": sum(recall) / max(1, len(recall)), "mrr": sum(reciprocal) / max(1, len(reciprocal))}

    def resolve(self, work: int, other: Callable[[int], object] | None = None):
        """A work of this catalogue, else what another one's look-up gives."""
        return self.work(work) or (other(work) if other else None)
