"""An inverted index over works, and typo-tolerant ranked search on it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import saved

#: Weights of kinds of match, depth of the rerank, floor of the results.
AUTHOR, LONG_COMPLETION, SHORT_COMPLETION, ONE_EDIT, TWO_EDITS = 0.85, 0.9, 0.75, 0.72, 0.5
DEPTH, FLOOR, COMPLETIONS, ANCHOR = 250, 0.45, 12, 0.8
#: Frequencies below which a token or its completions are rare, misspellings of a token, and bonuses for title and
#: author together, for an author alone and for the first of a series.
RARE, RARE_COMPLETIONS, FUZZY, COMBO, AUTHOR_ALONE, SERIES_START = 50, 20, 60, 0.5, 1.0, 0.9


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


@dataclass
class Index:
    works: DataFrame
    postings: DataFrame
    terms: DataFrame
    grams: DataFrame


def grams(term: Column) -> Column:
    """Three letters each of a marked term."""
    marked = F.concat(F.lit("$"), term, F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(term))), lambda i: F.substring(marked, i, F.lit(3))))


def build(works: DataFrame) -> Index:
    """From (work, title, author, popularity): postings by term and field, terms with their frequency and their grams, written
    once for all queries."""
    parts = [works.select("work", F.explode(words(F.col(f))).alias("term"), F.lit(f).alias("field")) for f in ("title", "author")]
    postings = saved(parts[0].unionByName(parts[1]).distinct())
    terms = saved(postings.groupBy("term").agg(F.countDistinct("work").alias("df")))
    return Index(works, postings, terms, saved(terms.select("term", "df", F.explode(grams(F.col("term"))).alias("gram"))))


def expanded(index: Index, query: str) -> tuple[DataFrame, int]:
    """Terms that a query's tokens stand for, with their weights; and the number of tokens. The last token has its commonest
    completions; misspellings, met by shared grams, count only where the token itself and its completions are rare."""
    spark = index.works.sparkSession
    found = spark.range(1).select(words(F.lit(query)).alias("w")).first()["w"]
    tokens = spark.createDataFrame([(i, t) for i, t in enumerate(found)], "i int, token string")
    columns = ["i", "token", "term", "df", "weight"]
    rows = index.terms.filter(F.col("term").isin(*found)).join(tokens, F.col("term") == F.col("token")).withColumn("weight", F.lit(1.0)).select(*columns)
    if found and len(found[-1]) >= 2:
        best = index.terms.filter(F.startswith("term", F.lit(found[-1])) & (F.col("term") != found[-1])).orderBy(F.col("df").desc(), "term").limit(COMPLETIONS)
        weight = LONG_COMPLETION if len(found[-1]) >= 4 else SHORT_COMPLETION
        rows = rows.unionByName(best.select(F.lit(len(found) - 1).alias("i"), F.lit(found[-1]).alias("token"), "term", "df", F.lit(weight).alias("weight")))
    own, longer = F.sum(F.when(F.col("weight") == 1, F.col("df"))), F.sum(F.when(F.col("weight") < 1, F.col("df")))
    held = {r["i"]: (r["own"] or 0, r["longer"] or 0) for r in rows.groupBy("i").agg(own.alias("own"), longer.alias("longer")).collect()}  # a row a token
    sparse = [(i, t) for i, t in enumerate(found) if len(t) > 3 and held.get(i, (0, 0))[0] < RARE and (held.get(i, (0, 0))[1] < RARE_COMPLETIONS or not held.get(i, (0, 0))[0])]
    if sparse:
        asked = spark.createDataFrame(sparse, "i int, token string")
        met = index.grams.join(F.broadcast(asked.select("i", "token", F.explode(grams(F.col("token"))).alias("gram"))), "gram").groupBy("i", "token", "term").agg(F.first("df").alias("df"))  # the tokens of one query
        allowed, edits = F.when(F.length("token") <= 6, 1).otherwise(2), F.levenshtein("token", "term")
        near = met.withColumn("edits", edits).filter((F.col("edits") >= 1) & (F.col("edits") <= allowed))
        place = F.row_number().over(Window.partitionBy("i").orderBy("edits", F.col("df").desc(), "term"))
        near = near.withColumn("place", place).filter(F.col("place") <= FUZZY).withColumn("weight", F.when(F.col("edits") == 1, ONE_EDIT).otherwise(TWO_EDITS))
        rows = rows.unionByName(near.select(*columns))
    best_of = rows.groupBy("i", "token", "term").agg(F.max("df").alias("df"), F.max("weight").alias("weight"))
    return best_of, len(found)


def search(index: Index, query: str, limit: int = 20) -> DataFrame:
    """(work, title, author, score), best first."""
    terms, n = expanded(index, query)
    total = index.works.count()
    idf = terms.groupBy("i").agg((F.log((F.lit(total) + 1.0) / (F.least(F.sum("df"), F.lit(total)) + 1)) + 1).alias("idf"))
    value = index.postings.join(F.broadcast(terms), "term").groupBy("i", "work").agg(F.max(F.col("weight") * F.when(F.col("field") == "author", AUTHOR).otherwise(1.0)).alias("v"))
    whole = idf.agg(F.sum("idf").alias("whole"))
    in_title = index.postings.filter("field = 'title'").join(F.broadcast(terms), "term").groupBy("work").agg(F.count_distinct("i").alias("titled"))
    by_author = index.postings.filter("field = 'author'").join(F.broadcast(terms), "term").groupBy("work").agg(F.count_distinct("i").alias("written"))
    text = value.join(F.broadcast(idf), "i").join(F.broadcast(whole)).groupBy("work").agg((F.sum(F.col("v") * F.col("idf")) / F.first("whole") * F.pow(F.count("*") / max(n, 1), F.lit(2))).alias("text"), F.count("*").alias("matched"), F.max("v").alias("best"), F.avg("v").alias("sure"))
    hits = text.filter((F.col("best") >= ANCHOR) | (F.col("matched") == n)).join(index.works, "work").orderBy((F.col("text") + 0.35 * F.col("popularity")).desc(), "work").limit(DEPTH)
    hits = hits.join(in_title, "work", "left").join(by_author, "work", "left").fillna(0, ["titled", "written"])
    asked = F.lit(query.lower().strip())
    title = F.lower("title")
    bonus = F.when(title == asked, 1.0).when(title.startswith(asked), 0.5).when(title.contains(asked), 0.4).otherwise(0.0)
    bonus = bonus + F.when((F.col("titled") >= 1) & (F.col("titled") < n) & (F.col("titled") + F.col("written") >= n), COMBO).otherwise(0.0)
    bonus = bonus + F.when((F.col("written") == n) & (F.col("titled") < n), AUTHOR_ALONE * F.col("sure")).otherwise(0.0)
    if {"series", "position"} <= set(index.works.columns):
        bonus = bonus + F.when((F.lower("series") == asked) & (F.col("position") == 1), SERIES_START).otherwise(0.0)
    scored = hits.withColumn("score", F.col("text") + bonus + 0.95 * F.col("popularity") * F.col("matched") / max(n, 1) + 0.4 * F.least(F.lit(1.0), F.col("matched") / max(n, 1)))
    best = scored.agg(F.max("score").alias("top"))
    kept = scored.join(F.broadcast(best)).filter(F.col("score") >= FLOOR * F.col("top"))
    return kept.select("work", "title", "author", F.round("score", 6).alias("score")).orderBy(F.col("score").desc(), "work").limit(limit)


def completions(index: Index, prefix: str, limit: int = COMPLETIONS) -> DataFrame:
    return index.terms.filter(F.col("term").startswith(prefix.lower())).orderBy(F.col("df").desc(), "term").limit(limit)


def soft_similarity(a: Column, b: Column) -> Column:
    """1 for equal words, 0.8 of the shared part for beginnings, 0.75 and 0.5 for one and two edits."""
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    partial = F.when(a.startswith(b) | b.startswith(a), F.lit(0.8) * short / long)
    edits = F.levenshtein(a, b)
    return F.when(a == b, 1.0).otherwise(F.coalesce(partial, F.when((long > 3) & (edits == 1), 0.75).when((long > 6) & (edits == 2), 0.5), F.lit(0.0)))


def line_matches(index: Index, lines: DataFrame, limit: int = 400) -> DataFrame:
    """Works for read lines (line, text): two shared words or a rare one, by IDF-weighted coverage of their titles."""
    total = F.lit(float(max(1, index.works.count())))
    seen = lines.select("line", F.explode(F.array_distinct(words(F.col("text")))).alias("term"))
    title = index.postings.filter("field = 'title'").join(index.terms, "term").withColumn("idf", F.log((total + 1) / (F.col("df") + 1)) + 1)
    whole = title.groupBy("work").agg(F.sum("idf").alias("whole"))
    met = seen.join(title, "term").groupBy("line", "work").agg(F.count("*").alias("n"), F.min("df").alias("rarest"), F.sum("idf").alias("covered"))
    found = met.filter((F.col("n") >= 2) | (F.col("rarest") <= 60)).join(whole, "work").withColumn("coverage", F.round(F.col("covered") / F.col("whole"), 6))
    order = Window.partitionBy("line").orderBy(F.round(F.col("coverage") * F.col("covered"), 9).desc(), "work")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit).select("line", "work", "coverage", "place")
