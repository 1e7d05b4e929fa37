"""Recommendations as plans: seeds, candidate scores, text rerank, mixing, kin, rows and evaluation; SQL written apart.

A brand is an author and a reader's taste at once: its cheaper works are read, the dearer ones candidates for other brands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .registry import query
from .rules import CHECK, read, scored

#: Tags that make a seed specific, works and weight that a sparse one borrows.
SPARSE, BORROWED, BORROWED_WEIGHT = 2, 6, 0.4
#: Weights of a candidate's score, its gates, and how fast eras part.
SIMILARITY, ERA, QUALITY, AFFINITY, LEAST, COVER, COVERED, ERA_SCALE, ERA_UNKNOWN, YOUNGER, OLDER, GAP = 0.60, 0.15, 0.35, 0.15, 0.2, 0.3, 0.7, 25.0, 0.4, 0.4, 0.15, 2
#: The text's weight, what titles of another language keep, letters of a word.
TEXT, FOREIGN, WORD = 0.8, 0.35, 4


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(work, author, tags, title, size): tags are the title's words and the type."""
    tags = F.array_distinct(F.array_append(F.split("p_name", " "), F.lower("p_type")))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("work"), F.col("p_brand").alias("author"), tags.alias("tags"), F.col("p_name").alias("title"), F.col("p_size").alias("size"))


@query(f"""WITH {CHECK}, own AS (SELECT p_partkey AS work, p_brand AS author, len(list_filter(list_distinct([split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), lower(p_type)]), lambda t: length(t) > 4)) AS specific FROM part),
ranked AS (SELECT own.*, score, row_number() OVER (PARTITION BY author ORDER BY score DESC, work) AS place FROM own JOIN m USING (work)), sparse AS (SELECT * FROM own WHERE specific < 2),
lent AS (SELECT sparse.work AS seed, ranked.work, ranked.specific, row_number() OVER (PARTITION BY sparse.work ORDER BY ranked.place) AS k FROM sparse JOIN ranked ON ranked.author = sparse.author AND ranked.work <> sparse.work AND ranked.place <= 7) SELECT seed, work, round(0.4 / 6, 6) AS weight FROM lent WHERE k <= 6 AND specific > 0""")
def seed_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds with few specific tags borrow from their author's six best other works."""
    rows = works(spark, sf_dir).withColumn("specific", F.size(F.filter("tags", lambda t: F.length(t) > 4)))
    return enriched(rows.filter(F.col("specific") < SPARSE).select("work", "author"), rows.join(scored(spark, sf_dir).select("work", "score"), "work"))


def enriched(seeds: DataFrame, rows: DataFrame) -> DataFrame:
    """(seed, work, weight) for seeds (work, author) from rows (work, author, score, specific): one more than is borrowed is
    ranked by author, as the seed itself may be among them."""
    best = rows.withColumn("place", F.row_number().over(Window.partitionBy("author").orderBy(F.col("score").desc(), "work"))).filter(F.col("place") <= BORROWED + 1)
    met = seeds.select(F.col("work").alias("seed"), "author").join(best, "author").filter("seed <> work")
    own = F.row_number().over(Window.partitionBy("seed").orderBy("place"))
    return met.withColumn("k", own).filter((F.col("k") <= BORROWED) & (F.col("specific") > 0)).select("seed", "work", F.round(F.lit(BORROWED_WEIGHT / BORROWED), 6).alias("weight"))


VECTORS = """t AS (SELECT DISTINCT p_partkey AS work, p_brand AS author, p_size AS size, unnest([split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), lower(p_type)]) AS tag FROM part), i AS (SELECT tag, ln((SELECT count(*) + 1.0 FROM part) / (count(*) + 1)) AS idf FROM t GROUP BY tag),
y AS (SELECT l_partkey AS work, min(year(l_shipdate)) AS year, avg(l_tax) AS quality FROM lineitem GROUP BY 1), v AS (SELECT t.*, idf, year, quality FROM t JOIN i USING (tag) JOIN y USING (work)),
taste AS (SELECT author AS reader, tag, sum(idf) AS w FROM v WHERE size <= 5 GROUP BY ALL), norm AS (SELECT reader, sqrt(sum(w * w)) AS norm FROM taste GROUP BY 1), about AS (SELECT author AS reader, avg(year) AS year, coalesce(stddev_pop(year), 0) AS spread FROM (SELECT DISTINCT work, author, year FROM v WHERE size <= 5) z GROUP BY 1),
pair AS (SELECT reader, v.work, sum(w * idf) AS dot, sum(w * w) AS covered FROM v JOIN taste USING (tag) WHERE v.size > 5 GROUP BY ALL), len AS (SELECT work, any_value(author) AS author, any_value(size) AS size, any_value(year) AS year, any_value(quality) AS quality, sqrt(sum(idf * idf)) AS len FROM v GROUP BY work),
s AS (SELECT reader, work, dot / (len * norm) AS sim, 0.3 + 0.7 * covered / (norm * norm) AS cover, exp(-abs(len.year - about.year) / (25 + spread)) AS era, quality, if(reader = author, 1, 0) AS affinity, size % 5 - 2 AS gap FROM pair JOIN len USING (work) JOIN norm USING (reader) JOIN about USING (reader)),
f AS (SELECT reader, work, (0.6 * sim * cover + 0.15 * era + 0.35 * quality + 0.15 * affinity) / (1 + 0.4 * greatest(0, -gap) + 0.15 * greatest(0, gap)) AS score FROM s WHERE sim > 0.2 AND abs(gap) <= 2)"""


@query(f"WITH {VECTORS} SELECT reader, work, round(score, 6) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY reader ORDER BY round(score, 9) DESC, work) AS place FROM f) x WHERE place <= 20")
def candidate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of each taste by similarity, coverage, era, quality and affinity, less for another audience; the best
    twenty."""
    rows = candidates(spark, sf_dir)
    place = F.row_number().over(Window.partitionBy("reader").orderBy(F.round("score", 9).desc(), "work"))
    return rows.withColumn("place", place.cast("long")).filter("place <= 20").select("reader", "work", F.round("score", 6).alias("score"), "place")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = works(spark, sf_dir)
    n = rows.count()
    facts = read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("work")).agg(F.min(F.year("l_shipdate")).alias("year"), F.avg("l_tax").alias("quality"))
    tagged = rows.select("work", "author", "size", F.explode("tags").alias("tag")).join(facts, "work")
    idf = tagged.groupBy("tag").agg(F.log((n + 1.0) / (F.count("*") + 1)).alias("idf"))
    tagged = tagged.join(idf, "tag")
    seeds = tagged.filter("size <= 5").withColumnRenamed("author", "reader")
    taste = seeds.groupBy("reader", "tag").agg(F.sum("idf").alias("w"))
    about = seeds.select("reader", "work", "year").distinct().groupBy("reader").agg(F.avg("year").alias("liked"), F.coalesce(F.stddev_pop("year"), F.lit(0.0)).alias("spread"))
    about = about.join(taste.groupBy("reader").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")), "reader")
    return candidate_scored(tagged.filter("size > 5"), taste, about)


def candidate_scored(tagged: DataFrame, taste: DataFrame, about: DataFrame) -> DataFrame:
    """(reader, work, score) for works (work, author, size, year, quality, tag, idf) that share a tag with a taste (reader, tag,
    w) of which (reader, liked, spread, norm) is known. Sums are built before readers and works are looked up again."""
    lengths = tagged.groupBy("work").agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("len"), F.first("author").alias("author"), F.first("size").alias("size"), F.first("year").alias("year"), F.first("quality").alias("quality"))
    pair = tagged.select("work", "tag", "idf").join(taste, "tag").groupBy("reader", "work").agg(F.sum(F.col("w") * F.col("idf")).alias("dot"), F.sum(F.col("w") * F.col("w")).alias("shared"))
    met = pair.join(lengths, "work").join(about, "reader")
    gap, similar = F.col("size") % 5 - 2, F.col("dot") / (F.col("len") * F.col("norm"))
    cover = COVER + COVERED * F.col("shared") / (F.col("norm") * F.col("norm"))
    era = F.when((F.col("year") > 0) & (F.col("liked") > 0), F.exp(-F.abs(F.col("year") - F.col("liked")) / (ERA_SCALE + F.col("spread")))).otherwise(ERA_UNKNOWN)
    affinity = (F.col("reader") == F.col("author")).cast("double")
    penalty = 1 + YOUNGER * F.greatest(F.lit(0), -gap) + OLDER * F.greatest(F.lit(0), gap)
    value = (SIMILARITY * similar * cover + ERA * era + QUALITY * F.col("quality") + AFFINITY * affinity) / penalty
    return met.filter((similar > LEAST) & (F.abs(gap) <= GAP)).select("reader", "work", value.alias("score"))


@query(r"""WITH w AS (SELECT source, doc_id, lang, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS term FROM documents), tf AS (SELECT source, doc_id, lang, term, count(*) AS n FROM w GROUP BY ALL), pool AS (SELECT source, count(DISTINCT doc_id) AS docs, min(doc_id) AS seed FROM documents GROUP BY 1),
df AS (SELECT source, term, count(*) FILTER (doc_id <> seed) AS df FROM tf JOIN pool USING (source) GROUP BY ALL), x AS (SELECT tf.*, seed, (1 + ln(n)) * ln((docs + 1.0) / (df + 1.0)) AS w FROM tf JOIN pool USING (source) JOIN df USING (source, term)),
q AS (SELECT source, term, w AS q, lang AS own FROM x WHERE doc_id = seed), d AS (SELECT x.source, doc_id, x.lang, sum(w * coalesce(q, 0)) AS dot, sqrt(sum(w * w)) AS norm FROM x LEFT JOIN q ON q.source = x.source AND q.term = x.term WHERE doc_id <> seed GROUP BY ALL),
z AS (SELECT source, sqrt(sum(q * q)) AS qnorm, any_value(own) AS own FROM q GROUP BY 1) SELECT source, doc_id, round((0.5 + 0.8 * CASE WHEN norm > 0 AND qnorm > 0 THEN dot / (norm * qnorm) ELSE 0 END) * if(lang = own, 1, 0.35), 6) AS score FROM d JOIN z USING (source)""")
def text_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's texts against its first one, terms weighted by how many of the source's others have them; other
    languages count for less."""
    docs = read(spark, sf_dir, "documents").select(F.col("source").alias("pool"), F.col("doc_id").alias("work"), "lang", "text")
    seeds = docs.groupBy("pool").agg(F.min("work").alias("seed"), F.count_distinct("work").alias("works"))
    return reranked(docs.withColumn("score", F.lit(0.5)), seeds).select(F.col("pool").alias("source"), F.col("work").alias("doc_id"), F.round("score", 6).alias("score"))


def reranked(docs: DataFrame, seeds: DataFrame) -> DataFrame:
    """(pool, work, score) of a pool's texts (pool, work, lang, text, score) with the cosine to the seed's text added."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(rf"[a-z]{{{WORD},}}"), F.lit(0))
    counts = docs.select("pool", "work", F.explode(words).alias("term")).groupBy("pool", "work", "term").agg(F.count("*").alias("n")).join(seeds, "pool")
    others = F.sum((F.col("work") != F.col("seed")).cast("long")).over(Window.partitionBy("pool", "term"))
    weighed = counts.withColumn("w", (1 + F.log("n")) * F.log((F.col("works") + 1.0) / (others + 1.0)))
    asked = weighed.filter("work = seed").select("pool", "term", F.col("w").alias("q"))
    norm = asked.groupBy("pool").agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("qnorm"))
    met = weighed.filter("work <> seed").join(asked, ["pool", "term"], "left").groupBy("pool", "work").agg(F.sum(F.col("w") * F.coalesce("q", F.lit(0.0))).alias("dot"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    tongue = docs.join(seeds, "pool").filter("work = seed").select("pool", F.col("lang").alias("own"))
    cosine = F.when((F.col("norm") > 0) & (F.col("qnorm") > 0), F.col("dot") / (F.col("norm") * F.col("qnorm"))).otherwise(0.0)
    rows = met.join(norm, "pool").join(docs.select("pool", "work", "lang", "score"), ["pool", "work"]).join(tongue, "pool")
    return rows.select("pool", "work", ((F.col("score") + TEXT * cosine) * F.when(F.col("lang") == F.col("own"), 1.0).otherwise(FOREIGN)).alias("score"))


@query(f"""WITH {VECTORS}, c AS (SELECT reader AS cluster, left(reader, 7) AS request, norm AS weight FROM norm), h AS (SELECT request, max(weight) AS top FROM c GROUP BY 1), k AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY request ORDER BY weight DESC, cluster) <= 4),
x AS (SELECT request, f.work, cluster, score * (0.5 + 0.5 * weight / top) AS score FROM k JOIN h USING (request) JOIN f ON f.reader = k.cluster), b AS (SELECT *, row_number() OVER (PARTITION BY request, work ORDER BY round(score, 9) DESC, cluster) AS r FROM x) SELECT request, work, cluster, round(score, 6) AS score FROM b WHERE r = 1""")
def cluster_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request's four heaviest clusters with their candidates, scaled by the cluster's share; of each work the best."""
    rows = candidates(spark, sf_dir).withColumnRenamed("reader", "cluster")
    tagged = works(spark, sf_dir)
    n = tagged.count()
    idf = tagged.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.log((n + 1.0) / (F.count("*") + 1)).alias("idf"))
    weights = tagged.filter("size <= 5").select(F.col("author").alias("cluster"), F.explode("tags").alias("tag")).join(idf, "tag").groupBy("cluster", "tag").agg(F.sum("idf").alias("w")).groupBy("cluster").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("weight"))
    return mixed(rows, weights.withColumn("request", F.substring("cluster", 1, 7))).select("request", "work", "cluster", F.round("score", 6).alias("score"))


def mixed(rows: DataFrame, clusters: DataFrame, most: int = 4) -> DataFrame:
    """(request, work, cluster, score) from (cluster, work, score) and (request, cluster, weight)."""
    by = Window.partitionBy("request")
    heavy = clusters.withColumn("top", F.max("weight").over(by)).withColumn("k", F.row_number().over(by.orderBy(F.col("weight").desc(), "cluster"))).filter(F.col("k") <= most)
    scaled = rows.join(heavy, "cluster").withColumn("score", F.col("score") * (0.5 + 0.5 * F.col("weight") / F.col("top")))
    best = F.struct((-F.round("score", 9)).alias("minus"), "cluster", "score")
    return scaled.groupBy("request", "work").agg(F.min(best).alias("b")).select("request", "work", "b.cluster", "b.score")


@query("""WITH k AS (SELECT p_brand AS author, list_distinct(flatten(list(list_filter(split(p_name, ' '), lambda w: length(w) >= 4 AND w <> 'widget')))) AS kin FROM part WHERE p_size <= 3 GROUP BY 1)
SELECT p_partkey AS work, len(list_intersect(kin, split(p_name, ' '))) > 0 AS blocked FROM part JOIN k ON author = p_brand WHERE p_size > 3""")
def kin_blocking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works whose title shares a distinctive word with a seed by the same author."""
    rows = works(spark, sf_dir)
    words = F.filter(F.split("title", " "), lambda w: (F.length(w) >= WORD) & (w != "widget"))
    kin = rows.filter("size <= 3").groupBy("author").agg(F.array_distinct(F.flatten(F.collect_set(words))).alias("kin"))
    return rows.filter("size > 3").join(kin, "author").select("work", F.arrays_overlap("kin", F.split("title", " ")).alias("blocked"))


ROWS_CHECK = """w AS (SELECT p_partkey AS work, p_brand AS reader, p_name AS title, p_size, p_retailprice, p_type FROM part),
a AS (SELECT * FROM w WHERE p_size % 4 = 1 QUALIFY row_number() OVER (PARTITION BY reader ORDER BY p_size, work) <= 4),
b AS (SELECT * FROM w WHERE p_type = 'SMALL' AND NOT EXISTS (SELECT 1 FROM a WHERE a.reader = w.reader AND a.title = w.title) QUALIFY row_number() OVER (PARTITION BY reader ORDER BY p_retailprice DESC, work) <= 6),
c AS (SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.reader = w.reader AND a.title = w.title) AND NOT EXISTS (SELECT 1 FROM b WHERE b.reader = w.reader AND b.title = w.title) QUALIFY row_number() OVER (PARTITION BY reader ORDER BY p_retailprice DESC, work) <= 6)"""


@query(f"WITH {ROWS_CHECK} SELECT reader, 'series' AS kind, work FROM a UNION ALL SELECT reader, 'because', work FROM b UNION ALL SELECT reader, 'popular', work FROM c")
def home_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reader's rows in turn: series to go on with, works like those read, popular ones; a title stands in one row only."""
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("work"), F.col("p_brand").alias("reader"), F.col("p_name").alias("title"), "p_size", "p_retailprice", "p_type")
    dear = [F.col("p_retailprice").desc(), F.col("work")]
    return rows_in_turn([("series", part.filter("p_size % 4 = 1"), [F.col("p_size"), F.col("work")], 4), ("because", part.filter("p_type = 'SMALL'"), dear, 6), ("popular", part, dear, 6)])


def rows_in_turn(rows: list[tuple[str, DataFrame, list[Column], int]]) -> DataFrame:
    """(reader, kind, work): each kind takes its first works by its order whose title no kind before has shown. The kinds are
    a few and fixed; each is a join and a window on the reader."""
    shown = out = None
    for kind, found, order, size in rows:
        if shown is not None:
            found = found.join(shown, ["reader", "title"], "left_anti")
        place = F.row_number().over(Window.partitionBy("reader").orderBy(*order))
        chosen = found.withColumn("place", place).filter(F.col("place") <= size).select("reader", F.lit(kind).alias("kind"), "work", "title")
        titles = chosen.select("reader", "title").distinct()
        shown = titles if shown is None else shown.unionByName(titles)
        out = chosen if out is None else out.unionByName(chosen)
    return out.select("reader", "kind", "work")


@query(f"""WITH {VECTORS}, r AS (SELECT reader, f.work, author, row_number() OVER (PARTITION BY reader ORDER BY round(score - if(reader = author, 0.15 / (1 + 0.4 * greatest(0, 2 - size % 5) + 0.15 * greatest(0, size % 5 - 2)), 0), 9) DESC, f.work) AS place FROM f JOIN len ON len.work = f.work)
SELECT reader, count(*) FILTER (place <= 50 AND author = reader) AS found, round(coalesce(1.0 / min(place) FILTER (author = reader), 0), 6) AS rr FROM r GROUP BY reader""")
def blind_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates ranked without their author: how many of a taste's own author stand among the first fifty, and the
    first's reciprocal place."""
    size = F.col("size") % 5 - 2
    penalty = 1 + YOUNGER * F.greatest(F.lit(0), -size) + OLDER * F.greatest(F.lit(0), size)
    rows = candidates(spark, sf_dir).join(works(spark, sf_dir).select("work", "author", "size"), "work")
    blind = F.round(F.col("score") - F.when(F.col("reader") == F.col("author"), AFFINITY / penalty).otherwise(0.0), 9)
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy("reader").orderBy(blind.desc(), "work")))
    own = F.when(F.col("author") == F.col("reader"), F.col("place"))
    return ranked.groupBy("reader").agg(F.count_if(own <= 50).alias("found"), F.round(F.coalesce(1.0 / F.min(own), F.lit(0.0)), 6).alias("rr"))
