"""Scores, places, votes and matches as DataFrames; the SQL that checks each is written apart."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import osa_distance
from ..operators.order import placed
from .catalogue import SCORED
from .dialect import run_sql
from .registry import query

#: Least score of an eligible work, share and votes of an original title, share and works of an author's tags.
MIN_SCORE, VOTE_SHARE, VOTES, FILL_SHARE, FILL_WORKS = 150, 0.6, 2, 0.7, 2


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scored(spark: SparkSession, sf_dir: str, rows: str = "scored") -> DataFrame:
    """Works (or ``by_language``: works in their languages) with facts, traits, signals and score."""
    return run_sql(spark, sf_dir, f"WITH {SCORED} SELECT * FROM {rows} /* part lineitem events */")


#: The same scores, step by step and by language, for the checks.
CHECK = """e AS (SELECT l_partkey AS work, l_returnflag AS language, count(*) AS n, bool_or(l_quantity < 50) AS readable FROM lineitem GROUP BY ALL),
w AS (SELECT l_partkey AS work, least(count(*), 65535) AS editions, count(DISTINCT l_returnflag) AS languages, min(year(l_shipdate)) AS first_year, bool_or(l_discount > 0.05) AS cover, bool_or(l_tax > 0.04) AS isbn, bool_or(l_linestatus = 'F') AS publisher FROM lineitem GROUP BY ALL),
g AS (SELECT user_id % (SELECT max(p_partkey) + 1 FROM part) AS work, list(event_type) AS kinds, list(1 + CAST(floor(value) AS BIGINT) % 5) FILTER (WHERE event_type = 'purchase') AS stars FROM events GROUP BY 1),
r AS (SELECT work, len(list_filter(kinds, lambda k: k = 'view')) AS want, len(list_filter(kinds, lambda k: k = 'click')) AS reading, coalesce(len(stars), 0) AS finished, coalesce(list_sum(stars), 0) AS total FROM g),
a AS (SELECT e.*, w.* EXCLUDE (work), p_type, p_size, p_name, p_brand, coalesce(want, 0) AS want, coalesce(reading, 0) AS reading, coalesce(finished, 0) AS finished, coalesce(total, 0) AS total FROM e JOIN w USING (work) JOIN part ON p_partkey = work LEFT JOIN r USING (work)),
s AS (SELECT *, list_sum([100 * ln(1 + 3 * finished + 2 * reading + want), 60 * ln(1 + finished), 20 * ln(1 + editions), 30 * ln(1 + n), 45 * ln(languages), if(finished >= 5, 18 * (total / finished::DOUBLE - 3.6), 0),
  if(cover OR p_size > 45, 30, 0), if(p_size % 3 <> 0, 22, 0), if(p_type <> 'STANDARD', 15, 0), if(isbn, 10, 0), if(publisher, 8, 0), if(first_year >= 1950, 6, 0)]) AS score FROM a),
m AS (SELECT work, arg_max(score, struct_pack(n := n, tie := -ascii(language))) AS score, any_value(p_name) AS title, any_value(editions) AS editions, any_value(first_year) AS first_year FROM s GROUP BY work)"""


@query(f"WITH {CHECK}, t AS (SELECT max(score) AS top FROM m) SELECT work, title, round(score, 5) AS score, round(ln(1 + score) / ln(1 + top), 5) AS popularity FROM m, t ORDER BY m.score DESC, work LIMIT 100")
def popular_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals, facts, score, normalised popularity, top 100."""
    works = scored(spark, sf_dir)
    top = works.agg(F.max("score").alias("top"))  # one row
    best = works.orderBy(F.col("score").desc(), "work").limit(100).join(F.broadcast(top))
    named = best.join(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("work"), F.col("p_name").alias("title")), "work")
    return named.select("work", "title", F.round("score", 5).alias("score"), F.round(F.log(1 + F.col("score")) / F.log(1 + F.col("top")), 5).alias("popularity"))


@query(f"WITH {CHECK}, t AS (SELECT max(score) AS top FROM m) SELECT work, round(CASE WHEN top <= 0 THEN 1 ELSE ln(1 + greatest(score, 0)) / ln(1 + top) END, 6) AS popularity FROM m, t")
def normalised_popularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logarithm of a work's score against the best; 1 for all if none has any."""
    works = scored(spark, sf_dir).select("work", "score")
    both = works.join(F.broadcast(works.agg(F.max("score").alias("top"))))  # one row
    return both.select("work", F.round(F.when(F.col("top") <= 0, F.lit(1.0)).otherwise(F.log(1 + F.greatest("score", F.lit(0.0))) / F.log(1 + F.col("top"))), 6).alias("popularity"))


@query(f"""WITH {CHECK} SELECT work, language, round(score, 4) AS score FROM s WHERE length(p_brand) > 0 AND length(trim(p_name)) > 0 AND n > 0 AND readable AND (isbn OR want + reading + finished > 0)
AND (p_type <> 'STANDARD' OR want + reading + finished > 0) AND (want + reading + finished > 0 OR cover OR p_size > 45 OR editions >= 2) AND NOT (p_type = 'PROMO' AND want + reading + finished < 3) AND score >= 150""")
def eligible_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works in a language that are named, published, described, wanted, not junk and scored at 150 or more."""
    readers = F.col("want") + F.col("reading") + F.col("finished")
    cover, isbn = F.col("flags") % 2 == 1, F.col("flags") % 4 >= 2
    named = (F.col("has_author") == 1) & (F.col("good_title") == 1)
    published = (F.col("language_editions") > 0) & (F.col("readable") == 1) & (isbn | (readers > 0))
    described = (F.col("has_subjects") == 1) | (readers > 0)
    wanted = (readers > 0) | cover | (F.col("has_cover") == 1) | (F.col("editions") >= 2)
    junk = (F.col("bad_subject") == 1) & (readers < 3)
    rows = scored(spark, sf_dir, "by_language")
    return rows.filter(named & published & described & wanted & ~junk & (F.col("score") >= MIN_SCORE)).select("work", "language", F.round("score", 4).alias("score"))


@query(f"WITH {CHECK}, o AS (SELECT work, row_number() OVER (ORDER BY score DESC, work) AS place FROM m) SELECT work, place, if(place <= 100, 'core', 'rest') AS pack FROM o WHERE place <= 500")
def core_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred by score are the core, up to five hundred in all."""
    best = scored(spark, sf_dir).select("work", "score").orderBy(F.col("score").desc(), "work").limit(500)
    return placed(best, F.col("score").desc(), "work").select("work", "place", F.when(F.col("place") <= 100, "core").otherwise("rest").alias("pack"))


@query(f"WITH {CHECK} SELECT work, row_number() OVER (ORDER BY score DESC, work) AS popular, row_number() OVER (ORDER BY first_year DESC, work) AS newest, row_number() OVER (ORDER BY first_year = 0, first_year, work) AS oldest FROM m")
def result_sorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Popular, newest and oldest, years unknown last."""
    rows = placed(scored(spark, sf_dir).select("work", "score", "first_year"), F.col("score").desc(), "work", place="popular")
    rows = placed(rows, F.col("first_year").desc(), "work", place="newest")
    return placed(rows, F.col("first_year") == 0, "first_year", "work", place="oldest").select("work", "popular", "newest", "oldest")


@query(f"WITH {CHECK}, b AS (SELECT work, sum(70 * editions) OVER (ORDER BY score DESC, work ROWS UNBOUNDED PRECEDING)::BIGINT AS bytes FROM m) SELECT work, bytes FROM b WHERE bytes <= 100000")
def budget_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works by score until their sizes, at 70 bytes an edition, reach the budget."""
    rows = scored(spark, sf_dir).select("work", "score", (70 * F.col("editions")).cast("long").alias("size"))
    return placed(rows, F.col("score").desc(), "work", total="size", running="bytes").filter("bytes <= 100000").select("work", "bytes")


@query("""SELECT o_orderkey AS work, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS by_added, row_number() OVER (ORDER BY o_orderpriority, o_orderkey) AS by_title, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS by_rating,
row_number() OVER (ORDER BY o_orderstatus <> 'F', o_orderdate DESC, o_orderkey) AS by_finished FROM orders""")
def library_sorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of a reading list's rows in each of its orders."""
    rows = read(spark, sf_dir, "orders")
    orders = {"by_added": [F.col("o_orderdate").desc()], "by_title": [F.col("o_orderpriority")], "by_rating": [F.col("o_totalprice").desc()], "by_finished": [F.col("o_orderstatus") != "F", F.col("o_orderdate").desc()]}
    for name, order in orders.items():
        rows = placed(rows, *order, "o_orderkey", place=name)
    return rows.select(F.col("o_orderkey").alias("work"), *orders)


@query("SELECT c_name, row_number() OVER (ORDER BY split_part(c_name, '#', 1), split_part(c_name, '#', 2)::BIGINT) AS place FROM customer")
def natural_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digits compared as numbers."""
    name = F.col("c_name")
    return placed(read(spark, sf_dir, "customer").select("c_name"), F.regexp_replace(name, "[0-9]+", ""), F.regexp_replace(name, "[^0-9]+", "").cast("long")).select("c_name", "place")


@query("""WITH l AS (SELECT DISTINCT ts::DATE::VARCHAR || CASE WHEN user_id % 12 = 0 THEN '' ELSE '-' || (user_id % 12) END AS label FROM events)
SELECT label, row_number() OVER (ORDER BY label[1:10], CASE WHEN length(label) > 10 THEN label[12:]::INT ELSE 0 END) AS place FROM l""")
def release_label_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels ordered by date and then by their number."""
    number = F.col("user_id") % 12
    label = F.concat(F.to_date("ts").cast("string"), F.when(number == 0, "").otherwise(F.concat(F.lit("-"), number.cast("string"))))
    labels = read(spark, sf_dir, "events").select(label.alias("label")).distinct()
    return placed(labels, F.substring("label", 1, 10), F.coalesce(F.expr("try_cast(split_part(label, '-', 4) AS INT)"), F.lit(0))).select("label", "place")


@query("""WITH b AS (SELECT DISTINCT p_brand || p_type AS author, p_partkey AS work, p_size <= 25 AS filed, lower(p_type) AS t0, split_part(p_name, ' ', 1) AS t1, split_part(p_name, ' ', 2) AS t2 FROM part),
t AS (SELECT author, work, filed, unnest([t0, t1, t2]) AS tag FROM b), n AS (SELECT author, count(DISTINCT work) AS works FROM b WHERE filed GROUP BY author HAVING works >= 2),
c AS (SELECT author, tag FROM t SEMI JOIN n USING (author) WHERE filed GROUP BY author, tag HAVING count(DISTINCT work) >= 0.7 * (SELECT works FROM n WHERE n.author = t.author))
SELECT b.work, c.tag FROM b JOIN c USING (author) WHERE NOT filed""")
def author_tag_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags that seven tenths of an author's sorted works have, of two or more, are lent to the unsorted ones."""
    works = read(spark, sf_dir, "part").select(F.concat("p_brand", "p_type").alias("author"), F.col("p_partkey").alias("work"), (F.col("p_size") <= 25).alias("filed"), F.array_append(F.split("p_name", " "), F.lower("p_type")).alias("tags"))
    filed = works.filter("filed")
    many = filed.groupBy("author").agg(F.count("*").alias("works")).filter(F.col("works") >= FILL_WORKS)
    common = filed.select("author", "work", F.explode(F.array_distinct("tags")).alias("tag")).groupBy("author", "tag").agg(F.count("*").alias("n"))
    lent = common.join(many, "author").filter(F.col("n") >= FILL_SHARE * F.col("works")).select("author", "tag")
    return works.filter("NOT filed").join(lent, "author").select("work", "tag")


@query("""WITH v AS (SELECT l_orderkey AS source, l_returnflag AS target, count(*) AS votes FROM lineitem GROUP BY ALL), b AS (SELECT source, max(votes) AS most, sum(votes) AS total FROM v GROUP BY source)
SELECT source, min(target) AS target, most AS votes FROM v JOIN b USING (source) WHERE votes = most AND most >= 2 AND most >= 0.6 * total GROUP BY source, most""")
def unify_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target with three fifths of a source's votes and two at least, if there is one."""
    votes = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("source"), F.col("l_returnflag").alias("target")).agg(F.count("*").alias("votes"))
    best = votes.groupBy("source").agg(F.min(F.struct((-F.col("votes")).alias("minus"), "target")).alias("best"), F.sum("votes").alias("total"))
    rows = best.select("source", "best.target", (-F.col("best.minus")).alias("votes"), "total")
    return rows.filter((F.col("votes") >= VOTES) & (F.col("votes") >= VOTE_SHARE * F.col("total"))).select("source", "target", "votes")


@query("""WITH a AS (SELECT p_brand AS author, sum(l_quantity) AS weight FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'A' GROUP BY 1 HAVING count(DISTINCT l_partkey) > 1) SELECT author, round(weight / (SELECT max(weight) FROM a), 6) AS affinity FROM a""")
def author_affinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of authors with more than one source, scaled by the largest."""
    author = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("author"))
    weight = read(spark, sf_dir, "lineitem").filter("l_returnflag = 'A'").groupBy("l_partkey").agg(F.sum("l_quantity").alias("w")).join(author, "l_partkey")
    by = weight.groupBy("author").agg(F.sum("w").alias("weight"), F.count("*").alias("n")).filter("n > 1")
    return by.join(F.broadcast(by.agg(F.max("weight").alias("top")))).select("author", F.round(F.col("weight") / F.col("top"), 6).alias("affinity"))  # one row


@query("""WITH k AS (SELECT p_partkey AS work, p_brand AS author, lower(replace(p_name, ' ', '')) AS title_key FROM part)
SELECT a.work, min(b.work) AS claims, count(*) AS candidates FROM k a JOIN k b ON a.title_key = b.title_key AND a.author = b.author AND b.work < a.work GROUP BY a.work""")
def title_key_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A work claims the first of its title key and author; how many came before it. Counted, not paired."""
    works = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("work"), F.col("p_brand").alias("author"), F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", "").alias("title_key"))
    w = Window.partitionBy("title_key", "author").orderBy("work")
    return works.select("work", F.first("work").over(w).alias("claims"), (F.row_number().over(w) - 1).cast("long").alias("candidates")).filter("candidates > 0")


@query("""WITH s AS (SELECT DISTINCT l_orderkey AS series, l_returnflag AS language, l_suppkey % 5 AS author, l_linenumber AS volume, l_partkey AS work FROM lineitem),
one AS (SELECT series, language, author, volume, min(work) AS work FROM s GROUP BY ALL HAVING count(*) = 1),
c AS (SELECT a.series AS a, a.language AS la, b.series AS b, b.language AS lb, a.author, count(*) FILTER (a.volume = b.volume) AS agree, count(*) FILTER (a.volume <> b.volume) AS apart FROM one a JOIN one b ON a.work = b.work AND a.author = b.author AND a.language < b.language GROUP BY ALL),
k AS (SELECT * FROM c WHERE agree > 0 AND apart = 0) SELECT a, la, b, lb, author, agree FROM k
WHERE (SELECT count(*) FROM k x WHERE (x.a, x.la, x.author, x.lb) = (k.a, k.la, k.author, k.lb)) = 1 AND (SELECT count(*) FROM k x WHERE (x.b, x.lb, x.author, x.la) = (k.b, k.lb, k.author, k.la)) = 1""")
def series_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series of one author in two languages that share a work at one position and none at different ones, each the other's
    only partner in its language."""
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("series"), F.col("l_returnflag").alias("language"), (F.col("l_suppkey") % 5).alias("author"), F.col("l_linenumber").alias("volume"), F.col("l_partkey").alias("work")).distinct()
    return aligned_series(rows)


def aligned_series(rows: DataFrame) -> DataFrame:
    """(a, la, b, lb, author, agree) from (series, language, author, volume, work); positions held by two works don't count."""
    key = ["series", "language", "author", "volume"]
    one = rows.groupBy(*key).agg(F.min("work").alias("work"), F.count("*").alias("n")).filter("n = 1").drop("n")
    side = lambda s, l, v: one.select(F.col("series").alias(s), F.col("language").alias(l), "author", F.col("volume").alias(v), "work")
    met = side("a", "la", "va").join(side("b", "lb", "vb"), ["work", "author"]).filter("la < lb")
    same = (F.col("va") == F.col("vb")).cast("long")
    found = met.groupBy("a", "la", "b", "lb", "author").agg(F.sum(same).alias("agree"), F.sum(1 - same).alias("apart")).filter("agree > 0 AND apart = 0")
    left, right = Window.partitionBy("a", "la", "author", "lb"), Window.partitionBy("b", "lb", "author", "la")
    only = found.withColumn("l", F.count("*").over(left)).withColumn("r", F.count("*").over(right)).filter("l = 1 AND r = 1")
    return only.select("a", "la", "b", "lb", "author", "agree")


@query("""WITH m AS (SELECT doc_id, item_id, length(b.text) AS n FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(b.text))), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, item_id) AS rn FROM m) SELECT doc_id, item_id FROM r WHERE rn = 1""")
def containment_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that stand whole in a text; the longest one per text, the smaller id on ties."""
    return contained(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark").select("item_id", "text"))


def contained(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Places that may hold an item are joined and then verified: a text cut into pieces of some size has one within every
    passage of twice that size less one, so an item is met by the pieces that start at its first places. Items are taken
    in three classes of length, each with the largest pieces that it allows."""
    phrases = items.select("item_id", F.lower("text").alias("phrase")).filter(F.length("phrase") > 0)
    said = docs.select("doc_id", F.lower("text").alias("said"), F.xxhash64("text").alias("h"))
    pieces = lambda text, last, step, size: F.transform(F.sequence(F.lit(1), last, F.lit(step)), lambda i: F.substring(text, i, F.lit(size)))
    found = []
    for size, least, most in ((24, 47, 1 << 30), (4, 7, 46), (1, 1, 6)):
        own = phrases.filter(F.length("phrase").between(least, most))
        if own.isEmpty() and size < 24:
            continue
        heads = own.select("item_id", "phrase", F.explode(F.array_distinct(pieces("phrase", F.lit(size), 1, size))).alias("piece"))
        places = said.select("doc_id", "h", F.explode(pieces("said", F.greatest(F.lit(1), F.length("said")), size, size)).alias("piece")).join(heads.select("piece").distinct(), "piece", "left_semi").distinct()
        pairs = places.join(heads, "piece").select("doc_id", "h", "item_id", "phrase").distinct()
        found.append(pairs.join(said, ["doc_id", "h"]).filter(F.contains("said", "phrase")).select("doc_id", "item_id", F.length("phrase").alias("n")))
    best = functools.reduce(DataFrame.unionByName, found).groupBy("doc_id").agg(F.min(F.struct((-F.col("n")).alias("minus"), "item_id")).alias("b"))
    return best.select("doc_id", "b.item_id")


@query("""WITH t AS (SELECT DISTINCT unnest(split(lower(p_name), ' ')) AS term FROM part), p AS (SELECT a.term AS a, b.term AS b, damerau_levenshtein(a.term, b.term) AS distance FROM t a JOIN t b ON a.term < b.term) SELECT * FROM p WHERE distance <= 2""")
def edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms within two edits or swaps of neighbours. Such terms share a spelling with up to two letters left out."""
    terms = read(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("term")).distinct()
    return near_spellings(terms, 2)


def without_one(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text))), lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text))))


def near_spellings(terms: DataFrame, limit: int) -> DataFrame:
    """Pairs of distinct ``term``s within ``limit`` edits or swaps, met at a spelling with as many letters left out."""
    spelt = F.array(F.col("term"))
    for _ in range(limit):
        spelt = F.array_distinct(F.concat(spelt, F.flatten(F.transform(spelt, without_one))))
    by = terms.select("term", F.explode(spelt).alias("spelling"))
    met = by.select(F.col("term").alias("a"), "spelling").join(by.select(F.col("term").alias("b"), "spelling"), "spelling").filter("a < b").select("a", "b").distinct()
    return met.withColumn("distance", osa_distance("a", "b").cast("long")).filter(F.col("distance") <= limit)


@query("""WITH n AS (SELECT DISTINCT p_name AS name FROM part UNION SELECT split_part(p_name, ' ', 2) FROM part), w AS (SELECT name, split(name, ' ') AS w FROM n)
SELECT a.name, max(b.name) AS joins FROM w a JOIN w b ON length(b.name) > length(a.name) AND list_has_any([array_to_string(b.w[i : i + len(a.w) - 1], ' ') FOR i IN range(1, len(b.w) + 1)], [a.name]) GROUP BY a.name""")
def name_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names whose words stand in a longer name: the last of these. Met at their first word."""
    part = read(spark, sf_dir, "part")
    names = part.select(F.col("p_name").alias("name")).unionByName(part.select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("name"))).distinct()
    first = names.select("name", F.split_part("name", F.lit(" "), F.lit(1)).alias("word"))
    longer = names.select(F.col("name").alias("joins"), F.explode(F.array_distinct(F.split("name", " "))).alias("word"))
    pad = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    met = first.join(longer, "word").filter((F.length("joins") > F.length("name")) & F.contains(pad("joins"), pad("name")))
    return met.groupBy("name").agg(F.max("joins").alias("joins"))


@query(r"""WITH c AS (SELECT doc_id, CASE WHEN regexp_matches(text, '-{10,}') THEN text[: strpos(text, regexp_extract(text, '-{10,}')) - 1] ELSE text END AS t FROM documents),
u AS (SELECT doc_id, trim(regexp_replace(regexp_replace(t, 'https?://[^ ]+', '', 'g'), '[ \n\t]+', ' ', 'g')) AS t FROM c)
SELECT doc_id, octet_length(encode(t))::BIGINT AS bytes, CASE WHEN octet_length(encode(t)) <= 480 THEN t ELSE trim(list_aggregate([t[i:i] FOR i IN range(1, 481) IF octet_length(encode(t[1:i])) <= 480], 'string_agg', '')) END AS description FROM u""")
def clean_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten dashes end it; links and white space go; whole characters of at most 480 bytes."""
    ended = F.regexp_replace("text", "(?s)-{10,}.*$", "")
    said = F.trim(F.regexp_replace(F.regexp_replace(ended, "https?://[^ ]+", ""), "[ \n\t]+", " "))
    rows = read(spark, sf_dir, "documents").select("doc_id", said.alias("t"))
    sizes = F.aggregate(F.split(F.substring("t", 1, 480), ""), F.struct(F.lit(0).alias("bytes"), F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, c: F.struct((s["bytes"] + F.octet_length(c)).alias("bytes"), F.when(s["on"] & (s["bytes"] + F.octet_length(c) <= 480), s["n"] + 1).otherwise(s["n"]).alias("n"), (s["on"] & (s["bytes"] + F.octet_length(c) <= 480)).alias("on")))
    cut = F.when(F.octet_length("t") <= 480, F.col("t")).otherwise(F.trim(F.substring("t", F.lit(1), sizes["n"])))
    return rows.select("doc_id", F.octet_length("t").cast("long").alias("bytes"), cut.alias("description"))
