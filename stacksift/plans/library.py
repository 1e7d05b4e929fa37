"""A reader's library and lookups between catalogues; the SQL that checks each is written apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .registry import query
from .rules import read

#: Names of print-on-demand publishers' stand-ins, bytes of an edition's title and of its packed form.
REPRINTERS, TITLE_BYTES, PACKED_BYTES = ("000000001", "000000013"), 160, 255


@query("""WITH w AS (SELECT DISTINCT p_name AS title, p_brand AS author FROM part), o AS (SELECT p_partkey AS offer, p_brand AS author, split(p_name || ' ' || lower(p_type), ' ') AS words FROM part)
SELECT title, w.author, count(*) AS offers, min(offer) AS first FROM w JOIN o ON o.author = w.author AND list_has_all(o.words, split(w.title, ' ')) GROUP BY ALL""")
def offer_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers with an author in common whose title has every wanted word; met at author and word."""
    part = read(spark, sf_dir, "part")
    wants = part.select(F.col("p_name").alias("title"), F.col("p_brand").alias("author")).distinct().withColumn("words", F.array_distinct(F.split("title", " ")))
    offers = part.select(F.col("p_partkey").alias("offer"), F.col("p_brand").alias("author"), F.split(F.concat_ws(" ", "p_name", F.lower("p_type")), " ").alias("said"))
    met = wants.select("title", "author", F.size("words").alias("n"), F.explode("words").alias("word")).join(offers.select("offer", "author", F.explode(F.array_distinct("said")).alias("word")), ["author", "word"])
    whole = met.groupBy("title", "author", "offer").agg(F.count("*").alias("have"), F.first("n").alias("n")).filter("have = n")
    return whole.groupBy("title", "author").agg(F.count("*").alias("offers"), F.min("offer").alias("first"))


@query("""WITH a AS (SELECT c_custkey AS old, c_custkey // 2 AS new FROM customer WHERE c_custkey % 3 = 0), e AS (SELECT coalesce(new, o_custkey) AS work, o_orderkey, o_orderdate FROM orders LEFT JOIN a ON old = o_custkey)
SELECT work, arg_max(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) AS entry, count(*) AS entries FROM e GROUP BY work""")
def redirected_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries follow their works' aliases; of those that meet the newest stays."""
    aliases = read(spark, sf_dir, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("old"), F.floor(F.col("c_custkey") / 2).alias("new"))
    return redirected(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("work"), F.col("o_orderkey").alias("entry"), F.col("o_orderdate").alias("updated")), aliases)


def redirected(entries: DataFrame, aliases: DataFrame) -> DataFrame:
    """(work, entry, entries) of (work, entry, updated) after (old, new)."""
    moved = entries.join(aliases, entries.work == aliases.old, "left").select(F.coalesce("new", "work").alias("work"), "entry", "updated")
    return moved.groupBy("work").agg(F.max(F.struct("updated", "entry")).alias("newest"), F.count("*").alias("entries")).select("work", "newest.entry", "entries")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size <= 25) THEN l_partkey ELSE l_partkey // 2 END AS id FROM lineitem""")
def alias_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The id itself if the catalogue has it, else what its alias says."""
    works = read(spark, sf_dir, "part")
    known = works.filter("p_size <= 25").select(F.col("p_partkey").alias("l_partkey"), F.col("p_partkey").alias("own"))
    alias = works.select(F.col("p_partkey").alias("l_partkey"), F.floor(F.col("p_partkey") / 2).alias("other"))
    asked = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(known, "l_partkey", "left").join(alias, "l_partkey", "left")
    return asked.select("l_orderkey", "l_linenumber", F.coalesce("own", "other", "l_partkey").alias("id"))


@query("""WITH l AS (SELECT o_custkey AS reader, o_orderkey AS work, list_distinct([lower(o_orderpriority), lower(o_orderstatus)]) AS lists FROM orders), c AS (SELECT reader, bool_and(list_contains(lists, 'f')) AS everywhere FROM l GROUP BY reader)
SELECT reader, work, array_to_string(list_sort(CASE WHEN everywhere THEN list_filter(lists, lambda x: x <> 'f') ELSE list_distinct(list_append(lists, 'f')) END), ',') AS lists FROM l JOIN c USING (reader)""")
def toggled_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list's name goes from all of a reader's works if all have it, else it comes to those that lack it."""
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("reader"), F.col("o_orderkey").alias("work"), F.array_distinct(F.array(F.lower("o_orderpriority"), F.lower("o_orderstatus"))).alias("lists"))
    return toggled(rows, "f").select("reader", "work", F.array_join(F.array_sort("lists"), ",").alias("lists"))


def toggled(rows: DataFrame, name: str) -> DataFrame:
    """(reader, work, lists) with the list toggled for each reader's works; names compare without case."""
    key = F.lit(name.lower())
    has = lambda c: F.exists(c, lambda x: F.lower(x) == key)
    everywhere = rows.groupBy("reader").agg(F.min(has("lists")).alias("everywhere"))
    changed = F.when(F.col("everywhere"), F.filter("lists", lambda x: F.lower(x) != key)).otherwise(F.when(has("lists"), F.col("lists")).otherwise(F.array_append("lists", F.lit(name))))
    return rows.join(everywhere, "reader").select("reader", "work", changed.alias("lists"))


@query("""SELECT o_orderpriority AS pack, o_orderkey AS file FROM orders o WHERE o_orderstatus = 'P' AND NOT EXISTS (SELECT 1 FROM orders x WHERE x.o_orderpriority = o.o_orderpriority AND x.o_orderstatus = 'O' AND x.o_custkey = o.o_custkey)""")
def obsolete_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files held (pending) that the manifest (open) offers no more."""
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("pack"), F.col("o_custkey").alias("name"), F.col("o_orderkey").alias("file"), "o_orderstatus")
    return rows.filter("o_orderstatus = 'P'").join(rows.filter("o_orderstatus = 'O'"), ["pack", "name"], "left_anti").select("pack", "file")


@query("""SELECT p_partkey AS work FROM part WHERE p_type = 'SMALL' AND len(list_filter(['re', 'bo'], lambda t: len(list_filter(split(lower(p_name || ' ' || p_brand), ' '), lambda w: starts_with(w, t))) = 0)) = 0""")
def library_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works of a status of which every token of the query begins a word."""
    part = read(spark, sf_dir, "part").filter("p_type = 'SMALL'")
    words = F.split(F.lower(F.concat_ws(" ", "p_name", "p_brand")), " ")
    return part.filter(begins(words, F.array(F.lit("re"), F.lit("bo")))).select(F.col("p_partkey").alias("work"))


def begins(words: Column, tokens: Column) -> Column:
    """Every token begins some word."""
    return F.forall(tokens, lambda t: F.exists(words, lambda w: F.startswith(w, t)))


@query("SELECT l_partkey AS work, min(year(l_shipdate)) AS year FROM lineitem GROUP BY l_partkey HAVING year BETWEEN 1996 AND 1998 AND l_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE '%bolt%')")
def era_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works with a tag whose first year lies in an era."""
    tagged = read(spark, sf_dir, "part").filter(F.array_contains(F.split("p_name", " "), "bolt")).select(F.col("p_partkey").alias("l_partkey"))
    years = read(spark, sf_dir, "lineitem").join(tagged, "l_partkey", "left_semi").groupBy(F.col("l_partkey").alias("work")).agg(F.min(F.year("l_shipdate")).alias("year"))
    return years.filter(F.col("year").between(1996, 1998))


@query("SELECT DISTINCT o_orderdate::DATE AS day, CASE month(o_orderdate) WHEN 12 THEN year(o_orderdate) WHEN 1 THEN year(o_orderdate) - 1 END AS wrapped FROM orders")
def wrapped_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The year that a recap is about: December's own, January's last, else none."""
    day = F.to_date("o_orderdate").alias("day")
    month = F.month("day")
    return read(spark, sf_dir, "orders").select(day).distinct().select("day", F.when(month == 12, F.year("day")).when(month == 1, F.year("day") - 1).cast("long").alias("wrapped"))


@query("""WITH t AS (SELECT DISTINCT lower(p_type) AS slug FROM part), x AS (SELECT slug, row_number() OVER (ORDER BY slug) AS here, row_number() OVER (ORDER BY reverse(slug)) AS there FROM t)
SELECT p_partkey AS work, here AS tag, there AS mapped FROM part JOIN x ON slug = lower(p_type) WHERE slug <> 'promo'""")
def adopted_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A work's tags in another catalogue's numbers, by slug; slugs that the other lacks go."""
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("work"), F.lower("p_type").alias("slug"))
    slugs = part.select("slug").distinct()
    number = lambda order, name: slugs.select(F.posexplode(F.array_sort(F.collect_list(order)))).select((F.col("pos") + 1).cast("long").alias(name), "col")
    here = number(F.col("slug"), "tag").withColumnRenamed("col", "slug")  # the vocabulary has a few hundred tags
    there = number(F.reverse("slug"), "mapped").withColumn("slug", F.reverse("col")).drop("col").filter("slug <> 'promo'")
    return part.join(here, "slug").join(there, "slug").select("work", "tag", "mapped")


@query("""WITH r AS (SELECT o_orderkey AS row, o_orderkey * 3 AS isbn, p_name AS title, p_brand AS author FROM orders JOIN part ON p_partkey = o_orderkey % (SELECT count(*) FROM part)), k AS (SELECT l_orderkey * 10 + l_linenumber AS isbn, min(l_partkey) AS work FROM lineitem GROUP BY 1),
t AS (SELECT p_name AS title, p_brand AS author, min(p_partkey) AS other FROM part WHERE p_size > 10 GROUP BY ALL) SELECT row, coalesce(work, other, 1000000000 + row) AS work, CASE WHEN work IS NOT NULL THEN 'isbn' WHEN other IS NOT NULL THEN 'title' ELSE 'own' END AS found
FROM r LEFT JOIN k USING (isbn) LEFT JOIN t USING (title, author)""")
def imported_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an import find their work by number, else by title and author, else become works of their own."""
    part = read(spark, sf_dir, "part")
    n = part.count()
    titles = part.select(F.col("p_partkey").alias("at"), F.col("p_name").alias("title"), F.col("p_brand").alias("author"))
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row"), (F.col("o_orderkey") * 3).alias("isbn"), (F.col("o_orderkey") % max(n, 1)).alias("at")).join(titles, "at")
    numbers = read(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("isbn")).agg(F.min("l_partkey").alias("work"))
    known = part.filter("p_size > 10").groupBy(F.col("p_name").alias("title"), F.col("p_brand").alias("author")).agg(F.min("p_partkey").alias("other"))
    met = rows.join(numbers, "isbn", "left").join(known, ["title", "author"], "left")
    return met.select("row", F.coalesce("work", "other", 1000000000 + F.col("row")).alias("work"), F.when(F.col("work").isNotNull(), "isbn").when(F.col("other").isNotNull(), "title").otherwise("own").alias("found"))


@query("""WITH b AS (SELECT p_brand AS author, p_name FROM part), t AS (SELECT author, unnest(split(p_name, ' ')) AS token FROM b) SELECT author, count(*) AS hits FROM t WHERE token IN ('red', 'anvil') GROUP BY author HAVING count(DISTINCT token) = 2""")
def authors_of_all_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors whose works answer to every token of a query."""
    tokens = ["red", "anvil"]
    postings = read(spark, sf_dir, "part").select(F.col("p_brand").alias("author"), F.explode(F.split("p_name", " ")).alias("token")).filter(F.col("token").isin(tokens))
    return postings.groupBy("author").agg(F.count("*").alias("hits"), F.count_distinct("token").alias("n")).filter(F.col("n") == len(tokens)).select("author", "hits")


@query("""WITH h AS (SELECT p_brand, p_name, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS place, p_type FROM part QUALIFY place <= 20), a AS (SELECT p_type AS query, p_brand AS author, min(place) AS first FROM h WHERE starts_with(lower(p_brand), 'brand#1') GROUP BY ALL),
n AS (SELECT p_brand AS author, count(*) AS books FROM part GROUP BY 1) SELECT query, author, books, row_number() OVER (PARTITION BY query ORDER BY first, author) AS place FROM a JOIN n USING (author) QUALIFY place <= 3""")
def matching_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a query's twenty first hits the authors whose name it begins: three, with the number of their books."""
    part = read(spark, sf_dir, "part").select(F.col("p_type").alias("query"), F.col("p_brand").alias("author"), "p_retailprice", "p_partkey")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("p_retailprice").desc(), "p_partkey"))
    hits = part.withColumn("at", rank).filter("at <= 20")
    named = hits.filter(begins(F.split(F.lower("author"), " "), F.array(F.lit("brand#1")))).groupBy("query", "author").agg(F.min("at").alias("first"))
    books = part.groupBy("author").agg(F.count("*").alias("books"))
    place = F.row_number().over(Window.partitionBy("query").orderBy("first", "author")).cast("long")
    return named.join(books, "author").withColumn("place", place).filter("place <= 3").select("query", "author", "books", "place")


@query("""SELECT event_id, props AS state, coalesce((props->>'k')::BIGINT, -1) AS k, coalesce(props->>'theme', 'system') AS theme, coalesce(props->>'ref', '') AS ref FROM events""")
def state_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored states without a version: unknown fields are ignored, missing ones have their defaults."""
    state = F.from_json("props", "k long, theme string, ref string")
    return read(spark, sf_dir, "events").select("event_id", F.col("props").alias("state"), F.coalesce(state["k"], F.lit(-1)).alias("k"), F.coalesce(state["theme"], F.lit("system")).alias("theme"), F.coalesce(state["ref"], F.lit("")).alias("ref"))


@query("""WITH d AS (SELECT o_custkey AS k, month(o_orderdate) AS m, count(*) FILTER (o_orderkey % 2 = 0) AS a, count(*) FILTER (o_orderkey % 2 = 1) AS b FROM orders GROUP BY ALL)
SELECT k, string_agg(m || ':' || greatest(a, b), ',' ORDER BY m) FILTER (greatest(a, b) > 1) AS merged FROM d GROUP BY k HAVING count(*) FILTER (a > 0) > 0 AND count(*) FILTER (b > 0) > 0""")
def map_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two maps by month merged with the larger value of each key, values of one dropped."""
    rows = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k"), F.month("o_orderdate").alias("m"), (F.col("o_orderkey") % 2).alias("side")).agg(F.count("*").alias("n"))
    half = lambda side: rows.filter(F.col("side") == side).groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("m", "n"))).alias(f"m{side}"))
    both = F.map_zip_with("m0", "m1", lambda _, a, b: F.greatest(F.coalesce(a, F.lit(0)), F.coalesce(b, F.lit(0))))
    kept = F.map_filter(both, lambda _, n: n > 1)
    text = F.transform(F.array_sort(F.map_entries(kept)), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"].cast("string")))
    return half(0).join(half(1), "k").select("k", F.when(F.size(text) > 0, F.array_join(text, ",")).alias("merged"))


@query("""WITH s AS (SELECT o_custkey AS work, o_orderkey AS snap, CASE WHEN o_orderstatus = 'F' THEN 'kids' ELSE 'general' END AS pack FROM orders)
SELECT work, arg_min(pack, snap) AS pack, count(*) AS published FROM s GROUP BY work""")
def sticky_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Once published a work keeps the pack of its first release."""
    pack = F.when(F.col("o_orderstatus") == "F", "kids").otherwise("general")
    return read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("work")).agg(F.min_by(pack, "o_orderkey").alias("pack"), F.count("*").alias("published"))


@query("""SELECT s_suppkey AS publisher, s_name LIKE '%000000001%' OR s_name LIKE '%000000013%' AS reprinter FROM supplier""")
def reprinter_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publishers whose name holds that of a print-on-demand house."""
    found = F.exists(F.array(*map(F.lit, REPRINTERS)), lambda x: F.contains(F.lower("s_name"), x))
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("publisher"), found.alias("reprinter"))


@query("""WITH t AS (SELECT doc_id, lang AS title, substr(text, 1, 60 + (doc_id % 300)::INT) AS subtitle FROM documents), u AS (SELECT *, strlen(title) AS a, strlen(subtitle) AS b FROM t)
SELECT doc_id, CASE WHEN a > 160 THEN '' WHEN b = 0 OR b > 160 OR a + 1 + b > 255 THEN title ELSE title || chr(31) || subtitle END AS packed FROM u""")
def edition_title_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and subtitle in one, if they fit: 160 bytes each, 255 together; a longer title is dropped, a subtitle left out."""
    subtitle = F.substring("text", F.lit(1), (60 + F.col("doc_id") % 300).cast("int"))
    rows = read(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("title"), subtitle.alias("subtitle"))
    return rows.select("doc_id", packed_title(F.col("title"), F.col("subtitle")).alias("packed"))


def packed_title(title: Column, subtitle: Column) -> Column:
    a, both = F.octet_length(title), F.concat(title, F.lit("\x1f"), subtitle)
    whole = (F.octet_length(subtitle) > 0) & (F.octet_length(subtitle) <= TITLE_BYTES) & (F.octet_length(both) <= PACKED_BYTES)
    return F.when(a > TITLE_BYTES, "").when(whole, both).otherwise(title)


@query("""WITH c AS (SELECT l_partkey AS work, l_orderkey * 10 + l_linenumber AS cover, l_discount > 0.03 AS usable, l_suppkey % 10 = 3 AS reprint, l_linestatus = 'F' AS book FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY work ORDER BY cover, usable, book AND NOT reprint) AS i FROM c)
SELECT work, string_agg(if(usable, cover, 0)::VARCHAR, ',' ORDER BY i) FILTER (i <= 8) AS covers, max(if(i = 1 AND usable AND book AND NOT reprint, cover, 0)) AS vetted FROM r GROUP BY work""")
def vetted_covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A work's first eight covers, unusable ones zero; and its first if it is usable, a book's and no reprint's."""
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("work"), F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("cover"), (F.col("l_discount") > 0.03).alias("usable"), ((F.col("l_suppkey") % 10 != 3) & (F.col("l_linestatus") == "F")).alias("book")).alias("c"))
    first = rows.withColumn("i", F.row_number().over(Window.partitionBy("work").orderBy("c"))).filter("i <= 8")
    by = first.groupBy("work").agg(F.array_sort(F.collect_list("c")).alias("c"))
    shown = F.transform("c", lambda c: F.when(c["usable"], c["cover"]).otherwise(0).cast("string"))
    head = F.col("c")[0]
    return by.select("work", F.array_join(shown, ",").alias("covers"), F.when(head["usable"] & head["book"], head["cover"]).otherwise(0).alias("vetted"))


@query("""SELECT l_orderkey * 10 + l_linenumber AS edition, least((SELECT count(*) FROM events WHERE user_id = l_orderkey * 10 + l_linenumber), 65535) AS readers FROM lineitem""")
def edition_readers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readers of each edition, from the log's edition numbers."""
    log = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("edition")).agg(F.count("*").alias("n"))
    return read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edition")).join(log, "edition", "left").select("edition", F.least(F.coalesce("n", F.lit(0)), F.lit(65535)).alias("readers"))


@query("""SELECT DISTINCT l_partkey AS work, l_returnflag AS language, EXISTS (SELECT 1 FROM lineitem x WHERE x.l_partkey = y.l_partkey AND x.l_returnflag = y.l_returnflag AND x.l_linestatus <> 'O') AS local FROM lineitem y""")
def local_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a work has a title in a language that isn't its series' name."""
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("work"), F.col("l_returnflag").alias("language")).agg(F.bool_or(F.col("l_linestatus") != "O").alias("local"))


@query("""WITH m AS (SELECT p_name AS unified, p_type AS language, min(p_partkey) AS member FROM part GROUP BY ALL), d AS (SELECT DISTINCT p_name AS unified, p_brand AS language FROM part WHERE p_size > 48)
SELECT unified, language, member, 'member' AS kind FROM m WHERE language <> 'SMALL' UNION ALL SELECT unified, language, NULL, 'description' FROM d WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.unified = d.unified AND m.language = d.language)""")
def other_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A work's members in other languages, and descriptions in languages that no member has."""
    part = read(spark, sf_dir, "part")
    members = part.groupBy(F.col("p_name").alias("unified"), F.col("p_type").alias("language")).agg(F.min("p_partkey").alias("member"))
    texts = part.filter("p_size > 48").select(F.col("p_name").alias("unified"), F.col("p_brand").alias("language")).distinct().join(members, ["unified", "language"], "left_anti")
    return members.filter("language <> 'SMALL'").withColumn("kind", F.lit("member")).unionByName(texts.select("unified", "language", F.lit(None).cast("long").alias("member"), F.lit("description").alias("kind")))


@query("""WITH c AS (SELECT l_partkey AS work, CASE l_linenumber % 3 WHEN 0 THEN 'translator' WHEN 1 THEN 'illustrator' ELSE 'narrator' END AS role, 'Supplier ' || l_suppkey AS name FROM lineitem),
k AS (SELECT DISTINCT work, role, name FROM c), x AS (SELECT * FROM k a WHERE role <> 'translator' OR NOT EXISTS (SELECT 1 FROM k b WHERE b.work = a.work AND b.role = 'translator' AND b.name <> a.name AND starts_with(b.name, a.name)))
SELECT work, string_agg(name, ', ' ORDER BY name) FILTER (role = 'translator') AS translators, string_agg(name, ', ' ORDER BY name) FILTER (role = 'illustrator') AS illustrators, string_agg(name, ', ' ORDER BY name) FILTER (role = 'narrator') AS narrators FROM x GROUP BY work""")
def contributor_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contributors by role; a translator whose name begins another's is left out."""
    role = F.when(F.col("l_linenumber") % 3 == 0, "translators").when(F.col("l_linenumber") % 3 == 1, "illustrators").otherwise("narrators")
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("work"), role.alias("role"), F.concat(F.lit("Supplier "), "l_suppkey").alias("name"))
    by = rows.groupBy("work").pivot("role", ["translators", "illustrators", "narrators"]).agg(F.array_sort(F.collect_set("name")))
    whole = F.filter("translators", lambda a: ~F.exists("translators", lambda b: (a != b) & F.startswith(b, a)))
    shown = lambda c: F.when(F.size(c) > 0, F.array_join(c, ", "))
    return by.select("work", shown(whole).alias("translators"), shown(F.col("illustrators")).alias("illustrators"), shown(F.col("narrators")).alias("narrators"))


@query("""WITH o AS (SELECT p_partkey AS work, p_name AS unified, unnest([lower(p_type), split_part(p_name, ' ', 2), 'size ' || p_size % 5]) AS tag FROM part), a AS (SELECT work, tag, 0 AS rank FROM o UNION ALL SELECT m.p_partkey, o.tag, 1 FROM part m JOIN o ON o.unified = m.p_name AND o.work <> m.p_partkey)
SELECT work, count(DISTINCT tag) AS tags, count(DISTINCT tag) FILTER (rank = 0) AS own, string_agg(DISTINCT tag, ',' ORDER BY tag) AS shown FROM a GROUP BY work""")
def member_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A work's own tags and then those that only its other members have; gathered once for each unified work."""
    tags = F.array_distinct(F.array(F.lower("p_type"), F.split_part("p_name", F.lit(" "), F.lit(2)), F.concat(F.lit("size "), F.col("p_size") % 5)))
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("work"), F.col("p_name").alias("unified"), tags.alias("own"))
    whole = rows.select("unified", F.explode("own").alias("tag")).distinct().groupBy("unified").agg(F.array_sort(F.collect_list("tag")).alias("whole"))
    return rows.join(whole, "unified").select("work", F.size("whole").cast("long").alias("tags"), F.size("own").cast("long").alias("own"), F.array_join("whole", ",").alias("shown"))


@query("""WITH p AS (SELECT l_suppkey AS person, list_sort(list_distinct(list('viaf:' || l_partkey % 7) || list('isni:' || l_orderkey % 5))) AS ids FROM lineitem GROUP BY 1) SELECT person, array_to_string(ids, ' ') AS ids, len(ids) AS n FROM p WHERE len(ids) > 0""")
def people_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each author's identifiers of all sources, once and in order."""
    ids = F.array(F.concat(F.lit("viaf:"), F.col("l_partkey") % 7), F.concat(F.lit("isni:"), F.col("l_orderkey") % 5))
    by = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("person"), F.explode(ids).alias("id")).distinct().groupBy("person").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return by.select("person", F.array_join("ids", " ").alias("ids"), F.size("ids").cast("long").alias("n"))


@query("""WITH c AS (SELECT l_suppkey AS writer, p_brand AS author, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL) SELECT writer, min(author) AS canonical, n AS works FROM c WHERE (writer, n) IN (SELECT writer, max(n) FROM c GROUP BY writer) GROUP BY ALL""")
def canonical_writers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue author that most of a library writer's works have, the first on ties."""
    author = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("author"))
    counts = read(spark, sf_dir, "lineitem").join(author, "l_partkey").groupBy(F.col("l_suppkey").alias("writer"), "author").agg(F.count("*").alias("n"))
    return counts.groupBy("writer").agg(F.min(F.struct((-F.col("n")).alias("minus"), "author")).alias("b")).select("writer", F.col("b.author").alias("canonical"), (-F.col("b.minus")).alias("works"))


@query("""SELECT p_partkey AS work, '{' || concat_ws(',', '"id":' || p_partkey, CASE WHEN p_size % 3 <> 0 THEN '"title":"' || p_name || '"' END, CASE WHEN p_size % 2 = 0 THEN '"pages":' || p_size END) || '}' AS reply FROM part""")
def compact_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A work as JSON without nulls and empty strings."""
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 3 != 0, F.col("p_name")).otherwise("").alias("title"), F.when(F.col("p_size") % 2 == 0, F.col("p_size")).alias("pages"))
    return part.select(F.col("id").alias("work"), compact(part).alias("reply"))


def compact(rows: DataFrame) -> Column:
    """The columns as a JSON object; strings that are empty and nulls are left out."""
    shown = [F.nullif(F.col(f.name), F.lit("")).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f.name) for f in rows.schema]
    return F.to_json(F.struct(*shown), {"ignoreNullFields": "true"})


@query("""WITH g AS (SELECT l_suppkey AS grp, l_returnflag AS language, l_partkey AS work FROM lineitem), t AS (SELECT DISTINCT l_partkey AS work, l_returnflag AS language FROM lineitem WHERE l_linestatus = 'F') SELECT grp, work, language FROM (SELECT DISTINCT * FROM g) x WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.work = x.work AND t.language = x.language)""")
def placed_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that groups add to works which have none of their own in a language."""
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("grp"), F.col("l_partkey").alias("work"), F.col("l_returnflag").alias("language"), "l_linestatus")
    return rows.drop("l_linestatus").distinct().join(rows.filter("l_linestatus = 'F'"), ["work", "language"], "left_anti").select("grp", "work", "language")


@query("""WITH s AS (SELECT l_suppkey AS grp, l_linenumber AS series, l_returnflag AS title, l_orderkey AS cover, l_quantity AS size FROM lineitem), k AS (SELECT grp, series, count(*) AS n FROM s GROUP BY ALL), t AS (SELECT grp, title, count(*) AS n FROM s GROUP BY ALL)
SELECT grp, (SELECT series FROM k WHERE k.grp = s.grp ORDER BY n DESC, series LIMIT 1) AS series, (SELECT title FROM t WHERE t.grp = s.grp ORDER BY n DESC, title LIMIT 1) AS title, min(cover) FILTER (size = 50) AS cover FROM s GROUP BY grp""")
def group_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The series and title of most of a group's records, and the first of its largest covers."""
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("grp"), F.col("l_linenumber").alias("series"), F.col("l_returnflag").alias("title"), "l_orderkey", "l_quantity")
    most = lambda c: rows.groupBy("grp", c).agg(F.count("*").alias("n")).groupBy("grp").agg(F.min(F.struct((-F.col("n")).alias("minus"), c)).alias("b")).select("grp", F.col("b")[c].alias(c))
    cover = rows.groupBy("grp").agg(F.min(F.when(F.col("l_quantity") == 50, F.col("l_orderkey"))).alias("cover"))
    return most("series").join(most("title"), "grp").join(cover, "grp")


@query("""WITH m(code, iso) AS (VALUES ('A', 'de'), ('N', 'en')), f AS (SELECT l_partkey AS work, arg_min(l_returnflag, l_orderkey * 10 + l_linenumber) AS code FROM lineitem GROUP BY 1) SELECT work, coalesce(iso, lower(code)) AS language, CASE WHEN iso = 'de' THEN p_type ELSE p_name END AS original FROM f JOIN part ON p_partkey = work LEFT JOIN m USING (code)""")
def original_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A work's original title: the library's label in the original language, else the catalogue's; codes mapped."""
    codes = F.create_map(F.lit("A"), F.lit("de"), F.lit("N"), F.lit("en"))
    first = read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min_by("l_returnflag", F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("code"))
    rows = first.join(read(spark, sf_dir, "part"), "p_partkey").withColumn("language", F.coalesce(codes[F.col("code")], F.lower("code")))
    return rows.select(F.col("p_partkey").alias("work"), "language", F.when(F.col("language") == "de", F.col("p_type")).otherwise(F.col("p_name")).alias("original"))


@query("""SELECT work, arg_min(text, struct_pack(r := rank, d := doc_id)) IS NOT NULL AS described, min(rank) AS rank, md5(arg_min(text, struct_pack(r := rank, d := doc_id))) AS text FROM (SELECT doc_id % 500 AS work, doc_id, text, if(lang = 'en', 0, 1) AS rank FROM documents) x GROUP BY work""")
def description_of_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A work's description: its own language's, else a translated one, the first of each."""
    rows = read(spark, sf_dir, "documents").select((F.col("doc_id") % 500).alias("work"), "doc_id", "text", F.when(F.col("lang") == "en", 0).otherwise(1).alias("rank"))
    best = rows.groupBy("work").agg(F.min(F.struct("rank", "doc_id")).alias("b"))
    met = best.select("work", "b.*").join(rows.select("doc_id", "text"), "doc_id")
    return met.select("work", F.col("text").isNotNull().alias("described"), "rank", F.md5("text").alias("text"))
