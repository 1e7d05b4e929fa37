"""Sources as queries: tables are written out as a source's records, read back through its scan, and held against SQL over
the tables themselves."""

from __future__ import annotations

import uuid
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import shared_folder
from ..sources import dumps as D
from ..sources import libraries as L
from ..sources import records as R
from .registry import query
from .rules import read

QUOTE = "\""


def line(kind: str, prefix: str, number: Column, suffix: str, date: Column, json: Column) -> Column:
    """A dump's line."""
    return F.concat(F.lit(f"/type/{kind}\t/{prefix}/OL"), number.cast("string"), F.lit(f"{suffix}\t3\t"), date, F.lit("\t"), json).alias("record")


def author_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as authors: both ways of writing a name, bodies, twins by region and balance."""
    c = read(spark, sf_dir, "customer")
    n = F.col("c_custkey")
    first, last = F.concat(F.lit("Ann"), F.translate((n % 40).cast("string"), "0123456789", "abcdefghij")), F.concat(F.lit("Lee"), F.translate((n % 23).cast("string"), "0123456789", "klmnopqrst"))
    name = F.when(n % 3 == 0, F.concat(last, F.lit(", "), first)).when(n % 3 == 1, F.concat(first, F.lit(" "), last)).otherwise(F.concat(first, F.lit(" "), last, F.lit(" (author)")))
    json = F.to_json(F.struct(name.alias("name"), F.concat(F.lit("c. "), (1900 + n % 4).cast("string")).alias("birth_date"), F.when(n % 11 == 0, "org").alias("entity_type"), F.concat(F.lit("A *writer* of ["), "c_mktsegment", F.lit("](http://x.y).")).alias("bio")))
    return c.select(line("author", "authors", n, "A", F.lit("2024-01-02T00:00:00"), json))


NAMES_CHECK = """a AS (SELECT c_custkey AS id, 'Ann' || translate((c_custkey % 40)::VARCHAR, '0123456789', 'abcdefghij') || ' Lee' || translate((c_custkey % 23)::VARCHAR, '0123456789', 'klmnopqrst') AS name, (1900 + c_custkey % 4)::INT AS birth, c_mktsegment FROM customer)"""


@query(f"WITH {NAMES_CHECK} SELECT id, name, birth, min(id) OVER (PARTITION BY name, birth) AS canonical FROM a WHERE id % 11 <> 0")
def dump_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors of a dump: names in one form, birth years, twins pointing to one."""
    return D.authors(author_lines(spark, sf_dir))


@query(f"WITH {NAMES_CHECK} SELECT id, name, birth, 'A writer of ' || c_mktsegment || '.' AS bio FROM a SEMI JOIN orders ON o_custkey = id")
def wanted_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of the authors that books credit."""
    return D.people(author_lines(spark, sf_dir), read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")))


def edition_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as editions."""
    rows = read(spark, sf_dir, "lineitem")
    number = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    json = F.to_json(
        F.struct(
            F.concat(F.lit("T"), F.col("l_linenumber").cast("string")).alias("title"),
            F.array(F.struct(F.concat(F.lit("/works/OL"), F.col("l_partkey").cast("string"), F.lit("W")).alias("key"))).alias("works"),
            F.array(F.struct(F.concat(F.lit("/languages/"), F.lower("l_returnflag")).alias("key"))).alias("languages"),
            F.when(F.col("l_tax") > 0.04, F.array(F.concat(F.lit("978-"), number.cast("string")))).alias("isbn_13"),
            F.array(F.lit(-1).cast("long"), F.when(F.col("l_discount") > 0.05, number).otherwise(0).cast("long")).alias("covers"),
            F.array(F.concat(F.lit("P"), F.col("l_suppkey").cast("string"))).alias("publishers"),
            F.concat(F.lit("May "), F.year("l_shipdate").cast("string")).alias("publish_date"),
            F.when(F.col("l_quantity") >= 50, "Audio CD").otherwise("Paperback").alias("physical_format"),
        )
    )
    return rows.select(line("edition", "books", number, "M", F.lit("2024-01-01T00:00:00"), json))


@query("""SELECT l_partkey AS work, count(DISTINCT l_orderkey * 10 + l_linenumber) AS editions, count(DISTINCT l_returnflag) AS languages, min(year(l_shipdate))::INT AS first_year,
(max(if(l_discount > 0.05, 1, 0)) + max(if(l_tax > 0.04, 2, 0)) + 4 + max(if(l_quantity < 50, 8, 0)))::INT AS flags FROM lineitem GROUP BY 1""")
def dump_edition_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a dump's editions say of each work."""
    return D.facts(D.editions(edition_lines(spark, sf_dir)))


@query("""WITH e AS (SELECT *, l_orderkey * 10 + l_linenumber AS edition, lower(l_returnflag) AS language FROM lineitem)
SELECT 'title' AS kind, l_partkey AS work, language, 'T' || l_linenumber AS value, count(DISTINCT edition) AS n FROM e GROUP BY ALL
UNION ALL SELECT DISTINCT 'isbn', l_partkey, language, '978' || edition, 1 FROM e WHERE l_tax > 0.04 UNION ALL SELECT DISTINCT 'cover', l_partkey, language, edition::VARCHAR, 1 FROM e WHERE l_discount > 0.05
UNION ALL SELECT 'publisher', NULL, '', 'P' || l_suppkey, count(DISTINCT l_partkey) FROM e GROUP BY l_suppkey""")
def dump_edition_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dump's titles, numbers, covers and publishers from one scan."""
    rows = D.editions(edition_lines(spark, sf_dir))
    shape = lambda df, kind, value, n, work=F.col("work"), language=F.col("language"): df.select(F.lit(kind).alias("kind"), work.alias("work"), language.alias("language"), F.col(value).cast("string").alias("value"), n.alias("n"))
    one = F.lit(1).cast("long")
    found = shape(D.titles(rows), "title", "title", F.col("editions")).unionByName(shape(D.numbers(rows), "isbn", "isbn", one)).unionByName(shape(D.covers(rows), "cover", "cover", one))
    return found.unionByName(shape(D.publishers(rows), "publisher", "publisher", F.col("works"), F.lit(None).cast("long"), F.lit("")))


@query("""WITH t AS (SELECT max(('2020-01-0' || (1 + p_size % 9))) AS label FROM part) SELECT p_partkey AS work, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN p_partkey || ',' || (p_partkey + 1) ELSE p_partkey::VARCHAR END AS authors, if(p_size > 10, p_size, 0)::BIGINT AS cover, label
FROM part, t WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 48)""")
def dump_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works of a dump that have editions, with the release's label: their JSON is read after the semi-join."""
    part = read(spark, sf_dir, "part")
    n = F.col("p_partkey")
    key = lambda x: F.struct(F.struct(F.concat(F.lit("/authors/OL"), x.cast("string"), F.lit("A")).alias("key")).alias("author"))
    json = F.to_json(F.struct(F.col("p_name").alias("title"), F.when(n % 2 == 0, F.array(key(n), key(n + 1), key(n))).otherwise(F.array(key(n))).alias("authors"), F.array(F.lit(0).cast("long"), F.when(F.col("p_size") > 10, F.col("p_size")).otherwise(-5).cast("long")).alias("covers")))
    lines = part.select(line("work", "works", n, "W", F.concat(F.lit("2020-01-0"), (1 + F.col("p_size") % 9).cast("string"), F.lit("T01:02:03")), json))
    known = read(spark, sf_dir, "lineitem").filter("l_quantity > 48").select(F.col("l_partkey").alias("id"))
    rows = D.works(lines, known)
    return rows.select("work", "title", F.array_join(F.transform("authors", lambda a: a.cast("string")), ",").alias("authors"), "cover", F.lit(D.release_label(lines)).alias("label"))


@query("SELECT p_partkey AS cover, p_size::BIGINT * 20 AS width, floor(p_retailprice)::BIGINT AS height FROM part WHERE p_size * 20 >= 250 AND floor(p_retailprice) > 0 AND p_size * 20 / floor(p_retailprice) BETWEEN 0.58 AND 0.72")
def dump_covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covers of a dump with a book's shape."""
    rows = read(spark, sf_dir, "part").select(F.concat_ws("\t", F.col("p_partkey").cast("string"), (F.col("p_size") * 20).cast("string"), F.floor("p_retailprice").cast("string")).alias("record"))
    return D.usable_covers(rows)


@query("SELECT c_custkey AS item, c_name || ' \"x\"' AS value, 'en' AS language FROM customer UNION ALL SELECT c_custkey, 'http://e.org/' || c_nationkey, '' FROM customer UNION ALL SELECT c_custkey, c_mktsegment, '' FROM customer")
def item_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literals and addresses of a query service's answers."""
    c = read(spark, sf_dir, "customer")
    head = F.concat(F.lit("<http://www.example.org/entity/Q"), F.col("c_custkey").cast("string"), F.lit(">\t"))
    values = F.array(F.concat(F.lit('"'), "c_name", F.lit(' \\"x\\""@en')), F.concat(F.lit("<http://e.org/"), F.col("c_nationkey").cast("string"), F.lit(">")), F.concat(F.lit('"'), "c_mktsegment", F.lit('"')))
    return D.item_values(c.select(F.explode(F.transform(values, lambda v: F.concat(head, v))).alias("record")))


@query("SELECT c_custkey::VARCHAR AS c, n_name AS name, r_regionkey::VARCHAR AS r FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA' UNION SELECT c_custkey::VARCHAR, n_name, r_regionkey::VARCHAR FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'EUROPE'")
def triple_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query of triple patterns, with a union of two of them, as joins."""
    t = lambda df, s, p, o: df.select(F.col(s).cast("string").alias("subject"), F.lit(p).alias("predicate"), F.col(o).cast("string").alias("object"))
    nation, region = read(spark, sf_dir, "nation").withColumn("n", F.concat(F.lit("n"), "n_nationkey")), read(spark, sf_dir, "region")
    customer = read(spark, sf_dir, "customer").withColumn("n", F.concat(F.lit("n"), "c_nationkey"))
    triples = t(customer, "c_custkey", "of", "n").unionByName(t(nation, "n", "label", "n_name")).unionByName(t(nation, "n", "in", "n_regionkey")).unionByName(t(region, "r_regionkey", "label", "r_name"))
    either = [D.matches(triples, ("?c", "of", "?n"), ("?n", "label", "?name"), ("?n", "in", "?r"), ("?r", "label", where)) for where in ("ASIA", "EUROPE")]
    return either[0].unionByName(either[1]).select("c", "name", "r").distinct()


def isbn_digits(number: Column) -> Column:
    """Thirteen digits with their check digit for a number under a million."""
    head = F.concat(F.lit("978000"), F.lpad(number.cast("string"), 6, "0"))
    total = sum((F.substring(head, i + 1, 1).cast("int") * (3 if i % 2 else 1) for i in range(12)), F.lit(0))
    return F.concat(head, ((10 - total % 10) % 10).cast("string"))


ISBN_CHECK = "'978000' || lpad(p_partkey::VARCHAR, 6, '0') || ((10 - (list_sum([substr('978000' || lpad(p_partkey::VARCHAR, 6, '0'), i, 1)::INT * if(i % 2 = 0, 3, 1) FOR i IN range(1, 13)]) % 10)) % 10)::INT"


def shaped(df: DataFrame) -> DataFrame:
    return df.select("id", "title", "author", F.array_join("isbns", ",").alias("isbns"), "year", "series", "volume")


def book_check(id_: str, title: str, author: str, year: str, series: str, volume: str, where: str) -> str:
    return f"SELECT {id_} AS id, {title} AS title, {author} AS author, {ISBN_CHECK} AS isbns, ({year})::INT AS year, {series} AS series, ({volume})::INT AS volume FROM part WHERE {where}"


def subfield(tag: str, **codes: Column) -> Column:
    inner = [F.concat(F.lit(f'<subfield code="{c}">'), v, F.lit("</subfield>")) for c, v in codes.items()]
    return F.concat(F.lit(f'<datafield tag="{tag}" ind1=" " ind2=" ">'), *inner, F.lit("</datafield>"))


def control(tag: str, value: Column) -> Column:
    return F.concat(F.lit(f'<controlfield tag="{tag}">'), value, F.lit("</controlfield>"))


LEADER = "<record><leader>00000nam a2200000   4500</leader>"


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with what records need."""
    return read(spark, sf_dir, "part").withColumn("n", F.col("p_partkey").cast("string")).withColumn("isbn", isbn_digits(F.col("p_partkey"))).withColumn("year", (1950 + F.col("p_size")).cast("string")).withColumn("volume", (1 + F.col("p_size") % 9).cast("string"))


@query(book_check("'f' || p_partkey", "p_name || ' & more'", "'Ann Lee'", "1950 + p_size", "p_type", "1 + p_size % 9", "p_size % 4 <> 0"))
def unimarc_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literature of a French library from UNIMARC in XML."""
    form = F.when(F.col("p_size") % 4 == 0, "y").otherwise("a")
    record = F.concat(F.lit(LEADER), control("001", F.concat(F.lit("f"), "n")), subfield("010", a=F.col("isbn")), subfield("101", a=F.lit("fre")), subfield("105", a=F.concat(F.lit("y   z   00 "), form, F.lit("y"))), subfield("200", a=F.concat("p_name", F.lit(" &amp; more /"))), subfield("210", d=F.concat(F.lit("cop. "), "year")), subfield("225", a=F.col("p_type"), v=F.concat(F.lit("t. "), "volume")), subfield("700", a=F.lit("Lee"), b=F.lit("Ann")), F.lit("</record>"))
    return shaped(L.library_books(parts(spark, sf_dir).select(record.alias("record")), "bnf"))


@query(book_check("'b' || p_partkey", "p_name", "'Ann' || translate((p_size % 5)::VARCHAR, '0123456789', 'abcdefghij') || ' Lee'", "1950 + p_size", "''", "0", "p_type <> 'PROMO'").replace("FROM part", ", if(p_size % 5 IN (1, 2), 'viaf' || p_size % 5, '') AS ids FROM part"))
def authority_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books of a Spanish library with the identifiers that its authority file has for their authors; one name has two sets."""
    rows = parts(spark, sf_dir)
    name = F.concat(F.lit("Lee, Ann"), F.translate((F.col("p_size") % 5).cast("string"), "0123456789", "abcdefghij"))
    fixed = F.concat(F.lit("200101s"), "year", F.lit("    sp            000 0 "), F.when(F.col("p_type") == "PROMO", "cat").otherwise("spa"), F.lit(" d"))
    record = F.concat(F.lit(LEADER), control("001", F.concat(F.lit("b"), "n")), control("008", fixed), subfield("020", a=F.col("isbn")), subfield("100", a=name, d=F.lit("1920-")), subfield("245", a=F.col("p_name")), F.lit("</record>"))
    fields = R.marc_xml(rows.select(record.alias("record")))
    person = lambda n, ident: F.concat(F.lit("<record>"), control("001", F.lit(f"p{n}{ident}")), subfield("024", a=F.lit(ident)), subfield("100", a=F.lit(f"Lee, Ann{'abcde'[n]}"), d=F.lit("1920-1990")), F.lit("</record>"))
    people = R.marc_xml(spark.range(1).select(F.explode(F.array(person(1, "viaf1"), person(2, "viaf2"), person(3, "viaf3"), person(3, "viaf4"))).alias("record")))
    found = L.with_persons(fields, people, L.marc21(fields, "bne", "spa"))
    return found.select("id", "title", "author", F.array_join("isbns", ",").alias("isbns"), "year", "series", "volume", F.array_join("ids", ",").alias("ids"))


@query(book_check("'i' || p_partkey", "p_name", "if(p_size % 2 = 0, 'Ann Lee', if(p_size % 3 = 0, 'Bo Ek', ''))", "1950 + p_size", "p_type", "1 + p_size % 9", "p_partkey % 7 <> 0"))
def json_ld_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books of a Swedish library from JSON-LD; linked authors' names come from a second file."""
    j = lambda c: F.concat(F.lit(QUOTE), c, F.lit(QUOTE))
    agent = F.when(F.col("p_size") % 2 == 0, F.lit('{"givenName":"Ann","familyName":"Lee"}')).otherwise(F.concat(F.lit('{"@id":"http://l/p'), (F.col("p_size") % 3).cast("string"), F.lit('"}')))
    tongue = F.when(F.col("p_partkey") % 7 == 0, "nor").otherwise("swe")
    record = F.concat(F.lit('{"@graph":[{},{"@id":"http://l/i'), "n", F.lit('","identifiedBy":[{"@type":"LCCN","value":"1"},{"@type":"ISBN","value":'), j(F.col("isbn")), F.lit('}],"hasTitle":[{"mainTitle":'), j(F.col("p_name")), F.lit('}],"instanceOf":{"language":[{"@id":"https://id/language/'), tongue, F.lit('"}],"contribution":[{"@type":"PrimaryContribution","agent":'), agent, F.lit('}]},"publication":[{"year":'), j(F.col("year")), F.lit('}],"seriesMembership":[{"seriesStatement":'), j(F.col("p_type")), F.lit(',"seriesEnumeration":"del '), "volume", F.lit('"}]}]}'))
    people = spark.createDataFrame([('{"@graph":[{},{"@id":"http://l/p0","givenName":"Bo","familyName":"Ek"}]}',), ("broken",)], "record string")
    return shaped(L.library_books(parts(spark, sf_dir).select(record.alias("record")), "libris", people=people))


@query(book_check("'k' || p_partkey", "p_name", "'Kim Lee'", "1950 + p_size", "''", "0", "p_type <> 'SMALL'"))
def json_chunk_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books of a Korean library from the pieces of one large array."""
    tongue = F.when(F.col("p_type") == "SMALL", "eng").otherwise("kor")
    chunk = F.concat(F.lit('\n    "@id" : "http://k/k'), "n", F.lit('",\n "title" : "'), "p_name", F.lit('", "creator":"Lee, Kim", "issued":"'), "year", F.lit('", "isbn":"'), "isbn", F.lit('", "language":"http://lod/language/'), tongue, F.when(F.col("p_size") % 2 == 0, '"').otherwise('"\n } ]\n}'))
    return shaped(L.library_books(parts(spark, sf_dir).select(chunk.alias("record")), "nlk"))


@query(book_check("'c' || p_partkey", "p_name || ' の'", "'Lee'", "1950 + p_size", "p_type", "1 + p_size % 9", "p_size % 3 <> 0"))
def json_line_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books of Japanese libraries from JSON lines; those without kana or number go."""
    title = F.concat("p_name", F.when(F.col("p_size") % 3 == 0, "").otherwise(" の : sub"))
    record = F.to_json(F.struct(F.concat(F.lit("https://c/ncid/c"), "n").alias("@id"), title.alias("title"), F.lit("Lee; Kim").alias("dc:creator"), F.col("year").alias("dc:date"), F.array(F.struct(F.concat(F.lit("urn:isbn:"), "isbn").alias("@id"))).alias("dcterms:hasPart"), F.array(F.struct(F.concat("p_type", F.lit(" ; "), "volume").alias("dc:title"))).alias("dcterms:isPartOf")))
    return shaped(L.library_books(parts(spark, sf_dir).select(record.alias("record")), "cinii"))


@query(book_check("'d' || p_partkey", "p_name || ' <x>'", "'Ann Lee'", "1950 + p_size", "p_type", "1 + p_size % 9", "p_size % 2 = 0"))
def rdf_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books of a German library from RDF in XML."""
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))
    tongue = F.when(F.col("p_size") % 2 == 0, "ger").otherwise("eng")
    record = F.concat(F.lit("<rdf:RDF><rdf:Description>"), tag("dc:identifier", F.concat(F.lit("(DE-101)d"), "n")), tag("dc:title", F.concat("p_name", F.lit(" &lt;x&gt;"))), tag("gndo:preferredName", F.lit("Lee, Ann")), tag("bibo:isbn13", F.col("isbn")), tag("dcterms:issued", F.col("year")), tag("dcterms:language", tongue), tag("dcterms:isPartOf", F.concat("p_type", F.lit(" ; "), "volume")), F.lit("</rdf:Description></rdf:RDF>"))
    return shaped(L.library_books(parts(spark, sf_dir).select(record.alias("record")), "dnb"))


@query("""SELECT p_type AS language, p_partkey || chr(9) || p_size || chr(9) || p_brand || chr(9) || p_name || chr(9) || split_part(p_name, ' ', 1) || '; ' || split_part(p_name, ' ', 2) AS line FROM part""")
def works_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works as tab-separated lines by language, written and read back."""
    tags = F.array_join(F.split("p_name", " "), "; ")
    line_ = F.concat_ws("\t", F.col("p_partkey").cast("string"), F.col("p_size").cast("string"), "p_brand", "p_name", tags)
    path = f"{shared_folder(spark)}/works-{uuid.uuid4().hex}"
    read(spark, sf_dir, "part").select(F.col("p_type").alias("language"), line_.alias("line")).write.partitionBy("language").text(path)
    return spark.read.text(path).select("language", F.col("value").alias("line"))


@query("""SELECT p_name AS unified, count(*) AS members, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) AS works, min(p_partkey) AS first FROM part GROUP BY 1""")
def sidecar_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unified works with their members as nested Parquet, and back; only the columns asked for are read."""
    path = f"{shared_folder(spark)}/members-{uuid.uuid4().hex}"
    part = read(spark, sf_dir, "part").select(F.col("p_name").alias("unified"), F.struct(F.col("p_partkey").alias("work"), F.col("p_type").alias("language"), F.col("p_brand").alias("author")).alias("m"))
    part.groupBy("unified").agg(F.array_sort(F.collect_list("m")).alias("members")).write.parquet(path)
    back = spark.read.parquet(path).select("unified", F.col("members.work").alias("works"))
    return back.select("unified", F.size("works").cast("long").alias("members"), F.array_join(F.transform("works", lambda w: w.cast("string")), ",").alias("works"), F.array_min("works").alias("first"))


@query("""SELECT p_partkey AS work, CASE WHEN p_size % 10 = 0 THEN 'gone' WHEN p_size % 10 = 1 THEN 'changed' ELSE 'same' END AS state FROM part UNION ALL SELECT 1000000 + p_partkey, 'new' FROM part WHERE p_size % 10 = 2""")
def state_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of a release (work, hash) written, read at the next one, and what became of each work."""
    path = f"{shared_folder(spark)}/state-{uuid.uuid4().hex}"
    # a work is known by its release's number and key, as the new ones' numbers may be taken; copies of a key are told apart by their place
    copy = F.row_number().over(Window.partitionBy("p_partkey").orderBy("p_name", "p_brand", "p_size"))
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("work"), copy.alias("copy"), "p_name", "p_brand", F.coalesce(F.col("p_size") % 10, F.lit(-1)).alias("change"))
    hashed = F.xxhash64("p_name", "p_brand")
    part.select(F.lit(0).alias("release"), "work", "copy", hashed.alias("hash")).write.parquet(path)
    now = part.filter("change <> 0").select(F.lit(0).alias("release"), "work", "copy", F.when(F.col("change") == 1, F.xxhash64("p_name", "p_brand", F.lit("changed"))).otherwise(hashed).alias("now"))
    now = now.unionByName(part.filter("change = 2").select(F.lit(1).alias("release"), (1000000 + F.col("work")).alias("work"), "copy", F.xxhash64("p_name").alias("now")))
    old, key = spark.read.parquet(path), ("release", "work", "copy")
    both = old.alias("o").join(now.alias("n"), reduce(and_, (F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key)), "full")
    state = F.when(F.col("now").isNull(), "gone").when(F.col("hash").isNull(), "new").when(F.col("hash") != F.col("now"), "changed").otherwise("same")
    return both.select(F.coalesce("o.work", "n.work").alias("work"), state.alias("state"))


@query("""SELECT doc_id AS work, md5(text) AS text, lang AS target FROM documents WHERE lang <> 'en' AND text IS NOT NULL""")
def translation_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts to be translated as JSON lines, and their results read back."""
    path = f"{shared_folder(spark)}/requests-{uuid.uuid4().hex}"
    read(spark, sf_dir, "documents").filter("lang <> 'en' AND text IS NOT NULL").select(F.col("doc_id").alias("work"), "text", F.col("lang").alias("target")).write.json(path)
    return spark.read.schema("work long, text string, target string").json(path).select("work", F.md5("text").alias("text"), "target")
