"""Records of national libraries in one shape, whatever format they come in, and the table of the sources.

A book is (source, id, title, author, isbns, language, year, series, volume); formats are read by Spark's JSON functions or
from MARC subfields, prefilters on the raw text come first.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions.text import isbn13, udf
from . import records as R
from .dumps import year_of

BOOK = ["source", "id", "title", "author", "isbns", "language", "year", "series", "volume"]
EMPTY = "array<string>"


def _isbns(raw: Column) -> Column:
    """Valid numbers of thirteen digits, once and in order."""
    found = udf(lambda xs: sorted({i for x in xs if x and (i := isbn13(x))}), EMPTY)
    return found(F.coalesce(raw, F.array().cast(EMPTY)))


def _tidy(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s*[/:;,=.]+\s*$", ""))


def books(rows: DataFrame, source: str, **columns: Column) -> DataFrame:
    """Rows in the common shape; without a title or a number they are dropped."""
    default = {"author": F.lit(""), "isbns": F.array().cast(EMPTY), "language": F.lit(""), "year": F.lit(0), "series": F.lit(""), "volume": F.lit(0)}
    made = rows.select(F.lit(source).alias("source"), *[F.coalesce(columns.get(c, default.get(c)), default.get(c, F.lit(""))).alias(c) for c in BOOK[1:]])
    return made.filter("title <> '' AND size(isbns) > 0")


def _by_record(fields: DataFrame) -> DataFrame:
    """MARC subfields gathered by record: (control, f) with f the (field, code, value) of the record."""
    return fields.groupBy("control").agg(F.collect_list(F.struct("field", "code", "value")).alias("f"))


def _values(tag: str, code: str) -> Column:
    return F.transform(F.filter("f", lambda x: (x["field"] == tag) & (x["code"] == code)), lambda x: x["value"])


def _first(tag: str, code: str) -> Column:
    return F.coalesce(F.try_element_at(_values(tag, code), F.lit(1)), F.lit(""))


def _number(text: Column) -> Column:
    return F.coalesce(F.regexp_extract(text, r"(\d{1,3})", 1).try_cast("int"), F.lit(0))


def marc21(fields: DataFrame, source: str, language: str) -> DataFrame:
    """MARC21: 245 title, 100 author, 020 numbers, 490 series; the language of 008 must be the source's and the leader a book's."""
    rows = _by_record(fields).filter((F.substring(_first("LDR", ""), 7, 2) == "am") & (F.substring(_first("008", ""), 36, 3) == language))
    return books(rows, source, id=F.col("control"), title=_tidy(_first("245", "a")), author=udf(N.normalized_name, "string")(_tidy(_first("100", "a"))), isbns=_isbns(_values("020", "a")), language=F.lit(language), year=F.coalesce(year_of(F.substring(_first("008", ""), 8, 4)), F.lit(0)), series=_tidy(_first("490", "a")), volume=_number(_first("490", "v")))


def unimarc(fields: DataFrame, source: str, language: str) -> DataFrame:
    """UNIMARC: 200 title, 700 author (surname, forename), 010 numbers, 225 or 461 series; 101 must be the source's language and
    the work literature by 105 or by its class."""
    form = F.substring(_first("105", "a"), 12, 1)
    literary = form.isin(*"abcdefg") | F.exists(_values("675", "a"), lambda c: F.startswith(c, F.lit("821")))
    rows = _by_record(fields).filter((F.substring(_first("LDR", ""), 7, 2) == "am") & (_first("101", "a") == language) & literary)
    name = F.concat_ws(", ", F.nullif(_tidy(_first("700", "a")), F.lit("")), F.nullif(_tidy(_first("700", "b")), F.lit("")))
    series = F.coalesce(F.nullif(_tidy(_first("225", "a")), F.lit("")), _tidy(_first("461", "t")))
    volume = F.coalesce(F.nullif(_first("225", "v"), F.lit("")), _first("461", "v"))
    return books(rows, source, id=F.col("control"), title=_tidy(_first("200", "a")), author=udf(N.normalized_name, "string")(name), isbns=_isbns(_values("010", "a")), language=F.lit(language), year=F.coalesce(year_of(_first("210", "d")), F.lit(0)), series=series, volume=_number(volume))


def with_persons(fields: DataFrame, persons: DataFrame, found: DataFrame) -> DataFrame:
    """Books with the identifiers that an authority file has for their author's name and birth year; a name and year with two
    different sets of identifiers has none. The file joins on (name, birth); both sides are shuffled by it."""
    key = lambda name: udf(N.name_key, "string")(udf(N.normalized_name, "string")(name))
    birth = F.coalesce(year_of(_first("100", "d")), F.lit(0))
    ids = _by_record(persons).filter(F.size(_values("100", "t")) == 0).select(key(_tidy(_first("100", "a"))).alias("name"), birth.alias("birth"), F.array_sort(F.array_distinct(_values("024", "a"))).alias("ids")).filter("name <> '' AND size(ids) > 0")
    known = ids.groupBy("name", "birth").agg(F.min("ids").alias("ids"), F.max("ids").alias("other")).filter("ids = other").drop("other")
    asked = _by_record(fields).select(F.col("control").alias("id"), key(_tidy(_first("100", "a"))).alias("name"), birth.alias("birth"))
    return found.join(asked.join(known, ["name", "birth"]).select("id", "ids"), "id", "left").withColumn("ids", F.coalesce("ids", F.array().cast(EMPTY)))


GRAPH = "`@graph` array<struct<`@id`: string, identifiedBy: array<struct<`@type`: string, value: string>>, hasTitle: array<struct<mainTitle: string>>, instanceOf: struct<language: array<struct<`@id`: string>>, contribution: array<struct<`@type`: string, agent: struct<`@id`: string, givenName: string, familyName: string>>>>, publication: array<struct<year: string>>, seriesMembership: array<struct<seriesStatement: string, seriesEnumeration: string>>, givenName: string, familyName: string>>"


def json_ld(lines: DataFrame, people: DataFrame, source: str = "libris", language: str = "swe") -> DataFrame:
    """JSON-LD graphs of an instance; an author who is only linked has the name that a second file has under the link."""
    person = lambda p: F.concat_ws(" ", F.nullif(p["givenName"], F.lit("")), F.nullif(p["familyName"], F.lit("")))
    names = people.select(F.from_json("record", GRAPH)["@graph"][1].alias("p")).select(F.col("p.`@id`").alias("agent"), person(F.col("p")).alias("linked")).filter("agent IS NOT NULL AND linked <> ''").groupBy("agent").agg(F.min("linked").alias("linked"))
    rows = lines.filter(F.contains("record", F.lit(f"language/{language}"))).select(F.from_json("record", GRAPH)["@graph"][1].alias("i")).filter("i IS NOT NULL")
    rows = rows.filter(F.exists("i.instanceOf.language", lambda x: F.endswith(x["@id"], F.lit(f"/{language}"))))
    first = F.try_element_at(F.filter("i.instanceOf.contribution", lambda c: c["@type"] == "PrimaryContribution"), F.lit(1))
    rows = rows.withColumn("agent", first["agent"]["@id"]).withColumn("inline", person(first["agent"])).join(names, "agent", "left")
    series = F.try_element_at("i.seriesMembership", F.lit(1))
    isbns = F.transform(F.filter("i.identifiedBy", lambda x: x["@type"] == "ISBN"), lambda x: x["value"])
    author = udf(N.normalized_name, "string")(F.coalesce(F.nullif("inline", F.lit("")), "linked", F.lit("")))
    return books(rows, source, id=F.element_at(F.split("i.`@id`", "/"), -1), title=_tidy(F.try_element_at("i.hasTitle", F.lit(1))["mainTitle"]), author=author, isbns=_isbns(isbns), language=F.lit(language), year=F.coalesce(year_of(F.try_element_at("i.publication", F.lit(1))["year"]), F.lit(0)), series=_tidy(series["seriesStatement"]), volume=_number(F.coalesce(series["seriesEnumeration"], F.lit(""))))


def json_chunks(chunks: DataFrame, source: str = "nlk", language: str = "kor") -> DataFrame:
    """Members of one large JSON array cut at ``\\n  }, {``: each from its @id on, its closing marks put right."""
    body = F.regexp_extract("record", r'(?s)("@id".*)$', 1)
    whole = F.concat(F.lit("{"), F.regexp_replace(body, r"[\s}\]]+$", ""), F.lit("}"))
    schema = "`@id` string, title string, creator string, issued string, isbn string, kdc string, language string"
    rows = chunks.filter(F.contains("record", F.lit(f"language/{language}"))).select(F.from_json(whole, schema).alias("j")).filter("j.`@id` IS NOT NULL")
    fine = rows.filter(F.endswith("j.language", F.lit(f"/{language}")))
    return books(fine, source, id=F.element_at(F.split("j.`@id`", "/"), -1), title=_tidy(F.col("j.title")), author=udf(N.normalized_name, "string")(F.coalesce("j.creator", F.lit(""))), isbns=_isbns(F.array("j.isbn")), language=F.lit(language), year=F.coalesce(year_of(F.col("j.issued")), F.lit(0)))


def json_lines(lines: DataFrame, source: str = "cinii", language: str = "jpn") -> DataFrame:
    """JSON lines whose parts are numbers; titles or publishers must hold kana."""
    schema = "`@id` string, title string, `dc:creator` string, `dc:publisher` string, `dc:date` string, `dcterms:hasPart` array<struct<`@id`: string>>, `dcterms:isPartOf` array<struct<`dc:title`: string>>"
    rows = lines.filter(F.contains("record", F.lit("urn:isbn:"))).select(F.from_json("record", schema).alias("j")).filter("j IS NOT NULL")
    kana = rows.filter(F.concat_ws("", "j.title", "j.`dc:publisher`").rlike("[\\u3041-\\u30ff]"))
    part = F.coalesce(F.try_element_at("j.`dcterms:isPartOf`", F.lit(1))["dc:title"], F.lit(""))
    isbns = F.transform(F.filter("j.`dcterms:hasPart`", lambda x: F.startswith(x["@id"], F.lit("urn:isbn:"))), lambda x: F.substring(x["@id"], 10, 20))
    author = udf(N.normalized_name, "string")(F.split(F.coalesce("j.`dc:creator`", F.lit("")), "[;/]")[0])
    return books(kana, source, id=F.element_at(F.split("j.`@id`", "/"), -1), title=F.trim(F.split("j.title", " : ")[0]), author=author, isbns=_isbns(isbns), language=F.lit(language), year=F.coalesce(year_of(F.col("j.`dc:date`")), F.lit(0)), series=F.trim(F.regexp_replace(part, r"[\s,;]*\d+\s*$", "")), volume=_number(part))


def rdf_xml(docs: DataFrame, source: str = "dnb", language: str = "ger") -> DataFrame:
    """rdf:Description elements: dc:title, creators' preferred names, bibo numbers, issued, dcterms:language."""
    fields = {"about": "dc:identifier", "title": "dc:title", "author": "gndo:preferredName", "isbn": "bibo:isbn13", "issued": "dcterms:issued", "lang": "dcterms:language", "series": "dcterms:isPartOf"}
    rows = R.xml_records(docs, "rdf:Description", fields).filter(F.col("lang").isin("", language))
    return books(rows, source, id=F.regexp_replace("about", r"^\(.*?\)", ""), title=_tidy(F.col("title")), author=udf(N.normalized_name, "string")("author"), isbns=_isbns(F.array("isbn")), language=F.lit(language), year=F.coalesce(year_of(F.col("issued")), F.lit(0)), series=F.trim(F.regexp_replace("series", r"[\s,;]*\d+\s*$", "")), volume=_number(F.col("series")))


@dataclass(frozen=True)
class Source:
    """A library: its language, what separates its records, how they are read, and where its ids begin."""

    language: str
    separator: str
    read: Callable[..., DataFrame]
    first_id: int
    covers: bool = False


#: A range of a hundred million ids for each source.
SOURCES = {
    name: Source(language, separator, read, (20 + n) * 100_000_000, covers)
    for n, (name, language, separator, read, covers) in enumerate(
        [
            ("dnb", "ger", "</rdf:RDF>", rdf_xml, True),
            ("bnf", "fre", "</record>", lambda r, **k: unimarc(R.marc_xml(r), "bnf", "fre"), False),
            ("sbn", "ita", "</record>", lambda r, **k: unimarc(R.marc_xml(r), "sbn", "ita"), False),
            ("bne", "spa", "\x1d", lambda r, **k: marc21(R.iso2709(r), "bne", "spa"), False),
            ("libris", "swe", "\n", json_ld, False),
            ("nlk", "kor", "\n  }, {", json_chunks, False),
            ("cinii", "jpn", "\n", json_lines, False),
        ]
    )
}


def library_books(raw: DataFrame, name: str, **more: DataFrame) -> DataFrame:
    """The books of a source's records, by its entry in the table."""
    if name not in SOURCES:
        raise KeyError(f"no source {name!r}; there are {', '.join(sorted(SOURCES))}")
    return SOURCES[name].read(raw, **more)
