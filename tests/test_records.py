import gzip
import zipfile

from stacksift.operators.graph import components, resolved
from stacksift.operators.recommend import diversified
from stacksift.sources import records as R
from stacksift.streaming.windows import decide


def test_gzip_and_zip(spark, tmp_path):
    with gzip.open(tmp_path / "a.gz", "wt") as f:
        f.write("a\tb\t{\"x\": 1}\nc\n")
    rows = R.records(spark, str(tmp_path / "a.gz"))
    got = rows.select(R.field("record", 1).alias("b"), R.json_tail("record", "x int").alias("j")).collect()
    assert [r["b"] for r in got] == ["b", ""]
    assert got[0]["j"]["x"] == 1
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as box:
        box.writestr("m", "one|two")
    assert [r["record"] for r in R.archived(spark, str(tmp_path / "b.zip"), "|").collect()] == ["one", "two"]


def test_marc(spark):
    xml = '<record><controlfield tag="001">7</controlfield><datafield tag="245" ind1="1" ind2="0"><subfield code="a">Dune /</subfield></datafield></record>'
    book = R.marc_books(R.marc_xml(spark.createDataFrame([(xml,)], "record string"))).first()
    assert (book["control"], book["title"]) == ("7", "Dune")
    fields = [("001", "9\x1e"), ("245", "10\x1faDune\x1fbtwo\x1e")]
    base, at, directory, body = 24 + 12 * len(fields) + 1, 0, "", ""
    for tag, value in fields:
        directory += f"{tag}{len(value):04d}{at:05d}"
        at += len(value)
        body += value
    record = f"{base + len(body) + 1:05d}nam a22{base:05d}   4500" + directory + "\x1e" + body + "\x1d"
    rows = R.iso2709(spark.createDataFrame([(record,), ("short",), (None,)], "record string")).collect()
    assert {(r["field"], r["code"], r["value"]) for r in rows} == {("001", "", "9"), ("245", "a", "Dune"), ("245", "b", "two")}


def test_triples_and_xml(spark):
    lines = ['<s> <p> "a \\"b\\""@en .', "<s> <q> <o> .", "# no", "bad"]
    rows = {(r["predicate"], r["object"], r["language"]) for r in R.n_triples(spark.createDataFrame([(x,) for x in lines], "record string")).collect()}
    assert rows == {("p", 'a "b"', "en"), ("q", "o", "")}
    feed = "<feed><entry><title>A</title><id>1</id></entry><entry><title>B <i>x</i></title></entry></feed>"
    got = R.xml_records(spark.createDataFrame([(feed,)], "record string"), "entry", {"title": "title", "id": "id"}).collect()
    assert [(r["title"], r["id"]) for r in got] == [("A", "1"), ("B x", "")]


def test_reading_list(spark, tmp_path):
    (tmp_path / "l.csv").write_text('Title,Author,Where It Stands,My Rating,ISBN13\n"A, ""b""\nc",X,read,7,"=""978-1"""\nD,Y,odd,,\n')
    rows = sorted(R.reading_list(spark, str(tmp_path / "l.csv")).collect(), key=lambda r: r["title"])
    assert (rows[0]["title"], rows[0]["status"], rows[0]["rating"], rows[0]["isbn"]) == ('A, "b"\nc', "Read", 5, "9781")
    assert (rows[1]["status"], rows[1]["rating"]) == ("Want", 0)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("=1+1", "en", 1), ("x", "fr", 2)], "title string, language string, work int")
    R.write_csv(df.select("title"), str(tmp_path / "c"))
    assert "'=1+1" in "".join(p.read_text() for p in (tmp_path / "c").glob("*.csv"))
    made = R.write_release(df, str(tmp_path / "r"), "2024-01")
    assert made["languages"] == {"en": 1, "fr": 1}
    assert R.merged_manifest({"label": "o", "languages": {"de": 3}}, made)["languages"] == {"de": 3, "en": 1, "fr": 1}
    assert spark.read.parquet(str(tmp_path / "r/2024-01")).count() == 2


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (3, 4), (5, 5)], "a long, b long")
    assert {(r["node"], r["component"]) for r in components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (8, 8), (9, 8), (5, 5)}
    aliases = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (7, 8)], "old long, new long")
    live = spark.createDataFrame([(7,)], "id long")
    assert {tuple(r) for r in resolved(aliases, live).collect()} == {(1, 4), (2, 4), (3, 4)}


def test_diversified(spark):
    rows = [(1, i, f"a{i % 2}", "c", f"t{i}", 10.0 - i) for i in range(6)]
    got = diversified(spark.createDataFrame(rows, "request long, work long, author string, cluster string, title string, score double"), 10).collect()
    assert sorted(r["place"] for r in got) == [1, 2, 3, 4]


def test_decide():
    totals, leader = decide({}, {"a": 0.9})
    assert leader is None
    totals, leader = decide(totals, {"a": 0.9, "b": 0.1})
    assert leader == "a"
    totals, leader = decide({"a": 0.03}, {})
    assert totals == {} and leader is None
