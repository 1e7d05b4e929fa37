"""Names, documents, feeds, recipes, dumps and releases on small inputs of their own."""

import hashlib
import io
import json
import zipfile

import pytest

from stacksift.functions import names as N
from stacksift.plans.texts import line_words
from stacksift.sources import documents as D
from stacksift.sources import dumps, libraries, recipes
from stacksift.sources import records as R
from stacksift.streaming import windows as S


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as box:
        for name, text in members.items():
            box.writestr(name.replace("__", "/").replace("_dot_", "."), text)
    return out.getvalue()


EPUB = {
    "META-INF__container_dot_xml": '<container><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>',
    "O__p_dot_opf": '<package xmlns:dc="d"><metadata><dc:title>My Book</dc:title></metadata><manifest><item id="a" href="a.xhtml"/><item id="b" href="../b.xhtml"/><item id="c" href="c.xhtml"/></manifest><spine><itemref idref="b"/><itemref idref="a"/><itemref idref="c" linear="no"/></spine></package>',
    "O__a_dot_xhtml": "<html><body><h1>One &amp; two</h1><p>First<br/>line</p></body></html>",
    "b_dot_xhtml": "<html><head><title>x</title></head><body><p>Before</p><ul><li>item</li></ul></body></html>",
    "O__c_dot_xhtml": "<p>left out</p>",
}
W = 'xmlns:w="http://w"'
DOCX = {"word__document_dot_xml": f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Some </w:t><w:tab/><w:t>text</w:t></w:r></w:p></w:body></w:document>'}
ODT = {"content_dot_xml": '<o xmlns:text="t"><text:h>Head</text:h><text:p>Some <text:span>text</text:span></text:p></o>'}
FB2 = '<?xml version="1.0"?><FictionBook><description><title-info><book-title>The Land</book-title></title-info></description><body><title><p>Part</p></title><section><p>Words <emphasis>here</emphasis></p><poem><stanza><v>verse</v></stanza></poem></section></body></FictionBook>'


def test_documents():
    assert D.opened("x.bin", zipped(**EPUB)) == ("epub", "My Book", [("paragraph", "Before"), ("item", "item"), ("heading", "One & two"), ("paragraph", "First"), ("paragraph", "line")])
    assert D.opened("x", zipped(**DOCX)) == ("docx", "Head", [("heading", "Head"), ("paragraph", "Some text")])
    assert D.opened("x", zipped(**ODT)) == ("odt", "Head", [("heading", "Head"), ("paragraph", "Some text")])
    assert D.opened("x", FB2.encode()) == ("fb2", "The Land", [("heading", "Part"), ("paragraph", "Words here"), ("paragraph", "verse")])
    assert D.opened("a.md", b"# Head *one*\ntext\n\n- item [a](b)\n- two\n\nlast")[2] == [("heading", "Head one"), ("paragraph", "text"), ("item", "item a"), ("item", "two"), ("paragraph", "last")]
    assert D.opened("a.txt", "one\ntwo\n\n  \nthree".encode())[2] == [("paragraph", "one two"), ("paragraph", "three")]
    rich = rb"{\rtf1{\fonttbl{\f0 Arial;}}\b Caf\'e9\b0\par " + b"\\u" + b"8211? next}"
    assert D.opened("a", rich)[2] == [("paragraph", "Café"), ("paragraph", f"{chr(8211)} next")]


@pytest.mark.parametrize("data", [b"", b"PK\x03\x04broken", b"%PDF-1.4", b"<html", b"{\\rtf", b"\xff\xfe\x00", b"<?xml version='1.0'?><!DOCTYPE a [<!ENTITY b 'c'>]><FictionBook/>", zipped(a="b")])
def test_broken_documents(data):
    try:
        D.opened("x", data)
    except Exception as fault:
        assert isinstance(fault, (ValueError, KeyError, StopIteration, zipfile.BadZipFile, SyntaxError))


def test_documents_of_a_folder(spark, tmp_path):
    (tmp_path / "a.epub").write_bytes(zipped(**EPUB))
    (tmp_path / "b.txt").write_text("one\n\ntwo")
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.4")
    rows = D.documents(spark, str(tmp_path)).collect()
    assert sorted((r["format"], r["at"], r["text"]) for r in rows if not r["fault"])[:2] == [("epub", 0, "Before"), ("epub", 1, "item")]
    assert [r["fault"] for r in rows if r["fault"]] == ["ValueError: no reader for pdf"]


def test_feeds(spark):
    atom = '<feed xmlns="a"><entry><id>1</id><title>T &amp; U</title><author><name>Ann</name></author><link rel="http://opds-spec.org/acquisition/open-access" href="/1.epub" type="application/epub+zip"/><link rel="self" href="x"/></entry></feed>'
    modern = json.dumps({"publications": [{"metadata": {"title": "V", "identifier": "2", "author": [{"name": "Bo"}, "Cy"]}, "links": [{"rel": "http://opds-spec.org/acquisition", "href": "/2", "type": "t"}]}, {"links": []}]})
    got = R_rows(D.feeds(spark.createDataFrame([(atom,), (modern,), (None,)], "record string")))
    assert got == [("1", "T & U", "Ann", "/1.epub", "application/epub+zip"), ("2", "V", "Bo, Cy", "/2", "t")]


def R_rows(df):
    return sorted(map(tuple, df.collect()))


def test_names():
    for raw, name in {"Tolkien, J. R. R. (1892-1973)": "J. R. R. Tolkien", "LE GUIN, URSULA": "Ursula le Guin", "Ann Lee, editor": "Ann Lee", "King, Stephen, 1947-": "Stephen King", "Ann Lee et al.": "Ann Lee", "Oxford University Press": "", "": "", "[s.n.]": "", "123": ""}.items():
        assert N.normalized_name(raw) == name
    assert N.name_key("Lee, Ánn") == N.name_key("Ann Lee")


def test_series_in_titles():
    for title, found in {"The Way (Dune, #3)": ("The Way", "Dune", 3), "Dune, Book 2: More": ("More", "Dune", 2), "Dune 4. God": ("God", "Dune", 4), "1984": None, "Catch-22": None, "Room (2010)": None, "Foundation, Vol. 0": None}.items():
        assert N.series_of(title) == found


def test_bios():
    assert N.clean_bio("**Ann** [Lee](http://x) wrote[1].\n\n[1]: http://y") == "Ann Lee wrote ."
    long = "A sentence here. " * 100
    assert len(N.clean_bio(long)) <= 1200 and N.clean_bio(long).endswith("here.")


def test_recognised_lines():
    assert line_words("A NOVEL by  D U N E", set()) == ["dune"]
    assert line_words("d u n e  messiah", set()) == ["dune", "messiah"]
    assert line_words("dunemessiah", {"dune", "messiah"}) == ["dune", "messiah"]
    assert line_words("dunemessiah", {"dune"}) == ["dunemessiah"]


PAGE = '<div class="hit big"><a href="/b/1">Dune &amp; more</a><div>x</div></div><div class="other">no</div><div class="hit"><a href="/b/2">Emma</a></div>'
RECIPE = {"name": "r", "rows": {"element": "div.hit"}, "fields": {"title": {"element": "a"}, "link": {"element": "a", "attribute": "href"}}, "steps": [{"follow": "http://x{link}", "fields": {"id": {"json": "files.*.id"}}}], "address": "http://x/get/{id}"}


def test_recipes(spark):
    recipe = recipes.validated(json.dumps(RECIPE))
    linked = {"http://x/b/1": json.dumps({"files": [{"id": 7}, {"id": 8}]})}
    got = recipes.applied(spark.createDataFrame([("p", PAGE), ("q", None)], "page string, text string"), recipe, linked).collect()
    assert [(r["page"], r["row"], r["fields"]["title"], r["address"], r["fault"]) for r in got] == [("p", 0, "Dune & more", "http://x/get/7", None), ("p", 1, "Emma", "http://x/get/", "no page http://x/b/2")]
    assert recipes.taken("a1 b2", {"regex": r"([a-z])(\d)", "group": 2}) == ["1", "2"]
    for wrong in ({"fields": {}}, {"extra": 1}, {"fields": {"a": {"xpath": "x"}}}, {"fields": {"a": {"regex": "("}}}, {"address": "{nothing}"}, {"steps": [{"follow": "{nothing}"}]}):
        with pytest.raises(Exception):
            recipes.validated(json.dumps({**RECIPE, **wrong}))


def test_dumps_skip_what_is_broken(spark):
    lines = ["/type/author\t/authors/OL1A\t1\t2024\t{\"name\": \"Иван\", \"alternate_names\": [\"Ivan Petrov\"]}", "/type/author\t/authors/OL2A\t1\t2024\t{broken", "/type/author\tbad", "", "/type/edition\t/books/OL3M\t1\t2024\t{}", "/type/author\t/authors/OL4A\t1\t2024\t{\"name\": \"Petrov, Iván\"}", "/type/author\t/authors/OL5A\t1\t2024\t{\"name\": \"Ivan Petrov\"}"]
    df = spark.createDataFrame([(x,) for x in lines], "record string")
    assert R_rows(dumps.authors(df)) == [(1, "Ivan Petrov", 0, 4), (4, "Iván Petrov", 0, 4), (5, "Ivan Petrov", 0, 4)]
    assert dumps.editions(df).collect() == [] and dumps.release_label(df) == ""


def test_registry(spark):
    with pytest.raises(KeyError):
        libraries.library_books(spark.createDataFrame([], "record string"), "nowhere")
    assert len({s.first_id for s in libraries.SOURCES.values()}) == len(libraries.SOURCES)


def test_user_parsers(spark):
    rows = R.scanned(spark.createDataFrame([("a=1;b=2",), ("",), (None,), ("c",)], "record string"), lambda r: [(k, int(v)) for k, _, v in (p.partition("=") for p in r.split(";")) if v], "k string, v int")
    assert R_rows(rows) == [("a", 1), ("b", 2)]


def test_manifest(spark, tmp_path):
    made = R.write_release(spark.createDataFrame([("x", "en", 1), ("y", "fr", 2)], "title string, language string, work int"), str(tmp_path), "2024-02")
    assert {f.partition("/")[0] for f in made["files"]} == {"language=en", "language=fr"}
    for file, known in made["files"].items():
        data = (tmp_path / "2024-02" / file).read_bytes()
        assert known == {"size": len(data), "sha256": hashlib.sha256(data).hexdigest()}
    merged = R.merged_manifest({"languages": {"de": 3, "en": 9}, "files": {"language=de/a": {"size": 1}, "language=en/b": {"size": 2}}}, made)
    assert set(merged["files"]) == {*made["files"], "language=de/a"} and merged["languages"] == {"de": 3, "en": 1, "fr": 1}


def test_marc_text_is_decoded(spark):
    xml = '<record><leader>00000nam a22</leader><controlfield tag="001">7</controlfield><datafield tag="245" ind1="1" ind2="0"><subfield code="a">Tom &amp; <![CDATA[<Jerry>]]> &#x41;</subfield></datafield></record>'
    values = {r["value"] for r in R.marc_xml(spark.createDataFrame([(xml,)], "record string")).collect()}
    assert "Tom & <Jerry> A" in values
    triple = R.n_triples(spark.createDataFrame([('<s> <p> "a\\tb\\u0041\\\\" .',)], "record string")).first()
    assert triple["object"] == "a\tbA\\"


def test_a_batch_run_again_is_written_once(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i, i % 3) for i in range(30)], "id long, k int").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, k int").parquet(str(tmp_path / "in"))
    writer = type(stream.writeStream)
    plain = writer.foreachBatch
    monkeypatch.setattr(writer, "foreachBatch", lambda self, f: plain(self, lambda batch, n: (f(batch, n), f(batch, n))[0]))
    assert S.drained(stream, "append").count() == 30


def test_newest_snapshot(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        (tmp_path / "r").mkdir()
        S.newest_snapshot(spark, str(tmp_path / "r"))
    for name in ("a", "b"):
        spark.createDataFrame([(name,)], "x string").write.parquet(str(tmp_path / "r" / name))
    (tmp_path / "r" / "c").mkdir()
    assert S.newest_snapshot(spark, str(tmp_path / "r")).first()["x"] == "b"


def test_intermediate_tables_are_cleared(spark, tmp_path):
    from stacksift.session import clear_intermediate

    for name in ("cut-a", "stream-b", "mine"):
        (tmp_path / name).mkdir()
    assert clear_intermediate(spark, 1.0, str(tmp_path)) == 0 and clear_intermediate(spark, -1.0, str(tmp_path)) == 2
    assert [p.name for p in tmp_path.iterdir()] == ["mine"]
