import pytest

from stacksift.engine import Engine
from stacksift.operators import search as S

WORKS = [(1, "Dune", "Frank Herbert", "en", "Dune", 1, 1.0, "9780441013593"), (2, "Dune Messiah", "Frank Herbert", "en", "Dune", 2, 0.8, "2"), (3, "Children of Dune", "Frank Herbert", "en", "Dune", 3, 0.7, "3"), (4, "Emma", "Jane Austen", "en", None, None, 0.9, "4"), (5, "The Silmarillion", "J. Tolkien", "en", None, None, 0.6, "5"), (6, "The Hobbit", "J. Tolkien", "de", None, None, 0.95, "6"), (7, "Messiah", "Other Writer", "fr", None, None, 0.1, "7")]


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark.createDataFrame(WORKS, "work long, title string, author string, language string, series string, position int, popularity double, number string"))


def ids(engine, query):
    return [r["work"] for r in engine.search(query)[0]]


def test_ranking(engine):
    assert ids(engine, "dune") == [1, 2, 3]
    assert ids(engine, "silmarilion") == [5]
    assert ids(engine, "hobit") == [6]
    assert ids(engine, "xyzzy qwerty") == []
    assert ids(engine, "") == []
    assert ids(engine, "herbert")[0] == 1


def test_pages(engine):
    first, more = engine.search("dune", 0, 2)
    rest, end = engine.search("dune", 1, 2)
    assert ([r["work"] for r in first], more, [r["work"] for r in rest], end) == ([1, 2], True, [3], False)


def test_lookups(engine):
    assert engine.work(4)["title"] == "Emma" and engine.work(99) is None
    assert engine.number("978-0441013593")["work"] == 1
    assert [r["work"] for r in engine.series("Dune").collect()] == [1, 2, 3]
    assert [r["work"] for r in engine.author("J. Tolkien").collect()] == [6, 5]
    assert [(r["language"], r["works"]) for r in engine.languages().collect()] == [("en", 5), ("de", 1), ("fr", 1)]
    assert [r["work"] for r in engine.catalogue("en", 2).collect()] == [1, 4]
    assert [r["work"] for r in engine.similar(2).collect()] == [1, 7]
    assert engine.suggest("tolk")["authors"] == ["J. Tolkien"]
    assert engine.screen("dune mes")["completions"] == ["messiah"]


def test_visible(spark, engine):
    fewer = Engine(engine.works, spark.createDataFrame([(2,)], "work long"))
    assert ids(fewer, "dune") == [2]


def test_lines(spark, engine):
    lines = spark.createDataFrame([(1, "CHILDREN OF DUNE"), (2, "nothing")], "line int, text string")
    best = S.line_matches(engine.index, lines).filter("place = 1").collect()
    assert [(r["line"], r["work"], r["coverage"]) for r in best] == [(1, 3, 1.0)]


def test_soft_similarity(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("dune", "dune"), ("dun", "dune"), ("dine", "dune"), ("silmarilion", "silmarillion"), ("a", "b")], "a string, b string")
    assert [round(r[0], 3) for r in rows.select(S.soft_similarity(F.col("a"), F.col("b"))).collect()] == [1.0, 0.6, 0.75, 0.75, 0.0]


def test_seeds(engine):
    works = lambda *seed: [r["work"] for r in engine.recommend(*seed).orderBy("place").collect()]
    assert works("work", 2)[0] == 1 and 2 not in works("work", 2)
    assert works("writer", "Frank Herbert") == [7] and works("saga", "Dune") == [7]
    assert works("mix", [1, 7])[0] == 2
    assert works("library", {2: 3.0, 5: 1.0}).count(6) == 1
    with pytest.raises(ValueError):
        engine.recommend("nothing", 1)


def test_evaluation_and_resolver(engine):
    got = engine.evaluate(lambda e, work: [r["work"] for r in e.similar(work).collect()], {2: {1, 7}, 4: {1}})
    assert got == {"recall": 0.5, "mrr": 0.5}
    assert engine.resolve(4)["title"] == "Emma" and engine.resolve(99, lambda w: w + 1) == 100 and engine.resolve(99) is None


def test_misspellings_only_where_rare(spark):
    many = [(n, f"dune volume{n}", "A", "en", None, None, 0.1, str(n)) for n in range(60)] + [(90, "dunes of sand", "B", "en", None, None, 0.1, "90"), (91, "june", "C", "en", None, None, 0.1, "91")]
    big = Engine(spark.createDataFrame(many, "work long, title string, author string, language string, series string, position int, popularity double, number string"))
    terms = lambda q: {r["term"] for r in S.expanded(big.index, q)[0].collect()}
    assert terms("dune x") == {"dune"} and "dunes" in terms("dune")
    assert "dune" in terms("dvne x") and "june" in terms("jvne x")
    assert sum(t.startswith("volume") for t in terms("vol")) == S.COMPLETIONS
