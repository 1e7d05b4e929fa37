"""Entity passes and places against plain code."""

import random

from stacksift.operators import entities as E
from stacksift.operators.graph import components, resolved
from stacksift.operators.order import placed
from stacksift.plans.texts import cast, rebuilt
from pyspark.sql import functions as F


def apply_plainly(cluster, language, wishes):
    """One round: cluster by node, language by node, wishes as (source, target) of clusters."""
    spoken = {}
    for node, c in cluster.items():
        spoken.setdefault(c, set()).add(language[node])
    least = {}
    for s, t in wishes:
        if s != t:
            least[s] = min(t, least.get(s, t))
    targets = set(least.values())
    least = {s: t for s, t in least.items() if s not in targets}
    moved = {}
    for s, t in least.items():
        rivals = [x for x, y in least.items() if y == t and x != s and spoken[x] & spoken[s]]
        if not rivals and not spoken[s] & spoken[t]:
            moved[s] = t
    return {node: moved.get(c, c) for node, c in cluster.items()}


def rows(df):
    return {r["node"]: r["cluster"] for r in df.collect()}


def made(spark, cluster, language):
    return spark.createDataFrame([(n, language[n], c) for n, c in cluster.items()], "node long, language string, cluster long")


def test_proposals(spark):
    rng = random.Random(3)
    for n in range(4):
        language = {i: rng.choice("abcd") for i in range(40)}
        cluster = {i: i for i in range(40)}
        wishes = [(rng.randrange(40), rng.randrange(40)) for _ in range(30)]
        if not n:
            wishes = []
        got = E.applied(made(spark, cluster, language), spark.createDataFrame(wishes, "source long, target long"))
        want = apply_plainly(cluster, language, wishes)
        assert rows(got) == want
        again = apply_plainly(want, language, [(want[s], want[t]) for s, t in wishes])
        more = E.applied(got, spark.createDataFrame([(want[s], want[t]) for s, t in wishes], "source long, target long"))
        assert rows(more) == again


def test_clusters_keep_one_work_a_language(spark):
    rng = random.Random(5)
    language = {i: rng.choice("abc") for i in range(30)}
    wishes = [(rng.randrange(30), rng.randrange(30)) for _ in range(60)]
    got = rows(E.merged(made(spark, {i: i for i in range(30)}, language), spark.createDataFrame(wishes, "source long, target long")))
    held = {}
    for node, c in got.items():
        assert language[node] not in held.setdefault(c, set())
        held[c].add(language[node])


def test_items(spark):
    language = {1: "a", 2: "b", 3: "a", 4: "a", 5: "c", 6: "b"}
    clusters = made(spark, {i: i for i in language}, language)
    items = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, "y"), (5, None), (6, "z")], "node long, item string")
    assert {tuple(r) for r in E.by_item(clusters, items).collect()} == {(2, 1)}
    split_ = made(spark, {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6}, language)
    odd = spark.createDataFrame([(1, "x"), (2, "w"), (6, "x")], "node long, item string")
    assert E.by_item(split_, odd).collect() == []


def test_series_propagation(spark):
    books = [(1, "de", "Scheibenwelt", "P", 1), (2, "de", "Scheibenwelt", "P", 2), (3, "de", "Scheibenwelt", "P", 3), (11, "en", "Discworld", "P", 1), (12, "en", "Discworld", "P", 2), (13, "en", "Discworld", "P", 3), (21, "en", "Other", "P", 1), (22, "en", "Other", "Q", 2), (14, "en", "Discworld", "P", 4), (15, "en", "Discworld", "P", 4)]
    nodes = spark.createDataFrame(books, "node long, language string, series string, author string, position int")
    language = {b[0]: b[1] for b in books}
    cluster = {n: n for n in language}
    cluster[12] = 2  # one volume is known to be the same
    got = rows(E.propagated(nodes, made(spark, cluster, language)))
    assert [got[n] == got[n + 10] for n in (1, 2, 3)] == [True] * 3
    assert got[21] == 21 and got[14] == 14 and got[15] == 15
    cluster[13] = 1  # and one contradicts
    got = rows(E.propagated(nodes, made(spark, cluster, language)))
    assert got[1] != got[11] and got[3] == 3


def test_author_aliases(spark):
    credits = [(1, 5, "a b"), (1, 7, "a b"), (2, 7, "a b"), (2, 2000, "a b"), (3, 9, ""), (3, 10, ""), (4, 30, "x"), (4, 31, "y")] + [(9, 100 + i, "many") for i in range(9)]
    got = E.author_aliases(spark.createDataFrame(credits, "unified long, number long, name string"), F.col("number") > 5)
    assert {tuple(r) for r in got.collect()} == {(5, 7), (2000, 7)}


def test_components_of_structs(spark):
    edges = spark.createDataFrame([((0, 1), (1, 9)), ((0, 2), (1, 9)), ((0, 3), (1, 8))], "a struct<kind:int,id:long>, b struct<kind:int,id:long>")
    got = {(r["node"]["kind"], r["node"]["id"]): r["component"]["id"] for r in components(edges).collect()}
    assert got == {(0, 1): 1, (0, 2): 1, (1, 9): 1, (0, 3): 3, (1, 8): 3}


def test_aliases_of_any_length(spark):
    aliases = spark.createDataFrame([(n, n + 1) for n in range(20)], "old long, new long")
    none = spark.createDataFrame([], "id long")
    for hops in (1, 3, 5, 6, 8):
        got = {r["old"]: r["new"] for r in resolved(aliases, none, hops).collect()}
        assert got == {n: min(20, n + hops) for n in range(20)}
    ring = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "old long, new long")
    assert {tuple(r) for r in resolved(ring, none, 8).collect()} == {(1, 3), (2, 1), (3, 2)}


def test_places(spark):
    rng = random.Random(2)
    data = [(i, rng.randrange(6), rng.randrange(1, 9)) for i in range(500)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "id long, k int, size long").repartition(7)
    got = {r["id"]: (r["place"], r["running"]) for r in placed(df, F.col("k").desc(), "id", total="size").collect()}
    total = 0
    for n, (i, _, size) in enumerate(sorted(data, key=lambda x: (-x[1], x[0])), 1):
        total += size
        assert got[i] == (n, total)
    assert placed(df.limit(0), "id").collect() == []


def test_passages(spark):
    data = [(1, 0, 0, "ab"), (1, 0, 5, "cd"), (1, 0, 6, "e"), (1, 1, 3, "x"), (2, 0, 0, "")]
    got = {(r["conv_id"], r["paragraph"]): r["text"] for r in rebuilt(spark.createDataFrame(data, "conv_id long, paragraph long, at long, text string")).collect()}
    assert got == {(1, 0): "ab   cde", (1, 1): "   x", (2, 0): ""}


def test_cast(spark):
    people = [("b", "Ann", 9, "f", 22), ("b", "Bea", 5, "f", 21), ("b", "Cid", 5, "m", 80), ("c", "Ann", 1, "f", 70)]
    got = {(r["book"], r["character"]): r["voice"] for r in cast(spark.createDataFrame(people, "book string, character string, lines long, gender string, age int")).collect()}
    assert got == {("b", "Ann"): "alma", ("b", "Bea"): "berta", ("b", "Cid"): "dan", ("c", "Ann"): "eva"}
