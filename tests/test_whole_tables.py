"""Plans over whole tables and whole texts, against brute force on small tables of their own."""

import re
from collections import Counter
from datetime import date, datetime

import duckdb
import pytest

import __spark_entry__ as entry
from stacksift.operators.recommend import diversified
from stacksift.sources.documents import closed_references

from .compare import both

LONG = "word " * 900 + "no no no " + "one two three four five six " * 3 + "und der die das "
DOCS = [(1, LONG, "en", "a", len(LONG)), (2, "go go go go", "en", "a", None), (3, "Short and plain", "en", "b", 15), (4, "x" * 5000 + " que le temps", "fr", "b", 5013), (5, "ж" * 4000 + "ab", "en", "b", 4002)]


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    """Rows of a query over the tables given: name to (rows, schema)."""

    def rows(name, **tables):
        top = str(tmp_path_factory.mktemp(name))
        for table, (content, schema) in tables.items():
            spark.createDataFrame(content, schema).write.parquet(f"{top}/{table}.parquet")
        return [tuple(r) for r in entry.queries()[name](spark, top).collect()]

    return rows


def documents(rows=DOCS):
    return {"documents": (rows, "doc_id long, text string, lang string, source string, n_chars long")}


def words(text):
    return re.findall("[a-z]+", text.lower())


def test_repeated_words_of_long_texts(run):
    want = {}
    for doc, text, *_ in DOCS:
        w = words(text)
        want[doc] = sum(w[i] == w[i + 1] == w[i + 2] for i in range(len(w) - 2))
    assert dict(run("repeated_words", **documents())) == {d: n for d, n in want.items() if n}


def test_repeated_phrase_of_long_texts(run):
    want = set()
    for doc, text, *_ in DOCS:
        w = words(text)
        often = [n for n in Counter(tuple(w[i : i + 6]) for i in range(len(w) - 5)).values() if n >= 3]
        if often:
            want.add((doc, max(often), len(often)))
    assert set(run("repeated_phrase", **documents())) == want


def test_language_votes_of_long_texts(run):
    assert sorted(run("doc_language_vote", **documents())) == [("a", "de", 1), ("a", "en", 1), ("b", "en", 3)]


def test_script_share_of_long_texts(run):
    got = dict(run("script_share", **documents()))
    assert sorted(got) == [1, 2, 3, 4, 5] and got[5] == round(2 / 4002, 6) and got[2] == 1


TAIL = "alpha " * 600 + "tail Box set: die und der das nicht ein mit"
TEXTS = {"documents": ([(1, "The " + TAIL, "de", "a", None), (2, "x" * 30 + "\nyz / rest", "en", "a", None), (3, "beta " * 200 + "les mots", "fr", "a", None), (4, "tail tail", "en", "a", None)], documents()["documents"][1])}


def test_words_behind_the_first_characters(run):
    assert set(run("term_frequency", **TEXTS)) == {("alpha", 1, 600), ("beta", 1, 200), ("tail", 2, 3)}
    tokens = dict(run("tokenize_ascii", **TEXTS))
    assert tokens[1] == ("the " + TAIL).lower().replace(":", "") and tokens[2] == "x" * 24 + " yz rest"
    assert {d: (lang, top) for d, lang, top in run("detect_language", **TEXTS)}[1] == ("de", 7)


def test_keys_of_whole_texts(run):
    assert dict(run("match_key", **TEXTS))[1] == TAIL.lower().replace(":", "")
    keys = dict(run("title_key", **TEXTS))
    assert keys[1] == ("alpha " * 600 + "tail box set") and keys[2] == "x" * 30 + " yz" and len(keys) == 4


def test_patterns_behind_the_first_characters(run):
    assert {d for d, found in run("companion_filter", **TEXTS) if found} == {1}
    assert {d for d, _, found in run("foreign_title", **TEXTS) if found} == {3}


def test_items_are_matched_whole(run):
    item = "a passage that begins like others do and then goes on "
    tables = documents([(1, f"x {item}here", "en", "a", None), (2, f"x {item}there", "en", "a", None)])
    items = {"benchmark": ([(1, item + "here"), (2, item + "there")], "item_id long, text string")}
    assert sorted(run("containment_match", **tables, **items)) == [(1, 1), (2, 2)]


DAY = "1995-01-0"
ROWS = [(order, 1 + order % 7, order % 3, line, f"{DAY}{1 + order % 9}", "ANR"[order % 2]) for order in (1, 2, 300, 301, 401, 501, 2001, 3001, 9000) for line in (1, 2, 6)]
LINES = {"lineitem": (ROWS, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_shipdate string, l_returnflag string")}
ORDERS = {"orders": ([(o, o, "F" if o % 2 else "O", f"{DAY}{1 + o % 9}", "1") for o in sorted({r[0] for r in ROWS})], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate string, o_orderpriority string")}


def aligned_plainly(rows):
    """Series of one author in two languages that share a work at one place and none at others, each the other's only one."""
    held = {}
    for series, work, supplier, line, _, language in rows:
        held.setdefault((series, language, supplier % 5, line), set()).add(work)
    one = {k: min(v) for k, v in held.items() if len(v) == 1}
    pairs = {}
    for (a, la, author, x), work in one.items():
        for (b, lb, other, y), same in one.items():
            if work == same and author == other and la < lb:
                pairs.setdefault((a, la, b, lb, author), []).append(x == y)
    fit = {k: len(v) for k, v in pairs.items() if all(v)}
    left = Counter((a, la, author, lb) for a, la, b, lb, author in fit)
    right = Counter((b, lb, author, la) for a, la, b, lb, author in fit)
    return {(*k, n) for k, n in fit.items() if left[k[0], k[1], k[4], k[3]] == 1 == right[k[2], k[3], k[4], k[1]]}


def test_series_are_aligned(run):
    rows = [(1, 10, 1, 1, "", "A"), (1, 11, 1, 2, "", "A"), (2, 10, 1, 1, "", "N"), (2, 12, 1, 3, "", "N"), (3, 20, 2, 1, "", "A"), (4, 20, 2, 2, "", "N"), (5, 30, 3, 1, "", "A"), (6, 30, 3, 1, "", "N"), (7, 30, 3, 1, "", "N")]
    assert aligned_plainly(rows) == {(1, "A", 2, "N", 1, 1)}
    assert set(run("series_alignment", lineitem=(rows, LINES["lineitem"][1]))) == aligned_plainly(rows)


def test_all_series_and_orders(run):
    assert {(s, p) for s, _, p in run("series_members", **LINES)} == {(r[0], n) for r in ROWS for n in (1, 2, 3)}
    members = Counter(r[2] for r in ROWS)
    assert set(run("series_gap_fill", **LINES)) == {(s, 3, n) for s, n in members.items()}
    assert Counter(r[0] for r in run("reading_order_anchor", **LINES)) == members
    assert set(run("series_alignment", **LINES)) == aligned_plainly(ROWS)
    assert set(run("next_unread", **LINES, **ORDERS)) == {(r[0], r[2], 1) for r in ROWS if r[0] % 2 == 0}
    since = max(day for _, _, status, day, _ in ORDERS["orders"][0] if status == "F")
    assert {r[1] for r in run("chain_selection", **ORDERS)} == {o for o, _, status, day, _ in ORDERS["orders"][0] if (day == since if status == "F" else day >= since)}


def test_all_documents_and_their_ends(run):
    tables = documents([(5, "no widget", "en", "a", None), (900, "a " * 50 + "bolt\nwithout widget", "en", "a", None)])
    parts = {"part": ([("bolt widget",)], "p_name string")}
    assert set(run("wish_terms", **tables, **parts)) == {(5, "widget", 1), (900, "bolt", 0), (900, "widget", 1)}
    assert {(d, i): n for d, i, n, _ in run("remaining_time", **tables)} == {(5, 1): 9, (900, 1): 118, (900, 2): 14}


def test_all_readers_get_works(spark, data):
    part, readers = spark.read.parquet(f"{data}/part.parquet"), spark.read.parquet(f"{data}/customer.parquet")
    found = part.join(readers.selectExpr("c_custkey AS request", "CAST(c_custkey % 50 AS INT) AS p_size"), "p_size").selectExpr("request", "p_partkey AS work", "p_brand AS author", "p_type AS cluster", "p_name AS title", "p_retailprice AS score")
    want = sorted(map(tuple, diversified(found).collect()))
    assert sorted(map(tuple, entry.queries()["recommend_diversified"](spark, data).collect())) == want and want[-1][0] >= 100


def tagged(spark, data):
    return {r["p_partkey"]: (r["p_brand"], set(f"{r['p_name']} {r['p_type'].lower()}".split(" "))) for r in spark.read.parquet(f"{data}/part.parquet").collect()}


def test_aversion_scores_every_work(spark, data):
    works = tagged(spark, data)
    size, bad = max(works) + 1, {}
    for r in spark.read.parquet(f"{data}/events.parquet").collect():
        if r["event_type"] == "purchase" and int(r["value"] // 1) % 5 == 0 and r["user_id"] % size in works:
            author, have = works[r["user_id"] % size]
            bad.setdefault(r["user_id"], set()).update((author, t) for t in have)
    want = {}
    for user, pairs in bad.items():
        disliked = {t for _, t in pairs}
        for work, (author, have) in works.items():
            if have & disliked:
                same = any(a == author and t in have for a, t in pairs)
                want[user, work] = round(1 - (1 - 0.4 * len(have & disliked) / len(disliked)) * (1 - 0.6 * same), 6)
    got = {(u, w): float(x) for u, w, x in entry.queries()["aversion"](spark, data).collect()}
    assert got == pytest.approx(want, abs=2e-6)


def test_every_work_has_similar_ones(spark, data):
    rows = entry.queries()["tag_cosine_similar"](spark, data).collect()
    works = tagged(spark, data)
    assert {r["seed"] for r in rows} == set(works)
    assert all(r["seed"] != r["work"] and works[r["seed"]][1] & works[r["work"]][1] for r in rows)


def test_centroids_have_all_places(run):
    rows = [(1, [float(x) for x in range(12)], 0), (2, [float(x + 2) for x in range(12)], 0), (3, [5.0], 1)]
    got = run("embedding_centroids", embeddings=(rows, "vec_id long, embedding array<float>, label int"))
    assert {(label, place): mean for label, place, mean in got} == {(0, p): p for p in range(1, 13)} | {(1, 1): 5}


def test_days_follow_the_events(run):
    rows = [(n, t) for n, t in enumerate(["2023-12-30 10:00:00", "2024-02-20 10:00:00", "2024-02-20 11:00:00"])]
    got = run("week_frame", events=([(n, datetime.fromisoformat(t)) for n, t in rows], "event_id long, ts timestamp_ntz"), pages=([(1,)], "page_id long"))
    assert len(got) == 53 and min(got) == (date(2023, 12, 30), 1, 1) and max(got) == (date(2024, 2, 20), 2, 2)


def shuffled(df):
    """Rows that a frame's exchanges wrote, once it has been collected."""

    def rows(node):
        kind = node.nodeName()
        if kind == "AdaptiveSparkPlan":
            return rows(node.executedPlan())
        if kind.endswith("QueryStage"):
            return rows(node.plan())
        own = node.metrics().get("shuffleRecordsWritten").get().value() if kind == "Exchange" else 0
        return own + sum(rows(node.children().apply(i)) for i in range(node.children().size()))

    df.collect()
    return rows(df._jdf.queryExecution().executedPlan())


def test_aversion_moves_fewer_rows_than_it_returns(spark, tmp_path):
    kinds = [("bolt widget", "a", "SMALL"), ("red widget", "b", "LARGE"), ("red bolt", None, "SMALL"), ("red gear", "c", "gear"), ("gear", "a", "red")]
    parts = [(n, *kinds[n % 5]) for n in range(1500)] + [(7, "bolt gear", "d", "SMALL"), (None, "bolt widget", "a", "SMALL")]
    log = [(n, n % 97 if n % 13 else None, "purchase", float(n % 7)) for n in range(400)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(datetime(2024, 1, 1), *r[1:]) for r in log], "ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    found = duckdb.connect()
    for name in ("part", "events"):
        found.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    ours, theirs = both(spark, found, str(tmp_path), entry.queries()["aversion"], entry.oracle_sql()["aversion"])
    assert ours == theirs and len(ours) > 30_000
    assert shuffled(entry.queries()["aversion"](spark, str(tmp_path))) < len(ours) / 2


def test_aversion_exchanges_readers_and_works_instead_of_their_pairs(spark, tmp_path):
    parts = [(n, f"bolt t{n}  {'x' * (n % 3)}", None if n % 11 == 0 else f"a {n % 7}", "SMALL") for n in range(300)] + [(n, f"bolt t{n + 9}", "b", "Bolt") for n in range(0, 300, 9)]
    parts += [(n, "gear", "c", "RED") for n in range(1000, 5200)] + [(5000, None, "d", "RED"), (None, "gear t1", "c", "RED"), (6000, "", None, "")]
    log = [(n, n, "purchase", 5.0 * (n % 2)) for n in range(300)] + [(n, n % 3 and n, "purchase", float(n % 5)) for n in range(900)] + [(0, 1200, "purchase", -4.0), (0, 7201, "purchase", 0.5), (0, None, "purchase", 0.0)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(datetime(2024, 1, 1), *r[1:]) for r in log], "ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    found = duckdb.connect()
    for name in ("part", "events"):
        found.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    ours, theirs = both(spark, found, str(tmp_path), entry.queries()["aversion"], entry.oracle_sql()["aversion"])
    assert ours == theirs and len(ours) > 90_000
    assert shuffled(entry.queries()["aversion"](spark, str(tmp_path))) < len(ours) / 2


def test_states_of_works_whose_keys_meet_new_ones(spark, tmp_path):
    keys = [1, 2, 3, 12, 22, 1_000_002, 1_000_012, 1_000_022, 2_000_002, None, 2, 2]
    sizes = [10, 2, 11, 12, 22, 20, 21, 12, 3, 2, 2, None]
    rows = [(k, None if i == 2 else "bolt", "bolt" if i < 7 else "b", z) for i, (k, z) in enumerate(zip(keys, sizes, strict=True))]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    found = duckdb.connect()
    found.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet/*.parquet')")
    ours, theirs = both(spark, found, str(tmp_path), entry.queries()["state_round_trip"], entry.oracle_sql()["state_round_trip"])
    assert ours == theirs and len(ours) == len(rows) + 6


def test_titles_of_pages_as_they_stand(spark, tmp_path):
    heads = ["<h1>and&amp;&amp;&amp</h1>", "<h1>a &lt;b&gt; &quot;c&quot;</h1><p>x</p>", "<h1>this &am</h1>", "<h1>&amp;lt; &lt</h1>", "<p>none</p>", "", "<h1>&nosuch; &ampx;</h1><p>d &amp; e</p>"]
    rows = [(n, f"<html><body>{head}</body></html>") for n, head in enumerate(heads)] + [(len(heads), None), (len(heads) + 1, "")]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = duckdb.connect()
    found.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    ours, theirs = both(spark, found, str(tmp_path), entry.queries()["page_sections"], entry.oracle_sql()["page_sections"])
    assert ours == theirs and len(ours) == len(rows)


def test_closed_references():
    assert closed_references("&amp;&#65;&#x42; &eacute; &amp &copy &nosuch; &amp;lt;") == "&AB é &amp &copy &nosuch; &lt;"
