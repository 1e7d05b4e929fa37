"""Dedup, order, streaks, visibility, ranks and sets."""

from __future__ import annotations

from .aggregates import tags
from .catalogue import SCORED
from .dialect import plan


@plan
def twin_dedup(d):
    """The best spelling of each (name, birth), the others pointing to it."""
    return """WITH t AS (SELECT c_custkey AS id, c_mktsegment AS name, c_nationkey AS birth, c_acctbal FROM customer), r AS (SELECT *, first_value(id) OVER (PARTITION BY name, birth ORDER BY c_acctbal DESC, id) AS canonical FROM t)
SELECT id, canonical, id = canonical AS kept FROM r"""


@plan
def dedup_with_volume(d):
    """In rank order the first of a key, or a volume not yet seen where neither it nor zero was."""
    return """WITH b AS (SELECT p_partkey AS work, p_name AS title_key, p_brand AS writer, p_size % 4 AS position, row_number() OVER (PARTITION BY p_name, p_brand ORDER BY p_retailprice DESC, p_partkey) AS place,
row_number() OVER (PARTITION BY p_name, p_brand, p_size % 4 ORDER BY p_retailprice DESC, p_partkey) AS mine FROM part), f AS (SELECT *, max(CASE WHEN place = 1 AND position = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY title_key, writer) AS zero_first FROM b)
SELECT work, title_key, writer, position FROM f WHERE place = 1 OR (position > 0 AND mine = 1 AND zero_first = 0)"""


@plan
def cross_source_guard(d):
    """A later entry goes if it or an earlier one of its key comes from the library."""
    return """WITH e AS (SELECT o_orderkey AS work, o_custkey AS k, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS library, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place, o_totalprice FROM orders),
g AS (SELECT *, max(library) OVER (PARTITION BY k ORDER BY place ROWS UNBOUNDED PRECEDING) AS touched FROM e) SELECT work, k, place FROM g WHERE place = 1 OR touched = 0"""


@plan
def score_clamp(d):
    """Library works rank no higher than the least score among read works."""
    return f"""WITH {SCORED} SELECT work, round(CASE WHEN ratings = 0 THEN least(score, coalesce((SELECT min(score) FROM scored WHERE ratings > 0), score)) ELSE score END, 5) AS rank_score FROM scored"""


@plan
def reading_order_anchor(d):
    """Unnumbered members stand behind the largest volume of a year not after theirs."""
    return """WITH m AS (SELECT l_suppkey AS series, l_orderkey * 10 + l_linenumber AS work, CASE WHEN l_linenumber <= 4 THEN l_linenumber ELSE 0 END AS volume, year(l_shipdate) AS y FROM lineitem),
a AS (SELECT m.*, CASE WHEN volume > 0 THEN volume ELSE coalesce(max(CASE WHEN volume > 0 THEN volume END) OVER (PARTITION BY series ORDER BY y RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) END AS anchor FROM m)
SELECT series, work, anchor, row_number() OVER (PARTITION BY series ORDER BY anchor, CASE WHEN volume > 0 THEN 0 ELSE 1 END, y, work) AS place FROM a"""


@plan
def series_positions(d):
    """The volume if all are distinct, else the ordinal; two to forty members."""
    return """WITH m AS (SELECT l_orderkey AS series, l_partkey AS work, l_linenumber AS volume, count(*) OVER (PARTITION BY l_orderkey) AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS place FROM lineitem),
s AS (SELECT series FROM m GROUP BY series HAVING count(DISTINCT volume) = count(*)) SELECT m.series, work, CASE WHEN s.series IS NULL THEN place ELSE volume END AS position FROM m LEFT JOIN s ON m.series = s.series WHERE n BETWEEN 2 AND 40 AND place <= 40"""


@plan
def longest_streak(d):
    """Longest run of consecutive days per reader."""
    return f"""WITH a AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), g AS (SELECT user_id, day, {d.plus('day', '-row_number() OVER (PARTITION BY user_id ORDER BY day)')} AS grp FROM a),
r AS (SELECT user_id, grp, count(*) AS days, min(day) AS since FROM g GROUP BY user_id, grp), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY days DESC, since) AS rn FROM r) SELECT user_id, days, since FROM k WHERE rn = 1"""


@plan
def goal_streak(d):
    """Consecutive days up to the last one on which a reader met the goal."""
    return f"""WITH a AS (SELECT user_id, CAST(ts AS DATE) AS day FROM events GROUP BY user_id, CAST(ts AS DATE) HAVING sum(value) >= 30), g AS (SELECT user_id, day, {d.plus('day', '-row_number() OVER (PARTITION BY user_id ORDER BY day)')} AS grp, max(day) OVER (PARTITION BY user_id) AS last FROM a)
SELECT user_id, count(*) AS streak, max(day) AS last FROM g WHERE grp = (SELECT max(h.grp) FROM g h WHERE h.user_id = g.user_id) GROUP BY user_id"""


@plan
def week_frame(d):
    """Each day from the first event to the last with the seven days that end in it, empty days included."""
    return f"""WITH n AS (SELECT CAST(ts AS DATE) AS day, count(*) AS pages FROM events WHERE ts IS NOT NULL GROUP BY CAST(ts AS DATE)), r AS (SELECT min(day) AS since, {d.days('max(day)', 'min(day)')} AS days FROM n), days AS (SELECT {d.plus('since', 'i')} AS day FROM (SELECT since, {d.each(d.seq('0', 'days'))} AS i FROM r) x)
SELECT days.day, coalesce(pages, 0) AS pages, CAST(sum(coalesce(pages, 0)) OVER (ORDER BY days.day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS BIGINT) AS week FROM days LEFT JOIN n ON days.day = n.day"""


@plan
def latest_visible_version(d):
    """The newest segment of a work wins; a tombstone that is newest hides it."""
    return """SELECT work, version FROM (SELECT o_custkey AS work, o_orderkey AS version, o_orderstatus AS status, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) x WHERE rn = 1 AND status <> 'P'"""


@plan
def chain_selection(d):
    """The newest base of a pack, then its later deltas in order."""
    return """WITH s AS (SELECT o_orderpriority AS pack, o_orderkey AS id, CAST(o_orderdate AS DATE) AS month, o_orderstatus = 'F' AS base FROM orders), b AS (SELECT pack, max(month) AS since FROM s WHERE base GROUP BY pack)
SELECT s.pack, id, month, base, row_number() OVER (PARTITION BY s.pack ORDER BY CASE WHEN base THEN 0 ELSE 1 END, month, id) AS place FROM s JOIN b ON s.pack = b.pack WHERE (base AND month = since) OR (NOT base AND month >= since)"""


@plan
def repeated_words(d):
    """Texts with a word that stands three times in a row or oftener."""
    found = d.words("lower(text)", "[a-z]+")
    if d.text == "STRING":  # words are found once a text and not copied for each place
        runs = "size(filter(sequence(1, size(w) - 2), i -> element_at(w, i) = element_at(w, i + 1) AND element_at(w, i) = element_at(w, i + 2)))"
        return f"SELECT doc_id, CAST(runs AS BIGINT) AS runs FROM (SELECT doc_id, explode(transform(array({found}), w -> CASE WHEN size(w) >= 3 THEN {runs} ELSE 0 END)) AS runs FROM documents) x WHERE runs > 0"
    return f"""WITH w AS (SELECT doc_id, {found} AS w FROM documents), x AS (SELECT doc_id, w, {d.each(d.seq('1', f'greatest({d.size}(w) - 2, 1)'))} AS i FROM w WHERE {d.size}(w) >= 3)
SELECT doc_id, count(*) AS runs FROM x WHERE w[i] = w[i + 1] AND w[i] = w[i + 2] GROUP BY doc_id"""


@plan
def repeated_phrase(d):
    """Texts with a window of six words that occurs three times or oftener."""
    found = d.words("lower(text)", "[a-z]+")
    if d.text == "STRING":  # words are found once a text and not copied for each place
        six = ", ".join(f"element_at(w, i + {n})" for n in range(6))
        phrases = f"x AS (SELECT doc_id, explode(flatten(transform(array({found}), w -> CASE WHEN size(w) >= 6 THEN transform(sequence(1, size(w) - 5), i -> concat_ws(' ', {six})) ELSE CAST(array() AS ARRAY<STRING>) END))) AS phrase FROM documents)"
    else:
        phrases = f"w AS (SELECT doc_id, {found} AS w FROM documents), x AS (SELECT doc_id, {d.join}({d.slice}(w, CAST(i AS INT), CAST(i AS INT) + 5), ' ') AS phrase FROM (SELECT doc_id, w, {d.each(d.seq('1', f'{d.size}(w) - 5'))} AS i FROM w WHERE {d.size}(w) >= 6) y)"
    return f"""WITH {phrases}
SELECT doc_id, max(n) AS times, count(*) AS phrases FROM (SELECT doc_id, phrase, count(*) AS n FROM x GROUP BY doc_id, phrase HAVING count(*) >= 3) z GROUP BY doc_id"""


@plan
def chapter_changes(d):
    """Turns numbered, with a header where the role changes."""
    return "SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn) <> role, TRUE) AS header FROM conversations"


@plan
def listened_deltas(d):
    """Positive steps of one to five between a reader's successive positions."""
    return """WITH p AS (SELECT user_id, event_id, CAST(floor(value) AS BIGINT) AS pos, lag(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prior FROM events)
SELECT user_id, CAST(sum(CASE WHEN pos - prior BETWEEN 1 AND 5 THEN pos - prior ELSE 0 END) AS BIGINT) AS heard FROM p GROUP BY user_id"""


@plan
def topk_by_tag(d):
    return f"WITH {SCORED}, {tags(d)} SELECT tag, work, place FROM (SELECT tag, s.work, row_number() OVER (PARTITION BY tag ORDER BY score DESC, s.work) AS place FROM tags t JOIN scored s ON t.work = s.work) x WHERE place <= 5"


@plan
def language_order(d):
    return "SELECT p_type AS language, p_partkey AS work, row_number() OVER (PARTITION BY p_name ORDER BY p_retailprice DESC, p_type, p_partkey) AS place FROM part"


@plan
def page_probe(d):
    """The third page of twenty, with a row more to tell if another follows."""
    return "SELECT work, place, count(*) OVER () > 20 AS more FROM (SELECT p_partkey AS work, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS place FROM part) x WHERE place BETWEEN 41 AND 61"


@plan
def daily_rotation(d):
    """Languages interleaved by rank; a window of twelve that moves with the day."""
    return """WITH r AS (SELECT p_partkey AS work, p_type, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS place FROM part), m AS (SELECT work, row_number() OVER (ORDER BY place, p_type) - 1 AS i, count(*) OVER () AS n FROM r WHERE place <= 10),
c AS (SELECT count(DISTINCT CAST(ts AS DATE)) AS day FROM events) SELECT work, (i - day * 12 % n + n) % n AS slot FROM m, c WHERE (i - day * 12 % n + n) % n < 12"""


@plan
def next_unread(d):
    """The first member of each series that a reader hasn't finished."""
    return """WITH m AS (SELECT DISTINCT o_custkey AS reader, l_suppkey AS series, l_linenumber AS volume, o_orderstatus AS status FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
SELECT reader, series, min(volume) AS next FROM m WHERE status <> 'F' GROUP BY reader, series"""


@plan
def seeded_shuffle(d):
    """An order that only the seed decides."""
    return f"SELECT work, place FROM (SELECT p_partkey AS work, row_number() OVER (ORDER BY md5(concat('seed-7-', CAST(p_partkey AS {d.text}))), p_partkey) AS place FROM part) x WHERE place <= 50"


@plan
def keyed_union_first(d):
    """Two lists of marks: the first of each position."""
    return """SELECT k, pos, src FROM (SELECT k, pos, src, row_number() OVER (PARTITION BY k, pos ORDER BY src) AS rn FROM (SELECT o_custkey AS k, o_orderstatus AS pos, 1 AS src FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_custkey, o_orderstatus, 2 FROM orders WHERE o_orderkey % 2 = 1) u) x WHERE rn = 1"""


@plan
def union_of_sources(d):
    return "SELECT 'c' AS source, c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 's', s_suppkey, s_name FROM supplier UNION ALL SELECT 'p', p_partkey, p_name FROM part"


@plan
def sorted_dedup(d):
    return "SELECT DISTINCT l_partkey AS work, l_returnflag AS language, l_suppkey AS number FROM lineitem"


@plan
def array_set_ops(d):
    """What two sets share, and whether they are disjoint."""
    return f"""WITH a AS (SELECT p_partkey AS work, split(p_name, ' ') AS t FROM part), b AS (SELECT t FROM a WHERE work = (SELECT min(work) FROM a)) SELECT work, {d.join}({d.ordered}({d.distinct}({d.set_and}(a.t, b.t))), ' ') AS shared, {d.size}({d.set_and}(a.t, b.t)) = 0 AS disjoint FROM a, b"""


@plan
def case_distinct(d):
    """Names that differ but in case: the first."""
    return "SELECT min(p_partkey) AS first, lower(p_type) AS name FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN upper(p_type) ELSE lower(p_type) END AS p_type FROM part) x GROUP BY lower(p_type)"


@plan
def distinct_then_take(d):
    """Distinct titles, companions removed, the first ten."""
    return "SELECT title, work FROM (SELECT p_name AS title, min(p_partkey) AS work FROM part WHERE p_type <> 'PROMO' GROUP BY p_name) x ORDER BY work LIMIT 10"


@plan
def collision_separation(d):
    """Hashed ids in a range: those that collide get the next numbers."""
    return "SELECT c_custkey AS id, slot + 1000 * (row_number() OVER (PARTITION BY slot ORDER BY c_custkey) - 1) AS placed FROM (SELECT c_custkey, c_custkey * 7919 % 1000 AS slot FROM customer) x"
