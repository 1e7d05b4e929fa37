"""Scans, predicates, scores and roll-ups of works, editions and reading logs.

Works are parts, editions line items, the reading log events, reading lists orders.
"""

from __future__ import annotations

from .dialect import plan

#: The reading log by work: a view wants, a click reads, a purchase finishes and rates from 1 to 5.
LOG = """log AS (SELECT CAST(user_id % (SELECT max(p_partkey) + 1 FROM part) AS BIGINT) AS work, user_id, ts, event_type AS kind,
  CASE WHEN event_type = 'purchase' THEN 1 + CAST(floor(value) AS BIGINT) % 5 END AS rating, value FROM events)"""
SIGNALS = """signals AS (SELECT work, least(count(*) FILTER (WHERE kind = 'view'), 65535) AS want, least(count(*) FILTER (WHERE kind = 'click'), 65535) AS reading,
  least(count(*) FILTER (WHERE kind = 'purchase'), 65535) AS finished, least(count(rating), 65535) AS ratings, CAST(coalesce(sum(rating), 0) AS BIGINT) AS rating_total FROM log GROUP BY work)"""
FACTS = """facts AS (SELECT l_partkey AS work, least(count(*), 65535) AS editions, count(DISTINCT l_returnflag) AS languages, min(year(l_shipdate)) AS first_year,
  CAST(max(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) + 2 * max(CASE WHEN l_tax > 0.04 THEN 1 ELSE 0 END) + 4 * max(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS flags FROM lineitem GROUP BY l_partkey)"""
#: What an edition tells: 1 a cover, 2 a number, 4 a publisher, and that it can be read unless it is the audio book.
LANGUAGES = """editions AS (SELECT l_partkey AS work, l_returnflag AS language, count(*) AS language_editions, max(CASE WHEN l_quantity < 50 THEN 1 ELSE 0 END) AS readable FROM lineitem GROUP BY l_partkey, l_returnflag)"""
#: What the work itself tells.
TRAITS = """traits AS (SELECT p_partkey AS work, CASE WHEN length(p_brand) > 0 THEN 1 ELSE 0 END AS has_author, CASE WHEN length(trim(p_name)) > 0 THEN 1 ELSE 0 END AS good_title, CASE WHEN p_type <> 'STANDARD' THEN 1 ELSE 0 END AS has_subjects,
  CASE WHEN p_type = 'PROMO' THEN 1 ELSE 0 END AS bad_subject, CASE WHEN p_size % 3 > 0 THEN 1 ELSE 0 END AS has_description, CASE WHEN p_size > 45 THEN 1 ELSE 0 END AS has_cover FROM part)"""
#: The whole score of a work in a language, and that of the language with most editions (the first on ties) as the work's.
SCORED = f"""{LOG}, {SIGNALS}, {FACTS}, {LANGUAGES}, {TRAITS}, by_language AS (SELECT f.work, e.language, language_editions, readable, f.editions, f.languages, f.first_year, f.flags, coalesce(ratings, 0) AS ratings, coalesce(rating_total, 0) AS rating_total,
  coalesce(want, 0) AS want, coalesce(reading, 0) AS reading, coalesce(finished, 0) AS finished, has_author, good_title, has_subjects, bad_subject, has_description, has_cover,
  100 * ln(1 + 3 * coalesce(finished, 0) + 2 * coalesce(reading, 0) + coalesce(want, 0)) + 60 * ln(1 + coalesce(ratings, 0)) + 20 * ln(1 + f.editions) + 30 * ln(1 + language_editions) + 45 * ln(greatest(f.languages, 1))
  + CASE WHEN coalesce(ratings, 0) >= 5 THEN 18 * (rating_total * 1.0e0 / ratings - 3.6e0) ELSE 0 END + CASE WHEN f.flags % 2 = 1 OR has_cover = 1 THEN 30 ELSE 0 END + 22 * has_description + 15 * has_subjects
  + CASE WHEN f.flags % 4 >= 2 THEN 10 ELSE 0 END + CASE WHEN f.flags >= 4 THEN 8 ELSE 0 END + CASE WHEN f.first_year >= 1950 THEN 6 ELSE 0 END AS score
  FROM facts f JOIN editions e ON f.work = e.work JOIN traits t ON t.work = f.work LEFT JOIN signals s ON f.work = s.work),
scored AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY work ORDER BY language_editions DESC, language) AS main FROM by_language) m WHERE main = 1)"""


@plan
def signals_per_work(d):
    return f"WITH {LOG}, {SIGNALS} SELECT * FROM signals"


@plan
def facts_fold(d):
    return f"WITH {FACTS} SELECT * FROM facts"


@plan
def language_edition_pivot(d):
    return """SELECT l_partkey AS work, count(*) FILTER (WHERE l_returnflag = 'A') AS editions_a, count(*) FILTER (WHERE l_returnflag = 'N') AS editions_n,
count(*) FILTER (WHERE l_returnflag = 'R') AS editions_r, count(DISTINCT l_returnflag) AS languages FROM lineitem GROUP BY l_partkey"""


@plan
def quality_score(d):
    """0.7 of the readers' logarithm against 50,000 and 0.3 of the Bayesian rating above 3."""
    return f"""WITH {LOG}, {SIGNALS} SELECT work, round(0.7e0 * least(1, ln(1 + want + reading + finished) / ln(50001)) + 0.3e0 * greatest(0, least(1, ((rating_total + 10 * 3.5e0) / (ratings + 10) - 3) / 2)), 6) AS quality FROM signals"""


@plan
def library_score(d):
    """Supply-side score from formats, editions, translations, series and recency within ten years."""
    return """SELECT l_partkey AS work, round(150 + 20 * ln(1 + count(DISTINCT l_linestatus)) + 15 * ln(1 + count(*)) + 20 * ln(count(DISTINCT l_returnflag))
+ 15 * max(CASE WHEN l_linenumber > 1 THEN 1 ELSE 0 END) + 10 * greatest(0, 1 - (1998 - max(year(l_shipdate))) / 10.0e0), 4) AS score FROM lineitem GROUP BY l_partkey"""


@plan
def pack_assignment(d):
    """Children's, young adults' or the first genre pack, else general."""
    return """SELECT p_partkey AS work, CASE WHEN p_size <= 10 THEN 'kids' WHEN p_size <= 18 THEN 'young-adult'
WHEN p_type IN ('ECONOMY', 'PROMO', 'STANDARD') THEN lower(p_type) ELSE 'general' END AS pack FROM part"""


@plan
def year_of_edition(d):
    """First run of four digits from 1450 on that isn't a placeholder."""
    return f"""WITH y AS (SELECT event_id, {d.kept(d.mapped(d.words("concat('ed. 1800, ', CAST(1400 + event_id % 700 AS " + d.text + "), ' / ', CAST(ts AS " + d.text + "))", "[0-9]+"), "x", "CAST(x AS BIGINT)"), "v", "v BETWEEN 1450 AND 2027 AND v NOT IN (1800, 1900)")} AS years FROM events)
SELECT event_id, coalesce({'try_element_at(years, 1)' if d.text == 'STRING' else 'years[1]'}, 0) AS year FROM y"""


@plan
def id_extraction(d):
    """The digits behind a key's prefix."""
    return f"""SELECT c_custkey, CAST({'regexp_extract(c_name, ' + "r'#0*([0-9]+)', 1)" if d.text == 'STRING' else "regexp_extract(c_name, '#0*([0-9]+)', 1)"} AS BIGINT) AS id FROM customer WHERE {d.like('c_name', '#[0-9]+')}"""


@plan
def edition_flags(d):
    """Bit mask: 1 numbered, 2 cover, 4 publisher, 8 readable."""
    return """SELECT l_orderkey, l_linenumber, l_partkey, CAST((CASE WHEN l_quantity > 10 THEN 1 ELSE 0 END) + (CASE WHEN l_discount > 0.02 THEN 2 ELSE 0 END)
+ (CASE WHEN l_suppkey > 0 THEN 4 ELSE 0 END) + (CASE WHEN l_returnflag = 'N' THEN 8 ELSE 0 END) AS BIGINT) AS flags FROM lineitem"""


@plan
def usable_cover(d):
    """At least 250 wide, with an aspect from 0.58 to 0.72."""
    return "SELECT p_partkey AS work, p_size * 20 AS width, p_retailprice AS height, p_size * 20 >= 250 AND p_size * 20 / p_retailprice BETWEEN 0.58 AND 0.72 AS usable FROM part WHERE p_retailprice > 0"


@plan
def bad_title_filter(d):
    """Titles that are empty, numbers, collections or volume ranges."""
    return f"""SELECT p_partkey AS work, p_name AS title FROM part WHERE NOT ({d.like('lower(p_name)', '^(collected|complete|selected) ')} OR {d.like('p_name', '^[0-9]+$')} OR {d.like('lower(p_name)', 'vol[.] ?[0-9]+ ?- ?[0-9]+')} OR length(trim(p_name)) = 0)"""


@plan
def companion_filter(d):
    """Study aids and omnibus editions by pattern."""
    return f"""SELECT doc_id, {d.like("lower(text)", "study guide|companion|summary of|box(ed)? set|omnibus")} AS companion FROM documents"""


@plan
def band_points(d):
    """The first band that a value reaches gives its points."""
    return """SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity >= 45 THEN 12 WHEN l_quantity >= 30 THEN 8 WHEN l_quantity >= 15 THEN 4 WHEN l_quantity >= 5 THEN 1 ELSE 0 END AS points FROM lineitem"""


@plan
def cover_score(d):
    """Best edition's cover per work: readers, year and publisher reach in bands, less for specials."""
    return """WITH reach AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey),
c AS (SELECT l_partkey AS work, l_orderkey * 10 + l_linenumber AS cover, CASE WHEN l_quantity >= 40 THEN 60 WHEN l_quantity >= 20 THEN 30 ELSE 10 END
 + CASE WHEN year(l_shipdate) >= 1997 THEN 20 WHEN year(l_shipdate) >= 1994 THEN 10 ELSE 0 END + CASE WHEN n >= 600 THEN 15 ELSE 5 END - CASE WHEN l_returnflag = 'R' THEN 25 ELSE 0 END AS points
 FROM lineitem JOIN reach USING (l_suppkey)),
r AS (SELECT *, row_number() OVER (PARTITION BY work ORDER BY points DESC, cover) AS rn FROM c) SELECT work, cover, CAST(points AS BIGINT) AS points FROM r WHERE rn = 1"""


@plan
def json_props_projection(d):
    """Fields of a JSON column with defaults where they are missing."""
    return f"""SELECT event_id, trim(coalesce({d.get('props', 'k')}, '')) AS k, trim(coalesce({d.get('props', 'ref')}, '')) AS ref, coalesce({d.get('props', 'nothing')}, '-') AS missing FROM events"""


@plan
def tsv_fields(d):
    """The n-th field of a delimited line, empty when it is missing."""
    part = "split_part(line, '|', {})"
    return f"""WITH l AS (SELECT event_id, concat(event_type, '|', CAST(user_id AS {d.text}), '|', props) AS line FROM events) SELECT event_id, {part.format(1)} AS a, {part.format(2)} AS b, {part.format(9)} AS c FROM l"""


@plan
def csv_formula_guard(d):
    """Cells that a spreadsheet would run get an apostrophe; all are quoted."""
    return f"""SELECT doc_id, concat('"', replace(CASE WHEN {d.like('text', '^[=+@-]')} THEN concat('''', text) ELSE text END, '"', '""'), '"') AS cell FROM (SELECT doc_id, concat(CASE doc_id % 4 WHEN 0 THEN '=' WHEN 1 THEN '-' ELSE '' END, substr(text, 1, 40)) AS text FROM documents) x"""


@plan
def reading_import(d):
    """Rows of a reading list: status, rating rounded into 0 to 5, days kept."""
    return """SELECT o_orderkey AS work, o_custkey AS reader, CASE o_orderstatus WHEN 'F' THEN 'Read' WHEN 'O' THEN 'Reading' ELSE 'Want' END AS status,
greatest(0, least(5, CAST(round(o_totalprice / 60000) AS INT))) AS rating, CAST(o_orderdate AS DATE) AS updated FROM orders"""


@plan
def default_left_join(d):
    """A lookup whose missing rows are zeros."""
    return f"""WITH {LOG}, {SIGNALS} SELECT p_partkey AS work, coalesce(want, 0) AS want, coalesce(finished, 0) AS finished FROM part LEFT JOIN signals ON p_partkey = work"""


@plan
def sticky_semi_join(d):
    """Works with editions, or published before."""
    return "SELECT p_partkey AS work FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45) OR EXISTS (SELECT 1 FROM orders WHERE o_orderkey = p_partkey AND o_orderstatus = 'F')"


@plan
def tombstone_anti_join(d):
    """Works of the previous release that the new one lacks."""
    return """WITH m AS (SELECT max(CAST(o_orderdate AS DATE)) AS last FROM orders), old AS (SELECT DISTINCT o_custkey AS work FROM orders), new AS (SELECT DISTINCT o_custkey AS work FROM orders, m WHERE year(o_orderdate) = year(last))
SELECT work FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.work = old.work)"""


@plan
def changed_rows(d):
    """New works, and works whose content hash differs."""
    return """WITH old AS (SELECT o_custkey AS work, md5(concat(max(o_orderstatus), '|', CAST(count(*) AS VARCHAR(20)))) AS hash FROM orders WHERE o_orderdate < CAST('1997-01-01' AS TIMESTAMP) GROUP BY o_custkey),
new AS (SELECT o_custkey AS work, md5(concat(max(o_orderstatus), '|', CAST(count(*) AS VARCHAR(20)))) AS hash FROM orders GROUP BY o_custkey)
SELECT new.work, CASE WHEN old.work IS NULL THEN 'new' ELSE 'changed' END AS change FROM new LEFT JOIN old ON new.work = old.work WHERE old.work IS NULL OR old.hash <> new.hash"""


@plan
def isbn_vote_match(d):
    """Groups (suppliers) meet works over shared numbers; most votes, then the smaller work."""
    return """WITH v AS (SELECT l_suppkey AS grp, l_partkey AS work, count(*) AS votes FROM lineitem GROUP BY l_suppkey, l_partkey),
r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY votes DESC, work) AS rn FROM v) SELECT grp, work, votes FROM r WHERE rn = 1"""


@plan
def mutual_best(d):
    """Each group's best claimant, kept where the group is also the claimant's best."""
    return """WITH v AS (SELECT l_suppkey AS grp, l_partkey AS work, count(*) AS votes FROM lineitem GROUP BY l_suppkey, l_partkey),
r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY votes DESC, work) AS a, row_number() OVER (PARTITION BY work ORDER BY votes DESC, grp) AS b FROM v) SELECT grp, work, votes FROM r WHERE a = 1 AND b = 1"""


@plan
def unique_key_match(d):
    """A key maps to its work only if one work has it."""
    return "SELECT p_name AS title_key, CASE WHEN count(*) = 1 THEN min(p_partkey) END AS work FROM part GROUP BY p_name"


@plan
def orphan_groups(d):
    """Claimed groups enrich works; unclaimed ones become works of their own, by a full join."""
    return """WITH c AS (SELECT DISTINCT l_partkey AS work FROM lineitem WHERE l_quantity >= 48) SELECT coalesce(p_partkey, 1000000000 + o_orderkey) AS work, CASE WHEN p_partkey IS NULL THEN 'orphan' WHEN o_orderkey IS NULL THEN 'plain' ELSE 'enriched' END AS kind
FROM (SELECT p_partkey FROM part JOIN c ON work = p_partkey) p FULL JOIN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0) o ON p_partkey = o_orderkey"""


@plan
def posting_intersection(d):
    """Works that carry every wished tag."""
    return f"""WITH t AS (SELECT p_partkey AS work, {d.each("split(p_name, ' ')")} AS tag FROM part) SELECT work FROM t WHERE tag IN (SELECT min(tag) FROM t UNION ALL SELECT max(tag) FROM t) GROUP BY work HAVING count(DISTINCT tag) = (SELECT count(DISTINCT x) FROM (SELECT min(tag) AS x FROM t UNION ALL SELECT max(tag) AS x FROM t) y) UNION SELECT p_partkey AS work FROM part WHERE p_type = 'PROMO' AND p_size > 40"""


@plan
def posting_difference(d):
    return "SELECT p_partkey AS work FROM part WHERE p_type <> 'PROMO' EXCEPT SELECT l_partkey AS work FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40"


@plan
def sorted_range_lookup(d):
    """The rows of a key range."""
    return "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE (l_orderkey, l_linenumber) IN (SELECT o_orderkey, 1 FROM orders WHERE o_orderkey BETWEEN 100 AND 900)"


@plan
def as_of_chapter(d):
    """The latest purchase at or before each error of a user."""
    return """WITH u AS (SELECT user_id, ts, event_id, event_type FROM events WHERE event_type IN ('purchase', 'error')),
w AS (SELECT *, max(CASE WHEN event_type = 'purchase' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_type DESC, event_id ROWS UNBOUNDED PRECEDING) AS as_of FROM u)
SELECT event_id, user_id, as_of FROM w WHERE event_type = 'error'"""


@plan
def interval_overlap(d):
    """Highlights that meet page ranges, with the common part."""
    return """WITH h AS (SELECT event_id, user_id, CAST(floor(value) AS BIGINT) AS a, CAST(floor(value) AS BIGINT) + 20 AS b FROM events WHERE event_type = 'purchase'),
p AS (SELECT n_nationkey AS page, n_nationkey * 20 AS a, n_nationkey * 20 + 20 AS b FROM nation) SELECT event_id, page, CAST(greatest(h.a, p.a) AS BIGINT) AS from_char, CAST(least(h.b, p.b) AS BIGINT) AS to_char FROM h JOIN p ON h.a < p.b AND p.a < h.b"""
