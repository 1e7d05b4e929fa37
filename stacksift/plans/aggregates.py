"""Votes, details, roll-ups, vectors and metrics as aggregations."""

from __future__ import annotations

from .catalogue import LOG, SCORED
from .dialect import plan

TAGS = "tags AS (SELECT DISTINCT p_partkey AS work, p_brand AS author, tag FROM (SELECT p_partkey, p_brand, {each} AS tag FROM part) x)"


def tags(d) -> str:
    return TAGS.format(each=d.each("split(concat(p_name, ' ', lower(p_type)), ' ')"))


@plan
def title_vote_mode(d):
    """Plurality of keys, the smaller key on ties, then the most common spelling, the larger on ties."""
    return """WITH v AS (SELECT l_suppkey AS work, l_linenumber AS title_key, concat(l_returnflag, l_linestatus) AS spelling FROM lineitem),
k AS (SELECT work, title_key, row_number() OVER (PARTITION BY work ORDER BY count(*) DESC, title_key) AS rn, count(*) AS votes FROM v GROUP BY work, title_key),
s AS (SELECT v.work, v.title_key, v.spelling, votes, row_number() OVER (PARTITION BY v.work ORDER BY count(*) DESC, v.spelling DESC) AS rs FROM v JOIN k ON v.work = k.work AND v.title_key = k.title_key AND rn = 1 GROUP BY v.work, v.title_key, v.spelling, votes)
SELECT work, title_key, spelling, votes FROM s WHERE rs = 1"""


@plan
def most_common_smallest_tie(d):
    return "SELECT work, status FROM (SELECT o_custkey AS work, o_orderpriority AS status, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderpriority) AS rn FROM orders GROUP BY o_custkey, o_orderpriority) x WHERE rn = 1"


@plan
def most_common_first_seen(d):
    return "SELECT work, status FROM (SELECT o_custkey AS work, o_orderpriority AS status, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, min(o_orderkey)) AS rn FROM orders GROUP BY o_custkey, o_orderpriority) x WHERE rn = 1"


@plan
def original_vote_share(d):
    """The leading original of a work, if it has three fifths of at least two votes."""
    return """WITH c AS (SELECT l_partkey AS work, l_returnflag AS original, count(*) AS votes FROM lineitem GROUP BY l_partkey, l_returnflag),
t AS (SELECT *, sum(votes) OVER (PARTITION BY work) AS total, row_number() OVER (PARTITION BY work ORDER BY votes DESC, original) AS rn FROM c) SELECT work, original, votes, CAST(total AS BIGINT) AS total FROM t WHERE rn = 1 AND total >= 2 AND votes >= 0.6 * total"""


@plan
def dominant_author(d):
    """The author of over half of a series' members."""
    return """WITH c AS (SELECT l_orderkey AS series, l_suppkey AS author, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_suppkey), t AS (SELECT *, sum(n) OVER (PARTITION BY series) AS total FROM c) SELECT series, author FROM t WHERE n * 2 > total"""


@plan
def capped_distinct(d):
    """Up to four authors of a work per language, in the order first seen."""
    return f"""WITH f AS (SELECT l_partkey AS work, l_returnflag AS language, l_suppkey AS author, min(l_orderkey * 10 + l_linenumber) AS first FROM lineitem GROUP BY l_partkey, l_returnflag, l_suppkey),
r AS (SELECT *, row_number() OVER (PARTITION BY work, language ORDER BY first, author) AS rn FROM f) SELECT work, language, {d.joined(f"CAST(author AS {d.text})", "rn")} AS authors, count(*) AS n FROM r WHERE rn <= 4 GROUP BY work, language"""


@plan
def contributors_capped(d):
    """Case-insensitive distinct names, eight at most."""
    return f"""WITH n AS (SELECT o_custkey AS work, lower(o_orderpriority) AS name, min(o_orderkey) AS first FROM orders GROUP BY o_custkey, lower(o_orderpriority)), r AS (SELECT *, row_number() OVER (PARTITION BY work ORDER BY first) AS rn FROM n)
SELECT work, {d.joined('name', 'rn', ';')} AS names FROM r WHERE rn <= 8 GROUP BY work"""


@plan
def best_description(d):
    """Per source and language the best scored text, the smaller one on ties."""
    return """WITH s AS (SELECT source, lang, doc_id, least(n_chars, 3000) / 3.0e0 - CASE WHEN text LIKE '%|%' THEN 600 ELSE 0 END AS score, text FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY score DESC, text, doc_id) AS rn FROM s) SELECT source, lang, doc_id, round(score, 4) AS score FROM r WHERE rn = 1"""


@plan
def details_rollup(d):
    """What all records of a work say together."""
    return """SELECT l_partkey AS work, count(*) AS records, count(DISTINCT l_suppkey) AS publishers, count(DISTINCT l_returnflag) AS languages, min(CAST(l_shipdate AS DATE)) AS first, max(CAST(l_shipdate AS DATE)) AS last,
round(avg(l_quantity), 6) AS pages, max(l_extendedprice) AS largest, bool_or(l_discount > 0.08) AS special, bool_and(l_tax < 0.08) AS plain, count(*) FILTER (WHERE l_linenumber = 1) AS leading, round(sum(l_quantity * l_discount), 4) AS weighted FROM lineitem GROUP BY l_partkey"""


@plan
def rarity_counts(d):
    return "SELECT p_brand AS writer, p_name AS title, p_type AS language, count(*) AS records FROM part GROUP BY p_brand, p_name, p_type"


@plan
def generic_title_keys(d):
    """Keys that four or more distinct full titles lead to."""
    return f"""SELECT title_key, count(DISTINCT title) AS titles FROM (SELECT split_part(p_name, ' ', 1) AS title_key, concat(p_name, ' ', p_brand) AS title FROM part) x GROUP BY title_key HAVING count(DISTINCT title) >= 4"""


@plan
def shared_number(d):
    """Numbers whose records disagree with the first owner's title."""
    return """WITH r AS (SELECT l_suppkey AS number, l_partkey, p_brand AS title, first_value(p_brand) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, p_brand) AS first FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT number, count(*) FILTER (WHERE title <> first) AS disagreeing, count(*) AS records FROM r GROUP BY number HAVING count(*) FILTER (WHERE title <> first) > 0"""


@plan
def publisher_series(d):
    """Series with three or more writers among their numbered records."""
    return "SELECT o_custkey AS series, o_orderstatus AS language, count(DISTINCT o_orderpriority) AS writers FROM orders WHERE o_totalprice > 1000 GROUP BY o_custkey, o_orderstatus HAVING count(DISTINCT o_orderpriority) >= 3"


@plan
def translations_per_original(d):
    return "SELECT p_name AS original, count(DISTINCT l_suppkey) AS translations FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_name"


@plan
def author_best_id(d):
    """Per name key the id with most works, the smaller on ties."""
    return "SELECT name_key, id, works FROM (SELECT n_name AS name_key, c_custkey AS id, count(o_orderkey) AS works, row_number() OVER (PARTITION BY n_name ORDER BY count(o_orderkey) DESC, c_custkey) AS rn FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY n_name, c_custkey) x WHERE rn = 1"


@plan
def theme_support(d):
    """Themes of a work by their support, rarer ones and then smaller ids first."""
    return f"""WITH {tags(d)}, g AS (SELECT tag, count(*) AS total FROM tags GROUP BY tag), s AS (SELECT author, t.tag, count(*) AS support, total FROM tags t JOIN g ON t.tag = g.tag GROUP BY author, t.tag, total)
SELECT author, tag, support, row_number() OVER (PARTITION BY author ORDER BY support DESC, total, tag) AS place FROM s"""


@plan
def tag_idf(d):
    return f"WITH {tags(d)} SELECT tag, count(*) AS df, round(ln(((SELECT count(*) FROM part) + 1) / (count(*) + 1.0e0)), 6) AS idf FROM tags GROUP BY tag"


@plan
def term_frequency(d):
    """Terms of titles and texts with the number of documents."""
    return f"""SELECT term, count(DISTINCT doc_id) AS documents, count(*) AS places FROM (SELECT doc_id, {d.each(d.words("lower(text)", "[a-z0-9]+"))} AS term FROM documents) x GROUP BY term HAVING count(*) >= 3"""


@plan
def facets_top5(d):
    """The five commonest tags of at least two works."""
    return f"WITH {tags(d)} SELECT author, tag, n FROM (SELECT author, tag, count(*) AS n, row_number() OVER (PARTITION BY author ORDER BY count(*) DESC, tag) AS rn FROM tags GROUP BY author, tag HAVING count(*) >= 2) x WHERE rn <= 5"


@plan
def genre_stats(d):
    return f"WITH {tags(d)} SELECT tag, count(*) AS works, count(DISTINCT author) AS authors FROM tags GROUP BY tag"


@plan
def recap_months(d):
    """Pages, days and purchases of each of a year's twelve months, empty ones included."""
    return f"""WITH m AS (SELECT {d.each(d.seq('1', '12'))} AS month), e AS (SELECT month(ts) AS month, count(*) AS pages, count(DISTINCT CAST(ts AS DATE)) AS days, count(*) FILTER (WHERE event_type = 'purchase') AS finished FROM events GROUP BY month(ts))
SELECT CAST(m.month AS BIGINT) AS month, coalesce(pages, 0) AS pages, coalesce(days, 0) AS days, coalesce(finished, 0) AS finished FROM m LEFT JOIN e ON m.month = e.month"""


@plan
def recap_summary(d):
    """Totals, hours, best day and weekend share of each reader."""
    return f"""WITH a AS (SELECT user_id, CAST(ts AS DATE) AS day, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS pages FROM events GROUP BY user_id, CAST(ts AS DATE)),
b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pages DESC, day) AS rn FROM a WHERE pages > 0)
SELECT user_id, CAST(sum(pages) AS BIGINT) AS total, CAST(floor((sum(pages) + 20) / 40) AS BIGINT) AS hours, min(CASE WHEN rn = 1 THEN day END) AS best_day, round(sum(CASE WHEN {d.weekday('day')} >= 6 THEN pages ELSE 0 END) / CAST(sum(pages) AS DOUBLE), 6) AS weekend FROM b GROUP BY user_id"""


@plan
def reader_type(d):
    """Marathoner, explorer, devotee, weekender or bookworm, by the first rule that holds."""
    return f"""WITH a AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), g AS (SELECT user_id, day, {d.plus('day', '-row_number() OVER (PARTITION BY user_id ORDER BY day)')} AS grp FROM a),
s AS (SELECT user_id, max(n) AS streak FROM (SELECT user_id, grp, count(*) AS n FROM g GROUP BY user_id, grp) x GROUP BY user_id),
k AS (SELECT user_id, count(DISTINCT event_type) AS genres, max(n) AS top, round(sum(w) / CAST(sum(n) AS DOUBLE), 6) AS weekend FROM (SELECT user_id, event_type, count(*) AS n, count(*) FILTER (WHERE {d.weekday('ts')} >= 6) AS w FROM events GROUP BY user_id, event_type) y GROUP BY user_id)
SELECT s.user_id, CASE WHEN streak >= 21 THEN 'Marathoner' WHEN genres >= 5 THEN 'Explorer' WHEN top >= 30 THEN 'Devotee' WHEN weekend > 0.5 THEN 'Weekender' ELSE 'Bookworm' END AS kind FROM s JOIN k ON s.user_id = k.user_id"""


@plan
def stats_years(d):
    return "SELECT DISTINCT CAST(year(o_orderdate) AS BIGINT) AS year FROM orders UNION SELECT DISTINCT CAST(year(ts) AS BIGINT) AS year FROM events"


@plan
def newest_per_key(d):
    return "SELECT work, status, updated FROM (SELECT o_custkey AS work, o_orderstatus AS status, CAST(o_orderdate AS DATE) AS updated, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) x WHERE rn = 1"


@plan
def max_per_day_merge(d):
    """Two logs by day: the larger count of each."""
    return """WITH a AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE user_id % 2 = 0 GROUP BY CAST(ts AS DATE)), b AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE user_id % 2 = 1 GROUP BY CAST(ts AS DATE))
SELECT coalesce(a.day, b.day) AS day, greatest(coalesce(a.n, 0), coalesce(b.n, 0)) AS pages FROM a FULL JOIN b ON a.day = b.day"""


@plan
def list_rollups(d):
    """Case-insensitive names of lists with their books, and whether all readers have them."""
    return "SELECT lower(o_orderpriority) AS list, count(DISTINCT o_orderkey) AS books, count(DISTINCT o_custkey) = (SELECT count(DISTINCT o_custkey) FROM orders) AS common FROM orders GROUP BY lower(o_orderpriority)"


@plan
def recency_weights(d):
    """Weights of a reader's works from rank, rating and repeats."""
    return f"""WITH {LOG}, g AS (SELECT user_id, work, max(ts) AS newest, count(*) AS repeats, max(rating) AS rating FROM log GROUP BY user_id, work), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY newest DESC, work) - 1 AS place FROM g)
SELECT user_id, work, round((0.3e0 + 0.7e0 * power(0.5e0, place / 5.0e0)) * (CASE WHEN rating IS NULL THEN 1 ELSE rating / 3.0e0 END) * (1 + 0.5e0 * (repeats - 1)), 6) AS weight FROM r"""


@plan
def weighted_spread(d):
    """Weighted mean and standard deviation of years."""
    return """WITH w AS (SELECT l_suppkey AS entity, l_quantity AS w, year(l_shipdate) AS y FROM lineitem), m AS (SELECT entity, sum(w * y) / sum(w) AS mean FROM w GROUP BY entity)
SELECT w.entity, round(mean, 4) AS mean, round(sqrt(sum(w * (y - mean) * (y - mean)) / sum(w)), 4) AS spread FROM w JOIN m ON w.entity = m.entity GROUP BY w.entity, mean"""


@plan
def size_histogram(d):
    return "SELECT size, count(*) AS groups, CAST(sum(size) AS BIGINT) AS members FROM (SELECT o_custkey, count(*) AS size FROM orders GROUP BY o_custkey) x GROUP BY size"


@plan
def retrieval_metrics(d):
    """Precision at 5 and reciprocal rank per class and over all."""
    return """WITH r AS (SELECT lang AS class, source AS query, d.doc_id, quality, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, d.doc_id) AS place FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
q AS (SELECT class, query, sum(CASE WHEN place <= 5 AND quality = 1 THEN 1 ELSE 0 END) / 5.0e0 AS p5, coalesce(1.0e0 / min(CASE WHEN quality = 1 THEN place END), 0) AS rr FROM r GROUP BY class, query)
SELECT coalesce(class, 'all') AS class, round(avg(p5), 6) AS p5, round(avg(rr), 6) AS mrr, count(*) AS queries FROM q GROUP BY GROUPING SETS ((class), ())"""


@plan
def list_hygiene(d):
    """Repeats, foreign rows and quantiles of result lists."""
    return """SELECT source, count(*) - count(DISTINCT text) AS duplicates, count(*) FILTER (WHERE lang <> 'en') AS foreign_rows, max(n) AS most FROM (SELECT source, text, lang, count(*) OVER (PARTITION BY source, lang) AS n FROM documents) x GROUP BY source"""


@plan
def distinct_after_alias(d):
    return "SELECT count(DISTINCT c_custkey) AS ids, count(DISTINCT c_custkey % 100) AS after_alias FROM customer"


@plan
def release_rollup(d):
    """Works by pack and language, with subtotals."""
    return "SELECT coalesce(p_type, 'all') AS pack, coalesce(l_returnflag, 'all') AS language, count(DISTINCT l_partkey) AS works, count(*) AS editions FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ROLLUP (p_type, l_returnflag)"


@plan
def tag_vectors(d):
    """Tag vectors: IDF with decay by place, of length one."""
    return f"""WITH {tags(d)}, i AS (SELECT tag, ln(((SELECT count(*) FROM part) + 1) / (count(*) + 1.0e0)) AS idf FROM tags GROUP BY tag),
w AS (SELECT work, t.tag, idf / (1 + 0.15e0 * (row_number() OVER (PARTITION BY work ORDER BY t.tag) - 1)) AS w FROM tags t JOIN i ON t.tag = i.tag) SELECT work, tag, round(w / sqrt(sum(w * w) OVER (PARTITION BY work)), 6) AS weight FROM w"""


@plan
def tag_cosine_similar(d):
    """Cosines of tag vectors between each work and all that share a tag; the best ten, with popularity at 0.3."""
    if d.text == "STRING":  # works with the same tags have the same cosines: ranked once, with one more for the work itself
        return f"""WITH {SCORED}, {tags(d)}, i AS (SELECT tag, ln(((SELECT count(*) FROM part) + 1) / (count(*) + 1.0e0)) AS idf FROM tags GROUP BY tag), k AS (SELECT work, array_join(sort_array(collect_list(tag)), ' ') AS k FROM tags GROUP BY work),
m AS (SELECT work, min(work) OVER (PARTITION BY k) AS head FROM k), v AS (SELECT work, t.tag, idf / sqrt(sum(idf * idf) OVER (PARTITION BY work)) AS w FROM tags t JOIN i ON t.tag = i.tag WHERE work IN (SELECT head FROM m)),
c AS (SELECT a.work AS a, b.work AS b, sum(a.w * b.w) AS cosine FROM v a JOIN v b ON a.tag = b.tag GROUP BY a.work, b.work),
p AS (SELECT work, ln(1 + score) / ln(1 + (SELECT max(score) FROM scored)) AS popularity FROM scored), r AS (SELECT a, m.work, 0.7e0 * cosine + 0.3e0 * popularity AS score FROM c JOIN m ON b = head JOIN p ON m.work = p.work WHERE cosine >= 0.2),
best AS (SELECT a, work, score FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(score, 9) DESC, work) AS n FROM r) x WHERE n <= 11),
s AS (SELECT m.work AS seed, best.work, score, row_number() OVER (PARTITION BY m.work ORDER BY round(score, 9) DESC, best.work) AS place FROM best JOIN m ON a = head WHERE m.work <> best.work)
SELECT seed, work, place, round(score, 5) AS score FROM s WHERE place <= 10"""
    return f"""WITH {SCORED}, {tags(d)}, i AS (SELECT tag, ln(((SELECT count(*) FROM part) + 1) / (count(*) + 1.0e0)) AS idf FROM tags GROUP BY tag), v AS (SELECT work, t.tag, idf / sqrt(sum(idf * idf) OVER (PARTITION BY work)) AS w FROM tags t JOIN i ON t.tag = i.tag),
c AS (SELECT a.work AS seed, b.work, sum(a.w * b.w) AS cosine FROM v a JOIN v b ON a.tag = b.tag AND a.work <> b.work GROUP BY a.work, b.work),
p AS (SELECT work, ln(1 + score) / ln(1 + (SELECT max(score) FROM scored)) AS popularity FROM scored), r AS (SELECT seed, c.work, 0.7e0 * cosine + 0.3e0 * popularity AS score, row_number() OVER (PARTITION BY seed ORDER BY round(0.7e0 * cosine + 0.3e0 * popularity, 9) DESC, c.work) AS place FROM c JOIN p ON c.work = p.work WHERE cosine >= 0.2)
SELECT seed, work, place, round(score, 5) AS score FROM r WHERE place <= 10"""


@plan
def taste_blend(d):
    """A reader's taste: weighted tags of what they bought, of length one."""
    return f"""WITH {LOG}, {tags(d)}, w AS (SELECT user_id, tag, sum(rating) AS w FROM log JOIN tags ON log.work = tags.work WHERE rating IS NOT NULL GROUP BY user_id, tag) SELECT user_id, tag, round(w / sqrt(sum(w * w) OVER (PARTITION BY user_id)), 6) AS weight FROM w"""


@plan
def aversion(d):
    """How much a reader's badly rated tags and authors speak against a work."""
    if d.text == "STRING":
        # Readers and works of the same authors and tags are judged once, where their smallest common tag brings them together; parts of a tag's readers (i)
        # meet parts of its works (j), so what is exchanged grows with readers and works, not with their product. Lists are cut so that a row stays small. The SQL's concat takes a null as empty.
        parts = "(SELECT have, pairs, k, slice({0}, k * 4096 + 1, 4096) AS {0} FROM (SELECT *, explode(sequence(0, (size({0}) - 1) div 4096)) AS k FROM {1}))"
        salt, each = "CAST(pmod(hash(have, pairs, k), {}) AS INT)", "explode(split(concat(coalesce(p_name, ''), ' ', lower(coalesce(p_type, ''))), ' '))"
        return f"""WITH {LOG}, w AS (SELECT work, sort_array(collect_set(tag)) AS have, sort_array(collect_set(concat(author, ' ', tag))) AS pairs FROM (SELECT p_partkey AS work, p_brand AS author, {each} AS tag FROM part) x GROUP BY work),
hated AS (SELECT DISTINCT user_id, work FROM log WHERE rating <= 1),
bad AS (SELECT user_id, sort_array(collect_set(tag)) AS have, sort_array(collect_set(concat(author, ' ', tag))) AS pairs FROM (SELECT /*+ MERGE(part) */ user_id, p_brand AS author, {each} AS tag FROM hated JOIN part ON work = p_partkey) x GROUP BY user_id),
readers AS (SELECT have, pairs, collect_list(user_id) AS users FROM bad GROUP BY have, pairs), kinds AS (SELECT have, pairs, transform(collect_list(struct(work)), x -> x.work) AS works FROM w GROUP BY have, pairs),
a AS (SELECT /*+ REPARTITION(96, tag, i, j) */ *, explode(sequence(0, 7)) AS j FROM (SELECT have, pairs, users, {salt.format(4)} AS i, explode(have) AS tag FROM {parts.format("users", "readers")} x) y),
b AS (SELECT /*+ REPARTITION(96, tag, i, j) */ *, explode(sequence(0, 3)) AS i FROM (SELECT have, pairs, works, {salt.format(8)} AS j, explode(have) AS tag FROM {parts.format("works", "kinds")} x) y),
r AS (SELECT /*+ MERGE(b) */ users, works, explode(array(round(1 - (1 - 0.4e0 * size(array_intersect(a.have, b.have)) / size(a.have)) * (1 - 0.6e0 * CASE WHEN arrays_overlap(a.pairs, b.pairs) THEN 1 ELSE 0 END), 6))) AS aversion
  FROM a JOIN b ON a.tag = b.tag AND a.i = b.i AND a.j = b.j AND a.tag = array_min(array_intersect(a.have, b.have)))
SELECT user_id, work, aversion FROM r LATERAL VIEW explode(users) u AS user_id LATERAL VIEW explode(works) x AS work"""
    return f"""WITH {LOG}, {tags(d)}, bad AS (SELECT DISTINCT user_id, author, tag FROM log JOIN tags ON log.work = tags.work WHERE rating <= 1), n AS (SELECT user_id, count(DISTINCT tag) AS n FROM bad GROUP BY user_id),
o AS (SELECT b.user_id, t.work, count(DISTINCT t.tag) AS shared, max(CASE WHEN b.author = t.author THEN 1 ELSE 0 END) AS same FROM bad b JOIN tags t ON b.tag = t.tag GROUP BY b.user_id, t.work)
SELECT o.user_id, work, round(1 - (1 - 0.4e0 * shared / n) * (1 - 0.6e0 * same), 6) AS aversion FROM o JOIN n ON o.user_id = n.user_id"""


@plan
def embedding_centroids(d):
    """Centroids of vectors by label."""
    return f"""SELECT label, place, round(avg(x), 5) AS mean FROM (SELECT label, place, CAST(embedding[{'CAST(place - 1 AS INT)' if d.text == 'STRING' else 'place'}] AS DOUBLE) AS x FROM (SELECT label, embedding, {d.each(d.seq('1', d.size + '(embedding)'))} AS place FROM embeddings WHERE {d.size}(embedding) > 0) e) f GROUP BY label, place"""


@plan
def author_books(d):
    """An author's works by series and reading order."""
    return "SELECT p_brand AS author, p_type AS series, p_partkey AS work, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_size, p_partkey) AS place FROM part"


@plan
def popular_by_tag(d):
    """The best by score of each tag, one per author."""
    return f"""WITH {SCORED}, {tags(d)}, one AS (SELECT tag, author, s.work, score, row_number() OVER (PARTITION BY tag, author ORDER BY score DESC, s.work) AS mine FROM tags t JOIN scored s ON t.work = s.work), r AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY score DESC, work) AS place FROM one WHERE mine = 1)
SELECT tag, author, work, place FROM r WHERE place <= 12"""


@plan
def wish_relaxation(d):
    """All wished tags; while there are under twelve works, the broadest tag is dropped."""
    return f"""WITH {tags(d)}, broad AS (SELECT tag, count(*) AS n FROM tags GROUP BY tag), wish AS (SELECT tag, rarity FROM (SELECT tag, row_number() OVER (ORDER BY n, tag) AS rarity FROM broad) b WHERE rarity <= 3),
hit AS (SELECT work, rarity FROM tags JOIN wish ON tags.tag = wish.tag), whole AS (SELECT k, work FROM hit JOIN (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 3) l ON rarity <= k GROUP BY k, work HAVING count(*) = k),
n AS (SELECT k, count(*) AS found FROM whole GROUP BY k), c AS (SELECT coalesce(max(CASE WHEN found >= 12 THEN k END), 1) AS k FROM n) SELECT work, whole.k AS tags FROM whole JOIN c ON whole.k = c.k"""
