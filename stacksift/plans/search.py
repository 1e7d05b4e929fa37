"""Full-text search over titles and authors, lookups, entities and releases."""

from __future__ import annotations

from .aggregates import tags
from .catalogue import SCORED
from .dialect import plan


def index(d) -> str:
    """Terms of titles and authors by work, with their frequency; three queries: exact, unfinished and misspelt."""
    return f"""posting AS (SELECT DISTINCT p_partkey AS work, term, field FROM (SELECT p_partkey, {d.each("split(lower(p_name), ' ')")} AS term, 'title' AS field FROM part UNION ALL SELECT p_partkey, lower(replace(p_brand, '#', '')), 'author' FROM part) x),
term AS (SELECT term, count(DISTINCT work) AS df FROM posting GROUP BY term),
query AS (SELECT 1 AS qid, lower(min(p_name)) AS q FROM part UNION ALL SELECT 2, substr(lower(max(p_name)), 1, length(max(p_name)) - 2) FROM part UNION ALL SELECT 3, concat(substr(lower(max(p_name)), 1, 1), substr(lower(max(p_name)), 3)) FROM part),
token AS (SELECT qid, i, {"element_at(split(q, ' '), CAST(i AS INT))" if d.text == "STRING" else "split(q, ' ')[i]"} AS token, i = {d.size}(split(q, ' ')) AS final, {d.size}(split(q, ' ')) AS n FROM (SELECT qid, q, {d.each(d.seq('1', d.size + "(split(q, ' '))"))} AS i FROM query) y),
gram AS (SELECT DISTINCT term, df, substr(concat('$', term, '$'), CAST(i AS INT), 3) AS gram FROM (SELECT term, df, {d.each(d.seq('1', 'length(term)'))} AS i FROM term) x),
exact AS (SELECT qid, i, n, token, term, df, 1.0e0 AS weight FROM token JOIN term ON term = token),
begun AS (SELECT * FROM (SELECT qid, i, n, token, term, df, CASE WHEN length(token) >= 4 THEN 0.9e0 ELSE 0.75e0 END AS weight, row_number() OVER (PARTITION BY qid, i ORDER BY df DESC, term) AS place FROM token JOIN term ON substr(term, 1, 2) = substr(token, 1, 2) WHERE final AND length(token) >= 2 AND term LIKE concat(token, '%') AND term <> token) b WHERE place <= 12),
known AS (SELECT qid, i, sum(CASE WHEN weight = 1 THEN df ELSE 0 END) AS own, sum(CASE WHEN weight < 1 THEN df ELSE 0 END) AS longer FROM (SELECT qid, i, df, weight FROM exact UNION ALL SELECT qid, i, df, weight FROM begun) k GROUP BY qid, i),
sparse AS (SELECT t.* FROM token t LEFT JOIN known k ON t.qid = k.qid AND t.i = k.i WHERE coalesce(own, 0) < 50 AND (coalesce(longer, 0) < 20 OR coalesce(own, 0) = 0)),
asked AS (SELECT qid, i, n, token, substr(concat('$', token, '$'), CAST(j AS INT), 3) AS gram FROM (SELECT *, {d.each(d.seq('1', 'length(token)'))} AS j FROM sparse) x),
near AS (SELECT qid, i, n, token, term, df, count(*) AS shared FROM asked JOIN gram ON asked.gram = gram.gram GROUP BY qid, i, n, token, term, df),
fuzzy AS (SELECT * FROM (SELECT *, CASE WHEN levenshtein(token, term) = 1 THEN 0.72e0 ELSE 0.5e0 END AS weight, row_number() OVER (PARTITION BY qid, i ORDER BY levenshtein(token, term), df DESC, term) AS place FROM near WHERE levenshtein(token, term) BETWEEN 1 AND (CASE WHEN length(token) <= 3 THEN 0 WHEN length(token) <= 6 THEN 1 ELSE 2 END)) f WHERE place <= 60),
expanded AS (SELECT qid, i, n, token, term, df, max(weight) AS weight FROM (SELECT qid, i, n, token, term, df, weight FROM exact UNION ALL SELECT qid, i, n, token, term, df, weight FROM begun UNION ALL SELECT qid, i, n, token, term, df, weight FROM fuzzy) z GROUP BY qid, i, n, token, term, df)"""


@plan
def term_index(d):
    return f"WITH {index(d)} SELECT term, df FROM term"


@plan
def gram_index(d):
    """Trigrams of terms that two works have."""
    return f"WITH {index(d)} SELECT gram, count(*) AS terms FROM (SELECT term, substr(concat('$', term, '$'), CAST(i AS INT), 3) AS gram FROM (SELECT term, {d.each(d.seq('1', 'length(term)'))} AS i FROM term WHERE df >= 2 AND length(term) >= 3) x) y GROUP BY gram"


@plan
def completion_index(d):
    """Prefixes of two to four letters with their twelve commonest terms."""
    return f"WITH {index(d)} SELECT prefix, term, place FROM (SELECT prefix, term, row_number() OVER (PARTITION BY prefix ORDER BY df DESC, term) AS place FROM (SELECT term, df, substr(term, 1, CAST(k AS INT)) AS prefix FROM (SELECT term, df, {d.each(d.seq('2', '4'))} AS k FROM term) a WHERE length(term) >= k) b) c WHERE place <= 12"


@plan
def fuzzy_terms(d):
    """Terms that share enough trigrams with a token and lie within its allowance."""
    return f"""WITH {index(d)}, g AS (SELECT term, substr(concat('$', term, '$'), CAST(i AS INT), 3) AS gram FROM (SELECT term, {d.each(d.seq('1', 'length(term)'))} AS i FROM term) x), t AS (SELECT DISTINCT token FROM token WHERE length(token) >= 4),
tg AS (SELECT token, substr(concat('$', token, '$'), CAST(i AS INT), 3) AS gram FROM (SELECT token, {d.each(d.seq('1', 'length(token)'))} AS i FROM t) x)
SELECT token, term, count(*) AS shared FROM tg JOIN g ON tg.gram = g.gram GROUP BY token, term HAVING count(*) >= greatest(1, length(token) - 6) AND levenshtein(token, term) <= CASE WHEN length(token) <= 6 THEN 1 ELSE 2 END"""


@plan
def term_expansion(d):
    return f"WITH {index(d)} SELECT qid, i, token, term, round(weight, 4) AS weight FROM expanded"


def scored_hits(d) -> str:
    return f"""{SCORED}, {index(d)}, size AS (SELECT count(*) AS total FROM part),
idf AS (SELECT qid, i, n, ln((total + 1.0e0) / (least(sum(df), total) + 1)) + 1 AS idf FROM expanded, size GROUP BY qid, i, n, total),
value AS (SELECT e.qid, e.i, p.work, max(CASE WHEN field = 'title' THEN weight ELSE 0.85e0 * weight END) AS v, max(CASE WHEN field = 'author' THEN 1 ELSE 0 END) AS author FROM expanded e JOIN posting p ON e.term = p.term GROUP BY e.qid, e.i, p.work),
whole AS (SELECT qid, sum(idf) AS whole FROM idf GROUP BY qid),
text AS (SELECT v.qid, work, sum(v * idf) / whole * power(count(*) / CAST(max(n) AS DOUBLE), 2) AS text, count(*) AS matched, max(n) AS n, max(v) AS best FROM value v JOIN idf ON v.qid = idf.qid AND v.i = idf.i JOIN whole ON v.qid = whole.qid GROUP BY v.qid, work, whole),
popular AS (SELECT work, ln(1 + score) / ln(1 + (SELECT max(score) FROM scored)) AS pop FROM scored),
candidate AS (SELECT qid, t.work, text, matched, n, coalesce(pop, 0) AS pop, row_number() OVER (PARTITION BY qid ORDER BY round(text + 0.35e0 * coalesce(pop, 0), 9) DESC, t.work) AS place FROM text t LEFT JOIN popular p ON t.work = p.work WHERE best >= 0.8 OR matched = n)"""


@plan
def token_scores(d):
    return f"WITH {scored_hits(d)} SELECT qid, work, round(text, 6) AS text, matched FROM text"


@plan
def search_candidates(d):
    return f"WITH {scored_hits(d)} SELECT qid, work, place FROM candidate WHERE place <= 250"


def ranked(d) -> str:
    return f"""{scored_hits(d)}, bonus AS (SELECT c.qid, work, text + 0.95e0 * pop * matched / n + CASE WHEN lower(p_name) = q THEN 1.0e0 WHEN lower(p_name) LIKE concat(q, '%') THEN 0.5e0 WHEN lower(p_name) LIKE concat('%', q, '%') THEN 0.4e0 ELSE 0 END + 0.4e0 * least(1, matched / CAST(n AS DOUBLE)) - CASE WHEN p_type = 'PROMO' THEN 0.7e0 ELSE 0 END AS score
FROM candidate c JOIN part ON work = p_partkey JOIN query q ON c.qid = q.qid WHERE place <= 250), final AS (SELECT qid, work, score, max(score) OVER (PARTITION BY qid) AS top FROM bonus)"""


@plan
def search_ranked(d):
    """Reranked by title match, coverage and popularity; floor 0.45 of the best; twenty."""
    return f"WITH {ranked(d)} SELECT qid, work, place, round(score, 5) AS score FROM (SELECT qid, work, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, work) AS place FROM final WHERE score >= 0.45 * top) x WHERE place <= 20"


@plan
def search_federated(d):
    """Catalogues by type searched together: the best of each title."""
    return f"WITH {ranked(d)} SELECT qid, p_name AS title, min(work) AS work, round(max(score), 5) AS score FROM final JOIN part ON work = p_partkey WHERE score >= 0.45 * top GROUP BY qid, p_name"


@plan
def author_suggest(d):
    return "SELECT DISTINCT p_brand AS author, length(p_brand) AS n FROM part WHERE lower(p_brand) LIKE 'brand#1%' OR lower(p_brand) LIKE 'brand#2%'"


@plan
def did_you_mean(d):
    return f"WITH {index(d)} SELECT qid, token, term FROM (SELECT qid, token, term, row_number() OVER (PARTITION BY qid ORDER BY weight DESC, df DESC, term) AS rn FROM expanded WHERE token <> term) x WHERE rn <= 3"


@plan
def number_lookup(d):
    return "SELECT l_orderkey * 10 + l_linenumber AS number, l_partkey AS work FROM lineitem WHERE l_orderkey * 10 + l_linenumber IN (11, 12, 23, 101, 9999, 321)"


@plan
def visible_works(d):
    return "SELECT p_partkey AS work FROM part WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = p_partkey AND o_orderstatus = 'P')"


@plan
def tag_counts(d):
    return f"WITH {tags(d)} SELECT tag, count(DISTINCT work) AS works FROM tags GROUP BY tag"


@plan
def author_works(d):
    return "SELECT p_brand AS author, count(DISTINCT p_partkey) AS works, min(p_partkey) AS first FROM part GROUP BY p_brand"


@plan
def series_members(d):
    return "SELECT l_orderkey AS series, l_partkey AS work, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS position FROM lineitem"


@plan
def member_choice(d):
    """The preferred language, else the first in order."""
    return "SELECT title, work FROM (SELECT p_name AS title, p_partkey AS work, row_number() OVER (PARTITION BY p_name ORDER BY CASE p_type WHEN 'SMALL' THEN 0 WHEN 'LARGE' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END, p_type, p_partkey) AS rn FROM part) x WHERE rn = 1"


@plan
def number_preference(d):
    """A work's numbers: own, cover's, catalogue's; each once."""
    return "SELECT work, number, min(rank) AS rank FROM (SELECT l_partkey AS work, l_suppkey AS number, CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS rank FROM lineitem) x GROUP BY work, number"


@plan
def shown_tags(d):
    """Up to three themes and six tags in all, in order."""
    return f"WITH {tags(d)}, r AS (SELECT work, tag, CASE WHEN length(tag) > 6 THEN 1 ELSE 0 END AS theme FROM tags), p AS (SELECT *, row_number() OVER (PARTITION BY work, theme ORDER BY tag) AS k FROM r) SELECT work, tag, theme FROM (SELECT *, row_number() OVER (PARTITION BY work ORDER BY theme DESC, k) AS s FROM p WHERE theme = 0 OR k <= 3) x WHERE s <= 6"


@plan
def quantised_popularity(d):
    return f"WITH {SCORED} SELECT work, CAST(floor(greatest(score, 0) / 10) AS BIGINT) AS score10, CASE WHEN ratings > 0 THEN CAST(floor(20.0e0 * rating_total / ratings) AS BIGINT) ELSE 0 END AS rating20, least(editions, 255) AS editions FROM scored"


@plan
def publisher_reach(d):
    return "SELECT l_suppkey AS publisher, count(*) AS editions, count(DISTINCT l_partkey) AS works FROM lineitem GROUP BY l_suppkey"


@plan
def claimed_covers(d):
    return "SELECT DISTINCT l_orderkey * 10 + l_linenumber AS cover FROM lineitem WHERE l_discount > 0.07 AND l_returnflag <> 'N'"


@plan
def majority_language(d):
    """The language of most editions, the first on ties."""
    return "SELECT work, language FROM (SELECT l_partkey AS work, l_returnflag AS language, row_number() OVER (PARTITION BY l_partkey ORDER BY count(*) DESC, l_returnflag) AS rn FROM lineitem GROUP BY l_partkey, l_returnflag) x WHERE rn = 1"


@plan
def claim_what_if(d):
    """Facts joined by a group's, judged again without committing."""
    return "SELECT p_partkey AS work, count(l_orderkey) AS editions, count(l_orderkey) + count(DISTINCT l_suppkey) AS with_claim, count(l_orderkey) + count(DISTINCT l_suppkey) >= 40 AS eligible FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey"


@plan
def role_pivot(d):
    return "SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS users, count(*) FILTER (WHERE role = 'assistant') AS assistants, count(*) FILTER (WHERE role = 'system') AS systems FROM conversations GROUP BY conv_id"


@plan
def pack_status(d):
    """Packs offered against packs installed."""
    return "WITH o AS (SELECT p_type AS pack, count(*) AS offered FROM part GROUP BY p_type), i AS (SELECT p_type AS pack, count(*) AS installed FROM part WHERE p_size > 48 OR p_type LIKE 'S%' GROUP BY p_type) SELECT o.pack, CASE WHEN installed IS NULL THEN 'available' WHEN installed < offered THEN 'update' ELSE 'installed' END AS status, offered - coalesce(installed, 0) AS missing FROM o LEFT JOIN i ON o.pack = i.pack"


@plan
def status_transition(d):
    """Moves between statuses set start and finish once."""
    return "SELECT o_custkey AS reader, min(CASE WHEN o_orderstatus IN ('O', 'F') THEN CAST(o_orderdate AS DATE) END) AS started, min(CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) END) AS finished, count(*) AS moves FROM orders GROUP BY o_custkey"


@plan
def progress_fraction(d):
    return "SELECT event_id, CASE WHEN value > 1 THEN round((floor(value / 2) + 1) / floor(value), 6) END AS fraction FROM events"


@plan
def gold_constraints(d):
    """Pairs that must share an id, and pairs that must not."""
    return "SELECT a.p_partkey AS a, b.p_partkey AS b, a.p_name = b.p_name AND a.p_brand = b.p_brand AS same FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 64"


@plan
def proposal_conflicts(d):
    """By target, sources that collide on a language all refuse."""
    return "WITH p AS (SELECT DISTINCT l_orderkey AS target, l_suppkey AS source, l_returnflag AS language FROM lineitem), c AS (SELECT target, language FROM p GROUP BY target, language HAVING count(DISTINCT source) > 1) SELECT p.target, p.source, max(CASE WHEN c.language IS NULL THEN 0 ELSE 1 END) = 0 AS merges FROM p LEFT JOIN c ON p.target = c.target AND p.language = c.language GROUP BY p.target, p.source"


@plan
def compilation_titles(d):
    """Titles whose halves are each known three times."""
    return "WITH h AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part), n AS (SELECT x, count(*) AS n FROM (SELECT a AS x FROM h UNION ALL SELECT b FROM h) y GROUP BY x) SELECT p_partkey FROM h JOIN n m ON a = m.x JOIN n o ON b = o.x WHERE m.n >= 3 AND o.n >= 3"


@plan
def title_variants(d):
    return f"SELECT p_partkey, variant FROM (SELECT p_partkey, {d.each("split(p_name, ' ')")} AS variant FROM part UNION ALL SELECT p_partkey, p_name FROM part) x GROUP BY p_partkey, variant"


@plan
def stable_ids(d):
    """The least catalogue id of a component, else its previous one."""
    return "WITH m AS (SELECT p_name AS component, p_partkey AS work, CASE WHEN p_size > 10 THEN p_partkey END AS catalogue FROM part) SELECT work, coalesce(min(catalogue) OVER (PARTITION BY component), min(work) OVER (PARTITION BY component)) AS unified FROM m"


@plan
def one_per_language(d):
    """Unified works with two members of a language."""
    return "SELECT p_name AS unified, p_type AS language, count(*) AS members FROM part GROUP BY p_name, p_type HAVING count(*) > 1"


@plan
def series_gap_fill(d):
    """Series without holes, and how many positions the others miss."""
    return "SELECT series, max(position) - min(position) + 1 - count(DISTINCT position) AS holes, count(*) AS members FROM (SELECT l_suppkey AS series, l_linenumber AS position FROM lineitem) x GROUP BY series"


@plan
def extras_gap_fill(d):
    """Members' extras folded: the first of each language."""
    return "SELECT p_name AS unified, p_type AS language, min(p_partkey) AS first, count(DISTINCT p_brand) AS contributors FROM part GROUP BY p_name, p_type"


@plan
def snapshot_delta(d):
    """Tombstones and changes between two releases."""
    return "WITH old AS (SELECT o_custkey AS work, count(*) AS n FROM orders WHERE o_orderdate < CAST('1996-01-01' AS TIMESTAMP) GROUP BY o_custkey), new AS (SELECT o_custkey AS work, count(*) AS n FROM orders WHERE o_orderdate >= CAST('1993-01-01' AS TIMESTAMP) GROUP BY o_custkey) SELECT coalesce(old.work, new.work) AS work, CASE WHEN new.work IS NULL THEN 'tombstone' WHEN old.work IS NULL THEN 'new' ELSE 'changed' END AS change FROM old FULL JOIN new ON old.work = new.work WHERE old.n IS NULL OR new.n IS NULL OR old.n <> new.n"


@plan
def late_data_rule(d):
    """Deltas whose month isn't before their base's."""
    return "SELECT o_orderkey AS delta FROM orders WHERE o_orderstatus <> 'F' AND CAST(o_orderdate AS DATE) >= (SELECT max(CAST(b.o_orderdate AS DATE)) FROM orders b WHERE b.o_orderstatus = 'F' AND b.o_custkey = orders.o_custkey)"


@plan
def recent_ring(d):
    """The eight most recent distinct searches of a reader."""
    return "SELECT user_id, page, place FROM (SELECT user_id, page, row_number() OVER (PARTITION BY user_id ORDER BY newest DESC, page) AS place FROM (SELECT user_id, event_type AS page, max(ts) AS newest FROM events GROUP BY user_id, event_type) x) y WHERE place <= 8"


@plan
def rate_windows(d):
    """Events in fixed hours, and those over the limit."""
    return "SELECT user_id, date_trunc('hour', ts) AS hour, count(*) AS n, count(*) > 2 AS limited FROM events GROUP BY user_id, date_trunc('hour', ts)"
