"""Keys, checks, cleaning and classification of text."""

from __future__ import annotations

from .dialect import plan

#: Articles that keys drop, and common words of four languages, this module's own choice.
ARTICLES = "the|a|an|le|la|les|der|die|das|el|los|las"
STOP = {"en": "the|and|of|to|in|is|that|was|for|with", "fr": "le|la|les|et|des|une|que|est|pour|dans", "de": "der|die|und|das|ist|nicht|ein|mit|von|den", "es": "el|los|las|y|que|de|una|por|con|del"}
#: Letters and what they fold to.
ACCENTS, PLAIN = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿ", "aaaaaaeeeeiiiiooooouuuuncyy"


def folded(x: str) -> str:
    return f"translate(lower({x}), '{ACCENTS}', '{PLAIN}')"


def tokens(d, x: str) -> str:
    return d.words(folded(x), "[a-z0-9]+")


@plan
def tokenize_ascii(d):
    """Folded tokens of at most 24 characters."""
    return f"SELECT doc_id, {d.join}({d.mapped(tokens(d, 'text'), 't', 'substr(t, 1, 24)')}, ' ') AS tokens FROM documents"


@plan
def match_key(d):
    return f"SELECT doc_id, {d.replaced(d.join + '(' + tokens(d, 'text') + ', chr(32))', '^(' + ARTICLES + ') ', '')} AS match_key FROM documents"


@plan
def title_key(d):
    """The key of what stands before a colon, semicolon, bracket or slash."""
    return f"SELECT doc_id, {d.replaced(d.join + '(' + tokens(d, d.replaced('text', '(?s)[:;(/].*$', '')) + ', chr(32))', '^(the|a|an) ', '')} AS title_key FROM documents"


@plan
def main_title(d):
    return f"SELECT p_partkey, trim({d.replaced('title', '[:;(/].*$', '')}) AS main FROM (SELECT p_partkey, concat(p_name, CASE p_partkey % 3 WHEN 0 THEN ': a novel' WHEN 1 THEN ' (second)' ELSE '' END) AS title FROM part) x"


@plan
def name_key(d):
    """Sorted tokens of a name."""
    return f"SELECT c_custkey, {d.join}({d.ordered}({d.words('lower(c_name)', '[a-z0-9]+')}), ' ') AS name_key FROM customer"


@plan
def writer_key(d):
    """Last name and initial; "Last, First" is turned round."""
    return "SELECT p_partkey, concat(split_part(n, ' ', 2), ' ', substr(n, 1, 1)) AS writer_key FROM (SELECT p_partkey, CASE WHEN a LIKE '%,%' THEN concat(trim(split_part(a, ',', 2)), ' ', split_part(a, ',', 1)) ELSE a END AS n FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN concat(split_part(p_name, ' ', 2), ', ', split_part(p_name, ' ', 1)) ELSE p_name END AS a FROM part) x) y"


@plan
def isbn_check(d):
    """Twelve digits with their check digit, and the key behind the prefix."""
    total = " + ".join(f"{w} * CAST(substr(s, {i + 1}, 1) AS INT)" for i, w in enumerate([1, 3] * 6))
    return f"SELECT p_partkey, concat(s, CAST((10 - ({total}) % 10) % 10 AS {d.text})) AS isbn, CAST(s AS BIGINT) - 978000000000 AS isbn_key FROM (SELECT p_partkey, CAST(978000000000 + p_partkey * 104729 % 1000000000 AS {d.text}) AS s FROM part) x"


@plan
def trigram_explode(d):
    """Trigrams of a marked term, with the number of terms."""
    return f"SELECT gram, count(DISTINCT term) AS terms FROM (SELECT term, substr(concat('$', term, '$'), CAST(i AS INT), 3) AS gram FROM (SELECT term, {d.each(d.seq('1', 'length(term)'))} AS i FROM (SELECT DISTINCT split_part(p_name, ' ', 1) AS term FROM part) t) u) v GROUP BY gram"


@plan
def typo_allowance(d):
    return "SELECT DISTINCT n_name AS term, CASE WHEN length(n_name) <= 3 THEN 0 WHEN length(n_name) <= 6 THEN 1 ELSE 2 END AS allowed FROM nation"


@plan
def transposition_variants(d):
    """All swaps of neighbouring letters."""
    return f"SELECT term, concat(substr(term, 1, CAST(i AS INT) - 1), substr(term, CAST(i AS INT) + 1, 1), substr(term, CAST(i AS INT), 1), substr(term, CAST(i AS INT) + 2)) AS variant FROM (SELECT term, {d.each(d.seq('1', 'length(term) - 1'))} AS i FROM (SELECT DISTINCT lower(n_name) AS term FROM nation) t) x"


@plan
def detect_language(d):
    """Stop-word vote with one winner, English by default."""
    hits = ", ".join(f"{d.size}({d.kept('w', 't', d.like('t', '^(' + STOP[k] + ')$'))}) AS n_{k}" for k in STOP)
    return f"""WITH w AS (SELECT doc_id, lang, {d.words('lower(text)', '[a-zäöüßéèñ]+')} AS w FROM documents), h AS (SELECT doc_id, lang, {hits} FROM w), m AS (SELECT *, greatest(n_en, n_fr, n_de, n_es) AS top FROM h)
SELECT doc_id, CASE WHEN top = 0 THEN 'en' WHEN n_en = top THEN 'en' WHEN n_fr = top THEN 'fr' WHEN n_de = top THEN 'de' ELSE 'es' END AS detected, top FROM m"""


@plan
def script_share(d):
    """Share of plain Latin letters among all."""
    return f"SELECT doc_id, round(length({d.replaced('lower(text)', '[^a-z]+', '')}) / (1.0e0 * greatest(1, length({d.replaced('text', '[ .,!?|*#$%&0-9:;/=()@_-]+', '')}))), 6) AS latin FROM documents"


@plan
def foreign_title(d):
    """Titles of three words and more without an own stop word, with one of another language."""
    return f"SELECT doc_id, lang, {d.like('lower(text)', '(^| )(' + STOP['fr'] + ')( |$)')} AND NOT {d.like('lower(text)', '(^| )(' + STOP['en'] + ')( |$)')} AS foreign_title FROM documents"


@plan
def strip_markup(d):
    """Pages without comments, scripts and tags, white space in one."""
    inner = d.replaced("html", "(?s)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return f"SELECT page_id, length(trim({d.replaced(d.replaced(d.replaced(inner, '(?s)<!--.*?-->', ' '), '<[^>]*>', ' '), '[ \\t\\n\\r]+', ' ')})) AS n FROM pages"


@plan
def entity_decode(d):
    return "SELECT page_id, replace(replace(replace(replace(html, '&amp;', '&'), '&lt;', '<'), '&quot;', '\"'), '&middot;', '·') AS html FROM pages"


@plan
def page_links(d):
    """Targets of a page's links."""
    return f"SELECT page_id, replace(replace(a, 'href=\"', ''), '\"', '') AS target, count(*) AS n FROM (SELECT page_id, {d.each(d.words('html', 'href=\"[^\"]*\"'))} AS a FROM pages) x GROUP BY page_id, a"


@plan
def url_parts(d):
    """Scheme, host and whether it has a query."""
    return f"SELECT page_id, split_part(url, ':', 1) AS scheme, split_part(url, '/', 3) AS host, url LIKE '%?%' AS query FROM pages"


@plan
def reader_comment_score(d):
    """Points for what readers' comments look like."""
    return f"SELECT doc_id, CASE WHEN {d.like('text', '^[a-z]')} THEN 1 ELSE 0 END + CASE WHEN {d.like('lower(text)', '(^| )(loved it|must read|boring|disgusting|stupid)( |[.]|$)')} THEN 2 ELSE 0 END + CASE WHEN {d.like('text', '(^| )i( |$)')} THEN 1 ELSE 0 END + CASE WHEN n_chars < 40 THEN 1 ELSE 0 END AS points FROM documents"


@plan
def subject_list_test(d):
    return "SELECT doc_id, length(text) - length(replace(text, '|', '')) AS bars, length(text) - length(replace(text, ' | ', '')) >= 9 AS list FROM documents"


@plan
def description_score(d):
    """A third of its length up to 1000, less for contents; null under four words."""
    return f"SELECT doc_id, CASE WHEN {d.size}({d.words('text', '[^ \\n]+')}) >= 4 THEN round(least(n_chars, 3000) / 3.0e0 - CASE WHEN text LIKE '%|%' THEN 600 ELSE 0 END, 4) END AS score FROM documents"


@plan
def title_tidy(d):
    """Responsibility, edition tails and end marks cut."""
    return f"SELECT p_partkey, {d.replaced(d.replaced(d.replaced('t', ' / .*$', ''), ' [(][0-9]+(st|nd|rd|th) ed[.]?[)]$', ''), '[ .,;:]+$', '')} AS title FROM (SELECT p_partkey, concat(p_name, CASE p_partkey % 4 WHEN 0 THEN ' / by ' || p_brand WHEN 1 THEN ' (2nd ed.)' WHEN 2 THEN ' .' ELSE '' END) AS t FROM part) x"


@plan
def series_parse(d):
    """Name and number of "Name #n" and "Name, Book n"."""
    group = (lambda p, n: f"regexp_extract(t, r'{p}', {n})") if d.text == "STRING" else (lambda p, n: f"regexp_extract(t, '{p}', {n})")
    pattern = "^(.*?),? (#|Book )([0-9]+)$"
    return f"SELECT p_partkey, {group(pattern, 1)} AS series, CAST({group(pattern, 3)} AS BIGINT) AS position FROM (SELECT p_partkey, concat(p_name, CASE WHEN p_partkey % 2 = 0 THEN ' #' ELSE ', Book ' END, CAST(p_size AS {d.text})) AS t FROM part) x WHERE {d.like('t', pattern)}"


@plan
def role_map(d):
    return "SELECT conv_id, turn, CASE WHEN lower(role) LIKE 'sys%' THEN 'editor' WHEN lower(role) LIKE 'assist%' THEN 'translator' ELSE 'narrator' END AS role FROM conversations"


@plan
def tag_rules(d):
    """Word-bounded includes less excludes, plural s allowed; up to eight tags."""
    return f"""WITH r(tag, inc, exc) AS (SELECT 'colour', 'red|blue|green', 'widget' UNION ALL SELECT 'fastener', 'bolt|nut|screw', 'none' UNION ALL SELECT 'size', 'small|large', 'ring'),
m AS (SELECT p_partkey AS work, tag, row_number() OVER (PARTITION BY p_partkey ORDER BY tag) AS rn FROM part JOIN r ON {'p_name RLIKE concat(chr(92), chr(98), chr(40), inc, chr(41), chr(115), chr(63), chr(92), chr(98)) AND NOT p_name RLIKE exc' if d.text == 'STRING' else "regexp_matches(p_name, concat(chr(92), 'b(', inc, ')s?', chr(92), 'b')) AND NOT regexp_matches(p_name, exc)"})
SELECT work, tag FROM m WHERE rn <= 8"""


@plan
def classification_codes(d):
    """Counters of class and band per work."""
    return "SELECT l_partkey AS work, count(*) FILTER (WHERE l_linenumber <= 2) AS fiction, count(*) FILTER (WHERE l_linenumber > 2) AS other, count(*) FILTER (WHERE l_quantity < 10) AS short FROM lineitem GROUP BY l_partkey"


@plan
def snippet(d):
    """Thirty-six characters before the first match and ninety behind it."""
    at = "locate('the', lower(text))" if d.text == "STRING" else "strpos(lower(text), 'the')"
    return f"SELECT doc_id, substr(text, CAST(greatest(1, p - 36) AS INT), CAST(p - greatest(1, p - 36) + 93 AS INT)) AS snippet FROM (SELECT doc_id, text, {at} AS p FROM documents) x WHERE p > 0"


@plan
def occurrences(d):
    """How often a phrase stands in each text, 500 at most."""
    return "SELECT doc_id, least(500, CAST((length(lower(text)) - length(replace(lower(text), 'the', ''))) / 3 AS BIGINT)) AS n FROM documents WHERE lower(text) LIKE '%the%'"


@plan
def record_hash(d):
    return f"SELECT l_orderkey, l_linenumber, md5(concat(CAST(l_partkey AS {d.text}), '|', CAST(l_suppkey AS {d.text}), '|', l_returnflag)) AS hash FROM lineitem"


@plan
def days_to_finish(d):
    """Inclusive days from start to finish, at least one."""
    return f"SELECT o_orderkey, greatest(1, {d.days('CAST(max(l_shipdate) AS DATE)', 'CAST(o_orderdate AS DATE)')} + 1) AS days FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate"


@plan
def saturating_add(d):
    return "SELECT l_orderkey, least(255, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT)) AS total FROM lineitem GROUP BY l_orderkey"


@plan
def cover_url(d):
    return f"SELECT p_partkey, concat('https://covers.example/', CASE WHEN p_size > 25 THEN 'b' ELSE 'w' END, '/id/', CAST(p_partkey AS {d.text}), '-L.jpg') AS url FROM part"


@plan
def translation_validation(d):
    """Pairs of turns by length ratio, and whether they differ."""
    return "SELECT a.conv_id, a.turn, length(b.text) / (1.0e0 * greatest(1, length(a.text))) BETWEEN 0.4 AND 2.5 AND a.text <> b.text AS valid FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"


@plan
def wish_terms(d):
    """Words of a question that name tags, those behind a negation excluded."""
    found = d.words("lower(concat('not red but ', 'small blue ring ', text))", "[a-z]+")
    tag = f"t AS (SELECT DISTINCT {d.each('split(p_name, chr(32))')} AS tag FROM part)"
    if d.text == "STRING":  # words are found once a text and not copied for each place
        pair = "named_struct('word', element_at(w, i), 'before', element_at(w, i - 1))"
        words = f"p AS (SELECT doc_id, explode(flatten(transform(array({found}), w -> transform(sequence(2, size(w)), i -> {pair})))) AS p FROM documents WHERE text IS NOT NULL), y AS (SELECT doc_id, p.word AS word, p.before AS before FROM p)"
    else:
        words = f"q AS (SELECT doc_id, {found} AS w FROM documents), x AS (SELECT doc_id, w, {d.each(d.seq('2', d.size + '(w)'))} AS i FROM q), y AS (SELECT doc_id, w[i] AS word, w[i - 1] AS before FROM x)"
    return f"""WITH {words}, {tag}
SELECT doc_id, tag, max(CASE WHEN before IN ('not', 'no', 'without') THEN 1 ELSE 0 END) AS excluded FROM y JOIN t ON word = tag GROUP BY doc_id, tag"""
