"""Texts made ready to be read: redaction, noise, headers, sections, language and dialogue."""

from __future__ import annotations

from .dialect import plan

LINES = "line AS (SELECT doc_id, i, {at} AS t FROM (SELECT doc_id, text, {each} AS i FROM documents) x)"


def lines(d) -> str:
    parts = "split(text, chr(10))"
    return LINES.format(at=f"element_at({parts}, CAST(i AS INT))" if d.text == "STRING" else f"{parts}[i]", each=d.each(d.seq("1", f"{d.size}({parts})")))


@plan
def pii_redaction(d):
    """Addresses, paths and numbers replaced in order."""
    x = d.replaced("text", "https?://[^ ]+", "[url]")
    x = d.replaced(x, "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}", "[email]")
    x = d.replaced(x, "([0-9]{1,3}[.]){3}[0-9]{1,3}", "[ip]")
    return f"SELECT doc_id, md5({x}) AS redacted, length({x}) AS n FROM documents"


@plan
def garbage_lines(d):
    """Lines with one letter or less, or of thirty characters with under two fifths of them letters."""
    return f"WITH {lines(d)} SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE length({d.replaced('t', '[^A-Za-z]+', '')}) <= 1 OR (length(t) >= 30 AND length({d.replaced('t', '[^A-Za-z]+', '')}) < 0.4 * length(t))) AS garbage FROM line GROUP BY doc_id"


@plan
def running_headers(d):
    """Short lines, digits made alike, that a source has again and that end no sentence."""
    return f"WITH {lines(d)}, k AS (SELECT source, {d.replaced('lower(t)', '[0-9]+', '#')} AS k FROM line JOIN documents USING (doc_id) WHERE length(t) BETWEEN 1 AND 80 AND NOT {d.like('t', '[.!?]$')}) SELECT source, k, count(*) AS n FROM k GROUP BY source, k HAVING count(*) >= 2"


@plan
def marker_cut(d):
    """What stands behind the first start mark in the first half."""
    at = "locate('. ', text)" if d.text == "STRING" else "strpos(text, '. ')"
    return f"SELECT doc_id, CASE WHEN p > 0 AND p < n_chars / 2 THEN n_chars - p - 1 ELSE n_chars END AS kept FROM (SELECT doc_id, length(text) AS n_chars, {at} AS p FROM documents) x"


@plan
def heading_sections(d):
    """Each short line that ends no sentence starts a part."""
    return f"WITH {lines(d)}, h AS (SELECT doc_id, i, t, CASE WHEN length(t) BETWEEN 1 AND 70 AND NOT {d.like('t', '[.!?,;:]$')} THEN 1 ELSE 0 END AS head FROM line), s AS (SELECT *, sum(head) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS part FROM h) SELECT doc_id, CAST(part AS BIGINT) AS part, min(i) AS first, count(*) AS lines, CAST(sum(length(t)) AS BIGINT) AS chars FROM s GROUP BY doc_id, part"


@plan
def heading_class(d):
    return f"WITH {lines(d)} SELECT doc_id, i, CASE WHEN {d.like('lower(t)', '^(contents|preface|foreword)')} THEN 'front' WHEN {d.like('lower(t)', '^(index|notes|appendix)')} THEN 'back' WHEN {d.like('t', '^(Chapter )?[0-9IVX]+[.]?$')} THEN 'numbered' ELSE 'body' END AS kind FROM line WHERE length(t) BETWEEN 1 AND 30"


@plan
def paragraph_reflow(d):
    """A paragraph ends where a line ends a sentence and is short."""
    return f"WITH {lines(d)}, l AS (SELECT doc_id, i, t, max(length(t)) OVER (PARTITION BY doc_id) AS widest, lag(t) OVER (PARTITION BY doc_id ORDER BY i) AS prior FROM line), b AS (SELECT doc_id, i, t, CASE WHEN prior IS NULL OR ({d.like('prior', '[.!?]$')} AND length(prior) < 0.75 * widest) THEN 1 ELSE 0 END AS brk FROM l) SELECT doc_id, CAST(sum(brk) AS BIGINT) AS paragraphs, count(*) AS lines FROM b GROUP BY doc_id"


@plan
def doc_language_vote(d):
    """Language by words of one source, where it has over a fiftieth of them."""
    return f"SELECT source, detected, count(*) AS votes FROM (SELECT source, CASE WHEN {d.like('lower(text)', '(^| )(und|der|die|das) ')} THEN 'de' WHEN {d.like('lower(text)', '(^| )(que|les|une|est) .*(^| )(la|le|et) ')} THEN 'fr' WHEN {d.like('lower(text)', '(^| )(los|las|el|con) ')} THEN 'es' ELSE 'en' END AS detected FROM documents) x GROUP BY source, detected"


@plan
def quote_style(d):
    return "SELECT doc_id, CASE WHEN a >= b AND a > 0 THEN 'double' WHEN b > 0 THEN 'guillemets' ELSE 'none' END AS style FROM (SELECT doc_id, length(text) - length(replace(text, chr(34), '')) AS a, length(text) - length(replace(text, '«', '')) AS b FROM documents) x"


@plan
def speaker_tags(d):
    """Capitalised words that open a turn, by role."""
    first = "regexp_extract(text, '^([A-Z][a-z]+)', 1)"
    return f"SELECT role, {first} AS name, count(*) AS n FROM conversations WHERE {d.like('text', '^[A-Z][a-z]+')} GROUP BY role, {first}"


@plan
def sentence_counts(d):
    return f"SELECT doc_id, {d.size}({d.words('text', '[.!?]( |$)')}) AS ends FROM documents WHERE NOT text LIKE concat('%', chr(10))"


@plan
def remaining_time(d):
    """Seconds left at fifteen characters each, by section."""
    return f"WITH {lines(d)} SELECT doc_id, i, CAST(sum(length(t)) OVER (PARTITION BY doc_id ORDER BY i DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS chars, round(sum(length(t)) OVER (PARTITION BY doc_id ORDER BY i DESC ROWS UNBOUNDED PRECEDING) / 15.0e0, 4) AS seconds FROM line"


@plan
def kept_position(d):
    """The page that a stored place falls on."""
    return "SELECT event_id, n_nationkey AS page FROM events JOIN nation ON value >= n_nationkey * 20 AND value < n_nationkey * 20 + 20"


@plan
def file_kind(d):
    """The kind of a page by its first characters."""
    return "SELECT page_id, CASE WHEN upper(html) LIKE '<!DOCTYPE HTML%' THEN 'html' WHEN html LIKE '<?xml%' THEN 'xml' WHEN html LIKE '{%' THEN 'json' ELSE 'text' END AS kind FROM pages"


@plan
def page_titles(d):
    return "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, 'lang=.([a-z]+)', 1) AS lang FROM pages"


@plan
def repeated_lines(d):
    """Lines that several documents share."""
    return f"WITH {lines(d)} SELECT md5(t) AS line, count(DISTINCT doc_id) AS documents FROM line WHERE length(t) >= 20 GROUP BY md5(t) HAVING count(DISTINCT doc_id) >= 3"
