"""Names of persons and what biographies hold, as plain functions of one text."""

from __future__ import annotations

import re

from .text import fold

#: Words that make a name a body's and not a person's, roles that stand behind a name, particles in lower case.
BODIES = frozenset("university universität press verlag ltd inc gmbh company society institute ministry museum library committee association staff editors".split())
ROLES = frozenset("author editor translator illustrator ed eds trans ill hrsg autor trad".split())
PARTICLES = frozenset("de da di du la le van von der den zu y e af av bin ibn".split())
BIO_CHARACTERS = 1200


def normalized_name(raw: str) -> str:
    """A person's name as one reads it, or nothing: brackets, years, roles and et al. go, "Last, First" is turned round,
    capitals are mended, bodies are refused."""
    text = re.sub(r"\([^)]*\)|\[[^\]]*\]|<[^>]*>", " ", raw.replace("ʹ", "").replace("ʺ", ""))
    text = re.split(r"\b(?:et al|and others|u\.? ?a)\b\.?", text, maxsplit=1, flags=re.I)[0]
    parts = [p.strip(" ;:-") for p in re.sub(r"\d+", " ", text).split(",")]
    parts = [p if re.search(r"\b\w\.$", p) else p.strip(" .") for p in parts]
    parts = [p for p in parts if p and p.lower().rstrip(".") not in ROLES]
    if len(parts) > 1 and parts[1].lower().rstrip(".") in ("jr", "sr", "ii", "iii"):
        parts = [f"{' '.join(parts[2:])} {parts[0]} {parts[1]}".strip()]
    words = (f"{' '.join(parts[1:])} {parts[0]}" if len(parts) > 1 else "".join(parts)).split()
    if not words or BODIES.intersection(w.lower().strip(".") for w in words):
        return ""
    joined = "".join(words)
    if joined.isupper() and len(joined) > 3 or joined.islower():
        words = [w.lower() if w.lower() in PARTICLES else "-".join(p[:1].upper() + p[1:].lower() for p in w.split("-")) for w in words]
    return " ".join(words)


def name_key(name: str) -> str:
    """Folded words in order, so that both ways of writing a name meet."""
    return " ".join(sorted(re.findall(r"[^\W_]+", fold(name))))


def clean_bio(text: str) -> str:
    """Without mark-up and references; a long one ends with its last whole sentence."""
    plain = re.sub(r"\[([^\]]*)\]\([^)]*\)", r"\1", text)
    plain = re.sub(r"\[\d+\]:?\s*(?:https?://\S+)?|https?://\S+|[*_#>`]+", " ", plain)
    plain = " ".join(re.split(r"\(?\s*source\s*[:)]", plain, maxsplit=1, flags=re.I)[0].split())
    if len(plain) <= BIO_CHARACTERS:
        return plain
    head = plain[:BIO_CHARACTERS]
    ends = [m.end() for m in re.finditer(r"[.!?](?=\s|$)", head)]
    return head[: ends[-1]].strip() if ends else head.rsplit(" ", 1)[0]


SERIES = (
    re.compile(r"^(?P<rest>.+?)\s*\((?P<name>[^()#]+?),?\s*(?:#|no\.?|book|vol\.?|volume|bd\.?|band|tome|t\.)\s*(?P<n>\d{1,3})\)\s*$", re.I),
    re.compile(r"^(?P<name>.+?),\s*(?:book|vol\.?|volume|bd\.?|band|tome)\s*(?P<n>\d{1,3})(?:\s*[:.]\s*(?P<rest>.+))?$", re.I),
    re.compile(r"^(?P<name>[^\d.:]+?)\s+(?P<n>\d{1,3})\s*[.:]\s*(?P<rest>.+)$"),
)


def series_of(title: str) -> tuple[str, str, int] | None:
    """(title, series, number) of "Title (Series #n)", "Series, Book n: Title" and "Series n. Title"."""
    for pattern in SERIES:
        if (m := pattern.match(title.strip())) and 0 < int(m["n"]) <= 200:
            return (m["rest"] or "").strip(), m["name"].strip(), int(m["n"])
    return None
