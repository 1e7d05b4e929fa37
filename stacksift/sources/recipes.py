"""Recipes: what to take from pages of a provider, as data that a user writes.

A recipe names the rows of a page and the fields of a row by picks (JSON path, regular expression or element), steps that
follow a field's address to another page, and a template of the result's address. Pages come from a table, nothing is
fetched here.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

PICKS = {"json", "regex", "element"}
FIELD = re.compile(r"\{(\w+)\}")
RESULT = "page string, row int, fields map<string,string>, address string, fault string"


@dataclass(frozen=True)
class Recipe:
    name: str
    rows: dict
    fields: dict
    steps: tuple = ()
    address: str = ""
    known: frozenset = field(default_factory=frozenset)


def validated(text: str) -> Recipe:
    """A recipe from its JSON; unknown keys, picks and fields, and expressions that don't compile raise with their place."""
    raw = json.loads(text)
    extra = set(raw) - {"name", "rows", "fields", "steps", "address"}
    if extra or not raw.get("name") or not raw.get("fields"):
        raise ValueError(f"recipe: unknown {sorted(extra)}" if extra else "recipe: a name and fields are needed")
    steps = raw.get("steps", [])
    known: set[str] = set()
    for place, picks in [("rows", {"rows": raw["rows"]} if "rows" in raw else {}), ("fields", raw["fields"]), *((f"step {n}", s.get("fields", {})) for n, s in enumerate(steps, 1))]:
        for name, pick in picks.items():
            if len(PICKS & set(pick)) != 1 or set(pick) - PICKS - {"group", "attribute"}:
                raise ValueError(f"{place}: {name} needs one of {sorted(PICKS)}")
            if "regex" in pick:
                re.compile(pick["regex"])
    known.update(raw["fields"])
    for n, step in enumerate(steps, 1):
        missing = set(FIELD.findall(step.get("follow", ""))) - known
        if missing or not step.get("follow"):
            raise ValueError(f"step {n}: follows {sorted(missing) or 'nothing'}")
        known.update(step.get("fields", {}))
    missing = set(FIELD.findall(raw.get("address", ""))) - known
    if missing:
        raise ValueError(f"address: unknown {sorted(missing)}")
    return Recipe(raw["name"], raw.get("rows", {}), raw["fields"], tuple(steps), raw.get("address", ""), frozenset(known))


def _json(value, path: str) -> list:
    found = [value]
    for key in filter(None, path.split(".")):
        step = []
        for v in found:
            if key == "*":
                step += v if isinstance(v, list) else list(v.values()) if isinstance(v, dict) else []
            elif isinstance(v, dict) and key in v:
                step.append(v[key])
            elif isinstance(v, list) and key.isdigit() and int(key) < len(v):
                step.append(v[int(key)])
        found = step
    return found


def taken(text: str, pick: dict) -> list[str]:
    """All that a pick finds in a text. An element is a tag, with a class behind a stop if it must have one; nested elements of
    the same tag belong to the outer one."""
    if "json" in pick:
        try:
            return [x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in _json(json.loads(text), pick["json"]) if x is not None]
        except ValueError:
            return []
    if "regex" in pick:
        return [m[pick.get("group", min(1, m.re.groups))] or "" for m in re.finditer(pick["regex"], text, re.S)]
    tag, _, style = pick["element"].partition(".")
    out, depth, start, attributes = [], 0, 0, ""
    for m in re.finditer(rf"<(/?){re.escape(tag)}\b([^>]*)>", text, re.I):
        if m[1]:
            depth -= depth > 0
            if depth == 0 and start:
                out.append((attributes, text[start : m.start()]))
                start = 0
        else:
            named = re.search(r"\bclass\s*=\s*[\"']?([^\"'>]*)", m[2])
            if depth == 0 and (not style or named and style in named[1].split()):
                start, attributes, depth = m.end(), m[2], 1
                if pick.get("attribute") and m[2].rstrip().endswith("/"):
                    out.append((attributes, ""))
                    start, depth = 0, 0
            elif depth:
                depth += 1
    if "attribute" in pick:
        found = [re.search(rf"\b{re.escape(pick['attribute'])}\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", a) for a, _ in out]
        return [html.unescape(m[1] if m[1] is not None else m[2]) for m in found if m]
    return [inner for _, inner in out]


def plain(text: str) -> str:
    return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", text)).split())


def applied(pages: DataFrame, recipe: Recipe, linked: dict[str, str] | None = None) -> DataFrame:
    """(page, row, fields, address, fault) from pages (page, text). ``linked`` has the pages that steps lead to, a bounded table
    of the provider's; a row whose step leads elsewhere names it as its fault."""
    linked = linked or {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page, text in zip(batch["page"], batch["text"], strict=True):
                for n, part in enumerate(taken(text or "", recipe.rows) if recipe.rows else [text or ""]):
                    found = {name: plain(next(iter(taken(part, pick)), "")) for name, pick in recipe.fields.items()}
                    fault = None
                    for step in recipe.steps:
                        address = FIELD.sub(lambda m, f=found: f.get(m[1], ""), step["follow"])
                        if address not in linked:
                            fault = f"no page {address}"
                            break
                        found |= {name: plain(next(iter(taken(linked[address], pick)), "")) for name, pick in step.get("fields", {}).items()}
                    address = FIELD.sub(lambda m, f=found: f.get(m[1], ""), recipe.address)
                    rows.append((page, n, found, address, fault))
            yield pd.DataFrame(rows, columns=["page", "row", "fields", "address", "fault"]).astype({"row": "int32"})

    return pages.select("page", "text").mapInPandas(run, RESULT)
