"""Documents as blocks: pages, plain texts, Markdown, rich text, and the zipped and XML formats of books and offices."""

from __future__ import annotations

import html
import io
import json
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from html.entities import html5
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCKS = "path string, format string, title string, at int, kind string, text string, fault string"
TAG = re.compile(r"<!--.*?-->|<(script|style|svg|title)\b.*?</\1\s*>|<(/?)([a-zA-Z][\w:-]*)[^>]*>", re.S | re.I)
BREAKS = set("p div section article li ul ol tr td th blockquote pre h1 h2 h3 h4 h5 h6 header footer nav main body br hr table dt dd figcaption".split())
#: Most bytes that a member of an archive may unpack to.
MEMBER = 64 << 20


def sniffed(name: str, data: bytes) -> str:
    """The format by content first, then by the name."""
    head = data[:4096]
    if head[:4] == b"PK\x03\x04":
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as box:
                inside = set(box.namelist())
        except zipfile.BadZipFile:
            return "zip"
        return next((kind for kind, member in (("epub", "META-INF/container.xml"), ("docx", "word/document.xml"), ("odt", "content.xml")) if member in inside), "zip")
    if head[:5] == b"%PDF-":
        return "pdf"
    if head[:5] == b"{\\rtf":
        return "rtf"
    text = head.decode("utf-8", "replace").lstrip("\ufeff \n\r\t").lower()
    if "<fictionbook" in text:
        return "fb2"
    if text.startswith(("<!doctype html", "<html")) or "<body" in text:
        return "html"
    return {"md": "md", "markdown": "md", "html": "html", "htm": "html"}.get(name.lower().rpartition(".")[2], "txt")


#: Character references that end as they should.
CLOSED = re.compile(r"&(?:#\d+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);")


def closed_references(text: str) -> str:
    """Decode the references that end in a semicolon; one that was cut short stays as it is."""
    return CLOSED.sub(lambda m: html.unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html5 else m[0], text)


def html_blocks(page: str, decoded: Callable[[str], str] = html.unescape) -> list[tuple[str, str]]:
    """(kind, text) of a page: headings, list items and paragraphs. ``decoded`` gives a text's references their characters."""
    out: list[tuple[str, str]] = []
    kind, parts, at = "paragraph", [], 0

    def flush() -> None:
        text = " ".join(decoded("".join(parts)).split())
        if text:
            out.append((kind, text))
        parts.clear()

    for m in TAG.finditer(page):
        parts.append(page[at : m.start()])
        at, tag = m.end(), (m[3] or "").lower()
        if tag in BREAKS:
            flush()
            kind = "paragraph" if m[2] else "heading" if re.fullmatch("h[1-6]", tag) else "item" if tag == "li" else "paragraph" if tag != "br" else kind
    parts.append(page[at:])
    flush()
    return out


def text_blocks(text: str) -> list[tuple[str, str]]:
    """Paragraphs between empty lines."""
    return [("paragraph", " ".join(p.split())) for p in re.split(r"\n\s*\n", text.replace("\r\n", "\n")) if p.strip()]


def markdown_blocks(text: str) -> list[tuple[str, str]]:
    """Headings, items and paragraphs, marks of emphasis and links taken off."""
    out = []
    for block in re.split(r"\n\s*\n|\n(?=#{1,6} )|\n(?=[-*+] )", text.replace("\r\n", "\n")):
        plain = " ".join(re.sub(r"\[([^\]]*)\]\([^)]*\)", r"\1", re.sub(r"[*_`]{1,3}", "", block)).split()) if block.strip() else ""
        if heading := re.match(r"\s*#{1,6}\s+(.*)", block):
            first, _, rest = block.strip().partition("\n")
            out.append(("heading", re.sub(r"[*_`#]", "", heading[1]).strip()))
            out += markdown_blocks(rest) if rest.strip() else []
        elif re.match(r"\s*[-+*] ", block):
            out.append(("item", re.sub(r"^[-+]? ?", "", plain)))
        elif plain:
            out.append(("paragraph", plain))
    return out


def rtf_blocks(data: bytes) -> list[tuple[str, str]]:
    """Paragraphs of rich text; groups of fonts, colours, styles and pictures are left out."""
    text = re.sub(r"\{\\(?:\*|fonttbl|colortbl|stylesheet|info|pict)(?:[^{}]|\{[^{}]*\})*\}", "", data.decode("latin-1"))
    text = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes([int(m[1], 16)]).decode("cp1252", "replace"), text)
    text = re.sub(r"\\u(-?\d+) ?\??", lambda m: chr(int(m[1]) % 65536), text)
    text = re.sub(r"\\(?:par|line|page|sect)\b ?", "\n\n", text.replace("\r", "").replace("\n", " "))
    text = re.sub(r"\\tab\b ?", " ", text)
    return text_blocks(re.sub(r"\\([\\{}])", r"\1", re.sub(r"\\[a-zA-Z]+-?\d* ?|(?<!\\)[{}]", "", text)))


def _local(element: ElementTree.Element) -> str:
    return element.tag.rpartition("}")[2] if isinstance(element.tag, str) else ""


def _member(box: zipfile.ZipFile, name: str) -> bytes:
    if box.getinfo(name).file_size > MEMBER:
        raise ValueError(f"{name} unpacks to more than {MEMBER} bytes")
    return box.read(name)


def _xml(data: bytes) -> ElementTree.Element:
    if re.search(rb"<!ENTITY", data[:8192]):
        raise ValueError("declared entities aren't read")
    return ElementTree.fromstring(data)


def epub(data: bytes) -> tuple[str, list[tuple[str, str]]]:
    """Title and blocks of the spine's pages in order."""
    with zipfile.ZipFile(io.BytesIO(data)) as box:
        root = next(e.attrib["full-path"] for e in _xml(_member(box, "META-INF/container.xml")).iter() if _local(e) == "rootfile")
        package = _xml(_member(box, root))
        files = {e.attrib["id"]: e.attrib["href"] for e in package.iter() if _local(e) == "item"}
        title = next((e.text or "" for e in package.iter() if _local(e) == "title"), "")
        out = []
        for e in package.iter():
            if _local(e) == "itemref" and e.attrib.get("linear") != "no" and e.attrib["idref"] in files:
                name = posixpath.normpath(posixpath.join(posixpath.dirname(root), files[e.attrib["idref"]].partition("#")[0]))
                if name in box.namelist():
                    out += html_blocks(_member(box, name).decode("utf-8", "replace"))
    return title.strip(), out


def fb2(data: bytes) -> tuple[str, list[tuple[str, str]]]:
    """Title and blocks of the bodies of a fiction book."""
    root = _xml(data)
    title = next((" ".join("".join(e.itertext()).split()) for e in root.iter() if _local(e) == "book-title"), "")
    out = []
    for body in (e for e in root if _local(e) == "body"):
        heads = {id(p) for t in body.iter() if _local(t) in ("title", "subtitle") for p in t.iter()}
        for e in body.iter():
            if _local(e) in ("p", "v", "subtitle", "text-author"):
                text = " ".join("".join(e.itertext()).split())
                if text:
                    out.append(("heading" if id(e) in heads else "paragraph", text))
    return title, out


def office(data: bytes, member: str, paragraph: str, heading: str) -> tuple[str, list[tuple[str, str]]]:
    """Paragraphs of an office document's content; headings by element or by the name of their style."""
    with zipfile.ZipFile(io.BytesIO(data)) as box:
        root = _xml(_member(box, member))
    out = []
    for e in root.iter():
        if _local(e) in (paragraph, heading):
            said = "".join((x.text or "") if _local(x) == "t" else "\t" if _local(x) == "tab" else "" for x in e.iter()) if member.startswith("word") else "".join(e.itertext())
            style = next((v for x in e.iter() if _local(x) == "pStyle" for k, v in x.attrib.items() if k.endswith("val")), "")
            text = " ".join(said.split())
            if text:
                out.append(("heading" if _local(e) == heading != paragraph or re.match("heading|title", style, re.I) else "paragraph", text))
    return next((t for k, t in out if k == "heading"), ""), out


def opened(name: str, data: bytes) -> tuple[str, str, list[tuple[str, str]]]:
    """(format, title, blocks) of a document; formats without a reader raise."""
    kind = sniffed(name, data)
    if kind == "epub":
        return kind, *epub(data)
    if kind == "fb2":
        return kind, *fb2(data)
    if kind == "docx":
        return kind, *office(data, "word/document.xml", "p", "p")
    if kind == "odt":
        return kind, *office(data, "content.xml", "p", "h")
    if kind == "rtf":
        blocks = rtf_blocks(data)
    elif kind in ("txt", "md", "html"):
        text = data.decode("utf-8", "replace").lstrip("\ufeff")
        blocks = {"txt": text_blocks, "md": markdown_blocks, "html": html_blocks}[kind](text)
    else:
        raise ValueError(f"no reader for {kind}")
    return kind, next((t for k, t in blocks if k == "heading"), ""), blocks


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of all files under a path, a file in one task; a file that can't be read is one row that names its fault."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    kind, title, blocks = opened(name, bytes(content))
                    rows += [(name, kind, title, i, k, t, None) for i, (k, t) in enumerate(blocks)]
                except Exception as fault:  # any malformed file
                    rows.append((name, None, None, None, None, None, f"{type(fault).__name__}: {fault}"))
            yield pd.DataFrame(rows, columns=["path", "format", "title", "at", "kind", "text", "fault"]).astype({"at": "Int32"})

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInPandas(read, BLOCKS)


def feed(text: str) -> list[dict]:
    """Entries of an Atom or JSON catalogue feed: title, author, id, acquisitions as (address, type)."""
    if text.lstrip().startswith("{"):
        found = json.loads(text)
        links = lambda p: [(x["href"], x.get("type", "")) for x in p.get("links", []) if "acquisition" in str(x.get("rel", "")) and x.get("href")]
        author = lambda a: a if isinstance(a, str) else a.get("name", "") if isinstance(a, dict) else ", ".join(map(author, a)) if isinstance(a, list) else ""
        return [{"id": p["metadata"].get("identifier", ""), "title": p["metadata"].get("title", ""), "author": author(p["metadata"].get("author", "")), "acquisitions": links(p)} for p in found.get("publications", []) if p.get("metadata")]
    out = []
    for entry in (e for e in _xml(text.encode()).iter() if _local(e) == "entry"):
        one = lambda name: next((" ".join("".join(x.itertext()).split()) for x in entry if _local(x) == name), "")  # noqa: E731, B023
        links = [(x.attrib["href"], x.attrib.get("type", "")) for x in entry if _local(x) == "link" and "acquisition" in x.attrib.get("rel", "") and x.attrib.get("href")]
        author = next((" ".join((n.text or "").split()) for x in entry if _local(x) == "author" for n in x if _local(n) == "name"), "")
        out.append({"id": one("id"), "title": one("title"), "author": author, "acquisitions": links})
    return out


def feeds(raw: DataFrame) -> DataFrame:
    """(id, title, author, address, type) of all acquisitions in feeds of a column ``record``."""
    kind = "array<struct<id:string,title:string,author:string,acquisitions:array<struct<address:string,type:string>>>>"

    @F.pandas_udf(kind)
    def read(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [(e["id"], e["title"], e["author"], e["acquisitions"]) for e in feed(t)] if t else [])

    rows = raw.select(F.explode(read("record")).alias("e")).select("e.*")
    return rows.select("id", "title", "author", F.explode("acquisitions").alias("a")).select("id", "title", "author", "a.address", "a.type")
