"""HTML, Markdown, plain text and DOCX as pages of text."""

from __future__ import annotations

import re
import zipfile
from html import unescape
from pathlib import Path

from pyspark.sql import SparkSession

from plumbline.sources.registry import Dataset, NotThisFormat, Options, looks_like_text, missing_library, reader

PAGE_WORDS = 600


def pages_of(text: str, words: int = PAGE_WORDS) -> list[str]:
    """Pages of whole paragraphs, each up to a number of words where paragraphs allow."""
    out, size = [[]], 0
    for p in re.split(r"\n\s*\n", text):
        n = len(p.split())
        if out[-1] and size + n > words:
            out.append([])
            size = 0
        out[-1].append(p.strip())
        size += n
    return ["\n\n".join(p) for p in out if any(p)]


def _document(spark: SparkSession, path: Path, pages: list[str], meta: dict) -> Dataset:
    return Dataset("document", spark.createDataFrame([(path.name, i + 1, p) for i, p in enumerate(pages)], "file string, page int, text string"), meta)


@reader("html", "Document", extensions=(".html", ".htm"), sniff=lambda h: b"<html" in h.lower() or b"<!doctype html" in h.lower())
def read_html(spark: SparkSession, path: Path, options: Options) -> Dataset:
    raw = path.read_text(encoding="utf-8", errors="replace")
    body = re.sub(r"(?is)<(script|style|noscript)\b.*?</\1\s*>|<!--.*?-->", " ", raw)
    text = lambda x: " ".join(unescape(re.sub(r"<[^>]+>", " ", x)).split())
    first = lambda p: next((text(m) for m in re.findall(p, body, re.I | re.S) if text(m)), "")
    meta = {"title": first(r"<h1[^>]*>(.*?)</h1>") or first(r"<title[^>]*>(.*?)</title>"), "headings": [text(h) for h in re.findall(r"<h[1-3][^>]*>(.*?)</h[1-3]>", body, re.I | re.S)]}
    author = re.search(r"<meta[^>]+name=[\"']author[\"'][^>]+content=[\"']([^\"']*)", raw, re.I)
    if author:
        meta["author"] = unescape(author[1])
    meta["captions"] = [text(c) for c in re.findall(r"<figcaption[^>]*>(.*?)</figcaption>", body, re.I | re.S)]
    meta["tables"] = [[[text(c) for c in re.findall(r"<t[dh][^>]*>(.*?)</t[dh]>", r, re.I | re.S)] for r in re.findall(r"<tr[^>]*>(.*?)</tr>", t, re.I | re.S)[:30]] for t in re.findall(r"<table[^>]*>(.*?)</table>", body, re.I | re.S)[:15]]
    lines = re.sub(r"(?i)</(p|div|h[1-6]|li|tr|article|section)>|<br[^>]*>", "\n\n", re.sub(r"(?is)<head\b.*?</head>", " ", body))
    return _document(spark, path, pages_of("\n\n".join(filter(None, (text(x) for x in lines.split("\n\n"))))), meta)


@reader("markdown", "Document", extensions=(".md", ".markdown"))
def read_markdown(spark: SparkSession, path: Path, options: Options) -> Dataset:
    raw = path.read_text(encoding="utf-8", errors="replace")
    heads = re.findall(r"(?m)^#{1,6}\s+(.+?)\s*#*$", raw)
    rows = [[c.strip() for c in x.strip().strip("|").split("|")] for x in raw.splitlines() if x.lstrip().startswith("|")]
    return _document(spark, path, pages_of(raw), {"title": heads[0] if heads else "", "headings": heads, "table_rows": len(rows)})


@reader("text", "Document", extensions=(".txt", ".log", ".rst"), sniff=looks_like_text, priority=90)
def read_text(spark: SparkSession, path: Path, options: Options) -> Dataset:
    raw = path.read_text(encoding="utf-8", errors="replace")
    if not raw.strip():
        raise NotThisFormat("empty")
    return _document(spark, path, pages_of(raw), {"title": raw.strip().splitlines()[0][:200]})


@reader("docx", "Document", extensions=(".docx",))
def read_docx(spark: SparkSession, path: Path, options: Options) -> Dataset:
    import xml.etree.ElementTree as E

    try:
        with zipfile.ZipFile(path) as z:
            root = E.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError) as e:
        raise NotThisFormat("no word document inside") from e
    ns = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    text, heads = [], []
    for p in root.iter(f"{ns}p"):
        t = "".join(x.text or "" for x in p.iter(f"{ns}t"))
        style = next((s.get(f"{ns}val", "") for s in p.iter(f"{ns}pStyle")), "")
        if t.strip():
            text.append(t)
            if style.lower().startswith(("heading", "title")):
                heads.append(t)
    return _document(spark, path, pages_of("\n\n".join(text)), {"title": heads[0] if heads else "", "headings": heads, "n_tables": sum(1 for _ in root.iter(f"{ns}tbl"))})


missing_library("pdf", "Document", "pypdf", extensions=(".pdf",), magic=(b"%PDF",))
