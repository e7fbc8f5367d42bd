"""Web pages and markdown to sections and paragraphs, a row each."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Elements that open a section, give a paragraph, or are left out.
MAJOR = {"h1", "h2"}
MINOR = {"h3", "h4", "h5", "h6"}
PARAGRAPHS = {"p", "li", "blockquote", "pre"} | MINOR
BOILERPLATE = {"script", "style", "nav", "header", "footer", "aside", "noscript", "form"}
INTRO_CHARS = 500
#: Bytes of text that are parsed before their rows are sent on.
PORTION = 1_000_000
SECTION = "page_number bigint, section_title string, text string, text_length bigint, extraction_status string"


class _Sections(HTMLParser):
    """Collects (title, paragraphs) in page order; table rows become `header: cell | ...` lines."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.sections: list[tuple[str, list[str]]] = [("(intro)", [])]
        self.skip = self.table = 0
        self.open: list[tuple[str, list[str]]] = []
        self.headers: list[str] = []
        self.row: list[tuple[str, str]] = []

    def handle_starttag(self, tag, attrs):
        if tag in BOILERPLATE:
            self.skip += 1
        elif tag == "table":
            self._close_all()
            self.table += 1
            self.headers = []
        elif self.table and tag == "tr":
            self._end_row()
        elif tag in MAJOR | {"td", "th"} or tag in PARAGRAPHS and not self.table:
            if tag in PARAGRAPHS | MAJOR:
                self._close_all()
            self.open.append((tag, []))

    def handle_endtag(self, tag):
        if tag in BOILERPLATE:
            self.skip = max(0, self.skip - 1)
        elif tag in ("tr", "table") and self.table:
            self._end_row()
            self.table -= tag == "table"
        elif any(t == tag for t, _ in self.open):
            while self._close()[0] != tag:
                pass

    def handle_data(self, data):
        if not self.skip and self.open:
            self.open[-1][1].append(data)

    def _close(self):
        tag, parts = self.open.pop()
        text = " ".join(" ".join(parts).split())
        if tag in MAJOR:
            self.sections.append((text or "(unnamed section)", []))
        elif tag in ("td", "th"):
            self.row.append((tag, text))
        elif text:
            self.sections[-1][1].append(f"## {text}" if tag in MINOR else text)
        return tag, text

    def _close_all(self):
        while self.open:
            self._close()

    def _end_row(self):
        self._close_all()
        if self.row and not self.headers and all(t == "th" for t, _ in self.row):
            self.headers = [c for _, c in self.row]
        elif self.row:
            named = [f"{self.headers[i]}: {c}" if i < len(self.headers) and self.headers[i] else c for i, (_, c) in enumerate(self.row) if c]
            if named:
                self.sections[-1][1].append(" | ".join(named))
        self.row = []


def sections(html: str | None) -> list[tuple[int, str, str, int, str]]:
    """(page_number, title, text, length, status) of a page; one empty row for a page without text."""
    parser = _Sections()
    parser.feed(html or "")
    parser.close()
    parser._end_row()
    parser._close_all()
    found = [(title, "\n\n".join(dict.fromkeys(parts))) for title, parts in parser.sections]
    found = [(title, text) for title, text in found if text or title != "(intro)"]
    if len(found) > 1 and found[0][0] == "(intro)" and len(found[0][1]) < INTRO_CHARS:
        found = found[1:]
    if not any(text for _, text in found):
        return [(1, found[0][0] if found else "(intro)", "", 0, "empty")]
    return [(i + 1, title, text, len(text), "success" if text else "empty") for i, (title, text) in enumerate(found)]


def _portions(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of the batches, whose second column has some PORTION bytes of text in each (one row at least), so that a task's memory doesn't go by the rows of a batch."""
    for batch in batches:
        ends = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = done = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(ends, done + PORTION, "right")))
            yield batch.slice(start, end - start)
            start, done = end, int(ends[end - 1])


def page_sections(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key and the sections of each page, a row each; one bad page fails alone."""
    kind = pages.schema[key].dataType.simpleString()
    names = [key, "page_number", "section_title", "text", "text_length", "extraction_status"]

    def run(batches):
        for batch in _portions(batches):
            own, rows = [], []
            for i, html in enumerate(batch.column(1).to_pylist()):
                try:
                    found = sections(html)
                except Exception:  # the page's own fault is its status
                    found = [(1, "(intro)", "", 0, "failed")]
                own += [i] * len(found)
                rows += found
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()))] if rows else [pa.array([], t) for t in (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own, pa.int32())), *columns], names)

    return pages.select(key, "html").mapInArrow(run, f"{key} {kind}, {SECTION}")


def plain_text(html: Column) -> Column:
    """A page's text without scripts, styles and markup; the common character references are read."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    for name, mark in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("nbsp", " "), ("amp", "&")):
        bare = F.replace(bare, F.lit(f"&{name};"), F.lit(mark))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


HEADING = re.compile(r"^#{1,6}\s+(.*)$")


def markdown_paragraphs(text: str | None) -> list[tuple[int, str, int, int, str]]:
    """(index, section path, start, end, text) of blank-line paragraphs below `#` headings; offsets are code points."""
    out, path, at = [], "", 0
    for m in re.finditer(r"(?:[^\n]|\n(?!\s*\n))+", text or ""):
        at = m.start()
        body = []
        for line in m[0].split("\n"):
            if h := HEADING.match(line):
                path = h[1].strip()
            elif line.strip():
                body.append((at, at + len(line), line))
            at += len(line) + 1
        if body:
            out.append((len(out), path, body[0][0], body[-1][1], (text or "")[body[0][0] : body[-1][1]]))
    return out


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph_index, section_path, start_offset, end_offset and text of markdown documents."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in _portions(batches):
            rows = [(i, *p) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for p in markdown_paragraphs(text)]
            yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "paragraph_index", "section_path", "start_offset", "end_offset", "text"), r)) for r in rows], schema=pa.schema([("doc_id", batch.schema.field(0).type), ("paragraph_index", pa.int64()), ("section_path", pa.string()), ("start_offset", pa.int64()), ("end_offset", pa.int64()), ("text", pa.string())]))

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, paragraph_index bigint, section_path string, start_offset bigint, end_offset bigint, text string")
