"""Markup as a table of elements, numbered in document order with the number of each one's last descendant."""

from __future__ import annotations

from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of HTML: elements without content, and those whose start ends an open one of the same group.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
STOPS = frozenset("ul ol table section div nav article aside body".split())
SILENT = frozenset(("script", "style"))
#: Elements that a task hands over at once, at least.
BATCH_ROWS = 5000
#: Markup of so many characters or bytes at most is parsed once for all documents of a batch that have it.
SHORT = 4096
#: Elements whose rows keep their whole text; those of others, which hold these, keep its first TEXT characters. Both are parameters of `shred`.
WHOLE = frozenset("p h1 h2 h3 h4 h5 h6 a td th caption dt dd title dc:title dc:language text navlabel figcaption pre li aside blockquote".split())
TEXT = 200

ELEMENTS = (
    "book string, doc string, eid int, parent int, last int, depth int, tag string, nth int, child int, path string, attrs map<string,string>, "
    "text string, joined string, in_nav boolean, anchor int, table_eid int, chain string, lines array<string>"
)


class Shredder(HTMLParser):
    """Elements of one document. soup: missing end tags are filled in as browsers do for common elements."""

    def __init__(self, soup: bool, most: int = TEXT, whole: frozenset = WHOLE):
        super().__init__(convert_charrefs=True)
        self.soup, self.rows, self.open, self.top, self.most, self.whole = soup, [], [], {}, most, whole

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.soup and tag in CLOSES:
            for i in range(len(self.open) - 1, -1, -1):
                if self.rows[self.open[i]]["tag"] in CLOSES[tag]:
                    self.close_from(i)
                    break
                if self.rows[self.open[i]]["tag"] in STOPS:
                    break
        up = self.rows[self.open[-1]] if self.open else None
        eid = len(self.rows)
        seen = up["seen"] if up else self.top
        seen[tag] = seen.get(tag, 0) + 1
        step = f"{tag}[{seen[tag]}]"
        row = {
            "eid": eid, "parent": up["eid"] if up else None, "last": eid, "depth": len(self.open), "tag": tag, "nth": seen[tag], "child": sum(seen.values()) - 1,
            "path": f"{up['path']}/{step}" if up else step, "attrs": [(k, v or "") for k, v in dict(attrs).items()], "spaced": [], "size": 0, "seen": {},
            "in_nav": bool(up and (up["in_nav"] or up["tag"] == "nav")), "anchor": None, "table_eid": None, "chain": f"{up['chain']} {up['eid']}" if up else "", "lines": [""] if tag == "p" else None,
        }
        if tag == "br" and up and up["lines"]:
            up["lines"].append("")
        if up:
            row["anchor"] = up["eid"] if up["tag"] == "a" else up["anchor"]
            row["table_eid"] = up["eid"] if up["tag"] == "table" else up["table_eid"]
        self.rows.append(row)
        self.open.append(eid)
        if self.soup and tag in VOID:
            self.close_from(len(self.open) - 1)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if self.open and self.rows[self.open[-1]]["tag"] == tag:
            self.close_from(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.rows[self.open[i]]["tag"] == tag:
                self.close_from(i)
                return

    def close_from(self, i: int) -> None:
        for eid in self.open[i:]:
            self.rows[eid]["last"] = len(self.rows) - 1
        del self.open[i:]

    def handle_data(self, data: str) -> None:
        if self.open and self.rows[self.open[-1]]["tag"] not in SILENT:
            for eid in self.open:
                lines = self.rows[eid]["lines"]
                if lines:
                    lines[-1] += data
        part = data.strip()
        if not part or self.open and self.rows[self.open[-1]]["tag"] in SILENT:
            return
        for eid in self.open:
            row = self.rows[eid]
            if row["tag"] in self.whole:
                row["spaced"].append(part)
            elif row["size"] < self.most:
                row["spaced"].append(part[: self.most])
                row["size"] += len(part)


def shred_text(text: str, soup: bool, most: int = TEXT, whole: frozenset = WHOLE) -> list[dict]:
    parser = Shredder(soup, most, whole)
    parser.feed(text)
    parser.close()
    parser.close_from(0)
    for row in parser.rows:
        row["lines"] = [x.strip() for x in row["lines"]] if row["lines"] and len(row["lines"]) > 1 else None
        end = None if row["tag"] in whole else most
        row["text"], row["joined"] = " ".join(row["spaced"])[:end], "".join(row["spaced"])[:end]
    return parser.rows


def shred(docs: DataFrame, book: str | Column, doc: str | Column, text: str | Column, soup: bool = False, most: int = TEXT, whole: frozenset = WHOLE) -> DataFrame:
    """The elements of all documents; lines are the parts of a paragraph that br children part, null without any. text: markup as a string or as UTF-8 bytes. Null markup has no element.

    The tags of `whole` keep their whole text (their lines always do), other elements the first `most` characters of it.
    (eid, last) is an interval: d is below a iff a.eid < d.eid <= a.last. chain has the numbers of all above, the root first.
    """
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    kinds = [pa.string(), pa.string(), *[pa.int32()] * 4, pa.string(), pa.int32(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string())]
    names = [x.split()[0] for x in ELEMENTS.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen, places, n = [], {}, [], 0  # rows of different markup; first row and rows of short markup; book, doc, first row and rows of documents; their rows
        for batch in batches:
            for b, d, t in zip(*(batch.column(c).to_pylist() for c in ("book", "doc", "text")), strict=True):
                if t is None:
                    continue
                at = seen.get(t) if len(t) <= SHORT else None
                if at is None:
                    rows = shred_text(t.decode("utf-8-sig", "replace") if isinstance(t, bytes) else t, soup, most, whole)
                    at = len(held), len(rows)
                    held += rows
                    if len(t) <= SHORT:
                        seen[t] = at
                places.append((b, d, *at))
                n += at[1]
                if len(held) >= BATCH_ROWS or n >= 4 * BATCH_ROWS:
                    yield as_batch(held, places, n)
                    held, seen, places, n = [], {}, [], 0
        if n:
            yield as_batch(held, places, n)

    def as_batch(rows: list[dict], places: list[tuple], n: int) -> pa.RecordBatch:
        columns = [pa.array([r[c] for r in rows], k) for c, k in zip(names[2:], kinds[2:], strict=True)]
        books, docs, first, sizes = zip(*places, strict=True)
        if n > len(rows):
            ends = np.cumsum(sizes)
            at = pa.array(np.repeat(np.array(first) - ends + sizes, sizes) + np.arange(n))
            columns = [c.take(at) for c in columns]
        of = pa.array(np.repeat(np.arange(len(sizes)), sizes))
        return pa.RecordBatch.from_arrays([pa.array(books, kinds[0]).take(of), pa.array(docs, kinds[1]).take(of), *columns], names)

    picked = docs.select(as_column(book).cast("string").alias("book"), as_column(doc).cast("string").alias("doc"), as_column(text).alias("text"))
    return picked.mapInArrow(work, ELEMENTS)


class Runs(Shredder):
    """Texts of one document as they lie between tags, for `shred_runs`."""

    def __init__(self, soup: bool):
        super().__init__(soup)
        self.runs = []

    def handle_data(self, data: str) -> None:
        if not self.open or self.rows[self.open[-1]]["tag"] not in SILENT:
            self.add(data)

    def add(self, data: str | None) -> None:
        self.runs.append((len(self.runs), len(self.rows) - 1, self.open[-1] if self.open else None, data))

    def handle_endtag(self, tag: str) -> None:
        if all(self.rows[eid]["tag"] != tag for eid in self.open):
            self.add(None)
        super().handle_endtag(tag)

    def cut(self, *_: str) -> None:
        self.add(None)

    handle_comment = handle_decl = handle_pi = unknown_decl = cut


def shred_runs(docs: DataFrame, book: str | Column, doc: str | Column, text: str | Column, soup: bool = False) -> DataFrame:
    """(book, doc, ord, at, up, data): the texts between tags, but those of scripts and styles; null data stands for what parts texts and is no element (a comment, say).

    at: the last element that begins before, -1 for none; up: the element that holds the text, null for none. Null markup has no text.
    """
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    names = ["book", "doc", "ord", "at", "up", "data"]
    kinds = [pa.string(), pa.string(), *[pa.int32()] * 3, pa.string()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, d, t in zip(*(batch.column(c).to_pylist() for c in ("book", "doc", "text")), strict=True):
                if t is None:
                    continue
                parser = Runs(soup)
                parser.feed(t.decode("utf-8-sig", "replace") if isinstance(t, bytes) else t)
                parser.close()
                columns = [[b] * len(parser.runs), [d] * len(parser.runs), *(list(zip(*parser.runs, strict=True)) or [()] * 4)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    picked = docs.select(as_column(book).cast("string").alias("book"), as_column(doc).cast("string").alias("doc"), as_column(text).alias("text"))
    return picked.mapInArrow(work, "book string, doc string, ord int, at int, up int, data string")


def attr(name: str) -> Column:
    """An attribute's value; null where it is absent, which isn't the same as empty."""
    return F.try_element_at("attrs", F.lit(name))


class Rewriter(HTMLParser):
    """Copies markup but for the start tags that edits name, and for the names in their end tags.

    Of an edit's names, `before` is markup in front of the element, `append` markup that goes to its end, `text` what takes the place
    of all that is in it, `wrap` a start tag's inside (its name and
    attributes) of a new element around it, and `remove` leaves the element out; the others are as in `changes.set_attributes`.
    """

    def __init__(self, edits: dict[str, dict[str, str | None]]):
        super().__init__(convert_charrefs=False)
        self.edits, self.kept, self.open, self.top, self.done, self.removed = edits, [], [], {}, set(), None

    @property
    def out(self) -> list:
        """Where markup goes; nowhere within an element that is left out."""
        return self.kept if self.removed is None else []

    def start(self, tag: str, attrs: list, closed: bool) -> None:
        seen = self.open[-1][2] if self.open else self.top
        seen[tag] = seen.get(tag, 0) + 1
        path = (self.open[-1][1] + "/" if self.open else "") + f"{tag}[{seen[tag]}]"
        raw, name, after = self.get_starttag_text(), tag, ""
        if path in self.edits:
            self.done.add(path)
            change = dict(self.edits[path])
            if "remove" in change:
                if not closed and self.removed is None:
                    self.removed = path
                    self.open.append((tag, path, {}, name, ""))
                elif not closed:
                    self.open.append((tag, path, {}, name, ""))
                return
            wrap, appended, before = (change.pop(x, None) for x in ("wrap", "append", "before"))
            text = change.pop("text", None)
            level = change.pop("heading_level", None)
            name = f"h{level}" if level and len(tag) == 2 and tag[0] == "h" and tag[1].isdigit() else change.pop("tag", None) or tag
            change.pop("tag", None)
            kept = {k: v for k, v in dict(attrs).items() if k not in change} | {k: v for k, v in change.items() if v is not None}
            if change or name != tag or appended and closed:
                raw = f"<{name}" + "".join(f' {k}="{escape(v or "", quote=True)}"' for k, v in kept.items()) + ("/>" if closed and not appended else ">")
            raw = (before or "") + (f"<{wrap}>{raw}" if wrap else raw)
            after = f"</{wrap.split()[0]}>" if wrap else ""
            if appended and closed:
                raw += f"{appended}</{name}>{after}"
            elif closed:
                raw += after
        else:
            appended = text = None
        self.out.append(raw)
        if not closed:
            self.open.append((tag, path, {}, name, (escape(text, quote=False) if text is not None else appended or "", after)))
            if text is not None and self.removed is None:
                self.removed = path

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.start(tag, attrs, False)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.start(tag, attrs, True)

    def handle_endtag(self, tag: str) -> None:
        name, appended, after = tag, "", ""
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                ends = self.open[i:]
                name = ends[0][3]
                appended, after = ends[0][4] or ("", "")
                del self.open[i:]
                if any(path == self.removed for _, path, *_ in ends):
                    self.removed = None
                    if ends[0][1] in self.edits and "remove" in self.edits[ends[0][1]]:
                        return
                break
        self.out.append(f"{appended}</{name}>{after}")

    def handle_data(self, data: str) -> None:
        self.out.append(data)

    def handle_entityref(self, name: str) -> None:
        self.out.append(f"&{name};")

    def handle_charref(self, name: str) -> None:
        self.out.append(f"&#{name};")

    def handle_comment(self, data: str) -> None:
        self.out.append(f"<!--{data}-->")

    def handle_decl(self, decl: str) -> None:
        self.out.append(f"<!{decl}>")

    def handle_pi(self, data: str) -> None:
        self.out.append(f"<?{data}>")

    def unknown_decl(self, data: str) -> None:
        self.out.append(f"<![{data}]>")


def rewrite_text(text: str, edits: dict[str, dict[str, str | None]]) -> str:
    parser = Rewriter(edits)
    parser.feed(text)
    parser.close()
    return "".join(parser.kept)


def rewrite_entries(entries: DataFrame, edits: DataFrame) -> DataFrame:
    """Package entries with edits (book, doc, path, name, value) in their markup; only edited documents are touched."""
    listed = edits.groupBy(F.col("book"), F.col("doc").alias("name")).agg(F.collect_list(F.struct("path", F.col("name").alias("attr"), "value")).alias("_edits"))
    joined = entries.join(listed, ["book", "name"], "left")
    kept = joined.where("_edits is null").select(*entries.columns)
    changed = joined.where("_edits is not null")
    names = entries.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for content, listed in zip(batch.column("content").to_pylist(), batch.column("_edits").to_pylist(), strict=True):
                by_path: dict[str, dict[str, str | None]] = {}
                for e in sorted(listed, key=lambda e: (e["path"], e["attr"], e["value"] or "")):
                    by_path.setdefault(e["path"], {})[e["attr"]] = e["value"]
                texts.append(rewrite_text((content or b"").decode("utf-8-sig", "replace"), by_path).encode())
            columns = [pa.array(texts, pa.binary()) if c == "content" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names)

    return kept.unionByName(changed.mapInArrow(work, entries.schema))
