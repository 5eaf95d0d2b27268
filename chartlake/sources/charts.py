"""Chart entries from CSV, JSON and HTML that stands in a column.

Every parser takes a DataFrame with one document per row (``url`` and a text
column) and gives one row per entry; malformed documents give none.
"""

from __future__ import annotations

import io
import json
import re
from collections.abc import Iterator, Sequence
from html import unescape
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chartlake.functions.keys import video_id
from chartlake.runtime import map_arrow

ENTRY = "url string, pos int, rank int, item_id string, title string, artist string, album string, previous_rank int, artwork_url string"
# Names of CSV columns.
CSV_COLUMNS = {
    "url": ("YouTube URL", "URL", "Video URL"), "rank": ("Rank",), "title": ("Track Name", "Title"),
    "artist": ("Artist Names", "Artist", "Artists"), "views": ("Views",), "previous_rank": ("Previous Rank",),
}
# Scripts of a page that hold JSON.
PAGE_JSON = (r"(?s)ytInitialData\s*=\s*(\{.*?\})\s*;", r"(?s)AF_initDataCallback\((\{.*?\})\);", r"(?s)window\.__data\s*=\s*(\{.*?\})\s*;")
PAGE_CONFIG = r"(?s)ytcfg\.set\((\{.*?\})\);"


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """``url, text`` of whole files or a glob."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("url"), F.col("value").alias("text"))


def looks_like_csv(text: Column) -> Column:
    """Whether the first line is the head of a chart's CSV."""
    head = F.split(F.regexp_replace(text, "^﻿", ""), "\n", 2)[0]
    return F.coalesce(head.contains("Rank") & (head.contains("Track Name") | head.contains("Title")), F.lit(False))


def parse_csv(docs: DataFrame, text: str = "text", limit: int | None = None) -> DataFrame:
    """Entries of CSV texts: the columns by any of their names, the id from the
    URL; rows without an id are skipped, and a missing rank is the place among
    the kept rows. ``limit`` keeps the first entries of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import csv

        for b in batches:
            rows = []
            for url, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for i, row in enumerate(csv.DictReader(io.StringIO((body or "").lstrip("﻿"), newline=""))):
                    got = {k: next((row[n] for n in names if row.get(n)), None) for k, names in CSV_COLUMNS.items()}
                    rows.append((url, i, *(got[k] for k in CSV_COLUMNS)))
            cols = list(zip(*rows)) or [[]] * (2 + len(CSV_COLUMNS))
            types = [pa.string(), pa.int32(), *[pa.string()] * len(CSV_COLUMNS)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc", "line", *CSV_COLUMNS])

    raw = map_arrow(docs.select("url", text), run, "doc string, line int, " + ", ".join(f"{k} string" for k in CSV_COLUMNS))
    kept = raw.withColumn("item_id", video_id(F.coalesce("url", F.lit("")))).where("item_id <> ''")
    kept = kept.withColumn("pos", F.row_number().over(W.partitionBy("doc").orderBy("line")))
    if limit is not None:
        kept = kept.where(F.col("pos") <= limit)
    return kept.select(
        F.col("doc").alias("url"), "pos", F.coalesce(F.col("rank").try_cast("int"), "pos").alias("rank"), "item_id", "title", "artist",
        F.col("views").try_cast("bigint").alias("views"), F.col("previous_rank").try_cast("int").alias("previous_rank"),
    )


def find_csv_urls(docs: DataFrame, text: str = "text") -> DataFrame:
    """``url, pos, csv_url``: links to CSV files and downloads in a page, made
    absolute, each once, in order."""
    html = F.col(text)
    whole = F.regexp_extract_all(html, F.lit(r"""(?i)(https?://[^"'\s]+?\.csv(?:\?[^"']*)?)"""), 1)
    local = F.regexp_extract_all(html, F.lit(r"""(?i)["'](/[^"']*?(?:csv|download)[^"']*)["']"""), 1)
    clean = F.transform(F.concat(whole, local), lambda x: F.replace(F.replace(x, F.lit("\\u0026"), F.lit("&")), F.lit("\\/"), F.lit("/")))
    site = F.regexp_extract("url", r"^(https?://[^/?#]+)", 1)
    full = F.array_distinct(F.transform(clean, lambda x: F.when(x.startswith("/"), F.concat(site, x)).otherwise(x)))
    return docs.select("url", F.posexplode(full).alias("pos", "csv_url"))


def absolute(base: str, link: str) -> str:
    return urljoin(base, link)


def page_json(docs: DataFrame, text: str = "text", patterns: Sequence[str] = PAGE_JSON) -> DataFrame:
    """``url, pos, json``: valid JSON objects that a page's scripts hold."""
    found = F.concat(*[F.regexp_extract_all(F.col(text), F.lit(p), 1) for p in patterns])
    out = docs.select("url", F.posexplode(found).alias("pos", "json"))
    return out.where(F.expr("try_parse_json(json)").isNotNull())


def walk_json(docs: DataFrame, column: str = "json", wanted: Sequence[str] = ()) -> DataFrame:
    """Every object in a JSON text in pre-order: ``url, pos, object``; of
    ``wanted`` keys only objects that have one of them. Deep nesting is walked
    without recursion."""
    keys = set(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for url, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    stack = [json.loads(body)] if body else []
                except (ValueError, RecursionError):
                    continue
                pos = 0
                while stack:
                    v = stack.pop()
                    if isinstance(v, dict):
                        if not keys or keys & v.keys():
                            out.append((url, pos, json.dumps(v, ensure_ascii=False)))
                        pos += 1
                        stack.extend(reversed(list(v.values())))
                    elif isinstance(v, list):
                        stack.extend(reversed(v))
            cols = list(zip(*out)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string())], names=["url", "pos", "object"])

    return map_arrow(docs.select("url", column), run, "url string, pos int, object string")


VIEW = (
    "struct<encryptedVideoId:string,videoId:string,atvExternalVideoId:string,name:string,viewCount:string,artists:array<struct<name:string>>,"
    "thumbnail:struct<thumbnails:array<struct<url:string,width:int,height:int>>>,chartEntryMetadata:struct<currentPosition:int,previousPosition:int>>"
)


def best_thumbnail(thumbs: Column) -> Column:
    """URL of the largest area, of equal ones the first."""
    sized = F.transform(thumbs, lambda t, i: F.struct((F.coalesce(t["width"], F.lit(0)) * F.coalesce(t["height"], F.lit(0))).alias("area"), (-i).alias("n"), t["url"].alias("url")))
    return F.coalesce(F.array_max(sized)["url"], F.lit(""))


def text_of_runs(runs: Column) -> Column:
    """Text of an array of runs."""
    return F.trim(F.array_join(F.transform(runs, lambda r: F.trim(r["text"])), " "))


def chart_views(docs: DataFrame, column: str = "json", limit: int | None = None) -> DataFrame:
    """Entries of chart JSON: all ``trackViews`` in the tree; each id once (the
    first), a missing position is the place, the first ``limit`` are kept and
    then sorted by rank."""
    objects = walk_json(docs, column, ["trackViews"])
    v = objects.select("url", "pos", F.from_json("object", f"trackViews array<{VIEW}>")["trackViews"].alias("views"))
    v = v.select("url", F.col("pos").alias("o"), F.posexplode("views").alias("n", "v"))
    item = F.coalesce(*[F.nullif(F.col(f"v.{c}"), F.lit("")) for c in ("encryptedVideoId", "videoId", "atvExternalVideoId")])
    v = v.withColumn("item_id", item).where("item_id is not null")
    v = v.withColumn("k", F.row_number().over(W.partitionBy("url", "item_id").orderBy("o", "n"))).where("k = 1")
    v = v.withColumn("pos", F.row_number().over(W.partitionBy("url").orderBy("o", "n")))
    if limit is not None:
        v = v.where(F.col("pos") <= limit)
    return v.select(
        "url", "pos", F.coalesce("v.chartEntryMetadata.currentPosition", "pos").alias("rank"), "item_id", F.col("v.name").alias("title"),
        F.array_join(F.transform("v.artists", lambda a: a["name"]), ", ").alias("artist"),
        F.col("v.chartEntryMetadata.previousPosition").alias("previous_rank"), best_thumbnail(F.col("v.thumbnail.thumbnails")).alias("artwork_url"),
        F.col("v.viewCount").try_cast("bigint").alias("views"),
    )


def chart_period(docs: DataFrame, column: str = "json") -> DataFrame:
    """``url, period_end``: the end date that chart JSON asks for, else the
    latest that it offers; of several the last seen."""
    objects = walk_json(docs, column, ["endDate", "latestEndDate"])
    o = objects.select("url", "pos", *[F.nullif(F.get_json_object("object", f"$.{k}"), F.lit("")).alias(k) for k in ("endDate", "latestEndDate")])
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("pos")))
    return o.groupBy("url").agg(F.coalesce(last("endDate"), last("latestEndDate")).alias("period_end"))


def balanced_object(text: str, start: int = 0) -> str | None:
    """The JSON object that opens at or after ``start``, braces in strings and
    escapes aside; null if it never closes."""
    depth, inside, at = 0, False, text.find("{", start)
    if at < 0:
        return None
    i = at
    for m in re.compile(r'\\.|["{}]', re.S).finditer(text, at):
        c, i = m.group(), m.end()
        if c == '"':
            inside = not inside
        elif not inside and c in "{}":
            depth += 1 if c == "{" else -1
            if depth == 0:
                return text[at:i]
    return None


def embedded_objects(docs: DataFrame, marker: str, text: str = "text") -> DataFrame:
    """``url, pos, json``: the balanced objects around each ``marker`` (a text
    inside of them, such as an item kind), malformed ones skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for url, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                body, at, pos, done = body or "", -1, 0, -1
                while (at := body.find(marker, at + 1)) >= 0:
                    if at < done:
                        continue
                    opened = body.rfind("{", 0, at)
                    found = balanced_object(body, opened) if opened >= 0 else None
                    if found:
                        try:
                            json.loads(found)
                        except ValueError:
                            continue
                        out.append((url, pos, found))
                        pos, done = pos + 1, opened + len(found)
            cols = list(zip(*out)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string())], names=["url", "pos", "json"])

    return map_arrow(docs.select("url", text), run, "url string, pos int, json string")


def script_json(text: Column, script_id: str) -> Column:
    """JSON of the script with an id or type."""
    return F.nullif(F.regexp_extract(text, rf"""(?s)<script[^>]*(?:id|type)=["']{re.escape(script_id)}["'][^>]*>(.*?)</script>""", 1), F.lit(""))


def first_path(column: Column, *paths: str) -> Column:
    """The first of several JSON paths that is filled."""
    return F.coalesce(*[F.nullif(F.get_json_object(column, p), F.lit("")) for p in paths])


def ld_tracks(docs: DataFrame, text: str = "text") -> DataFrame:
    """Entries of a page's linked data: ``track`` items with name, artist, URL."""
    j = docs.select("url", script_json(F.col(text), "application/ld+json").alias("j"))
    item = "struct<name:string,url:string,byArtist:struct<name:string>,audio:struct<name:string>>"
    rows = j.select("url", F.posexplode(F.from_json("j", f"track array<{item}>")["track"]).alias("pos", "t"))
    return rows.select("url", (F.col("pos") + 1).alias("rank"), F.coalesce("t.name", "t.audio.name").alias("title"), F.col("t.byArtist.name").alias("artist"), F.col("t.url").alias("link"))


def catalog_page(docs: DataFrame, column: str = "json") -> DataFrame:
    """Songs of one page of a catalog API: ``data`` items in order."""
    item = "struct<id:string,attributes:struct<name:string,artistName:string,albumName:string,url:string,artwork:struct<url:string>>>"
    d = docs.select("url", F.posexplode(F.from_json(column, f"data array<{item}>")["data"]).alias("pos", "d"))
    a = "d.attributes"
    return d.select("url", (F.col("pos") + 1).alias("rank"), F.col("d.id").alias("song_id"), F.col(f"{a}.name").alias("title"), F.col(f"{a}.artistName").alias("artist"), F.col(f"{a}.albumName").alias("album"), F.col(f"{a}.artwork.url").alias("artwork_url"))


def next_page(column: Column) -> Column:
    """Link to the next page of a catalog API."""
    return F.nullif(F.get_json_object(column, "$.next"), F.lit(""))


class _Rows(HTMLParser):
    """Cells of elements with wanted classes, hidden ones left out."""

    VOID = {"br", "img", "input", "hr", "meta", "link", "col", "source", "wbr"}

    def __init__(self, row: str, cells: dict[str, tuple[str, ...]], attributes: dict[str, tuple[str, ...]], hidden: tuple[str, ...]) -> None:
        super().__init__(convert_charrefs=True)
        self.row, self.cells, self.attributes, self.hidden = row, cells, attributes, hidden
        self.stack: list[tuple[str, list[str], bool]] = []
        self.rows: list[dict[str, str]] = []
        self.depth = 0

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        classes = a.get("class", "").split()
        if tag == self.row or self.row in classes:
            if not any(t == "ROW" for t, _, _ in self.stack):
                self.rows.append({})
                self.stack.append(("ROW", [], False)) if tag not in self.VOID else None
                self._take(a)
                self.stack.append((tag, [], False))
                return
        self._take(a)
        if tag not in self.VOID:
            fields = [f for f, names in self.cells.items() if set(names) & set(classes)]
            self.stack.append((tag, fields, bool(set(self.hidden) & set(classes)) or tag in ("script", "style")))

    def _take(self, a):
        if self.rows and self.stack:
            for f, names in self.attributes.items():
                for n in names:
                    if a.get(n) and f not in self.rows[-1]:
                        self.rows[-1][f] = a[n]

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                if self.stack and self.stack[-1][0] == "ROW":
                    self.stack.pop()
                return

    def handle_data(self, data):
        if self.rows and not any(h for _, _, h in self.stack):
            for _, fields, _ in self.stack:
                for f in fields:
                    self.rows[-1][f] = self.rows[-1].get(f, "") + data


def parse_html_rows(docs: DataFrame, row: str, cells: dict[str, Sequence[str]], attributes: dict[str, Sequence[str]], hidden: Sequence[str] = ("none",), text: str = "text") -> DataFrame:
    """``url, pos`` and one column per field of each row of HTML tables or
    lists. ``row`` is a tag or class; ``cells`` maps fields to classes whose
    text they are, ``attributes`` to attributes of the row or within it, the
    first that is filled. Elements with a ``hidden`` class are left out."""
    names = [*cells, *[a for a in attributes if a not in cells]]
    cell = {k: tuple(v) for k, v in cells.items()}
    attr = {k: tuple(v) for k, v in attributes.items()}
    gone = tuple(hidden)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for url, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                p = _Rows(row, cell, attr, gone)
                p.feed(body or "")
                p.close()
                for i, r in enumerate(p.rows):
                    out.append((url, i, *(" ".join(unescape(r[n]).split()) if n in r else None for n in names)))
            cols = list(zip(*out)) or [[] for _ in range(2 + len(names))]
            types = [pa.string(), pa.int32(), *[pa.string()] * len(names)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["url", "pos", *names])

    return map_arrow(docs.select("url", text), run, "url string, pos int, " + ", ".join(f"`{n}` string" for n in names))


def anchors(docs: DataFrame, text: str = "text", base: str = "/watch?v=") -> DataFrame:
    """``url, pos, item_id, title`` of links to videos in a page."""
    pat = rf"""(?is)<a[^>]*href=["']([^"']*{re.escape(base)}[^"']+)["'][^>]*>(.*?)</a>"""
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(pat), 1).alias("href"), F.regexp_extract_all(text, F.lit(pat), 2).alias("label"))
    rows = docs.select("url", F.posexplode(both).alias("pos", "x"))
    return rows.select("url", "pos", F.regexp_extract("x.href", r"[?&]v=([^&#]+)", 1).alias("item_id"), F.trim(F.regexp_replace("x.label", "<[^>]*>", "")).alias("title"))


def fallback_chain(strategies: Sequence[DataFrame]) -> DataFrame:
    """Rows of the first strategy that found any in each document, with its
    ``strategy_no``. All have the same columns, among them ``url``."""
    both = None
    for i, s in enumerate(strategies, 1):
        s = s.withColumn("strategy_no", F.lit(i))
        both = s if both is None else both.unionByName(s, allowMissingColumns=True)
    best = both.groupBy("url").agg(F.min("strategy_no").alias("strategy_no"))
    return both.join(best, ["url", "strategy_no"])
