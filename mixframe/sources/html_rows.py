"""Tracklist rows of crawled pages.

A tag stream per page comes from the standard library's parser (there is no HTML function in
Spark); everything after it - the site rules, the size rules, the text - is native columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import squeeze

# Blocks this short are no tracklist; tables shorter than MIN_TABLE never are.
SHORT_BLOCK = 8
MIN_TABLE = 3
# A version in brackets at the end: what a title has and a name does not.
VERSION = r"(?i)\([^()]*\b(?:re)?mix(?:ed)?\b[^()]*\)$|\([^()]*\b(?:edit|dub|version|live|vip|bootleg|instrumental)\)$"
CELL_SCHEMA = "page_id BIGINT, _host STRING, block INT, kind STRING, row INT, cell INT, class STRING, text STRING"


LEAVES = ("td", "th", "span", "div", "abbr", "h3", "h4")
BLOCKS = {"ul": "list", "ol": "list", "table": "table", "p": "p"}


class _Cells(HTMLParser):
    """Leaf texts with their block (list, table or paragraph), row and cell number.

    Open blocks and open leaves are stacks: a nested list does not end the table around it, and a link
    inside a cell does not change the cell's class.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.buf, self.skip, self.n = [], [], 0, 0
        self.blocks: list[list] = []  # tag, number, kind, row, cell
        self.leaves: list[tuple[str, str]] = []  # tag, class

    def _flush(self):
        text = "".join(self.buf).strip()
        if text and self.blocks:
            _, number, kind, row, cell = self.blocks[-1]
            cls = next((c for _, c in reversed(self.leaves) if c), "")
            self.out.append((number, kind, row, cell, cls, text))
            self.blocks[-1][4] += 1
        self.buf = []

    def _close(self, stack, tag):
        """Close ``tag`` and what was left open inside it; a stray end tag closes nothing."""
        at = max((i for i, entry in enumerate(stack) if entry[0] == tag), default=None)
        if at is not None:
            del stack[at:]

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        elif tag in BLOCKS:
            self._flush()
            if tag == "p":
                self._close(self.blocks, "p")
            self.n += 1
            self.blocks.append([tag, self.n, BLOCKS[tag], 0, 0])
        elif tag in ("li", "tr") or (tag == "br" and self.blocks and self.blocks[-1][2] == "p"):
            self._flush()
            self.leaves.clear()
            if self.blocks:
                self.blocks[-1][3] += 1
                self.blocks[-1][4] = 0
        if tag in LEAVES or tag == "li":
            self._flush()
            self.leaves.append((tag, dict(attrs).get("class") or ""))

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag in LEAVES or tag in ("li", "tr") or tag in BLOCKS:
            self._flush()
            self._close(self.blocks if tag in BLOCKS else self.leaves, tag)

    def handle_data(self, data):
        if not self.skip:
            self.buf.append(data)

    def close(self):
        super().close()
        self._flush()


def _cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for page_id, host, html in zip(pdf.page_id, pdf._host, pdf.html):
            parser = _Cells()
            parser.feed(html or "")
            parser.close()
            rows.extend((page_id, host, *r) for r in parser.out)
        yield pd.DataFrame(rows, columns=["page_id", "_host", "block", "kind", "row", "cell", "class", "text"])


def _host():
    """The host of a page; '' where its address is null or has none, so that rules for every page reach it."""
    return F.coalesce(F.regexp_extract("url", "://([^/]+)", 1), F.lit("")).alias("_host")


def html_cells(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", _host(), "html").mapInPandas(_cells, CELL_SCHEMA)


def _ordered_columns(rows: DataFrame) -> DataFrame:
    """``left`` and ``right`` as artist and title.

    The rows of a block vote: a version in brackets marks a title.  Without a majority the column that
    repeats itself more is the artist, as one act plays several times; else the left one is.
    """
    block = Window.partitionBy("page_id", "block")
    version = lambda c: F.coalesce(F.col(c).rlike(VERSION), F.lit(False)).cast("int")
    for c in ("left", "right"):  # numbered in the order of their texts, the last number is how many there are
        rows = rows.withColumn(f"_{c}", F.when(F.col(c).isNotNull(), F.dense_rank().over(block.orderBy(F.col(c).asc_nulls_last()))))
    rows = rows.select("*", F.sum(version("left") - version("right")).over(block).alias("marked"),
                       (F.coalesce(F.max("_left").over(block), F.lit(0)) - F.coalesce(F.max("_right").over(block), F.lit(0))).alias("varied"))
    rows = rows.withColumn("swapped", (F.col("marked") > 0) | ((F.col("marked") == 0) & (F.col("varied") > 0)))
    first, second = F.when(F.col("swapped"), F.col("right")).otherwise(F.col("left")), F.when(F.col("swapped"), F.col("left")).otherwise(F.col("right"))
    return rows.withColumns({"artist": F.coalesce("artist", first), "title": F.coalesce("title", second)}).drop(
        "left", "right", "_left", "_right", "marked", "varied", "swapped")


def scan_html_rows(pages: DataFrame, site_spec: DataFrame) -> DataFrame:
    """``(page_id, block, pos, cue, artist, title, label, text)`` of the tracklist blocks.

    ``site_spec(host, kind, role, class_pattern, cell)`` names the cell of each role by its class
    or, where that is NULL, by its number; ``host`` '*' is for every page.  The roles ``left`` and ``right``
    are artist and title in an order that differs from block to block: each block decides by its own rows.
    """
    # site rules are written by hand, a few for each site and kind, so they go to the cells; a block is part of one
    # page, so all that follows needs the one exchange that brings the cells of a block together
    listed = F.collect_list(F.struct("role", "class_pattern", F.col("cell").alias("at")))
    own = site_spec.where("host != '*'").groupBy(F.col("host").alias("_host"), "kind").agg(listed.alias("_own"))
    common = site_spec.where("host = '*'").groupBy("kind").agg(listed.alias("_common"))
    hit = html_cells(pages).join(F.broadcast(common), "kind", "left").join(F.broadcast(own), ["_host", "kind"], "left")
    rules = F.when(F.col("_own").isNull(), F.col("_common")).when(F.col("_common").isNull(), F.col("_own")).otherwise(F.concat("_own", "_common"))
    hit = hit.select("page_id", "block", "kind", "row", "cell", "class", "text", F.inline(rules))
    hit = hit.where(F.when(F.col("class_pattern").isNotNull(), F.expr("class rlike class_pattern")).otherwise(F.col("cell") == F.col("at")))
    hit = hit.select("page_id", "block", "kind", "row", "cell", "text", "role").repartition("page_id", "block")
    value = squeeze(F.translate("text", " ", " "))
    pick = lambda r: F.min_by(value, F.when(F.col("role") == r, F.col("cell")))
    rows = hit.groupBy("page_id", "block", "kind", "row").agg(*[pick(r).alias(r) for r in ("cue", "artist", "title", "label", "left", "right")])
    rows = _ordered_columns(rows)
    rows = rows.where(F.coalesce("artist", "title").isNotNull())
    block = Window.partitionBy("page_id", "block")
    rows = rows.withColumn("n_rows", F.count(F.lit(1)).over(block)).where(F.col("n_rows") > SHORT_BLOCK)
    rows = rows.where((F.col("kind") != "table") | (F.col("n_rows") >= MIN_TABLE))
    missing = F.when(F.col("kind") == "table", F.lit("?"))
    rows = rows.withColumn("artist", F.coalesce("artist", missing)).withColumn("title", F.coalesce("title", missing))
    rows = rows.withColumn("artist", F.regexp_replace("artist", r"(?i)^(.+) \(.+(?:mix|remix|version|edit|femix).*\)$", "$1"))
    rows = rows.withColumn("pos", F.row_number().over(block.orderBy("row")))
    return rows.select("page_id", "block", "pos", "cue", "artist", "title", "label", F.concat_ws(" - ", "artist", "title").alias("text"))
