"""Main text of pages by the container path that most pages of a host agree on.

First pass: every page scores its containers and votes for the generalised tag-class paths of
the best. The votes are summed per host. Second pass: each page is read again and the text below
the host's winning path is taken; a page without that path, or without a host, uses its own best.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..sources.staging import staged
from .common import small

# Element names and class words of HTML practice.
BLOCKS = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
DROPPED = set("aside button canvas datalist dialog embed footer form head iframe input label menu nav noscript object option select svg template textarea title".split())
RAW = set("script style xmp noembed noframes".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = set("article body div main section td blockquote".split())
WHOLE = set("html body article main".split())
NOISE = set("ad ads adsbox advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer footnotes gdpr legal login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted recommended related replies reply respond search share sharing sidebar sidenav signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split())
ROLES = set("alert banner complementary contentinfo dialog form menu navigation search".split())
GOOD = set("article articlebody body content entry main post story text".split())
ENDS_ITSELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)([^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*)>|<[a-zA-Z/][^<>]*\Z""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORDS = re.compile(r"[^a-z]+")
#: What a block counts for each further container around it; candidates a page votes for.
FADE, CANDIDATES = 0.7, 3
#: Blocks nested deeper have the path of the ancestor at this depth.
DEEPEST = 64


class Page:
    """Elements and text blocks of a page. An element: parent, tag, path and whether its text is left out."""

    def __init__(self, source: str):
        self.parent, self.tag, self.path, self.good = [-1], [""], [""], [False]
        self.blocks: list[tuple[int, str, int]] = []
        self._out, self._in_article, self._depth = [False], [False], [0]
        self._stack, self._text, self._links, self._anchor = [0], [], 0, 0
        self._read(source)

    def _read(self, source: str) -> None:
        at = 0
        while found := _TAG.search(source, at):
            self._add(source[at : found.start()])
            at = found.end()
            if not found[2]:
                continue
            tag = found[2].lower()
            if found[1]:
                self._close(tag)
            elif tag in RAW:
                end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(source, at)
                at = end.end() if end else len(source)
            else:
                self._open(tag, found[3])
        self._add(source[at:])
        self._flush()

    def _add(self, text: str) -> None:
        if text and not self._out[self._stack[-1]]:
            self._text.append(html.unescape(text))
            if self._anchor:
                self._links += len(text.strip())

    def _flush(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                self.blocks.append((self._stack[-1], text, min(self._links, len(text))))
        self._text, self._links = [], 0

    def _open(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS:
            self._flush()
            self._imply("p", {"td", "th", "li", "div", "section", "article", "main", "blockquote", "body", "table"}, {"p"})
            if tag in ENDS_ITSELF:
                self._imply(tag, STOPS[tag], ENDS_ITSELF[tag])
        if tag == "br":
            self._text.append(" ")
        if tag in VOID:
            return
        up = self._stack[-1]
        known = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if attributes.strip(" /") else {}
        names = f"{known.get('class', '')} {known.get('id', '')}".lower()
        words = set(_WORDS.split(names)) if names.strip() else set()
        inside = self._in_article[up] or tag in ("article", "main")
        out = self._out[up] or tag in DROPPED or (tag == "header" and not inside) or "hidden" in known or known.get("aria-hidden") == "true"
        if not out and known and tag not in WHOLE:
            out = bool(words & NOISE) or ("header" in words and not inside) or known.get("role", "").lower() in ROLES or bool(_HIDDEN.search(known.get("style", "")))
        node = len(self.parent)
        self.parent.append(up)
        self.tag.append(tag)
        self._depth.append(self._depth[up] + (tag in BLOCKS))
        if tag in BLOCKS and self._depth[node] <= DEEPEST:
            classes = sorted(re.sub(r"\d+", "#", c) for c in known.get("class", "").lower().split())
            self.path.append(f"{self.path[up]}/{tag}" + "".join(f".{c}" for c in classes))
        else:
            self.path.append(self.path[up])
        self.good.append(bool(words & GOOD) or known.get("role") == "main")
        self._out.append(out)
        self._in_article.append(inside)
        self._stack.append(node)
        self._anchor += tag == "a"

    def _pop(self, depth: int) -> None:
        for node in self._stack[depth:]:
            self._anchor -= self.tag[node] == "a"
        del self._stack[depth:]

    def _imply(self, tag: str, stops: set, ended: set) -> None:
        for depth in range(len(self._stack) - 1, 0, -1):
            name = self.tag[self._stack[depth]]
            if name in ended:
                self._pop(depth)
                return
            if name in stops:
                return

    def _close(self, tag: str) -> None:
        block = tag in BLOCKS
        for depth in range(len(self._stack) - 1, 0, -1):
            name = self.tag[self._stack[depth]]
            if name == tag:
                if block:
                    self._flush()
                self._pop(depth)
                return
            if not block and name in BLOCKS:
                return

    def scores(self) -> dict[int, float]:
        """Unlinked text of each container's blocks, fading with every container between."""
        total: dict[int, float] = {}
        for node, text, linked in self.blocks:
            weight, up = float(len(text) - linked), node
            while up > 0 and weight > 1e-3:
                if self.tag[up] in CONTAINERS:
                    total[up] = total.get(up, 0.0) + weight
                    weight *= FADE
                up = self.parent[up]
        for node in total:
            tag = self.tag[node]
            total[node] *= {"article": 1.6, "main": 1.4, "body": 0.8}.get(tag, 1.0) * (1.3 if self.good[node] else 1.0)
        return total

    def votes(self) -> list[tuple[str, float]]:
        """Paths of the best containers with their share of the best score."""
        by_path: dict[str, float] = {}
        for node, score in self.scores().items():
            by_path[self.path[node]] = by_path.get(self.path[node], 0.0) + score
        best = sorted(by_path.items(), key=lambda x: (-x[1], x[0]))[:CANDIDATES]
        return [(p, s / best[0][1]) for p, s in best if best[0][1] > 0]

    def below(self, path: str | None) -> list[str]:
        inside = [False] * len(self.parent)
        for node in range(1, len(inside)):
            inside[node] = inside[self.parent[node]] or (self.tag[node] in CONTAINERS and self.path[node] == path)
        return [text for node, text, _ in self.blocks if inside[node]]

    def main_text(self, path: str | None) -> str:
        """Blocks below the path; below the page's own best if there are none; else all that are left."""
        found = self.below(path) if path else []
        if not found:
            own = self.votes()
            found = self.below(own[0][0]) if own else []
        return "\n\n".join(found or [text for _, text, _ in self.blocks])


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1))


def host_paths(pages: DataFrame, url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(host, path): the path with most votes; on ties the first by name."""
    rows = pages.select(host_of(F.col(url_column)).alias("host"), F.col(html_column).alias("source")).where("host <> '' AND source IS NOT NULL")

    def run(batches):
        for batch in batches:
            votes: dict[tuple[str, str], float] = {}
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1)):
                for path, share in Page(source.as_py()).votes():
                    votes[host, path] = votes.get((host, path), 0.0) + share
            yield pa.RecordBatch.from_pydict({"host": [k[0] for k in votes], "path": [k[1] for k in votes], "votes": pa.array(votes.values(), pa.float64())}, schema)

    schema = pa.schema([("host", pa.string()), ("path", pa.string()), ("votes", pa.float64())])
    votes = rows.mapInArrow(run, "host string, path string, votes double").groupBy("host", "path").agg(F.round(F.sum("votes"), 6).alias("votes"))
    return votes.groupBy("host").agg(F.min(F.struct((-F.col("votes")).alias("v"), "path")).alias("best")).select("host", "best.path")


def main_texts(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """One row per page: id, url, text (blocks joined by a blank line, empty if none), n_chars.

    A missing page counts as empty. Pages with a missing or odd url have no host and use their own
    best container. Broken markup is read as far as it goes. Repeated rows are answered each; an
    empty table gives no rows; other columns are ignored. Every host's paths are few rows after
    the votes are summed per task, so a host of any size is no hot key; the pages themselves are
    only shuffled if the hosts are too many to broadcast.
    """
    paths = small(staged(host_paths(pages, url_column, html_column), "paths"))
    rows = pages.select(F.col(id_column).alias("id"), F.col(url_column).alias("address"), F.col(html_column).alias("source")).withColumn("host", host_of(F.col("address")))
    rows = rows.join(paths, "host", "left").select("id", "address", "source", "path")

    def run(batches):
        for batch in batches:
            texts = [Page(source.as_py() or "").main_text(path.as_py()) for source, path in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["id", "address", "text"])

    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, address string, text string")
    return out.select(F.col("id").alias(id_column), F.col("address").alias(url_column), "text", F.length("text").cast("long").alias("n_chars"))
