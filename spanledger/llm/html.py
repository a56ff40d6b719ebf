"""Main text of web pages: block structure, and host-wide boilerplate by suffix arrays.

A page is cut into text blocks: `chrome` (menus, headers, footers, sidebars, notices,
adverts, forms, comments, by element and class), `main` (of an article or main
element) and `loose`. A wrapper's class rejects no article inside it, unless it
names comments or other articles. Every page gives two token streams: its article, and
what stands outside. The streams of all pages of a host are concatenated and their
suffixes sorted to a depth of `run` tokens, which tells each run of `run` tokens and
the distinct pages that hold it. Of a page then
- chrome goes;
- loose text goes where runs cover it that two pages of the host or more hold
  outside their articles; the unique runs stay, beside an article too;
- an article's block goes if runs cover `whole` of its tokens that `common` of the
  pages hold, and `common_pages` at least: a notice that the site prints into its
  articles. An article that such runs cover to a half or more is a copy, and stays, as does every
  line that fewer pages share.

A host is dealt into shards of about `shard_tokens` by page content; a shard is one
suffix array. Shards change no result: runs outside articles that several shards hold are told
to each of them, and common runs are counted over all pages of the host. A shard
reports the runs that half of `common` of its pages hold; what the others may hold at most
settles nearly every run, and the rest are counted again in every shard.
Copies of one page that would fill a shard go through it once.
Hosts are told apart by a hash of 64 bits.

Defined results: NULL or empty html has empty text and no characters; a NULL URL
is a host of its own (empty name); broken markup is read as far as it goes;
unclosed elements end with the page; equal pages count as one page for
repetition; repeated rows are extracted each; a page of any length is read
whole; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import html as references
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from .common import pieces, settle

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(script|style|noscript|textarea|template|svg|iframe|title|select|math|object|canvas|audio|video)\b[^>]*+>.*?(?:</\1\s*+>|\Z)"
    r"|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>",
    re.S | re.I,
)
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer",
    "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot",
    "th", "thead", "tr", "ul",
}
MAIN = {"article", "main"}
CHROME = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "head"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
#: Names of classes and ids, by their parts, of what is not the article.
NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "form", "gdpr", "masthead",
    "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pagination", "pager", "popup", "promo", "promoted", "related", "replies", "share", "sharing", "sidebar", "signup",
    "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
#: Wrappers of these names hold no article of the page, whatever elements are in them.
OTHERS = {"comment", "comments", "disqus", "promoted", "related", "replies", "sponsored"}
#: Words that turn a name into its absence or into a layout, as in with-sidebar or ad-free.
TURNED = {"with", "without", "has", "no", "non", "free", "less", "layout"}
#: Elements that a new element of the same kind ends.
ENDED_BY = {"p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}}
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden)(?![\w-])(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
FREE, NAMED, OUT = 0, 1, 2


def _of(tag: str, attributes: str, in_main: bool) -> tuple[int, bool]:
    """How an element rejects its text (FREE: not, NAMED: but for an article inside, OUT: wholly), and whether it is a main element."""
    main = tag in MAIN
    out = OUT if tag in CHROME or (tag == "header" and not in_main) else FREE
    if not attributes or tag in ("html", "body"):
        return out, main
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "role":
            main |= value == "main"
            out = OUT if value in ROLES else out
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            out = OUT
        elif name in ("class", "id"):
            for part in value.split():
                words = set(re.split(r"[^a-z]+", part))
                if not TURNED.isdisjoint(words):
                    continue
                if not OTHERS.isdisjoint(words):
                    out = OUT
                elif tag not in MAIN and not NAMES.isdisjoint(words):
                    out = max(out, NAMED)
    return out, main


def blocks(page: str) -> list[tuple[str, str]]:
    """(kind, text) in page order; kind is `main`, `chrome` or `loose`."""
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, int, bool]] = []
    text: list[str] = []
    chrome, main = FREE, False

    def flush() -> None:
        if text:
            words = references.unescape("".join(text)).split()
            text.clear()
            if words:
                out.append(("chrome" if chrome else "main" if main else "loose", " ".join(words)))

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            text.append(page[at:m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in BLOCK:
            flush()
        elif tag == "br":
            text.append(" ")
        if m[2]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    if any(x[1] != chrome or x[2] != main for x in stack[depth:]) or tag in BLOCK:
                        flush()
                    chrome, main = stack[depth][1], stack[depth][2]
                    del stack[depth:]
                    break
            continue
        while stack and tag in ENDED_BY.get(stack[-1][0], ()):
            chrome, main = stack[-1][1], stack[-1][2]
            stack.pop()
        if tag in VOID or m[4].endswith("/") and tag not in BLOCK:
            continue
        stack.append((tag, chrome, main))
        own, is_main = _of(tag, m[4], main or tag in MAIN)
        now_main = main or is_main
        # the outermost article takes the place that a wrapper's name had denied it
        now_chrome = max(FREE if is_main and not main and chrome == NAMED else chrome, own)
        if now_chrome != chrome or now_main != main:
            flush()
            chrome, main = now_chrome, now_main
    rest = page[at:]
    # a tag that never ends is no text
    cut = re.search(r"<[a-zA-Z/!][^>]*\Z", rest)
    text.append(rest[:cut.start()] if cut else rest)
    flush()
    return out


def packed(pages: DataFrame) -> DataFrame:
    """`pages` with `blocks` in place of `html`: a line for each block, its kind's first letter and its text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=9)
        for batch in batches:
            for piece in pieces(batch, "html"):
                lines = [pack.compress("\n".join(k[0] + t for k, t in blocks(page or "")).encode()) for page in piece.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([*piece.columns[1:], pa.array(lines, pa.binary())], [*piece.schema.names[1:], "blocks"])

    rest = [c for c in pages.columns if c != "html"]
    schema = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in rest)
    return pages.select("html", *rest).mapInArrow(run, f"{schema}, blocks binary")


def unpacked(lines: bytes) -> list[tuple[str, list[str]]]:
    """(kind's first letter, words) of each block."""
    text = zstandard.ZstdDecompressor().decompress(lines).decode()
    return [(line[0], line[1:].split(" ")) for line in text.split("\n")] if text else []


def two_streams(parts: list[tuple[str, list[str]]]) -> tuple[list[str], list[str]]:
    """The words outside the article, and the article's."""
    return [w for k, ws in parts if k != "m" for w in ws], [w for k, ws in parts if k == "m" for w in ws]


class Suffixes:
    """The suffixes of concatenated streams in order of their first `run` tokens, and the pages that hold each run."""

    def __init__(self, streams: list[list[str]], run: int):
        sizes = np.array([len(s) for s in streams], np.int64)
        self.run, self.bounds = run, np.concatenate([[0], np.cumsum(sizes)])
        self.words = [w for s in streams for w in s]
        self.stream = np.repeat(np.arange(len(streams)), sizes)
        left = np.repeat(self.bounds[1:], sizes) - np.arange(len(self.words))  # tokens up to the end of the stream
        self.full = left >= run
        ids: dict[str, int] = {}
        self.ids = np.array([ids.setdefault(w, len(ids)) for w in self.words], np.int64)
        self.names = np.array([xxhash.xxh64_intdigest(w.encode()) for w in ids], np.uint64)
        # ranks of the first `depth` tokens from those of two halves; beyond the end stands 0
        rank, depth = self.ids + 1, 1
        while depth < run and len(rank):
            step = min(depth, run - depth)
            after = np.zeros_like(rank)
            if len(rank) > step:
                after[:-step] = np.where(left[:-step] > step, rank[step:], 0)
            _, rank = np.unique(rank * (rank.max() + len(rank) + 2) + after, return_inverse=True)
            rank += 1
            depth += step
        self.rank = rank

    def pages(self, page_of: np.ndarray, of: np.ndarray | None = None) -> np.ndarray:
        """For each position with a whole run the number of different pages holding it in the streams marked in `of`, else 0."""
        taken = self.full if of is None else self.full & of[self.stream]
        page = page_of[self.stream]
        order = np.flatnonzero(taken)
        order = order[np.lexsort((page[order], self.rank[order]))]
        r, p = self.rank[order], page[order]
        new = np.ones(len(order), bool)
        new[1:] = (r[1:] != r[:-1]) | (p[1:] != p[:-1])
        counts = np.bincount(r[new], minlength=int(self.rank.max(initial=0)) + 1)
        return np.where(self.full, counts[self.rank], 0)

    def hashes(self, at: np.ndarray) -> np.ndarray:
        """64-bit hashes of the runs that start at the positions `at`."""
        h = np.zeros(len(at), np.uint64)
        for k in range(self.run):
            h = (h ^ self.names[self.ids[at + k]]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h.view(np.int64)

    def covered(self, starts: np.ndarray) -> np.ndarray:
        """Which tokens lie in a run that begins where `starts` holds."""
        at = np.flatnonzero(starts & self.full)
        edges = np.zeros(len(starts) + 1, np.int64)
        np.add.at(edges, at, 1)
        np.add.at(edges, at + self.run, -1)
        return np.cumsum(edges[:-1]) > 0


def suffix_runs(streams: list[list[str]], pages: list[int], run: int) -> tuple[list[str], list[int]]:
    """Distinct runs of `run` tokens in the concatenated streams, and the number of different `pages` that hold each."""
    found = Suffixes(streams, run)
    counts = found.pages(np.array(pages, np.int64))
    at = np.flatnonzero(found.full)
    at = at[np.unique(found.rank[at], return_index=True)[1]]
    return [" ".join(found.words[i:i + run]) for i in at], counts[at].tolist()


def main_text(parts: list[tuple[str, list[str]]], gone: np.ndarray, common: np.ndarray, whole: float) -> str:
    """The text of a page from its blocks; `gone` marks the words outside the article, `common` the article's."""
    out, at, inside = [], 0, 0
    copied = len(common) > 0 and common.mean() >= 0.5
    for kind, words in parts:
        n = len(words)
        if kind == "m":
            if copied or common[inside:inside + n].mean() < whole:
                out.append(" ".join(words))
            inside += n
        else:
            if kind == "l":
                kept = [w for w, g in zip(words, gone[at:at + n]) if not g]
                out += [" ".join(kept)] if kept else []
            at += n
    return "\n\n".join(out)


def extract(
    pages: DataFrame, run: int = 8, shard_tokens: int = 1 << 18, common: float = 0.8, common_pages: int = 8, whole: float = 0.9,
) -> DataFrame:
    """page_id, url, text and n_chars for every row of `pages` (page_id, url, html)."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url"), F.xxhash64(host).alias("site"), F.xxhash64("html").alias("content"),
        F.coalesce("html", F.lit("")).alias("html"),
    )
    full = 6 * shard_tokens  # bytes of a token and its markup, about
    contents = settle(rows.groupBy("site", "content").agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("html")).cast("bigint").alias("size")))
    # both tables hold a row for each `full` bytes of input at most
    large = settle(contents.groupBy("site").agg(F.ceil(F.sum("size") / full).cast("int").alias("shards"), F.count(F.lit(1)).alias("pages")).where("shards > 1"))
    shard = F.pmod(F.col("content"), F.coalesce("shards", F.lit(1))).cast("int").alias("shard")
    many = settle(contents.where(F.col("n") * F.col("size") > full).select("site", "content"))
    forms = rows.join(many, ["site", "content"], "left_semi").groupBy("site", "content").agg(F.first("html").alias("html"))
    once = forms.select(F.lit(None).cast("bigint").alias("page_id"), F.lit(None).cast("string").alias("url"), "site", "content", "html", F.lit(True).alias("form"))
    flow = rows.join(many, ["site", "content"], "left_anti").withColumn("form", F.lit(False)).unionByName(once)
    dealt = flow.join(large.drop("pages"), "site", "left").select(*flow.columns, "shards", shard)
    blocked = packed(dealt.select("page_id", "url", "site", "content", "form", "shards", "shard", "html"))
    of_shard = blocked.groupBy("site", "shard")

    def pages_of(group: pa.Table) -> tuple[list[list[tuple[str, list[str]]]], np.ndarray, Suffixes, np.ndarray, np.ndarray]:
        """The blocks of the different pages, the page of each row, the suffixes, and for each stream its page and whether it is outside."""
        names, first, row_of = np.unique(group.column("content").to_numpy(), return_index=True, return_inverse=True)
        lines = group.column("blocks")
        parts = [unpacked(lines[int(i)].as_py()) for i in first]
        found = Suffixes([s for p in parts for s in two_streams(p)], run)
        return parts, row_of, found, np.repeat(np.arange(len(names)), 2), np.tile([True, False], len(names))

    def told_by(group: pa.Table) -> pa.Table:
        """The runs outside articles, and those that enough pages hold for a report."""
        if group.column("shards")[0].as_py() is None:
            return reports.empty_table()
        parts, _, found, page, is_outside = pages_of(group)
        held = found.pages(page)
        outside = np.zeros(len(found.rank) + 2, bool)
        outside[found.rank[found.full & is_outside[found.stream]]] = True
        at = np.flatnonzero(found.full)
        at = at[np.unique(found.rank[at], return_index=True)[1]]
        least = max(1, math.ceil(common * len(parts) / 2))
        at = at[outside[found.rank[at]] | (held[at] >= least)]
        n = len(at)
        return pa.table([
            pa.array(np.full(n, group.column("site")[0].as_py())), pa.array(np.full(n, group.column("shard")[0].as_py(), np.int32)), pa.array(found.hashes(at)),
            pa.array(outside[found.rank[at]]), pa.array(held[at], mask=held[at] < least), pa.array(np.full(n, least - 1)),
        ], schema=reports)

    reports = pa.schema([("site", pa.int64()), ("shard", pa.int32()), ("run", pa.int64()), ("outside", pa.bool_()), ("held", pa.int64()), ("spare", pa.int64())])
    told = of_shard.applyInArrow(told_by, "site bigint, shard int, run bigint, outside boolean, held bigint, spare bigint")
    least = F.greatest(F.lit(1), F.ceil(F.lit(common) * F.count(F.lit(1)) / 2))
    shards = settle(contents.join(large, "site").groupBy("site", "pages", shard).agg((least - 1).cast("bigint").alias("spare")))
    sites = shards.groupBy("site").agg(F.greatest(F.lit(float(common_pages)), F.lit(common) * F.first("pages")).alias("needed"), F.sum("spare").alias("all_spare"))
    over = Window.partitionBy("site", "run")
    heard = told.withColumns({
        "lo": F.min(F.when(F.col("outside"), F.col("shard"))).over(over), "hi": F.max(F.when(F.col("outside"), F.col("shard"))).over(over),
        "known": F.sum("held").over(over), "spared": F.sum(F.when(F.col("held").isNotNull(), F.col("spare"))).over(over),
    }).where("known IS NOT NULL OR lo < hi").join(sites, "site")
    # a row for each run: known to be common, or possibly
    likely = heard.where("known + all_spare - spared >= needed").groupBy("site", "run").agg(F.first("needed").alias("needed"), F.first("known").alias("known"))

    def counted(group: pa.Table, asked: pa.Table) -> pa.Table:
        """The pages of the shard that hold the runs asked for."""
        if not asked.num_rows:
            return pa.schema([("site", pa.int64()), ("run", pa.int64()), ("held", pa.int64()), ("needed", pa.float64())]).empty_table()
        _, _, found, page, _ = pages_of(group)
        at = np.flatnonzero(found.full)
        at = at[np.unique(found.rank[at], return_index=True)[1]]
        held = dict(zip(found.hashes(at).tolist(), found.pages(page)[at].tolist()))
        return asked.select(["site", "run"]).append_column("held", pa.array([held.get(r, 0) for r in asked.column("run").to_pylist()], pa.int64())).append_column(
            "needed", asked.column("needed"))

    everywhere = shards.select("site", "shard")
    asked = likely.where("known < needed").join(everywhere, "site").select("site", "shard", "run", "needed")
    again = of_shard.cogroup(asked.groupBy("site", "shard")).applyInArrow(counted, "site bigint, run bigint, held bigint, needed double")
    frequent = likely.where("known >= needed").select("site", "run").unionByName(
        again.groupBy("site", "run").agg(F.sum("held").alias("held"), F.first("needed").alias("needed")).where("held >= needed").select("site", "run"))
    shared = heard.where("outside AND lo < hi").select("site", "shard", "run", F.lit(False).alias("frequent")).unionByName(
        frequent.join(everywhere, "site").select("site", "shard", "run", F.lit(True).alias("frequent")))

    def cut(group: pa.Table, elsewhere: pa.Table) -> pa.Table:
        parts, row_of, found, page, is_outside = pages_of(group)
        loose = found.pages(page, is_outside) >= 2
        if group.column("shards")[0].as_py() is None:
            frequent = found.pages(page) >= max(common_pages, common * len(parts))
        else:
            runs, is_frequent = elsewhere.column("run").to_numpy(), elsewhere.column("frequent").to_numpy()
            at = np.flatnonzero(found.full)
            hashes = found.hashes(at)
            frequent = np.zeros(len(found.full), bool)
            frequent[at] = np.isin(hashes, runs[is_frequent])
            loose[at] |= is_outside[found.stream[at]] & np.isin(hashes, runs[~is_frequent])
        loose, frequent = found.covered(loose), found.covered(frequent)
        b = found.bounds
        texts = [main_text(p, loose[b[2 * i]:b[2 * i + 1]], frequent[b[2 * i + 1]:b[2 * i + 2]], whole) for i, p in enumerate(parts)]
        return group.select(["page_id", "url", "site", "content", "form"]).append_column("text", pa.array(texts, pa.string()).take(pa.array(row_of)))

    cuts = of_shard.cogroup(shared.groupBy("site", "shard")).applyInArrow(cut, "page_id bigint, url string, site bigint, content bigint, form boolean, text string")
    texts = cuts.where("form").select("site", "content", "text")
    copies = rows.drop("html").join(many, ["site", "content"], "left_semi").join(texts, ["site", "content"])
    out = cuts.where("NOT form").select("page_id", "url", "text").unionByName(copies.select("page_id", "url", "text"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))
