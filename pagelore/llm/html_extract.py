"""HTML main-text extraction with a suffix array per host.

1. Every page is parsed once into blocks (paragraphs, headings, list items, ...), each
   marked by where it stands: in an article, in a main part, in a content container,
   or loose; and whether it belongs to the page's chrome (menus, headers, footers,
   sidebars, notices, adverts, forms, reader comments).
2. The token streams of the loose and chrome blocks of a host's pages are concatenated
   and their suffixes sorted; suffixes of distinct pages that share their first
   ``RUN`` tokens mark repeated runs. Covered tokens are boilerplate.
3. A page's text is that of its explicit containers, of its main parts and articles or
   else of its content containers, without the host's furniture: blocks covered by runs
   that stand outside containers on ``SHARE`` of the host's pages (``LEAST_PAGES`` at
   least) and open blocks inside containers on as many pages, no more than half of them
   of one text.
   What repeats inside containers alone is not cut: articles quote and copy each other.
   What stands in one article, or in copies of it, is not cut either: menus name and
   quote articles. A page without a container keeps its loose blocks
   without chrome, but for the blocks that are wholly covered by runs that stand on
   ``SHARE`` of the host's pages (``LEAST_PAGES`` at least). A page whose tokens all equal
   another page's is a copy, not boilerplate, and keeps these blocks too.

A large host is split into parts of bounded size; runs that are unique within their part
are then compared across parts by the hash of their tokens, so no repetition is missed
and no host meets in one task. Of articles, only a hash of the first ``RUN`` tokens from
each block on leaves the page's task before the text itself.

Defined cases: null html is empty; an empty page, or one without main text, has the
empty text; a null or odd url belongs to the host ""; unclosed and stray tags are read as
browsers do, but an element of raw text that is never closed loses its tag alone (a script
or style also what stands before the next block); markup cut off at the end is dropped, a
lone ``<`` is text; repeated rows are distinct pages; an empty table gives no rows; very
long pages are read whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelore.llm._common import Words, give_back, materialize, mix, shingle_hashes, signed, table

#: Tokens of a repeated run, at least.
RUN = 6
#: Tokens of one part of a host.
PART_TOKENS = 400_000
#: A block goes if its runs stand on this share of the host's pages, and on so many.
SHARE, LEAST_PAGES = 0.25, 3
#: Runs on SHARE of their hosts' pages that are broadcast; more are joined by shuffles.
BROADCAST_ROWS = 1 << 17
#: Kinds of covered ranges: on two pages, on SHARE of the pages, on a copied page.
TWICE, WIDE, COPY = 0, 1, 2

# Element kinds of HTML.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp", "noframes", "svg", "math", "object", "audio", "video", "canvas", "head"}
#: Of these, elements that may close themselves.
FOREIGN = {"svg", "math"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3",
    "h4", "h5", "h6", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
CHROME = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "fieldset", "label", "datalist"}
CHROME_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
CHROME_WORDS = {
    "ad", "ads", "adslot", "adsense", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored", "promo", "promotion", "cookie", "cookies", "consent", "gdpr", "notice", "popup",
    "modal", "overlay", "newsletter", "subscribe", "signup", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "masthead", "topbar", "footer", "comment", "comments",
    "disqus", "replies", "respond", "share", "sharing", "social", "related", "recommended", "widget", "toolbar", "pagination", "pager", "login",
}
CONTENT_WORDS = {"content", "article", "post", "entry", "story", "maintext", "articlebody"}
#: Parts of a class name that say nothing about what it holds, at its end.
NEUTRAL_WORDS = {"area", "articles", "bar", "block", "bottom", "box", "button", "buttons", "column", "container", "inner", "items", "left", "links", "list", "message", "outer", "panel", "posts", "right", "section", "stories", "thread", "top", "unit", "wrap", "wrapper"}
#: Parts that name a layout around others.
AROUND_WORDS = {"container", "inner", "layout", "outer", "wrap", "wrapper"}
ADVERT_WORDS = {"ad", "ads", "advert", "advertisement", "sponsored", "promo", "promoted"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: An opening tag closes the nearest open element of the first set, unless one of the second stands between.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

#: A tag's attributes may hold ``>`` in quotes; where quotes don't end, the tag ends at the first ``>``.
_TOKEN = re.compile(r"""<!--|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)(?:((?:[^>=]+|=\s*"[^"]*"|=\s*'[^']*'|=)*+)>|([^>]*)>)|[^<]+|<""")
_BLOCK_TAG = re.compile("</?(?:" + "|".join(sorted(BLOCK)) + r")\b", re.I)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_SPLIT = re.compile(r"[^a-z0-9]+")

IN_ARTICLE, IN_MAIN, IN_CONTENT, LOOSE = 3, 2, 1, 0
#: Chrome by its class name alone, and by what the element is.
NAMED, CERTAIN = 1, 2


def _named_chrome(name: str) -> bool:
    """Does a class name say chrome? Its last telling part decides; a layout around content doesn't."""
    parts = [w for w in _SPLIT.split(name) if w]
    if not parts or parts[0] in ("has", "with", "no", "without"):
        return False
    if parts[0] in ADVERT_WORDS and len(parts) <= 2 and (len(parts) == 1 or parts[1] in NEUTRAL_WORDS | CONTENT_WORDS | CHROME_WORDS):
        return True
    if parts[-1] in AROUND_WORDS and CONTENT_WORDS & set(parts) | ({"main"} & set(parts)):
        return False
    while parts and parts[-1] in NEUTRAL_WORDS:
        parts.pop()
    return bool(parts) and parts[-1] in CHROME_WORDS


def _marks(tag: str, attributes: str) -> tuple[int, int, bool]:
    """(container level, chrome, header) of an element."""
    level = IN_ARTICLE if tag == "article" else IN_MAIN if tag == "main" else LOOSE
    chrome, header = CERTAIN if tag in CHROME else 0, tag == "header"
    if attributes and tag not in ("html", "body"):
        low = attributes.lower()
        if "=" in low:
            got = {m[1]: m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(low)}
            names = (got.get("class", "") + " " + got.get("id", "")).split()
            words = {w for name in names for w in _SPLIT.split(name) if w}
            role = got.get("role", "")
            if role in CHROME_ROLES or got.get("aria-hidden") == "true" or "display:none" in got.get("style", "").replace(" ", ""):
                chrome = CERTAIN
            elif not chrome and tag not in ("main", "article") and tag not in HEADINGS and any(map(_named_chrome, names)):
                chrome = NAMED
            header |= "header" in words
            if not chrome and not level:
                if role == "main" or "main" in names:
                    level = IN_MAIN
                elif role == "article" or got.get("itemprop") == "articlebody":
                    level = IN_ARTICLE
                elif words & CONTENT_WORDS:
                    level = IN_CONTENT
        if re.search(r"(?:^|\s)hidden(?:\s|=|$|/)", low):
            chrome = CERTAIN
    return level, chrome, header


def parse(page: str) -> list[tuple[int, bool, str]]:
    """Blocks of a page in order: (container level, chrome, text)."""
    out: list[tuple[int, int, str]] = []
    stack: list[tuple[str, int, int, bool]] = []  # tag, level so far, chrome so far, in a header
    held: list[str] = []
    level, chrome, header = LOOSE, 0, False
    closed: dict[str, bool] = {}  # is there an end tag of this raw element further on?

    def flush() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                hide = max(chrome, CERTAIN if header and (level == LOOSE or not any(s[0] in HEADINGS for s in stack)) else 0)
                out.append((level, hide, text))

    def cut(n: int) -> None:
        nonlocal level, chrome, header
        del stack[n:]
        level, chrome, header = stack[-1][1:] if stack else (LOOSE, 0, False)

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            first = page[m.start()]
            if first != "<":
                held.append(m[0])
            elif m[0] == "<!--":
                stop = page.find("-->", at)
                at = end if stop < 0 else stop + 3
            elif m[0] == "<":
                if re.match("/?[a-zA-Z]", page[at : at + 2]):
                    break  # a tag that is cut off
                held.append("&lt;")
            continue
        tag = tag.lower()
        block = tag in BLOCK
        if m[1]:
            if block:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    cut(i)
                    break
            continue
        attributes = m[3] if m[3] is not None else m[4]
        if tag in RAW:
            if tag in FOREIGN and attributes.endswith("/"):
                continue
            stop = re.compile(f"</{tag}[^>]*>", re.I).search(page, at) if closed.get(tag, True) else None
            closed[tag] = stop is not None
            if stop:
                at = stop.end()
            elif tag in ("script", "style"):
                following = _BLOCK_TAG.search(page, at)
                at = following.start() if following else end
            continue
        if tag == "br":
            held.append(" ")
            continue
        if block:
            flush()
            for i in range(len(stack) - 1, -1, -1):  # a block ends an open paragraph
                if stack[i][0] == "p":
                    cut(i)
                    break
                if stack[i][0] in BLOCK:
                    break
        if tag in CLOSES:
            own, stops = CLOSES[tag]
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in own:
                    cut(i)
                    break
                if stack[i][0] in stops:
                    break
        if tag in VOID:
            continue
        lv, ch, he = _marks(tag, attributes)
        if tag == "main" and chrome == NAMED:
            chrome = 0  # a name above it meant something else
        level, chrome, header = max(level, lv), max(chrome, ch), header or he
        stack.append((tag, level, chrome, header))
    flush()
    if not any(lv > LOOSE and not hide for lv, hide, _ in out):
        # no container is left: those that only a name hides count
        return [(lv, hide == CERTAIN or (hide == NAMED and lv < IN_MAIN), t) for lv, hide, t in out]
    return [(lv, hide > 0, t) for lv, hide, t in out]


def main_level(blocks: list[tuple[int, bool, str]]) -> int:
    """The weakest level that counts: main parts and articles together, or else content containers."""
    return min(IN_MAIN, max((lv for lv, chrome, _ in blocks if not chrome), default=LOOSE))


# ------------------------------------------------------------------ suffix array


def suffix_order(tokens: np.ndarray, page: np.ndarray, depth: int = RUN) -> np.ndarray:
    """Rank of every suffix by its first ``depth`` tokens (equal ranks: equal prefixes), by
    prefix doubling; -1 where the page ends before. ``page`` is the page of each token."""
    _, rank = np.unique(tokens, return_inverse=True)
    n, have = len(tokens), 1
    rank = rank.astype(np.int64)
    while have < depth and n:
        step = min(have, depth - have)
        ahead = np.full(n, -1, np.int64)
        if step < n:
            same = page[step:] == page[: n - step]
            ahead[: n - step][same] = rank[step:][same]
        pair = np.where((ahead >= 0) & (rank >= 0), rank * (n + 1) + ahead, -1)
        values, rank = np.unique(pair, return_inverse=True)
        rank = rank.astype(np.int64) - (len(values) > 0 and values[0] == -1)
        have += step
    return rank


def repeated(tokens: np.ndarray, page: np.ndarray, depth: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """(starts of runs of ``depth`` tokens that stand on two distinct pages, starts of the others)."""
    rank = suffix_order(tokens, page, depth)
    order = np.argsort(rank, kind="stable")
    order = order[rank[order] >= 0]
    if not len(order):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.flatnonzero(np.diff(rank[order], prepend=-2))
    pages = page[order]
    several = np.minimum.reduceat(pages, edge) != np.maximum.reduceat(pages, edge)
    mark = np.repeat(several, np.diff(np.append(edge, len(order))))
    return np.sort(order[mark]), np.sort(order[~mark])


def pages_of_runs(tokens: np.ndarray, page: np.ndarray, depth: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """(for every token the number of pages with the run that starts there, 0 where none does;
    whether it is the first of its run)."""
    rank = suffix_order(tokens, page, depth)
    number, first = np.zeros(len(tokens), np.int64), np.zeros(len(tokens), bool)
    order = np.lexsort((page, rank))
    order = order[rank[order] >= 0]
    if len(order):
        edge = np.diff(rank[order], prepend=-2) != 0
        run = np.cumsum(edge) - 1
        number[order] = np.bincount(run, edge | (np.diff(page[order], prepend=-1) != 0)).astype(np.int64)[run]
        first[order[edge]] = True
    return number, first


# ------------------------------------------------------------------ Spark


def _tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes of all texts, number of tokens of each); tokens are separated by spaces."""
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    w = Words(data, np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))
    return w.hash, np.diff(w.first)


def _blocks(page: str | None) -> tuple[int, list, list[tuple[bool, str]]]:
    """(container level, blocks, loose and chrome blocks) of a page."""
    blocks = parse(page or "")
    return main_level(blocks), blocks, [(chrome, t) for k, chrome, t in blocks if k == LOOSE or chrome]


def _contained(level: int, blocks: list[tuple[int, bool, str]]) -> list[str]:
    """The texts of a page's containers, block by block."""
    return [t for k, chrome, t in blocks if k >= level and not chrome]


def _openings(texts: list[str]) -> list[str]:
    """The first RUN tokens from each block on ("" where fewer are left)."""
    out, after = [], []
    for t in reversed(texts):
        after = (t.split(" ", RUN)[:RUN] + after)[:RUN]
        out.append(" ".join(after) if len(after) == RUN else "")
    return out[::-1]


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (host, row, html) to host, row, the tokens outside containers, and the hash of
    the run that starts at each block inside them (null where fewer tokens are left)."""
    for b in batches:
        tokens, openings = [], []
        for page in b.column(2).to_pylist():
            lv, blocks, loose = _blocks(page)
            tokens.append(signed(_tokens([t for _, t in loose])[0]))
            openings.append(_openings(_contained(lv, blocks)) if lv else [])
        runs = iter(signed(shingle_hashes(mix(_tokens([t for o in openings for t in o])[0]), RUN)[::RUN]).tolist())
        starts = [[next(runs) if t else None for t in o] for o in openings]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(tokens, pa.list_(pa.int64())), pa.array(starts, pa.list_(pa.int64()))], names=["host", "row", "tokens", "starts"])


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (page_id, url, row, html) to the text of the page's containers (null without one), else its loose blocks."""
    for b in batches:
        cols: dict[str, list] = {k: [] for k in ("text", "loose", "hidden", "n")}
        for page in b.column(3).to_pylist():
            lv, blocks, loose = _blocks(page)
            cols["text"].append("\n".join(_contained(lv, blocks)) if lv else None)
            cols["n"].append(sum(len(t.split(" ")) for _, t in loose))
            cols["loose"].append([] if lv else [t for _, t in loose])
            cols["hidden"].append([] if lv else [c for c, _ in loose])
        types = {"text": pa.string(), "loose": pa.list_(pa.string()), "hidden": pa.list_(pa.bool_()), "n": pa.int32()}
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *(pa.array(cols[k], types[k]) for k in types)], names=["page_id", "url", "row", *types])
    give_back()


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (host, part, parts, row, tokens, least), those of one part together: covered ranges
    of each page, and by hash the runs on ``least`` pages (once) or, for a host of several parts,
    all runs, with their pages here (once a run)."""
    key, rows, streams, parts, least = None, [], [], 1, 0

    def done() -> pa.RecordBatch:
        size = [len(s) for s in streams]
        tokens = np.concatenate(streams)
        page = np.repeat(np.arange(len(rows)), size)
        base = np.concatenate([[0], np.cumsum(size)])
        twice, once = repeated(tokens, page)
        number, first = pages_of_runs(tokens, page)
        out_row, out_from, out_to, out_gram, out_pages, out_kind = [], [], [], [], [], []
        for kind, at in ((TWICE, twice), (WIDE, np.flatnonzero(number >= least) if parts == 1 else twice[:0])):
            if len(at):
                gap = np.flatnonzero((np.diff(at) > RUN) | (np.diff(page[at]) > 0)) + 1
                lo, hi = at[np.concatenate([[0], gap])], at[np.concatenate([gap - 1, [len(at) - 1]])] + RUN
                p = page[lo]
                out_row += [rows[i] for i in p]
                out_from += (lo - base[p]).tolist()
                out_to += (hi - base[p]).tolist()
                out_gram += [None] * len(lo)
                out_pages += [0] * len(lo)
                out_kind += [kind] * len(lo)
        # what is unique here may stand in another part; runs that repeat here are offered too, for its sake
        every = np.sort(np.concatenate([once, twice])) if parts > 1 else np.flatnonzero(first & (number >= least))
        if len(every):
            grams, p = signed(shingle_hashes(mix(tokens.view(np.uint64)), RUN))[every], page[every]
            out_row += [rows[i] for i in p]
            out_from += (every - base[p]).tolist()
            out_to += (every - base[p] + RUN).tolist()
            out_gram += grams.tolist()
            out_pages += np.where(first, number, 0)[every].tolist()
            out_kind += [TWICE] * len(every)
        return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(out_row), pa.string()), pa.array([key[1]] * len(out_row), pa.int64()), pa.array(out_row, pa.int64()), pa.array(out_from, pa.int64()), pa.array(out_to, pa.int64()), pa.array(out_gram, pa.int64()), pa.array(out_pages, pa.int64()), pa.array(out_kind, pa.int32()), pa.array([least] * len(out_row), pa.int64())], names=["host", "part", "row", "lo", "hi", "gram", "pages", "kind", "least"])

    for b in batches:
        lists = b.column(4)
        values, offsets = np.asarray(lists.values), np.asarray(lists.offsets)
        for i, (host, part, n, row, enough) in enumerate(zip(*(b.column(c).to_pylist() for c in (0, 1, 2, 3, 5)), strict=True)):
            if (host, part) != key:
                if rows:
                    yield done()
                key, rows, streams, parts, least = (host, part), [], [], n, enough
            rows.append(row)
            streams.append(values[offsets[i] : offsets[i + 1]].copy())
    if rows:
        yield done()


def without_furniture(text: str, at: list[int], runs: np.ndarray) -> tuple[str, int]:
    """(the text without the blocks that are wholly covered by ``runs`` from the start of a
    block of ``at`` on, number of tokens that went)."""
    blocks = text.split("\n")
    tokens, size = _tokens(blocks)
    base = np.concatenate([[0], np.cumsum(size)])
    other = np.flatnonzero(~np.isin(signed(shingle_hashes(mix(tokens), RUN)), runs))
    other = np.append(other, max(0, len(tokens) - RUN + 1))
    gone = np.zeros(len(tokens), bool)
    for i in at:
        end = min(other[np.searchsorted(other, base[i])], base[i + 1])
        if end > base[i]:
            gone[base[i] : end + RUN - 1] = True
    whole = [gone[base[i] : base[i + 1]].all() for i in range(len(blocks))]
    return "\n".join(t for t, w in zip(blocks, whole, strict=True) if not w), int(size[whole].sum())


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, lost = [], []
        for text, loose, hidden, n, spans, at, runs in zip(*(b.column(c).to_pylist() for c in range(2, 9)), strict=True):
            gone, wide, copy = np.zeros(n or 0, bool), np.zeros(n or 0, bool), False
            for x in spans or ():
                if x["kind"] == COPY:
                    copy = True
                else:
                    (gone if x["kind"] == TWICE else wide)[x["lo"] : x["hi"]] = True
            lost.append(int(gone.sum()))
            if text is None:
                at, kept = 0, []
                for t, chrome in zip(loose, hidden, strict=True):
                    size = len(t.split(" "))
                    if not chrome and (copy or not wide[at : at + size].all()):
                        kept.append(t)
                    at += size
                text = "\n".join(kept)
            elif at:
                text, tokens = without_furniture(text, at, np.array(runs, np.int64))
                lost[-1] += tokens
            texts.append(text)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(lost, pa.int64())], names=["page_id", "url", "text", "n_chars", "boilerplate_tokens"])


def furniture(streams: DataFrame, wide: DataFrame, sizes: DataFrame) -> DataFrame:
    """(row, at, runs): the blocks inside containers that open with a run of ``wide`` (host, gram)
    which opens such blocks on enough pages of the host, and all runs of the host.

    Copies of one article are no such pages: beside the run, ``LEAST_PAGES`` different first (or
    last) blocks must stand there, none of them on more than half of the pages."""
    wide = materialize(wide, "wide")
    few = F.broadcast if wide.count() <= BROADCAST_ROWS else lambda df: df
    opened = streams.select("host", "row", F.posexplode("starts").alias("at", "gram")).where("gram is not null").join(few(wide), ["host", "gram"])
    opened = opened.groupBy("host", "row").agg(F.collect_set("at").alias("at")).join(streams.groupBy("row").agg(F.any_value("starts").alias("starts")), "row")
    beside = opened.withColumn("beside", F.expr("filter(starts, (x, i) -> x is not null and not array_contains(at, i))"))
    ends = F.expr("array(struct(0 as side, coalesce(get(beside, 0), 0) as text), struct(1 as side, coalesce(get(beside, size(beside) - 1), 0) as text))")
    beside = beside.select("host", "row", ends.alias("ends"), F.explode(F.expr("transform(at, i -> struct(i as at, starts[i] as gram))")).alias("x")).select("host", "row", "ends", "x.at", "x.gram")
    texts = beside.select("host", "gram", "row", F.inline("ends")).groupBy("host", "gram", "side", "text").agg(F.countDistinct("row").alias("pages"))
    often = texts.groupBy("host", "gram", "side").agg(F.sum("pages").alias("pages"), F.max("pages").alias("most"), F.count("*").alias("texts")).join(sizes, "host")
    often = often.where(f"pages >= least and 2 * most <= pages and texts >= {LEAST_PAGES}").select("host", "gram").distinct()
    found = beside.join(often, ["host", "gram"]).groupBy("host", "row").agg(F.collect_set("at").alias("at"))
    return found.join(few(wide.groupBy("host").agg(F.collect_list("gram").alias("runs"))), "host").select("row", "at", "runs")


def extract(pages: DataFrame, part_tokens: int = PART_TOKENS) -> DataFrame:
    """page_id, url, text, n_chars and boilerplate_tokens (repeated tokens outside containers, and
    those of the furniture inside) of every page."""
    host = F.coalesce(F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit(""))
    pages = pages.select("page_id", "url", "html", host.alias("host"), F.xxhash64("page_id", "url", "html").alias("row"))
    # parsing twice is cheaper than keeping the texts: only tokens outside containers are stored and meet by host
    streams = materialize(pages.select("host", "row", "html").mapInArrow(_streams, "host string, row long, tokens array<long>, starts array<long>"), "streams")
    sizes = materialize(streams.groupBy("host").agg(F.greatest(F.lit(1), F.ceil(F.sum(F.size("tokens")) / part_tokens)).cast("long").alias("parts"), F.greatest(F.lit(LEAST_PAGES), F.ceil(F.count(F.when(F.size("tokens") > 0, 1)) * SHARE)).cast("long").alias("least")), "hosts")
    dealt = streams.join(sizes, "host").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")))
    runs = dealt.select("host", "part", "parts", "row", "tokens", "least").repartition("host", "part").sortWithinPartitions("host", "part", "row")
    runs = materialize(runs.mapInArrow(_runs, "host string, part long, row long, lo long, hi long, gram long, pages long, kind int, least long"), "runs")
    offered = runs.where("gram is not null")
    across = offered.groupBy("host", "gram").agg(F.min("part").alias("a"), F.max("part").alias("z"), F.sum("pages").alias("on"), F.max("least").alias("enough"))
    across = across.select("host", "gram", F.array_compact(F.array(F.expr(f"if(a < z, {TWICE}, null)"), F.expr(f"if(on >= enough, {WIDE}, null)"))).alias("kinds")).where("size(kinds) > 0")
    met = offered.join(across, ["host", "gram"]).select("row", "lo", "hi", F.explode("kinds").alias("kind"))
    whole = streams.where("size(tokens) > 0").select("host", F.xxhash64("tokens").alias("whole"), "row")
    copies = whole.groupBy("host", "whole").agg(F.count("*").alias("c")).where("c > 1").select("host", "whole")
    copies = whole.join(copies, ["host", "whole"]).select("row", F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi"), F.lit(COPY).alias("kind")).distinct()
    covered = runs.where("gram is null").select("row", "lo", "hi", "kind").union(met).union(copies)
    covered = covered.groupBy("row").agg(F.collect_list(F.struct("lo", "hi", "kind")).alias("spans"))
    inside = furniture(streams, across.where(F.array_contains("kinds", WIDE)).select("host", "gram"), sizes)
    parsed = pages.select("page_id", "url", "row", "html").mapInArrow(_parsed, "page_id long, url string, row long, text string, loose array<string>, hidden array<boolean>, n int")
    full = parsed.join(covered, "row", "left").join(inside, "row", "left").select("page_id", "url", "text", "loose", "hidden", "n", "spans", "at", "runs")
    return full.mapInArrow(_finish, "page_id long, url string, text string, n_chars long, boilerplate_tokens long")


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
