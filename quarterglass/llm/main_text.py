"""Main text of HTML pages: blocks by markup, and repeated runs of a host's pages by a suffix order of their tokens.

A page is cut into blocks of text, each in a zone: inside an article or main element, inside a part that is not main
text by its element or its name (those are dropped), or open. A host's pages are dealt out in cells of bounded length, one
cell for most hosts. A cell's token streams are concatenated and their suffixes ordered by doubling, which gives the runs
that stand on several distinct pages. What is covered by such runs is dropped from open blocks, and from articles only
where most pages of the host have it, as a notice put into every article would be.

Cells of one host are counted together, by hashes of runs, so that what is covered does not depend on them. Runs of open
blocks are handed on with their pages in the cell. Of articles, a run on half of the host's pages is on half of the pages
of some cell: only runs that are go on, to be counted in the host's other cells. Texts are moved once, to their cells.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterglass.llm.common import settle
from quarterglass.llm.decontaminate import hashed, shingles, word_hashes

DROPPED = frozenset(
    "nav footer aside form script style noscript template iframe object svg math canvas button select option textarea label dialog menu head title audio video figure".split()
)
#: Main text inside an article: figures with captions, tables and listings in them, and words of running text.
KEPT = frozenset(("figure", "math", "label", "button"))
#: Those of them that stand inside a line.
INLINE = frozenset(("math", "label", "button"))
#: Elements whose content is no markup.
RAW = frozenset("script style noscript template iframe textarea title svg math".split())
MAIN = frozenset(("article", "main"))
BLOCKS = frozenset(
    "p div section article main header h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th thead tbody tfoot caption blockquote pre address figcaption hr details summary center body html fieldset"
    .split()
) | DROPPED
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Class, id and role names of what is not main text. A name has to be one of these as a whole,
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies cookie-banner cookie-bar cookie-consent cookie-notice consent gdpr notice notices"
    " alert menu navbar nav navigation breadcrumb breadcrumbs sidebar aside footer comment comments disqus reply replies newsletter subscribe subscription signup login popup modal"
    " overlay contentinfo complementary masthead".split()
)
#: or begin with one of these and a hyphen or underscore,
FIRST = frozenset("ad ads advert nav navbar menu sidebar footer breadcrumb breadcrumbs comment comments cookie".split())
#: or be one of the names behind a word for a place.
PLACES = frozenset("site page main primary secondary top bottom left right global".split())
#: Second parts that make another word or a state of the first.
OTHER = frozenset("hoc hominem lib open opened closed collapsed expanded fixed visible free enabled active".split())
_START = re.compile(r"<(?:(!--)|([!?])|(/?)([A-Za-z][^\s/>]*))")
_STOP = re.compile("[>\"']")
_NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_SPACE = re.compile(r"\s+")


class Tags:
    """Tags of a page one after the other. Every character is read a bounded number of times, however odd the page is."""

    def __init__(self, page: str):
        self.page, self.quotes = page, True

    def after(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """(start, end, closing, name, attributes) of the next tag from ``at`` on; the name is empty for comments and the like."""
        found = _START.search(self.page, at)
        if not found:
            return None
        if found[1]:
            end = self.page.find("-->", found.end())
            return found.start(), len(self.page) if end < 0 else end + 3, False, "", ""
        end = self._end(found.end(), found[2] is None)
        if end < 0:  # no tag ends behind here
            return None
        if found[2]:
            return found.start(), end, False, "", ""
        return found.start(), end, bool(found[3]), found[4].lower(), self.page[found.end() : end - 1]

    def _end(self, at: int, quoted: bool) -> int:
        """Behind the tag's closing sign, which in quotes is none. Once a quote stays open to the page's end, none counts."""
        place = at
        while quoted and self.quotes:
            stop = _STOP.search(self.page, place)
            if stop and stop[0] == ">":
                return stop.end()
            close = self.page.find(stop[0], stop.end()) if stop else -1
            if close < 0:
                self.quotes = False
                break
            place = close + 1
        return self.page.find(">", at) + 1 or -1


def _is_named(names: str) -> bool:
    for name in names.lower().split():
        first, _, rest = name.replace("_", "-").partition("-")
        if name in NAMES or rest and (first in FIRST and rest not in OTHER or first in PLACES and rest in NAMES):
            return True
    return False


def _is_dropped(tag: str, rest: str, in_main: bool, in_article: bool) -> bool:
    if tag in DROPPED and not (in_main and tag in KEPT) or tag == "header" and not in_main:
        return True
    if rest and (tag not in ("html", "body", "article", "main") or tag == "article" and in_article):
        return any(_is_named(m[1] or m[2] or m[3] or "") for m in _NAMED.finditer(rest)) or bool(_HIDDEN.search(rest))
    return False


def _closed(page: str) -> set[int]:
    """Places of the elements that are closed before their body is."""
    out: set[int] = set()
    is_open: dict[str, list[int]] = {}
    tags, at = Tags(page), 0
    while found := tags.after(at):
        start, at, closing, tag, rest = found
        if not tag or tag in VOID or not closing and rest.endswith("/"):
            continue
        if closing:
            if tag in ("body", "html"):
                is_open.clear()
            elif is_open.get(tag):
                out.add(is_open[tag].pop())
        elif tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        else:
            is_open.setdefault(tag, []).append(start)
    return out


def blocks_of(page: str) -> list[tuple[str, bool]]:
    """(text, inside an article) of each block that is not dropped, in page order."""
    out: list[tuple[str, bool]] = []
    held: list[str] = []
    main, articles, dropped, depth, at = 0, 0, "", 0, 0
    since, inner = 0, 0  # where the dropped part starts, and articles open in it
    closed: set[int] | None = None

    def close() -> None:
        text = _SPACE.sub(" ", html.unescape("".join(held))).strip()
        held.clear()
        if text:
            out.append((text, main > 0))

    size, tags = len(page), Tags(page)
    while at < size:
        found = tags.after(at)
        if not found:
            if not dropped:
                held.append(page[at:])
            break
        start, end, closing, tag, rest = found
        if not dropped and start > at:
            held.append(page[at:start])
        at = end
        if not tag:
            continue
        if closing:
            if dropped:
                if tag == dropped:
                    depth -= 1
                    if not depth:
                        dropped = ""
                    continue
                elif tag in MAIN and inner:
                    inner -= 1
                elif tag in ("body", "html") or tag in MAIN and main:
                    dropped, depth = "", 0
            if not dropped and tag in BLOCKS and not (tag in INLINE and main):
                close()
                if tag in MAIN and main:
                    main -= 1
                    articles -= tag == "article" and articles > 0
            continue
        if tag in RAW and not (tag in KEPT and main and not dropped):
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else size
            if not dropped and tag in BLOCKS:
                close()
            continue
        if dropped:
            reopens = tag in MAIN and not articles
            if reopens and tag == "article":  # only what was opened before and is not closed
                closed = _closed(page) if closed is None else closed
                reopens = since not in closed
            if not reopens:
                if tag == dropped:
                    depth += tag not in VOID and not rest.endswith("/")
                else:
                    inner += tag in MAIN
                continue
            dropped, depth = "", 0
        if tag in BLOCKS and not (tag in INLINE and main):
            close()
        elif tag == "br":
            held.append(" ")
        if tag not in VOID and not (rest.endswith("/") and tag not in MAIN) and _is_dropped(tag, rest, main > 0, articles > 0):
            close()
            dropped, depth, since, inner = tag, 1, start, 0
        elif tag in MAIN:
            main += 1
            articles += tag == "article"
    close()
    return out


def suffix_order(tokens: np.ndarray, page: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, class) of the runs of ``run`` tokens (a power of two): suffixes of at least that length in the order of their
    first ``run`` tokens and then of pages; equal runs are of one class.

    Suffixes are ordered by their first 1, 2, 4, ... tokens: doubling ranks pairs of the ranks before. No suffix is compared
    beyond its page.
    """
    n = len(tokens)
    if n < run:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    ends = np.flatnonzero(np.append(page[1:] != page[:-1], True)) + 1
    left = np.repeat(ends, np.diff(np.append(0, ends))) - np.arange(n)  # tokens to the page's end
    length = 1
    while length < run:
        second = np.full(n, -1, np.int64)
        second[: n - length] = rank[length:]
        second[left <= length] = -1
        rank = np.unique(rank * (n + 1) + second + 1, return_inverse=True)[1].astype(np.int64)
        length *= 2
    starts = np.flatnonzero(left >= run)
    order = starts[np.lexsort((page[starts], rank[starts]))]
    ranks = rank[order]
    return order, np.cumsum(np.append(True, ranks[1:] != ranks[:-1])[: len(order)]) - 1


def pages_of_runs(order: np.ndarray, group: np.ndarray, page: np.ndarray) -> np.ndarray:
    """Distinct pages of each class of equal runs."""
    pages = page[order]
    new = np.append(True, (pages[1:] != pages[:-1]) | (group[1:] != group[:-1]))[: len(order)]
    return np.bincount(group, new).astype(np.int64) if len(order) else np.zeros(0, np.int64)


def cover(places: np.ndarray, n: int, run: int) -> np.ndarray:
    """Mask of the ``n`` tokens that the runs starting at ``places`` cover."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, places, 1)
    np.add.at(edge, places + run, -1)
    return np.cumsum(edge[:-1]) > 0


def repeated_runs(tokens: np.ndarray, page: np.ndarray, run: int, least: np.ndarray) -> np.ndarray:
    """Mask of the tokens in runs that stand on at least ``least`` distinct pages, as asked at each token."""
    order, group = suffix_order(tokens, page, run)
    distinct = pages_of_runs(order, group, page)[group]
    return cover(order[distinct >= least[order]], len(tokens), run)


def whole_runs(mask: np.ndarray, run: int) -> np.ndarray:
    """The covered tokens of a block: all of it, or stretches of a run at least. A run that ends in the next block takes none
    of that block's first words along."""
    if not mask.any() or mask.all():
        return mask
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    out = np.zeros(len(mask), bool)
    for low, high in edges.reshape(-1, 2):
        out[low:high] = high - low >= run
    return out


def without(blocks: list[list[str]], covered: np.ndarray, run: int) -> str:
    """Text of a page's blocks of words without the covered ones."""
    if not covered.any():
        return "\n\n".join(map(" ".join, blocks))
    kept, at = [], 0
    for block in blocks:
        mask = whole_runs(covered[at : at + len(block)], run)
        at += len(block)
        text = " ".join(w for w, c in zip(block, mask, strict=True) if not c)
        if text:
            kept.append(text)
    return "\n\n".join(kept)


def least_pages(inside: np.ndarray, pages: int, open_pages: int, main_pages: int, main_share: float) -> np.ndarray:
    """Distinct pages of a host of ``pages`` that make a run boilerplate, by zone."""
    return np.where(inside, max(main_pages, int(np.ceil(main_share * pages))), open_pages)


# -- cells ----------------------------------------------------------------------

OPEN, INSIDE, WHOLE = 0, 1, 2
_PARSED = "page_id long, url string, host string, groups long, d1 long, d2 long, turn int, salt long, blocks array<string>, inside array<boolean>"
_RUNS = "cell long, host long, key long, zone int, pages long"
_TEXTS = "page_id long, url string, host string, d1 long, d2 long, shared boolean, text string, n_chars long"


def _parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pages cut into blocks, with a digest of these. A page whose blocks the task has met on the host goes without them:
    ``turn`` is 0 for the first page of its blocks, 1 for the second, which tells their cell of copies, and 2 for others."""
    import xxhash

    met: dict[tuple, int] = {}
    salt = 0
    for frame in frames:
        pages = [blocks_of(h or "") for h in frame["html"]]
        digests = [xxhash.xxh3_128_digest("\0".join(b for b, _ in page).encode("utf-8", "surrogatepass")) for page in pages]
        if len(met) > 500_000:
            met.clear()  # a page more or less with its blocks changes nothing
        turns = []
        for key in zip(frame["host"], digests, strict=True):
            turns.append(met.get(key, 0))
            met[key] = min(turns[-1] + 1, 2)
        both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
        yield frame[["page_id", "url", "host", "groups"]].assign(
            d1=both[:, 0], d2=both[:, 1], turn=turns, salt=np.arange(salt, salt + len(frame)),
            blocks=[None if t else [b for b, _ in p] for t, p in zip(turns, pages, strict=True)],
            inside=[None if t else [i for _, i in p] for t, p in zip(turns, pages, strict=True)],
        )
        salt += len(frame)


class Cell:
    """The distinct pages of a cell: token ids, pages, zones, and hashes of the runs that start at each token."""

    def __init__(self, host: str, pages: list[tuple[list[list[str]], list[bool]]], run: int, memo):
        known: dict[str, int] = {}
        tokens, sizes, zone, keys = [], [], [], []
        self.host = int(np.array([memo[host]], np.uint64).view(np.int64)[0])
        for blocks, inside in pages:
            own = [w for block in blocks for w in block]
            tokens += [known.setdefault(w, len(known)) for w in own]
            sizes.append(len(own))
            flags = np.repeat(np.array(inside, bool), np.array([len(b) for b in blocks], int))
            zone.append(flags)
            hashes = shingles(hashed(own, memo), run)
            mixed = ((hashes ^ np.uint64(memo[host])) + flags[: len(hashes)].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            keys.append(np.append(mixed ^ (mixed >> np.uint64(31)), np.zeros(len(own) - len(hashes), np.uint64)))
        self.tokens, self.page = np.array(tokens, np.int64), np.repeat(np.arange(len(pages)), sizes)
        self.zone = np.concatenate([np.zeros(0, bool), *zone])
        self.keys = np.concatenate([np.zeros(0, np.uint64), *keys]).view(np.int64)
        self.ends = np.cumsum(sizes)

    def runs(self, run: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(zone, key, distinct pages) of the classes of equal runs, a class of both zones being two."""
        order, group = suffix_order(self.tokens, self.page, run)
        for zone in (OPEN, INSIDE):
            mine = self.zone[order] == (zone == INSIDE)
            places, classes = order[mine], group[mine]
            classes = np.cumsum(np.append(True, classes[1:] != classes[:-1])[: len(classes)]) - 1
            first = np.flatnonzero(np.append(True, classes[1:] != classes[:-1])[: len(classes)])
            yield zone, self.keys[places[first]], pages_of_runs(places, classes, self.page)


def _in_cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows with blocks of one cell at a time; a cell's rows stand together."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        frame = frame[frame["blocks"].notna()]
        if frame.empty:
            continue
        edges = np.flatnonzero(np.append(True, frame["cell"].to_numpy()[1:] != frame["cell"].to_numpy()[:-1]))
        for low, high in zip(edges, [*edges[1:], len(frame)], strict=True):
            part = frame.iloc[low:high]
            if held and held[0]["cell"].iloc[0] != part["cell"].iloc[0]:
                yield pd.concat(held)
                held = []
            held.append(part)
    if held:
        yield pd.concat(held)


def _hosts_of(cell: pd.DataFrame, run: int, memo) -> Iterator[tuple[pd.DataFrame, Cell]]:
    """(distinct pages, their tokens) of each host of a cell; hosts share one only where their hashes are equal."""
    for host, rows in cell.groupby("host", sort=True):
        rows = rows.drop_duplicates(["d1", "d2"])
        pages = [([b.split(" ") for b in blocks], list(inside)) for blocks, inside in zip(rows["blocks"], rows["inside"], strict=True)]
        yield rows, Cell(host, pages, run, memo)


def _first(run: int, main_share: float):
    def cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Runs of open blocks, runs on the asked share of the cell's pages in articles, and the number of pages."""
        memo = word_hashes()
        for cell in _in_cells(frames):
            for rows, own in _hosts_of(cell, run, memo):
                yield pd.DataFrame({"cell": [cell["cell"].iloc[0]], "host": [own.host], "key": [0], "zone": [WHOLE], "pages": [len(rows)]})
                for zone, keys, pages in own.runs(run):
                    kept = pages >= (main_share * len(rows) if zone == INSIDE else 1)
                    yield pd.DataFrame({"cell": cell["cell"].iloc[0], "host": own.host, "key": keys[kept], "zone": zone, "pages": pages[kept]})

    return cells


def _again(run: int):
    def cell(pages: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        """Pages in the cell of the runs that are asked for."""
        out, memo = [], word_hashes()
        keys = asked["key"].to_numpy(np.int64)
        if len(keys):
            for _, own in _hosts_of(pages[pages["blocks"].notna()], run, memo):
                pairs = np.unique(np.stack([own.keys, own.page]), axis=1) if len(own.keys) else np.zeros((2, 0), np.int64)
                found, counts = np.unique(pairs[0][np.isin(pairs[0], keys)], return_counts=True)
                out.append(pd.DataFrame({"cell": asked["cell"].iloc[0], "host": own.host, "key": found, "zone": INSIDE, "pages": counts}))
        return pd.concat(out) if out else pd.DataFrame({"cell": [], "host": [], "key": [], "zone": [], "pages": []})

    return cell


def _cover(run: int):
    def cell(pages: pd.DataFrame, drop: pd.DataFrame) -> pd.DataFrame:
        """Texts of the cell's pages without the runs to drop; those with copies once more, as ``shared``."""
        memo, texts = word_hashes(), {}
        copied = set(zip(*(pages.loc[pages["blocks"].isna(), c] for c in ("host", "d1", "d2")), strict=True))
        pages, keys = pages[pages["blocks"].notna()], drop["key"].to_numpy(np.int64)
        if len(keys):
            for rows, own in _hosts_of(pages, run, memo):
                covered = cover(np.flatnonzero(np.isin(own.keys, keys)), len(own.keys), run)
                for key, blocks, end in zip(zip(rows["host"], rows["d1"], rows["d2"], strict=True), rows["blocks"], own.ends, strict=True):
                    words = [b.split(" ") for b in blocks]
                    texts[key] = without(words, covered[end - sum(map(len, words)) : end], run)
        ids = list(zip(pages["host"], pages["d1"], pages["d2"], strict=True))
        out = [texts[key] if key in texts else "\n\n".join(blocks) for key, blocks in zip(ids, pages["blocks"], strict=True)]
        out = pages[["page_id", "url", "host", "d1", "d2"]].assign(shared=False, text=out, n_chars=[len(t) for t in out])
        again = out[[key in copied for key in ids]].drop_duplicates(["host", "d1", "d2"]).assign(shared=True)
        return pd.concat([out, again]).astype({"url": object, "host": object, "text": object})  # strings in pieces can't go back to Spark

    return cell


def _copies(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield frame.loc[frame["blocks"].isna(), ["page_id", "url", "host", "d1", "d2"]]


def extract(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    run: int = 16,
    open_pages: int = 3,
    main_pages: int = 8,
    main_share: float = 0.5,
    group_chars: int = 4_000_000,
    most_broadcast: int = 100_000,
) -> DataFrame:
    """(page_id, url, text, n_chars) per row; blocks are joined by an empty line.

    NULL and empty html give empty text. Pages without a readable host are a host of their own kind; NULL urls too. Rows
    that are repeated are rows of their own, and pages of equal blocks count as one when repeats are looked for. A run of
    ``run`` words is boilerplate in open blocks where those of ``open_pages`` distinct pages have it, in articles where those
    of ``main_share`` of the host's distinct pages do, and of at least ``main_pages``. An empty table gives no row.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))
    sizes = base.groupBy("host").agg((F.floor(F.sum(F.coalesce(F.length("html"), F.lit(0))) / group_chars) + 1).alias("groups"))
    # Hosts of several cells. Sent to all tasks while there are few of them, else joined by host.
    large = settle(sizes.filter("groups > 1"), "large-hosts")
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sized = base.join(F.broadcast(large) if large.count() <= most_broadcast else large, "host", "left").withColumn("groups", F.coalesce("groups", F.lit(1)))
    parsed = sized.select("page_id", "url", "html", "host", "groups").mapInPandas(_parse, _PARSED)
    # Pages of equal blocks meet in a cell; copies that a task has met before only have to be somewhere.
    cell = F.xxhash64("host", F.pmod(F.xxhash64("d1"), F.col("groups")))
    dealt = parsed.withColumn("cell", F.when(F.col("turn") == 2, F.xxhash64(F.lit("copies"), F.pmod("salt", F.lit(4 * n)))).otherwise(cell))
    dealt = dealt.drop("groups", "turn", "salt").repartition(n, "cell")  # the one shuffle of texts, which all steps below read
    counted = dealt.sortWithinPartitions("cell").mapInPandas(_first(run, main_share), _RUNS)
    sums = counted.groupBy("host", "key").agg(F.max("zone").alias("zone"), F.sum("pages").alias("pages"), F.collect_set("cell").alias("cells"))
    # Passed through as it is, so that all readers ask for the same columns of one shuffle.
    sums = sums.mapInArrow(lambda batches: batches, "host long, key long, zone int, pages long, cells array<long>")
    hosts = sums.filter(F.col("zone") == WHOLE).select("host", F.col("pages").alias("whole"), F.col("cells").alias("all_cells"))
    asked = sums.filter(F.col("zone") == INSIDE).select("host", "key").join(hosts.filter(F.col("whole") >= main_pages), "host")
    asked = asked.select("key", F.explode("all_cells").alias("cell"))
    recounted = dealt.groupBy("cell").cogroup(asked.groupBy("cell")).applyInPandas(_again(run), _RUNS)
    inside = recounted.groupBy("host", "key").agg(F.sum("pages").alias("pages")).join(hosts, "host")
    inside = inside.filter(F.col("pages") >= F.greatest(F.lit(main_pages), F.ceil(main_share * F.col("whole"))))
    opened = sums.filter((F.col("zone") == OPEN) & (F.col("pages") >= open_pages)).join(hosts, "host")
    drop = opened.select("key", "all_cells").unionByName(inside.select("key", "all_cells")).select("key", F.explode("all_cells").alias("cell"))
    texts = dealt.groupBy("cell").cogroup(drop.groupBy("cell")).applyInPandas(_cover(run), _TEXTS)
    copies = dealt.mapInPandas(_copies, "page_id long, url string, host string, d1 long, d2 long")
    shared = texts.filter("shared").select("host", "d1", "d2", "text", "n_chars")
    copies = copies.join(shared.hint("merge"), ["host", "d1", "d2"])  # whose skewed side is split where a content has many copies
    return texts.filter("NOT shared").select("page_id", "url", "text", "n_chars").unionByName(copies.select("page_id", "url", "text", "n_chars"))
