"""Main text of web pages by differencing each page with its nearest neighbour by URL.

Pages stand in the order of host, path and id. A page is compared with the neighbour on its host whose path shares the
longer start; their lines of text are aligned by longest common subsequence and lines that both have are deleted, since
a site repeats its frame from page to page. A line is the text of one block. Two rules keep this right: what the markup
itself marks as frame (navigation, footers, forms, adverts, comments and the like), or puts outside its article where
it has one, goes also where no neighbour repeats it; and a neighbour that repeats half of the article's text or more
deletes nothing there, since sites hold copies of articles. A mark that encloses the article, or nearly all text of a page,
is a wrapper and no frame, and an article that holds little of what differs from the neighbour is a teaser.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable
from hashlib import blake2b
from html import unescape
from itertools import chain, groupby, islice

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows

#: Elements whose content is not text of the page; elements that frame a page; elements that start a block.
SILENT = frozenset("script style template noscript iframe object svg title select option datalist audio video canvas".split())
FRAME = frozenset("nav footer aside form button dialog menu fieldset label input textarea".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCK - {"caption", "legend", "summary", "td", "th", "tr", "tbody", "thead", "tfoot", "body", "html", "option", "optgroup"}
#: Words in class, id and role that mark a frame, and roles and names of the main part.
FRAME_WORDS = frozenset(
    "ad ads adv advert advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login"
    " share sharing social related recommended recommendations sidebar side menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar topbar masthead header footer comment comments disqus"
    " reply replies respond contentinfo complementary search searchform widget copyright legal skip hidden".split()
)
#: Words that names of frames hold beside these; elements that wrap whole pages, marked or not.
FILLER_WORDS = frozenset("site page main global top bottom left right section box bar block list item items container wrapper wrap area inner outer col column nav the js".split())
WRAPPERS = frozenset("form div section fieldset table tbody tr td center span".split())
#: Words that mark a frame in any name, but where the name's last word is one of the article's own or its first
#: one says that the page has or lacks such a thing; words that mark one with those too; words of readers' remarks.
SURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising promo promotion cookie cookies consent gdpr popup modal newsletter subscribe subscription share sharing social"
    " sidebar menu menus navbar navigation breadcrumb breadcrumbs pagination pager toolbar comment comments disqus reply replies respond".split()
)
OWN_WORDS = frozenset("article body text title story main entry post paragraph heading headline free".split())
SAYS_HAS = frozenset("has have with without no not is hide show".split())
#: Words that mark a frame together with one of those that it then lists.
NEAR_WORDS, LISTED_WORDS = frozenset("related recommended recommendations".split()), frozenset("posts articles links stories news pages items reading".split())
PAID_WORDS = frozenset("sponsor sponsored advertorial".split())
REMARK_WORDS = frozenset("comment comments reply replies respond".split())
#: Share of a page's text from which on a marked element wraps it; share of the differing text that a main part has at least.
WRAPS, LEAST_MAIN = 0.8, 0.2
#: A quote opens a value only after an equals sign and where its mate follows, however far; else it is an ordinary character.
#: Nothing is matched twice: only the last quote of a kind can lack its mate, so a page takes linear time.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^=>]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>][^\s>]*+|))*+)(?:>|\Z)|[^<]+|<", re.DOTALL)
ATTRIBUTE = re.compile(r"""([A-Za-z_:][-A-Za-z0-9_:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
WORDS = re.compile(r"[A-Za-z]+")
#: Lines times lines up to which one table of bits aligns two pages; beyond it the alignment is halved.
TABLE = 1 << 28
#: Share of a main part's characters from which on a page that has them too counts as a copy of the article.
COPY = 0.5
#: Runs of equal pages on either side of a range that others may need: the page's own, and two neighbours.
SIDE = 3
#: Pages of a range, about: the unit in which neighbours are found.
RANGE_ROWS, MOST_RANGES = 500, 16384
#: Ranges of a task, about.
TASK_RANGES = 8


def blocks(html: str) -> list[tuple[str, bool, bool]]:
    """The page's lines in order: (text, inside an article or main part, inside a frame). Empty lines are left out."""
    out: list[tuple[str, tuple[int, ...], tuple[int, ...]]] = []
    text: list[str] = []
    # open elements: name, and numbers of the main part and the frame that they are, or 0
    stack: list[tuple[str, int, int]] = []
    mains: list[int] = []
    frames: list[int] = []
    # of each main part the frames around it, of each frame the element
    around: dict[int, tuple[int, ...]] = {}
    element: dict[int, str] = {}

    # the line around each open inline frame: its text so far, its main parts and frames
    waiting: list[tuple[list[str], tuple[int, ...], tuple[int, ...]]] = []

    def put(pieces: list[str], mains: tuple[int, ...], frames: tuple[int, ...]) -> None:
        line = " ".join(unescape("".join(pieces)).split())
        pieces.clear()
        if line:
            out.append((line, mains, frames))

    def settle() -> None:
        """A block inside an inline frame ends the lines around it."""
        for pieces, *where in waiting:
            put(pieces, *where)

    def flush() -> None:
        if text:
            put(text, tuple(mains), tuple(frames))

    def close(upto: int) -> None:
        while len(stack) > upto:
            name, is_main, is_frame = stack.pop()
            if name in BLOCK:
                flush()
            elif is_frame:
                flush()
                text.extend(waiting.pop()[0])
            if is_main:
                mains.pop()
            if is_frame:
                frames.pop()

    at, size = 0, len(html)
    while at < size:
        token = TOKEN.match(html, at)
        at = token.end()
        name = token[2]
        if name is None:
            found = token[0]
            if found.startswith("<![CDATA["):
                text.append(found[9:].removesuffix("]]>"))
            elif found == "<" or not found.startswith("<"):
                text.append(found)
            continue
        name = name.lower()
        if token[1]:
            if name == "p" and not any(e[0] == "p" for e in stack):
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    close(i)
                    break
                # an inline element's end tag does not close the block that it stands in
                if stack[i][0] in BLOCK and name not in BLOCK:
                    break
            continue
        if name in SILENT:
            # what these hold is not markup: it ends at the first end tag of the name
            if not token[0].endswith("/>"):
                end = re.compile(rf"</{name}\s*>", re.IGNORECASE).search(html, at)
                at = end.end() if end else size
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in CLOSES_P or name in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):
            own = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}.get(name, ())
            for i in range(len(stack) - 1, -1, -1):
                held = stack[i][0]
                if held == "p" or held in own:
                    close(i)
                    if held == "p" and own:
                        continue
                    break
                if held in BLOCK:
                    break
        if name in BLOCK:
            settle()
            flush()
        if name in VOID:
            continue
        is_main, is_frame = name in ("article", "main"), name in FRAME
        if token[3]:
            given = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(token[3])}
            role = given.get("role", "").lower()
            is_main |= role in ("main", "article")
            if name == "article" and (remark(given.get("class", "")) or remark(given.get("id", ""))):
                # a reader's remark may be an article
                is_main, is_frame = False, True
            is_frame |= name not in ("body", "html", "article", "main") and (any(marks_frame(w) for k in ("class", "id", "role") for w in given.get(k, "").split()) or "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", ""))
        # a header is a frame but where it opens an article
        is_frame |= name == "header" and not mains
        if token[0].endswith("/>") and name not in BLOCK:
            continue
        if is_main:
            mains.append(len(around) + 1)
            around[mains[-1]] = tuple(frames)
        if is_frame and name not in BLOCK:
            # what an inline frame holds is a line of its own; the line around it goes on behind it
            waiting.append((text.copy(), tuple(mains), tuple(frames)))
            text.clear()
        if is_frame:
            frames.append(len(element) + 1)
            element[frames[-1]] = name
        stack.append((name, mains[-1] if is_main else 0, frames[-1] if is_frame else 0))
    close(0)
    flush()
    return settled(out, around, element)


def remark(names: str) -> bool:
    """Whether a class or id is that of a reader's remark."""
    return any(not REMARK_WORDS.isdisjoint(words) and words[-1] not in OWN_WORDS and words[0] not in SAYS_HAS for words in ([w.lower() for w in WORDS.findall(n)] for n in names.split()) if words)


def marks_frame(token: str) -> bool:
    """Whether a class, id or role names a frame: a sure word does wherever it stands, as in article-ad or share-buttons, but
    for names such as ad-free-article or has-comments; others where all words do, but for fillers such as in site-header."""
    words = [w.lower() for w in WORDS.findall(token)]
    if not PAID_WORDS.isdisjoint(words) or not (NEAR_WORDS.isdisjoint(words) or LISTED_WORDS.isdisjoint(words)):
        return True
    if not SURE_WORDS.isdisjoint(words) and words[-1] not in OWN_WORDS and words[0] not in SAYS_HAS:
        return True
    return not FRAME_WORDS.isdisjoint(words) and FRAME_WORDS.union(FILLER_WORDS).issuperset(words)


def settled(lines: list[tuple[str, tuple[int, ...], tuple[int, ...]]], around: dict[int, tuple[int, ...]], element: dict[int, str]) -> list[tuple[str, bool, bool]]:
    """Lines with their main parts and frames; frames that wrap the page don't count, nor main parts inside frames (a
    remark among the comments may be an article) unless they hold half of the page's text."""
    total = sum(len(x) for x, _, _ in lines)
    held: Counter[tuple[bool, int]] = Counter()
    for x, mains, frames in lines:
        held.update({**{(True, m): len(x) for m in mains}, **{(False, f): len(x) for f in frames}})
    wrapping = {f for f, name in element.items() if name in WRAPPERS and held[False, f] >= WRAPS * total}
    wrapping |= {f for m, fs in around.items() if 2 * held[True, m] >= total for f in fs if element[f] in WRAPPERS}
    inside = {m for m, fs in around.items() if wrapping.issuperset(fs)}
    return [(x, not inside.isdisjoint(mains), not wrapping.issuperset(frames)) for x, mains, frames in lines]


def lcs_shared(a: list[str], b: list[str]) -> list[bool]:
    """Which entries of ``a`` belong to a longest common subsequence of the two.

    Common ends are cut off; the rest is a row of bits per entry of ``a`` with a step for each entry of ``b`` at which
    the length grows. Where that table would be too large, ``a`` is halved at the point of ``b`` that loses nothing.
    """
    shared = [False] * len(a)
    work = [(0, len(a), 0, len(b))]
    while work:
        i, j, k, m = work.pop()
        while i < j and k < m and a[i] == b[k]:
            shared[i] = True
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            shared[j - 1] = True
            j, m = j - 1, m - 1
        if i == j or k == m:
            continue
        if (j - i) * (m - k) > TABLE and j - i > 1:
            half = (i + j) // 2
            first = _row_lengths(a[i:half], b[k:m])
            second = _row_lengths(a[half:j][::-1], b[k:m][::-1])
            n = m - k
            best = max(range(n + 1), key=lambda c: first[c] + second[n - c])
            work += [(i, half, k, k + best), (half, j, k + best, m)]
            continue
        rows = _rows(a[i:j], b[k:m])
        x, y = j - i, m - k
        while x and y:
            if a[i + x - 1] == b[k + y - 1]:
                shared[i + x - 1] = True
                x, y = x - 1, y - 1
            elif rows[x] >> (y - 1) & 1:  # the length does not grow at this entry of b
                y -= 1
            else:
                x -= 1
    return shared


def _places(b: list[str]) -> dict[str, int]:
    where: dict[str, int] = {}
    for c, value in enumerate(b):
        where[value] = where.get(value, 0) | 1 << c
    return where


def _rows(a: list[str], b: list[str]) -> list[int]:
    where, full = _places(b), (1 << len(b)) - 1
    rows = [full]
    for value in a:
        v, u = rows[-1], rows[-1] & where.get(value, 0)
        rows.append(((v + u) | (v - u)) & full)
    return rows


def _row_lengths(a: list[str], b: list[str]) -> list[int]:
    """Length of the longest common subsequence of all of ``a`` and each start of ``b``."""
    where, full = _places(b), (1 << len(b)) - 1
    v = full
    for value in a:
        u = v & where.get(value, 0)
        v = ((v + u) | (v - u)) & full
    out, total = [0], 0
    for bit in reversed(format(v, f"0{len(b)}b")) if b else ():
        total += bit == "0"
        out.append(total)
    return out


def common_start(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def main_lines(page: list[tuple[str, bool, bool]], path: str, neighbours: list[tuple[str, list[str]]], copied: bool = False) -> tuple[list[str], int]:
    """The page's lines of main text, and how many lines the neighbour shares.

    ``neighbours`` are paths and lines of the nearest pages of other content before and after it on its host. The nearer one
    is taken; one with the very same lines, or none, tells nothing, so then the other is. Where the page has a main part,
    one that shares ``COPY`` of its text or more holds a copy of the article and tells nothing about it either; if both do,
    the whole main part stays. Inside the main part only lines go that three pages have, both neighbours or, where the page
    has a copy beside it (``copied``), one: two articles may share a sentence or a heading, what more repeat is the site's.
    """
    lines = [x[0] for x in page]
    inside = main_part(page, [False] * len(page))
    has_main = any(inside)
    size = sum(len(x) for x, i in zip(lines, inside, strict=True) if i)
    ranked = sorted(neighbours, key=lambda n: -common_start(path, n[0]))
    seen, telling = [], []
    for _, other in ranked:
        if not other or other == lines or (telling and not has_main):
            continue
        seen.append(lcs_shared(lines, other))
        if not has_main or sum(len(x) for x, i, s in zip(lines, inside, seen[-1], strict=True) if i and s) < COPY * size:
            telling.append(seen[-1])
    none = [False] * len(lines)
    shared = (telling or seen or [none])[0]
    gone = telling[0] if telling else none
    inside = main_part(page, gone)
    if any(inside):
        both = [all(told) for told in zip(*telling, strict=True)] if len(telling) + copied >= 2 and telling else none
        kept = [x for (x, _, frame), i, s in zip(page, inside, both, strict=True) if not frame and i and not s]
    else:
        kept = [x for (x, _, frame), s in zip(page, gone, strict=True) if not frame and not s]
    return kept, sum(shared)


def main_part(page: list[tuple[str, bool, bool]], shared: list[bool]) -> list[bool]:
    """Which lines stand in the page's main part; none if that holds less than ``LEAST_MAIN`` of what is not shared."""
    inside = [is_main and not frame for _, is_main, frame in page]
    own = sum(len(x) for (x, _, _), i, s in zip(page, inside, shared, strict=True) if i and not s)
    rest = sum(len(x) for (x, _, frame), s in zip(page, shared, strict=True) if not frame and not s)
    return inside if own >= LEAST_MAIN * rest else [False] * len(page)


def content(page: list[tuple[str, bool, bool]]) -> list[str]:
    """The lines that stay where no neighbour shares any: those inside the main part, or all where there is none."""
    inside = main_part(page, [False] * len(page))
    has_main = any(inside)
    return [x for (x, _, frame), i in zip(page, inside, strict=True) if not frame and (i or not has_main)]


def mark(page: list[tuple[str, bool, bool]]) -> bytes | None:
    """Pages with the same content have the same mark; a page without lines, which tells its neighbours nothing, has none."""
    return blake2b("\n".join(content(page)).encode("utf-8", "surrogatepass"), digest_size=16).digest() if page else None


def last_two(pages: Iterable[tuple]) -> list[tuple]:
    """Of pages (host, mark, ...) in order: the last one of the last run of equal marks on the last host, and those of the
    two runs before it, the last of all at the end."""
    held: list[tuple] = []
    for page in pages:
        if held and page[0] != held[-1][0]:
            held = []
        if held and page[1] == held[-1][1]:
            held[-1] = page
        else:
            held = [*held, page][-SIDE:]
    return held


def beyond(ends: list[list[tuple]]) -> list[list[tuple]]:
    """Per range, the pages of the ranges before it among which its first pages find their neighbours.

    ``ends`` are ``last_two`` of each range in order; those of all ranges up to one follow from them.
    """
    out, held = [], []
    for own in ends:
        out.append(held)
        held = last_two([*held, *own])
    return out


def with_neighbours(runs: Iterable[list]) -> Iterable[tuple[list, list]]:
    """Each run of one host with the nearest page of the run before and of the run after it; at either end of the host
    those of the two nearest runs. At most three runs are held."""
    past: list = []
    pending: list[list] = []

    def near() -> list:
        after = [run[0] for run in pending[1:3]]
        before = past[::-1]
        return [before[0], after[0]] if before and after else (before or after)[:2]

    for run in runs:
        pending.append(run)
        if len(pending) == (2 if past else 3):
            yield pending[0], near()
            past = [*past, pending.pop(0)[-1]][-2:]
            if len(pending) == 2:
                yield pending[0], near()
                past = [*past, pending.pop(0)[-1]][-2:]
    while pending:
        yield pending[0], near()
        past = [*past, pending.pop(0)[-1]][-2:]


def extract_main_text(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """Per page: url, text (lines of main text joined by two line feeds), n_chars, and n_shared (lines of the neighbour).

    A null or empty html gives an empty text. A null url, or one without host, has no neighbours. Ids may be null or
    repeated and rows keep their multiplicity; of rows with one id and url but other pages, the same one is always what
    other ranges see. Other columns are ignored. Pages are dealt into ranges of the order host,
    path, id, so a host, however large, is spread over many. Neighbours are the nearest pages with other content: a run
    of copies is compared with the pages before and after all of it. html is parsed twice, first for marks of content,
    which show the pages of other ranges that a range's first and last pages need, so that neighbours do not depend on
    the ranges; lines are shuffled once. The driver holds the ranges' borders and six keys of each range, at most
    ``MOST_RANGES``.
    """
    url = F.coalesce(F.col(url_column).cast("string"), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)", 1)
    keyed = pages.select(F.col(id_column).cast("bigint").alias("id"), F.col(url_column).cast("string").alias("url"), F.col(html_column).alias("html"), host.alias("host"), path.alias("path"))

    key = lambda host, path, key: (host, path, key is not None, key or 0)
    narrow = keyed.select("id", "url", "host", "path")
    n = narrow.count()
    ranges = max(1, min(MOST_RANGES, -(-n // RANGE_ROWS)))
    tasks = max(ranges // TASK_RANGES, min(ranges, pages.sparkSession.sparkContext.defaultParallelism))
    every = max(1, n // (ranges * 10))
    sample = narrow.where(F.pmod(F.xxhash64("id", "url"), F.lit(every)) == 0).select("host", "path", "id").limit(ranges * 30).collect()
    sample = sorted(key(r["host"], r["path"], r["id"]) for r in sample)
    borders = sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)}) if sample else []

    def place(batches):
        for batch in batches:
            keys = map(key, batch["host"].to_pylist(), batch["path"].to_pylist(), batch["id"].to_pylist())
            marks = [mark(blocks(h or "")) for h in batch["html"].to_pylist()]
            yield {k: batch[k] for k in ("id", "url", "host", "path")} | {"mark": marks, "pid": [bisect_right(borders, k) for k in keys]}

    # the pages of other ranges among which the first and last pages of each find their neighbours
    marked = map_rows(keyed, place, "id bigint, url string, host string, path string, mark binary, pid int", slice_rows=256)
    marked = marked.where("mark IS NOT NULL AND host != ''").repartition(tasks, "pid").sortWithinPartitions("pid", "host", "path", "id", "url")

    def summarise(batches):
        rows = chain.from_iterable(zip(*(b[k].to_pylist() for k in ("pid", "host", "mark", "id", "url")), strict=True) for b in batches)
        for pid, of_range in groupby(rows, lambda r: r[0]):
            first, back = [], []
            for row in of_range:
                row = row[1:]
                if not back or (len(first) < SIDE and row[0] == back[-1][0] == first[0][0] and row[1] != back[-1][1]):
                    first.append(row)
                back = last_two([*back, row])
            found = [(pid, side, *row) for side, row in (*enumerate(first), *enumerate(back, SIDE))]
            yield dict(zip(("pid", "side", "host", "mark", "id", "url"), zip(*found, strict=True), strict=True))

    ends: dict[int, list] = {}
    for r in map_rows(marked, summarise, "pid int, side int, host string, mark binary, id bigint, url string", slice_rows=65536).collect():
        ends.setdefault(r["pid"], [None] * 2 * SIDE)[r["side"]] = (r["host"], bytes(r["mark"]), r["id"], r["url"])
    pids, known = sorted(ends), lambda sides: [page for page in sides if page is not None]
    before = beyond([known(ends[p][SIDE:]) for p in pids])
    # from the other end a range's first pages are its last
    after = beyond([known(ends[p][:SIDE])[::-1] for p in reversed(pids)])[::-1]
    ghosts = sorted({(page[2], page[3], pid) for pid, *sides in zip(pids, before, after, strict=True) for page in chain(*sides)}, key=str)
    ghosts = pages.sparkSession.createDataFrame(ghosts, "id bigint, url string, pid int")
    ghosts = keyed.alias("k").join(F.broadcast(ghosts.alias("g")), F.col("k.id").eqNullSafe(F.col("g.id")) & F.col("k.url").eqNullSafe(F.col("g.url")))
    # of rows with one id and url the page whose hash, or else text, is least
    least = F.min_by("html", F.struct(F.xxhash64("html"), "html")).alias("html")
    ghosts = ghosts.select("k.*", "g.pid").groupBy("id", "url", "host", "path", "pid").agg(least).select("id", "url", "html", "host", "path", "pid").withColumn("ghost", F.lit(True))
    every_page = keyed.withColumn("pid", F.lit(None).cast("int")).withColumn("ghost", F.lit(False)).unionByName(ghosts)

    def parse(batches):
        for batch in batches:
            got = [blocks(h or "") for h in batch["html"].to_pylist()]
            keys = map(key, batch["host"].to_pylist(), batch["path"].to_pylist(), batch["id"].to_pylist())
            yield {
                **{k: batch[k] for k in ("id", "url", "host", "path", "ghost")},
                "pid": [p if p is not None else bisect_right(borders, k) for p, k in zip(batch["pid"].to_pylist(), keys, strict=True)],
                "lines": ["\n".join(x[0] for x in page) for page in got],
                "marks": ["".join("0123"[is_main + 2 * frame] for _, is_main, frame in page) for page in got],
            }

    parsed = map_rows(every_page, parse, "id bigint, url string, host string, path string, ghost boolean, pid int, lines string, marks string", slice_rows=256)
    parsed = parsed.repartition(tasks, "pid").sortWithinPartitions("pid", "host", "path", "id", "url")

    def difference(batches):
        def rows():
            for batch in batches:
                yield from zip(*(batch[k].to_pylist() for k in ("pid", "host", "path", "id", "url", "ghost", "lines", "marks")), strict=True)

        def page_of(row):
            return [(x, m in "13", m in "23") for x, m in zip(row[6].split("\n"), row[7], strict=True)] if row[7] else []

        def done(row, near, copied=False):
            kept, shared = main_lines(page_of(row), row[2], [(r[2], r[6].split("\n")) for r in near], copied)
            text = "\n\n".join(kept)
            return row[3], row[4], text, len(text), shared

        def runs_of(of_host):
            run, held = [], None
            for row in of_host:
                key = mark(page_of(row))
                if run and key != held:
                    yield run
                    run = []
                # copies wait for the next page that differs; they hold their lines once
                run.append((*row[:6], *run[-1][6:]) if run and run[-1][6:] == row[6:] else row)
                held = key
            yield run

        def results():
            for (_, host), of_host in groupby(rows(), lambda row: row[:2]):
                # a page without host or lines has no neighbours and is none
                alone = lambda row: not row[7] or not row[1]
                told: list = []
                pages = (row for row in of_host if not (alone(row) and (row[5] or told.append(row) or True)))
                if host:
                    for run, near in with_neighbours(run for run in runs_of(pages) if run):
                        yield from (done(row, near, len(run) > 1) for row in run if not row[5])
                        yield from (done(row, []) for row in told)
                        told.clear()
                else:
                    for row in of_host:
                        if not row[5]:
                            yield done(row, [])
                yield from (done(row, []) for row in told)

        names = ("id", "url", "text", "n_chars", "n_shared")
        found = results()
        while part := list(islice(found, 256)):
            yield dict(zip(names, zip(*part, strict=True), strict=True))

    out = map_rows(parsed, difference, "id bigint, url string, text string, n_chars bigint, n_shared bigint", slice_rows=256)
    return out.select(F.col("id").alias(id_column), F.col("url").alias(url_column), "text", "n_chars", "n_shared")
