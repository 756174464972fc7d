"""Main text of web pages by a suffix array over each host (operator 6).

Inside an article (or `main`) everything stays but what is marked as another part.  About all other blocks repeats decide first:
the words outside the articles of a host's pages are concatenated, with a mark of its own after each page, and sorted into a
suffix array up to DEPTH words (by prefix doubling); its ranks tell how many distinct pages hold each run of words.  Runs that
other pages repeat are left out (n_repeated of a page).  Of what is unique on its page, text that is marked as a menu, header,
footer, aside, form, notice, advert or reader comment goes too (n_marked); the rest stays.  Names of classes are weak marks: on
a page that has no text but in blocks so named, they count for nothing and repeats alone decide.

Boilerplate is a run of at least LEAST words, or a whole block of any length, that a share of the host's pages holds (one of
ONE_IN of those that have such text, at least 3, or both of two; of marked text any two pages), and a run of at least LONG words
that two or more pages hold.
Pages of equal text (but for marked parts) count as one.  A page of which long runs that only few others hold are half or more
of what is left is a copy (a print view): it keeps them.

Hosts of any size go one way.  A host's pages are dealt out to groups of about GROUP pages (most have one), pages of equal text
together, and the suffix array of a group tells how many distinct pages of the group hold each run of LEAST and of LONG words.
Such counts are added up over the groups of the host, by fingerprints of the runs; who needs a run or block that is repeated on
the whole host is told so.  So nothing depends on how a host is dealt out: neither texts nor n_repeated nor n_marked.

Defined cases: null html, or html without text, gives an empty text; pages with a null or odd url are compared with none; null
and repeated keys are kept, a row each; a quote in a tag that nothing closes ends with the tag; other columns are not read; an
empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, distinct, hash_spans, map_arrow, parts_for, read_table, slices, stage_table, window_hashes

#: Words of a run that a share of the pages holds, and of one that two hold; the share; pages that copies may be on in any case.
LEAST, LONG, ONE_IN, FEW = 5, 50, 4, 3
#: Words by which suffixes are sorted; pages of a group, and bytes of html of one.
DEPTH, GROUP, GROUP_BYTES = 32, 400, 32 << 20
#: A quoted value, or a quote that stands alone: one closes where no tag begins before, or where a blank or the tag's end follows.
_QUOTED = r"\"[^\"<]*\"|'[^'<]*'|\"[^\"]*\"(?=[\s/>])|'[^']*'(?=[\s/>])"
_TAG = re.compile(rf"<!--.*?(?:-->|$)|<(script|style|noscript|template|textarea|svg|iframe|select)\b.*?(?:</\1\s*>|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^\"'>]|{_QUOTED}|[\"'])*)(?:>|$)", re.S | re.I)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_WHITE = re.compile(r"[\s\u200b\ufeff]+")
_BLOCKS = frozenset("address article aside blockquote body br button caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_OUT = frozenset("nav footer aside form head menu dialog button title header".split())
_OUT_NAMES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent notice notices popup modal newsletter subscribe nav navbar navigation menu breadcrumb breadcrumbs sidebar footer comment comments reply replies disqus related share sharing social widget login signup masthead".split())
_OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form".split())


#: What a page says of a block: nothing, that it belongs to the article, that it belongs to a menu, form or the like; while a
#: page is read also: that its class or id is called so.
OPEN, ARTICLE, OUT, _NAMED = 0, 1, 2, 3


def named_out(names: list[str]) -> bool:
    """Whether a whole name says so, or all its parts do, or the last one behind what it belongs to (as "site-footer")."""
    for name in names:
        parts = re.split("[-_]+", name)
        if name in _OUT_NAMES or parts[-1] in _OUT_NAMES or all(p in _OUT_NAMES for p in parts):
            return True
    return False


def blocks_of(html: str) -> list[tuple[str, int]]:
    """Text blocks in page order, and OPEN, ARTICLE or OUT for each."""
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, bool, int]] = []  # tag, article above, OUT or _NAMED if it is left out
    opened: Counter[str] = Counter()  # tags on the stack
    parts: list[str] = []
    article, left = False, OPEN

    def leave(tag: str) -> tuple[bool, int]:
        while True:
            last = stack.pop()[0]
            opened[last] -= 1
            if last == tag:
                return stack[-1][1:] if stack else (False, OPEN)

    def close() -> None:
        if parts:
            text = _WHITE.sub(" ", unescape("".join(parts))).strip()
            if text:
                out.append((text, left or (ARTICLE if article else OPEN)))
            parts.clear()

    end = 0
    for m in _TAG.finditer(html):
        if m.start() > end:
            parts.append(html[end : m.start()])
        end = m.end()
        tag = (m[3] or "").lower()
        if not tag:  # comments, declarations, scripts and the like: nothing to read
            continue
        if tag in _BLOCKS:
            close()
        if m[2]:
            if opened[tag]:
                above = leave(tag)
                if above != (article, left):
                    close()
                article, left = above
            continue
        if tag in _VOID or m[4].rstrip().endswith("/"):
            continue
        if tag in ("p", "li") and stack and tag in [t for t, *_ in stack[-2:]]:  # these close themselves
            article, left = leave(tag)
        names, role = [], ""
        if "=" in m[4]:
            for name, value in _ATTRIBUTE.findall(m[4]):
                value = value.strip("\"'").lower()
                if name.lower() == "role":
                    role = value
                else:
                    names += value.split()
        body = tag in ("body", "html", "article", "main") or role in ("article", "main")
        inside = article or (body and tag not in ("body", "html"))
        marked = role in _OUT_ROLES or (tag in _OUT and not (tag == "header" and article))
        gone = OUT if marked or left == OUT else _NAMED if left or (not body and named_out(names)) else OPEN
        if (inside, gone) != (article, left):
            close()
        stack.append((tag, inside, gone))
        opened[tag] += 1
        article, left = inside, gone
    parts.append(html[end:])
    close()
    unnamed = OUT if any(kind in (OPEN, ARTICLE) for _, kind in out) else OPEN
    return [(text, unnamed if kind == _NAMED else kind) for text, kind in out]


def suffix_array(tokens: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffixes in the order of their first `depth` tokens, and the ranks by the first 1, 2, 4, ... tokens."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1
    ranks, k = [rank], 1
    while k < depth and len(rank):
        behind = np.zeros_like(rank)
        behind[:-k] = rank[k:] if k < len(rank) else 0
        rank = np.unique(rank * (len(rank) + 2) + behind, return_inverse=True)[1].astype(np.int64) + 1
        ranks.append(rank)
        k *= 2
    return np.argsort(rank, kind="stable"), ranks


def repeated(tokens: np.ndarray, pages: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Which tokens lie in a substring of at least `least` tokens that distinct pages share.  Neighbours in the suffix array
    share their longest common prefix, found from the ranks."""
    n = len(tokens)
    if n < 2:
        return np.zeros(n, dtype=bool)
    order, ranks = suffix_array(tokens)
    a, b = order[:-1], order[1:]
    shared = np.zeros(n - 1, dtype=np.int64)
    for level in range(len(ranks) - 1, -1, -1):  # binary descent: the longest prefix of 2**k + ... tokens with equal ranks
        i, j = np.minimum(a + shared, n), np.minimum(b + shared, n)
        r = np.append(ranks[level], [-1])
        same = (r[i] == r[j]) & (i < n) & (j < n)
        shared += same * (1 << level)
    # With the nearest suffix of another page, before or behind, a suffix shares the least prefix on the way there.
    here = pages[order]
    turn = np.concatenate([[0], np.cumsum(here[1:] != here[:-1])])
    least_so_far = lambda x, t: np.minimum.accumulate(x - (2 * DEPTH) * t) + (2 * DEPTH) * t  # noqa: E731  anew at each turn
    before = least_so_far(np.concatenate([[0], shared]), turn)
    behind = least_so_far(np.concatenate([[0], shared[::-1]]), turn[-1] - turn[::-1])[::-1]
    length = np.maximum(before, behind)
    hit = length >= least
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, order[hit], 1)
    np.add.at(change, np.minimum(order[hit] + length[hit], n), -1)
    return np.cumsum(change)[:-1] > 0


def _long_runs(gone: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Of the covered words of a block those in runs of `least` words or of the whole block: a substring that reaches in from
    the block before takes nothing away."""
    if not gone.any() or gone.all():
        return gone
    edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    out = np.zeros_like(gone)
    for a, b in edges.reshape(-1, 2).tolist():
        out[a:b] = b - a >= least
    return out


def _words(block: str) -> list[str]:
    return block.split(" ")


def _hash(words: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b"".join(words), dtype=np.uint8)
    ends = np.cumsum([len(w) for w in words])
    return hash_spans(data, ends - [len(w) for w in words], ends)


def needed(pages: int) -> int:
    """How many of a host's distinct pages must hold a short run or a block."""
    return max(min(pages, 3), -(-pages // ONE_IN), 2)


def _covered(starts: np.ndarray, width: int) -> np.ndarray:
    """The words of the runs of `width` words that begin at these places."""
    change = np.zeros(len(starts) + width, dtype=np.int64)
    change[: len(starts)] += starts
    change[width:] -= starts
    return np.cumsum(change)[: len(starts)] > 0


Page = tuple[list[str], list[int]]


def _of_kind(page: Page, kind: int) -> list[str]:
    return [t for t, k in zip(*page, strict=True) if k == kind]


def _class(page: Page) -> int:
    """Equal for pages of equal text but for marked parts."""
    return block_print("\n".join(t for t, kind in zip(*page, strict=True) if kind != OUT))


def run_prints(words: np.ndarray, width: int) -> np.ndarray:
    return (window_hashes(words, width) ^ np.uint64(width)).view(np.int64)


#: Laws of prints: open runs of LEAST words and open blocks (a share of the pages must hold them), open runs of LONG words (two
#: must), marked runs of LEAST words and shorter marked blocks (two must); and the number of a host's distinct pages with open text.
SHARE, TWO, MARKED, PAGES = range(4)
#: A law, and under it prints, how many distinct pages hold each, and a part of the host that does.
Counted = tuple[int, np.ndarray, np.ndarray, np.ndarray]


def _counted(law: int, prints: np.ndarray, of: np.ndarray, page: np.ndarray, classes: np.ndarray, parts: list[list[int]], least: int) -> Counted:
    """of, page: which print is found on which page.  A print stands once for each part, its holders with the first alone."""
    n, m = len(parts), int(classes.max()) + 1
    pairs = distinct(of * n + page)
    of, page = pairs // n, pairs % n
    holders = np.bincount(distinct(of * m + classes[page]) // m, minlength=len(prints))
    sizes = np.array([len(x) for x in parts])
    flat, firsts = np.concatenate([np.array(x, dtype=np.int64) for x in parts]), np.cumsum(sizes) - sizes
    times = sizes[page]
    at = np.repeat(firsts[page] - (np.cumsum(times) - times), times) + np.arange(times.sum())
    size = int(flat.max()) + 1
    pairs = distinct(np.repeat(of, times) * size + flat[at])
    of, part = pairs // size, pairs % size
    ok = holders[of] >= least
    of, part = of[ok], part[ok]
    first = np.concatenate([[True], of[1:] != of[:-1]])[: len(of)]
    return law, prints[of], np.where(first, holders[of], 0), part


def runs_of(pages: list[tuple[int, list[int], list[str]]], kind: int, whole: bool = False) -> Iterator[Counted]:
    """The runs and blocks of these pages' blocks of one kind: (class, parts, blocks) of each page.  Runs are told apart, and
    their holders counted, by the suffix array; pages of one class count as one.  whole: these are all pages of their host, so
    what one of them holds alone is left out."""
    if not pages:
        return
    names: dict[int, int] = {}
    of_page, parts = np.array([names.setdefault(c, len(names)) for c, _, _ in pages]), [x for _, x, _ in pages]
    words, lengths = [], []
    for i, (_, _, blocks) in enumerate(pages):
        own = [*(w.encode() for t in blocks for w in _words(t)), b"\x00%d" % i]  # no other page has the last
        words += own
        lengths.append(len(own))
    tokens, page, least = _hash(words), np.repeat(np.arange(len(pages)), lengths), 2 if whole else 1
    last = np.repeat(np.cumsum(lengths) - 1, lengths)
    if not whole or repeated(tokens, of_page[page]).any():
        ranks = suffix_array(tokens)[1]
        for law, width in ((SHARE, LEAST), (TWO, LONG)) if kind == OPEN else ((MARKED, LEAST),):
            k, n = width.bit_length() - 1, len(tokens) - width + 1
            at = np.flatnonzero(np.arange(max(n, 0)) + width <= last[: max(n, 0)])
            if len(at):
                same = ranks[k][at] * (len(tokens) + 2) + ranks[k][at + width - (1 << k)]
                firsts, of = np.unique(same, return_index=True, return_inverse=True)[1:]
                yield _counted(law, run_prints(tokens, width)[at[firsts]], of, page[at], of_page, parts, least)
    told = [(block_print(t), i) for i, (_, _, blocks) in enumerate(pages) for t in blocks if kind == OPEN or t.count(" ") + 1 < LEAST]
    if told:
        prints, of = np.unique(np.array([x for x, _ in told], dtype=np.int64), return_inverse=True)
        yield _counted(SHARE if kind == OPEN else MARKED, prints, of, np.array([i for _, i in told]), of_page, parts, least)
    if kind == OPEN:
        yield PAGES, np.zeros(1, np.int64), np.array([len(names)]), np.zeros(1, np.int64)


def summed(counted: list[Counted]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """part, law, prints and holders of what at least two distinct pages hold, from the counts of all groups."""
    for law in sorted({x[0] for x in counted}):
        prints, holders, parts = (np.concatenate([x[i] for x in counted if x[0] == law]) for i in (1, 2, 3))
        known, of = np.unique(prints, return_inverse=True)
        n = np.zeros(len(known), dtype=np.int64)
        np.add.at(n, of, holders)
        ok = (n[of] >= 2) | (law == PAGES)
        if not ok.any():
            continue
        pairs = distinct(parts[ok] * len(known) + of[ok])
        part, of = pairs // len(known), pairs % len(known)
        edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])[: len(part)])
        for a, b in zip(edges, [*edges[1:], len(part)], strict=True):
            yield int(part[a]), law, known[of[a:b]], n[of[a:b]]


#: What the pages of a part must know: the repeated prints of each law, in order, and those of TWO that only few pages hold.
Known = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def known_from(told: list[tuple[int, np.ndarray, np.ndarray]], pages: int) -> Known:
    """told: law, prints and holders; pages: how many distinct pages with open text the host has."""
    need = needed(pages)
    pick = lambda law, ok: distinct(np.concatenate([np.zeros(0, np.int64), *(p[ok(n)] for x, p, n in told if x == law)]))
    return pick(SHARE, lambda n: n >= need), pick(TWO, lambda n: n >= 2), pick(MARKED, lambda n: n >= 2), pick(TWO, lambda n: (n >= 2) & (n <= max(FEW, need - 1)))


NOTHING: Known = (np.zeros(0, np.int64),) * 4


def known_of(pages: list[Page]) -> Known:
    """The same where these pages are all of their host's."""
    counted = [x for kind in (OPEN, OUT) for x in runs_of([(_class(p), [0], _of_kind(p, kind)) for p in pages if _of_kind(p, kind)], kind, True)]
    told = list(summed(counted))
    return known_from([x[1:] for x in told], sum(int(n[0]) for _, law, _, n in told if law == PAGES))


#: Of the words of a page's blocks of a kind those that short runs, long runs and long runs on few pages cover, and the blocks to leave out.
Found = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _among(prints: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(prints), dtype=bool)
    at = np.searchsorted(known, prints)
    return known[np.minimum(at, len(known) - 1)] == prints


def look_up(blocks: list[str], kind: int, known: Known) -> Found:
    """What is known to be repeated of a page's blocks of a kind.  Of marked text long runs are runs of short ones."""
    share, two, marked, few = known
    n, runs = sum(t.count(" ") + 1 for t in blocks), share if kind == OPEN else marked
    if not len(runs) and (kind == OUT or not len(two)):
        return (np.zeros(n, dtype=bool),) * 3 + (np.zeros(len(blocks), dtype=bool),)
    words = _hash([w.encode() for t in blocks for w in _words(t)]) if blocks else np.zeros(0, np.uint64)

    def covered(width: int, of: np.ndarray) -> np.ndarray:
        starts = np.zeros(n, dtype=bool)
        found = _among(run_prints(words, width), of)
        starts[: len(found)] = found
        return _covered(starts, width)

    none = NOTHING[0]
    return covered(LEAST, runs), covered(LONG, two if kind == OPEN else none), covered(LONG, few if kind == OPEN else none), _among(np.array([block_print(t) for t in blocks], dtype=np.int64), runs)


def decide(kind: int, blocks: list[str], found: Found) -> tuple[list[str | None], int]:
    """Of these blocks of one kind what repeats leave (null: nothing), and the number of words that they take."""
    short, long, few, shared = found
    copied = bool(few.any()) and 2 * few.sum() >= (few | ~short).sum()
    removed = (short | long) & ~few if copied and kind == OPEN else short | long
    out, words, k = [], 0, 0
    for block, everywhere in zip(blocks, shared.tolist(), strict=True):
        own = _words(block)
        gone, safe = _long_runs(removed[k : k + len(own)]), copied and kind == OPEN and few[k : k + len(own)].all()
        k += len(own)
        if gone.all() or (not safe and everywhere):
            out.append(None)
            words += len(own)
        else:
            out.append(" ".join(w for w, g in zip(own, gone, strict=True) if not g) if gone.any() else block)
            words += int(gone.sum())
    return out, words


def clean_pages(pages: list[Page], known: Known | None = None) -> list[tuple[str, int, int]]:
    """Text, n_repeated and n_marked of pages: (blocks, kinds) of each.  known: what their host's pages share; without it the
    pages are all of their host's."""
    known = known_of(pages) if known is None else known
    out = []
    for page in pages:
        left: dict[int, Iterator[str | None]] = {}
        n_repeated = n_marked = 0
        for kind in (OPEN, OUT):
            blocks = _of_kind(page, kind)
            kept, words = decide(kind, blocks, look_up(blocks, kind, known))
            left[kind], n_repeated = iter(kept), n_repeated + words
        kept = []
        for block, kind in zip(*page, strict=True):
            rest = block if kind == ARTICLE else next(left[kind])
            if rest is not None and kind == OUT:
                n_marked += len(_words(rest))
            elif rest is not None:
                kept.append(rest)
        out.append((" ".join(kept), n_repeated, n_marked))
    return out


def block_print(block: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(block.encode()) - (1 << 63)


OUTSIDE = "host string, groups long, group long, part long, class long, open string, out string"
COUNTED = "host string, bucket long, law int, prints array<long>, holders array<long>, parts array<long>"
TOLD = "host string, part long, law int, prints array<long>, holders array<long>"
TEXTS = "page_id long, url string, text string, n_chars long, n_repeated long, n_marked long"


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, n_repeated and n_marked of each page.  Pages are parsed twice (for what a host repeats, and
    for the texts), so that whole pages are shuffled once and never stored; what lies outside of articles is shuffled once more,
    to the suffix arrays."""
    spark = pages.sparkSession

    def page_of(html: bytes) -> Page:
        return tuple(zip(*blocks_of(html.decode()), strict=True)) or ((), ())

    def outside(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What pages hold outside their articles, dealt out by class."""
        types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        for batch, texts in batches(it, "html"):
            rows = []
            for host, groups, part, x in zip(*(batch.column(i).to_pylist() for i in range(3)), texts, strict=True):
                page = page_of(x)
                own = ["\n".join(_of_kind(page, kind)) for kind in (OPEN, OUT)]  # no block has a line end
                if any(own):
                    rows.append((host, groups, (c := _class(page)) % groups, part, c, *own))
            columns = list(zip(*rows, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [x.split()[0] for x in OUTSIDE.split(", ")])

    def runs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition holds whole groups, sorted by class: the suffix array of one group at a time.  Equal pages are held once."""
        held: dict[tuple[int, str, str], set[int]] = {}
        now: tuple | None = None

        def emit() -> Iterator[pa.RecordBatch]:
            host, groups, _ = now
            for place, kind in ((1, OPEN), (2, OUT)):
                own: dict[tuple[int, str], set[int]] = {}
                for x, parts in held.items():
                    if x[place]:
                        own.setdefault((x[0], x[place]), set()).update(parts)
                for law, prints, holders, parts in runs_of([(c, sorted(p), t.split("\n")) for (c, t), p in own.items()], kind, groups == 1):
                    bucket = prints % groups
                    order = np.lexsort((parts, bucket))
                    bucket = bucket[order]
                    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])[: len(bucket)])
                    offsets = pa.array([*edges, len(bucket)], pa.int32())
                    lists = [pa.ListArray.from_arrays(offsets, pa.array(x[order], pa.int64())) for x in (prints, holders, parts)]
                    yield pa.RecordBatch.from_arrays([pa.array([host] * len(edges), pa.string()), pa.array(bucket[edges], pa.int64()), pa.array([law] * len(edges), pa.int32()), *lists], [x.split()[0] for x in COUNTED.split(", ")])

        for batch in it:
            for host, groups, group, part, c, *own in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if (host, groups, group) != now:
                    if held:
                        yield from emit()
                    held, now = {}, (host, groups, group)
                held.setdefault((c, *own), set()).add(part)
        if held:
            yield from emit()

    def sums(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition holds whole buckets of prints, sorted."""
        held: list[Counted] = []
        now: tuple | None = None

        def emit() -> Iterator[pa.RecordBatch]:
            for part, law, prints, holders in summed(held):
                columns = ([now[0]], [part], [law], [prints], [holders])
                types = (pa.string(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [x.split()[0] for x in TOLD.split(", ")])

        for batch in it:
            for i, at in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if at != now:
                    yield from emit()
                    held, now = [], at
                held.append((batch.column(2)[i].as_py(), *(batch.column(k)[i].values.to_numpy() for k in (3, 4, 5))))
        yield from emit()

    def parse(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches(it, "html"):
            found = [page_of(x) for x in texts]
            blocks, kinds = pa.array(["\n".join(b) for b, _ in found], pa.string()), pa.array(["".join(map(str, k)) for _, k in found], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], blocks, kinds], ["host", "part", "page_id", "url", "blocks", "kinds"])

    def clean(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition holds whole parts of hosts, sorted, what they must know first."""
        told: list[tuple[int, np.ndarray, np.ndarray]] = []
        now, known, pages = None, NOTHING, 0
        types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        for whole in it:
            for a, b in slices(pc.fill_null(pc.binary_length(whole.column(4)), 0).to_pylist()):
                batch, rows = whole.slice(a, b - a), []
                for i, (host, part, page, address, blocks, kinds, law) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True)):
                    if (host, part) != now:
                        now, told, known, pages = (host, part), [], None, 0
                    if law is not None:
                        told.append((law, batch.column(7)[i].values.to_numpy(), batch.column(8)[i].values.to_numpy()))
                        pages = batch.column(9)[i].as_py()
                        continue
                    known = known_from(told, pages) if known is None else known
                    text, repeated, marked = clean_pages([(blocks.split("\n"), list(map(int, kinds))) if kinds else ([], [])], known)[0]
                    rows.append((page, address, text, len(text), repeated, marked))
                columns = list(zip(*rows, strict=True)) or [()] * len(types)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [x.split()[0] for x in TEXTS.split(", ")])

    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)", 1)), F.lit("")).alias("host")
    picked = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html")).select("*", host)
    sized = stage_table(picked.groupBy("host").agg(F.count("*").alias("pages"), F.coalesce(F.sum(F.octet_length("html").cast("long")), F.lit(0)).alias("bytes")), "hosts")
    # Hosts of more than one group: less than one for GROUP pages.
    large = sized.withColumn("groups", F.ceil(F.greatest(F.col("pages") / GROUP, F.col("bytes") / GROUP_BYTES))).where("groups > 1").select("host", "groups")
    groups = F.coalesce("groups", F.lit(1)).cast("long")
    dealt = picked.join(large, "host", "left").select("host", groups.alias("groups"), F.pmod(F.xxhash64("page_id", "url"), groups).alias("part"), "page_id", "url", "html")
    n = parts_for(spark, sized.agg(F.sum("bytes")).first()[0])
    # Pages without a host are compared with none.
    found = map_arrow(dealt.where("host <> ''").select("host", "groups", "part", "html"), outside, OUTSIDE).repartition(n, "host", "group").sortWithinPartitions("host", "group", "class")
    counted = map_arrow(found, runs, COUNTED).repartition(n, "host", "bucket").sortWithinPartitions("host", "bucket")
    told = stage_table(map_arrow(counted, sums, TOLD), "repeats")
    sizes = told.where(F.col("law") == PAGES).select("host", F.get("holders", F.lit(0)).alias("pages"))
    nulls = [F.lit(None).cast(t).alias(c) for c, t in (("page_id", "long"), ("url", "string"), ("blocks", "string"), ("kinds", "string"))]
    shared = told.where(F.col("law") != PAGES).join(sizes, "host", "left").select("host", "part", *nulls, "law", "prints", "holders", F.coalesce("pages", F.lit(0)).alias("pages"))
    rows = map_arrow(dealt.select("host", "part", "page_id", "url", "html"), parse, "host string, part long, page_id long, url string, blocks string, kinds string").unionByName(shared, allowMissingColumns=True)
    return map_arrow(rows.repartition(n, "host", "part").sortWithinPartitions("host", "part", F.col("law").isNull(), "page_id", "url"), clean, TEXTS)


def op6_page_text(spark, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))
