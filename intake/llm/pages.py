"""Operator 9: main text of web pages, by markup and by a suffix array over each host's pages.

1. A page is read into blocks of text. Markup decides most: scripts, styles, menus, headers, footers,
   sidebars, notices, adverts, forms and reader comments go by element, role or a word of class or id; the
   article (or else the main element) is content. A page without either has undecided blocks.
2. The token streams of what isn't article are laid end to end per host, batch by batch, and sorted as
   suffixes (prefix doubling). Neighbours that share ``RUN`` tokens or more are repeats; each task gives every
   repeated or single window of ``RUN`` tokens once, with how many streams hold it. Spark sums the windows of
   a host over all batches, which finds the repeats that span them: the windows of a run of
   ``RUN`` tokens or more are exactly what suffixes share. Pages of a host with the same stream count once,
   and what counts as repeated grows with the host's distinct streams.
3. Undecided blocks that repeated windows mostly cover go; the other blocks stay, in page order.

A host may hold a third of all pages: its pages are never gathered, only its distinct windows are summed.

Defined results: null or empty html has the empty text; a null url is its own host; repeated rows are read one by one;
an empty table gives an empty table; only the columns named in ``keep`` stay.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from intake.llm.common import cut, list_array, map_slices

#: Tokens of the shortest run that counts as repeated, the streams that must hold it, and the covered share from which a block goes.
RUN, STREAMS, COVERED = 5, 3, 0.6
#: The share of a host's distinct streams that must hold a repeated run as well, so that ordinary phrases don't become repeats as a host grows.
SHARE = 0.1
ARTICLE, UNDECIDED, DROPPED = 0, 1, 2

# Names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe object canvas select".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
BOILERPLATE = frozenset("nav footer aside form menu dialog button search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of class or id that mark what isn't the article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer copyright sidebar side aside cookie cookies consent gdpr notice notices banner alert popup modal overlay newsletter subscribe signup login comment comments respond replies reply disqus share sharing social related recommended pagination pager widget toolbar".split()
)
#: Words that say nothing of what an element holds, as parts of a class beside a word of ``MARKS``.
NEUTRAL = frozenset("bar block box btn button buttons container content count form group icon icons inner item items label link links list module outer panel row section slot space text thread title top bottom left right unit wrap wrapper area zone the".split())
#: Elements that hold a piece of text rather than a part of the page.
TEXTS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th tr figcaption caption a b i em strong span small sub sup code cite q abbr time mark".split())
_TAG = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
#: A tag whose quotes are not heeded, for what follows a tag with quotes that never close.
_LOOSE = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|$)""", re.I)
_NAME = re.compile(r"[a-z]+")
_HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", re.I)


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found.group(1).lower() if found else ""


def _says(value: str, name: str, inside: bool) -> bool:
    """Whether a class or id marks what isn't the article. In the article a word of ``MARKS`` alone doesn't: a class must hold nothing else that means something, and for a text all classes must."""
    if not inside:
        return not MARKS.isdisjoint(_NAME.findall(value))
    said = [bool(words) and not MARKS.isdisjoint(words) and all(w in MARKS or w in NEUTRAL for w in words) for words in map(_NAME.findall, value.split())]
    return bool(said) and (all(said) if name in TEXTS else any(said))


def _marked(name: str, attributes: str, inside: bool) -> bool:
    """Whether an element's name or attributes say that it isn't article text; ``inside``: it stands in the article."""
    if name in BOILERPLATE or (name == "header" and not inside):
        return True
    for key, *values in _ATTR.findall(attributes) if attributes else ():
        value = "".join(values).lower()
        key = key.lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
            return True
        if (key == "role" and value in ROLES) or (key in ("class", "id") and _says(value, name, inside)):
            return True
    return False


def blocks(page: str | None) -> list[tuple[str, int]]:
    """The blocks of a page in order with their kind. The page is read forwards once, broken or not."""
    page = page or ""
    found: list[tuple[str, bool, str]] = []
    parts: list[str] = []
    # open elements: name, whether it or one around it is marked, the root it stands in
    stack: list[tuple[str, bool, str]] = []
    marked, root, at = False, "", 0
    counts: dict[str, int] = {}
    tag_of, last, seek = _TAG, page.rfind(">"), 0

    def end() -> None:
        text = "".join(parts)
        parts.clear()
        text = " ".join((entities.unescape(text) if "&" in text else text).split())
        if text:
            found.append((text, marked, root))

    def back(k: int) -> None:
        nonlocal marked, root
        for name, _, _ in stack[k:]:
            counts[name] -= 1
        del stack[k:]
        marked, root = (stack[-1][1], stack[-1][2]) if stack else (False, "")

    while (start := page.find("<", seek)) >= 0 and (start < last or page.startswith("<!--", start)):
        tag = tag_of.match(page, start)
        if not tag and tag_of is _TAG and page[start + 1 : start + 3].lstrip("/")[:1].isalpha():
            tag_of = _LOOSE
            tag = tag_of.match(page, start)
        if not tag:
            seek = start + 1
            continue
        parts.append(page[at:start])
        at = seek = tag.end()
        if not tag[2]:
            continue
        name = tag[2].lower()
        if name in BLOCKS:
            end()
        elif name == "br":
            parts.append(" ")
        if tag[1] and counts.get(name):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    back(k)
                    break
        elif tag[1]:
            pass  # nothing of that name is open
        elif name in RAW:
            close = re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.I).search(page, at)
            at = seek = len(page) if not close else page.find(">", close.end()) + 1 or len(page)
        elif name not in VOID:
            if name in BLOCKS and stack and stack[-1][0] == "p":
                back(len(stack) - 1)
            if name in ("article", "main") and any(counts.get(e) for e in ("nav", "header", "menu")):
                marked = False  # these hold no article: their end is missing
            now = marked or _marked(name, tag[3], root == "article")
            if name in ("article", "main") and root != "article":
                root = name
            marked = now
            stack.append((name, marked, root))
            counts[name] = counts.get(name, 0) + 1
    # a "<" without an end is text, unless a tag begins there
    rest = page[at:]
    parts.append(rest[: cut_at] if (cut_at := _open_tag(rest)) >= 0 else rest)
    end()
    for wanted in ("article", "main"):
        if any(r == wanted and not m for _, m, r in found):
            # main holds the article: where there is an article, the rest of main is not
            return [(t, ARTICLE if r == wanted and not m else DROPPED) for t, m, r in found]
        if any(r == wanted for _, _, r in found) and not any(not m for _, m, _ in found):
            return [(t, ARTICLE if r == wanted else DROPPED) for t, _, r in found]
    return [(t, DROPPED if m else UNDECIDED) for t, m, _ in found]


def _open_tag(text: str) -> int:
    found = re.search(r"<(?:[a-zA-Z/!?])", text)
    return found.start() if found else -1


def suffix_order(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``ids`` in order of their first ``RUN`` tokens or more, and their ranks there, by prefix doubling."""
    rank, k = np.unique(ids, return_inverse=True)[1].astype(np.int64), 1
    while True:
        order = np.lexsort((np.r_[rank[k:], np.full(min(k, len(rank)), -1)], rank))
        pair = np.stack([rank, np.r_[rank[k:], np.full(min(k, len(rank)), -1)]])[:, order]
        new = np.zeros(len(rank), np.int64)
        new[order] = np.cumsum(np.r_[0, (np.diff(pair) != 0).any(0)])
        rank, k = new, 2 * k
        if k >= RUN or rank.max(initial=0) == len(rank) - 1:
            return order, rank


def window_hashes(tokens: list[str]) -> np.ndarray:
    """A 63-bit hash of each run of ``RUN`` tokens."""
    return np.array([xxhash.xxh64_intdigest(" ".join(tokens[i : i + RUN])) >> 1 for i in range(len(tokens) - RUN + 1)], np.int64)


def host_windows(streams: list[list[str]]) -> dict[int, int]:
    """Windows of ``RUN`` tokens of a host's distinct streams with the number of streams that hold each, from their suffix array."""
    if not streams:
        return {}
    number: dict[str, int] = {}
    ids, owner, start = [], [], []
    for s, tokens in enumerate(streams):
        start.append(len(ids))
        ids += [number.setdefault(t, len(number)) for t in tokens]
        ids.append(-1 - s)  # an end of its own, so that no run crosses pages
        owner += [s] * (len(tokens) + 1)
    flat, owner = np.array(ids, np.int64), np.array(owner)
    order, _ = suffix_order(flat)
    padded = np.r_[flat, np.full(RUN, np.iinfo(np.int64).min)]
    heads = np.stack([padded[order + j] for j in range(RUN)])
    whole = (heads >= 0).all(0)
    order, heads = order[whole], heads[:, whole]
    if not len(order):
        return {}
    # suffixes in order: a new group begins where the first RUN tokens differ from the suffix before
    group = np.cumsum(np.r_[0, (np.diff(heads) != 0).any(0)])
    pairs = np.unique(np.stack([group, owner[order]]), axis=1)
    count = np.bincount(pairs[0])
    first = order[np.r_[0, np.flatnonzero(np.diff(group)) + 1]]
    out = {}
    for g, f in enumerate(first):
        s = owner[f]
        tokens = streams[s][f - start[s] : f - start[s] + RUN]
        out[xxhash.xxh64_intdigest(" ".join(tokens)) >> 1] = int(count[g])
    return out


def _stream(parts: list[tuple[str, int]]) -> list[str]:
    """The tokens of all blocks but the article's."""
    return [w for t, k in parts if k != ARTICLE for w in t.split()]


def _undecided(parts: list[tuple[str, int]]) -> bool:
    return any(k == UNDECIDED for _, k in parts)


def main_text(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The columns ``keep`` with ``text`` (blocks joined by a line feed) of every page.

    Pages are read anew in each pass rather than stored: reading costs less than writing all blocks. A page is known
    by 128 bits of hash over its url and html, so that no pass depends on the order of rows.
    """
    kept = pages.select(*keep).schema.fields
    names = [f.name for f in kept]
    url, page = F.col(url_col).cast("string"), F.col(html_col)
    given = pages.select(*keep, url.alias("_url_in"), page.alias("_html_in"), F.xxhash64(url, page).alias("_k1"), F.xxhash64(F.lit("page"), url, page).alias("_k2"))

    def read():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = list({(host_of(u), " ".join(_stream(blocks(h)))): None for u, h in zip(*(c.to_pylist() for c in batch.columns), strict=True)})
            return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows if r[1]], pa.string()) for j in range(2)], ["_host", "_stream"])

        return work

    def find():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            hosts: dict[str, list[list[str]]] = {}
            for h, stream in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                hosts.setdefault(h, []).append(stream.split())
            rows = [(h, w, n) for h, streams in hosts.items() for w, n in host_windows(streams).items()]
            return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["_host", "w", "n"])

        return work

    streams = cut(map_slices(given.select("_url_in", "_html_in"), "_host string, _stream string", read, 4096).distinct())
    windows = map_slices(streams, "_host string, w long, n long", find, 4096).groupBy("_host", "w").agg(F.sum("n").alias("n")).where(F.col("n") >= STREAMS)
    hosts = streams.groupBy("_host").count()
    repeated = cut(windows.join(hosts, "_host").where(F.col("n") >= SHARE * F.col("count")).select("_host", "w"))

    def where():
        """Windows of pages with undecided blocks by their place in the page's stream."""

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[tuple[int, int, str, int, int]] = []
            for u, h, k1, k2 in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if _undecided(parts := blocks(h)):
                    out += [(k1, k2, host_of(u), int(w), i) for i, w in enumerate(window_hashes(_stream(parts)))]
            return pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32()))], ["_k1", "_k2", "_host", "w", "at"])

        return work

    placed = map_slices(given.select("_url_in", "_html_in", "_k1", "_k2"), "_k1 long, _k2 long, _host string, w long, at int", where)
    covered = placed.join(repeated, ["_host", "w"]).groupBy("_k1", "_k2").agg(F.collect_set("at").alias("_at"))
    text = T.StructField("text", T.StringType())

    def decided():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            read = [blocks(h) for h in batch.column(len(kept)).to_pylist()]
            mine = pa.array([not _undecided(b) for b in read], pa.bool_())
            texts = pa.array(["\n".join(t for t, k in b if k == ARTICLE) for b in read], pa.string())
            return pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], texts], [*names, "text"]).filter(mine)

        return work

    def open_blocks():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            read = [blocks(h) for h in batch.column(len(kept)).to_pylist()]
            mine = pa.array([_undecided(b) for b in read], pa.bool_())
            sizes = [len(b) for b in read]
            out = [*batch.columns[: len(kept)], *batch.columns[len(kept) + 1 :], list_array([t for b in read for t, _ in b], sizes, pa.string()), list_array([k for b in read for _, k in b], sizes, pa.int32())]
            return pa.RecordBatch.from_arrays(out, [*names, "_k1", "_k2", "_blocks", "_kinds"]).filter(mine)

        return work

    def join():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = []
            for parts, kinds, at in zip(*(c.to_pylist() for c in batch.columns[len(kept) :]), strict=True):
                hit = {i + j for i in at or () for j in range(RUN)}
                place, left = 0, []
                for t, kind in zip(parts, kinds, strict=True):
                    n = 0 if kind == ARTICLE else len(t.split())
                    if kind == ARTICLE or (kind == UNDECIDED and sum(i in hit for i in range(place, place + n)) < COVERED * n):
                        left.append(t)
                    place += n
                texts.append("\n".join(left))
            return pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(texts, pa.string())], [*names, "text"])

        return work

    keys = [T.StructField(k, T.LongType()) for k in ("_k1", "_k2")]
    lists = [T.StructField("_blocks", T.ArrayType(T.StringType())), T.StructField("_kinds", T.ArrayType(T.IntegerType()))]
    opened = map_slices(given.select(*names, "_html_in", "_k1", "_k2"), T.StructType([*kept, *keys, *lists]), open_blocks)
    settled = map_slices(given.select(*names, "_html_in"), T.StructType([*kept, text]), decided)
    judged = map_slices(opened.join(covered, ["_k1", "_k2"], "left").select(*names, "_blocks", "_kinds", "_at"), T.StructType([*kept, text]), join)
    return settled.union(judged)
