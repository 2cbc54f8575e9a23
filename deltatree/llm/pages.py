"""Main text of web pages: a suffix array of each host says what its pages repeat, markup says where an article is.

A page is read into blocks of text. Elements and class names of menus, headers, footers, side columns, notices, adverts,
forms, comments and the like go with all they hold. The token streams of the blocks of all pages, marked or not, are put into suffix
arrays by host; substrings of ``match`` tokens or more that stand on ``least`` distinct pages of a host are repeats. Tokens that repeats
cover go, and unique runs stay. Markup is a check that follows: if a page marks its article, and that holds at least half of the words,
the article's blocks are the text, and only a template's repeats go from them: those on ``TEMPLATE`` pages and half of the
host's pages, since some pages may well carry the same article. Pages of the same blocks count once, and so do near-whole
copies of each other (components of a Jaccard similarity of 0.8), so what only copies share stays.

Each task orders the suffixes of the pages it has in hand by doubling, with their common prefixes. Suffixes that share ``match`` tokens or more are an interval;
what a longer repeat covers is what the intervals along it cover, so its head of ``match`` tokens is all that is sent on. Heads travel packed by bucket,
where the intervals of all tasks meet; a host with a third of all pages isn't gathered anywhere. What comes back to a page is the list of its
own repeated heads, and those are counted again by their whole hashes and by near-copies.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltatree.llm import arrays as A
from deltatree.llm import jaccard
from deltatree.llm.jaccard import runs
from deltatree.llm.urls import host_and_path
from deltatree.session import cut_lineage, cut_lineage_by

#: Tokens of a repeat; a shorter block repeats as a whole.
MATCH = 8
#: A block goes if repeats cover so much of it.
COVERED = 0.8
#: Pages, without copies and near-copies, that make a repeat: two may quote each other or share a heading.
LEAST = 3
#: Pages, without copies and near-copies, and half of the host's, that make a repeat a template's, which goes from a marked article too.
TEMPLATE = 10
#: Heads that one bucket holds, about.
BUCKET = 2_000_000
#: Buckets of the written pages, and input partitions for each further one: joins by row read them as they lie, so texts are never shuffled.
PAGE_BUCKETS, PARTITIONS = 16, 8
#: Near-copies: shingles of five words, a similarity of 0.8.
SHINGLE, PERCENT = 5, 80

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
_PARTS = re.compile(r"[-_]+")

_RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "title", "svg", "object", "xmp"}
_DROPPED = {"nav", "footer", "aside", "form", "head", "button", "select", "dialog", "menu", "fieldset", "canvas", "audio", "video"} | _RAW
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {"address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5",
          "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
_BOILERPLATE = set("""ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies
disqus footer login menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promotion related search share sharing sidebar signup
social sponsor sponsored subscribe toolbar widget""".split())
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_MAIN = {"article", "content", "entry", "main", "post", "story"}


def _attributes(text: str) -> dict[str, str]:
    """Attributes by name; of a repeated one the first counts."""
    found: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), html.unescape(value.strip("\"'")))
    return found


def _hidden(attributes: dict[str, str]) -> bool:
    return ("hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true"
            or bool(_NO_DISPLAY.search(attributes.get("style", ""))))


def _names(attributes: dict[str, str], ids: bool = True) -> set[str]:
    """The whole names in ``class`` and ``role``, and in ``id`` if asked for."""
    return {w for n in ("class", "role", *(["id"] if ids else ())) for w in attributes.get(n, "").lower().split()}


def _among(names: set[str], known: set[str]) -> bool:
    """Whether a name is known, or put together from known ones alone: ``cookie-notice``, but not ``share-price``."""
    return any(name in known or all(part in known for part in _PARTS.split(name)) for name in names)


def read_page(page: str) -> tuple[list[str], bool]:
    """The blocks that can be main text, in page order, and whether the page marks them as its article."""
    blocks, mine, marked = page_blocks(page)
    return [b for b, inside in zip(blocks, mine, strict=True) if inside or not marked], marked


def page_blocks(page: str) -> tuple[list[str], list[bool], bool]:
    """All blocks outside boilerplate elements, which of them a mark holds, and whether the page marks its article.

    A mark counts if what it holds has at least half of the words: a teaser or a byline doesn't stand for the page.
    """
    blocks: list[tuple[str, bool]] = []
    words: list[str] = []
    skip, skip_depth = "", 0  # name of the dropped element that is open, and how many of that name
    inside: list[tuple[str, int]] = []  # open main elements: name and how many of that name are open within
    at = marked = 0

    def flush() -> None:
        text = " ".join(html.unescape("".join(words)).split()) if words else ""
        words.clear()
        if text:
            blocks.append((text, bool(inside)))

    for m in _TAG.finditer(page):
        if m.start() < at:
            continue
        if not skip and m.start() > at:
            words.append(page[at:m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if not closing and name in _RAW:
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            # title and the like hold no article; without an end tag nothing is lost but the element's own text
            at = end.end() if end else (len(page) if name in ("script", "style") else at)
            continue
        if skip:
            # an article that begins inside something never closed is an article all the same
            begins = not closing and name in ("article", "main") and not marked and not inside and not _among(_names(_attributes(attributes)), _BOILERPLATE)
            if not begins:
                if name == skip and not attributes.endswith("/"):
                    skip_depth += -1 if closing else 1
                    if not skip_depth:
                        skip = ""
                continue
            skip = ""
        if name in _BLOCK or name in _DROPPED:
            flush()
        elif name == "br":
            words.append(" ")
        if closing:
            while inside and any(n == name for n, _ in inside):
                n, depth = inside[-1]
                if n != name:
                    if name in ("article", "main", "body", "html"):
                        inside.pop()
                        continue
                    break
                inside[-1] = (n, depth - 1)
                if depth == 1:
                    inside.pop()
                break
            continue
        if name in _VOID or attributes.endswith("/"):
            continue
        given = _attributes(attributes) if attributes else {}
        called = _names(given)
        # an id of a heading, or of anything in an article, is where a link leads to; a heading in an article is part of it
        dull = not (inside and name in _HEADINGS) and _among(_names(given, ids=not inside and name not in _HEADINGS), _BOILERPLATE)
        if name in _DROPPED or (name == "header" and not inside) or dull or _hidden(given):
            if name not in ("body", "html", "article", "main") or (name in ("article", "main") and dull):
                flush()
                skip, skip_depth = name, 1
                continue
        if name in ("article", "main") or (name in ("div", "section", "td") and _among(called, _MAIN)):
            inside.append((name, 1))
            marked = 1
        elif inside and inside[-1][0] == name:
            inside[-1] = (name, inside[-1][1] + 1)
    if not skip and at < len(page):
        words.append(page[at:])
    flush()
    words_of = [len(b.split()) for b, _ in blocks]
    held = sum(n for n, (_, mine) in zip(words_of, blocks, strict=True) if mine)
    return [b for b, _ in blocks], [mine for _, mine in blocks], held > 0 and 2 * held >= sum(words_of)


def tokens(blocks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every token, and the offsets of the blocks into them."""
    text, at = A.text_bytes(pa.array(blocks, pa.large_string()))
    data = np.frombuffer(text, np.uint8)
    starts, ends, words = A.word_spans(data, at, np.arange(256) != 0x20)
    return A.span_hashes(data, starts, ends), words


def heads(blocks: list[str], match: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash of the ``match`` tokens from each place of a block, and the offsets of the blocks into hashes and tokens."""
    hashes, words = tokens(blocks)
    found, of = A.windows(hashes, words, match)
    return found, of, words


def _numbered(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1].astype(np.int64)


def suffix_array(hashes: np.ndarray, offsets: np.ndarray, host: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the suffixes of all blocks, ordered by host and first ``depth`` tokens, and each one's common prefix with the one before it.

    ``host`` numbers the host of each block. A block ends in a mark that comes before every token, and no prefix goes beyond it. Ranks are doubled: those of ``2 * k`` tokens are pairs of
    those of ``k``. Of hosts that differ, and of the first suffix, the prefix is -1.
    """
    n = hashes.size
    lengths = np.diff(offsets)
    left = np.repeat(offsets[1:], lengths) - np.arange(n)  # tokens to the end of the block
    of = np.repeat(host, lengths)
    levels = [(1, _numbered(hashes) + 1)]
    # ranks of as many tokens as the binary digits of the depth ask for
    while 2 * levels[-1][0] <= depth:
        k, rank = levels[-1]
        levels.append((2 * k, _numbered(rank * (n + 1) + _shifted(rank, left, k)) + 1))
    order = of.astype(np.int64)
    at, parts = 0, []
    for k, rank in reversed(levels):
        if at + k <= depth:
            parts.append(_shifted(rank, left, at) if at else rank)
            at += k
    array = np.lexsort((*reversed(parts), order))
    common = np.zeros(n, np.int64)
    a, b = array[:-1].copy(), array[1:].copy()
    done = np.zeros(a.size, np.int64)
    for k, rank in reversed(levels):
        here = (np.minimum(left[array[:-1]], left[array[1:]]) - done >= k) & (done + k <= depth)
        here[here] = rank[a[here]] == rank[b[here]]
        done[here] += k
        a[here] = np.minimum(a[here] + k, n - 1)
        b[here] = np.minimum(b[here] + k, n - 1)
    common[1:] = np.where(of[array[1:]] == of[array[:-1]], done, -1)
    common[:1] = -1
    return array, common


def _shifted(rank: np.ndarray, left: np.ndarray, k: int) -> np.ndarray:
    """The rank ``k`` places on, 0 beyond the block."""
    out = np.zeros(rank.size, np.int64)
    out[:max(0, rank.size - k)] = rank[k:]
    out[left <= k] = 0
    return out


def intervals(hashes: np.ndarray, offsets: np.ndarray, host: np.ndarray, match: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of suffixes in their order, and the number of the interval of each: suffixes with ``match`` tokens in common, or blocks of fewer that are equal.

    A suffix of fewer tokens that doesn't begin a block is in none and left out.
    """
    array, common = suffix_array(hashes, offsets, host, match)
    lengths = np.diff(offsets)
    left = (np.repeat(offsets[1:], lengths) - np.arange(hashes.size))[array]
    begins = np.zeros(hashes.size, bool)
    begins[offsets[:-1][lengths > 0]] = True
    whole = np.minimum(left, match)
    # suffixes of equal length, below match, with all of it in common are next to each other
    same = np.zeros(array.size, bool)
    same[1:] = (whole[1:] == whole[:-1]) & (common[1:] >= whole[1:])
    number = np.cumsum(~same)
    keep = (left >= match) | begins[array]
    return array[keep], number[keep]


def _packed(batches: Iterable[pa.RecordBatch], match: int, most: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """The heads of the intervals in hand by bucket, grouped by the pages that have them; a page with unmarked text says so in its last bit."""
    names: dict[str, int] = {}
    held: list[tuple[int, int, list[str]]] = []
    total = 0

    def flush() -> Iterator[pa.RecordBatch]:
        host = [number for number, _, blocks in held for _ in blocks]
        owner = [i for i, (_, _, blocks) in enumerate(held) for _ in blocks]
        hashes, offsets = tokens([b for _, _, blocks in held for b in blocks])
        if not hashes.size:
            return
        place, number = intervals(hashes, offsets, np.array(host), match)
        page = np.repeat(np.array(owner), np.diff(offsets))[place]
        first = jaccard._starts(number)
        # the hash of an interval's head: of match tokens, or of a whole block of fewer
        windows, of = A.windows(hashes, offsets, match)
        block = np.searchsorted(offsets, place[first], "right") - 1
        head = _key(windows[of[block] + place[first] - offsets[block]], np.array([_host(x) for x in names], np.uint64)[np.array(host)[block]])
        head = np.repeat(head, np.diff(np.append(first, number.size)))
        bucket, low = jaccard._spread(head, buckets), head.astype(np.uint32)
        order = np.lexsort((low, page, bucket))
        order = order[jaccard._starts(bucket[order], page[order], low[order])]
        bucket, page, low = bucket[order], page[order], low[order]
        first, counts = jaccard._groups(bucket, page)
        used, cut = jaccard._cuts(bucket, buckets)
        _, group = jaccard._cuts(bucket[first], buckets)
        rows = np.array([r for _, r, _ in held], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), jaccard._blobs(low, used, cut), jaccard._blobs(rows[page[first]], used, group),
                                          jaccard._blobs(counts, used, group)], ["bucket", "heads", "rows", "counts"])

    for batch in batches:
        for host, row, blocks, unmarked in zip(*(batch.column(c).to_pylist() for c in ("host", "row", "blocks", "open")), strict=True):
            held.append((names.setdefault(host, len(names)), 2 * row + unmarked, blocks))
            total += sum(b.count(" ") + 1 for b in blocks)
            if total >= most:
                yield from flush()
                names, held, total = {}, [], 0
    if held:
        yield from flush()


def _host(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little")


def _key(head: np.ndarray, host: np.ndarray) -> np.ndarray:
    return A.mix(head ^ host)


def _meet(batches: Iterable[pa.RecordBatch], least: int, template: int) -> Iterator[pa.RecordBatch]:
    """The heads, by page, that stand on ``least`` pages, one of them with unmarked text, or on ``template`` pages."""
    for bucket, cols in runs(batches, "bucket", ("heads", "rows", "counts")):
        row = np.repeat(jaccard._joined(cols["rows"], np.int64), jaccard._joined(cols["counts"], np.uint16))
        low = jaccard._joined(cols["heads"], np.uint32)
        order = np.argsort(low, kind="stable")
        low, row = low[order], row[order]
        first = jaccard._starts(low)
        n = np.diff(np.append(first, low.size))
        unmarked = np.bitwise_or.reduceat(row & 1, first) > 0 if first.size else np.zeros(0, bool)
        keep = np.repeat((n >= template) | ((n >= least) & unmarked), n)
        low, row = low[keep], row[keep] >> 1
        order = np.argsort(row, kind="stable")
        low, row = low[order], row[order]
        first = jaccard._starts(row)
        for at in range(0, first.size, 10_000):
            some = first[at:at + 10_000]
            ends = np.append(first, row.size)[at + 1:at + 1 + some.size]
            yield pa.RecordBatch.from_arrays([pa.array(row[some], pa.int64()), pa.array(np.full(some.size, bucket), pa.int32()),
                                              pa.array([low[i:j].tobytes() for i, j in zip(some, ends, strict=True)], pa.binary())], ["row", "bucket", "heads"])


def unique_runs(blocks: list[str], repeated: set[int], match: int, covered: float) -> list[str]:
    """What repeats leave of the blocks: unique runs of tokens, of a block that repeats cover almost whole nothing."""
    if not repeated:
        return blocks
    hashes, of, words = heads(blocks, match)
    known = np.fromiter(repeated, np.int64, len(repeated))
    hit = np.isin(hashes.view(np.int64), known)
    out = []
    for b, block in enumerate(blocks):
        n = int(words[b + 1] - words[b])
        places = np.flatnonzero(hit[of[b]:of[b + 1]])
        if not places.size:
            out.append(block)
            continue
        depth = np.zeros(n + 1, np.int64)
        np.add.at(depth, places, 1)
        np.add.at(depth, np.minimum(n, places + match), -1)
        gone = np.cumsum(depth[:-1]) > 0
        if gone.mean() < covered:
            out.append(" ".join(w for w, g in zip(block.split(" "), gone, strict=True) if not g))
    return out


def main_text(pages: DataFrame, match: int = MATCH, covered: float = COVERED, most: int = 500_000, least: int = LEAST, template: int = TEMPLATE) -> DataFrame:
    """One row per page: ``page_id``, ``url``, ``text`` (blocks joined by a line feed) and ``n_chars`` (its code points).

    Character references are decoded, white space inside a block becomes one space, ``br`` counts as white space. Needs ``page_id``, ``url`` and ``html``.

    * A null or empty page, and one without main text, has an empty text. Pages are read whole; a cut-off tag at the end is dropped.
    * Repeats are found over the blocks of all pages of a host. A page that marks its article (``article``, ``main``, or such a class) and has half of its words or more in it keeps all of it but
      repeats on ``template`` distinct pages and half of the host's: some pages may carry the same article.
    * Pages with a null URL, or one without ``://``, are of the host with no name. Each row gives a row; repeated rows and other copies count as one page.
    * No pages: no rows. Other columns are ignored, whatever their names.
    """
    plain = pages.select("page_id", "url", host_and_path(F.col("url"))[0].alias("host"), "html")

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in A.slices(batch, "html"):
                found = [page_blocks(h or "") for h in part.column("html").to_pylist()]
                hosts = part.column("host").to_pylist()
                content = [hashlib.blake2b("\n".join([n, f"{marked:d}" + "".join(f"{i:d}" for i in mine), *b]).encode(), digest_size=16).digest()
                           for n, (b, mine, marked) in zip(hosts, found, strict=True)]
                yield pa.RecordBatch.from_arrays([
                    part.column("page_id"), part.column("url"), part.column("host"), pa.array([b for b, _, _ in found], pa.list_(pa.string())),
                    pa.array([mine for _, mine, _ in found], pa.list_(pa.bool_())), pa.array([marked for _, _, marked in found], pa.bool_()),
                    pa.array(content, pa.binary())], ["page_id", "url", "host", "blocks", "mine", "marked", "content"])

    done = plain.withColumn("page_id", F.col("page_id").cast("long")).mapInArrow(
        read, "page_id long, url string, host string, blocks array<string>, mine array<boolean>, marked boolean, content binary")
    # rows are numbered before they are written, and read with their numbers from then on
    parts = max(PAGE_BUCKETS, pages.rdd.getNumPartitions() // PARTITIONS)
    done = cut_lineage_by(done.withColumn("row", F.monotonically_increasing_id()), "pages", "row", parts, compression="zstd")
    # one row of each content stands for all
    first = cut_lineage(done.groupBy("content").agg(F.min("row").alias("row")), "first")
    each = done.join(first.select("row").hint("shuffle_hash"), "row", "left_semi").select("host", "row", "blocks", (~F.col("marked") & (F.size("blocks") > 0)).cast("int").alias("open"))
    size = done.agg(F.sum(F.aggregate("blocks", F.lit(0).cast("long"), lambda n, b: n + F.length(b)))).first()[0] or 0
    buckets = int(min(1 << 20, max(int(done.sparkSession.conf.get("spark.sql.shuffle.partitions")), size / 6 / BUCKET)))
    packed = each.mapInArrow(lambda b: _packed(b, match, most, buckets), "bucket int, heads binary, rows binary, counts binary")
    shared = cut_lineage(packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        lambda b: _meet(b, least, template), "row long, bucket int, heads binary"), "shared")
    if shared.isEmpty():
        lists = shared.select("row", F.lit(None).cast("array<bigint>").alias("heads"), F.lit(None).cast("array<bigint>").alias("templates"))
    else:
        of_host = each.groupBy("host").agg(F.count("*").alias("n_pages"))
        lists = _repeats(done.select("row", "host", "blocks"), of_host, shared, match, least, template, buckets)

    def clean(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for blocks, mine, marked, some, often in zip(*(batch.column(c).to_pylist() for c in ("blocks", "mine", "marked", "heads", "templates")), strict=True):
                blocks = [b for b, inside in zip(blocks, mine, strict=True) if inside or not marked]
                texts.append("\n".join(unique_runs(blocks, set((often if marked else some) or ()), match, covered)))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    # the lists go from the row that stands for a content to all rows of it
    named = lists.join(first, "row").select("content", "heads", "templates")
    named = cut_lineage(done.select("row", "content").join(named, "content").select("row", "heads", "templates"), "lists")
    return done.join(named, "row", "left").select("page_id", "url", "blocks", "mine", "marked", "heads", "templates").mapInArrow(
        clean, "page_id long, url string, text string").withColumn("n_chars", F.char_length("text").cast("long"))


def _repeats(pages: DataFrame, of_host: DataFrame, shared: DataFrame, match: int, least: int, template: int, buckets: int) -> DataFrame:
    """Rows ``(row, heads, templates)``: the heads of a page that are repeats, and those of them that are a template's."""
    back = shared.groupBy("row").agg(F.collect_list(F.struct("bucket", "heads")).alias("back"))  # bounded by the length of the page

    def places(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, found = batch.column("host").to_pylist(), []
            for host, blocks, back in zip(hosts, batch.column("blocks").to_pylist(), batch.column("back").to_pylist(), strict=True):
                mine = np.unique(heads(blocks, match)[0])
                key = _key(mine, np.array([_host(host)], np.uint64))
                known = np.concatenate([(np.uint64(x["bucket"]) << np.uint64(32)) | np.frombuffer(x["heads"], np.uint32).astype(np.uint64) for x in back])
                here = (jaccard._spread(key, buckets).astype(np.uint64) << np.uint64(32)) | (key & np.uint64(0xFFFFFFFF))
                found.append(mine[np.isin(here, known)].view(np.int64))
            n = [x.size for x in found]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(batch.column("row").to_numpy(), n), pa.int64()), pa.array(np.repeat(np.array(hosts, object), n), pa.string()),
                pa.array(np.concatenate([*found, np.zeros(0, np.int64)]), pa.int64())], ["row", "host", "head"])

    # written, so that a head that very many pages share can be split in the joins
    found = cut_lineage(pages.join(back, "row").mapInArrow(places, "row long, host string, head long"), "heads")
    near = jaccard.jaccard_components(pages.join(found.select("row").distinct().hint("shuffle_hash"), "row", "left_semi").select(
        F.col("row").alias("doc_id"), F.array_join("blocks", "\n").alias("text")), SHINGLE, PERCENT).select(F.col("doc_id").alias("row"), "component_id")
    often = (F.col("count") >= template) & (2 * F.col("count") >= F.col("n_pages"))
    repeats = cut_lineage(found.join(near, "row").select("host", "head", "component_id").distinct().groupBy("host", "head").count().where(
        F.col("count") >= least).join(of_host, "host").select("host", "head", often.alias("often")), "repeats")
    return found.join(repeats, ["host", "head"]).groupBy("row").agg(  # bounded by the length of the page
        F.collect_set("head").alias("heads"), F.collect_set(F.when(F.col("often"), F.col("head"))).alias("templates"))
