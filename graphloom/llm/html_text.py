"""Main text of HTML pages by differencing each page with its nearest neighbour.

Pages are cut into text lines, one for each block, and each line knows whether it lies in an article and whether an
element around it is a menu, a form, an advert or the like. Within a host, the pages' distinct (path, content) are put
in order by a range partition; a page's mate is the one of its two neighbours whose path shares the longer beginning
(the earlier one if they are level). The mates' lines are aligned by longest common subsequence, and a line that both
have is deleted from each. So are lines in boilerplate elements. One kind of line is never deleted for being shared: those
of a page's article, for two pages may quote the same paragraph, and near copies of an article share almost all of it.
All else stays, inside and outside of articles. A mate with the very same lines is a copy and deletes nothing. Class and
role words that mark boilerplate do not hide an article inside the marked element, unless another article lies outside of
all such elements; an article that is marked as a comment itself is one.

Marks are whole names made of marking words (`ad-slot`, `site-footer`), not words in other names (`share-price`); ids count
outside of articles only, and on a page without an article no mark hides the element that holds most of the text.

Null and empty pages give an empty text; null URLs and URLs without `://` have an empty host and path. Pages without a
mate keep what is not boilerplate. Repeated pages get equal texts, and ties between neighbours go to the earlier one.
Pages of any length are read whole. An empty table gives no rows. Other columns of pages are not read, so none can clash;
the key may have any name but `url` and `text`.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, materialise, no_clash, table
from .url_filter import split_url

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Elements whose content is never text, elements that are boilerplate, blocks, and elements that never have an end (fixed values).
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "textarea", "title", "head", "object", "canvas", "video", "audio"}
BOILER = {"nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "header"}
BLOCKS = set("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id, role and label that mark boilerplate, and words that only say what sort of box or place it is (fixed values).
MARKS = set("ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promos promotion promotions banner cookie cookies consent gdpr notice notices popup modal overlay menu nav navbar navigation breadcrumb breadcrumbs sidebar footer masthead contentinfo complementary search comment comments disqus respond reply replies newsletter subscribe signup login share sharing social related recommended widget widgets pagination pager toolbar skip".split())
PLACES = set("area bar block bottom box button buttons card cards col column container content div feed form global group header icon icons inline inner item items left link links list main mobile module outer page panel post posts primary region right row secondary section site slot strip this top unit wrap wrapper".split())


def is_mark(token: str) -> bool:
    """Whether a class name, as site-footer or ad_slot2, is made of words that mark boilerplate and such as name a place; at least one marks it."""
    words = [w for w in re.split("[^a-z]+", re.sub("([a-z])([A-Z])", r"\1-\2", token).lower()) if w]
    return any(w in MARKS for w in words) and all(w in MARKS or w in PLACES for w in words)


#: Words that make an article a reader's comment (fixed values).
COMMENTS = re.compile(r"(?:^|[^a-z])(?:comments?|disqus|respond|reply|replies)(?:[^a-z]|$)")
#: An end tag closes open elements up to its own start, but not past these.
CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
IN_ARTICLE, IS_BOILER = 1, 2
#: While a page is read: inside an element that is boilerplate by its name, and in an article that only marks make boilerplate.
_BY_NAME, _HELD = 4, 8


def page_lines(page: str) -> list[tuple[str, int]]:
    """(line, flags) of each block that has text, in order."""
    out: list[tuple[str, int, int]] = []
    stack: list[tuple[str, int, int]] = []
    buffer: list[str] = []
    flags, pos, marker, markers = 0, 0, 0, 0  # marker: the outermost element around that marks make boilerplate

    def flush():
        line = " ".join("".join(buffer).split()) if buffer else ""
        if line:
            out.append((line, flags, marker))
        buffer.clear()

    while pos < len(page):
        m = _TAG.search(page, pos)
        if not m:
            buffer.append(entities.unescape(page[pos:]))
            break
        if m.start() > pos:
            buffer.append(entities.unescape(page[pos : m.start()]))
        pos = m.end()
        if m[1] is not None:
            buffer.append(m[1])
            continue
        name = m[3] or m[6]
        if name is None:
            continue
        name, ends, attributes = name.lower(), bool(m[2] or m[5]), m[4] if m[3] else m[7]
        if name in RAW and not ends:
            if name == "head":  # its own children are dealt with one by one
                continue
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, pos)
            pos = end.end() if end else len(page)
            continue
        if name in BLOCKS:
            flush()
        if name in VOID or name in RAW:
            continue
        if ends:
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if at is not None:
                _, flags, marker = stack[at]
                del stack[at:]
            continue
        if name in CLOSES and stack and stack[-1][0] in CLOSES[name]:
            _, flags, marker = stack.pop()
        if attributes.rstrip().endswith("/"):
            continue
        stack.append((name, flags, marker))
        if name == "article" or name == "main" or (name == "div" and "role" in attributes.lower() and re.search(r"role\s*=\s*[\"']?(?:main|article)\b", attributes, re.I)):
            flags |= IN_ARTICLE | (_HELD if flags & IS_BOILER and not flags & _BY_NAME else 0)
        named = [(kind.lower(), a or b or c) for kind, a, b, c in _NAMES.findall(attributes)] if attributes else []
        if (name in BOILER and not (name == "header" and flags & IN_ARTICLE)) or (name == "article" and any(COMMENTS.search(x.lower()) for _, x in named)):
            flags = (flags | IS_BOILER | _BY_NAME) & ~_HELD
        elif name not in ("html", "body", "article", "main"):
            # ids in an article are made from its headings; a label is one name
            tokens = [t for kind, x in named if kind != "id" or not flags & IN_ARTICLE for t in ([x] if kind == "aria-label" else x.split())]
            if any(map(is_mark, tokens)):
                flags = (flags | IS_BOILER) & ~_HELD
                if not marker:
                    markers += 1
                    marker = markers
    flush()
    if not any(f & IN_ARTICLE and not f & IS_BOILER for _, f, _ in out):
        # a page without an article outside of marked elements: marks hide no article inside them, and no element with most of the text
        size: dict[int, int] = {}
        for x, f, k in out:
            if not f & _BY_NAME:
                size[k] = size.get(k, 0) + len(x)
        most = set() if any(f & _HELD for _, f, _ in out) else {k for k, n in size.items() if k and 2 * n > sum(size.values())}
        out = [(x, f & ~IS_BOILER if f & _HELD or (k in most and not f & _BY_NAME) else f, k) for x, f, k in out]
    return [(x, f & (IN_ARTICLE | IS_BOILER)) for x, f, _ in out]


#: Bits of the table that one step of `common_lines` holds: 16 MB.
TABLE_BITS = 1 << 27


def _states(a: list, b: list) -> list[int]:
    """The rows of the table for prefixes of a: in each, bit j is 0 where b's entry j makes the longest common subsequence longer."""
    masks: dict = {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    state, rows = full, []
    for x in a:
        u = state & masks.get(x, 0)
        state = ((state + u) | (state - u)) & full
        rows.append(state)
    return rows


def _lengths(a: list, b: list) -> np.ndarray:
    """The length of a longest common subsequence of a and each prefix of b, from the empty one on; one row is held at a time."""
    asked, masks = set(a), {}
    for j, x in enumerate(b):
        if x in asked:
            masks.setdefault(x, []).append(j)
    # a mask is made when it is used: all of them together would be a table
    mask = lambda js: sum(1 << j for j in js) if len(js) < 64 else int.from_bytes(np.packbits(np.isin(np.arange(len(b)), js), bitorder="little").tobytes(), "little")
    bits = {x: mask(js) for x, js in masks.items() if len(js) >= 64}  # fewer than len(b) / 64 of them
    full = (1 << len(b)) - 1
    state = full
    for x in a:
        if x not in masks:
            continue
        u = state & (bits[x] if x in bits else mask(masks[x]))
        state = ((state + u) | (state - u)) & full
    row = np.unpackbits(np.frombuffer(state.to_bytes((len(b) + 7) // 8 or 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - row.astype(np.int64))])


def common_lines(a: list, b: list) -> list[bool]:
    """For each entry of a whether a longest common subsequence of a and b holds it. A table of more than TABLE_BITS is halved until its parts fit, so memory is bounded."""
    if len(a) * len(b) > TABLE_BITS and len(a) > 1:
        half = len(a) // 2
        at = int(np.argmax(_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]))
        return common_lines(a[:half], b[:at]) + common_lines(a[half:], b[at:])
    rows = _states(a, b)
    found, i, j = [False] * len(a), len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if not i or rows[i - 1] >> (j - 1) & 1:
                found[i] = True
                j -= 1
    return found


def deleted_lines(flags: bytes, own: list[int], mate: list[int] | None) -> list[int]:
    """The numbers of the lines outside of articles that a page loses for being shared with its mate, both given as hashes."""
    if not mate or own == mate:
        return []
    return [i for i, (f, shared) in enumerate(zip(flags, common_lines(own, mate), strict=True)) if shared and not f & IN_ARTICLE]


def main_text(lines: list[tuple[str, int]], deleted: list[int] | None) -> str:
    """What stays of a page's lines without boilerplate and deleted ones."""
    gone = set(deleted or ())
    return "\n".join(x for i, (x, f) in enumerate(lines) if not f & IS_BOILER and i not in gone)


def line_hashes(pages: DataFrame, url: str, html: str) -> DataFrame:
    """Each page without its text: url and body (the html's xxhash64), host, path, a digest of its lines, their flags and hashes."""

    def run(batches):
        for batch in batches:
            hosts, paths, digests, flags, hashes = [], [], [], [], []
            for u, page in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                own = page_lines(page.as_py())
                host, path = split_url(u)
                hosts.append(host)
                paths.append(path)
                flags.append(bytes(f for _, f in own))
                hashes.append(np.array([xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) for x, _ in own], dtype=np.uint64).tobytes())
                digests.append(int.from_bytes(xxhash.xxh3_64_digest(hashes[-1] + flags[-1]), "big", signed=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(digests, pa.int64()), pa.array(flags, pa.binary()), pa.array(hashes, pa.binary())], names=["url", "body", "host", "path", "digest", "flags", "hashes"])

    return arrow_map(keyed(pages, url, html).select("url", "body", "html"), run, "url string, body long, host string, path string, digest long, flags binary, hashes binary")


def keyed(pages: DataFrame, url: str, html: str, *columns) -> DataFrame:
    body = F.coalesce(F.col(html), F.lit(""))
    return pages.select(*columns, F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"), F.xxhash64(body).alias("body"), body.alias("html"))


def nearest(distinct: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, path, digest, mate_path, mate_digest) of the pages that have a mate."""
    order = ["host", "path", "digest"]

    def neighbours(batches):
        task, before, held, n = TaskContext.get().partitionId(), None, None, 0
        out: list[tuple] = []

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if held is not None:
                    out.append((*held, task, n == 0, False, *(before[1:] if before and before[0] == held[0] else (None, None)), *(row[1:] if row[0] == held[0] else (None, None))))
                    n += 1
                before, held = held, row
            if out:
                yield batch_of(out)
                out = []
        if held is not None:
            yield batch_of([(*held, task, n == 0, True, *(before[1:] if before and before[0] == held[0] else (None, None)), None, None)])

    names = [*order, "task", "is_first", "is_last", "a_path", "a_digest", "b_path", "b_digest"]
    types = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    ordered = distinct.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    near = scratch.put("neighbours", arrow_map(ordered, neighbours, "host string, path string, digest long, task int, is_first boolean, is_last boolean, a_path string, a_digest long, b_path string, b_digest long"))
    # a range's ends: at most two short rows for each task, whose neighbours lie in the next or last range that has rows
    ends = near.where("is_first OR is_last").select("task", "is_first", "is_last", *order)
    own = near.select(*order, "task", "is_first", "is_last", *(F.col(c) for c in names[6:]))
    by_task = Window.orderBy("task")
    firsts = ends.where("is_first").select("task", *(F.lead(c).over(by_task).alias(f"next_{c}") for c in order))
    lasts = ends.where("is_last").select("task", *(F.lag(c).over(by_task).alias(f"last_{c}") for c in order))
    fixed = own.join(firsts.withColumn("is_last", F.lit(True)), ["task", "is_last"], "left").join(lasts.withColumn("is_first", F.lit(True)), ["task", "is_first"], "left")
    side = lambda mine, other, c: F.coalesce(mine, F.when(F.col(f"{other}_host") == F.col("host"), F.col(f"{other}_{c}")))
    whole = fixed.select(*order, *(side(f"{s}_{c}", other, c).alias(f"{s}_{c}") for s, other in (("a", "last"), ("b", "next")) for c in ("path", "digest")))

    def shared_start(x: str, y: str) -> int:
        n = min(len(x), len(y))
        return next((i for i in range(n) if x[i] != y[i]), n)

    def choose(batches):
        for batch in batches:
            paths, digests = [], []
            for _, path, digest, a, a_digest, b, b_digest in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                sides = [(shared_start(path, p), -k, p, d) for k, (p, d) in enumerate(((a, a_digest), (b, b_digest))) if d is not None and d != digest]
                best = max(sides, default=(0, 0, None, None))
                paths.append(best[2])
                digests.append(best[3])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(paths, pa.string()), pa.array(digests, pa.int64())], names=[*order, "mate_path", "mate_digest"])

    return arrow_map(whole, choose, "host string, path string, digest long, mate_path string, mate_digest long").where("mate_digest IS NOT NULL")


def lost_lines(pages: DataFrame, url: str, html: str, scratch: Scratch) -> DataFrame:
    """(url, body, deleted): the pages that lose lines to their mate. Texts don't move: hashes of lines are compared."""
    light = scratch.put("page-lines", line_hashes(pages, url, html))
    page = ["host", "path", "digest"]
    distinct = scratch.put("distinct-pages", light.groupBy(*page).agg(F.first("flags").alias("flags"), F.first("hashes").alias("hashes")))
    lines = distinct.select("host", F.col("path").alias("mate_path"), F.col("digest").alias("mate_digest"), F.col("hashes").alias("mate"))
    mates = nearest(distinct, scratch).join(lines, ["host", "mate_path", "mate_digest"]).select(*page, "mate")
    pairs = distinct.join(mates, page).select(*page, "flags", "hashes", "mate")

    def run(batches):
        for batch in batches:
            lost = [deleted_lines(flags, *(np.frombuffer(x, np.uint64).tolist() for x in (own, mate))) for flags, own, mate in zip(*(batch.column(i).to_pylist() for i in range(3, 6)), strict=True)]
            some = pa.array([bool(x) for x in lost], pa.bool_())
            yield pa.RecordBatch.from_arrays([*(c.filter(some) for c in batch.columns[:3]), pa.array([x for x in lost if x], pa.list_(pa.int32()))], names=[*page, "deleted"])

    losing = arrow_map(pairs, run, "host string, path string, digest long, deleted array<int>")
    return light.select("url", "body", *page).distinct().join(losing, page).select("url", "body", "deleted")


def extract_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """A row for each row of pages: key, url, text. Spark joins the lost lines by broadcast if their written table is small, else by sorting."""
    no_clash(key, "url", "text")
    kind = pages.schema[key].dataType.simpleString()
    with Scratch(pages.sparkSession) as scratch:
        lost = materialise(lost_lines(pages, url, html, scratch), "lost-lines")
    whole = keyed(pages, url, html, F.col(key).alias("key"), F.col(url).cast("string").alias("own_url")).join(lost, ["url", "body"], "left").select("key", "own_url", "html", "deleted")

    def run(batches):
        for batch in batches:
            out = [main_text(page_lines(page.as_py()), deleted.as_py()) for page, deleted in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=[key, "url", "text"])

    return arrow_map(whole, run, f"`{key}` {kind}, url string, text string")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
