"""Benchmark passages in documents, by a positional inverted index.

The index is partitioned by document: a block holds some documents (about 250,000 words, more only if one document
is longer) and, for each word that occurs there, the sorted positions at which the block has it. It knows nothing of any
test set: `build_index` writes it once, and `search` can be asked about one test set after another. A search takes every
window of the test items to every block: the postings of the window's rarest word there are moved by the word's offset,
and each further word in order of rarity strikes out the starts at which its own moved postings have no entry. Windows
are worked off together as arrays. With a span, proximity matches are returned too: the places of a window's first word
around which all its other words lie at most `span` words away in the same document, in any order, and the items of such
windows.

The test set is cut into segments that overlap by a window less a word, so that an item of any length is many short
rows, and goes to the workers in parts of about `max_bytes`, each of which is one pass over the index; the parts' results
of a document are put together.

Texts: null has no words. Items without words have no windows; items that share an id count once; a null id is
reported as an empty string. Repeated documents are searched one by one, and each gets its row. Words run over the whole
text. An empty benchmark hits nothing, an empty table of documents gives no rows. Columns besides key and text are not
read, so none can clash; the key may have any name but those of the columns that are returned.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, materialise, no_clash, table, texts

WINDOW, SPAN, BLOCK_WORDS, MAX_BYTES, SEGMENT, SLICE = 10, 12, 250_000, 8 << 20, 20_000, 1 << 14
NEAR = ("near", "near_items")
_KEEP = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_FOLD = bytes((b + 32 if 0x41 <= b <= 0x5A else b if b in _KEEP else 0x20) for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] after A-Z are lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Windows:
    """The distinct windows of test items by length, each with the items that have it.

    `groups` holds for each length an array with a row of term numbers for each window, the ends of the windows' item lists, and the lists."""

    def __init__(self, items: list[tuple[str, str]], size: int = WINDOW) -> None:
        self.terms: dict[bytes, int] = {}
        self.ids: list[str] = []
        by_id: dict[str, int] = {}
        rows: dict[int, list[np.ndarray]] = {}
        owners: dict[int, list[np.ndarray]] = {}
        for name, text in items:
            words = np.array([self.terms.setdefault(w, len(self.terms)) for w in words_of(text)], dtype=np.int32)
            if not len(words):
                continue
            i = by_id.setdefault(name, len(by_id))
            if i == len(self.ids):
                self.ids.append(name)
            n = min(size, len(words))
            own = np.lib.stride_tricks.sliding_window_view(words, n)
            rows.setdefault(n, []).append(own)
            owners.setdefault(n, []).append(np.full(len(own), i, dtype=np.int32))
        self.groups = []
        for n in sorted(rows):
            windows, which = np.unique(np.concatenate(rows[n]), axis=0, return_inverse=True)
            pairs = np.unique(np.stack([which.ravel(), np.concatenate(owners[n])], axis=1), axis=0)
            self.groups.append((windows, np.concatenate([[0], np.cumsum(np.bincount(pairs[:, 0], minlength=len(windows)))]), pairs[:, 1].astype(np.int64)))


class Block:
    """The postings of a block, as far as a list of terms needs them."""

    def __init__(self, terms: dict[bytes, int], doc_ends: np.ndarray, vocabulary: list[bytes], ends: np.ndarray, positions: np.ndarray) -> None:
        self.doc_ends, self.n_words = doc_ends, int(doc_ends[-1]) if len(doc_ends) else 0
        self.doc_starts = np.concatenate([[0], doc_ends[:-1]]).astype(np.int64)
        here = sorted((terms[w], v) for v, w in enumerate(vocabulary) if w in terms)
        known, own = (np.array(x, dtype=np.int64) for x in zip(*here, strict=True)) if here else (np.zeros(0, np.int64),) * 2
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)[own] if here else own
        counts = ends[own] - starts if here else own
        self.frequency, self.first = np.zeros((2, len(terms)), dtype=np.int64)
        self.frequency[known], self.first[known] = counts, np.cumsum(counts) - counts
        at = np.repeat(starts - self.first[known], counts) + np.arange(counts.sum())
        self.positions = positions[at].astype(np.int64)
        #: term and position in one sorted array, so that one binary search asks many lists at once
        self.keys = np.repeat(known, counts) * (self.n_words + 1) + self.positions

    def next_after(self, terms: np.ndarray, positions: np.ndarray) -> np.ndarray:
        """The first position of each term at or after a position; past the block if there is none."""
        wanted = terms * (self.n_words + 1) + positions
        at = np.searchsorted(self.keys, wanted)
        found = self.keys[np.minimum(at, len(self.keys) - 1)] if len(self.keys) else np.zeros(len(wanted), np.int64)
        return np.where((at < len(self.keys)) & (found < (terms + 1) * (self.n_words + 1)), found - terms * (self.n_words + 1), self.n_words)

    def postings(self, windows: np.ndarray, column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, position) of each occurrence of the term that stands in a window's given column."""
        pivot = windows[np.arange(len(windows)), column]
        n = self.frequency[pivot]
        row = np.repeat(np.arange(len(windows)), n)
        return row, self.positions[np.repeat(self.first[pivot] - np.cumsum(n) + n, n) + np.arange(n.sum())]

    def by_rarity(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(numbers, windows, order of their columns) of the windows whose terms all occur."""
        frequency = self.frequency[windows]
        alive = np.flatnonzero(frequency.min(axis=1) > 0)
        return alive, windows[alive].astype(np.int64), np.argsort(frequency[alive], axis=1, kind="stable")

    def phrases(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, start) of each exact occurrence inside one document."""
        alive, rows, order = self.by_rarity(windows)
        which, at = self.postings(rows, order[:, 0])
        start = at - order[which, 0]
        inside = start >= 0
        which, start = which[inside], start[inside]
        for k in range(1, windows.shape[1]):
            column = order[which, k]
            ok = self.next_after(rows[which, column], start + column) == start + column
            which, start = which[ok], start[ok]
        inside = np.searchsorted(self.doc_ends, start, "right") == np.searchsorted(self.doc_ends, start + windows.shape[1] - 1, "right")
        return alive[which[inside]], start[inside]

    def near(self, windows: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, place of its first word) wherever all its words lie within the span of that place and in its document.

        All words then lie within twice the span of the rarest one, which thins out the places before any first word is looked at."""
        alive, rows, order = self.by_rarity(windows)
        which, at = self.postings(rows, order[:, 0])
        which, at = self._within(rows, order, which, at, 2 * span)
        # the places of the first word around each place of the rarest one
        doc = np.searchsorted(self.doc_ends, at, "right")
        low, high = np.maximum(at - span, self.doc_starts[doc]), np.minimum(at + span + 1, self.doc_ends[doc])
        first = rows[which, 0]
        a, b = (np.searchsorted(self.keys, first * (self.n_words + 1) + x) for x in (low, high))
        n = b - a
        which = np.repeat(which, n)
        places = self.positions[np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())]
        pairs = np.unique(np.stack([which, places], axis=1), axis=0) if len(which) else np.zeros((0, 2), np.int64)
        which, places = self._within(rows, order, pairs[:, 0], pairs[:, 1], span)
        return alive[which], places

    def _within(self, rows: np.ndarray, order: np.ndarray, which: np.ndarray, at: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
        for k in range(rows.shape[1]):
            doc = np.searchsorted(self.doc_ends, at, "right")
            low, high = np.maximum(at - span, self.doc_starts[doc]), np.minimum(at + span + 1, self.doc_ends[doc])
            ok = self.next_after(rows[which, order[which, k]], low) < high
            which, at = which[ok], at[ok]
        return which, at


class BlockBuilder:
    """Gathers documents of a block; of its words only the distinct ones are kept as such."""

    def __init__(self) -> None:
        self.numbers: dict[bytes, int] = defaultdict(count().__next__)
        self.bodies: list[np.ndarray] = []
        self.n_words = 0

    def add(self, words: list[bytes]) -> None:
        self.bodies.append(np.fromiter(map(self.numbers.__getitem__, words), dtype=np.int32, count=len(words)))
        self.n_words += len(words)

    def build(self) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
        """(doc_ends, vocabulary, ends, positions): word v has positions[ends[v - 1] : ends[v]]."""
        doc_ends = np.cumsum([len(b) for b in self.bodies], dtype=np.int64)
        ids = np.concatenate(self.bodies)
        ends = np.cumsum(np.bincount(ids, minlength=len(self.numbers)), dtype=np.int64)
        return doc_ends, list(self.numbers), ends, np.argsort(ids, kind="stable").astype(np.int32)


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row for each block. Write it once; any number of test sets can then be searched in it."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        ids, own, id_type = [], BlockBuilder(), None

        def block():
            doc_ends, vocabulary, ends, positions = own.build()
            arrays = [pa.array([ids], pa.list_(id_type)), pa.array([doc_ends.tolist()], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in (b" ".join(vocabulary), ends.tobytes(), positions.tobytes()))]
            return pa.RecordBatch.from_arrays(arrays, names=["ids", "doc_ends", "vocabulary", "ends", "positions"])

        for batch in batches:
            id_type = batch.schema.field(0).type
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(i)
                own.add(words_of(t.as_py()))
                if own.n_words >= block_words:
                    yield block()
                    ids, own = [], BlockBuilder()
        if ids:
            yield block()

    return arrow_map(texts(docs, key, text=text), run, f"ids array<{kind}>, doc_ends array<bigint>, vocabulary binary, ends binary, positions binary")


def search(index: DataFrame, windows, key: str = "doc_id", span: int | None = None) -> DataFrame:
    """A row for each document: n_words, n_hit, the hit spans in words [from, to) and the items found, as sorted strings; `windows` is a broadcast Windows.

    With a span also near, the words at which windows lie within it, and near_items."""
    kind = index.schema["ids"].dataType.elementType.simpleString()

    def by_document(block: Block, names: list[str], found: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> list[list[str]]:
        """The names of the items of (window, place) by document."""
        out: list[set[str]] = [set() for _ in block.doc_ends]
        for which, place, item_ends, items in found:
            n = np.diff(item_ends)[which]
            doc = np.repeat(np.searchsorted(block.doc_ends, place, "right"), n)
            at = np.repeat(item_ends[which] - np.cumsum(n) + n, n) + np.arange(n.sum())
            for d, i in np.unique(np.stack([doc, items[at]], axis=1), axis=0).tolist():
                out[d].add(names[i])
        return [sorted(x) for x in out]

    def run(batches):
        wanted = windows.value
        for batch in batches:
            for ids, doc_ends, vocabulary, ends, positions in zip(*(batch.column(i) for i in range(5)), strict=True):
                doc_ends = np.array(doc_ends.as_py(), dtype=np.int64)
                block = Block(wanted.terms, doc_ends, vocabulary.as_py().split(b" "), np.frombuffer(ends.as_py(), np.int64), np.frombuffer(positions.as_py(), np.int32))
                starts, docs = block.doc_starts, range(len(doc_ends))
                change, exact, close = np.zeros(block.n_words + 1, dtype=np.int64), [], []
                for group, item_ends, items in wanted.groups:
                    for low in range(0, len(group), SLICE):  # a bound on the arrays of one step
                        which, start = block.phrases(group[low : low + SLICE])
                        np.add.at(change, start, 1)
                        np.add.at(change, start + group.shape[1], -1)
                        exact.append((which + low, start, item_ends, items))
                        if span is not None:
                            which, place = block.near(group[low : low + SLICE], span)
                            close.append((which + low, place, item_ends, items))
                hit = np.cumsum(change)[:-1] > 0
                before = np.concatenate([[0], np.cumsum(hit)])
                n_hit = before[doc_ends] - before[starts]
                spans = []
                for d in docs:
                    own = []
                    if n_hit[d]:
                        step = np.diff(hit[starts[d] : doc_ends[d]].astype(np.int8), prepend=0, append=0)
                        own = [{"from": int(a), "to": int(b)} for a, b in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True)]
                    spans.append(own)
                more = []
                if span is not None:
                    places: list[list[int]] = [[] for _ in docs]
                    for p in np.unique(np.concatenate([np.zeros(0, np.int64), *(x[1] for x in close)])).tolist():
                        d = int(np.searchsorted(doc_ends, p, "right"))
                        places[d].append(p - int(starts[d]))
                    more = [pa.array(places, pa.list_(pa.int64())), pa.array(by_document(block, wanted.ids, close), pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(
                    [ids.values, pa.array(doc_ends - starts, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(spans, pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))), pa.array(by_document(block, wanted.ids, exact), pa.list_(pa.string())), *more],
                    names=[key, "n_words", "n_hit", "spans", "items", *(NEAR if more else ())],
                )

    return arrow_map(index, run, f"`{key}` {kind}, n_words long, n_hit long, spans array<struct<`from`:bigint,`to`:bigint>>, items array<string>" + (", near array<bigint>, near_items array<string>" if span is not None else ""))


def segments(benchmark: DataFrame, item: str, text: str, size: int) -> DataFrame:
    """(i, t): the items' words in rows of at most SEGMENT words more than a window; each window of an item lies whole in one row."""

    def run(batches):
        for batch in batches:
            ids, parts = [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = words_of(t.as_py())
                for at in range(0, max(1, len(words) - size + 1), SEGMENT):
                    ids.append("" if i is None else i)
                    parts.append(b" ".join(words[at : at + SEGMENT + size - 1]).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(parts, pa.string())], names=["i", "t"])

    return arrow_map(benchmark.select(F.col(item).cast("string").alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t")), run, "i string, t string")


def _parts(rows: DataFrame, max_bytes: int):
    """The segments in parts of about max_bytes, by a hash of the row."""
    n = (rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // max_bytes + 1
    for k in range(n):
        yield [(r.i, r.t) for r in rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()]  # about max_bytes


def _united(parts: list[DataFrame]) -> DataFrame:
    """The results of several parts of the test set, one row for each distinct document."""
    every = parts[0].dropDuplicates(["row"])
    for p in parts[1:]:
        every = every.unionByName(p.dropDuplicates(["row"]))
    grouped = every.groupBy("row").agg(F.first("n_words").alias("n_words"), F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"), *(F.sort_array(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("items", *NEAR) if c in every.columns))
    # spans in order of their starts: a span joins the one before it or begins anew
    start = F.expr("CAST(array() AS array<struct<`from`:bigint,`to`:bigint>>)")
    join = lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["to"] >= x["from"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["from"].alias("from"), F.greatest(F.element_at(acc, -1)["to"], x["to"]).alias("to"))))).otherwise(F.concat(acc, F.array(x)))
    merged = grouped.withColumn("spans", F.aggregate("spans", start, join))
    return merged.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["to"] - x["from"]))


def find_passages(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", size: int = WINDOW, max_bytes: int = MAX_BYTES, span: int | None = None) -> DataFrame:
    """A row for each row of docs: key, body (xxhash64 of the text), n_words, n_hit, spans, items; with a span also near and near_items."""
    no_clash(key, "body", "n_words", "n_hit", "spans", "items", *NEAR)
    spark, found = docs.sparkSession, []
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(F.struct(F.col(key).alias("id"), F.xxhash64(body).alias("body")).alias("row"), body.alias("text"))
    with Scratch(spark) as scratch:
        index = scratch.put("postings", build_index(keyed, "row"))
        for k, part in enumerate(_parts(scratch.put("segments", segments(benchmark, item, item_text, size)), max_bytes)):
            windows = spark.sparkContext.broadcast(Windows(part, size))  # of about max_bytes of text
            found.append(scratch.put(f"found-{k}", search(index, windows, "row", span)))
        done = found[0] if len(found) == 1 else index.select(F.explode("ids").alias("row")).join(_united(found), "row")
        return materialise(done.select(F.col("row.id").alias(key), "row.body", "n_words", "n_hit", "spans", "items", *(NEAR if span is not None else ())), "passages")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs without the rows that hold a test window; columns and texts as they are."""
    hits = find_passages(docs, benchmark, key, text, **options).where("n_hit > 0").select(F.col(key).alias("__id"), F.col("body").alias("__body")).distinct()
    same = docs[key].eqNullSafe(hits["__id"]) & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == hits["__body"])
    return docs.join(hits, same, "left_anti")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact phrases as the contract has them, and besides n_near (words where a window lies within SPAN words) and near_sha256 (the items of such windows)."""
    found = find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), span=SPAN)
    digest = lambda c: F.sha2(F.array_join(c, ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest("items").alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), F.size("near").cast("long").alias("n_near"), digest("near_items").alias("near_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item_id, w, least(len(w), 10) AS m, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS g FROM bi),
di AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m),
dg AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS g FROM di),
h AS (SELECT doc_id, item_id, dg.m AS m, i FROM dg JOIN bw ON dg.m = bw.m AND dg.g = bw.g),
hw AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS place FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id),
wins AS (SELECT g, any_value(string_split(g, ' ')) AS ws, list(DISTINCT item_id) AS owners FROM bw GROUP BY g),
wt AS (SELECT g, any_value(ws[1]) AS head, unnest(list_distinct(any_value(ws))) AS w, any_value(len(list_distinct(ws))) AS n FROM wins GROUP BY g),
dp AS (SELECT doc_id, w[i] AS w, i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) WHERE w[i] IN (SELECT w FROM wt)),
dw AS (SELECT doc_id, w, list(i ORDER BY i) AS ps FROM dp GROUP BY doc_id, w),
live AS (SELECT doc_id, g FROM dw JOIN wt ON dw.w = wt.w GROUP BY doc_id, g HAVING count(*) = any_value(wt.n)),
heads AS (SELECT doc_id, g, unnest(ps) AS p FROM live JOIN (SELECT DISTINCT g, head FROM wt) USING (g) JOIN dw USING (doc_id) WHERE dw.w = head),
near AS (SELECT h.doc_id, h.g, h.p FROM heads h JOIN wt ON wt.g = h.g JOIN dw ON dw.doc_id = h.doc_id AND dw.w = wt.w
  GROUP BY h.doc_id, h.g, h.p HAVING bool_and(len(list_filter(dw.ps, lambda x: abs(x - h.p) <= 12)) > 0)),
np AS (SELECT doc_id, count(DISTINCT p) AS n_near FROM near GROUP BY doc_id),
ni AS (SELECT doc_id, string_agg(CAST(o AS VARCHAR), ',' ORDER BY CAST(o AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, unnest(owners) AS o FROM near JOIN wins USING (g)) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(hi.ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  coalesce(n_near, 0) AS n_near, sha256(coalesce(ni.ids, '')) AS near_sha256
FROM d LEFT JOIN hw ON d.doc_id = hw.doc_id LEFT JOIN hi ON d.doc_id = hi.doc_id LEFT JOIN np ON d.doc_id = np.doc_id LEFT JOIN ni ON d.doc_id = ni.doc_id
"""
