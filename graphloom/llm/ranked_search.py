"""Ranked search over all documents: WAND in each shard, and the shards' heaps merged.

Documents are indexed once for a block of queries: for each document its number of terms and, for the queries' terms, how
often it has them. Shards are the partitions of that table. A shard's postings hold their exact impacts (the share of
a term in a document's score), and each term has its greatest impact there. A query goes over a shard's postings in document order:
the pivot is found for a window of WINDOW documents at once. Lists whose next document lies behind the window
can't add to its scores; if the greatest impacts of the others together can't beat the heap's threshold, the window is skipped, and the next one
begins where the next document of a list is. Within a window the documents' own sums of greatest impacts are added up as arrays, and only those
that reach the threshold are scored. A worker holds postings of about SHARD_POSTINGS at a time, whatever the size of its partition, and
keeps one heap for each query over them; of these at most `top` rows for each query leave the task. They are merged in two rounds, so that the
last one gets a bounded number of rows for each query.

A document or query without terms (a null text too) has no results. Repeated documents are ranked one by one; a null
doc_id comes last among equal scores. Rows of one item_id and text are one query; different texts under one id are queries of their
own. Scores are whole numbers, so ties are exact: ascending doc_id decides. Texts of any length are worked off in pieces.
An empty table of documents or of queries gives no rows. Other columns are not read, so none clashes.

Queries go to the workers in blocks of about `max_bytes` of text; each block is one pass over the documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, materialise, table, texts

TOP, MAX_BYTES, SHARD_POSTINGS, WINDOW, PIECE, MERGE = 10, 8 << 20, 1 << 21, 4096, 1 << 20, 256
#: Bytes that belong to terms; A-Z are lower-cased. All bytes of characters outside ASCII belong to terms.
_KEEP = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _KEEP else 0x20 for b in range(256))
LAST = np.iinfo(np.int64).max


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in pieces of about PIECE bytes."""
    folded, at = text.translate(_FOLD), 0
    while at < len(folded):
        end = folded.find(b" ", at + PIECE) if len(folded) - at > PIECE else -1
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def weight(n: int, df: int) -> int:
    """How much a term counts that df of n documents hold."""
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def index(docs: DataFrame, vocabulary, key: str, text: str) -> DataFrame:
    """(id, n, terms, tfs) of each document with terms; terms are numbers of the broadcast vocabulary, ascending."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        known = vocabulary.value
        for batch in batches:
            keep, lengths, terms, tfs = [], [], [], []
            for row, body in enumerate(batch.column(1).cast(pa.binary())):
                n, held = 0, Counter()
                for words in terms_of(body.as_py()):
                    n += len(words)
                    held.update(x for x in map(known.get, words) if x is not None)
                if n:
                    keep.append(row)
                    lengths.append(n)
                    order = sorted(held)
                    terms.append(order)
                    tfs.append([held[x] for x in order])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(lengths, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], names=["id", "n", "terms", "tfs"])

    return arrow_map(texts(docs.withColumnRenamed(key, "id") if key != "id" else docs, "id", text=text), run, f"id {kind}, n long, terms array<int>, tfs array<long>")


class Shard:
    """Postings of some documents: for each term the places of its documents, ascending, and its impact on each."""

    def __init__(self, lengths: np.ndarray, terms: np.ndarray, tfs: np.ndarray, counts: np.ndarray, weights: np.ndarray, n: int, total: int) -> None:
        m = 100 - 90 + (90 * lengths * n) // total
        place = np.repeat(np.arange(len(lengths)), counts)
        impact = weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * m[place]))
        order = np.argsort(terms, kind="stable")
        self.places, self.impacts, self.size = place[order], impact[order], len(lengths)
        self.starts = np.searchsorted(terms[order], np.arange(len(weights) + 1))
        # the greatest impact of each term's list
        filled = np.flatnonzero(np.diff(self.starts))
        self.greatest = np.zeros(len(weights), np.int64)
        if len(filled):
            self.greatest[filled] = np.maximum.reduceat(self.impacts, self.starts[filled])

    def search(self, query: np.ndarray, threshold: int, top: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(places, scores) of the documents that may be among the best `top` given a threshold that ties may reach, and how many were scored."""
        lists = [(self.places[a:b], self.impacts[a:b], int(self.greatest[t])) for t in query if (a := self.starts[t]) < (b := self.starts[t + 1]) and self.greatest[t] > 0]
        at, places, scores, scored = [0] * len(lists), [], [], 0
        best = np.zeros(0, np.int64)
        while True:
            nexts = [int(x[0][i]) if i < len(x[0]) else LAST for x, i in zip(lists, at, strict=True)]
            low = min(nexts, default=LAST)
            if low == LAST:
                break
            high = low + WINDOW
            inside = [k for k, d in enumerate(nexts) if d < high]
            ends = {k: int(np.searchsorted(lists[k][0], high)) for k in inside}
            if sum(lists[k][2] for k in inside) >= threshold:  # else the pivot lies behind the window
                bound = np.zeros(WINDOW, np.int64)
                for k in inside:
                    bound[lists[k][0][at[k] : ends[k]] - low] += lists[k][2]
                able = bound >= max(threshold, 1)
                if able.any():
                    sums = np.zeros(WINDOW, np.int64)
                    for k in inside:
                        own = lists[k][0][at[k] : ends[k]] - low
                        chosen = able[own]
                        sums[own[chosen]] += lists[k][1][at[k] : ends[k]][chosen]
                    good = np.flatnonzero(able & (sums >= max(threshold, 1)))
                    scored += int(able.sum())
                    places.append(good + low)
                    scores.append(sums[good])
                    best = np.concatenate([best, sums[good]])
                    if len(best) >= top:
                        best = np.partition(best, len(best) - top)[-top:]
                        threshold = max(threshold, int(best[0]))
            for k in inside:
                at[k] = ends[k]
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), scored
        return np.concatenate(places), np.concatenate(scores), scored


def _rank(rows: list[tuple], top: int) -> list[tuple]:
    """The best rows of (score, id): by score, then by id, null last."""
    return sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1]))[:top]


def heaps(postings: DataFrame, asked, top: int) -> DataFrame:
    """(query, id, score): the best of each task's documents for each query."""
    kind = postings.schema["id"].dataType

    def run(batches):
        queries, weights, n, total = asked.value
        heap: list[list[tuple]] = [[] for _ in queries]

        def flush(held: list[pa.RecordBatch]) -> None:
            ids = [x for b in held for x in b.column(0).to_pylist()]
            whole = lambda i: np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held])
            flat = lambda i: np.concatenate([b.column(i).flatten().to_numpy(zero_copy_only=False) for b in held])
            counts = np.concatenate([np.asarray(b.column(2).value_lengths()) for b in held])
            shard = Shard(whole(1), flat(2), flat(3), counts, weights, n, total)
            for i, q in enumerate(queries):
                threshold = heap[i][-1][0] if len(heap[i]) == top else 1
                places, scores, _ = shard.search(q, threshold, top)
                if len(places) > top:  # those below the last place can't be in the heap
                    least = np.partition(scores, len(scores) - top)[len(scores) - top]
                    places, scores = places[scores >= least], scores[scores >= least]
                if len(places):
                    heap[i] = _rank(heap[i] + [(int(s), ids[p]) for p, s in zip(places.tolist(), scores.tolist(), strict=True)], top)

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch.column(2).flatten())
            if size >= SHARD_POSTINGS:
                flush(held)
                held, size = [], 0
        if held:
            flush(held)
        rows = [(i, d, s) for i, own in enumerate(heap) for s, d in own]
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], kind_of), pa.array(columns[2], pa.int64())], names=["query", "id", "score"])

    from pyspark.sql.pandas.types import to_arrow_type

    kind_of = to_arrow_type(kind)
    return arrow_map(postings, run, f"query int, id {kind.simpleString()}, score long")


def merged(found: DataFrame, top: int) -> DataFrame:
    """The best rows of each query, with their rank: first within MERGE shares of the tasks' heaps, then over them."""
    order = [F.desc("score"), F.asc_nulls_last("id")]
    part = found.withColumn("share", F.pmod(F.xxhash64("id", "score"), F.lit(MERGE)))
    first = part.withColumn("rank", F.row_number().over(Window.partitionBy("query", "share").orderBy(*order))).where(F.col("rank") <= top)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= top).drop("share")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", max_bytes: int = MAX_BYTES) -> DataFrame:
    """(item, rank, key, score): the documents with the highest scores above 0 for each item's text, at most `top`."""
    spark, out = docs.sparkSession, []
    asked = items.select(F.col(item).alias("item"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("body")).distinct()
    with Scratch(spark) as scratch:
        queries = scratch.put("queries", asked)
        blocks = int(queries.agg(F.sum(F.octet_length("body") + 16)).first()[0] or 0) // max_bytes + 1
        for k in range(blocks):
            rows = queries.where(F.pmod(F.xxhash64("item", "body"), F.lit(blocks)) == k).collect()  # about max_bytes of text
            known: dict[bytes, int] = {}
            own = [np.array(sorted({known.setdefault(w, len(known)) for words in terms_of(r.body.encode()) for w in words}), np.int64) for r in rows]
            postings = scratch.put("postings", index(docs, spark.sparkContext.broadcast(known), key, text))
            n, total = postings.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
            held = np.zeros(len(known), np.int64)
            for r in postings.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():  # a row for each term of the block
                held[r.t] = r["count"]
            weights = np.array([weight(n, int(df)) for df in held], np.int64)
            best = merged(heaps(postings, spark.sparkContext.broadcast((own, weights, n, total)), top), top)
            names = spark.createDataFrame([(i, r.item) for i, r in enumerate(rows)], f"query int, item {items.schema[item].dataType.simpleString()}")
            out.append(scratch.put(f"best-{k}", best.join(F.broadcast(names), "query").select(F.col("item").alias(item), "rank", F.col("id").alias(key), "score")))
        every = out[0]
        for x in out[1:]:
            every = every.unionByName(x)
        return materialise(every, "ranked")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
q AS (SELECT DISTINCT item_id, {_TERMS} AS w, text FROM benchmark),
qt AS (SELECT item_id, text, unnest(list_distinct(w)) AS t FROM q),
dt AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM qt) GROUP BY r, t),
s AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(len(w)) AS BIGINT) AS total FROM d WHERE len(w) > 0),
wt AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM dt, s GROUP BY t),
m AS (SELECT r, doc_id, 100 - 90 + ((90 * len(w) * n) // total) AS m FROM d, s WHERE len(w) > 0),
p AS (SELECT item_id, text, r, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM qt JOIN wt USING (t) JOIN dt USING (t) JOIN m USING (r) GROUP BY item_id, text, r),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM p JOIN m USING (r) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 10
"""
