"""Near-duplicate classes by consistent weighted sampling.

A text's shingles are five successive words (a shorter text's words are one shingle). A shingle weighs
(1 + ln tf) * idf, where idf runs from 1 to 1 + `STRENGTH` by the share of documents that have the shingle, so that a
common passage counts a little less than a rare one, but a large group of copies does not lose its own shingles.
Shares come from a table of 2^20 counters over the hashes of the shingles of all documents; a shingle shares its
counter with others, which adds to its share about (shingles of a document) / 2^20, the same at every corpus size.
Weights are rounded to a grid of 5 %.

Improved consistent weighted sampling draws, for each of 64 hash functions, the shingle with the least
c / (y e^r), y = e^(r (t - b)), t = floor(ln w / r + b); two texts draw the same (shingle, t) with the probability of
their weighted Jaccard similarity. r, c ~ Gamma(2, 1) and b ~ U(0, 1) are read from a table by 16 bits of the hash.
16 bands of 4 draws give candidates, which weighted Jaccard over the whole sets confirms at 0.8 or more.

Texts with equal words are one node from the start. Every pair of nodes that share a bucket of a band is decided, in an
order that spares work: first each node is compared with the least node of its buckets, which joins most of a group of
copies; then the buckets that still hold several classes compare all pairs of nodes of different classes. Such a bucket
is cut by total weight (pairs whose weights differ by more than the similarity allows cannot be similar), by whether a
node is of the bucket's largest class (which needs no pairs of its own) and by hash into chunks, and every two chunks that
may hold a pair are laid side by side in one task: a few strays beside a class of any size are work in proportion to it.
Buckets with the same nodes are worked off once, and a pair that shares several buckets once; neither changes a result.
The work of a large bucket of many classes of like weight grows with the square of its nodes. Classes are connected
components, by label propagation over written tables; the second step joins classes, so its components are those of
labels. Joins on a bucket, a class or a text that many rows share are salted. Tables are removed as soon as they are used up.

Null texts count as empty. Texts without words are the same if they are equal. Repeated documents join one class. An
empty table gives an empty result. Columns of docs besides key and text are not read, so none can clash.
A class is told by its label, a number; class_id is for output: the least key, or where that is null or the least of
several classes, a value that no row has as its key (for integers a number below all keys, for strings `key#label`).
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SALTS, Scratch, arrow_map, files_for, look_up, materialise, table
from .decontaminate import words_of

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 16, 4
SLOTS, BLOCKS, STRENGTH, GRID = 1 << 20, 256, 0.25, 0.05
LEVELS = 60
#: Nodes and bytes of shingles of a chunk of a bucket.
CHUNK, CHUNK_BYTES = 512, 4 << 20


def shingles(text: str, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 32-bit shingle hashes and how often each occurs."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = min(size, len(words))
    out = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for k in range(n):
        out = (out * np.uint64(0x9E3779B97F4A7C15)) ^ (out >> np.uint64(29))
        out += h[k : k + len(out)]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return np.unique((out >> np.uint64(32)).astype(np.uint32), return_counts=True)


def content(text: str) -> bytes:
    """128 bits that equal texts, or texts with equal words, share."""
    words = words_of(text)
    return xxhash.xxh3_128_digest(b"w" + b" ".join(words) if words else b"t" + text.encode("utf-8", "surrogatepass"))


def shingle_sets(docs: DataFrame, key: str, text: str) -> DataFrame:
    """A row for each row of docs: rid (unique once written), key, body, content hash, shingles, and counts where one is not 1."""
    kind = docs.schema[key].dataType.simpleString()
    body = F.coalesce(F.col(text), F.lit(""))

    def run(batches):
        n = TaskContext.get().partitionId() << 40
        for batch in batches:
            rid, c1, c2, sets, counts = [], [], [], [], []
            for value in batch.column(2):
                value = value.as_py()
                digest, (h, tf) = content(value), shingles(value)
                rid.append(n)
                n += 1
                c1.append(int.from_bytes(digest[:8], "big", signed=True))
                c2.append(int.from_bytes(digest[8:], "big", signed=True))
                sets.append(h.tobytes())
                counts.append(tf.astype(np.int32).tobytes() if len(tf) and tf.max() > 1 else b"")
            yield pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), batch.column(0), batch.column(1), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.array(sets, pa.binary()), pa.array(counts, pa.binary())], names=["rid", "doc", "body", "c1", "c2", "shingles", "counts"])

    return arrow_map(docs.select(F.col(key), F.xxhash64(body).alias("body"), body.alias("text")), run, f"rid long, doc {kind}, body long, c1 long, c2 long, shingles binary, counts binary")


def idf_levels(sets: DataFrame) -> np.ndarray:
    """The weight level of each counter, from the number of documents that have its shingles: 1 MB at every input size."""
    width = SLOTS // BLOCKS

    def count(batches):
        total, n = np.zeros(SLOTS, dtype=np.int64), 0
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint32) >> 12, minlength=SLOTS)
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([total[i * width : (i + 1) * width].astype(np.uint32).tobytes() for i in range(BLOCKS)], pa.binary()), pa.array([n] * BLOCKS, pa.int64())], names=["block", "counts", "n"])

    def add(batches):
        sums: dict[int, list] = {}
        for batch in batches:
            for block, counts, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                own = sums.setdefault(block, [np.zeros(width, dtype=np.int64), 0])
                own[0] += np.frombuffer(counts, np.uint32)
                own[1] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s[0].tobytes() for s in sums.values()], pa.binary()), pa.array([s[1] for s in sums.values()], pa.int64())], names=["block", "counts", "n"])

    schema = "block int, counts binary, n long"
    rows = arrow_map(arrow_map(sets.select("shingles"), count, schema).repartition("block"), add, schema).collect()  # 256 rows of 32 KB
    total, n = np.zeros(SLOTS, dtype=np.int64), max([1, *(r.n for r in rows)])
    for r in rows:
        total[r.block * width : (r.block + 1) * width] = np.frombuffer(r.counts, np.int64)
    share = np.minimum(1.0, total / n)
    idf = 1 + STRENGTH * np.log(1 / (share + 1e-3)) / np.log(1 / 1e-3)
    return np.clip(np.round(np.log(idf) / GRID), 0, LEVELS - 1).astype(np.uint8)


@lru_cache(maxsize=1)
def _tables(seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ln of c / (y e^r) and t by level and 16 bits of a hash, and the multipliers and shifts of the hash functions: 47 MB, made from the seed in each worker."""
    rng, n = np.random.default_rng(seed), 1 << 16
    r, c, b = rng.gamma(2, 1, n), rng.gamma(2, 1, n), rng.random(n)
    t = np.floor(np.arange(LEVELS)[:, None] * GRID / r + b)
    least = (np.log(c) - r * (t - b) - r).astype(np.float32).ravel()
    odd = rng.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    return least, t.astype(np.int64).ravel(), odd, rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)


class Sampler:
    def __init__(self, idf: np.ndarray, seed: int = 11) -> None:
        self.idf, self.seed = idf, seed

    def levels(self, h: np.ndarray, counts: bytes) -> np.ndarray:
        level = self.idf[h >> 12].astype(np.int32)
        if counts:
            level = level + np.round(np.log(1 + np.log(np.frombuffer(counts, np.int32))) / GRID).astype(np.int32)
        return np.minimum(level, LEVELS - 1)

    def bands(self, h: np.ndarray, counts: bytes) -> np.ndarray:
        """One 64-bit key for each band."""
        level = self.levels(h, counts) << 16
        least, t, odd, shift = _tables(self.seed)
        best, which = np.full(len(odd), np.inf, dtype=np.float32), np.zeros(len(odd), dtype=np.int64)
        for i in range(0, len(h), 2048):
            part = h[i : i + 2048]
            at = (((part[:, None] + shift) * odd) >> np.uint32(16)).astype(np.int32)
            at += level[i : i + 2048, None]
            values = least[at]
            row = values.argmin(axis=0)
            value = values[row, np.arange(len(row))]
            better = value < best
            best = np.where(better, value, best)
            which = np.where(better, i + row, which)
        at = ((h[which] + shift) * odd >> np.uint32(16)).astype(np.int64) + level[which]
        draws = h[which].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + t[at].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        draws ^= draws >> np.uint64(31)
        keys = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for k in range(ROWS):
            keys = (keys ^ draws[k::ROWS]) * np.uint64(0x9FB21C651E98DF25)
            keys ^= keys >> np.uint64(35)
        return keys.view(np.int64)

    def total(self, h: np.ndarray, counts: bytes) -> float:
        return float(np.exp(self.levels(h, counts) * GRID).sum())

    def similarity(self, a: tuple[bytes, bytes], b: tuple[bytes, bytes]) -> float:
        """Weighted Jaccard similarity of two sets."""
        ha, hb = np.frombuffer(a[0], np.uint32), np.frombuffer(b[0], np.uint32)
        wa, wb = np.exp(self.levels(ha, a[1]) * GRID), np.exp(self.levels(hb, b[1]) * GRID)
        at = np.searchsorted(hb, ha)
        same = np.flatnonzero(hb[np.minimum(at, len(hb) - 1)] == ha) if len(hb) else np.zeros(0, np.int64)
        shared = np.minimum(wa[same], wb[at[same]]).sum()
        return float(shared / max(wa.sum() + wb.sum() - shared, 1e-12))


def _confirmed(pairs: DataFrame, sets: DataFrame, sampler, similarity: float) -> DataFrame:
    """Of pairs (a, b) those that are similar enough."""
    right = look_up(pairs, "a", sets.withColumnsRenamed({"rid": "b", "shingles": "sb", "counts": "cb"}), ["b"])
    both = right.join(sets.withColumnsRenamed({"rid": "a", "shingles": "sa", "counts": "ca"}).hint("merge"), "a").select("a", "b", "sa", "ca", "sb", "cb")

    def run(batches):
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True)
            keep = pa.array([sampler.value.similarity((sa, ca), (sb, cb)) >= similarity for sa, ca, sb, cb in rows], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return arrow_map(both, run, "a long, b long")


def block_links(sampler: Sampler, similarity: float, chunks: np.ndarray, labels: np.ndarray, keys: np.ndarray, band: int, sets: list[tuple[bytes, bytes]]) -> list[tuple[int, int]]:
    """Pairs (i, j) of a block's nodes that join its classes: all pairs of different classes and, if the block has two chunks, of different chunks.

    `keys` has a row of band keys for each node; a pair that shares a key of a band before `band` is left to that band."""
    n, both = len(sets), chunks.min() != chunks.max()
    hashes = [np.frombuffer(h, np.uint32) for h, _ in sets]
    weights = np.concatenate([np.exp(sampler.levels(h, c) * GRID) for h, (_, c) in zip(hashes, sets, strict=True)])
    _, ids = np.unique(np.concatenate(hashes), return_inverse=True)
    starts = np.cumsum([0, *map(len, hashes)])
    totals = np.add.reduceat(weights, starts[:-1])
    dense = np.zeros(ids.max() + 1)
    _, group = np.unique(labels, return_inverse=True)
    found = []
    for i in range(n - 1):
        j = np.arange(i + 1, n)
        open_ = (group[j] != group[i]) & (np.minimum(totals[i], totals[j]) >= similarity * np.maximum(totals[i], totals[j]) * (1 - 1e-9))
        if both:
            open_ &= chunks[j] != chunks[i]
        j = j[open_]
        if len(j) and band:
            j = j[~(keys[j, :band] == keys[i, :band]).any(axis=1)]
        if not len(j):
            continue
        own = slice(starts[i], starts[i + 1])
        dense[ids[own]] = weights[own]
        low = starts[j[0]]
        shared = np.add.reduceat(np.minimum(weights[low:], dense[ids[low:]]), starts[j[0] : -1] - low)[j - j[0]]
        dense[ids[own]] = 0
        alike = shared / np.maximum(totals[i] + totals[j] - shared, 1e-12)
        for k in j[alike >= similarity - 1e-9].tolist():
            if group[k] != group[i] and sampler.similarity(sets[i], sets[k]) >= similarity:
                found.append((i, k))
                group[group == group[k]] = group[i]
    return found


def members_of(contents: DataFrame, names: list[str]) -> DataFrame:
    """(node, place, band, lead) of the buckets of two nodes or more; lead is the least node of the bucket. No bucket is gathered in one task."""
    banded = contents.where("bytes > 0").select("node", F.posexplode(F.array(*names)).alias("place", "band"), F.pmod(F.xxhash64("node"), F.lit(SALTS)).alias("salt"))
    shares = banded.groupBy("band", "salt").agg(F.count("*").alias("n"), F.min("node").alias("lead"))
    buckets = shares.groupBy("band").agg(F.sum("n").alias("n"), F.min("lead").alias("lead"), F.collect_list("salt").alias("salts")).where("n > 1")  # at most SALTS salts
    return banded.join(buckets.select("band", "lead", F.explode("salts").alias("salt")).hint("merge"), ["band", "salt"]).drop("salt")


def mixed_buckets(tagged: DataFrame) -> DataFrame:
    """The rows of tagged (members with label, a written table) of the buckets that hold several classes; of buckets with the same nodes that of the first band alone."""
    whole = F.struct(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    several = tagged.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high"), whole.alias("whole"), F.min("place").alias("place")).where("low < high")
    chosen = several.groupBy("whole").agg(F.min(F.struct("place", "band")).alias("first")).select("first.band")
    return look_up(tagged, "node", chosen, ["band"])


def mixed_links(mixed: DataFrame, contents: DataFrame, names: list[str], sets: DataFrame, sampler, similarity: float, scratch: Scratch) -> DataFrame:
    """Links (a, b) between labels, from all pairs of nodes of different classes in the buckets of `mixed` (a written table)."""
    # pairs at the similarity lie in one weight class or in two that are next to each other
    step = -np.log(similarity * (1 - 1e-6))
    size = F.greatest(F.count("*") / F.lit(CHUNK), F.sum("bytes") / F.lit(CHUNK_BYTES))
    by_label = mixed.groupBy("band", "label").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    largest = by_label.groupBy("band").agg(F.max_by("label", F.struct("n", "label")).alias("major"), (F.greatest(F.sum("n") / F.lit(CHUNK), F.sum("bytes") / F.lit(CHUNK_BYTES)) <= 1).alias("whole"))
    # a part is a weight class, of the bucket's largest class (odd numbers, no pairs among its own nodes) or of the others (even numbers)
    part = F.floor(F.ln("weight") / F.lit(step)).cast("int") * 2 + (F.col("label") == F.col("major")).cast("int")
    parted = scratch.put("parted", look_up(mixed, "node", largest, ["band"]).select("band", "place", "node", "label", F.when(F.col("whole"), F.lit(0)).otherwise(part).alias("part"), "bytes"))
    chunks = parted.groupBy("band", "part").agg(F.ceil(size).cast("int").alias("n"))
    by_part = chunks.groupBy("band").agg(F.map_from_entries(F.collect_list(F.struct("part", "n"))).alias("n"))  # two entries for each factor of 0.8 in weight
    here = look_up(parted, "node", by_part, ["band"]).withColumn("c", F.pmod(F.xxhash64("node"), F.element_at("n", F.col("part"))).cast("int"))
    chunk = lambda p, c: F.struct(p.alias("p"), c.alias("c"))
    own, odd = chunk(F.col("part"), F.col("c")), F.col("part") % 2

    def beside(d: int, kind: int):
        """The chunks of the part d weight classes further; none of a second odd part."""
        p = F.col("part") - odd + 2 * d + kind
        n = F.coalesce(F.try_element_at("n", p), F.lit(0)) * (1 - odd * kind)
        return F.slice(F.transform(F.sequence(F.lit(0), n), lambda c: chunk(p, c)), 1, n)

    others = F.concat(*(beside(d, kind) for d in (-1, 0, 1) for kind in (0, 1)))
    placed = here.withColumn("own", own).withColumn("other", F.explode(others)).select("band", "place", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "label")
    rows = placed.join(contents.select("node", F.array(*names).alias("keys")), "node").join(sets.withColumnRenamed("rid", "node"), "node").select("band", "place", "i", "j", (F.col("own") == F.col("i")).cast("int").alias("side"), "node", "label", "keys", "shingles", "counts")

    def run(block: pa.Table) -> pa.Table:
        label, keys = block["label"].to_numpy(), np.array(block["keys"].to_pylist(), dtype=np.int64)
        pairs = block_links(sampler.value, similarity, block["side"].to_numpy(), label, keys, block["place"][0].as_py(), list(zip(block["shingles"].to_pylist(), block["counts"].to_pylist(), strict=True)))
        return pa.table({"a": pa.array([int(label[i]) for i, _ in pairs], pa.int64()), "b": pa.array([int(label[j]) for _, j in pairs], pa.int64())})

    return rows.groupBy("band", "i", "j").applyInArrow(run, "a long, b long")


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(v, label) of all nodes in edges (a, b): the least node of each connected component, as the table `name`."""
    both = scratch.put("both-ways", edges.unionByName(edges.selectExpr("b AS a", "a AS b")).distinct())
    labels = scratch.put(name, both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("a")).alias("label")))
    while True:
        near = look_up(both, "a", labels.selectExpr("v AS b", "label AS other"), ["b"]).groupBy(F.col("a").alias("v")).agg(F.min("other").alias("other"))
        jump = look_up(labels, "v", labels.selectExpr("v AS label", "label AS next"), ["label"])
        new = scratch.put(name, jump.join(near, "v").select("v", F.col("label").alias("old"), F.least("next", "other").alias("label")))
        labels = new.select("v", "label")
        if new.where("label < old").isEmpty():
            scratch.drop("both-ways")
            return labels


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """A row for each row of docs: rid, doc (its key), body (xxhash64 of the text), node (a number shared by equal texts), label (the number of its class) and class_id (the least key of the class, or its substitute)."""
    spark = docs.sparkSession
    with Scratch(spark, files_for(docs)) as scratch:
        return materialise(_classes(docs, key, text, similarity, scratch), "near-classes", scratch.files)


def _classes(docs: DataFrame, key: str, text: str, similarity: float, scratch: Scratch) -> DataFrame:
    spark = docs.sparkSession
    sets = scratch.put("shingles", shingle_sets(docs, key, text), numbered=True)
    rows = scratch.put("rows", sets.select("rid", "doc", "body", "c1", "c2"))
    sampler = spark.sparkContext.broadcast(Sampler(idf_levels(sets)))  # 1 MB at every input size
    names = [f"k{i}" for i in range(BANDS)]

    def sign(batches):
        for batch in batches:
            each = list(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True))
            bands = [sampler.value.bands(np.frombuffer(h, np.uint32), c) if h else np.zeros(BANDS, np.int64) for h, c in each]
            keys = np.array(bands, dtype=np.int64).reshape(-1, BANDS)
            weights = [sampler.value.total(np.frombuffer(h, np.uint32), c) for h, c in each]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([len(h) for h, _ in each], pa.int64()), pa.array(weights, pa.float64()), *(pa.array(keys[:, i]) for i in range(BANDS))], names=["rid", "doc", "c1", "c2", "bytes", "weight", *names])

    kind = docs.schema[key].dataType.simpleString()
    signed = arrow_map(sets.select("rid", "doc", "c1", "c2", "shingles", "counts"), sign, f"rid long, doc {kind}, c1 long, c2 long, bytes long, weight double, " + ", ".join(f"{k} long" for k in names))
    # copies have the same keys, so one partial aggregate puts a group of any size into one row
    contents = scratch.put("contents", signed.groupBy("c1", "c2").agg(F.min("rid").alias("node"), F.min("doc").alias("first"), *(F.min(k).alias(k) for k in ("bytes", "weight", *names))))
    members = scratch.put("members", members_of(contents, names))
    # only the sets of nodes that share a bucket are looked at again: they are moved once, at every size by a shuffle
    shared = members.select(F.col("node").alias("rid")).distinct()
    kept = scratch.put("shared-sets", sets.select("rid", "shingles", "counts").join(shared.hint("merge"), "rid", "left_semi"))
    scratch.drop("shingles")
    stars = scratch.put("pairs", members.where("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b")).distinct())
    labels = components(scratch.put("links", _confirmed(stars, kept, sampler, similarity)), scratch, "labels")
    own = F.col("node") == F.col("v")
    tagged = scratch.put("tagged", members.join(labels, own, "left").select("node", "place", "band", F.coalesce("label", "node").alias("label")))
    scratch.drop("pairs", "members")
    mixed = scratch.put("mixed", mixed_buckets(tagged).join(contents.select("node", "bytes", "weight"), "node"))
    scratch.drop("tagged")
    found = scratch.put("links", mixed_links(mixed, contents, names, kept, sampler, similarity, scratch))
    classes = scratch.put("classes", contents.join(labels, own, "left").select("c1", "c2", "node", "first", F.coalesce("label", "node").alias("label")))
    if not found.isEmpty():
        joined = components(found, scratch, "joined-labels").selectExpr("v AS label", "label AS least")
        classes = scratch.put("classes", look_up(classes, "node", joined, ["label"], "left").select("c1", "c2", "node", "first", F.coalesce("least", "label").alias("label")))
    scratch.drop("shared-sets", "mixed", "parted", "links")
    ids = _class_ids(classes.groupBy("label").agg(F.min("first").alias("class_id")), rows)
    whole = look_up(classes, "node", ids, ["label"]).select("c1", "c2", "node", "label", "class_id")
    return look_up(rows, "rid", whole, ["c1", "c2"]).select("rid", "doc", "body", "node", "label", "class_id")


def _class_ids(ids: DataFrame, rows: DataFrame) -> DataFrame:
    """(label, class_id) with another class_id for each class whose least key is null or not its own alone."""
    kind = ids.schema["class_id"].dataType
    if isinstance(kind, T.IntegralType):
        low = min(0, rows.agg(F.min("doc")).first()[0] or 0)
        ids, own = ids.withColumn("class_id", F.col("class_id").cast("long")), F.lit(low).cast("long") - 1 - F.col("label")
    elif isinstance(kind, T.StringType):
        own = F.concat(F.coalesce("class_id", F.lit("")), F.lit("#"), F.col("label").cast("string"))
    else:
        return ids
    known = ids.where("class_id IS NOT NULL")
    shared = known.groupBy("class_id").agg(F.count("*").alias("n")).where("n > 1")
    named = known.join(shared, "class_id", "left").select("label", F.when(F.col("n").isNull(), F.col("class_id")).otherwise(own).alias("class_id"))
    return named.unionByName(ids.where("class_id IS NULL").select("label", own.alias("class_id")))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each class: that of the least key (of rows that share it, the first)."""
    rows = near_duplicates(docs, key, text, similarity)
    first = rows.groupBy("label").agg(F.min(F.struct(F.col("doc").isNull(), "doc", "rid", "body")).alias("row"))
    chosen = first.select(F.col("row.doc").alias("__doc"), F.col("row.body").alias("__body"))
    same = docs[key].eqNullSafe(chosen["__doc"]) & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == chosen["__body"])
    left = docs.join(chosen, same, "left_semi")
    repeated = rows.groupBy("doc", "body").count().where("count > 1").limit(1).count()
    return left.dropDuplicates([key, text]) if repeated else left


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select(F.col("doc").alias("doc_id"), "class_id")
