"""Removal of lines that several documents share.

Keys of lines (the stripped, lower-cased line) are hashed to 128 bits. The hashes are range-partitioned with document
and position as secondary sort keys, so a very common line spreads over as many partitions as it needs. Each task
streams its sorted range: the first occurrence of a run is kept, later ones are dropped once the run is known to be
frequent enough. Only the runs at a task's two ends can go on in a neighbour; their counts (at most two rows for each
task) are added up apart and settle the few rows left open. What comes back is a compressed bitmap of kept lines for
each document that loses any; texts stay where they are until the bitmap is applied.

A document is a row: a row given twice counts as two documents, and rows that share the largest doc_id all keep the
line. A null doc_id sorts below all others; ids that are no integers are refused. Null and empty texts are one empty line,
which has no key. An empty table gives an empty result. Lines and texts of any length are read whole. Columns of docs with
the names of those that are worked with here stay as they are.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, arrow_map, files_for, look_up, materialise, table

BLANKS = " \t\n\x0b\x0c\r"
LEAST_ID = -(1 << 63)
MIN_CHARS, MIN_DOCS = 20, 3


def line_key(line: str) -> bytes:
    return line.strip(BLANKS).encode("utf-8", "surrogatepass").lower()


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    if not isinstance(docs.schema[key].dataType, T.IntegralType):
        raise ValueError(f"{key} must be an integer: the largest one keeps a line")
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(LEAST_ID)).alias("doc"), F.xxhash64(body).alias("body"), body.alias("text"))


def line_hashes(docs: DataFrame, key: str, text: str, min_chars: int) -> DataFrame:
    """A row for each document and distinct key: hash, document, the line numbers with that key."""

    def run(batches):
        for batch in batches:
            h1, h2, doc, body, lines = [], [], [], [], []
            for d, b, t in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                found: dict[bytes, list[int]] = {}
                for n, line in enumerate(t.split("\n")):
                    if len(line) >= min_chars and len(line.strip(BLANKS)) >= min_chars:
                        found.setdefault(xxhash.xxh3_128_digest(line_key(line)), []).append(n)
                for digest, at in found.items():
                    h1.append(int.from_bytes(digest[:8], "big", signed=True))
                    h2.append(int.from_bytes(digest[8:], "big", signed=True))
                    doc.append(d)
                    body.append(b)
                    lines.append(at)
            yield pa.RecordBatch.from_arrays([pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(doc, pa.int64()), pa.array(body, pa.int64()), pa.array(lines, pa.list_(pa.int32()))], names=["h1", "h2", "doc", "body", "lines"])

    return arrow_map(_keyed(docs, key, text), run, "h1 long, h2 long, doc long, body long, lines array<int>")


DROP, OPEN, EDGE = 0, 1, 2


def stream_runs(ordered: DataFrame, min_docs: int) -> DataFrame:
    """Over ranges sorted by hash and falling document: rows to DROP, rows left OPEN, and the counts of EDGE runs."""
    names = ["kind", "h1", "h2", "doc", "body", "lines", "n"]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int64()]

    def run(batches):
        out: list[tuple] = []
        current, largest, n, first, pending = None, 0, 0, True, []

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)
            out.clear()
            return batch

        for batch in batches:
            for h1, h2, doc, body, lines in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if (h1, h2) != current:
                    if current is not None and first:
                        out.append((EDGE, *current, largest, 0, [], n))
                        first = False
                    current, largest, n, pending = (h1, h2), doc, 0, []
                n += 1
                row = (h1, h2, doc, body, lines, 0)
                if first:
                    out.append((OPEN, *row))
                elif n < min_docs:
                    pending.append(row)
                else:
                    out += [(DROP, *r) for r in (*pending, row) if r[2] < largest]
                    pending = []
            if out:
                yield flush()
        if current is not None:
            out += [(OPEN, *r) for r in pending]
            out.append((EDGE, *current, largest, 0, [], n))
            yield flush()

    return arrow_map(ordered, run, "kind int, h1 long, h2 long, doc long, body long, lines array<int>, n long")


def pack_bitmap(dropped: list[int]) -> bytes:
    """zlib of one bit for each line up to the last dropped one, 1 = keep; lines beyond are kept."""
    keep = np.ones(max(dropped) + 1, dtype=np.uint8)
    keep[dropped] = 0
    return zlib.compress(np.packbits(keep, bitorder="little").tobytes() + (len(keep) % 8).to_bytes(1, "little"))


def unpack_bitmap(bitmap: bytes) -> np.ndarray:
    raw = zlib.decompress(bitmap)
    bits = np.unpackbits(np.frombuffer(raw[:-1], dtype=np.uint8), bitorder="little")
    return bits[: len(bits) - (8 - raw[-1]) % 8].astype(bool)


def apply_bitmap(text: str, bitmap: bytes | None) -> str:
    if bitmap is None:
        return text
    lines, keep = text.split("\n"), unpack_bitmap(bitmap)
    return "\n".join(x for i, x in enumerate(lines) if i >= len(keep) or keep[i])


def keep_bitmaps(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc, body, keep_bitmap, n_dropped) of the documents that lose lines; body is the text's xxhash64."""
    order = [F.col("h1"), F.col("h2"), F.col("doc").desc(), F.col("body")]
    with Scratch(docs.sparkSession, files_for(docs)) as scratch:
        hashes = scratch.put("line-hashes", line_hashes(docs, key, text, min_chars))  # the range partitioner reads it twice
        runs = scratch.put("line-runs", stream_runs(hashes.repartitionByRange(*order).sortWithinPartitions(*order), min_docs))
        scratch.drop("line-hashes")
        return materialise(_bitmaps(runs, min_docs), "bitmaps", scratch.files)


def _bitmaps(runs: DataFrame, min_docs: int) -> DataFrame:
    # at most two rows for each task of the pass that made the runs
    edges = runs.where(F.col("kind") == EDGE).groupBy("h1", "h2").agg(F.sum("n").alias("total"), F.max("doc").alias("largest"))
    opens = runs.where(F.col("kind") == OPEN).select("h1", "h2", "doc", "body", "lines")
    settled = look_up(opens, "body", edges, ["h1", "h2"]).where((F.col("total") >= min_docs) & (F.col("doc") < F.col("largest")))
    drops = runs.where(F.col("kind") == DROP).select("doc", "body", "lines").unionByName(settled.select("doc", "body", "lines"))
    grouped = drops.groupBy("doc", "body").agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("lines"))

    def pack(batches):
        for batch in batches:
            lines = batch.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([pack_bitmap(x) for x in lines], pa.binary()), pa.array([len(x) for x in lines], pa.int64())], names=["doc", "body", "keep_bitmap", "n_dropped"])

    return arrow_map(grouped, pack, "doc long, body long, keep_bitmap binary, n_dropped long")


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(docs, keep_bitmap, n_dropped): each row of docs as a struct beside its bitmap, null where nothing is dropped."""
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("docs"))
    own = row.withColumns({"doc": F.coalesce(F.col("docs")[key].cast("long"), F.lit(LEAST_ID)), "body": F.xxhash64(F.coalesce(F.col("docs")[text], F.lit("")))})
    return own.join(bitmaps, ["doc", "body"], "left").select("docs", "keep_bitmap", "n_dropped")


def drop_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """docs with the shared lines taken out of the text (a null text stays null); all other columns as they are."""
    marked = with_bitmaps(docs, keep_bitmaps(docs, key, text, **limits), key, text)
    at, names = docs.columns.index(text), docs.columns

    def run(batches):
        for batch in batches:
            bitmaps, column = batch.column(len(names)).to_pylist(), batch.column(at).to_pylist()
            new = [t if t is None else apply_bitmap(t, b) for t, b in zip(column, bitmaps, strict=True)]
            arrays = [pa.array(new, batch.schema.field(at).type) if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return arrow_map(marked.select(*(F.col("docs")[c].alias(f"c{i}") for i, c in enumerate(names)), "keep_bitmap"), run, schema)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = with_bitmaps(docs, keep_bitmaps(docs)).select("docs.doc_id", F.coalesce("docs.text", F.lit("")).alias("text"), "keep_bitmap", F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"))

    def run(batches):
        for batch in batches:
            values = batch.column(1).to_pylist()
            shas = [hashlib.sha256(apply_bitmap(t, b).encode("utf-8", "surrogatepass")).hexdigest() for t, b in zip(values, batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.count("\n") + 1 for t in values], pa.int64()), batch.column(3), pa.array(shas, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return arrow_map(marked, run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (
  SELECT key, max(doc_id) AS largest FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (
  SELECT k.doc_id, k.n, k.line, f.key IS NOT NULL AND k.doc_id < f.largest AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
