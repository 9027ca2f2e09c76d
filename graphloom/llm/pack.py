"""Packing of token sequences into bins by minimum bin slack.

Texts are tokenised and cut where they exceed the capacity. The packing itself works on the histogram of piece
lengths, which has at most `capacity` rows at every input size: a bin starts with the longest length left, a subset-sum
dynamic programme over bit sets finds the fullest combination of the lengths available for its rest, and that
combination is removed as many times as the histogram holds it. The plan has a few entries for each length, however
many bins it stands for. Pieces then find their bin by their rank among the pieces of their length: each task ranks
its own pieces, and the tasks' counts are summed up in front of them, so no length is gathered in one task.

A worker holds one batch of texts and the ids of one text at a time, and the plan of the histogram.

Texts: null counts as empty; an empty text is the end token alone. Repeated documents are packed one by one. An empty table
gives no pieces. Pieces of equal length are interchangeable, and ranks break the tie. Columns besides key and text are not
read; the key may have any name but those of the columns that are returned.
"""

from __future__ import annotations

import json
import os
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import HELD, arrow_map, materialise, no_clash, table, texts, tokenizer_text

CAPACITY, END_ID, MEMO_WORDS = 4096, 1, 900_000
MARKS = ".,!?%*#$&;:"
#: The rules of a tokenizer file that allow its texts to be cut at blanks (fixed values).
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


class WordIds:
    """Token ids of a text as little-endian 32-bit bytes.

    Where the file's normaliser turns white space into blanks and its pre-tokenizer drops them, the ids of a text are those
    of its blank-separated stretches, and each stretch goes through the library once while it is remembered. Texts with a
    blank inside a special string, and all texts of files with other rules, go through the library whole."""

    def __init__(self, spec: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.memo: dict[str, bytes] = {"": b""}
        model = json.loads(spec)
        self.special = [t["content"] for t in model.get("added_tokens") or []]
        self.by_words = (model.get("normalizer"), model.get("pre_tokenizer")) == (NORMALIZER, PRE_TOKENIZER) and not any(c.isspace() for s in self.special for c in s)

    def parts(self, stretch: str) -> tuple[str, str]:
        """A stretch as a stem and marks behind it, which the pre-tokenizer always parts; ASCII stems in the lower case that the normaliser gives them.

        A stretch that may hold a special string, in this case or in another, stays as it is."""
        if any(s[0] in stretch for s in self.special if s):
            return stretch, ""
        stem = stretch.rstrip(MARKS)
        if not stem or not stem[-1].lower()[-1].isalpha():
            stem = stretch
        return stem.lower() if stem.isascii() else stem, stretch[len(stem) :]

    def encode(self, values: list[str]) -> list[bytes]:
        if not self.by_words:
            return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(values, add_special_tokens=False)]
        lists = [t.replace("\n", " ").split(" ") for t in values]
        missing = set().union(*lists).difference(self.memo)
        if len(self.memo) + len(missing) > MEMO_WORDS:
            self.memo = {"": b""}
            missing = set().union(*lists).difference(self.memo)
        if missing:
            split = {w: self.parts(w) for w in missing}
            order = sorted({x for both in split.values() for x in both}.difference(self.memo))
            for i in range(0, len(order), 20_000):
                part = order[i : i + 20_000]
                for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                    self.memo[w] = np.array(e.ids, dtype="<u4").tobytes()
            self.memo.update({w: self.memo[stem] + self.memo[tail] for w, (stem, tail) in split.items()})
        get = self.memo.__getitem__
        return [b"".join(map(get, words)) for words in lists]


@lru_cache(maxsize=2)
def _ids(spec: str) -> WordIds:
    return WordIds(spec)


HELD[__name__] = _ids.cache_clear  # hundreds of thousands of words


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """A row for each piece: key, piece, start, length, ids_crc32, with `ids` if asked for, and its task and rank there among equal lengths."""
    no_clash(key, "piece", "start", "length", "ids_crc32", "task", "place", "ids", "rank", "before", "sequence_id", "offset")
    spec = docs.sparkSession.sparkContext.broadcast(tokenizer_text(tokenizer))  # a vocabulary file: a few MB at every input size
    kind = docs.schema[key].dataType.simpleString()
    end = np.array([END_ID], dtype="<u4").tobytes()

    def run(batches):
        encoder, seen, task = _ids(spec.value), Counter(), TaskContext.get().partitionId()
        for batch in batches:
            keys, rows, ids = [], [], []
            for i, body in enumerate(encoder.encode(batch.column(1).to_pylist())):
                body += end
                for piece, start in enumerate(range(0, len(body) // 4, capacity)):
                    own = body[4 * start : 4 * (start + capacity)]
                    n = len(own) // 4
                    keys.append(i)
                    rows.append((piece, start, n, zlib.crc32(own), task, seen[n]))
                    seen[n] += 1
                    ids.append(own)
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), *columns, *([pa.array(ids, pa.binary())] if with_ids else [])], names=[key, "piece", "start", "length", "ids_crc32", "task", "place", *(["ids"] if with_ids else [])])

    schema = f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long, task int, place long" + ", ids binary" * with_ids
    return arrow_map(texts(docs, key, text=text), run, schema)


def fullest(available: dict[int, int], room: int) -> list[int]:
    """The lengths, each used at most as often as available, whose sum comes closest to room from below."""
    if available.get(room, 0) > 0:
        return [room]
    mask, reached, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x, n in available.items() if n > 0 and x <= room), reverse=True):
        for _ in range(min(available[length], room // length)):
            new = (reached << length) & mask & ~reached
            if not new:
                break
            steps.append((length, new))
            reached |= new
        if reached >> room & 1:
            break
    at, chosen = reached.bit_length() - 1, []
    for length, new in reversed(steps):
        if new >> at & 1:
            chosen.append(length)
            at -= length
    return chosen


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Rows (length, first rank, ranks' end, copies in a bin, first bin, offset in the bin), and the number of bins."""
    left, used, rows, bins = dict(histogram), Counter(), [], 0
    for longest in sorted(left, reverse=True):
        while left[longest]:
            left[longest] -= 1
            combination = Counter([longest, *fullest(left, capacity - longest)])
            left[longest] += 1
            times = min(left[x] // n for x, n in combination.items())
            offset = 0
            for x, n in combination.items():
                rows.append((x, used[x], used[x] + n * times, n, bins, offset))
                used[x] += n * times
                left[x] -= n * times
                offset += n * x
            bins += times
    return rows, bins


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (a written table of `cut_pieces`) with sequence_id and offset in place of task and place."""
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    rows, _ = plan_bins(histogram, capacity)
    plan = pieces.sparkSession.sparkContext.broadcast(np.array(sorted(rows), dtype=np.int64).reshape(-1, 6))  # a few rows for each length
    counts = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fronts = counts.select("task", "length", before.cast("long").alias("before"))
    ranked = pieces.join(fronts, ["task", "length"]).withColumn("rank", F.col("place") + F.col("before")).drop("task", "place", "before")
    names = [c for c in ranked.columns if c != "rank"]

    def run(batches):
        table_ = plan.value
        keys = table_[:, 0] * (1 << 44) + table_[:, 1]
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            rank = batch.column(batch.schema.get_field_index("rank")).to_numpy()
            row = table_[np.searchsorted(keys, length * (1 << 44) + rank, "right") - 1]
            nth, copy = np.divmod(rank - row[:, 1], row[:, 3])
            added = [pa.array(row[:, 4] + nth, pa.int64()), pa.array(row[:, 5] + copy * length, pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), *added], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return arrow_map(ranked, run, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack; each sequence is its pieces in order of offset."""
    return pack(materialise(cut_pieces(docs, tokenizer, capacity, key, text, with_ids), "pieces"), capacity)


def packed(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    done = pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return done.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
