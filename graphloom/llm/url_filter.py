"""URL rules held as a sorted array of 64-bit digests that workers map into memory.

A rule is a host and a path prefix with a verdict. The index file holds the sorted xxhash64 digests of the rule
strings, the offsets of the strings and the strings themselves. A URL is probed with each of its host suffixes
joined with each path prefix whose length some rule has; a binary search over the whole batch finds digests, and the
stored string settles collisions. The longest rule that fits wins (of equally long ones, that with the longer host).

Null URLs and URLs without `://` have an empty host and path and take the default verdict, as do URLs that no rule
fits. Repeated rows are judged one by one, an empty table gives no rows. A URL is read whole at any length; its probes are at most its host's
suffixes times the rules' different path lengths. A rule given twice counts once; given with two verdicts, it is an error.
"""

from __future__ import annotations

import os
import re
import struct
import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_map, table

MAGIC = b"URLDIG01"
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_AFTER = re.compile(r"[/?#]")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL, both empty without `://`."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    cut = _AFTER.search(rest)
    host, tail = (rest, "") if cut is None else (rest[: cut.start()], rest[cut.start() :])
    return host.translate(_UPPER), re.split(r"[?#]", tail, maxsplit=1)[0]


def pack_rules(rules: Iterable[tuple[str, str, str]], seed: int = 0) -> bytes:
    """The index file of (host, path, verdict) rules: header, digests, string offsets, verdicts, path lengths, strings."""
    seen: dict[tuple[str, str], str] = {}
    for host, path, verdict in rules:
        if seen.setdefault((host.translate(_UPPER), path), verdict) != verdict:
            raise ValueError(f"two verdicts for the rule {host}{path}")
    rows = sorted((xxhash.xxh64_intdigest(f"{h}\n{p}".encode(), seed), f"{h}\n{p}".encode(), v == "block") for (h, p), v in seen.items())
    strings = b"".join(r[1] for r in rows)
    ends = np.cumsum([0] + [len(r[1]) for r in rows], dtype=np.int64)
    lengths = np.array(sorted({len(p) for _, p in seen}), dtype=np.int64)
    return b"".join([
        MAGIC, struct.pack("<qqq", len(rows), len(lengths), seed), np.array([r[0] for r in rows], dtype="<u8").tobytes(),
        ends.astype("<i8").tobytes(), lengths.astype("<i8").tobytes(), bytes(r[2] for r in rows), strings,
    ])


class DigestIndex:
    """The index file mapped into memory; processes on one machine share its pages."""

    def __init__(self, path: str) -> None:
        raw = np.memmap(path, dtype=np.uint8, mode="r")
        if raw[:8].tobytes() != MAGIC:
            raise ValueError("not a digest index")
        n, m, self.seed = struct.unpack("<qqq", raw[8:32].tobytes())
        at = 32
        self.keys = raw[at : at + 8 * n].view("<u8")
        at += 8 * n
        self.ends = raw[at : at + 8 * (n + 1)].view("<i8")
        at += 8 * (n + 1)
        self.lengths = raw[at : at + 8 * m].view("<i8").tolist()
        at += 8 * m
        self.blocks = raw[at : at + n]
        self.strings = raw[at + n :]

    def probe(self, strings: list[bytes]) -> np.ndarray:
        """For each string the index of the equal stored string, or -1."""
        out = np.full(len(strings), -1, dtype=np.int64)
        if not strings or not len(self.keys):
            return out
        digests = np.fromiter((xxhash.xxh64_intdigest(s, self.seed) for s in strings), dtype=np.uint64, count=len(strings))
        at, end = np.searchsorted(self.keys, digests, "left"), np.searchsorted(self.keys, digests, "right")
        for i in np.flatnonzero(at < end):
            for k in range(at[i], end[i]):  # more than one only if stored digests collide
                if self.strings[self.ends[k] : self.ends[k + 1]].tobytes() == strings[i]:
                    out[i] = k
        return out

    def judge(self, urls: list[str | None], default: str) -> list[tuple[str, str, str | None, str]]:
        """(host, path, rule, verdict) of each URL."""
        parts, probes, owners = [split_url(u) for u in urls], [], []
        for i, (host, path) in enumerate(parts):
            starts = [0, *(m.end() for m in re.finditer(r"\.", host))] if host else []
            prefixes = [path[:n] for n in self.lengths if n <= len(path)]
            for s in starts:
                probes += [f"{host[s:]}\n{p}".encode("utf-8", "surrogatepass") for p in prefixes]
                owners += [i] * len(prefixes)
        best: dict[int, tuple[int, int, int]] = {}
        for i, k in zip(owners, self.probe(probes).tolist(), strict=True):
            if k >= 0:
                host, _, path = self.strings[self.ends[k] : self.ends[k + 1]].tobytes().decode("utf-8").partition("\n")
                best[i] = max(best.get(i, (-1, -1, -1)), (len(host) + len(path), len(host), k))
        out = []
        for i, (host, path) in enumerate(parts):
            if i in best:
                k = best[i][2]
                rule = self.strings[self.ends[k] : self.ends[k + 1]].tobytes().decode("utf-8").replace("\n", "", 1)
                out.append((host, path, rule, "block" if self.blocks[k] else "allow"))
            else:
                out.append((host, path, None, default))
        return out


def ship(spark: SparkSession, content: bytes) -> str:
    """Give a file to every executor, late ones included; its name there."""
    path = os.path.join(tempfile.mkdtemp(prefix="graphloom-"), f"urls-{uuid.uuid4().hex}.idx")
    with open(path, "wb") as out:
        out.write(content)
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]], url: str = "url", default: str = "allow") -> DataFrame:
    """pages' own columns with `url_host`, `url_path`, `url_rule` (null where no rule fits) and `url_verdict`.

    Rows keep their order and number; columns of pages that have one of those names are replaced. One pass, no shuffle."""
    name = ship(pages.sparkSession, pack_rules(rules))
    added = ("url_host", "url_path", "url_rule", "url_verdict")
    pages = pages.drop(*added)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema), *(f"{c} string" for c in added)])

    def judge(batches):
        index = DigestIndex(SparkFiles.get(name))
        for batch in batches:
            found = index.judge(batch.column(batch.schema.get_field_index(url)).to_pylist(), default)
            columns = [pa.array([r[k] for r in found], pa.string()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *added])

    return arrow_map(pages, judge, schema)


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), RULES)
    return judged.selectExpr("page_id", "url_host AS host", "url_path AS path", "url_rule AS rule", "url_verdict AS verdict")


SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw_host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
hosts AS (
  SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM parts),
rules(rhost, rpath, rverdict) AS (VALUES
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
fits AS (
  SELECT h.page_id, h.host, h.path, r.rhost || r.rpath AS rule, r.rverdict,
    row_number() OVER (PARTITION BY h.page_id, h.host, h.path ORDER BY length(r.rhost || r.rpath) DESC NULLS LAST, length(r.rhost) DESC) AS k
  FROM hosts h LEFT JOIN rules r ON (h.host = r.rhost OR ends_with(h.host, '.' || r.rhost)) AND starts_with(h.path, r.rpath))
SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict FROM fits WHERE k = 1
"""
