"""Token counts by a tokenizer compiled to finite-state transducers.

`ByteTransducer` is the deterministic transducer of a byte-level BPE: a state stands for the bytes of a pre-token read
so far as later tokens depend on them, and each transition carries the number of tokens that it emits (the change in
the count, which is below 0 when tokens merge). Transitions are compiled on first use from the vocabulary and the merges; when more than
`max_states` states exist the table is dropped and compiled again, so memory is bounded.

`TokenCounter` puts the pre-tokenizer in front of it. A blank after a character that is no white space always starts
a new pre-token, so texts are cut there; the stretches between cuts are the transducer's compound symbols and their
counts are kept as compound transitions. A chunk that is cut anywhere has a state map (open head, emitted count, open
tail); what is open is kept as text, for the state that a pre-token leaves the transducer in depends on where it ends.
Maps compose associatively, so the maps of a long text's chunks are combined by a prefix scan, which gives the tokens up
to the end of each chunk (`chunk_tokens`), the places at which to cut a long text, and with the last one its count.

Texts: null counts as empty, an empty text has no tokens, texts of any length are read whole. The added special token
inside a text is one token, which is the library's default; chunks begin anew after it. Repeated rows are counted one by
one; an empty table gives no rows. Columns besides key and text are not read; the key may have any name but those of the
columns that are returned.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from itertools import accumulate, pairwise
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_map, no_clash, table, texts, tokenizer_text

#: The pre-tokenizer of the byte-level vocabularies (fixed value).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRE_TOKENIZER = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
CHUNK, SHORT = 1 << 16, 64


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteTransducer:
    def __init__(self, vocab: dict[str, int], merges: list, max_states: int = 120_000) -> None:
        back = byte_alphabet()
        as_bytes = lambda s: bytes(back[c] for c in s)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.rank = {(as_bytes(a), as_bytes(b)): i for i, (a, b) in enumerate(pairs)}
        self.split: dict[bytes, tuple[bytes, bytes]] = {}
        for pair in self.rank:
            self.split.setdefault(pair[0] + pair[1], pair)
        self.tokens = {t for t in map(as_bytes, (s for s in vocab if all(c in back for c in s))) if len(t) == 1 or t in self.split}
        self.heads = {t[:n] for t in self.tokens for n in range(len(t))}
        self.max_states = max_states
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self.spines: tuple[dict, dict] = ({}, {})
        self.reset()

    def reset(self) -> None:
        self.edges: dict[int, tuple[int, int]] = {}
        self.states: list[tuple] = [(b"", (b"",), (0,))]
        self.known: dict[tuple, int] = {self.states[0]: 0}

    def merge(self, word: bytes) -> list[bytes]:
        """Plain merging, lowest rank first: the definition that the transitions are compiled from."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best, at = min((self.rank.get((parts[i], parts[i + 1]), 1 << 60), i) for i in range(len(parts) - 1))
            if best == 1 << 60:
                break
            pair, out, i = (parts[at], parts[at + 1]), [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def spine(self, token: bytes, side: int) -> list[tuple[bytes, int, int]]:
        """The pieces that lie at a token's left (0) or right (1) end while it is merged: (piece, made at, consumed at)."""
        found = self.spines[side].get(token)
        if found is None:
            found, until = [], 1 << 60
            while token in self.split:
                made = self.rank[self.split[token]]
                found.append((token, made, until))
                token, until = self.split[token][side], made
            found.append((token, -1, until))
            self.spines[side][token if len(found) == 1 else found[0][0]] = found
        return found

    def follows(self, left: bytes, right: bytes) -> bool:
        """Whether two tokens can stand side by side: no merge across their border comes before the pieces there are consumed.

        Of equal ranks the leftmost merge is made first."""
        found = self.fits.get((left, right))
        if found is None:
            if len(self.fits) > 200_000:
                self.fits.clear()
            found = True
            for x, x_made, x_until in self.spine(left, 1):
                for y, y_made, y_until in self.spine(right, 0):
                    r = self.rank.get((x, y))
                    if r is not None and x_made < r and y_made < r and r < x_until and r <= y_until:
                        found = False
            self.fits[left, right] = found
        return found

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        """The transition of a state on a byte.

        A state holds the longest suffix read that begins some token and, for each place in it where such a beginning
        starts, the token that ends there and the count there less the present count: all that later tokens can depend on."""
        suffix, before, counts = self.states[state]
        read = suffix + bytes((byte,))
        for at in range(len(read)):
            token = read[at:]
            if token in self.tokens and before[at] is not None and (not before[at] or self.follows(before[at], token)):
                break
        else:
            raise ValueError("the vocabulary has no token for a byte")
        emitted = counts[at] + 1
        live = [read[k:] in self.heads for k in range(len(read))]
        first = live.index(True) if True in live else len(read)
        kept = (
            read[first:],
            (*(before[k] if live[k] else None for k in range(first, len(read))), token),
            (*(counts[k] - emitted if live[k] else 0 for k in range(first, len(read))), 0),
        )
        to = self.known.get(kept)
        if to is None:
            to = self.known[kept] = len(self.states)
            self.states.append(kept)
        edge = self.edges[state << 8 | byte] = (to, emitted)
        return edge

    def count(self, word: bytes) -> int:
        """Tokens of one pre-token: the sum of what its transitions emit."""
        if len(self.states) > self.max_states:
            self.reset()
        state, total, edges = 0, 0, self.edges
        for byte in word:
            state, emitted = edges.get(state << 8 | byte) or self.compile(state, byte)
            total += emitted
        return total

    def running(self, word: bytes, places: list[int]) -> list[int]:
        """Tokens of each beginning of a pre-token, given by ascending numbers of bytes: what the transitions have emitted so far. Time is in proportion to the word, memory to max_states."""
        out, state, total, done = [], 0, 0, 0
        for place in places:
            for byte in word[done:place]:
                if len(self.states) > self.max_states:
                    kept = self.states[state]
                    self.reset()
                    state = self.known.setdefault(kept, len(self.states))
                    if state == len(self.states):
                        self.states.append(kept)
                state, emitted = self.edges.get(state << 8 | byte) or self.compile(state, byte)
                total += emitted
            done = place
            out.append(total)
        return out


class ChunkMap(NamedTuple):
    """What a chunk does: `head` joins what came before, `tail` what comes after. No cut inside: all is head, tail is None."""

    head: str
    emitted: int
    tail: str | None


class TokenCounter:
    def __init__(self, spec: str, max_symbols: int = 500_000) -> None:
        model = json.loads(spec)
        self.fst = ByteTransducer(model["model"]["vocab"], model["model"]["merges"])
        self.special = [t["content"] for t in model.get("added_tokens", [])]
        if model.get("normalizer") or model.get("pre_tokenizer") != PRE_TOKENIZER:
            raise ValueError("this tokenizer file has other rules than a byte-level one without normaliser")
        self.pre = regex.compile(PRE_TOKEN)
        self.cut = re.compile(r"\s ")
        self.safe = regex.compile(r"(?<=\S)(?= )")
        # every border that no pre-token can cross, whatever stands around it: the ends of runs of letters, of numbers and of marks; a mark before a letter may be a contraction's
        self.wide = regex.compile(r"(?<=\S)(?=\s)|(?<=[\p{L}\p{N}])(?=[^\s\p{L}\p{N}])|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})|(?<=[^\s\p{L}\p{N}'])(?=[\p{L}\p{N}])")
        self.max_symbols = max_symbols
        outer = self

        class Symbols(dict):
            def __missing__(self, key: str) -> int:
                if len(self) > outer.max_symbols:
                    self.clear()
                n = self[key] = outer.stretch(" " + key)
                return n

        self.symbols = Symbols()
        self.inner: dict[str, int] = {}

    def stretch(self, text: str) -> int:
        """Tokens of a text that starts at a pre-token's start."""
        words, inner = self.pre.findall(text), self.inner
        if len(inner) > self.max_symbols:
            inner.clear()
        total = 0
        for w in words:
            n = inner.get(w)
            if n is None:
                n = self.fst.count(w.encode("utf-8", "replace"))
                if len(words) > 1 and len(w) < 48:
                    inner[w] = n
            total += n
        return total

    def plain(self, text: str) -> int:
        """Tokens of a text without special tokens."""
        if not text:
            return 0
        if self.cut.search(text):
            parts = self.safe.split(text)
            return self.stretch(parts[0]) + sum(self.symbols[p[1:]] if not p[1:2].isspace() else self.stretch(p) for p in parts[1:])
        first, *rest = text.split(" ")
        return (self.stretch(first) if first else 0) + sum(map(self.symbols.__getitem__, rest))

    def chunk_map(self, chunk: str) -> ChunkMap:
        cuts = [m.start() for m in (self.safe.search(chunk), next(self._last_cut(chunk), None)) if m]
        if not cuts:
            return ChunkMap(chunk, 0, None)
        first, last = cuts[0], cuts[-1]
        return ChunkMap(chunk[:first], self.plain(chunk[first:last]), chunk[last:])

    def _last_cut(self, chunk: str):
        for size in (256, 4096, len(chunk)):
            base = max(0, len(chunk) - size)
            found = None
            for found in self.wide.finditer(chunk, base):
                pass
            if found is not None:
                yield found
                return

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        if a.tail is None and b.tail is None:
            joined = self.chunk_map(a.head + b.head)
            return joined
        if a.tail is None:
            joined = self.chunk_map(a.head + b.head)
            return ChunkMap(joined.head, joined.emitted + self.plain(joined.tail) + b.emitted, b.tail) if joined.tail is not None else ChunkMap(joined.head, b.emitted, b.tail)
        joined = self.chunk_map(a.tail + b.head)  # the tail starts at a border that no pre-token crosses
        if b.tail is None:
            return ChunkMap(a.head, a.emitted + (self.plain(joined.head) + joined.emitted if joined.tail is not None else 0), joined.tail if joined.tail is not None else joined.head)
        return ChunkMap(a.head, a.emitted + self.plain(a.tail + b.head) + b.emitted, b.tail)

    def scan(self, maps: list[ChunkMap]) -> list[ChunkMap]:
        """Inclusive prefix scan: in each of log n rounds every map takes in the one `step` places before it."""
        step = 1
        while step < len(maps):
            maps = [self.compose(maps[i - step], m) if i >= step else m for i, m in enumerate(maps)]
            step *= 2
        return maps

    def finish(self, m: ChunkMap) -> int:
        return self.plain(m.head) + m.emitted + (self.plain(m.tail) if m.tail else 0)

    def open_prefixes(self, pieces: list[str]) -> list[int]:
        """Tokens up to the end of each piece of a text that starts at a pre-token's start: long runs are followed once, by the transducer's state."""
        text, ends = "".join(pieces), list(accumulate(map(len, pieces)))
        out, before, start, wanted = [0] * len(ends), 0, 0, 0
        cuts = (m.start() for m in self.wide.finditer(text))
        while wanted < len(ends):
            border = next(cuts, len(text))
            if border <= start and border < len(text):
                continue
            inside = []
            while wanted < len(ends) and (ends[wanted] < border or border == len(text)):
                inside.append(wanted)
                wanted += 1
            own = text[start:border]
            for k, n in zip(inside, self._within(own, [ends[k] - start for k in inside]), strict=True):
                out[k] = before + n
            if wanted < len(ends):
                before += self.stretch(own)
                start = border
        return out

    def _within(self, text: str, places: list[int]) -> list[int]:
        """Tokens of the beginnings of a text that holds no border, by ascending places."""
        if not places:
            return []
        words, at = [], 0
        for w in self.pre.findall(text):
            words.append((at, at + len(w)))
            at += len(w)
        out, done, i, asked = [], 0, 0, {}
        for p in places:  # the word that each place lies in, and the tokens before that word
            while i < len(words) and words[i][1] < p:
                done += self.stretch(text[slice(*words[i])])
                i += 1
            if i == len(words) or p - words[i][0] < SHORT or text[p - 1].isspace():
                # white space at an end is one pre-token, in the middle two
                first = words[i][0] if i < len(words) else at
                back = len(text[:p].rstrip()) if p and text[p - 1].isspace() else first
                if back < first:
                    out.append(self.stretch(text[:back]) + self.stretch(text[back:p]) if p - back < SHORT else self.stretch(text[:back]) + self.fst.running(text[back:p].encode("utf-8", "replace"), [len(text[back:p].encode("utf-8", "replace"))])[0])
                else:
                    out.append(done + self.stretch(text[first:p]))
            else:
                asked.setdefault(i, []).append((len(out), p))
                out.append(done)
        for i, own in asked.items():
            word = text[slice(*words[i])]
            sizes = [len(word[: p - words[i][0]].encode("utf-8", "replace")) for _, p in own] if len(own) < 3 else list(accumulate(len(word[a - words[i][0] : b - words[i][0]].encode("utf-8", "replace")) for a, b in pairwise([words[i][0], *(p for _, p in own)])))
            for (k, _), n in zip(own, self.fst.running(word.encode("utf-8", "replace"), sizes), strict=True):
                out[k] += n
        return out

    def _long(self, text: str, chunk: int) -> list[int]:
        """Tokens up to the end of each chunk of a text without special tokens, by a scan of the chunks' maps.

        Chunks that hold no border at all only make the open part before them longer: each such row of chunks is followed once, and the map behind it counts it."""
        maps = [self.chunk_map(text[at : at + chunk]) for at in range(0, len(text), chunk)]
        row, rows = [], []  # (first, last + 1) of the rows of chunks without a border
        for k, m in enumerate([*maps, ChunkMap("", 0, "")]):
            if k < len(maps) and m.tail is None:
                row.append(k)
            else:
                if len(row) > 1:
                    rows.append((row[0], row[-1] + 1))
                row = []
        kept, extra = {k: m for k, m in enumerate(maps)}, {}
        for first, end in rows:
            opening = [maps[first - 1].tail] if first else []
            pieces = [*opening, *(m.head for m in maps[first:end])]
            closed = end < len(maps)
            counts = self.open_prefixes([*pieces, maps[end].head] if closed else pieces)
            if first:
                kept[first - 1] = ChunkMap(kept[first - 1].head, kept[first - 1].emitted, "")
                extra[first - 1] = counts[0]
            for k, n in zip(range(first, end), counts[len(opening) :], strict=False):
                kept[k], extra[k] = None, n
            if closed:
                kept[end] = ChunkMap("", counts[-1] + maps[end].emitted, kept[end].tail)
        order = [k for k in range(len(maps)) if kept[k] is not None]
        done = dict(zip(order, map(self.finish, self.scan([kept[k] for k in order])), strict=True))
        out, last = [], 0
        for k in range(len(maps)):
            last = done.get(k, last)
            out.append(last + extra.get(k, 0))
        return out

    def prefixes(self, text: str, chunk: int = CHUNK) -> list[int]:
        """Tokens up to the end of each chunk; the last number is the text's count."""
        parts = [text]
        for s in self.special:
            if s in text:
                parts = [x for p in parts for x in p.split(s)]
        out, before = [], 0
        for i, p in enumerate(parts):
            own = [self.plain(p)] if len(p) <= chunk else self._long(p, chunk)
            own[-1] += i + 1 < len(parts)  # the special token behind it
            out += [before + n for n in own]
            before = out[-1]
        return out

    def count(self, text: str, chunk: int = CHUNK) -> int:
        return self.prefixes(text, chunk)[-1]


@lru_cache(maxsize=2)
def _counter(spec: str) -> TokenCounter:
    return TokenCounter(spec)


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_bytes (UTF-8), n_tokens and chunk_tokens of every text; one pass without a shuffle, one row for each row of docs."""
    no_clash(key, "n_bytes", "n_tokens", "chunk_tokens")
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(tokenizer_text(tokenizer))  # a vocabulary file: a few MB at every input size
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        counter = _counter(spec.value)
        for batch in batches:
            column = batch.column(1)
            values = column.to_pylist()
            counts = [counter.prefixes(t) for t in values]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode("utf-8")) for t in values], pa.int64()), pa.array([c[-1] for c in counts], pa.int64()), pa.array(counts, pa.list_(pa.int64()))],
                names=[key, "n_bytes", "n_tokens", "chunk_tokens"],
            )

    return arrow_map(texts(docs, key, text=text), run, f"`{key}` {kind}, n_bytes long, n_tokens long, chunk_tokens array<bigint>")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.selectExpr("doc_id", "n_bytes", "n_tokens", "n_tokens > 1024 AS over_limit", "chunk_tokens")
