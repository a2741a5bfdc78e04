"""Byte-level BPE: text to ranked token ids and back.

``encode_words`` is the higher-order-function form: a fold over the bytes of each distinct word merges
the adjacent pair of the lowest rank, looked up in a literal rank map. ``encode``, ``decode`` and
``digests`` do the same merges in Arrow batches; the query uses these, since the fold costs too much
for every distinct word of a large corpus and its results would have to be joined back to every
occurrence of a word (README has the figures).
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import json
import re

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from agendry.llm.arrow import map_batches, utf8

#: Pieces whose ids a task keeps, in each of two generations; longer pieces than LONG are not kept.
CACHED, LONG = 300_000, 64
#: Code points below this are matched by plain character classes.
LATIN = 0x250
#: Maps that the literal rank table is dealt over, so that a lookup reads a few entries.
BUCKETS = 8192


@functools.lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def _plain(pattern: str) -> str:
    """The pattern with explicit classes of the characters below LATIN."""

    def members(kind: str) -> str:
        return "".join(f"\\u{i:04x}" for i in range(LATIN) if regex.fullmatch(kind, chr(i)))

    space, letter, number = members(r"\s"), members(r"\p{L}"), members(r"\p{N}")
    inner = {r"\s": space, r"\p{L}": letter, r"\p{N}": number}
    swap = lambda text, outer: re.sub(r"\\s|\\p\{[LN]\}", lambda m: f"[{inner[m[0]]}]" if outer else inner[m[0]], text)
    parts = re.split(r"(\[\^?[^\]]*\])", pattern)
    return "".join(swap(p, not p.startswith("[")).replace(r"\S", f"[^{space}]") for p in parts)


class Encoder(dict):
    """Little-endian 32-bit ids of pieces; a piece that is not there yet is merged."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.ranks = ranks
        self.all_text, self.latin = regex.compile(pattern), re.compile(_plain(pattern))
        self.other = re.compile(f"[^\\x00-\\u{LATIN - 1:04x}]")
        self.token = {rank: token for token, rank in ranks.items()}
        self.packed = {token: rank.to_bytes(4, "little") for token, rank in ranks.items()}
        self.none = len(ranks) + (1 << 30)
        #: Ranks of two bytes, the first in the upper half of the index.
        self.two = [ranks.get(bytes((a, b)), self.none) for a in range(256) for b in range(256)]
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        if (ids := self.older.get(piece)) is None:
            raw = piece.encode()
            ids = self.packed.get(raw) or self.merged(raw)
        if len(piece) <= LONG:
            if len(self) >= CACHED:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def merged(self, raw: bytes) -> bytes:
        """Packed ids after merging the leftmost adjacent pair of the lowest rank until none is left."""
        if len(raw) > LONG:
            return self._merged_long(raw)
        get, none, two = self.ranks.get, self.none, self.two
        ends = list(range(1, len(raw) + 1))
        pairs = [two[a << 8 | b] for a, b in zip(raw, raw[1:])]
        starts = [0, *ends[:-1]]
        while pairs and (low := min(pairs)) < none:
            i = pairs.index(low)
            ends[i] = ends[i + 1]
            del pairs[i], ends[i + 1], starts[i + 1]
            if i:
                pairs[i - 1] = get(raw[starts[i - 1] : ends[i]], none)
            if i < len(pairs):
                pairs[i] = get(raw[starts[i] : ends[i + 1]], none)
        packed = self.packed
        return b"".join([packed[raw[a:b]] for a, b in zip(starts, ends)])

    def _merged_long(self, raw: bytes) -> bytes:
        ranks, n = self.ranks, len(raw)
        parts = [raw[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, left, size = heapq.heappop(heap)
            right = after[left]
            if not parts[left] or right >= n or len(parts[left]) + len(parts[right]) != size:
                continue
            parts[left], parts[right] = parts[left] + parts[right], b""
            after[left] = following = after[right]
            if following < n:
                before[following] = left
            for a, b in ((left, following), (before[left], left)):
                if a >= 0 and b < n and (r := ranks.get(parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, (r, a, len(parts[a]) + len(parts[b])))
        return b"".join(self.packed[p] for p in parts if p)

    def encode(self, text: str) -> bytes:
        find = self.all_text if self.other.search(text) else self.latin
        if len(text) < 1 << 20:
            return b"".join(map(self.__getitem__, find.findall(text)))
        return b"".join(self[m[0]] for m in find.finditer(text))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(load_ranks(path), pattern)


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids (binary, little-endian 32-bit) for each row of ``docs``; null and empty texts have none."""

    def one(b: pa.RecordBatch) -> list[pa.Array]:
        e = encoder(ranks_path, pattern)
        return [b.column(0), pa.array([e.encode(t.decode("utf-8", "replace")) for t in utf8(b.column(1))], pa.binary())]

    return map_batches(docs.select("doc_id", "text"), one, "doc_id long, ids binary")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, text for each row of encode(): the tokens' bytes set side by side, as UTF-8; null ids give an empty text."""

    def one(b: pa.RecordBatch) -> list[pa.Array]:
        e = encoder(ranks_path, pattern)
        return [b.column(0), pa.array([e.decode(i.as_py() or b"").decode("utf-8", "replace") for i in b.column(1)], pa.string())]

    return map_batches(encoded.select("doc_id", "ids"), one, "doc_id long, text string")


def digests(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of ``docs``, encoded and decoded in one pass; ids as well if asked for.

    ``ranks_path`` names a file that every executor has. Null and empty texts have no tokens and the
    digests of nothing; repeated rows and null ids stay; other columns are not read.
    """

    def one(b: pa.RecordBatch) -> list[pa.Array]:
        e, all_ids, text_sha = encoder(ranks_path, pattern), [], []
        for raw in utf8(b.column(1)):
            all_ids.append(e.encode(raw.decode("utf-8", "replace")))
            text_sha.append(hashlib.sha256(e.decode(all_ids[-1])).hexdigest())
        out = [b.column(0), pa.array([len(i) // 4 for i in all_ids], pa.int64()), pa.array([hashlib.sha256(i).hexdigest() for i in all_ids]), pa.array(text_sha)]
        return [*out, pa.array(all_ids, pa.binary())] if with_ids else out

    return map_batches(docs.select("doc_id", "text"), one, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids)


def _rank_table(ranks: dict[bytes, int]) -> Column:
    """A literal: hexadecimal tokens to ranks, dealt over small maps by the token's hash."""
    maps: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for token, rank in ranks.items():
        key = token.hex().upper()
        h = xxhash.xxh64_intdigest(key.encode(), 42)
        maps[(h - (1 << 64) if h >> 63 else h) % BUCKETS][key] = rank
    return F.from_json(F.lit(json.dumps(maps)), "array<map<string,int>>")


def encode_words(words: DataFrame, ranks: dict[bytes, int], col: str = "word") -> DataFrame:
    """(word, ids) for each distinct word: a fold of ranked merges in Spark's higher-order functions."""
    table = words.sparkSession.range(1).select(_rank_table(ranks).alias("_ranks"))
    split = words.select(F.col(col).alias("word")).where("word is not null").distinct().withColumn("_hex", F.hex(F.encode("word", "UTF-8")))
    start = F.regexp_extract_all("_hex", F.lit(".."), F.lit(0))
    rank = lambda h: F.try_element_at(F.element_at(F.col("_ranks"), F.pmod(F.xxhash64(h), F.lit(BUCKETS)).cast("int") + 1), h)

    def step(parts: Column, _: Column) -> Column:
        pair = lambda i: F.concat(F.element_at(parts, i), F.element_at(parts, i + 1))
        ranked = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.struct(rank(pair(i)).alias("r"), i.alias("i")))
        low = F.when(F.size(parts) > 1, F.array_min(F.filter(ranked, lambda x: x["r"].isNotNull())))
        merged = lambda at: F.concat(F.slice(parts, F.lit(1), at - 1), F.array(pair(at)), F.slice(parts, at + 2, F.size(parts)))
        return F.element_at(F.transform(F.array(low["i"]), lambda at: F.when(at.isNull(), parts).otherwise(merged(F.coalesce(at, F.lit(1))))), 1)

    whole = rank(F.col("_hex"))
    folded = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(start) - 1, F.lit(1))), start, step)
    ids = F.when(F.col("_hex") == "", F.array().cast("array<int>")).when(whole.isNotNull(), F.array(whole)).otherwise(F.transform(folded, rank))
    return split.crossJoin(F.broadcast(table)).select("word", ids.alias("ids"))
