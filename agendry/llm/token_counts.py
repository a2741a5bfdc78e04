"""Token counts under a byte-fallback BPE piece model, without emitting identifiers.

A text is a chain of characters. A heap holds the adjacent pairs that are pieces, the best score
first and the leftmost among equals; the best pair is merged in a linked list and its new neighbours
are pushed, until no pair is left. The count is the initial symbols less the merges, where a
character that is no piece stands for as many symbols as it has UTF-8 bytes. No identifier is made.

No piece spans two adjacent characters that stand together in no piece, so a text falls apart into
units that merge on their own: the count of a unit is kept in a bounded cache of the task.
"""

from __future__ import annotations

import functools
import heapq
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from agendry.llm.arrow import map_batches, utf8

SPACE = "▁"
#: Units whose counts a task keeps, in each of two generations; longer units than LONG are not kept.
CACHED, LONG = 400_000, 64
#: Characters of a text whose units are listed at once.
LISTED = 1 << 20


def _fields(data: bytes):
    """(number, value) of each field of a protocol-buffer message."""
    i, end = 0, len(data)

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[i]
            value |= (byte & 127) << shift
            i, shift = i + 1, shift + 7
            if byte < 128:
                return value, i

    while i < end:
        key, i = varint(i)
        if key & 7 == 0:
            value, i = varint(i)
        else:
            size, i = varint(i) if key & 7 == 2 else ({5: 4, 1: 8}[key & 7], i)
            value, i = data[i : i + size], i + size
        yield key >> 3, value


class PieceCounter(dict):
    """Counts of units; a unit that is not there yet is counted by merging."""

    def __init__(self, model: bytes):
        super().__init__()
        scores: dict[str, float] = {}
        rules: dict[int, object] = {}
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                if piece.get(3, 1) in (1, 4):
                    scores[piece[1].decode()] = struct.unpack("<f", piece.get(2, bytes(4)))[0]
            elif number == 3:
                rules = dict(_fields(value))
        if rules.get(1) != b"identity" or rules.get(2) or rules.get(4, 1):
            raise ValueError("only models without text normalisation are counted here")
        self.prefix = SPACE if rules.get(3, 1) else ""
        order = {score: rank for rank, score in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = {piece: order[score] for piece, score in scores.items()}
        self.joins = {piece[i : i + 2] for piece in scores for i in range(len(piece) - 1)}
        if any(pair[1] == SPACE and pair[0] != SPACE or "\n" in pair for pair in self.joins):
            raise ValueError("pieces of this model cross word starts")
        self.units = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n|[^{SPACE}\n]+")
        self.older: dict[str, int] = {}

    def __missing__(self, unit: str) -> int:
        if (count := self.older.get(unit)) is None:
            count, start = 0, 0
            for i in range(1, len(unit)):
                if unit[i - 1 : i + 1] not in self.joins:
                    count += self.merged(unit[start:i]) if i - start > 1 else self.symbols(unit[start])
                    start = i
            count += self.merged(unit[start:])
        if len(unit) <= LONG:
            if len(self) >= CACHED:
                self.older = dict(self)
                self.clear()
            self[unit] = count
        return count

    def symbols(self, char: str) -> int:
        return 1 if char in self.rank else len(char.encode("utf-8", "surrogatepass"))

    def merged(self, unit: str) -> int:
        """Initial symbols of a unit less its merges."""
        rank, parts = self.rank, list(unit)
        n, merges = len(parts), 0
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := rank.get(unit[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, left, size = heapq.heappop(heap)
            right = after[left]
            if not parts[left] or right >= n or len(parts[left]) + len(parts[right]) != size:
                continue  # one of the two has been merged since
            parts[left] += parts[right]
            parts[right] = ""
            merges += 1
            after[left] = following = after[right]
            if following < n:
                before[following] = left
                both = parts[left] + parts[following]
                if (r := rank.get(both)) is not None:
                    heapq.heappush(heap, (r, left, len(both)))
            if (leading := before[left]) >= 0:
                both = parts[leading] + parts[left]
                if (r := rank.get(both)) is not None:
                    heapq.heappush(heap, (r, leading, len(both)))
        return sum(map(self.symbols, unit)) - merges

    def count(self, text: str) -> int:
        if not text:
            return 0
        marked = self.prefix + text.replace(" ", SPACE)
        if len(marked) <= LISTED:
            return sum(map(self.__getitem__, self.units.findall(marked)))
        return sum(self[m[0]] for m in self.units.finditer(marked))


@functools.lru_cache(maxsize=2)
def _counter(path: str) -> PieceCounter:
    with open(path, "rb") as f:
        return PieceCounter(f.read())


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of ``docs``, from the whole text.

    ``model_path`` names a file that every executor has. Null and empty texts count zero; repeated
    rows and null ids stay; other columns are not read.
    """

    def one(b: pa.RecordBatch) -> list[pa.Array]:
        counter = _counter(model_path)
        sizes, counts = [], []
        for raw in utf8(b.column(1)):
            sizes.append(len(raw))
            counts.append(counter.count(raw.decode("utf-8", "replace")))
        return [b.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array(np.array(counts, np.int64) > limit)]

    return map_batches(docs.select("doc_id", "text"), one, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
