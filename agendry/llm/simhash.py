"""Near-duplicate grouping by 64-bit SimHash, with Golay-code keys for the candidate join.

A fingerprint's bit is 1 where over half of the hashes of the text's word shingles have it set.
Two fingerprints are linked when they differ in at most three bits. The 64 bits are dealt into
segments of 22, 21 and 21. Three errors over three segments fall in one of two ways:

* some segment is free of errors, and of the other two one has at most one error;
* every segment has exactly one error.

A segment with at most one error is matched through the [23,12] Golay code, which is perfect: each
23-bit word has one nearest codeword. The word whose bit count is odd gives the index of its own
codeword; the word whose bit count is even gives the indices for itself and for each of its one-bit
neighbours (six at most). Words that differ in one bit have different parity, so they share an
index. Keys of the first kind join an exact segment with the index of another; keys of the second
kind join the indices of all three. So every pair within three bits shares a key, and each shared
key is verified on the full fingerprints. Equal fingerprints are one node, so copies are never
expanded into pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from agendry.llm.arrow import free_name, map_batches, small_batches, utf8
from agendry.operators.graph import connected_components
from agendry.runtime import cut

ERRORS = 3
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Distinct fingerprints of one key that a task compares by itself; a larger key goes the way of neighbourhoods().
MAX_GROUP = 20_000
#: Shingles whose bits are unpacked at once.
CHUNK = 1 << 17


def fingerprint(words: list[bytes], shingle: int = 3) -> int:
    """The unsigned fingerprint of a text's words; zero if there are none."""
    if not words:
        return 0
    line, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()[min(shingle, len(words)) - 1 :]
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, len(ends), CHUNK):
        h = np.array([digest(line[s:e], 42) for s, e in zip(starts[i : i + CHUNK], ends[i : i + CHUNK])], np.uint64)
        total += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(ends)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint of each whole text as a signed long. Null texts count as empty."""

    def one(b: pa.RecordBatch) -> list[pa.Array]:
        # bytes.lower() and bytes.split() know ASCII only: A-Z, and 0x20, 0x09-0x0D.
        fps = np.array([fingerprint(t.lower().split(), shingle) for t in utf8(b.column(1))], np.uint64)
        return [b.column(0), pa.array(fps.view(np.int64))]

    return map_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), one, "doc_id long, fp long")


def _golay() -> tuple[np.ndarray, np.ndarray]:
    """Parity bits of each 12-bit message, and the error pattern of each 11-bit syndrome."""
    parity = np.zeros(1 << 12, np.uint32)
    for bit in range(12):
        r = 1 << (bit + 11)
        for k in range(bit + 11, 10, -1):
            if r >> k & 1:
                r ^= 0xC75 << (k - 11)
        parity[(np.arange(1 << 12) >> bit & 1) == 1] ^= np.uint32(r)
    ones = np.uint32(1) << np.arange(23, dtype=np.uint32)
    i, j, k = np.meshgrid(*[np.append(ones, np.uint32(0))] * 3, indexing="ij")
    patterns = np.unique((i | j | k).ravel())
    errors = np.zeros(1 << 11, np.uint32)
    errors[(patterns & 0x7FF) ^ parity[patterns >> 11]] = patterns
    return parity, errors


_TABLES: list = []


def codeword_index(v: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword nearest to each 23-bit word."""
    if not _TABLES:
        _TABLES.extend(_golay())
    parity, errors = _TABLES
    return (v ^ errors[(v & 0x7FF) ^ parity[v >> 11]]) >> 11


def segment_keys(v: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Codeword indices of each segment, one row a word, and which of them count."""
    near = np.sort(codeword_index(v[:, None] ^ np.append(np.uint32(0), np.uint32(1) << np.arange(width, dtype=np.uint32))[None, :]), axis=1)
    new = np.ones(near.shape, bool)
    new[:, 1:] = near[:, 1:] != near[:, :-1]
    odd = np.bitwise_count(v) % 2 == 1
    near[odd, 0] = codeword_index(v[odd])
    new[odd, 1:] = False
    new[odd, 0] = True
    order = np.argsort(~new, axis=1, kind="stable")[:, : new.sum(1).max(initial=1)]
    return np.take_along_axis(near, order, 1).astype(np.uint64), np.take_along_axis(new, order, 1)


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, row): all keys of each unsigned fingerprint, and the row each is of."""
    segs = [((fps >> np.uint64(at)) & np.uint64((1 << w) - 1)) for at, w in SEGMENTS]
    near = [segment_keys(s.astype(np.uint32), w) for s, (_, w) in zip(segs, SEGMENTS)]
    keys, rows, tag = [], [], 1
    for i in range(3):
        for j in range(3):
            if i != j:
                r, c = np.nonzero(near[j][1])
                keys.append(np.uint64(tag << 40) | (segs[i][r] << np.uint64(12)) | near[j][0][r, c])
                rows.append(r)
                tag += 1
    (a, am), (b, bm), (c, cm) = near
    r, x, y = np.nonzero(am[:, :, None] & bm[:, None, :])
    two = (a[r, x] << np.uint64(24)) | (b[r, y] << np.uint64(12))
    at, z = np.nonzero(cm[r])
    keys.append(np.uint64(tag << 40) | two[at] | c[r[at], z])
    rows.append(r[at])
    return np.concatenate(keys), np.concatenate(rows)


def _forest(fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that join all of a key's fingerprints that links can join; each is compared with what is still loose."""
    rest, out = fps, []
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            p = front.pop()
            near = np.bitwise_count(rest ^ p) <= ERRORS
            if near.any():
                out.append((np.full(int(near.sum()), p), rest[near]))
                front.extend(rest[near])
                rest = rest[~near]
    return out


def _links(batches: Iterator[pa.RecordBatch], max_group: int) -> Iterator[pa.RecordBatch]:
    """Verified links within each key of a partition sorted by key; a key over the limit gives its rows marked."""

    def found(key: np.ndarray, fp: np.ndarray) -> Iterator[tuple]:
        if not len(key):
            return
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        count = np.diff(np.append(first, len(key)))
        small = np.repeat(count <= 8, count)
        for d in range(1, 8):
            ok = small[:-d] & (key[d:] == key[:-d]) & (np.bitwise_count(fp[d:] ^ fp[:-d]) <= ERRORS)
            if ok.any():
                yield fp[:-d][ok], fp[d:][ok], False
        for s, n in zip(first[count > 8], count[count > 8]):
            for a, b in _forest(fp[s : s + n]):
                yield a, b, False

    def made(parts: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        for a, b, over in parts:
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.full(len(a), over))], ["src", "dst", "over"])

    key, fp, over = np.empty(0, np.int64), np.empty(0, np.uint64), None
    for batch in batches:
        k, f = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        key, fp = np.concatenate([key, k]), np.concatenate([fp, f.view(np.uint64)])
        if over is not None:
            n = int(np.searchsorted(key, over, "right"))
            yield from made([(fp[:n], fp[:n], True)])
            key, fp, over = key[n:], fp[n:], over if n == len(key) else None
            if not len(key):
                continue
        last = int(np.searchsorted(key, key[-1], "left"))
        yield from made(found(key[:last], fp[:last]))
        key, fp = key[last:], fp[last:]
        if len(key) > max_group:
            over = key[0]
            yield from made([(fp, fp, True)])
            key, fp = key[:0], fp[:0]
    yield from made(found(key, fp))


def neighbourhoods(fps: DataFrame) -> DataFrame:
    """(src, dst): links among fingerprints of very large keys, without comparing them with each other.

    Each fingerprint stands at every word within two bits of it. At a word, all that stand within one
    bit are linked to the least of them, and all within two bits are linked to that one as well: these
    differ in three bits at most. Two linked fingerprints meet at some word, once within one and once
    within two bits. At most 2,081 stand at one word, so no group grows with the data.
    """
    flips = [0, *(1 << i for i in range(64)), *(1 << i | 1 << j for i in range(64) for j in range(i))]

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, close = np.array(flips, np.uint64), np.arange(len(flips)) <= 64
        for b in batches:
            for x in b.column(0).to_numpy(zero_copy_only=False).view(np.uint64):
                at = (by ^ x).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.full(len(at), x).view(np.int64)), pa.array(close)], ["at", "fp", "close"])

    stood = fps.mapInArrow(one, "at long, fp long, close boolean")
    least = F.min(F.when(F.col("close"), F.col("fp"))).over(Window.partitionBy("at"))
    return stood.withColumn("src", least).where("src is not null and src <> fp").select("src", F.col("fp").alias("dst")).distinct()


def links(fps: DataFrame, max_group: int = MAX_GROUP) -> DataFrame:
    """(src, dst): links between distinct fingerprints, enough to join all that are connected."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(fp), 2000):
                part = fp[i : i + 2000]
                keys, rows = keys_of(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(part[rows])], ["key", "fp"])

    dealt = fps.mapInArrow(keyed, "key long, fp long").repartition("key").sortWithinPartitions("key")
    found = cut(dealt.mapInArrow(lambda b: _links(b, max_group), "src long, dst long, over boolean").distinct())
    large = found.where("over").select(F.col("src").alias("fp")).distinct()
    near = found.where("not over").select("src", "dst")
    return near if large.isEmpty() else near.union(neighbourhoods(large))


def _roots(marked: DataFrame, max_group: int) -> DataFrame:
    """(fp, root): each distinct fingerprint and the one that names its group; itself if nothing is linked to it."""
    every = marked.select("fp").distinct()
    found = connected_components(links(every, max_group)).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    return every.join(found, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def groups(docs: DataFrame, shingle: int = 3, max_group: int = MAX_GROUP) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    ``component_id`` is the least doc_id that links reach. Null and empty texts have fingerprint zero
    and are linked like any other. Rows with a null doc_id are kept and take part in links, but never
    name a component; a component without any id has a null component_id. An empty table gives an
    empty result; other columns of ``docs`` are not read.
    """
    marked = cut(fingerprints(docs, shingle))
    first = marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    found = connected_components(links(first.select("fp"), max_group)).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    named = found.join(first, "fp").groupBy("root").agg(F.min("first_id").alias("component_id"))
    linked = found.join(named, "root").select("fp", "component_id")
    by_fp = first.join(linked, "fp", "left").select("fp", F.least(F.coalesce("component_id", "first_id"), F.coalesce("first_id", "component_id")).alias("component_id"))
    return marked.join(by_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, max_group: int = MAX_GROUP) -> DataFrame:
    """``docs`` with one row of each group: the one of the least doc_id; a null one comes last.

    Of rows repeated under that doc_id in the group the least text stays. Groups are told apart by
    their fingerprints, so rows of other groups that share a doc_id, or have none, stay for their own.
    """
    own_fp, root, first_id, whole = (free_name(docs, f"kept_{n}") for n in ("fp", "root", "id", "row"))
    marked = cut(fingerprints(docs, shingle))
    roots = cut(_roots(marked, max_group))
    # The least doc_id is null only if the whole group has none.
    best = marked.join(roots, "fp").groupBy("root").agg(F.min("doc_id").alias("first_id"))
    named = roots.join(best, "root").select(F.col("fp").alias(own_fp), F.col("root").alias(root), F.col("first_id").alias(first_id))

    @F.arrow_udf("long")
    def printed(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t.lower().split(), shingle) for t in utf8(texts)], np.uint64).view(np.int64))

    # Only rows whose doc_id names a group are printed again.
    chosen = docs.join(best.select(F.col("first_id").alias(first_id)).distinct(), F.col("doc_id").eqNullSafe(F.col(first_id)), "left_semi")
    rows = small_batches(chosen).withColumn(own_fp, printed(F.col("text"))).join(named, own_fp).where(F.col("doc_id").eqNullSafe(F.col(first_id)))
    row = F.min_by(F.struct(*[F.col(c) for c in docs.columns]), F.coalesce("text", F.lit(""))).alias(whole)
    return rows.groupBy(root).agg(row).select(f"{whole}.*")
