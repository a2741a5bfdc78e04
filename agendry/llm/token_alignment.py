"""Alignment of two tokenizers over a corpus, with corpus-wide counts of the id pairs that are linked.

Each text is encoded by a byte-level BPE (A) and by a piece model (B). Byte offsets at which tokens of both end cut
the two sequences into groups, and every A token of a group is linked with every B token of it.

First pass: encode, align, store the ids, and note which pairs each document holds; a task sums them up to
``HELD`` distinct pairs and gives these as rows. Distinct pairs, dealt over shards by a hash, get a minimal
perfect hash for each shard: levels of bits in which a key stands alone at its place, so its number is the count of set bits
before. What tasks noted becomes dense count vectors indexed by that hash, which are summed in a tree;
beside the counts a shard's file keeps the keys themselves, so a lookup is verified. Second pass: align the stored ids
again and look the pairs of some thousand documents up at a time, shard by shard.

Ids of A take 16 bits and of B 15, so a corpus has at most 2^31 pairs whatever its size, a shard at most 2^31 over
the number of shards, and the highest count of each A id, which second-pass tasks are given, at most 65,536 numbers.
"""

from __future__ import annotations

import functools
import hashlib
import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import sentencepiece
import zstandard
from pyspark.sql import DataFrame, functions as F

from agendry.llm.arrow import scratch, small_batches, utf8
from agendry.llm.bpe import load_ranks
from agendry.llm.training_order import token_ids
from agendry.runtime import cut

B_BITS = 15
#: Pairs that a task holds before it gives them away, in the first pass, or looks them up, in the second.
HELD = 2_000_000
#: Pairs, counted once a task, that a shard aims at, and the most shards, a power of two.
SHARD_KEYS, MOST_SHARDS = 1 << 19, 1 << 12
#: Links of a group up to which each is listed by itself; larger groups go by their distinct ids.
LISTED = 4096
#: Vectors of a shard that a task of a lower level of the tree sums.
FAN = 16
SPACE = "▁"


@functools.lru_cache(maxsize=1)
def _pieces(model_path: str) -> tuple[sentencepiece.SentencePieceProcessor, list[bytes]]:
    """The processor, and the bytes of each piece."""
    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    if model.get_piece_size() > 1 << B_BITS:
        raise ValueError("ids of B do not fit 15 bits")
    raw = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return model, [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(raw)]


@functools.lru_cache(maxsize=1)
def _lengths(ranks_path: str, model_path: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of each token of A and of B."""
    ranks = load_ranks(ranks_path)
    if max(ranks.values()) >= 1 << 16:
        raise ValueError("ids of A do not fit 16 bits")
    a = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        a[rank] = len(token)
    return a, np.array([len(p) for p in _pieces(model_path)[1]], np.int64)


@functools.lru_cache(maxsize=1)
def _decimals(n: int) -> dict[str, np.ndarray]:
    """Decimal ids below ``n``, each followed by a sign."""
    return {sign: np.array([f"{i}{sign}".encode() for i in range(n)], object) for sign in ",|;"}


def encode(raw: bytes | None, ranks_path: str, pattern: str, model_path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of A for a space and the text, and of B for the text; none for texts that either of them does not give back."""
    none = np.empty(0, np.uint16)
    if not raw:
        return none, none
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return none, none
    model, pieces = _pieces(model_path)
    b = model.encode(text, num_threads=1)
    if b"".join([pieces[i] for i in b]) != b" " + raw:
        return none, none
    return token_ids(" " + text, ranks_path, pattern).astype(np.uint16), np.array(b, np.uint16)


class Aligned:
    """Groups of several documents: ids of all of them in a row, and how many each has."""

    def __init__(self, a: list[np.ndarray], b: list[np.ndarray], lengths: tuple[np.ndarray, np.ndarray]):
        self.n_a, self.n_b = (np.array([len(x) for x in ids], np.int64) for ids in (a, b))
        self.a, self.b = (np.concatenate(ids).astype(np.int64) if ids else np.empty(0, np.int64) for ids in (a, b))
        # Both sides of a document have as many bytes, so ends agree over all documents.
        ends_a, ends_b = np.cumsum(lengths[0][self.a]), np.cumsum(lengths[1][self.b])
        self.last_a, self.last_b = np.isin(ends_a, ends_b, assume_unique=True), np.isin(ends_b, ends_a, assume_unique=True)
        self.group_a, self.group_b = (np.cumsum(last) - last for last in (self.last_a, self.last_b))
        groups = int(self.last_a.sum())
        self.size_a, self.size_b = np.bincount(self.group_a, minlength=groups), np.bincount(self.group_b, minlength=groups)
        #: Number of the first group of each document, and of none.
        self.starts = np.append(0, np.cumsum(self.last_a))[np.append(0, np.cumsum(self.n_a))]

    def sums(self, of_groups: np.ndarray) -> np.ndarray:
        """Sums over the groups of each document."""
        return np.diff(np.append(0, np.cumsum(of_groups))[self.starts])

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, pair, times), each document's pairs once and in order."""
        doc_of = np.repeat(np.arange(len(self.n_a)), np.diff(self.starts))
        many = self.size_a * self.size_b > LISTED
        first_b, first_a = np.cumsum(self.size_b) - self.size_b, np.cumsum(self.size_a) - self.size_a
        at = np.flatnonzero(~many[self.group_a])
        g = self.group_a[at]
        times = self.size_b[g]
        b_at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first_b[g], times)
        packed, n = np.unique(np.repeat(doc_of[g] << 31 | self.a[at] << B_BITS, times) | self.b[b_at], return_counts=True)
        rest = [(packed, n)]
        for g in np.flatnonzero(many):
            (a, n_a), (b, n_b) = (np.unique(ids[s : s + size], return_counts=True) for ids, s, size in ((self.a, first_a[g], self.size_a[g]), (self.b, first_b[g], self.size_b[g])))
            rest.append(((doc_of[g] << 31 | a[:, None] << B_BITS | b[None, :]).ravel(), (n_a[:, None] * n_b[None, :]).ravel()))
        if len(rest) > 1:
            both = np.concatenate([p for p, _ in rest])
            packed, back = np.unique(both, return_inverse=True)
            n = np.zeros(len(packed), np.int64)
            np.add.at(n, back, np.concatenate([x for _, x in rest]))
        return packed >> 31, (packed & 0x7FFFFFFF).astype(np.uint32), n

    def digests(self) -> list[str]:
        """SHA-256 of each document's groups as text; empty for documents without tokens."""
        signs = _decimals(1 << 16)
        out = np.empty(len(self.a) + len(self.b), object)
        before_b, through_a = np.cumsum(self.size_b) - self.size_b, np.cumsum(self.size_a)
        out[np.arange(len(self.a)) + before_b[self.group_a]] = np.where(self.last_a, signs["|"][self.a], signs[","][self.a])
        out[np.arange(len(self.b)) + through_a[self.group_b]] = np.where(self.last_b, signs[";"][self.b], signs[","][self.b])
        at = np.append(0, np.cumsum(self.n_a + self.n_b)).tolist()
        return [hashlib.sha256(b"".join(out[s:z].tolist())[:-1]).hexdigest() if z > s else "" for s, z in zip(at, at[1:])]


def mixed(keys: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of keys."""
    x = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of a hash, so keys in its order fall into any number of them."""
    return (mixed(keys) >> np.uint64(64 - MOST_SHARDS.bit_length() + 1)).astype(np.int64) * shards // MOST_SHARDS


class PerfectHash:
    """A minimal perfect hash: each level is a field of bits twice as long as the keys it is given; those that stand alone at their place stay, the others go on."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, n = [], 0
        for bits in levels:
            counts = np.bitwise_count(bits.view(np.uint64)).astype(np.int64)
            self.ranks.append(n + np.cumsum(counts) - counts)
            n += int(counts.sum())
        self.size = n

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        """For distinct keys."""
        levels, left = [], keys
        while len(left):
            places = 64 * -(-2 * len(left) // 64)
            at = (mixed(left, len(levels) + 1) % np.uint64(places)).astype(np.int64)
            alone = np.bincount(at, minlength=places) == 1
            levels.append(np.packbits(alone, bitorder="little"))
            left = left[~alone[at]]
        return cls(levels)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; for keys that it was not made for, some number or -1."""
        out, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks)):
            if not len(todo):
                break
            words = bits.view(np.uint64)
            at = (mixed(keys[todo], level + 1) % np.uint64(64 * len(words))).astype(np.int64)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[todo[hit]] = ranks[at[hit] >> 6] + below[hit]
            todo = todo[~hit]
        return out


def _write(uri: str, **arrays: np.ndarray) -> None:
    """A file under a name of its attempt, then moved, so a lost or repeated task leaves whole files only."""
    fs, path = pafs.FileSystem.from_uri(uri)
    held = io.BytesIO()
    np.savez(held, **arrays)
    own = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(own) as out:
        out.write(held.getbuffer())
    fs.move(own, path)


def _read(uri: str) -> dict[str, np.ndarray]:
    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_file(path) as f:
        held = np.load(io.BytesIO(f.read()))
        return {k: held[k] for k in held.files}


class Table:
    """Counts of one shard by pair."""

    def __init__(self, folder: str, shard: int, name: str = "counts"):
        held = _read(f"{folder}/{name}-{shard:05d}.npz")
        self.hash, self.keys, self.counts = PerfectHash([held[f"level{i}"] for i in range(len(held) - 1 - ("counts" in held))]), held["keys"], held.get("counts")

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """The count of each pair; zero for one that no document holds."""
        if not self.hash.size:
            return np.zeros(len(keys), np.int64)
        at = self.hash.index(keys)
        return np.where((at >= 0) & (self.keys[at] == keys), self.counts[at], 0)


def _first_pass(docs: DataFrame, ranks_path: str, pattern: str, model_path: str) -> DataFrame:
    """Rows of two kinds: documents with their ids, and (keys, counts) of up to HELD distinct pairs in the order of their hash."""
    kinds = {
        "doc_id": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string(), "a": pa.binary(), "b": pa.binary(), "n_keys": pa.int64(), "keys": pa.binary(), "counts": pa.binary(),
    }

    def rows(**columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in kinds.items()], list(kinds))

    def noted(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        found, back = np.unique(np.concatenate(keys), return_inverse=True)
        return found, np.bincount(back, np.concatenate(counts), len(found)).astype(np.uint32)

    def given(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(mixed(keys))
        return rows(n_keys=[len(keys)], keys=[keys[order].tobytes()], counts=[counts[order].tobytes()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held, fresh = [], [], 0, 0
        for batch in batches:
            ids = [encode(raw, ranks_path, pattern, model_path) for raw in utf8(batch.column(1))]
            a, b = [x for x, _ in ids], [x for _, x in ids]
            groups = Aligned(a, b, _lengths(ranks_path, model_path))
            n_links = groups.sums(groups.size_a * groups.size_b)
            yield rows(doc_id=batch.column(0), n_groups=np.diff(groups.starts), n_links=n_links, groups_sha256=groups.digests(), a=[x.tobytes() for x in a], b=[x.tobytes() for x in b])
            _, pair, _ = groups.links()
            keys.append(pair)
            counts.append(np.ones(len(pair), np.uint32))
            fresh += len(pair)
            if fresh >= HELD:
                k, c = noted(keys, counts)
                keys, counts, held, fresh = [k], [c], len(k), 0
                if held >= HELD:
                    yield given(k, c)
                    keys, counts, held = [], [], 0
        if keys:
            k, c = noted(keys, counts)
            if len(k):
                yield given(k, c)

    names = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    return small_batches(docs.select("doc_id", "text")).mapInArrow(run, ", ".join(f"{c} {names[t]}" for c, t in kinds.items()))


def _split(noted: DataFrame, shards: int, fold) -> DataFrame:
    """(shard, node, data): what tasks noted, cut by shard; ``fold`` makes the bytes of a shard's keys and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for k, c in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
                keys, counts = np.frombuffer(k, np.uint32), np.frombuffer(c, np.uint32)
                at = np.searchsorted(shard_of(keys, shards), np.arange(shards + 1))
                node = int.from_bytes(hashlib.sha256(k).digest()[:4], "little")
                data = [(s, small.compress(fold(s, keys[at[s] : at[s + 1]], counts[at[s] : at[s + 1]]))) for s in range(shards) if at[s + 1] > at[s]]
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in data], pa.int32()), pa.array([node] * len(data), pa.int64()), pa.array([d for _, d in data], pa.binary())], ["shard", "node", "data"])

    return small_batches(noted).mapInArrow(run, "shard int, node long, data binary")


def _merged(parts: DataFrame, by: list[str], merge, done, schema: str) -> DataFrame:
    """Rows of one group after the other: ``merge`` takes what is held, or None, and a row's bytes; ``done`` turns a group's result into a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        large, own, held = zstandard.ZstdDecompressor(), None, None
        names = [c.split()[0] for c in schema.split(", ")]

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(names, done(own, held)))], schema=pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]]) for n, c in zip(names, schema.split(", "))]))

        for batch in batches:
            for *group, data in zip(*(batch.column(i).to_pylist() for i in range(len(by) + 1))):
                if own is not None and own != group:
                    yield out()
                    held = None
                own, held = group, merge(held, large.decompress(data))
        if own is not None:
            yield out()

    return small_batches(parts.select(*by, "data").repartition(*by).sortWithinPartitions(*by)).mapInArrow(run, schema)


def _tables(noted: DataFrame, shards: int, folder: str) -> np.ndarray:
    """Write the hash, the keys and the counts of each shard; give the highest count of each A id."""

    def union(held: np.ndarray | None, data: bytes) -> np.ndarray:
        keys = np.frombuffer(data, np.uint32)
        return keys if held is None else np.union1d(held, keys)

    def hashed(group: list, keys: np.ndarray) -> tuple:
        made, own = PerfectHash.of(keys), np.empty(len(keys), np.uint32)
        own[made.index(keys)] = keys
        _write(f"{folder}/hash-{group[0]:05d}.npz", keys=own, **{f"level{i}": bits for i, bits in enumerate(made.levels)})
        return (group[0], len(keys))

    cut(_merged(_split(noted, shards, lambda _, keys, __: keys.tobytes()), ["shard"], union, hashed, "shard int, n long"))
    pack = lambda vector: zstandard.ZstdCompressor(level=3).compress(vector.tobytes())

    def vector(shard: int, keys: np.ndarray, counts: np.ndarray) -> bytes:
        table = Table(folder, shard, "hash")
        dense = np.zeros(table.hash.size, np.uint64)
        dense[table.hash.index(keys)] = counts
        return dense.tobytes()

    def add(held: np.ndarray | None, data: bytes) -> np.ndarray:
        return np.frombuffer(data, np.uint64) if held is None else held + np.frombuffer(data, np.uint64)

    def stored(group: list, counts: np.ndarray) -> tuple:
        held = _read(f"{folder}/hash-{group[0]:05d}.npz")
        _write(f"{folder}/counts-{group[0]:05d}.npz", counts=counts.astype(np.int64), **held)
        best = np.zeros(1 << 16, np.int64)
        np.maximum.at(best, held["keys"].astype(np.int64) >> B_BITS, counts.astype(np.int64))
        return (0, zstandard.ZstdCompressor().compress(best.tobytes()))

    leaves = _split(noted, shards, vector).withColumn("node", F.pmod("node", F.lit(FAN)))
    sums = _merged(leaves, ["shard", "node"], add, lambda group, v: (group[0], pack(v)), "shard int, data binary")
    tops = cut(_merged(sums, ["shard"], add, stored, "one int, data binary"))
    best = _merged(tops, ["one"], lambda held, d: np.maximum(0 if held is None else held, np.frombuffer(d, np.int64)), lambda _, v: (v.tobytes(),), "data binary").collect()
    return np.frombuffer(best[0]["data"], np.int64) if best else np.zeros(1 << 16, np.int64)


def _second_pass(stored: DataFrame, lengths, shards: int, folder: str, best: np.ndarray) -> DataFrame:
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def looked_up(batches: list, links: list) -> Iterator[pa.RecordBatch]:
        pairs, back = np.unique(np.concatenate([p for _, p, _, _ in links]), return_inverse=True)
        owner, counts = shard_of(pairs, shards), np.zeros(len(pairs), np.int64)
        for s in np.unique(owner):
            at = np.flatnonzero(owner == s)
            counts[at] = Table(folder, s).lookup(pairs[at])
        top = counts == best[pairs.astype(np.int64) >> B_BITS]
        start = 0
        for b, (row, pair, times, n) in zip(batches, links):
            own = back[start : start + len(pair)]
            start += len(pair)
            sums = [np.zeros(len(b), np.int64) for _ in range(2)]
            np.add.at(sums[0], row, times * top[own])
            np.add.at(sums[1], row, times * counts[own])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n[0]), pa.array(n[1]), b.column("n_groups"), b.column("n_links"), *map(pa.array, sums), b.column("groups_sha256")], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, links, held = [], [], 0
        for batch in batches:
            ids = [[np.frombuffer(x, np.uint16) for x in batch.column(c).to_pylist()] for c in ("a", "b")]
            groups = Aligned(*ids, lengths())
            row, pair, times = groups.links()
            kept.append(batch.drop_columns(["a", "b"]))
            links.append((row, pair, times, (groups.n_a, groups.n_b)))
            held += len(pair) + len(batch)
            if held >= HELD:
                yield from looked_up(kept, links)
                kept, links, held = [], [], 0
        if kept:
            yield from looked_up(kept, links)

    source = stored.where("a is not null").select("doc_id", "n_groups", "n_links", "groups_sha256", "a", "b")
    return small_batches(source).mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def alignment(docs: DataFrame, ranks_path: str, pattern: str, model_path: str) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A pair's count is the number of rows that hold it linked, each row counted once. ``n_best`` are the links
    whose count is the highest of their A id, ``count_sum`` is the sum of the counts over links. Null and
    empty texts, and texts that either tokenizer doesn't give back byte for byte, have no tokens: zeros, and
    an empty groups_sha256. Rows repeated, ties and null ids stay; an empty table gives no rows; other columns are not read.
    The paths name files that every executor has. Ids, hashes and counts lie in the shared folder, which pyarrow's file systems
    must reach, until the result is made.
    """
    spark = docs.sparkSession
    with scratch(spark, "alignment") as folder:
        first = _first_pass(docs, ranks_path, pattern, model_path)
        first.write.options(**{"compression": "zstd", "parquet.enable.dictionary": "false"}).parquet(f"{folder}/stored")
        stored = spark.read.schema(first.schema).parquet(f"{folder}/stored")
        noted = stored.where("keys is not null").select("keys", "counts", "n_keys")
        total = noted.agg(F.coalesce(F.sum("n_keys"), F.lit(0))).first()[0]
        shards = min(MOST_SHARDS, 1 << max(0, (total // SHARD_KEYS).bit_length()))
        best = _tables(noted, shards, folder)
        return cut(_second_pass(stored, functools.partial(_lengths, ranks_path, model_path), shards, folder, best))
