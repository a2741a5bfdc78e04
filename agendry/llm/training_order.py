"""Token ids in training order, in shards of a fixed stride.

Texts become token ids; each text ends with an end mark and the ids of a partition are packed into
sequences of equal length. A sequence's number is its place in its partition plus the sequences of the
partitions before. A keyed Feistel permutation, walked along its cycle until it is below the number of
sequences, takes the number to a global slot: a shuffle of all sequences that needs no sort by random
keys and can be computed for one sequence alone. Range partitions by slot hold the shards; a sequence
of slot s is record s % shard_size of shard s // shard_size, at a byte offset that follows from it.

A shard's file is named by its number and the digest of its data, so files of different runs never mix. A manifest
lists the files of a run; which manifest holds is written last, and only then go the files that it doesn't list.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import tiktoken
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from agendry.llm.arrow import dropped, map_batches, scratch, small_batches, utf8
from agendry.llm.bpe import encoder, load_ranks
from agendry.runtime import checkpoint_dir, cut

LENGTH, SHARD, ROUNDS = 2048, 4096, 6
#: Tasks that write shards, at most; each writes whole shards.
WRITERS = 20_000
#: Levels of compression of the packed table and of what is shuffled.
TABLE_LEVEL, SHUFFLE_LEVEL = 6, 6


def _round_keys(key: bytes) -> np.ndarray:
    return np.frombuffer(b"".join(hashlib.sha256(key + bytes([r])).digest()[:8] for r in range(ROUNDS)), "<u8")


def slots(numbers: np.ndarray, total: int, key: bytes) -> np.ndarray:
    """The slot of each sequence number: a permutation of range(total) that the key picks."""
    half = max(1, ((max(total, 2) - 1).bit_length() + 1) // 2)
    mask, keys = np.uint64((1 << half) - 1), _round_keys(key)
    x = numbers.astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] >> np.uint64(half), x[todo] & mask
        for k in keys:
            mixed = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed >> np.uint64(32)) & mask)
        x[todo] = left << np.uint64(half) | right
        todo = todo[x[todo] >= total]
    return x.astype(np.int64)


@functools.lru_cache(maxsize=1)
def _library(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_ranks(ranks_path), special_tokens={})


def token_ids(text: str, ranks_path: str, pattern: str) -> np.ndarray:
    """Ids of a text by the library, without special tokens."""
    try:
        return _library(ranks_path, pattern).encode_to_numpy(text, disallowed_special=())
    except ValueError:  # its regular expressions give up on very long runs of white space
        return np.frombuffer(encoder(ranks_path, pattern).encode(text), "<u4")


def sequences(docs: DataFrame, ranks_path: str, pattern: str, length: int = LENGTH) -> DataFrame:
    """(part, seq, first_doc, n_docs, n_tokens, ids): ids as little-endian 16-bit numbers, padded with the end mark.

    Every row of ``docs`` gives its tokens and one end mark; null and empty texts give the mark alone.
    The last sequence of a partition is padded; n_tokens counts what is not padding. The end mark is the
    first number after the vocabulary, which may hold 65,535 tokens at most: more raise a ValueError.
    """

    source = docs.select(F.spark_partition_id().alias("part"), "doc_id", "text")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = len(load_ranks(ranks_path))
        if end >= 1 << 16:
            raise ValueError("ids do not fit 16 bits")
        mark, part, seq = np.array([end], "<u2"), 0, 0
        held, at, docs_at = [], 0, []  # arrays of ids not yet packed, their total, and (offset, doc_id)

        def cut_off(stream: np.ndarray, starts: list, last: bool) -> tuple[list, np.ndarray, list]:
            nonlocal seq
            rows, n = [], len(stream) // length + bool(last and len(stream) % length)
            offsets = np.array([o for o, _ in starts], np.int64)
            for i in range(n):
                ids = stream[i * length : (i + 1) * length]
                a, z = np.searchsorted(offsets, (i * length, (i + 1) * length))
                a0 = a if a < len(offsets) and offsets[a] == i * length else a - 1
                rows.append((part, seq, starts[max(a0, 0)][1], int(z - max(a0, 0)), len(ids), np.append(ids, np.full(length - len(ids), end, "<u2")).tobytes()))
                seq += 1
            rest = stream[n * length :]
            z = max(0, int(np.searchsorted(offsets, n * length, "right")) - 1)
            return rows, rest, [(max(0, o - n * length), d) for o, d in starts[z:]] if len(rest) else []

        def batch(rows: list) -> pa.RecordBatch:
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 6, kinds)], ["part", "seq", "first_doc", "n_docs", "n_tokens", "ids"])

        for b in batches:
            if len(b):
                part = b.column(0)[0].as_py()
            for doc_id, raw in zip(b.column(1).to_pylist(), utf8(b.column(2))):
                docs_at.append((at, doc_id))
                ids = token_ids(raw.decode("utf-8", "replace"), ranks_path, pattern).astype("<u2")
                held += [ids, mark]
                at += len(ids) + 1
                if at >= 1 << 19:
                    rows, rest, docs_at = cut_off(np.concatenate(held), docs_at, False)
                    held, at = [rest], len(rest)
                    yield batch(rows)
        if at:
            yield batch(cut_off(np.concatenate(held), docs_at, True)[0])

    return small_batches(source).mapInArrow(pack, "part int, seq long, first_doc long, n_docs int, n_tokens int, ids binary")


def _stored(packed: DataFrame, path: str) -> DataFrame:
    """``packed`` as a table at ``path``: compressed, ids take half of what a checkpoint takes."""
    options = {"compression": "zstd", "parquet.compression.codec.zstd.level": TABLE_LEVEL, "parquet.enable.dictionary": "false"}
    packed.write.options(**options).parquet(path)
    return packed.sparkSession.read.schema(packed.schema).parquet(path)


def training_order(docs: DataFrame, ranks_path: str, pattern: str, key: bytes, length: int = LENGTH, shard_size: int = SHARD, packed_at: str | None = None) -> DataFrame:
    """(slot, shard, record, byte_offset, first_doc, n_docs, n_tokens, ids), range-partitioned and sorted by slot.

    Slots are 0 to the number of sequences less one, each once. The same documents, key and deal of
    documents over partitions (thus of files over input splits) give the same order; another deal packs other
    sequences. An empty table gives no sequence. Other columns are not read. Packed sequences are stored at ``packed_at``, a
    folder of their own in the shared one if it is not given, and may go once the result is made.
    """
    packed = _stored(sequences(docs, ranks_path, pattern, length), packed_at or f"{checkpoint_dir(docs.sparkSession)}/packed-{uuid.uuid4().hex}")
    # One row for each partition, not for each document.
    counts = {r["part"]: r["n"] for r in packed.groupBy("part").agg(F.max("seq").alias("n")).collect()}
    starts, total = {}, 0
    for p in sorted(counts):
        starts[p], total = total, total + counts[p] + 1

    def place(b: pa.RecordBatch) -> list[pa.Array]:
        small = zstandard.ZstdCompressor(level=SHUFFLE_LEVEL)
        number = np.array([starts[p] for p in b.column(0).to_pylist()], np.int64) + b.column(1).to_numpy(zero_copy_only=False)
        return [pa.array(slots(number, total, key)), *(b.column(i) for i in range(2, 5)), pa.array([small.compress(x) for x in b.column(5).to_pylist()], pa.binary())]

    def whole(b: pa.RecordBatch) -> list[pa.Array]:
        large = zstandard.ZstdDecompressor()
        return [*(b.column(i) for i in range(4)), pa.array([large.decompress(x) for x in b.column(4).to_pylist()], pa.binary())]

    # Ids are shuffled compressed. A range of slots is a whole number of shards and goes to a task of its own.
    schema = "slot long, first_doc long, n_docs int, n_tokens int, ids binary"
    shards = max(1, -(-total // shard_size))
    each = -(-shards // WRITERS)
    task = F.floor(F.col("slot") / (shard_size * each)).cast("int")
    sorted_ = map_batches(packed, place, schema).repartitionById(-(-shards // each), task).sortWithinPartitions("slot")
    record = F.col("slot") % shard_size
    return map_batches(sorted_, whole, schema).select(
        "slot", F.floor(F.col("slot") / shard_size).cast("long").alias("shard"), record.alias("record"), (record * length * 2).alias("byte_offset"), "first_doc", "n_docs", "n_tokens", "ids"
    )


def shard_folder(spark: SparkSession, source: str, key: bytes, length: int = LENGTH, shard_size: int = SHARD) -> str:
    """A folder in the shared one, as a URI, for the shards of one source, key and size."""
    root = checkpoint_dir(spark)
    name = hashlib.sha256(repr((source, key, length, shard_size)).encode()).hexdigest()[:16]
    return f"{root if ':/' in root else 'file://' + os.path.abspath(root)}/shards-{name}"


def write_shards(ordered: DataFrame, folder: str) -> DataFrame:
    """Write each shard as one file of raw ids and give the manifest (shard, path, records, bytes, sha256).

    ``folder`` is a URI that executors share, and so is each path. A shard is written under a name of its attempt and then
    moved to the name of its digest, so a lost or repeated task leaves whole files only, and a run keeps the files
    that hold its own data already. When all are there, the manifest is stored and becomes the folder's current one (see
    shards()), and files that it doesn't list are deleted: those of an earlier, larger run among them. An empty
    table leaves an empty manifest. Rows must come as training_order() gives them: a shard's rows in one partition, sorted by slot.
    """
    return _published(cut(_written(ordered.select("shard", "ids"), folder, False)), folder)


def _published(manifest: DataFrame, folder: str) -> DataFrame:
    """Make ``manifest`` the folder's current one and delete what it doesn't list: one short name for each shard."""
    spark = manifest.sparkSession
    name = f"manifest-{uuid.uuid4().hex}"
    manifest.write.parquet(f"{folder}/{name}")
    total = manifest.agg(F.count(F.lit(1)).alias("shards"), F.coalesce(F.sum("records"), F.lit(0)).alias("records"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first().asDict()
    fs, root = pafs.FileSystem.from_uri(folder)
    own = f"{root}/{uuid.uuid4().hex}.part"
    with fs.open_output_stream(own) as out:
        out.write(json.dumps(total | {"manifest": name}).encode())
    fs.move(own, f"{root}/CURRENT.json")
    there = [(i.base_name,) for i in fs.get_file_info(pafs.FileSelector(root)) if i.base_name not in ("CURRENT.json", name)]
    listed = manifest.select(F.element_at(F.split("path", "/"), -1).alias("name"))
    for (stale,) in spark.createDataFrame(there, "name string").join(listed, "name", "left_anti").collect():
        dropped(spark, f"{folder}/{stale}")
    return shards(spark, folder)


def shards(spark: SparkSession, folder: str) -> DataFrame:
    """The current manifest of a folder: (shard, path, records, bytes, sha256), shard by shard what a reader reads."""
    fs, root = pafs.FileSystem.from_uri(folder)
    with fs.open_input_file(f"{root}/CURRENT.json") as f:
        name = json.loads(f.read())["manifest"]
    return spark.read.schema("shard long, path string, records long, bytes long, sha256 string").parquet(f"{folder}/{name}")


def written_order(ordered: DataFrame, folder: str) -> DataFrame:
    """The rows of ``ordered`` with the path of their shard, after writing all shards (see write_shards()).

    Shards are written when this is called; ids are read back from the files at their offsets.
    """
    kinds = {f.name: f.dataType.simpleString() for f in ordered.schema.fields}
    stored = cut(_written(ordered, folder, True))
    _published(stored.groupBy("shard", "path").agg(F.count(F.lit(1)).alias("records"), F.sum("n_bytes").alias("bytes")).withColumn("sha256", F.regexp_extract("path", "-([0-9a-f]{64})[.]bin$", 1)), folder)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        own, source = None, None
        for b in batches:
            ids = []
            for path, at, size in zip(*(b.column(n).to_pylist() for n in ("path", "byte_offset", "n_bytes"))):
                if path != own:
                    if source:
                        source.close()
                    own, source = path, fs.open_input_file(pafs.FileSystem.from_uri(path)[1])
                ids.append(source.read_at(size, at))
            got = {n: b.column(n) for n in kinds if n != "ids"} | {"ids": pa.array(ids, pa.binary()), "path": b.column("path")}
            yield pa.RecordBatch.from_arrays([got[n] for n in (*kinds, "path")], [*kinds, "path"])
        if source:
            source.close()

    return small_batches(stored).mapInArrow(fill, ", ".join(f"{n} {t}" for n, t in kinds.items()) + ", path string")


def ordered_shards(docs: DataFrame, ranks_path: str, pattern: str, key: bytes, folder: str, length: int = LENGTH, shard_size: int = SHARD) -> DataFrame:
    """written_order() of training_order() of ``docs``; the packed sequences in between are deleted."""
    with scratch(docs.sparkSession, "packed") as packed_at:
        return written_order(training_order(docs, ranks_path, pattern, key, length, shard_size, packed_at), folder)


def _written(ordered: DataFrame, folder: str, each: bool) -> DataFrame:
    """Write the shards; give one row for each shard, or for each record, without its ids, if ``each``."""
    kept = [c for c in ordered.columns if c != "ids"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        held: dict[int, list] = {}
        facts: list[pa.RecordBatch] = []

        def put(path: str, data: bytes) -> None:
            own = f"{path}.{uuid.uuid4().hex}.part"
            with fs.open_output_stream(own) as out:
                out.write(data)
            fs.move(own, path)

        def done(shard: int, rows: list) -> pa.RecordBatch:
            data = b"".join(rows)
            digest = hashlib.sha256(data).hexdigest()
            name = f"shard-{shard:08d}-{digest}.bin"
            path, uri = f"{root}/{name}", f"{folder}/{name}"
            info = fs.get_file_info(path)
            if info.type == pafs.FileType.NotFound or info.size != len(data):
                put(path, data)
            if not each:
                return pa.RecordBatch.from_pydict({"shard": [shard], "path": [uri], "records": [len(rows)], "bytes": [len(data)], "sha256": [digest]})
            own = pa.Table.from_batches(facts).combine_chunks()
            own = own.filter(pc.equal(own.column("shard"), shard))
            own = own.append_column("path", pa.array([uri] * len(rows))).append_column("n_bytes", pa.array([len(r) for r in rows], pa.int32()))
            return own.combine_chunks().to_batches()[0]

        for b in batches:
            fact = b.select(kept)
            facts.append(fact)
            for shard, ids in zip(b.column("shard").to_pylist(), b.column("ids").to_pylist()):
                if shard not in held:
                    for s in list(held):
                        yield done(s, held.pop(s))
                        facts[:] = [fact]
                    held[shard] = []
                held[shard].append(ids)
        for s in list(held):
            yield done(s, held.pop(s))

    if not each:
        return small_batches(ordered).mapInArrow(write, "shard long, path string, records long, bytes long, sha256 string")
    kinds = ", ".join(f"{c} {ordered.schema[c].dataType.simpleString()}" for c in kept)
    return small_batches(ordered).mapInArrow(write, f"{kinds}, path string, n_bytes int")


def read_shard(uri: str, start_record: int = 0, length: int = LENGTH) -> np.ndarray:
    """Sequences of a shard from a record on: sequential, and resumable at any record."""
    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_file(path) as f:
        f.seek(start_record * length * 2)
        return np.frombuffer(f.read(), "<u2").reshape(-1, length)
