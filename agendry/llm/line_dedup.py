"""Line dedup by pairwise alignment.

Lines are compared stripped, empty lines aside. Documents meet through two kinds of shared keys: rare
lines, which few documents of the whole table hold, and runs of lines. A run is the shortest one from a
line on, or back from a line, that holds ``min_words`` words: each line of a common block of that many
words is in the run from the block's first line or in the run back from itself, so runs find every such
block, even one whose lines are all frequent. A run is proof enough by itself, so the earliest document (least
doc_id) that holds it is paired with every later one; pairs grow with the keys, not with the square of a group.
A rare line is part of an edited passage whose other lines may have other earliest holders, so all documents that
hold it are paired, at most RARE * (RARE - 1) / 2 pairs a line. A key is 128 bits, so no two texts of any corpus
share one by chance.

Each pair is aligned by patience diff: keys are anchors, and the longest chain of anchors in the same order
on both sides is the alignment. It decides which single lines go: aligned lines with at most ``GAP`` other
lines between them on either side are one passage, edited here and there, and go if they hold
``min_words`` words together; the same lines in another order, or scattered, stay. What the chain leaves out, moved blocks
and lines that stand several times, is aligned locally by the same rule. Runs hold that many words by themselves and go wherever they stand.
What is aligned is deleted from the later document.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from agendry.llm.arrow import free_name, scratch, small_batches, utf8
from agendry.runtime import cut

#: Words that a common passage has at least.
MIN_WORDS = 50
#: Documents that hold a rare line at most, words that it has at least, and lines between two lines of one passage.
RARE, LINE_WORDS, GAP = 100, 4, 3
#: Rounds of alignment with chains; what is left then is aligned block by block.
ROUNDS = 8
#: Pairs of places of one line in two documents up to which all are anchors; beyond, those near other lines' anchors.
PLACES = 10_000
#: Rows of a batch that the splitter emits at once.
EMITTED = 100_000


def line_keys(text: bytes, min_words: int = MIN_WORDS, line_words: int = LINE_WORDS) -> dict[int, tuple[int, int, list[int]]]:
    """By 128-bit hash (lines, words, first lines) of each run and, where it is no run itself, each line of ``line_words`` words.

    Lines are counted without empty ones; a key that stands several times in the text has several first lines.
    """
    lines = [words for line in text.split(b"\n") if (words := line.split())]
    clean = [b" ".join(words) + b"\n" for words in lines]
    sizes = [len(words) for words in lines]
    spans, end, held = [], 0, 0
    for start in range(len(lines)):
        while end < len(lines) and held < min_words:
            held += sizes[end]
            end += 1
        if held < min_words:
            break
        spans.append((start, end, held))
        held -= sizes[start]
    known, start, held = set(spans), 0, 0
    for end in range(1, len(lines) + 1):
        held += sizes[end - 1]
        while held - sizes[start] >= min_words:
            held -= sizes[start]
            start += 1
        if held >= min_words and (start, end, held) not in known:
            spans.append((start, end, held))
    spans += [(i, i + 1, n) for i, n in enumerate(sizes) if line_words <= n < min_words]
    out: dict[int, tuple[int, int, list[int]]] = {}
    for a, z, n in spans:
        whole = clean[a] if z == a + 1 else b"".join(clean[a:z])
        out.setdefault(xxhash.xxh3_128_intdigest(whole), (z - a, n, []))[2].append(a)
    return out


def keys(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, body, run, proof, at, size, words): the keys of each row, each once, with the lines that it begins at; ``body`` is the hash of its text."""

    def emit(ids: list, bodies: list, found: list[dict]) -> pa.RecordBatch:
        n = np.array([len(f) for f in found], np.int64)
        rows = pa.array(np.repeat(np.arange(len(n)), n))
        hashes = np.array([(h >> 64, h & 0xFFFFFFFFFFFFFFFF) for f in found for h in f], np.uint64).reshape(-1, 2)
        facts = [x for f in found for x in f.values()]
        at = pa.array([x[2] for x in facts], pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()).take(rows), pa.array(bodies, pa.int64()).take(rows), *[pa.array(hashes[:, i].copy().view(np.int64)) for i in (0, 1)], at,
                *[pa.array([x[i] for x in facts], pa.int32()) for i in (0, 1)],
            ],
            ["doc_id", "body", "run", "proof", "at", "size", "words"],
        )

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, bodies, found, held = [], [], [], 0
            for doc_id, body, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), utf8(b.column(2))):
                ids.append(doc_id)
                bodies.append(body)
                found.append(line_keys(text, min_words))
                held += len(found[-1])
                if held >= EMITTED:
                    yield emit(ids, bodies, found)
                    ids, bodies, found, held = [], [], [], 0
            yield emit(ids, bodies, found)

    source = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("body"), "text")
    return small_batches(source).mapInArrow(split, "doc_id long, body long, run long, proof long, at array<int>, size int, words int")


def longest_chain(anchors: list[tuple[int, int, int, int]]) -> list[int]:
    """Numbers of the anchors (later line, earlier line, ...) of the longest chain that rises on both sides, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    back = [-1] * len(anchors)
    for i in sorted(range(len(anchors)), key=lambda i: (anchors[i][0], -anchors[i][1])):
        at = bisect_left(tops, anchors[i][1])
        back[i] = piles[at - 1] if at else -1
        tops[at : at + 1] = [anchors[i][1]]
        piles[at : at + 1] = [i]
    chain, i = [], piles[-1] if piles else -1
    while i >= 0:
        chain.append(i)
        i = back[i]
    return chain[::-1]


def passages(chain: list[tuple[int, int, int, int]], min_words: int, gap: int = GAP) -> list[tuple[int, int, int]]:
    """(later line, earlier line, lines) of the parts of a chain that hold ``min_words`` words with small gaps only.

    Anchors that overlap on one side but not in the same way on the other belong to different passages.
    """
    out: list[tuple[int, int, int]] = []
    held: list[tuple[int, int, int]] = []
    words = 0

    def close() -> None:
        if words >= min_words:
            out.extend(held)

    for later, earlier, size, n in chain:
        if held:
            a, b, m = held[-1]
            if later - a == earlier - b and later <= a + m:
                # The same diagonal: what this anchor adds are its lines beyond the last one.
                new = max(0, later + size - a - m)
                held[-1] = (a, b, max(m, later + size - a))
                words += n if new == size else n * new // size
                continue
            if not (0 <= later - a - m <= gap and 0 <= earlier - b - m <= gap):
                close()
                held, words = [], 0
        held.append((later, earlier, size))
        words += n
    close()
    return out


def local_lines(anchors: list[tuple[int, int, int, int]], min_words: int, gap: int = GAP) -> list[tuple[int, int, int]]:
    """(later line, earlier line, 1) of single lines that lie on a rising chain, with at most ``gap`` lines between neighbours on either side, of ``min_words`` words."""
    held = {(later, earlier): n for later, earlier, size, n in anchors if size == 1}
    steps = [(i, j) for i in range(1, gap + 2) for j in range(1, gap + 2)]

    def most(order: list, sign: int) -> dict:
        out: dict[tuple[int, int], int] = {}
        for i, j in order:
            out[i, j] = held[i, j] + max((out.get((i - sign * a, j - sign * b), 0) for a, b in steps))
        return out

    order = sorted(held)
    before, after = most(order, 1), most(order[::-1], -1)
    return [(i, j, 1) for i, j in order if before[i, j] + after[i, j] - held[i, j] >= min_words]


def patience(anchors: list[tuple[int, int, int, int]], min_words: int = MIN_WORDS, gap: int = GAP) -> list[tuple[int, int, int]]:
    """Common blocks (later line, earlier line, lines) from anchors (later line, earlier line, lines, words)."""
    left = sorted(set(anchors))
    blocks = passages([left[i] for i in longest_chain(left)], min_words, gap) + local_lines(left, min_words, gap)
    # Runs that the chain left out are moved blocks, aligned among themselves.
    left = [x for x in left if x[3] >= min_words]
    for _ in range(ROUNDS):
        gone = {line for a, _, n in blocks for line in range(a, a + n)}
        left = [x for x in left if any(line not in gone for line in range(x[0], x[0] + x[2]))]
        if not left:
            return blocks
        taken = longest_chain(left)
        blocks += [left[i][:3] for i in taken]
        left = [x for i, x in enumerate(left) if i not in set(taken)]
    return blocks + [x[:3] for x in left]


def anchors_of(shared: list[dict], gap: int = GAP) -> list[tuple[int, int, int, int]]:
    """Anchors (later line, earlier line, lines, words) of a pair from its shared keys and their places on both sides."""
    out = [(i, j, k["size"], k["words"]) for k in shared if len(k["at"]) * len(k["first_at"]) <= PLACES for i in k["at"] for j in k["first_at"]]
    many = [k for k in shared if len(k["at"]) * len(k["first_at"]) > PLACES]
    if many:
        near = {(i + a, j + b) for i, j, _, _ in out for a in range(-gap - 1, gap + 2) for b in range(-gap - 1, gap + 2)}
        for k in many:
            later, earlier = set(k["at"]), set(k["first_at"])
            out += [(i, j, k["size"], k["words"]) for i, j in near if i in later and j in earlier]
            # A run goes from wherever it stands.
            out += [(i, k["first_at"][0], k["size"], k["words"]) for i in k["at"]]
    return out


def common_blocks(docs: DataFrame, min_words: int = MIN_WORDS, rare: int = RARE) -> DataFrame:
    """(doc_id, body, first_id, pos, first_pos, size): aligned blocks of each row with earlier documents."""
    with scratch(docs.sparkSession, "line-keys") as folder:
        # Keys are read for their counts, for runs and for rare lines: they are stored once, compressed, till the blocks are known.
        stored = keys(docs, min_words)
        stored.write.options(**{"compression": "zstd"}).parquet(folder)
        return cut(_aligned(docs.sparkSession.read.schema(stored.schema).parquet(folder), min_words, rare))


def _aligned(found: DataFrame, min_words: int, rare: int) -> DataFrame:
    counted = found.groupBy("run", "proof").agg(F.min(F.struct("doc_id", "body", F.slice("at", 1, 1).alias("at"))).alias("f"), F.count(F.lit(1)).alias("held")).where("held > 1")
    shared = lambda at, first: F.struct(at.alias("at"), first.alias("first_at"), "size", "words")
    names = ["doc_id", "body", "first_id", "first_body"]
    runs = found.where(F.col("words") >= min_words).join(counted, ["run", "proof"]).where(F.col("doc_id") > F.col("f.doc_id"))
    by_runs = runs.select("doc_id", "body", F.col("f.doc_id").alias("first_id"), F.col("f.body").alias("first_body"), shared(F.col("at"), F.col("f.at")).alias("key"))
    # All holders of a rare line, at most ``rare``, in their order; each is paired with every one before it.
    lines = found.where(F.col("words") < min_words).join(counted.where(F.col("held") <= rare).select("run", "proof"), ["run", "proof"])
    holders = lines.groupBy("run", "proof", "size", "words").agg(F.array_sort(F.collect_list(F.struct("doc_id", "body", "at"))).alias("h"))
    each = F.flatten(F.transform("h", lambda x, i: F.transform(F.filter(F.slice(F.col("h"), F.lit(1), i), lambda y: y["doc_id"] < x["doc_id"]), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    by_lines = holders.select("size", "words", F.explode(each).alias("p")).select(
        F.col("p.x.doc_id").alias("doc_id"), F.col("p.x.body").alias("body"), F.col("p.y.doc_id").alias("first_id"), F.col("p.y.body").alias("first_body"), shared(F.col("p.x.at"), F.col("p.y.at")).alias("key")
    )
    words = F.sum(F.col("key.words") * F.least(F.size("key.at"), F.size("key.first_at"))).alias("words")
    pairs = by_runs.union(by_lines).groupBy(*names).agg(F.collect_list("key").alias("shared"), words, F.max(F.col("key.words")).alias("most"))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, body, first_id, held in zip(*(b.column(i).to_pylist() for i in range(4))):
                rows += [(doc_id, body, first_id, *block) for block in patience(anchors_of(held), min_words)]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "body", "first_id", "pos", "first_pos", "size"])

    # Pairs whose shared keys hold fewer words in all have no passage.
    able = pairs.where((F.col("words") >= min_words) | (F.col("most") >= min_words)).select("doc_id", "body", "first_id", "shared")
    return small_batches(able).mapInArrow(align, "doc_id long, body long, first_id long, pos int, first_pos int, size int")


def without_lines(text: str, gone: set[int]) -> str:
    """The text without the lines of those numbers; empty lines have no number and stay, unless nothing else does."""
    kept, n, some = [], 0, False
    for line in text.split("\n"):
        if line.strip(" \t\n\r\x0b\x0c"):
            n += 1
            if n - 1 in gone:
                continue
            some = True
        kept.append(line)
    return "\n".join(kept) if some else ""


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with common blocks deleted from the later document; n_removed, the lines deleted, is added.

    The later document is the one of the larger doc_id; rows with a null doc_id or text are left as
    they are, and rows repeated under one doc_id are the same document. Kept lines, empty ones among
    them, stay in their order and as they were; a text all of whose lines were common is empty.
    Passages shorter than ``min_words`` words stay. A column n_chars is set to the new length. Other
    columns are kept; one named n_removed is replaced.
    """
    own_id, own_body, gone, shorter = (free_name(docs, f"dedup_{n}") for n in ("id", "body", "gone", "text"))
    # Lines are numbered without empty ones.
    blocks = common_blocks(docs, min_words).groupBy(F.col("doc_id").alias(own_id), F.col("body").alias(own_body)).agg(F.collect_set(F.struct("pos", "size")).alias(gone))
    numbered = blocks.withColumn(gone, F.array_distinct(F.flatten(F.transform(gone, lambda s: F.sequence(s["pos"], s["pos"] + s["size"] - 1)))))
    joined = docs.join(numbered, (F.col("doc_id") == F.col(own_id)) & (F.xxhash64("text") == F.col(own_body)), "left")

    @F.pandas_udf("string")
    def shortened(text: pd.Series, lines: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else without_lines(t, set(n.tolist())) for t, n in zip(text, lines)], dtype=object)

    hit = F.col(gone).isNotNull()
    done = joined.withColumn(shorter, shortened(F.when(hit, F.col("text")), F.col(gone)))
    new = {"text": F.when(hit, F.col(shorter)).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(hit, F.char_length(shorter)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return done.select(*[new.get(c, F.col(c)).alias(c) for c in docs.columns if c != "n_removed"], F.when(hit, F.size(gone)).otherwise(0).alias("n_removed"))
