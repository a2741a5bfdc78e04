"""Benchmark decontamination with DataFrame functions only.

The 13-word windows of the benchmark are hashed into a broadcast table. Each document's words are
hashed window by window inside the row, the windows are exploded and meet the table in one broadcast
join, and each hit is verified on its words. A marker window per document meets a marker row of the
table, so documents without hits come out of the same pass and the text is read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from agendry.llm.arrow import free_name

WINDOW = 13
#: The word pattern after A-Z became a-z.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The benchmark's windows are broadcast up to this size; a larger set is joined by a shuffle.
BROADCAST_BYTES = 64 << 20
#: Bytes of a broadcast row besides its words.
ROW_BYTES = 120


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z only) words of a text; none for null."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORDS), F.lit(0))


def _windows(words: Column, n: Column, length: Column | int) -> Column:
    """(pos, len, h) for each window of that many words."""
    size = F.lit(length) if isinstance(length, int) else length
    each = lambda i: F.struct(i.alias("pos"), size.alias("len"), F.xxhash64(F.slice(words, i, size)).alias("h"))
    return F.when(n >= size, F.transform(F.sequence(F.lit(1), n - size + 1), each)).otherwise(F.array().cast("array<struct<pos:int,len:int,h:bigint>>"))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(len, h, gram, item_id): each window of each item; an item of fewer words is one window."""
    worded = benchmark.select("item_id", words_of(F.col("text")).alias("words")).withColumn("n", F.size("words")).where("n > 0")
    size = F.least(F.col("n"), F.lit(window))
    return (
        worded.select("item_id", "words", F.explode(_windows(F.col("words"), F.col("n"), size)).alias("w"))
        .select("w.len", "w.h", F.array_join(F.slice("words", F.col("w.pos"), F.col("w.len")), " ").alias("gram"), "item_id")
        .distinct()
    )


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: tuple[str, ...] = (), broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row for each row of ``docs``: row_id, doc_id, n_words, spans (pos, len), items, and the columns of ``keep``.

    Null and empty texts have no words, and items without words have no windows. Rows repeated under
    one doc_id stay rows of their own. Items with a null item_id hit words but are not listed.
    """
    grams = benchmark_windows(benchmark, window)
    known = grams.agg(F.collect_set("len").alias("lens"), F.coalesce(F.sum(F.octet_length("gram") + ROW_BYTES), F.lit(0)).alias("bytes")).first()
    marker = grams.sparkSession.range(1).select(F.lit(0).alias("len"), F.lit(0).cast("long").alias("h"), F.lit("").alias("gram"), F.lit(None).cast(grams.schema["item_id"].dataType).alias("item_id"))
    table = grams.union(marker)
    if known["bytes"] <= broadcast_bytes:
        table = F.broadcast(table)
    worded = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", *[F.col(c).alias(f"_{c}") for c in keep], words_of(F.col("text")).alias("words")).withColumn("n_words", F.size("words"))
    sentinel = F.array(F.struct(F.lit(0).alias("pos"), F.lit(0).alias("len"), F.lit(0).cast("long").alias("h")))
    windows = F.concat(sentinel, *[_windows(F.col("words"), F.col("n_words"), n) for n in sorted(known["lens"])])
    each = worded.select("*", F.explode(windows).alias("w"))
    same = F.when(F.col("w.len") > 0, F.array_join(F.slice("words", F.greatest(F.col("w.pos"), F.lit(1)), F.col("w.len")), " ")).otherwise("") == F.col("gram")
    met = each.join(table, (F.col("w.len") == F.col("len")) & (F.col("w.h") == F.col("h")) & same)
    span = F.when(F.col("len") > 0, F.struct(F.col("w.pos").alias("pos"), F.col("w.len").alias("len")))
    return met.groupBy("row_id").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").cast("long").alias("n_words"), *[F.first(f"_{c}").alias(c) for c in keep], F.collect_set(span).alias("spans"), F.collect_set("item_id").alias("items")
    )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of ``docs`` (see hits())."""
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["pos"], s["pos"] + s["len"] - 1))))
    found = hits(docs, benchmark, window, keep).withColumn("n_hit", F.size(covered).cast("long"))
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), *keep,
    )


def remove_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without its contaminated rows; all columns as they were.

    A row goes by its own text alone, whatever its doc_id: the digest of a contaminated text names it.
    """
    digest, name = F.sha2("text", 256), free_name(docs, "bad_text")
    marked = docs.select("doc_id", "text", digest.alias("digest"))
    bad = contamination(marked, benchmark, window, keep=("digest",)).where("contaminated").select(F.col("digest").alias(name)).distinct()
    return docs.join(bad, digest == F.col(name), "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text): each whole text without the words that windows hit; what stands between words stays."""
    found = hits(docs, benchmark, window, keep=("text",))
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["pos"], s["pos"] + s["len"] - 1))))
    pieces = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    is_word = lambda p: ~p.rlike(r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
    at = found.withColumn("_covered", covered).withColumn("_pieces", pieces)
    # Words and what stands between them alternate, so a piece's word number follows from its place.
    lead = F.when(is_word(F.coalesce(F.try_element_at("_pieces", F.lit(1)), F.lit(" "))), 0).otherwise(1)
    kept = F.filter("_pieces", lambda p, i: ~(((i + lead) % 2 == 0) & F.array_contains(F.col("_covered"), F.floor((i - lead) / 2).cast("int") + 1)))
    return at.select("doc_id", F.when(F.size("_covered") == 0, F.col("text")).otherwise(F.array_join(kept, "")).alias("text"))
