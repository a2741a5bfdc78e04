"""Merkle manifest of a table: one root for all rows, and for each row a proof that leads to it.

Every row is a leaf, the SHA-256 of its columns. Per ``lang`` the leaves, by ascending doc_id, are hashed
two by two, level by level, until one node is left; the subroots, by ``lang``, are hashed likewise to the root.

Positions are found without a window over a language: rows are range-partitioned and sorted, and a row's
position is its place in its partition plus the counts of the partitions before. ``BLOCK`` neighbours from an
aligned position on form a block, whose levels are hexadecimal strings, one a level: substrings of 128 digits
hash to the 64 digits of a parent, and the 64 digits beside a node are its sibling. The nodes that blocks end
in are the leaves of the next round, so rounds grow with the logarithm of the table, and no task holds
more than a block. SQL functions do all of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from agendry.runtime import cut

#: Levels that a block's string is folded by in a round, and leaves of a block.
LEVELS = 10
BLOCK = 1 << LEVELS
#: Hexadecimal digits of a digest.
DIGITS = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*fields: Column) -> Column:
    """The leaf of a row: ``-`` for a null, else the count of UTF-8 bytes, a colon and the value; all concatenated."""
    as_text = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in as_text]).cast("binary"), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, leaf, altered): the leaf of each row; ``altered`` is its leaf with n_chars raised by one where the row counts as tampered, else the same."""
    doc_id, source, lang, n_chars, text = (F.col(f"`{c}`") for c in FIELDS)
    leaf = digest(doc_id, source, lang, n_chars, text)
    tampered = F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 0, F.lit(False)) & n_chars.isNotNull()
    # Decimal, so that the largest long can be raised as well.
    raised = digest(doc_id, source, lang, n_chars.cast("decimal(20,0)") + 1, text)
    return docs.select(doc_id.alias("doc_id"), lang.alias("lang"), leaf.alias("leaf"), F.when(tampered, raised).alias("altered")).withColumn("altered", F.coalesce("altered", "leaf"))


def placed(nodes: DataFrame, group: str, *order: str) -> DataFrame:
    """``nodes`` with pos, the place from 0 on of each row in its group by ascending ``order``, nulls first, and total, the group's rows.

    Rows are dealt by ranges of (group, order), so a group of any size spreads over tasks. Rows that are
    equal in all of these are dealt at random, and each gets a place of its own.
    """
    tie = F.hash(F.monotonically_increasing_id()).alias("_tie")
    keys = [group, *order, "_tie"]
    dealt = nodes.select("*", tie).repartitionByRange(*keys).sortWithinPartitions(*keys)
    held = cut(dealt.drop("_tie").select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")))
    counts = held.groupBy(F.col(group).alias("_group"), F.col("_part").alias("_own")).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    # One row for each pair of group and partition: what stands before a partition is the sum over the ones before it.
    before = F.coalesce(F.expr("sum(_n) over (partition by _group order by _own rows between unbounded preceding and 1 preceding)"), F.lit(0))
    starts = counts.select("_group", "_own", (F.col("_first") - before).alias("_from"), F.expr("sum(_n) over (partition by _group)").alias("total"))
    return held.join(starts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_own"))).withColumn("pos", F.col("_at") - F.col("_from")).drop("_part", "_at", "_group", "_own", "_from")


def _parents(level: Column) -> Column:
    """The level above one: every 128 digits hash to 64; the last node of an odd level is hashed alone."""
    runs = F.ceil(F.length(level) / (2 * DIGITS)).cast("int")
    return F.array_join(F.transform(F.sequence(F.lit(0), runs - 1), lambda i: F.sha2(F.substring(level, i * (2 * DIGITS) + 1, F.lit(2 * DIGITS)).cast("binary"), 256)), "")


def _levels(lowest: Column, rises: Column) -> Column:
    """All level strings of a block, from its leaves on; the last one is the node that it ends in."""
    up = F.filter(F.sequence(F.lit(0), F.lit(LEVELS)), lambda k: (k > 0) & (k <= rises))
    return F.aggregate(up, F.array(lowest), lambda held, _: F.concat(held, F.array(_parents(F.element_at(held, -1)))))


def _steps(levels: Column, pos: Column) -> Column:
    """For each rise of place ``pos`` in its block: ``l`` or ``r``, the sibling's side, and its digits; none where a node stands alone."""

    def one(level: Column, k: Column) -> Column:
        node = F.call_function("shiftright", (pos % BLOCK).cast("int"), k)
        sibling = node.bitwiseXOR(F.lit(1))
        return F.concat(F.when(sibling < node, "l").otherwise("r"), F.substring(level, sibling * DIGITS + 1, F.lit(DIGITS)))

    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), one)


def folded(node: Column, steps: Column) -> Column:
    """The node that a leaf and its steps lead to."""
    sibling = lambda step: F.substring(step, F.lit(2), F.lit(DIGITS))
    return F.aggregate(steps, node, lambda held, step: F.sha2(F.when(F.startswith(step, F.lit("l")), F.concat(sibling(step), held)).otherwise(F.concat(held, sibling(step))).cast("binary"), 256))


def proof(steps: Column) -> Column:
    """The siblings' digits, from the leaf up."""
    return F.array_join(F.transform(steps, lambda s: F.substring(s, F.lit(2), F.lit(DIGITS))), "")


def blocks(nodes: DataFrame, group: str, node: str, *carried: str) -> DataFrame:
    """(group, block, total, members, levels): aligned blocks of rows with pos and total; ``members`` are structs of pos, node and what is carried, in order."""
    members = F.array_sort(F.collect_list(F.struct("pos", F.col(node).alias("node"), *carried))).alias("members")
    held = nodes.groupBy(group, F.floor(F.col("pos") / BLOCK).cast("long").alias("block"), "total").agg(members)
    n = F.size("members")
    # A group of one block rises until one node is left; of several, each block rises by LEVELS, alone nodes too.
    rises = F.when(F.col("total") > BLOCK, F.lit(LEVELS)).when(n > 1, F.length(F.bin(n - 1))).otherwise(0)
    return held.withColumn("levels", _levels(F.array_join(F.transform("members", lambda m: m["node"]), ""), rises))


def tree(nodes: DataFrame, group: str, node: str, *carried: str) -> tuple[DataFrame, DataFrame]:
    """(blocks, roots) of one tree for each group of rows with group, pos, total and node.

    ``blocks``: those of blocks(), with ``up``, the steps from the node that a block ends in to the group's root.
    ``roots``: group, root.
    """
    rounds = [cut(blocks(nodes, group, node, *carried))]
    # Groups that have ended stand for themselves in later rounds: a lone node is its own root.
    while not rounds[-1].where(F.col("total") > BLOCK).isEmpty():
        tops = rounds[-1].select(group, F.col("block").alias("pos"), F.ceil(F.col("total") / BLOCK).cast("long").alias("total"), F.element_at("levels", -1).alias("node"))
        rounds.append(cut(blocks(tops, group, "node")))
    roots = rounds[-1].select(group, F.element_at("levels", -1).alias("root"))
    found = rounds[-1].withColumn("up", F.array().cast("array<string>"))
    for below in reversed(rounds[:-1]):
        each = found.select(F.col(group).alias("_group"), F.inline(F.transform("members", lambda m: F.struct(m["pos"].alias("_pos"), F.concat(_steps(F.col("levels"), m["pos"]), F.col("up")).alias("up")))))
        found = below.join(each, below[group].eqNullSafe(each["_group"]) & (below["block"] == each["_pos"])).drop("_group", "_pos")
    return found, roots


def manifest(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``proof_sha256`` is the digest of the siblings, level by level up to the root; folded_root is what the
    altered leaf (see leaves()) and the original siblings lead to. Digests are lower-case hexadecimal strings.
    Rows without doc_id come first in their language and count as untampered; a null language is one
    of its own and comes first; rows repeated under a doc_id are ordered by their leaves, and equal rows
    get a place each. Null fields differ from empty ones. An empty table gives no rows; other columns are not read.
    """
    found, subroots = tree(placed(leaves(docs), "lang", "doc_id", "leaf"), "lang", "leaf", "doc_id", "altered")
    top, root = tree(placed(subroots.select(F.lit(0).alias("all"), "lang", "root"), "all", "lang"), "all", "root", "lang")
    steps = F.transform("members", lambda m: F.struct(m["lang"].alias("_lang"), m["node"].alias("subroot"), F.concat(_steps(F.col("levels"), m["pos"]), F.col("up")).alias("top")))
    named = top.join(root, "all").select("root", F.inline(steps))
    # Languages are joined to blocks, not to rows; within a block, all is done on its array.
    joined = found.join(named, F.col("lang").eqNullSafe(F.col("_lang")))

    def row(m: Column) -> Column:
        return F.struct(m["doc_id"].alias("doc_id"), m["node"].alias("leaf"), m["altered"].alias("altered"), F.concat(_steps(F.col("levels"), m["pos"]), F.col("up"), F.col("top")).alias("steps"))

    each = joined.select("subroot", "root", F.transform("members", row).alias("rows"))
    done = F.transform("rows", lambda r: F.struct(r["doc_id"], r["leaf"], F.sha2(proof(r["steps"]).cast("binary"), 256).alias("proof_sha256"), folded(r["altered"], r["steps"]).alias("folded_root")))
    return each.select("subroot", "root", F.inline(done)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
