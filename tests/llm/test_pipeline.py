"""Stages of the pipeline, each against a brute-force version on its own input."""

from __future__ import annotations

import corpus_pipeline as pipeline
from helpers import SF

from agendry.llm import decontam, toxicity


def test_stages(spark):
    from test_operators import brute_common_lines, brute_components, brute_fingerprint, plain_lines

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [name for name, _ in pipeline.STAGES] == ["toxicity", "line_dedup", "simhash", "decontaminate", "bpe"] and pipeline.ORACLE_SQL is None
    frames = [docs]
    for _, stage in pipeline.STAGES:
        frames.append(stage(spark, frames[-1], SF).cache())
    rows = [[r.asDict() for r in f.collect()] for f in frames]
    assert all(f.columns == docs.columns for f in frames[:5])
    scorer = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert {r["doc_id"] for r in rows[1]} == {r["doc_id"] for r in rows[0] if scorer.score(r["text"] or "") < 0.5}

    before = sorted(rows[1], key=lambda r: r["doc_id"])
    after = {r["doc_id"]: r["text"] for r in rows[2]}
    assert len(after) == len(before)
    seen = set()
    for r, gone in zip(before, brute_common_lines([r["text"] for r in before])):
        lines, kept = plain_lines(r["text"]), plain_lines(after[r["doc_id"]])
        removed = [line for line in lines if line not in set(kept)]
        assert {lines[i] for i in gone} - set(removed) <= {lines[i] for i in range(len(lines)) if i not in gone} and set(removed) <= seen
        assert removed or after[r["doc_id"]] == r["text"]
        seen |= set(lines)

    found = brute_components({r["doc_id"]: brute_fingerprint(r["text"]) for r in rows[2]})
    assert {r["doc_id"] for r in rows[3]} == set(found.values())

    bad = {r.doc_id for r in decontam.contamination(frames[3], spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").collect()}
    assert {r["doc_id"] for r in rows[4]} == {r["doc_id"] for r in rows[3]} - bad
    assert {r["doc_id"] for r in rows[5]} == {r["doc_id"] for r in rows[4]}
    assert {r.doc_id for r in pipeline.run(spark, SF).collect()} == {r["doc_id"] for r in rows[5]}
