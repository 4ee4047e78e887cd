"""The pipeline's stages against brute-force versions; registry and contracts."""

import hashlib
import os
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from seatplan.llm import registry
from brute import brute_components, brute_copies, brute_groups, brute_identify, brute_print

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def test_every_operator_is_registered():
    names = registry.queries()
    assert [n for n in range(1, 14) if not any(q.startswith(f"op{n}_") for q in names)] == []
    assert "pipeline" in names and set(registry.oracle_sql()) <= set(names)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


@needs_tables
def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        path = str(tmp_path / str(k))
        out.write.parquet(path)
        out = spark.read.parquet(path)
        before = docs.collect()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        after = out.collect()
        ids = [r.doc_id for r in before]
        if k == 0:
            train = [(r.lang, r.text) for r in before if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 5]
            known = brute_identify(train, [r.text for r in before], 300)
            assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r, (lang, score) in zip(before, known) if lang != "und" and score >= .1)
        elif k == 1:
            want = brute_groups([r.text for r in sorted(before, key=lambda r: r.doc_id)])
            order = sorted(ids)
            assert sorted(r.doc_id for r in after) == sorted(order[i] for i, w in want.items() if w[2])
        elif k == 2:
            rows = sorted(before, key=lambda r: r.doc_id)
            roots = brute_components([brute_print(r.text, 3) for r in rows], 2)
            assert sorted(r.doc_id for r in after) == sorted({rows[i].doc_id for i in roots})
        elif k == 3:
            labels = spark.read.parquet(f"{SF}/labels.parquet").groupBy("doc_id").agg(F.max("quality").alias("q"))
            copies = brute_copies([(r.doc_id, r.text, r.source) for r in before], {r.doc_id: r.q for r in labels.collect()})
            assert sorted(str(tuple(r)) for r in after) == sorted(str(tuple(r)) for r, n in zip(before, copies) for _ in range(n))
        else:
            text = {r.doc_id: r.text for r in before}
            assert len(after) == len(before)
            assert all(r.decoded_sha256 == hashlib.sha256((text[r.doc_id] or "").encode()).hexdigest() for r in after)
        docs = out


def test_stages_on_awkward_documents(spark, table):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, "some words here", "en", None, None), (1, None, None, None, None), (1, None, None, None, None),
            (2, "", "en", "s", 0), (3, "some words here", "en", "s", 3), (3, "some words here", "en", "s", 3),
            (4, "x" * 20000, None, "s", 1), (5, "12 34", "en", "s", 1)]
    for given in (rows, []):
        docs = table(given, schema, files=2)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF) if os.path.isdir(SF) else docs
            assert out.count() <= 3 * max(1, len(given))
            docs = table([tuple(r) for r in out.collect()], out.schema, files=2)
