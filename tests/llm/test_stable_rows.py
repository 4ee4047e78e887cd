"""Rows keep their identity when the number of cores changes between two actions."""

import random

import pytest

from seatplan.llm import exact_dedup, mixing, simhash, suffix_dedup
from seatplan.plans import lineage, numbering
from brute import brute_cut

DOCS = "doc_id long, text string, source string, _row string"


@pytest.fixture
def shifting(spark, monkeypatch):
    """After the first table or checkpoint is written, files are packed another way."""
    settings = {"spark.sql.files.openCostInBytes": ("64k", "1"), "spark.sql.leafNodeDefaultParallelism": ("12", "2")}
    before = {k: spark.conf.get(k, None) for k in settings}

    def choose(i):
        for k, v in settings.items():
            spark.conf.set(k, v[i])

    def shifted(real):
        def run(*args, **kw):
            out = real(*args, **kw)
            choose(1)
            return out
        return run
    for module in (exact_dedup, mixing, simhash, suffix_dedup, numbering):
        for name in ("materialize", "written"):
            if hasattr(module, name):
                monkeypatch.setattr(module, name, shifted(getattr(lineage, name)))
    choose(0)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def rows_of(rnd):
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(5, 40))) for _ in range(120)]
    rows = [(i, t, rnd.choice(["a", "b", None]), f"own {i}") for i, t in enumerate(texts)]
    return rows + [(200 + i, t, "a", f"own {200 + i}") for i, t in enumerate(texts[:60])] + [(None, "null id", "a", "x")]


def test_packing_does_change_partitions(spark, table, shifting):
    t = table(rows_of(random.Random(1)), DOCS, files=12)
    first = t.rdd.getNumPartitions()
    simhash.materialize(t.limit(1))
    assert t.select("doc_id").rdd.getNumPartitions() != first


def test_one_row_of_equal_texts_stays(table, shifting):
    rows = rows_of(random.Random(1))
    t = table(rows, DOCS, files=12)
    kept = [tuple(r) for r in exact_dedup.drop_duplicates(t).collect()]
    assert sorted(r[1] for r in kept) == sorted({r[1] for r in rows}) and set(kept) <= set(rows)


def test_one_row_of_near_texts_stays(table, shifting):
    rows = rows_of(random.Random(2))
    t = table(rows, DOCS, files=12)
    kept = [tuple(r) for r in simhash.keep_one_each(t, 3, 0).collect()]
    assert set(kept) <= set(rows)
    prints = {}
    for r in rows:
        prints.setdefault(simhash.fingerprint(r[1].encode(), 3), []).append(r)
    best = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in prints.values()]
    assert sorted(map(str, kept)) == sorted(map(str, best))


def test_mixed_rows_are_those_taken(table, shifting):
    rows = rows_of(random.Random(3))
    t = table(rows, DOCS, files=12)
    got = sorted(map(str, (tuple(r) for r in mixing.mixed_rows(t).collect())))
    taken = {r.doc_id: r.copies for r in mixing.mix_sources(mixing.measured(t)).collect()}
    assert got == sorted(str(r) for r in rows for _ in range(taken[r[0]]))


@pytest.mark.parametrize("length", [30, 400])
def test_repeats_are_cut_from_their_own_texts(table, shifting, length):
    rnd = random.Random(length)
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(length + 40))
    rows = [(i, "".join(rnd.choice("abcdefgh ") for _ in range(rnd.randrange(900)))
             + (passage[rnd.randrange(20):] if i % 3 == 0 else ""), "s", "r") for i in range(90)]
    t = table(rows, DOCS, files=12)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept))
           for r in suffix_dedup.remove_repeats(t, length).collect()}
    assert got == brute_cut([r[1].encode() for r in rows], length) and any(v[1] for v in got.values())


def test_other_tables_are_written_once(spark, shifting):
    """Not a scan: rows get their numbers in a written copy, and repeated rows stay apart."""
    t = spark.createDataFrame([(1, "x", "s", "r"), (1, "x", "s", "r"), (2, "y", "s", "r")], DOCS)
    keyed = numbering.keyed_rows(t.unionAll(t), "k")
    assert keyed.select("k").distinct().count() == 6 and keyed.count() == 6
    assert numbering.fresh_name(t, "_row") == "_row_"
