"""Exact, SimHash and suffix dedup against brute force on small tables."""

import hashlib
import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from brute import brute_components, brute_cut, brute_groups, brute_print
from seatplan.llm import exact_dedup, simhash, suffix_dedup, suffix_merge


# ---------------------------------------------------------------- exact
def exact_texts():
    rnd = random.Random(1)
    base = ["A sentence. " * 40, "x" * 5000, "one two three", "", None, " \t\n", "é ü. " * 100, "a.b.c."]
    out = []
    for t in base:
        for _ in range(4):
            out.append(t)
            out.append(None if t is None else t.replace(" ", rnd.choice([" ", "  ", "\n", ""])))
    return out + ["x" * 5000 + "y", "y" + "x" * 5000]


def test_exact_groups(docs):
    texts = exact_texts()
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256)
           for r in exact_dedup.exact_groups(docs(texts), min_chunk=8, max_chunk=64).collect()}
    assert got == brute_groups(texts)


def test_exact_groups_with_colliding_identifiers(docs, monkeypatch):
    """Identifiers that stand for many chunk texts still tell texts apart."""
    real = F.xxhash64
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.pmod(real(*c), F.lit(3)))
    texts = exact_texts()
    for few in (10_000, 0):  # broadcast side and shuffle side
        monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", few)
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256)
               for r in exact_dedup.exact_groups(docs(texts), min_chunk=8, max_chunk=64).collect()}
        assert got == brute_groups(texts)


def test_exact_repeated_rows_and_other_columns(spark, table):
    rows = [(1, "same", 5), (1, "same", 5), (None, "same", 6), (2, "other", 7)]
    t = table(rows, "doc_id long, text string, group_size int")
    kept = sorted((r.doc_id, r.text, r.group_size) for r in exact_dedup.drop_duplicates(t).collect())
    assert kept == [(1, "same", 5), (2, "other", 7)]
    assert exact_dedup.exact_groups(t.limit(0)).count() == 0


# ---------------------------------------------------------------- SimHash
def test_fingerprints_and_components(docs):
    rnd = random.Random(2)
    words = ["w%d" % i for i in range(60)]
    texts = ["", None, "one", "ONE", "one two", "\x1cone two", " ", "é É"]
    for _ in range(12):
        t = [rnd.choice(words) for _ in range(rnd.randrange(3, 400))]
        for _ in range(6):
            u = list(t)
            if rnd.random() < .7:
                u[rnd.randrange(len(u))] = rnd.choice(words)
            texts.append(" ".join(u).title() if rnd.random() < .2 else " ".join(u))
    prints = [brute_print(t, 3) for t in texts]
    want = brute_components(prints, 2)
    got = {r.doc_id: r for r in simhash.near_groups(docs(texts), 3, 2).collect()}
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [got[i].component_id for i in range(len(texts))] == want
    assert sorted(i for i in got if got[i].stays) == sorted(set(want))


def near_prints(rnd, n):
    out = []
    while len(out) < n:
        seed = rnd.getrandbits(64)
        for _ in range(rnd.randrange(1, 25)):
            out.append(seed)
            for _ in range(rnd.randrange(0, 3)):
                seed ^= 1 << rnd.randrange(64)
    return out[:n]


def test_links_connect_what_brute_force_connects(spark):
    rnd = random.Random(3)
    prints = list(dict.fromkeys(near_prints(rnd, 500)))
    signed = [(int(np.uint64(p).astype(np.int64)),) for p in prints]
    for segments, bits, rows in ((8, 2, 4096), (16, 2, 3), (8, 3, 2), (4, 1, 4096)):
        found = simhash.links(spark.createDataFrame(signed, "fp long"), bits, segments, rows).collect()
        at = {s[0]: i for i, s in enumerate(signed)}
        root = list(range(len(prints)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x
        for r in found:
            assert (prints[at[r.a]] ^ prints[at[r.b]]).bit_count() <= bits
            x, y = find(at[r.a]), find(at[r.b])
            root[max(x, y)] = min(x, y)
        assert [find(i) for i in range(len(prints))] == brute_components(prints, bits)


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 2000)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 301)} | {2000: 1000}


def test_near_dedup_of_a_hot_group(spark, table):
    rows = [(i, "the same old story " * 5, "x") for i in range(400)] + [(1000 + i, "w%d " % i * 9, "y") for i in range(50)]
    kept = simhash.keep_one_each(table(rows, "doc_id long, text string, row string"), 3, 2)
    ids = sorted(r.doc_id for r in kept.collect())
    assert ids[0] == 0 and len([i for i in ids if i < 1000]) == 1 and kept.columns == ["doc_id", "text", "row"]
    assert simhash.near_groups(kept.limit(0), 3, 2).count() == 0


# ---------------------------------------------------------------- suffixes
def suffix_texts(rnd, alphabet, length):
    phrase = "".join(rnd.choice("xyz") for _ in range(length + 5))
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(0, 160))) for _ in range(45)]
    texts = [t[:k] + phrase[rnd.randrange(3):] + t[k:] if rnd.random() < .6 else t
             for t in texts for k in [rnd.randrange(len(t) + 1)]]
    return texts + texts[:4] + ["a" * 90, "ab" * 40, "é" * 40, "", None]


def test_suffix_dedup(docs, monkeypatch):
    rnd = random.Random(5)
    for alphabet, length, segment in (("ab", 12, 1 << 20), ("abcd", 17, 40), ("abcdefgh", 24, 7)):
        monkeypatch.setattr(suffix_dedup, "_SEGMENT", segment)
        texts = suffix_texts(rnd, alphabet, length)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept))
               for r in suffix_dedup.remove_repeats(docs(texts), length).collect()}
        assert got == brute_cut([(t or "").encode() for t in texts], length)


def test_suffix_dedup_of_one_hot_passage(docs):
    """A passage that every text holds, between texts of their own."""
    rnd = random.Random(6)
    own = lambda: "".join(rnd.choice("abcdefgh ") for _ in range(rnd.randrange(5, 60)))
    passage = "".join(rnd.choice("klmnop ") for _ in range(33))
    texts = [own() + passage + own() for _ in range(150)]
    got = {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(docs(texts), 30).collect()}
    want = brute_cut([t.encode() for t in texts], 30)
    assert got == {i: w[1] for i, w in want.items()} and min(got.values()) >= 33


def test_suffix_dedup_of_an_empty_table(docs):
    assert suffix_dedup.remove_repeats(docs(["x"]).limit(0), 12).count() == 0


def test_loser_tree_merges_front_coded_runs():
    rnd = random.Random(7)
    items = [(bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(0, 12))), i, i % 7, b"r%d" % i) for i in range(500)]
    for n in (1, 2, 3, 8, 13):
        runs = [sorted(items[k::n]) for k in range(n)]
        out = list(suffix_merge.merged([suffix_merge.front_coded(r) for r in runs]))
        assert [x for _, x in out] == sorted(items)
        assert [h for h, _ in out][1:] == [suffix_merge.common_prefix(a[0], b[0]) for (_, a), (_, b) in zip(out, out[1:])]
    assert list(suffix_merge.merged([])) == []
