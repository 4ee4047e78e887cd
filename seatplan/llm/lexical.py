"""Ranked lexical search: the documents that score highest for each query text.

Terms are maximal runs of ASCII letters, digits and characters beyond ASCII;
only A-Z are lower-cased.  A term weighs ``floor(1000 ln((2N+2)/(2df+1)))``; its
score in a document is that times ``10^9 tf div (1000 tf + 20 m)``, with
``m = 50 + 50 n N div L``: whole numbers, so sums do not depend on their order.

One scan of the texts writes what the queries' terms need: per document its
length and the counts of those terms.  Ranking then streams that table, without
a shuffle of postings, in chunks of bounded size, as a hybrid of term-at-a-time
and document-at-a-time:

* the chunk's short lists of a query are summed into one accumulator per
  document, which from then on is one more posting list with its own bounds;
* over this list and the long ones documents are met in order, block by block:
  blocks whose bounds (the largest scores there) cannot reach the query's
  current k-th score are skipped; in the others only the lists that could lift
  a document to it give candidates, the rest are searched for those that are
  still within reach.

Each task keeps k documents per query across its chunks; those lists are merged
in two steps, by parts of tasks and then per query.

Defined results: null or term-less texts, of queries or documents, find
nothing; rows that repeat a ``doc_id`` are documents of their own; a null
``doc_id`` comes last among equal scores; rows that share an ``item_id`` are one
query; empty tables give empty results; long texts count as a whole; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seatplan.plans.lineage import materialize, written

#: The same characters, for Java's and for UTF-8 bytes' regular expressions.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERM_BYTES = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Longer terms are known by their SHA-256 (after a space, which no term holds).
LONG_TERM = 64
#: Up to so many query terms go to the tasks that scan texts; beyond it all terms are written.
SENT_TERMS = 500_000
#: (query, term) pairs ranked in one pass.
QUERY_TERMS = 100_000
#: Postings of a chunk, postings of a short list there, documents of a block and of a step.
CHUNK, SHORT, BLOCK, STEP = 1_000_000, 1024, 64, 4096
#: Parts of tasks whose lists are merged first.
PARTS = 256


def _key(term: bytes) -> bytes:
    return term if len(term) <= LONG_TERM else b" " + hashlib.sha256(term).hexdigest().encode()


def query_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): distinct terms of each query, long ones by their digest, as bytes."""
    low = F.translate(F.col("text").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    term = F.explode(F.array_distinct(F.regexp_extract_all(low, F.lit(TERM), F.lit(0))))
    raw = items.select(F.col("item_id").cast("long").alias("item_id"), term.alias("term"))
    named = F.when(F.octet_length("term") <= LONG_TERM, F.col("term")).otherwise(F.concat(F.lit(" "), F.sha2("term", 256)))
    return raw.select("item_id", named.cast("binary").alias("term")).distinct()


def _postings(vocabulary: frozenset[bytes] | None):
    """(text, doc_id) to (doc_id, n, terms, tfs): length in terms, and counts of the vocabulary's terms."""
    long_wanted = vocabulary is None or any(t[:1] == b" " for t in vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, sizes, terms, tfs = [], [], [], []
            for text in batch.column(0):
                words = _TERM_BYTES.findall((text.as_py() or b"").lower())
                found = Counter(words if vocabulary is None else filter(vocabulary.__contains__, words))
                if long_wanted:
                    far = Counter(w for w in words if len(w) > LONG_TERM)
                    for w, c in far.items():
                        found.pop(w, None)
                        if vocabulary is None or _key(w) in vocabulary:
                            found[_key(w)] += c
                lengths.append(len(words))
                sizes.append(len(found))
                terms.extend(found.keys())
                tfs.extend(found.values())
            ends = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
            yield pa.record_batch({
                "doc_id": batch.column(1), "n": pa.array(lengths, pa.int64()),
                "terms": pa.ListArray.from_arrays(ends, pa.array(terms, pa.binary())),
                "tfs": pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int64()))})

    return run


def indexed(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, n, terms, tfs) of every document, written: the counts of the queries' terms."""
    wanted = materialize(terms.select("term").distinct())
    few = wanted.count() <= SENT_TERMS
    vocabulary = frozenset(bytes(r.term) for r in wanted.toLocalIterator()) if few else None
    texts = docs.select(F.col("text").cast("string").cast("binary").alias("text"),
                        F.col("doc_id").cast("long").alias("doc_id"))
    return written(texts.mapInArrow(_postings(vocabulary), "doc_id long, n long, terms array<binary>, tfs array<long>"),
                   "postings")


class _Lists:
    """A chunk's posting lists by term, with their bounds per block of documents."""

    def __init__(self, chunk: pa.Table, terms: pa.Array, weights: np.ndarray, total_n: int, total_l: int):
        lists = chunk["terms"].combine_chunks()
        self.n_docs = len(lists)
        counts = np.asarray(pc.list_value_length(lists), np.int64)
        doc = np.repeat(np.arange(self.n_docs), counts)
        tf = np.asarray(pc.list_flatten(chunk["tfs"].combine_chunks()), np.int64)
        m = 50 + 50 * np.asarray(chunk["n"], np.int64) * total_n // total_l
        term = np.asarray(pc.fill_null(pc.index_in(pc.list_flatten(lists), value_set=terms), -1), np.int64)
        own = np.flatnonzero(term >= 0)
        own = own[np.argsort(term[own], kind="stable")]
        term, self.doc, tf = term[own], doc[own], tf[own]
        self.score = weights[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[self.doc]))
        self.first = np.searchsorted(term, np.arange(len(terms) + 1))
        self.blocks = -(-self.n_docs // BLOCK)
        self._bounds: dict[int, np.ndarray] = {}

    def size(self, term: int) -> int:
        return int(self.first[term + 1] - self.first[term])

    def of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.first[term], self.first[term + 1])
        return self.doc[part], self.score[part]

    def bounds(self, docs: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """The largest score in each block."""
        out = np.zeros(self.blocks, np.int64)
        if len(docs):
            at = docs // BLOCK
            first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            out[at[first]] = np.maximum.reduceat(scores, first)
        return out

    def bounds_of(self, term: int) -> np.ndarray:
        if term not in self._bounds:
            self._bounds[term] = self.bounds(*self.of(term))
        return self._bounds[term]


def _accumulated(lists: _Lists, terms: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Short lists summed to one, by document (term at a time)."""
    docs = np.concatenate([lists.of(t)[0] for t in terms])
    scores = np.concatenate([lists.of(t)[1] for t in terms])
    order = np.argsort(docs, kind="stable")
    docs, scores = docs[order], scores[order]
    first = np.flatnonzero(np.concatenate(([True], docs[1:] != docs[:-1])))
    return docs[first], np.add.reduceat(scores, first)


class _Top:
    """A query's best documents so far: score, doc_id, whether it is null."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.doc, self.none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    @property
    def least(self) -> int:
        """Scores below it have no place (equal ones may, by their doc_id)."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, doc: np.ndarray, none: np.ndarray) -> None:
        score, doc, none = (np.concatenate(x) for x in ((self.score, score), (self.doc, doc), (self.none, none)))
        best = np.lexsort((doc, none, -score))[:self.k]
        self.score, self.doc, self.none = score[best], doc[best], none[best]


def _rank(lists: _Lists, terms: list[int], ids: np.ndarray, none: np.ndarray, top: _Top) -> None:
    """Document-at-a-time over the long lists and the accumulated short ones."""
    terms = [t for t in terms if lists.size(t)]
    short = [t for t in terms if lists.size(t) <= SHORT]
    runs = [(*lists.of(t), lists.bounds_of(t)) for t in terms if lists.size(t) > SHORT]
    if short:
        summed = _accumulated(lists, short)
        runs.append((*summed, lists.bounds(*summed)))
    if not runs:
        return
    bound = np.sum([b for _, _, b in runs], axis=0)
    for block in range(0, lists.blocks, STEP // BLOCK):
        until = min(block + STEP // BLOCK, lists.blocks)
        least = top.least
        if bound[block:until].max() < least:
            continue
        live = bound[block:until] >= least
        # The part of each list in this step, weakest first: strong ones give the candidates.
        parts = []
        for docs, scores, bounds in runs:
            a, b = np.searchsorted(docs, (block * BLOCK, until * BLOCK))
            if a < b:
                parts.append((int(bounds[block:until][live].max()), docs[a:b], scores[a:b]))
        parts.sort(key=lambda p: p[0])
        reach = np.cumsum([p[0] for p in parts])
        strong = int(np.searchsorted(reach, least))
        found = np.unique(np.concatenate([docs for _, docs, _ in parts[strong:]] or [np.empty(0, np.int64)]))
        found = found[live[found // BLOCK - block]]
        got = np.zeros(len(found), np.int64)
        for i in range(len(parts) - 1, -1, -1):
            if i < strong:  # what the lists up to this one can add decides who stays
                stay = got + reach[i] >= least
                found, got = found[stay], got[stay]
            if not len(found):
                break
            _, docs, scores = parts[i]
            at = np.minimum(np.searchsorted(docs, found), len(docs) - 1)
            got = got + np.where(docs[at] == found, scores[at], 0)
        good = got >= least
        if good.any():
            top.add(got[good], ids[found[good]], none[found[good]])


def _ranked(queries: list[tuple[int | None, list[tuple[int, int]]]], terms: list[bytes], total_n: int, total_l: int, k: int):
    """Streams (doc_id, n, terms, tfs) to each query's best documents of the task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(terms, pa.binary())
        # A term has one weight in all queries.
        weights = np.zeros(len(terms), np.int64)
        for _, pairs in queries:
            for t, w in pairs:
                weights[t] = w
        tops = [_Top(k) for _ in queries]

        def rank(chunk: pa.Table) -> None:
            ids = chunk["doc_id"].combine_chunks()
            none = np.asarray(pc.is_null(ids))
            plain = np.asarray(pc.fill_null(ids, 0), np.int64)
            lists = _Lists(chunk, known, weights, total_n, total_l)
            for (_, pairs), top in zip(queries, tops):
                _rank(lists, [t for t, _ in pairs], plain, none, top)

        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                held.append(part)
                size += len(pc.list_flatten(part.column("terms")))
                if size >= CHUNK:
                    rank(pa.Table.from_batches(held))
                    held, size = [], 0
        if held:
            rank(pa.Table.from_batches(held))
        for (item, _), top in zip(queries, tops):
            if len(top.score):
                yield pa.record_batch({
                    "item_id": pa.array([item] * len(top.score), pa.int64()),
                    "doc_id": pa.array(top.doc, mask=top.none), "score": pa.array(top.score)})

    return run


def _best(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each query, highest first, ties by ``doc_id``."""
    asked = materialize(query_terms(items))
    index = indexed(docs, asked)
    total_n, total_l = index.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    found_in = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(F.log((F.lit(2.0) * total_n + 2.0) / (F.col("df") * 2.0 + 1.0)) * 1000.0).cast("long")
    weighed = materialize(asked.join(found_in, "term").select("item_id", "term", weight.alias("w")).filter("w > 0"))
    rows = weighed.count()
    passes = max(1, -(-rows // QUERY_TERMS))
    out = None
    for i in range(passes):
        part = weighed.filter(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == i).orderBy("item_id", "term")
        numbers: dict[bytes, int] = {}
        queries: dict[int | None, list[tuple[int, int]]] = {}
        for r in part.toLocalIterator():
            queries.setdefault(r.item_id, []).append((numbers.setdefault(bytes(r.term), len(numbers)), r.w))
        tops = (index.filter(F.size("terms") > 0)
                .mapInArrow(_ranked(list(queries.items()), list(numbers), total_n, max(1, total_l), k),
                            "item_id long, doc_id long, score long")
                .withColumn("_part", F.spark_partition_id() % PARTS))
        out = tops if out is None else out.unionByName(tops)
    first = _best(out, ["item_id", "_part"], k).drop("rank")
    return _best(first, ["item_id"], k).select("item_id", "rank", "doc_id", "score")
