"""Language identification by rank-order profiles of character n-grams.

A profile is the ``PROFILE`` most frequent n-grams (n = 1 to 3, over
lower-cased words of letters and marks, with word-edge marks) in order of
frequency.  A document goes to the language whose profile has the smallest
out-of-place distance: the sum, over the document's profile, of how far each
n-gram's rank is from its rank in the language's profile (``PROFILE`` if it is
not there).  Profiles are learned from counts over all training documents,
summed with map-side combine.

Defined results: null text, or text without a letter, is ``und`` with score
0; so is every text when nothing can be learned.  A document with a null id
is held out.  Equal counts rank by n-gram code, equal distances go to the
first language by code point.  Repeated rows are predicted alike; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: N-grams in a profile.
PROFILE = 300
#: Profiles travel to the tasks; more languages than this raise an error.
MAX_LANGUAGES = 2000
EDGE = 0x1FFFFF  # marks a word edge; above every code point
UND = "und"
_CHUNK = 2_000_000  # characters handled at once


@functools.cache
def _classes() -> np.ndarray:
    """Per code point: 2 for letters, 1 for marks, 0 for all else."""
    kinds = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LM":
            kinds[c] = 2 if kind == "L" else 1
    return kinds


def _symbols(text: str) -> np.ndarray:
    """Letters and marks as code points, every other run as one EDGE, EDGE at both ends."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _classes()[points]
    if not (kinds == 2).any():
        return np.empty(0, np.int64)
    inside = kinds > 0
    keep = inside.copy()
    keep[1:] |= inside[:-1]  # the first character after a word stands for the edge
    out = np.where(inside, points, EDGE)[keep].astype(np.int64)
    if out[0] != EDGE:
        out = np.concatenate(([EDGE], out))
    return out if out[-1] == EDGE else np.append(out, EDGE)


def _ngram_codes(sym: np.ndarray, edge: int, bits: int) -> np.ndarray:
    """Codes of all 1-, 2- and 3-grams that don't reach over a word edge.

    A code holds the symbols in ``bits`` each; the last symbol is never 0, so
    shorter n-grams don't meet longer ones.
    """
    at_edge = sym == edge
    one = sym[~at_edge]
    two = (sym[:-1] << bits | sym[1:])[~(at_edge[:-1] & at_edge[1:])]
    if len(sym) < 3:
        return np.concatenate((one, two))
    three = sym[:-2] << (2 * bits) | sym[1:-1] << bits | sym[2:]
    return np.concatenate((one, two, three[~at_edge[1:-1]]))


class _Alphabet:
    """Dense symbol numbers for the texts of one chunk, so that codes are short and sort fast."""

    def __init__(self, parts: list[np.ndarray]):
        present = np.zeros(EDGE + 1, bool)
        for p in parts:
            present[p] = True
        self.points = np.concatenate(([0], np.flatnonzero(present)))  # 0 stands for "no symbol"
        self.number = np.zeros(EDGE + 1, np.int64)
        self.number[self.points] = np.arange(len(self.points))
        self.bits = int(len(self.points)).bit_length()
        self.edge = int(self.number[EDGE])
        self.kind = np.uint32 if 3 * self.bits <= 32 else np.int64

    def codes(self, sym: np.ndarray) -> np.ndarray:
        return _ngram_codes(self.number[sym], self.edge, self.bits).astype(self.kind)

    def wide(self, codes: np.ndarray) -> np.ndarray:
        """Codes of 21 bits a symbol, the same for every chunk."""
        c, mask = codes.astype(np.int64), (1 << self.bits) - 1
        p = self.points
        return p[c >> 2 * self.bits] << 42 | p[c >> self.bits & mask] << 21 | p[c & mask]


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(index of the first text, symbols of texts) for runs of texts of bounded size."""
    start, parts, n = 0, [], 0
    for i, t in enumerate(texts):
        parts.append(_symbols(t) if t else np.empty(0, np.int64))
        n += len(parts[-1])
        if n >= _CHUNK:
            yield start, parts
            start, parts, n = i + 1, [], 0
    if parts:
        yield start, parts


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to partial (lang, gram, n)."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def merged():
        for lang, pairs in held.items():
            grams, where = np.unique(np.concatenate([g for g, _ in pairs]), return_inverse=True)
            counts = np.bincount(where, np.concatenate([c for _, c in pairs])).astype(np.int64)
            yield lang, grams, counts

    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for start, parts in _chunks(texts):
            alphabet = _Alphabet(parts)
            by_lang: dict[str, list[np.ndarray]] = {}
            for i, sym in enumerate(parts):
                if len(sym):
                    by_lang.setdefault(langs[start + i], []).append(sym)
            for lang, syms in by_lang.items():
                codes, counts = np.unique(alphabet.codes(np.concatenate(syms)), return_counts=True)
                held.setdefault(lang, []).append((alphabet.wide(codes), counts))
                size += len(codes)
        if size > 2_000_000:
            held = {lang: [(g, c)] for lang, g, c in merged()}
            if (size := sum(len(p[0][0]) for p in held.values())) > 1_000_000:
                yield from (_gram_batch(*x) for x in merged())
                held, size = {}, 0
    yield from (_gram_batch(*x) for x in merged())


def _gram_batch(lang: str, grams: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch({"lang": pa.array([lang] * len(grams), pa.string()),
                            "gram": pa.array(grams, pa.int64()), "n": pa.array(counts, pa.int64())})


def learn_profiles(labelled: DataFrame, size: int = PROFILE) -> DataFrame:
    """(lang, gram, rank from 0): the most frequent n-grams of each language in ``labelled`` (lang, text)."""
    counted = (labelled.select(F.col("lang").cast("string"), F.col("text").cast("string"))
               .mapInArrow(_count_batches, "lang string, gram long, n long")
               .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
               .withColumn("_salt", F.pmod(F.xxhash64("gram"), F.lit(16))))
    order = (F.col("n").desc(), F.col("gram"))
    first = counted.withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order)))
    return (first.filter(F.col("_r") <= size)
            .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)) - 1)
            .filter(F.col("rank") < size).select("lang", "gram", "rank"))


def _predictor(profiles: list[tuple[str, int, int]], size: int):
    langs = sorted({p[0] for p in profiles})
    place = {lang: i for i, lang in enumerate(langs)}
    rows = sorted((g, place[lang], r) for lang, g, r in profiles)
    grams, owners, ranks = (np.array(x, np.int64) for x in zip(*rows)) if rows else [np.empty(0, np.int64)] * 3
    known, first, often = np.unique(grams, return_index=True, return_counts=True)

    def distances(top: np.ndarray) -> np.ndarray:
        """Out-of-place distance of a profile (codes by rank) to every language."""
        at = np.minimum(np.searchsorted(known, top), len(known) - 1)
        hit = np.flatnonzero(known[at] == top)
        n = often[at[hit]]
        mine = np.repeat(hit, n)
        entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[at[hit]], n)
        saved = size - np.minimum(np.abs(ranks[entry] - mine), size)
        return size * len(top) - np.bincount(owners[entry], saved, len(langs))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            pred, score = [UND] * len(texts), np.zeros(len(texts))
            for start, parts in _chunks(texts):
                alphabet = _Alphabet(parts)
                for i, sym in enumerate(parts):
                    if len(sym) and langs:
                        codes, counts = np.unique(alphabet.codes(sym), return_counts=True)
                        # Codes ascend by code point, so ties of counts rank by n-gram.
                        top = alphabet.wide(codes[np.argsort(-counts, kind="stable")[:size]])
                        d = distances(top)
                        best = int(d.argmin())
                        pred[start + i] = langs[best]
                        score[start + i] = 1 - d[best] / (size * len(top))
            rest = {f.name: batch.column(i) for i, f in enumerate(batch.schema) if i}
            yield pa.record_batch(rest | {"lang_pred": pa.array(pred, pa.string()), "score": pa.array(score)})

    return predict


def identify(texts: DataFrame, labelled: DataFrame, size: int = PROFILE) -> DataFrame:
    """``texts`` without its first column, the text, plus ``lang_pred`` and ``score``.

    ``labelled`` holds (lang, text) to learn from; languages are few
    (``MAX_LANGUAGES`` at most), so their profiles go to every task.
    """
    return _identify(texts, _collected(labelled, size), size)


def _collected(labelled: DataFrame, size: int) -> list:
    profiles = learn_profiles(labelled, size).limit(MAX_LANGUAGES * size + 1).collect()
    if len(profiles) > MAX_LANGUAGES * size:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return profiles


def _identify(texts: DataFrame, profiles: list, size: int) -> DataFrame:
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields[1:])
    schema = (kept + ", " if kept else "") + "lang_pred string, score double"
    return texts.mapInArrow(_predictor([tuple(p) for p in profiles], size), schema)


def held_out(doc_id):
    """True for the fifth of the ids that is never learned from (and for null ids)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull()).select("lang", "text")


def predict_documents(docs: DataFrame, size: int = PROFILE) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (needs doc_id, text, lang)."""
    rows = docs.select(F.col("text").cast("string"), "doc_id", held_out(F.col("doc_id")).alias("held_out"))
    return identify(rows, training_rows(docs), size)


#: Below this score a text has hardly an n-gram in common with any language learned.
MIN_SCORE = 0.1


def keep_known(docs: DataFrame, size: int = PROFILE) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is known: not ``und``
    and scored ``MIN_SCORE`` or more.  Where no language can be learned, every
    text with a letter stays."""
    profiles = _collected(training_rows(docs), size)
    if not profiles:
        return docs.filter(F.col("text").cast("string").rlike(r"\p{L}"))
    rows = docs.select(F.col("text").cast("string"), F.struct("*").alias("_doc"))
    return (_identify(rows, profiles, size)
            .filter((F.col("lang_pred") != UND) & (F.col("score") >= MIN_SCORE)).select("_doc.*"))
