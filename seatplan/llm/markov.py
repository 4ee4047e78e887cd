"""LM scoring by a hidden Markov model over words, trained by Baum-Welch.

Tokens are the words ``[^\\x20\\x09-\\x0D]+`` of the lower-cased (A-Z) text, then
one end of text.  The words that training documents use most often (up to
``FREQUENT``) are emitted by the hidden states as they are.  Every other word is
emitted as one of ``CLASSES`` word classes, by the CRC of its last three bytes,
and drawn from that class by its own count: ``(c + 0.1) / (C + 0.1 (W + 1))``, with
the class's count C and its distinct words W; a word that training never saw
is the class's one unseen word.  That factor does not depend on the state, so
a text's probability is the forward recursion over frequent words and classes
times the factors of its rarer words.

1. Words are counted over all training texts, combined in the tasks first.
2. Frequent words (bounded in number and length) go to the tasks, which write
   every text as a row of 16-bit numbers, and its rarer words with their counts.
3. Baum-Welch: every round, all training texts pass through the scaled forward
   and backward recursions in stretches of ``STRETCH`` tokens; the tasks' expected
   counts are summed per emitted word.  The states start from a bounded sample of
   texts that differ most; every count after that covers all training tokens.
4. Scores: the forward recursion over whole texts, many side by side.  A very
   long text is cut into segments whose transfer matrices are computed side
   by side and multiplied in order, which is the same recursion.
5. Rarer words meet their counts in a join; a word too rare for the frequent
   list cannot be a hot key there.

Defined results: a null text is empty, and has its end as its only token; a
document with a null ``doc_id`` is held out; rows that repeat a ``doc_id`` are
texts of their own; without training tokens every word is unseen (base scores
are 0); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatplan.plans.lineage import written

STATES, ROUNDS = 12, 8
#: Training ends when a round has raised the log likelihood per token (natural) by less.
LEAST_GAIN = 0.01
FREQUENT, CLASSES = 32_000, 1024
#: Added to every count, as in the base score.
ADDED = 0.1
#: Weight of the words' overall shares in every state, in tokens.
PRIOR = 100.0
#: Longer words are known by their SHA-256 (after a space, which no word holds).
LONG_WORD = 64
#: Tokens of a training stretch, stretches side by side.
STRETCH, SIDE = 256, 1024
#: Texts scored side by side, by their tokens; longer texts than ``WHOLE`` go by segments.
POOL, WHOLE, SEGMENT = 2_000_000, 16_384, 256
#: Texts and tokens of each that the states start from.
START_TEXTS, START_TOKENS = 256, 4096
END = b""


def _key(word: bytes) -> bytes:
    return word if len(word) <= LONG_WORD else b" " + hashlib.sha256(word).hexdigest().encode()


def _class(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % CLASSES


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(True))


def _texts(docs: DataFrame) -> DataFrame:
    doc_id = F.col("doc_id").cast("long")
    return docs.select(F.col("text").cast("string").cast("binary").alias("text"), doc_id.alias("doc_id"),
                       held_out(doc_id).alias("held_out"))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) to partial (word, class, c)."""
    held: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        long = {w for w in held if len(w) > LONG_WORD}
        return pa.record_batch({
            "word": pa.array([_key(w) if w in long else w for w in held], pa.binary()),
            "class": pa.array([_class(w) if w else -1 for w in held], pa.int32()),
            "c": pa.array(held.values(), pa.int64())})

    for batch in batches:
        for text in batch.column(0):
            held.update((text.as_py() or b"").lower().split())
            held[END] += 1
            if len(held) > 300_000:
                yield out()
                held.clear()
    if held:
        yield out()


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, class, c) over ``texts``, written; the end is the empty word, of class -1."""
    partial = texts.mapInArrow(_count, "word binary, class int, c long")
    return written(partial.groupBy("word").agg(F.first("class").alias("class"), F.sum("c").alias("c")), "word-counts")


@dataclass
class Vocabulary:
    """What tasks know of the counts: frequent words, sums of the classes, totals."""

    words: list[bytes]          # emitted as they are; the first is the end
    counts: np.ndarray          # their counts
    class_counts: np.ndarray    # per class, count of its words that are not frequent
    class_words: np.ndarray     # and how many there are
    n: int                      # training tokens
    v: int                      # distinct ones

    @property
    def base_total(self) -> float:
        return self.n + ADDED * (self.v + 1)

    @property
    def class_totals(self) -> np.ndarray:
        return self.class_counts + ADDED * (self.class_words + 1)

    def shares(self) -> np.ndarray:
        """Overall share of every emitted word or class."""
        p = np.concatenate((self.counts + ADDED, self.class_totals))
        return p / p.sum()


def vocabulary(counts: DataFrame, frequent: int = FREQUENT) -> Vocabulary:
    """The frequent words are those with at least some count, chosen from the
    histogram of counts (64 steps a power of two) so that they are ``frequent`` at most."""
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    words = counts.filter("class >= 0").withColumn("step", F.floor(F.log2("c") * 64).cast("int"))
    least, total = None, 0
    for step, size in sorted(((r.step, r["count"]) for r in words.groupBy("step").count().collect()), reverse=True):
        total += size
        if total > frequent:
            break
        least = step
    often = F.lit(False) if least is None else F.col("step") >= least
    chosen = sorted(((bytes(r.word), r.c) for r in words.filter(often).select("word", "c").collect()),
                    key=lambda x: (-x[1], x[0]))
    ends = counts.filter("class < 0").select("c").collect()
    class_counts, class_words = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in words.filter(~often).groupBy("class").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("w")).collect():
        class_counts[r["class"]], class_words[r["class"]] = r.c, r.w
    return Vocabulary([END] + [w for w, _ in chosen], np.array([ends[0].c if ends else 0] + [c for _, c in chosen], float),
                      class_counts, class_words, n, v)


def _encode(words: list[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = {w: i for i, w in enumerate(words)}
        n = len(numbers)
        for batch in batches:
            ids, sizes, rare, times = [], [], [], []
            for text in batch.column(0):
                tokens = (text.as_py() or b"").lower().split()
                seq = np.fromiter(map(numbers.get, tokens, repeat(n)), np.uint16, len(tokens))
                at = np.flatnonzero(seq == n)
                others = [tokens[i] for i in at.tolist()]
                found = Counter(others)
                # A long word may be frequent under its digest.
                number = {w: numbers.get(_key(w), n + _class(w)) if len(w) > LONG_WORD else n + _class(w) for w in found}
                seq[at] = np.fromiter(map(number.__getitem__, others), np.uint16, len(others))
                ids.append(np.append(seq, np.uint16(0)).astype("<u2").tobytes())
                kept = [w for w in found if number[w] >= n]
                sizes.append(len(kept))
                rare.extend(_key(w) if len(w) > LONG_WORD else w for w in kept)
                times.extend(map(found.__getitem__, kept))
            ends = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
            yield pa.record_batch({
                "doc_id": batch.column(1), "held_out": batch.column(2), "ids": pa.array(ids, pa.binary()),
                "rare": pa.ListArray.from_arrays(ends, pa.array(rare, pa.binary())),
                "times": pa.ListArray.from_arrays(ends, pa.array(times, pa.int64()))})

    return run


def encoded(texts: DataFrame, vocab: Vocabulary) -> DataFrame:
    """(row, doc_id, held_out, ids, rare, times) of every text, written: numbers of
    its tokens as 16-bit integers, and its words that are not frequent with their counts."""
    rows = texts.mapInArrow(_encode(vocab.words), "doc_id long, held_out boolean, ids binary, "
                                                  "rare array<binary>, times array<long>")
    return written(rows.withColumn("row", F.monotonically_increasing_id()), "token-numbers")


@dataclass
class Model:
    start: np.ndarray   # (states)
    move: np.ndarray    # (states, states), rows sum to 1
    emit: np.ndarray    # (words and classes, states), columns sum to 1


def first_model(sample: list[np.ndarray], shares: np.ndarray, states: int) -> Model:
    """States start as groups of ``sample`` texts: those farthest from each other, and the ones nearest to them."""
    emit = np.repeat(shares[:, None], states, 1)
    if sample:
        seen = np.array([np.bincount(s, minlength=len(shares)) for s in sample], np.float32)
        unit = np.sqrt(seen)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        like = unit @ unit.T
        chosen = [0]
        while len(chosen) < min(states, len(sample)):
            chosen.append(int(np.argmin(like[:, chosen].max(1))))
        own = np.argmax(like[:, chosen], axis=1)
        for k in range(len(chosen)):
            group = seen[own == k].sum(0, dtype=np.float64)
            emit[:, k] = (group / max(1.0, group.sum()) + shares) / 2
    move = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    return Model(np.full(states, 1 / states), move, emit)


def _expected(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, model: Model,
              emitted: np.ndarray, moved: np.ndarray, started: np.ndarray) -> float:
    """Adds the stretches' expected counts; returns their log likelihood.

    Stretches are sorted, longest first, so that those with a token at step t are
    the first ones; all values lie step by step, and are computed in the type of
    the model's numbers.
    """
    states, most = len(model.start), int(sizes[0])
    active = np.searchsorted(-sizes, -np.arange(1, most + 1), side="right").tolist()
    at = np.concatenate(([0], np.cumsum(active))).tolist()
    number = np.concatenate([flat[starts[:n] + t] for t, n in enumerate(active)])
    seen = model.emit.take(number, axis=0)
    ahead, scale = np.empty_like(seen), np.empty(len(seen), seen.dtype)
    ones, back = np.ones(states, seen.dtype), np.ascontiguousarray(model.move.T)
    for t, n in enumerate(active):
        a = ahead[at[t]:at[t] + n]
        if t:
            np.matmul(ahead[at[t - 1]:at[t - 1] + n], model.move, out=a)
        else:
            a[:] = model.start
        a *= seen[at[t]:at[t] + n]
        c = a @ ones
        scale[at[t]:at[t] + n] = c
        a *= (1 / c)[:, None]
    total = float(np.log(scale, dtype=np.float64).sum())
    seen *= (1 / scale)[:, None]
    behind = np.ones((len(sizes), states), seen.dtype)  # rows that end at a step still have 1 there
    for t in range(most - 1, -1, -1):
        a = ahead[at[t]:at[t + 1]]
        if t + 1 < most:
            m = active[t + 1]
            b = seen[at[t + 1]:at[t + 2]]
            b *= behind[:m]
            moved += a[:m].T @ b
            np.matmul(b, back, out=behind[:m])
        a *= behind[:active[t]]  # from here on the states' shares
    started += ahead[:active[0]].sum(0)
    order = np.argsort(number, kind="stable")
    held, first = np.unique(number[order], return_index=True)
    emitted[held] += np.add.reduceat(ahead.take(order, axis=0), first, axis=0)
    return total


def _baum_welch(model: Model):
    """(ids) to the task's expected counts: per emitted number a row of its counts by state;
    number -1 - k holds moves from state k (over those to it), -1 - states the starts, -2 - states (log likelihood, tokens)."""
    states, short = len(model.start), Model(*(x.astype(np.float32) for x in (model.start, model.move, model.emit)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emitted, moved, started = np.zeros(short.emit.shape), np.zeros((states, states)), np.zeros(states)
        likelihood, tokens = 0.0, 0
        held: list[np.ndarray] = []

        def learn() -> None:
            nonlocal likelihood, tokens
            held.sort(key=len, reverse=True)
            sizes = np.array([len(s) for s in held])
            flat = np.concatenate(held)
            likelihood += _expected(flat, np.cumsum(sizes) - sizes, sizes, short, emitted, moved, started)
            tokens += len(flat)
            held.clear()

        for batch in batches:
            for ids in batch.column(0):
                seq = np.frombuffer(ids.as_py(), "<u2")
                for at in range(0, len(seq), STRETCH):
                    held.append(seq[at:at + STRETCH])
                    if len(held) == SIDE:
                        learn()
        if held:
            learn()
        if tokens:
            used = np.flatnonzero(emitted.any(1))
            last = np.zeros(states)
            last[:2] = likelihood, tokens
            number = np.concatenate((used, -1 - np.arange(states + 2)))
            values = np.concatenate((emitted[used], moved * short.move, started[None], last[None]))
            yield pa.record_batch({"number": pa.array(number.astype(np.int32)),
                                   **{f"s{k}": pa.array(values[:, k]) for k in range(states)}})

    return run


def trained(texts: DataFrame, vocab: Vocabulary, states: int = STATES, rounds: int = ROUNDS) -> tuple[Model, list[float]]:
    """Baum-Welch over the training rows of :func:`encoded`, up to ``rounds`` rounds
    or until they gain little; also the log likelihood per token before each round."""
    learning = texts.filter(~F.col("held_out"))
    # About four times as many by hash, so that no task has to order a share of the table.
    one_in = max(1, int(vocab.counts[0]) // (4 * START_TEXTS))
    sample = (learning.filter(F.pmod(F.xxhash64("row"), F.lit(one_in)) == 0)
              .select(F.substring("ids", 1, 2 * START_TOKENS).alias("ids"), "row")
              .orderBy(F.xxhash64("row"), "row").limit(START_TEXTS).collect())
    shares = vocab.shares()
    model = first_model([np.frombuffer(bytes(r.ids), "<u2").astype(np.int64) for r in sample], shares, states)
    columns = [f"s{k}" for k in range(states)]
    seen = []
    for _ in range(rounds):
        found = (learning.select("ids").mapInArrow(_baum_welch(model), "number int, " + ", ".join(f"{c} double" for c in columns))
                 .groupBy("number").agg(*[F.sum(c).alias(c) for c in columns]).toArrow())
        number = found["number"].to_numpy()
        values = np.stack([found[c].to_numpy() for c in columns], 1) if len(number) else np.empty((0, states))
        emitted, moved, started = PRIOR * np.repeat(shares[:, None], states, 1), np.ones((states, states)), np.ones(states)
        emitted[number[number >= 0]] += values[number >= 0]
        for i in np.flatnonzero(number < 0):
            k = -1 - number[i]
            if k < states:
                moved[k] += values[i]
            elif k == states:
                started += values[i]
            else:
                seen.append(float(values[i][0] / values[i][1]))
        model = Model(started / started.sum(), moved / moved.sum(1, keepdims=True), emitted / emitted.sum(0))
        if len(seen) > 1 and seen[-1] - seen[-2] < LEAST_GAIN:
            break
    return model, seen


def _forward(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, prior: np.ndarray, model: Model):
    """Scaled forward recursion of sequences side by side, longest first, each
    with its own distribution of first states: (last states, log of the scale)."""
    now, log, ones = prior.copy(), np.zeros(len(sizes)), np.ones(len(model.start))
    active = np.searchsorted(-sizes, -np.arange(1, int(sizes[0]) + 1), side="right")
    for t, n in enumerate(active.tolist()):
        a = now[:n] @ model.move if t else now[:n]
        a *= model.emit.take(flat[starts[:n] + t], axis=0)
        c = a @ ones
        np.multiply(a, (1 / c)[:, None], out=now[:n])
        log[:n] += np.log(c)
    return now, log


def _forward_long(seq: np.ndarray, model: Model, at_once: int = 512) -> float:
    """The same for one long sequence: segments from every state side by side, then multiplied in order."""
    states = len(model.start)
    now, log = _forward(seq[:SEGMENT], np.zeros(1, np.int64), np.array([min(SEGMENT, len(seq))]), model.start[None], model)
    now, total = now[0], float(log[0])
    for begin in range(SEGMENT, len(seq), SEGMENT * at_once):
        starts = np.arange(begin, min(len(seq), begin + SEGMENT * at_once), SEGMENT)
        sizes = np.minimum(SEGMENT, len(seq) - starts)
        last, scale = _forward(seq, np.repeat(starts, states), np.repeat(sizes, states),
                               np.tile(model.move, (len(starts), 1)), model)
        last, scale = last.reshape(-1, states, states), scale.reshape(-1, states)
        for part, s in zip(last, scale):
            top = s.max()
            now = (now * np.exp(s - top)) @ part
            c = now.sum()
            now, total = now / c, total + float(np.log(c)) + float(top)
    return total


def _score(model: Model, vocab: Vocabulary):
    """(row, doc_id, held_out, ids) to what the frequent words and the classes give."""
    n_words = len(vocab.words)
    # What a token adds to the base score, and to the score beside the recursion; rarer words add log10(c + ADDED) later.
    base = np.concatenate((np.log10(vocab.counts + ADDED), np.zeros(CLASSES))) - np.log10(vocab.base_total)
    beside = np.concatenate((np.zeros(n_words), -np.log10(vocab.class_totals)))
    known = np.concatenate((vocab.counts > 0, np.zeros(CLASSES, bool)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def scored(group: list[tuple], seqs: list[np.ndarray]) -> pa.RecordBatch:
            log = np.zeros(len(seqs))
            whole = [i for i, s in enumerate(seqs) if len(s) <= WHOLE]
            whole.sort(key=lambda i: -len(seqs[i]))
            if whole:
                sizes = np.array([len(seqs[i]) for i in whole])
                flat = np.concatenate([seqs[i] for i in whole])
                prior = np.repeat(model.start[None], len(whole), 0)
                log[whole] = _forward(flat, np.cumsum(sizes) - sizes, sizes, prior, model)[1]
            for i, s in enumerate(seqs):
                if len(s) > WHOLE:
                    log[i] = _forward_long(s, model)
            rows, ids, out = zip(*group)
            return pa.record_batch({
                "row": pa.array(rows, pa.int64()), "doc_id": pa.array(ids, pa.int64()), "held_out": pa.array(out, pa.bool_()),
                "n_tokens": pa.array([len(s) for s in seqs], pa.int64()),
                "known": pa.array([int(known[s].sum()) for s in seqs], pa.int64()),
                "base": pa.array([float(base[s].sum()) for s in seqs]),
                "states": pa.array(log / np.log(10) + [float(beside[s].sum()) for s in seqs])})

        group, seqs, size = [], [], 0
        for batch in batches:
            for row, doc_id, out, ids in zip(*(batch.column(i) for i in range(4))):
                group.append((row.as_py(), doc_id.as_py(), out.as_py()))
                seqs.append(np.frombuffer(ids.as_py(), "<u2").astype(np.int64))
                size += len(seqs[-1])
                if size >= POOL:
                    yield scored(group, seqs)
                    group, seqs, size = [], [], 0
        if group:
            yield scored(group, seqs)

    return run


def score_texts(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS, frequent: int = FREQUENT) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    if frequent + 1 + CLASSES > 1 << 16:
        raise ValueError("token numbers have 16 bits")
    texts = _texts(docs)
    counts = word_counts(texts.filter(~F.col("held_out")).select("text"))
    vocab = vocabulary(counts, frequent)
    numbers = encoded(texts, vocab)
    model, _ = trained(numbers, vocab, states, rounds)
    scored = numbers.select("row", "doc_id", "held_out", "ids").mapInArrow(
        _score(model, vocab),
        "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, states double")
    each = numbers.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select(
        "row", F.col("w.rare").alias("word"), F.col("w.times").alias("times"))
    c = F.coalesce("c", F.lit(0))
    rare = (each.join(counts.select("word", "c"), "word", "left").groupBy("row")
            .agg(F.sum(F.col("times") * F.log10(c + ADDED)).alias("logs"),
                 F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("seen")))
    logs = F.coalesce("logs", F.lit(0.0))
    return scored.join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("seen", F.lit(0))).alias("n_known"),
        F.lit(vocab.n).cast("long").alias("train_tokens"), (F.col("base") + logs).alias("base_score"),
        (F.col("states") + logs).alias("score"))
