"""The hidden Markov model against plain recursions, ranked search and the conversation trie against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from seatplan.llm import conversation_trie, lexical, markov

ODD_TEXTS = ["", None, " \t\n", "one", "Ünïcode WÖRDS é", "a" * 5000, "x " * 3000, "same text here", "same text here", "end\x00of\x0bline"]


# ---------------------------------------------------------------- hidden Markov model
def plain_forward(seq, model):
    now, log = None, 0.0
    for o in seq:
        now = model.start * model.emit[o] if now is None else (now @ model.move) * model.emit[o]
        log += math.log(now.sum())
        now = now / now.sum()
    return log


def random_model(rnd, n, states):
    def rows(*shape):
        x = rnd.random(shape) + .01
        return x / x.sum(-1, keepdims=True)
    return markov.Model(rows(states), rows(states, states), rows(states, n).T.copy())


def test_forward_recursions():
    rnd = np.random.default_rng(1)
    model = random_model(rnd, 20, 4)
    seqs = sorted((rnd.integers(0, 20, n) for n in (1, 5, 5, 70, 700, 2000)), key=len, reverse=True)
    sizes = np.array([len(s) for s in seqs])
    log = markov._forward(np.concatenate(seqs), np.cumsum(sizes) - sizes, sizes, np.repeat(model.start[None], len(seqs), 0), model)[1]
    want = [plain_forward(s, model) for s in seqs]
    assert np.allclose(log, want, rtol=1e-10)
    assert np.allclose([markov._forward_long(s, model, at_once=3) for s in seqs], want, rtol=1e-10)


def test_expected_counts():
    """Baum-Welch counts of a few short sequences against all state paths."""
    import itertools
    rnd = np.random.default_rng(2)
    model = random_model(rnd, 6, 3)
    seqs = sorted((rnd.integers(0, 6, n) for n in (4, 3, 3, 1)), key=len, reverse=True)
    emitted, moved, started, total = np.zeros((6, 3)), np.zeros((3, 3)), np.zeros(3), 0.0
    for seq in seqs:
        paths = {}
        for path in itertools.product(range(3), repeat=len(seq)):
            p = model.start[path[0]] * model.emit[seq[0], path[0]]
            for a, b, o in zip(path, path[1:], seq[1:]):
                p *= model.move[a, b] * model.emit[o, b]
            paths[path] = p
        whole = sum(paths.values())
        total += math.log(whole)
        for path, p in paths.items():
            started[path[0]] += p / whole
            for o, k in zip(seq, path):
                emitted[o, k] += p / whole
            for a, b in zip(path, path[1:]):
                moved[a, b] += p / whole
    e, m, s = np.zeros((6, 3)), np.zeros((3, 3)), np.zeros(3)
    sizes = np.array([len(x) for x in seqs])
    got = markov._expected(np.concatenate(seqs), np.cumsum(sizes) - sizes, sizes, model, e, m, s)
    assert math.isclose(got, total) and np.allclose(e, emitted) and np.allclose(m * model.move, moved) and np.allclose(s, started)


def corpus(rnd, n):
    """Texts of two made-up languages; words of one follow each other."""
    langs = [[f"{a}{b}{i}" for a in p for b in "xyz" for i in range(12)] for p in ("kl", "mn")]
    return [" ".join(rnd.choice(langs[i % 2]) for _ in range(rnd.randrange(1, 80))) for i in range(n)]


def test_scores(docs, monkeypatch):
    monkeypatch.setattr(markov, "WHOLE", 40)  # longer texts go by segments
    monkeypatch.setattr(markov, "SEGMENT", 7)
    rnd = random.Random(4)
    texts = corpus(rnd, 160) + ODD_TEXTS
    table = docs(texts)
    got = {r.doc_id: r for r in markov.score_texts(table, states=3, frequent=50).collect()}
    tokens = [(t or "").encode().lower().split() + [b""] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))]
    c = Counter(w for t, h in zip(tokens, held) if not h for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(tokens):
        base = sum(math.log10((c[w] + .1) / (n + .1 * (v + 1))) for w in t)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.train_tokens, r.n_known) == (held[i], len(t), n, sum(c[w] > 0 for w in t))
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
    assert len(got) == len(texts)
    # What the model gives to held-out texts of several words is well above what the words alone give.
    out = [i for i, t in enumerate(tokens) if held[i] and len(t) > 20 and i < 160]
    assert out and sum(got[i].score - got[i].base_score for i in out) / sum(len(tokens[i]) for i in out) > .1
    # The same scores from the model's parts, by the plain recursion.
    rows = markov._texts(table)
    counts = markov.word_counts(rows.filter("NOT held_out").select("text"))
    vocab = markov.vocabulary(counts, 50)
    assert len(vocab.words) <= 51 and vocab.words[0] == b"" and (vocab.n, vocab.v) == (n, v)
    numbers = markov.encoded(rows, vocab)
    model, seen = markov.trained(numbers, vocab, 3, markov.ROUNDS)
    assert all(b >= a - 1e-6 for a, b in zip(seen, seen[1:]))
    assert np.allclose(model.emit.sum(0), 1) and np.allclose(model.move.sum(1), 1)
    often = {w: i for i, w in enumerate(vocab.words)}
    for i in (0, 7, 30, 161, 165, 166):
        seq = [often.get(w if len(w) <= 64 else markov._key(w), len(often) + markov._class(w)) for w in tokens[i][:-1]] + [0]
        rare = sum(math.log10((c[w] + .1) / vocab.class_totals[o - len(vocab.words)])
                   for w, o in zip(tokens[i], seq) if o >= len(vocab.words))
        assert math.isclose(got[i].score, plain_forward(seq, model) / math.log(10) + rare, rel_tol=1e-6)


def test_probabilities_sum_to_one(docs):
    """Over all known words, the unseen word of every class, and the end."""
    rows = markov._texts(docs(corpus(random.Random(5), 40)))
    counts = markov.word_counts(rows.filter("NOT held_out").select("text"))
    vocab = markov.vocabulary(counts, 20)
    model, _ = markov.trained(markov.encoded(rows, vocab), vocab, 3, 2)
    first = model.emit @ model.start
    n = len(vocab.words)
    total = first[:n].sum()
    often = set(vocab.words)
    for r in counts.collect():
        if bytes(r.word) not in often:
            k = r["class"]
            total += first[n + k] * (r.c + .1) / vocab.class_totals[k]
    total += (first[n:] * .1 / vocab.class_totals).sum()
    assert math.isclose(total, 1, rel_tol=1e-9)


def test_scores_of_awkward_tables(spark, table):
    schema = "doc_id long, text string, row int, base int, word string"
    rows = [(None, "some words", 1, 1, "w"), (None, "some words", 1, 1, "w"), (3, None, None, None, None), (4, "w" * 200 + " w", 1, 1, "")]
    got = markov.score_texts(table(rows, schema), states=2).collect()
    assert len(got) == 4 and [r.held_out for r in got if r.doc_id is None] == [True, True]
    none = markov.score_texts(table(rows[:2], schema), states=2).collect()  # no training rows
    assert [(r.train_tokens, r.n_known, r.base_score) for r in none] == [(0, 0, 0.0)] * 2 and all(math.isfinite(r.score) for r in none)
    assert markov.score_texts(table([], schema), states=2).count() == 0


# ---------------------------------------------------------------- ranked search
def brute_search(texts, items, k):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(i, Counter(term.findall((t or "").translate(low)))) for i, t in texts]
    big_n, big_l = sum(bool(d) for _, d in docs), sum(sum(d.values()) for _, d in docs)
    df = Counter(w for _, d in docs for w in d)
    out = {}
    for item, text in items:
        asked = out.setdefault(item, [set(), None])[0]
        asked.update(term.findall((text or "").translate(low)))
    for item, (asked, _) in out.items():
        scored = []
        for i, d in docs:
            m = 50 + 50 * sum(d.values()) * big_n // max(1, big_l)
            s = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[w] + 1))) * (10**9 * d[w] // (1000 * d[w] + 20 * m))
                    for w in asked if w in d)
            if s > 0:
                scored.append((-s, i is None, i))
        out[item] = [(r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return [(item, *row) for item, rows in out.items() for row in rows]


@pytest.mark.parametrize("chunk,short,block,step,sent", [(1_000_000, 1024, 64, 4096, 500_000), (400, 10, 2, 6, 500_000), (900, 25, 4, 16, 0)])
def test_ranked_search(docs, table, monkeypatch, chunk, short, block, step, sent):
    for name, value in dict(CHUNK=chunk, SHORT=short, BLOCK=block, STEP=step, SENT_TERMS=sent, QUERY_TERMS=40 if sent == 0 else 10**5).items():
        monkeypatch.setattr(lexical, name, value)
    rnd = random.Random(chunk)
    words = [f"w{i}" for i in range(60)] + ["É", "ßa", "x" * 90, "Y" * 90]
    text = lambda: " ".join(words[min(int(rnd.expovariate(.08)), len(words) - 1)] + rnd.choice([" ", "-", ", "]) for _ in range(rnd.randrange(1, 60)))
    texts = [text() for _ in range(150)] + ODD_TEXTS
    items = [(i, text()) for i in range(12)] + [(12, None), (13, "no such term anywhere"), (3, "w5 w6"), (14, "w0"), (15, "x" * 90 + " " + "y" * 90)]
    got = lexical.ranked_search(docs(texts), table(items, "item_id long, text string"), k=7)
    assert sorted(map(tuple, got.collect())) == sorted(brute_search(list(enumerate(texts)), items, 7))


def test_ranked_search_of_awkward_tables(spark, table):
    schema = "doc_id long, text string, terms int, n int, score int, item_id long"
    rows = [(None, "alpha beta", 1, 1, 1, 1), (2, "alpha", 1, 1, 1, 1), (2, "alpha", 1, 1, 1, 1), (3, None, 1, 1, 1, 1),
            (4, "gamma " * 50, 1, 1, 1, 1), (5, "delta", 1, 1, 1, 1), (6, "eps", 1, 1, 1, 1)]
    items = [(1, "alpha beta"), (None, "Gamma")]
    got = lexical.ranked_search(table(rows, schema), table(items, "item_id long, text string")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_search([(r[0], r[1]) for r in rows], items, 50)))
    empty = table([], schema)
    assert lexical.ranked_search(empty, table(items, "item_id long, text string")).count() == 0
    assert lexical.ranked_search(table(rows, schema), table([], "item_id long, text string")).count() == 0


# ---------------------------------------------------------------- conversation trie
def brute_trie(turns, first, group=100):
    convs = {}
    for conv, turn, role, text in turns:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(rows)] for c, rows in convs.items()}
    built = {c: tuple(own.get(c - int(math.fmod(c, group)), [])[:first(c)] + own[c][first(c):]) for c in own}
    nodes = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], []).append(c)
    out = set()
    for node, members in nodes.items():
        d = len(node)
        below = [x for x in nodes if x[:d] == node]
        ends = sorted(c for c in members if len(built[c]) == d)
        leaves = [x for x in below if not any(len(y) == len(x) + 1 and y[:len(x)] == x for y in nodes)]
        saved = sum((len(nodes[x]) - 1) * len(x[-1][1]) for x in below if x)
        out.add((min(members), d, min(nodes[node[:-1]]) if d else None, len(members),
                 sum(len(x) == d + 1 for x in below), len(leaves), saved,
                 hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return out


def crc(c):
    return zlib.crc32(str(c).encode()) % 6


SCHEMA = "conv_id long, turn long, role string, text string"


def test_trie(table, monkeypatch):
    monkeypatch.setattr(conversation_trie, "BLOCK", 3)
    monkeypatch.setattr(conversation_trie, "ID_RANGE", 4)
    monkeypatch.setattr(conversation_trie, "SALTS", 3)
    rnd = random.Random(8)
    turns = []
    for c in [*range(40), 100, 101, 102, 250, 251, -3, -150, 10**12 + 7]:
        for turn in rnd.sample([None, *range(12)], rnd.randrange(1, 9)):
            turns.append((c, turn, rnd.choice(["user", "assistant", None]), rnd.choice(["hi", "", None, "ok é", "long " * 9])))
    turns += turns[:5] + [(None, 1, "user", "hi"), (7, 3, "user", "tie"), (7, 3, "user", "a tie")]
    got = conversation_trie.prefix_trie(table(turns, SCHEMA), conversation_trie.opening_turns())
    assert {tuple(r) for r in got.collect()} == brute_trie(turns, crc)
    plain = conversation_trie.prefix_trie(table(turns, SCHEMA))
    assert {tuple(r) for r in plain.collect()} == brute_trie(turns, lambda c: 0)


def test_trie_of_a_long_chain_and_a_hot_node(table):
    """One conversation of very many turns, one opening that many share."""
    turns = [(1, i, "user", f"turn {i}") for i in range(300)] + [(c, 0, "user", "hello") for c in range(2, 300)]
    turns += [(c, 1, "assistant", f"answer {c % 50}") for c in range(2, 300, 3)]
    got = conversation_trie.prefix_trie(table(turns, SCHEMA))
    assert {tuple(r) for r in got.collect()} == brute_trie(turns, lambda c: 0)


def test_trie_of_awkward_tables(table):
    schema = SCHEMA + ", depth long, points int, h1 long, id string"
    rows = [(5, None, None, None, 1, 1, 1, "x"), (5, None, None, None, 1, 1, 1, "x"), (None, 1, "user", "x", 1, 1, 1, "x")]
    got = conversation_trie.prefix_trie(table(rows, schema))
    assert {tuple(r) for r in got.collect()} == brute_trie([r[:4] for r in rows], lambda c: 0)
    assert conversation_trie.prefix_trie(table([], schema)).count() == 0
    assert conversation_trie.prefix_trie(table([], schema), conversation_trie.opening_turns()).count() == 0
