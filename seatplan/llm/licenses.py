"""License scans: MinHash bands over overlapping windows, then exact shingle containment.

Texts become words (runs of ASCII letters and digits and of all non-ASCII
bytes, ASCII letters lower-cased) and shingles of five words.  Templates fall
into size classes; for each class in use a text is cut into windows four times
the class's least size that overlap by half, so that every stretch as long as a
template of the class lies whole in a window.

A window retrieves a template when one of their MinHash bands is equal.  A
stretch holding 0.8 of a template's shingles has a known least Jaccard
similarity with its window; :func:`bands_for` takes as many bands (of one row)
as bring the chance that none is equal under ``MISS``.  A band can only be
equal if the window holds a shingle of the template, so windows without any
template shingle are passed over before their MinHashes are taken.  Retrieved
pairs are verified on the words themselves: at least ``CONTAINMENT`` of the
template's distinct shingles must be in the window.  Templates of fewer than five
words (an SPDX tag, a name with its version) have no shingle; they go by phrase and
must occur word for word.

A match reaches from its first to its last shared shingle.  One that lies inside
a match of another licence that shares more shingles is part of that text (a
licence names others, and versions repeat each other) and is left out; the same
licence beside or outside of it is found on its own.

The query's own templates (:func:`known_templates`) are, per licence, notices, file
headers and full texts.

Defined results: null, empty and short texts match nothing; of several windows
of a document the one with the highest containment counts, then the first;
repeated rows are repeated in the result; an empty table gives an empty
result; texts are read whole; other columns are ignored.
"""

from __future__ import annotations

import importlib.resources
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 5
CONTAINMENT = 0.8
#: Greatest chance that no band of a matching window is equal.
MISS = 1e-5
_CHUNK = 8 << 20  # bytes handled at once

# Notices by which works name their licence.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}

_GNU = {"GPL-2.0": ("General", "2"), "GPL-3.0": ("General", "3"), "LGPL-2.1": ("Lesser General", "2.1"),
        "LGPL-3.0": ("Lesser General", "3"), "AGPL-3.0": ("Affero General", "3")}
#: Other wordings of the notices, by licence.
NOTICES: dict[str, list[str]] = {
    "Apache-2.0": ["Apache License 2.0", "Apache License, Version 2.0", "Apache License v2.0", "Apache 2.0 License"],
    "MIT": ["under the MIT License", "The MIT License (MIT)", "under MIT License", "under the terms of the MIT License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-clause BSD license"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-clause BSD license"],
    "ISC": ["under the ISC License"],
    "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, version 2.0", "Mozilla Public License, v. 2.0"],
    "Unlicense": ["For more information, please refer to <https://unlicense.org>"],
    "CC0-1.0": ["CC0 1.0 Universal"],
    **{f"CC-{k}-4.0": [f"CC {k} 4.0", f"Creative Commons {name} 4.0 International"] for k, name in
       (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"))},
    **{k: [f"GNU {name} Public License{sign} {v}" for v in dict.fromkeys((v, v if "." in v else v + ".0"))
           for sign in (" version", " v", "")] + [f"GNU {name} Public License v{v}"]
       for k, (name, v) in _GNU.items()},
}


def known_templates() -> dict[str, list[str]]:
    """Every licence's notices, SPDX tag, file headers and full texts (``license_texts``: name[.variant].txt)."""
    out = {k: [v, *NOTICES.get(k, [])] for k, v in TEMPLATES.items()} | {
        k: list(v) for k, v in NOTICES.items() if k not in TEMPLATES}
    for file in sorted(importlib.resources.files("seatplan.llm").joinpath("license_texts").iterdir(), key=lambda f: f.name):
        if file.name.endswith(".txt"):
            name = file.name.removesuffix(".txt").removesuffix(".header").removesuffix(".regents")
            text = file.read_text("utf-8")
            paragraphs = text.split("\n\n") if ".header." in file.name else [text]
            # Headers are often cut short: each run of paragraphs from the first is a variant.
            out.setdefault(name, []).extend("\n\n".join(paragraphs[:n + 1]) for n in range(len(paragraphs)))
    return {k: [*v, f"SPDX-License-Identifier: {k}"] for k, v in out.items()}


_KIND = np.zeros(256, bool)
_KIND[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)


def bands_for(similarity: float, miss: float = MISS, rows: int = 1) -> int:
    """Bands of ``rows`` MinHashes such that a pair of this similarity shares none with chance ``miss`` at most."""
    return math.ceil(math.log(miss) / math.log(1 - similarity ** rows))


def _class_of(n_shingles: int) -> int:
    return max(0, (n_shingles - 1).bit_length() - 1)


def _least_similarity() -> float:
    """Of a stretch with CONTAINMENT of a template of 2**c + 1 shingles and its window of 4 * 2**c, at c = 0."""
    return CONTAINMENT / (4 + 1 - CONTAINMENT)


BANDS = bands_for(_least_similarity())


def _powers(n: int) -> np.ndarray:
    out = np.ones(n + 1, np.uint64)
    out[1:] = _BASE
    return np.multiply.accumulate(out)


def _words(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, hash) of each word in lower-cased bytes."""
    kind = _KIND[flat]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], kind, [False])).astype(np.int8)))
    start, stop = edges[::2], edges[1::2]
    if not len(start):
        return start, stop, np.empty(0, np.uint64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * _powers(len(flat))[:-1])))
    # A sum over the word, weighted by place, brought to a common place by the base's inverse powers.
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    back = np.ones(len(flat) + 1, np.uint64)
    back[1:] = inverse
    back = np.multiply.accumulate(back)
    h = (sums[stop] - sums[start]) * back[start]
    h ^= h >> np.uint64(31)
    return start, stop, h * np.uint64(0xBF58476D1CE4E5B9)


def _shingles(h: np.ndarray, width: int = WIDTH) -> np.ndarray:
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) + h[j:n + j]
    return out ^ (out >> np.uint64(32))


_rng = np.random.default_rng(2024)
_MUL = _rng.integers(1, 2 ** 63, BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2 ** 63, BANDS, dtype=np.uint64)


def _minhash(shingles: np.ndarray) -> np.ndarray:
    mixed = shingles[None, :] * _MUL[:, None] + _ADD[:, None]
    return (mixed ^ (mixed >> np.uint64(33))).min(1)


_SIEVE = 20  # bits of a shingle that the first look reads


def _filter(known: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << _SIEVE, bool)
    out[(known & np.uint64((1 << _SIEVE) - 1)).astype(np.int64)] = True
    return out


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each value is in the sorted, not empty ``known`` (np.isin sorts ``known`` again in every call)."""
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


class Library:
    """Templates with their shingles, MinHash bands and size classes; short ones as phrases."""

    def __init__(self, templates: dict[str, str | list[str]]):
        self.names, self.sets, self.bands = [], [], {}
        self.phrases: dict[int, dict[int, list[int]]] = {}  # words -> hash -> templates
        known: dict[int, list[np.ndarray]] = {}
        every = [(name, t) for name, texts in templates.items() for t in ([texts] if isinstance(texts, str) else texts)]
        for i, (name, text) in enumerate(every):
            flat = _LOWER[np.frombuffer(text.encode(), np.uint8)]
            start, stop, h = _words(flat)
            self.names.append(name)
            if not len(start):
                raise ValueError(f"template {name} has no words")
            width = min(WIDTH, len(start))
            self.sets.append(set(_word_shingles(flat.tobytes(), start, stop, width)))
            shingles = np.unique(_shingles(h, width))
            if width < WIDTH:
                self.phrases.setdefault(width, {}).setdefault(int(shingles[0]), []).append(i)
                continue
            c = _class_of(len(shingles))
            known.setdefault(c, []).append(shingles)
            for band, value in enumerate(_minhash(shingles).tolist()):
                self.bands.setdefault((c, band, value), []).append(i)
        self.classes = {c: np.unique(np.concatenate(x)) for c, x in sorted(known.items())}
        self.known = np.unique(np.concatenate(list(self.classes.values()))) if known else np.empty(0, np.uint64)
        self.filter = _filter(self.known)
        self.phrase_keys = {}
        for width, at in self.phrases.items():
            keys = np.array(sorted(at), np.uint64)
            self.phrase_keys[width] = keys, _filter(keys)


def _held(shingles: np.ndarray, known: np.ndarray, filt: np.ndarray) -> np.ndarray:
    """Places of known shingles."""
    at = np.flatnonzero(filt[(shingles & np.uint64((1 << _SIEVE) - 1)).astype(np.int64)])
    return at[_among(shingles[at], known)] if len(known) else at[:0]


def _word_shingles(flat: bytes, start: np.ndarray, stop: np.ndarray, width: int = WIDTH) -> list[tuple[bytes, ...]]:
    words = [flat[a:b] for a, b in zip(start.tolist(), stop.tolist())]
    return [tuple(words[i:i + width]) for i in range(len(words) - width + 1)]


def _scan_text(library: Library, flat: np.ndarray, start, stop, shingles: np.ndarray) -> Iterator[tuple]:
    """(template, containment, first word, past the last, shared shingles) of every verified window of one document."""
    at = _held(shingles, library.known, library.filter)
    if not len(at):
        return
    raw, held = None, shingles[at]
    for c, known in library.classes.items():
        own_at = at[_among(held, known)]
        if not len(own_at):
            continue
        step, size = 2 << c, 4 << c
        last = own_at // step
        for first in (np.unique(np.concatenate((last, np.maximum(last - 1, 0)))) * step).tolist():
            mins = _minhash(shingles[first:first + size]).tolist()
            hits = {t for band, value in enumerate(mins) for t in library.bands.get((c, band, value), ())}
            if not hits:
                continue
            raw = raw or flat.tobytes()
            end = min(first + size + WIDTH - 1, len(start))
            own = _word_shingles(raw, start[first:end], stop[first:end])
            for t in hits:
                shared = [i for i, s in enumerate(own) if s in library.sets[t]]
                n = len({own[i] for i in shared})
                if n >= CONTAINMENT * len(library.sets[t]):
                    yield t, n / len(library.sets[t]), first + shared[0], first + shared[-1] + WIDTH, n


def _find_phrases(library: Library, flat: np.ndarray, start, stop, h: np.ndarray) -> Iterator[tuple]:
    """(template, 1.0, first word, past the last, 0) of every short template that occurs."""
    for width, (keys, filt) in library.phrase_keys.items():
        shingles = _shingles(h, width)
        for first in _held(shingles, keys, filt).tolist():
            words = tuple(flat[a:b].tobytes() for a, b in zip(start[first:first + width], stop[first:first + width]))
            for t in library.phrases[width][int(shingles[first])]:
                if words in library.sets[t]:
                    yield t, 1.0, first, first + width, 0


def _on_their_own(found: list[tuple], names: list[str]) -> Iterator[tuple]:
    """Matches that do not lie inside one of another licence that shares more shingles."""
    found = sorted(set(found), key=lambda m: -m[4])
    first, stop, shared = (np.array([m[i] for m in found], np.int64) for i in (2, 3, 4))
    licence = np.array([names[m[0]] for m in found])
    for m in found:
        n = int(np.searchsorted(-shared, -m[4]))  # those that share more come first
        if not ((first[:n] <= m[2]) & (stop[:n] >= m[3]) & (licence[:n] != names[m[0]])).any():
            yield m


def scan_licenses(docs: DataFrame, templates: dict[str, str | list[str]] | None = None) -> DataFrame:
    """(doc_id, license, containment, first_word, n_words) of the best match per document and license.

    ``templates`` maps a name to its text or texts; without it the
    :func:`known_templates` are searched.  The library is built once and sent to the tasks (it is the caller's own, bounded list).
    """
    library = Library(known_templates() if templates is None else templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, raw in zip(batch.column(1).to_pylist(), batch.column(0)):
                raw = raw.as_py()
                if not raw or not library.names:
                    continue
                flat = _LOWER[np.frombuffer(raw, np.uint8)]
                start, stop, h = _words(flat)
                best: dict[str, tuple] = {}
                found = [*_scan_text(library, flat, start, stop, _shingles(h)),
                         *_find_phrases(library, flat, start, stop, h)]
                for t, share, first, end, _ in _on_their_own(found, library.names):
                    name = library.names[t]
                    best[name] = max(best.get(name, (0,)), (share, -first, end - first))
                for name, (share, first, n) in best.items():
                    for column, v in zip(out, (doc, name, share, -first, n)):
                        column.append(v)
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64())
            names = ("doc_id", "license", "containment", "first_word", "n_words")
            yield pa.record_batch({k: pa.array(v, t) for k, v, t in zip(names, out, kinds)})

    return (docs.select(F.col("text").cast("string").cast("binary"), F.col("doc_id").cast("long"))
            .mapInArrow(run, "doc_id long, license string, containment double, first_word long, n_words long"))
