"""Text folded as blindly as the accent- and case-blind collation, for every script.

Spark compares and searches under the collation, but has no LIKE under it and
no key that texts could be cut into grams of.  Both need a fold: a plain text
that is equal for texts that the collation finds equal.  Its table is asked of
the collation itself, once per process: all letters and signs that it
finds equal get one representative, those it does not see are dropped, and
ligatures it finds equal to several letters become these.

The table covers scripts whose letters are compared one by one.  Scripts whose
letters the collation reorders or contracts (Thai, Lao, Indic scripts, Hangul
in parts) are left as they are, and :func:`letterwise` is false for texts that
hold them.
"""

from __future__ import annotations

import functools
import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

CI_AI = "UNICODE_CI_AI"
#: Blocks of letters and signs that are compared one by one (first, last).
BLOCKS = [(0x20, 0x7E), (0xA0, 0x24F), (0x370, 0x58F), (0x5D0, 0x5EA), (0x620, 0x64A), (0x660, 0x66D), (0x671, 0x6D3),
          (0x10A0, 0x10FF), (0x13A0, 0x13FF), (0x1E00, 0x1FFF), (0x2010, 0x2023), (0x2C60, 0x2C7F), (0x3041, 0x3096),
          (0x30A1, 0x30FA), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA640, 0xA66D), (0xAC00, 0xD7A3), (0xF900, 0xFAD9),
          (0xFB00, 0xFB06), (0xFF01, 0xFF04), (0xFF06, 0xFF3B), (0xFF3D, 0xFF3E), (0xFF40, 0xFF5E), (0xFF66, 0xFF6F), (0xFF71, 0xFF9D)]
#: Of these, blocks in which every character stands for itself.
PLAIN = [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3)]
#: Marks that go with the letter before them.
MARKS = [(0x300, 0x344), (0x346, 0x362)]
#: These keep their meaning in a pattern, so nothing is folded to them.
WILD = "%_\\"


def _chars(blocks) -> list[str]:
    return [chr(c) for a, b in blocks for c in range(a, b + 1) if unicodedata.category(chr(c))[0] not in "CM"]


def _base(c: str) -> str:
    """The first character of the canonical decomposition."""
    return unicodedata.normalize("NFD", c)[0]


@dataclass(frozen=True)
class Folds:
    """Characters and their representatives, ligatures and their letters, and what is dropped."""

    letters: str
    to: str
    ligatures: dict[str, str]
    dropped: str
    #: Letters that the collation keeps apart from the letter they are written with, and that letter.
    marked: str
    base: str
    #: Such letters written as a letter and a mark, and as one character.
    spelled: dict[str, str]


def _widened(every: list[str]) -> dict[str, str]:
    """Ligatures and the letters they may stand for."""
    wide = {"æ": "ae", "œ": "oe", "ß": "ss"}
    for c in every:
        full = unicodedata.normalize("NFKD", c).casefold()
        wide[c] = "".join(wide.get(x, x) for x in full if not unicodedata.combining(x))
    return {c: e for c, e in wide.items() if len(e) > 1 and e.isascii() and e.isalpha()}


@functools.cache
def folds() -> Folds:
    """Asked of the collation by one small job."""
    spark = SparkSession.getActiveSession()
    own = _chars([b for b in BLOCKS if b not in PLAIN])
    every = [*dict.fromkeys([*own, *map(_base, own)])]
    letters = spark.createDataFrame([(c, c.lower() != c, ord(c)) for c in every], "c string, upper boolean, code int")
    groups = letters.groupBy(F.collate("c", CI_AI).alias("k")).agg(
        F.min(F.struct("upper", "code")).alias("one"), F.collect_list("c").alias("all"))
    to = {c: chr(r.one.code) for r in groups.filter(F.size("all") > 1).select("one", "all").collect() for c in r.all}
    marks = [chr(c) for a, b in MARKS for c in range(a, b + 1)]
    unseen = letters.filter(F.collate("c", CI_AI) == F.collate(F.lit(""), CI_AI)).select("c")
    dropped = {r.c for r in unseen.collect()} | set(marks)
    pairs = spark.createDataFrame(list(_widened(every).items()), "c string, e string")
    ligatures = {r.c: r.e for r in pairs.filter(F.collate("c", CI_AI) == F.collate("e", CI_AI)).collect()}
    single = {c: r for c, r in to.items() if c != r and r not in WILD and c not in ligatures and c not in dropped}
    marked, spelled = {}, {}
    for c in every:
        base, folded = single.get(_base(c), _base(c)), single.get(c, c)
        if base != folded and c not in ligatures and base not in WILD and _base(c) != c:
            marked[folded] = base
            if len(pair := unicodedata.normalize("NFD", c)) == 2:
                spelled[pair] = c
    return Folds("".join(single), "".join(single.values()), ligatures, "".join(sorted(dropped)), "".join(marked),
                 "".join(marked.values()), spelled)


def collation_fold(c: Column) -> Column:
    """Texts equal under the collation, of letters compared one by one, are equal here; others are not.

    A letter and its marks are one character, a ligature is its letters.
    """
    f = folds()
    composed = c
    for pair, letter in f.spelled.items():
        composed = F.replace(composed, F.lit(pair), F.lit(letter))
    marks = "[" + "".join(f"\\u{a:04X}-\\u{b:04X}" for a, b in MARKS) + "]"
    c = F.when(c.rlike(marks), composed).otherwise(c)
    letters = F.create_map(*[F.lit(x) for pair in f.ligatures.items() for x in pair])
    parts = F.transform(F.split(c, ""), lambda x: F.coalesce(F.element_at(letters, x), x))
    whole = F.when(c.rlike("[" + "".join(f.ligatures) + "]"), F.array_join(parts, "")).otherwise(c)
    return F.translate(whole, f.letters + f.dropped, f.to)


def blind_fold(c: Column) -> Column:
    """:func:`collation_fold`, further folded: letters that a contraction keeps apart
    from their base letter (й and и) are equal too, so a lone mark after a letter cannot matter."""
    f = folds()
    return F.translate(collation_fold(c), f.marked, f.base)


@functools.cache
def _letterwise_class() -> str:
    """A regular expression's class of all letters compared one by one, and marks."""
    known = [b for b in PLAIN] + MARKS
    for c in sorted(map(ord, _chars([b for b in BLOCKS if b not in PLAIN]))):
        if known and known[-1][1] == c - 1 and known[-1] not in PLAIN and known[-1] not in MARKS:
            known[-1] = (known[-1][0], c)
        else:
            known.append((c, c))
    return "[" + "".join(f"\\u{a:04X}-\\u{b:04X}" for a, b in known) + "]"


def letterwise(c: Column) -> Column:
    """Whether the collation compares the text letter by letter, marks aside."""
    return F.coalesce(c.rlike(f"^{_letterwise_class()}*$"), F.lit(False))
