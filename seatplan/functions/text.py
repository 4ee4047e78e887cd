"""Text rules of the booking app as Spark column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from seatplan.functions.collation import blind_fold, collation_fold, letterwise
from seatplan.functions.dates import strtotime

# Fixed values the results depend on.
# ASCII whitespace that PHP's PCRE ``\s`` matches (RE2's ``\s`` lacks \x0B).
WHITESPACE_CLASS = "[ \\t\\n\\x0B\\f\\r]+"
# PHP trim() strips these from both ends.
PHP_TRIM_CHARS = " \t\n\r\u0000\u000b"
# Accent- and case-blind comparison like utf8mb4_unicode_ci; RTRIM also
# ignores trailing spaces for '=' as MySQL's PAD SPACE collations do.
CI_AI = "UNICODE_CI_AI"
CI_AI_RTRIM = "UNICODE_CI_AI_RTRIM"
# Parts of an address.  No look-ahead, so the same text runs on RE2 engines; what
# look-aheads would say (lengths, groups of an IPv6 address) is checked apart.
EMAIL_ATOM = "[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+"
EMAIL_QUOTED = "\"([\\x20-\\x21\\x23-\\x5B\\x5D-\\x7E]|\\\\[\\x20-\\x7E])*\""
EMAIL_LOCAL = f"^({EMAIL_ATOM}|{EMAIL_QUOTED})(\\.({EMAIL_ATOM}|{EMAIL_QUOTED}))*$"
EMAIL_LABEL = "[A-Za-z0-9]+(-+[A-Za-z0-9]+)*"
EMAIL_DOMAIN = f"^({EMAIL_LABEL}\\.)+[A-Za-z][A-Za-z0-9]*(-+[A-Za-z0-9]+)*$"
IPV4 = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}"
HEX4 = "[0-9A-Fa-f]{1,4}"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_text(c) -> Column:
    """Collapse ASCII whitespace runs to one space, then PHP-trim."""
    return F.trim(F.regexp_replace(col_(c), WHITESPACE_CLASS, " "), F.lit(PHP_TRIM_CHARS))


def php_trim(c) -> Column:
    return F.trim(col_(c), F.lit(PHP_TRIM_CHARS))


def _units(c) -> Column:
    """Length of a part of an address: an escaped character counts once, quotes do not."""
    return F.length(F.regexp_replace(F.regexp_replace(c, "\\\\\\\\.", "x"), "\"", ""))


def _address_literal(domain) -> Column:
    """``[192.0.2.1]`` or ``[IPv6:...]``: eight groups, or fewer around one ``::``; the last two may be an IPv4 address."""
    inner = F.regexp_extract(domain, "^\\[(.*)\\]$", 1)
    six = F.when(F.lower(F.substring(inner, 1, 5)) == "ipv6:", F.substring(inner, 6, 1000))
    groups = F.size(F.filter(F.split(six, ":"), lambda g: g != ""))
    tail = six.contains(".")
    full = F.when(tail, six.rlike(f"^{HEX4}(:{HEX4}){{5}}:{IPV4}$")).otherwise(six.rlike(f"^{HEX4}(:{HEX4}){{7}}$"))
    short = F.when(tail, six.rlike(f"^({HEX4}(:{HEX4})*)?::({HEX4}:)*{IPV4}$") & (groups <= 5)) \
        .otherwise(six.rlike(f"^({HEX4}(:{HEX4})*)?::({HEX4}(:{HEX4})*)?$") & (groups <= 6))
    return inner.rlike(f"^{IPV4}$") | F.coalesce(full | short, F.lit(False))


def email_is_valid(c) -> Column:
    """Well-formed address: atoms and quoted strings before the last ``@``,
    a domain of two labels or more or an address literal after it."""
    e = col_(c)
    domain = F.substring_index(e, "@", -1)
    local = F.substring(e, F.lit(1), F.greatest(F.length(e) - F.length(domain) - 1, F.lit(0)))
    named = domain.rlike(EMAIL_DOMAIN) & ~domain.rlike("[^.]{64}")
    return F.coalesce(local.rlike(EMAIL_LOCAL) & F.when(domain.startswith("["), _address_literal(domain)).otherwise(named)
                      & (_units(local) <= 64) & (_units(e) <= 254) & (F.octet_length(e) <= 320), F.lit(False))


def ci_key(c) -> Column:
    """A collated column usable as a join or partition key (hash-partitionable)."""
    return F.collate(col_(c), CI_AI_RTRIM)


def has_like_wildcards(term: str) -> bool:
    return any(ch in term for ch in "%_\\")


# Printable ASCII: for such strings the accent/case-blind collation compares
# exactly like lower-casing (no accents, no ignorable characters), so a plain
# byte search on lower() gives the same answer far more cheaply.
PRINTABLE_ASCII = "^[\\x20-\\x7E]*$"


def is_printable_ascii(c) -> Column:
    return F.coalesce(col_(c).rlike(PRINTABLE_ASCII), F.lit(False))


def _term_is_ascii(term: str) -> bool:
    return all(0x20 <= ord(ch) <= 0x7E for ch in term)


# A backslash before anything but %, _ or another backslash stands for nothing.
IDLE_ESCAPE = r"\\([^%_\\])|(\\[%_\\])"


def like_pattern(term) -> Column:
    """The page's LIKE pattern of a term column, without escapes that Spark's LIKE rejects."""
    return F.regexp_replace(F.concat(F.lit("%"), col_(term), F.lit("%")), IDLE_ESCAPE, "$1$2")


def like_text(term: str) -> str:
    """:func:`like_pattern` of one given term."""
    return re.sub(IDLE_ESCAPE, lambda m: (m[1] or "") + (m[2] or ""), f"%{term}%", flags=re.S)


def fold(c) -> Column:
    """Case- and accent-blind form of a text (:func:`collation_fold`)."""
    return F.when(is_printable_ascii(c), F.lower(col_(c))).otherwise(collation_fold(col_(c)))


def blind_key(c) -> Column:
    """:func:`fold`, further folded: texts that are equal under the collation, or
    one of which holds the other, have keys that are and do."""
    return F.when(is_printable_ascii(c), F.lower(col_(c))).otherwise(blind_fold(col_(c)))


def has_blind_key(c) -> Column:
    """Whether :func:`blind_key` is known to be as blind as the collation: not for
    scripts whose letters the collation reorders or contracts."""
    return is_printable_ascii(c) | letterwise(col_(c))


def ci_contains(c, term: str) -> Column:
    """MySQL ``col LIKE '%term%'`` under the page's unescaped wrapping.

    A plain term is an accent- and case-blind substring test.  A term holding
    ``%``, ``_`` or a backslash keeps its wildcard meaning (the page never
    escapes them) and is matched on folded text (:func:`fold`), where ``_`` is any
    one letter with its marks.  A backslash before any other character is
    dropped, as the database reads it.
    """
    if has_like_wildcards(term):
        return F.like(fold(c), fold(F.lit(like_text(term))))
    slow = F.collate(col_(c), CI_AI).contains(F.lit(term))
    if _term_is_ascii(term):
        return F.when(is_printable_ascii(c), F.lower(col_(c)).contains(F.lit(term.lower()))) \
            .otherwise(slow)
    return slow


def ucfirst(c) -> Column:
    s = col_(c)
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 1 << 30))


def initials(c) -> Column:
    """First letters of the first two space-separated parts, upper-cased."""
    parts = F.split(F.trim(col_(c)), " ")
    first = F.upper(F.substring(F.get(parts, 0), 1, 1))
    second = F.coalesce(F.upper(F.substring(F.get(parts, 1), 1, 1)), F.lit(""))
    return F.concat(first, second)


def format_datetime(ts) -> Column:
    """``May 10, 2026 02:05 PM`` from a timestamp column."""
    return F.date_format(col_(ts), "MMM dd, yyyy hh:mm a")


def format_datetime_text(text, as_of=None) -> Column:
    """Same, from text as :func:`seatplan.functions.dates.strtotime` reads it;
    text that names no moment is returned as is."""
    stored = parse_datetime_text(text)
    parsed = F.when(stored.isNotNull(), stored).otherwise(strtotime(col_(text), as_of))
    return F.coalesce(format_datetime(parsed), col_(text))


def format_input_time(ts) -> Column:
    """The ``datetime-local`` form value: ``2026-05-10T10:00``."""
    return F.date_format(col_(ts), "yyyy-MM-dd'T'HH:mm")


def format_currency(x) -> Column:
    """``BDT 12,000.00``; rounds half up first (format_number alone is half-even)."""
    return F.concat(F.lit("BDT "), F.format_number(F.round(col_(x).cast("decimal(38,4)"), 2), 2))


# Date-time forms that the table takes.
DATETIME_SHAPE = "^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2})?)?$"


def parse_datetime_text(text) -> Column:
    """Date-time text as the table stores it; NULL when it takes no such text."""
    t = F.trim(col_(text))
    # Straight to a zone-free value: a time that a session zone skips stays as written.
    return F.when(t.rlike(DATETIME_SHAPE), t.try_cast("timestamp_ntz"))


# PHP's (int) on a string: skip leading whitespace, read the longest numeric
# prefix; an integer prefix converts directly, a float-form prefix ("12.7",
# "1e3") converts through a float and truncates toward zero; else 0.
PHP_NUMERIC_PREFIX = "^[ \\t\\n\\r\\x0B\\f]*([+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?)"


def php_intval(text) -> Column:
    """PHP ``(int)'12abc'`` is 12, ``(int)'1e3'`` is 1000, ``(int)'abc'`` is 0.

    Digits beyond a 64-bit integer saturate, as in PHP.
    """
    lead = F.regexp_extract(col_(text), PHP_NUMERIC_PREFIX, 1)
    beyond = F.when(lead.startswith("-"), F.lit(-(1 << 63))).otherwise(F.lit((1 << 63) - 1))
    as_int = F.when(lead.rlike("^[+-]?[0-9]+$"), F.coalesce(lead.try_cast("bigint"), beyond))
    as_float = F.when(~lead.rlike("^[+-]?[0-9]+$"), lead.try_cast("double"))
    truncated = F.when(as_float.isNotNull() & (F.abs(as_float) < F.lit(9.2e18)),
                       F.when(as_float < 0, F.ceil(as_float)).otherwise(F.floor(as_float)))
    return F.coalesce(as_int, truncated.cast("bigint"), F.lit(0).cast("bigint"))


def parse_id_list(arr) -> Column:
    """Cast each form value to an int, de-duplicate, keep first-seen order."""
    return F.array_distinct(F.transform(F.coalesce(col_(arr), F.array().cast("array<string>")),
                                        lambda x: php_intval(x)))


def resource_label(kind: str) -> Column:
    if kind == "venue":
        return F.concat(F.col("venue_name"), F.lit(" (Capacity: "), F.col("capacity").cast("string"),
                        F.lit(")"))
    if kind == "staff":
        return F.concat(F.col("name"), F.lit(" - "), F.col("role"))
    if kind == "supplier":
        return F.concat(F.col("name"), F.lit(" - "), F.col("service_type"))
    raise ValueError(f"unknown resource kind {kind!r}")
