"""Text search, e-mail matching and the per-viewer action on an event card."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatplan.functions.text import (CI_AI, blind_key, ci_contains, ci_key, fold, has_blind_key,
                                     is_printable_ascii, like_pattern, php_trim)
from seatplan.operators.reports import _ts, booking_counts
from seatplan.plans.lineage import materialize, written
from seatplan.plans.sides import counted_side
from seatplan.sources.tables import Tables

SEARCH_COLUMNS = ["event_id", "customer_id", "event_name", "event_time", "budget",
                  "venue_name", "capacity", "organizer_name", "booking_total"]


def event_search(t: Tables, term: str) -> DataFrame:
    """Events whose name, venue name or organizer name contains ``term``.

    ``term`` is trimmed (not whitespace-collapsed); an empty term matches
    nothing.  Matching is accent- and case-blind; ``%`` and ``_`` in the
    term keep their LIKE meaning, as on the page.

    Plan: each dimension is read once and joined once, with the name to show
    and whether it holds the term; bookings are counted for matches only.
    """
    term = term.strip(" \t\n\r\x00\x0b")
    if term == "":
        def holds(c):
            return F.lit(False)
    else:
        def holds(c):
            return F.coalesce(ci_contains(c, term), F.lit(False))
    venues = t.venues.select("venue_id", "venue_name", "capacity", holds("venue_name").alias("_v"))
    organizers = t.customers.select("customer_id", F.col("name").alias("organizer_name"),
                                    holds("name").alias("_c"))
    matched = (t.events.join(venues, "venue_id").join(organizers, "customer_id")
               .filter(holds("event_name") | F.col("_v") | F.col("_c")))
    # Bookings of matched events only, counted after the join: the events are read once.
    counted = (matched.join(t.bookings.select("event_id", "booking_id"), "event_id", "left")
               .groupBy(*[c for c in SEARCH_COLUMNS if c != "booking_total"])
               .agg(F.count("booking_id").cast("bigint").alias("booking_total")))
    return counted.select(*SEARCH_COLUMNS).orderBy("event_time", "event_id")


#: Length of the grams that retrieve candidates (shorter ones for terms without such a run).
GRAM = 3


#: A term is looked up by grams of its first so many characters; all of it is tested.
LOOKED_UP = 64


#: Stands for a gram of the names that every term is tested on (no name or term holds it as a gram).
EVERY_TERM = "*" * (GRAM + 1)


def _grams(text, n: int):
    """Distinct runs of ``n`` characters of a text."""
    last = F.length(text) - n + 1
    return F.when(last >= 1, F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, F.lit(n))))
    ).otherwise(F.array().cast("array<string>"))


def _name_grams(key, proven, lengths: list[int]):
    """What a name is retrieved by: its grams of those lengths, or every term
    where its key may be less blind than the collation."""
    runs = [_grams(key, n) for n in lengths if n] + [F.array(F.lit(""))] * (0 in lengths)
    held = F.flatten(F.array(*runs)) if runs else F.array().cast("array<string>")
    every = F.array(*map(F.lit, [EVERY_TERM] + [""] * (0 in lengths)))
    return F.when(proven, held).otherwise(every)


def _term_grams(term, wild):
    """Runs that every match of a term holds: those of its longest literal piece.

    Wildcard terms fall into pieces at ``%`` and ``_`` (escaped ones are
    literal but end a piece too).
    """
    pieces = F.when(wild, F.split(term, r"[%_" + chr(92) * 2 + "]+")).otherwise(F.array(term))
    longest = F.element_at(F.array_sort(pieces, lambda a, b: F.length(a) - F.length(b)), -1)
    head = F.substring(longest, 1, LOOKED_UP)
    out = F.array(F.lit(""))
    for n in range(1, GRAM + 1):
        out = F.when(F.length(head) >= n, _grams(head, n)).otherwise(out)
    return out


def _searched_names(t: Tables) -> DataFrame:
    """(kind, key, name): every event, venue and organizer name once."""
    return (t.events.select(F.lit("event").alias("kind"), F.col("event_id").alias("key"),
                            F.col("event_name").alias("name"))
            .unionAll(t.venues.select(F.lit("venue"), "venue_id", "venue_name"))
            .unionAll(t.customers.select(F.lit("organizer"), "customer_id", "name"))
            .filter(F.col("name").isNotNull()))


def _name_matches() -> F.Column:
    """Whether ``name`` holds ``term``: wildcard terms by LIKE on folded text,
    plain ones byte-wise where both are printable ASCII, else by collation."""
    plain = F.when(is_printable_ascii("name") & is_printable_ascii("term"),
                   F.lower("name").contains(F.lower("term"))) \
        .otherwise(F.collate("name", CI_AI).contains(F.collate("term", CI_AI)))
    return F.when(F.col("wild"), F.like(F.col("folded"), fold(like_pattern("term")))).otherwise(plain)


def _keyed_terms(terms: DataFrame) -> DataFrame:
    """(term, wild, gram) of distinct, trimmed, non-empty terms: the runs that each may be looked up by."""
    clean = (terms.select(php_trim(F.col(terms.columns[0])).alias("term"))
             .filter(F.col("term") != "").distinct()
             .withColumn("wild", F.col("term").rlike(r"[%_" + chr(92) * 2 + "]")))
    grams_of = F.when(F.col("wild") | has_blind_key("term"), _term_grams(blind_key("term"), F.col("wild"))) \
        .otherwise(F.array(F.lit("")))
    return clean.select("term", "wild", F.explode(grams_of).alias("gram"))


def gram_postings(t: Tables, keyed: DataFrame) -> DataFrame:
    """(gram, kind, key), written: the names that hold each gram of ``keyed``, and
    under :data:`EVERY_TERM` those that every term is tested on.

    Names are read and cut once, into grams of the lengths asked for; only
    grams that some term asks for are stored, without the names.
    """
    lengths = sorted(r[0] for r in keyed.select(F.length("gram")).distinct().collect())  # of 0 to GRAM
    wanted = keyed.select("gram").union(keyed.sparkSession.createDataFrame([(EVERY_TERM,)], "gram string")).distinct()
    names = _searched_names(t).select("kind", "key", blind_key("name").alias("folded"), has_blind_key("name").alias("proven"))
    grams = names.select("kind", "key", F.explode(_name_grams(F.col("folded"), F.col("proven"), lengths)).alias("gram"))
    return written(grams.join(counted_side(wanted), "gram"), "gram-postings")


def search_terms_batch(t: Tables, terms: DataFrame) -> DataFrame:
    """(term, event_id) for every term in ``terms`` and every event it finds.

    A gram join: each term is looked up by the rarest of its grams (runs of up
    to three characters) among the names, and the names that hold that gram
    are tested exactly.  Grams are those of :func:`blind_key`, which is as blind
    as the collation for all scripts that it compares letter by letter.  Names of
    other scripts (Thai, Indic ones) are tested on every term, and plain terms on every name.
    Names are tested once each, then venues and organizers lead to their events.

    Plan: the postings of the terms' grams are written once and hold keys only;
    what a join broadcasts is the term's side, what it found, or nothing,
    decided on counted rows (:func:`counted_side`), never the postings or names.
    """
    keyed = materialize(_keyed_terms(terms))
    postings = gram_postings(t, keyed)
    often = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # A term with a gram that no name holds is found at most in names that take every term.
    held = keyed.join(often, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = (held.groupBy("term", "wild").agg(F.min(F.struct("n", "gram")).alias("least"))
              .select("term", "wild", F.col("least.n").alias("n"), F.col("least.gram").alias("gram")))
    # The empty gram meets every name already.
    by = F.when(F.col("n") == 0, F.array(F.lit(EVERY_TERM))).when(F.col("gram") == "", F.array("gram")) \
        .otherwise(F.array(F.col("gram"), F.lit(EVERY_TERM)))
    looked_up = counted_side(rarest.select("term", "wild", F.explode(by).alias("gram")))
    met = counted_side(postings.join(looked_up, "gram").select("term", "wild", "kind", "key"))
    names = _searched_names(t).withColumn("folded", fold("name"))
    hits = counted_side(names.join(met, ["kind", "key"]).filter(_name_matches()).select("term", "kind", "key"))
    events = (t.events.select("event_id", "customer_id", "venue_id")
              .join(t.venues.select("venue_id"), "venue_id", "left_semi")
              .join(t.customers.select("customer_id"), "customer_id", "left_semi"))
    # Events once: each with its own key and those of its venue and organizer.
    keys = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("key")) for k, c in (
        ("event", "event_id"), ("venue", "venue_id"), ("organizer", "customer_id"))])).alias("k")
    return (events.select("event_id", keys).select("event_id", "k.kind", "k.key")
            .join(hits, ["kind", "key"]).select("term", "event_id").distinct())


def search_hit_counts(t: Tables, terms: DataFrame) -> DataFrame:
    """(term, hits): the page's ``count($results)`` per term, zeros kept."""
    pairs = search_terms_batch(t, terms)
    clean = (terms.select(php_trim(F.col(terms.columns[0])).alias("term"))
             .filter(F.col("term") != "").distinct())
    return (clean.join(pairs.groupBy("term").agg(F.count(F.lit(1)).alias("hits")), "term", "left")
            .select("term", F.coalesce("hits", F.lit(0)).cast("bigint").alias("hits")))


def account_by_email(t: Tables, emails: DataFrame, email_col: str = "email") -> DataFrame:
    """Match submitted e-mails to accounts under the accent/case/trailing-space-blind collation.

    An equi-join on a collated key: Spark hash-partitions on the collation
    key, so this is a shuffle (or broadcast) join, never a nested loop.
    """
    acc = t.customers.select(F.col("customer_id"), F.col("name"), F.col("role"),
                             F.col("email").alias("account_email"))
    return (emails.join(acc, ci_key(F.col(email_col)) == ci_key(F.col("account_email")), "inner"))


def viewer_action(t: Tables, views: DataFrame, as_of, page: str = "catalogue") -> DataFrame:
    """The action shown to a viewer on an event card, for (view_id, viewer_id, event_id) rows.

    Customers: Already Booked > Event Closed (past) > Event Full > Reserve Seat.
    The owning organizer: Edit/Delete on the catalogue, Edit on search.
    Anyone else: NULL.  Views of unknown events or viewers give no row.
    """
    owner_label = "Edit/Delete" if page == "catalogue" else "Edit"
    state = (t.events.select("event_id", F.col("customer_id").alias("owner_id"), "venue_id",
                             "event_time")
             .join(booking_counts(t), "event_id", "left")
             .join(t.venues.select("venue_id", "capacity"), "venue_id")
             .select("event_id", "owner_id",
                     (~(F.col("event_time") > _ts(as_of))).alias("is_past"),
                     (F.coalesce("booking_total", F.lit(0)) >= F.col("capacity")).alias("is_full")))
    viewers = t.customers.select(F.col("customer_id").alias("viewer_id"), "role")
    held = t.bookings.select("event_id", F.col("customer_id").alias("viewer_id"),
                             F.lit(True).alias("held"))
    v = (views.join(state, "event_id").join(viewers, "viewer_id")
         .join(held, ["event_id", "viewer_id"], "left"))
    action = (F.when(F.col("role") == "customer",
                     F.when(F.col("held").isNotNull(), "Already Booked")
                      .when(F.col("is_past"), "Event Closed")
                      .when(F.col("is_full"), "Event Full")
                      .otherwise("Reserve Seat"))
              .when((F.col("role") == "organizer") & (F.col("owner_id") == F.col("viewer_id")),
                    owner_label))
    keep = [c for c in views.columns if c not in ("event_id", "viewer_id")]
    return v.select(*keep, "viewer_id", "event_id", action.alias("action"))
