"""Secret scans: candidates by pattern, false positives removed by a random forest.

DataFrame functions and Spark's own (JVM) random forest only.  A word falls
into runs of key characters, wherever in the word they stand (JSON, URLs, lists,
markup, text without spaces).  A candidate is a run of twelve or more with a
digit among them, or any run of ``SHORT`` or more that directly follows a
credential word or an assignment sign.  A web token of three parts joined by dots
is one run.  Its features: length, character
transitions (how often neighbouring characters change class, and the share of
digits, capitals and distinct characters), dictionary coverage (the share of its
characters in letter runs that are words of the corpus: those of a share of all
documents, candidates left aside), its path (a column of
the caller), and what stands around it (a credential word before it, an
assignment, quotes).  A value with other punctuation inside gives its runs.

The forest is trained from labelled findings, at most ``train_rows`` of each
label by hash order; everything else covers all documents.

Defined results: null and empty texts have no candidates; a null path is an
empty one; repeated rows give repeated findings; without findings of both
labels nothing is learned and every candidate is kept with probability null;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seatplan.plans.lineage import materialize

KEY = r"A-Za-z0-9+/_\-"
RUN = rf"[{KEY}]{{12,}}"
#: A signed web token: three parts of base64, the first an object.
WEB_TOKEN = r"eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+"
#: Pieces of a word: what stands before a run, and the run.
PIECE = rf"[^{KEY}]*(?:{WEB_TOKEN}|[{KEY}]*)"
CREDENTIAL = r"(?i)(passw|pwd|secret|token|api.?key|access.?key|auth|credential|private)"
#: Text that ends where a credential's value starts: a credential word or an assignment.
LEAD = rf"{CREDENTIAL}[{KEY}.]*[^{KEY}]*((is|was)[^{KEY}]+)?$|[=:][^{KEY}]*$"
#: Least length of a run behind such a text.
SHORT = 4
#: So many characters before a candidate are looked at.
NEAR = 100
HARMLESS_PATH = r"(?i)(test|example|sample|doc|fixture|mock)"
#: A word of the dictionary occurs in this share of the documents, and in two at least.
DICTIONARY_SHARE = 1e-4
#: What may be a key is no source of words.
KEY_LIKE = rf"(?=[A-Za-z+/_\-]*[0-9])[{KEY}]{{12,}}"
TRAIN_ROWS = 20_000
FEATURES = ["length", "transitions", "digits", "capitals", "distinct", "coverage",
            "harmless_path", "credential_word", "assigned", "quoted"]


def candidates(docs: DataFrame, path) -> DataFrame:
    """(doc_id, path, word_no, run_no, found, before, after): every candidate.

    ``run_no`` is its place among the runs of its word; ``before`` ends where it
    starts (runs of the word before it, else the two words before), ``after`` is
    the character behind it.  Rows are cut from arrays of words and of pieces,
    so that none carries more of its text than that.
    """
    words = F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+")
    w, p = F.col("_w"), F.col("_p")

    def near(i):
        return F.concat_ws(" ", F.get(w, i - 2), F.get(w, i - 1), F.lit(""))

    def likely(i):
        word = F.get(w, i)
        return ((F.length(word) >= 12) & word.rlike("[0-9]") & word.rlike(RUN)
                | (F.length(word) >= SHORT) & (word.rlike("[=:]") | word.rlike(CREDENTIAL) | near(i).rlike(LEAD)))

    def run(i):
        piece = F.get(p, i)
        found = F.regexp_extract(piece, rf"({WEB_TOKEN}|[{KEY}]+)$", 0)
        gap = F.substring(piece, F.lit(1), F.length(piece) - F.length(found))
        before = F.concat(F.when(i < 3, F.col("_near")).otherwise(F.lit("")),
                          *[F.coalesce(F.get(p, i - k), F.lit("")) for k in (3, 2, 1)], gap)
        return F.struct(i.alias("run_no"), found.alias("found"), F.right(before, F.lit(NEAR)).alias("before"),
                        F.substring(F.coalesce(F.get(p, i + 1), F.lit("")), 1, 1).alias("after"))

    def numbers(of):
        return F.sequence(F.lit(0), F.size(of) - 1)

    def credible(r):
        long = (F.length(r["found"]) >= 12) & r["found"].rlike("[0-9]")
        return long | (F.length(r["found"]) >= SHORT) & r["before"].rlike(LEAD)

    found = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(path, F.lit("")).alias("path"),
                         words.alias("_w"))
             .select("doc_id", "path", F.explode(F.transform(
                 F.filter(numbers(w), likely),
                 lambda i: F.struct(i.alias("word_no"), F.get(w, i).alias("_word"),
                                    F.right(near(i), F.lit(NEAR)).alias("_near")))).alias("_at"))
             .select("doc_id", "path", "_at.word_no", "_at._near",
                     F.regexp_extract_all("_at._word", F.lit(PIECE), F.lit(0)).alias("_p")))
    return (found.select("doc_id", "path", "word_no",
                         F.explode(F.filter(F.transform(numbers(p), run), credible)).alias("_r"))
            .select("doc_id", "path", "word_no", "_r.*"))


def _dictionary(docs: DataFrame) -> DataFrame:
    """(part): lower-case letter runs outside of keys that enough documents hold."""
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), KEY_LIKE, " ")
    runs = F.array_distinct(F.regexp_extract_all(F.lower(plain), F.lit(r"[a-z]{4,30}"), F.lit(0)))
    least = max(2.0, DICTIONARY_SHARE * docs.count())
    return (docs.select(F.explode(runs).alias("part")).groupBy("part").agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") >= least).select("part"))


def _coverage(found: DataFrame, docs: DataFrame) -> DataFrame:
    """``found`` plus ``coverage``: the share of a candidate's characters in dictionary words."""
    parts = (found.select("found").distinct()
             .select("found", F.explode(F.regexp_extract_all(F.lower("found"), F.lit(r"[a-z]{4,30}"), F.lit(0))).alias("part")))
    covered = (parts.join(_dictionary(docs), "part").groupBy("found")
               .agg(F.sum(F.length("part")).alias("_covered")))
    return (found.join(covered, "found", "left")
            .withColumn("coverage", F.coalesce("_covered", F.lit(0)) / F.length("found")).drop("_covered"))


def features(found: DataFrame, docs: DataFrame) -> DataFrame:
    x, n = F.col("found"), F.length("found").cast("double")

    def share(pattern):
        return F.regexp_count(x, F.lit(pattern)) / n

    change = r"[a-z](?=[A-Z0-9])|[A-Z](?=[a-z0-9])|[0-9](?=[A-Za-z])"
    return (_coverage(found, docs)
            .withColumn("length", n).withColumn("transitions", share(change))
            .withColumn("digits", share("[0-9]")).withColumn("capitals", share("[A-Z]"))
            .withColumn("distinct", F.size(F.array_distinct(F.split(x, ""))) / n)
            .withColumn("harmless_path", F.col("path").rlike(HARMLESS_PATH).cast("double"))
            .withColumn("credential_word", F.col("before").rlike(CREDENTIAL).cast("double"))
            .withColumn("assigned", (F.col("before").rlike(r"[=:]>?\s*[\"']?$") & ~x.startswith("//")).cast("double"))
            .withColumn("quoted", (F.col("before").rlike("[\"']$") | F.col("after").rlike("[\"']")).cast("double")))


def scan_secrets(docs: DataFrame, labelled, path, train_rows: int = TRAIN_ROWS,
                 trees: int = 20, depth: int = 6, seed: int = 7, near_path: bool = False) -> DataFrame:
    """(doc_id, word_no, run_no, found_sha256, length, probability, kept) of every candidate.

    ``labelled`` is a column over the candidates: 1 for a confirmed secret, 0
    for a confirmed false positive, null for a finding nobody has labelled.
    With ``near_path`` path words count in the text before a candidate too.
    """
    found = candidates(docs, path)
    if near_path:
        found = found.withColumn("path", F.concat_ws(" ", "path", "before"))
    rated = materialize(features(found, docs).withColumn("label", labelled.cast("double")))
    by_hash = Window.partitionBy("label").orderBy("_h", "found")
    labels = (rated.filter("label is not null").select("label", "found", *FEATURES).distinct()
              .withColumn("_h", F.xxhash64("found", "label")))
    # A few of each label by hash order: first per slice, then overall, so that no label is sorted whole.
    slices = Window.partitionBy("label", F.pmod("_h", F.lit(64))).orderBy("_h", "found")
    train = (labels.withColumn("_n", F.row_number().over(slices)).filter(F.col("_n") <= train_rows)
             .withColumn("_n", F.row_number().over(by_hash)).filter(F.col("_n") <= train_rows))
    out = ["doc_id", "word_no", "run_no", F.sha2("found", 256).alias("found_sha256"), F.col("length").cast("int").alias("length")]
    train = materialize(train.select("label", *FEATURES))
    if train.select("label").distinct().count() < 2:
        return rated.select(*out, F.lit(None).cast("double").alias("probability"), F.lit(True).alias("kept"))
    assemble = VectorAssembler(inputCols=FEATURES, outputCol="features")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, labelCol="label")
    model = forest.fit(assemble.transform(train).select("label", "features"))
    scored = model.transform(assemble.transform(rated.drop("label")))
    chance = F.round(vector_to_array("probability")[1], 6)
    return scored.select(*out, chance.alias("probability"), (chance >= 0.5).alias("kept"))
