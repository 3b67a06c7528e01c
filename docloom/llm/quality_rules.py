"""Quality rules from built-in DataFrame functions only.

Words are maximal runs of characters other than blank and 0x09-0x0D. Besides plain counts, every document gets a hashed n-gram
log-likelihood ratio: with unigrams and bigrams of words hashed to ``buckets`` classes, each is scored by
ln P(bucket | trusted target) - ln P(bucket | raw corpus), add-one smoothed, and the sum is divided by the number of
n-grams. Both multinomials are counted in Spark over all documents (target: all that the labels trust). The threshold is a
fixed number, so every verdict is a function of the counts alone.

The ratios are one array of ``buckets`` numbers whatever the corpus, used as a scalar subquery; counts are pre-aggregated in
each task, so only ``buckets`` rows a task are shuffled, and texts are never shuffled unless more than ``BROADCAST_IDS`` ids are
trusted (then they are joined by shuffle). Scoring is a projection.

Defined results: a null or empty text has no words, all counts zero, ratio null, and fails the base rules; a text of one
word has one unigram and no bigram; very long texts are whole; a row without an id is no trusted one; repeated rows each give a row; without trusted documents all ratios are zero and pass; an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import docs_text, materialize, narrow

BUCKETS = 1 << 14
#: Mean log ratio a document must reach.
MIN_RATIO = -0.06
BROADCAST_IDS = 1_000_000
#: Words of a repeat window; built from bigrams and four-word hashes.
WINDOW = 5
_BLANKS = r"[\x20\x09-\x0D]+"
_BLANK_CHARS = " \t\n\x0b\x0c\r"


def words_of(text: Column) -> Column:
    """The words of a text as an array."""
    bare = F.btrim(text, F.lit(_BLANK_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, _BLANKS))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def _shifted(left: Column, right: Column, n_left: Column, by: int) -> Column:
    """The hash of left[i] and right[i + by] for every i where both exist; both are arrays of longs in columns."""
    n = F.greatest(n_left - by, F.lit(0))
    return F.zip_with(F.slice(left, 1, n), F.slice(right, by + 1, n), lambda a, b: F.xxhash64(a, b))


def with_hashes(docs: DataFrame) -> DataFrame:
    """Adds ``words``, ``n``, and 64-bit hashes of all words (``h1``) and bigrams (``h2``).

    Each array is a column of its own: lambdas then refer to computed arrays instead of evaluating them for each element.
    """
    out = docs.withColumn("words", words_of(F.col("text")))
    out = out.withColumn("n", F.size("words")).withColumn("h1", F.transform("words", lambda w: F.xxhash64(w)))
    return out.withColumn("h2", _shifted(F.col("h1"), F.col("h1"), F.col("n"), 1))


def _covered(positions: Column, size: int) -> Column:
    step = F.transform(positions, lambda p, i: F.least(F.coalesce(F.get(positions, i + 1) - p, F.lit(size)), F.lit(size)))
    return F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x)


def base_counts(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with ``h1, h2, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (windows of ``WINDOW`` words)."""
    out = with_hashes(docs)
    out = out.withColumn("h4", _shifted(F.col("h2"), F.col("h2"), F.col("n") - 1, 2))
    out = out.withColumn("hashes", _shifted(F.col("h4"), F.col("h1"), F.col("n"), WINDOW - 1))
    out = out.select(
        "doc_id", "h1", "h2", "hashes",
        F.col("n").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        duplicate_lines(F.col("text")).alias("n_dup_lines"),
    )
    # Equal windows stand side by side once (hash, position) is sorted; only texts with a repeated window are sorted.
    keyed = F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), F.array_sort(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    out = out.withColumn("keyed", keyed).drop("hashes")
    twice = F.filter("keyed", lambda x, i: F.coalesce(F.get("keyed", i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("keyed", i + 1)["h"] == x["h"], F.lit(False)))
    out = out.withColumn("at", F.array_sort(F.transform(twice, lambda x: x["i"]))).drop("keyed")
    return out.withColumn("n_repeat_words", F.coalesce(_covered(F.col("at"), WINDOW), F.lit(0).cast("long"))).drop("at")


def ratio_table(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, ratio``: ln P(bucket | trusted) - ln P(bucket | all), add-one smoothed, for every bucket."""
    spark = docs.sparkSession
    ids = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().withColumn("trusted", F.lit(1))
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    worded = with_hashes(docs.join(ids, "doc_id", "left").select(F.coalesce("trusted", F.lit(0)).alias("trusted"), "text"))
    marked = worded.select("trusted", F.explode(F.concat("h1", "h2")).alias("h")).select("trusted", F.pmod("h", F.lit(buckets)).alias("bucket"))
    none = spark.range(buckets).select(F.col("id").alias("bucket"), F.lit(0).cast("long").alias("raw"), F.lit(0).cast("long").alias("target"))
    seen = marked.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("trusted").alias("target"))
    counts = materialize(seen.unionByName(none).groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")), "grams", 1)
    raw, target = counts.agg(F.sum("raw"), F.sum("target")).first()
    p = lambda n, total: F.log((F.col(n) + 1) / F.lit(float(total + buckets)))
    return counts.select("bucket", (p("target", target) - p("raw", raw) if target else F.lit(0.0)).alias("ratio"))


def rate_quality(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, min_ratio: float = MIN_RATIO, min_words: int = 10, max_repeat_percent: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, ``base_failed``, ``ratio`` and ``kept`` for every document.

    ``trusted`` lists the ids (``doc_id``) of the trusted target.
    """
    texts = docs_text(docs, id_col, text_col)
    table = ratio_table(texts, trusted, buckets)
    ratios = table.agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "ratio"))), lambda x: x["ratio"]).alias("ratios")).scalar()
    out = base_counts(texts).withColumn("ratios", ratios)
    look_up = lambda a, h: a + F.get(F.col("ratios"), F.pmod(h, F.lit(buckets)).cast("int"))
    total = F.aggregate("h1", F.lit(0.0), look_up) + F.aggregate("h2", F.lit(0.0), look_up)
    n_grams = F.size("h1") + F.size("h2")
    out = out.withColumn("ratio", F.when(n_grams > 0, F.round(total / n_grams, 9)))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    counts = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return narrow(out.select(*counts, failed.alias("base_failed"), "ratio", (~failed & F.coalesce(F.col("ratio") >= min_ratio, F.lit(False))).alias("kept")))
