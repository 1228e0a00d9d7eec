"""Quality rules by hashed n-gram log-likelihood ratios, in DataFrame functions only.

Words and pairs of neighbouring words are hashed into `buckets` buckets.  The
trusted target (labelled good documents) and the raw corpus (all documents)
each give a smoothed multinomial over them.  A document's score is the mean
log-likelihood ratio, target against raw, of its n-grams; it is kept if the
score reaches a fixed threshold.  Counting is a pre-aggregated sum over all
n-grams of all documents; the weights, one number for each bucket, are bounded
by `buckets` and reach the scoring pass as a scalar subquery.

Base rules: a document fails with fewer than `least_words` words or with more
than `most_repeats` per cent of its words in repeated `window`-word windows.

Edge cases: a null or empty text has no words and fails; without trusted
documents all weights are 0 and only the base rules decide; null labels are no
labels; repeated rows are counted and scored each; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitalis.llm.storage import materialize

SEPARATORS = "\t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def words(text: Column) -> Column:
    """Maximal runs of characters that aren't ASCII white space."""
    return F.array_remove(F.split(F.translate(text, SEPARATORS, " " * len(SEPARATORS)), " "), "")


def neighbours(hashes: Column, shift: int = 1) -> Column:
    """A hash of each element and the one `shift` places on; none for the last ones."""
    both = F.transform(hashes, lambda h, i: F.xxhash64(h, F.get(hashes, i + shift)))
    return F.slice(both, 1, F.greatest(F.size(hashes) - shift, F.lit(0)))


def repeated_words(hashes: Column, pairs: Column, window: int) -> Column:
    """How many words lie in windows (of word hashes; pairs: those of two words) found
    twice or more.  Windows of two, four, ... words come first: where all of a text's
    are different, so are its longer ones."""

    def covered(found: Column) -> Column:
        """found: hash and place of each window, sorted."""
        size = F.size(found)
        same = lambda i, j: F.get(found, i)["h"] == F.get(found, j)["h"]
        again = F.filter(F.transform(found, lambda x, i: F.when(((i > 0) & same(i, i - 1)) | ((i < size - 1) & same(i, i + 1)), x["i"])), lambda x: x.isNotNull())
        return F.aggregate(
            F.array_sort(again),
            F.struct(F.lit(0).alias("n"), F.lit(-window).alias("end")),
            lambda acc, i: F.struct((acc["n"] + F.least(F.lit(window), i + window - acc["end"])).alias("n"), (i + window).alias("end")),
            lambda acc: acc["n"],
        )

    def of(found: Column, size: int) -> Column:
        if size == window:
            more = _let(F.array_sort(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), covered)
        else:
            to = min(2 * size, window)
            more = _let(neighbours(found, to - size), lambda x: of(x, to))
        return F.when(F.size(F.array_distinct(found)) == F.size(found), 0).otherwise(more)

    return F.when(F.size(hashes) < window + 1, 0).otherwise(of(pairs, 2)).cast("long")


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def base_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 8) -> DataFrame:
    """doc_id, hashes (of the words), pairs (of neighbours), and the base numbers of each row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    plain = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), words(text).alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, " " + SEPARATORS, "")) > 0)
    return plain.select(
        "doc_id",
        F.transform("words", lambda x: F.xxhash64(x)).alias("hashes"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", " " + SEPARATORS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ).withColumn("pairs", neighbours(F.col("hashes"))).withColumn("n_repeat_words", repeated_words(F.col("hashes"), F.col("pairs"), window))


def bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(gram, F.lit(buckets)).cast("int")


_BROADCAST_ROWS = 500_000


def weights(docs: DataFrame, trusted: DataFrame, buckets: int, smoothing: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row with the array of log-likelihood ratios by bucket."""
    good = trusted.select(F.col("doc_id").alias("_id")).distinct().withColumn("_good", F.lit(1))
    if good.count() <= _BROADCAST_ROWS:
        good = F.broadcast(good)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # joined as texts, which are half as large as their hashes where the join is a shuffle
    each = docs.select(F.col(id_col).alias("_doc"), text.alias("_text")).join(good, F.col("_doc") == F.col("_id"), "left")
    each = each.withColumn("hashes", F.transform(words(F.col("_text")), lambda x: F.xxhash64(x)))
    grams = each.select(F.coalesce("_good", F.lit(0)).alias("good"), F.explode(F.concat("hashes", neighbours(F.col("hashes")))).alias("gram"))
    counts = grams.groupBy(bucket(F.col("gram"), buckets).alias("bucket")).agg(F.count("*").alias("n"), F.sum("good").alias("k"))
    counts = materialize(counts, "gram-counts")
    n, k = counts.agg(F.sum("n"), F.sum("k")).first()
    n, k = n or 0, k or 0
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    ratio = F.log((F.coalesce("k", F.lit(0)) + smoothing) / (k + smoothing * buckets)) - F.log((F.coalesce("n", F.lit(0)) + smoothing) / (n + smoothing * buckets))
    filled = every.join(counts, "bucket", "left").select("bucket", (ratio if k else F.lit(0.0)).alias("w"))
    ordered = filled.agg(F.array_sort(F.collect_list(F.struct("bucket", "w"))).alias("x"))  # `buckets` numbers
    return materialize(ordered.select(F.transform("x", lambda s: s["w"]).alias("w")), "gram-weights")


def apply_rules(
    docs: DataFrame,
    trusted: DataFrame,
    buckets: int = 32_768,
    smoothing: float = 1.0,
    threshold: float = -0.1,
    least_words: int = 20,
    most_repeats: int = 30,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, the base numbers, score, base_failed and kept of each row."""
    table = weights(docs, trusted, buckets, smoothing, id_col, text_col).scalar()
    base = base_columns(docs, id_col, text_col).withColumn("_weights", table)
    add = lambda acc, gram: acc + F.get("_weights", bucket(gram, buckets))
    total = F.aggregate("pairs", F.aggregate("hashes", F.lit(0.0), add), add)
    scored = base.withColumn("score", F.when(F.col("n_words") > 0, total / (2 * F.col("n_words") - 1)).otherwise(0.0))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeats * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= threshold)).drop("hashes", "pairs", "_weights")
