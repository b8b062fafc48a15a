"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

DataFrame functions alone. Word unigrams and bigrams are hashed to ``BUCKETS`` buckets each. Two multinomials
over the buckets, of the trusted documents and of the whole corpus, give each bucket a weight: the logarithm
of their ratio as a whole number of 2**-16, so that sums do not depend on their order and equal texts always get
equal verdicts. A document's score is the sum over its n-grams divided by their number; it is kept if
the base rules hold and the score reaches a fixed threshold. Every document gets a verdict.

Words: runs of characters other than space and \\t to \\r.

Defined results: null and empty texts have no words, no n-grams and fail the base rules; without trusted documents
all weights are 0 and the base rules decide; a null doc_id is never trusted and is judged by its text; rows with the same
doc_id are judged each by its own text; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, split_words

BUCKETS = 1 << 13
#: Counts added to each bucket of the target on average, shared out as the raw corpus is, so that what is rare leans to neither side.
SMOOTHING = 1.0
#: The lowest mean log-likelihood ratio of a document that is kept.
THRESHOLD = -0.1
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
_UNIT = 1 << 16
#: Low bits of a window's hash that hold its place: more words than a text can have.
_PLACE_BITS = 30

#: Fixed by the contract.
SYMBOLS, SPACES = "#*$%&|<>", " \t\n\x0b\f\r"


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _pairs(a: Column) -> tuple[Column, Column]:
    """Each element but the last with its successor."""
    n = F.greatest(F.size(a) - 1, F.lit(0))
    return F.slice(a, F.lit(1), n), F.slice(a, F.lit(2), n)


def _repeat_words(counted: DataFrame) -> DataFrame:
    """counted (w, ...) with n_repeat_words: words in 3-word windows that occur twice or more in the text.

    Each window's place takes the low bits of its hash, so that sorting plain numbers brings windows that may be equal
    together. Only those are then compared by whole hash: sorted with their places, neighbours that are equal
    give the places of repeated windows, and each adds the words not covered by the one before. Each
    step is a projection of its own, so that Spark evaluates it once. Texts without a repeated window stop after the first.
    """
    n = F.greatest(F.size("w") - 2, F.lit(0))
    hashed = counted.withColumn("hashes", F.transform(F.slice("w", F.lit(1), n), lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2))))
    some = hashed.withColumn("hashes", F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), F.col("hashes")))
    keyed = some.withColumn("keys", F.sort_array(F.transform("hashes", lambda h, i: h.bitwiseAND(F.lit(-1 << _PLACE_BITS)).bitwiseOR(i.cast("long")))))
    part = lambda x: F.shiftright(x, _PLACE_BITS)
    close = lambda x, i: (part(x) == part(F.get("keys", i + 1))) | ((i > 0) & (part(x) == part(F.get("keys", i - 1))))
    near = keyed.withColumn("near", F.filter("keys", lambda x, i: F.coalesce(close(x, i), F.lit(False))))
    place = lambda x: x.bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)).cast("int")
    placed = near.withColumn("placed", F.array_sort(F.transform("near", lambda x: F.struct(F.get("hashes", place(x)).alias("h"), place(x).alias("i")))))
    one, two = _pairs(F.col("placed"))
    found = F.filter(F.zip_with(one, two, lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"]))), lambda x: x.isNotNull())
    places = placed.withColumn("places", F.sort_array(F.array_distinct(F.flatten(found))))
    left, right = _pairs(F.col("places"))
    gained = F.aggregate(F.zip_with(left, right, lambda x, y: F.least(y - x, F.lit(3))), F.lit(3), lambda s, x: s + x)
    return places.withColumn("n_repeat_words", F.when(F.size("places") > 0, gained).otherwise(0).cast("long")).drop("w", "hashes", "keys", "near", "placed", "places")


def base_rules(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    split = docs.select("doc_id", F.xxhash64(_text()).alias("text_key"), _text().alias("text"))
    split = split.select("*", split_words(F.col("text")).alias("w"), F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "").alias("lines"))
    counted = split.select(
        "doc_id",
        "text_key",
        "w",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    repeated = _repeat_words(counted)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return repeated.withColumn("base_failed", failed)


def _grams(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text_key, bucket: one row for each word and each pair of neighbours."""
    text = _text()
    worded = docs.select("doc_id", F.xxhash64(text).alias("text_key"), split_words(text).alias("w"), *more)
    one, two = _pairs(F.col("w"))
    bucket = lambda h, at: (F.pmod(h, F.lit(BUCKETS)) + at).cast("int")
    buckets = F.concat(F.transform("w", lambda x: bucket(F.xxhash64(x), 0)), F.zip_with(one, two, lambda x, y: bucket(F.xxhash64(x, y), BUCKETS)))
    return worded.select("doc_id", "text_key", F.explode(buckets).alias("bucket"), *more)


def weights(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """bucket, weight for every bucket that occurs: at most 2 * BUCKETS rows. trusted: doc_id, one row each."""
    ids = trusted.select("doc_id").where("doc_id is not null").distinct().withColumn("good", F.lit(True))
    # the ids grow with the documents: a plain shuffled join at every size
    marked = docs.select("doc_id", "text").join(ids.hint("merge"), "doc_id", "left")
    counts = materialise(_grams(marked, "good").groupBy("bucket").agg(F.count("*").alias("raw"), F.count("good").alias("target")), "buckets")
    totals = counts.agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).first()
    if not totals["target"]:
        return counts.select("bucket", F.lit(0).cast("long").alias("weight"))
    room = SMOOTHING * 2 * BUCKETS
    share = F.col("raw") / totals["raw"]
    ratio = F.log((F.col("target") + room * share) / (totals["target"] + room)) - F.log(share)
    return materialise(counts.select("bucket", F.round(ratio * _UNIT).cast("long").alias("weight")), "weights")


def judge(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """base_rules' columns with score (mean log-likelihood ratio, null without n-grams) and kept, for every document."""
    table = F.broadcast(weights(docs, trusted))  # at most 2 * BUCKETS rows
    scores = _grams(docs).join(table, "bucket").groupBy("doc_id", "text_key").agg(F.sum("weight").alias("total"), F.count("*").alias("grams"))
    base = materialise(base_rules(docs), "base")  # filters on it must not be pushed into its array expressions
    same = base["doc_id"].eqNullSafe(scores["doc_id"]) & (base["text_key"] == scores["text_key"])
    both = base.join(scores, same, "left").select(*[base[c] for c in base.columns], "total", "grams")
    passed = F.coalesce(F.col("total") >= F.col("grams") * round(threshold * _UNIT), F.lit(False))
    return both.withColumn("score", F.col("total") / F.col("grams") / _UNIT).withColumn("kept", ~F.col("base_failed") & passed).drop("total", "grams")
