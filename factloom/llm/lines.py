"""Line dedup by a deletion-neighbourhood join, with DataFrame functions alone.

A line goes if an earlier line, in any document or its own, is within the edit bound. Edits are
insertions, deletions and substitutions of words, and the bound is relative: one edit for every ``WORDS_PER_EDIT`` words of both lines, one at
most. So equal lines go at every length, and lines of at least that many words also if one word differs. Case of A-Z
and white space do not count; lines without words stay. Earlier means a smaller doc_id, or in one document a smaller line number. Lines are
judged on the input, not on what is left. A document is ``repeated`` if it has lines with words and all of them went.

Equal lines are aggregated first. Of distinct lines only those that share their first or last half with another one
can be one edit apart; these emit every deletion of one word, and themselves, as hashed keys. Lines whose keys are equal
are candidates: two deletions at the same place (a substitution), or one of the keys a whole
line (an insertion or deletion). The earliest line of each key is an aggregate; no pairs are made. Each line is then verified
against the earliest one, word by word.

Hashes have 64 bits; equal lines are those of equal hashes and numbers of words.

Defined results: a null text stays null and has no lines to lose, an empty text stays; rows that repeat a doc_id and text
wholly are treated alike, and of rows with one doc_id and different texts the one with the smaller text hash
comes first; a null doc_id comes first of all; extra columns, whatever their names, are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, split_words

#: Words for one edit; the bound is one edit at most, which one deletion for each line covers.
WORDS_PER_EDIT = 8


def _words(line: Column) -> Column:
    return split_words(line, lower=True)


def _worded(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, line_no (from 0), w of every line."""
    lines = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("text_key"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.select("doc_id", "text_key", "line_no", _words(F.col("line")).alias("w"))


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, line_no, n (words), h (hash of the words) and the keys of the line's halves.

    A half's key holds the length of the shorter of two lines that may share it, so lines of n and of n - 1 words meet.
    """
    w, n = F.col("w"), F.size("w")
    half = lambda size: F.floor(size / 2).cast("int")
    keys = []
    for size in (n, n - 1):
        keys += [F.xxhash64(F.lit("first"), size, F.slice(w, F.lit(1), half(size))), F.xxhash64(F.lit("last"), size, F.slice(w, n - (size - half(size)) + 1, size - half(size)))]
    halves = F.when(n >= WORDS_PER_EDIT, F.array(*keys))
    return _worded(docs).select("doc_id", "text_key", "line_no", n.alias("n"), F.xxhash64(w).alias("h"), halves.alias("halves"))


def _first() -> Column:
    return F.min(F.struct("doc_id", "text_key", "line_no"))


def _near(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """n, h of distinct lines that have an earlier line one edit away. distinct: n, h, first, halves."""
    long = distinct.where(F.col("n") >= WORDS_PER_EDIT)
    halves = long.select("n", "h", F.explode("halves").alias("half"))
    met = materialise(halves.groupBy("half").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select("half"), "halves")
    some = materialise(long.join(halves.join(met, "half", "left_semi").select("n", "h").distinct(), ["n", "h"], "left_semi").select("n", "h", "first"), "halved")
    # the words of those lines, read again where each stands first
    at = some.select("first.doc_id", "first.text_key", "first.line_no", "n", "h", "first")
    chosen = at.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("line_no", "n", "h", "first")).alias("chosen"))
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").where("text is not null")
    same = keyed["doc_id"].eqNullSafe(chosen["doc_id"]) & (keyed["text_key"] == chosen["text_key"])
    split = keyed.join(chosen, same).select(F.split("text", "\n").alias("lines"), "chosen").select("lines", F.explode("chosen").alias("c"))
    words = materialise(split.select("c.n", "c.h", "c.first", _words(F.element_at("lines", F.col("c.line_no") + 1)).alias("w")), "words")
    cut = words.select("n", "h", "first", "w", F.posexplode("w").alias("place", "word"))
    less = F.concat(F.slice("w", F.lit(1), F.col("place")), F.slice("w", F.col("place") + 2, F.col("n")))
    deleted = cut.select("h", "n", "first", "place", (F.col("n") - 1).alias("size"), F.xxhash64(less).alias("variant"))
    whole = some.select("h", "n", "first", F.lit(-1).alias("place"), F.col("n").alias("size"), F.col("h").alias("variant"))
    variants = materialise(deleted.unionByName(whole), "variants")
    key = ["size", "variant"]
    shared = variants.groupBy(*key).agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select(*key)
    alike = materialise(variants.join(materialise(shared, "shared"), key, "left_semi"), "alike")
    by_place = materialise(alike.groupBy(*key, "place").agg(F.min("first").alias("earliest")), "places")
    wholes = by_place.where("place = -1").select(*key, "earliest")
    deletions = materialise(by_place.where("place >= 0").groupBy(*key).agg(F.min("earliest").alias("earliest")), "deletions")
    substituted = alike.where("place >= 0").join(by_place, [*key, "place"])
    shortened = alike.where("place >= 0").join(wholes, key)
    lengthened = alike.where("place = -1").join(deletions, key)
    later = [x.where("earliest < first").select("n", "h", "earliest") for x in (substituted, shortened, lengthened)]
    found = later[0].unionByName(later[1]).unionByName(later[2]).distinct()
    own = words.select("n", "h", F.col("w").alias("one"))
    other = words.select(F.col("first").alias("earliest"), F.col("w").alias("two"))
    return found.join(own, ["n", "h"]).join(other, "earliest").where(_one_edit(F.col("one"), F.col("two"))).select("n", "h").distinct()


def _one_edit(a: Column, b: Column) -> Column:
    """Whether one word's insertion, deletion or substitution, or nothing, turns one array of words into the other."""
    changed = F.size(F.filter(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), lambda x: x)) <= 1
    long, short = F.when(F.size(a) > F.size(b), a).otherwise(b), F.when(F.size(a) > F.size(b), b).otherwise(a)
    without = lambda i: F.concat(F.slice(long, F.lit(1), i), F.slice(long, i + 2, F.size(long)))
    dropped = F.exists(F.sequence(F.lit(0), F.size(short)), lambda i: without(i) == short)
    return F.when(F.size(a) == F.size(b), changed).otherwise((F.size(long) == F.size(short) + 1) & dropped)


def flagged_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, line_no, gone (null: a line without words) for every line."""
    lines = materialise(_lines(docs), "worded")
    distinct = materialise(lines.where("n > 0").groupBy("n", "h").agg(_first().alias("first"), F.min("halves").alias("halves")), "lines")
    near = materialise(_near(docs, distinct), "near").withColumn("near", F.lit(True))
    known = materialise(distinct.select("n", "h", "first").join(near, ["n", "h"], "left"), "known")
    # lines without words match nothing; a hash of their place spreads them
    own = F.when(F.col("n") > 0, F.col("h")).otherwise(F.xxhash64("doc_id", "text_key", "line_no"))
    marked = lines.select("doc_id", "text_key", "line_no", F.when(F.col("n") > 0, F.col("n")).otherwise(-1).alias("n"), own.alias("h")).join(known, ["n", "h"], "left")
    place = F.struct("doc_id", "text_key", "line_no")
    matched = F.col("first").isNotNull() & ((F.col("first") < place) | F.coalesce("near", F.lit(False)))
    return marked.select("doc_id", "text_key", "line_no", F.when(F.col("n") > 0, matched).alias("gone"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """row (a struct of the document's columns as they were), text (the lines left), n_lines, n_removed and repeated for every document."""
    flags = flagged_lines(docs).groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set(F.struct("line_no", "gone"))).alias("flags"))
    keyed = docs.select(F.struct(*docs.columns).alias("row")).withColumn("key", F.xxhash64("row.text"))
    joined = keyed.join(flags, keyed["row.doc_id"].eqNullSafe(flags["doc_id"]) & (keyed["key"] == flags["text_key"]), "left")
    gone = lambda flag: F.coalesce(flag["gone"], F.lit(False))
    kept = F.filter(F.zip_with(F.split("row.text", "\n"), "flags", lambda line, flag: F.when(~gone(flag), line)), lambda line: line.isNotNull())
    text = F.when(F.col("flags").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n"))
    count = lambda x: F.when(F.col("flags").isNull(), 0).otherwise(F.size(x)).cast("long")
    removed = count(F.filter("flags", gone))
    left = F.coalesce(F.exists("flags", lambda flag: F.coalesce(~flag["gone"], F.lit(False))), F.lit(False))
    return joined.select("row", text.alias("text"), count(F.col("flags")).alias("n_lines"), removed.alias("n_removed"), ((removed > 0) & ~left).alias("repeated"))


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """Every document with the lines left in ``text``; the other columns as they were."""
    return dedup_lines(docs).select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])
