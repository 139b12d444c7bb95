"""Quality rules by divergence from language references, in DataFrame operations only.

Each document has two histograms: of character classes, and of its language's commonest function words among its
words. The reference of a language is the sum of the histograms of all its documents that pass the base rules; a
document is rejected when the Jensen-Shannon distance of either histogram from its reference is above a limit. Short
documents have noisy histograms: below a minimum length a distance says nothing and rejects nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column_names, saved

#: Common function words of the languages that have a word reference.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "on", "with"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un"],
}
#: Limits of the distances (0 to 1), and the words and characters that a document needs for them to count.
MOST_CHARS, MOST_WORDS, LEAST_WORDS, LEAST_CHARS = 0.30, 0.29, 60, 200
SHINGLE = 5


def _count(text: Column, pattern: str) -> Column:
    """Characters of a class in a text; few of a text's characters should be in it."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _covered(starts: Column, width: int) -> Column:
    """Places covered by runs of width from each of the sorted starts."""
    gaps = F.zip_with(starts, F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(width)), F.lit(width)))
    return F.aggregate(gaps, F.lit(0), lambda acc, x: acc + x)


def features(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the counts of the base rules, and the two histograms of each row's whole text (null: empty).

    Windows are compared by a 64-bit hash of their words' 64-bit hashes. Each step is a projection of its own that
    later ones read several times, so that none is computed again within another.
    """
    raw = column_names(docs, "doc_id", "text", *(["lang"] if "lang" in docs.columns else []))
    if "lang" not in raw.columns:
        raw = raw.withColumn("lang", F.lit(None).cast("string"))
    t = raw.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("words", F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    t = t.select("doc_id", "lang", "text", "words", lines.alias("lines"), F.size("words").alias("n"))
    t = t.select(
        "doc_id", "lang", "n",
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        _count(F.col("text"), r"[#*$%&|<>]+").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.length("text").alias("chars"),
        _count(F.col("text"), r"\p{Lu}+").alias("upper"), _count(F.col("text"), r"[0-9]+").alias("digits"), _count(F.col("text"), r"[\p{P}\p{S}]+").alias("marks"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
        _common("lang", "words").alias("common"),
    )
    window = F.transform(F.sequence(F.lit(0), F.col("n") - SHINGLE), lambda i: F.xxhash64(*(F.get("hashes", i + j) for j in range(SHINGLE))))
    t = t.withColumn("windows", F.when(F.col("n") >= SHINGLE, window).otherwise(F.array().cast("array<bigint>"))).drop("hashes")
    t = t.withColumn("again", F.size(F.array_distinct("windows")) < F.size("windows"))
    ranked = F.when(F.col("again"), F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    t = t.withColumn("ranked", ranked).drop("windows", "again")
    twice = F.filter("ranked", lambda x, k: x["h"].eqNullSafe(F.get("ranked", k - 1)["h"]) | x["h"].eqNullSafe(F.get("ranked", k + 1)["h"]))
    t = t.withColumn("starts", F.array_sort(F.transform(twice, lambda x: x["i"]))).drop("ranked")
    white = F.col("chars") - F.col("word_chars")
    rest = F.col("word_chars") - F.col("upper") - F.col("digits") - F.col("marks")
    kinds = F.array(*(F.greatest(c.cast("double"), F.lit(0.0)) for c in (F.col("upper"), F.col("digits"), F.col("marks"), white, rest)))
    listed = _by_lang("lang", lambda ws: F.array(*(_times("common", w) for w in ws)))
    t = t.withColumn("counts", listed)
    return t.select(
        "doc_id", "lang", F.col("n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", _covered(F.col("starts"), SHINGLE).cast("long").alias("n_repeat_words"), F.col("chars").cast("long").alias("chars"),
        kinds.alias("kinds"), F.concat("counts", F.array((F.col("n") - F.size("common")).cast("double"))).alias("counts"),
    )


def _by_lang(lang: str, make) -> Column:
    out = None
    for code, words in COMMON_WORDS.items():
        out = (F if out is None else out).when(F.col(lang) == code, make(words))
    return out


def _times(words: str, word: str) -> Column:
    return F.size(F.filter(words, lambda w: F.lower(w) == F.lit(word))).cast("double")


def _common(lang: str, words: str) -> Column:
    """The words that are common ones of the row's language; null for other languages."""
    return _by_lang(lang, lambda ws: F.filter(words, lambda w: F.lower(w).isin(*ws)))


def js_distance(counts: Column, others: Column) -> Column:
    """Jensen-Shannon distance (0 to 1) of two histograms of counts; null if either is empty."""

    def shares(c: Column) -> Column:
        total = F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
        return F.when(total > 0, F.transform(c, lambda x: x / total))

    def part(p: Column, q: Column) -> Column:
        return F.when(p > 0, p * F.log2(p * 2.0 / (p + q))).otherwise(0.0)

    terms = F.zip_with(shares(counts), shares(others), lambda p, q: part(p, q) + part(q, p))
    # greatest() passes over nulls, which must stay.
    return F.when(terms.isNotNull(), F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2.0, F.lit(0.0))))


def quality_rules(docs: DataFrame, most_chars: float = MOST_CHARS, most_words: float = MOST_WORDS, least_words: int = LEAST_WORDS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, char_distance, word_distance.

    One row for each row of docs. base_failed: fewer than 10 words, or over a fifth of the words in repeated 5-word
    windows. A null or empty text has no words and fails. Languages are those of the column lang (null is one of its
    own); those without a word list, and documents below the minimum lengths, have the rules left that apply.
    """
    f = saved(features(docs), "features")
    f = f.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    bins = {"kinds": 5, "counts": len(COMMON_WORDS["en"]) + 1}
    sums = [F.sum(F.get(c, F.lit(i))).alias(f"{c}{i}") for c, n in bins.items() for i in range(n)]
    refs = f.filter("not base_failed").groupBy("lang").agg(*sums)
    refs = refs.select(F.col("lang").alias("of"), *(F.array(*(F.coalesce(f"{c}{i}", F.lit(0.0)) for i in range(n))).alias(f"{c}_ref") for c, n in bins.items()))
    j = f.join(refs, F.col("lang").eqNullSafe(F.col("of")), "left")
    j = j.withColumn("char_distance", F.when(F.col("chars") >= least_chars, js_distance(F.col("kinds"), F.col("kinds_ref"))))
    j = j.withColumn("word_distance", F.when(F.col("n_words") >= least_words, js_distance(F.col("counts"), F.col("counts_ref"))))
    odd = F.coalesce(F.col("char_distance") > most_chars, F.lit(False)) | F.coalesce(F.col("word_distance") > most_words, F.lit(False))
    return j.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~odd).alias("kept"), "char_distance", "word_distance")
