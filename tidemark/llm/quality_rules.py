"""Quality rules by distribution divergence, in SQL functions only.

*Base rules.* A text with under 10 words, or with more than 20 % of its words
in 5-word windows that occur again in it, fails.

*Divergence.* Each document has a histogram of character classes and one of
its language's commonest function words. The language's reference histograms
are the sums over all documents of that ``lang``. A document goes if its
Jensen-Shannon distance (base 2, 0 to 1) to the reference is above the
threshold and it is long enough for the histogram to mean something: short
documents are judged by the base rules alone. A document of enough words is
also compared with all its other words as one more bin, so that one in which
the function words are missing is far from its language.

*Scale.* Two scans and no shuffle but of one partial sum per language. All
measures of a text are computed within its row; references come back by a
broadcast join after their number is checked.

Defined cases: a null text is an empty one and fails; a null or unknown
language has the reference of its own documents, without function words; a very
long text is measured whole, in its row; repeated rows are judged each, and
nothing depends on ties; on an empty table the result is empty. Columns named
like an added one are replaced, others may have any name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, small_side, word_count

# Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the of and to in a is that for it as was",
    "de": "der die und in den von zu das mit sich des auf",
    "fr": "de la le et les des en un du une que est",
    "es": "de la que el en y a los del se las por",
}
N_WORDS = 12

#: Distances above these reject, given at least so many characters or words.
MOST_CHAR_DISTANCE = 0.28
MOST_WORD_DISTANCE = 0.42
LEAST_CHARS = 200
LEAST_WORDS = 200
#: The same with all other words as a bin, where a text without function words is at about 0.30.
MOST_MISSING = 0.20

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE_CLASS + "+"), lambda w: w != "")


def _repeat_words(words: Column) -> Column:
    """Words inside 5-word windows that occur at least twice."""

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, i: F.least(F.lit(5), F.coalesce(F.get(places, i + 1), p + 5) - p))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def twice(pairs: Column) -> Column:
        same = F.filter(pairs, lambda x, i: (F.get(pairs, i - 1)["h"] == x["h"]) | (F.get(pairs, i + 1)["h"] == x["h"]))
        return let(F.sort_array(F.transform(same, lambda x: x["p"])), covered)

    def windows(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(pairs, twice))

    def hashed(h: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.size(h) - 5), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(5)]))
        return F.when(F.size(h) < 6, F.lit(0)).otherwise(let(grams, windows))

    return let(F.transform(words, lambda w: F.xxhash64(w)), hashed)


def _repeat_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def _char_histogram(text: Column) -> Column:
    """Spaces, capitals, sentence marks, symbols, letters beyond ASCII, all else."""
    known = [
        _count(text, SPACE_CLASS),
        _count(text, "[A-Z]"),
        _count(text, "[.,;:?'()-]"),
        _count(text, r"[!\"#*$%&|<>@+=_~^\[\]{}/\\]"),
        (F.octet_length(text) - F.char_length(text)).cast("long"),
    ]
    return let(F.array(*known), lambda a: F.array_append(a, F.greatest(F.lit(0), F.char_length(text) - F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y))))


def _word_histogram(text: Column, lang: Column) -> Column:
    """Function words of the language, then all other words."""
    lists = F.create_map(*[F.lit(x) for k, v in FUNCTION_WORDS.items() for x in (k, v)])
    mine = F.split(F.coalesce(F.try_element_at(lists, lang), F.lit("")), " ")

    def counts(hits: Column, of: Column) -> Column:
        return F.transform(of, lambda w: F.size(F.filter(hits, lambda x: x == w)).cast("long"))

    def histogram(of: Column) -> Column:
        found = lambda words: let(F.filter(words, lambda w: F.array_contains(of, w)), lambda hits: F.array_append(counts(hits, of), (F.size(words) - F.size(hits)).cast("long")))
        return let(_words(text), found)

    return F.when(lang.isin(*FUNCTION_WORDS), let(mine, histogram)).otherwise(F.array_repeat(F.lit(0).cast("long"), N_WORDS + 1))


def _shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, b: a + b)
    return let(total, lambda t: F.transform(counts, lambda c: F.when(t > 0, c / t).otherwise(F.lit(0.0))))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms, base 2; null if one of them is empty."""

    def half(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(F.lit(2.0) * a / (a + b))).otherwise(F.lit(0.0))

    terms = F.zip_with(_shares(p), _shares(q), lambda a, b: F.lit(0.5) * (half(a, b) + half(b, a)))
    total = F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)
    size = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    return F.when((size(p) > 0) & (size(q) > 0), F.sqrt(F.greatest(F.lit(0.0), total)))


def references(docs: DataFrame) -> DataFrame:
    """``lang, ref_chars, ref_words``: the summed histograms of all documents of a language."""
    text = F.coalesce(F.col("text"), F.lit(""))
    seen = docs.select("lang", _char_histogram(text).alias("c"), _word_histogram(text, F.col("lang")).alias("w"))
    sums = [F.sum(F.get("c", F.lit(i))).alias(f"c{i}") for i in range(6)] + [F.sum(F.get("w", F.lit(i))).alias(f"w{i}") for i in range(N_WORDS + 1)]
    return seen.groupBy("lang").agg(*sums).select(
        F.col("lang").alias("__lang"), F.array(*[f"c{i}" for i in range(6)]).alias("ref_chars"), F.array(*[f"w{i}" for i in range(N_WORDS + 1)]).alias("ref_words")
    )


def assess(docs: DataFrame) -> DataFrame:
    """``docs`` with the measures, ``base_failed``, both distances and ``kept``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    refs = small_side(references(docs))
    keep = [c for c in docs.columns if c not in {*MEASURES, "char_distance", "word_distance", "kept"}]
    common = lambda w: F.slice(w, 1, N_WORDS)
    measured = docs.select(
        F.struct(*keep).alias("row"),
        word_count(text).alias("n_words"),
        (F.char_length(text) - _count(text, SPACE_CLASS)).cast("long").alias("word_chars"),
        _count(text, r"[#*$%&|<>]").alias("n_symbols"),
        _repeat_lines(text).cast("long").alias("n_dup_lines"),
        let(_words(text), _repeat_words).cast("long").alias("n_repeat_words"),
        _char_histogram(text).alias("__c"),
        _word_histogram(text, F.col("lang")).alias("__w"),
        F.char_length(text).alias("__n"),
        F.col("lang").alias("own_lang"),
    )
    judged = (
        measured.join(refs, F.col("own_lang").eqNullSafe(F.col("__lang")), "left")
        .withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
        .withColumn("char_distance", js_distance(F.col("__c"), F.col("ref_chars")))
        .withColumn("word_distance", js_distance(common(F.col("__w")), common(F.col("ref_words"))))
    )
    missing = F.coalesce(js_distance(F.col("__w"), F.col("ref_words")), F.lit(0.0))
    far = ((F.col("__n") >= LEAST_CHARS) & (F.coalesce("char_distance", F.lit(0.0)) > MOST_CHAR_DISTANCE)) | (
        (F.col("n_words") >= LEAST_WORDS) & ((F.coalesce("word_distance", F.lit(0.0)) > MOST_WORD_DISTANCE) | (missing > MOST_MISSING))
    )
    return judged.withColumn("kept", ~F.col("base_failed") & ~far).select("row.*", *MEASURES, "char_distance", "word_distance", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their columns as they are."""
    return assess(docs.select(F.struct(*docs.columns).alias("whole"), "text", "lang")).filter("kept").select("whole.*")
