"""Quality rules: how far a document's histograms lie from those of its language.

Each document has a histogram of character classes and one of its language's common words. References are the summed
histograms of all documents of a language that pass the base rules; the Jensen-Shannon distance (base 2, from 0 to 1) between document and
reference decides, for documents long enough that a distance means something. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, stored, whole

#: The most common words of each language that has a reference.
COMMON_WORDS = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "en": "the of and to in is that it for on with as was be by are this at from or".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al".split(),
    "fr": "de la le les et des en un une du que est pour qui dans sur par au avec ne".split(),
}
SYMBOLS = "#*$%&|<>"
PUNCTUATION = ".,;:!?'\"()-"
WHITE = " \t\n\x0b\x0c\r"
CLASSES = ["lower", "upper", "letter", "digit", "white", "punctuation", "symbol", "rest"]
N_COMMON = 20
#: Base rules.
MIN_WORDS, MAX_REPEATED = 50, 50
#: Distances above these reject a document of at least MIN_WORDS words. Short documents scatter more: the word distance
#: may also reach SCATTER[0] + SCATTER[1] / sqrt(words).
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE, SCATTER = 0.28, 0.22, (0.13, 1.55)


def _removed(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def features(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, class_counts and word_counts (arrays).

    A null text has no words, lines or characters. Words are runs of other than ASCII white space. A column of docs
    that bears one of these names is replaced.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.withColumn("_words", F.filter(F.split(text, SPACE), lambda w: w != ""))
    rows = rows.withColumn("n_words", F.size("_words").cast("long"))
    lines = F.filter(F.split(text, "\n"), lambda x: _removed(x, WHITE) != "")
    rows = rows.withColumn("_lines", lines)
    rows = rows.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    # Three-word windows as hashes with their places, sorted: equal windows become neighbours.
    rows = rows.withColumn("_n", F.greatest(F.col("n_words").cast("int") - 2, F.lit(0)))
    pairs = F.zip_with(F.slice("_words", 1, F.col("_n")), F.slice("_words", 2, F.col("_n")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    windows = F.zip_with(pairs, F.slice("_words", 3, F.col("_n")), lambda p, c: F.xxhash64(p["a"], p["b"], c))
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("_sorted", placed)
    ahead = F.slice("_sorted", 2, F.greatest(F.col("_n") - 1, F.lit(0)))
    twins = F.filter(
        F.zip_with(F.slice("_sorted", 1, F.greatest(F.col("_n") - 1, F.lit(0))), ahead, lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))),
        lambda x: x.isNotNull(),
    )
    covered = F.array_distinct(F.flatten(F.transform(F.array_distinct(F.flatten(twins)), lambda i: F.array(i, i + 1, i + 2))))
    rows = rows.withColumn("n_repeat_words", F.size(covered).cast("long"))
    # Character classes by what their removal leaves; each step works on the shorter remainder.
    rows = rows.withColumn("_chars", F.length(text).cast("long")).withColumn("_a", F.regexp_replace(text, r"\p{Ll}+", ""))
    rows = rows.withColumn("_b", _removed(F.col("_a"), WHITE)).withColumn("_c", _removed(F.col("_b"), SYMBOLS)).withColumn("_d", _removed(F.col("_c"), PUNCTUATION))
    rows = rows.withColumn("_e", F.regexp_replace("_d", r"\p{Lu}+", "")).withColumn("_f", F.regexp_replace("_e", r"\p{L}+", "")).withColumn("_g", F.regexp_replace("_f", r"\p{N}+", ""))
    size = {k: F.length(f"_{k}").cast("long") for k in "abcdefg"}
    rows = rows.withColumn("n_symbols", size["b"] - size["c"]).withColumn("word_chars", F.col("_chars") - size["a"] + size["b"])
    counts = [F.col("_chars") - size["a"], size["d"] - size["e"], size["e"] - size["f"], size["f"] - size["g"], size["a"] - size["b"], size["c"] - size["d"], F.col("n_symbols"), size["g"]]
    rows = rows.withColumn("class_counts", F.array(*counts))
    found = F.lit("")
    for lang, common in COMMON_WORDS.items():
        listed = F.array(*map(F.lit, common))
        places = F.filter(F.transform("_words", lambda w: F.array_position(listed, F.lower(w))), lambda k: k > 0)  # noqa: B023
        found = F.when(F.col("lang") == lang, F.array_join(F.transform(places, lambda k: F.char(k + 64)), "")).otherwise(found)
    rows = rows.withColumn("_found", found)
    each = [F.length("_found") - F.length(F.replace("_found", F.lit(chr(65 + k)), F.lit(""))) for k in range(N_COMMON)]
    rows = rows.withColumn("word_counts", F.array(*[x.cast("long") for x in each], F.col("n_words") - F.length("_found")))
    return rows.drop("_words", "_lines", "_n", "_sorted", "_chars", *[f"_{k}" for k in "abcdefg"], "_found")


def _reference(rows: DataFrame, column: str, bins: int) -> Column:
    return F.array(*[F.sum(F.col(column)[k]) for k in range(bins)]).alias(f"_ref_{column}")


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two arrays of counts of one length; null if either has no counts."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    shares = lambda x: F.transform(x, lambda v: F.try_divide(v.cast("double"), total(x)))
    part = lambda a, b: F.when(a > 0, a * F.ln(2 * a / (a + b))).otherwise(0.0)
    terms = F.zip_with(shares(p), shares(q), lambda a, b: part(a, b) + part(b, a))
    return F.sqrt(F.greatest(total(terms), F.lit(0.0)) / (2 * F.ln(F.lit(2.0))))


def _judged(rows: DataFrame, min_words: int, max_repeated: int, max_class: float, max_word: float) -> DataFrame:
    """Stored rows of features() with base_failed, class_distance, word_distance and kept."""
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeated * F.col("n_words"))
    refs = rows.where(F.col("lang").isin(*COMMON_WORDS) & ~failed).groupBy("lang").agg(_reference(rows, "class_counts", len(CLASSES)), _reference(rows, "word_counts", N_COMMON + 1))
    # One row per language of COMMON_WORDS, however large the corpus.
    rows = rows.join(F.broadcast(refs), "lang", "left")
    rows = rows.withColumn("class_distance", js_distance(F.col("class_counts"), F.col("_ref_class_counts")))
    rows = rows.withColumn("word_distance", js_distance(F.col("word_counts"), F.col("_ref_word_counts")))
    allowed = F.greatest(F.lit(max_word), SCATTER[0] + SCATTER[1] / F.sqrt(F.greatest(F.col("n_words"), F.lit(1))))
    far = F.coalesce((F.col("class_distance") > max_class) | (F.col("word_distance") > allowed), F.lit(False))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & ~far)


def judge(docs: DataFrame, min_words: int = MIN_WORDS, max_repeated: int = MAX_REPEATED, max_class: float = MAX_CLASS_DISTANCE, max_word: float = MAX_WORD_DISTANCE) -> DataFrame:
    """doc_id, the base features, base_failed, class_distance, word_distance and kept for every row of docs.

    base_failed: fewer than min_words words, or more than max_repeated per cent of them in repeated three-word
    windows. kept is false for those, and for documents whose distance exceeds max_class or max_word. A document in a
    language without a reference (null included, or no document of it passes the base rules) has null distances and is
    judged by the base rules alone. Repeated rows and null doc_ids give a row each; an empty table gives an empty result.
    Other columns than doc_id, text and lang are not read.
    """
    rows = stored(features(docs.select("doc_id", "text", "lang")).drop("text"), "quality")
    rows = _judged(rows, min_words, max_repeated, max_class, max_word)
    for name in ("class_distance", "word_distance"):
        rows = rows.withColumn(name, F.round(name, 9))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept")


def keep_documents(docs: DataFrame, min_words: int = MIN_WORDS, max_repeated: int = MAX_REPEATED, max_class: float = MAX_CLASS_DISTANCE, max_word: float = MAX_WORD_DISTANCE) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns; the text rides along, so nothing is joined back."""
    rows = stored(features(docs.select("text", "lang", whole(docs).alias("doc"))).drop("text"), "quality")
    return _judged(rows, min_words, max_repeated, max_class, max_word).where("kept").select("doc.*")
