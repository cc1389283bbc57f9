"""Quality rules: repetition and length guards, then divergence from language references.

Everything runs as DataFrame expressions in one scan.  A text that passes the base rules
is compared with reference histograms of running prose by Jensen-Shannon distance (base 2,
the square root of the divergence): its character classes with those of the nearest
language, and its words with the common words of the nearest language or, in a language
without a list, with how often prose repeats its most frequent words.  Short texts are not
judged by a histogram they cannot fill.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import read, text_of

# Fixed values of the contract.
WHITE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

# Reference shares of character classes, measured on running prose of each language: lower
# case and other letters, capitals, digits, blanks, sentence punctuation, every other mark.
# The last is prose in a script without capitals and with full stops of its own.
CLASSES = ("letter", "capital", "digit", "blank", "stop", "mark")
PROSE = {
    "en": (0.7952, 0.0138, 0.0006, 0.1667, 0.0236, 0.0001),
    "fr": (0.7946, 0.0140, 0.0008, 0.1667, 0.0238, 0.0001),
    "de": (0.8103, 0.0128, 0.0004, 0.1546, 0.0218, 0.0001),
    "es": (0.8011, 0.0135, 0.0008, 0.1615, 0.0230, 0.0001),
    "caseless": (0.8200, 0.0010, 0.0005, 0.1700, 0.0080, 0.0005),
}
# Common words of each language by falling frequency, and what share of all words each has
# (measured; languages differ little in it).  What is left falls to all other words together.
COMMON_WORDS = {
    "en": ("the", "of", "and", "to", "a", "in", "is", "that", "it", "for"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich"),
    "es": ("de", "la", "que", "el", "en", "y", "los", "se", "las", "del"),
}
SHARES = (0.0625, 0.0368, 0.0259, 0.0202, 0.0161, 0.0138, 0.0119, 0.0104, 0.0091, 0.0084)

#: Largest distance of the character classes (of the nearest language), judged from MIN_CHARS
#: characters on.
MAX_CLASS_DISTANCE = 0.19
MIN_CHARS = 200
#: Largest distance of the common words of the nearest language, judged from MIN_COMMON_WORDS
#: words on.  A text that is beyond it for want of common words is in none of these languages,
#: or is no prose: then its own most frequent words are held against the same shares, rank by
#: rank, whatever words they are.  Prose of any language repeats a few short words; lists and
#: gibberish do not.
MAX_WORD_DISTANCE = 0.26
MAX_RANK_DISTANCE = 0.13
MIN_COMMON_WORDS = 100


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Maximal runs of characters other than blank and tab to carriage return."""
    inner = F.trim(text, F.lit(WHITE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, "[ \\t-\\r]+"))


def n_dup_lines(text: Column) -> Column:
    """Lines holding a word that equal an earlier line of the text."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.trim(x, F.lit(WHITE)) != "")
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def n_repeat_words(w: Column) -> Column:
    """Words that lie in a three-word window found twice or more in the text.

    Each window is a 64-bit hash of its words.  Sorted, equal neighbours are the repeated
    hashes; these are dealt into about sqrt(windows) bins, so finding the windows that hold
    one takes a look into one bin each and the work stays below the square of the length.
    The words covered are the steps between repeated places, at most three each."""
    hashes = F.transform(F.sequence(F.lit(1), F.size(w) - 2),
                         lambda i: F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)))

    def twice(h):
        pairs = let(F.sort_array(h), lambda s: F.zip_with(s, F.slice(s, 2, F.size(s)), lambda a, b: F.when(a == b, a)))
        return F.array_distinct(F.filter(pairs, lambda x: x.isNotNull()))

    def places(h, repeated):
        def found(bins):
            n = F.size(bins)
            return F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(F.element_at(bins, F.pmod(x, n).cast("int") + 1), x), i)),
                            lambda i: i.isNotNull())
        count = F.ceil(F.sqrt(F.size(h))).cast("int")
        return let(F.transform(F.sequence(F.lit(0), count - 1),
                               lambda k: F.filter(repeated, lambda x: F.pmod(x, count) == k)), found)

    def covered(at):
        steps = F.zip_with(at, F.slice(at, 2, F.size(at)), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, x: total + x)

    return (F.when(F.size(w) < 4, F.lit(0).cast("long"))
            .otherwise(let(hashes, lambda h: let(twice(h), lambda d: F.when(F.size(d) == 0, F.lit(0).cast("long"))
                                                 .otherwise(let(places(h, d), covered))))))


def js_distance(shares: Column, reference: Column) -> Column:
    """Jensen-Shannon distance (0 to 1) of two arrays of shares over the same cells."""
    def term(p, q):
        m = (p + q) / 2
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)
    total = F.aggregate(F.zip_with(shares, reference, term), F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def array_of(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def marked(text: Column) -> Column:
    """What is left of a text without letters (capitals stay) and blanks: one pass over the
    whole text, after which the class counts and the symbols are counted on the rest."""
    return F.regexp_replace(text, "[^\\p{Lu}\\x00-\\x08\\x0e-\\x1f!-@\\[-`{-\\x7f]+", "")


def kept_by(text: Column, pattern: str) -> Column:
    """Characters of the (short) text that the character class ``pattern`` names."""
    return F.char_length(F.regexp_replace(text, f"[^{pattern}]+", "")).cast("long")


def class_distance(c: Column) -> Column:
    """Distance of the character classes counted in ``c`` from the nearest prose; without characters 1."""
    n = c["n_chars"].cast("double")
    rest = c["n_chars"] - c["word_chars"]
    mark = c["n_marked"] - c["capital"] - c["digit"] - c["stop"]
    letter = c["word_chars"] - c["n_marked"]
    shares = F.array(*[x / n for x in (letter, c["capital"], c["digit"], rest, c["stop"], mark)])
    references = F.array(*[array_of(r) for r in PROSE.values()])
    nearest = let(shares, lambda s: F.array_min(F.transform(references, lambda r: js_distance(s, r))))
    return F.when(c["n_chars"] == 0, 1.0).otherwise(nearest)


def with_rest(shares: Column) -> Column:
    """Shares with what they leave of 1."""
    return F.concat(shares, F.array(F.lit(1.0) - F.aggregate(shares, F.lit(0.0), lambda a, x: a + x)))


def rank_distance(w: Column) -> Column:
    """Distance of a text's own most frequent words from the reference shares, rank by rank.

    Words are taken without marks at their ends and regardless of case.  In the sorted hashes
    a word's count is the distance between the places where one word ends and the next begins."""
    marks = F.lit(".,;:!?\"'()[]")
    hashes = F.sort_array(F.transform(w, lambda x: F.xxhash64(F.lower(F.trim(x, marks)))))

    def shares(h):
        ends = F.filter(F.transform(h, lambda x, i: F.when((i + 1 == F.size(h)) | (x != F.get(h, i + 1)), i + 1)), lambda i: i.isNotNull())
        counts = let(ends, lambda e: F.transform(e, lambda x, i: x - F.when(i == 0, F.lit(0)).otherwise(F.get(e, i - 1))))
        top = F.slice(F.concat(F.sort_array(counts, asc=False), F.array_repeat(F.lit(0), len(SHARES))), 1, len(SHARES))
        return F.transform(top, lambda c: c / F.size(h))

    return F.when(F.size(w) == 0, 1.0).otherwise(js_distance(let(let(hashes, shares), with_rest), let(array_of(SHARES), with_rest)))


def nearest_language(w: Column) -> Column:
    """struct(distance, share): distance of a text's common-word shares from the nearest
    language reference, and what share of the words are common ones of that language.

    The common words a text holds are joined with two blanks, so taking one blank from
    each place of a word shortens that string by its count."""
    listed = sorted({x for common in COMMON_WORDS.values() for x in common})
    held = F.filter(w, lambda x: x.isin([*listed, *(x.capitalize() for x in listed)]))
    line = F.concat(F.lit("  "), F.lower(F.array_join(held, "  ")), F.lit("  "))
    languages = F.array(*[array_of(listed.index(x) + 1 for x in common) for common in COMMON_WORDS.values()])

    def judge(c):
        counts = F.transform(array_of(listed), lambda x: F.octet_length(c["line"]) - F.octet_length(
            F.replace(c["line"], F.concat(F.lit(" "), x, F.lit(" ")), F.concat(F.lit(" "), x))))

        def one(shares):
            return F.struct(js_distance(shares, let(array_of(SHARES), with_rest)).alias("distance"), (1.0 - F.element_at(shares, -1)).alias("share"))
        return let(counts, lambda k: F.array_min(F.transform(languages, lambda at: let(
            let(F.transform(at, lambda i: F.element_at(k, i) / c["n"]), with_rest), one))))

    return F.when(F.size(w) == 0, F.struct(F.lit(1.0).alias("distance"), F.lit(0.0).alias("share"))).otherwise(
        let(F.struct(F.size(w).cast("double").alias("n"), line.alias("line")), judge))


def score_rules(docs: DataFrame, text: str = "text", out: str = "rules") -> DataFrame:
    """``docs`` with a struct column ``out``: counts, distances, base_failed and kept.

    A NULL or empty text has no words and fails; columns of ``docs`` stay as they are (one
    already named ``out`` is replaced).  Row-local: one scan, no shuffle.  ``rank_distance`` is
    NULL where the common words of a language decide, or the text is too short."""
    t = text_of(text)

    def judge(c, class_far):
        base_failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])
        far = (((c["n_chars"] >= MIN_CHARS) & (class_far > MAX_CLASS_DISTANCE))
               | F.coalesce(c["rank_distance"] > MAX_RANK_DISTANCE, F.lit(False)))
        return F.struct(*[c[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
                        class_far.alias("class_distance"), c["nearest"]["distance"].alias("word_distance"), c["rank_distance"].alias("rank_distance"), base_failed.alias("base_failed"), (~base_failed & ~far).alias("kept"))

    def counted(x):
        return lambda w: let(marked(x), lambda m: let(F.struct(
            F.size(w).cast("long").alias("n_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.char_length(x).cast("long").alias("n_chars"), F.char_length(m).cast("long").alias("n_marked"),
            kept_by(m, "\\p{Lu}").alias("capital"), kept_by(m, "0-9").alias("digit"), kept_by(m, ".,;:!?").alias("stop"),
            kept_by(m, SYMBOLS).alias("n_symbols"), n_dup_lines(x).alias("n_dup_lines"),
            n_repeat_words(w).alias("n_repeat_words"), nearest_language(w).alias("nearest")),
            lambda c: let(ranked(c, w), lambda c: let(class_distance(c), lambda far: judge(c, far)))))

    def ranked(c, w):
        judged = ((c["n_words"] >= MIN_COMMON_WORDS) & (c["nearest"]["distance"] > MAX_WORD_DISTANCE)
                  & (c["nearest"]["share"] < sum(SHARES)))
        return c.withField("rank_distance", F.when(judged, rank_distance(w)))

    return docs.withColumn(out, let(t, lambda x: let(words(x), counted(x))))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_rules(read(spark, sf_dir, "documents").select("doc_id", "text"))
    # a generator keeps the scored row whole, so each field is not computed anew
    return scored.select("doc_id", F.inline(F.array("rules"))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("class_distance", 6).alias("class_distance"), F.round("word_distance", 6).alias("word_distance"),
        F.round("rank_distance", 6).alias("rank_distance"))
