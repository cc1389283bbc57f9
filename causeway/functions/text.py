"""Text column expressions: cleaning predicates (B1-B13), normalisation (C1),
thread keys (C2), date rendering (C3) and term matching (B10/B11).

All of these are JVM-side expressions, so they stay inside whole-stage codegen
and are evaluated where the data sits (no Python in the hot path).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from causeway.functions.arrays import let

# Tombstones, the HTML entities unescaped (in this order), the word-break
# window and the minimum comment length of the curation rules.
TOMBSTONES = ("[deleted]", "[removed]")
ENTITIES = (("&gt;", ">"), ("&lt;", "<"), ("&amp;", "&"))
WORD_BREAK_WINDOW = 2048
MIN_COMMENT_WORDS = 10
MIN_ALPHA_RATIO = 0.5
DATE_FORMAT = "MMMM dd, yyyy"       # e.g. "November 22, 2022" (UTC)

# The characters Python's str.split()/str.strip() treat as whitespace.
PY_WHITESPACE = (" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
                 "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
# the same set as a regex class of ranges written with \x{..} escapes (Java and RE2 both
# accept them; ranges keep the class a few nodes, which matters for regex speed)
WS_CLASS = ("\\x{9}-\\x{D}\\x{1C}-\\x{20}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}"
            "\\x{202F}\\x{205F}\\x{3000}")
WS = "[" + WS_CLASS + "]"
NON_WS = "[^" + WS_CLASS + "]"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalise(c) -> Column:
    """Unescape &gt; &lt; &amp; (in order), newline/tab -> space, strip."""
    x = _col(c)
    # plain byte searches, several times faster than a character-wise translate
    for ent, ch in (*ENTITIES, ("\n", " "), ("\t", " ")):
        x = F.replace(x, F.lit(ent), F.lit(ch))
    return strip(x)


def strip(c) -> Column:
    """Python ``str.strip()``: trim the whitespace character set from both ends
    (a character-set trim, no regex)."""
    return F.trim(_col(c), F.lit(PY_WHITESPACE))


_WS_OTHER = PY_WHITESPACE.replace(" ", "")


def word_count(c) -> Column:
    """Number of whitespace-separated words (Python ``len(s.split())``): every
    whitespace character is first mapped to a space by ``translate`` (one cheap
    pass), then runs of non-spaces are counted -- several times faster than one
    regex with a large Unicode class."""
    return F.regexp_count(F.translate(_col(c), _WS_OTHER, " " * len(_WS_OTHER)), F.lit("[^ ]+"))


def sql_word_count(e: str) -> str:
    """The same count as DuckDB SQL text (oracle side)."""
    frm = " || ".join(f"chr({ord(ch)})" for ch in _WS_OTHER)
    return f"len(regexp_extract_all(translate({e}, {frm}, repeat(' ', {len(_WS_OTHER)})), '[^ ]+'))"


def letter_count(c) -> Column:
    return F.length(F.regexp_replace(_col(c), "[^\\p{L}]+", ""))


def not_tombstone(c) -> Column:
    """B3"""
    return ~_col(c).isin(*TOMBSTONES)


def long_enough(c, min_words: int = MIN_COMMENT_WORDS) -> Column:
    """B4 (comments only).  One anchored match without backtracking: it ends at the last word
    that is needed, or at the end of the text."""
    rest = "" if min_words < 2 else f"(?:{NON_WS}++{WS}++){{{min_words - 1}}}"
    return F.lit(True) if min_words < 1 else _col(c).rlike(f"^{WS}*+{rest}{NON_WS}")


def human_author(c) -> Column:
    """Author does not contain 'bot' (case-folded); NULL authors are dropped."""
    return F.coalesce(~F.lower(_col(c)).contains("bot"), F.lit(False))


def has_word_break(norm: Column, window: int = WORD_BREAK_WINDOW) -> Column:
    """B6 on normalised text: a space within the first ``window`` characters."""
    return F.instr(F.substring(norm, 1, window), " ") > 0


def alpha_ratio_ok(norm: Column, ratio: float = MIN_ALPHA_RATIO) -> Column:
    """B7 on normalised text: letters / length >= ratio (spaces count in the length)."""
    n = F.length(norm)
    return F.coalesce((n > 0) & (letter_count(norm) >= F.lit(ratio) * n), F.lit(False))


def thread_key(permalink, is_comment: bool) -> Column:
    """Title-slug segment of a permalink (-2 for submissions, -3 for comments)."""
    idx = -3 if is_comment else -2
    return F.try_element_at(F.split(_col(permalink), "/"), F.lit(idx))


def utc_date(epoch_seconds) -> Column:
    """Epoch seconds -> 'Month DD, YYYY' in UTC (session time zone must be UTC)."""
    return F.date_format(F.timestamp_seconds(_col(epoch_seconds)), DATE_FORMAT)


def strict_yes(answer) -> Column:
    """The lower-cased answer is exactly 'yes'."""
    return F.lower(_col(answer)) == F.lit("yes")


def lenient_yes(answer) -> Column:
    """Contains 'yes' and does not contain 'no'."""
    a = F.lower(_col(answer))
    return a.contains("yes") & ~a.contains("no")


def _haystack(text_cols) -> Column:
    return F.lower(F.concat_ws("\u0001", *[F.coalesce(_col(c), F.lit("")) for c in text_cols]))


def matched_terms(text_cols, terms) -> Column:
    """Sorted distinct list of terms that occur (case-folded substring) in any
    of ``text_cols``.  Every term is tested on its own, so overlapping terms
    ("topama", "topamax") are all reported."""
    terms = sorted({t.lower() for t in terms})
    arr = F.array(*[F.lit(t) for t in terms])
    return let(_haystack(text_cols), lambda hay: F.filter(arr, lambda t: F.instr(hay, t) > 0))


def _trie_pattern(terms) -> str:
    """A pattern for the longest of ``terms`` that starts at a place: common prefixes are
    tried once, and longer continuations before shorter ones."""
    trie: dict = {}
    for t in terms:
        node = trie
        for ch in t:
            node = node.setdefault(ch, {})
        node[""] = {}

    def spell(node):
        parts = [f"\\x{{{ord(ch):x}}}" + spell(below) for ch, below in sorted(node.items()) if ch]
        if not parts:
            return ""
        body = parts[0] if len(parts) == 1 and "" not in node else "(?:" + "|".join(parts) + ")"
        return body + "?+" if "" in node else body
    return spell(trie)


def matched_terms_one_pass(text_cols, terms) -> Column:
    """B10/B11 for large lexicons, the same list as ``matched_terms`` from one pass.

    A zero-width look-ahead finds, at every place, the longest term that starts there; every
    other term that starts there is one of its prefixes, so a map from each term to the terms
    that are its prefixes completes the list."""
    terms = sorted({t.lower() for t in terms})
    always = [t for t in terms if not t]                        # the empty term is in every text
    terms = [t for t in terms if t]
    if not terms:
        return F.array(*[F.lit(t) for t in always]).cast("array<string>")
    # the first characters guard the look-ahead, so most places cost one test
    first = "".join(sorted({f"\\x{{{ord(t[0]):x}}}" for t in terms}))
    found = F.regexp_extract_all(_haystack(text_cols), F.lit(f"(?=[{first}])(?=({_trie_pattern(terms)}))"), 1)
    prefixes = F.create_map(*[x for t in terms for x in (F.lit(t), F.array(*[F.lit(q) for q in terms if t.startswith(q)]))])
    kinds = let(F.array_distinct(found), lambda f: F.flatten(F.transform(f, lambda t: F.element_at(prefixes, t))))
    return F.array_sort(F.array_distinct(F.concat(kinds, F.array(*[F.lit(t) for t in always]).cast("array<string>"))))


def mention_terms(text_cols, terms, method: str = "scan") -> Column:
    """The term matcher: 'scan' tests each term on its own, 'one_pass' all of them together."""
    return matched_terms_one_pass(text_cols, terms) if method == "one_pass" else matched_terms(text_cols, terms)


