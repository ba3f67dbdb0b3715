"""Column expressions for the word rules (all JVM-side, codegen-friendly).

Every function takes and returns ``Column``s; nothing here runs Python per row (:func:`rebuilt` runs Arrow kernels per batch).
The character classes reproduce Python's ``str`` semantics with Java regexes:

* word character = Python ``\\w`` = letter, number or underscore.  Java's ``\\w``
  is ASCII-only and ``(?U)\\w`` also accepts combining marks, so the class is
  spelled out.
* whitespace = what ``str.split()`` / ``str.strip()`` treat as space.
* case tests = ``str.isupper()``, ``str.istitle()``, ``str.islower()``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Character classes equal to Python's str rules.
WORD_CHARS = r"\p{L}\p{N}_"
WHITESPACE = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
UPPER = r"\p{IsUppercase}"
LOWER = r"\p{IsLowercase}"
TITLE = r"\p{Lt}"
CASED = UPPER + TITLE + LOWER

NON_WORD = f"[^{WORD_CHARS}]"
# Leading run, or the trailing run that starts right after a word character
# (the look-behind keeps the scan linear on long inner punctuation runs).
_EDGE_NON_WORD = f"^{NON_WORD}++|(?<=[{WORD_CHARS}]){NON_WORD}++$"
# The same whitespace as plain characters, for trimming without a regex, and split by how common it is.
WHITESPACE_CHARS = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
ASCII_WHITESPACE = r"[ \t-\r\x1c-\x1f]"
# One bit table and one range, which Java tests fast, then the class itself where that matched.
OTHER_WHITESPACE = r"[\x85\u00a0\u1680-\u3000](?<=[\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000])"

# A run of any of it, each character tested the same way.
_ANY_WHITESPACE = rf"[ \t-\r\x1c-\x1f\x85\u00a0\u1680-\u3000](?<={WHITESPACE})"
WHITESPACE_RUN = f"{_ANY_WHITESPACE}(?:{_ANY_WHITESPACE})*+"

IS_UPPER = f"^[^{LOWER}{TITLE}]*{UPPER}[^{LOWER}{TITLE}]*$"
IS_LOWER = f"^[^{UPPER}{TITLE}]*{LOWER}[^{UPPER}{TITLE}]*$"
# Title case by what must not be in it: a repeated group would recurse on long tokens.
HAS_CASED = f"[{CASED}]"
NOT_TITLE = f"(?:^|[^{CASED}]){LOWER}|[{CASED}][{UPPER}{TITLE}]"

STRETCH_RUN = r"(.)\1{2,}"


def strip_ws(text: Column) -> Column:
    """``str.strip()``: remove Python whitespace at both ends."""
    return F.btrim(text, F.lit(WHITESPACE_CHARS))


def split_words(text: Column) -> Column:
    """``str.split()`` as an array; null text gives null, blank text ``[""]``.

    Java tests every character against a class; the class of ASCII whitespace is a bit table, so only
    texts that hold other whitespace are split by the whole class.
    """
    core = strip_ws(text)
    other = (F.length(text) != F.octet_length(text)) & text.rlike(OTHER_WHITESPACE)
    return F.when(other, F.split(core, f"{WHITESPACE}+")).otherwise(F.split(core, f"{ASCII_WHITESPACE}+"))


def collapse_ws(text: Column) -> Column:
    """``' '.join(text.split())`` for a non-null text."""
    return F.array_join(split_words(text), " ")


def is_blank(text: Column) -> Column:
    """True when the text is null or holds only Python whitespace (decided at the first other character)."""
    return text.isNull() | ~text.rlike(f"[^{WHITESPACE[1:-1]}]")


def clean_word(word: Column) -> Column:
    """Lower-case, then drop leading and trailing non-word characters."""
    return F.regexp_replace(F.lower(word), _EDGE_NON_WORD, "")


def word_core(word: Column) -> Column:
    """The word without its leading and trailing non-word characters (case kept)."""
    return F.regexp_replace(word, _EDGE_NON_WORD, "")


def word_prefix(word: Column) -> Column:
    return F.regexp_extract(word, f"^{NON_WORD}*+", 0)


def word_suffix(word: Column) -> Column:
    """Trailing non-word characters (computed by length, no backtracking)."""
    start = F.length(word_prefix(word)) + F.length(word_core(word)) + F.lit(1)
    return F.substring(word, start, 1 << 30)


def destretch(word: Column) -> Column:
    """Runs of three or more equal characters become two."""
    return F.regexp_replace(word, STRETCH_RUN, "$1$1")


def similarity(a: Column, b: Column, distance: Column | None = None) -> Column:
    """``1 - d / max(len)`` in double precision; 0.0 if either word is empty."""
    la, lb = F.length(a), F.length(b)
    d = F.levenshtein(a, b) if distance is None else distance
    return (
        F.when((la == 0) | (lb == 0), F.lit(0.0))
        .otherwise(F.lit(1.0) - d.cast("double") / F.greatest(la, lb).cast("double"))
    )


def case_pattern(word: Column) -> Column:
    """'upper' / 'title' / 'lower' / 'mixed', tested in that order on the whole token."""
    return (
        F.when(word.rlike(IS_UPPER), F.lit("upper"))
        .when(word.rlike(HAS_CASED) & ~word.rlike(NOT_TITLE), F.lit("title"))
        .when(word.rlike(IS_LOWER), F.lit("lower"))
        .otherwise(F.lit("mixed"))
    )


def apply_case(pattern: Column, value: Column, value_upper: Column, value_title: Column,
               value_lower: Column, with_lower: Column | bool = True) -> Column:
    """Pick the dictionary value in the token's case (``with_lower`` false: no lower branch)."""
    lower_ok = F.lit(with_lower) if isinstance(with_lower, bool) else with_lower
    return (
        F.when(pattern == "upper", value_upper)
        .when(pattern == "title", value_title)
        .when((pattern == "lower") & lower_ok, value_lower)
        .otherwise(value)
    )


def replace_core(word: Column, replacement: Column) -> Column:
    """Put ``replacement`` where the word's core is, keeping outer punctuation."""
    return F.concat(word_prefix(word), replacement, word_suffix(word))


def replace_words(words: Column, changes: Column) -> Column:
    """``words`` joined by blanks, with those at the given positions replaced.

    ``changes``: array<struct<pos, out_word>> in any order, each position once.
    The changes are sorted and the slices of words between them taken as they
    are, so the work is linear in the words plus the changes.
    """
    def joined(one: Column) -> Column:
        w, c = one["w"], one["c"]
        n = F.size(c)

        def piece(i: Column) -> Column:
            begin = F.when(i > 0, F.get(c, i - 1)["pos"] + 1).otherwise(F.lit(0))
            end = F.when(i < n, F.get(c, i)["pos"]).otherwise(F.size(w))
            changed = F.when(i < n, F.array(F.get(c, i)["out_word"])).otherwise(F.array().cast("array<string>"))
            return F.concat(F.slice(w, begin + 1, end - begin), changed)

        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), n), piece)), " ")

    # a one-element array binds both arrays to a variable: they are computed once a row
    bound = F.array(F.struct(words.alias("w"), F.sort_array(changes).alias("c")))
    return F.element_at(F.transform(bound, joined), 1)


@F.arrow_udf(T.StringType())
def _rebuilt(texts: pa.Array, changes: pa.Array) -> pa.Array:
    lists = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.fill_null(texts, "")))
    words, begins = lists.values, np.asarray(lists.offsets)
    flat = pc.list_flatten(changes)
    if len(flat):
        at = begins[np.asarray(pc.list_parent_indices(changes))] + np.asarray(flat.field("pos"))
        changed = np.zeros(len(words), dtype=bool)
        changed[at] = True
        words = pc.replace_with_mask(words, pa.array(changed), flat.field("out_word").take(pa.array(np.argsort(at))))
    return pc.binary_join(type(lists).from_arrays(lists.offsets, words), " ")


def rebuilt(text: Column, changes: Column) -> Column:
    """``replace_words(split_words(text), changes)`` for a non-null text, a batch of texts at a time.

    Arrow's whitespace is Python's; the words of a batch lie side by side, so the work is linear in them.
    """
    return _rebuilt(F.make_valid_utf8(text), changes)
