"""Columns for names, titles and free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ACCENTED, _PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
WHITE = r"[\t\n\x0b\f\r ]+"


def normal_space(t: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(t, WHITE, " ")))


def without_space(t: Column) -> Column:
    """A text without white space at its ends."""
    return F.regexp_replace(t, r"^[\t\n\x0b\f\r ]+|[\t\n\x0b\f\r ]+$", "")


#: Words that start the name of an edition, and words that deny what follows them.
EDITIONS = "directors?|extended|unrated|special|theatrical|ultimate|final|collectors?|anniversary|remastered|uncut|redux"
NEGATORS = (
    "no ", "not ", "n't", "never", "cannot", "can not", "without", "absent", "rather than", "instead of", "neither", "nor ",
    "lacks", "lacking", "does not", "is not", "are not", "was not", "were not", "would require", "could reach",
    "would reach", "short of", "falls short", "unlike",
)


def normal_title(t: Column) -> Column:
    """Accents and other signs off, lower case, punctuation to spaces, edition suffix off; never empty by that."""
    plain = F.regexp_replace(F.translate(F.lower(t), _ACCENTED, _PLAIN), r"[^\x00-\x7F]", "")
    spaced = F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))
    cut = F.trim(F.regexp_replace(spaced, rf"\b(?:the )?(?:{EDITIONS})\b.*$", ""))
    return F.coalesce(F.nullif(cut, F.lit("")), spaced)


def normal_list(t: Column) -> Column:
    spaced = F.trim(F.regexp_replace(F.lower(t), "[^a-z0-9]+", " "))
    return F.regexp_replace(spaced, "^(the|a|an) ", "")


#: Fixed value: the shape of a name, two to five capitalised words with periods, hyphens and either apostrophe.
NAME = r"^[A-Z][A-Za-z.'’\-]*(?: [A-Z][A-Za-z.'’\-]*){1,4}$"


def is_name(t: Column) -> Column:
    return F.trim(t).rlike(NAME)


def redacted(t: Column, *names: Column, put: str = "[SUBJECT]") -> Column:
    """Full names and aliases, and their words of four or more letters, replaced as whole words in any case, longest first."""
    words = F.filter(F.flatten(F.array(*[F.split(n, " ") for n in names])), lambda w: F.length(w) >= 4)
    every = F.array_distinct(F.filter(F.concat(F.array(*names), words), lambda w: w.isNotNull() & (w != "")))
    longest = F.array_sort(every, lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0))
    quoted = F.transform(longest, lambda w: F.regexp_replace(w, r"([^\w ])", r"\\$1"))
    return F.when(F.size(every) > 0, F.call_function("regexp_replace", t, F.concat(F.lit(r"(?i)\b("), F.array_join(quoted, "|"), F.lit(r")\b")), F.lit(put))).otherwise(t)


def residual(t: Column, *names: Column) -> Column:
    """Words of under four letters of the names that stand in the text, in the order of the names."""
    words = F.array_distinct(F.flatten(F.array(*[F.split(n, " ") for n in names])))
    short = F.filter(words, lambda w: (F.length(w) < 4) & (F.trim(w, F.lit(".,' ")) != ""))
    return F.filter(short, lambda w: F.call_function("regexp_like", t, F.concat(F.lit(r"(?i)\b"), F.regexp_replace(w, r"([^\w ])", r"\\$1"), F.lit(r"\b"))))


def ordinal(n: Column) -> Column:
    last = F.when(n % 100 >= 11, F.when(n % 100 <= 13, 0).otherwise(n % 10)).otherwise(n % 10)
    return F.concat(n.cast("string"), F.when(last == 1, "st").when(last == 2, "nd").when(last == 3, "rd").otherwise("th"))


def surname(name: Column) -> Column:
    """Last word of a name if it has four letters or more."""
    last = F.element_at(F.split(name, " "), -1)
    return F.when(F.length(last) >= 4, last)


def without_disambiguator(t: Column) -> Column:
    return F.regexp_replace(t, r"\s*\([^)]*\)$", "")


def stripped_markup(t: Column) -> Column:
    """Tags and templates off, links unwrapped, blank lines collapsed."""
    no_tags = F.regexp_replace(t, r"<[^>]*>", " ")
    no_templates = F.regexp_replace(no_tags, r"\{\{[^{}]*\}\}", "")
    links = F.regexp_replace(no_templates, r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", "$1")
    return F.trim(F.regexp_replace(links, WHITE, " "))


def failure_class(t: Column) -> Column:
    low = F.lower(t)
    has = lambda *words: F.greatest(*[F.contains(low, F.lit(w)) for w in words], F.lit(False))
    return F.when(has("quota", "rate limit"), "quota").when(has("timeout", "temporarily"), "transient").when(has("exit", "nonzero"), "nonzero").when(F.trim(t) == "", "empty").otherwise("other")


def asserted(t: Column, pattern: str, reach: int = 60) -> Column:
    """Whether a text asserts the pattern: some match has no negator in the ``reach`` characters before it in its sentence."""
    sentences = F.filter(F.split(t, r"[.!?\n]", -1), lambda s: s.rlike(pattern))
    size = lambda a: F.aggregate(a, F.lit(0), lambda n, x: n + F.length(x))

    def free(s: Column) -> Column:
        parts, whole = F.split(s, pattern, -1), F.regexp_extract_all(s, F.lit(pattern), F.lit(0))
        starts = F.transform(whole, lambda _, i: size(F.slice(parts, 1, i + 1)) + size(F.slice(whole, 1, i)))
        before = lambda at: F.lower(F.substring(s, F.greatest(at - reach, F.lit(0)) + 1, F.least(at, F.lit(reach))))
        return F.exists(starts, lambda at: ~before(at).rlike("|".join(NEGATORS)))

    return F.exists(sentences, free)


def years_in(t: Column) -> Column:
    """Distinct years 1900 to 2099 that stand in a text, in order."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(t, F.lit(r"\b(19\d{2}|20\d{2})\b"), F.lit(1))))


def sentences(t: Column) -> Column:
    """Sentences of a text: cut after . ! or ? before white space, without white space at their ends."""
    return F.filter(F.transform(F.split(t, r"(?<=[.!?])[\t\n\x0b\f\r ]+", -1), without_space), lambda s: s != "")


def _whole_word(s: Column, words: Column) -> Column:
    """Whether words stand in a text between characters that are no letters, digits or underscores."""
    return F.call_function("regexp_like", s, F.concat(F.lit(r"(?U)\b"), F.regexp_replace(words, r"([^\p{L}\p{N}_ ])", r"\\$1"), F.lit(r"\b")))


def sentences_naming(t: Column, name: Column) -> Column:
    """Struct of ``how`` and ``hits``: the sentences that hold the full name, else those that hold the surname (of four
    letters or more) as a whole word."""
    all_ = F.coalesce(sentences(t), F.array().cast("array<string>"))
    full = F.filter(all_, lambda s: F.contains(s, name))
    last = F.element_at(F.split(F.trim(name), r"\s+"), -1)
    by_surname = F.when(F.length(last) >= 4, F.filter(all_, lambda s: _whole_word(s, last))).otherwise(F.array().cast("array<string>"))
    how = F.when(F.size(full) > 0, "full name").when(F.size(by_surname) > 0, "surname only").otherwise("none")
    return F.struct(how.alias("how"), F.when(F.size(full) > 0, full).otherwise(F.coalesce(by_surname, F.array().cast("array<string>"))).alias("hits"))


def years_of(hits: Column) -> Column:
    """Distinct years 1900 to 2099 of several texts, in order."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(hits, years_in))))
