"""String expressions.

Whitespace follows Python's ``str.isspace`` set, not Java's ``\\s``: the set is
spelled out once, as characters (for ``btrim``) and as a regex class.  Both
forms mean the same in Java and in RE2, so oracle SQL can reuse them.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The code points Python's str.strip() and re's \s treat as blank.
WHITESPACE = "".join(
    map(
        chr,
        [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
         0x2028, 0x2029, 0x202F, 0x205F, 0x3000],
    )
)
WHITESPACE_CLASS = (
    r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)

# Token shapes.  WORD is the usual vectoriser token, a run of at
# least two letters, digits or underscores; ALPHA is a plain a-z run.
WORD = r"[\p{L}\p{N}_]{2,}"
ALPHA = r"[a-z]+"


def strip(text: Column) -> Column:
    """Trim blanks on both sides; a character set, so linear and regex-free."""
    return F.btrim(text, F.lit(WHITESPACE))


def normalised(text: Column) -> Column:
    """Lower case, then strip: the form most rules compare against."""
    return strip(F.lower(text))


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def flatten_lines(text: Column, width: int, stripped: bool = False) -> Column:
    """One display line: newlines to spaces, optional strip, cut to ``width``."""
    line = F.replace(text, F.lit("\n"), F.lit(" "))
    return F.substring(strip(line) if stripped else line, 1, width)


def alpha_tokens(text: Column) -> Column:
    """All a-z runs of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit(ALPHA), F.lit(0))


def word_tokens(text: Column) -> Column:
    """Vectoriser tokens: lower-cased word runs of two or more characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def cleaned_tokens(text: Column) -> Column:
    """Tokens of the discovery cleaner.

    Mentions and links vanish, every other non-letter separates words, and
    one-letter words are dropped; what is left is exactly the a-z runs of two
    or more letters, so one extraction replaces three rewriting passes.
    """
    # Each rewriting is for the few texts that have something to rewrite.
    lower = F.lower(text)
    no_mentions = F.when(
        lower.contains("@"), F.regexp_replace(lower, "@[a-z0-9_]+", "")
    ).otherwise(lower)
    no_links = F.when(
        lower.contains("http"), F.regexp_replace(no_mentions, f"http[^{WHITESPACE_CLASS}]+", "")
    ).otherwise(no_mentions)
    return F.regexp_extract_all(no_links, F.lit("[a-z]{2,}"), F.lit(0))


def clean_message(text: Column) -> Column:
    """Cleaned message text; NULL stays NULL."""
    return F.array_join(cleaned_tokens(text), " ")


def drop_words(tokens: Column, stop_words) -> Column:
    """Tokens that are not stop words, order kept."""
    return F.filter(tokens, lambda t: ~t.isin(*sorted(stop_words)))


def ngrams(tokens: Column, n: int) -> Column:
    """Space-joined n-grams; an array shorter than ``n`` gives none.

    Shifted copies of the array are zipped; positions past the end come out as
    NULL and are dropped.  ``tokens`` should be a column, not an expression: it
    is read once per shift.
    """
    grams = tokens
    for shift in range(2, n + 1):
        grams = F.zip_with(
            grams,
            F.slice(tokens, F.lit(shift), F.size(tokens)),
            lambda left, right: F.concat(left, F.lit(" "), right),
        )
    return F.array_compact(grams) if n > 1 else grams


def contains_any(text: Column, needles) -> Column:
    """True when any needle occurs as a plain substring."""
    found = text.contains(needles[0])
    for needle in needles[1:]:
        found = found | text.contains(needle)
    return found
