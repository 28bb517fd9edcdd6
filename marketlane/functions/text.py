"""String expressions: trimming, e-mail and file-extension checks, word tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The e-mail pattern of the reference (RFC 5322-style), written for
# Java regex. Java's ``$`` also matches before a final newline, JS's does not,
# so the end anchor is ``\z``.
EMAIL_PATTERN = (
    r'^(([^<>()\[\]\\.,;:\s@"]+(\.[^<>()\[\]\\.,;:\s@"]+)*)|(".+"))@'
    r'((\[[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}])|'
    r'(([a-zA-Z\-0-9]+\.)+[a-zA-Z]{2,}))\z'
)

# Image extensions accepted on upload (case-sensitive).
IMAGE_EXTENSIONS = (".png", ".jpeg", ".jpg")


# The white space and line ends that JS ``String.trim`` strips.
JS_BLANKS = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"


def trim_text(col: Column) -> Column:
    """Strip leading and trailing white space (JS ``String.trim``)."""
    return F.regexp_replace(col, rf"^{JS_BLANKS}+|{JS_BLANKS}+\z", "")


def is_valid_email(col: Column) -> Column:
    return col.rlike(EMAIL_PATTERN)


def file_extension(col: Column) -> Column:
    """Text from the last dot to the end, like Node's ``path.extname``: ``''``
    when there is no dot or the only dot starts the name."""
    return F.regexp_extract(col, r"^.+(\.[^.]*)$", 1)


def has_image_extension(col: Column) -> Column:
    return file_extension(col).isin(*IMAGE_EXTENSIONS)


def word_tokens(col: Column) -> Column:
    """Lower-case words of letters and digits of any script, in order (search config ``simple``)."""
    return F.filter(F.split(F.lower(col), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != F.lit(""))


def harman_s_stem(word: Column) -> Column:
    """Harman's (1991) S-stemmer, the first matching rule applies:
    ``-ies`` (not ``-eies``/``-aies``) -> ``-y``; ``-es`` (not ``-aes``/``-ees``/
    ``-oes``) -> ``-e``; ``-s`` (not ``-us``/``-ss``) -> drop."""
    return (F.when(word.rlike("[^ea]ies$"), F.regexp_replace(word, "ies$", "y"))
            .when(word.rlike("[^aeo]es$"), F.regexp_replace(word, "es$", "e"))
            .when(word.rlike("[^us]s$"), F.regexp_replace(word, "s$", ""))
            .otherwise(word))


def harman_s_stem_py(word: str) -> str:
    """The same rule for driver-side query words."""
    if len(word) > 3 and word.endswith("ies") and word[-4] not in "ea":
        return word[:-3] + "y"
    if len(word) > 2 and word.endswith("es") and word[-3] not in "aeo":
        return word[:-2] + "e"
    if len(word) > 1 and word.endswith("s") and word[-2] not in "us":
        return word[:-1]
    return word


def english_tokens(col: Column, stop_words: list[str]) -> Column:
    """Search config ``english``: lower-case words without stop words, each
    reduced by the S-stemmer."""
    stops = F.array(*[F.lit(w) for w in stop_words]) if stop_words else F.array().cast("array<string>")
    kept = F.filter(word_tokens(col), lambda w: ~F.array_contains(stops, w))
    return F.transform(kept, harman_s_stem)
