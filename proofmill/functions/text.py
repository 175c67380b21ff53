"""Text normalisation, token sets and length estimates as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no relationship signal.
STOPWORDS = (
    "the a an of and or to in on for from by with at as is was were are be been being this that these those it its "
    "their there than then also both over under during between through per into which who whose reported"
).split()

#: Words that hint at a relationship.
CUES = (
    "because due caused cause causing led leads result resulted resulting therefore following after before while "
    "whereas however despite increase increased increasing decrease decreased decline declined fall fell rose grew "
    "growth reduced reduction higher lower change changed impact effect affected contributed contribution associated "
    "correlated compared versus"
).split()


def _words(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def ustrip(c: Column) -> Column:
    """Strip white space of any script."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", " ")


def filled(c: Column) -> Column:
    """Null for null and for the empty string."""
    return F.nullif(c, F.lit(""))


def normalize(c: Column) -> Column:
    """Lower case; letters and digits of ASCII, % and single spaces; an end that was punctuation stays a space."""
    return squeeze(F.regexp_replace(ustrip(F.lower(F.coalesce(c, F.lit("")))), r"[^a-z0-9%\s]", " "))


def tokens(normal: Column) -> Column:
    """The distinct words of a normalised text."""
    return F.array_distinct(F.filter(F.split(normal, " "), lambda t: t != ""))


def meaningful(normal: Column) -> Column:
    """The distinct words that aren't stop words and have more than one letter."""
    return F.array_except(F.filter(tokens(normal), lambda t: F.length(t) > 1), _words(STOPWORDS))


def cues(meaningful_tokens: Column) -> Column:
    return F.array_intersect(meaningful_tokens, _words(CUES))


def verify_normalize(c: Column) -> Column:
    """The form in which quotes and blocks are compared: dashes and quote marks made plain, spaces single."""
    plain = F.translate(F.lower(F.coalesce(c, F.lit(""))), "–—−’“”", "---'\"\"")
    return ustrip(squeeze(plain))


#: Letters whose upper case is longer than one letter, but which have one of a single letter as well.
_SINGLE = {"ß": "ẞ"} | {x: x.title() for x in map(chr, range(0x1F80, 0x2000)) if len(x.upper()) > 1 and x.title() != x and len(x.title()) == 1}


def upper_single(c: Column) -> Column:
    """Upper case letter by letter, as many letters as before: ß becomes ẞ, and a letter without such an upper case stays."""
    one = lambda x: F.when(F.length(F.upper(x)) == 1, F.upper(x)).otherwise(F.translate(x, "".join(_SINGLE), "".join(_SINGLE.values())))
    return F.array_join(F.transform(F.split(c, ""), one), "")


def rule_normalize(c: Column) -> Column:
    return F.lower(ustrip(F.coalesce(c, F.lit(""))))


def token_estimate(c: Column) -> Column:
    """A quarter of the characters, rounded up; 0 only for an empty text."""
    n = F.length(F.coalesce(c, F.lit("")))
    return F.floor((n + 3) / 4).cast("long")


def claim_text(c) -> Column:
    """Subject, predicate, definition, basis and scope of ``c(name)``, joined where filled."""
    return F.concat_ws(" ", *(filled(c(x)) for x in ("subject", "predicate", "definition", "basis", "scope")))


def period_text(c) -> Column:
    return F.concat_ws(" ", *(filled(c(x)) for x in ("period_start", "period_end", "period_type")))
