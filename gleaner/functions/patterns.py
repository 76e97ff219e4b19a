"""Extraction rules as Spark Columns.

The matching semantics wanted are those of a linear-time regex engine with ASCII word boundaries and Unicode case
folding. Spark evaluates patterns with ``java.util.regex``, which differs in both points and backtracks, so every
pattern here

* spells out the two non-ASCII letters that fold to ASCII ones (U+017F to ``s``, U+212A to ``k``),
* spells out word boundaries with ASCII look-arounds,
* uses possessive runs and one start per run, so that a long run of candidate characters is read once.

``oracle_patterns`` states the same patterns in plain linear-engine syntax; the SQL checks use those.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: they must equal the reference's for equal results -------------------------------------------------

IOC_TYPES = ("ipv4", "ipv6", "domain", "url", "md5", "sha1", "sha256", "email")

GENERIC_TLDS = (
    "com", "net", "org", "edu", "gov", "mil", "int", "info", "biz", "name", "pro", "aero", "coop", "museum",
)

PRIVATE_IPV4_PREFIXES = (
    "10.",
    *(f"172.{second}." for second in range(16, 32)),
    "192.168.",
    "127.",
    "0.",
)

PLACEHOLDER_DOMAINS = (
    "example.com", "example.org", "example.net", "localhost.local", "test.com", "domain.com",
)

URL_TRAILING_PUNCTUATION = ".,;:!?)"

OCTET = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
HEX_GROUP = "[0-9a-fA-F]{1,4}"
HEX_DIGITS_BY_HASH = {"md5": 32, "sha1": 40, "sha256": 64}

# --- character classes -----------------------------------------------------------------------------------------------

# ``\\w``, ``\\p{Alnum}``, ``\\p{Alpha}`` and ``\\p{XDigit}`` are ASCII in Java and much faster than spelled-out ranges.
_FOLDED = "\u017F\u212A"
_WORD = "\\w"
_LETTER = "\\p{Alpha}" + _FOLDED
_ALNUM = "\\p{Alnum}" + _FOLDED
_HEX = "\\p{XDigit}{1,4}+"
_SPACE = "[\\t\\n\\f\\r ]"
_NOT_SPACE = "[^\\t\\n\\f\\r ]"

_BOUNDARY = f"(?:(?<!{_WORD})(?={_WORD})|(?<={_WORD})(?!{_WORD}))"
_START_OF_ALNUM = f"(?:(?<!{_WORD})(?=\\p{{Alnum}})|(?<={_WORD})(?=[{_FOLDED}]))"
_NO_WORD_BEFORE = f"(?<!{_WORD})"
_NO_WORD_AFTER = f"(?!{_WORD})"

# --- candidate tokens ------------------------------------------------------------------------------------------------

# No indicator holds white space, and each one holds a '.' or ':' followed by a letter, digit, ':' or '/', or else is a
# run of at least 32 characters. Everything else is dropped in one pass over the text before the eight rules run. The
# runs below stop at a mark that counts, at the 32nd character, or at the end of the token; only the last is a miss.
_PLAIN = "[^\\t\\n\\f\\r .:]{0,31}+"
_CANDIDATE = f"{_SPACE}{_PLAIN}(?:[.:](?![{_ALNUM}:/]){_PLAIN})*+{_NOT_SPACE}++"

# The tokens of a candidate string that hold a mark one type needs; cheaper than that type's own pattern.
_TOKENS_WITH_AT = f"{_SPACE}[^\\t\\n\\f\\r @]*+@{_NOT_SPACE}*+"
_TOKENS_WITH_TWO_COLONS = f"{_SPACE}(?:[^\\t\\n\\f\\r :]*+:){{2}}{_NOT_SPACE}*+"
_TOKENS_WITH_SUFFIX = (
    f"{_SPACE}[^\\t\\n\\f\\r .]*+(?:\\.(?![{_LETTER}])[^\\t\\n\\f\\r .]*+)*+\\.{_NOT_SPACE}*+"
)

# --- per-type patterns -----------------------------------------------------------------------------------------------

_IPV4 = f"{_NO_WORD_BEFORE}(?:{OCTET}\\.){{3}}{OCTET}{_NO_WORD_AFTER}"
_IPV4_LEADING_ZERO = "(^|\\.)0[0-9]"

_IPV6_FULL = f"{_NO_WORD_BEFORE}(?:{_HEX}:){{7}}{_HEX}{_NO_WORD_AFTER}"
_IPV6_COMPRESSED = (
    f"(?=\\p{{XDigit}}{{0,4}}+:)"
    f"(?:{_NO_WORD_BEFORE}(?:{_HEX}:){{1,7}}:|(?:{_HEX}:){{1,6}}:{_HEX}|:(?::{_HEX}){{1,7}})"
)
_IPV6_MAPPED = (
    f"(?i)^(?:(?:0{{1,4}}:){{5}}ffff(?::{HEX_GROUP}:{HEX_GROUP}|::|::{HEX_GROUP}|:{HEX_GROUP}::)"
    f"|::(?:0{{1,4}}:){{0,4}}ffff:{HEX_GROUP}:{HEX_GROUP})$"
)
# A maximal run of address characters with '::', for callers that want the whole compressed address: one '::', at most
# seven groups.
_IPV6_RUN = "(?<![\\w:.])(?=[\\p{XDigit}:]*::)[\\p{XDigit}:]++(?!\\w)"
_IPV6_WHOLE = (
    f"^(?=.{{2,39}}$)(?!.*::.*::)(?!:*(?:\\p{{XDigit}}+:+){{7}}\\p{{XDigit}})"
    f"(?:{_HEX}(?::{_HEX})*+)?::(?:{_HEX}(?::{_HEX})*+)?$"
)

_HASH = f"{_NO_WORD_BEFORE}(?:\\p{{XDigit}}{{64}}|\\p{{XDigit}}{{40}}|\\p{{XDigit}}{{32}}){_NO_WORD_AFTER}"
_CONSTANT_HASH = "^(?:f+|0+)$"

# A domain is the longest prefix of a dotted run that ends in a known suffix. The run is read possessively (a greedy
# group would retry every label, and recurse in Java), with a look-ahead that carries the few characters after it that
# may still be a suffix.
_LABEL = f"[{_ALNUM}][{_ALNUM}-]{{0,62}}+(?<=[{_ALNUM}])\\."
_DOTTED_RUN = f"{_START_OF_ALNUM}(?=((?:{_LABEL})++[{_ALNUM}_-]{{0,7}}))(?:{_LABEL})++"
_SUFFIX = f"(?iu:{'|'.join(GENERIC_TLDS)}|[a-z]{{2}})"
_DOMAIN_IN_RUN = f"^(.*\\.{_SUFFIX}){_BOUNDARY}"

_URL = f"{_NO_WORD_BEFORE}[hH][tT][tT][pP][sS\u017F]?://[^\\t\\n\\f\\r <>\"'`{{}}\\[\\]|\\\\^]+"

# One start per run of local-part characters: the first boundary in the run, or the end of the previous match.
_LOCAL = f"[{_ALNUM}._%+-]"
_EMAIL = (
    f"(?:\\G{_BOUNDARY}|(?<!{_LOCAL})[.%+\\-{_FOLDED}]*+(?={_WORD}))"
    f"({_LOCAL}++@[{_ALNUM}.-]+\\.[{_LETTER}]{{2,}}{_BOUNDARY})"
)


def oracle_patterns() -> dict[str, str]:
    """The same patterns in linear-engine syntax (``\\b`` is ASCII, ``(?i)`` folds Unicode), for SQL checks."""
    return {
        "ipv4": f"\\b(?:{OCTET}\\.){{3}}{OCTET}\\b",
        "ipv6_full": f"\\b(?:{HEX_GROUP}:){{7}}{HEX_GROUP}\\b",
        "ipv6_compressed": (
            f"\\b(?:{HEX_GROUP}:){{1,7}}:|(?:{HEX_GROUP}:){{1,6}}:{HEX_GROUP}|:(?::{HEX_GROUP}){{1,7}}"
        ),
        "ipv6_mapped": _IPV6_MAPPED,
        "md5": "\\b[a-fA-F0-9]{32}\\b",
        "sha1": "\\b[a-fA-F0-9]{40}\\b",
        "sha256": "\\b[a-fA-F0-9]{64}\\b",
        "domain": (
            f"(?i)\\b(?:[a-z0-9](?:[a-z0-9-]{{0,61}}[a-z0-9])?\\.)+(?:{'|'.join(GENERIC_TLDS)}|[a-z]{{2}})\\b"
        ),
        "url": "(?i)\\bhttps?://[^\\s<>\"'`{}\\[\\]|\\\\^]+",
        "email": "(?i)\\b[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]{2,}\\b",
    }


# --- column builders -------------------------------------------------------------------------------------------------


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _none() -> Column:
    return F.array().cast("array<string>")


def _tokens(text: Column, pattern: str) -> Column:
    return F.array_join(_all(F.concat(F.lit(" "), text), pattern), "")


def candidate_tokens(text: Column) -> Column:
    """The white-space separated tokens of ``text`` that can hold an indicator, as one string."""
    return _tokens(text, _CANDIDATE)


def ipv4_values(text: Column) -> Column:
    return F.filter(_all(text, _IPV4), lambda v: ~v.rlike(_IPV4_LEADING_ZERO))


def colon_tokens(text: Column) -> Column:
    return _tokens(text, _TOKENS_WITH_TWO_COLONS)


def ipv6_values(tokens: Column) -> Column:
    found = F.concat(_all(tokens, _IPV6_FULL), _all(tokens, _IPV6_COMPRESSED))
    return F.filter(found, lambda v: ~v.rlike(_IPV6_MAPPED))


def ipv6_whole_values(tokens: Column) -> Column:
    """As ``ipv6_values``, but a compressed address is returned whole (``fe80::1``, not ``fe80::``)."""
    whole = F.filter(_all(tokens, _IPV6_RUN), lambda v: v.rlike(_IPV6_WHOLE))
    return F.filter(F.concat(_all(tokens, _IPV6_FULL), whole), lambda v: ~v.rlike(_IPV6_MAPPED))


def hash_runs(text: Column) -> Column:
    """Every 32, 40 or 64 digit hash in ``text``: one search serves the three hash types."""
    found = F.transform(_all(text, _HASH), lambda v: F.lower(v))
    return F.filter(found, lambda v: ~v.rlike(_CONSTANT_HASH))


def hashes_of_length(digits: int) -> Callable[[Column], Column]:
    return lambda hashes: F.filter(hashes, lambda v: F.length(v) == digits)


def domain_values(text: Column) -> Column:
    runs = _all(_tokens(text, _TOKENS_WITH_SUFFIX), _DOTTED_RUN, 1)
    found = F.transform(runs, lambda run: F.lower(F.regexp_extract(run, _DOMAIN_IN_RUN, 1)))
    return F.filter(found, lambda v: v != "")


def url_values(text: Column) -> Column:
    return F.transform(_all(text, _URL), lambda v: F.rtrim(v, F.lit(URL_TRAILING_PUNCTUATION)))


def email_values(text: Column) -> Column:
    return F.transform(_all(_tokens(text, _TOKENS_WITH_AT), _EMAIL, 1), lambda v: F.lower(v))


def is_private_ipv4(value: Column) -> Column:
    return value.rlike("^(?:" + "|".join(p.replace(".", "\\.") for p in PRIVATE_IPV4_PREFIXES) + ")")


def is_placeholder_domain(value: Column) -> Column:
    return F.lower(value).isin(*PLACEHOLDER_DOMAINS)


@dataclass(frozen=True)
class PatternRule:
    """How one indicator type is found.

    ``find`` maps a text column to an array of normalised values. ``gate`` is a substring without which ``find`` cannot
    match; it is tested first because a substring search costs far less than a regex.

    ``prepare`` is an expression over the candidate tokens that ``find`` works on in place of the tokens themselves;
    rules that name the same function share one evaluation. A rule that must see the whole text, because its matches
    hold white space or no candidate mark (see ``candidate_tokens``), sets ``candidates_only=False``.
    """

    ioc_type: str
    find: Callable[[Column], Column]
    gate: str | None = None
    prepare: Callable[[Column], Column] | None = None
    candidates_only: bool = True

    def values(self, source: Column, gated: Column) -> Column:
        found = F.array_distinct(self.find(source))
        return found if self.gate is None else F.when(gated.contains(self.gate), found).otherwise(_none())


DEFAULT_RULES = (
    PatternRule("ipv4", ipv4_values, gate="."),
    PatternRule("ipv6", ipv6_values, gate=":", prepare=colon_tokens),
    PatternRule("domain", domain_values, gate="."),
    PatternRule("url", url_values, gate="://"),
    *(
        PatternRule(name, hashes_of_length(digits), prepare=hash_runs)
        for name, digits in HEX_DIGITS_BY_HASH.items()
    ),
    PatternRule("email", email_values, gate="@"),
)

WHOLE_IPV6_RULES = tuple(
    PatternRule("ipv6", ipv6_whole_values, gate=":", prepare=colon_tokens) if rule.ioc_type == "ipv6" else rule
    for rule in DEFAULT_RULES
)
