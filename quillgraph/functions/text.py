"""Text, rounding and identity as expressions on columns; nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.constants import ANTONYMS, COMMON_SHARE, DIRECTORY_MIN_FILES, OVERLAP_FLOOR

#: Words that say nothing of a decision's subject.
STOP_WORDS = (
    "the", "a", "an", "to", "for", "of", "and", "or", "in", "on", "with", "instead",
    "use", "using", "avoid", "adopt", "reject", "enable", "disable", "this", "that", "will", "should",
)


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda x: x != "")


def subject_tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(tokens(text), lambda x: (F.length(x) > 2) & ~x.isin(*STOP_WORDS)))


def coverage(query: Column, document: Column) -> Column:
    """Share of the distinct query tokens that the document has."""
    q = F.array_distinct(query)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, document)) / F.size(q)).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    """Intersection by the smaller set."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))).otherwise(F.lit(0.0))


def anchored(shared: Column, frequency: Column, n: Column) -> Column:
    """Whether some shared token is rare enough in a corpus of ``n`` subjects (``frequency``: map of token to count)."""
    return (n < DIRECTORY_MIN_FILES) | F.exists(shared, lambda t: F.coalesce(F.try_element_at(frequency, t), F.lit(0)) / n <= COMMON_SHARE)


def opposed(a: Column, b: Column, pairs=ANTONYMS) -> Column:
    """Whether one text holds a word and the other its antonym, as substrings."""
    a, b = F.lower(a), F.lower(b)
    out = F.lit(False)
    for x, y in pairs:
        out = out | (a.contains(x) & b.contains(y)) | (a.contains(y) & b.contains(x))
    return out


def contradicts(a: Column, b: Column, pairs=ANTONYMS) -> Column:
    return (overlap(subject_tokens(a), subject_tokens(b)) >= OVERLAP_FLOOR) & opposed(a, b, pairs)


def round3(x: Column) -> Column:
    return F.floor(x * 1000 + F.lit(0.5)) / F.lit(1000.0)


def round6(x: Column) -> Column:
    return F.floor(x * 1000000 + F.lit(0.5)) / F.lit(1000000.0)


def stable_id(prefix: Column | str, text: Column) -> Column:
    prefix = F.lit(prefix) if isinstance(prefix, str) else prefix
    return F.concat(prefix, F.lit(":"), F.substring(F.sha1(F.lower(strip(text))), 1, 12))


def without_checkbox(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"^\[[ xX]\]\s*", ""))


def without_date(text: Column) -> Column:
    return F.regexp_replace(text, r"^\d{4}-\d{2}-\d{2}\s*[—-]\s*", "")


def truncated(text: Column, limit: int) -> Column:
    t = strip(F.coalesce(text, F.lit("")))
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit - 1), F.lit("…"))).otherwise(t)


def token_cost(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def _word(pattern: str) -> str:
    """Bounded by what are not ASCII word characters."""
    return rf"(?i)(?<![A-Za-z0-9_])({pattern})(?![A-Za-z0-9_])"


def committed(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(_word(r"decided|final|going with|confirmed|let'?s go with"))


def self_resolved(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return ~t.rlike(_word(r"unresolved|not\s+(yet\s+)?(fixed|resolved)|still\s+(broken|unresolved|an?\s+issue)")) & t.rlike(_word("fixed|resolved|patched"))


def redacted(content: Column) -> Column:
    """Nothing but redaction marks."""
    return F.coalesce(content.rlike(r"(?i)\[REDACTED\]") & (strip(F.regexp_replace(content, r"(?i)\[REDACTED\]", "")) == ""), F.lit(False))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, r"[/\\]+$", ""), r"[/\\]"), -1)


def whole_diff(old: Column, new: Column, name: Column) -> Column:
    """A listing of all old lines as removed and all new ones as added."""

    def listed(text: Column, mark: str) -> Column:
        return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(text, "\n"), lambda x: F.concat(F.lit(mark), x)))

    return F.array_join(F.concat(F.array(F.concat(F.lit("--- a/"), name), F.concat(F.lit("+++ b/"), name)), listed(old, "-"), listed(new, "+")), "\n")


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different lengths, empty ones and those of length zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    x, y = a.cast("array<double>"), b.cast("array<double>")
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when((F.size(x) == F.size(y)) & (F.size(x) > 0) & (norm > 0), dot(x, y) / norm).otherwise(F.lit(0.0))


#: Names that mark a file as noise in benchmarks, and the one that is kept all the same.
NOISE = ("lock", ".svg", ".png", ".lockb", ".snap", ".json")
NOT_NOISE = "package.json"


def is_noise(path: Column) -> Column:
    p = F.lower(path)
    found = F.lit(False)
    for mark in NOISE:
        found = found | p.contains(mark)
    return found & ~p.contains(NOT_NOISE)
