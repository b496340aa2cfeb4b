"""Line-first cleaning: rules per line, then the verdict on what is left of the document.

Base figures (words, word characters, symbols, repeated lines, words in repeated 3-word windows) are taken from the
whole text. Then every non-blank line is held against three rules (``navigation``, ``boilerplate``, ``punctuation``);
lines that fail are removed, and a document that loses more than ``max_loss`` of its words is rejected.

Edge cases: a null text has no words and no lines (all counts 0, ``base_failed`` true, ``kept`` false); so has an empty
one. Null ids are carried through. Repeated rows give repeated results. Every row is judged alone, so an empty table
gives an empty result, and extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from .common import WHITE, by_text, utf8

SYMBOLS = "#*$%&|<>"
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, kept_words long, kept_lines long, navigation_lines long, boilerplate_lines long, punctuation_lines long"
)
#: Phrases of site furniture, lower case.
BOILERPLATE = (
    "accept cookies", "all rights reserved", "click here", "cookie policy", "enable javascript", "lorem ipsum",
    "privacy policy", "read more", "sign up for", "skip to content", "subscribe to", "terms of service", "terms of use",
)
_boiler = re.compile("|".join(map(re.escape, BOILERPLATE)))
_ends = re.compile(r"[.!?…:;。！？\"'”’»)\]]\s*$")
_bars = re.compile(r"[|»›·•<>{}]")
_odd = re.compile(r"[#*$%&~^_=+\\]+")


@dataclass(frozen=True)
class LineRules:
    min_words: int = 50
    max_repeat_percent: int = 50
    max_loss: float = 0.5
    max_bars: float = 0.25  #: separators per word from which a line is navigation
    max_odd: float = 0.3  #: runs of symbols per word from which the punctuation of a line is junk
    open_words: int = 4  #: lines of at most so many words without a closing mark fail the punctuation rule
    open_commas: float = 0.02  #: longer lines pass without a closing mark if they have so many marks a word


def line_verdict(line: str, rules: LineRules = LineRules()) -> str:
    """``keep`` or the name of the first rule that the line fails."""
    n = len(line.split())
    if len(_bars.findall(line)) > rules.max_bars * n:
        return "navigation"
    if _boiler.search(line.lower()):
        return "boilerplate"
    if len(_odd.findall(line)) > rules.max_odd * n:
        return "punctuation"
    if not _ends.search(line):
        marks = line.count(".") + line.count(",")
        if n <= rules.open_words or marks < rules.open_commas * n:
            return "punctuation"
    return "keep"


def clean_lines(text: str | None, rules: LineRules = LineRules()) -> str:
    """The text without the lines that fail; blank lines stay."""
    return "\n".join(x for x in (text or "").split("\n") if not utf8(x).split() or line_verdict(x, rules) == "keep")


def repeat_words(tokens: list[bytes]) -> int:
    """Words that stand in a 3-word window found twice or more."""
    n = len(tokens)
    if n < 4:
        return 0
    codes: dict[bytes, int] = {}
    ids = np.fromiter((codes.setdefault(w, len(codes)) for w in tokens), np.int64, n)
    m = len(codes)
    if m < 2_000_000:
        windows = (ids[:-2] * m + ids[1:-1]) * m + ids[2:]
    else:  # the product would not fit
        pairs = np.unique(ids[:-2] * m + ids[1:-1], return_inverse=True)[1]
        windows = pairs * m + ids[2:]
    _, back, count = np.unique(windows, return_inverse=True, return_counts=True)
    hit = count[back] > 1
    if not hit.any():
        return 0
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : k + n - 2] |= hit
    return int(covered.sum())


def assess(text: str | None, rules: LineRules = LineRules()) -> tuple:
    """The columns after ``doc_id`` of SCHEMA."""
    text = text or ""
    tokens = utf8(text).split()
    n = len(tokens)
    chars = len(text) - sum(map(text.count, WHITE))
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    repeats = repeat_words(tokens)
    base_failed = n < rules.min_words or 100 * repeats > rules.max_repeat_percent * n
    found = {"keep": 0, "navigation": 0, "boilerplate": 0, "punctuation": 0}
    left = 0
    for line in lines:
        verdict = line_verdict(line, rules)
        found[verdict] += 1
        if verdict == "keep":
            left += len(utf8(line).split())
    kept = not base_failed and n - left <= rules.max_loss * n
    symbols = sum(map(text.count, SYMBOLS))
    return n, chars, symbols, len(lines) - len(set(lines)), repeats, base_failed, kept, left, found["keep"], found["navigation"], found["boilerplate"], found["punctuation"]


def quality(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """One row of figures and verdicts per document; a narrow map, nothing is shuffled."""
    return by_text(docs, lambda texts: [assess(t, rules) for t in texts], SCHEMA)
