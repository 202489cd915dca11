"""Text functions, Column to Column: tokens, key words, sentiment flips, sanitizing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrywell.functions.vector import _c

#: All white space of Unicode that separates words.
SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WS = f"[{SPACE}]"
#: The same characters as a property, which is looked up and not gone through range by range.
_WS_FAST = r"[\p{IsWhite_Space}\x1c-\x1f]"

# Words that negate; pairs of words of opposite sentiment; prepositions; punctuation cut from words.
NEGATIONS = ["no", "not", "never", "don't", "doesn't", "didn't", "won't", "can't", "cannot", "hate", "dislike", "avoid", "stop", "stopped", "quit", "quitting", "anymore", "no longer", "ceased"]
OPPOSITES = [("love", "hate"), ("like", "dislike"), ("enjoy", "avoid"), ("always", "never"), ("do", "don't"), ("will", "won't"), ("can", "can't"), ("start", "stop"), ("begin", "quit"), ("am", "am not"), ("was", "wasn't"), ("is", "isn't"), ("have", "haven't"), ("had", "hadn't")]
PREPOSITIONS = ["at", "in", "on", "to", "for"]
PUNCTUATION = ",.!?;:'\""

# Patterns of prompt injection, in the order of replacement, and role prefixes.
SUSPICIOUS = [
    rf"(?iUd)\bignore{WS}+(all{WS}+)?previous{WS}+instructions\b",
    rf"(?iUd)\byou{WS}+are{WS}+now\b",
    rf"(?iUdm)^{WS}*system{WS}*:",
    rf"(?iUdm)^{WS}*assistant{WS}*:",
    r"(?iUd)\[INST\]",
    rf"(?iUdm)^{WS}*###{WS}*instruction",
    rf"(?iUd)\bignore{WS}+all\b",
]
ROLES = [rf"(?iUdm)^{WS}*{role}{WS}*:{WS}*" for role in ("user", "assistant", "system", "bot")]
SHORT_CHARS, SHORT_WORDS = 8, 8


def tokens(c) -> Column:
    """Lower-case words between white space; punctuation stays."""
    return F.filter(F.split(F.lower(_c(c)), f"{_WS_FAST}+"), lambda x: x != "")


def token_count(c) -> Column:
    """Words times 1.3, cut to a whole number."""
    return F.floor(F.size(tokens(c)) * F.lit(1.3)).cast("int")


def key_words(words: Column) -> Column:
    """Words without punctuation around them: those of over two characters, and prepositions behind a word that is
    not itself such a preposition."""
    bare = F.transform(words, lambda w: F.btrim(w, F.lit(PUNCTUATION)))
    short = [p for p in PREPOSITIONS if len(p) <= 2]
    start = F.struct(F.lit(False).alias("open"), *(F.lit(False).alias(p) for p in short))

    def step(s, w):
        taken = s["open"] & w.isin(PREPOSITIONS)
        return F.struct((~taken).alias("open"), *((s[p] | (taken & (w == p))).alias(p) for p in short))

    found = F.aggregate(words, start, step, lambda s: F.filter(F.array(*(F.when(s[p], F.lit(p)) for p in short)), lambda x: x.isNotNull()))
    return F.array_union(F.filter(bare, lambda w: F.length(w) > 2), found)


def sentiment_flip(a: Column, b: Column) -> Column:
    """Whether two token lists share a key word and say the opposite of each other."""
    said = lambda x: F.arrays_overlap(x, F.array(*map(F.lit, NEGATIONS)))
    pair = F.lit(False)
    for p, n in OPPOSITES:
        pair = pair | (F.array_contains(a, p) & F.array_contains(b, n)) | (F.array_contains(a, n) & F.array_contains(b, p))
    return F.arrays_overlap(key_words(a), key_words(b)) & (pair | (said(a) != said(b)))


def is_suspicious(c) -> Column:
    c = _c(c)
    hit = F.lit(False)
    for p in SUSPICIOUS:
        hit = hit | c.rlike(p)
    return (F.length(c) >= SHORT_CHARS) & hit


def sanitize(c, strict: bool = False) -> Column:
    """Suspicious patterns replaced; strict: role prefixes too.  Short texts without a pattern stay as they are."""
    c = _c(c)
    out = c
    for p in SUSPICIOUS:
        out = F.regexp_replace(out, p, "[SANITIZED]")
    for p in ROLES if strict else ():
        out = F.regexp_replace(out, p, "[ROLE]")
    return F.when((F.size(tokens(c)) < SHORT_WORDS) & ~is_suspicious(c), c).otherwise(out)
