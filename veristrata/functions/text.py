"""Text normalisers, tokens and set measures as column builders; all stay inside the JVM."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column, functions as F

# Words that carry no content when quotes are matched with their source.
STOP_WORDS = [
    "the", "was", "were", "and", "for", "with", "from", "this", "that", "patient", "discharge", "discharged", "continued", "started", "changed",
    "stopped", "performed", "showed", "shows", "showing", "revealed", "demonstrated", "obtained", "completed", "because", "surgical", "daily",
    "nightly", "tablet", "capsule", "admission", "admitted", "medication", "medications", "diagnosis", "diagnoses", "hospital", "course", "brief",
    "follow", "up", "sig",
]


# A number and a unit of dose, words of ASCII characters on both sides' boundaries.
DOSE = r"(?<![A-Za-z0-9_])\d+(?:\.\d+)?\s*(?:mg|mcg|g|units?|ml|meq)(?![A-Za-z0-9_])"


def but(*kept: tuple[int, int]) -> str:
    """A class of all characters but those in the ranges, written without negation: Java takes ten times as long for [^...] of several ranges."""
    out, begin = "", 0
    for first, last in [*sorted(kept), (sys.maxunicode + 1, 0)]:
        out += f"\\x{{{begin:X}}}-\\x{{{first - 1:X}}}" if begin < first else ""
        begin = max(begin, last + 1)
    return f"[{out}]"


def but_words(more: str = "") -> str:
    """A class of all characters but a-z, 0-9 and those in `more`."""
    return but((0x61, 0x7A), (0x30, 0x39), *((ord(c), ord(c)) for c in more))


def bounded(pattern: str) -> str:
    """The pattern between boundaries of ASCII words, whatever its case; its alternatives share the boundaries."""
    return f"(?i)(?<![A-Za-z0-9_])(?:{pattern})(?![A-Za-z0-9_])"


def lower(x: Column) -> Column:
    """Lower case, one character for each: a capital I with a dot becomes i alone, without the mark that Java's lower case adds."""
    return F.lower(F.replace(x, F.lit("\u0130"), F.lit("i")))


def normal_exact(x: Column) -> Column:
    """Lower case, white space as single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))


#: Blocks of letters whose characters mostly have no other NFKC form: Latin, Cyrillic, dashes and quotation marks, Chinese.
PLAIN_BLOCKS = [(0x80, 0x24F), (0x400, 0x482), (0x48A, 0x52F), (0x2010, 0x205F), (0x3040, 0x3098), (0x4E00, 0x9FFF)]


@cache
def _compatible() -> tuple[dict[str, str], str, str]:
    """Characters whose NFKC form holds an ASCII letter, digit or full stop, with that form; a pattern of letters that a mark composes
    with; a class of the characters that may need either (all but ASCII and what is plain in PLAIN_BLOCKS, as few ranges)."""
    forms, composed = {}, {}
    for c in range(0x80, sys.maxunicode + 1):
        form = unicodedata.normalize("NFKC", chr(c))
        if form != chr(c) and any(x < "\x80" and (x.isalnum() or x == ".") for x in form):
            forms[chr(c)] = form
        parts = unicodedata.normalize("NFD", chr(c))
        if len(parts) > 1 and parts[0] < "\x80" and parts[0].isalpha() and unicodedata.normalize("NFC", parts[:2]) != parts[:2]:
            composed.setdefault(parts[0], set()).add(parts[1])
    plain, begin = [(0, 0x7F)], None
    for first, last in PLAIN_BLOCKS:
        for c in range(first, last + 2):
            ok = c <= last and chr(c) not in forms
            if ok and begin is None:
                begin = c
            elif not ok and begin is not None:
                plain.append((begin, c - 1))
                begin = None
    return forms, "|".join(f"{a}[{''.join(sorted(marks))}]" for a, marks in sorted(composed.items())), but(*plain)


def nfkc_ascii(x: Column) -> Column:
    """x with the ASCII letters, digits and full stops that its NFKC form has; other characters that this form changes may stay or become spaces.

    All inside the JVM: texts without a special character are left as they are, and only those with one whose form has several go through a map.
    """
    forms, composed, special = _compatible()
    single = {c: f for c, f in forms.items() if len(f) == 1}
    several = {c: f for c, f in forms.items() if len(f) > 1}
    plain = F.translate(x, "".join(single), "".join(single.values()))
    table = F.create_map(*(F.lit(v) for pair in several.items() for v in pair))
    spelled = F.array_join(F.transform(F.split(plain, ""), lambda c: F.when(c > "\x7f", F.coalesce(F.try_element_at(table, c), c)).otherwise(c)), "")
    marked = F.when(plain.rlike(f"[{''.join(several)}]"), spelled).otherwise(plain)
    return F.when(F.octet_length(x) == F.length(x), x).when(x.rlike(special), F.regexp_replace(marked, composed, " ")).otherwise(x)


def normal_loose(x: Column) -> Column:
    """NFKC, lower case, [**...**] marks dropped, everything but ASCII letters, digits and full stops as single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(nfkc_ascii(x)), r"\[\*\*[^\]]+\*\*\]", " "), f"{but_words('.')}+", " "))


def normal_quote(x: Column) -> Column:
    """Letters and digits of any script kept, the rest as single spaces."""
    return F.trim(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", " "))


def normal_dose(x: Column) -> Column:
    """A drug's name without its doses."""
    return F.trim(F.regexp_replace(F.regexp_replace(normal_exact(x), DOSE, ""), r"[^a-z0-9]+", " "))


def normal_cluster(x: Column) -> Column:
    """For fingerprints: [**...**] marks as deid, numbers as #, other than letters and # as single spaces."""
    marked = F.regexp_replace(F.lower(x), r"\[\*\*.*?\*\*\]", " [deid] ")
    return F.trim(F.regexp_replace(F.regexp_replace(marked, r"\d+(?:\.\d+)?", "#"), r"[^a-z#]+", " "))


def word_tokens(x: Column) -> Column:
    """ASCII words, with one inner apostrophe."""
    return F.regexp_extract_all(F.lower(x), F.lit(r"([a-z0-9]+(?:'[a-z0-9]+)?)"), F.lit(1))


def content_words(words: Column) -> Column:
    """Those of the words of a text in normal_loose() form that have three characters or more and aren't stop words; full stops at a word's end go."""
    return F.filter(F.transform(words, lambda t: F.rtrim(t, F.lit("."))), lambda t: (F.length(t) >= 3) & ~t.isin(STOP_WORDS))


def content_tokens(x: Column) -> Column:
    """Words of three characters or more that aren't stop words; full stops at a word's end go (a number has none there)."""
    return content_words(F.split(normal_loose(x), " "))


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of n tokens joined by spaces. Shifted arrays are zipped, so the tokens are computed n times, not once for each run."""
    out = tokens
    for j in range(1, n):
        out = F.zip_with(out, F.slice(tokens, F.lit(1 + j), F.size(tokens)), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.filter(out, lambda g: g.isNotNull())


def coverage(query: Column, target: Column) -> Column:
    """Share of the query's distinct tokens that the target has; 0 without tokens."""
    n = F.size(F.array_distinct(query))
    return F.when(n > 0, F.size(F.array_intersect(query, target)) / n).otherwise(0.0)


def dice(a: Column, b: Column) -> Column:
    na, nb = F.size(F.array_distinct(a)), F.size(F.array_distinct(b))
    return F.when((na > 0) & (nb > 0), 2 * F.size(F.array_intersect(a, b)) / (na + nb)).otherwise(0.0)


def numbers(x: Column) -> Column:
    return F.transform(F.regexp_extract_all(x, F.lit(r"(?<![A-Za-z0-9_])(\d+(?:\.\d+)?)(?![A-Za-z0-9_])"), F.lit(1)), lambda t: t.cast("double"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return F.when(b != 0, a.cast("double") / b)


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval; null for no trials."""
    p, m = hits.cast("double") / n, n.cast("double")
    middle, spread = p + z * z / (2 * m), z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m))
    return F.when(n > 0, (middle - spread) / (1 + z * z / m)), F.when(n > 0, (middle + spread) / (1 + z * z / m))
