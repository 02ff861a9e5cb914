"""Scalar column expressions: rounding, dates, paths, text and hashes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Source suffixes known to the graph builder.
SOURCE_SUFFIX = r"\.(tsx?|jsx?|mjs|cjs|mts|cts|py|go|rs|rb|java|kt)$"
# File patterns that mark a test; each use has its own rule.
TEST_FILE = {
    "graph": r"(?i)(?:^|[\\/])(test|tests|__tests__|spec)(?:[\\/]|\.|\b)|(?:\.test|\.spec)\.[a-z]+$",
    "impact": r"(?:\.test\.|^test[/\\])",
    "gates_dir": r"(^|/)(test|tests|__tests__|spec|e2e)/",
    "gates_name": r"\.(test|spec)\.[cm]?[jt]sx?$",
    "context": r"(?i)(?:^|/)(?:test|tests|__tests__)(?:/|\b)|\.(?:test|spec)\.",
    "authors": r"\.(test|spec)\.(ts|tsx|js|jsx|mjs|py|go|rs|rb|java|kt)$|_test\.(go|py|rs)$|Test\.(java|kt)$",
}
MICROS_PER_DAY = 86_400_000_000


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def half_up(x: Column, digits: int = 0) -> Column:
    """Round halves towards +infinity; DOUBLE result."""
    k = 10.0**digits
    return F.floor(x * F.lit(k) + F.lit(0.5)).cast("double") / F.lit(k)


def clamp(x: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def trim(c: Column | str) -> Column:
    """Strip blanks, tabs and line ends on both sides."""
    return F.btrim(col(c), F.lit(" \t\r\n\f"))


def micros(ts: Column | str) -> Column:
    return F.unix_micros(col(ts).cast("timestamp"))


def days_between(a: Column | str, b: Column | str) -> Column:
    """Fractional days from a to b."""
    return (micros(b) - micros(a)) / F.lit(float(MICROS_PER_DAY))


def slashes(path: Column | str) -> Column:
    return F.regexp_replace(F.translate(col(path), "\\", "/"), r"^\./", "")


def strip_suffix(path: Column | str) -> Column:
    return F.regexp_replace(col(path), SOURCE_SUFFIX, "")


def basename(path: Column | str) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def dirname(path: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(col(path), r"[^/]*$", ""), r"/$", "")


def first_segment(path: Column | str) -> Column:
    return F.substring_index(col(path), "/", 1)


def suffix_of(path: Column | str) -> Column:
    """Lower-case extension with its dot, or ''."""
    return F.lower(F.regexp_extract(basename(path), r".(\.[^.]+)$", 1))


def join_path(base: Column | str, rel: Column | str) -> Column:
    """Resolve ``rel`` against directory ``base`` ('.' and '..' included).

    Leading './' and '../' steps cut that many folders off the base. Paths with
    steps further in, or that climb out of the root, are folded step by step.
    """
    lead = F.regexp_extract(col(rel), r"^((?:\.\.?/)*)", 1)
    tail = F.regexp_replace(col(rel), r"^(?:\.\.?/)*", "")
    up = F.size(F.split(lead, r"\.\./")) - 1
    folders = F.filter(F.split(col(base), "/"), lambda p: p != "")
    kept = F.array_join(F.slice(folders, F.lit(1), F.greatest(F.lit(0), F.size(folders) - up)), "/")
    plain = ~tail.rlike(r"(^|/)\.\.?(/|$)|//|/$") & (up <= F.size(folders))
    return F.when(plain, F.when(kept == "", tail).otherwise(F.concat(kept, F.lit("/"), tail))).otherwise(_fold_path(base, rel))


def _fold_path(base: Column | str, rel: Column | str) -> Column:
    joined = F.concat(F.when(col(base) == "", F.lit("")).otherwise(F.concat(col(base), F.lit("/"))), col(rel))
    parts = F.filter(F.split(joined, "/"), lambda p: (p != "") & (p != "."))
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(
            (p == "..") & (F.size(acc) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), acc), -1) != ".."),
            F.slice(acc, F.lit(1), F.size(acc) - 1),
        ).otherwise(F.concat(acc, F.array(p))),
    )
    return F.array_join(folded, "/")


def module_id(path: Column | str) -> Column:
    return F.concat(F.lit("module:"), strip_suffix(path))


def symbol_module(symbol_id: Column | str) -> Column:
    """symbol:<rel>#<name> -> module:<rel>; other ids stay."""
    c = col(symbol_id)
    return F.when(
        c.startswith("symbol:"),
        F.concat(F.lit("module:"), F.regexp_extract(c, r"^symbol:([^#]*)", 1)),
    ).otherwise(c)


def evidence_file(evidence: Column | str) -> Column:
    return F.substring_index(col(evidence), ":", 1)


def evidence_of(path: Column, line: Column) -> Column:
    return F.concat_ws(":", path, line.cast("string"))


def token_estimate(text: Column | str) -> Column:
    return F.ceil(F.length(col(text)) / F.lit(4.0)).cast("bigint")


def words(text: Column | str, min_len: int = 3) -> Column:
    """Distinct lower-case [a-z0-9_]+ words in first-seen order."""
    found = F.regexp_extract_all(F.lower(col(text)), F.lit(r"([a-z0-9_]+)"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda w: F.length(w) >= min_len))


def contained(text: Column | str, terms: Column | list[str]) -> Column:
    """Number of terms that occur in the text (case-insensitive)."""
    lower = F.lower(col(text))
    if isinstance(terms, list):
        hits = [F.when(lower.contains(F.lit(t)), 1).otherwise(0) for t in terms]
        return reduce(lambda a, b: a + b, hits, F.lit(0)).cast("bigint")
    return F.size(F.filter(terms, lambda w: F.contains(lower, w))).cast("bigint")


def excerpt(text: Column | str, max_lines: int = 28) -> Column:
    kept = F.filter(F.split(col(text), "\n"), lambda line: trim(line) != "")
    return F.array_join(F.slice(kept, 1, max_lines), "\n")


def email_slug(email: Column | str) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(col(email)), r"[^a-z0-9]+", "_"), r"^_|_$", "")
    return F.when(slug == "", F.lit("local_user")).otherwise(slug)


def normalise_span(text: Column | str) -> Column:
    """Drop trailing blanks on each line and final newlines."""
    return F.regexp_replace(F.regexp_replace(col(text), r"(?md)[ \t]+$", ""), r"\n+\z", "")


def span_hash(text: Column | str) -> Column:
    return F.substring(F.sha2(normalise_span(text), 256), 1, 16)


def line_span(text: Column | str, start: Column, end: Column) -> Column:
    """Lines start..end (1-based, end clamped); NULL when out of range."""
    lines = F.split(col(text), "\n")
    n = F.size(lines)
    ok = (start >= 1) & (end >= start) & (start <= n)
    return F.when(ok, F.array_join(F.slice(lines, F.when(ok, start).otherwise(1), F.when(ok, F.least(end, n) - start + 1).otherwise(1)), "\n"))


def squeeze_markdown(text: Column | str) -> Column:
    """Token-saving clean-up of prose: comments, trailing blanks, filler phrases, blank runs."""
    # Phrases and their short forms.
    steps = [
        (r"\r\n", "\n"),
        (r"(?m)\A(---\n(?:(?!---)[^\n]*\n)*)version:[^\n]*\n", "$1"),
        (r"<!--[\s\S]*?-->", ""),
        (r"(?md)[ \t]+$", ""),
        (r"[Pp]lease note that\s*", ""),
        (r"Make sure to\s*", "Ensure "),
        (r"make sure to\s*", "ensure "),
        (r"It is important to\s*", "Must "),
        (r"it is important to\s*", "must "),
        (r"\n{3,}", "\n\n"),
        (r"\s+\z", ""),
    ]
    out = reduce(lambda c, s: F.regexp_replace(c, s[0], s[1]), steps, col(text))
    return F.concat(out, F.lit("\n"))
