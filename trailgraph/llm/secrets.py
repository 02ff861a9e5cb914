"""Secret scan: fixed patterns, and guess costs of values in credential contexts.

The method: a value that follows a credential word is cut into pieces (words,
dates, repeats, keyboard walks, brute-force spans) so that the guesses needed
are least, by dynamic programming over its characters. A value that needs at
least 10^``log_guesses`` guesses is a secret. A word's rank is the number of
corpus words at least as common. All words of the corpus have one; only on
request are those beyond rank ``vocabulary`` left out. Values are taken out
first, and only the words inside them are looked up, by an equality join.

Null text counts as empty. Repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailgraph.llm import text as T
from trailgraph.runtime import cut_lineage

# The base patterns.
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = {"assign": 0, "access": 1, "hex": 2, "guess": 3}
# Words that announce a credential.
CONTEXT = re.compile(r"""(?<![A-Za-z])(?:password|passphrase|passwd|pass|pwd|secret|token|api_?key|access_?key|private_?key|credentials?|auth|login|bearer)["']?(?:\x20*[:=]\x20*|\x20+is\x20+)["']?([^\s"'<>,;]{6,})""", re.I | re.A)
HINTS = (b"pass", b"pwd", b"secret", b"token", b"key", b"credential", b"auth", b"login", b"bearer")
DATE = re.compile(r"(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d|(?:19|20)\d\d")
# Keyboard rows.
ROWS = ["1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz"]
_NEXT = {a + b for row in ROWS for r in (row, row[::-1]) for a, b in zip(r, r[1:])}

# Blocks of several periods are tried up to this size: two of the longest words fit in. One period may be of any size.
BLOCK = 48

# Parts in one Arrow batch.
BATCH = 1 << 14

DATE_COST, WALK_COST = math.log10(365 * 120), math.log10(len("".join(ROWS)) * 4)


def pieces(value: str, ranks: dict[str, int]):
    """(start, end, log10 guesses) of every piece that isn't brute force."""
    low, n = value.lower(), len(value)
    for i in range(n):
        for j in range(i + 3, min(n, i + 24) + 1):
            rank = ranks.get(low[i:j])
            if rank:
                yield i, j, math.log10(rank + 1) + (0.0 if value[i:j] == low[i:j] else math.log10(2) if value[i:j].istitle() or value[i:j].isupper() else (j - i) * math.log10(2))
    for m in (DATE.match(value, i) for i in range(n)):
        if m:
            yield m.start(), m.end(), DATE_COST
    for step, cost in ((lambda a, b: a == b, math.log10(95)), (lambda a, b: a + b in _NEXT, WALK_COST)):
        i = 0
        while i < n:
            j = i + 1
            while j < n and step(low[j - 1], low[j]):
                j += 1
            if j - i >= 3:
                yield i, j, cost + math.log10(j - i)
            i = j
    for i, j, p in runs(low):  # a repeated block costs its first copy and a count
        for size in (p, *range(2 * p, min(BLOCK, (j - i) // 2) + 1, p)):
            if size > 1:
                yield i, i + (j - i) // size * size, log_guesses(value[i : i + size], ranks) + math.log10((j - i) // size)


def runs(s: str) -> set[tuple[int, int, int]]:
    """(start, end, period) of all maximal repetitions: s[start:end] has its least period at least twice.

    Each one holds a longest Lyndon word of one of the two letter orders, from
    which it is extended both ways by hashed comparisons: n log n steps.
    """
    n, m = len(s), (1 << 61) - 1
    powers, sums = [1], [0]
    for c in s:
        powers.append(powers[-1] * 0x1F3D5B79A2C4E687 % m)
        sums.append((sums[-1] * 0x1F3D5B79A2C4E687 + ord(c) + 1) % m)

    def same(i, j, k):
        return (sums[i + k] - sums[j + k] - (sums[i] - sums[j]) * powers[k]) % m == 0

    def alike(i, j, most, back):
        """Characters alike from i and j on, or before i and j."""
        lo, step, up = 0, 1, True
        while step:  # doubling, then halving
            if lo + step <= most and (same(i - lo - step, j - lo - step, step) if back else same(i + lo, j + lo, step)):
                lo += step
            else:
                up = False
            step = step * 2 if up else step // 2
        return lo

    found = set()
    for flip in (False, True):
        following = [n] * n  # of every i, the end of the longest Lyndon word that begins there
        for i in range(n - 1, -1, -1):
            j = i + 1
            while j < n:
                k = alike(i, j, n - j, False)
                # the end of the text is less than any letter in both orders
                if j + k < n and (s[i + k] < s[j + k]) != flip:
                    j = following[j]
                else:
                    break
            following[i] = j
        for i, j in enumerate(following):
            p = j - i
            start = i - alike(i, j, i, True)
            end = j + alike(i, j, n - j, False)
            if end - start >= 2 * p:
                found.add((start, end, p))
    return found


def log_guesses(value: str, ranks: dict[str, int]) -> float:
    """Least log10 guesses over all ways to cut the value into pieces."""
    best = [0.0] + [math.inf] * len(value)
    ends: dict[int, list] = {}
    for i, j, cost in pieces(value, ranks):
        ends.setdefault(j, []).append((i, cost))
    for j in range(1, len(value) + 1):
        c = value[j - 1]
        size = 10 if c.isdigit() else 26 if c.isalpha() else 33
        best[j] = best[j - 1] + math.log10(size)
        for i, cost in ends.get(j, ()):
            best[j] = min(best[j], best[i] + cost)
    return best[-1]


def corpus_ranks(docs: DataFrame, text_col: str, vocabulary: int | None = None) -> DataFrame:
    """w, rank: the corpus's words of 3 to 24 letters; words equally common share the last of their places.

    Values after credential words don't count: a secret isn't known for standing there.
    """

    def count(batch):
        for _, _, data, offsets in T.chunks(batch.column(0), T.CHUNK * 4):
            c, raw = Counter(), data.tobytes()
            for a, b in zip(offsets, offsets[1:]):
                low = raw[a:b].lower()
                if any(h in low for h in HINTS):
                    low = CONTEXT.sub(lambda m: m[0][: m.start(1) - m.start()], raw[a:b].decode()).encode().lower()
                c.update(re.findall(rb"[a-z]{3,24}", low))
            yield {"w": [w.decode() for w in c], "n": list(c.values())}

    words = cut_lineage(T.arrow_map(docs.select(text_col), count, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")))
    # One row per different count: their number grows with the square root of the corpus at most.
    places = words.groupBy("n").agg(F.count("*").alias("k")).withColumn("rank", F.sum("k").over(W.orderBy(F.desc("n"))))
    ranked = words.join(places.select("n", "rank"), "n").select("w", "rank")
    return ranked if vocabulary is None else ranked.filter(F.col("rank") <= vocabulary)


def parts(value: str) -> set[str]:
    """All runs of 3 to 24 letters a-z inside the value, lowered."""
    low = value.lower()
    return {m[0][i:j] for m in re.finditer("[a-z]{3,}", low) for i in range(len(m[0]) - 2) for j in range(i + 3, min(len(m[0]), i + 24) + 1)}


def value_costs(values: DataFrame, ranks: DataFrame) -> DataFrame:
    """value, cost: log10 guesses of the different ``values`` (value).

    The parts of a value carry its digest, not the value, and leave a task in bounded batches.
    """
    keyed = values.select("value", F.sha2("value", 256).alias("key"))

    def cut(batch):
        for v, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            inside = sorted(parts(v))
            for i in range(0, len(inside), BATCH):
                yield {"key": [key] * len(inside[i : i + BATCH]), "w": inside[i : i + BATCH]}

    def cost(batch):
        out = [(v, log_guesses(v, {x["w"]: x["rank"] for x in r or ()})) for v, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        yield {"value": [v for v, _ in out], "cost": [c for _, c in out]}

    known = T.arrow_map(keyed, cut, "key string, w string").join(ranks, "w").groupBy("key").agg(F.collect_list(F.struct("w", "rank")).alias("r"))
    return T.arrow_map(keyed.join(known, "key", "left").select("value", "r"), cost, "value string, cost double")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def in_order(found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return sorted(found, key=lambda s: (s[0], KINDS[s[2]]))


def spans(text: str, ranks: dict[str, int], threshold: float) -> list[tuple[int, int, str]]:
    return in_order(base_spans(text) + [(m.start(1), m.end(1), "guess") for m in CONTEXT.finditer(text) if log_guesses(m[1], ranks) >= threshold])


_BUSY = re.compile(rb"[0-9a-f]{24}")
_SPAN = "struct<start:bigint,end:bigint,kind:string>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: int | None = None, log_guesses: float = 10.0) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans ('kind:start:end', comma-joined), n_guess."""

    def one(batch):
        out = {k: [] for k in ("key", "doc_id", "base", "may")}
        texts = batch.column(2).cast(pa.binary())
        for i, (key, doc_id) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            raw = texts[i].as_py() or b""
            low = raw.lower()
            text = raw.decode() if any(h in low for h in HINTS) or b"AKIA" in raw or _BUSY.search(raw) else ""
            base = [{"start": a, "end": b, "kind": k} for a, b, k in in_order(base_spans(text))]
            may = [{"start": m.start(1), "end": m.end(1), "value": m[1]} for m in CONTEXT.finditer(text)]
            for k, v in zip(out, (key, doc_id, base, may)):
                out[k].append(v)
        yield out

    def told(batch):
        out = {k: [] for k in ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess")}
        line = lambda ss: ",".join(f"{k}:{a}:{b}" for a, b, k in ss)
        for doc_id, base, guess in zip(*(batch.column(i).to_pylist() for i in range(3))):
            base = [(x["start"], x["end"], x["kind"]) for x in base]
            guess = [(x["start"], x["end"], "guess") for x in guess or ()]
            kinds = Counter(k for _, _, k in base)
            row = (doc_id, kinds["assign"], kinds["access"], kinds["hex"], hashlib.sha256(line(base).encode()).hexdigest(), line(in_order(base + guess)), len(guess))
            for k, v in zip(out, row):
                out[k].append(v)
        yield out

    src = docs.select(T.row_key(id_col, text_col).alias("key"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = cut_lineage(T.arrow_map(src, one, f"key long, doc_id long, base array<{_SPAN}>, may array<struct<start:bigint,end:bigint,value:string>>"))
    may = rows.filter(F.size("may") > 0).select("key", F.explode("may").alias("m")).select("key", "m.*").distinct()
    hard = value_costs(cut_lineage(may.select("value").distinct()), corpus_ranks(docs, text_col, vocabulary)).filter(F.col("cost") >= log_guesses)
    guess = may.join(hard, "value").groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("guess"))
    return T.arrow_map(rows.join(guess, "key", "left").select("doc_id", "base", "guess"), told, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long")
