"""Secret scans: known forms by pattern, unknown ones by the entropy of a sliding window.

Candidates are runs of 20 or more token characters.  A candidate belongs to the smallest of four
character classes that holds it.  A window of 20 characters slides over it; counts per character
and the sum of c * log2(c) change only for the character that enters and the one that leaves.
Where the window's entropy reaches the threshold of the class, its characters are reported,
unless the candidate is on the allow-list or lies within a span that a pattern has found.

Only DataFrame operations, row by row: nothing is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.llm.common import table

# The forms of the base rules, in the order in which kinds are listed.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
#: Character classes from small to large, with the bits per character from which a window counts.
CLASSES = (
    (r"[0-9a-fA-F]+", 3.0),
    (r"[A-Z0-9]+", 3.5),
    (r"[A-Za-z0-9]+", 3.7),
    (r"[A-Za-z0-9+/_-]+", 3.8),
)
#: What a part between separators is if it is no secret: words (small letters, with a capital
#: before them or not, or capitals, two letters or more), a number, or a part that says that it is
#: an example.  Repeats are possessive, so that no candidate is tried in many ways.
_PART = (
    r"(?:(?:[A-Z]?[a-z]{2,}+|[A-Z]{2,}+)++|[0-9]++"
    r"|[A-Za-z0-9]*?(?:(?i:example|sample|dummy|placeholder)|[xX]{4})[A-Za-z0-9]*+)"
)
#: Candidates that are no secrets whatever their entropy: prose, numbers, joined words, account
#: numbers, identifiers of the form 8-4-4-4-12, and strings that say in each doubtful part that
#: they are examples.
ALLOWED = (
    r"^[A-Z]?[a-z]+$",
    r"^[A-Z]+$",
    r"^[0-9+/_-]+$",
    rf"^[+/_-]*+(?:{_PART}(?:[+/_-]++|$))+$",
    r"^[A-Z]{2}[0-9]{13,32}$",
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
)
_BLOCK = 128
_SPAN = "struct<start:int,kind:int,end:int>"


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _append(pieces: Column, first: Column, step) -> Column:
    """Running ``(at, out)`` over ``pieces``; ``step(at, piece)`` gives the next at and an item."""

    def add(state, piece):
        at, item = step(state["at"], piece)
        return F.struct(at.alias("at"), F.concat(state["out"], F.array(item)).alias("out"))

    def kind(piece):
        return F.slice(F.array(step(F.lit(0), piece)[1]), 1, 0)

    empty = F.get(F.transform(F.slice(pieces, 1, 1), kind), F.lit(0))
    return F.aggregate(pieces, F.struct(first.alias("at"), empty.alias("out")), add)["out"]


def _placed(gaps: Column, matches: Column, fits: Column, kind: int) -> Column:
    """Spans from the texts between and in matches; cumulated in blocks, so that the cost stays
    near linear in the number of matches."""
    lengths = _let(
        F.struct(gaps.alias("gaps"), fits.alias("fits")),
        lambda once: F.transform(
            matches,
            lambda m, i: F.struct(
                F.length(F.get(once["gaps"], i)).alias("gap"),
                F.length(m).alias("len"),
                F.get(once["fits"], i).alias("fits"),
            ),
        ),
    )

    def blocks(all_):
        count = F.ceil(F.size(all_) / F.lit(_BLOCK)).cast("int")
        return F.transform(
            F.sequence(F.lit(0), count - 1), lambda b: F.slice(all_, b * _BLOCK + 1, F.lit(_BLOCK))
        )

    def sums(blocked):
        return F.transform(
            blocked, lambda x: F.aggregate(x, F.lit(0), lambda n, y: n + y["gap"] + y["len"])
        )

    def placed(blocked):
        def with_bases(bases):
            def one(block, b):
                return _append(
                    block,
                    F.get(bases, b),
                    lambda at, y: (
                        at + y["gap"] + y["len"],
                        F.struct(
                            (at + y["gap"]).alias("start"),
                            F.lit(kind).alias("kind"),
                            (at + y["gap"] + y["len"]).alias("end"),
                            y["fits"].alias("fits"),
                        ),
                    ),
                )

            return F.flatten(F.transform(blocked, one))

        bases = _append(sums(blocked), F.lit(0), lambda at, n: (at + n, at))
        return _let(bases, with_bases)

    return _let(lengths, lambda x: _let(blocks(x), placed))


def _spans(text: Column, pattern: str, kind: int, fits, group: int = 0) -> Column:
    """Leftmost non-overlapping matches, of which those remain whose group ``fits``."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def found(m):
        checked = m if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        spans = _placed(F.split(text, pattern, -1), m, F.transform(checked, fits), kind)
        kept = F.filter(spans, lambda s: s["fits"])
        return F.transform(kept, lambda s: F.struct(s["start"], s["kind"], s["end"])).cast(f"array<{_SPAN}>")

    none = F.array().cast(f"array<{_SPAN}>")
    return _let(matches, lambda m: F.when(F.size(m) > 0, found(m)).otherwise(none))


def _threshold(candidate: Column) -> Column:
    result = F.lit(CLASSES[-1][1])
    for pattern, bits in reversed(CLASSES[:-1]):
        result = F.when(candidate.rlike(f"^{pattern}$"), F.lit(bits)).otherwise(result)
    return result


def high_entropy(candidate: Column, window: int = WINDOW) -> Column:
    """(first, last): from where to where windows of the candidate reach its class's threshold."""
    table_of = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])

    def slide(chars):
        def step(state, i):
            enter = F.get(chars, i)
            leave = F.when(i >= window, F.get(chars, i - window)).otherwise(F.lit(-1))
            counts = state["counts"]
            change = lambda at, by: F.get(table_of, F.get(counts, at) + by) - F.get(table_of, F.get(counts, at))
            moved = F.when(enter == leave, F.lit(0.0)).otherwise(
                change(enter, 1) + F.when(leave >= 0, change(leave, -1)).otherwise(F.lit(0.0))
            )
            total = state["total"] + moved
            high = (i >= window - 1) & (F.lit(math.log2(window)) - total / window >= state["bits"])
            return F.struct(
                F.transform(
                    counts,
                    lambda c, k: c + F.when(k == enter, 1).otherwise(0) - F.when(k == leave, 1).otherwise(0),
                ).alias("counts"),
                total.alias("total"),
                state["bits"].alias("bits"),
                F.when(high & (state["first"] < 0), i - window + 1).otherwise(state["first"]).alias("first"),
                F.when(high, i + 1).otherwise(state["last"]).alias("last"),
            )

        start = F.struct(
            F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"),
            F.lit(0.0).alias("total"),
            _threshold(candidate).alias("bits"),
            F.lit(-1).alias("first"),
            F.lit(-1).alias("last"),
        )
        end = F.aggregate(F.sequence(F.lit(0), F.size(chars) - 1), start, step)
        return F.struct(end["first"].alias("first"), end["last"].alias("last"))

    chars = F.transform(F.split(candidate, ""), lambda c: F.position(c, F.lit(ALPHABET)) - 1)
    return _let(chars, slide)


def _entropy_spans(text: Column, base: Column) -> Column:
    allowed = "|".join(f"(?:{p})" for p in ALLOWED)
    matches = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))

    def found(m):
        spans = _placed(F.split(text, CANDIDATE, -1), m, F.transform(m, lambda c: ~c.rlike(allowed)), 3)
        kept = F.filter(
            F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["fits"].alias("fits"), F.get(m, i).alias("m"))),
            lambda s: s["fits"] & ~F.exists(base, lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"])),
        )
        windows = F.transform(
            kept, lambda s: F.struct(s["start"].alias("start"), high_entropy(s["m"]).alias("w"))
        )
        high = F.filter(windows, lambda s: s["w"]["first"] >= 0)
        return F.transform(
            high,
            lambda s: F.struct(
                (s["start"] + s["w"]["first"]).alias("start"),
                F.lit(3).alias("kind"),
                (s["start"] + s["w"]["last"]).alias("end"),
            ),
        ).cast(f"array<{_SPAN}>")

    none = F.array().cast(f"array<{_SPAN}>")
    return _let(matches, lambda m: F.when(F.size(m) > 0, found(m)).otherwise(none))


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` with the added column ``secrets``: spans (start, kind, end) in code points.

    ``kind`` is a place in ``KINDS``; ``end`` is exclusive; spans are sorted by start, then kind.
    Spans of one pattern do not overlap, spans of different kinds may.  Null and empty texts have
    none.  Each row is scanned by itself, so repeated rows and empty tables need no rule; other
    columns pass through unchanged.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.array_sort(
        F.concat(
            _spans(text, ASSIGN, 0, lambda v: F.length(v) >= 8, group=1),
            _spans(text, ACCESS, 1, lambda v: F.length(v) >= 16),
            _spans(text, r"[0-9a-f]{32,}", 2, lambda v: F.lit(True)),
        )
    )
    found = docs.withColumn("secrets", base)
    return found.withColumn(
        "secrets", F.array_sort(F.concat("secrets", _entropy_spans(text, F.col("secrets"))))
    )


def op9_entropy_secrets(spark, folder):
    found = scan(table(spark, folder, "documents").select("doc_id", "text"))
    names = F.array(*[F.lit(k) for k in KINDS])
    listed = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ","
    )
    of = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("bigint")
    base = F.filter("secrets", lambda s: s["kind"] < 3)
    return found.select(
        "doc_id",
        of(0).alias("n_assign"),
        of(1).alias("n_access"),
        of(2).alias("n_hex"),
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("secrets")).alias("spans"),
        of(3).alias("n_entropy"),
    )
