"""Spans of pattern matches inside whole texts, found with DataFrame functions only.

Matches are wrapped in a marker character, the text is split at the marker, and places follow from the lengths of the parts.
Places count code points; ends are exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import let

#: The marker, the character that stands for it in texts, and one for separators that stand next to another separator.
MARK, PLAIN, DOUBLED = "\x01", "\x02", "\x03"
#: Length of the context kept on each side of a match.
CONTEXT = 40
#: Parts walked together.
BLOCK = 1024

SPAN = "array<struct<s:int,k:int,e:int,v:string,before:string,after:string>>"


def plain_text(text: Column) -> Column:
    """The text without the characters used as markers, each replaced by one that no pattern here takes; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), MARK + DOUBLED, PLAIN + PLAIN)


def find_spans(text: Column, pattern: str, kind: int, ahead: int = CONTEXT) -> Column:
    """All leftmost non-overlapping matches of ``pattern`` as structs (start s, kind k, end e, value v, context before and
    after), in order. The context is what stands in the text, other matches included: CONTEXT code points before and
    ``ahead`` after."""
    parts = F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK)

    def fold(p: Column) -> Column:
        # every second part is a match and not empty, so a context lies within twice as many parts as it has code points
        tails = F.transform(p, lambda x: F.right(x, F.lit(CONTEXT)))
        heads = F.transform(p, lambda x: F.left(x, F.lit(ahead)))
        found = let(F.struct(tails.alias("tails"), heads.alias("heads")), lambda ends: _walk(p, ends["tails"], ends["heads"], kind, ahead))
        return F.when(F.size(p) > 1, found).otherwise(F.array().cast(SPAN))

    return let(parts, fold)


def _walk(p: Column, tails: Column, heads: Column, kind: int, ahead: int) -> Column:
    """The spans of all parts. Parts are walked in blocks, as each span is appended to the array of those before it in its
    block: the work is in proportion to the number of matches."""

    def before(i: Column) -> Column:
        last = F.get(tails, i - 1)
        several = F.array_join(F.slice(tails, F.greatest(i - 2 * CONTEXT + 1, F.lit(1)), F.least(i, F.lit(2 * CONTEXT))), "")
        return F.when(F.char_length(last) >= CONTEXT, last).otherwise(F.right(several, F.lit(CONTEXT)))

    def after(i: Column) -> Column:
        first = F.get(heads, i + 1)
        return F.when(F.char_length(first) >= ahead, first).otherwise(F.left(F.array_join(F.slice(heads, i + 2, F.lit(2 * ahead)), ""), F.lit(ahead)))

    def step(a: Column, x: Column) -> Column:
        end = a["at"] + F.char_length(x)
        span = F.struct(
            a["at"].alias("s"), F.lit(kind).alias("k"), end.alias("e"), x.alias("v"),
            before(a["i"]).alias("before"), after(a["i"]).alias("after"),
        )
        out = F.when(a["i"] % 2 == 1, F.concat(a["out"], F.array(span))).otherwise(a["out"])
        return F.struct(end.alias("at"), (a["i"] + 1).alias("i"), out.cast(SPAN).alias("out"))

    block = lambda k: F.slice(p, k * BLOCK + 1, F.lit(BLOCK))
    blocks = F.sequence(F.lit(0), ((F.size(p) - 1) / BLOCK).cast("int"))
    length = lambda k: F.aggregate(block(k), F.lit(0), lambda n, x: n + F.char_length(x))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    add = lambda a, k: F.struct((a["at"] + length(k)).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))

    def inside(bases: Column) -> Column:
        def one(k: Column) -> Column:
            zero = F.struct(F.get(bases, k).alias("at"), (k * BLOCK).alias("i"), F.array().cast(SPAN).alias("out"))
            return F.aggregate(block(k), zero, step, lambda a: a["out"])

        return F.flatten(F.transform(blocks, one))

    return let(F.aggregate(blocks, start, add, lambda a: a["out"]), inside)


def joined(spans: Column, kinds: list[str], *more: str) -> Column:
    """``kind:start:end`` (and the fields ``more``) of each span by start, then kind in the order of ``kinds``, joined by
    commas."""
    names = F.array(*[F.lit(k) for k in kinds])
    keys = F.array_sort(F.transform(spans, lambda x: F.struct(*[x[c].alias(c) for c in ("s", "k", "e", *more)])))
    return F.array_join(F.transform(keys, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"], *[x[c] for c in more])), ",")


def duckdb_spans(text: str, pattern: str, kind: int) -> str:
    """DuckDB's expression for find_spans: a list of {s, k, e, v, b, a}."""
    pattern = pattern.replace("'", "''")
    p = f"string_split(regexp_replace({text}, '{pattern}', chr(1) || '\\0' || chr(1), 'g'), chr(1))"
    at = f"list_sum(list_transform({p}[1:2*k-1], lambda x: length(x)))"
    return f"list_transform(range(1, len({p})//2 + 1), lambda k: {{'s': {at}::BIGINT, 'k': {kind}, 'e': ({at} + length({p}[2*k]))::BIGINT, 'v': {p}[2*k], 'b': right({p}[2*k-1], {CONTEXT}), 'a': left({p}[2*k+1], {CONTEXT})}})"


def duckdb_joined(spans: str, kinds: list[str], *more: str) -> str:
    names = "[" + ", ".join(f"'{k}'" for k in kinds) + "]"
    key = ", ".join(["x.s", "x.k", "x.e", *more])
    rest = "".join(f" || ':' || x[{4 + i}]" for i in range(len(more)))
    return f"coalesce(array_to_string(list_transform(list_sort(list_transform({spans}, lambda x: [{key}])), lambda x: {names}[x[2] + 1] || ':' || x[1] || ':' || x[3]{rest}), ','), '')"
