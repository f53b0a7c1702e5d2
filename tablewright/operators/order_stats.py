"""Exact order statistics from mergeable sketches, without bringing a column into one task.

A sketch pass (``percentile_approx``) brackets every wanted rank between two values of the column. One more scan counts what lies below a bracket and
collects what lies strictly inside; values equal to its ends are only counted, so repeated values never fill a bracket, and inside there is at most a
known share of the rows. Brackets that still hold many rows are sketched again first. All brackets of all columns share each scan, and what is returned
is exact whatever the sketch's error: a rank that turns out to lie outside its bracket is looked for between the column's ends.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A sketch's rank error is one over ``ACCURACY`` of the rows; a bracket reaches ``REACH`` times that to either side.
ACCURACY, REACH = 10_000, 3
#: Rows a bracket may hold to be collected, and cuts of a bracket that holds more.
FETCH_ROWS, CUTS = 20_000, 256
#: Aggregates of an aggregation, and aggregations of a job, where numbers are taken in packs.
PACK_AGGS, PACKS_AT_ONCE = 14, 32


@dataclass(frozen=True)
class Sketch:
    """Non-null values of a column, the smallest and largest, and its values at ``points`` (shares of the rows), about."""

    rows: int
    low: float | None
    high: float | None
    points: tuple[float, ...]
    values: tuple[float, ...]


@dataclass
class Bracket:
    """Two values of a column and the 0-based ranks that are looked for between them; ``rows`` lie strictly inside at most."""

    name: str
    low: float
    high: float
    rows: float
    ranks: set[int] = field(default_factory=set)


def sketch_points(probs: Iterable[float]) -> tuple[float, ...]:
    return tuple(sorted({min(1.0, max(0.0, p + d)) for p in probs for d in (-REACH / ACCURACY, REACH / ACCURACY)}))


def sketch_aggs(x: Column, points: tuple[float, ...], suffix: str = "") -> list[Column]:
    """What ``sketch_of`` reads from a row: count, ends and about the values at ``points``."""
    return [F.count(x).alias(f"sk_n{suffix}"), F.min(x).alias(f"sk_low{suffix}"), F.max(x).alias(f"sk_high{suffix}"),
            F.percentile_approx(x, F.array(*map(F.lit, points)), F.lit(ACCURACY)).alias(f"sk_at{suffix}")]


def sketch_of(row, points: tuple[float, ...], suffix: str = "") -> Sketch:
    return Sketch(row[f"sk_n{suffix}"], row[f"sk_low{suffix}"], row[f"sk_high{suffix}"], points, tuple(row[f"sk_at{suffix}"] or ()))


def brackets_of(name: str, sketch: Sketch, ranks: set[int]) -> list[Bracket]:
    """Brackets of the ranks of a column; few rows are one bracket from end to end."""
    if sketch.rows <= FETCH_ROWS:
        return [Bracket(name, sketch.low, sketch.high, sketch.rows, set(ranks))] if ranks else []
    found: dict[tuple[float, float], Bracket] = {}
    for rank in ranks:
        share = rank / sketch.rows
        below = [v for p, v in zip(sketch.points, sketch.values) if p <= share - 1.5 / ACCURACY]
        above = [v for p, v in zip(sketch.points, sketch.values) if p >= share + 1.5 / ACCURACY]
        ends = below[-1] if below else sketch.low, above[0] if above else sketch.high
        found.setdefault(ends, Bracket(name, *ends, 0.0)).ranks.add(rank)
    for b in found.values():
        # From the last point at the lower end to the first at the upper one.
        low = max((p for p, v in zip(sketch.points, sketch.values) if v <= b.low), default=0.0)
        high = min((p for p, v in zip(sketch.points, sketch.values) if v >= b.high), default=1.0)
        b.rows = max(0.0, high - low + 2 / ACCURACY) * sketch.rows
    return list(found.values())


def _inside(b: Bracket, x: Column) -> Column:
    return F.when((x > b.low) & (x < b.high), x)


def _cuts(x: Column) -> Column:
    return F.percentile_approx(x, F.array(*[F.lit(k / CUTS) for k in range(1, CUTS)]), F.lit(ACCURACY))


def bracket_counts(brackets: list[Bracket], exprs: dict[str, Column], tag: str = "b") -> list[dict[str, Column]]:
    """For every bracket, how many rows lie below it, at its ends and inside, by name; nothing lies between equal ends."""
    out: list[dict[str, Column]] = []
    for i, b in enumerate(brackets):
        x = exprs[b.name]
        out.append({f"below_{tag}{i}": F.count_if(x < b.low), f"low_{tag}{i}": F.count_if(x == b.low)})
        if b.low != b.high:
            out[-1] |= {f"high_{tag}{i}": F.count_if(x == b.high), f"inside_{tag}{i}": F.count(_inside(b, x))}
    return out


def bracket_held(brackets: list[Bracket], exprs: dict[str, Column], tag: str = "b") -> dict[str, Column]:
    """What lies inside every bracket with two ends: collected where few rows do, else sketched."""
    out: dict[str, Column] = {}
    for i, b in enumerate(brackets):
        if b.low != b.high:
            inner = _inside(b, exprs[b.name])
            out[f"held_{tag}{i}"] = F.sort_array(F.collect_list(inner)) if b.rows <= FETCH_ROWS else _cuts(inner)
    return out


def counted_in_packs(df: DataFrame, groups: Iterable[dict[str, Column]]) -> dict[str, float | None]:
    """Numeric aggregates by name, a few in each of the aggregations that run side by side, as Spark compiles few at once far better than many.

    Aggregates of a group, such as those of one column, stay together: every aggregation reads its own columns only.
    """
    packs: list[dict[str, Column]] = []
    for group in groups:
        if not packs or len(packs[-1]) + len(group) > PACK_AGGS:
            packs.append({})
        packs[-1] |= group
    found: dict[str, float | None] = {}
    for start in range(0, len(packs), PACKS_AT_ONCE):
        some = packs[start : start + PACKS_AT_ONCE]
        parts = [df.agg(F.array(*[a.cast("double") for a in p.values()]).alias("v")).select(F.lit(i).alias("pack"), "v") for i, p in enumerate(some)]
        for r in reduce(DataFrame.union, parts).collect():
            found |= zip(some[r["pack"]], r["v"])
    return found


def bracket_scan(df: DataFrame, brackets: list[Bracket], exprs: dict[str, Column], also: dict[str, dict[str, Column]] | None = None, others: list[Column] | None = None, stored: bool = False) -> dict:
    """What ``resolved`` reads, with the counts ``also`` by column and any ``others``: one scan, or of a ``stored`` table one of each column for the
    counts, one of all for what lies inside the brackets, whose rows leave their columns before they are aggregated, and one for the others."""
    groups = {c: dict((also or {}).get(c, {})) for c in exprs}
    for b, counts in zip(brackets, bracket_counts(brackets, exprs)):
        groups[b.name] |= counts
    if not stored:
        named = [*groups.values(), bracket_held(brackets, exprs)]
        aggs = [a.alias(name) for some in named for name, a in some.items()] + (others or [])
        return df.agg(*aggs).first().asDict() if aggs else {}
    out = counted_in_packs(df, [g for g in groups.values() if g])
    out |= df.agg(*others).first().asDict() if others else {}
    wide = [i for i, b in enumerate(brackets) if b.low != b.high]
    if wide:
        x, sketched = F.col("x"), F.col("b").isin([i for i in wide if brackets[i].rows > FETCH_ROWS])
        cells = F.array(*[F.struct(F.lit(i).alias("b"), _inside(brackets[i], exprs[brackets[i].name]).alias("x")) for i in wide])
        held = df.select(F.inline(cells)).where(x.isNotNull()).groupBy("b").agg(
            F.sort_array(F.collect_list(F.when(~sketched, x))).alias("all"), _cuts(F.when(sketched, x)).alias("cuts"))
        out |= {f"held_b{r['b']}": r["cuts"] or r["all"] for r in held.collect()}
    return out


def resolved(row: dict, brackets: list[Bracket], ends: dict[str, Sketch], tag: str = "b") -> tuple[dict[tuple[str, int], float], list[Bracket]]:
    """Values at ranks that a ``bracket_scan`` has settled, and narrower brackets of the others."""
    found: dict[tuple[str, int], float] = {}
    left: dict[tuple, Bracket] = {}

    def again(b: Bracket, rank: int, low: float, high: float, rows: float) -> None:
        left.setdefault((b.name, low, high), Bracket(b.name, low, high, rows)).ranks.add(rank)

    for i, b in enumerate(brackets):
        below, at_low = (int(row[f"{k}_{tag}{i}"]) for k in ("below", "low"))
        at_high, inside = (int(row[f"{k}_{tag}{i}"]) if b.low != b.high else 0 for k in ("high", "inside"))
        held = row.get(f"held_{tag}{i}") or []
        for rank in b.ranks:
            place = rank - below
            if not 0 <= place < at_low + inside + at_high:
                again(b, rank, ends[b.name].low, ends[b.name].high, ends[b.name].rows)
            elif place < at_low:
                found[(b.name, rank)] = b.low
            elif place >= at_low + inside:
                found[(b.name, rank)] = b.high
            elif b.rows <= FETCH_ROWS:
                found[(b.name, rank)] = held[place - at_low]
            else:
                share = (place - at_low) / inside * CUTS
                k = [k for k in range(len(held)) if k + 1 <= share - CUTS / ACCURACY - 0.01]
                m = [k for k in range(len(held)) if k + 1 >= share + CUTS / ACCURACY + 0.01]
                low, high = held[k[-1]] if k else b.low, held[m[0]] if m else b.high
                again(b, rank, low, high, inside * (3 / CUTS + 2 / ACCURACY))
    return found, list(left.values())


def ranked_values(df: DataFrame, exprs: dict[str, Column], sketches: dict[str, Sketch], ranks: dict[str, set[int]], found: dict[tuple[str, int], float] | None = None, left: list[Bracket] | None = None, stored: bool = False) -> dict[tuple[str, int], float]:
    """The value at every wanted 0-based rank; a scan or two settle a table of some ten million rows, every further one takes 80 times as many."""
    found = dict(found or {})
    left = [b for c, r in ranks.items() for b in brackets_of(c, sketches[c], r)] if left is None else left
    while left:
        more, left = resolved(bracket_scan(df, left, exprs, stored=stored), left, sketches)
        found |= more
    return found


def quantile_ranks(rows: int, probs: Iterable[float]) -> set[int]:
    return {f(p * (rows - 1)) for p in probs for f in (math.floor, math.ceil)} if rows else set()


def interpolated(name: str, rows: int, probs: Iterable[float], found: dict[tuple[str, int], float]) -> list[float | None]:
    out: list[float | None] = []
    for p in probs:
        pos = p * (rows - 1)
        below, above = math.floor(pos), math.ceil(pos)
        if not rows:
            out.append(None)
            continue
        low, high = found[(name, below)], found[(name, above)]
        # The weights of the built-in percentile, for the same bits.
        out.append(low if below == above or low == high else (above - pos) * low + (pos - below) * high)
    return out


def exact_quantiles(df: DataFrame, exprs: dict[str, Column], probs: list[float]) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of several DOUBLE expressions; NULLs are skipped."""
    if not exprs:
        return {}
    points = sketch_points(probs)
    row = df.agg(*[a for i, x in enumerate(exprs.values()) for a in sketch_aggs(x, points, str(i))]).first()
    sketches = {c: sketch_of(row, points, str(i)) for i, c in enumerate(exprs)}
    found = ranked_values(df, exprs, sketches, {c: quantile_ranks(s.rows, probs) for c, s in sketches.items()})
    return {c: interpolated(c, s.rows, probs, found) for c, s in sketches.items()}


def order_values(df: DataFrame, expr: Column, ranks_of: Callable[[int], list[int]]) -> list[float]:
    """The values at the 0-based ranks that ``ranks_of`` names for the number of non-null values of a DOUBLE expression."""
    points = tuple(k / CUTS for k in range(1, CUTS))
    sketch = sketch_of(df.agg(*sketch_aggs(expr, points)).first(), points)
    ranks = ranks_of(sketch.rows)
    found = ranked_values(df, {"v": expr}, {"v": sketch}, {"v": set(ranks)})
    return [found[("v", r)] for r in ranks]
