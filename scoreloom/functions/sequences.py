"""How alike two sequences are by their matching blocks, as an expression: no shuffle, no Python worker.

The longest block that both sequences hold comes first (of equal ones the earliest in the first sequence, then in the second), then the same left of it and
right of it, until nothing matches. An index of the second sequence gives the places of every token of the first; places that follow each
other on a diagonal are one run. What is left to do is a stack of lists of runs: the longest run of the top list is a block, and the others, cut
to what lies before and after it in both sequences, are two lists again.

Time and memory grow with the number of runs, that is with how often a token stands in both sequences.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scoreloom.functions.lookup import let

def common_places(a: Column, b: Column) -> Column:
    """How many pairs of places of two arrays hold the same token: what ``matched`` takes memory for."""

    def of(both: Column) -> Column:
        x, y = both["a"], both["b"]
        times = lambda c, t: (F.size(c) - F.size(F.array_remove(c, t))).cast("long")
        return F.aggregate(F.array_distinct(x), F.lit(0).cast("long"), lambda n, t: n + times(x, t) * times(y, t))

    return let(F.struct(a.alias("a"), b.alias("b")), of)


def _runs(a: Column, b: Column) -> Column:
    """Maximal runs of equal tokens along diagonals, as (n, i, j): length, and the places negated, so that the largest run is the next block."""

    def indexed(pairs: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(b) - 1), lambda k: (k == 0) | (F.get(pairs, k)["x"] != F.get(pairs, k - 1)["x"]))

        def placed(firsts: Column) -> Column:
            def cells(keys: Column) -> Column:
                def of(x: Column, i: Column) -> Column:
                    found = lambda p: F.transform(F.slice(pairs, F.get(firsts, p - 1) + 1, F.coalesce(F.get(firsts, p), F.size(b)) - F.get(firsts, p - 1)), lambda s: F.struct(i.alias("i"), s["j"].alias("j")))
                    return let(F.array_position(keys, x).cast("int"), lambda p: F.when(p > 0, found(p)).otherwise(F.array().cast("array<struct<i:int,j:int>>")))

                return F.flatten(F.transform(a, of))

            return let(F.transform(firsts, lambda k: F.get(pairs, k)["x"]), cells)

        return let(first, placed)

    def ends(cells: Column, step: int) -> Column:
        """Cells whose neighbour on the diagonal doesn't match, as diagonal and place, sorted."""
        matches = lambda c: F.get(a, c["i"] + step) == F.get(b, c["j"] + step)  # noqa: E731 - null beyond the edges
        last = F.filter(cells, lambda c: ~F.coalesce(matches(c), F.lit(False)))
        return F.sort_array(F.transform(last, lambda c: F.struct((c["j"] - c["i"]).alias("d"), c["i"].alias("i"))))

    def run(s: Column, e: Column) -> Column:
        return F.struct((e["i"] - s["i"] + 1).alias("n"), (-s["i"]).alias("i"), (-s["i"] - s["d"]).alias("j"))

    pairs = F.sort_array(F.transform(b, lambda x, j: F.struct(x.alias("x"), j.alias("j"))))
    return let(let(pairs, indexed), lambda cells: F.zip_with(ends(cells, -1), ends(cells, 1), run))


def matched(a: Column, b: Column) -> Column:
    """Tokens in matching blocks of two arrays without nulls."""

    def run(n: Column, i: Column, j: Column) -> Column:
        return F.struct(n.alias("n"), i.alias("i"), j.alias("j"))

    def singles(frame: Column) -> Column:
        """Blocks of a list without longer runs: each is the earliest that lies after the one before it, so one pass in order finds them."""
        after = lambda at, r: F.when((r["i"] < at["i"]) & (r["j"] < at["j"]), F.struct((at["n"] + 1).alias("n"), r["i"].alias("i"), r["j"].alias("j"))).otherwise(at)
        return F.aggregate(F.sort_array(frame, False), run(F.lit(0), F.lit(1), F.lit(1)), after, lambda at: at["n"])

    def step(acc: Column, _: Column) -> Column:
        def split(frame: Column) -> Column:
            def by(best: Column) -> Column:
                di, dj = best["n"] - best["i"], best["n"] - best["j"]  # where the block ends

                def cut_before(r: Column) -> Column:
                    room = F.least(r["i"] - best["i"], r["j"] - best["j"])
                    return F.when(r["n"] == 1, r).otherwise(run(F.least(r["n"], room), r["i"], r["j"]))

                def cut_after(r: Column) -> Column:
                    gone = F.greatest(F.lit(0), di + r["i"], dj + r["j"])
                    return F.when(r["n"] == 1, r).otherwise(let(gone, lambda g: run(r["n"] - g, r["i"] - g, r["j"] - g)))

                before = F.filter(frame, lambda r: (r["i"] > best["i"]) & (r["j"] > best["j"]))
                after = F.filter(frame, lambda r: (r["n"] - r["i"] > di) & (r["n"] - r["j"] > dj))
                two = F.array(F.transform(before, cut_before), F.transform(after, cut_after))
                rest = F.slice(acc["stack"], F.lit(1), F.size(acc["stack"]) - 1)
                goes_on = F.struct(F.concat(rest, F.filter(two, lambda f: F.size(f) > 0)).alias("stack"), (acc["total"] + best["n"]).alias("total"))
                return F.when(best["n"] == 1, F.struct(rest.alias("stack"), (acc["total"] + singles(frame)).alias("total"))).otherwise(goes_on)

            return let(F.array_max(frame), by)

        return F.when(F.size(acc["stack"]) == 0, acc).otherwise(let(F.element_at(acc["stack"], -1), split))

    def counted(runs: Column) -> Column:
        steps = F.least(F.size(a), F.size(b), F.size(runs))
        start = F.struct(F.array(runs).alias("stack"), F.lit(0).alias("total"))
        return F.when(F.size(runs) == 0, F.lit(0)).otherwise(F.aggregate(F.sequence(F.lit(1), steps), start, step, lambda acc: acc["total"]))

    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0)).otherwise(let(_runs(a, b), counted))


def ratio(a: Column, b: Column) -> Column:
    """Twice the matched tokens over all tokens; 1 for two empty arrays, null if one is null."""

    def of(both: Column) -> Column:
        x, y = both["a"], both["b"]
        size = F.size(x) + F.size(y)
        return F.when(x.isNull() | y.isNull(), F.lit(None).cast("double")).when(size == 0, F.lit(1.0)).otherwise(2.0 * matched(x, y) / size)

    return let(F.struct(a.alias("a"), b.alias("b")), of)
