"""Running state over an array, and search in a sorted one, without copying what was built so far.

An ``aggregate`` copies its accumulator at every step, so one that collects n elements costs n * n.
Here an outer fold goes over runs of about sqrt(n) elements, and only one run is collected at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .let import let


def _width(items: Column) -> Column:
    return F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(items))).cast("int"))


def _runs(items: Column) -> Column:
    """The first positions (from 1) of the runs of items; at least one."""
    return F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(items)), _width(items))


class Emit:
    """What a step may return: the next state with or without an element."""

    def __init__(self, out: Column):
        self.out = out

    def nothing(self, state: Column) -> Column:
        return F.struct(state.alias("state"), self.out.alias("out"))

    def one(self, state: Column, element: Column) -> Column:
        return F.struct(state.alias("state"), F.concat(self.out, F.array(element)).alias("out"))


def scan(items: Column, zero: Column, step: Callable[[Column, Column, Emit], Column], element: str) -> Column:
    """What the steps emit, in order; ``step(state, item, emit)`` returns ``emit.nothing(...)`` or ``emit.one(...)``."""
    none = F.array().cast(f"array<{element}>")
    start = F.struct(zero.alias("state"), F.array().cast(f"array<array<{element}>>").alias("out"))

    def fold(xs: Column) -> Column:
        def run(acc: Column, at: Column) -> Column:
            return F.aggregate(
                F.slice(xs, at, _width(xs)),
                F.struct(acc["state"].alias("state"), none.alias("out")),
                lambda a, x: step(a["state"], x, Emit(a["out"])),
                lambda a: F.struct(a["state"].alias("state"), F.concat(acc["out"], F.array(a["out"])).alias("out")),
            )

        return F.aggregate(_runs(xs), start, run, lambda acc: F.flatten(acc["out"]))

    return let(items, fold)


def pieces(text: Column, items: Column, start: str, end: str, bound: bool = False) -> Column:
    """``struct(parts, rest)``: for each of the ascending disjoint items the ``gap`` before it and its ``value``.

    A substring is found by walking the text from its start; each run of items walks its own part only.
    ``bound`` says that ``items`` is a variable already.
    """
    zero = F.struct(
        F.lit(0).cast("int").alias("pos"), text.alias("rest"), F.array().cast("array<array<struct<gap:string,value:string>>>").alias("out")
    )

    def fold(xs: Column) -> Column:
        def run(acc: Column, at: Column) -> Column:
            last = F.get(xs, F.least(at + _width(xs) - 1, F.size(xs)) - 1)[end]

            def inside(seg: Column) -> Column:
                def piece(x: Column, i: Column) -> Column:
                    before = F.when(i == 0, acc["pos"]).otherwise(F.get(xs, at + i - 2)[end])
                    return F.struct(
                        F.substring(seg, before - acc["pos"] + 1, x[start] - before).alias("gap"),
                        F.substring(seg, x[start] - acc["pos"] + 1, x[end] - x[start]).alias("value"),
                    )

                return F.struct(
                    last.alias("pos"),
                    F.substring(acc["rest"], last - acc["pos"] + 1, F.length(acc["rest"])).alias("rest"),
                    F.concat(acc["out"], F.array(F.transform(F.slice(xs, at, _width(xs)), piece))).alias("out"),
                )

            cut = let(F.substring(acc["rest"], F.lit(1), last - acc["pos"]), inside)
            return F.when(F.size(xs) == 0, acc).otherwise(cut)

        return F.aggregate(_runs(xs), zero, run, lambda acc: F.struct(F.flatten(acc["out"]).alias("parts"), acc["rest"].alias("rest")))

    return fold(items) if bound else let(items, fold)


def count_up_to(ordered: Column, value: Column) -> Column:
    """How many elements of an ascending array are at most ``value``, by binary search."""
    strides = F.array(*[F.lit(1 << k) for k in reversed(range(31))])
    return F.aggregate(
        strides,
        F.lit(0),
        lambda at, s: F.when((at <= F.size(ordered) - s) & (F.get(ordered, at + s - 1) <= value), at + s).otherwise(at),
    )
