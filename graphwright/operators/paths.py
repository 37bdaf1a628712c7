"""Paths of any form through a triple table: an expression becomes a small automaton, and a search goes over pairs of a node and a state.

Expressions are nested tuples:

    ("iri", predicate)                  one triple
    ("inverse", e)                      against the arrow
    ("sequence", e, e)                  one after the other
    ("alternative", [e, ...])           any of them
    ("repeat", e, zero, many)           none too if `zero`, more than once if `many`: (True, True) is *, (False, True) +, (True, False) ?
    ("negated", [(predicate, inverse)]) a triple with none of the predicates; those marked inverse against the arrow

A node is its text and whether it is a literal, so that a literal never goes on as the node of the same text.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphwright.sources.scratch import drop, stored


@dataclass
class Automaton:
    """States are numbers. A move is (state, predicates, whether these are the ones excluded, inverse, next state); `blank` moves take no triple."""

    moves: list[tuple[int, tuple[str, ...], bool, bool, int]] = field(default_factory=list)
    blank: dict[int, set[int]] = field(default_factory=lambda: defaultdict(set))
    states: int = 0

    def state(self) -> int:
        self.states += 1
        return self.states - 1

    def add(self, e: tuple, inverse: bool = False) -> tuple[int, int]:
        """The first and the last state of an expression."""
        kind = e[0]
        if kind == "inverse":
            return self.add(e[1], not inverse)
        if kind == "sequence":
            (a, b), (c, d) = (self.add(x, inverse) for x in ((e[2], e[1]) if inverse else (e[1], e[2])))
            self.blank[b].add(c)
            return a, d
        first, last = self.state(), self.state()
        if kind == "iri":
            self.moves.append((first, (e[1],), False, inverse, last))
        elif kind == "negated":
            for against in (False, True):
                names = tuple(p for p, i in e[1] if i == against)
                if names or (not against and not e[1]):
                    self.moves.append((first, names, True, against != inverse, last))
        elif kind == "alternative":
            for x in e[1]:
                a, b = self.add(x, inverse)
                self.blank[first].add(a)
                self.blank[b].add(last)
        elif kind == "repeat":
            a, b = self.add(e[1], inverse)
            self.blank[first].add(a)
            self.blank[b].add(last)
            if e[2]:
                self.blank[first].add(last)
            if e[3]:
                self.blank[b].add(a)
        else:
            raise ValueError(f"{kind} isn't a path")
        return first, last

    def from_(self, state: int) -> set[int]:
        """The states that blank moves lead to, this one included."""
        seen, left = {state}, [state]
        while left:
            for n in self.blank[left.pop()] - seen:
                seen.add(n)
                left.append(n)
        return seen


def compiled(e: tuple) -> tuple[list[tuple[int, tuple[str, ...], bool, bool, int]], int, set[int]]:
    """Moves without blank ones, the first state, and those in which a path may end."""
    a = Automaton()
    first, last = a.add(e)
    moves = {(s, *m[1:]) for s in range(a.states) for t in a.from_(s) for m in a.moves if m[0] == t}
    ends = {s for s in range(a.states) if last in a.from_(s)}
    # only states that a path from the first one gets to
    seen, left = {first}, [first]
    while left:
        at = left.pop()
        for m in moves:
            if m[0] == at and m[4] not in seen:
                seen.add(m[4])
                left.append(m[4])
    return sorted(m for m in moves if m[0] in seen), first, ends & seen


def _steps(t: DataFrame, moves: list[tuple[int, tuple[str, ...], bool, bool, int]]) -> DataFrame:
    """(src, src_literal, state, dst, dst_literal, next): what each triple lets a search do. One scan; where predicates are named, of theirs only."""
    literal = F.col("o_kind") == "literal"
    tests, made = [], []
    for state, names, excluded, inverse, after in moves:
        test: Column = F.col("p").isin(*names) if names else F.lit(False)
        test = ~test if excluded else test
        ends = (F.col("o"), literal, F.col("s"), F.lit(False)) if inverse else (F.col("s"), F.lit(False), F.col("o"), literal)
        made.append(F.when(test, F.struct(ends[0].alias("src"), ends[1].alias("src_literal"), F.lit(state).alias("state"), ends[2].alias("dst"), ends[3].alias("dst_literal"), F.lit(after).alias("next"))))
        tests.append(test)
    some = t.where(reduce(lambda a, b: a | b, tests))
    return some.select(F.inline(F.filter(F.array(*made), lambda m: m.isNotNull()))).distinct()


def search(t: DataFrame, e: tuple, start: DataFrame | None = None) -> DataFrame:
    """(src, src_literal, dst, dst_literal): distinct pairs of nodes with a path between them, from the nodes of `start` (node, literal), or from all of the graph's.

    Breadth first: a round joins only the pairs found in the last one with the steps of their state, and keeps what is new; rounds are written to tables. A node given is
    joined with itself by an empty path even if the graph doesn't have it.
    """
    moves, first, ends = compiled(e)
    known = front = None
    steps = stored(_steps(t, moves)) if moves else None
    if start is None and first in ends:
        nodes = t.select(F.col("s").alias("node"), F.lit(False).alias("literal")).union(t.select("o", F.col("o_kind") == "literal"))
    elif start is None:
        nodes = steps.where(F.col("state") == first).select(F.col("src").alias("node"), F.col("src_literal").alias("literal"))
    else:
        nodes = start
    nodes = nodes.where("node is not null").distinct()
    front = stored(nodes.select(F.col("node").alias("src"), F.col("literal").alias("src_literal"), F.col("node").alias("at"), F.col("literal").alias("at_literal"), F.lit(first).alias("state")))
    known = front
    while steps is not None:
        on = (F.col("at") == F.col("m.src")) & (F.col("at_literal") == F.col("m.src_literal")) & (F.col("f.state") == F.col("m.state"))
        new = front.alias("f").join(steps.alias("m"), on).select("f.src", "f.src_literal", F.col("dst").alias("at"), F.col("dst_literal").alias("at_literal"), F.col("next").alias("state")).distinct()
        front = stored(new.join(known, ["src", "src_literal", "at", "at_literal", "state"], "left_anti"))
        if front.isEmpty():
            drop(front)
            break
        known = known.union(front)
    return known.where(F.col("state").isin(*ends)).select("src", "src_literal", F.col("at").alias("dst"), F.col("at_literal").alias("dst_literal")).distinct()
