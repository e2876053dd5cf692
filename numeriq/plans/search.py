"""Searches among subsets of changes, each tested by a job: the smallest that fails, the largest that passes, and a smallest difference between the two.

A test gives PASS, FAIL or UNRESOLVED. How candidates are tested, split and repaired are hooks, and an index of tested sets spares tests: with monotone outcomes
(more changes never pass where fewer fail) a subset of what passed passes and a superset of what failed fails.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

PASS, FAIL, UNRESOLVED = "PASS", "FAIL", "UNRESOLVED"


def even_parts(items: list, n: int) -> list[list]:
    """n contiguous parts whose sizes differ by one at most."""
    bounds = [len(items) * k // n for k in range(n + 1)]
    return [items[a:b] for a, b in zip(bounds, bounds[1:])]


@dataclass
class SetIndex:
    """Outcomes of tested sets, found by the set itself, by a superset or by a subset. Only the largest sets that pass and the smallest that fail are compared."""

    known: dict = field(default_factory=dict)
    passed: list = field(default_factory=list)
    failed: list = field(default_factory=list)

    def add(self, items: frozenset, outcome: str) -> None:
        self.known[items] = outcome
        if outcome == PASS and not self.inside_passed(items):
            self.passed = [s for s in self.passed if not s <= items] + [items]
        if outcome == FAIL and not self.around_failed(items):
            self.failed = [s for s in self.failed if not s >= items] + [items]

    def inside_passed(self, items: frozenset) -> bool:
        return any(items <= s for s in self.passed)

    def around_failed(self, items: frozenset) -> bool:
        return any(items >= s for s in self.failed)


@dataclass
class Search:
    """test: of a frozenset. split(items, n): parts. resolve(candidate, low, high): another candidate between low and high for one that is unresolved, or None.
    report(low, high): called whenever the search narrows."""

    test: Callable[[frozenset], str]
    split: Callable[[list, int], list[list]] = even_parts
    resolve: Callable[[frozenset, frozenset, frozenset], frozenset | None] = lambda candidate, low, high: None
    report: Callable[[frozenset, frozenset], None] = lambda low, high: None
    monotone: bool = False
    index: SetIndex = field(default_factory=SetIndex)
    runs: int = 0
    spared: int = 0

    def outcome(self, items: frozenset) -> str:
        if items in self.index.known:
            self.spared += 1
            return self.index.known[items]
        if self.monotone and (self.index.inside_passed(items) or self.index.around_failed(items)):
            self.spared += 1
            return PASS if self.index.inside_passed(items) else FAIL
        self.runs += 1
        self.index.add(items, self.test(items))
        return self.index.known[items]

    def settled(self, items: frozenset, low: frozenset, high: frozenset) -> tuple[str, frozenset]:
        """The outcome of a candidate, repaired while it is unresolved; a repair that reaches an end of the range says nothing."""
        tried = {items}
        outcome = self.outcome(items)
        while outcome == UNRESOLVED:
            other = self.resolve(items, low, high)
            if other is None or other in tried or not low < other < high:
                return UNRESOLVED, items
            items = other
            tried.add(items)
            outcome = self.outcome(items)
        return outcome, items

    def narrowed(self, items: Sequence, shrink_failing: bool, grow_passing: bool) -> tuple[frozenset, frozenset]:
        """(low, high): low passes, high fails and holds low, and no single part of their difference can be moved any more."""
        place = {x: k for k, x in enumerate(items)}
        low, high = frozenset(), frozenset(items)
        if self.outcome(high) != FAIL:
            return high, high
        if self.outcome(low) != PASS:
            return low, low
        n = 2
        while len(high - low) > 1 or (len(high - low) == 1 and not (shrink_failing and grow_passing)):
            rest = sorted(high - low, key=place.__getitem__)
            n = min(n, len(rest))
            step = self.step(low, high, [frozenset(p) for p in self.split(rest, n)], shrink_failing, grow_passing)
            if step:
                low, high, coarse = step
                n = 2 if coarse else max(2, n - 1)
                self.report(low, high)
            elif n >= len(rest):
                break
            else:
                n = min(len(rest), 2 * n)
        return low, high

    def step(self, low: frozenset, high: frozenset, parts: list[frozenset], shrink_failing: bool, grow_passing: bool):
        """The first move that the parts allow: (low, high, whether to split in two again). Small candidates first, then large ones."""
        for part in parts:
            outcome, found = self.settled(low | part, low, high)
            if outcome == FAIL and shrink_failing and found < high:
                return low, found, True
            if outcome == PASS and grow_passing and found > low:
                return found, high, False
        for part in parts:
            outcome, found = self.settled(high - part, low, high)
            if outcome == PASS and grow_passing and found > low:
                return found, high, True
            if outcome == FAIL and shrink_failing and found < high:
                return low, found, False
        return None

    def smallest_failing(self, items: Sequence) -> frozenset:
        """A set that fails, from which no single item can be taken without its passing or being unresolved; empty if all items pass."""
        if self.outcome(frozenset(items)) != FAIL:
            return frozenset()
        return self.narrowed(items, True, False)[1]

    def largest_passing(self, items: Sequence) -> frozenset:
        """A set that passes, to which no single item can be added."""
        if self.outcome(frozenset(items)) == PASS:
            return frozenset(items)
        return self.narrowed(items, False, True)[0]

    def difference(self, items: Sequence) -> tuple[frozenset, frozenset]:
        """(low, high): a passing and a failing set that differ by as little as can be, mostly one item: it is what makes the difference there."""
        return self.narrowed(items, True, True)
