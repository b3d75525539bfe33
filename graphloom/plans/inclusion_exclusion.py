"""Counting an independent suffix without matching it: inclusion-exclusion over set partitions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import factorial

from ..patterns import Pairs, surviving_images
from .schedule import Schedule


def set_partitions(items: list[int]) -> Iterator[list[list[int]]]:
    if not items:
        yield []
        return
    for rest in set_partitions(items[1:]):
        yield [[items[0]], *rest]
        for i in range(len(rest)):
            yield [*rest[:i], [items[0], *rest[i]], *rest[i + 1 :]]


@dataclass(frozen=True)
class SuffixCount:
    """counts = sum of coefficient * product of |intersection of the block's candidate sets|, over divisor."""

    prefix: int
    terms: tuple[tuple[int, tuple[tuple[int, ...], ...]], ...]
    restrictions: Pairs
    divisor: int

    def describe(self) -> str:
        sizes = lambda blocks: " * ".join("|" + " & ".join(f"S{u}" for u in b) + "|" for b in blocks)
        return f"prefix of {self.prefix}: ({' '.join(f'{c:+d} * {sizes(b)}' for c, b in self.terms)}) / {self.divisor}"


def last_count(s: Schedule) -> SuffixCount | None:
    """The last vertex alone, counted by its one neighbour's degree; None if it has several, or if restrictions on it
    would be lost."""
    k = s.pattern.size
    single = sum(s.pattern.edge(k - 1, i) for i in range(k - 1)) == 1
    return suffix_count(s, 1) if single and not any(k - 1 in pair for pair in s.restrictions) else None


def suffix_count(s: Schedule, t: int | None = None) -> SuffixCount | None:
    """The last t vertices, the whole suffix unless given; then None if that is a single vertex.

    Restrictions on suffix vertices cannot be kept.  An occurrence is then found as often as automorphic
    images of it satisfy the surviving ones; if that number depends on the ids, none is kept."""
    k = s.pattern.size
    if t is None:
        t = s.suffix
        if t < 2:
            return None
    prefix = k - t
    kept = tuple(p for p in s.implied if max(p) < prefix)
    divisor = surviving_images(s.pattern, kept)
    if divisor is None:
        kept, divisor = (), len(s.pattern.automorphisms)
    terms: dict[tuple[tuple[int, ...], ...], int] = {}
    for partition in set_partitions(list(range(prefix, k))):
        coefficient = 1
        for block in partition:
            coefficient *= (-1) ** (len(block) - 1) * factorial(len(block) - 1)
        blocks = tuple(sorted(tuple(sorted({j for u in b for j in range(prefix) if s.pattern.edge(u, j)})) for b in partition))
        terms[blocks] = terms.get(blocks, 0) + coefficient  # equal sets count together
    return SuffixCount(prefix, tuple((c, b) for b, c in sorted(terms.items()) if c), kept, divisor)
