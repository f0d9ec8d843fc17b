"""Model terms: products of columns, written as a short formula."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Term:
    """A product of columns, each to a power; ``factors`` is sorted ((name, power), ...)."""

    factors: tuple[tuple[str, int], ...]

    @property
    def name(self) -> str:
        return "#".join("#".join([c] * p) for c, p in self.factors)

    def column(self) -> Column:
        product = None
        for name, power in self.factors:
            for _ in range(power):
                c = F.col(f"`{name}`").cast("double")
                product = c if product is None else product * c
        return product


def _term(names: list[str]) -> Term:
    order = list(dict.fromkeys(names))
    return Term(tuple((n, names.count(n)) for n in order))


def expand_terms(formula: str) -> list[Term]:
    """Read ``'a*b*c + x + x^2 + d:e'``.

    ``a*b*c`` stands for all products of its factors up to the full one, ``d:e`` for the
    product alone, ``x^2`` for a power. A term that appears twice is kept once, in first place.
    """
    found: dict[frozenset, Term] = {}
    for part in (p.strip() for p in formula.split("+")):
        if not part:
            continue
        if "^" in part:
            base, power = (s.strip() for s in part.split("^"))
            products = [[base] * int(power)]
        elif ":" in part:
            products = [[s.strip() for s in part.split(":")]]
        else:
            names = [s.strip() for s in part.split("*")]
            products = [list(c) for size in range(1, len(names) + 1) for c in combinations(names, size)]
        for product in products:
            term = _term(product)
            found.setdefault(frozenset(term.factors), term)
    return list(found.values())
