"""Search schemes: generators from their published definitions, files, mirrors, selection, and coverage as relational work.

A search visits parts in the order pi; after each step the errors so far lie between its lower bound l and its
upper bound u. A scheme is lossless for k errors if every distribution of at most k errors over the parts
fits one of its searches.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Search:
    pi: tuple[int, ...]
    l: tuple[int, ...]  # noqa: E741
    u: tuple[int, ...]

    def mirrored(self) -> Search:
        top = len(self.pi) - 1
        return Search(tuple(top - p for p in self.pi), self.l, self.u)

    def problems(self) -> list[str]:
        """What makes the search invalid: no permutation, parts that don't touch, bounds that fall or cross."""
        out = []
        if sorted(self.pi) != list(range(len(self.pi))) or not len(self.pi) == len(self.l) == len(self.u):
            return ["no permutation of the parts with a bound for each"]
        if any(p not in (min(self.pi[:i]) - 1, max(self.pi[:i]) + 1) for i, p in enumerate(self.pi) if i):
            out.append("parts are not connected")
        if any(a > b for x in (self.l, self.u) for a, b in zip(x, x[1:], strict=False)):
            out.append("bounds fall")
        if any(a > b for a, b in zip(self.l, self.u, strict=True)):
            out.append("a lower bound exceeds its upper bound")
        return out

    def covers(self, errors: tuple[int, ...]) -> bool:
        total = 0
        for p, low, high in zip(self.pi, self.l, self.u, strict=True):
            total += errors[p]
            if not low <= total <= high:
                return False
        return True


def _from(i: int, parts: int) -> tuple[int, ...]:
    """Parts from i to the right end, then to the left."""
    return (*range(i, parts), *range(i - 1, -1, -1))


def naive(k: int) -> list[Search]:
    return [Search((0,), (0,), (k,))]


def pigeonhole(k: int) -> list[Search]:
    """One of k + 1 parts has no error."""
    return [Search(_from(i, k + 1), (0,) * (k + 1), (0, *(k,) * k)) for i in range(k + 1)]


def suffix_filter(k: int) -> list[Search]:
    """From some part on, each prefix of the rest has fewer errors than parts."""
    out = []
    for i in range(k + 1):
        right = k + 1 - i
        out.append(Search(_from(i, k + 1), (0,) * (k + 1), (*range(right), *(k,) * i)))
    return out


def zero_ones_zero(k: int) -> list[Search]:
    """Of k + 2 parts two have no error and those between them one each."""
    p, out = k + 2, []
    for i in range(k + 1):
        right = p - i
        u = [0, 1 if right > 2 else 0, *(k,) * (p - 2)]
        out.append(Search(_from(i, p), (0,) * p, tuple(u)))
    return out


GENERATORS = {"naive": naive, "pigeon": pigeonhole, "suffix_filter": suffix_filter, "01*0": zero_ones_zero}


def parse(text: str) -> list[Search]:
    """Searches of a scheme file: three vectors in braces a line, with or without commas between them."""
    out = []
    for line in text.splitlines():
        found = re.findall(r"\{([^}]*)\}", line)
        if found:
            if len(found) != 3:
                raise ValueError(f"three vectors are needed: {line!r}")
            out.append(Search(*(tuple(int(x) for x in v.split(",")) for v in found)))
    return out


def mirrored(scheme: list[Search]) -> list[Search]:
    return [s.mirrored() for s in scheme]


def critical_part(scheme: list[Search]) -> int:
    """The part whose exact search weighs most: of the search with the largest upper and smallest lower bounds."""
    worst = max(range(len(scheme)), key=lambda i: (scheme[i].u, tuple(-x for x in scheme[i].l), -i))
    return scheme[worst].pi[0]


def distributions(spark: SparkSession, parts: int, k: int) -> DataFrame:
    """errors: array<int> of every distribution of at most k errors over the parts."""
    digit = [F.floor(F.col("id") / (k + 1) ** i) % (k + 1) for i in range(parts)]
    rows = spark.range((k + 1) ** parts).select(F.array(*[d.cast("int") for d in digit]).alias("errors"))
    return rows.where(F.aggregate("errors", F.lit(0), lambda s, x: s + x) <= k)


def is_covered(errors: Column, search: Search) -> Column:
    total, ok = F.lit(0), F.lit(True)
    for p, low, high in zip(search.pi, search.l, search.u, strict=True):
        total = total + F.get(errors, p)
        ok = ok & total.between(low, high)
    return ok


def coverage(spark: SparkSession, scheme: list[Search], k: int) -> DataFrame:
    """errors, searches: how many searches cover each distribution; 0 is a gap."""
    n = F.lit(0)
    for s in scheme:
        n = n + is_covered(F.col("errors"), s).cast("int")
    return distributions(spark, len(scheme[0].pi), k).withColumn("searches", n)


def is_lossless(scheme: list[Search], k: int) -> bool:
    parts = len(scheme[0].pi)
    return all(any(s.covers(e) for s in scheme) for e in product(range(k + 1), repeat=parts) if sum(e) <= k)


def select(reads: DataFrame, frequencies: DataFrame, schemes: dict[str, list[Search]], kmer: int) -> DataFrame:
    """read_id, scheme: for each read the scheme whose critical part begins with the rarest k-mer (by name among equals)."""
    options = []
    for name, scheme in sorted(schemes.items()):
        parts, at = len(scheme[0].pi), critical_part(scheme)
        begin = F.floor(at * F.length("seq") / parts).cast("int")
        options.append(F.struct(F.lit(name).alias("scheme"), F.substr("seq", begin + 1, F.lit(kmer)).alias("kmer")))
    each = reads.select("read_id", F.explode(F.array(*options)).alias("o")).select("read_id", "o.*")
    seen = each.join(frequencies, "kmer", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return seen.groupBy("read_id").agg(F.min_by("scheme", F.struct("n", "scheme")).alias("scheme"))
