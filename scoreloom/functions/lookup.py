"""Lookups in a known table of phrases as an expression: no join, no shuffle, and one probe of a set per word n-gram instead of one search per phrase."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


class Phrases:
    """A known table of phrases as constant sets, one of all phrases and one per value: an expression with nothing to build per row, also within a conditional."""

    def __init__(self, values: Mapping[str, str]):
        self._all, self._by_value = list(values), {}
        for phrase, value in values.items():
            self._by_value.setdefault(value, []).append(phrase)

    def _known(self, phrase: Column) -> Column:
        return phrase.isin(*self._all) if self._all else F.lit(False)

    def entry(self, phrase: Column) -> Column:
        """(phrase, value) of an exact phrase, or null."""

        def of(p: Column) -> Column:
            values = [F.when(p.isin(*own), F.lit(value)) for value, own in self._by_value.items()]
            return F.when(self._known(p), F.struct(p.alias("phrase"), F.coalesce(*values, F.lit(None).cast("string")).alias("value")))

        return let(phrase, of)

    def within(self, words: Column, more: int) -> Column:
        """(phrase, value) of the phrase that is a run of the words but for up to ``more`` of them: the one of most letters, then the first by name."""
        n = F.size(words)
        runs = [F.when(n > gone, F.array_join(F.slice(words, F.lit(at + 1), n - gone), " ")) for gone in range(more + 1) for at in range(gone + 1)]
        found = F.transform(F.filter(F.array(*runs), self._known), lambda p: F.struct((-F.length(p)).alias("short"), p.alias("phrase")))
        return self.entry(F.array_min(found)["phrase"])
