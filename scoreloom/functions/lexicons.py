"""The lexicon of skills as a table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from scoreloom.functions import fixed

TOKEN = r"[\w+#]+(?:\.[\w+#]+)*"


def form_of(name: str) -> str:
    """A name as the tokens that texts are cut into, in lower case."""
    return " ".join(re.findall(TOKEN, name.lower()))


def signs_of(name: str) -> str:
    """What stands between the words of a name besides blanks and hyphens."""
    return re.sub(rf"{TOKEN}|[\s-]", "", name)


def lexicon(spark: SparkSession, skills: dict[str, list[str]] | None = None, others: dict[str, list[str]] | None = None, exact_case: list[str] | None = None, list_only: list[str] | None = None) -> DataFrame:
    """(form, skill, category, name, order, exact_case, list_only); a form that two skills share is an error.

    Names that differ in what stands between their words, like a slash, are rows of their own. A name in ``exact_case`` counts only as it is written, one in ``list_only`` in a list as well. A name that begins with a full stop
    counts in its own case, as the stop isn't part of a token.
    """
    own = skills is None
    skills, others = skills or fixed.SKILLS, others if others is not None else fixed.OTHER_NAMES if own else {}
    exact, listed = set(exact_case if exact_case is not None else fixed.EXACT_CASE), set(list_only if list_only is not None else fixed.LIST_ONLY)
    rows: dict[tuple[str, str], tuple] = {}
    for category, names in skills.items():
        for skill in names:
            for name in [skill, *others.get(skill, [])]:
                form, written = form_of(name), name.lstrip(".")
                strict = name in exact or name in listed or written != name
                key = (form, written if strict else signs_of(written))
                if rows.setdefault(key, (form, skill, category, written, len(rows), name in exact or written != name, name in listed))[1] != skill:
                    raise ValueError(f"{name!r} names both {rows[key][1]} and {skill}")
    return spark.createDataFrame(list(rows.values()), "form string, skill string, category string, name string, `order` int, exact_case boolean, list_only boolean")
