"""Recognizers that are no regular expression, as table functions for SQL's LATERAL, and the check digits of numbers.

A finder gets a text and gives its spans; :func:`span_function` makes a table function of it, to which rows come and from which they go in
Arrow batches. Where the same can be said by built-in expressions (see :func:`checked`), those are faster.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: A finder: a text in, (entity_type, start, end, score) of each span out.
Finder = Callable[[str], Iterable[tuple[str, int, int, float]]]

# Weights of the digits of the two national numbers, without their check digits.
MY_NUMBER_WEIGHTS = (6, 5, 4, 3, 2, 7, 6, 5, 4, 3, 2)
CORPORATE_WEIGHTS = (2, 1, 2, 1, 2, 1, 2, 1, 2, 1, 2, 1)


def luhn(digits: list[int]) -> bool:
    twice = [2 * d for d in digits[-2::-2]]
    return (sum(digits[-1::-2]) + sum(t - 9 if t > 9 else t for t in twice)) % 10 == 0


def my_number(digits: list[int]) -> bool:
    """The last of 12 digits is 11 less the weighted sum's rest by 11, or 0 where the rest is 0 or 1."""
    rest = sum(w * d for w, d in zip(MY_NUMBER_WEIGHTS, digits)) % 11
    return digits[11] == (0 if rest <= 1 else 11 - rest)


def corporate_number(digits: list[int]) -> bool:
    """The first of 13 digits is 9 less the weighted sum's rest by 9."""
    return digits[0] == 9 - sum(w * d for w, d in zip(CORPORATE_WEIGHTS, digits[1:])) % 9


_NUMBER = re.compile(r"(?<!\w)\d{1,4}(?:[ \-]?\d{4}){2,3}(?!\w)|(?<!\w)\d{12,16}(?!\w)")


def checked_numbers(text: str) -> Iterator[tuple[str, int, int, float]]:
    """Numbers of 12, 13 and 16 digits, in one piece or cut by blanks or hyphens, whose check digits are right."""
    for m in _NUMBER.finditer(text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        right = {12: ("MY_NUMBER", my_number), 13: ("MY_NUMBER_CORPORATE", corporate_number), 16: ("CREDIT_CARD", luhn)}.get(len(digits))
        if right and right[1](digits):
            yield right[0], m.start(), m.end(), 1.0


def span_function(find: Finder):
    """A table function ``f(text)``: ``entity_type, start, end, score, text`` of the spans that ``find`` gives. A null text has none."""

    class Spans:
        def eval(self, text: str) -> Iterator[tuple[str, int, int, float, str]]:
            for entity, start, end, score in find(text) if text else ():
                yield entity, start, end, score, text[start:end]

    return F.udtf(Spans, returnType="entity_type string, start int, end int, score double, text string", useArrow=True)


def register_finder(spark: SparkSession, name: str, find: Finder) -> None:
    """Makes ``name`` a table function of the session: ``SELECT d.id, s.* FROM docs AS d, LATERAL name(d.text) AS s``."""
    spark.udtf.register(name, span_function(find))


def checked(entity: str, text: Column) -> Column:
    """Whether the check digits of a number, as text, are right; null for other types and lengths, built-in expressions only."""
    digits = F.regexp_replace(text, r"[^0-9]", "")
    digit = lambda i: F.substring(digits, i + 1, 1).cast("int")
    weighed = lambda weights, at: sum((digit(i + at) * w for i, w in enumerate(weights)), F.lit(0))
    if entity == "CREDIT_CARD":
        return F.when(F.length(digits) == 16, F.call_function("luhn_check", digits))
    if entity == "MY_NUMBER":
        rest = weighed(MY_NUMBER_WEIGHTS, 0) % 11
        return F.when(F.length(digits) == 12, digit(11) == F.when(rest <= 1, 0).otherwise(11 - rest))
    if entity == "MY_NUMBER_CORPORATE":
        return F.when(F.length(digits) == 13, digit(0) == 9 - weighed(CORPORATE_WEIGHTS, 1) % 9)
    return F.lit(None).cast("boolean")
