"""Phrases such as `X die from Y` to path strings: the pipeline's converter and the evaluator's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from .stem import stem, stem_lower

# Auxiliary verb forms, and particles.
AUX = [
    "be", "am", "is", "are", "was", "were", "been", "being", "do", "does", "did", "have", "has", "had", "will",
    "would", "shall", "should", "can", "could", "may", "might", "must",
]
PARTICLES = ["up", "down", "out", "in", "off", "on", "over", "through"]

#: White space that the source's patterns mean.
SPACE = r"[ \t\n\x0B\f\r]"


def _words(inner: Column) -> Column:
    return F.filter(F.split(inner, SPACE + "+"), lambda w: w != "")


def _active(verb: Column) -> Column:
    return F.concat(F.lit("N:<nsubj:V:"), verb, F.lit(":>dobj:N"))


def _with(verb: Column, preposition: Column) -> Column:
    return F.concat(F.lit("N:<nsubj:V:"), verb, F.lit(":>prep:P:"), preposition, F.lit(":>pobj:N"))


def phrase_to_path(phrase: Column, normal: Callable[[Column], Column] = stem) -> Column:
    """The pipeline's path of `X ... Y`, or null: an auxiliary verb in front is passed over, `by` makes a passive."""
    inner = F.regexp_replace(F.regexp_replace(phrase, f"^X{SPACE}+", ""), f"{SPACE}+Y$", "")
    words = _words(inner)
    n = F.size(words)
    first = F.when((n >= 2) & F.lower(words[0]).isin(AUX), 1).otherwise(0)
    left = n - first
    at = lambda k: F.get(words, first + k)
    passive = (left >= 2) & (F.lower(F.get(words, n - 1)) == "by")
    particle = (left == 3) & F.lower(at(1)).isin(PARTICLES)
    verb = normal(F.when(passive, F.get(words, n - 2)).when(particle, F.concat(at(0), F.lower(at(1)))).otherwise(at(0)))
    return (
        F.when(n == 0, None)
        .when(passive, F.concat(F.lit("N:<nsubjpass:V:"), verb, F.lit(":>prep:P:by:>pobj:N")))
        .when(left == 1, _active(verb))
        .when(left == 2, _with(verb, F.lower(at(1))))
        .when(particle, _with(verb, F.lower(at(2))))
    )


def phrase_to_path_eval(phrase: Column, normal: Callable[[Column], Column] = stem_lower) -> Column:
    """The evaluator's path: every X and Y goes, one or two words are taken, a passive has an agent."""
    words = _words(F.translate(phrase, "XY", ""))
    n = F.size(words)
    verb = normal(F.get(words, F.lit(0)))
    return (
        F.when(n == 1, _active(verb))
        .when((n == 2) & (F.get(words, F.lit(1)) != "by"), _with(verb, F.get(words, F.lit(1))))
        .when(n == 2, F.concat(F.lit("N:<nsubjpass:V:"), verb, F.lit(":>agent:P:by:>pobj:N")))
    )
