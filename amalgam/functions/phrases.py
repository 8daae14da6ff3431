"""Aliases as whole phrases, matched against text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Alias:
    """Phrases by which an entity is named, and phrases that contain one but mean something else."""

    entity: str
    phrases: tuple[str, ...]
    excluded: tuple[str, ...] = ()


def phrase_pattern(phrases: tuple[str, ...]) -> str:
    """Any of the phrases with no ASCII letter, digit or underscore at either end, and any space between their words; empty for
    none. Spelled out, as engines differ in what their word boundary counts as a letter."""
    inside = "[0-9A-Za-z_]"
    return f"(?<!{inside})(?:" + "|".join(r"\s+".join(p.split()) for p in phrases) + f")(?!{inside})" if phrases else ""


def alias_rules(df: DataFrame, aliases: list[Alias]) -> DataFrame:
    """entity, pattern, excluded: a row for each entity."""
    rows = [(a.entity, phrase_pattern(a.phrases), phrase_pattern(a.excluded)) for a in aliases]
    return df.sparkSession.createDataFrame(rows, "entity string, pattern string, excluded string")


def mentions(texts: DataFrame, text: str, aliases: list[Alias]) -> DataFrame:
    """Rows of ``texts`` with the entity that their text names. One pattern of all phrases drops most rows before the rules,
    which a person wrote, are broadcast to the rest."""
    anything = phrase_pattern(tuple(p for a in aliases for p in a.phrases))
    lower = F.lower(F.col(text))
    some = texts.filter(lower.rlike(anything))
    hit = F.expr(f"lower(`{text}`) RLIKE pattern AND (excluded = '' OR NOT lower(`{text}`) RLIKE excluded)")
    return some.join(F.broadcast(alias_rules(texts, aliases)), hit).drop("pattern", "excluded")
