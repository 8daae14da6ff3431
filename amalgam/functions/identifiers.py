"""Legal-entity identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: States in which an identifier was withdrawn. Fixed values.
WITHDRAWN = ("ANNULLED", "DUPLICATE")


def lei_is_valid(lei: Column) -> Column:
    """Form of an ISO 17442 identifier and its check digits: the number spelled in base 36 leaves 1 modulo 97."""
    place = lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
    rest = F.aggregate(F.split(lei, ""), F.lit(0), lambda r, c: (r * F.when(place(c) > 9, 100).otherwise(10) + place(c)) % 97)
    return F.coalesce(F.when(lei.rlike("^[0-9A-Z]{18}[0-9]{2}$"), rest == 1), F.lit(False))


def lei_is_firm(lei: Column, state: Column) -> Column:
    """A valid identifier that its register hasn't withdrawn."""
    return lei_is_valid(lei) & ~F.coalesce(state.isin(*WITHDRAWN), F.lit(False))


def entity_label_id(label: Column) -> Column:
    """The entity id at the end of a label such as ``Name · E0123456789AB-2``; null without one."""
    return F.nullif(F.regexp_extract(label, r"(E[0-9A-F]{12}(?:-[0-9]+)?)$", 1), F.lit(""))
