"""Countries, cities and web hosts in one spelling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..expressions import literal_map
from .names import to_ascii

# Country codes of the filings register that aren't ISO codes. Fixed values.
FILING_CODES = {
    "2M": "DE", "A0": "CA", "C1": "AR", "D0": "BM", "E9": "KY", "F4": "FR", "K3": "GB", "L2": "IL", "N4": "LU", "O5": "MX",
    "P7": "NL", "U3": "ES", "X0": "GB", "X3": "UY",
}
# States, district and territory of the United States. Fixed values.
US_STATES = (
    "AK AL AR AZ CA CO CT DC DE FL GA HI IA ID IL IN KS KY LA MA MD ME MI MN MO MS MT NC ND NE NH NJ NM NV NY OH OK OR PA PR RI "
    "SC SD TN TX UT VA VT WA WI WV WY"
).split()
# Country names and their ISO codes. Fixed values.
COUNTRY_NAMES = {
    "ARGENTINA": "AR", "BRASIL": "BR", "BRAZIL": "BR", "CHILE": "CL", "LUXEMBOURG": "LU", "MEXICO": "MX", "SPAIN": "ES",
    "UNITED STATES": "US", "URUGUAY": "UY", "USA": "US",
}
# Spellings of the city of Buenos Aires. Fixed values.
BUENOS_AIRES = (
    "BS AS", "BUENOS AIRES", "CABA", "CAPITAL FEDERAL", "CITY OF BUENOS AIRES", "CIUDAD AUTONOMA BUENOS AIRES",
    "CIUDAD AUTONOMA DE BS AS", "CIUDAD AUTONOMA DE BUENOS AIRES", "CIUDAD DE BUENOS AIRES",
)


def country_code(value: Column, source: str) -> Column:
    """ISO 3166 code of a raw value, by the habits of its source.

    ``jurisdiction``: the part before a hyphen; ``filing``: a register code, a US state or a name; others: a two-letter code
    or a name. Null if it is none of these.
    """
    v = F.upper(F.trim(value))
    named = F.try_element_at(literal_map(COUNTRY_NAMES), to_ascii(v))
    if source == "jurisdiction":
        out = F.nullif(F.split(v, "-")[0], F.lit(""))
    elif source == "filing":
        out = F.coalesce(F.try_element_at(literal_map(FILING_CODES), v), F.when(v.isin(US_STATES), F.lit("US")), named)
    else:
        out = F.when(v.rlike(r"^\p{L}{2}$"), v).otherwise(named)
    return F.when(F.coalesce(value, F.lit("")) != "", out)


def city_name(value: Column) -> Column:
    """Upper-case letters of a city; postal codes go, and all spellings of Buenos Aires are one. Null if nothing is left or a
    country stands in its place."""
    v = F.trim(F.regexp_replace(F.upper(to_ascii(value)), "[^A-Z]+", " "))
    capital = "|".join(sorted(BUENOS_AIRES, key=len, reverse=True))
    known = v.rlike(f"^(?:{capital})$| (?:{capital})$|^(?:{capital}) ")
    nothing = (v == "") | v.isin("N A", "NA", *COUNTRY_NAMES)
    return F.when(nothing, F.lit(None)).when(known, F.lit("BUENOS AIRES")).otherwise(v)


def url_host(url: Column) -> Column:
    """Lower-case host of a URL without ``www.``; null if it has none or isn't a URL."""
    return F.nullif(F.regexp_replace(F.lower(F.try_parse_url(F.trim(url), F.lit("HOST"))), r"^www\.", ""), F.lit(""))
