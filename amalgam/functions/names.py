"""Company names in a form that can be compared, as Spark expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..expressions import let

# Legal forms at the end of a normalised name, and the short form of each. Fixed values.
LEGAL_FORMS = {
    "SOCIEDAD ANONIMA": "SA", "SA": "SA", "SOCIEDAD ANONIMA UNIPERSONAL": "SAU", "SAU": "SAU",
    "SOCIEDAD DE RESPONSABILIDAD LIMITADA": "SRL", "SRL": "SRL", "SOCIEDAD LIMITADA": "SL", "SL": "SL", "SLU": "SL",
    "SOCIEDAD POR ACCIONES SIMPLIFICADA": "SAS", "SAS": "SAS", "SOCIEDAD EN COMANDITA POR ACCIONES": "SCA", "SCA": "SCA",
    "SAB DE CV": "SAB DE CV", "SA DE CV": "SA DE CV", "DE CV": "SA DE CV",
    "SAIC": "SA", "SACI": "SA", "SAICF": "SA", "SACIF": "SA", "SAICYF": "SA", "SACIFIA": "SA", "SAICA": "SA", "CIASA": "SA",
    "IC YF": "SA", "ICYF": "SA", "IC Y F": "SA", "CIYF": "SA", "AIC": "SA", "CI": "SA",
    "COOP LTDA": "COOP", "COOPERATIVA LIMITADA": "COOP", "LIMITADA": "LTDA", "LTDA": "LTDA",
    "Y CIA": "CIA", "Y COMPANIA": "CIA", "CIA": "CIA",
    "INCORPORATED": "INC", "INC": "INC", "CORPORATION": "CORP", "CORP": "CORP", "COMPANY": "CO", "CO": "CO",
    "LIMITED": "LTD", "LTD": "LTD", "LLC": "LLC", "LP": "LP", "PLC": "PLC",
    "AKTIENGESELLSCHAFT": "AG", "AG": "AG", "GMBH": "GMBH", "SE": "SE", "NV": "NV", "BV": "BV", "SPA": "SPA", "AB": "AB",
}
# Words that say nothing about which company it is. Fixed values.
STOP_WORDS = ("A", "AND", "DE", "DEL", "E", "EL", "LA", "LAS", "LOS", "OF", "THE", "TO", "Y")
# English words and the Spanish ones they are compared as. Fixed values.
TRANSLATIONS = {
    "ARGENTINE": "ARGENTINA", "ARGENTINIAN": "ARGENTINA", "BANK": "BANCO", "CEMENT": "CEMENTO", "ENERGY": "ENERGIA",
    "FINANCIAL": "FINANCIERO", "FRENCH": "FRANCES", "FUND": "FONDO", "GROUP": "GRUPO", "HOLDINGS": "HOLDING",
    "INDUSTRIES": "INDUSTRIAS", "INSURANCE": "SEGUROS", "INVESTMENT": "INVERSION", "INVESTMENTS": "INVERSIONES",
    "INVESTORS": "INVERSORES", "NORTH": "NORTE", "OIL": "PETROLEO", "PETROLEUM": "PETROLEO", "PORT": "PUERTO",
    "REPRESENTATIONS": "REPRESENTACIONES", "SECURITIES": "VALORES", "SERVICES": "SERVICIOS", "SOUTH": "SUR",
    "TRANSPORTER": "TRANSPORTADORA",
}


@lru_cache(1)
def _ascii_tables() -> tuple[str, str, dict[str, str]]:
    """Characters with one ASCII character as their compatibility decomposition, those characters, and a map of the
    characters that decompose into several."""
    one, to, many = [], [], {}
    for i in range(0x80, 0x10000):
        if 0xD800 <= i < 0xE000:
            continue
        plain = unicodedata.normalize("NFKD", chr(i)).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            one.append(chr(i))
            to.append(plain)
        elif plain:
            many[chr(i)] = plain
    return "".join(one), "".join(to), many


def _ranges(chars) -> str:
    """The characters as a regular expression's ranges: a class of single ones would be tried one by one."""
    codes = sorted(map(ord, chars))
    starts = [c for c, before in zip(codes, [-2, *codes]) if c != before + 1]
    ends = [c for c, after in zip(codes, [*codes[1:], -2]) if after != c + 1]
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(starts, ends))


def to_ascii(text: Column) -> Column:
    """Compatibility decomposition without what isn't ASCII: accents go, letters that don't decompose go too."""
    one, to, many = _ascii_tables()
    spelled = F.create_map(*(F.lit(x) for kv in many.items() for x in kv))
    rare = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(spelled, c), c)), "")
    whole = F.when(text.rlike(f"[{_ranges(many)}]"), rare).otherwise(text)
    plain = F.regexp_replace(F.translate(whole, one, to), r"[^\x00-\x7F]+", "")
    return F.when(text.rlike(r"[^\x00-\x7F]"), plain).otherwise(text)  # most names are ASCII already


def normalize_name(name: Column) -> Column:
    """Upper-case ASCII words; single letters in a row joined (S. A. becomes SA); & becomes Y; null becomes empty."""
    upper = F.upper(to_ascii(F.coalesce(name, F.lit(""))))
    words = F.trim(F.regexp_replace(F.regexp_replace(upper, "&", " & "), "[^A-Z0-9&]+", " "))
    joined = F.regexp_replace(words, "(?<=(?:^| )[A-Z]) (?=[A-Z](?: |$))", "")
    return F.regexp_replace(joined, "&", "Y")


def _form_pattern() -> str:
    forms = "|".join(sorted(LEGAL_FORMS, key=lambda f: (-f.count(" "), f)))
    return f"^(.+?) ({forms})(?: (?:{forms}))*$"


def _may_end_in_form(normalized: Column) -> Column:
    """Whether the last word is that of a legal form: most names without one are spared the long pattern."""
    return F.substring_index(normalized, " ", -1).isin(*sorted({f.split()[-1] for f in LEGAL_FORMS}))


def without_form(normalized: Column) -> Column:
    """The name without the legal forms at its end; its first word always stays."""
    bare = F.when(_may_end_in_form(normalized), F.regexp_extract(normalized, _form_pattern(), 1))
    return F.coalesce(F.nullif(bare, F.lit("")), normalized)


def legal_form(normalized: Column) -> Column:
    """The short form of the innermost legal form, or empty."""
    forms = F.create_map(*(F.lit(x) for kv in LEGAL_FORMS.items() for x in kv))
    found = F.when(_may_end_in_form(normalized), F.try_element_at(forms, F.regexp_extract(normalized, _form_pattern(), 2)))
    return F.coalesce(found, F.lit(""))


def name_tokens(bare: Column) -> Column:
    """The words without stop words, in one language."""
    same = F.create_map(*(F.lit(x) for kv in TRANSLATIONS.items() for x in kv))
    kept = F.filter(F.split(bare, " "), lambda t: (t != "") & ~t.isin(*STOP_WORDS))
    return F.transform(kept, lambda t: F.coalesce(F.try_element_at(same, t), t))


def name_parts(name: Column) -> Column:
    """struct(norm, bare, form, tokens) of a raw name."""
    return let(normalize_name(name), lambda n: let(without_form(n), lambda b: F.struct(n.alias("norm"), b.alias("bare"), legal_form(n).alias("form"), name_tokens(b).alias("tokens"))))
