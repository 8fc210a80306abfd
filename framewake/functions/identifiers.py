"""Text and XML forms of core identifiers, and the check value that guards the text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..session import let

# Fixed values of the standard: what each bit of a digit becomes under the two permutations, and the form of the text
FIRST, SECOND = {8: 9, 4: 8, 2: 4, 1: 2}, {8: 4, 4: 2, 2: 1, 1: 12}
PERIOD = 15
_GROUPS = "[0-9A-Fa-f]{4}(?:-[0-9A-Fa-f]{4}){7}"
TEXT = rf"^([0-9A-Fa-f]{{4}}):({_GROUPS}(?:/{_GROUPS}){{0,2}}):([0-9A-Fa-f]{{2}})$"
NAMESPACE = "http://www.nga.gov/MiisSchema/"


def powers(images: dict[int, int]) -> list[int]:
    """What a digit becomes at each place of a period: the permutation taken once for each place before it, as one row of 16 after another."""
    row, out = list(range(16)), []
    for _ in range(PERIOD):
        out += row
        row = [0 if not v else _image(v, images) for v in row]
    return out


def _image(value: int, images: dict[int, int]) -> int:
    found = 0
    for bit, image in images.items():
        if value & bit:
            found ^= image
    return found


def check_value(text: Column) -> Column:
    """The two check digits of a text's hexadecimal digits, as capitals; null if it has none, or other characters than those and : - /"""
    digits = F.regexp_replace(text, "[:/-]", "")
    tables = [F.array(*map(F.lit, powers(m))) for m in (FIRST, SECOND)]
    number = lambda d, k: F.conv(F.substring(d, k, F.lit(1)), 16, 10).cast("int")

    def folded(d: Column, t: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda a, k: a.bitwiseXOR(F.element_at(t, k % PERIOD * 16 + number(d, k) + 1)))

    good = F.coalesce(digits.rlike("^[0-9A-Fa-f]+$"), F.lit(False))
    return F.when(good, let(digits, lambda d: F.concat(*[F.hex(folded(d, t).cast("long")) for t in tables])))


def core_text(raw: Column) -> Column:
    """A core identifier's octets as text: its header, its components in groups of four digits, and the check value."""
    grouped = lambda h: F.regexp_replace(F.regexp_replace(F.regexp_replace(h, "([0-9A-F]{4})", "$1-"), "((?:[0-9A-F]{4}-){7}[0-9A-F]{4})-", "$1/"), "/$", "")
    body = F.concat(F.substring(F.hex(raw), 1, 4), F.lit(":"), grouped(F.substring(F.hex(raw), 5, 1 << 20)))
    return let(body, lambda b: F.concat(b, F.lit(":"), check_value(b)))


def parse_core_text(text: Column) -> Column:
    """The octets of a core identifier's text (any case), and issue: format, or check, if the check value is another; no octets then."""
    told = F.upper(F.regexp_extract(text, TEXT, 3))
    body = F.regexp_extract(text, "^(.*):[^:]*$", 1)
    issue = F.when(~F.coalesce(text.rlike(TEXT), F.lit(False)), "format").when(told != check_value(body), "check")
    return let(issue, lambda i: F.struct(F.when(i.isNull(), F.unhex(F.regexp_replace(body, "[:/-]", ""))).alias("raw"), i.alias("issue")))


def core_xml(raw: Column) -> Column:
    """The XML document of a core identifier."""
    return F.concat(F.lit(f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<MiisCoreId xmlns="{NAMESPACE}">'), core_text(raw), F.lit("</MiisCoreId>"))


def parse_core_xml(document: Column) -> Column:
    """The octets of an XML document's core identifier, and issue: xml, if the document is no such element, or those of ``parse_core_text``."""
    form = rf"^\s*(?:<\?xml[^>]*\?>)?\s*<MiisCoreId\s+xmlns=[\"']{NAMESPACE}[\"']\s*>\s*([^<\s]*)\s*</MiisCoreId>\s*$"
    inner = parse_core_text(F.regexp_extract(document, form, 1))
    return F.when(F.coalesce(document.rlike(form), F.lit(False)), inner).otherwise(F.struct(F.lit(None).cast("binary").alias("raw"), F.lit("xml").alias("issue")))
