"""Decoding of HTML character references as a column expression.

The text is split at each ampersand, so every reference is looked at once and the result of one
decoding is never decoded again.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillsift.functions.arrays import let

# What may follow an ampersand: decimal, hexadecimal or named reference.
_REFERENCE = r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
_REPLACEMENT = "�"


def _names_by_initial() -> str:
    """Names grouped by first letter, as JSON: a lookup scans one letter instead of all names."""
    table: dict[str, dict[str, str]] = {}
    for name, char in html5.items():
        table.setdefault(name[0], {})[name] = char
    return json.dumps(table)


# Names that also count without a semicolon, and then as the start of a longer word; longest first.
_OPEN_NAMES = "^(" + "|".join(sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True)) + ")"

# Code points 128 to 159 stand for the Windows-1252 character where there is one.
_WINDOWS = json.dumps(
    {str(cp): bytes([cp]).decode("cp1252") for cp in range(128, 160) if bytes([cp]).decode("cp1252", "ignore")}
)


def _named(token: Column) -> Column:
    names = F.from_json(F.lit(_names_by_initial()), "map<string,map<string,string>>")

    def char(name: Column) -> Column:
        return F.try_element_at(F.try_element_at(names, F.substring(name, 1, 1)), name)

    opening = F.regexp_extract(token, _OPEN_NAMES, 1)
    rest = F.substr(token, F.char_length(opening) + 1)
    return F.coalesce(
        char(token),
        F.when(opening != "", F.concat(char(opening), rest)),
        F.concat(F.lit("&"), token),
    )


def _numbered(code: Column) -> Column:
    """Character of a code point; null when there are too many digits to be one."""
    low = code.bitwiseAND(F.lit(0xFFFE))
    dropped = (
        code.between(0x1, 0x8)
        | (code == 0xB)
        | code.between(0xE, 0x1F)
        | (code == 0x7F)
        | code.between(0xFDD0, 0xFDEF)
        | (low == 0xFFFE)
    )
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    windows = F.try_element_at(F.from_json(F.lit(_WINDOWS), "map<string,string>"), code.cast("string"))
    return (
        F.when((code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF), _REPLACEMENT)
        .when(code.between(0x80, 0x9F), F.coalesce(windows, char))
        .when(dropped, "")
        .otherwise(char)
    )


def _decoded(token: Column, code: Column) -> Column:
    return (
        F.when(token == "", "&")
        .when(token == "amp;", "&")
        .when(~token.startswith("#"), _named(token))
        .otherwise(F.coalesce(_numbered(code), F.lit(_REPLACEMENT)))
    )


def _code_point(token: Column) -> Column:
    """Number in a numeric reference, or null for a named one or for more digits than a code point has."""
    hexadecimal = F.regexp_extract(token, r"^#[xX]0*([0-9a-fA-F]*);?$", 1)
    decimal = F.regexp_extract(token, r"^#0*([0-9]*);?$", 1)
    return (
        F.when(~token.startswith("#"), F.lit(None).cast("bigint"))
        .when(token.rlike("^#[xX]"), F.when(F.char_length(hexadecimal) <= 6, F.conv(F.concat(F.lit("0"), hexadecimal), 16, 10).cast("bigint")))
        .otherwise(F.when(F.char_length(decimal) <= 7, F.concat(F.lit("0"), decimal).cast("bigint")))
    )


def _unescape(text: Column) -> Column:
    parts = F.split(text, "&", -1)
    decoded = F.transform(
        F.slice(parts, F.lit(2), F.size(parts)),
        lambda part: let(F.regexp_extract(part, _REFERENCE, 1), lambda token: _part(part, token)),
    )
    return F.concat(parts[0], F.array_join(decoded, ""))


def _part(part: Column, token: Column) -> Column:
    """Text after one ampersand, its reference decoded."""
    char = let(_code_point(token), lambda code: _decoded(token, code))
    return F.concat(char, F.substr(part, F.char_length(token) + 1))


def html_unescape(text: Column) -> Column:
    """Decode all HTML 5 character references once."""
    return let(text, lambda t: F.when(t.contains("&"), _unescape(t)).otherwise(t))
