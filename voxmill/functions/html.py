"""HTML to text as a column expression (TXT1)."""

from __future__ import annotations

import html.entities
import json
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxmill.functions.binding import where_present
from voxmill.functions.whitespace import WHITESPACE

# A Unicode noncharacter: it is not meant for interchanged text, so it can mark cuts.
_CUT = "\ufdd0"

# One pass, first alternative wins, so a comment inside a script or a tag inside a
# comment is swallowed with its surroundings. What is never closed runs to the end;
# an unfinished tag at the very end is text and is put back.
_MARKUP = (
    r"(?is)<(?:!--.*?(?:-->|\z)"
    r"|(script|style|template)\b[^>]*+>.*?(?:</\1\s*+>|\z)"
    r"|[!?][^>]*+>"
    r"""|/?[a-z](?:[^"'>]++|"[^"]*+"|'[^']*+')*+>"""
    r"|/?[a-z][^>]*+>"
    r"|(?<=(<))(/?[a-z!?][^>]*+\z))"
)
_REFERENCE = r"\A(#[xX][0-9a-fA-F]++|#[0-9]++|[a-zA-Z][-.a-zA-Z0-9]*+);?"


def _literal_map(entries: dict[str, str]) -> Column:
    """A constant map; the optimizer folds it into one literal."""
    return F.from_json(F.lit(json.dumps(entries)), "map<string,string>")


def _entity_table() -> Column:
    """Named references by the standard's own list; the everyday ones come first."""
    everyday = ("amp", "lt", "gt", "quot", "nbsp", "copy", "middot")
    listed = (name[:-1] for name in html.entities.html5 if name.endswith(";"))
    names = dict.fromkeys(chain(everyday, listed))
    return _literal_map({name: html.entities.html5[name + ";"] for name in names})


def _windows_1252_table() -> Column:
    """Numbers 128 to 159 are read as Windows-1252, as browsers do."""
    decoded = {n: bytes([n]).decode("cp1252", errors="ignore") for n in range(128, 160)}
    return _literal_map({str(n): c for n, c in decoded.items() if c})


def _code_point(code: Column) -> Column:
    utf32 = F.unhex(F.lpad(F.hex(code), 8, "0"))
    bad = (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
    return F.when(code.isNull() | bad, F.lit("\ufffd")).otherwise(F.decode(utf32, "UTF-32"))


def _decode_piece(piece: Column) -> Column:
    """A piece of text that followed an ampersand, with its reference decoded."""
    name = F.regexp_extract(piece, _REFERENCE, 1)
    rest = F.regexp_replace(piece, _REFERENCE, "")
    digits = F.regexp_extract(name, r"\A#[xX]?0*+([0-9a-fA-F]*+)\z", 1)
    # Nine digits and more are beyond any code point and must not overflow the cast.
    in_range = F.length(digits) < 9
    hexadecimal = F.when(in_range, F.conv(digits, 16, 10).cast("bigint"))
    decimal = F.when(in_range, digits.try_cast("bigint"))
    code = F.when(name.rlike(r"\A#[xX]"), hexadecimal).otherwise(decimal)
    numeric = F.coalesce(F.try_element_at(_windows_1252_table(), code.cast("string")), _code_point(code))
    named = F.coalesce(F.try_element_at(_entity_table(), name), F.concat(F.lit("&"), name))
    return (
        F.when(name == "", F.concat(F.lit("&"), piece))
        .when(name.startswith("#"), F.concat(numeric, rest))
        .otherwise(F.concat(named, rest))
    )


def decode_entities(text: Column) -> Column:
    """Decode character references in one pass, so ``&amp;lt;`` becomes ``&lt;``."""

    def decode(t: Column) -> Column:
        pieces = F.transform(
            F.split(t, "&", -1),
            lambda piece, i: F.when(i == 0, piece).otherwise(_decode_piece(piece)),
        )
        return F.array_join(pieces, "")

    return where_present(text, "&", decode)


def html_to_text(text: Column) -> Column:
    """Text nodes, each stripped, empty ones dropped, joined with one space."""
    cut = where_present(text, "<", lambda t: F.regexp_replace(t, _MARKUP, "$2$3" + _CUT))
    nodes = F.transform(
        F.split(cut, _CUT, -1), lambda node: F.btrim(decode_entities(node), F.lit(WHITESPACE))
    )
    return F.array_join(F.filter(nodes, lambda node: node != ""), " ")
