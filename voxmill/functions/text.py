"""The cleaning steps as column expressions.

Every step is one built-in expression and needs no Python worker, so the chain runs
inside the scan's stage and can also be used inside ``transform`` on a nested array. A
step looks for its opening characters first and runs its regex only on texts that hold
them.

The patterns give the results of the plain patterns quoted beside them under the rules
of Python's ``re`` (``(?d)``: only a newline ends a line; explicit white-space class).
They are also written so that a hostile text costs linear time: where a plain pattern
would restart at every opener and scan to the end each time, an extra alternative takes
the hopeless rest in one go and puts it back through its capture groups. One bad
document must not hold up a whole stage.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxmill import vocab
from voxmill.functions.binding import where_present
from voxmill.functions.html import html_to_text
from voxmill.functions.whitespace import ANY, WHITESPACE, WITHIN_LINE


def strip(text: Column) -> Column:
    """Remove white space at both ends (TXT16, TXT19). Not a regex: linear and cheap."""
    return F.btrim(text, F.lit(WHITESPACE))


def or_empty(text: Column) -> Column:
    """Missing text is the empty text (TXT0)."""
    return F.coalesce(text, F.lit(""))


def _drop_lines(text: Column, start: str) -> Column:
    """Drop whole lines whose first visible characters match ``start``.

    With a newline put in front, every line starts with one, so a line goes together
    with the newline before it and what is left is joined as it should be.
    """
    pattern = f"\\n[{WITHIN_LINE}]*+(?iu:{start})[^\\n]*+"
    return F.substr(F.regexp_replace(F.concat(F.lit("\n"), text), pattern, ""), F.lit(2))


def _quote_literal(text: str) -> str:
    return "".join(c if c.isalnum() or c in " _" else "\\" + c for c in text)


def boilerplate_prefixes(
    product: str | None = None, prefixes: Iterable[str] = vocab.BOILERPLATE_PREFIXES
) -> list[str]:
    """The prefixes with the product's name filled in; without a name those are left out."""
    return [p.replace("{product}", product or "") for p in prefixes if product or "{product}" not in p]


def drop_boilerplate(
    text: Column,
    product: str | None = None,
    prefixes: Iterable[str] = vocab.BOILERPLATE_PREFIXES,
) -> Column:
    """Drop template lines (TXT2): a case-blind prefix test on the stripped line."""
    wanted = boilerplate_prefixes(product, prefixes)
    return _drop_lines(text, "|".join(map(_quote_literal, wanted))) if wanted else text


def drop_images(text: Column) -> Column:
    r"""TXT3, ``!\[.*?\]\(.*?\)``."""
    pattern = r"(?d)!\[(?:(?>.*?\]\()[^)\n]*+\)|(?<=(!\[))(.*+))"
    return where_present(text, "![", lambda t: F.regexp_replace(t, pattern, "$1$2"))


def drop_code_fences(text: Column) -> Column:
    r"""TXT4, three backticks, anything, three backticks."""
    return where_present(text, "```", lambda t: F.regexp_replace(t, r"```[\s\S]*?```", ""))


def drop_inline_code(text: Column) -> Column:
    r"""TXT5, ```[^`\n]*```."""
    return where_present(text, "`", lambda t: F.regexp_replace(t, r"`[^`\n]*+`", ""))


def unwrap_links(text: Column) -> Column:
    r"""TXT6, ``\[([^\]]+)\]\([^)]+\)`` to its first group."""
    pattern = r"\[(?:([^\]]++)\]\([^)]++\)|(?<=(\[))([^\]]++\]\([^)]++\z|[^\]]*+\]?))"
    return where_present(text, "](", lambda t: F.regexp_replace(t, pattern, "$1$2$3"))


def unwrap_bold(text: Column) -> Column:
    r"""TXT7, ``\*\*(.*?)\*\*`` to its group."""
    return where_present(text, "**", lambda t: F.regexp_replace(t, r"(?d)\*\*(.*?)\*\*", "$1"))


def unwrap_italic(text: Column) -> Column:
    r"""TXT8, ``\*(.*?)\*`` to its group."""
    return where_present(text, "*", lambda t: F.regexp_replace(t, r"(?d)\*(.*?)\*", "$1"))


def unwrap_underline(text: Column) -> Column:
    r"""TXT9, ``__(.*?)__`` to its group."""
    return where_present(text, "__", lambda t: F.regexp_replace(t, r"(?d)__(.*?)__", "$1"))


def unwrap_underscore(text: Column) -> Column:
    r"""TXT10, ``_(.*?)_`` to its group."""
    return where_present(text, "_", lambda t: F.regexp_replace(t, r"(?d)_(.*?)_", "$1"))


def drop_quotes(text: Column) -> Column:
    """Drop quoted lines (TXT11): the stripped line starts with ``>``."""
    return where_present(text, ">", lambda t: _drop_lines(t, ">"))


def drop_mail_footers(text: Column) -> Column:
    r"""TXT12, ``^On .+, .+ wrote:.*$`` on each line."""
    pattern = r"(?md)^On .(?>.*?, ).(?>.*? wrote:).*$"
    return where_present(text, " wrote:", lambda t: F.regexp_replace(t, pattern, ""))


def drop_signatures(text: Column) -> Column:
    r"""TXT13, ``--+\s*$`` on each line, with the white space behind it."""
    pattern = f"(?md)-(?<!--)-++[{ANY}]*$"
    return where_present(text, "--", lambda t: F.regexp_replace(t, pattern, ""))


def squeeze_newlines(text: Column) -> Column:
    r"""TXT14, ``\n{3,}`` to two."""
    return where_present(text, "\n\n\n", lambda t: F.regexp_replace(t, r"\n{3,}+", "\n\n"))


def squeeze_spaces(text: Column) -> Column:
    r"""TXT15, `` {2,}`` to one."""
    return where_present(text, "  ", lambda t: F.regexp_replace(t, r" {2,}+", " "))


def clean_markup(
    text: Column,
    product: str | None = None,
    prefixes: Iterable[str] = vocab.BOILERPLATE_PREFIXES,
) -> Column:
    """TXT2 to TXT16 in their fixed order."""
    text = drop_boilerplate(text, product, prefixes)
    for step in (
        drop_images,
        drop_code_fences,
        drop_inline_code,
        unwrap_links,
        unwrap_bold,
        unwrap_italic,
        unwrap_underline,
        unwrap_underscore,
        drop_quotes,
        drop_mail_footers,
        drop_signatures,
        squeeze_newlines,
        squeeze_spaces,
        strip,
    ):
        text = step(text)
    return text


def clean_text(
    body: Column,
    source: Column | None = None,
    product: str | None = None,
    prefixes: Iterable[str] = vocab.BOILERPLATE_PREFIXES,
) -> Column:
    """The whole cleaning of one body. HTML is only taken apart for forum posts."""
    text = or_empty(body)
    if source is not None:
        text = F.when(source == vocab.DISCOURSE, html_to_text(text)).otherwise(text)
    return clean_markup(text, product, prefixes)


def strip_json_fence(reply: Column) -> Column:
    r"""TXT17: ``^```json\s*`` and ``\s*```$`` on each line, then the ends."""
    opener = f"(?md)^```json[{ANY}]*+"
    closer = f"(?md)(?<![{ANY}])[{ANY}]*+```$"
    return strip(
        where_present(
            reply, "```", lambda t: F.regexp_replace(F.regexp_replace(t, opener, ""), closer, "")
        )
    )
