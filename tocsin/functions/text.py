"""Text expressions that must agree with Python's own string rules.

Everything here is a built-in Spark expression, so it runs inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The breaks ``str.splitlines`` knows, and the characters
# ``str.strip`` removes.
LINE_BREAK = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"
RARE_BREAKS = ["\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def sql_text(text: str) -> str:
    """A text as a literal of Spark SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def line_pieces(payload: Column) -> Column:
    """Pieces between line breaks; a trailing break leaves one empty last piece.

    Nearly all dumps use LF alone.  Byte searches tell them apart, and they are
    split at a single character, several times faster than by regex.
    """
    rare = payload.contains(RARE_BREAKS[0])
    for other in RARE_BREAKS[1:]:
        rare = rare | payload.contains(other)
    by_regex = F.split(payload, f"(?![ -~])(?:{LINE_BREAK})", -1)
    return F.when(rare, by_regex).otherwise(F.split(payload, "\n", -1))


def line_total(pieces: Column) -> Column:
    """Lines in the pieces: a final empty piece is not a line."""
    return F.array_size(pieces) - F.when(F.element_at(pieces, -1) == "", 1).otherwise(0)


def split_lines(payload: Column) -> Column:
    """Lines of a dump as an array; the empty dump has none."""
    pieces = line_pieces(payload)
    return F.slice(pieces, F.lit(1), line_total(pieces))


def strip(text: Column) -> Column:
    """Trim Unicode white space (and 0x1C to 0x1F) from both ends."""
    return F.btrim(text, F.lit(SPACES))


def quarter_length(text: Column) -> Column:
    """Token estimate: code points divided by four, rounded down."""
    return F.floor(F.length(text) / 4).cast("int")


def json_quote(text: Column) -> Column:
    """A JSON string literal in plain ASCII, non-ASCII as ``\\uXXXX`` units.

    Text made of printable ASCII without quote or backslash is only wrapped; any
    other text is walked by UTF-16 unit, which gives surrogate pairs for free.
    """
    units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("(....)"), F.lit(1))

    def escape(unit: Column) -> Column:
        named = F.when(unit == "0022", F.lit('\\"')).when(unit == "005C", F.lit("\\\\"))
        for code, short in (("0008", "b"), ("0009", "t"), ("000A", "n"), ("000C", "f"), ("000D", "r")):
            named = named.when(unit == code, F.lit("\\" + short))
        printable = F.char(F.conv(unit, 16, 10).cast("bigint"))
        return named.when(unit.between("0020", "007E"), printable).otherwise(
            F.concat(F.lit("\\u"), F.lower(unit))
        )

    body = F.when(text.rlike(r"\A[ !#-\[\]-~]*\z"), text).otherwise(
        F.array_join(F.transform(units, escape), "")
    )
    return F.concat(F.lit('"'), body, F.lit('"'))
