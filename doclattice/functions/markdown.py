"""Text and Markdown scalar functions as Column expressions: no Python runs in any of them.

Null in, null out. Regular expressions use ``(?md)`` so that only LF ends a line.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_S = F.lit


def line_style(c: Column) -> Column:
    """CRLF, CR or LF: what ends the lines of a text."""
    return F.when(c.contains("\r\n"), "CRLF").when(c.contains("\r"), "CR").when(c.isNotNull(), "LF")


def to_lf(c: Column) -> Column:
    return F.replace(F.replace(c, _S("\r\n"), _S("\n")), _S("\r"), _S("\n"))


def esc_inline(c: Column) -> Column:
    """Backslashes doubled, then a backslash before every bar."""
    return F.replace(F.replace(c, _S("\\"), _S("\\\\")), _S("|"), _S("\\|"))


def esc_block(c: Column) -> Column:
    """A backslash before what would start a Markdown block; leading blanks stay."""
    return F.regexp_replace(c, r"(?md)^([^\S\n]*)([#>\-+*=]|\d+[.)]|\|)", r"$1\\$2")


def cell_inline(c: Column) -> Column:
    """Line breaks of already escaped text for a table cell."""
    return F.replace(c, _S("\n"), _S("<br>"))


def esc_cell(c: Column) -> Column:
    return cell_inline(esc_inline(c))


def cell_block(c: Column) -> Column:
    """Text below a coordinate: broken lines, or an indented block where a line is a table row or quotation."""
    lines = F.split(c, "\n")
    block = F.exists(lines, lambda x: F.ltrim(x).startswith("|") | F.ltrim(x).startswith(">"))
    return F.when(block, F.replace(c, _S("\n"), _S("\n    "))).otherwise(cell_inline(c))


def normalize_md(c: Column) -> Column:
    """Markdown without its marks: span tags, breaks, strike-out, bold, back-ticks, then escapes."""
    c = F.regexp_replace(c, r"</?span[^>]*>", "")
    c = F.regexp_replace(c, r"<br\s*/?>", "\n")
    for mark in ("~~", "**", "`"):
        c = F.replace(c, _S(mark), _S(""))
    return F.regexp_replace(c, r"\\(.)", "$1")


def fence_for(c: Column) -> Column:
    """A back-tick fence longer than any run in the text, three at least."""
    runs = F.transform(F.regexp_extract_all(c, _S("`+"), _S(0)), F.length)
    return F.repeat(_S("`"), F.greatest(_S(3), F.coalesce(F.array_max(runs), _S(0)) + 1))


def esc_tsv(c: Column) -> Column:
    for a, b in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        c = F.replace(c, _S(a), _S(b))
    return c


def xml_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, _S(a), _S(b))
    return c


def xml_unescape(c: Column) -> Column:
    """Predefined and numeric entities of XML decoded once; carriage returns become line feeds."""
    ref = r"&#([0-9]{1,7}|x[0-9a-fA-F]{1,6});"

    def put(text: Column, found: Column) -> Column:
        number = F.regexp_extract(found, r"&#x?([0-9a-fA-F]+);", 1)
        code = F.when(found.contains("x"), F.conv(number, 16, 10)).otherwise(number).cast("int")
        high = F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32")
        return F.replace(text, found, F.when(code == 38, F.lit("&amp;")).otherwise(high))

    c = F.aggregate(F.array_distinct(F.regexp_extract_all(c, _S(ref), _S(0))), c, put)
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        c = F.replace(c, _S(a), _S(b))
    return to_lf(c)


def number_text(c: Column) -> Column:
    """A number as a spreadsheet shows it: whole numbers under 1e15 without a fraction."""
    whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
    return F.when(whole, c.cast("decimal(20,0)").cast("string")).otherwise(c.cast("string"))


def boolean_text(c: Column) -> Column:
    return F.when(c, "TRUE").when(~c, "FALSE")


def value_text(kind: Column, text: Column, number: Column, flag: Column) -> Column:
    """Display text of a cell: null, stored empty text, 0 and FALSE stay apart."""
    return (
        F.when(kind == "b", boolean_text(flag))
        .when(kind == "n", number_text(number))
        .when((kind == "s") & (text == ""), "[빈 문자열]")
        .when(kind.isin("s", "e", "d"), text)
        .otherwise("")
    )


def serial_date(ts: Column) -> Column:
    """Days since 1899-12-30, as spreadsheets count them from March 1900."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(86_400e6) + F.lit(25_569)


def formula_shape(c: Column) -> Column:
    """A formula without its equals sign, blanks and cell names: what filled-down copies share."""
    return F.replace(F.regexp_replace(F.upper(F.regexp_replace(c, "^=+", "")), r"\$?[A-Z]{1,3}\$?[0-9]+", "@"), _S(" "), _S(""))


def column_letters(n: Column) -> Column:
    """Letters of a column number from 1 to 18,278."""
    one = lambda k: F.chr(F.lit(65) + k)
    a, b, c = n - 1, F.floor((n - 27) / 26), F.floor((n - 703) / 676)
    return F.concat(
        F.when(n > 702, one(c % 26)).otherwise(""),
        F.when(n > 26, one(b % 26)).otherwise(""),
        one(a % 26),
    )


def column_number(letters: Column) -> Column:
    each = F.transform(F.filter(F.split(F.upper(letters), ""), lambda x: x != ""), lambda x: F.ascii(x) - 64)
    return F.aggregate(each, F.lit(0), lambda s, x: s * 26 + x)


def occurrences(text: Column, part: Column) -> Column:
    """How often a part stands in a text without overlap; an empty part never."""
    n = F.length(part)
    return F.when(n > 0, ((F.length(text) - F.length(F.replace(text, part, _S("")))) / n).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def present(part: Column, md: Column, norm: Column) -> Column:
    """Whether a text stands in the Markdown, as it is or without marks on either side."""
    return F.when(md.contains(part), True).when(norm.contains(part), True).otherwise(norm.contains(normalize_md(part)))


def strip(c: Column) -> Column:
    """Without blanks of any script at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def heading_level(style_name: Column) -> Column:
    """Level 1 to 6 of an outline or title style; 0 for others."""
    n = F.regexp_extract(style_name, r"(?i)(?:개요|제목|outline|heading|title)\s*([0-9]+)", 1)
    return F.least(F.coalesce(F.try_to_number(F.when(n != "", n), F.lit("999")).cast("int"), F.lit(0)), F.lit(6))


def header_block(name: Column, fmt: Column, converter: str, *extra: Column) -> Column:
    return F.concat_ws("\n", F.concat(_S("# "), name), _S(""), F.concat(_S("- 원본 형식: `"), fmt, _S("`")), F.concat(_S("- 변환기: `"), _S(converter), _S("`")), *extra)
