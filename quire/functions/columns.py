"""Column expressions for single lines and bodies; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEADING = r"^ {0,3}#{1,6}[ \t]+\S"
GLUED = r"^ {0,3}#{1,6}[^#\s]"
ANY_HEADING = r"^ {0,3}#{1,6}([ \t]+\S|[^#\s])"
MEDIA = r"(?i)^(</?figure[^<>]*>|<img[^<>]*>)$"
ANY_FORMULA = r"\$\$[^$]+\$\$|\$[^$]+\$"
LIST_ITEM = r"^\s*([-*+]|\d{1,9}[.)])[ \t]+\S"
TABLE_ROW = r"^\s*\|.*\|\s*$"
TABLE_RULE = r"^[|:\- \t]*-[|:\- \t]*$"
PAGE_MARK = r"^<!-- source:page (\d+) -->$"
LOST_PAGE = r"^\[page (\d+) not recognized\]$"
IMAGE = r"!\[([^\]\n]*)\]\(([^()\s]*)\)"
NOISE = "[­​-‍﻿]"


def without_noise(line: Column) -> Column:
    """Without invisible characters and white space at the end."""
    return F.regexp_replace(F.regexp_replace(line, NOISE, ""), r"[ \t]+$", "")


def heading_level(line: Column) -> Column:
    return F.when(line.rlike(ANY_HEADING), F.length(F.regexp_extract(line, r"^ {0,3}(#{1,6})", 1)))


def heading_title(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, r"^ {0,3}#{1,6}[ \t]*", ""))


def has_cells(line: Column) -> Column:
    """A bar that no backslash escapes, outside of code."""
    return F.contains(F.regexp_replace(F.regexp_replace(line, "`[^`]*`", ""), r"\\\|", ""), F.lit("|"))


def alnum(text: Column) -> Column:
    """Number of letters and digits."""
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


def is_junk(line: Column, underline: Column) -> Column:
    """Two symbols or more, no letter or digit, and no rule, table rule, formula sign, line break or underline of a heading."""
    core = F.trim(line)
    structural = core.rlike(r"^(- *){3,}$|^(\* *){3,}$|^(_ *){3,}$") | core.rlike(TABLE_RULE) | core.rlike(r"^\$\$$") | core.rlike(r"^(\\\\)+$") | underline
    return (F.length(core) >= 2) & ~core.rlike(r"[\p{L}\p{N}]") & ~structural


def glued_emphasis_off(line: Column) -> Column:
    """**I**nterface reads Interface."""
    return F.regexp_replace(F.regexp_replace(line, r"\*\*(\p{L}+)\*\*(\p{L})", "$1$2"), r"(\p{L})\*\*(\p{L}+)\*\*", "$1$2")


def heading_emphasis_off(line: Column) -> Column:
    return F.regexp_replace(line, r"^( {0,3}#{1,6}[ \t]+)\*\*([^*]+)\*\*[ \t]*$", "$1$2")


def entry_number_joined(line: Column) -> Column:
    """82. 1. at the head of a line reads 82.1."""
    return F.regexp_replace(line, r"^(\d+)\. (\d+)\.(\s)", "$1.$2.$3")


def bullet_promoted(line: Column) -> Column:
    return F.regexp_replace(line, r"^( {0,3})•[ \t]+(\S)", "$1- $2")


def bold_marker_spaced(line: Column) -> Column:
    return F.regexp_replace(line, r"^(\s*[-*+] \*\*\d+[.)]\*\*)(\S)", "$1 $2")


def path_alt_off(line: Column) -> Column:
    """An image text that is a path or a file name goes."""
    return F.regexp_replace(line, r"!\[[^\]\n]*[\w-]\.(png|jpe?g|gif|svg|tiff?|webp|bmp)\]\(", "![](")


def anchors_off(line: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(line, r"<span id=[^<>]*></span>", ""), r"([^!]|^)\[([^\]\n]+)\]\(#[^()\s]*\)", "$1$2")


def oversize_heading_off(line: Column) -> Column:
    return F.when(line.rlike(HEADING) & (F.length(line) > 200), heading_title(line)).otherwise(line)


LINE_FIXES = (without_noise, path_alt_off, glued_emphasis_off, entry_number_joined, anchors_off, heading_emphasis_off, oversize_heading_off, bullet_promoted, bold_marker_spaced)


#: Signs of one character for several letters, and what they stand for (fixed values).
LIGATURES = (("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬅ", "st"), ("ﬆ", "st"))


def plain_characters(text: Column) -> Column:
    """Ligatures as letters, other spaces and tabs as blanks, line ends as one sign, no control characters."""
    for sign, letters in LIGATURES:
        text = F.replace(text, F.lit(sign), F.lit(letters))
    text = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "[\t\u00a0\u2000-\u200a\u202f\u205f\u3000]", " ")
    return F.regexp_replace(text, "[\u0000-\u0008\u000b\u000c\u000e-\u001f\u007f-\u009f]", "")


def hyphens_joined(text: Column) -> Column:
    """Words that a hyphen breaks over a line end are whole; soft hyphens go."""
    return F.regexp_replace(F.regexp_replace(text, r"(\p{L})[-\u00ad\u2010]\n(\p{Ll})", "$1$2"), "\u00ad", "")


def value_form(value: Column) -> Column:
    """Form of a table value: 9 for digits, A for letters."""
    return F.regexp_replace(F.regexp_replace(F.trim(value), r"\p{N}+", "9"), r"\p{L}+", "A")


def url_hash(content: Column) -> Column:
    """SHA-256 as base64 for addresses, without padding."""
    return F.rtrim(F.translate(F.base64(F.unhex(F.sha2(content, 256))), "+/=", "-_ "))


def halved(x: Column, h: float) -> Column:
    """Score of a check: 100, halved with every h of defect."""
    return F.lit(100.0) * F.pow(F.lit(2.0), -x / F.lit(h))
