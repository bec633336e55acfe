"""String column functions, all JVM-side built-ins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin-1 letters folded to ASCII the way ASCII//TRANSLIT does
# for single letters (source letters, then their ASCII replacements).
ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöøùúûüýÿ"
UNACCENTED = "AAAAAACEEEEIIIINOOOOOOUUUUYaaaaaaceeeeiiiinoooooouuuuyy"
# Letters that transliterate to two ASCII letters.
LIGATURES = {"Æ": "AE", "æ": "ae", "ß": "ss", "Œ": "OE", "œ": "oe"}

# Whitespace as R's str_trim sees it (ASCII controls plus Unicode separators);
# written so Java regex and RE2 (the DuckDB oracle) read it the same way.
WS = r"[\t\n\x{0B}\f\r\p{Z}]"
# The same set as code points (tab, LF, VT, FF, CR, then the
# Unicode space/line/paragraph separators), for character-set trimming.
WS_CODEPOINTS = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0xA0, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004,
                 0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
WS_CHARS = "".join(chr(c) for c in WS_CODEPOINTS)


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def upper(c) -> Column:  # C1
    return F.upper(col_(c))


def trim_ws(c) -> Column:  # C2: both sides, all Unicode whitespace (character-set trim, no regex)
    c = col_(c)
    ws = [F.lit(ch) for ch in WS_CHARS]
    edge = F.substring(c, 1, 1).isin(*ws) | F.substring(c, -1, 1).isin(*ws)  # cheap test first
    return F.when(edge, F.btrim(c, F.lit(WS_CHARS))).otherwise(c)


def squish(c) -> Column:  # C3: trim, then inner runs of whitespace -> one blank
    return F.regexp_replace(trim_ws(c), f"{WS}+", " ")


def ascii_fold(c) -> Column:  # C4: literal replacements + one character map
    c = col_(c)
    out = c
    for src, dst in LIGATURES.items():
        out = F.replace(out, F.lit(src), F.lit(dst))
    # pure-ASCII strings (characters == bytes) need no work
    return F.when(F.length(c) == F.octet_length(c), c).otherwise(F.translate(out, ACCENTED, UNACCENTED))


def strip_prefix(c, pattern: str) -> Column:  # C5: e.g. "^HFC@"
    lit = pattern[1:] if pattern.startswith("^") else None
    if lit and not any(ch in lit for ch in ".^$*+?()[]{}|\\"):
        # anchored literal prefix: no regex needed
        c = col_(c)
        return F.when(c.startswith(lit), F.substring(c, len(lit) + 1, 2 ** 31 - 1)).otherwise(c)
    return F.regexp_replace(col_(c), pattern, "")


def remove_punct(c) -> Column:  # C6: Unicode class P only; symbols ($ + ^ |) stay
    return F.regexp_replace(col_(c), r"\p{P}", "")


def snake_words(c) -> Column:  # C7: squish, then whitespace -> "_"
    return F.regexp_replace(squish(c), f"{WS}+", "_")


def left(c, n: int) -> Column:  # C8
    return F.substring(col_(c), 1, n)


def extract_first(c, pattern: str) -> Column:  # C9: no match -> NULL
    return F.nullif(F.regexp_extract(col_(c), pattern, 0), F.lit(""))


def count_with_pct(n, pct) -> Column:  # C11: "n (pct)"
    return F.concat(col_(n).cast("string"), F.lit(" ("), col_(pct), F.lit(")"))


def title_case(c) -> Column:  # C12
    return F.initcap(F.lower(col_(c)))


def percent(c, digits: int = 2) -> Column:  # C13: 0.1234 -> "12.34%"
    return F.format_string(f"%.{digits}f%%", F.round(col_(c) * 100, digits))


def upper_keep_sharp_s(c) -> Column:
    """``toupper`` as R does it: ß has no one-letter capital and stays ß
    (Java would turn it into "SS")."""
    guarded = F.replace(col_(c), F.lit("ß"), F.lit("\uE000"))
    return F.replace(F.upper(guarded), F.lit("\uE000"), F.lit("ß"))


def clean_text(c) -> Column:
    """Q1 cleaning of one string column: upper, trim, ASCII."""
    return ascii_fold(trim_ws(upper_keep_sharp_s(c)))
