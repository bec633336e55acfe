"""SQL text fragments shared by the DuckDB oracles (mirror the column functions)."""

from ..functions.text import ACCENTED, UNACCENTED, WS_CODEPOINTS

WS = r"[\t\n\x{0B}\f\r\p{Z}]"


WS_CHARS_SQL = " || ".join(f"chr({c})" for c in WS_CODEPOINTS)


def trim_ws(x: str) -> str:
    return f"trim({x}, {WS_CHARS_SQL})"


def squish(x: str) -> str:
    return f"regexp_replace({trim_ws(x)}, '{WS}+', ' ', 'g')"


def ascii_fold(x: str) -> str:
    inner = x
    for src, dst in (("Æ", "AE"), ("æ", "ae"), ("ß", "ss"), ("Œ", "OE"), ("œ", "oe")):
        inner = f"replace({inner}, '{src}', '{dst}')"
    return f"translate({inner}, '{ACCENTED}', '{UNACCENTED}')"


def upper_keep_sharp_s(x: str) -> str:
    return f"replace(upper(replace({x}, 'ß', chr(57344))), chr(57344), 'ß')"


def clean_text(x: str) -> str:
    return ascii_fold(trim_ws(upper_keep_sharp_s(x)))


def rnd(expr: str, digits: int = 6) -> str:
    scale = float(10 ** digits)
    return f"CAST(floor(({expr}) * {scale} + 0.5) / {scale} AS DOUBLE)"
