"""Text expressions: first value, MAC addresses, SSIDs, numbers.

Each function takes SQL text, mostly a column name, and returns SQL text for
`selectExpr` or `expr`. All are built-in functions, so they stay inside whole-stage
code generation; as text a whole projection is one call to the session.
"""

from __future__ import annotations

from airsift import labels as L

# Unicode white space as stripped by the exporters' consumers. Fixed values.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
_WHITESPACE_SQL = "".join(f"\\u{ord(c):04x}" for c in WHITESPACE)

# `\z` is the very end; `$` would also match before a last line break.
MAC_PATTERN = r"^[0-9a-f]{2}(?::[0-9a-f]{2}){5}\z"
# Decimal text of any length; what leaves the range of a DOUBLE is told by the result.
_NUMBER = r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
_BLANK = "[" + "".join(rf"\u{ord(c):04x}" for c in WHITESPACE) + "]*"
NUMBER_PATTERN = rf"^{_NUMBER}\z"
# A number as first value: blanks, number, blanks, then a comma or the end.
FIRST_NUMBER_PATTERN = rf"^{_BLANK}({_NUMBER}){_BLANK}(?:,|\z)"
HEX_PAIRS_PATTERN = r"^(?:[ \t\n\x0b\f\r]*[0-9a-fA-F]{2})+[ \t\n\x0b\f\r]*\z"
LOCAL_OCTET_PATTERN = r"^(?:0[xX])?[0-9a-fA-F]*[2367abefABEF]\z"
# A hexadecimal code of a value that fits 60 bits; a larger one is no code and stays text.
HEX_CODE_PATTERN = r"^0[xX]0*[0-9a-fA-F]{1,15}\z"
# One or more printable characters: no control, format, surrogate, private-use or
# unassigned ones, and no separator other than the plain space.
PRINTABLE_PATTERN = r"^((?:[^\p{C}\p{Z}]| )+)\z"


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def matches(c: str, pattern: str) -> str:
    return f"({c} RLIKE r'{pattern}')"


def strip(c: str) -> str:
    return f"btrim({c}, '{_WHITESPACE_SQL}')"


def first_value(c: str) -> str:
    """Text before the first comma, stripped; '' for null or empty."""
    return strip(f"substring_index(coalesce({c}, ''), ',', 1)")


def normalize_mac(c: str) -> str:
    """First value in lower case."""
    return f"lower({first_value(c)})"


def is_valid_mac(c: str) -> str:
    """Six colon-separated hex pairs; takes text already normalised to lower case."""
    return matches(c, MAC_PATTERN)


def is_ignored_mac(c: str) -> str:
    """Empty, broadcast, and IPv4/IPv6 multicast addresses."""
    tests = [f"{c} = ''", f"{c} = {literal(L.BROADCAST_MAC)}"]
    tests += [f"startswith({c}, {literal(prefix)})" for prefix in L.MULTICAST_PREFIXES]
    return f"({' OR '.join(tests)})"


def parse_double(c: str) -> str:
    """Decimal text to DOUBLE. Null for everything else, `1d`, NaN and infinity included."""
    return _finite(f"try_cast(CASE WHEN {matches(c, NUMBER_PATTERN)} THEN {c} END AS DOUBLE)")


def _finite(number: str) -> str:
    return f"nullif(nullif({number}, DOUBLE('Infinity')), DOUBLE('-Infinity'))"


def parse_signal(c: str) -> str:
    """First value as dBm, an INT truncated toward zero; null if it is no number."""
    number = f"regexp_extract({c}, r'{FIRST_NUMBER_PATTERN}', 1)"
    return f"try_cast(try_cast({number} AS DOUBLE) AS INT)"


def decode_ssid(c: str) -> str:
    """Undo hexadecimal SSIDs, given stripped: an even number of characters made of hex
    pairs that are printable UTF-8 is decoded, all other text stays as it is."""
    is_hex = f"length({c}) % 2 = 0 AND {matches(c, HEX_PAIRS_PATTERN)}"
    packed = rf"regexp_replace(CASE WHEN {is_hex} THEN {c} END, r'[ \t\n\x0b\f\r]', '')"
    decoded = f"try_validate_utf8(CAST(unhex({packed}) AS STRING))"
    printable = f"nullif(regexp_extract({decoded}, r'{PRINTABLE_PATTERN}', 1), '')"
    return f"CASE WHEN {c} = '' THEN {literal(L.HIDDEN_SSID)} ELSE coalesce({printable}, {c}) END"


def normalize_oui(c: str) -> str:
    """First three octets as `XX:XX:XX`; '' if there are fewer than three parts."""
    parts = f"split(translate(upper({strip(c)}), '-', ':'), ':')"
    return f"CASE WHEN size({parts}) >= 3 THEN array_join(slice({parts}, 1, 3), ':') ELSE '' END"


def is_locally_administered(c: str) -> str:
    """Bit 0x02 of the first octet; false if the octet is no hex number."""
    octet = f"substring_index(translate({c}, '-', ':'), ':', 1)"
    # The last digit has the bit, however long the number is.
    return f"coalesce({matches(octet, LOCAL_OCTET_PATTERN)}, false)"


def vendor_label(mac: str, vendor: str) -> str:
    """Vendor text from the looked-up name; the local bit is checked first."""
    unknown = literal(L.VENDOR_UNKNOWN)
    return (
        f"CASE WHEN {mac} = '' THEN {unknown} WHEN {is_locally_administered(mac)} "
        f"THEN {literal(L.VENDOR_RANDOMIZED)} ELSE coalesce({vendor}, {unknown}) END"
    )


def subtype_label(code: str, name: str) -> str:
    return f"coalesce({name}, concat({literal(L.SUBTYPE_PREFIX)}, {code}))"


def decimal_subtype(code: str) -> str:
    """Opt-in: `0x000c` to `12`, so that hexadecimal exports meet the subtype names."""
    is_hex = matches(code, HEX_CODE_PATTERN)
    return f"CASE WHEN {is_hex} THEN conv(substring({code}, 3), 16, 10) ELSE {code} END"
