"""Text forms that must equal a compact ASCII JSON encoder byte for byte.

The functions take and return SQL expression text, because one long parsed expression builds much
faster than the same tree made of single column calls.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tracemill.schemas import FEATURE_VERSION

PLAIN = r"^[ !#-\[\]-~]*\z"
PLAIN_UNICODE = r"^[^\x00-\x1F\x22\x5C]*\z"


def _unit(value: str) -> str:
    return f"concat(char(92), 'u', lower(lpad(hex({value}), 4, '0')))"


def _escaped_character(character: str) -> str:
    point = f"ascii({character})"
    named = {8: "b", 9: "t", 10: "n", 12: "f", 13: "r"}
    return (
        f"CASE WHEN {point} = 34 THEN concat(char(92), char(34))"
        f" WHEN {point} = 92 THEN concat(char(92), char(92))"
        + "".join(f" WHEN {point} = {code} THEN concat(char(92), '{letter}')" for code, letter in named.items())
        + f" WHEN {point} BETWEEN 32 AND 126 THEN {character}"
        f" WHEN {point} < 65536 THEN {_unit(point)}"
        f" ELSE concat({_unit(f'55296 + shiftright({point} - 65536, 10)')},"
        f" {_unit(f'56320 + (({point} - 65536) & 1023)')}) END"
    )


def json_string(value: str, ascii_only: bool = True) -> str:
    """A quoted JSON string, in ASCII by default. Plain text takes no per-character work."""
    plain = PLAIN if ascii_only else PLAIN_UNICODE
    letter = f"substring({value}, i, 1)"
    escaped = _escaped_character(letter)
    if not ascii_only:
        escaped = f"IF(ascii({letter}) > 126, {letter}, {escaped})"
    letters = f"transform(sequence(1, char_length({value})), i -> {escaped})"
    return (
        f"concat(char(34), CASE WHEN {value} RLIKE r'{plain}' THEN {value} "
        f"ELSE array_join({letters}, '') END, char(34))"
    )


def json_double(value: str) -> str:
    """The shortest decimal form with the exponent rules of a JSON float.

    Positional between 1e-4 and 1e16, scientific with an exponent of two or more digits outside.
    """
    size = f"abs({value})"
    text = f"CAST({size} AS STRING)"
    digits = f"replace(regexp_replace(split_part({text}, 'E', 1), r'\\.0$', ''), '.', '')"
    power = f"TRY_CAST(split_part({text}, 'E', 2) AS INT)"
    mantissa = (
        f"CASE WHEN length({digits}) > 1 THEN concat(substring({digits}, 1, 1), '.', substring({digits}, 2, 20)) "
        f"ELSE {digits} END"
    )
    return (
        f"concat(CASE WHEN CAST({value} AS STRING) LIKE '-%' THEN '-' ELSE '' END, CASE"
        f" WHEN {size} < 1e16 AND {size} = floor({size}) THEN concat(TRY_CAST({size} AS BIGINT), '.0')"
        f" WHEN {size} >= 1e-3 AND {size} < 1e7 THEN {text}"
        f" WHEN {size} >= 1e-4 AND {size} < 1e-3 THEN concat('0.', repeat('0', -{power} - 1), {digits})"
        f" WHEN {size} >= 1e7 AND {size} < 1e16 THEN"
        f" concat(substring({digits}, 1, {power} + 1), '.', substring({digits}, {power} + 2, 20))"
        f" ELSE concat({mantissa}, CASE WHEN {power} < 0 THEN 'e-' ELSE 'e+' END,"
        f" CASE WHEN abs({power}) < 10 THEN '0' ELSE '' END, abs({power})) END)"
    )


def json_array(value: str, element) -> str:
    return f"concat('[', array_join(transform({value}, x -> {element('x')}), ','), ']')"


def json_boolean(value: str) -> str:
    return f"CASE WHEN {value} THEN 'true' ELSE 'false' END"


def window_id(version: int = FEATURE_VERSION) -> Column:
    """Stable identity of a window: its values are left out, so replacements keep the id."""
    numbers = "".join(f", ',', {name}" for name in ("tgid", "start_time_ns", "start_ns", "end_ns"))
    return F.expr(
        f"sha2(concat('[', {json_string('run_id')}, ',', {json_string('boot_id')}{numbers}, ',{version}]'), 256)"
    )


def is_digest(column: Column) -> Column:
    return F.coalesce(column.rlike(r"^[0-9a-f]{64}\z"), F.lit(False))
