"""Column expressions for positions, quantities, versions and ages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetlens.fixed import LEGACY_SEGMENT, MEMORY_UNITS, SEGMENT, TIME_UNITS


def whole_div(a: Column, b: Column | int) -> Column:
    """Integer division, truncating towards zero."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970; monotone because the session runs in UTC."""
    return F.unix_micros(ts.cast("timestamp"))


def age_seconds(ts: Column, as_of: Column) -> Column:
    """Whole seconds from ``ts`` to ``as_of``, truncated."""
    return whole_div(epoch_micros(as_of) - epoch_micros(ts), 1_000_000)


def nice_age(seconds: Column) -> Column:
    """``D days, H hours, M minutes and S seconds``."""
    s = seconds.cast("bigint")
    return F.concat(
        whole_div(s, 86400).cast("string"),
        F.lit(" days, "),
        whole_div(s % 86400, 3600).cast("string"),
        F.lit(" hours, "),
        whole_div(s % 3600, 60).cast("string"),
        F.lit(" minutes and "),
        (s % 60).cast("string"),
        F.lit(" seconds"),
    )


def is_position(text: Column) -> Column:
    """Two hexadecimal numbers of up to sixteen digits with a slash between them, and nothing else."""
    return text.rlike("^[0-9A-Fa-f]{1,16}/[0-9A-Fa-f]{1,16}$") & ~F.endswith(text, F.lit("\n"))


def lsn_bytes(position: Column, legacy: bool = True) -> Column:
    """``hi/lo`` (hex) as one ordered number, ``decimal(38,0)``; null for any other text.

    The high half alone can exceed a bigint once scaled, so the arithmetic stays
    decimal throughout.
    """

    def half(i: int) -> Column:
        return F.conv(F.split_part(position, F.lit("/"), F.lit(i)), 16, 10).cast("decimal(20,0)")

    scale = F.lit(LEGACY_SEGMENT if legacy else SEGMENT).cast("decimal(12,0)")
    return F.when(is_position(position), (half(1) * scale + half(2)).cast("decimal(38,0)"))


def version_parts(version: Column) -> Column:
    """Numeric parts of a version, comparable element by element."""
    return F.transform(
        F.regexp_extract_all(version, F.lit(r"(\d+)"), 1), lambda part: part.try_cast("int")
    )


def at_least(version: Column, required: str) -> Column:
    """True when ``version`` is the required one or newer."""
    wanted = F.array(*[F.lit(int(p)) for p in required.split(".")])
    return version_parts(version) >= wanted


def _amount(text: Column) -> tuple[Column, Column, Column]:
    """Digits at the start with their sign, the word after them, and whether that is all."""
    digits = F.regexp_extract(text, r"^-?[0-9]+", 0)
    word = F.btrim(F.substring(text, F.length(digits) + 1, F.length(text)), F.lit(" \t\r\n\x0b\x0c"))
    return digits, word, (digits != "") & ~word.rlike(r"\W")


def _unit_map(values: dict[str, int] | dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


_FACTORS = {**MEMORY_UNITS, **TIME_UNITS}
_FAMILY = {**{u: "memory" for u in MEMORY_UNITS}, **{u: "time" for u in TIME_UNITS}}


def quantity_error(text: Column, unit: Column) -> Column:
    """Why ``text`` cannot be expressed in ``unit``; null when it can."""
    _, own, well = _amount(text)
    family = _unit_map(_FAMILY)
    return (
        F.when(~well, F.lit("Invalid number or unit"))
        .when(own == "", F.lit(None).cast("string"))
        .when(
            F.try_element_at(family, own).isNull(),
            F.concat(
                F.lit("Unknown conversion unit '"), own, F.lit("'. Units are case sensitive.")
            ),
        )
        .when(
            ~F.try_element_at(family, own).eqNullSafe(F.try_element_at(family, unit)),
            F.concat(F.lit("Cannot convert "), own, F.lit(" to "), unit),
        )
    )


def convert_unit(text: Column, unit: Column) -> Column:
    """``'16MB'`` expressed in ``unit`` as a double; null when it cannot be.

    A number without a unit is taken to be in ``unit`` already. Numbers of any size are
    converted, beyond 2**53 to the nearest double.
    """
    digits, own, _ = _amount(text)
    number = digits.try_cast("double")
    factors = _unit_map(_FACTORS)
    scaled = (
        number
        * F.try_element_at(factors, own).cast("double")
        / F.try_element_at(factors, unit).cast("double")
    )
    return F.when(
        quantity_error(text, unit).isNull(),
        F.when(own == "", number).otherwise(scaled),
    )
