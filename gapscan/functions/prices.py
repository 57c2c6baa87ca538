"""SQL of price measures: typical price, VWAP, distances, gap direction."""

from __future__ import annotations

# Prices enter sums as whole millionths (a rule: what lies beyond six decimals does not
# count). Money is summed as whole DECIMALs, so sums do not depend on the order in which tasks
# add, however large the volumes are, and a difference of two running sums is as exact as a
# direct sum. Plain sums of closes stay DOUBLEs, which hold whole numbers up to 2^53 exactly: a
# symbol has one close per calendar day, so that is a century of closes up to 240,000.
PRICE_UNITS = 1_000_000


def price_units(price: str) -> str:
    return f"rint(({price}) * {PRICE_UNITS}D)"


# Three times the typical price (high + low + close), in price units. Doubles become decimals by way of their text, which costs more than all that
# is done with the sums; whole numbers that doubles hold exactly go by way of BIGINT and give the same decimals.
_UNITS = price_units("high + low + close")
_TYPICAL = f"if(abs({_UNITS}) < 9e15D, cast(try_cast({_UNITS} as bigint) as decimal(18,0)), try_cast({_UNITS} as decimal(18,0)))"
_VOLUME = "cast(coalesce(volume, 0) as decimal(19,0))"

#: By its public name, for tables that carry it instead of prices.
TYPICAL = _TYPICAL


def vwap_sums(typical: str = TYPICAL) -> dict[str, str]:
    """The four aggregates a VWAP needs, from bars or from what is their TYPICAL and volume."""
    return {
        "tpv": f"sum({typical} * {_VOLUME})",
        "vol": f"sum({_VOLUME})",
        "tp": f"sum({typical})",
        "n": f"count({typical})",
    }


VWAP_SUMS = vwap_sums()


def vwap(tpv: str, vol: str, tp: str, n: str) -> str:
    """Sum(tp * volume) / sum(volume); the plain mean of tp when no volume traded."""
    unit = f"{3 * PRICE_UNITS}D"
    return (
        f"case when {vol} > 0 then coalesce(cast({tpv} as double), 0D) / (cast({vol} as double) * {unit})"
        f" when {n} > 0 then cast({tp} as double) / ({n} * {unit}) end"
    )


def percent_from(base: str, close: str = "close") -> str:
    """Distance of close from base in percent; null unless base is positive."""
    return f"case when {base} > 0 then ({close} - {base}) / {base} * 100D end"


def by_mode(mode: str, up: str, down: str) -> str:
    """SQL for up gaps, down gaps, or whichever a row is."""
    if mode == "both":
        return f"if(open >= prev_close, {up}, {down})"
    if mode not in ("up", "down"):
        raise ValueError(f"gap mode must be up, down or both, not {mode!r}")
    return up if mode == "up" else down


def gap_percent(mode: str) -> str:
    """Opening gap as a fraction of the previous close, positive in the gap's direction."""
    move = by_mode(mode, "open - prev_close", "prev_close - open")
    return f"({move}) / nullif(prev_close, 0D)"
