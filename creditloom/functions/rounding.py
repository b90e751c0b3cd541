"""Rounding of published numbers, as SQL text that two engines read alike."""

from __future__ import annotations

#: Significant digits to which numbers with a fraction are rounded.
DIGITS = 9
#: From where the digit after them counts up.  Halves go up, also if the order of
#: addition leaves them a hair below: means of cents often end in a 5.
HALF = "0.5001e0"
#: Numbers below it are differences of equal sums and count as zero.
NOISE = "1e-9"


def grid(x: str) -> str:
    """``x`` to ``DIGITS`` significant digits; whole numbers stay as they are."""
    unit = f"pow(10e0, {DIGITS - 1} - floor(log10(abs({x}))))"
    return (
        f"CASE WHEN {x} = floor({x}) THEN {x} WHEN abs({x}) < {NOISE} THEN 0e0"
        f" ELSE floor({x} * {unit} + {HALF}) / {unit} END"
    )
