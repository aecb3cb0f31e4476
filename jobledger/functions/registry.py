"""The identities of a work-in-progress schedule, once, as data that compiles to Catalyst expressions."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobledger.functions.scalars import ratio

#: What the variables are called in reports.
NAMES = {
    "V": "Contract Value", "C": "Estimated Total Cost", "G": "Estimated Gross Profit", "M": "Estimated Gross Margin %", "D": "Cost to Date", "Q": "Cost to Complete", "P": "Percent Complete",
    "E": "Earned Revenue", "B": "Billings to Date", "H": "Earned Gross Profit to Date", "N": "Net Billing Position", "U": "Underbillings", "O": "Overbillings",
    "R": "Remaining Revenue (Backlog)", "RB": "Remaining Billings", "PB": "Percent Billed",
}
#: Half a unit of a value printed in whole dollars, with a hair for rounding.
CELL = 0.51


@dataclass(frozen=True)
class Rule:
    output: str
    inputs: tuple[str, ...]
    formula: Callable[..., Column]
    text: str
    family: str
    kind: str = "money"
    clipped: bool = False

    @property
    def name(self) -> str:
        return f"{self.output}={self.text}"

    @property
    def business(self) -> str:
        """The identity with the variables' names."""
        spaced = self.name.replace("=", " = ").replace("-", " - ").replace("*", " * ").replace("/", " / ")
        return "".join(NAMES.get(part, part) for part in re.split(r"([A-Z]+)", spaced))

    def value(self, of: Callable[[str], Column] = F.col) -> Column:
        return self.formula(*[of(i) for i in self.inputs])

    def tolerance(self, of: Callable[[str], Column] = F.col) -> Column:
        """What rounding of the printed inputs can do to the output: one-sided differences, added up."""
        exact, total = self.value(of), F.lit(CELL if self.kind == "money" else 0.0005)
        for moved in self.inputs:
            total = total + F.abs(self.formula(*[of(i) + F.lit(CELL) if i == moved else of(i) for i in self.inputs]) - exact)
        return total


def _d(x: Column) -> Column:
    return x.cast("double")


RULES = (
    Rule("G", ("V", "C"), lambda v, c: _d(v) - _d(c), "V-C", "est_comp"),
    Rule("C", ("V", "G"), lambda v, g: _d(v) - _d(g), "V-G", "est_comp"),
    Rule("E", ("V", "D", "C"), lambda v, d, c: F.when(c != 0, _d(v) * _d(d) / _d(c)), "V*D/C", "earned"),
    Rule("Q", ("C", "D"), lambda c, d: _d(c) - _d(d), "C-D", "cost_complete"),
    Rule("H", ("E", "D"), lambda e, d: _d(e) - _d(d), "E-D", "earned_profit"),
    Rule("H", ("G", "D", "C"), lambda g, d, c: F.when(c != 0, _d(g) * _d(d) / _d(c)), "G*D/C", "earned_profit"),
    Rule("N", ("E", "B"), lambda e, b: _d(e) - _d(b), "E-B", "billing_pos"),
    Rule("U", ("E", "B"), lambda e, b: F.greatest(_d(e) - _d(b), F.lit(0.0)), "max(E-B,0)", "billing_pos", clipped=True),
    Rule("O", ("E", "B"), lambda e, b: F.greatest(_d(b) - _d(e), F.lit(0.0)), "max(B-E,0)", "billing_pos", clipped=True),
    Rule("R", ("V", "E"), lambda v, e: _d(v) - _d(e), "V-E", "backlog"),
    Rule("RB", ("V", "B"), lambda v, b: _d(v) - _d(b), "V-B", "rem_billing"),
    Rule("M", ("G", "V"), ratio, "G/V", "margin", "pct"),
    Rule("P", ("D", "C"), ratio, "D/C", "pct_complete", "pct"),
    Rule("P", ("E", "V"), ratio, "E/V", "pct_complete", "pct"),
    Rule("PB", ("B", "V"), ratio, "B/V", "pct_billed", "pct"),
)

#: Sums of a completed-contracts schedule: (addend, addend, sum).
CC_SUMS = (("KT", "GT", "RT"), ("KP", "GP", "RP"), ("KC", "GC", "RC"), ("RP", "RC", "RT"), ("KP", "KC", "KT"), ("GP", "GC", "GT"))

VARIABLES = ("V", "C", "G", "M", "D", "Q", "P", "E", "B", "H", "N", "U", "O", "R", "RB", "PB")


def usable(columns: list[str]) -> list[Rule]:
    return [r for r in RULES if r.output in columns and set(r.inputs) <= set(columns)]


#: Steps of the canonical derivation, in order: what is missing, from what, how.  No printed percentage gives dollars.
STEPS: tuple[tuple[str, tuple[str, ...], Callable[..., Column]], ...] = (
    ("V", ("C", "G"), lambda c, g: c + g),
    ("C", ("V", "G"), lambda v, g: v - g),
    ("G", ("V", "C"), lambda v, c: v - c),
    ("C", ("D", "Q"), lambda d, q: d + q),
    ("D", ("C", "Q"), lambda c, q: c - q),
    ("D", ("E", "H"), lambda e, h: e - h),
    ("E", ("D", "H"), lambda d, h: d + h),
    ("D", ("E", "C", "V"), lambda e, c, v: F.when(v != 0, e * c / v)),
    ("P", ("D", "C"), ratio),
    ("Q", ("C", "D"), lambda c, d: c - d),
    ("E", ("D", "C", "V"), lambda d, c, v: F.when((v != 0) & (c != 0), d / c * v)),
    ("N", ("U", "O"), lambda u, o: F.abs(o) - F.abs(u)),
    ("B", ("E", "N"), lambda e, n: e + n),
    ("B", ("V", "RB"), lambda v, rb: v - rb),
    ("V", ("E", "R"), lambda e, r: e + r),
    ("E", ("V", "R"), lambda v, r: v - r),
    ("V", ("B", "RB"), lambda b, rb: b + rb),
    ("R", ("V", "E"), lambda v, e: v - e),
    ("RB", ("V", "B"), lambda v, b: v - b),
    ("M", ("G", "V"), ratio),
    ("PB", ("B", "V"), ratio),
    ("H", ("E", "D"), lambda e, d: e - d),
    ("U", ("E", "B"), lambda e, b: F.greatest(e - b, F.lit(0.0))),
    ("O", ("E", "B"), lambda e, b: F.greatest(b - e, F.lit(0.0))),
    ("N", ("E", "B"), lambda e, b: b - e),
)


def derive(df):
    """df with all sixteen variables as doubles; given values stay, missing ones are derived where they can be, else null."""
    df = df.withColumns({v: F.col(v).cast("double") if v in df.columns else F.lit(None).cast("double") for v in VARIABLES})
    for target, inputs, formula in STEPS:
        df = df.withColumn(target, F.coalesce(F.col(target), formula(*[F.col(i) for i in inputs])))
    return df
