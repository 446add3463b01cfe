"""Element attributes as a small dimension and as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Atomic numbers of the known symbols.
CODES = {
    "H": 1, "HE": 2, "LI": 3, "BE": 4, "B": 5, "C": 6, "N": 7, "O": 8, "F": 9, "NE": 10, "NA": 11, "MG": 12, "AL": 13, "SI": 14, "P": 15, "S": 16,
    "CL": 17, "AR": 18, "K": 19, "CA": 20, "FE": 26, "CU": 29, "ZN": 30, "SE": 34, "BR": 35, "I": 53,
}
# Van der Waals radius, covalent radius (both in angstrom) and colour of the tabulated elements.
ATTRIBUTES = {
    "H": (1.2, 0.31, (255, 255, 255)), "C": (1.7, 0.76, (144, 144, 144)), "N": (1.55, 0.71, (48, 80, 248)), "O": (1.52, 0.66, (255, 13, 13)),
    "F": (1.47, 0.57, (144, 224, 80)), "NA": (2.27, 1.66, (171, 92, 242)), "MG": (1.73, 1.30, (138, 255, 0)), "P": (1.8, 1.07, (255, 128, 0)),
    "S": (1.8, 1.05, (255, 255, 48)), "CL": (1.75, 1.02, (31, 240, 31)), "K": (2.75, 2.03, (143, 64, 212)), "CA": (2.31, 1.74, (61, 255, 0)),
    "FE": (1.8, 1.24, (224, 102, 51)), "ZN": (1.39, 1.22, (125, 128, 176)), "SE": (1.9, 1.20, (255, 161, 0)), "BR": (1.85, 1.20, (166, 41, 41)),
    "I": (1.98, 1.39, (148, 0, 148)),
}
DEFAULT_VDW, DEFAULT_COVALENT, DEFAULT_RGB = 1.7, 0.76, (200, 200, 200)
# Chain colours.
PALETTE = (
    "69d2e7 a7dbd8 e0e4cc f38630 fa6900 e94e77 d68189 c6a49a c6e5d9 f4ead5 ecd078 d95b43 c02942 542437 53777a 556270 4ecdc4 c7f464 ff6b6b c44d58"
).split()


def _lookup(key: Column, values: dict, default) -> Column:
    table = F.create_map(*chain.from_iterable((F.lit(k), v if isinstance(v, Column) else F.lit(v)) for k, v in values.items()))
    return F.coalesce(F.try_element_at(table, key), default if isinstance(default, Column) else F.lit(default))


def element_code(symbol: Column) -> Column:
    """Atomic number, 0 for unknown symbols."""
    return _lookup(F.upper(symbol), CODES, 0)


def element_symbol(code: Column) -> Column:
    """Symbol of an atomic number, null for 0 and unknown ones."""
    table = F.create_map(*chain.from_iterable((F.lit(n), F.lit(s)) for s, n in CODES.items()))
    return F.try_element_at(table, code)


def vdw_radius(symbol: Column) -> Column:
    return _lookup(F.upper(symbol), {k: v[0] for k, v in ATTRIBUTES.items()}, DEFAULT_VDW)


def covalent_radius(symbol: Column) -> Column:
    return _lookup(F.upper(symbol), {k: v[1] for k, v in ATTRIBUTES.items()}, DEFAULT_COVALENT)


def element_rgb(symbol: Column) -> Column:
    colour = lambda c: F.array(*[F.lit(x).cast("short") for x in c])
    return _lookup(F.upper(symbol), {k: colour(v[2]) for k, v in ATTRIBUTES.items()}, colour(DEFAULT_RGB))


def infer_symbol(element_field: Column, atom_name: Column) -> Column:
    """The element field if it has one or two characters, else from the atom name: two letters if they are a known
    symbol, else the first letter; null if the name has no letter."""
    field = F.upper(F.trim(element_field))
    letters = F.regexp_replace(F.upper(F.trim(atom_name)), "[^A-Z]", "")
    two, one = F.substring(letters, 1, 2), F.substring(letters, 1, 1)
    return F.when(F.length(field).between(1, 2), field).when((F.length(two) == 2) & two.isin(list(CODES)), two).when(one != "", one)


def chain_colour(chain_idx: Column) -> Column:
    """Palette colour of a chain index; negative and null ones take the first."""
    at = F.when(F.coalesce(chain_idx, F.lit(-1)) < 0, 0).otherwise(F.pmod(chain_idx, F.lit(len(PALETTE))))
    return F.element_at(F.array(*[F.lit(c) for c in PALETTE]), (at + 1).cast("int"))


def elements(spark: SparkSession) -> DataFrame:
    """symbol, code, vdw, covalent, rgb of all known symbols: a fixed table of a few rows, safe to broadcast."""
    rows = [(s, n, *ATTRIBUTES.get(s, (DEFAULT_VDW, DEFAULT_COVALENT, DEFAULT_RGB))) for s, n in CODES.items()]
    return spark.createDataFrame([(a, b, c, d, list(e)) for a, b, c, d, e in rows], "symbol string, code int, vdw double, covalent double, rgb array<smallint>")
