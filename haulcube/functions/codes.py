"""Code tables and the area-code normaliser.

All of it is Column expressions: the normaliser is a nested CASE that stays
inside whole-stage codegen, the lookups are literal maps (fixed, tiny).
"""
from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the original pipeline's for identical results.
# ---------------------------------------------------------------------------
PRIMARY_STREAMS = {1: "Refuse", 31: "Paper", 33: "MGP"}
STREAM_COLUMNS = {1: "tons_refuse", 31: "tons_paper", 33: "tons_mgp"}
BOROUGH_PREFIXES = {
    "BK": "Brooklyn",
    "QE": "Queens",
    "QW": "Queens",
    "QN": "Queens",
    "QS": "Queens",
    "MN": "Manhattan",
    "BX": "Bronx",
    "SI": "Staten Island",
}
DROP_SECTIONS = [
    "AFFB02", "AFFBK", "AFFBX", "AFFM03", "AFFM10", "AFFMN", "AFFQN",
    "AFFS02", "AFFSI", "BKLC1", "BKLC2", "BKLC3", "BKLC4", "BXLC1",
    "FKA1", "MN012", "MN102", "MNLC1", "MNLC2", "OTHCLN", "OTHSCH",
    "QEB1", "QELC1", "QELC2", "SILC1", "SILC2",
]
NORTH_BROOKLYN_SUFFIXES = ["091", "092", "093", "161", "162",
                           "171", "172", "173", "174", "175"]
PLACEHOLDER_TRUCK = "9999999"
# Material code dictionary used for labels (J6); unknown codes -> 'Unknown'.
MATERIAL_NAMES = {
    0: "Unspecified",
    1: "H/H Collection (Curbside)",
    2: "Bulk (Residential)",
    3: "Self-help Bulk",
    4: "Leaves (Not Recycling)",
    5: "Trees (Not Recycling)",
    6: "Street Dirt (MLP/MBD/WEP)",
    7: "Self Help (Community Cleanup)",
    8: "Fly Ash",
    9: "Residue",
    10: "Lot Cleaning",
    11: "Pest Control",
    12: "Lot Cleaning - Federal",
    14: "EZ Pack Collection",
    15: "HFC Collection",
    21: "Abandoned Cars / Junk",
    22: "Miscellaneous Recycling",
    24: "RO/RO (AFF) Collection",
    25: "RO/RO (AFF) Bulk",
    26: "RO/RO (AFF) Miscellaneous",
    27: "RO/RO (AFF) News/Mags/Corrug",
    28: "RO/RO (AFF) Metal Bulk",
    29: "RO/RO (AFF) Metal/Glass/Plastic",
    31: "Newspaper / Magazines / Corrugated",
    32: "News / Mags / Corrug (Intensive)",
    33: "Metal / Glass / Plastic",
    34: "Metal / Glass / Plastic (Intensive)",
    35: "Comingled Recyclables",
    36: "Mixed Waste",
    37: "Metal Bulk",
    38: "News / Mags / Corrug (EZ Pack)",
    39: "Metal / Glass / Plastic (EZ Pack)",
    40: "Pratt Paper",
    41: "Pratt Paper (EZ Pack)",
    45: "Residential Food Waste",
    46: "School Food Waste",
    47: "Residential Mixed Metals",
    48: "School Truck Paper",
    49: "School Truck Metal",
    50: "Brush (Compost)",
    51: "Green Market Food Waste (Recycling)",
    52: "Leaves (Recycling)",
    53: "Yard Waste (Recycling)",
    54: "Christmas Trees (Recycling)",
    55: "Wood Chips (Recycling)",
    56: "Tires (Recycling)",
    57: "Dirt",
    58: "Construction Debris",
    59: "Grass (Compost)",
    60: "ER Cleaning",
    61: "ERD Collection",
    62: "ER Hauling",
    63: "Emergency Collection Service",
    64: "ERD Paper",
    65: "ERD M/G/P",
    66: "Storm Debris",
    67: "ERD Down Trees",
    77: "Metal / Plastic",
    78: "School Truck Metal / Glass / Plastic",
    79: "School Truck Metal & Plastic",
    80: "Housing Authority Trucks",
    81: "School Trucks",
    82: "Goodwill Industries",
    83: "Public Buildings",
    84: "Special Coll (CRS/RI/GWI/PB/CC)",
    85: "Catholic Charities",
    86: "District Shop Load",
    87: "Baskets",
    88: "Tires (Non-Recycling)",
    90: "Millings",
    96: "Passover Refuse",
    97: "Passover Paper",
    98: "Passover Metal/Glass/Plastic",
}
# ---------------------------------------------------------------------------

STREAM_ORDER = ["tons_refuse", "tons_paper", "tons_mgp"]
MEASURES = STREAM_ORDER + ["tons_total"]


def literal_map(d: dict) -> Column:
    """A literal MAP column built from a small fixed dict."""
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(d.items())])


def normalise_code(c: Column) -> Column:
    """trimmed area code mapped to the polygon layer's naming.

    The rule chain refers to its input ~20 times; binding the input once as a
    lambda variable keeps Catalyst from substituting the (possibly long)
    upstream expression into every reference (and into pushed-down filters).
    """
    return F.transform(F.array(F.btrim(c)), normalise_trimmed)[0]


def normalise_trimmed(c: Column) -> Column:
    """F1 rules on an already trimmed code; pass a plain column for the codegen path."""
    p2, p3, r3 = F.substring(c, 1, 2), F.substring(c, 1, 3), F.right(c, F.lit(3))
    rest = F.substr(c, F.lit(3))
    return (
        F.when(c == "", c)
        .when(p2.isin("QS", "QN"), F.concat(F.lit("QE"), rest))
        .when((F.substring(c, 1, 1) == "M") & (p2 != "MN"), F.concat(F.lit("MN"), rest))
        .when(p2 == "BX", F.concat(F.lit("BX"), r3))
        .when(p3 == "BKW", F.concat(F.lit("BKS"), r3))
        .when((p3 == "BKE") & r3.isin(*NORTH_BROOKLYN_SUFFIXES), F.concat(F.lit("BKN"), r3))
        .when(p3 == "BKE", F.concat(F.lit("BKS"), r3))
        .otherwise(c)
    )


def borough_of(c: Column, default: str = "Unknown") -> Column:
    """borough from the two-letter prefix (prefixes are disjoint)."""
    return F.coalesce(literal_map(BOROUGH_PREFIXES)[F.substring(F.btrim(c), 1, 2)],
                      F.lit(default))


def stream_name(code: Column) -> Column:
    """Material code -> stream name, null when not a primary stream."""
    return literal_map(PRIMARY_STREAMS)[code]


def material_label(code: Column) -> Column:
    """J6: 'code - name' with 'Unknown' for codes outside the dictionary."""
    name = F.coalesce(literal_map(MATERIAL_NAMES)[code], F.lit("Unknown"))
    return F.concat_ws(" - ", code.cast("string"), name)


# SQL twins used by the DuckDB oracles -------------------------------------
def normalise_sql(c: str) -> str:
    sfx = ", ".join(f"'{s}'" for s in NORTH_BROOKLYN_SUFFIXES)
    return (f"(CASE WHEN trim({c}) = '' THEN trim({c}) "
            f"WHEN left(trim({c}),2) IN ('QS','QN') THEN 'QE' || substr(trim({c}),3) "
            f"WHEN left(trim({c}),1) = 'M' AND left(trim({c}),2) <> 'MN' THEN 'MN' || substr(trim({c}),3) "
            f"WHEN left(trim({c}),2) = 'BX' THEN 'BX' || right(trim({c}),3) "
            f"WHEN left(trim({c}),3) = 'BKW' THEN 'BKS' || right(trim({c}),3) "
            f"WHEN left(trim({c}),3) = 'BKE' AND right(trim({c}),3) IN ({sfx}) THEN 'BKN' || right(trim({c}),3) "
            f"WHEN left(trim({c}),3) = 'BKE' THEN 'BKS' || right(trim({c}),3) "
            f"ELSE trim({c}) END)")


def borough_sql(c: str, default: str = "Unknown") -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in BOROUGH_PREFIXES.items())
    return f"(CASE left(trim({c}),2) {whens} ELSE '{default}' END)"


def drop_sections_sql() -> str:
    return ", ".join(f"'{s}'" for s in DROP_SECTIONS)
