"""Scalar expressions: recodes, buckets, guarded logs and small formulas."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds and labels of the bucketed census and recidivism columns.
AGE_BUCKETS = [(25, 20), (35, 30), (45, 40), (60, 50), (None, 70)]
HOURS_BUCKETS = [(20, 20), (35, 30), (40, 40), (45, 45), (60, 60), (None, 70)]
PRIORS_BUCKETS = [(0, 0), (3, 1), (None, 2)]
EDUCATION_LOW, EDUCATION_HIGH = 5, 13
AGE_CATEGORIES = {"Less than 25": 0, "25 - 45": 1}
AGE_CATEGORY_OTHER = 2

# Dictionary recodes.
SEX_CODES = {"Male": 1, "Female": 0}
INCOME_CODES = {"<=50K": 0, ">50K": 1, "<=50K.": 0, ">50K.": 1}
DEGREE_CODES = {"bachelor": 1, "master": 0}
OCCUPATION_CLASSES = {
    "NOC-1": ["Exec-managerial", "Prof-specialty"],
    "NOC-2": ["Tech-support", "Sales", "Protective-serv"],
    "NOC-3": ["Craft-repair", "Transport-moving"],
    "NOC-4": ["Adm-clerical", "Machine-op-inspct", "Farming-fishing", "Armed-Forces"],
    "NOC-5": ["Handlers-cleaners", "Other-service"],
    "NOC-6": ["Priv-house-serv"],
    "NOC-7": ["?"],
}
MARITAL_CLASSES = {
    "married": ["Married-civ-spouse", "Married-spouse-absent", "Married-AF-spouse"],
    "single": ["Never-married", "Separated", "Widowed"],
}
MARITAL_OTHER = "divorced"
COUNTRY_TIERS = {
    4: [
        "United-States", "Germany", "Canada", "Japan", "France", "Ireland",
        "England", "Italy", "Taiwan", "Portugal", "Scotland", "Holand-Netherlands",
    ],
    3: [
        "Poland", "China", "Mexico", "Cuba", "Philippines", "India", "Hungary",
        "Iran", "Greece", "Hong", "Jamaica", "Puerto-Rico", "Columbia", "Yugoslavia", "Peru",
    ],
    2: [
        "El-Salvador", "Vietnam", "Nicaragua", "Haiti", "Honduras",
        "Guatemala", "Dominican-Republic", "Thailand", "Ecuador",
    ],
    1: ["Cambodia", "Laos", "Trinadad&Tobago", "?", "South", "Outlying-US(Guam-USVI-etc)"],
}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bucket_case(c: Column | str, buckets: Sequence[tuple]) -> Column:
    """First label whose upper bound is not below the value; a None bound takes the rest."""
    c, out = _col(c), None
    for bound, label in buckets:
        if bound is None:
            return F.lit(label) if out is None else out.otherwise(F.lit(label))
        out = F.when(c <= bound, label) if out is None else out.when(c <= bound, label)
    return out


def clamp(c: Column | str, low, high) -> Column:
    """Values pulled into [low, high]."""
    c = _col(c)
    return F.when(c <= low, low).when(c >= high, high).otherwise(c)


def map_values(c: Column | str, mapping: Mapping, default=None) -> Column:
    """Dictionary recode; values without an entry become ``default`` (NULL if none)."""
    table = F.create_map(*[F.lit(v) for v in chain.from_iterable(mapping.items())])
    found = F.try_element_at(table, _col(c))
    return found if default is None else F.coalesce(found, F.lit(default))


def map_classes(c: Column | str, classes: Mapping, default=None) -> Column:
    """Recode by class lists: {label: [values]}."""
    return map_values(c, {v: k for k, values in classes.items() for v in values}, default)


def flip_binary(c: Column | str) -> Column:
    return F.lit(1) - _col(c)


def sigmoid(c: Column | str) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_col(c)))


def log_floor(c: Column | str) -> Column:
    """log(x + 1e-100), finite at 0."""
    return F.log(_col(c) + F.lit(1e-100))


def arctan_ratio(total: Column | str, n: int) -> Column:
    """atan(total)/atan(n); one half when there is no condition."""
    return F.lit(0.5) if n == 0 else F.atan(_col(total)) / F.atan(F.lit(float(n)))


def parity_sign(c: Column | str) -> Column:
    """-1 for odd, 1 for even."""
    return F.when(F.pmod(_col(c), F.lit(2)) == 1, -1).otherwise(1)


def bits_to_int(*bits: Column | str) -> Column:
    """Integer whose binary digits are the given 0/1 columns, first one highest."""
    text = F.concat_ws("", *[_col(b).cast("int").cast("string") for b in bits])
    return F.conv(text, 2, 10).cast("bigint")


def composite_key(cols: Sequence[str], sep: str = "_") -> Column:
    """Columns joined as text; an empty separator is allowed but can collide."""
    return F.concat_ws(sep, *[F.col(c).cast("string") for c in cols])
