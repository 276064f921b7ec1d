"""Unit conversions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def c_to_f(x: Column) -> Column:
    return x * 9 / 5 + 32


def mm_to_in(x: Column) -> Column:
    return x / F.lit(25.4)


def ms_to_mph(x: Column) -> Column:
    return x * F.lit(2.23694)


def m_to_mi(x: Column) -> Column:
    return x / F.lit(1609.344)
