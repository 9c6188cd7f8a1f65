"""String similarities and the composite score of a pair."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from recordloom.functions.blocks import ratios


def levenshtein_ratio(a: Column, b: Column, least: float = 0.5) -> Column:
    """1 - distance / longer length; 0 below least or if a side is empty, 1 if equal."""
    longest = F.greatest(F.length(a), F.length(b))
    ratio = (longest - F.levenshtein(a, b)) / longest
    return F.when(a == b, 1.0).when((F.length(a) == 0) | (F.length(b) == 0), 0.0).when(ratio >= least, ratio).otherwise(0.0)


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching blocks over both lengths (query first: the measure isn't symmetric); 0 if a side is empty or lengths differ by over 65 %."""
    a, b = a.fillna(""), b.fillna("")
    n, m = a.str.len(), b.str.len()
    out = np.where((a == b).to_numpy(), 1.0, 0.0)
    open_ = ((a != b) & (n > 0) & (m > 0) & ((n - m).abs() <= 0.65 * np.maximum(n, m))).to_numpy()
    out[open_] = ratios(a[open_].tolist(), b[open_].tolist())
    return pd.Series(out)


@F.pandas_udf(DoubleType())
def sequence_ratio_lite(a: pd.Series, b: pd.Series) -> pd.Series:
    """The plain ratio, with popular characters of long texts left out."""
    return pd.Series(ratios(a.fillna("").tolist(), b.fillna("").tolist(), popular=True))


def lengths_within(n: Column, band: float) -> Column:
    """The lengths that differ from n by at most the band, as a share of the longer: a key to join by instead of comparing all pairs."""
    lengths = F.sequence(F.floor(n * (1 - band)).cast("int"), F.ceil(n / (1 - band)).cast("int"))
    return F.filter(lengths, lambda m: F.abs(m - n) / F.greatest(m, n) <= band)


def length_gate(a: Column, b: Column, threshold: float) -> Column:
    """Whether the lengths are close enough for the pair to reach the threshold."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.abs(F.length(a) - F.length(b)) / longest <= gate_band(threshold)


def gate_band(threshold: float) -> float:
    return 1 - max(0.4, threshold - 0.2)


def composite(status: Column, factor: Column, modality: Column, full: Column, tech: Column, core: Column) -> Column:
    """Full, technique and core similarity weighed by the anatomy's and the modality's agreement."""
    exact = full * 0.35 + tech * 0.25 + core * 0.25 + 0.15
    system = full * 0.40 + tech * 0.25 + core * 0.25 + 0.10
    other = (full * 0.50 + tech * 0.25 + core * 0.25) * factor
    score = F.when(status == "EXACT_MATCH", exact).when(status == "SAME_ORGAN_SYSTEM", system).otherwise(other)
    score = score * F.when(modality == "COMPATIBLE", 0.85).otherwise(1.0) + F.when(modality == "MATCH", 0.08).otherwise(0.0)
    return F.least(score, F.lit(1.0))


def composite_lite(status: Column, factor: Column, full: Column, tech: Column) -> Column:
    exact, system = full * 0.50 + tech * 0.35 + 0.15, full * 0.55 + tech * 0.35 + 0.05
    return F.least(F.when(status == "EXACT_MATCH", exact).when(status == "SAME_ORGAN_SYSTEM", system).otherwise(full * factor), F.lit(1.0))
