"""Sensor harmonisation, quality masks and spectral indices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BANDS = ["b1", "b2", "b3", "b4", "b5", "b7"]

# Published reduced-major-axis coefficients (Roy et al. 2016, table 2).
OLI_SLOPE = [0.9785, 0.9542, 0.9825, 1.0073, 1.0171, 0.9949]
OLI_INTERCEPT = [-0.0095, -0.0016, -0.0022, -0.0021, -0.0030, 0.0029]

# Tasseled-cap coefficients for bands 1, 2, 3, 4, 5 and 7.
TASSELED_CAP = {
    "tcb": [0.2043, 0.4158, 0.5524, 0.5741, 0.3124, 0.2303],
    "tcg": [-0.1603, -0.2819, -0.4934, 0.7940, -0.0002, -0.1446],
    "tcw": [0.0315, 0.2021, 0.3102, 0.1594, -0.6806, -0.6109],
}

# Sign that makes disturbance positive, per index.
INDEX_FLIP = {"NBR": -1, "B5": 1, "NDVI": -1, "TCB": 1, "NDSI": -1, "TCG": -1, "B3": 1}


def harmonize_oli(df: DataFrame) -> DataFrame:
    """Bring LC08 bands onto the older sensors' scale; other sensors pass through. Bands hold reflectance times 10,000."""
    fixed = {
        b: F.when(F.col("sensor") == "LC08", ((F.col(b) - round(10_000 * i, 6)) / F.lit(s)).cast("short")).otherwise(F.col(b).cast("short"))
        for b, s, i in zip(BANDS, OLI_SLOPE, OLI_INTERCEPT)
    }
    return df.withColumns(fixed)


def qa_clear(qa: Column, strict: bool = False) -> Column:
    """At most two quality bits set; ``strict`` tests the shadow, snow and cloud bits instead."""
    return (qa.bitwiseAND(56) == 0) if strict else (F.bit_count(qa) <= 2)


def tasseled_cap(name: str) -> Column:
    total = F.lit(0.0)
    for band, k in zip(BANDS, TASSELED_CAP[name]):
        total = total + F.col(band) * F.lit(k)
    return total


def normalized_difference(a: str, b: str) -> Column:
    """(a - b) / (a + b) * 1000, NULL where the sum is zero."""
    x, y = F.col(a), F.col(b)
    return F.try_divide(x - y, x + y) * F.lit(1000)


def spectral_index(name: str) -> Column:
    builders = {
        "NBR": lambda: normalized_difference("b4", "b7"),
        "NDVI": lambda: normalized_difference("b4", "b3"),
        "NDSI": lambda: normalized_difference("b2", "b5"),
        "TCB": lambda: tasseled_cap("tcb"),
        "TCG": lambda: tasseled_cap("tcg"),
        "B5": lambda: F.col("b5").cast("double"),
        "B3": lambda: F.col("b3").cast("double"),
    }
    if name not in builders:
        raise ValueError(f"index {name!r} is not supported; use one of {sorted(builders)}")
    return builders[name]()


def index_stack(df: DataFrame, index: str, keep: list[str]) -> DataFrame:
    """The flipped segmentation index plus the unflipped layers to be fitted along with it."""
    flip = INDEX_FLIP[index] if index in INDEX_FLIP else 1
    chosen = spectral_index(index)
    return df.select(
        *keep,
        (chosen * flip).alias("idx"),
        chosen.alias("ftv_idx"),
        tasseled_cap("tcb").alias("ftv_tcb"),
        tasseled_cap("tcg").alias("ftv_tcg"),
        tasseled_cap("tcw").alias("ftv_tcw"),
        normalized_difference("b4", "b3").alias("ftv_ndvi"),
        normalized_difference("b2", "b5").alias("ftv_ndsi"),
    )
