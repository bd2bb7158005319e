"""Band arithmetic on pixel columns, in single precision; null stands for no data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Reflectance offset, its first day, and the limits of clouds.
OFFSET, OFFSET_AFTER = 1000, "2022-01-25"
CLOUD = {"b11": 0.03, "b12": 0.02, "b10": 0.0025, "f1": 0.1, "f2": 0.25, "f3": 0.01}
NO_MASK_CHANNELS = ("B04", "B03", "B02", "B08")
INVALID_SCL = (0, 1, 3, 8, 9, 10, 11)


def f32(value: float | Column) -> Column:
    return (value if isinstance(value, Column) else F.lit(float(value))).cast("float")


def clip(v: Column, low: float, high: float) -> Column:
    return F.greatest(f32(low), F.least(f32(high), v))


def known(raw: Column) -> Column:
    """raw, null where it is the no-data value 0."""
    return F.when(raw != 0, raw)


def toa(raw: Column, day: Column) -> Column:
    """Top-of-atmosphere reflectance 0..1; 0 (no data) for raw 0 and for what the offset after 2022-01-25 uses up."""
    v = F.when(F.coalesce(day > F.to_date(F.lit(OFFSET_AFTER)), F.lit(False)), (raw - f32(OFFSET)).cast("float")).otherwise(raw)
    return F.when(raw == 0, f32(0)).otherwise(clip((F.greatest(v, f32(0)) / f32(10000)).cast("float"), 0, 1))


def boa(raw: Column) -> Column:
    """Bottom-of-atmosphere reflectance 0..1; 0 for raw 0."""
    return clip((raw / f32(10000)).cast("float"), 0, 1)


def cloud_mask(b10: Column, b11: Column, b12: Column, b02: Column | None = None, b03: Column | None = None, b04: Column | None = None) -> Column:
    """Simple cloud test; with blue, green and red the full one."""
    out = (b11 < f32(CLOUD["b11"])) | (b12 < f32(CLOUD["b12"])) | (b10 > f32(CLOUD["b10"]))
    if b02 is not None and b03 is not None and b04 is not None:
        den = (b03 + b11).cast("float")
        f1 = F.when(den == 0, f32(0)).otherwise(((b03 - b11).cast("float") / F.nullif(den, f32(0))).cast("float"))
        f2 = ((b02 + b03 + b04).cast("float") / f32(3)).cast("float")
        f3 = (b02 - (f32(0.5) * b04).cast("float") - f32(0.08)).cast("float")
        out = out | (f1 > f32(CLOUD["f1"])) | (f2 > f32(CLOUD["f2"])) | (f3 > f32(CLOUD["f3"]))
    return out


def cloud_mask_mode(channels: list[str], wanted: str = "full") -> str:
    """none, simple or full: none for exactly red, green, blue, near infrared."""
    return "none" if tuple(c.strip().upper() for c in channels) == NO_MASK_CHANNELS else wanted


def scl_valid(scl: Column) -> Column:
    """False for scene classes that are no data, shadow, cloud or snow; classes are rounded first."""
    return ~F.round(scl).cast("int").isin(*INVALID_SCL)


def ndvi_unit(red: Column, nir: Column) -> Column:
    """NDVI scaled to 0..1; 0 where a band is missing or both sum to 0."""
    den = (nir + red).cast("float")
    value = (((nir - red).cast("float") / F.nullif(den, f32(0))).cast("float") + f32(1)) * f32(0.5)
    return F.coalesce(F.when((red != 0) & (nir != 0) & (den != 0), value.cast("float")), f32(0))


def ndvi_clipped(red: Column, nir: Column) -> Column:
    """NDVI, negative values as 0; null where neither band is positive."""
    den = (nir + red).cast("float")
    return F.when((red > 0) | (nir > 0), F.greatest(f32(0), F.coalesce(((nir - red).cast("float") / F.nullif(den, f32(0))).cast("float"), f32(0))))


def vog1(b05: Column, b06: Column, cloudy: Column) -> Column:
    """The ratio of the red-edge bands; null under clouds or where one is not positive."""
    return F.when(~cloudy & (b05 > 0) & (b06 > 0), (b05 / F.nullif(b06, f32(0))).cast("float"))


def model_input(v: Column, identity: bool = False, divisor: float = 10000.0) -> Column:
    """A value as a model expects it: 0..1, large ones divided first; unchanged for identity models."""
    if identity:
        return v
    low = F.greatest(v, f32(0))
    return clip(F.when(low > f32(2), (low / f32(divisor)).cast("float")).otherwise(low) if divisor > 0 else low, 0, 1)


def valid_pixel(channels: list[Column], cloudy: Column | None = None) -> Column:
    """At least one channel is positive, and there is no cloud."""
    some = reduce(lambda a, b: a | b, [c > 0 for c in channels])
    return F.coalesce(some if cloudy is None else some & ~cloudy, F.lit(False))


def linear_scale(v: Column, low: Column, high: Column) -> Column:
    """A byte 1..255 from low..high, clamped and rounded half up; 0 stays no data."""
    return F.when(v == 0, 0).otherwise(F.least(F.lit(255), F.greatest(F.lit(1), F.floor((v - low) / (high - low) * 254.0 + 1.5)))).cast("int")
