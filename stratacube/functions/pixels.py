"""Column expressions on stored pixel values: validity, physical values, modular deltas, indices, colours.

Unsigned data are ints here. Invalid pixels are nulls inside the engine and become NaN only on export.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values of a stored index that means -1 to 1.
INDEX_LIMIT = 10_000
#: Digital numbers up to this, in green and near infrared alike, are deep water.
DARK_DN = 5
#: Scene classes that are land or water seen clearly (vegetation, bare, water, unclassified, snow).
CLEAR_CLASSES = (4, 5, 6, 7, 11)
#: Offset of processing baselines from this one on.
BOA_BASELINE, BOA_OFFSET = "04.00", 1000
#: Tone mapping: gain before Reinhard's curve, boost of saturation, weights of luminance.
GAIN, SATURATION, LUMA = 5.0, 1.4, (0.2126, 0.7152, 0.0722)


def valid(v: Column, mask: Column | None = None, nodata: float | int | None = None) -> Column:
    """A mask decides alone; else the nodata value does; else every pixel is valid."""
    if mask is not None:
        return F.coalesce(mask == 1, F.lit(False))
    if nodata is not None:
        return v != F.lit(nodata)
    return F.lit(True)


def physical(v: Column, scale: float, offset: float, ok: Column | None = None) -> Column:
    """stored * scale + offset in single precision throughout; null where not ok."""
    out = v.cast("float") * F.lit(scale).cast("float") + F.lit(offset).cast("float")
    return out if ok is None else F.when(ok, out)


def whole_divisor(scale: float) -> int:
    """1 / scale where that is a whole number (but for rounding) and scale isn't 1, else 0."""
    inverse = 1.0 / scale
    whole = round(inverse)
    return whole if scale != 1 and whole and abs(inverse - whole) < 1e-6 * inverse else 0


def physical_exact(v: Column, scale: float, offset: float, ok: Column | None = None) -> Column:
    """In double precision; divides where the scale is one over a whole number, which keeps the last bit."""
    divisor = whole_divisor(scale)
    value = v.cast("double")
    out = (value / F.lit(float(divisor)) if divisor else value * F.lit(scale)) + F.lit(offset)
    return out if ok is None else F.when(ok, out)


def residual(v: Column, anchor: Column, bits: int = 16) -> Column:
    return F.pmod(v - anchor, F.lit(1 << bits)).cast("int")


def restored(delta: Column, anchor: Column, bits: int = 16) -> Column:
    return F.pmod(anchor + delta, F.lit(1 << bits)).cast("int")


def normalized_difference(a: Column, b: Column, otherwise: float | None = None) -> Column:
    """(a - b) / (a + b) where the sum is positive; else null, or what is given."""
    out = F.when(a + b > 0, (a - b) / (a + b))
    return out if otherwise is None else out.otherwise(F.when(a.isNotNull() & b.isNotNull(), F.lit(otherwise)))


def ndvi(nir: Column, red: Column) -> Column:
    return normalized_difference(nir, red)


def ndwi(green: Column, nir: Column) -> Column:
    return normalized_difference(green, nir)


def stored_index(a: Column, b: Column) -> Column:
    """A normalised difference as a whole number up to INDEX_LIMIT, halves to even."""
    x, y = a.cast("double"), b.cast("double")
    return F.when(x + y > 0, F.rint((x - y) / (x + y) * INDEX_LIMIT).cast("int"))


def dark(green: Column, nir: Column) -> Column:
    return (green <= DARK_DN) & (nir <= DARK_DN)


def decibel(v: Column, amplitude: bool = True) -> Column:
    """10 log10 of the power; null unless the value is positive."""
    x = v.cast("double")
    return F.when(x > 0, F.lit(10.0) * F.log10(x * x if amplitude else x))


def without_offset(v: Column, baseline: Column) -> Column:
    """Values of newer baselines on the older ones' scale, at least 1; 0 stays 0."""
    shifted = F.greatest(F.least(v - BOA_OFFSET, F.lit(65535)), F.lit(1))
    return F.when(baseline < BOA_BASELINE, v).otherwise(F.when(v > 0, shifted).otherwise(F.lit(0))).cast("int")


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.least(x, F.lit(hi)), F.lit(lo))


def to_srgb(x: Column) -> Column:
    return F.when(x <= 0.0031308, F.lit(12.92) * x).otherwise(F.lit(1.055) * F.pow(F.greatest(x, F.lit(0.0)), F.lit(1 / 2.4)) - 0.055)


def reinhard(reflectance: Column) -> Column:
    scaled = reflectance * GAIN
    return to_srgb(scaled / (scaled + 1))


def tone(reflectance: Column, low: float = 0.0) -> Column:
    """Reinhard's curve in sRGB, with the shadows up to low cut off."""
    out = reinhard(reflectance)
    return clamp((out - low) / (1.0 - low)) if 1.0 - low > 0.001 else out


def true_color(r: Column, g: Column, b: Column, low: float = 0.0) -> tuple[Column, Column, Column]:
    toned = [tone(c, low) for c in (r, g, b)]
    luma = sum((c * w for c, w in zip(toned[1:], LUMA[1:], strict=True)), toned[0] * LUMA[0])
    return tuple(clamp(luma * (1 - SATURATION) + c * SATURATION) for c in toned)


Colour = tuple[float, float, float]

# Products must have these colours.
#: Colour ramps: (from, to, colour at from, colour at to), the first below zero.
NDVI_RAMP: list[tuple[float, float, Colour, Colour]] = [
    (-1.0, 0.0, (0.14, 0.15, 0.19), (0.48, 0.42, 0.36)),
    (0.0, 0.2, (0.76, 0.70, 0.52), (0.50, 0.76, 0.32)),
    (0.2, 0.5, (0.50, 0.76, 0.32), (0.18, 0.52, 0.16)),
    (0.5, 1.0, (0.18, 0.52, 0.16), (0.04, 0.28, 0.04)),
]
NDWI_RAMP: list[tuple[float, float, Colour, Colour]] = [
    (-1.0, 0.0, (0.32, 0.26, 0.20), (0.58, 0.52, 0.42)),
    (0.0, 0.3, (0.62, 0.80, 0.94), (0.22, 0.52, 0.84)),
    (0.3, 1.0, (0.22, 0.52, 0.84), (0.06, 0.22, 0.52)),
]
WATER_BLUE: Colour = (0.18, 0.48, 0.84)


def ramp(v: Column, pieces: list[tuple[float, float, Colour, Colour]]) -> tuple[Column, Column, Column]:
    """Piecewise linear colours, held at the ends."""

    def channel(k: int) -> Column:
        out = None
        for i, (lo, hi, a, b) in enumerate(pieces):
            at = clamp((v - lo) / (hi - lo))
            mix = at * (b[k] - a[k]) + a[k]
            if i == len(pieces) - 1:
                return F.when(v.isNull(), None).otherwise(mix) if out is None else out.otherwise(mix)
            out = F.when(v < hi, mix) if out is None else out.when(v < hi, mix)
        raise ValueError("a ramp needs pieces")

    return tuple(channel(k) for k in range(3))


def water_colour(green: Column, nir: Column, low: float = 0.0) -> tuple[Column, Column, Column]:
    """Blue where the index says water, else the toned green as grey."""
    wet = normalized_difference(green, nir, 0.0) > 0
    land = tone(green, low) * 0.65 + 0.06
    return tuple(F.when(wet, F.lit(c)).otherwise(land) for c in WATER_BLUE)


def linear(v: Column, lo: float, hi: float) -> Column:
    return clamp((v - lo) / (hi - lo))


def rendered_8bit(v: Column, lo: float, hi: float) -> Column:
    """0 to 255, halves to even."""
    return F.rint(linear(v.cast("double"), lo, hi) * 255).cast("int")


def shade(product: str, inputs: list[Column], low: float = 0.0, span: tuple[float, float] | None = None) -> tuple[Column, Column, Column]:
    """Red, green and blue of a product from its inputs, in the order that the product needs them.

    With a span, values are stretched linearly in place of the tone curve (data that aren't reflectance). Indices are 0
    where the sum of their inputs isn't positive.
    """
    if span is not None:
        parts = [linear(c, *span) for c in inputs]
        return (parts[0],) * 3 if product == "band" else tuple((parts + parts[-1:] * 3)[:3])
    if product == "true_color":
        return true_color(*inputs, low)
    if product == "false_color":
        return tuple(tone(c, low) for c in inputs)
    if product == "ndvi":
        return ramp(normalized_difference(inputs[0], inputs[1], 0.0), NDVI_RAMP)
    if product == "ndwi":
        return ramp(normalized_difference(inputs[0], inputs[1], 0.0), NDWI_RAMP)
    if product == "water":
        return water_colour(inputs[0], inputs[1], low)
    if product == "band":
        return (tone(inputs[0], low),) * 3
    raise ValueError(f"no product {product!r}")
