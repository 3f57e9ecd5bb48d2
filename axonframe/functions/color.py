"""Colour maps and palettes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from axonframe.functions.scan import is_finite

# Colour stops that results must equal.
VIRIDIS = [
    (0.267, 0.005, 0.329), (0.283, 0.141, 0.458), (0.254, 0.265, 0.530), (0.207, 0.372, 0.553),
    (0.164, 0.471, 0.558), (0.128, 0.567, 0.551), (0.135, 0.659, 0.518), (0.267, 0.749, 0.441),
    (0.478, 0.821, 0.318), (0.741, 0.873, 0.150),
]
INFERNO = [
    (0.001, 0.000, 0.014), (0.125, 0.047, 0.290), (0.302, 0.073, 0.488), (0.511, 0.121, 0.561),
    (0.709, 0.212, 0.486), (0.865, 0.316, 0.347), (0.962, 0.471, 0.212), (0.988, 0.683, 0.139),
    (0.978, 0.893, 0.306),
]
MAGMA = [
    (0.001, 0.000, 0.014), (0.113, 0.065, 0.276), (0.275, 0.063, 0.485), (0.445, 0.122, 0.507),
    (0.625, 0.185, 0.498), (0.805, 0.251, 0.443), (0.944, 0.378, 0.365), (0.992, 0.606, 0.419),
    (0.987, 0.848, 0.608),
]
PLASMA = [
    (0.050, 0.030, 0.528), (0.255, 0.014, 0.615), (0.417, 0.001, 0.658), (0.563, 0.052, 0.642),
    (0.693, 0.165, 0.565), (0.798, 0.280, 0.470), (0.881, 0.393, 0.383), (0.949, 0.518, 0.295),
    (0.988, 0.652, 0.211), (0.940, 0.975, 0.131),
]
STOPS = {"viridis": VIRIDIS, "inferno": INFERNO, "magma": MAGMA, "plasma": PLASMA}

# The public 20-colour categorical palette and two extra tones.
CATEGORICAL = [
    (0.122, 0.467, 0.706), (0.682, 0.780, 0.910), (1.000, 0.498, 0.055), (1.000, 0.733, 0.471),
    (0.173, 0.627, 0.173), (0.596, 0.875, 0.541), (0.839, 0.153, 0.157), (1.000, 0.596, 0.588),
    (0.580, 0.404, 0.741), (0.773, 0.690, 0.835), (0.549, 0.337, 0.294), (0.769, 0.612, 0.580),
    (0.890, 0.467, 0.761), (0.969, 0.714, 0.824), (0.498, 0.498, 0.498), (0.780, 0.780, 0.780),
    (0.737, 0.741, 0.133), (0.859, 0.859, 0.553), (0.090, 0.745, 0.812), (0.620, 0.855, 0.898),
    (0.400, 0.761, 0.647), (0.988, 0.553, 0.384),
]
# Well-known bundle names and their categorical colour number.
NAMED_BUNDLES = {
    "Left Anterior Thalamic": 0, "C_L": 0, "Right Anterior Thalamic": 1, "C_R": 1,
    "Left Corticospinal": 2, "Right Corticospinal": 3,
    "Left Cingulum Cingulate": 4, "MCP": 4, "Right Cingulum Cingulate": 5, "CCMid": 5,
    "Left Posterior Arcuate": 6, "Right Posterior Arcuate": 7,
    "Forceps Minor": 8, "CC_ForcepsMinor": 8, "Forceps Major": 9, "CC_ForcepsMajor": 9,
    "Left Inferior Fronto-occipital": 10, "IFOF_L": 10, "Right Inferior Fronto-occipital": 11, "IFOF_R": 11,
    "Left Inferior Longitudinal": 12, "F_L": 12, "Right Inferior Longitudinal": 13, "F_R": 13,
    "Left Superior Longitudinal": 14, "Right Superior Longitudinal": 15,
    "Left Uncinate": 16, "UF_L": 16, "Right Uncinate": 17, "UF_R": 17,
    "Left Arcuate": 18, "AF_L": 18, "Right Arcuate": 19, "AF_R": 19,
    "Left Vertical Occipital": 20, "Right Vertical Occipital": 21, "median": 6,
}
# Callosal bundle colours.
CALLOSAL = {
    "Callosum Orbital": (0.20, 0.13, 0.53), "Callosum Anterior Frontal": (0.07, 0.47, 0.20),
    "Callosum Superior Frontal": (0.27, 0.67, 0.60), "Callosum Motor": (0.53, 0.80, 0.93),
    "Callosum Superior Parietal": (0.87, 0.80, 0.47), "Callosum Posterior Parietal": (0.80, 0.40, 0.47),
    "Callosum Occipital": (0.67, 0.27, 0.60), "Callosum Temporal": (0.53, 0.13, 0.33),
}
GOLDEN_ANGLE = 137.50776
LABEL_MULTIPLIER = 0x9E3779B9

RGB = "struct<r:double,g:double,b:double>"


def rgb(r: Column | float, g: Column | float, b: Column | float) -> Column:
    def as_column(v: Column | float) -> Column:
        return v if isinstance(v, Column) else F.lit(float(v))

    return F.struct(as_column(r).alias("r"), as_column(g).alias("g"), as_column(b).alias("b"))


def clamp01(v: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))


def window_level(value: Column, low: float | Column, high: float | Column) -> Column:
    """Position of ``value`` in [low, high], clamped to [0, 1]."""
    low, high = (v if isinstance(v, Column) else F.lit(float(v)) for v in (low, high))
    return clamp01((value - low) / F.greatest(high - low, F.lit(1e-6)))


def piecewise_gate(value: Column, low: float, high: float, below: float, above: float) -> Column:
    """``below`` under the range, ``above`` over it, linear inside; no value means 1."""
    inner = F.lit(float(below)) + (value - F.lit(float(low))) / F.lit(max(high - low, 1e-6)) * F.lit(float(above - below))
    return (
        F.when(~is_finite(value), F.lit(1.0))
        .when(value <= low, F.lit(float(below)))
        .when(value >= high, F.lit(float(above)))
        .otherwise(inner)
    )


def map_colors(t: Column, name: str) -> Column:
    """Colour of ``t`` (clamped to [0, 1]) as a struct r, g, b."""
    t = clamp01(t)
    if name == "blue_white_red":
        up, down = t * 2.0, (F.lit(1.0) - t) * 2.0
        low = t < 0.5
        return rgb(F.when(low, up).otherwise(F.lit(1.0)), F.when(low, up).otherwise(down), F.when(low, F.lit(1.0)).otherwise(down))
    if name == "grayscale":
        return rgb(t, t, t)
    if name == "hot":
        return rgb(clamp01(t * 2.5), clamp01(t * 2.5 - 1.0), clamp01(t * 5.0 - 4.0))
    if name == "cool":
        return rgb(t, F.lit(1.0) - t, F.lit(1.0))
    if name == "red_yellow":
        return rgb(F.lit(1.0), t, F.lit(0.0))
    if name == "blue_lightblue":
        return rgb(F.lit(0.0), t, F.lit(1.0))
    stops = STOPS[name]
    at = t * float(len(stops) - 1)
    lower = F.least(F.floor(at), F.lit(len(stops) - 2)).cast("int")
    share = at - F.floor(at)
    channels = []
    for c in range(3):
        table = F.array(*[F.lit(float(s[c])) for s in stops])
        a, b = F.get(table, lower), F.get(table, lower + 1)
        # At exactly t = 1 the share is zero, so the colour is that of the last step's start.
        channels.append(a + (b - a) * share)
    return rgb(*channels)


def distinct_color(index: Column) -> Column:
    """Golden-angle hue with alternating saturation and value."""
    hue = F.pmod(index.cast("double") * GOLDEN_ANGLE, F.lit(360.0))
    saturation = F.when(F.pmod(index, F.lit(2)) == 0, 0.72).otherwise(0.55)
    third = F.pmod(index, F.lit(3))
    value = F.when(third == 0, 0.95).when(third == 1, 0.78).otherwise(0.62)
    sector = hue / 60.0
    chroma = value * saturation
    cross = chroma * (F.lit(1.0) - F.abs(F.pmod(sector, F.lit(2.0)) - 1.0))
    rest = value - chroma
    zero = F.lit(0.0)
    at = F.floor(sector)

    def channel(*six: Column) -> Column:
        out = F.when(at == 0, six[0])
        for n in range(1, 5):
            out = out.when(at == n, six[n])
        return out.otherwise(six[5]) + rest

    return rgb(
        channel(chroma, cross, zero, zero, cross, chroma),
        channel(cross, chroma, chroma, cross, zero, zero),
        channel(zero, zero, cross, chroma, chroma, cross),
    )


def label_color(label: Column) -> Column:
    """Generated colour of a parcel label that has no colour of its own."""
    mixed = F.pmod(label.cast("long") * F.lit(LABEL_MULTIPLIER), F.lit(2**32))
    byte = [F.pmod(F.shiftright(mixed, s), F.lit(256)) for s in (0, 8, 16)]
    return rgb(*[F.greatest(F.lit(0.2), F.least(F.lit(0.95), b / 255.0)) for b in byte])


def bundle_name_color(name: Column) -> Column:
    """Colour of a well-known bundle name, NULL otherwise."""
    pairs = {n: CATEGORICAL[i] for n, i in NAMED_BUNDLES.items()} | CALLOSAL
    table = F.create_map(*[v for n, c in pairs.items() for v in (F.lit(n), rgb(*c))])
    return F.try_element_at(table, name)


def sheet_color(name: Column) -> Column:
    """Colour of ``sheet_NNNN`` / ``super_NNNN`` names (four digits, N > 0), NULL otherwise."""
    digits = F.regexp_extract(name, r"^(?:sheet|super)_([0-9]{4})$", 1)
    number = F.when(digits != "", digits).otherwise(F.lit("0")).cast("long")
    return F.when(number > 0, distinct_color(number - 1))
