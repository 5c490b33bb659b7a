"""Scalar functions as column expressions: strings, numbers, cases, JSON. All run inside generated code, none in Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INFINITY = float("inf")

# --- numbers ---------------------------------------------------------------------------------------------------------


def is_finite(c: Column) -> Column:
    """True for numbers that are neither NaN nor infinite; null stays null."""
    return ~F.isnan(c) & (F.abs(c) < F.lit(INFINITY))


def finite_or_null(c: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(is_finite(c), c)


def nan_to_null(c: Column) -> Column:
    """NaN as null; infinities pass."""
    return F.when(~F.isnan(c), c)


def number_or_zero(c: Column) -> Column:
    """Anything that is not a finite number, text included, as 0."""
    return F.coalesce(finite_or_null(c.try_cast("double")), F.lit(0.0))


def clip(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """``c`` limited to an interval; null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def safe_ratio(a: Column, b: Column) -> Column:
    """``a`` over ``b``, with denominators below 1 taken as 1."""
    return a.cast("double") / F.greatest(b.cast("double"), F.lit(1.0))


def truncated(c: Column) -> Column:
    """The integer part, towards zero."""
    return c.cast("int")


def half_even(c: Column) -> Column:
    """Rounded to an integer, halves to the even one."""
    return F.rint(c).cast("int")


def to_byte_level(c: Column) -> Column:
    """A share as a level of 0 to 255, truncated."""
    return F.floor(c * 255).cast("int")


def hue_distance(a: Column, b: Column, length: float = 180.0) -> Column:
    """Distance of two hues on their circle."""
    d = F.abs(a - b)
    return F.least(d, F.lit(length) - d)


def circle_iou(x1: Column, y1: Column, r1: Column, x2: Column, y2: Column, r2: Column) -> Column:
    """Intersection over union of two circles; 0 if they are apart, the ratio of areas if one lies within the other."""
    d = F.hypot(x1 - x2, y1 - y2)
    return iou_of_shared(circle_shared(d, r1, r2), d, r1, r2)


def circle_shared(d: Column, r1: Column, r2: Column) -> Column:
    """The area that two circles share whose centres are ``d`` apart, if they meet."""
    small, large = F.least(r1, r2), F.greatest(r1, r2)
    within = F.pi() * small * small

    def half_angle(r: Column, other: Column) -> Column:
        return F.acos(clip((d * d + r * r - other * other) / F.greatest(2 * d * r, F.lit(1e-300)), -1.0, 1.0))

    a, b = half_angle(r1, r2), half_angle(r2, r1)
    kite = F.sqrt(F.greatest(F.lit(0.0), (r1 + r2 - d) * (d + r1 - r2) * (d - r1 + r2) * (d + r1 + r2))) / 2
    lens = r1 * r1 * a + r2 * r2 * b - kite
    return F.when(d <= large - small, within).otherwise(lens)


def iou_of_shared(shared: Column, d: Column, r1: Column, r2: Column) -> Column:
    """Intersection over union of two circles by the area that they share; 0 if they are apart."""
    both = F.pi() * (r1 * r1 + r2 * r2)
    return F.when(d >= r1 + r2, F.lit(0.0)).otherwise(shared / F.greatest(both - shared, F.lit(1e-9)))


def asymmetry_score(xor: Column, area_delta: Column, jaccard: Column, hue: Column) -> Column:
    """How differently two plates respond, 0 to 1; a null hue distance counts as none."""
    hue_part = F.coalesce(hue, F.lit(0.0)) / 90
    return clip(0.45 * xor + 0.25 * F.abs(area_delta) + 0.20 * (1 - jaccard) + 0.10 * hue_part)


def pixel_difference(hue: Column, common: Column, xor: Column) -> Column:
    """Difference of a pixel of two plates: hue distance where both respond, and whether just one does."""
    part = F.when(common, F.coalesce(hue, F.lit(0.0)) / 90).otherwise(F.lit(0.0))
    return clip(0.65 * part + 0.35 * xor.cast("double"))


# --- strings ---------------------------------------------------------------------------------------------------------

BLANKS = " \t\n\r\f\v"


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(c, F.lit(BLANKS))


def text_or(c: Column, default: str) -> Column:
    """Stripped text, or a default if nothing is left."""
    return F.coalesce(F.nullif(strip(c), F.lit("")), F.lit(default))


def path_safe(c: Column) -> Column:
    """Path separators as underscores; names made of dots only become underscores too."""
    name = F.translate(c, "/\\", "__")
    return F.when(name.rlike(r"^\.+$"), F.translate(name, ".", "_")).otherwise(name)


def file_stem(c: Column) -> Column:
    """The last part of a path without its last suffix; a leading dot starts no suffix."""
    name = F.regexp_extract(c, r"([^/]*)/*$", 1)
    return F.regexp_replace(name, r"(?<=[^.])\.[^.]+$", "")


def plate_name(filename: Column, ordinal: Column) -> Column:
    """The id of a plate from its file's name and its number in the file."""
    return F.replace(F.format_string("%s-P%02d", F.substring(file_stem(filename), 1, 24), ordinal), F.lit(" "), F.lit("_"))


def html_escape(c: Column) -> Column:
    """``&``, ``<``, ``>`` and both quotes as entities."""
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(plain), F.lit(entity))
    return c


def joined_or(c: Column, default: str = "None", separator: str = ", ") -> Column:
    """The texts of an array joined, or a default if there are none."""
    return F.coalesce(F.nullif(F.concat_ws(separator, c), F.lit("")), F.lit(default))


def fixed(c: Column, digits: int = 3) -> Column:
    """A number with a fixed number of decimals."""
    return F.format_string(f"%.{digits}f", c)


def url_component(c: Column) -> Column:
    """Percent-encoded text for a part of an address."""
    return F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))


def iso_utc(c: Column) -> Column:
    """A time as ISO 8601 text in UTC, with microseconds and offset."""
    return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))


def short_id() -> Column:
    """Ten random hexadecimal digits."""
    return F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 10)


# --- cases -----------------------------------------------------------------------------------------------------------

#: Fixed value: the profile of uploads that name none.
DEFAULT_PROFILE = "client-device-tlc-pending"


def normalized_side(c: Column) -> Column:
    """LEFT, RIGHT or UNKNOWN."""
    side = F.upper(strip(c))
    return F.when(side.isin("L", "LEFT"), "LEFT").when(side.isin("R", "RIGHT"), "RIGHT").otherwise("UNKNOWN")


def profile_or_default(c: Column) -> Column:
    return text_or(c, DEFAULT_PROFILE)


def position_or_auto(position: Column, ordinal: Column) -> Column:
    """The position as text, or one made from the ordinal; an empty text stays."""
    return F.coalesce(position.cast("string"), F.format_string("AUTO-%02d", ordinal))


def morphology(area: Column, components: Column, largest: Column, elongation: Column, branches: Column) -> Column:
    """The descriptor of a response; the first rule that holds decides."""
    return (
        F.when(area < 0.02, "minimal-response")
        .when((components >= 5) & (largest < 0.12), "scattered")
        .when((elongation >= 3) & (area < 0.22), "linear-like")
        .when((branches >= 8) & (elongation >= 1.6), "branched/complex")
        .when(area >= 0.30, "diffuse/large-region")
        .when(largest >= 0.08, "focal/irregular-region")
        .otherwise("mixed")
    )


#: Image quality flags in the order in which they are reported, and those of which two mean rejection.
QC_FLAGS = (
    "LOW_SHARPNESS",
    "BRIGHT_CLIPPING",
    "VERY_DARK_PLATE",
    "SATURATION_CLIPPING",
    "LOW_CONTRAST",
    "VERY_LOW_THERMOCHROMIC_RESPONSE",
    "POSSIBLE_OVER_RESPONSE",
)
QC_SEVERE = ("BRIGHT_CLIPPING", "VERY_DARK_PLATE", "LOW_CONTRAST")


def qc_flags(sharpness: Column, bright: Column, dark: Column, saturated: Column, contrast: Column, response: Column) -> Column:
    """The flags that hold, in their order."""
    rules = (sharpness < 20, bright > 0.08, dark > 0.85, saturated > 0.20, contrast < 12, response < 0.005, response > 0.85)
    return F.array_compact(F.array(*[F.when(rule, flag) for rule, flag in zip(rules, QC_FLAGS)]))


def severe_count(flags: Column) -> Column:
    return F.size(F.filter(flags, lambda f: f.isin(*QC_SEVERE)))


def qc_status(flags: Column) -> Column:
    """REJECT_REFERENCE_QC with two severe flags, REVIEW with any flag, else PASS_REFERENCE_QC."""
    return F.when(severe_count(flags) >= 2, "REJECT_REFERENCE_QC").when(F.size(flags) > 0, "REVIEW").otherwise("PASS_REFERENCE_QC")


def guardrails() -> dict[str, Column]:
    """Columns that every result carries: no risk, no claim."""
    return {"clinical_risk": F.lit(None).cast("double"), "clinical_claim": F.lit("NONE")}


# --- arrays and vectors ----------------------------------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null if one vector is zero."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def unit(a: Column) -> Column:
    """A vector of length one in the same direction."""
    n = F.nullif(F.sqrt(dot(a, a)), F.lit(0.0))
    return F.transform(a, lambda x: x.cast("double") / n)


def pair_vector(a: Column, b: Column) -> Column:
    """Both vectors, their absolute difference and their product, in one."""
    return F.concat(
        F.transform(a, lambda x: x.cast("double")),
        F.transform(b, lambda x: x.cast("double")),
        F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))),
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
    )


def fused_vector(numbers: list[Column], embedding: Column) -> Column:
    """Explicit numbers, then the embedding, in one vector; numbers that are not finite are 0, a null embedding gives null."""
    explicit = F.array(*[number_or_zero(n) for n in numbers])
    return F.when(embedding.isNotNull(), F.concat(explicit, F.transform(embedding, lambda x: x.cast("double"))))


def zip_short(a: Column, b: Column) -> Column:
    """Pairs of the elements at the same place, as many as the shorter array has."""
    n = F.least(F.size(a), F.size(b))
    return F.arrays_zip(F.slice(a, 1, n).alias("a"), F.slice(b, 1, n).alias("b"))


# --- JSON ------------------------------------------------------------------------------------------------------------


def strict_json(c: Column, *numbers: Column) -> Column:
    """JSON text with all members; raises if one of ``numbers`` is NaN or infinite."""
    text = F.to_json(c, {"ignoreNullFields": "false"})
    if not numbers:
        return text
    bad = F.lit(False)
    for n in numbers:
        bad = bad | F.coalesce(~is_finite(n), F.lit(False))
    return F.when(bad, F.raise_error(F.lit("numbers out of the range of JSON"))).otherwise(text)


NEIGHBORS = "array<struct<plate_id:string,cosine_distance:double>>"


def neighbor_list(c: Column) -> Column:
    """A stored neighbour list as an array; null for text that is none."""
    return F.from_json(c, NEIGHBORS, {"mode": "PERMISSIVE"})


UPLOAD_ITEM = T.StructType(
    [
        T.StructField("filename", T.StringType()),
        T.StructField("side", T.StringType()),
        T.StructField("position", T.StringType()),
        T.StructField("sequence_index", T.StringType()),
        T.StructField("tlc_profile_id", T.StringType()),
        T.StructField("device_profile_id", T.StringType()),
    ]
)


def upload_items(c: Column) -> Column:
    """Upload metadata: a list, or an object with the list as ``files``. Null for text of another shape."""
    as_list = F.when(F.ltrim(c).startswith("["), F.from_json(c, T.ArrayType(UPLOAD_ITEM)))
    as_object = F.when(F.ltrim(c).startswith("{"), F.from_json(c, T.StructType([T.StructField("files", T.ArrayType(UPLOAD_ITEM))]))["files"])
    return F.coalesce(as_list, as_object)
