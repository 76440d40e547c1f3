"""Readings of listed quantities in running text, brought to common units.

Everything is Spark SQL: regular expressions find the readings, the unit's alias is
normalised by a join, the unit field of the reading comes before the unit that the text
declares for the dimension, which comes before the source's default, and factor and
offset are applied at the end.

Defined results: a null or empty text gives no reading; a reading whose unit is missing
or unknown, or has another dimension than its quantity, gives none; the same reading
twice in a chunk, or in a repeated row of it, counts once; extra columns are ignored.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import body_without_title

POUND_KG, INCH_M, GRAVITY, ATMOSPHERE_KPA, GALLON_L = 0.45359237, 0.0254, 9.80665, 101.325, 3.785411784
_PSI_KPA = POUND_KG * GRAVITY / INCH_M**2 / 1000
_FTLB_NM = POUND_KG * GRAVITY * INCH_M * 12

#: (dimension, factor, offset, aliases): common = value * factor + offset
UNITS = [
    ("pressure", 0.001, 0.0, "Pa|pascal|pascals"),
    ("pressure", 1.0, 0.0, "kPa|kilopascal|kilopascals|kPa(a)"),
    ("pressure", 1000.0, 0.0, "MPa|megapascal|megapascals"),
    ("pressure", 100.0, 0.0, "bar|bars|bar(a)|bara"),
    ("pressure", 0.1, 0.0, "mbar|millibar|millibars"),
    ("pressure", _PSI_KPA, 0.0, "psi|psia|lbf/in²|lbf/in2|lbf/in^2"),
    ("pressure", ATMOSPHERE_KPA, 0.0, "atm|atmosphere|atmospheres"),
    ("temperature", 1.0, 0.0, "K|kelvin|kelvins"),
    ("temperature", 1.0, 273.15, "°C|ºC|deg C|degree Celsius|degrees Celsius|degC|Celsius"),
    ("temperature", 5 / 9, 459.67 * 5 / 9, "°F|ºF|deg F|degree Fahrenheit|degrees Fahrenheit|degF|Fahrenheit"),
    ("mass", 0.001, 0.0, "mg|milligram|milligrams"),
    ("mass", 1.0, 0.0, "g|gram|grams"),
    ("mass", 1000.0, 0.0, "kg|kilogram|kilograms"),
    ("mass", POUND_KG * 1000, 0.0, "lb|lbs|lbm|pound|pounds"),
    ("mass", POUND_KG * 1000 / 16, 0.0, "oz|ounce|ounces"),
    ("length", 0.001, 0.0, "µm|μm|micrometre|micrometres"),
    ("length", 1.0, 0.0, "mm|millimetre|millimetres|millimeter|millimeters"),
    ("length", 10.0, 0.0, "cm|centimetre|centimetres|centimeter|centimeters"),
    ("length", 1000.0, 0.0, "m|metre|metres|meter|meters"),
    ("length", INCH_M * 1000, 0.0, "in|in.|inch|inches"),
    ("length", INCH_M * 12000, 0.0, "ft|ft.|foot|feet"),
    ("torque", 1.0, 0.0, "N·m|N⋅m|N m|Nm|N-m|newton metre|newton metres|newton-metre|newton-metres"),
    ("torque", 0.01, 0.0, "N·cm|N⋅cm|N cm|Ncm|newton centimetre|newton centimetres"),
    ("torque", 1000.0, 0.0, "kN·m|kN⋅m|kN m|kNm|kilonewton metre|kilonewton metres"),
    ("torque", _FTLB_NM, 0.0, "ft-lb|ft·lb|ft lb|ft lbf|ft·lbf|ft-lbf|lbf·ft|lbf ft|lbf-ft|lb-ft|lb·ft|lb ft|foot-pound|foot-pounds"),
    ("torque", _FTLB_NM / 12, 0.0, "in-lb|in·lb|in lb|in lbf|in·lbf|in-lbf|lbf·in|lbf in|lbf-in|lb-in|lb·in|lb in|inch-pound|inch-pounds"),
    ("flow", 1.0, 0.0, "L/min|lpm|LPM|litres per minute|litre per minute"),
    ("flow", 60.0, 0.0, "L/s|litres per second|litre per second"),
    ("flow", 0.001, 0.0, "mL/min|millilitres per minute"),
    ("flow", 1000 / 60, 0.0, "m³/h|m3/h|m^3/h|cubic metres per hour"),
    ("flow", GALLON_L, 0.0, "US gpm|US gal/min|gpm|gal/min"),
]

#: Words before a unit that scale it.
SCALES = {"": 1.0, "thousands of": 1000.0, "thousandths of": 0.001, "hundreds of": 100.0, "hundredths of": 0.01, "tens of": 10.0, "tenths of": 0.1, "millions of": 1e6, "millionths of": 1e-6}

#: Quantities are a short fixed list; the operator refuses to build patterns from more.
MAX_NAMES = 10_000

_NUM = r"[-−–+]?\d+(?:,\d+)*(?:\.\d+)?(?:[eE][-−+]?\d+|\s*[×x]\s*10\s*\^?\s*[-−+]?\d+)?"


def _loose(text: str) -> str:
    """A pattern for ``text`` whatever blanks, line ends or hyphens part its words."""
    return r"[\s-]+".join(re.escape(w) for w in re.split(r"[\s-]+", text))


def _pattern_of(words: list[str]) -> str:
    return "|".join(_loose(w) for w in sorted(set(words), key=lambda w: (-len(w), w)))


def _key(text: Column) -> Column:
    """Alias as joined: lower case, blanks and hyphens of any kind as one blank."""
    return F.trim(F.regexp_replace(F.lower(text), r"[\s-]+", " "))


def unit_table(spark: SparkSession) -> DataFrame:
    rows = {(d, re.sub(r"[\s-]+", " ", a.lower())): (f, o) for d, f, o, names in UNITS for a in names.split("|")}
    return spark.createDataFrame([(d, a, f, o) for (d, a), (f, o) in rows.items()], "dimension string, alias string, factor double, offset double")


def parse_number(text: Column) -> Column:
    """The value of a number in any of the notations; a comma before exactly three digits groups, any other is a decimal comma."""
    x = F.regexp_replace(F.regexp_replace(text, "[−–]", "-"), r"\s+", "")
    x = F.regexp_replace(x, r"[×x]10\^?", "e")
    x = F.regexp_replace(x, r",(?=\d{3}(?!\d))", "")
    return F.regexp_replace(F.regexp_replace(x, ",", "."), r"^\+", "").try_cast("double")


def readings(chunks: DataFrame, quantities: DataFrame, *, key: str = "chunk_id", text: str = "content", default_units: DataFrame | None = None) -> DataFrame:
    """Distinct ``(key, quantity_id, value_common double)``.

    ``default_units`` may hold ``(key, dimension, alias)``: a unit that the source of the
    row uses where the text gives none; none is assumed without it.
    """
    spark = chunks.sparkSession
    named = quantities.where("names is not null").select("quantity_id", "dimension", F.explode(F.split("names", r"\|")).alias("name")).where("trim(name) <> ''")
    names = [r.name.strip() for r in named.select("name").distinct().limit(MAX_NAMES + 1).collect()]
    if len(names) > MAX_NAMES:
        raise ValueError("more quantity names than patterns are built from")
    if not names:
        return chunks.select(key).limit(0).select(key, F.lit(0).alias("quantity_id"), F.lit(0.0).alias("value_common"))
    name, unit = _pattern_of(names), _pattern_of([a for *_, al in UNITS for a in al.split("|")])
    scale = _pattern_of([s for s in SCALES if s])
    end = r"(?![\w³²/·(])"
    unit_end = rf"(?:{unit}){end}"
    named_unit = rf"(?:\(\s*(?:(?:{scale})\s+)?(?:{unit})\s*\)|\[\s*(?:(?:{scale})\s+)?(?:{unit})\s*\]|/\s*(?:(?:{scale})\s+)?(?:{unit}){end}|in\s+(?:(?:{scale})\s+)?(?:{unit}){end})"
    link = r"(?:,\s+as\s+found,|=|:|settled\s+at|reached|of|was|is|at)"

    forward = rf"(?:{name})\b\s*(?:{named_unit}\s*)?(?:\|\s*)?(?:{link}\s*)?{_NUM}(?![\d])(?:(?:\s*\|)?\s*(?:(?:{scale})\s+)?{unit_end})?"
    backward = rf"{_NUM}\s*(?:(?:{scale})\s+)?(?:{unit})\s+of\s+(?:{name})\b|{_NUM}\s*(?:(?:{scale})\s+)?(?:{unit})\s*\(\s*(?:{name})\s*\)"
    heads = sorted({re.split(r"[\s-]", n.lower())[-1] for n in names})

    src = chunks.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t")).distinct()
    lowered = F.lower("t")
    src = src.where(reduce(lambda a, b: a | b, [lowered.contains(h) for h in heads]))
    # Words divided at a line end are joined first; a hyphen of their own is optional in the patterns.
    src = src.select("k", F.regexp_replace(body_without_title(F.col("t")), r"(?<=[A-Za-z])[-¬­‐]\s?\n(?=[a-z])", "-").alias("t"))

    # 1. A number beside its quantity's name.
    found = src.select("k", "t", F.explode(F.regexp_extract_all("t", F.lit(rf"(?i)(?<![\w])(?:{forward}|{backward})"), F.lit(0))).alias("m"))
    # The name may hold digits or units of its own, so it is cut before they are looked for.
    found = found.select(
        "k", "t", F.regexp_extract("m", rf"(?i)({name})\b", 1).alias("name"),
        F.regexp_replace("m", rf"(?i)(?<![A-Za-z])(?:{name})\b", " ¦ ").alias("rest"),
    )
    num_at = F.regexp_extract("rest", rf"(?<![\w^.,])({_NUM})", 1)
    unit_part = F.regexp_replace("rest", rf"(?<![\w^.,]){_NUM}", " ")
    found = found.select("k", "t", "name", num_at.alias("num"), unit_part.alias("u"))
    found = found.select(
        "k", "t", "name", "num",
        F.regexp_extract("u", rf"(?i)({scale})\s", 1).alias("scale"),
        F.regexp_extract("u", rf"(?i)(?<![\w])(?:in\s+)?(?:(?:{scale})\s+)?({unit}){end}", 1).alias("unit"),
    )

    # 2. Tables whose header names quantity and unit: cells meet their header by position.
    tables = src.where(F.col("t").contains("|---")).select(
        "k", F.explode(F.regexp_extract_all("t", F.lit(r"(?m)^\|[^\n]*\|[ ]*\n\|[-|: ]*\|[ ]*\n(?:\|[^\n]*(?:\n|\z))+"), F.lit(0))).alias("tab")
    )
    lines = tables.select("k", F.split("tab", "\n").alias("l"))
    cells = lambda c: F.split(F.regexp_replace(F.trim(c), r"^\||\|$", ""), r"\|")
    rows = lines.select("k", cells(F.col("l")[0]).alias("head"), F.explode(F.slice("l", F.lit(3), F.size("l"))).alias("row")).where("row <> ''")
    cell = rows.select("k", F.explode(F.arrays_zip("head", cells(F.col("row")).alias("val"))).alias("c")).select("k", F.col("c.head").alias("h"), F.trim(F.col("c.val")).alias("v"))
    cell = cell.where(F.col("h").rlike(rf"(?i)^\s*(?:{name})\s*{named_unit}\s*$") & F.col("v").rlike(rf"^{_NUM}$"))
    rest = F.regexp_replace("h", rf"(?i)^\s*(?:{name})", " ¦ ")
    cell = cell.select(
        "k", F.lit(None).cast("string").alias("t"), F.regexp_extract("h", rf"(?i)^\s*({name})", 1).alias("name"), F.col("v").alias("num"),
        F.regexp_extract(rest, rf"(?i)({scale})\s", 1).alias("scale"),
        F.regexp_extract(rest, rf"(?i)(?<![\w])(?:in\s+)?(?:(?:{scale})\s+)?({unit}){end}", 1).alias("unit"),
    )
    everything = found.unionByName(cell)

    # 3. The unit that the text declares for a whole dimension, for readings without one of their own.
    small = F.broadcast(named.select("quantity_id", "dimension", _key(F.col("name")).alias("name_key")))  # at most MAX_NAMES rows
    r = everything.withColumn("name_key", _key(F.col("name"))).join(small, "name_key")
    scaled_unit = rf"((?:(?:{scale})\s+)?(?:{unit})){end}"
    dims = "pressure|temperature|mass|length|torque|flow"
    said = {d: [] for d in dims.split("|")}
    for d in said:
        stem = {"mass": "mass(?:es)?"}.get(d, d + "s?")
        said[d] = [
            rf"(?i)unless\s+(?:otherwise\s+)?stated,\s+(?:all\s+)?{stem}(?:\s+\w+)?\s+(?:is|are)\s+in\s+{scaled_unit}",
            rf"(?i)all\s+{stem}\s+values\s+(?:are\s+)?in\s+{scaled_unit}",
            rf"(?i)\b{stem}(?:\s+and\s+\w+)?\s+are\s+given\s+in\s+{scaled_unit}",
        ]
    declared = F.lit("")
    for d, patterns in said.items():
        got = F.coalesce(*[F.nullif(F.regexp_extract("t", p, 1), F.lit("")) for p in patterns], F.lit(""))
        declared = F.when(F.col("dimension") == d, got).otherwise(declared)
    r = r.withColumn("declared", F.when((F.col("unit") == "") & F.col("t").isNotNull(), declared).otherwise(F.lit(""))).drop("t")
    if default_units is not None:
        r = r.join(default_units.select(F.col(key).alias("k"), "dimension", F.col("alias").alias("source_unit")), ["k", "dimension"], "left")
    else:
        r = r.withColumn("source_unit", F.lit(None).cast("string"))
    r = r.withColumn("scale", F.when(F.col("unit") != "", F.col("scale")).otherwise(F.regexp_extract("declared", rf"(?i)^({scale})\s", 1)))
    own, text_unit = F.nullif("unit", F.lit("")), F.nullif(F.regexp_replace("declared", rf"(?i)^(?:{scale})\s+", ""), F.lit(""))
    r = r.withColumn("alias", _key(F.coalesce(own, text_unit, F.col("source_unit"))))
    units = F.broadcast(unit_table(spark))  # the fixed list above
    r = r.join(units, ["dimension", "alias"])
    scale_map = F.create_map(*[x for s, f in SCALES.items() for x in (F.lit(s), F.lit(f))])
    by = F.coalesce(scale_map[_key(F.col("scale"))], F.lit(1.0))
    value = parse_number(F.col("num")) * by * F.col("factor") + F.col("offset")
    return r.select(F.col("k").alias(key), "quantity_id", value.alias("value_common")).where("value_common is not null").distinct()


def reading_integers(chunks: DataFrame, quantities: DataFrame, **kw) -> DataFrame:
    """Distinct readings with the common value rounded to the nearest integer (halves away from zero)."""
    r = readings(chunks, quantities, **kw)
    # The sum of binary fractions can fall a hair below a half; nine decimals take that back.
    return r.withColumn("value_common", F.round(F.round("value_common", 9)).cast("bigint")).distinct()
