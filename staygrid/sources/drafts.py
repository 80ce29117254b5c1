"""Listing drafts from JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Draft fields, with the default a missing key takes.
REQUIRED_TEXT = (
    "title", "addressLine", "locality", "genderPreference", "pgType", "foodType",
)
OPTIONAL_TEXT = ("description", "pincode", "contactPhone")
REQUIRED_NUMBER = ("latitude", "longitude")
DEFAULT_CITY = "Bengaluru"
DEFAULT_NOTICE_DAYS = 30

ROOM = (
    "struct<sharingType:string,monthlyRent:int,securityDeposit:int,totalBeds:int,"
    "availableBeds:int,noticePeriodDays:variant>"
)
# Fields with a default are read as variants: a missing key is then a SQL NULL and
# an explicit null a variant null, which the source format treats as an error.
SCHEMA = ", ".join(
    [f"{name} string" for name in REQUIRED_TEXT + OPTIONAL_TEXT]
    + [f"{name} double" for name in REQUIRED_NUMBER]
    + ["city variant", f"roomOptions array<{ROOM}>", "amenityIds array<int>"]
    + ["_bad string"]
)
ROOM_REQUIRED = (
    "sharingType", "monthlyRent", "securityDeposit", "totalBeds", "availableBeds",
)
OUTPUT = {
    "title": "title", "description": "description", "addressLine": "address_line",
    "locality": "locality", "city": "city", "pincode": "pincode",
    "contactPhone": "contact_phone", "latitude": "latitude", "longitude": "longitude",
    "genderPreference": "gender_preference", "pgType": "pg_type", "foodType": "food_type",
    "roomOptions": "rooms", "amenityIds": "amenity_ids",
}


# Whole strings, marks, and runs of anything else; a quote that does not end stays alone.
TOKENS = r'''"[^"\\]*+(?:\\.[^"\\]*+)*+"|[{}\[\],:]|[^\s{}\[\],:"]+|"'''
NUMBERS = (
    *REQUIRED_NUMBER, "monthlyRent", "securityDeposit", "totalBeds", "availableBeds", "noticePeriodDays", "amenityIds",
)
TEXTS = (*REQUIRED_TEXT, *OPTIONAL_TEXT, "city", "sharingType")
NUMBER = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"


def strict_json(lines: DataFrame, column: str) -> DataFrame:
    """Lenient JSON lines as strict JSON text in the same column: bare values become strings
    where text is asked for or where they are no literal, quoted numbers become numbers
    where one is asked for. What is neither stays malformed. Expressions only."""
    tokens = F.regexp_extract_all(F.col(column), F.lit(TOKENS), F.lit(0))
    # The exploded array keeps the tokens from being computed again for each of them.
    cut = lines.withColumn("_cut", F.explode(F.array(F.struct(tokens.alias("t")))))
    t = F.col("_cut.t")

    def written(token: Column, i: Column) -> Column:
        before, after = F.get(t, i - 1), F.get(t, i + 1)
        key = F.when(before == ":", F.regexp_replace(F.get(t, i - 2), '"', ""))
        quoted = token.startswith('"') & token.endswith('"') & (F.length(token) > 1)
        inner = F.substring(token, F.lit(2), F.length(token) - 2)
        listed = before.isin("[", ",") & F.coalesce(after.isin("]", ","), F.lit(False))
        number = F.coalesce(key.isin(*NUMBERS), F.lit(False))
        bare = ~quoted & ~token.isin(*"{}[],:", '"')
        literal = token.rlike(rf"^({NUMBER}|true|false|null)$")
        as_text = F.coalesce(key.isin(*TEXTS), F.lit(False)) & (token != "null")
        value = F.coalesce(before == ":", F.lit(False)) | listed
        return (
            F.when(quoted & (number | listed) & inner.rlike(f"^{NUMBER}$"), inner)
            .when(bare & value & (as_text | (~literal & ~number)), F.concat(F.lit('"'), token, F.lit('"')))
            .otherwise(token)
        )

    strict = F.when(F.col(column).isNotNull(), F.array_join(F.transform(t, written), " "))
    return cut.withColumn(column, strict).drop("_cut")


def _variant_text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def read_drafts(spark: SparkSession, path: str) -> DataFrame:
    """One row per line with a ``reason`` that is NULL when the draft is well formed.

    Unknown keys are ignored; bare field names, bare values and quoted numbers are
    accepted. A required field that is missing or null, or an explicit null for a
    defaulted field, is a reason.
    """
    lines = spark.read.text(path)
    return parse_drafts(lines, "value")


def parse_drafts(lines: DataFrame, column: str) -> DataFrame:
    """The same for a text column, so drafts may come from any source."""
    options = {
        "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": "_bad",
        "allowUnquotedFieldNames": "true",
        "allowSingleQuotes": "false",
    }
    lines = strict_json(lines.select(column), column)
    draft = F.from_json(F.col(column), SCHEMA, options)
    shape = F.from_json(
        F.col(column),
        "roomOptions variant, amenityIds variant",
        {k: v for k, v in options.items() if k != "columnNameOfCorruptRecord"},
    )
    parsed = lines.select(draft.alias("d"), shape.alias("s"))
    d = F.col("d")

    def missing(names) -> Column:
        test = F.lit(False)
        for name in names:
            test = test | d[name].isNull()
        return test

    null_for_default = (
        F.coalesce(F.is_variant_null(d["city"]), F.lit(False))
        | F.coalesce(F.is_variant_null(F.col("s.roomOptions")), F.lit(False))
        | F.coalesce(F.is_variant_null(F.col("s.amenityIds")), F.lit(False))
        | F.coalesce(
            F.exists(d["roomOptions"], lambda r: F.is_variant_null(r["noticePeriodDays"])),
            F.lit(False),
        )
    )
    bad_element = F.coalesce(
        F.exists(
            d["roomOptions"],
            lambda r: r.isNull() | F.array_contains(
                F.array(*[r[name].isNull() for name in ROOM_REQUIRED]), True
            ),
        ),
        F.lit(False),
    ) | F.coalesce(F.exists(d["amenityIds"], lambda a: a.isNull()), F.lit(False))
    reason = F.coalesce(
        F.when(d.isNull() | d["_bad"].isNotNull(), "malformed"),
        F.when(missing(REQUIRED_TEXT + REQUIRED_NUMBER), "missing field"),
        F.when(null_for_default, "null for a field with a default"),
        F.when(bad_element, "missing field"),
    )
    rooms = F.transform(
        d["roomOptions"],
        lambda r: F.struct(
            r["sharingType"].alias("sharing_type"),
            r["monthlyRent"].alias("monthly_rent"),
            r["securityDeposit"].alias("security_deposit"),
            r["totalBeds"].alias("total_beds"),
            r["availableBeds"].alias("available_beds"),
            F.coalesce(
                F.try_variant_get(r["noticePeriodDays"], "$", "int"), F.lit(DEFAULT_NOTICE_DAYS)
            ).alias("notice_period_days"),
        ),
    )
    values = {name: d[name] for name in OUTPUT}
    values["city"] = F.coalesce(_variant_text(d["city"]), F.lit(DEFAULT_CITY))
    empty_rooms = F.array().cast(
        "array<struct<sharing_type:string,monthly_rent:int,security_deposit:int,"
        "total_beds:int,available_beds:int,notice_period_days:int>>"
    )
    values["roomOptions"] = F.coalesce(rooms, empty_rooms)
    values["amenityIds"] = F.coalesce(d["amenityIds"], F.array().cast("array<int>"))
    return parsed.select(
        *[values[name].alias(alias) for name, alias in OUTPUT.items()], reason.alias("reason")
    )
