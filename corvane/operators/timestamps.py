"""Problem 5: mixed timestamp formats and time zones become one instant in UTC.

Method: an ordered cascade of anchored patterns. The first pattern that matches the whole
text rewrites it to `year|month|day|hour|minute|second|fraction|half|zone`, which is then
parsed strictly. A reading without a zone takes the source's default zone. Policy for local
times: a reading in a repeated hour is its first occurrence, one in a skipped hour moves on
by the skipped time (the rules of to_utc_timestamp). All of it is column expressions, so it
runs inside the scan's stage.
"""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Month names and their usual abbreviations.
MONTHS = {
    "en": "january february march april may june july august september october november december",
    "en_short": "jan feb mar apr may jun jul aug sep oct nov dec",
    "de": "januar februar märz april mai juni juli august september oktober november dezember",
    "de_short": "jan feb mär apr mai jun jul aug sep okt nov dez",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "fr_short": "janv févr mars avr mai juin juil août sept oct nov déc",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    "es_short": "ene feb mar abr may jun jul ago sep oct nov dic",
    "ru": "января февраля марта апреля мая июня июля августа сентября октября ноября декабря",
    "ru_short": "янв фев мар апр мая июн июл авг сен окт ноя дек",
}
# Zone abbreviations and their offsets from UTC in minutes. IST is read as India's.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "UT": 0, "Z": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "IST": 330, "JST": 540, "KST": 540, "AWST": 480, "ACST": 570, "AEST": 600, "AEDT": 660,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
}

_D = r"(\d{4})-(\d{2})-(\d{2})"
_T = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
_ZONE = r"(Z|z|[+-]\d{2}:?\d{2}|[+-]\d{2}|[A-Za-z]+/[A-Za-z_]+(?:/[A-Za-z_]+)?|[A-Z]{2,4})"
_BRACKET = r"(?:\[[A-Za-z_/]+\])?"
_WORD = r"(\p{L}{3,12})\.?"
_WEEKDAY = r"\p{L}{2,10}\.?"

#: Pattern and rewriting, in order. Fields: year, month, day, hour, minute, second, fraction, half of the day, zone.
CASCADE = [
    (rf"^{_D}[T ]{_T} ?{_ZONE}?{_BRACKET}$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    (r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})?(?:[.,](\d{1,9}))?(Z|[+-]\d{2}:?\d{2})?$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    (rf"^{_D}$", "$1|$2|$3||||||"),
    (rf"^(\d{{4}})[/.](\d{{1,2}})[/.](\d{{1,2}})(?:[T ,]+{_T}(?: ?{_ZONE})?)?$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    # 24.10.2025 01:25 is always day first
    (rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}})(?:,? {_T}(?: ?{_ZONE})?)?$", "$3|$2|$1|$4|$5|$6|$7||$8"),
    # Thu, 23 Oct 2025 12:40:40 GMT and 17 Aug 2025 09:14:59 +1000
    (rf"^(?:{_WEEKDAY},? )?(\d{{1,2}})[ -]{_WORD}[ -](\d{{4}}) {_T}(?: {_ZONE})?$", "$3|$2|$1|$4|$5|$6|$7||$8"),
    # Fri Oct 24 03:10:19 GMT 2025
    (rf"^{_WEEKDAY} {_WORD} +(\d{{1,2}}) {_T}(?: {_ZONE})? (\d{{4}})$", "$8|$1|$2|$3|$4|$5|$6||$7"),
    # October 24, 2025, 4:39 am and Oct 24, 2025 5:42 PM EDT
    (rf"^(?:{_WEEKDAY},? )?{_WORD} (\d{{1,2}}),? (\d{{4}})(?:,? (?:at )?{_T}(?: ?([AaPp])\.?[Mm]\.?)?(?: {_ZONE})?)?$", "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    # 29. Oktober 2025, 08:56 Uhr; 28 октября 2025, 07:32; 1 de noviembre de 2024, 03:50
    (rf"^(\d{{1,2}})\.?(?: de)? {_WORD}(?: de)? (\d{{4}})(?:,? {_T}(?: Uhr)?(?: {_ZONE})?)?$", "$3|$2|$1|$4|$5|$6|$7||$8"),
    # 23 octobre 2025 à 21h00
    (rf"^(\d{{1,2}})(?:er)? {_WORD} (\d{{4}}) à (\d{{1,2}}) ?[h:] ?(\d{{2}})$", "$3|$2|$1|$4|$5||||"),
]
#: 10/23/2025 3:46 PM: the order of day and month is the source's.
_SLASH = rf"^(\d{{1,2}})[/-](\d{{1,2}})[/-](\d{{4}})(?:,? {_T}(?: ?([AaPp])\.?[Mm]\.?)?(?: {_ZONE})?)?$"
#: Seconds, milli-, micro- or nanoseconds since 1970, told apart by their digits.
_EPOCH = r"^(\d{9,10})(?:\.(\d{1,9}))?$|^(\d{12,13})$|^(\d{15,16})$|^(\d{18,19})$"
#: Written like 2025-10-26T08:00:00Z.
NORMAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"


def _map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def _epoch_us(text: Column) -> Column:
    digits = F.regexp_extract(text, r"^(\d+)", 1)
    fraction = F.rpad(F.substring(F.regexp_extract(text, r"\.(\d+)$", 1), 1, 6), 6, "0")
    number, length = digits.try_cast("bigint"), F.length(digits)
    return (
        F.when(length <= 10, number * 1_000_000 + F.coalesce(fraction.try_cast("bigint"), F.lit(0)))
        .when(length <= 13, number * 1000)
        .when(length <= 16, number)
        .otherwise(F.call_function("div", number, F.lit(1000)))
    )


def _known_zone(name: Column) -> Column:
    return F.when(name.isin(*sorted(z for z in available_timezones() if "/" in z), "UTC", "GMT"), name)


def _rewritten(text: Column, date_order: Column) -> Column:
    """The fields of the first pattern that matches, or null."""
    (pattern, fields), *rest = CASCADE
    parts = F.when(text.rlike(pattern), F.regexp_replace(text, pattern, fields))
    for pattern, fields in rest:
        parts = parts.when(text.rlike(pattern), F.regexp_replace(text, pattern, fields))
    first, second = (F.regexp_extract(text, _SLASH, i).try_cast("int") for i in (1, 2))
    day_first = F.when(date_order == "DMY", True).when(date_order == "MDY", False).when(first > 12, True).when(second > 12, False)
    slash = F.when(day_first, F.regexp_replace(text, _SLASH, "$3|$2|$1|$4|$5|$6|$7|$8|$9"))
    slash = slash.when(~day_first, F.regexp_replace(text, _SLASH, "$3|$1|$2|$4|$5|$6|$7|$8|$9"))
    return F.split(parts.when(text.rlike(_SLASH), slash), "\\|")


def with_utc_micros(rows: DataFrame, text: str, zone: str, date_order: str, out: str = "utc_us") -> DataFrame:
    """Adds `out`: microseconds since 1970 in UTC that the text denotes, finer digits cut off; null if no instant.

    Column `zone`: IANA name for readings without zone information, null for UTC. Column
    `date_order`: MDY, DMY or YMD for numeric dates with slashes; without one such a date
    counts only where a part above 12 decides. Null, empty and unusable texts, impossible
    dates and times, and unknown months or zones give null. Missing seconds are 0, a date
    alone is the start of that day in its zone, and an offset outranks a zone name behind it.
    """
    # Steps of their own, so that no pattern is evaluated once per field.
    rows = rows.withColumn("_text", F.regexp_replace(F.trim(text), "[\\u00a0\\u202f]", " "))
    rows = rows.withColumn("_p", _rewritten(F.col("_text"), F.col(date_order)))
    field = lambda i: F.nullif(F.col("_p")[i], F.lit(""))
    number = lambda i: F.coalesce(field(i).try_cast("int"), F.lit(0))
    months = _map({name: k + 1 for names in MONTHS.values() for k, name in enumerate(names.split())})
    month = F.coalesce(field(1).try_cast("int"), F.try_element_at(months, F.lower(field(1))))
    half, twelve = F.lower(field(7)), (number(3) >= 1) & (number(3) <= 12)
    hour = F.when(half.isNull(), number(3)).when(twelve, number(3) % 12 + F.when(half == "p", 12).otherwise(0))
    micros = F.rpad(F.substring(F.coalesce(field(6), F.lit("")), 1, 6), 6, "0").try_cast("bigint")
    rows = rows.withColumns({
        "_day": F.unix_date(F.try_make_timestamp_ntz(number(0), month, number(2), F.lit(0), F.lit(0), F.lit(0)).cast("date")).cast("bigint"),
        "_h": hour, "_m": number(4), "_s": number(5), "_us": micros, "_zone": field(8), "_year": number(0),
    })
    in_day = (F.col("_year") >= 1) & (F.col("_h") <= 23) & (F.col("_m") <= 59) & (F.col("_s") <= 59)
    seconds = F.col("_day") * 86400 + F.col("_h") * 3600 + F.col("_m") * 60 + F.col("_s")
    digits, given = F.regexp_replace("_zone", "[^0-9]", ""), F.col("_zone")
    minutes = F.substring(digits, 1, 2).try_cast("int") * 60 + F.coalesce(F.substring(digits, 3, 2).try_cast("int"), F.lit(0))
    minutes = F.when(given.startswith("-"), -minutes).otherwise(minutes)
    offset = F.when(given.rlike("^[+-]"), minutes).when(~given.contains("/"), F.try_element_at(_map(ABBREVIATIONS), F.upper(given)))
    name = F.when(given.isNull(), F.coalesce(F.col(zone), F.lit("UTC"))).when(given.contains("/"), given)
    rows = rows.withColumns({"_local": F.when(in_day, seconds * 1_000_000 + F.col("_us")), "_offset": offset, "_name": _known_zone(name)})
    utc = F.when(F.col("_offset").isNotNull(), F.col("_local") - F.col("_offset").cast("bigint") * 60_000_000).when(
        F.col("_name").isNotNull(), F.unix_micros(F.to_utc_timestamp(F.timestamp_micros("_local"), F.col("_name")))
    )
    utc = F.when(F.col("_text").rlike(_EPOCH), _epoch_us(F.col("_text"))).otherwise(utc)
    helpers = ["_text", "_p", "_day", "_h", "_m", "_s", "_us", "_zone", "_year", "_local", "_offset", "_name"]
    return rows.withColumn(out, utc).drop(*helpers)
