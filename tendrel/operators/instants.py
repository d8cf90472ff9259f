"""Dates and times in many notations, as one UTC instant or one calendar day.

Everything is a Column expression: an ordered cascade of anchored patterns turns the text into one canonical record
`y|m|d|H|M|S|half|zone`, and built-in date functions check and convert it. Nothing leaves the JVM and nothing is
shuffled, so the cost is one pass over the rows.

Policy for local times: a wall time that occurs twice means the first one, one that is skipped moves forward by the
length of the gap. That is how Java's LocalDateTime.atZone, and with it to_utc_timestamp, resolves them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Month names by number in the languages of the sources.
MONTHS = {
    1: "january jan januar janvier janv enero ene gennaio janeiro stycznia styczeń января",
    2: "february feb februar février févr fevrier febrero fevereiro fev lutego luty февраля",
    3: "march mar märz maerz mars marzo março marca marzec марта",
    4: "april apr avril avr abril abr kwietnia kwiecień апреля",
    5: "may mai mayo maio maja maj мая",
    6: "june jun juni juin junio junho czerwca czerwiec июня",
    7: "july jul juli juillet juil julio julho lipca lipiec июля",
    8: "august aug août aout agosto ago sierpnia sierpień августа",
    9: "september sep sept septembre septiembre setembro set września wrzesień сентября",
    10: "october oct oktober okt octobre octubre outubro out października październik октября",
    11: "november nov novembre noviembre novembro listopada listopad ноября",
    12: "december dec dezember dez décembre déc decembre diciembre dic dezembro grudnia grudzień декабря",
}
# Abbreviations that name one offset (minutes east of UTC), whatever the season.
OFFSET_MINUTES = {
    "z": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "eet": 120, "eest": 180,
    "msk": 180, "ist": 330, "brt": -180, "ast": -240, "adt": -180, "est": -300, "edt": -240, "cst": -360, "cdt": -300,
    "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600,
}
# Names of a region's clock that leave standard or summer time open.
CLOCKS = {
    "et": "America/New_York", "eastern": "America/New_York", "ct": "America/Chicago", "central": "America/Chicago",
    "mt": "America/Denver", "mountain": "America/Denver", "pt": "America/Los_Angeles",
    "pacific": "America/Los_Angeles", "akt": "America/Anchorage", "alaska": "America/Anchorage",
    "ht": "Pacific/Honolulu", "hawaii": "Pacific/Honolulu", "hawaiian": "Pacific/Honolulu",
}

_MONTH_OF = {name: n for n, names in MONTHS.items() for name in names.split()}
_NAMES = "|".join(sorted(_MONTH_OF, key=len, reverse=True))
# Weekday names that may stand before a date; they carry no information.
_WEEKDAYS = (
    "monday tuesday wednesday thursday friday saturday sunday mon tue tues wed thu thur thurs fri sat sun "
    "montag dienstag mittwoch donnerstag freitag samstag sonntag lundi mardi mercredi jeudi vendredi samedi dimanche "
    "lunes martes miércoles jueves viernes sábado domingo segunda-feira terça-feira quarta-feira quinta-feira "
    "sexta-feira poniedziałek wtorek środa czwartek piątek sobota niedziela"
)
_WEEKDAY = rf"(?:(?:{'|'.join(_WEEKDAYS.split())})\.?,? )?"
_ORDINAL = r"(?:st|nd|rd|th|er|º|\.)?"
_HALF = r"([ap])\.?m\.?"
_CLOCK24 = r"(\d{1,2})[:.h](\d{2})(?:[:.](\d{2})(?:[.,]\d{1,9})?)?"
# A time of day: 12-hour with its half, else 24-hour; each ends with the zone, if any.
_ZONE = r"(?: ?\(?([+-]\d{2}:?\d{2}|(?:utc|gmt)[+-]\d{1,2}(?::?\d{2})?|\p{L}{1,8}(?: (?:standard |daylight )?time)?)\)?)?"
_TIME12 = r"(\d{1,2})(?:[:.](\d{2}))?(?:[:.](\d{2}))? ?" + _HALF
_GAP = r"(?:,? at |, | à | um | às | a las | o godz\. |,? )"


def _dates() -> list[tuple[str, tuple[str, str, str], str]]:
    """Date notations in order: pattern with three groups, the group of year, month and day, and the kind of order."""
    name = rf"({_NAMES})\.?"
    return [
        (r"(\d{4})-(\d{1,2})-(\d{1,2})", "123", ""),
        (r"(\d{4})/(\d{1,2})/(\d{1,2})", "123", ""),
        (r"(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})", "312", "agency"),
        (r"(\d{1,2})\.(\d{1,2})\.(\d{4}|\d{2})", "321", ""),
        (rf"(\d{{1,2}})-{name}-(\d{{4}}|\d{{2}})", "321", ""),
        (rf"{_WEEKDAY}{name} (\d{{1,2}}){_ORDINAL},? (\d{{4}})", "312", ""),
        (rf"{_WEEKDAY}(\d{{1,2}}){_ORDINAL} (?:de |of )?{name},? (?:de )?(\d{{4}})", "321", ""),
    ]


def _cascade() -> list[tuple[str, str]]:
    """Anchored patterns with the replacement that writes y|m|d|H|M|S|half|zone|order."""
    out = [
        (r"^(\d{4})(\d{2})(\d{2})t(\d{2})(\d{2})(\d{2})?(z)?$", "$1|$2|$3|$4|$5|$6||$7|"),
        (r"^(\d{4})(\d{2})(\d{2})$", "$1|$2|$3||||||"),
    ]
    for pattern, (y, m, d), order in _dates():
        ymd = f"${y}|${m}|${d}"
        out += [
            (rf"^{pattern}$", f"{ymd}||||||{order}"),
            (rf"^{pattern}{_GAP}{_TIME12}{_ZONE}$", f"{ymd}|$4|$5|$6|$7|$8|{order}"),
            (rf"^{pattern}(?:t|{_GAP}){_CLOCK24}(?: ?(?:h|uhr|hrs))?{_ZONE}$", f"{ymd}|$4|$5|$6||$7|{order}"),
            (rf"^{pattern},? (\d{{2}})(\d{{2}}) ?(?:hrs|hours|h|uhr){_ZONE}$", f"{ymd}|$4|$5|||$6|{order}"),
        ]
    for pattern, (y, m, d), order in _dates():
        y, m, d = (int(x) for x in (y, m, d))
        out += [
            (rf"^{_TIME12}{_ZONE} on {pattern}$", f"${5 + y}|${5 + m}|${5 + d}|$1|$2|$3|$4|$5|{order}"),
            (rf"^{_CLOCK24}{_ZONE} on {pattern}$", f"${4 + y}|${4 + m}|${4 + d}|$1|$2|$3||$4|{order}"),
        ]
    return out


def _lookup(values: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: a name in the plan, where plain reuse would copy the expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _canonical(text: Column) -> Column:
    s = F.lower(F.trim(F.regexp_replace(text, r"[\s\u00a0\u2007\u202f]+", " ")))
    return F.trim(F.regexp_replace(s, r"\((?:local time|ortszeit|hora local|heure locale)\)", ""))


def _fields(record: Column) -> Column:
    """Numbers and zone of a canonical record."""
    part = F.split(record, r"\|")

    def text(k: int) -> Column:
        return F.get(part, F.lit(k))

    def number(k: int) -> Column:
        return text(k).try_cast("int")

    return F.struct(
        F.when(F.length(text(0)) == 2, number(0) + 2000).otherwise(number(0)).alias("y"),
        F.coalesce(number(1), _lookup(_MONTH_OF, text(1))).alias("m"),
        number(2).alias("d"),
        (F.coalesce(text(3), F.lit("")) != "").alias("timed"),
        number(3).alias("H"),
        F.coalesce(number(4), F.lit(0)).alias("mi"),
        F.coalesce(number(5), F.lit(0)).alias("S"),
        F.nullif(text(6), F.lit("")).alias("half"),
        F.regexp_replace(F.coalesce(text(7), F.lit("")), r" (?:standard |daylight )?time$", "").alias("zone"),
        (text(8) == "agency").alias("by_agency"),
    )


def _offset_minutes(zone: Column) -> Column:
    def signed(k: int) -> Column:
        return F.regexp_extract(zone, r"^(?:utc|gmt)?([+-])(\d{1,2}):?(\d{2})?$", k)

    minutes = signed(2).try_cast("int") * 60 + F.coalesce(signed(3).try_cast("int"), F.lit(0))
    return F.when(signed(1) == "-", -minutes).when(signed(1) == "+", minutes).otherwise(_lookup(OFFSET_MINUTES, zone))


def _resolved(f: Column, time_zone: Column, date_order: Column) -> Column:
    """struct<utc: long seconds, day: date> of the fields."""
    flip = f["by_agency"] & (date_order == "dmy")
    month = F.when(flip, f["d"]).otherwise(f["m"])
    day = F.when(flip, f["m"]).otherwise(f["d"])
    date = F.try_to_timestamp(F.format_string("%04d-%02d-%02d", f["y"], month, day), F.lit("yyyy-MM-dd")).cast("date")
    date = F.when(f["y"].isNotNull() & month.isNotNull() & day.isNotNull(), date)
    hour = F.when(f["half"].isNull(), f["H"]).when(
        f["H"].between(1, 12), f["H"] % 12 + F.when(f["half"] == "p", 12).otherwise(0)
    )
    valid = hour.between(0, 23) & f["mi"].between(0, 59) & f["S"].between(0, 59)
    wall = F.when(f["timed"] & valid, F.unix_date(date) * F.lit(86400).cast("long") + hour * 3600 + f["mi"] * 60 + f["S"])
    clock = F.when(f["zone"] == "", F.coalesce(time_zone, F.lit("UTC"))).otherwise(_lookup(CLOCKS, f["zone"]))
    by_clock = F.unix_timestamp(F.to_utc_timestamp(F.timestamp_seconds(wall), clock))
    utc = F.coalesce(wall - _offset_minutes(f["zone"]) * 60, by_clock)
    return F.struct(utc.alias("utc"), F.when(~f["timed"], date).alias("day"))


def _stated(s: Column, time_zone: Column, date_order: Column) -> Column:
    record = F.coalesce(*[F.when(s.rlike(p), F.regexp_replace(s, p, to)) for p, to in _cascade()])
    epoch = F.when(s.rlike(r"^\d{10}$"), s.cast("long")).when(s.rlike(r"^\d{13}$"), F.floor(s.cast("long") / 1000))
    by_record = _let(record, lambda r: _let(_fields(r), lambda f: _resolved(f, time_zone, date_order)))
    return F.when(epoch.isNotNull(), F.struct(epoch.alias("utc"), F.lit(None).cast("date").alias("day"))).otherwise(by_record)


def instant(text: Column, time_zone: Column, date_order: Column) -> Column:
    """struct<at: timestamp_ntz, day: date, stated: string> of a text that states a moment or a day.

    `at` is the UTC instant as wall time without zone, `day` the calendar day where no time of day is given, and
    `stated` a text that is equal for equal statements only (`2021-03-09T17:00:00Z` or `2021-03-09`). All are null
    where the text is null, blank or no date, or states an impossible one (February 30, 25:00). `time_zone` is the
    default zone for values without one and `date_order` ('mdy' or 'dmy') decides all-number dates with slashes;
    where they are null, UTC and month first hold.
    """

    def named(r: Column) -> Column:
        at = F.timestamp_seconds(r["utc"])
        day = F.date_format(r["day"], "yyyy-MM-dd")
        return F.struct(
            F.to_timestamp_ntz(F.date_format(at, "yyyy-MM-dd HH:mm:ss")).alias("at"),
            r["day"].alias("day"),
            F.coalesce(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"), day).alias("stated"),
        )

    return _let(_canonical(text), lambda s: _let(_stated(s, time_zone, date_order), named))


def normalise_instants(df: DataFrame, text: str, time_zone: str, date_order: str, out: str = "instant") -> DataFrame:
    """df with the struct column `out` (see `instant`); an existing column of that name is replaced, all others stay."""
    return df.withColumn(out, instant(F.col(text), F.col(time_zone), F.col(date_order)))


def same_statement_pairs(df: DataFrame, group: list[str], key: str, text: str, stated: str) -> DataFrame:
    """Pairs of rows of one group that state the same thing in different words: the group's columns, key_a < key_b.

    Rows with a null in the group or a null statement take no part. Texts that differ are paired first, once each however
    many rows repeat them, and only then joined with their rows: the joins produce exactly the pairs asked for, and a
    group full of equal texts costs nothing. All joins are equi-joins that AQE can split. df is read four times, so it
    should be cheap to read (see `tendrel.session.cut`).
    """
    there = F.col(stated).isNotNull()
    for name in group:
        there &= F.col(name).isNotNull()
    rows = df.where(there).select(*group, F.col(stated).alias("_s"), F.col(key).alias("_k"), F.col(text).alias("_t"))
    same = [*group, "_s"]
    texts = rows.select(*same, "_t").distinct()
    differing = texts.withColumnRenamed("_t", "_ta").join(texts.withColumnRenamed("_t", "_tb"), same).where(F.col("_ta") < F.col("_tb"))
    a = rows.select(*same, F.col("_t").alias("_ta"), F.col("_k").alias("_ka"))
    b = rows.select(*same, F.col("_t").alias("_tb"), F.col("_k").alias("_kb"))
    pairs = differing.join(a, [*same, "_ta"]).join(b, [*same, "_tb"])
    return pairs.select(*group, F.least("_ka", "_kb").alias("key_a"), F.greatest("_ka", "_kb").alias("key_b"))
