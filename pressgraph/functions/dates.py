"""Free date text to timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pressgraph.functions.binding import let

# Tried in order; the first that reads the whole text wins.
DATE_FORMATS = [
    "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ssXX",
    "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mmXXX", "yyyy-MM-dd'T'HH:mm",
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy/M/d HH:mm:ss", "yyyy/M/d",
    "yyyy-M-d", "yyyy.M.d", "yyyyMMdd", "d MMM yyyy", "d MMMM yyyy", "MMM d yyyy", "MMMM d yyyy",
    "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy HH:mm:ss", "d MMM yyyy HH:mm:ss XX",
    "MMMM d, yyyy h:mm a", "MMM d, yyyy h:mm a", "M/d/yyyy", "yyyy-MMM-d", "yyyy/MMM/d",
]

# Month names and their short forms in English, French, German and Spanish.
MONTH_NAMES = (
    "january jan janvier janv januar jänner jän enero ene",
    "february feb février fevrier févr fév februar febrero",
    "march mar mars märz maerz mrz marzo",
    "april apr avril avr abril abr",
    "may mai mayo",
    "june jun juin juni junio",
    "july jul juillet juil juli julio",
    "august aug août aout agosto ago",
    "september sept sep septembre septiembre",
    "october oct octobre oktober okt octubre",
    "november nov novembre noviembre",
    "december dec décembre déc dezember dez diciembre dic",
)

# Zone words with one offset; words that name several zones are left out.
ZONE_OFFSETS = {
    "z": "+00:00", "gmt": "+00:00", "utc": "+00:00", "wet": "+00:00", "west": "+01:00", "bst": "+01:00",
    "cet": "+01:00", "cest": "+02:00", "eet": "+02:00", "eest": "+03:00", "msk": "+03:00", "jst": "+09:00",
    "aest": "+10:00", "aedt": "+11:00", "est": "-05:00", "edt": "-04:00", "cst": "-06:00", "cdt": "-05:00",
    "mst": "-07:00", "mdt": "-06:00", "pst": "-08:00", "pdt": "-07:00",
}

_WEEKDAY = (
    r"(?:mon|tues?|wed(?:nes)?|thu(?:rs?)?|fri|sat(?:ur)?|sun)(?:day)?|lun|mar(?=\.?,? \d{1,2}\.? \p{L})|mer|jeu|ven|sam|dim|"
    r"(?:lun|mar|mercre|jeu|vendre|same)di|dimanche|mo|di|mi|do|fr|sa|so|(?:mon|diens|donners|frei|sams|sonn)tag|mittwoch|"
    r"sonnabend|lunes|martes|mi[ée]rcoles|jueves|viernes|s[áa]bado|domingo"
)
# Day, month word and year or month word, day and year or numbers; then a time; then a zone.  One group for each part.
_WORDED = (
    r"^(?:(\d{1,2})\.? (\p{L}+)\.?,? (\d{4})|(\p{L}+)\.? (\d{1,2}),? (\d{4})|(\d{4})-(\d{1,2})-(\d{1,2})|(\d{1,2})\.(\d{1,2})\.(\d{4}))"
    r"(?:(?:,? |t)(\d{1,2})(?=:| ?h| ?[ap]\.?m| uhr)(?:(?::| ?h ?)(\d{2})(?::(\d{2})(?:\.\d+)?)?)?(?: ?([ap])\.?m\.?)?(?: uhr)?"
    r"(?: ?\(?(?:(?:gmt|utc)?([+-]\d{1,2}):?(\d{2})?|(\p{L}{1,4}))\)?)?)?$"
)


def worded_date(t: Column) -> Column:
    """Timestamp of a date with month words of four languages, ordinals, a time and a zone word or offset.

    NULL for other texts, for unknown month or zone words and for days or times that do not exist.
    """
    s = F.lower(F.regexp_replace(t, r"[\s\u00a0]+", " "))
    s = F.regexp_replace(s, rf"^ ?(?:(?:{_WEEKDAY})\.?,? )?(?:(?:the|le|el|der|den|am) )?| $", "")
    s = F.regexp_replace(s, r"\b(\d{1,2})(?:st|nd|rd|th|er|º|ª)(?=[ ,])", "$1")
    s = F.regexp_replace(s, r",? (?:of|de|del|at|um|à|a las|-|–|\|) ", " ")
    parts = F.when(s.rlike(_WORDED), F.split(F.regexp_replace(
        s, _WORDED, "$1$5$9$10|$2$4$8$11|$3$6$7$12|$13|$14|$15|$16|$17|$18|$19"), r"\|"))

    def read(p: Column) -> Column:
        def number(i: int) -> Column:
            return F.coalesce(F.nullif(F.get(p, i), F.lit("")).try_cast("int"), F.lit(0))

        word, half, zone = F.get(p, 1), F.get(p, 6), F.get(p, 9)
        month = number(1)
        for i, names in enumerate(MONTH_NAMES):
            month = F.when(word.isin(names.split()), i + 1).otherwise(month)
        hour = F.when(half == "", number(3)).when(number(3).between(1, 12), number(3) % 12 + F.when(half == "p", 12).otherwise(0))
        offset = F.when(zone.isin(list(ZONE_OFFSETS)), F.element_at(
            F.create_map(*[F.lit(x) for pair in ZONE_OFFSETS.items() for x in pair]), zone))
        signed = F.concat(F.substr(F.get(p, 7), F.lit(1), F.lit(1)), F.lpad(F.substr(F.get(p, 7), F.lit(2)), 2, "0"), F.lit(":"),
                          F.coalesce(F.nullif(F.get(p, 8), F.lit("")), F.lit("00")))
        fields = number(2), month, number(0), hour, number(4), number(5)
        return (
            F.when((F.get(p, 7) == "") & (zone == ""), F.try_make_timestamp(*fields))
            .when(zone == "", F.try_make_timestamp(*fields, signed))
            .otherwise(F.try_make_timestamp(*fields, offset)))

    return let(parts, read)


def parse_dates(texts: Column) -> Column:
    """Timestamps of an array of date texts, NULL where no format reads one."""

    def one(t: Column) -> Column:
        tries = [F.try_to_timestamp(t, F.lit(f)) for f in DATE_FORMATS]
        return F.when(F.length(t) >= 6, F.coalesce(*tries, worded_date(t)))

    # Weekday names, zone words and edge separators carry no information.
    tidy = F.transform(texts, lambda t: F.regexp_replace(F.regexp_replace(
        t, r"^[./\-_\s]+|[./\-_\s]+$|(?i)^\s*(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)"
           r"(?:day)?,?\s+|\s*(?:gmt|utc)$", ""), "_", "-"))
    return F.transform(tidy, one)


def parse_date(text: Column | str) -> Column:
    """Timestamp of a date text, NULL when no format reads it."""
    t = F.col(text) if isinstance(text, str) else text
    return F.get(parse_dates(F.array(t)), 0)
