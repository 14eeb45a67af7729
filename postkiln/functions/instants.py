"""Times written in many habits, read as one instant: an ordered cascade of anchored patterns over native expressions.

Each pattern rewrites a text that it matches as a whole to ``y|mo|d|h|mi|s|fraction|half|zone|region|word``; texts that no
pattern matches, or whose fields do not exist in the calendar, name no instant. A text with an offset or a zone abbreviation
is that instant. All others are wall-clock times in the region written in brackets or else in the default zone; a wall-clock
time that occurs twice or never follows the stated policy.
"""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of the months in English, Russian, German and Portuguese, as prefixes that tell them apart.
MONTHS = {
    1: ["january", "jan", "января", "январь", "янв", "januar", "jän", "janeiro"],
    2: ["february", "feb", "февраля", "февраль", "фев", "февр", "februar", "fevereiro", "fev"],
    3: ["march", "mar", "марта", "март", "мар", "märz", "mär", "mrz", "março"],
    4: ["april", "apr", "апреля", "апрель", "апр", "abril", "abr"],
    5: ["may", "мая", "май", "mai", "maio"],
    6: ["june", "jun", "июня", "июнь", "июн", "juni", "junho"],
    7: ["july", "jul", "июля", "июль", "июл", "juli", "julho"],
    8: ["august", "aug", "августа", "август", "авг", "agosto", "ago"],
    9: ["september", "sep", "sept", "сентября", "сентябрь", "сен", "сент", "setembro", "set"],
    10: ["october", "oct", "октября", "октябрь", "окт", "oktober", "okt", "outubro", "out"],
    11: ["november", "nov", "ноября", "ноябрь", "ноя", "нояб", "novembro"],
    12: ["december", "dec", "декабря", "декабрь", "дек", "dezember", "dez", "dezembro"],
}
# Words for a day, as days after the base date.
DAY_WORDS = {
    "today": 0, "heute": 0, "сегодня": 0, "hoje": 0,
    "tomorrow": 1, "morgen": 1, "завтра": 1, "amanhã": 1,
    "yesterday": -1, "gestern": -1, "вчера": -1, "ontem": -1,
    "day after tomorrow": 2, "the day after tomorrow": 2, "übermorgen": 2, "послезавтра": 2, "depois de amanhã": 2,
    "day before yesterday": -2, "the day before yesterday": -2, "vorgestern": -2, "позавчера": -2, "anteontem": -2,
}
# Zone abbreviations with one usual meaning, in minutes east of UTC.
ABBREVIATIONS = {
    "z": 0, "ut": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "mez": 60, "mesz": 120,
    "eet": 120, "eest": 180, "msk": 180, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360,
    "pst": -480, "pdt": -420, "nst": -210, "ndt": -150, "brt": -180, "jst": 540, "aest": 600, "aedt": 660, "yekt": 300,
}
#: Countries that write the month first, and languages that write the year first.
MONTH_FIRST, YEAR_FIRST = ("US",), ("ja", "zh", "ko", "hu")

_MON = "|".join(sorted({m for names in MONTHS.values() for m in names}, key=lambda m: (-len(m), m)))
_WORD = "|".join(sorted(DAY_WORDS, key=lambda w: (-len(w), w)))
_ZONE = r"(?: ?((?:utc|gmt|ut)?[+-]\d{1,2}(?::?\d{2})?|[a-z]{1,4}))?"
_REGION = r"(?: ?\[([a-z]+(?:[/_+-][a-z0-9]+)*)\])?"
_COMMENT = r"(?: ?\([\p{L} ./_+-]*\))?"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,12}))?)?(?: (?:uhr|ч\.?|h))?(?: ?([ap])\.?m\.?)?"
_FLAGS = "(?iu)^"

#: Order matters only where two patterns match one text; digits alone come first, words last.
PATTERNS: list[tuple[str, str]] = [
    (r"(\d{4})-(\d{1,2})-(\d{1,2})(?:(?:t| |, )" + _CLOCK + _ZONE + _REGION + ")?", "$1|$2|$3|$4|$5|$6|$7|$8|$9|$10|"),
    (r"(?:\p{L}{2,12}\.?, ?)?(\d{1,2})\.? (?:de )?(" + _MON + r")\.?,? (?:de )?(\d{4}|\d{2})(?: ?г\.?| года)?(?:(?:,| at| um| в| às| as| on)? " + _CLOCK + _ZONE + _REGION + _COMMENT + ")?", "$3|$2|$1|$4|$5|$6|$7|$8|$9|$10|"),
    (r"(?:\p{L}{2,12}\.?, ?)?(" + _MON + r")\.? (\d{1,2})(?:st|nd|rd|th)?,? (\d{4})(?:(?:,| at)? " + _CLOCK + _ZONE + _REGION + _COMMENT + ")?", "$3|$1|$2|$4|$5|$6|$7|$8|$9|$10|"),
    (r"(\d{4})(\d{2})(\d{2})(?:t? ?(\d{2})(\d{2})(\d{2})?(?:[.,](\d{1,12}))?(z|[+-]\d{2}:?\d{2})?)?", "$1|$2|$3|$4|$5|$6|$7||$8||"),
    (r"(\d{4})/(\d{1,2})/(\d{1,2})(?:(?:,)? " + _CLOCK + _ZONE + _REGION + ")?", "$1|$2|$3|$4|$5|$6|$7|$8|$9|$10|"),
    (r"(\d{1,2})([./-])(\d{1,2})\2(\d{4}|\d{2})(?:,? " + _CLOCK + _ZONE + _REGION + ")?", "$1|$3|$4|$5|$6|$7|$8|$9|$10|$11|@"),
    (r"(" + _WORD + r")(?:(?:,| at| um| в| às)? " + _CLOCK + _ZONE + ")?", "|||$2|$3|$4|$5|$6|$7||$1"),
]


def tidy(text: Column) -> Column:
    """The text without surrounding white space, with plain spaces (one at a time) and the plain minus sign."""
    plain = F.translate(text, "   \t\r\n−–", "      --")
    return F.trim(F.regexp_replace(plain, " {2,}", " "))


def _lookup(pairs: dict[str, int]) -> Column:
    return F.expr("map(" + ", ".join(f"'{k}', {v}" for k, v in pairs.items()) + ")")


def offset_us(utc_us: Column, zone: Column) -> Column:
    """Microseconds that the clocks of zone are ahead of UTC at an instant."""
    t = F.timestamp_micros(utc_us)
    return F.unix_micros(F.from_utc_timestamp(t, zone)) - utc_us


def with_instant(df: DataFrame, text: Column, zone: Column, locale: Column, base_date: Column | None = None, name: str = "utc_us", ambiguous: str = "null", nonexistent: str = "null") -> DataFrame:
    """df with ``name``: the UTC instant, in microseconds since 1970, that ``text`` names; null where it names none.

    zone: default zone of wall-clock times (null or unknown: such times name no instant). locale: order of all-digit dates.
    base_date: the day that words for a day count from; without it they name nothing. Digits beyond microseconds are dropped,
    unwritten parts of the time are zero, two-digit years are 20xx. Null and empty texts name nothing.

    ambiguous: 'null', 'earlier' or 'later' for a wall-clock time that occurs twice; nonexistent: 'null', 'shift_forward' or
    'shift_backward' (by the length of the gap) for one that never occurs. Offsets of the day before and the day after are
    tried, so two changes of a zone's offset must be two days apart.

    The steps are projections of their own, so that each value is computed once; all of them run in one generated stage.
    """
    null = F.lit(None).cast("bigint")
    df = df.withColumns({"_i_t": tidy(text), "_i_zone": zone, "_i_locale": locale, "_i_base": F.to_date(base_date) if base_date is not None else F.lit(None).cast("date")})
    t = F.col("_i_t")
    matches = [(F.lit(_FLAGS + pattern + "$"), to) for pattern, to in PATTERNS]
    df = df.withColumn("_i_r", F.coalesce(*[F.when(F.regexp_like(t, p), F.regexp_replace(t, p, F.lit(to))) for p, to in matches]))
    df = df.withColumn("_i_f", F.split("_i_r", r"\|"))
    at = lambda i: F.nullif(F.get(F.col("_i_f"), F.lit(i)), F.lit(""))
    df = df.withColumns({f"_i_{k}": at(i) for i, k in enumerate(("a", "b", "c", "h", "mi", "s", "frac", "half", "z", "region", "mark"))})
    a, b, c, mark = F.col("_i_a"), F.col("_i_b"), F.col("_i_c"), F.col("_i_mark")
    df = df.withColumns({
        "_i_num": F.coalesce(mark == "@", F.lit(False)),
        "_i_yf": F.coalesce(F.lower(F.substring_index("_i_locale", "_", 1)).isin(*YEAR_FIRST), F.lit(False)) & (F.length(c) <= 2),
        "_i_mf": F.coalesce(F.upper(F.substring_index("_i_locale", "_", -1)).isin(*MONTH_FIRST), F.lit(False)),
    })
    num, year_first, month_first = F.col("_i_num"), F.col("_i_yf"), F.col("_i_mf")
    # an all-digit date without its year in front is day-first unless the locale says otherwise; without a locale it says nothing
    df = df.withColumns({
        "_i_y": F.when(num & F.col("_i_locale").isNull(), None).when(num & ~year_first, c).otherwise(a),
        "_i_m": F.when(num & ~year_first & month_first, a).otherwise(b),
        "_i_d": F.when(num & ~year_first, F.when(month_first, b).otherwise(a)).otherwise(c),
        "_i_shift": F.try_element_at(_lookup(DAY_WORDS), F.lower(F.when(~num, mark))),
    })
    base = F.date_add(F.col("_i_base"), F.col("_i_shift"))
    year = F.when(F.length("_i_y") <= 2, F.col("_i_y").try_cast("int") + 2000).otherwise(F.col("_i_y").try_cast("int"))
    month = F.coalesce(F.col("_i_m").try_cast("int"), F.try_element_at(_lookup({name: n for n, names in MONTHS.items() for name in names}), F.lower("_i_m")))
    df = df.withColumn("_i_date", base)
    df = df.withColumns({"_i_y": year, "_i_m": month, "_i_d": F.col("_i_d").try_cast("int"), "_i_half": F.lower("_i_half"), "_i_h": F.coalesce(F.col("_i_h").try_cast("int"), F.lit(0)), "_i_mi": F.coalesce(F.col("_i_mi").try_cast("int"), F.lit(0)), "_i_s": F.coalesce(F.col("_i_s").try_cast("int"), F.lit(0))})
    y, m, d, h, half = F.col("_i_y"), F.col("_i_m"), F.col("_i_d"), F.col("_i_h"), F.col("_i_half")
    last_day = F.when(m.isin(4, 6, 9, 11), 30).when(m == 2, F.when((y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0)), 29).otherwise(28)).otherwise(31)
    real_date = F.when(m.between(1, 12) & (d >= 1) & (d <= last_day) & y.between(1, 9999), F.make_date(y, m, d))
    good = F.when(half.isNotNull(), h.between(1, 12)).otherwise(h <= 23) & (F.col("_i_mi") <= 59) & (F.col("_i_s") <= 59)
    hour24 = F.when(half == "p", h % 12 + 12).when(half == "a", h % 12).otherwise(h)
    clock = F.when(good, ((hour24 * 60 + F.col("_i_mi")) * 60 + F.col("_i_s")).cast("bigint") * 1_000_000)
    fraction = F.coalesce(F.rpad(F.substring("_i_frac", 1, 6), 6, "0").try_cast("bigint"), F.lit(0).cast("bigint"))
    df = df.withColumn("_i_date", F.coalesce("_i_date", real_date))
    df = df.withColumns({
        "_i_local": F.unix_date("_i_date").cast("bigint") * 86_400_000_000 + clock + fraction,
        "_i_z": F.lower("_i_z"),
        "_i_off": F.regexp_replace(F.lower("_i_z"), "^(utc|gmt|ut)(?=[+-])", ""),
    })
    off, local = F.col("_i_off"), F.col("_i_local")
    df = df.withColumn("_i_digits", F.regexp_replace(off, "[^0-9]", ""))
    digits = F.col("_i_digits")
    hours = F.when(F.length(digits) <= 2, digits).otherwise(F.substring(digits, F.lit(1), F.length(digits) - 2)).try_cast("int")
    minutes = F.when(F.length(digits) <= 2, F.lit(0)).otherwise(F.right(digits, F.lit(2)).try_cast("int"))
    df = df.withColumns({"_i_oh": hours, "_i_om": minutes})
    signed = F.when((F.col("_i_oh") <= 15) & (F.col("_i_om") <= 59), (F.col("_i_oh") * 60 + F.col("_i_om")) * F.when(off.startswith("-"), -1).otherwise(1))
    known = ", ".join(f"'{z.lower()}'" for z in sorted(zoneinfo.available_timezones()) if "/" in z or z == "UTC")
    region = F.coalesce("_i_region", "_i_zone")
    df = df.withColumns({
        "_i_minutes": F.when(off.rlike("^[+-]"), signed).otherwise(F.try_element_at(_lookup(ABBREVIATIONS), off)),
        "_i_region": F.when(F.expr(f"lower(coalesce(_i_region, _i_zone)) IN ({known})"), region),
    })
    # wall-clock time: only where there is neither an offset nor an abbreviation
    walled = F.when(F.col("_i_z").isNull(), local)
    day = F.lit(86_400_000_000)
    df = df.withColumn("_i_wall", walled)
    wall, where = F.col("_i_wall"), F.col("_i_region")
    df = df.withColumns({"_i_o1": offset_us(wall - day, where), "_i_o2": offset_us(wall + day, where)})
    df = df.withColumns({"_i_u1": wall - F.col("_i_o1"), "_i_u2": wall - F.col("_i_o2")})
    u1, u2 = F.col("_i_u1"), F.col("_i_u2")
    changed = F.col("_i_o1") != F.col("_i_o2")
    df = df.withColumns({"_i_ok1": F.when(changed, offset_us(u1, where) == F.col("_i_o1")), "_i_ok2": F.when(changed, offset_us(u2, where) == F.col("_i_o2"))})
    ok1, ok2 = F.col("_i_ok1"), F.col("_i_ok2")
    twice = {"null": null, "earlier": F.least(u1, u2), "later": F.greatest(u1, u2)}[ambiguous]
    never = {"null": null, "shift_forward": F.greatest(u1, u2), "shift_backward": F.least(u1, u2)}[nonexistent]
    from_wall = F.when(~changed, u1).when(ok1 & ok2, twice).when(ok1, u1).when(ok2, u2).when(changed, never)
    # all digits: seconds, milliseconds, microseconds or nanoseconds since 1970
    number = F.when(t.rlike(r"^\d{10}$|^\d{13}$|^\d{16}$|^\d{19}$"), t.try_cast("bigint"))
    df = df.withColumn("_i_n", number)
    n = F.col("_i_n")
    epoch = F.when(F.length(t) == 10, n * 1_000_000).when(F.length(t) == 13, n * 1000).when(F.length(t) == 16, n).otherwise(F.floor(n / 1000).cast("bigint"))
    result = F.when(n.isNotNull(), epoch).when(F.col("_i_z").isNotNull(), local - F.col("_i_minutes").cast("bigint") * 60_000_000).otherwise(from_wall)
    # one generated row per row: a later filter on the instant stays above it, else the optimizer would write every step above out in the filter
    kept = [x for x in df.columns if not x.startswith("_i_") and x != name]
    return df.select(*kept, result.alias("_i_result")).select(*kept, F.explode(F.array("_i_result")).alias(name))
