"""Mixed timestamp formats and zones: one normal form for each value.

Parsing is Catalyst expressions only. A value is a date in one of eleven shapes, then optionally a clock time and a
zone. All shapes but one have one reading. All-number dates with the year last have two, day first or month first;
each source is a mixture of the two, whose weights come from expectation-maximisation over the source's values: a value counts
towards a reading in proportion to weight times likelihood, which is 0 where the reading is no date. Only three counts
for each source enter: values valid both ways, day-first only, month-first only.

A declared order is prior evidence, worth ``DECLARED`` times the source's own values, and it rules out the other reading: a value that is
impossible in the declared order is no date. Values valid both ways are read by their posterior. Where that is under ``SURE``
the value is marked ambiguous, and ``other_day`` has the day of the less probable reading.

Normal form: instants ``YYYY-MM-DDTHH:MM:SS.ffffffZ``, days ``YYYY-MM-DD``, months ``YYYY-MM``, years ``YYYY``; digits beyond
microseconds are dropped. Defined cases: null, empty, placeholder, unparsable and impossible values give a null normal
form; an input column named like an output comes out with ``_in`` appended; an unknown zone name or abbreviation gives null; wall times that occur twice are the earlier instant, skipped ones move forward by the gap; very
long texts match no shape; repeated rows are kept. Rows with a null group share one group.
"""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.session import cut, fence, spared

DECLARED, SURE, ROUNDS = 1000.0, 0.9, 40

# Names of the months in the languages of the data, and abbreviations.
MONTHS = {
    1: "january jan januar janvier enero januara januari ocak يناير janv ene oca sij",
    2: "february feb februar février fevrier febrero februara februari şubat subat فبراير févr",
    3: "march mar mars marzo märz maerz mart marta machi مارس mär",
    4: "april apr avril abril aprila aprili nisan أبريل abr avr nis",
    5: "may mai mayo maj maja mei mayıs mayis مايو",
    6: "june jun juin junio juni juna haziran يونيو haz",
    7: "july jul juillet julio juli jula julai temmuz يوليو juil tem",
    8: "august aug août aout agosto augusta agosti ağustos agustos أغسطس ago ağu",
    9: "september sep sept septembre septiembre septembra septemba eylül eylul سبتمبر eyl",
    10: "october oct octobre octubre oktober oktobar oktobra oktoba ekim أكتوبر okt eki",
    11: "november nov novembre noviembre novembar novembra novemba kasım kasim نوفمبر kas",
    12: "december dec décembre decembre diciembre dezember decembar decembra desemba aralık aralik ديسمبر dez dic déc ara",
}
# Minutes east of UTC of the usual zone abbreviations.
ABBREVIATIONS = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "mez": 60, "wat": 60, "cest": 120, "mesz": 120, "eet": 120, "cat": 120, "sast": 120, "eest": 180, "eat": 180, "msk": 180,
    "trt": 180, "ist": 330, "npt": 345, "awst": 480, "hkt": 480, "jst": 540, "kst": 540, "acst": 570, "aest": 600, "acdt": 630, "aedt": 660, "nzst": 720, "nzdt": 780,
    "ast": -240, "adt": -180, "edt": -240, "est": -300, "cdt": -300, "cst": -360, "mdt": -360, "mst": -420, "pdt": -420, "pst": -480, "akdt": -480, "akst": -540, "hst": -600,
}

DAY_MICROS = 86_400_000_000


def _lookup(pairs: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair]), key)


def _int(c: Column) -> Column:
    return F.nullif(c, F.lit("")).try_cast("int")


def _date(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")), "yyyy-MM-dd") 


def clean(value: Column) -> Column:
    """ASCII digits, single spaces, no white space or closing full stop around the value."""
    ascii_digits = F.translate(value, "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹−", "01234567890123456789-")
    one = F.regexp_replace(ascii_digits, r"[\s ‎‏ ]+", " ")
    return F.regexp_replace(F.regexp_replace(one, r"^[ ]+|[ .,;]+$", ""), r"(?i)^(mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,? ", "")


#: Shape, pattern with the rest of the value as last group.
SHAPES = {
    "year_first": r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?!\d)(.*)$",
    "year_last": r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})(?!\d)(.*)$",
    "compact": r"^(\d{4})(\d{2})(\d{2})((?:[tT ].*)?)$",
    "week": r"^(\d{4})-?[wW](\d{2})-?([1-7])()$",
    "ordinal": r"^(\d{4})-(\d{3})()()$",
    "day_name": r"^(\d{1,2})(?:st|nd|rd|th)?\.?[ -](?:de )?(\p{L}+)\.?,?[ -](?:del? )?(\d{4})(?!\d)(.*)$",
    "name_day": r"^(\p{L}+)\.? (\d{1,2})(?:st|nd|rd|th)?,? (\d{4})(?!\d)(.*)$",
    "name_year": r"^(\p{L}+)\.?,?[ -](?:de )?(\d{4})()()$",
    "month_year": r"^(\d{1,2})[-/.](\d{4})()()$",
    "year_month": r"^(\d{4})[-/.](\d{1,2})()()$",
    "year": r"^(\d{4})()()()$",
    "epoch": r"^(\d{10}|\d{13}|\d{16})()()()$",
}
CLOCK = r"(?i)^[t ,]*(\d{1,2}):?(\d{2})(?::?(\d{2})(?:[.,](\d+))?)? ?(?:(am|pm)(?![a-z]))? ?(.*)$"
OFFSET = r"(?i)^(?:utc|gmt)? ?([+-])(\d{1,2})(?::?(\d{2}))?$"


def _mixture(group: Column, order: Column) -> Column:
    """Rows of one source with different declared orders are mixtures of their own."""
    return F.concat(F.coalesce(group.cast("string"), F.lit("")), F.lit("\x1f"), F.coalesce(order, F.lit("")))


def parsed(df: DataFrame, value: str, zone: Column, order: Column, group: Column) -> DataFrame:
    """``df`` with normal_form, precision, posterior, ambiguous and other_day.

    ``zone`` and ``order`` (dmy or mdy) are the declared defaults, null where there are none; ``group`` names the source whose mixture is fitted.
    """
    names = spared(df, ["normal_form", "precision", "posterior", "ambiguous", "other_day"])
    text = F.col("__v")
    x = df.select(F.struct(*[F.col(f"`{c}`").alias(name) for c, name in names.items()]).alias("__row"), clean(F.col(f"`{value}`")).alias("__v"), zone.alias("__zone"), order.alias("__order"), _mixture(group, order).alias("__group"))
    shape = F.lit(None).cast("string")
    for name, pattern in reversed(SHAPES.items()):
        shape = F.when(text.rlike(pattern), F.lit(name)).otherwise(shape)
    x = x.withColumn("__shape", F.when(F.length(text) <= 80, shape))
    part = [F.lit(None).cast("string")] * 4
    for name, pattern in SHAPES.items():
        part = [F.when(F.col("__shape") == name, F.regexp_extract(text, pattern, i + 1)).otherwise(p) for i, p in enumerate(part)]
    x = x.withColumns({f"__p{i}": p for i, p in enumerate(part)})
    s, (a, b, c) = F.col("__shape"), (_int(F.col(f"__p{i}")) for i in range(3))
    month_of = {name: m for m, names in MONTHS.items() for name in names.split()}
    named = _lookup(month_of, F.lower(F.when(s == "day_name", F.col("__p1")).otherwise(F.col("__p0"))))
    # Two readings, alike except for all-number dates with the year last.
    y = F.when(s.isin("year_first", "compact", "year", "year_month", "ordinal", "week"), a).when(s.isin("year_last", "day_name", "name_day"), c).when(s.isin("name_year", "month_year"), b)
    m1 = F.when(s.isin("year_first", "compact", "year_last", "year_month"), b).when(s == "month_year", a).when(s.isin("day_name", "name_day", "name_year"), named)
    d1 = F.when(s.isin("year_first", "compact"), c).when(s.isin("year_last", "day_name"), a).when(s == "name_day", b)
    day1 = (
        F.when(s.isin("year_first", "compact", "year_last", "day_name", "name_day"), _date(y, m1, d1))
        .when((s == "ordinal") & b.between(1, 366), F.when(F.year(F.date_add(F.make_date(y, F.lit(1), F.lit(1)), b - 1)) == y, F.date_add(F.make_date(y, F.lit(1), F.lit(1)), b - 1)))
        .when((s == "week") & b.between(1, 53), _week_day(y, b, c))
    )
    x = x.withColumns({"__y": F.when(y >= 1, y), "__m": F.when(m1.between(1, 12), m1), "__day_first": day1, "__month_first": F.when(s == "year_last", _date(y, a, b))})
    # The parsed parts are read twice, for the fit and for the choice, so they are kept.
    return fence(_normal(_choose(cut(fence(x)))))


def _week_day(y: Column, week: Column, day: Column) -> Column:
    """ISO week date; null where the year has no such week."""
    jan4 = F.make_date(y, F.lit(1), F.lit(4))
    found = F.date_add(F.date_sub(jan4, F.weekday(jan4)), (week - 1) * 7 + day - 1)
    return F.when((week <= 52) | (F.weekofyear(found) == 53), found)


def _orders(x: DataFrame) -> DataFrame:
    """Rows (__group, both, dmy, mdy, declared, weight): the fitted weight of day-first dates in each group."""
    two = F.col("__shape") == "year_last"
    d, m = F.col("__day_first").isNotNull(), F.col("__month_first").isNotNull()
    counts = x.where(two & (d | m)).groupBy("__group").agg(
        F.count_if(d & m).alias("both"), F.count_if(d & ~m).alias("dmy"), F.count_if(~d & m).alias("mdy"), F.max("__order").alias("declared"),
    )
    n = (F.col("both") + F.col("dmy") + F.col("mdy")).cast("double")
    prior_d = 1.0 + F.when(F.col("declared") == "dmy", n * DECLARED).otherwise(F.lit(0.0))
    prior_m = 1.0 + F.when(F.col("declared") == "mdy", n * DECLARED).otherwise(F.lit(0.0))
    # One round: values valid both ways are shared out by the weight (E), then the weight is re-estimated (M).
    weight = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.lit(0.5), lambda w, _: (prior_d + F.col("dmy") + F.col("both") * w) / (prior_d + prior_m + n))
    return counts.select("__group", "both", "dmy", "mdy", "declared", weight.alias("weight"))


def _choose(x: DataFrame) -> DataFrame:
    """Fit the mixture of each group and add __day, posterior, ambiguous and other_day."""
    two = F.col("__shape") == "year_last"
    fitted = _orders(x).select(F.col("__group").alias("__g"), F.col("weight").alias("__w"))
    x = x.join(fitted, F.col("__group").eqNullSafe(F.col("__g")), "left").drop("__g")
    # A declared order rules the other reading out; what is left of the two is weighed.
    d, m = F.col("__day_first").isNotNull() & (F.coalesce("__order", F.lit("dmy")) == "dmy"), F.col("__month_first").isNotNull() & (F.coalesce("__order", F.lit("mdy")) == "mdy")
    w = F.coalesce(F.col("__w"), F.lit(0.5))
    either = F.col("__day_first").isNotNull() & F.col("__month_first").isNotNull()
    first = F.when(either, w >= 0.5).otherwise(d)
    sure = F.when(two & either, F.greatest(w, 1 - w)).otherwise(F.lit(1.0))
    chosen = F.when(first & d, F.col("__day_first")).when(~first & m, F.col("__month_first"))
    ambiguous = two & either & (sure < SURE) & (F.col("__day_first") != F.col("__month_first"))
    return x.withColumns({
        "__day": F.when(two, chosen).otherwise(F.col("__day_first")), "posterior": sure, "ambiguous": ambiguous,
        "other_day": F.when(ambiguous, F.when(first, F.col("__month_first")).otherwise(F.col("__day_first")).cast("string")),
    })


def fitted_orders(df: DataFrame, value: str, order: Column, group: Column) -> DataFrame:
    """Rows (source, both, dmy, mdy, declared, weight): values valid both ways, day-first only and month-first only, and the fitted weight of day first."""
    text = clean(F.col(f"`{value}`"))
    x = fence(df.select(text.alias("__v"), order.alias("__order"), group.cast("string").alias("__group")))
    x = x.where(F.col("__v").rlike(SHAPES["year_last"]) & (F.length("__v") <= 80))
    a, b, c = (_int(F.regexp_extract("__v", SHAPES["year_last"], i)) for i in (1, 2, 3))
    x = fence(x.select("__group", "__order", F.lit("year_last").alias("__shape"), _date(F.when(c >= 1, c), b, a).alias("__day_first"), _date(F.when(c >= 1, c), a, b).alias("__month_first")))
    return _orders(x).withColumnRenamed("__group", "source")


def _instant_text() -> Column:
    """Text of __micros, microseconds since 1970 in UTC, whatever the session's zone."""
    days = F.expr("__micros div 86400000000 - case when __micros % 86400000000 < 0 then 1 else 0 end")
    of_day = F.expr("pmod(__micros, 86400000000)")
    two = lambda unit, span: F.lpad(((of_day / unit).cast("long") % span).cast("string"), 2, "0")
    date = F.date_from_unix_date(days.cast("int")).cast("string")
    return F.concat(date, F.lit("T"), two(3_600_000_000, 24), F.lit(":"), two(60_000_000, 60), F.lit(":"), two(1_000_000, 60), F.lit("."), F.lpad((of_day % 1_000_000).cast("string"), 6, "0"), F.lit("Z"))


def _normal(x: DataFrame) -> DataFrame:
    s, day = F.col("__shape"), F.col("__day")
    group = lambda i: F.regexp_extract(F.col("__p3"), CLOCK, i)
    x = x.withColumns({"__clock": F.col("__p3").rlike(CLOCK), "__h": _int(group(1)), "__min": _int(group(2)), "__s": F.coalesce(_int(group(3)), F.lit(0)), "__us": F.coalesce(_int(F.rpad(F.nullif(F.substring(group(4), 1, 6), F.lit("")), 6, "0")), F.lit(0)), "__half": F.lower(group(5)), "__named": F.regexp_replace(group(6), r"^\[|\]$", "")})
    h, half, named = F.col("__h"), F.col("__half"), F.col("__named")
    hour = F.when(half == "", h).when(h.between(1, 12), h % 12 + F.when(half == "pm", F.lit(12)).otherwise(F.lit(0)))
    valid = hour.between(0, 23) & F.col("__min").between(0, 59) & F.col("__s").between(0, 59)
    part = lambda i: F.regexp_extract(named, OFFSET, i)
    minutes = F.coalesce(_int(part(2)), F.lit(0)) * 60 + F.coalesce(_int(part(3)), F.lit(0))
    offset = F.when(named.rlike(OFFSET), F.when(part(1) == "-", -minutes).otherwise(minutes)).otherwise(_lookup(ABBREVIATIONS, F.lower(named)))
    known = sorted(z for z in available_timezones() if "/" in z or z == "UTC")
    iana = F.when(named == "", F.coalesce(F.col("__zone"), F.lit("UTC"))).when(named.isin(known), named)
    wall = F.unix_date(day).cast("long") * F.lit(DAY_MICROS) + (hour * 3600 + F.col("__min") * 60 + F.col("__s")).cast("long") * 1_000_000 + F.col("__us")
    x = x.withColumns({"__wall": F.when(F.col("__clock") & valid & day.isNotNull(), wall), "__offset": offset, "__iana": iana})
    zoned = F.when(F.col("__iana").isNotNull(), F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(F.col("__wall")), F.col("__iana"))))
    number = F.col("__p0").try_cast("long")
    epoch = F.when(F.length("__p0") == 10, number * 1_000_000).when(F.length("__p0") == 13, number * 1000).otherwise(number)
    x = x.withColumn("__micros", F.when(s == "epoch", epoch).when(F.col("__offset").isNotNull(), F.col("__wall") - F.col("__offset").cast("long") * 60_000_000).otherwise(zoned))
    month = F.concat(F.lpad(F.col("__y").cast("string"), 4, "0"), F.lit("-"), F.lpad(F.col("__m").cast("string"), 2, "0"))
    precision = F.when((s == "epoch") | (F.col("__p3") != ""), F.lit("instant")).when(s.isin("name_year", "month_year", "year_month"), F.lit("month")).when(s == "year", F.lit("year")).when(s.isNotNull(), F.lit("day"))
    form = F.when(precision == "instant", _instant_text()).when(precision == "month", month).when(precision == "year", F.lpad(F.col("__y").cast("string"), 4, "0")).when(precision == "day", day.cast("string"))
    return x.withColumn("normal_form", form).withColumn("precision", F.when(form.isNotNull(), precision)).select("__row.*", "normal_form", "precision", "posterior", "ambiguous", F.when(form.isNotNull(), F.col("other_day")).alias("other_day"))
