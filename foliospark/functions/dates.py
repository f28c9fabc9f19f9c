"""Date functions, Column to Column. Months are English; the date of an offset time is its own wall-clock date."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions.text import strip

_ISO = r"^(\d{4}-\d{2}-\d{2})T\d{2}(:?\d{2}(:?\d{2}([.,]\d+)?)?)?(Z|[+-]\d{2}(:?\d{2})?)?$"
LONG = "MMMM dd, yyyy"


def _iso_date(c: Column) -> Column:
    return F.try_to_timestamp(F.nullif(F.regexp_extract(c, _ISO, 1), F.lit("")), F.lit("yyyy-MM-dd"))


def format_date(c: Column) -> Column:
    """ISO date or time to 'September 29, 2024'; empty to null; what does not parse, stripped."""
    plain = F.try_to_timestamp(F.nullif(F.regexp_extract(c, r"^\d{4}-\d{1,2}-\d{1,2}$", 0), F.lit("")), F.lit("yyyy-M-d"))
    day = F.when(c.contains("T"), _iso_date(c)).otherwise(plain)
    return F.when(c != "", F.coalesce(F.date_format(day, LONG), strip(c)))


def format_iso(content: Column, shown: Column) -> Column:
    """ISO ``content`` in long form, else the text shown."""
    day = F.coalesce(_iso_date(content), F.try_to_timestamp(F.nullif(F.regexp_extract(content, r"^\d{4}-\d{2}-\d{2}$", 0), F.lit("")), F.lit("yyyy-MM-dd")))
    return F.when(F.coalesce(content, F.lit("")) == "", shown).otherwise(F.coalesce(F.date_format(day, LONG), shown))


#: Tried in this order.
FORMATS = (
    (r"^[A-Za-z]+ \d{1,2}, \d{4}$", "MMMM d, yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{1,2} [A-Za-z]+ \d{4}$", "d MMMM yyyy"),
)


def normalize_date(c: Column) -> Column:
    """To 'yyyy-MM-ddTHH:mm:ss'. Empty and null give ''; a time with a '+' offset and whatever does not parse
    come back unchanged, as the time already is in that form."""
    tried = [F.try_to_timestamp(F.nullif(F.regexp_extract(F.initcap(c), shape, 0), F.lit("")), F.lit(form)) for shape, form in FORMATS]
    parsed = F.date_format(F.coalesce(*tried), "yyyy-MM-dd'T'HH:mm:ss")
    timed = c.contains("T") & c.contains("+")
    full = F.regexp_replace(F.regexp_replace(c, r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2})([+-])", "$1:00$2"), r"([+-]\d{2})(\d{2})$", "$1:$2")
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit("")).when(timed, F.when(_iso_date(c).isNotNull(), full).otherwise(c)).otherwise(F.coalesce(parsed, c))


def to_date_lenient(c: Column, form: str = "MMMM d, yyyy") -> Column:
    """Null where it does not parse."""
    return F.to_date(F.try_to_timestamp(c, F.lit(form)))


def to_date_strict(c: Column, form: str = "MMMM d, yyyy") -> Column:
    """An error where it does not parse."""
    return F.to_date(F.to_timestamp(c, form))


def year_of(c: Column, form: str = "MMMM d, yyyy") -> Column:
    return F.year(to_date_lenient(c, form))
