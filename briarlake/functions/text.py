"""Column expressions over text: tokens, sets, dates, domains."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from briarlake.functions import fixed

WORD = r"[\p{L}\p{N}_]+"


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _texts(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def all_words(x) -> Column:
    """Lower-case word tokens in order, repeats included."""
    return F.regexp_extract_all(F.lower(_col(x)), F.lit(WORD), F.lit(0))


def tokens(x) -> Column:
    """Distinct lower-case word tokens."""
    return F.array_distinct(all_words(x))


def word_count(x) -> Column:
    return F.size(F.filter(F.split(_col(x), r"(?U)\s+"), lambda t: t != ""))


def strip(x) -> Column:
    return F.regexp_replace(_col(x), r"(?U)^\s+|\s+$", "")


def ratio(a, b) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def jaccard(a, b) -> Column:
    """Similarity of two token arrays; 0 when both are empty."""
    a, b = _col(a), _col(b)
    return ratio(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def content_tokens(x, stopwords=fixed.STOPWORDS) -> Column:
    return F.filter(tokens(x), lambda t: (F.length(t) > 2) & ~t.isin(*stopwords))


def entities(x) -> Column:
    """Capitalised names, lower-cased, without their dots at either end and without generic ones."""
    found = F.regexp_extract_all(_col(x), F.lit(r"\b[A-Z][a-zA-Z&.]{2,}\b"), F.lit(0))
    names = F.transform(found, lambda t: F.regexp_replace(F.lower(t), r"^\.+|\.+$", ""))
    return F.array_except(F.array_distinct(names), _texts(fixed.GENERIC_NAMES))


def contains_any(x, phrases) -> Column:
    """Whether the lower-cased text holds one of the phrases, anywhere."""
    return F.lower(_col(x)).rlike("|".join(re.escape(p) for p in phrases))


def actions(x) -> Column:
    """Numbers of the verb families that the text names."""
    return F.array_compact(F.array(*[F.when(contains_any(x, stems), F.lit(i)) for i, stems in enumerate(fixed.ACTION_STEMS)]))


def same_event(tokens_a, tokens_b, entities_a, entities_b, actions_a, actions_b, threshold: float = 0.45) -> Column:
    """Whether two texts, given their content tokens, names and verb families, tell of one event."""
    alike = jaccard(tokens_a, tokens_b) >= threshold
    named = F.arrays_overlap(_col(entities_a), _col(entities_b)) & F.arrays_overlap(_col(actions_a), _col(actions_b))
    return (F.size(_col(tokens_a)) > 0) & (F.size(_col(tokens_b)) > 0) & (alike | F.coalesce(named, F.lit(False)))


def host(url) -> Column:
    """The host (with port) of a URL, without www."""
    return F.replace(F.regexp_extract(F.lower(_col(url)), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1), F.lit("www."), F.lit(""))


def is_price_title(title) -> Column:
    return F.coalesce(_col(title), F.lit("")).rlike("(?iU)" + "|".join(fixed.PRICE_TITLE_PATTERNS))


def is_english(language) -> Column:
    language = F.coalesce(_col(language), F.lit(""))
    return (language == "") | F.lower(language).startswith("eng")


def domain_suffixes(domain) -> Column:
    """The domain and all its dot-suffixes, lower-case, every www. removed."""
    parts = F.split(F.replace(F.lower(F.coalesce(_col(domain), F.lit(""))), F.lit("www."), F.lit("")), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def is_quality_outlet(domain) -> Column:
    return F.arrays_overlap(domain_suffixes(domain), _texts(fixed.QUALITY_DOMAINS))


def parse_event_date(x) -> Column:
    """Dates as YYYY-MM-DD at the start, YYYYMMDD at the start, else the first such digits anywhere; null otherwise."""
    x = _col(x)
    found = lambda g: F.regexp_extract(x, r"(\d{4})-?(\d{2})-?(\d{2})", g)
    anywhere = F.try_to_date(F.concat_ws("-", found(1), found(2), found(3)), "yyyy-MM-dd")
    head = F.when(F.substring(x, 1, 10).rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(F.substring(x, 1, 10), "yyyy-M-d"))
    plain = F.when(F.substring(x, 1, 8).rlike(r"^\d{8}$"), F.try_to_date(F.substring(x, 1, 8), "yyyyMMdd"))
    return F.coalesce(head, plain, F.when(found(1) != "", anywhere))


def parse_reported_date(x, as_of) -> Column:
    """`N units ago` counted back from as_of, or one of five absolute formats; null otherwise."""
    x = F.lower(F.trim(_col(x)))
    number = F.regexp_extract(x, r"^(\d{1,6})\s+(minute|hour|day|week|month|year)s?\s+ago", 1)
    unit = F.regexp_extract(x, r"^(\d{1,6})\s+(minute|hour|day|week|month|year)s?\s+ago", 2)
    days = F.when(unit.isin("minute", "hour"), 0).when(unit == "day", 1).when(unit == "week", 7).when(unit == "month", 30).otherwise(365)
    ago = F.when(number != "", F.date_sub(_col(as_of), F.try_multiply(number.try_cast("int"), days).cast("int")))
    title = F.initcap(x)
    shapes = [("MMM d, yyyy", r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$"), ("MMMM d, yyyy", r"^[A-Z][a-z]+ \d{1,2}, \d{4}$"), ("yyyy-M-d", r"^\d{4}-\d{1,2}-\d{1,2}$"),
              ("d MMM yyyy", r"^\d{1,2} [A-Z][a-z]{2} \d{4}$"), ("M/d/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$")]
    return F.coalesce(ago, *[F.when(title.rlike(shape), F.try_to_date(title, fmt)) for fmt, shape in shapes])


def month_distance(a, b) -> Column:
    gap = F.abs(_col(a) - _col(b))
    return F.least(gap, 12 - gap)


def date_marks(x) -> Column:
    """The years, full dates and months (by number) that a text names."""
    x = _col(x)
    years = F.regexp_extract_all(x, F.lit(r"(?U)\b((?:19|20)\d{2})\b"), F.lit(1))
    dates = F.regexp_extract_all(x, F.lit(r"(?U)\b(\d{4}-\d{2}-\d{2})\b"), F.lit(1))
    months = F.array_compact(F.array(*[F.when(x.rlike(rf"(?iU)\b{name}\b"), F.lit(i)) for i, name in enumerate(fixed.MONTHS, 1)]))
    return F.struct(
        F.array_compact(F.transform(F.array_distinct(years), lambda y: y.try_cast("int"))).alias("years"),
        F.array_compact(F.transform(F.array_distinct(dates), lambda d: F.try_to_date(d, "yyyy-MM-dd"))).alias("dates"),
        months.alias("months"),
    )


def marks_leak(marks, event_date, months: int = 3) -> Column:
    """Whether date marks name another year, a date over months * 31 days away, or a month further than months away."""
    marks, event = _col(marks), _col(event_date)
    other_year = F.exists(marks["years"], lambda y: y != F.year(event))
    far_date = F.exists(marks["dates"], lambda d: F.abs(F.datediff(d, event)) > months * 31)
    far_month = F.exists(marks["months"], lambda m: month_distance(m, F.month(event)) > months)
    return F.when(event.isNull(), False).otherwise(F.coalesce(other_year | far_date | far_month, F.lit(False)))


def date_leaks(text, event_date, months: int = 3) -> Column:
    """marks_leak of a text."""
    return marks_leak(date_marks(text), event_date, months)


def letters(golden) -> Column:
    """The letters of a comma-joined answer."""
    return F.filter(F.transform(F.split(F.coalesce(_col(golden), F.lit("")), ","), F.trim), lambda x: x != "")


def unordered(x) -> Column:
    """A hash order in the place of a seeded shuffle."""
    return F.md5(x)
