"""Column expressions: codes, categories, flags, labels and arithmetic.

Every function returns a ``Column`` made of built-in functions only, so it stays
inside whole-stage code generation and can be pushed towards the scan.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tradeweave.functions import domains as d

ColumnLike = Column | str


def as_col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- membership and categories -------------------------------------------------


def not_in(c: ColumnLike, values: Iterable) -> Column:
    """Complement of ``isin`` that keeps missing values."""
    return is_not_true(as_col(c).isin(list(values)))


def is_not_true(condition: Column) -> Column:
    """Negation under which an undecided condition counts as false."""
    return ~F.coalesce(condition, F.lit(False))


def restrict_to(c: ColumnLike, levels: Iterable[str]) -> Column:
    """Values outside the allowed levels become missing."""
    c = as_col(c)
    return F.when(c.isin(list(levels)), c)


def level_order(c: ColumnLike, levels: Iterable[str]) -> Column:
    """Position of a value in an ordered category, 1-based; missing outside it."""
    position = F.array_position(F.array(*[F.lit(v) for v in levels]), as_col(c))
    return F.nullif(position, F.lit(0)).cast("int")


def habitat_method(habitat: ColumnLike, method: ColumnLike, fold_unknown: bool = True) -> Column:
    """Habitat and method as one category.

    With ``fold_unknown`` a part containing "unknown" makes the whole that single
    level; other combinations outside the domain become missing. Plain comparisons
    of the two columns: no text is built per row.
    """
    habitat, method = as_col(habitat), as_col(method)
    category = F
    if fold_unknown:
        category = F.when(habitat.contains(d.UNKNOWN) | method.contains(d.UNKNOWN), F.lit(d.UNKNOWN))
    for source in d.FOUR_SOURCES:
        h, m = source.split(" ")
        category = category.when((habitat == h) & (method == m), F.lit(source))
    return category


def has_known_source(habitat: ColumnLike, method: ColumnLike) -> Column:
    """Whether the category is one of the four known ones.

    The same rows as a test of the category, but each column is compared once, so the
    test stays small and reaches the scan.
    """
    habitats, methods = zip(*(source.split(" ") for source in d.FOUR_SOURCES))
    return as_col(habitat).isin(*dict.fromkeys(habitats)) & as_col(method).isin(*dict.fromkeys(methods))


def habitat_method_text(habitat: ColumnLike, method: ColumnLike) -> Column:
    """Habitat and method as free text; a missing part is spelled "NA"."""
    return F.concat_ws(" ", F.coalesce(as_col(habitat), F.lit("NA")), F.coalesce(as_col(method), F.lit("NA")))


def in_regime(hs_version: ColumnLike, year: ColumnLike, open_start: bool = False) -> Column:
    """One product-code version per year range.

    ``open_start`` drops the lower bound of the first range. An OR of plain
    comparisons prunes partitions of tables laid out by (hs_version, year).
    """
    hs_version, year = as_col(hs_version), as_col(year)
    keep = F.lit(False)
    for i, (version, first, last) in enumerate(d.REGIMES):
        branch = (hs_version == version) & (year <= last)
        if not (open_start and i == 0):
            branch = branch & (year >= first)
        keep = branch if i == 0 else keep | branch
    return keep


def year_group(year: ColumnLike) -> Column:
    year = as_col(year)
    return F.when(year.between(*d.BEGINNING_YEARS), F.lit("beginning")).when(
        year.between(*d.END_YEARS), F.lit("end")
    )


def in_year_groups(year: ColumnLike) -> Column:
    year = as_col(year)
    return year.between(*d.BEGINNING_YEARS) | year.between(*d.END_YEARS)


def food_or_fmfo(is_fishmeal: Column) -> Column:
    """Label of a test for fishmeal; an undecided test stays missing."""
    return F.when(is_fishmeal, F.lit("fishmeal")).when(~is_fishmeal, F.lit("nonfishmeal"))


def ldc_flag(iso3c: ColumnLike, codes: Iterable[str] = d.LDC_CODES) -> Column:
    """Membership in the least-developed group; a missing country is outside it."""
    return F.when(not_in(iso3c, codes), F.lit("non-LDC")).otherwise(F.lit("LDC"))


def trade_scope(exporter_region: ColumnLike, importer_region: ColumnLike) -> Column:
    """Within one region or between two. The second spelling is the published one."""
    a, b = as_col(exporter_region), as_col(importer_region)
    return F.when(a == b, F.lit("intraregional trade")).when(a != b, F.lit("interegional trade"))


def consumption_source_label(source: ColumnLike) -> Column:
    source = as_col(source)
    return (
        F.when(source == "domestic", F.lit("domestic_consumption_t"))
        .when(source == "foreign", F.lit("foreign_consumption_t"))
        .otherwise(F.lit("error"))
    )


def is_known_region(c: ColumnLike) -> Column:
    """Has a region, and not the leftover one (missing regions are dropped)."""
    return as_col(c) != d.OTHER_REGION


# -- text ----------------------------------------------------------------------


def hs6_text(code: ColumnLike) -> Column:
    """Product code as text; exactly five characters get a leading zero."""
    text = as_col(code).cast("string")
    return F.when(F.length(text) == 5, F.concat(F.lit("0"), text)).otherwise(text)


def pair_label(a: ColumnLike, b: ColumnLike) -> Column:
    return F.concat(as_col(a), F.lit(" to "), as_col(b))


def within_label(c: ColumnLike, group: ColumnLike) -> Column:
    """Value tagged with its facet so that it can be ordered inside the facet."""
    return F.concat_ws("___", as_col(c), as_col(group))


def within_value(label: ColumnLike) -> Column:
    return F.regexp_replace(as_col(label), "___.+$", "")


def abbreviate_region(c: ColumnLike, dot: str = ".") -> Column:
    """North and South America shortened; pass ``dot=". "`` for the spaced form."""
    c = as_col(c)
    return (
        F.when(c == "North America", F.lit(f"N{dot}America"))
        .when(c == "South America", F.lit(f"S{dot}America"))
        .otherwise(c)
    )


def chart_name(c: ColumnLike, labels: Mapping[str, str], drop_nei: bool) -> Column:
    """Species name as charts show it: suffix dropped, renamed, one word per line."""
    c = as_col(c)
    if drop_nei:
        c = F.regexp_replace(c, " nei", "")
    renamed = c
    for old, new in labels.items():
        renamed = F.when(c == old, F.lit(new)).otherwise(renamed)
    return F.regexp_replace(renamed, " ", "\n")


# -- arithmetic ----------------------------------------------------------------


def ratio(numerator: ColumnLike, denominator: ColumnLike) -> Column:
    """Division in double precision; missing when the denominator is zero."""
    return F.try_divide(as_col(numerator).cast("double"), as_col(denominator).cast("double"))


def percent(part: ColumnLike, whole: ColumnLike) -> Column:
    return ratio(F.lit(100.0) * as_col(part).cast("double"), whole)


def percent_change(start: ColumnLike, end: ColumnLike, base: ColumnLike | None = None) -> Column:
    """Change in percent of ``base``, by default the start value."""
    start, end = as_col(start).cast("double"), as_col(end).cast("double")
    return ratio(F.lit(100.0) * (end - start), start if base is None else base)


def kg_per_capita(tonnes: ColumnLike, people: ColumnLike) -> Column:
    return ratio(F.lit(1000.0) * as_col(tonnes).cast("double"), people)


def millions(c: ColumnLike) -> Column:
    return ratio(c, F.lit(1_000_000.0))


def round_even(c: ColumnLike, digits: int = 0) -> Column:
    """Rounding to decimal places, ties to even."""
    return F.bround(as_col(c), digits)


def signif(c: ColumnLike, digits: int) -> Column:
    """Rounding to significant digits."""
    c = as_col(c).cast("double")
    unit = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(c))) - F.lit(digits - 1))
    return F.when(c == 0, F.lit(0.0)).otherwise(F.bround(c / unit, 0) * unit)
