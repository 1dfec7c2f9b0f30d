"""The numbers quoted in text, as (metric, value) tables."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeweave.functions import domains as d
from tradeweave.functions.aggregates import narm_sum, strict_sum, sum_where
from tradeweave.functions.columns import (
    kg_per_capita,
    millions,
    percent,
    percent_change,
    ratio,
    round_even,
    signif,
)
from tradeweave.operators.reshape import metric_table, stack, wide
from tradeweave.operators.windows import rows_at_max, share_of_group
from tradeweave.plans import supply, trade
from tradeweave.plans.study import Study, in_plan, source_totals

WEIGHT = trade.WEIGHT
START, END, LAST = 1996, 2019, 2020


def _metrics(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Aggregates of a table, each as one metric; a single pass over the table."""
    return metric_table(df.agg(*[c.alias(name) for name, c in columns.items()]))


def _pick(value: str, **keys) -> Column:
    """The value in the row with the given keys."""
    condition = F.lit(True)
    for name, key in keys.items():
        condition = condition & (F.col(name) == key)
    return F.max(F.when(condition, F.col(value)))


def _underscored(source: str) -> str:
    return source.replace(" ", "_")


# -- trade ---------------------------------------------------------------------


def trade_totals(s: Study) -> DataFrame:
    """Exports in million tonnes, rounded: all, by source category and by method."""

    def total(year: int, part: str | None = None) -> Column:
        rows = F.col("year") == year
        if part:
            rows = rows & F.col("habitat_method").contains(part)
        return round_even(millions(sum_where(rows, WEIGHT)), 1)

    columns = {f"total_{y}": total(y) for y in (START, END, LAST)}
    columns |= {f"total_{_underscored(p)}_{y}": total(y, p) for p in d.FOUR_SOURCES for y in (START, END)}
    columns |= {f"total_{p}_{y}": total(y, p) for p in ("capture", "aquaculture") for y in (START, END, LAST)}
    return _metrics(trade.export_by_source(s), columns)


def fishmeal_totals(s: Study) -> DataFrame:
    return _metrics(
        trade.fishmeal_trade(s),
        {f"total_fmfo_{y}": millions(sum_where(F.col("year") == y, WEIGHT)) for y in (START, END)},
    )


def percent_export_lookups(s: Study) -> DataFrame:
    """Share of production exported, all sources and each category."""
    shares = trade.export_shares(s, d.FOUR_SOURCES).withColumns(
        {"_dom": percent("domestic", "domestic_production"), "_all": percent("everything", "production")}
    )
    names = {"export_total_dom": "_dom", "export_total": "_all"}
    names |= {f"{_underscored(source)}_exported": source for source in d.FOUR_SOURCES}
    return _metrics(
        shares, {f"percent_{name}_{y}": _pick(column, year=y) for name, column in names.items() for y in (START, END)}
    )


def concentration_lookups(s: Study) -> DataFrame:
    return _metrics(
        trade.n_countries_by_flow(s),
        {f"{flow}_n_countries_{y}": _pick("n", year=y, flow=flow) for flow in ("export", "import") for y in (START, END)},
    )


def mean_out_degree(s: Study) -> DataFrame:
    return _metrics(
        trade.all_degree_summary(s),
        {f"all_degree_{y}": F.avg(F.when(F.col("year") == y, F.col("all_out_degree"))) for y in (START, END)},
    )


def foreign_export_change(s: Study) -> DataFrame:
    """Foreign exports, and their change in percent of the *end* year."""

    def foreign(year: int) -> Column:
        return _pick(WEIGHT, year=year, dom_source="foreign")

    return _metrics(
        trade.dom_source_ts(s),
        {
            "foreign_exports_1996": foreign(START),
            "foreign_exports_2019": foreign(END),
            "foreign_exports_percent_change": percent_change(foreign(START), foreign(END), base=foreign(END)),
        },
    )


def dom_source_shares(s: Study) -> DataFrame:
    """Share of each origin in the year's exports, with and without errors.

    The few rows of the yearly totals are repeated for each basis, so trade is read
    once.
    """
    both = F.array(F.lit("with error"), F.lit("no error"))
    basis = F.when(F.col("dom_source") != "error", both).otherwise(F.array(F.lit("with error")))
    totals = trade.dom_source_ts(s).withColumn("basis", F.explode(basis))
    return share_of_group(totals, ["basis", "year"], WEIGHT, "export_percent", total="total_export")


def export_share_by_dom_source(s: Study) -> DataFrame:
    return _metrics(
        dom_source_shares(s),
        {
            f"foreign_export_percent_{y}{tag}": _pick("export_percent", year=y, dom_source="foreign", basis=basis)
            for tag, basis in (("", "with error"), ("_no_error", "no error"))
            for y in (START, END)
        },
    )


def percent_flow_increases(s: Study) -> DataFrame:
    """Percent of country pairs whose trade grew."""
    grew = F.count(F.when(F.col("change") > 0, F.lit(1)))
    return _metrics(
        trade.bilateral_flow_change(s), {"percent_flow_increases": percent(grew, F.count(F.lit(1)))}
    )


# -- supply --------------------------------------------------------------------


def global_supply_lookups(s: Study) -> DataFrame:
    return _metrics(
        supply.global_supply_per_cap(s),
        {f"global_supply_{y}": _pick("per_cap", year=y) for y in (START, END)},
    )


def _with_change(df: DataFrame) -> DataFrame:
    return df.withColumn("diff", F.col("year2019") - F.col("year1996")).withColumn(
        "percent_diff", ratio(F.lit(100.0) * F.col("diff"), F.col("year1996"))
    )


def regional_supply_trends(s: Study) -> DataFrame:
    """Per-capita supply of each region, first and last year and change."""
    rows = supply.supply_per_cap_by_region(s).where(F.col("year").isin(START, END))
    totals = rows.groupBy("year", "region").agg(narm_sum("supply_per_cap").alias("supply_per_cap"))
    return _with_change(wide(totals, ["region"], "year", [START, END], F.first("supply_per_cap"), prefix="year"))


def regional_hm_supply_trends(s: Study) -> DataFrame:
    rows = supply.supply_per_cap_by_region(s).where(
        F.col("year").isin(START, END) & (F.col("habitat_method") != d.UNKNOWN)
    )
    return _with_change(
        wide(rows, ["region", "habitat_method"], "year", [START, END], F.first("supply_per_cap"), prefix="year")
    )


def hm_supply_trends(s: Study) -> DataFrame:
    """Per-capita supply of each category over regions that consume it."""
    rows = supply.supply_per_cap_by_region(s).where(
        F.col("year").isin(START, END) & (F.col("habitat_method") != d.UNKNOWN)
    )
    totals = rows.groupBy("year", "habitat_method").agg(
        kg_per_capita(narm_sum("supply"), narm_sum("pop")).alias("supply_per_cap")
    )
    return _with_change(
        wide(totals, ["habitat_method"], "year", [START, END], F.first("supply_per_cap"), prefix="year")
    )


def habitat_method_supply_wide(s: Study) -> DataFrame:
    rows = supply.habitat_method_supply(s).where(F.col("year").isin(START, LAST))
    return wide(
        rows, ["habitat", "method"], "year", [START, LAST], F.first("supply"), prefix="year_"
    ).withColumn("percent_diff", percent_change("year_1996", "year_2020"))


def habitat_method_supply_change(s: Study) -> DataFrame:
    """Change in supply 1996-2020 for three categories; one without its sign."""

    def change(habitat: str, method: str) -> Column:
        return _pick("percent_diff", habitat=habitat, method=method)

    return _metrics(
        habitat_method_supply_wide(s),
        {
            "inland_aqua_supply_change": change("inland", "aquaculture"),
            "marine_aqua_supply_change": change("marine", "aquaculture"),
            "marine_cap_supply_change": F.abs(change("marine", "capture")),
        },
    )


def max_supply_share(s: Study) -> DataFrame:
    """The category with the largest share of supply in 2020."""
    return rows_at_max(supply.habitat_method_supply(s).where(F.col("year") == LAST), "percent_supply")


def region_capture_share(s: Study) -> DataFrame:
    return _metrics(
        supply.regional_method_supplies(s),
        {f"{r.lower()}_cap_supply_percent": _pick("capture", region=r) for r in ("Oceania", "Asia")},
    )


def capture_share(s: Study) -> DataFrame:
    return _metrics(
        supply.method_supplies(s), {"cap_supply_percent": _pick("percent_supply", method="capture")}
    )


def foreign_share_start_end(s: Study) -> DataFrame:
    return _metrics(
        supply.consumption_foreign(s),
        {
            "foreign_consumption_start": _pick("percent_supply", year=START),
            "foreign_consumption_end": _pick("percent_supply", year=LAST),
        },
    )


def overtake_year(s: Study, region: str) -> DataFrame:
    """First year in which farmed exceeds wild supply; missing if there is none."""
    rows = supply.supply(s).where((F.col("region") == region) & F.col("method").isin("capture", "aquaculture"))
    yearly = wide(rows, ["year"], "method", ["aquaculture", "capture"], strict_sum("supply"))
    return yearly.where(F.col("aquaculture") > F.col("capture")).agg(F.min("year").alias("farmed_year"))


def asia_farmed_overtake_year(s: Study) -> DataFrame:
    return overtake_year(s, "Asia")


def foreign_share_by_region_2019(s: Study) -> DataFrame:
    return (
        supply.regional_supply_origin_percent(s)
        .where(
            (F.col("year") == END)
            & (F.col("supply_source") == "foreign")
            & F.col("region").isin("Asia", "South America", "Europe")
        )
        .select("region", signif("supply_percent", 2).alias("supply_percent"))
    )


# -- statements ----------------------------------------------------------------


def growth_statements(s: Study) -> DataFrame:
    """Growth and share figures as quoted, rounded, from the metrics above.

    Trade and production are read once each, whatever the number of figures.
    """
    if s.trade_cube is None:
        s = s.with_shared_trade(in_plan)
    if s.source_production is None:
        s = replace(s, source_production=in_plan(source_totals(s), "production"))
    known = stack(
        trade_totals(s),
        fishmeal_totals(s),
        percent_export_lookups(s),
        mean_out_degree(s),
        foreign_export_change(s),
        export_share_by_dom_source(s),
    )

    def m(name: str) -> Column:
        return _pick("value", metric=name)

    def growth(start: str, end: str, digits: int) -> Column:
        return round_even(percent_change(m(start), m(end)), digits)

    def share(part: str, whole: Column, digits: int) -> Column:
        return round_even(percent(m(part), whole), digits)

    def decline(start: str, end: str) -> Column:
        return -growth(start, end, 0)

    return _metrics(
        known,
        {
            "total_growth": growth("total_1996", "total_2019", 0),
            "capture_growth": growth("total_capture_1996", "total_capture_2019", 0),
            "aquaculture_growth": growth("total_aquaculture_1996", "total_aquaculture_2019", 0),
            "total_decline_2020": decline("total_2019", "total_2020"),
            "capture_decline_2020": decline("total_capture_2019", "total_capture_2020"),
            "aquaculture_rise_2020": growth("total_aquaculture_2019", "total_aquaculture_2020", 1),
            "capture_share_tenths": F.lit(100.0) * round_even(ratio(m("total_capture_2019"), m("total_2019")), 1),
            "capture_share_1996": share("total_capture_1996", m("total_1996"), 0),
            "capture_share_2019": share("total_capture_2019", m("total_2019"), 0),
            "aquaculture_share_1996": share("total_aquaculture_1996", m("total_1996"), 0),
            "aquaculture_share_2019": share("total_aquaculture_2019", m("total_2019"), 0),
            "domestic_exported_1996": round_even(m("percent_export_total_dom_1996"), 1),
            "domestic_exported_2019": round_even(m("percent_export_total_dom_2019"), 1),
            "total_exported_2019": round_even(m("percent_export_total_2019"), 1),
            "marine_capture_exported_2019": round_even(m("percent_marine_capture_exported_2019"), 1),
            "inland_aquaculture_exported_2019": round_even(m("percent_inland_aquaculture_exported_2019"), 1),
            "exported_share_growth": F.lit(100.0)
            * round_even(
                ratio(
                    m("percent_export_total_dom_2019") - m("percent_export_total_dom_1996"),
                    m("percent_export_total_dom_1996"),
                ),
                1,
            ),
            "mean_partners_1996": round_even(m("all_degree_1996"), 1),
            "mean_partners_2019": round_even(m("all_degree_2019"), 1),
            "marine_share_of_capture": share(
                "total_marine_capture_2019", m("total_marine_capture_2019") + m("total_inland_capture_2019"), 1
            ),
            "marine_share_of_aquaculture": share(
                "total_marine_aquaculture_2019",
                m("total_marine_aquaculture_2019") + m("total_inland_aquaculture_2019"),
                1,
            ),
            "fishmeal_decline": F.abs(growth("total_fmfo_1996", "total_fmfo_2019", 1)),
            "fishmeal_share_1996": F.abs(share("total_fmfo_1996", m("total_1996") + m("total_fmfo_1996"), 1)),
            "fishmeal_share_2019": F.abs(share("total_fmfo_2019", m("total_2019") + m("total_fmfo_2019"), 1)),
            "foreign_exports_change": round_even(m("foreign_exports_percent_change"), 1),
            "foreign_exports_1996_mt": round_even(millions(m("foreign_exports_1996")), 2),
            "foreign_exports_2019_mt": round_even(millions(m("foreign_exports_2019")), 2),
            "foreign_share_growth": growth("foreign_export_percent_1996", "foreign_export_percent_2019", 1),
            "foreign_share_1996": round_even(m("foreign_export_percent_1996"), 1),
            "foreign_share_2019": round_even(m("foreign_export_percent_2019"), 1),
            "foreign_share_growth_no_error": growth(
                "foreign_export_percent_1996_no_error", "foreign_export_percent_2019_no_error", 1
            ),
            "foreign_share_1996_no_error": round_even(m("foreign_export_percent_1996_no_error"), 1),
            "foreign_share_2019_no_error": round_even(m("foreign_export_percent_2019_no_error"), 1),
        },
    )


def supply_statements(s: Study) -> DataFrame:
    """Supply figures as quoted, to significant digits."""
    by_category = _metrics(
        hm_supply_trends(s),
        {
            f"{_underscored(source)}_{column}": signif(_pick(column, habitat_method=source), 3)
            for source in d.FOUR_SOURCES
            for column in ("year1996", "year2019", "percent_diff")
        },
    )
    south_america = _metrics(
        regional_supply_trends(s),
        {"south_america_decline": -signif(_pick("percent_diff", region="South America"), 3)},
    )
    world = _metrics(
        global_supply_lookups(s),
        {f"global_supply_{y}": signif(_pick("value", metric=f"global_supply_{y}"), 3) for y in (START, END)},
    )
    captured = _metrics(
        stack(capture_share(s), region_capture_share(s)),
        {
            name: signif(_pick("value", metric=metric), 2)
            for name, metric in (
                ("world_capture_share", "cap_supply_percent"),
                ("oceania_capture_share", "oceania_cap_supply_percent"),
                ("asia_capture_share", "asia_cap_supply_percent"),
            )
        },
    )
    foreign = _metrics(
        foreign_share_start_end(s),
        {
            f"foreign_share_{year}": signif(_pick("value", metric=f"foreign_consumption_{end}"), 3)
            for year, end in ((START, "start"), (LAST, "end"))
        },
    )
    overtaken = _metrics(asia_farmed_overtake_year(s), {"asia_farmed_overtake_year": F.max("farmed_year")})
    return stack(by_category, south_america, world, captured, foreign, overtaken)
