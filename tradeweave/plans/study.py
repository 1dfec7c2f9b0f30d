"""The cleaned facts that every dataset starts from, and the grains they share."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tradeweave.functions import domains as d
from tradeweave.functions.aggregates import narm_sum
from tradeweave.functions.columns import food_or_fmfo, habitat_method, has_known_source, hs6_text, in_regime, is_not_true
from tradeweave.operators.joins import lookup
from tradeweave.operators.network import edge_sets
from tradeweave.operators.reshape import computed_once
from tradeweave.sources.regimes import DEFAULT_REGIME, in_regime_table
from tradeweave.sources.sinks import materialise
from tradeweave.sources.tables import TradeTables

# Grain of the shared trade table. Everything derived from trade is a sum, or a set
# of edges, over these keys; their domains bound its size, whatever the input.
TRADE_KEYS = (
    "year",
    "exporter_iso3c",
    "importer_iso3c",
    "environment",
    "method",
    "habitat_method",
    "dom_source",
    "food_or_fmfo",
)
# Grain of the shared consumption table, bounded by the domains as well. Species
# occur only in the slice of one year.
CONSUMPTION_KEYS = ("year", "consumer_iso3c", "source_country_iso3c", "habitat", "method", "consumption_source")
SPECIES_KEYS = ("year", "consumer_iso3c", "source_country_iso3c", "habitat", "method", "sciname_hs_modified")
PRODUCTION_KEYS = ("year", "iso3c", "sciname", "method", "habitat")
# Grain of trade and production together: no countries and no species.
SOURCE_KEYS = ("year", "habitat", "method", "dom_source")

#: Keeps a table that several plans share: (table, name, partition columns) -> table.
Keep = Callable[[DataFrame, str, Sequence[str]], DataFrame]


def in_plan(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Keeps a table inside a plan: its branches compute it once, and nothing is written."""
    return computed_once(df)


@dataclass(frozen=True)
class Study:
    """Input tables plus the settings that vary between uses.

    All datasets are lazy plans over the tables. ``shared()`` reads each large input
    once and writes the grains that the datasets start from, so that computing every
    dataset does not read it once per dataset.

    ``regimes`` is a table (regime, hs_version, first_year, last_year), of which the
    rows named ``regime`` say which version counts in which years; without it the
    published ranges hold.
    """

    tables: TradeTables
    ldc_codes: Sequence[str] = d.LDC_CODES
    centroid_overrides: Mapping[str, tuple[float, float]] = field(default_factory=lambda: d.CENTROID_OVERRIDES)
    custom_series_label: str = "Custom time series"
    concentration_percent: float = d.CONCENTRATION_PERCENT
    max_kg_per_capita: int = d.MAX_KG_PER_CAPITA
    slice_year: int = d.SLICE_YEAR
    regimes: DataFrame | None = None
    regime: str = DEFAULT_REGIME
    trade_cube: DataFrame | None = None
    version_cube: DataFrame | None = None
    edge_table: DataFrame | None = None
    production_cube: DataFrame | None = None
    source_production: DataFrame | None = None
    source_trade: DataFrame | None = None
    consumption_cube: DataFrame | None = None
    species_cube: DataFrame | None = None
    supply_table: DataFrame | None = None

    def shared(self, keep: Keep = materialise) -> Study:
        return self.with_shared_trade(keep).with_shared_production(keep).with_shared_consumption(keep)

    def with_shared_trade(self, keep: Keep = materialise) -> Study:
        kept = keep(trade_grains(self), "trade", [])
        sums = [F.sum(c).alias(c) for c in ("product_weight_t", "n_fishmeal", "fishmeal_live_t", "fishmeal_product_t")]
        return replace(
            self,
            trade_cube=kept.where("n_food > 0").select(*[F.col(f"_{k}").alias(k) for k in TRADE_KEYS], "live_weight_t"),
            version_cube=kept.groupBy("year", "hs_version").agg(*sums),
        )

    def with_shared_edges(self, keep: Keep = materialise) -> Study:
        return replace(self, edge_table=keep(self.edges(), "edges", []))

    def with_shared_production(self, keep: Keep = materialise) -> Study:
        kept = keep(production_grains(self), "production", ["grain"])
        detail, sources = (kept.where(F.col("grain") == g).drop("grain") for g in ("detail", "sources"))
        return replace(self, production_cube=detail, source_production=sources.drop("iso3c", "sciname"))

    def with_shared_sources(self, keep: Keep = in_plan) -> Study:
        """Trade and production by source from one pass, for datasets that take both.

        Only where the tables say that both are the same records, and nothing of them
        is shared yet; else the study as it is.
        """
        if getattr(self.tables, "records", None) is None or self.trade_cube is not None or self.source_production is not None:
            return self
        kept = keep(source_grains(self), "sources", [])
        produced = kept.groupBy("year", "method", "habitat").agg(F.sum("production_t").alias("production_t"))
        category = habitat_method("habitat", "method").alias("habitat_method")
        traded = kept.where("is_food").select(
            "year", F.col("habitat").alias("environment"), "method", category, "dom_source", "live_weight_t"
        )
        return replace(self, source_production=produced, source_trade=traded)

    def with_shared_consumption(self, keep: Keep = materialise) -> Study:
        kept = keep(consumption_grains(self), "consumption", [])
        weights = ("consumption_live_t", "n_missing")
        return replace(
            self,
            consumption_cube=kept.select(*CONSUMPTION_KEYS, *weights),
            species_cube=kept.where("is_slice").select(*SPECIES_KEYS, *weights),
        )

    def authoritative(self, df: DataFrame) -> DataFrame:
        """Rows of the version that counts in their year."""
        if self.regimes is None:
            return df.where(in_regime("hs_version", "year"))
        return in_regime_table(df, self.regimes, self.regime)

    def trade(self) -> DataFrame:
        """Food trade with its source category, without regions."""
        return food_trade(self) if self.trade_cube is None else self.trade_cube

    def trade_by_source(self) -> DataFrame:
        """Food trade for sums that take no countries."""
        return self.trade() if self.source_trade is None else self.source_trade

    def trade_with_regions(self) -> DataFrame:
        return add_regions(self.trade(), self.tables.countries)

    def edible_trade(self) -> DataFrame:
        """Trade known not to be fishmeal; a missing product code is dropped."""
        return self.trade().where(F.col("food_or_fmfo") == "nonfishmeal")

    def sourced_trade(self) -> DataFrame:
        """Edible trade of the four known source categories."""
        return self.edible_trade().where(has_known_source("environment", "method"))

    def edges(self) -> DataFrame:
        """Countries that trade in a year, once per pair, with the categories they trade."""
        if self.edge_table is not None:
            return self.edge_table
        return edge_sets(self.trade(), ["year"], "habitat_method", d.HABITAT_METHODS)

    def consumption(self) -> DataFrame:
        """Consumption weights with the number of missing weights they stand for."""
        if self.consumption_cube is not None:
            return self.consumption_cube
        missing = F.col("consumption_live_t").isNull().cast("int").alias("n_missing")
        return consumption_rows(self).select(*CONSUMPTION_KEYS, "sciname_hs_modified", "consumption_live_t", missing)

    def species_slice(self) -> DataFrame:
        """Foreign consumption of known origin in the slice's year, with species."""
        if self.species_cube is not None:
            return self.species_cube
        return self.consumption().where(in_slice(self)).select(*SPECIES_KEYS, "consumption_live_t", "n_missing")

    def population(self) -> DataFrame:
        """Population by country and year with the country's region."""
        return lookup(
            self.tables.population,
            self.tables.countries,
            {"iso3c": "iso3c"},
            {"region": "owid_region"},
            unique="countries",
        ).select("iso3c", "year", "region", "pop")


# -- trade ---------------------------------------------------------------------


def code_in(df: DataFrame, codes: Sequence[str], column: str = "hs6") -> Column:
    """Test of the stored product code, before padding, so that it reaches the scan."""
    if isinstance(df.schema[column].dataType, StringType):
        spellings = [*codes, *[c[1:] for c in codes if c.startswith("0")]]
    else:
        spellings = [int(c) for c in codes]
    return F.col(column).isin(spellings)


def weighed_rows(study: Study) -> DataFrame:
    """Trade of the authoritative versions with both weights present."""
    both = F.col("live_weight_t").isNotNull() & F.col("product_weight_t").isNotNull()
    return study.authoritative(study.tables.snet).where(both).drop("record_id")


def pad_codes(df: DataFrame) -> DataFrame:
    return df.withColumn("hs6", hs6_text("hs6"))


def coded_trade(study: Study) -> DataFrame:
    return pad_codes(weighed_rows(study))


def nonfood_trade(study: Study) -> DataFrame:
    rows = weighed_rows(study)
    return pad_codes(rows.where(code_in(rows, d.NONFOOD_CODES)))


def fishmeal_rows(study: Study) -> DataFrame:
    rows = weighed_rows(study)
    return pad_codes(rows.where(code_in(rows, [d.FISHMEAL_CODE])))


def _food(study: Study) -> DataFrame:
    """Everything but the non-food codes; a missing code stays. Codes as stored."""
    rows = weighed_rows(study)
    return rows.where(is_not_true(code_in(rows, d.NONFOOD_CODES)))


def food_rows(study: Study) -> DataFrame:
    return pad_codes(_food(study))


def food_trade(study: Study) -> DataFrame:
    rows = _food(study).where(F.col("live_weight_t") >= d.MIN_WEIGHT_T)
    return pad_codes(
        rows.withColumnRenamed("habitat", "environment")
        .withColumn("habitat_method", habitat_method("environment", "method"))
        .withColumn("food_or_fmfo", food_or_fmfo(code_in(rows, [d.FISHMEAL_CODE])))
    )


def add_regions(df: DataFrame, countries: DataFrame) -> DataFrame:
    df = lookup(df, countries, {"exporter_iso3c": "iso3c"}, {"exporter_region": "owid_region"}, unique="countries")
    return lookup(df, countries, {"importer_iso3c": "iso3c"}, {"importer_region": "owid_region"}, unique="countries")


def marked_trade(study: Study, rows: DataFrame, weighed: Column) -> DataFrame:
    """All rows, with whether they are food trade (``is_food``) or fishmeal (``is_fishmeal``);
    ``weighed`` says whether both weights are present."""
    counts = in_regime("hs_version", "year")
    if study.regimes is not None:
        rows, counts = in_regime_table(rows, study.regimes, study.regime, mark="_counts"), F.col("_counts")
    usable = F.coalesce(counts, F.lit(False)) & weighed
    heavy = F.col("live_weight_t") >= d.MIN_WEIGHT_T
    return rows.withColumns(
        {
            "is_food": usable & heavy & is_not_true(code_in(rows, d.NONFOOD_CODES)),
            "is_fishmeal": usable & F.coalesce(code_in(rows, [d.FISHMEAL_CODE]), F.lit(False)),
        }
    )


def trade_grains(study: Study) -> DataFrame:
    """What the datasets take from trade, from one pass over it.

    Food trade is summed by TRADE_KEYS, their names with a leading underscore. Other
    rows have none of these keys; they are one group for each year and version, which
    ``n_food`` tells apart. Summed again by year and version, the table gives the
    product weight of all rows and the weights of fishmeal, which has no minimum. So
    one grouping holds both grains, and no row is counted twice on the way.
    """
    both = F.col("live_weight_t").isNotNull() & F.col("product_weight_t").isNotNull()
    rows = marked_trade(study, study.tables.snet, both)
    rows = rows.withColumns(
        {
            "environment": F.col("habitat"),
            "habitat_method": habitat_method("habitat", "method"),
            "food_or_fmfo": food_or_fmfo(code_in(rows, [d.FISHMEAL_CODE])),
        }
    )
    keys = [F.when(F.col("is_food"), F.col(k)).alias(f"_{k}") for k in TRADE_KEYS]
    food, fishmeal = F.col("is_food"), F.col("is_fishmeal")
    return rows.groupBy(*keys, "year", "hs_version").agg(
        F.count_if(food).alias("n_food"),
        F.sum(F.when(food, F.col("live_weight_t"))).alias("live_weight_t"),
        F.sum("product_weight_t").alias("product_weight_t"),
        F.count_if(fishmeal).alias("n_fishmeal"),
        narm_sum(F.when(fishmeal, F.col("live_weight_t"))).alias("fishmeal_live_t"),
        narm_sum(F.when(fishmeal, F.col("product_weight_t"))).alias("fishmeal_product_t"),
    )


def source_grains(study: Study) -> DataFrame:
    """Food trade and production by SOURCE_KEYS, from one pass over records that are both.

    Every record counts as production. Those that are food trade as well are groups of
    their own, which ``is_food`` tells apart.
    """
    rows = marked_trade(study, study.tables.records, F.col("weighed"))
    return rows.groupBy(*SOURCE_KEYS, "is_food").agg(
        F.sum(F.when(F.col("is_food"), F.col("live_weight_t"))).alias("live_weight_t"),
        narm_sum("live_weight_t").alias("production_t"),
    )


# -- production ----------------------------------------------------------------


def source_totals(study: Study) -> DataFrame:
    """Production by year, method and habitat."""
    if study.source_production is not None:
        return study.source_production
    return study.tables.production.groupBy("year", "method", "habitat").agg(narm_sum("live_weight_t").alias("production_t"))


def production_grains(study: Study) -> DataFrame:
    """Production by PRODUCTION_KEYS ("detail") and by year, method and habitat ("sources")
    from one pass; the second is bounded by the domains, the first holds species."""
    sources = ["year", "method", "habitat"]
    rows = study.tables.production
    return rows.groupingSets([[*PRODUCTION_KEYS], sources], *PRODUCTION_KEYS).agg(
        F.when(F.grouping("iso3c") == 1, F.lit("sources")).otherwise(F.lit("detail")).alias("grain"),
        narm_sum("live_weight_t").alias("production_t"),
    )


# -- consumption ---------------------------------------------------------------


def consumption_rows(study: Study) -> DataFrame:
    return study.authoritative(study.tables.consumption).drop("record_id")


def in_slice(study: Study) -> Column:
    """Foreign supply of the slice's year that comes from a known country."""
    return (
        (F.col("year") == study.slice_year)
        & (F.col("consumption_source") == "foreign")
        & (F.col("source_country_iso3c") != d.UNKNOWN)
    )


def combine_parts(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Weights summed over keys, still counting the missing ones."""
    return df.groupBy(*by).agg(
        narm_sum("consumption_live_t").alias("consumption_live_t"), F.sum("n_missing").alias("n_missing")
    )


def consumption_grains(study: Study) -> DataFrame:
    """What the datasets take from consumption, from one pass over it.

    Summed by CONSUMPTION_KEYS, and by species in the slice of one year only: all other
    rows have none, so the table does not grow with the number of species.
    """
    rows = consumption_rows(study).withColumn("is_slice", F.coalesce(in_slice(study), F.lit(False)))
    species = F.when(F.col("is_slice"), F.col("sciname_hs_modified")).alias("sciname_hs_modified")
    return rows.groupBy(*CONSUMPTION_KEYS, species).agg(
        F.bool_or("is_slice").alias("is_slice"),
        narm_sum("consumption_live_t").alias("consumption_live_t"),
        F.count_if(F.col("consumption_live_t").isNull()).alias("n_missing"),
    )
