"""Equivalent SQL for every query, for DuckDB."""

from __future__ import annotations

from checks.fixtures import COUNTRY_SPELLINGS
from checks.oracle_tables import (
    LEVELS,
    NONFOOD,
    REGIME,
    category,
    padded,
    pct,
    strict,
    with_tables,
)

SQL: dict[str, str] = {}


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def add(name: str, columns: str, query: str) -> None:
    """Register a query with its output columns.

    ``:d`` marks fixed-point columns, compared as doubles; ``:r`` marks doubles,
    compared to six places.
    """
    out = []
    for column in columns.split():
        plain, _, kind = column.partition(":")
        quoted = f'"{plain}"'
        if kind == "d":
            out.append(f"CAST(CAST({quoted} AS DECIMAL(38,6)) AS DOUBLE) AS {quoted}")
        elif kind == "r":
            out.append(f"round(CAST({quoted} AS DOUBLE), 6) AS {quoted}")
        else:
            out.append(quoted)
    SQL[name] = with_tables(f"SELECT {', '.join(out)} FROM ({query}) AS result")


def same(new: str, old: str) -> None:
    SQL[new] = SQL[old]


def table(name: str, columns: str, source: str) -> None:
    add(name, columns, f"SELECT * FROM {source}")


# -- scans, sources, sinks -----------------------------------------------------

SNET = (
    "record_id year hs_version hs6 exporter_iso3c importer_iso3c sciname habitat method dom_source "
    "live_weight_t:d product_weight_t:d"
)
CODED = SNET.replace("record_id ", "")
CONSUMED = (
    "year hs_version consumer_iso3c source_country_iso3c sciname_hs_modified habitat method consumption_source "
    "consumption_live_t:d"
)
add("scan_trade_regime", SNET, f"SELECT * FROM snet WHERE {REGIME}")
add("scan_consumption_regime", CONSUMED, f"SELECT * FROM consumption WHERE {REGIME}")
table("scan_production", "iso3c year sciname method habitat live_weight_t:d", "production")
same("prod", "scan_production")
table("scan_countries", "iso3c owid_region", "countries")
add("scan_code_max_resolved_taxa", "hs6", f"SELECT {padded('hs6')} AS hs6 FROM taxa_codes")
table("scan_sciname", "sciname common_name", "species_names")
table("scan_population", "iso3c year pop", "population")
table("trade_ts_by_version", "year hs_version product_weight_t:d", "version_ts")
same("scan_aggregate_pushdown", "trade_ts_by_version")
add(
    "row_counts",
    "table_name n_rows",
    " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, count(*) AS n_rows FROM {source}"
        for name, source in (
            ("snet", "snet"),
            ("production", "production"),
            ("countries", "countries"),
            ("code_max_resolved_taxa", "taxa_codes"),
            ("sciname", "species_names"),
            ("population", "population"),
            ("consumption", "consumption"),
            ("centroids", "centroids"),
        )
    ),
)
COLUMNS = {
    "snet": "record_id bigint, year int, hs_version string, hs6 int, exporter_iso3c string, importer_iso3c string, "
    "sciname string, habitat string, method string, dom_source string, live_weight_t decimal(18,2), "
    "product_weight_t decimal(18,2)",
    "production": "record_id bigint, iso3c string, year int, sciname string, method string, habitat string, "
    "live_weight_t decimal(18,2)",
    "countries": "record_id int, iso3c string, owid_region string",
    "code_max_resolved_taxa": "hs6 int, record_id bigint",
    "sciname": "sciname string, record_id bigint, common_name string",
    "population": "record_id bigint, iso3c string, year int, pop bigint",
    "consumption": "record_id bigint, year int, hs_version string, consumer_iso3c string, source_country_iso3c string, "
    "sciname_hs_modified string, habitat string, method string, consumption_source string, "
    "consumption_live_t decimal(18,2)",
    "centroids": "iso3 string, adm1_code string, centroid_lon double, centroid_lat double",
}
SOURCES = {"code_max_resolved_taxa": "taxa_codes", "sciname": "species_names"}
add(
    "list_tables",
    "table_name position column_name data_type n_rows",
    " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, c.position, c.column_name, c.data_type, "
        f"(SELECT count(*) FROM {SOURCES.get(name, name)}) AS n_rows FROM (VALUES "
        + ", ".join(f"({i + 1}, '{x.split()[0]}', '{x.split()[1]}')" for i, x in enumerate(columns.split(", ")))
        + ") AS c(position, column_name, data_type)"
        for name, columns in COLUMNS.items()
    ),
)
add(
    "scan_trade_laid_out",
    SNET.replace(" sciname", ""),
    f"""SELECT record_id, year, hs_version, hs6, exporter_iso3c, importer_iso3c, habitat, method, dom_source,
      live_weight_t, product_weight_t FROM snet WHERE {REGIME}""",
)
add(
    "custom_regime_exports",
    "year habitat_method live_weight_t:d",
    f"""SELECT year, {category("habitat", "method")} AS habitat_method, sum(live_weight_t) AS live_weight_t FROM snet
    WHERE ((hs_version = 'HS96' AND year < 2000) OR (hs_version = 'HS17' AND year > 2015))
      AND live_weight_t IS NOT NULL AND product_weight_t IS NOT NULL AND live_weight_t >= 0.1
      AND (hs6 IS NULL OR hs6 NOT IN (230120, 30110, 30111, 30119)) GROUP BY 1, 2""",
)
add(
    "read_csv_rejected",
    "record_id iso3c pop record",
    """SELECT CASE WHEN fits THEN n END AS record_id, CASE WHEN fits AND kind <> 5 THEN country END AS iso3c,
      CASE WHEN fits AND kind NOT IN (4, 7) THEN pop END AS pop,
      CASE kind WHEN 1 THEN 'x' || n || ',' || country || ',' || pop WHEN 2 THEN n || ',' || country
        WHEN 3 THEN n || ',' || country || ',' || pop || ',more' WHEN 6 THEN n || ',' || country || ',12.5' END AS record
    FROM (SELECT c_custkey AS n, c_custkey % 10 AS kind, (c_custkey % 10) NOT IN (1, 2, 3, 6) AS fits,
      concat('N', lpad(CAST(c_nationkey AS STRING), 2, '0')) AS country, CAST(c_nationkey * 100 + 7 AS BIGINT) AS pop FROM customer)""",
)
add("read_csv", "record_id iso3c year pop", "SELECT * FROM population")
table("write_csv", "year habitat_method environment dom_live_weight_t:d", "dom_exports")
table("centroid_source", "iso3 adm1_code centroid_lon:r centroid_lat:r", "centroids")

# -- projections, filters, predicates ------------------------------------------

add(
    "drop_null_weights",
    CODED,
    f"SELECT * FROM snet WHERE ({REGIME}) AND live_weight_t IS NOT NULL AND product_weight_t IS NOT NULL",
)
add("normalize_hs6", "hs6 n", f"SELECT {padded('hs6')} AS hs6, count(*) AS n FROM snet GROUP BY 1")
add("split_nonfood", CODED, f"SELECT * FROM coded WHERE hs6 IN {NONFOOD}")
same("trade_nonfood", "split_nonfood")
add("split_food", CODED, f"SELECT * FROM coded WHERE hs6 IS NULL OR hs6 NOT IN {NONFOOD}")
add("fishmeal_filter", CODED, "SELECT * FROM coded WHERE hs6 = '230120'")
add("min_weight_filter", "record_id live_weight_t:d", "SELECT * FROM snet WHERE live_weight_t >= 0.1")
add(
    "habitat_method",
    "habitat method trade_source production_source n",
    f"""SELECT habitat, method, {category("habitat", "method")} AS trade_source,
      CASE WHEN habitat || ' ' || method IN {LEVELS} THEN habitat || ' ' || method END AS production_source, count(*) AS n
    FROM snet GROUP BY habitat, method""",
)
add(
    "filter",
    "record_id year dom_source hs6",
    """SELECT * FROM snet WHERE dom_source <> 'error' AND hs6 IS NOT NULL AND (year < 2000 OR year > 2015)
      AND product_weight_t <= 40""",
)
add(
    "year_in_range",
    "year n",
    """SELECT year, count(*) AS n FROM snet
    WHERE year IN (1996, 1997, 1998, 1999, 2000, 2016, 2017, 2018, 2019, 2020) GROUP BY year""",
)
add(
    "select",
    "exporter_iso3c exporter_region",
    "SELECT iso3c AS exporter_iso3c, owid_region AS exporter_region FROM countries",
)
add(
    "rename",
    "record_id iso3c supply:d",
    "SELECT record_id, consumer_iso3c AS iso3c, consumption_live_t AS supply FROM consumption",
)
add(
    "mutate",
    "record_id consumption_kg:d",
    "SELECT record_id, consumption_live_t * 1000 AS consumption_kg FROM consumption",
)
add(
    "case_when",
    "size_class n",
    """SELECT CASE WHEN live_weight_t < 1 THEN 'trace' WHEN live_weight_t < 10000 THEN 'small'
      WHEN live_weight_t < 50000 THEN 'medium' END AS size_class, count(*) AS n FROM snet GROUP BY 1""",
)
add(
    "food_or_fmfo",
    "hs6 food_or_fmfo n",
    f"""SELECT {padded("hs6")} AS hs6, CASE WHEN hs6 = 230120 THEN 'fishmeal'
      WHEN hs6 <> 230120 THEN 'nonfishmeal' END AS food_or_fmfo, count(*) AS n FROM snet GROUP BY ALL""",
)
add(
    "year_group",
    "year year_group n",
    """SELECT year, CASE WHEN year IN (1996, 1997, 1998, 1999, 2000) THEN 'beginning'
      WHEN year IN (2016, 2017, 2018, 2019, 2020) THEN 'end' END AS year_group, count(*) AS n FROM snet GROUP BY year""",
)
add(
    "ldc_flag",
    "exporter_iso3c importer_iso3c exporter_ldc importer_ldc n",
    """SELECT exporter_iso3c, importer_iso3c,
      CASE WHEN exporter_iso3c IN ('N00', 'N03', 'N05', 'N08', 'N10', 'N13') THEN 'LDC' ELSE 'non-LDC' END AS exporter_ldc,
      CASE WHEN importer_iso3c IN ('N00', 'N03', 'N05', 'N08', 'N10', 'N13') THEN 'LDC' ELSE 'non-LDC' END AS importer_ldc,
      count(*) AS n FROM snet GROUP BY ALL""",
)
add(
    "intraregion_flag",
    "exporter_region importer_region intraregion n",
    """SELECT exporter_region, importer_region, CASE WHEN exporter_region = importer_region THEN 'intraregional trade'
      WHEN exporter_region <> importer_region THEN 'interegional trade' END AS intraregion, count(*) AS n
    FROM trade GROUP BY ALL""",
)
add(
    "exporter_importer_label",
    "exporter_importer n",
    "SELECT exporter_region || ' to ' || importer_region AS exporter_importer, count(*) AS n FROM trade GROUP BY 1",
)
add(
    "consumption_source_recode",
    "consumption_source n",
    """SELECT CASE consumption_source WHEN 'domestic' THEN 'domestic_consumption_t'
      WHEN 'foreign' THEN 'foreign_consumption_t' ELSE 'error' END AS consumption_source, count(*) AS n
    FROM consumption GROUP BY 1""",
)
add(
    "unit_scaling",
    "year habitat_method live_weight_kg:d live_weight_mt:r negative_mt:r",
    """SELECT year, habitat_method, w * 1000 AS live_weight_kg, CAST(w AS DOUBLE) / 1000000 AS live_weight_mt,
      -(CAST(w AS DOUBLE) / 1000000) AS negative_mt FROM m_trade""",
)
add(
    "replace_na",
    "consumer_iso3c year domestic:d foreign:d",
    """SELECT consumer_iso3c, year,
      COALESCE(sum(consumption_live_t) FILTER (WHERE consumption_source = 'domestic'), 0) AS domestic,
      COALESCE(sum(consumption_live_t) FILTER (WHERE consumption_source = 'foreign'), 0) AS "foreign"
    FROM consumption GROUP BY ALL""",
)
add(
    "factor_relevel",
    "level level_order n",
    f"""SELECT CASE WHEN t IN {LEVELS} THEN t END AS level,
      CAST(CASE t WHEN 'marine capture' THEN 1 WHEN 'inland capture' THEN 2 WHEN 'marine aquaculture' THEN 3
        WHEN 'inland aquaculture' THEN 4 END AS INT) AS level_order, count(*) AS n
    FROM (SELECT habitat || ' ' || method AS t FROM snet) GROUP BY ALL""",
)
VERSION_ORDER = """CAST(CASE hs_version WHEN 'HS96' THEN 1 WHEN 'HS02' THEN 2 WHEN 'HS07' THEN 3 WHEN 'HS12' THEN 4
      WHEN 'HS17' THEN 5 END AS INT)"""
add(
    "hs_version_series",
    "year hs_version product_weight_t:d level_order",
    f"""SELECT year, CASE WHEN hs_version IN ('HS96', 'HS02', 'HS07', 'HS12', 'HS17') THEN hs_version END AS hs_version,
      product_weight_t, {VERSION_ORDER} AS level_order FROM all_versions""",
)
same("hs_version_factor", "hs_version_series")

# -- trade datasets ------------------------------------------------------------

table("prod_summary", "year iso3c sciname method habitat production_t:d", "prod_sum")
table("trade_fm", "year live_weight_t:d product_weight_t:d", "fishmeal")
add(
    "global_export_by_source",
    "year habitat_method food_or_fmfo live_weight_t:d",
    "SELECT year, habitat_method, food_or_fmfo, sum(live_weight_t) AS live_weight_t FROM trade GROUP BY ALL",
)
add("fig_1a", "year habitat_method live_weight_t:d", "SELECT year, habitat_method, w AS live_weight_t FROM m_trade")
table("prod_by_source", "year production_t:d habitat_method", "prod_src")
same("dom_export_by_source", "write_csv")
table(
    "percent_export_by_source",
    "year habitat_method environment dom_live_weight_t:d production_t:d percent_export:r",
    "dom_share",
)
same("join_production_share", "percent_export_by_source")
table("percent_export_total", "year percent_export:r calc_type", "share_exported")
same("union_tagged", "percent_export_total")
table("all_degree_summary", "year iso3c all_out_degree all_in_degree", "degree")
table("habitat_method_degree_summary", "year iso3c habitat_method all_out_degree all_in_degree", "hm_degree")
same("degree_full_join", "habitat_method_degree_summary")
add(
    "degree_levels",
    "year level habitat_method iso3c all_out_degree all_in_degree",
    """SELECT 'all' AS level, CAST(NULL AS VARCHAR) AS habitat_method, * FROM degree
    UNION ALL BY NAME SELECT 'within' AS level, * FROM hm_degree""",
)
table(
    "bilateral_habitat_method_summary",
    "year exporter_iso3c exporter_region importer_iso3c importer_region habitat_method dom_source live_weight_t:d",
    "bilateral",
)


def _shares(member: str, by: str) -> str:
    return f"""SELECT *, 100.0 * CAST(sum(live_weight_t) OVER (PARTITION BY {by} ORDER BY live_weight_t DESC, {member}
        ROWS UNBOUNDED PRECEDING) AS DOUBLE) / CAST(sum(live_weight_t) OVER (PARTITION BY {by}) AS DOUBLE)
        AS cumulative_percent
      FROM (SELECT {by}, {member}, sum(live_weight_t) AS live_weight_t FROM bilateral GROUP BY ALL)"""


for flow, member in (("export", "exporter_iso3c"), ("import", "importer_iso3c")):
    add(
        f"{flow}_concentration_habitat_method",
        f"year habitat_method {member} live_weight_t:d cumulative_percent:r",
        _shares(member, "year, habitat_method"),
    )
    table(f"{flow}_concentration_n_countries", "year n", f"{flow}_n")
    add(
        f"{flow}_concentration_hm_n_countries",
        "year habitat_method n",
        f"""SELECT year, habitat_method, count(*) AS n FROM ({_shares(member, "year, habitat_method")})
        WHERE cumulative_percent < 75 AND habitat_method <> 'unknown' GROUP BY ALL""",
    )
    add(
        "concentration_with_total" if flow == "export" else "import_concentration_with_total",
        "year series n",
        f"""SELECT year, habitat_method AS series, count(*) AS n FROM ({_shares(member, "year, habitat_method")})
        WHERE cumulative_percent < 75 AND habitat_method <> 'unknown' GROUP BY ALL
        UNION ALL SELECT year, 'total', n FROM {flow}_n""",
    )

table(
    "trade_region_method",
    "year exporter_region importer_region habitat_method live_weight_t:d exporter_importer",
    "region_method",
)
table("regional_trade", "exporter_region importer_region habitat method year live_weight_t:d", "regional")
add(
    "bilateral_flow_change",
    "exporter_iso3c importer_iso3c beginning:d end:d change:d",
    'SELECT *, "end" - beginning AS change FROM flow_change',
)


def _top(country: str, years: str, split: bool) -> str:
    """Ten largest per category with ties, average rank and label."""
    parts = ", ".join(
        f"COALESCE(CAST(sum(live_weight_t) FILTER (WHERE dom_source = '{o}') AS DOUBLE) / 4, 0) AS \"{o}\""
        for o in ("domestic", "foreign", "error")
    )
    total = 'domestic + "foreign"' if split else "total"
    return f"""SELECT {country} || '___' || habitat_method AS {country}, * EXCLUDE ({country}, place),
        CAST(rank() OVER (PARTITION BY habitat_method ORDER BY live_weight_t) AS DOUBLE)
          + (count(*) OVER (PARTITION BY habitat_method, live_weight_t) - 1) / 2.0 AS ranking
      FROM (SELECT *, rank() OVER (PARTITION BY habitat_method ORDER BY live_weight_t DESC) AS place
        FROM (SELECT *, {total} AS live_weight_t
          FROM (SELECT {country}, habitat_method, {parts}, CAST(sum(live_weight_t) AS DOUBLE) / 4 AS total
            FROM bilateral WHERE year BETWEEN {years} AND habitat_method <> 'unknown' GROUP BY ALL)))
      WHERE place <= 10"""


for label, country in (("exporters", "exporter_iso3c"), ("importers", "importer_iso3c")):
    for when, years in (("old", "1996 AND 2000"), ("new", "2016 AND 2020")):
        top = _top(country, years, split=True)
        add(
            f"top_{label}_{when}",
            f"{country} habitat_method domestic:r foreign:r error:r live_weight_t:r ranking:r",
            top,
        )
        add(
            f"top_partners_long_{label}_{when}",
            f"{country} habitat_method error:r live_weight_t:r ranking:r dom_source live_weight_t_2:r",
            f"""SELECT *, 'domestic' AS dom_source, domestic AS live_weight_t_2 FROM ({top})
            UNION ALL SELECT *, 'foreign', "foreign" FROM ({top})""",
        )
for when, years in (("old", "1996 AND 2000"), ("recent", "2016 AND 2020")):
    add(
        f"top_importers_total_{when}",
        "importer_iso3c habitat_method live_weight_t:r ranking:r",
        _top("importer_iso3c", years, split=False),
    )
same("pivot_longer", "top_partners_long_exporters_new")

table("trade_region", "year exporter_region importer_region live_weight_t:d exporter_importer", "region_pairs")
table("region_slopes", "exporter_importer slope:r", "slopes")
add(
    "regional_avg_annual_change",
    "exporter_region importer_region exporter_importer slope:r intraregion pair_order",
    """SELECT p.*, s.slope, CASE WHEN exporter_region = importer_region THEN 'intraregional trade'
        ELSE 'interegional trade' END AS intraregion,
      CAST(row_number() OVER (ORDER BY s.slope NULLS LAST, p.exporter_importer) AS INT) AS pair_order
    FROM (SELECT DISTINCT exporter_region, importer_region, exporter_importer FROM region_pairs) p
    LEFT JOIN slopes s ON p.exporter_importer = s.exporter_importer""",
)
table("dom_source_ts", "dom_source year live_weight_t:d", "origin_ts")
add(
    "dom_source_by_habitat_method",
    "dom_source habitat_method year live_weight_t:d",
    """SELECT dom_source, habitat_method, year, sum(live_weight_t) AS live_weight_t FROM trade
    WHERE dom_source <> 'error' GROUP BY ALL""",
)
table("ldc_habitat_method_summary", "year exporter_ldc importer_ldc habitat_method live_weight_t:d", "ldc")
table(
    "ldc_net_habitat_method_summary",
    "year habitat_method ldc_import:d ldc_export:d net_import:d net_export:d",
    "ldc_net",
)
table("custom_ts", "year hs_version product_weight_t:d", "custom")
table("trade_ts_union", "year hs_version product_weight_t:d", "all_versions")

# -- consumption and supply datasets -------------------------------------------

ADJUSTED = CONSUMED + " consumer_year consumer_region source_region common_name"
table("consumption_outliers", "consumer_iso3c year corrected_consumption_t:r", "factors")
table("consumption_scaled", CONSUMED + " consumer_year", "scaled")
same("join_outlier_detail", "consumption_scaled")
table("consumption_percap_adjusted", ADJUSTED, "adjusted")
add("union_all_by_name", CONSUMED + " consumer_year", "SELECT * FROM regular UNION ALL SELECT * FROM scaled")
table(
    "foreign_consumption_2019",
    "consumer_iso3c source_country_iso3c habitat method consumption_live_t:d",
    "foreign_pairs",
)
table("top_scinames_foreign_consumed", "sciname_hs_modified habitat_method", "top_species")
table("top_scinames_source_consumer", "common_name habitat_method consumption_live_t:d flow region", "species_long")
same("join_top_species", "top_scinames_source_consumer")
for source in ("marine capture", "marine aquaculture", "inland capture", "inland aquaculture"):
    key = source.replace(" ", "_")
    habitat, method = source.split()
    add(
        f"foreign_flow_{key}",
        "consumer_iso3c source_country_iso3c consumption_live_t:d",
        f"SELECT * FROM foreign_pairs WHERE habitat = '{habitat}' AND method = '{method}'",
    )
    add(
        f"top_scinames_{key}",
        "common_name habitat_method consumption_live_t:d flow region total:d common_name_order",
        f"""SELECT *, CAST(dense_rank() OVER (ORDER BY total DESC, common_name) AS INT) AS common_name_order
        FROM (SELECT *, sum(consumption_live_t) OVER (PARTITION BY common_name) AS total FROM species_long
          WHERE habitat_method = '{source}')""",
    )
    add(
        f"flow_arrows_{key}",
        """consumer_iso3c source_country_iso3c consumption_live_t:d source_lon:r source_lat:r consumer_lon:r
        consumer_lat:r""",
        f"""SELECT f.*, a.centroid_lon AS source_lon, 1.05 * a.centroid_lat AS source_lat,
          b.centroid_lon AS consumer_lon, 0.95 * b.centroid_lat AS consumer_lat
        FROM (SELECT *, rank() OVER (ORDER BY consumption_live_t DESC) AS place FROM foreign_pairs
          WHERE habitat = '{habitat}' AND method = '{method}') f
        LEFT JOIN country_points a ON f.source_country_iso3c = a.iso3
        LEFT JOIN country_points b ON f.consumer_iso3c = b.iso3 WHERE f.place <= 10""",
    )
    add(
        f"sankey_regions_{key}",
        "x node next_x next_node value:d node_order",
        f"""SELECT x, CASE WHEN node IN ('Europe', 'Oceania', 'Asia', 'S.America', 'N.America', 'Africa') THEN node END
            AS node, next_x, next_node, value,
          CAST(CASE node WHEN 'Europe' THEN 1 WHEN 'Oceania' THEN 2 WHEN 'Asia' THEN 3 WHEN 'S.America' THEN 4
            WHEN 'N.America' THEN 5 WHEN 'Africa' THEN 6 END AS INT) AS node_order
        FROM (SELECT 'exporter_region' AS x, exporter_region AS node, 'importer_region' AS next_x,
            importer_region AS next_node, sum(live_weight_t) AS value
          FROM short_regions WHERE habitat = '{habitat}' AND method = '{method}'
          GROUP BY exporter_region, importer_region
          UNION ALL
          SELECT 'importer_region', importer_region, NULL, NULL, sum(live_weight_t)
          FROM short_regions WHERE habitat = '{habitat}' AND method = '{method}'
          GROUP BY exporter_region, importer_region)""",
    )
table(
    "supply", "iso3c habitat method year supply_domestic:d supply_foreign:d supply:d habitat_method region pop", "supplies"
)
table("global_pop", "year pop", "(SELECT year, CAST(pop AS BIGINT) AS pop FROM world_pop)")
table("regional_pop", "region year pop", "(SELECT region, year, CAST(pop AS BIGINT) AS pop FROM region_pop)")
add(
    "global_supply_per_cap",
    "year supply:d pop per_cap:r",
    "SELECT year, supply, CAST(pop AS BIGINT) AS pop, per_cap FROM world_per_cap",
)
same("join_global_pop", "global_supply_per_cap")
add(
    "supply_total",
    "iso3c region year habitat_method supply:d supply_domestic:d supply_foreign:d pop",
    f"""SELECT iso3c, region, year, habitat_method, sum(supply) AS supply, sum(supply_domestic) AS supply_domestic,
      sum(supply_foreign) AS supply_foreign, CAST({strict("pop")} AS BIGINT) AS pop
    FROM supplies GROUP BY iso3c, region, year, habitat_method""",
)
add(
    "fig4a",
    "year habitat_method supply:d year_global_pop supply_per_cap:r",
    """SELECT s.*, CAST(p.pop AS BIGINT) AS year_global_pop, 1000.0 * CAST(s.supply AS DOUBLE) / p.pop AS supply_per_cap
    FROM (SELECT year, habitat_method, sum(supply) AS supply FROM supplies WHERE region <> 'Other nei' GROUP BY ALL) s
    LEFT JOIN world_pop p ON s.year = p.year""",
)
add(
    "fig4b",
    "year region habitat_method supply:d pop supply_per_cap:r",
    "SELECT * REPLACE (CAST(pop AS BIGINT) AS pop) FROM region_per_cap",
)
same("join_regional_pop", "fig4b")
add(
    "fig4c",
    "year supply_source supply_percent:r",
    f"""SELECT year, 'domestic' AS supply_source, {pct("sum(supply_domestic)", "sum(supply)")} AS supply_percent
    FROM supplies WHERE region <> 'Other nei' GROUP BY year
    UNION ALL SELECT year, 'foreign', {pct("sum(supply_foreign)", "sum(supply)")}
    FROM supplies WHERE region <> 'Other nei' GROUP BY year""",
)
table("fig4d", "region year supply_source supply_percent:r", "origin_long")
same("sum_of_ratio_parts", "fig4d")
add(
    "global_supply",
    "year supply:r",
    "SELECT year, CAST(sum(supply) AS DOUBLE) / 1000000 AS supply FROM supplies GROUP BY year",
)
table("regional_method_supplies", "region region_supply:d aquaculture:r capture:r unknown:r", "region_methods")
table("method_supplies", "method supply:d total_supply:d percent_supply:r", "methods_2020")
table("habitat_method_supply", "year habitat method supply:d supply_total:d percent_supply:r", "hm_supply")
table("consumption_foreign", "year supply_foreign:d supply:d percent_supply:r", "foreign_years")

# -- datasets behind the charts ------------------------------------------------

add(
    "mean_degree_by_source",
    "year habitat_method mean_out_degree:r mean_in_degree:r",
    """SELECT year, habitat_method, avg(all_out_degree) AS mean_out_degree, avg(all_in_degree) AS mean_in_degree
    FROM hm_degree GROUP BY ALL""",
)
table("consumer_map_totals", "consumer_iso3c habitat_method consumption_live_t:d", "map_totals")
add(
    "join_map_attributes",
    "consumer_iso3c habitat_method consumption_live_t:d consumer_region",
    """SELECT m.*, c.owid_region AS consumer_region FROM map_totals m
    LEFT JOIN countries c ON m.consumer_iso3c = c.iso3c""",
)
table("country_centroids", "iso3 centroid_lon:r centroid_lat:r", "country_points")
add(
    "axis_limits",
    "axis max_value:r",
    """SELECT 'map' AS axis, CAST(max(consumption_live_t) AS DOUBLE) / 1000000 AS max_value FROM map_totals
    UNION ALL SELECT 'arrows', CAST(max(consumption_live_t) AS DOUBLE) / 1000000 FROM titled
    UNION ALL SELECT 'stacked_bar', CAST(max(consumption_live_t) AS DOUBLE) / 1000000 FROM species_sums""",
)
same("global_max", "axis_limits")
table("sciname_totals", "common_name flow habitat_method consumption_live_t:d", "species_sums")
add(
    "clean_common_names",
    "common_name habitat_method consumption_live_t:d flow region label region_label",
    f"""SELECT *, replace(CASE
      WHEN habitat_method = 'marine capture' THEN CASE common_name
        WHEN 'alaska pollock(=walleye poll.)' THEN 'alaska pollock' WHEN 'ray-finned fishes' THEN 'ray finned fishes'
        ELSE common_name END
      WHEN habitat_method = 'marine aquaculture' THEN common_name
      WHEN habitat_method = 'inland capture' THEN CASE replace(common_name, ' nei', '')
        WHEN 'ray-finned fishes' THEN 'ray finned fishes' WHEN 'freshwater siluroids' THEN chr(10) || 'freshwater siluroids'
        WHEN 'nile perch' THEN chr(10) || 'nile perch' ELSE replace(common_name, ' nei', '') END
      ELSE CASE replace(common_name, ' nei', '')
        WHEN 'ray-finned fishes' THEN 'ray finned fishes' WHEN 'striped catfish' THEN chr(10) || 'striped catfish'
        WHEN 'freshwater siluroids' THEN chr(10) || 'freshwater siluroids'
        WHEN 'nile tilapia' THEN chr(10) || 'nile tilapia' ELSE replace(common_name, ' nei', '') END
      END, ' ', chr(10)) AS label,
      CASE WHEN habitat_method = 'inland aquaculture' THEN replace(replace(region, 'North ', 'N. '), 'South ', 'S. ')
        ELSE region END AS region_label
    FROM species_long WHERE habitat_method IN {LEVELS}""",
)
table("abbreviate_regions", "exporter_region importer_region habitat method year live_weight_t:d", "short_regions")
add(
    "region_net_import",
    "year region import_live_weight_t:d export_live_weight_t:d net_import:d",
    """SELECT i.year, i.region, i.w AS import_live_weight_t, e.w AS export_live_weight_t, i.w - e.w AS net_import
    FROM (SELECT year, importer_region AS region, sum(live_weight_t) AS w FROM region_method GROUP BY ALL) i
    LEFT JOIN (SELECT year, exporter_region AS region, sum(live_weight_t) AS w FROM region_method GROUP BY ALL) e
      ON i.year = e.year AND i.region = e.region""",
)
same("region_net_join", "region_net_import")
add(
    "region_flow_totals",
    "flow year region habitat_method live_weight_t:d",
    """SELECT 'exporter' AS flow, year, exporter_region AS region, habitat_method, -sum(live_weight_t) AS live_weight_t
    FROM region_method GROUP BY ALL
    UNION ALL SELECT 'importer', year, importer_region, habitat_method, sum(live_weight_t) FROM region_method GROUP BY ALL""",
)
add(
    "ldc_net_with_total",
    "year habitat_method net_export:d level_order",
    f"""SELECT *, CAST(CASE habitat_method WHEN 'marine capture' THEN 1 WHEN 'inland capture' THEN 2
        WHEN 'marine aquaculture' THEN 3 WHEN 'inland aquaculture' THEN 4 WHEN 'total' THEN 5 END AS INT) AS level_order
    FROM (SELECT year, habitat_method, net_export FROM ldc_net
      UNION ALL SELECT year, 'total', {strict("net_export")} FROM ldc_net GROUP BY year)""",
)

# -- joins ---------------------------------------------------------------------

table("population_region", "iso3c year region pop", "people")
add(
    "add_region",
    "record_id exporter_iso3c exporter_region importer_iso3c importer_region",
    """SELECT s.*, e.owid_region AS exporter_region, i.owid_region AS importer_region FROM snet s
    LEFT JOIN countries e ON s.exporter_iso3c = e.iso3c LEFT JOIN countries i ON s.importer_iso3c = i.iso3c""",
)
add(
    "add_common_name",
    "record_id sciname_hs_modified common_name",
    "SELECT c.*, n.common_name FROM consumption c LEFT JOIN species_names n ON c.sciname_hs_modified = n.sciname",
)
add(
    "join_production_year",
    "year live_weight_t:d production_t:d",
    """SELECT t.*, p.production_t FROM (SELECT year, sum(live_weight_t) AS live_weight_t FROM trade GROUP BY year) t
    LEFT JOIN (SELECT year, sum(production_t) AS production_t FROM prod_src GROUP BY year) p ON t.year = p.year""",
)
add(
    "join_population",
    "consumer_iso3c year consumption_live_t:d pop",
    """SELECT t.*, p.pop
    FROM (SELECT consumer_iso3c, year, sum(consumption_live_t) AS consumption_live_t FROM consumption GROUP BY ALL) t
    LEFT JOIN population p ON t.consumer_iso3c = p.iso3c AND t.year = p.year""",
)
add(
    "anti_outliers",
    "consumer_iso3c year n",
    "SELECT consumer_iso3c, year, count(*) AS n FROM regular GROUP BY ALL",
)
add(
    "join_slopes",
    "year exporter_region importer_region live_weight_t:d exporter_importer slope:r",
    "SELECT p.*, s.slope FROM region_pairs p LEFT JOIN slopes s ON p.exporter_importer = s.exporter_importer",
)
add(
    "join_ldc_flows",
    "year habitat_method ldc_import:d ldc_export:d",
    """SELECT i.year, i.habitat_method, i.live_weight_t AS ldc_import, e.live_weight_t AS ldc_export
    FROM (SELECT * FROM ldc WHERE importer_ldc = 'LDC' AND exporter_ldc = 'non-LDC') i
    LEFT JOIN (SELECT * FROM ldc WHERE importer_ldc = 'non-LDC' AND exporter_ldc = 'LDC') e
      ON i.year = e.year AND i.habitat_method IS NOT DISTINCT FROM e.habitat_method""",
)
add(
    "join_centroids",
    "exporter_iso3c importer_iso3c n exporter_lon:r exporter_lat:r importer_lon:r importer_lat:r",
    """SELECT t.*, a.centroid_lon AS exporter_lon, a.centroid_lat AS exporter_lat, b.centroid_lon AS importer_lon,
      b.centroid_lat AS importer_lat
    FROM (SELECT exporter_iso3c, importer_iso3c, count(*) AS n FROM trade GROUP BY ALL) t
    LEFT JOIN country_points a ON t.exporter_iso3c = a.iso3 LEFT JOIN country_points b ON t.importer_iso3c = b.iso3""",
)

# -- aggregations --------------------------------------------------------------

add(
    "group_sum",
    "year product_weight_t:d",
    f"SELECT year, {strict('product_weight_t')} AS product_weight_t FROM snet GROUP BY year",
)
add(
    "group_sum_narm",
    "year exporter_iso3c hs6 product_weight_t:d",
    """SELECT year, exporter_iso3c, hs6, COALESCE(sum(product_weight_t), 0) AS product_weight_t
    FROM snet GROUP BY year, exporter_iso3c, hs6""",
)
add(
    "group_mean",
    "year dom_source mean_product_weight_t:r mean_hs6:r",
    """SELECT year, dom_source, CAST(sum(product_weight_t) AS DOUBLE) / count(product_weight_t) AS mean_product_weight_t,
      avg(hs6) AS mean_hs6 FROM snet GROUP BY ALL""",
)
add("count_rows", "year hs_version n", "SELECT year, hs_version, count(*) AS n FROM snet GROUP BY ALL")
table("distinct_rows", "year exporter_iso3c importer_iso3c habitat_method", "hm_edges")
add(
    "argmax_row",
    "year habitat method supply:d supply_total:d percent_supply:r",
    """SELECT * FROM hm_supply WHERE year = 2020
      AND percent_supply = (SELECT max(percent_supply) FROM hm_supply WHERE year = 2020)""",
)
same("max_supply_share", "argmax_row")
add(
    "argmin_row",
    "year habitat percent_supply:r",
    """SELECT * FROM hm_supply WHERE method = 'aquaculture' AND percent_supply > 10 AND year =
      (SELECT min(year) FROM hm_supply WHERE method = 'aquaculture' AND percent_supply > 10)""",
)
add(
    "ols_slope_by_group",
    "exporter_iso3c importer_iso3c slope:r",
    """SELECT exporter_iso3c, importer_iso3c,
      (CAST(n AS DOUBLE) * CAST(sxy AS DOUBLE) - CAST(sx AS DOUBLE) * CAST(sy AS DOUBLE))
        / NULLIF(CAST(n * sxx - sx * sx AS DOUBLE), 0) AS slope
    FROM (SELECT exporter_iso3c, importer_iso3c, count(*) AS n, sum(year - 2000) AS sx, sum(w) AS sy,
        sum((year - 2000) * (year - 2000)) AS sxx, sum(CAST(w AS DECIMAL(28,2)) * (year - 2000)) AS sxy
      FROM (SELECT exporter_iso3c, importer_iso3c, year, sum(live_weight_t) AS w FROM trade GROUP BY ALL) GROUP BY ALL)""",
)

# -- windows, sorts, top-k -----------------------------------------------------

add(
    "cumulative_share",
    "year exporter_iso3c live_weight_t:d cumulative_percent:r",
    """SELECT *, 100.0 * CAST(sum(live_weight_t) OVER (PARTITION BY year ORDER BY live_weight_t DESC, exporter_iso3c
        ROWS UNBOUNDED PRECEDING) AS DOUBLE) / CAST(sum(live_weight_t) OVER (PARTITION BY year) AS DOUBLE)
        AS cumulative_percent
    FROM (SELECT year, exporter_iso3c, sum(live_weight_t) AS live_weight_t FROM trade GROUP BY ALL)""",
)
table("share_of_group", "dom_source year live_weight_t:d total_export:d export_percent:r basis", "origin_shares")
add(
    "group_total_column",
    "year habitat_method live_weight_t:d total:d",
    """SELECT year, habitat_method, w AS live_weight_t, sum(w) OVER (PARTITION BY habitat_method) AS total FROM m_trade""",
)
add(
    "average_rank",
    "year iso3c all_out_degree all_in_degree ranking:r",
    """SELECT *, CASE WHEN all_out_degree IS NOT NULL THEN rank() OVER (PARTITION BY year ORDER BY all_out_degree NULLS LAST)
        + (count(*) OVER (PARTITION BY year, all_out_degree) - 1) / 2.0 END AS ranking
    FROM degree""",
)
add(
    "top_k_by_group",
    "year iso3c all_out_degree all_in_degree",
    """SELECT * FROM (SELECT *, rank() OVER (PARTITION BY year ORDER BY all_in_degree DESC NULLS LAST) AS place FROM degree)
    WHERE place <= 5""",
)
same("sort_rows", "export_concentration_habitat_method")
add(
    "top_k_global",
    "year iso3c habitat_method all_out_degree all_in_degree",
    """SELECT * FROM (SELECT *, rank() OVER (ORDER BY all_out_degree DESC NULLS LAST) AS place FROM hm_degree)
    WHERE place <= 10""",
)
add(
    "order_by_other_column",
    "exporter_region mean_weight:r region_order",
    """SELECT *, CAST(row_number() OVER (ORDER BY mean_weight DESC, exporter_region) AS INT) AS region_order
    FROM (SELECT exporter_region, CAST(sum(live_weight_t) AS DOUBLE) / count(*) AS mean_weight
      FROM region_pairs GROUP BY exporter_region)""",
)
add(
    "order_within_group",
    "habitat_method label iso3c label_order",
    f"""SELECT habitat_method, importer_iso3c AS label, string_split(importer_iso3c, '___')[1] AS iso3c,
      CAST(dense_rank() OVER (PARTITION BY habitat_method ORDER BY ranking, importer_iso3c) AS INT) AS label_order
    FROM ({_top("importer_iso3c", "1996 AND 2000", split=False)})""",
)

# -- set operations and reshaping ----------------------------------------------

add(
    "subtotal_union",
    "year habitat_method live_weight_t:d",
    """SELECT year, habitat_method, w AS live_weight_t FROM m_trade
    UNION ALL SELECT year, 'total', sum(w) FROM m_trade GROUP BY year""",
)
add(
    "pivot_wider",
    "year exporter_iso3c from_domestic:d from_foreign:d from_error:d",
    "SELECT year, exporter_iso3c, "
    + ", ".join(
        f"COALESCE(sum(live_weight_t) FILTER (WHERE dom_source = '{o}'), 0) AS from_{o}"
        for o in ("domestic", "foreign", "error")
    )
    + " FROM trade GROUP BY year, exporter_iso3c",
)
add(
    "pivot_longer_names_sep",
    "year habitat_method live_weight_t:d region flow drop",
    """SELECT *, exporter_region AS region, 'exporter' AS flow, 'region' AS "drop" FROM region_method
    UNION ALL SELECT *, importer_region, 'importer', 'region' FROM region_method""",
)
add(
    "sankey_links",
    "x node next_x next_node value:d",
    """SELECT 'exporter_region' AS x, exporter_region AS node, 'importer_region' AS next_x, importer_region AS next_node,
      live_weight_t AS value FROM region_method
    UNION ALL SELECT 'importer_region', importer_region, NULL, NULL, live_weight_t FROM region_method""",
)

# -- scalar functions ----------------------------------------------------------

add(
    "str_concat",
    "record_id consumer_year habitat_method",
    "SELECT record_id, consumer_iso3c || '_' || year AS consumer_year, habitat || ' ' || method AS habitat_method FROM consumption",
)
add("str_length", "n_chars n", "SELECT CAST(length(CAST(hs6 AS VARCHAR)) AS INT) AS n_chars, count(*) AS n FROM snet GROUP BY 1")
add("str_count_chars", "iso3 adm1_code", "SELECT * FROM centroids WHERE length(adm1_code) = 3")
add(
    "str_detect",
    "year capture:d marine_capture:d unknown:d",
    "SELECT year, "
    + ", ".join(
        f"COALESCE(sum(live_weight_t) FILTER (WHERE contains(habitat || ' ' || method, '{text}')), 0) AS {name}"
        for name, text in (("capture", "capture"), ("marine_capture", "marine capture"), ("unknown", "unknown"))
    )
    + " FROM snet GROUP BY year",
)
add(
    "regex_replace",
    "sciname name stacked",
    """SELECT sciname, replace(common_name, ' nei', '') AS name,
      replace(replace(common_name, ' nei', ''), ' ', chr(10)) AS stacked FROM species_names""",
)
add("cast_text", "hs6 n", "SELECT CAST(hs6 AS VARCHAR) AS hs6, count(*) AS n FROM snet GROUP BY 1")
# The country of each spelling, in the order in which customers use them.
SPELLED = (
    "AFG AGO BGD BEN BTN BFA BFA BDI "
    "KHM CAF CAF TCD COM COM "
    "COD COD COD DJI ERI ETH "
    "GMB GMB GIN GNB GNB HTI KIR "
    "LAO LAO LAO LSO LBR MDG "
    "MWI MLI MRT MOZ MMR MMR NPL NER NER RWA "
    "STP STP SEN SLE SLB SLB "
    "SOM SSD SSD SDN TLS TLS TLS TGO TUV "
    "UGA TZA TZA YEM YEM ZMB "
    "- - - - - - - "
    "- - -"
).split()
add(
    "country_to_code",
    "c_custkey country iso3c",
    "SELECT c_custkey, spelled.country, spelled.iso3c FROM customer JOIN (VALUES "
    + ", ".join(
        f"({i}, {'NULL' if name is None else quoted(name)}, {'NULL' if code == '-' else quoted(code)})"
        for i, (name, code) in enumerate(zip(COUNTRY_SPELLINGS, SPELLED, strict=True))
    )
    + f") AS spelled(i, country, iso3c) ON c_custkey % {len(SPELLED)} = spelled.i",
)
add(
    "dimension_contract",
    "table_name n_rows n_keys n_repeated n_missing",
    " UNION ALL ".join(
        f"""SELECT '{name}' AS table_name, CAST(sum(n) AS BIGINT) AS n_rows, count(*) FILTER (whole) AS n_keys,
          count(*) FILTER (whole AND n > 1) AS n_repeated, CAST(coalesce(sum(n) FILTER (NOT whole), 0) AS BIGINT) AS n_missing
        FROM (SELECT count(*) AS n, {" AND ".join(f"{k} IS NOT NULL" for k in keys.split(", "))} AS whole FROM {source} GROUP BY {keys})"""
        for name, source, keys in (
            ("countries", "countries", "iso3c"),
            ("population", "population", "iso3c, year"),
            ("sciname", "species_names", "sciname"),
            ("consumption", "consumption", "consumer_iso3c, year"),
        )
    ),
)
add(
    "round_digits",
    "year habitat_method environment one_digit:r no_digit:r",
    "SELECT *, round_even(percent_export, 1) AS one_digit, round_even(percent_export, 0) AS no_digit FROM dom_share",
)


def sig(x: str, digits: int) -> str:
    unit = f"pow(10.0, floor(log10(abs({x}))) - {digits - 1})"
    return f"CASE WHEN {x} = 0 THEN 0.0 ELSE round_even({x} / {unit}, 0) * {unit} END"


add(
    "signif_digits",
    "year region habitat_method three:r two:r",
    f"SELECT *, {sig('supply_per_cap', 3)} AS three, {sig('supply_per_cap', 2)} AS two FROM region_per_cap",
)
add(
    "abs_value",
    "exporter_iso3c importer_iso3c change:d",
    'SELECT exporter_iso3c, importer_iso3c, abs("end" - beginning) AS change FROM flow_change',
)
CHANGE = 'CAST("end" AS DOUBLE) - CAST(beginning AS DOUBLE)'
add(
    "percent_change",
    "exporter_iso3c importer_iso3c of_start:r of_end:r",
    f"""SELECT *, {pct(f"({CHANGE})", "beginning")} AS of_start, {pct(f"({CHANGE})", '"end"')} AS of_end
    FROM flow_change""",
)
add(
    "is_null",
    "year no_code no_weight",
    """SELECT year, count(*) FILTER (WHERE hs6 IS NULL) AS no_code,
      count(*) FILTER (WHERE product_weight_t IS NULL) AS no_weight FROM snet GROUP BY year""",
)
add(
    "in_list",
    "year listed not_listed",
    f"""SELECT year, count(*) FILTER (WHERE code IN {NONFOOD}) AS listed,
      count(*) FILTER (WHERE code IS NULL OR code NOT IN {NONFOOD}) AS not_listed
    FROM (SELECT year, {padded("hs6")} AS code FROM snet) GROUP BY year""",
)

# -- headline ------------------------------------------------------------------


def metric_sql(metrics: dict[str, str], source: str) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{name}' AS metric, CAST({value} AS DOUBLE) AS value FROM {source}" for name, value in metrics.items()
    )


def pick(value: str, **keys) -> str:
    condition = " AND ".join(f"{k} = {v!r}" for k, v in keys.items())
    return f"max({value}) FILTER (WHERE {condition})"


def metrics(name: str, *parts: tuple[dict[str, str], str]) -> str:
    text = "\nUNION ALL ".join(metric_sql(m, source) for m, source in parts)
    add(name, "metric value:r", text)
    return text


SOURCES = ("marine capture", "inland capture", "marine aquaculture", "inland aquaculture")


def _total(year: int, part: str = "") -> str:
    where = f"year = {year}" + (f" AND contains(habitat_method, '{part}')" if part else "")
    return f"round_even(CAST(COALESCE(sum(w) FILTER (WHERE {where}), 0) AS DOUBLE) / 1000000, 1)"


TRADE_TOTALS = metrics(
    "trade_totals",
    (
        {f"total_{y}": _total(y) for y in (1996, 2019, 2020)}
        | {f"total_{p.replace(' ', '_')}_{y}": _total(y, p) for p in SOURCES for y in (1996, 2019)}
        | {f"total_{p}_{y}": _total(y, p) for p in ("capture", "aquaculture") for y in (1996, 2019, 2020)},
        "m_trade",
    ),
)
FISHMEAL = metrics(
    "fishmeal_totals",
    (
        {
            f"total_fmfo_{y}": f"CAST(COALESCE(sum(live_weight_t) FILTER (WHERE year = {y}), 0) AS DOUBLE) / 1000000"
            for y in (1996, 2019)
        },
        "fishmeal",
    ),
)
EXPORTED = metrics(
    "percent_export_lookups",
    (
        {
            f"percent_export_total{tag}_{y}": pick("percent_export", year=y, calc_type=kind)
            for tag, kind in (("_dom", "domestic exports"), ("", "all export sources"))
            for y in (1996, 2019)
        },
        "share_exported",
    ),
    (
        {
            f"percent_{p.replace(' ', '_')}_exported_{y}": pick("percent_export", year=y, habitat_method=p)
            for p in SOURCES
            for y in (1996, 2019)
        },
        "dom_share",
    ),
)
metrics(
    "concentration_lookups",
    *[({f"{flow}_n_countries_{y}": pick("n", year=y) for y in (1996, 2019)}, f"{flow}_n") for flow in ("export", "import")],
)
DEGREES = metrics(
    "mean_out_degree", ({f"all_degree_{y}": f"avg(all_out_degree) FILTER (WHERE year = {y})" for y in (1996, 2019)}, "degree")
)
F96, F19 = (f"CAST({pick('live_weight_t', year=y, dom_source='foreign')} AS DOUBLE)" for y in (1996, 2019))
FOREIGN = metrics(
    "foreign_export_change",
    (
        {
            "foreign_exports_1996": F96,
            "foreign_exports_2019": F19,
            "foreign_exports_percent_change": f"100.0 * ({F19} - {F96}) / NULLIF({F19}, 0)",
        },
        "origin_ts",
    ),
)
SHARES = metrics(
    "export_share_by_dom_source",
    (
        {
            f"foreign_export_percent_{y}{tag}": pick("export_percent", year=y, dom_source="foreign", basis=basis)
            for tag, basis in (("", "with error"), ("_no_error", "no error"))
            for y in (1996, 2019)
        },
        "origin_shares",
    ),
)
metrics(
    "percent_flow_increases",
    ({"percent_flow_increases": '100.0 * count(*) FILTER (WHERE "end" > beginning) / count(*)'}, "flow_change"),
)
same("nrow_ratio", "percent_flow_increases")
metrics("global_supply_lookups", ({f"global_supply_{y}": pick("per_cap", year=y) for y in (1996, 2019)}, "world_per_cap"))
table("regional_supply_trends", "region year1996:r year2019:r diff:r percent_diff:r", "region_trend")
table("regional_hm_supply_trends", "region habitat_method year1996:r year2019:r diff:r percent_diff:r", "region_hm_trend")
table("hm_supply_trends", "habitat_method year1996:r year2019:r diff:r percent_diff:r", "hm_trend")
metrics(
    "habitat_method_supply_change",
    (
        {
            "inland_aqua_supply_change": pick("percent_diff", habitat="inland", method="aquaculture"),
            "marine_aqua_supply_change": pick("percent_diff", habitat="marine", method="aquaculture"),
            "marine_cap_supply_change": f"abs({pick('percent_diff', habitat='marine', method='capture')})",
        },
        "hm_supply_wide",
    ),
)
metrics(
    "region_capture_share",
    ({f"{r.lower()}_cap_supply_percent": pick("capture", region=r) for r in ("Oceania", "Asia")}, "region_methods"),
)
metrics("capture_share", ({"cap_supply_percent": pick("percent_supply", method="capture")}, "methods_2020"))
metrics(
    "foreign_share_start_end",
    (
        {
            "foreign_consumption_start": pick("percent_supply", year=1996),
            "foreign_consumption_end": pick("percent_supply", year=2020),
        },
        "foreign_years",
    ),
)
add(
    "asia_farmed_overtake_year",
    "farmed_year",
    """SELECT min(year) AS farmed_year FROM (
      SELECT year, sum(supply) FILTER (WHERE method = 'aquaculture') AS a, sum(supply) FILTER (WHERE method = 'capture') AS c
      FROM supplies WHERE region = 'Asia' GROUP BY year) WHERE a > c""",
)
add(
    "foreign_share_by_region_2019",
    "region supply_percent:r",
    f"""SELECT region, {sig('"foreign"', 2)} AS supply_percent FROM region_origin
    WHERE year = 2019 AND region IN ('Asia', 'South America', 'Europe')""",
)


def _m(name: str) -> str:
    return f"max(value) FILTER (WHERE metric = '{name}')"


def _growth(a: str, b: str, digits: int) -> str:
    return f"round_even(100.0 * ({_m(b)} - {_m(a)}) / NULLIF({_m(a)}, 0), {digits})"


def _part(a: str, whole: str, digits: int) -> str:
    return f"round_even(100.0 * {_m(a)} / NULLIF({whole}, 0), {digits})"


def _round(name: str, digits: int, scale: int = 1) -> str:
    return f"round_even({_m(name)} / {scale}, {digits})" if scale != 1 else f"round_even({_m(name)}, {digits})"


KNOWN = "\nUNION ALL ".join((TRADE_TOTALS, FISHMEAL, EXPORTED, DEGREES, FOREIGN, SHARES))
STATEMENTS = {
    "total_growth": _growth("total_1996", "total_2019", 0),
    "capture_growth": _growth("total_capture_1996", "total_capture_2019", 0),
    "aquaculture_growth": _growth("total_aquaculture_1996", "total_aquaculture_2019", 0),
    "total_decline_2020": f"-{_growth('total_2019', 'total_2020', 0)}",
    "capture_decline_2020": f"-{_growth('total_capture_2019', 'total_capture_2020', 0)}",
    "aquaculture_rise_2020": _growth("total_aquaculture_2019", "total_aquaculture_2020", 1),
    "capture_share_tenths": f"100.0 * round_even({_m('total_capture_2019')} / NULLIF({_m('total_2019')}, 0), 1)",
    "capture_share_1996": _part("total_capture_1996", _m("total_1996"), 0),
    "capture_share_2019": _part("total_capture_2019", _m("total_2019"), 0),
    "aquaculture_share_1996": _part("total_aquaculture_1996", _m("total_1996"), 0),
    "aquaculture_share_2019": _part("total_aquaculture_2019", _m("total_2019"), 0),
    "domestic_exported_1996": _round("percent_export_total_dom_1996", 1),
    "domestic_exported_2019": _round("percent_export_total_dom_2019", 1),
    "total_exported_2019": _round("percent_export_total_2019", 1),
    "marine_capture_exported_2019": _round("percent_marine_capture_exported_2019", 1),
    "inland_aquaculture_exported_2019": _round("percent_inland_aquaculture_exported_2019", 1),
    "exported_share_growth": "100.0 * round_even(({b} - {a}) / NULLIF({a}, 0), 1)".format(
        a=_m("percent_export_total_dom_1996"), b=_m("percent_export_total_dom_2019")
    ),
    "mean_partners_1996": _round("all_degree_1996", 1),
    "mean_partners_2019": _round("all_degree_2019", 1),
    "marine_share_of_capture": _part(
        "total_marine_capture_2019", f"({_m('total_marine_capture_2019')} + {_m('total_inland_capture_2019')})", 1
    ),
    "marine_share_of_aquaculture": _part(
        "total_marine_aquaculture_2019",
        f"({_m('total_marine_aquaculture_2019')} + {_m('total_inland_aquaculture_2019')})",
        1,
    ),
    "fishmeal_decline": f"abs({_growth('total_fmfo_1996', 'total_fmfo_2019', 1)})",
    "fishmeal_share_1996": f"abs({_part('total_fmfo_1996', '(' + _m('total_1996') + ' + ' + _m('total_fmfo_1996') + ')', 1)})",
    "fishmeal_share_2019": f"abs({_part('total_fmfo_2019', '(' + _m('total_2019') + ' + ' + _m('total_fmfo_2019') + ')', 1)})",
    "foreign_exports_change": _round("foreign_exports_percent_change", 1),
    "foreign_exports_1996_mt": _round("foreign_exports_1996", 2, 1000000),
    "foreign_exports_2019_mt": _round("foreign_exports_2019", 2, 1000000),
    "foreign_share_growth": _growth("foreign_export_percent_1996", "foreign_export_percent_2019", 1),
    "foreign_share_1996": _round("foreign_export_percent_1996", 1),
    "foreign_share_2019": _round("foreign_export_percent_2019", 1),
    "foreign_share_growth_no_error": _growth(
        "foreign_export_percent_1996_no_error", "foreign_export_percent_2019_no_error", 1
    ),
    "foreign_share_1996_no_error": _round("foreign_export_percent_1996_no_error", 1),
    "foreign_share_2019_no_error": _round("foreign_export_percent_2019_no_error", 1),
}
add("growth_statements", "metric value:r", f"WITH known AS ({KNOWN})\n" + metric_sql(STATEMENTS, "known"))
metrics(
    "supply_statements",
    (
        {
            f"{p.replace(' ', '_')}_{column}": sig(f"({pick(column, habitat_method=p)})", 3)
            for p in SOURCES
            for column in ("year1996", "year2019", "percent_diff")
        },
        "hm_trend",
    ),
    ({"south_america_decline": f"-({sig('(' + pick('percent_diff', region='South America') + ')', 3)})"}, "region_trend"),
    ({f"global_supply_{y}": sig(f"({pick('per_cap', year=y)})", 3) for y in (1996, 2019)}, "world_per_cap"),
    ({"world_capture_share": sig(f"({pick('percent_supply', method='capture')})", 2)}, "methods_2020"),
    (
        {f"{r.lower()}_capture_share": sig(f"({pick('capture', region=r)})", 2) for r in ("Oceania", "Asia")},
        "region_methods",
    ),
    ({f"foreign_share_{y}": sig(f"({pick('percent_supply', year=y)})", 3) for y in (1996, 2020)}, "foreign_years"),
    (
        {"asia_farmed_overtake_year": "min(year) FILTER (WHERE a > c)"},
        """(SELECT year, sum(supply) FILTER (WHERE method = 'aquaculture') AS a, sum(supply) FILTER (WHERE method = 'capture') AS c
        FROM supplies WHERE region = 'Asia' GROUP BY year)""",
    ),
)
