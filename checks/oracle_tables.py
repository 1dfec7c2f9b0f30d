"""Common table expressions the oracle queries are made of.

The driver registers only the generated tables, so the trade tables of FIXTURES.md
and the cleaned facts are inlined into each query as needed.
"""

import re

from tradeweave.functions.domains import REGIMES

REGIME = " OR ".join(f"(hs_version = '{v}' AND year >= {a} AND year <= {b})" for v, a, b in REGIMES)
OPEN_REGIME = REGIME.replace(" AND year >= 1996", "")
LDC = "('N00', 'N03', 'N05', 'N08', 'N10', 'N13')"
NONFOOD = "('230120', '030110', '030111', '030119')"
LEVELS = "('marine capture', 'inland capture', 'marine aquaculture', 'inland aquaculture')"


def pct(a: str, b: str) -> str:
    return f"100.0 * CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0)"


def strict(c: str) -> str:
    return f"CASE WHEN count(*) = count({c}) THEN sum({c}) END"


def padded(c: str) -> str:
    text = f"CAST({c} AS VARCHAR)"
    return f"CASE WHEN length({text}) = 5 THEN '0' || {text} ELSE {text} END"


def category(habitat: str, method: str) -> str:
    """Habitat and method with "unknown" folded and other values outside the domain."""
    text = f"COALESCE({habitat}, 'NA') || ' ' || COALESCE({method}, 'NA')"
    return (
        f"CASE WHEN contains({text}, 'unknown') THEN 'unknown' "
        f"WHEN {text} IN {LEVELS} THEN {text} END"
    )


TABLES = {
    # -- fixtures ---------------------------------------------------------------
    "v_line": """
        SELECT l.l_orderkey * 10 + l.l_linenumber AS record_id,
          CAST(1995 + 4 * (year(o.o_orderdate) - 1995) + quarter(o.o_orderdate) - 1 AS INT) AS year,
          CASE o.o_orderpriority WHEN '1-URGENT' THEN 'HS96' WHEN '2-HIGH' THEN 'HS02' WHEN '3-MEDIUM' THEN 'HS07'
            WHEN '4-NOT SPECIFIED' THEN 'HS12' ELSE 'HS17' END AS hs_version,
          CAST(CASE WHEN p.p_size = 1 THEN 30110 WHEN p.p_size = 2 THEN 30111 WHEN p.p_size = 3 THEN 30119
            WHEN p.p_size <= 6 THEN 230120 WHEN p.p_size = 50 THEN NULL WHEN p.p_size > 40 THEN 160400 + p.p_size
            ELSE 30200 + p.p_size END AS INT) AS hs6,
          concat('N', lpad(CAST(s.s_nationkey AS STRING), 2, '0')) AS exporter_iso3c,
          concat('N', lpad(CAST(c.c_nationkey AS STRING), 2, '0')) AS importer_iso3c,
          p.p_name AS sciname,
          CASE WHEN l.l_linenumber = 7 AND (o.o_orderstatus = 'P' OR year(o.o_orderdate) = 1998) THEN 'unknown'
            WHEN l.l_linestatus = 'O' THEN 'marine' ELSE 'inland' END AS habitat,
          CASE WHEN l.l_linenumber = 7 AND (o.o_orderstatus = 'P' OR year(o.o_orderdate) = 1998) THEN 'unknown'
            WHEN l.l_returnflag = 'A' THEN 'aquaculture' ELSE 'capture' END AS method,
          CASE o.o_orderstatus WHEN 'O' THEN 'domestic' WHEN 'F' THEN 'foreign' ELSE 'error' END AS dom_source,
          CAST(CASE WHEN l.l_quantity = 1 THEN 0.05 ELSE l.l_extendedprice END AS DECIMAL(18,2)) AS live_weight_t,
          CAST(CASE WHEN l.l_quantity = 50 THEN NULL ELSE l.l_quantity END AS DECIMAL(18,2)) AS product_weight_t,
          l.l_linenumber AS linenumber
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
        JOIN customer c ON o.o_custkey = c.c_custkey
        JOIN supplier s ON l.l_suppkey = s.s_suppkey
        JOIN part p ON l.l_partkey = p.p_partkey""",
    "snet": """
        SELECT record_id, year, hs_version, hs6, exporter_iso3c, importer_iso3c, sciname, habitat, method, dom_source,
          live_weight_t, product_weight_t FROM v_line""",
    "production": """
        SELECT record_id, exporter_iso3c AS iso3c, year, sciname, method, habitat, live_weight_t FROM v_line""",
    "countries": """
        SELECT n_nationkey AS record_id, concat('N', lpad(CAST(n_nationkey AS STRING), 2, '0')) AS iso3c,
          CASE WHEN r_name = 'AFRICA' THEN 'Africa' WHEN r_name = 'EUROPE' THEN 'Europe'
            WHEN r_name = 'MIDDLE EAST' THEN 'Other nei' WHEN n_nationkey IN (1, 6, 11) THEN 'North America'
            WHEN r_name = 'AMERICA' THEN 'South America' WHEN n_nationkey = 22 THEN 'Oceania'
            ELSE 'Asia' END AS owid_region
        FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey <> 24""",
    "population": """
        SELECT c.c_nationkey * 10000 + y.year AS record_id,
          concat('N', lpad(CAST(c.c_nationkey AS STRING), 2, '0')) AS iso3c, y.year,
          CAST(count(*) * (200000 + 2000 * (y.year - 1995)) AS BIGINT) AS pop
        FROM customer c CROSS JOIN (SELECT DISTINCT year FROM v_line) y
        WHERE c.c_nationkey <> 23 OR y.year < 2018 GROUP BY c.c_nationkey, y.year""",
    "consumption": """
        SELECT record_id, year, hs_version, importer_iso3c AS consumer_iso3c,
          CASE WHEN dom_source = 'domestic' THEN importer_iso3c WHEN linenumber = 6 THEN 'unknown'
            ELSE exporter_iso3c END AS source_country_iso3c,
          sciname AS sciname_hs_modified, habitat, method,
          CASE WHEN dom_source = 'domestic' THEN 'domestic' ELSE 'foreign' END AS consumption_source,
          live_weight_t AS consumption_live_t
        FROM v_line""",
    "species_names": """
        SELECT min(p_partkey) AS record_id, p_name AS sciname,
          CASE WHEN p_name LIKE 'blue%' THEN concat(p_name, ' nei') ELSE p_name END AS common_name
        FROM part GROUP BY p_name""",
    "centroids": """
        SELECT concat('N', lpad(CAST(n_nationkey AS STRING), 2, '0')) AS iso3,
          CASE WHEN n_nationkey % 2 = 0 THEN 'adm' ELSE 'admin1' END AS adm1_code,
          CAST(n_nationkey * 14 - 170 AS DOUBLE) AS centroid_lon, CAST(n_nationkey * 6 - 70 AS DOUBLE) AS centroid_lat
        FROM nation""",
    "taxa_codes": "SELECT min(record_id) AS record_id, hs6 FROM snet GROUP BY hs6",
    # -- trade ------------------------------------------------------------------
    "coded": f"""
        SELECT year, hs_version, {padded("hs6")} AS hs6, exporter_iso3c, importer_iso3c, sciname, habitat, method,
          dom_source, live_weight_t, product_weight_t
        FROM snet WHERE ({REGIME}) AND live_weight_t IS NOT NULL AND product_weight_t IS NOT NULL""",
    "trade": f"""
        SELECT c.year, c.hs6, c.exporter_iso3c, c.importer_iso3c, c.habitat AS environment, c.method, c.dom_source,
          c.live_weight_t, c.product_weight_t, e.owid_region AS exporter_region, i.owid_region AS importer_region,
          {category("c.habitat", "c.method")} AS habitat_method,
          CASE WHEN c.hs6 = '230120' THEN 'fishmeal' WHEN c.hs6 <> '230120' THEN 'nonfishmeal' END AS food_or_fmfo
        FROM coded c LEFT JOIN countries e ON c.exporter_iso3c = e.iso3c
        LEFT JOIN countries i ON c.importer_iso3c = i.iso3c
        WHERE (c.hs6 IS NULL OR c.hs6 NOT IN {NONFOOD}) AND c.live_weight_t >= 0.1""",
    "prod_sum": """
        SELECT year, iso3c, sciname, method, habitat, COALESCE(sum(live_weight_t), 0) AS production_t
        FROM production GROUP BY ALL""",
    "prod_src": f"""
        SELECT year, sum(production_t) AS production_t,
          CASE WHEN habitat || ' ' || method IN {LEVELS} THEN habitat || ' ' || method END AS habitat_method
        FROM prod_sum GROUP BY year, method, habitat""",
    "dom_exports": """
        SELECT year, habitat_method, environment, sum(live_weight_t) AS dom_live_weight_t
        FROM trade WHERE dom_source = 'domestic' GROUP BY ALL""",
    "dom_share": f"""
        SELECT d.*, p.production_t, {pct("dom_live_weight_t", "production_t")} AS percent_export
        FROM dom_exports d LEFT JOIN prod_src p
          ON d.year = p.year AND d.habitat_method IS NOT DISTINCT FROM p.habitat_method""",
    "share_exported": f"""
        SELECT year, {pct(strict("dom_live_weight_t"), strict("production_t"))} AS percent_export,
          'domestic exports' AS calc_type FROM dom_share GROUP BY year
        UNION ALL
        SELECT t.year, {pct("t.w", "p.w")}, 'all export sources'
        FROM (SELECT year, sum(live_weight_t) AS w FROM trade GROUP BY year) t
        LEFT JOIN (SELECT year, sum(production_t) AS w FROM prod_src GROUP BY year) p ON t.year = p.year""",
    "out_degree": """
        SELECT year, exporter_iso3c AS iso3c, count(*) AS all_out_degree
        FROM (SELECT DISTINCT year, exporter_iso3c, importer_iso3c FROM trade) GROUP BY ALL""",
    "in_degree": """
        SELECT year, importer_iso3c AS iso3c, count(*) AS all_in_degree
        FROM (SELECT DISTINCT year, exporter_iso3c, importer_iso3c FROM trade) GROUP BY ALL""",
    "degree": """
        SELECT COALESCE(o.year, i.year) AS year, COALESCE(o.iso3c, i.iso3c) AS iso3c, all_out_degree, all_in_degree
        FROM out_degree o FULL JOIN in_degree i ON o.year = i.year AND o.iso3c = i.iso3c""",
    "hm_edges": "SELECT DISTINCT year, exporter_iso3c, importer_iso3c, habitat_method FROM trade",
    "hm_degree": """
        SELECT COALESCE(o.year, i.year) AS year, COALESCE(o.iso3c, i.iso3c) AS iso3c,
          COALESCE(o.habitat_method, i.habitat_method) AS habitat_method, all_out_degree, all_in_degree
        FROM (SELECT year, exporter_iso3c AS iso3c, habitat_method, count(*) AS all_out_degree FROM hm_edges GROUP BY ALL) o
        FULL JOIN (SELECT year, importer_iso3c AS iso3c, habitat_method, count(*) AS all_in_degree FROM hm_edges GROUP BY ALL) i
          ON o.year = i.year AND o.iso3c = i.iso3c AND o.habitat_method IS NOT DISTINCT FROM i.habitat_method""",
    "bilateral": """
        SELECT year, exporter_iso3c, exporter_region, importer_iso3c, importer_region, habitat_method, dom_source,
          sum(live_weight_t) AS live_weight_t
        FROM trade WHERE hs6 <> '230120' GROUP BY ALL""",
    "region_method": """
        SELECT year, exporter_region, importer_region, habitat_method, sum(live_weight_t) AS live_weight_t,
          exporter_region || ' to ' || importer_region AS exporter_importer
        FROM trade WHERE importer_region <> 'Other nei' AND exporter_region <> 'Other nei' GROUP BY ALL""",
    "regional": """
        SELECT exporter_region, importer_region, environment AS habitat, method, year, sum(live_weight_t) AS live_weight_t
        FROM trade GROUP BY ALL""",
    "region_pairs": """
        SELECT year, exporter_region, importer_region, sum(live_weight_t) AS live_weight_t, exporter_importer
        FROM region_method GROUP BY ALL""",
    "slopes": """
        SELECT exporter_importer,
          (CAST(n AS DOUBLE) * CAST(sxy AS DOUBLE) - CAST(sx AS DOUBLE) * CAST(sy AS DOUBLE))
            / NULLIF(CAST(n * sxx - sx * sx AS DOUBLE), 0) AS slope
        FROM (SELECT exporter_importer, count(*) AS n, sum(year - 2000) AS sx, sum(live_weight_t) AS sy,
            sum((year - 2000) * (year - 2000)) AS sxx,
            sum(CAST(live_weight_t AS DECIMAL(28,2)) * (year - 2000)) AS sxy
          FROM region_pairs GROUP BY exporter_importer)""",
    "flow_change": """
        SELECT exporter_iso3c, importer_iso3c,
          COALESCE(sum(live_weight_t) FILTER (WHERE year <= 2000), 0) AS beginning,
          COALESCE(sum(live_weight_t) FILTER (WHERE year >= 2016), 0) AS "end"
        FROM bilateral WHERE exporter_region <> 'Other nei' AND importer_region <> 'Other nei'
          AND (year BETWEEN 1996 AND 2000 OR year BETWEEN 2016 AND 2020) GROUP BY ALL""",
    "origin_ts": "SELECT dom_source, year, sum(live_weight_t) AS live_weight_t FROM trade GROUP BY ALL",
    "ldc": f"""
        SELECT year, CASE WHEN exporter_iso3c IN {LDC} THEN 'LDC' ELSE 'non-LDC' END AS exporter_ldc,
          CASE WHEN importer_iso3c IN {LDC} THEN 'LDC' ELSE 'non-LDC' END AS importer_ldc,
          habitat_method, sum(live_weight_t) AS live_weight_t
        FROM bilateral GROUP BY ALL""",
    "ldc_net": """
        SELECT i.year, i.habitat_method, i.live_weight_t AS ldc_import, e.live_weight_t AS ldc_export,
          i.live_weight_t - e.live_weight_t AS net_import, e.live_weight_t - i.live_weight_t AS net_export
        FROM (SELECT * FROM ldc WHERE importer_ldc = 'LDC' AND exporter_ldc = 'non-LDC') i
        LEFT JOIN (SELECT * FROM ldc WHERE importer_ldc = 'non-LDC' AND exporter_ldc = 'LDC') e
          ON i.year = e.year AND i.habitat_method IS NOT DISTINCT FROM e.habitat_method
        WHERE i.habitat_method <> 'unknown'""",
    "version_ts": """
        SELECT year, hs_version, sum(product_weight_t) AS product_weight_t FROM snet GROUP BY ALL""",
    "custom": f"""
        SELECT year, 'Custom time series' AS hs_version, product_weight_t FROM version_ts WHERE {OPEN_REGIME}""",
    "all_versions": "SELECT * FROM version_ts UNION ALL SELECT * FROM custom",
    # -- consumption and supply ---------------------------------------------------
    "consumed": f"SELECT * FROM consumption WHERE {REGIME}",
    "people": """
        SELECT p.iso3c, p.year, c.owid_region AS region, p.pop
        FROM population p LEFT JOIN countries c ON p.iso3c = c.iso3c""",
    "factors": f"""
        SELECT consumer_iso3c, year, pop * 100 / 1000.0 AS corrected_consumption_t,
          CAST(CAST((CAST(20 AS HUGEINT) * pop * 1000000000000000 + cents) // (2 * cents) AS DECIMAL(18,0))
            * CAST(0.000000000000001 AS DECIMAL(16,15)) AS DECIMAL(16,15)) AS factor
        FROM (SELECT t.consumer_iso3c, t.year, p.pop, CAST(CAST(t.total AS DECIMAL(18,2)) * 100 AS HUGEINT) AS cents,
            1000 * CAST(t.total AS DOUBLE) / p.pop AS percap
          FROM (SELECT consumer_iso3c, year, {strict("consumption_live_t")} AS total FROM consumed GROUP BY ALL) t
          JOIN people p ON t.consumer_iso3c = p.iso3c AND t.year = p.year)
        WHERE percap > 100""",
    "scaled": """
        SELECT c.year, c.hs_version, c.consumer_iso3c, c.source_country_iso3c, c.sciname_hs_modified, c.habitat, c.method,
          c.consumption_source, CAST(c.consumption_live_t AS DECIMAL(20,2)) * f.factor AS consumption_live_t,
          c.consumer_iso3c || '_' || c.year AS consumer_year
        FROM factors f LEFT JOIN consumed c ON c.consumer_iso3c = f.consumer_iso3c AND c.year = f.year""",
    "regular": """
        SELECT year, hs_version, consumer_iso3c, source_country_iso3c, sciname_hs_modified, habitat, method,
          consumption_source, CAST(consumption_live_t AS DECIMAL(36,17)) AS consumption_live_t,
          consumer_iso3c || '_' || year AS consumer_year
        FROM consumed WHERE consumer_iso3c || '_' || year NOT IN (SELECT consumer_year FROM scaled)""",
    "adjusted": """
        SELECT a.*, k.owid_region AS consumer_region, o.owid_region AS source_region, n.common_name
        FROM (SELECT * FROM regular UNION ALL SELECT * FROM scaled) a
        LEFT JOIN countries k ON a.consumer_iso3c = k.iso3c
        LEFT JOIN countries o ON a.source_country_iso3c = o.iso3c
        LEFT JOIN species_names n ON a.sciname_hs_modified = n.sciname
        WHERE k.owid_region <> 'Other nei' AND o.owid_region <> 'Other nei'""",
    "foreign19": """
        SELECT * FROM adjusted
        WHERE year = 2019 AND consumption_source = 'foreign' AND source_country_iso3c <> 'unknown'""",
    "foreign_pairs": """
        SELECT consumer_iso3c, source_country_iso3c, habitat, method, sum(consumption_live_t) AS consumption_live_t
        FROM foreign19 GROUP BY ALL""",
    "top_species": """
        SELECT sciname_hs_modified, habitat_method FROM (
          SELECT *, rank() OVER (PARTITION BY habitat_method ORDER BY w DESC) AS place FROM (
            SELECT sciname_hs_modified, habitat || ' ' || method AS habitat_method, sum(consumption_live_t) AS w
            FROM foreign19 GROUP BY ALL)) WHERE place <= 5""",
    "species_flows": """
        SELECT f.common_name, t.habitat_method, f.source_region AS Producer, f.consumer_region AS Consumer,
          sum(f.consumption_live_t) AS consumption_live_t
        FROM top_species t JOIN foreign19 f
          ON t.sciname_hs_modified = f.sciname_hs_modified AND t.habitat_method = f.habitat || ' ' || f.method
        GROUP BY ALL""",
    "species_long": """
        SELECT common_name, habitat_method, consumption_live_t, 'Consumer' AS flow, Consumer AS region FROM species_flows
        UNION ALL
        SELECT common_name, habitat_method, consumption_live_t, 'Producer', Producer FROM species_flows""",
    "supplies": f"""
        SELECT s.*, {category("s.habitat", "s.method")} AS habitat_method, p.region, p.pop
        FROM (SELECT consumer_iso3c AS iso3c, habitat, method, year,
            COALESCE(sum(consumption_live_t) FILTER (WHERE consumption_source = 'domestic'), 0) AS supply_domestic,
            COALESCE(sum(consumption_live_t) FILTER (WHERE consumption_source = 'foreign'), 0) AS supply_foreign,
            sum(consumption_live_t) AS supply
          FROM adjusted GROUP BY ALL) s
        LEFT JOIN people p ON s.iso3c = p.iso3c AND s.year = p.year WHERE s.supply > 0""",
    "world_pop": "SELECT year, sum(pop) AS pop FROM people WHERE region <> 'Other nei' GROUP BY year",
    "region_pop": f"SELECT region, year, {strict('pop')} AS pop FROM people GROUP BY ALL",
    "world_per_cap": """
        SELECT s.year, s.supply, p.pop, 1000.0 * CAST(s.supply AS DOUBLE) / p.pop AS per_cap
        FROM (SELECT year, sum(supply) AS supply FROM supplies GROUP BY year) s LEFT JOIN world_pop p ON s.year = p.year""",
    "region_per_cap": """
        SELECT s.year, s.region, s.habitat_method, s.supply, p.pop,
          1000.0 * CAST(s.supply AS DOUBLE) / p.pop AS supply_per_cap
        FROM (SELECT year, region, habitat_method, sum(supply) AS supply FROM supplies
          WHERE region <> 'Other nei' GROUP BY ALL) s
        LEFT JOIN region_pop p ON s.region = p.region AND s.year = p.year""",
    "region_origin": f"""
        SELECT region, year, {pct("sum(supply_domestic)", "sum(supply)")} AS domestic,
          {pct("sum(supply_foreign)", "sum(supply)")} AS "foreign"
        FROM supplies WHERE region <> 'Other nei' GROUP BY ALL""",
    "origin_long": """
        SELECT region, year, 'domestic' AS supply_source, domestic AS supply_percent FROM region_origin
        UNION ALL SELECT region, year, 'foreign', "foreign" FROM region_origin""",
    "hm_supply": f"""
        SELECT *, {pct("supply", "supply_total")} AS percent_supply
        FROM (SELECT *, sum(supply) OVER (PARTITION BY year) AS supply_total
          FROM (SELECT year, habitat, method, sum(supply) AS supply FROM supplies GROUP BY ALL))""",
    "methods_2020": f"""
        SELECT *, {pct("supply", "total_supply")} AS percent_supply
        FROM (SELECT *, sum(supply) OVER () AS total_supply
          FROM (SELECT method, sum(supply) AS supply FROM supplies WHERE year = 2020 GROUP BY method))""",
    "region_methods": f"""
        SELECT region, region_supply, max(p) FILTER (WHERE method = 'aquaculture') AS aquaculture,
          max(p) FILTER (WHERE method = 'capture') AS capture, max(p) FILTER (WHERE method = 'unknown') AS unknown
        FROM (SELECT *, {pct("supply", "region_supply")} AS p
          FROM (SELECT *, sum(supply) OVER (PARTITION BY region) AS region_supply
            FROM (SELECT region, method, sum(supply) AS supply FROM supplies WHERE year = 2020 GROUP BY ALL)))
        GROUP BY region, region_supply""",
    "foreign_years": f"""
        SELECT year, sum(supply_foreign) AS supply_foreign, sum(supply) AS supply,
          {pct("sum(supply_foreign)", "sum(supply)")} AS percent_supply
        FROM supplies WHERE year IN (1996, 2020) GROUP BY year""",
    # -- behind the charts --------------------------------------------------------
    "titled": f"""
        SELECT consumer_iso3c, source_country_iso3c, consumption_live_t,
          CASE habitat || ' ' || method WHEN 'marine capture' THEN 'Marine Capture'
            WHEN 'marine aquaculture' THEN 'Marine Aquaculture' WHEN 'inland capture' THEN 'Inland Capture'
            WHEN 'inland aquaculture' THEN 'Inland Aquaculture' END AS habitat_method
        FROM foreign_pairs WHERE habitat || ' ' || method IN {LEVELS}""",
    "map_totals": """
        SELECT consumer_iso3c, habitat_method, sum(consumption_live_t) AS consumption_live_t FROM titled GROUP BY ALL""",
    "country_points": """
        SELECT iso3, CASE WHEN iso3 = 'N07' THEN 172.9717 ELSE avg(centroid_lon) END AS centroid_lon,
          CASE WHEN iso3 = 'N07' THEN 1.4518 ELSE avg(centroid_lat) END AS centroid_lat
        FROM centroids WHERE length(adm1_code) = 3 GROUP BY iso3""",
    "species_sums": f"""
        SELECT common_name, flow, array_to_string(list_transform(string_split(habitat_method, ' '),
            lambda w: upper(w[1]) || w[2:]), ' ') AS habitat_method, sum(consumption_live_t) AS consumption_live_t
        FROM species_long WHERE habitat_method IN {LEVELS} GROUP BY ALL""",
    "short_regions": """
        SELECT CASE exporter_region WHEN 'North America' THEN 'N.America' WHEN 'South America' THEN 'S.America'
            ELSE exporter_region END AS exporter_region,
          CASE importer_region WHEN 'North America' THEN 'N.America' WHEN 'South America' THEN 'S.America'
            ELSE importer_region END AS importer_region, habitat, method, year, live_weight_t
        FROM regional""",
    # -- headline -----------------------------------------------------------------
    "m_trade": "SELECT year, habitat_method, sum(live_weight_t) AS w FROM trade GROUP BY ALL",
    "fishmeal": """
        SELECT year, sum(live_weight_t) AS live_weight_t, sum(product_weight_t) AS product_weight_t
        FROM coded WHERE hs6 = '230120' GROUP BY year""",
    "origin_shares": f"""
        SELECT *, {pct("live_weight_t", "total_export")} AS export_percent FROM (
          SELECT *, sum(live_weight_t) OVER (PARTITION BY year) AS total_export, 'with error' AS basis FROM origin_ts
          UNION ALL
          SELECT *, sum(live_weight_t) OVER (PARTITION BY year), 'no error' FROM origin_ts WHERE dom_source <> 'error')""",
    "export_n": """
        SELECT year, count(*) AS n FROM (
          SELECT year, 100.0 * CAST(sum(w) OVER (PARTITION BY year ORDER BY w DESC, c ROWS UNBOUNDED PRECEDING) AS DOUBLE)
            / CAST(sum(w) OVER (PARTITION BY year) AS DOUBLE) AS share
          FROM (SELECT year, exporter_iso3c AS c, sum(live_weight_t) AS w FROM bilateral GROUP BY ALL))
        WHERE share < 75 GROUP BY year""",
    "import_n": """
        SELECT year, count(*) AS n FROM (
          SELECT year, 100.0 * CAST(sum(w) OVER (PARTITION BY year ORDER BY w DESC, c ROWS UNBOUNDED PRECEDING) AS DOUBLE)
            / CAST(sum(w) OVER (PARTITION BY year) AS DOUBLE) AS share
          FROM (SELECT year, importer_iso3c AS c, sum(live_weight_t) AS w FROM bilateral GROUP BY ALL))
        WHERE share < 75 GROUP BY year""",
    "region_trend": """
        SELECT region, y96 AS year1996, y19 AS year2019, y19 - y96 AS diff,
          100.0 * (y19 - y96) / NULLIF(y96, 0) AS percent_diff
        FROM (SELECT region, sum(supply_per_cap) FILTER (WHERE year = 1996) AS y96,
            sum(supply_per_cap) FILTER (WHERE year = 2019) AS y19
          FROM region_per_cap WHERE year IN (1996, 2019) GROUP BY region)""",
    "region_hm_trend": """
        SELECT region, habitat_method, y96 AS year1996, y19 AS year2019, y19 - y96 AS diff,
          100.0 * (y19 - y96) / NULLIF(y96, 0) AS percent_diff
        FROM (SELECT region, habitat_method, max(supply_per_cap) FILTER (WHERE year = 1996) AS y96,
            max(supply_per_cap) FILTER (WHERE year = 2019) AS y19
          FROM region_per_cap WHERE year IN (1996, 2019) AND habitat_method <> 'unknown' GROUP BY ALL)""",
    "hm_trend": """
        SELECT habitat_method, y96 AS year1996, y19 AS year2019, y19 - y96 AS diff,
          100.0 * (y19 - y96) / NULLIF(y96, 0) AS percent_diff
        FROM (SELECT habitat_method, max(v) FILTER (WHERE year = 1996) AS y96, max(v) FILTER (WHERE year = 2019) AS y19
          FROM (SELECT year, habitat_method, 1000.0 * CAST(sum(supply) AS DOUBLE) / CAST(sum(pop) AS DOUBLE) AS v
            FROM region_per_cap WHERE year IN (1996, 2019) AND habitat_method <> 'unknown' GROUP BY ALL)
          GROUP BY habitat_method)""",
    "hm_supply_wide": f"""
        SELECT habitat, method, y96 AS year_1996, y20 AS year_2020,
          {pct("CAST(y20 AS DOUBLE) - CAST(y96 AS DOUBLE)", "y96")} AS percent_diff
        FROM (SELECT habitat, method, max(supply) FILTER (WHERE year = 1996) AS y96,
            max(supply) FILTER (WHERE year = 2020) AS y20
          FROM hm_supply WHERE year IN (1996, 2020) GROUP BY ALL)""",
}


def with_tables(query: str) -> str:
    """The query preceded by the definitions it needs, in order."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in set(re.findall(r"\w+", text)) & TABLES.keys() - needed:
            needed.add(name)
            visit(TABLES[name])

    visit(query)
    definitions = ",\n".join(f"{name} AS ({body})" for name, body in TABLES.items() if name in needed)
    return f"WITH {definitions}\n{query}" if definitions else query
