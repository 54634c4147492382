"""The registered queries in SQL, for the cross-check on DuckDB.

``RELATIONS`` are named subqueries: first the inputs made from the given
tables, then the calculated tables, written the plain way (full expansion,
aggregates joined back). ``compose`` prefixes a query with those it mentions.
"""

from __future__ import annotations

import re

RELATIONS: dict[str, str] = {}

# Inputs

RELATIONS["month_projection"] = """
SELECT date_trunc('hour', ts) AS "timestamp",
       CAST(2025 + 5 * (user_id % 3) AS BIGINT) AS model_year,
       CASE user_id % 2 WHEN 0 THEN 'baseline' ELSE 'high_growth' END AS scenario,
       event_type AS sector, 'all' AS geography,
       concat('k', event_id % 3) AS metric,
       ROUND(SUM(value) * 100) AS value
FROM events GROUP BY 1, 2, 3, 4, 5, 6"""

RELATIONS["year_projection"] = """
SELECT date_trunc('day', l_shipdate) + to_hours(CAST(l_orderkey % 24 AS INTEGER)) AS "timestamp",
       CAST(year(l_shipdate) AS BIGINT) AS model_year,
       CASE l_linenumber % 2 WHEN 1 THEN 'baseline' ELSE 'high_growth' END AS scenario,
       l_returnflag AS sector, 'all' AS geography, l_linestatus AS metric,
       SUM(l_quantity) AS value
FROM lineitem GROUP BY 1, 2, 3, 4, 5, 6"""

RELATIONS["places"] = """
SELECT n_nationkey, n_name, r_name AS geography
FROM nation JOIN region ON n_regionkey = r_regionkey"""

RELATIONS["buyers"] = """
SELECT c_custkey, c_mktsegment, c_acctbal, n_name, geography
FROM customer JOIN places ON c_nationkey = n_nationkey"""

RELATIONS["sales"] = """
SELECT o_orderkey, o_totalprice, o_orderstatus, o_orderdate, o_orderpriority,
       CAST(2025 + 5 * (o_orderkey % 3) AS BIGINT) AS model_year, c_mktsegment, geography
FROM orders JOIN buyers ON o_custkey = c_custkey"""

RELATIONS["sales_years"] = """
SELECT geography, model_year, ROUND(SUM(o_totalprice), 2) AS price, COUNT(*) AS n,
       COUNT(*) FILTER (o_orderstatus = 'F') AS n_f,
       COUNT(*) FILTER (o_orderstatus = 'O') AS n_o,
       COUNT(*) FILTER (o_orderstatus = 'P') AS n_p
FROM sales GROUP BY geography, model_year"""

RELATIONS["buyer_places"] = """
SELECT geography, COUNT(*) AS n, ROUND(SUM(c_acctbal), 2) AS balance
FROM buyers GROUP BY geography"""

RELATIONS["gdp"] = "SELECT geography, model_year, price / 1e9 AS value FROM sales_years"

RELATIONS["gdp_alt"] = """
SELECT geography, model_year, value * (1e0 + 0.25e0 * (model_year - 2020) / 5e0) AS value FROM gdp"""

RELATIONS["hdi"] = """
SELECT geography, model_year, 0.5e0 + 0.25e0 * n_o / n AS value FROM sales_years"""

RELATIONS["population"] = """
SELECT geography, CAST(y AS BIGINT) AS model_year,
       CAST(n * (1000 + 10 * (y - 2025)) AS DOUBLE) AS value
FROM buyer_places, (VALUES (2025), (2030), (2035)) AS years(y)"""

RELATIONS["ev_share_in"] = """
SELECT geography, model_year, n_f / n AS value FROM sales_years"""

RELATIONS["phev_share_in"] = """
SELECT geography, model_year, n_p / n AS value FROM sales_years"""

RELATIONS["wh_in"] = """
SELECT geography, 'bev' AS subsector, model_year, 150e0 + 100e0 * n_f / n AS value FROM sales_years
UNION ALL
SELECT geography, 'phev', model_year, 200e0 + 100e0 * n_o / n FROM sales_years"""

RELATIONS["intensity_base"] = """
SELECT geography,
       CASE c_mktsegment WHEN 'MACHINERY' THEN 'Industrial' WHEN 'AUTOMOBILE' THEN 'Transportation'
            WHEN 'BUILDING' THEN 'Commercial' WHEN 'HOUSEHOLD' THEN 'Residential'
            ELSE c_mktsegment END AS sector,
       CASE c_custkey % 2 WHEN 0 THEN 'Road' ELSE 'Other' END AS subsector,
       COUNT(*) AS n, ROUND(SUM(c_acctbal), 2) AS balance
FROM buyers
GROUP BY 1, 2, 3"""

RELATIONS["intensity"] = """
SELECT geography, sector, subsector,
       concat(CASE sector WHEN 'Residential' THEN 'res' ELSE 'nonres' END, '_', p, '_',
              CASE WHEN sector = 'Residential' THEN 'lin'
                   WHEN geography = 'EUROPE' AND sector = 'Industrial' AND subsector = 'Other'
                   THEN 'log' ELSE 'exp' END) AS metric,
       CASE p WHEN 'a0' THEN 0.5e0 + balance / n / 1e5 WHEN 'a1' THEN 0.015625e0
              WHEN 't0' THEN 2020e0 ELSE 0.875e0 END AS value
FROM intensity_base, (VALUES ('a0'), ('a1'), ('t0'), ('r2')) AS parts(p)"""

RELATIONS["vpc_in"] = """
SELECT geography, concat(p, '_lin') AS metric,
       CASE p WHEN 'a0' THEN 0.25e0 + balance / n / 1e5 WHEN 'a1' THEN 0.001953125e0
              ELSE 2020e0 END AS value
FROM buyer_places, (VALUES ('a0'), ('a1'), ('t0')) AS parts(p)"""

RELATIONS["km_in"] = """
SELECT geography, concat(p, '_exp') AS metric,
       CASE p WHEN 'a0' THEN 9e0 + balance / n / 1e5 WHEN 'a1' THEN -0.0009765625e0
              ELSE 2020e0 END AS value
FROM buyer_places, (VALUES ('a0'), ('a1'), ('t0')) AS parts(p)"""

RELATIONS["load_shapes"] = """
SELECT geography, model_year, month(o_orderdate) AS month, o_orderkey % 24 AS hour,
       isodow(o_orderdate) < 6 AS is_weekday,
       CASE c_mktsegment WHEN 'MACHINERY' THEN 'Industry' WHEN 'AUTOMOBILE' THEN 'Transport'
            WHEN 'BUILDING' THEN 'Service' WHEN 'HOUSEHOLD' THEN 'Residential'
            ELSE c_mktsegment END AS sector,
       CASE left(o_orderpriority, 1) WHEN '1' THEN 'heating' WHEN '2' THEN 'cooling'
            ELSE 'other' END AS metric,
       ROUND(SUM(o_totalprice), 2) / COUNT(*) / 365.25e0 AS value
FROM sales GROUP BY 1, 2, 3, 4, 5, 6, 7"""

RELATIONS["shipped"] = """
SELECT geography, date_trunc('day', l_shipdate) AS "timestamp",
       SUM(l_quantity) / COUNT(*) AS bait,
       ROUND(SUM(l_discount), 2) * 100 / COUNT(*) AS temperature,
       ROUND(SUM(l_tax), 2) * 100 / COUNT(*) AS humidity,
       CAST(COUNT(*) AS DOUBLE) AS solar, SUM(l_linenumber) / COUNT(*) AS wind,
       MIN(l_quantity) AS dew
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN places ON s_nationkey = n_nationkey
GROUP BY 1, 2"""

RELATIONS["weather_in"] = """
SELECT geography, "timestamp", 'BAIT' AS metric, bait AS value FROM shipped
UNION ALL SELECT geography, "timestamp", 'Temperature', temperature FROM shipped
UNION ALL SELECT geography, "timestamp", 'Humidity', humidity FROM shipped
UNION ALL SELECT geography, "timestamp", 'Solar_Radiation', solar FROM shipped
UNION ALL SELECT geography, "timestamp", 'Wind_Speed', wind FROM shipped
UNION ALL SELECT geography, "timestamp", 'Dew_Point', dew FROM shipped"""

# Annual energy

RELATIONS["parsed"] = """
SELECT geography, sector, subsector, string_split(metric, '_')[2] AS parameter,
       string_split(metric, '_')[3] AS regression_type, value
FROM intensity"""

RELATIONS["coefficients"] = """
SELECT geography, sector, subsector, regression_type,
       SUM(value) FILTER (parameter = 'a0') AS a0, SUM(value) FILTER (parameter = 'a1') AS a1,
       SUM(value) FILTER (parameter = 't0') AS t0
FROM parsed GROUP BY ALL"""

RELATIONS["coefficients_cit"] = """
SELECT * FROM coefficients WHERE sector IN ('Commercial', 'Industrial', 'Transportation')"""

RELATIONS["coefficients_res"] = "SELECT * FROM coefficients WHERE sector = 'Residential'"

for _name, _gdp in (("", "gdp"), ("_alt", "gdp_alt")):
    RELATIONS[f"annual_cit{_name}"] = f"""
    SELECT c.geography, d.model_year, sector, subsector,
           CASE regression_type WHEN 'exp' THEN exp(a0 + a1 * (d.model_year - t0))
                WHEN 'lin' THEN a0 + a1 * (d.model_year - t0) END * d.value AS value
    FROM coefficients_cit c JOIN {_gdp} d USING (geography)"""

RELATIONS["annual_res"] = """
SELECT c.geography, h.model_year, sector, subsector,
       CASE regression_type WHEN 'exp' THEN exp(a0 + a1 * (h.model_year - t0))
            WHEN 'lin' THEN a0 + a1 * (h.model_year - t0) END * h.value * p.value AS value
FROM coefficients_res c JOIN hdi h USING (geography)
JOIN population p ON p.geography = h.geography AND p.model_year = h.model_year"""

# Vehicles

RELATIONS["vpc"] = """
SELECT geography, string_split(metric, '_')[2] AS regression_type,
       SUM(value) FILTER (metric LIKE 'a0!_%' ESCAPE '!') AS a0,
       SUM(value) FILTER (metric LIKE 'a1!_%' ESCAPE '!') AS a1,
       SUM(value) FILTER (metric LIKE 't0!_%' ESCAPE '!') AS t0
FROM vpc_in GROUP BY ALL"""

RELATIONS["km"] = RELATIONS["vpc"].replace("vpc_in", "km_in")

RELATIONS["stock"] = """
SELECT v.geography, p.model_year,
       CASE regression_type WHEN 'exp' THEN exp(a0 + a1 * (p.model_year - t0))
            WHEN 'lin' THEN a0 + a1 * (p.model_year - t0) END * p.value AS total_vehicles
FROM vpc v JOIN population p USING (geography)"""

RELATIONS["ev_stock_q"] = """
SELECT s.geography, s.model_year, total_vehicles * e.value AS ev_stock_total
FROM stock s JOIN ev_share_in e USING (geography, model_year)"""

RELATIONS["ev_split_q"] = """
SELECT s.geography, s.model_year, ev_stock_total * (1 - p.value) AS bev_stock,
       ev_stock_total * p.value AS phev_stock
FROM ev_stock_q s JOIN phev_share_in p USING (geography, model_year)"""

RELATIONS["distance"] = """
SELECT k.geography, p.model_year,
       CASE regression_type WHEN 'exp' THEN exp(a0 + a1 * (p.model_year - t0))
            WHEN 'lin' THEN a0 + a1 * (p.model_year - t0) END AS km_per_vehicle_year
FROM km k JOIN population p USING (geography)"""

RELATIONS["ev_energy"] = """
SELECT s.geography, s.model_year, w.subsector AS ev_type,
       CASE w.subsector WHEN 'bev' THEN bev_stock WHEN 'phev' THEN phev_stock END
           * km_per_vehicle_year * w.value AS wh_per_year
FROM ev_split_q s JOIN distance d USING (geography, model_year)
JOIN wh_in w ON w.geography = s.geography AND w.model_year = s.model_year"""

RELATIONS["ev_tj"] = """
SELECT geography, model_year, 'Transportation' AS sector, 'Road' AS subsector,
       SUM(wh_per_year) / 277777777.778e0 AS value
FROM ev_energy GROUP BY geography, model_year"""

# Weather

RELATIONS["daily"] = """
SELECT geography, "timestamp",
       MAX(value) FILTER (metric = 'Temperature') AS temperature,
       MAX(value) FILTER (metric = 'Solar_Radiation') AS solar_radiation,
       MAX(value) FILTER (metric = 'Wind_Speed') AS wind_speed,
       MAX(value) FILTER (metric = 'Dew_Point') AS dew_point,
       MAX(value) FILTER (metric = 'Humidity') AS humidity,
       MAX(value) FILTER (metric = 'BAIT') AS bait,
       CAST(year("timestamp") AS BIGINT) AS weather_year,
       CAST(month("timestamp") AS BIGINT) AS month, CAST(day("timestamp") AS BIGINT) AS day,
       CASE dayname("timestamp") WHEN 'Saturday' THEN 'weekend' ELSE 'weekday' END AS day_type
FROM weather_in WHERE year("timestamp") = 1998 GROUP BY geography, "timestamp"
"""

RELATIONS["days"] = """
SELECT *, greatest(0e0, 20e0 - bait) AS hdd, greatest(0e0, bait - 30e0) AS cdd FROM daily"""

RELATIONS["grouped"] = """
SELECT geography, weather_year, month, day_type, COUNT(*) AS num_days,
       SUM(hdd) AS total_hdd, SUM(cdd) AS total_cdd
FROM days GROUP BY ALL"""

RELATIONS["maxima"] = """
SELECT geography, weather_year, month, day_type, MAX(hdd) AS max_hdd, MAX(cdd) AS max_cdd
FROM days GROUP BY ALL"""

RELATIONS["smoothed"] = """
SELECT d.*, num_days, total_hdd, total_cdd, max_hdd, max_cdd,
       CASE WHEN total_hdd > 0 THEN greatest(hdd, max_hdd / 10e0) ELSE hdd END AS adjusted_hdd,
       CASE WHEN total_cdd > 0 THEN greatest(cdd, max_cdd / 10e0) ELSE cdd END AS adjusted_cdd
FROM days d JOIN grouped USING (geography, weather_year, month, day_type)
JOIN maxima USING (geography, weather_year, month, day_type)"""

RELATIONS["adjusted_sums"] = """
SELECT geography, weather_year, month, day_type, SUM(adjusted_hdd) AS adjusted_total_hdd,
       SUM(adjusted_cdd) AS adjusted_total_cdd
FROM smoothed GROUP BY ALL"""

RELATIONS["multipliers"] = """
SELECT s.*, adjusted_total_hdd, adjusted_total_cdd,
       CASE WHEN total_hdd > 0 THEN adjusted_hdd / adjusted_total_hdd * num_days ELSE 1e0 END
           AS heating_multiplier,
       CASE WHEN total_cdd > 0 THEN adjusted_cdd / adjusted_total_cdd * num_days ELSE 1e0 END
           AS cooling_multiplier,
       1e0 AS other_multiplier
FROM smoothed s JOIN adjusted_sums USING (geography, weather_year, month, day_type)"""

# Shapes and projection

RELATIONS["shapes"] = """
SELECT geography, model_year, month, hour, is_weekday,
       CASE sector WHEN 'Industry' THEN 'Industrial' WHEN 'Transport' THEN 'Transportation'
            WHEN 'Service' THEN 'Commercial' ELSE sector END AS sector,
       metric AS enduse, value AS load_shape_value,
       CASE WHEN is_weekday THEN 'weekday' ELSE 'weekend' END AS day_type
FROM load_shapes"""

RELATIONS["hours"] = """
SELECT s.geography, s.model_year, s.sector, s.enduse,
       m."timestamp" + to_hours(CAST(s.hour AS INTEGER)) AS "timestamp", m.weather_year,
       s.load_shape_value,
       CASE s.enduse WHEN 'heating' THEN heating_multiplier WHEN 'cooling' THEN cooling_multiplier
            ELSE other_multiplier END AS multiplier,
       load_shape_value * multiplier AS adjusted_value
FROM shapes s JOIN multipliers m USING (geography, month, day_type)"""

RELATIONS["totals"] = """
SELECT geography, model_year, sector, SUM(adjusted_value) AS load_shape_annual_total
FROM hours WHERE sector IN ('Commercial', 'Industrial', 'Transportation', 'Residential')
GROUP BY ALL"""

RELATIONS["mwh"] = """
SELECT geography, model_year, sector, subsector, value * 277.777777778e0 AS annual_mwh
FROM (SELECT * FROM annual_cit UNION ALL SELECT * FROM annual_res)"""

RELATIONS["mwh_alt"] = """
SELECT geography, model_year, sector, subsector, value * 277.777777778e0 AS annual_mwh
FROM (SELECT * FROM annual_cit_alt UNION ALL SELECT * FROM annual_res)"""

RELATIONS["mwh_ev"] = """
SELECT * FROM mwh WHERE NOT (sector = 'Transportation' AND subsector = 'Road')
UNION ALL
SELECT geography, model_year, sector, subsector, value * 277.777777778e0 FROM ev_tj"""

for _name in ("", "_alt", "_ev"):
    RELATIONS[f"factors{_name}"] = f"""
    SELECT t.geography, t.model_year, t.sector,
           CASE WHEN load_shape_annual_total > 0
                THEN SUM(annual_mwh) / load_shape_annual_total ELSE 1e0 END AS scaling_factor
    FROM totals t JOIN mwh{_name} USING (geography, model_year, sector)
    GROUP BY t.geography, t.model_year, t.sector, load_shape_annual_total"""
    RELATIONS[f"projection{_name}"] = f"""
    SELECT h."timestamp", h.model_year, h.sector, h.geography, h.enduse AS metric,
           h.adjusted_value * scaling_factor AS value
    FROM hours h JOIN factors{_name} USING (geography, model_year, sector)"""

RELATIONS["projections"] = """
SELECT 'baseline' AS scenario, * FROM projection
UNION ALL BY NAME SELECT 'alternate_gdp' AS scenario, * FROM projection_alt
UNION ALL BY NAME SELECT 'ev_projection' AS scenario, * FROM projection_ev"""

_WORD = re.compile(r"[a-z_]+")


def compose(query: str) -> str:
    """The query with a WITH clause of the relations it needs, in order."""
    needed: set[str] = set()
    todo = [query]
    while todo:
        mentioned = set(_WORD.findall(todo.pop())) & RELATIONS.keys() - needed
        needed |= mentioned
        todo.extend(RELATIONS[name] for name in mentioned)
    parts = [f"{name} AS ({sql})" for name, sql in RELATIONS.items() if name in needed]
    return (f"WITH {', '.join(parts)} " if parts else "") + query
