"""Views that derive tracks, grids, cells, vessels, routes and logs from the given tables.

One SQL text serves both engines: ``{TS}`` is the zone-less timestamp type, ``1.5D`` a double literal.
"""
import re

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()

_RAW = """
select case when event_id % 97 = 0 then '' else concat('B', cast(user_id as string)) end as id,
  case when event_id % 89 = 0 then 'bad' else cast(date_trunc('second', ts) as string) end as time,
  case when event_id % 83 = 0 then '-95.0' when event_id % 79 = 0 then 'x'
       else concat('-', cast(50 + user_id % 27 as string), '.', cast(10 + event_id % 90 as string)) end as lat,
  concat(cast(user_id % 180 as string), '.5') as lon,
  cast(event_id % 50 as string) as length_km, cast(event_id % 30 as string) as width_km
from events"""

VIEW_SQL = {
    "v_tracks": """
select concat('B', cast(user_id as string)) as iceberg_id, ts as obs_time,
  -74.5D + (user_id*7 % 180)/10.0D + event_id/20000.0D as latitude,
  -180.0D + (user_id*37 % 3600)/10.0D + (event_id*13 % 1000)/5000.0D as longitude,
  0.1D + value/100.0D as length_nm, (0.1D + value/100.0D)*0.6D as width_nm,
  event_type as remarks, event_id
from events""",
    "v_tracks_raw": f"select * from ({_RAW} union all {_RAW} where event_id % 101 = 0) r",
    "v_grid": """
select cast(date '2024-01-01' + cast(l_partkey % 30 as int) as {TS}) as obs_time,
  -74.5D + l_suppkey % 20 as latitude, -180.0D + 10.0D*(l_orderkey % 36) as longitude,
  round(avg(case when l_returnflag='R' and l_linenumber>=5 then null else l_discount*10 end),6) as sic,
  round(avg(l_tax-0.04D),6)+0.0D as uo, round(avg(l_discount-0.05D),6)+0.0D as vo,
  round(avg(l_quantity-25),6)+0.0D as u10, round(avg(l_partkey % 40 - 20),6)+0.0D as v10,
  round(avg(250+l_quantity),6) as t2m, round(avg(95000+97*l_quantity),3) as msl
from lineitem group by 1,2,3""",
    "v_cells": """
select latitude, longitude, is_land,
  case when is_land then 50.0D + (latitude + 80.0D)*-10.0D else -500.0D - (latitude + 75.0D)*100.0D end as z
from (select distinct -74.5D + l_suppkey % 20 as latitude, -180.0D + 10.0D*(l_orderkey % 36) as longitude,
  case when -74.5D + l_suppkey % 20 < -71.0D then true
       when -74.5D + l_suppkey % 20 < -64.0D and (l_orderkey % 36) in (11, 12) then true else false end as is_land
  from lineitem) c""",
    "v_vessels": """
select s_suppkey as vessel_id, s_name as name,
  case s_nationkey % 4 when 0 then 'PC3' when 1 then 'PC5' when 2 then 'PC7' else 'NO' end as ice_class,
  8.0D + s_suppkey % 9 as cruise_speed_knots, 1.0D + s_suppkey % 12 as safety_distance_nm,
  18.0D + s_nationkey as tons_per_day
from supplier""",
    "v_places": """
select n_nationkey as place_id, n_name as name,
  case when n_nationkey % 5 = 0 then 'port' else 'research_center' end as kind,
  -74.6D + n_nationkey*0.75D as latitude, -170.2D + n_nationkey*14.0D as longitude
from nation""",
    "v_routes": """
select o_orderkey as route_id, o_custkey % (select count(*) from supplier) as vessel_id,
  o_orderpriority as preference, o_orderdate as created_at, o_totalprice/1000 as distance_km,
  (o_orderkey % 10 = 0) as demo
from orders""",
    "v_waypoints": """
select l_orderkey as route_id, l_linenumber as wp_index,
  -74.5D + min(l_suppkey) % 20 + 0.25D as latitude, -180.0D + (min(l_partkey) % 720)/2.0D as longitude
from lineitem group by 1,2""",
    "v_metrics": """
select case when event_type in ('click','view') then 'sea_ice' else 'iceberg' end as pipeline,
  concat('model_', cast(user_id % 3 as string)) as model, event_type as metric_name,
  round(avg(value),4) as metric_value, (user_id % 3 = 0) as demo
from events group by 1,2,3,5""",
    "v_forecasts": """
select event_id, ts as forecast_time, event_type as model, cast(6*(1 + user_id % 4) as int) as horizon_hours,
  least(1.0D, value/500.0D) as mean_concentration, (event_id % 10 = 0) as demo
from events""",
    "v_presence": """
select o_orderdate as obs_time, -90.0D + (o_custkey % 400)/10.0D as cell_ll_lat,
  -180.0D + (o_orderkey % 3600)/10.0D as cell_ll_lon, o_orderpriority as flag, o_orderstatus as geartype,
  o_totalprice/10000 as hours
from orders""",
}


class Views:
    """Lazy access to the fixture views (``v.tracks``) and given tables (``v.table('events')``) in Spark."""

    def __init__(self, spark, sf_dir):
        self.spark, self.dir = spark, sf_dir

    def table(self, name):
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def sql(self, text):
        text = text.replace("{TS}", "timestamp_ntz")
        for name in sorted(VIEW_SQL, key=len, reverse=True):
            if re.search(rf"\b{name}\b", text):
                text = re.sub(rf"\b(from|join)\s+{name}\b", rf"\1 ({VIEW_SQL[name]})", text)
        text = text.replace("{TS}", "timestamp_ntz")
        for t in TABLES:
            text = re.sub(rf"\bfrom {t}\b", f"from parquet.`{self.dir}/{t}.parquet`", text)
        return self.spark.sql(text)

    def __getattr__(self, name):
        key = f"v_{name}"
        if key not in VIEW_SQL:
            raise AttributeError(name)
        return self.sql(VIEW_SQL[key])


def oracle(text, ctes=None):
    """DuckDB text of an oracle: literals rewritten, the views it names put in front as CTEs."""
    shared = dict(VIEW_SQL)
    shared.update(ctes or {})
    need, stack = [], [text]
    while stack:
        cur = stack.pop()
        for name, sql in shared.items():
            if re.search(rf"\b{name}\b", cur) and name not in need:
                need.append(name)
                stack.append(sql)
    # order: a CTE after the ones it uses
    done = []

    def visit(n):
        for m in shared:
            if m != n and m in need and re.search(rf"\b{m}\b", shared[n]) and m not in done:
                visit(m)
        if n not in done:
            done.append(n)
    for n in need:
        visit(n)
    body = text.strip()
    head = ", ".join(f"{n} as materialized ({shared[n].strip()})" for n in done)
    if head:
        if re.match(r"(?i)with\b", body):
            body = f"with {head}, {body[4:].lstrip()}"
        else:
            body = f"with {head} {body}"
    return re.sub(r"(\d+(?:\.\d+)?(?:e-?\d+)?)D\b", r"\1::double", body.replace("{TS}", "timestamp"))
