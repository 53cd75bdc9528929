"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm the JVM, then is timed once (planning included, nothing cached between the runs) into a
no-op sink, so all rows and columns are produced and nothing is collected.
"""
import json
import os
import sys
import tempfile
import time

HEADLINE = [
    "j01_flagship", "w01_kinematics", "w06_track_windows", "w10_chrono_split", "p10_clean_rows", "w19_cell_windows", "w08_fill_gaps",
    "a13_regression_metrics", "a32_per_track_errors", "j06_min_distance", "j12_nearest_navigable", "j27_risk_grid", "a37_route_rollup",
    "j28_route_alerts", "w18_position_along", "m03_current_drift", "s17_upsert", "a34_verify",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from floetrack.plans import registry
    from floetrack.plans.fixtures import Views
    from floetrack.session import get_session
    from floetrack.sources import writers as wr
    spark = get_session(f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    qs = registry.queries()
    names = sys.argv[1:] or HEADLINE
    run = lambda df: df.write.format("noop").mode("overwrite").save()
    times = {}
    for n in names:
        run(qs[n](spark, sf_dir))
        t = time.time()
        run(qs[n](spark, sf_dir))
        times[n] = round(time.time() - t, 3)
        print(f"{n} {times[n]}", file=sys.stderr, flush=True)
    out = {"metric": "total_headline_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
           "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus)}
    if names == HEADLINE:
        # comparable workloads: clean + partitioned write of a long grid table (rows/s) and routes scored per second
        v = Views(spark, sf_dir)
        long = v.sql("select cast(l_shipdate as timestamp_ntz) as obs_time, -74.5D + l_suppkey % 20 as latitude, l_orderkey % 360 - 180.0D as longitude, "
                     "cast(l_discount*10 as double) as sic, cast(l_quantity as double) as wind from lineitem")
        long = long.unionByName(long).unionByName(long).unionByName(long)
        from floetrack.operators.grids import flag_nodata
        t = time.time()
        wr.write_partitioned(flag_nodata(long, "sic"), tempfile.mkdtemp(prefix="bench-") + "/grid", {"yyyymm": wr.month_key()})
        sec = time.time() - t
        out["grid_write_rows_per_sec"] = round(long.count() / sec)
        out["routes_scored_per_sec"] = round(v.routes.count() / times["a37_route_rollup"])
    print(json.dumps(out))


if __name__ == "__main__":
    main()
