"""Edges between watch apps and phone apps, against all pairs; no watch app meets all phone apps."""

import random

from pyspark.sql import functions as F

from archspark.operators import relationships

COMPS = "repo string, id string, path string, name string, type string, ord struct<kind:int,path:string>"


def apps(spark, rows):
    return spark.createDataFrame([(r, p, p, n, t, (k, p)) for r, p, n, t, k in rows], COMPS)


def measured(df, metric, *kinds):
    """Values of a metric of the executed plan's operators of some kinds."""
    df.collect()
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            todo += [node.children().apply(i) for i in range(node.children().size())]
            if any(k in name for k in kinds) and node.metrics().contains(metric):
                found.append(node.metrics().apply(metric).value())
    return found


def some_apps(seed):
    rng = random.Random(seed)
    names = ["Run", "Run Watch", "watch", "Runner", "Tide watch", "My Tide", "Zz", "Watch Zz"]
    return sorted({(rng.choice("rs"), f"{rng.choice('abcd')}/{i}", rng.choice(names), rng.choice(["watch-app", "ios-client", "module"]), rng.randrange(2)) for i in range(60)})


def test_companions_are_those_of_all_pairs(spark):
    for seed in range(3):
        rows = [*some_apps(seed), ("only watches", "a/1", "Run", "watch-app", 0)]
        want = set()
        for r, p, n, t, _ in rows:
            phones = [x for x in rows if x[0] == r and x[3] == "ios-client"]
            if t == "watch-app" and phones:
                core = n.lower().replace(" watch", "").replace("watch", "").strip()
                best = min(phones, key=lambda x: (not (x[1].split("/")[0] == p.split("/")[0] or core in x[2].lower()), x[4], x[1]))
                want.add((r, p, best[1]))
        got = relationships.companion_edges(apps(spark, rows)).select("repo", "source", "target").collect()
        assert len(got) == len(want) and {tuple(x) for x in got} == want


def test_a_watch_app_does_not_meet_all_phone_apps(spark):
    rows = [("r", f"g{i % 7}/{i}", f"App {i}", "watch-app" if i % 2 else "ios-client", 0) for i in range(800)]
    found = relationships.companion_edges(apps(spark, rows).repartition(3))
    assert max(measured(found, "numOutputRows", "Join")) <= 800


def test_watch_connections_are_those_of_all_pairs(spark):
    rng = random.Random(4)
    rows = some_apps(9)
    files = [(r, p, f"{p}/{rng.randrange(9)}.swift", "swift", rng.choice([["WatchConnectivity"], ["SwiftUI"]])) for r, p, _, _, _ in rows for _ in range(2)]
    want = {}
    for r, p, _, t, _ in rows:
        mine = [f for q, o, f, _, used in files if (q, o) == (r, p) and "WatchConnectivity" in used]
        for q, p2, _, t2, k2 in rows if mine else []:
            if q == r and {t, t2} == {"watch-app", "ios-client"}:
                key, at = (r, *((p, p2) if t == "watch-app" else (p2, p))), (min(mine), f"{k2}:{p2}")
                want[key] = min(want.get(key, at), at)
    table = spark.createDataFrame(files, "repo string, owner string, path string, language string, imports array<string>")
    got = relationships.watch_edges(table, apps(spark, rows)).select("repo", "source", "target", "at.k0", "at.k1").collect()
    assert len(got) == len(want) and {tuple(x[:3]): tuple(x[3:]) for x in got} == want


def test_pairs_of_apps_do_not_leave_tasks(spark):
    rows = [("r", f"g/{i}", f"App {i}", "watch-app" if i % 2 else "ios-client", 0) for i in range(1200)]
    files = apps(spark, rows).select("repo", "path", F.lit("swift").alias("language"), F.array(F.lit("WatchConnectivity")).alias("imports")).withColumn("owner", F.col("path"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = relationships.watch_edges(files, apps(spark, rows).repartition(3))
        sent = measured(found, "shuffleRecordsWritten", "ShuffleExchange")
        assert found.count() == 600 * 600 and max(sent) <= 1200 * relationships.PAIR_BLOCKS
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
