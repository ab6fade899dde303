import datetime
import pathlib
import random
import threading
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyward import Dataset
from tallyward.errors import QuotaExceededError, ResourceLimitError, TenantContextError
from tallyward.operators import audit, evaluation, guards, topn, usage, verify
from tallyward.plans import catalog, steps
from tallyward.plans.catalog import JoinPolicy, generate_metrics
from tallyward.sources import sinks
from tallyward.sources.commits import CommitLog
from tallyward.sources.catalog_store import JOIN_PROPOSALS, METRIC_PROPOSALS, CatalogStore
from tallyward.frames import small_frame
from tallyward.sources.registry import DatasetRegistry
from tests.conftest import values


# ---- first rows per key, quotas -----------------------------------------------------------------------


@pytest.fixture(scope="module")
def skewed(spark):
    """A tenant with a third of all rows, many of them at the same instant."""
    rng = random.Random(5)
    start = datetime.datetime(2024, 1, 1)
    rows = []
    for i in range(3000):
        tenant = "hot" if i % 3 == 0 else f"t{rng.randint(0, 40)}"
        rows.append((i, tenant, start + datetime.timedelta(hours=rng.randint(0, 60))))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "id int, tenant_id string, timestamp timestamp_ntz").repartition(8).cache(), rows


@pytest.mark.parametrize("n", [1, 7, 300])
@pytest.mark.parametrize("threshold", ["1000", "1"])
def test_first_per_key_equals_brute_force(spark, skewed, n, threshold):
    df, rows = skewed
    spark.conf.set(topn.GROUP_LIMIT_SETTING, threshold)  # 1 sends larger n through the salted ranking
    try:
        got = sorted(values(topn.first_per_key(df, ["tenant_id"], [F.desc("timestamp"), F.asc("id")], n), "tenant_id", "id", "position"))
    finally:
        spark.conf.unset(topn.GROUP_LIMIT_SETTING)
    expected = []
    for tenant in {r[1] for r in rows}:
        mine = sorted((r for r in rows if r[1] == tenant), key=lambda r: (-r[2].timestamp(), r[0]))
        expected += [(tenant, r[0], i + 1) for i, r in enumerate(mine[:n])]
    assert got == sorted(expected)


@pytest.mark.parametrize("group_rows", [usage.GROUP_ROWS, 30, 1])
def test_quota_equals_brute_force(spark, skewed, group_rows):
    df, rows = skewed
    limits = spark.createDataFrame([("hot", 100), ("t1", 0), ("t2", 3), ("t3", 5000)], "tenant_id string, daily_limit int")
    own = {"hot": 100, "t1": 0, "t2": 3, "t3": 5000}
    used, accepted, refused = {}, set(), set()
    for i, tenant, ts in sorted(rows, key=lambda r: (r[2], r[0])):
        key = (tenant, ts.date())
        if used.get(key, 0) < own.get(tenant, 10):
            used[key] = used.get(key, 0) + 1
            accepted.add((i, used[key]))
        else:
            refused.add(i)
    got = values(usage.accepted_requests(df, limits, 10, group_rows=group_rows), "id", "request_no")
    assert set(got) == accepted and len(got) == len(accepted)
    over = values(usage.refused_requests(df, limits, 10, group_rows=group_rows), "id")
    assert {r[0] for r in over} == refused and len(over) == len(refused)
    status = usage.quota_status(df, limits, 10).agg(F.sum("accepted"), F.sum("refused")).first()
    assert tuple(status) == (len(accepted), len(refused))


def test_large_quota_of_one_tenant(spark):
    rows = spark.range(5000).select(
        F.expr("timestamp'2024-01-01' + make_dt_interval(0, 0, 0, CAST(id % 977 AS DECIMAL(18,6)))").alias("timestamp"), "id",
        F.when(F.col("id") % 10 > 0, "a").alias("tenant_id"),
    )
    limits = spark.createDataFrame([("a", 3_000_000_000), ("b", 1)], "tenant_id string, daily_limit bigint")
    assert usage.refused_requests(rows.where("tenant_id = 'a'"), limits, 2).count() == 0
    assert usage.accepted_requests(rows, limits, 2).groupBy("tenant_id").count().where("tenant_id IS NULL").first()["count"] == 2
    assert usage.refused_requests(rows, limits, 2).count() == 498


@pytest.mark.parametrize("spread", ["CAST(id % 59 AS DECIMAL(18,6))", "0"])
def test_one_minute_of_one_tenant_is_put_in_order_in_parts(spark, spread):
    """A million rows, over the minute or at one instant; no part has three times the rows of the middle one."""
    rows = spark.range(0, 1_000_000, 1, 8).selectExpr(f"timestamp'2024-01-01' + make_dt_interval(0, 0, 0, {spread}) AS timestamp", "id", "'a' AS tenant_id")
    begun = usage._begun(rows, None, 10**9, "timestamp", "id", 100_000)
    sizes = sorted(r["count"] for r in begun.groupBy("_slot").count().collect())
    assert sum(sizes) == 1_000_000 and len(sizes) > 25 and sizes[-1] < 3 * sizes[len(sizes) // 2] and sizes[-1] < 100_000
    taken = usage.accepted_requests(rows, None, 10**9, group_rows=100_000)
    lag = Window.orderBy("request_no")
    assert taken.agg(F.count_distinct("request_no"), F.min("request_no"), F.max("request_no")).first() == (1_000_000, 1, 1_000_000)
    wrong = taken.select("id", "timestamp", F.lag("timestamp").over(lag).alias("t"), F.lag("id").over(lag).alias("i"))
    assert wrong.where("t > timestamp OR t = timestamp AND i >= id").count() == 0


def test_slots_of_rows_without_id_or_tenant(spark):
    rows = spark.range(1000).selectExpr("timestamp'2024-01-01' AS timestamp", "IF(id % 3 = 0, NULL, id) AS id", "IF(id % 2 = 0, NULL, 'a') AS tenant_id")
    got = usage.accepted_requests(rows, None, 400, group_rows=50)
    assert sorted(values(got.groupBy("tenant_id").agg(F.count_distinct("request_no").alias("n"), F.max("request_no").alias("m")), "n", "m")) == [(400, 400)] * 2
    assert got.where("id IS NULL").count() == 334  # they come first
    assert usage.refused_requests(rows, None, 400, group_rows=50).count() == 200


def test_map_inside_a_struct(spark):
    df = spark.range(40).select((F.col("id") % 3).alias("k"), F.struct(F.create_map(F.lit("a"), F.col("id")).alias("m")).alias("s"), "id")
    spark.conf.set(topn.GROUP_LIMIT_SETTING, 1)
    try:
        assert topn.first_per_key(df, ["k"], [F.asc("id")], 2).count() == 6
    finally:
        spark.conf.unset(topn.GROUP_LIMIT_SETTING)


def test_quota_without_limits(skewed):
    df, rows = skewed
    assert usage.accepted_requests(df, None, 10**6).count() == len(rows)
    assert usage.refused_requests(df, None, 10**6).count() == 0
    with pytest.raises(QuotaExceededError):
        usage.check_quota(5, 5, "t")
    usage.check_quota(4, 5, "t")


def test_upsert_replaces_by_key(spark):
    old = spark.createDataFrame([(1, "a", "x"), (1, "b", "y")], "id int, f string, v string")
    new = spark.createDataFrame([(1, "b", "z"), (2, "a", "w")], "id int, f string, v string")
    assert sorted(values(topn.upsert(old, new, ["id", "f"]))) == [(1, "a", "x"), (1, "b", "z"), (2, "a", "w")]


# ---- guards -------------------------------------------------------------------------------------------


def test_row_cap(spark):
    df = spark.range(10)
    assert values(guards.cap_rows(df, 4, [F.desc("id")])) == [(9, True), (8, True), (7, True), (6, True)]
    assert {r["truncated"] for r in guards.cap_rows(df, 10).collect()} == {False}
    assert guards.cap_rows(df, 10).count() == 10 and guards.cap_rows(df, 0).count() == 10
    assert guards.original_rows(df).first()[0] == 10


def test_tenant_is_mandatory(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "tenant_id string, x int")
    assert values(guards.tenant_scope(df, " a ")) == [("a", 1)]
    for blank in (None, "", "  "):
        with pytest.raises(TenantContextError):
            guards.tenant_scope(df, blank)
    with pytest.raises(PermissionError):
        guards.require_tenant(None)


def test_steps_are_capped():
    assert guards.cap_steps([1, 2, 3, 4]) == [1, 2, 3] and guards.cap_steps([1, 2], 1) == [1]


def test_timeout_cancels(spark):
    slow = spark.range(0, 10**12, 1, 8).selectExpr("sum(id % 7 * sqrt(id))")
    with pytest.raises(ResourceLimitError):
        guards.run_with_timeout(spark, slow.collect, 1)
    assert guards.run_with_timeout(spark, lambda: spark.range(3).count(), 60) == 3
    assert guards.run_with_timeout(spark, lambda: 5, 0) == 5


# ---- audit and telemetry ------------------------------------------------------------------------------


def audit_rows(spark):
    rows = [
        {"id": 1, "username": "ann", "role": "admin", "action_type": "QUERY", "details": {"q": "x", "token": "s"}, "tenant_id": "a"},
        {"id": 2, "username": "bob", "role": "analyst", "action_type": "LOGIN", "details": {}, "tenant_id": "b"},
        {"id": 3, "username": "ann", "role": "admin", "action_type": "ERROR", "details": {"note": 'say "hi", now'}, "tenant_id": "a"},
    ]
    schema = "id bigint, username string, role string, action_type string, details map<string,string>, tenant_id string"
    return small_frame(spark, rows, schema).withColumn("ip_address", F.lit("127.0.0.1"))


def test_audit_round_trip(spark, folder):
    now = F.lit("2024-03-10 00:00:00").cast("timestamp")
    sinks.append_audit(audit_rows(spark), f"{folder}/audit", now)
    stored = sinks.read_audit(spark, f"{folder}/audit")
    assert values(stored.orderBy("id"), "id", "details") == [(1, '{"q":"x"}'), (2, None), (3, '{"note":"say \\"hi\\", now"}')]
    assert "PartitionFilters: [isnotnull(tenant_id" in guards.tenant_scope(stored, "a")._jdf.queryExecution().toString()
    sinks.export_audit(stored, f"{folder}/csv", "a", now, file_format="csv")
    back = spark.read.option("header", True).option("escape", '"').csv(f"{folder}/csv")
    assert back.columns == list(audit.EXPORT_COLUMNS)
    assert values(back, "id", "details") == [("3", '{"note":"say \\"hi\\", now"}'), ("1", '{"q":"x"}')]
    sinks.export_audit(stored, f"{folder}/json", "a", now)
    assert spark.read.json(f"{folder}/json").count() == 2
    with pytest.raises(ValueError):
        sinks.export_audit(stored, f"{folder}/x", "a", now, file_format="xml")


def test_unknown_action_writes_nothing(spark, folder):
    bad = audit_rows(spark).withColumn("action_type", F.when(F.col("id") == 2, "PEEK").otherwise(F.col("action_type")))
    with pytest.raises(ValueError):
        sinks.append_audit(bad, f"{folder}/audit")
    with pytest.raises(Exception):
        spark.read.parquet(f"{folder}/audit")


def test_search_page_and_lookback(spark):
    rows = audit.sanitize(audit_rows(spark)).withColumn("timestamp", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(CAST(id AS INT))"))
    assert [r["id"] for r in audit.search(rows, username="ann", action_type="ERROR", tenant_id="a").collect()] == [3]
    assert audit.search(rows).count() == 3
    assert [r["id"] for r in audit.page(rows, 1, 1).collect()] == [2]
    now = F.expr("timestamp_ntz'2024-01-04 00:00:00'")
    assert sorted(r["id"] for r in audit.since(rows, now, 1).collect()) == [2, 3]
    counts = {(r["section"], r["key"]): r["n"] for r in audit.stats(rows).collect()}
    assert counts[("total", None)] == 3 and counts[("user", "ann")] == 2 and counts[("action", "LOGIN")] == 1


def test_telemetry_round_trip(spark, folder):
    events = small_frame(
        spark, [{"timestamp": "2024-01-01T00:00:00", "tenant_id": t, "event_type": "ask", "details": {"n": "1"}} for t in ("a", "b", "a")],
        sinks.TELEMETRY_SCHEMA,
    )
    for file_format in ("parquet", "json"):
        path = f"{folder}/{file_format}"
        sinks.append_telemetry(events, path, file_format)
        sinks.append_telemetry(events, path, file_format)
        assert guards.tenant_scope(sinks.read_telemetry(spark, path, file_format), "a").count() == 4


# ---- sessions and evaluation --------------------------------------------------------------------------


def test_day_text(spark):
    row = spark.range(1).select(usage.day_text(F.lit("2024-03-05 23:59:59").cast("timestamp_ntz"))).first()
    assert row[0] == "2024-03-05"


def test_session_context(spark):
    turns = spark.createDataFrame([("s", i, f"q{i}", "t" if i % 2 else None) for i in range(8)], "sid string, turn int, q string, target string")
    line = usage.turn_line(F.col("q"), F.lit("stats_tool"), F.col("target"), F.lit("region"), F.lit(None).cast("string"))
    text = usage.session_context(turns, "sid", "turn", line).first()["context"].split("\n")
    assert text[0] == "Previous question: 'q3' -> used stats_tool on 't' grouped by 'region'"
    assert text[1] == "Previous question: 'q4' grouped by 'region'" and len(text) == 5


def test_grading(spark):
    expect = "struct<plan_types_allowed: array<string>, must_include_numbers: boolean, forbidden_substrings: array<string>, check_pii: boolean>"
    refuse, answer = ["no_match", "propose_metric"], ["single_metric"]
    rows = [
        {"id": "s1", "plan_type": "single_metric", "answer": "Total is 5", "expect": {"plan_types_allowed": answer, "must_include_numbers": True}},
        {"id": "s2", "plan_type": "no_match", "answer": "none", "expect": {"plan_types_allowed": answer, "must_include_numbers": True}},
        {"id": "a1", "plan_type": None, "answer": "I don't know", "expect": {"plan_types_allowed": refuse, "forbidden_substrings": ["KNOW"]}},
        {"id": "a2", "plan_type": None, "answer": "sure", "expect": {"plan_types_allowed": refuse}},
        {"id": "p1", "plan_type": "no_match", "answer": "mail a.b@c.org", "expect": {"check_pii": True}},
        {"id": "p2", "plan_type": "no_match", "answer": None, "error": "E: x", "payload_leak": "Bob Smith", "expect": {"check_pii": True}},
    ]
    runs = small_frame(spark, rows, f"id string, plan_type string, answer string, confidence string, error string, payload_leak string, expect {expect}")
    graded = {r["id"]: (r["pass"], r["reasons"]) for r in evaluation.grade(runs).collect()}
    assert graded["s1"] == (True, [])
    assert graded["s2"] == (False, ["plan_type=no_match not in [single_metric]", "no_numbers_in_answer"])
    assert graded["a1"] == (False, ["forbidden_substring_in_answer: KNOW"])
    assert graded["a2"] == (False, ["plan_type=unknown not in [no_match, propose_metric]"])
    assert graded["p1"] == (False, ["pii_leak_in_answer"])
    assert graded["p2"] == (False, ["error: E: x", "pii_leak_in_llm_payload: Bob Smith"])
    summary = evaluation.trust_summary(evaluation.grade(runs)).first()
    assert (summary["total"], summary["passed"], summary["pii_leak_count"], summary["pii_leak_rate"]) == (6, 1, 2, 1.0)
    assert (summary["error_count"], summary["refusal_correctness"], summary["pass_rate"]) == (1, 0.0, 0.1667)


# ---- catalog and steps --------------------------------------------------------------------------------


@pytest.fixture()
def store(spark, folder):
    return CatalogStore(spark, folder, "acme")


def test_seed_once_and_versions(spark, store, orders):
    generated = catalog.catalog_frame(spark, Dataset("data", orders).metrics)
    assert store.seed(generated) == generated.count() and store.seed(generated) == 0
    store.save(store.load().where("agg = 'sum'"), note="only sums")
    assert [(r["version"], r["label"], r["note"]) for r in store.versions().collect()] == [(2, "v002", "only sums"), (1, "v001", "auto-seed from datasource")]
    assert store.load(version=1).count() == generated.count() > store.load().count()
    assert {m.agg for m in catalog.definitions(store.load()).values()} == {"sum"}


def proposal(spark, key="p1", name="net", agg="sum"):
    metric = {"name": name, "column": "revenue", "agg": agg, "description": "d", "status": "pending"}
    return small_frame(spark, [{"proposal_id": key, "metric": metric, "question": "q", "reason": "r", "proposed_by": "ann"}], METRIC_PROPOSALS)


def test_approval_life_cycle(spark, store):
    store.propose(proposal(spark))
    store.propose(proposal(spark, "p2", "gross"))
    assert catalog.pending_only(store.load("metric_proposals")).count() == 2 and store.load().count() == 0
    store.approve("p1", "boss", "fine")
    approved = store.load().first()
    assert (approved["name"], approved["status"], approved["approved_by"], approved["source"], approved["proposal_id"]) == ("net", "approved", "boss", "proposed", "p1")
    assert approved["approved_at"] is not None
    with pytest.raises(ValueError):
        store.approve("p1", "boss")
    store.reject("p2", "no")
    with pytest.raises(ValueError):
        store.approve("p2", "boss")
    states = {r["proposal_id"]: (r["status"], r["review_note"]) for r in store.load("metric_proposals").collect()}
    assert states == {"p1": ("approved", "fine"), "p2": ("rejected", "no")}
    store.propose(proposal(spark, "p3", "net", "max"))
    store.approve("p3", "boss")
    assert [r["agg"] for r in store.load().collect()] == ["max"]


def test_tenants_do_not_share_a_catalog(spark, folder):
    one, two = CatalogStore(spark, folder, "one"), CatalogStore(spark, folder, "two")
    one.propose(proposal(spark))
    assert two.load("metric_proposals").count() == 0
    with pytest.raises(TenantContextError):
        CatalogStore(spark, folder, " ")


def test_an_unfinished_version_is_not_seen(spark, store, orders):
    generated = catalog.catalog_frame(spark, generate_metrics(Dataset("data", orders).profile))
    store.seed(generated)
    generated.limit(1).write.parquet(f"{store.root}/metrics/version=2")  # a save that died before its version row
    assert store.latest_version() == 1 and store.load().count() == generated.count()
    assert store.save(generated.limit(3)) == 2 and store.load().count() == 3


def test_writers_at_the_same_time_lose_nothing(spark, folder):
    stores = [CatalogStore(spark, folder, "acme") for _ in range(4)]
    start = threading.Barrier(len(stores))

    def add(number):
        start.wait()
        stores[number].propose(proposal(spark, f"p{number}", f"m{number}"))
        return stores[number].save(stores[number].load("metrics"))

    with ThreadPoolExecutor(len(stores)) as pool:
        found = list(pool.map(add, range(len(stores))))
    assert sorted(found) == [1, 2, 3, 4] == sorted(r["version"] for r in stores[0].versions("metric_proposals").collect())
    assert sorted(r["proposal_id"] for r in stores[0].load("metric_proposals").collect()) == ["p0", "p1", "p2", "p3"]
    assert [stores[0].load("metric_proposals", v).count() for v in (1, 2, 3, 4)] == [1, 2, 3, 4]


def test_two_approvals_at_once(spark, folder):
    store = CatalogStore(spark, folder, "acme")
    store.propose(proposal(spark, "p1", "net"))
    store.propose(proposal(spark, "p2", "gross"))
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda key: CatalogStore(spark, folder, "acme").approve(key, "boss"), ("p1", "p2")))
    assert sorted(r["name"] for r in store.load().collect()) == ["gross", "net"]
    assert {r["status"] for r in store.load("metric_proposals").collect()} == {"approved"}


def test_commits_are_put_once(spark, folder):
    log = CommitLog(spark, f"{folder}/log")
    assert log.numbers() == [] and log.last() is None and log.read(1) is None
    assert log.put(1, {"a": "é"}) and not log.put(1, {"a": 2}) and log.put(12, {})
    assert log.read(1) == {"a": "é"} and log.numbers() == [1, 12] and (log.last(), log.last(12), log.last(1)) == (12, 1, None)
    with ThreadPoolExecutor(8) as pool:
        assert sum(pool.map(lambda n: CommitLog(spark, f"{folder}/log").put(20, {"n": n}), range(8))) == 1
    assert [p.name for p in pathlib.Path(f"{folder}/log").iterdir() if p.name.startswith("_")] == []


def test_join_life_cycle(spark, store):
    policy = {"name": "oc", "left_table": "orders", "right_table": "customers", "left_key": "customer_id", "right_key": "customer_id", "join_type": "inner", "status": "pending"}
    rows = [{"proposal_id": k, "join": policy} for k in ("j1", "j2")]
    store.propose(small_frame(spark, rows, JOIN_PROPOSALS), "join")
    store.approve_join("j1", "boss")
    store.reject_join("j2", "twice")
    from tallyward.operators.joins import policy_rows

    assert policy_rows(store.load("joins"))["oc"].status == "approved"
    with pytest.raises(ValueError):
        store.approve_join("j2", "boss")


def test_validated_proposals(spark, orders):
    rows = [("a", "revenue", "sum", None), ("b", "price", "sum", None), ("c", "revenue", "median", None), ("d", "revenue", "sum", "city"), ("e", "revenue", "sum", "")]
    frame = spark.createDataFrame(rows, "id string, `column` string, agg string, groupby string")
    columns = spark.createDataFrame([(c,) for c in orders.columns], "name string")
    got = dict(values(catalog.validate_proposals(frame, columns), "id", "problem"))
    assert got == {"a": None, "b": "column", "c": "agg", "d": "groupby", "e": None}


def test_merge_prefers_generated(spark):
    schema = "name string, description string"
    mine = spark.createDataFrame([("a", "mine"), ("b", "mine")], schema)
    auto = spark.createDataFrame([("b", "auto"), ("c", "auto")], schema)
    assert sorted(values(catalog.merge_catalogs(mine, auto))) == [("a", "mine"), ("b", "auto"), ("c", "auto")]


def test_plan_is_refused_whole(spark, orders):
    data = Dataset("data", orders)
    Step = steps.Step
    good, bad = Step("total_revenue", filters={"region": "South", "revenue": 1}), Step("total_price")
    with pytest.raises(steps.RefusedPlan):
        steps.run_plan(data, [good, bad])
    with pytest.raises(steps.RefusedPlan):
        steps.run_plan(data, [Step("drop_table", "run_stats")])
    with pytest.raises(steps.RefusedPlan):
        steps.run_plan(data, [Step("total_revenue", join_policy="secret")])
    # order_date and few-valued revenue are filterable, so a filter on a column outside the list is the only one dropped.
    results = steps.run_plan(data, [Step("total_revenue", filters={"region": "South", "nope": 1})] * 4)
    assert len(results.results) == 3 and values(results.results[0][1]) == [(600.0, False)]
    assert [s.target for s in results.left_out] == ["total_revenue"]
    checks = results.checks.orderBy("step").collect()
    assert [c["lineage"]["notes"] for c in checks] == ["filters not allowed: nope"] * 3
    assert checks[0]["lineage"]["filters_applied"] == {"region": "South"} and checks[0]["source_rows"] == 6
    assert steps.expected_total(data, Step("revenue_by_region"), data.metrics).first()[0] == 1400.0
    assert steps.expected_total(data, Step("total_revenue"), data.metrics) is None
    trend = Step("trend", "run_stats", args={"date_col": "order_date", "value_col": "revenue"})
    assert steps.expected_total(data, trend, data.metrics).first()[0] == 1400.0
    run = steps.run_plan(data, [Step("revenue_by_region"), trend], max_rows=3)
    first, second = run.checks.orderBy("step").collect()
    # Three of four regions do not add up to the total, nor do three of six months.
    assert first["flags"] == ["breakdown_total_mismatch:revenue_by_region", "result_truncated:revenue_by_region"]
    assert (first["breakdown_sum"], first["expected_total"], first["confidence"]) == (1250.0, 1400.0, "low")
    assert second["truncated"] and second["confidence"] == "low"
    whole = steps.run_plan(data, [Step("revenue_by_region")])
    assert [tuple(r) for r in whole.checks.select("flags", "confidence", "passed").collect()] == [([], "high", True)]
    assert steps.run_plan(data, []).checks.count() == 0


def test_steps_over_a_join(spark, orders):
    customers = spark.createDataFrame([(10, "gold"), (20, "iron"), (30, "gold"), (40, "iron")], "customer_id bigint, tier string")
    registry = DatasetRegistry()
    registry.register_table("orders", orders)
    registry.register_table("customers", customers)
    policies = {"oc": JoinPolicy("oc", "orders", "customers", "customer_id", "customer_id", status="approved")}
    data = Dataset("data", orders)
    metric = steps.run_step(data, steps.Step("revenue_by_tier", join_policy="oc"), None, registry, policies)
    assert values(metric) == [("gold", 700.0), ("iron", 700.0)]
    tool = steps.Step("group_compare", "run_stats", args={"value_col": "revenue", "group_col": "tier", "agg": "max"}, join_policy="oc")
    run = steps.run_plan(data, [tool], None, registry, policies)
    assert values(run.results[0][1]) == [("iron", 400.0, False), ("gold", 250.0, False)]
    registry.register_table("customers", customers.withColumn("customer_name", F.lit("alice smith")))
    names = steps.Step("value_counts", "run_stats", args={"column": "customer_name"}, join_policy="oc")
    shown = values(steps.run_plan(data, [names], None, registry, policies).results[0][1], "value")
    assert len(shown) == 1 and "alice" not in str(shown)


# ---- results as delivered -----------------------------------------------------------------------------


def test_checks_are_of_the_rows_delivered(spark, folder, orders):
    data = Dataset("data", orders)
    wanted = [steps.Step("revenue_by_region"), steps.Step("total_revenue", filters={"region": "North"}), steps.Step("describe", "run_stats")]
    run = steps.run_plan(data, wanted, max_rows=3)
    given = []

    def sink(number, step, frame):
        given.append((number, step.target))
        frame.write.parquet(f"{folder}/{number}")
        return spark.read.parquet(f"{folder}/{number}")

    done = run.deliver(sink)
    checks = done.checks.orderBy("step").collect()
    assert given == [(0, "revenue_by_region"), (1, "total_revenue"), (2, "describe")]
    before = run.checks.orderBy("step").collect()
    for name in before[0].asDict():
        assert [r[name] for r in checks] == [r[name] for r in before], name
    assert checks[0]["truncated"] and "breakdown_total_mismatch:revenue_by_region" in checks[0]["flags"] and checks[1]["value"] == 400.0
    assert [r["rows"] for r in checks] == [f.count() for f in done.results]
    for check, frame in zip(checks, done.results):
        assert verify.as_checked(frame, check.asDict())
        altered = frame.limit(0) if "value" not in frame.columns else frame.withColumn("value", F.col("value") + 0.01)
        assert not verify.as_checked(altered, check.asDict())


def test_a_result_is_run_once(spark):
    """Every run of this table gives other numbers, so that a check on a second run would not fit."""
    rows = spark.range(1000).select(F.concat(F.lit("k"), F.col("id") % 5).alias("kind"), (F.unix_micros(F.current_timestamp()) % 100_003 + F.col("id") / 7).alias("amount"))
    run = steps.run_plan(Dataset("data", rows), [steps.Step("amount_by_kind")])
    done = run.deliver(lambda number, step, frame: frame.collect())
    (check,) = done.checks.collect()
    assert check["breakdown_sum"] == pytest.approx(sum(r["value"] for r in done.results[0]), rel=1e-12)
    assert check["flags"] == ["breakdown_total_mismatch:amount_by_kind"] and check["confidence"] == "low"
    assert run.deliver(lambda *_: _[2].collect()).checks.first()["fingerprint"] != check["fingerprint"]


def test_an_empty_plan_delivers_nothing(spark, orders):
    done = steps.run_plan(Dataset("data", orders), []).deliver(lambda *_: None)
    assert done.results == () and done.checks.count() == 0


# ---- pages --------------------------------------------------------------------------------------------


def test_pages_after_a_place_equal_offsets(spark):
    random.seed(2)
    rows = [(random.choice([None, 1, 2, 3]), random.choice([None, "a", "b"]), i) for i in range(60)]
    frame = spark.createDataFrame(rows, "x int, y string, id int").repartition(3)
    for order in ([("x", True), ("y", False), ("id", True)], [("id", True)], [("y", True), ("id", False)]):
        sort = [F.desc_nulls_last(n) if d else F.asc_nulls_last(n) for n, d in order]
        after, got = None, []
        while page := values(topn.page_after(frame, order, after, 7)):
            got += page
            after = [dict(zip(frame.columns, page[-1]))[n] for n, _ in order]
        assert got == values(frame.orderBy(*sort)) and len(got) == 60


def test_a_deep_page_reads_what_the_filter_leaves(spark, folder):
    spark.range(1000).write.parquet(f"{folder}/t")
    text = audit.page_before(spark.read.parquet(f"{folder}/t"), 20)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(id,20)" in text and "TakeOrderedAndProject" in text
