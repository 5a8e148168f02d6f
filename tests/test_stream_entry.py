import os

from pyspark.sql import functions as F

import __spark_entry__ as E
from ledgerlake.operators import changes as C
from ledgerlake.operators import metrics as M
from ledgerlake.session import scratch_path
from ledgerlake.sources.store import TableStore
from ledgerlake.streaming import change_feed as CF
from tests.conftest import changes, make
from tests.test_changes import BASE, full

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch_and_replay_is_skipped(spark):
    cur = make(spark, "projects", BASE)
    inv = make(spark, "invoices", [dict(id=1, invoice_no="i", project_name="p", payment_status="入金済", amount=3)])
    emps = make(spark, "employees", [dict(id=1, name="山田 太郎")])
    rows = [(1, "update", 1, full(status="契約済", contract_amount=5, staff="山田")), (2, "delete", 2, None),
            (3, "create", None, full(name="n", status="商談中", estimate_amount=8)), (4, "assign_staff", 3, dict(staff="鈴木"))]
    ch = changes(spark, "projects", rows)
    root = scratch_path(spark, "stream-test")
    store = TableStore(spark, root + "/store")
    store.publish({"projects": cur, "invoices": inv, "employees": emps}, hwms={"projects": 9, "employees": 1})
    feed = CF.to_feed(ch, "projects").unionByName(
        CF.to_feed(changes(spark, "employees", [(5, "delete", 1, None)]), "employees"))
    # two arrivals in order (one file each): seq 1-2, then seq 3-5
    feed.where(F.col("seq") <= 2).coalesce(1).write.json(root + "/feed")
    feed.where(F.col("seq") > 2).coalesce(1).write.mode("append").json(root + "/feed")
    CF.run_change_feed(spark, root + "/feed", store, root + "/ckpt")
    got = {r["id"]: r["staff"] for r in store.read("projects").collect()}
    batch, _ = C.apply_change_set(cur, ch, "projects", hwm=9)
    expected = {r["id"]: (None if r["staff"] == "山田" else r["staff"]) for r in batch.collect()}
    assert got == expected and 10 in got
    assert store.read("employees").count() == 0
    assert CF.published_kpis(store).first()["total_projects"] == 4
    version = store.versions()[-1]
    assert CF.apply_batch(store, feed, 0, feed=root + "/ckpt") is None and store.versions()[-1] == version


def test_refused_changes_are_published(spark):
    store = TableStore(spark, scratch_path(spark, "stream-rejects"))
    store.publish({"projects": make(spark, "projects", BASE), "customers": make(spark, "customers", [dict(id=1, name="k")])})
    row = lambda t, seq, op, i, p: (t, seq, op, i, p)
    ok = '{"name":"n","customer_name":"c","status":"商談中"%s}'
    batch = [row("projects", 10, "assign_staff", 1, '{"staff":"X'), row("projects", 11, "update", 1, ok % ',"estimate_amount":"abc"'),
             row("nowhere", 12, "delete", 1, None), row(None, 13, "delete", 1, None), row("projects", 14, "delete", 777, None),
             row("projects", 100, "assign_staff", 1, '{"staff":"late"}'), row("customers", 15, "assign_staff", 1, '{"staff":"x"}'),
             row("invoices", 16, "delete", 1, None)]
    df = spark.createDataFrame(batch, CF.FEED_SCHEMA)
    assert CF.apply_batch(store, df, 0, "a") is not None
    got = {(r.table, r.seq): r.reason for r in store.read("rejects").collect()}
    assert got == {("projects", 10): "bad_payload", ("projects", 11): "bad_payload", ("nowhere", 12): "bad_table", (None, 13): "bad_table",
                   ("projects", 14): "unknown_id", ("customers", 15): "bad_op", ("invoices", 16): "bad_table"}
    # an older seq in a later batch is stale; a second feed counts its own batches
    second = spark.createDataFrame([row("projects", 5, "assign_staff", 1, '{"staff":"old"}'), row("projects", 101, "delete", 2, None)], CF.FEED_SCHEMA)
    assert CF.apply_batch(store, second, 0, "a") is None
    assert CF.apply_batch(store, second, 0, "b") is not None
    staff = {r.id: r.staff for r in store.read("projects").collect()}
    assert staff[1] == "late" and 2 not in staff
    assert [(r.feed, r.seq) for r in store.read("rejects").where("reason = 'stale'").collect()] == [("b", 5)]


def test_store_survives_a_torn_manifest_and_never_reuses_ids(spark):
    store = TableStore(spark, scratch_path(spark, "store-torn"))
    store.publish({"projects": make(spark, "projects", BASE)})
    top = store.hwm("projects")
    assert top == max(r["id"] for r in BASE)
    spark.range(1).write.parquet(store.root + "/projects/L0-torn")  # a crash before its version was claimed
    feed = lambda *rows: spark.createDataFrame(list(rows), CF.FEED_SCHEMA)
    CF.apply_batch(store, feed(("projects", 1, "delete", top, None)), 0)
    CF.apply_batch(store, feed(("projects", 2, "create", None, '{"name":"n","customer_name":"c"}')), 1)
    assert store.versions() == [1, 2, 3] and {r.id for r in store.read("projects").collect()} >= {top + 1}


def test_entry_and_registry(spark):
    df = E.entry(spark)
    assert df.columns == ["rank", "staff", "total", "contracted", "revenue", "win_rate", "revenue_share"]
    assert df.count() > 0
    qs, sqls = E.queries(), E.oracle_sql()
    assert set(sqls) <= set(qs)
    assert len(qs) >= 40


def test_registered_queries_run_on_smoke_data(spark):
    qs = E.queries()
    for key in ("kpi_summary", "employee_workload", "validate_changes", "reconcile_kpis"):
        assert qs[key](spark, SF).count() > 0, key
    assert M.KPI_COLUMNS == tuple(qs["kpi_summary"](spark, SF).columns)
    assert os.path.isdir(SF)
    assert qs["project_by_id"](spark, SF).where(F.col("id") == 1234).count() in (0, 1)


def test_batches_do_not_grow_in_number_with_the_feed(spark, monkeypatch):
    from ledgerlake.plans import registry as R
    few = R._streamed(spark, E.SMOKE_DIR)
    monkeypatch.setattr(R, "ROWS_PER_FILE", 100)  # more than three files
    many = R._streamed(spark, E.SMOKE_DIR)
    assert len(many.versions()) == len(few.versions()) == 1 + 3
    facts = lambda s: sorted(map(tuple, s.read(CF.REJECTS).select("table", "seq", "op", "id", "verdict", "reason").collect()), key=str)
    assert facts(many) == facts(few)
    assert CF.published_kpis(many).collect() == CF.published_kpis(few).collect() == CF.incremental_kpis(many).collect()
