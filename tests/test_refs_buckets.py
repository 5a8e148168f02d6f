"""Rows addressed by ref in the set that creates them, and stores that rewrite only touched buckets."""

import os

from pyspark.sql import functions as F

from ledgerlake import schemas as S
from ledgerlake.operators import changes as C
from ledgerlake.operators import filters as P
from ledgerlake.operators import metrics as M
from ledgerlake.session import scratch_path
from ledgerlake.sources.store import TableStore, bucket_of
from ledgerlake.streaming import change_feed as CF
from tests.conftest import make
from tests.test_changes import BASE, full


def ref_changes(spark, table, rows):
    """A change set from (seq, op, id, ref, payload-dict) tuples."""
    fields = S.payload_schema(table).fields
    schema = S.change_schema(table).add("ref", "string")
    return spark.createDataFrame(
        [(seq, op, i, None if p is None else tuple(p.get(f.name) for f in fields), ref) for seq, op, i, ref, p in rows], schema)


def test_refs_in_one_set(spark):
    rows = [(1, "assign_staff", None, "a", dict(staff="early")),       # before its create
            (2, "create", None, "a", full(name="A", staff="山田")),
            (3, "assign_staff", None, "a", dict(staff="鈴木")),
            (4, "create", None, "a", full(name="again")),
            (5, "update", None, "a", full(name="A2", staff="佐藤", status="契約済")),
            (6, "create", None, "b", full(name="B")),
            (7, "delete", None, "b", None),
            (8, "update", None, "b", full()),                          # after its delete
            (9, "delete", None, "zz", None),                           # no such ref
            (10, "create", None, "bad", full(name="")),                # rejected: its ref names nothing
            (11, "delete", None, "bad", None),
            (12, "create", None, None, full(name="C")),
            (13, "assign_staff", 1, "a", dict(staff="by id")),          # the id counts
            (14, "delete", None, None, None)]
    cur = make(spark, "projects", BASE)
    new, v = C.apply_change_set(cur, ref_changes(spark, "projects", rows), "projects")
    got = {r.id: r for r in new.collect()}
    assert sorted(got) == [1, 2, 3, 9, 10, 12]                          # 11 was used up by the deleted B
    assert (got[10].name, got[10].staff, got[10].status) == ("A2", "佐藤", "契約済") and got[12].name == "C"
    assert got[1].staff == "by id"
    reasons = {r.seq: (r.verdict, r.reason) for r in v.collect() if r.reason}
    assert reasons == {1: ("unmatched", "unknown_ref"), 4: ("rejected", "duplicate_ref"), 8: ("unmatched", "after_delete"),
                       9: ("unmatched", "unknown_ref"), 10: ("rejected", "required:name"), 11: ("unmatched", "unknown_ref"),
                       14: ("rejected", "missing_id")}
    assert v.count() == len(rows)


def test_refs_without_creates(spark):
    cur = make(spark, "projects", BASE)
    new, v = C.apply_change_set(cur, ref_changes(spark, "projects", [(1, "delete", None, "a", None), (2, "delete", 1, None, None)]), "projects")
    assert sorted(r.id for r in new.collect()) == [2, 3, 9]
    assert {r.seq: r.reason for r in v.collect()} == {1: "unknown_ref", 2: None}


def feed(spark, *rows):
    return spark.createDataFrame(list(rows), CF.STREAM_SCHEMA)


def test_lifecycle_over_four_tables(spark):
    """Create, assign, work through the statuses, bill, pay, and remove: as one batch, then a second."""
    store = TableStore(spark, scratch_path(spark, "lifecycle"))
    store.publish({t: make(spark, t, []) for t in CF.APPLY_ORDER})
    project = '{"name":"roof","customer_name":"Sato","estimate_amount":900,%s}'
    first = [("employees", 1, "create", None, '{"name":"山田 太郎"}', "e1"), ("employees", 2, "create", None, '{"name":"鈴木 一郎"}', "e2"),
             ("customers", 3, "create", None, '{"name":"Sato","staff":"山田"}', "c1"),
             ("projects", 4, "create", None, '{"name":"roof","customer_name":"Sato","estimate_amount":900}', "p1"),
             ("projects", 5, "assign_staff", None, '{"staff":"山田"}', "p1"),
             ("projects", 6, "update", None, project % '"status":"商談中","staff":"山田"', "p1"),
             ("projects", 7, "update", None, project % '"status":"契約済","staff":"山田","contract_amount":1000', "p1"),
             ("invoices", 8, "create", None, '{"invoice_no":"i1","project_name":"roof","amount":600}', "i1"),
             ("invoices", 9, "create", None, '{"invoice_no":"i2","project_name":"roof","amount":400}', "i2"),
             ("invoices", 10, "update", None, '{"invoice_no":"i1","project_name":"roof","amount":600,"payment_status":"入金済"}', "i1"),
             ("projects", 11, "create", None, '{"name":"tmp","customer_name":"x"}', "p2"), ("projects", 12, "delete", None, None, "p2")]
    CF.apply_batch(store, feed(spark, *first), 0)
    assert store.read("rejects").count() == 0
    p = store.read("projects").collect()
    assert [(r.id, r.status, r.staff, r.contract_amount) for r in p] == [(1, "契約済", "山田", 1000)]
    kpis = CF.published_kpis(store).first()
    assert (kpis.contracted_total, kpis.paid_amount, kpis.unpaid_amount, kpis.total_projects) == (1000, 600, 400, 1)
    assert {r.staff: r.revenue for r in M.staff_performance(store.read("projects")).collect()} == {"山田": 1000}
    assert P.project_by_id(store.read("projects"), 1).count() == 1
    # the next batch: refs still hold, the deleted row's id is not given again, the cascade clears both tables
    second = [("employees", 20, "delete", None, None, "e1"), ("projects", 21, "create", None, '{"name":"n","customer_name":"c"}', "p1"),
              ("projects", 22, "create", None, '{"name":"n","customer_name":"c","staff":"鈴木"}', "p3"),
              ("invoices", 23, "update", None, '{"invoice_no":"i2","project_name":"roof","amount":400,"payment_status":"入金済"}', "i2"),
              ("customers", 24, "update", None, '{"name":"Sato K","staff":"鈴木"}', "c1"), ("projects", 5, "delete", None, None, "p1")]
    CF.apply_batch(store, feed(spark, *second), 1)
    assert [(r.id, r.name) for r in store.read("employees").collect()] == [(2, "鈴木 一郎")]
    assert {r.id: r.staff for r in store.read("projects").collect()} == {1: None, 3: "鈴木"}
    assert [(r.name, r.staff) for r in store.read("customers").collect()] == [("Sato K", "鈴木")]
    assert CF.published_kpis(store).first().paid_amount == 1000
    assert {(r.seq, r.reason) for r in store.read("rejects").collect()} == {(21, "duplicate_ref"), (5, "stale")}
    # remove the rest
    last = [("projects", 30, "delete", 1, None, None), ("projects", 31, "delete", None, None, "p3"), ("customers", 32, "delete", None, None, "c1")]
    CF.apply_batch(store, feed(spark, *last), 2)
    assert store.read("projects").count() == 0 and store.read("customers").count() == 0 and store.hwm("projects") == 3


def test_only_touched_buckets_are_rewritten(spark):
    store = TableStore(spark, scratch_path(spark, "buckets"), bucket_ids=10)
    rows = [dict(id=i, name=f"p{i}", customer_name="c", staff="山田" if i == 25 else "鈴木") for i in range(1, 46)]
    store.publish({"projects": make(spark, "projects", rows), "employees": make(spark, "employees", [dict(id=1, name="山田 太郎")])})
    before = store.manifest()["projects"]["buckets"]
    assert sorted(before) == [0, 1, 2, 3, 4] and store.read("projects").count() == 45

    def changed(*batch):
        old = store.manifest()["projects"]["buckets"]
        CF.apply_batch(store, feed(spark, *batch), store.last_batch() + 1)
        now = store.manifest()["projects"]["buckets"]
        return {b for b in old.keys() | now.keys() if old.get(b) != now.get(b)}

    assert changed(("projects", 1, "delete", 12, None, None)) == {1}
    assert changed(("projects", 2, "delete", 10**9, None, None), ("projects", 3, "update", -7, '{"name":"n","customer_name":"c"}', None)) == set()
    assert changed(("projects", 4, "create", None, '{"name":"new","customer_name":"c"}', None)) == {4}       # id 46
    assert changed(*[("projects", 10 + i, "create", None, '{"name":"m","customer_name":"c"}', None) for i in range(5)]) == {4, 5}
    assert changed(("employees", 5, "delete", 1, None, None)) == {2}                                          # the cascade's bucket
    assert {r.id for r in store.read("projects").where("staff is null").collect()} == {25, 46, 47, 48, 49, 50, 51}
    assert changed(*[("projects", 30 + i, "delete", i, None, None) for i in range(30, 40)]) == {3}            # emptied
    assert 3 not in store.manifest()["projects"]["buckets"] and store.read("projects").count() == 45 - 1 + 6 - 10
    assert store.read("rejects").count() == 2


def test_expire_keeps_what_newer_versions_name(spark):
    store = TableStore(spark, scratch_path(spark, "expire"), bucket_ids=10)
    store.publish({"projects": make(spark, "projects", BASE + [dict(id=15, name="p", customer_name="c")])})
    for n in range(3):
        CF.apply_batch(store, feed(spark, ("projects", n, "assign_staff", 1, '{"staff":"s%d"}' % n, None)), n)
    expected = sorted(map(tuple, store.read("projects").collect()), key=lambda r: r[0])
    assert store.versions() == [1, 2, 3, 4]
    folders = lambda v: {p for p in store.manifest(v)["projects"]["buckets"].values()}
    old, live = folders(1) | folders(2) | folders(3), folders(4)
    assert len(old - live) == 3 and len(live) == 2                      # bucket 0 of versions 1 to 3; bucket 1 lives on
    assert store.expire(keep=1) >= 3 and store.versions() == [4]
    assert not any(os.path.exists(p) for p in old - live) and all(os.path.exists(p) for p in live)
    assert sorted(map(tuple, store.read("projects").collect()), key=lambda r: r[0]) == expected
    assert store.expire(keep=1) == 0


def test_bucket_numbers(spark):
    df = spark.sql("select * from values (0L), (9L), (10L), (-1L), (9007199254740993L), (null) t(id)")
    got = {r.id: r.b for r in df.select("id", bucket_of(F.col("id"), 10).alias("b")).collect()}
    assert got == {0: 0, 9: 0, 10: 1, -1: -1, 9007199254740993: 900719925474099, None: -1}
