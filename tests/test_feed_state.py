"""Two writers of a store, duplicate deliveries, cascades across refs and batches, and what a batch reads."""

import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import changes as C
from ledgerlake.session import scratch_path
from ledgerlake.sources import store as store_module
from ledgerlake.sources.store import PublishConflict, TableStore
from ledgerlake.streaming import change_feed as CF
from tests.conftest import changes, make
from tests.test_changes import BASE, full
from tests.test_refs_buckets import feed, ref_changes

CREATE = '{"name":"n%s","customer_name":"c","staff":"%s"}'


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


# --- two writers ---------------------------------------------------------------------
def test_two_writers_from_one_base_keep_both_tables(spark):
    root = scratch_path(spark, "writers")
    one, two = TableStore(spark, root), TableStore(spark, root)
    one.publish({"projects": make(spark, "projects", BASE)})
    first, second = one.snapshot(), two.snapshot()
    assert one.publish({"customers": make(spark, "customers", [dict(id=1, name="a")])}, base=first) == 2
    assert two.publish({"employees": make(spark, "employees", [dict(id=1, name="b")])}, base=second) == 3
    assert set(one.manifest()) == {"projects", "customers", "employees"} and one.versions() == [1, 2, 3]


def test_disjoint_buckets_merge_and_shared_ones_conflict(spark):
    root = scratch_path(spark, "writers-buckets")
    store = TableStore(spark, root, bucket_ids=10)
    rows = [dict(id=i, name=f"p{i}", customer_name="c") for i in (1, 2, 11, 21)]
    store.publish({"projects": make(spark, "projects", rows)})
    base = store.snapshot()
    upper = lambda b: base.read("projects", {b}).withColumn("name", F.upper("name"))
    store.publish({"projects": upper(1)}, replaced={"projects": {1}}, base=base)
    store.publish({"projects": upper(2)}, replaced={"projects": {2}}, base=base)
    assert rows_of(store.read("projects"), "id", "name") == [(1, "p1"), (11, "P11"), (2, "p2"), (21, "P21")]
    for case in (dict(tables={"projects": upper(2)}, replaced={"projects": {2}}),   # a bucket the other one wrote
                 dict(tables={"projects": upper(0)}),                              # the whole table
                 dict(tables={"notes": spark.range(1)}, scanned={"projects"})):     # computed from the whole table
        with pytest.raises(PublishConflict):
            store.publish(base=base, **case)
    assert store.versions() == [1, 2, 3] and "notes" not in store.manifest()


def test_a_claim_is_exclusive_and_appends_add_up(spark):
    store = TableStore(spark, scratch_path(spark, "claims"))
    store.publish({"projects": make(spark, "projects", BASE)})
    other = {"t": dict(schema="{}", paths=["p"], bucket_ids=None, buckets={}, hwm=None, feeds={})}
    assert store._claim(2, other) and not store._claim(2, store.manifest(1)) and store.manifest(2)["t"]["paths"] == ["p"]
    assert not [n for n in os.listdir(store.root + "/_log") if n.startswith(".") and not n.endswith(".crc")]
    other = TableStore(spark, scratch_path(spark, "appends"))
    other.publish({}, append={"log": spark.range(1)})
    base = other.snapshot()
    other.publish({}, append={"log": spark.range(10, 12)}, base=base)
    other.publish({}, append={"log": spark.range(20, 22)}, base=base)
    assert rows_of(other.read("log"), "id") == sorted([(0,), (10,), (11,), (20,), (21,)], key=str)


def test_a_batch_that_meets_another_writer_starts_again(spark, monkeypatch):
    store = TableStore(spark, scratch_path(spark, "retry"))
    store.publish({"projects": make(spark, "projects", BASE)})
    publish, met = TableStore.publish, []

    def interrupted(self, *args, **kw):
        if not met and kw.get("feed") == "a":
            met.append(1)
            CF.apply_batch(store, feed(spark, ("projects", 50, "create", None, CREATE % (1, "x"), None)), 0, "b")
        return publish(self, *args, **kw)

    monkeypatch.setattr(TableStore, "publish", interrupted)
    CF.apply_batch(store, feed(spark, ("projects", 51, "create", None, CREATE % (2, "y"), None)), 0, "a")
    assert rows_of(store.read("projects").where("id > 9"), "id", "name") == [(10, "n1"), (11, "n2")]


def test_paths_stay_few(spark, monkeypatch):
    monkeypatch.setattr(store_module, "FAN", 3)
    store = TableStore(spark, scratch_path(spark, "fan"))
    for n in range(14):
        store.publish({}, append={"log": spark.range(n, n + 1)})
        assert len(store.manifest()["log"]["paths"]) <= 2 * 3
    assert store.read("log").count() == 14 and store.read("log").agg(F.sum("id")).first()[0] == 91


# --- duplicate deliveries ------------------------------------------------------------
def test_one_request_counts_once_in_a_set(spark):
    rows = [(1, "create", None, full(name="a")), (1, "create", None, full(name="a")), (1, "create", None, full(name="a")),
            (2, "update", 1, full(name="v")), (2, "update", 1, full(name="w")), (2, "delete", 1, None), (None, "delete", 2, None),
            (3, "delete", 2, None)]
    new, v = C.apply_change_set(make(spark, "projects", BASE), changes(spark, "projects", rows), "projects")
    # of equal seqs the smallest (op, id, payload) stands: the delete
    assert rows_of(new, "id", "name") == [(10, "a"), (3, "p3"), (9, "p9")]
    got = rows_of(v, "seq", "op", "verdict", "reason")
    assert got == sorted([(1, "create", "accepted", None)] + 2 * [(1, "create", "rejected", "duplicate_seq")]
                         + [(2, "delete", "accepted", None)] + 2 * [(2, "update", "rejected", "duplicate_seq")]
                         + [(3, "delete", "accepted", None), (None, "delete", "rejected", "missing_seq")], key=str)


def test_two_creates_of_one_ref_and_seq(spark):
    rows = [(5, "create", None, "a", full(name="x")), (5, "create", None, "a", full(name="y")), (6, "update", None, "a", full(name="z"))]
    new, v = C.apply_change_set(make(spark, "projects", []), ref_changes(spark, "projects", rows), "projects")
    assert rows_of(new, "id", "name") == [(1, "z")] and v.where("reason = 'duplicate_seq'").count() == 1


def test_a_create_delivered_again_is_refused(spark):
    store = TableStore(spark, scratch_path(spark, "again"))
    store.publish({"projects": make(spark, "projects", BASE), "customers": make(spark, "customers", [])})
    line = ("projects", 7, "create", None, CREATE % ("", "s"), None)
    customer = ("customers", 7, "create", None, '{"name":"k"}', None)
    CF.apply_batch(store, feed(spark, line, line, customer), 0)
    CF.apply_batch(store, feed(spark, line, ("projects", 8, "create", None, '{"name":""}', None)), 1)
    CF.apply_batch(store, feed(spark, ("projects", 8, "create", None, CREATE % ("", "s"), None)), 2)  # refused before: not accepted
    assert store.read("projects").where("id > 9").count() == 2 and store.read("customers").count() == 1
    assert rows_of(store.read("rejects"), "batch", "seq", "reason") == [
        (0, 7, "duplicate_seq"), (1, 7, "duplicate_seq"), (1, 8, "required:name")]
    CF.apply_batch(store, feed(spark, line), 0, "other")  # another feed numbers its own requests
    assert store.read("projects").where("id > 9").count() == 3
    assert rows_of(store.read("seqs"), "source", "feed", "id", "hi") == [
        ("customers", "", 7, 7), ("projects", "", 7, 8), ("projects", "other", 7, 7)]


def test_ranges_merge(spark):
    old = spark.createDataFrame([(1, 3, "p", "f"), (7, 9, "p", "f"), (1, 1, "q", "f"), (1_999_999, 1_999_999, "p", "f")],
                                "id long, hi long, source string, feed string")
    new = spark.createDataFrame([(s, "p", "f") for s in (4, 6, 11, 8, 2_000_000)], "seq long, source string, feed string")
    assert rows_of(CF.merge_ranges(old, new), "source", "id", "hi") == sorted([
        ("p", 1, 4), ("p", 6, 9), ("p", 11, 11), ("q", 1, 1), ("p", 1_999_999, 1_999_999), ("p", 2_000_000, 2_000_000)], key=str)
    rows = spark.createDataFrame([(s,) for s in (2, 5, 8, 10, 1_999_998, 1_999_999)] + [(None,)], "seq long")
    ranges = old.where("source = 'p'").select("id", "hi")
    assert {r.seq for r in CF._accepted_before(rows, ranges).where("_again").collect()} == {2, 8, 1_999_999}


# --- cascades ------------------------------------------------------------------------
def test_delete_by_ref_cascades(spark):
    people = [(1, "create", None, "e", dict(name="Tanaka Ichi")), (2, "create", None, "f", dict(name="Mori Ni")),
              (3, "update", None, "f", dict(name="Abe Ni")), (4, "delete", None, "e", None), (5, "delete", None, "f", None)]
    staff = [dict(id=i, name="p", customer_name="c", staff=s) for i, s in enumerate(["Tanaka", "Mori", "Abe", "Sato"], 1)]
    e, p, c = C.delete_employees_with_cascade(make(spark, "employees", []), make(spark, "projects", staff),
                                              make(spark, "customers", [dict(id=1, name="k", staff="Abe")]),
                                              ref_changes(spark, "employees", people))
    assert e.count() == 0 and c.first().staff is None
    assert rows_of(p, "id", "staff") == [(1, None), (2, "Mori"), (3, None), (4, "Sato")]


def history():
    """Changes of two tables whose cascades and staff values interleave by seq."""
    people = [("employees", 10, "delete", 1, None, None), ("employees", 30, "delete", 2, None, None)]
    work = [("projects", 5, "assign_staff", 1, '{"staff":"A"}', None),      # before A's delete: cleared
            ("projects", 20, "assign_staff", 2, '{"staff":"A"}', None),     # after it: stays
            ("projects", 8, "create", None, CREATE % ("a", "A"), None),      # cleared
            ("projects", 40, "create", None, CREATE % ("b", "B"), None),     # stays
            ("projects", 25, "update", 3, CREATE % ("c", "B"), None),        # cleared by 30
            ("projects", 35, "assign_staff", 4, '{"staff":"B"}', None)]      # stays
    return people, work


@pytest.mark.parametrize("order", (0, 3, 5))
def test_any_order_of_batches_gives_the_same_staff(spark, order):
    people, work = history()
    batches = list(itertools.permutations([people[:1], people[1:], work]))[order]
    store = CF.feed_store(spark, scratch_path(spark, "order"), bucket_ids=2)
    base = [dict(id=i, name=f"p{i}", customer_name="c", staff=s) for i, s in ((1, None), (2, "A"), (3, "x"), (4, "B"), (5, "A"), (6, "B"))]
    store.publish({"employees": make(spark, "employees", [dict(id=1, name="A a"), dict(id=2, name="B b")]),
                   "projects": make(spark, "projects", base), "invoices": make(spark, "invoices", [])})
    for n, rows in enumerate(batches):
        CF.apply_batch(store, feed(spark, *rows), n)
    assert rows_of(store.read("projects"), "id", "staff") == [(1, None), (2, "A"), (3, None), (4, "B"), (5, None), (6, None), (7, None), (8, "B")]
    assert rows_of(CF.incremental_kpis(store), "*") == rows_of(CF.published_kpis(store), "*")


def test_a_cascade_opens_only_the_buckets_of_its_surname(spark, monkeypatch):
    store = CF.feed_store(spark, scratch_path(spark, "index"), bucket_ids=10)
    rows = [dict(id=i, name=f"p{i}", customer_name="c", staff="gone" if i in (205, 707) else "s") for i in range(1000)]
    store.publish({"projects": make(spark, "projects", rows), "employees": make(spark, "employees", [dict(id=1, name="gone x")]),
                   "invoices": make(spark, "invoices", [])})
    read, seen = store_module.Snapshot.read, []
    monkeypatch.setattr(store_module.Snapshot, "read", lambda self, t, b=None: (seen.append((t, b)), read(self, t, b))[1])
    CF.apply_batch(store, feed(spark, ("employees", 1, "delete", 1, None, None)), 0)
    assert {b for t, bs in seen if t == "projects" for b in bs} == {20, 70}
    assert rows_of(store.read("projects").where("staff is null"), "id") == [(205,), (707,)]
    assert store.read("staff_projects").where("staff = 'gone'").count() == 0


def test_a_one_row_batch_reads_one_bucket(spark, monkeypatch):
    store = CF.feed_store(spark, scratch_path(spark, "one"), bucket_ids=10)
    rows = [dict(id=i, name=f"p{i}", customer_name="c", status="契約済", contract_amount=i, estimate_amount=1) for i in range(300)]
    store.publish({"projects": make(spark, "projects", rows), "invoices": make(spark, "invoices", [dict(id=1, amount=4, payment_status="入金済")])})
    CF.apply_batch(store, feed(spark, ("projects", 1, "delete", 3, None, None), ("projects", 2, "delete", 299, None, None)), 0)
    read, seen = store_module.Snapshot.read, []
    monkeypatch.setattr(store_module.Snapshot, "read", lambda self, t, b=None: (seen.append((t, b)), read(self, t, b))[1])
    CF.apply_batch(store, feed(spark, ("projects", 5, "delete", 157, None, None)), 1)
    assert {t: bs for t, bs in seen if t == "projects"} == {"projects": {15}} and all(bs is not None and len(bs) <= 1 for _, bs in seen)
    seen.clear()
    got = CF.incremental_kpis(store).first()
    assert {t for t, _ in seen} == {"kpi_projects", "kpi_invoices"}
    assert got.asDict() == CF.published_kpis(store).first().asDict() and got.total_projects == 297 and got.paid_amount == 4


def random_changes(seed, n=90):
    """Changes of three tables, seqs in order per table; employees are renamed and deleted, staff values name them."""
    rnd = random.Random(seed)
    names, out, refs = ["A a", "B b", "C　c", "D d"], [], []
    for seq in range(1, n):
        table = rnd.choice(["employees", "projects", "projects", "customers"])
        op = rnd.choice(["create", "update", "update", "delete"] + ["assign_staff"] * 2 * (table == "projects"))
        ref = None
        if op == "create" and rnd.random() < .6:
            ref = f"r{seq}"
            refs.append((table, ref))
        mine = [r for t, r in refs if t == table]
        by_ref = op != "create" and mine and rnd.random() < .4
        # stored rows only: the id of a row that the set creates is not known to its sender
        ident = None if op == "create" or by_ref else rnd.choice([*range(1, 5 if table == "employees" else 7), 99])
        if by_ref:
            ref = rnd.choice(mine)
        staff = rnd.choice(["A", "B", "C", "D", "E", ""])
        body = {"employees": '{"name":"%s"}' % rnd.choice(names), "customers": '{"name":"k%d","staff":"%s"}' % (seq, staff),
                "projects": CREATE % (seq, staff)}[table]
        body = {"delete": None, "assign_staff": '{"staff":"%s"}' % staff}.get(op, body)
        out.append((table, seq, op, ident, body, ref))
    return out


@pytest.mark.parametrize("seed", (1,))
def test_a_set_and_its_split_give_equal_tables(spark, seed):
    rows = random_changes(seed)
    late = [r for r in rows if r[0] == "employees"], [r for r in rows if r[0] != "employees"]
    half = len(rows) // 2
    splits = {"one": [rows], "halves": [rows[:half], rows[half:]],
              "tables": [late[1][:30], late[0], late[1][30:]] if seed == 1 else [late[0][:8], late[1], late[0][8:]]}
    got = {}
    for name, batches in splits.items():
        store = CF.feed_store(spark, scratch_path(spark, f"split-{name}"), bucket_ids=4)
        store.publish({"employees": make(spark, "employees", [dict(id=i, name=n) for i, n in enumerate(["A x", "B y", "C z", "D w"], 1)]),
                       "projects": make(spark, "projects", [dict(id=i, name="p", customer_name="c", staff="ABCD"[i % 4]) for i in range(1, 7)]),
                       "customers": make(spark, "customers", [dict(id=i, name="k", staff="ABCD"[i % 4]) for i in range(1, 7)])})
        for n, batch in enumerate(batches):
            CF.apply_batch(store, feed(spark, *batch), n)
        got[name] = {t: rows_of(store.read(t), "*") for t in ("employees", "projects", "customers")}
        assert {r[1]: r[0] for r in rows_of(store.read("staff_projects"), "id", "staff")}.keys() == {
            r[0] for r in rows_of(store.read("projects").where("staff is not null"), "staff")}
    assert got["halves"] == got["one"] and got["tables"] == got["one"]
    assert any(r[5] is None for r in got["one"]["projects"])
