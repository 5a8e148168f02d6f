from pyspark.sql import functions as F

from ledgerlake.operators import changes as C
from tests.conftest import changes, make

BASE = [
    dict(id=1, name="p1", customer_name="c1", staff="山田", status="商談中", estimate_amount=10),
    dict(id=2, name="p2", customer_name="c2", staff="鈴木", status="商談中", estimate_amount=20),
    dict(id=3, name="p3", customer_name="c3", staff="山田", status="契約済", estimate_amount=30),
    dict(id=9, name="p9", customer_name="c9", staff=None, status="失注", estimate_amount=90),
]


def full(**kw):
    row = dict(name="x", customer_name="c")
    row.update(kw)
    return row


def verdicts(spark, rows):
    cur = make(spark, "projects", BASE)
    v = C.validate_changes(cur, changes(spark, "projects", rows), "projects")
    return {r["seq"]: (r["verdict"], r["reason"]) for r in v.collect()}


def test_validation_order_and_reasons(spark):
    got = verdicts(spark, [
        (1, "update", 1, full(name="a??b", customer_name="")),   # garbled wins over required
        (2, "update", 1, full(name="a?b?")),                    # single ? is fine
        (3, "update", 1, full(name="", customer_name="c")),     # required
        (4, "update", 1, full(name="   ")),                     # blanks-only passes
        (5, "update", 404, full()),                             # unknown id
        (6, "delete", 2, None),
        (7, "update", 2, full()),                               # after delete
        (8, "assign_staff", 1, dict(staff="??")),               # garbled staff
        (9, "merge", 1, full()),
        (10, "delete", None, None),
    ])
    assert got[1] == ("rejected", "garbled:name")
    assert got[2] == ("accepted", None)
    assert got[3] == ("rejected", "required:name")
    assert got[4] == ("accepted", None)
    assert got[5] == ("unmatched", "unknown_id")
    assert got[6] == ("accepted", None)
    assert got[7] == ("unmatched", "after_delete")
    assert got[8] == ("rejected", "garbled:staff")
    assert got[9] == ("rejected", "bad_op")
    assert got[10] == ("rejected", "missing_id")


def apply(spark, rows, hwm=None, base=BASE):
    cur = make(spark, "projects", base)
    new, _ = C.apply_change_set(cur, changes(spark, "projects", rows), "projects", hwm=hwm)
    return {r["id"]: r.asDict() for r in new.collect()}


def test_no_changes_is_identity(spark):
    got = apply(spark, [])
    assert got == {r["id"]: {**{f: None for f in got[1]}, **r} for r in BASE}


def test_updates_fold_last_wins_and_replace_all_columns(spark):
    got = apply(spark, [
        (5, "update", 1, full(name="second", estimate_amount=0, note="")),
        (2, "update", 1, full(name="first", work_type="外装")),
    ])
    r = got[1]
    assert r["name"] == "second" and r["work_type"] is None          # full replace: omitted → null
    assert r["estimate_amount"] is None and r["note"] is None        # 0 and '' → null
    assert r["staff"] is None and r["status"] is None                # update has no status default


def test_assignment_after_update_wins_and_before_loses(spark):
    got = apply(spark, [
        (1, "update", 1, full(staff="佐藤")),
        (2, "assign_staff", 1, dict(staff="田中")),
        (3, "assign_staff", 2, dict(staff="田中")),
        (4, "update", 2, full(staff="佐藤")),
        (5, "assign_staff", 3, dict(staff="")),
    ])
    assert got[1]["staff"] == "田中"
    assert got[2]["staff"] == "佐藤"
    assert got[3]["staff"] is None and got[3]["name"] == "p3"       # assignment changes staff only


def test_delete_and_unknown(spark):
    got = apply(spark, [(1, "delete", 2, None), (2, "delete", 77, None), (3, "update", 2, full())])
    assert sorted(got) == [1, 3, 9]


def test_creates_get_ids_above_high_water_mark(spark):
    rows = [(30, "create", None, full(name="b", status="")), (10, "create", None, full(name="a")),
            (20, "create", None, full(name="", customer_name="c"))]
    got = apply(spark, rows)
    assert got[10]["name"] == "a" and got[11]["name"] == "b"
    assert got[11]["status"] == "初回訪問済" and got[10]["status"] == "初回訪問済"
    assert 12 not in got                                              # the rejected create takes no id
    # delete of the highest id, then a create: the persisted mark (9) is not reused
    got = apply(spark, [(1, "delete", 9, None), (2, "create", None, full(name="n"))], hwm=9)
    assert 9 not in got and got[10]["name"] == "n"


def test_invoice_payment_default_on_create_and_update(spark):
    cur = make(spark, "invoices", [dict(id=1, invoice_no="i1", project_name="p", payment_status="入金済", amount=5)])
    ch = changes(spark, "invoices", [(1, "update", 1, dict(invoice_no="i1", project_name="p", amount=0)),
                                     (2, "create", None, dict(invoice_no="i2", project_name="p"))])
    new, _ = C.apply_change_set(cur, ch, "invoices")
    rows = {r["id"]: r for r in new.collect()}
    assert rows[1]["payment_status"] == "未入金" and rows[1]["amount"] is None
    assert rows[2]["payment_status"] == "未入金"


def test_cascade_clears_namesakes_not_later_assignments(spark):
    emps = make(spark, "employees", [dict(id=1, name="カスケード テスト"), dict(id=2, name="山田　太郎"),
                                     dict(id=3, name="鈴木 一郎")])
    projects = make(spark, "projects", BASE + [dict(id=4, name="p4", customer_name="c", staff="カスケード")])
    customers = make(spark, "customers", [dict(id=1, name="k", staff="山田"), dict(id=2, name="k2", staff="鈴木")])
    emp_changes = changes(spark, "employees", [(10, "delete", 1, None), (11, "delete", 2, None),
                                               (12, "delete", 99, None)])
    new_emp, p, c = C.delete_employees_with_cascade(emps, projects, customers, emp_changes)
    assert [r["id"] for r in new_emp.collect()] == [3]
    staff = {r["id"]: r["staff"] for r in p.collect()}
    assert staff == {1: None, 2: "鈴木", 3: None, 4: None, 9: None}   # both 山田 rows cleared (U+3000 split)
    assert {r["id"]: r["staff"] for r in c.collect()} == {1: None, 2: "鈴木"}
    # a staff value set after the delete survives it
    names = C.deleted_surnames(emps, emp_changes)
    t = projects.withColumn("_staff_seq", F.when(F.col("id") == 1, F.lit(50)).otherwise(F.lit(None)).cast("bigint"))
    after = {r["id"]: r["staff"] for r in C.cascade_staff(t, names).collect()}
    assert after[1] == "山田" and after[3] is None


def test_changes_are_judged_once(spark):
    """The rules on the change itself run when the set is written, not again in each branch of the plans."""
    cur = make(spark, "projects", BASE)
    ch = changes(spark, "projects", [(1, "create", None, full(name="a")), (2, "update", 1, full(name="b")), (3, "delete", 2, None), (3, "delete", 2, None)])
    new, verdicts = C.apply_change_set(cur, ch, "projects")
    for frame in (new, verdicts, C.validate_changes(cur, ch, "projects")):
        assert "RLIKE" not in frame._jdf.queryExecution().optimizedPlan().toString().upper()
    assert sorted((r["seq"], r["verdict"]) for r in verdicts.collect()) == sorted(
        (r["seq"], r["verdict"]) for r in C.validate_changes(cur, ch, "projects").collect())
    assert [r["reason"] for r in verdicts.collect() if r["verdict"] == C.REJECTED] == [C.DUPLICATE]
