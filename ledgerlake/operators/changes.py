"""Keyed change sets (M1-M6, J3): single-row writes re-expressed as batch operators.

A change row is ``(seq, op, id, payload)``, and ``ref`` if the set has it, with ``op`` one of ``create``,
``update``, ``delete``, ``assign_staff`` and ``payload`` a struct of the
table's columns without ``id``. Rules, in the order the original service
applied them to one request:

1. garbled text (two or more ``?``) in a checked text field → rejected;
2. a required field null or ``''`` on create / full update → rejected;
3. an update, assignment or delete of an unknown id → unmatched; so is any
   change of an id after that id's first delete in the set.

A ``seq`` stands for one request. Of rows that share one, the smallest by (op,
id, ref, payload) stands and the others are rejected (``duplicate_seq``) before
those rules; a change without a ``seq`` is rejected (``missing_seq``).

A set may carry a ``ref`` column: a name the sender gives to a row it creates,
so that later changes of the set can address it before its id is known
(``id`` null, ``ref`` set). The first accepted create of a ref holds it; a
further one is rejected (``duplicate_ref``), and a keyed change whose ref no
earlier accepted create holds is unmatched (``unknown_ref``).

Accepted changes fold per id: the last full update replaces every column
(fields left out become null, blanks become null, invoice payment state
defaults); a staff assignment after it changes only ``staff``; a delete
removes the row. Creates get new ids above the table's high-water mark in
``seq`` order.

Everything is keyed aggregation and joins on ``id``: one grouped fold per id
(deleted or not, last update, last assignment: ``max(struct(seq, ...))``, so
partial aggregation absorbs a hot id) is joined to the table, whose ids are
unique. The same join drops changes of unknown ids, and what comes after an
id's first delete cannot matter, so the new table needs no verdicts; those are
a plan of their own, run only if read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake import schemas as S
from ledgerlake.functions import normalise as N
from ledgerlake.operators import filters as P
from ledgerlake.plans.joins import rank_by
from ledgerlake.session import scratch_path

OPS = ("create", "update", "delete", "assign_staff")
ASSIGNABLE = ("projects",)  # tables whose staff can be assigned by itself
KEYED_OPS = ("update", "delete", "assign_staff")

ACCEPTED, REJECTED, UNMATCHED = "accepted", "rejected", "unmatched"
DUPLICATE = "duplicate_seq"


def _fields(table: str) -> list[T.StructField]:
    return list(S.payload_schema(table).fields)


def falsy_to_null(c: Column, dtype: T.DataType) -> Column:
    """the form's falsy values become null: ``''`` for text, 0 for numbers."""
    if isinstance(dtype, T.StringType):
        return F.when(c == "", F.lit(None).cast(dtype)).otherwise(c)
    return F.when(c == 0, F.lit(None).cast(dtype)).otherwise(c)


def normalised_payload(table: str, op: str, prefix: str = "payload.") -> list[Column]:
    """the stored values of a create or full update, one column per field.

    Required fields are stored as sent; project status is defaulted on create
    and stored as sent on update; invoice payment state is defaulted on both.
    """
    required = set(S.REQUIRED_FIELDS.get(table, ()))
    defaults = (S.CREATE_DEFAULTS if op == "create" else S.UPDATE_DEFAULTS).get(table, {})
    raw_on_update = {"status"} if (table == "projects" and op == "update") else set()
    out = []
    for f in _fields(table):
        c = F.col(prefix + f.name)
        if f.name in defaults:
            v = N.default_if_blank(c, defaults[f.name])
        elif f.name in required or f.name in raw_on_update:
            v = c
        else:
            v = falsy_to_null(c, f.dataType)
        out.append(v.cast(f.dataType).alias(f.name))
    return out


def reject_reason(table: str, with_ref: bool = False) -> Column:
    """P9 then P10 for one change row; null when the row passes both."""
    fields = [f.name for f in _fields(table)]
    op = F.col("op")
    garbled = P.garbled_field(fields, "payload.")
    has_body = op.isin("create", "update", "assign_staff")
    needs_required = op.isin("create", "update")
    missing = P.missing_required(table, "payload.") if table in S.REQUIRED_FIELDS else F.lit(None).cast("string")
    allowed = OPS if table in ASSIGNABLE else tuple(o for o in OPS if o != "assign_staff")
    return (F.when(F.col("seq").isNull(), F.lit("missing_seq"))
            .when(~op.isin(*allowed) | op.isNull(), F.lit("bad_op"))
            .when(op.isin(*KEYED_OPS) & F.col("id").isNull() & (F.col("ref").isNull() if with_ref else F.lit(True)),
                  F.lit("missing_id"))
            .when(has_body & garbled.isNotNull(), F.concat(F.lit("garbled:"), garbled))
            .when(needs_required & missing.isNotNull(), F.concat(F.lit("required:"), missing)))


def _ordered(changes: DataFrame) -> Column:
    """The order of change rows that share a seq."""
    return F.struct("op", "id", *(["ref"] if "ref" in changes.columns else []), "payload")


def written(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` as a scratch table: what several branches of a plan read is computed once, not once a branch."""
    path = scratch_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def _judged(changes: DataFrame, table: str) -> DataFrame:
    """The change rows with the ``reason`` that the rules on the change itself give."""
    with_ref = "ref" in changes.columns
    return changes.select("seq", "op", "id", *(["ref"] if with_ref else []), "payload", reject_reason(table, with_ref).alias("reason"))


def set_facts(changes: DataFrame) -> tuple[bool, bool]:
    """Has the set creates, and does it repeat a seq? One small aggregate over (seq, op)."""
    per_seq = changes.groupBy("seq").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("op") == "create").alias("c"))
    row = per_seq.agg(F.max("c"), F.max(F.when(F.col("seq").isNotNull(), F.col("n")))).first()
    return bool(row[0]), (row[1] or 0) > 1


def first_deliveries(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(standing, repeats)``: one row for each seq, and all further rows.

    Equal rows are counted in an aggregate before anything is compared, so a
    row delivered a million times is one row a task; only rows of a repeated
    seq take part.
    """
    cols = changes.columns
    often = changes.where("seq is not null").groupBy("seq").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("seq")
    counted = (changes.join(often, "seq", "left_semi").select("seq", F.struct(*cols).alias("_row"), _ordered(changes).alias("_k"))
               .groupBy("seq", "_row", "_k").agg(F.count(F.lit(1)).alias("_n")))
    first = counted.groupBy("seq").agg(F.min(F.struct("_k", "_row")).alias("_m")).select("seq", F.col("_m._row").alias("_first"))
    stands = first.select("_first.*")
    spare = F.col("_n") - F.when(F.col("_row").eqNullSafe(F.col("_first")), 1).otherwise(0)
    repeats = (counted.join(first, "seq").where(spare > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), spare)))
               .select("_row.*"))
    return changes.join(often, "seq", "left_anti").select(*cols).unionByName(stands), repeats


def valid_changes(changes: DataFrame, table: str) -> DataFrame:
    """The rows that pass the rules on the change itself (P9, P10, known operation, some id)."""
    return changes.where(reject_reason(table, "ref" in changes.columns).isNull())


def validate_changes(current: DataFrame, changes: DataFrame, table: str, unique: bool = False) -> DataFrame:
    """Every change with ``verdict`` (accepted / rejected / unmatched) and ``reason``.

    Creates and rejected rows are judged where they lie. Of the keyed rows,
    unknown ids are found with one left join to the table's ids (unique, so
    the join never multiplies rows; a hot id on the change side is split by
    AQE's skew handling). The first delete per id comes from a grouped min
    joined back on id. Rows that use ``ref`` are judged by ``_judge_refs``.
    ``unique``: the caller knows that no seq is repeated. Changes that have a
    ``reason`` already are not judged again.
    """
    with_ref = "ref" in changes.columns
    cols = ["seq", "op", "id", *(["ref"] if with_ref else []), "payload"]
    marked = changes if "reason" in changes.columns else _judged(changes, table)
    if not unique:
        marked = marked if marked is changes else written(marked, "judged")
        if set_facts(marked)[1]:
            standing, repeats = first_deliveries(marked)
            return validate_changes(current, written(standing, "standing"), table, unique=True).unionByName(_refuse_repeats(repeats))
    ok = F.col("reason").isNull()
    keyed_ok = ok & F.col("op").isin(*KEYED_OPS) & F.col("id").isNotNull()
    by_ref = ok & F.col("ref").isNotNull() & ~keyed_ok if with_ref else F.lit(False)
    local = marked.where(~keyed_ok & ~by_ref).select(
        *cols, F.when(F.col("reason").isNotNull(), F.lit(REJECTED)).otherwise(F.lit(ACCEPTED)).alias("verdict"), "reason")
    checked = marked.where(keyed_ok)
    ids = current.select(F.col("id").alias("_cid"), F.lit(True).alias("_known"))
    first_delete = (checked.where(F.col("op") == "delete")
                    .groupBy("id").agg(F.min("seq").alias("_first_delete")))
    j = (checked.join(ids, checked.id == ids._cid, "left")
         .join(first_delete.withColumnRenamed("id", "_did"), F.col("id") == F.col("_did"), "left"))
    reason = (F.when(F.col("_known").isNull(), F.lit("unknown_id"))
              .when(F.col("seq") > F.col("_first_delete"), F.lit("after_delete")))
    verdict = F.when(reason.isNotNull(), F.lit(UNMATCHED)).otherwise(F.lit(ACCEPTED))
    judged = local.unionByName(j.select(*cols, verdict.alias("verdict"), reason.alias("reason")))
    return judged.unionByName(_judge_refs(marked.where(by_ref), cols)) if with_ref else judged


def _refuse_repeats(repeats: DataFrame) -> DataFrame:
    """The verdicts of rows whose seq another row stands for."""
    return repeats.drop("reason").withColumns({"verdict": F.lit(REJECTED), "reason": F.lit(DUPLICATE)})


def _judge_refs(rows: DataFrame, cols: list[str]) -> DataFrame:
    """Verdicts of creates that carry a ref and of keyed changes that use one.

    One row per ref (its first create, its first delete after that) is joined
    back, so a ref that many changes use is aggregated before the join.
    """
    born = rows.where(F.col("op") == "create").groupBy(F.col("ref").alias("_ref")).agg(F.min("seq").alias("_born"))
    gone = (rows.where(F.col("op") == "delete").join(born, F.col("ref") == F.col("_ref"))
            .where(F.col("seq") > F.col("_born")).groupBy(F.col("ref").alias("_gone_ref")).agg(F.min("seq").alias("_gone")))
    j = (rows.join(born, F.col("ref") == F.col("_ref"), "left")
         .join(gone, F.col("ref") == F.col("_gone_ref"), "left"))
    created = F.col("op") == "create"
    reason = (F.when(created & (F.col("seq") > F.col("_born")), F.lit("duplicate_ref"))
              .when(~created & (F.col("_born").isNull() | (F.col("seq") < F.col("_born"))), F.lit("unknown_ref"))
              .when(~created & (F.col("seq") > F.col("_gone")), F.lit("after_delete")))
    verdict = (F.when(reason.isNull(), F.lit(ACCEPTED)).when(created, F.lit(REJECTED)).otherwise(F.lit(UNMATCHED)))
    return j.select(*cols, verdict.alias("verdict"), reason.alias("reason"))


def fold_changes(accepted: DataFrame, table: str) -> DataFrame:
    """Per id: last full update (normalised), last staff assignment, delete flag.

    ``max`` over ``struct(seq, …)`` picks the latest row per id; it is a plain
    aggregate, so Spark combines it map-side before the shuffle on ``id``.
    """
    keyed = accepted.where(F.col("op").isin(*KEYED_OPS))
    upd = F.struct(F.col("seq"), F.struct(*normalised_payload(table, "update")).alias("row"))
    aggs = [
        F.max(F.when(F.col("op") == "update", upd)).alias("_upd"),
        F.max(F.col("op") == "delete").alias("_deleted"),
    ]
    if "staff" in [f.name for f in _fields(table)]:
        asg = F.struct(F.col("seq"), falsy_to_null(F.col("payload.staff"), T.StringType()).alias("staff"))
        aggs.append(F.max(F.when(F.col("op") == "assign_staff", asg)).alias("_asg"))
    return keyed.groupBy("id").agg(*aggs)


def apply_keyed(current: DataFrame, folded: DataFrame, table: str) -> DataFrame:
    """M2/M3/M4: the table after updates, assignments and deletes.

    Adds ``_staff_seq``: the seq of the change that last set ``staff`` (null
    when the stored value is older than the change set), used by cascades. A
    ``_staff_seq`` that ``current`` has (rows created in this set) is the floor.
    """
    cols = [f.name for f in _fields(table)]
    has_staff = "staff" in cols
    f = folded.withColumnRenamed("id", "_fid")
    j = current.join(f, current.id == f._fid, "left")
    j = j.where(~F.coalesce(F.col("_deleted"), F.lit(False)))
    upd_seq = F.col("_upd.seq")
    out = [F.col("id")]
    for c in cols:
        v = F.when(F.col("_upd").isNotNull(), F.col(f"_upd.row.{c}")).otherwise(F.col(c))
        if c == "staff" and has_staff:
            later = F.col("_asg").isNotNull() & (F.col("_upd").isNull() | (F.col("_asg.seq") > upd_seq))
            v = F.when(later, F.col("_asg.staff")).otherwise(v)
        out.append(v.alias(c))
    if has_staff:
        before = F.col("_staff_seq") if "_staff_seq" in current.columns else F.lit(None).cast("bigint")
        staff_seq = F.greatest(before, upd_seq, F.col("_asg.seq"))
        out.append(staff_seq.alias("_staff_seq"))
    return j.select(*out)


def high_water_mark(current: DataFrame) -> DataFrame:
    """One-row frame ``_hwm``: the largest id ever issued (here: max id, 0 when empty)."""
    return current.agg(F.coalesce(F.max("id"), F.lit(0)).cast("bigint").alias("_hwm"))


def standing_creates(valid: DataFrame) -> DataFrame:
    """The creates that hold: all without a ref, and the first of each ref."""
    creates = valid.where(F.col("op") == "create")
    if "ref" not in valid.columns:
        return creates.select("seq", "op", "payload")
    first = (creates.where("ref is not null").groupBy("ref").agg(F.min(F.struct("seq", "payload")).alias("c"))
             .select("c.seq", F.lit("create").alias("op"), "ref", "c.payload"))
    return creates.where("ref is null").select("seq", "op", "ref", "payload").unionByName(first)


def apply_creates(accepted: DataFrame, table: str, hwm: int | Column) -> DataFrame:
    """M1: created rows with ids ``hwm + 1, hwm + 2, …`` in seq order, plus ``_staff_seq`` = seq.

    If the set has refs, also ``ref`` and ``_born``, the create's seq. Ranks
    come from ``rank_by`` over the seqs alone; payloads join them once.
    """
    extra = ["ref"] if "ref" in accepted.columns else []
    creates = accepted.where(F.col("op") == "create").select("seq", *extra, *normalised_payload(table, "create"))
    ranked = rank_by(creates, "seq", "_rank")
    cols = [f.name for f in _fields(table)]
    marks = [F.col("seq").alias("_staff_seq")] if "staff" in cols else []
    marks += [F.col("ref"), F.col("seq").alias("_born")] if extra else []
    base = hwm if isinstance(hwm, Column) else F.lit(hwm)
    return ranked.select((base.cast("bigint") + F.col("_rank")).alias("id"), *cols, *marks)


def resolve_refs(keyed: DataFrame, created: DataFrame | None) -> DataFrame:
    """Keyed changes by id: refs are replaced by the ids that ``created`` gave; what precedes its row's create drops out."""
    keyed = keyed.where(F.col("op").isin(*KEYED_OPS))
    if "ref" not in keyed.columns:
        return keyed
    by_id = keyed.where("id is not null").drop("ref")
    if created is None:
        return by_id
    ids = created.where("ref is not null").select(F.col("id").alias("_new_id"), F.col("ref").alias("_new_ref"), "_born")
    by_ref = keyed.where("id is null").join(ids, F.col("ref") == F.col("_new_ref")).where(F.col("seq") > F.col("_born"))
    return by_id.unionByName(by_ref.withColumn("id", F.col("_new_id")).drop("ref", "_new_id", "_new_ref", "_born"))


def created_rows(verdicts: DataFrame, table: str, hwm: int | Column) -> DataFrame | None:
    """``apply_creates`` of a judged set; None, without a checkpoint, if it creates nothing."""
    accepted = verdicts.where(F.col("verdict") == ACCEPTED)
    if accepted.where(F.col("op") == "create").isEmpty():
        return None
    return apply_creates(accepted, table, hwm)


def apply_valid(current: DataFrame, valid: DataFrame, table: str, created: DataFrame | None) -> DataFrame:
    """The table after valid (or accepted) changes whose creates have their ids; has ``_staff_seq`` if it has ``staff``."""
    folded = fold_changes(resolve_refs(valid, created), table)
    if created is None:
        return apply_keyed(current, folded, table)
    if "ref" not in created.columns:
        return apply_keyed(current, folded, table).unionByName(created)
    # only rows that can be addressed in this set go through the join
    named = created.where("ref is not null").drop("ref", "_born")
    result = apply_keyed(current.unionByName(named, allowMissingColumns=True), folded, table)
    return result.unionByName(created.where("ref is null").drop("ref", "_born"))


def apply_change_set(current: DataFrame, changes: DataFrame, table: str, hwm: int | None = None,
                     keep_staff_seq: bool = False) -> tuple[DataFrame, DataFrame]:
    """Apply a whole change set; returns ``(new_table, verdicts)``.

    ``hwm`` is the persisted high-water mark of issued ids; when unknown it is
    the table's current max id, as a scalar subquery inside the same plan. A
    row created and deleted in one set uses up its id: a store's mark must
    count it (``sources.store`` takes marks beside the snapshot's ids).
    """
    judged = written(_judged(changes, table), "judged")
    has_creates, repeats = set_facts(judged)
    again = None
    if repeats:
        judged, again = first_deliveries(judged)
        judged = written(judged, "standing")
    verdicts = validate_changes(current, judged, table, unique=True)
    if again is not None:
        verdicts = verdicts.unionByName(_refuse_repeats(again))
    valid = judged.where("reason is null").drop("reason")
    created = None
    if has_creates:
        if hwm is None:
            hwm = high_water_mark(current).scalar()
        created = written(apply_creates(standing_creates(valid), table, hwm), "created")
    result = apply_valid(current, valid, table, created)
    if not keep_staff_seq and "_staff_seq" in result.columns:
        result = result.drop("_staff_seq")
    return result, verdicts


# --- M5: employee delete with cascade ----------------------------------------
def deleted_surnames(employees: DataFrame, employee_changes: DataFrame, mode: str = "any") -> DataFrame:
    """Surnames of employees deleted by the changes, with the seq of the (latest) delete.

    The name is the one the employee had at the delete: the last valid full
    update before it, else the name of its create (a row addressed by ``ref``),
    else the stored name. One row per surname. A seq must not be repeated.
    """
    valid = valid_changes(employee_changes, "employees").select("seq", "op", "id", F.col("payload.name").alias("_name"),
                                                                *(["ref"] if "ref" in employee_changes.columns else []))
    stored = employees.select("id", F.col("name").alias("_stored"), F.lit(None).cast("bigint").alias("_born"))
    gone = _names_at_delete(valid.where("id is not null"), stored, "id")
    if "ref" in valid.columns:
        born = (valid.where("op = 'create' and ref is not null").groupBy("ref").agg(F.min(F.struct("seq", "_name")).alias("c"))
                .select("ref", F.col("c._name").alias("_stored"), F.col("c.seq").alias("_born")))
        gone = gone.unionByName(_names_at_delete(valid.where("id is null and ref is not null"), born, "ref"))
    return gone.select(N.surname("_name", mode).alias("_surname"), "_seq").groupBy("_surname").agg(
        F.max("_seq").alias("_cascade_seq"))


def _names_at_delete(valid: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """(_name, _seq) of the first delete of each of ``rows`` (key, _stored, _born) that has one."""
    later = F.coalesce(F.col("seq") > F.col("_born"), F.lit(True))
    deletes = (valid.where("op = 'delete'").join(rows, key).where(later)
               .groupBy(key).agg(F.min("seq").alias("_seq"), F.first("_stored").alias("_stored"), F.first("_born").alias("_born")))
    renamed = (valid.where("op = 'update'").join(deletes.select(key, "_seq", "_born"), key)
               .where((F.col("seq") < F.col("_seq")) & later)
               .groupBy(key).agg(F.max(F.struct("seq", "_name")).alias("_u")))
    return deletes.join(renamed, key, "left").select(F.coalesce("_u._name", "_stored").alias("_name"), "_seq")


def cascade_staff(table: DataFrame, surnames: DataFrame) -> DataFrame:
    """Null ``staff`` where it equals a deleted employee's surname set before that delete.

    ``table`` carries ``_staff_seq`` (seq of the change that set ``staff``;
    null = stored before the change set). Namesakes are cleared too. The
    surname side has one row per surname; AQE broadcasts it if its measured
    size allows, and else shuffles.
    """
    j = table.join(surnames, F.col("staff") == F.col("_surname"), "left")
    hit = F.col("_surname").isNotNull() & (
        F.col("_staff_seq").isNull() | (F.col("_cascade_seq") > F.col("_staff_seq")))
    return j.withColumn("staff", F.when(hit, F.lit(None).cast("string")).otherwise(F.col("staff"))) \
            .drop("_surname", "_cascade_seq")


def delete_employees_with_cascade(employees: DataFrame, projects: DataFrame, customers: DataFrame,
                                  employee_changes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """M5 on stored tables: apply employee changes, then clear matching staff in projects and customers.

    Returns the three new tables. Projects and customers keep their other
    columns unchanged; publish all three together (see ``sources.store``).
    """
    if set_facts(employee_changes)[1]:
        employee_changes = first_deliveries(employee_changes)[0]
    new_emp, _ = apply_change_set(employees, employee_changes, "employees")
    names = deleted_surnames(employees, employee_changes)
    p = cascade_staff(projects.withColumn("_staff_seq", F.lit(None).cast("bigint")), names).drop("_staff_seq")
    c = cascade_staff(customers.withColumn("_staff_seq", F.lit(None).cast("bigint")), names).drop("_staff_seq")
    return new_emp, p, c
