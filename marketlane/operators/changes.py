"""Keyed bulk changes with an outcome per input row.

Each operator takes the current table and a batch of changes that carries a
``seq`` column (the order the changes arrive in; unique within the batch) and
returns a ``ChangeResult``:
the new table and the batch with an ``outcome`` column (OK, CONFLICT,
DOES_NOT_EXIST, FOREIGN_KEY_VIOLATION), the same answers one-at-a-time
statements against a keyed table give.

Everything is joins and aggregates over all keys at once. Per-key decisions
("first claimant wins", "last change wins") are ``groupBy`` aggregates joined
back, not windows, so a key holding a third of the batch is combined map-side
and its join partition is split by AQE's skew handling. The one place where order
matters across keys (W2 on unique columns) replays blocks of the batch (``unique.py``). Existence and FK checks first cut the large table to the keys
the batch uses, by a broadcast of those keys where their measured size allows
it, so a small batch neither shuffles nor deduplicates a large table for them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.outcomes import CONFLICT, DOES_NOT_EXIST, FOREIGN_KEY_VIOLATION, OK
from ..functions.text import trim_text
from ..session import materialize
from .joins import cut_if_few, cut_to_keys, few_keys, is_few, many_keys, sized
from .unique import unique_conflicts


@dataclass
class ChangeResult:
    table: DataFrame
    outcomes: DataFrame


def _all(cols: list[Column]) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & c
    return out


def _with_fk_checks(batch: DataFrame, fks: dict | None) -> DataFrame:
    """Add ``_w_fk_ok``: every FK column is NULL or found in its parent.

    ``fks`` maps a batch column to ``(parent_df, parent_col)``. The parents are
    first cut to the values the batch uses and only that result is made distinct:
    for a small batch a large parent table is neither shuffled nor deduplicated.
    One pass over the batch counts the values of all its whole-number columns.
    """
    b = batch
    checks = []
    whole = [c for c in fks or {} if dict(batch.dtypes)[c] in ("bigint", "int")]
    asked = few_keys(batch, whole)
    for i, (col, (parent, parent_col)) in enumerate((fks or {}).items()):
        hit, tmp = f"_w_fk_hit{i}", f"_w_fk{i}"
        parents = parent.select(F.col(parent_col).alias(tmp))
        if col in asked:
            known = cut_if_few(parents.withColumnRenamed(tmp, col), asked[col], col).withColumnRenamed(col, tmp)
        else:
            known = cut_to_keys(parents, batch.select(F.col(col).alias(tmp)).where(F.col(tmp).isNotNull()), [tmp])
        keys = known.distinct().withColumn(hit, F.lit(True))
        if col in asked and not is_few(asked[col]):
            keys = keys.hint("merge")
        b = b.join(keys, b[col] == keys[tmp], "left").drop(tmp)
        checks.append(F.col(col).isNull() | F.col(hit).isNotNull())
    b = b.withColumn("_w_fk_ok", _all(checks))
    return b.drop(*[f"_w_fk_hit{i}" for i in range(len(fks or {}))])


def _key_present(df: DataFrame, table: DataFrame, key: list[str], flag: str, batch: DataFrame | None = None) -> DataFrame:
    """Left-join a presence flag: is the row's key in ``table``. The table is
    first cut to the batch's keys (``cut_to_keys``), then made distinct; for more keys than
    one broadcast holds the cut would exchange the table once more, and is left out.
    ``batch``: what ``df`` was made of, where that is less work to read."""
    nn = _all([F.col(k).isNotNull() for k in key])
    asked = (df if batch is None else batch).where(nn).select(*key)
    held = table.select(*key)
    many = many_keys(asked, key)
    marks = (held if many else cut_to_keys(held, asked, key)).distinct().withColumn(flag, F.lit(True))
    return df.join(marks.hint("merge") if many else marks, key, "left")


def insert_rows(target: DataFrame, batch: DataFrame, unique: list[str] | None = None,
                fks: dict | None = None, id_col: str | None = None) -> ChangeResult:
    """Insert rows; a unique key and foreign keys decide each row's outcome.

    Among rows whose FKs hold, the first per unique key (by ``seq``) is OK if
    the key is not in the table, later ones are CONFLICT. A row failing an FK
    is CONFLICT when its key is already taken (in the table, or by an earlier
    accepted row) and FOREIGN_KEY_VIOLATION otherwise (uniqueness is tested
    first). Keys with a NULL part never conflict. ``id_col``: a generated id
    for accepted rows, ``max(id) + seq`` (unique, gaps allowed, stable under
    recomputation).
    """
    b = _with_fk_checks(batch, fks)
    fk_ok = F.col("_w_fk_ok")
    if unique:
        key_nn = _all([F.col(k).isNotNull() for k in unique])
        asked = batch.where(key_nn).select(*unique)
        many = many_keys(asked, unique)
        if many:
            b = materialize(b)      # read twice below: its foreign keys are looked up once
        held = (target.select(*unique) if many else cut_to_keys(target.select(*unique), asked, unique)).where(key_nn)
        # One aggregate says of each key whether the table has it, and who claims it first.
        claims = b.where(fk_ok & key_nn).select(*unique, "seq", F.lit(None).cast("boolean").alias("_w_taken"))
        facts = (claims.unionByName(held.select(*unique, F.lit(None).cast(b.schema["seq"].dataType).alias("seq"), F.lit(True).alias("_w_taken")))
                 .groupBy(*unique).agg(F.min("seq").alias("_w_first"), F.max("_w_taken").alias("_w_taken")))
        b = b.join(facts.hint("merge") if many else facts, unique, "left")
        taken = F.col("_w_taken").isNotNull()
        seq, first_seq = F.col("seq"), F.col("_w_first")
        outcome = (F.when(~fk_ok, F.when(key_nn & (taken | (first_seq < seq)), F.lit(CONFLICT))
                          .otherwise(F.lit(FOREIGN_KEY_VIOLATION)))
                   .when(~key_nn, F.lit(OK))
                   .when(taken, F.lit(CONFLICT))
                   .when(seq == first_seq, F.lit(OK))
                   .otherwise(F.lit(CONFLICT)))
    else:
        outcome = F.when(fk_ok, F.lit(OK)).otherwise(F.lit(FOREIGN_KEY_VIOLATION))
    judged = b.withColumn("outcome", outcome)
    accepted = judged.where(F.col("outcome") == OK)
    if id_col is not None:
        base = target.select(F.coalesce(F.max(id_col), F.lit(0)).alias("_m")).scalar()
        accepted = accepted.withColumn(id_col, (base + F.col("seq")).cast(target.schema[id_col].dataType))
        judged = judged.withColumn(id_col, F.when(F.col("outcome") == OK, base + F.col("seq"))
                                   .cast(target.schema[id_col].dataType))
    new_rows = accepted.select(*[F.col(c).cast(target.schema[c].dataType) for c in target.columns])
    out_cols = list(dict.fromkeys(batch.columns + ([id_col] if id_col else []) + ["outcome"]))
    return ChangeResult(target.unionByName(new_rows), judged.select(*out_cols))


def update_rows(target: DataFrame, batch: DataFrame, key: list[str], set_cols: list[str],
                unique: list[str] | None = None, fks: dict | None = None) -> ChangeResult:
    """Set ``set_cols`` of the rows matching ``key``; the last OK change wins.

    DOES_NOT_EXIST when no row has the key; CONFLICT when the new value of the
    ``unique`` columns (a subset of ``set_cols``) is held by another row at that
    moment, as one-at-a-time statements in ``seq`` order would find it: a value that
    an earlier change of the batch gave up is free, one that it took is not
    (``unique.py``). Then FOREIGN_KEY_VIOLATION when a new FK value has no parent. A
    NULL in the batch sets NULL (a NULL unique value never conflicts).
    """
    b = _key_present(batch, target, key, "_w_exists")
    b = _with_fk_checks(b, fks)
    exists = F.col("_w_exists").isNotNull()
    conflict = F.lit(False)
    if unique:
        b = materialize(b)
        changes = b.where(exists).select("seq", _tag(key).alias("k"), _tag(unique).alias("v"), F.col("_w_fk_ok").alias("fk_ok"))
        opening = target.select(_tag(unique).alias("v"), _tag(key).alias("k")).where("v is not null")
        b = b.join(unique_conflicts(opening, changes), "seq", "left")
        conflict = F.coalesce("conflict", F.lit(False))
    outcome = (F.when(~exists, F.lit(DOES_NOT_EXIST))
               .when(conflict, F.lit(CONFLICT))
               .when(~F.col("_w_fk_ok"), F.lit(FOREIGN_KEY_VIOLATION))
               .otherwise(F.lit(OK)))
    judged = b.withColumn("outcome", outcome)
    return _apply_updates(target, batch, judged, key, set_cols)


def _apply_updates(target: DataFrame, batch: DataFrame, judged: DataFrame, key: list[str],
                   set_cols: list[str]) -> ChangeResult:
    """The last OK change per key wins (``max_by`` on seq, map-side combined)."""
    last = (judged.where(F.col("outcome") == OK).groupBy(*key)
            .agg(F.max_by(F.struct(*[F.col(c).alias(c) for c in set_cols]), F.col("seq")).alias("_w_new")))
    t = target.join(last, key, "left")
    new_table = t.select(*[
        F.when(F.col("_w_new").isNotNull(), F.col("_w_new")[c]).otherwise(F.col(c))
        .cast(target.schema[c].dataType).alias(c)
        if c in set_cols else F.col(c) for c in target.columns])
    return ChangeResult(new_table, judged.select(*batch.columns, "outcome"))


def _tag(cols: list[str]) -> Column:
    """One string per key or value (NULL when a part is NULL), so multi-column
    keys and values join as a single column."""
    return F.when(_all([F.col(c).isNotNull() for c in cols]), F.to_json(F.struct(*[F.col(c) for c in cols])))


def delete_rows(target: DataFrame, batch: DataFrame, key: list[str], missing_ok: bool = False) -> ChangeResult:
    """Delete every row matching ``key``. OK for the first change that finds
    rows; DOES_NOT_EXIST when none or already deleted by an earlier change
    (``missing_ok`` reports those as OK too)."""
    b = _key_present(batch, target, key, "_w_present")
    first = b.where(F.col("_w_present").isNotNull()).groupBy(*key).agg(F.min("seq").alias("_w_first"))
    b = b.join(first, key, "left")
    hit = F.col("_w_present").isNotNull() & (F.col("seq") == F.col("_w_first"))
    outcome = F.when(hit | F.lit(missing_ok), F.lit(OK)).otherwise(F.lit(DOES_NOT_EXIST))
    gone = batch.select(*key).where(_all([F.col(k).isNotNull() for k in key])).distinct()
    return ChangeResult(target.join(gone, key, "left_anti").select(*target.columns), b.withColumn("outcome", outcome)
                        .select(*batch.columns, "outcome"))


def deleted_rows(target: DataFrame, batch: DataFrame, key: list[str]) -> DataFrame:
    """The rows a ``delete_rows`` removes (``DELETE .. RETURNING``)."""
    return target.join(batch.select(*key).distinct(), key, "left_semi")


def upsert_rows(target: DataFrame, batch: DataFrame, key: list[str], fks: dict | None = None,
                order_cols: list[str] | None = None) -> ChangeResult:
    """Insert, or replace the row with the same key; the last change wins.

    The batch's OK rows are cut to one winner per key (``max_by`` on ``seq``, or
    on the tuple ``order_cols`` when the log's order is several columns, combined
    map-side); the table is anti-joined with the winners' keys, never regrouped.
    """
    b = _with_fk_checks(batch, fks)
    judged = b.withColumn("outcome", F.when(F.col("_w_fk_ok"), F.lit(OK)).otherwise(F.lit(FOREIGN_KEY_VIOLATION)))
    values = [c for c in target.columns if c not in key]
    order = F.struct(*[F.col(c) for c in order_cols or ["seq"]])
    row = F.struct(*[F.col(c).cast(target.schema[c].dataType).alias(c) for c in values])
    winner = judged.where(F.col("outcome") == OK).groupBy(*key).agg(F.max_by(row, order).alias("_w_row"))
    new = winner.select(*[(F.col(c) if c in key else F.col("_w_row")[c]).cast(target.schema[c].dataType).alias(c)
                          for c in target.columns])
    kept = target.join(new.select(*key), key, "left_anti").select(*target.columns)
    return ChangeResult(kept.unionByName(new), judged.select(*batch.columns, "outcome"))


def trim_columns(batch: DataFrame, cols: list[str]) -> DataFrame:
    """Trim text columns before a write."""
    return batch.select(*[trim_text(F.col(c)).alias(c) if c in cols else F.col(c) for c in batch.columns])


@dataclass
class GroupPart:
    """One table a group of rows is inserted into.

    ``rows`` carries ``group_id`` and ``seq`` (the order within and across
    groups: a group's rows are checked in ``seq`` order) and the target's
    columns. ``unique`` and ``fks`` are as in ``insert_rows``.
    """

    name: str
    target: DataFrame
    rows: DataFrame
    unique: list[str] | None = None
    fks: dict | None = None


def insert_groups(parts: list[GroupPart], checkpoint: bool = True):
    """Insert all rows of a group or none; a group's outcome is the outcome
    of its first failing row (by ``seq``), OK when none fails.

    Exact one-group-at-a-time semantics (a rejected group holds none of its
    keys), computed in three steps:

    1. *Static* failures need no order: a row whose FK misses, whose key is
       already in the table, or whose key repeats an earlier row of its own
       group. Such groups are rejected whatever happens and never take a key.
    2. Among the other groups, acceptance is the greedy "first claimant wins"
       over shared keys. A group that shares none is accepted. The rest is settled
       in rounds: a group with no earlier undecided group on any of its keys is
       accepted, and the groups that share a key with it are rejected in the same
       round. Each round settles at least the earliest undecided group, and rounds go
       on until none is left; for orders unrelated to the keys their number grows
       only polylogarithmically with the number of groups.
    3. With the accepted set known, every group's outcome is its first failing
       row: CONFLICT when the key is taken (table, an earlier accepted group, or
       an earlier row of the group), else FOREIGN_KEY_VIOLATION.

    What is known of the rows is summed up once per (group, key) and once per group, and
    written to the shared checkpoint folder, as is each round's state, so the lineage
    stays one round deep. A side is broadcast where its measured size allows it; the
    planner takes a compressed file for a small table, so the other joins are marked
    sort-merge, and no batch is broadcast through the driver. Returns (tables: dict
    name -> DataFrame, group outcomes ``group_id``, ``outcome``).
    """
    hold = materialize if checkpoint else (lambda df: df)

    # Step 1: per-row static facts; keyed rows carry a tagged key so all parts
    # share one key space.
    all_rows = None
    for i, p in enumerate(parts):
        rows = _with_fk_checks(p.rows.where("group_id is not null"), p.fks)
        key, taken = F.lit(None).cast("string"), F.lit(False)
        if p.unique:
            key_nn = _all([F.col(k).isNotNull() for k in p.unique])
            rows = _key_present(rows, p.target, p.unique, "_w_taken", p.rows)
            key = F.when(key_nn, F.to_json(F.struct(F.lit(i).alias("part"), *[F.col(k) for k in p.unique])))
            taken = key_nn & F.col("_w_taken").isNotNull()
        rows = rows.select("group_id", "seq", "_w_fk_ok", key.alias("_w_key"), taken.alias("_w_taken"))
        all_rows = rows if all_rows is None else all_rows.unionByName(rows)
    all_rows = hold(all_rows)

    seq, order = F.col("seq"), F.col("_w_order")
    keys = (all_rows.where("_w_key is not null").groupBy("group_id", "_w_key")
            .agg(F.min("seq").alias("_w_key_seq"), F.max("seq").alias("_w_key_last")))
    keys = hold(keys)
    again = keys.where("_w_key_last > _w_key_seq").select("group_id", "_w_key", "_w_key_seq")
    repeated = (all_rows.join(sized(again), ["group_id", "_w_key"]).where(seq > F.col("_w_key_seq"))
                .groupBy("group_id").agg(F.min("seq").alias("_w_again_seq")))
    groups = all_rows.groupBy("group_id").agg(F.min("seq").alias("_w_order"), F.min(F.when(~F.col("_w_fk_ok"), seq)).alias("_w_fk_seq"),
                                              F.min(F.when(F.col("_w_taken"), seq)).alias("_w_taken_seq"))
    groups = hold(groups.join(sized(repeated), "group_id", "left")
                  .withColumn("_w_own_seq", F.least("_w_taken_seq", "_w_again_seq")).drop("_w_taken_seq", "_w_again_seq"))
    fair = F.col("_w_fk_seq").isNull() & F.col("_w_own_seq").isNull()

    # Step 2: only keys of several groups decide anything between groups.
    shared = sized(keys.groupBy("_w_key").agg(F.count(F.lit(1)).alias("_w_n")).where("_w_n > 1").select("_w_key"))
    shared_keys = hold(keys.join(shared, "_w_key", "left_semi").select("group_id", "_w_key", "_w_key_seq")
                       .join(groups.select("group_id", "_w_order", fair.alias("_w_fair")).hint("merge"), "group_id"))
    claims = shared_keys.where("_w_fair").select("group_id", "_w_order", "_w_key")
    accepted = hold(groups.where(fair).select("group_id", "_w_order")
                    .join(claims.select("group_id").hint("merge"), "group_id", "left_anti"))
    settled = None  # accepted ones that share a key: group_id, _w_order
    while not claims.isEmpty():
        first = sized(claims.groupBy("_w_key").agg(F.min("_w_order").alias("_w_first")))
        ready = (claims.join(first, "_w_key").groupBy("group_id", "_w_order")
                 .agg(F.max(F.col("_w_first") < order).alias("_w_late")).where("not _w_late").select("group_id", "_w_order"))
        ready = hold(ready)
        settled = ready if settled is None else settled.unionByName(ready)
        # Groups that share a key with one accepted now are rejected in the same round.
        held = sized(claims.join(sized(ready.select("group_id")), "group_id", "left_semi").select("_w_key").distinct())
        met = claims.join(held, "_w_key", "left_semi").select("group_id").distinct()
        claims = hold(claims.join(met.hint("merge"), "group_id", "left_anti"))
    if settled is not None:
        accepted = accepted.unionByName(settled)

    # Step 3: outcomes from the accepted set.
    decided = groups.withColumn("_w_late_seq", F.lit(None).cast(groups.schema["_w_order"].dataType))
    if settled is not None:
        winners = (shared_keys.join(sized(settled.select("group_id")), "group_id", "left_semi")
                   .select("_w_key", F.col("_w_order").alias("_w_acc_order")))
        late = (shared_keys.join(sized(winners), "_w_key").where(F.col("_w_acc_order") < order)
                .groupBy("group_id").agg(F.min("_w_key_seq").alias("_w_late_seq")))
        decided = groups.join(late.hint("merge"), "group_id", "left")
    conflict, missing = F.least("_w_own_seq", "_w_late_seq"), F.col("_w_fk_seq")
    decided = decided.select("group_id", F.when(conflict.isNotNull() & (missing.isNull() | (conflict <= missing)), F.lit(CONFLICT))
                             .when(missing.isNotNull(), F.lit(FOREIGN_KEY_VIOLATION)).otherwise(F.lit(OK)).alias("outcome"))
    ok_groups = accepted.select("group_id")
    tables = {}
    for p in parts:
        new = p.rows.join(ok_groups.hint("merge"), "group_id", "left_semi").select(*p.target.columns)
        tables[p.name] = p.target.unionByName(new)
    return tables, decided
