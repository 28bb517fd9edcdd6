"""W1-W5 against one-change-at-a-time Python models on random batches."""

import random

import pytest

from marketlane.operators import changes as W


def _df(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# ---- sequential models -------------------------------------------------------

def model_insert(table_keys, parents, batch):
    taken = set(table_keys)
    out = {}
    for seq, key, fk in sorted(batch):
        fk_ok = fk is None or fk in parents
        if key is not None and key in taken:
            out[seq] = "CONFLICT"
        elif not fk_ok:
            out[seq] = "FOREIGN_KEY_VIOLATION"
        else:
            out[seq] = "OK"
            if key is not None:
                taken.add(key)
    return out


def model_update(table, parents, batch):
    """table: id -> (name, ref). Batch rows (seq, id, name, ref); one at a time."""
    table = dict(table)
    holder = {n: k for k, (n, _) in table.items() if n is not None}
    out = {}
    for seq, k, name, ref in sorted(batch):
        if k not in table:
            out[seq] = "DOES_NOT_EXIST"
        elif name is not None and holder.get(name, k) != k:
            out[seq] = "CONFLICT"
        elif ref is not None and ref not in parents:
            out[seq] = "FOREIGN_KEY_VIOLATION"
        else:
            out[seq] = "OK"
            old = table[k][0]
            if old is not None and holder.get(old) == k:
                del holder[old]
            table[k] = (name, ref)
            if name is not None:
                holder[name] = k
    return out, table


def model_delete(keys, batch):
    present = set(keys)
    out = {}
    for seq, k in sorted(batch):
        if k in present:
            out[seq] = "OK"
            present.discard(k)
        else:
            out[seq] = "DOES_NOT_EXIST"
    return out, present


def model_upsert(table, parents, batch):
    table = dict(table)
    out = {}
    for seq, k, v, ref in sorted(batch):
        if ref is not None and ref not in parents:
            out[seq] = "FOREIGN_KEY_VIOLATION"
        else:
            out[seq] = "OK"
            table[k] = (v, ref)
    return out, table


def model_groups(table_keys, parents, rows):
    """rows: (group, seq, key, fk). Groups in order of their first seq."""
    taken = set(table_keys)
    by_group = {}
    for g, seq, key, fk in rows:
        by_group.setdefault(g, []).append((seq, key, fk))
    order = sorted(by_group, key=lambda g: min(s for s, _, _ in by_group[g]))
    out = {}
    for g in order:
        trial = set(taken)
        verdict = "OK"
        for seq, key, fk in sorted(by_group[g]):
            if key is not None and key in trial:
                verdict = "CONFLICT"
                break
            if fk is not None and fk not in parents:
                verdict = "FOREIGN_KEY_VIOLATION"
                break
            if key is not None:
                trial.add(key)
        out[g] = verdict
        if verdict == "OK":
            taken = trial
    return out, taken


# ---- tests -------------------------------------------------------------------

SEEDS = list(range(6))


@pytest.mark.parametrize("seed", SEEDS)
def test_insert_rows_matches_model(spark, seed):
    rnd = random.Random(seed)
    table_keys = rnd.sample(range(30), 8)
    parents = set(rnd.sample(range(10), 6))
    batch = [(s + 1, rnd.choice([None] + list(range(30))), rnd.choice([None] + list(range(12))))
             for s in range(40)]
    target = _df(spark, [(k, None) for k in table_keys], "k bigint, fk bigint")
    b = _df(spark, batch, "seq bigint, k bigint, fk bigint")
    parent = _df(spark, [(p,) for p in parents], "id bigint")
    res = W.insert_rows(target, b, unique=["k"], fks={"fk": (parent, "id")})
    got = {r.seq: r.outcome for r in res.outcomes.collect()}
    assert got == model_insert(table_keys, parents, batch)
    ok = [r for r in batch if got[r[0]] == "OK"]
    assert res.table.count() == len(table_keys) + len(ok)


@pytest.mark.parametrize("seed", SEEDS)
def test_update_rows_matches_model(spark, seed):
    rnd = random.Random(100 + seed)
    names = ["a", "b", "c", "d", "e", "f", None]
    pool = names[:-1]
    rnd.shuffle(pool)
    table = {k: (pool[k] if k < len(pool) and rnd.random() < 0.8 else None, rnd.choice([None, 1, 2]))
             for k in range(8)}
    parents = {1, 2, 3}
    batch = [(s + 1, rnd.randrange(11), rnd.choice(names + ["g", "h"]), rnd.choice([None, 1, 2, 3, 9]))
             for s in range(30)]
    target = _df(spark, [(k, n, r) for k, (n, r) in table.items()], "id bigint, name string, ref bigint")
    b = _df(spark, batch, "seq bigint, id bigint, name string, ref bigint")
    parent = _df(spark, [(p,) for p in parents], "id bigint")
    res = W.update_rows(target, b, key=["id"], set_cols=["name", "ref"], unique=["name"],
                        fks={"ref": (parent, "id")})
    got = {r.seq: r.outcome for r in res.outcomes.collect()}
    want, final = model_update(table, parents, batch)
    assert got == want
    assert {r.id: (r.name, r.ref) for r in res.table.collect()} == final


@pytest.mark.parametrize("seed", SEEDS)
def test_delete_rows_matches_model(spark, seed):
    rnd = random.Random(200 + seed)
    keys = rnd.sample(range(20), 10)
    batch = [(s + 1, rnd.randrange(22)) for s in range(25)]
    target = _df(spark, [(k, "x") for k in keys], "k bigint, v string")
    b = _df(spark, batch, "seq bigint, k bigint")
    res = W.delete_rows(target, b, key=["k"])
    got = {r.seq: r.outcome for r in res.outcomes.collect()}
    want, left = model_delete(keys, batch)
    assert got == want
    assert {r.k for r in res.table.collect()} == left


@pytest.mark.parametrize("seed", SEEDS)
def test_upsert_rows_matches_model(spark, seed):
    rnd = random.Random(300 + seed)
    table = {k: (rnd.randrange(100), None) for k in range(6)}
    parents = {1, 2}
    batch = [(s + 1, rnd.randrange(10), rnd.randrange(100), rnd.choice([None, 1, 2, 5])) for s in range(25)]
    rnd.shuffle(batch)
    target = _df(spark, [(k, v, r) for k, (v, r) in table.items()], "k bigint, v bigint, ref bigint")
    b = _df(spark, batch, "seq bigint, k bigint, v bigint, ref bigint")
    parent = _df(spark, [(p,) for p in parents], "id bigint")
    res = W.upsert_rows(target, b, key=["k"], fks={"ref": (parent, "id")})
    got = {r.seq: r.outcome for r in res.outcomes.collect()}
    want, final = model_upsert(table, parents, batch)
    assert got == want
    assert {r.k: (r.v, r.ref) for r in res.table.collect()} == final


@pytest.mark.parametrize("seed", SEEDS[:4])
def test_insert_groups_matches_model(spark, seed):
    rnd = random.Random(400 + seed)
    table_keys = set(rnd.sample(range(25), 5))
    parents = {0, 1, 2, 3}
    rows = []
    seq = 0
    for g in range(12):
        for _ in range(rnd.randint(1, 3)):
            seq += 1
            rows.append((g, seq, rnd.choice([None] + list(range(25))), rnd.choice([None, 0, 1, 2, 3, 7])))
    target = _df(spark, [(k, None) for k in table_keys], "k bigint, fk bigint")
    part_rows = _df(spark, rows, "group_id bigint, seq bigint, k bigint, fk bigint")
    parent = _df(spark, [(p,) for p in parents], "id bigint")
    tables, verdicts = W.insert_groups(
        [W.GroupPart("t", target, part_rows, unique=["k"], fks={"fk": (parent, "id")})])
    got = {r.group_id: r.outcome for r in verdicts.collect()}
    want, final = model_groups(table_keys, parents, rows)
    assert got == want
    assert {r.k for r in tables["t"].collect() if r.k is not None} == final


def test_trim_columns(spark):
    df = _df(spark, [("  a b \t", " x")], "name string, other string")
    row = W.trim_columns(df, ["name"]).collect()[0]
    assert row.name == "a b" and row.other == " x"


@pytest.mark.parametrize("seed", range(3))
def test_insert_groups_hot_keys(spark, seed):
    """Few keys shared by many groups: chains of dependent decisions."""
    rnd = random.Random(500 + seed)
    table_keys = {0}
    parents = {0, 1}
    rows = []
    seq = 0
    for g in range(25):
        for _ in range(rnd.randint(1, 3)):
            seq += 1
            rows.append((g, seq, rnd.choice([1, 1, 1, 2, 3, 4, None]), rnd.choice([None, 0, 1, 9])))
    target = _df(spark, [(k, None) for k in table_keys], "k bigint, fk bigint")
    part_rows = _df(spark, rows, "group_id bigint, seq bigint, k bigint, fk bigint")
    parent = _df(spark, [(p,) for p in parents], "id bigint")
    tables, verdicts = W.insert_groups(
        [W.GroupPart("t", target, part_rows, unique=["k"], fks={"fk": (parent, "id")})])
    got = {r.group_id: r.outcome for r in verdicts.collect()}
    want, final = model_groups(table_keys, parents, rows)
    assert got == want
    assert {r.k for r in tables["t"].collect() if r.k is not None} == final


def test_update_rows_rename_chain(spark):
    """A takes B's name after B moved on; swap through a free name; a name
    freed and reclaimed within one batch."""
    table = {1: ("a", None), 2: ("b", None), 3: ("c", None)}
    batch = [(1, 2, "z", None),   # b -> z (frees b)
             (2, 1, "b", None),   # a -> b (b is free now)
             (3, 3, "a", None),   # c -> a (a freed by step 2)
             (4, 2, "c", None),   # z -> c (c freed by step 3)
             (5, 1, "c", None),   # conflict: c held by 2
             (6, 9, "q", None)]   # unknown key
    target = _df(spark, [(k, n, r) for k, (n, r) in table.items()], "id bigint, name string, ref bigint")
    b = _df(spark, batch, "seq bigint, id bigint, name string, ref bigint")
    res = W.update_rows(target, b, key=["id"], set_cols=["name", "ref"], unique=["name"])
    want, final = model_update(table, set(), batch)
    assert {r.seq: r.outcome for r in res.outcomes.collect()} == want
    assert want == {1: "OK", 2: "OK", 3: "OK", 4: "OK", 5: "CONFLICT", 6: "DOES_NOT_EXIST"}
    assert {r.id: (r.name, r.ref) for r in res.table.collect()} == final


@pytest.mark.parametrize("seed", range(6, 10))
def test_update_rows_dense_chains(spark, seed):
    rnd = random.Random(700 + seed)
    pool = ["a", "b", "c", "d"]
    table = {k: (pool[k] if k < 3 else None, None) for k in range(5)}
    batch = [(s + 1, rnd.randrange(6), rnd.choice(pool + [None]), rnd.choice([None, 1, 5])) for s in range(40)]
    target = _df(spark, [(k, n, r) for k, (n, r) in table.items()], "id bigint, name string, ref bigint")
    b = _df(spark, batch, "seq bigint, id bigint, name string, ref bigint")
    parent = _df(spark, [(1,)], "id bigint")
    res = W.update_rows(target, b, key=["id"], set_cols=["name", "ref"], unique=["name"],
                        fks={"ref": (parent, "id")})
    want, final = model_update(table, {1}, batch)
    assert {r.seq: r.outcome for r in res.outcomes.collect()} == want
    assert {r.id: (r.name, r.ref) for r in res.table.collect()} == final


@pytest.mark.parametrize("seed,keys,values", [(1, 6, 5), (2, 40, 60), (3, 3, 2)])
def test_update_rows_in_many_blocks(spark, monkeypatch, seed, keys, values):
    """Blocks of 20 changes, replayed until the holders at their begins are right;
    one key and one value hold a third of the batch."""
    from marketlane.operators import unique

    monkeypatch.setattr(unique, "BLOCK_ROWS", 20)
    rounds, replay = [], unique._replay
    monkeypatch.setattr(unique, "_replay", lambda *a: rounds.append(1) or replay(*a))
    rnd = random.Random(900 + seed)
    table = {k: (f"n{k}" if k < values and rnd.random() < 0.7 else None, None) for k in range(keys)}
    pick = lambda n: 0 if rnd.random() < 0.3 else rnd.randrange(n)
    batch = [(s + 1, pick(keys + 1), rnd.choice([None, *[f"n{pick(values)}"] * 6]), rnd.choice([None, 1, 1, 5])) for s in range(300)]
    target = _df(spark, [(k, n, r) for k, (n, r) in table.items()], "id bigint, name string, ref bigint")
    b = _df(spark, rnd.sample(batch, len(batch)), "seq bigint, id bigint, name string, ref bigint")
    res = W.update_rows(target, b, key=["id"], set_cols=["name", "ref"], unique=["name"], fks={"ref": (_df(spark, [(1,)], "id bigint"), "id")})
    want, final = model_update(table, {1}, batch)
    assert {r.seq: r.outcome for r in res.outcomes.collect()} == want
    assert {r.id: (r.name, r.ref) for r in res.table.collect()} == final
    assert 1 < len(rounds) <= 16


def test_generated_ids_beyond_32_bits(spark):
    from marketlane.operators import admin
    from marketlane.sources.tables import ShopTables

    t = ShopTables(spark, "/root/testdata/sf0.001")
    top = t.brands.agg({"id": "max"}).first()[0]
    res = admin.create_brands(t, _df(spark, [(3_000_000_000, "Far")], "seq bigint, name string"))
    assert [(r.id, r.outcome) for r in res.outcomes.collect()] == [(top + 3_000_000_000, "OK")]
    assert res.table.where("name = 'Far'").first().id == top + 3_000_000_000
