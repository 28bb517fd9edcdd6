"""Deletes with children: one statement at a time over small random tables."""

import random

import pytest

from marketlane.operators.parents import ForeignKey, delete_parents, walk_order

KEYS = [ForeignKey("b", "a_id", "a", on_delete="cascade"), ForeignKey("c", "b_id", "b", on_delete="cascade"), ForeignKey("d", "c_id", "c"),
        ForeignKey("e", "b_id", "b", on_delete="set_null"), ForeignKey("f", "a_id", "a")]
COLUMNS = {"a": "id bigint, n string", "b": "id bigint, a_id bigint", "c": "id bigint, b_id bigint", "d": "id bigint, c_id bigint", "e": "id bigint, b_id bigint", "f": "id bigint, a_id bigint"}


def model(tables, batch):
    out = {}
    for seq, key in sorted(batch):
        if key not in tables["a"]:
            out[seq] = "DOES_NOT_EXIST"
            continue
        b = {i for i, a in tables["b"].items() if a == key}
        c = {i for i, x in tables["c"].items() if x in b}
        if any(x in c for x in tables["d"].values()) or key in tables["f"].values():
            out[seq] = "FOREIGN_KEY_VIOLATION"
            continue
        out[seq] = "OK"
        del tables["a"][key]
        for name, gone in (("b", b), ("c", c)):
            tables[name] = {i: x for i, x in tables[name].items() if i not in gone}
        tables["e"] = {i: None if x in b else x for i, x in tables["e"].items()}
    return out


@pytest.mark.parametrize("seed", range(4))
def test_delete_parents_matches_model(spark, seed):
    rnd = random.Random(seed)
    ids = lambda n, up, share=0.9: {i: rnd.choice([*range(up), None]) for i in range(n) if rnd.random() < share}
    tables = {"a": {i: f"n{i}" for i in range(12)}, "b": ids(20, 12), "c": ids(25, 20), "d": ids(5, 25), "e": ids(20, 20), "f": ids(2, 12, 1)}
    batch = [(s + 1, rnd.choice([*range(14), None])) for s in range(20)]
    dfs = {n: spark.createDataFrame(list(t.items()), COLUMNS[n]) for n, t in tables.items()}
    result = delete_parents(dfs, "a", spark.createDataFrame(batch, "seq bigint, id bigint"), KEYS)
    want = model(tables, batch)
    assert {r.seq: r.outcome for r in result.outcomes.collect()} == want
    for name in ("a", "b", "c", "e"):
        assert {r[0]: r[1] for r in result.tables[name].collect()} == tables[name], name
    assert set(result.tables) == {"a", "b", "c", "e"}


def test_walk_order():
    assert [k.child for k in walk_order("a", KEYS)][0] in "bf" and {k.child for k in walk_order("b", KEYS)} == {"c", "d", "e"}
    with pytest.raises(ValueError):
        walk_order("a", [ForeignKey("b", "a_id", "a", on_delete="cascade"), ForeignKey("a", "b_id", "b", on_delete="cascade")])
    with pytest.raises(ValueError):
        walk_order("a", [ForeignKey("b", "a_id", "a", on_delete="ignore")])
