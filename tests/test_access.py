"""Entitlements over several levels of reporting lines."""

from quotaflow.operators import access

LINES = [("ceo", "north"), ("ceo", "south"), ("north", "n1"), ("n1", "n2"), ("n2", "n1"), ("south", "south"), ("x", None), (None, "ceo"), ("n1", "n2")]
OWNS = [("n2", "7"), ("n1", "8"), ("south", "9"), ("south", "7"), ("lonely", "1"), ("n2", None), (None, "5")]


def frames(spark):
    return spark.createDataFrame(OWNS, "viewer string, owner_id string"), spark.createDataFrame(LINES, "manager string, member string")


def plain(viewer):
    seen, todo = set(), [viewer]
    while todo:
        at = todo.pop()
        if at not in seen:
            seen.add(at)
            todo += [m for manager, m in LINES if manager == at and m is not None]
    return {owner for v, owner in OWNS if v in seen and owner is not None}


def test_all_levels_and_circles(spark):
    entitlements, lines = frames(spark)
    got = {}
    for r in access.entitled_owners(entitlements, lines).collect():
        got.setdefault(r.viewer, []).append(r.owner_id)
    viewers = {v for v, _ in [*OWNS, *LINES] if v is not None}
    assert {v: sorted(o) for v, o in got.items()} == {v: sorted(plain(v)) for v in viewers if plain(v)}


def test_one_viewer(spark):
    entitlements, lines = frames(spark)
    deals = spark.createDataFrame([(o, i) for i, o in enumerate(["7", "8", "9", "1", "7", None])], "owner_id string, id int")
    for viewer in ("ceo", "north", "n2", "south", "lonely", "nobody"):
        got = access.visible_rows(deals, viewer, "manager", entitlements, lines=lines)
        assert {r.owner_id for r in got.collect()} == plain(viewer) & {"7", "8", "9", "1"}
    assert access.visible_rows(deals, "ceo", "leader", entitlements, lines=lines).count() == 6
    assert [r.id for r in access.visible_rows(deals, "8", "rep").collect()] == [1]


def test_a_long_line(spark):
    lines = spark.createDataFrame([(f"m{i}", f"m{i + 1}") for i in range(12)], "manager string, member string")
    entitlements = spark.createDataFrame([("m12", "deep")], "viewer string, owner_id string")
    assert {r.viewer for r in access.entitled_owners(entitlements, lines).collect()} == {f"m{i}" for i in range(13)}


def test_no_lines(spark):
    entitlements, lines = frames(spark)
    got = access.entitled_owners(entitlements, lines.limit(0))
    assert sorted(map(tuple, got.collect())) == sorted((v, o) for v, o in OWNS if v is not None and o is not None)
