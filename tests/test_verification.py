import pytest

from stratalog.operators.verification import RULES, verify_imports, verify_pair

ROOT = (0, "Lib", "Package", "Core", 0, True)


def status(imports, exports, engine):
    return {i: (s, r, x) for i, s, r, x in verify_pair([ROOT, *imports], exports, engine)}


def imp(i, name, cls="Texture", package="Engine", outer=-1, referenced=True):
    return (i, name, cls, package, outer, referenced)


def exp(i, name, cls="Texture", package="Engine", outer=0, public=True):
    return (i, name, cls, package, outer, (1 << 34) + 1 if public else 0)


@pytest.mark.parametrize("engine", RULES)
def test_common_rules(engine):
    exports = [exp(0, "group", "Package", "Core"), exp(1, "WOOD", outer=1), exp(2, "hidden", public=False)]
    imports = [imp(1, "Group", "Package", "Core"), imp(2, "wood", outer=-2), imp(3, "Hidden"), imp(4, "Gone"), imp(5, "below", outer=-5), imp(6, "self", outer=-7), imp(7, "lost", outer=-99), imp(8, "None"), imp(9, "a", outer=3), imp(10, "top", outer=0)]
    got = status(imports, exports, engine)
    assert got[0][0] == "package" and got[1] == ("resolved", None, 0) and got[2] == ("resolved", None, 1)
    assert got[3][0] == "private_export" and got[4][0] == ("missing" if engine >= 4 else "runtime_only") and got[5] == ("unresolved", "parent", None)
    assert got[6] == ("unresolved", "cycle", None) and got[7] == ("unresolved", "lost_parent", None)
    assert got[8][0] == ("unresolved" if engine == 4 else "ignored") and got[9][0] == ("invalid" if engine <= 2 else "unresolved") and got[10][0] == "invalid"


def test_what_differs():
    twice = [exp(4, "Wood"), exp(7, "Wood")]
    assert [status([imp(1, "wood")], twice, e)[1][2] for e in RULES] == [4, 7, 4, 4, 4]
    other = [exp(0, "Wood", package="Other")]
    assert [status([imp(1, "wood")], other, e)[1][0] for e in RULES] == ["runtime_only", "runtime_only", "runtime_only", "resolved", "missing"]
    pair = [exp(0, "Wood", package="UnrealShare")]
    assert [status([imp(1, "wood", package="UnrealI")], pair, e)[1][0] for e in RULES] == ["resolved", "resolved", "runtime_only", "resolved", "missing"]
    mesh = [exp(0, "Tree", cls="LodMesh")]
    assert [status([imp(1, "tree", cls="Mesh")], mesh, e)[1][0] for e in RULES] == ["resolved", "resolved", "runtime_only", "missing", "missing"]
    moved = [exp(0, "Old", cls="ObjectRedirector")]
    assert [status([imp(1, "old")], moved, e)[1][1] for e in RULES] == ["no_match", "no_match", "redirector", "no_match", "redirector"]
    loose = [exp(0, "g", "Package", "Core"), exp(1, "Wood", outer=0)]
    assert [status([imp(1, "g", "Package", "Core"), imp(2, "wood", outer=-2)], loose, e)[2][0] for e in RULES] == ["resolved", "resolved", "runtime_only", "missing", "missing"]
    private = [exp(0, "Wood", public=False)]
    assert [status([imp(1, "wood", referenced=False)], private, e)[1][0] for e in RULES] == ["private_export", "private_export", "runtime_only", "private_export", "private_export"]


def test_deep_chains_and_missing_providers(spark):
    deep = [(1, 0, "Lib", "Package", "Core", 0, True)] + [(1, i, f"g{i}", "Package", "Core", -i, True) for i in range(1, 3000)]
    imports = spark.createDataFrame([*deep, (2, 0, "Lib", "Package", "Core", 0, True), (2, 1, None, None, None, -1, None)], "pair_id long, index int, object_name string, class_name string, class_package string, outer_index int, referenced boolean")
    exports = spark.createDataFrame([(1, i - 1, f"g{i}", "Package", "Core", i - 1, 1) for i in range(1, 3000)], "pair_id long, index int, object_name string, class_name string, class_package string, outer_index int, flags long")
    got = {(r.pair_id, r["index"]): r.status for r in verify_imports(imports, exports, 4).collect()}
    assert got[1, 2999] == "resolved" and got[2, 0] == "package" and got[2, 1] == "unresolved" and len(got) == 3002
    assert verify_imports(imports, exports.limit(0), 4).count() == 3002 and verify_imports(imports.limit(0), exports, 4).count() == 0
