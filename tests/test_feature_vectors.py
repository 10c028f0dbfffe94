"""Assembled feature vectors: widths of the presets, places of the groups, empty and odd nodes."""

import pytest

from quillspark.operators import features

NODES = "nb_id long, node_id string, ord long, struct_type int, code string, label string, cell_id string"
EDGES = "nb_id long, src string, dst string, ord long"
#: Widths of the presets.
WIDTHS = {"standard": 315, "emb_rich": 924, "all": 929, "emb_only": 300, "api_lib": 600, "api29": 329, "api24": 324, "struct_only": 15}


def test_widths_name_their_groups():
    for name, width in WIDTHS.items():
        groups = features.PRESETS[name].split()
        assert features.layout(groups)[-1][2] == width and features.groups_of(width) == groups
    assert features.groups_of(900) == ["code_emb", "api_emb", "lib_emb"]
    assert features.groups_of(303) == ["code_emb", "degree", "cell_pos"]
    assert features.groups_of(7) == features.STANDARD


def graph(spark):
    n = [(1, "p", 0, 8, "'a.csv'", "a.csv", "c0"), (1, "r", 1, 9, "pd.read_csv('a.csv')", "read_csv", "c0"), (1, "d", 2, 0, "df", "df", "c0"), (1, "f", 3, 9, "m.fit(df, y)", "fit", "c1"), (1, "lone", 4, 9, None, None, None)]
    e = [(1, "p", "r", 0), (1, "r", "d", 1), (1, "d", "f", 2), (1, "d", "f", 3)]
    return spark.createDataFrame(n, NODES), spark.createDataFrame(e, EDGES)


def test_assemble_places(spark):
    n, e = graph(spark)
    groups = "degree cell_pos neighbor lib_category lineage_struct semantic_anchor".split()
    got = {r["node_id"]: r["features"] for r in features.assemble(n, e, groups).collect()}
    at = {g: slice(a, b) for g, a, b in features.layout(groups)}
    assert set(got) == {"r", "f", "lone"} and all(len(v) == 24 for v in got.values())
    assert got["r"][at["degree"]] == [1, 1] and got["f"][at["degree"]] == [2, 0] and got["lone"][at["degree"]] == [0, 0]
    assert [got[k][at["cell_pos"]] for k in ("r", "f", "lone")] == [[0], [1], [0.5]]
    assert got["r"][at["neighbor"]] == [0, 1] and got["f"][at["neighbor"]] == [1, 0]
    assert got["r"][at["lib_category"]][0] == 1 and sum(got["lone"][at["lib_category"]]) == 0
    assert got["r"][at["semantic_anchor"]] == [1, 1, 0] and got["f"][at["semantic_anchor"]] == [1, 1, 1]
    # r: two edges lead on from df to f, both to a call; a loader; df is the variable that it is assigned to
    assert got["r"][at["lineage_struct"]] == [0, 0.4, 1, 1, 1, 1, 0, 0, 0.4, 1]


def test_assemble_every_preset(spark):
    n, e = graph(spark)
    for name in ("standard", "all"):
        assert {len(r["features"]) for r in features.assemble(n, e, features.PRESETS[name].split()).collect()} == {WIDTHS[name]}
    empty = features.assemble(n.limit(0), e.limit(0), ["degree", "cell_pos"])
    assert empty.count() == 0


def test_assemble_refuses(spark):
    n, e = graph(spark)
    with pytest.raises(ValueError, match="no such feature groups"):
        features.assemble(n, e, ["degrees"])
    with pytest.raises(Exception, match="has to be 300 wide"):
        features.assemble(n, e, ["code_emb"], lambda df, t, o: features.embed(df, t, o, 16)).collect()
