import random

from quillspark.operators import knowledge


def test_look_up_by_equal_keys(spark):
    r = random.Random(3)
    some = lambda: r.choice([None, "", "a", "b"])
    kb = [(some(), some(), some(), some(), [f"i{k}"], [f"o{k}"], k) for k in range(60)]
    asked = [(k, some(), some(), some(), some()) for k in range(200)]

    def plain(library, module, caller, api):
        rows = [k for k in kb if (library is None or (k[0] or "") == library) and (module is None or (k[1] or "") == module)]
        strict = [k for k in rows if caller is not None and k[2] == caller]
        rows = [k for k in (strict or [k for k in rows if k[2] is None]) if ((k[3] or "") == api if api is not None else k[3] is None)]
        return (rows[0][4], rows[0][5]) if rows else ([], [])

    table = spark.createDataFrame(kb, "library string, module string, caller string, api string, inputs array<string>, outputs array<string>, ord long").repartition(5)
    got = knowledge.look_up(spark.createDataFrame(asked, "ask_id int, library string, module string, caller string, api string"), table)
    assert {x.ask_id: (x.inputs, x.outputs) for x in got.collect()} == {k: plain(*rest) for k, *rest in asked}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
