import io
import json

import pytest

from veilgrid import cli
from veilgrid.operators import hints


def test_candidates(spark):
    df = spark.createDataFrame([("Ann", "a@b.org", "34", "東京都", "note 4111111111111111"), ("Bo", "c@d.net", "51", "大阪府", "")], "name string, contact string, age string, `都道府県` string, memo string")
    found = hints.scan(df)
    best = {r["column"]: (r["rule"], r["role"], r["evidence"]) for r in hints.candidates(found).where("rank = 1").collect()}
    assert best["contact"] == ("email", "id", "value") and best["age"] == ("age", "qi", "name_and_value") and best["都道府県"] == ("prefecture", "qi", "name_and_value") and best["name"] == ("person_name", "id", "name")
    assert hints.provisional_roles(found, df.columns)["memo"] == "keep"
    wrong = {r["column"]: r.suggested for r in hints.role_mismatches(found, {"name": "keep", "contact": "keep", "age": "keep", "都道府県": "qi", "memo": "keep"}).collect()}
    assert wrong == {"age": "qi"}


def test_packs_are_strict():
    pack = {"schema": 1, "id": "p", "version": "1", "rules": [{"id": "r", "names": ["Ｘ"], "shape": "##", "role": "qi"}]}
    (rule,) = hints.load_pack(json.dumps(pack).encode())
    assert rule.names == ("x",) and rule.pack == "p"
    for bad in ({**pack, "more": 1}, {**pack, "rules": pack["rules"] * 2}, {**pack, "rules": [{"id": "r", "odd": 1}]}, {**pack, "rules": [{"id": "r", "role": "king"}]}):
        with pytest.raises(ValueError):
            hints.load_pack(json.dumps(bad).encode())
    with pytest.raises(ValueError):
        hints.merged([rule], [rule])


def test_verbs(spark, tmp_path):
    (tmp_path / "t.csv").write_text("name,age,city\nAlice,30,Osaka\nBob,30,Osaka\nCarol,40,Kyoto\nDave,40,Kyoto\nEve,25,Nara\n")
    (tmp_path / "u.csv").write_text("name,age,city\nAlice,31,Osaka\nBob,30,Osaka\n")
    columns = {"city": {"role": "qi"}, "name": {"role": "drop"}} | {"age": {"gen": {"widths": [10], "type": "numeric"}, "role": "qi"}}
    config = {"max_suppression": 0.2, "k": 2, "columns": columns}
    (tmp_path / "c.json").write_text(json.dumps(config))
    run = lambda *a: (cli.main(list(map(str, a)), out := io.StringIO()), out.getvalue())
    assert run("inspect", tmp_path / "t.csv")[0] == 0
    code, said = run("diff", tmp_path / "t.csv", tmp_path / "u.csv", "--key", "name")
    assert code == 1 and json.loads(said) == {"same": 1, "changed": 1, "removed": 3, "added": 0, "duplicate_keys": 0}
    assert run("diff", tmp_path / "t.csv", tmp_path / "t.csv", "--key", "name")[0] == 0
    code, said = run("run", tmp_path / "t.csv", "-c", tmp_path / "c.json", "-o", tmp_path / "o.csv")
    assert code == 0 and (tmp_path / "o.csv").read_text().startswith("age,city\n") and (tmp_path / "o.csv").read_text().count("\n") == 5
    (tmp_path / "c.json").write_text(json.dumps({**config, "k": 50}))
    (tmp_path / "bad.csv").write_text("a,b\n1\n")
    assert run("inspect", tmp_path / "bad.csv") == (1, '{"refused": "ragged_row"}\n')
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.txt").write_text("x")
    assert run("manifest", tmp_path / "d", "-o", tmp_path / "m.json")[0] == 0
    assert run("verify", tmp_path / "m.json", tmp_path / "d")[0] == 0
    (tmp_path / "d" / "x.txt").write_text("y")
    code, said = run("verify", tmp_path / "m.json", tmp_path / "d")
    assert code == 1 and json.loads(said) == {"path": "x.txt", "reason": "input_changed"}
