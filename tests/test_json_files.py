"""Arrays of objects read by ranges, against the standard library."""

import json
import random

import pytest

from quarrywell.sources import json_files


def some_objects(n, seed):
    r = random.Random(seed)
    odd = ['"', "\\", "{", "}", "[", "]", ",", "é", "😀", "\n", " ", 'x"}', "\\\\", '\\"', "plain words "]
    text = lambda: "".join(r.choice(odd) for _ in range(r.randint(0, 12)))
    return [{"memory_id": f"m{k}", "user_id": "u", "content": text() or "x", "metadata": {"k": [1, {"a": text(), "b": {}}, []], text(): text()}, "tags": [text()]} for k in range(n)]


@pytest.mark.parametrize("size,form", [(40, {}), (64, {"indent": 2}), (333, {"ensure_ascii": False}), (1 << 20, {"separators": (",", ":")}), (97, {"indent": 1, "ensure_ascii": False})])
def test_objects_of_an_array(spark, tmp_path, size, form):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    one, two = some_objects(30, size), some_objects(7, size + 1)
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "1.json").write_text("\n " + json.dumps(one, **form) + "\n", encoding="utf-8")
    (tmp_path / "a" / "2.json").write_text(json.dumps(two, **form), encoding="utf-8")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = sorted((r["place"], r["json"]) for r in json_files.array_objects(spark, f"{tmp_path}/a").collect())
        assert [p for p, _ in got] == list(range(37))
        assert [json.loads(t) for _, t in got] == one + two
        rows = {r["memory_id"]: r for r in json_files.imported(spark, f"{tmp_path}/a/1.json", "2024-02-01 00:00:00").collect()}
        assert {k: (r["content"], r["tags"], json.loads(r["metadata"])) for k, r in rows.items()} == {o["memory_id"]: (o["content"], o["tags"], o["metadata"]) for o in one}
        assert sorted(rows, key=lambda k: rows[k]["seq"]) == [o["memory_id"] for o in one]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_odd_files(spark, tmp_path):
    for k, (text, n) in enumerate((("[]", 0), ("", 0), ("  [ ]\n", 0), ('[{"memory_id":"a","user_id":"u","content":"c"}]', 1), ('{"memory_id":"a","user_id":"u","content":"[{"}\n{"memory_id":"b","user_id":"u","content":"}"}\n', 2), ('[1, "x", {"memory_id":"a","user_id":"u","content":"c"}, [{"no": 1}], null]', 1))):
        path = tmp_path / f"{k}.json"
        path.write_text(text)
        assert json_files.imported(spark, f"file://{path}", "2024-02-01 00:00:00").count() == n
    bad = tmp_path / "bad.json"
    bad.write_text('[{"memory_id":"a","user_id":"u"}]')
    with pytest.raises(Exception, match="mandatory"):
        json_files.imported(spark, f"file://{bad}").collect()
