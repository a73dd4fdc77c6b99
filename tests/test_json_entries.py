"""Documents of any layout, cut into entries over many blocks."""

import json
import random

import pytest

from gatewarden.sources import registry_files
from gatewarden.sources.json_entries import read_entries


@pytest.fixture
def small_blocks(spark):
    names = {"spark.sql.files.maxPartitionBytes": "900", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def entries(spark, path):
    out = {}
    rows = [json.loads(r.value) for r in read_entries(spark, str(path)).collect()]
    for row in rows:
        assert not set(row) & set(out)
        out.update(row)
    return out


TEXTS = ["plain", "}", "{", '"', '\\', '\\"}', '{"a":{}}', "},{", "é}ü", "", "a\nb", '\\\\"', "]}[{", "x" * 700, '"}' * 90]


def document(seed, n):
    r = random.Random(seed)
    return {
        f"o{i}/" + r.choice(TEXTS): {
            "full_name": f"o{i}", "success": r.random() < 0.5, "message": "".join(r.choices(TEXTS, k=r.randint(0, 4))),
            **({"deep": {"a": [{"b": r.choice(TEXTS)}, {}]}} if r.random() < 0.3 else {}),
        }
        for i in range(n)
    }


@pytest.mark.parametrize("seed, style", [(1, {}), (2, {"separators": (",", ":")}), (3, {"indent": 4, "ensure_ascii": False}), (4, {"indent": 2})])
def test_layouts_over_many_blocks(spark, tmp_path, small_blocks, seed, style):
    doc = document(seed, 120)
    (tmp_path / "d.json").write_text(json.dumps(doc, **style))
    assert spark.read.option("lineSep", "}").text(str(tmp_path / "d.json")).rdd.getNumPartitions() > 10
    assert entries(spark, tmp_path / "d.json") == doc


def test_documents_in_a_row_and_parts_of_one(spark, tmp_path, small_blocks):
    a, b = document(5, 30), {"z" + k: v for k, v in document(6, 30).items()}
    (tmp_path / "two").mkdir()
    for name, doc, tail in (("a", a, "\n"), ("b", {}, ""), ("c", b, "")):
        (tmp_path / "two" / f"{name}.json").write_text(json.dumps(doc) + tail)
    assert entries(spark, tmp_path / "two") == {**a, **b}
    text = json.dumps(a)
    (tmp_path / "parts").mkdir()
    cuts = [0, *(at for at in range(1234, len(text), 1234) if text[at - 1] != "\\"), len(text)]
    for i, (start, end) in enumerate(zip(cuts, cuts[1:])):
        (tmp_path / "parts" / f"part-{i:03}.json").write_text(text[start:end])
    assert entries(spark, tmp_path / "parts") == a


@pytest.mark.parametrize("text, expected", [
    ("", {}), ("{}", {}), (" \n", {}), ("{ }\n", {}), ('{"a":{}}', {"a": {}}), ('{"a":null,"b":{"c":1},"d":2}', {"a": None, "b": {"c": 1}, "d": 2}),
    ('{"a":{"b":1},"c":{"d":"cut o', {"a": {"b": 1}})])
def test_edges(spark, tmp_path, text, expected):
    (tmp_path / "e.json").write_text(text)
    assert entries(spark, tmp_path / "e.json") == expected


def test_a_registry_on_one_line_equals_the_indented_one(spark, tmp_path, small_blocks):
    doc = {
        k: {"full_name": k, "processed_at": f"2024-01-01T00:00:{i % 60:02}Z", "success": v["success"], "message": v["message"]}
        for i, (k, v) in enumerate(document(7, 200).items())
    }
    (tmp_path / "flat.json").write_text(json.dumps(doc))
    (tmp_path / "wide.json").write_text(json.dumps(doc, indent=8))
    (tmp_path / "indented.json").write_text(json.dumps(doc, indent=2))
    rows = [sorted(map(str, registry_files.read_registry(spark, str(tmp_path / f"{n}.json")).collect())) for n in ("flat", "wide", "indented")]
    assert rows[0] == rows[1] == rows[2] and len(rows[0]) == len(doc)


def test_texts_are_not_held_by_one_task(spark, tmp_path, small_blocks):
    """The one window without a key sees a row a block and no text."""
    (tmp_path / "d.json").write_text(json.dumps(document(8, 50)))
    plan = read_entries(spark, str(tmp_path / "d.json"))._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line]
    assert not any("text" in w or "value" in w for w in windows)
