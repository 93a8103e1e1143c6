import json

from graphloom.cli import main
from graphloom.operators import checks
from graphloom.sources import html, services


def test_operations_from_pages(spark):
    page = "<h1>Update a hold</h1><p>Changes it. PATCH /api/v1/holds/{id} is the path.</p><h2>Request parameters</h2><table><tr><th>Name</th><th>Type</th><th>Description</th></tr><tr><td>id</td><td>long</td><td>the key</td></tr></table><h2>Request body</h2><table><tr><th>Name</th></tr><tr><td>Reason</td></tr></table>"
    other = "<h1>Get all rates</h1><p>No path is given.</p>"
    sections = html.page_sections(spark.createDataFrame([("u1", page), ("u2", other), ("u3", None)], "url string, html string"))
    ops = {r.url: r for r in services.operations(sections).collect()}
    assert (ops["u1"].method, ops["u1"].endpoint_path, ops["u1"].resource_name) == ("PATCH", "/api/v1/holds/{id}", "holds")
    assert ops["u1"].parameters[0]["name"] == "id" and ops["u1"].attributes[0]["name"] == "Reason"
    assert (ops["u2"].method, ops["u2"].endpoint_path, ops["u2"].resource_name) == ("GET", None, "Get all rates")
    rolled = {r.resource_name: r.n_operations for r in services.resource_rollup(services.operations(sections)).collect()}
    assert rolled["holds"] == 1


def test_environment_metadata(spark):
    doc = json.dumps({"Resources": {"holds": {"title": "Holds", "attributes": [{"name": "Reason_c", "type": "string"}, {"name": "HoldDFF", "type": "array"}], "children": {"lines": {"title": "Lines"}}}, "Extra_c": {}}})
    r = services.describe_resources(spark.createDataFrame([(doc,), ("{bad",)], "payload string"))
    got = {x.name: x for x in r.collect()}
    assert got["holds"].children == ["lines"] and [a["is_custom"] for a in got["holds"].attributes] == [True, False] and got["Extra_c"].is_custom
    assert [x.name for x in services.select_resources(r, exclude="^extra", custom_only=True).collect()] == ["holds"]
    assert [x.name for x in services.select_resources(r, limit=1).collect()] == ["Extra_c"]
    s = services.environment_stats(r).first()
    assert (s.n_resources, s.n_attributes, s.n_custom, s.n_flexfields, s.n_children) == (2, 2, 1, 1, 1)


def test_command_line(spark, tmp_path, capsys):
    assert main(["queries"]) == 0 and "hybrid_search" in capsys.readouterr().out
    assert main(["validate-environment", str(tmp_path)], spark) == 0
    assert main(["validate-environment", str(tmp_path / "none")], spark) == 1


def test_file_checks(spark, tmp_path):
    (tmp_path / "a.json").write_text("{}")
    (tmp_path / "e.json").write_text("")
    (tmp_path / "l.jsonl").write_text('{"a":1}\n{bad\n')
    codes = {r.subject: r.code for r in checks.validate_files(spark, str(tmp_path), {"a.json": True, "e.json": True, "m.json": True, "o.json": False}).collect()}
    assert codes == {"a.json": "FILE_EXISTS", "e.json": "FILE_EMPTY", "m.json": "FILE_MISSING", "o.json": "FILE_NOT_REQUIRED"}
    assert checks.validate_json_lines(spark, str(tmp_path / "l.jsonl")).first()["details"]["bad_lines"] == "1"
