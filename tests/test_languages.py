from gatewarden.operators import languages, render
from gatewarden.functions.text import path_extension
from pyspark.sql import functions as F


def tree(spark, **repos):
    rows = [(name, p) for name, paths in repos.items() for p in paths]
    return spark.createDataFrame(rows, "full_name string, path string")


def test_detection(spark):
    df = tree(
        spark,
        one=["a.go", "b/c.go"],
        several=[f"{i}.go" for i in range(3)] + [f"{i}.py" for i in range(4)] + ["x.rb"],
        tie=["a.py", "a.go"],
        none=["README", "a.PY", "x.txt"],
        pruned=["vendor/a.go", "x/node_modules/b.js", ".github/c.py"],
        named=["dist", "src/vendored/a.rs", "vendor.go"],
        below=["a.go", "b.go", "c.py"],
    )
    got = {r.full_name: (r.detected, r.language) for r in languages.detect_languages(df).collect()}
    assert got == {
        "one": ("go", "go"),
        "several": ("go, python, ruby", "go, python"),
        "tie": ("go, python", "go"),
        "none": ("", "javascript"),
        "pruned": ("", "javascript"),
        "named": ("go, rust", "go"),
        "below": ("go, python", "go"),
    }


def test_extensions(spark):
    paths = ["a.go", "x.y/a", "a.", ".go", "a.b.c", "d/.x.py", ""]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = {r.p: r.e for r in df.select("p", path_extension(F.col("p")).alias("e")).collect()}
    assert got == {"a.go": ".go", "x.y/a": "", "a.": ".", ".go": ".go", "a.b.c": ".c", "d/.x.py": ".py", "": ""}


def test_rendering(spark):
    repos = spark.createDataFrame([("o/a", "go"), ("o/b", "go, python")], "full_name string, language string")
    rows = {(r.full_name, r.tool): r.content for r in render.render(repos, enabled=()).collect()}
    assert set(t for _, t in rows) == {"codeql", "dependabot"}
    assert "language: [ 'go' ]" in rows["o/a", "codeql"]
    assert "language: \n        - 'go'\n        - 'python'\n" in rows["o/b", "codeql"]
    assert rows["o/a", "dependabot"] == rows["o/b", "dependabot"]
    assert render.render(repos).count() == 8


def test_normalised_names(spark):
    names = ["Go", "TSX", "Kotlin", "C#", "c++", "PHP", None, "go, python"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select(
        languages.scanner_language(F.col("n")).alias("s"), languages.ecosystem(F.col("n")).alias("e"))
    assert [tuple(r) for r in df.collect()] == [
        ("go", "gomod"), ("javascript", "npm"), ("java", "maven"), ("csharp", "nuget"), ("cpp", "npm"),
        ("javascript", "composer"), ("javascript", "npm"), ("javascript", "npm")]


def test_templates_from_a_folder(spark, tmp_path):
    (tmp_path / "codeql.yml").write_text("l: [ 'language' ]\n")
    (tmp_path / "own.yml").write_text("x: 'language'\n")
    templates = render.read_templates(spark, str(tmp_path))
    assert [(t.tool, t.target_path, t.optional) for t in templates] == [
        ("codeql", ".github/workflows/codeql.yml", False), ("own", ".github/workflows/own.yml", True)]
    repos = spark.createDataFrame([("o/a", "go, rust")], "full_name string, language string")
    rows = {r.tool: r.content for r in render.render(repos, templates, ("own",)).collect()}
    assert rows == {"codeql": "l: \n        - 'go'\n        - 'rust'\n", "own": "x: 'language'\n"}
    plain = {r.tool: r.content for r in render.render(repos, templates, ("own",), as_list=False).collect()}
    assert plain == {"codeql": "l: [ 'go, rust' ]\n", "own": "x: 'go, rust'\n"}


def test_any_number_of_templates_as_a_table(spark, tmp_path):
    (tmp_path / "codeql.yml").write_text("l: [ 'language' ]\n")
    for i in range(249):
        (tmp_path / f"own{i}.yml").write_text(f"x{i}: 'language'\n")
    table = render.template_files(spark, str(tmp_path))
    repos = spark.createDataFrame([("o/a", "go, rust"), ("o/b", "java")], "full_name string, language string")
    enabled = tuple(f"own{i}" for i in range(249))
    rows = {(r.full_name, r.tool): (r.path, r.content) for r in render.render(repos, table, enabled).collect()}
    assert len(rows) == 500
    assert rows["o/a", "codeql"] == (".github/workflows/codeql.yml", "l: \n        - 'go'\n        - 'rust'\n")
    assert rows["o/b", "own200"] == (".github/workflows/own200.yml", "x200: 'java'\n")
    assert [r.tool for r in render.render(repos.limit(1), table, ()).collect()] == ["codeql"]
    assert render.render(repos, table.limit(0)).count() == 0


def test_fixed_values_are_pinned():
    """The checks in SQL import these, so that an error in them would go unseen there."""
    from gatewarden.functions.text import UNICODE_SPACE
    from gatewarden.operators.languages import EXTENSION_LANGUAGE
    from gatewarden.operators.rules import CATALOG

    spaces = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    assert sorted(map(ord, UNICODE_SPACE)) == spaces
    of = dict(EXTENSION_LANGUAGE)
    assert len(of) == 19 and (of[".go"], of[".py"], of[".cs"], of[".rb"], of[".kt"]) == ("go", "python", "csharp", "ruby", "java")
    assert [e.rule_id for e in CATALOG] == [f"R{i:02d}" for i in range(1, 13)]
    assert [e.severity for e in CATALOG] == [
        "MEDIUM", "MEDIUM", "HIGH", "HIGH", "MEDIUM", "MEDIUM", "HIGH", "LOW", "LOW", "HIGH", "HIGH", "MEDIUM"]
