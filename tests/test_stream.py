from gatewarden import corpus
from gatewarden.operators.scan import scan
from gatewarden.streaming import incremental

SCHEMA = "full_name string, repo_ord long, wf_ord int, path string, content string"


def bag(df):
    return sorted(tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect())


def test_arrivals_equal_one_scan(spark, tmp_path):
    files = corpus.workflow_files(spark, "/root/testdata/sf0.001").select(*[c.split()[0] for c in SCHEMA.split(", ")])
    first, second = files.where("repo_ord < 40"), files.where("repo_ord >= 40")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (first, second):
        part.write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 3).parquet(source)
        incremental.scan_arrivals(stream, out)
    assert bag(incremental.read_findings(spark, out)) == bag(scan(files))
    names = files.select("full_name").distinct().count()
    assert incremental.read_registry(spark, out).count() == names
    # Nothing new: nothing is scanned again.
    before = incremental.read_findings(spark, out).count()
    incremental.scan_arrivals(spark.readStream.schema(SCHEMA).parquet(source), out)
    assert incremental.read_findings(spark, out).count() == before
