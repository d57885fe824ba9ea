from strandline.sources import publish as pb


def test_a_run_is_in_view_only_when_published_and_a_rerun_replaces_it(spark, tmp_path):
    path, table = str(tmp_path / "out"), lambda n: {"a": spark.range(n), "b": spark.range(n + 1)}
    assert pb.published_run(spark, path) is None and pb.published(spark, path, "a") is None
    pb.write_run(table(9), path)  # broken off before its last write
    assert pb.published(spark, path, "a") is None
    first = pb.publish(table(1), path, "2026-01-01")
    pb.write_run(table(9), path)
    assert pb.published_run(spark, path) == first and pb.published(spark, path, "b").count() == 2
    second = pb.publish(table(3), path, "2026-01-01")
    assert pb.published_run(spark, path) == second and pb.published(spark, path, "a").count() == 3
    other = pb.publish(table(5), path, "2026-01-02")
    pb.publish(table(7), path, "2026-01-01")  # an earlier day run late does not hide the latest one
    assert pb.published_run(spark, path) == other
    assert pb.published(spark, path, "a", "2026-01-01").count() == 7 and pb.published_run(spark, path, "2026-02-01") is None
