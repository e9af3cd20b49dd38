from pyspark.sql import functions as F

from svlattice.operators import percentiles, refused
from svlattice.streaming import arrivals

SCHEMA = "ord long, file_id long, svtype string, qual string, support long, svlen long, loaded_at timestamp"


def test_sketches_of_batches_equal_those_of_the_whole(spark, tmp_path):
    rows = spark.range(600).select(
        F.col("id").alias("ord"), (F.col("id") % 3).alias("file_id"), F.lit("DEL").alias("svtype"), (F.col("id") % 97).cast("string").alias("qual"), (F.col("id") % 11).alias("support"),
        (-F.col("id")).alias("svlen"), F.expr("timestamp'2030-01-01' + make_interval(0, 0, 0, cast(id % 2 as int))").alias("loaded_at"),
    )
    files = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b")], "file_id long, caller string")
    source, sketches = str(tmp_path / "in"), str(tmp_path / "sketches")
    for part in (rows.where("ord < 200"), rows.where("ord >= 200")):  # two batches, the days mixed
        part.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        arrivals.grow_daily_sketches(stream, files, sketches, str(tmp_path / "state")).awaitTermination(120)
    got = {(r.caller, r.day, r.measure): (r.n, r.p50) for r in arrivals.read_daily(spark, sketches).collect()}
    whole = percentiles.read_percentiles(percentiles.daily_sketches(rows, files), ["caller", "svtype", "day"])
    assert got == {(r.caller, r.day, r.measure): (r.n, r.p50) for r in whole.collect()} and len(got) == 12


def test_refused_lines_of_a_stream(spark, tmp_path):
    good = "chr1\t5\ta\tN\t<DEL>\t.\tPASS\tA=1"
    spark.createDataFrame([(1, 1, 1, good), (2, 1, 2, good + "\tx"), (3, 1, 3, 'a"b')], "line_id long, file_id long, line_no long, line string").write.parquet(str(tmp_path / "in"))
    files = spark.createDataFrame([(1, "svim")], "file_id long, caller string")
    stream = spark.readStream.schema("line_id long, file_id long, line_no long, line string").parquet(str(tmp_path / "in"))
    query = refused.refused(stream, files).writeStream.format("memory").queryName("refused_now").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r.line_id, r.reason) for r in spark.table("refused_now").collect()) == [(2, "columns"), (3, "quote")]
