from strandline.operators import kmers as K
from strandline.streaming.screen import screen_stream


def test_stream_equals_table(spark, tmp_path):
    bait = spark.createDataFrame([("ACGTTGCATGCCGATC",)], "seq string")
    rows = [(1, "ACGTTGCATGCCGATC"), (2, "TTTTGGGTACACTTAG"), (3, "GATCGGCATGCAACGT")]
    table = spark.createDataFrame(rows, "id long, seq string")
    table.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    screen_stream(stream, bait, 5, 70.0, "id", f"{tmp_path}/out", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination(120)
    got = {(r.id, r.hits, r.length) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(r.id, r.hits, r.length) for r in K.screen(table, bait, 5, 70.0, "id").collect()} and len(got) == 2
