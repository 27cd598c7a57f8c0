from meshwork.streaming import results


def test_running_stats(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a.out").write_text("RESULT comm=bcast kernel=acc P=1 total_avg_ms=4\nnoise\n")
    query = results.running_stats(results.stream_records(spark, str(logs))).writeStream.outputMode("complete").format("memory").queryName("stats").start()
    try:
        query.processAllAvailable()
        (logs / "b.out").write_text("RESULT comm=bcast kernel=acc P=1 total_avg_ms=8\n")
        query.processAllAvailable()
        assert [tuple(r) for r in spark.sql("SELECT * FROM stats").collect()] == [("bcast", "acc", 2, 6.0, 4.0, 8.0)]
    finally:
        query.stop()


def test_repetitions_of_a_stream_are_those_of_the_batch(spark, tmp_path):
    """Repetitions that several files share, in the files' order; the last ones
    are cut short.  The stream starts twice, from its checkpoint."""
    import os
    import random

    from meshwork.sources import results
    from meshwork.streaming.results import stream_lines, stream_repetitions

    rnd = random.Random(8)
    lines = []
    for k in range(400):
        p = rnd.choice([1, 2, 3, 4])
        lines.append(f"  RESULT comm={rnd.choice('ab')} kernel=acc matrix=m{rnd.randrange(2)} P={p} rank={k % p} nnz_local={k} total_avg_ms={k / 8}")
        if k % 9 == 0:
            lines.append("=== noise ===")
    folder, files = tmp_path / "logs", []
    folder.mkdir()
    spark.conf.set("spark.sql.shuffle.partitions", "2")

    def put(name, some, age):
        path = folder / name
        path.write_text("\n".join(some) + "\n")
        os.utime(path, (1_700_000_000 + age, 1_700_000_000 + age))
        files.append(str(path))

    def run():
        out = stream_repetitions(stream_lines(spark, str(folder)))
        q = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start(str(tmp_path / "out"))
        assert q.awaitTermination(200)

    try:
        put("c.out", lines[:200], 0)
        put("a.out", lines[200:290], 60)
        run()
        put("b.out", lines[290:], 120)
        run()
        want = results.repetitions(results.parse(results.numbered_lines(spark, files)))
        key = ("matrix", "comm", "kernel", "P", "rep", "nnz_local", "total_avg_ms")
        got = sorted(tuple(r[c] for c in key) for r in spark.read.parquet(str(tmp_path / "out")).collect())
        assert got == sorted(tuple(r[c] for c in key) for r in want.collect()) and len(got) > 380
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
