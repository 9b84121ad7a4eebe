from brindle.streaming.watch import Watch, delay


def test_changes_settle_after_a_quiet_poll(spark):
    seen = []
    watch = Watch(lambda df: seen.append([r.path for r in df.collect()]))
    listing = lambda **files: spark.createDataFrame(list(files.items()) or [], "path string, stamp string")
    assert [watch.poll(listing(**f)) for f in ({"a": "1", "b": "1"}, {"a": "1", "b": "1"}, {"a": "2", "b": "1"}, {"a": "2"}, {"a": "2"}, {"a": "2"})] == [False, False, False, False, True, False]
    assert seen == [["a", "b"]]


def test_stream_feeds_the_watch(spark, tmp_path):
    seen = []
    watch = Watch(lambda df: seen.append([r.path for r in df.collect()]))
    source = tmp_path / "listings"
    source.mkdir()
    stream = spark.readStream.schema("path string, stamp string").option("maxFilesPerTrigger", 1).json(str(source))
    query = watch.run(stream, str(tmp_path / "checkpoint"))
    for k, stamp in enumerate("122"):
        (source / f"{k}.json").write_text(f'{{"path": "a", "stamp": "{stamp}"}}\n')
        query.processAllAvailable()
    query.stop()
    assert seen == [["a"]]


def test_delays():
    assert [delay(i, 0.0, False) for i in (4, 5, 6, 9)] == [0.0, 0.25, 0.5, 2.0]
    assert delay(9, 0.0, True) == 0.0 and delay(1, 0.05, False) == 0.5
