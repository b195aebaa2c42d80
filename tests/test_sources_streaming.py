from tessera.sources.rooms import sections, write_records
from tessera.streaming.progress import progress

SF = "/root/testdata/sf0.001"


def test_room(spark, tmp_path):
    room = tmp_path / "room"
    (room / "sub").mkdir(parents=True)
    (room / "a.txt").write_text("1. Scope\n\nfirst\nsecond\n\n\nthird\n")
    (room / "sub/b.csv").write_text('Item,Value\n"two\nlines",5\n , \nx,7\n')
    (room / "c.eml").write_text("From: p@x.org\nTo: q@x.org\nSubject: Hi\n\nbody one\n\nbody two\n")
    (room / "d.mbox").write_text("From p@x.org Mon\nFrom: p@x.org\nSubject: A\n\nline\n\nFrom q@x.org Tue\nFrom: q@x.org\nSubject: B\n\nother\n")
    (room / ".hidden.txt").write_text("no")
    (room / "e.bin").write_text("no")
    got = {r["anchor"]: r for r in sections(spark, f"file://{room}").collect()}
    assert {a for a in got if a.startswith("a.txt")} == {"a.txt#l1", "a.txt#l3", "a.txt#l7"}
    assert got["a.txt#l3"]["text"] == "first\nsecond" and got["a.txt#l7"]["heading"] == "1. Scope"
    assert got["sub/b.csv#r2"]["cells"] == ["two\nlines", "5"] and "sub/b.csv#r3" not in got
    assert got["c.eml#l1"]["text"] == "body one" and got["c.eml#l4"]["text"] == "From: p@x.org" and got["c.eml#l6"]["ordinal"] == 3
    assert got["d.mbox#m2l1"]["heading"] == "q@x.org | B"
    write_records(sections(spark, f"file://{room}"), f"{tmp_path}/out", ["doc", "ordinal"])
    assert spark.read.json(f"{tmp_path}/out").count() == len(got)


def test_stream_equals_table(spark, tmp_path):
    table = spark.read.parquet(f"{SF}/events.parquet")
    (tmp_path / "in").mkdir()
    table.repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/in")
    stream = progress(spark.readStream.schema(table.schema).parquet(f"{tmp_path}/in"), late="90 days")
    asked = stream.writeStream.outputMode("complete").format("memory").queryName("progress").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    asked.awaitTermination(120)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(spark.table("progress")) == rows(progress(table))
