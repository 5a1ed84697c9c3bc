"""The line source over restarts and torn lines, the three sinks, and the jobs that use them."""

import os

import pytest
from pyspark.sql import functions as F

from emberline.plans import jobs
from emberline.session import scratch_path, ship_package
from emberline.sources import growing_lines
from emberline.streaming import scoring as S


@pytest.fixture(scope="module", autouse=True)
def package(spark):
    ship_package(spark)
    growing_lines.register(spark)


def lines(spark, folder, sink, ckpt, **options):
    stream = spark.readStream.format("growing_lines").options(**options).load(folder)
    q = stream.writeStream.format("parquet").option("checkpointLocation", ckpt).trigger(availableNow=True).start(sink)
    q.awaitTermination()
    return sorted((os.path.basename(r["file"]), r["at"], r["value"]) for r in spark.read.schema("value string, file string, at long").parquet(sink).collect())


def test_each_line_once_over_two_restarts(spark, tmp_path):
    folder, sink, ckpt = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ckpt")
    folder.mkdir()
    (folder / "a.log").write_bytes(b"one\ntwo\r\nthr")
    (folder / "_hidden").write_bytes(b"no\n")
    (folder / "empty.log").write_bytes(b"")
    assert lines(spark, str(folder), sink, ckpt) == [("a.log", 0, "one"), ("a.log", 4, "two")]
    with open(folder / "a.log", "ab") as f:
        f.write("ee é\n\nfive".encode())
    (folder / "b.log").write_bytes(b"x" * 200_000 + b"\nlast\n")
    want = [("a.log", 0, "one"), ("a.log", 4, "two"), ("a.log", 9, "three é"), ("a.log", 18, ""), ("b.log", 0, "x" * 200_000), ("b.log", 200_001, "last")]
    assert lines(spark, str(folder), sink, ckpt) == want
    assert lines(spark, str(folder), sink, ckpt) == want  # nothing new
    with open(folder / "a.log", "ab") as f:
        f.write(b"\n")
    assert lines(spark, str(folder), sink, ckpt) == sorted([*want, ("a.log", 19, "five")])


@pytest.mark.parametrize("piece", [1, 7, 64])
def test_pieces_share_out_the_lines(tmp_path, piece):
    file = tmp_path / "f.txt"
    said = ["", "a", "bc" * 40, "", "é", "x" * 13, "end"]
    file.write_bytes("".join(x + "\n" for x in said).encode())
    reader = growing_lines.LineReader({"path": str(file), "pieceBytes": str(piece)})
    end = reader.latestOffset()
    got = [row for p in reader.partitions({}, end) for row in reader.read(p)]
    assert [g[0] for g in got] == said and reader.latestOffset() == end
    small = growing_lines.LineReader({"path": str(file), "batchBytes": "5"})  # batches end at line ends, long lines come whole
    seen, start = [], {}
    for _ in range(20):
        end = small.latestOffset()
        seen += [row[0] for p in small.partitions(start, end) for row in small.read(p)]
        start = end
    assert seen == said


HEAD = "index,UTC,Temperature[C],Humidity[%],TVOC[ppb],eCO2[ppm],Raw H2,Raw Ethanol,Pressure[hPa],PM1,PM2_5,NC0_5,NC1_0,NC2_5,CNT,Fire Alarm"


def reading(i):
    return [i, 1000 + i, 20 + i % 7, 40.5, i % 50, 400, 12000 + i % 9, 19000, 938.0, 1.0, 2.0, 3.0, 4.0, 5.0, i, int(i % 50 > 24)]


@pytest.fixture(scope="module")
def fitted(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("jobs")
    for name, ids in (("train", range(240)), ("test", range(240, 320))):
        (base / f"{name}.csv").write_text("\n".join([HEAD, *(",".join(map(str, reading(i))) for i in ids)]))
    report = jobs.run_v2(spark, str(base / "train.csv"), str(base / "test.csv"), 5, str(base / "model"))
    assert {"weighted_f1", "auc_roc", "pr_recall"} <= {r["metric"] for r in report.collect()}
    return base


def test_score_job(spark, fitted):
    out = jobs.run_score(spark, str(fitted / "model"), str(fitted / "test.csv"), str(fitted / "scored"))
    assert out.count() == 80 and set(out.columns) == {"index", "prediction", "score", "label"}
    assert out.where("prediction = label").count() > 70


def test_stream_job_keeps_broken_lines_and_commits_all_sinks(spark, fitted):
    names = HEAD.split(",")
    json_line = lambda i: "{" + ", ".join(f'"{n}": {v}' for n, v in zip(names, reading(i))) + "}"
    source = fitted / "incoming"
    source.mkdir()
    (source / "one.jsonl").write_text("\n".join([json_line(1), "{broken", json_line(30), '{"index": 5}', json_line(40)]) + "\n")
    run = lambda: jobs.run_stream(spark, str(fitted / "model"), str(source), str(fitted / "sinks"), str(fitted / "ckpt"),
                                  alerts_only=False, available_now=True, fmt="growing_lines").awaitTermination()
    run()
    with open(source / "one.jsonl", "a") as f:
        f.write(json_line(41) + "\nnot json\n")
    run()
    read = lambda name: S.committed(spark, str(fitted / "sinks"), name)
    assert sorted(r["index"] for r in read("scored").collect()) == [1, 30, 40, 41]
    assert read("raw").count() == 7 and read("broken").count() == 3
    assert sorted(r["_corrupt"] or "" for r in read("broken").collect()) == ["", "not json", "{broken"]
    # an epoch whose commit is missing is not read from any sink
    extra = read("scored").drop("epoch").limit(1)
    extra.write.parquet(str(fitted / "sinks" / "scored" / "epoch=99"))
    assert read("scored").count() == 4
