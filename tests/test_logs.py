"""Text logs and comma-separated captures: frames to text and back, bad lines, order over blocks and files."""

from pyspark.sql import functions as F

from busloom.plans.bus import bus
from busloom.sources import logs, sinks

COLUMNS = ["capture", "us", "aid", "dlc", "b"]


def test_round_trip(spark, data, monkeypatch):
    frames = bus(spark, data).frames
    path = sinks.scratch(spark, "t")
    logs.write_lines(frames.select("capture", "seq", logs.log_line().alias("value")), path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")  # many blocks a file
    try:
        read, bad = logs.read_logs(spark, path)
        got = read.orderBy("capture", "seq").collect()
        assert bad.count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = frames.orderBy("capture", "seq").select(*COLUMNS).collect()
    assert [tuple(r[c] for c in COLUMNS) for r in got] == [tuple(r) for r in want]
    places = {}
    for r in got:
        assert r.seq == places.get(r.capture, 0)
        places[r.capture] = r.seq + 1


def test_csv_round_trip(spark, data):
    frames = bus(spark, data).frames
    path = sinks.scratch(spark, "t")
    head = frames.select("capture").distinct().select("capture", F.lit(-1).cast("long").alias("seq"), F.lit(logs.HEADER).alias("value"))
    logs.write_lines(head.unionByName(frames.select("capture", "seq", logs.csv_line().alias("value"))), path)
    read, bad = logs.read_csv_captures(spark, path)
    assert bad.count() == 0
    assert sorted(map(repr, read.select(*COLUMNS, "y").collect())) == sorted(map(repr, frames.select(*COLUMNS, "y").collect()))


def test_bad_lines_are_kept_and_named(spark, tmp_path):
    lines = ["(1.5) can0 123#", "(12.000001) vcan1 1ABCDEFF#0102030405060708", "", "   ", "(1.5) can0 12#00", "(1.5) can0 123#0", "(1.5) can0 123#010203040506070809", "(x) can0 123#00", "(1.5) can0 123#0F1\\", "(2.25) can0 fff#Aa\r", "(3.0) can0 FFFFFFFF#00"]
    (tmp_path / "drive.log").write_text("\n".join(lines) + "\n")
    frames, bad = logs.read_logs(spark, f"file://{tmp_path}")
    assert [(r.capture, r.seq, r.us, r.aid, r.dlc, r.b) for r in frames.orderBy("seq").collect()] == [
        ("drive", 0, 1_500_000, 0x123, 0, [-1] * 8),
        ("drive", 1, 12_000_001, 0x1ABCDEFF, 8, [1, 2, 3, 4, 5, 6, 7, 8]),
        ("drive", 9, 2_250_000, 0xFFF, 1, [0xAA] + [-1] * 7),
    ]
    assert [(r.line, r.reason) for r in bad.orderBy("line").collect()] == [(2, "empty"), (3, "empty"), *[(i, "no frame") for i in (4, 5, 6, 7, 8)], (10, "identifier too large")]
    (tmp_path / "drive.log").write_text("")
    assert all(t.count() == 0 for t in logs.read_logs(spark, f"file://{tmp_path}"))


def test_csv_labels_and_no_labels(spark, tmp_path):
    (tmp_path / "c.csv").write_text(f"{logs.HEADER}\n1.5,0C1,00FF,1\n1.6,0C1,\n1.7,0C1,00,2\n1.8,0C1,00,0,9\n")
    frames, bad = logs.read_csv_captures(spark, f"file://{tmp_path}")
    assert [(r.seq, r.us, r.aid, r.dlc, r.y) for r in frames.orderBy("seq").collect()] == [(1, 1_500_000, 0xC1, 2, 1), (2, 1_600_000, 0xC1, 0, None)]
    assert [r.line for r in bad.orderBy("line").collect()] == [3, 4]


def test_frames_are_placed_alike_in_parts_of_any_size(spark, data, monkeypatch):
    from busloom.operators import messages

    frames = bus(spark, data).frames
    got = []
    for part in (65_536, 7):
        monkeypatch.setattr(messages, "PART", part)
        got.append(sorted(map(tuple, messages.placed(frames).select("capture", "seq", "ord", "n_capture", "dt").collect())))
    assert got[0] == got[1]
    by_capture = {}
    for capture, seq, us in sorted((r.capture, r.seq, r.us) for r in frames.collect()):
        by_capture.setdefault(capture, []).append((seq, us))
    for capture, seq, at, n, dt in got[0]:
        own = by_capture[capture]
        assert own[at][0] == seq and n == len(own) and dt == ((own[at][1] - own[at - 1][1]) / 1e6 if at else 0.0)
