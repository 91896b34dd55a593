"""Formats to files and back, and live streams."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from retinaspark.operators import filters, represent
from retinaspark.schema import SensorMeta
from retinaspark.sources import codecs
from retinaspark.sources.files import detect_format, export_png, from_numpy, load, load_frame, load_mask, save, save_frame, save_mask
from retinaspark.sources.udp import UdpReceiver, UdpSender
from retinaspark.streaming import live

RNG = np.random.default_rng(3)
EV = np.column_stack([RNG.integers(0, 60, 400), RNG.integers(0, 40, 400), np.sort(RNG.integers(0, 300_000, 400)), RNG.integers(0, 2, 400)])


def stream(spark, ev=EV, size=(60, 40)):
    return from_numpy(spark, ev, sensor_size=size)


def rows(s):
    return [tuple(map(int, r)) for r in s.df.orderBy("seq").select("x", "y", "t", F.col("p").cast("int")).collect()]


@pytest.mark.parametrize("name", ["a.txt", "a.npz", "a.dat", "a.raw", "a.aedat", "a.aedat4", "a.bag", "a.parquet"])
def test_round_trip(spark, tmp_path, name):
    s = stream(spark)
    save(s, str(tmp_path / name))
    back = load(spark, str(tmp_path / name), sensor_size=(60, 40))
    assert rows(back) == rows(s)
    cut = load(spark, str(tmp_path / name), sensor_size=(60, 40), offset=100_000, max_events=20)
    assert rows(cut) == [r for r in rows(s) if r[2] >= 100_000][:20]


def test_evt3_and_vectors(spark, tmp_path):
    s = stream(spark)
    save(s, str(tmp_path / "b.raw"), evt=3)
    assert rows(load(spark, str(tmp_path / "b.raw"))) == rows(s)
    words = [0x8001, 0x6002, 0x0005, 0x3800 | 10, 0x4000 | 0b101, 0x5000 | 0b1]
    x, y, t, p = codecs.decode_evt3(np.array(words, "<u2").tobytes())
    assert x.tolist() == [10, 12, 22] and set(y) == {5} and set(t) == {(1 << 12) + 2} and p.all()


def test_clock_wraps():
    high = np.array([0x8FFFFFFF, 0x10000000, 0x80000000, 0x10000000], "<u4")
    _, _, t, _ = codecs.decode_evt2(high.tobytes())
    assert t[1] - t[0] == 64
    data = codecs.encode_aedat2([1, 1], [2, 2], [2**32 - 1, 2**32 + 5], [1, 0], 180)
    assert codecs.decode_aedat2(data, 180)[2].tolist() == [2**32 - 1, 2**32 + 5]


def test_text_headers_and_errors(spark, tmp_path):
    p = tmp_path / "h.csv"
    p.write_text("# made by hand\npolarity,x,y,timestamp\n1,3,2,10\n-1,4,1,20\n")
    assert rows(load(spark, str(p))) == [(3, 2, 10, 1), (4, 1, 20, 0)]
    p.write_text("0.001 1 2 1\n")
    assert rows(load(spark, str(p), time_unit="s")) == [(1, 2, 1000, 1)]
    with pytest.raises(ValueError):
        detect_format("a.xyz")
    with pytest.raises(ValueError):
        save(stream(spark, EV[::-1]), str(tmp_path / "c.raw"))


def test_frames_and_masks(spark, tmp_path):
    f = represent.polarity(stream(spark))
    save_frame(f, str(tmp_path / "f.npz"))
    data, kind, names = load_frame(str(tmp_path / "f.npz"))
    assert kind == "polarity" and names == ["positive", "negative"] and data.shape == (2, 40, 60)
    mask = RNG.random((7, 9)) > 0.5
    save_mask(mask, str(tmp_path / "m.png"))
    assert (load_mask(str(tmp_path / "m.png")) == mask).all()
    assert export_png(f, str(tmp_path / "png")).count() == 1 and (tmp_path / "png/frame_00000.png").exists()


def test_udp(spark):
    receiver = UdpReceiver(spark, "127.0.0.1", 0, (60, 40))
    assert UdpSender(*receiver.address, timestamps=True).send(stream(spark)) == 3
    assert sorted(rows(receiver.recv(300))) == sorted(rows(stream(spark)))
    x, y, p, t = codecs.decode_udp(codecs.encode_udp([1], [2], [1])[0])
    assert (x[0], y[0], p[0], t) == (1, 2, True, None)


def test_live_equals_batch(spark, tmp_path):
    s = stream(spark)
    s.df.repartition(3).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(s.df.schema).parquet(str(tmp_path / "in"))
    for name, df in (("counts", live.live_counts(src, s.meta, 50.0)), ("rate", live.live_rate(src, s.meta, 50.0)), ("bursts", live.live_sessions(src, s.meta, 5.0)), ("calm", live.live_refractory(src, 5000))):
        mode = "append" if name == "calm" else "complete"
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    batch = s.df.groupBy(F.expr("t div 50000 * 50000").alias("t0"), F.when(F.col("p"), 0).otherwise(1).alias("c"), "y", "x").count()
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted((r["t0"], r["c"], r["y"], r["x"], r["count"]) for r in batch.collect())
    assert spark.table("rate").agg(F.sum("count")).first()[0] == 400
    assert spark.table("bursts").agg(F.sum("count")).first()[0] == 400
    assert sorted(map(tuple, spark.table("calm").collect())) == sorted(map(tuple, filters.refractory_filter(s, 5000).df.collect()))


def test_pipeline_of_windows_equals_the_whole(spark):
    s = stream(spark)
    whole = set(rows(filters.background_activity_filter(s, 20_000)))
    pipe = live.Pipeline([live.BackgroundProcessor(20_000)])
    out = set()
    for t0 in range(0, 300_000, 100_000):
        w = s.with_(s.df.where((F.col("t") >= t0) & (F.col("t") < t0 + 100_000)))
        out |= set(rows(pipe.process((t0, t0 + 100_000), w)))
    assert out == whole and pipe.lookback == 20_000


def test_bias_settings():
    from retinaspark.streaming import biases

    assert biases.preset("evk4").throttle_range == (0, 235) and biases.preset("davis346", step=3, patience=None).step == 3
    assert biases.preset("evk4", target_rate=(1e5, 1e6)).calibrate == 0 and biases.preset("evk4", target_rate=(1e5, 1e6), calibrate=2).calibrate == 2
    for wrong in ({"target_rate": (2.0, 1.0)}, {"max_slew": 0}, {"follower": (9, 3)}):
        with pytest.raises(ValueError):
            biases.preset("evk4", **wrong)
    with pytest.raises(ValueError):
        biases.preset("other")
    with pytest.raises(TypeError):
        biases.preset("evk4", pace=3)


def test_bias_control(spark):
    rates = spark.createDataFrame([(i, 5e6) for i in range(40)], "t long, rate double")
    states = live.bias_series(rates).orderBy("t").collect()
    assert states[0]["refractory"] == pytest.approx(0.1) and states[10]["refractory"] == pytest.approx(1.0) and states[-1]["threshold"] > 0.5
    assert live.bias_step(live.BiasConfig(), live.BiasState(), 5e5).state == "settled"
    assert SensorMeta(1, 1).span() == 30.0


@pytest.mark.parametrize("evt", [2, 3])
def test_raw_ranges_go_on_from_checkpoints(spark, tmp_path, monkeypatch, evt):
    from retinaspark.sources import files

    rng = np.random.default_rng(evt)
    # times wrap several times over the 24 bits of EVT 3
    t = np.sort(rng.integers(0, 90_000_000, 3000))
    s = from_numpy(spark, np.stack([rng.integers(0, 1200, 3000), rng.integers(0, 700, 3000), t, rng.integers(0, 2, 3000)], 1).astype(float), sensor_size=(1280, 720))
    save(s, str(tmp_path / "a.raw"), evt=evt)
    whole = rows(load(spark, str(tmp_path / "a.raw")))
    monkeypatch.setattr(files, "RANGE", 1000)
    ranged = load(spark, str(tmp_path / "a.raw"))
    assert rows(ranged) == whole == rows(s) and ranged.df.rdd.getNumPartitions() > 5


def test_vectors_go_on_over_ranges():
    words = [8 << 12 | 1, 6 << 12 | 5, 7, 3 << 12 | 1 << 11 | 100, 4 << 12 | 0xFFF, 5 << 12 | 0x81, 4 << 12 | 1, 2 << 12 | 9, 8 << 12 | 4000, 5 << 12 | 3, 8 << 12 | 2, 4 << 12 | 0x800]
    data = np.array(words, "<u2").tobytes()
    whole = [c.tolist() for c in codecs.read_evt3(data)]
    for cut in range(0, len(data) + 1, 2):
        state = codecs.after(codecs.RawState(), codecs.scan_evt3(data[:cut]), 12)
        a, b = codecs.read_evt3(data[:cut]), codecs.read_evt3(data[cut:], state)
        assert [np.concatenate(c).tolist() for c in zip(a[:4], b[:4])] == whole[:4]
        assert np.concatenate([a[4], b[4] + cut // 2 * 12]).tolist() == whole[4]


def test_e2vid_archive(spark, tmp_path):
    import zipfile

    save(stream(spark), str(tmp_path / "a.zip"))
    with zipfile.ZipFile(tmp_path / "a.zip") as z:
        lines = z.read(z.namelist()[0]).decode().splitlines()
    first = rows(stream(spark))[0]
    assert len(lines) == 401 and lines[1] == f"{first[2] / 1e6:.6f} {first[0]} {first[1]} {int(first[3])}"
    from retinaspark.plans.dataset import open_stream

    open_stream(stream(spark), dt_ms=10).flip_x().save(str(tmp_path / "b.zip"))
    with zipfile.ZipFile(tmp_path / "b.zip") as z:
        turned = z.read(z.namelist()[0]).decode().splitlines()
    w = int(turned[0].split()[0])
    assert len(turned) == 401 and int(turned[1].split()[1]) == w - 1 - first[0]


@pytest.mark.parametrize("name", ["a.dat", "a.txt", "a.raw"])
def test_data_source(spark, tmp_path, name):
    from retinaspark.sources.datasource import EventFiles

    spark.dataSource.register(EventFiles)
    save(stream(spark), str(tmp_path / name))
    df = spark.read.format("events").load(str(tmp_path / name))
    assert [tuple(map(int, r)) for r in df.orderBy("seq").select("x", "y", "t", F.col("p").cast("int")).collect()] == rows(stream(spark))
    kind = {"dat": "dat", "txt": "text", "raw": "raw"}[name[2:]]
    stream(spark).df.repartitionByRange(3, "t").sortWithinPartitions("t", "seq").write.format("events").options(width=60, height=40, format=kind).mode("append").save(str(tmp_path / "out"))
    parts = sorted((tmp_path / "out").glob(f"part-*.{name[2:]}"))
    back = [rows(load(spark, str(p), sensor_size=(60, 40))) for p in parts]
    assert len(parts) == 3 and sorted(r for p in back for r in p) == sorted(rows(stream(spark)))


def test_stateful_background_filter(spark, tmp_path):
    ev = np.column_stack([RNG.integers(0, 40, 600), RNG.integers(0, 40, 600), np.sort(RNG.choice(100_000, 600, False)), RNG.integers(0, 2, 600)])
    s = stream(spark, ev, (40, 40))
    want = rows(filters.background_activity_filter(s, 2000))
    for i, (lo, hi) in enumerate(((0, 30_000), (30_000, 70_000), (70_000, 100_000))):
        s.df.where(f"t >= {lo} and t < {hi}").coalesce(1).write.parquet(str(tmp_path / "in" / f"b={i}"))
    live_df = spark.readStream.schema(s.df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "b=*"))
    live.live_background(live_df, SensorMeta(40, 40), 2000, tile=16).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("seq").select("x", "y", "t", F.col("p").cast("int")).collect()
    assert [tuple(map(int, r)) for r in got] == want and 0 < len(want) < 600


def test_hot_pixels_add_up_over_batches(spark, tmp_path):
    s, kept = stream(spark), []
    run = live.hot_pixel_batches(lambda batch, n: kept.append(batch.count()), str(tmp_path), 1.0)
    for _ in range(2):
        kept.clear()
        run(s.df.where("t < 150000"), 0)
        run(s.df.where("t >= 150000"), 1)
    first = s.with_(s.df.where("t < 150000"))
    hot = [(r["x"], r["y"]) for r in filters.hot_pixels(s, 1.0).collect()]
    assert kept == [filters.hot_pixel_filter(first, 1.0).n_events(), sum((x, y) not in hot for x, y, t, _ in rows(s) if t >= 150_000)]


def test_windows_on_a_grid_and_by_number(spark, tmp_path):
    s = stream(spark)
    s.df.coalesce(1).write.parquet(str(tmp_path / "in"))
    first = rows(s)[0][2]
    source = spark.readStream.schema(s.df.schema).parquet(str(tmp_path / "in"))
    for name, made in (("grid", live.live_counts(source, SensorMeta(60, 40), 10.0, origin=first)), ("number", live.live_count_windows(source, SensorMeta(60, 40), 70))):
        made.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination(120)
    assert all((r["t0"] - first) % 10_000 == 0 for r in spark.table("grid").collect())
    sums = {r["window"]: r["n"] for r in spark.table("number").groupBy("window").agg(F.sum("value").alias("n")).collect()}
    assert sums == {k: min(70, 400 - 70 * k) for k in range(6)}


@pytest.mark.parametrize("packing", [0, 1, 3])
def test_aedat4_packets(spark, tmp_path, monkeypatch, packing):
    from retinaspark.sources import aedat4, files

    path, (x, y, t, p) = tmp_path / "a.aedat4", EV.T
    other = aedat4.packet(x[:9], y[:9], t[:9], p[:9], packing)
    parts = [aedat4.packet(x[i: i + 50], y[i: i + 50], t[i: i + 50], p[i: i + 50], packing) for i in range(0, 400, 50)]
    path.write_bytes(aedat4.file_header(60, 40, packing) + b"".join(b"\x07\0\0\0" + other[4:] + q for q in parts))
    monkeypatch.setattr(files, "RANGE", 1500)
    s = load(spark, str(path))
    assert s.sensor_size == (60, 40) and rows(s) == [tuple(map(int, e)) for e in EV] and s.df.rdd.getNumPartitions() > 2
    # numbers of eight bytes stand at places that eight divides
    assert (aedat4.file_header(1, 1).index(struct.pack("<q", -1)) - len(aedat4.MAGIC)) % 8 == 0
    path.write_bytes(b"#!AER-DAT2.0")
    with pytest.raises(ValueError):
        load(spark, str(path))


def test_udp_as_a_stream(spark, tmp_path):
    import socket
    import time

    from retinaspark.sources.udp import UdpEvents

    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as free:
        free.bind(("127.0.0.1", 0))
        port = free.getsockname()[1]
    spark.dataSource.register(UdpEvents)
    q = spark.readStream.format("udp-events").option("port", port).option("wait_ms", 300).load().writeStream.format("memory").queryName("udp").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        sender, until = UdpSender("127.0.0.1", port, timestamps=True), time.monotonic() + 60
        while time.monotonic() < until and spark.table("udp").count() < 400:
            sender.send(stream(spark))
            time.sleep(0.5)
    finally:
        q.stop()
    got = [tuple(map(int, r)) for r in spark.table("udp").orderBy("seq").select("x", "y", "t", F.col("p").cast("int")).limit(400).collect()]
    want = rows(stream(spark))
    # sending may begin while the port isn't open yet, with any datagram
    assert len(got) == 400 and set(got) <= set(want) and [r["seq"] for r in spark.table("udp").orderBy("seq").limit(400).collect()] == list(range(400))


def test_added_formats(spark, tmp_path):
    from retinaspark.sources import files

    def read(spark, path):
        return stream(spark).df, (64, 48)

    files.register_format("mine", ".mine", read)
    try:
        assert rows(load(spark, str(tmp_path / "x.mine"))) == rows(stream(spark))
    finally:
        del files.FORMATS[".mine"], files.READERS["mine"]


def write_gif_bytes(image):
    import io

    from retinaspark.functions.video import write_gif

    out = io.BytesIO()
    write_gif(out, [image], 30)
    return out.getvalue()


def gif_pixels(data, n):
    """The colour numbers of the first image: codes of nine bits between clear codes."""
    at = data.index(b"!\xf9\x04") + 8 + 10 + 1
    body = b""
    while data[at]:
        body += data[at + 1: at + 1 + data[at]]
        at += 1 + data[at]
    bits = np.unpackbits(np.frombuffer(body, np.uint8), bitorder="little")
    codes = (bits[: len(bits) // 9 * 9].reshape(-1, 9) << np.arange(9)).sum(1)
    assert codes[0] == 256 and 257 in codes
    out = codes[: list(codes).index(257)]
    out = out[out != 256]
    assert len(out) == n
    return out


def test_command_line_and_video(spark, tmp_path, capsys):
    from retinaspark.cli import main
    from retinaspark.functions.video import save_video
    from retinaspark.plans.dataset import open_stream

    save(stream(spark), str(tmp_path / "a.raw"))
    assert main(["info", str(tmp_path / "a.raw")], spark) == 0 and "events 400" in capsys.readouterr().out
    assert main(["convert", str(tmp_path / "a.raw"), str(tmp_path / "a.npz")], spark) == 0
    assert rows(load(spark, str(tmp_path / "a.npz"))) == rows(stream(spark))
    assert main(["render", str(tmp_path / "a.raw"), str(tmp_path / "png"), "--dt-ms", "100"], spark) == 0
    assert len(list((tmp_path / "png").iterdir())) == 3
    frames = open_stream(stream(spark), dt_ms=50).with_repr("count").frames()
    assert save_video(frames, str(tmp_path / "v.png")) == 6
    assert (tmp_path / "v.png").read_bytes().count(b"fcTL") == 6
    assert save_video(frames, str(tmp_path / "v.gif")) == 6
    data = (tmp_path / "v.gif").read_bytes()
    assert data[:6] == b"GIF89a" and data[-1:] == b";" and data.count(b"!\xf9\x04") == 6
    image = np.arange(40 * 30 * 3, dtype=np.uint8).reshape(30, 40, 3)
    assert (gif_pixels(write_gif_bytes(image), 40 * 30) < 252).all()


def test_model_needs_a_file():
    from retinaspark.operators.model import Model

    with pytest.raises(Exception):
        Model("/nowhere.onnx").inputs  # noqa: B018


def test_bag_side_tables(spark, tmp_path):
    import struct

    from retinaspark.sources import rosbag as rb

    path = str(tmp_path / "b.bag")
    rb.write_bag(stream(spark), path, per_message=150)
    assert rb.topics(path) == [(rb.TOPIC, "dvs_msgs/EventArray")] and len(rb.index(path)[1]) == 3
    assert rb.read_imu(spark, path).count() == 0 and rb.read_camera_info(path) is None
    # a calibration and an image in one more chunk
    head = lambda t: struct.pack("<I", 0) + rb._stamp(t) + struct.pack("<I", 0)
    info = head(5) + struct.pack("<II", 40, 60) + struct.pack("<I", 0) + struct.pack("<I", 5) + struct.pack("<5d", 1, 2, 3, 4, 5) + struct.pack("<9d", 10, 0, 30, 0, 20, 40, 0, 0, 1)
    image = head(7) + struct.pack("<II", 2, 3) + struct.pack("<I", 5) + b"mono8" + b"\0" + struct.pack("<II", 3, 6) + bytes(range(6))
    messages = b"".join(rb._pack({"conn": struct.pack("<I", c), "time": rb._stamp(9), "op": bytes([rb.MESSAGE])}, m) for c, m in ((0, info), (1, image)))
    chunk = rb._pack({"compression": b"none", "size": struct.pack("<I", len(messages)), "op": bytes([rb.CHUNK])}, messages)
    links = b"".join(rb._pack({"conn": struct.pack("<I", c), "topic": t, "op": bytes([rb.CONNECTION])}, struct.pack("<I", 5 + len(k)) + b"type=" + k) for c, t, k in ((0, b"/info", b"sensor_msgs/CameraInfo"), (1, b"/img", b"sensor_msgs/Image")))
    where = rb._pack({"chunk_pos": struct.pack("<Q", 200), "start_time": rb._stamp(5), "end_time": rb._stamp(7), "op": bytes([rb.CHUNK_INFO])}, b"")
    fields = {"index_pos": struct.pack("<Q", 200 + len(chunk)), "op": bytes([rb.BAG])}
    bag = rb.MAGIC + rb._pack(fields, b" " * (200 - len(rb.MAGIC) - len(rb._pack(fields, b""))))
    (tmp_path / "c.bag").write_bytes(bag + chunk + links + where)
    c = rb.read_camera_info(str(tmp_path / "c.bag"))
    assert (c.fx, c.fy, c.cx, c.cy, c.k3) == (10, 20, 30, 40, 5)
    (t, pixels), = rb.read_frames(str(tmp_path / "c.bag"))
    assert t == 7 and pixels.tolist() == [[0, 1, 2], [3, 4, 5]]
