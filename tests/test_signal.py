"""Queries against DuckDB, and what SQL cannot say against direct evaluation."""

import glob
import os
import struct
import threading

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sigstrata.functions import codes
from sigstrata.operators import catalog, dsp, generate, rollups, wave, windows
from sigstrata.plans import endpoints
from sigstrata.plans.signal_queries import ORACLE_SQL, QUERIES
from sigstrata.sources import cache, container, publish, signals, wav
from sigstrata.streaming.incremental import streaming_extrema

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def events_by_frame() -> np.ndarray:
    value = duckdb.sql(f"select value from '{SF}/events.parquet' order by event_id").fetchnumpy()["value"]
    return (np.floor(value * 100).astype(np.int64) % 65536 - 32768) / 32768.0


def check_spectral(got):
    f, d = dsp.spectral_peaks(events_by_frame(), 44100, 147)
    assert sorted(got.itertuples(index=False, name=None)) == [(0, i, a, b) for i, (a, b) in enumerate(zip(f.tolist(), d.tolist(), strict=True))]


def check_modes(got):
    """Layers of three caches: counts by rule, extents end to end."""
    n = 1000
    for track, mode in (("waveform", 3), ("spectral", 8), ("spectrogram", 10)):
        rows = got[got.track_id == track].sort_values("layer_ord")
        assert len(rows) == mode and rows.payload_offset.iloc[0] == 18 + 8 * mode
        assert (rows.payload_offset.iloc[1:].to_numpy() == (rows.payload_offset + rows.payload_len).iloc[:-1].to_numpy()).all()
        assert rows[rows.kind == "wave"].record_count.tolist() == [wave.bucket_count(n, d, 147) for d in (147, 2205, 44100)]
        if track == "spectrogram":
            assert rows[rows.kind == "spectrogram"].record_count.tolist() == rollups.spectrogram_counts(n, [147, 2205, 44100])
            assert rows[rows.kind == "loudness"].mirrored_division.tolist() == [2205, 44100]


#: What holds the queries that SQL cannot express.
DIRECT = {"spectral_fine": check_spectral, "cache_modes": check_modes}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in ORACLE_SQL:
        DIRECT[name](got)
        return
    want = duck.execute(ORACLE_SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    key = lambda d: sorted(map(repr, d[cols].itertuples(index=False, name=None)))
    assert [str(t) for t in got[cols].dtypes] == [str(t) for t in want[cols].dtypes]
    assert key(got) == key(want)


def test_powers_of_two_at_the_end_of_its_list(spark, tmp_path):
    ids = [None, -741456, -741455, -5, 0, 1, 2, 3, 741455, 741456, 5999999, 3037000499]
    spark.createDataFrame([(i,) for i in ids], "event_id long").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    got = [tuple(r) for r in QUERIES["powers_of_two"](spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, con.execute(ORACLE_SQL["powers_of_two"]).fetchall()))
    assert dict(got)[741455] == 1 << 39 and dict(got)[741456] is None


@pytest.mark.parametrize("frames", [147 * 15 * k + o for k in (1, 2) for o in (-1, 0, 1, 146, 147)])
def test_levels_at_ends(spark, frames):
    x = np.random.default_rng(frames).integers(-32768, 32767, frames)
    s = spark.createDataFrame([(0, i, int(v)) for i, v in enumerate(x)], "channel int, frame long, v int").withColumn("v", F.col("v").cast("short"))
    from sigstrata.functions.codes import peak16

    got = {(r.division, r.peak): (r.max_code, r.min_code) for r in wave.levels(s, [147, 2205], frames, lambda p: wave.coded(p, peak16)).collect()}
    q = np.where(x < 0, x, (x * 32767 + 16384) // 32768)
    want = {}
    for d in (147, 2205):
        for k in range(wave.bucket_count(frames, d, 147)):
            part = q[k * d : (k + 1) * d]
            want[d, k] = int(part.max()), int(part.min())
    assert got == want


def test_nan_samples_do_not_count(spark):
    s = spark.createDataFrame([(0, 0, float("nan")), (0, 1, -0.25), (0, 2, None), (0, 4, float("nan")), (0, 8, 0.5)], "channel int, frame long, v float")
    got = sorted((r.peak, r.hi, r.lo) for r in wave.extrema(s, 4).collect())
    assert got == [(0, -0.25, -0.25), (1, None, None), (2, 0.5, 0.5)]  # a bucket of NaN stays in its place
    coded = {r.peak: (r.max_code, r.min_code) for r in wave.levels(s, [4], 9, wave.float_code(codes.unit_code)).collect()}
    assert coded == {0: (-8192, -8192), 1: (-32768, 32767), 2: (16384, 16384)}
    assert {tuple(r) for r in streaming_extrema(s, 4).collect()} == {tuple(r) for r in wave.extrema(s, 4).collect()}


def test_derived_records_without_peaks_are_zeros(spark):
    fine = spark.createDataFrame([(0, 0, 5, -5), (0, 9, 7, -7)], "channel int, peak long, max_code short, min_code short")
    got = [(r.peak, r.max_code, r.min_code) for r in wave.read_range(fine, 4, 0, 4, fill=True).orderBy("peak").collect()]
    assert got == [(0, 5, -5), (1, 0, 0), (2, 7, -7), (3, 0, 0)]


def test_spectrogram_in_stretches(spark):
    n, d = 3000, 160
    x = np.sin(np.arange(n) * 0.3).astype(np.float32)
    s = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(x)], "channel int, frame long, v float")
    got = {(r.record, r.bin): r.code for r in dsp.spectrogram_base(s, d).collect()}
    shift = rollups.spectrogram_shift(d)
    count = 1 + (n - shift - 256) // d
    want = dsp.spectrogram_frames(x, 0, np.arange(count) * d + shift)
    assert got == {(r, b): int(want[r, b]) for r in range(count) for b in range(128)}


def test_filter_is_its_transfer_function():
    b, a = dsp.k_weighting(48000)
    x = np.zeros(4096)
    x[0] = 1.0
    h = dsp.k_filter(x, 48000)
    w = np.fft.rfft(h)[200]
    z = np.exp(-2j * np.pi * 200 / 4096 * np.arange(5))
    assert abs(w - (b @ z) / (a @ z)) < 1e-3


def test_tone_is_found():
    rate = 44100
    x = 0.8 * np.sin(2 * np.pi * 1234.5 * np.arange(rate) / rate)
    f, d = dsp.spectral_peaks(x, rate, 147)
    assert abs(np.median(f[20:]) - 1234.5) < 2 and d[50] > 16000


def test_cache_round_trip(spark):
    layers = [("wave", 160, np.arange(8).reshape(4, 2)), ("wave", 2400, np.array([[7, 0]])), ("spectral", 160, np.array([[1000, 5]] * 3)), ("spectrogram", 2400, np.arange(128)[None] * 31 % 4096), ("loudness", 2400, np.array([[0.5, 0.25]]))]
    data = cache.encode("unit", 1, 48000, (7, 9), layers)
    files = spark.createDataFrame([("t", bytearray(data))], "track_id string, content binary")
    rows = cache.layer_index(files).orderBy("layer_ord").collect()
    assert [(r.kind, r.record_count) for r in rows] == [("wave", 4), ("wave", 1), ("spectral", 3), ("spectrogram", 1), ("loudness", 1)]
    assert rows[-1].payload_offset + rows[-1].payload_len == len(data)
    at = rows[3].payload_offset
    assert (cache.unpack12(data[at : at + 192]) == layers[3][2]).all()
    part = cache.raw_range(files, "wave", 1, 2).orderBy("layer_ord").collect()[0].bytes
    assert bytes(part) == layers[0][2][1:3].astype("<i2").tobytes()
    with pytest.raises(ValueError):
        cache.encode("legacy", 1, 48000, (0, 0), [])


def test_container_round_trip():
    e = [(b"n" * 16, b"kind", 1, 0, b"abc"), (b"m" * 16, b"kin2", 2, 3, b"")]
    data = container.encode(e)
    assert container.parse(data + b"tail") == e
    for bad in (data[:-1], data[:40], b"XXXX" + data[4:]):
        with pytest.raises(ValueError):
            container.parse(bad)


def test_wave_file(spark):
    x = np.arange(-6, 6, dtype="<i2")
    fmt = struct.pack("<HHIIHH", 1, 2, 8000, 32000, 4, 16)
    chunk = lambda name, data: name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    body = b"WAVE" + chunk(b"LIST", b"odd") + chunk(b"fmt ", fmt) + chunk(b"data", x[:4].tobytes()) + chunk(b"data", x[4:].tobytes())
    whole = b"RIFF" + struct.pack("<I", len(body)) + body
    files = spark.createDataFrame([("a.wav", bytearray(whole))], "path string, content binary")
    rows = wav.wave_blocks(files, block=4).orderBy("start_frame", "channel").collect()
    assert [len(r.samples) for r in rows] == [4, 4, 2, 2] and rows[0].samples[0] == -6 / 32768
    part = wav.wave_blocks(files, 1, 3).orderBy("channel").collect()  # frames 1 to 3 lie in both data chunks
    assert [r.start_frame for r in part] == [1, 1] and [round(v * 32768) for v in part[0].samples] == [-4, -2, 0]
    assert tuple(wav.wave_headers(files).first()) == ("a.wav", 8000, 2, "pcm16", 6)
    wide = chunk(b"fmt ", struct.pack("<HHIIHHHHI", 0xFFFE, 1, 8000, 24000, 3, 24, 22, 24, 0) + struct.pack("<H", 1) + bytes(14)) + chunk(b"data", b"\xff\xff\xff\0\0\x40")
    assert wav.frames_of(b"RIFF" + struct.pack("<I", 4 + len(wide)) + b"WAVE" + wide)[2].ravel().tolist() == [-1 / 2**23, 0.5]
    for bad in (whole[:-1], whole[:30], b"RIFX" + whole[4:], whole.replace(b"fmt ", b"fmx "), whole.replace(b"data", b"datx"), whole.replace(struct.pack("<HHI", 1, 2, 8000), struct.pack("<HHI", 7, 2, 8000))):
        with pytest.raises(ValueError):
            wav.parse(bad)


def test_open_samples_and_byte_kinds(spark, tmp_path):
    x = np.linspace(-1, 1, 200, dtype=np.float32).reshape(-1, 2)
    (tmp_path / "x.wav").write_bytes(wav.wave_bytes(x, 8000))
    blocks = wav.open_samples(spark, str(tmp_path / "x.wav"))
    assert wav.frames_of(wav.wave_bytes(x, 8000))[2].tolist() == x.tolist() and blocks.count() == 2
    blocks.write.parquet(str(tmp_path / "blocks"))
    assert wav.open_samples(spark, str(tmp_path / "blocks")).count() == 2
    with pytest.raises(ValueError):
        wav.open_samples(spark, "x", "tape")
    for kind, data, want in (("pcm24", b"\x00\x00\x80\xff\xff\x7f", [-1.0, 8388607 / 8388608]), ("f32", struct.pack("<2f", 0.5, -2), [0.5, -2.0])):
        files = spark.createDataFrame([("t", bytearray(data))], "track_id string, content binary")
        assert [r.v for r in signals.samples_of(signals.byte_blocks(files, kind, 1)).orderBy("frame").collect()] == want
    with pytest.raises(ValueError):
        signals.decoded(b"abc", "pcm16")
    with pytest.raises(Exception, match="24 bits"):
        spark.range(1).select(signals.pcm24_whole(F.lit(1 << 23))).collect()


def test_stream_equals_batch(spark, tmp_path):
    s = spark.createDataFrame([(0, i, (i * 37 % 101) / 100) for i in range(1000)], "channel int, frame long, v double")
    s.repartition(5).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(s.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streaming_extrema(live, 64).writeStream.outputMode("complete").format("memory").queryName("live").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("live").collect()} == {tuple(r) for r in streaming_extrema(s, 64).collect()}


def test_container_edits_in_a_file():
    data = cache.encode("unit", 1, 48000, (7, 9), [("wave", 160, np.arange(4).reshape(2, 2))])
    assert container.standard_end(data) == len(data) and container.strip(data) == data
    key = (b"n" * 16, b"kind")
    one = container.edit(data, "append", *key, payload=b"a")
    two = container.edit(container.edit(one, "append", b"m" * 16, b"kind", payload=b"b"), "append", *key, payload=b"c")
    assert [e[4] for e in container.split(two)[1]] == [b"a", b"b", b"c"]
    assert [e[4] for e in container.split(container.edit(two, "set", *key, payload=b"new") + b"")[1]] == [b"new", b"b"]
    assert container.edit(one, "remove", *key) == data
    assert container.split(one + b"suffix")[2] == b"suffix" and container.strip(one + b"suffix") == data + b"suffix"
    with pytest.raises(ValueError):
        container.split(data + b"foreign tail that is no container")
    with pytest.raises(ValueError):
        container.attach(data, [], (1, 2))


@pytest.mark.parametrize("rate", [22050, 44100, 48000, 96000])
def test_pieces_give_the_whole(rate):
    rng = np.random.default_rng(rate)
    x = rng.normal(size=rate // 4) * 0.2
    whole = dsp.spectral_peaks(x, rate, 160)
    a, meter = dsp.SpectralAnalyzer(rate, 160), dsp.LoudnessMeter(rate)
    cuts = np.sort(rng.integers(0, len(x), 9))
    got = [a.push(p) for p in np.split(x, cuts)]
    assert (np.concatenate([g[0] for g in got]) == whole[0]).all() and (np.concatenate([g[1] for g in got]) == whole[1]).all()
    assert np.allclose(np.concatenate([meter.push(p) for p in np.split(x, cuts)]), dsp.LoudnessMeter(rate).push(x))


def test_stateful_stream_equals_batch(spark, tmp_path):
    x = np.sin(np.arange(9000) * 0.2)
    for k in range(3):
        part = spark.createDataFrame([(0, i, float(x[i])) for i in range(k * 3000, k * 3000 + 3000)], "channel int, frame long, v double")
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    from sigstrata.streaming.incremental import streaming_spectral

    live = spark.readStream.schema("channel int, frame long, v double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streaming_spectral(live, 44100, 147).writeStream.outputMode("append").format("memory").queryName("peaks").start()
    q.processAllAvailable()
    q.stop()
    f, d = dsp.spectral_peaks(x, 44100, 147)
    got = sorted((r.record, r.frequency_hz, r.density) for r in spark.table("peaks").collect())
    assert got == [(i, int(a), int(b)) for i, (a, b) in enumerate(zip(f, d, strict=True))]


@pytest.mark.parametrize("wide", [False, True])
def test_whole_cache_round_trip(spark, wide):
    """Stereo floats in the mode with all kinds: what is written is read back, and layers follow their rules."""
    rate, divisions, frames = 44100, [147, 2205, 4410], 30001
    x = 1.2 * np.random.default_rng(5).standard_normal((frames, 2)).astype(np.float32)
    s = spark.createDataFrame([(c, i, float(x[i, c])) for c in (0, 1) for i in range(frames)], "channel int, frame long, v float")
    made = generate.cache_records(s, rate, divisions, "spectrogram", 2, wide=wide)
    want = {(r.layer_ord, r.record, r.channel): r["values"] for r in made.collect()}
    files = generate.build_cache(s, "t", rate, divisions, "spectrogram", 2, wide=wide, stamp=(3, 4)).persist()
    got = {(r.layer_ord, r.record, r.channel): r["values"] for r in cache.read_records(files, slab=7).collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():  # sums of the two runs may differ in the last digit of loudness
        assert got[k] == (pytest.approx(v, rel=1e-6) if k[0] >= 8 else v)
    assert {r[0] for r in cache.read_records(files, ("loudness",)).select("kind").distinct().collect()} == {"loudness"}
    h = files.select(*[c.alias(k) for k, c in cache.header(F.col("content")).items()]).first()
    assert (h.version, h.channels, h.layers, h.sample_rate, h.mtime_low32, h.size_low32) == ("wide" if wide else "unit", 2, 10, rate, 3, 4)
    index = {r.layer_ord: (r.kind, r.mirrored_division, r.record_count) for r in cache.layer_index(files).collect()}
    counts = rollups.spectrogram_counts(frames, divisions)
    assert [index[i] for i in range(3)] == [("wave", d, wave.bucket_count(frames, d, divisions[0])) for d in divisions]
    assert [index[i] for i in (6, 7)] == [("spectrogram", d, n) for d, n in zip(divisions[1:], counts, strict=True)]
    base = -(-frames // divisions[1])
    assert [index[i] for i in (8, 9)] == [("loudness", divisions[1], base), ("loudness", divisions[2], base // 2)]
    fine = index[3][2]
    assert [index[i] for i in (3, 4, 5)] == [("spectral", d, fine // (d // 147)) for d in divisions]
    # the coarse spectrogram against direct means of direct windows
    for c in (0, 1):
        n = 1 + (frames - rollups.spectrogram_shift(147) - 256) // 147
        b = dsp.spectrogram_frames(x[:, c], 0, np.arange(n) * 147 + rollups.spectrogram_shift(147)).astype(np.int64)
        first = np.array([b[i : i + 15].sum(axis=0) // len(b[i : i + 15]) for i in range(0, n, 15)])
        assert all(got[6, i, c] == first[i].tolist() for i in range(len(first)))
        second = [(first[i] + first[i + 1]) // 2 for i in range(0, len(first) - 1, 2)]
        assert all(got[7, i, c] == v.tolist() for i, v in enumerate(second))


def test_cache_of_nothing_and_bad_options(spark):
    none = spark.createDataFrame([], "channel int, frame long, v float")
    assert generate.cache_records(none, 48000, [160, 2400]).collect() == []
    for bad in ({"mode": "x"}, {"channels": 0}, {"divisions": []}, {"divisions": [160, 250], "mode": "spectral"}, {"divisions": [160], "mode": "spectral"}):
        with pytest.raises(ValueError):
            generate.check_options(**({"channels": 1, "rate": 48000, "divisions": [160, 2400], "mode": "waveform"} | bad))


def fnv(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 % 2**64
    return h


def sixteen(x: np.ndarray) -> np.ndarray:
    return np.round(x * 32767).astype(np.int16)


def pulses(frames: int, at: list[int], size: int) -> np.ndarray:
    x = np.zeros(frames, np.int16)
    x[at] = size
    return x


T44 = np.arange(44100) / 44100
RATIO = 10 ** (-6 / 20)
#: Digests of known payloads of three signals at 44,100 Hz, by level.
KNOWN = {
    "tone": (sixteen(0.8 * np.sin(2 * np.pi * 1234.5 * np.arange(44100) / 44100)), ((300, 0x5119DFD59F72B548), (20, 0xD22366BE92E2F37D), (1, 0x4CF08A60373E8133)), ((293, 0x3DE3E6350707906A), (19, 0x3F3ADBDECD66096))),
    "two tones": (sixteen(0.8 / (1 + RATIO) * (np.sin(2 * np.pi * 1000 * T44) + RATIO * np.sin(2 * np.pi * 3000 * T44))), ((300, 0xE7D1CCF79F446DBD), (20, 0xB6688185686F0D8D), (1, 0xA021FD1F5E2410D7)), ((293, 0x87CE6729D33B41B0), (19, 0x7589B1B5664159E8))),
    "impulse": (pulses(5000, [1024], 29490), ((35, 0xA582AA2EF0D5E525), (3, 0x4BFD3C8DF6608225), (1, 0xFD56AAEFCD751F85)), ((27, 0xAED090D336C6B60A), (1, 0x76B8FD90707804CA))),
}


def as_samples(spark, x: np.ndarray):
    """Samples of (frames, channels) or of one channel."""
    x = x.reshape(len(x), -1)
    frame, channel = np.divmod(np.arange(x.size), x.shape[1])
    kind = "smallint" if x.dtype == np.int16 else "float"
    return spark.createDataFrame(pd.DataFrame({"channel": channel, "frame": frame, "v": x.ravel()})).selectExpr("cast(channel as int) as channel", "frame", f"cast(v as {kind}) as v")


@pytest.mark.parametrize("name", list(KNOWN))
def test_known_payloads(spark, name):
    x, waves, spectra = KNOWN[name]
    files = generate.build_cache(as_samples(spark, x), name, 44100, [147, 2205, 44100], "spectral").persist()
    content, layers = bytes(files.first().content), cache.layer_index(files).orderBy("layer_ord").collect()
    got = {(r.kind, r.division if r.kind == "wave" else r.mirrored_division): (r.record_count, fnv(content[r.payload_offset : r.payload_offset + r.payload_len])) for r in layers}
    assert [got["wave", d] for d in (147, 2205, 44100)] == list(waves)
    assert [got["spectral", d] for d in (147, 2205)] == list(spectra)


def loud(kind: str) -> np.ndarray:
    n = 48000 * 3
    if kind == "sine":
        phase = 2 * np.pi * 997.0 * np.arange(n) / 48000
        return np.stack([np.round(0.5 * 32767.0 * np.sin(phase)), np.round(0.25 * 32767.0 * np.sin(phase))], axis=1).astype(np.int16)
    if kind == "step":
        return np.repeat(np.repeat(np.array([0, 8192, 16384], np.int16), 48000)[:, None], 2, axis=1)
    return np.repeat(pulses(n, [0, 1200, 38400, 96000], 32767)[:, None], 2, axis=1)


@pytest.mark.parametrize(
    ("kind", "base", "coarse"),
    [("sine", 0x0DB32799C4F9F411, 0xBD0FE30E9F89CEF0), ("step", 0xC4A98514C21005F9, 0xBC650B74ACFEBB49), ("impulse", 0x34A7949B1E62C755, 0x2B543CF0B767C4E9)],
)
def test_known_loudness(spark, kind, base, coarse):
    """Digests of known payloads: the last digit of each sum counts."""
    s, known = as_samples(spark, loud(kind)), signals.extent(spark, 48000 * 3, 2)
    for layer, want in zip(generate.loudness_layers(s, known, [160, 2400, 48000], 48000), (base, coarse), strict=True):
        rows = sorted((r.record, r.channel, r["values"]) for r in layer.collect())
        assert fnv(np.array([v for _, _, v in rows], "<f4").tobytes()) == want


@pytest.mark.parametrize(("rate", "spans"), [(11025, (4410, 33075)), (22051, (8820, 66153)), (76799, (30719, 230397)), (76800, (30720, 230400)), (76801, (30720, 230403))])
def test_loudness_spans_of_odd_rates(rate, spans):
    assert dsp.LoudnessMeter(rate).spans == spans


def test_extremes_of_wide_codes(spark):
    x = np.repeat(np.array([1, 2, 64, 255, 256, 512, -1, -2, -64, -255, -256, -512], np.float32), 147)
    got = wave.levels(as_samples(spark, x), [147], len(x), wave.float_code(codes.wide_code)).orderBy("peak").collect()
    up = [24576, 25600, 30720, 32762, 32767, 32767]
    down = [-24576, -25600, -30720, -32762, -32768, -32768]
    assert [(r.max_code, r.min_code) for r in got] == [(u, 24576) for u in up] + [(-24576, d) for d in down]


def test_many_tracks_are_as_each_alone(spark):
    rng, parts, rate, divisions = np.random.default_rng(8), {}, 44100, [147, 2205, 4410]
    for track, (frames, channels) in {"a": (9001, 2), "b": (30000, 1), "c": (700, 1), "d": (147, 2)}.items():
        parts[track] = as_samples(spark, (rng.standard_normal((frames, channels)) * 0.3).astype(np.float32))
    every = None
    for track, s in parts.items():
        t = s.select(F.lit(track).alias("track_id"), "*")
        every = t if every is None else every.unionByName(t)
    stamps = spark.createDataFrame([("a", 5, 6)], "track_id string, mtime_low32 long, size_low32 long")
    made = {r.track_id: bytes(r.content) for r in generate.build_caches(every.repartition(5), rate, divisions, "spectrogram", stamps=stamps).collect()}
    for track, s in parts.items():
        channels = s.select("channel").distinct().count()
        alone = generate.build_cache(s, track, rate, divisions, "spectrogram", channels, stamp=(5, 6) if track == "a" else (0, 0))
        assert bytes(alone.first().content) == made[track]


def test_wave_files_to_caches(spark):
    rng = np.random.default_rng(9)
    rows = [(f"{rate}.wav", bytearray(wav.wave_bytes((rng.standard_normal((n, 1)) * 0.2).astype(np.float32), rate))) for rate, n in ((44100, 5000), (8000, 900), (44101, 3000))]
    files = spark.createDataFrame(rows, "path string, content binary")
    made = generate.build_caches_of_waves(files, lambda rate: [rate // 100, rate // 100 * 10], "spectral").persist()
    heads = {r.track_id: (r.sample_rate, r.error) for r in cache.inspected(made).collect()}
    assert heads == {"44100.wav": (44100, None), "8000.wav": (8000, None), "44101.wav": (44101, None)}
    assert endpoints.meta(made).count() == 3 * 5 and endpoints.peaks(made, 441).select("track_id").distinct().count() == 2
    assert endpoints.wave_tile(made, 441, 0).count() == 2 and endpoints.records(made, "loudness", 0, 2).count() == 3
    assert endpoints.spectral_tile(made, 500, [441, 4410], 0).count() == 2 and endpoints.overview(made, 441, 0, 3000, 20, 40, 1).count() > 20


@pytest.mark.parametrize(("rate", "division"), [(44100, 147), (48000, 160), (96000, 64), (30000, 5000)])
def test_scheduler_counts(rate, division):
    a = dsp.SpectralAnalyzer(rate, division)
    phase, n, want = a.phase, 0, []
    for i in range(1, 9001):  # as written: one frame at a time
        phase, n = phase + 1.0, n + 1
        while phase >= a.hop:
            want.append((i, n))
            phase, n = phase - a.hop, 0
    assert a.stops(9000) == want and dsp.analysis_count(9000, rate, division) == len(want) and dsp.analysis_count(0, rate, division) == 0


def test_refused_files(spark):
    bad = spark.createDataFrame([("x", bytearray(b"RPKN\1"))], "track_id string, content binary")
    with pytest.raises(Exception, match="truncated header"):
        cache.layer_index(bad).collect()
    assert cache.layer_index(bad, strict=False).collect() == [] and cache.read_records(bad, strict=False).collect() == []
    old = spark.createDataFrame([("x", bytearray(b"RPKM\1\1" + struct.pack("<III", 8000, 0, 0) + struct.pack("<iI", 160, 3) + b"abcdef"))], "track_id string, content binary")
    row = cache.layer_index(old).first()
    assert (row.kind, row.record_count, row.payload_len) == ("wave", 3, 6) and cache.read_records(old).collect() == []
    opaque = struct.pack("<III", 8000, 0, 0) + struct.pack("<iIiI", 160, 1, -108, 1)
    last = spark.createDataFrame([("x", bytearray(b"RPKN\1\2" + opaque + b"1234" + b"opaque"))], "track_id string, content binary")
    assert cache.inspected(last).first().standard_end == 18 + 16 + 10 and [r.kind for r in cache.read_records(last).collect()] == ["wave"]
    files = spark.createDataFrame([("y", bytearray(cache.encode("unit", 1, 8000, (0, 0), [("wave", 160, np.zeros((2, 2)))])))], "track_id string, content binary")
    assert cache.has_shape(files, [160]).first().matches and not cache.has_shape(files, [160, -115]).first().matches


def test_read_cache_files(spark, tmp_path):
    (tmp_path / "a.peaks").write_bytes(cache.encode("unit", 1, 8000, (0, 0), [("wave", 160, np.arange(4).reshape(2, 2))]))
    rows = cache.read_records(cache.read_cache(spark, str(tmp_path / "*.peaks"))).collect()
    assert [r["values"] for r in rows] == [[0.0, 1.0], [2.0, 3.0]] and rows[0].track_id.endswith("a.peaks")


def test_edits_keep_payloads_and_refuse_unsound_tails(spark, tmp_path):
    data = cache.encode("unit", 1, 48000, (7, 9), [("wave", 160, np.arange(4).reshape(2, 2))])
    key = (b"n" * 16, b"kind")
    one = container.edit(data, "append", *key, version=3, flags=4, payload=b"abc")
    schema = "track_id string, content binary"
    files = spark.createDataFrame([("a", bytearray(one)), ("b", bytearray(data)), ("c", bytearray(data + b"foreign")), ("d", bytearray(one[:-1]))], schema)
    assert {r.track_id: r.error for r in container.scanned(files).collect()} == {"a": None, "b": None, "c": "foreign tail", "d": "truncated container"}
    assert [(r.version, r.flags, r.payload_len) for r in container.index(files).collect()] == [(3, 4, 3)]
    edits = spark.createDataFrame([("a", 0, "append", bytearray(key[0]), bytearray(b"kin2"), 1, 2, bytearray(b"new")), ("a", 1, "remove", bytearray(key[0]), bytearray(key[1]), 0, 0, None)], "track_id string, ord int, action string, namespace binary, kind binary, version int, flags int, payload binary")
    done = {r.track_id: r for r in container.edited(files.where("track_id in ('a', 'b')"), edits).collect()}
    assert container.split(bytes(done["a"].content))[1] == [(key[0], b"kin2", 1, 2, b"new")] and done["a"].changed
    assert not done["b"].changed and bytes(done["b"].content) == data
    entries = spark.createDataFrame([("f", 0, "n", "k", 5, 6, bytearray(b"x"), 1)], "file_id string, ord long, namespace string, kind string, version int, flags int, payload binary, payload_len long")
    new = spark.createDataFrame([("f", "n", "k2", 7, bytearray(b"yy"), 2)], "file_id string, namespace string, kind string, version int, payload binary, payload_len long")
    rows = {r.kind: r for r in container.set_entries(entries, new).collect()}
    assert (rows["k"].version, rows["k"].flags, bytes(rows["k"].payload)) == (5, 6, b"x") and (rows["k2"].version, rows["k2"].flags, bytes(rows["k2"].payload), rows["k2"].ord) == (7, None, b"yy", 1)
    assert container.entry(container.append_entries(entries, new), "n", "k").count() == 1


def test_files_are_put_in_place_whole(spark, tmp_path):
    data = cache.encode("unit", 1, 48000, (7, 9), [("wave", 160, np.arange(4).reshape(2, 2))])
    files = spark.createDataFrame([("a", bytearray(data)), ("b", bytearray(data))], "track_id string, content binary")
    put = publish.published(files, str(tmp_path)).collect()
    assert all(open(r.path, "rb").read() == data for r in put) and len({r.path for r in put}) == 2
    with pytest.raises(ValueError):
        publish.put(put[0].path, b"not a cache", container.standard_end)
    path, key = put[0].path, (b"n" * 16, b"kind")
    assert publish.update_file(path, "append", *key, payload=b"abc") == (True, 34, 34 + 32 + 48 + 3, 34, 3, 80)
    assert publish.update_file(path, "remove", b"m" * 16, b"none")[0] is False
    edits = spark.createDataFrame([(path, 1, "append", bytearray(key[0]), bytearray(b"more"), 1, 0, bytearray(b"x")), (path, 2, "remove", bytearray(key[0]), bytearray(key[1]), 1, 0, None)], "path string, ord int, action string, namespace binary, kind binary, version int, flags int, payload binary")
    assert sorted(r.changed for r in publish.updated(edits).collect()) == [True, True]
    assert [e[1] for e in container.split(open(path, "rb").read())[1]] == [b"more"]
    assert [f for f in os.listdir(tmp_path) if f.endswith(".tmp")] == []


def test_places_of_caches(spark):
    media = spark.createDataFrame([("/a/x.wav",), ("/a/y.wav",)], "path string")
    mapping = spark.createDataFrame([("/a//x.wav", "/m/x", "", 0), ("\\a\\x.wav", "/m/x2", "", 1)], "media string, read string, write string, ord int")
    assert {r.path: r.cache for r in catalog.mapped(media, mapping, for_write=True).collect()} == {"/a/x.wav": "/m/x2", "/a/y.wav": None}
    tried = catalog.candidates(media, mapping, "/c")
    assert [r.place for r in tried.where("path = '/a/x.wav'").orderBy("prio").collect()] == ["mapped", *["sidecar"] * 2, *["subdir"] * 2, *["central"] * 2]
    twice = tried.unionByName(tried.withColumn("prio", F.col("prio") + 10))
    assert catalog.deduplicated(twice).count() == tried.count()
    listing = spark.createDataFrame([("/a/peaks/x.wav.peaks",), ("/a/y.wav.Peaks",), ("/m/x2",)], "file string")
    assert {r.path: (r.place, r.cache) for r in catalog.resolved(tried, listing).collect()} == {"/a/x.wav": ("mapped", "/m/x2"), "/a/y.wav": ("sidecar", "/a/y.wav.Peaks")}
    for bad in ({"mode": "other"}, {"mode": "central"}, {"mode": "mapped"}):
        with pytest.raises(ValueError):
            catalog.candidates(media, **bad)


def test_pages_on_the_driver():
    store, reads = windows.PageStore(10, 3), []
    read = lambda key, n: store.get(key, lambda: (reads.append(key), b"x" * n)[1])[1]
    assert [read("a", 4), read("b", 4), read("a", 4), read("c", 4), read("b", 4)] == ["read", "read", "hit", "read", "read"]
    assert store.bytes <= 10 and reads == ["a", "b", "c", "b"]
    gate, got = threading.Event(), []
    first = threading.Thread(target=lambda: got.append(store.get("slow", lambda: gate.wait(5) and b"s")))
    first.start()
    while "slow" not in store.reading:
        pass
    second = threading.Thread(target=lambda: got.append(store.get("slow", lambda: b"other")))
    second.start()
    while not store.waiting:
        pass
    gate.set()
    first.join()
    second.join()
    assert sorted(got) == [(b"s", "joined"), (b"s", "read")] and not store.reading
    with pytest.raises(KeyError):
        store.get("bad", lambda: {}["missing"])
    assert not store.reading


def test_windows_of_samples(spark):
    s = as_samples(spark, np.arange(1000, dtype=np.float32))
    for bad in ((0, 0, 1), (5, 10, 4), (1000, 4, 1)):
        with pytest.raises(ValueError):
            windows.display_window(s, *bad, 1, 1000)
    with pytest.raises(Exception, match="exceeds the bytes"):
        windows.display_window(s, 0, 100, 1, 1, 1000, max_bytes=64)[1].collect()
    records, event = windows.display_window(s, 992, 100, 4, 1, 1000)
    assert [(r.record, r.hi) for r in records.orderBy("record").collect()] == [(0, 995.0), (1, 999.0)] and event.first().records == 2
