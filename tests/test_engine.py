"""Operators of the recording engine against hand-made cases and plain versions."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklode import cli
from tracklode.functions import formats, layouts, media, text
from tracklode.model import StreamId
from tracklode.operators import compare, decimate, digest, filters, merge, stats, temporal
from tracklode.operators.filters import Bound, Selection, Stream
from tracklode.sources import recording

SCHEMA = "file_id int, type_id int, instance_id int, record_type string, ts_us long, file_offset long, payload string"


def records(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def sim(spark):
    """A recording of 5 Hz, 15 Hz and 1 kHz streams with one frame dropped."""
    rows = []
    for t in (214, 1201, 1202):
        rows += [(0, t, 1, "configuration", 0), (0, t, 1, "state", 0)]
    rows += [(0, 214, 1, "data", 100_000 + 200_000 * k) for k in range(75) if k != 35]
    rows += [(0, 1201, 1, "data", round(k * 1e6 / 15)) for k in range(226)]
    rows += [(0, 1202, 1, "data", 1000 * k) for k in range(1, 15_072)]
    return records(spark, [(*r, i, f"p{i}") for i, r in enumerate(rows)]).cache()


def n(df, **where):
    for k, v in where.items():
        df = df.where(F.col(k) == v)
    return df.count()


def test_golden_counts(sim):
    assert n(sim) == 15_377
    out = filters.select_records(sim, Selection(streams=[("+", "1201")], after=Bound.parse("+2.2"), before=Bound.parse("14")))
    assert n(out) == 179
    out = decimate.interval_decimate(filters.select_records(sim, Selection(after=Bound.parse("+1"), before=Bound.parse("+2"))), {1202: 10_000})
    assert (n(out), n(out, type_id=1202, record_type="data"), n(out, type_id=1201, record_type="data")) == (126, 100, 15)
    out = filters.select_records(sim, Selection(streams=[("+", "214-1"), ("+", "1201-1")], after=Bound.parse("+5"), before=Bound.parse("-9.5")))
    assert (n(out), n(out, type_id=214, record_type="data"), n(out, type_id=1201, record_type="data")) == (14, 3, 7)
    assert n(filters.select_records(sim, Selection(before=Bound.parse("+0.1")))) == 109


def test_golden_rates(sim):
    assert {r["type_id"]: round(r["fps"]) for r in stats.fps_estimate(sim).collect()} == {214: 5, 1201: 15, 1202: 1000}


def test_golden_merge(sim):
    other = sim.where("type_id = 1201").withColumn("ts_us", F.when(F.col("record_type") == "data", F.col("ts_us") + 1000).otherwise(F.col("ts_us"))).withColumn("file_id", F.lit(1))
    both = sim.unionByName(other)
    unique = merge.with_unique_ids(both)
    assert n(unique) == 15_605 and unique.select("type_id", "unique_instance").distinct().count() == 4
    fused = merge.fused(both)
    assert fused.select("type_id", "fused_instance").distinct().count() == 3 and n(fused) == 15_605
    # Context records of equal time meet in the fused stream; one of each stays.
    assert n(merge.merged(both)) == 15_603


def test_stream_fold():
    streams = [Stream(StreamId(100, i), f"f{i}") for i in range(1, 7)] + [Stream(StreamId(101, i)) for i in range(1, 21)]
    fold = lambda *f: len(filters.fold_streams([(s[0], s[1:]) for s in f], streams))
    assert [fold("-100-f1"), fold("-100-f1", "-100-4"), fold("+100"), fold("+100-1", "+100-3", "+100-5", "+101-10"), fold("+100", "-100"), fold("+200"), fold()] == [25, 24, 6, 4, 0, 0, 26]
    assert filters.fold_streams([("+", "100+2")], streams) == {StreamId(100, 2)}
    assert filters.fold_types([("-", "d")]) == {"configuration", "state"} and filters.named_type("") == "configuration"
    assert filters.split_signed("+a,~b,c") == [("+", "a"), ("-", "b"), ("+", "c")]


def test_bounds_are_open_and_closed(spark):
    r = records(spark, [(0, 1, 1, "data", t, t, "") for t in (1, 2, 3)])
    assert [x["ts_us"] for x in filters.in_range(r, 1, 3).orderBy("ts_us").collect()] == [2, 3]
    assert temporal.at_or_after(r, 2).first()["ts_us"] == 2
    assert temporal.nearest(r, 10, 5).first() is None and temporal.nearest(r, 10, 7).first()["ts_us"] == 3


def test_lookups_against_plain_search(spark):
    rng = random.Random(3)
    day = 86_400_000_000
    rows = [(0, 1, 1 + rng.randrange(2), "data", rng.randrange(40) * day // 7, i, "") for i in range(120)]
    probes = [(0, 1, 1 + rng.randrange(2), rng.randrange(45) * day // 7 + rng.choice((-5, 0, 5)), i) for i in range(80)]
    r = records(spark, rows)
    p = spark.createDataFrame(probes, "file_id int, type_id int, instance_id int, ts_us long, probe long")
    eps = day // 2
    low = {x["probe"]: x["hit_ts_us"] for x in temporal.lower_bound_join(p, r).collect()}
    near = {x["probe"]: x["hit_ts_us"] for x in temporal.nearest_join(p, r, eps).collect()}
    for _, _, instance, t, i in probes:
        ts = sorted(x[4] for x in rows if x[2] == instance)
        assert low[i] == next((x for x in ts if x >= t), None)
        best = min(ts, key=lambda x: (abs(x - t), x))
        assert near[i] == (best if abs(best - t) <= eps else None)


def test_numbers_gaps_and_context(spark):
    rows = [(0, 1, 1, k, t, i, f"v{i}") for i, (k, t) in enumerate([("configuration", 0), ("data", 5), ("data", 5), ("configuration", 10**12), ("data", 10**12 + 1)])]
    r = records(spark, rows)
    assert [x["stream_index_number"] for x in temporal.index_numbers(r).orderBy("file_offset").collect()] == [0, 1, 2, 3, 4]
    assert [x["gap_us"] for x in temporal.record_gaps(r).where("record_type = 'data'").orderBy("file_offset").collect()] == [None, 0, 10**12 - 4]
    assert [x["config"] for x in temporal.config_asof(r).orderBy("file_offset").collect()] == ["v0", "v0", "v3"]
    assert temporal.kth_record(r, 1).where("record_type = 'data'").first()["file_offset"] == 2
    assert [x["next_offset"] for x in temporal.record_limits(r).orderBy("file_offset").collect()] == [1, 2, 3, 4, None]
    assert filters.preroll(r, 10**12 + 1).count() == 0 and filters.preroll(r, 10**12).first()["file_offset"] == 3


def test_decimation_against_plain_walk(spark):
    rng = random.Random(5)
    rows = [(f, t, 1, "data", rng.randrange(3000), i, "") for i, (f, t) in enumerate([(f, t) for f in (0, 1) for t in (1, 2) for _ in range(150)])]
    got = {x["file_offset"] for x in decimate.interval_decimate(records(spark, rows), 100).collect()}
    want, last = set(), {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[4], r[5])):
        if r[:2] not in last or r[4] >= last[r[:2]] + 100:
            want.add(r[5])
            last[r[:2]] = r[4]
    assert got == want
    for farthest in (True, False):
        got = {x["file_offset"] for x in decimate.bucket_decimate(records(spark, rows), 200, 40, farthest).collect()}
        want = set()
        for f in (0, 1):
            at, held = None, {}
            for r in sorted((r for r in rows if r[0] == f), key=lambda r: (r[4], r[1], r[2], r[5])):
                at = r[4] if at is None else at
                if r[4] - at > 40:
                    want |= {x[5] for x in held.values()}
                    held, at = {}, at + 200
                elif abs(r[4] - at) <= 40:
                    old = held.get(r[1])
                    if old is None or (abs(old[4] - at) < abs(r[4] - at)) == farthest and abs(old[4] - at) != abs(r[4] - at):
                        held[r[1]] = r
            want |= {x[5] for x in held.values()}
        assert got == want


def test_tags():
    assert merge.merge_tags({"a": "1"}, {"a": "2", "b": "3"}) == {"a": "1", "a_merged": "2", "b": "3"}
    assert merge.merge_tags({"a": "1", "a_merged": "2"}, {"a": "3"}) == {"a": "1", "a_merged": "2", "a_merged-1": "3"}
    assert merge.merge_tags({"a": "1"}, {"a": "2"}, private=True) == {"a": "1"}
    assert merge.related([{"session_id": "x"}, {}, {"session_id": "x"}]) and not merge.related([{"session_id": "x"}, {"session_id": "y"}])
    assert merge.first_tags([{"a": "1"}, {"a": "2", "b": "3"}]) == {"a": "1", "b": "3"}


def test_digests():
    d = digest.Digest
    assert d().raw(b"a\0").hex() == d().text("a").hex() != d().raw(b"a").hex()
    assert [d().text("a").hex(), d().text("a").text("b").hex(), d().text("abc").hex(), d().text("ab").text("").hex()] == ["e513e02c99167f96", "2b4d0fc9e4bf29e2", "fa5741489fa85bff", "d997f8be8ae224f1"]
    assert d().mapping({"a": "b", "c": "d"}).hex() == "195268c1fb719fe4" and d().mapping({}).hex() == "97efee010603e0a0"


def test_compare(spark):
    a = records(spark, [(0, 1, 1, "data", 1, 1, "x"), (0, 1, 1, "data", 2, 2, "y"), (0, 1, 2, "data", 3, 3, "z")])
    b = records(spark, [(0, 1, 5, "data", 1, 1, "x"), (0, 1, 5, "data", 2, 2, "Y"), (0, 1, 5, "data", 9, 3, "new")])
    out = {r["place"]: r for r in compare.compare_records(a, b, strict=True).collect()}
    assert (out[1]["n_matched"], out[1]["n_different"], out[1]["n_missing"], out[1]["n_extra"]) == (1, 1, 0, 1) and out[2]["n_missing"] == 1


def test_compare_counts_repeats(spark):
    side = lambda *p: records(spark, [(0, 1, 1, "data", 1, i, x) for i, x in enumerate(p)])
    out = compare.compare_records(side("a", "a", "b"), side("a", "a", "c"), strict=True).first()
    assert (out["n_matched"], out["n_different"], out["n_missing"], out["n_extra"]) == (2, 1, 0, 0)


def made_file(tmp_path, payloads, layout, index=True):
    """A recording laid down by hand, field by field."""
    import struct

    def text(s):
        return struct.pack("<I", len(s)) + s.encode()

    def tags(d):
        return struct.pack("<I", len(d)) + b"".join(text(k) + text(v) for k, v in sorted(d.items()))

    private = {"RF:Data:7": "data_layout+image/raw", "DL:Data:7:0": layout, "x_Recordable_Flavor": "test/made"}
    body = struct.pack("<I", 1) + struct.pack("<iH", 998, 3) + tags({"k": "u"}) + tags(private) + tags({"session_id": "x"})
    sizes = [32 + len(p) for p in payloads]
    first = 80 + 32 + len(body)
    out = struct.pack("<II", 0x69736956, 0x65526E6F) + struct.pack("<QII", 5, 80, 32) + struct.pack("<qqq", first + sum(sizes), 80, first) + struct.pack("<QQQ", 0, 0, 0) + struct.pack("<II", 0x64726F63, 0x32535256)
    before = 0

    def record(type_id, version, ts, instance, kind, data):
        nonlocal before
        head = struct.pack("<IIiIdHBBI", 32 + len(data), before, type_id, version, ts, instance, kind, 0, 0)
        before = 32 + len(data)
        return head + data

    out += record(2, 2, 0.0, 0, 1, body)
    for i, p in enumerate(payloads):
        out += record(998, 7, 1.5e-6 + i, 3, 3, p)
    entries = b"".join(struct.pack("<dIBiH", 1.5e-6 + i, n, 3, 998, 3) for i, n in enumerate(sizes))
    out += record(1, 2, 0.0, 0, 1, struct.pack("<I", 1) + struct.pack("<iH", 998, 3) + struct.pack("<I", len(sizes)) + entries)
    path = str(tmp_path / "made.rec")
    with open(path, "wb") as f:
        f.write(out)
    return path


def test_made_file_is_read_decoded_copied_and_checked(spark, tmp_path):
    import json
    import struct

    layout = json.dumps({"data_layout": [{"name": "n", "type": "DataPieceValue<uint32_t>", "offset": 0}, {"name": "s", "type": "DataPieceString", "index": 0}]})
    payloads = [struct.pack("<III", 10 + i, 0, i) + b"abcde"[:i] + b"PIXELS" for i in range(5)]
    path = made_file(tmp_path, payloads, layout)
    spark.dataSource.register(recording.RecordingSource)
    read = lambda p, t: spark.read.format("recording").option("table", t).load(p)
    assert [bytes(r["payload"]) for r in read(path, "records").orderBy("timestamp").collect()] == payloads
    blocks = cli.run(spark, ["print-json", path]).orderBy("ts_us", "block").collect()
    assert [json.loads(b["content"]) for b in blocks if b["block"] == 0] == [{"n": 10 + i, "s": "abcde"[:i]} for i in range(5)]
    assert [(b["kind"], b["format"], b["start"], b["size"]) for b in blocks if b["block"] == 1] == [("image", "raw", 12 + i, 6) for i in range(5)]
    # A copy keeps tags, versions and exact times, and so its checksums.
    copied = cli.run(spark, ["copy", path, "--to", str(tmp_path / "c"), "+", "998-test/made"]).first()["path"]
    a, b = (read(p, "records").orderBy("timestamp").collect() for p in (path, copied))
    assert [(r["timestamp"], r["format_version"], bytes(r["payload"])) for r in a] == [(r["timestamp"], r["format_version"], bytes(r["payload"])) for r in b] and a[0]["timestamp"] == 1.5e-6
    s, t = read(path, "streams").first(), read(copied, "streams").first()
    assert s["user_tags"] == t["user_tags"] == {"k": "u"} and s["private_tags"] == t["private_tags"] and t["flavor"] == "test/made"
    assert read(copied, "files").first()["tags"] == {"session_id": "x"}
    sums = [sorted((r["name"], r["checksum"]) for r in cli.run(spark, ["checksums", p]).collect()) for p in (path, copied)]
    assert sums[0] == sums[1] and {n for n, _ in sums[0]} == {"filetags", "998-3_vrstags", "998-3_usertags", "998-3_headers", "998-3_payload", "checksum"}
    heads, bodies = digest.Digest(), digest.Digest()
    for i, p in enumerate(payloads):
        heads.raw(struct.pack("<dIIHHB", 1.5e-6 + i, 7, len(p), 998, 1, 3))
        bodies.raw(p)
    assert dict(sums[0])["998-3_headers"] == heads.hex() and dict(sums[0])["998-3_payload"] == bodies.hex()
    # Damage: reading stops there, and the check says how far it got.
    raw = bytearray(open(path, "rb").read())
    at = [r["file_offset"] for r in a][3]
    raw[at + 8] ^= 0xFF
    bad = str(tmp_path / "bad.rec")
    with open(bad, "wb") as f:
        f.write(raw)
    r = cli.run(spark, ["check", bad]).first()
    assert (r["total"], r["good"]) == (5, 3)
    assert cli.run(spark, ["hexdump", bad]).count() == 3
    with pytest.raises(Exception, match="isn't the one of the index"):
        read(bad, "records").count()
    # Copies side by side and merged; recordings of other sessions are refused.
    both = cli.run(spark, ["copy", path, copied, "--to", str(tmp_path / "two")]).first()
    assert both["n"] == 10 and {r["instance_id"] for r in read(both["path"], "streams").collect()} == {3, 4}
    one = cli.run(spark, ["merge", path, copied, "--to", str(tmp_path / "one")]).first()
    assert one["n"] == 5 and read(one["path"], "streams").count() == 1


def test_filters_reach_the_index(spark, tmp_path):
    rows = [(0, 1201, 1 + i % 2, "data", i * 1000, i, "x" * 10) for i in range(40)]
    path = recording.write_recordings(records(spark, rows).withColumn("file_id", F.lit("p")), str(tmp_path)).first()["path"]
    reader = recording.FilteringReader([path], "records", False)
    list(reader.pushFilters([recording.GreaterThan(("ts_us",), 10_000), recording.LessThanOrEqual(("ts_us",), 20_000), recording.EqualTo(("instance_id",), 2), recording.In(("record_type",), ("data", "state"))]))
    assert [e["ts"] for p in reader.partitions() for e in p.entries] == [0.011, 0.013, 0.015, 0.017, 0.019]


def test_dense_streams_are_cut_into_buckets(spark, monkeypatch):
    from tracklode.operators import ordered

    monkeypatch.setattr(ordered, "BUCKET_ROWS", 100)
    hour = records(spark, [(0, 1, 1, "data", 3_600_000 * i, i, "") for i in range(1000)] + [(0, 1, 2, "data", 10**15 * i, i, "") for i in range(3)])
    width = ordered.bucket_width(hour, ["file_id", "type_id", "instance_id"], "ts_us")
    assert 300_000_000 < width < 400_000_000
    assert [x["stream_index_number"] for x in temporal.index_numbers(hour).where("instance_id = 1").orderBy("ts_us").collect()] == list(range(1000))
    assert {x["gap_us"] for x in temporal.record_gaps(hour).where("instance_id = 1").collect()} == {None, 3_600_000}


def test_named_streams_count_within_each_file(spark):
    r = records(spark, [(f, 200, i, "data", 1, i, "") for f, ids in ((0, (1, 5)), (1, (2, 7))) for i in ids])
    out = filters.select_records(r, Selection(streams=[("+", "200+2")]))
    assert {(x["file_id"], x["instance_id"]) for x in out.collect()} == {(0, 5), (1, 7)}
    flavored = r.withColumn("flavor", F.when(F.col("instance_id") == 7, "b").otherwise("a"))
    assert [x["instance_id"] for x in filters.select_records(flavored, Selection(streams=[("+", "200-b")])).collect()] == [7]
    assert filters.constrained_range(Selection(after=Bound.parse("0.0000005")), r) == (1, 1)


def test_layout_round_trip():
    spec = [("flag", "Value<Bool>"), ("n", "Value<uint64_t>"), ("p", "Value<Point3Df>"), ("m", "Array<Matrix2Di>"), ("name", "Array<char>"), ("v", "Vector<double>"), ("s", "String"), ("vs", "Vector<string>"), ("d", "StringMap<int32_t>"), ("ds", "StringMap<string>")]
    import json

    rows = [{"name": k, "type": "DataPiece" + t, **({"size": 2 if k == "m" else 8} if t.startswith("Array") else {})} for k, t in spec]
    layout = layouts.Layout.parse(json.dumps({"data_layout": rows}))
    value = {"flag": True, "n": 2**63 + 1, "p": {"x": 1.0, "y": 2.0, "z": 3.0}, "m": [[[1, 2], [3, 4]], [[5, 6], [7, 8]]], "name": "abc", "v": [1.5, 2.5], "s": "häl", "vs": ["", "x"], "d": {"a": 1}, "ds": {"k": "v"}}
    data = layout.pack(value)
    assert layout.read(data) == value and layout.size_in(data) == len(data) and layout.size_in(data[:-1]) is None
    again = layouts.Layout.parse(layout.text())
    assert again.read(data) == value and len(again.schema()) == 10
    old = layouts.Layout([layouts.Piece("n", "Value", layouts.Element("uint64_t")), layouts.Piece("s", "Vector", layouts.Element("string"), required=True)])
    assert layout.mapped(old)["s"] is None and not layout.serves(old)


def test_formats(spark):
    blocks = formats.parse_format("data_layout/size=48+image/raw/640x480/pixel=grey8/stride=648")
    assert formats.format_text(blocks) == "data_layout/size=48+image/raw/640x480/pixel=grey8/stride=648"
    assert formats.block_sizes([10, None, 5], 100) == [10, 85, 5] and formats.block_sizes([None, None], 9) == [None, None]
    rows = [("grey8", 640, 480, 0, 0, 307_200), ("yuv_i420_split", 5, 3, 0, 0, 27), ("raw10", 6, 2, 0, 0, 20), ("yuy2", 3, 2, 0, 0, 16), ("grey16", 4, 2, 10, 0, 20)]
    df = spark.createDataFrame(rows, "p string, w long, h long, s long, s2 long, want long")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", formats.raw_image_size(F.col("p"), F.col("w"), F.col("h"), F.col("s"), F.col("s2"))).collect())


def test_text(spark):
    df = spark.createDataFrame([(0,), (512,), (1536,), (104_857_600,), (-2048,), (10_736_344_498,)], "n long")
    assert [r[0] for r in df.select(text.readable_size(F.col("n"))).collect()] == ["0 B", "512 B", "1.50 KiB", "100 MiB", "-2.00 KiB", "9.99 GiB"]
    assert [text.duration_text(x) for x in (0, 0.25, 61, 90_000)] == ["0.000s", "250ms", "1m 1.000s", "1 day, 1h 0m 0.000s"]
    assert text.printable("a\n\x1bé") == "a\\n\\e\\xc3\\xa9" and text.byte_size("1.5MB") == 1_572_864 and text.byte_size("x") is None
    assert sorted(["a10", "a9", "a1"], key=text.natural_key) == ["a1", "a9", "a10"]
    assert text.path_spec("store://a/b%20c?x=1") == {"handler": "store", "chunks": ["a/b c"], "extras": {"x": "1"}}


def test_text_columns(spark):
    names = ["b10", "a2", "a10", "A1", "a02x"]
    rows = spark.createDataFrame([(x,) for x in names], "s string")
    assert [r["s"] for r in rows.orderBy(text.natural_order(F.col("s"))).collect()] == ["A1", "a2", "a02x", "a10", "b10"]
    r = spark.range(1).select(
        text.query_values(F.lit("s://p/q?a=1&b=x%20y&a=2&c&d=e%3Df+g")).alias("q"), text.query_values(F.lit("s://p/q")).alias("none"),
        text.split_trimmed(F.lit(" a, ,b ,"), ",").alias("p"), text.split_trimmed(F.lit("a,,b"), ",", skip_empty=False).alias("all"),
        text.leading_number(F.lit("17x")).alias("n"), text.leading_number(F.lit("4294967296")).alias("big"), text.leading_number(F.lit("x1")).alias("no"),
        text.readable_duration(F.lit(3723.5)).alias("d"), text.readable_text(F.lit("a\tb\u00e9")).alias("t"), text.readable_datetime(F.lit(86400.9)).alias("at"),
    ).first()
    assert r["q"] == {"a": "2", "b": "x y", "c": "", "d": "e=f g"} and r["none"] == {}
    assert (r["p"], r["all"]) == (["a", "b"], ["a", "", "b"]) and (r["n"], r["big"], r["no"]) == (17, None, None)
    assert (r["d"], r["t"], r["at"]) == (text.duration_text(3723.5), text.printable("a\tb\u00e9"), "1970-01-02 00:00:00")


def test_specs(spark):
    """The order in which specs are told, key frames, sizes from the next block's layout, and what can't be told."""
    import json
    import struct

    from tracklode.operators import decode, specs

    def layout(*names):
        return json.dumps({"data_layout": [{"name": n, "type": "DataPieceValue<uint32_t>", "offset": 4 * i} for i, n in enumerate(names)]})

    image = layout("image_width", "image_height", "image_pixel_format")
    tags = {
        "RF:Configuration:1": "data_layout+data_layout", "DL:Configuration:1:0": image, "DL:Configuration:1:1": layout("other"),
        "RF:Data:1": "image/raw", "RF:Data:2": "data_layout+image/raw", "DL:Data:2:0": image, "RF:Data:3": "image/raw/8x2/pixel=grey8",
        "RF:Data:4": "data_layout+image/video/codec=h+custom", "DL:Data:4:0": layout("next_content_block_size", "image_key_frame_index"),
    }
    rows = [
        ("data", 0, 0, 1, b"xxxx"), ("configuration", 1, 1, 1, struct.pack("<4I", 4, 1, 1, 9)), ("data", 2, 2, 1, b"abcd"), ("data", 3, 3, 2, struct.pack("<3I", 2, 1, 4) + b"rgbrgb"),
        ("data", 4, 4, 3, b"." * 16), ("data", 5, 5, 4, struct.pack("<2I", 3, 7) + b"key" + b"rest"), ("configuration", 6, 6, 1, struct.pack("<4I", 0, 0, 0, 9)), ("data", 7, 7, 1, b"zz"),
    ]
    r = spark.createDataFrame([(0, 1, 1, *x) for x in rows], "file_id int, type_id int, instance_id int, record_type string, ts_us long, file_offset long, format_version int, payload binary")
    streams = spark.createDataFrame([(0, 1, 1, tags)], "file_id int, type_id int, instance_id int, private_tags map<string,string>")
    blocks = decode.decoded_blocks(r, streams)
    got = [(b["ts_us"], b["told_by"], b["pixel"], b["width"], b["size"], b["key_frame_index"]) for b in specs.block_specs(blocks).orderBy("ts_us").collect()]
    assert got == [
        (0, None, None, None, 4, None), (2, "configuration", "grey8", 4, 4, None), (3, "record", "rgb8", 2, 6, None),
        (4, "format", "grey8", 8, 16, None), (5, "configuration", "grey8", 4, 3, 7), (7, None, None, None, 2, None),
    ]
    assert specs.decode_status(blocks).first()[1:] == (8, 8, 6, 0)


def test_verbatim(spark, tmp_path):
    from tracklode.sources import export

    data = bytes(range(256)) * 40_000
    for name, x in (("a", data), ("b", data[:9_000_000] + b"?" + data[9_000_001:]), ("c", data[:-1])):
        (tmp_path / name).write_bytes(x)
    (tmp_path / "d").write_bytes(data[:1000])
    (tmp_path / "d_1").write_bytes(data[1000:])
    got = {n: tuple(export.compare_verbatim(spark, str(tmp_path / "a"), str(tmp_path / n)).first()[2:]) for n in "abcd"}
    assert got == {"a": (True, None), "b": (False, 9_000_000), "c": (False, None), "d": (True, None)}


def test_media():
    rng = np.random.default_rng(0)
    for shape, kind in (((5, 7), np.uint8), ((5, 7), np.uint16), ((5, 7, 3), np.uint8)):
        x = rng.integers(0, np.iinfo(kind).max, shape).astype(kind)
        assert (media.png_pixels(media.png_bytes(x)) == x).all()
    x = np.array([[1023, 512, 3, 0]], np.uint16)
    raw = bytes([*(x[0] >> 2).astype(np.uint8), int((x[0] & 3) @ [1, 4, 16, 64])])
    assert (media.five_bytes(raw, 4, 1) == x).all()
    assert media.psnr(x.astype(np.uint8), x.astype(np.uint8)) == 100.0 and media.differing(b"\x00\x0f", b"\x00\x00") == (1, 4)
    assert media.normalised(bytes([16, 128, 235, 128]), "yuy2", 2, 1).tolist() == [[[0, 0, 0], [255, 255, 255]]]
    assert len(media.wav_bytes(b"\0" * 8, "int16le", 1, 44_100)) == 52
    with pytest.raises(LookupError):
        media.decode_image(b"", "jxl")


def test_recording_round_trip(spark, tmp_path):
    rows = [(0, 1201, 1 + i % 2, ("configuration", "data")[i > 1], i * 1000, i, "payload " * (i * 20)) for i in range(30)]
    r = records(spark, rows).withColumn("file_id", F.lit("a"))
    out = recording.write_recordings(r, str(tmp_path), {"session_id": "s"}).collect()
    assert [(x["file_id"], x["n"]) for x in out] == [("a", 30)] and recording.is_recording(out[0]["path"])
    spark.dataSource.register(recording.RecordingSource)
    for rebuild in ("false", "true"):
        back = spark.read.format("recording").option("rebuild", rebuild).load(out[0]["path"]).orderBy("ts_us").collect()
        assert [(b["instance_id"], b["record_type"], b["ts_us"], b["payload"].decode()) for b in back] == [(x[2], x[3], x[4], x[6]) for x in rows]
        assert {b["compression"] for b in back} == {0, 2}
    files = spark.read.format("recording").option("table", "files").load(out[0]["path"]).first()
    assert files["tags"] == {"session_id": "s"} and files["has_index"]
    assert spark.read.format("recording").option("table", "streams").load(out[0]["path"]).count() == 2
    assert not recording.is_recording(__file__)
    listed = cli.run(spark, ["list", out[0]["path"], "+", "1201-2", "-", "conf"])
    assert listed.count() == 14
    copied = cli.run(spark, ["copy", out[0]["path"], "--to", str(tmp_path / "b"), "--after", "0.0205"]).collect()
    assert copied[0]["n"] == 9 + 2
    assert {r["n_missing"] for r in cli.run(spark, ["compare", out[0]["path"], out[0]["path"]]).collect()} <= {0}


@pytest.mark.parametrize("split", [False, True])
def test_chunks_are_read_as_one(spark, tmp_path, split):
    import os

    rows = [(0, 1201, 1 + i % 2, ("configuration", "data")[i > 1], i * 1000, i, f"payload {i} " * (i * 9)) for i in range(40)]
    r = records(spark, rows).withColumn("file_id", F.lit("a"))
    write = lambda size: recording.write_recordings(r, str(tmp_path), {"k": "v"}, recording.NONE, chunk_size=size, split=split).first()["path"]
    write(1 << 10)
    many = len(os.listdir(tmp_path))
    path = write(4 << 10)
    names = sorted(n for n in os.listdir(tmp_path) if "crc" not in n)
    assert 3 < len(names) < many and names == sorted(["a.rec", *(f"a.rec_{k}" for k in range(1, len(names)))])
    assert all(os.path.getsize(tmp_path / n) <= 5 << 10 for n in names[1:])
    spark.dataSource.register(recording.RecordingSource)
    for rebuild in ("false", "true"):
        back = spark.read.format("recording").option("rebuild", rebuild).load(str(tmp_path / "*")).orderBy("ts_us").collect()
        assert [(b["instance_id"], b["record_type"], b["ts_us"], b["payload"].decode()) for b in back] == [(x[2], x[3], x[4], x[6]) for x in rows]
    assert spark.read.format("recording").option("table", "files").load(path).first()["has_index"]
    os.rename(tmp_path / names[-1], tmp_path / "away")
    assert 0 < spark.read.format("recording").option("table", "index").load(path).count() < 40


def test_index_of_an_unclosed_recording(tmp_path):
    """An index in front that wasn't closed: its size and the records' start are not told, its last entry is cut."""
    import struct

    def record(size, type_id, version, kind, ts=0.0, before=0):
        return struct.pack("<IIiIdHBBI", size, before, type_id, version, ts, 1, kind, 0, 0)

    description = struct.pack("<I", 0) * 2
    entries = b"".join(struct.pack("<dIBiH", float(i), 40, 3, 998, 1) for i in range(4))
    magic = struct.pack("<II", 0x69736956, 0x65526E6F)
    at = 80 + 32 + len(description)
    header = magic + struct.pack("<QIIqqqQQQII", 0, 80, 32, at, 80, 0, 0, 0, 0, 0x64726F63, recording.VERSIONS[1])
    head = header + record(32 + len(description), 2, 2, 1) + description + record(32, 1, 3, 1) + entries[:-5]
    (tmp_path / "x.rec").write_bytes(head)
    (tmp_path / "x.rec_1").write_bytes(b"".join(record(40, 998, 1, 3, float(i), 40) + b"abcdefgh" for i in range(3)))
    found = recording.Recording(str(tmp_path / "x.rec")).index()
    assert found["ts"].tolist() == [0, 1, 2] and found["at"].tolist() == [len(head) + 40 * i for i in range(3)]


def test_command_line():
    c = cli.parse(["copy", "a", "b", "+", "1201", "-", "data", "--range", "+1", "-2", "--decimate", "1202", "0.01", "--to", "x"])
    assert c.paths == ["a", "b"] and c.chosen.streams == [("+", "1201")] and c.chosen.types == [("-", "data")] and c.intervals == {1202: 10_000}
    assert cli.parse(["file"]).name == "details"
    for bad in ([], ["copy", "a"], ["details"], ["a", "--after"], ["a", "--no"]):
        with pytest.raises(ValueError):
            cli.parse(bad)


def test_streaming(spark, tmp_path):
    from tracklode.streaming import live

    rows = [(0, 1, 1, k, t, i, f"v{i}") for i, (k, t) in enumerate([("data", 5), ("configuration", -2), ("data", 9), ("state", 3), ("configuration", 7), ("data", 1)])]
    r = records(spark, rows)
    assert {x["file_offset"] for x in live.purged(r, 6).collect()} == {2, 3, 4}
    assert live.ready(r, 5).count() == 3
    r.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(r.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    live.write_live(stream, str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination()
    assert [x["ts_us"] for x in live.read_live(spark, str(tmp_path / "out")).collect()] == [-2, 1, 3, 5, 7, 9]
    q = live.latest_context(stream).writeStream.format("memory").queryName("context").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    best = spark.table("context").groupBy("record_type").agg(F.max("ts_us").alias("t")).collect()
    assert {x["record_type"]: x["t"] for x in best} == {"configuration": 7, "state": 3}
    assert live.flush_delay(1_000_000, 2_000_000) == "2400 milliseconds"


def test_entry_and_oracles(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and e.entry(spark).count() > 0


def test_streams_and_edits(spark, tmp_path):
    from tracklode.operators import edit, streams, video
    from tracklode.sources import cache, export

    s = spark.createDataFrame([(0, 200, 1, "a"), (0, 200, 4, "b"), (0, 201, 1, "a")], "file_id int, type_id int, instance_id int, flavor string")
    assert streams.stream_by_name(s, "200-4").first()["instance_id"] == 4 and streams.stream_by_name(s, "200+2").first()["instance_id"] == 4
    assert streams.stream_by_name(s, "camera").count() == 0 and streams.nth_stream(s, 200, 0, "b").first()["instance_id"] == 4
    r = records(spark, [(0, 200, 1, "data", 1, 1, "abc"), (0, 201, 1, "data", 2, 2, "de"), (0, 200, 1, "data", 3, 3, "f")])
    assert [bytes(x["payload"]) for x in edit.zeroed(r, [200]).orderBy("ts_us").collect()] == [b"\0\0\0", b"de", b"\0"]
    assert [x["ts_us"] for x in video.frame_set(r, 1).orderBy("ts_us").collect()] == [1, 2]
    o = edit.overridden(spark.createDataFrame([({"a": "1", "b": "2"},)], "user_tags map<string,string>"), {"a": "3"}).first()
    assert o["user_tags"] == {"a": "3", "b": "2"}
    assert len(streams.serial_number({}, {"a": "b"}, {}, StreamId(200, 1))) == 16
    path = recording.write_recordings(r.withColumn("file_id", F.lit("c")), str(tmp_path)).first()["path"]
    cache.save_catalog(spark, path, str(tmp_path / "catalog"))
    assert {k: v.count() for k, v in cache.catalog(spark, str(tmp_path / "catalog")).items()} == {"files": 1, "streams": 2, "index": 3}
    assert export.file_checksums(spark.createDataFrame([(path,)], "path string")).first()["size"] > 200
    blocks = spark.createDataFrame([("200-1", 0, t, "int16le", 1, 8000, b"\1\2\3\4") for t in range(3)], "stream_id string, segment int, ts_us long, sample string, channels int, rate int, payload binary")
    assert export.export_audio(blocks, str(tmp_path / "wav")).first()["n"] == 3
    frames = spark.createDataFrame([("200-1", 1, 0.5, "grey8", 2, 2, 0, b"\1\2\3\4")], "stream_id string, number int, timestamp double, pixel string, width int, height int, stride int, payload binary")
    png = export.export_images(frames, str(tmp_path / "png")).first()["path"]
    assert media.png_pixels(open(png, "rb").read()).tolist() == [[1, 2], [3, 4]]


def test_many_taken_instances_are_passed_at_once():
    import time

    by_file = [(f, [StreamId(200, i) for i in range(1, 4001)]) for f in range(3)]
    start = time.perf_counter()
    ids = merge.unique_ids(by_file)
    assert time.perf_counter() - start < 5  # a walk over every taken instance needs a minute
    assert ids[0, StreamId(200, 7)] == StreamId(200, 7) and ids[1, StreamId(200, 7)] == StreamId(200, 4007) and ids[2, StreamId(200, 4000)] == StreamId(200, 12_000)
    gaps = merge.unique_ids([(0, [StreamId(1, i) for i in (1, 2, 5)]), (1, [StreamId(1, i) for i in (1, 5)]), (2, [StreamId(1, 1)])])
    assert [gaps[1, StreamId(1, 1)].instance_id, gaps[1, StreamId(1, 5)].instance_id, gaps[2, StreamId(1, 1)].instance_id] == [3, 6, 4]


@pytest.fixture
def late_broadcast(spark):
    """Joins are planned as shuffles; then adaptive execution broadcasts their small side and reads the other one mapper by mapper."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "20KB", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k in conf:
        spark.conf.unset(k)


def test_a_file_and_a_stream_are_one_task_whatever_the_joins(late_broadcast, tmp_path):
    spark = late_broadcast
    r = spark.range(0, 4000, 1, 8).select(
        F.concat(F.lit("f"), (F.col("id") % 2).cast("string")).alias("file_id"), (F.col("id") % 3 + 200).cast("int").alias("type_id"), F.lit(1).alias("instance_id"), F.lit("data").alias("record_type"),
        (F.col("id") * 1000).alias("ts_us"), F.col("id").alias("file_offset"), F.col("id").cast("string").cast("binary").alias("payload"),
    )
    done = recording.write_recordings(r, str(tmp_path), compression=recording.NONE).collect()
    assert sorted((d["file_id"], d["n"]) for d in done) == [("f0", 2000), ("f1", 2000)]
    spark.dataSource.register(recording.RecordingSource)
    assert spark.read.format("recording").load(f"{tmp_path}/*.rec").count() == 4000
    digests = digest.stream_digests(r).collect()
    assert len(digests) == 6 and sum(d["n"] for d in digests) == 4000


def test_formats_and_layouts_are_read_once(monkeypatch):
    from tracklode.operators import decode

    layout = layouts.Layout.parse('{"data_layout": [{"name": "n", "type": "DataPieceValue<int64_t>", "offset": 0}, {"name": "m", "type": "DataPieceValue<Matrix2Dd>", "offset": 8}, {"name": "s", "type": "DataPieceString", "index": 0}]}')
    payload = layout.pack({"n": 7, "m": [[1.0, 2.0], [3.0, 4.0]], "s": "x"}) + b"1234"
    seen = []
    monkeypatch.setattr(decode, "parse_format", lambda text: seen.append(text) or formats.parse_format(text))
    for _ in range(100):
        first, second = decode.blocks_of(payload, ["data_layout", "image/raw/once=1"], {"0": layout})
        assert first[4] == '{"m": [[1.0, 2.0], [3.0, 4.0]], "n": 7, "s": "x"}' and second[2:4] == (len(payload) - 4, 4)
    assert len(seen) == 1


def test_a_recording_is_made_by_many_tasks(spark, tmp_path):
    rows = [(0, 1201, 1 + i % 3, "data", i // 2 * 1000, i, f"payload {i}") for i in range(400)]
    r = records(spark, rows).withColumn("file_id", F.lit("a")).repartition(3)
    encoded = recording.encoded_records(r.select("file_id", "type_id", "instance_id", "record_type", (F.col("ts_us") / 1e6).alias("time"), F.lit(1).cast("long").alias("version"), "file_offset", F.col("payload").cast("binary").alias("payload")), recording.NONE)
    made = encoded.where(F.col("what") == recording.BODIES).orderBy("part", "nth").collect()
    assert sum(len(x["sizes"]) // 4 for x in made) == 400 and all(sum(np.frombuffer(x["sizes"], "<u4")) == len(x["data"]) for x in made)
    path = recording.write_recordings(r, str(tmp_path), {"k": "v"}, recording.NONE).first()["path"]
    spark.dataSource.register(recording.RecordingSource)
    back = spark.read.format("recording").option("rebuild", "true").load(path).orderBy("file_offset").collect()
    want = sorted(rows, key=lambda x: (x[4], x[2], x[5]))
    assert [(b["instance_id"], b["ts_us"], b["payload"].decode()) for b in back] == [(x[2], x[4], x[6]) for x in want]


def test_writer_holds_no_index(tmp_path):
    import tracemalloc

    n, size = 400_000, recording.RECORD.size
    body = b"".join(recording.RECORD.pack(size, size, 1201, 1, 0.0, 1, 3, 0, 0) for _ in range(1000))
    entries = recording.INDEX_ENTRY.pack(0.0, size, 3, 1201, 1) * 1000
    writer = recording.RecordingWriter(str(tmp_path / "a.rec"), {}, 1, 14, n, n * size)
    writer.add(recording.DESCRIBED, recording.STREAM_ID.pack(1201, 1) + recording.tags_bytes({}) * 2, None)
    tracemalloc.start()
    for _ in range(n // 1000):
        writer.add(recording.BODIES, body, np.full(1000, size, "<u4").tobytes())
    writer.add(recording.IDS, recording.STREAM_ID.pack(1201, 1), None)
    for _ in range(n // 1000):
        writer.add(recording.ENTRIES, entries, None)
    writer.close()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1 << 20
    found = recording.Recording(str(tmp_path / "a.rec"))
    assert len(found.index()) == len(found.walk()) == n


def test_small_records_and_streams_are_read_by_many_tasks(tmp_path, monkeypatch):
    monkeypatch.setattr(recording, "SPLIT_RECORDS", 16)
    monkeypatch.setattr(recording, "STREAM_ROWS", 2)
    writer = recording.RecordingWriter(str(tmp_path / "a.rec"), {}, 5, 5 * 14, 50, 50 * recording.RECORD.size)
    ids = [recording.STREAM_ID.pack(1201, k) for k in range(5)]
    writer.add(recording.DESCRIBED, b"".join(i + recording.tags_bytes({}) * 2 for i in ids), None)
    writer.add(recording.BODIES, b"".join(recording.RECORD.pack(recording.RECORD.size, recording.RECORD.size, 1201, 1, float(k), k % 5, 3, 0, 0) for k in range(50)), np.full(50, recording.RECORD.size, "<u4").tobytes())
    writer.add(recording.IDS, b"".join(ids), None)
    writer.add(recording.ENTRIES, b"".join(recording.INDEX_ENTRY.pack(float(k), recording.RECORD.size, 3, 1201, k % 5) for k in range(50)), None)
    writer.close()
    read = {}
    for table in ("records", "streams"):
        reader = recording.RecordingReader([writer.path], table, False)
        read[table] = [list(reader.read(p)) for p in reader.partitions()]
    assert [len(x) for x in read["records"]] == [16, 16, 16, 2] and [len(x) for x in read["streams"]] == [2, 2, 1]
    assert [x[6] for part in read["records"] for x in part] == [float(k) for k in range(50)]


def test_checksums_hold_no_file_at_once(spark, tmp_path):
    rows = [(0, 1201 + i % 2, 1 + i % 5, "data", i * 1000, i, f"payload {i}") for i in range(60)]
    r = records(spark, rows).withColumn("file_id", F.lit("a"))
    path = recording.write_recordings(r, str(tmp_path), {"k": "v"}, recording.NONE).first()["path"]
    found = cli.run(spark, ["checksums", path])
    assert "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString()
    held = {x["name"]: x["checksum"] for x in found.collect()}
    total = digest.Digest().text(held["filetags"])
    for t in (1201, 1202):
        for i in range(1, 6):
            for what in ("vrstags", "usertags", "headers", "payload"):
                total.text(held[f"{t}-{i}_{what}"])
    ids = "".join(f"{t}-{n}/" for t in (1201, 1202) for n in range(1, 6))
    assert held["checksum"] == total.text(digest.Digest().raw(ids.encode()).hex()).hex() and len(held) == 42


def test_instances_beyond_16_bits(spark, tmp_path):
    ids = [(200, 1), (200, 65535), (200, 65536), (200, 65537), (201, 108_001), (65_000, 2**31 - 1)]
    rows = [(0, *ids[i % 6], ("configuration", "data")[i > 5], i * 1000, i, f"payload {i}") for i in range(36)]
    r = records(spark, rows).withColumn("file_id", F.lit("a"))
    tags = r.select("file_id", "type_id", "instance_id", F.create_map(F.lit("side"), F.col("instance_id").cast("string")).alias("user_tags"), F.create_map(F.lit("x_Recordable_Flavor"), F.lit("f")).alias("private_tags")).dropDuplicates(["type_id", "instance_id"])
    path = recording.write_recordings(r, str(tmp_path), {"k": "v"}, recording.NONE, tags).first()["path"]
    spark.dataSource.register(recording.RecordingSource)
    for rebuild in ("false", "true"):
        back = spark.read.format("recording").option("rebuild", rebuild).load(path).orderBy("ts_us").collect()
        assert [(b["type_id"], b["instance_id"], b["stream_id"], b["payload"].decode()) for b in back] == [(x[1], x[2], f"{x[1]}-{x[2]}", x[6]) for x in rows]
    copied = cli.run(spark, ["copy", path, "--to", str(tmp_path / "c"), "+", "200", "+", "201-108001", "-", "200-65535", "--after", "0.0065"]).first()
    streams = spark.read.format("recording").option("table", "streams").load(copied["path"]).collect()
    kept = [(200, 1), (200, 65536), (200, 65537), (201, 108_001)]
    assert sorted((s["type_id"], s["instance_id"], s["user_tags"]["side"], s["flavor"]) for s in streams) == [(t, i, str(i), "f") for t, i in kept]
    back = spark.read.format("recording").load(copied["path"]).orderBy("ts_us").collect()
    assert [b["payload"].decode() for b in back] == [x[6] for x in rows if (x[1], x[2]) in kept and (x[4] > 6500 or x[3] == "configuration")]
    with pytest.raises(ValueError, match="70000-70000"):
        recording.stored_id(70_000, 70_000)
    keys = np.array([recording.stored_id(t, i) for t, i in [*ids, (70_000, 5)]])
    assert [recording.stream_key(*k) for k in keys.tolist()] == [*ids, (70_000, 5)] == list(zip(*(x.tolist() for x in recording.stream_keys(keys[:, 0], keys[:, 1]))))


def test_tasks_are_told_a_place_not_the_index(tmp_path, monkeypatch):
    import pickle

    n, size = 300_000, recording.RECORD.size
    writer = recording.RecordingWriter(str(tmp_path / "a.rec"), {"k": "v"}, 20_000, 20_000 * 14, n, n * size)
    ids = b"".join(recording.STREAM_ID.pack(1201, k) for k in range(20_000))
    writer.add(recording.DESCRIBED, b"".join(recording.STREAM_ID.pack(1201, k) + recording.tags_bytes({}) * 2 for k in range(20_000)), None)
    writer.add(recording.BODIES, b"".join(recording.RECORD.pack(size, size, 1201, 1, k / 1e3, k % 5, 3, 0, 0) for k in range(n)), np.full(n, size, "<u4").tobytes())
    writer.add(recording.IDS, ids, None)
    writer.add(recording.ENTRIES, b"".join(recording.INDEX_ENTRY.pack(k / 1e3, size, 3, 1201, k % 5) for k in range(n)), None)
    writer.close()
    for table in ("records", "index", "streams", "files"):
        parts = recording.RecordingReader([writer.path], table, False).partitions()
        assert len(pickle.dumps(parts)) < 4000 and (table == "files" or len(parts) == 3)
    # Blocks of the index, reads and batches may end anywhere.
    for name, value in (("INDEX_ROWS", 70_000), ("BATCH_ROWS", 999), ("READ", 5000)):
        monkeypatch.setattr(recording, name, value)
    reader = recording.FilteringReader([writer.path], "records", False)
    list(reader.pushFilters([recording.EqualTo(("instance_id",), 2), recording.GreaterThan(("ts_us",), 50_000_000)]))
    parts = reader.partitions()
    assert len(parts) == 5
    assert [x[7] for p in parts for x in reader.read(p)] == [k * 1000 for k in range(n) if k % 5 == 2 and k > 50_000]


def test_chosen_streams_and_their_tags_stay_with_the_executors(spark, tmp_path, monkeypatch):
    rows = [(0, 200 + i % 2, 1 + i, "data", i * 1000, i, f"payload {i}") for i in range(20)]
    r = records(spark, rows).withColumn("file_id", F.lit("a"))
    path = recording.write_recordings(r, str(tmp_path)).first()["path"]
    c = cli.parse(["copy", path, "--to", "x"])
    held, streams = cli.opened(spark, c).withColumn("own", F.col("instance_id")), cli.opened(spark, c, "streams")
    with monkeypatch.context() as m:
        m.setattr(type(held), "collect", None)
        out = filters.select_records(held, Selection(streams=[("+", "200"), ("+", "201+2"), ("-", "200-3"), ("+", "x")]))
        tags = cli.renamed(streams, out, "own", "b", False)
    want = sorted((x[1], x[2]) for x in rows if x[1] == 200 and x[2] != 3 or x[2] == 4)
    assert sorted((x["type_id"], x["instance_id"]) for x in out.collect()) == sorted((x["type_id"], x["instance_id"]) for x in tags.collect()) == want


def test_compare_reads_each_file_by_its_own_load(spark, tmp_path):
    rows = [(0, 200, 65_530 + i % 9, "data", i * 1000, i, f"payload {i}") for i in range(45)]
    paths = [recording.write_recordings(records(spark, [*rows, *more]).withColumn("file_id", F.lit(name)), str(tmp_path)).first()["path"] for name, more in (("a", []), ("b", [(0, 200, 65_530, "data", 99_000, 99, "")]))]
    found = cli.run(spark, ["compare", *paths])
    assert sorted((x["place"], x["n_left"], x["n_matched"], x["n_different"], x["n_missing"]) for x in found.collect()) == [(k, 5, 5, 0, 0) for k in range(1, 10)]
    back = cli.run(spark, ["compare", *paths[::-1]])
    assert sorted((x["place"], x["n_left"], x["n_matched"], x["n_missing"]) for x in back.collect()) == [(1, 6, 5, 1), *((k, 5, 5, 0) for k in range(2, 10))]
    # Times count from an end of both files' data.
    cut = cli.run(spark, ["compare", *paths, "--before", "-0.06"])
    assert {(x["n_left"], x["n_matched"]) for x in cut.collect()} == {(5, 5), (4, 4)}
    scans = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in scans


def test_damage_doesnt_gather_a_file(spark):
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        r = spark.range(0, 400, 1, 4).select(F.lit("a").alias("file_id"), F.lit(200).alias("type_id"), F.lit(1).alias("instance_id"), F.lit("state").alias("record_type"), F.col("id").alias("ts_us"), F.col("id").alias("file_offset"), (F.col("id") != 399).alias("ok"))
        out = filters.up_to_damage(r)
        assert out.count() == 399 and out.select(F.spark_partition_id()).distinct().count() == 4
    finally:
        for k in conf:
            spark.conf.unset(k)
