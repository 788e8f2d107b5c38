"""Logs, documents, settings, bytes, files, renderers, cut plans, reports and the watcher."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from spotseam import queries
from spotseam.plans import cutplan, report
from spotseam.sinks import render
from spotseam.sources import broadcast, documents, files, logs, settings
from spotseam.streaming import watch

S = 1_000_000
LOG = "rec_id long, log string, duration_us long"


def logged(spark, text, duration=40):
    return spark.createDataFrame([(1, text, duration * S), (2, None, duration * S)], LOG)


def test_black_log(spark):
    got = logs.black_segments(logged(spark, "x\n[blackdetect @ 0x0] black_start:10.5 black_end:11.2 black_duration:0.7\nblack_start=12 black_end=13")).collect()
    assert [(r["start_us"], r["end_us"]) for r in got] == [(10_500_000, 11_200_000), (12 * S, 13 * S)]


def test_silence_log_pairs_in_order(spark):
    text = "silence_start: 10\nsilence_end: 11 | d\nsilence_start: 20\nsilence_end: 21\nsilence_start: 30"
    got = logs.silence_segments(logged(spark, text)).collect()
    assert [(r["start_us"] // S, r["end_us"] // S) for r in got] == [(10, 11), (20, 21), (30, 40)]
    assert logs.silence_segments(logged(spark, "silence_end: 3")).count() == 0


def test_frame_and_ssim_logs(spark):
    assert [r["t_us"] for r in logs.frame_events(logged(spark, "a pts_time:12.345 b pts_time:1")).collect()] == [12_345_000, S]
    text = "n:1 Y:0.998 U:0.999 V:0.997 All:0.998 (47.4)\nn:3 Y:0 U:0 V:0 All:0.49 (1)\nn:4 Y:0 U:0 V:0 All:0.50 (1)"
    assert [r["t_us"] for r in logs.ssim_events(logged(spark, text), 0.50).collect()] == [10 * S]


def test_probe(spark):
    doc = {"streams": [{"codec_type": "audio", "codec_name": "ac3", "sample_rate": "48000", "channels": 6}, {"codec_type": "video", "codec_name": "h264", "width": 1280, "height": 720, "avg_frame_rate": "0/0", "r_frame_rate": "30000/1001", "duration": "12.5"}], "format": {"duration": "0"}}
    got = documents.parse_probe(spark.createDataFrame([(1, json.dumps(doc)), (2, "{}"), (3, "no json")], "id long, json string")).orderBy("id").collect()
    assert (got[0]["duration_us"], got[0]["width"], got[0]["audio_channels"], got[0]["audio_sample_rate"]) == (12_500_000, 1280, 6, 48000)
    assert got[0]["frame_rate"] == 30000 / 1001
    assert all((r["duration_us"], r["frame_rate"], r["video_codec"]) == (0, 0.0, "") for r in got[1:])


def test_guide(spark):
    doc = json.dumps({"Items": [{"Id": "a", "Path": "D:\\TV\\Show.TS", "EndDate": "2024-01-01T01:00:00Z"}, {"Id": "b", "Path": "/x/show.ts", "PostPaddingSeconds": 60}]})
    epg = documents.parse_epg(spark.createDataFrame([(doc,)], "json string"))
    got = documents.match_epg(spark.createDataFrame([(1, "/rec/SHOW.ts"), (2, "/rec/none.ts")], "rec_id long, path string"), epg).orderBy("rec_id").collect()
    assert [r["id"] for r in got] == ["a", None]
    pad = lambda s: spark.range(1).select(documents.post_padding(F.lit(0), F.timestamp_seconds(F.lit(s)), F.timestamp_seconds(F.lit(0))).alias("v")).first()["v"]
    assert pad(1800) == 0 and pad(1799) == 1799 and pad(-5) == 0


def test_programme_match(spark):
    r = spark.createDataFrame([(1, 0)], "rec_id long, rec_start_us long")
    listed = lambda start: documents.match_programme(r, spark.createDataFrame([(1, 0, start * S, 3600 * S)], "rec_id long, ord long, prog_start_us long, prog_len_us long")).first()["listing"]
    assert listed(299) == 0 and listed(301) is None


def test_skips(spark):
    us = lambda m: F.lit(m * 60 * S).cast("long")
    a, b = documents.programme_skips(us(0), us(2), us(60), us(65))
    c, d = documents.elapsed_skips(us(2), us(60), us(65))
    assert tuple(spark.range(1).select(a, b, c, d).first()) == (120.0, 180.0, 120.0, 180.0)


def test_ini(spark):
    text = "top=1\n# c\n[s]\na=1 ; x\nb=\"q;r\"\nempty=\n=none\nno pair\n; c\n[S]\nA = 2 # y\nc = #tag\nd='it'\n"
    got = {(r["section"].lower(), r["key"].lower()): r["value"] for r in settings.parse_ini(spark.createDataFrame([("f", text)], "file string, text string")).collect()}
    assert got == {("general", "top"): "1", ("s", "a"): "2", ("s", "b"): "q;r", ("s", "empty"): "", ("s", "c"): "#tag", ("s", "d"): "'it'"}
    values = {"a": ('"q;r" ; note', "q;r"), "b": ("'x' ; c", "'x'"), "c": ('"p" q "z"', "p"), "d": ('"open', '"open'), "e": ("; all", "; all"), "f": ("a # b ; c", "a # b"), "g": ('x "y"', 'x "y"')}
    text = "".join(f"{k} = {v}\n" for k, (v, _) in values.items())
    got = {r["key"]: r["value"] for r in settings.parse_ini(spark.createDataFrame([("f", text)], "file string, text string")).collect()}
    assert got == {k: want for k, (_, want) in values.items()}


def test_ini_keeps_comments(spark):
    texts = spark.createDataFrame([("f", "# shipped\n;; by hand\nx=1 ; one\n# later\n[S]\na=2 # two\nb=\"q\"\n")], "file string, text string")
    kv, head = settings.parse_ini(texts), settings.header_comments(texts)
    assert settings.render_ini(kv, head).first()["text"] == "# shipped\n# by hand\n\n[General]\nx=1  ; one\n\n[S]\na=2  ; two\nb=q\n"


def test_every_setting_has_its_default(spark):
    from spotseam.sources.settings import KEYS, PRESETS

    none = settings.with_defaults(spark.range(1)).first()
    assert none["logo_cluster_max_gap"] == 35.0 and none["logo_cluster_min_duration"] == 30.0 and none["logo_cluster_min_events"] == 5
    assert none["bf_use_clustering"] is False and none["output_formats"] == ["Edl"] and len(KEYS) == 45
    assert all(none[k] is not None for k, *_ in KEYS)
    fast = settings.with_defaults(spark.range(1), "fast").first()
    assert {k: fast[k] for k in PRESETS["fast"]} == PRESETS["fast"]
    text = "[Output]\nformats = edl, comskip_txt, nothing, FFMETADATA\n[Logo]\nenabled=no\ncluster_min_events=x\n"
    own = settings.with_defaults(settings.params_of(settings.parse_ini(spark.createDataFrame([("f", text)], "file string, text string")))).first()
    assert own["output_formats"] == ["Edl", "ComskipTxt", "FFMetadata"] and own["logo_enabled"] is False and own["logo_cluster_min_events"] == 5


def test_skips_by_source_and_switch(spark):
    r = spark.createDataFrame([(i, i != 3, i != 4) for i in range(1, 6)], "rec_id long, psip boolean, xds boolean")
    told = [(1, "psip", 1.0, 2.0), (1, "xds", 3.0, 4.0), (2, "xds", 3.0, 4.0), (3, "psip", 1.0, 2.0), (3, "xds", 3.0, 4.0), (4, "xds", 3.0, 4.0), (5, "epg", 50.0, 5.0)]
    b = spark.createDataFrame(told, "rec_id long, source string, skip_start_s double, skip_end_s double")
    got = {x["rec_id"]: (x["skip_start_s"], x["skip_end_s"]) for x in documents.effective_skips(r, b, 30, F.lit(45), F.col("psip"), F.col("xds")).collect()}
    assert got == {1: (1.0, 2.0), 2: (3.0, 4.0), 3: (3.0, 4.0), 4: (30.0, 45.0), 5: (50.0, 45.0)}


def test_ini_round_trip_and_json(spark):
    kv = settings.parse_ini(spark.createDataFrame([("f", "[Detection]\ncommercial_threshold=0.45\n[Output]\nformats=edl, json\n")], "file string, text string"))
    again = settings.parse_ini(settings.render_ini(kv).select("file", "text"))
    assert sorted((r["section"], r["key"], r["value"]) for r in kv.collect()) == sorted((r["section"], r["key"], r["value"]) for r in again.collect())
    assert settings.params_of(kv).first()["threshold"] == 0.45
    doc = settings.params_json(spark.createDataFrame([(0.5, 3)], "commercial_threshold double, smoothing_radius int"))
    assert json.loads(doc.first()["json"]) == {"commercialThreshold": 0.5, "smoothingRadius": 3}
    back = settings.params_from_json(doc, "commercial_threshold double, smoothing_radius int, skip_start double").first()
    assert tuple(back) == (0.5, 3, None)


def packet(pid, payload, fresh=True, fill=0xFF):
    return bytes([0x47, (0x40 if fresh else 0) | pid >> 8, pid & 0xFF, 0x10]) + payload.ljust(184, bytes([fill]))[:184]


def psip_stream():
    gps = 1_388_000_000
    stt = bytes([0xCD, 0xB0, 0x11, 0]) + gps.to_bytes(4, "big") + bytes([18]) + bytes(11)
    title = b"News Hour "
    event = b"\0\1" + (gps + 120).to_bytes(4, "big") + (0x300000 + 3600).to_bytes(3, "big") + bytes([8 + len(title)]) + b"\1eng\1\0\0" + bytes([len(title)]) + title + b"\0\0"
    late = b"\0\2" + (gps + 9000).to_bytes(4, "big") + (600).to_bytes(3, "big") + b"\0\0\0"
    body = bytes(6) + bytes([2]) + late + event + bytes(4)
    eit = bytes([0xCB, 0xF0 | len(body) >> 8, len(body) & 0xFF]) + body
    return gps, b"\0" + stt, eit


def test_psip():
    gps, stt, eit = psip_stream()
    split = [packet(0x1FFB, stt), packet(0x1FFB, b"\0" + eit[:20] + b"")[:4] + (b"\0" + eit).ljust(184, b"\xff")]
    want = (gps - 18 + broadcast.GPS_EPOCH, gps + 120 - 18 + broadcast.GPS_EPOCH, 3600, "News Hour")
    assert broadcast.read_psip(b"junk" + split[0] + packet(5, b"x") + split[1]) == want
    assert broadcast.read_psip(split[0])[1:] == (None, None, None)
    assert broadcast.read_psip(split[1] + split[0])[1] is None  # a listing before the time can't be placed
    assert broadcast.read_psip(b"") == (None, None, None, None)


def test_psip_first_time_table_counts():
    gps, stt, eit = psip_stream()
    late = stt[:5] + (gps + 5000).to_bytes(4, "big") + stt[9:]
    assert broadcast.read_psip(packet(0x1FFB, stt) + packet(0x1FFB, late) + packet(0x1FFB, b"\0" + eit))[0] == gps - 18 + broadcast.GPS_EPOCH
    assert broadcast.read_psip(packet(0x1FFB, late) + packet(0x1FFB, stt) + packet(0x1FFB, b"\0" + eit))[1] is None  # the listing has ended 1,280 s before the first


def test_psip_section_over_two_packets():
    gps, stt, eit = psip_stream()
    long = eit[:3] + eit[3:]
    pad = bytes(180)
    first = packet(0x1FFB, b"\0" + stt[1:] + b"\xff")
    big = bytes([0xCC, 0xF0, len(pad)]) + pad  # another table before the listing pushes it over the end
    data = first + packet(0x1FFB, b"\0" + big + long[:0]) + packet(0x1FFB, bytes([len(long)]) + long)
    assert broadcast.read_psip(data)[3] == "News Hour"


def xds_stream(pairs):
    pat = b"\0" + bytes.fromhex("00B00D0001C100000001E10000000000")
    pmt = b"\0" + bytes.fromhex("02B0170001C10000E101F00003E102F0001BE101F00000000000")
    cc = b"".join(bytes([0x04, a | 0x80, b]) for a, b in pairs)
    video = b"\0\0\1\xe0\0\0\x80\0\0" + b"\0\0\1\xb2GA94\3" + bytes([0x40 | len(pairs), 0xFF]) + cc
    return packet(0, pat) + packet(0x100, pmt) + packet(0x101, video, fill=0)


def test_xds():
    name = [(1, 3), (ord("A"), ord("b")), (ord("c"), 0), (0x0F, 0)]
    length = [(1, 2), (0x21, 0x3E), (0x20, 0x25), (0x0F, 0)]
    assert broadcast.read_xds(xds_stream(name + length)) == ("Abc", 90, 5)
    assert broadcast.read_xds(xds_stream([(1, 2), (0x21, 0x3E), (0x14, 0x20), (0x0F, 0)])) == (None, None, 0)  # broken off
    assert broadcast.read_xds(xds_stream([(3, 2), (0x21, 0x3E), (0x0F, 0)])) == (None, None, 0)  # another class
    assert broadcast.read_xds(b"x" * 500) == (None, None, 0)


def test_scanners_over_columns(spark):
    df = spark.createDataFrame([(1, bytearray(xds_stream([(1, 2), (0x21, 0x3E), (0x0F, 0)]))), (2, None)], "rec_id long, content binary")
    assert sorted((r["rec_id"], r["prog_len_s"]) for r in broadcast.xds(df).collect()) == [(1, 5400), (2, None)]
    assert broadcast.psip(df).filter("prog_start is null").count() == 2


def test_files(spark, tmp_path):
    for name, size in (("A.ts", 20), ("b.partial.ts", 20), ("c.txt", 20), ("sub/d.MKV", 5)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * size)
    got = files.candidates(files.listing(spark, str(tmp_path)), ["*.partial.*"], 10).collect()
    assert [r["path"].rpartition("/")[2] for r in got] == ["A.ts"]
    names = spark.createDataFrame([("/e/Show_20260101_000000.edl",), ("/e/Show_20260102_000000.edl",), ("/e/_20260102_000000.edl",)], "path string")
    assert [tuple(r) for r in report.latest_runs(files.archive_entries(names)).collect()] == [("Show", "20260102_000000", "/e/Show_20260102_000000.edl")]


def test_extensions():
    assert files.MEDIA == (".ts", ".mpg", ".mpeg", ".mp4", ".mkv", ".avi", ".wtv", ".m4v", ".mov")
    assert files.WATCHED == (".ts", ".mpg", ".mpeg", ".mp4", ".mkv") and len(files.BATCH) == 8
    assert watch.SERVER["extensions"] == (".ts", ".mpg", ".mpeg", ".mp4", ".mkv", ".wtv", ".m4v")


def test_alongside_lists_and_marks(spark, tmp_path):
    names = spark.createDataFrame([("/v/Show One.edl",), ("/v/Show One.ts",), ("/v/x.EDL",)], "path string")
    assert [tuple(r) for r in files.alongside_entries(names).collect()] == [("/v/Show One.edl", "Show One", None)]
    (tmp_path / "a.txt").write_text("FILE PROCESSING COMPLETE  a.ts\r\n1\t2\n")
    (tmp_path / "b.txt").write_text("")
    got = {r["path"].rpartition("/")[2]: r["first_line"] for r in files.first_lines(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "FILE PROCESSING COMPLETE  a.ts"}
    f = spark.createDataFrame([("/r/a.ts",), ("/r/b.ts",)], "path string")
    outs = spark.createDataFrame([("/r/a.txt", "FILE PROCESSING COMPLETE  a.ts"), ("/r/b.txt", "notes")], "path string, first_line string")
    left = lambda formats: [r["path"] for r in files.unprocessed(f, outs, formats).collect()]
    assert left(["Edl"]) == ["/r/b.ts"] and left(["ComskipTxt"]) == []


def test_backfill(spark, tmp_path):
    rows = [("/w/a.ts", 20 << 20), ("/w/b.ts", 20 << 20), ("/w/c.ts", 1), ("/w/d.m4v", 20 << 20)]
    listed = spark.createDataFrame([(p, n, T0) for p, n in rows], "path string, length long, modified timestamp")
    outs = spark.createDataFrame([("/w/b.edl", None)], "path string, first_line string")
    found = watch.backfill(listed, outs)
    assert [r["path"] for r in found.collect()] == ["/w/a.ts"]
    for _ in range(2):
        watch.process_batch(found, lambda b: b.select("path", F.lit(True).alias("ok")), str(tmp_path / "ledger"))
    assert spark.read.parquet(str(tmp_path / "ledger")).count() == 1


def segments_of(spark):
    rows = [(1, 0, 10_500_000, "Program", 0.1, 0, 1, 0, 1), (1, 10_500_000, 75_200_000, "Commercial", 0.12345, 1, 2, 1, 1), (1, 75_200_000, 3_600_000_000, "Program", 0.2, 2, 3, 2, 2)]
    return spark.createDataFrame(rows, "rec_id long, start_us long, end_us long, type string, confidence double, start_frame long, end_frame long, seg_no long, type_no long")


def recordings_of(spark):
    return spark.createDataFrame([(1, "/r/My Show.ts", 3_600_000_000, 0.0, 1280, 720), (2, "/r/None.ts", 0, 25.0, 0, 0)], "rec_id long, path string, duration_us long, frame_rate double, width int, height int")


def text(df, rec=1):
    return {r["rec_id"]: r["text"] for r in df.collect()}[rec]


def test_renderers(spark):
    s, r = segments_of(spark), recordings_of(spark)
    assert text(render.edl(s, r)) == "10.500 75.200 3\n" and text(render.edl(s, r), 2) == ""
    assert text(render.comskip(s, r)) == "FILE PROCESSING COMPLETE  My Show.ts\n314\t2253\n"
    assert text(render.ffmetadata(s, r)).startswith(";FFMETADATA1\n[CHAPTER]\nTIMEBASE=1/1000\nSTART=0\nEND=10500\ntitle=Part 1\n")
    xml = text(render.mkv_chapters(s, r))
    assert xml.count("<ChapterAtom>") == 3 and xml.count("ChapterFlagHidden>1") == 1 and "<ChapterTimeEnd>01:00:00.000000000<" in xml
    doc = json.loads(text(render.json_result(s, r)))
    assert doc["segments"][1]["confidence"] == 0.1234 and doc["totalDuration"] == "01:00:00" and doc["resolution"] == "1280x720"
    assert json.loads(text(render.json_result(s, r), 2))["segments"] == []
    timed = r.withColumns({"started_at": F.to_timestamp(F.lit("2024-01-01 10:00:00")), "completed_at": F.to_timestamp(F.lit("2024-01-01 10:01:02.5"))})
    doc = json.loads(text(render.json_result(s, timed)))
    assert (doc["analysisStarted"], doc["analysisDuration"]) == ("2024-01-01T10:00:00.000000Z", "00:01:02.5000000")
    both = render.render(s, r, ["Edl", "Json"]).collect()
    assert sorted(x["path"] for x in both if x["rec_id"] == 1) == ["/r/My Show.breaks.json", "/r/My Show.edl"]


def test_written_files(spark, tmp_path):
    out = render.write_rendered(render.render(segments_of(spark), recordings_of(spark), ["Edl"]), f"file://{tmp_path}/out")
    assert {r["name"]: r["bytes"] for r in out.collect()} == {"1-My Show.edl": 16, "2-None.edl": 0}
    assert (tmp_path / "out/1-My Show.edl").read_text() == "10.500 75.200 3\n"


def test_cut_plan(spark):
    s, r = segments_of(spark), recordings_of(spark)
    plain = cutplan.segment_plan(s, r, cutplan.CutParams()).orderBy("seg").collect()
    assert plain[1]["args"] == '-hide_banner -loglevel warning -y -ss 00:01:15.200 -i "/r/My Show.ts" -t 00:58:44.800 -c copy -avoid_negative_ts make_zero "/tmp/My Show_seg001.ts"'
    p = cutplan.CutParams(mode="Cut", method="Reencode", video_codec="libx264", video_preset="fast", crf=20, hw_accel="Vaapi", audio_codec="aac", normalize=True, deinterlace="Auto", container="Mp4")
    args = cutplan.graph_plan(s, r, p, queries.TODAY).first()
    assert args["out_path"] == "/r/My Show.cut.mp4" and "[v0][a0][v1][a1]concat=n=2:v=1:a=1[outv][outa];[outv]bwdif=mode=send_field" in args["args"]
    assert args["args"].startswith("-hide_banner -vaapi_device /dev/dri/renderD128 -loglevel") and "-c:v h264_vaapi -preset fast -crf 20 -c:a aac -af loudnorm=I=-24" in args["args"]
    same = cutplan.CutParams(name_pattern="{name}.{ext}")
    assert r.select(cutplan.output_path(F.col("path"), same, queries.TODAY).alias("v")).first()["v"] == "/r/My Show.cut.ts"


def test_reports(spark):
    edl = spark.createDataFrame([('a"b', 65.2, 3725.9), ('a"b', 1.0, 2.0)], "show string, start_s double, end_s double")
    shows = spark.createDataFrame([('a"b',), ("none",)], "show string")
    assert sorted(r["line"] for r in report.shows_report(shows, edl).collect()) == ['"a""b",2,,', '"none",0,,']
    lines = [r["line"] for r in report.breaks_report(edl).orderBy("break_no").collect()]
    assert lines == ['"a""b",1,0:01,0:02,,,', '"a""b",2,1:05,1:02:05,,,']
    assert all(len(line.split(",")) == len(report.BREAKS_HEADER.split(",")) for line in lines)
    names = spark.createDataFrame([("S S01E10",), ("S S01E08",), ("S S01E09",), ("a film",)], "name string")
    assert [r["name"] for r in report.by_episode(names, F.col("name")).collect()] == ["S S01E08", "S S01E09", "S S01E10", "a film"]


def test_all_parts_are_sorted_and_numbered(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{sf}/part.parquet')")
    got = sorted(map(tuple, queries.QUERIES["episode_sort"](spark, sf).collect()))
    assert len(got) == con.execute("SELECT count(*) FROM part").fetchone()[0]
    assert got == sorted(con.execute(queries.SQL["episode_sort"]).fetchall())
    rows = spark.createDataFrame([("b", 2), ("a", 1), (None, 3), ("a", 1), ("c", None)] * 300, "k string, n int")
    placed = report.numbered(rows, "k", "n", parts=4).orderBy("pos").collect()
    assert [r["pos"] for r in placed] == list(range(1, 1501))
    assert [(r["k"], r["n"]) for r in placed] == [(None, 3)] * 300 + [("a", 1)] * 600 + [("b", 2)] * 300 + [("c", None)] * 300
    assert report.numbered(rows.limit(0), "k", "n").count() == 0


T0 = dt.datetime(2024, 1, 1)


def event(path, seconds, kind="changed", old=None, size=100):
    return (path, kind, old, T0 + dt.timedelta(seconds=seconds), size)


def test_stable_files_stream(spark, tmp_path):
    rounds = [
        [event("/w/a.ts", 0), event("/w/b.ts", 0), event("/w/c.txt", 0), event("/w/small.ts", 0, size=1)],
        [event("/w/a.ts", 20), event("/w/d.ts", 21, "renamed", "/w/b.ts")],
        [event("/w/x.ts", 49)],
        [event("/w/y.ts", 500)],
        [event("/w/a.ts", 501), event("/w/z.ts", 2000)],
        [event("/w/z.ts", 4000)],
    ]
    src = tmp_path / "in"
    src.mkdir()
    stream = spark.readStream.schema(watch.EVENTS).parquet(str(src))
    out = watch.stable_files(stream, 30, 10)
    q = None
    try:
        for i, rows in enumerate(rounds):
            spark.createDataFrame(rows, watch.EVENTS).coalesce(1).write.parquet(str(tmp_path / f"p{i}"))
            part = next((tmp_path / f"p{i}").glob("part-*"))
            part.rename(src / f"{i}.parquet")
            q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
            q.awaitTermination(120)
            q.stop()
    finally:
        if q is not None:
            q.stop()
    got = {r["path"]: (r["ready_at"] - T0).total_seconds() for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got["/w/a.ts"] == 50 and got["/w/d.ts"] == 51 and got["/w/x.ts"] == 79
    assert "/w/b.ts" not in got and "/w/c.txt" not in got and "/w/small.ts" not in got


def test_stable_batch(spark):
    log = spark.createDataFrame([event("/w/a.ts", 0), event("/w/a.ts", 20), event("/w/a.ts", 50), event("/w/b.ts", 90)], watch.EVENTS)
    got = watch.stable_batch(log, 30, F.lit(T0 + dt.timedelta(seconds=100))).collect()
    assert [(r["path"], (r["ready_at"] - T0).total_seconds()) for r in got] == [("/w/a.ts", 50)]


def test_ledger_counts_a_file_once(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("/w/a.ts",), ("/w/a.ts",), ("/w/b.ts",)], "path string").write.parquet(str(src))
    seen = []

    def process(batch):
        seen.append(batch.count())
        return batch.select("path", F.lit(True).alias("ok"))

    for i in range(2):
        q = watch.process_new(spark.readStream.schema("path string").parquet(str(src)), process, str(tmp_path / "ledger"), str(tmp_path / f"cp{i}"))
        q.awaitTermination(120)
        q.stop()
    assert seen == [2, 0] and spark.read.parquet(str(tmp_path / "ledger")).count() == 2


@pytest.mark.parametrize("name", ["flagship_breaks", "psip_scan", "xds_scan"])
def test_queries_have_rows(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.SQL)
