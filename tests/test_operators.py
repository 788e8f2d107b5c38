"""Operators on rows made by hand, their edges included, and against small models in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from spotseam.functions import scalars as x
from spotseam.operators import intervals, score, segments
from spotseam.plans import detect
from spotseam.sources import settings

S = 1_000_000
EVENTS, SPANS = "rec_id long, signal string, t_us long", "rec_id long, signal string, start_us long, end_us long"
SEGMENTS = "rec_id long, start_us long, end_us long, type string, confidence double, start_frame long, end_frame long"


def points(spark, *seconds, signal="BlackFrame"):
    return spark.createDataFrame([(1, signal, round(s * S)) for s in seconds], EVENTS)


def spans(spark, *pairs):
    return spark.createDataFrame([(1, "B", round(a * S), round(b * S)) for a, b in pairs], SPANS)


def pairs(df):
    return sorted((r["start_us"] / S, r["end_us"] / S) for r in df.collect())


def test_cluster_golden(spark):
    e = points(spark, 398, 596, 954, 1147, 1152, 1492, 1620, 1725, 2065, 2192, 2283, 2907)
    assert pairs(intervals.cluster(e, 200 * S, 60 * S, 2)) == [(398, 596), (954, 1152), (1492, 1725), (2065, 2283)]


def test_cluster_gap_is_inclusive_and_limits_may_be_columns(spark):
    e = points(spark, 0, 35)
    assert pairs(intervals.cluster(e, 35 * S, 30 * S, 2)) == [(0, 35)]
    assert pairs(intervals.cluster(e, 34 * S, 0, 2)) == []
    own = e.withColumns({"gap": F.lit(35 * S), "least": F.lit(2)})
    assert pairs(intervals.cluster(own, F.col("gap"), 35 * S, F.col("least"))) == [(0, 35)]
    assert intervals.cluster(e.limit(0), 1, 1, 1).count() == 0


def test_rescue(spark):
    assert pairs(intervals.rescue(spans(spark, (500, 502)), 180 * S, S)) == [(500, 502)]
    assert pairs(intervals.rescue(spans(spark, (0, 2), (180, 182), (400, 402)), 180 * S, S)) == [(400, 402)]
    assert pairs(intervals.rescue(spans(spark, (0, 0.5)), 180 * S, S)) == []


def test_overlap_windows_golden(spark):
    for pair, want in (((2, 2), []), ((3, 3), [1]), ((4, 9), [2]), ((5, 6), [])):
        got = intervals.overlap_windows(spans(spark, pair), 2 * S, 5 * S)
        assert sorted(r["i"] for r in got.collect()) == want


def test_overlap_windows_equal_the_nested_loop(spark):
    rng = random.Random(1)
    made = [(a, a + rng.choice([0, 1, 3, 10])) for a in (rng.randint(0, 60) for _ in range(200))]
    rows = [(i, "B", a * S // 2, b * S // 2) for i, (a, b) in enumerate(made)]
    got = {(r["rec_id"], r["i"]) for r in intervals.overlap_windows(spark.createDataFrame(rows, SPANS), 2 * S, 25 * S).collect()}
    cells = [(i * 2 * S, min((i + 1) * 2, 25) * S) for i in range(13)]
    assert got == {(k, i) for k, _, a, b in rows for i, (s, e) in enumerate(cells) if a < e and b > s}


def test_grid_ends_at_the_duration(spark):
    r = spark.createDataFrame([(1, 5 * S), (2, 0)], "rec_id long, duration_us long")
    assert pairs(intervals.grid(r, 2 * S)) == [(0, 2), (2, 4), (4, 5)]


def settled(spark, rows, **own):
    """Recordings (rec_id, seconds) with the default settings but for ``own``."""
    r = spark.createDataFrame([(i, round(s * S), 30.0) for i, s in rows], "rec_id long, duration_us long, frame_rate double")
    return settings.with_defaults(r).withColumns({k: F.lit(v) for k, v in own.items()})


def scored(spark, segs, r, active=((1, "top-left"),)):
    active = spark.createDataFrame(list(active), "rec_id long, source string")
    return detect.weighted(detect.hit_windows(segs, r), detect.with_corners(r, active)).orderBy("i").collect()


def test_weights_count_signals_that_found_nothing(spark):
    r = settled(spark, [(1, 2)], window_size=2.0, bf_weight=0.60, sc_weight=0.05, silence_weight=0.15, logo_enabled=False)
    found = spark.createDataFrame([(1, "Silence", 0, S)], SPANS)
    assert [round(w["p"], 9) for w in scored(spark, found, r)] == [0.1875]
    none = settled(spark, [(1, 2)], bf_weight=0.0, sc_weight=0.0, silence_weight=0.0, logo_weight=0.0)
    assert [w["p"] for w in scored(spark, found, none)] == [0.0, 0.0]


def test_logo_that_is_nearly_always_away_does_not_count(spark):
    r = settled(spark, [(1, 100), (2, 100), (3, 100)])
    found = spark.createDataFrame([(1, "LogoAbsence", 0, 85 * S), (2, "LogoAbsence", 0, 84 * S), (3, "LogoAbsence", 0, 10 * S)], SPANS)
    active = spark.createDataFrame([(1, "top-left"), (2, "top-left")], "rec_id long, source string")
    got = {(w["rec_id"], w["signal"]) for w in detect.present_signals(found, r, active).collect()}
    assert (1, "LogoAbsence") not in got and (2, "LogoAbsence") in got and (3, "LogoAbsence") not in got  # nearly always, a share, no corner left
    assert (1, "Letterbox") not in got and (1, "BlackFrame") in got
    rows = detect.weighted(detect.hit_windows(found, r), detect.with_corners(r, active)).filter("i = 0").collect()
    assert {w["rec_id"]: round(w["p"], 9) for w in rows} == {1: 0.0, 2: 0.25, 3: 0.0}
    off = detect.present_signals(found, r.withColumn("logo_weight", F.lit(0.0)), active)
    assert off.filter("signal = 'LogoAbsence'").isEmpty()


def test_inverted_signal(spark):
    r = settled(spark, [(1, 6)], window_size=2.0, sc_weight=0.5, bf_weight=0.5, silence_weight=0.0, logo_enabled=False, sc_invert=True)
    found = spark.createDataFrame([(1, "SceneChange", 0, S)], SPANS)
    assert [w["p"] for w in scored(spark, found, r)] == [0.0, 0.5, 0.5]


def test_black_path_by_recording(spark):
    """As they are; clusters of long enough ones; a lone one where one event is enough."""
    r = settled(spark, [(1, 3600), (2, 3600), (3, 3600)], bf_min_count=30, bf_cluster_max_gap=180.0, bf_cluster_min_duration=2.0)
    r = r.withColumns({"bf_use_clustering": F.col("rec_id") > 1, "bf_cluster_min_events": F.when(F.col("rec_id") == 3, 1).otherwise(2)})
    made = [(0, 1), (100, 100.5), (200, 201), (350, 351), (900, 903)]
    spans = spark.createDataFrame([(k, "BlackFrame", round(a * S), round(b * S)) for k in (1, 2, 3) for a, b in made], SPANS)
    got = {k: sorted((x["start_us"] / S, x["end_us"] / S) for x in detect.black_segments(spans, r).collect() if x["rec_id"] == k) for k in (1, 2, 3)}
    assert got[1] == made
    assert got[2] == [(200, 350)]  # the short one at 100 doesn't bridge 0 and 200
    assert got[3] == [(200, 350), (900, 903)]


def test_scene_changes_take_the_logo_settings(spark):
    r = settled(spark, [(1, 3600)])
    cuts = spark.createDataFrame([(1, t * S) for t in (0, 10, 20, 30, 40, 500, 535, 570, 605)], "rec_id long, t_us long")
    assert pairs(detect.scene_segments(cuts, r)) == [(0, 40)]  # 35/30/5: the second run has four events


def test_corner_path(spark):
    """Rates in the learning window, tickers and noise out, probes where there is a reference, votes."""
    r = settled(spark, [(1, 1000)], logo_learn_duration=100.0, skip_start=50.0, logo_ticker_threshold=0.5, logo_cluster_min_events=2, logo_cluster_min_duration=1.0)
    changes = [("top-left", t) for t in (60, 70, 300, 303)] + [("top-right", t) for t in (61, 80, 400)] + [("bottom-left", t) for t in range(50, 110)] + [("bottom-right", t) for t in range(60, 70)] + [("top-band", 55)] + [("top-left", 10), ("top-left", 150)]
    corners = spark.createDataFrame([(1, c, t * S) for c, t in changes], "rec_id long, source string, t_us long")
    probes = spark.createDataFrame([(1, "top-right", 300 * S), (1, "top-right", 305 * S), (1, "top-left", 800 * S)], "rec_id long, source string, t_us long")
    refs = spark.createDataFrame([(1, "top-right")], "rec_id long, source string")
    none = spark.createDataFrame([], SPANS)
    found = detect.Found(none, corners.select("rec_id", "t_us").limit(0), corners, probes, refs)
    rates = {x["source"]: x["rate"] for x in detect.activity(corners, r).collect()}
    assert rates == {"top-left": 0.02, "top-right": 0.02, "bottom-left": 0.6, "bottom-right": 0.1, "top-band": 0.01, "bottom-band": 0.0}
    active = detect.active_corners(detect.activity(corners, r), r)
    assert {x["source"] for x in active.collect()} == {"top-left", "top-right"}
    # 300 and 303 changed at the top left, 300 and 305 probed at the top right; 305 has no second vote, nor have the others.
    assert sorted(x["t_us"] // S for x in detect.logo_events(found, active, r).collect()) == [300, 300, 303]
    segs, _ = detect.found_segments(found, r)
    assert pairs(segs) == [(300, 303)]
    assert intervals.band_warnings(spark.createDataFrame([(1, "top-band", 1.6), (1, "bottom-band", 1.5), (1, "top-left", 9.0)], "rec_id long, source string, rate double")).count() == 1


def test_profiles_in_one_plan_equal_each_alone(spark, sf):
    from spotseam.plans import views

    r, found = views.settled_recordings(spark, sf), views.found(spark, sf)
    rows = lambda df: sorted(map(tuple, df.select("rec_id", "start_us", "end_us", "type").collect()))
    every = rows(detect.detect_breaks(found, r))
    alone = [x for n in range(4) for x in rows(detect.detect_breaks(found, r.filter(F.col("rec_id") % 4 == n)))]
    assert every == sorted(alone) and len({x[3] for x in every}) == 2


def test_smoothing_by_column_equals_each_radius(spark):
    rng = random.Random(3)
    rows = [(k, i, i * S, (i + 1) * S, rng.random(), k) for k in (0, 1, 3, 7, 50) for i in range(40)]
    w = spark.createDataFrame(rows, "rec_id long, i long, start_us long, end_us long, p double, r int")
    got = {(x["rec_id"], x["i"]): x["p"] for x in score.smooth(w, F.col("r")).collect()}
    for k in (0, 1, 3, 7, 50):
        p = [x[4] for x in rows if x[0] == k]
        for i in range(40):
            part = p[max(0, i - k) : i + k + 1]
            assert got[k, i] == pytest.approx(sum(part) / len(part))


def windows(spark, ps):
    return spark.createDataFrame([(1, i, i * S, (i + 1) * S, float(v)) for i, v in enumerate(ps)], "rec_id long, i long, start_us long, end_us long, p double")


def test_smoothing_and_threshold(spark):
    got = [r["p"] for r in score.smooth(windows(spark, [0, 1, 0]), 1).orderBy("i").collect()]
    assert got == pytest.approx([0.5, 1 / 3, 0.5])
    assert [r["p"] for r in score.smooth(windows(spark, [0, 1, 0]), 0).orderBy("i").collect()] == [0, 1, 0]
    got = score.classify(windows(spark, [0.38, 0.379999]), 0.38).orderBy("i").collect()
    assert [r["classification"] for r in got] == ["Commercial", "Program"]


def segs(spark, *rows):
    return spark.createDataFrame([(1, round(a * S), round(b * S), {"C": "Commercial", "P": "Program"}[t], c, int(a * 30), int(b * 30)) for t, a, b, c in rows], SEGMENTS)


def shown(df):
    return [(r["type"][0], r["start_us"] / S, r["end_us"] / S, round(r["confidence"], 9), r["end_frame"]) for r in df.orderBy("start_us").collect()]


def test_islands(spark):
    w = score.classify(windows(spark, [0, 0.9, 0.7, 0]), 0.5)
    got = segments.with_frames(segments.islands(w), 30000 / 1001).orderBy("start_us").collect()
    assert [(r["type"], r["start_us"], r["confidence"], r["end_frame"]) for r in got] == [("Program", 0, 0.0, 29), ("Commercial", S, 0.8, 89), ("Program", 3 * S, 0.0, 119)]


def test_skips(spark):
    s = segs(spark, ("C", 80, 200, 0.5))
    assert shown(segments.strip_start(s, 90))[0][0] == "P" and shown(segments.strip_start(s, 80))[0][0] == "C"
    assert shown(segments.strip_start(s, 0))[0][0] == "C"
    s = segs(spark, ("P", 0, 70, 0.1), ("C", 70, 90, 0.5), ("P", 90, 100, 0.1))
    assert shown(segments.strip_end(s, 20, 100 * S))[1] == ("C", 70.0, 80.0, 0.5, 2700)
    assert shown(segments.strip_end(segs(spark, ("C", 85, 90, 0.5)), 20, 100 * S)) == [("P", 85.0, 90.0, 0.5, 2700)]


def test_gap_merge_and_confidence_fold(spark):
    s = segs(spark, ("P", 0, 10, 0.1), ("C", 10, 40, 0.8), ("P", 40, 90, 0.2), ("C", 90, 120, 0.6))
    assert shown(segments.bridge_gaps(s, 50)) == [("P", 0.0, 10.0, 0.1, 300), ("C", 10.0, 120.0, 0.7, 3600)]
    assert len(shown(segments.bridge_gaps(s, 49.9))) == 4 and len(shown(segments.bridge_gaps(s, 0))) == 4
    chain = segs(spark, ("C", 0, 1, 0.8), ("P", 1, 2, 0.1), ("C", 2, 3, 0.4), ("P", 3, 4, 0.1), ("C", 4, 5, 0.6))
    assert shown(segments.bridge_gaps(chain, 1)) == [("C", 0.0, 5.0, 0.6, 150)]


def test_merged_confidences_round_as_the_sql_does(spark):
    import duckdb

    from spotseam import queries

    ties = [0.2513835, 0.5027495, 0.13998649999999999, 0.40359849999999997, 0.8071294999999999, 0.4296875, 0.0, 1.0]
    made = spark.createDataFrame([(n, 0, 10 * S, "Commercial", c, 0, 300) for n, c in enumerate(ties)], SEGMENTS)
    got = [r["confidence"] for r in queries._shown(segments.bridge_gaps(made, 20)).orderBy("rec_id").collect()]
    assert got == [duckdb.execute(f"SELECT round({c!r}::DOUBLE, 6)").fetchone()[0] for c in ties]
    assert got[:3] == [0.251383, 0.502749, 0.139987]
    odd = spark.createDataFrame([(0, -0.5), (1, -2.4), (2, 1e300), (3, float("inf")), (4, None)], "n int, v double")
    assert [r["v"] for r in odd.withColumn("v", x.rounded(F.col("v"), 0)).orderBy("n").collect()] == [-1.0, -2.0, 1e300, float("inf"), None]


def plain_rewrite(rows, gap, lo, hi):
    """Repeated merging, as one would by hand."""
    rows = [list(r) for r in rows]
    again = gap > 0
    while again:
        again = False
        for i in range(1, len(rows) - 1):
            a, g, b = rows[i - 1 : i + 2]
            if a[0] == b[0] == "C" and g[0] == "P" and g[2] - g[1] <= gap:
                rows[i - 1 : i + 2] = [["C", a[1], b[2], (a[3] + b[3]) / 2]]
                again = True
                break
    out = []
    for t, a, b, c in rows:
        t = "P" if t == "C" and not lo <= b - a <= hi else t
        if out and out[-1][0] == t:
            out[-1] = [t, out[-1][1], b, (out[-1][3] + c) / 2]
        else:
            out.append([t, a, b, c])
    return [(t, a, b, round(c, 9)) for t, a, b, c in out]


def test_rewrites_equal_repeated_merging(spark):
    rng = random.Random(7)
    cases, rows = [], []
    for k in range(150):
        at, case = 0, []
        for _ in range(rng.randint(1, 12)):
            n = rng.choice([1, 2, 3, 5, 8])
            case.append((rng.choice("CP"), at, at + n, rng.randint(0, 100) / 100))
            at += n
        cases.append(case)
        rows += [(k, a * S, b * S, {"C": "Commercial", "P": "Program"}[t], c, a, b) for t, a, b, c in case]
    got = segments.merge_adjacent(segments.limit_duration(segments.bridge_gaps(spark.createDataFrame(rows, SEGMENTS), 3), 2, 9)).orderBy("start_us").collect()
    for k, case in enumerate(cases):
        mine = [(r["type"][0], r["start_us"] // S, r["end_us"] // S, round(r["confidence"], 9)) for r in got if r["rec_id"] == k]
        assert mine == plain_rewrite(case, 3, 2, 9), case


def test_duration_bounds_are_inclusive(spark):
    s = segs(spark, ("C", 0, 60, 0.5), ("P", 60, 70, 0.1), ("C", 70, 670, 0.5), ("P", 670, 680, 0.1), ("C", 680, 681, 0.5))
    assert [r[0] for r in shown(segments.merge_adjacent(segments.limit_duration(s, 60, 600)))] == ["C", "P", "C", "P"]


def test_consensus(spark):
    rows = [(1, "A", 11), (1, "A", 13), (1, "B", 40), (2, "A", 11)]
    e = spark.createDataFrame([(r, s, t * S) for r, s, t in rows], "rec_id long, source string, t_us long")
    active = spark.createDataFrame([(1, "A"), (1, "B"), (2, "A")], "rec_id long, source string")
    got = intervals.consensus(e, active, 100 * S).collect()
    assert sorted((r["rec_id"], r["t_us"] // S) for r in got) == [(1, 11), (1, 13), (2, 11)]


def rates(spark, *values):
    return spark.createDataFrame([(1, str(i), float(v)) for i, v in enumerate(values)], "rec_id long, source string, rate double")


def test_region_filters(spark):
    kept = lambda df: sorted(r["rate"] for r in df.collect())
    assert kept(intervals.without_noise(intervals.without_tickers(rates(spark, 0.20, 0.29, 0.31, 0.6), 0.5), 1.5)) == [0.20, 0.29]
    assert kept(intervals.without_noise(rates(spark, 0, 0, 0.1), 1.5)) == [0, 0]
    assert kept(intervals.without_noise(rates(spark, 0.4), 1.5)) == [0.4] and kept(intervals.without_noise(rates(spark, 0.1, 9), 0)) == [0.1, 9]
    assert kept(intervals.without_tickers(rates(spark, 0.5, 0.51), 0.5)) == [0.5]


def test_corners():
    assert intervals.corners(0.1, 0.02, 0)[3] == ("bottom-right", "crop=iw*0.1000:ih*0.1000:iw*0.8800:ih*0.9000")


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("text,want", [("30000/1001", 30000 / 1001), ("25", 25.0), ("0/0", 0.0), ("", 0.0), ("x/2", 0.0), ("1/2/3", 0.0)])
def test_fraction(spark, text, want):
    assert one(spark, x.fraction(F.lit(text))) == want


def test_times(spark):
    us = F.lit(3_725_500_000).cast("long")
    assert one(spark, x.mkv_time(us)) == "01:02:05.500000000" and one(spark, x.clock(us)) == "01:02:05.500"
    assert one(spark, x.report_time(F.lit(65.2))) == "1:05" and one(spark, x.report_time(F.lit(3725.9))) == "1:02:05"
    assert one(spark, x.seconds3(F.lit(1_000_500).cast("long"))) == "1.001" and one(spark, x.seconds3(F.lit(0).cast("long"))) == "0.000"
    assert one(spark, x.span_text(F.lit(90_061_500_000).cast("long"))) == "1.01:01:01.5000000"


def test_names_and_switches(spark):
    import re

    assert re.match(x.glob_regex("*.partial.*"), "A.Partial.ts") and not re.match(x.glob_regex("a?c"), "abbc") and re.match(x.glob_regex("*"), "")
    assert one(spark, x.with_extension(F.lit("/a.b/c.d.ts"), ".edl")) == "/a.b/c.d.edl"
    assert one(spark, x.stem(F.lit("C:\\x\\y.z.ts"))) == "y.z" and one(spark, x.folder(F.lit("/a/b/c"))) == "/a/b"
    assert one(spark, x.switch(F.lit(" ON "))) and not one(spark, x.switch(F.lit("maybe"))) and one(spark, x.switch(F.lit("maybe"), True))
    assert one(spark, x.csv_quoted(F.lit('a"b'))) == '"a""b"'
    assert one(spark, x.filled("{a}-{b}-{a}", a=F.lit(1), b="x")) == "1-x-1"
