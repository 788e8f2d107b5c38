"""One query per operator over the driver's tables, and the SQL that says the same."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .functions import scalars as x
from .operators import intervals, score, segments
from .plans import cutplan, detect, report, views
from .sinks import render
from .sources import broadcast, documents, files, logs, settings
from .streaming import watch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: The same SQL before its table expressions are put before it, for use in other queries.
_TEXT: dict[str, str] = {}
SQL: dict[str, str] = {}

GAP, LONG, LEAST = 220_000_000, 60_000_000, 2
TODAY = datetime.date(2024, 6, 1)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            _TEXT[f.__name__] = sql
            SQL[f.__name__] = _full(sql)
        return f

    return add


#: Common table expressions by name; ``_full`` puts those that a query names before it.
CTES: dict[str, str] = {
    "ev": """SELECT user_id AS rec_id, CASE event_type WHEN 'error' THEN 'BlackFrame' WHEN 'view' THEN 'SceneChange' WHEN 'click' THEN 'Silence'
        WHEN 'purchase' THEN 'LogoAbsence' WHEN 'signup' THEN 'Letterbox' END AS signal, CAST(event_id % 4 AS VARCHAR) AS source, event_id,
        (epoch_us(ts) - 1704067200000000) // 720 AS t_us, CAST(round(value * 100) AS BIGINT) * 1000 AS len_us, value, props FROM events""",
    "recs": """SELECT DISTINCT user_id AS rec_id, '/rec/show ' || (user_id % 20) || '/Show ' || user_id || '.ts' AS path, 3600000000 AS duration_us FROM events""",
    "marked": """SELECT *, CASE WHEN t_us - lag(t_us) OVER w <= 220000000 THEN 0 ELSE 1 END AS f FROM ev WINDOW w AS (PARTITION BY rec_id, signal ORDER BY t_us, event_id)""",
    "runs": """SELECT *, sum(f) OVER (PARTITION BY rec_id, signal ORDER BY t_us, event_id ROWS UNBOUNDED PRECEDING) AS run FROM marked""",
    "clu": """SELECT rec_id, signal, min(t_us) AS start_us, max(t_us) AS end_us, count(*) AS n_events FROM runs GROUP BY rec_id, signal, run
        HAVING count(*) >= 2 AND max(t_us) - min(t_us) >= 60000000""",
    # One row a profile, the settings as the base file and the profile's own give them; what neither sets is the default.
    "prof": """SELECT * FROM (VALUES
        (0, 2000000, 0.38::DOUBLE, 3, 20000000, 90000000, 60000000, 0.60::DOUBLE, true, 220000000, 60000000, 2, 0.05::DOUBLE, false, 0.15::DOUBLE, true, 0.40::DOUBLE, -1.0::DOUBLE, 420000000, 2, 1.5::DOUBLE, false, 0.50::DOUBLE, 5000000, true, true),
        (1, 2000000, 0.45, 0, 215000000, 90000000, 60000000, 0.55, true, 180000000, 1000000, 1, 0.15, false, 0.20, false, 0.0, -1.0, 420000000, 2, 1.5, false, 0.50, 5000000, true, false),
        (2, 3500000, 0.55, 3, 20000000, 90000000, 60000000, 0.55, false, 220000000, 60000000, 2, 0.20, true, 0.15, false, 0.40, -1.0, 300000000, 3, 1.5, false, 0.50, 5000000, true, true),
        (3, 2000000, 0.38, 5, 0, 0, 60000000, 0.25, true, 350000000, 60000000, 2, 0.05, false, 0.15, true, 0.40, 300.0, 420000000, 2, 0.0, true, 0.55, 30000000, false, true))
        t(prof_no, window_us, threshold, radius, merge_us, skip_s0, skip_e0, bf_w, bf_dense, bf_gap, bf_dur, bf_ev, sc_w, sc_inv, si_w, lo_on, lo_w, learn_at, lo_gap, lo_ev, lo_ratio, lb_on, lb_w, lb_dur, psip, xds)""",
    "settled": """SELECT r.rec_id, r.duration_us, p.*, 60000000 AS min_us, 600000000 AS max_us, 30000000 AS lo_dur, 0.002 AS ticker,
        CASE WHEN p.psip AND r.rec_id % 7 = 0 THEN 120000000 WHEN p.xds AND r.rec_id % 5 = 0 THEN 60000000 ELSE p.skip_s0 END AS skip_s,
        CASE WHEN p.psip AND r.rec_id % 7 = 0 THEN 180000000 WHEN p.xds AND r.rec_id % 5 = 0 THEN 0 ELSE p.skip_e0 END AS skip_e FROM recs r JOIN prof p ON p.prof_no = r.rec_id % 4""",
    "black": """SELECT e.rec_id, e.t_us AS start_us, e.t_us + e.len_us AS end_us, s.* EXCLUDE (rec_id) FROM ev e JOIN settled s USING (rec_id) WHERE e.signal = 'BlackFrame'""",
    "black_long": """SELECT * FROM black WHERE bf_dense AND (end_us - start_us) / 1000000.0::DOUBLE >= 15 / (30000.0::DOUBLE / 1001)""",
    "black_m": """SELECT *, CASE WHEN start_us - lag(start_us) OVER w <= bf_gap THEN 0 ELSE 1 END AS f, coalesce(start_us - lag(start_us) OVER w, 4611686018427387904) AS before_us, coalesce(lead(start_us) OVER w - start_us, 4611686018427387904) AS after_us
        FROM black_long WINDOW w AS (PARTITION BY rec_id ORDER BY start_us, end_us)""",
    "black_r": """SELECT *, sum(f) OVER (PARTITION BY rec_id ORDER BY start_us, end_us ROWS UNBOUNDED PRECEDING) AS run FROM black_m""",
    "black_segs": """SELECT rec_id, start_us, end_us FROM black WHERE NOT bf_dense
        UNION ALL SELECT rec_id, min(start_us), max(start_us) FROM black_r GROUP BY rec_id, run HAVING count(*) >= any_value(bf_ev) AND max(start_us) - min(start_us) >= any_value(bf_dur)
        UNION ALL SELECT rec_id, start_us, end_us FROM black_m WHERE bf_ev <= 1 AND end_us - start_us >= bf_dur AND before_us > bf_gap AND after_us > bf_gap""",
    "corner_no": """SELECT * FROM (VALUES (0, 'top-left'), (1, 'top-right'), (2, 'bottom-left'), (3, 'bottom-right'), (4, 'top-band'), (5, 'bottom-band')) t(n, source)""",
    "changes": """SELECT e.rec_id, c.source, c.n, e.t_us, e.event_id FROM ev e JOIN corner_no c ON c.n = e.event_id % 6 WHERE e.signal = 'LogoAbsence'""",
    "probes": """SELECT e.rec_id, c.source, c.n, e.t_us // 5000000 * 5000000 AS t_us, e.event_id FROM ev e JOIN corner_no c ON c.n = e.event_id % 4 WHERE e.signal = 'LogoAbsence' AND e.len_us // 1000 % 10 < 7""",
    "learn": """SELECT rec_id, least(CASE WHEN learn_at >= 0 THEN learn_at ELSE skip_s / 1000000.0::DOUBLE END, 1800.0::DOUBLE) AS at_s, least(900.0::DOUBLE, 3600 - least(CASE WHEN learn_at >= 0 THEN learn_at ELSE skip_s / 1000000.0::DOUBLE END, 1800.0::DOUBLE)) AS len_s
        FROM settled WHERE lo_on AND lo_w > 0""",
    "busy": """SELECT l.rec_id, c.source, c.n, count(x.event_id) / any_value(l.len_s) AS rate FROM learn l CROSS JOIN corner_no c
        LEFT JOIN changes x ON x.rec_id = l.rec_id AND x.n = c.n AND x.t_us >= l.at_s * 1000000 AND x.t_us < (l.at_s + l.len_s) * 1000000 GROUP BY l.rec_id, c.source, c.n""",
    "calm": """SELECT b.rec_id, b.source, b.rate, s.lo_ratio, min(b.rate) OVER w AS least_rate, count(*) OVER w AS n_left FROM busy b JOIN settled s USING (rec_id) WHERE b.n < 4 AND b.rate <= s.ticker WINDOW w AS (PARTITION BY b.rec_id)""",
    "active": """SELECT rec_id, source FROM calm WHERE n_left < 2 OR lo_ratio <= 0 OR rate <= least_rate * lo_ratio""",
    "away": """SELECT rec_id, source, t_us FROM probes WHERE (rec_id + n) % 3 <> 0 UNION ALL SELECT rec_id, source, t_us FROM changes WHERE n > 3 OR (rec_id + n) % 3 = 0""",
    "voted": """SELECT a.rec_id, a.t_us, count(*) OVER (PARTITION BY a.rec_id, a.t_us // 5000000) AS votes, k.n_active FROM away a JOIN active USING (rec_id, source) JOIN (SELECT rec_id, count(*) AS n_active FROM active GROUP BY rec_id) k USING (rec_id)""",
    "dots": """SELECT rec_id, 'LogoAbsence' AS signal, t_us FROM voted WHERE n_active < 2 OR (votes >= 2 AND t_us // 5000000 < 721) UNION ALL SELECT rec_id, signal, t_us FROM ev WHERE signal = 'SceneChange'""",
    "dots_m": """SELECT d.rec_id, d.signal, d.t_us, s.lo_gap, s.lo_dur, s.lo_ev, CASE WHEN d.t_us - lag(d.t_us) OVER (PARTITION BY d.rec_id, d.signal ORDER BY d.t_us) <= s.lo_gap THEN 0 ELSE 1 END AS f FROM dots d JOIN settled s USING (rec_id)""",
    "dots_r": """SELECT *, sum(f) OVER (PARTITION BY rec_id, signal ORDER BY t_us ROWS UNBOUNDED PRECEDING) AS run FROM dots_m""",
    "segs": """SELECT rec_id, 'BlackFrame' AS signal, start_us, end_us FROM black_segs
        UNION ALL SELECT rec_id, signal, min(t_us), max(t_us) FROM dots_r GROUP BY rec_id, signal, run HAVING count(*) >= any_value(lo_ev) AND max(t_us) - min(t_us) >= any_value(lo_dur)
        UNION ALL SELECT rec_id, signal, t_us, t_us + len_us FROM ev WHERE signal = 'Silence'
        UNION ALL SELECT e.rec_id, e.signal, e.t_us, e.t_us + e.len_us FROM ev e JOIN settled s USING (rec_id) WHERE e.signal = 'Letterbox' AND s.lb_on AND e.len_us >= s.lb_dur""",
    "slots": """SELECT rec_id, duration_us, window_us, unnest(generate_series(0, (duration_us + window_us - 1) // window_us - 1)) AS i FROM settled""",
    "cells": """SELECT rec_id, i, i * window_us AS start_us, least((i + 1) * window_us, duration_us) AS end_us FROM slots""",
    "hits": """SELECT DISTINCT c.rec_id, s.signal, c.i FROM cells c JOIN segs s ON s.rec_id = c.rec_id AND s.start_us < c.end_us AND s.end_us > c.start_us""",
    "absent": """SELECT r.rec_id, coalesce(sum((s.end_us - s.start_us) / 1000000.0), 0.0) AS absent_s FROM recs r LEFT JOIN (SELECT * FROM segs WHERE signal = 'LogoAbsence') s USING (rec_id) GROUP BY r.rec_id""",
    "present": """SELECT s.rec_id, v.signal, CASE v.signal WHEN 'BlackFrame' THEN s.bf_w WHEN 'SceneChange' THEN s.sc_w WHEN 'Silence' THEN s.si_w WHEN 'LogoAbsence' THEN s.lo_w ELSE s.lb_w END AS weight
        FROM settled s JOIN absent a USING (rec_id) CROSS JOIN (VALUES ('BlackFrame'), ('SceneChange'), ('Silence'), ('LogoAbsence'), ('Letterbox')) v(signal)
        WHERE CASE v.signal WHEN 'LogoAbsence' THEN s.lo_on AND s.lo_w > 0 AND a.absent_s / 3600 < 0.85 AND s.rec_id IN (SELECT rec_id FROM active) WHEN 'Letterbox' THEN s.lb_on ELSE true END""",
    "total": """SELECT rec_id, CASE WHEN sum(weight) > 0 THEN sum(weight) ELSE 1 END AS total FROM present GROUP BY rec_id""",
    "lit": """SELECT h.rec_id, h.i, h.signal FROM hits h JOIN settled s USING (rec_id) WHERE NOT (h.signal = 'SceneChange' AND s.sc_inv)
        UNION ALL SELECT c.rec_id, c.i, 'SceneChange' FROM cells c JOIN settled s USING (rec_id) WHERE s.sc_inv AND NOT EXISTS (SELECT 1 FROM hits h WHERE h.rec_id = c.rec_id AND h.i = c.i AND h.signal = 'SceneChange')""",
    "raw": """SELECT h.rec_id, h.i, least(1.0, greatest(0.0, sum(p.weight) / any_value(t.total))) AS p FROM lit h JOIN present p USING (rec_id, signal) JOIN total t USING (rec_id) GROUP BY h.rec_id, h.i""",
    "win": """SELECT c.rec_id, c.i, c.start_us, c.end_us, coalesce(r.p, 0.0) AS p0 FROM cells c LEFT JOIN raw r USING (rec_id, i)""",
    "smo": """SELECT w.*, CASE s.radius WHEN 0 THEN w.p0 WHEN 3 THEN avg(w.p0) OVER (PARTITION BY rec_id ORDER BY w.i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) ELSE avg(w.p0) OVER (PARTITION BY rec_id ORDER BY w.i ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) END AS p FROM win w JOIN settled s USING (rec_id)""",
    "cls": """SELECT m.*, CASE WHEN round(m.p, 9) >= s.threshold THEN 'Commercial' ELSE 'Program' END AS class FROM smo m JOIN settled s USING (rec_id)""",
    "isl0": """SELECT *, CASE WHEN class = lag(class) OVER (PARTITION BY rec_id ORDER BY i) THEN 0 ELSE 1 END AS f FROM cls""",
    "isl1": """SELECT *, sum(f) OVER (PARTITION BY rec_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM isl0""",
    "isl": """SELECT rec_id, min(start_us) AS start_us, max(end_us) AS end_us, any_value(class) AS type, avg(p) AS confidence,
        CAST(trunc(min(start_us) / 1000000.0::DOUBLE * (30000.0::DOUBLE / 1001)) AS BIGINT) AS start_frame, CAST(trunc(max(end_us) / 1000000.0::DOUBLE * (30000.0::DOUBLE / 1001)) AS BIGINT) AS end_frame FROM isl1 GROUP BY rec_id, run""",
    "skip0": """SELECT x.* REPLACE (CASE WHEN x.type = 'Commercial' AND x.start_us < s.skip_s THEN 'Program' ELSE x.type END AS type) FROM isl x JOIN settled s USING (rec_id)""",
    "skip1": """SELECT x.* REPLACE (CASE WHEN x.type = 'Commercial' AND s.skip_e > 0 AND x.end_us > 3600000000 - s.skip_e AND x.start_us < 3600000000 - s.skip_e THEN 3600000000 - s.skip_e ELSE x.end_us END AS end_us,
        CASE WHEN x.type = 'Commercial' AND s.skip_e > 0 AND x.end_us > 3600000000 - s.skip_e AND x.start_us >= 3600000000 - s.skip_e THEN 'Program' ELSE x.type END AS type) FROM skip0 x JOIN settled s USING (rec_id)""",
    "gap0": """SELECT x.*, coalesce(x.type = 'Program' AND lag(x.type) OVER w = 'Commercial' AND lead(x.type) OVER w = 'Commercial' AND s.merge_us > 0 AND x.end_us - x.start_us <= s.merge_us, false) AS closed FROM {src} x JOIN settled s USING (rec_id) WINDOW w AS (PARTITION BY rec_id ORDER BY x.start_us)""",
}
_FOLD = "list_reduce(list(confidence ORDER BY start_us){only}, lambda a, b: (a + b) / 2)"


def _grouped(src: str, only: str = "") -> str:
    fold = _FOLD.format(only=only)
    return f"""SELECT rec_id, min(start_us) AS s, arg_max(end_us, start_us) AS end_us, arg_min(type, start_us) AS type, {fold} AS confidence,
        arg_min(start_frame, start_us) AS start_frame, arg_max(end_frame, start_us) AS end_frame FROM {src} GROUP BY rec_id, run"""


def _named(name: str, src: str, bridge: bool = True) -> None:
    """CTEs that bridge gaps, limit durations and merge, from ``src`` to ``name``."""
    if bridge:
        CTES[f"{name}_g0"] = CTES["gap0"].format(src=src)
        CTES[f"{name}_g1"] = f"SELECT *, CASE WHEN closed OR lag(closed, 1, false) OVER (PARTITION BY rec_id ORDER BY start_us) THEN 0 ELSE 1 END AS f FROM {name}_g0"
        CTES[f"{name}_g2"] = f"SELECT *, sum(f) OVER (PARTITION BY rec_id ORDER BY start_us ROWS UNBOUNDED PRECEDING) AS run FROM {name}_g1"
        CTES[f"{name}_g"] = _grouped(f"{name}_g2", " FILTER (WHERE NOT closed)").replace("AS s,", "AS start_us,")
        src = f"{name}_g"
    CTES[f"{name}_d0"] = f"SELECT x.* REPLACE (CASE WHEN x.type = 'Commercial' AND (x.end_us - x.start_us < s.min_us OR x.end_us - x.start_us > s.max_us) THEN 'Program' ELSE x.type END AS type) FROM {src} x JOIN settled s USING (rec_id)"
    CTES[f"{name}_d1"] = f"SELECT *, CASE WHEN type = lag(type) OVER (PARTITION BY rec_id ORDER BY start_us) THEN 0 ELSE 1 END AS f FROM {name}_d0"
    CTES[f"{name}_d2"] = f"SELECT *, sum(f) OVER (PARTITION BY rec_id ORDER BY start_us ROWS UNBOUNDED PRECEDING) AS run FROM {name}_d1"
    CTES[name] = _grouped(f"{name}_d2").replace("AS s,", "AS start_us,")


_named("mrg", "skip1")
_named("lim", "isl", bridge=False)
CTES["fin"] = """SELECT x.* REPLACE (CASE WHEN x.type = 'Commercial' AND (x.start_us < s.skip_s OR (s.skip_e > 0 AND x.end_us > 3600000000 - s.skip_e)) THEN 'Program' ELSE x.type END AS type) FROM mrg x JOIN settled s USING (rec_id)"""
CTES["num"] = """SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY start_us) - 1 AS seg_no, row_number() OVER (PARTITION BY rec_id, type ORDER BY start_us) AS type_no FROM fin"""


def _full(sql: str) -> str:
    """The query with the table expressions that it uses, and those that these use, in order."""
    import re

    used: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in used and re.search(rf"(?:FROM|JOIN)\s+{name}\b", text):
                visit(CTES[name])
                if name not in used:
                    used.append(name)

    visit(sql)
    used = [n for n in used if n != "gap0"]
    return ("WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in used) + "\n" if used else "") + sql


# Signals, grid and scores ---------------------------------------------------


def _events(spark, sf_dir, *signals: str) -> DataFrame:
    e = views.signal_events(spark, sf_dir)
    return e.filter(F.col("signal").isin(*signals)) if signals else e


def _settled(spark, sf_dir) -> DataFrame:
    return views.settled_recordings(spark, sf_dir)


def _found(spark, sf_dir) -> DataFrame:
    return detect.found_segments(views.found(spark, sf_dir), _settled(spark, sf_dir))[0]


def _scored(spark, sf_dir) -> DataFrame:
    return detect.scored_windows(views.found(spark, sf_dir), _settled(spark, sf_dir))


def _islands(spark, sf_dir) -> DataFrame:
    return detect.raw_segments(views.found(spark, sf_dir), _settled(spark, sf_dir))


def _with(spark, sf_dir, rows: DataFrame, *settings: str) -> DataFrame:
    return rows.join(_settled(spark, sf_dir).select("rec_id", "duration_us", *settings), "rec_id")


def _breaks(spark, sf_dir) -> DataFrame:
    return detect.detect_breaks(views.found(spark, sf_dir), _settled(spark, sf_dir))


_SEG = "rec_id, start_us, end_us, type, round(confidence, 6) AS confidence, start_frame, end_frame"


def _shown(df: DataFrame, *more: str) -> DataFrame:
    return df.select("rec_id", "start_us", "end_us", "type", x.rounded(F.col("confidence"), 6).alias("confidence"), "start_frame", "end_frame", *more)


@query(f"SELECT {_SEG}, seg_no FROM num")
def flagship_breaks(spark, sf_dir):
    return _shown(_breaks(spark, sf_dir), "seg_no")


@query("SELECT rec_id, signal, start_us, end_us, n_events FROM clu")
def cluster_events(spark, sf_dir):
    return intervals.cluster(_events(spark, sf_dir), GAP, LONG, LEAST)


@query("SELECT rec_id, signal, start_us, end_us, n_events FROM clu")
def session_window_cluster(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("ts", F.timestamp_micros("t_us"))
    us = F.unix_micros("ts")
    s = e.groupBy("rec_id", "signal", F.session_window("ts", "220 seconds")).agg(F.min(us).alias("start_us"), F.max(us).alias("end_us"), F.count("*").alias("n_events"))
    return s.filter((F.col("n_events") >= LEAST) & (F.col("end_us") - F.col("start_us") >= LONG)).select("rec_id", "signal", "start_us", "end_us", "n_events")


@query("""SELECT rec_id, signal, start_us, end_us FROM (SELECT rec_id, signal, t_us AS start_us, t_us + len_us AS end_us,
    coalesce(t_us - lag(t_us) OVER w, 4611686018427387904) AS b, coalesce(lead(t_us) OVER w - t_us, 4611686018427387904) AS a FROM ev WHERE signal = 'BlackFrame'
    WINDOW w AS (PARTITION BY rec_id ORDER BY t_us, t_us + len_us)) WHERE end_us - start_us >= 2000000 AND b > 180000000 AND a > 180000000""")
def cluster_rescue(spark, sf_dir):
    return intervals.rescue(views.signal_spans(spark, sf_dir, "BlackFrame").drop("event_id"), 180_000_000, 2_000_000)


@query("SELECT rec_id, signal, t_us AS start_us, t_us + len_us AS end_us FROM ev WHERE signal = 'BlackFrame' AND len_us / 1000000.0 >= 150 / (30000.0 / 1001)")
def bf_min_count(spark, sf_dir):
    return intervals.long_enough(views.signal_spans(spark, sf_dir, "BlackFrame"), 150, views.FPS).drop("event_id")


@query("SELECT rec_id, signal, start_us, end_us FROM segs")
def found_segments(spark, sf_dir):
    """The segments of all signals, each under its own detector's settings and its recording's profile."""
    return _found(spark, sf_dir).select("rec_id", "signal", "start_us", "end_us")


@query("SELECT rec_id, signal, i FROM hits")
def overlap_windows(spark, sf_dir):
    return intervals.overlap_windows(_with(spark, sf_dir, _found(spark, sf_dir), "window_size"), detect.us("window_size"), F.col("duration_us"))


@query("SELECT DISTINCT c.rec_id, c.i FROM (SELECT rec_id, i, i * 2000000 AS start_us, (i + 1) * 2000000 AS end_us FROM recs, generate_series(0, 1799) g(i)) c SEMI JOIN (SELECT rec_id, t_us AS start_us, t_us + len_us AS end_us FROM ev WHERE signal = 'Silence') s ON s.rec_id = c.rec_id AND s.start_us < c.end_us AND s.end_us > c.start_us")
def overlap_theta_join(spark, sf_dir):
    c = intervals.grid(views.recordings(spark, sf_dir), 2_000_000).alias("c")
    s = views.signal_spans(spark, sf_dir, "Silence").alias("s")
    return c.join(s, (F.col("s.rec_id") == F.col("c.rec_id")) & (F.col("s.start_us") < F.col("c.end_us")) & (F.col("s.end_us") > F.col("c.start_us")), "left_semi").select("rec_id", "i")


@query("SELECT rec_id, round(total, 9) AS total FROM total")
def active_weights(spark, sf_dir):
    r = _settled(spark, sf_dir)
    segs, active = detect.found_segments(views.found(spark, sf_dir), r)
    return score.active_weights(detect.present_signals(segs, r, active)).select("rec_id", F.round("total", 9).alias("total"))


@query("SELECT rec_id, i, start_us, end_us, round(p0, 9) AS p FROM win")
def weighted_scores(spark, sf_dir):
    return _scored(spark, sf_dir).select("rec_id", "i", "start_us", "end_us", F.round("p", 9).alias("p"))


@query("""SELECT rec_id, i, round((p0 * total + CASE WHEN h.x THEN -sc_w ELSE sc_w END * CASE WHEN sc_inv THEN -1 ELSE 1 END) / total, 9) AS p FROM win JOIN total USING (rec_id) JOIN settled USING (rec_id)
    LEFT JOIN (SELECT rec_id, i, true AS x FROM hits WHERE signal = 'SceneChange') h USING (rec_id, i)""")
def invert_scores(spark, sf_dir):
    """Each profile with its scene changes turned the other way."""
    r = _settled(spark, sf_dir).withColumn("sc_invert", ~F.col("sc_invert"))
    return detect.scored_windows(views.found(spark, sf_dir), r).select("rec_id", "i", F.round("p", 9).alias("p"))


@query("SELECT rec_id, i, string_agg(signal, ',' ORDER BY signal) AS signals FROM hits GROUP BY rec_id, i")
def signal_score_map(spark, sf_dir):
    hits = intervals.overlap_windows(_with(spark, sf_dir, _found(spark, sf_dir), "window_size"), detect.us("window_size"), F.col("duration_us"))
    return score.score_map(hits).select("rec_id", "i", F.array_join(F.sort_array(F.map_keys("signal_scores")), ",").alias("signals"))


@query("SELECT rec_id, i, round(avg(p0) OVER (PARTITION BY rec_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 9) AS p FROM win")
def smooth_scores(spark, sf_dir):
    return score.smooth(_scored(spark, sf_dir), 3).select("rec_id", "i", F.round("p", 9).alias("p"))


@query("SELECT rec_id, i, round(p, 9) AS p FROM smo")
def smooth_by_profile(spark, sf_dir):
    return score.smooth(_scored(spark, sf_dir), F.col("smoothing_radius")).select("rec_id", "i", F.round("p", 9).alias("p"))


@query("SELECT rec_id, i, class AS classification FROM cls")
def threshold_class(spark, sf_dir):
    return detect.classified(views.found(spark, sf_dir), _settled(spark, sf_dir)).select("rec_id", "i", "classification")


# Segments -------------------------------------------------------------------


@query(f"SELECT {_SEG} FROM isl")
def islands(spark, sf_dir):
    return _shown(_islands(spark, sf_dir))


def _skipped(spark, sf_dir) -> DataFrame:
    s = _with(spark, sf_dir, _islands(spark, sf_dir), "skip_start", "skip_end", "merge_gap")
    return segments.strip_end(segments.strip_start(s, F.col("skip_start")), F.col("skip_end"), F.col("duration_us"))


@query(f"SELECT {_SEG} FROM skip0")
def skip_start(spark, sf_dir):
    return _shown(segments.strip_start(_with(spark, sf_dir, _islands(spark, sf_dir), "skip_start"), F.col("skip_start")))


@query(f"SELECT {_SEG} FROM skip1")
def skip_end_trim(spark, sf_dir):
    return _shown(_skipped(spark, sf_dir))


@query(f"SELECT {_SEG} FROM mrg_g")
def gap_merge(spark, sf_dir):
    return _shown(segments.bridge_gaps(_skipped(spark, sf_dir), F.col("merge_gap")))


@query(f"SELECT {_SEG} FROM lim")
def duration_filter_remerge(spark, sf_dir):
    return _shown(segments.merge_adjacent(segments.limit_duration(_islands(spark, sf_dir), 60, 600)))


@query("SELECT rec_id, round(list_reduce(list(confidence ORDER BY start_us), lambda a, b: (a + b) / 2), 6) AS confidence FROM isl GROUP BY rec_id")
def confidence_fold(spark, sf_dir):
    parts = F.sort_array(F.collect_list(F.struct("start_us", "confidence")))
    return _islands(spark, sf_dir).groupBy("rec_id").agg(parts.alias("c")).select("rec_id", x.rounded(segments.folded(F.transform("c", lambda c: c["confidence"])), 6).alias("confidence"))


@query(f"""SELECT {_SEG} FROM (SELECT x.* REPLACE (CASE WHEN x.type = 'Commercial' AND (x.start_us < s.skip_s OR (s.skip_e > 0 AND x.end_us > 3600000000 - s.skip_e)) THEN 'Program' ELSE x.type END AS type) FROM isl x JOIN settled s USING (rec_id))""")
def skip_recheck(spark, sf_dir):
    s = _with(spark, sf_dir, _islands(spark, sf_dir), "skip_start", "skip_end")
    return _shown(segments.recheck_skips(s, F.col("skip_start"), F.col("skip_end"), F.col("duration_us")))


@query("SELECT rec_id, count(*) FILTER (WHERE type = 'Commercial') AS n_breaks, coalesce(sum((end_us - start_us) / 1000000.0) FILTER (WHERE type = 'Commercial'), 0.0)::DOUBLE AS break_s FROM fin GROUP BY rec_id")
def break_totals(spark, sf_dir):
    return segments.totals(_breaks(spark, sf_dir))


# Corners and bands ----------------------------------------------------------

CTES["logo"] = "SELECT * FROM ev WHERE signal = 'LogoAbsence'"


def _rates(spark, sf_dir) -> DataFrame:
    return detect.activity(views.found(spark, sf_dir).corners, _settled(spark, sf_dir))


@query("SELECT rec_id, source, round(rate, 9) AS rate FROM busy")
def corner_rates(spark, sf_dir):
    return _rates(spark, sf_dir).withColumn("rate", F.round("rate", 9))


@query("SELECT rec_id, source, round(rate, 9) AS rate FROM busy WHERE rate <= 0.002")
def ticker_filter(spark, sf_dir):
    return intervals.without_tickers(_rates(spark, sf_dir), 0.002).withColumn("rate", F.round("rate", 9))


@query("""SELECT rec_id, source, round(rate, 9) AS rate FROM (SELECT *, count(*) OVER w AS k, min(rate) OVER w AS m FROM busy WINDOW w AS (PARTITION BY rec_id)) WHERE k < 2 OR rate <= m * 1.5""")
def noise_filter(spark, sf_dir):
    return intervals.without_noise(_rates(spark, sf_dir), 1.5).withColumn("rate", F.round("rate", 9))


@query("SELECT rec_id, source FROM active")
def active_corners(spark, sf_dir):
    return detect.active_corners(_rates(spark, sf_dir), _settled(spark, sf_dir))


@query("SELECT rec_id, source, round(rate * 1000, 9) AS rate FROM busy WHERE n > 3 AND rate * 1000 > 1.5")
def band_warnings(spark, sf_dir):
    """Rates a thousand seconds, as the tables' events are sparse."""
    return intervals.band_warnings(_rates(spark, sf_dir).withColumn("rate", F.col("rate") * 1000)).withColumn("rate", F.round("rate", 9))


@query("SELECT rec_id, source, event_id, t_us FROM (SELECT *, count(*) OVER (PARTITION BY rec_id, t_us // 60000000) AS n FROM logo WHERE source <> '3') WHERE n >= 2")
def consensus_buckets(spark, sf_dir):
    active = views.recordings(spark, sf_dir).select("rec_id", F.explode(F.array(*map(F.lit, "012"))).alias("source"))
    out = intervals.consensus(_events(spark, sf_dir, "LogoAbsence"), active, views.DURATION_US, 60_000_000)
    return out.select("rec_id", "source", "event_id", "t_us")


@query("SELECT rec_id, round(absent_s, 6)::DOUBLE AS absent_s, round(absent_s / 3600, 9)::DOUBLE AS share, absent_s / 3600 >= 0.2 AS suppressed FROM absent")
def absent_fraction(spark, sf_dir):
    out = intervals.absent_share(_found(spark, sf_dir).filter("signal = 'LogoAbsence'"), views.recordings(spark, sf_dir), 0.2)
    return out.withColumns({"absent_s": F.round("absent_s", 6), "share": F.round("share", 9)})


@query("SELECT rec_id, least(rec_id % 7 * 400.0, 1800.0)::DOUBLE AS learn_start_s, least(180.0, 3600 - least(rec_id % 7 * 400.0, 1800.0))::DOUBLE AS learn_s, least(rec_id % 7 * 400.0, 1800.0)::DOUBLE + 90 AS reference_s FROM recs")
def learn_windows(spark, sf_dir):
    return intervals.learn_window(views.recordings(spark, sf_dir), F.lit(-1), (F.col("rec_id") % 7 * 400).cast("double"), 180, -1)


# Logs, documents and settings ------------------------------------------------

CTES["silent"] = "SELECT *, row_number() OVER (PARTITION BY rec_id, mod ORDER BY t_us, event_id) AS n FROM (SELECT rec_id, t_us, event_id, event_id % 2 AS mod FROM ev WHERE signal = 'Silence')"


def _seconds(us):
    return F.concat(F.floor(us / 1000000).cast("string"), F.lit("."), F.lpad((us % 1000000).cast("string"), 6, "0"))


def _log(rows: DataFrame, line) -> DataFrame:
    """(rec_id, log): one text a recording, its lines in order of time."""
    return rows.select("rec_id", "event_id", line.alias("line")).groupBy("rec_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "line"))), lambda r: r["line"]), "\n").alias("log"))


@query("SELECT rec_id, t_us AS start_us, t_us + len_us AS end_us FROM ev WHERE signal = 'BlackFrame'")
def parse_blackdetect(spark, sf_dir):
    line = F.concat(F.lit("[blackdetect @ 0x1] black_start:"), _seconds(F.col("start_us")), F.lit(" black_end:"), _seconds(F.col("end_us")), F.lit(" black_duration:1"))
    return logs.black_segments(_log(views.signal_spans(spark, sf_dir, "BlackFrame"), line))


@query("""SELECT s.rec_id, s.t_us AS start_us, coalesce(e.t_us, 3600000000) AS end_us FROM (SELECT * FROM silent WHERE mod = 0) s LEFT JOIN (SELECT * FROM silent WHERE mod = 1) e USING (rec_id, n)
    WHERE e.t_us IS NOT NULL OR s.n = (SELECT count(*) + 1 FROM silent x WHERE x.rec_id = s.rec_id AND x.mod = 1)""")
def silence_pairing(spark, sf_dir):
    e = _events(spark, sf_dir, "Silence")
    line = F.concat(F.when(F.col("event_id") % 2 == 0, "silence_start: ").otherwise("silence_end: "), _seconds(F.col("t_us")))
    by_time = e.withColumn("event_id", F.struct("t_us", "event_id"))
    text = by_time.select("rec_id", "event_id", F.concat(F.when(F.col("event_id.event_id") % 2 == 0, "silence_start: ").otherwise("silence_end: "), _seconds(F.col("t_us"))).alias("line"))
    log = text.groupBy("rec_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "line"))), lambda r: r["line"]), "\n").alias("log"))
    return logs.silence_segments(log.withColumn("duration_us", F.lit(views.DURATION_US)))


@query("SELECT rec_id, t_us FROM ev WHERE signal = 'SceneChange'")
def parse_pts(spark, sf_dir):
    line = F.concat(F.lit("[Parsed_showinfo_1 @ 0x1] n: 0 pts: 1 pts_time:"), _seconds(F.col("t_us")), F.lit(" duration: 1"))
    return logs.frame_events(_log(_events(spark, sf_dir, "SceneChange"), line))


@query("SELECT user_id AS rec_id, event_id * 5000000 AS t_us FROM events WHERE event_type = 'purchase' AND CAST(round(value * 100) AS BIGINT) % 1000 < 500")
def parse_ssim(spark, sf_dir):
    s = views.signal_events(spark, sf_dir, (F.round(F.col("value") * 100).cast("bigint") % 1000).alias("m")).filter("signal = 'LogoAbsence'")
    line = F.concat(F.lit("n:"), (F.col("event_id") + 1).cast("string"), F.lit(" Y:0.9 U:0.9 V:0.9 All:0."), F.lpad(F.col("m").cast("string"), 3, "0"), F.lit(" (12.3)"))
    return logs.ssim_events(_log(s, line), 0.5)


@query("""SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 0.0 WHEN p_size % 5 = 4 THEN p_size::DOUBLE ELSE (p_size * 1000)::DOUBLE / (1000 + p_size % 5) END AS rate FROM part""")
def parse_fraction(spark, sf_dir):
    s, m = F.col("p_size").cast("string"), F.col("p_size") % 5
    text = F.when(m == 0, F.concat(s, F.lit("/0"))).when(m == 4, s).otherwise(F.concat(F.lit(""), (F.col("p_size") * 1000).cast("string"), F.lit("/"), (1000 + m).cast("string")))
    return views.table(spark, sf_dir, "part").select("p_partkey", x.fraction(text).alias("rate"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE CAST(round(value * 1000000) AS BIGINT) END AS duration_us, CAST(json_extract_string(props, '$.k') AS INTEGER) AS width, 720 AS height,
    CASE WHEN event_id % 2 = 0 THEN 25.0 ELSE 30000.0::DOUBLE / 1001 END AS frame_rate, 'h264' AS video_codec, CASE WHEN event_id % 5 = 0 THEN '' ELSE 'aac' END AS audio_codec, CASE WHEN event_id % 5 = 0 THEN 0 ELSE 6 END AS audio_channels FROM events""")
def json_probe(spark, sf_dir):
    e = views.table(spark, sf_dir, "events")
    video = F.struct(F.lit("video").alias("codec_type"), F.lit("h264").alias("codec_name"), F.get_json_object("props", "$.k").alias("width"), F.lit(720).alias("height"), F.when(F.col("event_id") % 2 == 0, "25").otherwise("0/0").alias("avg_frame_rate"), F.lit("30000/1001").alias("r_frame_rate"), F.lit("").alias("duration"), F.lit(0).alias("channels"))
    audio = F.struct(F.when(F.col("event_id") % 5 == 0, "subtitle").otherwise("audio").alias("codec_type"), F.lit("aac").alias("codec_name"), F.lit("").alias("width"), F.lit(0).alias("height"), F.lit("").alias("avg_frame_rate"), F.lit("").alias("r_frame_rate"), F.lit("").alias("duration"), F.lit(6).alias("channels"))
    length = F.when(F.col("event_id") % 3 == 0, "N/A").otherwise(F.format_string("%.6f", "value"))
    doc = F.to_json(F.struct(F.array(audio, video).alias("streams"), F.struct(length.alias("duration")).alias("format")))
    return documents.parse_probe(e.select("event_id", doc.alias("json"))).drop("audio_sample_rate")


@query("""SELECT o_orderkey AS rec_id, CASE WHEN o_custkey % 2 = 0 AND o_custkey <> 0 THEN 0.0 WHEN o_orderkey % 4000 > 0 AND o_orderkey % 4000 < 1800 THEN (o_orderkey % 4000)::DOUBLE ELSE 0.0 END
    + CASE WHEN o_custkey % 2 = 0 THEN o_custkey ELSE 0 END AS padding FROM orders""")
def post_padding(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders").withColumn("ended", F.to_timestamp("o_orderdate"))
    late = F.timestamp_micros(F.unix_micros("ended") + F.col("o_orderkey") % 4000 * 1_000_000)
    declared = F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey")).otherwise(0)
    return o.select(F.col("o_orderkey").alias("rec_id"), documents.post_padding(declared, late, F.col("ended")).alias("padding"))


@query("""SELECT r.rec_id, g.c_custkey AS id FROM recs r LEFT JOIN (SELECT c_nationkey, min(c_custkey) AS c_custkey FROM customer GROUP BY 1) g ON r.rec_id = g.c_nationkey""")
def epg_join(spark, sf_dir):
    c = views.table(spark, sf_dir, "customer")
    epg = c.select(F.col("c_custkey").alias("ord"), F.col("c_custkey").alias("id"), F.concat(F.lit("D:\\TV\\SHOW "), F.col("c_nationkey").cast("string"), F.lit(".TS")).alias("path"))
    return documents.match_epg(views.recordings(spark, sf_dir).select("rec_id", "path"), epg).select("rec_id", "id")


CTES["starts"] = "SELECT rec_id, event_id AS ord, t_us AS prog_start_us, 600000000 + len_us AS prog_len_us FROM ev WHERE signal = 'Letterbox'"


@query("""SELECT rec_id, rec_start_us, prog_start_us, prog_len_us, CAST(ord AS BIGINT) AS listing FROM (SELECT r.rec_id, r.rec_start_us, s.*, row_number() OVER (PARTITION BY r.rec_id ORDER BY s.ord) AS n
    FROM (SELECT rec_id, 1800000000 AS rec_start_us FROM recs) r LEFT JOIN (SELECT rec_id AS k, ord, prog_start_us, prog_len_us FROM starts) s ON s.k = r.rec_id AND s.prog_start_us <= 2100000000 AND s.prog_start_us + s.prog_len_us > 1500000000) WHERE n = 1""")
def eit_asof(spark, sf_dir):
    l = views.signal_spans(spark, sf_dir, "Letterbox").select("rec_id", F.col("event_id").alias("ord"), F.col("start_us").alias("prog_start_us"), (F.col("end_us") - F.col("start_us") + 600_000_000).alias("prog_len_us"))  # noqa: E741
    r = views.recordings(spark, sf_dir).select("rec_id", F.lit(1_800_000_000).cast("long").alias("rec_start_us"))
    return documents.match_programme(r, l)


@query("""SELECT rec_id, CASE WHEN rec_id % 3 = 0 THEN 120.0 WHEN rec_id % 5 = 0 THEN 60.0 ELSE greatest(30.0, (rec_id % 100)::DOUBLE) END AS skip_start_s,
    CASE WHEN rec_id % 3 = 0 THEN 180.0 WHEN rec_id % 5 = 0 THEN 0.0 ELSE 45.0 END AS skip_end_s FROM recs""")
def effective_skips(spark, sf_dir):
    r = views.recordings(spark, sf_dir).select("rec_id", "duration_us")
    row = lambda df, source, a, b: df.select("rec_id", F.lit(source).alias("source"), a.cast("double").alias("skip_start_s"), b.cast("double").alias("skip_end_s"))
    us = lambda n: F.lit(n * 1_000_000).cast("long")
    psip = documents.programme_skips(us(0), us(120), us(3300), F.col("duration_us"))
    xds = documents.elapsed_skips(us(60), us(3600), F.col("duration_us"))
    b = row(r, "epg", F.col("rec_id") % 100, F.lit(0)).unionByName(row(r.filter("rec_id % 3 = 0"), "psip", *psip)).unionByName(row(r.filter("rec_id % 5 = 0"), "xds", *xds))
    return documents.effective_skips(r, b, 30, 45)


_INI = """# base
[General]
window_size = 2.0 ; seconds
[Detection]
commercial_threshold=0.38 # shipped
min_commercial_seconds = "60"
[BlackFrame]
weight = 0.60
use_clustering = yes
cluster_max_gap=220
[blackframe]
CLUSTER_MAX_GAP = 200
"""


@query("""SELECT * FROM (VALUES ('base', 2.0::DOUBLE, 0.38::DOUBLE, 60.0::DOUBLE, 0.60::DOUBLE, true, 200.0::DOUBLE), ('late show', 2.0, 0.45, 60.0, 0.55, true, 180.0), ('drama', 2.0, 0.38, 60.0, 0.70, false, 200.0))
    t(profile, window_size, threshold, min_commercial, bf_weight, bf_use_clustering, bf_cluster_max_gap)""")
def ini_overlay(spark, sf_dir):
    over = {"base": "", "late show": "[Detection]\ncommercial_threshold = .45\n[BlackFrame]\nweight=0.55\ncluster_max_gap = 180\n", "drama": "[BlackFrame]\nweight = 0.70;x\nuse_clustering=off\nmin_count = many\n"}
    rows = [(f"{p}|{i}", t) for p, o in over.items() for i, t in enumerate((_INI, o))]
    kv = settings.parse_ini(spark.createDataFrame(rows, "file string, text string"))
    layers = settings.params_of(kv).withColumns({"profile": F.split_part("file", F.lit("|"), F.lit(1)), "layer": F.split_part("file", F.lit("|"), F.lit(2)).cast("int")}).drop("file")
    return settings.overlay(layers).select("profile", "window_size", "threshold", "min_commercial", "bf_weight", "bf_use_clustering", "bf_cluster_max_gap")


# Renderers ------------------------------------------------------------------

CTES["secs"] = "SELECT *, (start_us // 1000000) || '.' || lpad(CAST(start_us % 1000000 // 1000 AS VARCHAR), 3, '0') AS s3, (end_us // 1000000) || '.' || lpad(CAST(end_us % 1000000 // 1000 AS VARCHAR), 3, '0') AS e3, CASE WHEN type = 'Commercial' THEN 'Commercial Break ' ELSE 'Part ' END || type_no AS title FROM num"


def _sql_clock(c: str) -> str:
    two = lambda e: f"lpad(CAST({e} AS VARCHAR), 2, '0')"
    return f"{two(f'{c} // 3600000000')} || ':' || {two(f'{c} // 60000000 % 60')} || ':' || {two(f'{c} // 1000000 % 60')} || '.' || lpad(CAST({c} // 1000 % 1000 AS VARCHAR), 3, '0')"


def _sql_text(line: str, head: str = "''", foot: str = "''", where: str = "true") -> str:
    return f"SELECT r.rec_id, {head} || coalesce(b.t, '') || {foot} AS text FROM recs r LEFT JOIN (SELECT rec_id, string_agg({line}, '' ORDER BY start_us) AS t FROM secs WHERE {where} GROUP BY rec_id) b USING (rec_id)"


@query(_sql_text("s3 || ' ' || e3 || ' 3' || chr(10)", where="type = 'Commercial'"))
def edl_lines(spark, sf_dir):
    return render.edl(_breaks(spark, sf_dir), views.recordings(spark, sf_dir))


@query(_sql_text("CAST(trunc(start_us / 1000000.0::DOUBLE * (30000.0::DOUBLE / 1001)) AS BIGINT) || chr(9) || CAST(trunc(end_us / 1000000.0::DOUBLE * (30000.0::DOUBLE / 1001)) AS BIGINT) || chr(10)", "'FILE PROCESSING COMPLETE  Show ' || r.rec_id || '.ts' || chr(10)", where="type = 'Commercial'"))
def comskip_lines(spark, sf_dir):
    return render.comskip(_breaks(spark, sf_dir), views.recordings(spark, sf_dir))


@query(_sql_text("'    <ChapterAtom>' || chr(10) || '      <ChapterTimeStart>' || " + _sql_clock("start_us") + " || '000000</ChapterTimeStart>' || chr(10) || '      <ChapterTimeEnd>' || " + _sql_clock("end_us") + " || '000000</ChapterTimeEnd>' || chr(10) || CASE WHEN type = 'Commercial' THEN '      <ChapterFlagHidden>1</ChapterFlagHidden>' || chr(10) ELSE '' END || '      <ChapterDisplay>' || chr(10) || '        <ChapterString>' || title || '</ChapterString>' || chr(10) || '        <ChapLanguageIETF>en</ChapLanguageIETF>' || chr(10) || '      </ChapterDisplay>' || chr(10) || '    </ChapterAtom>' || chr(10)", "'<?xml version=\"1.0\" encoding=\"UTF-8\"?>' || chr(10) || '<Chapters>' || chr(10) || '  <EditionEntry>' || chr(10) || '    <EditionFlagDefault>1</EditionFlagDefault>' || chr(10)", "'  </EditionEntry>' || chr(10) || '</Chapters>' || chr(10)"))
def mkv_chapters(spark, sf_dir):
    return render.mkv_chapters(_breaks(spark, sf_dir), views.recordings(spark, sf_dir))


@query(_sql_text("'[CHAPTER]' || chr(10) || 'TIMEBASE=1/1000' || chr(10) || 'START=' || (start_us // 1000) || chr(10) || 'END=' || (end_us // 1000) || chr(10) || 'title=' || title || chr(10)", "';FFMETADATA1' || chr(10)"))
def ffmeta(spark, sf_dir):
    return render.ffmetadata(_breaks(spark, sf_dir), views.recordings(spark, sf_dir))


@query(_sql_text("'[CHAPTER]' || chr(10) || 'TIMEBASE=1/1000' || chr(10) || 'START=' || (start_us // 1000) || chr(10) || 'END=' || (end_us // 1000) || chr(10) || 'title=' || CASE WHEN type = 'Commercial' THEN 'Ad ' || type_no ELSE 'Teil ' || type_no || ' von allen' END || chr(10)", "';FFMETADATA1' || chr(10)"))
def labelled_ffmeta(spark, sf_dir):
    return render.ffmetadata(_breaks(spark, sf_dir), views.recordings(spark, sf_dir), "Teil {number} von allen", "Ad {number}")


@query("""SELECT rec_id, '/rec/show ' || (rec_id % 20) || '/Show ' || rec_id || '.ts' AS source, '01:00:00' AS total, '1920x1080' AS resolution, count(*) AS n, round(sum(end_us - start_us) / 1000000.0, 3)::DOUBLE AS seconds, string_agg(type, ',' ORDER BY start_us) AS types FROM num GROUP BY rec_id""")
def json_result(spark, sf_dir):
    """The rendered JSON read back."""
    j = render.json_result(_breaks(spark, sf_dir), views.recordings(spark, sf_dir))
    back = F.from_json("text", "sourceFile string, totalDuration string, resolution string, segments array<struct<start: double, end: double, duration: double, type: string, confidence: double>>")
    total = F.aggregate("r.segments", F.lit(0.0), lambda a, s: a + s["duration"])
    return j.withColumn("r", back).select("rec_id", F.col("r.sourceFile").alias("source"), F.col("r.totalDuration").alias("total"), "r.resolution", F.size("r.segments").cast("bigint").alias("n"), F.round(total, 3).alias("seconds"), F.array_join(F.transform("r.segments", lambda s: s["type"]), ",").alias("types"))


def _sql_file(name: str, fmt: str, ext: str) -> str:
    return f"SELECT rec_id, '{fmt}' AS format, '/rec/show ' || (rec_id % 20) || '/Show ' || rec_id || '{ext}' AS path, text FROM ({_TEXT[name]})"


@query(_sql_file("edl_lines", "Edl", ".edl") + " UNION ALL " + _sql_file("ffmeta", "FFMetadata", ".ffmeta") + " UNION ALL " + _sql_file("comskip_lines", "ComskipTxt", ".txt") + " WHERE rec_id % 2 = 1")
def writer_dispatch(spark, sf_dir):
    """Two formats of every recording, a third of some, from one pass over the segments."""
    formats = F.when(F.col("rec_id") % 2 == 1, F.array(*map(F.lit, ("Edl", "FFMetadata", "ComskipTxt", "Edl")))).otherwise(F.array(F.lit("FFMetadata"), F.lit("Edl")))
    return render.render(_breaks(spark, sf_dir), views.recordings(spark, sf_dir), formats)


# Cut plans ------------------------------------------------------------------


@query("""SELECT rec_id, seg, '/tmp/Show ' || rec_id || '_seg' || lpad(CAST(seg AS VARCHAR), 3, '0') || '.ts' AS seg_path,
    '-hide_banner -loglevel warning -y -ss ' || """ + _sql_clock("start_us") + """ || ' -i "/rec/show ' || (rec_id % 20) || '/Show ' || rec_id || '.ts" -t ' || """ + _sql_clock("(end_us - start_us)") + """ || ' -c copy -avoid_negative_ts make_zero "/tmp/Show ' || rec_id || '_seg' || lpad(CAST(seg AS VARCHAR), 3, '0') || '.ts"' AS args
    FROM (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY start_us) - 1 AS seg FROM num WHERE type = 'Program')""")
def cut_segments(spark, sf_dir):
    return cutplan.segment_plan(_breaks(spark, sf_dir), views.recordings(spark, sf_dir), cutplan.CutParams())


@query("""SELECT rec_id, '/rec/show ' || (rec_id % 20) || '/Show ' || rec_id || '.cut.mkv' AS out_path, '-hide_banner -loglevel warning -y -i "/rec/show ' || (rec_id % 20) || '/Show ' || rec_id || '.ts" -filter_complex "' || v || ';' || a || ';' || c || 'concat=n=' || n || ':v=1:a=1[outv][outa];[outv]yadif[outv2]" -map "[outv2]" -map "[outa]" -c:v hevc_nvenc -cq 23 -c:a aac -b:a 128k -map_metadata 0 "/rec/show ' || (rec_id % 20) || '/Show ' || rec_id || '.cut.mkv"' AS args
    FROM (SELECT rec_id, count(*) AS n, string_agg('[0:v]trim=start=' || s3 || ':end=' || e3 || ',setpts=PTS-STARTPTS[v' || seg || ']', ';' ORDER BY seg) AS v, string_agg('[0:a]atrim=start=' || s3 || ':end=' || e3 || ',asetpts=PTS-STARTPTS[a' || seg || ']', ';' ORDER BY seg) AS a, string_agg('[v' || seg || '][a' || seg || ']', '' ORDER BY seg) AS c
    FROM (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY start_us) - 1 AS seg FROM secs WHERE type = 'Program') GROUP BY rec_id)""")
def cut_args(spark, sf_dir):
    p = cutplan.CutParams(mode="Cut", method="Reencode", container="Mkv", video_codec="libx265", hw_accel="Nvenc", crf=23, audio_codec="aac", audio_bitrate="128k", deinterlace="Yadif", name_pattern="{name}.{mode}.{ext}")
    return cutplan.graph_plan(_breaks(spark, sf_dir), views.recordings(spark, sf_dir), p, TODAY)


@query("""SELECT rec_id, '-hide_banner -loglevel warning -y -i "' || path || '" -i "' || path || '.meta" -map_metadata 1 -map_chapters 1 -c copy "/rec/show ' || (rec_id % 20) || '/Show ' || rec_id || '.cut.ts"' AS chapter, 'ffmpeg' AS tool,
    '-hide_banner -loglevel warning -y -f concat -safe 0 -i "/tmp/list.txt" -c copy -c:s copy "/o.ts"' AS concat, '-hide_banner -loglevel warning -y -i "' || path || '" -map 0 -c copy -map_metadata 0 -metadata comment="Processed by spotseam on 2024-06-01" -c:s copy "/o.ts"' AS remux FROM recs""")
def plan_args(spark, sf_dir):
    p = cutplan.CutParams(name_pattern="{name}.{ext}", processing_info=True)
    r, path = views.recordings(spark, sf_dir), F.col("path")
    return r.select("rec_id", cutplan.chapter_args(path, F.concat(path, F.lit(".meta")), cutplan.output_path(path, p, TODAY), p).alias("chapter"), cutplan.chapter_tool(path, p, True).alias("tool"), cutplan.concat_args("/tmp/list.txt", "/o.ts", p).alias("concat"), cutplan.remux_args(path, "/o.ts", p, TODAY).alias("remux"))


@query("SELECT rec_id, s AS step FROM recs, (VALUES ('chapter'), ('cut')) v(s)")
def mode_steps(spark, sf_dir):
    return cutplan.steps(views.recordings(spark, sf_dir), cutplan.CutParams(mode="Both"))


# Reports --------------------------------------------------------------------

CTES["runs_of"] = "SELECT o_custkey, o_orderdate, o_orderkey, 'Show_' || o_custkey || '_' || strftime(o_orderdate, '%Y%m%d_%H%M%S') || '.edl' AS name FROM orders"


def _entries(spark, sf_dir) -> DataFrame:
    o = views.table(spark, sf_dir, "orders")
    path = F.concat(F.lit("/edl/"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0"), F.lit("/Show_"), F.col("o_custkey").cast("string"), F.lit("_"), F.date_format("o_orderdate", "yyyyMMdd_HHmmss"), F.lit(".edl"))
    return files.archive_entries(o.select(path.alias("path")))


@query("SELECT 'Show_' || o_custkey AS show, strftime(max(o_orderdate), '%Y%m%d_%H%M%S') AS run_ts, arg_min(o_orderkey, (-epoch_us(o_orderdate), o_orderkey)) AS orderkey FROM orders GROUP BY o_custkey")
def latest_run(spark, sf_dir):
    return report.latest_runs(_entries(spark, sf_dir)).select("show", "run_ts", F.split_part("path", F.lit("/"), F.lit(3)).cast("bigint").alias("orderkey"))


@query("SELECT count(*) AS n, count(DISTINCT 'Show_' || o_custkey) AS shows FROM orders WHERE 'show_' || o_custkey LIKE '%w_12%'")
def show_filter(spark, sf_dir):
    return report.named(_entries(spark, sf_dir), "W_12").agg(F.count("*").alias("n"), F.count_distinct("show").alias("shows"))


CTES["breaks"] = "SELECT 'show \"' || (rec_id % 20) || '\"' AS \"show\", rec_id, start_us, end_us FROM fin WHERE type = 'Commercial'"


def _edl(spark, sf_dir) -> DataFrame:
    """Edit lists rendered and read back, one line a row."""
    t = render.edl(_breaks(spark, sf_dir), views.recordings(spark, sf_dir))
    lines = t.select(F.concat(F.lit('show "'), (F.col("rec_id") % 20).cast("string"), F.lit('"')).alias("show"), "rec_id", F.explode(F.split("text", "\n")).alias("line"))
    return files.edl_lines(lines)


@query("""SELECT s."show", count(b.rec_id) AS det_breaks, '"' || replace(s."show", '"', '""') || '",' || count(b.rec_id) || ',,' AS line FROM (SELECT DISTINCT 'show "' || (rec_id % 20) || '"' AS "show" FROM recs) s LEFT JOIN breaks b USING ("show") GROUP BY s."show" """)
def shows_report(spark, sf_dir):
    shows = views.recordings(spark, sf_dir).select(F.concat(F.lit('show "'), (F.col("rec_id") % 20).cast("string"), F.lit('"')).alias("show"))
    return report.shows_report(shows, _edl(spark, sf_dir))


def _sql_report(c: str) -> str:
    return f"CASE WHEN {c} >= 3600000000 THEN ({c} // 3600000000) || ':' || lpad(CAST({c} // 60000000 % 60 AS VARCHAR), 2, '0') ELSE CAST({c} // 60000000 AS VARCHAR) END || ':' || lpad(CAST({c} // 1000000 % 60 AS VARCHAR), 2, '0')"


@query(f"""SELECT "show", n AS break_no, a AS det_start, e AS det_end, '"' || replace("show", '"', '""') || '",' || n || ',' || a || ',' || e || ',,,' AS line FROM (SELECT "show", row_number() OVER (PARTITION BY "show" ORDER BY start_us, end_us) AS n, {_sql_report("start_us")} AS a, {_sql_report("end_us")} AS e FROM breaks)""")
def breaks_report(spark, sf_dir):
    return report.breaks_report(_edl(spark, sf_dir))


EPISODE_SQL = """SELECT name, row_number() OVER (ORDER BY prefix, season, episode, name) AS pos FROM (SELECT 'Part ' || (p_size % 3) || CASE WHEN p_partkey % 4 = 0 THEN ' special ' || p_partkey ELSE ' s0' || (p_size % 8) || 'E0' || (p_partkey % 10) || ' ' || p_partkey END AS name,
    CASE WHEN p_partkey % 4 = 0 THEN 'Part ' || (p_size % 3) || ' special ' || p_partkey ELSE 'Part ' || (p_size % 3) || ' ' END AS prefix, CASE WHEN p_partkey % 4 = 0 THEN 9999 ELSE p_size % 8 END AS season, CASE WHEN p_partkey % 4 = 0 THEN 9999 ELSE p_partkey % 10 END AS episode FROM part)"""


def _episodes(p: DataFrame) -> DataFrame:
    """Names of parts as of episodes, with their sort keys."""
    s, k = (F.col("p_size") % 3).cast("string"), F.col("p_partkey").cast("string")
    name = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("Part "), s, F.lit(" special "), k)).otherwise(F.concat(F.lit("Part "), s, F.lit(" s0"), (F.col("p_size") % 8).cast("string"), F.lit("E0"), (F.col("p_partkey") % 10).cast("string"), F.lit(" "), k))
    return report.by_episode(p.select(name.alias("name")), F.col("name"))


@query(EPISODE_SQL)
def episode_sort(spark, sf_dir):
    return report.numbered(_episodes(views.table(spark, sf_dir, "part")), "prefix", "season", "episode", "name").select("name", "pos")


@query("SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS passed, count(*) FILTER (WHERE o_orderstatus <> 'F') AS failed FROM orders")
def batch_outcomes(spark, sf_dir):
    return report.outcomes(views.table(spark, sf_dir, "orders").select((F.col("o_orderstatus") == "F").alias("ok")))


@query("SELECT rec_id, 'Results: ' || count(*) FILTER (WHERE type = 'Commercial') || ' commercial break(s) detected' || chr(10) || 'Total commercial time: ' || printf('%.1f', coalesce(sum((end_us - start_us) / 1000000.0) FILTER (WHERE type = 'Commercial'), 0.0)::DOUBLE) || 's' || chr(10) AS text FROM fin GROUP BY rec_id")
def run_summary(spark, sf_dir):
    return report.summary(segments.totals(_breaks(spark, sf_dir)))


@query("""SELECT event_id, CASE event_type WHEN 'view' THEN 'info' WHEN 'error' THEN 'fail' WHEN 'click' THEN 'dbug' ELSE '????' END || ': Detector[' || (event_id % 7) || ']' || chr(10) || '      user ' || user_id || chr(10)
    || CASE WHEN event_type = 'error' THEN '      at ' || event_id || chr(10) ELSE '' END AS text FROM events WHERE event_type <> 'signup'""")
def log_lines(spark, sf_dir):
    e, t = views.table(spark, sf_dir, "events"), F.col("event_type")
    level = F.when(t == "view", "Information").when(t == "error", "Error").when(t == "click", "Debug").when(t == "signup", "None").otherwise("Other")
    rows = e.select("event_id", level.alias("level"), F.lit("Detector").alias("category"), (F.col("event_id") % 7).alias("id"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("message"), F.when(t == "error", F.concat(F.lit("at "), F.col("event_id").cast("string"))).alias("exception"))
    shown = report.log_lines(rows.withColumn("key", F.col("event_id")).withColumn("event_id", F.col("id")))
    return shown.select(F.col("key").alias("event_id"), "text")


@query("""SELECT folder, 'Dry run — ' || count(*) || ' file(s) in ' || chr(39) || folder || chr(39) || ' (sort: episode):' || chr(10) || string_agg('  ' || name || chr(10), '' ORDER BY k, folder || '/' || name) AS text
    FROM (SELECT '/rec/' || (p_size % 20) AS folder, CASE WHEN p_partkey % 4 = 0 THEN 'special ' || p_partkey ELSE 'Show s0' || (p_size % 8) || 'E0' || (p_partkey % 10) || ' ' || p_partkey END || '.ts' AS name, CASE WHEN p_partkey % 4 = 0 THEN 99999999 ELSE p_size % 8 * 10000 + p_partkey % 10 END AS k FROM part) GROUP BY folder""")
def dry_run(spark, sf_dir):
    p, k = views.table(spark, sf_dir, "part"), F.col("p_partkey").cast("string")
    name = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("special "), k)).otherwise(F.concat(F.lit("Show s0"), (F.col("p_size") % 8).cast("string"), F.lit("E0"), (F.col("p_partkey") % 10).cast("string"), F.lit(" "), k))
    return report.dry_run(p.select(F.concat(F.lit("/rec/"), (F.col("p_size") % 20).cast("string"), F.lit("/"), name, F.lit(".ts")).alias("path")))


@query("SELECT rec_id, signal FROM (SELECT rec_id, signal, row_number() OVER (PARTITION BY rec_id ORDER BY count(*) DESC, min(CASE signal WHEN 'BlackFrame' THEN 0 WHEN 'SceneChange' THEN 1 WHEN 'Silence' THEN 2 WHEN 'LogoAbsence' THEN 3 ELSE 4 END)) AS n FROM ev GROUP BY rec_id, signal) WHERE n = 1")
def reference_signal(spark, sf_dir):
    order = F.array_position(F.array(*map(F.lit, detect.SIGNALS)), F.col("signal"))
    return score.reference_signal(_events(spark, sf_dir).groupBy("rec_id", "signal").agg(F.count("*").alias("n")).withColumn("ord", order))


@query("""SELECT path FROM (SELECT path, row_number() OVER (PARTITION BY lower(path) ORDER BY layer, n) AS k FROM (SELECT '/Set/' || (c_custkey % 50) AS path, 0 AS layer, c_custkey AS n FROM customer
    UNION ALL SELECT '/set/' || (s_suppkey % 70), 1, s_suppkey FROM supplier WHERE s_suppkey % 70 % 2 = 0)) WHERE k = 1""")
def recording_dirs(spark, sf_dir):
    named = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ord"), F.concat(F.lit("/Set/"), (F.col("c_custkey") % 50).cast("string")).alias("path"))
    usual = views.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ord"), F.concat(F.lit("/set/"), (F.col("s_suppkey") % 70).cast("string")).alias("path"))
    there = spark.range(0, 70, 2).select(F.concat(F.lit("/set/"), F.col("id").cast("string")).alias("path"))
    return documents.recording_dirs(named, usual, there).select("path")


# Files ----------------------------------------------------------------------


@query("""SELECT page_id, url FROM pages WHERE regexp_matches(lower(regexp_replace(url, '^.*[/\\\\]', '')), '\\.html$') AND NOT regexp_matches(lower(regexp_replace(url, '^.*[/\\\\]', '')), '^7.*\\.html$')""")
def glob_filter(spark, sf_dir):
    p = views.table(spark, sf_dir, "pages").select("page_id", "url")
    return p.filter(files.is_media(F.col("url"), (".html",)) & ~files.excluded(F.col("url"), ["7*.HTML", "?"]))


_NAMES = (".ts", ".MPG", ".mpeg", ".mp4", ".mkv", ".avi", ".wtv", ".m4v", ".Mov", ".m2ts", ".mts", ".html", ".ts.part", "")


@query(f"""SELECT '/rec/' || (page_id % 9) AS folder, count(*) FILTER (WHERE page_id % {len(_NAMES)} < 9) AS n_media FROM pages GROUP BY 1""")
def media_per_folder(spark, sf_dir):
    """Names with the nine extensions of recordings, in any case, and five that are none."""
    ext = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("page_id") % len(_NAMES) + 1).cast("int"))
    path = F.concat(F.lit("/rec/"), (F.col("page_id") % 9).cast("string"), F.lit("/x"), F.col("page_id").cast("string"), ext)
    return report.media_per_folder(views.table(spark, sf_dir, "pages").select(path.alias("path")))


@query("SELECT rec_id, path FROM recs WHERE rec_id % 3 <> 0 AND rec_id % 5 <> 0")
def anti_processed(spark, sf_dir):
    r = views.recordings(spark, sf_dir).select("rec_id", "path")
    done = r.filter("rec_id % 3 = 0").select(x.with_extension(F.col("path"), ".edl").alias("path"), F.lit(None).cast("string").alias("first_line"))
    told = r.filter("rec_id % 5 = 0").select(x.with_extension(F.col("path"), ".txt").alias("path"), F.lit("FILE PROCESSING COMPLETE  x").alias("first_line"))
    other = r.filter("rec_id % 7 = 0").select(x.with_extension(F.col("path"), ".txt").alias("path"), F.lit("notes").alias("first_line"))
    return files.unprocessed(r, done.unionByName(told).unionByName(other))


@query("SELECT lower(regexp_extract(url, '^[^?#]*')) AS key, arg_min(regexp_extract(url, '^[^?#]*'), page_id) AS path FROM pages GROUP BY 1")
def distinct_ci(spark, sf_dir):
    p = views.table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[^?#]*", 0).alias("path"))
    return documents.distinct_paths(p, "page_id").select(F.lower("path").alias("key"), "path")


@query("""SELECT page_id, regexp_replace(url, '^.*[/\\\\]', '') AS base, regexp_replace(regexp_replace(url, '^.*[/\\\\]', ''), '\\.[^.]*$', '') AS stem, regexp_replace(regexp_replace(url, '^.*[/\\\\]', ''), '["<>|:*?\\\\/]', '_', 'g') AS safe FROM pages""")
def path_functions(spark, sf_dir):
    u = F.col("url")
    return views.table(spark, sf_dir, "pages").select("page_id", x.basename(u).alias("base"), x.stem(u).alias("stem"), x.safe_name(x.basename(u)).alias("safe"))


@query(f"""SELECT event_id, {_sql_clock("t_us")} || '000000' AS mkv, {_sql_clock("t_us")} AS clock, {_sql_report("t_us")} AS report, ((t_us + 500) // 1000 // 1000) || '.' || lpad(CAST((t_us + 500) // 1000 % 1000 AS VARCHAR), 3, '0') AS f3, CAST(trunc(t_us / 1000000.0::DOUBLE * (30000.0::DOUBLE / 1001)) AS BIGINT) AS frame FROM ev""")
def time_functions(spark, sf_dir):
    t = F.col("t_us")
    return _events(spark, sf_dir).select("event_id", x.mkv_time(t).alias("mkv"), x.clock(t).alias("clock"), x.report_time(t / 1e6).alias("report"), x.seconds3(t).alias("f3"), x.frame(t, F.lit(views.FPS)).alias("frame"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN false ELSE true END AS flag, CASE event_id % 3 WHEN 0 THEN 'VideoToolbox' WHEN 1 THEN 'Nvenc' ELSE 'None' END AS accel, 'a|b c' AS items FROM events""")
def setting_functions(spark, sf_dir):
    e, k = views.table(spark, sf_dir, "events"), F.col("event_id")
    word = F.element_at(F.array(*map(F.lit, ("Yes", " ON ", "no", "0", "maybe"))), (k % 5 + 1).cast("int"))
    accel = F.element_at(F.array(*map(F.lit, ("video_toolbox", "NVENC", "cuda"))), (k % 3 + 1).cast("int"))
    return e.select("event_id", x.switch(word, True).alias("flag"), x.choice(accel, ["None", "Nvenc", "VideoToolbox"], "None").alias("accel"), F.array_join(x.items(F.lit(" a,, b c ,")), "|").alias("items"))


# Watching -------------------------------------------------------------------


@query("""SELECT '/w/' || user_id || '-' || event_type || '.ts' AS path, min(epoch_us(ts)) + 86400000000 AS ready_us FROM (SELECT *, coalesce(epoch_us(lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts)), 1706745600000000) - epoch_us(ts) AS rest FROM events) WHERE rest >= 86400000000 GROUP BY 1""")
def stability_debounce(spark, sf_dir):
    e = views.table(spark, sf_dir, "events").select(F.concat(F.lit("/w/"), F.col("user_id").cast("string"), F.lit("-"), "event_type", F.lit(".ts")).alias("path"), F.lit("changed").alias("event"), F.lit(None).cast("string").alias("old_path"), F.to_timestamp("ts").alias("observed_at"), F.lit(10).cast("long").alias("size"))
    until = F.timestamp_micros(F.lit(1_706_745_600_000_000))
    return watch.stable_batch(e, 86_400, until).select("path", F.unix_micros("ready_at").alias("ready_us"))


# Programme boundaries in transport streams: bytes, not SQL -------------------


def _packets(section, pid: int):
    """A table section as one transport packet."""
    body = F.concat(F.to_binary(F.lit(f"47{0x40 | pid >> 8:02X}{pid & 0xFF:02X}1000"), F.lit("hex")), section)
    return F.rpad(body, 188, F.lit(bytes([0xFF])))


@query("""SELECT rec_id, (1704067182 + rec_id * 60) * 1000000 AS rec_start_us, (1704067302 + rec_id * 60) * 1000000 AS prog_start_us, 3600 AS prog_len_s, lpad(CAST(rec_id AS VARCHAR), 6, '0') AS title FROM recs""")
def psip_scan(spark, sf_dir):
    """Two time tables, 4,000 seconds apart, and a listing of one programme for each recording, as bytes, and what the scanner finds in them: the first table counts."""
    gps = F.lit(1_388_102_400) + F.col("rec_id") * 60
    be = lambda c, n: F.to_binary(F.lpad(F.hex(c), 2 * n, "0"), F.lit("hex"))
    hx = lambda s: F.to_binary(F.lit(s), F.lit("hex"))
    stt = F.concat(hx("CD B011 00".replace(" ", "")), be(gps, 4), hx("12" + "00" * 11))
    later = F.concat(hx("CDB01100"), be(gps + 4000, 4), hx("12" + "00" * 11))
    title = F.encode(F.lpad(F.col("rec_id").cast("string"), 6, "0"), "ISO-8859-1")
    event = F.concat(hx("0001"), be(gps + 120, 4), be(F.lit(0x300000 + 3600), 3), hx("0E01656E67010000" + "06"), title, hx("0000"))
    eit = F.concat(hx("CBF02A" + "00" * 6 + "01"), event, hx("00" * 8))
    r = views.recordings(spark, sf_dir).select("rec_id", F.concat(_packets(stt, broadcast.PSIP_PID), _packets(later, broadcast.PSIP_PID), _packets(eit, broadcast.PSIP_PID)).alias("content"))
    return broadcast.psip(r).select("rec_id", F.unix_micros("rec_start").alias("rec_start_us"), F.unix_micros("prog_start").alias("prog_start_us"), "prog_len_s", "title")


@query("SELECT rec_id, CAST(NULL AS VARCHAR) AS name, 3600 + rec_id % 60 * 60 AS prog_len_s, 300 AS elapsed_s FROM recs")
def xds_scan(spark, sf_dir):
    """A programme map, and captions with a length, in one video packet for each recording."""
    hx = lambda s: F.to_binary(F.lit(s), F.lit("hex"))
    pat = _packets(hx("00B00D0001C100000001E100" + "00000000"), 0)
    pmt = _packets(hx("02B0120001C10000E101F0001BE101F000" + "00000000"), 0x100)
    minutes = F.to_binary(F.lpad(F.hex(F.lit(0x20) + F.col("rec_id") % 60), 2, "0"), F.lit("hex"))
    pairs = F.concat(hx("040102" + "0421"), minutes, hx("04" + "2025" + "040F00"))
    video = F.concat(hx("47410110" + "000001E00000800000" + "000001B247413934" + "0344FF"), pairs)
    content = F.concat(pat, pmt, F.rpad(video, 188, F.lit(bytes([0]))))
    return broadcast.xds(views.recordings(spark, sf_dir).select("rec_id", content.alias("content")))
