"""Queries of reducers, histograms and the frequency domain."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import samples as s
from ..operators import bands, frequency, reducers
from .images import EMB, HEAT, OTHER, RAMP, RGB, U8, Catalogue, emb, heat, other, ramp, rgb, u8
from .spatial_plans import near


def _r(c: str):
    return F.round(F.col(c).cast("double"), 6).alias(c)


def register(c: Catalogue) -> None:
    t = c.table
    t("avg", lambda k, d: reducers.avg(emb(k, d)).select(_r("avg")), f"SELECT round(avg(v), 6) AS avg FROM {EMB}")
    t("deviate", lambda k, d: reducers.deviate(emb(k, d)).select(_r("deviate")), f"SELECT round(stddev_samp(v), 6) AS deviate FROM {EMB}")
    t("min", lambda k, d: reducers.minimum(u8(k, d)), f"SELECT v, x, y, 0 AS band FROM {U8} ORDER BY v, y, x LIMIT 1")
    t("max", lambda k, d: reducers.maximum(u8(k, d)), f"SELECT v, x, y, 0 AS band FROM {U8} ORDER BY v DESC, y, x LIMIT 1")
    flat = f"(SELECT y, x, 0 AS band, r AS v FROM {RGB} UNION ALL SELECT y, x, 1, g FROM {RGB} UNION ALL SELECT y, x, 2, b FROM {RGB})"
    one = "min(v) AS min, max(v) AS max, CAST(sum(v) AS BIGINT) AS sum, CAST(sum(v * v) AS BIGINT) AS sum_sq, round(avg(v), 6) AS avg, round(stddev_samp(v), 6) AS stddev, first(x ORDER BY v, y, x) AS x_min, first(y ORDER BY v, y, x) AS y_min, first(x ORDER BY v DESC, y, x) AS x_max, first(y ORDER BY v DESC, y, x) AS y_max"
    t("stats", lambda k, d: reducers.stats(rgb(k, d)).select("row", "min", "max", F.col("sum").cast("long").alias("sum"), F.col("sum_sq").cast("long").alias("sum_sq"), _r("avg"), _r("stddev"), "x_min", "y_min", "x_max", "y_max"), f"SELECT 0 AS row, {one} FROM {flat} UNION ALL SELECT band + 1, {one} FROM {flat} GROUP BY band")
    t("image_stats", lambda k, d: reducers.image_stats(rgb(k, d)).select("band", "min", "max", _r("mean"), _r("stddev")), f"SELECT band, min(v) AS min, max(v) AS max, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS stddev FROM {flat} GROUP BY band")
    t("getpoint", lambda k, d: reducers.getpoint(ramp(k), [(5, 7)]).select("band", "v"), f"SELECT 0 AS band, v FROM {RAMP} WHERE x = 5 AND y = 7")
    t("getpoint_batch", lambda k, d: reducers.getpoint(ramp(k), [(5, 7), (1, 1), (63, 47)]), f"SELECT ordinal, 0 AS band, v FROM {RAMP} JOIN (VALUES (0, 5, 7), (1, 1, 1), (2, 63, 47)) p(ordinal, x, y) USING (x, y)")
    t("measure", lambda k, d: reducers.measure(rgb(k, d)).select("band", _r("mean")), f"SELECT band, round(avg(v), 6) AS mean FROM {flat} GROUP BY band")
    box = f"(SELECT y, x, CASE WHEN x BETWEEN 11 AND 30 AND y BETWEEN 9 AND 25 THEN v + 1 ELSE 0 END AS v FROM {RAMP})"
    boxed = lambda k: ramp(k).with_df(ramp(k).df.withColumn("v", F.when(F.col("x").between(11, 30) & F.col("y").between(9, 25), F.col("v") + 1).otherwise(0)))
    t("find_trim", lambda k, d: reducers.find_trim(boxed(k), 0, [0]), f"SELECT min(x) AS left, min(y) AS top, max(x) - min(x) + 1 AS width, max(y) - min(y) + 1 AS height FROM {box} WHERE v > 0".replace("AS left", 'AS "left"'))
    t("project", lambda k, d: reducers.project(ramp(k)), f"SELECT 0 AS band, x AS place, CAST(sum(v) AS BIGINT) AS sum, 'column' AS axis FROM {RAMP} GROUP BY x UNION ALL SELECT 0, y, CAST(sum(v) AS BIGINT), 'row' FROM {RAMP} GROUP BY y")
    t("profile", lambda k, d: reducers.profile(boxed(k)), f"SELECT 0 AS band, x AS place, coalesce(min(CASE WHEN v <> 0 THEN y END), 48) AS first, 'column' AS axis FROM {box} GROUP BY x UNION ALL SELECT 0, y, coalesce(min(CASE WHEN v <> 0 THEN x END), 64), 'row' FROM {box} GROUP BY y".replace("AS first", 'AS "first"'))
    dense = lambda q: f"SELECT CAST(i AS INT) AS bin, coalesce(n, 0) AS count FROM range(0, 256) t(i) LEFT JOIN ({q}) ON b = i"
    h8 = dense(f"SELECT v AS b, count(*) AS n FROM {U8} GROUP BY v")
    t("hist_find", lambda k, d: reducers.hist_find(u8(k, d)), f"SELECT 0 AS band, * FROM ({h8})")
    t("hist_find_reducer", lambda k, d: reducers.hist_find_scaled(u8(k, d), 0, 64), f"SELECT CAST(i AS INT) AS bin, coalesce(n, 0) AS count FROM range(0, 64) t(i) LEFT JOIN (SELECT least(63, floor(v / 255.0e0 * 64)) AS b, count(*) AS n FROM {U8} GROUP BY 1) ON b = i")
    t("hist_find_ndim", lambda k, d: reducers.hist_find_ndim(rgb(k, d), 4), f"SELECT CAST(r // 64 AS INT) AS bin0, CAST(g // 64 AS INT) AS bin1, CAST(b // 64 AS INT) AS bin2, count(*) AS count FROM {RGB} GROUP BY 1, 2, 3")
    t("hist_find_indexed", lambda k, d: reducers.hist_find_indexed(ramp(k), other(k), 100), f"SELECT 0 AS band, least(100, o.v) AS bin, count(*) AS count FROM {RAMP} r JOIN {OTHER} o USING (y, x) GROUP BY 2")
    cdf = f"(SELECT bin, count, sum(count) OVER (ORDER BY bin) AS cum, sum(count) OVER () AS n FROM ({h8}))"
    lut = f"(SELECT bin, CAST(floor(greatest(0, (cum - m) / CAST(n - m AS DOUBLE)) * 255 + 0.5) AS INT) AS v FROM {cdf}, (SELECT min(cum) AS m FROM {cdf} WHERE count > 0))"
    hb = dense(f"SELECT least(255, floor(v / 255.0e0 * 256)) AS b, count(*) AS n FROM {U8} GROUP BY 1")
    cdfb = cdf.replace(h8, hb)
    lutb = lut.replace(h8, hb)
    t("hist_equal_lut", lambda k, d: reducers.hist_equal_lut(u8(k, d)), f"SELECT bin, v FROM {lutb}")
    c.image("hist_equal", lambda k, d: reducers.hist_equal(u8(k, d)), f"SELECT y, x, l.v AS v FROM {U8} a JOIN {lutb} l ON l.bin = a.v")
    hf = lambda k, d: reducers.hist_find(u8(k, d))
    t("hist_cum", lambda k, d: reducers.hist_cum(hf(k, d)), f"SELECT 0 AS band, bin, CAST(cum AS BIGINT) AS count FROM {cdf}")
    t("hist_norm", lambda k, d: reducers.hist_norm(hf(k, d)).select("band", "bin", _r("count")), f"SELECT 0 AS band, bin, round(count / CAST(max(count) OVER () AS DOUBLE) * 255, 6) AS count FROM ({h8})")
    t("hist_percent", lambda k, d: reducers.hist_percent(hf(k, d), 0.3), f"SELECT 0 AS band, min(bin) AS bin FROM {cdf} WHERE cum >= n * 0.3e0")
    t("hist_entropy", lambda k, d: reducers.hist_entropy(hf(k, d)).select("band", _r("entropy")), f"SELECT 0 AS band, round(-sum(count / CAST(n AS DOUBLE) * log2(count / CAST(n AS DOUBLE))), 6) AS entropy FROM {cdf} WHERE count > 0")
    t("hist_ismonotonic", lambda k, d: reducers.hist_ismonotonic(reducers.hist_cum(hf(k, d))), "SELECT 0 AS band, 1 AS monotonic")
    t("hist_plot", lambda k, d: reducers.hist_plot(hf(k, d), 32), f"SELECT 0 AS band, CAST(j AS INT) AS y, bin AS x, CASE WHEN 31 - j <= floor(count / CAST(max(count) OVER () AS DOUBLE) * 31 + 0.5) THEN 255 ELSE 0 END AS v FROM ({h8}), range(0, 32) u(j)")
    match = f"""SELECT 0 AS band, s.bin, CASE WHEN b.c IS NULL THEN a.bin WHEN a.c IS NULL THEN b.bin WHEN s.c - b.c < a.c - s.c THEN b.bin ELSE a.bin END AS v
        FROM (SELECT bin, cum AS c FROM {cdf}) s LEFT JOIN LATERAL (SELECT min(cum) AS c, min(bin) AS bin FROM (SELECT cum, bin FROM {{t}} WHERE cum >= s.c ORDER BY cum, bin LIMIT 1)) a ON true
        LEFT JOIN LATERAL (SELECT min(cum) AS c, min(bin) AS bin FROM (SELECT cum, bin FROM {{t}} WHERE cum < s.c ORDER BY cum DESC, bin DESC LIMIT 1)) b ON true"""
    inv = dense(f"SELECT 255 - v AS b, count(*) AS n FROM {U8} WHERE v > 20 GROUP BY 1")
    target = lambda k, d: reducers.hist_cum(reducers.hist_find(u8(k, d).with_df(u8(k, d).df.where("v > 20")).map(lambda v: F.lit(255) - v)))
    t("hist_match", lambda k, d: reducers.hist_match(reducers.hist_cum(hf(k, d)), target(k, d)), match.format(t=cdf.replace(h8, inv)))
    w5 = [[1] * 5 for _ in range(3)]
    c.image("stdif", lambda k, d: reducers.stdif(ramp(k), 5, 3, 0.5, 128, 0.5, 50), f"SELECT y, x, floor(greatest(0, least(255, (v - m) * (0.5e0 * 50 / (50 + 0.5e0 * sd)) + 0.5e0 * 128 + 0.5e0 * m)) + 0.5) AS v FROM (SELECT y, x, first(v) AS v, avg(w) AS m, sqrt(greatest(0, avg(w * w) - avg(w) * avg(w))) AS sd FROM {near(w5)} GROUP BY y, x)")
    c.image("clahe", lambda k, d: reducers.clahe(ramp(k), 5, 3), f"SELECT y, x, floor(sum(CASE WHEN w <= v THEN 1 ELSE 0 END) * 255 / 15.0e0 + 0.5) AS v FROM {near(w5)} GROUP BY y, x")
    c.image("clahe_clipped", lambda k, d: reducers.clahe(ramp(k), 5, 3, 2.0), None)
    t("heat_column_sums", lambda k, d: reducers.project(heat(k, d)).where("axis = 'column'").select("place", "sum"), f"SELECT x AS place, CAST(sum(v) AS BIGINT) AS sum FROM {HEAT} GROUP BY x")
    rho = "floor(((x * cos(t * pi() / 36) + y * sin(t * pi() / 36)) / 80.0e0 + 1) * 0.5 * 49 + 0.5)"
    t("hough_line", lambda k, d: reducers.hough_line(ramp(k), 36, 50, 240), f"SELECT CAST(t AS INT) AS theta, CAST({rho} AS INT) AS rho, count(*) AS votes FROM {RAMP}, range(0, 36) u(t) WHERE v > 240 GROUP BY 1, 2")
    points = sorted({(r, round(r * math.sin(a)), round(r * math.cos(a))) for r in range(3, 6) for a in [2 * math.pi * i / max(8, 8 * r) for i in range(max(8, 8 * r))]})
    t("hough_circle", lambda k, d: reducers.hough_circle(ramp(k), 1, 3, 5, 240), f"SELECT r AS radius, y + a AS y, x + b AS x, count(*) AS votes FROM {RAMP}, (VALUES {', '.join(map(str, points))}) p(r, a, b) WHERE v > 240 AND y + a BETWEEN 0 AND 47 AND x + b BETWEEN 0 AND 63 GROUP BY 1, 2, 3")

    # Frequency: the whole image, transformed by rows and then by columns.
    h = "(SELECT count(*) FROM embeddings)"
    lines = f"(SELECT p.y, CAST(k AS INT) AS x, sum(p.v * cos(2 * pi() * ((k * p.x) % 64) / 64)) AS re, -sum(p.v * sin(2 * pi() * ((k * p.x) % 64) / 64)) AS im FROM {EMB} p, range(0, 64) t(k) GROUP BY ALL)"
    turned = f"(SELECT q.l AS y, r.x, r.re, r.im, 2 * pi() * ((q.l * r.y) % {h}) / {h} AS a FROM {lines} r, (SELECT vec_id AS l FROM embeddings) q)"
    dft = f"(SELECT y, x, sum(re * cos(a) + im * sin(a)) / (64 * {h}) AS re, sum(im * cos(a) - re * sin(a)) / (64 * {h}) AS im FROM {turned} GROUP BY y, x)"
    both = "SELECT y, x, 0 AS band, re AS v FROM {t} UNION ALL SELECT y, x, 1, im FROM {t}"
    centred = f"(y + {h} // 2) % {h} AS y, (x + 32) % 64 AS x"
    c.image("fwfft", lambda k, d: frequency.fwfft(emb(k, d)), both.format(t=dft), True, True)
    c.image("fwfft_shifted", lambda k, d: frequency.fwfft(emb(k, d), True), both.format(t=f"(SELECT {centred}, re, im FROM {dft})"), True, True)
    c.image("invfft", lambda k, d: frequency.invfft(frequency.fwfft(emb(k, d))), f"SELECT * FROM {EMB}", True)
    c.image("spectrum", lambda k, d: frequency.spectrum(frequency.fwfft(emb(k, d))), f"SELECT {centred}, sqrt(re * re + im * im) AS v FROM {dft}", True)
    pair = f"(SELECT a.y, a.x, a.v - 128.0e0 AS a, b.v - 128.0e0 AS b FROM {RAMP} a JOIN {OTHER} b USING (y, x))"
    mid = lambda r: r.map(lambda v: v.cast("double") - 128.0, s.F64)
    za = lambda k: bands.complex_form(mid(ramp(k)), mid(other(k)))
    zb = lambda k: bands.complex_form(mid(other(k)), mid(ramp(k)))
    c.image("freqmult", lambda k, d: frequency.freqmult(za(k), zb(k)), f"SELECT y, x, 0 AS band, a * b - b * a AS v FROM {pair} UNION ALL SELECT y, x, 1, a * a + b * b FROM {pair}", True, True)
    m = "sqrt((a * b + b * a) * (a * b + b * a) + (b * b - a * a) * (b * b - a * a))"
    c.image("phasecor", lambda k, d: frequency.phasecor(za(k), zb(k)), f"SELECT y, x, 0 AS band, CASE WHEN {m} = 0 THEN 0 ELSE (a * b + b * a) / {m} END AS v FROM {pair} UNION ALL SELECT y, x, 1, CASE WHEN {m} = 0 THEN 0 ELSE (b * b - a * a) / {m} END FROM {pair}", True, True)
    from ..operators import generators

    c.image("frequency_filter", lambda k, d: frequency.filtered(r := emb(k, d), generators.frequency_mask(k, r.width, r.height, "gaussian")), None, True)
