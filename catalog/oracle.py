"""ANSI-style SQL counterparts of the registered queries, run over the same tables."""

from __future__ import annotations

import re

from loadshape.operators.features import feature_names

ORACLES: dict[str, str] = {}


def conformal_level(n: str, alpha: str) -> str:
    return f"least(1.0::DOUBLE, ceil(({n} + 1) * (1.0::DOUBLE - ({alpha})::DOUBLE)) / {n})"


def list_quantile(items: str, n: str, alpha: str) -> str:
    """Conformal quantile of an ascending list."""
    h = f"(({n} - 1) * {conformal_level(n, alpha)})"
    low = f"{items}[CAST(floor({h}) AS BIGINT) + 1]"
    high = f"{items}[CAST(ceil({h}) AS BIGINT) + 1]"
    return f"({low} + ({h} - floor({h})) * ({high} - {low}))"


def day(thirtieths: int) -> str:
    return f"((SELECT day0 FROM span) + to_days(CAST((SELECT n_days FROM span) * {thirtieths} // 30 AS INTEGER)))"


def tagged(cuts: dict, ts: str = "ts") -> str:
    cases = " ".join(f"WHEN {ts} >= {day(a)} AND {ts} < {day(b)} THEN '{name}'" for name, (a, b) in cuts.items())
    return f"CASE {cases} END"


SPLITS = {"train": (7, 17), "calibration": (17, 22), "validation": (22, 24), "test": (24, 30)}
PER_SPLIT = {"train": (0, 13), "calibration": (13, 19), "validation": (19, 23), "test": (23, 30)}
WINDOW, REFERENCE, THRESHOLD = 96, 240, 0.15


def load_features(lags, partition: str) -> str:
    w = f"OVER (PARTITION BY {partition} ORDER BY ts"
    day = "ROWS BETWEEN 95 PRECEDING AND 48 PRECEDING)"
    week = "ROWS BETWEEN 383 PRECEDING AND 48 PRECEDING)"
    parts = [f"lag(load_kwh, {k}) {w}) AS load_lag_{k}" for k in lags]
    parts += [
        f"lag(load_kwh, 48) {w}) AS origin_load_h48",
        f"lag(load_kwh, 48) {w}) - lag(load_kwh, 49) {w}) AS origin_ramp_h48",
    ]
    for fn, name in (("avg", "mean"), ("stddev_samp", "std"), ("min", "min"), ("max", "max")):
        parts.append(
            f"CASE WHEN count(load_kwh) {w} {day} >= 24 THEN {fn}(load_kwh) {w} {day} END AS origin_{name}_24h_h48"
        )
    for fn, name in (("avg", "mean"), ("stddev_samp", "std")):
        parts.append(
            f"CASE WHEN count(load_kwh) {w} {week} >= 96 THEN {fn}(load_kwh) {w} {week} END AS origin_{name}_7d_h48"
        )
    return ", ".join(parts)


CALENDAR = """
    CAST(floor((hour(ts) * 60 + minute(ts)) / 30.0) AS INTEGER) AS half_hour_idx, CAST(hour(ts) AS INTEGER) AS hour,
    CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week, CASE WHEN isodow(ts) >= 6 THEN 1.0 ELSE 0.0 END::DOUBLE AS is_weekend,
    CAST(month(ts) AS INTEGER) AS month, CAST(dayofyear(ts) AS INTEGER) AS day_of_year"""
WAVES = ", ".join(
    f"{fn}(2 * pi() * {col} / {period}) AS {fn}_{name}"
    for name, col, period in (
        ("hh", "half_hour_idx", "48.0"), ("dow", "day_of_week", "7.0"), ("doy", "day_of_year", "365.25"),
    )
    for fn in ("sin", "cos")
)

CTES: dict[str, str] = {}
CTES["readings"] = """
    SELECT event_id, concat('MAC', lpad(CAST(user_id AS VARCHAR), 6, '0')) AS household_id, ts AS timestamp,
           value / 100 AS energy_kwh, CASE WHEN user_id % 3 = 0 THEN 'dToU' ELSE 'Std' END AS tariff_group,
           CASE user_id % 3 WHEN 0 THEN 'Affluent' WHEN 1 THEN 'Comfortable' ELSE 'Adversity' END AS acorn_group
    FROM events"""
CTES["dirty_once"] = """
    SELECT event_id, concat('MAC', lpad(CAST(user_id AS VARCHAR), 6, '0')) AS household_id,
           CASE WHEN event_id % 101 <> 0 THEN ts END AS timestamp,
           CASE WHEN event_type = 'error' THEN NULL WHEN event_id % 97 = 0 THEN -(value / 100)
                WHEN event_id % 89 = 0 THEN value / 100 * 1000 ELSE value / 100 END AS energy_kwh,
           CASE WHEN user_id % 3 = 0 THEN 'dToU' ELSE 'Std' END AS tariff_group
    FROM events"""
CTES["dirty"] = """
    SELECT * FROM dirty_once
    UNION ALL SELECT event_id, household_id, timestamp, energy_kwh + 1, tariff_group FROM dirty_once WHERE event_id % 50 = 0"""
CTES["keyed"] = """
    SELECT * FROM dirty WHERE household_id IS NOT NULL AND timestamp IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY household_id, timestamp ORDER BY event_id, energy_kwh NULLS LAST) = 1"""
CTES["halfhour"] = """
    SELECT household_id, tariff_group, acorn_group, time_bucket(INTERVAL 30 MINUTE, timestamp) AS ts,
           sum(energy_kwh) AS energy_kwh
    FROM readings GROUP BY ALL"""
CTES["members"] = """
    SELECT 'total_population' AS cohort, * FROM readings
    UNION ALL SELECT 'dtou', * FROM readings WHERE regexp_matches(tariff_group, '(?i)tou|dynamic')
    UNION ALL SELECT 'standard', * FROM readings WHERE regexp_matches(tariff_group, '(?i)std|flat')"""
CTES["cohort_readings"] = """
    SELECT 'total_population' AS cohort, * FROM halfhour
    UNION ALL SELECT 'dtou', * FROM halfhour WHERE regexp_matches(tariff_group, '(?i)tou|dynamic')
    UNION ALL SELECT 'standard', * FROM halfhour WHERE regexp_matches(tariff_group, '(?i)std|flat')"""
CTES["span"] = """
    SELECT date_trunc('day', min(ts))::TIMESTAMP AS day0, date_diff('day', min(ts)::DATE, max(ts)::DATE) + 1 AS n_days FROM events"""
CTES["grid"] = """
    SELECT unnest(generate_series(day0, day0 + to_days(CAST(n_days AS INTEGER)) - INTERVAL 30 MINUTE, INTERVAL 30 MINUTE)) AS ts FROM span"""
CTES["metered"] = """
    SELECT cohort, time_bucket(INTERVAL 30 MINUTE, timestamp) AS ts, sum(energy_kwh) AS load_kwh FROM members GROUP BY ALL"""
CTES["series"] = """
    SELECT c.cohort, g.ts, coalesce(m.load_kwh, 0.0) AS load_kwh
    FROM (SELECT DISTINCT cohort FROM metered) c CROSS JOIN grid g
    LEFT JOIN metered m ON m.cohort = c.cohort AND m.ts = g.ts"""
CTES["typed"] = """
    SELECT event_type, time_bucket(INTERVAL 30 MINUTE, ts) AS ts, sum(value) AS load_kwh FROM events GROUP BY ALL"""
CTES["split_series"] = f"""
    SELECT * FROM (SELECT *, {tagged(SPLITS)} AS split FROM series) WHERE split IS NOT NULL"""
CTES["lagged"] = """
    SELECT *, lag(load_kwh, 48) OVER w AS lag48, lag(load_kwh, 336) OVER w AS lag336
    FROM series WINDOW w AS (PARTITION BY cohort ORDER BY ts)"""
CTES["points"] = f"""
    SELECT * FROM (
        SELECT cohort, ts, {tagged(SPLITS)} AS split, load_kwh AS y, greatest(0.0, lag48) AS y_pred,
               CAST(floor((hour(ts) * 60 + minute(ts)) / 30.0) AS INTEGER) AS step, isodow(ts) >= 6 AS weekend, lag336
        FROM lagged WHERE lag336 IS NOT NULL)
    WHERE split IS NOT NULL"""
CTES["seasonal"] = """
    SELECT cohort, step, weekend, quantile_cont(y, 0.05) AS q_lo, quantile_cont(y, 0.5) AS q_mid, quantile_cont(y, 0.95) AS q_hi
    FROM points WHERE split = 'train' GROUP BY ALL"""
CTES["forecasts"] = """
    SELECT p.cohort, p.ts, p.split, p.y, p.y_pred, greatest(0.0, s.q_lo) AS q_lo, greatest(0.0, s.q_mid) AS q_mid,
           greatest(0.0, s.q_hi) AS q_hi, abs(p.y - p.y_pred) AS score, greatest(s.q_lo - p.y, p.y - s.q_hi) AS violation
    FROM points p LEFT JOIN seasonal s USING (cohort, step, weekend)"""
CTES["test"] = """
    SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY ts) - 1 AS pos,
           (row_number() OVER (PARTITION BY cohort ORDER BY ts) - 1) // 48 AS block
    FROM forecasts WHERE split = 'test'"""
CTES["cal"] = """
    SELECT *, -row_number() OVER (PARTITION BY cohort ORDER BY ts DESC) AS pos FROM forecasts WHERE split = 'calibration'"""
CTES["cal_lists"] = """
    SELECT cohort, count(*) AS n, list(score ORDER BY score) AS s, list(violation ORDER BY violation) AS v
    FROM cal GROUP BY cohort"""
CTES["cal_q"] = f"""
    SELECT cohort, {list_quantile('s', 'n', '0.1')} AS q, {list_quantile('v', 'n', '0.1')} AS qv FROM cal_lists"""
CTES["b_uncalibrated"] = """
    SELECT cohort, ts, pos, block, 'uncalibrated' AS method, y, y_pred, greatest(0.0, q_lo) AS lower,
           greatest(greatest(0.0, q_lo), q_hi) AS upper FROM test"""
CTES["b_static"] = """
    SELECT cohort, ts, pos, block, 'static' AS method, y, y_pred, greatest(0.0, y_pred - q) AS lower, y_pred + q AS upper
    FROM test JOIN cal_q USING (cohort)"""
CTES["b_cqr"] = """
    SELECT cohort, ts, pos, block, 'cqr' AS method, y, y_pred, greatest(0.0, q_lo - qv) AS lower,
           greatest(greatest(0.0, q_lo - qv), q_hi + qv) AS upper
    FROM test JOIN cal_q USING (cohort)"""


def rolling(window: int) -> tuple[str, str]:
    pool = f"""
    SELECT t.cohort, t.block, list(s.score ORDER BY s.score) AS s, count(*) AS n
    FROM (SELECT DISTINCT cohort, block FROM test) t
    JOIN (SELECT cohort, pos, score FROM cal UNION ALL SELECT cohort, pos, score FROM test) s
      ON s.cohort = t.cohort AND s.pos < t.block * 48 AND s.pos >= t.block * 48 - {window}
    GROUP BY ALL"""
    bounds = f"""
    SELECT cohort, ts, pos, block, 'rolling' AS method, y, y_pred, greatest(0.0, y_pred - q) AS lower, y_pred + q AS upper
    FROM test JOIN (SELECT cohort, block, {list_quantile('s', 'n', '0.1')} AS q FROM pool_{window}) USING (cohort, block)"""
    return pool, bounds


for w in (240, 130, 48, 144, 672):
    CTES[f"pool_{w}"], CTES[f"rolling_{w}"] = rolling(w)

Q_ALPHA = list_quantile("c.s", "c.n", "a.alpha")
CTES["aci_grid"] = "SELECT unnest([0.005, 0.01, 0.02, 0.05])::DOUBLE AS gamma"
CTES["aci_walk"] = f"""
    SELECT c.cohort, g.gamma, 0::BIGINT AS block, 0.1::DOUBLE AS alpha FROM cal_lists c CROSS JOIN aci_grid g
    UNION ALL
    SELECT a.cohort, a.gamma, a.block + 1,
           greatest(0.01::DOUBLE, least(0.5::DOUBLE, a.alpha + a.gamma * (0.1::DOUBLE - (
               SELECT avg(CASE WHEN t.y >= greatest(0.0, t.y_pred - {Q_ALPHA}) AND t.y <= t.y_pred + {Q_ALPHA}
                               THEN 0.0 ELSE 1.0 END)
               FROM test t WHERE t.cohort = a.cohort AND t.block = a.block))))
    FROM aci_walk a JOIN cal_lists c ON c.cohort = a.cohort
    WHERE a.block < (SELECT max(block) FROM test)"""
CTES["aci_bounds"] = f"""
    SELECT t.cohort, t.ts, t.pos, t.block, 'aci' AS method, a.gamma, t.y, t.y_pred, a.alpha, {Q_ALPHA} AS q,
           greatest(0.0, t.y_pred - {Q_ALPHA}) AS lower, t.y_pred + {Q_ALPHA} AS upper
    FROM test t JOIN aci_walk a USING (cohort, block) JOIN cal_lists c ON c.cohort = t.cohort"""
CTES["b_aci"] = """
    SELECT cohort, ts, pos, block, method, y, y_pred, lower, upper FROM aci_bounds WHERE gamma = 0.01::DOUBLE"""
Q_BAND = list_quantile("c.v", "c.n", "a.alpha")
BAND_LOW = f"greatest(0.0, t.q_lo - {Q_BAND})"
BAND_HIGH = f"greatest({BAND_LOW}, t.q_hi + {Q_BAND})"
CTES["aci_band_walk"] = f"""
    SELECT c.cohort, 0::BIGINT AS block, 0.1::DOUBLE AS alpha FROM cal_lists c
    UNION ALL
    SELECT a.cohort, a.block + 1,
           greatest(0.01::DOUBLE, least(0.5::DOUBLE, a.alpha + 0.01::DOUBLE * (0.1::DOUBLE - (
               SELECT avg(CASE WHEN t.y >= {BAND_LOW} AND t.y <= {BAND_HIGH} THEN 0.0 ELSE 1.0 END)
               FROM test t WHERE t.cohort = a.cohort AND t.block = a.block))))
    FROM aci_band_walk a JOIN cal_lists c ON c.cohort = a.cohort
    WHERE a.block < (SELECT max(block) FROM test)"""


def transport(window: int, reference: int) -> dict[str, str]:
    key = f"{window}_{reference}"
    return {
        f"ref_{key}": f"SELECT cohort, score FROM cal WHERE pos >= -{reference}",
        f"ref_size_{key}": f"""
    SELECT cohort, count(*) AS m, greatest(stddev_pop(score), 1e-6) AS sd FROM ref_{key} GROUP BY cohort""",
        f"masses_{key}": f"""
    SELECT cohort, pos, v, sum(f) AS f, sum(g) AS g FROM (
        SELECT t.cohort, t.pos, x.score AS v, 1.0::DOUBLE / least(t.pos + 1, {window}) AS f, 0.0::DOUBLE AS g
        FROM test t JOIN test x ON x.cohort = t.cohort AND x.pos <= t.pos AND x.pos > t.pos - {window}
        UNION ALL
        SELECT t.cohort, t.pos, r.score, 0.0::DOUBLE, 1.0::DOUBLE / z.m
        FROM test t JOIN ref_{key} r ON r.cohort = t.cohort JOIN ref_size_{key} z ON z.cohort = t.cohort)
    GROUP BY ALL""",
        f"cdfs_{key}": f"""
    SELECT cohort, pos, abs(sum(f) OVER w - sum(g) OVER w) * (lead(v) OVER w - v) AS area
    FROM masses_{key} WINDOW w AS (PARTITION BY cohort, pos ORDER BY v)""",
        f"shift_{key}": f"""
    SELECT cohort, pos, CASE WHEN pos + 1 >= greatest(24, {window} // 4) THEN sum(area) / max(sd) ELSE 0.0 END AS delta,
           pos + 1 >= greatest(24, {window} // 4) AS ready
    FROM cdfs_{key} JOIN ref_size_{key} USING (cohort) GROUP BY cohort, pos""",
    }


CTES |= transport(WINDOW, REFERENCE) | transport(96, 200)
CTES["sa_variants"] = f"""
    SELECT * FROM (VALUES ('main', 0.1, 0.005, 0.035, true), ('off', 0.1, 0.005, 0.035, false),
                          ('a4', 0.1, 0.005, 0.005, false), ('slow_only', 0.1, 0.005, 0.005, true),
                          ('fast_moderate', 0.1, 0.005, 0.025, true), ('fast_aggressive', 0.1, 0.005, 0.05, true),
                          ('80%', 0.2, 0.005, 0.035, true), ('90%', 0.1, 0.005, 0.035, true),
                          ('95%', 0.05, 0.005, 0.035, true)) AS v(variant, nominal, slow, fast, enabled)"""
CTES["sa_steps"] = f"""
    SELECT t.*, s.delta, s.ready AND s.delta >= {THRESHOLD} AS flagged FROM test t JOIN shift_{WINDOW}_{REFERENCE} s USING (cohort, pos)"""


def sa_walk(variants: str) -> str:
    """Alpha before every step and the quantile fixed at its block start."""
    flag = "(v.enabled AND t.flagged)"
    miss = "(CASE WHEN t.y >= greatest(0.0, t.y_pred - a.q) AND t.y <= t.y_pred + a.q THEN 0.0 ELSE 1.0 END)::DOUBLE"
    moved = (
        f"greatest(0.01::DOUBLE, least(0.5::DOUBLE, a.alpha + CASE WHEN {flag} THEN v.fast ELSE v.slow END::DOUBLE"
        f" * (v.nominal::DOUBLE - {miss}) - CASE WHEN {flag} THEN 0.02::DOUBLE * t.delta * {miss} ELSE 0.0::DOUBLE END))"
    )
    return f"""
    SELECT c.cohort, v.variant, 0::BIGINT AS pos, v.nominal::DOUBLE AS alpha, {list_quantile('c.s', 'c.n', 'v.nominal')} AS q
    FROM cal_lists c CROSS JOIN sa_variants v WHERE v.variant IN ({variants})
    UNION ALL
    SELECT b.cohort, b.variant, b.pos, b.alpha,
           CASE WHEN b.pos % 48 = 0 THEN {list_quantile('c.s', 'c.n', 'b.alpha')} ELSE b.q END
    FROM (SELECT a.cohort, a.variant, a.pos + 1 AS pos, {moved} AS alpha, a.q
          FROM sa_walk a JOIN sa_steps t ON t.cohort = a.cohort AND t.pos = a.pos
          JOIN sa_variants v ON v.variant = a.variant
          WHERE a.pos < (SELECT max(pos) FROM test)) b
    JOIN cal_lists c ON c.cohort = b.cohort"""


CTES["sa_walk"] = sa_walk("'main'")
CTES["sa_bounds"] = """
    SELECT t.cohort, t.ts, t.pos, t.block, a.variant, t.y, t.y_pred, a.alpha, a.q, v.enabled AND t.flagged AS shift_flag,
           CASE WHEN v.enabled THEN t.delta ELSE 0.0 END AS shift_score,
           CASE WHEN v.enabled AND t.flagged THEN v.fast ELSE v.slow END::DOUBLE AS gamma_t,
           first_value(a.alpha) OVER (PARTITION BY t.cohort, a.variant, t.block ORDER BY t.pos) AS alpha_block,
           greatest(0.0, t.y_pred - a.q) AS lower, t.y_pred + a.q AS upper
    FROM sa_steps t JOIN sa_walk a USING (cohort, pos) JOIN sa_variants v ON v.variant = a.variant"""
CTES["b_sa_acp"] = """
    SELECT cohort, ts, pos, block, 'sa_acp' AS method, y, y_pred, lower, upper FROM sa_bounds WHERE variant = 'main'"""
CTES["five"] = """
    SELECT * FROM b_uncalibrated UNION ALL SELECT * FROM b_static UNION ALL SELECT * FROM b_cqr
    UNION ALL SELECT * FROM rolling_240 UNION ALL SELECT * FROM b_aci"""
CTES["six"] = "SELECT * FROM five UNION ALL SELECT * FROM b_sa_acp"
CTES["feature_rows"] = f"""
    SELECT cohort, ts, load_kwh, {CALENDAR}, {load_features((48, 96, 144, 336), 'cohort')} FROM series"""
CTES["bands"] = """
    SELECT l_suppkey, l_orderkey, l_linenumber, l_shipdate AS ts, l_quantity AS y, l_extendedprice / 2500 AS lower,
           l_extendedprice / 1000 AS upper FROM lineitem"""

RECURSIVE = ("aci_walk", "aci_band_walk", "sa_walk")


def build(body: str, **override: str) -> str:
    """Prefix ``body`` with the named queries it needs."""
    available = CTES | override
    names = set(available)
    chosen: list[str] = []
    met: set[str] = set()

    def visit(text: str) -> None:
        for name in sorted(names & set(re.findall(r"\w+", re.sub(r"'[^']*'", "", text))) - met):
            if name not in met:
                met.add(name)
                visit(available[name])
                chosen.append(name)  # after all that it reads

    visit(body)
    if not chosen:
        return body
    recursive = "RECURSIVE " if any(n in RECURSIVE for n in chosen) else ""
    materialised = {"series", "forecasts", "test", "cal", "cal_lists", "sa_steps"}
    parts = [f"{n} AS {'MATERIALIZED ' if n in materialised else ''}({available[n]})" for n in chosen]
    return f"WITH {recursive}" + ",\n".join(parts) + "\n" + body


def oracle(name: str, body: str, **override: str) -> None:
    ORACLES[name] = build(body, **override)


def rounded(digits: int, *columns: str) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


def single(*columns: str) -> str:
    return ", ".join(f"CAST(CAST(round({c}, 12) AS FLOAT) AS DOUBLE) AS {c}" for c in columns)


def interval_metrics(source: str, keys: str, alpha: str = "0.1") -> str:
    a = f"({alpha})::DOUBLE"
    inside = "CASE WHEN y >= lower AND y <= upper THEN 1.0 ELSE 0.0 END"
    score = (
        f"upper - lower + CASE WHEN y < lower THEN 2.0::DOUBLE / {a} * (lower - y) ELSE 0.0 END"
        f" + CASE WHEN y > upper THEN 2.0::DOUBLE / {a} * (y - upper) ELSE 0.0 END"
    )
    return f"""SELECT {keys}, count(*) AS n_obs, round(avg({inside}), 4) AS empirical_coverage,
       round(1.0::DOUBLE - {a}, 4) AS target_coverage, round(abs(avg({inside}) - (1.0::DOUBLE - {a})), 4) AS ace,
       round(avg(upper - lower), 4) AS mpiw, round(avg({score}), 4) AS interval_score
FROM {source} GROUP BY {keys}{', alpha' if alpha == 'alpha' else ''}"""


def point_metrics(source: str, keys: str) -> str:
    return f"""SELECT {keys}, round(avg(abs(y - y_pred)), 4) AS mae, round(sqrt(avg((y - y_pred) * (y - y_pred))), 4) AS rmse,
       round(avg(abs(y - y_pred)) / greatest(avg(y), 1e-6), 4) AS nmae,
       round(avg(abs(y - y_pred) / ((abs(y) + abs(y_pred)) / 2.0 + 1e-6)) * 100.0, 4) AS smape
FROM {source} GROUP BY {keys}"""


# sources and sinks ------------------------------------------------------------

oracle("source_csv_mapped", """
SELECT household_id, tariff_group, count(*) AS n_rows, count(timestamp) AS n_times,
       min(date_trunc('second', timestamp)) AS first_ts, max(date_trunc('second', timestamp)) AS last_ts,
       count(energy_kwh) AS n_energy, round(sum(energy_kwh), 4) AS total_kwh
FROM dirty GROUP BY ALL""")
oracle("source_parquet_mapped", """
SELECT CAST(user_id AS VARCHAR) AS household_id, count(*) AS n_rows, min(ts) AS first_ts, round(sum(value), 4) AS total
FROM events GROUP BY ALL""")
oracle("source_tolerant_casts", """
SELECT CAST(user_id AS VARCHAR) AS household_id, count(*) AS n_rows, count(CASE WHEN event_id % 11 <> 0 THEN 1 END) AS n_times,
       max(CASE WHEN event_id % 11 <> 0 THEN date_trunc('second', ts) END) AS last_ts,
       count(CASE WHEN event_id % 7 <> 0 THEN 1 END) AS n_energy,
       round(sum(CASE WHEN event_id % 7 <> 0 THEN value END), 4) AS total
FROM events GROUP BY ALL""")
oracle("source_preview", "SELECT * FROM readings ORDER BY timestamp, event_id LIMIT 100")
oracle("sink_series_parquet", """
SELECT cohort, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts, round(sum(load_kwh), 4) AS total
FROM series GROUP BY cohort""")
oracle("sink_readings_sorted", "SELECT event_id, household_id, timestamp, round(energy_kwh, 4) AS energy_kwh FROM readings")
oracle("sink_result_tables", f"""
SELECT m.*, f.fmt FROM ({point_metrics("forecasts WHERE split = 'test'", "cohort")}) m
CROSS JOIN (VALUES ('csv'), ('json')) f(fmt)""")

# cleaning -----------------------------------------------------------------------

oracle("clean_drop_null_keys", """
SELECT event_id, household_id, timestamp, round(energy_kwh, 4) AS energy_kwh FROM dirty
WHERE household_id IS NOT NULL AND timestamp IS NOT NULL""")
oracle("clean_first_per_key", """
SELECT event_id, household_id, timestamp, round(energy_kwh, 4) AS energy_kwh FROM dirty
QUALIFY row_number() OVER (PARTITION BY household_id, timestamp ORDER BY event_id, energy_kwh NULLS LAST) = 1""")
oracle("clean_fill_and_clip", """
SELECT household_id, count(e) AS n, round(sum(e), 4) AS total, round(min(e), 4) AS lo, round(max(e), 4) AS hi
FROM (SELECT household_id, least(greatest(coalesce(energy_kwh, 0.0), 0.0), 50.0) AS e FROM dirty) GROUP BY household_id""")
oracle("clean_household_history", """
SELECT household_id, min(timestamp) AS min_ts, max(timestamp) AS max_ts, count(energy_kwh) AS count,
       round(floor(date_diff('microsecond', min(timestamp), max(timestamp)) / 1000000.0) / 86400.0, 6) AS duration_days
FROM dirty WHERE timestamp IS NOT NULL GROUP BY household_id""")
KEPT = """SELECT household_id FROM {source} GROUP BY household_id
HAVING floor(date_diff('microsecond', min(timestamp), max(timestamp)) / 1000000.0) / 86400.0 >= {days}"""
oracle("clean_keep_households", f"""
SELECT event_id, household_id, timestamp, round(energy_kwh, 4) AS energy_kwh FROM readings
WHERE household_id IN ({KEPT.format(source='readings', days=29)})""")
oracle("clean_readings_full", f"""
SELECT event_id, household_id, timestamp, round(least(greatest(coalesce(energy_kwh, 0.0), 0.0), 50.0), 4) AS energy_kwh, tariff_group
FROM keyed WHERE household_id IN ({KEPT.format(source='keyed', days=28)})""")
oracle("clean_enforce_missing_ratio", f"""
SELECT household_id, count(*) AS n, round(sum(least(greatest(coalesce(energy_kwh, 0.0), 0.0), 50.0)), 4) AS total
FROM keyed WHERE household_id IN ({KEPT.format(source='keyed', days=20)})
  AND household_id NOT IN (SELECT household_id FROM keyed GROUP BY household_id
                           HAVING count(CASE WHEN energy_kwh IS NULL THEN 1 END)::DOUBLE / count(*) > 0.2)
GROUP BY household_id""")
SAMPLE = "SELECT household_id FROM (SELECT DISTINCT household_id FROM readings) ORDER BY md5(concat('42-', household_id)), household_id LIMIT 50"
oracle("sample_households", SAMPLE)
oracle("sample_readings", f"""
SELECT event_id, household_id, timestamp, round(energy_kwh, 4) AS energy_kwh FROM readings WHERE household_id IN ({SAMPLE})""")

# audit ----------------------------------------------------------------------------

oracle("audit_totals", """
SELECT count(*) AS total_records, min(timestamp) AS start_ts, max(timestamp) AS end_ts,
       count(DISTINCT household_id) AS customer_count, count(*) - count(energy_kwh) AS null_energy_count,
       count(*) - count(timestamp) AS null_timestamp_count, count(CASE WHEN energy_kwh < 0 THEN 1 END) AS negative_count,
       count(CASE WHEN energy_kwh > 50 THEN 1 END) AS extreme_count
FROM dirty""")
oracle("audit_tariff_counts", """
SELECT CASE WHEN event_id % 10 <> 0 THEN tariff_group END AS tariff_group, count(*) AS records FROM dirty GROUP BY 1""")
oracle("audit_duplicates", """
SELECT (SELECT count(*) FROM dirty) - (SELECT count(*) FROM (SELECT DISTINCT household_id, timestamp FROM dirty)) AS duplicate_records""")
CTES["quality"] = """
    SELECT household_id, count(timestamp) AS obs_count, min(timestamp) AS min_ts, max(timestamp) AS max_ts,
           count(*) - count(energy_kwh) AS null_count,
           date_diff('microsecond', min(timestamp), max(timestamp)) / 86400000000.0 AS duration_days,
           (count(*) - count(energy_kwh))::DOUBLE / count(timestamp) AS missing_ratio
    FROM dirty GROUP BY household_id"""
oracle("audit_household_quality", """
SELECT household_id, obs_count, min_ts, max_ts, null_count, round(duration_days, 6) AS duration_days,
       round(missing_ratio, 6) AS missing_ratio FROM quality""")
oracle("audit_exclusions", """
SELECT count(CASE WHEN duration_days < 28 THEN 1 END) AS insufficient_history,
       count(CASE WHEN missing_ratio > 0.2 THEN 1 END) AS high_missingness,
       count(CASE WHEN duration_days < 28 OR missing_ratio > 0.2 THEN 1 END) AS total_excluded,
       count(CASE WHEN NOT (duration_days < 28 OR missing_ratio > 0.2) THEN 1 END) AS total_retained
FROM quality""")
oracle("audit_retained", """
SELECT household_id FROM quality
EXCEPT SELECT household_id FROM quality WHERE duration_days < 28 OR missing_ratio > 0.2""")
oracle("audit_consumption", """
SELECT round(avg(energy_kwh), 6) AS mean, round(stddev_samp(energy_kwh), 6) AS std, round(min(energy_kwh), 6) AS min,
       round(quantile_cont(energy_kwh, 0.25), 6) AS p25, round(quantile_cont(energy_kwh, 0.5), 6) AS median,
       round(quantile_cont(energy_kwh, 0.75), 6) AS p75, round(quantile_cont(energy_kwh, 0.99), 6) AS p99,
       round(max(energy_kwh), 6) AS max
FROM dirty""")

# cohorts ---------------------------------------------------------------------------

oracle("cohort_membership", """
SELECT cohort, count(*) AS n_rows, count(DISTINCT household_id) AS households FROM members GROUP BY cohort""")
oracle("cohort_halfhour_load", """
SELECT cohort, ts, CAST(CAST(round(sum(energy_kwh), 12) AS FLOAT) AS DOUBLE) AS load_kwh, CAST(CAST(round(avg(energy_kwh), 12) AS FLOAT) AS DOUBLE) AS load_mean_kwh,
       CAST(CAST(round(stddev_samp(energy_kwh), 12) AS FLOAT) AS DOUBLE) AS load_std_kwh, count(DISTINCT household_id) AS active_households
FROM cohort_readings GROUP BY cohort, ts""")
oracle("cohort_load_distinct", """
SELECT cohort, time_bucket(INTERVAL 30 MINUTE, timestamp) AS ts, round(sum(energy_kwh), 6) AS load_kwh,
       count(DISTINCT household_id) AS active_households
FROM members GROUP BY 1, 2""")
oracle("cohort_acorn_load", """
SELECT acorn_group AS cohort, ts, round(sum(energy_kwh), 6) AS load_kwh, count(DISTINCT household_id) AS active_households
FROM halfhour GROUP BY 1, 2""")
oracle("cohort_hourly_profile", """
SELECT cohort, CAST(hour(ts) AS INTEGER) AS hour, round(avg(load_kwh), 6) AS mean_load FROM series GROUP BY 1, 2""")
oracle("cohort_step_profile", """
SELECT cohort, CAST(floor((hour(ts) * 60 + minute(ts)) / 30.0) AS INTEGER) AS half_hour_idx, round(avg(load_kwh), 6) AS mean,
       round(stddev_samp(load_kwh), 6) AS std, round(quantile_cont(load_kwh, 0.1), 6) AS p10,
       round(quantile_cont(load_kwh, 0.9), 6) AS p90
FROM series GROUP BY 1, 2""")
oracle("cohort_histogram", """
SELECT r.cohort, r.split, CAST(b.bin AS INTEGER) AS bin, round(r.lo + b.bin * r.width, 6) AS bin_start,
       count(s.load_kwh) AS n, round(count(s.load_kwh) / (max(r.n) * max(r.width)), 6) AS density
FROM (SELECT cohort, split, min(load_kwh) AS lo, (max(load_kwh) - min(load_kwh)) / 35 AS width, count(*) AS n
      FROM split_series WHERE split IN ('train', 'test') GROUP BY 1, 2) r
CROSS JOIN (SELECT unnest(range(35)) AS bin) b
LEFT JOIN split_series s ON s.cohort = r.cohort AND s.split = r.split
     AND least(floor((s.load_kwh - r.lo) / r.width), 34) = b.bin
GROUP BY r.cohort, r.split, b.bin, r.lo, r.width""")

# splits -------------------------------------------------------------------------------

oracle("split_tags", "SELECT cohort, ts, split, round(load_kwh, 6) AS load_kwh FROM split_series")
oracle("split_counts", """
SELECT n.split, count(s.ts) AS n_rows, min(s.ts) AS first_ts, max(s.ts) AS last_ts, count(s.ts) = 0 AS is_empty
FROM (VALUES ('train'), ('calibration'), ('validation'), ('test')) n(split) LEFT JOIN split_series s ON s.split = n.split
GROUP BY n.split""")
oracle("split_disjoint", """
SELECT p.a, p.b, (SELECT count(*) FROM split_series x JOIN split_series z ON x.cohort = z.cohort AND x.ts = z.ts
                  WHERE x.split = p.a AND z.split = p.b) AS shared
FROM (VALUES ('train', 'calibration'), ('train', 'validation'), ('train', 'test'), ('calibration', 'validation'),
             ('calibration', 'test'), ('validation', 'test')) p(a, b)""")
oracle("slice_thirds", """
SELECT cohort, CASE WHEN pos < n // 3 THEN 'early' ELSE 'late' END AS period, ts, round(load_kwh, 6) AS load_kwh
FROM (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY ts) - 1 AS pos, count(*) OVER (PARTITION BY cohort) AS n
      FROM split_series WHERE split = 'test')
WHERE pos < n // 3 OR pos >= 2 * n // 3""")
oracle("slice_zoom_week", """
SELECT cohort, ts, round(load_kwh, 6) AS load_kwh
FROM (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY ts) - 1 AS pos FROM series) WHERE pos >= 336 AND pos < 672""")

# features -----------------------------------------------------------------------------

oracle("feature_regular_grid", """
SELECT g.event_type, g.ts, round(h.load_kwh, 4) AS load_kwh,
       row_number() OVER (PARTITION BY g.event_type ORDER BY g.ts) - 1 AS seq
FROM (SELECT event_type, unnest(generate_series(min(ts), max(ts), INTERVAL 30 MINUTE)) AS ts FROM typed GROUP BY event_type) g
LEFT JOIN typed h ON h.event_type = g.event_type AND h.ts = g.ts""")
oracle("feature_positions", """
SELECT event_type, ts, round(load_kwh, 4) AS load_kwh, row_number() OVER (PARTITION BY event_type ORDER BY ts) - 1 AS seq FROM typed""")
oracle("feature_row_lags", """
SELECT event_type, ts, round(lag(load_kwh, 48) OVER w, 4) AS load_lag_48, round(lag(load_kwh, 96) OVER w, 4) AS load_lag_96,
       round(lag(load_kwh, 144) OVER w, 4) AS load_lag_144, round(lag(load_kwh, 336) OVER w, 4) AS load_lag_336,
       round(lag(load_kwh, 48) OVER w, 4) AS origin_load_h48,
       round(lag(load_kwh, 48) OVER w - lag(load_kwh, 49) OVER w, 4) AS origin_ramp_h48
FROM typed WINDOW w AS (PARTITION BY event_type ORDER BY ts)""")
ORIGIN = ["origin_mean_24h_h48", "origin_std_24h_h48", "origin_min_24h_h48", "origin_max_24h_h48",
          "origin_mean_7d_h48", "origin_std_7d_h48"]
oracle("feature_origin_statistics", f"""
SELECT cohort, ts, {single(*ORIGIN)} FROM (SELECT cohort, ts, {load_features((), 'cohort')} FROM series)""")
WAVE_NAMES = ["sin_hh", "cos_hh", "sin_dow", "cos_dow", "sin_doy", "cos_doy"]
CAL_NAMES = "half_hour_idx, hour, day_of_week, is_weekend, month, day_of_year"
oracle("feature_calendar", f"""
SELECT cohort, ts, {CAL_NAMES}, {rounded(6, *WAVE_NAMES)},
       CASE WHEN CAST(ts AS DATE) IN (DATE '2024-01-01', DATE '2024-01-26') THEN 1.0 ELSE 0.0 END::DOUBLE AS is_bank_holiday
FROM (SELECT *, {WAVES} FROM (SELECT cohort, ts, {CALENDAR} FROM series))""")
oracle("feature_holiday_table", f"""
SELECT o_orderkey, half_hour_idx, day_of_week, is_weekend, month, day_of_year,
       CASE WHEN day(ts) = 25 THEN 1.0 ELSE 0.0 END::DOUBLE AS is_bank_holiday
FROM (SELECT o_orderkey, ts, {CALENDAR} FROM (SELECT o_orderkey, o_orderdate AS ts FROM orders))""")
LOADS = ["load_lag_48", "load_lag_96", "load_lag_144", "load_lag_336", "origin_load_h48", "origin_ramp_h48", *ORIGIN]
oracle("feature_table", f"""
SELECT cohort, ts, CAST(CAST(round(load_kwh, 12) AS FLOAT) AS DOUBLE) AS load_kwh, {CAL_NAMES}, {single(*WAVE_NAMES, *LOADS)}, 0.0::DOUBLE AS is_bank_holiday
FROM (SELECT *, {WAVES} FROM feature_rows)
WHERE {' AND '.join(f'{c} IS NOT NULL' for c in LOADS)}""")
PER = ["load_lag_48", "load_lag_96", "origin_load_h48", "origin_ramp_h48", *ORIGIN]
oracle("feature_table_per_split", f"""
SELECT cohort, split, ts, {single(*PER)}
FROM (SELECT cohort, split, ts, {load_features((48, 96), 'cohort, split')}
      FROM (SELECT *, {tagged(PER_SPLIT)} AS split FROM series) WHERE split IS NOT NULL)
WHERE {' AND '.join(f'{c} IS NOT NULL' for c in PER)}""")
SCALED = feature_names()
CTES["tagged_features"] = f"""
    SELECT *, 0.0::DOUBLE AS is_bank_holiday, {WAVES}, {tagged(SPLITS)} AS split FROM feature_rows
    WHERE {' AND '.join(f'{c} IS NOT NULL' for c in LOADS)}"""
oracle("feature_scaled", f"""
SELECT f.cohort, f.ts, f.split, {', '.join(
    f'round((f.{c} - s.m_{c}) / CASE WHEN s.s_{c} > 0 THEN s.s_{c} ELSE 1.0 END, 6) AS {c}' for c in SCALED)}
FROM tagged_features f JOIN (
    SELECT cohort, {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in SCALED)}
    FROM tagged_features WHERE split = 'train' GROUP BY cohort) s USING (cohort)
WHERE f.split IS NOT NULL""")
oracle("feature_rolling_coverage", """
SELECT cohort, ts, CASE WHEN count(*) OVER w = 96 THEN round(avg(CASE WHEN y >= lower AND y <= upper THEN 1.0 ELSE 0.0 END) OVER w, 6) END AS rolling_coverage
FROM b_static WINDOW w AS (PARTITION BY cohort ORDER BY ts ROWS BETWEEN 95 PRECEDING AND CURRENT ROW)""")
oracle("feature_day_blocks", """
SELECT cohort, block, min(ts) AS first_ts, count(*) AS n FROM test GROUP BY cohort, block""")

# scalar functions ------------------------------------------------------------------------

oracle("scalar_labels", """
SELECT CASE WHEN month(l_shipdate) IN (12, 1, 2) THEN 'Winter' WHEN month(l_shipdate) IN (3, 4, 5) THEN 'Spring'
            WHEN month(l_shipdate) IN (6, 7, 8) THEN 'Summer' ELSE 'Autumn' END AS season,
       CASE WHEN l_orderkey % 24 BETWEEN 17 AND 21 THEN 'Peak (17-21h)' ELSE 'Off-Peak' END AS peak,
       CASE WHEN isodow(l_shipdate) >= 6 THEN 'Weekend' ELSE 'Weekday' END AS day_type, count(*) AS n,
       min(CAST(l_shipdate AS DATE)) AS first_day, max(greatest(10.0 - l_quantity, l_quantity - 40.0)) AS worst,
       round(max(l_extendedprice / 7), 4) AS x4, round(min(l_extendedprice / 7), 2) AS x2
FROM lineitem GROUP BY 1, 2, 3""")
oracle("scalar_tertiles", """
SELECT l_orderkey, l_linenumber, l_returnflag,
       CASE WHEN l_extendedprice <= q1 THEN 'Low' WHEN l_extendedprice <= q2 THEN 'Medium' ELSE 'High' END AS regime
FROM lineitem JOIN (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.333) AS q1, quantile_cont(l_extendedprice, 0.667) AS q2
                    FROM lineitem GROUP BY l_returnflag) USING (l_returnflag)""")

# point forecasts --------------------------------------------------------------------------

oracle("model_seasonal_naive", """
SELECT cohort, ts, round(greatest(0.0, coalesce(lag48, 0.0)), 6) AS day, round(greatest(0.0, coalesce(lag336, 0.0)), 6) AS week,
       round(greatest(0.0, coalesce(lag48, 0.0)), 6) AS fallback FROM lagged""")
CTES["ridge_rows"] = f"""
    SELECT * FROM (SELECT *, {tagged(SPLITS)} AS split FROM lagged WHERE lag336 IS NOT NULL) WHERE split IS NOT NULL"""
CTES["ridge_fit"] = """
    SELECT cohort, my - b * mx AS a, b FROM (
        SELECT cohort, avg(lag48) AS mx, avg(load_kwh) AS my,
               covar_pop(lag48, load_kwh) * count(*) / (var_pop(lag48) * count(*) + 1.0) AS b
        FROM ridge_rows WHERE split = 'train' GROUP BY cohort)"""
oracle("model_ridge_one_feature", """
SELECT cohort, ts, round(greatest(0.0, a + b * lag48), 6) AS y_pred FROM ridge_rows JOIN ridge_fit USING (cohort) WHERE split = 'test'""")
oracle("model_ridge_two_features", """
SELECT l_returnflag, n AS n_rows, round(my - b1 * m1 - b2 * m2, 4) AS intercept, round(b1, 4) AS b_quantity, round(b2, 4) AS b_discount
FROM (SELECT *, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1, (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2
      FROM (SELECT l_returnflag, count(*) AS n, avg(l_quantity) AS m1, avg(l_discount) AS m2, avg(l_extendedprice) AS my,
                   var_pop(l_quantity) * count(*) + 10.0 AS s11, var_pop(l_discount) * count(*) + 10.0 AS s22,
                   covar_pop(l_quantity, l_discount) * count(*) AS s12, covar_pop(l_quantity, l_extendedprice) * count(*) AS s1y,
                   covar_pop(l_discount, l_extendedprice) * count(*) AS s2y
            FROM lineitem GROUP BY l_returnflag))""")
oracle("model_ridge_large_means", """
SELECT l_returnflag, count(*) AS n_rows, round(covar_pop(x, l_extendedprice) * count(*) / (var_pop(x) * count(*) + 10.0), 3) AS b
FROM (SELECT l_returnflag, l_quantity + 1e8 AS x, l_extendedprice FROM lineitem WHERE l_orderkey % 11 <> 0) GROUP BY 1""")
oracle("model_ridge_normal_equations", f"""
SELECT cohort, unnest([{', '.join(repr(n) for n in feature_names())}]) AS feature, 0.0::DOUBLE AS rest FROM (SELECT DISTINCT cohort FROM ridge_rows)""")
oracle("model_boosted_trees_facts", """
SELECT cohort, count(*) AS n, count(*) FILTER (load_kwh IS NULL) AS n_missing, count(*) FILTER (load_kwh < 0) AS n_negative,
       round(avg(abs(load_kwh - greatest(0.0, lag48))), 4) AS naive_mae, true AS below_naive
FROM ridge_rows WHERE split = 'test' GROUP BY 1""")
oracle("model_boosted_quantiles_facts", """
SELECT cohort, count(*) AS n, 0::BIGINT AS n_disordered,
       round(avg(greatest(0.05 * (y - q_lo), -0.95 * (y - q_lo))) + avg(greatest(0.5 * (y - q_mid), -0.5 * (y - q_mid)))
             + avg(greatest(0.95 * (y - q_hi), -0.05 * (y - q_hi))), 4) AS seasonal_pinball, true AS below_seasonal
FROM forecasts WHERE split = 'test' GROUP BY 1""")
oracle("point_four_models_facts", """
SELECT cohort, 'seasonal_naive_day' AS model, round(avg(abs(load_kwh - greatest(0.0, lag48))), 4) AS naive_mae, NULL::BOOLEAN AS below_day
FROM ridge_rows WHERE split = 'test' GROUP BY 1
UNION ALL SELECT cohort, 'seasonal_naive_week', round(avg(abs(load_kwh - greatest(0.0, lag336))), 4), NULL FROM ridge_rows WHERE split = 'test' GROUP BY 1
UNION ALL SELECT DISTINCT cohort, 'ridge', NULL::DOUBLE, NULL::BOOLEAN FROM ridge_rows
UNION ALL SELECT DISTINCT cohort, 'hist_gradient_boosting', NULL::DOUBLE, true FROM ridge_rows""")
oracle("backtest_boosted_facts", """
SELECT cohort, method, count(*) AS n, 0::BIGINT AS n_disordered, 0::BIGINT AS n_missing, true AS covers
FROM forecasts CROSS JOIN (SELECT unnest(['uncalibrated', 'static', 'cqr', 'rolling', 'aci', 'sa_acp']) AS method)
WHERE split = 'test' GROUP BY ALL""")
oracle("model_quantile_forest_facts", """
SELECT cohort, count(*) AS n, count(*) FILTER (load_kwh IS NULL) AS n_disordered, count(*) FILTER (load_kwh < 0) AS n_outside
FROM ridge_rows WHERE split = 'test' GROUP BY 1""")
oracle("model_seasonal_quantiles", f"""
SELECT cohort, ts, {rounded(6, 'q_lo', 'q_mid', 'q_hi')} FROM forecasts WHERE split = 'test'""")
oracle("model_quantile_interval", """
SELECT cohort, ts, round(q_lo, 6) AS lower, round(q_mid, 6) AS median, round(greatest(q_lo, q_hi), 6) AS upper
FROM forecasts WHERE split = 'test'""")
CTES["model_rows"] = """
    SELECT cohort, 'seasonal_naive_day' AS model, load_kwh AS y, greatest(0.0, lag48) AS y_pred FROM ridge_rows WHERE split = 'test'
    UNION ALL SELECT cohort, 'seasonal_naive_week', load_kwh, greatest(0.0, lag336) FROM ridge_rows WHERE split = 'test'
    UNION ALL SELECT cohort, 'ridge', load_kwh, greatest(0.0, a + b * lag48) FROM ridge_rows JOIN ridge_fit USING (cohort) WHERE split = 'test'"""
oracle("point_model_comparison", point_metrics("model_rows", "cohort, model"))
oracle("point_primary_model", point_metrics("model_rows WHERE model = 'ridge'", "cohort"))
oracle("point_metrics_by_supplier", point_metrics(
    "(SELECT l_suppkey, l_quantity AS y, l_extendedprice / 1500 AS y_pred FROM lineitem)", "l_suppkey"))
oracle("forecast_outcome_join", point_metrics("forecasts", "cohort"))

# conformal calibrators ----------------------------------------------------------------------

oracle("conformal_quantile_by_alpha", f"""
SELECT cohort, {', '.join(f"round({list_quantile('s', 'n', a)}, 6) AS {n}" for n, a in
    (('q05', '0.05'), ('q10', '0.10'), ('q20', '0.20'), ('q50', '0.50')))} FROM cal_lists""")
oracle("conformal_quantile_large_groups", f"""
SELECT l_returnflag, round({list_quantile('s', 'n', '0.10')}, 4) AS q10, round({list_quantile('s', 'n', '0.30')}, 4) AS q30
FROM (SELECT l_returnflag, list(abs(l_extendedprice - 30000.0) ORDER BY abs(l_extendedprice - 30000.0)) AS s, count(*) AS n
      FROM lineitem GROUP BY l_returnflag)""")
for name, source in (
    ("conformal_uncalibrated", "b_uncalibrated"), ("conformal_static", "b_static"), ("conformal_cqr", "b_cqr"),
    ("conformal_rolling", "rolling_240"), ("conformal_rolling_uneven_window", "rolling_130"),
):
    oracle(name, f"SELECT cohort, ts, {single('lower', 'upper')} FROM {source}")
oracle("conformal_aci", f"""
SELECT cohort, ts, CAST(CAST(round(alpha, 12) AS FLOAT) AS DOUBLE) AS alpha_block, CAST(CAST(round(q, 12) AS FLOAT) AS DOUBLE) AS conformal_quantile, {single('lower', 'upper')}
FROM aci_bounds WHERE gamma = 0.01::DOUBLE""")
oracle("conformal_aci_band", f"""
SELECT t.cohort, t.ts, CAST(CAST(round({BAND_LOW}, 12) AS FLOAT) AS DOUBLE) AS lower, CAST(CAST(round({BAND_HIGH}, 12) AS FLOAT) AS DOUBLE) AS upper
FROM test t JOIN aci_band_walk a USING (cohort, block) JOIN cal_lists c ON c.cohort = t.cohort""")
oracle("conformal_aci_trace", """
SELECT cohort, block, round(max(alpha), 6) AS alpha_t, round(max(q), 6) AS conformal_quantile,
       round(avg(CASE WHEN y >= lower AND y <= upper THEN 0.0 ELSE 1.0 END), 6) AS err_t,
       round(avg(CASE WHEN y >= lower AND y <= upper THEN 1.0 ELSE 0.0 END), 6) AS covered, round(avg(upper - lower), 6) AS width
FROM aci_bounds WHERE gamma = 0.01::DOUBLE GROUP BY cohort, block""")
SA = f"""
SELECT cohort, ts, CAST(CAST(round(alpha_block, 12) AS FLOAT) AS DOUBLE) AS alpha_t, CAST(CAST(round(gamma_t, 12) AS FLOAT) AS DOUBLE) AS gamma_t, CAST(CAST(round(shift_score, 12) AS FLOAT) AS DOUBLE) AS shift_score, shift_flag,
       {single('lower', 'upper')} FROM sa_bounds"""
oracle("conformal_shift_aware", SA)
oracle("conformal_shift_aware_trace", f"""
SELECT cohort, ts, CAST(CAST(round(alpha, 12) AS FLOAT) AS DOUBLE) AS alpha_t,
       CAST(CAST(round({list_quantile('c.s', 'c.n', 'b.alpha')}, 12) AS FLOAT) AS DOUBLE) AS conformal_quantile, CASE WHEN y >= lower AND y <= upper THEN 0.0 ELSE 1.0 END::DOUBLE AS err_t,
       CASE WHEN y >= lower AND y <= upper THEN 1.0 ELSE 0.0 END::DOUBLE AS covered, CAST(CAST(round(upper - lower, 12) AS FLOAT) AS DOUBLE) AS interval_width
FROM sa_bounds b JOIN cal_lists c USING (cohort)""")
oracle("conformal_detector_off", SA, sa_walk=sa_walk("'off'"))

CTES["mean_96"] = """
    SELECT t.cohort, t.pos, least(t.pos + 1, 96) AS n, abs(avg(t.score) OVER w - r.mu) / (r.sd / sqrt(least(t.pos + 1, 96))) AS z
    FROM test t JOIN (SELECT cohort, avg(score) AS mu, greatest(stddev_pop(score), 1e-6) AS sd FROM cal GROUP BY cohort) r USING (cohort)
    WINDOW w AS (PARTITION BY t.cohort ORDER BY t.pos ROWS BETWEEN 95 PRECEDING AND CURRENT ROW)"""
oracle("conformal_shift_aware_mean_detector", SA, sa_steps="""
    SELECT t.*, CASE WHEN d.n >= 24 THEN d.z ELSE 0.0 END AS delta, d.n >= 24 AND d.z >= 2.0 AS flagged
    FROM test t JOIN mean_96 d USING (cohort, pos)""")
oracle("conformal_shift_aware_always_penalised", SA, sa_walk=sa_walk("'main'").replace(
    " - CASE WHEN (v.enabled AND t.flagged) THEN 0.02", " - CASE WHEN v.enabled THEN 0.02"))
_LOW, _HIGH = "greatest(0.0, t.q_lo - a.q)", "greatest(greatest(0.0, t.q_lo - a.q), t.q_hi + a.q)"
oracle("conformal_shift_aware_band", SA, sa_walk=sa_walk("'main'").replace("c.s[", "c.v[").replace(
    "t.y >= greatest(0.0, t.y_pred - a.q) AND t.y <= t.y_pred + a.q", f"t.y >= {_LOW} AND t.y <= {_HIGH}"),
    sa_bounds=CTES["sa_bounds"].replace("greatest(0.0, t.y_pred - a.q) AS lower, t.y_pred + a.q AS upper", f"{_LOW} AS lower, {_HIGH} AS upper"))

# missing outcomes: ranks count scores, and steps without one move nothing
UNSETTLED = {
    "settled": CTES["forecasts"],
    "forecasts": """
    SELECT * EXCLUDE (y, score, violation), CASE WHEN known THEN y END AS y, CASE WHEN known THEN score END AS score, NULL::DOUBLE AS violation
    FROM (SELECT *, (day(ts) * 24 + hour(ts)) % 5 <> 0 AND ts::DATE <> (""" + day(24) + """ + INTERVAL 2 DAY)::DATE AS known FROM settled)
    WHERE split IN ('calibration', 'test')""",
    "cal": """
    SELECT *, -row_number() OVER (PARTITION BY cohort ORDER BY ts DESC) AS pos FROM forecasts WHERE split = 'calibration' AND score IS NOT NULL""",
    "test": """
    SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY ts) - 1 AS pos, (row_number() OVER (PARTITION BY cohort ORDER BY ts) - 1) // 48 AS block,
           count(score) OVER (PARTITION BY cohort ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS rank
    FROM forecasts WHERE split = 'test'""",
    "scored": "SELECT cohort, rank AS pos, score FROM test WHERE score IS NOT NULL",
    "aci_walk": CTES["aci_walk"].replace("t.block = a.block))))", "t.block = a.block AND t.y IS NOT NULL))))").replace(
        "greatest(0.01::DOUBLE, least(0.5::DOUBLE, a.alpha +", "greatest(0.01::DOUBLE, least(0.5::DOUBLE, a.alpha + coalesce("
    ).replace("t.y IS NOT NULL))))", "t.y IS NOT NULL)), 0.0::DOUBLE)))"),
    "sa_steps": f"""
    SELECT t.*, s.delta, coalesce(s.ready AND s.delta >= {THRESHOLD}, false) AS flagged
    FROM test t LEFT JOIN shift_{WINDOW}_{REFERENCE} s ON s.cohort = t.cohort AND s.pos = t.rank AND t.score IS NOT NULL""",
    "sa_walk": sa_walk("'main'").replace(".alpha + CASE WHEN", ".alpha + CASE WHEN t.y IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END * (CASE WHEN").replace(
        " - CASE WHEN (v.enabled", ") - CASE WHEN t.y IS NOT NULL AND (v.enabled"
    ),
}
for w in (130, 240):
    UNSETTLED[f"pool_{w}"] = f"""
    SELECT t.cohort, t.block, list(s.score ORDER BY s.score) AS s, count(*) AS n
    FROM (SELECT cohort, block, min(rank) AS start FROM test GROUP BY ALL) t
    JOIN (SELECT cohort, pos, score FROM cal UNION ALL SELECT cohort, pos, score FROM scored) s
      ON s.cohort = t.cohort AND s.pos < t.start AND s.pos >= t.start - {w}
    GROUP BY ALL"""
_scored = transport(WINDOW, REFERENCE)
_key = f"masses_{WINDOW}_{REFERENCE}"
UNSETTLED |= _scored | {_key: _scored[_key].replace("FROM test t", "FROM scored t").replace("JOIN test x", "JOIN scored x")}
ONLINE = f"""
SELECT cohort, ts, method, {single('lower', 'upper')} FROM (
    SELECT cohort, ts, method, lower, upper FROM rolling_240 UNION ALL SELECT cohort, ts, method, lower, upper FROM b_aci
    UNION ALL SELECT cohort, ts, method, lower, upper FROM b_sa_acp)"""
oracle("rolling_with_missing_outcomes", f"SELECT cohort, ts, {single('lower', 'upper')} FROM rolling_130", **UNSETTLED)
oracle("adaptive_with_missing_outcomes", f"""
SELECT cohort, ts, method, {single('alpha_t', 'lower', 'upper')} FROM (
    SELECT cohort, ts, method, NULL::DOUBLE AS alpha_t, lower, upper FROM rolling_240
    UNION ALL SELECT cohort, ts, 'aci', alpha, lower, upper FROM aci_bounds WHERE gamma = 0.01::DOUBLE
    UNION ALL SELECT cohort, ts, 'sa_acp', alpha_block, lower, upper FROM sa_bounds WHERE variant = 'main')""", **UNSETTLED)
oracle("stream_with_missing_outcomes", ONLINE, **UNSETTLED)
oracle("stream_joined_intervals", ONLINE)

# shift detection ---------------------------------------------------------------------------

oracle("shift_wasserstein_detector", """
SELECT t.cohort, t.ts, round(s.delta, 6) AS shift_score, s.ready AND s.delta >= 0.12 AS shift_flag
FROM test t JOIN shift_96_200 s USING (cohort, pos)""")
oracle("shift_mean_detector", """
SELECT cohort, ts, round(CASE WHEN n >= 24 THEN z ELSE 0.0 END, 6) AS shift_score, n >= 24 AND z >= 2.0 AS shift_flag
FROM (SELECT t.cohort, t.ts, least(t.pos + 1, 96) AS n,
             abs(avg(t.score) OVER w - r.mu) / (r.sd / sqrt(least(t.pos + 1, 96))) AS z
      FROM test t JOIN (SELECT cohort, avg(score) AS mu, greatest(stddev_pop(score), 1e-6) AS sd FROM cal GROUP BY cohort) r USING (cohort)
      WINDOW w AS (PARTITION BY t.cohort ORDER BY t.pos ROWS BETWEEN 95 PRECEDING AND CURRENT ROW))""")


def two_sample(source: str, key: str, value: str, period: str, pre: str, post: str) -> dict[str, str]:
    return {
        "ts_values": f"""
    SELECT {key} AS k, {value} AS v, count(CASE WHEN {period} = '{pre}' THEN 1 END) AS a, count(CASE WHEN {period} = '{post}' THEN 1 END) AS b
    FROM {source} WHERE {period} IN ('{pre}', '{post}') GROUP BY 1, 2""",
        "ts_ranked": """
    SELECT k, v, a, b, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER (PARTITION BY k) AS n1, sum(b) OVER (PARTITION BY k) AS n2,
           lead(v) OVER w AS nv
    FROM ts_values WINDOW w AS (PARTITION BY k ORDER BY v)""",
        "ts_sums": """
    SELECT k, max(n1)::BIGINT AS n_pre, max(n2)::BIGINT AS n_post, max(n1)::DOUBLE AS n1, max(n2)::DOUBLE AS n2,
           sum(abs(ca::DOUBLE / n1 - cb::DOUBLE / n2) * (nv - v)) AS wasserstein_1d, max(abs(ca::DOUBLE / n1 - cb::DOUBLE / n2)) AS ks_statistic,
           sum(a * ((ca + cb - a - b)::DOUBLE + (a + b + 1) / 2.0)) - max(n1)::DOUBLE * (max(n1)::DOUBLE + 1) / 2 AS u_statistic,
           sum((a + b)::DOUBLE * (a + b) * (a + b) - (a + b)) AS tie_term
    FROM ts_ranked GROUP BY k""",
        "ts_stats": """
    SELECT *, (greatest(u_statistic, n1 * n2 - u_statistic) - n1 * n2 / 2 - 0.5)
              / sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - tie_term / ((n1 + n2) * (n1 + n2 - 1)))) AS mann_whitney_z,
           sqrt(round(n1 * n2 / (n1 + n2))) * ks_statistic AS lam FROM ts_sums""",
        "ts_p": """
    SELECT s.*, CASE WHEN lam < 0.2 THEN 1.0 ELSE least(1.0, greatest(0.0, (
               SELECT sum(CASE WHEN i % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2.0 * s.lam * s.lam * i * i)) FROM range(1, 101) t(i)))) END AS ks_p_value
    FROM ts_stats s""",
    }


SPLIT_TESTS = two_sample("split_series", "cohort", "load_kwh", "split", "train", "test")
# the same published fit of erfc
_T = "(1.0::DOUBLE / (1.0 + greatest(mann_whitney_z, 0.0) / sqrt(2.0::DOUBLE) / 2.0))"
_POWER = "0.17087277::DOUBLE"
for _c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
    _POWER = f"({_POWER} * {_T} + {_c}::DOUBLE)"
CTES["ts_both"] = f"""
    SELECT *, least(1.0, {_T} * exp({_POWER} - pow(greatest(mann_whitney_z, 0.0) / sqrt(2.0::DOUBLE), 2))) AS mann_whitney_p_value FROM ts_p"""
oracle("shift_two_sample", f"""
SELECT k AS cohort, n_pre, n_post, {rounded(6, 'tie_term', 'wasserstein_1d', 'ks_statistic', 'ks_p_value', 'u_statistic', 'mann_whitney_z', 'mann_whitney_p_value')},
       ks_p_value < 0.01 AS significant_shift FROM ts_both""", **SPLIT_TESTS)
oracle("shift_two_sample_large_groups", f"""
SELECT k AS l_linestatus, n_pre, n_post, {rounded(4, 'wasserstein_1d', 'ks_statistic', 'u_statistic', 'mann_whitney_z')} FROM ts_stats""",
       **two_sample("lineitem", "l_linestatus", "l_extendedprice", "l_returnflag", "A", "N"))
CTES["moments"] = """
    SELECT cohort, split, count(load_kwh) AS n, avg(load_kwh) AS mean, stddev_pop(load_kwh) AS std, quantile_cont(load_kwh, 0.5) AS median,
           quantile_cont(load_kwh, 0.95) AS p95, quantile_cont(load_kwh, 0.99) AS p99
    FROM split_series GROUP BY cohort, split"""
oracle("shift_moments", f"SELECT cohort, split, n, {rounded(6, 'mean', 'std', 'median', 'p95', 'p99')} FROM moments")


def autocorrelation(source: str, keys: str) -> str:
    return f"""
    SELECT {keys}, avg(abs(x - x1)) AS mean_absolute_ramp, sum(d * d48) / sum(d * d) AS acf_48, sum(d * d336) / sum(d * d) AS acf_336,
           least(350, floor(count(*) / 2.0) - 1) AS reach
    FROM (SELECT {keys}, load_kwh AS x, lag(load_kwh) OVER w AS x1, load_kwh - mu AS d, lag(load_kwh - mu, 48) OVER w AS d48,
                 lag(load_kwh - mu, 336) OVER w AS d336
          FROM (SELECT *, avg(load_kwh) OVER (PARTITION BY {keys}) AS mu FROM {source}) WINDOW w AS (PARTITION BY {keys} ORDER BY ts))
    GROUP BY {keys}"""


oracle("shift_ramps_autocorrelation", f"""
SELECT cohort, {rounded(6, 'mean_absolute_ramp', 'acf_48', 'acf_336')} FROM ({autocorrelation('series', 'cohort')})""")
CTES["acf"] = autocorrelation("split_series", "cohort, split")
PAIRS = ("mean", "std", "median", "p95", "p99")
oracle("shift_characterisation", f"""
SELECT a.cohort, a.n AS n_pre, b.n AS n_post, {', '.join(f'round(a.{c}, 4) AS {c}_pre, round(b.{c}, 4) AS {c}_post' for c in PAIRS)},
       round(x.mean_absolute_ramp, 4) AS mean_absolute_ramp_pre, round(z.mean_absolute_ramp, 4) AS mean_absolute_ramp_post,
       round((b.mean - a.mean) / a.mean * 100.0, 2) AS mean_pct_change, round((b.std - a.std) / a.std * 100.0, 2) AS std_pct_change,
       {', '.join(f"CASE WHEN least(x.reach, z.reach) >= {k} THEN round({t}.acf_{k}, 4) END AS acf_{k}_{s}"
                  for k in (48, 336) for t, s in (('x', 'pre'), ('z', 'post')))},
       round(p.wasserstein_1d, 4) AS wasserstein_1d, round(p.ks_statistic, 4) AS ks_statistic, round(p.ks_p_value, 4) AS ks_p_value,
       round(p.mann_whitney_p_value, 4) AS mann_whitney_p_value, p.ks_p_value < 0.01 AS significant_shift
FROM moments a JOIN moments b ON b.cohort = a.cohort AND b.split = 'test'
JOIN acf x ON x.cohort = a.cohort AND x.split = 'train' JOIN acf z ON z.cohort = a.cohort AND z.split = 'test'
JOIN ts_both p ON p.k = a.cohort WHERE a.split = 'train'""", **SPLIT_TESTS)

# backtest -----------------------------------------------------------------------------------

oracle("backtest_intervals", f"""
SELECT cohort, ts, method, {single('y', 'y_pred', 'lower', 'upper')} FROM five""")
oracle("backtest_wide", f"""
SELECT b.*, CAST(CAST(round(a.alpha, 12) AS FLOAT) AS DOUBLE) AS aci_alpha, CAST(CAST(round(s.alpha_block, 12) AS FLOAT) AS DOUBLE) AS sa_acp_alpha, CAST(CAST(round(s.gamma_t, 12) AS FLOAT) AS DOUBLE) AS sa_acp_gamma,
       CAST(CAST(round(s.shift_score, 12) AS FLOAT) AS DOUBLE) AS shift_score, s.shift_flag
FROM (SELECT cohort, ts, CAST(CAST(round(max(y), 12) AS FLOAT) AS DOUBLE) AS y_true, CAST(CAST(round(max(y_pred), 12) AS FLOAT) AS DOUBLE) AS y_point_pred,
             {', '.join(f"CAST(CAST(round(max(CASE WHEN method = '{m}' THEN {c} END), 12) AS FLOAT) AS DOUBLE) AS {m}_{c}"
                        for m in ('uncalibrated', 'static', 'cqr', 'rolling', 'aci', 'sa_acp') for c in ('lower', 'upper'))}
      FROM six GROUP BY cohort, ts) b
JOIN aci_bounds a ON a.cohort = b.cohort AND a.ts = b.ts AND a.gamma = 0.01::DOUBLE
JOIN sa_bounds s ON s.cohort = b.cohort AND s.ts = b.ts""")
oracle("backtest_method_table", interval_metrics("""(SELECT cohort, CASE method WHEN 'uncalibrated' THEN 'P0_Uncalibrated_Quantile'
    WHEN 'static' THEN 'P1_Static_Split_Conformal' WHEN 'cqr' THEN 'P2_CQR' WHEN 'rolling' THEN 'P3_Rolling_Conformal'
    WHEN 'aci' THEN 'P4_ACI' ELSE 'P5_SA_ACP' END AS method, y, lower, upper FROM six)""", "cohort, method"))

# long series at default windows
DAILY = {
    "shipped": """
    SELECT 'g' || (l_suppkey % 4) AS cohort, CAST(l_shipdate AS TIMESTAMP) AS ts, sum(l_quantity)::DOUBLE AS y FROM lineitem GROUP BY ALL""",
    "daily": """
    SELECT *, row_number() OVER w - 1 AS seq, lag(y) OVER w AS y_pred, count(*) OVER (PARTITION BY cohort) AS n
    FROM (SELECT g.cohort, g.ts, coalesce(s.y, 0.0) AS y
          FROM (SELECT cohort, unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS ts FROM shipped GROUP BY cohort) g
          LEFT JOIN shipped s ON s.cohort = g.cohort AND s.ts = g.ts)
    WINDOW w AS (PARTITION BY cohort ORDER BY ts)""",
    "forecasts": """
    SELECT cohort, ts, CASE WHEN seq * 10 < n * 6 THEN 'calibration' ELSE 'test' END AS split, y, y_pred, y_pred * 0.75 AS q_lo,
           y_pred * 1.25 AS q_hi, abs(y - y_pred) AS score, greatest(y_pred * 0.75 - y, y - y_pred * 1.25) AS violation
    FROM daily WHERE y_pred IS NOT NULL""",
    "sa_steps": """
    SELECT t.*, s.delta, s.ready AND s.delta >= 1.25 AS flagged FROM test t JOIN shift_336_1344 s USING (cohort, pos)""",
} | transport(336, 1344)
for w in (672, 1344, 2688):
    DAILY[f"pool_{w}"], DAILY[f"rolling_{w}"] = rolling(w)
oracle("backtest_default_windows", interval_metrics("six", "cohort, method"), **DAILY, five=CTES["five"].replace("rolling_240", "rolling_1344"))
oracle("shift_detector_default_windows", f"""
SELECT cohort, ts, {single('shift_score')}, shift_flag, CAST(CAST(round(alpha_block, 12) AS FLOAT) AS DOUBLE) AS alpha_t, {single('lower', 'upper')}
FROM sa_bounds""", **DAILY)
oracle("ablation_window_lengths_default", interval_metrics("(" + " UNION ALL ".join(
    f"SELECT cohort, {d}::INTEGER AS window_days, y, lower, upper FROM rolling_{48 * d}" for d in (14, 28, 56)) + ")", "cohort, window_days"), **DAILY)

# evaluation ---------------------------------------------------------------------------------

oracle("interval_metrics_by_supplier", interval_metrics("bands", "l_suppkey", "0.2"))
oracle("interval_pinball", """
SELECT cohort, tau::DOUBLE AS tau, round(avg(greatest(tau::DOUBLE * (y - q), (tau::DOUBLE - 1.0) * (y - q))), 6) AS pinball
FROM (SELECT cohort, y, 0.05 AS tau, q_lo AS q FROM test UNION ALL SELECT cohort, y, 0.5, q_mid FROM test
      UNION ALL SELECT cohort, y, 0.95, q_hi FROM test) GROUP BY cohort, tau""")
METHOD_TABLE = interval_metrics("five", "cohort, method")
oracle("interval_method_table", METHOD_TABLE)
SCORE = """upper - lower + CASE WHEN y < lower THEN 2.0::DOUBLE / 0.1::DOUBLE * (lower - y) ELSE 0.0 END
    + CASE WHEN y > upper THEN 2.0::DOUBLE / 0.1::DOUBLE * (y - upper) ELSE 0.0 END"""
oracle("interval_daily_sums", f"""
SELECT l_suppkey, CAST(ts AS DATE) AS day, count(*) AS n_obs, count(CASE WHEN y >= lower AND y <= upper THEN 1 END) AS n_covered,
       round(sum(upper - lower), 7) AS sum_width, round(sum({SCORE}), 7) AS sum_score
FROM bands GROUP BY 1, 2""")
INSIDE = "CASE WHEN y >= lower AND y <= upper THEN 1.0 ELSE 0.0 END"
oracle("interval_daily_diagnostics", f"""
SELECT b.cohort, CAST(b.ts AS DATE) AS day, CAST(CAST(round(avg(CASE WHEN b.method = 'sa_acp' THEN abs(b.y - b.y_pred) END), 12) AS FLOAT) AS DOUBLE) AS day_mae,
       CAST(CAST(round(avg(CASE WHEN b.method = 'sa_acp' THEN {INSIDE.replace('y ', 'b.y ').replace('lower', 'b.lower').replace('upper', 'b.upper')} END), 12) AS FLOAT) AS DOUBLE) AS day_sa_cov,
       CAST(CAST(round(avg(CASE WHEN b.method = 'static' THEN {INSIDE.replace('y ', 'b.y ').replace('lower', 'b.lower').replace('upper', 'b.upper')} END), 12) AS FLOAT) AS DOUBLE) AS day_static_cov,
       count(CASE WHEN b.method = 'sa_acp' AND s.shift_flag THEN 1 END) AS day_flagged_steps,
       CAST(CAST(round(abs(avg(CASE WHEN b.method = 'sa_acp' THEN {INSIDE.replace('y ', 'b.y ').replace('lower', 'b.lower').replace('upper', 'b.upper')} END) - 0.9::DOUBLE), 12) AS FLOAT) AS DOUBLE) AS day_sa_ace
FROM six b JOIN sa_bounds s ON s.cohort = b.cohort AND s.ts = b.ts GROUP BY 1, 2""")
CTES["labelled"] = """
    SELECT b.*, r.ramp, hour(b.ts) AS h,
           quantile_cont(b.y, 0.333) OVER (PARTITION BY b.cohort) AS y1, quantile_cont(b.y, 0.667) OVER (PARTITION BY b.cohort) AS y2,
           quantile_cont(r.ramp, 0.333) OVER (PARTITION BY b.cohort) AS r1, quantile_cont(r.ramp, 0.667) OVER (PARTITION BY b.cohort) AS r2
    FROM b_static b JOIN (SELECT cohort, ts, coalesce(abs(y - lag(y) OVER (PARTITION BY cohort ORDER BY ts)), 0.0) AS ramp FROM test) r
      ON r.cohort = b.cohort AND r.ts = b.ts"""
DIMENSIONS = {
    "by_hour": "CAST(h AS VARCHAR)",
    "by_peak_status": "CASE WHEN h BETWEEN 17 AND 21 THEN 'Peak (17-21h)' ELSE 'Off-Peak' END",
    "by_day_type": "CASE WHEN isodow(ts) >= 6 THEN 'Weekend' ELSE 'Weekday' END",
    "by_season": "'Winter'",
    "by_load_regime": "CASE WHEN y <= y1 THEN 'Low Demand' WHEN y <= y2 THEN 'Medium Demand' ELSE 'High Demand' END",
    "by_ramp_regime": "CASE WHEN ramp <= r1 THEN 'Low Ramp' WHEN ramp <= r2 THEN 'Medium Ramp' ELSE 'High Ramp' END",
    "by_shift_status": "CASE WHEN h < 6 THEN 'Shift Detected' ELSE 'Normal / Low Shift' END",
}
oracle("conditional_reliability", interval_metrics(
    "(" + " UNION ALL ".join(
        f"SELECT cohort, '{d}' AS dimension, {e} AS subgroup, y, lower, upper FROM labelled" for d, e in DIMENSIONS.items()
    ) + ")", "cohort, dimension, subgroup"))
oracle("conditional_reliability_by_shift", interval_metrics(
    "(" + " UNION ALL ".join(
        f"SELECT cohort, '{d}' AS dimension, {e} AS subgroup, y, lower, upper FROM labelled"
        for d, e in (DIMENSIONS | {"by_shift_status": "CASE WHEN shift_flag THEN 'Shift Detected' ELSE 'Normal / Low Shift' END"}).items()
    ) + ")", "cohort, dimension, subgroup"), labelled=CTES["labelled"].replace("b_static b", "sa_bounds b"))
oracle("conditional_reliability_suppliers", interval_metrics("""(
    SELECT b.*, region, CASE WHEN y <= q1 THEN 'Low Demand' WHEN y <= q2 THEN 'Medium Demand' ELSE 'High Demand' END AS load_regime
    FROM (SELECT *, CAST(l_suppkey % 5 AS INTEGER) AS region FROM bands) b
    JOIN (SELECT CAST(l_suppkey % 5 AS INTEGER) AS region, quantile_cont(y, 0.333) AS q1, quantile_cont(y, 0.667) AS q2 FROM bands GROUP BY 1) USING (region))""",
    "region, load_regime"))
oracle("interval_ramps", """
SELECT cohort, ts, round(coalesce(abs(y - lag(y) OVER (PARTITION BY cohort ORDER BY ts)), 0.0), 6) AS ramp FROM test""")
oracle("hourly_coverage", f"""
SELECT cohort, CAST(hour(ts) AS INTEGER) AS hour, round(avg(CASE WHEN method = 'static' THEN {INSIDE} END) * 100, 4) AS static_pct,
       round(avg(CASE WHEN method = 'cqr' THEN {INSIDE} END) * 100, 4) AS cqr_pct
FROM (SELECT * FROM b_static UNION ALL SELECT * FROM b_cqr) GROUP BY 1, 2""")
oracle("coverage_width", f"""
SELECT cohort, method, mpiw, round(empirical_coverage * 100, 2) AS coverage_pct FROM ({METHOD_TABLE})""")
oracle("shift_against_residual", """
SELECT cohort, ts, round(shift_score, 6) AS shift_score, round(abs(y - y_pred), 6) AS abs_residual FROM sa_bounds""")
oracle("formatted_results", f"""
SELECT cohort, method, round(empirical_coverage * 100, 2) AS coverage_pct, round(target_coverage * 100, 2) AS target_pct,
       round(ace * 100, 2) AS ace_pct, mpiw, interval_score FROM ({METHOD_TABLE})""")
oracle("worst_days_by_error", """
SELECT cohort, day, round(day_mae, 6) AS day_mae, CAST(row_number() OVER (PARTITION BY cohort ORDER BY day_mae DESC, day) AS INTEGER) AS rank
FROM (SELECT cohort, CAST(ts AS DATE) AS day, avg(abs(y - y_pred)) AS day_mae FROM forecasts GROUP BY 1, 2)
QUALIFY rank <= 20""")
oracle("worst_days_by_coverage", f"""
SELECT cohort, day, CAST(row_number() OVER (PARTITION BY cohort ORDER BY day_static_ace DESC, day) AS INTEGER) AS rank, day_static_ace
FROM (SELECT cohort, CAST(ts AS DATE) AS day, round(abs(avg({INSIDE}) - 0.9::DOUBLE), 6) AS day_static_ace FROM b_static GROUP BY 1, 2)
QUALIFY rank <= 3""")
oracle("methods_stacked", interval_metrics("(SELECT * FROM b_static UNION ALL SELECT * FROM b_cqr)", "cohort, method"))

# bootstrap ----------------------------------------------------------------------------------


def draws(sizes: str, n_resamples: int, seed: int) -> str:
    return f"""
    SELECT n_days, b, day_idx, count(*) AS times FROM (
        SELECT s.n_days, r.b, ('0x' || substr(md5(concat_ws('|', '{seed}', CAST(r.b AS VARCHAR), CAST(k.k AS VARCHAR))), 1, 8))::BIGINT % s.n_days AS day_idx
        FROM (SELECT DISTINCT n_days FROM {sizes}) s CROSS JOIN (SELECT unnest(range({n_resamples})) AS b) r
        JOIN (SELECT unnest(range(1000)) AS k) k ON k.k < s.n_days)
    GROUP BY ALL"""


def bootstrap(days: str, keys: str, a: str, b: str, n_resamples: int, seed: int, digits: int | None) -> dict[str, str]:
    def metric(s: str) -> dict[str, str]:
        cov, target = f"c_{s}::DOUBLE / n_{s}", "(1.0::DOUBLE - 0.1::DOUBLE)"
        return {"ace": f"abs({cov} - {target})", "interval_score": f"s_{s} / n_{s}", "mpiw": f"w_{s} / n_{s}", "empirical_coverage": cov}

    def shown(e: str) -> str:
        return e if digits is None else f"round({e}, {digits})"

    sums = {"n": "1", "c": "CASE WHEN y >= lower AND y <= upper THEN 1 ELSE 0 END", "w": "upper - lower", "s": SCORE}
    per_day = ", ".join(
        f"sum(CASE WHEN method = '{m}' THEN {e} END) AS {c}_{s}" for s, m in (("a", a), ("b", b)) for c, e in sums.items()
    )
    return {
        "bs_days": f"""
    SELECT {keys}, day, row_number() OVER (PARTITION BY {keys} ORDER BY day) - 1 AS day_idx, count(*) OVER (PARTITION BY {keys}) AS n_days,
           {', '.join(f'{c}_{s}' for s in 'ab' for c in sums)}
    FROM (SELECT {keys}, day, {per_day} FROM {days} GROUP BY {keys}, day)""",
        "bs_draws": draws("bs_days", n_resamples, seed),
        "bs_drawn": f"""
    SELECT {keys}, d.n_days, b, {', '.join(f'sum(d.{c}_{s} * times) AS {c}_{s}' for s in 'ab' for c in sums)}
    FROM bs_days d JOIN bs_draws x ON x.n_days = d.n_days AND x.day_idx = d.day_idx GROUP BY {keys}, d.n_days, b""",
        "bs_samples": f"""
    SELECT {keys}, n_days, b, {', '.join(f'{shown(e)} AS {m}_{s}' for s in 'ab' for m, e in metric(s).items())} FROM bs_drawn""",
        "bs_long": " UNION ALL ".join(
            f"SELECT {keys}, n_days, '{m}' AS metric, {m}_a AS a, {m}_b AS z, {m}_a - {m}_b AS d FROM bs_samples" for m in metric("a")
        ),
    }


def bootstrap_result(keys: str) -> str:
    return f"""
SELECT {keys}, metric, CAST(CAST(round(avg(a), 12) AS FLOAT) AS DOUBLE) AS mean_a, CAST(CAST(round(avg(z), 12) AS FLOAT) AS DOUBLE) AS mean_b, CAST(CAST(round(avg(d), 12) AS FLOAT) AS DOUBLE) AS mean_diff,
       CAST(CAST(round(quantile_cont(d, 0.025), 12) AS FLOAT) AS DOUBLE) AS ci_lower, CAST(CAST(round(quantile_cont(d, 0.975), 12) AS FLOAT) AS DOUBLE) AS ci_upper,
       CAST(CAST(round(least(1.0, 2.0 * least(avg(CASE WHEN d <= 0 THEN 1.0 ELSE 0.0 END), avg(CASE WHEN d >= 0 THEN 1.0 ELSE 0.0 END))), 12) AS FLOAT) AS DOUBLE) AS p_value,
       quantile_cont(d, 0.025) > 0 OR quantile_cont(d, 0.975) < 0 AS is_significant_05, count(*) AS n_resamples, n_days
FROM bs_long GROUP BY {keys}, metric, n_days"""


CTES["two_methods"] = """
    SELECT cohort, method, CAST(ts AS DATE) AS day, y, lower, upper FROM (SELECT * FROM b_static UNION ALL SELECT * FROM b_cqr)"""
oracle("bootstrap_draws", "SELECT n_days, day_idx, b, times FROM bs_draws",
       split_days="SELECT split, count(DISTINCT CAST(ts AS DATE)) AS n_days FROM split_series GROUP BY split",
       bs_draws=draws("split_days", 200, 42))
oracle("bootstrap_samples", "SELECT * FROM bs_samples", **bootstrap("two_methods", "cohort", "cqr", "static", 300, 42, 4))
oracle("bootstrap_comparison", bootstrap_result("cohort"), **bootstrap("two_methods", "cohort", "cqr", "static", 2000, 42, 4))
oracle("bootstrap_unrounded", bootstrap_result("cohort"), **bootstrap("two_methods", "cohort", "cqr", "static", 500, 7, None))
oracle("bootstrap_table", """
SELECT cohort, metric, round(avg(a), 4) AS mean_a, round(avg(z), 4) AS mean_b, round(avg(d), 4) AS mean_diff,
       printf('[%.4f, %.4f]', round(quantile_cont(d, 0.025), 4), round(quantile_cont(d, 0.975), 4)) AS ci_95,
       round(least(1.0, 2.0 * least(avg(CASE WHEN d <= 0 THEN 1.0 ELSE 0.0 END), avg(CASE WHEN d >= 0 THEN 1.0 ELSE 0.0 END))), 4) AS p_value,
       CASE WHEN quantile_cont(d, 0.025) > 0 OR quantile_cont(d, 0.975) < 0 THEN 'Yes' ELSE 'No' END AS significant
FROM bs_long GROUP BY cohort, metric""", **bootstrap("two_methods", "cohort", "cqr", "static", 499, 42, 4))
oracle("bootstrap_few_days", """
SELECT cohort, m AS metric, NULL::DOUBLE AS mean_a, NULL::DOUBLE AS mean_b, NULL::DOUBLE AS mean_diff, NULL::DOUBLE AS ci_lower,
       NULL::DOUBLE AS ci_upper, NULL::DOUBLE AS p_value, NULL::BOOLEAN AS is_significant_05, 50::BIGINT AS n_resamples, 4::BIGINT AS n_days
FROM (SELECT DISTINCT cohort FROM test) CROSS JOIN (SELECT unnest(['ace', 'interval_score', 'mpiw', 'empirical_coverage']) AS m)""")
CTES["two_bands"] = """
    SELECT l_suppkey, 'narrow' AS method, date_trunc('month', ts) AS day, y, lower, upper FROM bands
    UNION ALL SELECT l_suppkey, 'wide', date_trunc('month', ts), y, lower, upper * 1.1 FROM bands"""
oracle("bootstrap_suppliers", bootstrap_result("l_suppkey"), **bootstrap("two_bands", "l_suppkey", "narrow", "wide", 100, 1, 4))

# ablations ----------------------------------------------------------------------------------

oracle("ablation_core_methods", interval_metrics("""(
    SELECT cohort, 'Static Conformal (P1)' AS configuration, y, lower, upper FROM b_static
    UNION ALL SELECT cohort, 'Rolling Conformal (P3)', y, lower, upper FROM rolling_240
    UNION ALL SELECT cohort, 'Adaptive Conformal Inference (P4)', y, lower, upper FROM b_aci
    UNION ALL SELECT cohort, CASE variant WHEN 'a4' THEN 'SA-ACP (Detector Disabled - A4)' ELSE 'SA-ACP (Proposed - P5)' END, y, lower, upper FROM sa_bounds)""",
    "cohort, configuration"), sa_walk=sa_walk("'main', 'a4'"))
oracle("ablation_gamma_rates", interval_metrics("aci_bounds", "cohort, gamma"))
oracle("ablation_window_lengths", interval_metrics("""(
    SELECT 1 AS window_days, * FROM rolling_48 UNION ALL SELECT 3, * FROM rolling_144 UNION ALL SELECT 14, * FROM rolling_672)""",
    "cohort, window_days"))
LEVELS = (("80%", "0.2"), ("90%", "0.1"), ("95%", "0.05"))
oracle("ablation_coverage_levels", interval_metrics("(" + " UNION ALL ".join(
    f"""SELECT cohort, 'Static Conformal' AS method, '{n}' AS nominal_level, {a}::DOUBLE AS alpha, y,
        greatest(0.0, y_pred - q) AS lower, y_pred + q AS upper
        FROM test JOIN (SELECT cohort, {list_quantile('s', 'n', a)} AS q FROM cal_lists) USING (cohort)""" for n, a in LEVELS
) + """ UNION ALL SELECT cohort, 'SA-ACP (Proposed)', variant, CASE variant WHEN '80%' THEN 0.2 WHEN '90%' THEN 0.1 ELSE 0.05 END::DOUBLE,
        y, lower, upper FROM sa_bounds)""", "cohort, method, nominal_level", "alpha"),
    sa_walk=sa_walk("'80%', '90%', '95%'"))
oracle("ablation_shift_aware_variations", interval_metrics("sa_bounds", "cohort, variant"),
       sa_walk=sa_walk("'slow_only', 'fast_moderate', 'fast_aggressive'"))
oracle("ablation_lag_choice", """
SELECT cohort, CAST(k AS INTEGER) AS season_lag, round(var_pop(y - p), 6) AS residual_variance, round(avg(abs(y - p)), 6) AS mae,
       round(sqrt(avg((y - p) * (y - p))), 6) AS rmse
FROM (SELECT cohort, 48 AS k, load_kwh AS y, greatest(0.0, lag48) AS p FROM lagged WHERE lag336 IS NOT NULL
      UNION ALL SELECT cohort, 336, load_kwh, greatest(0.0, lag336) FROM lagged WHERE lag336 IS NOT NULL) GROUP BY 1, 2""")

# streams ------------------------------------------------------------------------------------

oracle("stream_cohort_load", """
SELECT cohort, time_bucket(INTERVAL 30 MINUTE, timestamp) AS ts, CAST(CAST(round(sum(energy_kwh), 12) AS FLOAT) AS DOUBLE) AS load_kwh, CAST(CAST(round(avg(energy_kwh), 12) AS FLOAT) AS DOUBLE) AS load_mean_kwh
FROM members GROUP BY 1, 2""")
oracle("stream_dedup", """
SELECT DISTINCT user_id AS household_id, date_trunc('hour', ts) AS timestamp FROM events""")
oracle("stream_online_intervals", f"""
SELECT cohort, ts, method, {single('lower', 'upper')} FROM six
WHERE method IN ('rolling', 'aci', 'sa_acp')""")
