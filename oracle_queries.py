"""DuckDB statements giving the expected result of each registered query on the same tables."""

from __future__ import annotations

import math
from statistics import NormalDist

SUPPLIER_CONFIDENCES = (0.25, 0.4, 0.55, 0.8)
ASSETS = ["AF", "AO", "NF", "NO", "RF", "RO"]
SERIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
BAR = """min(l_extendedprice / l_quantity) AS low, max(l_extendedprice / l_quantity) AS high,
  CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100.0 / sum(l_quantity) AS adj_close, CAST(sum(l_quantity) AS BIGINT) AS volume"""

CTE = {
    "prices": f"SELECT concat(l_returnflag, l_linestatus) AS asset, CAST(l_shipdate AS DATE) AS date, {BAR} FROM lineitem GROUP BY 1, 2",
    "sprices": f"SELECT concat('S', l_suppkey) AS asset, CAST(l_shipdate AS DATE) AS date, {BAR} FROM lineitem GROUP BY 1, 2",
    "bprices": f"SELECT p_brand AS asset, CAST(l_shipdate AS DATE) AS date, {BAR} FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2",
    "macro": """SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS obs_date,
      CASE WHEN day(CAST(o_orderdate AS DATE)) = 13 THEN NULL ELSE avg(o_totalprice) END AS value
      FROM orders GROUP BY o_orderpriority, CAST(o_orderdate AS DATE)""",
    "runs": """SELECT o_orderkey AS run_id, o_custkey AS config_id,
      CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'P' THEN 'skipped' ELSE 'error' END AS status,
      CASE o_orderkey % 3 WHEN 0 THEN 'schedule' WHEN 1 THEN 'manual' ELSE 'startup' END AS trig, o_orderdate AS started_at FROM orders""",
    "weights": """SELECT run_id, asset, q / sum(q) OVER (PARTITION BY run_id) AS weight FROM (
      SELECT l_orderkey AS run_id, concat(l_returnflag, l_linestatus) AS asset, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2)""",
    "configs": """SELECT c_custkey AS config_id, c_name AS name,
      CASE WHEN c_custkey % 5 = 0 THEN 'fracdiff_macro' ELSE 'basic' END AS feature_set,
      CASE WHEN c_custkey % 11 = 0 THEN 'unheard' ELSE 'ewma' END AS forecaster,
      CAST(c_nationkey % 7 AS BIGINT) AS scenario_id,
      CASE WHEN c_custkey % 2 = 0 THEN 'min_variance' ELSE 'mvu' END AS optimizer,
      c_custkey = 7 AS is_central, TIMESTAMP '1997-06-01 00:00:00' AS updated_at FROM customer""",
    "stages": """SELECT run_id, ['freshness','ingest','features','forecast','blend','optimize','notify'][l] AS stage,
      CASE WHEN d < 0.09 THEN 'ok' ELSE 'error' END AS status,
      strftime(s, '%Y-%m-%d %H:%M:%S') AS started_at,
      CASE WHEN q > 4 THEN strftime(e, '%Y-%m-%d %H:%M:%S') ELSE 'unknown' END AS finished_at,
      CASE WHEN q <= 3 THEN '{broken'
        WHEN l = 1 THEN concat('{"data_max_date": "', CASE WHEN q > 10 THEN '2001-11-04' ELSE strftime(s, '%Y-%m-%d') END,
          '", "data_fetched_at": "', CASE WHEN q > 20 THEN '2001-11-05' ELSE strftime(s, '%Y-%m-%d') END, '"}')
        WHEN l = 6 THEN concat('{"objective": {"form": "', CASE WHEN q > 25 THEN 'utility' ELSE 'variance' END, '"}}') END AS detail_json
      FROM (SELECT l_orderkey AS run_id, l_linenumber AS l, max(l_discount) AS d, sum(l_quantity) AS q, min(l_shipdate) AS s, max(l_shipdate) AS e
            FROM lineitem GROUP BY 1, 2)""",
    "bars": """SELECT event_type AS asset, date_trunc('hour', ts) AS bar_start, min_by(value, ts) AS open, max(value) AS high,
      min(value) AS low, max_by(value, ts) AS close, count(*) AS n_ticks FROM events GROUP BY 1, 2""",
    "scenarios": """SELECT * FROM (VALUES (1, 'forecast', NULL, NULL), (2, 'historical', NULL, NULL),
      (3, 'historical', DATE '1996-01-01', DATE '1997-12-31'), (4, 'historical', NULL, DATE '1998-12-31'),
      (5, 'historical', DATE '1999-06-15', NULL), (6, 'counterfactual', NULL, NULL), (7, 'counterfactual', NULL, NULL))
      t(scenario_id, kind, window_start, window_end)""",
    "ghosts": "SELECT * FROM (VALUES ('XX'), ('YY')) t(asset)",
    "sstored": "SELECT asset, date, adj_close, volume FROM sprices WHERE date <= DATE '2000-12-31'",
    "refetched": "SELECT asset, date, CASE WHEN asset LIKE '%7' THEN adj_close * 0.7 ELSE adj_close END AS adj_close, volume FROM sprices",
    "marks": "SELECT max(CAST(l_shipdate AS DATE)) AS data_max_date, max(CAST(l_shipdate AS DATE) + 1) AS data_fetched_at FROM lineitem",
}


def returns_of(prices: str) -> str:
    return f"""SELECT asset, date, log_return, CAST(row_number() OVER (PARTITION BY asset ORDER BY date) - 1 AS BIGINT) AS pos,
      count(*) OVER (PARTITION BY asset) AS n FROM (
      SELECT asset, date, ln(adj_close / lag(adj_close) OVER (PARTITION BY asset ORDER BY date)) AS log_return FROM {prices}) WHERE log_return IS NOT NULL"""


def forecast_of(returns: str, halflife: float = 63.0) -> str:
    return f"""SELECT asset, date, pos, n, log_return, mu,
        stddev_samp(CASE WHEN pos >= 42 THEN e END) OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sigma
      FROM (SELECT *, lag(mu, 21) OVER (PARTITION BY asset ORDER BY date)
              - sum(log_return) OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) AS e
        FROM (SELECT *, 21 * sum(log_return * pow(2.0, pos / {halflife})) OVER w / sum(pow(2.0, pos / {halflife})) OVER w AS mu
          FROM {returns} WINDOW w AS (PARTITION BY asset ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)))"""


def erf(x: str) -> str:
    """The all-positive series, evaluated innermost term first."""
    total = "0.0"
    for k in range(30, 0, -1):
        total = f"(({total}) + 1.0) * q2 / {float(2 * k + 1)}"
    return f"(SELECT x * {2 / math.sqrt(math.pi)!r} * exp(-(x * x)) * (({total}) + 1.0) FROM (SELECT x, x * x * 2.0 AS q2 FROM (SELECT least({x}, 1.5) AS x)))"


def confidence(mu: str, sigma: str) -> str:
    return f"least(greatest({erf(f'abs({mu} / {sigma}) / {math.sqrt(2)!r}')}, 0.02), 0.95)"


def days_after(day: str, lag: str) -> str:
    wd = f"(isodow({day}) - 1)"
    b = f"least({wd}, 4)"
    return f"""(({day}) - CAST(greatest({wd} - 4, 0) AS INTEGER) + CAST(7 * (({b} + {lag}) // 5) + (({b} + {lag}) % 5) - {b} AS INTEGER))"""


for name in ("prices", "sprices", "bprices"):
    CTE[f"{name}_r"] = returns_of(name)
CTE["bars_p"] = "SELECT asset, bar_start AS date, close AS adj_close FROM bars"
CTE["bars_r"] = returns_of("bars_p")
CTE["bars_f"] = forecast_of("bars_r")
CTE["sf"] = forecast_of("sprices_r")
CTE["sf42"] = forecast_of("sprices_r", 42.0)
CTE["sf21"] = forecast_of("sprices_r", 21.0)
CTE["slatest"] = "SELECT * FROM sf WHERE pos = n - 1"
CTE["pf63"] = forecast_of("prices_r")
CTE["pf21"] = forecast_of("prices_r", 21.0)
CTE["pf126"] = forecast_of("prices_r", 126.0)
CTE["available"] = f"SELECT series_id, obs_date, value, {days_after('obs_date', chr(40) + 'CASE WHEN series_id = ' + chr(39) + '5-LOW' + chr(39) + ' THEN 3 ELSE 1 END)')} AS available_date FROM macro"
CTE["released"] = """SELECT series_id, available_date, max_by({'v': value}, obs_date).v AS value FROM available GROUP BY 1, 2"""
CTE["jdates"] = "SELECT date FROM prices_r GROUP BY date HAVING count(*) = 6"
CTE["joint"] = "SELECT asset, date, log_return FROM prices_r WHERE date IN (SELECT date FROM jdates)"
CTE["positions"] = "SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS BIGINT) AS pos, count(*) OVER () AS n_panel FROM jdates"
CTE["centered"] = "SELECT asset, date, log_return - avg(log_return) OVER (PARTITION BY asset) AS x FROM joint"
CTE["pairs"] = """SELECT a.asset AS asset_i, b.asset AS asset_j, count(*) AS n, sum(a.x * b.x) AS xy, sum(a.x * a.x * b.x * b.x) AS x2y2
  FROM centered a JOIN centered b ON a.date = b.date GROUP BY 1, 2"""
CTE["lwstats"] = """SELECT p, n, mu, CASE WHEN least(beta, delta) <= 0 THEN 0.0 ELSE least(beta, delta) / delta END AS shrinkage FROM (
  SELECT p, n, tr / p AS mu, (sq - 2 * (tr / p) * tr + p * (tr / p) * (tr / p)) / p AS delta, (fourth - sq) / (p * n) AS beta FROM (
    SELECT CAST(sum(CASE WHEN asset_i = asset_j THEN 1 ELSE 0 END) AS BIGINT) AS p, max(n) AS n,
      sum(CASE WHEN asset_i = asset_j THEN xy / n ELSE 0 END) AS tr, sum((xy / n) * (xy / n)) AS sq, sum(x2y2 / n) AS fourth FROM pairs))"""
CTE["cov"] = """SELECT asset_i, asset_j, 252 * ((1 - s.shrinkage) * xy / pairs.n + CASE WHEN asset_i = asset_j THEN s.shrinkage * s.mu ELSE 0 END) AS cov
  FROM pairs, lwstats s"""
CTE["prior"] = "SELECT asset_i AS asset, 2.5 * sum(cov / 6.0) AS prior_mu FROM cov GROUP BY 1"


def terms_of(views: str, by: str = "") -> str:
    """Views with H-day columns mu and sigma to annual view, confidence and error variance."""
    return f"""SELECT {by} asset, 12 * mu AS view_mu, c AS view_confidence, 0.05 * (1 - c) / c * v AS omega FROM (
      SELECT {by} f.asset, mu, {confidence('mu', 'sigma')} AS c, cov AS v FROM {views} f JOIN cov ON asset_i = f.asset AND asset_j = f.asset)"""


CTE["platest"] = "SELECT asset, mu, sigma FROM pf63 WHERE pos = n - 1"
CTE["terms"] = "SELECT 1 AS g, * FROM (" + terms_of("platest") + ")"
CTE["groups1"] = "SELECT 1 AS g"


def posterior_ctes(groups: str, terms: str) -> dict[str, str]:
    """The exact one-view-at-a-time update, one step per asset; an asset without a view leaves the state as is."""
    out = {
        "m0": f"SELECT g, asset, prior_mu AS m FROM prior, {groups}",
        "c0": f"SELECT g, asset_i, asset_j, 0.05 * cov AS c FROM cov, {groups}",
    }
    for k, a in enumerate(ASSETS):
        gain = f"""SELECT p.g, col.asset_i AS asset, CASE WHEN t.omega IS NULL THEN 0.0 ELSE col.c / (p.c + t.omega) END AS gain, coalesce(t.view_mu, 0.0) AS q
          FROM c{k} p JOIN c{k} col ON p.g = col.g AND col.asset_j = '{a}' LEFT JOIN {terms} t ON t.g = p.g AND t.asset = '{a}'
          WHERE p.asset_i = '{a}' AND p.asset_j = '{a}'"""
        out[f"g{k}"] = gain
        out[f"m{k + 1}"] = f"""SELECT m.g, m.asset, m.m + g.gain * (g.q - o.m) AS m FROM m{k} m JOIN g{k} g ON g.g = m.g AND g.asset = m.asset
          JOIN m{k} o ON o.g = m.g AND o.asset = '{a}'"""
        out[f"c{k + 1}"] = f"""SELECT c.g, c.asset_i, c.asset_j, c.c - g.gain * r.c AS c FROM c{k} c JOIN g{k} g ON g.g = c.g AND g.asset = c.asset_i
          JOIN c{k} r ON r.g = c.g AND r.asset_i = '{a}' AND r.asset_j = c.asset_j"""
    out["post"] = """SELECT c6.g, c6.asset_i, c6.asset_j, cov.cov + c6.c AS cov FROM c6 JOIN cov USING (asset_i, asset_j)"""
    return out


REPORT = """SELECT {key} AS {name}, m6.asset, round(p.prior_mu, {d}) AS prior_mu, round(t.view_mu, {d}) AS view_mu, round(t.view_confidence, {d}) AS view_confidence,
  round(t.omega, {d}) AS omega, round(m6.m, {d}) AS posterior_mu, round(sqrt(post.cov), {d}) AS posterior_sigma, round(m6.m - p.prior_mu, {d}) AS tilt
  FROM m6 JOIN prior p USING (asset) JOIN post ON post.g = m6.g AND post.asset_i = m6.asset AND post.asset_j = m6.asset
  LEFT JOIN {terms} t ON t.g = m6.g AND t.asset = m6.asset"""


def z_of(c: float) -> float:
    return NormalDist().inv_cdf((1 + c) / 2)


CTE["written"] = f"""SELECT * FROM (VALUES (6, 'RO', 0.073 * 21 / 252, {z_of(0.62)!r}), (7, 'NF', 0.021 * 21 / 252, {z_of(0.35)!r}), (7, 'AO', -0.088 * 21 / 252, {z_of(0.5)!r}),
  (7, 'RO', 0.055 * 21 / 252, {z_of(0.7)!r})) t(scenario_id, asset, mu, z)"""
CTE["written_views"] = "SELECT scenario_id, asset, CAST(mu AS DOUBLE) AS mu, greatest(abs(mu) / z, 1e-8) AS sigma FROM written"


def historical_of(returns: str) -> str:
    return f"""SELECT scenario_id, asset, avg(log_return) * 21 AS mu, greatest(stddev_samp(log_return) * sqrt(21), 1e-8) AS sigma
      FROM {returns} JOIN scenarios ON kind = 'historical' AND (window_start IS NULL OR date >= window_start) AND (window_end IS NULL OR date <= window_end)
      GROUP BY 1, 2 HAVING count(*) >= 2"""


CTE["past_views"] = historical_of("prices_r")
CTE["recipe_views"] = """SELECT 1 AS g, asset, mu, sigma FROM pf63 WHERE pos = n - 1 UNION ALL
  SELECT 2, asset, mu, sigma FROM pf126 WHERE pos = n - 1 UNION ALL
  SELECT CASE scenario_id WHEN 2 THEN 3 ELSE 4 END, asset, mu, sigma FROM past_views WHERE scenario_id IN (2, 3) UNION ALL
  SELECT CASE scenario_id WHEN 7 THEN 5 ELSE 6 END, asset, mu, sigma FROM written_views"""
CTE["recipe_terms"] = terms_of("recipe_views", "g,")
CTE["recipe_groups"] = "SELECT * FROM (VALUES (1), (2), (3), (4), (5), (6)) t(g)"
CTE["folds"] = """SELECT i AS fold, CAST(0 AS BIGINT) AS train_start, first + i * size - 21 AS train_end, first + i * size AS test_start,
  CASE WHEN i = 3 THEN n ELSE first + (i + 1) * size END AS test_end
  FROM (SELECT n, n // 5 AS size, n - 4 * (n // 5) AS first FROM (SELECT count(*) AS n FROM jdates)), (SELECT CAST(range AS BIGINT) AS i FROM range(4))"""
CTE["roles"] = """SELECT date, pos, n_panel, fold, test_start, CASE WHEN pos < train_end THEN 'train' ELSE 'test' END AS role FROM positions JOIN folds
  ON pos < train_end OR (pos >= test_start AND pos < test_end)"""
CTE["points"] = "SELECT date, pos, fold FROM roles WHERE role = 'test' AND (pos - test_start) % 21 = 0 AND pos + 21 <= n_panel - 1"
CTE["realized"] = """SELECT asset, date, CASE WHEN count(*) OVER w = 21 THEN sum(log_return) OVER w END AS realized_h FROM joint
  WINDOW w AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 21 FOLLOWING)"""
CTE["scored"] = """SELECT model, asset, date, fold, mu, sigma, realized_h FROM points JOIN realized USING (date) JOIN (
  SELECT 'ewma63' AS model, asset, date, mu, sigma FROM pf63 WHERE pos >= 51 UNION ALL SELECT 'ewma21', asset, date, mu, sigma FROM pf21 WHERE pos >= 51) USING (asset, date)"""


def ranked(by: str) -> str:
    return f"""SELECT *, rank() OVER (PARTITION BY {by} ORDER BY mu) + (count(*) OVER (PARTITION BY {by}, mu) - 1) / 2.0 AS rx,
      rank() OVER (PARTITION BY {by} ORDER BY realized_h) + (count(*) OVER (PARTITION BY {by}, realized_h) - 1) / 2.0 AS ry FROM scored"""


def metric(by: str, asset: str) -> str:
    return f"""SELECT model, {asset} AS asset, count(*) AS n_points, avg((mu - realized_h) * (mu - realized_h)) AS mse,
      CASE WHEN count(*) > 1 AND min(mu) < max(mu) AND min(realized_h) < max(realized_h) THEN corr(rx, ry) END AS ic,
      avg(CASE WHEN abs(realized_h - mu) <= 1.64 * sigma THEN 1.0 ELSE 0.0 END) AS coverage FROM ({ranked(by)}) GROUP BY {by}"""


CTE["metrics"] = metric("model, asset", "asset") + " UNION ALL " + metric("model", "NULL")
CTE["windows"] = """SELECT asset, date, pos, n, first_c, log_return AS last_c, first_t, last_t, realized_h, ctx, tgt FROM (
  SELECT *, lag(log_return, 15) OVER p AS first_c, lead(log_return, 6) OVER p AS first_t, lead(log_return, 21) OVER p AS last_t,
    sum(log_return) OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 21 FOLLOWING) AS realized_h,
    sum(log_return) OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN 15 PRECEDING AND CURRENT ROW) AS ctx,
    sum(log_return * log_return) OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN 15 PRECEDING AND CURRENT ROW) AS tgt
  FROM sprices_r WINDOW p AS (PARTITION BY asset ORDER BY date)) WHERE pos >= 15 AND pos + 21 <= n - 1"""
CTE["held"] = """SELECT w.*, CASE WHEN pos >= start THEN 'holdout' ELSE 'train' END AS role FROM windows w JOIN (
  SELECT asset, min(pos) + count(*) - greatest(2, CAST(round_even(count(*) * 0.25, 0) AS BIGINT)) AS start FROM windows GROUP BY 1) USING (asset)
  WHERE pos >= start OR pos + 21 < start"""
CTE["predictions"] = """SELECT asset, date, pos, role, realized_h, member, mu AS prediction FROM (
  SELECT asset, date, CAST(row_number() OVER (PARTITION BY asset ORDER BY date) - 1 AS BIGINT) AS pos, realized_h,
    CASE WHEN row_number() OVER (PARTITION BY asset ORDER BY date) - 1 >= count(*) OVER (PARTITION BY asset) * 3 / 4.0 THEN 'holdout' ELSE 'train' END AS role
  FROM (SELECT asset, date, CASE WHEN count(*) OVER f = 21 THEN sum(log_return) OVER f END AS realized_h FROM sprices_r
    WINDOW f AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 21 FOLLOWING)))
  JOIN (SELECT 0 AS member, asset, date, mu FROM sf WHERE pos >= 51 UNION ALL SELECT 1, asset, date, mu FROM sf42 WHERE pos >= 51
    UNION ALL SELECT 2, asset, date, mu FROM sf21 WHERE pos >= 51) USING (asset, date) WHERE realized_h IS NOT NULL"""
CTE["residuals"] = """SELECT a.asset, coalesce(k, 0) AS n_holdout, CASE WHEN k >= 2 THEN greatest(v, 1e-16) ELSE pooled END AS residual_var
  FROM (SELECT DISTINCT asset FROM predictions) a LEFT JOIN (SELECT asset, count(*) AS k, var_samp(e) AS v FROM errors GROUP BY 1) USING (asset),
  (SELECT greatest(coalesce(var_samp(e), 0.0), 1e-16) AS pooled FROM errors)"""
CTE["errors"] = "SELECT asset, pos, any_value(realized_h) - avg(prediction) AS e FROM predictions WHERE role = 'holdout' GROUP BY 1, 2"
CTE["dims"] = """SELECT label, vec_id, unnest(range(1, 65)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings"""
CTE["ecov"] = """SELECT a.label, a.i, b.i AS j, covar_samp(a.x, b.x) AS c, covar_pop(a.x, b.x) AS c0, count(*) AS n
  FROM dims a JOIN dims b ON a.vec_id = b.vec_id AND a.label = b.label GROUP BY 1, 2, 3"""
CTE["collapse"] = """SELECT label, max(n) AS n_rows, count(*) FILTER (i = j) AS dim,
  quantile_disc(sqrt(c), 0.5) FILTER (i = j) AS std_median, pow(sum(c) FILTER (i = j), 2) / sum(c * c) AS effective_rank FROM ecov GROUP BY 1"""
CTE["lastok"] = "SELECT config_id, max(run_id) AS run_id FROM runs WHERE status = 'ok' GROUP BY 1"
CTE["noted"] = """SELECT l.config_id, l.run_id, CASE WHEN json_valid(detail_json) THEN json_extract_string(detail_json, '$.data_max_date') END AS d,
  CASE WHEN json_valid(detail_json) THEN json_extract_string(detail_json, '$.data_fetched_at') END AS f
  FROM lastok l LEFT JOIN (SELECT * FROM stages WHERE stage = 'freshness') s USING (run_id)"""
CTE["gate"] = """SELECT c.config_id, run_id, CASE WHEN run_id IS NOT NULL AND coalesce(d = CAST(data_max_date AS VARCHAR) AND f = CAST(data_fetched_at AS VARCHAR), false)
  THEN 'skip' ELSE 'recompute' END AS decision FROM configs c LEFT JOIN noted USING (config_id), marks"""
CTE["compared"] = """SELECT c.config_id, name, is_central, l.run_id, objective, w.asset, round(w.weight, 8) AS weight FROM configs c LEFT JOIN lastok l USING (config_id)
  LEFT JOIN (SELECT run_id, CASE WHEN json_valid(detail_json) THEN json_extract_string(detail_json, '$.objective.form') END AS objective FROM stages WHERE stage = 'optimize') o USING (run_id)
  LEFT JOIN weights w USING (run_id)"""
CTE["matrix"] = "SELECT date, " + ", ".join(
    f"max(CASE WHEN asset = '{a}' THEN {f} END) AS {a}_{f}" for a in ASSETS for f in ("log_return", "realized_vol")
) + " FROM jfeatures GROUP BY date"
CTE["pfeatures"] = """SELECT asset, date, log_return, v AS realized_vol FROM (SELECT *, count(*) OVER w AS k, stddev_samp(log_return) OVER w * sqrt(252) AS v FROM prices_r
  WINDOW w AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)) WHERE k = 21"""
CTE["sfeatures"] = CTE["pfeatures"].replace("prices_r", "sprices_r")
CTE["jfeatures"] = "SELECT * FROM pfeatures WHERE date IN (SELECT date FROM pfeatures GROUP BY date HAVING count(*) = 6)"
CTE["slogs"] = "SELECT asset, date, ln(adj_close) AS x, row_number() OVER (PARTITION BY asset ORDER BY date) AS rn FROM sprices"
CTE["plogs"] = "SELECT asset, date, ln(adj_close) AS x, row_number() OVER (PARTITION BY asset ORDER BY date) AS rn FROM prices"


def weights_cte(d: float, threshold: float) -> str:
    return f"""SELECT 0 AS k, CAST(1.0 AS DOUBLE) AS w UNION ALL SELECT k + 1, -w * ({d} - k) / (k + 1) FROM ffd WHERE abs(-w * ({d} - k) / (k + 1)) >= {threshold}"""


def fracdiff_sql(logs: str) -> str:
    return f"""SELECT a.asset, a.date, sum(f.w * b.x) AS fracdiff FROM {logs} a JOIN ffd f ON a.rn > f.k JOIN {logs} b ON b.asset = a.asset AND b.rn = a.rn - f.k
      WHERE a.rn >= (SELECT count(*) FROM ffd) GROUP BY 1, 2"""


def asof_sql(dates: str) -> str:
    return f"""SELECT s.series_id, s.date, r.value FROM (SELECT series_id, date FROM (SELECT DISTINCT date FROM {dates}), (SELECT DISTINCT series_id FROM macro)) s
      ASOF LEFT JOIN released r ON r.series_id = s.series_id AND r.available_date <= s.date"""


def pivot_series(source: str) -> str:
    cells = ", ".join(f"""round(max(CASE WHEN series_id = '{s}' THEN value END), 4) AS "{s}" """ for s in SERIES)
    return f"SELECT date, {cells} FROM ({source}) GROUP BY date"


def build(body: str, extra: dict[str, str] | None = None, recursive: bool = False) -> str:
    """Prefix the statement with every named part it uses, in dependency order."""
    import re

    parts = {**CTE, **(extra or {})}
    order: list[str] = []

    def visit(text: str, own: str | None = None) -> None:
        for word in dict.fromkeys(re.findall(r"\b[a-z][a-z0-9_]*\b", text)):
            if word in parts and word != own and word not in order and re.search(rf"(\bFROM|\bJOIN|,)\s*{word}\b", text):
                visit(parts[word], word)
                if word not in order:
                    order.append(word)

    visit(body)
    if not order:
        return body
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(f"{n} AS ({parts[n]})" for n in order) + f" {body}"


def oracle_sql() -> dict[str, str]:
    sql: dict[str, str] = {}
    add = sql.__setitem__
    add("read_panel", build("SELECT asset, date, low, high, adj_close, volume FROM sprices WHERE date >= DATE '1995-01-01' AND date < DATE '2001-01-01'"))
    add("normalized_bars", build("SELECT asset, CAST(bar_start AS DATE) AS date, open, high, low, close, close AS adj_close, n_ticks AS volume FROM bars"))
    add("panel_contract", """SELECT asset, date_key, CASE WHEN date_key LIKE '%/%' THEN 'date key is not YYYY-MM-DD' ELSE 'duplicate key' END AS reason, n_rows FROM (
      SELECT concat('S', l_suppkey) AS asset, CASE WHEN l_quantity = 50 THEN strftime(l_shipdate, '%Y/%m/%d') ELSE strftime(l_shipdate, '%Y-%m-%d') END AS date_key, count(*) AS n_rows
      FROM lineitem GROUP BY 1, 2) WHERE n_rows > 1 OR date_key LIKE '%/%'""")
    add("clean_numeric", "SELECT o_orderkey AS row_id, CASE WHEN day(o_orderdate) NOT IN (13, 14, 15, 16) THEN o_totalprice END AS value, day(o_orderdate) = 15 AS violation FROM orders")
    add("finite_audit", build("""SELECT series_id, 'value missing or non-finite' AS reason, count(*) AS n_bad, string_agg(CAST(obs_date AS VARCHAR), ',' ORDER BY obs_date) FILTER (rn <= 5) AS first_keys
      FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY obs_date) AS rn FROM macro WHERE value IS NULL) GROUP BY 1"""))
    add("upsert_prices", build("""SELECT asset, date, CASE WHEN date >= DATE '2000-07-01' THEN adj_close * 2 ELSE adj_close END AS adj_close,
      CASE WHEN date <= DATE '2000-12-31' THEN volume END AS volume FROM sprices"""))
    add("append_prices", build("SELECT asset, date, adj_close, CASE WHEN date <= DATE '2000-12-31' THEN volume END AS volume FROM sprices"))
    add("high_watermark", build("SELECT asset, max(date) AS max_date FROM sprices GROUP BY 1 UNION ALL SELECT asset, NULL FROM ghosts"))
    early = """SELECT asset, date, CASE WHEN date >= DATE '2000-07-01' THEN adj_close * 2 ELSE adj_close END AS adj_close,
      CASE WHEN date <= DATE '2000-12-31' THEN volume END AS volume FROM sprices"""
    late = """SELECT asset, date, CASE WHEN asset LIKE '%7' AND date >= DATE '2000-12-01' THEN p.adj_close * 0.7 ELSE e.adj_close END AS adj_close,
      CASE WHEN asset LIKE '%7' AND date >= DATE '2000-12-01' THEN p.volume ELSE e.volume END AS volume FROM early e JOIN sprices p USING (asset, date)"""
    kept = {"early": early, "late": late}
    add("store_snapshot", build("SELECT 'early' AS version, asset, date, adj_close, volume FROM early UNION ALL SELECT 'late', asset, date, adj_close, volume FROM late", kept))
    add("store_marks", build("SELECT asset, max_date, date, adj_close FROM late JOIN (SELECT asset, max(date) AS max_date FROM late GROUP BY 1) USING (asset) WHERE date >= max_date - 10", kept))
    add("incremental_prices", build("""SELECT asset, date, adj_close FROM sprices LEFT JOIN (SELECT asset, max(date) AS m FROM sstored GROUP BY 1) USING (asset) WHERE m IS NULL OR date >= m - 10"""))
    add("incremental_macro", build("""SELECT series_id, obs_date, round(value, 4) AS value FROM macro LEFT JOIN (
      SELECT series_id, max(obs_date) AS m FROM macro WHERE obs_date <= DATE '1998-06-30' AND series_id <> '5-LOW' GROUP BY 1) USING (series_id) WHERE m IS NULL OR obs_date > m"""))
    mismatch = """SELECT s.asset, s.date, s.adj_close AS stored, f.adj_close AS fetched FROM sstored s JOIN refetched f USING (asset, date)
      JOIN (SELECT asset, max(date) AS m FROM sstored GROUP BY 1) t USING (asset) WHERE s.date >= m - 10 AND s.date < m AND abs(s.adj_close - f.adj_close) > 1e-4 * greatest(abs(s.adj_close), abs(f.adj_close))"""
    merged = {"mismatch": mismatch, "plan": """SELECT asset, m, m IS NULL OR asset IN (SELECT asset FROM mismatch) AS whole
      FROM (SELECT DISTINCT asset FROM refetched) LEFT JOIN (SELECT asset, max(date) AS m FROM sstored GROUP BY 1) USING (asset)""",
      "taken": "SELECT r.*, m, whole FROM refetched r JOIN plan USING (asset) WHERE whole OR r.date >= m - 10"}
    add("overlap_mismatches", build("SELECT asset, date, stored, fetched FROM mismatch", merged))
    add("revision_merge", build("""SELECT coalesce(t.asset, s.asset) AS asset, coalesce(t.date, s.date) AS date, coalesce(t.adj_close, s.adj_close) AS adj_close, coalesce(t.volume, s.volume) AS volume
      FROM sstored s FULL JOIN taken t ON s.asset = t.asset AND s.date = t.date""", merged))
    add("revision_counts", build("""SELECT asset, count(*) FILTER (whole OR date > m) AS new_rows, bool_or(whole) AS full_refresh FROM taken GROUP BY 1 UNION ALL SELECT asset, 0, false FROM ghosts""", merged))
    add("append_macro", build("""SELECT series_id, obs_date, round(CASE WHEN obs_date <= DATE '1998-06-30' THEN value ELSE CASE WHEN obs_date > m OR m IS NULL THEN value + 1 END END, 4) AS value, available_date
      FROM available LEFT JOIN (SELECT series_id, max(obs_date) AS m FROM macro WHERE obs_date <= DATE '1998-06-30' GROUP BY 1) USING (series_id)"""))
    add("release_lag", build("SELECT series_id, obs_date, available_date FROM available"))
    add("coverage_report", build("SELECT asset, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date, false AS empty FROM sprices GROUP BY 1 UNION ALL SELECT asset, 0, NULL, NULL, true FROM ghosts"))
    checks = [
        ("macro", "not_null", "value", "SELECT count(*) FROM macro WHERE value IS NULL"),
        ("macro", "unique", "series_id,obs_date", "SELECT count(*) FROM (SELECT 1 FROM macro GROUP BY series_id, obs_date HAVING count(*) > 1)"),
        ("runs", "not_null", "run_id", "SELECT count(*) FROM runs WHERE run_id IS NULL"),
        ("runs", "domain", "status", "SELECT count(*) FROM runs WHERE status NOT IN ('ok', 'error')"),
        ("runs", "reference", "config_id", "SELECT count(*) FROM runs WHERE config_id NOT IN (SELECT config_id FROM configs)"),
        ("configs", "at_most_one", "is_central", "SELECT greatest(count(*) - 1, 0) FROM configs WHERE is_central"),
        ("configs", "domain", "forecaster", "SELECT count(*) FROM configs WHERE forecaster NOT IN ('ewma', 'ridge')"),
        ("target_weights", "reference", "run_id", "SELECT count(*) FROM weights WHERE run_id NOT IN (SELECT run_id FROM runs)"),
        ("run_stages", "not_null", "detail_json", "SELECT count(*) FROM stages WHERE detail_json IS NULL"),
        ("lines", "unique", "l_orderkey,l_linenumber", "SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)"),
    ]
    add("constraint_audit", build(" UNION ALL ".join(f"SELECT '{t}' AS table_name, '{r}' AS rule, '{c}' AS target, ({q}) AS n_violations" for t, r, c, q in checks)))
    add("log_returns", build("SELECT asset, date, round(log_return, 8) AS log_return FROM sprices_r"))
    add("realized_vol", build("SELECT asset, date, round(realized_vol, 8) AS realized_vol FROM sfeatures"))
    add("latest_features", build("""SELECT CAST(1 AS BIGINT) AS run_id, asset, name, round(value, 8) AS value FROM (
      SELECT asset, max_by(log_return, date) AS log_return, max_by(realized_vol, date) AS realized_vol FROM sfeatures GROUP BY 1) UNPIVOT (value FOR name IN (log_return, realized_vol))"""))
    add("bar_positions", build("SELECT asset, date, row_number() OVER (PARTITION BY asset ORDER BY date) - 1 AS pos, count(*) OVER (PARTITION BY asset) AS n_bars FROM sprices"))
    add("forward_return", build("""SELECT asset, date, round(CASE WHEN count(*) OVER w = 21 THEN sum(log_return) OVER w END, 8) AS realized_h FROM sprices_r
      WINDOW w AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 21 FOLLOWING)"""))
    add("ewma_forecasts", build("SELECT asset, date, round(mu, 8) AS mu, round(sigma, 8) AS sigma, pos + 1 AS n_bars FROM sf WHERE pos >= 51"))
    add("bar_forecasts", build("SELECT asset, date, round(mu, 8) AS mu, round(sigma, 8) AS sigma, pos + 1 AS n_bars FROM bars_f WHERE pos >= 51"))
    add("idzorek_confidence", build(f"SELECT asset, date, round({confidence('mu', 'sigma')}, 8) AS confidence, round(mu * 252 / 21, 8) AS annual_mu, round(sigma * sqrt(252), 8) AS scaled_sigma FROM slatest"))
    add("forecast_contract", build("""SELECT asset, 'sigma not positive and finite' AS reason FROM slatest WHERE asset LIKE '%3' UNION ALL
      SELECT asset, 'no forecast' FROM (SELECT DISTINCT asset FROM sprices) WHERE asset LIKE '%9' UNION ALL SELECT asset, 'no forecast' FROM ghosts UNION ALL
      SELECT asset, 'not in universe' FROM (SELECT DISTINCT asset FROM sprices) WHERE asset LIKE '%1'"""))
    add("common_date_panel", build("SELECT asset, date, round(log_return, 8) AS log_return FROM joint"))
    add("common_dates", build("SELECT date FROM jdates"))
    add("covariance_window", build("""SELECT min(date) AS start, max(date) AS "end", count(*) AS bars, (SELECT max(f) FROM (SELECT min(date) AS f FROM prices_r GROUP BY asset)) AS overlap_start FROM jdates"""))
    add("macro_asof_join", build(f"SELECT series_id, date, round(value, 4) AS value FROM ({asof_sql('prices')})"))
    add("macro_wide", build(pivot_series(asof_sql("sprices"))))
    cells = ", ".join(f"round({a}_{f}, 8) AS {a}_{f}" for a in ASSETS for f in ("log_return", "realized_vol"))
    columns = ", ".join(f'"{s}"' for s in SERIES)
    wide_macro = {"wmacro": pivot_series(asof_sql("matrix"))}
    add("feature_matrix_wide", build(f"SELECT date, {cells}, {columns} FROM matrix JOIN wmacro USING (date)", wide_macro))
    add("split_feature_matrix", build(f"SELECT asset, date, round(log_return, 8) AS log_return, round(realized_vol, 8) AS realized_vol, {columns} FROM jfeatures JOIN wmacro USING (date)", wide_macro))
    add("fracdiff_first", build("SELECT asset, date, round(d, 8) AS fracdiff FROM (SELECT asset, date, x - lag(x) OVER (PARTITION BY asset ORDER BY date) AS d FROM slogs) WHERE d IS NOT NULL"))
    short = {"ffd": weights_cte(0.4, 1e-2), "fd": fracdiff_sql("slogs")}
    add("fracdiff_short", build("SELECT asset, date, round(fracdiff, 8) AS fracdiff FROM fd", short, True))
    add("memory_retained", build("SELECT fd.asset, round(corr(fracdiff, x), 8) AS memory, count(*) AS n_rows FROM fd JOIN slogs USING (asset, date) GROUP BY 1", short, True))
    add("fracdiff_wide", build("SELECT asset, date, round(fracdiff, 8) AS fracdiff FROM fd", {"ffd": weights_cte(0.5, 1e-4), "fd": fracdiff_sql("plogs")}, True))
    add("pair_moments", build("SELECT asset_i, asset_j, n, round(xy, 7) AS xy, round(x2y2, 7) AS x2y2 FROM pairs WHERE asset_i <= asset_j"))
    add("tiled_pair_moments", build("""SELECT a.asset AS asset_i, b.asset AS asset_j, count(*) AS n, round(sum(a.log_return * b.log_return), 6) AS xy, round(sum(a.log_return * a.log_return * b.log_return * b.log_return), 6) AS x2y2
      FROM joint a JOIN joint b ON a.date = b.date AND a.asset <= b.asset GROUP BY 1, 2"""))
    add("empirical_cov", build("SELECT asset_i, asset_j, round(xy / n, 9) AS cov FROM pairs"))
    add("ledoit_wolf_cov", build("SELECT asset_i, asset_j, round(cov, 8) AS cov FROM cov"))
    add("shrinkage_stats", build("SELECT p, n, round(mu, 9) AS mu, round(shrinkage, 8) AS shrinkage FROM lwstats"))
    add("equilibrium_prior", build("SELECT asset, round(prior_mu, 8) AS prior_mu FROM prior"))
    add("view_terms", build("SELECT asset, round(view_mu, 8) AS view_mu, round(view_confidence, 8) AS view_confidence, round(omega, 8) AS omega FROM terms"))
    one = posterior_ctes("groups1", "terms")
    add("bl_posterior", build(REPORT.format(key="CAST(m6.g AS BIGINT)", name="group_id", d=7, terms="terms"), one))
    add("bl_posterior_cov", build("SELECT asset_i, asset_j, round((a.cov + b.cov) / 2, 8) AS cov FROM post a JOIN (SELECT asset_j AS asset_i, asset_i AS asset_j, cov FROM post) b USING (asset_i, asset_j)", one))
    add("recipe_posteriors", build(REPORT.format(key="CAST(m6.g AS BIGINT)", name="config_id", d=6, terms="recipe_terms"), posterior_ctes("recipe_groups", "recipe_terms")))
    customers = {
        "recipes": """SELECT CAST(c_custkey AS BIGINT) AS g, 21.0 + (c_custkey % 200) * 0.75 AS h, CAST(c_nationkey % 7 + 1 AS BIGINT) AS scenario_id,
          CASE WHEN c_custkey % 5 = 0 THEN 'fracdiff_macro' ELSE 'basic' END AS feature_set FROM customer WHERE c_custkey % 11 <> 0""",
        "slots": "SELECT DISTINCT CAST(h AS DOUBLE) AS h FROM recipes WHERE scenario_id = 1",
        "slot_mu": """SELECT h, asset, date, pos, n, log_return, 21 * sum(log_return * pow(2.0, pos / h)) OVER w / sum(pow(2.0, pos / h)) OVER w AS mu FROM prices_r, slots
          WINDOW w AS (PARTITION BY h, asset ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
        "slot_error": """SELECT h, asset, date, pos, n, mu, lag(mu, 21) OVER w - sum(log_return) OVER (PARTITION BY h, asset ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) AS e
          FROM slot_mu WINDOW w AS (PARTITION BY h, asset ORDER BY date)""",
        "slot_last": """SELECT h, asset, max_by(date, pos) AS as_of, max_by(mu, pos) AS mu, stddev_samp(CASE WHEN pos >= 42 THEN e END) AS sigma FROM slot_error GROUP BY 1, 2""",
        "customer_views": """SELECT g, asset, mu, sigma FROM recipes r JOIN slot_last s ON s.h = r.h WHERE scenario_id = 1 UNION ALL
          SELECT g, asset, mu, sigma FROM recipes JOIN past_views USING (scenario_id) UNION ALL
          SELECT g, asset, mu, sigma FROM recipes JOIN written_views USING (scenario_id)""",
        "customer_terms": terms_of("customer_views", "g,"),
        "customer_groups": "SELECT g FROM recipes",
    }
    add("customer_posteriors", build(REPORT.format(key="m6.g", name="config_id", d=6, terms="customer_terms"), {**customers, **posterior_ctes("customer_groups", "customer_terms")}))
    add("customer_forecasts", build("""SELECT g AS config_id, asset, as_of, 21 AS horizon_days, 'ewma:' || CAST(CAST(r.h AS DOUBLE) AS VARCHAR) AS model_version, round(mu, 8) AS mu, round(sigma, 8) AS sigma
      FROM recipes r JOIN slot_last s ON s.h = r.h WHERE scenario_id = 1""", customers))
    add("customer_rejects", "SELECT CAST(c_custkey AS BIGINT) AS config_id, 'unknown forecaster unheard' AS problem FROM customer WHERE c_custkey % 11 = 0")
    plain = """SELECT asset, name, value FROM (SELECT asset, max_by(log_return, date) AS log_return, max_by(realized_vol, date) AS realized_vol FROM {0} GROUP BY 1)
      UNPIVOT (value FOR name IN (log_return, realized_vol))"""
    sets = {
        "basic_values": plain.format("pfeatures"),
        "macro_values": plain.format("jfeatures") + """ UNION ALL SELECT asset, series_id, value FROM (SELECT asset, max(date) AS date FROM jfeatures GROUP BY 1) JOIN macro_at USING (date)""",
    }
    add("customer_features", build("""SELECT g AS config_id, asset, name, round(value, 4) AS value FROM recipes JOIN basic_values ON feature_set = 'basic' UNION ALL
      SELECT g, asset, name, round(value, 4) FROM recipes JOIN macro_values ON feature_set <> 'basic'""", {**customers, **sets, "macro_at": asof_sql("jfeatures")}))
    add("historical_views", build(f"SELECT CAST(scenario_id AS BIGINT) AS scenario_id, asset, round(mu, 8) AS mu, round(sigma, 8) AS sigma FROM ({historical_of('sprices_r')})"))
    add("order_views", build("""SELECT CAST(o_orderkey AS BIGINT) AS scenario_id, asset, round(avg(log_return) * 21, 8) AS mu, round(greatest(stddev_samp(log_return) * sqrt(21), 1e-8), 8) AS sigma
      FROM bprices_r JOIN orders ON date BETWEEN CAST(o_orderdate AS DATE) - CAST(o_orderkey % 700 AS INTEGER) AND CAST(o_orderdate AS DATE) GROUP BY 1, 2 HAVING count(*) >= 2"""))
    scores = ", ".join(f"({k}, {z_of(c)!r})" for k, c in enumerate(SUPPLIER_CONFIDENCES))
    assets = ", ".join(f"({k}, '{a}')" for k, a in enumerate(ASSETS))
    add(
        "supplier_views",
        f"""SELECT CAST(s_suppkey AS BIGINT) AS scenario_id, asset, round(s_acctbal / 100000 * 21 / 252, 10) AS mu,
          round(greatest(abs(s_acctbal / 100000 * 21 / 252) / z, 1e-8), 8) AS sigma
        FROM supplier JOIN (VALUES {scores}) c(k, z) ON s_suppkey % {len(SUPPLIER_CONFIDENCES)} = k JOIN (VALUES {assets}) a(i, asset) ON s_suppkey % {len(ASSETS)} = i""",
    )
    add("counterfactual_views", build("SELECT CAST(scenario_id AS BIGINT) AS scenario_id, asset, round(mu, 10) AS mu, round(sigma, 8) AS sigma FROM written_views WHERE asset IN (SELECT asset FROM prices)"))
    add("box_feasibility", build("""SELECT run_id, reason FROM (SELECT run_id, CASE WHEN w_max <= 0 OR w_max > 1 THEN 'w_max must be in (0, 1]' WHEN w_max * n_assets < 1 THEN 'w_max too small for the budget'
      WHEN min_weight < 0 THEN 'min_weight must be >= 0' WHEN min_weight > w_max THEN 'min_weight exceeds w_max' WHEN min_weight * n_assets > 1 THEN 'min_weight too large for the budget' END AS reason
      FROM (SELECT run_id, count(*) AS n_assets, max(weight) - 0.125 AS w_max, min(weight) + 0.0625 AS min_weight FROM weights GROUP BY 1)) WHERE reason IS NOT NULL"""))
    add("previous_weights", build("""SELECT g.run_id, u.asset, round(coalesce(w.weight, 0), 8) AS prev_weight, CASE WHEN x.run_id IS NOT NULL THEN 'asset outside the universe' END AS reason
      FROM (SELECT DISTINCT run_id FROM weights) g CROSS JOIN (VALUES ('AF'), ('AO'), ('NF'), ('NO'), ('RF')) u(asset)
      LEFT JOIN weights w ON w.run_id = g.run_id AND w.asset = u.asset LEFT JOIN (SELECT DISTINCT run_id FROM weights WHERE asset = 'RO') x ON x.run_id = g.run_id"""))
    add("clipped_weights", build("SELECT run_id, asset, round(k / sum(k) OVER (PARTITION BY run_id), 8) AS weight FROM (SELECT run_id, asset, CASE WHEN weight < 0.1 THEN 0 ELSE weight END AS k FROM weights)"))
    add("turnover", build("""SELECT config_id, asset, round(weight, 8) AS weight, round(prev, 8) AS prev_weight, round(coalesce(abs(weight - prev), 0), 8) AS turnover FROM (
      SELECT l.config_id, w.asset, w.weight, CASE WHEN o.run_id IS NOT NULL AND EXISTS (SELECT 1 FROM weights e WHERE e.run_id = o.run_id) THEN coalesce(v.weight, 0) END AS prev
      FROM lastok l JOIN weights w USING (run_id) LEFT JOIN (SELECT r.config_id, max(r.run_id) AS run_id FROM runs r JOIN lastok k ON k.config_id = r.config_id AND r.run_id < k.run_id WHERE r.status = 'ok' GROUP BY 1) o ON o.config_id = l.config_id
      LEFT JOIN weights v ON v.run_id = o.run_id AND v.asset = w.asset)"""))
    add("panel_positions", build("SELECT date, pos, n_panel FROM positions"))
    add("walk_forward_folds", build("SELECT fold, train_start, train_end, test_start, test_end FROM folds"))
    add("leakage_audit", build("SELECT fold, 'train horizon reaches test' AS reason FROM folds"))
    add("fold_roles", build("SELECT date, pos, fold, role FROM roles"))
    add("eval_points", build("SELECT date, pos, fold FROM points"))
    add("fold_report", build("""SELECT fold, train_bars, test_bars, coalesce(k, 0) AS n_eval_points, a AS first_eval_date, b AS last_eval_date FROM (
      SELECT fold, count(*) FILTER (role = 'train') AS train_bars, count(*) FILTER (role = 'test') AS test_bars FROM roles GROUP BY 1)
      LEFT JOIN (SELECT fold, count(*) AS k, min(date) AS a, max(date) AS b FROM points GROUP BY 1) USING (fold)"""))
    add("evaluation_points", build("SELECT model, asset, date, fold, round(mu, 8) AS mu, round(sigma, 8) AS sigma, round(realized_h, 8) AS realized_h FROM scored"))
    add("forecast_metrics", build("SELECT model, asset, n_points, round(mse, 8) AS mse, round(ic, 8) AS ic, round(coverage, 8) AS coverage FROM metrics"))
    add("promotion_decision", build("""SELECT c.model, CASE WHEN c.mse < b.mse AND abs(c.coverage - 0.9) <= 0.05 AND abs(c.coverage - 0.9) <= abs(b.coverage - 0.9) THEN 'challenger promoted' ELSE 'baseline remains' END AS decision,
      concat_ws('; ', CASE WHEN NOT c.mse < b.mse THEN 'mse not strictly lower' END, CASE WHEN NOT abs(c.coverage - 0.9) <= 0.05 THEN 'coverage outside band' END,
        CASE WHEN NOT abs(c.coverage - 0.9) <= abs(b.coverage - 0.9) THEN 'coverage distance worse' END) AS failed
      FROM metrics c JOIN metrics b ON b.model = 'ewma63' AND b.asset IS NULL WHERE c.model <> 'ewma63' AND c.asset IS NULL"""))
    add("data_fingerprint", build("""SELECT asset, count(*) AS n_rows, max(date) AS max_date, (SELECT count(*) FROM jdates) AS panel_bars, (SELECT min(date) FROM jdates) AS panel_start,
      (SELECT max(date) FROM jdates) AS panel_end, left(sha256('{"horizon":21,"n_splits":4,"stride":21}'), 12) AS recipe_hash FROM prices GROUP BY 1"""))
    add("context_windows", build("""SELECT asset, date, pos, CAST(16 AS BIGINT) AS n, round(first_c, 8) AS context_first, round(last_c, 8) AS context_last, round(first_t, 8) AS target_first, round(last_t, 8) AS target_last,
      round(realized_h, 8) AS realized_h FROM windows"""))
    add("purged_holdout", build("SELECT asset, date, pos, role FROM held"))
    add("standardized_windows", build("""SELECT asset, date, role, round((last_c - m) / s, 7) AS context_last, round((last_t - m) / s, 7) AS target_last
      FROM held, (SELECT sum(ctx) / (16 * count(*)) AS m, sqrt(sum(tgt) / (16 * count(*)) - pow(sum(ctx) / (16 * count(*)), 2)) AS s FROM held WHERE role = 'train')"""))
    add("residual_variance", build("SELECT asset, n_holdout, round(residual_var, 8) AS residual_var FROM residuals"))
    add("ensemble_forecast", build("""SELECT asset, date, round(mu, 8) AS mu, round(sqrt(greatest(residual_var + b, 1e-16)), 8) AS sigma FROM (
      SELECT asset, date, avg(prediction) AS mu, coalesce(var_samp(prediction), 0) AS b FROM predictions GROUP BY 1, 2) JOIN residuals USING (asset)"""))
    add("embedding_collapse", build("SELECT label, n_rows, dim, round(std_median, 6) AS std_median, round(effective_rank, 5) AS effective_rank FROM collapse WHERE n_rows >= 2"))
    add("collapse_verdict", build("""SELECT round(s, 6) AS std_median, round(r, 5) AS effective_rank, s >= 0.1 AND r >= 1.5 AS passed FROM (SELECT min(std_median) AS s, min(effective_rank) AS r FROM collapse WHERE n_rows >= 2)"""))
    add("regularity_scores", build("""SELECT label, round(avg(greatest(0.0, 1.0 - sqrt(c0 + 1e-4))) FILTER (i = j), 6) AS variance_term,
      round(sum(CASE WHEN i <> j THEN c * c ELSE 0 END) / 64, 6) AS covariance_term FROM ecov GROUP BY 1"""))
    add("run_history", build("""SELECT r.run_id, config_id, status, trig, started_at, string_agg(asset, ',' ORDER BY asset) AS assets, round(sum(weight), 8) AS total
      FROM (SELECT * FROM runs ORDER BY run_id DESC LIMIT 50) r LEFT JOIN weights w USING (run_id) GROUP BY ALL"""))
    add("latest_ok_run", build("SELECT c.config_id, run_id FROM configs c LEFT JOIN lastok USING (config_id)"))
    add("data_watermarks", build("SELECT data_max_date, data_fetched_at FROM marks"))
    add("freshness_gate", build("SELECT config_id, run_id, decision FROM gate"))
    add("cached_runs", build("""SELECT config_id, CASE WHEN decision = 'skip' AND NOT coalesce(updated_at > started_at, false) THEN g.run_id END AS cached_run_id
      FROM gate g LEFT JOIN (SELECT run_id, started_at FROM runs) s USING (run_id) JOIN configs USING (config_id)"""))
    add("last_weights", build("SELECT config_id, run_id, asset, round(weight, 8) AS weight FROM lastok JOIN weights USING (run_id)"))
    add("compare_configs", build("SELECT config_id, name, is_central, run_id, objective, asset, weight FROM compared"))
    add("compare_grid", build("""SELECT asset, max(weight) FILTER (config_id = 7) AS "7", max(weight) FILTER (config_id = 8) AS "8", max(weight) FILTER (config_id = 10) AS "10" FROM compared WHERE asset IS NOT NULL GROUP BY 1"""))
    add("central_run", build("SELECT run_id, stage, status FROM stages WHERE run_id = (SELECT max(run_id) FROM runs WHERE status = 'ok' AND config_id IN (SELECT config_id FROM configs WHERE is_central))"))
    add("swept_runs", build("""SELECT run_id, CASE WHEN status = 'skipped' THEN 'error' ELSE status END AS status, CASE WHEN status = 'skipped' THEN 'interrupted: the process stopped before this run finished' END AS error_text,
      CASE WHEN status = 'skipped' THEN TIMESTAMP '2002-01-01 00:00:00' END AS finished_at FROM runs"""))
    add("promoted_config", build("SELECT config_id, config_id = 12 AS is_central FROM configs"))
    stage_list = "['freshness', 'ingest', 'features', 'forecast', 'blend', 'optimize']"
    add("stage_completeness", build(f"""SELECT run_id, missing_stages, failed_stages, covers_universe, sums_to_one, missing_stages = '' AND failed_stages = '' AND covers_universe AND sums_to_one AS complete FROM (
      SELECT r.run_id, coalesce(array_to_string(list_sort(list_filter({stage_list}, lambda s: NOT list_contains(coalesce(have, []), s))), ','), '') AS missing_stages,
        coalesce(array_to_string(list_sort(coalesce(bad, [])), ','), '') AS failed_stages, coalesce(k = 6, false) AS covers_universe, coalesce(abs(t - 1) <= 1e-9, false) AS sums_to_one
      FROM runs r LEFT JOIN (SELECT run_id, list(DISTINCT stage) AS have, list(DISTINCT stage) FILTER (status <> 'ok') AS bad FROM stages WHERE stage <> 'notify' GROUP BY 1) USING (run_id)
        LEFT JOIN (SELECT run_id, count(*) AS k, sum(weight) AS t FROM weights GROUP BY 1) USING (run_id) WHERE r.status = 'ok')"""))
    add("stage_durations", build("SELECT run_id, stage, epoch(CAST(finished_at AS TIMESTAMP)) - epoch(CAST(started_at AS TIMESTAMP)) AS seconds FROM stages WHERE finished_at <> 'unknown' UNION ALL SELECT run_id, stage, NULL FROM stages WHERE finished_at = 'unknown'"))
    add("model_versions", """SELECT evaluation_id, string_agg(v, ', ' ORDER BY f, v) AS versions FROM (
      SELECT l_orderkey AS evaluation_id, concat(l_returnflag, l_linestatus) AS v, min(l_linenumber) AS f FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
    add("run_counts", build("""SELECT trig, count(*) AS n_runs, count(*) FILTER (status = 'ok') AS n_ok, count(*) FILTER (status = 'error') AS n_error, count(*) FILTER (status = 'skipped') AS n_skipped,
      count(*) FILTER (status IN ('running', 'queued')) AS n_stuck FROM runs GROUP BY 1"""))
    add("poke_percentiles", """SELECT event_type, max(value) FILTER (rn = least(n - 1, CAST(floor(0.5 * n) AS BIGINT)) + 1) AS p50, max(value) FILTER (rn = least(n - 1, CAST(floor(0.95 * n) AS BIGINT)) + 1) AS p95, max(n) AS n
      FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY 1""")
    add("reference_checks", build("""SELECT 'scenario' AS entity, CAST(scenario_id AS BIGINT) AS id, scenario_id IN (SELECT scenario_id FROM configs) AS in_use FROM scenarios UNION ALL
      SELECT 'config', config_id, config_id IN (SELECT config_id FROM runs) FROM configs"""))
    add("recipe_problems", build("""SELECT config_id, 'unknown forecaster unheard' AS problem FROM configs WHERE forecaster = 'unheard' UNION ALL
      SELECT config_id, 'unknown scenario' FROM configs WHERE scenario_id NOT IN (SELECT scenario_id FROM scenarios)"""))
    add("json_details", build("""SELECT run_id, stage, CASE WHEN json_valid(detail_json) THEN json_extract_string(detail_json, '$.data_max_date') END AS data_max_date,
      coalesce(NOT json_valid(detail_json), false) AS parse_error FROM stages"""))
    add("recent_runs", build("SELECT run_id, CAST(started_at AS DATE) AS day FROM runs WHERE CAST(started_at AS DATE) >= (SELECT max(CAST(started_at AS DATE)) FROM runs) - 365"))
    add("unknown_assets", build("SELECT DISTINCT asset FROM weights WHERE asset NOT IN (SELECT asset FROM prices WHERE asset NOT LIKE 'R%')"))
    add("hourly_bars", build("SELECT asset, bar_start, open, high, low, close, n_ticks FROM bars"))
    add("canonical_order", build("""SELECT asset, max(date) AS date, max_by(adj_close, date) AS adj_close, CAST(list_position(['RO', 'RF', 'NO', 'NF', 'AO', 'AF'], asset) AS BIGINT) AS ordinal FROM prices GROUP BY 1 ORDER BY ordinal"""))
    add("incremental_forecast", build("SELECT asset, date AS last_date, n, round(mu, 8) AS mu FROM slatest"))
    add("moved_keys", build("SELECT asset FROM sprices GROUP BY 1 HAVING max(date) > DATE '2001-10-31'"))
    return sql
