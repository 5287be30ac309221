"""DuckDB SQL of the core tables, as common table expressions over the synthetic tables."""

from __future__ import annotations

from loomflow.config import SCORES, Config

ARROW = "' -> '"


def event_ctes(cfg: Config) -> dict[str, str]:
    """From `events` as a log to metrics, portfolios, outcomes and oracles."""
    t, cap, start, decision = repr(cfg.tail), repr(float(cfg.cap)), f"TIMESTAMP '{cfg.start}'", f"TIMESTAMP '{cfg.decision}'"
    end = f"TIMESTAMP '{cfg.holdout_end}'"
    y = f"least(delay, {cap})"
    if cfg.grid:
        y = f"least(greatest(round_even({y} / {cfg.grid!r}, 0) * {cfg.grid!r}, 0.0), {cap})"
    required = -(-cfg.coverage * cfg.blocks // 1)
    loo = cfg.reference == "leave_one_block_out"
    ref = "(cw - cb) / greatest(n - n_b, 1)" if loo else "cw / n"
    rest = " WHERE n - n_b > 0" if loo else ""
    methods = " UNION ALL ".join(f"SELECT transition, '{m}' AS method, {SCORES[m]} AS score FROM met" for m in cfg.methods)
    sizes = ", ".join(f"({k})" for k in cfg.sizes)
    order = ", ".join(f"('{m}', {k})" for k, m in enumerate(cfg.methods))
    return {
        "log": "SELECT user_id AS case_id, ts, event_id AS ord, event_type AS activity FROM events",
        "paired": "SELECT case_id, ts AS origin, lead(ts) OVER w AS destination, activity AS origin_activity, lead(activity) OVER w AS next_activity FROM log WINDOW w AS (PARTITION BY case_id ORDER BY ts, ord)",
        "obs": f"SELECT case_id, origin, destination, origin_activity, origin_activity || {ARROW} || next_activity AS transition, (epoch_us(destination) - epoch_us(origin)) / 3.6e9 AS delay FROM paired",
        "hist": f"SELECT * FROM obs WHERE origin >= {start} AND origin < {decision} AND destination IS NOT NULL AND destination < {decision}",
        "held": f"SELECT * FROM obs WHERE origin >= {decision} AND origin < {end} AND destination IS NOT NULL",
        "h": f"SELECT transition, CAST(floor((epoch_us(origin) - epoch_us({start})) / {cfg.block_days * 86400e6!r}) AS INTEGER) AS block, {y} AS y, count(*) AS c FROM hist GROUP BY ALL",
        "pool": "SELECT transition, y, CAST(sum(c) AS BIGINT) AS w FROM h GROUP BY ALL",
        "tot": "SELECT transition, CAST(sum(w) AS BIGINT) AS n, sum(y * w) / sum(w) AS mean FROM pool GROUP BY 1",
        "cum": "SELECT transition, y, w, sum(w) OVER (PARTITION BY transition ORDER BY y DESC) AS cw FROM pool",
        "cv": f"SELECT transition, n, mean, sum(y * greatest(0.0, least(w, n * {t} - (cw - w)))) / (n * {t}) AS cvar FROM cum JOIN tot USING (transition) GROUP BY transition, n, mean",
        "perblock": "SELECT transition, block, CAST(sum(c) AS BIGINT) AS n_b FROM h GROUP BY ALL",
        "valid": f"SELECT transition, block, n_b FROM perblock WHERE n_b >= {cfg.min_block}",
        "nvalid": f"SELECT transition, count_if(n_b >= {cfg.min_block}) AS valid_blocks FROM perblock GROUP BY 1",
        "cdf": "SELECT transition, y, sum(w) OVER o AS cw, lead(y) OVER o - y AS dx FROM pool WINDOW o AS (PARTITION BY transition ORDER BY y)",
        "dense": "SELECT d.transition, v.block, d.y, cw, dx, n_b, sum(coalesce(c, 0)) OVER (PARTITION BY d.transition, v.block ORDER BY d.y) AS cb FROM cdf d JOIN valid v ON d.transition = v.transition LEFT JOIN h ON h.transition = d.transition AND h.block = v.block AND h.y = d.y",
        "dist": f"SELECT transition, block, sum(abs(cb / n_b - {ref}) * dx) AS d FROM dense JOIN tot USING (transition){rest} GROUP BY ALL",
        "radius": f"SELECT transition, quantile_cont(d, {cfg.radius_q!r}) * {cfg.multiplier!r} AS epsilon FROM dist GROUP BY 1",
        "mcap": f"SELECT transition, sum(CASE WHEN y >= {cap} THEN w ELSE 0 END) / sum(w) AS m_cap FROM pool GROUP BY 1",
        "cal": f"SELECT transition, n, mean, cvar, valid_blocks, CAST({required} AS BIGINT) AS required, epsilon, m_cap, n / (SELECT sum(n) FROM tot) AS frequency, greatest(0.0, {t} * ({cap} - cvar)) AS epsilon_sat FROM cv JOIN nvalid USING (transition) JOIN mcap USING (transition) LEFT JOIN radius USING (transition)",
        "sc": f"SELECT *, n >= {cfg.min_obs} AND valid_blocks >= required AS strict_eligibility, epsilon_sat <= 1e-8 AS empirically_saturated, CASE WHEN epsilon_sat > 1e-8 THEN epsilon / epsilon_sat END AS rho, least({cap}, cvar + greatest(0.0, epsilon) / {t}) AS risk, CASE WHEN epsilon_sat <= 1e-8 THEN 0.0 ELSE least(epsilon, {cfg.kappa!r} * epsilon_sat) END AS sa_epsilon FROM cal",
        "sc2": f"SELECT *, least({cap}, cvar + greatest(0.0, sa_epsilon) / {t}) AS sa_risk FROM sc",
        "met": f"SELECT *, risk >= {cap} - 1e-7 AS saturated, sa_risk >= {cap} - 1e-7 AS sa_saturated, frequency * mean AS mean_score, frequency * cvar AS tail_score, frequency * risk AS dro_score, frequency * sa_risk AS sa_score FROM sc2 WHERE strict_eligibility",
        "scores": methods,
        "sizes": f"SELECT * FROM (VALUES {sizes}) AS s(K)",
        "morder": f"SELECT * FROM (VALUES {order}) AS s(method, k)",
        "ranked": "SELECT method, transition, score, row_number() OVER (PARTITION BY method ORDER BY round(score, 10) DESC, transition) AS rank FROM scores",
        "port": "SELECT method, K, rank, transition FROM ranked JOIN sizes ON rank <= K",
        "opool": f"SELECT transition, least(delay, {cap}) AS y, count(*) AS w FROM held GROUP BY ALL",
        "otot": "SELECT transition, CAST(sum(w) AS BIGINT) AS n, sum(y * w) / sum(w) AS mean FROM opool GROUP BY 1",
        "ocum": "SELECT transition, y, w, sum(w) OVER (PARTITION BY transition ORDER BY y DESC) AS cw FROM opool",
        "ocv": f"SELECT transition, n, mean, sum(y * greatest(0.0, least(w, n * {t} - (cw - w)))) / (n * {t}) AS cvar FROM ocum JOIN otot USING (transition) GROUP BY transition, n, mean",
        "outc": "SELECT *, n * mean AS mean_burden, n * cvar AS tail_burden FROM ocv",
        "olong": "SELECT transition, 'mean' AS target, mean_burden AS burden FROM outc UNION ALL SELECT transition, 'tail', tail_burden FROM outc",
        "orac_g": "SELECT target, K, rank, transition, burden FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY burden DESC, transition) AS rank FROM olong) JOIN sizes ON rank <= K",
        "orac_e": "SELECT target, K, rank, transition, burden FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY burden DESC, transition) AS rank FROM olong WHERE transition IN (SELECT transition FROM met)) JOIN sizes ON rank <= K",
        "sets": "SELECT method, K, list_sort(list(transition)) AS members FROM port GROUP BY ALL",
    }


def build(ctes: dict[str, str], final: str) -> str:
    """The final query with the tables that it needs, directly or not."""
    import re

    need: set[str] = set()
    todo = [final]
    while todo:
        text = todo.pop()
        for name, body in ctes.items():
            if name not in need and re.search(rf"\b{name}\b", text):
                need.add(name)
                todo.append(body)
    parts = ", ".join(f"{n} AS ({ctes[n]})" for n in ctes if n in need)
    return counted(f"WITH {parts} {final}" if parts else final)


def counted(sql: str) -> str:
    """count_if(x) as a count, which is a BIGINT as in Spark."""
    while (at := sql.find("count_if(")) >= 0:
        depth, end = 1, at + len("count_if(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}count(CASE WHEN {sql[at + len('count_if(') : end - 1]} THEN 1 END){sql[end:]}"
    return sql
