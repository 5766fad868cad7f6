"""Plain SQL for the attribution queries, written from the definitions and independent of the DataFrame code."""

from __future__ import annotations

from pathlift.sources.fixtures import TEST_CONFIG as CFG, with_clause

DIMS = list(CFG.dimensions)
COLS = ", ".join(DIMS)


def norm(c: str) -> str:
    return f"COALESCE(NULLIF(TRIM({c}), ''), 'none')"


def base(pt: str | None = None, source: str = "fx_app_daily") -> list[str]:
    """Facts in range, daily totals, kept days and window totals."""
    where = f"WHERE pt = '{pt}'" if pt else ""
    wins = ", ".join(f"('{w.key}', {w.observation_days}, {i})" for i, w in enumerate(CFG.windows))
    return [
        *with_clause(source),
        f"src AS (SELECT * FROM {source} {where})",
        f"""f AS (SELECT create_date AS day, {', '.join(f'{norm(d)} AS {d}' for d in DIMS)}, cnt, approval_cnt,
            approval_jy0_cnt, cid_cnt, approval_cid_cnt FROM src
            WHERE create_date >= (SELECT MAX(create_date) FROM src) - {CFG.lookback_days + 2})""",
        """daily AS (SELECT day, SUM(cnt) AS total, SUM(approval_cnt) AS approvals, SUM(approval_jy0_cnt) AS jy0,
            SUM(cid_cnt) AS persons, SUM(approval_cid_cnt) AS person_approvals, COUNT(*) AS n_rows FROM f GROUP BY day)""",
        f"""kept AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY day DESC) AS rn FROM daily)
            WHERE rn <= {CFG.lookback_days})""",
        f"wins AS (SELECT * FROM (VALUES {wins}) AS v(w, n, ord))",
        """tot AS (SELECT w, n, ord, SUM(CASE WHEN rn <= n THEN total ELSE 0 END) AS ot,
            SUM(CASE WHEN rn > n THEN total ELSE 0 END) AS bt, COUNT(CASE WHEN rn <= n THEN 1 END) AS od,
            COUNT(CASE WHEN rn > n THEN 1 END) AS bd,
            MIN(CASE WHEN rn <= n THEN day END) AS os, MAX(CASE WHEN rn <= n THEN day END) AS oe,
            MIN(CASE WHEN rn > n THEN day END) AS bs, MAX(CASE WHEN rn > n THEN day END) AS be
            FROM wins CROSS JOIN kept GROUP BY w, n, ord)""",
        "fk AS (SELECT f.*, kept.rn FROM f JOIN kept ON f.day = kept.day)",
    ]


def single_source() -> str:
    parts = [
        f"SELECT {', '.join(d if d == t else f'CAST(NULL AS VARCHAR) AS {d}' for d in DIMS)}, rn, SUM(cnt) AS c "
        f"FROM fk GROUP BY {t}, rn"
        for t in DIMS
    ]
    return " UNION ALL ".join(parts)


def extension_source(seeds: str, fields: list[str] | None = None) -> str:
    on = " AND ".join(f"(s.{d} IS NULL OR s.{d} = k.{d})" for d in DIMS)
    parts = []
    for t in fields or DIMS:
        cols = ", ".join(f"k.{d} AS {d}" if d == t else f"s.{d} AS {d}" for d in DIMS)
        keys = ", ".join(f"s.{d}" for d in DIMS)
        parts.append(
            f"SELECT {cols}, k.rn, SUM(k.cnt) AS c FROM {seeds} s JOIN fk k ON {on} WHERE s.{t} IS NULL "
            f"GROUP BY {keys}, k.{t}, k.rn"
        )
    return f"SELECT DISTINCT * FROM ({' UNION ALL '.join(parts)})"


def records(name: str, order: list[str] | None = None) -> list[str]:
    """Window metrics and records of the paths in ``<name>_src`` (dims, rn, c)."""
    shown = order or DIMS
    level = "CASE " + " ".join(
        f"WHEN o >= {t.min_observation_count} AND g >= {t.min_growth_factor} AND l >= {t.min_structure_lift_factor} "
        f"AND z >= {t.min_z_score} THEN {t.level}"
        for t in sorted(CFG.thresholds, key=lambda t: -t.level)
    ) + " ELSE 0 END"
    text = {d: f"CASE WHEN {d} IS NOT NULL THEN CONCAT('{d}=', {d}) END" for d in DIMS}
    suppressed = " OR ".join(f"COALESCE({r.field} = '{r.value}', FALSE)" for r in CFG.suppression_rules)
    return [
        f"""{name}_m AS (SELECT {', '.join('p.' + d for d in DIMS)}, t.w, t.ord, t.n, CAST(t.ot AS DOUBLE) AS ot,
            CAST(t.bt AS DOUBLE) AS bt, t.od, t.bd, t.os, t.oe, t.bs AS bstart, t.be,
            CAST(SUM(CASE WHEN p.rn <= t.n THEN p.c ELSE 0 END) AS DOUBLE) AS o,
            CAST(SUM(CASE WHEN p.rn > t.n THEN p.c ELSE 0 END) AS DOUBLE) AS b
            FROM {name}_src p CROSS JOIN tot t
            GROUP BY {', '.join('p.' + d for d in DIMS)}, t.w, t.ord, t.n, t.ot, t.bt, t.od, t.bd, t.os, t.oe, t.bs, t.be)""",
        f"""{name}_a AS (SELECT *, b / GREATEST(bd, 1) AS b_daily, o / GREATEST(od, 1) AS o_daily,
            CASE WHEN bt > 0 THEN b / bt ELSE 0 END AS b_share, CASE WHEN ot > 0 THEN o / ot ELSE 0 END AS o_share
            FROM {name}_m)""",
        f"""{name}_b AS (SELECT *, CASE WHEN b_daily > 0 THEN o_daily / b_daily ELSE 0 END AS g,
            CASE WHEN b_share > 0 THEN o_share / b_share ELSE 0 END AS l,
            CASE WHEN bt > 0 THEN ot * b_share ELSE 0 END AS e FROM {name}_a)""",
        f"{name}_c AS (SELECT *, o - e AS x, CASE WHEN e > 0 THEN (o - e) / SQRT(e) ELSE 0 END AS z FROM {name}_b)",
        f"""{name}_w AS (SELECT {COLS}, w, ord, od, bd, os, oe, bstart, be, b, o, {level} AS level,
            ROUND_EVEN(b_daily, 4) AS b_daily, ROUND_EVEN(o_daily, 4) AS o_daily, ROUND_EVEN(b_share, 8) AS b_share,
            ROUND_EVEN(o_share, 8) AS o_share, ROUND_EVEN(o_share - b_share, 8) AS change,
            ROUND_EVEN(g, 4) AS g, ROUND_EVEN(l, 4) AS l, ROUND_EVEN(e, 4) AS e, ROUND_EVEN(x, 4) AS x,
            ROUND_EVEN(z, 4) AS z FROM {name}_c)""",
        f"""{name}_p AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY {COLS}
            ORDER BY CASE WHEN b_daily > 0 THEN 1 ELSE 0 END DESC, level DESC, LEAST(g, l) DESC, z DESC, o DESC, ord) AS pick
            FROM {name}_w)""",
        f"""{name} AS (SELECT *, CASE WHEN hits >= 2 THEN '持续高位' WHEN hit_windows = '1d' THEN '单日尖峰'
            WHEN hit_windows = '3d' THEN '短期放量' WHEN hit_windows = '7d' THEN '趋势抬升' ELSE '无预警' END AS anomaly_type,
            SUBSTR(SHA1(canonical_path), 1, 12) AS id FROM (
            SELECT {COLS}, CONCAT_WS(' / ', {', '.join(text[d] for d in sorted(DIMS))}) AS canonical_path,
            CONCAT_WS(' / ', {', '.join(text[d] for d in shown)}) AS path,
            {' + '.join(f'CASE WHEN {d} IS NULL THEN 0 ELSE 1 END' for d in DIMS)} AS depth,
            CAST(MAX(level) AS INTEGER) AS level, CAST(COUNT(CASE WHEN level > 0 THEN 1 END) AS INTEGER) AS hits,
            COALESCE(STRING_AGG(w, ',' ORDER BY ord) FILTER (WHERE level > 0), '') AS hit_windows,
            MAX(CASE WHEN pick = 1 THEN w END) AS primary_window, MAX(CASE WHEN pick = 1 THEN o END) AS obs,
            MAX(CASE WHEN pick = 1 THEN g END) AS growth, MAX(CASE WHEN pick = 1 THEN l END) AS lift,
            MAX(CASE WHEN pick = 1 THEN z END) AS z, MAX(CASE WHEN pick = 1 THEN x END) AS excess,
            MAX(CASE WHEN pick = 1 THEN LEAST(g, l) END) AS strength, ({suppressed}) AS suppressed
            FROM {name}_p GROUP BY {COLS}))""",
    ]


ORDER = "level DESC, hits DESC, strength DESC, z DESC, obs DESC, canonical_path"
FLOOR = CFG.level0_min_observation


def single() -> list[str]:
    return [f"single_src AS ({single_source()})", *records("single")]


def pair() -> list[str]:
    return [
        *single(),
        f"""seeds1 AS (SELECT * FROM single WHERE NOT suppressed AND (level > 0 OR obs >= {FLOOR})
            ORDER BY {ORDER} LIMIT {CFG.single_limit})""",
        f"pair_src AS ({extension_source('seeds1')})",
        *records("pair"),
    ]


def third() -> list[str]:
    return [
        *pair(),
        f"""seeds2 AS (SELECT * FROM pair WHERE NOT suppressed AND (level > 0 OR obs >= {FLOOR})
            ORDER BY {ORDER} LIMIT {CFG.pair_limit})""",
        f"third_src AS ({extension_source('seeds2')})",
        *records("third"),
    ]


EXPERT_ORDER = ["systemtype", "reg_sx_days", "register_software", "traffic_channel", "device_brand"]


def expert() -> list[str]:
    a, b, c = CFG.expert_path[:3]

    def fixed(path: dict) -> str:
        return ", ".join(
            f"'{path[d]}' AS {d}" if d in path else f"CAST(NULL AS VARCHAR) AS {d}" for d in DIMS
        )

    one, two = {a.field: a.value}, {a.field: a.value, b.field: b.value}
    cond = {"x1": one, "x2": two}
    parts = [
        f"SELECT {fixed(p)}, k.rn, COALESCE(SUM(f.cnt), 0) AS c FROM kept k LEFT JOIN f ON f.day = k.day AND "
        + " AND ".join(f"f.{d} = '{v}'" for d, v in p.items()) + " GROUP BY k.rn"
        for p in cond.values()
    ]
    return [
        f"xseed AS (SELECT {fixed(two)})",
        f"expert_src AS ({' UNION ALL '.join(parts)} UNION ALL {extension_source('xseed', [c.field])})",
        *records("expert", EXPERT_ORDER),
    ]


def merged() -> list[str]:
    """All alerts, suppressed records and the merge of both searches."""
    a, b, c = CFG.expert_path[:3]
    cols = "canonical_path, path, id, level, hits, hit_windows, primary_window, obs, growth, lift, z, excess, " \
           f"strength, anomaly_type, depth, {COLS}"
    return [
        *third(),
        *expert(),
        f"""topk AS (SELECT {cols} FROM single WHERE NOT suppressed AND level > 0 UNION ALL
            SELECT {cols} FROM pair WHERE NOT suppressed AND level > 0 UNION ALL
            SELECT {cols} FROM third WHERE NOT suppressed AND level > 0)""",
        f"""xalerts AS (SELECT {cols}, CASE depth WHEN 1 THEN '{a.label}' WHEN 2 THEN '{b.label}' ELSE '{c.label}' END
            AS note FROM expert WHERE NOT suppressed AND level > 0)""",
        f"""merged AS (SELECT {cols}, CASE WHEN canonical_path IN (SELECT canonical_path FROM xalerts)
            THEN 'Top-K + 专家规则' ELSE 'Top-K' END AS source,
            canonical_path IN (SELECT canonical_path FROM xalerts) AS forced,
            COALESCE((SELECT MAX(note) FROM xalerts x WHERE x.canonical_path = t.canonical_path), '') AS note FROM topk t
            UNION ALL SELECT {cols}, '专家规则', TRUE, note FROM xalerts
            WHERE canonical_path NOT IN (SELECT canonical_path FROM topk))""",
        f"""suppressed AS (SELECT DISTINCT ON (canonical_path) {cols} FROM (
            SELECT {cols}, 0 AS o_ FROM single WHERE suppressed AND level > 0 UNION ALL
            SELECT {cols}, 0 FROM pair WHERE suppressed AND level > 0 UNION ALL
            SELECT {cols}, 0 FROM third WHERE suppressed AND level > 0 UNION ALL
            SELECT {cols}, 1 FROM expert WHERE suppressed AND level > 0) ORDER BY canonical_path, o_)""",
        f"head AS (SELECT * FROM merged ORDER BY {ORDER} LIMIT 1)",
    ]


def query(ctes: list[str], select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


RECORD_SELECT = (
    "canonical_path, path, level, hit_windows, hits AS hit_window_count, primary_window, anomaly_type, "
    "obs AS observation_count, growth AS growth_factor, lift AS structure_lift_factor, z AS z_score, "
    "excess AS excess_count, strength AS relative_strength"
)
