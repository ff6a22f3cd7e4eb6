"""Independent DuckDB SQL for each registered query (the correctness oracle).

These are written as plain relational SQL over the base tables (the cube is
rebuilt with GROUP BY GROUPING SETS inside each statement); dense grids use
CROSS JOIN and totals use UNION ALL, i.e. a different formulation from the
Spark plans they check.
"""

from __future__ import annotations

MASKED, NORMAL, UNMAPPED = "遮蔽", "正常", "未分類區域"
DIMS = ["DATA_YR", "COUNTY", "SEG", "PRI", "REGION"]
NUMERIC = {"DATA_YR"}

CUBE_CTE = f"""
t0 AS (
  SELECT CAST(year(o.o_orderdate) AS BIGINT) AS yr, c.c_nationkey AS nat, c.c_mktsegment AS seg,
         o.o_orderpriority AS pri, CAST(round(o.o_totalprice * 100) AS BIGINT) AS cents, o.o_totalprice AS price
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
),
tc AS (
  SELECT yr AS DATA_YR, nat AS COUNTY, seg AS SEG, pri AS PRI,
         CAST(count(*) AS BIGINT) AS CNT, CAST(sum(cents) AS BIGINT) AS SUM_PRICE,
         CAST(count(price) AS BIGINT) AS CNT_PRICE,
         CAST(GROUPING(nat) * 4 + GROUPING(seg) * 2 + GROUPING(pri) AS BIGINT) AS GID
  FROM t0
  GROUP BY GROUPING SETS ((yr), (yr, seg), (yr, pri), (yr, seg, pri),
                          (yr, nat), (yr, nat, seg), (yr, nat, pri), (yr, nat, seg, pri))
),
t AS (SELECT *, CASE WHEN CNT < 3 THEN '{MASKED}' ELSE '{NORMAL}' END AS DATA_STATUS FROM tc),
dl AS (
  SELECT t.DATA_YR,
         CASE WHEN t.COUNTY IS NULL THEN NULL ELSE coalesce(n.n_name, CAST(t.COUNTY AS VARCHAR)) END AS COUNTY,
         t.SEG, t.PRI, t.CNT, t.SUM_PRICE, t.CNT_PRICE, t.GID, t.DATA_STATUS, r.r_name AS rname
  FROM t LEFT JOIN nation n ON n.n_nationkey = t.COUNTY LEFT JOIN region r ON r.r_regionkey = n.n_regionkey
),
d AS (
  SELECT DATA_YR, COUNTY, SEG, PRI, CNT, SUM_PRICE, CNT_PRICE, GID, DATA_STATUS,
         CASE WHEN COUNTY IS NULL THEN NULL ELSE coalesce(rname, '{UNMAPPED}') END AS REGION
  FROM dl
)"""


def lit(v) -> str:
    if isinstance(v, (int, float)):
        return repr(v)
    return "'" + str(v).replace("'", "''") + "'"


def conj(parts: list[str]) -> str:
    return " AND ".join(f"({p})" for p in parts) if parts else "TRUE"


def smart_filter(src: str, tab: str | None, rows: list[str], cols: list[str], filters: dict,
                 probe: str = "prefix", dims: list[str] = DIMS) -> str:
    """SELECT of the rows a crosstab sums (aggregate-aware filter)."""
    axes = ({tab} if tab else set()) | set(rows) | set(cols)
    base: list[str] = []
    probes = []
    for dcol in dims:
        if dcol in filters:
            vals = [float(v) if dcol in NUMERIC else v for v in filters[dcol]]
            base.append(f"{dcol} IN ({', '.join(lit(v) for v in vals)})")
        if dcol in axes:
            base.append(f"{dcol} IS NOT NULL")
        else:
            probes.append((dcol, list(base)))
    if probe == "full":
        probes = [(dcol, list(base)) for dcol, _ in probes]
    if not probes:
        return f"SELECT * FROM {src} WHERE {conj(base)}"
    flags = ", ".join(f"coalesce(bool_or({conj(b)} AND {dcol} IS NULL), false) AS h_{dcol}" for dcol, b in probes)
    where = [conj(base)] + [f"NOT p.h_{dcol} OR s.{dcol} IS NULL" for dcol, _ in probes]
    return f"SELECT s.* FROM {src} s CROSS JOIN (SELECT {flags} FROM {src}) p WHERE {conj(where)}"


def with_cube(body: str, extra_ctes: list[tuple[str, str]] = (), cube_cte: str | None = None) -> str:
    ctes = (cube_cte or CUBE_CTE) + "".join(f",\n{name} AS (\n{sql}\n)" for name, sql in extra_ctes)
    return f"WITH {ctes}\n{body}"


def _null(col: str) -> str:
    return "CAST(NULL AS BIGINT)" if col in NUMERIC else "CAST(NULL AS VARCHAR)"


def crosstab_ctes(tab: str, rows: list[str], cols: list[str], metric: str, filters: dict,
                  probe: str = "prefix", src: str = "d", post_where: str | None = None,
                  filter_tab: str | None = "same", dims: list[str] = DIMS) -> list[tuple[str, str]]:
    """CTEs f (filtered), leaf, dense, rt, ct, g, cells."""
    r, c = ", ".join(rows), ", ".join(cols)
    sf = smart_filter(src, tab if filter_tab == "same" else filter_tab, rows, cols, filters, probe, dims)
    if post_where:
        sf = f"SELECT * FROM ({sf}) WHERE {post_where}"
    ctes = [("f", sf)]
    if cols:
        on = " AND ".join([f"l.{tab} = rk.{tab}"] + [f"l.{x} = rk.{x}" for x in rows] + [f"l.{x} = ck.{x}" for x in cols])
        ctes += [
            ("leaf", f"SELECT {tab}, {r}, {c}, CAST(coalesce(sum({metric}), 0) AS BIGINT) AS v FROM f GROUP BY ALL"),
            ("rk", f"SELECT DISTINCT {tab}, {r} FROM f"),
            ("ck", f"SELECT DISTINCT {c} FROM f"),
            ("dense", f"SELECT rk.{tab}, {', '.join('rk.' + x for x in rows)}, {', '.join('ck.' + x for x in cols)}, "
                      f"coalesce(l.v, 0) AS v FROM rk CROSS JOIN ck LEFT JOIN leaf l ON {on}"),
            ("rt", f"SELECT {tab}, {r}, CAST(sum(v) AS BIGINT) AS t FROM dense GROUP BY ALL"),
            ("ct", f"SELECT {tab}, {c}, CAST(sum(v) AS BIGINT) AS t FROM dense GROUP BY ALL"),
            ("g", f"SELECT {tab}, CAST(sum(v) AS BIGINT) AS t FROM dense GROUP BY ALL"),
        ]
        nr = ", ".join(f"{_null(x)} AS {x}" for x in rows)
        nc = ", ".join(f"{_null(x)} AS {x}" for x in cols)
        cells = (f"SELECT {tab}, {r}, {c}, false AS is_row_total, false AS is_col_total, v AS value FROM dense\n"
                 f"UNION ALL SELECT {tab}, {r}, {nc}, false, true, t FROM rt\n"
                 f"UNION ALL SELECT {tab}, {nr}, {c}, true, false, t FROM ct\n"
                 f"UNION ALL SELECT {tab}, {nr}, {nc}, true, true, t FROM g")
    else:
        ctes += [
            ("rt", f"SELECT {tab}, {r}, CAST(coalesce(sum({metric}), 0) AS BIGINT) AS t FROM f GROUP BY ALL"),
            ("g", f"SELECT {tab}, CAST(sum(t) AS BIGINT) AS t FROM rt GROUP BY ALL"),
        ]
        nr = ", ".join(f"{_null(x)} AS {x}" for x in rows)
        cells = (f"SELECT {tab}, {r}, false AS is_row_total, false AS is_col_total, t AS value FROM rt\n"
                 f"UNION ALL SELECT {tab}, {r}, false, true, t FROM rt\n"
                 f"UNION ALL SELECT {tab}, {nr}, true, false, t FROM g\n"
                 f"UNION ALL SELECT {tab}, {nr}, true, true, t FROM g")
    ctes.append(("cells", cells))
    return ctes


def pct_select(tab: str, rows: list[str], cols: list[str]) -> str:
    """Cells with row / column / total percentages (joins to the totals)."""
    rj = " AND ".join([f"rt.{tab} = u.{tab}"] + [f"rt.{x} = u.{x}" for x in rows])
    row_den = "CASE WHEN u.is_row_total THEN g.t ELSE rt.t END"
    if cols:
        cj = " AND ".join([f"ct.{tab} = u.{tab}"] + [f"ct.{x} = u.{x}" for x in cols])
        col_den = "CASE WHEN u.is_col_total THEN g.t ELSE ct.t END"
        ct_join = f"LEFT JOIN ct ON {cj}"
    else:
        col_den, ct_join = "g.t", ""
    return (f"SELECT u.*, CAST(u.value AS DOUBLE) / NULLIF(CAST({row_den} AS DOUBLE), 0) AS row_pct,\n"
            f"  CAST(u.value AS DOUBLE) / NULLIF(CAST({col_den} AS DOUBLE), 0) AS col_pct,\n"
            f"  CAST(u.value AS DOUBLE) / NULLIF(CAST(g.t AS DOUBLE), 0) AS total_pct\n"
            f"FROM cells u JOIN g ON g.{tab} = u.{tab} LEFT JOIN rt ON {rj} {ct_join}")


def crosstab(tab, rows, cols, metric="CNT", filters=None, pct=True, probe="prefix") -> str:
    ctes = crosstab_ctes(tab, rows, cols, metric, filters or {}, probe)
    body = pct_select(tab, rows, cols) if pct else "SELECT * FROM cells"
    return with_cube(body, ctes)


def averages_ctes(tab: str, rows: list[str], names: list[str], num: str = "SUM_PRICE",
                  den: str = "CNT_PRICE") -> list[tuple[str, str]]:
    """CTE avg over f: weighted average of num / den per row and for the total
    row, one row per average name."""
    r = ", ".join(rows)
    names_sql = ", ".join(f"({lit(n)})" for n in names)
    return [
        ("ag", f"SELECT {tab}, {r}, GROUPING({rows[0]}) AS gr, CAST(coalesce(sum({num}), 0) AS BIGINT) AS n, "
               f"CAST(coalesce(sum({den}), 0) AS BIGINT) AS dd FROM f GROUP BY GROUPING SETS (({tab}, {r}), ({tab}))"),
        ("av", f"SELECT {tab}, {r}, gr = 1 AS is_row_total, v.name AS avg_name, "
               "CASE WHEN dd <> 0 THEN CAST(n AS DOUBLE) / CAST(dd AS DOUBLE) WHEN gr = 1 THEN 0.0 "
               "WHEN n > 0 THEN CAST('Infinity' AS DOUBLE) WHEN n < 0 THEN CAST('-Infinity' AS DOUBLE) ELSE 0.0 END AS avg_value "
               f"FROM ag CROSS JOIN (VALUES {names_sql}) v(name)"),
    ]


def weighted_avg(tab, rows, cols, metric="CNT", filters=None, names=()) -> str:
    ctes = [("f", smart_filter("d", tab, rows, cols, filters or {}))] + averages_ctes(tab, rows, list(names))
    return with_cube("SELECT * FROM av", ctes)


def growth_overall(tab, rows, cols, metric="CNT", filters=None) -> str:
    ctes = crosstab_ctes(tab, rows, cols, metric, filters or {})
    ctes.append(("tot", f"SELECT {tab}, value AS TOTAL, lag(value) OVER (ORDER BY {tab}) AS prev "
                        f"FROM cells WHERE is_row_total AND is_col_total"))
    body = (f"SELECT {tab}, TOTAL, gr AS YEARLY_GROWTH, gr * 100 AS YEARLY_GROWTH_PCT FROM ("
            f"SELECT {tab}, TOTAL, CASE WHEN prev IS NULL THEN 0.0 WHEN prev = 0 AND TOTAL = 0 THEN 0.0 "
            f"WHEN prev = 0 THEN CAST('Infinity' AS DOUBLE) "
            f"ELSE CAST(TOTAL AS DOUBLE) / CAST(prev AS DOUBLE) - 1.0 END AS gr FROM tot)")
    return with_cube(body, ctes)


def growth_series(tab, rows, cols, metric="CNT", filters=None, by="rows") -> str:
    ctes = crosstab_ctes(tab, rows, cols, metric, filters or {})
    keys = (rows + ["is_row_total"]) if by == "rows" else (cols + ["is_col_total"])
    src_where = "is_col_total" if by == "rows" else "is_row_total"
    k = ", ".join(keys)
    on = " AND ".join([f"s.{tab} = ty.{tab}"] + [f"s.{x} IS NOT DISTINCT FROM kk.{x}" for x in keys])
    ctes += [
        ("src", f"SELECT {tab}, {k}, value FROM cells WHERE {src_where}"),
        ("grid", f"SELECT ty.{tab}, {', '.join('kk.' + x for x in keys)}, s.value FROM (SELECT DISTINCT {k} FROM src) kk "
                 f"CROSS JOIN (SELECT DISTINCT {tab} FROM src) ty LEFT JOIN src s ON {on}"),
        ("ff", f"SELECT {tab}, {k}, last_value(value IGNORE NULLS) OVER (PARTITION BY {k} ORDER BY {tab} "
               f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v, "
               f"row_number() OVER (PARTITION BY {k} ORDER BY {tab}) AS rn FROM grid"),
        ("lg", f"SELECT *, lag(v) OVER (PARTITION BY {k} ORDER BY {tab}) AS pv FROM ff"),
    ]
    body = (f"SELECT {tab}, {k}, CASE WHEN v IS NULL OR pv IS NULL THEN NULL "
            f"WHEN pv <> 0 THEN (CAST(v AS DOUBLE) / CAST(pv AS DOUBLE) - 1.0) * 100.0 "
            f"WHEN v > 0 THEN CAST('Infinity' AS DOUBLE) WHEN v < 0 THEN CAST('-Infinity' AS DOUBLE) END AS growth_pct "
            f"FROM lg WHERE rn > 1")
    return with_cube(body, ctes)


def label_rank_cte(name: str, codes_sql: str) -> tuple[str, str]:
    """(label, rnk): position of the code in the sorted code list, the last
    position for a label listed twice. ``codes_sql`` yields (code, label)."""
    return (name, f"SELECT label, max(pos) AS rnk FROM (SELECT label, row_number() OVER (ORDER BY code) - 1 AS pos "
                  f"FROM ({codes_sql})) GROUP BY label")


NATION_CODES = "SELECT n_nationkey AS code, n_name AS label FROM nation"
PRI_CODES = ("SELECT * FROM (VALUES (1, '1-URGENT'), (2, '2-HIGH'), (3, '3-MEDIUM'), (4, '4-NOT SPECIFIED'), "
             "(5, '5-LOW')) v(code, label)")


def axis_order(tab, rows, cols, metric="CNT", filters=None, axis="rows", codes_sql=None, out="row_rank") -> str:
    ctes = crosstab_ctes(tab, rows, cols, metric, filters or {})
    dims = rows if axis == "rows" else cols
    flag = "is_row_total" if axis == "rows" else "is_col_total"
    other = "is_col_total" if axis == "rows" else "is_row_total"
    k = ", ".join(dims)
    ctes.append(("keys", f"SELECT DISTINCT {tab}, {k}, {flag} FROM cells WHERE {other}"))
    if codes_sql:
        ctes.append(label_rank_cte("lr", codes_sql))
        order = f"{flag} DESC, lr.rnk ASC NULLS LAST, " + ", ".join(f"k.{x} ASC NULLS FIRST" for x in dims)
        src = f"keys k LEFT JOIN lr ON lr.label = CAST(k.{dims[0]} AS VARCHAR)"
    else:
        order = f"{flag} DESC, " + ", ".join(f"k.{x} ASC NULLS FIRST" for x in dims)
        src = "keys k"
    body = (f"SELECT k.{tab}, {', '.join('k.' + x for x in dims)}, k.{flag}, "
            f"row_number() OVER (PARTITION BY k.{tab} ORDER BY {order}) AS {out} FROM {src}")
    return with_cube(body, ctes)


def _row_labels(rows: list[str], prefix: str = "") -> str:
    out = []
    for i, x in enumerate(rows):
        lab = "'全國'" if i == 0 else "''"
        out.append(f"CASE WHEN {prefix}is_row_total THEN {lab} ELSE CAST({prefix}{x} AS VARCHAR) END AS {x}")
    return ", ".join(out)


def mix_report(tab, rows, cols, metric="CNT", filters=None, avg_names=()) -> str:
    """Long MIX cells (single column dimension)."""
    filters = filters or {}
    ctes = crosstab_ctes(tab, rows, cols, metric, filters) + averages_ctes(tab, rows, list(avg_names))
    ctes.append(("pc", pct_select(tab, rows, cols)))
    c = cols[0]
    ctes.append(("crk", f"SELECT {tab}, {c}, is_col_total, row_number() OVER (PARTITION BY {tab} "
                        f"ORDER BY is_col_total DESC, {c} ASC NULLS FIRST) AS crank "
                        f"FROM (SELECT DISTINCT {tab}, {c}, is_col_total FROM cells WHERE is_row_total)"))
    n_avg = len(avg_names)
    pos = " ".join(f"WHEN {lit(n)} THEN {i + 1}" for i, n in enumerate(avg_names))
    parts = [
        f"SELECT {tab}, {_row_labels(rows)}, is_row_total, '全國' AS \"column\", 'value' AS kind, "
        f"CAST(value AS DOUBLE) AS value, CAST(0 AS BIGINT) AS col_order FROM pc WHERE is_col_total",
        f"SELECT {tab}, {_row_labels(rows)}, is_row_total, avg_name, 'avg', avg_value, "
        f"CAST(CASE avg_name {pos} END AS BIGINT) FROM av",
        f"SELECT p.{tab}, {_row_labels(rows, 'p.')}, p.is_row_total, CAST(p.{c} AS VARCHAR), 'value', "
        f"CAST(p.value AS DOUBLE), CAST({n_avg} + (k.crank - 2) * 2 + 1 AS BIGINT) "
        f"FROM pc p JOIN crk k ON k.{tab} = p.{tab} AND k.{c} = p.{c} WHERE NOT p.is_col_total",
        f"SELECT p.{tab}, {_row_labels(rows, 'p.')}, p.is_row_total, CAST(p.{c} AS VARCHAR) || '(%)', 'pct', "
        f"p.row_pct, CAST({n_avg} + (k.crank - 2) * 2 + 2 AS BIGINT) "
        f"FROM pc p JOIN crk k ON k.{tab} = p.{tab} AND k.{c} = p.{c} WHERE NOT p.is_col_total",
    ]
    ctes.append(("mx", "\nUNION ALL ".join(parts)))
    body = ("SELECT *, CASE WHEN contains(\"column\", '(%)') THEN 'percent' "
            "WHEN contains(\"column\", '平均') OR contains(lower(\"column\"), 'age') THEN 'decimal2' "
            "ELSE 'integer' END AS format FROM mx")
    return with_cube(body, ctes)


def reference_where(tab: str, rows: list[str], cols: list[str], filters: dict, derived=(("REGION", "COUNTY"),)) -> str:
    axes = set(rows) | set(cols)
    parts = [f"{tab} IS NOT NULL"]
    for col, vals in filters.items():
        if col in DIMS and col not in axes and col != tab:
            vv = [float(v) if col in NUMERIC else v for v in vals]
            parts.append(f"{col} IN ({', '.join(lit(v) for v in vv)})")
    parts += [f"{x} IS NULL" for x in rows + cols]
    dmap = dict(derived)
    for dcol in DIMS:
        if dcol in filters or dcol in axes or dcol == tab:
            continue
        parent = dmap.get(dcol)
        if parent and parent in filters and parent not in axes:
            continue
        parts.append(f"{dcol} IS NULL")
    return conj(parts)


NOTE_HEAD, NOTE_MID, NOTE_TAIL = "此分組包含 ", " 組被遮蔽資料（樣本數小於 3 筆）。（而未經篩選及遮蔽的本分組總計應為: ", " 宅）"


def report_sheet_cells(spec: dict, sheet: str, rank: int, focus, avg_names) -> str:
    tab, rows, cols = spec["tab"], spec["rows"], spec["cols"]
    mix = mix_report(tab, rows, cols, spec.get("metric", "CNT"), spec["filters"], avg_names)
    focus_pred = f"{tab} = {focus}" if focus is not None else f"{tab} = __m"
    return (f"SELECT {lit(sheet)} AS sheet, CAST({rank} AS BIGINT) AS sheet_rank, CAST({tab} AS VARCHAR) AS tab, "
            f"{rows[0]} AS row_1, CAST(NULL AS VARCHAR) AS row_2, is_row_total, \"column\", kind, value, col_order, format "
            f"FROM (SELECT *, max({tab}) OVER () AS __m FROM ({mix})) WHERE {focus_pred}")


def report_sheet_note(spec: dict, sheet: str, rank: int, focus, chapter: str, title: str, desc: str,
                      names: dict | None = None, headline: str = "") -> str:
    tab, rows, cols, filters = spec["tab"], spec["rows"], spec["cols"], spec["filters"]
    fsql = smart_filter("d", tab, rows, cols, filters)
    focus_sql = str(focus) if focus is not None else f"(SELECT max({tab}) FROM f)"
    msg = (f"{lit(NOTE_HEAD)} || CAST(n_masked AS VARCHAR) || {lit(NOTE_MID)} || format('{{:,}}', ref_total) "
           f"|| {lit(NOTE_TAIL)}")
    stripped = (f"regexp_replace(regexp_replace({lit(desc)}, '(?s)此分組包含 \\d+ 組被遮蔽資料.*?宅）', '', 'g'), "
                f"'^\\s+|\\s+$', '', 'g')")
    body = (f"SELECT {lit(sheet)} AS sheet, CAST({rank} AS BIGINT) AS sheet_rank, {lit(chapter)} AS chapter, "
            f"{lit(title)} AS title, {lit(headline)} AS headline, CAST({focus_sql} AS VARCHAR) AS focus_tab, n_masked, ref_total, "
            f"CASE WHEN n_masked > 0 THEN (CASE WHEN {stripped} <> '' THEN {stripped} || chr(10) || {msg} ELSE {msg} END) "
            f"ELSE {lit(desc)} END AS description, "
            f"CAST({focus_sql} AS VARCHAR) || ' 年' || {lit(_context(filters))} || {lit(_dn(names, rows))} || '分佈 - 按' || "
            f"{lit(_dn(names, rows))} || '與' || {lit(_dn(names, cols))} || '區分' AS auto_title FROM ("
            f"SELECT (SELECT CAST(count(*) AS BIGINT) FROM f WHERE DATA_STATUS = '{MASKED}' AND {tab} = {focus_sql}) AS n_masked, "
            f"(SELECT CAST(coalesce(sum(CNT), 0) AS BIGINT) FROM d WHERE {reference_where(tab, rows, cols, filters)} "
            f"AND {tab} = {focus_sql}) AS ref_total)")
    return f"SELECT * FROM (" + with_cube(body, [("f", fsql)]) + ")"


def preset(rows: list[str], cols: list[str], value: str, exclude: list[str]) -> str:
    excl = ", ".join(lit(x) for x in exclude)
    post = conj([f"CAST({x} AS VARCHAR) NOT IN ({excl})" for x in rows + cols]) if exclude else None
    ctes = [("dp", "SELECT *, 1 AS __all FROM d")]
    ctes += crosstab_ctes("__all", rows, cols, value, {}, src="dp", post_where=post, filter_tab=None)
    out = ", ".join(rows + cols + ["is_row_total", "is_col_total", "value", "row_pct", "col_pct", "total_pct"])
    return with_cube(f"SELECT {out} FROM ({pct_select('__all', rows, cols)})", ctes)


def _context(filters: dict) -> str:
    owned = [str(v) for v in filters.get("OWNED_TYPE", [])]
    if "單獨持有" in owned:
        return "所有權單獨持有住宅"
    if "多人持有" in owned:
        return "所有權多人持有住宅"
    return "住宅"


def _dn(names: dict | None, dims: list[str]) -> str:
    if not dims:
        return "總計"
    return (names or {}).get(dims[0], dims[0])


LINEITEM_DIMS = ["DATA_YR", "FLAG", "LSTATUS"]
LINEITEM_CUBE_CTE = f"""
l0 AS (
  SELECT CAST(year(l_shipdate) AS BIGINT) AS yr, l_returnflag AS fl, l_linestatus AS ls,
         CAST(l_quantity AS DECIMAL(18, 2)) AS qty FROM lineitem
),
lc AS (
  SELECT yr AS DATA_YR, fl AS FLAG, ls AS LSTATUS, CAST(count(*) AS BIGINT) AS CNT,
         CAST(sum(qty) AS DOUBLE) AS SUM_QTY, CAST(count(qty) AS BIGINT) AS CNT_QTY,
         CAST(GROUPING(fl) * 2 + GROUPING(ls) AS BIGINT) AS GID
  FROM l0 GROUP BY GROUPING SETS ((yr), (yr, fl), (yr, ls), (yr, fl, ls))
),
d AS (SELECT *, CASE WHEN CNT < 3 THEN '{MASKED}' ELSE '{NORMAL}' END AS DATA_STATUS FROM lc)"""


def lineitem_crosstab(tab, rows, cols, metric, filters=None) -> str:
    ctes = [(n, q.replace("AS BIGINT", "AS DOUBLE")) for n, q in crosstab_ctes(tab, rows, cols, metric, filters or {}, dims=LINEITEM_DIMS)]
    return with_cube(pct_select(tab, rows, cols), ctes, LINEITEM_CUBE_CTE)


EVENTS_DIMS = ["WEEK", "EVENT", "BAND"]
EVENTS_CUBE_CTE = f"""
e0 AS (
  SELECT CAST(strftime(ts, '%G%V') AS BIGINT) AS wk, event_type AS ev, CAST(floor(hour(ts) / 6) AS INTEGER) AS band,
         CAST(round(value * 100) AS BIGINT) AS cents FROM events
),
ec AS (
  SELECT wk AS WEEK, ev AS EVENT, band AS BAND, CAST(count(*) AS BIGINT) AS CNT,
         CAST(sum(cents) AS BIGINT) AS SUM_VALUE, CAST(count(cents) AS BIGINT) AS CNT_VALUE,
         CAST(GROUPING(ev) * 2 + GROUPING(band) AS BIGINT) AS GID
  FROM e0 GROUP BY GROUPING SETS ((wk), (wk, ev), (wk, band), (wk, ev, band))
),
d AS (
  SELECT WEEK, EVENT,
         CASE WHEN BAND IS NULL THEN NULL WHEN BAND = 0 THEN '00-05' WHEN BAND = 1 THEN '06-11'
              WHEN BAND = 2 THEN '12-17' WHEN BAND = 3 THEN '18-23' ELSE CAST(BAND AS VARCHAR) END AS BAND,
         CNT, SUM_VALUE, CNT_VALUE, GID, CASE WHEN CNT < 3 THEN '{MASKED}' ELSE '{NORMAL}' END AS DATA_STATUS
  FROM ec
)"""


def events_crosstab(tab, rows, cols, metric, filters=None) -> str:
    ctes = crosstab_ctes(tab, rows, cols, metric, filters or {}, dims=EVENTS_DIMS)
    return with_cube(pct_select(tab, rows, cols), ctes, EVENTS_CUBE_CTE)


def events_weighted_avg(tab, rows, cols, metric, filters=None, names=()) -> str:
    ctes = [("f", smart_filter("d", tab, rows, cols, filters or {}, dims=EVENTS_DIMS))]
    ctes += averages_ctes(tab, rows, list(names), num="SUM_VALUE", den="CNT_VALUE")
    return with_cube("SELECT * FROM av", ctes, EVENTS_CUBE_CTE)


def mix_nocols(tab, rows, metric, filters=None) -> str:
    """MIX cells without column dimensions: the total, the metric, its percent."""
    ctes = crosstab_ctes(tab, rows, [], metric, filters or {})
    ctes.append(("pc", pct_select(tab, rows, [])))
    parts = [f"SELECT {tab}, {_row_labels(rows)}, is_row_total, '全國' AS \"column\", 'value' AS kind, CAST(value AS DOUBLE) AS value, "
             f"CAST(0 AS BIGINT) AS col_order FROM pc WHERE is_col_total",
             f"SELECT {tab}, {_row_labels(rows)}, is_row_total, {lit(metric)}, 'value', CAST(value AS DOUBLE), CAST(1 AS BIGINT) FROM pc WHERE NOT is_col_total",
             f"SELECT {tab}, {_row_labels(rows)}, is_row_total, {lit(metric + '(%)')}, 'pct', row_pct, CAST(2 AS BIGINT) FROM pc WHERE NOT is_col_total"]
    ctes.append(("mx", "\nUNION ALL ".join(parts)))
    return with_cube("SELECT *, CASE WHEN contains(\"column\", '(%)') THEN 'percent' ELSE 'integer' END AS format FROM mx", ctes)


#: A cube whose microdata lack some dimension values, counted from the raw rows.
GAP_ROWS = """
r AS (SELECT CAST(year(o_orderdate) AS BIGINT) AS yr, CASE WHEN c_nationkey = 4 THEN -1 WHEN c_nationkey <> 3 THEN c_nationkey END AS ct,
             CASE WHEN c_custkey % 13 = 0 THEN '(missing)' WHEN c_custkey % 11 <> 0 THEN c_mktsegment END AS sg,
             CASE WHEN CAST(round(o_totalprice * 100) AS BIGINT) % 7 <> 0 THEN o_orderpriority END AS pr,
             CAST(round(o_totalprice * 100) AS BIGINT) AS cents
      FROM orders JOIN customer ON o_custkey = c_custkey)"""
CUBE_WITH_GAPS = f"""
WITH {GAP_ROWS}
SELECT yr AS DATA_YR, ct AS COUNTY, sg AS SEG, pr AS PRI, CAST(count(*) AS BIGINT) AS CNT, CAST(sum(cents) AS BIGINT) AS SUM_PRICE,
       CAST(count(cents) AS BIGINT) AS CNT_PRICE, CAST(GROUPING(ct) * 4 + GROUPING(sg) * 2 + GROUPING(pr) AS BIGINT) AS GID
FROM r GROUP BY GROUPING SETS ((yr), (yr, ct), (yr, sg), (yr, pr), (yr, ct, sg), (yr, ct, pr), (yr, sg, pr), (yr, ct, sg, pr))
"""
# Crosstab of nations and priorities straight from the rows with gaps: a missing
# value is a row or column of its own.
CROSSTAB_WITH_GAPS = f"""
WITH {GAP_ROWS},
leaf AS (SELECT yr, ct, pr, count(*) AS n FROM r WHERE sg IN ('BUILDING', '(missing)') GROUP BY ALL),
rk AS (SELECT DISTINCT yr, ct FROM leaf), ck AS (SELECT DISTINCT pr FROM leaf),
dense AS (SELECT rk.yr, rk.ct, ck.pr, coalesce(n, 0) AS n FROM rk CROSS JOIN ck LEFT JOIN leaf l
          ON l.yr = rk.yr AND l.ct IS NOT DISTINCT FROM rk.ct AND l.pr IS NOT DISTINCT FROM ck.pr)
SELECT yr AS DATA_YR, ct AS COUNTY, pr AS PRI, GROUPING(ct) = 1 AS is_row_total, GROUPING(pr) = 1 AS is_col_total, CAST(sum(n) AS BIGINT) AS value
FROM dense GROUP BY GROUPING SETS ((yr, ct, pr), (yr, ct), (yr, pr), (yr))
"""


# Columns of the given tables and how their values are written as text.
KINDS = {
    "region": {"r_regionkey": "long", "r_name": "text"},
    "nation": {"n_nationkey": "long", "n_name": "text", "n_regionkey": "long"},
    "customer": {"c_custkey": "long", "c_name": "text", "c_nationkey": "long", "c_acctbal": "double", "c_mktsegment": "text"},
    "supplier": {"s_suppkey": "long", "s_name": "text", "s_nationkey": "long", "s_acctbal": "double"},
    "part": {"p_partkey": "long", "p_name": "text", "p_brand": "text", "p_type": "text", "p_size": "long", "p_retailprice": "double"},
    "orders": {"o_orderkey": "long", "o_custkey": "long", "o_orderstatus": "text", "o_totalprice": "double", "o_orderdate": "timestamp", "o_orderpriority": "text"},
    "lineitem": {"l_orderkey": "long", "l_partkey": "long", "l_suppkey": "long", "l_linenumber": "long", "l_quantity": "double", "l_extendedprice": "double",
                 "l_discount": "double", "l_tax": "double", "l_returnflag": "text", "l_linestatus": "text", "l_shipdate": "timestamp"},
    "events": {"event_id": "long", "ts": "timestamp", "user_id": "long", "event_type": "text", "value": "double", "props": "text"},
}


def _text(c: str, kind: str) -> str:
    return {"double": f"CAST(CAST({c} AS DECIMAL(28,4)) AS VARCHAR)", "timestamp": f"CAST(epoch_us({c}) AS VARCHAR)"}.get(kind, f"CAST({c} AS VARCHAR)")


def _profile(table: str, src: str, kinds: dict[str, str]) -> str:
    """One row per column: kind, rows, missing values, ends and checksum."""
    return " UNION ALL ".join(
        f"SELECT {lit(table)} AS dataset, {lit(c)} AS \"column\", {lit(k)} AS kind, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) - count({c}) AS BIGINT) AS n_nulls, "
        f"{_text(f'min({c})', k)} AS min_text, {_text(f'max({c})', k)} AS max_text, "
        f"coalesce(sum(CAST('0x' || md5({_text(c, k)})[1:8] AS HUGEINT)), 0) AS checksum FROM {src}" for c, k in kinds.items())


def catalogue(delivered: dict[str, str], disabled: list[str], prefixes: dict[str, str]) -> str:
    rows = " UNION ALL ".join(_profile(name, t, KINDS[t]) for t, name in delivered.items())
    kind = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in prefixes.items())
    return (f"SELECT dataset AS name, CASE split_part(dataset, '_coded', 1) {kind} END AS dataset_type, max(n_rows) AS n_rows, CAST(count(*) AS BIGINT) AS n_columns, "
            f"CAST(sum(n_nulls) AS BIGINT) AS n_nulls, CAST(sum(checksum) AS VARCHAR) AS checksum, row_number() OVER (ORDER BY dataset) AS by_name, "
            f"row_number() OVER (ORDER BY dataset DESC) AS by_name_desc FROM ({rows}) WHERE dataset NOT IN ({', '.join(map(lit, disabled))}) GROUP BY dataset")


def delivery_inferred() -> str:
    gaps = "(SELECT * REPLACE (CASE WHEN p_partkey % 7 <> 0 THEN p_size END AS p_size) FROM part)"
    parts = [_profile("part", gaps, {**KINDS["part"], "p_size": "double"}), _profile("supplier", "supplier", KINDS["supplier"]), _profile("orders", "orders", KINDS["orders"])]
    return "SELECT * REPLACE (CAST(checksum AS VARCHAR) AS checksum) FROM (" + " UNION ALL ".join(parts) + ")"
