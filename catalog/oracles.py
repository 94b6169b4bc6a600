"""DuckDB SQL for the registered queries, written from the definitions.

Regressions are solved here by Gram-Schmidt on the rows and tail
probabilities by power series, unlike the Spark side.
"""

from __future__ import annotations

from factorlab.functions import symbols as S
from factorlab.schemas import FACTORS, LONG_SHORT, MODELS, PORTFOLIOS, QUINTILES

from .views import END, RAW_SYMBOLS, START

GRID_START, GRID_END = START.replace(day=1), END.replace(day=1)
LOOKBACKS = (6, 12, 24)
MID = "DATE '1997-01-01' AND DATE '1999-12-31'"


def r(expr: str, digits: int = 6) -> str:
    """Rounded, with negative zero folded into zero."""
    return f"round({expr}, {digits}) + 0.0"


def rounds(*names: str, digits: int = 6) -> str:
    return ", ".join(f"{r(n, digits)} AS {n}" for n in names)


def with_(*parts: str, final: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + final


# ---- views ----------------------------------------------------------------

def daily_sums(name: str, ticker: str) -> str:
    return f"""{name} AS (
  SELECT {ticker} AS ticker, CAST(l_shipdate AS DATE) AS date, count(*) AS n,
         sum(CAST(round(l_tax * 100) AS BIGINT)) AS tax,
         sum(CAST(round(l_discount * 100) AS BIGINT)) AS disc,
         sum(CAST(round(l_quantity) AS BIGINT)) AS qty,
         sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents
  FROM lineitem GROUP BY 1, 2)"""


def price_rows(name: str, source: str) -> str:
    return f"""{name} AS (
  SELECT ticker, date, CAST(100 AS DOUBLE) + CAST(tax - disc AS DOUBLE) / n AS price FROM {source})"""


SUPPLIER = "'S' || CAST(l_suppkey AS VARCHAR)"
DAILY = daily_sums("daily", SUPPLIER)
PRICES = DAILY + ",\n" + price_rows("prices", "daily")
PANEL = daily_sums("panel_sums", "l_returnflag || l_linestatus") + ",\n" + price_rows("panel", "panel_sums")

QUOTES = f"""quotes AS (
  SELECT {SUPPLIER} AS ticker, CAST(l_shipdate AS DATE) AS date, l_orderkey, l_linenumber,
         l_partkey, l_extendedprice, l_extendedprice / l_quantity AS price FROM lineitem)"""

CHARACTERISTICS = DAILY + """,
per_ticker AS (
  SELECT ticker, CAST(date_trunc('month', date) AS DATE) AS month, sum(n) AS n, sum(tax) AS tax,
         sum(disc) AS disc, sum(qty) AS qty, sum(cents) AS cents
  FROM daily WHERE date BETWEEN DATE '%s' AND DATE '%s' GROUP BY 1, 2),
totals AS (
  SELECT month, count(*) AS tickers, sum(n) AS all_n, sum(tax) AS all_tax, sum(disc) AS all_disc,
         sum(qty) AS all_qty, sum(cents) AS all_cents
  FROM per_ticker GROUP BY 1),
chars AS (SELECT * FROM per_ticker JOIN totals USING (month))""" % (START, END)

MEMBERSHIP = """membership AS (
  SELECT CAST(month + INTERVAL 1 MONTH AS DATE) AS date, ticker AS symbol FROM chars
  WHERE CAST(cents AS DOUBLE) >= 0.5::DOUBLE * (CAST(all_cents AS DOUBLE) / tickers))"""

RAW = """sold AS (SELECT DISTINCT date_trunc('month', o_orderdate) AS month, o_orderpriority AS name FROM orders),
raw AS (
  SELECT strftime(month, '%Y-%m-%d') AS date,
         '"' || string_agg(name, ', ' ORDER BY name) || ', ,"' AS tickers
  FROM sold GROUP BY month)"""


def monthly_rows(prices: str = "prices", prefix: str = "") -> str:
    """RET1 by joining each month to the one before."""
    b, m = prefix + "buckets", prefix + "monthly"
    return f"""{b} AS (
  SELECT ticker, CAST(date_trunc('month', date) AS DATE) AS month, CAST(count(*) AS INTEGER) AS n_days,
         arg_min(price, date) AS first_price, arg_max(price, date) AS last_price,
         min(date) AS first_day, max(date) AS last_day
  FROM {prices} WHERE date BETWEEN DATE '{START}' AND DATE '{END}' GROUP BY 1, 2),
{m} AS (
  SELECT b.ticker, b.month, b.n_days,
         CASE WHEN b.n_days >= 5 AND b.month < DATE '{GRID_END}'
              THEN (b.last_price / coalesce(p.last_price, b.first_price) - 1) * 100 END AS ret
  FROM {b} b LEFT JOIN {b} p ON p.ticker = b.ticker AND p.month = b.month - INTERVAL 1 MONTH),
{prefix}spans AS (
  SELECT ticker, min(first_day) AS data_start, max(last_day) AS data_end,
         min(month) AS first_month, max(month) AS last_month FROM {b} GROUP BY 1)"""


MONTHLY = monthly_rows()
PANEL_MONTHLY = monthly_rows("panel", "p")
GRID = f"""grid AS (
  SELECT CAST(g AS DATE) AS month
  FROM generate_series(TIMESTAMP '{GRID_START}', TIMESTAMP '{GRID_END}', INTERVAL 1 MONTH) t(g))"""


def lookback_rows(lookbacks) -> str:
    return "lookbacks AS (SELECT * FROM (VALUES " + ", ".join(f"({n})" for n in lookbacks) + ") v(lookback))"


FORMATIONS = f"""formations AS (
  SELECT lookback, month AS formation FROM grid, lookbacks
  WHERE month >= DATE '{GRID_START}' + to_months(lookback) AND month < DATE '{GRID_END}')"""


def history(min_coverage: float) -> str:
    """VOL3 and JOIN3 for all formations; every ticker with enough history appears."""
    return f"""history AS (
  SELECT f.lookback, f.formation, s.ticker, CAST(count(m.ret) AS INTEGER) AS n_obs,
         CASE WHEN count(m.ret) >= ceil(f.lookback * {min_coverage}::DOUBLE)
              THEN round(stddev_samp(m.ret), 9) END AS vol
  FROM formations f
  JOIN spans s ON s.data_start <= f.formation - to_months(f.lookback) AND s.data_end >= f.formation
  LEFT JOIN monthly m ON m.ticker = s.ticker
       AND m.month BETWEEN f.formation - to_months(f.lookback) AND f.formation
  GROUP BY f.lookback, f.formation, s.ticker),
signals AS (
  SELECT h.*, m.ret AS hold_ret FROM history h
  LEFT JOIN monthly m ON m.ticker = h.ticker AND m.month = h.formation + INTERVAL 1 MONTH)"""


ELIGIBLE = """current_snapshot AS (
  SELECT f.formation, max(s.date) AS snapshot_date
  FROM (SELECT DISTINCT formation FROM formations) f
  JOIN (SELECT DISTINCT date FROM membership) s ON s.date <= f.formation GROUP BY 1),
eligible AS (
  SELECT s.* FROM signals s JOIN current_snapshot a USING (formation)
  JOIN membership m ON m.date = a.snapshot_date AND m.symbol = s.ticker)"""
ALL_ELIGIBLE = "eligible AS (SELECT * FROM signals)"


def outcomes(min_coverage: float, min_per_quintile: int) -> str:
    """PF3 from eligible signals to one row per holding month."""
    pick = ", ".join(
        f"max(ret) FILTER (WHERE q = {i} AND covered) AS P{i}" for i in range(1, 6)
    )
    return f"""sizes AS (
  SELECT lookback, formation, count(*) AS n_eligible, count(vol) AS n_vol FROM eligible GROUP BY 1, 2),
placed AS (
  SELECT e.*, z.n_vol AS cnt, row_number() OVER (PARTITION BY e.lookback, e.formation ORDER BY vol, ticker) AS rn
  FROM eligible e JOIN sizes z USING (lookback, formation)
  WHERE vol IS NOT NULL AND z.n_eligible >= 5 * {min_per_quintile} AND z.n_vol >= 5 * {min_per_quintile}),
sorted AS (SELECT *, (rn - 1) // (cnt // 5) + 1 AS q FROM placed),
means AS (
  SELECT lookback, formation, q, avg(hold_ret) AS ret,
         count(hold_ret) >= ceil(count(*) * {min_coverage}::DOUBLE) AS covered
  FROM sorted WHERE q <= 5 GROUP BY 1, 2, 3),
formed AS (SELECT lookback, formation, {pick} FROM means GROUP BY 1, 2),
outcomes AS (
  SELECT f.lookback, CAST(f.formation + INTERVAL 1 MONTH AS DATE) AS date,
         coalesce(n_eligible, 0) AS n_eligible, coalesce(n_vol, 0) AS n_vol,
         CASE WHEN coalesce(n_eligible, 0) < 5 * {min_per_quintile} THEN 'few_eligible'
              WHEN coalesce(n_vol, 0) < 5 * {min_per_quintile} THEN 'few_volatilities'
              WHEN P1 IS NULL OR P2 IS NULL OR P3 IS NULL OR P4 IS NULL OR P5 IS NULL THEN 'low_coverage'
              ELSE 'processed' END AS outcome,
         P1, P2, P3, P4, P5, P1 - P5 AS LowMinusHigh
  FROM formations f LEFT JOIN sizes USING (lookback, formation) LEFT JOIN formed USING (lookback, formation)),
wide AS (SELECT lookback, date, P1, P2, P3, P4, P5, LowMinusHigh FROM outcomes WHERE outcome = 'processed')"""


LONG = "long AS (" + " UNION ALL ".join(
    f"SELECT lookback, '{p}' AS portfolio, date, {p} AS ret FROM wide" for p in PORTFOLIOS
) + ")"


def portfolios(lookbacks=(12,)) -> list[str]:
    return [
        CHARACTERISTICS, MEMBERSHIP, price_rows("prices", "daily"), MONTHLY, GRID,
        lookback_rows(lookbacks), FORMATIONS, history(0.6), ELIGIBLE, outcomes(0.6, 1), LONG,
    ]


def spread(flag: str) -> str:
    return f"avg(CASE WHEN {flag} THEN ret END) - avg(CASE WHEN NOT ({flag}) THEN ret END)"


D = "CAST({} AS DOUBLE)".format
RF = "max(CAST(all_tax AS DOUBLE) / all_n) / 12"
FACTOR_ROWS = f"""factors AS (
  SELECT c.month AS date, avg(ret) - {RF} AS MKT_RF,
         {spread(f"{D('cents')} < {D('all_cents')} / tickers")} AS SMB,
         {spread(f"{D('disc')} / n > {D('all_disc')} / all_n")} AS HML,
         {spread(f"{D('qty')} / n > {D('all_qty')} / all_n")} AS RMW,
         {spread(f"{D('tax')} / n < {D('all_tax')} / all_n")} AS CMA,
         {RF} AS RF
  FROM chars c JOIN monthly m ON m.ticker = c.ticker AND m.month = c.month GROUP BY 1)"""
FACTORS_ONLY = [CHARACTERISTICS, price_rows("prices", "daily"), MONTHLY, FACTOR_ROWS]
COMPLETE = "complete AS (SELECT * FROM factors WHERE " + " AND ".join(
    f"{c} IS NOT NULL" for c in FACTORS + ["RF"]
) + ")"


# ---- probabilities --------------------------------------------------------

def incomplete_beta(a: str, b: str, x: str) -> str:
    """Regularised incomplete beta by its power series, on the side that converges."""

    def series(a: str, b: str, x: str) -> str:
        terms = (f"list_sum(list_transform(range(0, 400), lambda i: exp("
                 f"lgamma({a} + {b} + i) - lgamma({a} + {b}) + lgamma({a} + 1) - lgamma({a} + 1 + i)"
                 f" + i * ln({x}))))")
        return (f"exp({a} * ln({x}) + {b} * ln(1 - {x}) - lgamma({a}) - lgamma({b})"
                f" + lgamma({a} + {b})) / ({a}) * {terms}")

    return (f"CASE WHEN {x} <= 0 THEN 0.0 WHEN {x} >= 1 THEN 1.0 WHEN {x} <= 0.5 THEN {series(a, b, x)}"
            f" ELSE 1 - {series(b, a, f'(1 - {x})')} END")


def t_pvalue(t: str, df: str) -> str:
    return incomplete_beta(f"({df} / 2.0::DOUBLE)", "0.5::DOUBLE", f"({df} / ({df} + ({t}) * ({t})))")


def f_pvalue(f: str, df1: int, df2: str) -> str:
    return incomplete_beta(
        f"({df2} / 2.0::DOUBLE)", f"({df1} / 2.0::DOUBLE)", f"({df2} / ({df2} + {df1} * ({f})))"
    )


# ---- regressions ----------------------------------------------------------

def design(factors: list[str], aligned: str, group: str) -> str:
    """Complete rows in decimals; column c0 is the intercept."""
    xs = ", ".join(f"{n} / 100 AS c{i}" for i, n in enumerate(factors, start=1))
    keep = " AND ".join(f"{n} IS NOT NULL" for n in ["ret", "RF", *factors])
    return f"""design AS (
  SELECT {group} AS grp, date, (ret - RF) / 100 AS y, (ret - RF) / 100 AS y0, 1.0::DOUBLE AS c0, {xs}
  FROM {aligned} WHERE {keep})"""


def gram_schmidt(k: int) -> str:
    """Sweep c0..ck in turn out of the later columns and of y, within each group."""
    parts, last = [], "design"
    for i in range(k + 1):
        later = range(i + 1, k + 1)
        norms = [f"sum(c{i} * c{i}) OVER g AS d{i}", f"sum(c{i} * y) OVER g AS ny{i}"]
        norms += [f"sum(c{i} * c{j}) OVER g AS n{i}_{j}" for j in later]
        swaps = [f"y - c{i} * ny{i} / d{i} AS y"]
        swaps += [f"c{j} - c{i} * n{i}_{j} / d{i} AS c{j}" for j in later]
        parts.append(f"m{i} AS (SELECT *, {', '.join(norms)} FROM {last} WINDOW g AS (PARTITION BY grp))")
        parts.append(f"u{i} AS (SELECT * REPLACE ({', '.join(swaps)}) FROM m{i})")
        last = f"u{i}"
    # r_ij scaled, b_i = ny_i / d_i; then back substitution and the inverse of R.
    firsts = [f"any_value(d{i}) AS d{i}, any_value(ny{i} / d{i}) AS b{i}" for i in range(k + 1)]
    firsts += [f"any_value(n{i}_{j} / d{i}) AS r{i}_{j}" for i in range(k + 1) for j in range(i + 1, k + 1)]
    parts.append(f"""small AS (
  SELECT grp, count(*) AS n_obs, min(date) AS period_start, max(date) AS period_end,
         sum(y * y) AS rss, var_samp(y0) * (count(*) - 1) AS tss, {', '.join(firsts)}
  FROM {last} GROUP BY grp HAVING count(*) >= 12)""")
    solved = "small"
    for i in range(k, -1, -1):
        terms = "".join(f" - r{i}_{j} * beta{j}" for j in range(i + 1, k + 1))
        parts.append(f"back{i} AS (SELECT *, b{i}{terms} AS beta{i} FROM {solved})")
        solved = f"back{i}"
    for i in range(k + 1):
        for j in range(i + 1, k + 1):
            terms = " ".join(
                f"- {'r%d_%d' % (m, j) if m == i else 's%d_%d * r%d_%d' % (i, m, m, j)}"
                for m in range(i, j)
            )
            parts.append(f"inv{i}_{j} AS (SELECT *, {terms} AS s{i}_{j} FROM {solved})")
            solved = f"inv{i}_{j}"
    variances = [
        f"(1 / d{i}" + "".join(f" + s{i}_{j} * s{i}_{j} / d{j}" for j in range(i + 1, k + 1))
        + f") AS v{i}" for i in range(k + 1)
    ]
    parts.append(f"fit AS (SELECT *, {', '.join(variances)}, n_obs - {k + 1} AS df FROM {solved})")
    return ",\n".join(parts)


def newey_west(k: int, lags: int, extra: str = "") -> str:
    """Robust variance of each coefficient from its influence series a = (row of inverse) x e."""
    rows = []
    for i in range(k + 1):
        parts = [f"u.c{i} / f.d{i}"] + [f"f.s{i}_{j} * u.c{j} / f.d{j}" for j in range(i + 1, k + 1)]
        rows.append(f"({' + '.join(parts)}) * u.y AS a{i}")
    sums = []
    for i in range(k + 1):
        terms = [f"sum(a.a{i} * a.a{i})"]
        for lag in range(1, lags + 1):
            weight = 1 - lag / (lags + 1)
            terms.append(f"2 * {weight}::DOUBLE * sum(a.a{i} * coalesce(l{lag}.a{i}, 0))")
        sums.append(f"({' + '.join(terms)}){extra} AS w{i}")
    joins = " ".join(
        f"LEFT JOIN influence l{lag} ON l{lag}.grp = a.grp AND l{lag}.pos = a.pos - {lag}"
        for lag in range(1, lags + 1)
    )
    return f"""influence AS (
  SELECT u.grp, row_number() OVER (PARTITION BY u.grp ORDER BY u.date) AS pos, {', '.join(rows)}
  FROM u{k} u JOIN fit f USING (grp)),
robust AS (SELECT a.grp, {', '.join(sums)} FROM influence a {joins} GROUP BY a.grp)"""


def flat_fit(model: str, group: str, robust: bool = False) -> str:
    """Final select of one model: alpha, fit and per-factor beta, t and p."""
    def t(i):
        return f"(beta{i} / sqrt(w{i}))" if robust else f"(beta{i} / sqrt(v{i} * rss / df))"

    cells = []
    for i, name in enumerate(MODELS[model], start=1):
        cells += [f"{r(f'beta{i}')} AS b_{name}", f"{r(t(i))} AS t_{name}",
                  f"{r(t_pvalue(t(i), 'df'))} AS p_{name}"]
    source = "fit JOIN robust USING (grp)" if robust else "fit"
    return f"""SELECT grp AS {group}, {r('beta0 * 1200')} AS alpha, {r(t(0))} AS alpha_tstat,
  {r(t_pvalue(t(0), 'df'))} AS alpha_pvalue, {r('1 - rss / tss')} AS r2,
  {r('1 - (rss / df) / (tss / (n_obs - 1))')} AS adj_r2, n_obs, period_start, period_end,
  {', '.join(cells)} FROM {source}"""


BY_DATE = "aligned AS (SELECT l.*, f.* EXCLUDE (date) FROM long l JOIN factors f USING (date))"
BY_POSITION = """aligned AS (
  SELECT l.portfolio, l.date, l.ret, f.* EXCLUDE (date, pos)
  FROM (SELECT *, row_number() OVER (PARTITION BY portfolio ORDER BY date) AS pos FROM long) l
  JOIN (SELECT *, row_number() OVER (ORDER BY date) AS pos FROM complete) f USING (pos))"""


def aligned_model(model: str, robust: bool = False, extra: str = "") -> str:
    k = len(MODELS[model])
    parts = [*portfolios(), FACTOR_ROWS, BY_DATE, design(MODELS[model], "aligned", "portfolio"), gram_schmidt(k)]
    if robust:
        parts.append(newey_west(k, 3, extra))
    return with_(*parts, final=flat_fit(model, "portfolio", robust))


def positional_model(model: str) -> str:
    return with_(
        *portfolios(), FACTOR_ROWS, COMPLETE, BY_POSITION,
        design(MODELS[model], "aligned", "portfolio"), gram_schmidt(len(MODELS[model])),
        final=flat_fit(model, "portfolio"),
    )


def fit_block(model: str, tag: str, aligned: str = "aligned", group: str = "portfolio") -> str:
    """The fit of one model under table names of its own, reduced to its main figures."""
    k = len(MODELS[model])
    inner = with_(design(MODELS[model], aligned, group), gram_schmidt(k),
                  final=f"""SELECT grp, '{model}' AS model, {k} AS k, n_obs, beta0 * 1200 AS alpha,
  beta0 / sqrt(v0 * rss / df) AS alpha_tstat, {t_pvalue("(beta0 / sqrt(v0 * rss / df))", "df")} AS alpha_pvalue,
  1 - rss / tss AS r2, 1 - (rss / df) / (tss / (n_obs - 1)) AS adj_r2 FROM fit""")
    return f"{tag} AS ({inner})"


def residual_block(model: str) -> str:
    k = len(MODELS[model])
    inner = with_(design(MODELS[model], "aligned", "portfolio"), gram_schmidt(k),
                  final=f"SELECT u.grp AS portfolio, u.date, u.y * 100 AS resid FROM u{k} u JOIN fit USING (grp)")
    return f"resid AS ({inner})"


def verdict_case(long_form: bool, thesis: str = "the risk explanation") -> str:
    tail = " adjustment" if long_form else ""
    if long_form:
        texts = {
            "CAPM": (f"SUPPORTS {thesis}: No significant alpha after CAPM adjustment",
                     f"WEAK EVIDENCE against {thesis}: Significant alpha remains after CAPM"),
            "FF3": (f"STRONGLY SUPPORTS {thesis}: No significant alpha after FF3{tail}",
                    f"CONTRADICTS {thesis}: Significant alpha remains after FF3{tail}"),
            "FF5": (f"VERY STRONGLY SUPPORTS {thesis}: No significant alpha after FF5{tail}",
                    f"STRONGLY CONTRADICTS {thesis}: Significant alpha remains after FF5{tail}"),
        }
    else:
        texts = {
            "CAPM": (f"SUPPORTS {thesis}: No significant alpha after CAPM",
                     f"WEAK EVIDENCE against {thesis}: Alpha after CAPM"),
            "FF3": (f"STRONGLY SUPPORTS {thesis}: No alpha after FF3",
                    f"CONTRADICTS {thesis}: Alpha after FF3"),
            "FF5": (f"VERY STRONGLY SUPPORTS {thesis}: No alpha after FF5",
                    f"STRONGLY CONTRADICTS {thesis}: Alpha after FF5"),
        }
    whens = " ".join(
        f"WHEN best_model = '{m}' THEN CASE WHEN best_pvalue > 0.05 THEN '{yes}' ELSE '{no}' END"
        for m, (yes, no) in texts.items()
    )
    return f"CASE {whens} END"


BEST = """fits AS (SELECT * FROM f1 UNION ALL SELECT * FROM f3 UNION ALL SELECT * FROM f5),
best AS (
  SELECT grp, model AS best_model, alpha AS best_alpha, alpha_pvalue AS best_pvalue FROM fits
  QUALIFY row_number() OVER (PARTITION BY grp ORDER BY r2 DESC, k) = 1)"""


def alpha_sql(aligned: str, long_form: bool, views: list[str] | None = None) -> str:
    described = "long" if long_form else "aligned"
    cells = ", ".join(
        f"{r(f'{t}.{c}')} AS {m}_{c}" for m, t in (("capm", "f1"), ("ff3", "f3"), ("ff5", "f5"))
        for c in ("alpha", "alpha_pvalue", "r2")
    )
    return with_(
        *(views or portfolios()), FACTOR_ROWS, COMPLETE, aligned,
        fit_block("CAPM", "f1"), fit_block("FF3", "f3"), fit_block("FF5", "f5"), BEST,
        f"""sharpe AS (
  SELECT portfolio AS grp, count(*) AS n_obs, avg(ret - RF) / stddev_samp(ret - RF) * sqrt(12) AS raw_sharpe
  FROM aligned WHERE ret IS NOT NULL AND RF IS NOT NULL GROUP BY 1 HAVING count(*) >= 12),
raw AS (
  SELECT portfolio AS grp, any_value(n_obs) AS n_obs, any_value(raw_sharpe) AS raw_sharpe,
         avg(ret) * 12 AS raw_return, stddev_samp(ret) * sqrt(12) AS raw_volatility
  FROM {described} JOIN sharpe ON grp = portfolio WHERE ret IS NOT NULL GROUP BY 1)""",
        final=f"""SELECT raw.grp AS portfolio, raw.n_obs, {rounds('raw_return', 'raw_volatility', 'raw_sharpe')},
  {cells}, best_model, {verdict_case(long_form)} AS verdict, best_pvalue > 0.05 AS supports
  FROM raw JOIN best USING (grp) LEFT JOIN f1 USING (grp) LEFT JOIN f3 USING (grp) LEFT JOIN f5 USING (grp)""",
    )


def quadratic_form(tag: str, source: str, columns: list[str], values: str) -> str:
    """v' S^-1 v for the sample covariance S of the columns: sweep the columns, carry v along.

    ``values`` selects the one row of v0..vn.
    """
    n = len(columns)
    cells = ", ".join(f"{c} AS q{i}" for i, c in enumerate(columns))
    parts = [f"{tag}_0 AS (SELECT {cells}, v.* FROM {source}, ({values}) v)"]
    last = f"{tag}_0"
    for i in range(n):
        later = range(i + 1, n)
        norms = [f"sum(q{i} * q{i}) OVER () AS d{i}"] + [f"sum(q{i} * q{j}) OVER () AS n{i}_{j}" for j in later]
        parts.append(f"{tag}_m{i} AS (SELECT *, {', '.join(norms)} FROM {last})")
        if i + 1 < n:
            swaps = [f"q{j} - q{i} * n{i}_{j} / d{i} AS q{j}" for j in later]
            swaps += [f"v{j} - v{i} * n{i}_{j} / d{i} AS v{j}" for j in later]
            parts.append(f"{tag}_u{i} AS (SELECT * REPLACE ({', '.join(swaps)}) FROM {tag}_m{i})")
            last = f"{tag}_u{i}"
        else:
            last = f"{tag}_m{i}"
    total = " + ".join(f"v{i} * v{i} / d{i}" for i in range(n))
    parts.append(f"{tag} AS (SELECT (count(*) - 1) * any_value({total}) AS form, count(*) AS months FROM {last})")
    return ",\n".join(parts)


def critical(df1: int, source: str, tag: str = "crit") -> str:
    """The value that F exceeds with 5 %, halving from [0, 1000]; one for each df2 of the source."""
    return f"""{tag} AS (
  WITH RECURSIVE halved(df2, step, low, high) AS (
    SELECT DISTINCT df2, 0, 0.0::DOUBLE, 1000.0::DOUBLE FROM {source} WHERE df2 > 0
    UNION ALL
    SELECT df2, step + 1, CASE WHEN tail > 0.05 THEN middle ELSE low END, CASE WHEN tail > 0.05 THEN high ELSE middle END
    FROM (SELECT *, {f_pvalue('middle', df1, 'df2')} AS tail FROM (SELECT *, (low + high) / 2 AS middle FROM halved WHERE step < 56)))
  SELECT df2, (low + high) / 2 AS critical_value FROM halved WHERE step = 56)"""


def grs_sql(model: str, names: list[str], full: bool = True, views: list[str] | None = None, final: str | None = None) -> str:
    names_sql = ", ".join(f"'{p}'" for p in names)
    fs = MODELS[model]
    k, n = len(fs), len(names)
    side = ", ".join(f"max(resid / 100) FILTER (WHERE portfolio = '{p}') AS e{i}" for i, p in enumerate(names))
    alphas = ", ".join(f"max(alpha / 1200) FILTER (WHERE grp = '{p}') AS v{i}" for i, p in enumerate(names))
    means = ", ".join(f"avg({c} / 100) AS v{i}" for i, c in enumerate(fs))
    centred = ", ".join(f"{c} / 100 - avg({c} / 100) OVER () AS g{i}" for i, c in enumerate(fs))
    stat = "term1 * term2 * term3"
    significant = f"({f_pvalue('f_statistic', n, 'df2')}) < 0.05"
    return with_(
        *(views or portfolios()), FACTOR_ROWS, BY_DATE, fit_block(model, "f"), residual_block(model),
        f"""pairs AS (SELECT date, {side} FROM resid WHERE portfolio IN ({names_sql}) GROUP BY date),
used AS (SELECT f.* FROM factors f JOIN pairs USING (date)),
moves AS (SELECT {centred} FROM used)""",
        quadratic_form("qe", "pairs", [f"e{i}" for i in range(n)], f"SELECT {alphas} FROM f"),
        quadratic_form("qf", "moves", [f"g{i}" for i in range(k)], f"SELECT {means} FROM used"),
        f"""terms AS (
  SELECT 'ok' AS status, {n} AS n_portfolios, {k} AS n_factors, qe.months AS n_obs,
         qe.months - {n} - {k} AS df2, CAST(qe.months - {n} - {k} AS DOUBLE) / {n} AS term1,
         {"1 / (1 + qf.form)" if full else "1.0::DOUBLE"} AS term2, qe.form AS term3 FROM qe, qf),
stat AS (SELECT *, {stat} AS f_statistic FROM terms)""",
        critical(n, "stat"),
        final=final or f"""SELECT status, n_portfolios, n_factors, n_obs, df2, {rounds('f_statistic', 'critical_value', 'term1', 'term2', 'term3')},
  {r(f_pvalue('f_statistic', n, 'df2'))} AS p_value, {significant} AS is_significant,
  CASE WHEN {significant} THEN 'REJECT H0: at least one alpha differs from zero'
       ELSE 'FAIL TO REJECT H0: all alphas are statistically zero' END AS conclusion FROM stat JOIN crit USING (df2)""",
    )


def grs_fifty(groups: int = 50) -> str:
    """The test over many portfolios: covariances by pairs, then elimination on lists, a step for each portfolio."""
    return with_(
        *FACTORS_ONLY, f"""sold_parts AS (
  SELECT l_linenumber % 2 AS side, 'G' || (l_partkey % {groups}) AS portfolio, CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
         100::DOUBLE + CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) - sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / count(*) AS price
  FROM lineitem GROUP BY 1, 2, 3),
long AS (SELECT side, portfolio, date, (price / lag(price) OVER (PARTITION BY side, portfolio ORDER BY date) - 1) * 100 AS ret FROM sold_parts)""",
        BY_DATE, design(["MKT_RF"], "aligned", "side || ' ' || portfolio"), gram_schmidt(1), f"""e AS (
  SELECT CAST(split_part(u.grp, ' ', 1) AS INTEGER) AS side, CAST(substr(split_part(u.grp, ' ', 2), 2) AS INTEGER) AS g, u.date, u.y AS e,
         count(*) OVER (PARTITION BY split_part(u.grp, ' ', 1), u.date) AS held
  FROM u1 u JOIN fit USING (grp)),
whole AS (SELECT * FROM e WHERE held = {groups}),
months AS (SELECT side, count(DISTINCT date) AS n_obs FROM whole GROUP BY 1),
alphas AS (SELECT CAST(split_part(grp, ' ', 1) AS INTEGER) AS side, CAST(substr(split_part(grp, ' ', 2), 2) AS INTEGER) AS g, beta0 AS alpha FROM fit),
covs AS (SELECT a.side, a.g AS i, b.g AS j, covar_samp(a.e, b.e) AS c FROM whole a JOIN whole b ON a.side = b.side AND a.date = b.date GROUP BY 1, 2, 3),
lines AS (SELECT c.side, c.i, list_append(list(c ORDER BY j), any_value(alpha)) AS line FROM covs c JOIN alphas a ON a.side = c.side AND a.g = c.i GROUP BY 1, 2),
matrices AS (SELECT side, list(line ORDER BY i) AS m FROM lines GROUP BY 1),
forms AS (
  WITH RECURSIVE swept(side, k, m, form) AS (
    SELECT side, 1, m, 0.0::DOUBLE FROM matrices
    UNION ALL
    SELECT side, k + 1, list_transform(m, lambda r, i: CASE WHEN i <= k THEN r ELSE list_transform(r, lambda x, j: x - r[k] / m[k][k] * m[k][j]) END),
           form + m[k][{groups + 1}] * m[k][{groups + 1}] / m[k][k]
    FROM swept WHERE k <= {groups})
  SELECT side, form FROM swept WHERE k = {groups + 1}),
stat AS (SELECT side, n_obs, n_obs - {groups} - 1 AS df2, form * (n_obs - {groups} - 1) / {groups} AS f_statistic FROM forms JOIN months USING (side))""",
        critical(groups, "stat"),
        final=f"""SELECT side, 'ok' AS status, {groups} AS n_portfolios, 1 AS n_factors, n_obs, df2, {rounds('f_statistic', 'critical_value', digits=5)},
  {r(f_pvalue('f_statistic', groups, 'df2'), 5)} AS p_value, f_statistic > critical_value AS is_significant FROM stat JOIN crit USING (df2)""",
    )


# ---- performance ----------------------------------------------------------

def performance_rows(source: str, keys: str, tag: str = "perf") -> str:
    return f"""{tag}_grown AS (
  SELECT *, product(1 + ret / 100) OVER w AS growth, ret - avg(ret) OVER (PARTITION BY {keys}) AS dev
  FROM {source} WINDOW w AS (PARTITION BY {keys} ORDER BY date ROWS UNBOUNDED PRECEDING)),
{tag}_peaked AS (
  SELECT *, growth / max(growth) OVER (PARTITION BY {keys} ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd,
         stddev_samp(ret) OVER (PARTITION BY {keys}) AS sd FROM {tag}_grown),
{tag}_base AS (
  SELECT {keys}, avg(ret) * 12 AS annual_return, stddev_samp(ret) * sqrt(12) AS annual_vol,
         stddev_samp(CASE WHEN dev < 0 THEN dev END) * sqrt(12) AS below, min(dd) AS max_drawdown,
         CASE WHEN count(*) > 3 THEN avg(pow(dev / nullif(sd, 0), 3)) END AS skewness,
         CASE WHEN count(*) > 3 THEN avg(pow(dev / nullif(sd, 0), 4)) - 3 END AS kurtosis,
         count(*) AS n_months
  FROM {tag}_peaked GROUP BY ALL),
{tag} AS (
  SELECT {keys}, annual_return, annual_vol, annual_return / nullif(annual_vol, 0) AS sharpe_ratio,
         annual_return / nullif(below, 0) AS sortino_ratio, max_drawdown,
         annual_return / nullif(abs(max_drawdown), 0) AS calmar_ratio, skewness, kurtosis, n_months
  FROM {tag}_base)"""


MEASURES = ["annual_return", "annual_vol", "sharpe_ratio", "sortino_ratio", "max_drawdown",
            "calmar_ratio", "skewness", "kurtosis"]


def rolling(keys: str, where: str, first_row: int) -> str:
    return f"""rolling AS (
  SELECT {keys}, date, avg(ret) OVER w * 12 / nullif(stddev_samp(ret) OVER w * sqrt(12), 0) AS rolling_sharpe,
         stddev_samp(ret) OVER w * sqrt(12) AS rolling_vol
  FROM long WHERE {where}
  WINDOW w AS (PARTITION BY {keys} ORDER BY date ROWS 11 PRECEDING)
  QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY date) >= {first_row}
     AND count(*) OVER (PARTITION BY {keys}) >= 36)"""


# ---- symbols --------------------------------------------------------------

def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def case_map(column: str, pairs: dict[str, str]) -> str:
    whens = " ".join(f"WHEN {literal(a)} THEN {literal(b)}" for a, b in pairs.items())
    return f"CASE {column} {whens} END"


LISTINGS = f"""raw_listings AS (
  SELECT c_custkey AS listing, c_name,
         list_extract([{', '.join(map(literal, RAW_SYMBOLS))}], c_nationkey + 1)
         || CASE c_mktsegment WHEN 'BUILDING' THEN ' CORP' WHEN 'MACHINERY' THEN ' LTD.' ELSE '' END AS by_nation
  FROM customer),
listings AS (
  SELECT listing, by_nation AS raw_symbol FROM raw_listings
  UNION ALL SELECT listing, c_name FROM raw_listings),
normal AS (SELECT listing, raw_symbol, trim(upper(raw_symbol)) AS sym FROM listings)"""
FLAT_MAPPINGS = {old: new for pairs in S.MAPPINGS.values() for old, new in pairs.items()}


def in_list(column: str, values) -> str:
    return f"{column} IN ({', '.join(map(literal, values))})"


def resolved(check_extinct: bool = True, mappings: dict[str, str] = FLAT_MAPPINGS) -> str:
    gone = in_list("sym", S.EXTINCT) if check_extinct else "false"
    repl, target = case_map("sym", S.REPLACEMENTS), case_map("sym", mappings)
    return f"""tagged AS (SELECT *, {gone} AS gone, {repl} AS repl, {target} AS target FROM normal),
resolved AS (
  SELECT listing, raw_symbol, sym AS original,
    CASE WHEN gone AND repl IS NOT NULL THEN 'replaced' WHEN gone THEN 'extinct'
         WHEN target IS NOT NULL THEN 'mapped' WHEN contains(sym, '.') THEN 'format_corrected'
         ELSE 'original' END AS status,
    CASE WHEN gone THEN coalesce(repl, sym) WHEN target IS NOT NULL THEN target
         ELSE replace(sym, '.', '-') END AS symbol
  FROM tagged)"""


REASON = case_map("status", {
    "replaced": "extinct_with_replacement", "extinct": "extinct_no_replacement",
    "mapped": "symbol_change", "format_corrected": "dot_to_hyphen", "original": "no_changes_needed",
})

CLEAN = f"""stripped AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(sym,
    '\\.([AB])$', '-\\1'), '\\s+(INC|CORP|CO|LTD|LLC)\\.?$', ''), '\\s+CLASS\\s+[AB]$', ''),
    '\\.', '-', 'g'), '[^A-Z0-9\\-]', '', 'g') AS text FROM normal)"""
CLEANED = f"""coalesce({case_map('sym', S.CLEAN_RENAMES)},
  CASE WHEN length(text) > 8 THEN left(text, 5) ELSE text END)"""

DIMENSIONS = """ren AS (SELECT 'S' || s_suppkey AS ticker, 'S' || (s_suppkey + s_nationkey) AS target FROM supplier WHERE s_acctbal > 5000),
gone AS (SELECT 'S' || s_suppkey AS ticker, CASE WHEN s_nationkey < 12 THEN 'S' || (s_suppkey + s_nationkey) END AS repl
  FROM supplier WHERE s_acctbal < 0),
wanted AS (SELECT 'S' || s_suppkey AS ticker FROM supplier),
options AS (
  SELECT w.ticker, 1 AS priority,
         CASE WHEN g.ticker IS NOT NULL THEN coalesce(g.repl, w.ticker) ELSE coalesce(m.target, w.ticker) END AS symbol
  FROM wanted w LEFT JOIN gone g USING (ticker) LEFT JOIN ren m USING (ticker)
  UNION ALL
  SELECT w.ticker, 2, w.ticker FROM wanted w JOIN ren m USING (ticker) LEFT JOIN gone g USING (ticker)
  WHERE g.ticker IS NULL AND m.target <> w.ticker)"""
CHOSEN = f"""stored AS (
  SELECT ticker AS symbol, min(date) AS data_start, max(date) AS data_end, count(*) AS n_rows
  FROM prices WHERE date BETWEEN {MID} GROUP BY 1),
chosen AS (
  SELECT o.ticker, o.symbol AS source_symbol, s.data_start, s.data_end, s.n_rows
  FROM options o JOIN stored s USING (symbol)
  QUALIFY row_number() OVER (PARTITION BY o.ticker ORDER BY priority) = 1)"""
REQUESTS = f"""requests AS (
  SELECT 'S' || c_custkey AS ticker, CAST(DATE '{START}' + to_months(c_nationkey) AS DATE) AS start,
         CAST(DATE '{END}' - to_months(c_nationkey) AS DATE) AS "end" FROM customer),
covered AS (
  SELECT q.*, v.data_start, v.data_end, v.n_rows,
         CASE WHEN v.ticker IS NULL THEN 'missing'
              WHEN v.data_start <= q.start AND v.data_end >= q."end" THEN 'covered' ELSE 'partial' END AS status
  FROM requests q LEFT JOIN (
    SELECT ticker, min(date) AS data_start, max(date) AS data_end, count(*) AS n_rows FROM prices GROUP BY 1
  ) v USING (ticker))"""

MEMBER_VIEWS = [CHARACTERISTICS, MEMBERSHIP]
PRICE_VIEWS = [CHARACTERISTICS, MEMBERSHIP, price_rows("prices", "daily")]
FORMATION_VIEWS = [GRID, lookback_rows((12,)), FORMATIONS]
ASOF = ELIGIBLE.split(",\neligible")[0]
TRAILING = f"""trailed AS (
  SELECT g.month, s.ticker, CAST(count(m.ret) AS INTEGER) AS n_obs, round(stddev_samp(m.ret), 9) AS vol
  FROM grid g JOIN spans s ON s.first_month < g.month
  JOIN monthly m ON m.ticker = s.ticker AND m.month BETWEEN g.month - INTERVAL 12 MONTH AND g.month - INTERVAL 1 MONTH
  WHERE g.month >= DATE '{GRID_START}' + INTERVAL 12 MONTH GROUP BY 1, 2)"""


def trailing_signals(min_obs: int = 12) -> str:
    return f"""trail AS (
  SELECT t.*, m.ret FROM trailed t LEFT JOIN monthly m USING (ticker, month)
  WHERE n_obs >= {min_obs} * 0.7::DOUBLE)"""


CALENDAR = """calendar AS (SELECT date, row_number() OVER (ORDER BY date) AS cal_idx FROM (SELECT DISTINCT date FROM panel)),
numbered AS (SELECT p.*, c.cal_idx FROM panel p JOIN calendar c USING (date)),
moves AS (
  SELECT a.ticker, a.date, a.cal_idx, (a.price / b.price - 1) * 100 AS ret
  FROM numbered a LEFT JOIN numbered b ON b.ticker = a.ticker AND b.cal_idx = a.cal_idx - 1)"""
DAILY_VOL = """anchors AS (
  SELECT g.month AS formation, (SELECT min(cal_idx) FROM calendar c WHERE c.date >= g.month) AS anchor FROM grid g),
daily_vol AS (
  SELECT formation, ticker, round(stddev_samp(ret) * sqrt(252), 9) AS vol, CAST(count(ret) AS INTEGER) AS n_obs
  FROM anchors JOIN moves ON cal_idx BETWEEN anchor - 252 AND anchor - 1
  WHERE anchor > 252 GROUP BY 1, 2)"""


def basic_quintiles(source: str, min_per_quintile: int) -> str:
    pick = ", ".join(f"avg(ret) FILTER (WHERE q = {i}) AS P{i}" for i in range(1, 6))
    return f"""ordered AS (
  SELECT *, count(*) OVER (PARTITION BY month) AS cnt,
         row_number() OVER (PARTITION BY month ORDER BY vol, ticker) AS rn FROM {source}),
grouped AS (SELECT *, (rn - 1) // (cnt // 5) + 1 AS q FROM ordered WHERE cnt >= 5 * {min_per_quintile}),
basic AS (
  SELECT month AS date, {pick} FROM grouped GROUP BY 1
  HAVING P1 IS NOT NULL AND P2 IS NOT NULL AND P3 IS NOT NULL AND P4 IS NOT NULL AND P5 IS NOT NULL)"""


BASIC_FINAL = f"SELECT date, {rounds(*QUINTILES)}, {r('P1 - P5')} AS {LONG_SHORT} FROM basic"


def extremes(size: int) -> str:
    return f"""ends AS (
  SELECT *, count(*) OVER (PARTITION BY month) AS cnt,
         row_number() OVER (PARTITION BY month ORDER BY vol, ticker) AS rn FROM trail),
sides AS (
  SELECT month, avg(ret) FILTER (WHERE rn <= {size}) AS low, avg(ret) FILTER (WHERE rn > cnt - {size}) AS high
  FROM ends WHERE cnt >= 2 * {size} GROUP BY 1)"""


def extremes_final() -> str:
    both = "low IS NOT NULL AND high IS NOT NULL"
    return f"""SELECT g.month AS date, CASE WHEN {both} THEN {r('low')} END AS LOW,
  CASE WHEN {both} THEN {r('high')} END AS HIGH, {r('low - high')} AS LONG_SHORT
  FROM grid g LEFT JOIN sides USING (month) WHERE g.month >= DATE '{GRID_START}' + INTERVAL 12 MONTH"""


def pti_daily() -> str:
    return with_(
        PANEL, PANEL_MONTHLY, GRID, lookback_rows((12,)), FORMATIONS, CALENDAR, DAILY_VOL,
        """signals AS (
  SELECT f.lookback, f.formation, s.ticker, CASE WHEN v.n_obs >= ceil(252 * 0.6::DOUBLE) THEN v.vol END AS vol, h.ret AS hold_ret
  FROM formations f
  JOIN pspans s ON s.data_start <= f.formation - to_months(f.lookback) AND s.data_end >= f.formation
  LEFT JOIN daily_vol v ON v.formation = f.formation AND v.ticker = s.ticker
  LEFT JOIN pmonthly h ON h.ticker = s.ticker AND h.month = f.formation + INTERVAL 1 MONTH)""",
        ALL_ELIGIBLE, outcomes(0.6, 1),
        final=f"SELECT lookback, date, {rounds(*PORTFOLIOS)} FROM wide",
    )


def strict_outcomes(final: str) -> str:
    return with_(
        CHARACTERISTICS, MEMBERSHIP, price_rows("prices", "daily"), MONTHLY, GRID,
        lookback_rows(LOOKBACKS), FORMATIONS, history(0.7), ELIGIBLE, outcomes(0.7, 5), final=final,
    )


def limited_pti() -> str:
    """PF4: the whole universe of the period."""
    parts = [
        CHARACTERISTICS, MEMBERSHIP, price_rows("all_prices", "daily"),
        f"""universe AS (SELECT DISTINCT symbol FROM membership WHERE date BETWEEN DATE '{START}' AND DATE '{END}'),
prices AS (SELECT * FROM all_prices WHERE ticker IN (SELECT symbol FROM universe))""",
        MONTHLY, GRID, lookback_rows((12,)), FORMATIONS, history(0.6), ELIGIBLE, outcomes(0.6, 1),
    ]
    return with_(*parts, final=f"SELECT lookback, date, {rounds(*PORTFOLIOS)} FROM wide")


def limited_extremes() -> str:
    parts = [
        CHARACTERISTICS, MEMBERSHIP, price_rows("all_prices", "daily"),
        f"""universe AS (SELECT symbol, min(date) AS seen FROM membership WHERE date BETWEEN DATE '{START}' AND DATE '{END}'
  GROUP BY 1),
prices AS (SELECT * FROM all_prices WHERE ticker IN (SELECT symbol FROM universe))""",
        MONTHLY, GRID, TRAILING, trailing_signals(), extremes(20),
    ]
    return with_(*parts, final=extremes_final())


LATE = """late AS (
  SELECT ticker, date, CAST(qty AS DOUBLE) / n AS price FROM daily WHERE ticker IN (SELECT 'S' || s_suppkey FROM supplier WHERE s_acctbal < 0))"""
UPSERTED = f"""SELECT ticker, date, {r('price')} AS price FROM late
  UNION ALL SELECT ticker, date, {r('price')} FROM prices WHERE ticker NOT IN (SELECT ticker FROM late)"""
ASKED = f"'{START} to {END}' AS period, {{lookbacks}} AS lookbacks, 'CAPM,FF3,FF5' AS models"
LOWEST = QUOTES + """,
all_prices AS (SELECT ticker, date, min(price) AS price FROM quotes GROUP BY 1, 2)"""


def study(lookbacks, min_per_quintile: int, prices: str = price_rows("all_prices", "daily")) -> list[str]:
    """PIPE1: the index universe, symbols resolved (all of them stand), prices clipped to the period."""
    return [
        CHARACTERISTICS, MEMBERSHIP, prices,
        f"""prices AS (SELECT * FROM all_prices WHERE ticker IN (
  SELECT symbol FROM membership WHERE date BETWEEN DATE '{START}' AND DATE '{END}'))""",
        MONTHLY, GRID, lookback_rows(lookbacks), FORMATIONS, history(0.6), ELIGIBLE,
        outcomes(0.6, min_per_quintile), LONG,
    ]


ORACLES: dict[str, str] = {
    # constituents and universe
    "constituents_split": with_(RAW, final="""SELECT CAST(date AS DATE) AS date,
  CAST(len(string_split(tickers, ',')) AS INTEGER) AS n_items, string_split(tickers, ',')[1] AS first_item FROM raw"""),
    "constituents_parsed": with_(RAW, final="""SELECT CAST(date AS DATE) AS date, CAST(len(items) AS INTEGER) AS n_tickers,
  array_to_string(items, '|') AS tickers FROM (
  SELECT date, list_filter(list_transform(string_split(replace(tickers, '"', ''), ','), lambda t: trim(t)), lambda t: t <> '') AS items FROM raw)"""),
    "constituent_profile": with_(RAW, final="""SELECT min(CAST(date AS DATE)) AS first_date, max(CAST(date AS DATE)) AS last_date,
  count(*) AS n_snapshots, round_even((SELECT count(*) FROM sold) / CAST(count(*) AS DOUBLE), 1) AS mean_tickers FROM raw"""),
    "universe_raw": with_(RAW, final=f"""SELECT DISTINCT trim(t) AS symbol FROM (
  SELECT unnest(string_split(tickers, ',')) AS t FROM raw WHERE CAST(date AS DATE) BETWEEN {MID})"""),
    "universe_cleaned": with_(RAW, final=f"""SELECT DISTINCT symbol, ends_with(symbol, 'Q') AS looks_extinct FROM (
  SELECT t AS symbol FROM (
    SELECT regexp_replace(upper(name), '[^A-Z0-9-]', '', 'g') AS t FROM sold WHERE CAST(month AS DATE) BETWEEN {MID}))"""),
    "universe_period": with_(*MEMBER_VIEWS, final=f"""SELECT DISTINCT symbol, ends_with(symbol, 'Q') AS looks_extinct
  FROM membership WHERE date BETWEEN {MID}"""),
    "universe_in_order": with_(*MEMBER_VIEWS, final=f"""SELECT symbol, min(date) AS first_seen FROM membership
  WHERE date BETWEEN {MID} GROUP BY 1"""),
    "universe_limited": with_(*MEMBER_VIEWS, final=f"""SELECT DISTINCT symbol FROM membership
  WHERE date BETWEEN DATE '{START}' AND DATE '{END}' ORDER BY symbol LIMIT 25"""),
    "universe_custom": with_(PRICES, final="""SELECT ticker, min(date) AS data_start, max(date) AS data_end, count(*) AS n_rows
  FROM prices WHERE ticker IN (SELECT 'S' || s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY 1"""),
    "snapshot_intervals": with_(*MEMBER_VIEWS, final="""SELECT date AS snapshot_date,
  (SELECT min(date) FROM membership n WHERE n.date > d.date) AS next_date FROM (SELECT DISTINCT date FROM membership) d"""),
    "membership_asof": with_(*PRICE_VIEWS, *FORMATION_VIEWS, ASOF, final="""SELECT a.formation, a.snapshot_date, m.symbol AS ticker
  FROM current_snapshot a JOIN membership m ON m.date = a.snapshot_date WHERE m.symbol IN (SELECT ticker FROM prices)"""),
    "eligible_members": with_(*PRICE_VIEWS, *FORMATION_VIEWS, ASOF,
        "v AS (SELECT ticker, min(date) AS data_start, max(date) AS data_end FROM prices GROUP BY 1)",
        final="""SELECT a.formation, v.ticker, v.data_start, v.data_end
  FROM current_snapshot a JOIN membership m ON m.date = a.snapshot_date JOIN v ON v.ticker = m.symbol
  WHERE v.data_start <= a.formation - INTERVAL 12 MONTH AND v.data_end >= a.formation"""),
    "eligible_without_index": with_(PRICES, *FORMATION_VIEWS,
        "v AS (SELECT ticker, min(date) AS data_start, max(date) AS data_end FROM prices GROUP BY 1)",
        final="""SELECT f.formation, v.ticker, v.data_start, v.data_end FROM formations f
  JOIN v ON v.data_start <= f.formation - INTERVAL 6 MONTH AND v.data_end >= f.formation"""),
    "validity_metadata": with_(QUOTES, """gaps AS (
  SELECT ticker, date, date - lag(date) OVER (PARTITION BY ticker ORDER BY date) AS gap FROM quotes)""",
        final="""SELECT ticker, min(date) AS data_start, max(date) AS data_end, count(*) AS total_observations,
  CAST(max(date) - min(date) AS INTEGER) AS duration_days,
  round_even((max(date) - min(date)) / 365.25::DOUBLE, 2) AS duration_years, CAST(max(gap) AS INTEGER) AS max_gap_days,
  round_even(avg(gap), 1) AS avg_gap_days FROM gaps GROUP BY 1"""),
    "validity_single": with_(PRICES, final="""SELECT ticker, min(date) AS data_start, max(date) AS data_end
  FROM prices WHERE ticker = 'S3' GROUP BY 1"""),
    # price sources
    "price_one_per_day": with_(QUOTES, final=f"""SELECT ticker, date, {r('price', 8)} AS price FROM quotes
  QUALIFY row_number() OVER (PARTITION BY ticker, date ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) = 1"""),
    "coverage_status": with_(PRICES, REQUESTS, final="SELECT * FROM covered"),
    "load_success": with_(PRICES, REQUESTS, final="""SELECT count(*) AS requested, count(*) FILTER (WHERE status <> 'missing') AS obtained,
  count(*) FILTER (WHERE status = 'missing') AS failed,
  round_even(count(*) FILTER (WHERE status <> 'missing') * 100.0::DOUBLE / count(*), 1) AS success_rate FROM covered"""),
    "source_choice": with_(PRICES, DIMENSIONS, CHOSEN, final="SELECT * FROM chosen"),
    "acquired_prices": with_(PRICES, DIMENSIONS, CHOSEN, final=f"""SELECT c.ticker, c.source_symbol, p.date, {r('p.price')} AS price,
  c.data_start, c.data_end FROM chosen c JOIN prices p ON p.ticker = c.source_symbol WHERE p.date BETWEEN {MID}"""),
    "acquired_months": with_(PRICES, DIMENSIONS, CHOSEN.replace(MID, f"DATE '{START}' AND DATE '{END}'"), MONTHLY, final=f"""SELECT c.ticker, c.source_symbol, b.month, b.n_days,
  {rounds('b.first_price', 'b.last_price').replace(' AS b.', ' AS ')}, b.first_day, b.last_day, c.data_start, c.data_end
  FROM chosen c JOIN buckets b ON b.ticker = c.source_symbol"""),
    "price_upsert": with_(PRICES, LATE, final=UPSERTED),
    "price_store_round_trip": with_(PRICES, LATE, final=UPSERTED),
    "price_directories_round_trip": with_(PANEL, final=f"SELECT ticker, date, {r('price')} AS price FROM panel"),
    "factor_store_round_trip": with_(*FACTORS_ONLY, final=f"SELECT date, {rounds(*FACTORS, 'RF')} FROM factors"),
    # symbols
    "symbol_clean": with_(LISTINGS, CLEAN, final=f"SELECT listing, raw_symbol, {CLEANED} AS symbol FROM stripped"),
    "symbol_resolve": with_(LISTINGS, resolved(), final=f"SELECT listing, raw_symbol, symbol, status, {REASON} AS reason, original FROM resolved"),
    "symbol_resolve_without_proxies": with_(LISTINGS, resolved(mappings={
        old: new for kind, pairs in S.MAPPINGS.items() if kind != "proxy" for old, new in pairs.items()
    }), final=f"SELECT listing, raw_symbol, symbol, status, {REASON} AS reason, original FROM resolved"),
    "symbol_resolve_dated": with_(PRICES, f"""dated AS (
  SELECT 'S' || s_suppkey AS ticker, 'S' || (s_suppkey + s_nationkey) AS target, 'renamed' AS kind,
         CAST(DATE '{START}' + to_months(s_nationkey + 12) AS DATE) AS since FROM supplier WHERE s_acctbal > 3000
  UNION ALL
  SELECT 'S' || s_suppkey, 'S' || (s_suppkey + 1), 'proxy', CAST(DATE '{START}' + to_months(s_nationkey + 36) AS DATE)
  FROM supplier WHERE s_acctbal > 3000)""", final="""SELECT p.ticker, coalesce(d.target, p.ticker) AS resolved, d.kind AS mapping_kind,
  count(*) AS n_days, min(p.date) AS first_day, max(p.date) AS last_day
  FROM prices p ASOF LEFT JOIN dated d ON d.ticker = p.ticker AND p.date >= d.since GROUP BY 1, 2, 3"""),
    "symbol_resolve_keep_extinct": with_(LISTINGS, resolved(False), final="SELECT symbol, status, count(*) AS n FROM resolved GROUP BY 1, 2"),
    "resolution_stats": with_(LISTINGS, resolved(), final="""SELECT
  count(*) FILTER (WHERE status = 'original') AS original, count(*) FILTER (WHERE status = 'mapped') AS mapped,
  count(*) FILTER (WHERE status = 'extinct') AS extinct, count(*) FILTER (WHERE status = 'format_corrected') AS format_corrected,
  count(*) FILTER (WHERE status = 'replaced') AS replaced, count(*) AS total,
  count(*) FILTER (WHERE status <> 'extinct') AS resolvable,
  round_even(count(*) FILTER (WHERE status <> 'extinct') * 100.0::DOUBLE / count(*), 1) AS success_rate FROM resolved"""),
    "symbol_extinct": with_(LISTINGS, final=f"SELECT listing, raw_symbol, {in_list('sym', S.EXTINCT)} AS is_extinct FROM normal"),
    "symbol_metadata": with_(LISTINGS, final=f"""SELECT listing, raw_symbol,
  coalesce({case_map('sym', S.METADATA)}, 'unknown') AS metadata_status FROM normal"""),
    "mapping_upsert": with_("base AS (SELECT * FROM (VALUES " + ", ".join(
        f"({literal(o)}, {literal(n)}, {literal(kind)}, -1)" for kind, pairs in S.MAPPINGS.items() for o, n in pairs.items()
    ) + ") v(symbol, target, kind, seq))", """added AS (
  SELECT * FROM base UNION ALL
  SELECT 'FB' || CASE WHEN c_nationkey > 4 THEN CAST(c_nationkey AS VARCHAR) ELSE '' END, upper(c_name), 'renamed', c_custkey FROM customer)""",
        final="""SELECT symbol, target, kind FROM added
  QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY seq DESC, target DESC) = 1"""),
    "extinct_upsert": with_("base AS (SELECT * FROM (VALUES " + ", ".join(
        f"({literal(s)}, {literal(S.REPLACEMENTS[s]) if s in S.REPLACEMENTS else 'NULL'})" for s in S.EXTINCT
    ) + ") v(symbol, replacement))", final="""SELECT symbol, max(replacement) AS replacement FROM (
  SELECT * FROM base UNION ALL SELECT upper(s_name), NULL FROM supplier WHERE s_acctbal < 0) GROUP BY 1"""),
    "mapping_listing": with_(LISTINGS, "entries AS (SELECT * FROM (VALUES " + ", ".join(
        [f"('mapping', {literal(o)}, {literal(n)})" for o, n in FLAT_MAPPINGS.items()]
        + [f"('extinct', {literal(s)}, {literal(S.REPLACEMENTS[s]) if s in S.REPLACEMENTS else 'NULL'})" for s in S.EXTINCT]
    ) + ") v(entry, symbol, target))", final="""SELECT entry, symbol, target, (SELECT count(*) FROM normal WHERE sym = symbol) AS n_listings FROM entries"""),
    # returns and signals
    "month_grid_counts": with_(PRICES, MONTHLY, GRID, final="""SELECT g.month, count(b.ticker) AS n_tickers
  FROM grid g LEFT JOIN buckets b USING (month) GROUP BY 1"""),
    "month_buckets": with_(PRICES, MONTHLY, final=f"""SELECT ticker, month, n_days, {rounds('first_price', 'last_price')},
  first_day, last_day FROM buckets"""),
    "monthly_returns": with_(PRICES, MONTHLY, final=f"SELECT ticker, month, n_days, {r('ret')} AS ret FROM monthly"),
    "monthly_returns_dense": with_(PRICES, MONTHLY, GRID, final=f"""SELECT s.ticker, g.month, {r('m.ret')} AS ret
  FROM spans s JOIN grid g ON g.month BETWEEN s.first_month AND s.last_month LEFT JOIN monthly m ON m.ticker = s.ticker AND m.month = g.month"""),
    "daily_returns": with_(PANEL, CALENDAR, final=f"SELECT ticker, date, CAST(cal_idx AS INTEGER) AS cal_idx, {r('ret')} AS ret FROM moves"),
    "returns_wide": with_(PANEL, PANEL_MONTHLY, GRID, final="SELECT g.month AS date, " + ", ".join(
        f"{r(f'''max(ret) FILTER (WHERE ticker = '{t}')''')} AS \"{t}\"" for t in ["AF", "AO", "NF", "NO", "RF", "RO"]
    ) + " FROM grid g LEFT JOIN pmonthly m ON m.month = g.month GROUP BY 1"),
    "returns_long": with_(PANEL, PANEL_MONTHLY, GRID, final=f"""SELECT g.month, t.ticker, {r('m.ret')} AS ret
  FROM grid g CROSS JOIN (VALUES ('AF'), ('AO'), ('NF'), ('NO'), ('RF'), ('RO')) t(ticker)
  LEFT JOIN pmonthly m ON m.month = g.month AND m.ticker = t.ticker"""),
    "vol_monthly": with_(PRICES, MONTHLY, GRID, TRAILING, final=f"SELECT ticker, month, {r('vol', 9)} AS vol, n_obs FROM trailed WHERE n_obs >= 12 * 0.7::DOUBLE"),
    "vol_monthly_min_obs": with_(PRICES, MONTHLY, GRID, TRAILING, final=f"SELECT ticker, month, {r('vol', 9)} AS vol, n_obs FROM trailed WHERE n_obs >= 8 * 0.7::DOUBLE"),
    "vol_point_in_time": with_(PRICES, MONTHLY, GRID, lookback_rows(LOOKBACKS), FORMATIONS, history(0.6),
        final=f"SELECT lookback, formation, ticker, {r('vol', 9)} AS vol, n_obs, {r('hold_ret', 9)} AS hold_ret FROM signals"),
    "vol_daily": with_(PANEL, GRID, CALENDAR, DAILY_VOL, final=f"SELECT ticker, formation, {r('vol', 9)} AS vol, n_obs FROM daily_vol WHERE n_obs >= 180"),
    # portfolios
    "extreme_portfolios": with_(PRICES, MONTHLY, GRID, TRAILING, trailing_signals(), extremes(4), final=extremes_final()),
    "quintiles_basic": with_(PRICES, MONTHLY, GRID, TRAILING, trailing_signals(), basic_quintiles("trail", 1), final=BASIC_FINAL),
    "quintiles_basic_daily": with_(PANEL, PANEL_MONTHLY, GRID, CALENDAR, DAILY_VOL, """trail AS (
  SELECT v.formation AS month, v.ticker, v.vol, m.ret FROM daily_vol v
  LEFT JOIN pmonthly m ON m.ticker = v.ticker AND m.month = v.formation WHERE v.n_obs >= 180)""", basic_quintiles("trail", 1), final=BASIC_FINAL),
    "quintiles_pti": with_(*portfolios(), final=f"SELECT lookback, date, {rounds(*PORTFOLIOS)} FROM wide"),
    "quintiles_pti_daily": pti_daily(),
    "quintiles_pti_lookbacks": with_(*portfolios(LOOKBACKS), final=f"SELECT lookback, date, portfolio, {r('ret')} AS ret FROM long"),
    "pti_outcomes": strict_outcomes("SELECT lookback, date, outcome, n_eligible, n_vol FROM outcomes"),
    "pti_skip_reasons": strict_outcomes("SELECT lookback, outcome, count(*) AS n_months FROM outcomes GROUP BY 1, 2"),
    "pti_processing_rate": strict_outcomes("""SELECT lookback, count(*) FILTER (WHERE outcome = 'processed') AS processed,
  count(*) FILTER (WHERE outcome <> 'processed') AS skipped,
  round_even(count(*) FILTER (WHERE outcome = 'processed') * 100.0::DOUBLE / count(*), 1) AS success_rate FROM outcomes GROUP BY 1"""),
    "quintile_statistics": with_(*portfolios(), final=f"""SELECT lookback, portfolio, {r('avg(ret)')} AS mean_month,
  {r('stddev_samp(ret)')} AS vol_month, {r('avg(ret) * 12')} AS mean_year, {r('stddev_samp(ret) * sqrt(12)')} AS vol_year,
  {r('avg(ret) * 12 / (stddev_samp(ret) * sqrt(12))')} AS sharpe FROM long GROUP BY 1, 2"""),
    "quintiles_from_prices": limited_pti(),
    "extremes_from_prices": limited_extremes(),
    # performance
    "performance": with_(*portfolios(), performance_rows("long", "lookback, portfolio"),
        final=f"SELECT lookback, portfolio, {rounds(*MEASURES)}, n_months FROM perf"),
    "drawdown_series": with_(*portfolios(), performance_rows("long", "lookback, portfolio"),
        final=f"SELECT lookback, portfolio, date, {r('dd')} AS drawdown FROM perf_peaked"),
    "cumulative_returns": with_(*portfolios(), performance_rows("long", "lookback, portfolio"),
        final=f"SELECT lookback, portfolio, date, {r('(growth - 1) * 100')} AS cum_ret FROM perf_grown"),
    "rolling_metrics": with_(*portfolios(), rolling("lookback, portfolio", "true", 12),
        final=f"SELECT lookback, portfolio, date, {rounds('rolling_sharpe', 'rolling_vol')} FROM rolling"),
    "rolling_sharpe_skipping": with_(*portfolios(), rolling("lookback", "portfolio = 'LowMinusHigh'", 23),
        final=f"SELECT lookback, date, {rounds('rolling_sharpe', 'rolling_vol')} FROM rolling"),
    "rolling_summary": with_(*portfolios(LOOKBACKS), rolling("lookback", "portfolio = 'LowMinusHigh'", 12),
        final=f"""SELECT lookback, count(*) AS n_windows, {r('avg(rolling_sharpe)')} AS mean, {r('stddev_samp(rolling_sharpe)')} AS std,
  {r('min(rolling_sharpe)')} AS min, {r('max(rolling_sharpe)')} AS max FROM rolling GROUP BY 1"""),
    "risk_return_table": with_(*portfolios(), final=f"""SELECT lookback, portfolio, {r('avg(ret) * 12')} AS annual_return,
  {r('stddev_samp(ret) * sqrt(12)')} AS annual_vol, {r('avg(ret) * 12 / (stddev_samp(ret) * sqrt(12))')} AS sharpe_ratio FROM long GROUP BY 1, 2"""),
    "dashboard": with_(*portfolios(), final=f"""SELECT lookback, portfolio, {r('avg(ret)')} AS mean_ret, {r('stddev_samp(ret)')} AS std_ret,
  {r('avg(ret) / stddev_samp(ret)')} AS sharpe_month FROM long GROUP BY 1, 2"""),
    "sharpe_excess": with_(*portfolios(), FACTOR_ROWS, final=f"""SELECT lookback, portfolio, count(*) AS n_obs,
  {r("CASE WHEN count(*) >= 12 THEN avg(ret - RF) / stddev_samp(ret - RF) ELSE 'nan'::DOUBLE END")} AS sharpe_monthly,
  {r("CASE WHEN count(*) >= 12 THEN avg(ret - RF) / stddev_samp(ret - RF) * sqrt(12) ELSE 'nan'::DOUBLE END")} AS sharpe_annual
  FROM long JOIN factors USING (date) WHERE RF IS NOT NULL GROUP BY 1, 2"""),
    # factors
    "factor_table": with_(*FACTORS_ONLY, final=f"SELECT date, {rounds(*FACTORS, 'RF')} FROM factors WHERE date BETWEEN {MID}"),
    "factor_summary": with_(*FACTORS_ONLY, final=" UNION ALL ".join(
        f"""SELECT '{c}' AS factor, {r(f'avg({c})')} AS mean, {r(f'stddev_samp({c})')} AS std, {r(f'min({c})')} AS min,
  {r(f'max({c})')} AS max, count({c}) AS n_obs FROM factors""" for c in FACTORS + ["RF"])),
    "factor_correlations": with_(*FACTORS_ONLY, final=f"""SELECT min(date) AS period_start, max(date) AS period_end, count(*) AS n_months,
  {r('corr(MKT_RF, SMB)')} AS mkt_smb, {r('corr(MKT_RF, HML)')} AS mkt_hml, {r('corr(SMB, HML)')} AS smb_hml FROM factors"""),
    "factor_validation": with_(*FACTORS_ONLY, final=f"""SELECT {r('avg(MKT_RF)')} AS mean_mkt_rf, {r('avg(RF)')} AS mean_rf,
  count(*) AS n_months FROM factors"""),
    "factor_coverage": with_(*FACTORS_ONLY, final=f"""SELECT min(date) AS first_month, max(date) AS last_month,
  min(date) <= DATE '{GRID_START}' AND max(date) >= DATE '2001-10-01' AS covered FROM factors"""),
    "factor_file_ingest": with_(*FACTORS_ONLY, COMPLETE, final=f"""SELECT date, {', '.join(
        f"{r(c, 2)} AS {c}" for c in FACTORS + ['RF'])} FROM complete"""),
    # regressions
    "capm_ols": aligned_model("CAPM"),
    "ff3_ols": aligned_model("FF3"),
    "ff5_ols": aligned_model("FF5"),
    "capm_positional": positional_model("CAPM"),
    "ff3_positional": positional_model("FF3"),
    "ff5_positional": positional_model("FF5"),
    "capm_newey_west": aligned_model("CAPM", True),
    "ff5_newey_west": aligned_model("FF5", True),
    "ff3_newey_west_reference_scale": aligned_model("FF3", True, " / count(*)"),
    "custom_regression": with_(*portfolios(), FACTOR_ROWS, BY_DATE, design(["MKT_RF", "HML", "CMA"], "aligned", "portfolio"), gram_schmidt(3),
        final=f"""SELECT grp AS portfolio, {r('beta0', 8)} AS alpha, {r('sqrt(v0 * rss / df)', 8)} AS alpha_se,
  {r('beta0 / sqrt(v0 * rss / df)', 8)} AS alpha_t, {r(t_pvalue('(beta0 / sqrt(v0 * rss / df))', 'df'), 8)} AS alpha_pval,
  {r('beta1', 8)} AS b0, {r('beta2', 8)} AS b1, {r('beta3', 8)} AS b2, {r('1 - rss / tss', 8)} AS r2, n_obs FROM fit"""),
    "custom_regression_robust": with_(*portfolios(), FACTOR_ROWS, BY_DATE, design(["MKT_RF", "HML", "CMA"], "aligned", "portfolio"), gram_schmidt(3),
        newey_west(3, 4), final=f"""SELECT grp AS portfolio, {r('beta0', 8)} AS alpha, {r('beta0 / sqrt(w0)', 8)} AS alpha_t,
  {r(t_pvalue('(beta0 / sqrt(w0))', 'df'), 8)} AS alpha_pval FROM fit JOIN robust USING (grp)"""),
    "models_all": with_(*portfolios(LOOKBACKS), FACTOR_ROWS, BY_DATE,
        *[fit_block(m, t, group="lookback || ' ' || portfolio") for m, t in (("CAPM", "f1"), ("FF3", "f3"), ("FF5", "f5"))], BEST,
        final=f"""SELECT CAST(string_split(grp, ' ')[1] AS INTEGER) AS lookback, string_split(grp, ' ')[2] AS portfolio, model,
  {rounds('alpha', 'alpha_tstat', 'alpha_pvalue', 'r2', 'adj_r2')}, n_obs,
  CASE WHEN alpha_pvalue < 0.01 THEN 'highly significant' WHEN alpha_pvalue < 0.05 THEN 'significant'
       WHEN alpha_pvalue < 0.1 THEN 'marginally significant' ELSE 'not significant' END AS significance FROM fits"""),
    "capm_by_ticker": with_(*FACTORS_ONLY,
        "aligned AS (SELECT m.ticker, f.*, m.ret FROM monthly m JOIN factors f ON f.date = m.month)",
        design(["MKT_RF"], "aligned", "ticker"), gram_schmidt(1), final=flat_fit("CAPM", "ticker")),
    "factor_loadings": with_(*portfolios(), FACTOR_ROWS, BY_DATE, design(MODELS["FF3"], "aligned", "portfolio"), gram_schmidt(3),
        final=" UNION ALL ".join(f"""SELECT grp AS portfolio, 'FF3' AS model, '{c}' AS factor, {r(f'beta{i}')} AS beta,
  {r(f'beta{i} / sqrt(v{i} * rss / df)')} AS tstat, {r(t_pvalue(f'(beta{i} / sqrt(v{i} * rss / df))', 'df'))} AS pvalue FROM fit"""
            for i, c in enumerate(MODELS["FF3"], start=1))),
    "alpha_analysis": alpha_sql(BY_DATE, False),
    "alpha_analysis_positional": alpha_sql(BY_POSITION, True),
    "best_models": with_(*portfolios(), FACTOR_ROWS, BY_DATE, fit_block("CAPM", "f1"), fit_block("FF3", "f3"), fit_block("FF5", "f5"), BEST,
        final=f"SELECT grp AS portfolio, best_model, {rounds('best_alpha', 'best_pvalue')} FROM best"),
    "residual_series": with_(*portfolios(), FACTOR_ROWS, BY_DATE, residual_block("FF3"), final=f"""SELECT portfolio, 'FF3' AS model, date,
  {r('resid')} AS resid, {r("(product(1 + resid / 100) OVER (PARTITION BY portfolio ORDER BY date ROWS UNBOUNDED PRECEDING) - 1) * 100")} AS cum_ret FROM resid"""),
    "residuals_wide": with_(*portfolios(), FACTOR_ROWS, BY_DATE, residual_block("CAPM"), final="SELECT 'CAPM' AS model, date, " + ", ".join(
        f"{r(f'''max(resid) FILTER (WHERE portfolio = '{p}')''')} AS {p}" for p in QUINTILES) + f" FROM resid WHERE portfolio <> '{LONG_SHORT}' GROUP BY date"),
    "grs_capm_two_portfolios": grs_sql("CAPM", ["P1", "P5"]),
    "grs_ff3": grs_sql("FF3", QUINTILES),
    "grs_ff5": grs_sql("FF5", QUINTILES),
    "grs_simple": grs_sql("FF5", QUINTILES, full=False),
    "grs_alphas": with_(*portfolios(), FACTOR_ROWS, BY_DATE, fit_block("FF3", "f"), residual_block("FF3"),
        f"used AS (SELECT * FROM factors WHERE date IN (SELECT date FROM resid))",
        final=f"""SELECT grp AS name, {r('alpha / 1200', 8)} AS alpha, {r('alpha_pvalue', 8)} AS alpha_pvalue, NULL::DOUBLE AS factor_mean FROM f WHERE grp <> '{LONG_SHORT}'
  UNION ALL """ + " UNION ALL ".join(f"SELECT '{c}', NULL, NULL, {r(f'avg({c} / 100)', 8)} FROM used" for c in MODELS["FF3"])),
    "grs_fifty_portfolios": grs_fifty(),
    "grs_singular": with_(*portfolios(), FACTOR_ROWS,
        "doubled AS (SELECT * FROM long UNION ALL SELECT lookback, 'COPY', date, ret FROM long WHERE portfolio = 'P1')",
        "aligned AS (SELECT l.*, f.* EXCLUDE (date) FROM doubled l JOIN factors f USING (date))", residual_block("CAPM"),
        final="""SELECT CASE WHEN 1 - abs(corr(a.resid, b.resid)) < 1e-12 THEN 'singular' ELSE 'ok' END AS status,
  2 AS n_portfolios, 1 AS n_factors FROM resid a JOIN resid b USING (date) WHERE a.portfolio = 'P1' AND b.portfolio = 'COPY'"""),
    # robustness and reports
    "subperiods": with_(*portfolios(LOOKBACKS), f"""halves AS (
  SELECT *, CASE WHEN date <= DATE '{START}' + CAST((DATE '{END}' - DATE '{START}') // 2 AS INTEGER) THEN 'first_half' ELSE 'second_half' END AS half
  FROM long),
long_enough AS (SELECT * FROM halves QUALIFY count(*) OVER (PARTITION BY lookback, portfolio, half) > 12)""",
        performance_rows("long_enough", "lookback, portfolio, half"),
        final=f"SELECT lookback, portfolio, half, {rounds(*MEASURES)}, n_months FROM perf"),
    "lookback_correlations": with_(*portfolios(LOOKBACKS), final=f"""SELECT a.lookback AS lb1, b.lookback AS lb2, count(*) AS n_common,
  {r('corr(a.ret, b.ret)')} AS correlation FROM long a JOIN long b ON b.date = a.date AND b.portfolio = a.portfolio AND a.lookback < b.lookback
  WHERE a.portfolio = '{LONG_SHORT}' GROUP BY 1, 2 HAVING count(*) > 12"""),
    "report_table": with_(*portfolios(LOOKBACKS), performance_rows("long", "lookback, portfolio"), final=f"""SELECT lookback, portfolio,
  round_even(annual_return, 2) + 0.0 AS annual_return, round_even(annual_vol, 2) + 0.0 AS annual_vol, round_even(sharpe_ratio, 3) + 0.0 AS sharpe_ratio,
  round_even(max_drawdown * 100, 2) + 0.0 AS max_drawdown,
  CASE WHEN portfolio <> '{LONG_SHORT}' THEN NULL WHEN annual_return > 2 THEN 'STRONG ANOMALY DETECTED'
       WHEN annual_return > 0 THEN 'WEAK ANOMALY DETECTED' ELSE 'ANOMALY REVERSED' END AS anomaly_status FROM perf"""),
    "results_document": with_(*portfolios(LOOKBACKS), FACTOR_ROWS, BY_DATE, performance_rows("long", "lookback, portfolio"),
        *[fit_block(m, t, group="lookback || ' ' || portfolio") for m, t in (("CAPM", "f1"), ("FF3", "f3"), ("FF5", "f5"))], BEST,
        final=f"""SELECT lookback, '{START}' AS period_start, '{END}' AS period_end, portfolio,
  {rounds('annual_return', 'sharpe_ratio', 'max_drawdown')}, n_months, model, {rounds('alpha', 'alpha_pvalue', 'r2')}, n_obs, k AS n_loadings
  FROM perf JOIN fits ON grp = lookback || ' ' || portfolio"""),
    "final_summary": with_(*portfolios(LOOKBACKS), performance_rows("long", "lookback, portfolio"),
        final=f"SELECT lookback, {rounds('annual_return', 'sharpe_ratio')}, n_months, {ASKED.format(lookbacks=literal('6,12,24'))} FROM perf WHERE portfolio = '{LONG_SHORT}'"),
    "portfolios_side_by_side": with_(*portfolios(), final=f"SELECT lookback, date, {rounds(*PORTFOLIOS)} FROM wide"),
    "study_summary": with_(*study((12, 24), 1), performance_rows("long", "lookback, portfolio"),
        final=f"SELECT lookback, {rounds('annual_return', 'sharpe_ratio')}, n_months, {ASKED.format(lookbacks=literal('12,24'))} FROM perf WHERE portfolio = '{LONG_SHORT}'"),
    "study_repeated_quotes": with_(*study((12,), 1, LOWEST), performance_rows("long", "lookback, portfolio"),
        final=f"SELECT lookback, {rounds('annual_return', 'sharpe_ratio')}, n_months, {ASKED.format(lookbacks=literal('12'))} FROM perf WHERE portfolio = '{LONG_SHORT}'"),
    "study_regressions": with_(*study((12, 24), 1), FACTOR_ROWS, BY_DATE,
        *[fit_block(m, t, group="lookback || ' ' || portfolio") for m, t in (("CAPM", "f1"), ("FF3", "f3"), ("FF5", "f5"))], BEST,
        final=f"""SELECT CAST(string_split(grp, ' ')[1] AS INTEGER) AS lookback, string_split(grp, ' ')[2] AS portfolio, model,
  {rounds('alpha', 'alpha_tstat', 'alpha_pvalue', 'r2', 'adj_r2')}, n_obs,
  CASE WHEN alpha_pvalue < 0.01 THEN 'highly significant' WHEN alpha_pvalue < 0.05 THEN 'significant'
       WHEN alpha_pvalue < 0.1 THEN 'marginally significant' ELSE 'not significant' END AS significance FROM fits"""),
    "study_alphas": alpha_sql(BY_DATE, False, study((12,), 1)),
    "study_three_factors": " UNION ALL ".join("SELECT * FROM (" + grs_sql(m, QUINTILES, views=study((12,), 1), final=f"""SELECT 12 AS lookback, '{m}' AS model, status, n_portfolios, n_factors, n_obs, df2,
  {rounds('f_statistic', 'critical_value')}, {r(f_pvalue('f_statistic', 5, 'df2'))} AS p_value, f_statistic > critical_value AS is_significant
  FROM stat JOIN crit USING (df2)""") + ")" for m in ("CAPM", "FF3")) + " UNION ALL SELECT 12, 'FF5', 'missing_factors', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL",
    "study_files": with_(*study((12,), 1), f"""halves AS (
  SELECT *, CASE WHEN date <= DATE '{START}' + CAST((DATE '{END}' - DATE '{START}') // 2 AS INTEGER) THEN 'first_half' ELSE 'second_half' END AS half
  FROM long),
long_enough AS (SELECT * FROM halves QUALIFY count(*) OVER (PARTITION BY lookback, portfolio, half) > 12)""",
        performance_rows("long_enough", "lookback, portfolio, half"),
        final=f"SELECT lookback, portfolio, half, {rounds(*MEASURES)}, n_months FROM perf"),
    "quick_study": with_(*study((12,), 5), FACTOR_ROWS, BY_DATE, performance_rows("long", "lookback, portfolio"), fit_block("CAPM", "f"),
        final=f"""SELECT lookback, portfolio, {rounds('annual_return', 'sharpe_ratio')}, n_months, model,
  {rounds('alpha', 'alpha_tstat', 'alpha_pvalue', 'r2')}, n_obs FROM perf JOIN f ON grp = portfolio"""),
}
