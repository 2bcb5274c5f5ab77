"""SQL for linear algebra on small matrices: what least squares, elimination and components must give."""

from __future__ import annotations

import itertools
from collections.abc import Sequence


def jacobi_sql(matrix: str, size: int, name: str = "eigen", steps: int = 60) -> str:
    """CTEs ending in ``name`` (position, value, vector): eigenvalues of the list ``m`` that the CTE ``matrix`` holds.

    Rows of the matrix lie one after another. Each step turns the plane of the largest entry off the diagonal. Vectors
    have their largest entry positive.
    """
    n = size
    cell = lambda i, j: f"m[({i}) * {n} + ({j}) + 1]"
    turned = lambda source: (
        f"CASE WHEN x % {n} = p THEN c * {source}[(x // {n}) * {n} + p + 1] - s * {source}[(x // {n}) * {n} + q + 1] "
        f"WHEN x % {n} = q THEN s * {source}[(x // {n}) * {n} + p + 1] + c * {source}[(x // {n}) * {n} + q + 1] ELSE {source}[x + 1] END")
    rows = (
        f"CASE WHEN x // {n} = p THEN c * w[p * {n} + x % {n} + 1] - s * w[q * {n} + x % {n} + 1] "
        f"WHEN x // {n} = q THEN s * w[p * {n} + x % {n} + 1] + c * w[q * {n} + x % {n} + 1] ELSE w[x + 1] END")
    identity = ", ".join("1.0::DOUBLE" if i == j else "0.0::DOUBLE" for i in range(n) for j in range(n))
    upper = ", ".join(f"{{'a': abs({cell(i, j)}), 'p': {i}, 'q': {j}}}" for i in range(n) for j in range(i + 1, n))
    return f"""{name}_turn(step, m, v) AS (
  SELECT 0, m, [{identity}] FROM {matrix}
  UNION ALL
  SELECT step + 1, [{rows} FOR x IN range({n * n})], v
  FROM (SELECT step, [{turned('m')} FOR x IN range({n * n})] AS w, [{turned('v')} FOR x IN range({n * n})] AS v, p, q, c, s
    FROM (SELECT *, 1 / sqrt(t * t + 1) AS c, t / sqrt(t * t + 1) AS s
      FROM (SELECT *, CASE WHEN a = 0 THEN 0 ELSE (CASE WHEN h >= 0 THEN 1 ELSE -1 END) / (abs(h) + sqrt(h * h + 1)) END AS t
        FROM (SELECT step, m, v, top.p AS p, top.q AS q, {cell('top.p', 'top.q')} AS a,
            ({cell('top.q', 'top.q')} - {cell('top.p', 'top.p')}) / (2 * CASE WHEN {cell('top.p', 'top.q')} = 0 THEN 1 ELSE {cell('top.p', 'top.q')} END) AS h
          FROM (SELECT *, list_sort([{upper}], 'DESC')[1] AS top FROM {name}_turn WHERE step < {steps})))))
), {name}_raw AS (
  SELECT m[i * {n} + i + 1] AS value, [v[j * {n} + i + 1] FOR j IN range({n})] AS vector
  FROM (SELECT m, v, unnest(range({n})) AS i FROM {name}_turn WHERE step = {steps})
), {name} AS (
  SELECT row_number() OVER (ORDER BY value DESC) AS position, value,
    CASE WHEN list_max(vector) >= -list_min(vector) THEN vector ELSE [-x FOR x IN vector] END AS vector FROM {name}_raw
)"""


def t_tail_sql(t: str, df: str) -> str:
    """Two-sided tail of Student's distribution: Simpson's rule over the density up to |t|, or 40 if that is less."""
    density = f"exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0) - 0.5 * ln({df} * pi()) - ({df} + 1) / 2.0 * ln(1 + x * x / {df}))"
    width = f"(least(abs({t}), 40.0::DOUBLE) / 2000)"
    area = f"list_sum([(CASE WHEN k = 0 OR k = 2000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * {density.replace('x * x', f'(k * {width}) * (k * {width})')} FOR k IN range(2001)])"
    return f"greatest(0, 1 - 2 * {width} / 3 * {area})"


def least_squares_sql(base: str, target: str, features: Sequence[str]) -> str:
    """CTEs for every subset of ``features`` over the rows of the CTE ``base``.

    ``terms`` (set, term, coef, se, t, p) and ``fits`` (set, df, r2, adj_r2, aic, bic, mse); a set is the sorted list of
    its features. Each matrix of normal equations of centred columns is inverted by elimination, one pivot per step.
    """
    p = len(features)
    sums = ", ".join(f"avg({c}) AS m_{c}" for c in [*features, target])
    pairs = [(a, b) for a, b in itertools.combinations_with_replacement([*features, target], 2)]
    crosses = ", ".join(f"sum(({a} - m_{a}) * ({b} - m_{b})) AS s_{a}_{b}" for a, b in pairs)
    known = {(a, b): f"s_{a}_{b}" for a, b in pairs} | {(b, a): f"s_{a}_{b}" for a, b in pairs}
    starts = []
    for size in range(1, p + 1):
        for chosen in itertools.combinations(features, size):
            # The matrix beside the identity, its columns scaled to length 1.
            cells = [
                f"{known[a, b]} / sqrt({known[a, a]} * {known[b, b]})" if j < size else ("1.0::DOUBLE" if j - size == i else "0.0::DOUBLE")
                for i, a in enumerate(chosen) for j, b in enumerate([*chosen, *chosen])
            ]
            names = ", ".join(f"'{c}'" for c in chosen)
            column = lambda make: "[" + ", ".join(make(c) for c in chosen) + "]"
            starts.append(
                f"SELECT [{names}] AS names, {size} AS w, [{', '.join(cells)}] AS m, {column(lambda c: known[c, c])} AS sxx, "
                f"{column(lambda c: known[c, target])} AS sxy, {column(lambda c: f'm_{c}')} AS mx, {known[target, target]} AS sst, m_{target} AS my, n FROM crosses")
    return f"""means AS (SELECT {sums}, count(*)::DOUBLE AS n FROM {base}),
crosses AS (SELECT {crosses}, max(n) AS n, {', '.join(f'max(m_{c}) AS m_{c}' for c in [*features, target])} FROM {base}, means),
starts AS ({' UNION ALL '.join(starts)}),
solved(k, names, w, m) AS (
  SELECT 0, names, w, m FROM starts
  UNION ALL
  SELECT k + 1, names, w, [CASE WHEN x // (2 * w) = k THEN m[x + 1] / m[k * 2 * w + k + 1]
    ELSE m[x + 1] - m[(x // (2 * w)) * 2 * w + k + 1] * m[k * 2 * w + x % (2 * w) + 1] / m[k * 2 * w + k + 1] END FOR x IN range(2 * w * w)]
  FROM solved WHERE k < w
),
inverses AS (
  SELECT s.*, [[i.m[a * 2 * s.w + s.w + b + 1] / sqrt(sxx[a + 1] * sxx[b + 1]) FOR b IN range(s.w)] FOR a IN range(s.w)] AS inv
  FROM starts s JOIN solved i ON i.names = s.names AND i.k = s.w
),
slopes AS (SELECT *, [list_sum([inv[a + 1][b + 1] * sxy[b + 1] FOR b IN range(w)]) FOR a IN range(w)] AS slope FROM inverses),
sums AS (SELECT *, sst - list_sum([slope[a + 1] * sxy[a + 1] FOR a IN range(w)]) AS ssr, n - w - 1 AS df FROM slopes),
each_term AS (
  SELECT names, df, 'const' AS term, my - list_sum([slope[a + 1] * mx[a + 1] FOR a IN range(w)]) AS coef,
    sqrt(ssr / df * (1 / n + list_sum([list_sum([mx[a + 1] * inv[a + 1][b + 1] * mx[b + 1] FOR b IN range(w)]) FOR a IN range(w)]))) AS se FROM sums
  UNION ALL
  SELECT names, df, names[a + 1], slope[a + 1], sqrt(ssr / df * inv[a + 1][a + 1]) FROM (SELECT *, unnest(range(w)) AS a FROM sums)
  UNION ALL
  SELECT []::VARCHAR[], n - 1, 'const', m_{target}, sqrt({known[target, target]} / (n - 1) / n) FROM crosses
),
terms AS (SELECT names, df, term, coef, se, coef / se AS t, {t_tail_sql('(coef / se)', 'df')} AS p FROM each_term),
fits AS (
  SELECT names, df, 1 - ssr / sst AS r2, 1 - (ssr / sst) * (n - 1) / df AS adj_r2, n * (ln(2 * pi() * ssr / n) + 1) + 2 * (w + 1) AS aic,
    n * (ln(2 * pi() * ssr / n) + 1) + ln(n) * (w + 1) AS bic, ssr / n AS mse FROM sums
)"""


def elimination_sql(features: Sequence[str], p_remove: float = 0.1) -> str:
    """CTE ``walk`` (step, names, removed, p) over ``terms``: what backward elimination has before each step."""
    names = ", ".join(f"'{c}'" for c in features)
    return f"""worst AS (SELECT names, arg_max(term, p) AS term, max(p) AS p FROM terms WHERE term <> 'const' GROUP BY names),
walk(step, names, removed, p) AS (
  SELECT 1, w.names, w.term, w.p FROM worst w WHERE w.names = [{names}]
  UNION ALL
  SELECT step + 1, w.names, w.term, w.p FROM walk JOIN worst w ON w.names = [x FOR x IN walk.names IF x <> walk.removed] WHERE walk.p > {p_remove}
)"""
