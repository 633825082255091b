"""SQL for the grouped cross-validated ridge: the same numbers from textbook formulas.

Moments of each validation cell are formed in SQL, every penalty of every training set is
solved by elimination in a recursive query over lists, and the penalty with the best mean R2
over held-out cells is kept. Slow and less accurate than the factors, but independent of them.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

from voxelherd.operators.ridge import ALPHAS

# Remainders of the reflected polynomial for each byte value, from the rule by which the
# checksum of one byte is this remainder up to two fixed terms.
CRC_TABLE = [zlib.crc32(bytes([b ^ 0xFF])) ^ 0xFFFFFFFF ^ 0x00FFFFFF for b in range(256)]


def crc32_sql(text: str) -> str:
    """Unsigned checksum of an ASCII expression."""
    return (
        f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length({text})), "
        f"lambda j: ascii({text}[j + 1])::BIGINT)), lambda c, b: xor(c >> 8, {CRC_TABLE}[(xor(c, b) & 255) + 1])))"
    )


def ridge_sql(
    source: str, d: int, tail: str, alphas: Sequence[float] = ALPHAS, folds: int = 5, inner: str = "grouped"
) -> str:
    """``tail`` selects from ``predicted`` (src columns, outer_fold, alpha, predicted) and ``fits`` (model, alpha, w).

    ``source`` are common table expressions that end in ``src`` (id, s, x as a list, y); model 0
    is fitted on all rows, model f on the rows outside fold f.
    """
    if inner == "grouped":
        cells = "SELECT model, fold AS cell, id, x, y FROM trained"
    else:
        cells = f"""SELECT model, CASE WHEN p < n % {folds} * (n // {folds} + 1) THEN p // (n // {folds} + 1)
            ELSE n % {folds} + (p - n % {folds} * (n // {folds} + 1)) // greatest(n // {folds}, 1) END + 1 AS cell, id, x, y
  FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY id) - 1 AS p, count(*) OVER (PARTITION BY model) AS n FROM trained)"""
    penalties = f"[{', '.join(f'{a!r}::DOUBLE' for a in alphas)}]"
    return f"""
WITH RECURSIVE {source},
dealt AS (SELECT s, row_number() OVER (ORDER BY count(*) DESC, s) - 1 AS k FROM src GROUP BY s),
few AS (SELECT least({folds}, count(*)) AS k FROM dealt),
folded AS (
  SELECT src.*, CASE WHEN dealt.k % (2 * few.k) < few.k THEN dealt.k % (2 * few.k) ELSE 2 * few.k - 1 - dealt.k % (2 * few.k) END + 1 AS fold
  FROM src JOIN dealt ON src.s = dealt.s, few
),
trained AS (SELECT model, fold, id, x, y FROM folded, range(0, {folds} + 1) m(model) WHERE fold <> model),
split AS ({cells}),
long AS (SELECT model, unnest(range(1, {d} + 1)) AS i, unnest(x) AS v FROM trained),
scale AS (
  SELECT model, list(m ORDER BY i) AS mean, list(CASE WHEN s <= 1e-12::DOUBLE * (s + abs(m)) THEN 1 ELSE s END ORDER BY i) AS dev
  FROM (SELECT model, i, avg(v) AS m, stddev_pop(v) AS s FROM long GROUP BY ALL) GROUP BY model
),
level AS (SELECT model, avg(y) AS mean_y FROM trained GROUP BY model),
rows AS (
  SELECT model, cell, id, y - mean_y AS y, list_transform(range(1, {d} + 1), lambda i: (x[i] - mean[i]) / dev[i]) AS z
  FROM split JOIN scale USING (model) JOIN level USING (model)
),
wide AS (SELECT model, cell, id, list_concat([1::DOUBLE], z, [y]) AS v FROM rows),
flat AS (SELECT model, cell, id, unnest(range(0, {d} + 2)) AS i, unnest(v) AS a FROM wide),
products AS (
  SELECT model, cell, i, j, sum(a * b) AS v FROM (
    SELECT f.model, f.cell, f.i, f.a, unnest(range(0, {d} + 2)) AS j, unnest(w.v) AS b
    FROM flat f JOIN wide w ON f.model = w.model AND f.id = w.id AND f.cell = w.cell
  ) GROUP BY ALL
),
sets AS (SELECT DISTINCT model, cell AS held FROM split UNION ALL SELECT DISTINCT model, 0 FROM split),
totals AS (
  SELECT p.model, held, i, j, sum(v) AS v FROM products p JOIN sets t ON p.model = t.model AND p.cell <> t.held GROUP BY ALL
),
firsts AS (SELECT model, held, max(v) FILTER (i = 0 AND j = 0) AS n, list(v ORDER BY j) FILTER (i = 0) AS sums FROM totals GROUP BY ALL),
centered AS (
  SELECT model, held, list(v - sums[i + 1] * sums[j + 1] / n ORDER BY i, j) AS m
  FROM totals JOIN firsts USING (model, held) WHERE i BETWEEN 1 AND {d} AND j BETWEEN 1 AND {d} + 1 GROUP BY ALL
),
systems AS (
  SELECT model, held, alpha, list_transform(range({d} * ({d} + 1)), lambda p:
    m[p + 1] + CASE WHEN p // ({d} + 1) = p % ({d} + 1) THEN alpha ELSE 0 END) AS m
  FROM (SELECT *, unnest({penalties}) AS alpha FROM centered)
),
solved AS (
  SELECT model, held, alpha, m, 0 AS k, {d} + 1 AS c FROM systems
  UNION ALL
  SELECT model, held, alpha, list_transform(range({d} * (c - 1)), lambda p:
    CASE WHEN p // (c - 1) = k THEN m[k * c + p % (c - 1) + 2] / m[k * c + 1]
         ELSE m[p // (c - 1) * c + p % (c - 1) + 2] - m[p // (c - 1) * c + 1] * m[k * c + p % (c - 1) + 2] / m[k * c + 1] END), k + 1, c - 1
  FROM solved WHERE k < {d}
),
lines AS (
  SELECT model, held, alpha, m AS w, (sums[{d} + 2] - list_inner_product(m, sums[2:{d} + 1])) / n AS b
  FROM solved JOIN firsts USING (model, held) WHERE k = {d}
),
scores AS (
  SELECT l.model, l.held, l.alpha, CASE WHEN var_pop(y) > 0 THEN 1 - sum(pow(y - b - list_inner_product(w, z), 2)) / (var_pop(y) * count(*)) ELSE 0 END AS r2
  FROM lines l JOIN rows r ON l.model = r.model AND l.held = r.cell GROUP BY ALL
),
chosen AS (
  SELECT model, alpha FROM (
    SELECT *, row_number() OVER (PARTITION BY model ORDER BY r2 DESC, alpha) AS rank
    FROM (SELECT model, alpha, avg(r2) AS r2 FROM scores GROUP BY model, alpha)
  ) WHERE rank = 1
),
fits AS (SELECT l.model, l.alpha, w, b FROM lines l JOIN chosen c ON l.model = c.model AND l.alpha = c.alpha WHERE held = 0),
predicted AS (
  SELECT folded.*, fold::INTEGER AS outer_fold, alpha,
         mean_y + b + list_inner_product(w, list_transform(range(1, {d} + 1), lambda i: (x[i] - mean[i]) / dev[i])) AS predicted
  FROM folded JOIN fits ON folded.fold = fits.model JOIN scale ON folded.fold = scale.model JOIN level ON folded.fold = level.model
)
{tail}"""


def _eliminated(name: str, systems: str, d: int) -> str:
    """CTE ``name`` (alpha, w) from ``systems`` (alpha, m): rows of a matrix of d + 1 columns, the last is the right side."""
    return f"""{name}_steps AS (
  SELECT alpha, m, 0 AS k, {d} + 1 AS c FROM {systems}
  UNION ALL
  SELECT alpha, list_transform(range({d} * (c - 1)), lambda p:
    CASE WHEN p // (c - 1) = k THEN m[k * c + p % (c - 1) + 2] / m[k * c + 1]
         ELSE m[p // (c - 1) * c + p % (c - 1) + 2] - m[p // (c - 1) * c + 1] * m[k * c + p % (c - 1) + 2] / m[k * c + 1] END), k + 1, c - 1
  FROM {name}_steps WHERE k < {d}
),
{name} AS (SELECT alpha, m AS w FROM {name}_steps WHERE k = {d})"""


def probe_sql(source: str, d: int, penalties: Sequence[float], steps: int = 7) -> str:
    """Probe results from ``src`` (id, split, x as a list, y of 0 and 1), by plain Newton steps."""
    n = d + 1
    ridge = f"CASE WHEN i < {n} THEN alpha ELSE 0 END"
    parts = [f"""
WITH RECURSIVE {source},
heads AS (SELECT unnest([{', '.join(f'{p!r}::DOUBLE' for p in penalties)}]) AS alpha),
long AS (SELECT unnest(range(1, {n})) AS i, unnest(x) AS v FROM src WHERE split = 'train'),
scale AS (SELECT list(m ORDER BY i) AS mean, list(s ORDER BY i) AS dev FROM (SELECT i, avg(v) AS m, stddev_samp(v) AS s FROM long GROUP BY i)),
rows AS (
  SELECT id, split, y, list_concat(list_transform(range(1, {n}), lambda i: (x[i] - mean[i]) / dev[i]), [1::DOUBLE]) AS v FROM src, scale
),
train AS (SELECT * FROM rows WHERE split = 'train'),
w0 AS (
  SELECT alpha, list_concat(list_transform(range(1, {n}), lambda i: 0::DOUBLE), [level]) AS w
  FROM heads, (SELECT ln(avg(y) / (1 - avg(y))) AS level FROM train)
)"""]
    for k in range(steps):
        parts.append(f"""
p{k} AS (SELECT alpha, y, v, w, 1 / (1 + exp(-list_inner_product(w, v))) AS p FROM w{k}, train),
g{k} AS (
  SELECT alpha, i, avg((p - y) * a) + {ridge} * any_value(w[i]) AS g
  FROM (SELECT alpha, y, p, w, unnest(range(1, {n} + 1)) AS i, unnest(v) AS a FROM p{k}) GROUP BY alpha, i
),
h{k} AS (
  SELECT alpha, i, j, avg(c * a * b) + CASE WHEN i = j THEN {ridge} ELSE 0 END AS h FROM (
    SELECT alpha, c, i, a, unnest(range(1, {n} + 1)) AS j, unnest(v) AS b
    FROM (SELECT alpha, p * (1 - p) AS c, v, unnest(range(1, {n} + 1)) AS i, unnest(v) AS a FROM p{k})
  ) GROUP BY alpha, i, j
),
m{k} AS (
  SELECT alpha, list(v ORDER BY i, j) AS m
  FROM (SELECT alpha, i, j, h AS v FROM h{k} UNION ALL SELECT alpha, i, {n} + 1, g FROM g{k}) GROUP BY alpha
),
{_eliminated(f's{k}', f'm{k}', n)},
w{k + 1} AS (SELECT a.alpha, list_transform(range(1, {n} + 1), lambda i: a.w[i] - s.w[i]) AS w FROM w{k} a JOIN s{k} s ON a.alpha = s.alpha)""")
    return ",".join(parts) + f""",
scored AS (SELECT alpha, split, y, list_inner_product(w, v) AS score FROM w{steps}, rows WHERE split <> 'train'),
ranked AS (
  SELECT *, rank() OVER (PARTITION BY alpha, split ORDER BY score) + (count(*) OVER (PARTITION BY alpha, split, score) - 1) / 2.0::DOUBLE AS mid FROM scored
),
areas AS (
  SELECT alpha, split, (sum(mid) FILTER (y = 1) - pos * (pos + 1) / 2.0::DOUBLE) / (pos * neg) AS area
  FROM (SELECT *, count(*) FILTER (y = 1) OVER w AS pos, CAST(count(*) FILTER (y = 0) OVER w AS DOUBLE) AS neg FROM ranked WINDOW w AS (PARTITION BY alpha, split))
  GROUP BY alpha, split, pos, neg
),
wide AS (SELECT alpha, max(area) FILTER (split = 'val') AS val, max(area) FILTER (split = 'test') AS test FROM areas GROUP BY alpha)
SELECT alpha AS penalty, round(val, 8) AS val_auroc, round(test, 8) AS test_auroc, row_number() OVER (ORDER BY val DESC NULLS LAST, alpha) = 1 AS chosen FROM wide"""
