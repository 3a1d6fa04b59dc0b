"""SQL of the selectors: draws are hashes, so a statement can repeat them row by row."""

from __future__ import annotations

import math

from scantling.operators.selection import Target


def hash_of(text: str, seed: int) -> str:
    return f"CAST('0x'||substr(md5(concat('{seed}:',{text})),1,8) AS BIGINT)"


def drawn(budget: int, mode: str, seed: int, view: str, tag: str) -> str:
    """Tables r{tag} (rows by rank) and s{tag} (draws by rank, numbered from 0)."""
    weight = {"sqrt": "sqrt(proxy_score)", "prop": "proxy_score", "uniform": "1.0::DOUBLE"}[mode]
    return f"""pr{tag} AS (SELECT id, label, proxy_score, 0.9::DOUBLE*{weight}/(sum({weight}) OVER ())+0.1::DOUBLE/(count(*) OVER ()) AS prob, count(*) OVER () AS n FROM {view}),
r{tag} AS MATERIALIZED (SELECT *, sum(prob) OVER x AS upto, row_number() OVER x - 1 AS rank FROM pr{tag} WINDOW x AS (ORDER BY proxy_score DESC, id)),
d{tag} AS (SELECT draw, {hash_of("'draw'||draw", seed)}/4294967296.0::DOUBLE AS u FROM (SELECT unnest(range(0,{budget})) AS draw)),
s{tag} AS MATERIALIZED (SELECT row_number() OVER (ORDER BY rank, draw) - 1 AS i, id, rank, label, n, upto, 1/n/prob AS mass, label/n/prob AS m, count(*) OVER () AS c FROM d{tag} JOIN r{tag} ON u < upto AND u >= upto - prob)"""


def reach(delta: float) -> str:
    return f"CAST({math.sqrt(2 * math.log(1 / (2 * delta)))!r} AS DOUBLE)"


def recall(t: Target, mode: str, seed: int, view: str) -> str:
    return f"""WITH {drawn(t.budget, mode, seed, view, '1')}, c1 AS (SELECT *, sum(m) OVER (ORDER BY i) AS w, sum(m) OVER () AS total FROM s1),
sp AS (SELECT min(i) AS split FROM c1 WHERE w >= {t.recall}::DOUBLE * total),
bd AS (SELECT avg(a) + stddev_pop(a) * {reach(t.delta / 2)} / sqrt(count(*)) AS up, greatest(avg(b) - stddev_pop(b) * {reach(t.delta / 2)} / sqrt(count(*)), 0) AS lo
 FROM (SELECT CASE WHEN i <= split THEN m ELSE 0 END AS a, CASE WHEN i <= split THEN 0 ELSE m END AS b FROM c1, sp)),
wd AS (SELECT CASE WHEN up + lo > 0 THEN up / (up + lo) ELSE 1 END AS wanted FROM bd),
ct AS (SELECT CASE WHEN any_value(wanted) >= 1 OR any_value(total) = 0 THEN 9223372036854775807 ELSE arg_min(rank, i) FILTER (WHERE w >= wanted * total) END AS cut FROM c1, wd)
SELECT id FROM r1, ct WHERE rank <= cut OR id IN (SELECT id FROM s1 WHERE label > 0)"""


def uniform(t: Target, seed: int, view: str) -> str:
    return f"""o1 AS (SELECT *, row_number() OVER (ORDER BY proxy_score DESC, id) - 1 AS rank FROM {view}), q1 AS (SELECT * FROM o1 ORDER BY {hash_of('id', seed)}, id LIMIT {t.budget}),
s1 AS MATERIALIZED (SELECT *, row_number() OVER x - 1 AS i, sum(label) OVER x AS w, sum(label) OVER () AS total, avg(label) OVER x AS mean, stddev_pop(label) OVER x AS std, count(*) OVER () AS c FROM q1 WINDOW x AS (ORDER BY rank))"""


PICK = "SELECT id FROM o1, ct WHERE rank <= cut OR id IN (SELECT id FROM s1 WHERE label > 0)"


def recall_naive(t: Target, seed: int, view: str) -> str:
    return f"WITH {uniform(t, seed, view)}, ct AS (SELECT coalesce(min(rank) FILTER (WHERE total > 0 AND w >= {t.recall}::DOUBLE * total), 9223372036854775807) AS cut FROM s1) {PICK}"


def precision_naive(t: Target, seed: int, view: str) -> str:
    return f"WITH {uniform(t, seed, view)}, ct AS (SELECT coalesce(max(rank) FILTER (WHERE w / (i + 1) >= {t.precision}::DOUBLE), -1) AS cut FROM s1) {PICK}"


def precision_uniform(t: Target, seed: int, view: str, stride: int) -> str:
    tries = max(1, len(range(stride, t.budget, stride)))
    return f"WITH {uniform(t, seed, view)}, ct AS (SELECT coalesce(max(rank) FILTER (WHERE i > 0 AND i % {stride} = 0 AND mean - std * {reach(t.delta / tries)} / sqrt(i + 1) > {t.precision}::DOUBLE), -1) AS cut FROM s1) {PICK}"


def cut(t: Target, tag: str, budget: int, delta: float, stride: int) -> str:
    """Table ct: the last rank whose lower bound is above the target."""
    tries = max(1, len([s for s in range(stride, budget, stride) if s + 1 < budget]))
    return f"""w{tag} AS (SELECT *, avg(m) OVER x AS mean, stddev_pop(m) OVER x AS std, (rank + 1) / n / upto AS scale FROM s{tag} WINDOW x AS (ORDER BY i)),
ct AS (SELECT coalesce(max(rank) FILTER (WHERE i > 0 AND i % {stride} = 0 AND i + 1 < c AND mean / scale - std / scale * {reach(delta / tries)} / sqrt(i + 1) > {t.precision}::DOUBLE), -1) AS cut FROM w{tag})"""


def precision_one_stage(t: Target, seed: int, view: str, stride: int) -> str:
    return f"WITH {drawn(t.budget, 'sqrt', seed, view, '1')}, {cut(t, '1', t.budget, t.delta, stride)} SELECT id FROM r1, ct WHERE rank <= cut OR id IN (SELECT id FROM s1 WHERE label > 0)"


def precision_two_stage(t: Target, seed: int, view: str, stride: int) -> str:
    half = t.budget // 2
    return f"""WITH {drawn(half, 'sqrt', seed, view, '1')},
up AS (SELECT (avg(m) + stddev_pop(m) * {reach(t.delta / 2)} / sqrt(count(*))) AS up FROM s1),
tp AS (SELECT id, label, proxy_score FROM r1, up WHERE rank < least(n, greatest(1, ceil(up * n / {t.precision}::DOUBLE)))),
{drawn(t.budget - half, 'sqrt', seed + 1, 'tp', '2')}, {cut(t, '2', t.budget - half, t.delta / 2, stride)}
SELECT id FROM r1, ct WHERE rank <= cut OR id IN (SELECT id FROM s1 WHERE label > 0 UNION ALL SELECT id FROM s2 WHERE label > 0)"""


def chosen(selector: str, t: Target, seed: int = 7, view: str = "v_proxy", stride: int = 100) -> str:
    """The ids that a selector returns."""
    kind, mode = selector.split("_", 1)
    if selector in ("recall_sqrt", "recall_prop", "recall_uniform"):
        return recall(t, mode, seed, view)
    if selector.endswith("naive"):
        return recall_naive(t, seed, view) if kind == "recall" else precision_naive(t, seed, view)
    return {"uniform": precision_uniform, "one_stage": precision_one_stage, "two_stage": precision_two_stage}[mode](t, seed, view, stride)


def quality(ids: str, view: str = "v_proxy") -> str:
    """Precision, recall and sizes of a selection."""
    return f"""SELECT round(count(*) FILTER (WHERE c AND label > 0) / nullif(count(*) FILTER (WHERE c), 0), 6) AS "precision", round(count(*) FILTER (WHERE c AND label > 0) / nullif(count(*) FILTER (WHERE label > 0), 0), 6) AS recall,
count(*) FILTER (WHERE c) AS size, count(*) FILTER (WHERE label > 0) AS n_true FROM (SELECT label, id IN (SELECT id FROM ({ids})) AS c FROM {view})"""


def trials(selector: str, t: Target, n: int) -> str:
    goal = f'"precision" >= {t.precision}::DOUBLE' if selector.startswith("precision") else f"recall >= {t.recall}::DOUBLE"
    return " UNION ALL ".join(f'SELECT {seed} AS trial, "precision", recall, size, {goal} AS covered FROM ({quality(chosen(selector, t, seed))})' for seed in range(n))
