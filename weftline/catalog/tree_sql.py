"""Growing forests and boosted trees as SQL: the plain version of ``operators.trees``, a common table per step.

The rows come from a table ``src`` (``rid``, ``key``, ``row_key`` as text, ``x`` as a list, ``y``, ``train``).
"""

from __future__ import annotations

import math

from weftline.operators import trees as T

ONE = "1073741824.0"


def _bins(p: str, n: int, bins: int) -> list[str]:
    inner = ", ".join(f"{k}/{bins}.0" for k in range(1, bins))
    return [
        f"{p}f AS MATERIALIZED (SELECT rid, key, i AS f, x[i + 1] AS v, train FROM src, range({n}) r(i))",
        f"{p}e AS MATERIALIZED (SELECT key, f, quantile_cont(v, [{inner}]) AS e FROM {p}f WHERE train GROUP BY 1, 2)",
        f"{p}bins AS MATERIALIZED (SELECT rid, f, len(list_filter(e, lambda z: z < v)) AS bin FROM {p}f JOIN {p}e USING (key, f))",
    ]


def _splits(p: str, at: str, level: int, sums: str, chosen: str, worth, stands) -> list[str]:
    """Sums by bin, running sums, and the best split of each open node with the number of its first child."""
    s = f"{p}{level}"
    l, r, n = (worth(*x) for x in (("la", "lb"), ("(a - la)", "(b - lb)"), ("a", "b")))
    may = f"more IS NOT NULL AND {stands('la', 'lb')} AND {stands('(a - la)', '(b - lb)')}"
    return [
        f"""{s}c AS NOT MATERIALIZED (SELECT {at}.key, {at}.tree, {at}.node, f, bin, {sums} GROUP BY ALL)""",
        f"""{s}d AS NOT MATERIALIZED (SELECT key, tree, node, f, bin, lead(bin) OVER o AS more, sum(a) OVER o AS la, sum(b) OVER o AS lb,
               sum(a) OVER w AS a, sum(b) OVER w AS b FROM {s}c
             WINDOW o AS (PARTITION BY key, tree, node, f ORDER BY bin), w AS (PARTITION BY key, tree, node, f))""",
        f"""{s}g AS NOT MATERIALIZED (SELECT *, CASE WHEN {may} THEN {l} + {r} - {n} END AS gain FROM {s}d)""",
        f"""{s}b AS NOT MATERIALIZED (SELECT * REPLACE (CASE WHEN gain > {T.LEAST_GAIN} THEN gain END AS gain) FROM {s}g
             QUALIFY row_number() OVER (PARTITION BY key, tree, node ORDER BY CASE WHEN gain > {T.LEAST_GAIN} THEN gain END DESC NULLS LAST, f, bin) = 1)""",
        f"""{s}s AS NOT MATERIALIZED (SELECT *, max(node) OVER (PARTITION BY key, tree) + 1
               + 2 * (count(gain) OVER (PARTITION BY key, tree ORDER BY node) - 1) AS first FROM {s}b)""",
    ]


def _step(p: str, at: str, level: int, value) -> str:
    """Where each row stands after a level: its node, the value there, and whether the node is still open."""
    s = f"{p}{level}"
    goes_left = "coalesce(m.bin, 0) <= s.bin"
    return f"""{p}p{level + 1} AS MATERIALIZED (
      SELECT q.rid, q.key, q.tree, CASE WHEN s.gain IS NULL THEN q.node ELSE s.first + (NOT {goes_left})::INT END AS node,
             CASE WHEN s.key IS NULL THEN q.value WHEN s.gain IS NULL THEN {value('s.a', 's.b')}
                  WHEN {goes_left} THEN {value('s.la', 's.lb')} ELSE {value('(s.a - s.la)', '(s.b - s.lb)')} END AS value,
             s.gain IS NOT NULL AS open, CASE WHEN s.key IS NOT NULL THEN {value('s.a', 's.b')} END AS before, s.f AS split_on
      FROM {at} q LEFT JOIN {s}s s ON q.open AND q.key = s.key AND q.tree = s.tree AND q.node = s.node
      LEFT JOIN {p}bins m ON m.rid = q.rid AND m.f = s.f AND s.gain IS NOT NULL)"""


def forest(n: int, p: str = "w", trees: int = T.TREES, depth: int = T.FOREST_DEPTH, bins: int = T.BINS, seed: int = T.SEED) -> str:
    """Tables ``<p>p1`` … of where each row stands in each tree, ``<p>0s`` … of splits, and ``<p>score`` (rid, probability)."""
    m, ends, share, upto = max(int(math.sqrt(n)), 1), [], math.exp(-1.0), 0.0
    for k in range(8):
        upto += share
        ends.append(int(upto * 65536))
        share /= k + 1

    def worth(a, b):
        return f"({a} * {a} + {b} * {b})::DOUBLE / ({a} + {b})::DOUBLE"

    draw = f"('0x' || substr(md5('{seed}|' || (tree // {T.PER_DIGEST}) || '|' || row_key), (tree % {T.PER_DIGEST} * 4 + 1)::INT, 4))::INT"
    out = [
        *_bins(p, n, bins),
        f"{p}u AS (SELECT rid, y, tree, {draw} AS u FROM src, range({trees}) t(tree) WHERE train)",
        f"{p}w AS MATERIALIZED (SELECT rid, tree, y, {' + '.join(f'(u >= {e})::INT' for e in ends)} AS n FROM {p}u)",
        f"{p}p0 AS (SELECT rid, key, tree, 0 AS node, NULL::DOUBLE AS value, true AS open FROM src, range({trees}) t(tree))",
    ]
    for level in range(depth):
        at = f"{p}p{level}"
        chosen = f"""{p}{level}o AS MATERIALIZED (SELECT tree, node, f FROM range({trees}) t(tree), range({max(2 * level - 1, 0)}, {(2 << level) - 1}) o(node), range({n}) r(f)
          QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY md5('{seed}|' || tree || '|' || node || '|' || f)) <= {m})"""
        sums = f"""sum(n * (1 - y)) AS a, sum(n * y) AS b
             FROM {at} JOIN {p}w USING (rid, tree) JOIN {p}{level}o o ON o.tree = {at}.tree AND o.node = {at}.node JOIN {p}bins USING (rid, f)
             WHERE open AND n > 0"""
        out += [chosen, *_splits(p, at, level, sums, chosen, worth, lambda a, b: f"{a} + {b} >= 1")]
        out.append(_step(p, at, level, lambda a, b: f"{b}::DOUBLE / ({a} + {b})::DOUBLE"))
    out.append(f"{p}score AS (SELECT rid, avg(value) AS probability FROM {p}p{depth} GROUP BY 1)")
    return ",\n".join(out)


def moves(p: str, depth: int) -> str:
    """``<p>moves``: by row, tree and feature, how far each step moved the value."""
    parts = [f"SELECT rid, tree, split_on AS f, value - before AS moved FROM {p}p{k} WHERE open" for k in range(1, depth + 1)]
    return f"{p}moves AS ({' UNION ALL '.join(parts)})"


def boost(n: int, rounds: int, depth: int, p: str = "z", bins: int = T.BINS) -> str:
    """``<p>score`` (rid, margin, probability) after so many rounds."""

    def worth(a, b):
        return f"({a} / {ONE}) * ({a} / {ONE}) / ({b} / {ONE} + {T.PENALTY}) / 2"

    def value(a, b):
        return f"-({a} / {ONE}) / ({b} / {ONE} + {T.PENALTY}) * {T.RATE}"

    out = [*_bins(p, n, bins), f"{p}m0 AS (SELECT rid, key, y, train, 0.0::DOUBLE AS margin FROM src)"]
    for turn in range(rounds):
        q = f"{p}{turn}_"
        chance = "(1.0 / (exp(-margin) + 1))"
        out += [
            f"""{q}h AS MATERIALIZED (SELECT rid, round(({chance} - y) * {ONE})::BIGINT AS ga, round({chance} * (1 - {chance}) * {ONE})::BIGINT AS gb
                FROM {p}m{turn} WHERE train)""",
            f"{q}bins AS (SELECT * FROM {p}bins)",
            f"{q}p0 AS (SELECT rid, key, {turn} AS tree, 0 AS node, NULL::DOUBLE AS value, true AS open FROM {p}m{turn})",
        ]
        for level in range(depth):
            at = f"{q}p{level}"
            sums = f"sum(ga) AS a, sum(gb) AS b FROM {at} JOIN {q}h USING (rid) JOIN {p}bins USING (rid) WHERE open"
            out += _splits(q, at, level, sums, "", worth, lambda a, b: f"{b} / {ONE} >= {T.LEAST_CURVATURE}")
            out.append(_step(q, at, level, value))
        out.append(f"{p}m{turn + 1} AS MATERIALIZED (SELECT m.rid, m.key, m.y, m.train, m.margin + coalesce(q.value, 0) AS margin FROM {p}m{turn} m JOIN {q}p{depth} q USING (rid))")
    out.append(f"{p}score AS (SELECT rid, margin, 1.0 / (exp(-margin) + 1) AS probability FROM {p}m{rounds})")
    return ",\n".join(out)
