"""SQL texts for the searches over feature subsets: rounds in a recursive query that scores the
subsets it visits, and no others."""

from __future__ import annotations

from vectorloom.plans.oracles import (
    DIM,
    FOLD_MEMBERS,
    FOLDS,
    HOLDOUT,
    ITEMS,
    LETTERS,
    LEVELS,
    ORACLES,
    letters_cte,
    level,
    split_cte,
)


def memory(seeds) -> str:
    """Item memories of several seeds."""
    listed = ", ".join(map(str, seeds))
    return f"""grid AS (SELECT s.s AS seed, a.l AS level, b.d AS d FROM range({LEVELS}) a(l),
  range({DIM}) b(d), (SELECT unnest([{listed}]) AS s) s),
ranked AS (SELECT seed, level, d, row_number() OVER (PARTITION BY seed, level
  ORDER BY md5(seed || ':' || level || ':' || d), d) AS r FROM grid),
flips AS (SELECT seed, level, d, CASE WHEN r <= CASE WHEN level = 0 THEN {DIM // 2}
  ELSE {DIM // 2 // LEVELS} END THEN 1 ELSE 0 END AS f FROM ranked),
memory AS MATERIALIZED (SELECT seed, level, d, CASE WHEN sum(f) OVER (PARTITION BY seed, d
  ORDER BY level) % 2 = 1 THEN 1 ELSE -1 END AS sign FROM flips)"""


def prepared(source: str, folds: int | None, seeds) -> list[str]:
    """What all rounds share: cells, members, ranges per feature, ranks of classes."""
    member = FOLD_MEMBERS if folds else split_cte() + ",\n" + HOLDOUT
    member = member.replace("member AS (", "member AS MATERIALIZED (")
    return [
        source, member, memory(seeds),
        """all_cells AS MATERIALIZED (SELECT row_id, unnest(features) AS value,
  unnest(range(len(features))) AS pos FROM emb)""",
        """ends AS MATERIALIZED (SELECT model, pos, min(value) AS lo, max(value) AS hi
  FROM all_cells JOIN member USING (row_id) WHERE train GROUP BY ALL)""",
        """ranks AS MATERIALIZED (SELECT m.model, m.label, row_number() OVER (PARTITION BY m.model
  ORDER BY min(row_pos)) AS rank FROM member m JOIN emb USING (row_id) WHERE train
  GROUP BY m.model, m.label)""",
    ]


def scored(todo: str) -> str:
    """CTEs ending in ``acc`` (seed, mask, a): the accuracy of the subsets in ``todo``. A row is
    scored by adding up, over its cells, the product of its level with each class vector."""
    new_pos = "bit_count(mask & ((1::BIGINT << pos) - 1))"
    return f"""
wanted AS (SELECT DISTINCT seed, mask FROM {todo}),
edges AS (SELECT seed, mask, model, min(lo) AS lo, max(hi) AS hi FROM wanted JOIN ends
  ON (mask >> pos) & 1 = 1 GROUP BY ALL),
leveled AS (SELECT model, lo, hi, row_id, label, train, test, pos,
  {level('value', 'lo', 'hi')} AS level FROM (SELECT DISTINCT model, lo, hi FROM edges)
  JOIN member USING (model) JOIN all_cells USING (row_id)),
used AS (SELECT model, lo, hi, label, pos, level, count(*) AS n FROM leveled WHERE train
  GROUP BY ALL),
classes AS (SELECT seed, mask, model, label, (d + {new_pos}) % {DIM} AS d,
  CAST(sum(n * sign) AS BIGINT) AS c FROM edges JOIN used USING (model, lo, hi)
  JOIN memory USING (seed, level) WHERE (mask >> pos) & 1 = 1 GROUP BY ALL),
lengths AS (SELECT seed, mask, model, label, sqrt(CAST(sum(c * c) AS DOUBLE)) AS len FROM classes
  GROUP BY ALL),
places AS (SELECT seed, mask, pos, level, (d + {new_pos}) % {DIM} AS d, sign FROM wanted
  JOIN memory USING (seed) JOIN (SELECT DISTINCT pos FROM ends) p ON (mask >> pos) & 1 = 1),
products AS (SELECT seed, mask, model, label, pos, level, CAST(sum(sign * c) AS BIGINT) AS t
  FROM places JOIN classes USING (seed, mask, d) GROUP BY ALL),
tested AS (SELECT model, lo, hi, row_id, pos, level FROM leveled WHERE test),
dots AS (SELECT seed, mask, model, row_id, p.label, CAST(sum(t) AS DOUBLE) AS dot
  FROM edges JOIN tested USING (model, lo, hi)
  JOIN products p USING (seed, mask, model, pos, level) GROUP BY ALL),
guessed AS (SELECT seed, mask, model, row_id, label AS guess, row_number() OVER (
    PARTITION BY seed, mask, model, row_id
    ORDER BY round(dot / nullif(len, 0), 9) DESC NULLS LAST, rank) AS r
  FROM dots d JOIN lengths USING (seed, mask, model, label) JOIN ranks USING (model, label)),
per_model AS (SELECT seed, mask, model, round(100 * avg(CASE WHEN guess = label THEN 1 ELSE 0 END),
  2) AS a FROM guessed JOIN member USING (model, row_id) WHERE r = 1 GROUP BY ALL),
acc AS (SELECT seed, mask, round(avg(a), 2) AS a FROM per_model GROUP BY ALL)"""


def rounds(name: str, chunks: str, n: int, tolerance: float, threshold: float,
           group_min: int = 1) -> str:
    """``name`` (seed, chunk, round, base, size, kept, accs, best): the rounds of an elimination
    from every row of ``chunks`` (seed, chunk, full_mask)."""
    return f"""{name} AS (SELECT seed, chunk, -1 AS round, full_mask AS base, 0 AS size,
    [full_mask] AS kept, [0.0::DOUBLE] AS accs, 0.0::DOUBLE AS best FROM {chunks}
  UNION ALL (
    WITH state AS (SELECT seed, chunk, round, list_reduce(kept, lambda a, b: a & b) AS base
      FROM {name} WHERE round = -1 OR (size - 1 >= {group_min} AND best >= {threshold})),
    todo AS (SELECT seed, chunk, round + 1 AS round, base, unnest(CASE WHEN round = -1
      THEN [base] ELSE list_transform(list_filter(range({n}), lambda i: (base >> i) & 1 = 1),
        lambda i: base - (1::BIGINT << i)) END) AS mask
      FROM state WHERE round = -1 OR bit_count(base) > 1), {scored('todo')},
    judged AS (SELECT t.*, a, max(a) OVER (PARTITION BY seed, chunk) AS best
      FROM todo t JOIN acc USING (seed, mask))
    SELECT seed, chunk, round, base, CAST(bit_count(any_value(mask)) AS INTEGER),
      list(mask ORDER BY mask) FILTER (a >= best - best * {tolerance} / 100.0),
      list(a ORDER BY mask) FILTER (a >= best - best * {tolerance} / 100.0), best
    FROM judged GROUP BY seed, chunk, round, base, best))"""


def best_round(name: str, search: str) -> str:
    """``name`` (seed, chunk, size, best, selected): the best group of every search."""
    return f"""{name} AS (SELECT seed, chunk, size, best,
  list_reduce(kept, lambda a, b: a | b) AS selected FROM (SELECT *, row_number() OVER (
    PARTITION BY seed, chunk ORDER BY best DESC, size) AS place FROM {search} WHERE round >= 0)
  WHERE place = 1)"""


def _with(parts) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


def _listed(names) -> str:
    return "[" + ", ".join(f"'{x}'" for x in names) + "]"


def _features(mask: str, names) -> str:
    return (f"list_transform(list_filter(range({len(names)}), lambda i: ({mask} >> i) & 1 = 1), "
            f"lambda i: {_listed(names)}[i + 1])")


def whole(n: int, seed: int = 0) -> str:
    return f"chunks AS (SELECT {seed} AS seed, 0 AS chunk, {(1 << n) - 1}::BIGINT AS full_mask)"


def chunked(name: str, survivors: str, names, size: int) -> str:
    """``name``: random chunks of the survivors (seed, mask), drawn by the seed."""
    return f"""{name} AS (SELECT seed, chunk, bit_or(1::BIGINT << pos) AS full_mask FROM (
  SELECT seed, pos, CAST((row_number() OVER (PARTITION BY seed ORDER BY
    md5(seed || ':' || feature), feature) - 1) // {size} AS INTEGER) AS chunk
  FROM (SELECT seed, pos, {_listed(names)}[pos + 1] AS feature FROM {survivors},
    range({len(names)}) r(pos) WHERE (mask >> pos) & 1 = 1)) GROUP BY seed, chunk)"""


def selection(source, names, folds, tolerance, threshold, chunks: str | None = None) -> str:
    n = len(names)
    parts = [*prepared(source, folds, [0]), chunks or whole(n),
             rounds("search", "chunks", n, tolerance, threshold), best_round("found", "search")]
    return _with(parts) + f"""SELECT CAST(chunk AS INTEGER) AS chunk, size AS group_size,
  best AS accuracy, unnest({_features('selected', names)}) AS feature FROM found"""


def retained(source, names, folds, tolerance, threshold) -> str:
    """Retained runs; ``names`` must be in alphabetical order."""
    n = len(names)
    parts = [*prepared(source, folds, [0]), whole(n),
             rounds("search", "chunks", n, tolerance, threshold)]
    return _with(parts) + f"""SELECT md5('[''' || array_to_string({_features('mask', names)},
    ''', ''') || ''']') AS run_id, size AS group_size, a AS accuracy, 0 AS iteration,
  coalesce(array_to_string({_features('(base - mask)', names)}, ','), '') AS excluded
FROM (SELECT *, unnest(kept) AS mask, unnest(accs) AS a FROM search WHERE round >= 0)"""


def importance(source, names, folds, chunk_size, seeds, tolerance, threshold, runs: int) -> str:
    """Runs of every seed until the number of survivors stays, and one more on all of them;
    ``runs`` is how many the text spells out (further ones would be missing)."""
    n = len(names)
    listed = ", ".join(map(str, seeds))
    parts = [*prepared(source, folds, seeds),
             f"""s0 AS (SELECT unnest([{listed}]) AS seed, {(1 << n) - 1}::BIGINT AS mask, 0 AS before,
  false AS final)"""]
    for k in range(runs):
        parts += [
            chunked(f"cut{k}", f"(SELECT * FROM s{k} WHERE NOT final)", names, chunk_size),
            f"""chunks{k} AS MATERIALIZED (SELECT * FROM cut{k} UNION ALL SELECT seed, 0, mask FROM s{k}
  WHERE final)""",
            rounds(f"search{k}", f"chunks{k}", n, tolerance, threshold),
            best_round(f"found{k}", f"search{k}").replace(" AS (", " AS MATERIALIZED (", 1),
            f"""s{k + 1} AS MATERIALIZED (SELECT seed, mask, CAST(bit_count(mask) AS INTEGER) AS before,
  bit_count(mask) = before AS final FROM (SELECT f.seed, bit_or(selected) AS mask,
    any_value(before) AS before FROM found{k} f JOIN s{k} USING (seed) WHERE NOT final
    GROUP BY f.seed))""",
        ]
    last = " UNION ALL ".join(f"SELECT seed, selected FROM found{k} JOIN s{k} USING (seed) "
                              "WHERE final" for k in range(runs))
    return _with([*parts, f"last AS ({last})"]) + f"""SELECT feature,
  count(DISTINCT seed) AS n_selected, {len(seeds)} AS n_seeds,
  count(DISTINCT seed) / {float(len(seeds))} AS frequency
FROM (SELECT seed, unnest({_features('selected', names)}) AS feature FROM last) GROUP BY feature"""


_LETTERS = letters_cte(LETTERS, True)
ORACLES["language_feature_elimination"] = selection(_LETTERS, LETTERS, None, 5.0, 60.0)
ORACLES["language_elimination_runs"] = retained(_LETTERS, LETTERS, FOLDS, 1.0, 60.0)
ORACLES["chunked_selection"] = selection(
    _LETTERS, LETTERS, None, 5.0, 0.0,
    f"all_letters AS (SELECT 0 AS seed, {(1 << len(LETTERS)) - 1}::BIGINT AS mask),\n"
    + chunked("chunks", "all_letters", LETTERS, 9))
ORACLES["language_elimination_deep"] = retained(_LETTERS, LETTERS, None, 0.0, 0.0)
ORACLES["backward_selection"] = selection(
    ITEMS, ["quantity", "extendedprice", "discount", "tax"], None, 5.0, 0.0)
ORACLES["selection_report"] = ORACLES["language_feature_elimination"]
ORACLES["run_summary"] = f"""SELECT run_id, group_size, accuracy, 'letters' AS dataset,
  {DIM} AS dimensionality, {LEVELS} AS n_levels, 1.0::DOUBLE AS tolerance
FROM ({ORACLES["language_elimination_runs"]})"""
ORACLES["feature_importance"] = importance(_LETTERS, LETTERS, None, 9, [1, 2], 5.0, 60.0, 6)
