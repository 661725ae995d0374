"""SQL texts for DuckDB that compute the catalogue's results independently."""

from __future__ import annotations

DIM, LEVELS, SEED = 64, 8, 0
PERCENT, FOLDS = 80, 5
LETTERS = "abcdefghijklmnopqrstuvwxyz"

EMB = """emb AS (SELECT vec_id AS row_id, vec_id AS row_pos, CAST(label AS VARCHAR) AS label,
  CAST(embedding AS DOUBLE[]) AS features FROM embeddings)"""
ITEMS = """emb AS (SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber,
  CAST(l_quantity AS BIGINT)) AS row_id, CAST('0x' || substr(md5(row_id), 1, 15) AS BIGINT) AS row_pos, l_returnflag AS label,
  [l_quantity, l_extendedprice, l_discount, l_tax] AS features FROM lineitem)"""


def letters_cte(letters: str, shares: bool) -> str:
    one = "length(t) - length(replace(t, '{}', ''))"
    cells = ", ".join(f"CAST({one.format(c)} AS DOUBLE)" for c in letters)
    out = "list_transform(f, lambda v: coalesce(v / nullif(n, 0), 0.0))" if shares else "f"
    return f"""raw AS (SELECT doc_id, lang, lower(text) AS t FROM documents),
counted AS (SELECT doc_id, lang, length(t) AS n, [{cells}] AS f FROM raw),
emb AS (SELECT doc_id AS row_id, doc_id AS row_pos, lang AS label, {out} AS features FROM counted)"""


MEMORY = f"""grid AS (SELECT a.l AS level, b.d AS d FROM range({LEVELS}) a(l), range({DIM}) b(d)),
ranked AS (SELECT level, d, row_number() OVER (PARTITION BY level
  ORDER BY md5('{SEED}:' || level || ':' || d), d) AS r FROM grid),
flips AS (SELECT level, d, CASE WHEN r <= CASE WHEN level = 0 THEN {DIM // 2}
  ELSE {DIM // 2 // LEVELS} END THEN 1 ELSE 0 END AS f FROM ranked),
memory AS (SELECT level, d, CASE WHEN sum(f) OVER (PARTITION BY d ORDER BY level) % 2 = 1
  THEN 1 ELSE -1 END AS sign FROM flips)"""

CELLS = """cells AS (SELECT row_id, label, unnest(features) AS value,
  unnest(range(len(features))) AS pos FROM emb)"""


def level(value: str, lo: str, hi: str) -> str:
    return (f"greatest(len(list_filter(range({LEVELS}), lambda k: {lo} + k * (({hi} - {lo}) "
            f"/ {LEVELS}) <= {value})) - 1, 0)")


def split_cte() -> str:
    return f"""split AS (SELECT row_id, label, row_number() OVER (PARTITION BY label
  ORDER BY md5('{SEED}:' || row_id), row_id) <= floor(count(*) OVER (PARTITION BY label)
  * {PERCENT} / 100.0) AS is_train FROM emb)"""


# Rows with their model: every model trains on rows with train = true and tests the others.
ALL_TRAIN = "member AS (SELECT 0 AS model, row_id, label, true AS train, true AS test FROM emb)"
HOLDOUT = ("member AS (SELECT 0 AS model, row_id, label, is_train AS train, "
           "NOT is_train AS test FROM split)")
FOLD_MEMBERS = f"""folds AS (SELECT row_id, label, features, row_pos % {FOLDS} AS fold FROM emb),
copies AS (SELECT DISTINCT features, fold FROM folds),
member AS (SELECT g.m AS model, f.row_id, f.label, c.fold IS NULL AS train, f.fold = g.m AS test
  FROM folds f CROSS JOIN range({FOLDS}) g(m)
  LEFT JOIN copies c ON c.features = f.features AND c.fold = g.m)"""


def model_ctes() -> str:
    """Edges, encoded rows, class vectors and guesses of every model of ``member``."""
    return f"""edges AS (SELECT model, min(value) AS lo, max(value) AS hi
  FROM cells JOIN member USING (row_id) WHERE train GROUP BY model),
leveled AS (SELECT model, row_id, pos, {level('value', 'lo', 'hi')} AS level FROM cells, edges),
encoded AS (SELECT model, row_id, (d + pos) % {DIM} AS d, CAST(sum(sign) AS BIGINT) AS h
  FROM leveled JOIN memory USING (level) GROUP BY ALL),
classes AS (SELECT model, label, d, CAST(sum(h) AS BIGINT) AS c FROM encoded
  JOIN member USING (model, row_id) WHERE train GROUP BY ALL),
ranks AS (SELECT model, label, row_number() OVER (PARTITION BY model ORDER BY first) - 1 AS rank
  FROM (SELECT model, m.label, min(row_pos) AS first FROM member m JOIN emb USING (row_id)
    WHERE train GROUP BY ALL))"""


def scores(classes: str, name: str) -> str:
    """Cosine of every row and class of its models."""
    return f"""{name} AS (SELECT model, row_id, label AS guess, rank, cos FROM (
  SELECT model, row_id, c.label, CAST(sum(h * c.c) AS DOUBLE)
    / nullif(sqrt(CAST(sum(h * h) AS DOUBLE)) * sqrt(CAST(sum(c.c * c.c) AS DOUBLE)), 0) AS cos
  FROM encoded JOIN {classes} c USING (model, d) GROUP BY ALL) s JOIN ranks USING (model, label))"""


def guesses(source: str, name: str) -> str:
    return f"""{name} AS (SELECT model, row_id, m.label, guess, cos, train, test FROM (
  SELECT *, row_number() OVER (PARTITION BY model, row_id
    ORDER BY round(cos, 12) DESC NULLS LAST, rank) AS best FROM {source}) g
  JOIN member m USING (model, row_id) WHERE best = 1)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def classifier(source: str, members: str, final: str, *more: str) -> str:
    split = [split_cte()] if members is HOLDOUT else []
    return with_(source, *split, members, CELLS, MEMORY, model_ctes(), scores("classes", "scored"),
                 guesses("scored", "guessed"), *more) + final


ACCURACY = "round(100 * avg(CASE WHEN guess = label THEN 1 ELSE 0 END), 2)"
ALL_EDGES = "edges AS (SELECT min(value) AS lo, max(value) AS hi FROM cells)"
ENCODED = f"""leveled AS (SELECT row_id, label, pos, {level('value', 'lo', 'hi')} AS level
  FROM cells, edges),
encoded AS (SELECT row_id, label, (d + pos) % {DIM} AS d, CAST(sum(sign) AS BIGINT) AS h
  FROM leveled JOIN memory USING (level) GROUP BY ALL)"""
ENCODE = with_(EMB, CELLS, MEMORY, ALL_EDGES, ENCODED) + "SELECT row_id, d, h FROM encoded"


def class_vectors(source: str) -> str:
    return with_(source, CELLS, MEMORY, ALL_EDGES,
                 f"""used AS (SELECT label, pos, {level('value', 'lo', 'hi')} AS level, count(*) AS n
  FROM cells, edges GROUP BY ALL)""") + f"""
SELECT label, class_rank, (d + pos) % {DIM} AS d, CAST(sum(n * sign) AS BIGINT) AS h
FROM used JOIN memory USING (level) JOIN (
  SELECT label, row_number() OVER (ORDER BY min(row_pos)) - 1 AS class_rank FROM emb GROUP BY label)
USING (label) GROUP BY ALL"""


def batch_pass(step: int) -> list[str]:
    """Class vectors after one more pass over the training rows with fixed classes."""
    before, guessed = ("classes", "guessed") if step == 1 else (f"classes{step - 1}",
                                                                 f"guessed{step - 1}")
    return [
        f"wrong{step} AS (SELECT model, row_id, label, guess FROM {guessed} "
        "WHERE train AND guess <> label)",
        f"""moved{step} AS (SELECT model, label, d, h FROM encoded JOIN wrong{step} USING (model, row_id)
  UNION ALL SELECT model, guess AS label, d, -h FROM encoded JOIN wrong{step} USING (model, row_id))""",
        f"""classes{step} AS (SELECT model, label, d, CAST(sum(c) AS BIGINT) AS c FROM (
  SELECT * FROM {before} UNION ALL SELECT model, label, d, h AS c FROM moved{step}) GROUP BY ALL)""",
        scores(f"classes{step}", f"scored{step}"), guesses(f"scored{step}", f"guessed{step}"),
    ]


def history_row(step: int) -> str:
    now = "guessed" if step == 0 else f"guessed{step}"
    error = "CAST(NULL AS DOUBLE)" if step == 0 else (
        f"(SELECT round(avg(CASE WHEN guess <> label THEN 1 ELSE 0 END), 9) "
        f"FROM {'guessed' if step == 1 else f'guessed{step - 1}'} WHERE train)")
    return f"SELECT {step} AS iteration, {error} AS error, {ACCURACY} AS accuracy FROM {now} WHERE test"


def online_history(source: str, passes: int, stop: bool) -> str:
    """The online perceptron as a recursion over (pass, row): the state is one list with
    all class vectors end to end."""
    dot = ("list_aggregate(list_transform(range({D}), lambda i: "
           "CAST({a} AS DOUBLE) * CAST({b} AS DOUBLE)), 'sum')")
    of_class = f"s.v[c * {DIM} + i + 1]"
    cosine = (f"{dot.format(D=DIM, a=of_class, b='r.hv[i + 1]')} / nullif(sqrt("
              f"{dot.format(D=DIM, a=of_class, b=of_class)}), 0)")
    ctes = [
        source, split_cte(), HOLDOUT, CELLS, MEMORY, model_ctes(),
        "vectors AS (SELECT row_id, list(h ORDER BY d) AS hv FROM encoded GROUP BY row_id)",
        """train_rows AS (SELECT row_number() OVER (ORDER BY row_pos) AS at, hv, rank AS true_class
  FROM vectors JOIN member m USING (row_id) JOIN emb USING (row_id)
  JOIN ranks k ON k.label = m.label WHERE train)""",
        """test_rows AS (SELECT row_id, hv, rank AS true_class FROM vectors
  JOIN member m USING (row_id) LEFT JOIN ranks k ON k.label = m.label WHERE test)""",
        "size AS (SELECT count(*) AS n, (SELECT count(*) FROM ranks) AS k FROM train_rows)",
        """start AS (SELECT list(c ORDER BY rank, d) AS v FROM classes
  JOIN ranks USING (model, label))""",
        f"""walk AS (SELECT CAST(0 AS BIGINT) AS step, v, CAST(0 AS BIGINT) AS wrong FROM start
  UNION ALL
  SELECT step + 1, CASE WHEN guess = true_class THEN v ELSE list_transform(v, lambda x, j:
      x + CASE (j - 1) // {DIM} WHEN guess THEN -hv[(j - 1) % {DIM} + 1]
                                WHEN true_class THEN hv[(j - 1) % {DIM} + 1] ELSE 0 END) END,
    CASE WHEN (step % n) = 0 THEN 0 ELSE wrong END + CASE WHEN guess = true_class THEN 0 ELSE 1 END
  FROM (SELECT s.step, s.v, s.wrong, r.hv, r.true_class, z.n,
      list_position(cosines, list_max(cosines)) - 1 AS guess
    FROM (SELECT s.*, r.hv AS rhv, list_transform(range(z.k), lambda c: coalesce(round({cosine}, 9),
        -1e300)) AS cosines FROM walk s, size z, train_rows r
        WHERE r.at = s.step % z.n + 1 AND s.step < z.n * {passes}) s, size z, train_rows r
    WHERE r.at = s.step % z.n + 1))""",
        """passes AS (SELECT CAST(step // n AS INTEGER) AS iteration, v,
    CASE WHEN step > 0 THEN round(wrong / n, 9) END AS error FROM walk, size WHERE step % n = 0)""",
        f"""tested AS (SELECT iteration, error, true_class,
    list_position(cosines, list_max(cosines)) - 1 AS guess FROM (
      SELECT s.iteration, s.error, r.true_class, list_transform(range(z.k), lambda c:
        coalesce(round({cosine}, 9), -1e300)) AS cosines FROM passes s, test_rows r, size z))""",
        """history AS (SELECT iteration, error, round(100 * avg(CASE WHEN guess = true_class THEN 1
    ELSE 0 END), 2) AS accuracy FROM tested GROUP BY ALL)""",
    ]
    keep = ""
    if stop:
        keep = """ WHERE iteration <= coalesce((SELECT min(b.iteration) FROM history a JOIN history b
  ON b.iteration = a.iteration + 1 AND a.error = b.error), 1000000)"""
    return "WITH RECURSIVE " + ",\n".join(ctes) + f"""
SELECT iteration, error, accuracy FROM history{keep}"""


HISTORY = """hist AS (SELECT event_type AS run_id, user_id AS model_id, event_id AS iteration,
  round(value, 2) AS accuracy FROM events)"""
BEST = """best AS (SELECT run_id, model_id, max(accuracy) AS accuracy,
  arg_min(iteration, (-accuracy, iteration)) AS iteration FROM hist GROUP BY ALL)"""
RUNS = """prices AS (SELECT p_brand, p_name, CAST(sum(p_size) AS DOUBLE) / count(*) * 2 AS accuracy FROM part GROUP BY ALL),
sets AS (SELECT p_brand, list_sort(list(p_name)) AS f FROM prices GROUP BY ALL),
runs AS (SELECT p_brand, list_filter(f, lambda x: x <> p_name) AS features, p_name AS excluded,
  accuracy, md5('[''' || array_to_string(list_filter(f, lambda x: x <> p_name), ''', ''') || ''']')
  AS run_id, len(f) - 1 AS group_size FROM prices JOIN sets USING (p_brand))"""
RETAINED = """kept AS (SELECT * FROM (SELECT *, max(accuracy) OVER (PARTITION BY p_brand, group_size)
  AS top FROM runs) WHERE accuracy >= top - top * 5.0 / 100.0)"""
SELECTIONS = """sel AS (SELECT user_id AS seed, CAST(regexp_extract(props, '"k": ([0-9]+)', 1)
  AS INTEGER) AS run, event_type AS feature FROM events)"""
LAST = "last AS (SELECT s.* FROM sel s JOIN (SELECT seed, max(run) AS run FROM sel GROUP BY seed) USING (seed, run))"
FREQUENCY = """freq AS (SELECT feature, count(DISTINCT seed) AS n_selected,
  (SELECT count(DISTINCT seed) FROM last) AS n_seeds FROM last GROUP BY feature)"""
NAMES = "names AS (SELECT p_name AS name, row_number() OVER (ORDER BY p_name) - 1 AS pos FROM (SELECT DISTINCT p_name FROM part))"
SIZE_TEXT = "CASE WHEN p_size % 2 = 1 THEN NULL ELSE CAST(p_size AS DOUBLE) END"
TAXA = """taxa AS (SELECT 's__' || p_partkey AS taxon, [CAST(p_size AS DOUBLE),
  CAST(p_partkey AS DOUBLE), 0.5] AS v FROM part WHERE p_size <= 25)"""

_CHUNK = f"""CAST(floor((row_number() OVER (ORDER BY md5('{SEED}:' || name), name) - 1) / {{}})
  AS INTEGER) AS chunk"""

ORACLES = {
    "level_edges": f"""SELECT min(v) AS lo, max(v) AS hi, (max(v) - min(v)) / {LEVELS} AS gap,
  {LEVELS} AS n_levels FROM (SELECT unnest(CAST(embedding AS DOUBLE[])) AS v FROM embeddings)""",
    "level_edges_by_class": with_(ITEMS, CELLS) + f"""SELECT label, min(value) AS lo,
  max(value) AS hi, (max(value) - min(value)) / {LEVELS} AS gap, {LEVELS} AS n_levels
  FROM cells GROUP BY label""",
    "quantise_levels": with_(EMB, CELLS, ALL_EDGES)
    + f"SELECT row_id, pos, {level('value', 'lo', 'hi')} AS level FROM cells, edges",
    "item_memory_usage": with_(EMB, CELLS, ALL_EDGES, MEMORY, f"""used AS (SELECT
  {level('value', 'lo', 'hi')} AS level, count(*) AS n FROM cells, edges GROUP BY ALL)""")
    + """SELECT m.level, m.d, m.sign, coalesce(n, 0) AS n_cells FROM memory m
  LEFT JOIN used USING (level)""",
    "encode_rows": ENCODE,
    "encode_rows_native": ENCODE,
    "encode_rows_blocked": ENCODE,
    "class_hypervectors": class_vectors(EMB),
    "line_item_class_vectors": class_vectors(ITEMS),
    "class_similarity": classifier(EMB, ALL_TRAIN, """SELECT row_id, guess AS class_label,
  rank AS class_rank, round(cos, 9) AS similarity FROM scored"""),
    "predict_class": classifier(EMB, ALL_TRAIN, """SELECT row_id, label, guess,
  round(cos, 9) AS similarity FROM guessed"""),
    "vector_helpers": with_(EMB, CELLS, MEMORY, ALL_EDGES, ENCODED, f"""turned AS (SELECT a.row_id, a.d,
  a.h, b.h AS r, CASE WHEN a.d IN (0, {DIM - 1}) THEN -a.h ELSE a.h END AS f
  FROM encoded a JOIN encoded b ON a.row_id = b.row_id AND a.d = (b.d + a.row_id) % {DIM})""") + """
SELECT row_id, CAST(sum((h + r) * (h + r)) AS BIGINT) AS sum_squares,
  CAST(sum((h - r) * (h - r)) AS BIGINT) AS difference_squares,
  CAST(sum(h * f) AS DOUBLE) AS dot_flipped, round(sqrt(CAST(sum(h * h) AS DOUBLE)), 9) AS norm,
  round(CAST(sum(h * r) AS DOUBLE) / nullif(sqrt(CAST(sum(h * h) AS DOUBLE))
    * sqrt(CAST(sum(r * r) AS DOUBLE)), 0), 9) AS cosine
FROM turned GROUP BY row_id""",
    "stratified_split": with_(EMB, split_cte()) + "SELECT row_id, label, is_train FROM split",
    "line_item_split": with_(ITEMS, split_cte()) + "SELECT row_id, label, is_train FROM split",
    "kfold_assign": f"SELECT vec_id AS row_id, CAST(vec_id % {FOLDS} AS INTEGER) AS fold FROM embeddings",
    "kfold_train_exclusion": with_(letters_cte(LETTERS, False), FOLD_MEMBERS)
    + "SELECT CAST(model AS INTEGER) AS fold, row_id FROM member WHERE train",
    "feature_chunks": with_(NAMES) + f"SELECT pos, name, {_CHUNK.format(10)} FROM names",
    "label_permutation": f"""WITH reps AS (SELECT CAST(r.i AS INTEGER) AS replicate, vec_id,
    CAST(label AS VARCHAR) AS label FROM embeddings, range(3) r(i)),
  a AS (SELECT *, row_number() OVER (PARTITION BY replicate ORDER BY vec_id) AS k FROM reps),
  b AS (SELECT replicate, label, row_number() OVER (PARTITION BY replicate
    ORDER BY md5(replicate || ':{SEED}:' || vec_id), vec_id) AS k FROM reps)
SELECT a.replicate, a.vec_id AS row_id, b.label FROM a JOIN b USING (replicate, k)""",
    "loo_candidates": with_(RUNS) + "SELECT p_brand, run_id, group_size, excluded FROM runs",
    "run_ids": with_(RUNS) + """SELECT p_brand, md5('[''' || array_to_string(f, ''', ''') || ''']')
  AS run_id, len(f) AS n_features FROM sets""",
    "language_holdout": classifier(letters_cte(LETTERS, True), HOLDOUT,
                                   """SELECT row_id, label, guess, round(cos, 9) AS similarity
  FROM guessed WHERE test"""),
    "language_accuracy": classifier(letters_cte(LETTERS, True), HOLDOUT,
                                    f"SELECT {ACCURACY} AS accuracy FROM guessed WHERE test"),
    "holdout_accuracy": classifier(EMB, HOLDOUT,
                                   f"SELECT {ACCURACY} AS accuracy FROM guessed WHERE test"),
    "line_item_holdout": classifier(ITEMS, HOLDOUT,
                                    f"SELECT {ACCURACY} AS accuracy FROM guessed WHERE test"),
    "cv_accuracy": classifier(EMB, FOLD_MEMBERS, f"""SELECT 'all' AS run_id,
  round(avg(accuracy), 2) AS accuracy, 0 AS iteration FROM (SELECT model, {ACCURACY} AS accuracy
  FROM guessed WHERE test GROUP BY model)"""),
    "cv_history": classifier(EMB, FOLD_MEMBERS, f"""SELECT 'fold ' || model AS model_id,
  0 AS iteration, {ACCURACY} AS accuracy FROM guessed WHERE test GROUP BY model"""),
    "language_cv": classifier(letters_cte(LETTERS, False), FOLD_MEMBERS, f"""SELECT
  'fold ' || model AS model_id, {ACCURACY} AS accuracy FROM guessed WHERE test GROUP BY model"""),
    "retrain_batch_history": classifier(
        EMB, HOLDOUT, "\nUNION ALL ".join(history_row(i) for i in range(3)),
        *batch_pass(1), *batch_pass(2)),
    "retrain_online_history": online_history(EMB, 3, False),
    "language_online_history": online_history(letters_cte(LETTERS, True), 5, True),
    "best_iteration": with_(HISTORY) + """SELECT model_id, max(accuracy) AS accuracy,
  arg_min(iteration, (-accuracy, iteration)) AS iteration FROM hist GROUP BY model_id""",
    "fold_mean": with_(HISTORY, BEST) + """SELECT run_id, round(avg(accuracy), 2) AS accuracy,
  CAST(floor(avg(iteration)) AS INTEGER) AS iteration FROM best GROUP BY run_id""",
    "retain_runs": with_(RUNS, RETAINED) + "SELECT p_brand, run_id, accuracy FROM kept",
    "next_base": with_(RUNS, RETAINED, """total AS (SELECT p_brand, group_size,
  count(*) AS n FROM kept GROUP BY ALL),
seen AS (SELECT p_brand, group_size, feature, count(*) AS n FROM (SELECT p_brand, group_size,
  unnest(features) AS feature FROM kept) GROUP BY ALL)""") + """
SELECT p_brand, group_size, CAST(count(*) OVER (PARTITION BY p_brand, group_size) - 1 AS INTEGER)
  AS next_size, feature FROM seen JOIN total USING (p_brand, group_size, n)""",
    "best_group": with_(RUNS, """kept AS (SELECT * FROM (SELECT *, max(accuracy) OVER (
  PARTITION BY group_size) AS top FROM runs) WHERE accuracy >= top - top * 5.0 / 100.0)""",
                        """won AS (SELECT group_size, max(accuracy) AS accuracy FROM kept
  GROUP BY group_size ORDER BY accuracy DESC, group_size LIMIT 1)""") + """
SELECT DISTINCT group_size, won.accuracy, unnest(features) AS feature FROM kept
JOIN won USING (group_size)""",
    "selected_count": with_(SELECTIONS)
    + "SELECT seed, run, count(*) AS n_selected FROM sel GROUP BY ALL",
    "last_run_per_seed": with_(SELECTIONS, LAST) + "SELECT seed, run, feature FROM last",
    "selection_frequency": with_(SELECTIONS, LAST, FREQUENCY) + "SELECT * FROM freq",
    "top_features": with_(SELECTIONS, LAST, FREQUENCY) + """SELECT feature, n_selected,
  round(n_selected / n_seeds, 9) AS frequency FROM (SELECT *, row_number() OVER (
    ORDER BY n_selected DESC, feature) AS r, count(*) OVER () AS n FROM freq)
WHERE r <= ceil(n * 50 / 100.0)""",
    "class_membership": """SELECT CAST(label AS VARCHAR) AS label, vec_id AS row_id,
  count(*) OVER (PARTITION BY label) AS n_members FROM embeddings""",
    "shape_report": """SELECT max(len(embedding)) AS n_features, count(*) AS n_rows,
  count(DISTINCT label) AS n_classes FROM embeddings""",
    "recognised_features": """SELECT DISTINCT p_type AS name, true AS recognised FROM part
UNION ALL SELECT DISTINCT p_brand, false FROM part""",
    "project_features": """SELECT vec_id AS row_id, unnest([0, 1, 2]) AS pos,
  unnest([CAST(embedding[4] AS DOUBLE), CAST(embedding[18] AS DOUBLE),
    CAST(embedding[41] AS DOUBLE)]) AS value FROM embeddings""",
    "restrict_features": """SELECT row_number() OVER (ORDER BY p_name) - 1 AS pos, p_name AS name
FROM (SELECT DISTINCT p_name FROM part WHERE p_type = 'ECONOMY')""",
    "parse_labelled_text": f"""SELECT CAST(p_partkey AS VARCHAR) AS row_id, p_type AS label,
  unnest([0, 1]) AS pos, unnest([coalesce({SIZE_TEXT}, 0.0), p_size + 0.5]) AS value
FROM part WHERE p_size > 2""",
    "validate_rows": """SELECT CAST(p_partkey AS VARCHAR) AS row_id, p_size % 2 = 0 AS accepted
FROM part WHERE p_size > 2""",
    "meta_pivot": """SELECT CAST(user_id AS VARCHAR) AS sample,
  min(CASE WHEN event_type = 'click' THEN props END) AS label,
  min(CASE WHEN event_type = 'error' THEN props END) AS platform
FROM events WHERE event_type IN ('click', 'error') GROUP BY user_id""",
    "select_samples": """SELECT p_partkey AS sample, p_type AS label FROM part
WHERE p_brand = 'Brand#3' AND p_type <> 'SMALL'""",
    "sample_lookup": """SELECT p_partkey AS sample, s_name AS label FROM part
LEFT JOIN supplier ON s_suppkey = p_partkey""",
    "lineage_filter": with_(TAXA) + """SELECT taxon, unnest(['sample0', 'sample1', 'sample2'])
  AS sample, unnest(v) AS value FROM taxa""",
    "long_to_matrix": with_(TAXA) + """SELECT unnest(['sample0', 'sample1', 'sample2']) AS row_id,
  CAST(row_number() OVER (ORDER BY taxon) - 1 AS INTEGER) AS pos, taxon AS name,
  unnest(v) AS value FROM taxa""",
    "bed_matrix": """SELECT 'user-' || user_id AS sample,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INTEGER) AS pos,
  CASE WHEN event_type = 'error' THEN 0.0
    ELSE CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE) END AS value FROM events""",
    "sample_classes": "SELECT CAST(p_partkey AS VARCHAR) AS sample, p_type AS label FROM part",
    "flat_export_lines": """SELECT p_partkey AS row_pos, p_partkey || ';' || p_size || '.0;0.5;'
  || p_type AS value FROM part""",
    "chunked_dataset": with_(f"""names AS (SELECT pos, CAST(pos AS VARCHAR) AS name FROM (SELECT
  unnest(range(max(len(embedding)))) AS pos FROM embeddings)),
chunks AS (SELECT pos, {_CHUNK.format(20)} FROM names),
placed AS (SELECT chunk, pos, row_number() OVER (PARTITION BY chunk ORDER BY pos) - 1 AS slot
  FROM chunks)""") + """SELECT chunk, vec_id AS row_id, CAST(slot AS INTEGER) AS pos,
  CAST(embedding[placed.pos + 1] AS DOUBLE) AS value FROM embeddings, placed""",
}

# One elimination round: model m leaves out letter m, and later letters move up by one.
ORACLES["loo_round_accuracy"] = with_(
    letters_cte(LETTERS, True), split_cte(),
    f"""member AS (SELECT g.m AS model, row_id, label, is_train AS train, NOT is_train AS test
  FROM split, range({len(LETTERS)}) g(m))""",
    """all_cells AS (SELECT row_id, label, unnest(features) AS value,
  unnest(range(len(features))) AS pos FROM emb)""",
    f"""cells AS (SELECT g.m AS model, row_id, label, value,
  CASE WHEN pos > g.m THEN pos - 1 ELSE pos END AS pos FROM all_cells, range({len(LETTERS)}) g(m)
  WHERE pos <> g.m)""",
    MEMORY,
    model_ctes().replace("FROM cells JOIN member USING (row_id)",
                         "FROM cells JOIN member USING (model, row_id)")
    .replace("FROM cells, edges", "FROM cells JOIN edges USING (model)"),
    scores("classes", "scored"), guesses("scored", "guessed"),
) + f"""SELECT substr('{LETTERS}', CAST(model AS INTEGER) + 1, 1) AS excluded, {ACCURACY} AS accuracy
FROM guessed WHERE test GROUP BY model"""


# Model 5 is the classifier on the real labels, models 0 to 4 are the permuted replicates.
ORACLES["permutation_null"] = with_(
    EMB,
    "reps AS (SELECT r.i AS model, row_id, label FROM emb, range(5) r(i))",
    "places AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY row_id) AS k FROM reps)",
    f"""drawn AS (SELECT model, label, row_number() OVER (PARTITION BY model
  ORDER BY md5(model || ':{SEED}:' || row_id), row_id) AS k FROM reps)""",
    """relabeled AS (SELECT model, row_id, d.label FROM places JOIN drawn d USING (model, k)
  UNION ALL SELECT 5, row_id, label FROM emb)""",
    f"""ordered AS (SELECT *, row_number() OVER (PARTITION BY model, label
  ORDER BY md5('{SEED}:' || row_id), row_id) <= floor(count(*) OVER (PARTITION BY model, label)
  * {PERCENT} / 100.0) AS train FROM relabeled)""",
    "member AS (SELECT model, row_id, label, train, NOT train AS test FROM ordered)",
    CELLS, MEMORY, model_ctes(), scores("classes", "scored"), guesses("scored", "guessed"),
    f"results AS (SELECT model, {ACCURACY} AS accuracy FROM guessed WHERE test GROUP BY model)",
    "seen AS (SELECT accuracy AS observed FROM results WHERE model = 5)",
) + """SELECT count(*) AS n_replicates, any_value(observed) AS observed, max(accuracy) AS null_max,
  round(avg(accuracy), 9) AS null_mean,
  round((count(*) FILTER (accuracy >= observed) + 1) / (count(*) + 1), 9) AS p_value
FROM results, seen WHERE model <> 5"""

QUALITY = r"""emb AS (SELECT doc_id AS row_id, doc_id AS row_pos, CAST(quality AS VARCHAR) AS label,
  list_transform(['[a-z]', '[A-Z]', '[0-9]', '\s', '[^\w\s]'], lambda k: coalesce(
    CAST(length(text) - length(regexp_replace(text, k, '', 'g')) AS DOUBLE)
    / nullif(length(text), 0), 0.0)) AS features FROM documents JOIN labels USING (doc_id))"""
ORACLES["text_quality_hdc"] = classifier(
    QUALITY, HOLDOUT, f"SELECT {ACCURACY} AS accuracy, 0 AS iteration FROM guessed WHERE test")

# Written and read back: the same tables as before they were written.
ORACLES["store_item_memory"] = ORACLES["item_memory_usage"]
ORACLES["store_encoded_set"] = ENCODE
ORACLES["dataset_round_trip"] = with_(EMB, CELLS) + """SELECT row_id, CAST(pos AS VARCHAR) AS name,
  value FROM cells"""
ORACLES["flat_round_trip"] = with_(EMB, CELLS) + """SELECT CAST(row_id AS VARCHAR) AS row_id,
  row_id AS row_pos, label, 'f' || pos AS name, value FROM cells"""
ORACLES["line_item_label_permutation"] = with_(ITEMS, """places AS (SELECT r.i AS replicate,
  row_id, row_number() OVER (PARTITION BY r.i ORDER BY row_pos, row_id) AS k
  FROM emb, range(2) r(i))""", f"""drawn AS (SELECT r.i AS replicate, label, row_number() OVER (
  PARTITION BY r.i ORDER BY md5(r.i || ':{SEED}:' || row_id), row_pos) AS k
  FROM emb, range(2) r(i))""") + """SELECT CAST(replicate AS INTEGER) AS replicate, row_id, label
FROM places JOIN drawn USING (replicate, k)"""
ORACLES["profile_file"] = ORACLES["lineage_filter"]
ORACLES["sample_class_file"] = ORACLES["sample_classes"]
ORACLES["species_export_file"] = """SELECT 'Profiles;s__a;s__b;Class' AS value UNION ALL
  SELECT p_partkey || ';' || p_size || '.0;0.5;' || p_type FROM part"""
ORACLES["store_clean_up"] = """SELECT unnest(['kept', 'encoded removed', 'all removed']) AS step,
  unnest([count(*), 0, 0]) AS encoded_rows, unnest([true, true, false]) AS has_levels
FROM embeddings"""
ORACLES["feature_list_file"] = ORACLES["recognised_features"]
ORACLES["chunk_files"] = ORACLES["chunked_dataset"]
ORACLES["permutation_files"] = ORACLES["label_permutation"]
ORACLES["run_log"] = f"""SELECT model_id, accuracy, unnest([0, 1]) AS attempt, true AS timed
FROM ({ORACLES["cv_history"]})"""
ORACLES["ranking_report"] = f"""SELECT feature, frequency FROM ({ORACLES["top_features"]})"""
ORACLES["stored_model_predictions"] = ORACLES["predict_class"]

# Columns that are 32-bit integers in Spark.
_INTEGERS = {
    "quantise_levels": ["pos", "level"], "item_memory_usage": ["level", "d"],
    "store_item_memory": ["level", "d"], "encode_rows": ["d"], "encode_rows_native": ["d"],
    "encode_rows_blocked": ["d"], "store_encoded_set": ["d"],
    "class_hypervectors": ["class_rank", "d"], "line_item_class_vectors": ["class_rank", "d"],
    "class_similarity": ["class_rank"], "feature_chunks": ["pos"], "loo_candidates": ["group_size"],
    "run_ids": ["n_features"], "next_base": ["group_size"], "best_group": ["group_size"],
    "shape_report": ["n_features"], "restrict_features": ["pos"],
}
for _name, _columns in _INTEGERS.items():
    _casts = ", ".join(f"CAST({c} AS INTEGER) AS {c}" for c in _columns)
    ORACLES[_name] = f"SELECT * REPLACE ({_casts}) FROM ({ORACLES[_name]})"

ORACLES["selection_tree"] = """WITH picked AS (SELECT DISTINCT p_partkey % 10 AS seed,
  p_size % 3 AS run, p_brand || ' ' || p_type AS feature FROM part),
last AS (SELECT seed, max(run) AS run FROM picked GROUP BY seed)
SELECT feature, count(DISTINCT seed) AS n_selected, (SELECT count(*) FROM last) AS n_seeds
FROM picked JOIN last USING (seed, run) GROUP BY feature"""

_EVENT_FILES = """counts AS (SELECT user_id, event_type, count(*) AS n FROM events
  GROUP BY user_id, event_type),
lines AS (SELECT user_id, event_type AS name, CASE WHEN event_type = 'error' THEN 0.0 ELSE n END
  AS value, row_number() OVER (PARTITION BY user_id ORDER BY event_type) AS up,
  row_number() OVER (PARTITION BY user_id ORDER BY event_type DESC) AS down FROM counts),
placed AS (SELECT user_id, 'user-' || user_id AS sample, name, CAST(value AS DOUBLE) AS value,
  CAST(CASE WHEN user_id % 7 = 3 THEN down ELSE up END - 1 AS INTEGER) AS pos FROM lines),
files AS (SELECT user_id, sample, count(*)::INTEGER AS n_features,
  list(name ORDER BY pos) AS names FROM placed GROUP BY user_id, sample),
told AS (SELECT *, names = first(names) OVER (ORDER BY sample) AS same,
  CASE WHEN user_id % 5 <> 1 THEN CASE WHEN user_id % 2 = 0 THEN 'tumoral' ELSE 'normal' END END
  AS label, 'P' || user_id % 3 AS platform FROM files)"""
ORACLES["bed_files"] = f"""WITH {_EVENT_FILES}
SELECT sample, label, pos, name, value FROM placed JOIN told USING (sample)
WHERE same AND label IS NOT NULL"""
ORACLES["bed_file_report"] = f"""WITH {_EVENT_FILES}
SELECT sample, n_features, same AND label IS NOT NULL AND platform = 'P1' AS accepted, label,
  platform FROM told"""
ORACLES["reject_counts"] = """WITH lines AS (SELECT p_size,
  p_size % 10 = 9 AS wide, p_size % 10 = 4 AND p_size <> 14 AND p_size < 10 AS bad,
  p_size % 2 = 1 AS marked FROM part WHERE p_size > 2)
SELECT count(*) FILTER (NOT wide AND (bad OR marked)) AS rows_with_missing, count(*) AS rows,
  count(*) FILTER (marked) AS missing, count(*) FILTER (bad) + count(*) FILTER (wide)
  AS bad_numbers, count(*) FILTER (wide) AS rejected FROM lines"""
ORACLES["store_two_runs"] = """SELECT fold::INTEGER AS fold,
  CASE WHEN fold = 0 THEN 0 ELSE count(*) END AS encoded_rows
FROM (SELECT vec_id % 3 AS fold FROM embeddings) GROUP BY fold"""
