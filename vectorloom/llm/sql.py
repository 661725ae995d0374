r"""DuckDB SQL with the same columns as the queries that SQL can express."""

from __future__ import annotations

from vectorloom.llm import lines, mixing, quality, ranking, secrets

W = r"[^\x20\x09-\x0D]+"
TRIM = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '"


def measured(docs: str = "documents") -> str:
    """CTEs ending in ``m``: counts, rule values and base_failed per row of ``docs``."""
    return rf"""
src AS (SELECT *, row_number() OVER () AS rn, coalesce(text, '') AS body FROM {docs}),
parts AS (SELECT rn, doc_id, lang, source, body, regexp_extract_all(body, '{W}') AS w,
  list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '{W}')) AS l FROM src),
win AS (SELECT rn, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k
  FROM (SELECT rn, w, unnest(range(1, len(w) - 1)) AS i FROM parts)),
rep AS (SELECT rn, i FROM win
  QUALIFY count(*) OVER (PARTITION BY rn, k) > 1),
cov AS (SELECT rn, sum(least(3, coalesce(nxt - i, 3))) AS n FROM (
  SELECT rn, i, lead(i) OVER (PARTITION BY rn ORDER BY i) AS nxt FROM rep) GROUP BY rn),
c AS (SELECT rn, doc_id, lang, source, len(w)::BIGINT AS n_words,
  length(array_to_string(w, ''))::BIGINT AS word_chars,
  length(regexp_replace(body, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  length(regexp_replace(body, '[^A-Z]', '', 'g'))::BIGINT AS n_capitals,
  len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
  coalesce(n, 0)::BIGINT AS n_repeat_words FROM parts LEFT JOIN cov USING (rn)),
m AS (SELECT *,
  n_words < {quality.MIN_WORDS}
    OR n_repeat_words * 100 > n_words * {quality.MAX_REPEAT_PERCENT} AS base_failed,
  n_symbols * 1000 // greatest(word_chars, 1) AS symbol_share,
  n_capitals * 1000 // greatest(word_chars, 1) AS capital_share,
  n_repeat_words * 1000 // greatest(n_words, 1) AS repeat_share,
  n_dup_lines * 1000 // greatest(n_lines, 1) AS dup_line_share,
  word_chars * 100 // greatest(n_words, 1) AS word_length FROM c)"""


def judged() -> str:
    """CTEs ending in ``v``: m with kept."""
    sk = " UNION ALL ".join(
        f"SELECT lang, source, '{r.name}' AS rule, {r.name} AS val FROM m WHERE NOT base_failed"
        for r in quality.RULES)
    out = [f"""
sk AS (SELECT lang, source, rule, (val >> d) << d AS bucket, count(*) AS n FROM (
  SELECT *, greatest(length(bin(val)) - 7, 0)::INT AS d FROM ({sk})) GROUP BY ALL)"""]
    for name, key in (("own", "lang, source, "), ("bylang", "lang, "), ("everything", "")):
        out.append(f"""
{name}_s AS (SELECT {key}rule, bucket, sum(n) AS n FROM sk GROUP BY ALL),
{name} AS (SELECT {key}rule, max(total) AS n,
  min(CASE WHEN upto * 4 >= total THEN bucket END) AS q1,
  min(CASE WHEN upto * 4 >= total * 3 THEN bucket END) AS q3 FROM (
    SELECT *, sum(n) OVER (PARTITION BY {key}rule) AS total,
      sum(n) OVER (PARTITION BY {key}rule ORDER BY bucket) AS upto FROM {name}_s)
  GROUP BY ALL)""")
    w = quality.WEIGHT
    drawn = ", ".join(f"(o.n * o.{q} + {w} * p.{q})::BIGINT // (o.n + {w})::BIGINT AS {q}"
                      for q in ("q1", "q3"))
    out.append(f"""
prior AS (SELECT o.lang, rule, {drawn} FROM bylang o JOIN everything p USING (rule)),
pair AS (SELECT o.lang, o.source, o.rule, {drawn} FROM own o JOIN prior p
  ON o.lang IS NOT DISTINCT FROM p.lang AND o.rule = p.rule),
fence AS (SELECT lang, source, """ + ", ".join(
        f"max(CASE WHEN rule = '{r.name}' THEN q1 - (q3 - q1) * {quality.SPREAD} - {r.slack}"
        f" END) AS low_{r.name}, max(CASE WHEN rule = '{r.name}' THEN q3 + (q3 - q1) * "
        f"{quality.SPREAD} + {r.slack} END) AS high_{r.name}" for r in quality.RULES)
        + " FROM pair GROUP BY lang, source)")
    tests = []
    for r in quality.RULES:
        for side, op in (("high", "<="),) + ((("low", ">="),) if r.both_sides else ()):
            tests.append(f"coalesce(m.{r.name} {op} f.{side}_{r.name}, TRUE)")
    out.append(f"""
v AS (SELECT m.*, NOT m.base_failed AND {' AND '.join(tests)} AS kept FROM m
  LEFT JOIN fence f ON m.lang IS NOT DISTINCT FROM f.lang
    AND m.source IS NOT DISTINCT FROM f.source)""")
    return ",".join(out)


OP1 = f"""WITH {measured()}, {judged()}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept
FROM v"""


def _segments() -> str:
    rows = []
    for k, knots in enumerate(mixing.SCHEDULES):
        pairs = list(zip(knots, knots[1:], strict=False))
        whole = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in pairs)
        before = 0.0
        for a, b in pairs:
            rows.append(f"({k}, {a[0]!r}::DOUBLE, {a[1] / whole!r}::DOUBLE, "
                        f"{(b[1] - a[1]) / (b[0] - a[0]) / whole!r}::DOUBLE, "
                        f"{before / whole!r}::DOUBLE)")
            before += (b[0] - a[0]) * (a[1] + b[1]) / 2
    return ", ".join(rows)


OP5 = rf"""WITH src AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{W}'))::BIGINT AS size,
    ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS key FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM src GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM per),
weighed AS (SELECT *, [{', '.join(f'{w}::DOUBLE' for w in mixing.WEIGHTS)}]
  [(rank % {len(mixing.WEIGHTS)})::INT + 1] AS weight,
  source_size * {mixing.MOST}::DOUBLE AS cap FROM ranked),
levels AS (SELECT *, (sum(source_size) OVER () * {mixing.SHARE}::DOUBLE
    - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))
    AS level FROM weighed
  WINDOW b AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goal AS (SELECT *, least(cap, weight * (max(level) OVER ())) AS target FROM levels),
placed AS (SELECT s.*, g.source_size, g.target, g.rank, round(g.target)::BIGINT AS words,
  (sum(size) OVER (PARTITION BY g.rank ORDER BY key, doc_id
    ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS before
  FROM src s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source),
cuts AS (SELECT *, CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END AS full_copies
  FROM placed),
taken AS (SELECT *, CASE WHEN source_size > 0 THEN
    greatest(least(words - full_copies * source_size - before, size), 0) ELSE 0 END AS cut
  FROM cuts),
seg(k, t, w, slope, b) AS (VALUES {_segments()}),
timed AS (SELECT x.*, CASE WHEN size > 0 AND (full_copies > 0 OR cut > 0)
    THEN before / words::DOUBLE END AS f FROM taken x),
found AS (SELECT d.*, s.t, s.w, s.slope, f - s.b AS r FROM timed d LEFT JOIN seg s
    ON s.k = d.rank % {len(mixing.SCHEDULES)} AND s.b <= d.f
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s.b DESC NULLS LAST) = 1)
SELECT doc_id, size, source_size, target, (full_copies * size + cut)::BIGINT AS taken,
  ((CASE WHEN size > 0 THEN full_copies ELSE 0 END) + (cut > 0)::INT)::INT AS copies,
  CASE WHEN f IS NOT NULL THEN round(least(t + CASE WHEN r <= 0 THEN 0 ELSE
    r * 2 / (w + sqrt(greatest(w * w + slope * r * 2, 0))) END, 1), 9) END AS position
FROM found"""


def line_cuts(docs: str = "documents") -> str:
    """CTEs ending in ``cut``: rows of ``docs`` with n_lines, n_removed and kept_text."""
    return f"""
lsrc AS (SELECT *, row_number() OVER () AS lrn, string_split(text, chr(10)) AS ls
  FROM {docs}),
lpages AS (SELECT source, count(*) AS pages FROM lsrc GROUP BY source),
leach AS (SELECT lrn, source, text, i, ls[i] AS raw, trim(ls[i], {TRIM}) AS line
  FROM (SELECT lrn, source, text, ls, unnest(range(1, len(ls) + 1)) AS i FROM lsrc)),
lbad AS (SELECT source, line, count(DISTINCT lrn) AS n, count(DISTINCT text) AS texts
  FROM leach WHERE line <> '' GROUP BY source, line),
lhit AS (SELECT b.source, b.line FROM lbad b JOIN lpages p
  ON b.source IS NOT DISTINCT FROM p.source
  WHERE n >= {lines.MIN_PAGES} AND texts > 1 AND n > pages * {lines.RATIO}::DOUBLE),
lmark AS (SELECT e.*, h.line IS NOT NULL AS bad FROM leach e LEFT JOIN lhit h
  ON e.line = h.line AND e.source IS NOT DISTINCT FROM h.source),
lkept AS (SELECT lrn, count(*) FILTER (line <> '') AS n_lines,
  count(*) FILTER (bad) AS n_removed,
  coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (NOT bad), '') AS kept_text
  FROM lmark GROUP BY lrn),
cut AS (SELECT s.* EXCLUDE (lrn, ls), coalesce(n_lines, 0)::BIGINT AS n_lines,
  coalesce(n_removed, 0)::BIGINT AS n_removed,
  CASE WHEN s.text IS NULL THEN NULL ELSE kept_text END AS kept_text
  FROM lsrc s LEFT JOIN lkept k USING (lrn))"""


OP8 = f"""WITH {line_cuts()}
SELECT doc_id, n_lines, n_removed, sha256(coalesce(kept_text, '')) AS kept_sha256 FROM cut"""



def _secret_parts() -> str:
    def quoted(text: str) -> str:
        return text.replace("'", "''")

    each = []
    for kind, pattern, least in (*secrets.STRONG, *secrets.WEAK, ("break", secrets._BREAK, 2)):
        find = quoted(secrets.finder(pattern))
        each.append(f"""
SELECT rn, '{kind}' AS kind, unnest(range(len(a))) AS i, unnest(a) AS step, unnest(b) AS match,
  {least} AS least, unnest(c) AS val FROM (SELECT rn, regexp_extract_all(body, '{find}', 1) AS a,
  regexp_extract_all(body, '{find}', 2) AS b, regexp_extract_all(body, '{find}', 3) AS c FROM src)""")
    return " UNION ALL ".join(each)


def _listed(kinds) -> str:
    return ", ".join(f"'{k}'" for k in kinds)


_STRONG = _listed(k for k, _, _ in secrets.STRONG)
_RANK = f"list_position([{_listed(secrets.KINDS)}], kind)"
OP12 = f"""WITH src AS (SELECT doc_id, coalesce(text, '') AS body, row_number() OVER () AS rn
  FROM documents),
each AS ({_secret_parts()}),
sums AS (SELECT *, sum(length(step)) OVER (PARTITION BY rn, kind ORDER BY i) AS stop FROM each),
good AS (SELECT rn, kind, (stop - length(match))::BIGINT AS start, stop::BIGINT AS stop,
  kind IN ({_STRONG}) AS strong FROM sums WHERE length(match) > 0 AND length(val) >= least),
marked AS (SELECT *,
  count(*) FILTER (kind = 'break') OVER (PARTITION BY rn ORDER BY start, stop, kind
    ROWS UNBOUNDED PRECEDING) AS scope FROM good),
placed AS (SELECT * FROM marked m WHERE kind <> 'break' AND (strong OR NOT EXISTS (
  SELECT 1 FROM good s WHERE s.strong AND s.rn = m.rn AND s.start < m.stop
  AND s.stop > m.start))),
met AS (SELECT s.rn, s.kind, s.start, s.stop, c.kind AS c_kind, c.start AS c_start,
  c.stop AS c_stop FROM placed s JOIN placed c ON s.rn = c.rn AND s.scope = c.scope
  AND s.kind IN ({_listed(secrets.SECRETS)}) AND c.kind IN ({_listed(secrets.COMPLEMENTS)})
  AND (c.start BETWEEN s.stop AND s.stop + {secrets.REACH}
       OR s.start BETWEEN c.stop AND c.stop + {secrets.REACH})),
spans AS (SELECT rn, kind, start, stop FROM placed WHERE strong
  UNION SELECT rn, kind, start, stop FROM met UNION SELECT rn, c_kind, c_start, c_stop FROM met),
told AS (SELECT rn, count(*) FILTER (kind = 'assign') AS n_assign,
  count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, {_RANK})
    FILTER (kind IN ({_STRONG})) AS base,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, {_RANK}) AS spans
  FROM spans GROUP BY rn)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
  coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans FROM src LEFT JOIN told USING (rn)"""

_TERMS = (f"regexp_extract_all(translate(coalesce(text, ''), '{ranking.UPPER}', "
          f"'{ranking.UPPER.lower()}'), '{ranking.TERM}')")
OP13 = f"""WITH src AS (SELECT row_number() OVER () AS rn, doc_id, {_TERMS} AS w FROM documents),
full_docs AS (SELECT rn, doc_id, len(w)::BIGINT AS n FROM src WHERE len(w) > 0),
total AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM full_docs),
item AS (SELECT row_number() OVER () AS rk, item_id, {_TERMS} AS w FROM benchmark),
need AS (SELECT rk, t, count(*)::BIGINT AS reps FROM (SELECT rk, unnest(w) AS t FROM item)
  GROUP BY rk, t),
tf AS (SELECT rn, t, count(*)::BIGINT AS tf FROM (SELECT rn, unnest(w) AS t FROM src)
  WHERE t IN (SELECT t FROM need) GROUP BY rn, t),
w AS (SELECT t, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT t, count(*)::BIGINT AS df FROM tf GROUP BY t), total),
m AS (SELECT rn, doc_id, 25 + (75 * n * nn) // ll AS m FROM full_docs, total),
hit AS (SELECT rk, rn, doc_id, sum(reps * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT
  AS score FROM need JOIN tf USING (t) JOIN w USING (t) JOIN m USING (rn) GROUP BY rk, rn, doc_id)
SELECT item_id, rank, doc_id, score FROM (SELECT rk, doc_id, score, (row_number() OVER (
  PARTITION BY rk ORDER BY score DESC, doc_id NULLS LAST))::INTEGER AS rank FROM hit
  WHERE score > 0) JOIN item USING (rk) WHERE rank <= 10"""

ORACLES = {
    "op1_quality_rules": OP1,
    "op5_source_mixing": OP5,
    "op8_line_dedup": OP8,
    "op12_secret_scan": OP12,
    "op13_ranked_search": OP13,
}
