"""Secret scans: strong patterns, and weak parts that are reported when they complete each other.

Strong findings (``assign``, ``access``, ``hex``) stand for themselves. Weak parts are short or
odd assigned values and mixed long values (``weak``), account names (``identifier``) and
addresses (``endpoint``); each alone is ordinary text. They are linked by an interval join: a
secret (assign, hex, weak) and a complement (access, identifier, endpoint) whose intervals lie
within ``reach`` code points of each other inside one scope, a paragraph. Secrets stand in the
bin of their start; complements are entered in every bin that a secret within reach can start
in, so that the join is on (row, scope, bin) and a bin holds a bounded number of parts, however
long the text. A weak part is reported only if it is in a link.

Positions come without any regular expression that reads a text twice over: a pattern is matched
together with the text before it, so the ends of matches are running sums of lengths (in code
points). Those sums, scopes and overlaps are windows over the found parts of a row. Rows are
told apart by doc_id and a hash of the text; only parts are shuffled, never texts.

Patterns are read from left to right without overlaps, and matches that are too short are
dropped afterwards. A weak part that overlaps a strong finding is left out.

Defined results: null and empty texts have no findings; repeated rows are scanned once and
each get the result; null doc_ids are told apart by their texts; an empty table gives an empty
result; texts of any length are scanned whole; other columns are not read, so they cannot clash.
Everything stays in DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.llm.common import let, text_of
from vectorloom.tables import written

#: Fixed values of the contract: kind, pattern (its value is group 1 of VALUE kinds), least length.
_NAMES = (r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
          r"|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])")
_SET = r"[\x22']?\x20*[:=]\x20*[\x22']?"
_VALUE = r"[A-Za-z0-9+/_.=-]+"
STRONG = (
    ("assign", rf"{_NAMES}{_SET}({_VALUE})", 12),
    ("access", r"(AKIA[A-Z0-9]+)", 18),
    ("hex", r"([0-9a-f]{16,})", 16),
)
#: Weak parts by the same rules.
_WEAK_NAMES = r"(?:[Pp]wd|PWD|[Pp]ass|PASS|[Pp]assphrase|[Kk]ey|KEY|[Cc]redentials?|[Aa]uth|AUTH)"
_ACCOUNTS = (r"(?:[Uu]ser_?[Nn]ame|[Uu]ser_?[Ii][Dd]|[Uu]ser|USER|[Ll]ogin|LOGIN|[Cc]lient_?[Ii][Dd]"
             r"|[Aa]ccount|[Aa]ccess_?[Kk]ey_?[Ii][Dd])")
WEAK = (
    ("weak", rf"(?:{_NAMES}|{_WEAK_NAMES}){_SET}({_VALUE})", 4),
    ("identifier", rf"{_ACCOUNTS}{_SET}([A-Za-z0-9@._+-]+)", 3),
    ("endpoint", r"([a-z][a-z0-9+.-]{1,15}://[^\x00-\x20\x22'<>]+)", 8),
)
#: A paragraph ends at an empty line.
_BREAK = r"(\n[\x20\t]*\n)"
KINDS = tuple(k for k, _, _ in (*STRONG, *WEAK))
SECRETS = ("assign", "hex", "weak")
COMPLEMENTS = ("access", "identifier", "endpoint")
#: Code points between linked parts, at most.
REACH = 200
_PARTS = "array<struct<kind:string,no:int,step:int,size:int,good:boolean>>"


def finder(pattern: str) -> str:
    """Group 1: text and match, group 2: match, group 3: its value. The alternative at the end
    of the text takes the rest, so that no start is tried again."""
    return rf"(?s)(.*?({pattern}|\z))"


def _matches(text: Column, kind: str, pattern: str, least: int) -> Column:
    """(kind, no, step, size, value): lengths of text up to the end, match and value."""
    step, match, value = (
        F.transform(F.regexp_extract_all(text, F.lit(finder(pattern)), F.lit(i)), F.length)
        for i in (1, 2, 3))
    every = F.transform(F.arrays_zip(step.alias("step"), match.alias("size"),
                                     value.alias("value")),
                        lambda x, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("no"), x["step"].alias("step"),
        x["size"].alias("size"), ((x["value"] >= least) & (x["size"] > 0)).alias("good")))
    return F.when(text.rlike(pattern), every).otherwise(F.array().cast(_PARTS))


def parts(docs: DataFrame) -> DataFrame:
    """doc_id, h, found: the matches of a row, once for repeated rows. The matches of a kind
    are complete, also those too short, since positions are sums over all of them."""
    text = text_of(docs)
    strong = [_matches(text, *s) for s in STRONG]
    weak = [_matches(text, *s) for s in WEAK]
    breaks = _matches(text, "break", _BREAK, 2)

    def listed(m: Column) -> Column:
        can_link = (F.exists(m["more"], lambda x: x["good"])
                    & F.exists(m["secret"], lambda x: x["good"]))
        # Weak parts and paragraphs matter only beside a possible partner.
        return F.struct(m["base"].alias("base"), F.when(
            can_link, F.concat(m["more"], breaks)).alias("more"))

    def of_rest(m: Column) -> Column:
        return let(F.struct(
            m["base"].alias("base"), F.concat(m["weak"], *weak[1:]).alias("more"),
            F.concat(m["base"], m["weak"]).alias("secret")), listed)

    found = let(F.struct(F.concat(*strong).alias("base"), weak[0].alias("weak")), of_rest)
    return written(docs.select(docs["doc_id"].alias("doc_id"), F.xxhash64(text).alias("h"),
                               found.alias("x")).select("doc_id", "h", "x.*"))


def positions(found: DataFrame) -> DataFrame:
    """doc_id, h, kind, start, stop, scope: parts that are long enough, weak ones only where no
    strong one overlaps them."""
    all_parts = F.concat("base", F.coalesce("more", F.array().cast(_PARTS)))
    each = (found.where(F.exists(all_parts, lambda x: x["good"]))
            .select("doc_id", "h", F.explode(all_parts).alias("x")).select("doc_id", "h", "x.*")
            .distinct())
    key = ("doc_id", "h")
    stop = F.sum("step").over(Window.partitionBy(*key, "kind").orderBy("no"))
    placed = each.withColumn("stop", stop).where("good").select(
        *key, "kind", (F.col("stop") - F.col("size")).alias("start"), "stop")
    row = Window.partitionBy(*key)
    in_order = row.orderBy("start", "stop", "kind")
    strong = F.col("kind").isin(*[k for k, _, _ in STRONG])
    before = F.max(F.when(strong, F.col("stop"))).over(
        in_order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(strong, F.col("start"))).over(
        in_order.rowsBetween(1, Window.unboundedFollowing))
    overlaps = (F.coalesce(before > F.col("start"), F.lit(False))
                | F.coalesce(after < F.col("stop"), F.lit(False)))
    scope = F.sum(F.when(F.col("kind") == "break", 1).otherwise(0)).over(
        in_order.rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumns({"scope": scope, "strong": strong, "overlaps": overlaps}).where(
        "kind <> 'break' AND (strong OR NOT overlaps)").drop("overlaps")


def links(placed: DataFrame, reach: int = REACH) -> DataFrame:
    """doc_id, h, scope, and the two parts of each link: kind, start, stop and c_kind, c_start,
    c_stop."""
    bins = F.floor(F.col("start") / reach)
    secrets = placed.where(F.col("kind").isin(*SECRETS)).withColumn("bin", bins)
    # Parts in a link do not overlap: the secret stops before its complement starts, or starts
    # after it. So it is entered where it starts and where it stops.
    at_stop = secrets.withColumn("bin", F.floor((F.col("stop") - 1) / reach))
    entered = secrets.union(at_stop.where(F.col("bin") != bins))
    names = [c for c in placed.columns if c != "strong"]
    others = placed.where(F.col("kind").isin(*COMPLEMENTS)).select(
        *[F.col(c).alias(f"c_{c}") for c in names],
        F.explode(F.sequence(F.floor((F.col("start") - reach - 1) / reach),
                             F.floor((F.col("stop") + reach) / reach))).alias("c_bin"))
    near = (F.col("c_start").between(F.col("stop"), F.col("stop") + reach)
            | F.col("start").between(F.col("c_stop"), F.col("c_stop") + reach))
    met = entered.join(others, F.col("doc_id").eqNullSafe(F.col("c_doc_id"))
                       & (F.col("h") == F.col("c_h")) & (F.col("scope") == F.col("c_scope"))
                       & (F.col("bin") == F.col("c_bin")) & near)
    return met.select("doc_id", "h", "scope", "kind", "start", "stop", "c_kind", "c_start",
                      "c_stop").distinct()


def secret_scan(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """One row per row: doc_id, base and spans, arrays of (start, place of the kind in KINDS,
    stop) in that order; spans holds the weak parts in links too."""
    found = parts(docs)
    placed = written(positions(found))
    linked = links(placed, reach)
    weak = (linked.select("doc_id", "h", "kind", "start", "stop")
            .union(linked.select("doc_id", "h", "c_kind", "c_start", "c_stop")))
    strong = F.col("kind").isin(*[k for k, _, _ in STRONG])
    own = placed.where("strong").select("doc_id", "h", "kind", "start", "stop")
    spans = own.union(weak.where(~strong)).distinct()
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int") - 1
    entry = F.struct(F.col("start").cast("long").alias("start"), rank.alias("kind"),
                     F.col("stop").cast("long").alias("stop"))
    rows = spans.groupBy(F.col("doc_id").alias("s_doc_id"), F.col("h").alias("s_h")).agg(
        F.sort_array(F.collect_list(entry)).alias("listed"))
    joined = found.select("doc_id", "h").join(
        rows, F.col("doc_id").eqNullSafe(F.col("s_doc_id")) & (F.col("h") == F.col("s_h")), "left")
    spans = F.coalesce("listed", F.array().cast(rows.schema["listed"].dataType))
    return joined.select("doc_id", spans.alias("spans")).select(
        "doc_id", F.filter("spans", lambda x: x["kind"] < len(STRONG)).alias("base"), "spans")


def spelled(spans: Column) -> Column:
    """kind:start:stop of each, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["stop"].cast("string"))), ",")


def number_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == KINDS.index(kind))).cast("long")
