"""Mixing sources to target weights by hierarchical budgets.

Documents lie in the leaves of a tree (domain, then language, then source). A node's budget goes to its children in
proportion to their weights; a child that holds fewer tokens than its share, all epochs counted, gives what is short to
its siblings, and only what none of them can take reaches the siblings of the node above. That is water-filling from the
root down with each subtree's capacity, in closed form: children in order of capacity over weight, running sums.

A leaf then takes as many whole epochs as its budget holds and a prefix of one more, in an order that a hash of seed,
epoch and document id gives. Where the prefix ends is found on a slim table of paths, ids and token counts: token sums of
256 hash ranges a leaf, then of 256 ranges of the range in which the budget runs out, until few rows are left there. The
documents themselves are filtered by their leaf's last hash, and never shuffled or sorted.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bytestrata.llm.scratch import Scratch, bounded, fresh

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Params:
    """levels: columns from the root down. weights: of a level's values; missing ones have ``default``. budget: tokens in
    all, as a share of the table's. epochs: the most often a document can be taken. range_rows: a leaf's range is split no
    further when it has at most so many rows."""

    levels: tuple[str, ...] = ("domain", "lang", "source")
    weights: dict[str, dict[str, float]] = field(default_factory=dict)
    default: float = 1.0
    budget: float = 1.0
    epochs: int = 1
    seed: int = 42
    range_rows: int = 20_000
    broadcast_leaves: int = 100_000


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _weight(p: Params, level: str) -> Column:
    known = p.weights.get(level, {})
    w = F.lit(p.default)
    for value, x in sorted(known.items()):
        w = F.when(F.col(level) == value, F.lit(float(x))).otherwise(w)
    return w.cast("double")


def budgets(leaves: DataFrame, p: Params) -> DataFrame:
    """leaves(levels..., tokens) -> the same with ``budget``, a whole number of tokens. The children of one node are sorted in
    one task."""
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    df = leaves.withColumn("cap", (F.col("tokens") * p.epochs).cast("double")).withColumn("budget", F.lit(float(p.budget * total)))
    for depth in range(1, len(p.levels) + 1):
        path, parent = list(p.levels[:depth]), list(p.levels[: depth - 1])
        child = df.groupBy(*path).agg(F.sum("cap").alias("c"), F.first("budget").alias("b")).withColumn("w", _weight(p, path[-1]))
        child = child.withColumn("r", F.when(F.col("w") > 0, F.col("c") / F.col("w")).otherwise(F.lit(float("inf"))))
        group = Window.partitionBy(*(parent or [F.lit(0)]))
        order = group.orderBy("r", path[-1])
        before = F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, -1))
        rest = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
        full = (F.col("w") > 0) & (F.coalesce(before, F.lit(0.0)) + F.col("r") * rest <= F.col("b"))
        child = child.withColumn("full", full)
        held = F.coalesce(F.sum(F.when(F.col("full"), F.col("c"))).over(group), F.lit(0.0))
        open_ = F.sum(F.when(F.col("full"), F.lit(0.0)).otherwise(F.col("w"))).over(group)
        share = F.when(F.col("full"), F.col("c")).when(open_ > 0, F.col("w") * (F.col("b") - held) / open_).otherwise(F.lit(0.0))
        df = df.drop("budget").join(child.select(*path, share.alias("budget")), path)
    return df.select(*p.levels, "tokens", F.floor("budget").cast("long").alias("budget"))


def _last_taken(slim: DataFrame, plan: DataFrame, path: list[str], p: Params, scratch: Scratch) -> DataFrame:
    """(path..., last_h, last_n) of each leaf that takes a part of an epoch: its rows up to this hash and token count."""
    wanted = plan.where((F.col("full") < p.epochs) & (F.col("rest") > 0)).select(*path, "full", "rest")
    rows = slim.join(bounded(scratch.save(wanted), p.broadcast_leaves), path).withColumn("h", _order(p, F.col("full"), F.col("id")))
    inside, depth = rows.withColumns({"prefix": F.lit(""), "before": F.lit(0).cast("long")}), 0
    while True:
        depth += 2
        ranges = inside.groupBy(*path, "rest", "before", F.left("h", F.lit(depth)).alias("prefix")).agg(F.sum("n").alias("s"), F.count("*").alias("rows"))
        upto = F.col("before") + F.sum("s").over(Window.partitionBy(*path).orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0))
        crossed = ranges.withColumn("upto", upto).where("upto > rest").groupBy(*path).agg(F.min(F.struct("prefix", (F.col("upto") - F.col("s")).alias("before"), "rows")).alias("c"))
        crossed = scratch.save(crossed.select(*path, F.col("c.prefix").alias("prefix"), F.col("c.before").alias("before"), F.col("c.rows").alias("rows")))
        most = crossed.agg(F.max("rows")).first()[0] or 0
        inside = rows.join(bounded(crossed, p.broadcast_leaves), path).where(F.left("h", F.lit(depth)) == F.col("prefix"))
        if most <= p.range_rows or depth >= 32:
            break
    same = inside.groupBy(*path, "rest", "before", "prefix", "h", "n").agg(F.sum("n").alias("s"))
    upto = F.col("before") + F.sum("s").over(Window.partitionBy(*path).orderBy("h", "n").rowsBetween(Window.unboundedPreceding, 0))
    taken = same.withColumn("upto", upto).groupBy(*path, "prefix").agg(F.max(F.when(F.col("upto") <= F.col("rest"), F.struct("h", "n"))).alias("c"))
    return taken.select(*path, F.coalesce("c.h", "prefix").alias("last_h"), F.coalesce("c.n", F.lit(-1)).cast("long").alias("last_n"))


def _order(p: Params, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(p.seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def mix(docs: DataFrame, p: Params, tokens: Column, doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs that the budgets take, with n_tokens and epoch (from 0), a row for each time.

    Null values of a level count as the empty one. Documents of 0 tokens go with their leaf's order and cost nothing.
    Rows that repeat an id are ordered by their tokens; those equal in both go together, if all fit. An empty table gives
    no row. Columns of docs named n_tokens and epoch are replaced; other names are free. ``tokens`` is a Column of docs
    and is not null.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    own = [c for c in docs.columns if c not in ("n_tokens", "epoch")]
    path = [f"l{i}" for i in range(len(p.levels))]
    level = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in zip(p.levels, path, strict=True)]
    slim = scratch.save(docs.select(*level, F.col(doc_id).cast("string").alias("id"), tokens.cast("long").alias("n")))
    leaves = scratch.save(slim.groupBy(*path).agg(F.sum("n").alias("tokens")).withColumnsRenamed(dict(zip(path, p.levels, strict=True))))
    if leaves.count() <= p.broadcast_leaves:
        leaves = leaves.coalesce(1)
    whole = F.when(F.col("tokens") > 0, F.least(F.lit(p.epochs), F.floor(F.col("budget") / F.col("tokens")))).otherwise(0)
    plan = budgets(leaves, p).select(*(F.col(c).alias(n) for c, n in zip(p.levels, path, strict=True)), whole.cast("long").alias("full"), (F.col("budget") - whole * F.col("tokens")).cast("long").alias("rest"))
    plan = scratch.save(plan)
    last = _last_taken(slim, plan, path, p, scratch)
    place, leaf, row = fresh(docs, "place"), fresh(docs, "leaf"), fresh(docs, "row")
    plan = scratch.save(plan.join(last, path, "left").select(F.struct(*path).alias(place), F.struct("full", "last_h", "last_n").alias(leaf)))
    rows = docs.select("*", F.struct(*level).alias(row))
    rows = rows.join(bounded(plan, p.broadcast_leaves), F.col(row) == F.col(place))
    full, h = F.col(f"{leaf}.full"), _order(p, F.col(f"{leaf}.full"), F.col(doc_id))
    last_h, last_n = F.col(f"{leaf}.last_h"), F.col(f"{leaf}.last_n")
    more = F.coalesce((h < last_h) | ((h == last_h) & (tokens <= last_n)), F.lit(False))
    rows = rows.withColumn(leaf, F.when(more, full + 1).otherwise(full)).where(F.col(leaf) > 0)
    return rows.select(*own, tokens.cast("long").alias("n_tokens"), F.explode(F.sequence(F.lit(0), F.col(leaf).cast("int") - 1)).alias("epoch"))


WEIGHTS = {"domain": {"d0": 0.5, "d1": 0.3, "d2": 0.2}, "lang": {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}}


def domain(source: Column) -> Column:
    """The synthetic tables have no domain: the number in a source's name modulo 3."""
    return F.concat(F.lit("d"), (F.coalesce(F.try_to_number(F.regexp_extract(source, "([0-9]{1,9})$", 1), F.lit("999999999")).cast("long"), F.lit(0)) % 3).cast("string"))


def oracle(budget: float, epochs: int, seed: int) -> str:
    """DuckDB SQL of mix() over documents with WEIGHTS."""
    level = """
, c{d} AS (SELECT {path}, sum(cap) AS c, any_value(budget) AS b, {w} AS w FROM l{up} GROUP BY {path}),
r{d} AS (SELECT *, CASE WHEN w > 0 THEN c / w ELSE CAST('inf' AS DOUBLE) END AS r FROM c{d}),
f{d} AS (SELECT *, w > 0 AND coalesce(sum(c) OVER (PARTITION BY {parent} ORDER BY r, {last} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
  + r * sum(w) OVER (PARTITION BY {parent} ORDER BY r, {last} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) <= b AS filled FROM r{d}),
s{d} AS (SELECT *, coalesce(sum(CASE WHEN filled THEN c END) OVER (PARTITION BY {parent}), 0) AS held, sum(CASE WHEN filled THEN 0 ELSE w END) OVER (PARTITION BY {parent}) AS o FROM f{d}),
l{d} AS (SELECT l{up}.* EXCLUDE (budget), CASE WHEN filled THEN c WHEN o > 0 THEN w * (b - held) / o ELSE 0 END AS budget FROM l{up} JOIN s{d} USING ({path}))"""
    names = ("domain", "lang", "source")
    steps = ""
    for d in (1, 2, 3):
        known = WEIGHTS.get(names[d - 1], {})
        w = "CASE " + " ".join(f"WHEN {names[d - 1]} = '{k}' THEN CAST({x} AS DOUBLE)" for k, x in known.items()) + " ELSE CAST(1 AS DOUBLE) END" if known else "CAST(1 AS DOUBLE)"
        steps += level.format(d=d, up=d - 1, path=", ".join(names[:d]), parent=", ".join(names[: d - 1]) or "0", last=names[d - 1], w=w)
    return rf"""
WITH docs AS (
  SELECT doc_id, 'd' || (coalesce(TRY_CAST(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS BIGINT), 0) % 3) AS domain, coalesce(lang, '') AS lang,
    coalesce(source, '') AS source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS n_tokens
  FROM documents),
l0 AS (SELECT domain, lang, source, sum(n_tokens) AS tokens, CAST(sum(n_tokens) * {epochs} AS DOUBLE) AS cap,
  CAST({budget} * (SELECT sum(n_tokens) FROM docs) AS DOUBLE) AS budget FROM docs GROUP BY ALL){steps},
plan AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN least({epochs}, CAST(floor(floor(budget) / tokens) AS BIGINT)) ELSE 0 END AS whole,
  CAST(floor(budget) AS BIGINT) AS budget, tokens FROM l3),
rows_ AS (SELECT docs.*, whole, budget - whole * tokens AS remains, md5('{seed}' || ':' || whole || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM docs JOIN plan USING (domain, lang, source)),
part AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY h, doc_id, n_tokens RANGE UNBOUNDED PRECEDING) AS upto FROM rows_)
SELECT doc_id, domain, lang, source, n_tokens, CAST(e AS INTEGER) AS epoch FROM (SELECT *, unnest(range(whole)) AS e FROM rows_ WHERE whole > 0)
UNION ALL SELECT doc_id, domain, lang, source, n_tokens, CAST(whole AS INTEGER) FROM part WHERE whole < {epochs} AND remains > 0 AND upto <= remains
"""
