"""Mixing sources to target weights by hierarchical budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, checkpoint, hinted, table

#: The mixture holds this share of all tokens; no document occurs more often than MAX_EPOCHS times.
SHARE, MAX_EPOCHS, SEED = 0.5, 3, "mix-1"
#: Whole-number weights by level and value; all others weigh 1. A weight of 0 leaves a value out.
WEIGHTS = {"domain": {"a": 3, "b": 2}, "lang": {"en": 4, "de": 2, "fr": 2}, "source": {"src0": 5, "src3": 2}}
#: Hexadecimal digits of the order key that number the buckets of a leaf.
DIGITS = 3
LEVELS = ("domain", "lang", "source")


def default_domain(source: Column) -> Column:
    """One of four domains by a hash of the source, where no assignment is given."""
    digit = F.substring(F.md5(source.cast("binary")), 1, 1)
    return F.when(digit < "4", "a").when(digit < "8", "b").when(digit < "c", "c").otherwise("d")


def fill(children: DataFrame, parents: DataFrame | int, parent: tuple[str, ...], name: str) -> DataFrame:
    """Share each parent's budget among its children by weight, none over its capacity.

    children: parent columns, ``name``, capacity, weight; parents: parent columns, budget, or the root's budget. What a child can't use goes
    to its siblings by weight. As a capacity is that of the whole subtree, only what all siblings together can't use
    was never given to their parent: shortages stay among siblings before they reach ancestors. All whole numbers. A
    child without weight has no capacity and gets nothing.
    """
    # Children fill up in the order of capacity by weight.
    order = [F.coalesce(F.try_divide(F.col("capacity").cast("double"), F.col("weight").cast("double")), F.lit(0.0)), F.col(name)]
    group = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    before = group.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rest = group.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    both = children.join(parents, list(parent)) if parent else children.withColumn("budget", F.lit(parents).cast("long"))
    both = both.withColumns({"used": F.coalesce(F.sum("capacity").over(before), F.lit(0)), "open": F.sum("weight").over(rest)})
    both = both.withColumn("full", F.expr("capacity * open <= weight * (budget - used)"))
    both = both.withColumns(
        {"gone": F.sum(F.expr("if(full, capacity, 0L)")).over(group), "left": F.sum(F.expr("if(full, 0L, weight)")).over(group)}
    )
    return both.withColumn("budget", F.expr("if(full, capacity, weight * (budget - gone) div greatest(left, 1L))")).select(*parent, name, "capacity", "budget")


def leaf_budgets(leaves: DataFrame, share: float, max_epochs: int, weights: dict[str, dict[str, int]]) -> DataFrame:
    """Budgets of leaves ``(domain, lang, source, tokens)``, from the root downwards."""
    def weight(level: str) -> Column:
        known = weights.get(level) or {}
        out = F.lit(1).cast("long")
        for value, w in known.items():
            out = F.when(F.col(level) == value, F.lit(int(w)).cast("long")).otherwise(out)
        return out

    weighed = leaves.withColumns({f"__{level}": weight(level) for level in LEVELS})
    # Nothing under a weight of 0 can be used, so that ancestors count on none of it.
    leaves = weighed.withColumn("capacity", F.when(F.least(*(F.col(f"__{level}") for level in LEVELS)) > 0, F.col("tokens") * max_epochs).otherwise(0))
    budgets: DataFrame | int = leaves.agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * F.lit(share)).cast("long")).first()[0]
    for depth, level in enumerate(LEVELS):
        nodes = leaves.groupBy(*LEVELS[: depth + 1]).agg(F.sum("capacity").alias("capacity"), F.max(f"__{level}").alias("weight"))
        budgets = fill(nodes, budgets.select(*LEVELS[:depth], "budget") if depth else budgets, LEVELS[:depth], level)
    return leaves.select(*LEVELS, "tokens").join(budgets.drop("capacity"), list(LEVELS))


def mixed(
    docs: DataFrame,
    share: float = SHARE,
    max_epochs: int = MAX_EPOCHS,
    weights: dict[str, dict[str, int]] | None = None,
    domain: Column | None = None,
    seed: str = SEED,
) -> DataFrame:
    """The selected rows of docs with all their columns and ``domain``, ``n_tokens`` and ``copies``.

    The tree has domains, in them languages, in them sources. ``weights`` gives whole-number weights by level and
    value (WEIGHTS by default); all others are 1. The root's budget is ``share`` of all tokens (words between white space), and shares
    run down the tree (see ``fill``). A leaf holds up to ``max_epochs`` times its tokens. Its budget is spent on whole
    epochs first; of the next epoch, whose order is that of md5(seed, epoch, doc_id), it takes the longest prefix within
    what is left. copies is the number of epochs that a document is in; documents in none are dropped.

    A leaf's order is cut into 4096 buckets by the key's first digits. Sums by bucket show which one holds the end of
    the prefix; only keys there are sorted, summed by key before, so that neither a source with a third of all rows nor
    an id that often repeats is a single task's work. Null languages and sources count as empty names. Null texts have no
    tokens. Documents of a leaf with equal order keys (a repeated doc_id; a null id counts as empty) are taken or left
    together; those of other leaves stand for themselves. An empty table gives an empty result. Columns of docs named
    domain, n_tokens or copies are replaced, whatever their case; all others are kept, whatever their names.
    """
    weights = WEIGHTS if weights is None else weights
    taken = {c.lower() for c in docs.columns}

    def free(name: str) -> str:
        while name.lower() in taken:
            name += "_"
        return name

    marks = {k: free(f"__{k}") for k in ("domain", "lang", "source", "tokens", "id")}
    own = {k: free(f"__mix_{k}") for k in ("epochs", "edge", "key", "chosen")}
    source = F.coalesce(F.col("source"), F.lit(""))
    keys = {
        marks["domain"]: default_domain(source) if domain is None else domain,
        marks["lang"]: F.coalesce(F.col("lang"), F.lit("")),
        marks["source"]: source,
        marks["id"]: F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
        marks["tokens"]: F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long"),
    }
    keyed = docs.withColumns(keys)
    narrow = checkpoint(keyed.select(*(F.col(v).alias(k) for k, v in marks.items())))
    leaves = checkpoint(narrow.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")))
    budgets = leaf_budgets(leaves, share, max_epochs, weights)
    plan = checkpoint(
        budgets.select(
            *LEVELS,
            F.expr("if(tokens = 0, 0L, budget div greatest(tokens, 1L))").alias("epochs"),
            F.expr("if(tokens = 0, 0L, budget % greatest(tokens, 1L))").alias("rest"),
        )
    )
    n_leaves = plan.count()
    small = hinted(plan, 256, n_leaves)
    key = F.md5(F.concat_ws(":", F.lit(seed), "epochs", "id").cast("binary"))
    ordered = narrow.join(small, list(LEVELS)).withColumn("key", key).withColumn("bucket", F.substring("key", 1, DIGITS))
    sums = ordered.groupBy(*LEVELS, "rest", "bucket").agg(F.sum("tokens").alias("tokens"))
    upto = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # The first bucket that doesn't fit whole; all before it are taken, all after it are not.
    sums = sums.withColumn("end", F.sum("tokens").over(upto))
    edge = sums.where("end > rest").groupBy(*LEVELS).agg(F.min(F.struct("bucket", F.expr("rest - (end - tokens) AS room"))).alias("edge"))
    whole = plan.join(edge, list(LEVELS), "left").select(*LEVELS, "epochs", F.col("edge.bucket").alias("edge"), F.col("edge.room").alias("room"))
    whole = checkpoint(whole)
    inner = ordered.drop("rest").join(hinted(whole.drop("epochs"), 256, n_leaves), list(LEVELS)).where("bucket = edge")
    inner = inner.groupBy(*LEVELS, "key", "room").agg(F.sum("tokens").alias("tokens"))
    within = Window.partitionBy(*LEVELS).orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    part = checkpoint(inner.withColumn("sum", F.sum("tokens").over(within)).where("sum <= room").select(*LEVELS, "key"))

    on = [marks[c] for c in LEVELS]
    leaf = whole.select(*(F.col(c).alias(marks[c]) for c in LEVELS), F.col("epochs").alias(own["epochs"]), F.col("edge").alias(own["edge"]))
    out = keyed.join(hinted(leaf, 256, n_leaves), on)
    out = out.withColumn(own["key"], F.md5(F.concat_ws(":", F.lit(seed), own["epochs"], marks["id"]).cast("binary")))
    # Keys chosen in edge buckets, each of its own leaf; rows of other buckets need none.
    chosen = part.select(*(F.col(c).alias(marks[c]) for c in LEVELS), F.col("key").alias(own["key"]), F.lit(True).alias(own["chosen"]))
    out = out.join(hinted(chosen, 256), [*on, own["key"]], "left")
    bucket = F.substring(own["key"], 1, DIGITS)
    before = F.coalesce(bucket < F.col(own["edge"]), F.lit(True)) & (F.col(own["epochs"]) < max_epochs)
    copies = F.col(own["epochs"]) + F.when(before | F.coalesce(own["chosen"], F.lit(False)), 1).otherwise(0)
    named = {"domain": F.col(marks["domain"]), "n_tokens": F.col(marks["tokens"]), "copies": copies.cast("long")}
    out = out.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in named), *(c.alias(k) for k, c in named.items()))
    return out.where("copies > 0")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "domain", "lang", "source", "n_tokens", "copies")


def _weight_sql(level: str) -> str:
    known = " ".join(f"WHEN '{value}' THEN {int(w)}" for value, w in WEIGHTS.get(level, {}).items())
    return f"CASE {level} {known} ELSE 1 END" if known else "1"


def _level_sql(depth: int) -> str:
    level, parent = LEVELS[depth], LEVELS[:depth]
    on = " AND ".join(f"n.{c} = p.{c}" for c in parent) or "TRUE"
    cols = ", ".join(f"n.{c}" for c in LEVELS[: depth + 1])
    by = "PARTITION BY " + (", ".join(parent) or "0")
    return f"""
n{depth} AS (SELECT {", ".join(LEVELS[: depth + 1])}, sum(usable) * {MAX_EPOCHS} AS capacity, {_weight_sql(level)} AS weight FROM leaves GROUP BY ALL),
o{depth} AS (
  SELECT {cols}, n.capacity, n.weight, p.budget FROM n{depth} n JOIN b{depth} p ON {on}
), f{depth} AS (
  SELECT *, capacity * sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    <= weight * (budget - coalesce(sum(capacity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS is_full
  FROM o{depth} WINDOW w AS ({by} ORDER BY CASE WHEN weight = 0 THEN 0 ELSE capacity::DOUBLE / weight END, {level})
), b{depth + 1} AS (
  SELECT {", ".join(LEVELS[: depth + 1])}, CASE WHEN is_full THEN capacity ELSE
    weight * (budget - sum(CASE WHEN is_full THEN capacity ELSE 0 END) OVER ({by})) // greatest(sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ({by}), 1)
    END AS budget FROM f{depth}
)"""


OP4_SQL = rf"""
WITH d AS (
  SELECT doc_id, lang, source, coalesce(lang, '') AS l, coalesce(source, '') AS s,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens
  FROM documents
), k AS (
  SELECT *, CASE WHEN md5(s) < '4' THEN 'a' WHEN md5(s) < '8' THEN 'b' WHEN md5(s) < 'c' THEN 'c' ELSE 'd' END AS domain FROM d
), leaves AS (
  SELECT *, CASE WHEN least({", ".join(map(_weight_sql, LEVELS))}) > 0 THEN tokens ELSE 0 END AS usable
  FROM (SELECT domain, l AS lang, s AS source, sum(n_tokens)::BIGINT AS tokens FROM k GROUP BY ALL)
), b0 AS (
  SELECT floor(sum(tokens) * {SHARE})::BIGINT AS budget FROM leaves
), {", ".join(_level_sql(x).strip() for x in range(3))}
, plan AS (
  SELECT leaves.*, CASE WHEN tokens = 0 THEN 0 ELSE budget // greatest(tokens, 1) END AS epochs,
         CASE WHEN tokens = 0 THEN 0 ELSE budget % greatest(tokens, 1) END AS rest
  FROM leaves JOIN b3 USING (domain, lang, source)
), o AS (
  SELECT k.doc_id, k.domain, k.lang, k.source, k.n_tokens, p.epochs, p.rest,
         sum(k.n_tokens) OVER (PARTITION BY k.domain, k.l, k.s ORDER BY md5('{SEED}:' || p.epochs::BIGINT || ':' || coalesce(k.doc_id::VARCHAR, ''))) AS upto
  FROM k JOIN plan p ON k.domain = p.domain AND k.l = p.lang AND k.s = p.source
)
SELECT doc_id, domain, lang, source, n_tokens, (epochs + CASE WHEN upto <= rest AND epochs < {MAX_EPOCHS} THEN 1 ELSE 0 END)::BIGINT AS copies
FROM o WHERE epochs + CASE WHEN upto <= rest AND epochs < {MAX_EPOCHS} THEN 1 ELSE 0 END > 0
"""
