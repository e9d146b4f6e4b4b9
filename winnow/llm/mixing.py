"""Mixing sources to target weights by hierarchical budgets.

Documents lie in the leaves of a tree (domain, language, source). A token budget enters at the root and is dealt
among siblings by integer weights. No subtree gets more than it can give (tokens below it times ``max_epochs``):
what a short subtree leaves goes to its siblings by weight, and only what all siblings together cannot use
goes to the children of the next ancestor. A subtree of weight 0 gives nothing, so it counts in no ancestor's capacity. Amounts are whole tokens, rounded down.

A leaf's stream is its documents in a seeded random order, epoch after epoch, each epoch with an order of
its own. The leaf gives the prefix of the stream that its budget pays for: all documents for each full epoch, then
the documents that begin before the budget ends. ``taken`` is the part of a document's tokens inside the prefix; the
document itself stays whole.

A prefix sum over a leaf would put a large leaf into one task. Orders are hashes, so each leaf is cut into
ranges of the hash, 16**n of them so that a range holds about ``range_rows`` rows at most; sums by range tell the one range in which the budget ends, and only that range is sorted.

A null or empty text has no tokens and goes with the documents around it, and a leaf without tokens gives nothing; null labels form a leaf named 'unknown'. Very long texts are counted
as a whole and stay whole. Rows that repeat a doc_id, and all rows with a null one, have one place in a leaf's order and go together. An empty table gives an empty result. Columns of docs
may have any names; those named mix_epoch or mix_taken are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winnow.llm import store

WORD = r"[^\x20\x09-\x0D]+"


def _weight(level: dict[str, int], default: int, column: str) -> Column:
    out = F.lit(default)
    for value, w in level.items():
        out = F.when(F.col(column) == value, w).otherwise(out)
    return out.cast("long")


def water_fill(children: DataFrame, parent: Sequence[str]) -> DataFrame:
    """children (parent columns, name, w, cap, budget of the parent) -> the same with ``share``, each child's budget.

    Children whose capacity is below their part of what is left are filled, in the order of capacity by weight;
    the others divide the rest by weight.
    """
    order = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("w"), "name")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    here_on = order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(*parent)
    out = children.where("w > 0").withColumn("s", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("ws", F.sum("w").over(here_on))
    out = out.withColumn("full", F.expr("cap * ws <= w * (budget - s)"))
    out = out.withColumn("left", F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(whole), F.lit(0)))
    out = out.withColumn("wl", F.sum(F.when(~F.col("full"), F.col("w"))).over(whole))
    return out.withColumn("share", F.expr("CASE WHEN full THEN cap ELSE (w * left) div wl END")).drop("s", "ws", "full", "left", "wl")


def mix(docs: DataFrame, weights: Sequence[dict[str, int]], *, levels: Sequence[Column], budget_percent: int = 60, max_epochs: int = 2, seed: int = 7, range_rows: int = 4096, default_weight: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The selected (document, epoch) rows: all columns of docs, then mix_epoch and mix_taken.

    weights: for each level of the tree, integer weights by name. levels: the columns that give a row's names, root first.
    budget_percent: the budget as a part of all tokens. Sources whose weight is 0 give nothing.
    """
    names = [f"mix_l{i}" for i in range(len(levels))]
    own = {f"mix_c{i}": c for i, c in enumerate(docs.columns) if c not in ("mix_epoch", "mix_taken")}
    labels = [F.coalesce(level.cast("string"), F.lit("unknown")).alias(name) for name, level in zip(names, levels, strict=True)]
    tokens = F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(*[F.col(f"`{c}`").alias(x) for x, c in own.items()], *labels, tokens.alias("mix_tokens"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("mix_id"))
    every = store.saved(rows.groupBy(*names).agg(F.sum("mix_tokens").alias("tokens"), F.count("*").alias("rows")), "leaves")
    budget = every.agg(F.expr(f"coalesce(sum(tokens), 0) * {budget_percent} div 100").alias("budget"))
    leaves = every
    for name, level in zip(names, weights, strict=True):
        leaves = leaves.where(_weight(level, default_weight, name) > 0)
    parents = budget
    for i, name in enumerate(names):
        above = names[:i]
        caps = leaves.groupBy(*names[: i + 1]).agg((F.sum("tokens") * max_epochs).alias("cap"))
        children = caps.join(parents, above) if above else caps.crossJoin(F.broadcast(parents))  # parents: one row
        children = children.withColumn("w", _weight(weights[i], default_weight, name)).withColumn("name", F.col(name))
        parents = water_fill(children, above).select(*names[: i + 1], F.col("share").alias("budget"))
    digits = F.greatest(F.lit(1), F.ceil(F.log(16.0, F.col("rows") / range_rows))).cast("int")
    plan = leaves.join(parents, names).select(*names, digits.alias("mix_digits"), F.expr("CASE WHEN tokens > 0 THEN budget div tokens ELSE 0 END").alias("mix_full"), F.expr("CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END").alias("mix_rest"))
    plan = store.small(store.saved(plan, "plan"))
    store.forget(every)

    place = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("mix_full").cast("string"), "mix_id"))
    placed = rows.join(plan, names).withColumn("mix_place", place).withColumn("mix_range", F.expr("substring(mix_place, 1, mix_digits)"))
    sums = placed.where("mix_rest > 0").groupBy(*names, "mix_range").agg(F.sum("mix_tokens").alias("mix_sum"))
    running = Window.partitionBy(*names).orderBy("mix_range").rowsBetween(Window.unboundedPreceding, -1)
    cut = sums.withColumn("mix_before", F.coalesce(F.sum("mix_sum").over(running), F.lit(0)))
    cut = cut.join(plan, names).where("mix_before < mix_rest and mix_before + mix_sum >= mix_rest")
    cut = store.small(store.saved(cut.select(*names, F.col("mix_range").alias("mix_cut"), "mix_before"), "cut"))

    placed = placed.join(cut, names, "left")
    inside = Window.partitionBy(*names).orderBy("mix_place").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    same = Window.partitionBy(*names, "mix_place")
    edge = placed.where("mix_range = mix_cut").withColumn("mix_start", F.col("mix_before") + F.sum("mix_tokens").over(inside) - F.sum("mix_tokens").over(same))
    edge = edge.where("mix_start < mix_rest").withColumn("mix_taken", F.least("mix_tokens", F.col("mix_rest") - F.col("mix_start"))).withColumn("mix_epoch", F.col("mix_full"))
    part = placed.where("mix_range < mix_cut").withColumn("mix_taken", F.col("mix_tokens")).withColumn("mix_epoch", F.col("mix_full"))
    full = placed.where("mix_full > 0").withColumn("mix_taken", F.col("mix_tokens")).withColumn("mix_epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("mix_full") - 1)))
    kept = [*[F.col(x).alias(c) for x, c in own.items()], "mix_epoch", "mix_taken"]
    return full.select(*kept).unionByName(part.select(*kept)).unionByName(edge.select(*kept))


#: Target weights of the query and the pipeline: domains, then languages, then sources (all alike).
WEIGHTS: tuple[dict[str, int], ...] = ({"web": 5, "books": 3, "code": 2}, {"en": 6, "de": 2, "fr": 1, "es": 1}, {})


def document_levels() -> list[Column]:
    """domain (from the number at the end of the source's name), language, source."""
    number = F.coalesce(F.expr(r"try_cast(regexp_extract(source, '([0-9]{1,9})$', 1) AS INT)"), F.lit(0))
    domain = F.element_at(F.array(F.lit("web"), F.lit("books"), F.lit("code")), number % 3 + 1)
    return [domain, F.col("lang"), F.col("source")]


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    mixed = mix(docs, WEIGHTS, levels=document_levels())
    return mixed.select("doc_id", "lang", "source", F.col("mix_epoch").alias("epoch"), F.col("mix_taken").alias("taken"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, lang, source, coalesce(lang, 'unknown') AS l2, coalesce(source, 'unknown') AS l3,
             (['web', 'books', 'code'])[coalesce(try_cast(regexp_extract(source, '([0-9]{1,9})$', 1) AS INTEGER), 0) % 3 + 1] AS l1,
             CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS tokens FROM documents),
leaf AS (SELECT l1, l2, l3, CAST(sum(tokens) AS BIGINT) AS tokens FROM d GROUP BY ALL),
total AS (SELECT CAST(coalesce(sum(tokens), 0) AS BIGINT) * 60 // 100 AS b FROM leaf),
c1 AS (SELECT l1, CAST(sum(tokens) AS BIGINT) * 2 AS cap, CASE l1 WHEN 'web' THEN 5 WHEN 'books' THEN 3 ELSE 2 END AS w, any_value(b) AS b FROM leaf, total GROUP BY l1),
f1 AS (SELECT *, cap * sum(w) OVER (ORDER BY cap / w, l1 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
         <= w * (b - coalesce(sum(cap) OVER (ORDER BY cap / w, l1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS f FROM c1),
b1 AS (SELECT l1, CAST(CASE WHEN f THEN cap ELSE w * (b - coalesce(sum(cap) FILTER (f) OVER (), 0)) // sum(w) FILTER (NOT f) OVER () END AS BIGINT) AS b FROM f1),
c2 AS (SELECT l1, l2, CAST(sum(tokens) AS BIGINT) * 2 AS cap, CASE l2 WHEN 'en' THEN 6 WHEN 'de' THEN 2 ELSE 1 END AS w, any_value(b) AS b FROM leaf JOIN b1 USING (l1) GROUP BY l1, l2),
f2 AS (SELECT *, cap * sum(w) OVER (PARTITION BY l1 ORDER BY cap / w, l2 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
         <= w * (b - coalesce(sum(cap) OVER (PARTITION BY l1 ORDER BY cap / w, l2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS f FROM c2),
b2 AS (SELECT l1, l2, CAST(CASE WHEN f THEN cap ELSE w * (b - coalesce(sum(cap) FILTER (f) OVER (PARTITION BY l1), 0)) // sum(w) FILTER (NOT f) OVER (PARTITION BY l1) END AS BIGINT) AS b FROM f2),
c3 AS (SELECT l1, l2, l3, CAST(sum(tokens) AS BIGINT) * 2 AS cap, 1 AS w, any_value(b) AS b FROM leaf JOIN b2 USING (l1, l2) GROUP BY l1, l2, l3),
f3 AS (SELECT *, cap * sum(w) OVER (PARTITION BY l1, l2 ORDER BY cap / w, l3 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
         <= w * (b - coalesce(sum(cap) OVER (PARTITION BY l1, l2 ORDER BY cap / w, l3 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS f FROM c3),
b3 AS (SELECT l1, l2, l3, CAST(CASE WHEN f THEN cap ELSE w * (b - coalesce(sum(cap) FILTER (f) OVER (PARTITION BY l1, l2), 0)) // sum(w) FILTER (NOT f) OVER (PARTITION BY l1, l2) END AS BIGINT) AS b FROM f3),
p AS (SELECT l1, l2, l3, CASE WHEN tokens > 0 THEN b // tokens ELSE 0 END AS n_full, CASE WHEN tokens > 0 THEN b % tokens ELSE 0 END AS rest FROM leaf JOIN b3 USING (l1, l2, l3)),
o AS (SELECT d.*, n_full, rest, md5('7:' || n_full || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place FROM d JOIN p USING (l1, l2, l3)),
s AS (SELECT *, sum(tokens) OVER (PARTITION BY l1, l2, l3 ORDER BY place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - sum(tokens) OVER (PARTITION BY l1, l2, l3, place) AS start FROM o)
SELECT doc_id, lang, source, CAST(n_full AS BIGINT) AS epoch, CAST(least(tokens, rest - start) AS BIGINT) AS taken FROM s WHERE start < rest
UNION ALL
SELECT doc_id, lang, source, CAST(e AS BIGINT) AS epoch, tokens AS taken FROM (SELECT *, unnest(range(n_full)) AS e FROM o)
"""
