"""Mixing sources to target weights by hierarchical budgeting. Only DataFrame functions.

The tree is domain > language > source. Each inner node's budget is dealt to its children by weight; a child can take no
more than its whole subtree can supply (tokens x most epochs). What a child can't take goes to its siblings by weight,
and only what all of them can't take comes to the parent's siblings, since a parent never gets more than its subtree's
supply. Dealing among children is one pass over them sorted by supply / weight (water-filling), in whole tokens.

A leaf's budget is met from seeded epochs: epoch e orders the leaf's documents by md5(seed:epoch:doc_id). Whole epochs
come first, then the prefix of the next whose documents begin below the remaining budget. The prefix is found without
sorting a leaf: tokens are summed by the hash's first two hex digits, then, of the bucket in which the budget runs out, by
its first four, and so on (256 buckets a leaf each time), and only the last such bucket is ordered: 1 / 2^24 of a leaf. The cut is a hash value, so the filter is a join with one row a leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize

SEED, EPOCHS, SHARE = 42, 4, 0.6
#: Hex digits of the order value in the buckets of each step.
DIGITS = (2, 4, 6)
#: Default domain of a source and weights: numbered sources in five domains; unknown names get weight 1.
DOMAIN_SQL = "concat('d', coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) as int), 0) div 4)"
WEIGHTS = {"domain": {"d0": 4, "d1": 2}, "lang": {"en": 3, "de": 2}, "source": {"src0": 2}}
TREE = ["domain", "lang", "source"]


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    w = F.lit(1)
    for name, x in weights.get(level, {}).items():
        w = F.when(F.col(level) == name, F.lit(int(x))).otherwise(w)
    return w.cast("long")


def _deal(children: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Adds alloc to rows (parent..., child, given, supply, w): whole tokens, water-filled among the parent's children.

    In order of supply / weight a child is full if its share of what is left is its supply or more.
    """
    order = [F.col("supply") / F.col("w"), F.col(child).asc_nulls_first()]
    w = Window.partitionBy(*parent).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    after = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    x = children.withColumn("used", F.coalesce(F.sum("supply").over(before), F.lit(0))).withColumn("ws", F.sum("w").over(after))
    x = x.withColumn("left", F.col("given") - F.col("used")).withColumn("share", F.floor(F.greatest("left", F.lit(0)) * F.col("w") / F.col("ws")))
    x = x.withColumn("full", (F.col("left") > 0) & (F.col("share") >= F.col("supply")))
    x = x.withColumn("open", F.max(F.when(~F.col("full"), F.lit(1)).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # from the first that isn't full, all share what was left there
    x = x.withColumn("rest", F.first(F.when(F.col("open") == 1, F.struct("left", "ws")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    alloc = F.when(F.col("open") == 0, F.col("supply")).otherwise(F.least("supply", F.floor(F.greatest(F.col("rest.left"), F.lit(0)) * F.col("w") / F.col("rest.ws"))))
    return x.withColumn("alloc", alloc.cast("long")).drop("used", "ws", "left", "share", "full", "open", "rest", "given")


def budgets(leaves: DataFrame, target: Column, epochs: int = EPOCHS, weights: dict | None = None) -> DataFrame:
    """(domain, lang, source, tokens, docs, alloc) for leaves (domain, lang, source, tokens, docs); target: tokens wanted in all.

    Windows here run over nodes of the tree, whose number is that of different sources, not of documents.
    """
    weights = WEIGHTS if weights is None else weights
    supply = leaves.withColumn("supply", F.col("tokens") * epochs)
    total = supply.agg(F.sum("supply").alias("supply"), F.sum("tokens").alias("tokens")).select(F.least(F.col("supply"), target).cast("long").alias("given"), F.lit(1).alias("root"))
    given, above = total, ["root"]
    for depth, level in enumerate(TREE):
        names = TREE[: depth + 1]
        nodes = supply.withColumn("root", F.lit(1)).groupBy("root", *names).agg(F.sum("supply").alias("supply")).withColumn("w", _weight(level, weights))
        same = [nodes[c].eqNullSafe(given[c]) for c in above]
        cond = same[0]
        for s in same[1:]:
            cond = cond & s
        rows = nodes.join(given, cond).select(*(nodes[c] for c in ["root", *names]), "supply", "w", "given")
        dealt = _deal(rows, above, level)
        given, above = dealt.select("root", *names, F.col("alloc").alias("given")), ["root", *names]
    on = given.select(*(F.col(c).alias(f"_{c}") for c in TREE), F.col("given").alias("alloc"))
    cond = leaves["domain"].eqNullSafe(F.col("_domain")) & leaves["lang"].eqNullSafe(F.col("_lang")) & leaves["source"].eqNullSafe(F.col("_source"))
    return leaves.join(on, cond).select(*TREE, "tokens", "docs", "alloc")


def _order(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))


def plan(counted: DataFrame, share: float, epochs: int, seed: int, weights: dict | None) -> DataFrame:
    """(domain, lang, source, whole, cut): whole epochs of a leaf, and the order value up to which the next is taken.

    counted: doc_id and the leaf's columns with n_tokens, already written down. cut is null if nothing more is taken.
    """
    leaves = counted.groupBy(*TREE).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    given = budgets(leaves, F.floor(F.col("tokens") * F.lit(share)), epochs, weights)
    given = given.withColumn("whole", F.when(F.col("tokens") > 0, F.expr("alloc div tokens")).otherwise(F.lit(0))).withColumn("rest", F.col("alloc") - F.col("whole") * F.col("tokens"))
    given = materialize(given.repartition(1), "budgets")  # a row for each leaf: one small file
    short = given.select(*(F.col(c).alias(f"_{c}") for c in TREE), "whole", "rest").filter("rest > 0")
    leaf = F.col("domain").eqNullSafe(F.col("_domain")) & F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    key = counted.join(short, leaf).withColumn("o", _order(seed, F.col("whole"), F.col("doc_id"))).select(*TREE, "rest", "o", "n_tokens")
    w = Window.partitionBy(*TREE).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    base = F.lit(0).cast("long")
    for digits in DIGITS:  # the bucket in which the budget runs out, then its own
        key = key.withColumn("b", F.substring("o", 1, digits)).withColumn("base", base)
        sums = key.groupBy(*TREE, "rest", "base", "b").agg(F.sum("n_tokens").alias("n"))
        edge = sums.withColumn("begin", F.col("base") + F.coalesce(F.sum("n").over(w), F.lit(0))).filter("begin < rest").groupBy(*TREE, "rest").agg(F.max(F.struct("b", "begin")).alias("x"))
        edge = edge.select(*(F.col(c).alias(f"_{c}") for c in TREE), F.col("x.b").alias("eb"), F.col("x.begin").alias("at"))
        key = materialize(key.drop("base", "at").join(edge, leaf & (F.col("b") == F.col("eb"))).select(*TREE, "rest", "o", "n_tokens", "at"), "edge")
        base = F.col("at")
    upto = F.sum("n_tokens").over(Window.partitionBy(*TREE).orderBy("o"))  # of all documents up to this order value, ties together
    own = F.sum("n_tokens").over(Window.partitionBy(*TREE, "o"))
    cut = key.withColumn("begin", F.col("at") + upto - own).filter("begin < rest").groupBy(*TREE).agg(F.max("o").alias("cut"))
    cut = cut.select(*(F.col(c).alias(f"_{c}") for c in TREE), "cut")
    return given.join(cut, leaf, "left").select(*TREE, "tokens", "alloc", "whole", "cut")


def selected(docs: DataFrame, share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED, weights: dict | None = None, domain_sql: str = DOMAIN_SQL) -> DataFrame:
    """(row: a struct of the columns of `docs`, domain, n_tokens, epoch): a row for each epoch in which a document is taken.

    Tokens are words (runs of other than white space). The target is `share` of all tokens. Defined results: null lang or
    source are names of their own with weight 1; a null text has no tokens: it is taken in whole epochs, and in a prefix
    if its order value is within; a very long text is one document like others; rows that repeat a doc_id share its place
    in the order and are taken alike; an empty table gives no rows; other columns stay, whatever they are called. A leaf
    without tokens gives none of its documents.
    """
    whole = F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in docs.columns)).alias("row")
    rows = docs.select(whole, F.expr(domain_sql).alias("domain"), F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_tokens"))
    counted = materialize(rows.select("row.doc_id", "domain", "row.lang", "row.source", "n_tokens"), "counted")
    p = plan(counted, share, epochs, seed, weights).select(F.col("domain").alias("_d"), F.col("lang").alias("_l"), F.col("source").alias("_s"), "whole", "cut")
    p = materialize(p.repartition(1), "plan")
    leaf = F.col("domain").eqNullSafe(F.col("_d")) & F.col("row.lang").eqNullSafe(F.col("_l")) & F.col("row.source").eqNullSafe(F.col("_s"))
    last = F.coalesce(_order(seed, F.col("whole"), F.col("row.doc_id")) <= F.col("cut"), F.lit(False))
    taken = F.filter(F.sequence(F.lit(0), F.col("whole")), lambda e: (e < F.col("whole")) | last)
    return rows.join(p, leaf).select("row", "domain", "n_tokens", F.explode(taken).alias("epoch"))


def taken(docs: DataFrame, **options) -> DataFrame:
    """The rows and columns of `docs`, a row for each epoch in which `selected` takes it."""
    return selected(docs, **options).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def mix(docs: DataFrame, **options) -> DataFrame:
    """Per document and epoch taken: doc_id, domain, lang, source, n_tokens, epoch."""
    x = selected(docs.select("doc_id", "text", "lang", "source"), **options)
    return x.select("row.doc_id", "domain", "row.lang", "row.source", "n_tokens", F.col("epoch").cast("long").alias("epoch"))


def _case(level: str) -> str:
    names = WEIGHTS.get(level, {})
    return "cast(case " + " ".join(f"when {level} = '{n}' then {w}" for n, w in names.items()) + " else 1 end as bigint)" if names else "cast(1 as bigint)"


def _level_sql(k: int) -> str:
    level, names, above = TREE[k], ", ".join(TREE[: k + 1]), TREE[:k]
    part = f"partition by {', '.join(above)} " if above else ""
    on = " and ".join(f"n{k}.{c} is not distinct from g{k - 1}.{c}" for c in above) or "true"
    given = f"g{k - 1}.alloc" if k else "g.given"
    order = f"order by supply / w, {level} nulls first"
    ahead = f"{part}{order} rows between unbounded preceding"
    return f"""n{k} as (select {names}, sum(supply) as supply, {_case(level)} as w from leaf group by {names}),
a{k} as (select n{k}.*, {given} as given from n{k} join {f"g{k - 1}" if k else "g"} on {on}),
b{k} as (select *, coalesce(sum(supply) over ({ahead} and 1 preceding), 0) as used, sum(w) over ({part}{order} rows between current row and unbounded following) as ws from a{k}),
c{k} as (select *, given - used as lft, floor(greatest(given - used, 0) * w / ws) as share from b{k}),
d{k} as (select *, max(case when lft > 0 and share >= supply then 0 else 1 end) over ({ahead} and current row) as open from c{k}),
e{k} as (select *, first_value(case when open = 1 then lft end ignore nulls) over ({ahead} and current row) as rl, first_value(case when open = 1 then ws end ignore nulls) over ({ahead} and current row) as rw from d{k}),
g{k} as (select {names}, cast(case when open = 0 then supply else least(supply, floor(greatest(rl, 0) * w / rw)) end as bigint) as alloc from e{k}),"""


ORACLE_SQL = f"""
with c as (select doc_id, concat('d', coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) as int), 0) // 4) as domain, lang, source,
  cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as n_tokens from documents),
leaf as (select domain, lang, source, cast(sum(n_tokens) as bigint) as tokens, cast(sum(n_tokens) as bigint) * {EPOCHS} as supply from c group by all),
g as (select least(cast(sum(supply) as bigint), cast(floor(sum(tokens) * cast({SHARE} as double)) as bigint)) as given from leaf),
{_level_sql(0)}
{_level_sql(1)}
{_level_sql(2)}
b as (select leaf.*, alloc, case when tokens > 0 then alloc // tokens else 0 end as whole from leaf join g2 on leaf.domain is not distinct from g2.domain and leaf.lang is not distinct from g2.lang and leaf.source is not distinct from g2.source),
k as (select c.*, whole, alloc - whole * tokens as rest, md5(concat('{SEED}:', whole, ':', coalesce(cast(doc_id as varchar), 'null'))) as o
  from c join b on c.domain is not distinct from b.domain and c.lang is not distinct from b.lang and c.source is not distinct from b.source),
u as (select *, sum(n_tokens) over (partition by domain, lang, source order by o) - sum(n_tokens) over (partition by domain, lang, source, o) as begin_at from k),
x as (select *, max(case when rest > 0 and begin_at < rest then o end) over (partition by domain, lang, source) as cut from u)
select doc_id, domain, lang, source, n_tokens, cast(e as bigint) as epoch
from (select *, unnest(generate_series(0, whole)) as e from x) where e < whole or (e = whole and coalesce(o <= cut, false))
"""
