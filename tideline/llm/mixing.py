"""Mixing sources to target weights by hierarchical budgeting; DataFrame operations only.

Leaves are (domain, language, source) triples. A token budget flows down the tree: at each node it is split among the
children by weight, none gets more than its subtree can give (its tokens times the epochs allowed), and what a child
cannot take goes to its siblings. Only when all siblings are full is a shortage left for the level above, whose own
split has already seen it, because capacities are those of whole subtrees. A leaf's budget buys full epochs and a prefix
of one more, in an order seeded anew for each epoch.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import WORD, few, forget, materialize

#: Hex digits of the order hash that make a slice of a leaf; a leaf's prefix is counted by slices, then within one.
SLICE_DIGITS = 3


def tokens(text: Column) -> Column:
    """Words of a text and one end token; a null text has the end token alone."""
    return (F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)) + 1).cast("long")


def weight_of(name: Column, weights: Mapping[str, int], rest: int) -> Column:
    out = F.lit(rest)
    for key, value in weights.items():
        out = F.when(name == key, value).otherwise(out)
    return out.cast("long")


def split(children: DataFrame, parent: list[str], budget: str, capacity: str, weight: str, out: str) -> DataFrame:
    """Splits each parent's budget among its children by weight, none above its capacity.

    Children in the order of capacity for their weight fill up one after another: one is full if its share of what is
    left exceeds its capacity. From the first that isn't, all get their share of what is left. Whole tokens; shares round
    down, so up to one token a child may stay unspent. All weights and tokens are longs.
    """
    ratio = [F.col(capacity) / F.col(weight), F.col(capacity), F.col(weight)]
    before = Window.partitionBy(*parent).orderBy(*ratio, "node").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*parent).orderBy(*ratio, "node").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.greatest(F.col(budget) - F.coalesce(F.sum(capacity).over(before), F.lit(0)), F.lit(0))
    step = children.withColumn("_left", left).withColumn("_weights", F.sum(weight).over(after))
    step = step.withColumn("_open", F.expr(f"CAST(_left AS DECIMAL(38, 0)) * {weight} < CAST({capacity} AS DECIMAL(38, 0)) * _weights"))
    level = Window.partitionBy(*parent).orderBy(*ratio, "node").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # What is left, and the weights it is shared by, where the first open child stands.
    step = step.withColumn("_at", F.first(F.when(F.col("_open"), F.struct("_left", "_weights")), ignorenulls=True).over(level))
    share = F.expr(f"CAST(CAST(_at._left AS DECIMAL(38, 0)) * {weight} div _at._weights AS BIGINT)")
    return step.withColumn(out, F.when(F.col("_at").isNull(), F.col(capacity)).otherwise(share)).drop("_left", "_weights", "_open", "_at")


def budgets(leaves: DataFrame, total: Column, epochs: int, domains: Mapping[str, int], languages: Mapping[str, int], sources: Mapping[str, int], rest: int) -> DataFrame:
    """Per leaf (domain, lang, source, tokens): its budget, full epochs and the tokens of the partial one."""
    weights = {"domain": domains, "lang": languages, "source": sources}
    for name, given in weights.items():
        leaves = leaves.where(weight_of(F.col(name), given, rest) > 0)
    leaves = leaves.withColumn("capacity", F.col("tokens") * epochs)
    langs = leaves.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity"))
    tops = langs.groupBy("domain").agg(F.sum("capacity").alias("capacity"))
    tops = tops.withColumns({"node": F.col("domain"), "w": weight_of(F.col("domain"), domains, rest), "root": F.lit(0), "b": total})
    tops = split(tops, ["root"], "b", "capacity", "w", "b0").select("domain", "b0")
    langs = langs.join(tops, "domain").withColumns({"node": F.col("lang"), "w": weight_of(F.col("lang"), languages, rest)})
    langs = split(langs, ["domain"], "b0", "capacity", "w", "b1").select("domain", "lang", "b1")
    leaves = leaves.join(langs, ["domain", "lang"]).withColumns({"node": F.col("source"), "w": weight_of(F.col("source"), sources, rest)})
    leaves = split(leaves, ["domain", "lang"], "b1", "capacity", "w", "budget")
    return leaves.select("domain", "lang", "source", "tokens", "budget", F.expr("budget div tokens").cast("int").alias("full_epochs"), F.expr("budget % tokens").alias("tail"))


LEAF = ["domain", "lang", "source"]


def _named(docs: DataFrame, domain: Column, seed: int, key: str, text: str, lang: str, source: str) -> dict[str, Column]:
    name = lambda c: F.coalesce(c.cast("string"), F.lit("none"))
    return {"domain": name(domain), "lang": name(F.col(lang)), "source": name(F.col(source)), "n_tokens": tokens(F.col(text))}


def _hash(seed: int, epoch: str, key: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(epoch).cast("string"), F.coalesce(F.col(key).cast("string"), F.lit("null"))).cast("binary"))


def _plan(thin: DataFrame, share: float, epochs: int, domains, languages, sources, rest: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Per leaf its full epochs and the slice (edge) in which its partial epoch ends; and the rows of the edges with their tail_tokens."""
    leaves = thin.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens"))
    whole = leaves.agg(F.sum("tokens")).first()[0] or 0
    plan = budgets(leaves, F.lit(whole * round(share * 1000) // 1000), epochs, domains or {}, languages or {}, sources or {}, rest)
    plan = materialize(plan.select(*LEAF, "full_epochs", "tail"), "mixing-plan")
    dealt = thin.join(few(plan), LEAF).withColumn("h", _hash(seed, "full_epochs", "k")).withColumn("slice", F.substring("h", 1, SLICE_DIGITS))
    slices = materialize(dealt.groupBy(*LEAF, "slice").agg(F.sum("n_tokens").alias("n"), F.max("tail").alias("tail")), "mixing-slices")
    # Digit by digit: of a leaf at most 16 sums meet in a window, however many documents and slices it has.
    ends = slices.groupBy(*LEAF).agg(F.max("tail").alias("room")).where("room > 0").withColumn("edge", F.lit(""))
    for digits in range(1, SLICE_DIGITS + 1):
        inside = slices.join(few(ends), LEAF).where(F.substring("slice", 1, digits - 1) == F.col("edge"))
        sums = inside.groupBy(*LEAF, F.substring("slice", 1, digits).alias("next")).agg(F.sum("n").alias("n"), F.max("room").alias("room"))
        so_far = Window.partitionBy(*LEAF).orderBy("next").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("before", F.coalesce(F.sum("n").over(so_far), F.lit(0)))
        found = sums.where((F.col("before") < F.col("room")) & (F.col("room") <= F.col("before") + F.col("n")))
        ends = materialize(found.select(*LEAF, (F.col("room") - F.col("before")).alias("room"), F.col("next").alias("edge")), "mixing-ends")
    plan = materialize(plan.drop("tail").join(few(ends), LEAF, "left"), "mixing-edges")
    forget(slices)
    rank = Window.partitionBy(*LEAF).orderBy("h", "k", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    edge = dealt.drop("full_epochs", "tail").join(few(plan), LEAF).where(F.col("slice") == F.col("edge"))
    edge = edge.withColumn("begin", F.coalesce(F.sum("n_tokens").over(rank), F.lit(0)))
    edge = edge.withColumn("tail_tokens", F.greatest(F.lit(0), F.least(F.col("n_tokens"), F.col("room") - F.col("begin"))).cast("long"))
    return plan, edge


def pick(docs: DataFrame, domain: Column, share: float = 0.5, epochs: int = 4, seed: int = 11, domains: Mapping[str, int] | None = None, languages: Mapping[str, int] | None = None, sources: Mapping[str, int] | None = None, rest: int = 1, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """What the mixture takes of each document.

    share: total budget as a share of all tokens (whole thousandths); a leaf gives at most `epochs` times its tokens. Weights
    are whole numbers by name; names not given have weight `rest`; what weighs 0 is left out. A null domain, language
    or source is the name `none`.
    Returns key, domain, lang, source, n_tokens, full_epochs (times the document is taken whole) and tail_tokens (tokens
    taken in the partial epoch; of the document at the boundary a prefix), for documents of which anything is taken.
    Epoch e orders a leaf's documents by MD5 of seed, e and key; ties by key, then tokens. An empty table gives no rows;
    rows that repeat are documents of their own.

    Documents are never ordered within a whole leaf: tokens are summed by leaf and slice of the order, and only the slice
    in which a leaf's prefix ends is ranked row by row.
    """
    thin = docs.select(F.col(key).alias("k"), *(c.alias(n) for n, c in _named(docs, domain, seed, key, text, lang, source).items()))
    thin = materialize(thin, "mixing")
    plan, edge = _plan(thin, share, epochs, domains, languages, sources, rest, seed)
    at = thin.join(few(plan), LEAF).withColumn("slice", F.substring(_hash(seed, "full_epochs", "k"), 1, SLICE_DIGITS))
    other = at.where(F.col("edge").isNull() | (F.col("slice") != F.col("edge")))
    other = other.withColumn("tail_tokens", F.when(F.col("slice") < F.col("edge"), F.col("n_tokens")).otherwise(F.lit(0)).cast("long"))
    columns = [F.col("k").alias(key), *LEAF, "n_tokens", "full_epochs", "tail_tokens"]
    out = other.select(*columns).unionByName(edge.select(*columns))
    return out.where((F.col("full_epochs") > 0) | (F.col("tail_tokens") > 0))


def mix(docs: DataFrame, domain: Column, share: float = 0.5, epochs: int = 4, seed: int = 11, domains: Mapping[str, int] | None = None, languages: Mapping[str, int] | None = None, sources: Mapping[str, int] | None = None, rest: int = 1, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The mixture's documents as whole rows with all their columns: one for each full epoch, and one if the partial epoch takes any of it.

    The texts stay where they are: rows meet the leaves' plan and the few rows of the edges, both broadcast if they are small.
    Rows of an edge that share key and leaf are taken if any of them is.
    """
    names = _named(docs, domain, seed, key, text, lang, source)
    thin = docs.select(F.col(key).alias("k"), *(c.alias(n) for n, c in names.items()))
    plan, edge = _plan(materialize(thin, "mixing"), share, epochs, domains, languages, sources, rest, seed)
    mine = {n: f"_mix_{n}" for n in [*LEAF, "full_epochs", "edge"]}
    plan = plan.select(*(F.col(n).alias(m) for n, m in mine.items()))
    picked = materialize(edge.where(F.col("tail_tokens") > 0).select(F.col("k").alias("_mix_k"), *(F.col(n).alias(f"_mix_e_{n}") for n in LEAF), F.lit(1).alias("_mix_hit")).distinct(), "mixing-picked")
    rows = docs.withColumns({mine[n]: names[n] for n in LEAF}).join(few(plan), [mine[n] for n in LEAF])
    rows = rows.withColumn("_mix_slice", F.substring(_hash(seed, mine["full_epochs"], key), 1, SLICE_DIGITS))
    same = F.col(key).eqNullSafe(F.col("_mix_k"))
    for n in LEAF:
        same = same & (F.col(mine[n]) == F.col(f"_mix_e_{n}"))
    rows = rows.join(few(picked), same, "left")
    more = (F.col("_mix_slice") < F.col(mine["edge"])) | (F.col("_mix_hit") == 1)
    times = F.col(mine["full_epochs"]) + F.coalesce(more, F.lit(False)).cast("int")
    return rows.where(times > 0).withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), times))).select(*docs.columns)
