"""Mixing sources to target weights by Sainte-Lague apportionment.

Words are dealt in blocks of `block_words`. A first apportionment gives each source a whole number of blocks in
proportion to its target, seat by seat to the highest quotient target / (2k + 1). A second one, of the same kind,
gives each shard of the source its integer quota. A shard is a seeded choice of the source's documents in a seeded
order, some `shard_words` long, cut into equal blocks; its quota is taken as a run of consecutive blocks, round the
shard's end if need be, from a seeded first block on. So nearly all documents are taken whole, 0, 1 or 2 times.
Blocks are never rows: a shard's quota and a document's place in it give the words taken in closed form.

No shuffle of `mix` carries text. The sizes are worked out once; the running total is within a shard, and seats are
apportioned by sums and bins, so that a source with a third of all rows is spread over many tasks. Tables of a row per
source or per shard hold no documents; those of a row per source are ranked in one task.

Edge cases: a null text has size 0; a null source is a source of its own, the last; a null identifier is an
identifier like others. Documents of size 0 are never taken. Repeated rows are rows like others: among equal
(identifier, size) it is left open which row gets the larger count. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import cut, id_text, word_count, words

WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEATS = 2
BLOCK_WORDS = 64
SHARD_WORDS = 1 << 18
SEED = 17


def mark(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def key(column: Column) -> Column:
    """A text for each identifier, null included."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


def seeded(seed: int, *parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


def number(digest: Column) -> Column:
    """The first 32 bits of a hex digest."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def fill(sources: DataFrame, share: float, repeats: int) -> DataFrame:
    """Adds target: `share` of all sizes by weight, at most `repeats` times a source's size, what is above going to the others by weight.

    That is least(cap, level * weight) for one level. With sources in order of cap / weight, those before some
    place are at their caps, and the level is what remains, by weight, for that place and those after it.
    """
    cap = F.col("source_size") * F.lit(repeats)
    ordered = Window.orderBy((cap / F.col("weight")).asc(), "rank")
    before, after = ordered.rowsBetween(Window.unboundedPreceding, -1), ordered.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    stepped = sources.withColumns({
        "cap": cap.cast("double"),
        "level": (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0))) / F.sum("weight").over(after),
    })
    free = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    level = F.max(free).over(everything)  # from the first such place on, levels fall
    return stepped.withColumn("target", F.coalesce(F.least("cap", level * F.col("weight")), F.col("cap"))).drop("cap", "level")


#: Bins of quotients, of which only one is ranked.
BINS = 1 << 14


def apportion(parties: DataFrame, votes: str, seats: str, cap: str, order: str, name: str, group: str = "rank") -> DataFrame:
    """Adds `name`: each party's seats of its group's, by highest quotients votes / (2k + 1), cap at most.

    A seat that a party's cap keeps from it goes to the next quotient. With n parties, rounding votes by a divisor
    that is n/2 seats too large gives no party a seat too many. Divisors for more and more seats are tried by sums over the group, and
    the first that gives enough has none too few. Only seats in between are open. Their quotients are counted in bins; the bins before the
    one in which the group's seats run out win whole, and only that one's quotients are ranked. So no task sees a group's parties.
    """
    kept = parties.columns
    total = parties.groupBy(group).agg(F.count("*").alias("_n"), F.sum(votes).alias("_v"), F.max(seats).alias("_q"))
    rows = parties.join(total.withColumnRenamed(group, "_g"), F.col(group) == F.col("_g"))
    by = lambda q: F.least(F.col(cap), F.when(F.col("_v") > 0, F.floor(F.col(votes) * q / F.col("_v") + F.lit(0.5))).otherwise(0).cast("long"))
    steps = [F.col("_q") + F.col("_n") / 2 * 4**i for i in range(8)]
    sums = rows.groupBy(F.col(group).alias("_s")).agg(*[F.sum(by(q)).alias(f"_t{i}") for i, q in enumerate(steps)])
    rows = rows.join(sums, F.col(group) == F.col("_s"))
    last = F.col(cap)
    for i in reversed(range(8)):
        last = F.when(F.col(f"_t{i}") >= F.col("_q"), by(steps[i]) + 1).otherwise(last)
    bounded = rows.withColumn("_sure", F.greatest(F.lit(0), by(F.col("_q") - F.col("_n") / 2) - 1)).withColumn("_last", F.when(F.col(votes) > 0, F.least(F.col(cap), F.greatest("_sure", last))).otherwise(0))
    bounded = cut(bounded.select(*kept, "_q", "_sure", "_last"))
    tried = bounded.select(group, order, votes, F.explode(F.when(F.col("_last") > F.col("_sure"), F.sequence(F.col("_sure"), F.col("_last") - 1))).alias("_k"))
    tried = tried.withColumn("_x", F.col(votes) / (2 * F.col("_k") + 1))
    span = tried.groupBy(F.col(group).alias("_g")).agg(F.min("_x").alias("_low"), F.max("_x").alias("_high"))
    place = F.when(F.col("_high") > F.col("_low"), F.floor((F.col("_high") - F.col("_x")) / (F.col("_high") - F.col("_low")) * BINS)).otherwise(0)
    tried = tried.join(span, F.col(group) == F.col("_g")).select(group, order, "_k", "_x", place.alias("_bin"))
    bins = tried.groupBy(group, "_bin").agg(F.count("*").alias("_c")).withColumn("_to", F.sum("_c").over(Window.partitionBy(group).orderBy("_bin")))
    opened = bounded.groupBy(F.col(group).alias("_g")).agg((F.max("_q") - F.sum("_sure")).alias("_open"))
    reached = bins.join(opened, F.col(group) == F.col("_g")).where("_to > _open").groupBy(F.col(group).alias("_g")).agg(F.min("_bin").alias("_edge"), (F.first("_open") - F.min(F.col("_to") - F.col("_c"))).alias("_rest"))
    marked = tried.join(reached, F.col(group) == F.col("_g"), "left")
    ranked = marked.where("_bin = _edge").withColumn("_nth", F.row_number().over(Window.partitionBy(group).orderBy(F.col("_x").desc(), order))).where("_nth <= _rest")
    won = marked.where("_edge is null or _bin < _edge").select(group, order).unionByName(ranked.select(group, order)).groupBy(F.col(group).alias("_g"), F.col(order).alias("_p")).agg(F.count("*").alias("_won"))
    out = bounded.join(won, (F.col(group) == F.col("_g")) & (F.col(order) == F.col("_p")), "left")
    return out.select(*kept, (F.col("_sure") + F.coalesce("_won", F.lit(0))).cast("long").alias(name))


def mix(
    docs: DataFrame, *, weights: Sequence[float] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED,
    id: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """One row per document: id, size, source_size, target, taken, and what is taken of it.

    whole: times that all of it is taken; first/second: up to two runs of words [from, to) taken once more.
    Sources in order of their names weigh weights[0], weights[1], ..., over and over.
    """
    sized = cut(docs.select(F.col(id).alias("id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), mark(F.col(text)).alias("mark")))
    ranked = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    targets = fill(ranked, share, repeats).withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long"))
    targets = cut(targets)

    digest = seeded(seed, id_text(F.col("id")))
    placed = sized.join(targets.select(F.col("source").alias("of"), "rank", "shards"), F.col("source").eqNullSafe(F.col("of"))).select(
        "id", "size", "mark", "rank", digest.alias("digest"), F.pmod(number(digest), F.col("shards")).alias("shard")
    )
    shards = placed.groupBy("rank", "shard").agg(F.sum("size").alias("words"))
    n_blocks = F.when(F.col("words") > 0, F.greatest(F.lit(1), F.floor((2 * F.col("words") + block_words) / (2 * block_words)))).otherwise(0).cast("long")
    shards = cut(shards.withColumn("blocks", n_blocks))

    all_blocks = shards.groupBy("rank").agg(F.sum("blocks").alias("source_blocks"))
    seats = targets.agg(F.floor(F.sum("target") / block_words + 0.5).cast("long").alias("seats")).withColumn("all", F.lit(0))
    by_source = targets.join(all_blocks, "rank").select("rank", "target", (repeats * F.col("source_blocks")).alias("cap"), F.lit(0).alias("all")).join(seats, "all")
    by_source = apportion(by_source, "target", "seats", "cap", "rank", "source_quota", group="all")
    with_quota = shards.join(by_source.select("rank", "source_quota"), "rank").withColumns({"votes": F.col("words").cast("double"), "cap": repeats * F.col("blocks")})
    quotas = apportion(with_quota, "votes", "source_quota", "cap", "shard", "quota")

    # a run of quota mod blocks consecutive blocks, from a seeded one on, besides quota div blocks rounds of the shard
    per = F.nullif(F.col("blocks"), F.lit(0))
    more = F.col("quota") % per
    first = F.pmod(number(seeded(seed, F.col("rank").cast("string"), F.col("shard").cast("string"))), per)
    place = lambda block: F.floor(block * F.col("words") / per).cast("long")
    last = first + more
    runs = quotas.select(
        F.col("rank").alias("run_rank"), F.col("shard").alias("run_shard"),
        F.coalesce(F.floor(F.col("quota") / per), F.lit(0)).cast("long").alias("whole"),
        F.coalesce(place(first), F.lit(0)).alias("run_from"),
        F.coalesce(F.when(last <= F.col("blocks"), place(last)).otherwise(F.col("words")), F.lit(0)).alias("run_to"),
        F.coalesce(F.when(last > F.col("blocks"), place(last - F.col("blocks"))), F.lit(0)).alias("wrap_to"),
    )
    # the widest size of a shard bounds the rows of one task here
    in_order = Window.partitionBy("rank", "shard").orderBy("digest", F.col("id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, 0)
    spread = placed.withColumn("end", F.sum("size").over(in_order)).withColumn("begin", F.col("end") - F.col("size"))
    joined = spread.join(runs, (F.col("rank") == F.col("run_rank")) & (F.col("shard") == F.col("run_shard")))
    clip = lambda x: F.least(F.greatest(x, F.col("begin")), F.col("end")) - F.col("begin")
    taken = joined.select(
        "id", "size", "mark", "rank", "whole",
        clip(F.col("run_from")).alias("first_from"), clip(F.col("run_to")).alias("first_to"),
        clip(F.lit(0)).alias("second_from"), clip(F.col("wrap_to")).alias("second_to"),
    )
    out = taken.join(targets.select("rank", "source_size", "target"), "rank")
    return out.select(
        F.col("id").alias(id), "size", "source_size", "target",
        (F.col("whole") * F.col("size") + F.col("first_to") - F.col("first_from") + F.col("second_to") - F.col("second_from")).alias("taken"),
        "whole", "first_from", "first_to", "second_from", "second_to", "mark",
    )


def mixed_documents(docs: DataFrame, *, id: str = "doc_id", text: str = "text", source: str = "source", length: str = "n_chars", **options) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each time that a document is taken, in whole or as a run of its words.

    A whole document keeps its text as it is; a run's words are joined by single spaces.
    Rows are matched by identifier, size and a hash of the text, so only rows that repeat one another choose among decisions. The text is moved once.
    """
    plan = mix(docs, id=id, text=text, source=source, **options).where("taken > 0")
    take = F.struct("whole", "first_from", "first_to", "second_from", "second_to")
    plan = plan.select(key(F.col(id)).alias("__key"), F.col("size").alias("__size"), F.col("mark").alias("__mark"), take.alias("__take"))
    plan = plan.groupBy("__key", "__size", "__mark").agg(F.sort_array(F.collect_list("__take")).alias("__takes"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), key(F.col(id)).alias("__key"), word_count(F.col(text)).alias("__size"), mark(F.col(text)).alias("__mark"))
    joined = rows.join(plan, ["__key", "__size", "__mark"])
    nth = F.row_number().over(Window.partitionBy("__key", "__size", "__mark").orderBy(F.xxhash64("__row")))
    joined = joined.withColumn("__nth", nth).where(F.col("__nth") <= F.size("__takes")).select("__row", "__size", F.element_at("__takes", F.col("__nth")).alias("__plan")).select("__row", "__size", "__plan.*")
    part = lambda a, b: F.when(F.col(b) > F.col(a), F.struct(F.col(a).alias("a"), F.col(b).alias("b")))
    whole = F.struct(F.lit(0).cast("long").alias("a"), F.col("__size").alias("b"))
    takes = F.concat(F.array_repeat(whole, F.col("whole").cast("int")), F.array_compact(F.array(part("first_from", "first_to"), part("second_from", "second_to"))))
    pieces = joined.select("__row", "__size", F.explode(takes).alias("__take"))
    cut_text = F.when((F.col("__take.a") == 0) & (F.col("__take.b") == F.col("__size")), F.col(f"__row.{text}")).otherwise(
        F.array_join(F.slice(words(F.col(f"__row.{text}")), (F.col("__take.a") + 1).cast("int"), (F.col("__take.b") - F.col("__take.a")).cast("int")), " ")
    )
    pieces = pieces.withColumn("__text", cut_text)
    changed = {text: F.col("__text"), length: F.char_length("__text").cast("long")}
    return pieces.select(*[changed.get(c, F.col(f"__row.`{c}`")).alias(c) for c in docs.columns])
