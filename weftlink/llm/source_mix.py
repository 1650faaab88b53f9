"""Mixing sources to target weights by exact token budgets.

1. Every row gets its number of words and a random key, a hash of its id and text. This narrow table is written; texts
   are read once.
2. Sources in order take the weights in turn. Their targets share all words by weight; a target stops at `most` times
   its source's words, and what it leaves is shared by weight among the others, until none is above. So a target is
   min(most x words, rate x weight) for one rate, found where the sources, in order of words by weight, begin to lie
   above it: a running sum over sources, nothing of which meets in one task or on the driver but three numbers.
3. Rows are range partitioned and sorted by source and key, so a hot source fills many ranges. Words before a row are the
   sum inside its range, made in passing, and the sums of its source's earlier ranges, a window over one row for each.
4. A source's budget is its target to the nearest word: whole epochs of all its rows, then rows in order of their keys up
   to the budget; the row at the cut gives its first words.

Every row counts: rows of one id or without id, and repeated ones, are rows of their own; a null id has a key from its
text. Equal rows are next to each other and take what their places get, in any order. Null and empty texts have 0 words
and give none. A null source is one of its own, behind the others. With no words at all all targets are 0. Reruns agree:
keys depend on the row alone. An empty table gives one. Columns of the input never clash with those made here.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlink.llm.scratch import Scratch

WEIGHTS = (5, 2, 1)
MOST = 3
_WORDS = r"[^\x20\x09-\x0D]+"


def _running(by: int, amounts: Sequence[int]):
    """Adds the number of the range, of the run of equal values of column `by` in it, and each amount's sum over the run so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, last, sums = TaskContext.get().partitionId(), -1, None, np.zeros(len(amounts), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(by)
            code = key.dictionary_encode(null_encoding="encode")
            at = code.indices.to_numpy(zero_copy_only=False)
            new = np.concatenate([[number < 0 or code.dictionary[int(at[0])].as_py() != last], at[1:] != at[:-1]])
            numbers = number + np.cumsum(new)
            before = []
            for k, c in enumerate(amounts):
                value = batch.column(c).to_numpy(zero_copy_only=False)
                total = np.cumsum(value) - value + sums[k]
                begin = np.where(new, total, 0)
                before.append(total - np.maximum.accumulate(begin))
                sums[k] = before[-1][-1] + value[-1]
            number, last = int(numbers[-1]), code.dictionary[int(at[-1])].as_py()
            extra = [pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(numbers.astype(np.int32)), *map(pa.array, before)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "_part", "_run", *(f"_before{k}" for k in range(len(amounts)))])

    return run


def prefix_sums(df: DataFrame, by: str, order: Sequence[str], amounts: Sequence[str], scratch: Scratch, name: str) -> DataFrame:
    """df with `<amount>_before`: the sum of the amount (a long, not null) over the rows of the same `by` that come earlier in `order`; no amount is negative.

    Ranges are cut anywhere, also inside a value of `by`, so none of them grows with its largest value. The ranged rows are
    written, so all later reads see the same ranges, whatever is lost.
    """
    keys = [F.col(by).asc_nulls_last(), *order]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    schema = ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes), "_part int", "_run int", *(f"_before{k} long" for k in range(len(amounts)))])
    ranged = scratch.save_freeing(ranged.mapInArrow(_running(df.columns.index(by), [df.columns.index(a) for a in amounts]), schema), name)
    runs = ranged.groupBy("_part", "_run").agg(F.first(by).alias("_by"), *(F.sum(a).alias(f"_sum{k}") for k, a in enumerate(amounts)))
    earlier = "sum(_sum{0}) OVER (PARTITION BY _by ORDER BY _part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    runs = runs.select("_part", "_run", *(F.expr(f"coalesce({earlier.format(k)}, 0)").alias(f"_base{k}") for k in range(len(amounts))))
    return ranged.join(runs, ["_part", "_run"]).select(*df.columns, *((F.col(f"_base{k}") + F.col(f"_before{k}")).alias(f"{a}_before") for k, a in enumerate(amounts)))


def source_targets(sizes: DataFrame, weights: Sequence[int], most: int, scratch: Scratch) -> DataFrame:
    """(_source, _total, _target double, _budget long) of sizes(_source, _total): one row for each source."""
    if not weights or any(w < 1 for w in weights) or most < 1:
        raise ValueError("weights and the most epochs are positive integers")
    common = math.lcm(*weights)
    one = sizes.select("_source", "_total", F.lit(1).cast("long").alias("_one"), F.lit(0).alias("_all"))
    ranked = prefix_sums(one, "_all", [F.col("_source").asc_nulls_last()], ["_one"], scratch, "ranks")
    chosen = F.array(*map(F.lit, weights))[(F.col("_one_before") % len(weights)).cast("int")].cast("long")
    weighted = ranked.select("_source", "_total", "_all", chosen.alias("_weight"))
    # where most x words / weight, times what all weights divide, begins to lie above the rate
    weighted = weighted.withColumn("_cap", F.col("_total") * most).withColumn("_key", (F.col("_cap") * F.floor(F.lit(common) / F.col("_weight"))).cast("decimal(38,0)"))
    weighted = prefix_sums(weighted, "_all", ["_key", F.col("_source").asc_nulls_last()], ["_cap", "_weight"], scratch, "rates")
    words, total_weight = weighted.agg(F.coalesce(F.sum("_total"), F.lit(0)), F.coalesce(F.sum("_weight"), F.lit(0))).first()
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    free = (F.lit(words) - F.col("_cap_before")).cast("decimal(19,0)") * wide("_weight") < wide("_cap") * (F.lit(total_weight) - F.col("_weight_before")).cast("decimal(19,0)")
    first = weighted.where(free).agg(F.min_by(F.struct("_cap_before", "_weight_before"), F.struct("_key", F.col("_source").isNull(), "_source"))).first()[0]
    if first is None:  # all are at their most, as when there are no words
        target, budget = F.col("_cap").cast("double"), F.col("_cap")
    else:
        rest, share = words - first[0], total_weight - first[1]
        fair = (F.lit(rest).cast("decimal(19,0)") * wide("_weight")).cast("double") / F.lit(float(share))
        target = F.least(F.col("_cap").cast("double"), fair)
        budget = F.least(F.col("_cap"), F.floor(target + 0.5).cast("long"))
    return weighted.select("_source", "_total", target.alias("_target"), budget.alias("_budget"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, most: int = MOST, keep_key: bool = False) -> DataFrame:
    """(doc_id, source, size, source_size, target, epochs, cut, taken) for every row: `epochs` whole readings of it and one of its first `cut` words."""
    scratch = Scratch(docs.sparkSession, "mix")
    text = F.col(text_col).cast("string")
    narrow = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("_source"),
        F.coalesce(F.regexp_count(text, F.lit(_WORDS)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat_ws(":", F.col(id_col).cast("long").cast("string"), text).cast("binary")).alias("_key"),
    )
    narrow = scratch.save(narrow, "sizes")
    sizes = scratch.save(narrow.groupBy("_source").agg(F.sum("size").alias("_total")), "sources")
    targets = scratch.save(source_targets(sizes, weights, most, scratch), "targets")
    placed = prefix_sums(narrow, "_source", ["_key", "doc_id", "size"], ["size"], scratch, "ranged")
    both = placed.join(targets, placed["_source"].eqNullSafe(targets["_source"])).drop(targets["_source"])
    epochs = F.when(F.col("_total") > 0, F.expr("_budget div _total")).otherwise(0)
    both = both.withColumn("epochs", epochs).withColumn("cut", F.least(F.col("size"), F.greatest(F.lit(0), F.col("_budget") - F.col("epochs") * F.col("_total") - F.col("size_before"))))
    taken = (F.col("epochs") * F.col("size") + F.col("cut")).alias("taken")
    return both.select("doc_id", F.col("_source").alias("source"), "size", F.col("_total").alias("source_size"), F.col("_target").alias("target"), "epochs", "cut", taken, *["_key"] * keep_key)


def mixed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The mix itself: (doc_id, source, times, text), each text to be read `times` times; what a budget's cut leaves of a text is a row of its own.

    Equal rows come as one with their times added up, so no task holds their copies.
    """
    text, key = F.col(text_col).cast("string"), F.md5(F.concat_ws(":", F.col(id_col).cast("long").cast("string"), F.col(text_col).cast("string")).cast("binary"))
    taken = mix_sources(docs, id_col, text_col, source_col, weights, most, keep_key=True)
    whole = F.sum(F.col("epochs") + F.when((F.col("cut") == F.col("size")) & (F.col("size") > 0), 1).otherwise(0))
    taken = taken.groupBy("_key", "source").agg(F.first("doc_id").alias("doc_id"), whole.alias("_whole"), F.sum(F.when(F.col("cut") < F.col("size"), F.col("cut")).otherwise(0)).alias("_cut"))
    texts = docs.where(F.length(text) > 0).select(key.alias("_key"), F.col(source_col).cast("string").alias("_source"), text.alias("_text"))
    texts = texts.groupBy("_key", "_source").agg(F.first("_text").alias("_text"))
    both = taken.where("_whole + _cut > 0").join(texts, (taken["_key"] == texts["_key"]) & taken["source"].eqNullSafe(texts["_source"]))
    first = F.array_join(F.slice(F.regexp_extract_all("_text", F.lit(f"({_WORDS})"), 1), F.lit(1), F.col("_cut").cast("int")), " ")
    pieces = F.array(F.struct(F.col("_whole").alias("times"), F.col("_text").alias("text")), F.struct(F.when(F.col("_cut") > 0, 1).otherwise(0).cast("long").alias("times"), F.when(F.col("_cut") > 0, first).alias("text")))
    return both.select("doc_id", "source", F.inline(F.filter(pieces, lambda p: p["times"] > 0)))
