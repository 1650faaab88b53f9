"""Candidate generation: keys of twelve channels, frequency pruning, weighted scores, top-K with a name reserve.

An inverted index is an exploded table of (country, channel, key, entity); probing it is one equi-join. Inside, entities
go by numbers in the order of their ids, and keys by 64-bit hashes of country, channel and key. Keys are pruned by their
frequency among targets before the join, which bounds how many rows a probe can match; keys with very many probes are
split by a salt. The lists that a left entity fetches, bounded by its keys and the cutoffs, are summed and ranked in Arrow
groups of a few left entities without being unpacked into rows. Ids come back behind the ranking; where all pairs are
wanted, the lists hold the ids themselves.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlink.functions import text as T
from weftlink.sources.tables import Stage, parts_of, written


@dataclass(frozen=True)
class BlockingConfig:
    top_k: int = 25
    max_token_freq: int = 3000
    max_shingle_freq: int = 1500
    max_phonetic_freq: int = 400
    max_address_freq: int = 2000
    #: probes of one key that one task takes
    probes_per_task: int = 100_000
    channels: tuple[str, ...] = ("tok", "wp", "sn", "cmp", "sh", "ph", "cpd", "npc", "nat", "pcn", "at2", "pn")

    def __post_init__(self):
        if self.top_k < 6:
            raise ValueError("top_k must be 6 or more: six places are kept for the best names")


# Channel -> (is a name channel, weight before the frequency is taken into account)
CHANNELS = {"tok": (True, 3.5), "wp": (True, 5.0), "sn": (True, 5.5), "cmp": (True, 5.0), "sh": (True, 1.0), "ph": (True, 1.5), "cpd": (False, 6.0), "npc": (False, 4.5), "nat": (False, 4.0), "pcn": (False, 3.5), "at2": (False, 3.0), "pn": (False, 5.0)}
# left entities whose lists one Arrow group holds, those of one partition, and list entries that are summed at a time
BUCKET, PART, CACHED = 256, 5_000, 16_384
# numbers that monotonically_increasing_id leaves to one partition
PLACES = 1 << 33
NO_PHONETICS = tuple(c for c in CHANNELS if c not in ("ph", "pn"))


def prepare(df: DataFrame, phonetic: bool = False, transliteration=T.any_ascii) -> DataFrame:
    """Everything that is derived from one record, once for each record."""
    out = df.select(
        "entity_id",
        "country",
        T.normalize_text(F.col("business_name"), transliteration).alias("name"),
        T.normalize_text(F.col("business_address"), transliteration).alias("address"),
        T.address_numbers(F.col("business_address")).alias("numbers"),
        T.is_missing(F.col("business_address")).alias("is_empty"),
        T.compound_numbers(F.col("business_address")).alias("compounds"),
        *[c for c in ("uid",) if c in df.columns],
    )
    out = out.withColumns({"tokens": T.name_tokens(F.col("name")), "postal": T.postal_code(F.col("address")), "addr_tokens": T.address_tokens(F.col("address"))})
    return out.withColumn("phonetic", T.phonetic_keys(F.col("tokens")) if phonetic else F.array().cast("array<string>"))


def _once(c: Column, f) -> Column:
    """f(c), with c computed once: what a lambda spells out is computed anew for each element."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def _pairs(items: Column, fmt) -> Column:
    """fmt(x, y) for every x before y."""
    return _once(items, lambda all: F.flatten(F.transform(all, lambda x, i: F.transform(F.slice(all, i + 2, F.size(all)), lambda y: fmt(x, y)))))


def channel_keys(channel: str) -> Column:
    """The keys of one channel for a prepared record."""
    none, tokens, numbers = F.array().cast("array<string>"), F.col("tokens"), F.col("numbers")
    joined = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    if channel == "tok":
        return tokens
    if channel == "wp":
        return F.when(F.size(tokens).between(2, 4), _pairs(F.sort_array(F.array_distinct(tokens)), lambda x, y: joined("wp:", x, "_", y))).otherwise(none)
    if channel == "sn":
        return F.when(F.size(tokens) >= 2, F.array(joined("sn:", F.array_join(F.sort_array(tokens), " ")))).otherwise(none)
    if channel == "cmp":
        fused = T.compressed(F.col("name"))
        return F.when(F.length(fused) >= 4, F.array(joined("cmp:", fused))).otherwise(none)
    if channel == "sh":
        return F.array_union(T.prefix_shingles(tokens), T.compressed_shingles(F.col("name")))
    if channel == "ph":
        return F.col("phonetic")
    if channel == "cpd":
        return F.transform(F.slice("compounds", 1, 2), lambda c: joined("cpd:", c))
    if channel == "npc":
        return F.when(F.col("postal").isNotNull(), F.transform(numbers, lambda n: joined("npc:", n, "_", F.col("postal")))).otherwise(none)
    if channel == "nat":
        first = F.slice("addr_tokens", 1, 4)
        return F.flatten(F.transform(numbers, lambda n: F.transform(first, lambda t: joined("nat:", n, "_", t))))
    if channel == "pcn":
        return F.when(F.col("postal").isNotNull() & (F.size(tokens) > 0), F.array(joined("pcn:", F.col("postal"), "_", F.substring(F.get(tokens, F.lit(0)), 1, 3)))).otherwise(none)
    if channel == "at2":
        return _pairs(F.slice("addr_tokens", 1, 3), lambda x, y: joined("at2:", F.least(x, y), "_", F.greatest(x, y)))
    if channel == "pn":
        first = F.slice("phonetic", 1, 2)
        return F.flatten(F.transform(F.slice(numbers, 1, 2), lambda n: F.transform(first, lambda p: joined("pn:", p, "_", n))))
    raise ValueError(f"no channel {channel!r}")


def keys(records: DataFrame, channels, distinct_addresses: bool) -> DataFrame:
    """(country, entity_id, channel, key); a record's name keys are distinct, its address keys only on the index side."""
    parts = []
    for c in channels:
        found = channel_keys(c)
        if CHANNELS[c][0] or distinct_addresses:
            found = F.array_distinct(found)
        name = F.lit(c).alias("channel")
        parts.append(F.transform(found, lambda k: F.struct(name, k.alias("key"))))  # noqa: B023  called at once
    return records.where("country is not null").select("country", "entity_id", F.explode(F.concat(*parts)).alias("x")).select("country", "entity_id", "x.channel", "x.key")


def cutoff(config: BlockingConfig) -> Column:
    most = {"sh": config.max_shingle_freq, "ph": config.max_phonetic_freq} | {c: config.max_token_freq for c in ("tok", "wp", "sn", "cmp")}
    out = F.lit(config.max_address_freq)
    for c, n in most.items():
        out = F.when(F.col("channel") == c, F.lit(n)).otherwise(out)
    return out


def key_frequencies(index: DataFrame) -> DataFrame:
    return index.groupBy("country", "channel", "key").agg(F.count("*").alias("n"))


def weight() -> Column:
    """Name channels weigh less the commoner the key; address channels are flat."""
    out = F.lit(0.0)
    for c, (is_name, w) in CHANNELS.items():
        out = F.when(F.col("channel") == c, F.lit(w) / F.log2(F.lit(2.0) + F.col("n")) if is_name else F.lit(w)).otherwise(out)
    return out


def numbered(df: DataFrame) -> DataFrame:
    """df with `uid`: numbers that rise with entity_id; records of one id share one. They are fixed once the result is written."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # stated, as what follows costs more than its bytes tell
    ranged = df.repartitionByRange(parts, "entity_id").sortWithinPartitions("entity_id").withColumn("_at", F.monotonically_increasing_id())
    # ranges hold whole ids, so this needs no exchange
    return ranged.withColumn("uid", F.min("_at").over(Window.partitionBy("entity_id"))).drop("_at")


def records(df: DataFrame, phonetic: bool = False, transliteration=T.any_ascii, stages: list[Stage] | None = None) -> DataFrame:
    """Prepared records with `uid`, written once."""
    return written(prepare(numbered(df), phonetic, transliteration), "records", stages)


def _known(prepared: DataFrame) -> DataFrame:
    return prepared if "uid" in prepared.columns else written(numbered(prepared), "records")


def _hashed_keys(records: DataFrame, channels, index: bool, by: str = "uid") -> DataFrame:
    """(uid, k, channel) of every key of a record; a query's address keys come as often as they count. by: what stands for the record as uid."""
    found = {c: F.array_distinct(channel_keys(c)) if index or CHANNELS[c][0] else channel_keys(c) for c in channels}
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("channel"), x.alias("keys")) for c, x in found.items()))).alias("x")
    # hashed behind the arrays: what runs inside a lambda is interpreted
    keys = records.where("country is not null").select(F.col(by).alias("uid"), "country", each).select("uid", "country", "x.channel", F.explode("x.keys").alias("key"))
    return keys.select("uid", F.xxhash64("country", "channel", "key").alias("k"), "channel")


def _packed(ids: Column) -> Column:
    """Ids as sorted lines of one text, which takes fewer bytes than an array; a backslash, a line's end and null are escaped before."""
    return F.array_join(F.sort_array(ids), "\n").alias("found")


def _step(targets: DataFrame) -> tuple[int, int]:
    """(records of the largest partition of `numbered`, bytes that hold partition * that + place)."""
    place, part = targets.agg(F.max(F.col("uid").bitwiseAND(PLACES - 1)), F.max(F.shiftright("uid", 33))).first()
    step = (place or 0) + 1
    return step, 4 if ((part or 0) + 1) * step <= 1 << 32 else 8


def _packed_numbers(numbers: Column, step: int, width: int) -> Column:
    """Sorted numbers, their gaps between partitions closed, as `width` bytes each, most significant first: a list goes to Python as one value."""
    close = lambda x: F.shiftright(x, 33) * step + x.bitwiseAND(PLACES - 1)
    return F.unhex(F.array_join(F.transform(F.sort_array(numbers), lambda x: F.lpad(F.hex(close(x)), 2 * width, "0")), "")).alias("found")


def _numbers(found: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(found), f">u{width}").astype(np.int64)


def _plain(line: str) -> str | None:
    return None if line == "\\0" else re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], line)


def _postings(targets: DataFrame, config: BlockingConfig, by: str, numbering: tuple[int, int]) -> DataFrame:
    """(k, is_name, w, found): the targets of every key that is not too common, so lists are no longer than the cutoff."""
    index = written(_hashed_keys(targets, config.channels, True, by), "keys")
    common = index.groupBy("k", "channel").agg(F.count("*").alias("n")).where(F.col("n") > cutoff(config)).select("k")
    lists = index.join(common, "k", "left_anti").groupBy("k").agg(F.first("channel").alias("channel"), F.collect_list("uid" if by == "uid" else F.coalesce(F.replace(F.replace("uid", F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\\0"))).alias("found"))
    is_name = F.col("channel").isin([c for c, (name, _) in CHANNELS.items() if name])
    return lists.withColumn("n", F.size("found")).select("k", is_name.alias("is_name"), weight().alias("w"), _packed_numbers(F.col("found"), *numbering) if by == "uid" else _packed(F.col("found")))


def salted_probes(probes: DataFrame, config: BlockingConfig) -> tuple[DataFrame, DataFrame]:
    """(probes with `salt`, keys with the number of parts): a key with many probes is split into parts, each about as large as one task takes."""
    busy = probes.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > config.probes_per_task)
    busy = busy.select("k", F.ceil(F.col("n") / config.probes_per_task).cast("int").alias("parts"))
    salt = F.coalesce(F.pmod(F.xxhash64("uid"), F.col("parts")), F.lit(0)).cast("int")
    return probes.join(busy, "k", "left").withColumn("salt", salt).drop("parts"), busy


def _fetched(queries: DataFrame, targets: DataFrame, config: BlockingConfig, by: str = "uid", numbering: tuple[int, int] = (PLACES, 8)) -> DataFrame:
    """(s1, is_name, w, found, bucket): the lists of targets that a left entity's keys lead to, and what each counts, dealt out by buckets of left entities."""
    n = queries.count()
    # keys are counted and joined: written once
    probes, postings = written(_hashed_keys(queries, config.channels, False, by).drop("channel"), "keys"), _postings(targets, config, by, numbering)
    salted, busy = salted_probes(probes, config)
    # the list of a split key goes to each part
    spread = postings.join(busy, "k", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    lists = salted.join(spread, ["k", "salt"]).select(F.col("uid").alias("s1"), "is_name", "w", "found")
    bucket = F.pmod(F.xxhash64("s1"), F.lit(parts_of(n, BUCKET)))
    return lists.withColumn("bucket", bucket).repartition(parts_of(n, PART), "bucket")


def _sums(lists: pa.Table) -> pa.Table:
    """(s1_id, tgt_id, name_score, addr_score) of all pairs of a bucket."""
    found = pc.split_pattern(lists.column("found").combine_chunks(), "\n")
    size, w, is_name = np.asarray(found.value_lengths()), lists.column("w").to_numpy(), lists.column("is_name").to_numpy()
    left, right = (x.dictionary_encode(null_encoding="encode") for x in (lists.column("s1").combine_chunks(), found.flatten()))
    width = len(right.dictionary)
    pair = np.repeat(left.indices.to_numpy().astype(np.int64), size) * width + right.indices.to_numpy()
    order = np.argsort(pair)
    pair, w, is_name = pair[order], np.repeat(w, size)[order], np.repeat(is_name, size)[order]
    first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
    scores = [_nine_digits(np.add.reduceat(np.where(of, w, 0.0), first)) for of in (is_name, ~is_name)]
    names = right.dictionary
    if pc.any(pc.match_substring(names, "\\")).as_py():
        names = pa.array([_plain(x) for x in names.to_pylist()], pa.string())
    s1, tgt = left.dictionary.take(pa.array(pair[first] // width)), names.take(pa.array(pair[first] % width))
    return pa.table({"s1_id": s1, "tgt_id": tgt, "name_score": scores[0], "addr_score": scores[1]})


def _with_ids(scored: DataFrame, queries: DataFrame, targets: DataFrame) -> DataFrame:
    """s1_id and tgt_id instead of the numbers."""
    names = lambda records, number, name: records.groupBy(F.col("uid").alias(number)).agg(F.first("entity_id").alias(name))
    both = scored.join(names(queries, "s1", "s1_id"), "s1").join(names(targets, "tgt", "tgt_id"), "tgt")
    return both.select("s1_id", "tgt_id", *[c for c in scored.columns if c not in ("s1", "tgt")])


def score_pairs(queries: DataFrame, targets: DataFrame, config: BlockingConfig) -> DataFrame:
    """(s1_id, tgt_id, name_score, addr_score) of prepared records that share a key which is not too common.

    Lists hold ids instead of numbers, as there are far more pairs than list entries to look up afterwards: a pair is never shuffled.
    """
    queries, targets = _known(queries), _known(targets)
    return _fetched(queries, targets, config, "entity_id").groupBy("bucket").applyInArrow(_sums, "s1_id string, tgt_id string, name_score double, addr_score double")


def dual_evidence(scored: DataFrame) -> DataFrame:
    n, a = F.col("name_score"), F.col("addr_score")
    final = F.when((n > 0) & (a > 0), (n + a) * 3 + n * a).when(n > 0, n * 1.5).otherwise(a)
    return scored.withColumn("score", F.round(final, 9))


def top_candidates(scored: DataFrame, top_k: int) -> DataFrame:
    """(s1_id, tgt_id, rank, score): the best top_k - 6 by score, six places for the best names, then by score again."""
    by_score = Window.partitionBy("s1_id").orderBy(F.desc("score"), F.asc("tgt_id"))
    by_name = Window.partitionBy("s1_id").orderBy(F.desc(F.col("name_score") > 0), F.desc("name_score"), F.asc("tgt_id"))
    # one exchange on s1_id serves all three windows; a row beyond top_k by score and beyond six by name can't be chosen
    ranked = scored.withColumns({"rf": F.row_number().over(by_score), "rn": F.row_number().over(by_name)}).where((F.col("rf") <= top_k) | (F.col("rn") <= 6))
    bucket = F.when(F.col("rf") <= top_k - 6, 0).when((F.col("name_score") > 0) & (F.col("rn") <= 6), 1).otherwise(2)
    order = Window.partitionBy("s1_id").orderBy("bucket", F.when(F.col("bucket") == 1, F.col("rn")).otherwise(F.col("rf")))
    return ranked.withColumn("bucket", bucket).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).select("s1_id", "tgt_id", "rank", "score")


def _nine_digits(x: np.ndarray) -> np.ndarray:
    """round(x, 9) of numbers that are not negative; of those a rounding error from a half, the last digit may differ from Spark's."""
    out = x * 1e9
    out += 0.5
    np.floor(out, out=out)
    out /= 1e9
    return out


def _largest(x: np.ndarray, begin: np.ndarray, k: int, block: int = 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, run, rank from 0) of the k largest of each run of x, in their order; ties by place. Runs start at `begin`, none is empty."""
    size = np.diff(np.append(begin, len(x)))
    runs, blocks = np.arange(len(begin)), -(-size // block)
    ahead = np.cumsum(blocks) - blocks
    # the k-th of the largest of each block is no more than the k-th of all, so few are left to sort
    tops = np.maximum.reduceat(x, np.repeat(begin - block * ahead, blocks) + block * np.arange(blocks.sum()))
    tops = tops[np.lexsort((-tops, np.repeat(runs, blocks)))]
    least, many = np.full(len(runs), -np.inf), blocks >= k
    least[many] = tops[ahead[many] + k - 1]
    run = np.repeat(runs, size)
    at = np.flatnonzero(x >= least[run])
    at = at[np.lexsort((-x[at], run[at]))]
    run = run[at]
    rank = np.arange(len(at)) - np.searchsorted(run, run)
    kept = rank < k
    return at[kept], run[kept], rank[kept]


def _chosen(name: np.ndarray, score: np.ndarray, begin: np.ndarray, top_k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """top_candidates of left entities, whose targets are runs in the order of their ids: (place, run, rank from 1)."""
    at, run, rank = _largest(score, begin, top_k)
    named, own, nth = _largest(name, begin, 6)
    good = name[named] > 0
    # main places, then names, then the rest: a place that comes twice keeps the first
    order = np.concatenate([np.where(rank < top_k - 6, rank, top_k + rank), top_k - 6 + nth[good]])
    at, run = np.concatenate([at, named[good]]), np.concatenate([run, own[good]])
    in_order = np.lexsort((order, at))
    once = in_order[np.concatenate([[True], at[in_order][1:] != at[in_order][:-1]])]
    once = once[np.lexsort((order[once], run[once]))]
    at, run = at[once], run[once]
    rank = np.arange(1, len(at) + 1) - np.searchsorted(run, run)
    kept = rank <= top_k
    return at[kept], run[kept], rank[kept]


def _best(found: list[bytes], w: np.ndarray, is_name: np.ndarray, begin: np.ndarray, top_k: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(left entity, target, rank, score) of the best targets of a few left entities, the first of whose lists stand at `begin`."""
    size = np.fromiter(map(len, found), np.int64, len(found)) // width
    cut = np.concatenate([[0], np.cumsum(size)])[np.append(begin, len(size))]
    tgt = _numbers(found, width)
    # a list is sorted, so a stable sort has only to merge them
    order = np.concatenate([a + np.argsort(tgt[a:b], kind="stable") for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)])
    tgt = tgt[order]
    new = np.concatenate([[True], tgt[1:] != tgt[:-1]])
    new[cut[:-1]] = True
    first = np.flatnonzero(new)
    which = np.repeat(np.arange(len(size)), size)[order]
    name, addr = (_nine_digits(np.add.reduceat(np.where(of, w, 0.0)[which], first)) for of in (is_name, ~is_name))
    score = _nine_digits(np.where((name > 0) & (addr > 0), (name + addr) * 3 + name * addr, np.where(name > 0, name * 1.5, addr)))
    at, run, rank = _chosen(name, score, np.searchsorted(first, cut[:-1]), top_k)
    return run, tgt[first[at]], rank, score[at]


def _best_of_lists(top_k: int, step: int, width: int):
    """score_pairs, dual_evidence and top_candidates of the left entities of a bucket; an entity's lists are at most as many as its keys, each no longer than a cutoff."""

    def run(lists: pa.Table) -> pa.Table:
        lists = lists.take(pa.array(np.argsort(lists.column("s1").to_numpy(), kind="stable")))
        s1, w, is_name = (lists.column(c).to_numpy() for c in ("s1", "w", "is_name"))
        found = lists.column("found").to_pylist()
        begin = np.flatnonzero(np.concatenate([[True], s1[1:] != s1[:-1]]))
        # a few left entities at a time, as their arrays then stay in the processor's cache
        ahead = np.cumsum([0, *map(len, found)])[begin] // (width * CACHED)
        parts = np.append(np.flatnonzero(np.concatenate([[True], ahead[1:] != ahead[:-1]])), len(begin))
        out = []
        for i, j in zip(parts[:-1].tolist(), parts[1:].tolist(), strict=True):
            a, b = begin[i], begin[j] if j < len(begin) else len(s1)
            left, tgt, rank, score = _best(found[a:b], w[a:b], is_name[a:b], begin[i:j] - a, top_k, width)
            out.append((s1[begin[i:j]][left], tgt // step * PLACES + tgt % step, rank.astype(np.int32), score))
        return pa.table(dict(zip(("s1", "tgt", "rank", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    return run


def ranked_candidates(queries: DataFrame, targets: DataFrame, config: BlockingConfig = BlockingConfig(), stages: list[Stage] | None = None) -> DataFrame:
    """(s1_id, tgt_id, rank, score) of prepared records, best of `records`; written once, for every later step to read."""
    queries, targets = _known(queries), _known(targets)
    n = queries.count()
    numbering = _step(targets)
    ranked = _fetched(queries, targets, config, numbering=numbering).groupBy("bucket").applyInArrow(_best_of_lists(config.top_k, *numbering), "s1 long, tgt long, rank int, score double")
    return written(_with_ids(ranked, queries, targets).repartition(parts_of(n, PART), "s1_id"), "candidates", stages)  # stated, as features cost more than their pairs' bytes tell


def candidates(source1: DataFrame, targets: DataFrame, config: BlockingConfig = BlockingConfig()) -> DataFrame:
    phonetic = bool({"ph", "pn"} & set(config.channels))
    return ranked_candidates(records(source1, phonetic), records(targets, phonetic), config)


def with_empty(source1: DataFrame, ranked: DataFrame, name: str = "candidate_entity_ids", id_col: str = "tgt_id") -> DataFrame:
    """One row for each left entity: its ids in rank order, joined by commas; none is an empty string."""
    lists = ranked.groupBy("s1_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col(id_col).alias("id")))).alias("x"))  # at most top_k each
    joined = F.coalesce(F.array_join(F.transform("x", lambda x: x["id"]), ","), F.lit(""))
    return source1.select(F.col("entity_id").alias("source1_entity_id")).join(lists, F.col("source1_entity_id") == F.col("s1_id"), "left").select("source1_entity_id", joined.alias(name))
