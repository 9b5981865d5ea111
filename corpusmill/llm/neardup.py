"""Near-duplicate records by the Jaccard similarity of their word sets: a grouped prefix join.

1. Every record becomes its set of distinct words, as 64-bit hashes, rarest first. The order is global:
   by the count of the word over all records, for the ORDERED_WORDS commonest words (a fixed number, so
   what is broadcast is bounded), before them all rarer ones by hash. Any global order gives the exact
   result; a better one only leaves fewer candidates.
2. Records with the same set are one item; exact copies never meet each other in a join.
3. Items with the same prefix and size are one group. Two sets can be similar enough only if their
   prefixes share a word: groups are posted under the words of their prefixes (the smaller one's shorter
   index prefix meets the larger one's probing prefix). A word that more than LIGHT groups post is
   refined: sets whose first common word it is must share a second one, which stands in the prefix
   longer by a word, so such groups are posted under the pairs of that word and a later one; pairs
   posted too often are refined to triples. So lists stay short while a collection grows. Sets so small
   that the words of a list are all they need have in common stay in it as well.
4. The groups of a list meet in order of size, whole batches of lists at once in numpy, and are filtered
   by size, by the position of the word, and, for groups of one item, by a bitmap of the set: the bits in
   which two bitmaps differ are a lower bound of the words in which the sets do.
5. Pairs of groups are expanded to pairs of items, filtered by their bitmaps, and verified on the sets.

A list that is still long, of which the last refinement has any, is split into blocks that meet block by
block, so no task holds all of it. Hash collisions of two words of one pair are the only deviation from
exact results (about 1e-15 for each such pair of words).

Records without a word have no similarity to any other. Nulls count as empty. Repeated rows are
records of their own. Texts are treated whole, whatever their length. Extra columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpusmill.functions import vec
from corpusmill.operators.lookup import join_split
from corpusmill.session import checkpointed

#: Commonest words whose counts are sent to the executors (8 + 8 bytes each).
ORDERED_WORDS = 1_000_000
#: 64-bit words of an item's bitmap, and of them those that groups are compared by.
BITMAP, GROUP_BITMAP = 4, 2
#: Groups under a word, or words, above which they are refined by a further one (a refined posting takes some 30 microseconds,
#: a comparison 0.01); words in a refined posting at most.
LIGHT, LEVELS = 4096, 3
#: Refined words, or sets of words, of a level that are sent to the executors (8 bytes each); further ones are split into blocks.
REFINED = 1_000_000
#: Groups of one list that meet in one task at most, from each of two blocks.
BLOCK = 4096
#: Postings that are compared at once, about.
POSTINGS_AT_ONCE = 1 << 16


def _hash_sets(texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(text number, word hash): distinct words of each text, sorted by both."""
    codes, offsets = vec.pack([t.lower() if t is not None else "" for t in texts])
    starts, ends = vec.runs(vec.word_table()[codes] if len(codes) else np.empty(0, bool), offsets)
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    own = vec.owner(offsets)[starts]
    h = vec.span_hashes(codes, starts, ends).view(np.int64)
    order = np.lexsort((h, own))
    own, h = own[order], h[order]
    new = np.concatenate([[True], (own[1:] != own[:-1]) | (h[1:] != h[:-1])])
    return own[new], h[new]


def _split(values: np.ndarray, own: np.ndarray, n: int) -> list[np.ndarray]:
    return np.split(values, np.cumsum(np.bincount(own, minlength=n))[:-1]) if n else []


def word_sets(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, words (array of distinct word hashes, sorted)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a, b in vec.slices(vec.lengths(pdf["text"])):
                own, h = _hash_sets(pdf["text"].iloc[a:b])
                yield pd.DataFrame({"key": pdf["key"].iloc[a:b], "words": _split(h, own, b - a)})

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, "key long, words array<long>")


def _commonest(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """(keys, counts) of the commonest of counts(key, count), at most `most`, sorted by key, and the rest.

    A histogram of counts tells from which count there are few enough, so no task and no collected result holds more."""
    step = F.floor(F.log2("count") * 16)
    bins = sorted(counts.groupBy(step.alias("bin")).agg(F.count("*").alias("n")).collect(), reverse=True)
    total, least = 0, None
    for bin_, n in bins:
        total += n
        if total > most:
            break
        least = bin_
    if least is None:
        return np.empty(0, np.int64), np.empty(0, np.int64), counts
    rows = counts.where(step >= least).toPandas().sort_values("key")
    return rows["key"].to_numpy(np.int64), rows["count"].to_numpy(np.int64), counts.where(step < least)


def word_counts(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of the commonest words, at most ORDERED_WORDS, sorted by hash; counted over all records."""
    counts = sets.select(F.explode("words").alias("key")).groupBy("key").count().where("count > 1")
    return _commonest(checkpointed(counts), ORDERED_WORDS)[:2]


def _ordered(sets: DataFrame, counted: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """item, size, words in the global order, rarest first, and the bitmap m0, m1 ..."""
    words, counts = counted

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lengths = pdf["words"].map(len).to_numpy()
            flat = np.concatenate(list(pdf["words"])) if len(pdf) and lengths.sum() else np.empty(0, np.int64)
            own = np.repeat(np.arange(len(pdf)), lengths)
            rank = np.zeros(len(flat), np.int64)
            if len(words) and len(flat):
                at = np.minimum(np.searchsorted(words, flat), len(words) - 1)
                rank = np.where(words[at] == flat, counts[at], 0)
            order = np.lexsort((flat, rank, own))
            bits = flat.view(np.uint64) % np.uint64(64 * BITMAP)
            bitmap = np.zeros((len(pdf), BITMAP), np.uint64)
            np.bitwise_or.at(bitmap, (own, (bits >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bits & np.uint64(63)))
            out = pd.DataFrame({"item": pdf["item"], "size": lengths.astype(np.int32), "words": _split(flat[order], own, len(pdf))})
            for k in range(BITMAP):
                out[f"m{k}"] = bitmap[:, k].view(np.int64)
            yield out

    return sets.select("item", "words").mapInPandas(run, "item long, size int, words array<long>, " + ", ".join(f"m{k} long" for k in range(BITMAP)))


def _up(c: Column) -> Column:
    """Ceiling, against 0.75 * 4 = 3.0000000000000004."""
    return F.ceil(F.round(c, 9)).cast("int")


def _ceil(x: np.ndarray) -> np.ndarray:
    return np.ceil(np.round(x, 9)).astype(np.int64)


def _differing(a: str, b: str) -> Column:
    """Bits in which two bitmaps differ."""
    return sum((F.bit_count(F.col(f"{a}{k}").bitwiseXOR(F.col(f"{b}{k}"))) for k in range(1, BITMAP)), F.bit_count(F.col(f"{a}0").bitwiseXOR(F.col(f"{b}0"))))


def _keys(words: np.ndarray, start: np.ndarray, size: np.ndarray, prefix: np.ndarray, refined: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By level: (row, position of the last word, key, whether it is refined at the next level) of all postings.

    words: of all rows one behind the other, from `start`; prefix: length of each row's prefix proper."""
    row = np.repeat(np.arange(len(size)), prefix)
    place = np.arange(len(row)) - np.repeat(np.cumsum(prefix) - prefix, prefix)
    key = words[start[row] + place].view(np.uint64)
    for level in range(1, LEVELS + 1):
        more = refined[level - 1] if level <= len(refined) else np.empty(0, np.int64)
        heavy = np.zeros(len(key), bool)
        if len(more):
            heavy = more[np.minimum(np.searchsorted(more, key.view(np.int64)), len(more) - 1)] == key.view(np.int64)
        yield row, place, key.view(np.int64), heavy
        if not heavy.any():
            return
        row, place, key = row[heavy], place[heavy], key[heavy]
        n = np.minimum(prefix[row] + level, size[row]) - place - 1
        at = np.repeat(np.arange(len(row)), n)
        after = place[at] + 1 + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        key = vec.mix(key[at] * np.uint64(31) + words[start[row[at]] + after].view(np.uint64))
        row, place = row[at], after


def _posted(groups: DataFrame, t: float, refined: list[np.ndarray], count: int | None) -> DataFrame:
    """The postings of the groups: key, info, group, bitmap; or, to be counted, only the keys of level `count`.

    info holds the size (from bit 32), the position of the word (from bit 4), whether the group has several items (bit 1)
    and whether the word is in the index prefix (bit 0)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lengths, size = pdf["prefix"].map(len).to_numpy(), pdf["size"].to_numpy(np.int64)
            words = np.concatenate(list(pdf["prefix"])) if lengths.sum() else np.empty(0, np.int64)
            whole = size - _ceil(t * size) + 1
            index = size - _ceil(2 * t / (1 + t) * size) + 1
            least = _ceil(t * size)
            for level, (row, place, key, heavy) in enumerate(_keys(words, np.cumsum(lengths) - lengths, size, whole, refined), 1):
                # sets so small that the words of the key are enough may have no further word in common: they stay here, in a list of their own
                small = heavy & (least[row] <= level)
                key = np.where(small, vec.mix(key.view(np.uint64) ^ np.uint64(0x5BD1E995)).view(np.int64), key)
                if count is not None:
                    if level == count:
                        yield pd.DataFrame({"key": key, "small": False})
                    elif level == count - 1:
                        yield pd.DataFrame({"key": key[small], "small": True})
                    continue
                stay = ~heavy | small
                row, place, key = row[stay], place[stay], key[stay]
                info = (size[row] << 32) | (place << 4) | ((pdf["n_items"].to_numpy()[row] > 1).astype(np.int64) << 1) | (place < index[row] + level - 1)
                out = {"key": key, "info": info, "group": pdf["group"].to_numpy()[row]}
                yield pd.DataFrame(out | {f"m{k}": pdf[f"m{k}"].to_numpy()[row] for k in range(GROUP_BITMAP)})

    schema = "key long, small boolean" if count is not None else "key long, info long, group long, " + ", ".join(f"m{k} long" for k in range(GROUP_BITMAP))
    return groups.mapInPandas(run, schema)


def _lists(groups: DataFrame, t: float) -> DataFrame:
    """Postings (list, info, group, bitmap), none of whose lists has more than two blocks; bits 2 and 3 of info: 1 or 2 if only groups of the other block are met."""
    refined: list[np.ndarray] = []
    long: list[DataFrame] = []
    for level in range(1, LEVELS + 1):
        counts = checkpointed(_posted(groups, t, refined, level).groupBy("key", "small").count().where(F.col("count") > F.when(~F.col("small") & F.lit(level < LEVELS), LIGHT).otherwise(BLOCK)))
        keys, _, rest = _commonest(counts.where("not small"), REFINED) if level < LEVELS else (np.empty(0, np.int64), None, counts.where("not small"))
        long.append(rest.unionByName(counts.where("small")).where(F.col("count") > BLOCK).select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")))
        if not len(keys):
            break
        refined.append(keys)
    posted = _posted(groups, t, refined, None)
    over = checkpointed(functools.reduce(DataFrame.unionByName, long))
    n = over.count()
    if not n:
        return posted.withColumnRenamed("key", "list")
    posted = posted.join(F.broadcast(over) if n <= REFINED else over, "key", "left")
    own = F.pmod(F.col("group"), F.col("blocks")).cast("int")
    posted = posted.withColumn("own", own).withColumn("other", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(None).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
    cell = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    side = F.when(F.col("own") < F.col("other"), F.lit(4)).when(F.col("own") > F.col("other"), F.lit(8)).otherwise(0)
    return posted.select(F.when(F.col("blocks").isNull(), F.col("key")).otherwise(cell).alias("list"), F.col("info").bitwiseOR(side.cast("long")).alias("info"), "group", *[f"m{k}" for k in range(GROUP_BITMAP)])


def _meet(of: np.ndarray, info: np.ndarray, group: np.ndarray, maps: list[np.ndarray], t: float) -> np.ndarray:
    """Pairs of groups [2, n] that may be similar, of postings sorted by list and info."""
    size = info >> 32
    number = np.cumsum(np.concatenate([[0], of[1:] != of[:-1]]))
    spread = int(size.max()) + 1
    # in order of size, the partners of a posting are those behind it up to the largest size that is similar enough
    last = np.searchsorted(number * spread + size, number * spread + np.minimum((size / t + 1e-9).astype(np.int64), spread - 1), "right")
    n = np.where(info & 1 == 1, last - np.arange(len(of)) - 1, 0)
    total = np.arange(2 * spread)
    slack = total - 2 * _ceil(t / (1 + t) * total)
    several = info & 2 == 2
    maps = [m.view(np.uint64) for m in maps]
    found = []
    for a, b in vec.slices(n, 1 << 20):
        i = np.repeat(np.arange(a, b), n[a:b])
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n[a:b]) - n[a:b], n[a:b])
        differ = sum(np.bitwise_count(m[i] ^ m[j]).astype(np.int16) for m in maps)
        both = size[i] + size[j]
        keep = (differ <= slack[both]) | several[i] | several[j]
        i, j, both = i[keep], j[keep], both[keep]
        at_i, at_j, side = (info[i] >> 4) & 0xFFFFFFF, (info[j] >> 4) & 0xFFFFFFF, (info[i] | info[j]) & 12
        possible = np.minimum(at_i, at_j) + 1 + np.minimum(size[i] - at_i - 1, size[j] - at_j - 1)
        keep = (2 * possible >= both - slack[both]) & ((side == 0) | (side == 12)) & (group[i] != group[j])
        found.append(np.stack([np.minimum(group[i[keep]], group[j[keep]]), np.maximum(group[i[keep]], group[j[keep]])]))
    return np.unique(np.concatenate(found, axis=1), axis=1) if found else np.empty((2, 0), np.int64)


def _met(lists: DataFrame, t: float) -> DataFrame:
    """(group_a, group_b) of groups that meet in a list and pass its filters, possibly several times.

    One shuffle of the postings by list; a task holds a few batches of them at a time, and of a list at most two blocks."""
    columns = ["list", "info", "group", *[f"m{k}" for k in range(GROUP_BITMAP)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def out(parts: list[np.ndarray]) -> pa.RecordBatch:
            got = _meet(parts[0], parts[1], parts[2], parts[3:], t)
            return pa.RecordBatch.from_arrays([pa.array(got[0]), pa.array(got[1])], names=["group_a", "group_b"])

        for batch in batches:
            held.append([c.to_numpy() for c in batch.columns])
            if sum(len(h[0]) for h in held) >= POSTINGS_AT_ONCE:
                parts = [np.concatenate(c) for c in zip(*held)]
                edge = int(np.searchsorted(parts[0], parts[0][-1], "left"))
                held = [[p[edge:] for p in parts]]
                if edge:
                    yield out([p[:edge] for p in parts])
        if held and len(held[0][0]):
            yield out([np.concatenate(c) for c in zip(*held)])

    return lists.select(*columns).repartition("list").sortWithinPartitions("list", "info").mapInArrow(run, "group_a long, group_b long")


def _renamed(df: DataFrame, side: str, columns: list[str]) -> DataFrame:
    bitmap = [F.col(f"m{k}").alias(f"m{side}{k}") for k in range(BITMAP)]
    return df.select(*[c for c in df.columns if c not in columns and not c.startswith("m")], *[F.col(c).alias(f"{c}_{side}") for c in columns], *bitmap)


def similar_items(sets: DataFrame, threshold: float, counted: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """sets(item, words), distinct sets -> (a, b, similarity) with a < b and similarity >= threshold."""
    t = float(threshold)
    maps = [f"m{k}" for k in range(BITMAP)]
    ordered = checkpointed(_ordered(sets.where(F.size("words") > 0), counted))
    size = F.col("size")
    need = _up((t / (1 + t)) * (F.col("size_a") + F.col("size_b")))
    alike = 2 * need + _differing("ma", "mb") <= F.col("size_a") + F.col("size_b")

    # the prefix, and the words behind it by which long lists are refined
    prefix = F.slice("words", F.lit(1), F.least(size, size - _up(t * size) + LEVELS))
    members = ordered.select("item", "size", prefix.alias("prefix"), *maps).withColumn("group", F.xxhash64("size", "prefix"))
    firsts = [F.first(m).alias(m) for m in maps[:GROUP_BITMAP]]
    groups = checkpointed(members.groupBy("group").agg(F.first("size").alias("size"), F.first("prefix").alias("prefix"), F.count("*").alias("n_items"), *firsts))
    group_pairs = checkpointed(_met(_lists(groups, t), t).distinct())
    # groups of several items also hold pairs among themselves
    within = groups.where("n_items > 1").select(F.col("group").alias("group_a"), F.col("group").alias("group_b"))
    of = members.select("group", "item", "size", *maps)
    pairs = (
        group_pairs.unionByName(within)
        .join(_renamed(of, "a", ["group", "item", "size"]), "group_a")
        .join(_renamed(of, "b", ["group", "item", "size"]), "group_b")
        .where(((F.col("group_a") != F.col("group_b")) | (F.col("item_a") < F.col("item_b"))) & alike)
        .select(F.least("item_a", "item_b").alias("a"), F.greatest("item_a", "item_b").alias("b"))
    )
    left = ordered.select(F.col("item").alias("a"), F.col("words").alias("wa"), F.col("size").alias("na"))
    right = ordered.select(F.col("item").alias("b"), F.col("words").alias("wb"), F.col("size").alias("nb"))
    both = F.size(F.array_intersect("wa", "wb"))
    verified = pairs.join(left, "a").join(right, "b").select("a", "b", (both / (F.col("na") + F.col("nb") - both)).alias("similarity"))
    return verified.where(F.col("similarity") >= t - 1e-9)


def _items(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame, tuple[np.ndarray, np.ndarray]]:
    """(sets by item, members by key, word counts); an item is a distinct set, named by the least key that has it."""
    rows = checkpointed(word_sets(df, key, text))
    counted = word_counts(rows)
    full = rows.where(F.size("words") > 0).select("key", "words", F.struct(F.xxhash64("words").alias("h1"), F.hash("words").alias("h2")).alias("set"))
    # a set held by a third of all rows is aggregated map-side: min() needs no list of its keys; and its rows are dealt over several parts
    names = full.groupBy("set").agg(F.min("key").alias("item"))
    named = join_split(full, names, "set", "key", "inner")
    members = checkpointed(named.select("key", "item", F.when(F.col("key") == F.col("item"), F.col("words")).alias("words")))
    sets = members.where("key = item").select("item", "words")
    return sets, members.select("key", "item"), counted


def similar_rows(df: DataFrame, key: str, text: str, threshold: float) -> DataFrame:
    """(a, b) for every two rows with keys a < b whose word sets are similar enough, copies included.

    All pairs are the demanded result here; where groups do, use `classes`."""
    sets, members, counted = _items(df, key, text)
    links = similar_items(sets, threshold, counted).select("a", "b")
    left, right = members.select(F.col("item").alias("a"), F.col("key").alias("ka")), members.select(F.col("item").alias("b"), F.col("key").alias("kb"))
    across = links.join(left, "a").join(right, "b")
    same = left.join(right, F.col("a") == F.col("b")).where(F.col("ka") < F.col("kb"))
    return across.unionByName(same.select("b", "a", "ka", "kb"), allowMissingColumns=True).select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"))


def components(links: DataFrame, checkpoint_every: int = 1) -> DataFrame:
    """links(a, b) -> (item, component): connected components, named by their least item.

    Alternating large-star and small-star steps: a logarithmic number of rounds, each of two grouped
    aggregations; lineage is cut by a checkpoint in every round, and only counts reach the driver."""
    edges = checkpointed(links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a != b").distinct()
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(down, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("b")), F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b").where("a != b").distinct()
        new = checkpointed(small.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        if new.count() == edges.count() and new.exceptAll(edges).isEmpty():
            break
        edges = new
    return edges.groupBy(F.col("b").alias("item")).agg(F.min("a").alias("component"))


def classes(df: DataFrame, key: str, text: str, threshold: float) -> DataFrame:
    """One row per record: key, item (its class of equal sets), n_links (of its item to other items), component.

    Records without a word are classes of their own; so are those without a link."""
    sets, members, counted = _items(df, key, text)
    links = checkpointed(similar_items(sets, threshold, counted).select("a", "b"))
    degree = links.select(F.explode(F.array("a", "b")).alias("item")).groupBy("item").agg(F.count("*").alias("n_links"))
    grouped = members.join(degree, "item", "left").join(components(links), "item", "left")
    out = df.select(F.col(key).alias("key")).join(grouped, "key", "left")
    item = F.coalesce("item", "key")
    return out.select(F.col("key").alias(key), item.alias("item"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", item).alias("component"))


def record_text(first: Column, second: Column) -> Column:
    return F.concat(F.coalesce(first, F.lit("")), F.lit(" "), F.coalesce(second, F.lit("")))
