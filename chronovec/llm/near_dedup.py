"""Operator 7: MinHash near-duplicates with tensored banding.

Every text becomes the set of its distinct word shingles, as 64-bit hashes.
Two collections of M sub-keys, each over K minhashes, are computed; a table key
is a pair (i, j) with a sub-key from each collection, so 2*M*K minhashes serve
M*M tables of 2*K rows. Two sets of similarity s share a table with probability
(1 - (1 - s^K)^M)^2, over 0.99997 at s = 0.8 with the defaults.

A table key can be shared only if both its sub-keys are, so keys are formed only
from sub-keys that some other set has too. In every bucket of a table each member
meets one pivot, the member that shares most sub-keys, and is confirmed against it.
A pivot with the members of its buckets is a group; a group that then still holds
several components is finished exactly, but for one whose sets all lie in a larger one
(`_outer`). There each set is written as its difference to a common reference, so that what
all have in common drops out. Two sets of
different components can be similar only if they share so many elements of their
differences that one of these is among the rarest of either (`_finish`). Pairs that
have such an element in common are confirmed; all other pairs can't be similar. So
no pair of a bucket is left out. Where elements are in half of the sets, as in documents
made from one template, rarity tells nothing, and such groups are banded again by
sampled bits of their differences (`_plans`, `_banded`): a pair at the threshold is met with
probability 1 - MISSED, other pairs seldom. All links are confirmed on full sets.
Components come from a distributed star contraction.

Equal sets are one vertex, so exact copies never form pairs. Rows that share a
doc_id are one document; rows that repeat it with the same set enter the search
once, and each set of an id that has several is searched. Null or wordless texts and null ids link with nothing. Whole
texts of any length are read; an empty table gives an empty result; columns besides
doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordhash
from .common import connected_components, drop, join_sized, materialize, table

K, M = 3, 16
#: Groups of at least MANY sets are looked at for elements that a quarter to three quarters of them have.
MANY = 64
#: Chance that sampled bits miss a pair just as similar as asked for.
MISSED = 1e-4


def _shingles(texts: list[bytes], width: int):
    """(hashes of all shingles, first of each text, number for each text), repeats included."""
    hashes, counts = wordhash.words(texts, wordhash.BY_SPACE)
    first = np.concatenate(([0], np.cumsum(counts)[:-1])) if len(counts) else np.zeros(0, np.int64)
    full = wordhash.grams(hashes, width)
    number = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    out = np.empty(int(number.sum()), np.uint64)
    to = np.concatenate(([0], np.cumsum(number)[:-1])).astype(np.int64) if len(number) else first
    long = counts >= width
    take = np.repeat(first[long] - to[long], number[long]) + _ranges(to[long], number[long])
    out[_ranges(to[long], number[long])] = full[take]
    for i in np.flatnonzero((counts > 0) & ~long):
        out[to[i]] = wordhash.grams(hashes[first[i] : first[i] + counts[i]], int(counts[i]))[0]
    return out, to, number


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out = []
    for a, b in wordhash.pieces(texts):
        hashes, first, number = _shingles(texts[a:b], width)
        out += [np.unique(hashes[i : i + n]) for i, n in zip(first, number)]
    return out


def _texts(column: pa.ChunkedArray) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _sketches(width: int, k: int, m: int, seed: int):
    factors = np.random.default_rng(seed).integers(0, 1 << 63, 2 * m * k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    places = wordhash.mix(np.arange(1, 2 * m + 1, dtype=np.uint64))

    def run(batches):
        for batch in batches:
            texts = _texts(batch.column("text"))
            sizes, sums, xors, subs = [], [], [], []
            for a, b in wordhash.pieces(texts):
                hashes, first, number = _shingles(texts[a:b], width)
                some = number > 0
                low = np.zeros((len(factors), b - a), np.uint64)
                if some.any():
                    for f, factor in enumerate(factors):
                        low[f, some] = np.minimum.reduceat(hashes * factor, first[some])
                keys = low.reshape(2 * m, k, b - a)
                mixed = np.zeros((2 * m, b - a), np.uint64)
                for j in range(k):
                    mixed = wordhash.mix(mixed * np.uint64(0x9FB21C651E98DF25) + keys[:, j] + places[:, None])
                subs.append(mixed.T.view(np.int64))
                for i, n in zip(first, number):
                    own = np.unique(hashes[i : i + n])
                    sizes.append(len(own))
                    sums.append(int(wordhash.mix(own).sum(dtype=np.uint64).astype(np.int64)) if n else 0)
                    xors.append(int(np.bitwise_xor.reduce(own).astype(np.int64)) if n else 0)
            subs = np.concatenate(subs) if subs else np.zeros((0, 2 * m), np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(sums, pa.int64()),
                    pa.array(xors, pa.int64()),
                    pa.ListArray.from_arrays(np.arange(0, subs.size + 1, 2 * m, dtype=np.int32), subs.ravel()),
                ],
                ["doc_id", "n", "h1", "h2", "subs"],
            )

    return run


def _sets(width: int):
    def run(batches):
        for batch in batches:
            sets = shingle_sets(_texts(batch.column("text")), width)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["id", "shingles"]
            )

    return run


def _members(reps: DataFrame, m: int) -> DataFrame:
    """(key, id, n, pop) of table keys that at least two sets share."""
    subs = reps.select("id", "n", "h1", "h2", F.posexplode("subs").alias("place", "sub"))
    shared = subs.groupBy("place", "sub").agg(F.count("*").alias("of")).where("of > 1")
    own = subs.join(shared, ["place", "sub"])
    # at most 2 * M entries, as reps has each set of an id once
    sides = own.groupBy("id", "n", "h1", "h2").agg(
        F.sum("of").alias("pop"),
        F.collect_list(F.when(F.col("place") < m, F.col("sub"))).alias("left"),
        F.collect_list(F.when(F.col("place") >= m, F.col("sub"))).alias("right"),
    )
    pairs = F.flatten(F.transform("left", lambda a: F.transform("right", lambda b: F.xxhash64(a, b))))
    keys = materialize(sides.select(F.explode(pairs).alias("key"), "id", "n", "pop"), "table-keys")
    several = keys.groupBy("key").agg(F.count("*").alias("of")).where("of > 1")
    out = materialize(keys.join(several, "key").select("key", "id", "n", "pop"), "members")
    drop(keys)
    return out


def _star(members: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): each member of a bucket with its pivot, the member that shares most sub-keys with others."""
    pivots = members.groupBy("key").agg(F.max(F.struct("pop", -F.col("id"), "n")).alias("top"))
    pairs = members.join(pivots, "key").select(
        (-F.col("top")["col2"]).alias("a"), F.col("top")["n"].alias("n_a"), F.col("id").alias("b"), F.col("n").alias("n_b")
    )
    return pairs.where("a <> b").distinct()


def _confirmed(pairs: DataFrame, pool: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar."""
    sets_a, sets_b = (pool.select(F.col("id").alias(x), F.col("shingles").alias(f"set_{x}")) for x in "ab")
    both = F.size(F.array_intersect("set_a", "set_b"))
    similar = 100 * both >= percent * (F.size("set_a") + F.size("set_b") - both)
    return pairs.join(sets_b, "b").join(sets_a, "a").where(similar).select("a", "b")


def _outer(groups: DataFrame) -> DataFrame:
    """groups(p, id, n, root, of) without those whose sets all lie in the largest group that has their pivot.

    That group holds their pairs too. Of groups with equal sets the one with the largest pivot stays, so each
    group that goes lies in one that stays. An id may have sets of several sizes, so ids count with their sizes.
    """
    holders = groups.join(groups.select(F.col("p").alias("id")).distinct(), "id", "left_semi")
    largest = holders.groupBy("id").agg(F.max(F.struct("of", "p")).alias("top"))
    over = largest.select(F.col("id").alias("p"), F.col("top")["p"].alias("q")).where("p <> q")
    both = groups.join(over, "p").join(groups.select(F.col("p").alias("q"), "id", "n"), ["q", "id", "n"], "left_semi")
    inside = both.groupBy("p", "of").agg(F.count("*").alias("both")).where("both = of").select("p")
    return materialize(groups.join(materialize(inside, "inner"), "p", "left_anti"), "outer-groups")


def _by_rarity(pool: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, alone, rare): the sets of ids, elements that several of them have by number of sets, and how many others there are."""
    each = materialize(pool.join(ids, "id", "left_semi").select("id", F.explode("shingles").alias("x")), "elements")
    several = each.groupBy("x").agg(F.count("*").alias("of")).where("of > 1")
    known = each.join(several, "x").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("of", "x"))).alias("known"))
    sized = pool.join(ids, "id", "left_semi").select("id", F.size("shingles").alias("n"))
    rare = F.coalesce(F.col("known")["x"], F.array().cast("array<long>"))
    out = materialize(
        sized.join(known, "id", "left").select("id", rare.alias("rare")).join(sized, "id").select("id", "rare", (F.col("n") - F.size("rare")).alias("alone")), "by-rarity"
    )
    drop(each)
    return out


def _differences(groups: DataFrame, pool: DataFrame, percent: int) -> DataFrame:
    """(p, id, root, alone, last, d, e) for groups(p, id, n, root): each set's difference to its group's reference.

    The reference is the pivot without the elements that it alone has. `last` lists the difference but for elements
    that the set alone has, which are counted in `alone`: first what the reference lacks, rare elements before
    frequent ones, then what only the reference has, where elements that few sets lack come first. d is the size
    of the difference; e = d - c * n, times 100 + percent, with c = (100 - percent) / (100 + percent).
    """
    order = _by_rarity(pool, groups.select("id").distinct())  # a pivot is a member of its group
    pivots = order.select(F.col("id").alias("p"), F.col("rare").alias("of_p"))
    pairs = groups.join(order, "id").join(pivots, "p")
    more, less = F.array_except("rare", "of_p"), F.reverse(F.array_except("of_p", "rare"))
    own = (
        pairs.withColumn("last", F.concat(more, less))
        .withColumn("d", F.col("alone") + F.size("last"))
        .withColumn("e", (100 + percent) * F.col("d") - (100 - percent) * F.col("n"))
        .select("p", "id", "root", "alone", "last", "d", "e")
    )
    return materialize(own.repartition("id", "p"), "differences")


def _finish(groups: DataFrame, pool: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of groups(p, id, n, root) that may be similar, in different components; complete.

    Sets a and b are similar just if |a ^ b| = d_a + d_b - 2 s <= c (n_a + n_b), so if they share
    s >= (e_a + e_b) / 2 elements of their differences. Let o have the least e of the group. Sets with e <= -e_o are
    similar to o, and paired with it. Of two other sets that aren't both paired with o one, a, has e_a > -e_o; so
    0 < (e_b - e_o) / 2 < s for the other, and the first d_b - s + 1 of b's difference, in the common order, hold
    an element of a's.
    """
    step = 2 * (100 + percent)
    own = _differences(groups, pool, percent)
    least = materialize(own.groupBy("p").agg(F.min(F.struct("e", "id", "root")).alias("o")), "nearest")
    own = own.join(least, "p").withColumn("t", -F.col("o")["e"])
    core = own.where((F.col("e") <= F.col("t")) & (F.col("id") != F.col("o")["id"]) & (F.col("root") != F.col("o")["root"]))
    first = F.slice("last", 1, F.greatest(F.col("d") - F.floor((F.col("e") + F.col("t")) / step).cast("int") - F.col("alone"), F.lit(0)))

    def shown(rows: DataFrame, elements: Column, side: str) -> DataFrame:
        columns = [F.col(c).alias(f"{c}_{side}") for c in ("id", "root", "e")]
        return rows.select(F.col("p"), F.size("last").alias(f"of_{side}"), *columns, F.posexplode(elements).alias(f"i_{side}", "x"))

    far, near = shown(own.where(F.col("e") > F.col("t")), F.col("last"), "a"), shown(own.where(F.size(first) > 0), first, "b")
    share = F.col("e_a") + F.col("e_b")  # what is left of either difference has as many elements as they must share
    met = far.join(near, ["p", "x"]).where("root_a <> root_b").where(
        (step * (F.col("of_a") - F.col("i_a")) >= share) & (step * (F.col("of_b") - F.col("i_b")) >= share)
    )
    pairs = met.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).union(core.select(F.col("o")["id"], "id"))
    return materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")


def _joined(groups: DataFrame) -> DataFrame:
    """(g, id, n, root): the sets of groups of MANY or more, groups that overlap taken together; each set is in one."""
    own = groups.where(F.col("of") >= MANY)
    whole = connected_components(own.select(F.col("p").alias("a"), F.col("id").alias("b")))
    return own.select("id", "n", "root").distinct().join(whole.select("id", F.col("root").alias("g")), "id").select("g", "id", "n", "root")


def _plans(joined: DataFrame, elements: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """How to band groups again: (g, width, bits, tables), and (g, x, at) of their contested elements.

    Contested elements are those that a quarter to three quarters of a group's sets have; as a set has at most as
    many as its size, there are at most four times as many as the longest set has. Similar sets differ in c (n_a + n_b)
    elements at most, so they agree on a contested element drawn at random with probability `like` or more; any two
    sets of the group agree with probability `any` on average. A key is made of so many drawn elements that few
    sets share one by chance, and there are so many keys that a similar pair misses all with probability MISSED.
    Groups where too many pairs would meet by chance have no plan.
    """
    sizes = joined.groupBy("g").agg(F.countDistinct("id").alias("sets"), F.max("n").alias("longest"))
    share = F.col("of") / F.col("sets")
    seen = elements.groupBy("g", "x").agg(F.count("*").alias("of")).join(sizes, "g").where((share >= 0.25) & (share <= 0.75))
    seen = materialize(seen.select("g", "x", (1 - 2 * share * (1 - share)).alias("agree"), "sets", "longest"), "contested")
    each = seen.groupBy("g").agg(F.count("*").alias("width"), F.avg("agree").alias("any"), F.max("sets").alias("sets"), F.max("longest").alias("longest"))
    apart = F.floor(2 * F.col("longest") * (100 - percent) / (100 + percent))
    plans = (
        each.withColumn("like", 1 - apart / F.col("width"))
        .where("like > any")
        # a key costs about as much as reading 8 elements of either set of a pair
        .withColumn("bits", F.least(F.ceil(F.log(F.col("sets") * F.greatest(F.col("longest") / 16, F.lit(16))) / -F.log("any")), F.lit(62)).cast("int"))
        .withColumn("tables", F.ceil(-F.log(F.lit(MISSED)) / F.pow("like", "bits")))
        .where(F.col("tables") * F.pow("any", "bits") <= 0.25)
        .select("g", "width", "bits", F.col("tables").cast("int").alias("tables"))
    )
    plans = materialize(plans, "plans")
    # at most as many elements as a set can have, four times
    numbered = seen.join(plans.select("g"), "g", "left_semi").groupBy("g").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return plans, materialize(numbered.select("g", F.posexplode("x").alias("at", "x")), "numbered")


def _bit_keys(batches):
    drawn: dict[tuple, np.ndarray] = {}
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            plan = [part.column(c).to_pylist() for c in ("g", "width", "bits", "tables")]
            keys = []
            for own, (g, width, bits, tables) in zip(part.column("at"), zip(*plan)):
                if (g, width, bits, tables) not in drawn:
                    if len(drawn) > 16:
                        drawn.clear()
                    drawn[g, width, bits, tables] = np.random.default_rng([g & (1 << 64) - 1, tables]).integers(0, width, (tables, bits))
                has = np.zeros(width, np.int64)
                has[own.values.to_numpy() if own.is_valid else []] = 1
                keys.append(has[drawn[g, width, bits, tables]] @ (1 << np.arange(bits, dtype=np.int64)))
            columns = [part.column(c) for c in ("g", "id", "n", "root")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(keys, pa.list_(pa.int64()))], ["g", "id", "n", "root", "keys"])


def _banded(joined: DataFrame, elements: DataFrame, plans: DataFrame, numbered: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that agree on all elements drawn for one key or more, for groups with a plan."""
    places = elements.join(numbered, ["g", "x"]).groupBy("g", "id").agg(F.collect_list("at").alias("at"))
    rows = joined.join(plans, "g").join(places, ["g", "id"], "left")  # a set may have none of the elements
    schema = "g long, id long, n long, root long, keys array<long>"
    keys = rows.select("g", "id", "n", "root", "width", "bits", "tables", "at").mapInArrow(_bit_keys, schema)
    keys = materialize(keys.select("g", "id", "n", "root", F.posexplode("keys").alias("place", "key")), "bit-keys")
    bucket = ["g", "place", "key"]
    several = keys.groupBy(*bucket).agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select(*bucket)
    shared = materialize(keys.join(several, bucket), "bit-buckets")
    drop(keys)
    a, b = (shared.select(*bucket, *(F.col(c).alias(f"{c}_{x}") for c in ("id", "n", "root"))) for x in "ab")
    fit = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    met = a.join(b, bucket).where((F.col("root_a") < F.col("root_b")) & fit).select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"))
    return materialize(met.distinct(), "candidates")


def _left(groups: DataFrame, joined: DataFrame, plans: DataFrame) -> DataFrame:
    """The groups that don't lie in one with a plan."""
    planned = joined.join(plans.select("g"), "g", "left_semi").select("id", "g").distinct()
    inside = groups.select("p", "id").join(planned, "id", "left").groupBy("p").agg(
        F.count_if(F.col("g").isNull()).alias("out"), F.min("g").alias("lo"), F.max("g").alias("hi")
    )
    return groups.join(inside.where("out = 0 AND lo = hi").select("p"), "p", "left_anti")


def _open_pairs(groups: DataFrame, pool: DataFrame, percent: int) -> DataFrame:
    """Candidates (a, b) of groups(p, id, n, root, of), each of `of` sets, that still hold several components."""
    joined = materialize(_joined(groups), "joined")
    if not joined.take(1):
        return _finish(groups, pool, percent)
    elements = materialize(joined.select("g", "id").join(pool, "id").select("g", "id", F.explode("shingles").alias("x")).distinct(), "joined-elements")
    plans, numbered = _plans(joined, elements, percent)
    if not plans.take(1):
        drop(elements)
        return _finish(groups, pool, percent)
    banded = _banded(joined, elements, plans, numbered, percent)
    drop(elements)
    rest = materialize(_left(groups, joined, plans), "groups")
    return banded.union(_finish(rest, pool, percent)).distinct() if rest.take(1) else banded


def near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 80, k: int = K, m: int = M, seed: int = 7
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs(doc_id, text, ...)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    sketch = materialize(
        docs.mapInArrow(_sketches(width, k, m, seed), "doc_id long, n long, h1 long, h2 long, subs array<long>"), "sketches"
    )
    real = sketch.where("n > 0 AND doc_id IS NOT NULL")
    classes = materialize(
        real.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "set-classes"
    )
    # repeated rows are combined before the shuffle; class_of has them all
    reps = (
        real.groupBy("doc_id", "n", "h1", "h2")
        .agg(F.first("subs").alias("subs"))
        .join(classes.withColumnRenamed("rep", "doc_id").drop("copies"), ["doc_id", "n", "h1", "h2"])
        .select(F.col("doc_id").alias("id"), "n", "h1", "h2", "subs")
    )
    members = _members(reps, m)
    total = real.count()
    class_of = join_sized(real.select("doc_id", "n", "h1", "h2"), classes, ["n", "h1", "h2"], "copies", total)

    pool = materialize(
        docs.withColumnRenamed("doc_id", "id")
        .join(members.select("id").distinct(), "id", "left_semi")
        .mapInArrow(_sets(width), "id long, shingles array<long>")
        .distinct(),  # combined before the shuffle
        "shingle-sets",
    )
    star = materialize(_star(members), "stars")
    sizes_fit = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    links = materialize(_confirmed(star.where(sizes_fit), pool, percent), "links")
    roots = materialize(connected_components(links), "roots")
    pivots = star.select(F.col("a").alias("p"), F.col("a").alias("id"), F.col("n_a").alias("n")).distinct()
    groups = star.select(F.col("a").alias("p"), F.col("b").alias("id"), F.col("n_b").alias("n")).union(pivots)
    groups = groups.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    groups = materialize(groups, "groups")
    several = groups.groupBy("p").agg(F.count("*").alias("of"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    several = materialize(several.where("lo < hi").select("p", "of"), "open")
    # written, as many steps read it
    groups = _outer(materialize(groups.join(several, "p"), "open-groups"))
    more = _confirmed(_open_pairs(groups, pool, percent), pool, percent)
    links = materialize(links.union(more), "links")
    roots = materialize(connected_components(links), "roots")
    drop(pool), drop(members), drop(star)

    linked = class_of.join(roots.withColumnRenamed("id", "rep"), "rep", "left").withColumn(
        "component_id", F.coalesce("root", "rep")
    )
    alone = sketch.where("n = 0 OR doc_id IS NULL")
    return (
        linked.select("doc_id", F.col("n").alias("n_shingles"), "component_id")
        .unionByName(alone.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4)


SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM words),
rows AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM rows a JOIN rows b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach(x, y) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.x, s.y FROM reach r JOIN shared s ON r.y = s.x)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM sets s JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) c ON c.x = s.doc_id
"""
