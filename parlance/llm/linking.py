"""Connected groups from candidate buckets, without making all pairs of a bucket.

A bucket is a key that some groups share; sets (documents, lines) of these groups may be linked only
if their groups share a key. A group stands for all sets that no bucket tells apart; where each set
has its own keys, it is its own group.

First the group pairs of a bucket with its least group are filtered, and one set of each side is
verified. A bucket all of whose sets are in one component then is closed: its groups are never
expanded. Only the buckets that stay open are expanded to their sets. In those, sets outside the
commonest component ask; they are compared with the whole bucket in cells: both sides are dealt into
blocks of at most CELL sets, and each pair of blocks is one cell, in which a vectorised test, on
groups first, finds the pairs that may be linked. No row is made for a pair before it has passed that
test, and no task holds more than a cell, so a bucket of any size is many cells.

Of the pairs that pass, a set gives the nearest one of a cell first, since most sets are linked to
that; then the nearest for each other component that it still meets, and if these turn out to be no
links the next ones, 8 times as many each round, until none is left out. So the rows made stay in
proportion to sets and components, and no link between components is missed. Rows of cells grow
faster than sets, as a set moves to as many cells as its bucket has blocks; so cells come in waves, each of
which is done with before the next one moves; facts are joined to the sets once, before the waves. A pair that meets in
several buckets is given in one of them. Sets that are short texts go through cells twice instead: first
with their facts alone, which tells those that some pair passes for; only these then move to the cells of
what is left of their buckets with their texts, and there the pairs that pass are verified at once, nearest
first, but for those that links have united already, so that pairs of sets that merely hold a common
passage never become rows, and texts of sets that pass with no other never move.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import Scratch, components, maybe_broadcast

CELL = 2048
FIRST_PAIRS = 1
#: Rows of cells that a wave may move, if there are fewer sets.
WAVE_ROWS = 1 << 19
#: A set knows so many of its buckets, those of least keys; a pair is given in the least one that both know.
OWN_KEYS = 8
#: Pairs that a task tests at once.
FLAT = 1 << 18
#: Pairs that are verified at once, at first and at most; what they unite spares later ones.
FIRST_VERIFIED, VERIFIED = 64, 4096
#: Waves of keys in which the shared ones of larger inputs are found.
KEY_WAVES = 4
#: Keys that may be broadcast, after they have been counted: some 150 MB at most.
KEY_ROWS = 2_000_000

#: near(columns, i, j): distances of rows i to rows j, -1 where they can't be linked.
Near = Callable[[dict, np.ndarray, np.ndarray], np.ndarray]
#: alike(xs, ys): which pairs of sets are linked, from their raw columns.
Alike = Callable[[list[str], list[str]], np.ndarray]
#: within(columns): sizes of sets, and the least size of what each can be linked with, which grows with its own.
Within = Callable[[dict], tuple[np.ndarray, np.ndarray]]


def shared_keys(members: DataFrame, scratch: Scratch, waves: int = 1) -> DataFrame:
    """(key, grp, place), once each, of the keys that some groups share.

    members (key, grp, place), repeats allowed. Least and largest group tell which keys are shared;
    they combine before the shuffle. What other keys hold is dropped before anything else moves. Keys
    come in waves, so that the shuffle of one wave is freed before the next one's.
    """
    out = None
    for wave in range(waves):
        part = members.where(F.pmod("key", F.lit(waves)) == wave) if waves > 1 else members
        shared = part.groupBy("key").agg(F.min("grp").alias("least"), F.max("grp").alias("most")).where("least < most").select("key")
        shared = scratch.save(shared)
        held = scratch.save(part.join(maybe_broadcast(shared, KEY_ROWS), "key").groupBy("key", "grp").agg(F.min("place").alias("place")))
        scratch.drop(shared)
        out = held if out is None else out.unionByName(held)
    return out


def buckets(held: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, grp, place, least, size) of one bucket for each set of groups that some bucket has.

    held as `shared_keys` makes it. size counts a bucket's groups, and least is its least one.
    Groups are hashes, so count, least, largest and exclusive-or tell sets of groups apart.
    """
    marks = held.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("grp").alias("least"), F.max("grp").alias("most"), F.bit_xor("grp").alias("x"))
    kept = marks.groupBy("size", "least", "most", "x").agg(F.min("key").alias("key")).select("key", "least", "size")
    return scratch.save(held.join(kept, "key").select("key", "grp", "place", "least", "size"))


def _columns(batch) -> dict:
    out = {}
    for name in batch.schema.names:
        c = batch.column(name)
        if pa.types.is_list(c.type):
            c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
            sizes = np.diff(c.offsets.to_numpy())
            out[name] = np.full((len(c), OWN_KEYS), np.iinfo(np.int64).max)
            out[name][np.repeat(np.arange(len(c)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = c.flatten().to_numpy()
            continue
        out[name] = np.array(c.to_pylist(), object) if pa.types.is_binary(c.type) else c.to_numpy(zero_copy_only=False)
    return out


def _passing(pairs: DataFrame, facts: list[str], near: Near) -> DataFrame:
    """Distinct (a, b) of those pairs that near lets through; columns of the two sides are called a_ and b_."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            cols = _columns(batch)
            both = {c: np.concatenate([cols[f"a_{c}"], cols[f"b_{c}"]]) for c in [*facts, "place"]}
            ok = near(both, np.arange(n), n + np.arange(n)) >= 0
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(cols["a_id"], cols["b_id"])[ok]), pa.array(np.maximum(cols["a_id"], cols["b_id"])[ok])], ["a", "b"])

    return pairs.mapInArrow(run, "a long, b long").distinct()


def _first_pairs(held: DataFrame, sets: DataFrame, facts: list[str], near: Near, grouped: bool, scratch: Scratch) -> DataFrame:
    """(a, b): one set of each group with one of the bucket's least group, and each set of a group with its least one."""
    reps, stars = sets, held.where("grp <> least")
    if not grouped:
        # dealt by one side, pairs are made distinct and meet that side's facts in one shuffle
        none = F.lit(-1)
        stars = stars.select(F.col("least").alias("a_grp"), F.col("grp").alias("b_grp")).repartition("b_grp").distinct().withColumns({"a_place": none, "b_place": none})
    else:
        hubs = held.where("grp = least").select("key", F.col("grp").alias("a_grp"), F.col("place").alias("a_place"))
        stars = stars.join(hubs, "key").select("a_grp", "a_place", F.col("grp").alias("b_grp"), F.col("place").alias("b_place")).distinct()
        first = sets.groupBy("grp").agg(F.min("id").alias("id"))
        reps = scratch.save(sets.join(first, ["grp", "id"]))
    side = lambda rows, s: rows.select(*[F.col(c).alias(f"{s}_{c}") for c in ["grp", "id", *facts]])
    out = _passing(stars.join(side(reps, "b"), "b_grp").join(side(reps, "a"), "a_grp"), facts, near)
    if grouped:
        inner = side(reps, "a").join(side(sets, "b"), F.col("a_grp") == F.col("b_grp")).where("a_id <> b_id")
        out = out.unionByName(_passing(inner.withColumn("a_place", F.lit(-1)).withColumn("b_place", F.lit(-1)), facts, near))
    return out


def _open(held: DataFrame, sets: DataFrame, labels: DataFrame, grouped: bool, scratch: Scratch) -> DataFrame:
    """(key, grp, place, id, label, asks) of the sets in buckets that have more than one component.

    Where a group is one set, the only pair of a bucket of two has been looked at, so these are closed.
    """
    held = held if grouped else held.where("size > 2")
    labelled = sets.select("id", "grp").join(labels, "id", "left").select("id", "grp", F.coalesce("label", "id").alias("label"))
    labelled = scratch.save(labelled)
    of_group = labelled.groupBy("grp").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n")) if grouped else labelled.select("grp", F.col("label").alias("low"), F.col("label").alias("high"), F.lit(1).alias("n"))
    rows = scratch.save(held.select("key", "grp", "place").join(of_group, "grp"))
    several = rows.groupBy("key").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("key")
    wide, rows = rows, scratch.save(rows.join(maybe_broadcast(scratch.save(several)), "key", "left_semi"))
    scratch.drop(wide)
    counts = rows.groupBy("key", "low").agg(F.sum("n").alias("n"))
    main = counts.groupBy("key").agg(F.max(F.struct("n", "low")).getField("low").alias("main"))
    return rows.join(main, "key").select("key", "grp", "place", "main").join(labelled, "grp").select("key", "grp", "place", "id", "label", (F.col("label") != F.col("main")).alias("asks"))


def _alone() -> Column:
    """Whether a bucket is one cell; there a set that asks answers too, in the same row."""
    return (F.col("nx") == 1) & (F.col("ny") == 1)


def _sizes(now: DataFrame) -> DataFrame:
    """(key, nx, ny, rows) of buckets in which some set asks: blocks of those that ask, blocks of all, and the rows of the cells."""
    sizes = now.groupBy("key").agg(F.count_if("asks").alias("u"), F.count(F.lit(1)).alias("m")).where("u > 0")
    blocks = lambda n: F.ceil(F.col(n) / CELL).cast("int")
    rows = F.when(_alone(), F.col("m")).otherwise(F.col("u") * F.col("ny") + F.col("m") * F.col("nx"))
    return sizes.withColumns({"nx": blocks("u"), "ny": blocks("m")}).select("key", "nx", "ny", rows.alias("rows"))


def _placed(now: DataFrame, sizes: DataFrame, sets: DataFrame, facts: list[str]) -> DataFrame:
    """now of buckets in which some set asks, with blocks x and y of each set and its facts."""
    now = now.join(sizes.select("key", "nx", "ny"), "key")
    x, y = F.pmod(F.xxhash64("id", F.lit(1)), F.col("nx")).cast("int"), F.pmod(F.xxhash64("id", F.lit(2)), F.col("ny")).cast("int")
    return now.withColumns({"x": x, "y": y}).join(sets.select("id", *facts), "id").select("key", "nx", "ny", "x", "y", "id", "label", "asks", "place", *facts)


def _cells(placed: DataFrame, facts: list[str], wave: int = 0, waves: int = 1) -> DataFrame:
    """Rows of cells (key, x, y) of one wave: role 2 asks, role 0 answers, role 1 does both. A wave takes blocks (key, x) that ask, by hash."""
    due = lambda x: F.pmod(F.xxhash64("key", x), F.lit(waves)) == wave
    now = placed.withColumns({"xs": F.filter(F.sequence(F.lit(0), F.col("nx") - 1), due), "asking": F.col("asks") & due(F.col("x"))})
    cell = lambda x, y, role: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), role.alias("role"))
    asked = F.transform(F.sequence(F.lit(0), F.col("ny") - 1), lambda y: cell(F.col("x"), y, F.when(_alone(), 1).otherwise(2)))
    cells = F.concat(F.when(F.col("asking"), asked).otherwise(F.slice(asked, 1, 0)), F.when(_alone() & F.col("asks"), F.slice(asked, 1, 0)).otherwise(F.transform("xs", lambda x: cell(x, F.col("y"), F.lit(0)))))
    return now.where(F.col("asking") | (F.size("xs") > 0)).withColumn("cell", F.explode(cells)).select("key", "cell.x", "cell.y", "cell.role", "id", "label", "asks", "place", *facts)


def _met_before(col: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs share a known bucket of a lesser key than the one that they are met in."""
    out = np.zeros(len(i), bool)
    theirs = col["own"][j]
    for k in range(OWN_KEYS):
        mine = col["own"][i, k]
        out |= (mine < col["key"][i]) & (theirs == mine[:, None]).any(1)
    return out


def _nearest(asker, label, distance, given: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs to give: for each asker and label those up to `most` that follow the `given` nearest; and the askers that have more.

    Components only grow together, so a pair that was not given before is never among the nearest given.
    """
    order = np.lexsort((distance, label, asker))
    a, b = asker[order], label[order]
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    nth = np.arange(len(a)) - np.repeat(first, np.diff(np.r_[first, len(a)]))
    return order[(nth >= given) & (nth < most)], np.unique(a[nth >= most])


def _links(col: dict, i: np.ndarray, j: np.ndarray, d: np.ndarray, alike: Alike, up: dict) -> list[tuple[int, int]]:
    """Links among the pairs i, j, nearest first; up holds what has been united, and pairs of one component are passed over."""

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    out = []
    order = np.argsort(d, kind="stable")
    i, j, label, raw = i[order], j[order], col["label"], col["raw"]
    at, step = 0, FIRST_VERIFIED
    while at < len(i):
        pairs = [(m, n) for m, n in zip(i[at : at + step].tolist(), j[at : at + step].tolist(), strict=True) if root(int(label[m])) != root(int(label[n]))]
        linked = alike([raw[m] for m, _ in pairs], [raw[n] for _, n in pairs]) if pairs else []
        for (m, n), ok in zip(pairs, linked, strict=True):
            x, y = root(int(label[m])), root(int(label[n]))
            if ok and x != y:
                up[max(x, y)] = min(x, y)
                out.append((int(col["id"][m]), int(col["id"][n])))
        at, step = at + step, min(2 * step, VERIFIED)
    return out


def _fitting(of: np.ndarray, size: np.ndarray, least: np.ndarray, asks: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where in the last, the rows that answer by cell and size, those begin that fit each row that asks, and how many follow."""
    there = there[np.lexsort((size[there], of[there]))]
    # sizes become places in their order, so that a number holds both cell and place
    sizes = np.unique(size)
    cell = of * (len(sizes) + 1)
    low = np.searchsorted((cell + np.searchsorted(sizes, size))[there], (cell + np.searchsorted(sizes, least))[asks])
    # the least sizes grow with the sizes, so the largest that fits is found in the same order
    bounds = np.unique(np.r_[least, size])
    cell = of * (len(bounds) + 1)
    high = np.searchsorted((cell + np.searchsorted(bounds, least))[there], (cell + np.searchsorted(bounds, size))[asks], "right")
    return low, high - low, there


def _cell_pairs(cells: DataFrame, near: Near, given: int, most: int, alike: Alike | None = None, single: bool = False, within: Within | None = None) -> DataFrame:
    """(a, b, key, left): pairs of cells with two labels that pass near; left rows tell (a, key) of sets that have more.

    For each label those from the `given` nearest up to the `most` nearest; with most 0, one for all labels.
    With alike, cells have raw, and all pairs that pass near are verified at once: only links become rows.
    With single, rows are the sets (a, a, key) that some pair passes near for, once a cell at least; cells need no own.
    With within, a set meets only those of its cell whose sizes allow a link, others are never paired with it.
    """

    def run(batches):
        held: list = []

        def flush(rows):
            col, up, told = _columns(rows), {}, np.zeros(rows.num_rows, bool)
            cell = np.stack([col["key"], col["x"], col["y"]], 1)
            first = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]).any(1)])
            ends = np.r_[first[1:], len(cell)]
            of = np.repeat(np.arange(len(first)), ends - first)
            asks, there = np.flatnonzero(col["role"] > 0), np.flatnonzero(col["role"] < 2)
            if within is None:
                low = np.searchsorted(of[there], of[asks])
                answers = np.searchsorted(of[there], of[asks], "right") - low
            else:
                low, answers, there = _fitting(of, *within(col), asks, there)
            upto = np.cumsum(answers)
            at = 0
            while at < len(asks):
                to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + FLAT, "right")))
                n = answers[at:to]
                i = np.repeat(asks[at:to], n)
                j = there[np.repeat(low[at:to] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                ok = (col["label"][i] != col["label"][j]) & (~col["asks"][j] | (col["id"][i] < col["id"][j]))  # two that ask meet once
                i, j = i[ok], j[ok]
                d = near(col, i, j)
                i, j, d = i[d >= 0], j[d >= 0], d[d >= 0]
                at = to
                if single:
                    new = np.unique(np.r_[i, j])
                    new = new[~told[new]]
                    told[new] = True
                    a = pa.array(col["id"][new])
                    yield pa.RecordBatch.from_arrays([a, a, pa.array(col["key"][new]), pa.array(np.zeros(len(new), bool))], ["a", "b", "key", "left"])
                    continue
                ok = ~_met_before(col, i, j)
                i, j, d = i[ok], j[ok], d[ok]
                if alike is not None:
                    if links := _links(col, i, j, d, alike, up):
                        a, b = (pa.array(x, pa.int64()) for x in zip(*links, strict=True))
                        yield pa.RecordBatch.from_arrays([a, b, a, pa.array([False] * len(links))], ["a", "b", "key", "left"])
                elif len(i):
                    give, more = _nearest(i, col["label"][j] if most else np.zeros(len(j), np.int64), d, given, max(most, 1))
                    one, two = col["id"][i[give]], col["id"][j[give]]
                    a, b = np.r_[np.minimum(one, two), col["id"][more]], np.r_[np.maximum(one, two), col["id"][more]]
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.r_[col["key"][i[give]], col["key"][more]]), pa.array(np.arange(len(a)) >= len(one))], ["a", "b", "key", "left"])

        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < 4 * CELL:
                continue
            # the last cell may go on in the next batch
            rows = pa.Table.from_batches(held)
            cell = np.stack([rows.column(c).to_numpy() for c in ("key", "x", "y")], 1)
            last = int(np.flatnonzero((cell != cell[-1]).any(1)).max(initial=-1)) + 1
            if last:
                yield from flush(rows.slice(0, last).combine_chunks())
            rest = rows.slice(last)
            held, size = rest.to_batches(), rest.num_rows
        if size:
            yield from flush(pa.Table.from_batches(held).combine_chunks())

    n = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cells.repartition(n, "key", "x", "y").sortWithinPartitions("key", "x", "y", "role")
    return dealt.mapInArrow(run, "a long, b long, key long, left boolean")


def _met(now: DataFrame, sets: DataFrame, facts: list[str], scratch: Scratch, near: Near, given: int, most: int, alike: Alike | None = None, single: bool = False, within: Within | None = None) -> DataFrame:
    """What `_cell_pairs` gives for all cells, wave by wave: a wave moves about as many rows as there are sets, so cells never fill the disk.

    Sets meet their facts once, before the waves, which only read and deal them out.
    """
    sizes = scratch.save(_sizes(now))
    waves = max(1, -(-(sizes.agg(F.sum("rows")).first()[0] or 0) // max(WAVE_ROWS, sets.count())))
    placed = _placed(now, sizes, sets, facts)
    kept = waves > 1 or alike is not None
    if kept:
        placed = scratch.save(placed)
    out = None
    for wave in range(waves):
        part = scratch.save(_cell_pairs(_cells(placed, facts, wave, waves), near, given, most, alike, single, within))
        out = part if out is None else out.unionByName(part)
    if kept:
        scratch.drop(placed)
    return out


def _own_keys(rows: DataFrame, name: str) -> DataFrame:
    """(name, own): the OWN_KEYS least keys of each."""
    return rows.groupBy(name).agg(F.slice(F.sort_array(F.collect_list("key")), 1, OWN_KEYS).alias("own"))


def _links_of_texts(now: DataFrame, sets: DataFrame, facts: list[str], scratch: Scratch, near: Near, alike: Alike, texts: Callable[[DataFrame], DataFrame], within: Within | None = None) -> DataFrame:
    """Links (a, b) between components of open buckets; texts are fetched for the sets only that some pair passes near for."""
    found = _met(now, sets, facts, scratch, near, 0, 0, None, True, within)
    found = scratch.save(found.select("key", F.col("a").alias("id")).distinct())
    now = scratch.save(now.join(found, ["key", "id"], "left_semi"))
    ids = found.select("id").distinct()
    few = scratch.save(sets.join(_own_keys(found, "id"), "id").join(texts(ids), "id"))
    return _met(now, few, [*facts, "own", "raw"], scratch, near, 0, 0, alike, False, within).select("a", "b")


def link(held: DataFrame, sets: DataFrame, near: Near, verify: Callable[[DataFrame, object], DataFrame], scratch: Scratch, grouped: bool, prepare: Callable[[DataFrame], DataFrame] | None = None, alike: Alike | None = None, texts: Callable[[DataFrame], DataFrame] | None = None, within: Within | None = None) -> DataFrame:
    """(id, label) of every id with a link; label is the least id of its component.

    held as `buckets` makes it; sets (id, grp, facts...), repeats allowed; without grouped, each id is its own group.
    near only rejects pairs that verify would. prepare may add facts to those sets that have
    candidates. verify gets pairs (a, b) and the sets, and returns the pairs that are linked. With
    alike, open buckets are verified in their cells, in one round; texts gives (id, raw), once each, for ids,
    and within spares pairs in cells.
    """
    used = held.select("grp").distinct()
    if grouped:
        own = sets.groupBy("grp").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("grp")
        held = scratch.save(held.unionByName(own.select(F.col("grp").alias("key"), "grp", F.lit(-1).alias("place"), F.col("grp").alias("least"), F.lit(0).cast("long").alias("size"))))
        used = held.select("grp").distinct()
    sets = scratch.save(sets.join(used, "grp", "left_semi").dropDuplicates(["id"]))
    if alike is None:
        plain, sets = sets, scratch.save(sets.join(_own_keys(held, "grp"), "grp"))
        scratch.drop(plain)
    if prepare:
        plain, sets = sets, scratch.save(prepare(sets))
        scratch.drop(plain)
    facts = [c for c in sets.columns if c not in ("id", "grp", "own")]
    at = scratch.count
    pairs = scratch.save(_first_pairs(held, sets, facts, near, grouped, scratch))
    labels = components(scratch.save(verify(pairs, sets)), scratch)
    now = scratch.save(_open(held, sets, labels, grouped, scratch))
    scratch.release(at, labels, now)
    if hasattr(held, "scratch_path"):
        scratch.drop(held)
    given, most = 0, 0
    if alike is not None and not now.isEmpty():
        links = _links_of_texts(now, sets, facts, scratch, near, alike, texts, within)
        return components(links.unionByName(labels.where("id <> label").select(F.col("id").alias("a"), F.col("label").alias("b"))), scratch)
    while not now.isEmpty():
        found = _met(now, sets, [*facts, "own"], scratch, near, given, most)
        links = scratch.save(verify(found.where("not left").select("a", "b").distinct(), sets))
        if not links.isEmpty():
            # old components are stars about their labels, so their edges need not be read again
            labels = components(links.unionByName(labels.where("id <> label").select(F.col("id").alias("a"), F.col("label").alias("b"))), scratch)
        left = scratch.save(found.where("left").select(F.col("a").alias("id"), "key", F.lit(True).alias("again")).distinct())
        if left.isEmpty():
            break
        # only what was left out asks again, in its own buckets
        rows = now.drop("label", "asks").join(maybe_broadcast(left.select("key").distinct()), "key", "left_semi").join(labels, "id", "left").join(left, ["id", "key"], "left")
        now = scratch.save(rows.select("key", "grp", "place", "id", F.coalesce("label", "id").alias("label"), F.coalesce("again", F.lit(False)).alias("asks")))
        scratch.release(at, labels, now)
        given, most = most, 8 * most or FIRST_PAIRS
    return labels
