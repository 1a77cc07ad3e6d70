"""Centroids, nearest turns and the two-stage teacher."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.functions.vectors import cosine, dot
from parlance.operators.vocabulary import token_ids
from parlance.sources import files


def centroids(ids: DataFrame, embeddings: DataFrame, keys: list[str], dim: int) -> DataFrame:
    """(keys, embedding): the mean vector of each row's ids; ids 0 and 1 and unknown ones are skipped; zeros if none is left.

    embeddings (id, vec). Sums are combined per dimension before the shuffle.
    """
    return _means(ids, ids.select(*keys, F.explode("ids").alias("id")), embeddings, keys, dim)


def turn_centroids(turns: DataFrame, vocab: DataFrame, embeddings: DataFrame, dim: int) -> DataFrame:
    """centroids of turns by their place; tokens meet their ids by a join, so no Python runs on executors."""
    keys = ["section_idx", "turn_idx"]
    return _means(turns, token_ids(turns, vocab, keys), embeddings, keys, dim)


def _means(rows: DataFrame, each: DataFrame, embeddings: DataFrame, keys: list[str], dim: int) -> DataFrame:
    """centroids of rows (keys) from each (keys, id)."""
    each = each.where("id > 1").join(embeddings, "id")
    cells = each.select(*keys, F.posexplode("vec").alias("d", "x")).groupBy(*keys, "d").agg(F.avg(F.col("x").cast("double")).alias("x"))
    vectors = cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("v")).select(*keys, F.transform("v", lambda c: c["x"]).alias("embedding"))
    zeros = F.array_repeat(F.lit(0.0), dim)
    return rows.select(*keys).join(vectors, keys, "left").withColumn("embedding", F.coalesce("embedding", zeros))


def build_index(turns: DataFrame, vocab: DataFrame, embeddings: DataFrame, dim: int) -> DataFrame:
    """(section_idx, turn_idx, person_id, tokens, embedding): a row for each turn with tokens, unknown ones skipped in its mean."""
    spoken = turns.withColumn("tokens", T.tokenize(F.col("text"))).where(F.size("tokens") > 0)
    keys = ["section_idx", "turn_idx"]
    return spoken.select(*keys, "person_id", "tokens").join(turn_centroids(spoken, vocab, embeddings, dim), keys)


#: How an index lies on disk: a folder for each batch that was put in; the corpus is batch -1.
INDEX = "section_idx bigint, turn_idx bigint, person_id bigint, tokens array<string>, embedding array<double>, batch bigint"
CORPUS_BATCH = -1
#: Order of the rows of an index, by which ties go.
INDEX_ORDER = ["batch", "section_idx", "turn_idx"]


def put(rows: DataFrame, path: str, batch: int = CORPUS_BATCH) -> None:
    """Puts rows of `build_index` into the index at path as one batch; a batch that comes again takes its own place."""
    cols = [F.col(c).cast(kind).alias(c) for c, kind in (x.split(" ", 1) for x in INDEX.split(", ")[:-1])]
    rows.select(*cols).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def insert_live(turns: DataFrame, vocab: DataFrame, embeddings: DataFrame, dim: int, path: str, batch: int) -> None:
    """Indexes live turns (section_idx, turn_idx, person_id, text) of one micro-batch; those without tokens are passed over."""
    put(build_index(turns, vocab, embeddings, dim), path, batch)


def open_index(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the index at path, the corpus' and live ones; none if there is no index."""
    return spark.read.schema(INDEX).parquet(path) if files.found(spark, f"{path}/batch=*") else spark.createDataFrame([], INDEX)


def rendered(person: Column, tokens: Column) -> Column:
    """A row of the index as an entry of a history."""
    return F.array_join(T.wrap(person, tokens), " ")


def group_means(vectors: DataFrame, key: str, vec: str) -> DataFrame:
    """(key, dim, mean) of array column vec."""
    return vectors.select(key, F.posexplode(vec).alias("dim", "x")).groupBy(key, "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def top_k(index: DataFrame, query: Column, k: int, order: str | list[str]) -> DataFrame:
    """The k rows of index (order, embedding, ...) nearest to one query by cosine; ties by order, non-finite scores go."""
    if k <= 0:
        return index.withColumn("score", F.lit(0.0)).limit(0)
    scored = index.withColumn("score", cosine(query, F.col("embedding"))).where(~F.isnan("score"))
    return scored.orderBy(F.desc("score"), *([order] if isinstance(order, str) else order)).limit(k)


#: Bytes of query vectors that every task may hold; more queries take more passes over the index.
QUERY_BYTES = 32 << 20
#: Scores that a task holds at once, and rows that it may have chosen before it keeps the best of them.
SCORES = 1 << 20
#: How far a product of 32-bit unit vectors may be from their cosine, for each component; pairs that are scored in 64 bits at once.
ROUNDING, EXACT = 4e-7, 1 << 14
#: Queries that a piece of the index is multiplied with at once.
ASKED = 4096


def _lengths(vectors: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the vectors of each length; without null ones, null components as NaN."""
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    out = []
    for n in np.unique(sizes[~np.isnan(sizes)]):
        at = np.flatnonzero(sizes == n)
        flat = vectors.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
        out.append((at, flat.reshape(len(at), int(n))))
    return out


def _cosines(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """(row, query); the shorter length counts, and a norm of 0 gives 0."""
    n = min(rows.shape[1], queries.shape[1])
    rows, queries = rows[:, :n], queries[:, :n]
    norms = np.sqrt((rows * rows).sum(1))[:, None] * np.sqrt((queries * queries).sum(1))[None]
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(norms == 0, 0.0, rows @ queries.T / norms)


def _norms(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(norms, odd): of rows, and which of them can't be squared or hold what isn't finite; a norm of 0 isn't odd."""
    with np.errstate(all="ignore"):
        norms = np.sqrt((rows * rows).sum(1))
    return norms, ~(np.isfinite(norms) & (norms > 1e-100)) & (rows != 0).any(1)


def _unit(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(units, odd): rows as 32-bit floats of norm 1, zeros where the norm is 0 or odd."""
    norms, odd = _norms(rows)
    fit = ~odd & (norms > 0)
    with np.errstate(all="ignore"):
        return np.where(fit[:, None], rows / np.where(fit, norms, 1)[:, None], 0).astype(np.float32), odd


def _at_least(vectors: np.ndarray, wanted: np.ndarray, units: tuple[np.ndarray, np.ndarray], least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, query, cosine) of all pairs whose cosine is finite and at least the query's least.

    Products of 32 bits rule pairs out, by ROUNDING at most beside the cosine; what is left is scored in 64 bits.
    """
    n = min(vectors.shape[1], wanted.shape[1])
    vectors, wanted = vectors[:, :n], wanted[:, :n]
    asked, odd_asked = units if n == units[0].shape[1] else _unit(wanted)
    rows, odd = _unit(vectors)
    near = rows @ asked.T >= (least - ROUNDING * n).astype(np.float32)
    near[odd] = True
    near[:, odd_asked] = True
    i, j = np.divmod(np.flatnonzero(near), near.shape[1])
    kept = [(i[:0], j[:0], np.empty(0))]
    for at in range(0, len(i), EXACT):
        a, b = i[at : at + EXACT], j[at : at + EXACT]
        x, y = vectors[a], wanted[b]
        norms = np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1))
        with np.errstate(invalid="ignore", divide="ignore"):
            scores = np.where(norms == 0, 0.0, (x * y).sum(1) / norms)
        ok = np.isfinite(scores) & (scores >= least[b])
        kept.append((a[ok], b[ok], scores[ok]))
    return tuple(np.concatenate(c) for c in zip(*kept, strict=True))


def _best(found: list[pa.Table], k: int, order: list[str]) -> pa.Table:
    """The k best of each query among the rows of found (query, score, order)."""
    table = pa.concat_tables(found)
    table = table.take(pc.sort_indices(table, [("query", "ascending"), ("score", "descending"), *((f"o{i}", "ascending") for i in range(len(order)))]))
    query = table.column("query").to_numpy()
    heads = np.flatnonzero(np.append(True, np.diff(query) != 0)) if len(query) else np.empty(0, np.int64)
    nth = np.arange(len(query)) - np.repeat(heads, np.diff(np.append(heads, len(query))))
    return table.filter(pa.array(nth < k))


def _kept(kept: pa.Table | None, found: list[pa.Table], k: int, order: list[str], floor: np.ndarray) -> pa.Table:
    """The k best of each query among those kept and found; floor becomes the k-th best score of queries that have k."""
    best = _best(found if kept is None else [kept, *found], k, order).combine_chunks()
    query, score = best.column("query").to_numpy(), best.column("score").to_numpy()
    full = np.bincount(query, minlength=len(floor)) >= k
    least = np.full(len(floor), np.inf)
    np.minimum.at(least, query, score)
    floor[full] = least[full]
    return best


def top_k_each(index: DataFrame, queries: DataFrame, k: int, order: str | list[str]) -> DataFrame:
    """(query_id, order, score, rank): as top_k for each row of queries (query_id, query).

    Blocks of queries, bounded by QUERY_BYTES, go to all tasks; there each Arrow batch of the index is
    multiplied with them at once, and a task gives k rows a query. The query's best are ranked from these. What
    a task has chosen is cut to k rows a query whenever it comes to SCORES rows, and later rows must reach the k-th of these.
    """
    order = [order] if isinstance(order, str) else order
    known = queries.select("query_id", F.col("query").cast("array<double>").alias("query")).where("query is not null")
    row = known.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("query")).alias("size")).first()
    blocks = max(1, -(-(row["n"] * 8 * (row["size"] or 1)) // QUERY_BYTES))
    kinds = dict(index.dtypes)
    keys = ", ".join(f"o{i} {kinds[c]}" for i, c in enumerate(order))
    rows = index.select(F.col("embedding").cast("array<double>").alias("v"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    names = ["query", "score", *(f"o{i}" for i in range(len(order)))]
    out = []
    for block in range(blocks):
        held = known.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).toArrow()  # some QUERY_BYTES
        whole = [(at, m) for at, m in _lengths(held.column("query").combine_chunks()) if m.shape[1]]
        parts = [(at[a : a + ASKED], m[a : a + ASKED], _unit(m[a : a + ASKED])) for at, m in whole for a in range(0, len(at), ASKED)]
        ids = held.select(["query_id"])

        def run(batches, parts=parts, n=held.num_rows):
            kept, held = None, 0
            found: list[pa.Table] = []
            step = max(1, SCORES // max([1, *(len(at) for at, *_ in parts)]))
            floor = np.full(n, -np.inf)  # of each query, the k-th best score so far; ties may still win by order
            for batch in batches:
                for at in range(0, batch.num_rows, step):
                    piece = batch.slice(at, step)
                    for places, vectors in _lengths(piece.column(0)):
                        for query, wanted, units in parts:
                            least = floor[query]
                            if np.isneginf(least).any() and len(vectors) > k:
                                # queries that don't know k rows yet: the k-th of this piece bounds theirs
                                scores = _cosines(vectors, wanted)
                                scores = np.where(np.isfinite(scores), scores, -np.inf)
                                least = np.maximum(least, np.partition(scores, -k, axis=0)[-k] - 1e-12)
                            i, j, scores = _at_least(vectors, wanted, units, least)
                            chosen = [piece.column(c).take(pa.array(places[i])) for c in range(1, piece.num_columns)]
                            found.append(pa.table([pa.array(query[j]), pa.array(scores), *chosen], names))
                            held += len(i)
                    # the first rows give each query a floor, so that few pairs reach it later
                    if held > min(SCORES, 4 * k * n) or kept is None and held >= k * n:
                        kept, held, found = _kept(kept, found, k, order, floor), 0, []
            if found:
                kept = _kept(kept, found, k, order, floor)
            if kept is not None:
                yield from kept.combine_chunks().to_batches()

        if k > 0 and parts:
            near = rows.mapInArrow(run, f"query long, score double, {keys}")
            rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), *names[2:]))
            near = near.withColumn("rank", rank).where(F.col("rank") <= k)
            numbers = known.sparkSession.createDataFrame(ids.append_column("query", pa.array(np.arange(held.num_rows))))
            out.append(near.join(F.broadcast(numbers), "query"))  # as many rows as the block has queries
    if not out:
        return queries.sparkSession.createDataFrame([], f"query_id {dict(queries.dtypes)['query_id']}, {', '.join(f'{c} {kinds[c]}' for c in order)}, score double, rank int")
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole.select("query_id", *[F.col(f"o{i}").alias(c) for i, c in enumerate(order)], "score", "rank")


def section_similarity(turns: DataFrame, memory: list[str]) -> DataFrame:
    """(section_idx, score): a section's i-th token against the memory's i-th, summed until either ends."""
    order = Window.partitionBy("section_idx").orderBy("turn_idx")
    sized = turns.withColumn("tokens", T.tokenize(F.col("text"))).withColumn("__n", F.size("tokens"))
    before = F.coalesce(F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tokens = sized.withColumn("__before", before).where(F.col("__before") < len(memory)).select("section_idx", "__before", F.posexplode("tokens").alias("p", "token"))
    said = F.array(*[F.lit(m) for m in memory]) if memory else F.array().cast("array<string>")
    other = F.get(said, F.col("__before") + F.col("p"))
    scores = tokens.where(other.isNotNull()).groupBy("section_idx").agg(F.sum(T.string_similarity(F.col("token"), other)).cast("long").alias("score"))
    return turns.select("section_idx").distinct().join(scores, "section_idx", "left").withColumn("score", F.coalesce("score", F.lit(0).cast("long")))


def best_section(turns: DataFrame, memory: list[str]) -> DataFrame:
    """The first section of the highest similarity."""
    return section_similarity(turns, memory).orderBy(F.desc("score"), "section_idx").limit(1)


def teacher_reply(turns: DataFrame, memory: list[str], turn_vectors: DataFrame, query: Column) -> DataFrame:
    """The turn after the one nearest to query in the best section; no row if that turn is its last.

    turn_vectors (section_idx, turn_idx, embedding) of turns with tokens.
    """
    section = best_section(turns, memory).select("section_idx")
    order = Window.partitionBy("section_idx").orderBy("turn_idx")
    own = turns.join(F.broadcast(section), "section_idx", "left_semi")
    following = own.withColumn("next_text", F.lead("text").over(order)).where(F.size(T.tokenize(F.col("text"))) > 0)
    scored = following.join(turn_vectors, ["section_idx", "turn_idx"]).withColumn("score", cosine(query, F.col("embedding")))
    return scored.orderBy(F.desc("score"), "turn_idx").limit(1).where("next_text is not null").select("section_idx", "turn_idx", "score", "next_text")
