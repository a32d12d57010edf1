"""Duplicate removal against a reference set: anti-joins on equal text and on similarity."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from ..registry import dedup
from ..sources.shared import written

#: Rows of vectors in a block at most, in one that is made for more tasks at least, and on a side of a tile.
ROWS, BLOCK, TILE = 1 << 15, 2048, 512
#: Slots of the table that orders words; words of a reference that go to all tasks; blocks of sets by size, and the words of the largest; rows in memory while two blocks are compared.
SLOTS, SMALL_WORDS, BLOCKS, BLOCK_WORDS, TUPLES = 1 << 20, 1 << 21, 16, 1 << 25, 1 << 22


def exact_match(source: DataFrame, reference: DataFrame, text: str = "text", reference_text: str | None = None) -> DataFrame:
    """Rows of ``source`` whose text isn't in ``reference``: an anti-join on a digest. Equal rows within the source all stay; a null text is never equal."""
    ref = reference.select(F.sha2(F.col(reference_text or text), 256).alias("_digest")).where("_digest is not null")
    return source.withColumn("_digest", F.sha2(F.col(text), 256)).join(ref, "_digest", "left_anti").drop("_digest")


def _cells(source: DataFrame, reference: DataFrame | None, key: str, vector: str, rows: int, compare: Callable[[_Side, _Side, bool], dict], schema: str) -> DataFrame:
    """What ``compare`` gives for each two blocks of at most about ``rows`` rows, by hash of key: a side of each, and whether they are one block.

    Without a reference the source is its own, and two blocks meet once. A row is sent once for each block
    that its own meets; a task holds two blocks, and scores them tile by tile.
    """
    own = reference is None
    many = source.sparkSession.sparkContext.defaultParallelism

    def number(df: DataFrame) -> int:
        n = df.where(F.col(vector).isNotNull()).count()
        # some cells for each core, unless blocks would be less than a few tiles
        return max(1, -(-n // rows), min(int((4 * many) ** 0.5) + 1, n // BLOCK))

    def side(df: DataFrame, k: int, blocks: int, cells: Callable[[Column], Column]) -> DataFrame:
        kind = df.schema[vector].dataType.elementType.simpleString()
        v = F.col(vector) if kind == "float" else F.transform(vector, lambda x: x.cast("double"))
        made = df.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), v.alias("v"), F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block"))
        return made.select(F.explode(cells(F.col("block"))).alias("cell"), F.lit(k).alias("side"), "block", "id", "v")

    m = number(source)
    n = m if own else number(reference)
    if own:
        sent = side(source, 0, m, lambda b: F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda c: F.least(b, c) * m + F.greatest(b, c)))
    else:
        sent = side(source, 0, m, lambda b: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda c: b * n + c))
        other = side(reference, 1, n, lambda b: F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda c: c * n + b))
        sent = sent.withColumn("v", F.col("v").cast("array<double>")).union(other.withColumn("v", F.col("v").cast("array<double>")))

    def run(cell: pa.Table) -> pa.Table:
        i, j = divmod(cell.column("cell")[0].as_py(), n)
        block, which = cell.column("block").to_numpy(), cell.column("side").to_numpy()
        x = _Side(cell, np.flatnonzero(block == i) if own else np.flatnonzero(which == 0))
        y = x if own and i == j else _Side(cell, np.flatnonzero(block == j) if own else np.flatnonzero(which == 1))
        if not len(x.ids) or not len(y.ids):
            return pa.table({k: pa.array([], t) for k, t in types.items()})
        return pa.table({k: pa.array(v, types[k]) for k, v in compare(x, y, x is y).items()})

    types = {name: {"long": pa.int64(), "double": pa.float64()}[kind] for name, kind in (one.split() for one in schema.split(", "))}
    # a number given isn't made less: a cell of few bytes has much to compare
    return sent.repartition(max(1, min(m * (m + 1) // 2 if own else m * n, 4096)), "cell").groupBy("cell").applyInArrow(run, schema)


class _Side:
    """Ids and vectors of a block's rows, by id."""

    def __init__(self, cell: pa.Table, rows: np.ndarray) -> None:
        ids = cell.column("id").to_numpy()[rows]
        order = np.argsort(ids, kind="stable")
        self.ids, rows = ids[order], rows[order]
        v = cell.column("v").combine_chunks()
        width = len(v[0]) if len(v) else 0
        if len(v) * width != len(v.flatten()):
            raise ValueError("vectors of several lengths")
        self.vectors = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), width)[rows].astype(np.float64)

    def usable(self, measure: str) -> tuple[np.ndarray, np.ndarray]:
        """Places of rows that have scores, and their vectors, of length 1 for cosines."""
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            norm = np.linalg.norm(self.vectors, axis=1)
            at = np.flatnonzero(np.isfinite(norm) & ((norm > 0) | (measure == "l2")))
            return at, self.vectors[at] if measure == "l2" else self.vectors[at] / norm[at, None]


def _tiles(x: np.ndarray, y: np.ndarray, ids: np.ndarray, others: np.ndarray, one: bool, measure: str) -> Iterator[tuple[slice, slice, np.ndarray, np.ndarray | None]]:
    """(rows, columns, scores, which are of one id) of tiles that stay in a core's cache, in order; of one block only those on and above the diagonal. Cosines, or squares of distances."""
    if measure == "l2":
        middle = y.mean(0)  # far from the origin squares would cancel
        x, y = x - middle, y - middle
        u = np.c_[-2 * x, (x * x).sum(1), np.ones(len(x))]
        v = np.c_[y, np.ones(len(y)), (y * y).sum(1)]
    else:
        u, v = x, y
    repeated = one and len(np.unique(ids)) < len(ids)
    held = np.empty(TILE * TILE)
    for r in range(0, len(u), TILE):
        for c in range(r if one else 0, len(v), TILE):
            rows, columns = slice(r, min(r + TILE, len(u))), slice(c, min(c + TILE, len(v)))
            m, n = rows.stop - r, columns.stop - c
            s = np.matmul(u[rows], v[columns].T, out=held[: m * n].reshape(m, n))
            yield rows, columns, s, ids[rows, None] == others[columns] if one and (r == c or repeated) else None


def _no_scores(s: np.ndarray, same: np.ndarray | None, none: float) -> np.ndarray:
    if same is not None:
        s[same] = none
    return s


def best_scores(source: DataFrame, reference: DataFrame | None = None, key: str = "id", vector: str = "embedding", measure: str = "cosine", rows: int = ROWS) -> DataFrame:
    """(id, best): each row's best score, the greatest cosine or the least distance, its own left out; null where it has none. Every pair is scored; the score matrix is never kept."""
    own, worst = reference is None, np.inf if measure == "l2" else -np.inf

    def compare(x: _Side, y: _Side, one: bool) -> dict:
        (i, u), (j, v) = x.usable(measure), y.usable(measure)
        best, other = (np.full(len(i), worst), np.full(len(j), worst))
        if one:
            other = best
        near, back = np.zeros(len(i), np.int64), np.zeros(len(j), np.int64)
        if one:
            back = near
        for r, c, s, same in _tiles(u, v, x.ids[i], y.ids[j], one, measure):
            s = _no_scores(s, same, worst)
            if measure == "l2":
                _least(s, best, near, r, c)
                if own and not (one and r == c):
                    _least(s.T, other, back, c, r)
            else:
                np.maximum(best[r], s.max(1), out=best[r])
                if own and not (one and r == c):
                    np.maximum(other[c], s.max(0), out=other[c])
        sides = [(x, i, u, best, v, near)] + [(y, j, v, other, u, back)] * (own and not one)
        ids, scores = [], []
        for side, at, w, score, partners, of in sides:
            whole = np.full(len(side.ids), worst)
            # squares of distances cancel: the distance to the nearest is taken anew
            whole[at] = np.where(np.isfinite(score), np.sqrt(((w - partners[of]) ** 2).sum(1)), worst) if measure == "l2" and len(partners) else score
            ids.append(side.ids)
            scores.append(whole)
        return {"id": np.concatenate(ids), "best": np.concatenate(scores)}

    pick = F.min if measure == "l2" else F.max
    got = _cells(source, reference, key, vector, rows, compare, "id long, best double").groupBy("id").agg(pick("best").alias("best"))
    return got.select("id", F.when(F.abs("best") < float("inf"), F.col("best")).alias("best"))


def _least(s: np.ndarray, best: np.ndarray, near: np.ndarray, rows: slice, columns: slice) -> None:
    """Takes each row's least of a tile, and its column, where less than before."""
    least = s.min(1)
    less = np.flatnonzero(least < best[rows])
    best[rows][less] = least[less]
    near[rows][less] = columns.start + s[less].argmin(1)


def score_moments(source: DataFrame, reference: DataFrame | None = None, key: str = "id", vector: str = "embedding", rows: int = ROWS) -> DataFrame:
    """(n, total, squares, high, low), one row: number, sum, sum of squares, greatest and least of the cosines of all pairs. Those of a row with itself count as 0; zero vectors have none.

    Sums need no pairs: they are those of the sum of all unit vectors and of their products by component.
    """
    own = reference is None

    def extremes(x: _Side, y: _Side, one: bool) -> dict:
        (i, u), (j, v) = x.usable("cosine"), y.usable("cosine")
        high, low, total, squares = -np.inf, np.inf, 0.0, 0.0
        for r, c, s, same in _tiles(u, v, x.ids[i], y.ids[j], one, "cosine"):
            if same is not None:
                times = 1 if r == c else 2  # of two tiles on both sides of the diagonal one is seen
                total, squares = total + times * s[same].sum(), squares + times * (s[same] ** 2).sum()
            s = _no_scores(s, same, 0.0)
            high, low = max(high, s.max()), min(low, s.min())
        return {"high": [max(high, 0.0) if one else high], "low": [min(low, 0.0) if one else low], "total": [total], "squares": [squares]}

    def moments(df: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, gram = 0, None
            for batch in batches:
                side = _Side(pa.table({"id": np.zeros(len(batch), np.int64), "v": batch.column(0)}), np.arange(len(batch)))
                n += len(side.ids)
                u = side.usable("cosine")[1]
                u = np.c_[u, np.ones(len(u))]
                gram = u.T @ u if gram is None else gram + u.T @ u
            if gram is not None:
                gram[-1, -1] = n  # of all rows, zero vectors too
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(gram.size)), pa.array(np.repeat(np.arange(len(gram)) == len(gram) - 1, len(gram)).astype(np.int64)), pa.array(np.tile(np.arange(len(gram)) == len(gram) - 1, len(gram)).astype(np.int64)), pa.array(gram.ravel())], ["at", "i", "j", "x"])

        v = df.where(F.col(vector).isNotNull()).select(F.transform(vector, lambda x: x.cast("double")).alias("v"))
        return v.mapInArrow(run, "at long, i long, j long, x double").groupBy("at", "i", "j").agg(F.sum("x").alias("x"))

    a = moments(source)
    b = a.select("at", F.col("x").alias("y")) if own else moments(reference).select("at", F.col("x").alias("y"))
    product = F.col("x") * F.col("y")
    sums = a.join(b, "at").agg(F.sum(F.when((F.col("i") == 1) & (F.col("j") == 1), product)).alias("n"), F.sum(F.when((F.col("i") == 1) & (F.col("j") == 0), product)).alias("total"), F.sum(F.when((F.col("i") == 0) & (F.col("j") == 0), product)).alias("squares"))
    seen = _cells(source, reference, key, vector, rows, extremes, "high double, low double, total double, squares double")
    seen = seen.agg(F.max("high").alias("high"), F.min("low").alias("low"), F.coalesce(F.sum("total"), F.lit(0.0)).alias("t"), F.coalesce(F.sum("squares"), F.lit(0.0)).alias("q"))
    some = lambda c: F.when(F.abs(c) < float("inf"), F.col(c)).alias(c)
    return sums.crossJoin(seen).select("n", (F.col("total") - F.col("t")).alias("total"), (F.col("squares") - F.col("q")).alias("squares"), some("high"), some("low"))


def embedding_similarity(source: DataFrame, reference: DataFrame | None = None, threshold: float = 0.9, key: str = "id", vector: str = "embedding", measure: str = "cosine", keep: str = "none") -> DataFrame:
    """Rows of ``source`` without a reference row of a score above ``threshold`` (a distance below it).

    Within one set both rows of a similar pair go; ``keep="first"`` keeps a row if no similar one has a
    lesser id. A zero or null vector is like none, so it stays.
    """
    hit = (F.col("best") < threshold) if measure == "l2" else (F.col("best") > threshold)
    if keep == "first" and reference is None:
        return source.join(_later(source, threshold, key, vector, measure), key, "left_anti")
    gone = best_scores(source, reference, key, vector, measure).where(hit).select(F.col("id").alias(key))
    return source.join(gone, key, "left_anti")


def _later(df: DataFrame, threshold: float, key: str, vector: str, measure: str, rows: int = ROWS) -> DataFrame:
    def compare(x: _Side, y: _Side, one: bool) -> dict:
        (i, u), (j, v) = x.usable(measure), y.usable(measure)
        gone, back = np.zeros(len(i), bool), np.zeros(len(j), bool)
        if one:
            back = gone
        a, b = x.ids[i], y.ids[j]
        for r, c, s, _ in _tiles(u, v, a, b, one, measure):
            m, n = np.nonzero(s < threshold * abs(threshold) if measure == "l2" else s > threshold)
            m, n = m + r.start, n + c.start
            gone[m[b[n] < a[m]]] = True
            back[n[a[m] < b[n]]] = True
        return {"id": a[gone] if one else np.concatenate([a[gone], b[back]])}

    return _cells(df, None, key, vector, rows, compare, "id long").distinct().withColumnRenamed("id", key)


def tokens(text):
    """Distinct lower-cased words of a text column."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))


def jaccard_similarity(source: DataFrame, reference: DataFrame | None = None, threshold: float = 0.8, key: str = "id", text: str = "text") -> DataFrame:
    """Rows of ``source`` without a reference row of a Jaccard similarity of words above ``threshold``; within one set both rows go.

    Rows of equal words are one in the comparison, so thousands of copies cost no more than one. With a
    reference of few words each row is compared with all of it where the row lies.
    """
    own = reference is None
    if not own:
        y, _ = _word_sets(reference, key, text)
        if y.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] <= SMALL_WORDS:
            gone = _similar_to_few(source.select(key, _words(text).alias("w")), key, y, threshold)
            return source.join(gone, key, "left_anti")
    x, rows = _word_sets(source, key, text)
    near = _similar_sets(x, x if own else y, threshold, own)
    gone = near.select(F.col("a").alias("set"))
    if own:
        gone = gone.union(near.select("b"))
        gone = gone.union(x.where("n > 1").select("set")) if threshold < 1 else gone
    return source.join(rows.join(gone.distinct(), "set", "left_semi").select(F.col("i").alias(key)), key, "left_anti")


def _words(text: str):
    # sets of numbers compare several times as fast as sets of strings
    return F.array_sort(F.array_distinct(F.transform(tokens(F.col(text)), lambda w: F.xxhash64(w))))


def _word_sets(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(set, w, size, n): each set of words of ``df`` once, as 64-bit hashes, with a number and the number of its rows; and the rows (i, set). Written, for both are read several times."""
    rows = df.select(F.col(key).alias("i"), _words(text).alias("w")).where(F.size("w") > 0)
    rows = written(rows.select("i", F.unhex(F.md5(F.to_json("w"))).alias("digest"), "w"), "words")
    sets = rows.groupBy("digest").agg(F.first("w").alias("w"), F.count(F.lit(1)).alias("n"))
    sets = written(sets.select(F.monotonically_increasing_id().alias("set"), "digest", "w", F.size("w").alias("size"), "n"), "sets")
    return sets.drop("digest"), rows.select("i", "digest").join(sets.select("digest", "set"), "digest").select("i", "set")


def _similar_to_few(rows: DataFrame, key: str, few: DataFrame, threshold: float) -> DataFrame:
    """Keys of rows (key, w) above ``threshold`` with any of few sets, which go to all tasks: words in common are counted, exactly and without a shuffle."""
    sets = few.select("w").toArrow().column("w").combine_chunks()
    size = np.diff(sets.offsets.to_numpy())
    words, owner = sets.flatten().to_numpy(), np.repeat(np.arange(len(size)), size)
    order = np.argsort(words, kind="stable")
    shared = rows.sparkSession.sparkContext.broadcast((words[order], owner[order].astype(np.int32), size))
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, owner, size = shared.value
        for batch in batches:
            w = batch.column(1)
            hit = np.zeros(len(w), bool)
            offsets, flat = w.offsets.to_numpy(), w.values.to_numpy()
            null = w.is_null().to_numpy(zero_copy_only=False)
            for k in range(len(w) if len(size) else 0):
                own = flat[offsets[k] : offsets[k + 1]]
                if null[k] or not len(own):
                    continue
                lo = np.searchsorted(words, own)
                n = np.searchsorted(words, own, "right") - lo
                at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
                common = np.bincount(owner[at], minlength=len(size))
                hit[k] = (common / (len(own) + size - common)).max() > threshold
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(hit))], [key])

    return rows.select(key, "w").mapInArrow(run, f"`{key}` {kind}")


def _similar_sets(x: DataFrame, y: DataFrame, threshold: float, own: bool) -> DataFrame:
    """(a, b, similarity) of different sets above ``threshold``, exactly; each pair once within one set.

    Words are ordered from rare to frequent, by counts in a hashed table: any one order gives all pairs. Two
    sets that similar share one of their first few words (:func:`_first`). Sets lie in blocks by size; each
    two blocks whose sizes allow a pair meet in one task, which joins first words in memory and rules out
    pairs by size, by what is left of both behind a shared word, and by a sketch: the parity of the words in
    each of some bits, which differs at most where the sets do. Only pairs that pass all of that are rows.
    A set goes to a bounded number of tasks with its first words and sketch, not with its words, until blocks
    have grown to BLOCK_WORDS.
    """
    if threshold >= 1:
        return x.select(F.col("set").alias("a"), F.col("set").alias("b"), F.lit(1.0).alias("similarity")).limit(0)
    spark = x.sparkSession
    both = x.select("set", "w", "size", F.lit(1).alias("side"))
    if not own:
        both = both.union(y.select("set", "w", "size", F.lit(0)))
    slots = both.select(F.explode("w").alias("word")).groupBy(F.pmod("word", F.lit(SLOTS)).cast("int").alias("slot")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    table = np.zeros(SLOTS, np.int64)
    table[slots.column("slot").to_numpy()] = slots.column("n").to_numpy()
    table = spark.sparkContext.broadcast(np.minimum(table, 2**31 - 1).astype(np.int32))
    bounds, splits, lows, highs = _size_blocks(both.groupBy("size").agg(F.count(F.lit(1)).alias("n")).orderBy("size").toArrow(), threshold)
    meet = [[j for j in range(len(lows)) if (highs[i] >= threshold * lows[j] and highs[j] >= threshold * lows[i])] for i in range(len(lows))]
    first_block, blocks = np.r_[0, np.cumsum(splits)], len(lows)
    # a cell is a block of those looked up and one of those that ask
    at = lambda b, c, side: (min(b, c) * blocks + max(b, c)) if own else c * blocks + b if side else b * blocks + c
    cells_of = pa.array([[at(b, c, side) for c in meet[b]] for side in (0, 1) for b in range(blocks)], pa.list_(pa.int32()))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                w = part.column(1)
                size, flat = np.diff(w.offsets.to_numpy()).astype(np.int64), w.flatten().to_numpy()
                own_set = np.repeat(np.arange(len(size)), size)
                order = np.lexsort((flat, table.value[flat % SLOTS], own_set))
                rank = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
                first = rank < np.repeat(_first(size, threshold), size)
                words = (flat[order][first].view(np.uint64) >> np.uint64(32)).astype(np.uint32)
                ends = np.r_[0, np.cumsum(np.bincount(own_set[first], minlength=len(size)))].astype(np.int32)
                k = np.searchsorted(bounds, size, "right") - 1
                set_ = part.column(0).to_numpy()
                block = first_block[k] + set_ % splits[k]
                bits = _sketch_bits(size)
                base = np.cumsum(bits) - bits
                odd = np.bincount(np.repeat(base, size) + (flat & (np.repeat(bits, size) - 1)), minlength=int(bits.sum())) & 1
                packed = np.packbits(odd.astype(np.uint8), bitorder="little")
                sketch = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.r_[base, bits.sum()].astype(np.int32) // 8), pa.py_buffer(packed)])
                first_words = pa.ListArray.from_arrays(pa.array(ends), pa.array(words.view(np.int32)))
                cells = cells_of.take(pa.array(block + part.column(3).to_numpy() * blocks))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size.astype(np.int32)), part.column(3), pa.array(block.astype(np.int32)), first_words, sketch, cells], ["set", "size", "side", "block", "first", "sketch", "cells"])

    sent = both.mapInArrow(features, "set long, size int, side int, block int, first array<int>, sketch binary, cells array<int>")
    sent = sent.select(F.explode("cells").alias("cell"), "set", "size", "side", "block", "first", "sketch")

    def compare(cell: pa.Table) -> pa.Table:
        found = _compare(cell, blocks, threshold, own)
        return pa.table({"a": found[0], "b": found[1]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    # a number given isn't made less: a cell of few bytes may have much to compare
    tasks = max(1, min(sum(map(len, meet)), 4096))
    near = sent.repartition(tasks, "cell").groupBy("cell").applyInArrow(compare, "a long, b long")
    pairs = written(near, "near")
    pairs = pairs.join(x.select(F.col("set").alias("a"), F.col("w").alias("wa")), "a").join(y.select(F.col("set").alias("b"), F.col("w").alias("wb")), "b")
    common = F.size(F.array_intersect("wa", "wb"))
    return pairs.select("a", "b", (common / (F.size("wa") + F.size("wb") - common)).alias("similarity")).where(F.col("similarity") > threshold)


def _first(size: np.ndarray, threshold: float) -> np.ndarray:
    """How many of a set's words, in order, must be looked at: a partner shares ``size * threshold`` of them, so not all of these are missed."""
    return np.clip(size - np.ceil(size * threshold - 1e-6).astype(np.int64) + 1, 1, size)


def _sketch_bits(size: np.ndarray) -> np.ndarray:
    """Bits of a set's sketch: a power of two of about twice its size."""
    return 2 ** np.clip(np.ceil(np.log2(np.maximum(size, 1) * 2)), 6, 16).astype(np.int64)


def _size_blocks(sizes: pa.Table, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of about equal numbers of words, by size: least sizes of ranges, blocks of each range, and each block's least and greatest size. A size of very many sets has several blocks."""
    size, n = sizes.column("size").to_numpy().astype(np.int64), sizes.column("n").to_numpy()
    if not len(size):
        size, n = np.array([1]), np.array([1])
    most = min(BLOCK_WORDS, max(1 << 16, -(-int((size * n).sum()) // BLOCKS)))
    bounds, splits, lows, highs, held = [], [], [], [], 0
    for s, k in zip(size.tolist(), (size * n).tolist()):
        if bounds and held + k <= most:
            held += k
            highs[-1] = s
            continue
        held = k
        bounds.append(s)
        splits.append(max(1, -(-k // most)))
        held = held if splits[-1] == 1 else most
        lows += [s] * splits[-1]
        highs += [s] * splits[-1]
    return np.array(bounds), np.array(splits), np.array(lows), np.array(highs)


def _compare(cell: pa.Table, blocks: int, threshold: float, own: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sets (a, b) of two blocks that may be above ``threshold``: all that are, and few others."""
    i, j = divmod(cell.column("cell")[0].as_py(), blocks)
    block, side = cell.column("block").to_numpy(), cell.column("side").to_numpy()
    size = cell.column("size").to_numpy().astype(np.int64)
    by_size = np.lexsort((cell.column("set").to_numpy(), size))
    # within one set the smaller partner is looked up, and shares more of its words: fewer of its first words do
    if own:
        known, asked = by_size[block[by_size] == i], by_size[block[by_size] == j]
    else:
        known, asked = by_size[side[by_size] == 0], by_size[side[by_size] == 1]
    least = 2 * threshold / (1 + threshold) if own else threshold
    nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(known) or not len(asked):
        return nothing
    kw, ks, kp = _flat(cell, known, _first(size[known], least))
    aw, as_, ap = _flat(cell, asked, _first(size[asked], threshold))
    k_size, a_size = size[known], size[asked]
    order = np.argsort(kw.astype(np.uint64) << np.uint64(32) | ks.astype(np.uint64))
    kw, ks, kp = kw[order], ks[order], kp[order]
    keys = kw.astype(np.uint64) << np.uint64(32) | ks.astype(np.uint64)
    low = np.searchsorted(k_size, np.ceil(a_size * threshold - 1e-6))
    high = np.arange(len(asked)) if own and i == j else np.searchsorted(k_size, np.floor(a_size / max(threshold, 1e-9) + 1e-6), "right")
    high = np.maximum(high, low)
    word = aw.astype(np.uint64) << np.uint64(32)
    lo = np.searchsorted(keys, word | low[as_].astype(np.uint64))
    n = np.maximum(np.searchsorted(keys, word | high[as_].astype(np.uint64)) - lo, 0)
    # as many sets at a time as have some millions of words in common
    ends = np.r_[0, np.cumsum(np.bincount(as_, weights=n, minlength=len(asked)))]
    starts = np.r_[0, np.cumsum(np.bincount(as_, minlength=len(asked)))].astype(np.int64)
    sketches = _sketches(cell, asked, a_size), _sketches(cell, known, k_size)
    set_ = cell.column("set").to_numpy()
    out: list[tuple[np.ndarray, np.ndarray]] = [nothing]
    at = 0
    while at < len(asked):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + TUPLES, "right")) - 1)
        span = slice(starts[at], starts[to])
        m = n[span]
        hit = np.repeat(lo[span] - np.cumsum(m) + m, m) + np.arange(m.sum())
        x, px = np.repeat(as_[span], m), np.repeat(ap[span], m)
        y, py = ks[hit], kp[hit]
        at = to
        need = (a_size[x] + k_size[y]) * (threshold / (1 + threshold)) - 1e-6
        # of the first word that two sets share, nothing before it is shared
        ok = np.minimum(a_size[x] - px, k_size[y] - py) >= need
        pair = np.unique(x[ok].astype(np.int64) << 32 | y[ok].astype(np.int64))
        x, y = pair >> 32, pair & 0xFFFFFFFF
        total = a_size[x] + k_size[y]
        most = total - 2 * np.ceil(total * (threshold / (1 + threshold)) - 1e-6)
        ok = _alike(*sketches, x, y, most)
        out.append((set_[asked[x[ok]]], set_[known[y[ok]]]))
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def _flat(cell: pa.Table, rows: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, number of its row, place) of the first ``most`` words of each row."""
    first = cell.column("first").combine_chunks()
    offsets, flat = first.offsets.to_numpy().astype(np.int64), first.values.to_numpy().view(np.uint32)
    n = np.minimum(most, offsets[rows + 1] - offsets[rows])
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return flat[np.repeat(offsets[rows], n) + place], np.repeat(np.arange(len(rows)), n), place


def _sketches(cell: pa.Table, rows: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows' sketches: 64-bit words of each, where each begins, and all of them."""
    column = cell.column("sketch").combine_chunks()
    begins = np.frombuffer(column.buffers()[1], np.int32)[column.offset :][rows].astype(np.int64) // 8
    return _sketch_bits(size) // 64, begins, np.frombuffer(column.buffers()[2], np.uint8, column.buffers()[2].size // 8 * 8).view(np.uint64)


def _alike(a: tuple, b: tuple, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Which pairs' sketches differ in at most so many bits; the longer of two folds to the shorter by exclusive or."""
    ok = np.zeros(len(x), bool)
    kinds = a[0][x] << 32 | b[0][y]
    for kind in np.unique(kinds).tolist():
        m, n = kind >> 32, kind & 0xFFFFFFFF
        short = min(m, n)
        own = np.flatnonzero(kinds == kind)
        # some millions of words of sketches at a time
        for at in range(0, len(own), step := max(1, TUPLES // max(m, n))):
            some = own[at : at + step]
            u = a[2][a[1][x[some], None] + np.arange(m)].reshape(len(some), -1, short)
            v = b[2][b[1][y[some], None] + np.arange(n)].reshape(len(some), -1, short)
            ok[some] = np.bitwise_count(np.bitwise_xor.reduce(u, 1) ^ np.bitwise_xor.reduce(v, 1)).sum(1) <= most[some]
    return ok


def jaccard_pairs(source: DataFrame, reference: DataFrame | None = None, threshold: float = 0.8, key: str = "id", text: str = "text") -> DataFrame:
    """(a, b, similarity) above ``threshold``, exactly, every pair of rows both ways round; see :func:`jaccard_similarity` for which rows have one."""
    own = reference is None
    x, left = _word_sets(source, key, text)
    y, right = (x, left) if own else _word_sets(reference, key, text)
    found = _similar_sets(x, y, threshold, own)
    if own:
        found = found.union(found.select("b", "a", "similarity"))
        if threshold < 1:
            found = found.union(x.where("n > 1").select("set", "set", F.lit(1.0)))
    rows = found.join(left.select(F.col("set").alias("a"), F.col("i")), "a").join(right.select(F.col("set").alias("b"), F.col("i").alias("j")), "b")
    rows = rows.select(F.col("i").alias("a"), F.col("j").alias("b"), "similarity")
    return rows.where("a <> b") if own else rows


def nearest(source: DataFrame, reference: DataFrame | None = None, k: int = 1, key: str = "id", vector: str = "embedding", rows: int = ROWS) -> DataFrame:
    """(id, other, score, rank): each row's ``k`` nearest by cosine, exactly; of scores equal to 9 places the least id."""
    own = reference is None

    def compare(x: _Side, y: _Side, one: bool) -> dict:
        (i, u), (j, v) = x.usable("cosine"), y.usable("cosine")
        a, b = x.ids[i], y.ids[j]
        tops = _Top(len(a), k), None if one else _Top(len(b), k)
        for r, c, s, same in _tiles(u, v, a, b, one, "cosine"):
            s = _no_scores(s, same, -np.inf)
            tops[0].take(s, r, b[c])
            if own and not (one and r == c):
                tops[0 if one else 1].take(s.T, c, a[r])
        sides = [(a, tops[0])] + [(b, tops[1])] * (own and not one)
        got = [(np.repeat(ids, k), t.other.ravel(), t.score.ravel(), t.whole.ravel()) for ids, t in sides]
        ids, other, score, whole = (np.concatenate([g[n] for g in got]) for n in range(4))
        ok = score > -np.inf
        return {"id": ids[ok], "other": other[ok], "near": score[ok], "score": whole[ok]}

    from pyspark.sql import Window

    found = _cells(source, reference, key, vector, rows, compare, "id long, other long, near double, score double")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("near"), "other"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).drop("near")


class _Top:
    """The ``k`` best partners of each row so far, best first, with scores to 9 places and whole. Tiles come by id of partner, so of equal scores those kept stay."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.score, self.whole, self.other = k, np.full((n, k), -np.inf), np.full((n, k), -np.inf), np.zeros((n, k), np.int64)

    def take(self, s: np.ndarray, rows: slice, ids: np.ndarray) -> None:
        last = self.score[rows, -1]
        if np.isinf(last).any() and s.shape[1] > self.k:
            # nothing below the tile's own k-th, but what rounds to the same
            own = s.max(1) if self.k == 1 else np.partition(s, -self.k, axis=1)[:, -self.k]
            least = np.where(np.isinf(last), own - 1.1e-9, last + 4e-10)
        else:
            least = last + 4e-10
        at, column = np.nonzero(s > least[:, None])
        if not len(at):
            return
        some = np.unique(at)
        places = rows.start + some
        row = np.r_[at, np.repeat(some, self.k)]
        whole = np.r_[s[at, column], self.whole[places].ravel()]
        score = np.r_[np.round(s[at, column], 9), self.score[places].ravel()]
        other = np.r_[ids[column], self.other[places].ravel()]
        order = np.lexsort((other, -score, row))
        row, score, whole, other = row[order], score[order], whole[order], other[order]
        begins = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        best = begins[:, None] + np.arange(self.k)
        self.score[places], self.whole[places], self.other[places] = score[best], whole[best], other[best]


for _name, _function in (("embedding_similarity", embedding_similarity), ("exact_match", exact_match), ("jaccard_similarity", jaccard_similarity)):
    dedup(_name)(_function)
