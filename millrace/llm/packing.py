"""Best-fit packing by sums of squares.

Documents fill bins of a fixed capacity. Each goes where, afterwards, the sum over all gaps of the
squared number of open bins with that gap is smallest: this keeps the bins' gaps varied, so that what
comes next tends to find one that it fills. The rule looks at counts by gap only, never at single
bins. Documents are packed in groups of at most about GROUP by a hash of doc_id, so all groups pack at
once and a group's memory is bounded at any size of corpus. There are a power of two of groups, so that
a document more changes its own group only, but where their number doubles.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from .bpe import token_count
from .staging import stage

CAPACITY = 2048
GROUP = 16384
_RUN = 256


def pack_group(lengths: Sequence[int], capacity: int) -> np.ndarray:
    """The bin of each item, in the order given; lengths are from 1 to ``capacity``.

    Ties: the smallest gap left, then an open bin before a new one, then the bin that has had its gap
    longest.
    """
    count = np.zeros(capacity + 1, np.int64)  # open bins by gap, from 1 to capacity - 1
    bins: list[deque[int]] = [deque() for _ in range(capacity + 1)]
    out = np.empty(len(lengths), np.int64)
    made = 0
    far = np.int64(1) << 60
    for i, s in enumerate(lengths):
        s = int(s)
        now = count[s : capacity + 1]
        left = count[: capacity - s + 1]
        # change of the sum: one bin fewer at gap g, one more at gap g - s
        change = np.where(now > 0, 2 * (left - now) + 2, far)
        if now[0] > 0:
            change[0] = 1 - 2 * now[0]  # filled: it has no gap left
        new = 2 * left[-1] + 1 if s < capacity else 0
        change[-1] = new  # gap `capacity`: a new bin
        k = int(change.argmin())
        gap = s + k
        if gap == capacity:
            b, made = made, made + 1
        else:
            b = bins[gap].popleft()
            count[gap] -= 1
        if k:
            bins[k].append(b)
            count[k] += 1
        out[i] = b
    return out


def words(text: Column) -> Column:
    """White-space separated words, and one for the mark between documents."""
    return F.regexp_count(text, F.lit(r"\S+")) + 1


def pack(docs: DataFrame, length: Callable[[Column], Column] = words, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """(bin_group, bin_id, doc_id, piece, start, length, gap): where each piece of each document goes, and the gap its bin has in the end.

    A document longer than ``capacity`` is cut into full pieces, each a bin of its own, and a rest
    that is packed like any other; whole texts are placed. ``length`` gives a document's length from
    its text, such as its tokens and a mark, see :func:`tokens`. Documents come in order of doc_id.

    Nulls: a null doc_id goes like any other value, before all others; a null or empty text has the
    length of no words. Ties and repeated rows are packed one by one, those of one doc_id in order of
    length. Rows of one doc_id and one length are counted before they are sent, and spread over groups in
    runs of 256, so that neither an id of very many rows nor rows without id fill one group. No rows
    give no rows. Columns other than doc_id and text aren't read.
    """
    size = length(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.greatest(size.cast("long"), F.lit(1)).alias("size"))
    # written, so that the caller's plan runs once for the count and for the bins
    rows = stage(rows.groupBy("doc_id", "size").agg(F.count(F.lit(1)).alias("n")), "lengths")
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    groups = 1
    while groups * group < total:
        groups *= 2
    # the first run of an id goes by the id alone
    rows = rows.select("doc_id", "size", "n", F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / _RUN).cast("long"))).alias("run"))
    spread = F.when((F.col("run") == 0) & F.col("doc_id").isNotNull(), F.xxhash64("doc_id")).otherwise(F.xxhash64("doc_id", "size", "run"))
    rows = rows.select(F.pmod(spread, F.lit(groups)).alias("bin_group"), "doc_id", "size", F.least(F.lit(_RUN), F.col("n") - F.col("run") * _RUN).alias("n"))

    def place(table: pa.Table) -> pa.Table:
        each = np.repeat(np.arange(len(table)), table.column("n").to_numpy())
        ids, sizes = table.column("doc_id").combine_chunks().take(pa.array(each)), table.column("size").to_numpy()[each]
        keys = ids.fill_null(-(1 << 63)).to_numpy()
        order = np.lexsort((sizes, keys))
        sizes, ids = sizes[order], ids.take(pa.array(order))
        full, rest = sizes // capacity, sizes % capacity
        some = np.flatnonzero(rest)
        of_rest = pack_group(rest[some], capacity)
        bins = int(of_rest.max()) + 1 if len(some) else 0
        doc = np.concatenate([np.repeat(np.arange(len(sizes)), full), some])
        piece = np.concatenate([np.arange(full.sum()) - np.repeat(np.cumsum(full) - full, full), full[some]])
        where = np.concatenate([bins + np.arange(full.sum()), of_rest])
        length_ = np.concatenate([np.full(full.sum(), capacity), rest[some]])
        used = np.bincount(where, length_, bins + int(full.sum())).astype(np.int64)
        back = np.lexsort((piece, doc))
        doc, piece, where, length_ = doc[back], piece[back], where[back], length_[back]
        return pa.table({"bin_group": pa.array(np.full(len(doc), table.column("bin_group")[0].as_py()), pa.int64()), "bin_id": pa.array(where, pa.int64()), "doc_id": ids.take(pa.array(doc)), "piece": pa.array(piece, pa.int64()), "start": pa.array(piece * capacity, pa.int64()), "length": pa.array(length_, pa.int64()), "gap": pa.array(capacity - used[where], pa.int64())})

    return rows.groupBy("bin_group").applyInArrow(place, "bin_group long, bin_id long, doc_id long, piece long, start long, length long, gap long")


def tokens(spark: SparkSession) -> Callable[[Column], Column]:
    """A length for :func:`pack`: the ids that ``bpe.encode`` gives, and one for the mark between documents."""
    count = token_count(spark)
    return lambda text: count(text) + 1


def op7(spark, sf_dir: str) -> DataFrame:
    """Bins of token ids for all documents."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokens(spark))


QUERIES: dict[str, Callable] = {"op7_packing": op7}
SQL: dict[str, str] = {}
