"""BPE encoding through a table of distinct words, and decoding through a table of pieces.

Texts are split into words (pre-tokens) in Spark; the distinct words are counted and each is encoded
once, into a table. Ids come back to the words by position in two exact ways at once. The most frequent
words, at most HEAD of them, are broadcast, which bounds what is sent to a worker for any corpus, and
resolve nearly all positions where the text stands. Every other word is a gap: it is looked up by a
shuffled join on the word, and its ids return to the gap's position by a join on the document, through
which only ids travel, never texts.
"""

from __future__ import annotations

import base64
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from .staging import stage
from .textvec import release

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
HEAD = 1 << 20  # at most this, for the numbers of words travel in one to three bytes
_FLUSH = 200_000
_KNOWN = 1 << 20
_ROWS = 2048
_QUICK = 1 << 16
_made: dict[int, tiktoken.Encoding] = {}
_sizes: dict[int, dict[str, int]] = {}


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """Pieces and their ids from a rank file, read on the driver."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _encoding(shared) -> tiktoken.Encoding:
    """One encoding for each worker and vocabulary."""
    if id(shared) not in _made:
        _made.clear()
        _made[id(shared)] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=shared.value, special_tokens={})
    return _made[id(shared)]


def _ranges(kind: str) -> str:
    """The letters of a class of ``regex`` below 65,536, as ranges for ``re``."""
    fits = regex.compile(kind).match
    inside = np.array([k < 0x10000 and not 0xD800 <= k < 0xE000 and fits(chr(k)) is not None for k in range(0x10001)])
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside]).astype(np.int8)))
    return "".join(f"\\u{a:04x}-\\u{b - 1:04x}" for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()))


@lru_cache(1)
def splitter() -> Callable[[str], list[str]]:
    """A function from a text to its words by PATTERN: by ``re``, which is twice as fast, where the text has no letter above 65,535."""
    letter, number, space = _ranges(r"\p{L}"), _ranges(r"\p{N}"), _ranges(r"\s")
    fast = re.compile(rf" ?[{letter}]+| ?[{number}]+|'(?:[stmd]|re|ve|ll)| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+").findall
    whole = regex.compile(PATTERN).findall
    return lambda text: fast(text) if text.isascii() or len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text) else whole(text)


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n): all distinct words of ``text`` with their counts, combined before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter()
        seen: Counter[str] = Counter()
        batch_of = lambda: pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])
        for batch in batches:
            for text in batch.column(0):
                seen.update(split(text.as_py() or ""))
                if len(seen) > _FLUSH:
                    yield batch_of()
                    seen.clear()
        if seen:
            yield batch_of()
        seen.clear()
        release()

    return docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def encode_words(words: DataFrame, ranks, kind: type = np.int32) -> DataFrame:
    """(word, n, ids): each row of ``words`` encoded, ids as bytes of a number ``kind``; ``ranks`` is a broadcast of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(ranks)._core_bpe.encode_single_piece
        for batch in batches:
            ids = [np.array(encode(w.encode()), kind).tobytes() for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary())], ["word", "n", "ids"])
        _made.clear()  # tasks after this one need the memory
        release()

    return words.mapInArrow(run, "word string, n long, ids binary")


def frequent(table: DataFrame, most: int = HEAD) -> tuple[DataFrame, DataFrame]:
    """The word table in two: the most frequent words, ``most`` at the most, and all others. The cut is between classes of counts, an eighth of a doubling wide, of which there are some hundreds."""
    kind = F.floor(F.log2("n") * 8).cast("int")
    sizes = table.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("kind")).collect()
    cut, room = 1 << 20, most
    for r in sizes:
        room -= r["words"]
        if room < 0:
            break
        cut = r["kind"]
    return table.where(kind >= cut), table.where(kind < cut)


class WordNumbers:
    """Numbers of ``words``, from 1 on, in some 30 bytes a word: only the first ``quick`` are in a dictionary, all others are found by hash and compared."""

    def __init__(self, words: pa.Array, quick: int = _QUICK, hash_of: Callable[[str], int] = xxhash.xxh3_64_intdigest):
        h = np.fromiter((hash_of(w.as_py()) for w in words), np.uint64, len(words))
        order = np.argsort(h)
        self.words, self.hash_of, self.hashes, self.places = words, hash_of, h[order], order.astype(np.uint32)
        same = np.flatnonzero(self.hashes[1:] == self.hashes[:-1])
        # words that share a hash can't be told by it
        own = np.union1d(np.arange(min(quick, len(words))), order[np.union1d(same, same + 1)])
        self.quick = dict(zip(words.take(pa.array(own, pa.int64())).to_pylist(), (own + 1).tolist()))

    def find(self, asked: list[str]) -> np.ndarray:
        """Numbers of words that aren't in ``quick``, 0 for those that aren't there at all."""
        out = np.zeros(len(asked), np.int64)
        if len(self.hashes):
            h = np.fromiter(map(self.hash_of, asked), np.uint64, len(asked))
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            near = np.flatnonzero(self.hashes[at] == h)
            place = self.places[at[near]]
            same = pc.equal(self.words.take(pa.array(place)), pa.array([asked[k] for k in near], self.words.type)).to_numpy(zero_copy_only=False)
            out[near[same]] = place[same].astype(np.int64) + 1
        return out


_ONE, _TWO = 192, 192 + 48 * 256


def pack_numbers(code: np.ndarray, missing: list[str]) -> bytes:
    """Numbers of words in one to three bytes, the first bytes of all before the others, then the missing words with their lengths."""
    y, z = code - _ONE, code - _TWO
    size = np.where(code < _ONE, 1, np.where(code < _TWO, 2, 3))
    first = np.where(size == 1, code, np.where(size == 2, 192 + (y >> 8), 240 + (z >> 16))).astype(np.uint8)
    more = np.stack([np.where(size == 2, y, z >> 8) & 255, z & 255], 1).astype(np.uint8)[np.arange(2) < (size - 1)[:, None]]
    words = [w.encode() for w in missing]
    return b"".join([np.array([len(code), len(words), len(more)], np.uint32).tobytes(), first.tobytes(), more.tobytes(), np.array([len(w) for w in words], np.uint32).tobytes(), *words])


def unpack_numbers(body: bytes) -> tuple[np.ndarray, list[str]]:
    """What :func:`pack_numbers` packed."""
    n, gaps, rest = np.frombuffer(body, np.uint32, 3).tolist()
    first = np.frombuffer(body, np.uint8, n, 12).astype(np.int64)
    more = np.append(np.frombuffer(body, np.uint8, rest, 12 + n), [0, 0]).astype(np.int64)
    size = (first >= 192).astype(np.int64) + (first >= 240)
    at = np.minimum(np.cumsum(size) - size, rest)
    two = ((first - 192) << 8 | more[at]) + _ONE
    three = ((first - 240) << 16 | more[at] << 8 | more[at + 1]) + _TWO
    code = np.where(size == 0, first, np.where(size == 1, two, three))
    at_ = 12 + n + rest
    lengths = np.frombuffer(body, np.uint32, gaps, at_) if gaps else np.zeros(0, np.uint32)
    at_ += 4 * gaps
    words = []
    for k in lengths.tolist():
        words.append(body[at_ : at_ + k].decode())
        at_ += k
    return code, words


_Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
_ENCODED = "doc_id long, ids array<int>, text_hash long"


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, head: int = HEAD) -> DataFrame:
    """(doc_id, ids, text_hash): the ids of each row's whole text, and a hash of the text for comparison.

    A null text has null ids, an empty one none; long texts are encoded in whole. Rows that repeat give a
    row each; a null doc_id stays null. Special tokens' strings are ordinary text. Ties in frequency
    fall on one side of the cut together. No rows give no rows. Other columns aren't read.
    """
    rows, fill = _encoding_plan(docs, vocabulary, head)
    return rows.mapInArrow(fill, _ENCODED)


def round_trip(docs: DataFrame, vocabulary: str = VOCABULARY, head: int = HEAD) -> DataFrame:
    """(doc_id, ids, text_hash, text): :func:`encode`, and :func:`decode` of what it gives. One Python worker does the last step of the one and the first of the other."""
    rows, fill = _encoding_plan(docs, vocabulary, head)
    spread_ids = lambda batches: spread(pa.RecordBatch.from_arrays([b.column(1), b.column(0), b.column(2)], ["ids", "c0", "c1"]) for b in fill(batches))
    met = rows.mapInArrow(spread_ids, "id int, row struct<ids: array<int>, c0: bigint, c1: bigint>")
    back = gathered(met, piece_table(docs.sparkSession, vocabulary), ["bigint", "bigint"])
    return back.select(F.col("c0").alias("doc_id"), "ids", F.col("c1").alias("text_hash"), F.col("text").cast("string").alias("text"))


def _encoding_plan(docs: DataFrame, vocabulary: str, head: int) -> tuple[DataFrame, _Batches]:
    """Rows in which words are numbers, and the function that turns these to ids."""
    spark = docs.sparkSession
    ranks_ = read_ranks(vocabulary)
    ranks = spark.sparkContext.broadcast(ranks_)
    narrow = np.uint16 if max(ranks_.values()) < 1 << 16 else np.int32
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = stage(encode_words(count_words(docs), ranks, narrow), "words")
    top, rest = frequent(table, head)
    known = top.select("word", "ids", "n").toArrow()  # at most `head` words
    # frequent words get small numbers, which take little room when they travel
    order = np.lexsort((known.column("word").to_numpy(), -known.column("n").to_numpy())) if len(known) else np.zeros(0, np.int64)
    words = pa.concat_arrays([pa.array([], pa.string()), *(c.cast(pa.string()) for c in known.column("word").take(pa.array(order)).chunks)])
    bodies = known.column("ids").take(pa.array(order)).to_pylist()
    # number 0 is a gap, without ids of its own
    starts = np.cumsum([0, 0, *(len(b) // narrow().itemsize for b in bodies)])
    numbers = spark.sparkContext.broadcast(WordNumbers(words))
    pieces = spark.sparkContext.broadcast((starts, np.frombuffer(b"".join(bodies), narrow)))
    del known, words, bodies

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, get, find = splitter(), numbers.value.quick.get, numbers.value.find
        pack = zstandard.ZstdCompressor(level=1, write_checksum=False).compress
        for whole in batches:
            for at in range(0, len(whole), _ROWS):
                batch = whole.slice(at, _ROWS)
                coded: list = []
                for text in batch.column(3):
                    words = split(text.as_py()) if text.is_valid else []
                    code = np.array([get(w, 0) for w in words], np.int32)
                    gaps = np.flatnonzero(code == 0)
                    coded.append((code, gaps, [words[k] for k in gaps]) if text.is_valid else None)
                asked = list({w for c in coded if c for w in c[2]})
                found = dict(zip(asked, find(asked).tolist()))
                bodies = []
                for c in coded:
                    if c:
                        code, gaps, missing = c
                        code[gaps] = [found[w] for w in missing]
                        bodies.append(pack(pack_numbers(code.astype(np.int64), [w for w in missing if not found[w]])))
                    else:
                        bodies.append(None)
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(bodies, pa.binary())], ["key", "own", "doc", "body"])
        release()

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            words: list[str] = []
            n = []
            for body in batch.column(3):
                missing = unpack_numbers(unpack(body.as_py()))[1] if body.is_valid else []
                words += missing
                n.append(len(missing))
            row = pa.array(np.repeat(np.arange(len(n)), n))
            at = np.concatenate([np.zeros(0, np.int64), *map(np.arange, n)])
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), batch.column(0).take(row), batch.column(1).take(row), pa.array(at, pa.int32())], ["word", "key", "own", "number"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        begin, every = pieces.value
        for batch in batches:
            out = []
            for k in range(len(batch)):
                body = batch.column(2)[k].as_py()
                if body is None:
                    out.append(None)
                    continue
                code, missing = unpack_numbers(unpack(body))
                size = begin[np.minimum(code + 1, len(begin) - 1)] - begin[code]
                gaps = np.flatnonzero(code == 0)
                given: list[np.ndarray] = []
                if len(gaps):
                    by = dict(zip(batch.column(3)[k].as_py() or (), batch.column(4)[k].as_py() or ()))
                    if len(by) != len(missing):
                        raise RuntimeError("a word isn't in the table of distinct words")
                    given = [np.frombuffer(by[j], narrow) for j in range(len(gaps))]
                    size[gaps] = [len(g) for g in given]
                ends = np.cumsum(size)
                take = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin[code] - (ends - size), size)
                for g in gaps:
                    take[ends[g] - size[g] : ends[g]] = 0
                ids = every[take].astype(np.int32) if len(every) else np.zeros(len(take), np.int32)
                for g, own in zip(gaps, given):
                    ids[ends[g] - size[g] : ends[g]] = own
                out.append(ids)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32())), batch.column(1)], ["doc_id", "ids", "text_hash"])
        release()

    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    keyed = docs.select(key.alias("key"), F.xxhash64("text").alias("own"), F.col("doc_id").alias("doc"), "text")
    # both uses read this one exchange, so texts are split once here
    coded = keyed.mapInArrow(number, "key long, own long, doc long, body binary").repartition("key", "own")
    answers = coded.mapInArrow(ask, "word string, key long, own long, number int").join(rest.select("word", "ids"), "word")
    # a repeated row asks the same again: a set
    found = answers.groupBy("key", "own").agg(F.collect_set(F.struct("number", "ids")).alias("got"))
    both = coded.join(found, ["key", "own"], "left")
    return both.select("doc", "own", "body", F.col("got.number").alias("number"), F.col("got.ids").alias("found")), fill


def token_count(spark: SparkSession, vocabulary: str = VOCABULARY) -> Callable[[Column], Column]:
    """A function from a text column to the number of its ids, as :func:`encode` gives them; null for null.

    Each worker encodes a word once, as long as it has fewer than 2**20 words in mind.
    """
    ranks = spark.sparkContext.broadcast(read_ranks(vocabulary))

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        encode_one, split = _encoding(ranks)._core_bpe.encode_single_piece, splitter()
        known = _sizes.setdefault(id(ranks), {})
        out = []
        for text in texts.to_pylist():
            if text is None:
                out.append(None)
                continue
            words = split(text)
            try:
                out.append(sum(map(known.__getitem__, words)))
            except KeyError:
                if len(known) > _KNOWN:
                    known.clear()
                for w in set(words).difference(known):
                    known[w] = len(encode_one(w.encode()))
                out.append(sum(map(known.__getitem__, words)))
        return pa.array(out, pa.int64())

    return count


def piece_table(spark: SparkSession, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, piece): the vocabulary, pieces as bytes."""
    ranks = read_ranks(vocabulary)
    return spark.createDataFrame(pa.table({"id": pa.array(ranks.values(), pa.int32()), "piece": pa.array(ranks.keys(), pa.binary())}))


def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, row): those of a batch, whose first column is ``ids``, without an id, and behind them its distinct ids without a row."""
    for whole in batches:
        for at in range(0, len(whole), _ROWS):  # what is put together holds as many rows
            batch = whole.slice(at, _ROWS)
            rows = pa.StructArray.from_arrays(batch.columns, batch.schema.names)
            wanted = batch.column(0).flatten().unique().drop_null()
            yield pa.RecordBatch.from_arrays([pa.nulls(len(rows), pa.int32()), rows], ["id", "row"])
            yield pa.RecordBatch.from_arrays([wanted, pa.nulls(len(wanted), rows.type)], ["id", "row"])
    release()


def joined(held: list[pa.RecordBatch], others: int) -> Iterator[pa.RecordBatch]:
    """Texts of one batch's rows, from those and from the pieces behind them."""
    table = pa.Table.from_batches(held).combine_chunks()
    asks = pc.is_null(table.column("id"))
    rows = table.column("row").filter(asks).combine_chunks()
    given = table.filter(pc.invert(asks))
    pieces = given.column("piece").combine_chunks()
    pieces = pa.concat_arrays([pieces, pa.nulls(1, pa.binary())])  # the last place is that of null ids
    lists = rows.field("ids")
    at = 0
    bounds = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())])
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + (1 << 18), side="right")) - 1)
        part = rows.slice(at, to - at)
        own = part.field("ids")
        where = pc.fill_null(pc.index_in(own.flatten(), given.column("id").combine_chunks()), len(pieces) - 1)
        body = pieces.take(where)
        places = np.frombuffer(body.buffers()[1], np.int32)[body.offset : body.offset + len(body) + 1]
        text = pa.Array.from_buffers(pa.binary(), to - at, [None, pa.py_buffer(places[bounds[at : to + 1] - bounds[at]].tobytes()), body.buffers()[2] or pa.py_buffer(b"")])
        text = pc.if_else(pc.is_null(own), pa.scalar(None, pa.binary()), text)
        yield pa.RecordBatch.from_arrays([own, text, *(part.field(k + 1) for k in range(others))], ["ids", "text", *(f"c{k}" for k in range(others))])
        at = to


def gathered(met: DataFrame, pieces: DataFrame, kinds: list[str]) -> DataFrame:
    """(ids, text, c0, ...) from the rows that :func:`spread` gives; ``kinds`` are the types of the columns beside ids."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = True
        for batch in batches:
            asks = pc.is_null(batch.column(0)).to_numpy(zero_copy_only=False)
            begins = np.flatnonzero(asks & ~np.append(last, asks[:-1])).tolist()  # a row behind pieces begins a batch
            for a, b in zip([0, *begins], [*begins, len(batch)]):
                if a in begins and held:
                    yield from joined(held, len(kinds))
                    held = []
                if b > a:
                    held.append(batch.slice(a, b - a))
            last = bool(asks[-1]) if len(asks) else last
        if held:
            yield from joined(held, len(kinds))
        release()

    # a task's rows keep their order in a join with a broadcast table
    rows = met.join(F.broadcast(pieces), "id", "left").select("id", "piece", "row")
    return rows.mapInArrow(gather, f"ids array<int>, text binary{''.join(f', c{k} {t}' for k, t in enumerate(kinds))}")


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY, ids: str = "ids", name: str = "text") -> DataFrame:
    """``encoded`` with the text of its ``ids`` in a column ``name``.

    Each Arrow batch is followed by its distinct ids, a row each. These are joined to the id-to-piece
    table, which is broadcast, for it has the vocabulary's size for any corpus; rows without an id pass.
    The join keeps rows where they are, so pieces come behind the rows that want them, and are put
    together by position without a shuffle. Each id is joined once a batch instead of once a position.

    Null ids give a null text, an empty array an empty one; ids that are null or that the vocabulary
    doesn't have give nothing. Long arrays are decoded in whole. Rows that repeat give a row each; no
    rows give no rows. A column ``name`` is replaced; all other columns stay.
    """
    others = [c for c in encoded.columns if c not in (ids, name)]
    plain = encoded.select(F.col(ids).cast("array<int>").alias("ids"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others)])
    kind = plain.select(F.struct("*").alias("row")).schema["row"].dataType.simpleString()
    kinds = [plain.schema[f"c{k}"].dataType.simpleString() for k in range(len(others))]
    back = gathered(plain.mapInArrow(spread, f"id int, row {kind}"), piece_table(encoded.sparkSession, vocabulary), kinds)
    place = {c: F.col(f"c{k}") for k, c in enumerate(others)} | {ids: F.col("ids")}
    return back.select(*[place[c].alias(c) for c in encoded.columns if c != name], F.col("text").cast("string").alias(name))


def op8(spark, sf_dir: str) -> DataFrame:
    """Ids of all documents, and whether decoding them gives the text back."""
    done = round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", "ids", F.size("ids").cast("long").alias("n_ids"), (F.xxhash64("text") == F.col("text_hash")).alias("same"))


QUERIES: dict[str, Callable] = {"op8_bpe": op8}
SQL: dict[str, str] = {}
