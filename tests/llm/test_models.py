"""Media, BPE, quality, language, and the pipeline."""

import pickle
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import bpe, jpeg, language, media, near_dedup, packing, quality

# -- media


def test_jpeg_round_trip():
    rng = np.random.default_rng(0)
    for shape in ((8, 8), (16, 24), (13, 21), (1, 1)):
        y = np.clip(rng.normal(128, 60, shape), 0, 255)
        for tables in (True, False):
            got = jpeg.decode(jpeg.encode(y, 1, tables))
            assert got.shape == (*shape, 3) and np.abs(got[:, :, 0] - y).max() < 2.5 and (got[:, :, 1:] == 128).all()


def colour_frame(planes, restart=0):
    """A 4:2:0 frame put together from grey scans of single values: each plane's blocks have one DC coefficient."""
    dc, ac = ({s: (c, n) for c, n, s in jpeg._codes(jpeg.STANDARD[k])} for k in (0, 0x10))
    bits, last, out = "", [0, 0, 0], b""
    put = lambda c, n: format(c, f"0{n}b") if n else ""

    def flush(text):
        text += "1" * (-len(text) % 8)
        return bytes(int(text[k : k + 8], 2) for k in range(0, len(text), 8)).replace(b"\xff", b"\xff\x00")

    for unit, values in enumerate(planes):
        if restart and unit and unit % restart == 0:
            out += flush(bits) + bytes([0xFF, 0xD0 + (unit // restart - 1) % 8])
            bits, last = "", [0, 0, 0]
        for plane, blocks in enumerate((values[:4], values[4:5], values[5:6])):
            for v in blocks:
                d = v - last[plane]
                last[plane] = v
                n = abs(d).bit_length()
                bits += put(*dc[n]) + put(d if d > 0 else d + (1 << n) - 1, n) + put(*ac[0])
    part = lambda m, b: bytes([0xFF, m]) + (len(b) + 2).to_bytes(2) + b
    head = b"\xff\xd8" + part(0xDB, b"\0" + bytes([8]) * 64) + part(0xC0, b"\x08\0\x10" + (16 * len(planes)).to_bytes(2) + b"\x03\x01\x22\x00\x02\x11\x00\x03\x11\x00")
    head += part(0xDD, restart.to_bytes(2)) if restart else b""
    return head + part(0xDA, b"\x03\x01\x00\x02\x00\x03\x00\x00\x3f\x00") + out + flush(bits) + b"\xff\xd9"


@pytest.mark.parametrize("shape", [(1, 1), (17, 33), (64, 48), (130, 120)])
def test_colour_round_trip(shape):
    rng = np.random.default_rng(1)
    y, x = np.mgrid[: shape[0], : shape[1]]
    frames = np.stack([np.stack([128 + 60 * np.sin(x / 9 + k), 120 + x / 4 - y / 5, 140 + 30 * np.cos(y / 11)], 2) for k in range(3)]) + rng.normal(0, 2, (3, *shape, 3))
    frames = frames.clip(0, 255)
    for across, down, restart in ((1, 1, 0), (2, 2, 0), (2, 1, 3), (4, 2, 1)):
        made = jpeg.encode_all(frames, 1, across=across, down=down, restart=restart)
        got = np.concatenate([p for _, p in jpeg.bands(made)])
        assert got.shape == frames.shape and np.abs(got[:, :, :, 0] - frames[:, :, :, 0]).max() < 3
        assert np.abs(got[:, :, :, 1:].astype(float) - frames[:, :, :, 1:]).mean() < 6
        assert (np.stack([jpeg.decode(f) for f in made]) == got).all()


def test_odd_sampling_and_separate_scans():
    """Factors that don't divide each other, and components in scans of their own."""
    dc, ac = ({s: (c, n) for c, n, s in jpeg._codes(jpeg.STANDARD[k])} for k in (0, 0x10))

    def scan(values):
        bits, last = "", {}
        for part, v in values:
            d = v - last.get(part, 0)
            last[part] = v
            n = abs(d).bit_length()
            c, m = dc[n]
            bits += format(c, f"0{m}b") + (format(d if d > 0 else d + (1 << n) - 1, f"0{n}b") if n else "")
            c, m = ac[0]
            bits += format(c, f"0{m}b")
        bits += "1" * (-len(bits) % 8)
        return bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")

    part = lambda m, b: bytes([0xFF, m]) + (len(b) + 2).to_bytes(2) + b
    head = lambda f, w: b"\xff\xd8" + part(0xDB, b"\0" + bytes([8]) * 64) + part(0xC0, b"\x08\0\x08" + w.to_bytes(2) + b"\x03" + bytes(f))
    odd = head([1, 0x31, 0, 2, 0x21, 0, 3, 0x11, 0], 24) + part(0xDA, b"\x03\x01\x00\x02\x00\x03\x00\x00\x3f\x00") + scan([(0, 1), (0, 2), (0, 3), (1, 40), (1, 50), (2, -60)]) + b"\xff\xd9"
    got = jpeg.decode(odd)
    assert got.shape == (8, 24, 3) and got[0, :, 0].tolist() == [129] * 8 + [130] * 8 + [131] * 8
    assert got[0, :, 1].tolist() == [168] * 12 + [178] * 12 and (got[:, :, 2] == 68).all()
    single = head([1, 0x21, 0, 2, 0x11, 0, 3, 0x11, 0], 20)
    for k, values in enumerate(([(0, 1), (0, 2), (0, 3)], [(0, 40), (0, 50)], [(0, -60), (0, -70)])):
        single += part(0xDA, bytes([1, k + 1, 0, 0, 63, 0])) + scan(values)
    got = jpeg.decode(single + b"\xff\xd9")
    assert got.shape == (8, 20, 3) and got[0, :, 0].tolist() == [129] * 8 + [130] * 8 + [131] * 4
    assert got[0, :, 1].tolist() == [168] * 16 + [178] * 4 and got[0, :, 2].tolist() == [68] * 16 + [58] * 4


def test_large_frames_and_hostile_ones():
    y = np.add.outer(np.linspace(20, 220, 2000), np.linspace(0, 30, 1500))
    big = jpeg.encode(y, 16)
    parts = [p.shape for _, p in jpeg.bands([big, big])]
    assert len(parts) > 2 and np.abs(jpeg.decode(big)[:, :, 0] - y).max() < 20
    assert media.value_counts([big, big])[:, 0].sum(1).tolist() == [3_000_000] * 2
    huge = big.replace(b"\xff\xc0\x00\x0b\x08" + (2000).to_bytes(2) + (1500).to_bytes(2), b"\xff\xc0\x00\x0b\x08\xff\xff\xff\xff")
    assert media.frame_counts([huge]) == [None]
    rng = np.random.default_rng(5)
    small = jpeg.encode_all(np.full((1, 16, 16, 3), 77.0), across=2, down=2)[0]
    for _ in range(1500):
        damaged = bytearray(small)
        for at in rng.integers(2, len(small), 3):
            damaged[at] = rng.integers(0, 256)
        media.frame_counts([bytes(damaged[: rng.integers(2, len(small) + 1)]), small])
    mixed = media.frame_counts([small, small[:-20], small, big, small])
    assert [x is None for x in mixed] == [False, True, False, False, False] and (mixed[0] == mixed[4]).all()


@pytest.mark.parametrize("restart", [0, 1, 2])
def test_colour_and_restarts(restart):
    planes = [[10, -20, 30, -40, 5, -6], [0, 1, 2, 3, 50, 60], [-9, -9, -9, -9, 0, 0]]
    got = jpeg.decode(colour_frame(planes, restart)).astype(int)
    assert got.shape == (16, 48, 3)
    for u, p in enumerate(planes):
        for k, (y, x) in enumerate(((0, 0), (0, 8), (8, 0), (8, 8))):
            assert (got[y : y + 8, 16 * u + x : 16 * u + x + 8, 0] == np.clip(128 + p[k], 0, 255)).all()
        assert (got[:, 16 * u : 16 * u + 16, 1] == 128 + p[4]).all() and (got[:, 16 * u : 16 * u + 16, 2] == 128 + p[5]).all()


def test_shots_against_the_script():
    rng = np.random.default_rng(4)
    for n in range(60):
        frames, starts = media.embedding_frames(rng.normal(size=64), n)
        for index in ("idx1", "indx", "none"):
            got = media.clips(media.write_avi(frames, 40_000, index=index))
            assert [c[1] for c in got] == starts and got[0][7] == {"none": "scan"}.get(index, index)
            assert got[-1][4] == 40_000 * len(frames) and got[-1][2] == len(frames) - 1 and all(a[4] == b[3] for a, b in zip(got, got[1:]))


def test_odd_media(spark):
    frames, _ = media.embedding_frames([1.0, -2.0], 7)
    whole = media.write_avi(frames)
    broken = media.write_avi([frames[0], b"\xff\xd8garbage", *frames[2:]])
    rows = [(1, None), (2, b""), (3, b"RIFF"), (4, b"x" * 1000), (5, whole), (5, whole), (6, whole[: len(whole) // 2]), (7, broken), (None, whole), (8, media.write_avi([])), (9, media.write_avi([b"\xff\xd8"] * 3)), (10, whole.replace(b"MJPG", b"XVID")), (11, media.write_avi(frames * 40))]
    df = spark.createDataFrame(rows, "media_id long, media binary").withColumn("shot", F.lit("x")).withColumn("key", F.lit(1))
    got = media.media_clips(df).collect()
    errors = {r.media_id: r.error for r in got}
    assert set(errors) == {None, *range(1, 12)} and {k for k, e in errors.items() if e} == {1, 2, 3, 4, 8, 9, 10}
    assert sum(r.damaged for r in got if r.media_id == 7) == 1 and sum(r.media_id == 5 for r in got) == 2 * sum(r.media_id is None for r in got)
    assert max(r.last_frame for r in got if r.media_id == 11) == 40 * len(frames) - 1
    assert media.media_clips(df.limit(0)).count() == 0


def test_media_query(spark, sf):
    rows = media.op4(spark, sf).collect()
    starts = {}
    for r in rows:
        starts.setdefault(r.media_id, []).append(r.first_frame)
    for e in spark.read.parquet(f"{sf}/embeddings.parquet").collect():
        assert sorted(starts[e.vec_id]) == media.embedding_frames(e.embedding, e.vec_id)[1]


# -- BPE


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.read_ranks(), special_tokens={})


def test_bpe_query(spark, sf, encoding):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = bpe.op8(spark, sf).collect()
    assert len(rows) == len(texts) and all(r.same for r in rows)
    for r in rows:
        assert r.ids == encoding.encode_ordinary(texts[r.doc_id]) and r.n_ids == len(r.ids)


@pytest.mark.parametrize("head", [0, 3, 1 << 20])
def test_bpe_cases(spark, encoding, head):
    texts = ["", None, " ", "a", "a", "<|endoftext|> it's 'll", "日本語 emoji 🙂 é́", "\n\n \t x\r\n", "\x00 nul\x00", "word " * 20_000, "z" * 3000, "It's I'LL 12³½"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "a b"), (None, None), (3, "a"), (3, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("word", F.lit("w")).withColumn("key", F.lit(0))
    got = bpe.decode(bpe.encode(df, head=head), name="back").collect()
    assert len(got) == len(rows)
    want = sorted([(i, None if t is None else encoding.encode_ordinary(t), t) for i, t in rows], key=repr)
    assert sorted([(r.doc_id, r.ids, r.back) for r in got], key=repr) == want
    assert bpe.encode(df.limit(0)).count() == 0


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The textbook loop: the neighbours of least rank become one, until none has a rank."""
    parts = [bytes([b]) for b in word]
    while True:
        pairs = [(ranks[parts[k] + parts[k + 1]], k) for k in range(len(parts) - 1) if parts[k] + parts[k + 1] in ranks]
        if not pairs:
            return [ranks[p] for p in parts]
        _, k = min(pairs)
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


def test_bpe_against_the_merge_loop(spark, sf):
    ranks = bpe.read_ranks()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    split = regex.compile(bpe.PATTERN).findall
    known = {}
    for r in bpe.op8(spark, sf).collect():
        want = []
        for w in split(texts[r.doc_id]):
            if w not in known:
                known[w] = merged(w.encode(), ranks)
            want += known[w]
        assert r.ids == want


def test_token_count_and_words(spark):
    texts = ["", None, "it's 'll 12³½ x", "日本語 emoji 🙂 é́ a\u0085b\u2028c\x1cd", "\n\n \t x\r\n  y ", "'S 's't''ve 're", "𝒜𝓁𝓅𝒽𝒶 x 𝟙𝟚", " " * 50 + "a"]
    whole = regex.compile(bpe.PATTERN).findall
    assert all(bpe.splitter()(t) == whole(t) for t in texts if t is not None)
    rng = np.random.default_rng(3)
    for _ in range(2000):
        t = "".join(chr(k) for k in rng.choice([*range(9, 14), 32, 32, 39, 39, *range(95, 123), 0x1C, 0x85, 0xA0, 0xB2, 0xBD, 0x301, 0x2019, 0x3000, 0x4E00, 0xAC00, 0xFFFF], 12))
        assert bpe.splitter()(t) == whole(t)
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    counts = {r.doc_id: r.n for r in df.select("doc_id", bpe.token_count(spark)(F.col("text")).alias("n")).collect()}
    assert counts == {r.doc_id: None if r.ids is None else len(r.ids) for r in bpe.encode(df).collect()}


def test_decode_keeps_columns(spark):
    rows = [(k, [64 + k % 40, 65] * (k % 7) if k % 5 else None, {"a": str(k)}, "old") for k in range(30_000)]
    df = spark.createDataFrame(rows, "id long, ids array<int>, extra map<string,string>, text string").coalesce(3)
    got = bpe.decode(df)
    assert got.columns == ["id", "ids", "extra", "text"] and got.count() == len(rows)
    piece = {v: k for k, v in bpe.read_ranks().items()}
    for r in got.collect():
        _, ids, extra, _ = rows[r.id]
        assert r.ids == ids and r.extra == extra and r.text == (None if ids is None else b"".join(piece[i] for i in ids).decode("utf-8", "replace"))
    assert "BroadcastHashJoin" in got._jdf.queryExecution().toString() and bpe.decode(df.limit(0)).count() == 0


def test_unknown_ids(spark):
    df = spark.createDataFrame([(1, [64, None, -5, 99_999_999, 65]), (2, []), (3, None)], "doc_id long, ids array<int>")
    ranks = {v: k for k, v in bpe.read_ranks().items()}
    assert [r.text for r in bpe.decode(df).orderBy("doc_id").collect()] == [(ranks[64] + ranks[65]).decode(), "", None]


def test_number_packing():
    code = np.array([0, 1, 191, 192, 193, 12479, 12480, 12481, (1 << 20) - 1, 1 << 20, 0])
    got, words = bpe.unpack_numbers(bpe.pack_numbers(code, ["é", ""]))
    assert got.tolist() == code.tolist() and words == ["é", ""]
    assert bpe.unpack_numbers(bpe.pack_numbers(code[:0], []))[0].tolist() == []


@pytest.mark.parametrize("hash_of", [bpe.xxhash.xxh3_64_intdigest, len], ids=["hash", "clashes"])
def test_word_numbers_are_exact(hash_of):
    words = [f"{a}{k}" for k in range(3000) for a in ("", " é")]
    for quick in (0, 7, 1 << 16):
        got = pickle.loads(pickle.dumps(bpe.WordNumbers(pa.array(words), quick, hash_of)))
        there = words + ["none", "", "3000"]
        rest = [w for w in there if w not in got.quick]
        assert {**got.quick, **dict(zip(rest, got.find(rest).tolist()))} == {w: words.index(w) + 1 if w in words else 0 for w in there}
    assert bpe.WordNumbers(pa.array([], pa.string())).find(["a"]).tolist() == [0] and bpe.WordNumbers(pa.array(words)).find([]).tolist() == []


def test_word_numbers_take_little_memory():
    """A dictionary of words takes over 100 bytes a word, in each worker."""
    words = pa.array([f" word{k}" for k in range(200_000)])
    body = pickle.dumps(bpe.WordNumbers(words, 1000))
    before = pa.total_allocated_bytes()
    tracemalloc.start()
    held = pickle.loads(body)
    taken = tracemalloc.get_traced_memory()[1] + pa.total_allocated_bytes() - before
    tracemalloc.stop()
    assert len(held.words) == 200_000 and taken < 60 * 200_000


# -- quality


def test_quality_held_out(spark):
    base = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    held = labels.where("pmod(xxhash64(doc_id, 'held'), 3) = 0")
    model = quality.fit_quality(docs, labels.join(held, "doc_id", "left_anti"))
    rows = quality.scored(docs.join(held, "doc_id").select("doc_id", "text", "quality"), model).toPandas()
    p, good = rows.iloc[:, -1].to_numpy(), rows["quality"].to_numpy()
    assert ((p >= quality.KEEP) == good).mean() > 0.97
    assert (p[good == 1] >= quality.KEEP).mean() > 0.99
    # calibrated: shares follow probabilities
    assert abs(p.mean() - good.mean()) < 0.03 and ((p - good) ** 2).mean() < 0.03


def brute_margin(text, model):
    from millrace.llm.textvec import blocks

    total = model.bias
    for _, _, data, offsets in blocks(pa.array([text]), lower=False):
        for w, (index, bounds) in zip(model.weights, quality.indices(data, offsets)):
            total += sum(float(w[i]) for i in index[bounds[0] : bounds[1]]) / (bounds[1] - bounds[0] + quality.SMOOTH)
    return total


def test_quality_scores(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit_quality(docs, labels)
    want = {}
    for r in docs.collect():
        p = float(model.probability(np.array([brute_margin(r.text, model)]))[0])
        if round(p, 6) >= quality.KEEP:
            want[r.doc_id] = p
    got = {r.doc_id: r.probability for r in quality.op9(spark, sf).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 2e-6 for k in got)


def test_quality_cases(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.fit_quality(docs, labels)
    good = docs.where("doc_id = 1").first().text
    rows = [(None, good), (1, good), (1, good), (2, None), (3, ""), (4, good * 300), (5, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("probability", F.lit("x")).withColumn("_", F.lit(1))
    kept = quality.keep_quality(df, model)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(1) == 2 and None in ids and 4 in ids and not {2, 3} & set(ids)
    assert quality.keep_quality(df.limit(0), model).count() == 0
    for some in (labels.limit(0), labels.where("quality = 1"), labels.withColumn("quality", F.lit(None).cast("int"))):
        own = quality.fit_quality(docs, some)
        assert quality.keep_quality(df, own).where("text <> ''").count() == 5
    assert quality.fit_quality(docs.limit(0), labels).bias == 0


# -- language


def brute_shares(p, steps=40):
    """The best shares of two columns on a grid."""
    grid = np.linspace(0, 1, steps + 1)
    return max(((np.log(p @ np.array([a, 1 - a]) + 1e-300).sum(), a) for a in grid))[1]


def test_expectation_maximisation():
    rng = np.random.default_rng(0)
    for _ in range(5):
        p = rng.uniform(0.01, 1, (80, 2))
        assert language.shares(p, 2000, 1e-9)[0] == pytest.approx(brute_shares(p), abs=0.03)


@pytest.fixture(scope="module")
def model(spark):
    return language.fit_languages(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))


def test_languages_held_out(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    seen = language.fit_languages(docs.where("pmod(xxhash64(doc_id, 'h'), 2) = 0"))
    held = docs.where("pmod(xxhash64(doc_id, 'h'), 2) = 1")
    got = language.languages(held, seen).join(held.select("doc_id", F.col("lang").alias("truth")), "doc_id")
    n, right = held.count(), got.where("lang = truth").count()
    assert right / n > 0.99


def test_mixtures(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("n_chars between 3000 and 6000")
    one = {r.lang: r.text for r in docs.where("not text rlike '[*%$#|!]'").orderBy("doc_id").dropDuplicates(["lang"]).collect()}
    mixed = one["en"][:2500] + "\n" + one["fr"][:2500]
    found, _ = language.identify(pa.array([mixed, one["de"], "\n".join(t[:2500] for t in one.values())]), model)
    names = (*model.names, "und")
    at = dict(zip(names, found[0]))
    assert at["en"] == pytest.approx(0.5, abs=0.12) and at["fr"] == pytest.approx(0.5, abs=0.12) and at["de"] == at["es"] == 0
    assert dict(zip(names, found[1]))["de"] > 0.98
    assert all(v > 0.1 for v in list(dict(zip(names, found[2])).values())[:4])


def test_language_cases(spark, model):
    text = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id = 1").first().text
    rows = [(1, text), (1, text), (None, text), (2, None), (3, ""), (4, "123 !!! 456"), (5, text * 200), (6, "qzxj wvkq xqzj vvkx " * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit(1)).withColumn("share", F.lit("x"))
    kept = language.keep_languages(df, model)
    assert kept.columns == df.columns and sorted(map(str, (r.doc_id for r in kept.collect()))) == ["1", "1", "5", "None"]
    assert language.keep_languages(df.limit(0), model).count() == 0
    none = language.fit_languages(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert none.names == () and language.keep_languages(df, none).count() == 0


# -- pipeline


def test_pipeline_against_its_parts(spark, sf, encoding):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    good = quality.fit_quality(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    kept = [i for i, t in rows.items() if round(float(good.probability(np.array([brute_margin(t, good)]))[0]), 6) >= quality.KEEP]
    left = docs.where(F.col("doc_id").isin(kept))
    tongues = language.fit_languages(left)
    found, _ = language.identify(pa.array([rows[i] for i in kept]), tongues)
    kept = [i for i, f in zip(kept, found) if f.any() and f[-1] <= 0.5 and f[:-1].any()]
    from test_near_dedup import brute

    groups, _ = brute([(i, rows[i]) for i in kept])
    gone = {i for m in groups for i in m if i != min(m)}
    got = corpus_pipeline.run(spark, sf)
    placed = {}
    for r in got.collect():
        placed[r.doc_id] = placed.get(r.doc_id, 0) + r.length
    assert placed == {i: len(encoding.encode_ordinary(rows[i])) + 1 for i in kept if i not in gone}


def test_stages_take_anything(spark, tmp_path):
    kind = "doc_id long, text string, lang string, source string, n_chars long, probability double, _ int, group_id long"
    text = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id = 1").first().text
    rows = [(1, text, "en", "s", 1, 0.1, 1, 1), (1, text, "en", "s", 1, 0.1, 1, 1), (2, text + " more", None, None, None, None, None, None), (None, text, "en", "s", 1, 0.1, 1, 1), (3, None, "en", "s", 1, 0.1, 1, 1), (4, "", "en", "s", 1, 0.1, 1, 1), (5, text * 100, "fr", "s", 1, 0.1, 1, 1)]
    for part in (rows, []):
        docs = spark.createDataFrame(part, kind)
        spark.createDataFrame([(1, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(str(tmp_path / "labels.parquet"))
        columns = docs.columns
        for k, (_, step) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"stage{len(part)}-{k}")
            step(spark, docs, str(tmp_path)).write.parquet(path)
            docs = spark.read.parquet(path)
            assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
        assert bool(docs.count()) == bool(part)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "language ID", "near-dedup", "packing"] and near_dedup.BANDS and packing.CAPACITY


def test_small_shares_of_long_texts(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("lang in ('en', 'es')").select("lang", "text").limit(3000).collect()
    words = {t: [w for d in docs if d.lang == t for w in d.text.split()] for t in ("en", "es")}
    long = " ".join(words["en"][:10_000] + words["es"][:350] + words["en"][10_000:19_650])
    assert len(long.split()) == 20_000
    found, _ = language.identify(pa.array([long]), model)
    share = dict(zip(model.names, found[0]))
    assert share["es"] == pytest.approx(0.0175, abs=0.005) and share["en"] > 0.9


def test_languages_after_one_that_fails():
    log_p = np.full((2000, 3), -40.0)
    log_p[:, 0] = -10
    log_p[0] = -40, -10, -40  # most gain at share 0, but less than the cost
    log_p[1:101] = -16, -40, -10
    got = language.mixture(log_p)
    assert got[1] == 0 and got[2] == pytest.approx(0.05, abs=0.01)


def test_long_repetitive_rows_train_unclipped():
    good = np.array([1, 0] * 16)
    fit = lambda times: quality.train(pa.array([f"plain words of a good text number {k} here" if g else f"x{k} " + "zq " * times for k, g in enumerate(good)]), good, bits=12, epochs=3)
    # shares of n-grams hardly change with length, so neither does the model
    assert fit(100_000).bias == pytest.approx(fit(20_000).bias, abs=1e-4)
