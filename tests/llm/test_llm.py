"""The training-data operators: brute force, the library they must equal, round trips, held-out accuracy, odd inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scantling.llm import bpe, flac, langid, licenses, mixing, quality_model, quality_rules, queries, simhash, token_files
from tests.compare import same_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Null, empty, white space, one word, ties, a very long text, other scripts, a repeated row, an id twice with other text, a null id.
ODD = [
    (1, None, "en", None), (2, "", "en", "b"), (3, " \n\t ", "en", "b"), (4, "word", None, "a"), (5, "same text here for two", "en", "a"),
    (6, "same text here for two", "en", "a"), (7, "long " * 30_000 + "end", "en", "a"), (8, "日本語 テキスト ١٢٣", "ja", "c"), (5, "same text here for two", "en", "a"),
    (9, "x", "en", "a"), (9, "y z", "en", "a"), (None, "nobody", "en", "a"), (10, "<|endoftext|> a <|endoftext|>", "en", "a"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows with extra columns whose names clash with what operators use or return."""
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit(0) for c in ("id", "size", "fp", "n_words", "kept", "rank", "component_id", "n_chars", "__text")})


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def rows_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


# every operator takes odd and empty tables ------------------------------------------------------------------------------------
ALL = {
    "flac": lambda d: flac.digest_media(flac.encode_media(d), ["doc_id", "n_bytes"]), "bpe": bpe.encode_documents, "quality": quality_model.classify,
    "tokens": token_files.count_tokens, "simhash": simhash.near_duplicates, "mixing": mixing.mix, "langid": langid.identify, "rules": quality_rules.apply_rules,
}


@pytest.mark.parametrize("name", sorted(ALL))
def test_odd_rows_have_a_row_each(name, odd):
    """A row for each, and rows of equal texts, languages and sources have equal values but for what is of their place or id."""
    got = ALL[name](odd)
    rows = got.collect()
    key = "id" if name == "mixing" else "doc_id"
    assert len(rows) == len(ODD) and Counter(r[key] for r in rows) == Counter(i for i, *_ in ODD)
    own = [c for c in got.columns if c not in (key, "file", "doc_no", "start", "held_out", "component_id", "copies", "taken")]
    values = {i: {str([r[c] for c in own]) for r in rows if r[key] == i} for i in (2, 3, 5, 6, 1)}
    assert values[5] == values[6] and len(values[5]) == 1
    if name not in ("flac", "bpe", "rules", "tokens"):
        assert values[2] == values[3] or name == "mixing"


def test_odd_rows_by_value(odd):
    """What null, empty and blank texts give, as the docstrings say."""
    by = lambda df, *c: {(r["doc_id"], tuple(r[x] for x in c)) for r in df.collect()}
    rules = by(quality_rules.apply_rules(odd), "n_words", "base_failed", "kept", "whole_ratio")
    assert {(1, (0, True, False, None)), (2, (0, True, False, None))} <= rules
    assert {(1, ("und", 0.0)), (2, ("und", 0.0)), (3, ("und", 0.0))} <= by(langid.identify(odd), "lang_pred", "score")
    assert {(1, (0.0, False)), (3, (0.0, False))} <= by(quality_model.classify(odd), "quality", "kept")
    assert {(1, (0, 1)), (2, (0, 1)), (3, (0, 1)), (5, (simhash.near_duplicates(odd).where("doc_id = 6").first()["fp"], 5))} <= by(simhash.near_duplicates(odd), "fp", "component_id")
    assert {(1, (0,)), (2, (0,))} <= by(bpe.encode_documents(odd), "n_tokens") & by(token_files.count_tokens(odd), "n_tokens")
    assert {(1, (0, 64)), (2, (0, 64)), (3, (4, 64))} <= by(flac.digest_media(flac.encode_media(odd), ["doc_id", "n_bytes"]), "n_bytes", "payload_bytes")


@pytest.mark.parametrize("name", sorted(ALL))
def test_empty_table(name, empty):
    assert ALL[name](empty).count() == 0


def test_licenses_of_odd_and_empty(odd, empty):
    assert licenses.scan(odd).count() == 0 and licenses.scan(empty).count() == 0


# FLAC ----------------------------------------------------------------------------------------------------------------------------
@given(st.lists(st.binary(min_size=64, max_size=3000), min_size=1, max_size=4), st.sampled_from([{}, {"max_order": 4}, {"linear_order": 3}, {"linear_order": 8, "max_order": 0}]))
@settings(max_examples=40, deadline=None)
def test_flac_round_trip(payloads, options):
    streams = flac.encode_payloads(payloads, **options)
    assert [b"".join(b for _, b in blocks) for blocks in flac.decode_streams(streams)] == payloads
    assert [o for o, _ in flac.decode_streams(streams)[0]] == list(range(0, len(payloads[0]), flac.BLOCK))


def test_flac_kinds_of_frames():
    smooth = bytes(int(128 + 100 * np.sin(i / 9)) for i in range(3000))
    for payload in (smooth, bytes(2000), bytes(range(256)) * 9, b"\xff" * 63 + b"\x00"):
        for options in ({}, {"linear_order": 6}):
            assert b"".join(b for _, b in flac.decode_streams(flac.encode_payloads([payload], **options))[0]) == payload
    assert len(flac.encode_payloads([smooth], linear_order=6)[0]) < len(flac.encode_payloads([smooth], max_order=0)[0])


def test_flac_checksums_by_hand():
    data = bytes(range(40))
    crc = 0
    for b in data:
        crc ^= b << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    assert flac.crc16_of(np.frombuffer(data, np.uint8), np.array([0]), np.array([40]))[0] == crc


@pytest.mark.parametrize("place", [30, 60, 150, -1])
def test_flac_damage_is_found(place):
    stream = bytearray(flac.encode_payloads([b"some text of a page " * 64])[0])
    stream[place] ^= 4
    with pytest.raises((flac.Broken, ValueError, IndexError)):
        flac.decode_streams([bytes(stream)])


def test_flac_query_by_hand(spark, sf, docs):
    got = {r["doc_id"]: r for r in queries.op1_flac(spark, sf).collect()}
    for i, text in rows_of(docs):
        payload = (text or "").encode()
        padded = payload + bytes(-len(payload) % 64 if payload else 64)
        assert (got[i]["n_bytes"], got[i]["payload_bytes"], got[i]["payload_sha256"], got[i]["tail_crc32"]) == (len(payload), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))


def test_pcm_blocks_can_be_sought(docs):
    blocks = flac.pcm_blocks(flac.encode_media(docs.where("n_chars > 3000").limit(2)), ["doc_id"])
    assert {r["sample_offset"] % flac.BLOCK for r in blocks.collect()} == {0}


@given(st.binary(min_size=64, max_size=5000), st.integers(0, 5200), st.integers(0, 3000))
@settings(max_examples=60, deadline=None)
def test_samples_from_any_offset(payload, first, count):
    stream = flac.encode_payloads([payload], linear_order=4)[0]
    assert flac.read_samples(stream, first, count) == payload[first : first + count]


def test_seeking_decodes_no_other_frame(spark):
    payload = bytes(random.Random(2).randbytes(5 * flac.BLOCK))
    stream = bytearray(flac.encode_payloads([payload])[0])
    stream[-20] ^= 1  # in the last frame
    assert flac.read_samples(bytes(stream), 10, 3000) == payload[10:3010]
    with pytest.raises(flac.Broken):
        flac.read_samples(bytes(stream), 4 * flac.BLOCK, 1)
    df = spark.createDataFrame([(1, bytearray(stream), 1500, 40), (2, bytearray(stream), 9999, 5)], "doc_id int, media binary, a int, b int")
    assert {r["doc_id"]: bytes(r["pcm"]) for r in flac.seek(df, ["doc_id"], "a", "b").collect()} == {1: payload[1500:1540], 2: b""}


def plain_decoder(stream):
    """A FLAC decoder of one bit after the other, for 8-bit mono, written from the format alone."""
    bits = "".join(f"{b:08b}" for b in stream)
    at = 32

    def take(n):
        nonlocal at
        at += n
        return int(bits[at - n : at] or "0", 2)

    def signed(n):
        v = take(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    last, total, kinds = False, 0, set()
    while not last:
        last, kind, n = take(1), take(7), take(24)
        if kind == 0:
            total = int(bits[at + 108 : at + 144], 2)
        at += 8 * n
    out = []
    while len(out) < total:
        assert take(14) == 0x3FFE and take(2) == 0
        code, _, _, _, _ = take(4), take(4), take(4), take(3), take(1)
        lead = take(8)
        for _ in range(max(0, f"{lead:08b}".index("0") - 1)):
            take(8)
        size = take(8) + 1 if code == 6 else take(16) + 1 if code == 7 else 256 << (code - 8)
        take(8)
        take(1)
        kind = take(6)
        take(1)
        kinds.add("linear" if kind >= 32 else "fixed" if kind >= 8 else "verbatim" if kind else "constant")
        x = []
        if kind == 0:
            x = [signed(8)] * size
        elif kind == 1:
            x = [signed(8) for _ in range(size)]
        else:
            order = kind - 31 if kind >= 32 else kind - 8
            x = [signed(8) for _ in range(order)]
            coefs, shift = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]][order] if kind < 32 else [], 0
            if kind >= 32:
                precision, shift = take(4) + 1, signed(5)
                coefs = [signed(precision) for _ in range(order)]
            wide, parts = 4 + take(2), take(4)
            for part in range(1 << parts):
                k = take(wide)
                raw = take(5) if k == (1 << wide) - 1 else None
                for _ in range((size >> parts) - (order if not part else 0)):
                    if raw is not None:
                        e = signed(raw)
                    else:
                        q = bits.index("1", at) - at
                        at += q + 1
                        u = q << k | (take(k) if k else 0)
                        e = u >> 1 if u % 2 == 0 else -(u + 1 >> 1)
                    x.append(e + (sum(c * v for c, v in zip(coefs, reversed(x), strict=False)) >> shift))
        out += x
        at += -at % 8
        take(16)
    return bytes(v + 128 for v in out), kinds


def test_an_independent_decoder_agrees(docs):
    texts = [(r["text"] or "").encode()[:3000] for r in docs.orderBy("doc_id").limit(12).collect()]
    texts += [bytes(int(128 + 100 * np.sin(i / 9)) for i in range(3000)), bytes(2100), random.Random(1).randbytes(1500)]
    seen = set()
    for text in texts:
        payload = flac.payload_of(text)
        got, kinds = plain_decoder(flac.encode_payloads([payload], linear_order=4)[0])
        assert got == payload
        seen |= kinds
    assert seen == {"linear", "fixed", "verbatim", "constant"}


# BPE -----------------------------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


@pytest.fixture(scope="module")
def own():
    return bpe.Bpe(bpe.default_path())


@given(st.text(alphabet=st.one_of(st.sampled_from(list("ab 'std.,\n\t  　é1x<|>")), st.characters(codec="utf-8")), max_size=60))
@settings(max_examples=400, deadline=None)
def test_bpe_equals_the_library(library, own, text):
    want = library.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == want and own.decode(want) == library.decode(want, skip_special_tokens=False)


def test_bpe_of_documents(library, docs, spark, sf):
    got = {r["doc_id"]: r for r in queries.op2_bpe(spark, sf).collect()}
    for i, text in rows_of(docs):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_three_ways_and_small_table(own):
    rng = random.Random(1)
    words = [bytes(rng.choice(b"abcdething ") for _ in range(rng.randint(1, 90))) for _ in range(200)]
    by_scan = [tuple(own.vocab[p] for p in own.parts(w)) for w in words]
    assert by_scan == own.merge_together(words) == [tuple(own.vocab[p] for p in own.parts_by_heap(w)) for w in words]
    small = bpe.Bpe(bpe.default_path(), table_words=10)
    texts = [w.decode() for w in words]
    assert [small.encode(t) for t in texts] == [own.encode(t) for t in texts]


def test_a_vocabulary_of_many_ids(own, tmp_path):
    """Ids beyond 16 bits, as they are in larger vocabularies: the same merges."""
    import json

    with open(bpe.default_path(), encoding="utf-8") as f:
        spec = json.load(f)
    spec["model"]["vocab"] = {t: i * 7 + 70_000 for t, i in spec["model"]["vocab"].items()}
    path = tmp_path / "wide.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    text = "Some words that merge, and others: antidisestablishmentarianism überraschend 12345"
    assert bpe.Bpe(str(path)).encode(text) == [i * 7 + 70_000 for i in own.encode(text)]
    assert bpe.Bpe(str(path)).merge_together([b"overwhelming", b"the"]) == [tuple(i * 7 + 70_000 for i in ids) for ids in own.merge_together([b"overwhelming", b"the"])]


def test_decode_ids(odd):
    made = bpe.encode_documents(odd.where("doc_id in (8, 10)"))
    assert {r["text"] for r in bpe.decode_ids(made, ["doc_id"]).collect()} == {ODD[7][1], ODD[12][1]}


def test_flac_query_uses_linear_predictors(spark, sf, docs):
    """Stored coefficients are taken where they are shorter, so the streams are, and they decode to the same."""
    plain = flac.digest_media(flac.encode_media(docs), ["doc_id", "n_bytes"])
    columns = ["payload_bytes", "payload_sha256", "tail_crc32", "n_blocks", "feature"]
    got = queries.op1_flac(spark, sf)
    assert got.agg(F.sum("media_bytes")).first()[0] < plain.agg(F.sum("media_bytes")).first()[0]
    assert got.select("doc_id", *columns).exceptAll(plain.select("doc_id", *columns)).count() == 0


# quality -----------------------------------------------------------------------------------------------------------------------
def test_label_model_finds_accuracies():
    rng = np.random.default_rng(1)
    n, k = 40_000, len(quality_model.LABELLERS)
    bad = rng.random(n) < 0.2
    on_bad, on_good = rng.uniform(0.3, 0.8, k), np.full(k, 0.005)
    fired = rng.random((n, k)) < np.where(bad[:, None], on_bad, on_good)
    patterns, counts = np.unique((fired << np.arange(k)).sum(1), return_counts=True)
    model = quality_model.fit_labels(patterns, counts)
    assert abs(model.bad - 0.2) < 0.03 and np.abs(model.on_bad - on_bad).max() < 0.06


def test_quality_of_held_out_labels(spark):
    """Half of the labels, by hash, are learned from; the others are what is held against."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").withColumn("own", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = quality_model.classify(docs, labels.where("own").drop("own")).join(labels.where("NOT own").withColumnRenamed("quality", "good"), "doc_id").collect()
    clean = [r["kept"] for r in got if r["good"] == 1 and r["toxic"] == 0]
    junk = [r["kept"] for r in got if r["good"] == 0]
    toxic = [r["kept"] for r in got if r["toxic"] == 1]
    print(f"kept of held-out rows: {np.mean(clean):.4f} of {len(clean)} clean, {np.mean(junk):.4f} of {len(junk)} junk, {np.mean(toxic):.4f} of {len(toxic)} toxic")
    assert np.mean(clean) > 0.97 and np.mean(junk) < 0.1 and np.mean(toxic) < 0.35


def test_words_weigh_alike_at_every_length():
    for n in (1, 7, 300, 50_000):
        slots = np.append(np.arange(n), quality_model.WORD_SLOTS + np.arange(3))
        values = quality_model.values_of(slots)
        assert np.isclose((values[:n] ** 2).sum(), quality_model.WORD_NORM**2) and (values[n:] == 1).all()


def test_rare_bad_texts_are_rejected(spark):
    """Insults in one text of 1,000, of more texts than the scorer is fitted on."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(2000)]
    rows = []
    for k in range(20_000):
        own = rng.choices(words, k=60)
        if k % 1000 == 7:
            own[::6] = rng.choices(["idiot", "moron", "scum", "vermin"], k=10)
        rows.append((k, " ".join(own)))
    got = quality_model.classify(spark.createDataFrame(rows, "doc_id long, text string"), fit_rows=4000).collect()
    planted = [r for r in got if r["doc_id"] % 1000 == 7]
    assert all(r["weak_bad"] > 0.9 and not r["kept"] for r in planted)
    assert np.mean([r["kept"] for r in got if r["doc_id"] % 1000 != 7]) > 0.99


# token files ----------------------------------------------------------------------------------------------------------------------
@given(st.lists(st.integers(0, 9), max_size=60), st.integers(1, 12))
@settings(max_examples=12, deadline=None)
def test_separator_scan_stitches_blocks(spark, tokens, size):
    data = np.array([token_files.END if t == 0 else t for t in tokens], "<u2").tobytes()
    rows = [("f", k, bytearray(data[i : i + 2 * size])) for k, i in enumerate(range(0, len(data), 2 * size))]
    got = sorted((r["doc_no"], r["start"], r["n_tokens"], r["ended"]) for r in token_files.scan_blocks(spark.createDataFrame(rows, "file string, block long, data binary")).collect())
    want, start = [], 0
    for i, t in enumerate(tokens):
        if t == 0:
            want.append((len(want), start, i - start, True))
            start = i + 1
    if start < len(tokens):
        want.append((len(want), start, len(tokens) - start, False))
    assert got == want


@pytest.mark.parametrize("width, block", [(2, 7), (2, 64), (4, 10), (2, 1 << 20)])
def test_raw_files_by_ranges(spark, tmp_path, width, block):
    """Blocks end anywhere, within tokens too."""
    rng = random.Random(block)
    want = {}
    for name in ("a.bin", "b.bin", "none.bin"):
        tokens = [] if name[0] == "n" else [token_files.END if rng.random() < 0.1 else rng.randrange(9) for _ in range(rng.randrange(50, 300))]
        (tmp_path / name).write_bytes(np.array(tokens, f"<u{width}").tobytes())
        counts, n = [], 0
        for t in tokens:
            if t == token_files.END:
                counts.append(n)
            n = 0 if t == token_files.END else n + 1
        want[name] = counts + ([n] if n else [])
    got = token_files.scan_blocks(token_files.read_flat(spark, f"file://{tmp_path}", width, block), width=width).collect()
    by = {name: [] for name in want}
    for r in sorted(got, key=lambda r: r["doc_no"]):
        by[r["file"].rsplit("/", 1)[1]].append(r["n_tokens"])
    assert by == want


def test_ids_of_any_type(spark, library):
    rows = [("a", "one two"), ("a", "three"), (None, "four"), ("b", None)]
    got = sorted(((r["key"], r["n_tokens"]) for r in token_files.count_tokens(spark.createDataFrame(rows, "key string, text string"), "key").collect()), key=str)
    assert got == sorted([(k, len(library.encode(t or "", add_special_tokens=False).ids)) for k, t in rows], key=str)


def test_token_counts(spark, docs, library):
    library.encode_special_tokens = True
    got = {r["doc_id"]: r["n_tokens"] for r in token_files.count_tokens(docs, block_bytes=4096).collect()}
    assert got == {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in rows_of(docs)}
    library.encode_special_tokens = False


# SimHash -----------------------------------------------------------------------------------------------------------------------------
def plain_fingerprint(text):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, ids, radius=2):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = root(i), root(j)
                parent[a] = b
    least = {}
    for k, i in enumerate(ids):
        least[root(k)] = min(i, least.get(root(k), i))
    return {i: least[root(k)] for k, i in enumerate(ids)}


def test_simhash_query_by_brute_force(spark, sf, docs):
    rows = rows_of(docs)
    fps = [plain_fingerprint(t) for _, t in rows]
    want = plain_components(fps, [i for i, _ in rows])
    got = {r["doc_id"]: r for r in queries.op6_simhash(spark, sf).collect()}
    assert {i: got[i]["component_id"] for i, _ in rows} == want
    assert all(got[i]["fingerprint"] == f"{f:016x}" for (i, _), f in zip(rows, fps, strict=True))


def near_ones(rng, n, spread):
    """Fingerprints around a few, and which bucket each is in."""
    fps, buckets = [], []
    for k in range(n):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 3, 70, 150])):
            flipped = base
            for _ in range(rng.randrange(spread)):
                flipped ^= 1 << rng.randrange(64)
            fps.append(flipped)
            buckets.append(k)
    return np.array(fps, np.uint64), np.array(buckets)


@pytest.mark.parametrize("radius", [1, 2, 3, 5])
@pytest.mark.parametrize("seed", range(5))
def test_bit_planes_count(seed, radius):
    """Of every distance: exactly the pairs of a bucket within the radius."""
    fps, buckets = near_ones(random.Random(seed), 9, 7)
    planes, n = simhash.planes_of(fps), len(fps)
    for d in (1, 2, 63, 64, 65, 100, 149):
        same = np.append(buckets[d:] == buckets[:-d], np.zeros(min(d, n), bool)) if d < n else np.zeros(n, bool)
        words, lanes = simhash.within(planes, simhash.lanes_of(same), d, radius, list(range(64)))
        got = {int(w) * 64 + b for w, x in zip(words, lanes, strict=True) for b in range(64) if int(x) >> b & 1}
        assert got == {i for i in range(n - d) if same[i] and (int(fps[i]) ^ int(fps[i + d])).bit_count() <= radius}


def test_every_pair_goes_through_the_planes(monkeypatch):
    """Buckets of all sizes: each pair of a bucket is a lane of one comparison, and nothing else decides on it."""
    fps, buckets = near_ones(random.Random(9), 12, 7)
    asked, plain = Counter(), simhash.within

    def within(planes, lanes, d, *rest):
        asked.update((w * 64 + b, w * 64 + b + d) for w, x in enumerate(lanes) for b in range(64) if int(x) >> b & 1)
        return plain(planes, lanes, d, *rest)

    monkeypatch.setattr(simhash, "within", within)
    edges = simhash.forest(fps, buckets, 2)
    assert asked == Counter((i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if buckets[i] == buckets[j])
    monkeypatch.setattr(simhash, "within", lambda *a: (np.zeros(0, int), np.zeros(0, np.uint64)))
    assert len(edges) and not len(simhash.forest(fps, buckets, 2))


def test_buckets_cross_batches():
    import pyarrow as pa

    rng = random.Random(4)
    fps = sorted({rng.getrandbits(16) for _ in range(900)})
    rows = sorted((simhash.signed(m), simhash.signed(f & m), f) for m in simhash.finer(0, 2) for f in fps)
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[a : a + 37], strict=True)], names=["mask", "part", "fp"]) for a in range(0, len(rows), 37)]
    got = [r for size in (10, 1 << 15) for r in [sorted((e["u"], e["v"]) for b in simhash.compare_buckets(iter(batches), 2, size) for e in b.to_pylist())]]
    assert all((u ^ v).bit_count() <= 2 for u, v in got[0])
    assert plain_components(fps, fps) == joined(fps, got[0]) == joined(fps, got[1])


def joined(fps, edges):
    parent = {f: f for f in fps}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for u, v in edges:
        a, b = root(u), root(v)
        parent[max(a, b)] = min(a, b)
    return {f: root(f) for f in fps}


def test_fingerprint_of_pieces(monkeypatch):
    text = " ".join(f"w{k * k % 97}" for k in range(500)) + "\x0b\u00a0é end"
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash.pieces, "__defaults__", (40,))
    assert simhash.fingerprint(text.encode()) == whole == plain_fingerprint(text)
    assert simhash.fingerprint(b" " * 300) == 0 and simhash.fingerprint(b" " * 90 + b"a" + b" " * 90 + b"B") == plain_fingerprint("a b")


@pytest.mark.parametrize("radius, limit", [(1, 3), (1, 2048), (2, 3), (2, 2048), (3, 2048)])
def test_large_buckets_lose_no_link(spark, limit, radius):
    rng = random.Random(limit)
    fps = {rng.getrandbits(64) for _ in range(40)}
    base = [rng.getrandbits(64) for _ in range(3)]
    for b in base:
        fps |= {b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(90)}
    fps = sorted(fps)
    signed = [simhash.signed(f) for f in fps]
    edges = simhash.link_edges(spark.createDataFrame([(f,) for f in signed], "fp long"), radius, limit).collect()
    assert all(((e["u"] ^ e["v"]) & (1 << 64) - 1).bit_count() <= radius for e in edges)
    assert joined(signed, [(e["u"], e["v"]) for e in edges]) == plain_components(fps, signed, radius)


def test_null_ids_link_others(spark):
    same = "a text that three rows have in common"
    rows = [(None, same), (7, same), (9, same), (None, "alone"), (None, None), (3, "")]
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(None, 7), (7, 7), (9, 7), (None, None), (None, 3), (3, 3)], key=str)


def test_one_of_each_group_stays(odd):
    kept = [r["doc_id"] for r in simhash.keep_one(odd).collect()]
    assert kept.count(6) == 0 and kept.count(5) == 2 and None in kept and 4 in kept


# mixing -----------------------------------------------------------------------------------------------------------------------------
def test_mixing_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    same_rows(queries.op7_mixing(spark, sf), con.execute(queries.oracle_sql()["op7_mixing"]))


def test_mixing_reaches_targets(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(1, 60), None if i % 11 == 0 else "hot" if i % 3 else f"s{i % 5}") for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    total = sum(r["size"] for r in got)
    by = {}
    for r in got:
        own = by.setdefault(r["source"], [0, r["target"], r["source_size"]])
        own[0] += r["taken"]
    assert sum(t for _, t, _ in by.values()) == pytest.approx(total)
    assert all(abs(taken - target) <= 60 and target <= 3 * size + 1e-6 for taken, target, size in by.values())


def test_few_bins_change_nothing(docs):
    rows = lambda b: sorted((r["id"], r["taken"]) for r in mixing.mix(docs, bins=b).collect())
    assert rows(2) == rows(4096)


def test_rows_without_ids_and_ids_of_two_sources(spark):
    """Null ids are drawn by their texts, not as one block; an id with rows in two sources is taken as each source says."""
    rows = [(None, f"word {k}", "a" if k % 2 else "b") for k in range(400)] + [(k, "x y z", s) for k in range(100) for s in "ab"]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.mix(df).collect()
    assert len(plan) == len(rows) and {r["copies"] for r in plan if r["id"] is None and r["source"] == "b"} == {0, 1}
    taken = mixing.take(df).groupBy("source").agg(F.count("*").alias("n")).collect()
    assert {r["source"]: r["n"] for r in taken} == {s: sum(r["copies"] for r in plan if r["source"] == s) for s in "ab"}


def test_take_repeats_rows(docs):
    want = sum(r["copies"] for r in mixing.mix(docs).collect())
    got = mixing.take(docs)
    assert got.count() == want and got.columns == docs.columns


# language ID ---------------------------------------------------------------------------------------------------------------------
def test_language_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op8_langid(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    assert np.mean([r["lang"] == r["lang_pred"] for r in got if r["held_out"]]) > 0.97


def test_languages_of_a_mixture(docs):
    model = langid.fit(docs)
    pick = lambda lang: docs.where((F.col("lang") == lang) & (F.col("n_chars") > 1500)).orderBy("doc_id").first()["text"].encode()[:1500]
    label, score, found = model.predict([pick("de") + b" " + pick("es")])[0]
    assert found == "de,es" and label in ("de", "es") and 0.3 < score < 0.7
    assert [p[:2] for p in model.predict([b"", b"123 \xe2\x82\xac 45"])] == [("und", 0.0)] * 2


def best_set(model, text):
    """Every set of languages, by plain expectation-maximisation: the best likelihood less the penalty."""
    logs, _ = model.segments([text])
    like = np.exp(logs - logs.max(1, keepdims=True)).astype(float)
    out = (-np.inf, ())
    for mask in range(1, 1 << len(model.languages)):
        own = [j for j in range(len(model.languages)) if mask >> j & 1]
        share = np.full(len(own), 1 / len(own))
        for _ in range(3000):
            weighed = like[:, own] * share
            share = (weighed / (weighed.sum(1, keepdims=True) + 1e-300)).mean(0)
        value = np.log((like[:, own] * share).sum(1) + 1e-300).sum() + logs.max(1).sum() - langid.PENALTY * len(own)
        out = max(out, (value, tuple(model.languages[j] for j in own)))
    return out[1]


def test_language_sets_by_brute_force(docs):
    """Of one to all four languages: the same set as the best of all sets, however many it holds."""
    model = langid.fit(docs)
    rng = random.Random(5)
    by = {x: [r["text"].encode() for r in docs.where((F.col("lang") == x) & (F.col("n_chars") > 900)).orderBy("doc_id").limit(8).collect()] for x in model.languages}
    texts = [b" ".join(rng.choice(by[x])[: 64 * rng.randint(4, 9)] for x in rng.sample(model.languages, k)) for k in (1, 2, 3, 4) for _ in range(6)]
    sizes = set()
    for text, (_, score, found) in zip(texts, model.predict(texts), strict=True):
        assert tuple(found.split(",")) == best_set(model, text) and 0 < score <= 1
        sizes.add(found.count(",") + 1)
    assert len(model.languages) == 4 and sizes == {1, 2, 3, 4}


def test_a_score_depends_on_its_text_alone(docs, monkeypatch):
    model = langid.fit(docs)
    texts = [(r["text"] or "").encode() for r in docs.orderBy("doc_id").limit(60).collect()]
    together = model.predict(texts)
    assert [model.predict([t])[0] for t in texts] == together
    monkeypatch.setattr(langid, "SLICE", 128)
    for (a, x, c), (b, y, d) in zip(model.predict(texts), together, strict=True):
        assert (a, c) == (b, d) and abs(x - y) < 1e-4


# licenses ---------------------------------------------------------------------------------------------------------------------------
def test_licenses_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = queries.op9_licenses(spark, sf)
    assert got.count() > 0
    same_rows(got, con.execute(queries.oracle_sql()["op9_licenses"]))


def test_every_template_is_found_anywhere(spark):
    rng = random.Random(3)
    rows = []
    for k in range(40):
        name, text = licenses.TEMPLATES[k % len(licenses.TEMPLATES)]
        filler = lambda n: " ".join(f"w{rng.randrange(999)}" for _ in range(n))
        rows.append((k, f"{filler(rng.randrange(300))} {text.upper() if k % 2 else text}. {filler(rng.randrange(50))}", name))
    got = {(r["doc_id"], r["license"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, name string")).collect()}
    assert {(k, name) for k, _, name in rows} <= got
    assert licenses.band_guarantee() > 0.999


def test_rows_without_ids_are_scanned_by_themselves(spark):
    """Halves of a text in rows of one id, or of none, don't add up; whole texts in such rows count each."""
    text = dict(licenses.TEMPLATES)["mit-full"].split()
    half = len(text) // 2
    rows = [(i, " ".join(part)) for i in (None, 5) for part in (text[:half], text[half:])] + [(None, " ".join(text))] * 2 + [(5, " ".join(text))]
    got = [r["doc_id"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).where("license = 'mit-full'").collect()]
    assert sorted(got, key=str) == [5, None, None]


def test_license_plan_has_no_python(spark, docs):
    plan = licenses.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# quality rules ---------------------------------------------------------------------------------------------------------------------
def plain_rules(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    marked = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), sum(x in lines[:i] for i, x in enumerate(lines)), len(marked)


@given(st.text(alphabet="ab \n\t#|é\x0b ", max_size=80))
@settings(max_examples=200, deadline=None)
def test_rules_by_brute_force(text):
    assert quality_rules.base_counts(text.encode()) == plain_rules(text)


def test_rules_of_documents(spark, sf, docs):
    got = {r["doc_id"]: r for r in queries.op10_quality_rules(spark, sf).collect()}
    for i, text in rows_of(docs.where("n_chars < 4000")):
        r = got[i]
        want = plain_rules(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r["base_failed"] and r["kept"])


def test_bands():
    judge = quality_rules.Bands()
    rng = random.Random(1)
    prose = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(600)).encode()
    assert judge.judge(prose)[3] == "kept"
    assert judge.judge(b"spam " * 600)[3] == "repetitive"
    assert judge.judge(rng.randbytes(3000))[3] == "incompressible"
    assert judge.judge(prose + b"a" * 2000)[3] == "chunks"


def test_every_byte_is_in_a_chunk():
    """Noise behind the last full chunk counts, and so does that of a text of less than a chunk."""
    judge, rng = quality_rules.Bands(), random.Random(1)
    prose = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(600)).encode()
    assert judge.judge(prose[:1024] + rng.randbytes(511))[1:] == (2, 1, "chunks")
    assert judge.judge(prose[:1024] + rng.randbytes(63))[1] == 1 and judge.judge(prose[:500])[1:] == (1, 0, "kept")


@given(st.integers(0, 4000), st.integers(0, 99))
@settings(max_examples=60, deadline=None)
def test_bands_by_brute_force(n, seed):
    import zstandard

    rng = random.Random(seed)
    kinds = (rng.randbytes, lambda k: b"ab" * (k // 2), lambda k: " ".join(rng.choice(["some", "words", "of", "prose", "which", "vary"]) + str(rng.randrange(50)) for _ in range(k // 6)).encode())
    text = b"".join(rng.choice(kinds)(rng.randrange(1, 900)) for _ in range(6))[:n]
    ratio = lambda data: len(zstandard.ZstdCompressor(level=quality_rules.LEVEL, write_checksum=False, write_content_size=False).compress(data)) / len(data)

    def band(k, chunk):
        if chunk and k >= 1024:
            return quality_rules.CHUNK_BAND
        return next(((a, b) for start, a, b in reversed(quality_rules.BANDS) if k >= start), (0, 99))

    inside = lambda data, chunk: band(len(data), chunk)[0] <= ratio(data) <= band(len(data), chunk)[1]
    chunks = [text[i : i + 1024] for i in range(0, len(text), 1024)]
    if len(chunks) > 1 and len(chunks[-1]) < 64:
        chunks[-2:] = [chunks[-2] + chunks[-1]]
    bad = [c for c in chunks if not inside(c, True)]
    whole, n_chunks, n_bad, verdict = quality_rules.Bands().judge(text)
    assert (n_chunks, n_bad) == (len(chunks), len(bad))
    if not text:
        assert verdict == "empty"
    elif not inside(text, False):
        assert verdict == ("repetitive" if whole < band(len(text), False)[0] else "incompressible")
    else:
        assert verdict == ("chunks" if sum(map(len, bad)) > 0.25 * len(text) else "kept")
