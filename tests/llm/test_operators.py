"""The operators against brute force, exact round trips and held-out accuracy, with awkward rows."""

import gzip
import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from engramix.llm import decontamination, jpeg, language_id, media, near_duplicates, packing, pii, quality, queries, token_counts, token_files, warc
from engramix.llm.encoding import ChunkEncoder

SF = "/root/testdata/sf0.001"
WORD = public_tokenizers.path("word_bpe_49k.json")
PIECE = public_tokenizers.path("piece_bpe_32k.model")

rnd = random.Random(3)
COMMON = "the of and in to with a is that for was on are by it as he be from at one have this".split()
LONG = " ".join(rnd.choice(COMMON) + str(rnd.randint(0, 50)) for _ in range(9000))
AWKWARD = [None, "", " ", "\n\n", "a", "one two three", "é́x İstanbul ß 日本語 テキスト 😀", "<|endoftext|> <s> </s> <0x41>", "x" * 700, "  two  spaces\tand tabs\x00", LONG, LONG, "don't 's 't they're", "1 2 3 4 5 6 7 8 9 10 11 12", "▁mark ▁", "\x1c?e a\x1c, x\x1f! a\x1d;b \x1e."]


@pytest.fixture(scope="module")
def docs(spark):
    """Null ids and texts, empty and long texts, repeated rows, and columns with clashing names."""
    rows = [(i, t, "en", "s", i, "x", i) for i, t in enumerate(AWKWARD)]
    rows += [(rows[4]), (None, "a null id", "en", "s", 1, "x", 1), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string, label long").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def texts_of(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_token_counts(docs, empty):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    expected = sorted(((d, len(t.encode()), n := len(library.encode(t)), n > 4096) for d, t in texts_of(docs)), key=repr)
    assert rows(token_counts.token_counts(docs, PIECE)) == expected
    assert token_counts.token_counts(empty, PIECE).count() == 0


def test_merging_matches_the_library_on_random_texts():
    library, own = sentencepiece.SentencePieceProcessor(model_file=PIECE), token_counts.merge_counter(PIECE)
    texts = ["".join(rnd.choice("ab the\n ▁é<>s/日😀") for _ in range(rnd.randint(0, 60))) for _ in range(500)]
    texts += ["".join(rnd.choice("etaoinshr") for _ in range(n)) for n in (250, 300, 600)]
    assert own.count(texts) == [len(x) for x in library.encode(texts)]


def test_chunk_encoder_matches_whole_texts():
    own = ChunkEncoder(WORD)
    texts = [t or "" for t in AWKWARD] + ["".join(rnd.choice("aB the\n é́<|endoftext|>'sre日😀\x1c12,.!_²") for _ in range(rnd.randint(0, 60))) for _ in range(800)]
    ids, counts = own.encode(texts)
    expected = [e.ids for e in own.library.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == expected


def same_ids(own, texts):
    for i in range(0, len(texts), 20_000):
        part = texts[i : i + 20_000]
        ids, counts = own.encode(part)
        got = np.split(ids, np.cumsum(counts)[:-1])
        for t, x, e in zip(part, got, own.library.encode_batch(part, add_special_tokens=False), strict=True):
            assert x.tolist() == e.ids, repr(t)


def test_chunk_encoder_on_all_pairs_of_the_first_256_characters():
    own = ChunkEncoder(WORD)
    pairs = [chr(i) + chr(j) for i in range(256) for j in range(256)]
    same_ids(own, pairs)
    same_ids(own, ["e" + p + "S" for p in pairs])
    same_ids(own, [p + "x " + p[::-1] + "'s" for p in pairs[::7]])
    controls = "\x00\x1b\x1c\x1d\x1e\x1f\x7f\x85\xa0\xad"
    same_ids(own, [a + b + c for a in controls + "a1. " for b in controls + "a1.,'?" for c in controls + "a1.;"])


def test_chunk_encoder_on_random_texts():
    draw = random.Random(17)
    latin, more = [chr(i) for i in range(256)], list("aeTs .,'!?-_1\x1c\x1f\n日é́²ß<|Σσ")
    same_ids(ChunkEncoder(WORD), ["".join(draw.choices(latin if draw.random() < 0.5 else more, k=draw.randint(0, 24))) for _ in range(50_000)])


def test_token_files(docs, empty):
    library = Tokenizer.from_file(WORD)
    ids = {}
    for d, t in texts_of(docs):
        ids.setdefault(d, []).append(np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4"))
    got = sorted(token_files.token_files(docs, WORD).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((d for d, x in ids.items() for _ in x), key=lambda d: (d is not None, d))
    at = 0
    for r in got:
        assert r["start"] == at and (r["n_tokens"], r["ids_crc32"]) in {(len(x), zlib.crc32(x)) for x in ids[r["doc_id"]]}
        at += r["n_tokens"]
    assert token_files.token_files(empty, WORD).count() == 0


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 31])
def test_bit_packing(bits):
    values = np.array([rnd.randrange(1 << bits) for _ in range(1000)], np.uint32)
    assert len(token_files.pack(values, bits)) == -(-1000 * bits // 8)
    assert (token_files.unpack(token_files.pack(values, bits), bits, 1000) == values).all()


def test_random_access(tmp_path):
    import pyarrow as pa

    values = np.array([rnd.randrange(40_000) for _ in range(30_000)], np.uint32)
    with open(tmp_path / "f", "wb") as f:
        w = token_files.TokenWriter(f, 16)
        for i in range(0, 30_000, 777):
            w.add(pa.array([i]), values[i : i + 777], np.array([len(values[i : i + 777])]))
        w.close(pa.int64())
    reader = token_files.TokenReader(pa.OSFile(str(tmp_path / "f"), "rb"))
    for first, n in ((0, 1), (8191, 2), (8000, 20_000), (29_999, 1), (5, 0)):
        assert (reader.tokens(first, n) == values[first : first + n]).all()
    assert reader.doc_ids.to_pylist() == list(range(0, 30_000, 777))


def test_packing(spark, docs, empty):
    library = Tokenizer.from_file(WORD)
    for frame in (docs, spark.read.parquet(f"{SF}/documents.parquet")):
        expected = sorted((repr(d), zlib.crc32(np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4"))) for d, t in texts_of(frame))
        got = packing.pack_documents(frame, WORD).collect()
        sequences, whole = defaultdict(list), []
        for r in got:
            sequences[r["sequence_id"]].append((r["offset"], r["length"]))
            if r["length"] == r["doc_tokens"]:
                whole.append((repr(r["doc_id"]), r["ids_crc32"]))
        for s in sequences.values():
            at = 0
            for offset, n in sorted(s):
                assert offset == at
                at += n
            assert at <= 4096
        assert set(whole) <= set(expected)
        by = defaultdict(int)
        for r in got:
            by[r["doc_id"]] += r["length"]
        assert sum(by.values()) == sum(len(library.encode(t, add_special_tokens=False).ids) + 1 for _, t in texts_of(frame))
    fill = [sum(n for _, n in s) for s in sequences.values()]
    assert sum(4096 - f for f in fill if f & (f - 1)) < 0.05 * sum(fill)
    assert packing.pack_documents(empty, WORD).count() == 0


def test_patterns_cover_the_demand():
    histogram = {s: rnd.randint(1, 400) for s in rnd.sample(range(1, 50), 40)}
    made = packing.patterns(histogram, 128)
    held = defaultdict(int)
    for pattern, times in made:
        assert sum(s * n for s, n in pattern.items()) <= 128
        for s, n in pattern.items():
            held[s] += n * times
    assert all(held[s] >= n for s, n in histogram.items())
    assert sum(t for _, t in made) <= 1.02 * sum(s * n for s, n in histogram.items()) / 128 + 2
    assert packing.patterns({}, 128) == []


def test_media(docs, empty):
    got = media.media_columns(docs, with_media=True).collect()
    expected = sorted((repr(d), len(t.encode()), hashlib.sha256(media.payload(t.encode()).tobytes()).hexdigest(), zlib.crc32(media.payload(t.encode()).tobytes()[-64:])) for d, t in texts_of(docs))
    assert sorted((repr(r["doc_id"]), r["n_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == expected
    for r in got:
        assert r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest() and r["media"][:2] == b"\xff\xd8" and r["media"][-2:] == b"\xff\xd9"
        assert len(r["thumbnail"]) == r["width"] * r["height"] // 64 >= r["payload_bytes"] // 64
    assert media.media_columns(empty).count() == 0


def test_jpeg_round_trip_of_any_bytes():
    cases = [bytes(1000), b"\xff" * 500, rnd.randbytes(5000), bytes(rnd.choice([0] * 60 + [7, 255]) for _ in range(9000)), b"ab" * 400_000]
    for case, (data, *_) in zip(cases, media.features(media.stored(cases)), strict=True):
        assert data == media.payload(case).tobytes()


def test_decoder_reads_several_components_without_restarts():
    """Two chroma components at half the size, one interval: built from the encoder's tables by hand."""
    dc, ac = jpeg._DC, jpeg._AC
    bits = ""
    values = []
    before = [0, 0, 0]
    for _mcu in range(6):
        for c in (0, 0, 0, 0, 1, 2):
            v = rnd.randint(-100, 100)
            d = v - before[c]
            before[c] = v
            n = abs(d).bit_length()
            bits += f"{dc[2][n]:0{dc[3][n]}b}" + (f"{d if d > 0 else d + (1 << n) - 1:0{n}b}" if n else "") + f"{ac[2][0]:0{ac[3][0]}b}"
            values.append((c, v))
    bits += "1" * (-len(bits) % 8)
    data = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0")
    seg = jpeg._segment
    file = b"\xff\xd8" + seg(0xDB, b"\0" + bytes([8] * 64)) + seg(0xC0, b"\x08\0\x20\0\x30\x03\x01\x22\0\x02\x11\0\x03\x11\0") + seg(0xC4, b"\0" + dc[0] + dc[1]) + seg(0xC4, b"\x10" + ac[0] + ac[1]) + seg(0xDA, b"\x03\x01\0\x02\0\x03\0\0\x3f\0") + data + b"\xff\xd9"
    ((image, coefficients),) = jpeg.decode([file])
    assert coefficients[:, 0].tolist() == [v for _, v in values]
    thumb = jpeg.thumbnail(image, coefficients)
    assert thumb.shape == (4, 6)
    luma = [v + 128 for c, v in values if c == 0]
    assert thumb[:2, :2].reshape(-1).tolist() == luma[:4] and thumb[2:, 4:].reshape(-1).tolist() == luma[20:24]


def brute_contamination(docs, items, width=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    windows = defaultdict(set)
    for item, text in items:
        w = word.findall((text or "").translate(lower))
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows[tuple(w[i : i + width])].add(str(item))
    for d, t in docs:
        w, hit, found = word.findall(t.translate(lower)), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[k]
        yield d, len(w), len(hit), sorted(found)


def test_contamination(spark, docs, empty):
    items = [(1, "one two three"), (2, " ".join(LONG.split()[100:130])), (10, " ".join(LONG.split()[110:125])), (3, None), (4, "..."), (5, "1 2 3 4 5 6 7 8 9 10 11"), (5, "日本語"), (None, "a")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    keep = [x for x in items if x[0] is not None]
    got = decontamination.contamination(docs, bench)
    assert rows(got.select("doc_id", "n_words", "n_hit", "items")) == sorted(brute_contamination(texts_of(docs), keep), key=repr)
    assert rows(decontamination.contamination(docs, bench.limit(0)).select("n_hit").distinct()) == [(0,)]
    assert decontamination.contamination(empty, bench).count() == 0
    near = decontamination.proximity(decontamination.build_index(docs), bench.where("item_id = 1"), slop=2)
    assert rows(near) == [(5, "1", 1)]


def test_contamination_on_the_table(spark):
    d, b = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    expected = sorted((*x[:3], len(x[3]), hashlib.sha256(",".join(x[3]).encode()).hexdigest(), x[2] > 0) for x in brute_contamination(texts_of(d), [(r["item_id"], r["text"]) for r in b.collect()]))
    assert rows(queries.op1_decontamination(spark, SF)) == sorted(expected, key=repr)


def brute_proximity(docs, items, slop=20, width=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    windows = defaultdict(set)
    for item, text in items:
        w = word.findall((text or "").translate(lower))
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows[tuple(w[i : i + width])].add(str(item))
    for d, t in docs:
        w, n = word.findall(t.translate(lower)), defaultdict(int)
        for x, owners in windows.items():
            if set(x) <= set(w) and any(set(x) <= set(w[i : i + len(x) + slop]) for i, own in enumerate(w) if own in x):
                for o in owners:
                    n[o] += 1
        yield d, n


def test_proximity_of_whole_items(spark, monkeypatch):
    b = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text")
    items = [(r["item_id"], r["text"]) for r in b.collect()]
    texts = [t for _, t in items if len(set(t.split())) > 41]
    assert texts
    shuffled = [" ".join(" ".join(rnd.sample(w, len(w))) for w in (x[i : i + 10] for i in range(0, len(x), 10))) for x in (t.split() for t in texts[:8])]
    apart = [" ".join(f"{w} gap{i} gap{i + 1}" for i, w in enumerate(t.split())) for t in texts[:8]]
    far = [" ".join(f"{w} " + "gap " * 4 for w in t.split()) for t in texts[:4]]
    rows_ = list(enumerate([*(t for _, t in items), *shuffled, *apart, *far, "", None]))
    frame = spark.createDataFrame(rows_, "doc_id long, text string").repartition(3)
    for slop, places in ((20, 1 << 20), (3, 50)):
        monkeypatch.setattr(decontamination, "NEAR_PLACES", places)
        expected = sorted(((d, i, n) for d, found in brute_proximity([(d, t or "") for d, t in rows_], items, slop) for i, n in found.items()), key=repr)
        got = rows(decontamination.proximity(decontamination.build_index(frame), b, slop))
        assert got == expected
        assert {(d, str(i)) for d, (i, _) in enumerate(items)} <= {x[:2] for x in got}


def test_proximity_query(spark):
    near = {r["doc_id"]: r for r in queries.op1_proximity(spark, SF).collect()}
    exact = queries.op1_decontamination(spark, SF).collect()
    assert len(near) == len(exact) and all(near[r["doc_id"]]["n_items"] >= r["n_items"] for r in exact)


def brute_near(docs, width, percent=80):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for d, t in docs:
        w = word.findall(t.translate(lower))
        sets.append((d, {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()))
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (d, x) in enumerate(sets):
        for j, (e, y) in enumerate(sets[:i]):
            if x and y and d is not None and e is not None and 100 * len(x & y) >= percent * len(x | y):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    for i, (d, x) in enumerate(sets):
        c = None if d is None else least[root(i)]
        yield d, len(x), c, d is None or c == d


def test_near_duplicates(spark, docs, empty):
    base = [rnd.choice(COMMON) + str(rnd.randint(0, 9)) for _ in range(150)]
    more = []
    for i in range(60):
        w = list(base)
        for _ in range(rnd.randint(0, 6)):
            w[rnd.randrange(len(w))] = "edit" + str(rnd.randint(0, 99))
        more.append((100 + i, " ".join(w)))
    frame = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    for width in (4, 5):
        assert rows(near_duplicates.near_duplicates(frame, width=width)) == sorted(brute_near(texts_of(frame), width), key=repr)
    assert near_duplicates.near_duplicates(empty).count() == 0


def test_near_duplicates_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK_SETS", 8)
    base = [f"w{i}" for i in range(120)]
    chain = [(i, " ".join(base[2 * i : 2 * i + 60])) for i in range(30)]
    frame = spark.createDataFrame(chain, "doc_id long, text string")
    assert rows(near_duplicates.near_duplicates(frame, width=4)) == sorted(brute_near(chain, 4), key=repr)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 105), (105, 103), (7, 7)]
    got = near_duplicates.components(spark.createDataFrame(edges, "a long, b long"), "test")
    assert dict(rows(got)) == {i: 0 for i in range(41)} | {100: 100, 103: 100, 105: 100}


def test_warc(spark):
    pages = [(1, "http://a/\r\nX: y", "x" * 1500, 1), (5, "u", "x" * 1500, 1), (3, None, "x" * 1500, 1), (4, "u", "small", 1), (6, "u", "small", 1), (7, "u", None, 1), (None, "u", "x" * 1500, 1), (8, "u", "é" * 1_500_000, 1), (9, "u", "q" * 1000, 1), (9, "u", "q" * 1000, 1)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string, digest int")
    expected = []
    for i, _, h, _ in pages:
        b = (h or "").encode()
        last = max((j for j, _, g, _ in pages if g == h and j is not None), default=None)
        to = last if len(b) >= 1000 and last != i else None
        expected.append((i, len(b), hashlib.sha1(b).hexdigest(), "response" if to is None else "revisit", to))
    folder = warc.scratch(spark, "warc")
    manifest = warc.write_archives(warc.classify(frame), folder)
    chunks = warc.read_archives(manifest, frame.schema["page_id"].dataType, with_data=True)
    got = chunks.where("is_last").select("page_id", "payload_bytes", "digest_so_far", "record_type", "refers_to")
    assert rows(got) == sorted(expected, key=repr)
    big = chunks.where("page_id = 8").orderBy("chunk").collect()
    assert len(big) == 3 and b"".join(r["data"] for r in big) == ("é" * 1_500_000).encode()
    for r in manifest.collect():
        with gzip.open(r["path"].removeprefix("file:"), "rb") as f:
            assert f.read(9) == b"WARC/1.1\r"
    assert warc.archive(frame.limit(0)).count() == 0


def test_warc_against_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    assert rows(queries.op6_warc(spark, SF)) == sorted(db.execute(queries.ORACLE_SQL["op6_warc"]).fetchall(), key=repr)


BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(d):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_pii(t):
    out = []
    for no, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 12 <= len(d) <= 19 and luhn(d) or kind == "phone" and 9 <= len(d) <= 15:
                out.append((m.start(), no, m.end(), kind))
    return sorted(out)


def test_pii(spark, docs, empty):
    parts = ["a", "b@", "c.d", "@x.y", "1.2.3.4", "255", "256", "00.0255", " ", "-", "+", "4111 1111 1111 1111", "4111111111111111", "+1 (202) 555-0143", ".", "é", "😀", "_", "x@y.z_w@v.u", "@", "9", "0", "\n"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(1500)]
    texts += ["1" * 20_000, "a" * 20_000 + "@", "1 " * 20_000, "a." * 9000 + "@b" + ".c" * 9000, "4" * 16]
    frame = docs.select("doc_id", "text", "label").unionByName(spark.createDataFrame([(1000 + i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, label long"))
    expected = []
    for d, t in texts_of(frame):
        spans = brute_pii(t)
        digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in spans).encode()).hexdigest()
        expected.append((d, *(sum(s[1] == i for s in spans) for i in range(4)), digest))
    assert rows(pii.pii_digests(frame).drop("spans")) == sorted(expected, key=repr)
    assert pii.pii_digests(empty).count() == 0


def test_pii_added_kinds_and_redaction(spark):
    text = "mail me@x.org or call +1 (202) 555-0143; iban DE89 3704 0044 0532 0130 00, bad DE88 3704 0044 0532 0130 00; my ssn 123-45-6789 not 123-45-6789 1.2.3.4"
    frame = spark.createDataFrame([(1, text, "x"), (2, None, None)], "doc_id long, text string, other string")
    spans = pii.pii_digests(frame).where("doc_id = 1").first()["spans"].split(",")
    found = [(s.split(":")[0], text[int(s.split(":")[1]) : int(s.split(":")[2])]) for s in spans]
    assert found == [("email", "me@x.org"), ("phone", "+1 (202) 555-0143"), ("iban", "DE89 3704 0044 0532 0130 00"), ("ssn", "123-45-6789"), ("ip", "1.2.3.4")]
    out = dict((r["doc_id"], r["text"]) for r in pii.redact_documents(frame).collect())
    assert out[2] is None and out[1].startswith("mail [EMAIL] or call [PHONE]; iban [IBAN], bad DE88") and "my ssn [SSN] not 123-45-6789 [IP]" in out[1]


def test_pii_accounts_beside_capitals_and_digits(spark):
    de, gb, no, ours = "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "NO93 8601 1117 947", "ZZ32 0000 1111 2222 33"
    cases = [
        (f"{de} Please pay", [de]), ("DE89370400440532013000 Thanks", ["DE89370400440532013000"]), (f"{de} BIC COBADEFF", [de]), (f"{de} 2024-01-01", [de]), (f"{de} A", [de]),
        (f"{de} {gb} {no} é {de}", [de, gb, no, de]), (f"é😀 AB12 {de} 7", [de]), (f"{no} 12 34 X {ours} OK", [no, ours]), (f"{de}x {de}0", []), ("DE88 3704 0044 0532 0130 00 Please", []),
    ]
    turned = ours.replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in turned[4:] + turned[:4])) % 97 == 1
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    spans = {r["doc_id"]: [s.split(":") for s in r["spans"].split(",") if s.startswith("iban")] for r in pii.pii_digests(frame).collect()}
    out = {r["doc_id"]: r["text"] for r in pii.redact_documents(frame).collect()}
    for i, (t, found) in enumerate(cases):
        assert [t[int(a) : int(b)] for _, a, b in spans[i]] == found, t
        for x in found:
            t = t.replace(x, "[IBAN]", 1)
        assert out[i] == t


def test_pii_lists_of_numbers(spark):
    cases = {
        "SSN: 123-45-6789, 234-56-7890": "SSN: [SSN], [SSN]", "ssn 123-45-6789; 234-56-7890 and 345-67-8901.": "ssn [SSN]; [SSN] and [SSN].", "ssn 000-45-6789, or 234-56-7890": "ssn 000-45-6789, or [SSN]",
        "ssn 123-45-6789 order 234-56-7890, 345-67-8901": "ssn [SSN] order 234-56-7890, 345-67-8901", "123-45-6789, 234-56-7890": "123-45-6789, 234-56-7890",
    }
    frame = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    assert [r["text"] for r in pii.redact_documents(frame).orderBy("doc_id").collect()] == list(cases.values())
    assert [r["spans"].count("ssn") for r in pii.pii_digests(frame).orderBy("doc_id").collect()] == [x.count("[SSN]") for x in cases.values()]


def test_pii_stays_in_sql(docs):
    plan = docs.sparkSession._jvm.PythonSQLUtils.explainString(pii.pii_digests(docs)._jdf.queryExecution(), "simple")
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan.replace("Exchange RoundRobin", "")


def test_language_id(spark, docs, empty):
    got = queries.op10_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.95 * len(held)
    model = language_id.train(spark.read.parquet(f"{SF}/documents.parquet"), queries.remainder(4) != 2)
    own = {r["doc_id"]: r for r in language_id.identify(docs, model).collect() if r["doc_id"] is not None}
    assert own[0]["lang_pred"] == own[1]["lang_pred"] == own[13]["lang_pred"] == "und"
    assert all(0 <= r["score"] <= 1 for r in own.values())
    assert language_id.identify(empty, model).count() == 0
    none = language_id.train(docs, F.lit(False))
    assert {r["lang_pred"] for r in language_id.identify(docs, none).collect()} == {"und"}


def test_quality(spark, docs, empty):
    sf = "/root/testdata/sf0.01"
    got = queries.op3_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    good, bad = [r["score"] for r in held if r["quality"] == 1], [r["score"] for r in held if r["quality"] == 0]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.95
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in got)
    labels = spark.createDataFrame([(1, 1), (4, 0), (None, 1), (6, None)], "doc_id long, quality int")
    machine = quality.train(docs, labels, F.lit(True))
    assert len({r["doc_id"] for r in quality.score(docs, machine).collect()}) == len(AWKWARD) + 1
    assert quality.score(empty, machine).count() == 0
    blank = quality.train(docs, labels.limit(0), F.lit(True))
    assert all(0 <= r["score"] <= 1 for r in quality.score(docs, blank).collect())


def test_factorisation_identity():
    draw = np.random.default_rng(1)
    machine = quality.Machine(0.1, draw.normal(size=100_000).astype(np.float32), draw.normal(size=(100_000, 4)).astype(np.float32))
    ids, x = np.array([3, 70_000, 9, 44]), np.array([0.5, 0.2, 1.0, 0.3], np.float32)
    pairs = sum(float(machine.factors[ids[i]] @ machine.factors[ids[j]]) * x[i] * x[j] for i in range(4) for j in range(i))
    raw = 0.1 + float(machine.weights[ids] @ x) + pairs
    assert machine.score([(ids, x)])[0] == pytest.approx(1 / (1 + np.exp(-raw)), rel=1e-4)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, held = held, stage(spark, held, SF).persist()
        assert held.columns == docs.columns and held.dtypes == docs.dtypes, name
        assert set(r["doc_id"] for r in held.collect()) <= set(r["doc_id"] for r in before.collect())
        if name == "MinHash near-dedup":
            expected = {x[0] for x in brute_near(texts_of(before), 5) if x[3]}
            assert {r["doc_id"] for r in held.collect()} == expected
        if name == "benchmark decontamination":
            bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert {r["doc_id"] for r in held.collect()} == {x[0] for x in brute_contamination(texts_of(before), bench) if not x[2]}
        if name == "PII":
            assert not any(brute_pii(t) for _, t in texts_of(held))
    packed = corpus_pipeline.STAGES[-1][1](spark, held, SF)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in held.collect()}


def test_pipeline_survives_awkward_rows(spark, docs):
    held = docs.select(*corpus_pipeline.COLUMNS)
    for _, stage in corpus_pipeline.STAGES[1:]:
        held = stage(spark, held, SF)
    assert held.count() > 10
