"""Operators on what the first tests leave out: hot groups, several blocks, long sequences, independent decoders and exact scores."""

import random
import resource
import subprocess
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from engramix.llm import common, decontamination, jpeg, language_id, media, near_duplicates, packing, quality, queries, token_counts
from test_operators import PIECE, SF, WORD, brute_contamination, brute_near, rows

rnd = random.Random(29)


# Token counts


def test_long_sequences_merge_as_the_library_does():
    library, own = sentencepiece.SentencePieceProcessor(model_file=PIECE), token_counts.merge_counter(PIECE)
    pieces = [p for i in range(3, library.get_piece_size()) if 1 < len(p := library.id_to_piece(i).replace("▁", "")) < 12 and not p.startswith("<")]
    texts = ["".join(rnd.choice(pieces) for _ in range(n)) for n in (60, 150, 400, 1200)]
    texts += ["".join(rnd.choice("etaoinshrdlu") for _ in range(n)) for n in (257, 1000, 5000)]
    texts += ["a" * n for n in (255, 256, 257, 1023, 3000)] + ["ab" * 900, "abab aab" * 300, "日本語テキスト" * 400, "=" * 999, "th" * 500 + "e" * 500]
    texts += ["".join(rnd.choice(["the", "he", "t", "an", "and", "n", "d", "ing", "in", "g"]) for _ in range(700)) for _ in range(20)]
    texts += ["".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 12))) for _ in range(3000)]
    assert own.count(texts) == [len(x) for x in library.encode(texts)]


# Packing


@pytest.mark.parametrize("length", [4096, 64])
def test_pieces_are_those_of_the_library(spark, length):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    library = Tokenizer.from_file(WORD)
    got = {}
    for r in packing.pack_documents(frame, WORD, length=length).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for r in frame.collect():
        ids = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for p in sorted(got.pop(r["doc_id"]), key=lambda p: p["start"]):
            assert (p["start"], p["doc_tokens"]) == (at, len(ids)) and 0 < p["length"] <= length
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]])
            at += p["length"]
        assert at == len(ids)
    assert not got


def program(histogram, room):
    sizes = np.array(sorted(histogram), np.int64)
    made = packing.Program(sizes, np.array([histogram[int(s)] for s in sizes], float), room)
    first = made.total()
    made.solve()
    return made, first


def test_columns_enter_and_meet_the_bound_on_the_table(spark):
    lengths = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sizes = packing.pieces(lengths, WORD, 4096, 2).select(F.ceil(F.col("length") / 4).cast("long").alias("s")).groupBy("s").count().collect()
    made, first = program({r["s"]: r["count"] for r in sizes}, 1024)
    assert made.entered > 0 and made.total() < first
    assert np.ceil(made.total() - 1e-6) <= np.ceil(made.bound - 1e-6) or made.total() <= made.bound * (1 + packing.GAP)
    assert ((made.columns * made.sizes[:, None]).sum(axis=0) <= 1024).all()
    assert np.allclose((made.columns * made.x).sum(axis=1), made.demand, atol=1e-6)


def test_programs_reach_the_optimum():
    """Cutting stock with known best numbers of sequences."""
    for histogram, room, best in (({3: 100}, 10, 34), ({45: 97, 36: 610, 31: 395, 14: 211}, 100, 453), ({6: 30, 5: 30, 4: 30}, 15, 30), ({7: 4}, 7, 4)):
        made, _ = program(histogram, room)
        assert made.total() <= best + 1e-6
        used = packing.patterns(histogram, room)
        assert best <= sum(t for _, t in used) <= best + 1
        assert all(sum(n.get(s, 0) * t for n, t in used) >= d for s, d in histogram.items())


# Media


def plain_decode(file):
    """Coefficients of a single-component baseline file, bit by bit."""
    i, tables, interval = 2, {}, 0
    while True:
        marker, n = file[i + 1], int.from_bytes(file[i + 2 : i + 4], "big")
        body = file[i + 4 : i + 2 + n]
        i += 2 + n
        if marker == 0xC4:
            while body:
                codes, code, k = {}, 0, 17
                for size in range(1, 17):
                    for _ in range(body[size]):
                        codes[size, code] = body[k]
                        code, k = code + 1, k + 1
                    code <<= 1
                tables[body[0] >> 4] = codes
                body = body[k:]
        elif marker == 0xDD:
            interval = int.from_bytes(body, "big")
        elif marker == 0xDA:
            break
    parts, held = [], bytearray()
    while True:
        if file[i] == 0xFF and file[i + 1] != 0:
            parts.append(bytes(held))
            held = bytearray()
            if file[i + 1] == 0xD9:
                break
            i += 2
        else:
            held.append(file[i])
            i += 1 + (file[i] == 0xFF)
    blocks = []
    for part in parts:
        bits, at, before = "".join(f"{b:08b}" for b in part), 0, 0

        def symbol(codes):
            nonlocal at
            for size in range(1, 17):
                if (found := codes.get((size, int(bits[at : at + size], 2)))) is not None:
                    at += size
                    return found
            raise AssertionError("no code")

        def value(size):
            nonlocal at
            x = int(bits[at : at + size], 2) if size else 0
            at += size
            return x if not size or x >> (size - 1) else x - (1 << size) + 1

        for _ in range(interval):
            block, k = [0] * 64, 1
            before += value(symbol(tables[0]))
            block[0] = before
            while k < 64:
                s = symbol(tables[1])
                if s == 0:
                    break
                k += s >> 4
                if s & 15:
                    block[k] = value(s & 15)
                k += 1
            blocks.append(block)
    return blocks


def test_media_files_by_an_independent_decoder(spark):
    texts = ["", "a", "x" * 64, "é日😀" * 40, "\x00\x7f" * 70, " ".join(rnd.choice(["alpha", "beta", "ÿ", "\n"]) for _ in range(300)), "\xff" * 100]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in media.media_columns(frame, with_media=True).collect():
        raw = texts[r["doc_id"]].encode()
        padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        blocks = plain_decode(r["media"])
        assert len(blocks) * 64 == r["width"] * r["height"] // 64 * 64 and r["payload_bytes"] == len(padded)
        assert bytes((x + 128 if k == 0 else x) for b in blocks[: len(padded) // 64] for k, x in enumerate(b)) == padded
        dc = [min(255, max(0, (8 * b[0] + 4) // 8 + 128)) for b in blocks]
        assert list(r["thumbnail"]) == dc
        across, down = r["width"] // 8, r["height"] // 8
        cells = [dc[(y * down // 8) * across + x * across // 8] for y in range(8) for x in range(8)]
        bits = "".join("1" if 64 * c > sum(cells) else "0" for c in cells)
        assert r["feature"] == f"{r['width']}x{r['height']}:{int(bits, 2):016x}"


def test_groups_of_intervals_give_the_same(monkeypatch):
    cases = [bytes(rnd.choice(b"abc \n\xff\0") for _ in range(n)) for n in (0, 10, 64, 5000, 20_001)]
    files = media.stored(cases)
    whole = [(d, w, h, t.tobytes()) for d, w, h, t in media.features(files)]
    monkeypatch.setattr(jpeg, "GROUP", 7)
    assert [(d, w, h, t.tobytes()) for d, w, h, t in media.features(files)] == whole


def test_a_very_long_text_takes_bounded_memory():
    """64 MB of repeated words: memory in proportion to the text, less than 16 bytes a byte."""
    code = "import resource\nfrom engramix.llm import media\nbefore = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\ntext = b'some words of a long text ' * (64_000_000 // 26)\n(data, *_), = media.features(media.stored([text]))\nassert data.rstrip(b'\\0') == text\nprint((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) * 1024 / len(text))"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=600, cwd=corpus_pipeline.__file__.rsplit("/", 1)[0])
    assert done.returncode == 0, done.stderr
    assert float(done.stdout) < 16


# Near duplicates


def edited(base, most, n, first):
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rnd.randint(1, most)):
            w[rnd.randrange(len(w))] = f"edit{rnd.randint(0, 10**6)}"
        out.append((first + i, " ".join(w)))
    return out


def test_a_large_group_of_near_copies_is_one_component(spark):
    """3,000 copies of one origin, up to five edits each; many pairs of them are less than similar, all are near the origin."""
    base = [f"w{i}" for i in range(200)]
    copies = edited(base, 5, 3000, 10) + [(5, " ".join(base))] + [(4000 + i, " ".join(f"o{i}{j}" for j in range(50))) for i in range(200)]
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates.near_duplicates(spark.createDataFrame(copies, "doc_id long, text string").repartition(6), width=4).collect()}
    assert all(got[d] == (5 if d < 4000 else d) for d, _ in copies)


def test_links_that_leaders_miss_are_found(spark, monkeypatch):
    """Chains and groups without an origin, in many blocks and slices: as brute force has it."""
    monkeypatch.setattr(near_duplicates, "BLOCK_SETS", 8)
    monkeypatch.setattr(near_duplicates, "SLICE", 3)
    base = [f"w{i}" for i in range(160)]
    texts = [(i, " ".join(base[2 * i : 2 * i + 60])) for i in range(50)]
    texts += edited([f"v{i}" for i in range(90)], 9, 120, 100)
    texts += [(1000 + i, " ".join([f"u{j}" for j in range(40 + i)])) for i in range(60)]
    texts += [(2000 + i, texts[i][1]) for i in range(0, 200, 9)] + [(3000, None), (3001, "")]
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    assert rows(near_duplicates.near_duplicates(frame, width=4)) == sorted(brute_near([(d, t or "") for d, t in texts], 4), key=repr)


def test_exploded_signatures_are_not_broadcast(spark, monkeypatch):
    """Spark's estimate of their size is that of the rows before exploding: at 0.6 GB, under its own threshold, the driver got all of them."""
    texts = [(2 * i + k, " ".join([f"t{i}x{j}" for j in range(60)] + [f"end{k}"])) for i in range(50) for k in range(2)]
    frame, plans, write = spark.createDataFrame(texts, "doc_id long, text string"), [], common.materialize
    monkeypatch.setattr(common, "materialize", lambda df, *more: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, *more))

    def run():
        plans.clear()
        assert {r["doc_id"]: r["component_id"] for r in near_duplicates.near_duplicates(frame, width=4).collect()} == {d: d - d % 2 for d, _ in texts}
        sent = []
        for lines in map(str.splitlines, plans):
            depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
            for i in (i for i, x in enumerate(lines) if "BroadcastExchange" in x):
                end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
                sent += [x for x in lines[i:end] if "posexplode" in x]
        assert any("posexplode" in p for p in plans) and not sent

    run()
    monkeypatch.setattr(near_duplicates, "LOOKUP_ROWS", 0)
    run()
    assert any("SortMergeJoin" in p for p in plans if "posexplode" in p)


def test_components_of_random_graphs(spark):
    for n, m in ((60, 30), (60, 80), (200, 150)):
        edges = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)]
        edges = [(a, b) for a, b in edges if a != b]
        label = {x: x for e in edges for x in e}
        for _ in range(n):
            for a, b in edges:
                label[a] = label[b] = min(label[a], label[b])
        assert dict(rows(near_duplicates.components(spark.createDataFrame(edges, "a long, b long"), "random"))) == label
    star = [(i, 500) for i in range(400)]
    assert set(dict(rows(near_duplicates.components(spark.createDataFrame(star, "a long, b long"), "star"))).values()) == {0}


def test_a_run_leaves_only_its_result(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda _: str(tmp_path))
    near_duplicates.near_duplicates(spark.createDataFrame([(1, "a b c d e"), (2, "a b c d e")], "doc_id long, text string"), width=4)
    assert [p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()] == ["near-duplicates-result"]


# Decontamination


def test_blocks_of_phrases_and_common_words(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 200)
    monkeypatch.setattr(decontamination, "HELD", 2)
    monkeypatch.setattr(decontamination, "NEAR_PLACES", 64)
    docs = [(i, " ".join(rnd.choice(["the", "of", "a", "cat", "dog"]) for _ in range(rnd.randint(0, 150)))) for i in range(60)]
    docs += [(100, "the " * 3000), (101, "the " * 9), (102, None), (103, "")]
    items = [(i, " ".join(rnd.choice(["the", "of", "a", "cat"]) for _ in range(rnd.randint(3, 14)))) for i in range(80)] + [(200, "the " * 40), (201, "the")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert len(decontamination.write_phrases(bench, 10)) > 5
    got = decontamination.contamination(frame, bench).select("doc_id", "n_words", "n_hit", "items")
    assert rows(got) == sorted(brute_contamination([(d, t or "") for d, t in docs], items), key=repr)


# Quality and language


def test_scores_are_those_of_the_explicit_sum(spark):
    """Every pair of inputs written out, over a table."""
    draw = np.random.default_rng(4)
    size = (1 << quality.BITS) + quality.STATISTICS * quality.LEVELS
    machine = quality.Machine(-0.2, draw.normal(0, 0.3, size).astype(np.float32), draw.normal(0, 0.2, (size, 4)).astype(np.float32))
    texts = [(i, t) for i, t in enumerate([None, "", "one", "one two two three", "A b!\nc | 9 é", " ".join(f"w{i}" for i in range(80))])]
    got = {r["doc_id"]: r["score"] for r in quality.score(spark.createDataFrame(texts, "doc_id long, text string"), machine).collect()}
    for d, t in texts:
        ids, x = quality.inputs((t or "").encode(), quality._Buckets())
        assert len(ids) == len(set((t or "").split())) + quality.STATISTICS
        raw = machine.bias + sum(float(machine.weights[i]) * v for i, v in zip(ids, x.tolist(), strict=True))
        raw += sum(float(machine.factors[a].astype(float) @ machine.factors[b].astype(float)) * x[i] * x[j] for i, a in enumerate(ids) for j, b in enumerate(ids[:i]))
        assert got[d] == pytest.approx(1 / (1 + np.exp(-raw)), rel=1e-4)


def test_quality_counts_structure_by_hand():
    ids, _ = quality.inputs(b"AB 1\nab ab", quality._Buckets())
    at = ids[-quality.STATISTICS :] - (1 << quality.BITS) - np.arange(quality.STATISTICS) * quality.LEVELS
    shares = [2 / 10, 1 / 10, 2 / 10, 1 / 10, 0, 0, 0, 0, 0, 3 / 4, 1.0]
    assert at.tolist() == [quality._level(s) for s in shares] + [10 // 4, (4).bit_length(), (10).bit_length() // 2, 4 // 2 // 4]


def test_language_scores_by_hand():
    """N-grams and logits of a small model, character by character."""
    text = "Ab, é"
    signs = [c if c.isalpha() else " " for c in " " + text.lower() + " "]
    ids, (count,) = language_id.ngrams([text])
    by_place = ids.reshape(-1, 3)
    assert count == 3 * len(signs) and len(by_place) == len(signs)
    grams = {}
    for n in (1, 2, 3):
        for i in range(len(signs) - n + 1):
            grams.setdefault("".join(signs[i : i + n]), set()).add(int(by_place[i, n - 1]))
    assert all(len(v) == 1 for v in grams.values())
    draw = np.random.default_rng(2)
    model = language_id.Model(["x", "y"], draw.normal(size=(1 << language_id.BITS, 2)).astype(np.float32), np.array([0.1, -0.1]), 0.7)
    logits = np.array([sum(float(model.weights[i, k]) for i in ids) / count + model.bias[k] for k in (0, 1)]) / 0.7
    p = np.exp(logits) / np.exp(logits).sum()
    names, scores = model.predict([text, "12", ""])
    assert names == [["x", "y"][int(p.argmax())], "und", "und"] and scores[0] == pytest.approx(p.max(), rel=1e-5)


def test_the_temperature_is_inside_and_the_model_sparse(spark):
    model = language_id.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), queries.remainder(4) != 2)
    assert 1e-3 < model.temperature < 1e3
    assert model.error < 0.05 and model.sparsity > 0.5


def test_calibration():
    own = np.array([0, 1] * 200)
    apart = np.where(np.arange(2) == own[:, None], 5.0, -5.0)
    t, _ = language_id.calibrate(apart, own)
    assert 1e-3 < t < 1e3 and language_id.softmax(apart / t).max() == pytest.approx(1 - 1 / 402, abs=1e-3)
    draw = np.random.default_rng(3)
    true = draw.normal(0, 2, (20_000, 3))
    own = np.array([draw.choice(3, p=p) for p in language_id.softmax(true)])
    t, error = language_id.calibrate(true * 3, own)
    assert t == pytest.approx(3, rel=0.05) and error < 0.01


def test_redaction_keeps_columns_of_any_name(spark):
    from engramix.llm import pii

    frame = spark.createDataFrame([(1, "mail me@x.org", "a", "b", "c")], "doc_id long, text string, __email string, _matches string, `_MATCHES_` string")
    (row,) = pii.redact_documents(frame).collect()
    assert tuple(row) == (1, "mail [EMAIL]", "a", "b", "c")


# The pipeline


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_empty_and_awkward_tables(spark, name, stage):
    schema = "doc_id long, text string, lang string, source string, n_chars long, label int, _key string, score double, kept boolean, size int"
    tail = ("en", "s", 1, 1, "k", 0.5, True, 1)
    long = " ".join(f"{rnd.choice('abcdefgh')}{i % 977}" for i in range(60_000))
    held = [(1, None, *tail), (2, "", *tail), (3, "same text of some words here", *tail), (3, "same text of some words here", *tail), (4, "same text of some words here", *tail), (5, long, *tail), (None, "no id at all", *tail), (None, None, None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(held, schema)
    last = name == corpus_pipeline.STAGES[-1][0]
    out = stage(spark, docs.limit(0), SF)
    assert out.count() == 0 and (last or out.columns == corpus_pipeline.COLUMNS)
    out = stage(spark, docs, SF)
    ids = [r["doc_id"] for r in out.collect()]
    assert set(ids) <= {1, 2, 3, 4, 5, None}
    if name == "MinHash near-dedup":
        assert sorted(ids, key=str) == sorted([1, 2, 3, 5, None, None], key=str)
    if name in ("PII", "benchmark decontamination"):
        assert len(ids) == len(held)


def test_whole_pipeline_on_empty_documents(spark, tmp_path):
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
