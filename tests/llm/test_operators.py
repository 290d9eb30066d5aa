"""The ten operators against brute force, round trips and held-out accuracy, with the defined odd cases."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tokenizers
from pyspark.sql import functions as F

from leafgrade.llm import arc_warc, common, decontaminate, jaccard, language, mjpeg, rans, sentencepiece_bpe, suffix_dedup, token_counts, token_files, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, bucket int, rid string"


def docs_of(spark, texts, ids=None):
    """Documents with extra columns whose names the operators use inside."""
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, None, "s", 0, 0.5, 1, "x") for i, t in zip(ids, texts, strict=True)], SCHEMA)


ODD = [None, "", " \n\t", "...", "one", "One two", "é", "a" * 5000, "x y " * 3000, "same text here and there now", "same text here and there now", "日本語 テキスト", "tail\x00nul"]
WORDS = [f"{a}{b}" for a in ("ba", "ko", "ri", "tu", "sel", "mon") for b in ("ra", "te", "pin", "do", "gul", "van", "s")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", ".", "\n"]) for _ in range(n))


def families(seed, groups=25, length=(8, 160)):
    """Texts in families: an original, copies, and copies with a few words changed, cut or added."""
    rng = random.Random(seed)
    out = []
    for _ in range(groups):
        words = prose(rng, rng.randint(*length)).split(" ")
        for _ in range(rng.randint(1, 7)):
            new = list(words)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                k = rng.randrange(len(new))
                new[k : k + rng.randint(0, 2)] = [rng.choice(WORDS) for _ in range(rng.randint(0, 2))]
                new = new or ["x"]
            out.append(" ".join(new))
    rng.shuffle(out)
    return out


# 1 language


def test_language_learns_and_rejects(spark):
    rng = random.Random(1)
    make = {"aa": ["krz", "shtk", "vlad", "grom"], "bb": ["ala", "eio", "oua", "lolo"]}
    rows = [(i, " ".join(rng.choice(make[x]) for _ in range(rng.randint(1, 40))), x) for i in range(400) for x in ["aa" if i % 2 else "bb"]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df, ~language.held_out(), language.LanguageConfig(epochs=2))
    got = language.identify(df, model).join(df, "doc_id").where(language.held_out()).collect()
    assert len(got) > 50 and np.mean([r.lang_pred == r.lang for r in got]) > 0.97
    odd = {r.doc_id: r for r in language.identify(docs_of(spark, ODD), model).collect()}
    assert [odd[i].lang_pred for i in (0, 1, 2, 3)] == ["und"] * 4 and odd[0].score == 0
    assert odd[4].lang_pred in make and odd[9].score == odd[10].score and all(0 <= r.score <= 1 for r in odd.values())


def test_language_without_labels(spark):
    df = docs_of(spark, ["abc", None])
    assert {r.lang_pred for r in language.identify(df, language.fit(df, F.lit(True))).collect()} == {"und"}


def test_language_is_batch_independent():
    rng = np.random.default_rng(0)
    texts = [bytes(rng.integers(32, 255, rng.integers(0, 50)).astype(np.uint8)) for _ in range(40)]
    off = np.append(0, np.cumsum([len(t) for t in texts]))
    b, r = language.grams(np.frombuffer(b"".join(texts), np.uint8), off, 12)
    for i, t in enumerate(texts):
        alone = language.grams(np.frombuffer(t, np.uint8), np.array([0, len(t)]), 12)[0]
        assert Counter(b[r == i].tolist()) == Counter(alone.tolist())


def test_predictions_against_a_plain_softmax():
    rng = random.Random(4)
    texts = [prose(rng, 30) for _ in range(40)] + ["der die das und " * 9, "le la les et " * 9]
    model = language.train(texts, ["a"] * 40 + ["b", "c"], language.LanguageConfig(bits=10, epochs=2))
    buf, off = common.text_buffer(pa.array(texts))
    best, p = language.predict(buf, off, model)
    for i, t in enumerate(texts):
        raw = t.encode()
        b, _ = language.grams(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), 10)
        z = [(sum(float(model.table[k, c]) for k in b) / len(b) + model.bias[c]) / model.temperature for c in range(3)]
        e = [math.exp(x - max(z)) for x in z]
        assert best[i] == e.index(max(e)) and p[i] == pytest.approx(max(e) / sum(e), rel=1e-5)


# 2 toxicity


def test_scores_against_a_plain_noisy_or():
    rng = random.Random(5)
    texts = [prose(rng, 40) + (". vilewort " if i % 3 == 0 else ".") + "tail\nend" for i in range(60)]
    config = toxicity.ToxicityConfig(bits=12, epochs=3)
    weight = toxicity.train(texts, np.array([i % 3 == 0 for i in range(60)], int), config)
    buf, off = common.text_buffer(pa.array([*texts, "", "..."], pa.large_string()))
    got, _, _ = toxicity.score_rows(buf, off, weight)
    for i, t in enumerate([*texts, "", "..."]):
        clean = 1.0
        for sentence in re.split(r"[.!?\n]", t):
            raw = np.frombuffer(sentence.encode(), np.uint8)
            buckets = set(toxicity.features(raw, np.array([0, len(raw)]), 12)[0].tolist())
            if buckets:
                clean *= 1 - 1 / (1 + math.exp(-(float(weight[1 << 12]) + sum(float(weight[b]) for b in buckets))))
        up = math.exp(float(weight[-1]))
        want = (1 - clean) * up / (clean + (1 - clean) * up)
        assert got[i] == pytest.approx(want, rel=1e-4, abs=1e-6)


def test_toxicity_finds_the_offending_sentence(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(900):
        toxic = int(i % 5 == 0)
        sentences = [prose(rng, 8).replace(".", "").replace("\n", " ") for _ in range(rng.randint(1, 6))]
        if toxic:
            k = rng.randrange(len(sentences))
            sentences[k] += " " + rng.choice(["vilewort", "badling", "scurm"])
        rows.append((i, ". ".join(sentences)))
        labels.append((i, toxic))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    weight = toxicity.fit(df, lab, ~toxicity.held_out())
    got = toxicity.score(df, weight, sentences=True).join(lab, "doc_id").where(toxicity.held_out()).collect()
    assert np.mean([(r.score >= 0.7) == (r.toxic == 1) for r in got]) > 0.97
    for r in got:
        for s in r.offending:
            assert any(w in s.text for w in ("vilewort", "badling", "scurm"))
    odd = {r.doc_id: r.score for r in toxicity.score(docs_of(spark, ODD), weight).collect()}
    assert odd[0] == odd[1] == odd[2] == odd[3] == 0.0 and odd[9] == odd[10]
    one_class = toxicity.fit(df, lab.where("toxic = 0"), F.lit(True))
    assert toxicity.score(df, one_class).agg(F.max("score")).first()[0] == 0.0


# 3 token files


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 5000, 32768, 32769, 70000])
def test_rans_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 49000).astype(np.uint32)
    docs, sizes, got, before = rans.read(rans.write([5, None], np.array([n, 0]), ids, 9))
    assert docs == [5, None] and sizes.tolist() == [n, 0] and before == 9 and (got == ids).all()


def test_rans_detects_damage():
    data = bytearray(rans.write([1], np.array([1000]), np.arange(1000, dtype=np.uint32)))
    for at in [*range(0, 32, 3), 40, 60, 500, 4000, len(data) // 2, len(data) - 5, len(data) - 1]:
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            rans.read(bytes(bad))


def test_word_tokenizer_equals_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    t, library = token_files.WordTokenizer(path), tokenizers.Tokenizer.from_file(path)
    rng = random.Random(4)
    parts = list("abZ ,.\n'1é日Σß\t\x01\x1c　-<|>") + ["'s", "'RE", "ing ", ". ", ", ", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "e\u0301", "İ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    assert [g.tolist() for g in t.encode(texts)] == [library.encode(x, add_special_tokens=False).ids for x in texts]


def test_token_files(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ODD + families(3, 5)
    ids = [7 * i % 50 for i in range(len(texts) - 1)] + [None]
    folder = common.scratch(spark, "files")
    manifest = token_files.write_token_files(docs_of(spark, texts, ids), folder, path, 1, partitions=3)
    got = token_files.read_token_files(spark, folder, manifest).collect()
    library = tokenizers.Tokenizer.from_file(path)
    at, want = 0, []
    for d, t in sorted(zip(ids, texts, strict=True), key=lambda x: (x[0] is not None, x[0] or 0)):
        tokens = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((d, len(tokens), zlib.crc32(np.array(tokens, "<u4").tobytes())))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter(want)
    rows = sorted(got, key=lambda r: r.start)
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    known = [r.doc_id for r in rows if r.doc_id is not None]
    assert known == sorted(known)


# 4 Jaccard join


def plain_components(texts):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for t in texts:
        w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", (t or "").translate(lower)) if x]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in range(len(texts))}


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_against_brute_force(spark, seed):
    texts = ODD + families(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs_of(spark, texts)).collect()}
    assert got == plain_components(texts)


def test_jaccard_long_lists_in_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK", 4)
    rng = random.Random(9)
    base = prose(rng, 120).split(" ")
    texts = []
    for _ in range(60):
        new = list(base)
        for _ in range(4):
            new[rng.randrange(len(new))] = rng.choice(WORDS)
        texts.append(" ".join(new))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs_of(spark, texts)).collect()}
    assert got == plain_components(texts)


def test_every_similar_pair_shares_enough_signatures():
    rng = np.random.default_rng(3)
    for _ in range(400):
        n = int(rng.integers(4, 300))
        common_ = rng.integers(0, 2**63, n).astype(np.uint64)
        a = b = common_
        while True:
            extra = rng.integers(0, 2**63, int(rng.integers(0, n // 4 + 2))).astype(np.uint64)
            cut = int(rng.integers(0, len(extra) + 1))
            a, b = np.unique(np.append(common_, extra[:cut])), np.unique(np.append(common_, extra[cut:]))
            if 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)):
                break
        s, r, need = jaccard.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        shared = len(np.intersect1d(s[r == 0], s[r == 1]))
        assert shared >= min(need), (len(a), len(b), shared, need)


@pytest.mark.parametrize("n,m", [(16, 20), (32, 40), (33, 40), (64, 80)])
def test_both_sets_of_a_nested_pair_reach_their_need(n, m):
    rng = np.random.default_rng(7)
    sets = []
    for _ in range(1000):
        large = rng.permutation(4096)[:m].astype(np.uint64)
        sets += [np.sort(common.mix(large[:n])), np.sort(common.mix(large))]
    s, r, need = jaccard.signatures(np.concatenate(sets), np.append(0, np.cumsum([len(x) for x in sets])))
    of = defaultdict(set)
    for sig, row in zip(s.tolist(), r.tolist(), strict=True):
        of[row].add(sig)
    assert all(len(of[i] & of[i + 1]) >= max(need[i], need[i + 1]) for i in range(0, len(sets), 2))


def plain_links(texts):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for t in texts:
        w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", (t or "").translate(lower)) if x]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    near = lambda a, b: a and b and 100 * len(a & b) >= 80 * len(a | b)
    return {i: sum(bool(near(a, b)) for j, b in enumerate(sets) if j != i) for i, a in enumerate(sets)}


@pytest.mark.parametrize("chunk", [4, 1024])
def test_jaccard_counts_every_link(spark, monkeypatch, chunk):
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    rng = random.Random(11)
    base = prose(rng, 120).split(" ")
    texts = ODD + families(5, 8)
    for _ in range(40):
        new = list(base)
        for _ in range(rng.choice([1, 2, 3])):
            new[rng.randrange(len(new))] = rng.choice(WORDS)
        texts += [" ".join(new)] * rng.choice([1, 1, 3])
    got = jaccard.jaccard_components(docs_of(spark, texts)).collect()
    want = plain_links(texts)
    assert {r.doc_id: r.n_links for r in got} == want and max(want.values()) > 20
    without = jaccard.jaccard_components(docs_of(spark, texts), count_links=False).collect()
    assert {r.doc_id: r.component_id for r in got} == {r.doc_id: r.component_id for r in without} == {i: c for i, (_, c) in plain_components(texts).items()}


def test_jaccard_of_an_empty_table(spark):
    assert jaccard.jaccard_components(docs_of(spark, [])).count() == 0


# 5 media


def test_media_round_trip_and_shots(spark):
    rows = {r.doc_id: r for r in mjpeg.read_media(mjpeg.store_text(docs_of(spark, ODD))).collect()}
    for i, t in enumerate(ODD):
        raw = (t or "").encode()
        padded = raw + b"\xff" * ((-len(raw)) % 576 or (576 if not raw else 0))
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
    assert rows[9].media_sha256 == rows[10].media_sha256 and rows[9].feature == rows[10].feature
    scenes = b"a" * 576 * 8 + bytes(range(0, 256)) * 18 + b"z" * 576 * 8
    media = mjpeg.write_avis([scenes])[0]
    clips = mjpeg.clips(spark.createDataFrame([(1, bytearray(media)), (2, bytearray(media[:100])), (3, None)], "doc_id long, media binary")).collect()
    whole = [r for r in clips if r.doc_id == 1]
    assert [(r.first_frame, r.last_frame) for r in whole][0] == (0, 7) and whole[-1].last_frame == 23 and len(whole) >= 3
    assert [r.error is None for r in clips if r.doc_id != 1] == [False, False]


def test_jpeg_against_an_inverse_transform():
    rng = np.random.default_rng(1)
    c, grey = mjpeg.decode_frames(mjpeg.parse_riff(mjpeg.write_avis([rng.integers(0, 256, 576).astype(np.uint8).tobytes()])[0])["frames"])
    x = np.zeros(64)
    x[mjpeg.ZIGZAG] = c[0, 0]
    k, p = np.arange(8)[:, None], np.arange(8)[None, :]
    basis = np.where(k == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * p + 1) * k * np.pi / 16)
    assert np.abs(np.clip(np.round(basis.T @ x.reshape(8, 8) @ basis + 128), 0, 255) - grey[0, :8, :8]).max() <= 1


def plain_scan(blocks, components, tables, restart, unit):
    """The entropy-coded bytes of blocks [(component, 64 coefficients in zigzag order)], one bit string at a time."""
    out, bits, last = b"", "", [0] * components

    def code(table, symbol):
        by_code, by_size, _ = mjpeg._codes(*map(list, table))
        return format(int(by_code[symbol]), f"0{int(by_size[symbol])}b")

    def number(v):
        n = abs(v).bit_length()
        return format(v if v > 0 else v + (1 << n) - 1, f"0{n}b") if n else ""

    def flush(bits):
        bits += "1" * (-len(bits) % 8)
        return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")

    for i, (c, z) in enumerate(blocks):
        if restart and i and i % (restart * unit) == 0:
            out += flush(bits) + bytes([0xFF, 0xD0 + (i // (restart * unit) - 1) % 8])
            bits, last = "", [0] * components
        d = int(z[0]) - last[c]
        last[c] = int(z[0])
        bits += code(tables[c][0], abs(d).bit_length()) + number(d)
        run = 0
        end = max([k for k in range(1, 64) if z[k]], default=0)
        for k in range(1, end + 1):
            if not z[k]:
                run += 1
                continue
            while run > 15:
                bits += code(tables[c][1], 0xF0)
                run -= 16
            bits += code(tables[c][1], run << 4 | abs(int(z[k])).bit_length()) + number(int(z[k]))
            run = 0
        if end < 63:
            bits += code(tables[c][1], 0)
    return out + flush(bits)


@pytest.mark.parametrize("sampling", [((1, 1),), ((1, 1), (1, 1), (1, 1)), ((2, 2), (1, 1), (1, 1)), ((2, 1), (1, 1), (1, 1))])
@pytest.mark.parametrize("restart", [0, 2])
@pytest.mark.parametrize("own_tables", [False, True])
def test_colour_frames(sampling, restart, own_tables):
    rng = np.random.default_rng(len(sampling) + restart)
    height, width = 27, 43
    h, v = sampling[0]
    across, down = -(-width // (8 * h)), -(-height // (8 * v))
    standard = ((mjpeg.DC_BITS, mjpeg.DC_SYMBOLS), (mjpeg.AC_BITS, mjpeg.AC_SYMBOLS))
    chroma = ((mjpeg.DC_BITS_CHROMA, mjpeg.DC_SYMBOLS_CHROMA), (mjpeg.AC_BITS_CHROMA, mjpeg.AC_SYMBOLS_CHROMA))
    tables = [standard] + [chroma] * (len(sampling) - 1)
    blocks, luma = [], np.zeros((down * v, across * h, 64), int)
    for y in range(down):
        for x in range(across):
            for c, (a, b) in enumerate(sampling):
                for k in range(a * b):
                    z = np.where(rng.random(64) < rng.choice([0.02, 0.4]), rng.integers(-60, 61, 64), 0)
                    z[0] = rng.integers(-200, 200)
                    blocks.append((c, z))
                    if c == 0:
                        luma[y * v + k // h, x * h + k % h] = z
    unit = sum(a * b for a, b in sampling)
    segment = mjpeg._segment
    quant = bytes(range(1, 65))
    head = b"\xff\xd8" + segment(0xDB, b"\x00" + quant + b"\x01" + b"\x02" * 64)
    head += segment(0xC0, bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(sampling)]) + b"".join(bytes([i + 1, a << 4 | b, min(i, 1)]) for i, (a, b) in enumerate(sampling)))
    if own_tables:
        for i, (dc, ac) in enumerate((standard, chroma)):
            head += segment(0xC4, bytes([i, *dc[0], *dc[1]])) + segment(0xC4, bytes([16 + i, *ac[0], *ac[1]]))
    if restart:
        head += segment(0xDD, restart.to_bytes(2, "big"))
    head += segment(0xDA, bytes([len(sampling)]) + b"".join(bytes([i + 1, 0x11 * min(i, 1)]) for i in range(len(sampling))) + b"\x00\x3f\x00")
    frame = head + plain_scan(blocks, len(sampling), tables, restart, unit) + b"\xff\xd9"
    c, grey = mjpeg.decode_frames([frame, frame])
    assert (c[1].reshape(luma.shape) == luma).all() and grey.shape == (2, height, width)
    clip = mjpeg._avi([frame] * 3, 0)
    assert [len(f) for f in mjpeg.parse_riff(clip)["frames"]] == [len(frame)] * 3


def test_features_against_a_plain_count(spark):
    texts = families(6, 4) + [None, "z" * 5000]
    got = {r.doc_id: r.feature for r in mjpeg.read_media(mjpeg.store_text(docs_of(spark, texts))).collect()}
    for i, t in enumerate(texts):
        grey = mjpeg.decode_frames(mjpeg.parse_riff(mjpeg.write_avis([(t or "").encode()])[0])["frames"])[1]
        hist = [[sum(int(p) // 16 == b for p in g.reshape(-1)) for b in range(16)] for g in grey]
        diffs = [sum(abs(a - b) for a, b in zip(x, y, strict=True)) for x, y in zip(hist, hist[1:], strict=False)]
        cuts, own, spread = [], [], 0.0
        for k, d in enumerate(diffs):
            if len(own) >= 3 and d > sum(own) / len(own) + 3 * max(spread / len(own), 1.0):
                cuts.append(k + 1)
                own, spread = [], 0.0
                continue
            own.append(d)
            spread += abs(d - sum(own) / len(own))
        total = [sum(h[b] for h in hist) for b in range(16)]
        assert got[i] == f"frames={len(grey)};shots={len(cuts) + 1};cuts={'.'.join(map(str, cuts))};hist={'.'.join(map(str, total))}"


# 6 sentencepiece


def test_pieces_equal_the_library(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    m = sentencepiece_bpe.PieceModel(path)
    rng = random.Random(2)
    parts = list("abct \n\n  ,.é日本𝄞\t\x00　▁") + ["the", "tion", " ", "  "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 80))) for _ in range(2000)] + [t or "" for t in ODD]
    got = m.encode(texts)
    assert [g.tolist() for g, _ in got] == [m.library.encode(t, add_eos=True) for t in texts] and m.corrected == 0
    chunks = [c for c in m.cache if len(c) < 40][:2000]
    assert m.agenda_encode(chunks) == [m.heap_encode(c) for c in chunks]
    rows = {r.doc_id: r for r in sentencepiece_bpe.encode_pieces(docs_of(spark, ODD), path).collect()}
    for i, t in enumerate(ODD):
        ids = m.library.encode(t or "", add_eos=True)
        assert (rows[i].n_tokens, rows[i].ids_sha256, rows[i].decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(m.library.decode(ids).encode()).hexdigest())


# 7 decontamination


def plain_contamination(texts, items):
    import re

    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))
    out = {}
    for d, t in enumerate(texts):
        w, hit, found = split(t), set(), set()
        for k, item in items:
            v = split(item)
            n = min(13, len(v))
            windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
            for i in range(len(w) - n + 1) if n else ():
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found.add(str(k))
        out[d] = (len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("block", [1 << 25, 4000])
def test_contamination_against_brute_force(spark, block):
    rng = random.Random(6)
    items = [(k, prose(rng, rng.choice([1, 2, 3, 7, 12, 13, 14, 30]))) for k in range(30)] + [(90, ""), (91, None), (92, "One two"), (93, "one TWO"), (94, "...")]
    texts = list(ODD)
    for _ in range(40):
        words = prose(rng, rng.randint(0, 200)).split(" ")
        item = rng.choice(items)[1] or ""
        k = rng.randint(0, len(words))
        texts.append(" ".join(words[:k] + item.split(" ")[rng.randint(0, 2) :] + words[k:]))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_contamination(docs_of(spark, texts), bench, decontaminate.DecontaminateConfig(max_block_bytes=block))
    assert {r.doc_id: (r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in got.collect()} == plain_contamination(texts, items)
    assert decontaminate.find_contamination(docs_of(spark, texts), bench.limit(0)).where("n_hit > 0").count() == 0


@pytest.mark.parametrize("block", [1 << 25, 2000])
@pytest.mark.parametrize("keep", [["doc_id"], ["doc_id", "text"]])
def test_contamination_keeps_every_row(spark, block, keep):
    rng = random.Random(12)
    items = [(k, prose(rng, 14)) for k in range(30)]
    texts = [prose(rng, 20) + " " + items[i % 30][1] if i % 3 else prose(rng, 30) for i in range(40)]
    texts += [texts[1], None, None]
    ids = [None if i % 4 == 0 else i % 5 for i in range(len(texts) - 3)] + [1, 2, 2]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_contamination(docs_of(spark, texts, ids), bench, decontaminate.DecontaminateConfig(max_block_bytes=block), keep)
    assert got.columns == [*keep, "n_words", "n_hit", "items", "spans", "contaminated"]
    want = plain_contamination(texts, items)
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in got.collect()) == Counter((d, want[i][0], want[i][1], tuple(want[i][2]), want[i][3]) for i, d in enumerate(ids))


@pytest.mark.parametrize("block", [1 << 25, 700])
def test_contamination_by_items_without_id(spark, block):
    rng = random.Random(13)
    items = [(None, prose(rng, 20)), (None, prose(rng, 14)), (3, prose(rng, 15)), (4, prose(rng, 20))]
    texts = [items[0][1], f"{items[1][1]} {items[2][1]} {items[0][1]}", items[3][1], prose(rng, 40)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.find_contamination(docs_of(spark, texts), bench, decontaminate.DecontaminateConfig(max_block_bytes=block)).collect()}
    assert [list(got[i]["items"]) for i in range(4)] == [[None], ["3", None], ["4"], []]
    numbered = [(i, t) for i, (_, t) in enumerate(items)]
    want = plain_contamination(texts, numbered)
    assert {i: (r.n_words, r.n_hit, r.contaminated) for i, r in got.items()} == {i: (w[0], w[1], w[3]) for i, w in want.items()}


def test_contamination_by_items_with_names(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    bench = spark.createDataFrame([("b-1", item), ("b-2", item)], "item_id string, text string")
    got = decontaminate.find_contamination(docs_of(spark, ["x " + item.upper().replace(" ", ", "), item[4:50]]), bench).orderBy("doc_id").collect()
    assert [(list(r["items"]), r.n_hit) for r in got] == [(["b-1", "b-2"], 14), ([], 0)]


def test_op7_equals_its_sql_on_items_without_id(spark, tmp_path):
    import duckdb

    from leafgrade.llm.queries import ORACLE_SQL

    rng = random.Random(14)
    items = [(None, prose(rng, 20)), (None, prose(rng, 14)), (3, prose(rng, 15)), (20, prose(rng, 20))]
    texts = [items[0][1], f"{items[1][1]} {items[2][1]} {items[3][1]}", items[3][1], prose(rng, 40), None]
    docs_of(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.execute(ORACLE_SQL["op7_decontaminate"]).fetchall()
    assert sorted(tuple(r) for r in decontaminate.op7_decontaminate(spark, str(tmp_path)).collect()) == sorted(want)


# 8 archives


def test_archives(spark):
    html = ["<p>a</p>", "<p>a</p>", None, "", "b\r\n\r\nc", "<p>a</p>", "é" * 3000, "last"]
    rows = [(i, None if i == 4 else f"http://x.example/{i} {i}", h) for i, h in enumerate(html)]
    # Repeated rows, one page id with two payloads, and rows without a page id.
    rows += [(5, "u", "<p>a</p>"), (5, "u", "<p>a</p>"), (7, "u", "other"), (None, "u", "<p>a</p>"), (None, None, None)]
    folder = common.scratch(spark, "arc")
    manifest = arc_warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), folder)
    got = arc_warc.read_archives(folder, manifest).collect()
    best = {}
    for i, _, h in rows:
        best[h or ""] = max(best.get(h or "", -1), -1 if i is None else i)
    want = Counter()
    for i, _, h in rows:
        raw, first = (h or "").encode(), best[h or ""]
        own = i is None or i == first
        want[i, len(raw), arc_warc.digest(raw), "response" if own else "revisit", None if own else first] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert len({r.record_id for r in got}) == len(rows)
    one = {r.page_id: r for r in got}
    assert one[0].url == "http://x.example/0%200" and one[4].url == "about:blank" and one[1].warc_date == "1997-01-01T00:00:01Z"
    # A file that the manifest doesn't name is not read.
    with open(folder.removeprefix("file://") + "/part-000000-00000-999999.warc.gz", "wb") as f:
        f.write(b"left behind")
    assert arc_warc.read_archives(folder, manifest).count() == len(rows)


def test_archives_of_an_empty_table(spark):
    folder = common.scratch(spark, "arc")
    manifest = arc_warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert arc_warc.read_archives(folder, manifest).collect() == []


def test_altered_payloads_are_refused():
    row = {"date": "19970101000000", "url": "u", "ip": "0.0.0.0", "data": b"HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nab"}
    record = arc_warc.warc_record(row, arc_warc.record_id(3, 4))
    names, block = next(arc_warc.parse_warc(zlib.compress(record, wbits=31)))
    assert arc_warc.payload_of(names, block) == (2, arc_warc.digest(b"ab")) and arc_warc.page_of(names["WARC-Record-ID"]) == 4
    with pytest.raises(ValueError):
        arc_warc.payload_of(names, block[:-1] + b"c")


@pytest.mark.parametrize("packed", [False, True])
def test_arc_files_are_converted(spark, tmp_path, packed):
    want = {}
    for version in (1, 2):
        records = [(f"http://{version}/{k}", "20010203040506", b"HTTP/1.0 200 OK\r\nX: y\r\n\r\nbody %d" % k) for k in range(3)]
        data = arc_warc.arc_file(records, version)
        (tmp_path / f"v{version}.arc").write_bytes(zlib.compress(data[:150], wbits=31) + zlib.compress(data[150:], wbits=31) if packed else data)
        want |= {u: arc_warc.digest(d.partition(b"\r\n\r\n")[2]) for u, _, d in records}
    folder = common.scratch(spark, "warc")
    got = arc_warc.read_archives(folder, arc_warc.convert_arc(spark, f"file://{tmp_path}", folder)).collect()
    assert {r.url: r.payload_digest for r in got} == want and len({r.record_id for r in got}) == 6
    assert {(r.record_type, r.warc_date, r.payload_bytes) for r in got} == {("response", "2001-02-03T04:05:06Z", 6)}


@pytest.mark.parametrize("version", [1, 2])
def test_arc_files(version):
    records = [("http://a/", "19970101000000", b"one\n\ntwo"), ("http://b/", "19980101000000", b""), ("http://c/", "19990101000000", b"\n")]
    got = list(arc_warc.parse_arc(arc_warc.arc_file(records, version)))
    assert [(r["url"], r["date"], r["data"]) for r in got] == records and {r["version"] for r in got} == {version}
    with pytest.raises(ValueError):
        list(arc_warc.parse_arc(arc_warc.arc_file(records[:1], version)[:-6]))


# 9 token counts


def test_edits_keep_the_count():
    c = token_counts.Counter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rng = random.Random(3)
    parts = list("ab're's'll \n\n  ,.1é日\t'") + ["the", " don", "'v", "  "]
    make = lambda n: "".join(rng.choice(parts) for _ in range(n))
    for trial in range(400):
        tree = token_counts.TokenTree(make(rng.randint(0, 300 if trial % 3 else 3000)), c)
        for _ in range(6):
            b = rng.randint(0, len(tree.text))
            tree.edit(b, b + rng.choice([0, 0, 1, 3, 50, 2000]), make(rng.choice([0, 1, 2, 8, 600])))
            assert tree.n_tokens == len(c.encoding.encode_ordinary(tree.text)) and tree.chars[1] == len(tree.text)


def test_an_edit_touches_little():
    c = token_counts.Counter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    tree = token_counts.TokenTree("word " * 20000 + "end", c)
    tree.edit(50000, 50004, "other")
    assert tree.recounted < 10


def test_count_query(spark):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoding = token_counts.Counter(path, pattern).encoding
    rows = {r.doc_id: r for r in token_counts.count_with_edits(docs_of(spark, ODD), path, pattern).collect()}
    for i, t in enumerate(ODD):
        text = t or ""
        assert rows[i].n_tokens == len(encoding.encode_ordinary(text))
        for b, e, new in token_counts.review_edits(text):
            b = min(b, len(text))
            text = text[:b] + new + text[max(b, min(e, len(text))) :]
        assert (rows[i].n_tokens_edited, rows[i].n_chars_edited) == (len(encoding.encode_ordinary(text)), len(text))


# 10 suffix arrays


def plain_cover(texts, length):
    count = defaultdict(set)
    for i, t in enumerate(texts):
        for p in range(len(t) - length + 1):
            count[t[p : p + length]].add((i, p))
    cover = [set() for _ in texts]
    for places in count.values():
        if len(places) > 1:
            for i, p in places:
                cover[i].update(range(p, p + length))
    return cover


@pytest.mark.parametrize("alphabet", [b"ab", b"abc", b"a", bytes(range(4))])
def test_maximal_repeats(alphabet):
    rng = random.Random(len(alphabet))
    for _ in range(100):
        length = rng.choice([3, 5, 8])
        texts = [bytes(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(1, 6))]
        cover = [set() for _ in texts]
        for size, places in suffix_dedup.maximal_repeats(texts, length):
            assert len({texts[i][p : p + size] for i, p in places}) == 1 and len(places) > 1
            for i, p in places:
                cover[i].update(range(p, p + size))
        assert cover == plain_cover(texts, length)


@pytest.mark.parametrize("hot,flush", [(1500, 150_000), (2, 150_000), (2, 20), (6, 60)])
def test_removal_against_brute_force(spark, monkeypatch, hot, flush):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "_FLUSH", flush)
    monkeypatch.setattr(suffix_dedup, "_FLUSH_STRINGS", 4 * flush)
    rng = random.Random(8)
    shared = [prose(rng, 150) for _ in range(4)]
    texts = list(ODD)
    for _ in range(60):
        part = rng.choice(shared)
        k = rng.randint(0, 300)
        texts.append(prose(rng, rng.randint(0, 90)) + part[k : k + rng.choice([380, 399, 400, 401, 600])] + prose(rng, rng.randint(0, 90)))
    texts.append(shared[0] + "|" + shared[0])
    # Copies, rows that repeat whole, one id with two texts, and rows without an id.
    texts += [texts[20]] * 9 + [texts[21]]
    ids = [*range(len(texts) - 4), 5, 5, None, None]
    raw = [(t or "").encode() for t in texts]
    cover = plain_cover(raw, 400)
    got = suffix_dedup.without_repeats(docs_of(spark, texts, ids)).collect()
    want = Counter()
    for d, b, c in zip(ids, raw, cover, strict=True):
        want[d, bytes(x for p, x in enumerate(b) if p not in c), len(c), sum(p - 1 not in c for p in c)] += 1
    assert Counter((r.doc_id, bytes(r.kept), r.n_removed, r.n_spans) for r in got) == want


def test_removal_from_an_empty_table(spark):
    assert suffix_dedup.without_repeats(docs_of(spark, [])).count() == 0


# shared pieces


def test_components(spark):
    rng = random.Random(4)
    for n, m in ((1, 0), (50, 20), (200, 150), (60, 200)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(1000, 1030)]
        parent = {}

        def find(x, parent=parent):
            parent.setdefault(x, x)
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
        got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {v: find(v) for e in edges for v in e if e[0] != e[1] or v in got}


def test_words_cross_neither_rows_nor_batches():
    texts = ["Alpha beta", "", "beta", "ALPHA", "a\x00b c"]
    raw = [t.encode() for t in texts]
    off = np.append(0, np.cumsum([len(r) for r in raw]))
    h, start, end, row = common.words(np.frombuffer(b"".join(raw), np.uint8), off, common.SPACE_WORDS)
    assert row.tolist() == [0, 0, 2, 3, 4, 4] and h[0] == h[3] and h[1] == h[2]
    assert h[0] == common.words(np.frombuffer(b"x alpha", np.uint8), np.array([0, 7]), common.SPACE_WORDS)[0][1]


# queries


@pytest.mark.parametrize("name", ["op4_jaccard", "op7_decontaminate", "op8_warc", "op10_suffix_dedup"])
def test_query_equals_its_sql(spark, tmp_path, name):
    import duckdb

    from leafgrade.llm.queries import ORACLE_SQL, QUERIES

    rng = random.Random(15)
    texts = [*ODD, *families(7, 8), "same " * 200]
    passage = prose(rng, 110)
    texts += [prose(rng, 20) + passage + prose(rng, 30) for _ in range(5)]
    docs_of(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, texts[20][:200]), (2, "no such words here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, f"u{i}", t and t[:300]) for i, t in enumerate(texts)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    got = QUERIES[name](spark, str(tmp_path))
    want = con.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert Counter(tuple(r[c] for c in want.columns) for r in got.collect()) == Counter(want.fetchall())


@pytest.mark.parametrize("rows", [0, 2])
def test_queries_on_empty_tables_and_repeated_rows(spark, tmp_path, rows):
    """Every query gives no row on empty tables, and equal rows for rows that repeat whole, with nulls in all columns."""
    import corpus_pipeline

    from leafgrade.llm.queries import QUERIES

    docs = [(1, "one two three four five six. idiot seven", "en", "s", 3), (None, None, None, None, None), (2, "", "en", None, 0)] * rows
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 1), (2, 0, 0), (None, None, None)] * rows, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(None, None), (1, "one two")] * rows, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(None, None, None), (1, "u", "x")] * rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    for name, query in QUERIES.items():
        got = query(spark, str(tmp_path)).collect()
        key = "page_id" if name == "op8_warc" else "doc_id"
        assert Counter(r[key] for r in got) == Counter(d[0] for d in (docs if key == "doc_id" else [(None,), (1,)] * rows)), name
        for k in {r[key] for r in got}:
            own = {tuple(v for c, v in r.asDict().items() if c not in ("start", "n_corrected")) for r in got if r[key] == k}
            assert len(own) == 1, (name, own)
    # In the pipeline the toxic document goes, and texts without words all stay.
    left = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in left) == Counter([None, 2] * rows)


DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
def test_tokenizing_queries_equal_the_libraries_on_the_whole_table(spark):
    import sentencepiece

    from leafgrade.llm.queries import QUERIES

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    at = 0
    for r in sorted(QUERIES["op3_token_files"](spark, DATA).collect(), key=lambda r: r.doc_id):
        ids = [*library.encode(texts[r.doc_id], add_special_tokens=False).ids, 1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = QUERIES["op6_sentencepiece"](spark, DATA).collect()
    assert len(got) == len(texts) and sum(r.n_corrected for r in got) == 0
    for r in got:
        ids = pieces.encode(texts[r.doc_id], add_eos=True)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(pieces.decode(ids)))
