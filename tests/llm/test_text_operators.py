"""Operators on texts against brute force or the public libraries, on a small hostile corpus."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from pathquill.llm import bpe_codec, decontamination, language_model, minhash_dedup, substring_dedup, suffix_dedup, token_counts
from pathquill.llm.bpe import Cache

P = pytest.importorskip("public_tokenizers")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def numbered(texts):
    """Texts by id, and the row without one, which repeats a text."""
    return dict(enumerate(texts)) | {None: texts[12]}


def uncovered(sequences, length):
    """Which symbols no repeated window covers."""
    counts = Counter(tuple(s[i : i + length]) for s in sequences.values() for i in range(len(s) - length + 1))
    out = {}
    for k, s in sequences.items():
        keep = [True] * len(s)
        for i in range(len(s) - length + 1):
            if counts[tuple(s[i : i + length])] > 1:
                keep[i : i + length] = [False] * length
        out[k] = keep
    return out


@pytest.mark.parametrize("bucket_symbols", [1_000_000, 2])
def test_substring_dedup(docs, texts, bucket_symbols):
    got = by_id(substring_dedup.without_repeats(docs, bucket_symbols=bucket_symbols))
    words = {k: re.findall("[^\x20\x09-\x0d]+", t or "") for k, t in numbered(texts).items()}
    for k, keep in uncovered(words, 35).items():
        assert got[k].n_words == len(words[k])
        assert got[k].kept == " ".join(w for w, x in zip(words[k], keep, strict=True) if x), k


@pytest.mark.parametrize("bucket_symbols", [1_000_000, 2])
def test_suffix_dedup(docs, texts, bucket_symbols):
    got = by_id(suffix_dedup.without_repeats(docs, bucket_symbols=bucket_symbols))
    raw = {k: (t or "").encode() for k, t in numbered(texts).items()}
    for k, keep in uncovered(raw, 200).items():
        assert bytes(got[k].kept) == bytes(b for b, x in zip(raw[k], keep, strict=True) if x), k


def test_suffix_order_is_the_suffix_array():
    rng = np.random.default_rng(2)
    for n in [*range(8), 50, 97]:
        s = rng.integers(1, 4, n)
        assert suffix_dedup.suffix_order(s, 10_000)[0].tolist() == sorted(range(n), key=lambda i, s=s: s[i:].tolist())


def test_cleaned_keeps_columns(docs, texts):
    got = suffix_dedup.cleaned(docs)
    assert got.columns == docs.columns and got.count() == docs.count()
    assert {r.doc_id: r.text for r in got.collect()}[0] is None


def test_decontamination(spark, docs, texts):
    items = [(1, texts[10]), (2, " ".join((texts[14] or "").split()[:4])), (3, None), (4, "..."), (5, texts[10]), (6, "the END")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = by_id(decontamination.contamination(docs, bench))

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for j in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[j : j + 10])].add(str(i))
    for k, t in numbered(texts).items():
        w, hit, held = words(t), set(), set()
        for x, who in windows.items():
            for j in range(len(w) - len(x) + 1):
                if tuple(w[j : j + len(x)]) == x:
                    hit.update(range(j, j + len(x)))
                    held |= who
        assert got[k].n_words == len(w)
        assert sum(b - a for a, b in got[k].hits) == len(hit)
        assert set(got[k].items) == held
    kept = decontamination.drop_contaminated_words(docs, bench).collect()
    assert {r.doc_id for r in kept} == {k for k in got if not got[k].hits}


def test_decontamination_in_blocks(spark, monkeypatch):
    """Repeated rows, ids of several texts, null ids and repeated items: small blocks give what one block gives."""
    w = ["w%d" % i for i in range(60)]
    text = [" ".join(w[:15]), " ".join(w[20:40]), " ".join(w[5:30])]
    rows = [(1, text[0]), (1, text[0]), (1, text[1]), (2, text[2]), (2, None), (None, text[0]), (None, text[1]), (None, None), (None, None), (3, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    items = [(7, " ".join(w[:12])), (7, " ".join(w[:12])), (7, " ".join(w[22:34])), (8, " ".join(w[10:22])), (9, "x"), (10, " ".join(w[30:45]))]
    bench = spark.createDataFrame(items, "item_id long, text string")

    def found():
        got = decontamination.contamination(df, bench).collect()
        return sorted((str(r.doc_id), r.n_words, str(r.hits), ",".join(sorted(r["items"]))) for r in got)

    one = found()
    assert len(one) == len(rows)
    assert [x[3] for x in one if x[1] == 15] == ["7"] * 3
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 60)
    assert len(list(decontamination.item_blocks(bench, "item_id", "text"))) > 2
    assert found() == one


def test_dropping_takes_the_index(spark, monkeypatch):
    """Rows are dropped by what the index finds, and shares count the words of all blocks together."""
    w = ["w%d" % i for i in range(40)]
    rows = [(1, " ".join(w)), (1, " ".join(w)), (2, " ".join(w[:12] + ["x"] * 30)), (None, None), (3, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(w[:14])), (8, " ".join(w[20:34]))], "item_id long, text string")
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 30)
    built, build = [], decontamination.build_index
    monkeypatch.setattr(decontamination, "build_index", lambda *a: built.append(1) or build(*a))
    kept = decontamination.drop_contaminated_words(df, bench, share=0.5)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "3", "None"]
    assert built and kept.columns == df.columns


def test_proximity():
    windows = decontamination.Windows([(1, "red green blue")])
    words = decontamination.words_of("blue x red y green z red")
    ids = decontamination.term_ids(words, windows.vocab)
    windows.plan(np.ones(len(windows.vocab), np.int64))
    lists = {t: np.flatnonzero(ids == t) for t in set(ids[ids >= 0].tolist())}
    assert list(decontamination.phrase_matches(windows, lists)) == []
    assert (0, 0, 4) in list(decontamination.proximity_matches(windows, lists, 2))
    assert list(decontamination.proximity_matches(windows, lists, 0)) == []


@pytest.mark.parametrize("size", [8_000_000, 60])
def test_proximity_from_the_index(spark, monkeypatch, size):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", size)
    w = ["w%d" % i for i in range(40)]
    far = [*w[:9], *["x%d" % i for i in range(12)], w[9]]
    rows = [(1, " ".join(w[:10])), (2, " ".join(["a", *w[:4], "new", w[5], w[4], *w[6:10], "b"])), (3, " ".join(far)), (4, None)]
    bench = spark.createDataFrame([(7, " ".join(w[:10])), (8, " ".join(w[12:22])), (9, " ".join(w[25:35]))], "item_id long, text string")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = by_id(decontamination.contamination(df, bench, slop=2))
    assert {k: (r.hits, r.near, r.near_items) for k, r in got.items()} == {1: ([[0, 10]], [[0, 10]], ["7"]), 2: ([], [[1, 12]], ["7"]), 3: ([], [], []), 4: ([], [], [])}
    # the last word needs the wider reach
    assert by_id(decontamination.contamination(df, bench, slop=12))[3].near == [[0, 22]]
    assert decontamination.contamination(df, bench).columns == ["doc_id", "n_words", "hits", "items"]


def test_token_counts(docs, texts):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = by_id(token_counts.token_counts(docs, path))
    for k, text in numbered(texts).items():
        assert got[k].n_tokens == len(t.encode(text or "", add_special_tokens=False).ids), k
        assert got[k].n_bytes == len((text or "").encode())
        assert got[k].over_limit == (got[k].n_tokens > 1024)


def test_codec(docs, texts):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    got = by_id(bpe_codec.codec_digests(docs, path, with_ids=True))
    encoded = bpe_codec.encode_texts(docs, path)
    whole = by_id(encoded)
    for k, text in numbered(texts).items():
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert got[k].ids == ids == whole[k].ids, k
        decoded = t.decode(ids, skip_special_tokens=False)
        assert whole[k].decoded == decoded
        assert got[k].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
        assert got[k].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    again = by_id(bpe_codec.decode_ids(encoded, path))
    assert all(again[k].decoded == whole[k].decoded for k in whole)


def test_codec_blocks(monkeypatch):
    """Small blocks and caches change no result: long and wide words, control marks, added tokens in capitals, pieces that recur."""
    import random

    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rng = random.Random(9)
    odd = ["a" * 300, "ab" * 400, "\U0001d400\U00010428x\U0001f600!", "é" * 60, "it's", "x\x1cy", "<|endoftext|>", "<|ENDOFTEXT|>", "z<|startoftext|>z", "12a3", "ΑΣ", "...", "\u0301"]
    texts = ["", " ", "\x1c", *(" ".join(rng.choice([*odd, "".join(rng.choices("abcdefgé", k=6))]) for _ in range(rng.randint(1, 30))) for _ in range(100)), "ab" * 5_000]
    monkeypatch.setattr(bpe_codec, "TEXT_BLOCK", 2000)
    monkeypatch.setattr(bpe_codec, "PIECE_BLOCK", 100)
    codec = bpe_codec.Codec(path, entries=20)
    for text, (ids, decoded) in zip(texts, codec.encode_texts(texts), strict=True):
        wanted = t.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == wanted
        assert decoded == t.decode(wanted, skip_special_tokens=False)
    assert len(codec.ids) < 2000 and all(len(p) <= 200 for p in codec.ids.keys() | codec.old_ids.keys())


def test_codec_cost_of_new_words():
    """Words that no cache holds cost well under merging them one by one."""
    import random
    import time

    path = P.path("word_bpe_49k.json")
    codec = bpe_codec.Codec(path)
    rng = random.Random(3)
    syllables = "the of ing er re on an ti en th ou le ne ät né".split()
    different = sorted({"".join(rng.choices(syllables, k=rng.randint(3, 7))) for _ in range(20_000)})

    def one_by_one(word):
        raw = word.encode()
        ids = [int(codec.inner[b]) for b in raw[:-1]] + [int(codec.last[raw[-1]])]
        while len(ids) > 1:
            best = None
            for i in range(len(ids) - 1):
                hit = codec.pairs.get(ids[i] << 32 | ids[i + 1])
                if hit and (best is None or hit[0] < best[0]):
                    best, at = hit, i
            if best is None:
                break
            ids[at : at + 2] = [best[1]]
        return ids

    began = time.process_time()
    wanted = [i for w in different for i in one_by_one(w)]
    plain = time.process_time() - began
    began = time.process_time()
    got = codec.encode(" ".join(different)).tolist()
    assert time.process_time() - began < 0.7 * plain
    assert got == wanted


def test_newer_letters_and_marks():
    """Capitals of Unicode 16 and 17, and marks that the library doesn't reorder, come out as the library has them."""
    import random
    import unicodedata

    from tokenizers import Tokenizer, normalizers

    from pathquill.llm import bpe

    library, lower = normalizers.NFC(), normalizers.Lowercase()
    path = P.path("word_bpe_49k.json")
    codec, tokenizer = bpe_codec.Codec(path), Tokenizer.from_file(path)
    rng = random.Random(6)
    marks = [c for c in range(0x300, 0x1E500) if not 0xD800 <= c < 0xE000 and unicodedata.combining(chr(c))]
    later = sorted(bpe.later_lower())
    for _ in range(3000):
        text = "".join(chr(rng.choice([97, 0x65, 0x393, 0xC5, 0x1100, 0x1161, 0x11935, *rng.sample(marks, 4), rng.choice(later)])) for _ in range(rng.randint(1, 8)))
        assert bpe.composed(text) == library.normalize_str(text), [hex(ord(c)) for c in text]
        assert bpe.lowered(text) == lower.normalize_str(text)
        assert codec.encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    every = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text = " ".join(map(chr, every))
    assert bpe.lowered(text) == lower.normalize_str(text)


def test_minhash(docs, texts):
    got = by_id(minhash_dedup.near_duplicates(docs))
    cache = Cache(minhash_dedup.word_hash)
    rows = {k: minhash_dedup.words_of(t or "", cache) for k, t in enumerate(texts)}
    parent = {k: k for k in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in rows:
        for b in rows:
            if a < b and len(rows[a]) and len(rows[b]):
                same = rows[a].tolist() == rows[b].tolist()
                if same or minhash_dedup.ordered_similarity(rows[a], rows[b], 0.8) >= 0.8:
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    assert {k: got[k].class_id for k in rows} == {k: root(k) for k in rows}
    assert all(got[k].kept == (got[k].class_id == k) for k in rows)
    kept = minhash_dedup.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {k for k in got if got[k].kept}


@pytest.mark.parametrize("block_words", [150_000, 60])
def test_near_duplicates_of_repeated_ids(spark, block_words):
    """Texts are found by content: an id with two texts links by either; repeated rows and small blocks change nothing."""
    rng = np.random.default_rng(3)
    a, b = (" ".join("w%d" % i for i in rng.integers(0, 5000, 60)) for _ in range(2))
    near = b.split()
    near[58] = "other"
    rows = [(1, a), (1, b), (3, " ".join(near)), (3, " ".join(near)), (4, "x"), (4, "x"), (None, a), (5, None), (6, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.class_id, r.kept) for r in minhash_dedup.near_duplicates(df, block_words=block_words).collect()]
    assert sorted(got, key=str) == sorted([(1, 1, True), (1, 1, True), (3, 1, False), (3, 1, False), (4, 4, True), (4, 4, True), (None, None, True), (5, 5, True), (6, 6, True)], key=str)


def test_recall_of_sketches():
    """Pairs at the threshold itself meet in a bucket more often than not, nearer ones nearly always."""
    rng = np.random.default_rng(11)

    def met(edits, trials=300):
        n = 0
        for _ in range(trials):
            a = rng.integers(1, 1 << 60, 300).astype(np.uint64)
            b = a.copy()
            b[rng.choice(np.arange(5, 295), edits, replace=False)] = rng.integers(1, 1 << 60, edits).astype(np.uint64)
            n += any(x == y for x, y in zip(minhash_dedup.sketches(minhash_dedup.shingles(a)), minhash_dedup.sketches(minhash_dedup.shingles(b)), strict=True))
        return n / trials

    assert met(6) > 0.97 and met(3) > 0.99


def test_alignment_against_plain_table():
    rng = np.random.default_rng(1)
    for _ in range(60):
        a = rng.integers(0, 4, rng.integers(1, 25))
        b = a.copy() if rng.random() < 0.5 else rng.integers(0, 4, rng.integers(1, 25))
        for _ in range(rng.integers(0, 4)):
            b = np.delete(b, rng.integers(len(b))) if len(b) > 1 else b
        d = np.zeros((len(a) + 1, len(b) + 1), int)
        d[:, 0], d[0] = range(len(a) + 1), range(len(b) + 1)
        for i in range(len(a)):
            for j in range(len(b)):
                d[i + 1, j + 1] = min(d[i, j] + (a[i] != b[j]), d[i, j + 1] + 1, d[i + 1, j] + 1)
        edits = int(d[-1, -1])
        assert minhash_dedup.aligned_runs(a, b, edits) is not None
        assert edits == 0 or minhash_dedup.aligned_runs(a, b, edits - 1) is None


def test_band_keeps_other_heads_and_tails(spark):
    rng = np.random.default_rng(9)
    seen = 0
    for _ in range(60):
        core = rng.integers(0, 1 << 60, 97).astype(np.uint64)
        own = [rng.integers(0, 1 << 60, rng.integers(0, 9)).astype(np.uint64) for _ in range(4)]
        a, b = np.concatenate([own[0], core, own[1]]), np.concatenate([own[2], core, own[3]])
        if rng.random() < 0.5:
            b = np.delete(b, rng.integers(len(b)))
        runs = minhash_dedup.aligned_runs(a, b, len(a) + len(b))
        common = sum(max(r - 4, 0) for r in runs)
        plain = common / (len(a) + len(b) - 8 - common)
        got = minhash_dedup.ordered_similarity(a, b, 0.8)
        assert got == plain or plain < 0.8 and got < 0.8
        seen += plain >= 0.8
    assert seen > 20
    words = ["w%d" % i for i in range(111)]
    rows = [(1, " ".join(words[:104])), (2, " ".join(words[7:]))]
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == {1: 1, 2: 1}


def test_order_matters():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 60, 200).astype(np.uint64)
    assert minhash_dedup.ordered_similarity(a, np.roll(a, 100), 0.8) == 0
    b = a.copy()
    b[50] = 1
    assert minhash_dedup.ordered_similarity(a, b, 0.8) == pytest.approx(191 / 201)


def plain_ending(word):
    core = word.rstrip(b".,;:!?")
    h = int(len(core) < len(word))
    for k in (1, 2, 3):
        h = (h * 257 + (core[-k] + 1 if k <= len(core) else 0)) % (1 << 64)
    return 1 + language_model.WORDS + ((h * 0x9E3779B97F4A7C15 % (1 << 64)) >> 40) % language_model.ENDINGS


def test_language_model(docs, texts):
    """Counts, base and score of every row against plain Python over the same parameters."""
    L = language_model
    learned = docs.where("doc_id % 3 != 1")
    got = by_id(L.score_texts(docs, learned))
    rows = numbered(texts)
    tokens = {k: [*(t or "").encode().lower().split(), L.END] for k, t in rows.items()}
    counts = Counter(w for k, ws in tokens.items() if k is not None and k % 3 != 1 for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    own = {w: k + 1 for k, w in enumerate(sorted(counts.keys() - {L.END}, key=lambda w: (-counts[w], w))[: L.WORDS])}

    def cls(w):
        return 0 if w == L.END else own.get(w) or plain_ending(w)

    mass, kinds = Counter(), Counter()
    for w, n in counts.items():
        mass[cls(w)] += n
        kinds[cls(w)] += 1
    m = L.learn(learned)[1]
    for k, ws in tokens.items():
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in ws)
        assert got[k].base_score == pytest.approx(base)
        assert (got[k].n_tokens, got[k].n_known, got[k].train_tokens) == (len(ws), sum(counts[w] > 0 for w in ws), total)
        if len(ws) < 500:
            score, before = 0.0, [L.CLASSES] * L.CONTEXT
            for w in ws:
                c = cls(w)
                z = m["q"].astype(float) @ sum(m["r"][x].astype(float) * m["c"][j] for j, x in enumerate(before)) + m["b"]
                score += (z[c] - z.max() - math.log(np.exp(z - z.max()).sum())) / math.log(10)
                if c > L.WORDS:
                    score += math.log10((counts[w] + 0.5) / (mass[c] + 0.5 * (kinds[c] + 1)))
                before = [c, *before[:-1]]
            assert got[k].score == pytest.approx(score, rel=1e-4), k


def test_endings_are_those_of_plain_python():
    words = [b"", b"a", b"!", b"ab.", b"abc", b"xyz,;!", b"\xc3\xa9t\xc3\xa9", b"word" + b"!" * 100, b"." * 50]
    assert language_model.endings(pa.array(words, pa.binary())).tolist() == [plain_ending(w) for w in words]
    assert language_model.endings(pa.array(words, pa.binary()).slice(3)).tolist() == [plain_ending(w) for w in words[3:]]


def test_head_is_bounded(spark):
    rows = [(b"w%d" % i, c) for i, c in enumerate([5000, 5000, 1100, 1090, *[7] * 10, *[1] * 30])] + [(language_model.END, 9)]
    words = spark.createDataFrame(rows, "token binary, c long")
    sizes = {most: language_model.head_of(words, most).num_rows for most in (100, 44, 20, 5, 1)}
    assert sizes == {100: 44, 44: 14, 20: 14, 5: 4, 1: 0}


def sequence_of(L, ctx, word):
    return np.array([*ctx[::-1], word])


def test_language_model_is_normalised():
    L = language_model
    rng = np.random.default_rng(0)
    m = L.start_of(rng.normal(size=L.CLASSES))
    for scale in (1, 12):
        big = {k: v * np.float32(scale) for k, v in m.items()}
        scorer = L.Scorer(big)
        ctx = rng.integers(0, L.CLASSES + 1, L.CONTEXT)
        p = np.exp([scorer(sequence_of(L, ctx, w))[0] for w in range(L.CLASSES)])
        assert p.sum() == pytest.approx(1, abs=1e-3)


def test_language_model_keeps_its_size(spark):
    """Rank 200 has a class of its own, the third class back counts, and a step takes 2,048 positions."""
    L = language_model
    words = spark.createDataFrame([(b"w%d" % i, 1000 - i) for i in range(300)], "token binary, c long")
    counts = L.gather(spark, words)
    assert len(counts.own) == 255 and counts.own[200].as_py() == b"w200" and len(counts.mass) == 1 + 255 + 128
    scorer = L.Scorer(L.start_of(np.zeros(L.CLASSES)))
    third = [scorer(sequence_of(L, [5, 6, last], 1))[0] for last in (7, 8)]
    assert abs(third[0] - third[1]) > 1e-6
    assert L.BATCH == 2048


def test_kept_normalisers_change_nothing(monkeypatch):
    L = language_model
    monkeypatch.setattr(L, "KEPT", 8)
    rng = np.random.default_rng(6)
    m = L.start_of(rng.normal(size=L.CLASSES))
    scorer = L.Scorer(m)
    for _ in range(3):
        seq = rng.integers(0, 4, 50)
        ctx, word = np.stack([seq[2 - k : len(seq) - 1 - k] for k in range(3)], axis=1), seq[3:]
        s = (m["r"][ctx] * m["c"]).sum(1) @ m["q"].T + m["b"]
        plain = s[np.arange(len(word)), word] - np.log(np.exp(s).sum(1))
        assert scorer(seq) == pytest.approx(plain, abs=1e-5)


def test_training_step_is_the_gradient():
    """One step moves every parameter along the numerical gradient of the noise-contrastive objective."""
    L = language_model
    rng = np.random.default_rng(4)
    m = {k: v.astype(np.float64) for k, v in L.start_of(rng.normal(size=L.CLASSES) - 5).items()}
    p = np.full(L.CLASSES, 1 / L.CLASSES)
    seq = np.array([L.CLASSES] * 3 + [4, 5, 4, 0] + [L.CLASSES] * 3 + [9, 4, 0])
    noise = np.random.default_rng(1).choice(L.CLASSES, L.NOISE, p=p)

    def objective(m):
        total = 0.0
        for i in range(3, len(seq)):
            if seq[i] < L.CLASSES:
                h = sum(m["r"][seq[i - 1 - k]] * m["c"][k] for k in range(3))
                x = m["q"] @ h + m["b"] - np.log(L.NOISE * p)
                total += -np.log1p(np.exp(-x[seq[i]])) - np.log1p(np.exp(x[noise])).sum()
        return total

    got = {k: np.zeros_like(v) for k, v in m.items()}
    L.train_step({k: v.copy() for k, v in m.items()}, got, p, seq, np.random.default_rng(1), 0.1)
    for name, at in (("q", (4, 3)), ("q", (int(noise[0]), 0)), ("b", (4,)), ("r", (4, 2)), ("r", (L.CLASSES, 1)), ("c", (1, 5))):
        up, down = ({k: v.copy() for k, v in m.items()} for _ in range(2))
        up[name][at] += 1e-4
        down[name][at] -= 1e-4
        slope = (objective(up) - objective(down)) / 2e-4
        assert np.sqrt(got[name][at] * 7) == pytest.approx(abs(slope), rel=1e-2, abs=1e-4), name


@pytest.mark.parametrize(
    "run",
    [
        substring_dedup.without_repeats,
        suffix_dedup.without_repeats,
        minhash_dedup.near_duplicates,
        lambda d: language_model.score_texts(d, d),
        lambda d: token_counts.token_counts(d, P.path("byte_bpe_50k.json")),
        lambda d: bpe_codec.codec_digests(d, P.path("word_bpe_49k.json")),
    ],
)
def test_empty_table(empty, run):
    assert run(empty).count() == 0
