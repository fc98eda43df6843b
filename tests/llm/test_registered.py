"""The registered operator queries on the smallest data set: columns, held-out rows, digests, against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest

from pathquill.llm import language_model, minhash_dedup, queries
from pathquill.llm.bpe import Cache

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no data")


@pytest.fixture(scope="module")
def texts():
    t = pq.read_table(DATA / "documents.parquet")
    return dict(zip(t.column("doc_id").to_pylist(), t.column("text").to_pylist(), strict=True))


def ran(spark, name):
    df = queries.QUERIES[name](spark, str(DATA))
    return df.columns, {r[0]: r for r in df.collect()}


def remainder(i, m):
    return zlib.crc32(str(i).encode()) % m


def test_toxicity(spark, texts):
    columns, got = ran(spark, "op3_toxicity")
    assert columns[:4] == ["doc_id", "held_out", "score", "predicted"] and got.keys() == texts.keys()
    for i, r in got.items():
        assert r.held_out == (remainder(i, 4) == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)


def test_language_model(spark, texts):
    columns, got = ran(spark, "op6_lm_scoring")
    assert columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"] and got.keys() == texts.keys()
    tokens = {i: [*re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None] for i, t in texts.items()}
    counts = Counter(w for i, ws in tokens.items() if remainder(i, 5) != 1 for w in ws)
    total = sum(counts.values())
    floor = math.log10(total + 0.5 * (len(counts) + 1))
    for i, r in got.items():
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (remainder(i, 5) == 1, len(tokens[i]), sum(counts[w] > 0 for w in tokens[i]), total)
        assert r.base_score == pytest.approx(sum(math.log10(counts[w] + 0.5) - floor for w in tokens[i]))
        assert -math.inf < r.score < 0
    assert language_model.CLASSES == 384


def test_tokens_and_codec(spark, texts):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    columns, got = ran(spark, "op7_token_counts")
    assert columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for i, text in texts.items():
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        assert tuple(got[i]) == (i, len((text or "").encode()), n, n > 1024)
    columns, got = ran(spark, "op9_bpe_codec")
    assert columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for i, text in texts.items():
        ids = t.encode(text or "", add_special_tokens=False).ids
        digests = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert tuple(got[i]) == (i, len(ids), *digests)


def test_near_duplicates(spark, texts):
    """No link of the brute force is lost, and none is made."""
    columns, got = ran(spark, "op2_minhash_near_dedup")
    assert columns[:3] == ["doc_id", "class_id", "kept"] and got.keys() == texts.keys()
    cache = Cache(minhash_dedup.word_hash)
    words = {i: minhash_dedup.words_of(t or "", cache) for i, t in texts.items()}
    sets = {i: set(minhash_dedup.shingles(w).tolist()) for i, w in words.items()}
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and len(words[a]) and len(words[b]):
                both = len(sets[a] & sets[b])
                near = words[a].tolist() == words[b].tolist() or both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) > 0 and minhash_dedup.ordered_similarity(words[a], words[b], 0.8) >= 0.8
                if near:
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
    wanted = {i: root(i) for i in texts}
    assert np.mean([got[i].class_id == wanted[i] for i in texts]) > 0.98
    assert all(r.kept == (r.class_id == i) for i, r in got.items())
    assert all(wanted[r.class_id] == wanted[i] for i, r in got.items())


def test_licenses(spark, texts):
    columns, got = ran(spark, "op8_license_scan")
    assert columns == ["doc_id", "license", "n_headers", "is_license_file", "inherited_from", "effective_license"] and got.keys() == texts.keys()
    for i, r in got.items():
        assert (r.license is not None) == (r.n_headers > 0 or r.is_license_file)
        if r.n_headers and not r.is_license_file:
            assert re.search("(?i)licen|permission|CC BY|SPDX", texts[i])
