"""Vectors, toxicity, licenses, components and the pipeline."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathquill.llm import embedding_dedup, licenses, toxicity
from pathquill.llm.common import components


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    loops = {a for a, b in edges if a == b}
    assert all(got.get(x, x) == root(x) for x in parent)
    assert set(parent) - set(got) <= loops


@pytest.mark.parametrize("block", [1024, 5])
def test_near_vectors(spark, block):
    rng = np.random.default_rng(7)
    rows, centres = [], rng.normal(size=(6, 20))
    for i in range(120):
        x = centres[i % 6] + rng.normal(size=20) * rng.choice([0.02, 0.2, 1.0])
        rows.append((i, [float(v) for v in x.astype(np.float32)], int(i % 2)))
    rows += [(200, rows[3][1], 1), (201, rows[3][1], 0), (202, None, 1), (203, [0.0] * 20, 1), (204, rows[3][1], None), (205, [float("nan")] * 20, 1), (206, [1.0, None], 1), (207, [], 1)]
    rows.append(rows[5])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(df, recall=0.9999, block=block).collect()}
    good = {r[0]: (np.array(r[1]) / np.linalg.norm(r[1]), r[2]) for r in rows if r[0] < 202}
    links = {a: [b for b, (y, m) in good.items() if b != a and m == l and x @ y >= 0.93] for a, (x, l) in good.items()}
    for a in good:
        seen, todo = {a}, [a]
        while todo:
            todo += [b for b in links[todo.pop()] if b not in seen and not seen.add(b)]
        assert (got[a].n_links, got[a].component_id, got[a].kept) == (len(links[a]), min(seen), min(seen) == a), a
    for a in range(202, 208):
        assert (got[a].n_links, got[a].component_id, got[a].kept) == (0, a, True)
    assert len(got) == len({r[0] for r in rows})


def test_recall_at_defaults(spark):
    """Pairs just above the threshold, by the operator's own parameters."""
    rng = np.random.default_rng(12)
    a = rng.normal(size=(1000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= np.einsum("nd,nd->n", a, b)[:, None] * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    cosine = rng.uniform(0.9302, 0.945, 1000)[:, None]
    b = a * cosine + b * np.sqrt(1 - cosine**2)
    rows = [(i, x.tolist(), 1) for i, x in enumerate(np.concatenate([a, b]))]
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert np.mean([got[1000 + i].component_id == i and got[i].n_links == 1 for i in range(1000)]) > 0.985
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>, label int")
    assert embedding_dedup.near_vectors(empty).count() == 0


def test_estimates_are_unbiased():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = embedding_dedup.encode(x, 8, 12)
    i, j = rng.integers(0, 400, 20_000), rng.integers(0, 400, 20_000)
    error = embedding_dedup.estimate(c, i, j) - np.einsum("nd,nd->n", x[i], x[j])
    assert abs(error.mean()) < 0.005
    assert (np.abs(error) <= embedding_dedup.bound(c, i, 4.0)).mean() > 0.999


def plain_segments(scores):
    """All maximal scoring segments, from the definition: split around the best, again and again."""
    best = max(((sum(scores[i:j]), i - j, i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=None)
    if best is None or best[0] <= 0:
        return []
    i, j = best[2], best[3]
    return plain_segments(scores[:i]) + [(i, j)] + [(a + j, b + j) for a, b in plain_segments(scores[j:])]


def test_segments():
    rng = random.Random(2)
    for _ in range(300):
        s = [rng.choice([-3, -2, -1.5, 1.25, 2, 3.5, -0.7]) + rng.random() * 1e-3 for _ in range(rng.randint(0, 14))]
        got = [(a, b) for a, b, _ in toxicity.segments(np.array(s))]
        assert sorted(got) == sorted(plain_segments(s))


def test_toxicity(spark):
    rng = random.Random(1)
    words = ["w%d" % i for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        text = rng.choices(words, k=rng.randint(5, 80))
        if i % 6 == 0:
            text[rng.randrange(len(text))] = "Vile!"
            text.append("vile")
        rows.append((i, " ".join(text)))
        labels.append((i, int(i % 6 == 0)))
    rows += [(700, None), (701, ""), (702, "vile"), (703, "vile " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    model = toxicity.fit(docs, spark.createDataFrame([x for x in labels if x[0] % 4] + [(0, None), (None, 1)], "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.toxic_passages(docs, model).collect()}
    assert np.mean([got[i].predicted == y for i, y in labels if i % 4 == 0]) > 0.97
    assert got[702].predicted == 1 and got[703].predicted == 1
    assert got[700].score == got[701].score < 0.3 and got[700].passages == []
    kept = {r.doc_id for r in toxicity.drop_toxic(docs, model).collect()}
    assert kept == {k for k, r in got.items() if not r.predicted}


def test_toxicity_counts_reach_the_driver_small(spark):
    rows = [(i, *(i * k + 1 for k in range(1, 4)), [70_000, 1 << 33][i % 2] if i in (5, 8) else 0) for i in range(3000)]
    counts = spark.createDataFrame(rows, "slot long, a long, b long, c long, d long").repartition(5)
    got = toxicity.dense_counts(counts, list("dabc"), 4000)
    for column, k in zip(got, (4, 1, 2, 3), strict=True):
        assert column.astype(int).tolist() == [r[k] for r in rows] + [0] * 1000
    assert [x.tolist() for x in toxicity.dense_counts(counts.limit(0), ["a"], 3)] == [[0, 0, 0]]


def test_toxicity_driver_memory(spark):
    """Counts of eight folds are some of the driver's largest arrays; before, they alone took 38 MB here and as much again on their way."""
    docs = spark.createDataFrame([(i, " ".join(f"w{i}_{j}" for j in range(20))) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    tracemalloc.start()
    try:
        toxicity.fit(docs, labels)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 50e6, peak


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.toxic_passages(docs, model).first().predicted == 0
    assert toxicity.toxic_passages(docs.limit(0), toxicity.fit(docs.limit(0), spark.createDataFrame([], "doc_id long, toxic int"))).count() == 0


def test_licenses(spark):
    files = [
        (1, "a/LICENSE", "Released under the MIT License."),
        (2, "a/x.py", "print"),
        (3, "a/b/y.py", "some words\nLicensed under the Apache License, Version 2.0.\nmore words here and there"),
        (4, "a/b/z.py", None),
        (5, "c/d.py", "LICENSED UNDER CC BY-NC 4.0\nand the rest of a longer text that has many other words in it"),
        (6, "e.py", ""),
        (7, None, "x"),
        (8, "a/b/c/LICENSE", "This work is licensed under the GNU General Public License, version 3."),
        (9, "a/b/c/d/q.py", "the license of this version is a public work"),
    ]
    df = spark.createDataFrame(files, "doc_id long, path string, text string").withColumn("license", F.lit(1))
    got = {r.doc_id: r for r in licenses.license_scan(df).collect()}
    assert {k: r.effective_license for k, r in got.items()} == {1: "MIT", 2: "MIT", 3: "Apache-2.0", 4: "MIT", 5: "CC-BY-NC-4.0", 6: None, 7: None, 8: "GPL-3.0", 9: "GPL-3.0"}
    assert {k for k, r in got.items() if r.is_license_file} == {1, 8}
    assert got[4].inherited_from == "a" and got[9].inherited_from == "a/b/c" and got[3].inherited_from is None
    assert licenses.license_scan(df.limit(0)).count() == 0


def test_wrapped_license_headers(spark):
    words = {name: text.split() for name, text in licenses.HEADERS}  # the last, longest template of each
    code = "\n".join("def f%d(x): return x + %d  # some code here" % (i, i) for i in range(30))

    def wrapped(name, n, mark):
        w = words[name]
        return "\n".join(mark + " ".join(w[i : i + n]) for i in range(0, len(w), n))

    files = [
        (1, "a/x.py", wrapped("MIT", 11, "# ") + "\n" + code),
        (2, "b/x.c", "int x;\n/*\n *\n" + wrapped("Apache-2.0", 7, " * ") + "\n */\n" + code),
        (3, "c/LICENSE", "Released under the MIT License."),
        (4, "c/x.py", code + "\n" + wrapped("GPL-3.0", 7, "// ") + "\nx = 1\n" + wrapped("MIT", 11, "") + "\n" + code),
        (5, "d/x.py", code + "\nThe license of this software and a copy\n" + code),
    ]
    df = spark.createDataFrame(files, "doc_id long, path string, text string")
    got = {r.doc_id: r for r in licenses.license_scan(df).collect()}
    assert (got[1].license, got[1].n_headers, got[1].is_license_file) == ("MIT", 1, False)
    assert (got[2].license, got[2].n_headers) == ("Apache-2.0", 1)
    assert got[4].license in ("MIT", "GPL-3.0") and got[4].n_headers == 2 and got[4].inherited_from is None
    assert (got[5].license, got[5].n_headers) == (None, 0)


def test_license_files_and_tags(spark):
    """Standard licence files speak for their directories, files with a standard header and code don't; tags name their licence."""
    mit, apache = dict(licenses.TEXTS)["MIT"], [t for n, t in licenses.HEADERS if n == "Apache-2.0"][-1]
    gpl = [t for n, t in licenses.HEADERS if n == "GPL-3.0"][-1]
    title = dict(licenses.TITLES)["Apache-2.0"].replace("Version", "\nVersion").replace("http", "\nhttp").replace("TERMS", "\n\nTERMS")
    body = "\n".join("%d. Clause on matters of grant and notice number %d, of which this file has many more words." % (i, i) for i in range(60))

    def wrapped(text, mark):
        w = text.split()
        return "\n".join(mark + " ".join(w[i : i + 9]) for i in range(0, len(w), 9))

    files = [
        (1, "a/LICENSE", "MIT License\n\nCopyright (c) 2020 Ann Author\n\n" + wrapped(mit[len("MIT License ") :], "")),
        (2, "a/x.py", "print(1)"),
        (3, "b/x.c", "/*\n" + wrapped(apache, " * ") + "\n */\nint main() { return 0; }\nint other(int value) { return value + 1; }"),
        (4, "b/y.c", "int y;"),
        (5, "c/x.py", wrapped(gpl, "# ") + "\nx = 1"),
        (6, "d/x.rs", "// SPDX-License-Identifier: MPL-2.0\nfn main() {}"),
        (7, "e/LICENSE", title + "\n\n" + body),
        (8, "e/z.py", "pass"),
        (8, "e/z.py", "pass"),
        (9, "f/x.py", "# SPDX-License-Identifier: Own-1.0\n"),
    ]
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    assert len(got) == 9
    assert {k for k, r in got.items() if r.is_license_file} == {1, 7}
    assert {k: r.effective_license for k, r in got.items()} == {1: "MIT", 2: "MIT", 3: "Apache-2.0", 4: None, 5: "GPL-3.0", 6: "MPL-2.0", 7: "Apache-2.0", 8: "Apache-2.0", 9: "Own-1.0"}
    assert got[2].inherited_from == "a" and got[8].inherited_from == "e"


def test_license_cosines_by_brute_force(spark):
    """Cosines of lines and wholes to all templates, said once more in plain Python."""
    rng = random.Random(3)
    texts = [t for _, t, _ in licenses.TEMPLATES]
    units = [" ".join(w for w in rng.choice(texts).split() if rng.random() < 0.8) + rng.choice(["", " and more words here"]) for _ in range(60)] + ["", "nothing"]
    df = spark.createDataFrame(list(enumerate(units)), "unit long, line string")
    model = licenses.weighted({"license": 5, "the": 40}, 50)
    got = {r.unit: r for r in licenses.best_license(df, ["unit"], "line", 0.75, model).collect()}
    rows, unknown, idf = model
    for k, unit in enumerate(units):
        bag = {t: (1 + np.log(c)) * idf.get(t, unknown) for t, c in Counter(licenses.terms(unit)).items()}
        norm = sum(x * x for x in bag.values()) ** 0.5
        cosines = {}
        for j, _, t, w in rows:
            cosines[j] = cosines.get(j, 0.0) + bag.get(t, 0.0) * w / (norm or 1)
        best = max(cosines.values())
        if best >= 0.75:
            assert got[k].cosine == pytest.approx(best, abs=1e-6)
            assert got[k].license in {licenses.TEMPLATES[j][0] for j, c in cosines.items() if c > best - 1e-6}
        else:
            assert k not in got


def test_shared_beginnings():
    import re

    words = ["a", "abc", "abd", "x", "xyz", "b.c"]
    pattern = re.compile(licenses.one_of(words))
    for w in [*words, "", "ab", "xy", "bxc", "abcd", "y"]:
        assert bool(pattern.fullmatch(w)) is (w in words), w


def test_license_anchors_lose_nothing():
    """A text without any anchor stays below the threshold, by brute force over the templates' other terms."""
    rows, unknown, idf = licenses.weighted()
    anchors = set(licenses.anchors(rows, licenses.THRESHOLD))
    for k, (_, text, _) in enumerate(licenses.TEMPLATES):
        left = [t for t in licenses.terms(text) if t not in anchors]
        bag = {t: left.count(t) * idf[t] for t in left}
        norm = sum(x * x for x in bag.values()) ** 0.5
        weight = {t: w for j, _, t, w in rows if j == k}
        assert not norm or sum(x * weight[t] for t, x in bag.items()) / norm < licenses.THRESHOLD


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(8)
    words = ["w%d" % i for i in range(4000)]
    text = {i: " ".join(rng.choices(words, k=60)) for i in range(80)}
    for i in range(0, 40, 2):
        text[i] += " vile vile"
    text[41] = text[43]
    near = text[45].split()
    near[30] = "other"
    text[47] = " ".join(near)
    passage = " ".join(rng.choices(words, k=70))
    text[49] += " " + passage
    text[51] = passage + " " + text[51]
    text[53] = text[53] + " alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    rows = [(i, t, "en", "s", len(t)) for i, t in text.items()] + [(100, None, None, None, None), (101, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i < 40 and i % 2 == 0)) for i in text], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "Beta gamma delta epsilon zeta eta theta iota kappa lambda")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {i for i in text if not (i < 40 and i % 2 == 0)} - {43, 47, 53} | {100, 101}
    assert got[49].n_tokens < 300 and got[100].n_tokens == 0


def test_pipeline_of_hostile_rows(spark, tmp_path):
    """Repeated rows, nulls, a very long text, an extra column with a clashing name, no labels and no benchmark; then no documents at all."""
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(4)
    words = ["w%d" % i for i in range(9000)]
    text = [" ".join(rng.choices(words, k=n)) for n in (40, 60, 30_000)]
    rows = [(1, text[0], "k"), (1, text[0], "k"), (2, text[1], None), (2, None, "k"), (3, text[2], "k"), (None, text[0] + " and its own end", "k"), (4, "", "k"), (5, "word", "k")]
    schema = "doc_id long, text string, _k1 string"
    for name, data in (("full", rows), ("none", [])):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    got = sorted((str(r.doc_id), r.n_tokens > 0) for r in pipeline.run(spark, f"{tmp_path}/full").collect())
    # the rows of document 1 repeat each other, and most of the row without an id
    assert [x for x, _ in got] == ["1", "1", "2", "2", "3", "4", "5", "None"]
    assert dict(got)["3"] and dict(got)["5"] and not dict(got)["4"]
    assert pipeline.run(spark, f"{tmp_path}/none").count() == 0
