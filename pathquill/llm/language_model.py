"""Text scores by a log-bilinear neural model, trained in numpy with noise-contrastive estimation.

The model predicts word classes: the most frequent words are classes of their own, all others share
classes by the look of their endings. A class' score is the product of its output vector with a sum of
position-weighted vectors of the preceding classes, plus a bias. Training tells text from noise drawn from
the class frequencies. It goes through the training documents once, in ``ROUNDS`` rounds of different documents: in a
round every task trains on its documents from the same start, and parameters and step sizes are averaged by
tokens before the next. Scoring takes one matrix product for a block of contexts and normalises
over all classes, so probabilities sum to one; inside a class a word has its smoothed share of counts.

Counts cover every training document. Of them a bounded head of frequent words is broadcast; the other
words of each document meet their counts in a join.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint_dir, crc_mod, drop_table, settle, table

#: Classes: the end, single words, and endings.
WORDS, ENDINGS = 255, 128
CLASSES = 1 + WORDS + ENDINGS
SIZE, CONTEXT, NOISE, BATCH = 16, 3, 48, 2048
#: Times that tasks exchange what they have learned; each document is in one of the rounds.
ROUNDS = 3
#: Normalisers that a task keeps, a power of two.
KEPT = 1 << 20
#: Contexts whose normalisers are worked out at once: their scores stay in the processor's cache.
ROWS = 256
#: Words at most whose counts are broadcast.
HEAD = 150_000
#: Bytes of text that are worked on at once.
SLICE = 2_000_000
END = b" "  # no word holds a space


@dataclass
class Tokens:
    """Tokens of some texts: the place of each word among the distinct ones, and where texts begin (ends are not in it)."""

    words: pa.BinaryArray
    at: np.ndarray
    first: np.ndarray


def tokens_of(texts: pa.Array) -> Tokens:
    """Words with A-Z lowered, parted by the six ASCII spaces; null reads as empty."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, offsets = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    some = pc.greater(pc.binary_length(flat), 0)  # spaces at a text's border leave an empty word
    before = np.concatenate(([0], np.cumsum(some.to_numpy(zero_copy_only=False))))
    coded = flat.filter(some).dictionary_encode()
    return Tokens(coded.dictionary.cast(pa.binary()), coded.indices.to_numpy(), before[offsets])


def sliced(column: pa.Array, size: int = SLICE) -> Iterator[tuple[int, pa.Array]]:
    """(row, texts) of consecutive slices of about ``size`` bytes, one text at least."""
    column = column.cast(pa.large_string())
    lengths = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy())
    at = 0
    while at < len(column):
        end = int(np.searchsorted(lengths, (lengths[at - 1] if at else 0) + size, "right"))
        end = max(end, at + 1)
        yield at, column.slice(at, end - at)
        at = end


MARKS = np.isin(np.arange(256), list(b".,;:!?"))


def endings(words: pa.BinaryArray) -> np.ndarray:
    """Classes of words without one of their own: by their last three bytes, marks behind them aside, and whether there are such marks."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    start, end = offsets[:-1], offsets[1:].copy()
    letters = np.frombuffer(words.buffers()[2] or bytes(1), np.uint8)
    at = np.flatnonzero(end > start)
    step = 0
    while len(at := at[MARKS[letters[end[at] - 1]]]):
        if step == 32:  # the few with longer tails, each at once
            for k in at.tolist():
                end[k] = start[k] + len(letters[start[k] : end[k]].tobytes().rstrip(b".,;:!?"))
            break
        end[at] -= 1
        at = at[end[at] > start[at]]
        step += 1
    h = (end < offsets[1:]).astype(np.uint64)
    for k in (1, 2, 3):
        there = end - k >= start
        h = h * np.uint64(257) + np.where(there, letters[np.where(there, end - k, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0))
    return (1 + WORDS + ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(ENDINGS)).astype(np.int64)


def classes_of(words: pa.BinaryArray, own: pa.BinaryArray) -> np.ndarray:
    """Class of each word: 0 for the end, k + 1 for the k-th of ``own``, else its ending's."""
    own_at = pc.index_in(words, own).fill_null(-1).to_numpy()
    out = np.where(own_at >= 0, own_at + 1, endings(words))
    out[pc.equal(words, END).to_numpy(zero_copy_only=False)] = 0
    return out


def start_of(bias: np.ndarray) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(5)
    return {
        "r": rng.normal(0, 0.1, (CLASSES + 1, SIZE)).astype(np.float32),  # context vectors; the last stands before the text
        "q": rng.normal(0, 0.1, (CLASSES, SIZE)).astype(np.float32),
        "c": np.full((CONTEXT, SIZE), 1.0, np.float32),
        "b": bias.astype(np.float32),
    }


def sequence(classes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts' classes in a row, ``CONTEXT`` times ``CLASSES`` before each and its end (0) behind it; and where its tokens begin.

    ``classes`` are of words alone, ``first`` where each text begins in them, with the end of the last.
    """
    n = len(first) - 1
    out = np.full(len(classes) + n * (CONTEXT + 1), CLASSES, np.int64)
    begin = first[:-1] + np.arange(n) * (CONTEXT + 1) + CONTEXT
    out[np.arange(len(classes)) + np.repeat(np.arange(1, n + 1) * (CONTEXT + 1) - 1, np.diff(first))] = classes
    out[begin + np.diff(first)] = 0
    return out, begin


def hidden(e: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Sums of the position-weighted vectors of the ``CONTEXT`` entries before each entry of ``e`` from ``CONTEXT`` on."""
    n = len(e) - CONTEXT
    h = e[CONTEXT - 1 : CONTEXT - 1 + n] * c[0]
    for k in range(1, CONTEXT):
        h += e[CONTEXT - 1 - k : CONTEXT - 1 - k + n] * c[k]
    return h


def train_step(m: dict, grads: dict, noise_p: np.ndarray, seq: np.ndarray, rng, rate: float) -> None:
    """One noise-contrastive step with Adagrad on the tokens of ``seq`` behind its first ``CONTEXT`` entries.

    ``CLASSES`` in it stands before a text and is context alone. Noise words are shared by the step.
    """
    noise = rng.choice(CLASSES, NOISE, p=noise_p)
    log_kp = np.log(NOISE * noise_p).astype(np.float32)
    e = m["r"][seq]
    h = hidden(e, m["c"])
    real = seq[CONTEXT:] < CLASSES
    word = np.where(real, seq[CONTEXT:], 0)
    qw = m["q"][word]
    with np.errstate(over="ignore"):
        up = real / (1 + np.exp(np.einsum("bd,bd->b", h, qw) + (m["b"] - log_kp)[word]))  # 1 - sigmoid
        down = h @ m["q"][noise].T
        down += (m["b"] - log_kp)[noise]
        np.negative(down, out=down)
        np.exp(down, out=down)
    down += 1
    np.divide(real[:, None].astype(np.float32), down, out=down)  # sigmoid
    n, up = max(int(real.sum()), 1), up.astype(np.float32)
    gh = up[:, None] * qw - down @ m["q"][noise]
    # an entry is a word once and context of the CONTEXT next ones
    both = np.zeros((len(seq), 2 * SIZE + 1), np.float32)
    both[CONTEXT:, :SIZE] = up[:, None] * h
    both[CONTEXT:, 2 * SIZE] = up
    for k in range(CONTEXT):
        both[CONTEXT - 1 - k : len(seq) - 1 - k, SIZE : 2 * SIZE] += gh * m["c"][k]
    sums = summed(seq, both, CLASSES + 1)
    gq, gr, gb = sums[:CLASSES, :SIZE], sums[:, SIZE : 2 * SIZE], sums[:CLASSES, 2 * SIZE]
    np.subtract.at(gq, noise, down.T @ h)
    np.subtract.at(gb, noise, down.sum(0))
    gc = np.stack([np.einsum("bd,bd->d", e[CONTEXT - 1 - k : len(seq) - 1 - k], gh) for k in range(CONTEXT)])
    for name, g in (("q", gq), ("b", gb), ("r", gr), ("c", gc)):
        g = g / np.float32(math.sqrt(n))
        grads[name] += g * g
        m[name] += rate * g / np.sqrt(grads[name] + 1e-6)


def summed(at: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Sums of the rows at each place: a place's rows are brought together by sorting."""
    order = np.argsort(at.astype(np.int16), kind="stable")  # places fit 16 bits, which numpy sorts by radix
    at = at[order]
    starts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    out = np.zeros((size, rows.shape[1]), np.float32)
    out[at[starts]] = np.add.reduceat(rows[order], starts, axis=0)
    return out


@dataclass
class Counts:
    """What the corpus gives: totals, the head's counts, and the words and masses of classes."""

    head: pa.BinaryArray
    times: np.ndarray  # counts of the head's words
    ends: int  # how often the end occurs, which is not in the head
    total: int  # N
    distinct: int  # V
    own: pa.BinaryArray  # words with a class of their own
    mass: np.ndarray  # tokens of each class
    kinds: np.ndarray  # distinct words of each class

    def base(self, count: int) -> float:
        return math.log10((count + 0.5) / (self.total + 0.5 * (self.distinct + 1)))

    def share(self, cls: int) -> float:
        """What a word's log10(count + 0.5) lacks to its share of a class of several words."""
        return -math.log10(self.mass[cls] + 0.5 * (self.kinds[cls] + 1))


def count_words(docs: DataFrame) -> DataFrame:
    """``token, c`` over the texts of ``docs``, the end of each among them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows, ends = 0, 0

        def folded() -> pa.Table:
            return pa.concat_tables(held).group_by("token").aggregate([("c", "sum")]).rename_columns(["token", "c"])

        for batch in batches:
            ends += batch.num_rows
            for _, texts in sliced(batch.column(0)):
                t = tokens_of(texts)
                held.append(pa.table({"token": t.words, "c": np.bincount(t.at, minlength=len(t.words)).astype(np.int64)}))
                rows += len(t.words)
                if rows > 800_000:
                    held = [folded()]
                    rows = held[0].num_rows
                    if rows > 400_000:
                        yield from held[0].to_batches()
                        held, rows = [], 0
        if ends:
            held.append(pa.table({"token": pa.array([END], pa.binary()), "c": pa.array([ends], pa.int64())}))
            yield from folded().to_batches()

    return docs.select("text").mapInArrow(count, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


def head_of(counts: DataFrame, most: int = HEAD) -> pa.Table:
    """The words of the largest counts with those counts, all of one count or none; at most ``most``, so that they may be broadcast.

    A histogram of counts (exact below 1,024, sixteen steps to an octave above) tells the smallest count that fits; only words
    that reach it leave the executors.
    """
    step = F.when(F.col("c") < 1024, F.col("c")).otherwise(F.floor(F.log2("c") * 16).cast("long") + 1024 - 160)
    bins = counts.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("c").alias("least")).collect()  # below 2,000 rows
    least, held = None, 0
    for b in sorted(bins, key=lambda b: -b.step):
        held += b.n
        if held > most:
            break
        least = b.least
    return counts.where((F.col("c") >= F.lit(least)) & (F.col("token") != F.lit(END))).select("token", "c").toArrow().combine_chunks()


def gather(spark: SparkSession, counts: DataFrame) -> Counts:
    head = head_of(counts).sort_by([("c", "descending"), ("token", "ascending")])
    words = pa.concat_arrays(head.column("token").cast(pa.binary()).chunks) if head.num_rows else pa.array([], pa.binary())
    own = pa.array(words.slice(0, WORDS).to_pylist(), pa.binary())  # without the head's buffers
    ends = counts.where(F.col("token") == F.lit(END)).agg(F.sum("c")).first()[0] or 0

    def by_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass, kinds = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for batch in batches:
            at = classes_of(batch.column(0), own)
            np.add.at(mass, at, batch.column(1).to_numpy())
            kinds += np.bincount(at, minlength=CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(mass), pa.array(kinds)], names=["cls", "mass", "kinds"])

    rows = counts.mapInArrow(by_class, "cls long, mass long, kinds long").groupBy("cls").agg(F.sum("mass").alias("mass"), F.sum("kinds").alias("kinds")).collect()  # CLASSES rows
    mass, kinds = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for r in rows:
        mass[r.cls], kinds[r.cls] = r.mass, r.kinds
    return Counts(words, head.column("c").to_numpy(), ends, int(mass.sum()), int(kinds.sum()), own, mass, kinds)


def train(docs: DataFrame, counts: Counts, rate: float = 0.15) -> dict[str, np.ndarray]:
    """The model after one pass over all ``docs``: each text is in one of ``ROUNDS`` rounds, by its hash."""
    spark = docs.sparkSession
    noise_p = (counts.mass + 1.0) / (counts.mass + 1.0).sum()
    model = start_of(np.log(noise_p))
    shapes = {k: v.shape for k, v in model.items()}
    grads = {k: np.zeros_like(v) for k, v in model.items()}
    size = sum(v.size for v in model.values())
    for part in range(ROUNDS):
        shared = spark.sparkContext.broadcast((model, grads, noise_p, counts.own))

        def fit(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            begin, g0, p, own = shared.value
            m, g = ({k: v.copy() for k, v in x.items()} for x in (begin, g0))
            rng, seen = np.random.default_rng(11), 0
            for batch in batches:
                for _, texts in sliced(batch.column(0)):
                    t = tokens_of(texts)
                    seq, _ = sequence(classes_of(t.words, own)[t.at], t.first)
                    for a in range(CONTEXT, len(seq), BATCH):
                        train_step(m, g, p, seq[a - CONTEXT : a + BATCH], rng, rate)
                    seen += len(t.at) + len(texts)
            if seen:
                values = np.concatenate([x[k].reshape(-1) for x in (m, g) for k in shapes]).astype(np.float64) * seen
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values), pa.array(np.full(len(values), seen))], names=["slot", "value", "seen"])

        mine = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(ROUNDS)) == part)
        got = mine.mapInArrow(fit, "slot long, value double, seen long").groupBy("slot").agg((F.sum("value") / F.sum("seen")).alias("value")).toArrow()  # one row a parameter
        if got.num_rows:
            flat = np.zeros(2 * size, np.float32)
            flat[got.column("slot").to_numpy()] = got.column("value").to_numpy()
            model, grads = parted(flat[:size], shapes), parted(flat[size:], shapes)
    return model


def parted(flat: np.ndarray, shapes: dict[str, tuple[int, ...]]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, shape in shapes.items():
        n = int(np.prod(shape))
        out[k], at = flat[at : at + n].reshape(shape), at + n
    return out


class Scorer:
    """Log-probabilities under a model; the normalisers of the last contexts are kept, one at each place of a table."""

    def __init__(self, m: dict[str, np.ndarray]):
        self.m = m
        self.code = np.full(KEPT, -1, np.int64)
        self.log_z = np.zeros(KEPT, np.float32)
        self.last = np.zeros(KEPT, np.int64)
        self.out = np.concatenate([m["q"], m["b"][:, None]], axis=1).T.copy()  # biases as one more dimension
        self.ones = np.ones(CLASSES, np.float32)

    def normaliser(self, h: np.ndarray) -> np.ndarray:
        """Logarithms of the sums over all classes; ``h`` ends with a column of ones."""
        s = h @ self.out
        low = 0.0
        if len(s) and (s.max() > 60 or s.max(1).min() < -60):  # beyond what single precision holds
            low = s.max(1)
            s -= low[:, None]
        np.exp(s, out=s)
        return np.log(s @ self.ones) + low

    def __call__(self, seq: np.ndarray) -> np.ndarray:
        """Natural log-probabilities of the entries of ``seq`` after the first ``CONTEXT``, each after those before it, normalised over all classes.

        Places that stand before a text get a figure without meaning.
        """
        n = len(seq) - CONTEXT
        code = np.zeros(n, np.int64)
        for k in range(CONTEXT):
            code = code * (CLASSES + 1) + seq[CONTEXT - 1 - k : CONTEXT - 1 - k + n]
        h = np.ones((n, SIZE + 1), np.float32)
        h[:, :SIZE] = hidden(self.m["r"][seq], self.m["c"])
        place = code * 0x9E3779B1 >> 20 & KEPT - 1
        log_z = self.log_z[place]
        new = np.flatnonzero(self.code[place] != code)
        for a in range(0, len(new), ROWS):
            at = new[a : a + ROWS]
            log_z[at] = self.normaliser(h[at])
        # of codes that share a place one stays, in both arrays alike
        self.last[place[new]] = new
        stay = new[self.last[place[new]] == new]
        self.code[place[stay]], self.log_z[place[stay]] = code[stay], log_z[stay]
        word = np.minimum(seq[CONTEXT:], CLASSES - 1)
        return np.einsum("nd,nd->n", h, self.out.T[word]) - log_z


def learn(docs: DataFrame, text: str = "text") -> tuple[Counts, dict[str, np.ndarray], DataFrame, str]:
    """Counts, model, the table of all words' counts, and the place of that table, from every text of ``docs``."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    place = f"{checkpoint_dir(spark)}/counts-{uuid.uuid4().hex}"
    count_words(texts).write.option("compression", "zstd").parquet(place)
    counts_table = spark.read.parquet(place)
    counts = gather(spark, counts_table)
    return counts, train(texts, counts), counts_table, place


PARTS = [("token", "binary", pa.binary()), ("k1", "long", pa.int64()), ("k2", "long", pa.int64()), ("doc_id", "", None), ("times", "long", pa.int64()), ("n_tokens", "long", pa.int64()), ("n_known", "long", pa.int64()), ("base", "double", pa.float64()), ("lm", "double", pa.float64()), ("share", "double", pa.float64())]


def score_texts(docs: DataFrame, learned: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs``.

    The model learns from ``learned`` (texts). Null texts are empty and have one token, their
    end; long texts are taken whole, other columns are not read. Equal rows get equal scores. Without a training document every word is unknown.
    An empty ``docs`` gives no rows.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    counts, model, counts_table, place = learn(learned, text)
    shared = spark.sparkContext.broadcast((counts, model))
    kind = docs.schema[doc_id].dataType.simpleString()

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document with what the head tells, and one for each other word in it."""
        c, m = shared.value
        scorer = Scorer(m)
        share = np.array([c.share(i) for i in range(CLASSES)])
        single = np.arange(CLASSES) <= WORDS
        floor = math.log10(c.total + 0.5 * (c.distinct + 1))
        end_base, end_known = c.base(c.ends), int(c.ends > 0)

        def made(**columns) -> pa.RecordBatch:
            n = len(columns["k1"])
            arrays = []
            for name, _, kind in PARTS:
                x = columns.get(name, 0)
                arrays.append(x if isinstance(x, pa.Array) else pa.array(np.full(n, x) if np.isscalar(x) else x, kind))
            return pa.RecordBatch.from_arrays(arrays, names=[p[0] for p in PARTS])

        for batch in batches:
            k1, k2 = (batch.column(k).to_numpy() for k in (0, 1))
            for row, texts in sliced(batch.column(3)):
                t = tokens_of(texts)
                words, cls = t.words, classes_of(t.words, c.own)
                seq, begin = sequence(cls[t.at], t.first)
                lp = scorer(seq) / math.log(10)  # of the entries from CONTEXT on
                sizes = np.diff(t.first)
                tokens = np.concatenate(([0.0], np.cumsum(np.where(seq[CONTEXT:] < CLASSES, lp, 0), dtype=np.float64)))
                lp = tokens[begin - CONTEXT + sizes + 1] - tokens[begin - CONTEXT]
                held = pc.index_in(words, c.head).fill_null(-1).to_numpy()
                known = held >= 0
                n = np.where(known, np.append(c.times, 0)[held], 0)
                log_n = np.log10(n + 0.5)
                base_of = np.where(known, log_n - floor, 0)
                inner_of = np.where(known & ~single[cls], log_n + share[cls], 0)
                sums = (np.concatenate(([0], np.cumsum(x[t.at])))[t.first] for x in (base_of, inner_of, known.astype(np.int64)))
                base, inner, n_known = (np.diff(x) for x in sums)
                own = slice(row, row + len(texts))
                token = pa.array([b" %d %d" % pair for pair in zip(k1[own].tolist(), k2[own].tolist(), strict=True)], pa.binary())
                yield made(token=token, k1=k1[own], k2=k2[own], doc_id=batch.column(2).slice(row, len(texts)), n_tokens=sizes + 1, n_known=n_known + end_known, base=base + end_base, lm=lp + inner)
                rest = np.flatnonzero(~known[t.at])
                if len(rest):
                    doc = np.repeat(np.arange(len(texts)), sizes)[rest]
                    pair, times = np.unique(doc * len(words) + t.at[rest], return_counts=True)
                    doc, word = pair // len(words), pair % len(words)
                    yield made(token=t.words.take(pa.array(word)), k1=k1[own][doc], k2=k2[own][doc], doc_id=batch.column(2).take(pa.array(row + doc)), times=times, share=share[cls[word]])

    marked = source.select(F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", F.lit(1), "doc_id").alias("k2"), "doc_id", "text")
    parts = marked.mapInArrow(look, ", ".join(f"{name} {sql or kind}" for name, sql, _ in PARTS))
    parts = parts.join(counts_table, "token", "left")
    c = F.coalesce("c", F.lit(0)).cast("double") + 0.5
    floor = counts.total + 0.5 * (counts.distinct + 1)
    parts = parts.select(
        "k1",
        "k2",
        "doc_id",
        (F.col("n_tokens") > 0).cast("long").alias("rows"),
        "n_tokens",
        (F.col("n_known") + F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("n_known"),
        (F.col("base") + F.col("times") * F.log10(c / F.lit(floor))).alias("base"),
        (F.col("lm") + F.col("times") * (F.log10(c) + F.col("share"))).alias("lm"),
    )
    sums = parts.groupBy("k1", "k2", "doc_id").agg(*(F.sum(x).alias(x) for x in ("rows", "n_tokens", "n_known", "base", "lm")))
    # equal rows were summed: each gets its share
    each = sums.select("*", F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("copy"))
    result = each.select(
        "doc_id",
        F.expr("n_tokens div rows").alias("n_tokens"),
        F.expr("n_known div rows").alias("n_known"),
        F.lit(counts.total).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("rows")).alias("base_score"),
        (F.col("lm") / F.col("rows")).alias("score"),
    )
    result = settle(result)
    drop_table(spark, place)
    return result


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(crc_mod(doc_id, 5) == 1, F.lit(False))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all ``documents``, learned from those not held out; a null id is not held out. Cases as in :func:`score_texts`."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_texts(docs, docs.where(~held_out())).select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
