"""LM scoring: a log-bilinear neural model trained in numpy with noise-contrastive estimation.

The FREQUENT commonest words and the end mark are symbols of their own; every other word shares one
of CLASSES tail symbols with words of like endings.  Symbols lie in CLASSES classes of MEMBERS, also by
their endings, each with one tail symbol.  A word's probability is

    P(class | context) * P(symbol | class, context) * P(word | symbol)

The context is the CONTEXT symbols before: their vectors, each scaled by weights of its place, add up
to the predicted vector, whose products with the vectors of the classes, and of the symbols of one
class, are the scores.  Both levels are trained by noise-contrastive estimation against NOISE symbols
drawn by their own frequencies; scoring normalises both by batched matrix products.  The last factor is an add-one estimate inside the symbol with one place for unseen words; it
needs the corpus-wide word counts, which reach the documents by the frequency-split join of `wordjoin`.

Every training token is used once.  Each task trains on its own texts from common parameters, and the
results are averaged by their tokens in a tree of AVERAGED at a time, ROUNDS times over the shares of
the texts; no text and no count of contexts reaches the driver, only parameters of fixed size.

Edge cases: null and empty texts consist of the end mark alone; without training rows every count
is 0 and the model is uniform over what the symbols allow; null doc_ids are held in training (they have
no remainder); repeated rows are scored row by row; words that tie in frequency are taken in their
order; texts of any length are scored whole; an empty table gives an empty result; columns besides
doc_id and text, whatever their names, are not looked at.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordjoin
from .common import lower_words, remainder, small_batches, stored

CLASSES, MEMBERS = 64, 64
SYMBOLS = CLASSES * MEMBERS
FREQUENT = SYMBOLS - CLASSES - 1  # words with a symbol of their own
DIM = 12
CONTEXT = 3
NOISE = 32
BATCH = 8192  # tokens a step of training sees
ROUNDS = 2
AVERAGED = 16
CHUNK = 8192  # tokens scored at once


class _Cache(dict):
    """word -> symbol; looks up and keeps what it lacks."""

    def __init__(self, symbols: Symbols):
        super().__init__(symbols.fixed)
        self.symbols = symbols

    def __missing__(self, word: bytes) -> int:
        s = self[word] = self.symbols.of(word)
        return s


class Symbols:
    """word -> symbol, with a cache whose bound changes the speed only.  Symbol c * MEMBERS + j is member
    j of class c; the last member is the class's tail."""

    def __init__(self, frequent: list[bytes], bound: int = 500_000):
        own = sorted((w[::-1] for w in frequent[:FREQUENT]))
        seats = CLASSES * (MEMBERS - 1) - 1  # one seat is the end mark's, the last of the last class
        self.fixed, self.first = {}, []
        for i, w in enumerate(own):
            seat = i * seats // max(1, len(own))
            self.fixed[w[::-1]] = seat // (MEMBERS - 1) * MEMBERS + seat % (MEMBERS - 1)
        at = {s // MEMBERS: w[::-1] for w, s in sorted(self.fixed.items(), key=lambda x: x[0][::-1], reverse=True)}  # least of each class
        self.classes = sorted(at)
        self.first = [at[c] for c in self.classes]
        self.end = SYMBOLS - 2
        self.bound, self.cache = bound, _Cache(self)

    def of(self, word: bytes) -> int:
        s = self.fixed.get(word)
        if s is not None:
            return s
        k = bisect.bisect_right(self.first, word[::-1]) - 1
        return (self.classes[max(k, 0)] if self.classes else 0) * MEMBERS + MEMBERS - 1

    def __call__(self, words: list[bytes]) -> list[int]:
        if len(self.cache) > self.bound:
            self.cache = _Cache(self)
        return list(map(self.cache.__getitem__, words))

    def tokens(self, texts: list, units: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbols, places of tokens, text of each token) of a batch: every text's symbols and end mark
        behind CONTEXT end marks that are not tokens."""
        flat, sizes = [], []
        for words in units or map(lower_words, texts):
            s = self(words)
            flat.extend([self.end] * CONTEXT)
            flat.extend(s)
            flat.append(self.end)
            sizes.append(len(s) + 1)
        n = np.array(sizes, np.int64)
        of = np.repeat(np.arange(len(n)), n)
        return np.array(flat, np.int32), np.arange(len(of)) + CONTEXT * (of + 1), of


def usable(counts: np.ndarray, symbols: Symbols) -> np.ndarray:
    """Symbols that some word or the end mark can take."""
    out = np.zeros(SYMBOLS, bool)
    out[list(symbols.fixed.values())] = True
    out[[symbols.end, *(c * MEMBERS + MEMBERS - 1 for c in symbols.classes or [0])]] = True
    return out


class Model:
    """Parameters of the log-bilinear model and what scoring and training do with them."""

    def __init__(self, counts: np.ndarray, symbols: Symbols, seed: int = 7):
        rng = np.random.default_rng(seed)
        small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        mass = np.where(usable(counts, symbols), counts + 0.5, 0.0)
        by_class = mass.reshape(CLASSES, MEMBERS)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.class_noise = (by_class.sum(1) / mass.sum()).astype(np.float32)
            self.member_noise = np.nan_to_num(by_class / by_class.sum(1, keepdims=True)).astype(np.float32)
            self.class_draw = by_class.sum(1) / mass.sum()
            self.member_draw = np.cumsum(np.nan_to_num(by_class / by_class.sum(1, keepdims=True)), 1) * (1 - 1e-12)
            logs = [np.maximum(np.log(x), -60) for x in (self.class_noise, self.member_noise.ravel())]
        # context vectors, weights of places, class vectors and biases, symbol vectors and biases
        self.params = [small(SYMBOLS, DIM), np.full((CONTEXT, DIM), 0.7, np.float32), small(CLASSES, DIM), logs[0].astype(np.float32), small(SYMBOLS, DIM), logs[1].astype(np.float32)]

    def pack(self) -> bytes:
        return np.concatenate([p.ravel() for p in self.params]).tobytes()

    def unpack(self, raw: bytes) -> None:
        flat, at = np.frombuffer(raw, np.float32), 0
        for i, p in enumerate(self.params):
            self.params[i] = flat[at : at + p.size].reshape(p.shape).copy()
            at += p.size

    def predicted(self, context: list[np.ndarray]) -> np.ndarray:
        r, d = self.params[:2]
        return sum(r.take(c, 0) * d[i] for i, c in enumerate(context))

    @staticmethod
    def _by_class(target: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """Tokens in order of their class, and each class's part of them."""
        own = (target // MEMBERS).astype(np.uint8)  # bytes are sorted in linear time
        order = np.argsort(own, kind="stable")
        edge = np.searchsorted(own[order], np.arange(CLASSES + 1))
        return order, [(c, int(a), int(b)) for c, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if b > a]

    def log_probs(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log10 P(symbol | context) of the tokens at the given places."""
        _, _, qc, bc, qw, bw = self.params
        qc, qw = (np.concatenate([q, b[:, None]], 1) for q, b in ((qc, bc), (qw, bw)))  # beside a column of ones
        out = np.empty(len(at))

        def normalised(score: np.ndarray, pick: np.ndarray) -> np.ndarray:
            """Of one column a token: row pick's log-softmax."""
            score -= score.max(0)
            out = score[pick, np.arange(len(pick))].astype(np.float64)
            return out - np.log(np.exp(score, out=score).sum(0))

        for k in range(0, len(at), CHUNK):
            place = at[k : k + CHUNK]
            target = symbols[place]
            h = np.ones((len(place), DIM + 1), np.float32)
            h[:, :DIM] = self.predicted([symbols[place - 1 - i] for i in range(CONTEXT)])
            found = normalised(qc @ h.T, target // MEMBERS)
            order, parts = self._by_class(target)
            hs, members = h[order], target[order] % MEMBERS
            for c, a, b in parts:
                score = qw[c * MEMBERS : (c + 1) * MEMBERS] @ hs[a:b].T
                found[order[a:b]] += normalised(score, members[a:b])
            out[k : k + CHUNK] = found
        return out / np.log(10)

    def step(self, symbols: np.ndarray, at: np.ndarray, sums: list[np.ndarray], rate: float, rng: np.random.Generator) -> None:
        """One step of noise-contrastive estimation on the tokens at the given places.  At each level the
        tokens of a step share NOISE symbols drawn from the noise.  Tokens lie in order of their class, one
        row a token; a last column of ones carries the biases through the same products."""
        r, d, qc, bc, qw, bw = self.params
        order, parts = self._by_class(symbols[at])
        first, size = int(at[0]) - CONTEXT, int(at[-1]) + 1 - int(at[0]) + CONTEXT
        near = symbols[first : first + size].astype(np.int64)  # the tokens and all their contexts
        at = at[order] - first
        target = near[at]
        vector = r.take(near, 0)
        h = np.ones((len(at), DIM + 1), np.float32)
        h[:, :DIM] = sum(vector[CONTEXT - 1 - i : size - 1 - i] * d[i] for i in range(CONTEXT)).take(at - CONTEXT, 0)
        columns, back = np.ascontiguousarray(h.T), np.zeros_like(h)

        def level(q, b, noise, pick, drawn, parts) -> np.ndarray:
            """Slopes of one level's vectors and biases: a score is a true symbol's, and no noise, with
            probability 1 / (1 + weight / exp(score))."""
            q = np.concatenate([q, b[:, None]], 1)
            weight = np.log(NOISE * noise)
            rows = q.take(pick, 0)
            score = np.einsum("ij,ij->i", h, rows)
            up = 1 / (1 + np.exp(score - weight.take(pick)))
            rows *= up[:, None]
            np.add(back, rows, out=back)
            pulled = columns * up
            slopes = np.stack([np.bincount(pick, weights=x, minlength=len(q)) for x in pulled], 1).astype(np.float32)
            names = np.concatenate(drawn)
            noise_rows = q.take(names, 0)
            fixed = noise_rows.copy()
            fixed[:, DIM] -= weight.take(names)
            found = np.empty_like(noise_rows)
            for k, (lo, hi) in enumerate(parts):
                own, hs = slice(k * NOISE, (k + 1) * NOISE), h[lo:hi]
                down = fixed[own] @ hs.T
                np.exp(np.negative(down, out=down), out=down)
                down += 1
                np.divide(-1, down, out=down)
                back[lo:hi] += down.T @ noise_rows[own]
                np.matmul(down, hs, out=found[own])
            np.add.at(slopes, names, found)
            return slopes

        with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
            classes = level(qc, bc, self.class_noise, target // MEMBERS, [rng.choice(CLASSES, NOISE, p=self.class_draw)], [(0, len(at))])
            drawn = [c * MEMBERS + np.searchsorted(self.member_draw[c], rng.random(NOISE)) for c, _, _ in parts]
            members = level(qw, bw, self.member_noise.ravel(), target, drawn, [(a, b) for _, a, b in parts])
        pull, pushed = np.zeros((size, DIM), np.float32), np.zeros((size, DIM), np.float32)
        pull[at] = back[:, :DIM]
        for i in range(CONTEXT):
            pushed[: size - 1 - i] += pull[1 + i :] * d[i]
        places = np.stack([np.einsum("ij,ij->j", pull[1 + i :], vector[: size - 1 - i]) for i in range(CONTEXT)])
        vectors = np.stack([np.bincount(near, weights=x, minlength=SYMBOLS) for x in np.ascontiguousarray(pushed.T)], 1)
        grads = [vectors.astype(np.float32), places, classes[:, :DIM], classes[:, DIM], members[:, :DIM], members[:, DIM]]
        for p, s, x in zip(self.params, sums, grads, strict=True):
            s += x * x
            p += np.float32(rate) * x / np.sqrt(s)

    def train(self, batches: Iterator[tuple[np.ndarray, np.ndarray]], rate: float = 0.12) -> int:
        """Steps over (symbols, places) of texts in turn; how many tokens there were."""
        sums, seen, rng = [np.full_like(p, 1e-8) for p in self.params], 0, np.random.default_rng(17)
        for symbols, at in batches:
            for k in range(0, len(at), BATCH):
                self.step(symbols, at[k : k + BATCH], sums, rate, rng)
            seen += len(at)
        return seen


def _averaged(table: pa.Table) -> pa.Table:
    n = np.array(table.column("n").to_pylist(), np.float64)
    order = np.argsort(table.column("part").to_numpy(), kind="stable")
    total = sum(n[i] * np.frombuffer(table.column("model")[int(i)].as_py(), np.float32).astype(np.float64) for i in order)
    return pa.table({"part": pa.array([int(table.column("part")[int(order[0])].as_py())], pa.int32()), "n": pa.array([float(n.sum())]), "model": pa.array([(total / n.sum()).astype(np.float32).tobytes()], pa.binary())})


def fit(train_docs: DataFrame, model: Model, frequent: list[bytes], rounds: int = ROUNDS) -> Model:
    """Trains on every text of train_docs once, a share of them a round, and averages after each."""
    share = F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds))
    for turn in range(rounds):
        shared = train_docs.sparkSession.sparkContext.broadcast((model, frequent))

        def learn(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            start, words = shared.value
            own = Model.__new__(Model)
            own.__dict__.update(start.__dict__, params=[p.copy() for p in start.params])
            symbols = Symbols(words)
            n = own.train(symbols.tokens(b.column(0).to_pylist())[:2] for b in batches)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([float(n)]), pa.array([own.pack()], pa.binary())], names=["part", "n", "model"])

        schema = "part int, n double, model binary"
        made = stored(train_docs.filter(share == turn).select("text").mapInArrow(learn, schema), "models")
        while made.count() > AVERAGED:  # neighbours are averaged AVERAGED at a time
            made = stored(made.groupBy(F.floor(F.col("part") / AVERAGED).alias("g")).applyInArrow(lambda t: _averaged(t.drop_columns(["g"]) if "g" in t.column_names else t), schema).withColumn("part", F.floor(F.col("part") / AVERAGED).cast("int")), "models")
        rows = made.toArrow()  # at most AVERAGED models of fixed size
        if rows.num_rows:
            model.unpack(_averaged(rows).column("model")[0].as_py())
        shared.unpersist()
    return model


@dataclass
class Corpus:
    """What is learnt from the training texts besides the word table."""

    tokens: int  # N, end marks included
    distinct: int  # V, the end mark included
    texts: int
    frequent: list[bytes]
    counts: np.ndarray  # of each symbol's words
    place: np.ndarray  # log10 of (count + distinct + 1) of each symbol's words


def learn_counts(train_docs: DataFrame) -> tuple[DataFrame, Corpus]:
    """The word table (unit, n, value = log10(n + 1)) and the corpus figures."""
    table = stored(wordjoin.count_units(train_docs, lower_words).withColumn("value", F.log10(F.col("n") + 1.0)), "words")
    frequent = [row["unit"].encode() for row in table.filter(~F.startswith("unit", F.lit("\x01"))).orderBy(F.desc("n"), "unit").select("unit", "n").limit(FREQUENT).collect()]
    symbol = Symbols(frequent)

    def by_symbol(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(SYMBOLS, np.int64), np.zeros(SYMBOLS, np.int64)
        for batch in batches:
            s = np.array([symbol.of(u.encode()) for u in batch.column(0).to_pylist()], np.int64)
            n += np.bincount(s, weights=batch.column(1).to_numpy(), minlength=SYMBOLS).astype(np.int64)
            v += np.bincount(s, minlength=SYMBOLS)
        yield pa.RecordBatch.from_arrays([pa.array(range(SYMBOLS), pa.int32()), pa.array(n), pa.array(v)], names=["symbol", "n", "v"])

    sums = {r["symbol"]: (r["n"], r["v"]) for r in table.select("unit", "n").mapInArrow(by_symbol, "symbol int, n bigint, v bigint").groupBy("symbol").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()}
    texts = train_docs.count()
    n = np.array([sums.get(s, (0, 0))[0] for s in range(SYMBOLS)], float)
    v = np.array([sums.get(s, (0, 0))[1] for s in range(SYMBOLS)], float)
    n[symbol.end], v[symbol.end] = texts, 1 if texts else 0
    return table, Corpus(int(n.sum()), int(v.sum()), texts, frequent, n, np.log10(n + v + 1))


def score_texts(docs: DataFrame, modulus: int = 7, held: int = 2, hot_limit: int = wordjoin.HOT_UNITS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score per row of docs."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    train_docs = docs.filter(F.coalesce(remainder("doc_id", modulus), F.lit(-1)) != held)
    table, corpus = learn_counts(train_docs)
    model = fit(train_docs, Model(corpus.counts, Symbols(corpus.frequent)), corpus.frequent)
    shared = docs.sparkSession.sparkContext.broadcast((model, corpus.frequent, corpus.place))
    end_value = float(np.log10(corpus.texts + 1))
    hot = {u.encode(): v[0] for u, v in wordjoin.hot_units(table, "value", limit=hot_limit).items()}
    state: dict = {}

    def extra(texts: list, units: list) -> Iterator[tuple]:
        model, frequent, place = shared.value
        symbols = state.get("symbols") or state.setdefault("symbols", Symbols(frequent))
        flat, at, of = symbols.tokens(texts, units)
        gain = model.log_probs(flat, at) - place[flat[at]]
        return zip(np.bincount(of, minlength=len(texts)).tolist(), np.bincount(of, weights=gain, minlength=len(texts)).tolist(), strict=True)

    rows = wordjoin.split_rows(docs, lower_words, hot, extra, [("n_tokens", pa.int64(), "bigint"), ("model", pa.float64(), "double")])
    unknown = F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("unknown")
    out = wordjoin.join_tail(rows, table.select("unit", "value"), "value", ["n_tokens", "model"], 0.0, [unknown])
    n, counted = F.col("n_tokens"), F.col("total") + end_value
    per_token = float(np.log10(corpus.tokens + corpus.distinct + 1))
    return out.select(
        "doc_id",
        F.coalesce(remainder("doc_id", modulus) == held, F.lit(False)).alias("held_out"),
        "n_tokens",
        (n - F.col("unknown") - (0 if corpus.texts else 1)).alias("n_known"),
        F.lit(corpus.tokens).cast("bigint").alias("train_tokens"),
        (counted - n * per_token).alias("base_score"),
        (counted + F.col("model")).alias("score"),
    )
