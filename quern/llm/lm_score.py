"""Language-model scores from a subword lattice.

An existing subword vocabulary weights all segmentations of a word: pieces
that begin a word, and pieces, bytes or a stop inside one, are two
distributions, so that the probabilities of all words add up to one. The
forward recursion over a word's lattice, in log space, gives the sum over all
its segmentations; pieces never cross words. The vocabulary's file carries
ranks instead of probabilities; they give the weights to begin with (falling
as one over the rank), and ROUNDS rounds of expected counts over all distinct
training words (forward and backward sums, EM) make them likelihoods. A
distinct word counts once: the lattice has to answer for new words, which
resemble the rare ones, and each rare word is one of many.

A text's kind (its language, in the query) is a hidden variable: each of the
most frequent KINDS - 1 kinds of training rows, and all others together, has
piece weights and word counts of its own (the others only where there are any). Within a kind a word is drawn from
the kind's counts; with the share of tokens that stand alone there (what a next
word is new with) it is drawn from all kinds' counts or, mostly, spelled by the
lattice. The text's marginal probability is the sum over kinds of the kind's
share times the product over its words and one end; the kind of a text to be
scored is not looked at.

The corpus is counted in a table with one row for each distinct word. What a
text needs of it is looked up in two ways: the most frequent words (FREQUENT
at most, of bounded length, by a count that a histogram of counts gives)
travel with the tasks, which settles most tokens where they lie and keeps hot
words out of the shuffle; the remaining (text, word) pairs meet the table in
an equi-join.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, remainder

VOCABULARY = "piece_bpe_32k.model"
FREQUENT, LONGEST = 131_072, 64
SMOOTH = 0.1
#: Kinds of text, the one of all rare kinds included; rounds of expected counts; characters that a lattice covers at once.
KINDS, ROUNDS, STRETCH = 6, 2, 4096
_FLUSH = 400_000
_BATCH = 40_000


def tokens_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def kinds_of(docs: DataFrame, most: int = KINDS) -> tuple[list[str], bool]:
    """The most frequent kinds of the training rows, at most `most` - 1, and whether there are others, nulls among them."""
    if "kind" not in docs.columns or most < 2:
        return [], True
    by = docs.where("train").groupBy("kind").count().orderBy(F.desc("count"), "kind").limit(most).collect()
    names = [r["kind"] for r in by if r["kind"] is not None][: most - 1]
    return names, not names or any(r["kind"] not in names for r in by)


def word_counts(docs: DataFrame, n: int) -> DataFrame:
    """word (binary) and c (array): its counts by place of the kind in the rows whose `train` is true, for every word.

    `docs` has text, train and at (0 to `n` - 1).
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every: set[bytes] = set()
        train: list[Counter[bytes]] = [Counter() for _ in range(n)]

        def flush() -> Iterator[pa.RecordBatch]:
            for k, part in enumerate([dict.fromkeys(every, 0), *train]):
                columns = [pa.array(part.keys(), pa.binary()), pa.array([max(k - 1, 0)] * len(part), pa.int32()), pa.array(part.values(), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["word", "at", "n"])
                part.clear()
            every.clear()

        for batch in batches:
            for text, of_train, at in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                (train[at] if of_train else every).update(tokens_of(text.as_py()))
                if len(every) + sum(map(len, train)) > _FLUSH:
                    yield from flush()
        yield from flush()

    rows = docs.select(F.col("text").cast("string").alias("text"), "train", "at").mapInArrow(each, "word binary, at int, n long")
    sums = [F.sum(F.when(F.col("at") == k, F.col("n")).otherwise(0)).alias(f"c{k}") for k in range(n)]
    # Tasks have summed up their words. The table is small beside the work on it, so its parts are set here, not by their bytes.
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    return rows.repartition(parts, "word").groupBy("word").agg(*sums).select("word", F.array(*[f"c{k}" for k in range(n)]).alias("c"))


def _processor(path: str | None):
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(VOCABULARY))


_FACTOR = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class _Beginnings:
    """All beginnings of some pieces by a 64-bit hash, with the row of the piece that each is, or -1."""

    hashes: np.ndarray
    rows: np.ndarray

    @classmethod
    def of(cls, pieces: dict[str, int]) -> _Beginnings:
        every = {p[:j]: -1 for p in pieces for j in range(1, len(p))} | {p: r for p, r in pieces.items() if p}
        found = []
        for text in every:
            h = 0
            for c in text:
                h = (h * int(_FACTOR) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
            found.append(h)
        hashes, rows = np.array(found, np.uint64), np.array(list(every.values()), np.int64)
        order = np.argsort(hashes)
        return cls(hashes[order], rows[order])

    def matches(self, chars: np.ndarray, at: np.ndarray, limit: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """For 1, 2, ... characters: the places of `at` where a piece of that length stands, ending by `limit`, and its row."""
        h, size = np.zeros(len(at), np.uint64), 0
        while True:
            alive = at + size < limit
            at, limit, h = at[alive], limit[alive], h[alive]
            if not len(at) or not len(self.hashes):
                return
            h = h * _FACTOR + chars[at + size].astype(np.uint64) + np.uint64(1)
            size += 1
            place = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            known = self.hashes[place] == h
            at, limit, h, rows = at[known], limit[known], h[known], self.rows[place[known]]
            yield at[rows >= 0], size, rows[rows >= 0]


@dataclass
class Lattice:
    """Pieces that begin a word, pieces inside one, bytes and the stop, with natural-log weights for each kind of text.

    `first` and `inner` give a piece's row of `weights`, whose last 257 rows are
    the bytes and the stop; its columns are the kinds.
    """

    first: dict[str, int]
    inner: dict[str, int]
    weights: np.ndarray

    @classmethod
    def of_vocabulary(cls, kinds: int = 1, path: str | None = None) -> Lattice:
        """The vocabulary's pieces, weighted by one over their rank in its file."""
        sp = _processor(path)
        first, inner, rank = {}, {}, []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or "▁" in piece[1:]:
                continue
            (first if piece[0] == "▁" else inner)[piece.removeprefix("▁")] = len(rank)
            rank.append(max(0.0, -sp.get_score(i)))
        rows = np.concatenate([1.0 / (np.array(rank) + 10.0), np.full(256, 1e-6), [0.5]])
        return cls(first, inner, np.tile(rows[:, None], kinds)).normalised()

    @property
    def bytes_at(self) -> int:
        return len(self.weights) - 257

    def normalised(self, counts: np.ndarray | None = None) -> Lattice:
        """The lattice of given positive weights (its own, not yet logs, if none), scaled to the two distributions."""
        rows = self.weights if counts is None else counts
        begins = np.zeros(len(rows), bool)
        begins[list(self.first.values())] = True
        total = np.where(begins[:, None], rows[begins].sum(0), rows[~begins].sum(0))
        return Lattice(self.first, self.inner, np.log(rows / total))

    def __post_init__(self) -> None:
        self._inner, self._first = _Beginnings.of(self.inner), _Beginnings.of(self.first)

    def arcs(self, words: Sequence[str]) -> tuple[np.ndarray, ...]:
        """The arcs of all words' lattices: from, to (places, each word's own one after the other), row of the weights
        (below 0: minus one minus the place of its character in a list), and word; that list of characters that are
        spelled in bytes; and the words' first places.

        From is -1 for an arc that begins a word. Long words are covered in
        stretches of STRETCH characters; a later one begins at no cost, and no
        piece crosses into it.
        """
        n = np.fromiter(map(len, words), np.int64, len(words))
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        end = np.cumsum(n)
        owner = np.repeat(np.arange(len(words)), n)
        at = np.arange(len(chars))
        within = at - (end - n)[owner]
        limit = np.minimum(end[owner], at - within + (within // STRETCH + 1) * STRETCH)
        start, stop, row = [], [], []
        missing = np.ones(len(chars), bool)
        for i, size, found in self._inner.matches(chars, at, limit):
            start.append(i)
            stop.append(i + size)
            row.append(found)
            if size == 1:
                missing[i] = False
        i = np.flatnonzero(missing)
        spelled, which = np.unique(chars[i], return_inverse=True)
        start.append(i)
        stop.append(i + 1)
        row.append(-1 - which.astype(np.int64))
        # Places: a word of n characters has n + 1 of them.
        of = [owner[i] for i in start]
        start, stop = [i + k for i, k in zip(start, of)], [i + k for i, k in zip(stop, of)]
        base = np.concatenate([[0], np.cumsum(n + 1)])
        if (whole := self.first.get("")) is not None:
            start.append(np.full(len(words), -1))
            stop.append(base[:-1])
            row.append(np.full(len(words), whole))
            of.append(np.arange(len(words)))
        begin, some = end - n, np.flatnonzero(n)
        place = np.full(len(chars) + 1, -1)
        place[begin[some]] = some
        for i, size, found in self._first.matches(chars, begin[some], np.minimum(end, begin + STRETCH)[some]):
            k = place[i]
            start.append(np.full(len(i), -1))
            stop.append(base[k] + size)
            row.append(found)
            of.append(k)
        return (*(np.concatenate(x).astype(np.int64) for x in (start, stop, row, of)), [chr(c) for c in spelled], base)

    def _costs(self, row: np.ndarray, spelled: list[str]) -> np.ndarray:
        own = self.weights
        if spelled:
            bytes_ = own[self.bytes_at : -1]
            extra = np.array([bytes_[list(c.encode("utf-8", "surrogatepass"))].sum(0) for c in spelled])
            own = np.concatenate([own, extra])
            row = np.where(row < 0, len(self.weights) - 1 - row, row)
        return own[row]

    def forward(self, arcs: tuple[np.ndarray, ...]) -> np.ndarray:
        """For each place and kind the log of the sum over all ways there."""
        start, end, row, owner, spelled, base = arcs
        return _sums(start, end, self._costs(row, spelled), end - base[owner], np.full((base[-1] + 1, self.weights.shape[1]), -np.inf))

    def log_probabilities(self, words: Sequence[str]) -> np.ndarray:
        """For each word and kind the natural log of the sum over all segmentations, the stop included."""
        out = np.zeros((len(words), self.weights.shape[1]))
        for a, b in _batches(words):
            arcs = self.arcs(words[a:b])
            out[a:b] = self.forward(arcs)[arcs[-1][1:] - 1] + self.weights[-1]
        return out

    def expected(self, words: Sequence[str], times: np.ndarray) -> np.ndarray:
        """The expected uses of each row of the weights by kind, over `words` that count `times` (words x kinds)."""
        total = np.zeros_like(self.weights)
        total[-1] = times.sum(0)
        for a, b in _batches(words):
            arcs = self.arcs(words[a:b])
            start, end, row, owner, spelled, base = arcs
            cost = self._costs(row, spelled)
            alpha = self.forward(arcs)
            beta = np.full_like(alpha, -np.inf)
            beta[base[1:] - 1] = 0.0
            inside = start >= 0
            # The same sums from the ends: places count down, and what is known is kept.
            _sums(end[inside], start[inside], cost[inside], -(start[inside] - base[owner[inside]]), beta, seeded=True)
            back = np.where(inside[:, None], alpha[start], 0.0)
            whole = alpha[base[1:] - 1][owner]
            with np.errstate(invalid="ignore"):
                share = np.nan_to_num(np.exp(back + cost + beta[end] - whole)) * times[a:b][owner]
            plain = row >= 0
            for k in range(total.shape[1]):
                total[:, k] += np.bincount(row[plain], share[plain, k], len(total))
            for r, s in zip(row[~plain].tolist(), share[~plain]):
                for byte in spelled[-1 - r].encode("utf-8", "surrogatepass"):
                    total[self.bytes_at + byte] += s
        return total


def _batches(words: Sequence[str]) -> Iterator[tuple[int, int]]:
    """Runs of words of about _BATCH characters."""
    begin = size = 0
    for i, w in enumerate(words):
        size += len(w) + 1
        if size >= _BATCH:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(words):
        yield begin, len(words)


def _sums(source: np.ndarray, target: np.ndarray, cost: np.ndarray, level: np.ndarray, out: np.ndarray, seeded: bool = False) -> np.ndarray:
    """Fills `out` at the targets with the log of the sum of exp(out[source] + cost), level after level; source -1 is the start."""
    if not len(level):
        return out
    order = np.argsort((level - level.min()) * len(out) + target, kind="stable")
    source, target, cost, level = source[order], target[order], cost[order], level[order]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(level)) + 1, [len(level)]])
    first = np.concatenate([[True], np.diff(target) != 0]) | np.concatenate([[True], np.diff(level) != 0])
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        came = cost[a:b] + np.where(source[a:b, None] >= 0, out[source[a:b]], 0.0)
        begin = np.flatnonzero(first[a:b])
        at = target[a:b][begin]
        found = np.logaddexp.reduceat(came, begin, axis=0)
        out[at] = np.logaddexp(out[at], found) if seeded else found
    return out


@dataclass
class Model:
    """What scores a word: corpus totals, the lattice, and for each kind its words, its singletons and its share of texts."""

    lattice: Lattice
    train_tokens: int  # words and ends
    distinct: int  # words, and the end if there is one
    ends: int
    words: np.ndarray  # training words by kind
    single: np.ndarray  # of which distinct ones that stand there once
    shared: float  # share of those that other kinds know
    texts: np.ndarray  # training rows by kind

    @property
    def base_norm(self) -> float:
        return self.train_tokens + SMOOTH * (self.distinct + 1)

    def base(self, c: int) -> float:
        return math.log10((c + SMOOTH) / self.base_norm)

    @property
    def end(self) -> float:
        """The share of ends among tokens, within (0, 1)."""
        return (self.ends + SMOOTH) / (self.train_tokens + 2 * SMOOTH)

    @property
    def new(self) -> np.ndarray:
        """By kind, the share of its tokens that are not drawn from its own counts."""
        return np.clip((self.single + 1) / (self.words + 1), 1e-3, 1.0)

    @property
    def kind_shares(self) -> np.ndarray:
        """log10 of the kinds' shares of texts."""
        return np.log10((self.texts + 1) / (self.texts.sum() + len(self.texts)))

    def word_scores(self, words: Sequence[bytes], counts: np.ndarray) -> np.ndarray:
        """log10 of each word's probability by kind, from its `counts` (words x kinds)."""
        spelled = self.lattice.log_probabilities([w.decode("utf-8", "surrogatepass") for w in words])
        all_words = max(1, int(self.words.sum()))
        known = (1 - self.new) * counts / np.maximum(1, self.words) + (self.new * self.shared * counts.sum(1, keepdims=True) / all_words)
        with np.errstate(divide="ignore"):
            both = np.logaddexp(np.log(known), spelled + np.log(self.new * (1 - self.shared)))
        return (both + math.log1p(-self.end)) / math.log(10)


def fit(docs: DataFrame, path: str | None = None, rounds: int = ROUNDS) -> tuple[Model, DataFrame]:
    """The model of the rows of `docs` (text, train, and kind if there is one) with `train`, and the table
    word, c (its training count), base, scores (array, by kind) of all words."""
    names, others = kinds_of(docs)
    n = len(names) + others
    place = F.lit(n - 1)
    for k, name in enumerate(names):
        place = F.when(F.col("kind") == name, k).otherwise(place)
    rows = docs.select("text", F.coalesce("train", F.lit(False)).alias("train"), (place if names else F.lit(0)).cast("int").alias("at"))
    counts = cut(word_counts(rows, n))
    c, whole = F.col("c"), F.aggregate("c", F.lit(0).cast("long"), lambda s, x: s + x)
    once = F.transform(c, lambda x: (x == 1).cast("long"))
    row = counts.agg(
        F.count(F.when(whole > 0, 1)).alias("distinct"),
        F.sum(F.aggregate(once, F.lit(0).cast("long"), lambda s, x: s + x)).alias("lone"),
        F.sum(F.when(whole > 1, F.aggregate(once, F.lit(0).cast("long"), lambda s, x: s + x)).otherwise(0)).alias("met"),
        *[F.coalesce(F.sum(c[k]), F.lit(0)).alias(f"w{k}") for k in range(n)], *[F.coalesce(F.sum(once[k]), F.lit(0)).alias(f"s{k}") for k in range(n)],
    ).first()
    texts = dict(rows.where("train").groupBy("at").count().collect())  # a row for each kind
    ends = sum(texts.values())
    words = np.array([row[f"w{k}"] for k in range(n)])
    model = Model(
        Lattice.of_vocabulary(n, path), int(words.sum()) + ends, row["distinct"] + (ends > 0), ends, words,
        np.array([row[f"s{k}"] for k in range(n)]), ((row["met"] or 0) + SMOOTH) / ((row["lone"] or 0) + 2 * SMOOTH), np.array([texts.get(k, 0) for k in range(n)]),
    )
    for _ in range(rounds):
        model.lattice = model.lattice.normalised(piece_counts(counts, model.lattice) + SMOOTH)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, own = batch.column(0).to_pylist(), _matrix(batch.column(1), n)
            found, total = model.word_scores(words, own), own.sum(1)
            base = np.log10((total + SMOOTH) / model.base_norm)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total), pa.array(base), pa.array(list(found), pa.list_(pa.float64()))], ["word", "c", "base", "scores"])

    return model, cut(counts.mapInArrow(each, "word binary, c long, base double, scores array<double>"))


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, n)


def piece_counts(counts: DataFrame, lattice: Lattice) -> np.ndarray:
    """The expected uses of all rows of the lattice's weights, over all words that a kind's training rows hold."""
    n = lattice.weights.shape[1]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros_like(lattice.weights)
        for batch in batches:
            own = (_matrix(batch.column(1), n) > 0).astype(float)
            some = np.flatnonzero(own.any(1))
            words = batch.column(0).take(pa.array(some)).to_pylist()
            total += lattice.expected([w.decode("utf-8", "surrogatepass") for w in words], own[some])
        hit = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(hit), *(pa.array(total[hit, k]) for k in range(n))], ["row", *(f"n{k}" for k in range(n))])

    schema = "row long, " + ", ".join(f"n{k} double" for k in range(n))
    # A row for each piece of the vocabulary at most. Sums of doubles depend on their order in the last digits: round them.
    found = counts.mapInArrow(each, schema).groupBy("row").agg(*[F.round(F.sum(f"n{k}"), 6).alias(f"n{k}") for k in range(n)]).toPandas()
    out = np.zeros_like(lattice.weights)
    out[found["row"].to_numpy(np.int64)] = found[[f"n{k}" for k in range(n)]].to_numpy(float)
    return out


def frequent_words(table: DataFrame, most: int = FREQUENT) -> tuple[list[bytes], np.ndarray]:
    """The words of count t or more, for the least t that leaves at most `most` of them, with (base, scores...) for each.

    t comes from a histogram of counts in steps of an eighth of a power of two,
    some 500 rows at most; words over LONGEST bytes stay in the table.
    """
    short = table.where((F.length("word") <= LONGEST) & (F.col("c") > 0))
    step = F.floor(F.log2("c") * 8).cast("int")
    held, least = 0, None
    for r in sorted(short.groupBy(step.alias("step")).count().collect(), reverse=True):
        held += r["count"]
        if held > most:
            break
        least = r["step"]
    if least is None:
        return [], np.zeros((0, 0))
    found = short.where(step >= least).select("word", "base", "scores").toPandas()
    return [bytes(w) for w in found["word"]], np.column_stack([found["base"], np.stack(found["scores"].to_numpy())])


def scores(docs: DataFrame, model: Model, table: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score (log10) for each row of `docs`.

    Null and empty texts are one end. Repeated rows are scored each by itself.
    `table` holds every word of `docs`. A text's words among the `frequent`
    ones are settled in its task; the others by a join with `table`. Further
    columns are not read; an empty table gives an empty one.
    """
    top, values = frequent_words(table, frequent)
    kinds = len(model.texts)
    index = {w: i for i, w in enumerate(top)}
    values = np.concatenate([values.reshape(len(top), kinds + 1), np.zeros((1, kinds + 1))])
    end_base, end_score = model.base(model.ends), math.log10(model.end)
    end_known = int(model.ends > 0)
    lookup = docs.sparkSession.sparkContext.broadcast((index, values))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, values = lookup.value
        for batch in batches:
            keys, words, times, ids, sizes, known, base, score = ([] for _ in range(8))

            def put(key, word, n, doc_id=None, size=None, k=None, b=None, s=None):
                for column, value in zip((keys, words, times, ids, sizes, known, base, score), (key, word, n, doc_id, size, k, b, s)):
                    column.append(value)

            for key, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                tokens = tokens_of(text.as_py())
                at = np.fromiter((index.get(t, -1) for t in tokens), np.int64, len(tokens))
                rest = np.flatnonzero(at < 0).tolist()
                b, *s = values[at].sum(0).tolist()
                put(key, b" %d" % key, 0, doc_id, len(tokens) + 1, len(tokens) - len(rest) + end_known, b + end_base, [x + end_score for x in s])
                for word, n in Counter([tokens[i] for i in rest]).items():
                    put(key, word, n)
            columns = [pa.array(keys, pa.int64()), pa.array(words, pa.binary()), pa.array(times, pa.int64()), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "word", "n", "doc_id", "size", "known", "b", "s"])

    rows = docs.select(
        F.monotonically_increasing_id().alias("key"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
    ).mapInArrow(each, "key long, word binary, n long, doc_id long, size long, known long, b double, s array<double>")
    # A text's own row goes under a key of its own that is no word, and so meets nothing.
    met = rows.join(table.select("word", "c", "base", "scores"), "word", "left")
    part = lambda own, found: F.sum(F.coalesce(own, F.lit(0)) + F.coalesce(F.col("n") * found, F.lit(0)))
    summed = met.groupBy("key").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("size").alias("n_tokens"),
        part(F.col("known"), (F.col("c") > 0).cast("long")).alias("n_known"),
        part(F.col("b"), F.col("base")).alias("base_score"),
        *[part(F.col("s")[k], F.col("scores")[k]).alias(f"s{k}") for k in range(kinds)],
    )
    by = [F.col(f"s{k}") + F.lit(float(x)) for k, x in enumerate(model.kind_shares)]
    most = F.greatest(*by) if kinds > 1 else by[0]
    score = most + F.log10(reduce(lambda a, b: a + b, [F.pow(F.lit(10.0), x - most) for x in by]))
    return summed.select("doc_id", "n_tokens", "n_known", "base_score", score.alias("score"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", F.col("lang").alias("kind"))
    model, table = fit(docs.withColumn("train", remainder(F.col("doc_id"), 10) != 0))
    return scores(docs, model, table).select(
        "doc_id",
        (remainder(F.col("doc_id"), 10) == 0).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
