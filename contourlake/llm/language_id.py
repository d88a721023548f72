"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for each piece of a fixed public vocabulary. A
word's probability is the sum over all its segmentations into pieces, which a
forward pass computes; a text's is the product over its words. The piece
probabilities are fitted by expectation-maximisation, whose expected counts
come from the same forward pass and its mirror.

Fitting takes a bounded sample of the labelled rows: per language
at most ``sample_docs`` documents of at most ``sample_bytes`` bytes, picked by a
hash of the id; all their words count, long ones, too. The model is a matrix of vocabulary size times
languages, a bound known before the data, and is broadcast. Predictions read
the text alone, of every row, whole. Words are scored once per batch, all
languages together, grouped by length; words of ``LONG`` characters and more
(texts without spaces are one word) go through the same passes in logarithms,
in time linear in their length.

A text that is null or has no letter, or any text if nothing was learned, is
``und`` with score 0. A null id is not held out and is not learned from.
Ties go to the language that sorts first. Extra columns are left behind.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_fold

#: Characters up to which words are scored in groups of equal length.
LONG = 24
#: Probability of a character that the vocabulary lacks.
UNKNOWN = 1e-9
#: Words whose scores a task remembers.
KNOWN = 200_000
BASE = 0x9E3779B97F4A7C15
SPACE = "▁"


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1) modulo 2 ** 64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Pieces:
    """The vocabulary's pieces, findable by text and, in arrays, by hash."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        found = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
        self.texts = sorted({p.lower() for p in found if len(p) <= LONG})
        self.index = {p: i for i, p in enumerate(self.texts)}
        self.longest = max(map(len, self.texts))
        self.up, self.down = (powers(x, LONG + 2) for x in (BASE, pow(BASE, -1, 1 << 64)))
        up = self.up.tolist()
        hashes = np.array([sum(ord(c) * u for c, u in zip(p, up, strict=False)) & (1 << 64) - 1 for p in self.texts], np.uint64)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.filter = np.zeros(1 << 20, bool)
        self.filter[self._slot(hashes)] = True

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(44)).astype(np.int64)

    def ids(self, h: np.ndarray) -> np.ndarray:
        """Piece of each hash, -1 for none."""
        out = np.full(len(h), -1, np.int64)
        maybe = np.flatnonzero(self.filter[self._slot(h)])
        at = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
        hit = self.hashes[at] == h[maybe]
        out[maybe[hit]] = self.order[at[hit]]
        return out

    def lattice(self, words: list[str], n: int) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """start, end, rows and pieces of all words, of at most n characters; a lone unknown character has the piece -1."""
        if len(self.up) < n + 2:
            self.up, self.down = (powers(x, 2 * n) for x in (BASE, pow(BASE, -1, 1 << 64)))
        codes = np.frombuffer("".join(w.ljust(n, "\x00") for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n).astype(np.uint64)
        s = np.zeros((len(words), n + 1), np.uint64)
        np.cumsum(codes * self.up[:n], axis=1, out=s[:, 1:])
        edges = []
        for j in range(1, n + 1):
            for i in range(max(0, j - self.longest), j):
                found = self.ids((s[:, j] - s[:, i]) * self.down[i])
                rows = np.arange(len(words)) if j == i + 1 else np.flatnonzero(found >= 0)
                if len(rows):
                    edges.append((i, j, rows, found[rows]))
        return edges


@dataclass
class Model:
    """languages, sorted; prob: a row per piece and a last one for unknown characters, a column per language; prior: log share."""

    languages: list[str]
    prob: np.ndarray
    prior: np.ndarray


def _forward(edges, n: int, w: int, prob: np.ndarray) -> np.ndarray:
    a = np.zeros((n + 1, w, prob.shape[1]))
    a[0] = 1
    for i, j, rows, pieces in edges:
        a[j, rows] += a[i, rows] * prob[pieces]
    return a


def _log_forward(edges, n: int, w: int, prob: np.ndarray) -> np.ndarray:
    """Logarithms of the forward pass: each place relative to the one before, so nothing underflows."""
    a = np.zeros((n + 1, w, prob.shape[1]))
    at, x = 0, np.ones((w, prob.shape[1]))
    for i, j, rows, pieces in edges:
        if j != at:
            if at:
                a[at] = a[at - 1] + np.log(x)
            at, x = j, np.zeros((w, prob.shape[1]))
        x[rows] += np.exp(a[i, rows] - a[j - 1, rows]) * prob[pieces]
    a[n] = a[n - 1] + np.log(x)
    return a


def grouped(words: list[str], languages: int, most: int = 1 << 14) -> Iterator[tuple[int, np.ndarray]]:
    """(length, places) of groups of words with their mark: of equal length if short, else of at most double length; a group's arrays are of bounded size."""
    by_length = defaultdict(list)
    for k, w in enumerate(words):
        n = len(w) + 1
        by_length[n if n <= LONG else 1 << (n - 1).bit_length()].append(k)
    for n, at in sorted(by_length.items()):
        step = most if n <= LONG else max(1, (1 << 22) // (n * languages))
        for lo in range(0, len(at), step):
            part = np.array(at[lo : lo + step])
            yield max(len(words[k]) + 1 for k in part), part


def word_scores(pieces: Pieces, words: list[str], prob: np.ndarray) -> np.ndarray:
    """Log probability of each word in each language."""
    out = np.empty((len(words), prob.shape[1]))
    for n, at in grouped(words, prob.shape[1]):
        marked = [SPACE + words[k] for k in at]
        edges = pieces.lattice(marked, n)
        if n <= LONG:
            out[at] = np.log(_forward(edges, n, len(at), prob)[n])
        else:
            out[at] = _log_forward(edges, n, len(at), prob)[[len(w) for w in marked], np.arange(len(at))]
    return out


def expected(edges, n: int, sizes: np.ndarray, count: np.ndarray, prob: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pieces, and how often words of these sizes are expected to use them, count times each."""
    w = len(count)
    if n <= LONG:
        a = _forward(edges, n, w, prob)
        b = np.zeros_like(a)
        b[n] = count / a[n]
        for i, j, rows, found in reversed(edges):
            b[i, rows] += b[j, rows] * prob[found]
        for i, j, rows, found in edges:
            yield found, a[i, rows] * prob[found] * b[j, rows]
        return
    a = _log_forward(edges, n, w, prob)
    at = np.zeros_like(a)  # how often a piece is expected to end at a place
    at[sizes, np.arange(w)] = count
    for i, j, rows, found in reversed(edges):
        used = np.exp(a[i, rows] - a[j, rows]) * prob[found] * at[j, rows]
        at[i, rows] += used
        yield found, used


def fit(pieces: Pieces, counts: dict[tuple[str, str], int], docs: dict[str, int], rounds: int = 4) -> Model:
    """EM over word counts by (language, word); docs: documents by language, for the prior."""
    languages = sorted(docs)
    where = {x: k for k, x in enumerate(languages)}
    words = sorted({w for _, w in counts})
    row = {w: k for k, w in enumerate(words)}
    c = np.zeros((len(words), len(languages)))
    for (lang, w), n in counts.items():
        c[row[w], where[lang]] = n
    v = len(pieces.texts)
    prob = np.full((v + 1, len(languages)), 1.0 / v)
    prob[v] = UNKNOWN
    groups = [(n, at, pieces.lattice([SPACE + words[k] for k in at], n)) for n, at in grouped(words, len(languages), len(words) or 1)]
    for _ in range(rounds):
        new = np.zeros_like(prob)
        for n, at, edges in groups:
            for found, used in expected(edges, n, np.array([len(words[k]) + 1 for k in at]), c[at], prob):
                np.add.at(new, found, used)
        new += 0.05
        prob = new / new[:v].sum(axis=0)
        prob[v] = UNKNOWN
    total = sum(docs.values())
    return Model(languages, prob, np.log([docs[x] / total for x in languages]))


def train(docs: DataFrame, path: str, id_col: str, text_col: str, lang_col: str, sample_docs: int = 400, sample_bytes: int = 20_000) -> Model | None:
    """Model of the rows whose fold is not 0 and whose language is known; None if there are none."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where((crc_fold("id") != 0) & F.col("lang").isNotNull())
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.octet_length("text") <= sample_bytes).alias("short")).collect()  # a row per language
    if not sizes:
        return None
    shares = {r["lang"]: r["n"] for r in sizes}
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
    # Hashes thin the short rows out to about twice the sample before any language's rows meet for ranking.
    share = F.create_map(*(F.lit(x) for r in sizes for x in (r["lang"], min(1.0, 2.0 * sample_docs / max(1, r["short"])))))
    thin = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) <= F.element_at(share, F.col("lang")) * F.lit(float(1 << 30))
    small = rows.where((F.octet_length("text") <= sample_bytes) & thin).select("lang", "id")
    ids = small.withColumn("k", rank).where(F.col("k") <= sample_docs).select("id").distinct()
    sample = rows.where(F.octet_length("text") <= sample_bytes).join(F.broadcast(ids), "id", "left_semi")  # sample_docs a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = Counter((x, w) for x, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for w in t.lower().split())
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in n], pa.string()), pa.array([k[1] for k in n], pa.string()), pa.array(list(n.values()), pa.int64())], ["lang", "word", "n"])

    words = sample.select("lang", "text").mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = {(r["lang"], r["word"]): r["n"] for r in words.toLocalIterator()}
    return fit(Pieces(path), counts, shares)


class Scorer:
    """Languages of texts; remembers words."""

    def __init__(self, model: Model, path: str):
        self.model, self.pieces, self.known, self.scores = model, Pieces(path), {}, np.empty((0, len(model.languages)))

    def __call__(self, texts: list[str]) -> list[tuple[str, float]]:
        split = [t.lower().split() for t in texts]
        new = list(dict.fromkeys(chain.from_iterable(split)).keys() - self.known.keys())
        if len(self.known) + len(new) > KNOWN:
            self.known, self.scores = {}, self.scores[:0]
            new = list(dict.fromkeys(chain.from_iterable(split)))
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.scores = np.concatenate([self.scores, word_scores(self.pieces, new, self.model.prob)])
        out = []
        for t, words in zip(texts, split, strict=True):
            if not any(map(str.isalpha, t)):
                out.append(("und", 0.0))
                continue
            log = self.model.prior + self.scores[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))].sum(axis=0)
            p = np.exp(log - log.max())
            best = int(p.argmax())
            out.append((self.model.languages[best], float(p[best] / p.sum())))
        return out


def predict(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id_col, held_out, lang_pred and score of each row."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(train(docs, path, id_col, text_col, lang_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value, path) if sent.value else None
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                got = scorer([x or "" for x in part.column(1).to_pylist()]) if scorer else [("und", 0.0)] * part.num_rows
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], ["id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, lang_pred string, score double")
    return rows.select(F.col("id").alias(id_col), F.coalesce(crc_fold("id") == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
