"""Language identification: script ranges, per-word scores and Viterbi spans.

The script of a word narrows the languages that may own it.  Each remaining
language scores the word by its character n-grams.  Viterbi over the words
with a penalty for switching labels spans, so mixed texts get several; the
language with most letters is the document's.

Where no stretch of words favours another language by more than half the
penalty, one label for all words is the optimum, which is found from running
sums; only other texts need the step-by-step search.

Whether a text is in any learned language at all is judged by its evidence:
the mean log likelihood of its n-grams, drawn towards that of learned texts
where it is short.  Texts far below the least of the learned ones are rejected
by the filter; the label itself does not depend on it.

Defined cases: a text that is null or has no letter is `und` with score 0, and
so is any text if nothing could be learned; null or unknown languages are not
learned; ties go to the language that sorts first; a null identifier counts
as the text "null" where rows are dealt into learned and held-out; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptloom.llm.common import discard, distinct_name, mapped, table, written
from scriptloom.session import ship

UNKNOWN = "und"

# Scripts and their main code point ranges.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)],
}
NAMES = list(SCRIPTS)
RANGES = sorted((lo, hi, k) for k, name in enumerate(NAMES) for lo, hi in SCRIPTS[name])
BUCKETS = 1 << 16
CLIP = 12.0

#: ASCII letters in lower case and all bytes of other characters; the rest are spaces.
LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def script_of(word: str) -> int:
    """Index of the script of the first letter that has one, else -1; -2 where there is no letter."""
    letter = False
    for c in word:
        if c.isalpha():
            letter = True
            for lo, hi, k in RANGES:
                if lo <= ord(c) <= hi:
                    return k
    return -1 if letter else -2


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the hashed n-grams of 2 to 4 bytes of each word between marks, and of the whole word: buckets word by word, and how many each word has."""
    lengths = np.array([len(w) + 2 for w in words])
    raw = np.frombuffer(b"<" + b"><".join(words) + b">", np.uint8).astype(np.uint64) + np.uint64(1)
    owner = np.repeat(np.arange(len(words)), lengths)
    ends = np.cumsum(lengths)
    room = np.repeat(ends, lengths) - np.arange(len(raw))  # bytes from here to the word's end
    hashed, owners = [], []
    h = raw.copy()
    for k in (2, 3, 4):
        h = h[:-1] * np.uint64(0x100000001B3) + raw[k - 1 :]
        here = room[: len(h)] >= k
        hashed.append(h[here] * np.uint64(8) + np.uint64(k))
        owners.append(owner[: len(h)][here])
    place = np.arange(len(raw)) - np.repeat(ends - lengths, lengths)
    power = np.cumprod(np.full(int(lengths.max()), 0x9E3779B97F4A7C15, np.uint64))
    hashed.append(np.add.reduceat(raw * power[place], ends - lengths) * np.uint64(8))
    owners.append(np.arange(len(words)))
    ids, whose = np.concatenate(hashed), np.concatenate(owners)
    ids = (ids ^ (ids >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    order = np.argsort(whose, kind="stable")
    return ((ids >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int64)[order], np.bincount(whose, minlength=len(words))


def gram_counts(words: list[bytes], times: np.ndarray, step: int = 20_000) -> np.ndarray:
    """How often each bucket's n-grams occur in words that occur so many times; step words at once, as their n-grams take some 2 KB a word meanwhile."""
    out = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(words), step):
        ids, sizes = grams(words[at : at + step])
        out += np.bincount(ids, np.repeat(times[at : at + step], sizes), BUCKETS).astype(np.int64)
    return out


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % 4 == 2


class Model:
    """Log likelihoods of hashed n-grams by language, and which languages use which script."""

    def __init__(self, languages: list[str], gram_counts: np.ndarray, script_counts: np.ndarray):
        self.languages = languages
        total = gram_counts.sum(0, keepdims=True)
        self.log = np.log((gram_counts + 0.2) / (total + 0.2 * BUCKETS)).astype(np.float32)
        share = script_counts / np.maximum(1, script_counts.sum(0, keepdims=True))
        self.uses = share >= 0.001
        self.words: dict[bytes, int] = {}
        self.scores = np.zeros((0, len(languages)), np.float32)  # grows to its limit on the worker
        self.letters = np.zeros(0, np.int64)
        self.sums, self.counts = np.zeros(0), np.zeros(0, np.int64)  # log likelihood in the best language, and n-grams
        self.usual, self.floor = 0.0, -np.inf  # evidence of learned texts: the mean, and below what a text is rejected

    def learn_words(self, words: set[bytes], limit: int = 250_000) -> None:
        """Scores of words not met before, together."""
        if len(self.words) + len(words) > limit:
            self.words.clear()
        start = len(self.words)
        if start + len(words) > len(self.scores):
            more = max(2 * len(self.scores), start + len(words)) - len(self.scores)
            self.scores = np.vstack([self.scores, np.zeros((more, len(self.languages)), np.float32)])
            self.letters = np.append(self.letters, np.zeros(more, np.int64))
            self.sums, self.counts = np.append(self.sums, np.zeros(more)), np.append(self.counts, np.zeros(more, np.int64))
        new, masks, letters = list(words), [], []
        for k, w in enumerate(new):
            self.words[w] = start + k
            s = 0 if w.isascii() else script_of(w.decode("utf-8", "replace"))
            masks.append(s)
            letters.append(0 if s == -2 else len(w))
        ids, sizes = grams(new)
        got = np.add.reduceat(self.log[ids], np.cumsum(sizes) - sizes, axis=0)
        wordless = np.array(masks) == -2
        self.sums[start : start + len(new)] = np.where(wordless, 0, got.max(1))
        self.counts[start : start + len(new)] = np.where(wordless, 0, sizes)
        got /= np.sqrt(sizes)[:, None]
        got -= got.max(1, keepdims=True)
        for k, s in enumerate(masks):
            if s == -2:
                got[k] = 0
            elif s >= 0 and self.uses[s].any():
                got[k, ~self.uses[s]] = -CLIP
        self.scores[start : start + len(new)] = np.maximum(got, -CLIP)
        self.letters[start : start + len(new)] = letters

    def rows(self, words: list[bytes]) -> np.ndarray:
        got = list(map(self.words.get, words))
        if None in got:
            self.learn_words({w for w, i in zip(words, got, strict=True) if i is None})
            got = list(map(self.words.get, words))
            if None in got:  # the store was emptied meanwhile
                self.learn_words({w for w, i in zip(words, got, strict=True) if i is None}, 1 << 40)
                got = [self.words[w] for w in words]
        return np.array(got)

    def label(self, rows: np.ndarray, penalty: float) -> np.ndarray:
        """The best language index for each word, given the words' rows."""
        scores = self.scores[rows]
        total = scores.sum(0)
        best = int(total.argmax())
        gain = np.cumsum(scores - scores[:, best : best + 1], axis=0)
        low = np.minimum.accumulate(np.vstack([np.zeros((1, gain.shape[1]), gain.dtype), gain]), axis=0)[:-1]
        if (gain - low).max() <= penalty / 2:
            return np.full(len(rows), best)
        return viterbi(scores, penalty)

    def likelihood(self, text: bytes | None) -> tuple[float, int]:
        """Sum of log likelihoods of a text's n-grams, each word's in its best language, and how many there are."""
        words = (text or b"").translate(LETTERS).split()
        if not words or not self.languages:
            return 0.0, 0
        rows = self.rows(words)
        return float(self.sums[rows].sum()), int(self.counts[rows].sum())

    def evidence(self, total: float, n: int, drawn: int = 50) -> float:
        """Mean log likelihood of an n-gram, as if `drawn` usual ones stood beside."""
        return (total + drawn * self.usual) / (n + drawn)

    def accepts(self, text: bytes | None) -> bool:
        """Whether a text is in a learned language: some word has a letter (only these have n-grams that count), and the evidence is not below the floor."""
        total, n = self.likelihood(text)
        return n > 0 and self.evidence(total, n) >= self.floor

    def predict(self, text: bytes | None, penalty: float) -> tuple[str, float]:
        words = (text or b"").translate(LETTERS).split()
        if not words or not self.languages:
            return UNKNOWN, 0.0
        rows = self.rows(words)
        labels = self.label(rows, penalty)
        letters = np.bincount(labels, self.letters[rows], len(self.languages))
        if not letters.sum():
            return UNKNOWN, 0.0
        best = int(letters.argmax())
        return self.languages[best], float(letters[best] / letters.sum())

    def spans(self, text: bytes | None, penalty: float) -> list[tuple[int, int, str]]:
        """(first word, words, language) of each stretch of one label."""
        words = (text or b"").translate(LETTERS).split()
        if not words or not self.languages:
            return []
        labels = self.label(self.rows(words), penalty)
        cuts = [0, *(np.flatnonzero(np.diff(labels)) + 1).tolist(), len(words)]
        return [(a, b - a, self.languages[labels[a]]) for a, b in zip(cuts, cuts[1:], strict=False)]


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """The labels with the highest sum of scores less penalty for each switch."""
    n, k = scores.shape
    value, came = scores[0].tolist(), []
    for row in scores[1:].tolist():
        top = max(value)
        at, floor = value.index(top), top - penalty
        came.append([j if v >= floor else at for j, v in enumerate(value)])
        value = [max(v, floor) + s for v, s in zip(value, row, strict=True)]
    out = [value.index(max(value))]
    for back in reversed(came):
        out.append(back[out[-1]])
    return np.array(out[::-1])


def sampled(docs: DataFrame, train_docs: int) -> DataFrame:
    """Of the rows of docs that have a text and a language about train_docs, each language with an even share, or all of its rows if they are fewer: a share of the rows by a hash of identifier and language.

    The driver sees a row for each language.
    """
    rows = known(docs)
    counts = rows.groupBy("lang").count().collect()
    million = 1_000_000
    shares = {r["lang"]: min(million, max(1, million * (train_docs // len(counts)) // r["count"])) for r in counts}
    if all(v == million for v in shares.values()):
        return rows
    share = F.element_at(F.create_map(*[F.lit(x) for pair in shares.items() for x in pair]), F.col("lang"))
    return rows.filter(F.pmod(F.xxhash64("doc_id", "lang"), F.lit(million)) < share)


def known(docs: DataFrame) -> DataFrame:
    """The rows of docs that can be learned from: those with a text and a language."""
    return docs.filter("lang is not null and text is not null")


def train(docs: DataFrame, train_docs: int | None = 20_000) -> Model:
    """A model of the languages in docs (doc_id, text, lang), fitted on about train_docs of the rows that have a language (None: on all).

    The counts are bounded by buckets times languages.
    """
    learned = known(docs) if train_docs is None else sampled(docs, train_docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: dict[str, np.ndarray] = {}
        for b in batches:
            met: dict[str, Counter] = {}
            for lang, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                met.setdefault(lang, Counter()).update(x.as_py().translate(LETTERS).split())
            for lang, counter in met.items():
                if lang not in tally:
                    tally[lang] = np.zeros(BUCKETS + len(NAMES), np.int64)
                if not counter:
                    continue
                words, times = list(counter), np.array(list(counter.values()))
                for w, n in counter.items():
                    s = 0 if w.isascii() else script_of(w.decode("utf-8", "replace"))
                    if s >= 0:
                        tally[lang][BUCKETS + s] += n
                tally[lang][:BUCKETS] += gram_counts(words, times)
        for lang, t in tally.items():
            at = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(t[at], pa.int64())], ["lang", "bucket", "n"])

    counted = learned.select("lang", F.col("text").cast("binary")).transform(mapped, count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(counted.column("lang").to_pylist()))
    grid = np.zeros((BUCKETS + len(NAMES), len(names)), np.float64)
    where = {n: i for i, n in enumerate(names)}
    grid[counted.column("bucket").to_numpy(), [where[x] for x in counted.column("lang").to_pylist()]] = counted.column("n").to_numpy()
    return Model(names, grid[:BUCKETS], grid[BUCKETS:])


def identify(docs: DataFrame, model: Model, penalty: float = 10.0) -> DataFrame:
    """doc_id, lang_pred, score of every document (doc_id, text); the model goes out as a broadcast of bounded size."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            got = [m.predict(x.as_py(), penalty) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).transform(mapped, run, "doc_id long, lang_pred string, score double")


def with_floor(docs: DataFrame, model: Model, margin: float = 2.0) -> Model:
    """The model with the evidence below which a text is rejected: the least of all learned texts (rows of docs with a text and a language), less margin (nats an n-gram).

    Two numbers a text are written; the driver sees sums and a minimum.
    """
    shared = ship(docs.sparkSession).sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [shared.value.likelihood(x.as_py()) for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in got], pa.float64()), pa.array([n for _, n in got], pa.int64())], ["total", "n"])

    measured = written(known(docs).select(F.col("text").cast("binary")).transform(mapped, measure, "total double, n long").filter("n > 0"), "language-evidence")
    total, n = measured.agg(F.sum("total"), F.sum("n")).first()
    if n:
        model.usual = total / n
        model.floor = measured.agg(F.min(model.evidence(F.col("total"), F.col("n")))).first()[0] - margin
    discard(measured)
    return model


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """docs without those that are in no learned language, all columns as they were, in one pass and without a shuffle."""
    shared = ship(docs.sparkSession).sparkContext.broadcast(model)
    found = distinct_name("lang_found", docs.columns)

    @F.arrow_udf("boolean")
    def identified(texts: pa.Array) -> pa.Array:
        m = shared.value
        return pa.array([m.accepts(x.as_py()) for x in texts], pa.bool_())

    return docs.withColumn(found, identified(F.col("text").cast("binary"))).filter(F.col(found)).drop(found)


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
