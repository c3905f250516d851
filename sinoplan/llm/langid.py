"""Language identification: scripts narrow the candidates, Viterbi labels the spans."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sinoplan.llm.common import in_bounded_batches, tidy
from sinoplan.llm.tokens import chunks

#: Rows of each language that the scores are fitted on, those with the smallest hash of the id.
SAMPLE_ROWS = 2000
#: Hashed character n-grams: their lengths, and the size of the table, which bounds the model.
N_GRAMS, BUCKETS = (1, 2, 3, 4), 1 << 16
#: Viterbi: what a change of language between two words costs, in units of log probability.
SWITCH = 6.0
#: How much of a word's evidence counts, since its overlapping n-grams say things twice.
WEIGHT, MOST = 0.35, 8.0
#: A script belongs to a language if it holds this share of the language's letters.
SCRIPT_SHARE = 0.02
#: Characters of text whose words go through Viterbi together, and words a worker remembers.
BATCH_CHARS, KNOWN_WORDS = 8 << 20, 120_000
#: With fewer texts than this still running, Viterbi goes text by text.
FEW = 12

#: Where the blocks of each script begin and end.
SCRIPTS = [
    ("Latin", 0x41, 0x24F), ("Latin", 0x1E00, 0x1EFF), ("Greek", 0x370, 0x3FF), ("Greek", 0x1F00, 0x1FFF),
    ("Cyrillic", 0x400, 0x52F), ("Armenian", 0x530, 0x58F), ("Hebrew", 0x590, 0x5FF), ("Arabic", 0x600, 0x6FF),
    ("Arabic", 0x750, 0x77F), ("Devanagari", 0x900, 0x97F), ("Bengali", 0x980, 0x9FF), ("Gurmukhi", 0xA00, 0xA7F),
    ("Gujarati", 0xA80, 0xAFF), ("Tamil", 0xB80, 0xBFF), ("Telugu", 0xC00, 0xC7F), ("Kannada", 0xC80, 0xCFF),
    ("Malayalam", 0xD00, 0xD7F), ("Sinhala", 0xD80, 0xDFF), ("Thai", 0xE00, 0xE7F), ("Lao", 0xE80, 0xEFF),
    ("Tibetan", 0xF00, 0xFFF), ("Myanmar", 0x1000, 0x109F), ("Georgian", 0x10A0, 0x10FF), ("Hangul", 0x1100, 0x11FF),
    ("Ethiopic", 0x1200, 0x137F), ("Khmer", 0x1780, 0x17FF), ("Kana", 0x3040, 0x30FF), ("Han", 0x3400, 0x4DBF),
    ("Han", 0x4E00, 0x9FFF), ("Hangul", 0xAC00, 0xD7AF), ("Han", 0x20000, 0x2FA1F),
]



def _class_of(*categories: str) -> str:
    """A character class, without brackets, of all code points of the general categories."""
    inside = [unicodedata.category(chr(c)) in categories for c in range(0x110000)]
    edges = [c for c in range(1, 0x110000) if inside[c] != inside[c - 1]]
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b - 1))}" for a, b in zip(edges[::2], edges[1::2], strict=True))


#: A word is a run of letters (categories L*): what ``\w`` has besides are digits, numerals and the underscore.
WORDS = re.compile(rf"[^\W\d_{_class_of('No', 'Nl')}]+")
_NAMES = sorted({s[0] for s in SCRIPTS})
_FROM = np.array([s[1] for s in sorted(SCRIPTS, key=lambda s: s[1])])
_TO = np.array([s[2] for s in sorted(SCRIPTS, key=lambda s: s[1])])
_SCRIPT = np.array([_NAMES.index(s[0]) for s in sorted(SCRIPTS, key=lambda s: s[1])])


def script_of(points: np.ndarray) -> np.ndarray:
    """The script of each code point by its range, -1 for those in none."""
    at = np.searchsorted(_FROM, points, "right") - 1
    return np.where((at >= 0) & (points <= _TO[at]), _SCRIPT[at], -1)


def hashed_ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the words, the word of each, and the script of each word.

    A word is padded with a blank on both sides; n-grams do not reach into the next word.
    """
    joined = " " + " ".join(words) + " "
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    blank = points == 32
    owner = np.cumsum(blank) - 1
    last = len(words) - 1
    buckets, owners = [], []
    value = np.zeros(len(points), np.uint64)
    for n in range(1, max(N_GRAMS) + 1):
        m = len(points) - n + 1
        if m <= 0:
            break
        value = (value[:m] * np.uint64(0x100000001B3)) ^ points[n - 1 :] * np.uint64(0x9E3779B97F4A7C15)
        if n not in N_GRAMS:
            continue
        # The n-gram from i stays within its word and the blanks around it.
        inside = np.ones(m, bool)
        for j in range(1, n - 1):
            inside &= ~blank[j : j + m]
        if n == 1:
            inside &= ~blank[:m]
        of = np.minimum(owner[:m], last)
        mixed = value * np.uint64(0xD6E8FEB86659FD93) + np.uint64(n)
        buckets.append(((mixed >> np.uint64(32)) % np.uint64(BUCKETS)).astype(np.int32)[inside])
        owners.append(of[inside])
    firsts = np.flatnonzero(blank)[:-1] + 1
    return np.concatenate(buckets), np.concatenate(owners), script_of(points[firsts].astype(np.int64))


@dataclass
class LanguageModel:
    """Log probabilities of hashed n-grams by language, and which scripts each language uses.

    Its size is BUCKETS floats a language, whatever it was fitted on.
    """

    languages: list[str]
    log_probability: np.ndarray
    uses_script: np.ndarray
    known: dict = field(default_factory=dict)
    scores: np.ndarray | None = None

    def __getstate__(self):
        return self.languages, self.log_probability, self.uses_script

    def __setstate__(self, state):
        self.languages, self.log_probability, self.uses_script = state
        self.forget()

    def forget(self) -> None:
        """Let go of the words seen."""
        self.known, self.scores = {}, None

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Scores of each word by language: 0 for the best, at least -MOST, less for languages that its script rules out."""
        buckets, owners, scripts = hashed_ngrams(words)
        order = np.argsort(owners, kind="stable")
        buckets, owners = buckets[order], owners[order]
        starts = np.searchsorted(owners, np.arange(len(words)))
        total = np.add.reduceat(self.log_probability[buckets], starts, axis=0) * WEIGHT
        total = np.maximum(total - total.max(axis=1, keepdims=True), -MOST)
        candidates = self.uses_script[scripts]
        candidates[~candidates.any(axis=1)] = True
        total[~candidates] -= 2 * MOST
        return (total - total.max(axis=1, keepdims=True)).astype(np.float32)

    def lookup(self, texts_words: list[list[str]]) -> list[np.ndarray]:
        """The place of each word's scores in ``self.scores``."""
        if self.scores is None or len(self.known) > KNOWN_WORDS:
            self.known, self.scores = {}, np.empty((0, len(self.languages)), np.float32)
        unseen = list(set(chain.from_iterable(texts_words)).difference(self.known))
        for at in range(0, len(unseen), 20_000):
            part = unseen[at : at + 20_000]
            self.known.update(zip(part, range(len(self.scores), len(self.scores) + len(part)), strict=True))
            self.scores = np.concatenate([self.scores, self.word_scores(part)])
        get = self.known.__getitem__
        return [self.scores[np.fromiter(map(get, words), np.int32, len(words))] for words in texts_words]


def viterbi(scores: list[np.ndarray], switch: float = SWITCH) -> list[np.ndarray]:
    """The best language of each word of each text; a change between two words costs ``switch``.

    best[t] = score[t] + max(best[t-1], max(best[t-1]) - switch), language by language. Texts run
    side by side, longest first, as long as many are left; the tails of the longest go one by one.
    Ties go to staying, then to the first language.
    """
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    order = [i for i in order if len(scores[i])]
    out = [np.empty(len(s), np.int16) for s in scores]
    if not order:
        return out
    lengths = np.array([len(scores[i]) for i in order])
    steps = int(lengths[FEW - 1]) if len(order) >= FEW else 0
    starts = np.cumsum(lengths) - lengths
    flat = np.concatenate([scores[i] for i in order])
    running = np.searchsorted(-lengths, -np.arange(1, steps + 1), "right")
    for t in range(1, steps):
        now = starts[: running[t]] + t
        before = flat[now - 1]
        flat[now] += np.maximum(before, before.max(axis=1, keepdims=True) - switch)
    for n in range(len(order)):  # texts longer than the common steps
        if lengths[n] <= max(steps, 1):
            break
        rows = flat[starts[n] : starts[n] + lengths[n]]
        t0 = max(steps, 1)
        best = rows[t0 - 1].tolist()
        done = []
        for row in rows[t0:].tolist():
            least = max(best) - switch
            best = [s + (b if b > least else least) for s, b in zip(row, best)]  # noqa: B905
            done.append(best)
        rows[t0:] = done
    path = np.empty(len(flat), np.int16)
    peak = flat.argmax(axis=1)
    state = peak[starts + lengths - 1].copy()
    path[starts + lengths - 1] = state
    for n in range(len(order)):
        if lengths[n] <= max(steps, 1):
            break
        first, at, s = int(starts[n]), int(starts[n] + lengths[n] - 1), int(state[n])
        rows = flat[first : at + 1]
        jump = (rows < rows.max(axis=1, keepdims=True) - switch).tolist()
        peaks = peak[first : at + 1].tolist()
        back = []
        for t in range(int(lengths[n]) - 2, max(steps, 1) - 2, -1):
            if jump[t][s]:
                s = peaks[t]
            back.append(s)
        path[first + max(steps, 1) - 1 : at] = back[::-1]
        state[n] = s
    for t in range(steps - 2, -1, -1):
        m = running[t + 1]
        now = starts[:m] + t
        s = state[:m]
        # A text that ends at t + 1 enters here with its last state.
        ended = lengths[:m] == t + 2
        s = np.where(ended, path[np.minimum(now + 1, len(path) - 1)], s)
        before = flat[now]
        leave = before[np.arange(m), s] < before.max(axis=1) - switch
        state[:m] = np.where(leave, peak[now], s)
        path[now] = state[:m]
    for n, i in enumerate(order):
        out[i] = path[starts[n] : starts[n] + lengths[n]]
    return out


def fit_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Fit n-gram scores on a sample of at most ``rows`` rows of each language.

    The sample is the rows of a language with the smallest hash of the id; their whole texts are
    counted by Spark into BUCKETS counters a language, which go to the driver. Rows with a null
    label or text are left out. With no rows left the model knows no language, and every text is
    ``und``. The language itself is no input of a prediction.
    """
    labelled = docs.filter(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    first = Window.partitionBy("lang").orderBy("h", "doc_id")
    keys = labelled.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("string").alias("lang"), F.xxhash64(id_col).alias("h"))
    chosen = keys.distinct().withColumn("n", F.row_number().over(first)).filter(F.col("n") <= rows).select("doc_id", "lang")
    sample = labelled.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("lang"))
    # At most ``rows`` keys a language: small enough to send to every task.
    sample = sample.join(F.broadcast(chosen), ["doc_id", "lang"])

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = WORDS.findall(text.lower())
                if not words:
                    continue
                total = sums.setdefault(lang, np.zeros(BUCKETS + len(_NAMES), np.int64))
                for at in range(0, len(words), 50_000):
                    buckets, _, scripts = hashed_ngrams(words[at : at + 50_000])
                    total[:BUCKETS] += np.bincount(buckets, minlength=BUCKETS)
                    total[BUCKETS:] += np.bincount(scripts[scripts >= 0], minlength=len(_NAMES))
        for lang, total in sums.items():
            where = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(where)), pa.array(where, pa.int32()), pa.array(total[where])], names=["lang", "bucket", "n"])

    counts = in_bounded_batches(sample).select("doc_id", "text", "lang").mapInArrow(tidy(count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["lang"].unique())
    table = np.zeros((BUCKETS + len(_NAMES), len(languages)))
    table[counts["bucket"], np.searchsorted(languages, counts["lang"])] = counts["n"]
    grams, scripts = table[:BUCKETS], table[BUCKETS:]
    probability = np.log((grams + 0.5) / (grams.sum(axis=0) + 0.5 * BUCKETS)) if languages else grams
    share = scripts / np.maximum(scripts.sum(axis=0), 1)
    uses = np.vstack([share >= SCRIPT_SHARE, np.ones((1, len(languages)), bool)])  # the last row, -1: no known script
    return LanguageModel(languages, probability.astype(np.float32), uses)


def _labels(texts: pa.Array, model: LanguageModel, switch: float, spans: bool):
    """Yield for consecutive runs of texts: their number, languages, shares, spans (none asked: none) and letters."""
    names = model.languages
    for group in chunks(pc.fill_null(texts, "").to_pylist(), BATCH_CHARS):
        scores: list[np.ndarray] = []
        letters: list[np.ndarray] = []
        for part in chunks(group):
            words = [WORDS.findall(text.lower()) for text in part]
            letters += [np.fromiter(map(len, w), np.int64, len(w)) for w in words]
            scores += model.lookup(words) if names else [np.empty((0, 0), np.float32)] * len(part)
        paths = viterbi(scores, switch) if names else [np.empty(0, np.int16)] * len(group)
        langs, shares, found = [], [], []
        for text, sizes, path in zip(group, letters, paths, strict=True):
            if not len(path):
                langs.append("und")
                shares.append(0.0)
                found.append([])
                continue
            by = np.bincount(path, sizes, len(names))
            best = int(by.argmax())
            langs.append(names[best])
            shares.append(float(by[best] / by.sum()))
            if spans:
                turns = np.concatenate([[0], np.flatnonzero(np.diff(path)) + 1])
                found.append(_spans(text, path, turns, names))
        yield len(group), langs, shares, found, [int(x.sum()) for x in letters]


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", switch: float = SWITCH) -> DataFrame:
    """Label the spans of every whole text, and the text with the language that most of its letters are in.

    Result: id, lang_pred, score (the share of letters in spans of that language; 0 for ``und``),
    spans (array of begin, end, lang: code points of the text, end exclusive, a span from the first
    letter of its first word to the last of its last), letters (how many the text has). A text that is null, empty or without a
    letter is ``und`` and has no spans; ties between languages go to the first in order of name.
    Rows are kept as they are: repeated rows give repeated results, a null id stays null, an empty
    table gives no rows. Columns besides the two named are not read.
    """
    span = T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType()), T.StructField("lang", T.StringType())]))
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", span), T.StructField("letters", T.LongType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    arrow_span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches):
        for batch in batches:
            first = 0
            for n, langs, shares, spans, letters in _labels(batch.column(1), shared.value, switch, True):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(langs, pa.string()), pa.array(shares, pa.float64()), pa.array(spans, arrow_span), pa.array(letters, pa.int64())], names=schema.names)
                first += n

    return in_bounded_batches(docs).select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(tidy(run), schema)


def rows_with_language(docs: DataFrame, model: LanguageModel, lang: str, letters: str, text_col: str = "text", switch: float = SWITCH) -> DataFrame:
    """All rows of ``docs`` as they are, with their language and count of letters (as ``identify`` has them) in two more columns.

    Rows travel whole, their text once; ``lang`` and ``letters`` must be names that ``docs`` does not have.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(lang, T.StringType()), T.StructField(letters, T.LongType())])
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            first = 0
            for n, langs, _, _, counts in _labels(pc.cast(batch.column(at), pa.string()), shared.value, switch, False):
                part = batch.slice(first, n)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(counts, pa.int64())], names=schema.names)
                first += n

    return in_bounded_batches(docs).mapInArrow(tidy(run, lambda: shared.value.forget()), schema)


def _spans(text: str, path: np.ndarray, turns: np.ndarray, names: list[str]) -> list[dict]:
    """Where each run of words of one language begins and ends in the text."""
    lower = text.lower()
    if len(turns) == 1:  # one span, from the first letter to the last
        where = text if len(text) == len(lower) else lower
        end = len(where)
        while WORDS.match(where, end - 1) is None:
            end -= 1
        return [{"begin": WORDS.search(where).start(), "end": end, "lang": names[path[0]]}]
    at = [m.span() for m in WORDS.finditer(text)] if len(text) == len(lower) else None
    if at is None or len(at) != len(path):  # lower case has another length: place the words in it
        at = [m.span() for m in WORDS.finditer(lower)]
    ends = [*turns[1:], len(path)]
    return [{"begin": at[a][0], "end": at[b - 1][1], "lang": names[path[a]]} for a, b in zip(turns, ends, strict=True)]
