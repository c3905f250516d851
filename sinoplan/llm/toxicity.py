"""Toxicity: a learned lexicon, misspellings by automata over its trie, and scores of the context."""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sinoplan.llm.common import in_bounded_batches, tidy
from sinoplan.llm.tokens import chunks

#: Labelled rows that are learned from, at most: those with the smallest hash of the id.
SAMPLE_ROWS = 20_000
#: A term must be in this many toxic texts, in this share of them, and this many times likelier there.
LEAST_TEXTS, LEAST_SHARE, LEAST_ODDS = 5, 0.015, 12.0
#: Lengths of stems.
STEMS = (4, 5, 6, 7)
#: Edits that a term or stem of so many letters may have; shorter ones must be spelled right.
EDITS = ((8, 2), (4, 1))
#: A misspelled hit counts for this share of the term's log odds where nothing is known of it, and for
#: nothing if what is learned of the term's neighbours is less than the second number.
FUZZY_SHARE, FUZZY_LEAST = 0.6, 1.0
#: What a toxic text counts for as one whose terms are misspelled, beside itself.
WRONG_SHARE = 0.2
#: Words to either side of a hit that tell quotation from abuse.
WINDOW = 6
#: Words that a worker remembers.
KNOWN_WORDS = 300_000
#: Characters of texts whose words are looked up together, and of one regular expression by which words are ruled out.
TEXTS, PATTERN = 1 << 20, 10_000

TOKENS = re.compile(r"[\"“”„«»‘’]|\w+")
QUOTES = frozenset("\"“”„«»‘’")
#: Words that report what others said.
REPORTING = frozenset("said says quoted quote quotes called word words term wrote writes text insult slur example dit mot cité sagte wort zitat dijo palabra cita".split())
#: Words that address the reader.
ADDRESS = frozenset("you your youre u ur du dich dein ihr euch tu te ton toi vous vos tú usted eres".split())


def budget(name: str) -> int:
    """Edits that a term, or a stem with its star, may have."""
    return next((k for n, k in EDITS if len(name.rstrip("*")) >= n), 0)


def spellings(name: str, edits: int) -> set[str]:
    """Regular expressions of all words within so many edits of a name."""
    found = {tuple(name)}
    for _ in range(edits):
        # Another letter or none in place of one; one put in.
        found = {(*v[:i], ".?", *v[i + 1 :]) for v in found for i in range(len(v))} | {(*v[:i], ".", *v[i:]) for v in found for i in range(len(v) + 1)}
    return {"".join(v) for v in found}


@dataclass
class Lexicon:
    """Terms and stems (open-ended beginnings of words) with their log odds, and the trie that automata run over.

    Hits name a stem with a star at its end. ``fuzzy``: log odds of a misspelled hit by such names;
    those of no use are not in it, and not in the trie.
    """

    terms: dict[str, float]
    stems: dict[str, float]
    fuzzy: dict[str, float] | None = None
    trie: dict = field(default_factory=dict, repr=False)

    def __post_init__(self):
        if self.fuzzy is None:
            self.fuzzy = {t: FUZZY_SHARE * o for t, o in self.named().items() if budget(t)}
        self.trie, self.heads, self.tails, self.inner = {}, {}, {}, {}
        for name in self.fuzzy:
            term, stem = name.rstrip("*"), name.endswith("*")
            node = self.trie
            for c in term:
                node = node.setdefault(c, {})
            node["*" if stem else ""] = name
            # With k edits one of k + 1 pieces is left alone: a cheap way to rule words out.
            k, n = budget(term), len(term)
            cuts = [n * i // (k + 1) for i in range(k + 2)]
            for i, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)):
                where = self.heads if i == 0 else self.tails if i == k and not stem else self.inner
                where.setdefault(y - x, set()).add(term[x:y])
        plain = [t for t in self.fuzzy if not t.endswith("*")]
        self.lengths = (min((len(t.rstrip("*")) - budget(t) for t in self.fuzzy), default=1), 99 if len(plain) < len(self.fuzzy) else max((len(t) + budget(t) for t in plain), default=0))

    def named(self) -> dict[str, float]:
        """Log odds of all terms and stems."""
        return self.terms | {f"{t}*": o for t, o in self.stems.items()}

    def odds(self, name: str, edits: int) -> float:
        return self.fuzzy[name] if edits else self.stems[name[:-1]] if name.endswith("*") else self.terms[name]

    def match(self, word: str) -> tuple[str, int] | None:
        """The term that a word is or begins with, or is few edits from, and the edits."""
        if word in self.terms:
            return word, 0
        for n in STEMS:
            if word[:n] in self.stems:
                return f"{word[:n]}*", 0
        if self.lengths[0] <= len(word) <= self.lengths[1] and self.has_piece(word):
            return self.near(word)
        return None

    @functools.cached_property
    def patterns(self) -> list[str]:
        """Regular expressions; a word that fits none of them has no match."""
        found = [f"{t}$" for t in self.terms] + list(self.stems)
        for name in self.fuzzy:
            end = "" if name.endswith("*") else "$"
            found += [f"{x}{end}" for x in sorted(spellings(name.rstrip("*"), budget(name)))]
        out, size = [], PATTERN
        for x in found:
            if size + len(x) >= PATTERN:
                out.append([])
                size = 0
            out[-1].append(x)
            size += len(x) + 1
        return [f"^(?:{'|'.join(xs)})" for xs in out]

    def matches(self, words) -> dict[str, tuple[str, int]]:
        """What ``match`` finds for those words that have a match; nearly all others are ruled out together."""
        words = pa.array(words, pa.string())
        fits = [pc.match_substring_regex(words, pattern) for pattern in self.patterns]
        maybe = words.filter(functools.reduce(pc.or_, fits)).to_pylist() if fits else []
        return {word: m for word in maybe if (m := self.match(word)) is not None}

    def has_piece(self, word: str) -> bool:
        if any(word[:n] in s for n, s in self.heads.items()) or any(word[-n:] in s for n, s in self.tails.items()):
            return True
        return any(word[i : i + n] in s for n, s in self.inner.items() for i in range(len(word) - n + 1))

    def near(self, word: str) -> tuple[str, int] | None:
        """Run the Levenshtein automaton of the word along the trie.

        A state is a set of (letters read, edits made), kept as a bit mask for each number of edits; a
        trie edge moves it, and a branch ends where all are empty. At the end of a term the whole word
        must be read, at the end of a stem any beginning of it. Ties go to fewer edits, then to the
        higher odds, then to the first in order.
        """
        n = len(word)
        letters: dict[str, int] = {}
        for i, c in enumerate(word):
            letters[c] = letters.get(c, 0) | 1 << i
        full, most = (2 << n) - 1, max(k for _, k in EDITS)
        best = None
        stack = [(self.trie, tuple((2 << e) - 1 & full for e in range(most + 1)))]  # up to e letters left out at once
        while stack:
            node, masks = stack.pop()
            for name in (node.get(""), node.get("*")):
                if name is not None:
                    read = [m if name.endswith("*") else m >> n & 1 for m in masks[: budget(name) + 1]]
                    edits = next((e for e, m in enumerate(read) if m), None)
                    if edits:  # without an edit it is no misspelling
                        key = (edits, -self.fuzzy[name], name)
                        best = min(best, key) if best else key
            for c, below in node.items():
                if c and c != "*":
                    same = letters.get(c, 0)
                    moved = [(masks[0] & same) << 1]
                    for e in range(1, most + 1):
                        # A letter read; one put in; one in place of another; one left out.
                        moved.append(((masks[e] & same) << 1 | masks[e - 1] | masks[e - 1] << 1 | moved[e - 1] << 1) & full)
                    if any(moved):
                        stack.append((below, tuple(moved)))
        return (best[2], best[0]) if best else None


class Matcher:
    """The words of texts with what a lexicon finds for them; words are remembered."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.seen, self.found = lexicon, set(), {}

    def read(self, texts: list[str]):
        """Yield each text's words, and the matches of all words that have one (none if no word of the text has)."""
        for part in chunks(texts, TEXTS):
            words = [TOKENS.findall(text.lower()) for text in part]
            new = set().union(*words) - self.seen
            if len(self.seen) + len(new) > KNOWN_WORDS:
                self.seen, self.found = set(), {}
                new = set().union(*words)
            self.found.update(self.lexicon.matches(list(new)))
            self.seen |= new
            for ws in words:
                yield ws, {} if self.found.keys().isdisjoint(ws) else self.found


@dataclass
class ToxicityModel:
    """A lexicon, log odds of words seen around hits, and weights of a text's features."""

    lexicon: Lexicon
    context: dict[str, float]
    weights: np.ndarray
    known: Matcher | None = None

    def __getstate__(self):
        return self.lexicon, self.context, self.weights

    def __setstate__(self, state):
        self.lexicon, self.context, self.weights = state
        self.known = None

    def forget(self) -> None:
        """Let go of the words seen."""
        self.known = None

    def hits(self, texts: list[str]):
        """Yield for each text its hits: term, edits, score in its window, and whether it is quoted."""
        if self.known is None:
            self.known = Matcher(self.lexicon)
        for words, found in self.known.read(texts):
            yield [(*found[w], *self.hit(words, i, *found[w])) for i, w in enumerate(words) if w in found] if found else []

    def hit(self, words: list[str], at: int, term: str, edits: int) -> tuple[float, bool]:
        """The score of one hit in its window, and whether it is quoted.

        The words around add their mean log odds. It is quoted between two quotation marks, or after a
        word that reports, unless the reader is addressed.
        """
        before, after = words[max(0, at - WINDOW) : at], words[at + 1 : at + 1 + WINDOW]
        marks = any(w in QUOTES for w in before) and any(w in QUOTES for w in after)
        reported = any(w in REPORTING for w in before)
        addressed = any(w in ADDRESS for w in before + after)
        around = [self.context.get(w, 0.0) for w in before + after]
        score = self.lexicon.odds(term, edits) + (sum(around) / len(around) if around else 0.0) + 0.5 * addressed
        return max(score, 0.0), (marks or reported) and not addressed

    def features(self, hits: list[tuple[str, int, float, bool]]) -> np.ndarray:
        """What hits come to, those that are quoted apart from the others; zeros if there are none."""
        out = np.zeros(FEATURES)
        for at, quoted in ((0, False), (2, True)):
            scores = [h[2] for h in hits if h[3] == quoted]
            if scores:
                out[at], out[at + 1] = max(scores), np.log1p(sum(scores))
        return out

    def misspelled(self, hits: list[tuple[str, int, float, bool]]) -> list[tuple[str, int, float, bool]]:
        """The hits as they would be with an edit in each; what is not told with an edit is left out."""
        lexicon = self.lexicon
        return [(t, 1, max(s - lexicon.odds(t, e) + lexicon.fuzzy[t], 0.0), q) for t, e, s, q in hits if t in lexicon.fuzzy]

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-(self.weights[0] + self.features(next(self.hits([text]))) @ self.weights[1:]))))


FEATURES = 4


def sampled(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """Texts of at most ``rows`` labelled documents, one for each text and label."""
    told = labels.filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = told.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # At most ``rows`` pairs of numbers: small enough to send to every task.
    return docs.filter(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id").select("text", F.col("label").cast("int").alias("label")).distinct()


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Learn lexicon, context and weights from at most ``rows`` labelled documents.

    Spark counts in how many toxic and other texts of the sample each word and stem is; those far
    likelier in toxic texts make the lexicon, however many they are. A second pass counts in how many texts each term's
    neighbours by edits are, which tells misspellings from other words; a third the words around hits;
    a fourth takes the features of each text, and of toxic ones as if their terms were misspelled, on
    which a logistic regression with weights of no less than zero (at most twice ``rows`` lines of four
    numbers) is fitted on the driver. Labels other than 0 and 1 are left out; a document labelled
    twice counts as toxic if either says so. With no toxic text left the lexicon is empty and every
    text gets the same score, the share of toxic texts (0 if nothing is labelled).
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sample = sampled(texts, labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label")), rows).persist()
    in_bounded_batches(sample)
    totals = dict(sample.groupBy("label").count().collect())
    toxic, other = totals.get(1, 0), totals.get(0, 0)

    def terms(batches):
        for batch in batches:
            out = [[], [], []]
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = {w for w in TOKENS.findall(text.lower()) if w not in QUOTES and not w.isdigit()}
                found = words | {w[:n] + "*" for w in words for n in STEMS if len(w) >= n}
                out[0] += found
                out[1] += [label] * len(found)
                out[2] += [1 - label] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], names=["term", "t", "o"])

    counted = sample.mapInArrow(tidy(terms), "term string, t long, o long").groupBy("term").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))
    odds = F.log((F.col("t") + 0.1) / (toxic + 1)) - F.log((F.col("o") + 0.5) / (other + 1))
    least = max(LEAST_TEXTS, LEAST_SHARE * toxic)
    picked = counted.filter(F.col("t") >= least).withColumn("odds", odds).filter(F.col("odds") >= float(np.log(LEAST_ODDS)))
    picked = picked.orderBy(F.desc("t"), "term").collect()  # of a bounded sample
    lexicon = _lexicon([(r["term"], r["t"], r["odds"]) for r in picked])
    lexicon = Lexicon(lexicon.terms, lexicon.stems, _fuzzy(sample, lexicon, toxic, other))
    model = ToxicityModel(lexicon, {}, np.zeros(FEATURES + 1))
    shared = spark.sparkContext.broadcast(model)

    def around(batches):
        known = Matcher(shared.value.lexicon)
        for batch in batches:
            out = [[], [], []]
            for (words, found), label in zip(known.read(batch.column(0).to_pylist()), batch.column(1).to_pylist(), strict=True):
                seen = {w for i, x in enumerate(words) if x in found for w in words[max(0, i - WINDOW) : i] + words[i + 1 : i + 1 + WINDOW] if w not in found} if found else ()
                out[0] += seen
                out[1] += [label] * len(seen)
                out[2] += [1 - label] * len(seen)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], names=["term", "t", "o"])

    near = sample.mapInArrow(tidy(around), "term string, t long, o long").groupBy("term").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))
    # Only words that other texts' hits have around them too can tell the two apart.
    near = near.filter((F.col("o") >= 5) & (F.col("t") + F.col("o") >= 20)).orderBy(F.desc(F.col("t") + F.col("o")), "term").collect()
    all_t, all_o = sum(r["t"] for r in near) + 1, sum(r["o"] for r in near) + 1
    model.context = {r["term"]: float(np.log((r["t"] + 1) / all_t) - np.log((r["o"] + 1) / all_o)) for r in near}
    fitted = spark.sparkContext.broadcast(model)

    def lines(batches):
        for batch in batches:
            rows = []
            for hits, label in zip(fitted.value.hits(batch.column(0).to_pylist()), batch.column(1).to_pylist(), strict=True):
                rows.append([float(label), 1.0, *fitted.value.features(hits)])
                # A toxic text stays one if its terms are misspelled, which the sample may not show.
                if label and (wrong := fitted.value.misspelled(hits)):
                    rows.append([1.0, WRONG_SHARE, *fitted.value.features(wrong)])
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64()))], names=["x"])

    table = np.array([r["x"] for r in sample.mapInArrow(tidy(lines), "x array<double>").collect()] or np.zeros((0, FEATURES + 2)))
    sample.unpersist()
    model.weights = _logistic(table[:, 2:], table[:, 0], table[:, 1])
    return model


def _fuzzy(sample: DataFrame, lexicon: Lexicon, toxic: int, other: int) -> dict[str, float]:
    """Log odds of a misspelled hit of each term, from the texts that have one.

    Where none has, a share of the term's own; the more texts have one, the less that share has a say.
    The words of a stem's family, of which there can be very many, are judged together as well: what
    their neighbours come to in all is the most that one of them counts.
    """
    family = {t: f"{t[:n]}**" for t in lexicon.terms for n in reversed(STEMS) if t[:n] in lexicon.stems}
    shared = sample.sparkSession.sparkContext.broadcast(lexicon)

    def near(batches):
        known = Matcher(shared.value)
        for batch in batches:
            out = [[], [], []]
            for (words, matches), label in zip(known.read(batch.column(0).to_pylist()), batch.column(1).to_pylist(), strict=True):
                found = {m[0] for m in map(matches.get, matches.keys() & set(words)) if m[1]}
                found |= {family[t] for t in found if t in family}
                out[0] += found
                out[1] += [label] * len(found)
                out[2] += [1 - label] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], names=["term", "t", "o"])

    rows = sample.mapInArrow(tidy(near), "term string, t long, o long").groupBy("term").agg(F.sum("t").alias("t"), F.sum("o").alias("o")).collect()
    seen = {r["term"]: (r["t"], r["o"]) for r in rows}

    def learned(name: str, odds: float) -> float:
        t, o = seen.get(name, (0, 0))
        prior = 0.5 * np.exp(FUZZY_SHARE * odds) * (toxic + 1) / (other + 1)
        return float(np.log((t + prior) / (toxic + 1)) - np.log((o + 0.5) / (other + 1)))

    out = {}
    for term, odds in lexicon.named().items():
        told = min(odds, learned(term, odds), learned(family[term], odds) if term in family else odds)
        if budget(term) and told >= FUZZY_LEAST:
            out[term] = told
    return out


def _lexicon(found: list[tuple[str, int, float]]) -> Lexicon:
    """Words and stems that tell something of their own.

    A stem stands for a family of words: it is taken if it is in clearly more toxic texts than any
    longer stem or word of it, and then its longer stems go; so a word's own beginnings are not taken
    beside it.
    """
    words = {t: (n, o) for t, n, o in found if not t.endswith("*")}
    stems = {t[:-1]: (n, o) for t, n, o in found if t.endswith("*")}
    most: dict[str, int] = {}
    for word, (n, _) in words.items():
        for k in STEMS:
            most[word[:k]] = max(most.get(word[:k], 0), n)
    families: dict[str, float] = {}
    for stem in sorted(stems, key=lambda s: (len(s), s)):
        if any(stem[:k] in families for k in STEMS if k < len(stem)):
            continue
        n, o = stems[stem]
        if n >= 1.5 * most.get(stem, 0):
            families[stem] = o
    # A family's words stay, since a misspelling is nearer to a word than to the beginning of one.
    return Lexicon({w: o for w, (_, o) in words.items()}, families)


def _logistic(x: np.ndarray, y: np.ndarray, share: np.ndarray, ridge: float = 1.0, steps: int = 60) -> np.ndarray:
    """Weights, the constant first, of a ridge logistic regression by Newton's steps.

    More and stronger hits cannot make a text less toxic: features whose weight comes out negative are
    left out, and the others fitted again.
    """
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return np.concatenate([[np.log((share * len(y) + 1e-6) / ((1 - share) * len(y) + 1e-6)) if len(y) else -20.0], np.zeros(x.shape[1])])
    use = np.ones(x.shape[1] + 1, bool)
    while True:
        full = np.hstack([np.ones((len(x), 1)), x])[:, use]
        penalty = ridge * np.eye(full.shape[1])
        penalty[0, 0] = 1e-6
        w = np.zeros(full.shape[1])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
            step = np.linalg.solve((full * (share * p * (1 - p))[:, None]).T @ full + penalty, full.T @ (share * (y - p)) - penalty @ w)
            w = w + np.clip(step, -3, 3)
            if np.abs(step).max() < 1e-8:
                break
        out = np.zeros(len(use))
        out[use] = w
        if (out[1:] >= 0).all():
            return out
        use[1:] &= out[1:] >= 0


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text.

    Result: id, score (0 to 1), predicted (1 if score >= 0.5), n_hits, n_quoted. A null text counts as
    empty; a text without a hit gets the constant score of such texts. Rows are kept as they are:
    repeated rows give repeated results, a null id stays null, an empty table gives no rows, and
    columns besides the two named are not read.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("n_hits", T.LongType()), T.StructField("n_quoted", T.LongType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        known = shared.value
        for batch in batches:
            first, texts = 0, pc.fill_null(batch.column(1), "").to_pylist()
            for part in chunks(texts):
                found = list(known.hits(part))
                x = np.array([known.features(hits) for hits in found])
                score = 1 / (1 + np.exp(-np.clip(known.weights[0] + x @ known.weights[1:], -40, 40)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(part)), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array([len(h) for h in found], pa.int64()), pa.array([sum(q for *_, q in h) for h in found], pa.int64())], names=schema.names)
                first += len(part)

    return in_bounded_batches(docs).select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(tidy(run, lambda: shared.value.forget()), schema)
