"""Language identification with a linear-chain conditional random field over words.

A text is lines of words (runs of letters); a line is a chain of any length. A word's score for a language sums the
learned weights of its features: character n-grams of one to five, where those that touch a word's edge are its affixes,
the word itself, and whether a lexicon counts it mostly to one language. Transitions between languages and the languages
of first words are learned with them. Forward-backward gives each word's probability of each language; a text's language
has the largest sum over its words, and the score is its mean. So a code-switched text gets the language of most of its
words, while a foreign word within a sentence is carried by its neighbours.

Training takes a bounded sample: ``SAMPLE`` documents of each language, those with the smallest hash of their id, and of
each at most ``SAMPLE_CHARS`` characters, in pieces from all of the text. Labels are those of documents; so that transitions see switches, a share
``MIXED`` of the training chains is composed of runs of words from lines of several languages, each run with its own
label. Prediction is a narrow map over all documents and whole texts.
"""

from __future__ import annotations

import random
import uuid
from collections import Counter, defaultdict
from itertools import groupby

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import prepare
from .batches import crc_of_id, doc_columns, kept, map_batches, REMEMBERED, spread
from .word_hashes import mixed

#: Documents of each language that training reads at most, and characters of each.
SAMPLE, SAMPLE_CHARS = 80, 20_000
#: Composed chains for each plain one, and the words of a run in them.
MIXED, RUN = 0.25, (3, 12)
#: Parts of a language's ids from which the sample is drawn.
PARTS = 64
#: Words of a chain that are gone through one by one; parts of this size run side by side, and exact messages join them.
PART = 128
NGRAMS = 5
BITS = 18
ROUNDS = 25
UNKNOWN = "und"

_WORD = regex.compile(r"\p{L}+|\n")


class Features:
    """Hashed features of words; ``lexicon`` gives the language (from 1) that counts a word mostly."""

    def __init__(self, lexicon: dict[str, int]):
        self.lexicon = lexicon

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Feature places word after word, and how many each word has."""
        text = "".join(f"^{w}$" for w in words)
        c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
        size = np.array([len(w) + 2 for w in words], np.int64)
        end = np.repeat(np.cumsum(size), size)
        owner = np.repeat(np.arange(len(words)), size)
        at = np.arange(len(c))
        keys, owners = [], []
        h = np.zeros(len(c), np.uint64)
        for n in range(1, NGRAMS + 1):
            own = np.flatnonzero(at + n <= end)
            h = mixed(h[: len(c) - n + 1] + c[n - 1 :] * np.uint64(2 * n + 1)) if len(c) >= n else h[:0]
            keys.append(h[own] + np.uint64(n))
            owners.append(owner[own])
        whole = np.zeros(len(c) + 1, np.uint64)
        np.cumsum(mixed(c + (at - (end - np.repeat(size, size))).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), out=whole[1:])
        stop = np.cumsum(size)
        keys.append(whole[stop] - whole[stop - size] + np.uint64(77))
        owners.append(np.arange(len(words)))
        known = [(k, self.lexicon[w]) for k, w in enumerate(words) if w in self.lexicon]
        keys.append(np.array([x for _, x in known], np.uint64) + np.uint64(0x1EC0))
        owners.append(np.array([k for k, _ in known], np.int64))
        key, owner = (mixed(np.concatenate(keys)) & np.uint64((1 << BITS) - 1)).astype(np.int64), np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        return key[order], np.bincount(owner, minlength=len(words))


class Chains:
    """Words in parts of chains, longest first, so that at each step the parts still running come first."""

    def __init__(self, breaks: np.ndarray, n: int):
        """breaks: places of words that begin a chain, ascending, among n words."""
        self.heads = breaks
        length = np.diff(np.append(breaks, n))
        parts = -(-length // PART)
        number = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first = np.repeat(breaks, parts) + PART * number
        length = np.minimum(PART, np.repeat(breaks + length, parts) - first)
        order = np.argsort(-length, kind="stable")
        self.first, self.length, self.number = first[order], length[order], number[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        # by the number of a part in its chain: the places of such parts of longer chains, and of their successors
        long = np.repeat(parts > 1, parts)
        self.later = [place[np.flatnonzero((number == k) & long)] for k in range(int(parts.max(initial=1)))] if long.any() else []
        self.running = [int(np.searchsorted(-self.length, -t, "left")) for t in range(int(self.length.max(initial=0)))]

    def _messages(self, e: np.ndarray, start: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What each part gets from the left, before its first word, and from the right, after its last one.

        A part of a longer chain is a matrix from the label before it to the label of its last word.
        """
        k = len(start)
        left, right = np.broadcast_to(start, (len(self.first), k)).copy(), np.ones((len(self.first), k))
        if not self.later:
            return left, right
        own = np.sort(np.concatenate(self.later))  # longest first too
        first, length = self.first[own], self.length[own]
        m = np.where(self.number[own][:, None, None] > 0, step, start) * e[first][:, None, :]
        for t in range(1, int(length.max())):
            r = int(np.searchsorted(-length, -t, "left"))
            m[:r] = (m[:r] @ step) * e[first[:r] + t][:, None, :]
            m[:r] /= m[:r].max(axis=(1, 2), keepdims=True)
        at = np.searchsorted(own, np.arange(len(self.first)))
        norm = lambda x: x / x.sum(axis=1, keepdims=True)
        # parts number j + 1 in the order of their chains, which are the first of those that have a part number j
        chain = [np.argsort(self.first[p], kind="stable") for p in self.later]
        ordered = [p[o] for p, o in zip(self.later, chain, strict=True)]
        of = [self.first[p] - PART * j for j, p in enumerate(ordered)]
        before = [np.searchsorted(of[j], of[j + 1]) for j in range(len(of) - 1)]
        done = norm(m[at[ordered[0]], 0])
        for j in range(1, len(ordered)):
            came = done[before[j - 1]]
            left[ordered[j]] = came @ step
            done = norm((came[:, None, :] @ m[at[ordered[j]]])[:, 0])
        for j in range(len(ordered) - 1, 0, -1):
            right[ordered[j - 1][before[j - 1]]] = norm((m[at[ordered[j]]] @ right[ordered[j]][:, :, None])[:, :, 0])
        return left, right

    def marginals(self, emission: np.ndarray, start: np.ndarray, step: np.ndarray, pairs: bool = False) -> tuple:
        """Probabilities of each label for each word, and expected transitions and first labels if ``pairs``."""
        k = emission.shape[1]
        e = np.exp(emission - emission.max(axis=1, keepdims=True))
        alpha, gamma = np.zeros_like(e), np.zeros_like(e)
        left, beta = self._messages(e, start, step)
        now = None
        for t, m in enumerate(self.running):
            at = self.first[:m] + t
            now = (left if t == 0 else now[:m] @ step) * e[at]
            now /= now.sum(axis=1, keepdims=True)
            alpha[at] = now
        expected = np.zeros((k, k))
        for t in range(len(self.running) - 1, -1, -1):
            m = self.running[t]
            at = self.first[:m] + t
            g = alpha[at] * beta[:m]
            gamma[at] = g / g.sum(axis=1, keepdims=True)
            b = e[at] * beta[:m]
            if pairs:
                own = slice(None) if t else self.number > 0
                a = alpha[at[own] - 1]
                z = ((a @ step) * b[own]).sum(axis=1, keepdims=True)
                expected += step * (a.T @ (b[own] / z))
            if t:
                b = b @ step.T
                beta[:m] = b / b.sum(axis=1, keepdims=True)
        return gamma, expected, gamma[self.heads].sum(axis=0)


def _composed(chains: list[tuple[int, list[int]]], n: int) -> list[list[tuple[int, int]]]:
    """Chains of labelled words that switch: two to five runs, each from a line of another language than the one before."""
    r = random.Random(1)
    by: dict[int, list[list[int]]] = defaultdict(list)
    for lang, own in chains:
        by[lang].append(own)
    out = []
    for _ in range(n if len(by) > 1 else 0):
        chain: list[tuple[int, int]] = []
        lang = None
        for _ in range(r.randint(2, 5)):
            lang = r.choice([x for x in by if x != lang])
            own = r.choice(by[lang])
            size = r.randint(*RUN)
            begin = r.randrange(max(1, len(own) - size + 1))
            chain += [(w, lang) for w in own[begin : begin + size]]
        out.append(chain)
    return out


class Model:
    """Languages, lexicon, and weights."""

    def __init__(self, samples: list[tuple[str, str]]):
        self.languages = sorted({lang for lang, _ in samples})
        k = len(self.languages)
        self.lexicon: dict[str, int] = {}
        self.weights = np.zeros((1 << BITS, k), np.float32)
        self.start, self.step = np.full(k, 1 / max(k, 1)), np.full((k, k), 1 / max(k, 1))
        if k < 2:
            return
        index = {lang: i for i, lang in enumerate(self.languages)}
        docs = [(index[lang], _WORD.findall(text.lower())) for lang, text in samples]
        counts: dict[str, Counter] = defaultdict(Counter)
        for lang, words in docs:
            for w in set(words) - {"\n"}:
                counts[w][lang] += 1
        for w, by in counts.items():
            lang, most = by.most_common(1)[0]
            if most >= 3 and most >= 0.8 * sum(by.values()):
                self.lexicon[w] = lang + 1
        ids = {w: i for i, w in enumerate(counts)}
        chains = [(lang, [ids[w] for w in own]) for lang, words in docs for is_end, group in groupby(words, "\n".__eq__) if not is_end and (own := list(group))]
        if chains:
            labelled = [[(w, lang) for w in own] for lang, own in chains] + _composed(chains, int(MIXED * len(chains)))
            size = np.array([len(c) for c in labelled])
            place, gold = np.array([x for c in labelled for x in c]).T
            self._train(list(ids), place, np.cumsum(size) - size, gold)

    def _train(self, vocabulary: list[str], place: np.ndarray, breaks: np.ndarray, gold: np.ndarray) -> None:
        """AdaGrad on the likelihood of the labels, all chains at once; every language weighs alike."""
        k, n = len(self.languages), len(place)
        key, count = Features(self.lexicon)(vocabulary)
        begin = np.cumsum(count) - count
        owner = np.repeat(np.arange(len(vocabulary)), count)
        chains = Chains(breaks, n)
        truth = np.eye(k)[gold]
        each = np.bincount(gold, minlength=k)
        weight = (n / (k * np.maximum(each, 1)))[gold][:, None]
        inner = np.ones(n, bool)
        inner[chains.heads] = False
        at = np.flatnonzero(inner)
        pair_truth = np.zeros((k, k))
        np.add.at(pair_truth, (gold[at - 1], gold[at]), 1)
        first_truth = truth[chains.heads].sum(axis=0)
        w, a, s = np.zeros((1 << BITS, k)), np.zeros((k, k)), np.zeros(k)
        seen = [np.full_like(x, 1e-6) for x in (w, a, s)]
        soft = lambda x: np.exp(x - x.max(axis=-1, keepdims=True)) / np.exp(x - x.max(axis=-1, keepdims=True)).sum(axis=-1, keepdims=True)
        for _ in range(ROUNDS):
            emission = np.add.reduceat(w[key], begin)
            gamma, pairs, first = chains.marginals(emission[place], soft(s), soft(a), pairs=True)
            by_word = np.zeros((len(vocabulary), k))
            for j in range(k):
                by_word[:, j] = np.bincount(place, ((truth - gamma) * weight)[:, j], minlength=len(vocabulary))
            grad = [np.zeros_like(w), (pair_truth - soft(a) * pair_truth.sum(axis=1, keepdims=True) + pairs - soft(a) * pairs.sum(axis=1, keepdims=True)) / 2 - a, (first_truth - soft(s) * first_truth.sum() + first - soft(s) * first.sum()) / 2 - s]
            for j in range(k):
                grad[0][:, j] = np.bincount(key, by_word[owner, j], minlength=1 << BITS)
            grad[0] -= 0.05 * w * n / len(vocabulary)
            for x, g, h, rate in zip((w, a, s), grad, seen, (0.15, 0.2, 0.2), strict=True):
                h += g * g
                x += rate * g / np.sqrt(h)
        self.weights, self.start, self.step = w.astype(np.float32), soft(s), soft(a)


class Labeller:
    """Predictions of one Python worker, with the emissions of words it has met."""

    def __init__(self, model: Model):
        self.model, self.features = model, Features(model.lexicon)
        self.reset()

    def reset(self) -> None:
        self.ids: dict[str, int] = {"\n": 0}
        self.emission = np.zeros((1, len(self.model.languages)), np.float32)

    def learn(self, words: list[str]) -> None:
        for k in range(0, len(words), 20_000):
            key, count = self.features(words[k : k + 20_000])
            self.emission = np.concatenate((self.emission, np.add.reduceat(self.model.weights[key], np.cumsum(count) - count)))
        self.ids.update(zip(words, range(len(self.ids), len(self.ids) + len(words)), strict=True))

    def __call__(self, texts: list[str]) -> list[tuple[str, float]]:
        k = len(self.model.languages)
        docs = [_WORD.findall(t.lower()) for t in texts]
        if k == 0:
            return [(UNKNOWN, 0.0)] * len(texts)
        if len(self.ids) > 2 * REMEMBERED:
            self.reset()
        new: set[str] = set()
        for d in docs:
            new.update(set(d).difference(self.ids))
        if new:
            self.learn(list(new))
        size = np.array([len(d) for d in docs], np.int64)
        own = np.fromiter((i for d in docs for i in map(self.ids.__getitem__, d)), np.int64, int(size.sum()))
        doc = np.repeat(np.arange(len(docs)), size)
        is_word = own > 0
        place, doc = own[is_word], doc[is_word]
        if not len(place):
            return [(UNKNOWN, 0.0)] * len(texts)
        gaps = np.cumsum(~is_word)[is_word]
        begins = np.ones(len(place), bool)
        begins[1:] = (doc[1:] != doc[:-1]) | (gaps[1:] != gaps[:-1])
        gamma, *_ = Chains(np.flatnonzero(begins), len(place)).marginals(self.emission[place].astype(np.float64), self.model.start, self.model.step)
        total = np.stack([np.bincount(doc, gamma[:, j], minlength=len(docs)) for j in range(k)], axis=1)
        words = np.bincount(doc, minlength=len(docs))
        best = total.argmax(axis=1)
        share = total[np.arange(len(docs)), best] / np.maximum(words, 1)
        return [(self.model.languages[b], min(1.0, float(s))) if n else (UNKNOWN, 0.0) for b, s, n in zip(best, share, words, strict=True)]


def fit(docs: DataFrame, learn: Column, sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> Model:
    """A model from at most ``sample`` documents of each language among those that ``learn`` admits.

    A document in two languages teaches both; of rows with one id and language the text that sorts first teaches.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", spread(F.col("text"), sample_chars).alias("text")).where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    ids = own.select("doc_id", "lang").distinct().withColumn("h", F.xxhash64("doc_id")).withColumn("part", F.expr(f"pmod(h, {PARTS})"))
    for keys in (("lang", "part"), ("lang",)):  # a language may hold most rows: its parts are cut down first
        first = F.row_number().over(Window.partitionBy(*keys).orderBy("h", "doc_id")) <= sample
        ids = ids.withColumn("first", first).where("first").drop("first")
    ids = ids.select("doc_id", "lang")
    # as many rows as ids, however many rows an id has
    rows = own.join(F.broadcast(ids), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["lang"], r["text"]))
    return Model([(r["lang"], r["text"]) for r in rows])


def languages(docs: DataFrame, folds: int = 5, held: int = 0, carry: tuple[str, ...] = (), sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document. Held-out ids (crc32 mod folds = held) teach nothing.

    ``und`` with score 0 stands for a null text, one without a letter, or any text where nothing could be learned. With
    one known language every text with a letter is predicted that. A null id is not held out and teaches nothing. Repeated
    rows are labelled each for itself; of languages that tie, the first by name is taken; whole texts of any length count.
    Further columns, whatever their names, are not read, but those named in ``carry`` pass through. The fit reads at most
    ``sample`` documents of each language, and of each at most ``sample_chars`` characters, in pieces from all of it.
    """
    spark = prepare(docs.sparkSession)
    held_out = crc_of_id(F.col("doc_id")) % folds == held
    model, key = spark.sparkContext.broadcast(fit(docs, ~held_out, sample, sample_chars)), uuid.uuid4().hex

    def make() -> object:
        label = kept(("language_crf", key), lambda: Labeller(model.value))

        def convert(batch: pa.RecordBatch) -> dict:
            texts = batch.column("text").to_pylist()
            out = [x for k in range(0, len(texts), 250) for x in label(texts[k : k + 250])]
            return {"doc_id": batch.column("doc_id"), "lang_pred": pa.array([x[0] for x in out], pa.string()), "score": pa.array([x[1] for x in out], pa.float64())}

        return convert

    out = map_batches(doc_columns(docs, "doc_id", "text", *carry), make, "doc_id long, lang_pred string, score double", carry)
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", *carry)
