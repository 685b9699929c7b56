"""The language of a text, and of the spans of a mixed one.

Words are scored by the character trigrams of each language. The script of a word, found
in a table of code point ranges, narrows the candidates to languages written in it. Viterbi
then picks one language per word so that the scores less a penalty for every switch are
highest; runs of one language are the spans, and the language with most letters is the
text's. All texts of a batch step through their words together.

The model is a classifier of bounded size: it is fitted on about ``rows_per_language``
labelled rows of each of the ``max_languages`` most frequent languages, taken by hash, and
keeps the ``max_grams`` most frequent trigrams. Prediction reads the text alone.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and no spans;
texts are read whole; rows are answered each for itself; rows with a null language or id are
not learned from; where nothing can be learned everything is ``und``; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import remainder, stored

ROWS_PER_LANGUAGE = 4_000
MAX_LANGUAGES = 256
MAX_GRAMS = 200_000
SWITCH = 12.0
SMOOTHING = 0.5
#: a language is written in the scripts that hold at least this share of its letters
SCRIPT_SHARE = 0.02
#: words remembered per task
REMEMBERED = 300_000
#: words that are held as texts before they are looked up
WAITING = 200_000
#: words times languages that step through Viterbi together
AT_ONCE = 4_000_000

#: fixed values: first and last code point of scripts' main ranges
SCRIPTS = [
    ("Latin", 0x0041, 0x024F), ("Latin", 0x1E00, 0x1EFF), ("Greek", 0x0370, 0x03FF), ("Greek", 0x1F00, 0x1FFF),
    ("Cyrillic", 0x0400, 0x052F), ("Armenian", 0x0530, 0x058F), ("Hebrew", 0x0590, 0x05FF), ("Arabic", 0x0600, 0x077F),
    ("Devanagari", 0x0900, 0x097F), ("Bengali", 0x0980, 0x09FF), ("Tamil", 0x0B80, 0x0BFF), ("Telugu", 0x0C00, 0x0C7F),
    ("Thai", 0x0E00, 0x0E7F), ("Georgian", 0x10A0, 0x10FF), ("Hangul", 0x1100, 0x11FF), ("Kana", 0x3040, 0x30FF),
    ("Han", 0x3400, 0x9FFF), ("Hangul", 0xAC00, 0xD7AF), ("Han", 0x20000, 0x2FA1F),
]
NAMES = sorted({name for name, _, _ in SCRIPTS}) + ["other"]
_STARTS = np.array([start for _, start, _ in sorted(SCRIPTS, key=lambda s: s[1])])
_SORTED = sorted(SCRIPTS, key=lambda s: s[1])
NOT_LETTERS = regex.compile(r"[^\p{L}\p{M} ]+")
NO_EVIDENCE = -1e4
#: code points to an integer of three
STEP = 21
_NUMBERS = np.array([NAMES.index(name) for name, _, _ in _SORTED])
_ENDS = np.array([end for _, _, end in _SORTED])


def scripts_of(codes: np.ndarray) -> np.ndarray:
    """Position in ``NAMES`` of the script of each letter."""
    at = np.searchsorted(_STARTS, codes, side="right") - 1
    inside = (at >= 0) & (codes <= _ENDS[np.maximum(at, 0)])
    return np.where(inside, _NUMBERS[np.maximum(at, 0)], NAMES.index("other"))


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every letter of the words, in order: the word's number, the letter, and the trigram
    around it (a space standing beside first and last letters)."""
    line = NOT_LETTERS.sub("", f" {' '.join(words)} ".lower())
    codes = np.frombuffer(line.encode("utf-32-le"), "u4").astype("i8")
    blank = codes == 32
    at = np.flatnonzero(~blank)
    return np.cumsum(blank)[at] - 1, codes[at], (codes[at - 1] << 2 * STEP) | (codes[at] << STEP) | codes[at + 1]


def _training_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(lang, gram, n): trigrams, and single letters by their code."""
    for batch in batches:
        for lang, texts in batch.groupby("lang")["text"]:
            found = []
            for text in texts:
                _, letters, grams = trigrams(text.split())
                found += [np.unique(letters, return_counts=True), np.unique(grams, return_counts=True)]
            grams, place = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
            counts = np.bincount(place, np.concatenate([n for _, n in found]), len(grams)).astype("i8")
            yield pd.DataFrame({"lang": lang, "gram": grams, "n": counts})


class Model:
    """What the tasks need: languages, trigrams in order, their scores in each language, the
    score of other trigrams, and the scripts of each language."""

    def __init__(self, langs: list[str], grams: np.ndarray, scores: np.ndarray, unseen: np.ndarray, scripts: np.ndarray):
        self.langs, self.grams, self.scores, self.unseen, self.scripts = langs, grams, scores, unseen, scripts
        self.name = uuid.uuid4().hex


def fit_languages(
    labelled: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, max_languages: int = MAX_LANGUAGES, max_grams: int = MAX_GRAMS
) -> Model:
    """From rows of (doc_id, text, lang); see the bounds above."""
    usable = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()
    if not sizes:
        return Model([], np.zeros(0, "i8"), np.zeros((0, 0), "f4"), np.zeros(0, "f4"), np.zeros((0, len(NAMES)), bool))
    rates = F.create_map(*[F.lit(x) for row in sizes for x in (row["lang"], min(1.0, rows_per_language / row["count"]))])
    uniform = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = usable.where(uniform < F.coalesce(F.try_element_at(rates, F.col("lang")), F.lit(0.0)))
    counts = stored(
        chosen.select("lang", "text")
        .mapInPandas(_training_grams, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    single = F.col("gram") < 1 << STEP
    frequent = counts.where(~single).groupBy("gram").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "gram").limit(max_grams)
    triples = counts.where(~single).join(frequent.select("gram"), "gram").toPandas()
    letters = counts.where(single).toPandas()
    langs = sorted({r["lang"] for r in sizes} & set(triples["lang"]))
    place = {lang: i for i, lang in enumerate(langs)}
    grams = np.unique(triples["gram"].to_numpy("i8"))
    table = np.zeros((len(grams), len(langs)))
    table[np.searchsorted(grams, triples["gram"].to_numpy("i8")), triples["lang"].map(place).to_numpy(int)] = triples["n"]
    total = table.sum(0) + SMOOTHING * (len(grams) + 1)
    scripts = np.zeros((len(langs), len(NAMES)))
    letters = letters[letters["lang"].isin(place)]
    np.add.at(scripts, (letters["lang"].map(place).to_numpy(int), scripts_of(letters["gram"].to_numpy("i8"))), letters["n"].to_numpy())
    scripts /= np.maximum(scripts.sum(1, keepdims=True), 1)
    return Model(
        langs, grams, np.log((table + SMOOTHING) / total).astype("f4"), np.log(SMOOTHING / total).astype("f4"), scripts >= SCRIPT_SHARE
    )


class Words(dict):
    """Row of each word in a growing matrix of scores."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.scores = np.zeros((0, len(self.model.langs)), "f4")
        self.letters = np.zeros(0, "i4")

    def learn(self, words: list[str]) -> None:
        """Scores of words not yet met. The best candidate has 0; languages that are not written
        in the word's script are no candidates; a word without candidates is no evidence."""
        model = self.model
        self.update(zip(words, range(len(self), len(self) + len(words))))
        owner, letters, grams = trigrams(words)
        at = np.minimum(np.searchsorted(model.grams, grams), len(model.grams) - 1)
        each = np.where((model.grams[at] == grams)[:, None], model.scores[at], model.unseen)
        count = np.bincount(owner, minlength=len(words)).astype("i4")
        scores = np.stack([np.bincount(owner, column, len(words)) for column in each.T], 1)
        some = np.flatnonzero(count)
        first = (np.cumsum(count) - count)[some]
        candidates = np.zeros(scores.shape, bool)
        candidates[some] = model.scripts[:, scripts_of(letters[first])].T
        top = np.where(candidates, scores, -np.inf).max(1, keepdims=True)
        with np.errstate(invalid="ignore"):
            scores = np.where(candidates, scores - top, NO_EVIDENCE)
        scores[~candidates.any(1)] = 0
        self.scores = np.concatenate([self.scores, scores.astype("f4")])
        self.letters = np.concatenate([self.letters, count])


def best_paths(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray, scores: np.ndarray, switch: float) -> np.ndarray:
    """The language of every word: texts are runs of ``ids``, all stepped through together."""
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    langs = scores.shape[1]
    own = np.arange(langs, dtype="i2")
    active = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), side="left")
    came = np.zeros((len(ids), langs), "i2" if langs > 127 else "i1")
    value = np.zeros((len(lengths), langs))
    for step, n in enumerate(active):
        at = starts[:n] + step
        now = value[:n]
        if step:
            top = now.argmax(1)
            leave = now[np.arange(n), top][:, None] - switch
            stay = now >= leave
            came[at] = np.where(stay, own, top[:, None])
            now = np.where(stay, now, leave)
        value[:n] = now + scores[ids[at]]
    path = np.zeros(len(ids), "i4")
    last = value.argmax(1) if len(lengths) else np.zeros(0, int)
    for step in range(len(active) - 1, -1, -1):
        n = active[step]
        at = starts[:n] + step
        path[at] = last[:n]
        if step:
            last[:n] = came[at, last[:n]]
    return path


def settled(each: np.ndarray, starts: np.ndarray, owner: np.ndarray, switch: float) -> tuple[np.ndarray, np.ndarray]:
    """The best single language of every text, and whether no switch can better it.

    A path with m stretches in other languages than the best has at least m switches, or m - 1
    if it never is in the best and m is two or more (one stretch alone is a single language,
    which is no better). So it can be better only if some language leads by more than half the
    penalty over a stretch, as m stretches of at most that add up to no more than m - 1
    penalties; all other texts stay in one language. ``each``: scores of all words, text by text.
    """
    best = np.add.reduceat(each, starts, 0).argmax(1)
    own = each[np.arange(len(each)), best[owner]]
    fixed = np.ones(len(starts), bool)
    for lang in range(each.shape[1]):
        lead = np.clip(each[:, lang] - own, -switch / 2, None)  # a loss of the limit ends a stretch
        running = np.concatenate([[0.0], np.cumsum(lead, dtype="f8")])
        apart = (2 * np.abs(running).max() + 1) * owner  # sums of each text lie below those before
        before = np.minimum.accumulate(running[:-1] - apart)
        fixed &= np.maximum.reduceat(running[1:] - apart - before, starts) <= switch / 2
    return best, fixed


_words: dict[str, Words] = {}


def _label(texts: list[str | None], words: Words, switch: float) -> list[tuple[str, float, list[dict]]]:
    langs = words.model.langs
    out: list[tuple[str, float, list[dict]]] = [("und", 0.0, [])] * len(texts)
    if not langs:
        return out
    todo: list[tuple[int, np.ndarray]] = []
    size = 0

    def run() -> None:
        lengths = np.array([len(i) for _, i in todo])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(int)
        ids = np.concatenate([i for _, i in todo])
        owner = np.repeat(np.arange(len(todo)), lengths)
        best, fixed = settled(words.scores[ids], starts, owner, switch)
        path = best[owner].astype("i4")
        if not fixed.all():
            open_words = ~fixed[owner]
            own = lengths[~fixed]
            path[open_words] = best_paths(ids[open_words], np.cumsum(own) - own, own, words.scores, switch)
        letters = words.letters[ids]
        mass = np.bincount(owner * len(langs) + path, weights=letters, minlength=len(todo) * len(langs)).reshape(len(todo), -1)
        turns = np.flatnonzero((path[1:] != path[:-1]) | (owner[1:] != owner[:-1])) + 1
        begins = np.concatenate([[0], turns])
        ends = np.concatenate([turns, [len(ids)]])
        spans: dict[int, list[dict]] = {}
        for b, e in zip(begins.tolist(), ends.tolist()):
            k = int(owner[b])
            spans.setdefault(k, []).append({"first": b - int(starts[k]), "stop": e - int(starts[k]), "lang": langs[path[b]]})
        for k, (row, _) in enumerate(todo):
            total = mass[k].sum()
            if total > 0:
                top = int(mass[k].argmax())
                out[row] = (langs[top], float(mass[k, top] / total), spans[k])
        todo.clear()

    part: list[tuple[int, list[str]]] = []
    waiting = 0

    def take() -> None:
        """The words of the texts read so far become rows of the matrix."""
        words.learn([w for w in set(chain.from_iterable(p for _, p in part)) if w not in words])
        todo.extend((row, np.fromiter(map(words.__getitem__, p), "i4", len(p))) for row, p in part)
        part.clear()

    for row, text in enumerate(texts):
        found = text.split() if text is not None else []
        if not found:
            continue
        part.append((row, found))
        waiting += len(found)
        size += len(found) * len(langs)
        if waiting >= WAITING:
            take()
            waiting = 0
        if size >= AT_ONCE:
            take()
            run()
            size = waiting = 0
            if len(words) > REMEMBERED:
                words.forget()
    if part:
        take()
    if todo:
        run()
    if len(words) > REMEMBERED:
        words.forget()
    return out


def label_languages(docs: DataFrame, model: Model, switch: float = SWITCH, text: str = "text", name: str = "language") -> DataFrame:
    """``docs`` with a struct column ``name``: ``lang``, ``score`` (the language's share of
    the letters) and ``spans`` (first word, stop, language)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, spans array<struct<first:int,stop:int,lang:string>>")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        key = shared.value.name
        if key not in _words:
            _words.clear()
            _words[key] = Words(shared.value)
        for texts in batches:
            yield pd.DataFrame(_label(texts.tolist(), _words[key], switch), columns=["lang", "score", "spans"])

    return docs.withColumn(name, label(F.col(text).cast("string")))


def language_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: learns where the id's remainder by 4 is not 2."""
    fold = remainder(4)
    model = fit_languages(docs.where((fold != 2) & (fold >= 0)).select("doc_id", "text", "lang"))
    labelled = label_languages(docs.select("doc_id", "text"), model)
    return labelled.select(
        "doc_id", (fold == 2).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"),
        F.col("language.spans").alias("spans"),
    )


def keep_languages(docs: DataFrame, least: float = 0.5, model: Model | None = None) -> DataFrame:
    """The documents whose text has a language that holds at least ``least`` of its letters."""
    if model is None:
        fold = remainder(4)
        model = fit_languages(docs.where((fold != 2) & (fold >= 0)).select("doc_id", "text", "lang"))
    labelled = label_languages(docs, model, name="_tw_language")
    return labelled.where((F.col("_tw_language.lang") != "und") & (F.col("_tw_language.score") >= least)).select(*docs.columns)
