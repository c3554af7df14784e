"""2. Language identification of whole texts, with spans of mixed-language text.

A model holds, per language, the frequencies of character trigrams within words and the scripts that the language is
written in. It is fitted on a bounded sample of labelled rows. A word's script narrows the candidate languages; its
trigrams score them; Viterbi over the words of a text, with a penalty for each switch, labels spans. The language that
covers most letters is the text's, and its share of the letters is the score. Letters in a script of no language speak
for none, but count among those that the share is of.

A null text or one without letters in a script of some language gives `und`, score 0 and no spans. Empty tables give empty
results; without any labelled row every text is `und`. Ties go to the language that sorts first. Rows with the same id or
text stay separate rows, a null id stays null, and columns other than id, text and label are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, free_name

#: Labelled rows that the model is fitted on, for each language: all of them, or about this many by a hash of the id.
ROWS_PER_LANGUAGE = 1500
#: A language is a candidate for a script that holds at least this share of its letters.
SCRIPT_SHARE = 0.01
#: What a switch of language between two words costs, in nats.
SWITCH = 8.0
#: Bytes that a worker spends on words whose scores it remembers (the memory starts anew when full), those that an entry
#: takes beside its letters and scores, and words that are scored at once.
REMEMBERED_BYTES, _WORD_BYTES, _SCORED = 24 << 20, 160, 20_000
#: Bytes of text that are judged at once.
CHUNK_BYTES = 2 << 20
UND = "und"

# The first and last code points of blocks of the scripts.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF)],
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
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x9FFF)],
    "hangul": [(0xAC00, 0xD7AF)],
}
_WORD = regex.compile(r"\p{L}+")


def script_of(word: str) -> str:
    c = ord(word[0])
    if c < 0x250:
        return "latin"
    return next((name for name, ranges in SCRIPTS.items() if any(a <= c <= b for a, b in ranges)), "other")


def words_of(text: str) -> list[str]:
    """The words of a text, each lower-cased by itself: lower-casing a whole text can change where its words end."""
    return _WORD.findall(text.lower()) if text.isascii() else [w.lower() for w in _WORD.findall(text)]


def trigrams(word: str) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + 3] for i in range(len(w) - 2)]


def _count(batches):
    """Trigram and script counts of labelled texts, summed over each batch."""
    for batch, texts in chunks(batches, "text", 8 << 20, 4096):
        words: dict[tuple[str, str], int] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), texts, strict=True):
            for w in words_of(text):
                words[lang, w] = words.get((lang, w), 0) + 1
        seen: dict[tuple[str, str, str], int] = {}
        for (lang, w), n in words.items():
            for g in trigrams(w):
                seen[lang, "g", g] = seen.get((lang, "g", g), 0) + n
            s = script_of(w)
            seen[lang, "s", s] = seen.get((lang, "s", s), 0) + n * len(w)
        keys = list(seen)
        yield pa.RecordBatch.from_pydict({"lang": [k[0] for k in keys], "kind": [k[1] for k in keys], "item": [k[2] for k in keys], "n": pa.array([seen[k] for k in keys], pa.int64())}, schema=pa.schema([("lang", pa.string()), ("kind", pa.string()), ("item", pa.string()), ("n", pa.int64())]))


class Model:
    """Log probabilities of trigrams by language, and the candidate languages of each script."""

    def __init__(self, rows: list[tuple[str, str, str, int]]):
        self.langs = sorted({r[0] for r in rows})
        at = {x: i for i, x in enumerate(self.langs)}
        grams = sorted({r[2] for r in rows if r[1] == "g"})
        self.index = {g: i for i, g in enumerate(grams)}
        counts = np.zeros((len(grams) + 1, len(self.langs)))
        letters: dict[str, np.ndarray] = {}
        for lang, kind, item, n in rows:
            if kind == "g":
                counts[self.index[item], at[lang]] += n
            else:
                letters.setdefault(item, np.zeros(len(self.langs)))[at[lang]] += n
        self.scores = np.log((counts + 0.5) / (counts.sum(0) + 0.5 * len(counts))).astype(np.float32)  # the last row is for unknown trigrams
        total = sum(letters.values()) if letters else np.zeros(len(self.langs))
        self.barred = {s: np.where(n >= SCRIPT_SHARE * np.maximum(total, 1), np.float32(0), np.float32(-1e6)) for s, n in letters.items()}

    def score(self, words: list[str]) -> np.ndarray:
        """Scores of the words by language. A word in a script of no language scores 0 for all."""
        unknown, index = len(self.index), self.index
        found = [[index.get(g, unknown) for g in trigrams(w)] for w in words]
        starts = [0, *accumulate(map(len, found))][:-1]
        out = np.add.reduceat(self.scores[np.fromiter((i for f in found for i in f), np.int64)], starts)
        for i, w in enumerate(words):
            barred = self.barred.get(s := script_of(w))
            if barred is None or barred.all():
                out[i] = 0
            elif s != "latin" or barred.any():
                out[i] += barred
        return out


def fit(labelled: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> Model:
    """A model from labelled rows (doc_id, text, lang): all trigrams of about rows_per_language rows of each language. What reaches the driver is bounded by the sample and the number of languages."""
    labelled = labelled.where("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([])
    share = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(0))), F.lit(1 << 30)) / float(1 << 30)
    limit = F.create_map(*[x for k, n in sorted(sizes.items()) for x in (F.lit(k), F.lit(min(1.0, rows_per_language / n)))])
    sample = labelled.where(share < limit[F.col("lang")]).select("text", "lang")
    counted = sample.mapInArrow(_count, "lang string, kind string, item string, n bigint").groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))
    return Model(sorted(tuple(r) for r in counted.collect()))  # all trigrams of a bounded sample


def viterbi(scores: list[np.ndarray], switch: float) -> list[np.ndarray]:
    """The best labels of each row of scores, for many texts at once: step t handles the t-th word of every text that has one."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    lengths = np.array([len(scores[i]) for i in order])
    longest = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(1, longest + 1), side="right")
    offsets = np.concatenate([[0], np.cumsum(active)])
    langs = scores[0].shape[1] if scores else 1
    packed = np.empty((offsets[-1], langs), np.float32)
    for k, i in enumerate(order):
        packed[offsets[: lengths[k]] + k] = scores[i]
    kind = np.min_scalar_type(langs)  # of labels: as small as their number allows
    back = np.empty((offsets[-1], langs), kind)
    own = np.arange(langs, dtype=kind)
    last = np.zeros(len(order), kind)
    best = np.zeros((len(order), langs), np.float64)
    for t in range(longest):
        k, at = active[t], offsets[t]
        if t:
            if k < active[t - 1]:
                last[k : active[t - 1]] = best[k : active[t - 1]].argmax(1)
            b = best[:k]
            top = b.argmax(1)
            high = b[np.arange(k), top] - switch
            stay = b >= high[:, None]
            back[at : at + k] = np.where(stay, own, top[:, None])
            best[:k] = np.where(stay, b, high[:, None]) + packed[at : at + k]
        else:
            best[:k] += packed[at : at + k]
    if longest:
        last[: active[-1]] = best[: active[-1]].argmax(1)
    path = np.empty(offsets[-1], kind)
    for t in range(longest - 1, -1, -1):
        k, at = active[t], offsets[t]
        path[at : at + k] = last[:k]
        if t:
            last[:k] = back[at : at + k][np.arange(k), last[:k]]
    out: list[np.ndarray] = [np.zeros(0, kind)] * len(scores)
    for k, i in enumerate(order):
        out[i] = path[offsets[: lengths[k]] + k]
    return out


def _slices(column: pa.Array, max_bytes: int, max_rows: int) -> Iterator[list[str | None]]:
    """The texts of a column in runs of about max_bytes (one longer text stands alone)."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and (total + n > max_bytes or i - start >= max_rows):
            yield column.slice(start, i - start).to_pylist()
            start, total = i, 0
        total += n
    if start < len(column):
        yield column.slice(start).to_pylist()


class _Judge:
    """Languages of texts by a model; remembers the scores of words, up to REMEMBERED_BYTES of them."""

    def __init__(self, model: Model, switch: float):
        self.model, self.switch = model, switch
        self.known: dict[str, int] = {}
        self.table = np.zeros((0, max(1, len(model.langs))), np.float32)
        self.bytes = 0

    def learn(self, found: list[list[str]]) -> None:
        if self.bytes > REMEMBERED_BYTES:
            self.known.clear()
            self.table, self.bytes = self.table[:0], 0
        known = self.known
        new = list(dict.fromkeys(w for words in found for w in words if w not in known))
        for i in range(0, len(new), _SCORED):
            names = new[i : i + _SCORED]
            known.update(zip(names, range(len(self.table), len(self.table) + len(names)), strict=True))
            self.table = np.concatenate([self.table, self.model.score(names)])
        self.bytes += sum(map(len, new)) + len(new) * (_WORD_BYTES + 4 * self.table.shape[1])

    def judged(self, texts: list[str | None], with_spans: bool) -> list[tuple]:
        """(language, share of letters, spans) of each text."""
        langs = self.model.langs
        if not langs:
            return [(UND, 0.0, [])] * len(texts)
        found = [words_of(x) if x else [] for x in texts]
        self.learn(found)
        at = self.known.__getitem__
        scores = [self.table[np.fromiter(map(at, words), np.int64, len(words))] for words in found]
        out = []
        for words, scored, path, text in zip(found, scores, viterbi(scores, self.switch), texts, strict=True):
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            letters = np.bincount(path, sizes * (scored[:, 0] != 0), len(langs))  # log probabilities are below 0
            if letters.any():
                top = int(letters.argmax())
                out.append((langs[top], float(letters[top] / sizes.sum()), _spans(text, path, langs) if with_spans else None))
            else:
                out.append((UND, 0.0, []))
        return out


def judge(model: Model, switch: float = SWITCH, with_spans: bool = True):
    """A function of a text column that gives a struct of lang_pred, score and, with_spans, spans. Only texts go to Python and only verdicts come back."""
    fields = [("lang_pred", pa.string()), ("score", pa.float64())]
    fields += [("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])))] * with_spans
    kind = pa.struct(fields)

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = _Judge(model, switch)
        for column in columns:
            verdicts = [v for texts in _slices(column, CHUNK_BYTES, 4096) for v in own.judged(texts, with_spans)]
            yield pa.StructArray.from_arrays([pa.array([v[i] for v in verdicts], t) for i, (_, t) in enumerate(fields)], fields=list(kind))

    returned = "struct<lang_pred:string,score:double" + ",spans:array<struct<start:bigint,end:bigint,lang:string>>" * with_spans + ">"
    return F.arrow_udf(run, returned).asNondeterministic()  # asked once for each row, whatever stands on top


def _spans(text: str, path: np.ndarray, langs: list[str]) -> list[dict]:
    at = [m.span() for m in _WORD.finditer(text)]
    cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
    return [{"start": at[a][0], "end": at[b - 1][1], "lang": langs[path[a]]} for a, b in zip(cuts, cuts[1:], strict=False)]


def language_id(docs: DataFrame, model: Model, switch: float = SWITCH, with_spans: bool = True, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns named in keep, lang_pred, score and spans (code points, end exclusive) of every row of docs, judged by its text."""
    found = free_name(docs, "found")
    rows = docs.withColumn(found, judge(model, switch, with_spans)(F.col("text").cast("string")))
    return rows.select(*keep, F.col(f"{found}.*"))


def held_out() -> Column:
    """Whether a row is kept from fitting: crc32 of its id as text leaves 2 modulo 4 (a null id: as an empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def op2_language_id(spark, sf_dir):
    from .common import table

    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()).select("doc_id", "text", "lang"))
    found = language_id(docs, model)
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["lang"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", spans.alias("spans"))
