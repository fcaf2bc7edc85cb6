"""Toxicity scores: gradient-boosted trees over dense features, calibrated isotonically.

Features of a whole text: densities of lexicon words, of them near a second-person word,
of capitals, punctuation and obfuscated spellings (rates per word or letter). The lexicon
is a short fixed list plus units learnt from the training labels: words and word beginnings
whose presence goes with the label by a likelihood-ratio test.

Training uses at most SAMPLE labelled rows (least hashes of doc_id; of the texts of one doc_id that of the least
hash; distinct texts).
Lexicon and trees are cross-fitted: each half's features come from the other half's
lexicon, and the calibration sees only scores of trees that were grown on the other half.

Only the text enters a score. Nulls and edges: a null or empty text has zero features and
is scored like any other; labels that are null or repeat a doc_id with another value are
left out of training; without labels of both kinds every score is the share of label 1 (0
without labels); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .boosting import Boosted, isotonic
from .bpe import HashIndex
from .common import LOWER, WS, arrow_map, buffers, materialize, quoted, range_hash, ranges, slices, text_array, word_spans

#: Labelled rows that the classifier is fitted on, at most.
SAMPLE = 16_000
THRESHOLD = 0.3
#: Units of the learnt lexicon at most, the likelihood ratio (nats) that each must reach, and texts of label 1 that must hold it.
LEARNT, RATIO, SUPPORT = 3000, 12.0, 4
#: Bytes of a word's beginning that are units too.
BEGINNINGS = (4, 5, 6)
#: Words on either side within which a second-person word counts as near.
NEAR = 5
#: Common English insults, and second-person words of the corpus's languages.
INSULTS = "idiot idiots stupid moron morons dumb loser losers pathetic worthless scum trash garbage clown disgusting fool fools ugly jerk creep bastard dirtbag imbecile vermin filth".split()
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch sie tu te toi ton ta vous votre vos tú ti tus usted ustedes vosotros".split()
#: Digits and signs that stand for letters.
LOOKALIKE = dict(zip("013457@$!", "oieastasi", strict=True))
FEATURES = (
    "fixed", "learnt", "hits", "kinds", "strongest", "weight", "near", "second", "capital", "shouted", "marks", "punctuation", "repeated", "odd", "hidden", "length",
)

_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LETTER = _ALNUM.copy()
_LETTER[48:58] = False
_LEET = LOWER.copy()
for _a, _b in LOOKALIKE.items():
    _LEET[ord(_a)] = ord(_b)


def _hash_words(words: list[str]) -> np.ndarray:
    buf, offs = buffers(text_array(pa.array(words)))
    return range_hash(buf, offs[:-1], offs[1:])


def _mix_unit(h: np.ndarray, kind: int) -> np.ndarray:
    return h ^ np.uint64(kind * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)


class Units:
    """The words of some texts without outer punctuation, and the hashes of their units."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        self.buf = buf
        starts, ends, self.wo = word_spans(buf, offs)
        solid = np.append(np.flatnonzero(_ALNUM[buf]), len(buf))
        a = solid[np.searchsorted(solid, starts)]
        last = np.searchsorted(solid, ends) - 1
        b = np.where(last >= 0, solid[np.maximum(last, 0)] + 1, 0)
        self.empty = a >= ends
        self.a, self.b = np.where(self.empty, starts, a), np.where(self.empty, starts, b)
        self.starts, self.ends = starts, ends
        self.low = LOWER[buf]
        self.text = np.repeat(np.arange(len(self.wo) - 1), np.diff(self.wo))
        self.word = range_hash(self.low, self.a, self.b)

    def all(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(word positions, unit hashes) of each kind."""
        some = np.flatnonzero(~self.empty)
        yield some, self.word[some]
        for k in BEGINNINGS:
            long = np.flatnonzero(self.b - self.a > k)
            yield long, _mix_unit(range_hash(self.low, self.a[long], self.a[long] + k), k)


def _unit_counts(rows: DataFrame) -> DataFrame:
    """unit, fold, label, n: texts that hold each unit."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf_all, offs_all = buffers(text_array(batch.column("text")))
            side = batch.column("fold").to_numpy(zero_copy_only=False) * 2 + batch.column("label").to_numpy(zero_copy_only=False)
            for i, j in slices(offs_all):
                u = Units(buf_all[offs_all[i] : offs_all[j]], offs_all[i : j + 1] - offs_all[i])
                parts = [(h, u.text[at]) for at, h in u.all()]
                h, text = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                order = np.lexsort((text, h))
                h, text = h[order], text[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
                h, s = h[new], side[i:j][text[new]]
                order = np.lexsort((s, h))
                h, s = h[order], s[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (s[1:] != s[:-1])
                at = np.flatnonzero(new)
                yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(s[at].astype(np.int32)), pa.array(np.diff(np.append(at, len(h))))], ["unit", "side", "n"])

    return arrow_map(rows, step, "unit long, side int, n long").groupBy("unit").agg(*[F.sum(F.when(F.col("side") == s, F.col("n")).otherwise(0)).alias(f"n{s}") for s in range(4)])


def _lexicon(units: np.ndarray, n1: np.ndarray, n0: np.ndarray, t1: int, t0: int) -> tuple[np.ndarray, np.ndarray]:
    """(units, log odds) of those that speak for label 1."""
    if not t1 or not t0:
        return np.zeros(0, np.uint64), np.zeros(0)
    def part(k, n, share):
        return np.where(k > 0, k * np.log(np.maximum(k, 1e-9) / np.maximum(n * share, 1e-9)), 0.0)
    n = n1 + n0
    share = t1 / (t1 + t0)
    ratio = part(n1, n, share) + part(n0, n, 1 - share)
    odds = np.log((n1 + 0.5) / (t1 + 1)) - np.log((n0 + 0.5) / (t0 + 1))
    keep = np.flatnonzero((ratio >= RATIO) & (odds > 1.5) & (n1 >= SUPPORT))
    keep = keep[np.lexsort((units[keep], -ratio[keep]))][:LEARNT]
    return units[keep], odds[keep]


class Featurizer:
    def __init__(self, units: np.ndarray, odds: np.ndarray):
        self.index, self.odds = HashIndex(units.astype(np.uint64)), odds
        self.fixed, self.second = HashIndex(np.unique(_hash_words(INSULTS))), HashIndex(np.unique(_hash_words(SECOND_PERSON)))

    def features(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        u, m = Units(buf, offs), len(offs) - 1
        per = lambda flag: np.bincount(u.text[flag], minlength=m).astype(float)
        words = np.maximum(np.diff(u.wo), 1).astype(float)
        weight, kinds_text, kinds_unit = np.zeros(len(u.word)), [], []
        for at, h in u.all():
            f = self.index.find(h)
            hit = f >= 0
            if hit.any():
                w = at[hit]
                weight[w] = np.maximum(weight[w], self.odds[f[hit]])
                kinds_text.append(u.text[w])
                kinds_unit.append(f[hit])
        fixed = self.fixed.find(u.word) >= 0
        second = (self.second.find(u.word) >= 0) & ~u.empty
        # spellings with signs or digits inside: letters alone, with look-alikes read as letters
        letters = np.concatenate([[0], np.cumsum(_LETTER[buf])])
        inside = letters[u.b] - letters[u.a]
        odd = (inside > 0) & (inside < u.b - u.a)
        hidden = np.zeros(len(u.word), bool)
        rows = np.flatnonzero(odd)
        if len(rows):
            size = u.b[rows] - u.a[rows]
            data = _LEET[buf[ranges(u.a[rows], size)]]
            keep = _LETTER[data]
            cut = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], np.cumsum(size)])]
            h = range_hash(data[keep], cut[:-1], cut[1:])
            hidden[rows] = (self.fixed.find(h) >= 0) | (self.index.find(h) >= 0)
        bad = (weight > 0) | fixed | hidden
        near = np.zeros(len(bad), bool)
        for k in range(1, NEAR + 1):
            ok = u.text[k:] == u.text[:-k]
            near[k:] |= bad[k:] & second[:-k] & ok
            near[:-k] |= bad[:-k] & second[k:] & ok
        strongest = np.zeros(m)
        np.maximum.at(strongest, u.text, weight)
        kinds = np.zeros(m)
        if kinds_text:
            pairs = np.unique(np.stack([np.concatenate(kinds_text), np.concatenate(kinds_unit)]), axis=1)
            kinds = np.bincount(pairs[0], minlength=m).astype(float)
        span = lambda flag: np.diff(np.concatenate([[0], np.cumsum(flag)])[offs]).astype(float)
        upper = (buf >= 65) & (buf <= 90)
        caps = np.concatenate([[0], np.cumsum(upper)])
        shouted = (caps[u.b] - caps[u.a] == u.b - u.a) & (u.b - u.a > 1)
        n_letters, n_bytes = np.maximum(span(_LETTER[buf]), 1), np.maximum(np.diff(offs), 1).astype(float)
        marks, punct = (buf == 33) | (buf == 63), ~_ALNUM[buf] & ~WS[buf]
        twice = np.zeros(len(buf), bool)
        twice[1:] = punct[1:] & (buf[1:] == buf[:-1])
        twice[offs[:-1][offs[:-1] < len(buf)]] = False  # the byte before is another text's
        return np.stack(
            [
                per(fixed) / words, per(weight > 0) / words, np.log1p(per(bad)), kinds, strongest, np.bincount(u.text, weight, m) / words, per(near) / words, per(second) / words,
                span(upper) / n_letters, per(shouted) / words, span(marks) / n_bytes, span(punct) / n_bytes, span(twice) / n_bytes, per(odd) / words, per(hidden) / words, np.log1p(words),
            ],
            1,
        )


def _table(rows: DataFrame, shared) -> DataFrame:
    """fold, label, features (cross-fitted) of the training rows."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = [Featurizer(*x) for x in shared.value]
        for batch in batches:
            buf_all, offs_all = buffers(text_array(batch.column("text")))
            fold = batch.column("fold").to_numpy(zero_copy_only=False)
            for i, j in slices(offs_all):
                buf, offs = buf_all[offs_all[i] : offs_all[j]], offs_all[i : j + 1] - offs_all[i]
                both = [t.features(buf, offs) for t in tools]
                x = np.where(fold[i:j, None] == 0, both[1], both[0])
                out = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column("fold").slice(i, j - i), batch.column("label").slice(i, j - i), out], ["fold", "label", "x"])

    return arrow_map(rows, step, "fold int, label int, x array<double>")


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> dict:
    """The model: lexicon, trees and calibration, fitted on at most `sample` labelled rows.

    docs: doc_id, text; labels: doc_id and the label, already restricted to rows that may be learnt from.
    """
    spark = docs.sparkSession
    clean = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("most")).where("label = most")
    chosen = materialize(clean.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tk")).join(F.broadcast(chosen), "doc_id")
    # a doc_id may stand in any number of rows: the text of the least hash is its one, so at most `sample` rows stay
    rows = rows.groupBy("doc_id", "label").agg(F.min_by("text", "tk").alias("text"), F.min("tk").alias("tk"))
    rows = materialize(rows.select("text", "label", F.pmod("tk", F.lit(2)).cast("int").alias("fold"), "tk").dropDuplicates(["tk", "label"]).drop("tk"))
    sides = {(r["fold"], r["label"]): r["count"] for r in rows.groupBy("fold", "label").count().collect()}
    t = np.array([sides.get((f, y), 0) for f in (0, 1) for y in (0, 1)])
    share = (t[1] + t[3]) / max(t.sum(), 1)
    if not (t[0] + t[2]) or not (t[1] + t[3]):
        return {"prior": float(share)}
    # units that too few texts of label 1 hold can't be learnt; of label-1 texts there are at most `sample`
    table = _unit_counts(rows).where(F.col("n1") + F.col("n3") >= SUPPORT).where((F.col("n1") + F.col("n3")) * int(t[0] + t[2]) > (F.col("n0") + F.col("n2")) * int(t[1] + t[3])).toArrow()
    unit = table["unit"].to_numpy().view(np.uint64)
    n = [table[f"n{s}"].to_numpy().astype(float) for s in range(4)]
    lexicons = [_lexicon(unit, n[1], n[0], t[1], t[0]), _lexicon(unit, n[3], n[2], t[3], t[2])]
    whole = _lexicon(unit, n[1] + n[3], n[0] + n[2], t[1] + t[3], t[0] + t[2])
    got = _table(rows, spark.sparkContext.broadcast(lexicons)).toArrow()  # at most `sample` rows of 16 numbers
    x = np.asarray(got["x"].combine_chunks().flatten()).reshape(-1, len(FEATURES))
    y, fold = got["label"].to_numpy().astype(float), got["fold"].to_numpy()
    order = np.lexsort((*x.T, y, fold))  # the rows come in any order; the model must not depend on it
    x, y, fold = x[order], y[order], fold[order]
    model = Boosted().fit(x, y)
    fair = np.full(len(y), model.start)
    for f in (0, 1):
        if 0 < y[fold != f].sum() < (fold != f).sum():
            fair[fold == f] = Boosted().fit(x[fold != f], y[fold != f]).raw(x[fold == f])
    return {"lexicon": whole, "model": model, "calibration": isotonic(fair, y), "prior": float(share)}


def score(docs: DataFrame, model: dict, keep: list[str] | None = None, threshold: float = THRESHOLD, out: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """docs' columns `keep` with the score and the prediction, named by `out`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = keep or ["doc_id"]
    held = [f"c{k}" for k in range(len(keep))]  # whatever signs the names have

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        tool = Featurizer(*model["lexicon"]) if "model" in model else None
        for batch in batches:
            buf_all, offs_all = buffers(text_array(batch.column("text")))
            for i, j in slices(offs_all):
                if tool is None:
                    p = np.full(j - i, model["prior"])
                else:
                    raw = model["model"].raw(tool.features(buf_all[offs_all[i] : offs_all[j]], offs_all[i : j + 1] - offs_all[i]))
                    # the fit is a step function; a thousandth of the raw probability keeps the order within a step
                    p = 0.999 * np.interp(raw, *model["calibration"]) + 0.001 / (1 + np.exp(-raw))
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(i, j - i) for c in held], pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*held, "score", "predicted"])

    rows = docs.select(*[F.col(quoted(c)).alias(h) for c, h in zip(keep, held, strict=True)], "text")
    fields = [*rows.schema.fields[:-1], StructField("score", DoubleType()), StructField("predicted", IntegerType())]
    return arrow_map(rows, step, StructType(fields)).toDF(*keep, *out)


def learnable(labels: DataFrame, parts: int = 4, part: int = 2) -> DataFrame:
    return labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts != part)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = train(docs, learnable(labels))
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")
