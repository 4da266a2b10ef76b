"""Hierarchical language identification: family first, then one-versus-one linear SVMs inside it."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from residua.llm import words as W
from residua.ship import map_arrow

UNKNOWN = "und"
TRIGRAMS, BIGRAMS = 2048, 512
#: Labelled rows of each language that the classifier is fitted on, and of all languages together, about; the only bounds on what is learned from.
SAMPLE_PER_LANGUAGE, SAMPLE_ROWS = 400, 20_000
_ROWS = 256


def features(texts: pa.Array) -> Iterator[np.ndarray]:
    """Rows of hashed byte bigram and trigram counts of whole texts, square-rooted and of unit length.

    Case is folded; digits and punctuation are blanks, so that only letters and where words begin and end count."""
    for lo in range(0, len(texts), _ROWS):
        for _, _, buf, offsets in W.pieces(texts.slice(lo, _ROWS)):
            n = len(offsets) - 1
            out = np.zeros((n, TRIGRAMS + BIGRAMS), np.float32)
            if len(buf) > 2:
                low = W.lower_latin(buf)
                letter = ((low >= 97) & (low <= 122)) | (low >= 128)
                x = np.where(letter, low, 32).astype(np.uint32)
                doc = np.repeat(np.arange(n), np.diff(offsets))
                for width, size, at in ((3, TRIGRAMS, 0), (2, BIGRAMS, TRIGRAMS)):
                    m = len(x) - width + 1
                    h = np.zeros(m, np.uint32)
                    for i in range(width):
                        h = h * np.uint32(0x01000193) + x[i : i + m]
                    h = (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - (size - 1).bit_length())
                    own = doc[:m] == doc[width - 1 :]
                    own &= letter[:m] | letter[1 : m + 1]
                    out[:, at : at + size] = np.bincount(doc[:m][own] * size + h[own], minlength=n * size).reshape(n, size)
            np.sqrt(out, out=out)
            norm = np.linalg.norm(out, axis=1, keepdims=True)
            yield out / np.maximum(norm, 1e-9)


def has_letter(texts: pa.Array) -> np.ndarray:
    """Whether each text has a letter of any script."""
    out = np.zeros(len(texts), bool)
    row = 0
    for lo, hi, buf, offsets in W.pieces(texts):
        low = W.lower_ascii(buf)
        ascii_letter = np.concatenate([[0], np.cumsum((low >= 97) & (low <= 122))])
        out[lo:hi] = ascii_letter[offsets[1:]] > ascii_letter[offsets[:-1]]
        row = hi
    assert row == len(texts)
    for i in np.flatnonzero(~out).tolist():
        text = texts[i].as_py()
        out[i] = text is not None and any(c.isalpha() for c in text)
    return out


def svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 300) -> np.ndarray:
    """Weights and bias of a linear SVM with squared hinge loss; y is 1 or -1. Accelerated gradient steps, no randomness.
    Classes weigh the same however many rows they have."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    step = 1.0 / (1.0 / c + 2 * 2.0)
    w = v = np.zeros(x.shape[1])
    for t in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v))
        new = v - step * (v / c - 2 * x.T @ (weight * y * slack))
        v, w = new + t / (t + 3) * (new - w), new
    return w


def families_of(x: np.ndarray, langs: list[str]) -> dict[str, str]:
    """Each language's family, by its first member's name: languages joined with the one whose mean features are nearest to theirs, by the cosine of what sets either apart from the mean
    of all. So a language stands with at least its nearest, and those that are taken for each other most have a classifier of their own."""
    lang = np.array(langs)
    names = sorted(set(langs))
    means = np.array([x[lang == v].mean(axis=0, dtype=np.float64) for v in names])
    apart = means - means.mean(axis=0)
    apart /= np.maximum(np.linalg.norm(apart, axis=1, keepdims=True), 1e-12)
    alike = apart @ apart.T
    np.fill_diagonal(alike, -np.inf)
    family = {v: v for v in names}
    for v, near in zip(names, alike.argmax(axis=1) if len(names) > 1 else [], strict=len(names) > 1):
        joined = sorted((family[v], family[names[near]]))
        family = {k: joined[0] if f == joined[1] else f for k, f in family.items()}
    return family


class Model:
    """Family classifiers, one against the rest, and a pairwise classifier for each two languages of a family."""

    def __init__(self, x: np.ndarray, langs: list[str], families: dict[str, str] | None = None) -> None:
        lang = np.array(langs)
        families = families_of(x, langs) if families is None else families
        family = np.array([families.get(v, v) for v in langs])
        self.families = sorted(set(family.tolist()))
        self.members = {f: sorted(set(lang[family == f].tolist())) for f in self.families}
        first = [svm(x, np.where(family == f, 1.0, -1.0)) for f in self.families] if len(self.families) > 1 else [np.zeros(x.shape[1] + 1)]
        self.first = np.array(first, np.float32)
        self.pairs = {}
        for f, members in self.members.items():
            for a, b in combinations(members, 2):
                rows = (lang == a) | (lang == b)
                self.pairs[f, a, b] = svm(x[rows], np.where(lang[rows] == a, 1.0, -1.0)).astype(np.float32)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The language and a score from 0 to 1: the family's probability times the mean of its pairwise ones."""
        sure = lambda m: 1 / (1 + np.exp(-4.0 * np.clip(m, -8, 8)))
        margin = x @ self.first[:, :-1].T + self.first[:, -1]
        best = margin.argmax(axis=1)
        score = sure(margin[np.arange(len(x)), best]) if len(self.families) > 1 else np.ones(len(x))
        out = np.empty(len(x), object)
        for k, f in enumerate(self.families):
            rows = np.flatnonzero(best == k)
            members = self.members[f]
            votes, trust = np.zeros((len(rows), len(members))), np.zeros((len(rows), len(members)))
            for (g, a, b), w in self.pairs.items():
                if g == f and len(rows):
                    m = x[rows] @ w[:-1] + w[-1]
                    for name, signed in ((a, m), (b, -m)):
                        votes[:, members.index(name)] += signed > 0
                        trust[:, members.index(name)] += sure(signed)
            pick = (votes + trust / (len(members) + 1)).argmax(axis=1) if len(rows) else np.zeros(0, int)
            out[rows] = np.array(members, object)[pick]
            if len(members) > 1:
                score[rows] *= trust[np.arange(len(rows)), pick] / (len(members) - 1)
        return out.tolist(), score


def fit(labelled: DataFrame, key: str, text: str, lang: str, families: dict[str, str] | None = None, per_language: int = SAMPLE_PER_LANGUAGE, most_rows: int = SAMPLE_ROWS) -> Model | None:
    """A model from about ``per_language`` rows of each language, those with the least hash of the key.

    Languages are counted, so that the share that is read is known before any text is; features are made on the executors and
    at most about ``per_language`` of them for each language, and ``most_rows`` in all, shared evenly by the languages, come to the driver, where the classifiers are
    fitted; so what it holds is bounded whatever the number of rows and labels, but for one count a label. Null texts and labels are left out, keys are integers or null, repeated rows are learned from as often as they are drawn. None if there
    is no labelled row. Families are learned from the languages' mean features, see ``families_of``, unless they are given.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}
    if not counts:
        return None
    per_language = min(per_language, max(1, most_rows // len(counts)))
    share = F.create_map(*[F.lit(v) for k, n in sorted(counts.items()) for v in (k, min(1.0, per_language / n))])
    draw = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 30)) / float(1 << 30)
    picked = rows.where(draw < share[F.col(lang)]).select(F.col(key).cast("long").alias("k"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    got = map_arrow(picked, _feature_rows, "k long, lang string, x binary").collect()
    got.sort(key=lambda r: (r[0], r[1], bytes(r[2])))
    if not got:
        return None
    x = np.array([np.frombuffer(r[2], np.float16) for r in got], np.float32)
    return Model(x, [r[1] for r in got], families)


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = [row.astype(np.float16).tobytes() for part in features(b.column(2)) for row in part]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.binary())], ["k", "lang", "x"])


def predict(docs: DataFrame, text: str, model: Model | None, tag: str = "") -> DataFrame:
    """``docs`` with lang_pred and score, their names after ``tag``; map-only over whole texts.

    A null text or one without any letter is ``und`` with score 0, and so is everything if nothing could be learned.
    Columns of these names in ``docs`` are replaced; all others are passed on as they are.
    """
    names = [f"{tag}lang_pred", f"{tag}score"]
    docs = docs.drop(*names)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = [], []
            if model is not None:
                for x in features(b.column(at)):
                    some, score = model.predict(x)
                    langs += some
                    scores.append(score)
            known = has_letter(b.column(at)) if model is not None else np.zeros(b.num_rows, bool)
            score = np.where(known, np.concatenate(scores), 0.0) if scores else np.zeros(b.num_rows)
            named = [v if ok else UNKNOWN for v, ok in zip(langs or [UNKNOWN] * b.num_rows, known.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(named, pa.string()), pa.array(score, pa.float64())], [*b.schema.names, *names])

    schema = StructType([*docs.schema.fields, StructField(names[0], StringType()), StructField(names[1], DoubleType())])
    return map_arrow(docs, run, schema)
