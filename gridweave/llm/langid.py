"""Language identification in two levels: the family first, then the language within it.

The family comes from one-versus-rest linear support vector machines, the language from one
machine for every pair of languages of that family.  Features are hashed counts of letter
sequences over the whole text; the models are fitted with numpy on a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import id_crc32
from gridweave.operators._joins import broadcast_if_small

#: Families of common language codes; a code not named here is a family of its own.
FAMILIES = {
    "germanic": "en de nl af sv da no nb nn is yi lb",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk",
    "baltic": "lt lv", "celtic": "ga gd cy br", "finnic": "fi et", "turkic": "tr az kk uz ky",
    "indic": "hi ur bn pa mr gu ne", "dravidian": "ta te kn ml", "semitic": "ar he mt am",
}
DIM = 4096
#: Labelled rows per language that the models are fitted on.
SAMPLE_PER_LANG = 400
#: A text is of no learned language if its letter sequences are less likely, by this many nats each on average, than
#: those of all but a thousandth of the sample (README: held-out figures).  The margin grows by SMOOTH_ROWS / rows of
#: itself, as the likelihoods of few rows tell little.
UNLIKELY, SMOOTH_ROWS = 0.8, 50


def family_of(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang in codes.split()), lang)


_FOLD = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint8)


def features(text: str) -> np.ndarray:
    """Unit vector of the square roots of hashed 1- to 3-byte counts in the lower-case UTF-8 text.

    Every ASCII character that is no letter counts as one space; spaces in a row count once.
    """
    b = _FOLD[np.frombuffer(text.lower().encode(), np.uint8)]
    b = b[np.append(True, (b[1:] != 32) | (b[:-1] != 32))] if len(b) else b
    b = np.concatenate([[32], b, [32]]).astype(np.uint32)
    one = b * np.uint32(2654435761)
    two = (one[:-1] ^ (b[1:] + np.uint32(0x1F3D))) * np.uint32(2246822519)
    three = (two[:-1] ^ (b[2:] + np.uint32(0x52A9))) * np.uint32(3266489917)
    count = np.zeros(DIM)
    for h in (one, two, three):
        count += np.bincount(((h ^ (h >> np.uint32(15))) & np.uint32(DIM - 1)).astype(np.int64), minlength=DIM)
    count = np.sqrt(count)
    norm = np.linalg.norm(count)
    return (count / norm if norm else count).astype(np.float32)


def fit_svm(x: np.ndarray, y: np.ndarray, reg: float = 1e-4, rounds: int = 200) -> tuple[np.ndarray, float, float]:
    """(weights, bias, slope) of a linear SVM with squared hinge loss; ``y`` is +1 / -1.

    Accelerated gradient descent on the whole sample with equal weight per class; ``slope`` maps
    the margin to a probability, fitted by Newton steps on the same rows.
    """
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    w, b, vw, vb = np.zeros(x.shape[1], np.float32), 0.0, np.zeros(x.shape[1], np.float32), 0.0
    for t in range(rounds):
        mom = t / (t + 3)
        pw, pb = w + mom * vw, b + mom * vb
        slack = np.maximum(0, 1 - y * (x @ pw + pb)) * y * share
        nw, nb = pw + 0.4 * (2 * (slack @ x) - reg * pw), pb + 0.4 * 2 * slack.sum()
        vw, vb, w, b = nw - w, nb - b, nw, nb
    margin, slope = (x @ w + b).astype(float), 1.0
    target = (y > 0).astype(float)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(slope * margin, -30, 30)))
        grad = (share * (p - target) * margin).sum() + 1e-3 * (slope - 1)
        slope -= grad / ((share * p * (1 - p) * margin**2).sum() + 1e-3)
        slope = float(np.clip(slope, 0.1, 20))
    return w, float(b), slope


@dataclass
class Model:
    """Fitted machines: one per family, one per pair of languages of a family."""

    families: dict[str, list[str]] = field(default_factory=dict)
    rest: dict[str, tuple] = field(default_factory=dict)
    pairs: dict[tuple[str, str], tuple] = field(default_factory=dict)
    #: Log share of every feature over the languages, and the least likelihood of a text in any of them.
    log_share: np.ndarray | None = None
    floor: float = -np.inf

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, probability); ``und`` and 0 for no text, no letter or no model."""
        if not text or not self.families or not any(map(str.isalpha, text)):
            return "und", 0.0
        return self._tell(features(text))

    def knows(self, text: str | None, min_score: float) -> bool:
        """Whether the text is told with ``min_score`` and as likely as texts in the learned languages are."""
        if not text or not self.families or not any(map(str.isalpha, text)):
            return False
        x = features(text)
        return self._tell(x)[1] >= min_score and self.likelihood(x) >= self.floor

    def likelihood(self, x: np.ndarray) -> float:
        """Mean log share of the text's letter sequences; about the same in a mix of learned languages."""
        return float(x.astype(float) ** 2 @ self.log_share)

    def _tell(self, x: np.ndarray) -> tuple[str, float]:
        prob = {f: _prob(x, self.rest[f]) for f in self.rest} or {f: 1.0 for f in self.families}
        family = max(sorted(prob), key=prob.get)
        langs = self.families[family]
        votes = {a: [0, 0.0] for a in langs}
        for (a, b), m in self.pairs.items():
            if a in votes:
                p = _prob(x, m)
                for lang, q in ((a, p), (b, 1 - p)):
                    votes[lang][0] += q >= 0.5
                    votes[lang][1] += q
        lang = max(langs, key=lambda a: (votes[a][0], votes[a][1]))
        within = votes[lang][1] / (len(langs) - 1) if len(langs) > 1 else 1.0
        return lang, float(prob[family] * within)


def _prob(x, machine) -> float:
    w, b, slope = machine
    return float(1 / (1 + np.exp(-np.clip(slope * (float(x @ w) + b), -30, 30))))


def fit(x: np.ndarray, lang: list[str]) -> Model:
    """Model of labelled feature rows; no rows give a model that says ``und``."""
    lang, model = np.array(lang, dtype=object), Model()
    for a in sorted(set(lang)):
        model.families.setdefault(family_of(a), []).append(a)
    family = np.array([family_of(a) for a in lang], dtype=object)
    if len(model.families) > 1:
        for f in model.families:
            model.rest[f] = fit_svm(x, np.where(family == f, 1.0, -1.0).astype(np.float32))
    if len(lang):
        share = np.mean([(x[lang == a].astype(float) ** 2).mean(0) for a in sorted(set(lang))], axis=0) + 1e-6
        model.log_share = np.log(share / share.sum())
    if len(lang):
        margin = UNLIKELY * (1 + SMOOTH_ROWS / len(lang))
        model.floor = float(np.quantile([model.likelihood(row) for row in x], 0.001)) - margin
    for langs in model.families.values():
        for i, a in enumerate(langs):
            for b in langs[i + 1:]:
                own = (lang == a) | (lang == b)
                model.pairs[a, b] = fit_svm(x[own], np.where(lang[own] == a, 1.0, -1.0).astype(np.float32))
    return model


def train(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG) -> Model:
    """Fit on about ``per_lang`` rows of each language, picked by a hash of the id.

    Learns from text and lang only, of rows that have both and an id whose crc32 mod 4 is not 2.
    The driver gets the sample's feature vectors only.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (id_crc32() % 4 != 2)
                       ).select("doc_id", "text", "lang")
    counts = known.groupBy("lang").agg(F.count("*").alias("n"))
    dice = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 30)) / float(1 << 30)
    picked = known.join(broadcast_if_small(counts), "lang").where(dice * F.col("n") < per_lang).select("lang", "text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = [(lang, text) for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(),
                                                       strict=True) if any(map(str.isalpha, text))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array(
                [features(r[1]).astype(np.float16).tobytes() for r in rows], pa.binary())], ["lang", "x"])

    got = picked.mapInArrow(run, "lang string, x binary").orderBy("lang", "x").collect()
    if not got:
        return Model()
    x = np.frombuffer(b"".join(r["x"] for r in got), np.float16).reshape(len(got), DIM).astype(np.float32)
    return fit(x, [r["lang"] for r in got])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row, from the whole text alone.

    Null, empty and letterless texts are ``und`` with score 0; repeated rows get equal results.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIM weights per family and pair

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = [shared.value.predict(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([o[0] for o in out], pa.string()),
                 pa.array([o[1] for o in out], pa.float64())], ["doc_id", "lang_pred", "score"])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(run, "doc_id long, lang_pred string, score double"))


def keep_known(docs: DataFrame, min_score: float = 0.3, model: Model | None = None) -> DataFrame:
    """The rows of ``docs`` whose language is told with at least ``min_score``, columns as they were.

    Rows without a letter go, and rows in no learned language by their likelihood; a document in two
    known languages scores near one half and stays.
    """
    model = model or train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def knows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for texts in batches:
            yield pa.array([shared.value.knows(t.as_py(), min_score) for t in texts], pa.bool_())

    # only the texts go to Python and only a boolean comes back; columns of any name, so by their place
    known = F.arrow_udf(knows, "boolean", F.ArrowUDFType.SCALAR_ITER)
    places = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*places).where(known(places[docs.columns.index("text")])).toDF(*docs.columns)


def query(spark, sf_dir):
    """Language of every document, learned from the rows outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = predict(docs, train(docs))
    return out.select("doc_id", (id_crc32() % 4 == 2).alias("held_out"), "lang_pred", "score")
