"""Language identification by hierarchical discrimination.

First the language family is predicted by one-versus-one linear support vector machines, then, within the family,
one-versus-one machines separate its languages. Features are the frequencies of hashed runs of one to four bytes
of the lower-cased letters (anything else counts as one space), so a machine's margin is the mean of a table
lookup over the whole text: one gather a text and machine, no feature vector.

Both sides of a machine weigh the same, however many rows they have, and the loss counts by rows against the
regularisation, so that a language with few texts is not lost beside a common one.

Families are those of FAMILIES; a label outside it is a family of its own. Training takes whole texts, at most
`max_per_language` of each language and about `max_rows` in all (by hash of identifier and text); their frequencies
are taken on the executors. Every label is learned; more than MAX_LANGUAGES of them are refused, as such a column
holds no languages. Prediction covers whole texts. Null labels and the held-out side are not learned from. A null
text or one without letters is `und` with score 0; so is everything when there is nothing to learn. Repeated rows
agree; equal votes go to the larger sum of margins, then the first label. Only the named columns are read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out

MAX_PER_LANGUAGE, MAX_ROWS, MAX_LANGUAGES = 400, 4000, 2000
SLOTS = 1 << 14
#: Language codes of each family.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "is", "af"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl"],
    "slavic": ["ru", "pl", "cs", "sk", "uk", "bg", "sr", "hr", "sl"],
    "uralic": ["fi", "et", "hu"],
}
_OTHER = re.compile(r"[\W\d_]+")


def family_of(lang: str) -> str:
    return next((f for f, own in FAMILIES.items() if lang in own), lang)


def letters(text: str | None) -> str | None:
    """Lower-cased words with single spaces around them; None if there is no letter."""
    if not text:
        return None
    out = _OTHER.sub(" ", text.lower()).strip()
    return f" {out} " if any(map(str.isalpha, out[:64])) or any(map(str.isalpha, out)) else None


def slots(data: bytes):
    """Hashed runs of 1 to 4 bytes, one after another."""
    import numpy as np

    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    out, h = [b], b
    for n in range(2, 5):
        if len(b) < n:
            break
        h = h[:-1] * np.uint32(0x01000193) + b[n - 1 :] + np.uint32(n)
        out.append(((h * np.uint32(0x9E3779B1)) >> np.uint32(18)) & np.uint32(SLOTS - 1))
    return np.concatenate(out)


class Model:
    """machines: (scope, left, right) -> column of weights; scope is "" for families or a family's name."""

    def __init__(self, languages: list[str], machines: list[tuple[str, str, str]], weights, bias):
        self.languages, self.machines, self.weights, self.bias = languages, machines, weights, bias
        self.families: dict[str, list[str]] = {}
        for x in languages:
            self.families.setdefault(family_of(x), []).append(x)

    def _vote(self, scope: str, options: list[str], margins) -> tuple[str, float]:
        import math

        if len(options) == 1:
            return options[0], 1.0
        votes, total, sure = dict.fromkeys(options, 0), dict.fromkeys(options, 0.0), dict.fromkeys(options, 1.0)
        for k, (s, left, right) in enumerate(self.machines):
            if s == scope:
                m = float(margins[k])
                votes[left if m >= 0 else right] += 1
                total[left] += m
                total[right] -= m
                p = 1 / (1 + math.exp(-max(-30.0, min(30.0, 4 * m))))
                sure[left] = min(sure[left], p)
                sure[right] = min(sure[right], 1 - p)
        best = max(options, key=lambda x: (votes[x], total[x], -options.index(x)))
        return best, sure[best]

    def _margins(self, data: bytes):
        """In pieces of a megabyte, so that memory does not follow the longest text."""
        import numpy as np

        total, n = np.zeros(len(self.weights)), 0
        for at in range(0, len(data), 1 << 20):
            found = slots(data[at : at + (1 << 20)])
            total += [w[found].sum(dtype=np.float64) for w in self.weights]
            n += len(found)
        return total / n + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        clean = letters(text)
        if clean is None or not self.languages:
            return "und", 0.0
        margins = self._margins(clean.encode()) if self.machines else []
        family, a = self._vote("", list(self.families), margins)
        lang, b = self._vote(family, self.families[family], margins)
        return lang, a * b


def _svm(x, y, rounds: int = 300, c: float = 1.0):
    """Squared-hinge linear machine, |w|^2 / 2 + c * rows * (mean over sides of the mean loss), by gradient steps with momentum."""
    import numpy as np

    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    strength = c * len(y)
    w, b, vw, vb = np.zeros(x.shape[1], np.float32), 0.0, 0.0, 0.0
    top = 2 * strength * float(((x * x).sum(1) + 1) @ share) + 1
    for _ in range(rounds):
        miss = np.maximum(0, 1 - y * (x @ w + b)) * y * share
        gw, gb = w - 2 * strength * (x.T @ miss), -2 * strength * float(miss.sum())
        vw, vb = 0.9 * vw - gw / top, 0.9 * vb - gb / top
        w, b = (w + vw).astype(np.float32), b + vb
    return w, b


def frequencies(text: str | None):
    """(slots, frequencies) of a text's runs; None without letters. In pieces of a megabyte, as in prediction."""
    import numpy as np

    clean = letters(text)
    if clean is None:
        return None
    data, total = clean.encode(), np.zeros(SLOTS, np.int64)
    for at in range(0, len(data), 1 << 20):
        total += np.bincount(slots(data[at : at + (1 << 20)]), minlength=SLOTS)
    found = np.flatnonzero(total)
    return found.astype(np.uint16), (total[found] / total.sum()).astype(np.float32)


def fit(rows: list[tuple[str, object, object]]) -> Model:
    """rows: (language, slots, frequencies)."""
    import numpy as np

    languages = sorted({x for x, *_ in rows})
    if len(languages) < 2:
        return Model(languages, [], np.zeros((0, SLOTS), np.float32), np.zeros(0))
    x = np.zeros((len(rows), SLOTS), np.float32)
    for k, (_, at, f) in enumerate(rows):
        x[k, at] = f
    power = np.zeros(SLOTS)
    for at in range(0, len(x), 256):
        power += (x[at : at + 256].astype(np.float64) ** 2).sum(0)
    scale = (1 / np.sqrt(power / len(x) + 1e-7) / np.sqrt(SLOTS)).astype(np.float32)
    x *= scale
    lang = np.array([y for y, *_ in rows])
    family = np.array([family_of(y) for y in lang])
    machines, weights, bias = [], [], []
    plan = [("", family)] + [(f, np.where(family == f, lang, "")) for f in sorted(set(family))]
    for scope, names in plan:
        options = [o for o in sorted(set(names)) if o]
        for i, left in enumerate(options):
            for right in options[i + 1 :]:
                own = np.flatnonzero((names == left) | (names == right))
                w, b = _svm(x[own], np.where(names[own] == left, 1, -1).astype(np.float32))
                machines.append((scope, left, right))
                weights.append(w * scale)
                bias.append(b)
    return Model(languages, machines, np.stack(weights).astype(np.float32), np.array(bias))


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", mod: int = 4, max_per_language: int = MAX_PER_LANGUAGE, max_rows: int = MAX_ROWS) -> Model:
    """Fits on a bounded sample of the rows whose crc32(doc_id) mod `mod` is not 2."""
    import numpy as np

    rows = docs.select(F.col(lang).cast("string").alias("y"), F.col(text).alias("t"), F.xxhash64(doc_id, text).alias("h"), held_out(mod, doc_id).alias("out")).filter("y IS NOT NULL AND NOT out AND length(t) > 0").drop("out")
    # how common each label is decides the share of hash space to take, so that only the sample is ranked
    counts = {r[0]: r[1] for r in rows.groupBy("y").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"column {lang} has more than {MAX_LANGUAGES} labels")
    if not counts:
        return fit([])
    each = min(max_per_language, max(8, max_rows // len(counts)))
    share = F.element_at(F.create_map(*[F.lit(x) for y, n in counts.items() for x in (y, min(1.0, 1.3 * each / n))]), F.col("y"))
    some = rows.filter(F.pmod("h", F.lit(1 << 20)) < share * (1 << 20))
    some = some.withColumn("k", F.row_number().over(Window.partitionBy("y").orderBy("h", "t"))).filter(F.col("k") <= each)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            got = [(y, f[0].tobytes(), f[1].tobytes()) for y, f in zip(b.column(0).to_pylist(), map(frequencies, b.column(1).to_pylist()), strict=True) if f is not None]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*got, strict=True), (pa.string(), pa.binary(), pa.binary()), strict=True)], names=["y", "at", "f"])

    got = sorted((r["y"], bytes(r["at"]), bytes(r["f"])) for r in some.select("y", "t").mapInArrow(run, "y string, at binary, f binary").toLocalIterator())
    return fit([(y, np.frombuffer(at, np.uint16), np.frombuffer(f, np.float32)) for y, at, f in got])


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score."""
    # plain values are broadcast and the model is built in the task, so that workers need no copy of this package
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.machines, model.weights, model.bias))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"))

    def run(batches):
        import pyarrow as pa

        built = Model(*shared.value)
        for b in batches:
            out = [built.predict(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in out], pa.string()), pa.array([float(x) for _, x in out], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, lang_pred string, score double")
