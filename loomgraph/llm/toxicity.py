"""Toxicity: a counterfactual-regularised classifier.

A logistic model of which words and word beginnings a text holds, fitted on labelled documents. Each training text has
counterfactual copies, and the change of the score between text and copy is penalised. Where a text mentions a group of
people, the mention is swapped for other groups of its kind; into other texts the names of a kind, chosen by the document's
id, are put one by one. So what a score takes from a group's name alone is pressed to zero and to the same value for all
groups of a kind, and neutral mentions stop counting as toxic.

Scale: at most SAMPLE labelled documents (those with the smallest hashes of their ids) are fitted; their words are counted
on the executors and only VOCABULARY significant ones and the sample's rows of them reach the driver. Scoring is one
pass over all texts, no shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, cut, string_views, table
from .decontaminate import words_of

SAMPLE, VOCABULARY = 20_000, 2048
MIN_DOCUMENTS, MIN_Z = 3, 3.0
THRESHOLD = 0.7
L2, PENALTY, STEPS = 1e-5, 5.0, 400
#: A toxic document counts as this many: they are the rarer ones.
POSITIVE = 4.0
SHIFTS = 3
#: Words longer than this have their first so many code points as a feature, `beginning*`, and `beginning**` if two or more.
BEGINNINGS = (5, 7)
#: Names of groups by kind, in the languages of the corpus; each is swapped for others of its line.
GROUPS = [
    "christian muslim jewish hindu buddhist atheist",
    "chrétien musulman juif hindou bouddhiste athée",
    "christlich muslimisch jüdisch hinduistisch buddhistisch atheistisch",
    "cristiano musulmán judío hindú budista ateo",
    "gay lesbian bisexual straight heterosexual homosexual",
    "women men girls boys transgender",
    "femmes hommes filles garçons",
    "frauen männer mädchen jungen",
    "mujeres hombres niñas niños",
    "black white asian latino african european",
    "immigrants refugees foreigners natives",
    "disabled blind deaf elderly young",
]


def swaps() -> dict[str, list[str]]:
    out = {}
    for line in GROUPS:
        names = line.split()
        for i, name in enumerate(names):
            out[name] = [names[(i + k) % len(names)] for k in range(1, min(SHIFTS, len(names) - 1) + 1)]
    return out


@dataclass
class Model:
    words: list[str]
    weights: np.ndarray
    bias: float
    #: Texts and copies whose change of score was penalised.
    pairs: int = 0


def text_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all words, the text of each)."""
    low, offsets, starts, ends = words_of(texts)
    return string_views(low, starts, ends), np.searchsorted(offsets, starts, side="right") - 1


def features(words: list[str]) -> set[str]:
    out = set(words)
    for size in BEGINNINGS:
        for start, n in Counter(w[:size] for w in words if len(w) > size).items():
            out.update([start + "*", start + "**"] if n > 1 else [start + "*"])
    return out


FEATURES = pa.schema([("toxic", pa.int32()), ("variant", pa.int32()), ("origin", pa.int64()), ("words", pa.list_(pa.string())), ("lost", pa.list_(pa.string()))])
FEATURE_ROW = "toxic int, variant int, origin bigint, words array<string>, lost array<string>"


def with_name(have: set[str], starts: set[str], name: str) -> set[str]:
    """The features that a text with these features, and these beginnings of its words, gains by one more word."""
    gained = {name}
    for size in BEGINNINGS:
        if len(name) > size:
            gained.update([name[:size] + "*", *([name[:size] + "**"] if name[:size] in starts else [])])
    return gained - have


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each text a row of its features (variant 0), and for each copy what it gains (words) and loses by its names."""
    other, kinds = swaps(), [line.split() for line in GROUPS]
    for b in chunks(batches, "text"):
        words, owner = text_words(b.column("text"))
        words = words.to_pylist()
        first = np.searchsorted(owner, np.arange(b.num_rows + 1))
        out = []
        for k, (toxic, origin) in enumerate(zip(b.column("toxic").to_pylist(), b.column("doc_id").to_pylist())):
            have = words[first[k] : first[k + 1]]
            own = features(have)
            out.append((toxic, 0, origin, sorted(own), []))
            if any(w in other for w in have):
                for shift in range(SHIFTS):
                    swapped = features([other[w][shift % len(other[w])] if w in other else w for w in have])
                    out.append((toxic, shift + 1, origin, sorted(swapped - own), sorted(own - swapped)))
            else:
                pick = crc32(str(origin).encode())
                names = kinds[pick % len(kinds)]
                starts = {w[:size] for size in BEGINNINGS for w in have if len(w) > size}
                for shift in range(SHIFTS):
                    name = names[(pick // len(kinds) + shift) % len(names)]
                    out.append((toxic, shift + 1, origin, sorted(with_name(own, starts, name)), []))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), FEATURES)], schema=FEATURES)


def _places(place: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known = [pa.array([[place[w] for w in ws if w in place] for ws in b.column(c).to_pylist()], pa.list_(pa.int32())) for c in ("words", "lost")]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), b.column("variant"), b.column("origin"), *known], names=["toxic", "variant", "origin", "places", "lost"])

    return run


def fit_weights(rows: list[list[int]], toxic: np.ndarray, pairs: list[tuple[list[int], list[int]]], n: int, penalty: float = PENALTY) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise log loss + L2 |w|^2 + penalty * mean square change of the logit over pairs.

    A pair is what a text and its copy have each that the other has not.
    """

    def matrix(xs: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(xs)), [len(x) for x in xs]), np.array([i for x in xs for i in x], dtype=np.int64)

    row, col = matrix(rows)
    (ra, ca), (rb, cb) = (matrix([p[k] for p in pairs]) for k in (0, 1))
    m, k = len(rows), max(1, len(pairs))
    weight = np.where(toxic > 0, POSITIVE, 1.0)
    weight /= weight.sum()
    w, bias = np.zeros(n), float(np.log((POSITIVE * toxic.sum() + 0.5) / (m - toxic.sum() + 0.5)))
    grad2, speed, speed_b, grad2_b = np.zeros(n), np.zeros(n), 0.0, 0.0
    for step in range(1, STEPS + 1):  # Adam over all rows
        z = np.bincount(row, weights=w[col], minlength=m) + bias
        err = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - toxic) * weight
        g = np.bincount(col, weights=err[row], minlength=n) + 2 * L2 * w
        if pairs:
            change = np.bincount(ra, weights=w[ca], minlength=k) - np.bincount(rb, weights=w[cb], minlength=k)
            g += 2 * penalty / k * (np.bincount(ca, weights=change[ra], minlength=n) - np.bincount(cb, weights=change[rb], minlength=n))
        gb = err.sum()
        speed, grad2 = 0.9 * speed + 0.1 * g, 0.99 * grad2 + 0.01 * g * g
        speed_b, grad2_b = 0.9 * speed_b + 0.1 * gb, 0.99 * grad2_b + 0.01 * gb * gb
        rate = 0.1 * min(1.0, 3 * (1 - step / (STEPS + 1)))
        c1, c2 = 1 - 0.9**step, 1 - 0.99**step
        w -= rate * (speed / c1) / (np.sqrt(grad2 / c2) + 1e-8)
        bias -= rate * (speed_b / c1) / (np.sqrt(grad2_b / c2) + 1e-8)
    return w, bias


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, penalty: float = PENALTY) -> Model | None:
    """The model of docs (doc_id, text) labelled by labels (doc_id, toxic); None if no label is usable.

    Of an id's labels the largest counts, of its texts the smallest; null ids, labels and texts are left out; texts that
    are alike throughout are fitted once.
    """
    chosen = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")
    once = texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).groupBy(F.sha2("text", 256)).agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"), F.first("text").alias("text"))
    rows = cut(once.select("doc_id", "toxic", "text").mapInArrow(_features, FEATURE_ROW))
    plain = rows.where("variant = 0")
    total = plain.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t")).first()
    n, t = total["n"], total["t"] or 0
    if not n:
        return None
    counts = plain.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t")).where(F.col("n") >= MIN_DOCUMENTS)
    share = t / n
    z = F.abs(F.col("t") - F.col("n") * share) / F.sqrt(F.col("n") * F.lit(max(share * (1 - share), 1e-9)))
    known = counts.where(z >= MIN_Z).orderBy(F.desc(z), "word").limit(VOCABULARY)
    names = {f for name in swaps() for f in features([name])}
    words = sorted({r["word"] for r in known.select("word").collect()} | names)
    place = {w: i for i, w in enumerate(words)}
    places = "toxic int, variant int, origin bigint, places array<int>, lost array<int>"
    x = rows.mapInArrow(_places(place), places).toArrow().to_pandas()  # at most sample * (1 + SHIFTS) rows of places in the vocabulary
    x = x.sort_values(["origin", "variant"])
    texts, copies = x[x["variant"] == 0], x[x["variant"] > 0]
    pairs = list(zip(copies["lost"], copies["places"]))
    weights, bias = fit_weights(list(texts["places"]), texts["toxic"].to_numpy(float), pairs, len(words), penalty)
    return Model(words, weights, bias, len(pairs))


def score_texts(texts: pa.Array, model: Model | None) -> np.ndarray:
    n = len(texts)
    if model is None:
        return np.zeros(n)
    words, owner = text_words(texts)
    at = pc.fill_null(pc.index_in(words, value_set=pa.array(model.words, pa.large_string())), -1).to_numpy().astype(np.int64)
    size = len(model.words)
    pair = [np.unique(owner[at >= 0] * size + at[at >= 0])]  # a feature counts once a text
    one, two = ({w[: -len(end)]: i for i, w in enumerate(model.words) if w.endswith(end) and w[-len(end) - 1] != "*"} for end in ("*", "**"))
    for length in BEGINNINGS:
        starts = sorted({w for w in (*one, *two) if len(w) == length})
        if starts:
            long = pc.greater(pc.utf8_length(words), length)
            found = pc.index_in(pc.utf8_slice_codeunits(words.filter(long), 0, length), value_set=pa.array(starts, pa.large_string()))
            found, whose = pc.fill_null(found, -1).to_numpy().astype(np.int64), owner[long.to_numpy(zero_copy_only=False)]
            key, count = np.unique(whose[found >= 0] * len(starts) + found[found >= 0], return_counts=True)
            for places, some in ((one, count > 0), (two, count > 1)):
                place = np.array([places.get(w, -1) for w in starts])[key[some] % len(starts)]
                pair.append((key[some] // len(starts) * size + place)[place >= 0])
    pair = np.concatenate(pair)
    z = model.bias + np.bincount(pair // size, weights=model.weights[pair % size], minlength=n)
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def score_toxicity(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs (text and any other columns) with a column toxicity (0 to 1) for every row.

    Null and empty texts have the score of a text without words; without a model all scores are 0. A column of that name
    is replaced; repeated rows are kept; an empty table gives an empty result.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import DoubleType, StructField, StructType

    plain = docs.drop("toxicity")
    shape = StructType([*plain.schema.fields, StructField("toxicity", DoubleType())])
    schema = to_arrow_schema(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            score = pa.array(score_texts(b.column("text"), model))
            yield pa.RecordBatch.from_arrays([score if f.name == "toxicity" else b.column(f.name).cast(f.type) for f in schema], schema=schema)

    return plain.mapInArrow(run, shape)


def remainder(parts: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(remainder(3) == 1, F.lit(False))
    model = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"))
