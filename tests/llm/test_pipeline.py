"""The stages of the pipeline, each and together, on a small corpus against plain Python."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomgraph.llm import decontaminate, near_dedup_stage, simhash, toxicity
from loomgraph.llm.common import cut
from loomgraph.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def low(s):
    return (s or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def prose(name, n):
    return " ".join(f"{name}{i}" for i in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with nulls, repeated rows, copies and columns of the stages' own names."""
    rows = [
        (1, prose("a", 40) + "\na line that repeats here", "en", 1), (2, prose("b", 40) + "\nA line that repeats here ", "en", 2),
        (3, prose("a", 40) + "\na line that repeats", None, None), (4, None, "en", 0), (5, "", "de", 0), (6, " \t\n", None, None),
        (7, prose("c", 30), "en", 3), (7, prose("c", 30), "en", 3), (None, prose("d", 20), None, None), (8, "漢字 " * 300, "fr", 4),
    ]
    shape = "doc_id bigint, text string, lang string, n_chars int"
    clash = {"ids": F.lit(1), "toxicity": F.lit("t"), "n_lines": F.lit(2), "n_dropped": F.lit(3), "shingles": F.lit(4), "label": F.lit(5)}
    return cut(spark.createDataFrame(rows, shape).select("*", *(c.alias(n) for n, c in clash.items())))


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_take_odd_and_empty_tables(spark, odd, k):
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, odd, SF)
    rows = out.collect()
    assert (out.columns == odd.columns) == (name != corpus_pipeline.STAGES[-1][0])
    ids = sorted(repr(r["doc_id"]) for r in rows)
    if name == "SimHash near-dedup":
        assert ids == sorted(map(repr, [1, 2, 4, 7, 8, None]))
    else:
        assert ids == sorted(repr(r["doc_id"]) for r in odd.collect())
    if name == "line dedup":
        assert {r["doc_id"]: r["n_chars"] for r in rows}[2] == len(prose("b", 40)) and (2, prose("b", 40)) in {(r["doc_id"], r["text"]) for r in rows}
    if "ids" in out.columns and name == corpus_pipeline.STAGES[-1][0]:
        assert all(r["exact"] for r in rows)
    assert stage(spark, odd.limit(0), SF).count() == 0


def test_pipeline_is_its_stages_by_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    frame = lambda rows: spark.createDataFrame(rows, "doc_id bigint, text string")
    # toxicity: the fitted model, its score taken feature by feature
    model = toxicity.fit(frame(docs), labels)
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    weight = dict(zip(model.words, model.weights)) if model else {}
    logit = lambda t: model.bias + sum(weight.get(f, 0) for f in toxicity.features(words(t)))
    docs = [(i, t) for i, t in docs if not model or 1 / (1 + 2.718281828459045 ** -logit(t)) < toxicity.THRESHOLD]
    # line dedup
    strip = lambda x: low(x.strip(" \t\n\x0b\x0c\r"))
    first, holders = {}, {}
    for i, t in docs:
        for x in map(strip, (t or "").split("\n")):
            if len(x) >= 10:
                first[x] = min(first.get(x, i), i)
                holders.setdefault(x, set()).add(i)
    docs = [(i, "\n".join(x for x in (t or "").split("\n") if len(holders.get(strip(x), ())) < 2 or first[strip(x)] == i)) for i, t in docs]
    # near copies: all pairs within the radius and of the similarity, joined
    import pyarrow as pa

    texts = pa.array([t for _, t in docs])
    fps, sets = near_dedup_stage.fingerprints(texts).tolist(), [set(zip(*[iter(s)] * 8)) for s in near_dedup_stage.shingle_sets(texts)[1]]
    up = {i: i for i, _ in docs}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(docs)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= near_dedup_stage.RADIUS and root(docs[a][0]) != root(docs[b][0]):
                whole = len(sets[a] | sets[b])
                if not whole or len(sets[a] & sets[b]) >= near_dedup_stage.SIMILARITY * whole:
                    x, y = sorted((root(docs[a][0]), root(docs[b][0])))
                    up[y] = x
    docs = [(i, t) for i, t in docs if root(i) == i]
    # decontamination
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r["text"])
        windows |= {tuple(w[k : k + decontaminate.WINDOW]) for k in range(max(1, len(w) - decontaminate.WINDOW + 1)) if w}
    sizes, left = sorted({len(w) for w in windows}), []
    for i, t in docs:
        at = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))]
        w, hit = words(t), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
        if hit and len(hit) == len(w):
            continue
        kept, end, k = [], 0, 0
        while k < len(w):
            if k in hit:
                b = k
                while b + 1 in hit:
                    b += 1
                kept.append(t[end : at[k][0]])
                end, k = at[b][1], b
            k += 1
        left.append((i, "".join([*kept, t[end:]])))
    # the codec restores each text
    got = {r["doc_id"]: r for r in QUERIES["pipeline"](spark, SF).collect()}
    assert sorted(got) == sorted(i for i, _ in left) and all(r["exact"] for r in got.values())
    from loomgraph.llm import sentencepiece_codec

    lexicon = sentencepiece_codec.Lexicon()
    ids, offsets = sentencepiece_codec.encode_texts(pa.array([t for _, t in left]), lexicon)
    assert {i: ids[a:b].tolist() for (i, _), a, b in zip(left, offsets[:-1], offsets[1:])} == {i: list(r["ids"]) for i, r in got.items()}


def test_op10_is_brute_force_on_the_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    import xxhash

    prints, cache = {}, {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        counts = [0] * 64
        shingles = [" ".join(w[k : k + simhash.SHINGLE]) for k in range(max(1, len(w) - simhash.SHINGLE + 1))] if w else []
        total = 0
        for s in shingles:
            h = cache.setdefault(s, xxhash.xxh64_intdigest(s.encode(), 42))
            total += int(f"{h:064b}".translate(SPREAD), 16)  # a sum of 64 counters of sixteen bits
        for k in range(64):
            counts[k] = total >> 16 * k & 0xFFFF
        prints[i] = sum(1 << k for k in range(64) if 2 * counts[k] > len(shingles))
    ids = sorted(prints)
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, i in enumerate(ids):
        for j in ids[:a]:
            if (prints[i] ^ prints[j]).bit_count() <= simhash.RADIUS:
                x, y = sorted((root(i), root(j)))
                up[y] = x
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op10_simhash_near_dedup"](spark, "/root/testdata/sf0.01").collect()}
    assert got == {i: (f"{prints[i]:016x}", root(i)) for i in ids}


#: binary digits -> hexadecimal digits of sixteen-bit counters
SPREAD = {ord("0"): "0000", ord("1"): "0001"}
