"""The operators as queries: nulls, empty and repeated rows, empty tables and clashing columns, against brute force."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import chat_format, decontaminate, lm_scoring, near_dedup_stage, secret_scan, sentencepiece_codec, simhash, top_k, toxicity, url_filter
from loomgraph.llm.common import cut
from loomgraph.llm.components import connected_components
from loomgraph.llm.line_dedup import LineIndex, dedup_lines

DOCS = [
    (1, "same line here\nown line of one\n"), (2, " SAME LINE HERE \nshort\nshort"), (3, None), (4, ""), (None, "same line here"),
    (5, "same line here\nsame line here"), (2, "only in the second two"), (6, "own line of one\x0b"), (7, "a"), (7, "a"),
]
SHAPE = "doc_id bigint, text string"


@pytest.fixture(scope="module")
def docs(spark):
    return cut(spark.createDataFrame([(i, t, 1, "x") for i, t in DOCS], SHAPE + ", n_lines int, spans string"))


def low(s):
    return (s or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def test_line_dedup(spark, docs):
    strip = lambda x: low(x.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for i, t in DOCS:
        for x in (t or "").split("\n"):
            if len(strip(x)) >= 10:
                holders.setdefault(strip(x), set()).add(10**9 if i is None else i)
    want = []
    for i, t in DOCS:
        ls = (t or "").split("\n")
        kept = [x for x in ls if len(holders.get(strip(x), ())) < 2 or min(holders[strip(x)]) == i]
        want.append((i, "\n".join(kept), len(ls), len(ls) - len(kept)))
    got = [(r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in dedup_lines(docs).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert dedup_lines(docs.limit(0)).count() == 0


def test_line_index_is_reversible(spark):
    df = lambda rows: spark.createDataFrame(rows, SHAPE)
    state = LineIndex(spark, shards=3).insert(df([(1, "a line that repeats\nb"), (2, "a line that repeats"), (3, "a line alone of three")]))
    both = state.insert(df([(4, "a line alone of three\na line that repeats")]))
    held = lambda s: sorted(r["keep_doc"] for r in s.repeated().collect())
    assert held(state) == [1] and held(both) == [1, 3]
    assert held(both.delete(df([(1, "")]))) == [2, 3]
    back = both.delete(df([(4, "")]))
    assert held(back) == [1] and sorted(map(tuple, back.counts.collect())) == sorted(map(tuple, state.counts.collect()))
    assert held(back.delete(df([(1, ""), (9, "")]))) == []
    again = both.insert(df([(4, "a line alone of three"), (2, "other text of two")]))  # ids that are held are not counted twice
    assert sorted(map(tuple, again.counts.collect())) == sorted(map(tuple, both.counts.collect()))


def test_line_index_cleans_texts_by_its_state(spark):
    df = lambda rows: spark.createDataFrame(rows, SHAPE)
    rng = np.random.default_rng(11)
    rows = [(i, "\n".join(f"line number {rng.integers(60)} of some" for _ in range(8))) for i in range(30)]
    texts = lambda frame: sorted((r["doc_id"], r["text"], r["n_dropped"]) for r in frame.collect())
    first, rest, gone = rows[:20], rows[20:], [r for r in rows if r[0] % 5 == 0]
    left = [r for r in rows if r[0] % 5]
    state = LineIndex(spark, shards=4).insert(df(first)).insert(df(rest))
    assert texts(state.clean(df(rows))) == texts(dedup_lines(df(rows)))
    after = state.delete(df(gone))
    assert texts(after.clean(df(left))) == texts(dedup_lines(df(left))) != texts(state.clean(df(left)))
    assert texts(after.insert(df(gone)).clean(df(rows))) == texts(dedup_lines(df(rows)))


def test_secret_scan_and_decontamination(spark, docs):
    assert secret_scan.scan_secrets(docs).count() == len(DOCS) and secret_scan.scan_secrets(docs.limit(0)).count() == 0
    bench = spark.createDataFrame([(1, "SAME line"), (None, "short"), (3, None), (4, "")], "item_id bigint, text string")
    rows = decontaminate.find_contamination(docs, bench, block_words=1).collect()
    hits = {(r["doc_id"], r["text"]): (sum(h["end"] - h["start"] for h in r["__hits"]), r["__items"], r["__clean"]) for r in rows}
    assert len(rows) == len(DOCS) and hits[(1, DOCS[0][1])] == (2, ["1"], " here\nown line of one\n")
    assert hits[(2, DOCS[1][1])] == (4, ["1"], "  HERE \n") and hits[(3, None)] == (0, [], "")
    assert decontaminate.find_contamination(docs.limit(0), bench).count() == 0
    many = spark.createDataFrame([(i, f"line of w{i}") for i in range(20)] + [(90, "same line")], "item_id bigint, text string")
    clash = docs.withColumn("__hits", F.lit(1)).withColumn("__words", F.lit("x"))
    some = decontaminate.find_contamination(clash, many, block_words=1, clean=False)  # more blocks than are sent at once
    assert {r["doc_id"] for r in some.where(F.array_contains("__items", "90")).collect()} == {1, 2, 5, None}
    assert decontaminate.find_contamination(docs, bench.limit(0)).where(F.size("__hits") > 0).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(120)]
    rows[7] = (7, rows[0][1])
    rows += [(3, rows[3][1]), (3, rows[9][1]), (50, rows[50][1]), (8, [9.0] * 6), (8, [9.0] * 6), (9, [1.0])]  # repeated ids and rows, a short one
    bad = [(200, None), (201, [float("nan")] * 6), (202, [None] * 6), (None, [1.0] * 6), (203, [float("inf")] * 6), (204, [3e38] * 6)]
    v = top_k.integer_vectors(spark.createDataFrame([(*r, 1) for r in rows + bad], "vec_id bigint, embedding array<float>, score int").select("vec_id", "embedding"))
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in top_k.top_k(v, v.where("vec_id % 50 = 0")).collect())
    ints = [(i, np.floor(256 * np.pad(np.array(x, np.float32), (0, 6 - len(x))).astype(float)).astype(int)) for i, x in rows]
    want = []
    for q in (0, 50, 100):
        scores = sorted((-int(x @ y), i) for j, x in ints if j == q for i, y in ints if i != q)
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores[:5])]
    assert got == sorted(want)
    assert top_k.top_k(v.limit(0), v.limit(0)).count() == 0


def test_top_k_deals_queries_and_vectors(spark, monkeypatch):
    monkeypatch.setattr(top_k, "SHARD_ROWS", 40)
    monkeypatch.setattr(top_k, "GROUP_ROWS", 3)
    rng = np.random.default_rng(1)
    x = rng.integers(-9, 9, (200, 4))
    v = spark.createDataFrame([(i, [int(c) for c in r]) for i, r in enumerate(x)], "vec_id bigint, x array<bigint>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in top_k.top_k(v, v.where("vec_id % 10 = 0")).collect())
    want = [(q, k + 1, i, -s) for q in range(0, 200, 10) for k, (s, i) in enumerate(sorted((-int(x[q] @ x[i]), i) for i in range(200) if i != q)[:5])]
    assert got == sorted(want)


def test_chat(spark):
    rows = [(1, 1, "assistant", "b\\</turn>## ### x"), (1, 0, "user", None), (1, 2, None, "t"), (2, 0, "user", "only"), (None, 0, "a:b\\", "q"), (1, 1, "assistant", "b\\</turn>## ### x")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id bigint, turn bigint, role string, text string, example int")
    back = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_chat(df)).collect()}
    assert [tuple(t) for t in back[1]["turns"]] == [("user", ""), *[("assistant", rows[0][3])] * 2, ("", "t")]
    assert back[1]["losses"] == [rows[0][3]] * 2 and back[2]["losses"] == [] and tuple(back[None]["turns"][0]) == ("a:b\\", "q")
    assert chat_format.format_chat(df.limit(0)).count() == 0


def test_url_filter(spark):
    urls = ["http://a.example.org/es/x", "https://EXAMPLE.org/en/1?q", "x://org", "http://b.com/de/#", None, "nothing", "http://c.com/fr/", "http://badexample.org/es/", "http://a.example.org/es/x"]
    pages = spark.createDataFrame([(i % 7, u, "h") for i, u in enumerate(urls)], "page_id bigint, url string, host string")
    rules = spark.createDataFrame(url_filter.RULES, "verdict string, host string, path string")

    def judge(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = low(re.match("[^/?#]*", rest)[0])
        path = re.match("[^?#]*", rest[len(host) :])[0]
        fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fits)[1:] if fits else (None, "allow")))

    got = [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, rules).collect()]
    assert sorted(map(repr, got)) == sorted(repr((i % 7, *judge(u))) for i, u in enumerate(urls))
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0 and url_filter.filter_urls(pages, rules.limit(0)).where("verdict <> 'allow'").count() == 0


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 80, (60, 2))] + [(i, i + 1) for i in range(100, 120)]
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {x: m for x, m in label.items() if any(x in e and e[0] != e[1] for e in edges)}


def test_simhash(spark, docs):
    rows = simhash.simhash_components(docs).collect()
    ids = {r["doc_id"]: r["component_id"] for r in rows}
    assert len(rows) == len(DOCS) and ids[3] == ids[4] == 3 and ids[7] == 7
    assert simhash.simhash_components(docs.limit(0)).count() == 0
    few = simhash.near_links(spark.createDataFrame([(int(x),) for x in range(64)], "fp bigint"), limit=4)
    assert connected_components(few).where("label <> 0").count() == 0


def test_near_copies_go(spark):
    base = [f"word{i}" for i in range(300)]
    near = list(base)
    near[150] = "other"
    rows = [(3, " ".join(base)), (1, " ".join(near)), (2, " ".join(base)), (9, " ".join(f"z{i}" for i in range(300))), (None, "x"), (5, None), (6, ""), (7, "\t\n"), (8, " ")]
    frame = lambda rows: spark.createDataFrame([(*r, 7) for r in rows], SHAPE + ", shingles int")
    kept = near_dedup_stage.keep_one_of_each(frame(rows)).collect()
    assert sorted(repr(r["doc_id"]) for r in kept) == sorted(map(repr, [1, 9, None, 5])) and {r["shingles"] for r in kept} == {7}
    # repeated rows, an id with two texts of one group, and one with a text of its own
    more = [*rows, (1, " ".join(near)), (1, " ".join(base)), (9, "a text of its own"), (2, "another one"), (None, "x")]
    kept = [(r["doc_id"], len(r["text"] or "")) for r in near_dedup_stage.keep_one_of_each(frame(more)).collect()]
    assert sorted(repr(i) for i, _ in kept) == sorted(map(repr, [1, 9, 9, 2, None, None, 5])) and (2, len("another one")) in kept
    assert near_dedup_stage.keep_one_of_each(frame(rows).limit(0)).count() == 0


def kept_by_all_pairs(rows):
    """The ids that all pairs of rows leave: fingerprints within RADIUS bits and shingles of SIMILARITY are joined."""
    texts = pa.array([t for _, t in rows])
    fp = near_dedup_stage.fingerprints(texts)
    h, at = simhash.shingle_hashes(texts, near_dedup_stage.WIDTH)
    sets = [set(h[a:b].tolist()) for a, b in zip(at[:-1], at[1:])]
    label = [i for i, _ in rows]
    for k in range(len(rows)):
        for j in range(k):
            if int(fp[k] ^ fp[j]).bit_count() <= near_dedup_stage.RADIUS and len(sets[k] & sets[j]) >= near_dedup_stage.SIMILARITY * len(sets[k] | sets[j]):
                old, new = max(label[k], label[j]), min(label[k], label[j])
                label = [new if x == old else x for x in label]
    return sorted(set(label))


def test_near_copies_of_large_groups_go_as_all_pairs_say(spark):
    rng, rows = np.random.default_rng(3), []
    for g in range(25):
        base = [f"w{rng.integers(5000)}" for _ in range(120)]
        for _ in range(60):
            text = list(base)
            for at in rng.integers(0, 120, rng.integers(1, 5)):
                text[at] = f"e{rng.integers(5000)}"
            rows.append((len(rows), " ".join(text)))
    _, first = np.unique(near_dedup_stage.fingerprints(pa.array([t for _, t in rows])), return_index=True)
    rows = [rows[k] for k in np.sort(first)]  # one text for each fingerprint
    got = near_dedup_stage.keep_one_of_each(spark.createDataFrame(rows, SHAPE)).collect()
    assert sorted(r["doc_id"] for r in got) == kept_by_all_pairs(rows)


def test_equal_fingerprints_are_only_candidates(spark):
    rng = np.random.default_rng(4)
    prose = lambda n: " ".join(f"p{rng.integers(9000)}" for _ in range(n))
    rows = [(i, "the same line again " * 200 + prose(250)) for i in range(6)]  # the filler's shingles outnumber the prose's
    rows = [(i, "hm " * 700 + prose(300)) for i in range(6, 12)] + rows
    rows += [(100 + i, t.replace("hm ", "hm hm ", 1) + " x") for i, t in rows]
    base = prose(150).split()
    for i in range(200, 260):
        text = list(base)
        for at in rng.integers(0, 150, 4):
            text[at] = f"e{rng.integers(9000)}"
        rows.append((i, " ".join(text)))
    got = near_dedup_stage.keep_one_of_each(spark.createDataFrame(rows, SHAPE)).collect()
    assert sorted(r["doc_id"] for r in got) == kept_by_all_pairs(rows)
    assert {6, 7, 8, 9, 10, 11} <= {r["doc_id"] for r in got}


@pytest.mark.parametrize("held", [(4096, 4 << 20), (7, 4 << 20), (4096, 900)])
def test_pairs_that_thin_links_leave_out(spark, monkeypatch, held):
    """Many texts of one fingerprint and around it, some alike: whole buckets and buckets in blocks give what all pairs give."""
    monkeypatch.setattr(near_dedup_stage, "HELD_SETS", held[0])
    monkeypatch.setattr(near_dedup_stage, "HELD_SHINGLES", held[1])
    rng, texts = np.random.default_rng(7), []
    for g in range(12):
        base = [f"g{g}w{i}" for i in range(40)]
        texts += [" ".join(w if rng.random() > 0.02 else f"e{rng.integers(9000)}" for w in base) for _ in range(6)]
    digests, sets = near_dedup_stage.shingle_sets(pa.array(texts))
    fps = [int(rng.choice([0, 1, 3, 1 << 40])) if i % 3 else -1 for i in range(len(texts))]
    nodes = spark.createDataFrame([(i, bytearray(d), f, len(x) // 8, i) for i, (d, x, f) in enumerate(zip(digests, sets, fps))], "node bigint, digest binary, fp bigint, size int, doc_id bigint")
    label = list(range(len(texts)))
    for k in range(len(texts)):
        for j in range(k):
            if ((fps[k] ^ fps[j]) & (2**64 - 1)).bit_count() <= 9 and near_dedup_stage.jaccard(sets[k], sets[j]) >= 0.8:
                old, new = max(label[k], label[j]), min(label[k], label[j])
                label = [new if x == old else x for x in label]
    got = near_dedup_stage.near_components(cut(nodes), spark.createDataFrame(list(enumerate(texts)), SHAPE), 9, 0.8).collect()
    assert len(set(label)) < len(texts) and [r["label"] for r in sorted(got, key=lambda r: r["node"])] == label


def test_sentencepiece(spark, docs):
    out = sentencepiece_codec.decode(sentencepiece_codec.encode(docs)).collect()
    assert all(r["decoded"] == (r["text"] or "") for r in out) and len(out) == len(DOCS)
    assert all(r["ids"] == [] for r in out if not r["text"]) and sentencepiece_codec.encode(docs.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["a b", "a  b", "a   b", "a    b", "  a", " a", "a ", " ", "   ", "a  ", "a   ", "x\n    ind", "x\n\n y", "x \n", "a  \n  b", *("a" + " " * n for n in (15, 16, 17, 31, 32, 40)), " " * 33 + "b"])
def test_runs_of_spaces_are_those_of_sentencepiece(text):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(sentencepiece_codec.MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1  # unigram
    want = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString()).encode(text)
    lexicon = sentencepiece_codec.Lexicon()
    ids, offsets = sentencepiece_codec.encode_texts(pa.array(["z  ", text, text, " y"]), lexicon)
    assert ids[offsets[1] : offsets[2]].tolist() == ids[offsets[2] : offsets[3]].tolist() == want
    assert sentencepiece_codec.decode_ids(ids, offsets, lexicon).to_pylist() == ["z  ", text, text, " y"]


def test_toxicity(spark):
    rows = [(i, f"w{i % 7} w{i % 5} " + ("awful" if i % 4 == 0 else "fine")) for i in range(80)] + [(None, "awful"), (500, None)]
    docs = spark.createDataFrame(rows, SHAPE)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(80)] + [(None, 1), (3, None)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    scores = {r["doc_id"]: r["toxicity"] for r in toxicity.score_toxicity(docs, model).collect()}
    assert scores[0] > 0.7 > scores[1] and scores[None] > 0.7 and 0 <= scores[500] < 0.7
    assert toxicity.fit(docs, labels.limit(0)) is None and toxicity.score_toxicity(docs, None).where("toxicity > 0").count() == 0


def test_lm_scores(spark, docs):
    rows = lm_scoring.score_corpus(docs.select("doc_id", "text")).collect()
    assert len(rows) == len(DOCS) and all(np.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", low(t))
    train = [words(t) for (i, t) in DOCS if i is None or __import__("zlib").crc32(str(i).encode()) % 7 != 2]
    count = {}
    for w in (x for ws in train for x in ws):
        count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()) + len(train), len(count) + 1
    want = sorted(round(sum(np.log10((count.get(w, 0) + 1) / (n + v + 1)) for w in words(t)) + np.log10((len(train) + 1) / (n + v + 1)), 6) for _, t in DOCS)
    assert sorted(round(r["base_score"], 6) for r in rows) == want and {r["train_tokens"] for r in rows} == {n}


def test_lm_trains_on_windows_of_all_documents(spark, monkeypatch):
    rows = [(i, f"some words of text {i % 5} and w{i % 3} more " * 4) for i in range(40)]
    seen = []
    real = lm_scoring.train_everywhere
    monkeypatch.setattr(lm_scoring, "train_everywhere", lambda *args: seen.append(real(*args, every=1)))
    for n in (4, 40):
        lm_scoring.fit(spark.createDataFrame(rows[:n], SHAPE), sample=4)
    assert seen[1] > 9 * seen[0] > 0


@pytest.fixture(scope="module")
def scorer(spark):
    rng = np.random.default_rng(2)
    words = [f"{a}{b}" for a in ("some", "under", "inter", "xq") for b in ("thing", "stand", "ing", "zzk", "")]
    return lm_scoring.fit(spark.createDataFrame([(i, " ".join(rng.choice(words, 30))) for i in range(60)], SHAPE))


def test_lm_probabilities_of_all_pieces_sum_to_one(scorer):
    sub, lm = scorer.subwords, scorer.lm
    assert (sub.share < 1).sum() > 30_000  # most pieces have no number of their own
    for word in ("something", "xq", "unseenword", "s"):
        known, count = lm_scoring.pieces_of([word], sub.model)
        k = len(known)
        n, inside = sub.counts.find(lm_scoring.prefix_keys(known, count))
        following = lm_scoring.prefix_keys(np.concatenate([np.append(known, y) for y in range(len(sub.place))]), np.full(len(sub.place), k + 1))
        more, _ = sub.counts.find(following.reshape(-1, k + 1)[:, -1])
        end, _ = sub.counts.find(lm_scoring.end_keys(lm_scoring.prefix_keys(known, count)[-1:]))
        place = np.append(sub.place, lm_scoring.EOS)
        starts = lm.starts[place]
        low = max(n[-1], 1)
        total = len(place)
        shape = (total, lm_scoring.BLOCK)
        ints, floats = [np.zeros(shape, np.int32) for _ in range(3)], [np.zeros(shape, np.float32) for _ in range(3)] + [np.ones(shape, np.float32)]
        tokens = [lm_scoring.PAD, lm_scoring.BOS, *sub.place[known]]
        ints[0][:, : k + 1], ints[1][:, : k + 1], ints[2][:, k] = tokens[:-1], tokens[1:], place
        floats[0][:, k] = np.where(starts, end[0], np.append(more, 0)) / low if n[-1] else 0
        floats[1][:, k], floats[2][:, k] = np.clip(1 - inside[-1] / low, 0, 1) if n[-1] else 0, np.log10(1 + n[-1])
        floats[3][:, k] = np.append(sub.share, 1)
        logs = lm.log10(lm_scoring.Batch(*ints, *floats), np.ones(total, bool))[:, k]
        assert abs((10**logs).sum() - 1) < 2e-3, word


def test_lm_windows_score_each_token_as_one_by_one(scorer):
    lm, b = scorer.lm, lm_scoring.BLOCK
    texts = pa.array(["something under " * 25 + "xqzzk", "", "a", "interstand some " * 9])
    words, at, offsets = lm_scoring.words_of(texts)
    batch, first, place, begin, size = lm_scoring.blocks_of(*lm_scoring.streams(at, offsets, scorer.subwords(words.to_pylist())))
    got = lm.log10(batch, first, step=3).ravel()[place]
    w, d = lm.weights, lm_scoring.AttentionLM.start(np.ones(9) / 9, np.ones(9, bool)).weights["tok"].shape[1]
    flat = {n: getattr(batch, n).ravel()[place] for n in batch.__dataclass_fields__}
    for start, n in zip(begin, size):
        x = [w["tok"][flat["token"][i]] + w["pair"][lm_scoring_pair(flat["before"][i], flat["token"][i])] for i in range(start, start + n)]
        for i in range(n):
            keys = range(max(0, i // b * b - b), i + 1)  # its own block up to itself, and the block before
            q = x[i] @ w["qkv"][:, :d] / d**0.5
            weight = np.exp([q @ (x[j] @ w["qkv"][:, d : 2 * d]) + w["dist"][i - j] for j in keys])
            a = sum(u * (x[j] @ w["qkv"][:, 2 * d :]) for u, j in zip(weight, keys)) / weight.sum()
            o = np.maximum(np.concatenate([x[i], a]) @ w["w1"] + w["b1"], 0) @ w["w2"] + w["b2"]
            gate = np.exp(o[:-1]) / np.exp(o[:-1]).sum()
            at_, share = flat["target"][start + i], flat["share"][start + i]
            sure, rest, ratio = (float(flat[c][start + i]) for c in ("sure", "rest", "ratio"))
            mix, starts = float(gate @ lm.emit[at_]) * share, float(gate @ lm.begin)
            trust = 1 / (1 + np.exp(-(o[-1] + w["known"][0] * sure + w["known"][1] * rest))) if sure > 0 else 0.0
            told = (ratio * mix / starts if lm.starts[at_] else ratio) + rest * mix
            assert abs(np.log10((1 - trust) * mix + trust * told) - got[start + i]) < 2e-3
    assert len(got) == len(at_pieces(scorer, texts)) + len(texts)


def lm_scoring_pair(before, token):
    from loomgraph.llm.attention_lm import pair_place

    return pair_place(np.array([before]), np.array([token]))[0]


def at_pieces(scorer, texts):
    words = [w for t in texts.to_pylist() for w in re.findall(r"[^\x20\x09-\x0D]+", low(t))]
    return lm_scoring.pieces_of(words, scorer.subwords.model)[0]


def test_toxicity_penalty_spares_neutral_mentions(spark):
    """The names stand in toxic texts mostly; the pairs of swapped copies keep them from counting as such."""
    rows = [(i, f"muslim u{i}" + " awful" * (i % 2)) for i in range(60)] + [(100 + i, f"{'jewish' if i % 2 else 'hindu'} u{i}") for i in range(300)]
    docs = spark.createDataFrame(rows, SHAPE)
    labels = spark.createDataFrame([(i, int(i < 60)) for i, _ in rows], "doc_id bigint, toxic int")
    neutral = spark.createDataFrame([(i, f"muslim v{i}") for i in range(20)], SHAPE)
    wrong, weight = [], []
    for penalty in (0.0, toxicity.PENALTY):
        model = toxicity.fit(docs, labels, penalty=penalty)
        wrong.append(toxicity.score_toxicity(neutral, model).where(F.col("toxicity") >= toxicity.THRESHOLD).count())
        w = dict(zip(model.words, model.weights))
        weight.append(w["muslim"] - w["jewish"])
    assert wrong == [20, 0] and abs(weight[1]) < weight[0] / 4


def test_counterfactuals_act_on_the_corpus(spark):
    """Documents of the corpus, of which many toxic and few others mention a group: neutral mentions are spared."""
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").join(labels, "doc_id")
    names = F.element_at(F.array(*map(F.lit, ["muslim", "jewish", "gay"])), (F.col("doc_id") % 3 + 1).cast("int"))
    mention = F.when((F.col("toxic") == 1) & (F.col("doc_id") % 4 != 0) | (F.col("doc_id") % 40 == 0), F.concat("text", F.lit(" "), names)).otherwise(F.col("text"))
    biased = docs.select("doc_id", "toxic", mention.alias("text"))
    neutral = docs.where("toxic = 0 AND doc_id % 2 = 0").select("doc_id", F.concat("text", F.lit(" "), names).alias("text"))
    wrong, pairs = [], []
    for penalty in (0.0, toxicity.PENALTY):
        model = toxicity.fit(biased, labels, penalty=penalty)
        wrong.append(toxicity.score_toxicity(neutral, model).where(F.col("toxicity") >= toxicity.THRESHOLD).count())
        pairs.append(model.pairs)
    assert min(pairs) >= 3 * 300  # every text has its copies
    assert wrong[0] >= 5 and wrong[1] <= wrong[0] / 4, wrong


def test_scores_are_those_of_the_features(spark):
    """The vectorised score equals the sum of the weights of the features as the fit makes them."""
    rng = np.random.default_rng(9)
    stems = ["awful", "terrible", "terribly", "muslim", "disabled", "disgusting", "fine", "gut", "übergröße", "übergrößen"]
    texts = [None, "", "!!", *(" ".join(rng.choice(stems, rng.integers(1, 9))) + rng.choice(["", ".", " ÄÖ"]) for _ in range(40))]
    every = sorted({f for t in texts for f in toxicity.features(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t)))})
    model = toxicity.Model(every, rng.normal(size=len(every)), -0.3)
    weight = dict(zip(model.words, model.weights))
    want = [sum(weight[f] for f in toxicity.features(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t)))) - 0.3 for t in texts]
    assert np.allclose(toxicity.score_texts(pa.array(texts), model), 1 / (1 + np.exp(-np.array(want))))
