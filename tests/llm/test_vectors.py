"""The numpy parts against brute force, without Spark."""

import base64
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import decontaminate, line_dedup, lm_scoring, near_dedup_stage, secret_scan, sentencepiece_codec, simhash, top_k, toxicity
from loomgraph.llm.common import chunks, runs, string_views, text_buffer
from loomgraph.llm.cuckoo import CuckooFilter
from loomgraph.llm.fm_index import FMIndex
from loomgraph.llm.xxh64 import xxh64

ODD = [None, "", " ", "a", "A b\tC\n\nd  e", "é Ü ß", "x " * 300, "0a" * 40, "漢字 𝒳 かな", "a\x0bb\x0cc\r\n"]
texts = st.lists(st.one_of(st.none(), st.text(alphabet="aAbé \n\t.#<\\/0漢", max_size=30)), max_size=8)


def low(s):
    return (s or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


@given(texts)
@settings(max_examples=60, deadline=None)
def test_runs_and_views_are_the_words(rows):
    data, offsets = text_buffer(pa.array(rows, pa.string()))
    space = np.isin(data, [9, 10, 11, 12, 13, 32])
    starts, ends = runs(~space, offsets)
    want = [w for s in rows for w in re.findall(r"[^\x20\x09-\x0D]+", s or "")]
    assert string_views(data, starts, ends).to_pylist() == want


def test_chunks_keep_all_rows():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * n for n in (5, 50, 1, 0, 7)] + [None]})
    assert [r for b in chunks([batch], "text", 8) for r in b.column("text").to_pylist()] == batch.column("text").to_pylist()


@given(st.lists(st.binary(max_size=90), min_size=1, max_size=20), st.integers(0, 2**63))
@settings(max_examples=60, deadline=None)
def test_xxh64(parts, seed):
    data = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    got = xxh64(data, ends - [len(p) for p in parts], ends, seed)
    assert got.tolist() == [xxhash.xxh64_intdigest(p, seed) for p in parts]


def fingerprint(s):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(s))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


@given(texts)
@settings(max_examples=40, deadline=None)
def test_fingerprints(rows):
    assert simhash.fingerprints(pa.array(rows + ODD, pa.string())).tolist() == [fingerprint(s) for s in rows + ODD]


@pytest.mark.parametrize("radius", [1, 3, 7])
def test_covering_masks_miss_no_pair(radius):
    masks, rng = simhash.covering_masks(radius), np.random.default_rng(radius)
    for _ in range(300):
        flip = sum(1 << int(i) for i in rng.choice(64, radius, replace=False))
        assert any(flip & m == 0 for m in masks)
    free = [i for i in range(64) if not masks[0] >> i & 1]
    for _ in range(100):  # what collides in a table collides in one of its finer ones
        flip = sum(1 << int(i) for i in rng.choice(free, radius, replace=False))
        assert any(flip & m == 0 for m in simhash.finer_masks(masks[0], radius))


def test_masks_of_two_halves_miss_no_pair():
    masks, rng = simhash.covering_masks(9, 2), np.random.default_rng(9)
    assert len(masks) == 62 and min(m.bit_count() for m in masks) >= 15
    for n in range(1, 10):
        for _ in range(100):
            flip = sum(1 << int(i) for i in rng.choice(64, n, replace=False))
            assert any(flip & m == 0 for m in masks)


def test_few_pairs_are_all_given():
    x = np.random.default_rng(6).integers(-(2**62), 2**62, 900)
    x = np.concatenate([x, x[:40] ^ 5])
    want = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if (int(x[i] ^ x[j]) & (2**64 - 1)).bit_count() <= 9}
    assert set(zip(*(c.tolist() for c in simhash.close_pairs(x, 9, 10**6)))) == want and len(want) >= 40
    assert simhash.close_pairs(x, 64, 1000) is None


def test_forest_joins_what_all_pairs_join():
    rng = np.random.default_rng(0)
    base = rng.integers(-(2**62), 2**62, 4)
    x = np.unique(np.concatenate([base ^ (1 << int(b)) ^ (1 << int(c)) for b, c in rng.integers(0, 62, (30, 2))]))
    u, v = simhash.forest(x, 3)

    def groups(edges):
        label = {int(i): int(i) for i in x}
        for a, b in edges:
            a, b = label[int(a)], label[int(b)]
            label = {k: min(a, b) if r in (a, b) else r for k, r in label.items()}
        return label

    pairs = [(a, b) for i, a in enumerate(x) for b in x[i + 1 :] if bin(int(a ^ b) & (2**64 - 1)).count("1") <= 3]
    assert groups(zip(u, v)) == groups(pairs) and len(u) < len(x)


def test_cuckoo_filter():
    keys = np.random.default_rng(1).integers(0, 2**63, 20_000).astype(np.uint64)
    f = CuckooFilter(20_000)
    assert not f.insert(keys[:10_000]).any()
    f.insert(keys[10_000:])
    assert f.contains(keys).all() and f.insert(keys[:50]).all()
    f.delete(keys[:10_000])
    assert f.contains(keys[10_000:]).all() and f.contains(keys[:10_000]).mean() < 0.001
    again = CuckooFilter.from_bytes(f.to_bytes())
    assert again.used == f.used and (again.table == f.table).all()
    with pytest.raises(OverflowError):
        CuckooFilter(4).insert(keys[:100])


def test_shards_hold_each_key_once():
    h = np.random.default_rng(2).integers(0, 2**62, 3000)
    rows = pa.table({"shard": pa.array(np.zeros(3000, np.int32)), **{c: h for c in ("h1", "h2", "first_doc", "last_doc", "lines")}, "old": np.zeros(3000, bool)})
    out = line_dedup._fill_shard(rows)
    f = CuckooFilter.from_bytes(out.column("filter")[-1].as_py())
    assert out.num_rows == 3001 and f.contains(h.astype(np.uint64)).all() and f.used == 3000
    more = line_dedup._insert_shard(pa.table({"shard": pa.array([0], pa.int32()), "filter": pa.array([f.to_bytes()], pa.binary()), "room": [f.room()]}), rows.slice(0, 50))
    assert sum(x.as_py() is True for x in more.column("held")) == 50


@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=4), min_size=1, max_size=5))
@settings(max_examples=80, deadline=None)
def test_fm_index(seq, patterns):
    index = FMIndex(np.array(seq))
    grid = np.zeros((len(patterns), 4), int)
    for i, p in enumerate(patterns):
        grid[i, : len(p)] = p
    lo, hi = index.search(grid, np.array([len(p) for p in patterns]))
    for p, a, b in zip(patterns, lo, hi):
        want = [i for i in range(len(seq) - len(p) + 1) if seq[i : i + len(p)] == p]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_windows_of_texts():
    items = [("1", "one two three".split()), ("2", [f"w{i}" for i in range(12)]), (None, ["zed"]), ("3", [])]
    w = decontaminate.Windows([(n, [x.encode() for x in ws]) for n, ws in items], 10)
    rows = [None, "", "ONE, two. Three!", "x w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 y", "zed one two", "one two", "three one two three zed"]
    n, spans, names = decontaminate.search_chunk(pa.array(rows), w)
    assert n.tolist() == [0, 0, 3, 13, 3, 2, 5]
    offset = np.cumsum(n) - n
    assert [[(a - o, b - o) for a, b in s] for s, o in zip(spans, offset)] == [[], [], [(0, 3)], [(1, 12)], [(0, 1)], [], [(1, 5)]]
    assert [sorted(x) for x in names] == [[], [], ["1"], ["2"], [], [], ["1"]]


def der(tag, body):
    return bytes([tag]) + (bytes([len(body)]) if len(body) < 128 else b"\x82" + len(body).to_bytes(2, "big")) + body


def field(body):
    return len(body).to_bytes(4, "big") + body


OID = der(6, b"\x2a\x86\x48\x86\xf7\x0d\x01\x01\x01")
PKCS8 = der(0x30, der(2, b"\0") + der(0x30, OID + der(5, b"")) + der(4, bytes(range(60))))
RSA = der(0x30, der(2, b"\0") + b"".join(der(2, bytes([7 + k]) * 40) for k in range(8)))
SEC1 = der(0x30, der(2, b"\1") + der(4, bytes(range(1, 33))) + der(0xA0, OID))
DSA = der(0x30, der(2, b"\0") + der(2, b"\7" * 128) + der(2, b"\7" * 20) + der(2, b"\5" * 128) + der(2, b"\3" * 128) + der(2, b"\2" * 20))
LOCKED = der(0x30, der(0x30, der(6, b"\x2a\x86\x48\x86\xf7\x0d\x01\x05\x0d") + der(0x30, der(4, b"salt"))) + der(4, bytes(64)))
PUBLIC = der(0x30, der(0x30, OID + der(5, b"")) + der(3, bytes(90)))
SIGNATURE = der(0x30, der(2, b"\7" * 32) + der(2, b"\5" * 32))
OPENSSH = b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(field(b"ssh-ed25519") + field(bytes(32))) + field(bytes(136))
SSH_PUBLIC = field(b"ssh-rsa") + field(b"abc") + field(bytes(32))


@pytest.mark.parametrize(("data", "kind"), [(PKCS8, "der"), (RSA, "der"), (SEC1, "der"), (DSA, "der"), (LOCKED, "der"), (OPENSSH, "ssh"), (PUBLIC, None), (SIGNATURE, None), (SSH_PUBLIC, None), (b"openssh-key-v1\0" + b"plain words " * 9, None), (RSA[:-1], None), (PKCS8 + b"\0", None), (OPENSSH + b"\0", None)])
def test_shapes_of_keys(data, kind):
    for text in (base64.b64encode(data).decode(), base64.urlsafe_b64encode(data).decode().rstrip("="), data.hex(), data.hex().upper()):
        got = [(s, secret_scan.KINDS[k], e) for s, k, e in secret_scan.scan_text(f"a {text} b") if secret_scan.KINDS[k] in ("der", "ssh")]
        assert got == ([(2, kind, 2 + len(text))] if kind else []), text


def test_secrets():
    armour = lambda kind, body: f"-----BEGIN {kind}-----\n{body}-----END {kind}-----"
    pem = armour("PRIVATE KEY", base64.encodebytes(PKCS8).decode())
    locked = armour("RSA PRIVATE KEY", "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC," + "0A" * 16 + "\n\n" + base64.encodebytes(bytes(range(64))).decode())
    token = lambda head: base64.urlsafe_b64encode(head).decode().rstrip("=") + ".e30.abc"
    jwt, spaced = token(b'{"alg":"HS256","typ":"JWT"}'), token(b'{ "alg": "HS256" }')
    rows = ["password = 'hunter2hunter2'", "passwd:short", "AKIA" + "A" * 12, "AKIAAB", "0123456789abcdef" * 2, pem, jwt, spaced, "eyJhbm90aGVyIjoxfQ.e30.x", "A" * 80, "ſecret=abcdefghijk", None, "Token" * 3 + "=aaaaaaaaaaaa", locked, armour("RSA PRIVATE KEY", "bm90IGEga2V5\n")]
    kinds = [[secret_scan.KINDS[k] for _, k, _ in secret_scan.scan_text(r or "")] for r in rows]
    assert kinds == [["assign"], [], ["access"], [], ["hex"], ["pem"], ["jwt"], ["jwt"], [], [], [], [], ["assign"], ["pem"], []]
    data, offsets = text_buffer(pa.array(rows))
    assert {i for i, k in enumerate(kinds) if k} <= secret_scan.touched(data, offsets)


def base_spans(text):
    """The three base kinds by a walk over the characters."""
    out, value, upper, hexes = [], set(secret_scan.CODE_BYTES.nonzero()[0].tolist()), "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "0123456789abcdef"
    value = {chr(c) for c in value if chr(c) in "+/_.=-" or chr(c).isalnum()}
    i = 0
    while i < len(text):
        end = None
        for word in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if low(text[i : i + len(word)]) != word:
                continue
            j = i + len(word)
            j += text[j : j + 1] in ('"', "'") and j < len(text)
            while text[j : j + 1] == " ":
                j += 1
            if text[j : j + 1] not in (":", "="):
                continue
            j += 1
            while text[j : j + 1] == " ":
                j += 1
            j += text[j : j + 1] in ('"', "'") and j < len(text)
            k = j
            while k < len(text) and text[k] in value:
                k += 1
            if k > j:
                end = k
                if k - j >= 8:
                    out.append((i, 0, k))
                break
        i = end or i + 1
    for kind, lead, chars, least in ((1, "AKIA", upper, 16), (2, "", hexes, 32)):
        i = 0
        while i < len(text):
            j = i + len(lead)
            k = j
            while text.startswith(lead, i) and k < len(text) and text[k] in chars:
                k += 1
            if k > j and k - i >= least:
                out.append((i, kind, k))
            i = k if k > j else i + 1
    return sorted(out)


@given(st.lists(st.sampled_from(["password", "Secret", "api_key", "APIKEY", "token", "=", ": ", " ", "'", '"', "AKIA", "ABCDEF0123", "abcdef01", "0123456789abcdef", "é", "\n", "x-y", "==", "漢"]), max_size=30))
@settings(max_examples=300, deadline=None)
def test_base_spans_are_those_of_a_plain_walk(parts):
    text = "".join(parts)
    assert [x for x in secret_scan.scan_text(text) if x[1] < 3] == base_spans(text)
    data, offsets = text_buffer(pa.array(["plain", text, ""]))
    assert not base_spans(text) or 1 in secret_scan.touched(data, offsets)


def test_impact_index_is_exact():
    rng = np.random.default_rng(3)
    x = rng.integers(-40, 40, (700, 12))
    x[100:160] = x[5]
    index = top_k.ImpactIndex(np.arange(700), x)
    for q in (0, 5, 130, 699):
        scores, rows = index.search(x[q], 5, q)
        got = [(int(scores[i]), int(rows[i])) for i in top_k.best(scores, rows, 5)]
        all_ = x @ x[q]
        want = sorted(((int(all_[i]), i) for i in range(700) if i != q), key=lambda t: (-t[0], t[1]))[:5]
        assert got == want


def test_large_products_are_exact_or_an_error():
    x = np.array([[1 << 40, 1], [1 << 40, 0], [-(1 << 40), 7], [5, 5]])
    index = top_k.ImpactIndex(np.arange(4), x)
    scores, rows = index.search(np.array([1 << 20, 1]), 2, 9)
    assert [(int(scores[i]), int(rows[i])) for i in top_k.best(scores, rows, 2)] == [((1 << 60) + 1, 0), (1 << 60, 1)]
    with pytest.raises(OverflowError):
        index.search(np.array([1 << 30, 1]), 2, 9)


def test_swapped_names_stop_counting():
    names = toxicity.GROUPS[0].split()
    rng = np.random.default_rng(4)
    docs, label = [], []
    for i in range(600):
        bad = i % 2
        docs.append([f"w{rng.integers(30)}" for _ in range(6)] + (["awful"] if bad and i % 10 else []) + (["muslim"] if bad and i % 3 == 0 else []))
        label.append(bad)
    words = sorted({w for d in docs for w in d} | set(names))
    place = {w: i for i, w in enumerate(words)}
    rows = [sorted({place[w] for w in d}) for d in docs]
    swap = toxicity.swaps()["muslim"]
    pairs = [(r, sorted({place[swap[0] if w == "muslim" else w] for w in d})) for r, d in zip(rows, docs) if "muslim" in d]
    free, _ = toxicity.fit_weights(rows, np.array(label, float), [], len(words))
    held, _ = toxicity.fit_weights(rows, np.array(label, float), pairs, len(words), 50.0)
    gap = lambda w: abs(w[place["muslim"]] - w[place[swap[0]]])
    assert gap(held) < 0.3 * gap(free) and held[place["awful"]] > 1


@pytest.fixture(scope="module")
def lexicon():
    return sentencepiece_codec.Lexicon()


def viterbi(lexicon, text):
    """Best paths by a dictionary of the pieces: the highest sum, of equal ones the longest last piece."""
    text = " " + text if text else ""
    best = [(0.0, [])]
    for end in range(1, len(text) + 1):
        found = []
        for start in range(max(0, end - lexicon.longest), end):
            part = text[start:end].replace(" ", "\u2581")
            own = "\u2581" in text[start:end]  # a mark of the text itself is no space
            piece = None if own else lexicon.exact.get(part)
            if piece is None and end - start == 1:
                raw = text[start:end].encode()
                piece = ([int(lexicon.byte_ids[b]) for b in raw], lexicon.unknown)
            elif piece is not None:
                piece = ([piece[0]], piece[1])
            if piece:
                found.append((best[start][0] + piece[1], end - start, best[start][1], piece[0]))
        score, _, before, ids = max(found, key=lambda f: (f[0], f[1]))
        best.append((score, before + ids))
    return best[-1][1]


@given(st.lists(st.text(alphabet="abest hing\n\u2581é漢 ", max_size=40), min_size=1, max_size=6))
@settings(max_examples=60, deadline=None)
def test_encoding_is_the_best_path(lexicon, rows):
    ids, at = sentencepiece_codec.encode_texts(pa.array(rows), lexicon)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [viterbi(lexicon, t) for t in rows]
    assert sentencepiece_codec.decode_ids(ids, at, lexicon).to_pylist() == rows


def test_words_of_the_corpus_are_best_paths(lexicon):
    import pyarrow.parquet as pq

    texts = [t for t in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"])["text"].to_pylist() if t and len(t) < 3000][:60]
    ids, at = sentencepiece_codec.encode_texts(pa.array(texts), lexicon)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [viterbi(lexicon, t) for t in texts]


def test_units_that_share_a_hash_stay_apart(lexicon):
    for n in (1024, 2048):  # polynomial hashes modulo 2**64 can not tell these two
        morse = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
        pair = [morse, morse.translate(str.maketrans("ab", "ba")), morse]
        ids, at = sentencepiece_codec.encode_texts(pa.array(pair), lexicon)
        assert sentencepiece_codec.decode_ids(ids, at, lexicon).to_pylist() == pair
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [viterbi(lexicon, t) for t in pair]


def test_long_units_and_exact_paths_agree(lexicon):
    rng = np.random.default_rng(8)
    text = "".join(rng.choice(list("etaoinshrdlu.é"), 400_000))
    ids, at = sentencepiece_codec.encode_texts(pa.array([text, text[:3000]]), lexicon)
    assert sentencepiece_codec.decode_ids(ids, at, lexicon).to_pylist() == [text, text[:3000]]
    assert ids[at[1] : at[2]].tolist() == viterbi(lexicon, text[:3000])
    codes = np.array([0x2581, *(ord(c) for c in "something é")])
    flat, count = lexicon.spell(lexicon.solve_exactly(codes[:10]), np.array([1]))
    assert flat.tolist() == viterbi(lexicon, "something")


def test_training_windows_are_the_texts():
    """All windows of texts put one after the other read every token of each text once."""
    words = [0, 25, 12, 1]  # of each text; word w has w % 3 + 1 pieces
    at = np.concatenate([np.arange(n) for n in words])
    offsets = np.concatenate([[0], np.cumsum(words)])
    count = np.arange(25) % 3 + 1
    number = 100 + np.arange(count.sum())
    word = (number, *(number / 1000.0 for _ in range(4)), count)
    pick, edges, begins, closes = lm_scoring.chosen_windows(at, offsets, np.array([3, 5, 7, 9]), every=1)
    b = lm_scoring.window_rows(*lm_scoring.streams(pick, edges, word), begins, closes)
    live = b.target != lm_scoring.PAD
    pieces = [np.concatenate([np.arange((np.cumsum(count) - count)[w], np.cumsum(count)[w]) for w in range(n)]) + 100 if n else np.zeros(0, int) for n in words]
    assert b.target[live & (b.target == lm_scoring.EOS)].size == 4 and (b.token[live] == lm_scoring.BOS).sum() == 4
    inner = live & (b.target != lm_scoring.EOS)
    # windows of 12 words: all pieces but the first of the windows inside a text are targets
    assert inner.sum() == sum(map(len, pieces)) - 2
    read = live & (b.token != lm_scoring.BOS)
    assert np.allclose(b.ratio[read], b.token[read] / 1000) and np.allclose(b.share[inner], b.target[inner] / 1000)
    follow = inner & (b.token != lm_scoring.BOS)
    pairs = {(x, y) for p in pieces for x, y in zip(p, p[1:])}
    assert set(zip(b.token[follow].tolist(), b.target[follow].tolist())) <= pairs
    few = lm_scoring.chosen_windows(np.zeros(12_000, int), np.array([0, 12_000]), np.array([1]), every=10)[1]
    assert 60 < len(few) - 1 < 140


def test_sketches_let_all_alike_sets_pass():
    rng = np.random.default_rng(8)
    for n in (0, 1, 5, 60, 146, 700, 5000):
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        for share in (0.5, 0.8, 0.88, 0.9, 1.0):
            kept = a[rng.random(len(a)) < share]
            b = np.unique(np.concatenate([kept, rng.integers(0, 2**64, int(n * (1 - share)), dtype=np.uint64)]))
            x, y = (np.frombuffer(near_dedup_stage.sketch(s.tobytes()), np.uint64)[None] for s in (a, b))
            told = [bool(near_dedup_stage.may_be_alike(p, np.array([m]), q, k, 0.8)[0]) for p, m, q, k in ((x, len(a), y, len(b)), (y, len(b), x, len(a)))]
            alike = near_dedup_stage.jaccard(a.tobytes(), b.tobytes())
            assert told[0] == told[1]
            assert told[0] if alike >= 0.8 else n < 60 or alike > 0.7 or not told[0]


def test_links_of_first_tables_join_what_all_pairs_join():
    rng = np.random.default_rng(9)
    tables = np.array([simhash.signed(m) for m in simhash.covering_masks(9, 2)])
    base = rng.integers(-(2**62), 2**62, 3)
    x = np.unique(np.concatenate([base, *(b ^ np.bitwise_xor.reduce(np.int64(1) << rng.integers(0, 62, (150, 5)), axis=1) for b in base)]))
    close = {(i, j) for i in range(len(x)) for j in range(i) if (int(x[i] ^ x[j]) & (2**64 - 1)).bit_count() <= 9}
    met, opened = set(), set()
    for k, m in enumerate(tables):
        s = x[np.lexsort((x, x & m))]
        u, v, o = simhash.links(simhash.bucket_starts(s & m), s, 9, np.full(len(s), k), tables)
        pairs = [tuple(sorted(p, reverse=True)) for p in zip(np.searchsorted(x, u).tolist(), np.searchsorted(x, v).tolist())]
        assert not met & set(pairs) and len(set(pairs)) == len(pairs)  # each in one table only
        met |= set(pairs)
        opened |= set(np.searchsorted(x, o).tolist())
    assert met <= close and len(met) < len(close)
    assert all(i in opened and j in opened for i, j in close - met)

    def groups(edges):
        up = list(range(len(x)))

        def root(i):
            while up[i] != i:
                i = up[i]
            return i

        for i, j in edges:
            a, b = sorted((root(i), root(j)))
            up[b] = a
        return [root(i) for i in range(len(x))]

    assert groups(met) == groups(close)
