"""SentencePiece encoding and decoding by a batched numpy Viterbi.

The pieces and scores of a model file are taken as a unigram lexicon: a text's pieces are those of the highest sum of
scores (of equal ones, that whose last piece is the longest). Pieces have space marks at their beginning only or are runs
of marks, so texts fall to units that begin at a run of marks, and units are solved once per chunk. Units of equal length advance together: for each end and piece length, hashes of all their substrings probe the sorted keys of the
pieces of that length, and vectorised maxima store backpointers. Units of more than LONG characters have all their substrings
probed at once, and the maxima taken one position after the other. Hashes only find: units taken as one are compared character
by character, and so are the pieces of every best path. Characters in no piece become byte pieces. A space mark in the text
itself becomes byte pieces too, so that decoding restores every text exactly.

Scale: one pass over the texts, no shuffle; the lexicon (the model's pieces, some hundred kB) goes to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import CHUNK_BYTES, chunks, table, text_buffer
from .cuckoo import mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK, NEWLINE = 0x2581, 10
#: stands for a space mark that the text itself has
OWN_MARK = 0x110000
UNKNOWN = 1 << 24
#: Units of more characters than this are solved one at a time.
LONG = 256
#: Positions of a long unit whose substrings are probed at once.
PROBES = 1 << 16
#: A character in no piece costs this much more than the worst piece.
UNKNOWN_COST = 10.0
BASE, LENGTH_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse, modulo 2**64."""
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    out = []
    for b in (BASE, inverse):
        p = np.full(n, b, dtype=np.uint64)
        if n:
            p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def prefix_sums(codes: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """S with hash of codes[i:j] = (S[j] - S[i]) * BASE**-i, plus a multiple of its length."""
    out = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(mix(codes.astype(np.uint64) + np.uint64(1)) * powers[: len(codes)], out=out[1:])
    return out


class Lexicon:
    """Pieces by length, keys sorted; what each id stands for; byte pieces."""

    def __init__(self, model: str = MODEL):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]
        special = [sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i) for i in range(len(pieces))]
        byte = [sp.is_byte(i) for i in range(len(pieces))]
        self.byte_ids = np.zeros(256, dtype=np.int64)
        text: list[bytes] = []
        by_length: dict[int, list[tuple[int, int, float]]] = {}
        powers, _ = _powers(64)
        worst = 0.0
        for i, (piece, score) in enumerate(pieces):
            if byte[i]:
                self.byte_ids[int(piece[3:5], 16)] = i
                text.append(bytes([int(piece[3:5], 16)]))
                continue
            text.append(b"" if special[i] else piece.replace(chr(MARK), " ").encode())
            if special[i] or chr(MARK) in piece.lstrip(chr(MARK)) or chr(NEWLINE) in piece:
                continue
            codes = np.array([ord(c) for c in piece], dtype=np.uint32)
            key = int(prefix_sums(codes, powers)[-1])
            by_length.setdefault(len(codes), []).append((key, i, score))
            worst = min(worst, score)
        self.unknown = worst - UNKNOWN_COST
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size, rows in by_length.items():
            rows.sort()
            self.tables[size] = (np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows]))
        self.longest = max(self.tables, default=1)
        spelled = [np.array([ord(c) for c in piece], dtype=np.uint32) for piece, _ in pieces]
        self.codes_at = np.concatenate([[0], np.cumsum([len(x) for x in spelled])]).astype(np.int64)
        self.codes = np.concatenate(spelled) if spelled else np.zeros(0, np.uint32)
        self.exact = {piece: (i, score) for i, (piece, score) in enumerate(pieces) if not (byte[i] or special[i] or chr(MARK) in piece.lstrip(chr(MARK)) or chr(NEWLINE) in piece)}
        self.text = np.frombuffer(b"".join(text), dtype=np.uint8)
        self.text_at = np.concatenate([[0], np.cumsum([len(t) for t in text])]).astype(np.int64)

    def solve(self, sums: np.ndarray, inverse: np.ndarray, codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Best paths of n units of one length: (piece ids or UNKNOWN + code, first to last, all units; how many each).

        sums: (n, size + 1) prefix sums, inverse: (n, size) BASE**-start, codes: (n, size).
        """
        n = len(codes)
        best = np.full((n, size + 1), -np.inf)
        best[:, 0] = 0
        back, piece = np.zeros((n, size + 1), dtype=np.int16 if size < 32768 else np.int64), np.zeros((n, size + 1), dtype=np.int32)
        for end in range(1, size + 1):
            for length in range(min(end, self.longest), 0, -1):
                if (found := self.tables.get(length)) is None and length > 1:
                    continue
                start = end - length
                value = np.full(n, -np.inf)
                ids = np.zeros(n, dtype=np.int64)
                if found is not None:
                    keys, own, scores = found
                    key = (sums[:, end] - sums[:, start]) * inverse[:, start]
                    at = np.searchsorted(keys, key)
                    at[at == len(keys)] = 0
                    hit = keys[at] == key
                    value[hit], ids[hit] = scores[at[hit]], own[at[hit]]
                if length == 1:
                    none = value == -np.inf
                    value[none], ids[none] = self.unknown, UNKNOWN + codes[none, start]
                value += best[:, start]
                better = value > best[:, end]
                best[better, end], back[better, end], piece[better, end] = value[better], length, ids[better]
        at, count = np.full(n, size), np.zeros(n, dtype=np.int64)
        rows, steps = np.arange(n), []
        while len(rows):
            steps.append((rows, piece[rows, at[rows]]))
            count[rows] += 1
            at[rows] -= back[rows, at[rows]]
            rows = rows[at[rows] > 0]
        last = np.cumsum(count)
        out = np.zeros(last[-1] if n else 0, dtype=np.int64)
        for k, (rows, ids) in enumerate(steps):
            out[last[rows] - 1 - k] = ids
        return out, count

    def solve_long(self, sums: np.ndarray, inverse: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The best path of one unit of any length, as solve() gives it. sums: size + 1 prefix sums; inverse, codes: size."""
        size = len(codes)
        best, back, piece = [0.0] + [-np.inf] * size, [0] * (size + 1), [0] * (size + 1)
        for low in range(0, size, PROBES):
            high = min(low + PROBES, size)
            ends, starts, ids, scores = [], [], [], []
            for length in range(self.longest, 0, -1):  # of equal values the longest piece is met first
                begin = np.arange(max(0, low + 1 - length), high + 1 - length)
                if length == 1:
                    value, own = np.full(len(begin), self.unknown), UNKNOWN + codes[begin]
                elif length not in self.tables or not len(begin):
                    continue
                if length in self.tables:
                    keys, all_ids, all_scores = self.tables[length]
                    key = (sums[begin + length] - sums[begin]) * inverse[begin]
                    at = np.searchsorted(keys, key)
                    at[at == len(keys)] = 0
                    hit = keys[at] == key
                    if length == 1:
                        value, own = np.where(hit, all_scores[at], value), np.where(hit, all_ids[at], own)
                    else:
                        begin, value, own = begin[hit], all_scores[at[hit]], all_ids[at[hit]]
                ends.append(begin + length)
                starts.append(begin)
                ids.append(own)
                scores.append(value)
            ends, starts, ids, scores = (np.concatenate(x) for x in (ends, starts, ids, scores))
            order = np.argsort(ends, kind="stable")
            for end, start, own, score in zip(*(x[order].tolist() for x in (ends, starts, ids, scores))):
                if (value := score + best[start]) > best[end]:
                    best[end], back[end], piece[end] = value, end - start, own
        out, at = [], size
        while at:
            out.append(piece[at])
            at -= back[at]
        return np.array(out[::-1], dtype=np.int64)

    def solve_exactly(self, codes: np.ndarray) -> np.ndarray:
        """The same from the pieces themselves, without hashes: for units in which a hash met another piece's."""
        text = "".join(chr(c) if c != OWN_MARK else "\0" for c in codes.tolist())
        best, back, piece = [0.0] + [-np.inf] * len(text), [0] * (len(text) + 1), [0] * (len(text) + 1)
        for end in range(1, len(text) + 1):
            for length in range(min(end, self.longest), 0, -1):
                start = end - length
                found = self.exact.get(text[start:end]) if OWN_MARK not in codes[start:end] else None
                if found is None and length == 1:
                    found = (UNKNOWN + int(codes[start]), self.unknown)
                if found is not None and (value := found[1] + best[start]) > best[end]:
                    best[end], back[end], piece[end] = value, length, found[0]
        out, at = [], len(text)
        while at:
            out.append(piece[at])
            at -= back[at]
        return np.array(out[::-1], dtype=np.int64)

    def spells(self, flat: np.ndarray, count: np.ndarray, codes: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Which ragged rows of count ids (or UNKNOWN + code) are made of the same characters as the rows of size codes."""
        known = flat < UNKNOWN
        at = np.where(known, flat, 0)
        length = np.where(known, self.codes_at[at + 1] - self.codes_at[at], 1)
        owner = np.repeat(np.arange(len(count)), count)
        ok = np.bincount(owner, weights=length, minlength=len(count)).astype(np.int64) == size
        pick = ranges(np.where(known, self.codes_at[at], 0), length)
        spelled = np.where(np.repeat(known, length), self.codes[pick], np.repeat(flat - UNKNOWN, length))
        fine = np.repeat(ok, size)
        rows = np.repeat(np.arange(len(size)), size)[fine]
        wrong = spelled[np.repeat(ok[owner], length)] != codes[fine]
        ok[rows[wrong]] = False
        return ok

    def spell(self, flat: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unknown characters replaced by byte pieces, in ragged rows of count ids."""
        unknown = np.flatnonzero(flat >= UNKNOWN)
        if not len(unknown):
            return flat, count
        raw = [chr(MARK if c == OWN_MARK else c).encode("utf-8", "surrogatepass") for c in (flat[unknown] - UNKNOWN).tolist()]
        sizes = np.ones(len(flat), dtype=np.int64)
        sizes[unknown] = [len(r) for r in raw]
        out = np.repeat(flat, sizes)
        begin = np.cumsum(sizes) - sizes
        places = np.repeat(begin[unknown], sizes[unknown]) + np.concatenate([np.arange(len(r)) for r in raw])
        out[places] = self.byte_ids[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(count)), count)
        return out, np.bincount(owner, weights=sizes, minlength=len(count)).astype(np.int64)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (sizes[0] of them), starts[1], ..."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes - starts, sizes)


def unlike(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, model: np.ndarray) -> np.ndarray:
    """Which ranges of codes differ from the range that model names for each."""
    wrong = sizes != sizes[model]
    rows = np.flatnonzero(~wrong & (model != np.arange(len(model))))
    same = codes[ranges(starts[rows], sizes[rows])] == codes[ranges(starts[model[rows]], sizes[rows])]
    owner = np.repeat(np.arange(len(rows)), sizes[rows])
    wrong[rows[np.unique(owner[~same])]] = True
    return np.flatnonzero(wrong)


#: Cells of a table (units x positions) that one step of the Viterbi may hold.
CELLS = 1 << 18


def encode_texts(texts: pa.Array, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """(all ids, n + 1 offsets); null and empty texts have none."""
    data, offsets = text_buffer(texts)
    n = len(offsets) - 1
    codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    lead = (data & 0xC0) != 0x80
    first = np.concatenate([[0], np.cumsum(lead)])[offsets]  # code points before each text
    full = np.flatnonzero(np.diff(first))
    codes = np.where(codes == MARK, OWN_MARK, np.where(codes == 32, MARK, codes)).astype(np.uint32)
    codes = np.insert(codes, first[full], MARK)
    begins = first[full] + np.arange(len(full))
    new = (codes == MARK) | (codes == NEWLINE)
    new[1:] &= (codes[1:] != MARK) | (codes[:-1] != MARK)
    new[1:] |= codes[:-1] == NEWLINE
    new[begins] = True
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(codes)))
    powers, inverse = _powers(len(codes) + 1)
    sums = prefix_sums(codes, powers)
    keys = (sums[starts + sizes] - sums[starts]) * inverse[starts] + sizes.astype(np.uint64) * LENGTH_MIX
    _, sample, which = np.unique(keys, return_index=True, return_inverse=True)
    other = unlike(codes, starts, sizes, sample[which])  # units that only share a key with the one taken for them
    which[other] = len(sample) + np.arange(len(other))
    sample = np.concatenate([sample, other])
    u_start, u_size = starts[sample], sizes[sample]
    order = np.argsort(u_size, kind="stable")
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    bounds = np.flatnonzero(np.diff(u_size[order], prepend=-1, append=-1))
    for a, b in zip(bounds[:-1], bounds[1:]):
        size = int(u_size[order[a]])
        if size > LONG:
            for row in order[a:b]:
                at = u_start[row]
                one = lexicon.solve_long(sums[at : at + size + 1], inverse[at : at + size], codes[at : at + size].astype(np.int64))
                parts.append((np.array([row]), one, np.array([len(one)])))
            continue
        step = max(1, CELLS // (size + 1))
        for at in range(a, b, step):
            rows = order[at : min(at + step, b)]
            grid = u_start[rows][:, None] + np.arange(size + 1)
            parts.append((rows, *lexicon.solve(sums[grid], inverse[grid[:, :-1]], codes[grid[:, :-1]].astype(np.int64), size)))
    rows, flat, count = (np.concatenate([p[k] for p in parts]) for k in range(3))
    fine = lexicon.spells(flat, count, codes[ranges(u_start[rows], u_size[rows])].astype(np.int64), u_size[rows])
    if not fine.all():
        each = np.split(flat, np.cumsum(count)[:-1])
        for k in np.flatnonzero(~fine):
            each[k] = lexicon.solve_exactly(codes[u_start[rows[k]] : u_start[rows[k]] + u_size[rows[k]]])
        flat, count = np.concatenate(each), np.array([len(x) for x in each])
    flat, count = lexicon.spell(flat, count)
    u_at, u_count = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
    u_at[rows], u_count[rows] = np.cumsum(count) - count, count
    ids = flat[ranges(u_at[which], u_count[which])]
    total = np.concatenate([[0], np.cumsum(u_count[which])])
    out = np.zeros(n + 1, dtype=np.int64)
    ends = np.append(np.searchsorted(starts, begins)[1:], len(starts)) if len(full) else np.zeros(0, int)
    per_text = np.zeros(n, dtype=np.int64)
    per_text[full] = total[ends] - total[np.searchsorted(starts, begins)]
    np.cumsum(per_text, out=out[1:])
    return ids, out


def decode_ids(ids: np.ndarray, offsets: np.ndarray, lexicon: Lexicon) -> pa.Array:
    """The texts of ragged rows of ids: the pieces' texts joined, less one leading space."""
    begin, size = lexicon.text_at[ids], np.diff(lexicon.text_at)[ids]
    raw = lexicon.text[ranges(begin, size)]
    at = np.concatenate([[0], np.cumsum(size)])[offsets]
    full = np.diff(at) > 0
    drop = at[:-1][full]
    drop = drop[raw[drop] == 32]
    raw = np.delete(raw, drop)
    at = at - np.searchsorted(drop, at, side="left")
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw)))


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """docs (text, any other columns) with ids array<int> for each row; a column of that name is replaced.

    Null and empty texts have no ids; repeated rows are kept; a text of any length is encoded whole, one without spaces as a
    single unit; an empty table gives an empty result.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    lexicon, plain = Lexicon(model), docs.drop("ids")
    shape = T.StructType([*plain.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    schema = to_arrow_schema(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text", CHUNK_BYTES // 4):
            ids, offsets = encode_texts(b.column("text"), lexicon)
            made = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([made.cast(f.type) if f.name == "ids" else b.column(f.name).cast(f.type) for f in schema], schema=schema)

    return plain.mapInArrow(run, shape)


def decode(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """rows (ids array<int>, any other columns) with decoded, the text of ids; null ids give an empty text."""
    from pyspark.sql.pandas.types import to_arrow_schema

    lexicon, plain = Lexicon(model), rows.drop("decoded")
    shape = T.StructType([*plain.schema.fields, T.StructField("decoded", T.StringType())])
    schema = to_arrow_schema(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                lists = part.column("ids")
                size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                ids = pc.fill_null(pc.list_flatten(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                text = decode_ids(ids, np.concatenate([[0], np.cumsum(size)]), lexicon)
                yield pa.RecordBatch.from_arrays([text.cast(pa.string()).cast(f.type) if f.name == "decoded" else part.column(f.name).cast(f.type) for f in schema], schema=schema)

    return plain.mapInArrow(run, shape)


def query(spark: SparkSession, sf_dir: str, model: str = MODEL) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    both = decode(encode(docs, model), model)
    return both.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == F.col("text")).alias("exact"))
