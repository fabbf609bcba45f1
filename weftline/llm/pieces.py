"""SentencePiece encoding and decoding with seeded merge-dropout.

Pieces and scores come from a merge-type model file. A text is cut where no piece can cross (before runs of spaces and around line ends and tabs);
each unit's candidate merges are on an agenda by score, leftmost first, and a candidate is skipped for good if a keyed hash of its place and unit
falls below the dropout rate. The key is the seeded hash of the whole text and the unit's number in it, so that each occurrence of a unit, in one text as
over the corpus, is segmented by draws of its own, yet reruns agree. Characters without a piece become byte pieces; a literal U+2581 does too, so decoding gives back every text exactly.

A slice's units are segmented together, short ones whose draws agree once for all of them: short ones in NumPy, all at the same step of their agendas, long ones with a heap each. Only a
slice of a few MB is held at a time.

Nulls: a null text gives null ids, null counts and lossless true; an empty text no ids. Repeated rows give repeated results. An empty table gives an
empty result. Other columns aren't read. With dropout 0 the ids are those of the sentencepiece library.
"""

from __future__ import annotations

import heapq
import re
from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import column_bytes, slices, table

MODEL, DROPOUT, SEED = "/opt/tokenizers/piece_bpe_32k.model", 0.1, 17
SLICE_BYTES, SHORT, FEW = 3 << 20, 24, 5
SPACE = "▁"
UNITS = re.compile(f"{SPACE}*[^{SPACE}\n\r\t]+|{SPACE}+|[\n\r\t]+")
#: Stands for a literal U+2581 while a text is cut: a character that no decoded text can hold.
LITERAL = "\ud800"
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(unit, start, mid, end):
    """The keyed hash of a candidate merge; works on numbers and arrays of unsigned 64 bits."""
    with np.errstate(over="ignore"):
        z = np.uint64(unit) if np.isscalar(unit) else unit
        z = z + M1 * (np.uint64(start) if np.isscalar(start) else start) + M2 * (np.uint64(mid) if np.isscalar(mid) else mid) + M3 * (np.uint64(end) if np.isscalar(end) else end)
        z = (z ^ (z >> np.uint64(30))) * M2
        z = (z ^ (z >> np.uint64(27))) * M3
        return z ^ (z >> np.uint64(31))


class Pieces:
    """A merge-type model: ids, scores and the pairs that merge."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        p = SentencePieceProcessor(model_proto=model)
        n = p.get_piece_size()
        self.n, names = n, [p.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))]
        self.id_of = {names[i]: i for i in normal}
        self.score = np.array([p.get_score(i) for i in range(n)], np.float64)
        self.byte = np.zeros(256, np.int32)
        self.bytes_of = [b""] * n
        for i in range(n):
            if p.is_byte(i):
                self.byte[int(names[i][3:5], 16)] = i
                self.bytes_of[i] = bytes([int(names[i][3:5], 16)])
            elif names[i] in self.id_of:
                self.bytes_of[i] = names[i].replace(SPACE, " ").encode()
        # characters that occur in pieces but are none get numbers above n while units are merged
        self.char = {c: self.id_of[c] for name in self.id_of for c in name if c in self.id_of}
        self.extra = sorted({c for name in self.id_of for c in name} - self.char.keys())
        self.char |= {c: n + k for k, c in enumerate(self.extra)}
        pairs = {}
        for name, i in self.id_of.items():
            for k in range(1, len(name)):
                a, b = (self.id_of.get(x, self.char.get(x)) for x in (name[:k], name[k:]))
                if a is not None and b is not None:
                    pairs[a << 32 | b] = i
        self.of_point = np.full(0x110000, -1, np.int32)
        for c, i in self.char.items():
            self.of_point[ord(c)] = i
        self.keys = np.array(sorted(pairs), np.uint64)
        self.into = np.array([pairs[int(k)] for k in self.keys], np.int32)
        self.worth = self.score[self.into].astype(np.float32)  # scores are 32-bit numbers in model files
        self.pairs = pairs
        from weftline.llm.ppm import Finder

        self.find = Finder(self.keys)

    def symbols(self, unit: str) -> list[int]:
        """A unit's characters: their numbers, or -1 - k for the k-th of no piece."""
        return [self.char.get(c, -1) for c in unit]

    def closed(self, ids: list[int], unit: str, ends: list[int]) -> list[int]:
        """Symbols to ids of the model: what is no piece becomes byte pieces."""
        out, a = [], 0
        for i, b in zip(ids, ends):
            if 0 <= i < self.n:
                out.append(i)
            else:
                out += self.byte[list(unit[a:b].replace(LITERAL, SPACE).encode("utf-8", "surrogateescape"))].tolist()
            a = b
        return out

    def by_heap(self, unit: str, key: int, dropout: float) -> list[int]:
        """One unit by its agenda."""
        ids = self.symbols(unit)
        n = len(ids)
        left, right, end = list(range(-1, n - 1)), [*range(1, n), -1], list(range(1, n + 1))
        bar = int(dropout * 2.0**64)
        agenda: list[tuple] = []

        def offer(a: int):
            b = right[a] if a >= 0 else -1
            if a < 0 or b < 0 or ids[a] < 0 or ids[b] < 0:
                return
            into = self.pairs.get(ids[a] << 32 | ids[b])
            if into is not None and int(mixed(key, a, b, end[b])) >= bar:
                heapq.heappush(agenda, (-self.score[into], a, b, end[b], into))

        for a in range(n):
            offer(a)
        gone = [False] * n
        while agenda:
            _, a, b, e, into = heapq.heappop(agenda)
            if gone[a] or gone[b] or right[a] != b or end[b] != e:
                continue
            ids[a], end[a], gone[b] = into, e, True
            right[a] = right[b]
            if right[b] >= 0:
                left[right[b]] = a
            offer(left[a])
            offer(a)
        stay = [k for k in range(n) if not gone[k]]
        return self.closed([ids[k] for k in stay], unit, [end[k] for k in stay])

    def by_steps(self, units: list[str], keys: np.ndarray, dropout: float) -> tuple[np.ndarray, np.ndarray]:
        """Units of similar length together: each step merges the best candidate of each unit that has one. All ids in unit order, and their numbers.

        The tables have a column for each unit and a row for each place, so every operation runs along all units at once.
        """
        n, sizes = len(units), np.array([len(u) for u in units], np.int16)
        width = int(sizes.max())
        ids = np.full((width + 1, n), -1, np.int32)
        cols = np.repeat(np.arange(n), sizes)
        rows = np.arange(len(cols)) - np.repeat(np.cumsum(sizes, dtype=np.int64) - sizes, sizes)
        ids[rows, cols] = self.of_point[np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)]
        start = np.minimum(np.arange(width + 2, dtype=np.int16)[:, None], sizes[None, :])  # of each symbol; behind the last one the unit's end
        bar = np.uint64(min(int(dropout * 2.0**64), 2**64 - 1))
        never = np.float32(-np.inf)

        def offers(a, b, s, m, e, key):
            into, worth = np.full(len(a), -1, np.int32), np.full(len(a), never, np.float32)
            ok = np.flatnonzero((a >= 0) & (b >= 0))
            at = self.find((a[ok].astype(np.uint64) << np.uint64(32)) | b[ok].astype(np.uint64))
            fits = at >= 0
            ok, at = ok[fits], at[fits]
            if dropout > 0:
                stay = mixed(key[ok], s[ok].astype(np.uint64), m[ok].astype(np.uint64), e[ok].astype(np.uint64)) >= bar
                ok, at = ok[stay], at[stay]
            into[ok] = self.into[at]
            worth[ok] = self.worth[at]
            return into, worth

        into, worth = np.full((width, n), -1, np.int32), np.full((width, n), never, np.float32)
        r, c = np.nonzero(np.arange(width, dtype=np.int16)[:, None] + 1 < sizes[None, :])
        into[r, c], worth[r, c] = offers(ids[r, c], ids[r + 1, c], start[r, c], start[r + 1, c], start[r + 2, c], keys[c])
        live, last, key = np.arange(n), sizes, keys
        flat, order, counts = [], [], []  # of the units that are done
        while len(live):
            top, best = worth[0].copy(), np.zeros(len(live), np.int16)
            for j in range(1, len(worth)):
                more = worth[j] > top
                np.copyto(top, worth[j], where=more)
                np.copyto(best, np.int16(j), where=more)
            can = top > never
            if not can.all():
                own = live[~can]
                got, end = ids[:, ~can].T, start[:, ~can].T
                inside = (end[:, :-1] < sizes[own][:, None])[:, : got.shape[1]]
                got, end = got[:, : inside.shape[1]], end[:, 1:]
                m = inside.sum(1)
                odd = np.flatnonzero((((got < 0) | (got >= self.n)) & inside).any(1))
                if len(odd):  # units with characters of no piece
                    fine = np.ones(len(own), bool)
                    fine[odd] = False
                    for k in odd.tolist():
                        closed = self.closed(got[k, : m[k]].tolist(), units[int(own[k])], end[k, : m[k]].tolist())
                        flat.append(np.array(closed, np.int32))
                        order.append(own[k : k + 1])
                        counts.append(np.array([len(closed)]))
                    own, got, inside, m = own[fine], got[fine], inside[fine], m[fine]
                flat.append(got[inside])
                order.append(own)
                counts.append(m)
                live, last, key, best = live[can], last[can], key[can], best[can]
                ids, start, into, worth = ids[:, can], start[:, can], into[:, can], worth[:, can]
            if not len(live):
                break
            at = np.arange(len(live))
            ids[best, at] = into[best, at]
            # take out the symbol behind the merge, its start and its candidate
            for j in range(len(ids) - 1):
                behind = best < j
                np.copyto(ids[j], ids[j + 1], where=behind)
                np.copyto(start[j], start[j + 1], where=behind)
                if j < len(worth) - 1:
                    np.copyto(into[j], into[j + 1], where=behind)
                    np.copyto(worth[j], worth[j + 1], where=behind)
            start[-2] = start[-1]
            ids, start = ids[:-1], start[:-1]
            if len(worth) == 1:
                worth[0] = never
                continue
            into, worth = into[:-1], worth[:-1]
            for place, some in ((best - 1, best > 0), (best, best < len(worth))):
                k = np.flatnonzero(some)
                p = place[k]
                behind = np.where(start[p + 1, k] < last[k], ids[np.minimum(p + 1, len(ids) - 1), k], -1)
                into[p, k], worth[p, k] = offers(ids[p, k], behind, start[p, k], start[p + 1, k], start[np.minimum(p + 2, len(start) - 1), k], key[k])
        return self.in_order(flat, order, counts, n)

    @staticmethod
    def in_order(flat: list, order: list, counts: list, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of results, each with the units that it holds and their numbers of ids, to one result in unit order."""
        if not n:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        flat, order, counts = np.concatenate(flat), np.concatenate(order), np.concatenate(counts)
        begins = np.cumsum(counts) - counts
        back = np.empty(n, np.int64)
        back[order] = np.arange(n)
        counts, begins = counts[back], begins[back]
        return flat[np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(begins, counts)], counts

    def segment(self, units: list[str], keys: np.ndarray, dropout: float) -> tuple[np.ndarray, np.ndarray]:
        """All ids in unit order, and their numbers."""
        sizes = np.array([len(u) for u in units])
        flat, order, counts = [], [], []
        for low, high in ((0, 4), (4, 6), (6, 8), (8, 10), (10, 12), (12, 16), (16, SHORT)):
            own = np.flatnonzero((sizes > low) & (sizes <= high))
            for a in range(0, len(own), 20_000):
                rows = own[a : a + 20_000]
                got, n = self.by_steps([units[k] for k in rows.tolist()], keys[rows], dropout)
                flat.append(got)
                order.append(rows)
                counts.append(n)
        for k in np.flatnonzero(sizes > SHORT).tolist():
            got = self.by_heap(units[k], int(keys[k]), dropout)
            flat.append(np.array(got, np.int32))
            order.append(np.array([k]))
            counts.append(np.array([len(got)]))
        return self.in_order(flat, order, counts, len(units))

    @staticmethod
    def alike(sizes: np.ndarray, unit: np.ndarray, key: np.ndarray, dropout: float) -> tuple[np.ndarray, np.ndarray]:
        """The occurrences to segment, and for each occurrence which of them it equals: short ones of one unit whose draws agree for all possible merges
        come out the same, whatever their keys."""
        short = np.flatnonzero(sizes <= FEW) if dropout > 0 else np.arange(len(sizes))
        draws = unit << comb(FEW + 1, 3)
        bar = np.uint64(min(int(dropout * 2.0**64), 2**64 - 1))
        for n in range(2, FEW + 1) if dropout > 0 else ():
            own = np.flatnonzero(sizes == n)
            for k, (s, m, e) in enumerate(combinations(range(n + 1), 3)):
                draws[own] |= (mixed(key[own], s, m, e) < bar).astype(np.int64) << k
        _, first, which = np.unique(draws[short], return_index=True, return_inverse=True)
        rest = np.setdiff1d(np.arange(len(sizes)), short, assume_unique=True)
        code = np.empty(len(sizes), np.int64)
        code[short], code[rest] = which, len(first) + np.arange(len(rest))
        return np.concatenate([short[first], rest]), code

    def encode(self, texts: list[bytes], dropout: float = DROPOUT, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and each text's number of ids."""
        from xxhash import xxh64_intdigest

        every, keys, counts = [], [], []
        for t in texts:
            found = UNITS.findall(SPACE + t.decode("utf-8", "surrogateescape").replace(SPACE, LITERAL).replace(" ", SPACE)) if t else []
            if found:
                every += found
                keys.append(mixed(xxh64_intdigest(t, seed), np.arange(len(found), dtype=np.uint64), 0, 0))
            counts.append(len(found))
        if not every:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        units = list(dict.fromkeys(every))
        number = dict(zip(units, range(len(units))))
        unit, key = np.fromiter(map(number.__getitem__, every), np.int64, len(every)), np.concatenate(keys)
        del every, number
        first, code = self.alike(np.array([len(u) for u in units])[unit], unit, key, dropout)
        flat, sizes = self.segment([units[k] for k in unit[first].tolist()], key[first], dropout)
        begins = np.cumsum(sizes) - sizes
        n = sizes[code]
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begins[code], n)
        per = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(counts)])]
        return flat[at], np.diff(per)

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of a text from its ids; the space that encoding puts first goes."""
        return b"".join(map(self.bytes_of.__getitem__, ids))[1:]


def _model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


_HELD: dict[int, Pieces] = {}


def _pieces(model: bytes) -> Pieces:
    """The model of this worker, made once."""
    key = hash(model)
    if key not in _HELD:
        _HELD[key] = Pieces(model)
    return _HELD[key]


def encode_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model_path: str = MODEL, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """doc_id, n_ids, n_bytes, lossless (whether the ids decode to the text), ids: one row for each row of ``docs``."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(_model(model_path))  # the size of the model file

    def run(batches):
        import pyarrow as pa

        pieces = _pieces(shared.value)
        for whole in batches:
            for b in slices(whole, SLICE_BYTES):
                raw = column_bytes(b.column("text"))
                ids, n = pieces.encode([t or b"" for t in raw], dropout, seed)
                ends = np.concatenate([[0], np.cumsum(n)])
                flat = ids.tolist()
                same = [t is None or pieces.decode(flat[ends[k] : ends[k + 1]]) == t for k, t in enumerate(raw)]
                null = pa.array([t is None for t in raw], pa.bool_())
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                null_list = pa.scalar(None, lists.type)
                import pyarrow.compute as pc

                lists = pc.if_else(null, null_list, lists) if any(t is None for t in raw) else lists
                counts = [None if t is None else c for t, c in zip(raw, n.tolist())]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counts, pa.int64()), pa.array([None if t is None else len(t) for t in raw], pa.int64()), pa.array(same, pa.bool_()), lists], ["doc_id", "n_ids", "n_bytes", "lossless", "ids"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_ids long, n_bytes long, lossless boolean, ids array<int>")


def decode_documents(encoded: DataFrame, doc_id: str = "doc_id", ids: str = "ids", model_path: str = MODEL) -> DataFrame:
    """doc_id and text from ids; null ids give a null text."""
    encoded = encoded.select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("ids"))
    shared = encoded.sparkSession.sparkContext.broadcast(_model(model_path))

    def run(batches):
        import pyarrow as pa

        pieces = _pieces(shared.value)
        for b in batches:
            texts = [None if x is None else pieces.decode(x) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string(), safe=False)], ["doc_id", "text"])

    return encoded.mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
