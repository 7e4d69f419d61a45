"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

A text is cut into units at white-space marks (no piece of the vocabulary crosses
one).  Units not seen before are encoded together: one flat numpy array of symbols,
and in each round every unit finds its best-ranked adjacent pairs, merges them, and the
array is compacted, until no pair remains.  A task keeps encoded units in a bounded
table, so repeated words cost one lookup.

Which pairs go in a round: the reference order merges, over and over, the adjacent pair
of the best rank, the leftmost of equals.  A pair's turn is the worst rank met in the
making of it or its two symbols, and then its own rank; pairs take their turns in rising
order.  What could touch a pair before its turn is a piece that spans one of its symbols
and their neighbours, so its first merge is a pair of an earlier turn no further away
than the longest piece.  A pair that comes first among all within that distance therefore
merges as it would in the reference order, whatever goes on elsewhere; in a unit no longer
than the window that is the unit's least pair.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import freeing, small_batches

MARK = "▁"
_UNIT = re.compile(" +[^ ]*|[^ ]+")
#: Units kept per worker, characters of all kept units, texts per step, and characters of a batch of new units.
MAX_UNITS, MAX_KEPT, STEP_TEXTS, BATCH = 400_000, 8_000_000, 256, 200_000
_NONE = np.int64(1) << 60
_RANK_BITS = 24


class Model:
    """Vocabulary, merge table and the two directions, for one model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm, spec = proto.normalizer_spec, proto.trainer_spec
        if spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not spec.byte_fallback or spec.treat_whitespace_as_suffix:
            raise ValueError("a BPE model with identity normalisation and byte fallback is needed")
        pieces = [(p.piece, p.score, p.type) for p in proto.pieces]
        self.prefix = bool(norm.add_dummy_prefix)
        self.size, self.eos = len(pieces), next(i for i, p in enumerate(pieces) if p[0] == "</s>")
        self.normal = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == 1}
        if any(MARK in p.lstrip(MARK) for p in self.normal) or any(c not in self.normal for p in self.normal for c in p):
            raise ValueError("a piece crosses a white-space mark or holds a character that is no piece")
        self.byte_ids = np.zeros(256, np.int64)
        self.raw: list[bytes] = []  # what each id decodes to
        self.is_byte = np.zeros(self.size, bool)
        for i, (p, _, kind) in enumerate(pieces):
            if kind == 6:
                b = int(p[3:5], 16)
                self.byte_ids[b], self.is_byte[i] = i, True
                self.raw.append(bytes([b]))
            else:
                self.raw.append(b"" if kind == 3 else " ⁇ ".encode() if kind == 2 else p.replace(MARK, " ").encode())
        self._merge_table(pieces)
        self.units: dict[str, int] = {}
        self._reset()

    def _merge_table(self, pieces) -> None:
        """(left, right) -> piece; rank 0 is the best score, equal scores share a rank."""
        scores = sorted({s for _, s, kind in pieces if kind == 1}, reverse=True)
        rank_of = {s: r for r, s in enumerate(scores)}
        self.rank = np.zeros(self.size, np.int64)
        self.char_ids = np.full(0x110000, -1, np.int64)
        keys, made = [], []
        best_above = {}
        for p, i in self.normal.items():
            self.rank[i] = rank_of[pieces[i][1]]
            if len(p) == 1:
                self.char_ids[ord(p)] = i
            for cut in range(1, len(p)):
                left, right = p[:cut], p[cut:]
                a, b = self.normal.get(left), self.normal.get(right)
                for q in (left, right):
                    best_above[q] = min(best_above.get(q, 1 << 30), int(rank_of[pieces[i][1]]))
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    made.append(i)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.made = np.array(keys, np.int64)[order], np.array(made, np.int64)[order]
        self.longest = max(map(len, self.normal))
        #: A merge is "early" if a piece around it ranks as well or better: then a later
        #: occurrence may be consumed first, so only the leftmost is merged in a round.
        self.early = np.zeros(self.size, bool)
        for p, i in self.normal.items():
            self.early[i] = best_above.get(p, 1 << 30) <= self.rank[i]

    def _reset(self) -> None:
        self.units.clear()
        self.starts = np.zeros(0, np.int64)
        self.lens = np.zeros(0, np.int64)
        self.store = np.zeros(0, np.int32)

    def pairs(self, left: np.ndarray, right: np.ndarray, born: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The piece that each pair of symbols makes, and its turn (_NONE if none)."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        piece = np.where(hit, self.made[at], -1)
        rank = self.rank[np.maximum(piece, 0)]
        return piece, np.where(hit, np.maximum(rank, born) << _RANK_BITS | rank, _NONE)

    def _around(self, turn: np.ndarray, place: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least turn among the pairs before, and after, each one, as far as a piece reaches within the word.

        place and left: symbols before and after in the same word.  Windows double in width.
        """
        none = np.full(1, _NONE)
        before = np.where(place > 0, np.concatenate([none, turn[:-1]]), _NONE)
        after = np.where(left > 0, np.concatenate([turn[1:], none]), _NONE)
        width, most = 1, min(self.longest, int(place.max(initial=0)))
        while width < most and width < len(turn):
            pad = np.full(width, _NONE)
            before = np.minimum(before, np.where(place > width, np.concatenate([pad, before[:-width]]), _NONE))
            after = np.minimum(after, np.where(left > width, np.concatenate([after[width:], pad]), _NONE))
            width *= 2
        return before, after

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Final symbols of all words, flat, and the number of each word's symbols."""
        sym = self.symbols("".join(words))
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        piece, turn = np.full(len(sym), -1), np.full(len(sym), _NONE)
        born = np.zeros(len(sym), np.int64)  # worst rank met in the making of a symbol
        inner = np.flatnonzero(word[:-1] == word[1:])
        piece[inner], turn[inner] = self.pairs(sym[inner], sym[inner + 1], born[inner])
        done_sym, done_word = [], []
        while len(sym):
            new = np.empty(len(sym), bool)
            new[0], new[1:] = True, word[1:] != word[:-1]
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(sym)))
            go = np.repeat(np.minimum.reduceat(turn, first) != _NONE, size)
            done_sym.append(sym[~go])
            done_word.append(word[~go])
            if not go.any():
                break
            place = np.arange(len(sym)) - np.repeat(first, size)
            before, after = self._around(turn, place, np.repeat(size, size) - 1 - place)
            free = (turn != _NONE) & (turn <= before) & (turn <= after)
            # pairs of one turn in a row overlap: every other one from the left, as far as all before are free
            same = np.zeros(len(sym), bool)
            same[1:] = (turn[1:] == turn[:-1]) & ~new[1:]
            take = free & ~same
            if (run := same & free).any():
                heads = np.flatnonzero(~same)
                length = np.diff(np.append(heads, len(sym)))
                nth = np.arange(len(sym)) - np.repeat(heads, length)
                blocked = np.minimum.reduceat(np.where(free, len(sym), nth), heads)
                take |= run & (nth % 2 == 0) & (nth < np.repeat(blocked, length))
            # of an early piece only one that none of its turn precedes
            take &= (turn < before) | ~self.early[piece]
            where = np.flatnonzero(take)
            born[where] = turn[where] >> _RANK_BITS
            sym[where] = piece[where]
            # pairs change where a merged symbol stands on either side
            turn[where], piece[where] = _NONE, -1
            stays, changed = go, take
            stays[where + 1] = False
            sym, word, piece, turn, born, changed = sym[stays], word[stays], piece[stays], turn[stays], born[stays], changed[stays]
            changed[:-1] |= changed[1:]
            at = np.flatnonzero(changed[:-1] & (word[:-1] == word[1:]))
            piece[at], turn[at] = self.pairs(sym[at], sym[at + 1], np.maximum(born[at], born[at + 1]))
        sym, word = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (done_sym, done_word))
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=len(words))

    def symbols(self, text: str) -> np.ndarray:
        """Id of each character; one that is no piece gets a negative number."""
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        got = self.char_ids[codes]
        return np.where(got >= 0, got, -1 - codes)

    def with_bytes(self, symbols: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids: characters that are no piece become their bytes' ids; and the new lengths."""
        odd = np.flatnonzero(symbols < 0)
        if not len(odd):
            return symbols.astype(np.int32), lens
        coded = [self.byte_ids[list(chr(-1 - c).encode())] for c in symbols[odd].tolist()]
        times = np.ones(len(symbols), np.int64)
        times[odd] = [len(c) for c in coded]
        out = np.repeat(symbols, times)
        out[out < 0] = np.concatenate(coded)
        word = np.repeat(np.arange(len(lens)), lens)
        return out.astype(np.int32), np.bincount(word, weights=times, minlength=len(lens)).astype(np.int64)

    def learn(self, units: list[str]) -> None:
        """Encode units and add them to the table; there they hold plain spaces."""
        units = sorted(units, key=len)
        ends = np.cumsum([len(u) for u in units])
        cuts = [0, *np.searchsorted(ends, np.arange(BATCH, ends[-1], BATCH)).tolist(), len(units)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            ids, lens = self.with_bytes(*self.merge([u.replace(" ", MARK) for u in units[a:b]]))
            base, known = len(self.store), len(self.units)
            self.units.update({u: known + k for k, u in enumerate(units[a:b])})
            self.starts = np.concatenate([self.starts, base + np.cumsum(lens) - lens])
            self.lens = np.concatenate([self.lens, lens])
            self.store = np.concatenate([self.store, ids])

    def encode(self, texts: list[str | None], add_eos: bool = True) -> list[np.ndarray]:
        """Ids of each text, as the library's encode gives them; null counts as empty."""
        if len(self.units) > MAX_UNITS or len(self.store) > MAX_KEPT:
            self._reset()
        mark = " "
        cut = [_UNIT.findall((mark if self.prefix else "") + t.replace(MARK, mark)) if t else [] for t in texts]
        new = list(dict.fromkeys(u for us in cut for u in us if u not in self.units))
        if new:
            self.learn(new)
        eos = np.array([self.eos] if add_eos else [], np.int32)
        get, out = self.units.__getitem__, []
        for us in cut:
            u = np.fromiter(map(get, us), np.int64, len(us))
            n = self.lens[u]
            ends = np.cumsum(n)
            total = int(ends[-1]) if len(n) else 0
            at = np.repeat(self.starts[u] - (ends - n), n) + np.arange(total)
            out.append(np.concatenate([self.store[at], eos]))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; control ids give nothing, bytes that are no UTF-8 become U+FFFD each."""
        raw = self.raw
        listed = ids.tolist()
        data = b"".join([raw[i] for i in listed])
        try:
            text = data.decode()
        except UnicodeDecodeError:
            parts, run = [], bytearray()
            for i in [*listed, None]:
                if i is not None and self.is_byte[i]:
                    run += raw[i]
                    continue
                if run:
                    parts.append(_lenient(bytes(run)))
                    run = bytearray()
                if i is not None:
                    parts.append(raw[i].decode())
            text = "".join(parts)
        first = next((i for i in listed if self.raw[i] or self.is_byte[i]), None)
        if self.prefix and first is not None and not self.is_byte[first] and text[:1] == " " and first != 0:
            text = text[1:]
        return text


def _lenient(data: bytes) -> str:
    out, i = [], 0
    while i < len(data):
        for n in (1, 2, 3, 4):
            try:
                out.append(data[i : i + n].decode())
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


_MODELS: dict[str, Model] = {}


def model(path: str) -> Model:
    """One model per worker and file."""
    if path not in _MODELS:
        _MODELS[path] = Model(path)
    return _MODELS[path]


def _forget() -> None:
    for m in _MODELS.values():
        m._reset()


def encode_decode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = True) -> DataFrame:
    """One row per input row: id, ids array<int> (with an end id), decoded string.

    A narrow map over Arrow batches: no shuffle, no collected state; memory is bounded
    by STEP_TEXTS texts and MAX_UNITS units of MAX_KEPT ids per task.  A lost executor costs
    its own tasks only.

    Edge cases: null counts as empty (ids hold the end id only, decoded is empty);
    repeated rows stay; an empty table gives an empty result; other columns are ignored;
    very long units take the same rounds.
    """
    small_batches(df.sparkSession)
    id_type = df.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_path)
        for batch in batches:
            for at in range(0, batch.num_rows, STEP_TEXTS):
                part = batch.slice(at, STEP_TEXTS)
                encoded = m.encode(part.column(1).to_pylist())
                offsets = np.concatenate([[0], np.cumsum([len(e) for e in encoded])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(encoded)))
                texts = pa.array([m.decode(e) for e in encoded] if decode else [None] * len(encoded), pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), ids, texts], names=[id_col, "ids", "decoded"])

    return df.select(F.col(id_col), F.col(text_col).alias("__text")).mapInArrow(freeing(run, _forget), schema)
