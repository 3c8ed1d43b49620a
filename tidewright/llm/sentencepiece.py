"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The model file is read on the driver with the public library and travels as plain arrays (its vocabulary is fixed, some 32,000
pieces), so executors need no file.  A text is cut before every run of the space mark, where no piece crosses; each task encodes
a distinct word once.  The words of a chunk are one flat symbol array.  A round finds the smallest pair rank of every word
(segmented minimum), merges all its occurrences from the left at once, and compacts; words with no pair left go out.

Merging all occurrences at once gives the library's order unless a merge makes a pair that ranks before (or ties with) the one at
hand.  Those words are found in the round and merge only their leftmost pair; a long such word (a run of hundreds of spaces, say) is
finished with a heap.

Defined results: a null or empty text has the end id only and decodes to an empty text; characters outside the vocabulary become
UTF-8 byte pieces; ids that are no valid UTF-8 decode to U+FFFD byte by byte, as in the library.
"""
from __future__ import annotations

import codecs
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import opened, prepare, share
from .tokens import chunks, free_buffers

SPACE = "▁"
NO_PAIR = np.int32(2**31 - 1)
CHUNK_CHARS = 1_000_000
CACHED_WORDS = 250_000
LONG_WORD = 256


@dataclass
class Vocabulary:
    """Arrays of a BPE model.  Symbols: piece ids, then characters that only stand inside pieces, then one for all others."""

    size: int
    end_id: int
    char_ids: np.ndarray  # code point -> symbol
    byte_ids: np.ndarray
    slots: np.ndarray  # open-addressing table of left * n_symbols + right
    ranks: np.ndarray
    merged: np.ndarray
    n_symbols: int
    surface: np.ndarray  # UTF-8 of all pieces, end to end
    surface_at: np.ndarray
    leads: np.ndarray  # piece starts with the space mark
    silent: np.ndarray  # control pieces


def _hash(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def load(path: str) -> Vocabulary:
    """Read a BPE model without a normalisation map and with a dummy prefix and byte pieces; any other kind is refused."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    probe = " Aéﬁ  b "
    ids = range(n)
    plain = [i for i in ids if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
    if sp.normalize(probe) != SPACE + probe.replace(" ", SPACE) or sum(map(sp.is_byte, ids)) != 256:
        raise ValueError("only BPE models with identity normalisation, a dummy prefix and byte fallback are supported")
    pieces = {sp.id_to_piece(i): i for i in plain}
    if any(SPACE in p.lstrip(SPACE) or (p.startswith(SPACE * 2) and p.strip(SPACE)) for p in pieces):
        raise ValueError("a piece reaches over a space mark")
    scores = np.array([sp.get_score(i) for i in plain])
    order = {i: int(r) for i, r in zip(plain, np.unique(-scores, return_inverse=True)[1])}
    inner = sorted({c for p in pieces for c in p} - pieces.keys())
    symbols = pieces | {c: n + k for k, c in enumerate(inner)}
    m = n + len(inner) + 1
    pairs = {symbols[p[:k]] * m + symbols[p[k:]]: i for p, i in pieces.items() for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols}
    char_ids = np.full(0x110000, m - 1, np.int32)
    for c, i in symbols.items():
        if len(c) == 1:
            char_ids[ord(c)] = i
    bits = max(10, int(np.ceil(np.log2(4 * len(pairs) + 1))))
    slots, ranks, merged = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NO_PAIR, np.int32), np.zeros(1 << bits, np.int32)
    mask = (1 << bits) - 1
    for (key, piece), at in zip(pairs.items(), _hash(np.fromiter(pairs, np.int64, len(pairs)), bits).tolist()):
        while slots[at] >= 0:
            at = (at + 1) & mask
        slots[at], ranks[at], merged[at] = key, order[piece], piece
    byte_ids = np.zeros(256, np.int32)
    faces = []
    for i in ids:
        p = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(p[3:5], 16)] = i
            faces.append(bytes([int(p[3:5], 16)]))
        else:
            faces.append(b"" if sp.is_control(i) else sp.decode([i]).encode() if sp.is_unknown(i) else p.replace(SPACE, " ").encode())
    at = np.concatenate([[0], np.cumsum([len(x) for x in faces])])
    leads = np.array([i in order and sp.id_to_piece(i).startswith(SPACE) for i in ids])
    return Vocabulary(n, sp.eos_id(), char_ids, byte_ids, slots, ranks, merged, m, np.frombuffer(b"".join(faces), np.uint8), at, leads,
                      np.array([sp.is_control(i) for i in ids]))


def look_up(v: Vocabulary, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank and merged piece of each pair; NO_PAIR where there is none."""
    key = left.astype(np.int64) * v.n_symbols + right
    at = _hash(key, v.slots.size.bit_length() - 1)
    todo = np.flatnonzero((v.slots[at] != key) & (v.slots[at] >= 0))
    while todo.size:
        at[todo] = (at[todo] + 1) & (v.slots.size - 1)
        todo = todo[(v.slots[at[todo]] != key[todo]) & (v.slots[at[todo]] >= 0)]
    return np.where(v.slots[at] == key, v.ranks[at], NO_PAIR), v.merged[at]


def _finish(v: Vocabulary, sym: np.ndarray, src: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One word, pair by pair from a heap of (rank, place)."""
    s, after, before = sym.tolist(), [*range(1, sym.size), -1], [*range(-1, sym.size - 1)]
    rank, piece = look_up(v, sym[:-1], sym[1:])
    heap = [(int(r), i, int(sym[i]), int(sym[i + 1]), int(p)) for i, (r, p) in enumerate(zip(rank, piece)) if r != NO_PAIR]
    heapq.heapify(heap)
    while heap:
        _, i, a, b, new = heapq.heappop(heap)
        j = after[i]
        if s[i] != a or j < 0 or s[j] != b:
            continue
        s[i], s[j], after[i] = new, -1, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        near = [(x, y) for x, y in ((before[i], i), (i, after[i])) if x >= 0 and y >= 0]
        if near:
            rank, piece = look_up(v, np.array([s[x] for x, _ in near]), np.array([s[y] for _, y in near]))
            for (x, y), r, p in zip(near, rank, piece):
                if r != NO_PAIR:
                    heapq.heappush(heap, (int(r), x, s[x], s[y], int(p)))
    keep = np.flatnonzero(np.array(s) >= 0)
    return np.array(s)[keep], src[keep]


def merge_words(v: Vocabulary, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(flat ids, offsets) of words, each preceded by a space mark."""
    text = SPACE.join(["", *words])
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    sym, src, word = v.char_ids[code].astype(np.int64), np.arange(code.size), np.repeat(np.arange(size.size), size)
    rank, piece = np.full(sym.size, NO_PAIR), np.zeros(sym.size, np.int32)
    if sym.size > 1:
        rank[:-1], piece[:-1] = look_up(v, sym[:-1], sym[1:])
        rank[:-1][word[:-1] != word[1:]] = NO_PAIR
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while sym.size:
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        count = np.diff(np.r_[first, sym.size])
        least = np.minimum.reduceat(rank, first)
        over = np.repeat(least == NO_PAIR, count)
        if over.any():
            done.append((word[over], sym[over], src[over]))
            live = ~over
            sym, src, word, rank, piece = sym[live], src[live], word[live], rank[live], piece[live]
            if not sym.size:
                break
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            count = np.diff(np.r_[first, sym.size])
            least = least[least != NO_PAIR]
        low = np.repeat(least, count)
        hit = rank == low
        # of touching hits every second one merges
        run = np.flatnonzero(hit)
        opens = np.r_[True, run[1:] != run[:-1] + 1]
        nth = np.arange(run.size) - np.maximum.accumulate(np.where(opens, np.arange(run.size), 0))
        at = run[nth % 2 == 0]
        owner = word[at]
        several = np.r_[owner[1:] == owner[:-1], False] | np.r_[False, owner[1:] == owner[:-1]]
        if several.any():
            now = sym.copy()
            now[at] = piece[at]
            sel = at[several]
            bound = low[sel]
            chosen = np.zeros(sym.size + 2, bool)
            chosen[at] = True
            left, right = sel - 1, sel + 2
            two_back = np.maximum(sel - 2, 0)
            has_left = (left >= 0) & (word[np.maximum(left, 0)] == word[sel])
            previous = np.where(chosen[two_back] & (sel >= 2), now[two_back], sym[np.maximum(left, 0)])
            has_right = (right < sym.size) & (word[np.minimum(right, sym.size - 1)] == word[sel])
            r_left = np.where(has_left, look_up(v, previous, now[sel])[0], NO_PAIR)
            r_right = np.where(has_right, look_up(v, now[sel], sym[np.minimum(right, sym.size - 1)])[0], NO_PAIR)
            unsafe = np.unique(word[sel[np.minimum(r_left, r_right) <= bound]])
            if unsafe.size:
                bad = np.isin(owner, unsafe)
                at = at[~bad | np.r_[True, owner[1:] != owner[:-1]]]
                long = [w for w in unsafe.tolist() if count[np.searchsorted(word[first], w)] > LONG_WORD]
                if long:
                    for w in long:
                        a, b = np.searchsorted(word, [w, w + 1])
                        s, o = _finish(v, sym[a:b], src[a:b])
                        done.append((np.full(s.size, w), s, o))
                    live = ~np.isin(word, long)
                    moved = np.cumsum(live) - 1
                    at = moved[at[live[at]]]
                    sym, src, word, rank, piece = sym[live], src[live], word[live], rank[live], piece[live]
                    if not sym.size:
                        break
        sym[at] = piece[at]
        live = np.ones(sym.size, bool)
        live[at + 1] = False
        place = np.cumsum(live) - 1
        at = place[at]
        sym, src, word, rank, piece = sym[live], src[live], word[live], rank[live], piece[live]
        changed = np.zeros(sym.size, bool)
        changed[at] = changed[at[at > 0] - 1] = True
        touched = np.flatnonzero(changed)
        pairs = touched[touched < sym.size - 1]
        rank[touched] = NO_PAIR
        r, p = look_up(v, sym[pairs], sym[pairs + 1])
        rank[pairs], piece[pairs] = np.where(word[pairs] == word[pairs + 1], r, NO_PAIR), p
    word, sym, src = (np.concatenate(x) for x in zip(*done)) if done else (np.zeros(0, np.int64),) * 3
    order = np.lexsort((src, word))
    word, sym, code = word[order], sym[order], code[src[order]]
    raw = sym >= v.size
    size = np.where(raw, 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000), 1)
    at = np.cumsum(size) - size
    flat = np.empty(int(size.sum()), np.int32)
    flat[at[~raw]] = sym[~raw]
    for k in range(4):
        s = np.flatnonzero(raw & (size > k))
        value = code[s] >> (6 * (size[s] - 1 - k))
        lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[size[s]]
        flat[at[s] + k] = v.byte_ids[lead | value if k == 0 else 0x80 | (value & 0x3F)]
    return flat, np.r_[0, np.cumsum(np.bincount(word, size, len(words)).astype(np.int64))]


def gather(flat: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges ``which`` of a flat array, end to end, and their sizes."""
    size = offsets[which + 1] - offsets[which]
    end = np.cumsum(size)
    return flat[np.repeat(offsets[which] - (end - size), size) + np.arange(int(end[-1]) if end.size else 0)], size


class Encoder:
    """Encodes texts chunk by chunk and keeps the words met so far, up to a bound."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.clear()

    def clear(self):
        class Numbers(dict):
            def __missing__(self, word):
                n = self[word] = len(self)
                self.fresh.append(word)
                return n

        self.numbers = Numbers()
        self.numbers.fresh = []
        self.flat, self.offsets = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids with an end id after each text, offsets)."""
        if len(self.numbers) > CACHED_WORDS:
            self.clear()
        codes, counts = [], []
        for t in texts:
            words: list[str] = []
            if t:
                s = t.replace(" ", SPACE)
                words = s.split(SPACE)
                if "" in words:  # runs of space marks stay with the word that follows
                    joined, run = [], -1
                    for w in words:
                        run += 1
                        if w:
                            joined.append(SPACE * run + w)
                            run = -1
                    words = joined + [SPACE * run] * (run >= 0)
            codes.append(np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words)))
            counts.append(len(words))
        if self.numbers.fresh:
            flat, offsets = merge_words(self.v, self.numbers.fresh)
            self.offsets = np.concatenate([self.offsets, offsets[1:] + self.offsets[-1]])
            self.flat = np.concatenate([self.flat, flat])
            self.numbers.fresh = []
        ids, size = gather(self.flat, self.offsets, np.concatenate(codes) if codes else np.zeros(0, np.int64))
        text = np.repeat(np.arange(len(texts)), counts)
        n = np.bincount(text, size, len(texts)).astype(np.int64) + 1
        ends = np.cumsum(n)
        out = np.full(int(ends[-1]) if ends.size else 0, self.v.end_id, np.int32)
        body = np.ones(out.size, bool)
        body[ends - 1] = False
        out[body] = ids
        return out, np.r_[0, ends]


def _byte_wise(e: UnicodeError):
    return "�", e.start + 1


def decode(v: Vocabulary, flat: np.ndarray, offsets: np.ndarray) -> list[str]:
    """Texts of runs of ids."""
    codecs.register_error("piece-bytes", _byte_wise)
    raw, size = gather(v.surface, v.surface_at, flat.astype(np.int64))
    ends = np.r_[0, np.cumsum(size)][offsets]
    raw, out = raw.tobytes(), []
    for k in range(offsets.size - 1):
        i, stop = offsets[k], offsets[k + 1]
        while i < stop and v.silent[flat[i]]:
            i += 1
        skip = int(i < stop and v.leads[flat[i]])
        out.append(raw[ends[k] + skip : ends[k + 1]].decode("utf-8", "piece-bytes"))
    return out


def encode_decode(docs: DataFrame, model_path: str, text_col: str = "text", decoded: bool = True, carry: list[str] | None = None) -> DataFrame:
    """Columns: row (the input row or its ``carry`` columns), ids (array<int>, the end id last) and, if asked for, decoded."""
    v = load(model_path)
    spark = docs.sparkSession
    shared = share(prepare(spark), v)
    rows = docs.select(F.struct(*(carry or ["*"])).alias("row"), F.col(text_col).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = opened(shared)
        encoder = Encoder(voc)
        for batch in batches:
            for part, texts in chunks(batch, "body", CHUNK_CHARS):
                flat, offsets = encoder.encode(texts)
                columns = {"row": part.column("row"), "ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))}
                if decoded:
                    columns["decoded"] = pa.array(decode(voc, flat, offsets), pa.string())
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
            free_buffers()

    fields = [rows.schema["row"], T.StructField("ids", T.ArrayType(T.IntegerType()))]
    return rows.mapInArrow(run, T.StructType(fields + [T.StructField("decoded", T.StringType())] * decoded))
