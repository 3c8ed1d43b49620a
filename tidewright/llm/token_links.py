"""Token links between two tokenizers, counted over a corpus under minimal perfect hashes.

A text is encoded by a byte-level BPE (A, space + text) and by a piece model (B, which adds the space itself).  Where tokens of both
end at one byte, a group ends; every A token of a group is linked to every B token of it.  A pair of ids counts once for each
document that holds it linked.

1. First pass: each task aligns its documents and sums its distinct pairs, dealt into 256 fixed buckets by a hash of the pair.
2. Task sums are merged in a tree of fan-in 16.  The distinct pairs of a bucket get a minimal perfect hash: levels of bit arrays, a
   pair's slot is the rank of the first bit that is its own.  Pairs are kept in slot order, to be verified.
3. Merged sums become dense vectors indexed by slot, which are added up in a tree as well: one count vector a bucket.
4. Second pass: documents are aligned again and look their pairs up.  Hashes, pairs and counts are broadcast if their measured size is
   within ``broadcast_bytes``; otherwise the documents' distinct pairs are joined with the same vectors.  Both give the same rows.

A bucket holds at most 1/256 of the product of both vocabularies, so no group grows with the corpus.  Neither tokenizer merges over a
single space between two other characters; texts are cut there and each task aligns a distinct word once.

Defined results: null and empty texts, and texts whose joined A or B bytes differ from space + text, have zeros and empty groups; rows
that repeat an id or a text are documents of their own; an empty table gives no rows.  A very long text is one row but many words; a
word without spaces is aligned whole.  Input columns travel as one struct, so that their names cannot clash.
"""
from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare, stored
from .sentencepiece import gather
from .tokens import chunks, free_buffers, mix

BUCKETS = 256
FAN_IN = 16
BROADCAST_BYTES = 256 * 1024 * 1024
CACHED_WORDS, CACHED_LINKS = 250_000, 3_000_000
HELD_PAIRS = 1_000_000
WIDE_GROUP = 1_000_000
_WHITE = "\u180e"
_CUT = re.compile(r" (?=[^\s᠎])(?<=[^\s᠎] )")
#: Fixed value: how byte-level tokenizers of this family cut a text before they merge.
_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_WORD = 2_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def byte_symbols() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def models(byte_bpe: str, piece_model: str) -> tuple:
    """(A's file, B's file, bytes of A's tokens, bytes of B's tokens; None for tokens without text; whether A's ids are its merge ranks), read
    on the driver."""
    import sentencepiece
    from tokenizers import Tokenizer

    with open(byte_bpe, encoding="utf-8") as f:
        a_file = f.read()
    with open(piece_model, "rb") as f:
        b_file = f.read()
    a, b, as_byte = Tokenizer.from_str(a_file), sentencepiece.SentencePieceProcessor(model_proto=b_file), byte_symbols()
    a_bytes: list = [None] * a.get_vocab_size()
    for token, i in a.get_vocab(with_added_tokens=False).items():
        a_bytes[i] = bytes(map(as_byte.__getitem__, token))
    b_bytes: list = []
    for i in range(b.get_piece_size()):
        p = b.id_to_piece(i)
        b_bytes.append(bytes([int(p[3:5], 16)]) if b.is_byte(i) else None if b.is_control(i) or b.is_unknown(i) else p.replace("▁", " ").encode())
    told = json.loads(a_file)
    merged_ids = [told["model"]["vocab"].get("".join(m) if isinstance(m, list) else m.replace(" ", "", 1)) for m in told["model"].get("merges", [])]
    cut = told.get("pre_tokenizer") or {}
    ranked = (told["model"]["type"] == "BPE" and not told["normalizer"] and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
              and None not in merged_ids and all(x < y for x, y in zip(merged_ids, merged_ids[1:])))
    return a_file, b_file, a_bytes, b_bytes, ranked


def of_worker(shared, text: bool = False) -> Aligner:
    """The aligner of this worker process: a broadcast value stays with the process, and so does what it found out for earlier tasks."""
    *known, kept = shared.value
    if "aligner" not in kept:
        kept["aligner"] = Aligner(*known)
    if kept["aligner"].text != text:
        kept["aligner"].text = text
        kept["aligner"].clear()
    return kept["aligner"]


class Aligner:
    """Aligns texts word by word and keeps what it has found out about words, up to a bound."""

    def __init__(self, a_file: str, b_file: bytes, a_bytes: list, b_bytes: list, ranked: bool):
        """``ranked``: merges by rank of the merged bytes give the same ids, and the faster encoder that works so is used for all but long words."""
        import sentencepiece
        import tiktoken

        self.a_file, self.a = a_file, None
        ranks = {x: i for i, x in enumerate(a_bytes) if x is not None}
        self.ranked = tiktoken.Encoding("ranked", pat_str=_BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={}) if ranked else None
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        self.width = len(b_bytes)
        self.faces = [(np.frombuffer(b"".join(x or b"" for x in t), np.uint8), np.r_[0, np.cumsum([len(x or b"") for x in t])], np.array([x is None for x in t]))
                      for t in (a_bytes, b_bytes)]
        self.marked = [f"{i}{end}" for i in range(max(len(a_bytes), self.width)) for end in ",|;"]
        self.age, self.text = 0, False
        self.clear()

    def clear(self) -> None:
        class Numbers(dict):
            def __missing__(self, word):
                n = self[word] = len(self)
                self.fresh.append(word)
                return n

        self.age += 1
        self.numbers = Numbers()
        self.numbers.fresh = []
        self.odd: set[str] = set()
        self.pairs, self.times, self.offsets = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)
        self.sums = np.zeros((0, 5), np.int64)  # good, n_a, n_b, n_groups, n_links
        self.texts: list[str] = []

    def words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the words of all texts, words in each text)."""
        if len(self.numbers) > CACHED_WORDS or self.pairs.size > CACHED_LINKS:
            self.clear()
        codes, counts = [], np.zeros(len(texts), np.int64)
        for k, t in enumerate(texts):
            if t:
                ws = _CUT.split(" " + t)
                ws[0] = ws[0][1:]
                for w in (ws[0], ws[-1]):  # white space is left at the ends of a text only
                    if not w or w[0].isspace() or w[-1].isspace() or w[0] == _WHITE or w[-1] == _WHITE:
                        self.odd.add(w)
                codes.append(np.fromiter(map(self.numbers.__getitem__, ws), np.int64, len(ws)))
                counts[k] = len(ws)
        if self.numbers.fresh:
            self.add(self.numbers.fresh)
            self.numbers.fresh = []
        return np.concatenate(codes) if codes else np.zeros(0, np.int64), counts

    def whole(self) -> object:
        """The library that reads A's file, made where it is first needed."""
        if self.a is None:
            from tokenizers import Tokenizer

            self.a = Tokenizer.from_str(self.a_file)
            self.a.encode_special_tokens = True
        return self.a

    def ids_of(self, text: str, side: int) -> list[int]:
        if side:
            return self.b.encode(text)
        if self.ranked:
            return self.ranked.encode_ordinary(" " + text)
        return self.whole().encode(" " + text, add_special_tokens=False).ids

    def encoded(self, words: list[str], side: int, size: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, word of each, whether a word's joined bytes are its own).

        Words without white space at their ends stand in one text, where no token crosses the spaces between them; the others, and all if
        that text does not come back byte by byte, are encoded one by one."""
        surface, at, none = self.faces[side]
        odd = np.fromiter(map(self.odd.__contains__, words), bool, len(words)) | (size > LONG_WORD)
        plain, ends, parts = np.flatnonzero(~odd), np.r_[0, np.cumsum(size)], []
        if plain.size:
            text = " ".join(itertools.compress(words, (~odd).tolist()))
            flat = np.array(self.ids_of(text, side), np.int64)
            stop = np.cumsum(at[flat + 1] - at[flat])
            wanted, n = gather(target, ends, plain)
            bounds = np.cumsum(n)
            if not none[flat].any() and stop[-1] == bounds[-1] and (gather(surface, at, flat)[0] == wanted).all() and np.isin(bounds, stop).all():
                parts.append((flat, plain[np.searchsorted(bounds, stop)]))
            else:
                odd[:] = True
        good = ~odd
        rest = np.flatnonzero(odd)
        if rest.size:
            alone = list(itertools.compress(words, odd.tolist()))
            ids = self.b.encode(alone, num_threads=1) if side else [self.whole().encode(" " + w, add_special_tokens=False).ids for w in alone]
            count = np.fromiter(map(len, ids), np.int64, len(ids))
            flat, word = np.fromiter(itertools.chain.from_iterable(ids), np.int64, int(count.sum())), np.repeat(rest, count)
            got = np.bincount(word, at[flat + 1] - at[flat], size.size).astype(np.int64)
            good[rest] = (got[rest] == size[rest]) & (np.bincount(word, none[flat], size.size)[rest] == 0)
            own = rest[good[rest]]
            wanted, n = gather(target, ends, own)
            found, _ = gather(surface, at, flat[good[word]])
            good &= ~(np.bincount(np.repeat(own, n), found != wanted, size.size) > 0)
            parts.append((flat, word))
        flat, word = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(word, kind="stable")
        return flat[order], word[order], good

    def add(self, fresh: list[str]) -> None:
        raw = [(" " + w).encode() for w in fresh]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        target = np.frombuffer(b"".join(raw), np.uint8)
        fa, wa, good_a = self.encoded(fresh, 0, size, target)
        fb, wb, good_b = self.encoded(fresh, 1, size, target)
        good = good_a & good_b
        n = len(fresh)
        fa, wa, fb, wb = fa[good[wa]], wa[good[wa]], fb[good[wb]], wb[good[wb]]
        end_a, end_b = (np.cumsum(np.diff(f[1])[x]) for f, x in zip(self.faces, (fa, fb)))
        common = np.intersect1d(end_a, end_b, assume_unique=True)
        ga, gb = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
        na, nb = np.bincount(ga, minlength=common.size), np.bincount(gb, minlength=common.size)
        first_a, first_b = np.cumsum(na) - na, np.cumsum(nb) - nb
        owner = wa[first_a] if common.size else np.zeros(0, np.int64)
        links = na * nb
        narrow = np.flatnonzero(links <= WIDE_GROUP)
        k = np.repeat(narrow, links[narrow])
        r = np.arange(k.size) - np.repeat(np.cumsum(links[narrow]) - links[narrow], links[narrow])
        keys = [owner[k] << 32 | (fa[first_a[k] + r // nb[k]] * self.width + fb[first_b[k] + r % nb[k]])]
        times = [np.ones(k.size, np.int64)]
        for g in np.flatnonzero(links > WIDE_GROUP).tolist():  # such a group repeats few ids, which meet once
            ua, ca = np.unique(fa[first_a[g] : first_a[g] + na[g]], return_counts=True)
            ub, cb = np.unique(fb[first_b[g] : first_b[g] + nb[g]], return_counts=True)
            keys.append((owner[g] << 32 | (ua[:, None] * self.width + ub)).ravel())
            times.append((ca[:, None] * cb).ravel())
        key, count = summed(np.concatenate(keys), np.concatenate(times))
        self.pairs, self.times = np.r_[self.pairs, key & 0xFFFFFFFF], np.r_[self.times, count]
        self.offsets = np.r_[self.offsets, self.offsets[-1] + np.cumsum(np.bincount(key >> 32, minlength=n))]
        sums = [good, np.bincount(wa, minlength=n), np.bincount(wb, minlength=n), np.bincount(owner, minlength=n), np.bincount(owner, links, n)]
        self.sums = np.concatenate([self.sums, np.stack(sums, 1).astype(np.int64)])
        if not self.text:
            return
        group, side = np.r_[ga, gb], np.repeat([0, 1], [ga.size, gb.size])
        order = np.argsort(group * 2 + side, kind="stable")
        part = (group * 2 + side)[order]
        last = np.r_[part[1:] != part[:-1], True][: part.size]
        tokens = list(map(self.marked.__getitem__, (np.r_[fa, fb][order] * 3 + np.where(last, 1 + side[order], 0)).tolist()))
        ends = np.cumsum(np.bincount(wa, minlength=n) + np.bincount(wb, minlength=n)).tolist()
        self.texts += ["".join(tokens[i:j]) for i, j in zip([0, *ends], ends)]


def summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their ``n``."""
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: key.size])
    return key[first], np.add.reduceat(n, first) if first.size else n


def bucket_of(pair: np.ndarray) -> np.ndarray:
    return (mix(pair.astype(np.uint64) * _STEP) >> np.uint64(56)).astype(np.int64)


def place(pair: np.ndarray, level: int, size) -> np.ndarray:
    """Bit of each pair in a level of ``size`` bits."""
    return (mix((pair.astype(np.uint64) + np.uint64(level + 1)) * _STEP) % np.asarray(size).astype(np.uint64)).astype(np.int64)


def perfect_hash(pairs: np.ndarray, spread: float = 1.5) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(bits in each level, all bits, the pairs in slot order): a pair stays in the first level where no other falls on its bit."""
    sizes, bits, slots = [], [], []
    while pairs.size:
        size = -(-max(64, int(spread * pairs.size)) // 64) * 64
        at = place(pairs, len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        own = alone[at]
        slots.append(pairs[own][np.argsort(at[own])])
        sizes.append(size)
        bits.append(alone)
        pairs = pairs[~own]
    return sizes, np.packbits(np.concatenate(bits)) if bits else np.zeros(0, np.uint8), np.concatenate(slots) if slots else pairs


class Lookup:
    """Slots of pairs under the hashes of all buckets, laid end to end."""

    def __init__(self, sizes: list[list[int]], bits: np.ndarray, pairs: np.ndarray):
        self.levels = max(map(len, sizes), default=0)
        self.size = np.zeros((len(sizes), self.levels), np.int64)
        for b, s in enumerate(sizes):
            self.size[b, : len(s)] = s
        ends = np.cumsum(self.size.ravel()).reshape(self.size.shape)
        self.base = ends - self.size
        self.bits, self.pairs = bits, pairs
        ones = np.bitwise_count(bits).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    def slots(self, pair: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """The slot of each pair; -1 for a pair that has none."""
        out = np.full(pair.size, -1, np.int64)
        todo = np.arange(pair.size)
        for level in range(self.levels):
            size = self.size[bucket[todo], level]
            todo = todo[size > 0]
            at = self.base[bucket[todo], level] + place(pair[todo], level, size[size > 0])
            byte, bit = at >> 3, (at & 7).astype(np.uint8)
            hit = (self.bits[byte] >> (np.uint8(7) - bit)) & 1 == 1
            rank = self.before[byte] + np.bitwise_count(self.bits[byte] >> (np.uint8(8) - bit)).astype(np.int64)
            out[todo[hit]] = rank[hit]
            todo = todo[~hit]
        known = np.flatnonzero(out >= 0)
        out[known[self.pairs[out[known]] != pair[known]]] = -1
        return out


def _lists(flat: np.ndarray, counts: np.ndarray, kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(flat, kind))


def pair_sums(docs: DataFrame, shared, text_col: str) -> DataFrame:
    """First pass: (bucket, part, pairs, n), where n counts the documents of a part of the corpus that hold a pair linked."""

    def rows(pair: np.ndarray, n: np.ndarray, part: int) -> pa.RecordBatch:
        bucket = bucket_of(pair)
        order = np.argsort(bucket, kind="stable")
        present, count = np.unique(bucket[order], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(present, pa.int32()), pa.array(np.full(present.size, part), pa.int32()),
                                           _lists(pair[order], count, pa.int64()), _lists(n[order], count, pa.int64())], names=["bucket", "part", "pairs", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, part, held, size = of_worker(shared), TaskContext.get().partitionId(), [], 0
        for batch in batches:
            for _, texts in chunks(batch, "body"):
                words, counts = aligner.words(texts)
                doc = np.repeat(np.arange(len(texts)), counts)
                fine = np.bincount(doc, aligner.sums[words, 0] == 0, len(texts)) == 0
                seen = np.unique(doc[fine[doc]] << 32 | words[fine[doc]])
                pair, n = gather(aligner.pairs, aligner.offsets, seen & 0xFFFFFFFF)
                pair = np.unique(np.repeat(seen >> 32, n) << 32 | pair) & 0xFFFFFFFF
                held.append(summed(pair, np.ones(pair.size, np.int64)))
                size += held[-1][0].size
                if size > 2 * HELD_PAIRS:
                    held = [summed(*map(np.concatenate, zip(*held)))]
                    size = held[0][0].size
                    if size > HELD_PAIRS:
                        yield rows(*held[0], part)
                        held, size = [], 0
            free_buffers()
        if size:
            yield rows(*summed(*map(np.concatenate, zip(*held))), part)

    return docs.select(F.col(text_col).alias("body")).mapInArrow(run, "bucket int, part int, pairs array<long>, n array<long>")


def merged(sums: DataFrame) -> DataFrame:
    """One level of the tree: the sums of FAN_IN parts as one."""

    def run(group: pa.Table) -> pa.Table:
        pair, n = summed(*(group.column(c).combine_chunks().flatten().to_numpy() for c in ("pairs", "n")))
        return pa.table({"bucket": group.column("bucket")[:1].cast(pa.int32()), "part": group.column("part")[:1].cast(pa.int32()),
                         "pairs": _lists(pair, np.array([pair.size]), pa.int64()), "n": _lists(n, np.array([n.size]), pa.int64())})

    return sums.withColumn("part", F.expr(f"int(part div {FAN_IN})")).groupBy("bucket", "part").applyInArrow(run, "bucket int, part int, pairs array<long>, n array<long>")


def hash_buckets(sums: DataFrame) -> DataFrame:
    """(bucket, sizes, bits, slots): the minimal perfect hash of each bucket's distinct pairs; ``sums`` holds one part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                sizes, bits, slots = perfect_hash(batch.column("pairs")[k].values.to_numpy())
                yield pa.RecordBatch.from_arrays([batch.column("bucket").slice(k, 1), _lists(np.array(sizes), np.array([len(sizes)]), pa.int32()),
                                                  pa.array([bits.tobytes()], pa.binary()), _lists(slots, np.array([slots.size]), pa.int64())], names=["bucket", "sizes", "bits", "slots"])

    return sums.select("bucket", "pairs").mapInArrow(run, "bucket int, sizes array<int>, bits binary, slots array<long>")


def count_vectors(sums: DataFrame, hashes: DataFrame, parts: int) -> DataFrame:
    """(bucket, counts): dense vectors by slot, one for each merged part, added up in a tree."""

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                sizes, bits, slots, pairs, n = (batch.column(c)[k] for c in ("sizes", "bits", "slots", "pairs", "n"))
                pair = pairs.values.to_numpy()
                at = Lookup([sizes.as_py()], np.frombuffer(bits.as_py(), np.uint8), slots.values.to_numpy()).slots(pair, np.zeros(pair.size, np.int64))
                if (at < 0).any():
                    raise ValueError("a pair has no slot")
                vector = np.zeros(len(slots), np.int64)
                vector[at] = n.values.to_numpy()
                yield pa.RecordBatch.from_arrays([batch.column("bucket").slice(k, 1), batch.column("part").slice(k, 1), _lists(vector, np.array([vector.size]), pa.int64())],
                                                 names=["bucket", "part", "counts"])

    def add(group: pa.Table) -> pa.Table:
        total = group.column("counts").combine_chunks().flatten().to_numpy().reshape(group.num_rows, -1).sum(0)
        return pa.table({"bucket": group.column("bucket")[:1].cast(pa.int32()), "part": group.column("part")[:1].cast(pa.int32()), "counts": _lists(total, np.array([total.size]), pa.int64())})

    vectors = sums.join(hashes, "bucket").mapInArrow(dense, "bucket int, part int, counts array<long>")
    while parts > 1:
        vectors = vectors.withColumn("part", F.expr(f"int(part div {FAN_IN})")).groupBy("bucket", "part").applyInArrow(add, "bucket int, part int, counts array<long>")
        parts = -(-parts // FAN_IN)
    return vectors.select("bucket", "counts")


def pair_counts(docs: DataFrame, shared, text_col: str) -> DataFrame:
    """(bucket, sizes, bits, slots, counts), a stored table of at most BUCKETS rows."""
    sums = stored(pair_sums(docs, shared, text_col), "pairs")
    sums = stored(merged(sums), "sums")
    parts = 1 + (sums.agg(F.max("part")).first()[0] or 0)
    one, left = sums, parts
    while left > 1:
        one, left = merged(one), -(-left // FAN_IN)
    hashes = stored(hash_buckets(one), "hashes")
    return stored(hashes.join(count_vectors(sums, hashes, parts), "bucket"), "counts")


def best_counts(counts: DataFrame, width: int) -> DataFrame:
    """(a, best): the highest count of each A id; at most as many rows as A has ids."""
    pairs = counts.select(F.explode(F.arrays_zip("slots", "counts")).alias("x")).select(F.expr(f"int(x.slots div {width})").alias("a"), F.col("x.counts").alias("c"))
    return pairs.groupBy("a").agg(F.max("c").alias("best"))


def word_scores(aligner: Aligner, index: tuple, width: int) -> np.ndarray:
    """(links with their A id's highest count, sum of counts, links without a count) of every word known so far: they do not depend on the
    text around a word.  Pairs of words that stand only in texts without tokens have no count."""
    sizes, bits, slots, n, best, kept = index
    if kept.get("age") != aligner.age:
        kept |= {"age": aligner.age, "scores": np.zeros((0, 3), np.int64)}
    if "lookup" not in kept:
        kept["lookup"] = Lookup(sizes, bits, slots)
    done, total = kept["scores"].shape[0], len(aligner.numbers)
    if done < total:
        start = aligner.offsets[done]
        pair, times = aligner.pairs[start:], aligner.times[start:]
        at = kept["lookup"].slots(pair, bucket_of(pair))
        found = np.where(at >= 0, n[at] if n.size else 0, 0)
        word = np.repeat(np.arange(total - done), np.diff(aligner.offsets[done:]))
        new = np.zeros((total - done, 3), np.int64)
        np.add.at(new[:, 0], word, times * (found == best[pair // width]))
        np.add.at(new[:, 1], word, times * found)
        np.add.at(new[:, 2], word, at < 0)
        kept["scores"] = np.concatenate([kept["scores"], new])
    return kept["scores"]


def token_links(docs: DataFrame, byte_bpe: str, piece_model: str, text_col: str = "text", carry: list[str] | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Columns: row (the input row or its ``carry`` columns), n_a, n_b, n_groups, n_links, n_best, count_sum, groups (``a1,a2|b1;a3|b2,b3``)."""
    spark = prepare(docs.sparkSession)
    known = models(byte_bpe, piece_model)
    shared, width, n_a = spark.sparkContext.broadcast((*known, {})), len(known[3]), len(known[2])
    counts = pair_counts(docs, shared, text_col)
    size = counts.agg(F.sum(F.size("slots") * 16 + F.length("bits") * 9)).first()[0] or 0
    rows = docs.select(F.struct(*(carry or ["*"])).alias("row"), F.col(text_col).alias("body"))
    sums = ["n_a", "n_b", "n_groups", "n_links"]
    small = size <= broadcast_bytes
    if small:
        table = counts.orderBy("bucket").toArrow()
        lists = {c: table.column(c).combine_chunks() for c in ("bucket", "sizes", "slots", "counts")}
        sizes: list[list[int]] = [[] for _ in range(BUCKETS)]
        for b, s in zip(lists["bucket"].to_pylist(), lists["sizes"].to_pylist()):
            sizes[b] = s
        slots, n = lists["slots"].flatten().to_numpy(), lists["counts"].flatten().to_numpy()
        best = np.zeros(n_a, np.int64)
        np.maximum.at(best, slots // width, n)
        index = spark.sparkContext.broadcast((sizes, np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint8), slots, n, best, {}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = of_worker(shared, True)
        for batch in batches:
            for part, texts in chunks(batch, "body"):
                words, counts_ = aligner.words(texts)
                scored = word_scores(aligner, index.value, width) if small else np.zeros((len(aligner.numbers), 3), np.int64)
                doc = np.repeat(np.arange(len(texts)), counts_)
                fine = np.bincount(doc, aligner.sums[words, 0] == 0, len(texts)) == 0
                keep = fine[doc]
                out = np.zeros((len(texts), 6), np.int64)
                if scored[words[keep], 2].any():
                    raise ValueError("a pair of the second pass was not met in the first")
                values = np.concatenate([aligner.sums[words[keep], 1:], scored[words[keep], :2]], 1)
                starts = np.cumsum(counts_ * fine) - counts_ * fine
                some = np.flatnonzero(fine & (counts_ > 0))
                if some.size:
                    out[some] = np.add.reduceat(values, starts[some])
                ends = np.cumsum(counts_)
                listed = words.tolist()
                groups = ["".join(map(aligner.texts.__getitem__, listed[e - c : e]))[:-1] if ok and c else "" for e, c, ok in zip(ends.tolist(), counts_.tolist(), fine.tolist())]
                columns = [part.column("row"), *map(pa.array, out.T), pa.array(groups, pa.string())]
                names = ["row", *sums, "n_best", "count_sum", "groups"]
                if not small:
                    seen, at = np.unique(doc[keep] << 32 | words[keep], return_counts=True)
                    pair, each = gather(aligner.pairs, aligner.offsets, seen & 0xFFFFFFFF)
                    times, _ = gather(aligner.times, aligner.offsets, seen & 0xFFFFFFFF)
                    key, times = summed(np.repeat(seen >> 32, each) << 32 | pair, times * np.repeat(at, each))
                    per_doc = np.bincount(key >> 32, minlength=len(texts))
                    columns += [_lists(key & 0xFFFFFFFF, per_doc, pa.int64()), _lists(times, per_doc, pa.int64())]
                    names += ["pairs", "times"]
                yield pa.RecordBatch.from_arrays(columns, names=names)
            free_buffers()

    fields = [rows.schema["row"], *[T.StructField(c, T.LongType()) for c in [*sums, "n_best", "count_sum"]], T.StructField("groups", T.StringType())]
    if small:
        return rows.mapInArrow(run, T.StructType(fields))
    # beyond the bound: the distinct pairs of every document meet the same vectors in a join, where a frequent pair's rows can be split
    fields += [T.StructField(c, T.ArrayType(T.LongType())) for c in ("pairs", "times")]
    aligned = stored(rows.mapInArrow(run, T.StructType(fields)).withColumn("key", F.expr("uuid()")), "aligned")
    links = aligned.select("key", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("key", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    one = counts.select(F.explode(F.arrays_zip("slots", "counts")).alias("x")).select(F.col("x.slots").alias("pair"), F.col("x.counts").alias("c"))
    one = stored(one.withColumn("a", F.expr(f"int(pair div {width})")).join(F.broadcast(best_counts(counts, width)), "a"), "pair-counts")
    per_doc = links.join(one, "pair").groupBy("key").agg(F.sum(F.when(F.col("c") == F.col("best"), F.col("times")).otherwise(0)).alias("b"), F.sum(F.col("times") * F.col("c")).alias("s"))
    return (aligned.drop("pairs", "times", "n_best", "count_sum").join(per_doc, "key", "left")
            .select("row", *sums, F.coalesce("b", F.lit(0)).alias("n_best"), F.coalesce("s", F.lit(0)).alias("count_sum"), "groups"))
