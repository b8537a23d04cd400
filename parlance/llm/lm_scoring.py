"""Language-model scores by online logistic context mixing.

A token is a path of binary decisions: a Huffman code of the words that follow the contexts of one group, or of an
escape, after which the word is spelled byte by byte, bit by bit. Each decision has three predictors, the counts of
what training did there in a context: any, the word before, the two words before (letters: any, one byte, two bytes).
A mixer adds their logits with weights that are gated by how much the two longer contexts have seen, and a map
refines the mixed chance by what such chances have been worth. Weights and map are learned online, from training
tokens alone, each predicted with its own count left out. A score is the total coding cost.

All contexts of a token hold the word before it, so tokens are dealt to groups, and in them to models, by a hash of that
word. Each model, of most of a million tokens, has all of its contexts: what is gathered grows with the corpus, and no task
holds more than one group. A word before that is too common for one group is dealt by the two (if both are common:
three) words before. Tasks send packed columns, a row per group, and get back what each document's tokens cost.

Token counts for the unigram base are exact: those beyond the commonest words are joined, not broadcast. The letter
model has at most 2 ** 24 counts, whatever the corpus.
"""

from __future__ import annotations

import ctypes
import functools
import heapq
import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import cut, documents

#: Words whose counts are broadcast, at most (16 bytes each). The rest are joined: this bounds memory, not results.
VOCABULARY = 1 << 19
#: Tokens that a group aims at, and the share of them from which on a word before is dealt by more words; tokens of a model in it.
GROUP_TOKENS, HOT, MODEL_TOKENS = 3_000_000, 8, 800_000
#: Bytes of text that a task packs at once, and distinct events that are worked on at once.
FLUSH_BYTES, BLOCK = 10_000_000, 60_000
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
END = 0  # place and hash of the end token, which also stands before a document's first word
DEPTH = 52  # bits of a code, left-aligned
#: Weight shares of a context by what it has seen: nothing, 1-3, 4-31, more.
TRUST = np.array([0.0, 0.2, 0.5, 0.8], np.float32)
LEVELS = (1, 4, 32)
MAP = 24  # intervals of the refining map
LIMIT = 12.0  # of a logit
#: Kinds of counts: words by hash, letters, all tokens of all rows.
WORD, LETTERS, ALL = range(3)
SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: Words hash as polynomials over random numbers of their bytes, modulo 2 ** 64.
BYTES = np.random.default_rng(9).integers(1, 1 << 63, 256).astype(np.uint64)


def held_out(key: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 1


@functools.cache
def _low_powers(of: int) -> np.ndarray:
    return np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full((1 << 16) - 1, of, np.uint64))))


def _high_powers(of: int, n: int) -> np.ndarray:
    return np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n, pow(of, 1 << 16, 1 << 64), np.uint64))))


def _word_hashes(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits for each word, the same wherever it stands: the sum of its bytes' numbers times powers of A."""
    begin, past = np.empty(len(starts), np.uint64), np.empty(len(starts), np.uint64)
    low, high = _low_powers(int(A)), _high_powers(int(A), len(text) >> 16)
    total = np.zeros(1, np.uint64)
    for k in range(len(high)):  # blocks of 2 ** 16 bytes
        at = k << 16
        block = text[at : at + (1 << 16)]
        sums = np.concatenate((total, total + np.cumsum(BYTES[block] * low[: len(block)] * high[k])))
        for out, places in ((begin, starts), (past, ends)):
            some = slice(*np.searchsorted(places, (at, at + (1 << 16) + (k == len(high) - 1))))
            out[some] = sums[places[some] - at]
        total = sums[-1:]
    inverse = pow(int(A), -1, 1 << 64)
    h = (past - begin) * _high_powers(inverse, len(text) >> 16)[starts >> 16] * _low_powers(inverse)[starts & 0xFFFF] + (ends - starts).astype(np.uint64) * B
    h = (h ^ (h >> np.uint64(32))) * B
    return (h ^ (h >> np.uint64(29))) | np.uint64(1)  # 0 is the end


class Tokens:
    """Tokens of texts, an end after each text's words. numbers: of the distinct tokens, by place; 0 is the end. Of those,
    hashes and the places of one word's bytes."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        self.bytes = LOWER[raw]
        gap = SPACE[raw]
        new = np.zeros(len(raw) + 1, bool)
        new[bounds] = True
        starts = np.flatnonzero(~gap & (new[:-1] | np.concatenate(([True], gap[:-1]))[: len(gap)]))
        ends = np.flatnonzero(~gap & (new[1:] | np.concatenate((gap[1:], [True]))[: len(gap)])) + 1
        h = _word_hashes(self.bytes, starts, ends)
        kinds, first, number = np.unique(h, return_index=True, return_inverse=True)
        self.hash = np.concatenate((np.zeros(1, np.uint64), kinds))
        self.word_starts, self.word_ends = starts[first], ends[first]
        doc = np.searchsorted(bounds, starts, "right") - 1
        self.n_words = np.bincount(doc, minlength=len(texts))
        self.n_bytes = np.bincount(doc, ends - starts, len(texts)).astype(np.int64) + self.n_words
        self.first = np.cumsum(self.n_words + 1) - self.n_words - 1
        self.numbers = np.zeros(len(starts) + len(texts), np.int32)
        self.numbers[np.arange(len(starts)) + doc] = number + 1
        self.doc = np.repeat(np.arange(len(texts), dtype=np.int32), self.n_words + 1)

    def letters(self) -> tuple[np.ndarray, ...]:
        """Byte before, the one before that, byte, and number of the word, for the bytes of the distinct words and a space
        after each."""
        size = self.word_ends - self.word_starts + 1
        word = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
        byte = np.where(place < size[word] - 1, self.bytes[np.minimum(self.word_starts[word] + place, max(len(self.bytes) - 1, 0))], 32).astype(np.int64)
        one = np.where(place > 0, np.roll(byte, 1), 32)
        return one, np.where(place > 1, np.roll(byte, 2), 32), byte, word


def _release() -> None:
    """Give freed memory back, so that a worker which is used again for another stage doesn't add one's peak to the other's."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):  # glibc
        libc.malloc_trim(0)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with about FLUSH_BYTES of text at a time, whatever the batches."""
    held, n = [], 0
    for b in batches:
        size = np.concatenate(([0], np.cumsum(pc.binary_length(b["text"]).fill_null(0).to_numpy())))
        start = 0
        while start < b.num_rows:
            stop = max(start + 1, int(np.searchsorted(size, size[start] + FLUSH_BYTES - n, "right")) - 1)
            held.append(b.slice(start, stop - start))
            n += int(size[stop] - size[start])
            start = stop
            if n >= FLUSH_BYTES or start < b.num_rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of training rows' words (by hash, the end too) and letters, and of all tokens of all rows."""
    for b in _pieces(batches):
        t = Tokens(b["text"])
        trained = ~b["held_out"].to_numpy(zero_copy_only=False)
        n = np.bincount(t.numbers, trained[t.doc], len(t.hash)).astype(np.int64)
        one, two, byte, word = t.letters()
        triple, place = np.unique((two << 16) | (one << 8) | byte, return_inverse=True)
        of_triple = np.bincount(place, n[1:][word], len(triple)).astype(np.int64)
        kind = np.repeat([WORD, LETTERS, ALL], [len(n), len(triple), 1])
        key = np.concatenate((t.hash.view(np.int64), triple, [0]))
        count = np.concatenate((n, of_triple, [len(t.numbers)]))
        some = count > 0
        yield pa.RecordBatch.from_arrays([pa.array(kind[some], pa.int32()), pa.array(key[some]), pa.array(count[some])], names=["kind", "key", "n"])
        _release()


class Code:
    """Huffman code of symbols 0 to n - 1. For symbol s, decision start[s] + d is its d-th: bits, and how often training
    (with the given weights) took either side there (none, ones)."""

    def __init__(self, weights: list[int]):
        n = len(weights)
        heap = [(w, i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        up, at_side, total = [0] * (2 * n), [0] * (2 * n), [*weights] + [0] * n
        for new in range(n, 2 * n - 1):
            w, i = heapq.heappop(heap)
            v, j = heap[0]
            up[i] = up[j] = new
            at_side[j] = 1
            total[new] = w + v
            heapq.heapreplace(heap, (w + v, new))
        parent, side, weight = (np.array(x, np.int64) for x in (up, at_side, total))
        at, levels = np.arange(n), []
        while len(going := np.flatnonzero(at != 2 * n - 2)) and n > 1:  # from the leaves up
            levels.append((going, side[at[going]], weight[at[going]], weight[parent[at[going]]]))
            at[going] = parent[at[going]]
        self.length = np.zeros(n, np.int64)
        for going, *_ in levels:
            self.length[going] += 1
        self.start = np.cumsum(self.length) - self.length
        self.bits, self.ones, self.none = (np.zeros(int(self.length.sum()), np.int64) for _ in range(3))
        self.value = np.zeros(n, np.int64)
        for k, (going, bit, own, both) in enumerate(levels):
            d = self.length[going] - 1 - k
            place = self.start[going] + d
            self.bits[place] = bit
            self.ones[place] = np.where(bit > 0, own, both - own)
            self.none[place] = np.where(bit > 0, both - own, own)
            self.value[going] |= bit << (DEPTH - 1 - d)


class Mixer:
    """Gated weights of three predictors and the refining map; both are changed by learn alone."""

    def __init__(self):
        long, middle = np.meshgrid(TRUST, TRUST, indexing="ij")
        w2 = long.ravel() * 0.8
        w1 = (1 - w2) * middle.ravel()
        self.weights = np.stack([1 - w1 - w2, w1, w2]).astype(np.float32)  # gate: 4 * level of the longest + of the middle context
        self.steps = np.full((3, 16), 1e-3)
        self.seen, self.ones = np.zeros(16 * MAP), np.zeros(16 * MAP)

    @staticmethod
    def inputs(counts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[list[np.ndarray], np.ndarray]:
        """Logits and gate. counts: how often a decision was 0 and 1, for the short, middle and long context."""
        x = [np.log((one + np.float32(0.4)) / (none + np.float32(0.4))) for none, one in counts]
        (_, middle, long) = (sum(((none + one) >= n).view(np.int8) for n in LEVELS) for none, one in counts)
        return x, (4 * long + middle).astype(np.intp)

    def chance(self, x: list[np.ndarray], gate: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chance of a 1, refined; the mixer's own; and its interval of the map."""
        z = sum(self.weights[k][gate] * x[k] for k in range(3))
        z = np.clip(z, -LIMIT, LIMIT)
        p = 1 / (1 + np.exp(-z))
        interval = gate * MAP + ((z + np.float32(LIMIT)) * np.float32(MAP / (2.001 * LIMIT))).astype(np.intp)
        trust = 32 / (self.seen + 32)
        worth = (self.ones / (self.seen + 32)).astype(np.float32)[interval] + trust.astype(np.float32)[interval] * p
        return np.clip((p + worth) / 2, np.float32(1e-5), np.float32(1 - 1e-5)), p, interval

    def learn(self, x: list[np.ndarray], gate: np.ndarray, p: np.ndarray, interval: np.ndarray, bits: np.ndarray, times: np.ndarray) -> None:
        """One step of all gates from decisions that training made so many times."""
        error = (bits - p) * times
        seen = np.bincount(interval, times, 16 * MAP)
        n = seen.reshape(16, MAP).sum(axis=1) + 16
        for k in range(3):
            slope = np.bincount(gate, error * x[k], 16) / n
            self.steps[k] += slope**2
            self.weights[k] += (0.05 * slope / np.sqrt(self.steps[k])).astype(np.float32)
        self.seen += seen
        self.ones += np.bincount(interval, times * bits, 16 * MAP)


def _common_bits(context: np.ndarray, value: np.ndarray) -> np.ndarray:
    """First bits that each code has in common with the one before it in the same context (-1: another context)."""
    out = np.full(len(value), -1, np.int64)
    out[1:] = np.where(context[1:] == context[:-1], DEPTH - np.frexp((value[1:] ^ value[:-1]).astype(float))[1], -1)
    return out


def _at_nodes(common: np.ndarray, bits: np.ndarray, times: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """How often training took 0 and 1 at the node of each code. Codes of one context that pass a node lie together."""
    new = common < depth
    first = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    one = np.add.reduceat(times * bits, first)
    both = np.add.reduceat(times, first)
    return (both - one)[run], one[run]


def event_bits(one: np.ndarray, two: np.ndarray, token: np.ndarray, times: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What events of a group cost: bits, bits with one count of the event itself left out, and whether it escapes
    (its spelling then comes on top). one, two: the word before and the one before that; times: how often training has
    the event (0: held out). Words are numbered from 0, the end token."""
    trained = np.bincount(token, times, n_words)
    listed = trained >= 2  # one seen once teaches what a new word costs
    listed[END] = True
    words = np.flatnonzero(listed)
    # Words in the order of their counts, ties by number, so that the code is the same wherever the group is worked on.
    code = Code([int(trained[~listed].sum()) + 1, *np.maximum(trained[words], 1).astype(np.int64).tolist()])
    symbol = np.zeros(n_words, np.int64)
    symbol[words] = np.arange(1, len(words) + 1)
    by_value = np.empty(len(code.value), np.int64)
    by_value[np.argsort(code.value, kind="stable")] = np.arange(len(code.value))
    n = len(by_value)
    symbols = symbol[token]
    pair = one * n_words + two
    if n_words * n_words * n >= 1 << 63:
        pair = np.unique(pair, return_inverse=True)[1]
    key = pair * n + by_value[symbols]
    order = np.argsort(key)
    key = key[order]
    new = np.concatenate(([True], key[1:] != key[:-1]))
    first = np.flatnonzero(new)
    inverse = np.empty(len(key), np.int64)
    inverse[order] = np.cumsum(new) - 1
    # From here on each event is taken once.
    one, pair, symbols = one[order[first]], pair[order[first]], symbols[order[first]]
    weight = np.add.reduceat(times[order], first).astype(np.float32)
    value, length, start, rank = code.value[symbols], code.length[symbols], code.start[symbols], by_value[symbols]
    bits, left = np.zeros(len(first)), np.zeros(len(first))
    mixer = Mixer()
    # Blocks end where the word before changes: each has all events of its contexts.
    ends = np.concatenate((np.flatnonzero(one[1:] != one[:-1]) + 1, [len(one)]))
    at = 0
    while at < len(one):
        stop = int(ends[np.searchsorted(ends, min(at + BLOCK, len(one)))])
        part = slice(at, stop)
        _block_bits(mixer, code, one[part], pair[part], value[part], rank[part], length[part], start[part], weight[part], bits[part], left[part])
        at = stop
    return bits[inverse], left[inverse], (symbols == 0)[inverse]


def _block_bits(mixer, code, one, pair, value, rank, length, start, weight, bits, left) -> None:
    """Fills bits and left. Events are distinct and sorted by pair, then by code."""
    common2 = _common_bits(pair, value)
    turn = np.argsort(one * (int(rank.max()) + 1) + rank, kind="stable")  # sorted by the word before, then by code
    common1 = _common_bits(one[turn], value[turn])
    longer = np.arange(len(one))
    place = np.empty(len(one), np.int64)
    depth = 0
    while True:
        longer = longer[length[longer] > depth]
        if not len(longer):
            return
        keep = length[turn] > depth
        turn, common1 = turn[keep], common1[keep]
        at = start[longer] + depth
        bit, w = code.bits[at].astype(np.float32), weight[longer]
        place[longer] = np.arange(len(longer))
        back = place[turn]
        middle = [np.empty(len(longer), np.float32) for _ in range(2)]
        for m, x in zip(middle, _at_nodes(common1, bit[back], w[back], depth), strict=True):
            m[back] = x
        counts = [(code.none[at].astype(np.float32), code.ones[at].astype(np.float32)), tuple(middle), _at_nodes(common2[longer], bit, w, depth)]
        x, gate = mixer.inputs(counts)
        p, _, _ = mixer.chance(x, gate)
        bits[longer] -= np.log2(np.abs(p - (1 - bit)))
        own = (w > 0).astype(np.float32)
        own1, own0 = own * bit, own * (1 - bit)
        x, gate = mixer.inputs([(none - own0, one_ - own1) for none, one_ in counts])
        p, plain, interval = mixer.chance(x, gate)
        left[longer] -= np.log2(np.abs(p - (1 - bit)))
        mixer.learn(x, gate, plain, interval, bit, w)
        depth += 1


class Letters:
    """Bits of a byte after two others, mixed from counts after none, one and two bytes; words end with a space.

    triples: (two before, one before, byte) as 24-bit numbers, and how many training words have them.
    """

    def __init__(self, triples: np.ndarray, times: np.ndarray):
        contexts, row = np.unique(triples >> 8, return_inverse=True)
        self.row = np.full(1 << 16, -1, np.int32)
        self.row[contexts] = np.arange(len(contexts))
        # A row more for each byte stands for the contexts of two bytes that end with it and were never seen.
        n2 = np.zeros((len(contexts) + 256, 256))
        n2[row, triples & 255] = times
        before = np.concatenate((contexts & 255, np.arange(256)))
        n1 = np.zeros((256, 256))
        np.add.at(n1, ((triples >> 8) & 255, triples & 255), times)
        n0 = n1.sum(axis=0)
        mixer = Mixer()
        for last in (False, False, True):  # twice to learn, then to say what bytes cost
            self.bits = np.zeros(n2.shape, np.float32)
            for d in range(8):
                sides = [n.reshape(-1, 1 << d, 2, 128 >> d).sum(axis=3) for n in (n0[None], n1, n2)]
                counts = [(np.broadcast_to(s[r, :, 0], sides[2][:, :, 0].shape), np.broadcast_to(s[r, :, 1], sides[2][:, :, 0].shape)) for s, r in zip(sides, ([0], before, slice(None)), strict=True)]
                counts = [(none.ravel().astype(np.float32), one.ravel().astype(np.float32)) for none, one in counts]
                if last:
                    p = mixer.chance(*mixer.inputs(counts))[0].reshape(len(n2), 1 << d, 1)
                    self.bits += np.repeat(-np.log2(np.concatenate((1 - p, p), axis=2)).reshape(len(n2), -1), 128 >> d, axis=1).astype(np.float32)
                    continue
                for bit in (0, 1):
                    times_ = counts[2][bit]
                    some = times_ > 0
                    less = [tuple(c[some] - (1 if side == bit else 0) for side, c in enumerate(pair)) for pair in counts]
                    x, gate = mixer.inputs(less)
                    _, p, interval = mixer.chance(x, gate)
                    mixer.learn(x, gate, p, interval, np.full(len(p), bit, np.float32), times_[some])

    def spelling(self, tokens: Tokens) -> np.ndarray:
        """Bits of each distinct token, by number; the end needs none."""
        one, two, byte, word = tokens.letters()
        row = self.row[(two << 8) | one]
        row = np.where(row < 0, len(self.bits) - 256 + one, row)
        return np.bincount(word + 1, self.bits[row, byte], len(tokens.hash)).astype(np.float32)


def _pack(columns: list[np.ndarray]) -> bytes:
    """Arrays of any kinds as one compressed buffer."""
    out = io.BytesIO()
    for c in columns:
        np.lib.format.write_array(out, np.ascontiguousarray(c), allow_pickle=False)
    raw = out.getvalue()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw = pa.Codec("zstd").decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)
    held, out = io.BytesIO(raw), []
    while held.tell() < len(raw):
        out.append(np.lib.format.read_array(held, allow_pickle=False))
    return out


def _deal(t: Tokens, spelling: np.ndarray, hot: np.ndarray, trained: np.ndarray, groups: int) -> Iterator[tuple[int, bytes]]:
    """Groups with their events: hashes (48 bits, enough within a group) and spellings of the words used, then one and
    two words before, token, document, number, and whether it was trained on."""
    token, doc, first = t.numbers, t.doc, t.first
    within = np.arange(len(token), dtype=np.int32) - first.astype(np.int32)[doc]
    before = [np.where(within >= k, np.concatenate((np.zeros(k, np.int32), token[:-k])) if len(token) > k else np.int32(0), np.int32(END)) for k in (1, 2, 3)]
    one, two, three = before
    del within, before
    times = np.ones(len(token), np.int32)
    hot1 = hot[one]
    hot2 = hot1 & hot[two]
    h = t.hash[one] * A
    h = np.where(hot1, (h ^ (h >> np.uint64(29))) * B + t.hash[two] * A, h)
    h = np.where(hot2, (h ^ (h >> np.uint64(29))) * B + t.hash[three] * A, h)
    h = (h ^ (h >> np.uint64(32))) * B
    group = ((h >> np.uint64(33)) % np.uint64(groups)).astype(np.int32)
    del h, hot1
    # A document that repeats common words over and over gives each such event once, with its number.
    if len(often := np.flatnonzero(hot2)):
        keep, n = _distinct(doc[often], three[often], two[often], one[often], token[often])
        times[often] = 0
        times[often[keep]] = n
    alive = np.flatnonzero(times).astype(np.int32)
    del three, hot2
    order = alive[np.argsort(group[alive], kind="stable")]
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(group[order])) + 1, [len(order)]))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        at = order[a:b]
        used, columns = _renumbered([one[at], two[at], token[at]], len(t.hash))
        # Common words get small numbers, and numbers are sent byte by byte: both make them compress.
        by_count = np.argsort(-sum(np.bincount(c, minlength=len(used)) for c in columns), kind="stable")
        place = np.empty(len(used), np.uint32)
        place[by_count] = np.arange(len(used))
        used, d = used[by_count], doc[at]
        yield (
            int(group[order[a]]),
            _pack(
                [(t.hash[used] >> np.uint64(32)).astype(np.uint32), (t.hash[used] >> np.uint64(16)).astype(np.uint16), spelling[used].astype(np.float16)]
                + [_planes(place[c]) for c in columns]
                + [_planes(np.diff(d, prepend=0).astype(np.uint32)), _planes(times[at].astype(np.uint32)), trained[d].astype(np.uint8)]
            ),
        )


def _planes(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 4).T)


def _joined(planes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(planes.T).view(np.uint32).ravel().astype(np.int64)


def _distinct(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of one row of each kind, and the numbers of such rows."""
    order = np.lexsort(columns)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[order[1:]] != c[order[:-1]]
    first = np.flatnonzero(new)
    return order[first], np.diff(np.append(first, len(order)))


def _renumbered(columns: list[np.ndarray], most: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The numbers below most that occur, and the columns with places among these instead."""
    if most > 8 * sum(map(len, columns)):
        used, local = np.unique(np.concatenate(columns), return_inverse=True)
        return used, np.split(local, np.cumsum([len(c) for c in columns])[:-1])
    occurs = np.zeros(most, bool)
    for c in columns:
        occurs[c] = True
    place = np.cumsum(occurs) - 1
    return np.flatnonzero(occurs), [place[c] for c in columns]


def _rare(t: Tokens, common: np.ndarray) -> pa.Array:
    """Each document's words that aren't common, and their numbers."""
    at = np.flatnonzero(~common[t.numbers])
    kind, n = np.unique(t.doc[at].astype(np.int64) * len(t.hash) + t.numbers[at], return_counts=True)
    ends = np.searchsorted(kind // len(t.hash), np.arange(len(t.first) + 1))
    hashes = t.hash[kind % len(t.hash)].view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(hashes), pa.array(n, pa.int64())], names=["token", "n"]))


def _send(shared, groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model = shared.value
        for k, b in enumerate(_pieces(batches)):
            flush = f"{TaskContext.get().partitionId()}-{k}"
            t = Tokens(b["text"])
            place = np.minimum(np.searchsorted(model["common"], t.hash), len(model["common"]) - 1)
            count = np.where(model["common"][place] == t.hash, model["counts"][place], 0)
            common = count > 0
            common[END] = True
            base = np.where(common, np.log10(count + 0.5) - model["denominator"], 0.0)
            columns = {
                "doc_id": b["doc_id"],
                "held_out": b["held_out"],
                "n_tokens": pa.array(t.n_words + 1, pa.int64()),
                "n_bytes": pa.array(np.where(t.n_words > 0, t.n_bytes, 0), pa.int64()),
                "n_known": pa.array(np.add.reduceat((count > 0)[t.numbers].astype(np.int64), t.first)),
                "base": pa.array(np.add.reduceat(base[t.numbers], t.first)),
                "rare": _rare(t, common),
            }
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.table(columns).schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as f:
                f.write_table(pa.table(columns))
            trained = ~b["held_out"].to_numpy(zero_copy_only=False)
            out = [(k % groups, True, sink.getvalue().to_pybytes()), *((g, False, blob) for g, blob in _deal(t, model["letters"].spelling(t), count > model["hot"], trained, groups))]
            del t, place, count, common, base, columns, sink
            _release()
            for i in range(0, len(out), 64):
                g, is_docs, blob = zip(*out[i : i + 64], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array([flush] * len(g)), pa.array(is_docs), pa.array(blob, pa.binary())], names=["grp", "flush", "is_docs", "blob"])

    return run


PACKED = "grp long, flush string, is_docs boolean, blob binary"


def _mix_group(table: pa.Table) -> pa.Table:
    """What a group's events cost, by flush: documents, bits, bits left out. Rows of documents pass through."""
    docs = table.filter(table["is_docs"])
    events = table.filter(pc.invert(table["is_docs"])).sort_by("flush")
    if not events.num_rows:
        return docs
    parts = [_unpack(x.as_py()) for x in events["blob"]]
    events = events.drop_columns(["blob"])
    hashes = [p[0].astype(np.int64) << 16 | p[1] for p in parts]
    known, at = np.unique(np.concatenate([np.zeros(1, np.int64), *hashes]), return_inverse=True)
    spelling = np.zeros(len(known), np.float32)
    words = np.split(at[1:], np.cumsum([len(h) for h in hashes])[:-1])
    for w, p in zip(words, parts, strict=True):
        spelling[w] = p[2]
    one, two, token = (np.concatenate([w[_joined(p[k])].astype(np.int32) for w, p in zip(words, parts, strict=True)]) for k in (3, 4, 5))
    docs_of = [_joined(p[6]) for p in parts]
    number, trained = np.concatenate([_joined(p[7]).astype(np.int32) for p in parts]), np.concatenate([p[8] for p in parts]).astype(bool)
    bits, left = np.zeros(len(one), np.float32), np.zeros(len(one), np.float32)
    del parts, words, hashes, at
    # Each model has all events of its words before, so a group can be worked on in parts.
    models = max(1, -(-int(number.sum()) // MODEL_TOKENS))
    model = ((known.astype(np.uint64) * B) >> np.uint64(33)) % np.uint64(models)
    for k in range(models):
        at = np.flatnonzero(model[one] == k)
        if len(at):
            times = number[at] * trained[at]
            some, less, escapes = event_bits(one[at].astype(np.int64), two[at].astype(np.int64), token[at].astype(np.int64), times, len(known))
            spelled = np.where(escapes, spelling[token[at]], 0)
            bits[at] = (some + spelled) * number[at]
            left[at] = (np.where(trained[at], less, some) + spelled) * number[at]
    blobs, n = [], 0
    for doc in map(np.cumsum, docs_of):
        some = slice(n, n + len(doc))
        n += len(doc)
        found, to = np.unique(doc, return_inverse=True)
        blobs.append(_pack([found.astype(np.uint32), *(np.bincount(to, x[some]).astype(np.float32) for x in (bits, left))]))
    costs = pa.table({"grp": events["grp"], "flush": events["flush"], "is_docs": events["is_docs"], "blob": pa.array(blobs, pa.binary())}).cast(docs.schema)
    del one, two, token, number, trained, bits, left, docs_of
    _release()
    return pa.concat_tables([docs, costs])


def _sum_flush(table: pa.Table) -> pa.Table:
    (docs,) = table.filter(table["is_docs"])["blob"].to_pylist()
    out = pa.ipc.open_stream(docs).read_all()
    bits, left = np.zeros(out.num_rows), np.zeros(out.num_rows)
    for blob in table.filter(pc.invert(table["is_docs"])).sort_by("grp")["blob"]:
        doc, x, y = _unpack(blob.as_py())
        bits[doc] += x
        left[doc] += y
    return out.append_column("bits", pa.array(bits)).append_column("left_out", pa.array(left))


def score_documents(docs: DataFrame, train, key: str = "doc_id", text: str = "text", vocabulary: int = VOCABULARY, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte, left_out_bits_per_byte, one row
    per row of docs.

    train: a boolean column of docs; rows where it isn't true are held out. Bytes are those that are coded: of lower-case
    words with a space after each. left_out: every token of a training text with one count of its own event taken
    away, so that a text is cheap only if others are like it; for held-out texts the same as bits_per_byte. A null or
    empty text is its end alone (bits per byte: null). Repeated rows are counted and scored each. Without training rows
    every count is 0, and each decision costs one bit. Other columns of docs are not read.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), (~F.coalesce(train, F.lit(False))).alias("held_out"))
    counts = cut(d.select("text", "held_out").mapInArrow(_count, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    total = counts.where(F.col("kind") == ALL).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    words = counts.where(F.col("kind") == WORD).select(F.col("key").alias("token"), "n")
    n_train, n_distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    denominator = math.log10(n_train + 0.5 * (n_distinct + 1))
    # The least count from which on there are few enough words, as a power of 2.
    by_size = dict(words.groupBy(F.expr("length(bin(n)) - 1").alias("k")).count().collect())
    least, n = 62, 0
    while least > 0 and (n := n + by_size.get(least - 1, 0)) < vocabulary:
        least -= 1
    common = words.where((F.col("n") >= F.expr(f"shiftleft(1L, {least})")) | (F.col("token") == END)).toArrow()
    triples = counts.where(F.col("kind") == LETTERS).orderBy("key").toArrow()  # at most 2 ** 24
    tokens = np.append(common["token"].to_numpy().view(np.uint64), np.uint64(END))  # the end, with no count, if it was never trained on
    numbers = np.append(common["n"].to_numpy(), 0)
    order = np.unique(tokens, return_index=True)[1]
    model = {
        "common": tokens[order],
        "counts": numbers[order],
        "denominator": denominator,
        "hot": max(1, group_tokens // HOT),
        "letters": Letters(triples["key"].to_numpy(), triples["n"].to_numpy()),
    }
    shared = spark.sparkContext.broadcast(model)
    groups = max(1, -(-total // group_tokens))
    costs = d.mapInArrow(_send(shared, groups), PACKED).groupBy("grp").applyInArrow(_mix_group, PACKED)
    schema = "doc_id " + d.schema["doc_id"].dataType.simpleString() + ", held_out boolean, n_tokens long, n_bytes long, n_known long, base double, rare array<struct<token:bigint,n:bigint>>, bits double, left_out double"
    scored = cut(costs.groupBy("flush").applyInArrow(_sum_flush, schema).withColumn("rid", F.monotonically_increasing_id()), "scored")
    rare = scored.select("rid", F.inline("rare")).join(words.select("token", F.col("n").alias("c")), "token", "left")
    rest = rare.groupBy("rid").agg(
        F.sum(F.col("n") * (F.log10(F.coalesce("c", F.lit(0)) + 0.5) - denominator)).alias("more"),
        F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("also_known"),
    )
    per_byte = lambda c: F.when(F.col("n_bytes") > 0, F.col(c) / F.col("n_bytes"))
    return scored.join(rest, "rid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("also_known", F.lit(0))).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        (-F.col("bits") * math.log10(2)).alias("score"),
        per_byte("bits").alias("bits_per_byte"),
        per_byte("left_out").alias("left_out_bits_per_byte"),
    )


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir), ~held_out())
