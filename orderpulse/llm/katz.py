"""Katz backoff scoring: Good-Turing discounted n-grams of up to three words with exactly normalised backoff weights.

Tokens are words (A-Z lower-cased, split at ASCII white space) and one end per text. P(w|v) is r*/c(v) for a pair seen
r times, else alpha(v) P(w), and P(w) if v was never seen; P(w) is c*/N, and all unknown words share what is left.
Counts up to `K` lose what Good-Turing takes, with counts of counts over all training texts; higher ones lose half a
count, so that every context leaves something to the unseen. alpha(v) is what v leaves over the words unseen after v.
With order 3, P(w|u,v) is r*/c(u,v) for a triple seen r times, else alpha(u,v) P(w|v), and P(w|v) if u, v was never
seen; triples have discounts of their own, a text's start is the u of its second token, and its first is a pair.

How pairs run: word counts come first, in a table. Then every chunk of texts sends its pairs, with the texts that hold
them, to buckets of their second word, where all counts of that word and its pairs meet. What depends on a pair is
added up there for each text; the masses of a first word, and the texts that backed off from it, go on to buckets of
the first word, where alpha is computed. The recursion's terms so reach their text from three places and are added.
Words are known by their XXH64. No bucket follows one word: second words with more pairs than a bucket is meant for
are dealt by both words of the pair, and the masses of first words as frequent are added up in a table of their own, so
that their back-offs can stay in the buckets where they arise. Pairs of two words of a large share are counted
beforehand and never sent.

How triples run: a chunk sends each of its triples once, to a bucket of the middle word, which has all counts of the
triples, of both their pairs and of the middle word. The bucket answers with the counts in the order in which the
triples came, so that neither they nor the answer name a text. Only held out texts have triples never seen; those name
their text, and their back-offs from two words and from one go on to buckets of the context and of the first word.
Triples of a heavy middle word are dealt by their last two words and, if that pair is heavy too, by all three; the
contexts they spread over meet in the bucket of the context. As a pair's count is also that of the context it makes,
each triple divides by it on behalf of the next.

Defined cases: a null or empty text is one end; a null id is learnt from and not held out; rows that repeat count as
often as they come and each gets its score; without training texts every probability is 1; an empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderpulse.llm.common import settle

#: Counts up to this one are discounted by Good-Turing.
K = 5
HALF = 0.5
#: Bytes of text of a chunk and pairs of a bucket, about: a task holds some 100 bytes for each pair. Half as many triples.
CHUNK, BUCKET = 6_000_000, 1_200_000
#: Frequent words that every task knows by number (12 bytes each), and those whose pairs are counted beforehand.
KNOWN, HOT = 1 << 20, 256
END, BOS, NONE = np.uint64(1), np.uint64(2), np.uint64(3)
_U = np.uint64


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays, integers in the least width that holds them, compressed."""
    parts = []
    for a in arrays:
        if a.dtype.kind in "iu" and a.dtype != np.uint64:
            a = a.astype(np.min_scalar_type(int(a.max())) if len(a) else np.uint8)
        parts.append(np.array([len(a), a.dtype.itemsize, a.dtype.kind == "f"], np.int64).tobytes() + a.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(raw: bytes) -> list[np.ndarray]:
    data, at, found = zstandard.ZstdDecompressor().decompress(raw), 0, []
    while at < len(data):
        n, size, is_float = np.frombuffer(data, np.int64, 3, at).tolist()
        found.append(np.frombuffer(data, f"{'f' if is_float else 'u'}{size}", n, at + 24))
        at += 24 + n * size
    return found


def discounted(counts_of_counts: list[int]) -> np.ndarray:
    """r* for r = 0..K from N_1..N_(K+1), kept inside (0, r); absolute discounting where Good-Turing has no value."""
    n = [0, *counts_of_counts]
    found = np.zeros(K + 1)
    share = (K + 1) * n[K + 1] / n[1] if n[1] else 0.0
    for r in range(1, K + 1):
        if n[r] and n[r + 1] and share < 1:
            found[r] = r * (((r + 1) * n[r + 1] / (n[r] * r)) - share) / (1 - share)
        if not 0 < found[r] < r:
            found[r] = r - (n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else HALF)
        found[r] = min(max(found[r], 0.05 * r), r - 0.05)
    return found


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")).cast("long") % 5 == 1, F.lit(False))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of the batches: (slice, hashes of its words, then end and start; second words, first words, texts)."""
    for whole in batches:
        size = np.cumsum(pc.binary_length(pc.fill_null(whole.column("text"), "")).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = [0, *(np.flatnonzero(np.diff(size // CHUNK)) + 1).tolist(), whole.num_rows]
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            if a == z:
                continue
            batch = whole.slice(a, z - a)
            split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(batch.column("text"), "")))
            offsets = np.asarray(split.offsets)
            words = split.values[offsets[0]:offsets[-1]]
            real = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
            text = np.repeat(np.arange(batch.num_rows), np.diff(offsets))[real]
            coded = words.filter(pa.array(real)).dictionary_encode()
            names = coded.dictionary.to_pylist()
            hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in names), np.uint64, len(names))
            count = np.bincount(text, minlength=batch.num_rows) + 1
            ends = np.cumsum(count)
            second = np.full(ends[-1], len(names), np.int64)
            inner = np.ones(ends[-1], bool)
            inner[ends - 1] = False
            second[inner] = np.asarray(coded.indices)
            first = np.empty_like(second)
            first[1:] = second[:-1]
            first[ends - count] = len(names) + 1
            yield batch, np.concatenate([hashes, [END, BOS]]), second, first, np.repeat(np.arange(batch.num_rows), count)
            pa.default_memory_pool().release_unused()


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _mixed(a: np.ndarray, b: np.ndarray | None = None) -> np.ndarray:
    x = a if b is None else a * _U(0x9E3779B97F4A7C15) + b
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(29))


def _training(batch: pa.RecordBatch) -> np.ndarray:
    return ~batch.column("held").to_numpy(zero_copy_only=False)


def unigrams(docs: DataFrame) -> DataFrame:
    """Table (word, c): the hash of each token of the training texts and its count."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, names, second, _, text in _chunks(batches):
            n = np.bincount(second[_training(batch)[text]], minlength=len(names))
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(names[some].view(np.int64)), pa.array(n[some])], ["word", "n"])

    return settle(docs.select("text", "held").mapInArrow(work, "word long, n long").groupBy("word").agg(F.sum("n").alias("c")), "unigrams")


class Vocabulary:
    """What every task knows: sizes, discounts, and the counts of the frequent words and of the pairs of hot ones."""

    def __init__(self, table: DataFrame, texts: int):
        tops = [F.sum((F.col("c") == r).cast("long")) for r in range(1, K + 2)]
        total, size, *coc = (x or 0 for x in table.agg(F.sum("c"), F.count("*"), *tops).first())
        self.n, self.v, self.texts, self.most = total, size, texts, BUCKET
        self.star = discounted(coc)
        low = sum(coc[:K])
        used = float(self.star[1:] @ np.array(coc[:K])) + (total - sum(r * x for r, x in enumerate(coc[:K], 1))) - HALF * (size - low)
        self.unknown = 1 - used / total if total else 1.0
        # The least power of 2^(1/8) that at most KNOWN words reach; 512 rows at most.
        steps = {r["s"]: r["n"] for r in table.groupBy(F.floor(F.log2("c") * 8).alias("s")).agg(F.count("*").alias("n")).collect()}
        kept, least = 0, 10_000
        for s in sorted(steps, reverse=True):
            if kept + steps[s] > KNOWN:
                break
            kept, least = kept + steps[s], s
        rows = table.where(F.floor(F.log2("c") * 8) >= least).toArrow().combine_chunks()
        words, counts = rows["word"].to_numpy().astype(np.int64).view(np.uint64), rows["c"].to_numpy().astype(np.int64)
        order = np.argsort(words)
        self.words, self.counts = words[order], counts[order]
        hot = np.argsort(-self.counts, kind="stable")[:HOT]
        hot = np.sort(hot[self.counts[hot] * HOT > total])
        self.hot = np.append(self.words[hot], BOS) if texts else self.words[hot]
        self.hot.sort()
        self.pairs = np.zeros((len(self.hot), len(self.hot)), np.int64)

    def lookup(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each word is known here, and its count or 0."""
        if not len(self.words):
            return np.zeros(len(names), bool), np.zeros(len(names), np.int64)
        at = np.minimum(np.searchsorted(self.words, names), len(self.words) - 1)
        here = self.words[at] == names
        return here, np.where(here, self.counts[at], 0)

    def hots(self, names: np.ndarray) -> np.ndarray:
        """The number of each word among the hot ones, or -1."""
        if not len(self.hot):
            return np.full(len(names), -1)
        at = np.minimum(np.searchsorted(self.hot, names), len(self.hot) - 1)
        return np.where(self.hot[at] == names, at, -1)

    def heavy(self, names: np.ndarray) -> np.ndarray:
        """Whether each word, or the start, is in more pairs than a bucket is meant for."""
        return np.where(names == BOS, self.texts, self.lookup(names)[1]) > self.most

    def log_p(self, c: np.ndarray) -> np.ndarray:
        """log10 P(w) of words of the counts c."""
        if not self.n:
            return np.zeros(len(c))
        return np.where(c > 0, np.log10(np.maximum(np.where(c <= K, self.star[np.minimum(c, K)], c - HALF), 1e-300) / self.n), np.log10(self.unknown))

    def squeeze(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct words as steps between numbers of known ones, and the hashes of the others."""
        here, _ = self.lookup(names)
        return np.diff(np.searchsorted(self.words, names[here]), prepend=0), names[~here]

    def stretch(self, steps: np.ndarray, others: np.ndarray) -> np.ndarray:
        return np.sort(np.concatenate([self.words[np.cumsum(steps.astype(np.int64))], others.astype(np.uint64)]))


def count_hot_pairs(docs: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """How often each pair of hot words comes in the training texts; HOT + 1 squared numbers at most."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    width = max(1, len(vocabulary.hot))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = shared.value
        total = np.zeros(width * width, np.int64)
        for batch, names, second, first, text in _chunks(batches):
            hot = voc.hots(names)
            a, b = hot[first], hot[second]
            use = (a >= 0) & (b >= 0) & _training(batch)[text]
            total += np.bincount(a[use] * width + b[use], minlength=width * width)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["pair", "n"])

    found = np.zeros(width * width, np.int64)
    for pair, n in docs.select("text", "held").mapInArrow(work, "pair long, n long").groupBy("pair").agg(F.sum("n")).collect():
        found[pair] = n
    return found.reshape(width, width)[:len(vocabulary.hot), :len(vocabulary.hot)]


_MESSAGE = "kind int, dest long, chunk long, blob binary"
_TO_SECOND, _TO_FIRST, _TO_TEXT, _STATS, _MASS, _TO_TRIPLE, _TO_CONTEXT, _STATS3, _OWN, _REPLY = range(10)


def _rows(found: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    kind, dest, chunk, blob = zip(*found, strict=True) if found else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(dest, pa.int64()), pa.array(chunk, pa.int64()), pa.array(blob, pa.binary())], ["kind", "dest", "chunk", "blob"])


class Sums:
    """Terms of texts: a sum, how many pairs were seen 1..K times, the base model's sum, known tokens."""

    def __init__(self, n: int):
        self.n, self.score, self.seen, self.base, self.known = n, np.zeros(n), np.zeros((n, K), np.int64), np.zeros(n), np.zeros(n, np.int64)

    def pairs(self, text: np.ndarray, n: np.ndarray, r: np.ndarray, log_p: np.ndarray) -> None:
        """Terms of pairs seen r times; log_p is that of the second word alone."""
        for k in range(1, K + 1):
            self.seen[:, k - 1] += np.bincount(text[r == k], n[r == k], self.n).astype(np.int64)
        term = np.where(r > K, np.log10(np.maximum(r - HALF, HALF)), np.where(r > 0, 0.0, log_p))
        self.score += np.bincount(text, n * term, self.n)

    def words(self, text: np.ndarray, n: np.ndarray, c: np.ndarray, end: np.ndarray) -> None:
        """Terms of words of the counts c: as second words of the base model, and, but for ends, as first words."""
        self.base += np.bincount(text, n * np.log10(c + 0.5), self.n)
        self.known += np.bincount(text, n * (c > 0), self.n).astype(np.int64)
        self.score -= np.bincount(text, np.where(end, 0.0, n * np.log10(np.maximum(c, 1))), self.n)

    def blob(self, *more: np.ndarray) -> bytes:
        return pack(self.score, self.base, self.known, *self.seen.T, *more)


def _send(docs: DataFrame, vocabulary: Vocabulary, buckets: int) -> DataFrame:
    """Messages to the buckets of second words, to those of first words (hot pairs never seen), and to the texts."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = shared.value
        chunk = (TaskContext.get().partitionId() << 32) - 1
        for batch, names, second, first, text in _chunks(batches):
            chunk += 1
            out, size, train = [], batch.num_rows, _training(batch)
            sums = Sums(size)
            here, c = voc.lookup(names)
            known = here[second]
            sums.words(text[known], np.ones(known.sum()), c[second[known]], second[known] == len(names) - 2)
            hot, heavy = voc.hots(names), voc.heavy(names)
            a, b = hot[first], hot[second]
            both = (a >= 0) & (b >= 0)
            if both.any():
                r = voc.pairs[a[both], b[both]]
                sums.pairs(text[both], np.ones(both.sum()), r, voc.log_p(c[second[both]]))
                miss = np.flatnonzero(both)[r == 0]
                to = np.where(heavy[first[miss]], _U(chunk % buckets), _mixed(names[first[miss]]) % _U(buckets))
                for dest in np.unique(to):
                    mine = miss[to == dest]
                    words, own = np.unique(names[first[mine]], return_inverse=True)
                    out.append((_TO_FIRST, int(dest), chunk, pack(*voc.squeeze(words), *[np.zeros(0)] * 1, *[np.zeros(0, np.int64)] * (K + 2), own, text[mine], np.ones(len(mine), np.int64), np.zeros(len(mine), np.int64), np.array([chunk], np.int64))))
            ids = batch.column("doc_id")
            out.append((_TO_TEXT, chunk, chunk, sums.blob(np.bincount(text, minlength=size), pc.fill_null(ids, 0).to_numpy().view(np.uint64), ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8), train.astype(np.uint8))))
            first, second, text = first[~both], second[~both], text[~both]
            code = second * len(names) + first
            order = np.argsort(code, kind="stable")
            code, text = code[order], text[order]
            at = _runs(code, text)
            n = np.diff(at, append=len(code))
            code, text = code[at], text[at]
            kinds = _runs(code)
            texts = np.diff(kinds, append=len(code))
            w, v = code[kinds] // len(names), code[kinds] % len(names)
            dest = _mixed(names)[w]
            split = (hot[w] >= 0) | heavy[w]
            dest[split] = _mixed(names[w[split]], names[v[split]])
            dest = (dest % _U(buckets)).astype(np.int64)
            order = np.argsort(dest, kind="stable")
            bounds = np.searchsorted(dest[order], np.arange(buckets + 1))
            for bucket in np.flatnonzero(np.diff(bounds)):
                some = order[bounds[bucket]:bounds[bucket + 1]]
                entry = np.repeat(kinds[some] - (np.cumsum(texts[some]) - texts[some]), texts[some]) + np.arange(texts[some].sum())
                ws, wi = np.unique(names[w[some]], return_inverse=True)
                vs, vi = np.unique(names[v[some]], return_inverse=True)
                out.append((_TO_SECOND, int(bucket), chunk, pack(*voc.squeeze(ws), *voc.squeeze(vs), wi, vi, texts[some], text[entry], n[entry], np.packbits(train), np.array([size]))))
            yield _rows(out)

    return docs.select("doc_id", "text", "held").mapInArrow(work, _MESSAGE)


def _grouped(rows: DataFrame, parts: int, solve) -> DataFrame:
    """`solve(dest, messages)` for all messages of each dest, which come together in one task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            for kind, dest, chunk, blob in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if held and dest != last:
                    yield from solve(last, held)
                    held = []
                held.append((kind, chunk, blob))
                last = dest
        if held:
            yield from solve(last, held)

    return rows.repartition(parts, "dest").sortWithinPartitions("dest", "kind", "chunk").mapInArrow(work, _MESSAGE)


def _second_words(shared, buckets: int):
    """Counts of the words and pairs of a bucket, and the terms that depend on them."""

    def solve(bucket: int, messages: list) -> Iterator[pa.RecordBatch]:
        voc = shared.value
        # What is not for this bucket's words passes through.
        yield _rows([(k, bucket if k == _TO_FIRST else c, c, b) for k, c, b in messages if k != _TO_SECOND])
        messages = [m for m in messages if m[0] == _TO_SECOND]
        if not messages:
            return
        ws, vs, texts, ns, trains, sizes, chunks, counts = [], [], [], [], [], [], [], []
        for _, chunk, blob in messages:
            w1, w2, v1, v2, wi, vi, per, text, n, train, size = unpack(blob)
            ws.append(voc.stretch(w1, w2)[wi])
            vs.append(voc.stretch(v1, v2)[vi])
            counts.append(per.astype(np.int64))
            texts.append(text.astype(np.int64) + sum(sizes))
            ns.append(n.astype(np.int64))
            sizes.append(int(size[0]))
            trains.append(np.unpackbits(train)[:sizes[-1]].astype(bool))
            chunks.append(chunk)
        w, v = np.concatenate(ws), np.concatenate(vs)
        order = np.lexsort((v, w))
        starts = _runs(w[order], v[order])
        kind = np.empty(len(w), np.int64)
        kind[order] = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(w)))
        w, v = w[order][starts], v[order][starts]
        entry = np.repeat(kind, np.concatenate(counts))
        text, n, train = np.concatenate(texts), np.concatenate(ns), np.concatenate(trains)
        r = np.bincount(entry, n * train[text], len(w)).astype(np.int64)
        word = _runs(w)
        of = np.repeat(np.arange(len(word)), np.diff(word, append=len(w)))
        here, c = voc.lookup(w[word])
        c = np.where(here, c, np.bincount(of, r, len(word)).astype(np.int64))
        c_of, here = c[of], here[of]
        sums = Sums(sum(sizes))
        sums.pairs(text, n, r[entry], voc.log_p(c_of)[entry])
        rare = ~here[entry]
        sums.words(text[rare], n[rare], c_of[entry][rare], w[entry][rare] == END)
        out, at = [], 0
        for chunk, size in zip(chunks, sizes, strict=True):
            mine = Sums(size)
            mine.score, mine.base, mine.known, mine.seen = (x[at:at + size] for x in (sums.score, sums.base, sums.known, sums.seen))
            out.append((_TO_TEXT, chunk, chunk, mine.blob()))
            at += size
        out.append((_STATS, -1, -1, np.bincount(np.minimum(r, K + 2), minlength=K + 3)[1:K + 2].astype(np.int64).tobytes()))
        # Masses of the first words of seen pairs, and the texts with pairs never seen.
        p = 10 ** voc.log_p(c_of)
        missed = np.flatnonzero(r[entry] == 0)
        first, own = np.unique(v, return_inverse=True)
        dest = (_mixed(first) % _U(buckets)).astype(np.int64)
        seen = r > 0
        mass = np.bincount(own[seen], p[seen], len(first))
        bins = [np.bincount(own[r == k], minlength=len(first)) for k in range(1, K + 1)]
        bins += [np.bincount(own[r > K], r[r > K], len(first)).astype(np.int64), np.bincount(own[r > K], minlength=len(first))]
        ends = np.cumsum(sizes)
        where = np.searchsorted(ends, text[missed], side="right")
        local = text[missed] - (ends - sizes)[where]
        m_own, m_n = own[entry[missed]], n[missed]
        # Masses of heavy first words go to their table, the texts wait in this bucket; no other bucket is theirs.
        heavy = voc.heavy(first)
        dest[heavy] = buckets
        if heavy.any():
            out.append((_MASS, -1, -1, pack(*voc.squeeze(first[heavy]), mass[heavy], *[x[heavy] for x in bins])))
            late = np.flatnonzero(heavy[m_own])
            if len(late):
                some, which = np.unique(m_own[late], return_inverse=True)
                none = np.zeros(0, np.int64)
                out.append((_TO_FIRST, bucket, bucket, pack(*voc.squeeze(first[some]), np.zeros(0), *[none] * (K + 2), which, local[late], m_n[late], where[late], np.array(chunks, np.int64))))
        m_dest = dest[m_own]
        order, by = np.argsort(dest, kind="stable"), np.argsort(m_dest, kind="stable")
        bound, m_bound = np.searchsorted(dest[order], np.arange(buckets + 1)), np.searchsorted(m_dest[by], np.arange(buckets + 1))
        number = np.empty(len(first), np.int64)
        for d in np.flatnonzero(np.diff(bound)):
            some, miss = order[bound[d]:bound[d + 1]], by[m_bound[d]:m_bound[d + 1]]
            number[some] = np.arange(len(some))
            out.append((_TO_FIRST, int(d), bucket, pack(*voc.squeeze(first[some]), mass[some], *[x[some] for x in bins], number[m_own[miss]], local[miss], m_n[miss], where[miss], np.array(chunks, np.int64))))
        yield _rows(out)

    return solve


class Numbers:
    """Numbers of words: the known ones by falling count, then start, end and none; words beyond have a list of their own."""

    def __init__(self, voc: Vocabulary):
        by = np.argsort(-voc.counts, kind="stable")
        self.voc, self.size = voc, len(by) + 3
        self.rank = np.empty(len(by), np.int32)
        self.rank[by] = np.arange(len(by), dtype=np.int32)
        self.names = np.concatenate([voc.words[by], [BOS, END, NONE]])
        self.counts = np.concatenate([voc.counts[by], [voc.texts, voc.texts, 0]])

    def of(self, names: np.ndarray) -> np.ndarray:
        """The number of each word, or -1."""
        found = np.full(len(names), -1, np.int32)
        if len(self.rank):
            at = np.minimum(np.searchsorted(self.voc.words, names), len(self.rank) - 1)
            found = np.where(self.voc.words[at] == names, self.rank[at], found)
        for k, name in enumerate((BOS, END, NONE)):
            found[names == name] = self.size - 3 + k
        return found


def _planes(numbers: np.ndarray) -> list[np.ndarray]:
    """The bytes of 32-bit numbers, the lowest of all first: they pack better than the numbers."""
    return list(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T))


def _send_triples(docs: DataFrame, shared, buckets: int) -> DataFrame:
    """Messages to the buckets of triples and to the texts.

    A triple goes to the bucket of its middle word; of its last two if the middle word is heavy; of all three if those
    two are. A message holds a chunk's triples in the order of its texts, those of training texts first, so that the
    answer needs no addresses; only triples of held out texts carry their text.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = shared.value
        numbers = Numbers(voc)
        chunk = (TaskContext.get().partitionId() << 32) - 1
        for batch, names, second, first, text in _chunks(batches):
            chunk += 1
            size, train = batch.num_rows, _training(batch)
            end, start = len(names) - 2, len(names) - 1
            names = np.append(names, NONE)
            third = np.empty_like(first)
            third[1:] = first[:-1]
            third[first == start] = start + 1
            own = numbers.of(names)
            c = numbers.counts[own]
            here = own >= 0
            known = here & (c > 0)
            base = np.bincount(text, np.where(here, np.log10(c + 0.5), 0.0)[second], size)
            n_known = np.bincount(text, known[second], size).astype(np.int64)
            heavy, hot = voc.heavy(names), voc.hots(names)
            dest = (_mixed(names) % _U(buckets)).astype(np.int64)[first]
            dealt = np.flatnonzero(heavy[first])
            w, v = second[dealt], first[dealt]
            key = _mixed(names[w], names[v])
            both = np.flatnonzero((hot[w] >= 0) & (hot[v] >= 0))
            split = both[voc.pairs[hot[v[both]], hot[w[both]]] > voc.most]
            key[split] = _mixed(key[split], names[third[dealt[split]]])
            dest[dealt] = (key % _U(buckets)).astype(np.int64)
            ids = batch.column("doc_id")
            out = [(_OWN, chunk, chunk, pack(
                dest, np.bincount(text, minlength=size), pc.fill_null(ids, 0).to_numpy().view(np.uint64),
                ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8), train.astype(np.uint8), base, n_known,
            ))]
            order, bounds = _by_bucket(dest, train[text])
            sent = np.stack([second[order], first[order], third[order]])
            mine, held = own[sent], ~train[text[order]]
            for a, z in zip(bounds[:-1], bounds[1:]):
                code = mine[:, a:z].ravel()
                rare = np.flatnonzero(code < 0)
                others, at = np.unique(names[sent[:, a:z].ravel()[rare]], return_inverse=True)
                code[rare] = numbers.size + at
                late = int(held[a:z].sum())
                out.append((_TO_TRIPLE, int(dest[order[a]]), chunk, pack(*_planes(code), others, text[order[z - late:z]], np.array([late], np.int64))))
            yield _rows(out)

    return docs.select("doc_id", "text", "held").mapInArrow(work, _MESSAGE)


def _by_bucket(dest: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order in which a chunk's triples are sent, and the bounds of its messages."""
    key = dest * 2 + ~train
    order = np.argsort(key.astype(np.min_scalar_type(int(key.max()))), kind="stable")
    return order, np.append(_runs(dest[order]), len(order))


def _triples(shared, buckets: int):
    """Counts of the triples and pairs of a bucket, the answers to its chunks, and what is left to back-off.

    An answer has for each triple of the message its count, that of its pair, and for middle words that are not known
    beforehand their count (plus one) and whether the first two words were never seen. A pair's count is that of a
    context as well; a text so divides by it without asking again.
    """

    def solve(bucket: int, messages: list) -> Iterator[pa.RecordBatch]:
        voc = shared.value
        yield _rows([(k, c, c, b) for k, c, b in messages if k == _OWN])
        messages = [m for m in messages if m[0] == _TO_TRIPLE]
        if not messages:
            return
        numbers = Numbers(voc)
        codes, others, lates, texts, chunks = [], [], [], [], []
        for _, chunk, blob in messages:
            *planes, other, text, late = unpack(blob)
            codes.append(np.ascontiguousarray(np.stack(planes, axis=1)).view("<u4").ravel().astype(np.int32).reshape(3, -1))
            others.append(other.astype(np.uint64))
            lates.append(int(late[0]))
            texts.append(text.astype(np.int64))
            chunks.append(chunk)
        del messages
        extra = np.unique(np.concatenate(others))
        for code, other in zip(codes, others, strict=True):
            if len(other):
                own = numbers.size + np.searchsorted(extra, other)
                rare = code >= numbers.size
                code[rare] = own[code[rare] - numbers.size]
        sizes = np.array([c.shape[1] for c in codes])
        ends = np.cumsum(sizes)
        train = np.ones(ends[-1], bool)
        for z, late in zip(ends, lates):
            train[z - late:z] = False
        w, v, u = (np.concatenate([c[k] for c in codes]).astype(np.int64) for k in range(3))
        del codes
        names = np.concatenate([numbers.names, extra])
        width, base = len(names), numbers.size
        pair, of_pair = np.unique(v * width + w, return_inverse=True)
        triple, own = np.unique(of_pair * width + u, return_inverse=True)
        del w, v, u
        r3 = np.bincount(own[train], minlength=len(triple))
        r2 = np.bincount(of_pair[train], minlength=len(pair))
        of, u = triple // width, triple % width
        v, w = pair // width, pair % width
        a, b = voc.hots(names[v]), voc.hots(names[w])
        hot = (a >= 0) & (b >= 0)
        r2[hot] = voc.pairs[a[hot], b[hot]]
        word = _runs(v)
        per = np.diff(word, append=len(v))
        rare = v[word] >= base
        c = np.where(rare, np.add.reduceat(r2, word), numbers.counts[np.minimum(v[word], base - 1)])
        rare, c, heavy, of_word = np.repeat(rare, per), np.repeat(c, per), np.repeat(voc.heavy(names[v[word]]), per), np.repeat(np.arange(len(word)), per)
        opens = u == base - 1
        r3[opens] = 0
        out = [(kind, -1, -1, np.bincount(np.minimum(r, K + 2), minlength=K + 3)[1:K + 2].astype(np.int64).tobytes()) for kind, r in ((_STATS, r2[~hot]), (_STATS3, r3))]
        # Contexts of middle words that are not known beforehand: all of them are here.
        some = np.flatnonzero(rare[of])
        context, at = np.unique(v[of[some]] * width + u[some], return_inverse=True)
        met = np.bincount(at, r3[some], len(context)) > 0
        fresh = np.zeros(len(triple), np.uint8)
        fresh[some] = ~met[at]
        count = np.where(rare, c + 1, 0)
        for a, z, chunk in zip(ends - sizes, ends, chunks):
            mine, two = own[a:z], of_pair[a:z]
            out.append((_REPLY, chunk, bucket, pack(r3[mine], r2[two], count[two], fresh[mine])))
        yield _rows(out)
        out = []
        # Masses that these words, as second ones, have in the contexts of the first.
        first, at = np.unique(context[met] % width, return_inverse=True)
        if len(first):
            mass = np.zeros(width)
            mass[v[word]] = 10 ** voc.log_p(c[word])
            out += _masses(voc, buckets, names[first], np.bincount(at, mass[context[met] // width], len(first)))
        # Held out triples never seen: their pair's terms, then the back-offs.
        where = np.repeat(np.arange(len(chunks)), lates)
        text, entry, two = np.concatenate(texts), own[~train], of_pair[~train]
        missed = np.flatnonzero(r3[entry] == 0)
        where, text, entry, two = where[missed], text[missed], entry[missed], two[missed]
        chunks = np.array(chunks, np.int64)
        alone = r2[two] == 0
        term = np.where(opens[entry], 0.0, -np.log10(np.maximum(c[two], 1)))
        plain = alone & (w[two] < base)
        term[plain] += voc.log_p(numbers.counts[w[two[plain]]])
        out += _to_texts(chunks[where], text, term)
        ask = np.flatnonzero(alone & (c[two] > 0))
        asked = np.zeros(len(word), bool)
        asked[of_word[two[ask]]] = True
        some = np.flatnonzero((r2 > 0) & ~hot & (asked | heavy[word])[of_word])
        own_word, r = of_word[some], r2[some]
        mass = np.bincount(own_word, np.where(w[some] < base, 10 ** voc.log_p(numbers.counts[np.minimum(w[some], base - 1)]), 0.0), len(word))
        bins = [np.bincount(own_word[r == k], minlength=len(word)) for k in range(1, K + 1)]
        bins += [np.bincount(own_word[r > K], r[r > K], len(word)).astype(np.int64), np.bincount(own_word[r > K], minlength=len(word))]
        none = np.zeros(0, np.int64)
        for kind in (False, True):
            want = np.flatnonzero((heavy[word] == kind) & asked)
            want = want[np.argsort(names[v[word[want]]])]
            place = np.zeros(len(word), np.int64)
            place[want] = np.arange(len(want))
            late = ask[heavy[two[ask]] == kind]
            if len(late):
                sums = [np.zeros(0), *[none] * (K + 2)] if kind else [mass[want], *[x[want] for x in bins]]
                out.append((_TO_FIRST, bucket, bucket, _addressed(voc, names[v[word[want]]], sums, [place[of_word[two[late]]], text[late], np.ones(len(late), np.int64), where[late], chunks])))
        big = np.flatnonzero(heavy[word])
        if len(big):
            big = big[np.argsort(names[v[word[big]]])]
            out.append((_MASS, -1, -1, _addressed(voc, names[v[word[big]]], [mass[big], *[x[big] for x in bins]], [])))
        yield _rows(out)
        yield _rows(_to_contexts(bucket, buckets, names, (of, u, v, c, heavy, r3, r2), (entry, two, text, where, np.flatnonzero(~opens[entry])), chunks))

    return solve


def _addressed(voc: Vocabulary, names: np.ndarray, sums: list, asks: list) -> bytes:
    """A message about first words, which come in the order of their names: known ones by steps."""
    return pack(*voc.squeeze(names), *sums, *asks)


def _masses(voc: Vocabulary, buckets: int, names: np.ndarray, mass: np.ndarray) -> list[tuple[int, int, int, bytes]]:
    """Messages with masses alone: to the table of heavy words and to the buckets of the others."""
    order = np.argsort(names)
    names, mass = names[order], mass[order]
    heavy, found = voc.heavy(names), []
    dest = np.where(heavy, -1, (_mixed(names) % _U(buckets)).astype(np.int64))
    order = np.argsort(dest, kind="stable")
    bounds = np.append(_runs(dest[order]), len(order))
    for a, z in zip(bounds[:-1], bounds[1:]):
        some, to = order[a:z], int(dest[order[a]])
        nothing, none = [np.zeros(z - a, np.int64)] * (K + 2), [np.zeros(0, np.int64)] * 5
        found.append((_MASS if to < 0 else _TO_FIRST, to, -1, _addressed(voc, names[some], [mass[some], *nothing], [] if to < 0 else none)))
    return found


def _to_texts(chunk: np.ndarray, text: np.ndarray, term: np.ndarray) -> list[tuple[int, int, int, bytes]]:
    """Terms added up by text, a message for each chunk."""
    order = np.lexsort((text, chunk))
    chunk, text, term = chunk[order], text[order], term[order]
    starts = _runs(chunk, text)
    if not len(starts):
        return []
    chunk, text, term = chunk[starts], text[starts], np.add.reduceat(term, starts)
    bounds = [*_runs(chunk).tolist(), len(chunk)]
    return [(_TO_TEXT, int(chunk[a]), int(chunk[a]), pack(text[a:z], term[a:z])) for a, z in zip(bounds, bounds[1:])]


def _to_contexts(bucket: int, buckets: int, names: np.ndarray, table: tuple, asks: tuple, chunks: np.ndarray) -> list[tuple[int, int, int, bytes]]:
    """The counts of contexts of two words, and the texts that back off from them. The contexts of a heavy middle word
    are spread over buckets and meet in one of their own; others are whole here, and only those asked for go on."""
    of, u, v, c, heavy, r3, r2 = table
    entry, two, text, where, ask = asks
    entry, two, text, where = entry[ask], two[ask], text[ask], where[ask]
    wanted = _mixed(names[u[entry]], names[v[two]])
    some = np.flatnonzero(r3 > 0)
    key = _mixed(names[u[some]], names[v[of[some]]])
    use = heavy[of[some]].copy()
    if len(wanted):
        asked = np.unique(wanted)
        use |= asked[np.minimum(np.searchsorted(asked, key), len(asked) - 1)] == key
    some, key = some[use], key[use]
    spread, m_spread = heavy[of[some]], heavy[two]
    dest = np.where(spread, (key % _U(buckets)).astype(np.int64), bucket)
    m_dest = np.where(m_spread, (wanted % _U(buckets)).astype(np.int64), bucket)
    order, by = np.lexsort((key, dest)), np.argsort(m_dest, kind="stable")
    some, key, dest, m_dest, found = some[order], key[order], dest[order], m_dest[by], []
    for d in np.union1d(dest, m_dest).tolist():
        mine, late = slice(*np.searchsorted(dest, [d, d + 1])), by[slice(*np.searchsorted(m_dest, [d, d + 1]))]
        keys, idx = np.unique(wanted[late], return_inverse=True)
        starts = _runs(key[mine])
        kept = some[mine]
        found.append((_TO_CONTEXT, d, bucket, pack(
            key[mine][starts], np.diff(starts, append=len(kept)), c[of[kept[starts]]], r3[kept], r2[of[kept]],
            keys, idx, text[late], np.ones(len(late), np.int64), where[late], chunks,
        )))
    return found


def _texts_of_triples(shared, star: np.ndarray, star3: np.ndarray):
    """Puts the answers to a chunk in the order of its texts and adds their terms up: one row for each text."""

    def logs(r: np.ndarray, discounts: np.ndarray) -> np.ndarray:
        return np.where(r > K, np.log10(np.maximum(r - HALF, HALF)), np.log10(np.append(1.0, discounts[1:]))[np.minimum(r, K)])

    def solve(messages: list[tuple[int, bytes]]) -> pa.RecordBatch:
        voc, replies, late = shared.value, [], []
        for kind, blob in messages:
            if kind == _OWN:
                dest, tokens, ids, valid, train, base, known = unpack(blob)
            else:
                (replies if kind == _REPLY else late).append(unpack(blob))
        size = len(tokens)
        tokens, known, score = tokens.astype(np.int64), known.astype(np.int64), np.zeros(size)
        text = np.repeat(np.arange(size), tokens)
        ends = np.zeros(len(text), bool)
        ends[np.cumsum(tokens) - 1] = True
        order, _ = _by_bucket(dest.astype(np.int64), train[text].astype(bool))
        text, ends = text[order], ends[order]
        r3, r2, count, fresh = (np.concatenate(x).astype(np.int64) for x in zip(*replies, strict=True))
        term = np.where(r3 > 0, logs(r3, star3), logs(r2, star)) - np.where(ends, 0.0, np.log10(np.maximum(r2, 1)))
        score = np.bincount(text, term, size)
        rare = np.flatnonzero(count)
        text, c, fresh = text[rare], count[rare] - 1, fresh[rare]
        base = base + np.bincount(text, np.log10(c + 0.5), size)
        known = known + np.bincount(text, c > 0, size).astype(np.int64)
        score += np.bincount(text, fresh * voc.log_p(c), size)
        for text, term in late:
            score[text.astype(np.int64)] += term
        if voc.texts:
            score = score - np.log10(voc.texts)
        return _scored(voc, ids, valid, train, tokens, known, base, score)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            for kind, dest, blob in zip(*(batch.column(k).to_pylist() for k in ("kind", "dest", "blob")), strict=True):
                if held and dest != last:
                    yield solve(held)
                    held = []
                held.append((kind, blob))
                last = dest
        if held:
            yield solve(held)

    return work


def _contexts(star: np.ndarray, star3: np.ndarray):
    """alpha of the contexts of two words of a bucket, and the terms of the texts that backed off from them."""

    def solve(bucket: int, messages: list) -> Iterator[pa.RecordBatch]:
        names, held, missed = [], [], []
        for _, _, blob in messages:
            key, per, c, r3, r2, keys, idx, text, n, where, chunks = unpack(blob)
            names.append(np.repeat(key, per.astype(np.int64)))
            held.append((np.repeat(c, per.astype(np.int64)).astype(np.float64), r3.astype(np.int64), r2.astype(np.int64)))
            if len(idx):
                missed.append((keys[idx], chunks.astype(np.int64)[where], text.astype(np.int64), n.astype(np.float64)))
        if not missed:
            return
        key, chunk, text, n = (np.concatenate(x) for x in zip(*missed, strict=True))
        asked, of = np.unique(key, return_inverse=True)
        seen = np.concatenate(names)
        at = np.minimum(np.searchsorted(asked, seen), len(asked) - 1)
        use = asked[at] == seen
        at, (c, r3, r2) = at[use], (np.concatenate(x)[use] for x in zip(*held, strict=True))
        left = np.bincount(at, np.where(r3 <= K, r3 - star3[np.minimum(r3, K)], HALF), len(asked))
        q = np.bincount(at, np.where(r2 <= K, star[np.minimum(r2, K)], r2 - HALF) / c, len(asked))
        weight = np.where(left > 0, np.log10(np.maximum(left, 1e-300)) - np.log10(np.maximum(1 - q, 1e-15)), 0.0)
        term = n * weight[of]
        order = np.lexsort((text, chunk))
        chunk, text, term = chunk[order], text[order], term[order]
        starts = _runs(chunk, text)
        chunk, text, term = chunk[starts], text[starts], np.add.reduceat(term, starts)
        bounds = [*_runs(chunk).tolist(), len(chunk)]
        yield _rows([(_TO_TEXT, int(chunk[a]), int(chunk[a]), pack(text[a:z], term[a:z])) for a, z in zip(bounds, bounds[1:])])

    return solve


def _heavy_weights(met: DataFrame, voc: Vocabulary, star: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The heavy first words in order and log10(c(v) alpha(v)) of each; their number is below that of the buckets."""
    columns = ["q", *[f"m{k}" for k in range(K + 2)]]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                steps, others, *sums = unpack(blob)
                yield pa.RecordBatch.from_arrays([pa.array(voc_of.value.stretch(steps, others).view(np.int64)), *[pa.array(x.astype(np.float64)) for x in sums]], ["word", *columns])

    voc_of = met.sparkSession.sparkContext.broadcast(voc)
    rows = met.where(F.col("kind") == _MASS).select("blob").mapInArrow(work, "word long, " + ", ".join(f"{c} double" for c in columns))
    found = {r[0]: np.array(r[1:]) for r in rows.groupBy("word").agg(*[F.sum(c) for c in columns]).collect()}
    for word, sums in zip(voc.hot[(heavy := voc.heavy(voc.hot))].view(np.int64).tolist(), _hot_sums(voc)[heavy], strict=True):
        found[word] = found.get(word, 0.0) + sums
    words = np.array(list(found), np.int64).view(np.uint64)
    order = np.argsort(words)
    sums = np.array(list(found.values())).reshape(-1, K + 3)[order]
    return words[order], context_weight(sums[:, 1:], sums[:, 0], star)


def _first_words(shared, star: np.ndarray, first_masses: dict[int, bytes], weights):
    """alpha of the first words of a bucket, and the terms of the texts that backed off from them or, in this bucket,
    from heavy ones, whose weights are known."""

    def solve(bucket: int, messages: list) -> Iterator[pa.RecordBatch]:
        voc = shared.value
        blobs = [b for k, _, b in messages if k == _TO_FIRST] + ([first_masses[bucket]] if bucket in first_masses else [])
        names, masses, bins, missed = [], [], [], []
        for blob in blobs:
            steps, others, mass, *rest = unpack(blob)
            own = voc.stretch(steps, others)
            more, (idx, text, n, where, chunks) = rest[:K + 2], rest[K + 2:]
            if len(mass):
                names.append(own)
                masses.append(mass)
                bins.append(np.stack([x.astype(np.float64) for x in more], axis=1))
            if len(idx):
                missed.append((own[idx], chunks.astype(np.int64)[where], text.astype(np.int64), n.astype(np.float64)))
        if not missed:
            return
        first, own = np.unique(np.concatenate(names) if names else np.zeros(0, np.uint64), return_inverse=True)
        q = np.bincount(own, np.concatenate(masses), len(first)) if names else np.zeros(0)
        m = np.zeros((len(first), K + 2))
        if names:
            np.add.at(m, own, np.concatenate(bins))
        log_alpha = context_weight(m, q, star)
        v, chunk, text, n = (np.concatenate(x) for x in zip(*missed, strict=True))
        if len(first):
            at = np.minimum(np.searchsorted(first, v), len(first) - 1)
            term = np.where((first[at] == v) & (m[at].sum(axis=1) > 0), n * log_alpha[at], 0.0)
        else:
            term = np.zeros(len(v))
        heavy, weight = weights.value
        if len(heavy):
            at = np.minimum(np.searchsorted(heavy, v), len(heavy) - 1)
            term = np.where(heavy[at] == v, n * weight[at], term)
        order = np.lexsort((text, chunk))
        chunk, text, term = chunk[order], text[order], term[order]
        starts = _runs(chunk, text)
        chunk, text, term = chunk[starts], text[starts], np.add.reduceat(term, starts)
        for a, z in zip(s := _runs(chunk), [*s[1:], len(chunk)], strict=True):
            yield _rows([(_TO_TEXT, int(chunk[a]), int(chunk[a]), pack(text[a:z], term[a:z]))])

    return solve


def context_weight(m: np.ndarray, q: np.ndarray, star: np.ndarray) -> np.ndarray:
    """log10(c(v) alpha(v)) for first words: m has the pairs seen 1..K times, the sum of the higher counts and their
    number; q is the sum of P(w) over the words seen after v."""
    c = m[:, :K] @ np.arange(1, K + 1) + m[:, K]
    left = c - m[:, :K] @ star[1:] - m[:, K] + HALF * m[:, K + 1]
    return np.log10(np.maximum(left, 1e-300)) - np.log10(np.maximum(1 - q, 1e-15))


def _scored(voc: Vocabulary, ids, valid, train, tokens, known, base, score) -> pa.RecordBatch:
    base = base - tokens * np.log10(voc.n + 0.5 * (voc.v + 1))
    return pa.RecordBatch.from_arrays(
        [pa.array(ids.view(np.int64), mask=valid == 0), pa.array(train == 0), pa.array(tokens.astype(np.int64)), pa.array(known), pa.array(np.full(len(ids), voc.n, np.int64)), pa.array(base), pa.array(score)],
        ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    )


def _texts(shared, star: np.ndarray):
    """Adds a chunk's terms up: one row for each text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(messages: list[bytes]) -> pa.RecordBatch:
            voc, parts, late, own = shared.value, [], [], None
            for blob in messages:
                arrays = unpack(blob)
                if len(arrays) == 2:
                    late.append(arrays)
                else:
                    parts.append(arrays[:K + 3])
                    own = arrays[K + 3:] or own
            score = np.sum([p[0] for p in parts], axis=0)
            base = np.sum([p[1] for p in parts], axis=0)
            known = np.sum([p[2].astype(np.int64) for p in parts], axis=0)
            for k in range(1, K + 1):
                score = score + np.sum([p[2 + k].astype(np.int64) for p in parts], axis=0) * np.log10(star[k])
            for text, term in late:
                score[text.astype(np.int64)] += term
            tokens, ids, valid, train = own
            if voc.texts:
                score = score - np.log10(voc.texts)
            return _scored(voc, ids, valid, train, tokens, known, base, score)

        held, last = [], None
        for batch in batches:
            for dest, blob in zip(batch.column("dest").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                if held and dest != last:
                    yield solve(held)
                    held = []
                held.append(blob)
                last = dest
        if held:
            yield solve(held)

    return work


def _discounts(met: DataFrame, kind: int, coc: np.ndarray) -> np.ndarray:
    """r* from the counts of counts of all buckets, added to `coc`."""
    for row in met.where(F.col("kind") == kind).select("blob").toLocalIterator():
        coc = coc + np.frombuffer(row[0], np.int64)
    return discounted(coc.tolist())


def score(docs: DataFrame, order: int = 2) -> DataFrame:
    """Scores of all texts by the model of those that are not held out (column held), of words in pairs or triples."""
    if order not in (2, 3):
        raise ValueError(f"order must be 2 or 3, not {order}")
    spark = docs.sparkSession
    texts = docs.where(~F.col("held")).count()
    table = unigrams(docs)
    voc = Vocabulary(table, texts)
    voc.pairs = count_hot_pairs(docs, voc)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if order == 3:
        voc.most = max(1, BUCKET // 2)
    buckets = max(parts, -(-voc.n // voc.most))
    shared = spark.sparkContext.broadcast(voc)
    sent, solve = (_send(docs, voc, buckets), _second_words(shared, buckets)) if order == 2 else (_send_triples(docs, shared, buckets), _triples(shared, buckets))
    met = settle(_grouped(sent, buckets, solve), "pairs")
    star = _discounts(met, _STATS, np.bincount(np.minimum(voc.pairs.ravel(), K + 2), minlength=K + 3)[1:K + 2].astype(np.int64))
    weights = spark.sparkContext.broadcast(_heavy_weights(met, voc, star))
    every = _grouped(met.where(F.col("kind") == _TO_FIRST), buckets, _first_words(shared, star, _hot_masses(voc, buckets), weights))
    every = every.unionByName(met.where(F.col("kind").isin(_TO_TEXT, _OWN, _REPLY)))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    if order == 2:
        return every.select("dest", "blob").repartition("dest").sortWithinPartitions("dest").mapInArrow(_texts(shared, star), schema)
    star3 = _discounts(met, _STATS3, np.zeros(K + 1, np.int64))
    every = every.unionByName(_grouped(met.where(F.col("kind") == _TO_CONTEXT), buckets, _contexts(star, star3)))
    return every.repartition("dest").sortWithinPartitions("dest", "kind", "chunk").mapInArrow(_texts_of_triples(shared, star, star3), schema)


def _hot_sums(voc: Vocabulary) -> np.ndarray:
    """The masses of hot first words from their pairs with hot words: q, pairs seen 1..K times, higher counts, their number."""
    _, c = voc.lookup(voc.hot)
    mass = (voc.pairs > 0) @ np.where(voc.hot == BOS, 0.0, 10 ** voc.log_p(c))
    bins = [(voc.pairs == k).sum(axis=1) for k in range(1, K + 1)] + [np.where(voc.pairs > K, voc.pairs, 0).sum(axis=1), (voc.pairs > K).sum(axis=1)]
    return np.stack([mass, *bins], axis=1)


def _hot_masses(voc: Vocabulary, buckets: int) -> dict[int, bytes]:
    """The sums of the hot first words that are not heavy, by bucket."""
    light = ~voc.heavy(voc.hot)
    if not light.any():
        return {}
    hot, sums = voc.hot[light], _hot_sums(voc)[light]
    dest, found, none = (_mixed(hot) % _U(buckets)).astype(np.int64), {}, np.zeros(0, np.int64)
    for d in np.unique(dest):
        some = np.flatnonzero(dest == d)
        found[int(d)] = pack(*voc.squeeze(hot[some]), sums[some, 0], *sums[some, 1:].astype(np.int64).T, none, none, none, none, none)
    return found
