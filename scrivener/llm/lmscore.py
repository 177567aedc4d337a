"""Masked pseudo-likelihood scores from a bidirectional window network trained in numpy.

Every word is predicted from the SIDE words on both its sides: their embeddings (a table for each place) are summed,
and a two-step softmax gives the class of the word and the word within its class. A document's score is the sum of
the log-probabilities of its words. The network's ids are the WORDS most frequent words of the whole corpus and hash
buckets for the others; a word of a bucket adds log P(word | bucket), its share of the bucket's words in the whole
corpus, so every word of the corpus has a probability of its own and those of all words sum to 1 at every place.
Words are lower-cased (A-Z).

What is gathered follows the corpus: word counts of all documents (summed before the shuffle), and training over all
words of all documents. Texts are read twice, for counts and to be written as ids (2 bytes a word) with their shares.
Training goes in ROUNDS. Documents are dealt by a hash to shards of about SHARD words and, within them, to rounds. In a
round every shard trains a copy of the network over its documents in order of id, and the copies are averaged, weighted by
words, in order of shard; the next round goes on from there. Neither documents nor sums depend on how the table is
partitioned, so the scores don't. Averages are taken in steps of FAN copies a task; one network comes to the driver.

Shares of the words above a count that at most SHARED words reach are a table that every task holds; those of all
others, as many as the corpus has, are joined by word. Only that table, a histogram of counts and the averaged network
come to the driver.

Defined results: null text counts as empty; a text without words has score 0 and a null mean; repeated rows give
repeated results; null ids pass through; an empty table gives an empty table; other columns don't matter.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivener.llm.common import Written, id_of, keyed, text_of, written
from scrivener.llm.hashing import Powers, word_hashes

WORDS, CLASSES, WIDTH, SIDE = 448, 16, 16, 2
#: Ids in all: WORDS frequent words and buckets of others.
IDS = 512
#: Words of buckets whose shares every task holds (16 bytes each); the shares of the others are joined.
SHARED = 1_000_000
BATCH, RATE = 4096, 0.1
ROUNDS, SHARD, FAN = 2, 2_000_000, 64
#: Bytes of documents handled at once, and words; a longer document is handled alone.
CHUNK, MANY = 1_000_000, 200_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class Vocabulary:
    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int):
        """hashes: most frequent first. Ids are dealt to classes so that classes are of like weight."""
        self.held, self.logs, self.total = np.zeros(0, np.uint64), np.zeros(0), total
        self.order = np.argsort(hashes, kind="stable")
        self.sorted, self.known = hashes[self.order], len(hashes)
        rest = max(total - int(counts.sum()), 1)
        buckets = np.full(IDS - WORDS, rest / (IDS - WORDS))
        filler = np.ones(WORDS - self.known)
        self.frequency = np.concatenate([counts, filler, buckets]) / max(total, 1)

    def ids(self, words: np.ndarray) -> np.ndarray:
        out = (WORDS + (words >> np.uint64(20)) % np.uint64(IDS - WORDS)).astype(np.int64)
        if self.known:
            at = np.minimum(np.searchsorted(self.sorted, words), self.known - 1)
            hit = self.sorted[at] == words
            out[hit] = self.order[at[hit]]
        return out

    def hold(self, words: np.ndarray, logs: np.ndarray) -> None:
        """log P(word | bucket) of the words that every task holds."""
        order = np.argsort(words)
        self.held, self.logs = words[order], logs[order]

    def shares(self, words: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log P(word | id), 0 where it isn't held, and places of the words whose share is to be joined."""
        out, rare = np.zeros(len(words)), np.flatnonzero(ids >= WORDS)
        if len(self.held) and len(rare):
            at = np.minimum(np.searchsorted(self.held, words[rare]), len(self.held) - 1)
            hit = self.held[at] == words[rare]
            out[rare[hit]], rare = self.logs[at[hit]], rare[~hit]
        return out, rare


def contexts(ids: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """(words, 2 * SIDE) ids around each word; IDS where the document has none."""
    out = np.full((len(ids), 2 * SIDE), IDS, np.int64)
    for c, k in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
        a, b = max(0, -k), len(ids) - max(0, k)
        if b > a:
            same = owner[a:b] == owner[a + k : b + k]
            out[a:b, c][same] = ids[a + k : b + k][same]
    return out


class Network:
    """Id i is word i // CLASSES of class i % CLASSES."""

    NAMES = ("embed", "class_w", "class_b", "word_w", "word_b")

    def __init__(self, frequency: np.ndarray):
        rng = np.random.default_rng(7)
        f = np.maximum(frequency, 1e-9).reshape(-1, CLASSES).T
        self.embed = rng.normal(0, 0.1, (2 * SIDE, IDS + 1, WIDTH)).astype(np.float32)
        self.class_w = rng.normal(0, 0.1, (WIDTH, CLASSES)).astype(np.float32)
        self.class_b = np.log(f.sum(1)).astype(np.float32)
        self.word_w = rng.normal(0, 0.1, (CLASSES, WIDTH, IDS // CLASSES)).astype(np.float32)
        self.word_b = np.log(f / f.sum(1, keepdims=True)).astype(np.float32)

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES])

    def load(self, flat: np.ndarray) -> Network:
        at = 0
        for n in self.NAMES:
            x = getattr(self, n)
            setattr(self, n, flat[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return self

    def _hidden(self, around: np.ndarray) -> np.ndarray:
        h = self.embed[0, around[:, 0]]
        for c in range(1, 2 * SIDE):
            h = h + self.embed[c, around[:, c]]
        return h

    @staticmethod
    def _softmax(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = z - z.max(1, keepdims=True)
        e = np.exp(z)
        s = e.sum(1, keepdims=True)
        return z - np.log(s), e / s

    def _by_class(self, target: np.ndarray):
        kind = target % CLASSES
        order = np.argsort(kind, kind="stable")
        edges = np.searchsorted(kind[order], np.arange(CLASSES + 1))
        for c in range(CLASSES):
            rows = order[edges[c] : edges[c + 1]]
            if len(rows):
                yield c, rows

    def log_probability(self, target: np.ndarray, around: np.ndarray) -> np.ndarray:
        h = self._hidden(around)
        log, _ = self._softmax(h @ self.class_w + self.class_b)
        out = log[np.arange(len(target)), target % CLASSES].astype(np.float64)
        for c, rows in self._by_class(target):
            log, _ = self._softmax(h[rows] @ self.word_w[c] + self.word_b[c])
            out[rows] += log[np.arange(len(rows)), target[rows] // CLASSES]
        return out

    def train(self, target: np.ndarray, around: np.ndarray, seen: dict) -> None:
        """One step of Adagrad on the mean log-probability of a batch."""
        n, h = len(target), self._hidden(around)
        _, p = self._softmax(h @ self.class_w + self.class_b)
        p[np.arange(n), target % CLASSES] -= 1
        grads = {"class_w": h.T @ p, "class_b": p.sum(0), "word_w": np.zeros_like(self.word_w), "word_b": np.zeros_like(self.word_b)}
        dh = p @ self.class_w.T
        for c, rows in self._by_class(target):
            hc = h[rows]
            _, q = self._softmax(hc @ self.word_w[c] + self.word_b[c])
            q[np.arange(len(rows)), target[rows] // CLASSES] -= 1
            grads["word_w"][c], grads["word_b"][c] = hc.T @ q, q.sum(0)
            dh[rows] += q @ self.word_w[c].T
        embed = np.empty_like(self.embed)
        for c in range(2 * SIDE):
            for j in range(WIDTH):
                embed[c, :, j] = np.bincount(around[:, c], dh[:, j], IDS + 1)
        grads["embed"] = embed
        for name, g in grads.items():
            g = g / n
            seen[name] = seen.get(name, 1e-6) + g * g
            setattr(self, name, getattr(self, name) - (RATE * g / np.sqrt(seen[name])).astype(np.float32))


def _groups(texts: list[bytes]):
    """Consecutive rows of about CHUNK bytes."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > CHUNK:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def _words(texts: list[bytes], powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every word."""
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    words, starts = word_hashes(b"\n".join(texts).translate(_LOWER), powers)
    return words, np.searchsorted(offsets, starts, "right") - 1


def _texts(b, i: int) -> list[bytes]:
    return [t.as_py() for t in b.column(i).cast(pa.binary())]


def _counts(batches):
    powers = Powers()
    for b in batches:
        texts = _texts(b, 0)
        parts = [_words(texts[i:j], powers)[0] for i, j in _groups(texts)]
        v, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *parts]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(n)], ["word", "n"])


ENCODED = "x struct<doc_id: bigint, _id: bigint, _key: bigint>, row bigint, ids binary, share double, rare array<struct<word: bigint, n: bigint>>"


def _encoded(vocabulary: Vocabulary):
    """ids (2 bytes each), the sum of the held log shares, and the words whose share is to be joined."""

    def run(batches):
        powers = Powers()
        for b in batches:
            texts = _texts(b, 2)
            for i, j in _groups(texts):
                words, owner = _words(texts[i:j], powers)
                ids = vocabulary.ids(words)
                share, at = vocabulary.shares(words, ids)
                edges = np.searchsorted(owner, np.arange(j - i + 1))
                flat = ids.astype("<u2")
                # equal unheld words of a document stand once, with their number
                order = at[np.lexsort((words[at], owner[at]))]
                w, o = words[order], owner[order]
                first = np.flatnonzero(np.concatenate([np.ones(min(1, len(w)), bool), (w[1:] != w[:-1]) | (o[1:] != o[:-1])]))
                rare = pa.StructArray.from_arrays([pa.array(w[first].view(np.int64)), pa.array(np.diff(np.append(first, len(w))))], ["word", "n"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(o[first], np.arange(j - i + 1)).astype(np.int32)), rare)
                own = pa.array([flat[p:q].tobytes() for p, q in zip(edges[:-1], edges[1:], strict=True)], pa.binary())
                sums = pa.array(np.bincount(owner, share, j - i).astype(float))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), own, sums, lists], ["x", "row", "ids", "share", "rare"])

    return run


def _gathered_ids(rows):
    """(first row, rows, ids, row of each id) of consecutive documents of about MANY words; rows are their ids as bytes."""
    at, held, size = 0, [], 0

    def made():
        return at, len(held), np.concatenate(held), np.repeat(np.arange(len(held)), [len(h) for h in held])

    for r, x in enumerate(rows):
        held.append(np.frombuffer(x, "<u2").astype(np.int64))
        size += len(held[-1])
        if size >= MANY:
            yield made()
            at, held, size = r + 1, [], 0
    if held:
        yield made()


def _trained(vocabulary: Vocabulary, flat: np.ndarray | None):
    """(shard, n, net) of the shards of a partition, which come one after the other, each in the order of its documents."""

    def run(batches):
        def rows():
            for b in batches:
                yield from zip(b.column(0).to_pylist(), (x.as_py() for x in b.column(1)), strict=True)

        for shard, group in groupby(rows(), key=lambda r: r[0]):
            net, seen, total = Network(vocabulary.frequency), {}, 0
            if flat is not None:
                net.load(flat)
            for _, _, ids, owner in _gathered_ids(x for _, x in group):
                around = contexts(ids, owner)
                for k in range(0, len(ids), BATCH):
                    net.train(ids[k : k + BATCH], around[k : k + BATCH], seen)
                total += len(ids)
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([total], pa.int64()), pa.array([net.flat().astype("<f8").tobytes()], pa.binary())], ["shard", "n", "net"])

    return run


def _averaged(batches):
    """(shard div FAN, n, net) of the shards of a partition, which come in order."""

    def rows():
        for b in batches:
            yield from zip(*(b.column(k).to_pylist() for k in range(3)), strict=True)

    for group, members in groupby(rows(), key=lambda r: r[0] // FAN):
        total, n = 0.0, 0
        for _, k, net in members:
            total, n = total + np.frombuffer(net, "<f8") * k, n + k
        yield pa.RecordBatch.from_arrays([pa.array([group], pa.int64()), pa.array([n], pa.int64()), pa.array([(total / n).tobytes()], pa.binary())], ["shard", "n", "net"])


def _scored(vocabulary: Vocabulary, flat: np.ndarray):
    def run(batches):
        net = Network(vocabulary.frequency).load(flat)
        for b in batches:
            for at, size, ids, owner in _gathered_ids(x.as_py() for x in b.column(2)):
                around = contexts(ids, owner)
                each = [net.log_probability(ids[k : k + BATCH], around[k : k + BATCH]) for k in range(0, len(ids), BATCH)]
                n = np.bincount(owner, minlength=size)
                own = b.column(3).slice(at, size).to_numpy(zero_copy_only=False) + np.bincount(owner, np.concatenate([np.zeros(0), *each]), size)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, size), b.column(1).slice(at, size), pa.array(n, pa.int64()), pa.array(own, pa.float64())], ["x", "row", "n_words", "log_likelihood"])

    return run


def _gathered(texts: DataFrame) -> tuple[Vocabulary, DataFrame | None]:
    """The vocabulary, and (w, share) of the words that it doesn't hold."""
    counts = written(texts.mapInArrow(_counts, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "words")
    top = counts.orderBy(F.desc("n"), "word").limit(WORDS).collect()
    total = counts.agg(F.sum("n")).first()[0] or 0
    hashes, most = np.array([r["word"] for r in top], np.int64).view(np.uint64), np.array([r["n"] for r in top], np.float64)
    vocabulary = Vocabulary(hashes, most, total)
    bucket = F.shiftrightunsigned("word", 20) % (IDS - WORDS)
    sums = np.zeros(IDS)
    for r in counts.groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("n")).collect():
        sums[WORDS + r["bucket"]] = r["n"]
    np.subtract.at(sums, WORDS + ((hashes >> np.uint64(20)) % np.uint64(IDS - WORDS)).astype(np.int64), most)
    least, held, others = None, 0, False
    for r in counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).toLocalIterator():
        if held + r["words"] > SHARED:
            others = True
            break
        least, held = r["n"], held + r["words"]
    if least is not None:
        found = counts.filter(F.col("n") >= least).toArrow()
        words, n = (found.column(k).to_numpy() for k in ("word", "n"))
        words = words.astype(np.int64).view(np.uint64)
        ids = vocabulary.ids(words)
        rare = ids >= WORDS
        vocabulary.hold(words[rare], np.log(n[rare] / sums[ids[rare]]))
    if not others:
        return vocabulary, None
    share = F.log("n") - F.log(F.get(F.array(*(F.lit(float(x)) for x in sums[WORDS:])), bucket.cast("int")))
    rest = counts if least is None else counts.filter(F.col("n") < least)
    return vocabulary, rest.select(F.col("word").alias("w"), share.alias("share"))


def vocabulary_of(texts: DataFrame) -> Vocabulary:
    return _gathered(texts)[0]


def encoded(docs: DataFrame, vocabulary: Vocabulary, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of docs as ids; to be written, as it numbers its rows."""
    i, k, t = keyed(docs, doc_id, text)
    rows = docs.select(F.struct(id_of(docs, doc_id).alias("doc_id"), i, k).alias("x"), F.monotonically_increasing_id().alias("row"), t)
    return rows.mapInArrow(_encoded(vocabulary), ENCODED)


def network_of(ids: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """Parameters after ROUNDS of training; ids as written from encoded()."""
    shards = -(-vocabulary.total // SHARD) or 1
    schema, flat = "shard bigint, n bigint, net binary", None
    dealt = ids.filter(F.length("ids") > 0).select(F.pmod(F.xxhash64("x._id", "x._key"), F.lit(shards)).alias("shard"), F.pmod(F.xxhash64(F.lit("round"), "x._id", "x._key"), F.lit(ROUNDS)).alias("round"), "x._id", "x._key", "ids")
    for k in range(ROUNDS):
        mine = dealt.filter(F.col("round") == k).repartition(min(shards, 10_000), "shard").sortWithinPartitions("shard", "_id", "_key")
        nets, left = Written(mine.select("shard", "ids").mapInArrow(_trained(vocabulary, flat), schema), "networks"), shards
        while left > 1:
            left = -(-left // FAN)
            steps = nets.df.repartition(min(left, 10_000), F.floor(F.col("shard") / FAN)).sortWithinPartitions("shard")
            after = Written(steps.mapInArrow(_averaged, schema), "networks")
            nets.drop()
            nets = after
        net = nets.df.first()
        flat = flat if net is None else np.frombuffer(net["net"], "<f8")
        nets.drop()
    return Network(vocabulary.frequency).flat() if flat is None else flat


def scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, log_likelihood."""
    vocabulary, rest = _gathered(docs.select(text_of(docs, text).alias("t")))
    ids = written(encoded(docs, vocabulary, doc_id, text), "encoded")
    own = ids.select("x", "row", "ids", "share").mapInArrow(_scored(vocabulary, network_of(ids, vocabulary)), "x struct<doc_id: bigint, _id: bigint, _key: bigint>, row bigint, n_words bigint, log_likelihood double")
    if rest is None:
        return own.select("x.doc_id", "n_words", "log_likelihood")
    words = ids.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.n")
    more = words.join(rest, F.col("word") == F.col("w")).groupBy(F.col("row").alias("_r")).agg(F.sum(F.col("n") * F.col("share")).alias("more"))
    joined = own.join(more, F.col("row") == F.col("_r"), "left")
    return joined.select("x.doc_id", "n_words", (F.col("log_likelihood") + F.coalesce("more", F.lit(0.0))).alias("log_likelihood"))


def query(docs: DataFrame) -> DataFrame:
    return scores(docs).withColumn("mean_log_likelihood", F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words")))
