"""Phrase collocation mining by dynamic itemset counting over cyclic shard scans.

Texts are read once into blocks of word numbers, dealt to a few shards. The shards are scanned in a cycle, one
a step. All words are counted from step 0. A longer phrase is activated at the step after both its subphrases
(all but its last word, all but its first) have reached the threshold in what is counted so far, in the middle of
a cycle as well; it is then counted in every step until it has seen each shard once. So lengths interleave: while
rare words still gather counts, frequent pairs and triples are under way. Scans end one full cycle after the last
word, pair or triple has reached the threshold.

What tasks must know is the step in which a phrase reached the threshold. It is held in one byte per slot of the
phrases' 64-bit hash, in a table of a fixed size (``SLOTS`` at most, 64 MB): the only thing that is broadcast. A
slot shared with another phrase can only activate a phrase too early, never lose one: it is counted over a full
cycle all the same. When far more phrases are frequent than slots, more is counted and the result is the same.
The counts themselves lie in bins by hash, packed, in the shared folder: a block sends each active phrase once a
step, bins add up, drop what has ended its cycle below the threshold, and give back which slots were reached.

At the end the blocks' words give the frequent phrases their text, each from one block; counts are added up once
more there by the hash and a second hash, which tells apart what shares the first one. Cuts, containment, scores
and ranks are joins and aggregates over the table of frequent phrases.

Defined results: null texts are empty, a null lang is ``und``; repeated rows count as often as they occur; equal
scores go by count, then by the phrase's bytes; extra columns are not used, whatever their names; an empty table,
or one without frequent phrases, gives no rows; a text of any length is cut into blocks between pieces.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import LOWER, UPPER, mix64, read, shared_dir, store

THRESHOLD = 30
LONGEST = 4
TOP = 2000
#: A phrase inside a longer one goes if the longer has at least this share of its count, in percent.
INSIDE = 80
#: Shards of a cycle.
SHARDS = 4
#: Bytes of text in a block, about.
BLOCK_BYTES = 8 << 20
#: Words of the corpus for a bin, about; at least LEAST_BINS bins. Both powers of two.
BIN_WORDS, LEAST_BINS = 1 << 22, 64
#: Bytes of the broadcast table, at most; a slot for every 16 words of the corpus below that.
SLOTS, LEAST_SLOTS = 1 << 26, 1 << 16
#: Step of a slot that no phrase has reached.
NEVER = 255

_TABLE = bytes(b + 32 if 65 <= b <= 90 else 46 if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Words(dict):
    """word -> number; languages have a dictionary each and share one list of words."""

    def __init__(self, seen: list[bytes]):
        super().__init__({b".": -1})
        self.seen = seen

    def __missing__(self, w: bytes) -> int:
        n = self[w] = len(self.seen)
        self.seen.append(w)
        return n


BLOCKS = "shard int, block long, ids binary, hashes binary, checks binary, words binary, word_lang binary, langs array<string>, n array<long>"
TYPES = [pa.int32(), pa.int64(), *[pa.binary()] * 5, pa.list_(pa.string()), pa.list_(pa.int64())]


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _chunks(text: bytes, most: int) -> Iterator[bytes]:
    """A text in parts of about ``most`` bytes, cut at the ends of pieces."""
    at = 0
    while len(text) - at > most:
        end = text.find(b".", at + most)
        if end < 0:
            break
        yield text[at:end]
        at = end + 1
    yield text[at:]


class Block:
    """Gathers texts: word numbers with -1 after each piece, and the words they stand for, by language."""

    def __init__(self):
        self.seen: list[bytes] = []
        self.by_lang: dict[str, Words] = {}
        self.owner: dict[str, int] = {}
        self.ids: list[np.ndarray] = []
        self.lang_of: list[np.ndarray] = []
        self.n: list[int] = []
        self.size = 0

    def add(self, lang: str, text: bytes) -> None:
        words = self.by_lang.get(lang)
        if words is None:
            words = self.by_lang[lang] = Words(self.seen)
            self.owner[lang] = len(self.owner)
            self.n.append(0)
        before, tokens = len(self.seen), text.replace(b".", b" . ").split()
        ids = np.fromiter(map(words.__getitem__, tokens), np.int32, len(tokens))
        self.ids += (ids, np.array([-1], np.int32))
        self.lang_of.append(np.full(len(self.seen) - before, self.owner[lang], np.uint16))
        self.n[self.owner[lang]] += int((ids >= 0).sum())
        self.size += len(text) + 16

    def row(self, shard: int, no: int) -> pa.RecordBatch:
        lang_of = np.concatenate(self.lang_of)
        langs = list(self.by_lang)
        seeds = [xxhash.xxh3_64_intdigest(x.encode()) for x in langs]
        words = list(zip(self.seen, lang_of.tolist()))
        h = mix64(np.array([xxhash.xxh3_64_intdigest(w, seeds[k]) for w, k in words], np.uint64))
        c = np.array([xxhash.xxh64_intdigest(w, seeds[k]) >> 32 for w, k in words], np.uint32)
        row = [shard, no, np.concatenate(self.ids).tobytes(), h.tobytes(), c.tobytes(), b"\n".join(self.seen), lang_of.tobytes(), langs, self.n]
        return pa.record_batch([pa.array([v], k) for v, k in zip(row, TYPES)], _names(BLOCKS))


def _blocks(docs: DataFrame, shards: int, most: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, block = TaskContext.get().partitionId(), 0, Block()
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for chunk in _chunks((text or "").encode("utf-8", "surrogatepass").translate(_TABLE), most):
                    block.add(lang, chunk)
                    if block.size >= most:
                        yield block.row((part + k) % shards, (part << 32) + k)
                        k, block = k + 1, Block()
        if block.size:
            yield block.row((part + k) % shards, (part << 32) + k)

    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(run, BLOCKS)


def _narrow(x: np.ndarray) -> tuple[str, bytes]:
    kind = np.min_scalar_type(int(x.max(initial=0)))
    return kind.str, x.astype(kind).tobytes()


class Reached:
    """The step in which each slot of phrase hashes reached the threshold."""

    def __init__(self, bits: int):
        self.step, self.shift = np.full(1 << bits, NEVER, np.uint8), np.uint64(64 - bits)

    def of(self, keys: np.ndarray) -> np.ndarray:
        return self.step[keys >> self.shift]


def grams(ids: np.ndarray, hashes: np.ndarray, reached: Reached) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length k from 2: positions of phrases whose subphrases have been reached, their hashes and first steps.

    A first step follows from the slots alone, so all blocks agree on it; a later one than the present is to come.
    """
    word = hashes[ids]
    key = word
    reach = np.where(ids >= 0, reached.of(hashes)[ids], np.uint8(NEVER))
    for k in range(2, LONGEST + 1):
        start = np.maximum(reach[:-1], reach[1:])
        at = np.flatnonzero(start < NEVER)
        with np.errstate(over="ignore"):
            own = mix64(key[at] * _A + word[at + k - 1] * _B + np.uint64(k))
        yield k, at, own, start[at].astype(np.int64) + 1
        key = np.zeros(len(start), np.uint64)
        key[at] = own
        # a slot shared with another phrase may be reached before this one is counted
        step = reached.of(own)
        reach = np.full(len(start), NEVER, np.uint8)
        reach[at] = np.where(step < NEVER, np.maximum(step, start[at] + 1), NEVER)


COUNTS = "bin long, k int, start int, keys binary, kind string, counts binary"


def _by_bin(keys: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """Bins of sorted hashes, by their leading bits, with the part of the array that each one has."""
    own, at = np.unique(keys >> np.uint64(64 - bits), return_index=True)
    for b, s, e in zip(own.tolist(), at, [*at[1:], len(keys)]):
        yield b, slice(s, e)


def _count(step: int, shards: int, bits: int, known):
    """Counts of the active phrases of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reached = known.value
        for batch in batches:
            for raw_ids, raw_hashes in zip(batch.column(0), batch.column(1)):
                ids, hashes = np.frombuffer(raw_ids.as_py(), np.int32), np.frombuffer(raw_hashes.as_py(), np.uint64)
                if not len(hashes):
                    continue
                found = []
                if step < shards:
                    order = np.argsort(hashes)
                    found.append((1, 0, hashes[order], np.bincount(ids[ids >= 0], minlength=len(hashes))[order]))
                for k, _, keys, start in grams(ids, hashes, reached):
                    for first in range(max(1, step - shards + 1), step + 1):
                        if len(mine := keys[start == first]):
                            found.append((k, first, *np.unique(mine, return_counts=True)))
                rows = [(b, k, first, keys[s].tobytes(), *_narrow(n[s])) for k, first, keys, n in found for b, s in _by_bin(keys, bits)]
                if rows:
                    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.binary())
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], _names(COUNTS))

    return run


def _unpack(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["keys"]])
    return keys, np.concatenate([np.frombuffer(x, k) for x, k in zip(pdf["counts"], pdf["kind"])]).astype(np.int64)


def _merge(step: int, shards: int, bits: int, slot_bits: int, threshold: int):
    """New counts of a bin; a row of length 0 has a bit for each of the bin's slots that was reached in this step."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, b = [], int(pdf["bin"].iloc[0])
        slots, going = np.zeros(1 << (slot_bits - bits), np.uint8), 0
        for (k, first), part in pdf.groupby(["k", "start"]):
            keys, counts = _unpack(part)
            old = np.repeat(~part["fresh"].to_numpy(bool), [len(x) // 8 for x in part["keys"]])
            uniq, inv = np.unique(keys, return_inverse=True)
            total = np.bincount(inv, counts, len(uniq)).astype(np.int64) if counts.sum() < 1 << 50 else _exact(inv, counts, len(uniq))
            before = np.zeros(len(uniq), np.int64)
            before[inv[old]] = counts[old]  # a hash is there once at most
            new = (total >= threshold) & (before < threshold)
            if new.any():
                slots[(uniq[new] >> np.uint64(64 - slot_bits)).astype(np.int64) - (b << (slot_bits - bits))] = 1
                going |= k < LONGEST
            if step - first + 1 >= shards:
                uniq, total = uniq[total >= threshold], total[total >= threshold]
            if len(uniq):
                rows.append((b, k, first, uniq.tobytes(), *_narrow(total)))
        if slots.any():
            rows.append((b, 0, int(going), np.packbits(slots).tobytes(), None, None))
        return pd.DataFrame(rows, columns=_names(COUNTS))

    return run


def _exact(inv: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    total = np.zeros(n, np.int64)
    np.add.at(total, inv, counts)
    return total


def _discard(spark: SparkSession, path: str) -> None:
    """Delete a table of an earlier step, which nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _power(n: int, least: int, most: int) -> int:
    """Bits of the smallest power of two that holds n, between two powers."""
    return min(max(least, 1 << max(0, int(n) - 1).bit_length()), most).bit_length() - 1


def count_phrases(blocks: DataFrame, words: int, shards: int = SHARDS, threshold: int = THRESHOLD, slot_bits: int | None = None) -> tuple[DataFrame | None, Reached, int, list[str]]:
    """Cyclic scans: counts of the frequent phrases in bins, the slots they reached, bits of the bins, a log of the steps."""
    spark = blocks.sparkSession
    bits = _power(-(-words // BIN_WORDS), LEAST_BINS, 1 << 40)
    slot_bits = max(bits, slot_bits or _power(-(-words // 16), LEAST_SLOTS, SLOTS))
    reached, base, log = Reached(slot_bits), f"{shared_dir(spark)}/phrases-{uuid.uuid4().hex[:12]}", []
    state, last, step = None, -1, 0
    # shared slots put off a phrase's first step by one for each length at most
    while words and (step < shards or step <= last + shards + LONGEST - 2):
        known = spark.sparkContext.broadcast(reached)
        fresh = blocks.where(F.col("shard") == step % shards).select("ids", "hashes").mapInArrow(_count(step, shards, bits, known), COUNTS).withColumn("fresh", F.lit(True))
        if state is not None:
            fresh = fresh.union(state.where("k > 0").withColumn("fresh", F.lit(False)))
        fresh.groupBy("bin").applyInPandas(_merge(step, shards, bits, slot_bits, threshold), COUNTS).write.parquet(f"{base}/{step}")
        if state is not None:
            _discard(spark, f"{base}/{step - 1}")
        state = spark.read.schema(COUNTS).parquet(f"{base}/{step}")
        known.unpersist()
        # a bit for each slot at most, whatever the corpus
        for r in state.where("k = 0").select("bin", "start", "keys").toLocalIterator():
            size = 1 << (slot_bits - bits)
            mine = reached.step[r["bin"] * size : (r["bin"] + 1) * size]
            mine[(np.unpackbits(np.frombuffer(r["keys"], np.uint8))[:size] == 1) & (mine == NEVER)] = step
            if r["start"]:
                last = step
        log.append(f"{base}/{step}")
        step += 1
    return state, reached, bits, log


FOUND = "bin long, k int, block long, keys binary, checks binary, kind string, counts binary, ids binary"
WANTED = "block long, k int, counts binary, ids binary"


def _distinct(keys: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by hash, then second hash, and where each distinct pair of them starts in it; not of nothing."""
    order = np.argsort(keys)
    other = np.diff(keys[order]) != 0
    if (~other & (np.diff(check[order]) != 0)).any():
        order = np.lexsort((check, keys))
        other = (np.diff(keys[order]) != 0) | (np.diff(check[order]) != 0)
    return order, np.flatnonzero(np.concatenate(([True], other)))


def _locate(bits: int, known):
    """Each block's reached phrases with a second hash, their counts there and their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reached = known.value
        for batch in batches:
            for no, raw_ids, raw_hashes, raw_checks in zip(*(batch.column(n) for n in range(4))):
                ids, hashes, checks = (np.frombuffer(x.as_py(), t) for x, t in ((raw_ids, np.int32), (raw_hashes, np.uint64), (raw_checks, np.uint32)))
                rows = []
                if len(hashes):
                    counts, place = np.bincount(ids[ids >= 0], minlength=len(hashes)), np.empty(len(hashes), np.int64)
                    place[ids[ids >= 0]] = np.flatnonzero(ids >= 0)
                    for k, at, keys, _ in [(1, place, hashes, None), *grams(ids, hashes, reached)]:
                        on = reached.of(keys) < NEVER
                        at, keys = at[on], keys[on]
                        if not len(at):
                            continue
                        check = np.zeros(len(at), np.uint64)
                        for j in range(k):
                            with np.errstate(over="ignore"):
                                check = mix64(check * _B + checks[ids[at + j]] + np.uint64(j + 1))
                        check = (check >> np.uint64(32)).astype(np.uint32)
                        order, first = _distinct(keys, check)
                        n = np.add.reduceat(counts[on][order], first) if k == 1 else np.diff(np.append(first, len(order)))
                        first = order[first]
                        keys, check, words = keys[first], check[first], np.stack([ids[at[first] + j] for j in range(k)], axis=1)
                        rows += [(b, k, no.as_py(), keys[s].tobytes(), check[s].tobytes(), *_narrow(n[s]), words[s].tobytes()) for b, s in _by_bin(keys, bits)]
                if rows:
                    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.string(), pa.binary(), pa.binary())
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], _names(FOUND))

    return run


def _pick(threshold: int):
    """Frequent phrases of a bin: corpus counts, and the words of each in the first block that holds it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for k, part in pdf.groupby("k"):
            counted, part = part[part["block"] < 0], part[part["block"] >= 0].sort_values("block")
            if not len(counted) or not len(part):
                continue
            sure = np.sort(_unpack(counted)[0])
            keys, n = _unpack(part)
            check = np.concatenate([np.frombuffer(x, np.uint32) for x in part["checks"]])
            block = np.repeat(part["block"].to_numpy(np.int64), [len(x) // 8 for x in part["keys"]])
            ids = np.concatenate([np.frombuffer(x, np.int32) for x in part["ids"]]).reshape(-1, k)
            on = sure[np.minimum(np.searchsorted(sure, keys), len(sure) - 1)] == keys
            both = np.stack((keys[on], check[on].astype(np.uint64)), axis=1).view("u8,u8").ravel()
            uniq, first, inv = np.unique(both, return_index=True, return_inverse=True)
            total = _exact(inv, n[on], len(uniq))
            keep = total >= threshold
            block, ids, total = block[on][first][keep], ids[on][first][keep], total[keep]
            order = np.argsort(block, kind="stable")
            own, at = np.unique(block[order], return_index=True)
            for b, s, e in zip(own.tolist(), at, [*at[1:], len(order)]):
                rows.append((b, k, total[order[s:e]].tobytes(), ids[order[s:e]].tobytes()))
        return pd.DataFrame(rows, columns=_names(WANTED))

    return run


PHRASES = "lang string, phrase string, k int, f long"


def _write(pdf: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
    rows = []
    if len(pdf):
        r = pdf.iloc[0]
        words = [w.decode("utf-8", "surrogatepass") for w in r["words"].split(b"\n")]
        lang_of, langs = np.frombuffer(r["word_lang"], np.uint16), list(r["langs"])
        for k, counts, ids in zip(wanted["k"], wanted["counts"], wanted["ids"]):
            ids = np.frombuffer(ids, np.int32).reshape(-1, k)
            rows += [(langs[g], " ".join(map(words.__getitem__, x)), k, f) for g, x, f in zip(lang_of[ids[:, 0]].tolist(), ids.tolist(), np.frombuffer(counts, np.int64).tolist())]
    return pd.DataFrame(rows, columns=_names(PHRASES))


def frequent_phrases(docs: DataFrame, shards: int = SHARDS, threshold: int = THRESHOLD, block_bytes: int = BLOCK_BYTES, slot_bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, f) of all phrases of 1 to 4 words that occur at least ``threshold`` times in a lang; (lang, n)."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/phrases-blocks-{uuid.uuid4().hex[:12]}"
    _blocks(docs, shards, block_bytes).write.option("compression", "zstd").option("parquet.block.size", 32 << 20).partitionBy("shard").parquet(path)
    blocks = spark.read.schema(BLOCKS).parquet(path)
    totals = store(blocks.select(F.explode(F.arrays_zip("langs", "n")).alias("x")).groupBy(F.col("x.langs").alias("lang")).agg(F.sum("x.n").alias("n")), "phrases-n")
    words = totals.agg(F.sum("n")).first()[0] or 0
    state, reached, bits, log = count_phrases(blocks, words, shards, threshold, slot_bits)
    if state is None:
        return spark.createDataFrame([], PHRASES), totals
    known = spark.sparkContext.broadcast(reached)
    found = blocks.select("block", "ids", "hashes", "checks").mapInArrow(_locate(bits, known), FOUND)
    sure = state.where("k > 0").select("bin", "k", F.lit(-1).cast("long").alias("block"), "keys", F.lit(None).cast("binary").alias("checks"), "kind", "counts", F.lit(None).cast("binary").alias("ids"))
    wanted = found.union(sure).groupBy("bin").applyInPandas(_pick(threshold), WANTED)
    texts = blocks.select("block", "words", "word_lang", "langs").groupBy("block").cogroup(wanted.groupBy("block")).applyInPandas(_write, PHRASES)
    out = store(texts, "phrases-found")
    _discard(spark, path)
    _discard(spark, log[-1])
    return out, totals


def collocations(found: DataFrame, totals: DataFrame, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each lang's best phrases of two or more words."""
    spark, w = found.sparkSession, F.split("phrase", " ")
    whole = found.where("k > 1")
    # the cut after c words with the least score
    cuts = whole.withColumn("c", F.explode(F.sequence(F.lit(1), F.col("k") - 1))).select(
        "lang", "phrase", F.col("f").alias("a"), "c", F.array_join(F.slice(w, F.lit(1), F.col("c")), " ").alias("first"), F.array_join(F.slice(w, F.col("c") + 1, F.col("k") - F.col("c")), " ").alias("rest")
    )
    part = lambda name, count: found.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    score = F.expr("cast(2000000 as decimal(8,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    least = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "c", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "x.score")
    # the most frequent longer candidate around each phrase
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("k") - m + 1), lambda i: F.array_join(F.slice(w, i, m), " "))))
    around = whole.where("k > 2").select("lang", F.explode(spans).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = least.join(around, ["lang", "phrase"], "left").where(f"longer IS NULL OR 100 * longer < {INSIDE} * a").drop("longer")
    kept = store(kept, "phrases-scored")
    # only scores that can be among the best meet in a lang's last sort: scores by hundreds, counted from above
    bucket = F.expr("score div 100")
    counts = kept.groupBy("lang", bucket.alias("b")).agg(F.count("*").alias("x")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("b", "x")), asc=False).alias("all"))
    down = F.aggregate("all", F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).cast("long").alias("b")), lambda s, e: F.when(s["sum"] < top, F.struct((s["sum"] + e["x"]).alias("sum"), e["b"].alias("b"))).otherwise(s))
    best = kept.join(counts.select("lang", down["b"].alias("cut")), "lang").where(bucket >= F.col("cut"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    # many equal scores: first the best of each of a lang's parts
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    best = best.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(*frequent_phrases(read(spark, sf_dir, "documents").select("lang", "text")))


OP12_SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents
), lists AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM lists GROUP BY 1),
places AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM lists, (SELECT unnest([1, 2, 3, 4]) AS k)),
found AS (
  SELECT lang, k, w[i:i + k - 1] AS p, count(*) AS f FROM places GROUP BY 1, 2, 3 HAVING count(*) >= {THRESHOLD}
), cand AS (SELECT * FROM found WHERE k > 1),
cuts AS (SELECT lang, k, p, f, unnest(range(1, k)) AS c FROM cand),
scored AS (
  SELECT x.lang, x.p, x.f AS a, y.f AS l, z.f AS r, c, (2000000::HUGEINT * x.f) // (y.f + z.f) AS score
  FROM cuts x JOIN found y ON y.lang = x.lang AND y.p = x.p[1:c] JOIN found z ON z.lang = x.lang AND z.p = x.p[c + 1:x.k]
), least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, c) = 1),
spans AS (SELECT lang, k, p, f, unnest(range(2, k)) AS m FROM cand),
inner_ AS (SELECT lang, f, m, p, unnest(range(1, k - m + 2)) AS i FROM spans),
around AS (SELECT lang, p[i:i + m - 1] AS p, max(f) AS longer FROM inner_ GROUP BY 1, 2),
kept AS (
  SELECT s.* FROM least s LEFT JOIN around o ON o.lang = s.lang AND o.p = s.p WHERE o.longer IS NULL OR 100 * o.longer < {INSIDE} * s.a
), ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank, array_to_string(p, ' ') AS phrase, a, l, r, score FROM kept
)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN totals USING (lang) WHERE rank <= {TOP}
"""
