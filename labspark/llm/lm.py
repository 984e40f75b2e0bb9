"""Language-model scores: prediction by partial matching (PPM) over bytes, and a unigram base score.

The model is a trie of byte contexts up to order 4, trained on all training documents. A byte is
predicted by the longest context that was seen; a context in which the byte is new escapes to the next
shorter one (method C: the escape counts as often as the context has different followers), whose
prediction leaves out the bytes that the longer context already excluded. Below order 0 all bytes left
are equally likely. A text ends with the byte FF, and bytes FE stand before it; UTF-8 has neither.

How it runs: documents are cut into blocks of bounded bytes, written once. Each block posts what it asks for (five-byte
grams and words, each once per block, with training counts). Spark adds the counts up per gram and per word, combining
before the shuffle, so only distinct grams go on to groups that share the last two context bytes; such a group has at
most 256 ** 3 grams whatever the corpus, and can work out orders 4 to 2 by itself. Orders 1 and 0 have at most 65,536
entries and are broadcast. The values meet the posts again in buckets of gram hashes, and the answers go back
to the blocks, which score their documents. Nothing else is broadcast: the model grows with the corpus and
stays spread.

What the score can show: how usual a text's bytes are after four bytes of context. An order of four hardly notices that a
document occurs twice in a large corpus, because its grams are frequent anyway; for that, see near-duplicates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labspark.llm.neardup import _batches, _mix, batch_bytes, word_hashes
from labspark.llm.shared import written

ORDER = 4
START, END = 0xFE, 0xFF
#: Added to every count of the base score.
SMOOTH = 0.1
#: A block holds at most 2 ** BLOCK_BITS documents and, unless it is one document, BLOCK_BYTES of text.
BLOCK_BITS, BLOCK_BYTES = 14, 32 << 20
#: Groups of context pairs that are worked out together, and blocks that meet in one answering task.
GROUPS, BLOCKS_TOGETHER = 1024, 65_536
#: Stands for the end token among word hashes.
END_KEY = 0x454E4445
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def gram_codes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of five bytes (context and byte) of every byte and end of the texts, and their text numbers."""
    n = len(starts) - 1
    lengths = np.diff(starts)
    size = len(data) + n * (ORDER + 1)
    padded = np.full(size, START, np.uint8)
    owner = np.repeat(np.arange(n), lengths + ORDER + 1)
    text_at = np.arange(len(data)) + np.repeat(np.arange(n) * (ORDER + 1) + ORDER, lengths)
    padded[text_at] = data
    padded[np.cumsum(lengths + ORDER + 1) - 1] = END
    codes = np.zeros(max(0, size - ORDER), np.uint64)
    for i in range(ORDER + 1):
        codes = (codes << np.uint64(8)) | padded[i:size - ORDER + i]
    real = np.ones(size, bool)
    first = np.cumsum(lengths + ORDER + 1) - lengths - ORDER - 1
    for i in range(ORDER):
        real[first + i] = False
    return codes[real[ORDER:]], owner[real]


def word_keys(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words, and their text numbers."""
    keys, counts = word_hashes(_LOWER[data], starts)
    return keys, np.repeat(np.arange(len(counts)), counts)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _counted(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with how often they occur in training texts (0 for keys of other texts only)."""
    seen = np.sort(keys[train])
    first = np.flatnonzero(np.append(True, seen[1:] != seen[:-1])) if len(seen) else np.empty(0, np.int64)
    known, counts = seen[first], np.diff(np.append(first, len(seen)))
    rest = np.unique(keys[~train])
    return _summed(np.concatenate([known, rest]), np.concatenate([counts, np.zeros(len(rest), np.int64)]))


def key_bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of a word or gram key, by hash: no bucket holds more than its share of distinct keys."""
    return (_mix(keys) % np.uint64(buckets)).astype(np.int64)


def _lists(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values))


def in_blocks(docs: DataFrame) -> DataFrame:
    """block, doc_id, held_out and text: consecutive rows of a partition, cut by bytes and rows, as a written table."""
    key = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows, held = TaskContext.get().partitionId() << 33, 0, 0
        for batch in batches:
            numbers = np.empty(batch.num_rows, np.int64)
            for i, size in enumerate(pc.binary_length(batch.column(2)).to_pylist()):
                if rows == 1 << BLOCK_BITS or rows and held + size > BLOCK_BYTES:
                    block, rows, held = block + 1, 0, 0
                rows, held = rows + 1, held + size
                numbers[i] = block
            yield pa.RecordBatch.from_arrays([pa.array(numbers), *batch.columns], ["block", *batch.schema.names])

    rows = docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return written(rows.mapInArrow(work, f"block long, doc_id {key}, held_out boolean, text string"), "blocks")


def posts(blocks: DataFrame, buckets: int) -> DataFrame:
    """(bucket, block, keys, counts) of every block, and its order-1 counts as bucket -1.

    ``blocks`` has block, train, text. Buckets from 0 hold words, buckets from ``buckets`` on hold grams. A block that
    several tasks read posts once in each.
    """
    def merge(merged: dict, part: pa.RecordBatch) -> None:
        train = part.column(2).to_numpy(zero_copy_only=False)
        data, starts = batch_bytes(part.column(1))
        for kind, (keys, owner) in enumerate((word_keys(data, starts), gram_codes(data, starts))):
            found = _counted(keys, train[owner])
            if kind == 0:
                found = _summed(np.append(found[0], np.uint64(END_KEY)), np.append(found[1], train.sum()))
            old = merged.get(kind)
            merged[kind] = found if old is None else _summed(
                np.concatenate([old[0], found[0]]), np.concatenate([old[1], found[1]]))

    def letter(block: int, merged: dict) -> pa.RecordBatch:
        (word, word_n), (gram, gram_n) = merged[0], merged[1]
        pair, pair_n = _summed(gram & np.uint64(0xFFFF), gram_n)
        of = np.concatenate([key_bucket(word, buckets), key_bucket(gram, buckets) + buckets, np.full(len(pair), -1)])
        own, n = np.concatenate([word, gram, pair]), np.concatenate([word_n, gram_n, pair_n])
        order = np.lexsort((own, of))
        of, own, n = of[order], own[order], n[order]
        first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        cuts = np.append(first, len(of))
        return pa.RecordBatch.from_arrays(
            [pa.array(of[first], pa.int64()), pa.array(np.full(len(first), block)), _lists(own.view(np.int64), cuts),
             _lists(n.astype(np.int64), cuts)], ["bucket", "block", "keys", "counts"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the rows of a block follow one another in its partition
        current, merged = None, {}
        for batch in batches:
            blocks_of = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(blocks_of)) + 1).tolist(), batch.num_rows]
            for start, end in zip(cuts, cuts[1:], strict=False):
                if start == end:
                    continue
                if merged and blocks_of[start] != current:
                    yield letter(current, merged)
                    merged = {}
                current = int(blocks_of[start])
                for part in _batches(batch.slice(start, end - start)):
                    merge(merged, part)
        if merged:
            yield letter(current, merged)

    return blocks.select("block", "text", "train").mapInArrow(
        work, "bucket long, block long, keys array<long>, counts array<long>")


class Level:
    """Counts of one order: of grams (context and byte), and per context their sum and number."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        self.grams, self.counts = grams, counts  # sorted, counts above 0
        context = grams >> np.uint64(8)
        first = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(grams) else np.empty(0, np.int64)
        self.first, self.contexts = first, context[first]
        self.total = np.add.reduceat(counts, first) if len(first) else np.empty(0, np.int64)
        self.kinds = np.diff(np.append(first, len(grams)))

    def count(self, grams: np.ndarray) -> np.ndarray:
        return _looked_up(self.grams, self.counts, grams)

    def context(self, contexts: np.ndarray, values: np.ndarray) -> np.ndarray:
        return _looked_up(self.contexts, values, contexts)


def _looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


def ppm_log10(wanted: np.ndarray, grams: np.ndarray, counts: np.ndarray, pairs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """log10 probability of each wanted gram under PPM-C with exclusion.

    ``grams`` and ``counts`` (above 0) are the trained grams that share the last two context bytes
    with the wanted ones; ``pairs`` has the trained (byte, next byte) codes and counts of all texts.
    """
    levels = {ORDER: Level(grams, counts)}
    for k in range(ORDER - 1, 1, -1):
        levels[k] = Level(*_summed(grams & np.uint64(256 ** (k + 1) - 1), counts))
    levels[1] = Level(*pairs)
    levels[0] = Level(*_summed(pairs[0] & np.uint64(255), pairs[1]))
    logp = np.zeros(len(wanted))
    todo = np.arange(len(wanted))
    longer: Level | None = None
    excluded = np.zeros(len(wanted), bool)  # whether a longer context was seen
    for k in range(ORDER, -1, -1):
        level = levels[k]
        gram = wanted[todo] & np.uint64(256 ** (k + 1) - 1)
        context = gram >> np.uint64(8)
        total, kinds = level.context(context, level.total), level.context(context, level.kinds)
        seen = kinds > 0
        if longer is not None:
            # what the longer context's followers have here, taken from the sums of this context
            inside = level.count(longer.grams & np.uint64(256 ** (k + 1) - 1))
            out_total = np.add.reduceat(inside, longer.first) if len(longer.first) else inside
            long_context = wanted[todo] >> np.uint64(8) & np.uint64(256 ** (k + 1) - 1)
            gone = excluded[todo]
            total = total - np.where(gone, longer.context(long_context, out_total), 0)
            kinds = kinds - np.where(gone, longer.context(long_context, longer.kinds), 0)
        count = level.count(gram)
        whole = total + kinds
        hit = seen & (count > 0)
        logp[todo[hit]] += np.log10(count[hit] / whole[hit])
        escape = seen & ~hit & (kinds > 0)
        logp[todo[escape]] += np.log10(kinds[escape] / whole[escape])
        excluded[todo] |= seen
        todo, longer = todo[~hit], level
    left = 256 - np.where(excluded[todo], len(levels[0].grams), 0)
    logp[todo] -= np.log10(left)
    return logp


def values(sums: DataFrame, buckets: int, pairs: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(bucket, keys, values) from distinct keys with their counts: word counts or log10 probabilities of grams.

    ``sums`` has gram (or word), key and n.
    """
    shared = sums.sparkSession.sparkContext.broadcast(pairs)  # at most 65,536 entries

    def work(rows: pa.Table) -> pa.Table:
        gram = rows.column("gram")[0].as_py()
        keys = rows.column("key").to_numpy().view(np.uint64)
        order = np.argsort(keys)
        keys, counts = keys[order], rows.column("n").to_numpy()[order]
        if gram:
            trained = counts > 0
            found = ppm_log10(keys, keys[trained], counts[trained], shared.value)
        else:
            found = counts.astype(np.float64)
        of = key_bucket(keys, buckets) + (buckets if gram else 0)
        order = np.argsort(of, kind="stable")
        of, keys, found = of[order], keys[order], found[order]
        first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        cuts = np.append(first, len(of))
        return pa.table({"bucket": pa.array(of[first]), "keys": _lists(keys.view(np.int64), cuts), "values": _lists(found, cuts)})

    # grams by the last two context bytes; words anyhow
    group = F.when(F.col("gram"), F.shiftright("key", 8).bitwiseAND(0xFFFF) * 40_503).otherwise(
        F.shiftrightunsigned("key", 20)).bitwiseAND(GROUPS - 1)
    return sums.withColumn("group", group).groupBy("gram", "group").applyInArrow(
        work, "bucket long, keys array<long>, values array<double>")


def answers(posted: DataFrame, valued: DataFrame, buckets: int, salts: int) -> DataFrame:
    """(block, kind, keys, values) for each post: the value of every key that the block asked for."""
    def work(rows: pa.Table, known: pa.Table) -> pa.Table:
        gram = rows.num_rows > 0 and rows.column("bucket")[0].as_py() >= buckets
        keys_list = rows.column("keys").combine_chunks()
        keys = keys_list.flatten().to_numpy().view(np.uint64)
        own = known.column("keys").combine_chunks().flatten().to_numpy().view(np.uint64)
        order = np.argsort(own)
        found = _exactly(own[order], known.column("values").combine_chunks().flatten().to_numpy()[order], keys)
        cuts = np.append(0, np.cumsum(pc.list_value_length(keys_list).to_numpy(zero_copy_only=False)))
        return pa.table({"block": rows.column("block"), "kind": pa.array([int(gram)] * rows.num_rows, pa.int32()),
                         "keys": _lists(keys.view(np.int64), cuts), "values": _lists(found, cuts)})

    salted = posted.where("bucket >= 0").select(
        "bucket", "block", "keys", F.pmod(F.xxhash64("block"), F.lit(salts)).alias("salt"))
    copies = valued.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return salted.groupBy("bucket", "salt").cogroup(copies.groupBy("bucket", "salt")).applyInArrow(
        work, "block long, kind int, keys array<long>, values array<double>")


def _exactly(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The values of wanted keys; every one must be there."""
    if not len(wanted):
        return np.empty(0)
    at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
    if not len(keys) or (keys[at] != wanted).any():
        raise LookupError("a block asks for keys that it has not posted: its input changed between two reads")
    return values[at]


def is_held_out(doc_id: Column) -> Column:
    """crc32 of the id as text is divisible by 10; a null id counts as an empty text (held out)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 10 == 0


def score(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``docs`` has doc_id and text (null: empty; others are left out). Training covers all documents that are
    not held out; without any, every word is unknown and all bytes are equally likely. Repeated rows
    train and score each. Words are kept by 64-bit hashes. A very long text is a block of its own. No rows, no result.
    """
    rows = in_blocks(docs)
    blocks = rows.select("block").distinct().count()
    # blocks and buckets grow alike with the input, so both stay small enough for a task
    buckets, salts = max(64, blocks), -(-max(1, blocks) // BLOCKS_TOGETHER)
    posted = written(posts(rows.select("block", (~F.col("held_out")).alias("train"), "text"), buckets), "posts")
    entries = posted.select("bucket", F.explode(F.arrays_zip("keys", "counts")).alias("p"))
    pair_rows = entries.where("bucket = -1").groupBy(F.col("p.keys").alias("k")).agg(
        F.sum("p.counts").alias("n")).where("n > 0").orderBy("k").collect()  # 65,536 at most
    pairs = np.array([r["k"] for r in pair_rows], np.uint64), np.array([r["n"] for r in pair_rows], np.int64)
    sums = written(entries.where("bucket >= 0").groupBy(
        (F.col("bucket") >= buckets).alias("gram"), F.col("p.keys").alias("key")).agg(F.sum("p.counts").alias("n")), "sums")
    words_ = sums.where("not gram").agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("v")).first()
    tokens, words = words_["n"] or 0, words_["v"] or 0
    valued = written(values(sums, buckets, pairs), "values")
    answered = answers(posted, valued, buckets, salts)
    key = docs.schema["doc_id"].dataType.simpleString()

    def work(texts: pa.Table, found: pa.Table) -> pa.Table:
        known = {}
        for kind in (0, 1):
            own = found.filter(pc.equal(found.column("kind"), kind))
            keys = own.column("keys").combine_chunks().flatten().to_numpy().view(np.uint64)
            found_values = own.column("values").combine_chunks().flatten().to_numpy()
            order = np.argsort(keys)
            known[kind] = keys[order], found_values[order]
        out = []
        for batch in texts.select(["doc_id", "text", "held_out"]).combine_chunks().to_batches():
            for part in _batches(batch):
                n = part.num_rows
                data, starts = batch_bytes(part.column(1))
                word, owner = word_keys(data, starts)
                word, owner = np.append(word, np.full(n, END_KEY, np.uint64)), np.append(owner, np.arange(n))
                count = _exactly(*known[0], word)
                base = np.bincount(owner, np.log10((count + SMOOTH) / (tokens + SMOOTH * (words + 1))), n)
                # code and text number in one sortable value: each distinct code is looked up once
                codes, text_no = gram_codes(data, starts)
                packed = np.sort((codes << np.uint64(BLOCK_BITS)) | text_no.astype(np.uint64))
                codes = packed >> np.uint64(BLOCK_BITS)
                first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
                value = _exactly(*known[1], codes[first])
                each = np.repeat(value, np.diff(np.append(first, len(codes))))
                total = np.bincount((packed & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64), each, n)
                out.append(pa.RecordBatch.from_arrays([
                    part.column(0), part.column(2), pa.array(np.bincount(owner, minlength=n)),
                    pa.array(np.bincount(owner, count > 0, n).astype(np.int64)), pa.array(np.full(n, tokens, np.int64)),
                    pa.array(base), pa.array(total)], names))
        return pa.Table.from_batches(out)

    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    schema = (f"doc_id {key}, held_out boolean, n_tokens long, n_known long, train_tokens long,"
              " base_score double, score double")
    scored = rows.select("block", "doc_id", "held_out", "text").groupBy("block").cogroup(
        answered.select("block", "kind", "keys", "values").groupBy("block"))
    return scored.applyInArrow(work, schema)
