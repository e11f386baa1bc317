"""Operator 1: language identification by interpolated Kneser-Ney character models.

One 4-gram model a language, from all labelled texts and all their n-grams. An n-gram of up to four characters of 16
bits is one 64-bit key; keys are mixed by a bijection and kept in sorted arrays, with a directory on the top bits, one array
an order for all languages together. Beside each key stand its interpolated log probabilities in every language, so
a text is scored in all languages by one look-up a character; only unseen n-grams go on to shorter ones.

A model that is larger than ``SHARD_NGRAMS`` n-grams is cut by the characters before the last: an n-gram, its suffixes
and their contexts are in one shard, single characters in all. Texts are scored shard by shard and the sums added, so no
worker and no broadcast holds more than a shard, and results don't depend on it.

The language of least cross-entropy per character wins. It is rejected where its cross-entropy lies too far above what
that language's texts show (by median and deviation over the table, and the noise of short texts), or
where the runner-up is as good.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from skeinlake.llm import arrays as A
from skeinlake.llm import jobs

ORDER = 4
BOS = 2
#: N-grams of all languages in one shard: about 73 MB in a worker, 300 MB on the driver while it is made.
SHARD_NGRAMS = 1_000_000
GRAM = np.dtype([("lang", "<i4"), ("key", "<u8"), ("count", "<i8")])
_FLUSH = 6_000_000


def normalised(column: pa.Array) -> pa.Array:
    """Lower case, runs of white space as one space, none at the ends."""
    return pc.utf8_trim_whitespace(pc.replace_substring_regex(pc.utf8_lower(A.as_strings(column)), r"\s+", " "))


def characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Characters of all texts in 16 bits, each text with ``ORDER - 1`` start marks before it, and the first place of each. Those
    above U+FFFF, 128 to a symbol, take the range of surrogates, which no text has."""
    n = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    mark = chr(BOS) * (ORDER - 1)
    code = np.frombuffer((mark + mark.join(texts.to_pylist())).encode("utf-32-le", "surrogatepass"), np.uint32) if len(n) else np.zeros(0, np.uint32)
    code = np.where(code > 0xFFFF, 0xD800 | code >> 7 & 0x7FF, code).astype(np.uint64)
    first = np.concatenate([[0], np.cumsum(n + ORDER - 1)])
    return code, first


def keys_of(code: np.ndarray) -> np.ndarray:
    """The 4-gram that ends at each character, 16 bits a character; the first three places are cut short."""
    key = code.copy()
    for k in range(1, ORDER):
        key[k:] |= code[:-k] << A.U64(16 * k)
    return key


def real_places(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of true characters, and how many each text has."""
    n = np.diff(first) - (ORDER - 1)
    return A.ragged(first[:-1] + ORDER - 1, n), n


def count_ngrams(docs: DataFrame, text_col: str, lang_col: str, langs: list[str], parts: int) -> DataFrame:
    """(lang, key, count) of every 4-gram of the labelled texts."""
    index = F.array_position(F.array(*(F.lit(x) for x in langs)), F.col(lang_col).cast("string")).cast("int") - 1
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(index.alias("lang"), F.col(text_col).cast("string").alias("text"))

    def summed(rec: np.ndarray) -> np.ndarray:
        rec = rec[np.lexsort((rec["key"], rec["lang"]))]
        new = np.concatenate([[True], (rec["key"][1:] != rec["key"][:-1]) | (rec["lang"][1:] != rec["lang"][:-1])])
        at = np.flatnonzero(new)
        out = rec[at].copy()
        out["count"] = np.add.reduceat(rec["count"], at)
        return out

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        rec = summed(np.concatenate(held))
        part = (A.mix(rec["key"].copy()) % A.U64(parts)).astype(np.int64)
        return jobs.to_batch(list(jobs.routed(part, rec, 0, parts)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0
        for batch in batches:
            lang = batch.column(0).to_numpy(zero_copy_only=False)
            for at, part in A.slices(batch.column(1)):
                part = normalised(part)
                code, first = characters(part)
                key = keys_of(code)
                place, size = real_places(first)
                of = np.repeat(lang[at : at + len(part)], size)
                key = key[place]
                for x in np.flatnonzero(np.bincount(of, minlength=1)):
                    s = np.sort(key[of == x])
                    begin, count = A.runs_of(s)
                    rec = np.empty(len(begin), GRAM)
                    rec["lang"], rec["key"], rec["count"] = x, s[begin], count
                    held.append(rec)
                    n += len(rec)
                if n > 1_000_000:
                    held = [summed(np.concatenate(held))]
                    n = len(held[0])
                if n > _FLUSH:
                    yield flush(held)
                    held, n = [], 0
        if held:
            yield flush(held)

    def receive(got: jobs.Payloads) -> Iterator[pa.RecordBatch]:
        rec = jobs.records_of(got.get(0, []), GRAM)
        if len(rec):
            rec = summed(rec)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rec["lang"]), pa.array(rec["key"].copy().view(np.int64)), pa.array(rec["count"])], names=["lang", "key", "count"]
            )

    return jobs.exchange(rows, send, parts, receive, "lang int, key bigint, count bigint")


class HashArray:
    """Sorted mixed keys with a directory on their top bits."""

    def __init__(self, keys: np.ndarray):
        h = A.mix(keys.copy())
        self.order = np.argsort(h)
        self.hash = h[self.order]
        self.bits = max(1, min(20, int(len(keys)).bit_length() + 1))
        top = self.hash >> A.U64(64 - self.bits)
        self.start = np.searchsorted(top, np.arange(2**self.bits + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where it is not there."""
        h = A.mix(keys.copy())
        top = (h >> A.U64(64 - self.bits)).astype(np.int64)
        at, end = self.start[top], self.start[top + 1]
        out = np.full(len(h), -1, np.int32)
        if not len(self.hash):
            return out
        hit = self.hash[np.minimum(at, len(self.hash) - 1)] == h
        hit &= at < end
        out[hit] = at[hit]
        live = np.flatnonzero(~hit & (at + 1 < end))
        at = at[live] + 1
        while len(live):
            same = self.hash[at] == h[live]
            out[live[same]] = at[same]
            go = ~same & (at + 1 < end[live])
            live, at = live[go], at[go] + 1
        return out


class KneserNey:
    """Interpolated Kneser-Ney models of several languages over shared hash arrays.

    ``logp[n][row]`` holds ln p of an n-gram's last character after the others, by language;
    ``back[n][row]`` holds the ln weight of the shorter context after context ``row``.
    """

    def __init__(self, tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], discounts: dict[tuple[int, int], float], letters: int, languages: int, part: int = 0, cuts: int = 1):
        self.languages, self.part, self.cuts = languages, part, cuts
        self.logp: dict[int, tuple[HashArray, np.ndarray]] = {}
        self.back: dict[int, tuple[HashArray, np.ndarray]] = {}
        finder: HashArray | None = None
        self.floor = float(np.log(1.0 / (letters + 1)))
        for n in range(1, ORDER + 1):
            g, k, c = tables[n]
            own = np.unique(k)
            here = HashArray(own)
            keys = own[here.order]
            ctx = np.unique(own >> A.U64(16)) if n > 1 else np.zeros(1, np.uint64)
            contexts = HashArray(ctx)
            of = contexts.find(keys >> A.U64(16) if n > 1 else np.zeros(len(keys), np.uint64))
            below = None if finder is None else finder.find(keys & A.U64((1 << 16 * (n - 1)) - 1))
            logp, back = np.empty((len(own), languages), np.float32), np.empty((len(ctx), languages), np.float32)
            for x in range(languages):  # one language at a time, as the table may be large
                kx, cx = k[g == x], c[g == x]
                crow = contexts.find(kx >> A.U64(16) if n > 1 else np.zeros(len(kx), np.uint64))
                counts = np.zeros(len(own))
                counts[here.find(kx)] = cx
                total, kinds = np.bincount(crow, cx, len(ctx)), np.bincount(crow, minlength=len(ctx))
                discount = discounts.get((n, x), 0.5)
                known = total > 0
                weight = np.where(known, discount * kinds / np.maximum(total, 1), 1.0)
                short = 1.0 / (letters + 1) if below is None else np.exp(self.logp[n - 1][1][below, x])
                p = np.where(known[of], np.maximum(counts - discount, 0) / np.maximum(total[of], 1), 0.0) + weight[of] * short
                logp[:, x], back[:, x] = np.log(p), np.log(weight)
            self.logp[n] = (here, logp)
            self.back[n] = (contexts, back)
            finder = here

    def mine(self, key: np.ndarray) -> np.ndarray:
        """Which 4-grams are scored by this shard."""
        return shard_of(key, self.cuts) == self.part

    def score(self, key: np.ndarray) -> np.ndarray:
        """ln p of the last character of each 4-gram, by language."""
        rows, values = self.logp[ORDER]
        at = rows.find(key)
        out = values[np.maximum(at, 0)] if len(values) else np.zeros((len(key), self.languages), np.float32)
        left = np.flatnonzero(at < 0)
        if len(left):
            add = np.zeros((len(left), self.languages), np.float32)
            k = key[left]
            for n in range(ORDER, 0, -1):
                rows, values = self.logp[n]
                at = rows.find(k)
                seen = at >= 0
                out[left[seen]] = values[at[seen]] + add[seen]
                left, k, add = left[~seen], k[~seen], add[~seen]
                if not len(left):
                    break
                contexts, weight = self.back[n]
                c = contexts.find(k >> A.U64(16) if n > 1 else np.zeros(len(k), np.uint64))
                add = add + np.where((c >= 0)[:, None], weight[np.maximum(c, 0)], 0)
                k = k & A.U64((1 << 16 * (n - 1)) - 1) if n > 1 else k
            if len(left):
                out[left] = add + self.floor
        return out


def shard_of(key: np.ndarray, cuts: int) -> np.ndarray:
    """Shard of n-grams of three characters or more: by the last context character, and by the two last."""
    one = A.mix(key >> A.U64(16) & A.U64(0xFFFF))
    two = A.mix(key >> A.U64(16) & A.U64(0xFFFFFFFF))
    return (one % A.U64(cuts) * A.U64(cuts) + two % A.U64(cuts)).astype(np.int64)


def _with_shard(grams: DataFrame, cuts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column(1).to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shard_of(key, cuts).astype(np.int32))], names=["lang", "key", "count", "shard"])

    return grams.mapInArrow(run, "lang int, key bigint, count bigint, shard int")


def _shorter(grams: DataFrame, bits: int) -> DataFrame:
    """Continuation counts: distinct n-grams that end in each shorter one."""
    return grams.groupBy("lang", F.col("key").bitwiseAND(F.lit((1 << bits) - 1)).alias("key")).agg(F.count("*").alias("count"))


def models(docs: DataFrame, text_col: str, lang_col: str, tmp: jobs.Scratch) -> tuple[list[str], int, Iterator[KneserNey]]:
    """Languages in order, the number of shards, and the models of one shard after another."""
    langs = [r[0] for r in docs.select(F.col(lang_col).cast("string")).where(F.col(lang_col).isNotNull()).distinct().orderBy(lang_col).collect()]
    four = tmp.save(count_ngrams(docs, text_col, lang_col, langs, jobs.parts_for(docs)))
    three = tmp.save(_shorter(four, 48))
    two = tmp.save(_shorter(three, 32))
    one = tmp.save(_shorter(two, 16))
    discounts: dict[tuple[int, int], float] = {}
    for n, t in ((4, four), (3, three), (2, two), (1, one)):
        for r in t.groupBy("lang").agg(F.count_if(F.col("count") == 1).alias("a"), F.count_if(F.col("count") == 2).alias("b")).collect():
            discounts[n, r.lang] = r.a / (r.a + 2 * r.b) if r.a and r.b else 0.5
    letters = max(1, one.select("key").distinct().count())
    cuts = 1
    while True:
        cut = four if cuts == 1 else _with_shard(four, cuts)
        largest = four.count() if cuts == 1 else cut.groupBy("shard").count().agg(F.max("count")).first()[0]
        if largest <= SHARD_NGRAMS or cuts >= 256:
            break
        cuts *= 2
    by_shard = [_with_shard(t, cuts).repartition("shard").sortWithinPartitions("shard") for t in (four, three)] if cuts > 1 else []
    by_shard = [tmp.save(t) for t in by_shard]

    def arrays(t: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        got = t.select("lang", "key", "count").toArrow()
        lang, key, count = (got.column(i).to_numpy() for i in range(3))
        return lang.astype(np.int64), key.astype(np.int64).view(np.uint64), count.astype(np.float64)

    def made() -> Iterator[KneserNey]:
        single = arrays(one)
        for part in range(cuts * cuts):
            if cuts == 1:
                tables = {4: arrays(four), 3: arrays(three), 2: arrays(two)}
            else:
                first = F.lit(part // cuts)
                mine = _with_shard(two, cuts).where(F.floor(F.col("shard") / cuts) == first)
                tables = {4: arrays(by_shard[0].where(F.col("shard") == part)), 3: arrays(by_shard[1].where(F.col("shard") == part)), 2: arrays(mine)}
            yield KneserNey({1: single, **tables}, discounts, letters, len(langs), part, cuts)

    return langs, cuts * cuts, made()


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], KneserNey]:
    """Languages in order, and their models where these are one shard."""
    with jobs.Scratch(docs.sparkSession) as tmp:
        langs, shards, made = models(docs, text_col, lang_col, tmp)
        if shards > 1:
            raise ValueError("the model has several shards")
        return langs, next(made)


SCORES = "doc_id bigint, n bigint, best int, entropy double, margin double"


def _decided(doc: pa.Array, n: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    """Best language of each text with its cross-entropy per character and the runner-up's excess, in nats."""
    entropy = -sums / np.maximum(n, 1)[:, None]
    order = np.argsort(entropy, axis=1, kind="stable")
    i = np.arange(len(n))
    low = entropy[i, order[:, 0]]
    gap = entropy[i, order[:, 1]] - low if entropy.shape[1] > 1 else np.full(len(n), np.inf)
    columns = [doc, pa.array(n), pa.array(order[:, 0].astype(np.int32)), pa.array(low), pa.array(gap)]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "best", "entropy", "margin"])


def _sums(model: KneserNey, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Characters of each text, and the log probabilities, by language, of those that this shard scores."""
    code, first = characters(normalised(texts))
    place, n = real_places(first)
    key = keys_of(code)[place]
    if model.cuts > 1:
        mine = np.flatnonzero(model.mine(key))
        logp = np.zeros((len(key), model.languages))
        logp[mine] = model.score(key[mine])
    else:
        logp = model.score(key).astype(np.float64)
    total = np.concatenate([np.zeros((1, logp.shape[1])), np.cumsum(logp, axis=0)])
    ends = np.cumsum(n)
    return n, total[ends] - total[ends - n]


def scored(docs: DataFrame, shards: Iterator[KneserNey], several: bool, id_col: str, text_col: str, tmp: jobs.Scratch) -> DataFrame:
    """(doc_id, n, best, entropy, margin) of each text."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if several:  # rows need a number by which their sums meet again
        rows = tmp.save(rows.withColumn("row", F.monotonically_increasing_id()))
    parts, languages = [], 0
    for model in shards:
        shared = docs.sparkSession.sparkContext.broadcast(model)
        languages = model.languages

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at, part in A.slices(batch.column(1), A.SLICE_BYTES // 2):
                    n, sums = _sums(shared.value, part)
                    doc = batch.column(0).slice(at, len(part))
                    if not several:
                        yield _decided(doc, n, sums)
                        continue
                    columns = [doc, batch.column(2).slice(at, len(part)), pa.array(n), *(pa.array(sums[:, x]) for x in range(sums.shape[1]))]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "n", *(f"s{x}" for x in range(sums.shape[1]))])

        schema = ", ".join(["doc_id bigint, row bigint, n bigint", *(f"s{x} double" for x in range(languages))]) if several else SCORES
        parts.append(tmp.save(rows.mapInArrow(run, schema)))
        shared.destroy()
    if not several:
        return parts[0]
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    names = [f"s{x}" for x in range(languages)]
    added = every.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n").alias("n"), *(F.sum(c).alias(c) for c in names))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield _decided(b.column(0), b.column(1).to_numpy(), np.stack([b.column(2 + x).to_numpy() for x in range(languages)], axis=1))

    return tmp.save(added.select("doc_id", "n", *names).mapInArrow(decide, SCORES))


def identify_language(
    docs: DataFrame,
    reject: float = 8.0,
    noise: float = 2.0,
    least_margin: float = 2.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """(doc_id, language, best_language, cross_entropy, margin) of every row.

    ``language`` is ``best_language``, or ``und`` where the text is rejected: its cross-entropy is more than
    ``reject`` deviations above the median of its language (deviation: the robust one of the table, and ``noise``
    nats over the root of its length), or the runner-up costs less than ``least_margin`` nats more on the whole text.
    Models come from all rows with a language and a text; a null language is scored but not learned from. Null and
    blank texts are ``und`` with null figures. Ties go to the language first in order. Rows are scored one by one,
    repeated or not, null ids too. Without any labelled row all is ``und``. Other columns don't matter.
    """
    empty = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.lit("und").alias("language"), F.lit(None).cast("string").alias("best_language"),
        F.lit(None).cast("double").alias("cross_entropy"), F.lit(None).cast("double").alias("margin"),
    )
    with jobs.Scratch(docs.sparkSession) as tmp:
        langs, shards, made = models(docs, text_col, lang_col, tmp)
        first = next(made) if langs else None
        if first is None or shards == 1 and not len(first.logp[ORDER][1]):
            return empty
        rows = scored(docs, itertools.chain([first], made), shards > 1, id_col, text_col, tmp)
        middle = tmp.save(rows.where("n > 0").groupBy("best").agg(F.percentile_approx("entropy", 0.5).alias("middle")))
        away = F.percentile_approx(F.abs(F.col("entropy") - F.col("middle")), 0.5)
        level = tmp.save(jobs.join_small(rows.where("n > 0"), middle, "best", "inner").groupBy("best").agg(F.first("middle").alias("middle"), (away * 1.4826).alias("spread")))
        names = F.array(*(F.lit(x) for x in langs))
        deviation = F.sqrt(F.col("spread") * F.col("spread") + F.lit(noise * noise) / F.greatest(F.col("n"), F.lit(1)))
        far = F.col("entropy") > F.col("middle") + F.lit(reject) * deviation
        near = F.col("margin") * F.col("n") < F.lit(least_margin)
        text = F.col("n") > 0
        result = jobs.join_small(rows, level, "best", "left").select(
            "doc_id",
            F.when(text & ~far & ~near, names[F.col("best")]).otherwise("und").alias("language"),
            F.when(text, names[F.col("best")]).alias("best_language"),
            F.when(text, F.col("entropy")).alias("cross_entropy"),
            F.when(text & (F.col("margin") < F.lit(float("inf"))), F.col("margin")).alias("margin"),
        )
        return tmp.keep(result)
