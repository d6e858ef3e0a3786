"""Near-duplicate documents by ProbMinHash, banding and verification.

Shingles are five consecutive words (runs without ASCII white space, lower-cased; a text of one to four words is one
shingle), weighted by how often the text has them. Every shingle sends a Poisson process of arrivals, of a rate equal to
its weight and drawn from its hash, to REGISTERS registers; each register keeps the shingle that arrives first, and a
shingle stops once its next arrival is later than the latest register. The share of equal registers estimates the
probability Jaccard similarity of the weighted shingles. Registers are cut into BANDS bands; texts that share a band
meet. A text that has a shingle more than once is signed a second time with equal weights, which estimates the Jaccard
similarity of the plain sets, and meets others by these bands too; for all other texts the two are one.

Two texts are linked where either similarity reaches the threshold: a line that is repeated on one side only must not
hide a copy, and neither must rare words beside what is repeated on both.

Texts of equal weighted shingles have one signature, whatever stands beside them in a batch, and are one node. In each
bucket every node is paired with the least node, first only with that which it meets most often, then with the others
where they are in another class still; a bucket is met in parts, so a crowded one is several tasks' work. Pairs
are verified by the exact similarities of their shingles and counts, after their registers say that one may reach the
threshold. Shingles are told apart by 64-bit keyed hashes of their words: that two different ones of a pair of texts are
taken for one has a chance of about their number squared over 2**64. Where
that leaves a bucket with several classes, its node of most links so far meets the nodes of the others, a few times
over; what is then still apart is compared in all pairs across classes: no pair of a bucket that could join two classes
goes unseen, and pairs inside a class are never made. Classes are the connected components.

A pair of similarity s shares a band with probability 1 - (1 - s**6)**32: 0.99994 at 0.8.

Defined results: texts without words (null, empty) are classes of their own; equal texts always share a class; class
ids are the least doc_id of the class (null only if the class has no other); repeated rows are documents of one
class; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latticebits.llm import chunks, hashing, memory, shared
from latticebits.llm.components import components
from latticebits.llm.hashing import GOLDEN, mix

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 6
REGISTERS = BANDS * ROWS
#: Registers of one byte: pairs of an estimate this far below the threshold (over 5 standard errors) are not verified.
SLACK = 0.16
#: A probability Jaccard similarity is a sum of quotients: what rounding may take from it.
TOLERANCE = 1e-12
#: Rounds in which the text of most links of a bucket meets those of other classes, before all pairs across classes do.
HUB_ROUNDS = 2
#: A bucket is met in so many parts at least; in more where even all nodes in one bucket would make larger parts than this.
SALTS, PART_NODES = 16, 50_000
#: Nodes of a block of a family, on average.
BLOCK = 256
_BATCH_BYTES = 1 << 20
SIGNATURE = "h1 long, h2 long, n_shingles int, bands array<long>, registers binary"


class Shingler:
    def __init__(self, words: int = WORDS):
        self.words = words

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """doc, shingle hash and count of every different shingle, sorted by doc and hash."""
        split = pc.ascii_split_whitespace(pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), "")))
        flat = split.flatten()
        doc = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
        coded = flat.dictionary_encode()
        index = coded.indices.to_numpy()
        word, real = hashing.of_words(coded.dictionary)[index], pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False)[index] > 0
        word, doc = word[real], doc[real]
        n = np.bincount(doc, minlength=len(texts))
        first = np.cumsum(n) - n
        last = first + n
        # a shingle begins at each word that has enough words from there on, or at the first of a short text
        at = np.flatnonzero(np.arange(len(word)) + self.words <= last[doc])
        value = np.zeros(len(at), np.uint64)
        for j in range(self.words):
            value = value * GOLDEN + word[at + j]
        value, owner = mix(value), doc[at]
        short = np.flatnonzero((n > 0) & (n < self.words))
        if len(short):
            v = np.zeros(len(short), np.uint64)
            for j in range(self.words - 1):
                has = j < n[short]
                v[has] = v[has] * GOLDEN + word[first[short][has] + j]
            value, owner = np.concatenate([value, mix(v + np.uint64(1))]), np.concatenate([owner, short])
        order = np.lexsort((value, owner))
        value, owner = value[order], owner[order]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        begin = np.flatnonzero(new)
        return owner[begin], value[begin], np.diff(np.concatenate([begin, [len(value)]]))


def registers(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, docs: int, m: int = REGISTERS) -> np.ndarray:
    """The shingle that arrives first at each register of each doc; 0 where a doc has none."""
    least = np.full(docs * m, np.inf)
    won = np.zeros(docs * m, np.uint64)
    seen: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    time, active, step = np.zeros(len(doc)), np.arange(len(doc)), 0
    while len(active):
        block = max(1, min(128, 200_000 // len(active)))
        draw = np.arange(step + 1, step + block + 1, dtype=np.uint64) * GOLDEN
        z = mix(shingle[active][:, None] + draw[None, :])
        gap = -np.log(((z >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) / weight[active][:, None]
        gap[:, 0] += time[active]
        when = np.cumsum(gap, axis=1)  # one sum from the first arrival on: blocks, and so other texts, don't change it
        to = doc[active][:, None] * m + (mix(z + GOLDEN) % np.uint64(m)).astype(np.int64)
        time[active] = when[:, -1]
        when, to, who = when.ravel(), to.ravel(), np.repeat(active, block)
        useful = when < least[to]
        when, to, who = when[useful], to[useful], who[useful]
        np.minimum.at(least, to, when)
        seen.append((when, to, who))
        latest = least.reshape(docs, m).max(axis=1)
        active = active[time[active] < latest[doc[active]]]
        step += block
    for when, to, who in seen:
        first = when == least[to]
        won[to[first]] = shingle[who[first]]
    return won.reshape(docs, m)


def _batches(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    upto, lo = np.cumsum(pc.binary_length(pc.fill_null(texts.cast(pa.string()), "")).to_numpy(zero_copy_only=False)), 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + _BATCH_BYTES)))
        yield lo, texts.slice(lo, hi - lo)
        memory.after(int(upto[hi - 1] - (upto[lo - 1] if lo else 0)))
        lo = hi


def _names(doc: np.ndarray, value: np.ndarray, count: np.ndarray, docs: int) -> list[pa.Array]:
    """h1 and h2 of each text's shingles and their counts."""
    out = []
    for each in (value, mix(value + GOLDEN)):
        total = np.zeros(docs, np.uint64)
        np.add.at(total, doc, mix(each + GOLDEN * count.astype(np.uint64)))
        out.append(pa.array(total.view(np.int64)))
    return out


def sign(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep` of docs with SIGNATURE; h1 and h2 tell weighted shingles apart. Where a text repeats a shingle,
    bands and registers are those of the weighted shingles, then those of the plain set."""
    rows = shared.columns(docs, *keep, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = memory.kept("shingler", Shingler)  # what another operator kept goes
        for batch in batches:
            for lo, texts in _batches(batch.column(batch.num_columns - 1)):
                n = len(texts)
                doc, value, count = shingler(texts)
                size = np.bincount(doc, minlength=n)
                again = np.bincount(doc, weights=count, minlength=n) > size
                weighted = registers(doc, value, count.astype(float), n)
                both = again[doc]
                number = np.cumsum(again) - 1
                plain = registers(number[doc[both]], value[both], np.ones(int(both.sum())), int(again.sum()))
                # the second signature of a text stands behind its first
                at = np.arange(n) + np.cumsum(again) - again
                won = np.zeros((n + len(plain), REGISTERS), np.uint64)
                won[at], won[at[again] + 1] = weighted, plain
                key = np.repeat(np.arange(BANDS, dtype=np.uint64)[None, :], len(won), axis=0)
                for j in range(ROWS):
                    key = mix(key * GOLDEN + won.reshape(len(won), BANDS, ROWS)[:, :, j])
                small = mix(won).astype(np.uint8).tobytes()
                has = np.repeat(size > 0, 1 + again)
                bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(size > 0, BANDS * (1 + again), 0))]), pa.int32()), pa.array(key[has].ravel().view(np.int64)))
                ends = REGISTERS * (at + 1 + again)
                columns = [*_names(doc, value, count, n), pa.array(size, pa.int32()), bands, pa.array([small[a:b] for a, b in zip((REGISTERS * at).tolist(), ends.tolist())], pa.binary())]
                yield pa.RecordBatch.from_arrays([c.slice(lo, n) for c in batch.columns[:-1]] + columns, [*keep, "h1", "h2", "n_shingles", "bands", "registers"])

    return rows.mapInArrow(signed, f"{schema}, {SIGNATURE}")


def shingles(docs: DataFrame) -> DataFrame:
    """(h1, h2, shingles, counts) of every text."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = memory.kept("shingler", Shingler)  # what another operator kept goes
        for batch in batches:
            for _, texts in _batches(batch.column(0)):
                doc, value, count = shingler(texts)
                n = len(texts)
                ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(value.view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(count.astype(np.int32)))]
                yield pa.RecordBatch.from_arrays([*_names(doc, value, count, n), *lists], ["h1", "h2", "shingles", "counts"])

    return shared.columns(docs, "text").mapInArrow(made, "h1 long, h2 long, shingles array<long>, counts array<int>")


def similarities(a: np.ndarray, a_count: np.ndarray, b: np.ndarray, b_count: np.ndarray) -> tuple[float, float]:
    """The exact Jaccard similarity of two shingle sets and the exact probability Jaccard similarity of their counts.

    The latter is the sum over common shingles d of 1 / sum over all e of max(x[e]/x[d], y[e]/y[d]). A shingle e counts
    with x where its ratio x[e]/y[e] is at least that of d, else with y: sums in the order of the ratios give all."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.bincount(at[: len(a)], weights=a_count, minlength=len(ids)), np.bincount(at[len(a) :], weights=b_count, minlength=len(ids))
    common = (x > 0) & (y > 0)
    jaccard = float(common.sum()) / len(ids)
    if (x.max() == 1 and y.max() == 1) or not common.any():
        return jaccard, jaccard
    ratio = np.divide(x, y, out=np.full(len(ids), np.inf), where=y > 0)
    order = np.argsort(-ratio, kind="stable")
    last = np.searchsorted(-ratio[order], -ratio[common], side="right") - 1
    above, below = np.cumsum(x[order])[last], y.sum() - np.cumsum(y[order])[last]
    return jaccard, float((1 / (above / x[common] + below / y[common])).sum())


def linked(a: np.ndarray, a_count: np.ndarray, b: np.ndarray, b_count: np.ndarray, similarity: float) -> bool:
    plain, weighted = similarities(a, a_count, b, b_count)
    return plain >= similarity or weighted >= similarity - TOLERANCE


@F.arrow_udf(T.DoubleType())
def _estimate(a: pa.Array, b: pa.Array) -> pa.Array:
    if not len(a):
        return pa.array([], pa.float64())
    return pa.array(_equal(_halves(a.to_pylist()), _halves(b.to_pylist())))


def _halves(packed: list[bytes]) -> np.ndarray:
    """Registers of weighted and of plain shingles, the same where there is one signature."""
    return np.frombuffer(b"".join(r if len(r) > REGISTERS else r + r for r in packed), np.uint8).reshape(len(packed), 2, REGISTERS)


def _equal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The larger of the two estimates."""
    return ((x == y).mean(axis=-1).max(axis=-1) - 1 / 256) / (1 - 1 / 256)


_NO_ID = -(2**63)  # stands for a null doc_id


def classes(docs: DataFrame, signatures: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(h1, h2, comp, class_id) of all weighted shingles in signatures, a written table of sign(docs, "doc_id", ...)."""
    grouped = signatures.where("n_shingles > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("min_doc"), F.any_value("n_shingles").alias("n"), F.min(F.struct("registers", "bands")).alias("signature"))
    grouped = grouped.select("h1", "h2", "min_doc", "n", "signature.bands", "signature.registers")
    nodes = shared.written(grouped.withColumn("node", F.monotonically_increasing_id()), "near-nodes")
    salts = max(SALTS, -(-nodes.count() // PART_NODES))
    buckets = nodes.select(F.explode("bands").alias("key"), "node")
    shared_buckets = shared.written(_met(buckets, salts, u=(F.min, "node"), last=(F.max, "node")).where("u <> last").select("key", "u", "node"), "near-buckets")
    star = shared.written(shared_buckets.where("u <> node").groupBy("u", F.col("node").alias("v")).agg(F.count("*").alias("n")), "near-star")
    wanted = shared.written(shared_buckets.select("node").distinct().join(nodes.select("node", "h1", "h2", F.coalesce("min_doc", F.lit(_NO_ID)).alias("min_doc")), "node"), "near-wanted")
    sets = shared.written(_sets(docs, wanted), "near-sets")
    # first each node with the one it meets most often; then those pairs of the rest that could still join two classes
    tested = _verified(nodes, sets, star.groupBy("v").agg(F.max_by("u", F.struct("n", -F.col("u"))).alias("u")).select("u", "v"), similarity)
    comps = components(tested.where("same"))
    of = lambda x: comps.select(F.col("node").alias(x), F.col("comp").alias(f"c_{x}"))
    apart = star.join(of("u"), "u", "left").join(of("v"), "v", "left").where(F.coalesce("c_u", "u") != F.coalesce("c_v", "v")).select("u", "v")
    apart = shared.written(apart.join(tested.select("u", "v"), ["u", "v"], "left_anti"), "near-apart")
    if not apart.isEmpty():
        more = _verified(nodes, sets, apart, similarity)
        tested = tested.unionByName(more)
        if not more.where("same").isEmpty():
            comps = components(tested.where("same"))
    for turn in range(HUB_ROUNDS + 1):
        placed = shared_buckets.join(comps, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
        placed = shared.written(_met(placed, salts, low=(F.min, "comp"), high=(F.max, "comp")).where("low <> high").select("key", "node", "comp"), "near-mixed")
        if placed.isEmpty():
            break
        if turn == HUB_ROUNDS:
            links = shared.written(_across(nodes, sets, placed, salts, similarity), "near-links")
            if not links.isEmpty():
                comps = components(tested.where("same").select("u", "v").unionByName(links))
            break
        # the text of most links so far, an original among its copies, meets the rest of its bucket
        ends = tested.where("same").select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
        ranked = placed.join(ends, "node", "left").select("key", F.struct(F.coalesce("links", F.lit(0)).alias("links"), "node", "comp").alias("hub"))
        met = _met(ranked.select("*", F.col("hub.node").alias("node")), salts, best=(F.max, "hub"))
        across = met.select(F.col("best.node").alias("u"), F.col("node").alias("v"), F.col("best.comp").alias("cu"), F.col("hub.comp").alias("cv")).where("cu <> cv").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        across = shared.written(across.join(tested.select("u", "v"), ["u", "v"], "left_anti"), "near-across")
        if across.isEmpty():
            continue
        more = _verified(nodes, sets, across, similarity)
        tested = tested.unionByName(more)
        if not more.where("same").isEmpty():
            comps = components(tested.where("same"))
    whole = nodes.join(comps, "node", "left").select("h1", "h2", "min_doc", F.coalesce("comp", "node").alias("comp"))
    ids = whole.groupBy("comp").agg(F.min("min_doc").alias("class_id"))
    return whole.join(ids, "comp").select("h1", "h2", "comp", "class_id")


def _met(buckets: DataFrame, salts: int, **of_all: tuple) -> DataFrame:
    """buckets (key, node, ...) with name=(F.min or F.max, column) over all nodes of a key, for keys of several nodes.

    These are taken over parts of a key, put together, and handed back to the parts: the nodes of a crowded key are
    never in one task."""
    parts = buckets.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(salts)).cast("int"))
    each = parts.groupBy("key", "salt").agg(*[f(c).alias(n) for n, (f, c) in of_all.items()], F.count("*").alias("n"))
    whole = each.groupBy("key").agg(*[f(n).alias(n) for n, (f, _) in of_all.items()], F.collect_list("salt").alias("salts"), F.sum("n").alias("n")).where("n > 1")
    return parts.join(whole.select("key", *of_all, F.explode("salts").alias("salt")), ["key", "salt"])


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, s, c) for the nodes of wanted (node, h1, h2, min_doc): shingles and counts, made anew from their texts."""
    texts = docs.select("doc_id", "text").join(wanted.select("min_doc").distinct(), F.coalesce("doc_id", F.lit(_NO_ID)) == F.col("min_doc"), "left_semi")
    return shingles(texts).join(wanted.select("node", "h1", "h2"), ["h1", "h2"]).groupBy("node").agg(F.any_value(F.struct("shingles", "counts")).alias("of")).select("node", F.col("of.shingles").alias("s"), F.col("of.counts").alias("c"))


def _verified(nodes: DataFrame, sets: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """(u, v, same): whether the shingles of two nodes are as similar as asked, by sets or by counts. A written table."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("registers").alias(f"r_{x}"))
    likely = pairs.join(side("u"), "u").join(side("v"), "v")
    likely = shared.written(likely.select("u", "v", _estimate("r_u", "r_v").alias("estimate")).where(F.col("estimate") >= similarity - SLACK).select("u", "v"), "near-likely")
    of = lambda x: sets.select(F.col("node").alias(x), F.col("s").alias(f"s_{x}"), F.col("c").alias(f"c_{x}"))
    full = likely.join(of("u"), "u").join(of("v"), "v").select("u", "v", "s_u", "c_u", "s_v", "c_v")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [c.flatten().to_numpy() for c in batch.columns[2:]]
            ends = [np.concatenate([[0], np.cumsum(pc.list_value_length(c).to_numpy())]) for c in batch.columns[2:]]
            own = lambda k: [x[e[k] : e[k + 1]] for x, e in zip(lists, ends)]
            same = [linked(*own(k), similarity) for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(same, pa.bool_())], ["u", "v", "same"])
            memory.after(batch.nbytes)

    with chunks.small_batches(nodes.sparkSession, 64):
        return shared.written(full.mapInArrow(verify, "u long, v long, same boolean"), "near-pairs")


def _across(nodes: DataFrame, sets: DataFrame, placed: DataFrame, salts: int, similarity: float) -> DataFrame:
    """Links (u, v) between classes among all pairs that share a bucket of placed (key, node, comp).

    Nodes that buckets connect form a family; a family is cut into blocks, and every two blocks are compared inside one
    task of a bounded size, which gives only the links: pairs don't become rows, and a large family is many tasks."""
    families = components(_met(placed, salts, u=(F.min, "node")).select("u", F.col("node").alias("v")).distinct())
    sized = families.join(families.groupBy("comp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "comp").select("node", F.col("comp").alias("family"), "blocks")
    members = shared.written(sized.join(placed.select("node", "comp").distinct(), "node"), "near-members")
    rows = members.join(nodes.select("node", "bands", "registers"), "node").join(sets, "node")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rows = shared.written(rows.select("family", "blocks", block.alias("block"), "node", "comp", "bands", "registers", "s", "c"), "near-blocks")
    units = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))

    def compare(unit: pa.Table) -> pa.Table:
        block = unit.column("block").to_numpy()
        low, high = unit.column("low")[0].as_py(), unit.column("high")[0].as_py()
        node, comp = unit.column("node").to_numpy(), unit.column("comp").to_numpy()
        band = np.array([b if len(b) > BANDS else b + b for b in unit.column("bands").to_pylist()], dtype=np.int64)
        register = _halves(unit.column("registers").to_pylist())
        lists = [(np.array(s, np.int64), np.array(c)) for s, c in zip(unit.column("s").to_pylist(), unit.column("c").to_pylist())]
        one, two = np.flatnonzero(block == low), np.flatnonzero(block == high)
        u, v = [], []
        for i in one.tolist():
            rest = two[(comp[two] != comp[i]) & ((two > i) if low == high else True)]
            rest = rest[(band[rest] == band[i]).any(axis=1)]
            for j in rest[_equal(register[rest], register[i]) >= similarity - SLACK].tolist():
                if linked(*lists[i], *lists[j], similarity):
                    u.append(min(node[i], node[j]))
                    v.append(max(node[i], node[j]))
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return units.groupBy("family", "low", "high").applyInArrow(compare, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id) of every row of docs (doc_id, text)."""
    with shared.scratch(docs.sparkSession):
        signatures = shared.written(sign(docs, "doc_id"), "near-signatures")
        found = classes(docs, signatures, similarity)
        placed = signatures.select("doc_id", "h1", "h2").join(found, ["h1", "h2"], "left")
        return shared.written(placed.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id")), "near-classes", result=True)


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one document, of the least doc_id, of each class."""
    row = "_row"
    while row in docs.columns:
        row += "_"
    with shared.scratch(docs.sparkSession):
        numbered = shared.written(docs.withColumn(row, F.monotonically_increasing_id()), "near-documents")
        signatures = shared.written(sign(numbered, "doc_id", row).withColumnRenamed(row, "row"), "near-signatures")
        found = classes(numbered, signatures, similarity)
        placed = signatures.select("doc_id", "row", "h1", "h2").join(found, ["h1", "h2"], "left")
        order = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)), "row")
        best = placed.where(F.col("comp").isNotNull()).groupBy("comp").agg(F.min(order).alias("best")).select(F.col("best.row").alias(row))
        keep = best.union(placed.where(F.col("comp").isNull()).select("row"))
        return shared.written(numbered.join(keep, row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns]), "near-kept", result=True)


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(shared.documents(spark, sf_dir))


#: For small tables: SQL has no way around all windows or pairs.
ORACLE_SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT rid, g, CAST(count(*) AS DOUBLE) AS c FROM (SELECT rid, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)) GROUP BY ALL),
n AS MATERIALIZED (SELECT rid, count(*) AS n, sum(c) AS t FROM s GROUP BY rid),
l AS MATERIALIZED (SELECT a.rid AS u, b.rid AS v, count(*) AS k, sum(least(a.c / x.t, b.c / y.t)) AS most
                   FROM s a JOIN s b ON a.g = b.g AND a.rid < b.rid JOIN n x ON a.rid = x.rid JOIN n y ON b.rid = y.rid GROUP BY ALL),
j AS MATERIALIZED (SELECT u, v, k >= 0.8 * (x.n + y.n - k) AS plain, most FROM l JOIN n x ON u = x.rid JOIN n y ON v = y.rid),
-- what may be linked by counts alone, its shingles in the order of their ratios
o AS (SELECT u, v, g, sum(x) AS x, sum(y) AS y FROM (SELECT u, v, g, c AS x, 0 AS y FROM j JOIN s ON u = rid WHERE NOT plain AND most > 0.79 UNION ALL SELECT u, v, g, 0, c FROM j JOIN s ON v = rid WHERE NOT plain AND most > 0.79) GROUP BY u, v, g),
q AS (SELECT u, v, x, y, sum(x) OVER w AS above, sum(y) OVER (PARTITION BY u, v) - sum(y) OVER w AS below FROM o WINDOW w AS (PARTITION BY u, v ORDER BY CASE WHEN y > 0 THEN x / y ELSE 1e300 END DESC RANGE UNBOUNDED PRECEDING)),
h AS MATERIALIZED (SELECT u, v FROM j WHERE plain UNION ALL SELECT u, v FROM q WHERE x > 0 AND y > 0 GROUP BY u, v HAVING sum(1 / (above / x + below / y)) >= 0.8 - 1e-12),
e AS MATERIALIZED (SELECT u, v FROM h UNION ALL SELECT v, u FROM h),
r AS (SELECT rid AS u, rid AS v FROM d UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u)
SELECT a.doc_id, min(b.doc_id) AS class_id FROM r JOIN d a ON r.u = a.rid JOIN d b ON r.v = b.rid GROUP BY a.rid, a.doc_id
"""
