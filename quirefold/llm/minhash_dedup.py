"""MinHash near-deduplication by a multi-index Hamming join of b-bit signatures.

1. Each text becomes its set of word shingles, as 64-bit hashes, and a signature of CHUNKS * WIDTH
   minima of 16 bits. Equal sets form one class; only class representatives go on.
2. Pigeonhole: two signatures that differ in at most CHUNKS * (ERRORS + 1) - 1 places differ in at most
   ERRORS places in some chunk. Enumerating the ERRORS (one) places that may differ gives WIDTH keys a
   chunk, each the exact 64 bits of the other four values: such pairs are guaranteed to share a key. At a
   similarity of 0.8 a chunk agrees that far with probability 0.74, so a pair with no shared
   key has probability 0.26 ** 10 < 2e-6; above 0.8 it falls off quickly.
3. Pairs are not expanded inside a bucket. In each of up to ROUNDS star rounds, every bucket that still spans
   components names a pivot, a member of the component that holds most of the bucket; each class of another
   component meets one pivot, that with which it shares most keys (one verification a class and round). Links
   that hold merge components, and buckets inside one component leave. The rounds end when they bring few
   links; what they take is in proportion to the classes left.
   What is left then are pairs that share a bucket but lie in different components: in each such bucket
   the largest component is the hub, and the classes of the others attach to it. A hub's attached classes are
   compared with its members and with each other, in blocks of bounded size, each a task's unit of work
   that counts common shingles by matrix products and emits one link per class and component at most. That
   covers every pair of every bucket but those inside one component, which can't change the components. Its
   rows are copied once a block (of LEFT and RIGHT classes), its arithmetic is quadratic in what no round linked.
4. Links are confirmed on the full shingle sets, recomputed from the packed texts of the classes concerned.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import checkpointed, hand_back, hint_if_few, release, small_or_not
from quirefold.llm.components import connected
from quirefold.llm.words import WordHashes, mix, windows

CHUNKS, WIDTH, ERRORS = 10, 5, 1
#: Similarity in hundredths, and words in a shingle, unless a caller says otherwise.
PERCENT, SHINGLE = 80, 5
#: Star rounds at most; they end sooner once fewer than this share of a round's verifications hold.
ROUNDS, WORTHWHILE = 6, 0.04
#: Classes on either side of a block of comparisons, shingles on either side, and shingles in a dense piece of it.
LEFT, RIGHT, BLOCK_SHINGLES, TERMS = 1024, 2048, 1_000_000, 2048
SIGNED = "doc_id long, text_key long, n_shingles long, set_id binary, keys array<long>"


class Shingler:
    """Shingle sets of whole texts as sorted unique 64-bit hashes."""

    def __init__(self, k: int):
        self.k, self.hashes = k, WordHashes()

    def __call__(self, text: str | bytes) -> np.ndarray:
        raw = text.encode() if isinstance(text, str) else text
        words = raw.lower().split()  # bytes.lower() changes A-Z only
        if not words:
            return np.empty(0, dtype=np.uint64)
        if len(words) < self.k:  # the whole sequence as one shingle
            return np.array([xxhash.xxh3_64_intdigest(b"\x20".join(words), seed=1)], dtype=np.uint64)
        return np.unique(windows(self.hashes(words), self.k))


def _seeds() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    n = CHUNKS * WIDTH
    return rng.integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The 16-bit minima of a non-empty set under CHUNKS * WIDTH multiply-shift orders."""
    multiply, add = _seeds_cached()
    low = np.empty(len(multiply), dtype=np.uint64)
    for i in range(len(multiply)):
        low[i] = (shingles * multiply[i] + add[i]).min()
    return mix(low) >> np.uint64(48)


_SEEDS: list = []


def _seeds_cached():
    if not _SEEDS:
        _SEEDS.extend(_seeds())
    return _SEEDS


def _sketch(it, k: int):
    shingler = Shingler(k)
    drop = [[c for c in range(WIDTH) if c != gone] for gone in range(WIDTH)]
    shifts = np.array([48, 32, 16, 0], dtype=np.uint64)
    slots = np.arange(CHUNKS * WIDTH, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for batch in it:
        rows = []
        for doc_id, text_key, text in zip(batch["doc_id"], batch["text_key"], batch["text"], strict=True):
            s = shingler(text)
            keys = None
            if len(s):
                sig = signature(s).reshape(CHUNKS, WIDTH)
                packed = np.stack([(sig[:, d] << shifts).sum(axis=1, dtype=np.uint64) for d in drop], axis=1).ravel()
                keys = mix(packed ^ slots).view(np.int64)  # one to one within a slot
            rows.append((doc_id, text_key, len(s), xxhash.xxh3_128_digest(s.tobytes()), keys))
        yield pd.DataFrame(rows, columns=["doc_id", "text_key", "n_shingles", "set_id", "keys"]).astype({"doc_id": "Int64"})
    del shingler
    hand_back()


def _pack(it):
    press = zstandard.ZstdCompressor(level=1)
    for batch in it:
        yield pd.DataFrame({"cls": batch["cls"], "packed": [press.compress(t.encode()) for t in batch["text"]]})


def _verify(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Of (a, b, root_a, root_b) those whose full sets are similar enough."""

    def check(it):
        shingler, unpack = Shingler(k), zstandard.ZstdDecompressor()
        last, left = None, None
        for batch in it:
            hold = np.zeros(len(batch), dtype=bool)
            for i, (a, x, y) in enumerate(zip(batch["a"], batch["x"], batch["y"], strict=True)):
                if a != last:  # rows come sorted by a
                    last, left = a, shingler(unpack.decompress(x))
                right = shingler(unpack.decompress(y))
                common = len(np.intersect1d(left, right, assume_unique=True))
                hold[i] = 100 * common >= percent * (len(left) + len(right) - common)
            yield batch.loc[hold, ["a", "b", "root_a", "root_b"]]

    second = pairs.join(texts.select(F.col("cls").alias("b"), F.col("packed").alias("y")), "b")
    first = second.join(texts.select(F.col("cls").alias("a"), F.col("packed").alias("x")), "a")
    ordered = first.sortWithinPartitions("a").select("a", "b", "root_a", "root_b", "x", "y")
    return ordered.mapInPandas(check, "a long, b long, root_a long, root_b long")


def _fits(percent: int):
    """Set sizes na and nb that allow the similarity."""
    return F.greatest("na", "nb") * percent <= F.least("na", "nb") * 100


def _star(labelled: DataFrame, turn: int, percent: int, hint) -> DataFrame:
    """(a, b, root_a, root_b): a pivot for each class that shares a bucket with a larger component."""
    order = F.xxhash64("cls", F.lit(turn))
    heads = labelled.groupBy("key", "root").agg(F.count("*").alias("n"), F.min(F.struct(order.alias("o"), "cls", "size")).alias("p"))
    pivots = heads.groupBy("key").agg(F.max(F.struct("n", (-F.col("root")).alias("low"), "p")).alias("h")).select(
        "key", F.col("h.p.cls").alias("a"), F.col("h.p.size").alias("na"), (-F.col("h.low")).alias("root_a")
    )
    offers = labelled.withColumnRenamed("size", "nb").join(hint(pivots), "key").where((F.col("root") != F.col("root_a")) & _fits(percent))
    votes = offers.groupBy("cls", "root", "a", "root_a").agg(F.count("*").alias("n"))
    best = votes.groupBy(F.col("cls").alias("b")).agg(
        F.max(F.struct("n", (-F.col("a")).alias("m"), "root_a", F.col("root").alias("root_b"))).alias("v")
    )
    return best.select((-F.col("v.m")).alias("a"), "b", "v.root_a", "v.root_b")


def _open(labelled: DataFrame, hint) -> DataFrame:
    """Rows of buckets that span components."""
    spread = labelled.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("key")
    return labelled.join(hint(spread), "key")


def _counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each left with each right set."""
    if len(left) * len(right) <= 16:
        return np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in right] for x in left])
    a, b = np.concatenate(left), np.concatenate(right)
    terms = np.intersect1d(a, b)
    row_a = np.repeat(np.arange(len(left)), [len(x) for x in left])
    row_b = np.repeat(np.arange(len(right)), [len(x) for x in right])
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    spots = []
    for values, rows in ((a, row_a), (b, row_b)):
        at = np.searchsorted(terms, values)
        at[at == len(terms)] = 0
        hit = terms[at] == values if len(terms) else np.zeros(len(values), dtype=bool)
        at, rows = at[hit], rows[hit]
        order = np.argsort(at, kind="stable")
        spots.append((at[order], rows[order]))
    for begin in range(0, len(terms), TERMS):  # bounded dense pieces
        dense = []
        for (at, rows), n in zip(spots, out.shape, strict=True):
            lo, hi = np.searchsorted(at, (begin, begin + TERMS))
            m = np.zeros((n, min(TERMS, len(terms) - begin)), dtype=np.float32)
            m[rows[lo:hi], at[lo:hi] - begin] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    return np.rint(out)


def _attached(labelled: DataFrame, texts: DataFrame, k: int, percent: int, hint) -> DataFrame:
    """Links (a, b) between different components that share a bucket; labelled: key, cls, size, root."""
    classes = checkpointed(labelled.select("cls", "size", "root").distinct())
    parts = labelled.select("key", "root").distinct().join(
        hint(classes.groupBy("root").agg(F.count("*").alias("members"), F.sum("size").alias("shingles"))), "root"
    )
    hubs = (
        parts.groupBy("key")
        .agg(F.max(F.struct("members", (-F.col("root")).alias("low"), "shingles")).alias("h"))
        .select("key", (-F.col("h.low")).alias("hub"), F.col("h.members").alias("members"), F.col("h.shingles").alias("shingles"))
    )
    attached = checkpointed(
        labelled.join(hint(hubs), "key").where("root != hub").select("hub", "members", "shingles", "cls", "size", "root").distinct()
    )
    cut = lambda n, most, total: F.ceil(F.greatest(n / most, total / BLOCK_SHINGLES)).cast("int")
    own = attached.groupBy("hub", "members", "shingles").agg(F.count("*").alias("n"), F.sum("size").alias("own"))
    shape = checkpointed(own.select(
        "hub",
        cut(F.col("n"), LEFT, F.col("own")).alias("rows"),
        cut(F.col("n") + F.col("members"), RIGHT, F.col("own") + F.col("shingles")).alias("columns"),
    ))
    members = classes.join(hint(shape.select(F.col("hub").alias("root"))), "root")
    right = attached.select("hub", "cls", "root").unionByName(members.select(F.col("root").alias("hub"), "cls", "root"))
    own = lambda n: F.pmod(F.xxhash64("cls"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    units = (
        attached.join(hint(shape), "hub")
        .select("hub", own("rows").alias("i"), every("columns").alias("j"), F.lit(0).alias("side"), "cls", "root")
        .unionByName(
            right.join(hint(shape), "hub").select(
                "hub", every("rows").alias("i"), own("columns").alias("j"), F.lit(1).alias("side"), "cls", "root"
            )
        )
    )
    filled = units.join(texts, "cls").repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j", "side")

    def compare(it):
        shingler, unpack = Shingler(k), zstandard.ZstdDecompressor()
        unit, sides = None, ([], [])

        def links():
            left, right = sides
            if not left or not right:
                return []
            common = _counts([x[2] for x in left], [y[2] for y in right])
            na, nb = (np.array([len(x[2]) for x in side]) for side in sides)
            good = 100 * common >= percent * (na[:, None] + nb[None, :] - common)
            ra, rb = (np.array([x[1] for x in side]) for side in sides)
            good &= ra[:, None] != rb[None, :]
            found = {}
            for x, y in zip(*np.nonzero(good), strict=True):
                found.setdefault((left[x][0], right[y][1]), right[y][0])
            return [(a, b) for (a, _), b in found.items()]

        for batch in it:
            found = []
            for hub, i, j, side, cls, root, packed in batch.itertuples(index=False):
                if (hub, i, j) != unit:
                    found += links()
                    unit, sides = (hub, i, j), ([], [])
                sides[side].append((cls, root, shingler(unpack.decompress(packed))))
            yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")
        yield pd.DataFrame(links(), columns=["a", "b"], dtype="int64")
        del shingler, sides, unit
        hand_back()

    picked = filled.select("hub", "i", "j", "side", "cls", "root", "packed")
    return picked.mapInPandas(compare, "a long, b long")


def _parents(links: DataFrame) -> DataFrame:
    """(node, root) of links (a, b) whose b occur once, a < b: three doublings of the pointers b -> a."""
    up = links.select(F.col("b").alias("node"), F.col("a").alias("root"))
    for _ in range(3):
        onward = up.select(F.col("node").alias("root"), F.col("root").alias("top"))
        up = up.join(onward, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return up


def _merged(links: DataFrame, hint) -> DataFrame:
    """(root, top) of links (root_a, root_b): each root's neighbour with most links, or itself, two steps up.

    Steps lead to more links or a smaller root, so they never circle. Not all of a component needs to meet
    at one top: labels order the comparisons only, components are settled over all links at the end.
    """
    ends = links.where("root_a != root_b").select(F.col("root_a").alias("u"), F.col("root_b").alias("v"))
    both = ends.unionByName(ends.select(F.col("v").alias("u"), F.col("u").alias("v")))
    degree = both.groupBy(F.col("u").alias("v")).agg(F.count("*").alias("n"))
    known = both.unionByName(both.select("u", F.col("u").alias("v"))).join(hint(degree), "v")
    step = checkpointed(known.groupBy("u").agg((-F.max(F.struct("n", (-F.col("v")).alias("m")))["m"]).alias("top")))
    onward = step.select(F.col("u").alias("top"), F.col("top").alias("next"))
    return step.join(hint(onward), "top").select(F.col("u").alias("root"), F.col("next").alias("top"))


def near_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    percent: int = PERCENT,
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept, text_key.

    A-Z is lower-cased, words are runs of anything but ASCII white space; a text of fewer than `shingle`
    words is one shingle, one without words (null too) has none and stands alone.
    component_id is the smallest doc_id reachable over links of at least `percent` hundredths (80 to 100), kept the
    row that has it. Rows that repeat an id are told apart by their texts (text_key, a hash of the text); those with
    equal sets share their fate. Rows without
    an id are never linked and keep a null component. Other columns are ignored.
    """
    if not PERCENT <= percent <= 100:
        raise ValueError(f"percent must be from {PERCENT} to 100: the keys miss pairs below that")
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    signed = checkpointed(source.mapInPandas(lambda it: _sketch(it, shingle), SIGNED))
    grouped = (
        signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy("set_id")
        .agg(F.min(F.struct("doc_id", "text_key", "n_shingles", "keys")).alias("r"))
    )
    classes = checkpointed(grouped.select("set_id", "r.doc_id", "r.text_key", F.col("r.n_shingles").alias("size"), F.col("r.keys").alias("keys")))
    # A class goes by its smallest doc_id; classes that share one (an id with several texts), by their sets' hashes.
    repeated = checkpointed(classes.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", F.lit(True).alias("again")))
    unique = not repeated.limit(1).count()
    classes = classes.withColumn("cls", F.col("doc_id")) if unique else classes.join(small_or_not(repeated), "doc_id", "left").withColumn(
        "cls", F.when(F.col("again"), F.xxhash64("set_id")).otherwise(F.col("doc_id"))
    )
    keyed = classes.select("cls", "size", F.explode("keys").alias("key"))
    # Buckets with company: their smallest class, by an aggregate that combines map-side.
    shared = keyed.groupBy("key").agg(F.min(F.struct("cls", "size")).alias("low"), F.max("cls").alias("high")).where("low.cls < high")
    rows = checkpointed(keyed.join(shared.select("key", F.col("low.cls").alias("low"), F.col("low.size").alias("na")), "key").select("key", "cls", "size", "low", "na"))
    involved = classes.join(rows.select("cls").distinct(), "cls", "left_semi").select("cls", "doc_id", "text_key")
    texts = checkpointed(
        source.join(involved, ["doc_id", "text_key"])
        .select("cls", "text")
        .mapInPandas(_pack, "cls long, packed binary")
        .dropDuplicates(["cls"])  # rows that repeat id and text
    )
    fitting = rows.withColumnRenamed("size", "nb").where((F.col("cls") != F.col("low")) & _fits(percent))
    votes = fitting.groupBy("low", "cls").agg(F.count("*").alias("n"))
    best = votes.groupBy("cls").agg(F.max(F.struct("n", (-F.col("low")).alias("m"))).alias("v"))
    star = best.select((-F.col("v.m")).alias("a"), F.col("cls").alias("b")).withColumns({"root_a": F.col("a"), "root_b": F.col("b")})
    links = checkpointed(_verify(star, texts, shingle, percent))
    roots = checkpointed(_parents(links.select("a", "b")))
    labelled = rows.join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("key", "cls", "size", F.coalesce("root", "cls").alias("root"))
    labelled = checkpointed(_open(labelled, lambda frame: frame))
    texts = checkpointed(texts.join(labelled.select("cls").distinct(), "cls", "left_semi"))
    links = links.select("a", "b")
    del rows, fitting, votes, best, star, keyed, shared, roots
    hint = hint_if_few(labelled.count())  # what the rounds join by id is no larger
    for turn in range(1, ROUNDS + 1):
        release(docs.sparkSession)
        star = checkpointed(_star(labelled, turn, percent, hint))
        tried = star.count()
        if not tried:
            break
        held = checkpointed(_verify(hint(star), texts, shingle, percent))
        links = links.unionByName(held.select("a", "b"))
        good = held.count()
        if good:
            labelled = labelled.join(hint(_merged(held, hint)), "root", "left").select("key", "cls", "size", F.coalesce("top", "root").alias("root"))
            labelled = checkpointed(_open(labelled, hint))
        if good < WORTHWHILE * tried:
            break
    more = checkpointed(_attached(labelled, texts, shingle, percent, hint))
    release(docs.sparkSession)
    final = connected(links.unionByName(more)).withColumnRenamed("node", "cls")
    found = classes.select("set_id", "cls", "doc_id").join(final, "cls", "left").select("set_id", "doc_id", F.coalesce("root", "cls").alias("root"))
    if unique:
        members = found.select("set_id", F.col("root").alias("component"))
    else:  # roots are named by the smallest doc_id, whatever their classes go by
        members = found.join(found.groupBy("root").agg(F.min("doc_id").alias("component")), "root").select("set_id", "component")
    joined = signed.select("doc_id", "text_key", "n_shingles", "set_id").join(members, "set_id", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return joined.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "text_key"
    )
