"""SimHash near-duplicates, compared on bit planes.

Equal fingerprints collapse first. The others meet in buckets: with the 64 bits cut into ``radius + 2`` parts, two
fingerprints within ``radius`` bits agree on two whole parts at least, so every pair of parts is a bucket key and no
link is lost. In a bucket, 64 fingerprints are stored as 64 vertical bit planes; a query updates 64 distances at once
with a carry-save counter for each plane and leaves a block as soon as all its counters exceed the radius. Buckets
emit links to the least member of each linked set, never all pairs; a large bucket is cut into tiles.

For a Jaccard similarity of shingle sets the same comparison runs on longer fingerprints with a wide radius, in buckets that lose no pair
of that similarity (:mod:`gridloom.llm.shingle_sets`); the components of these candidates are then settled by the sets themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import shingle_sets
from gridloom.llm.common import ASCII_LOWER, connected_components, discard, materialize, stored, table

#: Fingerprints on each side of a tile of a large bucket.
TILE = 4096
#: For the similarity rule: 64-bit words of a fingerprint, and sets and bytes of sets on each side of a tile of a large group of candidates.
WORDS, SET_TILE, SET_BYTES = 4, 1024, 32 << 20
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: str | None, size: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each word shingle, repeats included; fewer words than ``size`` are one shingle, no word none."""
    w = text.encode().translate(ASCII_LOWER).split() if text else []
    if not w:
        return np.zeros(0, np.uint64)
    joined, h = b" ".join(w), xxhash.xxh64_intdigest
    if len(w) <= size:
        return np.array([h(joined, seed)], np.uint64)
    end = np.cumsum([len(x) + 1 for x in w]) - 1
    start = np.concatenate([[0], end[:-1] + 1])
    return np.array([h(joined[a:b], seed) for a, b in zip(start[: len(w) - size + 1].tolist(), end[size - 1 :].tolist())], np.uint64)


def fingerprint(hashes: np.ndarray, words: int = 1) -> np.ndarray:
    """``words`` 64-bit words; a bit is set if it is set in over half of the hashes; none: zero. Further words vote on mixes of the hashes."""
    votes, n = np.zeros(64 * words, np.int64), len(hashes)
    for i in range(0, n, 255 * 64):
        part = hashes[i : i + 255 * 64]
        wide = np.empty((len(part), words), np.uint64)
        wide[:, 0] = part
        for w in range(1, words):
            x = (part ^ np.uint64(w)) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            wide[:, w] = x ^ (x >> np.uint64(32))
        bits = np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little")
        for k in range(0, len(part), 255):  # a byte holds the sum of 255 bits
            votes += bits[k : k + 255].sum(0, dtype=np.uint8)
    return np.packbits(2 * votes > n, bitorder="little").view(np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """``(id, h, fp)`` for every row of ``docs``, repeats and null ids included; h is xxhash64 of the text. Null and empty texts have fingerprint 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf.id.astype("Int64"), "h": pdf.h, "fp": np.array([fingerprint(shingle_hashes(t, size))[0] for t in pdf.t], np.uint64).view(np.int64)})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("t"))
    return rows.mapInPandas(run, "id long, h long, fp long")


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """(blocks, 64 items, words) of uint64 to (blocks, 64 words of planes): bit i of plane p is bit p of item i."""
    blocks, _, words = fps.shape
    bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(blocks, 64, 8 * words), axis=2, bitorder="little")
    return np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little").reshape(blocks, 64 * words, 8).copy().view(np.uint64)[..., 0]


def within(planes: np.ndarray, block: np.ndarray, query: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For each task (block, query words): a mask of the block's items within ``radius`` bits. Returns the tasks that
    are left at the end and their masks. A counter is held as bit planes; a carry out of the top stays set in ``over``."""
    width = max(1, (radius + 1).bit_length())
    live = np.arange(len(block))
    count = np.zeros((width, len(block)), np.uint64)
    over = np.zeros(len(block), np.uint64)
    last = planes.shape[1] - 1
    for p in range(last + 1):
        flip = np.where((query[live, p >> 6] >> np.uint64(p & 63)) & np.uint64(1), _ALL, np.uint64(0))
        carry = planes[block[live], p] ^ flip
        for c in range(min(width, (p + 1).bit_length())):  # higher counters are still zero
            count[c], carry = count[c] ^ carry, count[c] & carry
        over |= carry
        if p > radius and p % 8 == 7 or p == last:
            # a counter that has passed the radius never comes back
            past, equal = over.copy(), np.full(len(live), _ALL)
            for c in range(width - 1, -1, -1):
                if radius >> c & 1:
                    equal &= count[c]
                else:
                    past |= equal & count[c]
                    equal &= ~count[c]
            over = past
            stay = over != _ALL
            if not stay.all():
                live, over, count = live[stay], over[stay], count[:, stay]
    return live, ~over


def _bucket_links(group: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, least member of its linked set) in each run of equal ``group``; ``fp`` has a row of words for each member."""
    n = len(fp)
    start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.concatenate([start, [n]]))
    blocks = -(-size // 64)
    first_block = np.concatenate([[0], np.cumsum(blocks)[:-1]])
    run = np.repeat(np.arange(len(start)), size)
    slot = first_block[run] * 64 + np.arange(n) - start[run]
    grid = np.zeros((int(blocks.sum()) * 64, fp.shape[1]), np.uint64)
    item = np.full(len(grid), -1, np.int64)
    grid[slot], item[slot] = fp, np.arange(n)
    planes = bit_planes(grid.reshape(-1, 64, fp.shape[1]))
    own = slot // 64
    tasks = first_block[run] + blocks[run] - own  # this block and those after it
    parent = np.arange(n)
    lo = 0
    while lo < n:  # about 50,000 tasks at a time
        hi = max(lo + 1, int(np.searchsorted(np.cumsum(tasks[lo:]), 50_000)) + lo)
        k = tasks[lo:hi]
        q = np.repeat(np.arange(lo, hi), k)
        blk = own[q] + np.arange(len(q)) - np.repeat(np.concatenate([[0], np.cumsum(k)[:-1]]), k)
        live, mask = within(planes, blk, fp[q], radius)
        if len(live):
            bits = np.unpackbits(mask.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
            t, c = np.nonzero(bits)
            a, b = q[live[t]], item[blk[live[t]] * 64 + c]
            real = (b >= 0) & (a != b)
            a, b = a[real], b[real]
            while len(a):  # least label over each link, then over each parent
                was = parent.copy()
                m = np.minimum(parent[a], parent[b])
                np.minimum.at(parent, parent[a], m)
                np.minimum.at(parent, parent[b], m)
                parent = parent[parent]
                if (was == parent).all():
                    break
        lo = hi
    while (parent[parent] != parent).any():
        parent = parent[parent]
    at = np.flatnonzero(parent != np.arange(n))
    return at, parent[at]


def _linker(radius: int):
    """Rows (k, i, j, name, fp) in order of their bucket to links ``a, b`` of names; fp is a number or the bytes of several words."""

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        g = pdf.groupby(["k", "i", "j"], sort=False).ngroup().to_numpy()
        fp = np.frombuffer(b"".join(pdf.fp), np.uint64).reshape(len(pdf), -1) if pdf.fp.dtype == object else pdf.fp.to_numpy().view(np.uint64)[:, None]
        a, b = _bucket_links(g, fp, radius)
        name = pdf.name.to_numpy()
        return pd.DataFrame({"a": name[a], "b": name[b]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None  # rows of the last bucket, which the next batch may go on with
        for pdf in batches:
            if rest is not None:
                pdf = pd.concat([rest, pdf], ignore_index=True)
            if not len(pdf):
                continue
            last = pdf.iloc[-1]
            open_ = ((pdf.k == last.k) & (pdf.i == last.i) & (pdf.j == last.j)).to_numpy()
            rest, done = pdf[open_], pdf[~open_]
            if len(done):
                yield links(done)
        if rest is not None and len(rest):
            yield links(rest)
    return run


def _tiles(members: DataFrame, tiles) -> DataFrame:
    """Members of groups k as rows ``k, i, j, part, name``: each pair of a group's ``tiles`` parts is a tile of its own, so no task holds a large group."""
    t = members.withColumn("t", tiles.cast("int")).withColumn("part", F.pmod(F.xxhash64("name"), F.col("t")).cast("int"))
    t = t.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("t") - 1)))
    return t.select("k", F.least("part", "o").alias("i"), F.greatest("part", "o").alias("j"), "part", "name")


def fingerprint_links(fps: DataFrame, radius: int = 2, tile: int = TILE) -> DataFrame:
    """``(a, b)`` links of distinct fingerprints (column ``fp``) whose closure is that of all pairs within ``radius`` bits."""
    parts = radius + 2
    cut = [round(i * 64 / parts) for i in range(parts + 1)]
    mask = [((1 << cut[i + 1]) - 1) ^ ((1 << cut[i]) - 1) for i in range(parts)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keys = [F.xxhash64(F.lit(n), F.col("fp").bitwiseAND(F.lit(signed(mask[x] | mask[y])))) for n, (x, y) in enumerate(combinations(range(parts), 2))]
    keyed = fps.select(F.col("fp").alias("name"), F.explode(F.array(*keys)).alias("k"))
    counts = keyed.groupBy("k").count().where("count > 1").select(F.col("k").alias("k2"), F.col("count").alias("n"))
    tiled = _tiles(keyed.join(counts, F.col("k") == F.col("k2")).select("name", "k", "n"), F.ceil(F.col("n") / tile)).withColumn("fp", F.col("name")).drop("part")
    dealt = tiled.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j")
    return dealt.mapInPandas(_linker(radius), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, radius: int = 2) -> DataFrame:
    """``id, h, fp, component_id, group`` per row of ``docs``; component_id is the least id reachable over fingerprints within ``radius`` bits,
    group a fingerprint that stands for the component.

    Rows with null or empty texts share fingerprint 0 and link like others. Null ids are kept; a component of null ids only has
    component_id null. Repeated rows get equal results. Other columns play no part."""
    fps = materialize(fingerprints(docs, id_col, text_col, size), "fps")
    reps = materialize(fps.groupBy("fp").agg(F.min("id").alias("rep")), "reps")
    comp = connected_components(fingerprint_links(reps.select("fp"), radius))
    named = reps.join(comp.select(F.col("node").alias("fp"), "component"), "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("c"))
    least = named.groupBy("c").agg(F.min("rep").alias("component_id"))
    known = named.join(least, "c").select(F.col("fp").alias("f2"), "component_id", F.col("c").alias("group"))
    return fps.join(known, F.col("fp") == F.col("f2")).select("id", "h", "fp", "component_id", "group")


def similarity_radius(threshold: float, words: int = WORDS) -> int:
    """Bits within which fingerprints of sets of Jaccard similarity ``threshold`` lie, by six standard deviations: their angle is at most that of two sets of one size."""
    share = float(np.arccos(2 * threshold / (1 + threshold)) / np.pi)
    share = max(share, 0.1875)  # sets of five and four shingles, where a vote more or less tips most bits
    return int(np.ceil(64 * words * share + 6 * np.sqrt(64 * words * share * (1 - share))))


def set_components(docs: DataFrame, known: DataFrame, text_col: str, size: int, threshold: float, tile: int = TILE, set_tile: int = SET_TILE) -> DataFrame:
    """``(node, component)`` of signatures over all pairs at ``threshold`` or above. ``known`` has h, sig, size, fp and keys of every row of ``docs``."""
    spark = docs.sparkSession
    radius = similarity_radius(threshold)
    keyed = known.select(F.explode("keys").alias("k"), "sig").dropDuplicates(["k", "sig"]).repartition("k").sortWithinPartitions("k")
    met, met_path = stored(keyed.mapInArrow(shingle_sets.shared_buckets, "k long, sig long, g long, n long"), "met")
    once = met.groupBy("g", "n").agg(F.min("k").alias("k1")).select(F.col("g").alias("g1"), F.col("n").alias("n1"), "k1")  # buckets of equal members count once
    met = met.join(once, (F.col("g") == F.col("g1")) & (F.col("n") == F.col("n1")) & (F.col("k") == F.col("k1"))).select("k", F.col("sig").alias("name"), "n")
    prints = known.groupBy("sig").agg(F.min("fp").alias("fp"), F.min("size").alias("size"), F.min("h").alias("h"))
    prints = materialize(prints, "prints")
    tiled = _tiles(met, F.ceil(F.col("n") / tile)).join(prints.select("sig", "fp"), F.col("name") == F.col("sig")).select("k", "i", "j", "name", "fp")
    dealt = tiled.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j")
    maybe = connected_components(dealt.mapInPandas(_linker(radius), "a long, b long").distinct()).select(F.col("component").alias("k"), F.col("node").alias("sig"))
    discard(spark, met_path)
    maybe = materialize(maybe.join(prints, "sig"), "maybe")
    weight = maybe.groupBy(F.col("k").alias("k1")).agg(F.greatest(F.ceil(F.count("*") / set_tile), F.ceil(F.sum("size") * 8 / SET_BYTES)).alias("t"))
    members = _tiles(maybe.join(weight, F.col("k") == F.col("k1")).select("k", F.col("sig").alias("name"), "t"), F.col("t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"sig": pdf.sig, "fp": pdf.fp, "data": [np.unique(shingle_hashes(t, size)).tobytes() for t in pdf.t]})

    asked = maybe.select("sig", "fp", F.col("h").alias("h1"))
    texts = docs.select(F.xxhash64(text_col).alias("h"), F.col(text_col).alias("t")).join(asked, F.col("h") == F.col("h1")).dropDuplicates(["sig"]).select("sig", "fp", "t")
    sets, sets_path = stored(texts.mapInPandas(run, "sig long, fp binary, data binary"), "sets")
    dealt = members.join(sets, F.col("name") == F.col("sig")).drop("sig").repartition("k", "i", "j").sortWithinPartitions("k", "i", "j")
    found = connected_components(dealt.mapInPandas(shingle_sets.exact_linker(threshold, radius), "a long, b long").distinct())
    discard(spark, sets_path)
    return found


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: float = 0.8) -> DataFrame:
    """``id, h, component_id, group`` per row of ``docs``; component_id is the least id reachable over pairs of texts whose sets of ``size`` words have a
    Jaccard similarity of ``threshold`` or more, group a signature that stands for the component. h is xxhash64 of the text.

    Texts without words (null, empty, blank) are copies of each other; a text of fewer words than ``size`` is one shingle. Null ids are kept; a component of null ids only has
    component_id null. Repeated rows get equal results. Other columns play no part; an empty table gives no row."""
    late = docs.sparkSession.sparkContext.broadcast(shingle_sets.frequent(docs, text_col, lambda t: shingle_hashes(t, size)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            s = [np.unique(shingle_hashes(t, size)) for t in pdf.t]
            yield pd.DataFrame({"id": pdf.id.astype("Int64"), "h": pdf.h, "sig": [shingle_sets.signature(x) for x in s], "size": [len(x) for x in s], "fp": [fingerprint(x, WORDS).tobytes() for x in s],
                                "keys": [shingle_sets.prefix(x, threshold, late.value).view(np.int64) for x in s]})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("t"))
    known = materialize(rows.mapInPandas(run, "id long, h long, sig long, size long, fp binary, keys array<long>"), "known")
    comp = set_components(docs, known, text_col, size, threshold)
    reps = known.groupBy("sig").agg(F.min("id").alias("rep"))
    named = reps.join(comp.select(F.col("node").alias("sig"), "component"), "sig", "left").select("sig", "rep", F.coalesce("component", "sig").alias("c"))
    least = named.groupBy("c").agg(F.min("rep").alias("component_id"))
    found = named.join(least, "c").select(F.col("sig").alias("s2"), "component_id", F.col("c").alias("group"))
    return known.select("id", "h", "sig").join(found, F.col("sig") == F.col("s2")).select("id", "h", "component_id", "group")


def _firsts(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with one row of each group of ``found`` (id, h, component_id, group): that of the least id (of null ids only: one of them). All columns are kept."""
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("\0"))
    first = found.where("id <=> component_id").groupBy("id", "group").agg(F.min("h").alias("_h")).select(F.coalesce(F.col("id").cast("string"), F.lit("\0")).alias("_i"), "_h")
    own = docs.select(key.alias("_i"), F.xxhash64(text_col).alias("_h"), F.struct(*[F.col(c) for c in docs.columns]).alias("_doc"))
    return own.dropDuplicates(["_i", "_h"]).join(first, ["_i", "_h"], "left_semi").select(*[F.col("_doc")[c].alias(c) for c in docs.columns])


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, radius: int = 2) -> DataFrame:
    """``docs`` with one row of each component of :func:`near_duplicates`: that of the least id (of null ids only: one of them). All columns are kept."""
    return _firsts(docs, near_duplicates(docs, id_col, text_col, size, radius), id_col, text_col)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: float = 0.8) -> DataFrame:
    """``docs`` with one row of each component of :func:`near_copies`: that of the least id (of null ids only: one of them). All columns are kept."""
    return _firsts(docs, near_copies(docs, id_col, text_col, size, threshold), id_col, text_col)


def op6_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
