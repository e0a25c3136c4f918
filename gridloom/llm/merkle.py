"""Merkle manifest of a dataset: a SHA-256 tree whose parents keep hash states, so that a changed leaf is folded to the root without hashing what lies left of it again.

Digests enter their parent as hex text, 64 bytes, which is one block of SHA-256. So the state of the hash before a child slot is the chain value after the children
before it: 32 bytes. That of slot 0 is the same for every parent; a parent of two children stores the one before slot 1. Folding resumes from the state of the slot where
the path enters, with the replacement and the siblings to the right. States are plain bytes in a table, so they outlive the task that made them.

The rows of a group are numbered by a range sort and counts of its parts. Complete subtrees of LEVELS levels are pages: one task reads a page at a time, all parents of a level together in numpy, and its top is a leaf of the
next layer of pages. The tops of the groups make a tree of the same form. Then the path above each page is worked out from the top down, and the leaves of a page are folded beside its parents and that path.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridloom.llm.common import materialize, table

#: Levels of a page of leaves; a page has two to this power.
LEVELS = 10
#: Leaves that one task reads, about.
TASK_LEAVES = 8192
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<sibling:binary,state:binary>>"
_NODES = "g string, n long, level int, i long, digest binary, state binary"


# SHA-256 on many rows at once


def _primes(n: int) -> list[int]:
    found: list[int] = []
    k = 2
    while len(found) < n:
        if all(k % p for p in found):
            found.append(k)
        k += 1
    return found


def _cube_root(x: int) -> int:
    r = 1 << -(-x.bit_length() // 3)
    while r * r * r > x:
        r = (2 * r + x // (r * r)) // 3
    return r


#: First 32 bits of the fractions of the square roots of 8 primes and the cube roots of 64.
_START = np.array([isqrt(p << 64) & 0xFFFFFFFF for p in _primes(8)], np.uint32)
_ROUND = np.array([_cube_root(p << 96) & 0xFFFFFFFF for p in _primes(64)], np.uint32)
_HEX = np.frombuffer(b"".join(b"%02x" % i for i in range(256)), np.uint8).reshape(256, 2)


def _turn(x: np.ndarray, k: int) -> np.ndarray:
    return (x >> np.uint32(k)) | (x << np.uint32(32 - k))


def compress(state: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The states (8 x n) after one more block (16 x n words)."""
    w = list(words)
    for t in range(16, 64):
        p, q = w[t - 15], w[t - 2]
        w.append(w[t - 16] + (_turn(p, 7) ^ _turn(p, 18) ^ (p >> np.uint32(3))) + w[t - 7] + (_turn(q, 17) ^ _turn(q, 19) ^ (q >> np.uint32(10))))
    a, b, c, d, e, f, g, h = state
    for t in range(64):
        x = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + ((e & f) ^ (~e & g)) + _ROUND[t] + w[t]
        y = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) ^ (a & c) ^ (b & c))
        a, b, c, d, e, f, g, h = x + y, a, b, c, d + x, e, f, g
    return state + np.stack([a, b, c, d, e, f, g, h])


def fresh(n: int) -> np.ndarray:
    """The state of an empty hash, n times."""
    return np.repeat(_START[:, None], n, 1)


def feed(state: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """States after the hex text of ``digests`` (n x 32 bytes)."""
    if not len(digests):
        return state
    return compress(state, _HEX[digests].reshape(len(digests), 64).view(">u4").astype(np.uint32).T)


def close(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Digests (n x 32 bytes) of hashes that took ``blocks`` whole blocks."""
    bits = np.asarray(blocks, np.uint64) * np.uint64(512)
    words = np.zeros((16, state.shape[1]), np.uint32)
    words[0], words[14], words[15] = 0x80000000, bits >> np.uint64(32), bits & np.uint64(0xFFFFFFFF)
    return compress(state, words).T.astype(">u4", order="C").view(np.uint8).reshape(-1, 32)


def _as_rows(column) -> tuple[np.ndarray, np.ndarray]:
    """A column of 32-byte values as n x 32 bytes, and which are there."""
    there = np.array([v is not None for v in column], bool)
    return np.array(bytearray().join(v if v is not None else bytes(32) for v in column), np.uint8).reshape(-1, 32), there


def _as_bytes(rows: np.ndarray, there: np.ndarray | None = None) -> list[bytes | None]:
    flat = np.ascontiguousarray(rows).tobytes()
    return [flat[32 * i : 32 * i + 32] if there is None or there[i] else None for i in range(len(rows))]


def _state_rows(state: np.ndarray) -> np.ndarray:
    return state.T.astype(">u4", order="C").view(np.uint8).reshape(-1, 32)


def _row_states(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows).view(">u4").astype(np.uint32).reshape(-1, 8).T


# pages in tasks


def _whole_pages(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Rows in the order of (g, page) as frames of whole pages, with the number of each row's page in its frame."""
    rest = None
    for pdf in batches:
        if not len(pdf):
            continue
        both = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        g, page = both.g.to_numpy(), both.page.to_numpy()
        number = np.concatenate([[0], np.cumsum((g[1:] != g[:-1]) | (page[1:] != page[:-1]))])
        cut = int(np.searchsorted(number, number[-1]))
        if cut:
            yield both.iloc[:cut], number[:cut]
        rest = both.iloc[cut:].reset_index(drop=True)
    if rest is not None:
        yield rest, np.zeros(len(rest), np.int64)


def _build(batches: Iterator[pd.DataFrame], levels: int) -> Iterator[pd.DataFrame]:
    """The parents of the levels above ``level`` in each page, each with the state before its second child."""
    for pdf, page in _whole_pages(batches):
        g, n, i, level = pdf.g.to_numpy(), pdf.n.to_numpy(), pdf.i.to_numpy(), pdf.level.to_numpy()
        digest, _ = _as_rows(pdf.digest)
        for _ in range(levels):
            more = np.flatnonzero(((n - 1) >> level) > 0)  # groups that are not one node yet
            g, n, i, level, digest, page = g[more], n[more], i[more], level[more], digest[more], page[more]
            if not len(more):
                break
            first = np.concatenate([[True], (i[1:] >> 1 != i[:-1] >> 1) | (page[1:] != page[:-1])])
            left = np.flatnonzero(first)
            pair = np.diff(np.append(left, len(i))) == 2
            state = feed(fresh(len(left)), digest[left])
            kept = _state_rows(state)
            state[:, pair] = feed(state[:, pair], digest[left[pair] + 1])
            g, n, i, level, page = g[left], n[left], i[left] >> 1, level[left] + 1, page[left]
            digest = close(state, 1 + pair)
            yield pd.DataFrame({"g": g, "n": n, "level": level, "i": i, "digest": _as_bytes(digest), "state": _as_bytes(kept, pair)})


class _Paths:
    """The nodes of whole pages of one layer, and the way up from some of them."""

    def __init__(self, page, level, i, digest, state, levels: int):
        self.levels = levels
        self.rows = np.argsort(self._key(page, level, i))
        self.keys = self._key(page, level, i)[self.rows]
        self.digest, _ = _as_rows(digest)
        self.state, _ = _as_rows(state)

    def _key(self, page, level, i):
        """Pages in order, and in a page the place in its heap (level 0 is that of its leaves)."""
        width = 1 << (self.levels - level.astype(np.int64))
        return (page.astype(np.int64) << (self.levels + 1)) + width + (i & (width - 1))

    def _find(self, page, level, i):
        k = self._key(page, np.full(len(i), level), i)
        at = np.minimum(np.searchsorted(self.keys, k), max(0, len(self.keys) - 1))
        return self.rows[at], (self.keys[at] == k if len(self.keys) else np.zeros(len(k), bool))

    def steps(self, page, i, left):
        """For each level of a page: which items go up (those with levels ``left``), whether they are a second child, the state of their parent, and a sibling, if any."""
        for k in range(self.levels):
            up = np.flatnonzero(left > k)
            if not len(up):
                return
            parent, _ = self._find(page[up], k + 1, i[up] >> (k + 1))
            sibling, there = self._find(page[up], k, (i[up] >> k) ^ 1)
            yield up, (i[up] >> k & 1).astype(bool), self.state[parent], self.digest[sibling], there


class _Fold:
    """Digests on their way up, and the hash of the siblings that they met."""

    def __init__(self, digest: np.ndarray):
        self.digest, self.proof, self.met = digest.copy(), fresh(len(digest)), np.zeros(len(digest), np.int64)

    def up(self, rows, second, state, sibling, there) -> None:
        """Resume the parent's hash at the slot of ``rows`` with their digests and, from the first slot, the sibling at the right; left siblings enter the proof only."""
        resumed = np.where(second, _row_states(state), _START[:, None]) if len(rows) else fresh(0)
        resumed = feed(resumed, self.digest[rows])
        right = there & ~second
        resumed[:, right] = feed(resumed[:, right], sibling[right])
        self.digest[rows] = close(resumed, np.where(there, 2, 1))
        self.proof[:, rows[there]] = feed(self.proof[:, rows[there]], sibling[there])
        self.met[rows] += there


def _above(batches: Iterator[pd.DataFrame], levels: int) -> Iterator[pd.DataFrame]:
    """``g, i, path``: the way from each node of the lowest level of a layer to the root, given the way of each page (rows of kind 2)."""
    for pdf, page in _whole_pages(batches):
        kind = pdf.kind.to_numpy()
        node, top = pdf[kind == 1], pdf[kind == 2]
        rest = dict(zip(page[kind == 2], top.path))
        item = np.flatnonzero((kind == 1) & (pdf.level.to_numpy() == 0))
        paths = _Paths(page[kind == 1], node.level.to_numpy(), node.i.to_numpy(), node.digest, node.state, levels)
        ways = [[] for _ in item]
        for up, second, state, sibling, there in paths.steps(page[item], pdf.i.to_numpy()[item], pdf.left.to_numpy()[item]):
            for k, (s, d) in zip(up, zip(_as_bytes(state, second), _as_bytes(sibling, there))):
                ways[k].append({"sibling": d, "state": s})
        if len(item):
            yield pd.DataFrame({"g": pdf.g.to_numpy()[item], "i": pdf.i.to_numpy()[item], "path": pd.Series([w + list(rest.get(page[k], [])) for w, k in zip(ways, item)], dtype=object)})


def _fold(batches: Iterator[pd.DataFrame], levels: int) -> Iterator[pd.DataFrame]:
    """One row for each leaf that is to be folded; pages hold leaves (kind 1, level 0), parents (kind 1) and the way above them (kind 2)."""
    for pdf, page in _whole_pages(batches):
        kind, level = pdf.kind.to_numpy(), pdf.level.to_numpy()
        node = kind == 1
        paths = _Paths(page[node], level[node], pdf.i.to_numpy()[node], pdf.digest[node], pdf.state[node], levels)
        item = np.flatnonzero(node & (level == 0) & pdf.fold.to_numpy(bool))
        if not len(item):
            continue
        own, changed = _as_rows(pdf.digest.iloc[item])[0], pdf.given.iloc[item]
        given, there = _as_rows(changed)
        f, where = _Fold(np.where(there[:, None], given, own)), page[item]
        for step in paths.steps(where, pdf.i.to_numpy()[item], pdf.left.to_numpy()[item]):
            f.up(*step)
        at = np.flatnonzero(kind == 2)
        order = np.searchsorted(page[at], where)  # each page has one such row
        ways = [list(pdf.path.iloc[k]) for k in at]
        for k in range(max((len(w) for w in ways), default=0)):
            known = np.array([len(w) > k for w in ways])
            step = [w[k] if len(w) > k else {"sibling": None, "state": None} for w in ways]
            (state, second), (sibling, beside) = _as_rows([s["state"] for s in step]), _as_rows([s["sibling"] for s in step])
            rows = np.flatnonzero(known[order])
            o = order[rows]
            f.up(rows, second[o], state[o], sibling[o], beside[o])
        sub = pdf.top.to_numpy()[at]
        yield pd.DataFrame({"id": pdf.id.iloc[item].to_numpy(), "g": pdf.g.iloc[item].to_numpy(), "i": pdf.i.iloc[item].to_numpy(), "leaf": _as_bytes(own), "subroot": [sub[k] for k in order],
                            "proof": _as_bytes(close(f.proof, f.met)), "folded": _as_bytes(f.digest)})


# tables


def field(c):
    """A value as it enters a leaf: ``-`` if null, else its bytes, a colon and itself."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_digest(*columns):
    """The digest of a row (32 bytes): SHA-256 of its fields, one after another."""
    return F.unhex(F.sha2(F.concat(*[field(c) for c in columns]), 256))


def _levels(n):
    """Levels above ``n`` nodes."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0).cast("int")


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` as a stored table with ``i``, the place of each in its group ``g`` by ``order``, and ``n``, the size of the group.

    Ranges of (g, order) are sorted side by side; the counts of groups in ranges give each range its start. Rows that are the same in all of ``order`` may lie in several ranges."""
    d = rows.withColumn("_tie", F.rand(11))
    d = d.repartitionByRange("g", *order, "_tie").sortWithinPartitions("g", *order).withColumn("_m", F.monotonically_increasing_id()).drop("_tie")
    d = materialize(d.withColumn("_p", F.shiftright("_m", 33)), name)
    parts = d.groupBy(F.col("g").alias("_g"), F.col("_p").alias("_q")).agg(F.count("*").alias("c"), F.min("_m").alias("_first"))
    before = F.coalesce(F.sum("c").over(W.partitionBy("_g").orderBy("_q").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = materialize(parts.select("_g", "_q", "_first", before.alias("_start"), F.sum("c").over(W.partitionBy("_g")).alias("n")), f"{name}_parts")  # a row for each group in a range
    both = d.join(parts, (F.col("g") == F.col("_g")) & (F.col("_p") == F.col("_q")))
    return both.withColumn("i", F.col("_start") + F.col("_m") - F.col("_first")).drop("_g", "_p", "_q", "_m", "_first", "_start")


def _paged(d: DataFrame, leaves: int) -> DataFrame:
    """Rows of whole pages side by side, in order."""
    return d.repartition(max(1, -(-leaves // TASK_LEAVES)), "g", "page").sortWithinPartitions("g", "page", "kind", "level", "i")


def build_tree(leaves: DataFrame, levels: int = LEVELS) -> DataFrame:
    """All parents of ``leaves`` (g, n, i, digest) as a stored table: ``g, n, level, i, digest, state``, where ``state`` is that of the hash before the second child (null for an only child).

    Every 2 consecutive nodes of a level make one of the next, until one is left; a group of one leaf has no parents."""
    low = leaves.select("g", "n", F.lit(0).alias("level"), "i", "digest")
    size, count = leaves.agg(F.coalesce(F.max("n"), F.lit(0)), F.count("*")).first()
    built = None
    base = 0
    while True:
        rows = low.where(F.col("n") > F.expr(f"1L << {base}")).withColumns({"page": F.shiftright("i", levels), "kind": F.lit(1)})
        layer = materialize(_paged(rows, count >> base).mapInPandas(lambda b: _build(b, levels), _NODES), f"layer{base}")
        built = layer if built is None else built.unionAll(layer)
        base += levels
        if size <= 1 << base:
            return built
        low = layer.where(F.col("level") == base)


def tops(leaves: DataFrame, parents: DataFrame) -> DataFrame:
    """``g, digest``: the last node of each group."""
    return leaves.where("n = 1").select("g", "digest").unionAll(parents.where(F.col("level") == _levels(F.col("n"))).select("g", "digest"))


def _layer(leaves: DataFrame, parents: DataFrame, base: int, levels: int) -> DataFrame:
    """The nodes of one layer, levels counted from its lowest, and the levels left to go up in it."""
    all_nodes = leaves.select("g", "n", F.lit(0).alias("level"), "i", "digest", F.lit(None).cast("binary").alias("state")) if base == 0 else parents.where(F.col("level") == base)
    inner = all_nodes.unionByName(parents.where(F.col("level").between(base + 1, base + levels)).select(*all_nodes.columns))
    level = F.col("level") - base
    return inner.select("g", F.expr(f"i >> ({levels} - (level - {base}))").alias("page"), F.lit(1).alias("kind"), level.cast("int").alias("level"), "i", "digest", "state",
                        F.greatest(F.lit(0), F.least(_levels(F.col("n")) - base, F.lit(levels))).alias("left"))


def page_paths(leaves: DataFrame, parents: DataFrame, above: DataFrame, lowest: int = 1, levels: int = LEVELS) -> DataFrame:
    """``g, i, path``: the way from each page of leaves to the root, as sibling (null: none) and state (null: first slot) of each level; with ``lowest`` 0 that from each leaf.

    ``above`` is the way (g, path) of each group's top. Layers are gone through from the top down; the way from a node ends with that of its page."""
    size, count = leaves.agg(F.coalesce(F.max("n"), F.lit(0)), F.count("*")).first()
    layers = max(1, -(-(int(size) - 1).bit_length() // levels)) if size else 1
    ways = above.select("g", F.lit(0).cast("long").alias("i"), "path")
    for layer in range(layers - 1, lowest - 1, -1):
        base = layer * levels
        large = F.col("n") > F.expr(f"1L << {base}")
        nodes = _layer(leaves.where(large), parents.where(large), base, levels).withColumn("path", F.array().cast(_PATH))
        found = _paged(nodes.unionByName(_tail(ways)), count >> base).mapInPandas(lambda b: _above(b, levels), f"g string, i long, path {_PATH}")
        # a group that ends below this layer has one node there, whose way is that of its top
        short = leaves.where((F.col("i") == 0) & ~large).select("g").join(above, "g").select("g", F.lit(0).cast("long").alias("i"), "path")
        ways = materialize(found.unionByName(short), f"ways{layer}")
    return ways


def _tail(ways: DataFrame) -> DataFrame:
    """The rows of kind 2: the way above each page."""
    none = F.lit(None).cast("binary")
    return ways.select("g", F.col("i").alias("page"), F.lit(2).alias("kind"), F.lit(0).alias("level"), F.lit(0).cast("long").alias("i"), none.alias("digest"), none.alias("state"), F.lit(0).alias("left"), "path")


def fold_leaves(leaves: DataFrame, parents: DataFrame, above: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``id, g, i, leaf, subroot, proof, folded`` of each leaf where ``fold`` holds: the root that follows if the leaf is ``given`` (null: as it is), and the hash of its siblings up to the root.

    ``leaves`` has g, n, i, digest, id, given and fold; ``above`` the way (g, path) from each group's top to the root and that top (``top``)."""
    none = F.lit(None).cast("binary")
    ways = page_paths(leaves, parents, above.select("g", "path"), levels=levels).join(above.select("g", "top"), "g")
    blank = {"id": F.lit(None).cast("long"), "given": none, "fold": F.lit(False)}
    inner = _layer(leaves, parents, 0, levels).where("level > 0").withColumns(blank)
    low = leaves.select("g", F.shiftright("i", levels).alias("page"), F.lit(1).alias("kind"), F.lit(0).alias("level"), "i", "digest", none.alias("state"), F.least(_levels(F.col("n")), F.lit(levels)).alias("left"), *blank)
    both = low.unionByName(inner).withColumns({"path": F.array().cast(_PATH), "top": none})
    tail = _tail(ways.withColumn("path", F.struct("path", "top"))).withColumns({**blank, "top": F.col("path.top"), "path": F.col("path.path")})
    return _paged(both.unionByName(tail), leaves.count()).mapInPandas(lambda b: _fold(b, levels), "id long, g string, i long, leaf binary, subroot binary, proof binary, folded binary")


def group_key(c):
    """A group's name as text that sorts bytewise, null first."""
    return F.when(c.isNull(), F.lit("")).otherwise(F.concat(F.lit(":"), c.cast("string")))


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "lang", changed=None, levels: int = LEVELS) -> dict[str, DataFrame]:
    """The manifest of ``docs`` as stored tables.

    ``leaves``: g, i, n, id, digest, given (the digest of the row as ``changed`` has it, where that differs; ``changed`` maps some of ``fields`` to other columns) and fold (true);
    ``parents``: g, n, level, i, digest, state; ``subroots``: g, i, n, digest; ``top_parents``: the tree over the subroots."""
    digest = leaf_digest(*[F.col(c) for c in fields])
    given = F.lit(None).cast("binary")
    if changed:
        differs = F.array_contains(F.array(*[~F.col(c).eqNullSafe(other) for c, other in changed.items()]), True)
        given = F.when(differs, leaf_digest(*[changed.get(c, F.col(c)) for c in fields]))
    rows = docs.select(group_key(F.col(group_col)).alias("g"), F.col(id_col).cast("long").alias("id"), digest.alias("digest"), given.alias("given"))
    leaves = numbered(rows, ["id", "digest"], "leaves").withColumn("fold", F.lit(True))
    parents = build_tree(leaves, levels)
    subroots = numbered(tops(leaves, parents).select(F.lit("").alias("g"), F.col("g").alias("group"), "digest"), ["group"], "subroots")
    return {"leaves": leaves, "parents": parents, "subroots": subroots, "top_parents": build_tree(subroots, levels)}


def audit(m: dict[str, DataFrame], levels: int = LEVELS) -> DataFrame:
    """``id, leaf, subroot, root, proof_sha256, folded_root, verified`` of each leaf of a manifest.

    ``proof_sha256`` hashes the siblings from the leaf to the root; ``folded_root`` follows from the changed digest where one is given, else from the leaf; ``verified`` says whether it is the root."""
    subroots, over = m["subroots"], m["top_parents"]
    start = subroots.where("i = 0").select("g", F.array().cast(_PATH).alias("path"))
    ways = page_paths(subroots, over, start, 0, levels).select(F.col("i").alias("slot"), "path")
    named = subroots.select(F.col("i").alias("slot"), F.col("group").alias("g"), F.col("digest").alias("top"))
    above = materialize(ways.join(named, "slot").select("g", "path", "top"), "above")  # a row for each group
    text = lambda c: F.lower(F.hex(c))
    root = text(tops(subroots, over).select("digest").scalar())  # one value
    found = fold_leaves(m["leaves"], m["parents"], above, levels).withColumn("root", root)
    folded = text(F.col("folded"))
    return found.select("id", text("leaf").alias("leaf"), text("subroot").alias("subroot"), "root", text("proof").alias("proof_sha256"), folded.alias("folded_root"), (folded == F.col("root")).alias("verified"))


def audit_documents(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "lang", changed=None, levels: int = LEVELS) -> DataFrame:
    """:func:`audit` of the :func:`manifest` of ``docs``.

    Null fields enter as ``-``, empty texts as ``0:``; a null group is the first one. Leaves of a group are in the order of id (null first) and, for ids that repeat, of their digest; rows that are the same in both
    stand for each other. Texts of any length are hashed whole, outside Python. An empty table gives no row; other columns play no part."""
    return audit(manifest(docs, fields, id_col, group_col, changed, levels), levels)


def op11_merkle_manifest(spark, sf_dir: str, levels: int = LEVELS) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    hit = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 7 == 0
    n = F.col("n_chars").cast("decimal(20,0)")
    return audit_documents(docs, changed={"n_chars": F.when(hit, n + 1).otherwise(n)}, levels=levels).withColumnRenamed("id", "doc_id")


def _sql_field(c: str) -> str:
    return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"


#: Trees, siblings and folding level by level; crc32 by its polynomial.
OP11_SQL = f"""
WITH RECURSIVE crc AS (
  SELECT doc_id, xor(4294967295, list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT)),
    lambda c, b: list_reduce(range(8), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)), 4294967295)) AS crc
  FROM documents WHERE doc_id IS NOT NULL),
leaf AS (
  SELECT row_number() OVER () AS r, d.doc_id, CASE WHEN lang IS NULL THEN '' ELSE ':' || lang END AS g,
    sha256({" || ".join(_sql_field(f"d.{c}") for c in FIELDS)}) AS leaf,
    sha256({" || ".join(_sql_field(f"d.{c}" if c != "n_chars" else "(d.n_chars + CASE WHEN crc % 7 = 0 THEN 1 ELSE 0 END)") for c in FIELDS)}) AS given
  FROM documents d LEFT JOIN crc USING (doc_id)),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM leaf),
tree AS (
  SELECT g, 0 AS lvl, i, n, leaf AS h FROM placed
  UNION ALL
  SELECT g, lvl + 1, i // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY i)) FROM tree WHERE n > 1 GROUP BY g, lvl, i // 2),
sub AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1),
top AS (
  SELECT 0 AS lvl, i, n, subroot AS h FROM sub
  UNION ALL
  SELECT lvl + 1, i // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY lvl, i // 2),
nodes AS (SELECT g, lvl, i, n, h FROM tree UNION ALL SELECT '/', lvl, i, n, h FROM top),
climb AS (
  SELECT r, g, 0 AS lvl, i, given AS h, '' AS seen FROM placed
  UNION ALL
  SELECT c.r, CASE WHEN mine.n = 1 THEN '/' ELSE c.g END, CASE WHEN mine.n = 1 THEN 0 ELSE c.lvl + 1 END, CASE WHEN mine.n = 1 THEN sub.i ELSE c.i // 2 END,
    CASE WHEN mine.n = 1 THEN c.h WHEN c.i % 2 = 1 THEN sha256(beside.h || c.h) ELSE sha256(c.h || coalesce(beside.h, '')) END,
    CASE WHEN mine.n = 1 THEN c.seen ELSE c.seen || coalesce(beside.h, '') END
  FROM climb c JOIN nodes mine ON mine.g = c.g AND mine.lvl = c.lvl AND mine.i = c.i
  LEFT JOIN nodes beside ON beside.g = c.g AND beside.lvl = c.lvl AND beside.i = xor(c.i, 1)
  LEFT JOIN sub ON sub.g = c.g
  WHERE NOT (c.g = '/' AND mine.n = 1))
SELECT p.doc_id, p.leaf, sub.subroot, root.h AS root, sha256(e.seen) AS proof_sha256, e.h AS folded_root, e.h = root.h AS verified
FROM climb e JOIN nodes root ON root.g = '/' AND root.n = 1 AND e.g = '/' AND e.lvl = root.lvl AND e.i = root.i
JOIN placed p USING (r) JOIN sub ON sub.g = p.g
"""
