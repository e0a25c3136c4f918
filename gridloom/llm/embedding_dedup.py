"""Embedding near-duplicates over a robust-pruned flat graph.

Equal vectors of a label are one class. The classes of a label are dealt to overlapping shards, those of their nearest centroids. Each shard builds a graph by
insertion: batches of vectors search the graph so far from its medoid, what they meet becomes their candidates, and an edge list is pruned
so that an edge stays only if no shorter kept edge leads there as well. The lists of a class from all its shards are united. Every class then searches its shards:
greedily from the medoid, and from what that and its own vertex reach over the edges as long as they stay within range. The components of the
links found are verified by exact cosines in double precision, which also count the links. An audit compares a sample with brute force and widens the overlap if
links are missing. A shard that is too large (one dense group, say) is dealt to parts; each part has a graph, and the other parts search it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow.compute import field as pc_field
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import connected_components, materialize, runs, table

#: Classes of an average shard, and of the largest part of a shard.
TARGET, PART = 1200, 2048
#: Bound of what the driver holds: about so many centroids over all labels, and sampled vectors for each.
CENTROIDS, SAMPLES = 2048, 4
#: Edges of a vertex; factor of the pruning in the two rounds of insertion; width of the search during insertion and afterwards.
DEGREE, ALPHAS, BUILD_BEAM, BEAM = 22, (1.0, 1.2), 26, 12
BATCH, MAX_STEPS = 512, 120
#: Queries of the audit at first and at most, those with links that it needs, the mean recall it asks for, and the widest overlap.
AUDIT, AUDIT_MOST, AUDIT_LINKED, RECALL, WIDEST = 256, 4096, 32, 0.97, 24


def _unit(rows) -> np.ndarray:
    x = np.array(list(rows), np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # no overflow in the norm
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def k_means(x: np.ndarray, k: int, rounds: int = 5) -> np.ndarray:
    c = x[:k].copy()
    for _ in range(rounds):
        own = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        norm = np.sqrt((total * total).sum(1, keepdims=True))
        c = np.where(norm > 0, total / np.maximum(norm, 1e-30), c)
    return c


def greedy(f: np.ndarray, graph: np.ndarray, start: int, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The best ``beam`` vertices that each query meets on a best-first walk from ``start``, and their scores; -1 where there is none."""
    n = len(q)
    ids, score, todo = np.full((n, beam), -1), np.full((n, beam), -4.0, np.float32), np.zeros((n, beam), bool)
    ids[:, 0], score[:, 0], todo[:, 0] = start, q @ f[start], True
    for _ in range(MAX_STEPS):
        rows = np.flatnonzero(todo.any(1))
        if not len(rows):
            break
        k = np.where(todo[rows], score[rows], -9).argmax(1)
        todo[rows, k] = False
        near, own = graph[ids[rows, k]], ids[rows]
        s = np.matmul(f[near], q[rows][:, :, None])[..., 0]
        s[(near < 0) | (near[:, :, None] == own[:, None, :]).any(2)] = -4  # what a beam has dropped is worse than all it holds, so it never returns
        every = np.concatenate([score[rows], s], 1)
        best = np.argpartition(-every, beam - 1, axis=1)[:, :beam]
        ids[rows] = np.take_along_axis(np.concatenate([own, near], 1), best, 1)
        score[rows] = np.take_along_axis(every, best, 1)
        todo[rows] = np.take_along_axis(np.concatenate([todo[rows], s > -4], 1), best, 1)
    return np.where(score > -4, ids, -1), score


def prune(f: np.ndarray, cand: np.ndarray, s: np.ndarray, alpha: float) -> np.ndarray:
    """(k, DEGREE) of the candidates (k, m; -1: none) with scores s: nearest first, without those that a kept one is nearer to by ``alpha``."""
    order = np.argsort(-s, axis=1, kind="stable")
    cand, s = np.take_along_axis(cand, order, 1), np.take_along_axis(s, order, 1)
    far, alive, at = np.sqrt(np.maximum(0, 2 - 2 * s)), cand >= 0, np.arange(len(cand))
    vec, out = f[cand], np.full((len(cand), DEGREE), -1, np.int64)
    for k in range(DEGREE):
        pick = alive.argmax(1)
        has = alive[at, pick]
        if not has.any():
            break
        out[has, k] = cand[at, pick][has]
        between = np.sqrt(np.maximum(0, 2 - 2 * np.matmul(vec, vec[at, pick][:, :, None])[..., 0]))
        alive &= alpha * between > far
        alive[at, pick] = False
    return out


def medoid(x: np.ndarray) -> int:
    return int((x @ x.mean(0)).argmax())


def build_graph(x: np.ndarray, seed: int) -> np.ndarray:
    """(n, DEGREE) neighbours of unit vectors, -1 where there is none. Batches double until BATCH; in the second round all vectors are inserted again, so those of one batch meet."""
    n, f, start = len(x), x.astype(np.float32), medoid(x)
    graph = np.full((n, DEGREE), -1, np.int64)
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[start], order[order != start]])
    for alpha in ALPHAS:
        done = 1 if alpha == ALPHAS[0] else 0
        while done < n:
            batch = order[done : done + (min(done, BATCH) if alpha == ALPHAS[0] else BATCH)]
            cand, s = greedy(f, graph, start, f[batch], BUILD_BEAM)
            cand = np.concatenate([cand, graph[batch]], 1)
            old = cand[:, BUILD_BEAM:]
            s = np.concatenate([s, np.where(old >= 0, np.matmul(f[old], f[batch][:, :, None])[..., 0], -4)], 1)
            twice = (old[:, :, None] == cand[:, None, :BUILD_BEAM]).any(2)
            cand[:, BUILD_BEAM:][twice] = -1
            cand[cand == batch[:, None]] = -1
            graph[batch] = prune(f, cand, np.where(cand >= 0, s, -4), alpha)
            # the way back: a vertex that gains edges keeps the best of its own and the new ones
            to, frm = graph[batch].ravel(), np.repeat(batch, DEGREE)
            frm, to = frm[to >= 0], to[to >= 0]
            score = np.einsum("kd,kd->k", f[frm], f[to])
            by = np.lexsort((-score, to))
            to, frm = to[by], frm[by]
            v, first = np.unique(to, return_index=True)
            rank = np.arange(len(to)) - np.repeat(first, np.diff(np.concatenate([first, [len(to)]])))
            into = np.full((len(v), DEGREE), -1, np.int64)
            few = rank < DEGREE
            into[np.searchsorted(v, to[few]), rank[few]] = frm[few]
            into[(into[:, :, None] == graph[v][:, None, :]).any(2)] = -1
            for i in range(0, len(v), BATCH):
                w = v[i : i + BATCH]
                both = np.concatenate([graph[w], into[i : i + BATCH]], 1)
                graph[w] = prune(f, both, np.where(both >= 0, np.matmul(f[both], f[w][:, :, None])[..., 0], -4), alpha)
            done += len(batch)
    return graph


def search(x: np.ndarray, graph: np.ndarray, y: np.ndarray, min_cos: float, own: bool) -> np.ndarray:
    """(queries y, vertices x) booleans: what each query finds within range. ``own``: the queries are the vertices, and start from themselves too."""
    n, f, g, start = len(x), x.astype(np.float32), y.astype(np.float32), medoid(x)
    beams = np.concatenate([greedy(f, graph, start, g[i : i + BATCH], BEAM)[0] for i in range(0, len(y), BATCH)])
    seen, found = np.zeros((len(y), n), bool), np.zeros((len(y), n), bool)
    q, v = np.repeat(np.arange(len(y)), BEAM), beams.ravel()
    if own:
        q, v = np.concatenate([q, np.arange(n)]), np.concatenate([v, np.arange(n)])
    key = np.unique(q[v >= 0] * n + v[v >= 0])
    while len(key):
        q, v = key // n, key % n
        seen[q, v] = True
        hit = np.concatenate([np.einsum("kd,kd->k", y[q[i : i + 65536]], x[v[i : i + 65536]]) >= min_cos for i in range(0, len(q), 65536)])
        if own:
            hit |= q == v
        q, v = q[hit], v[hit]
        found[q, v] = True
        parts = [np.zeros(0, np.int64)]
        for i in range(0, len(q), 100_000):
            w, o = graph[v[i : i + 100_000]].ravel(), np.repeat(q[i : i + 100_000], graph.shape[1])
            ok = w >= 0
            ok[ok] = ~seen[o[ok], w[ok]]
            parts.append(np.unique(o[ok] * n + w[ok]))
        key = np.unique(np.concatenate(parts))
    return found


def _least_linked(found: np.ndarray) -> np.ndarray:
    """The least index that each vertex reaches."""
    lab = np.arange(len(found), dtype=np.int32)
    while True:
        new = lab.copy()
        for lo in range(0, len(found), 512):
            part = found[lo : lo + 512]
            new[lo : lo + 512] = np.minimum(new[lo : lo + 512], np.where(part, lab, np.int32(2**31 - 1)).min(1))
        new = new[new]
        if (new == lab).all():
            return lab
        lab = new


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("cid")
    cid = pdf.cid.to_numpy()
    g = build_graph(_unit(pdf.vec), int(pdf.shard.iloc[0]) + 1)
    return pd.DataFrame({"cid": cid, "near": [cid[r[r >= 0]] for r in g]})


def _graph_of(cid: np.ndarray, near: list) -> np.ndarray:
    """The united edge lists of sorted classes, as far as they lead to each other."""
    size = np.array([len(v) for v in near])
    flat = np.concatenate(near).astype(np.int64)
    at = np.minimum(np.searchsorted(cid, flat), len(cid) - 1)
    graph = np.full((len(cid), max(1, size.max())), -1, np.int64)
    graph[np.repeat(np.arange(len(cid)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = np.where(cid[at] == flat, at, -1)
    return graph


def _searcher(min_cos: float, exact: bool):
    """The links (class, least class that it reaches) of a part, or between two parts of a shard."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = [p.sort_values("cid") for _, p in pdf.groupby("part")]
        x, cid = [_unit(p.vec) for p in sides], [p.cid.to_numpy() for p in sides]
        if exact:
            found = [x[0] @ x[-1].T >= min_cos]
        else:
            graph = [_graph_of(c, list(p.near)) for c, p in zip(cid, sides)]
            found = [search(x[0], graph[0], x[-1], min_cos, len(x) == 1).T]
            if len(x) > 1:
                found.append(search(x[1], graph[1], x[0], min_cos, False))
        n, ids = len(cid[0]), np.concatenate(cid)
        linked = np.zeros((len(ids), len(ids)), bool)
        for m in found:
            if len(x) == 1:
                linked |= m | m.T
            else:
                linked[:n, n:] |= m
        linked |= linked.T
        np.fill_diagonal(linked, False)
        low = _least_linked(linked)
        at = np.flatnonzero(low != np.arange(len(ids)))
        return pd.DataFrame({"a": ids[at], "b": ids[low[at]]})
    return run


def _vector_classes(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """Valid rows (id, label, vec, h), and their classes (cid, label, vec, h, size, low) with a stable number."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    fine = F.forall("vec", lambda x: F.coalesce((x == x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))) & F.exists("vec", lambda x: x != 0)
    v = v.withColumn("ok", F.coalesce(F.col("label").isNotNull() & fine, F.lit(False)))
    v = v.withColumn("vec", F.when(F.col("ok"), F.transform("vec", lambda x: x + F.lit(0.0)))).withColumn("h", F.xxhash64("vec"))
    classes = v.where("ok").groupBy("label", "h", "vec").agg(F.count("*").alias("size"), F.min("id").alias("low"))
    return v, materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")


def _centroids(classes: DataFrame, overlap: int) -> dict:
    """Centroids of each label with more classes than fit one shard: about CENTROIDS of all labels, from SAMPLES vectors for each. Labels beyond that bound stay one shard, dealt to parts."""
    count = classes.groupBy("label", F.size("vec").alias("dim")).count().where(F.col("count") > TARGET)
    by = count.orderBy(F.desc("count"), "label", "dim").limit(CENTROIDS // 2).collect()
    want = {(r.label, r.dim): -(-overlap * r["count"] // TARGET) for r in by}
    scale = min(1.0, CENTROIDS / max(1, sum(want.values())))
    want = {k: max(2, int(n * scale)) for k, n in want.items()}
    if not by:
        return {}
    rates = classes.sparkSession.createDataFrame([(r.label, r.dim, min(1.0, SAMPLES * want[r.label, r.dim] / r["count"])) for r in by], "l2 string, dim int, rate double")
    uniform = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), "cid"), 11) / F.lit(float(1 << 53))
    some = classes.join(rates, (F.col("label") == F.col("l2")) & (F.size("vec") == F.col("dim"))).where(uniform < F.col("rate")).select("label", "dim", "cid", "vec").toArrow()
    out = {}
    for (label, dim), k in want.items():
        mine = some.filter((pc_field("label") == label) & (pc_field("dim") == dim)).sort_by("cid")
        if len(mine):
            x = _unit(mine.column("vec").combine_chunks().flatten().to_numpy().reshape(-1, dim))
            out[label, dim] = k_means(x, min(k, len(x))).astype(np.float32)
    return out


def _links(classes: DataFrame, overlap: int, min_cos: float, exact: bool = False) -> DataFrame:
    """Links of classes found in their shards; ``exact``: all pairs of a label, in tiles."""
    shared = classes.sparkSession.sparkContext.broadcast({} if exact else _centroids(classes, overlap))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            shards = [[0]] * len(pdf)
            for key, at in pdf.groupby(["label", pdf.vec.map(len)]).indices.items():
                c = shared.value.get(key)
                if c is not None:
                    s = -(_unit(pdf.vec.iloc[at]).astype(np.float32) @ c.T)
                    for i, b in zip(at, np.argpartition(s, min(overlap, len(c)) - 1, axis=1)[:, :overlap]):
                        shards[i] = sorted(b.tolist())
            yield pdf.assign(shards=shards)

    dealt = classes.select("cid", "label", "vec").mapInPandas(assign, "cid long, label string, vec array<double>, shards array<int>")
    dealt = materialize(dealt.withColumn("dim", F.size("vec")), "dealt")
    key = ["label", "dim", "shard"]
    count = dealt.select("label", "dim", F.explode("shards").alias("shard")).groupBy(*key).agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    each = dealt.withColumn("shard", F.explode("shards")).drop("shards").join(count, key).withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    if exact:
        each = each.withColumn("near", F.lit(None).cast("array<long>"))
    else:
        near = each.select("cid", "vec", *key, "part").groupBy(*key, "part").applyInPandas(_build, "cid long, near array<long>")
        each = each.join(near.groupBy("cid").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "cid")  # one list per shard of a class
    met = each.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("i", F.least("part", "o")).withColumn("j", F.greatest("part", "o"))
    return materialize(met.select("cid", "vec", "near", *key, "part", "i", "j").groupBy(*key, "i", "j").applyInPandas(_searcher(min_cos, exact), "a long, b long").distinct(), "links")


def _verified(classes: DataFrame, links: DataFrame, min_cos: float) -> DataFrame:
    """``cid, component, n``: the classes of components of two or more, and their exact numbers of linked rows of other classes."""
    comp = connected_components(links).withColumnRenamed("node", "cid")
    size = comp.groupBy("component").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    rows = classes.select("cid", "vec", "size").join(comp, "cid").join(size, "component").withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("i", F.least("part", "o")).withColumn("j", F.greatest("part", "o"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in runs(batches, ["component", "i", "j"]):
            x, size, part = _unit(pdf.vec), pdf["size"].to_numpy(), pdf.part.to_numpy()
            n = np.empty(len(pdf), np.int64)
            for k in range(0, len(pdf), 512):
                hit = x[k : k + 512] @ x.T >= min_cos
                hit[np.arange(len(hit)), np.arange(k, k + len(hit))] = False
                if pdf.i.iloc[0] != pdf.j.iloc[0]:
                    hit &= part[k : k + 512, None] != part
                n[k : k + 512] = hit @ size
            yield pd.DataFrame({"cid": pdf.cid, "component": pdf.component, "n": n})

    dealt = rows.select("component", "i", "j", "part", "cid", "vec", "size").repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    counted = dealt.mapInPandas(count, "cid long, component long, n long").groupBy("cid", "component").agg(F.sum("n").alias("n"))
    return materialize(counted, "verified")


def audit(classes: DataFrame, verified: DataFrame, min_cos: float) -> tuple[float, int]:
    """Mean share of its links that a class with links has been given, over a sample against brute force, and the number of such classes. The sample grows until it holds AUDIT_LINKED of them."""
    size = AUDIT
    while True:
        q = classes.orderBy(F.xxhash64(F.lit("audit"), "cid")).limit(size).select("cid", "label", "vec").collect()
        by: dict = {}
        for r in q:
            by.setdefault((r.label, len(r.vec)), []).append(r)
        shared = classes.sparkSession.sparkContext.broadcast({k: (np.array([r.cid for r in v]), _unit([r.vec for r in v])) for k, v in by.items()})

        def brute(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for key, at in pdf.groupby(["label", pdf.vec.map(len)]).indices.items():
                    if key in shared.value:
                        ids, x = shared.value[key]
                        hit = (_unit(pdf.vec.iloc[at]) @ x.T >= min_cos) & (pdf.cid.to_numpy()[at][:, None] != ids)
                        n = pdf["size"].to_numpy()[at] @ hit
                        yield pd.DataFrame({"cid": ids[n > 0], "n": n[n > 0]})

        true = {r.cid: r.n for r in classes.select("cid", "label", "vec", "size").mapInPandas(brute, "cid long, n long").groupBy("cid").agg(F.sum("n").alias("n")).collect()}
        if len(true) >= AUDIT_LINKED or len(q) < size or size >= AUDIT_MOST:
            break
        size *= 4
    found = {r.cid: r.n for r in verified.where(F.col("cid").isin(list(true))).collect()} if true else {}
    return (sum(found.get(c, 0) / n for c, n in true.items()) / len(true) if true else 1.0), len(true)


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", min_cos: float = 0.98, overlap: int = 3, report: dict | None = None) -> DataFrame:
    """``id, n_links, component_id, kept`` per row of ``vectors``.

    Rows link if their labels are equal and not null, their vectors have one length and a cosine of ``min_cos`` or more. Vectors that are null, empty, zero, or hold null or non-finite numbers link with
    nothing. Repeated rows are rows of their own and link. Null ids count as links of others; component_id is the least id that is not null. Other columns play no part; an empty table gives an
    empty result. The overlap doubles until the audited recall of the graph reaches RECALL; if it does not at WIDEST, all pairs of a label are compared. ``report`` is given the ``recall`` of the last
    audit, the classes with links that it saw (``audited``) and the ``overlap`` (None: all pairs)."""
    rows, classes = _vector_classes(vectors, id_col, vec_col, label_col)
    while True:
        verified = _verified(classes, _links(classes, overlap, min_cos), min_cos)
        recall, seen = audit(classes, verified, min_cos)
        if recall >= RECALL or overlap >= WIDEST:
            break
        overlap *= 2
    if recall < RECALL:
        verified, recall, overlap = _verified(classes, _links(classes, 1, min_cos, exact=True), min_cos), 1.0, None
    if report is not None:
        report |= {"recall": recall, "audited": seen, "overlap": overlap}
    c = classes.join(verified, "cid", "left")
    c = materialize(c.select("label", "h", "vec", "size", "low", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("component", "cid").alias("component")), "joined")
    low = c.groupBy("component").agg(F.min("low").alias("component_id"))
    c = c.join(low, "component").select(F.col("label").alias("l2"), F.col("h").alias("h2"), F.col("vec").alias("v2"), (F.col("size") - 1 + F.col("n")).alias("links"), "component_id")
    linked = rows.where("ok").join(c, (F.col("label") == F.col("l2")) & (F.col("h") == F.col("h2")) & (F.col("vec") == F.col("v2"))).select("id", F.col("links").alias("n_links"), "component_id")
    alone = rows.where("not ok").select("id", F.lit(0).cast("long"), "id")
    out = linked.union(alone)
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))


def op7_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


#: DuckDB; every pair of a label.
OP7_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL
), p AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT x, y FROM p UNION SELECT r.x, p.y FROM reach r JOIN p ON r.y = p.x
), least AS (SELECT x, min(y) AS m FROM reach GROUP BY x)
SELECT e.vec_id, coalesce(n, 0) AS n_links, least(e.vec_id, coalesce(m, e.vec_id)) AS component_id, e.vec_id <= coalesce(m, e.vec_id) AS kept
FROM embeddings e LEFT JOIN (SELECT x, count(*) AS n FROM p GROUP BY x) c ON c.x = e.vec_id LEFT JOIN least ON least.x = e.vec_id
"""
