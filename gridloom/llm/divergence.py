"""Divergence of the sources of each language, from exact term counts.

A term of a language is a token that carries the language before it, so one CountVectorizer with minDF counts documents and fixes vocabularies language by language; vocabSize is the largest integer, so no term is cut off.
It is fitted on the terms of each document, less those that minDF documents of the same task gave before, since these are in the vocabulary by then; that leaves the vocabulary the same and spares the fit most of its pairs of documents and terms.
Its vocabulary lives in the driver and in every task, so tokens are dealt by hash to as many vocabularies as keep each of them within a bound. The sparse vectors of the documents are summed by (language, source):
sparse sums, since only the terms that occur are rows. Pairs of sources are evaluated in tiles, a slice of the terms by two blocks of sources; terms that no source of a tile holds
are not in it and are added at the end, all at once. All numbers are whole.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridloom.llm.common import UPPER, materialize, table

#: Fixed values of the measure.
SEPARATORS = bytes((*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)))
#: For bytes.translate: separators to blanks, A-Z to a-z.
PLAIN = bytes.maketrans(SEPARATORS + UPPER.encode(), b" " * len(SEPARATORS) + UPPER.lower().encode())
SCALE_FACTORS = (31_250, 32_000)  # 10^9
MIN_DOCS = 10
MAX_INT = 2_147_483_647
TOP = 10
#: Kept terms of one vocabulary, at most about.
VOCABULARY = 2_000_000
#: Texts whose terms are made at a time, and bytes, about, that a task remembers of the terms it gave.
ROWS, SEEN = 256, 64_000_000
#: Terms of a slice and sources of a block: what a tile holds.
SLICE, BLOCK = 4096, 64


def _listed(batches: Iterator[pa.RecordBatch], enough: int) -> Iterator[pa.RecordBatch]:
    """``source, terms`` of the rows (lang, source, text as bytes): the terms of a text one to a line, with their language in hex and a tab before them, and before all an empty one.

    With ``enough`` 0 the terms are as they occur. Else each comes once for a text, and no more once ``enough`` texts of the task gave it: whether at least so many documents hold it is decided by then. What the task has seen is forgotten
    when it passes SEEN bytes, after which terms are given again; how many documents are counted for a term changes by that only beyond ``enough``."""
    times, done, held = defaultdict(Counter), defaultdict(set), 0
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            lang, source, text = batch.slice(at, ROWS).columns
            out, given = [], defaultdict(Counter)
            for code, body in zip(lang.to_pylist(), text.to_pylist()):
                words = body.translate(PLAIN).split()
                if enough:
                    words = set(words).difference(done[code])
                    given[code].update(words)
                head = code.hex().encode() + b"\t"
                out.append(head + (b"\n" + head).join([b"", *words]))
            for code, texts in given.items():
                before = times[code]
                before.update(texts)
                often = [w for w in texts if before[w] >= enough]
                done[code].update(often)
                for w in often:
                    del before[w]
            held += sum(len(body) for body in out)
            if held > SEEN:
                times.clear(), done.clear()
                held = 0
            yield pa.RecordBatch.from_arrays([source, pa.array(out, pa.binary())], names=["source", "terms"])


def _terms(docs: DataFrame, enough: int = 0) -> DataFrame:
    """``source, terms``: the terms of each of ``docs`` (lang, source, text) as an array; with ``enough``, only those that tell which terms that many documents hold."""
    rows = docs.select(F.col("lang").cast("binary"), "source", F.col("text").cast("binary")).mapInArrow(partial(_listed, enough=enough), "source string, terms binary")
    return rows.select("source", F.split(F.col("terms").cast("string"), "\n").alias("terms"))


def _vocabularies(docs: DataFrame, min_docs: int, size: int) -> int:
    """How many vocabularies are needed so that each keeps about ``size`` terms at most; 0 if no language has ``min_docs`` documents.

    Of a term's ten or more documents at least two are in a random sixteenth of all documents with a known probability, so the terms found twice there bound the kept ones (with a smaller ``min_docs``, those found once).
    Only the number of passes depends on it, no result."""
    most = docs.groupBy("lang").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    if (most or 0) < min_docs:
        return 0
    share, twice = 1 / 16, min_docs >= 10
    missed = (1 - share) ** min_docs + (min_docs * share * (1 - share) ** (min_docs - 1) if twice else 0)
    found = _terms(docs.where(F.rand(12) < share), max(min_docs, 1)).select(F.explode("terms").alias("t")).groupBy(F.xxhash64("t")).count().where(F.col("count") >= (2 if twice else 1)).count()
    return max(1, math.ceil(found / (1 - missed) / size))


def term_counts(docs: DataFrame, min_docs: int = MIN_DOCS, vocabulary: int = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """Stored tables of the kept terms (``lang, term, id``) and of their counts by source (``lang, source, id, n``), from ``docs`` (lang, source, text).

    A term is kept if at least ``min_docs`` documents of its language hold it. Documents are read, and their terms made, anew for each of the passes: terms are many times larger than texts as rows."""
    spark = docs.sparkSession
    blocks = _vocabularies(docs, min_docs, vocabulary)
    names = counts = None
    for block in range(blocks):
        # the empty term of a language is in every vocabulary, so none is empty
        mine = lambda t: (F.pmod(F.xxhash64(t), F.lit(blocks)) == block) | F.endswith(t, F.lit("\t"))  # noqa: E731, B023
        bags = lambda enough: _terms(docs, enough).select("source", (F.filter("terms", mine) if blocks > 1 else F.col("terms")).alias("terms"))  # noqa: E731, B023
        model = CountVectorizer(inputCol="terms", outputCol="vector", minDF=float(min_docs), vocabSize=MAX_INT).fit(bags(max(min_docs, 1)).select("terms"))
        entry = F.unwrap_udt("vector")
        each = model.transform(bags(0)).select("source", F.explode(F.arrays_zip(entry["indices"].alias("i"), entry["values"].alias("x"))).alias("e"))
        # a term's number tells its language
        summed = each.groupBy(F.col("e.i").alias("i"), "source").agg(F.sum(F.col("e.x").cast("long")).alias("n"))
        number = F.col("i").cast("long") * blocks + block
        listed = spark.createDataFrame(pd.DataFrame({"i": np.arange(len(model.vocabulary), dtype=np.int32), "token": model.vocabulary}), "i int, token string").where(F.contains("token", F.lit("\t")) & ~F.endswith("token", F.lit("\t")))
        lang = F.decode(F.unhex(F.substring_index("token", "\t", 1)), "UTF-8")
        listed = materialize(listed.select(F.substring_index("token", "\t", -1).alias("term"), lang.alias("lang"), number.alias("id")), f"terms{block}")
        summed = materialize(summed.select("source", number.alias("id"), "n").join(listed.select("lang", "id"), "id").select("lang", "source", "id", "n"), f"counts{block}")
        names, counts = (listed, summed) if names is None else (names.unionByName(listed), counts.unionByName(summed))
    if names is None:
        names, counts = spark.createDataFrame([], "term string, lang string, id long"), spark.createDataFrame([], "lang string, source string, id long, n long")
    return names, counts


def share(n, total, kept):
    """p of a term that occurs n times among ``total`` occurrences of ``kept`` terms; 0 where no term is kept. The scale is taken in two factors, so that whole numbers of 64 bits suffice up to 10^14 occurrences; beyond that it is an error."""
    a, b = SCALE_FACTORS
    d, x = f"({total} + 2 * {kept})", f"(({n} + 2L) * {a}L)"
    return F.when(F.expr(f"{kept} > 0"), F.expr(f"({x} div {d}) * {b}L + (({x} % {d}) * {b}L) div {d} + 1")).otherwise(0).cast("long")


def distance(p: str, q: str):
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div greatest({p} + {q}, 1)")


def _tile(key: tuple, pdf: pd.DataFrame, block: int) -> pd.DataFrame:
    """Sums over the terms of one tile for each pair of its sources. Rows without a term (id -1) give each source's p of absent terms."""
    lang, _, a, b = key
    s, t, p = pdf.s.to_numpy(), pdf.id.to_numpy(), pdf.p.to_numpy()
    base, term = t < 0, t >= 0
    source = np.sort(s[base])
    known, col = np.unique(t[term], return_inverse=True)
    value = np.empty((len(source), len(known)), np.int64)
    value[np.searchsorted(source, s[base])] = p[base][:, None]
    value[np.searchsorted(source, s[term]), col] = p[term]
    left, right = np.flatnonzero(source // block == a), np.flatnonzero(source // block == b)
    out = []
    for i in left:
        js = right[right > i]
        if len(js):
            d, m = value[js] - value[i], value[js] + value[i]
            out.append(pd.DataFrame({"lang": lang, "s": source[i], "o": source[js], "f": (d * d // np.maximum(m, 1)).sum(1), "terms": len(known)}))
    return pd.concat(out) if out else pd.DataFrame({"lang": [], "s": [], "o": [], "f": [], "terms": []}).astype({"lang": object})


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP, vocabulary: int = VOCABULARY, slice_terms: int = SLICE,
                      block_sources: int = BLOCK) -> DataFrame:
    """``lang, source, part, item, value, rank``: for every source of a language its divergence from each other source (part ``pair``) and its ``top`` terms that most exceed the language (part ``term``).

    Null texts, languages and sources count as empty. A group without terms, a language without kept terms (all values 0) and a language with one source (no pair) have what follows from that; an empty table gives no row.
    Ties of value are ranked by the item's bytes. Repeated rows count as often as they occur; texts of any length are read whole; other columns play no part. The vocabularies (of about
    ``vocabulary`` terms each at most) are all that the driver holds."""
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    names, counts = term_counts(docs, min_docs, vocabulary)
    kept = names.groupBy(F.col("lang").alias("kl")).agg(F.count("*").alias("v"))
    summed = counts.groupBy(F.col("lang").alias("cl"), F.col("source").alias("cs")).agg(F.sum("n").alias("total"))
    groups = docs.select("lang", "source").distinct()
    groups = groups.join(summed, (F.col("lang") == F.col("cl")) & (F.col("source") == F.col("cs")), "left").join(kept, F.col("lang") == F.col("kl"), "left")
    groups = groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v"))
    by_lang = W.partitionBy("lang")  # a row for each source of a language
    groups = groups.withColumns({"s": F.row_number().over(by_lang.orderBy("source")) - 1, "sources": F.count("*").over(by_lang), "every": F.sum("total").over(by_lang)})
    groups = materialize(groups.withColumn("p0", share("0", "total", "v")), "groups")
    g = groups.withColumnsRenamed({"lang": "gl", "source": "gs"})
    counted = counts.join(g, (F.col("lang") == F.col("gl")) & (F.col("source") == F.col("gs"))).withColumn("p", share("n", "total", "v"))
    slices = F.greatest(F.lit(1), F.ceil(F.col("v") / slice_terms)).cast("long")

    rows = counted.select("lang", "s", "sources", "id", "p", F.pmod("id", slices).alias("slice"))
    absent = groups.select("lang", "s", "sources", F.lit(-1).cast("long").alias("id"), F.col("p0").alias("p"), F.explode(F.sequence(F.lit(0).cast("long"), slices - 1)).alias("slice"))
    block, blocks = F.expr(f"s div {block_sources}"), F.expr(f"(sources + {block_sources - 1}) div {block_sources}")
    tiles = rows.unionByName(absent).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))).select(
        "lang", "slice", F.least(block, F.col("other")).alias("a"), F.greatest(block, F.col("other")).alias("b"), "s", "id", "p")
    sums = tiles.groupBy("lang", "slice", "a", "b").applyInPandas(lambda key, pdf: _tile(key, pdf, block_sources), "lang string, s int, o int, f long, terms long").groupBy("lang", "s", "o").agg(F.sum("f").alias("f"), F.sum("terms").alias("terms"))
    side = lambda n: groups.select(F.col("lang").alias(f"l{n}"), F.col("s").alias(f"s{n}"), F.col("source").alias(f"source{n}"), F.col("p0").alias(f"p{n}"), F.col("v").alias(f"v{n}"))
    pairs = sums.join(side(1), (F.col("lang") == F.col("l1")) & (F.col("s") == F.col("s1"))).join(side(2), (F.col("lang") == F.col("l2")) & (F.col("o") == F.col("s2")))
    value = F.col("f") + (F.col("v1") - F.col("terms")) * distance("p1", "p2")
    ends = [F.struct(F.col(f"source{i}").alias("source"), F.col(f"source{j}").alias("item")) for i, j in ((1, 2), (2, 1))]
    pairs = pairs.select("lang", value.alias("value"), F.explode(F.array(*ends)).alias("e")).select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value")

    whole = counts.groupBy(F.col("lang").alias("wl"), F.col("id").alias("wi")).agg(F.sum("n").alias("wn"))
    met = counted.join(whole, (F.col("lang") == F.col("wl")) & (F.col("id") == F.col("wi"))).withColumn("q", share("wn", "every", "v")).where("p > q").withColumn("value", distance("p", "q"))
    met = met.join(names.select(F.col("id").alias("ni"), "term"), F.col("id") == F.col("ni")).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    order = W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    found = pairs.withColumn("rank", F.row_number().over(order)).unionByName(met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top))
    return found.select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), "rank")


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
word AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM word GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
cnt AS (SELECT lang, source, term, count(*) AS n FROM word JOIN kept USING (lang, term) GROUP BY ALL),
grp AS (SELECT DISTINCT lang, source FROM d),
size AS (SELECT lang, source, coalesce((SELECT sum(n) FROM cnt c WHERE c.lang = grp.lang AND c.source = grp.source), 0)::HUGEINT AS total,
    (SELECT count(*) FROM kept k WHERE k.lang = grp.lang)::HUGEINT AS v FROM grp),
p AS (SELECT size.lang, size.source, k.term, coalesce(c.n, 0) AS n, (1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (total + 2 * v))::BIGINT AS p
    FROM size JOIN kept k ON k.lang = size.lang LEFT JOIN cnt c ON c.lang = size.lang AND c.source = size.source AND c.term = k.term),
whole AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM cnt GROUP BY ALL),
lsize AS (SELECT lang, sum(n)::HUGEINT AS total, count(*)::HUGEINT AS v FROM whole GROUP BY lang),
q AS (SELECT lang, term, (1 + 1000000000::HUGEINT * (n + 2) // (total + 2 * v))::BIGINT AS q FROM whole JOIN lsize USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce((SELECT sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) FROM p x JOIN p y ON x.term = y.term AND x.lang = y.lang
      WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
    FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source),
terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p > q),
ranked AS (SELECT 'pair' AS part, *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL SELECT 'term', *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
