"""Benchmark decontamination: one Aho-Corasick automaton over normalised test texts.

Test items become windows of words, and each word two symbols; the automaton holds all windows as sequences of symbols and reads each document once. A match is
word-aligned by nature, and the word numbers of its end are mapped back, for spans, to offsets of the original text.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import ascii_lower, materialize, table

#: Bytes of UTF-8 to word bytes (lower-cased) or spaces: digits, letters and all of 0x80 and above are word bytes.
_WORD_BYTES = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")
_WORD_PATTERN = r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"
#: Words of the items of one automaton (about 0.8 kB each in a worker); more items are read in further passes over the documents. Long items are cut into overlapping segments.
BLOCK_WORDS, SEGMENT = 200_000, 20_000


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_WORD_BYTES).split() if text else []


class _Symbols(dict):
    """Two characters for each word of the items, those of the first and of the second place from different ranges, so that a match never begins inside a word. A vertex of the automaton looks through its
    edges one by one, and with two places of about the square root of the words none has many. All other words have one sign."""

    def __missing__(self, word: bytes) -> str:
        return "\0\0"

    @classmethod
    def of(cls, known: dict[bytes, int]) -> _Symbols:
        base = math.isqrt(len(known)) + 1
        return cls((w, chr(1 + n // base) + chr(0x4000 + n % base)) for w, n in known.items())


class Windows:
    """The windows of a block of items: symbols of its words, and the automaton (None without windows)."""

    def __init__(self, items: list[tuple[int | None, str | None]], width: int):
        split = [(i, words(text)) for i, text in items]
        number: dict[bytes, int] = {}
        for _, w in split:
            for x in w:
                number.setdefault(x, len(number))
        self.symbols = _Symbols.of(number)
        found: dict[str, list] = {}
        for item_id, w in split:
            n, text = min(width, len(w)), self.coded(w)
            for i in range(len(w) - n + 1 if n else 0):
                ids = found.setdefault(text[2 * i : 2 * (i + n)], [])
                if item_id not in ids[-1:]:
                    ids.append(item_id)
        self.auto = None
        if found:
            self.auto = ahocorasick.Automaton()
            for key, ids in found.items():
                self.auto.add_word(key, (len(key) // 2, ids))
            self.auto.make_automaton()

    def coded(self, w: list[bytes]) -> str:
        return "".join(map(self.symbols.__getitem__, w))

    def scan(self, text: str) -> tuple[int, np.ndarray, set]:
        """Number of words, their hit flags (empty if none is hit) and the items that occur."""
        w = words(text)
        found = list(self.auto.iter(self.coded(w))) if w and self.auto is not None else []
        if not found:
            return len(w), np.zeros(0, bool), set()
        edge = np.zeros(len(w) + 1, np.int32)
        items: set = set()
        for at, (n, ids) in found:
            edge[at // 2 - n + 1] += 1
            edge[at // 2 + 1] -= 1
            items.update(ids)
        return len(w), np.cumsum(edge[:-1]) > 0, items


_built: dict[str, Windows] = {}


def _windows_of(key: str, items: list, width: int) -> Windows:
    """The block's automaton, built once per worker; a worker holds one at a time."""
    if key not in _built:
        _built.clear()
        _built[key] = Windows(items, width)
    return _built[key]


def _runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def _offsets(text: str, first: np.ndarray, end: np.ndarray) -> tuple[list[int], list[int]]:
    """Code point offsets of the word runs [first, end)."""
    data = text.encode()
    at = [m.span() for m in _WORD.finditer(data.translate(_WORD_BYTES))]
    points = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    start = [int(points[at[a][0]]) - 1 for a in first]
    return start, [int(points[at[b - 1][1] - 1]) for b in end]


_RUNS = "n_words long, hit_from array<int>, hit_to array<int>, items array<long>"


def _scanner(key: str, shared, width: int, with_text: bool):
    """Adds one automaton's hits to those found so far; the text goes on only if it is asked for."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        windows = _windows_of(key, shared.value, width)
        for pdf in batches:
            rows = []
            for text, was_from, was_to, was in pdf[["t", "hit_from", "hit_to", "items"]].itertuples(index=False):
                n, hit, items = windows.scan(text or "")
                if len(hit) and len(was_from):
                    for a, b in zip(was_from, was_to):
                        hit[a:b] = True
                a, b = _runs(hit) if len(hit) else (was_from, was_to)
                rows.append((n, list(a), list(b), sorted({x for x in items if x is not None} | set(was))))
            out = pd.DataFrame(rows, columns=["n_words", "hit_from", "hit_to", "items"])
            yield pd.concat([pdf[["id", "h", "t"] if with_text else ["id", "h"]].astype({"id": "Int64"}), out], axis=1)
    return run


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", width: int = 10, block_words: int = BLOCK_WORDS, with_text: bool = False, segment: int = SEGMENT) -> DataFrame:
    """Per document: ``id, h`` (xxhash64 of the text), ``n_words, hit_from, hit_to`` (runs of hit words, end exclusive) and ``items``
    (sorted distinct ids of the items with an occurring window); ``t``, the text, if asked for.

    Every row is kept, repeated rows and null ids too. Null and empty texts have no word and no hit; very long texts are read in whole. Items of fewer than ``width`` words are one
    window; items without words match nothing; repeated items count once; an item with a null id hits words but is not listed. Empty tables give no row or no hit. Only the
    named columns are read. The size of the test set is checked: an automaton takes about ``block_words`` words of it, and a larger set is read as several blocks, each passing over all
    documents. The driver holds one block of items at a time."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.regexp_extract_all(ascii_lower(F.coalesce(F.col(item_text_col), F.lit(""))), F.lit(_WORD_PATTERN)).alias("w"))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - width), F.lit(segment))
    items = items.select("i", "w", F.explode(starts).alias("s")).select("i", F.slice("w", F.col("s") + 1, F.lit(segment + width - 1)).alias("w")).where(F.size("w") > 0)
    items = items.select("i", F.size("w").alias("n"), F.array_join("w", " ").alias("t")).distinct()
    total = items.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_words))
    none = F.array().cast("array<int>")
    state = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("t"), F.lit(0).cast("long").alias("n_words"),
                        none.alias("hit_from"), none.alias("hit_to"), F.array().cast("array<long>").alias("items"))
    for b in range(blocks):
        mine = [(r.i, r.t) for r in items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).select("i", "t").toLocalIterator()]
        text = with_text or b + 1 < blocks
        state = state.mapInPandas(_scanner(uuid.uuid4().hex, spark.sparkContext.broadcast(mine), width, text), f"id long, h long, {'t string, ' if text else ''}{_RUNS}")
        if b + 1 < blocks:
            state = materialize(state, "scanned")
    return state


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """``id, start, end, text``: the passages of each document that test items cover, as code point offsets of the
    original text, end exclusive. Odd rows as in :func:`contamination`."""
    def cut(batches):
        for pdf in batches:
            rows = []
            for i, text, a, b in zip(pdf.id, pdf.t, pdf.hit_from, pdf.hit_to):
                for s, e in zip(*_offsets(text, a, b)):
                    rows.append((i, s, e, text[s:e]))
            yield pd.DataFrame(rows, columns=["id", "start", "end", "text"]).astype({"id": "Int64"})

    hit = contamination(docs, benchmark, with_text=True, **params).where(F.size("hit_from") > 0)
    return hit.select("id", "t", "hit_from", "hit_to").mapInPandas(cut, "id long, start int, end int, text string")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """``docs`` without the rows that hold a window of a test item. All columns of the others are kept, null texts too. Odd rows as in :func:`contamination`."""
    hit = contamination(docs, benchmark, id_col, text_col, **params).where(F.size("hit_from") > 0)
    hit = materialize(hit.select(F.col("id").alias("_i"), F.col("h").alias("_h")).distinct(), "hit")
    match = docs[id_col].cast("long").eqNullSafe(hit["_i"]) & (F.xxhash64(docs[text_col]) == hit["_h"])
    return docs.join(hit, match, "left_anti")


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hits = F.aggregate(F.zip_with("hit_from", "hit_to", lambda a, b: b - a), F.lit(0), lambda x, y: x + y).cast("long")
    named = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(F.col("id").alias("doc_id"), "n_words", hits.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.encode(named, "UTF-8"), 256).alias("items_sha256"), (hits > 0).alias("contaminated"))


OP3_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), iw AS (
  SELECT item_id, w, least(10, len(w)) AS n FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark)
  WHERE len(w) > 0
), win AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM iw)
), dwin AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)
), hit AS (SELECT d.doc_id, d.i, d.n, x.item_id FROM dwin d JOIN win x ON d.n = x.n AND d.k = x.k),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words ON dw.doc_id = words.doc_id LEFT JOIN items ON dw.doc_id = items.doc_id
"""
