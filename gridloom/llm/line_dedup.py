"""Line deduplication: hashes dealt by range, sorted by document, read as a stream.

Lines become ``(hash, document, position)`` rows. A range partitioning on (hash, document) with a secondary
sort lets one pass per partition see every run of a hash with its largest document first, so the first
occurrence stays and the later ones go, once the run is known to span enough documents. A frequent line is
simply many rows of one run: the ranges cut it at documents, and runs that reach
over a cut (or over an Arrow batch) are settled from a table of run summaries. The result is a compressed
bitmap of kept lines for each document, never its text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import ascii_lower, materialize, table

WS = " \t\n\x0b\x0c\r"
_DECIDED = "kind int, hi long, lo long, id long, h long, pos int, n long"


def line_rows(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """Rows ``(hi, lo, id, h, pos)`` of lines whose key has ``min_chars`` code points or more; (hi, lo) is a
    128-bit hash of the key and h a hash of the whole text, which tells apart rows that share an id."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.select("id", F.xxhash64("t").alias("h"), F.posexplode(F.split("t", "\n", -1)).alias("pos", "line"))
    rows = rows.select("id", "h", "pos", ascii_lower(F.btrim("line", F.lit(WS))).alias("k")).where(F.char_length("k") >= min_chars)
    return rows.select(F.xxhash64("k").alias("hi"), F.xxhash64(F.lit("second"), "k").alias("lo"), "id", "h", "pos")


def _stream(min_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last_id = None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            hi, lo, h, pos = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("hi", "lo", "h", "pos"))
            ids = batch.column("id")
            null = ids.is_null().to_numpy(zero_copy_only=False)
            doc = ids.fill_null(0).to_numpy(zero_copy_only=False)
            new_run = np.ones(n, bool)
            new_run[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
            new_doc = new_run.copy()
            new_doc[1:] |= (doc[1:] != doc[:-1]) | (null[1:] != null[:-1])
            if last_key == (hi[0], lo[0]) and last_id == (doc[0], null[0]):
                new_doc[0] = False
            last_key, last_id = (hi[-1], lo[-1]), (doc[-1], null[-1])
            starts = np.flatnonzero(new_run)
            run_of = np.cumsum(new_run) - 1
            n_docs = np.add.reduceat(new_doc.astype(np.int64), starts)
            open_run = np.zeros(len(starts), bool)  # may reach over this batch: settled later
            open_run[[0, -1]] = True
            first_doc = (doc == doc[starts][run_of]) & (null == null[starts][run_of])
            gone = ~open_run[run_of] & (n_docs[run_of] >= min_docs) & ~first_doc
            wait = open_run[run_of]
            at = np.flatnonzero(gone | wait)
            summary = starts[np.flatnonzero(open_run)]
            kind = np.concatenate([np.where(gone[at], 0, 2), np.ones(len(summary), int)]).astype(np.int32)
            rows = np.concatenate([at, summary])
            count = np.concatenate([np.zeros(len(at), np.int64), n_docs[run_of[summary]]])
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(kind), pa.array(hi[rows]), pa.array(lo[rows]), ids.take(take), pa.array(h[rows]), pa.array(pos[rows].astype(np.int32)), pa.array(count)],
                names=["kind", "hi", "lo", "id", "h", "pos", "n"])
    return run


def _bitmap(n_lines: int, gone: np.ndarray) -> bytes:
    keep = np.ones(-(-n_lines // 8) * 8, bool)  # whole bytes: the padding keeps
    keep[gone] = False
    return zlib.compress(np.packbits(keep).tobytes(), 6)


def unpack_bitmap(bitmap: bytes, n_lines: int) -> np.ndarray:
    """The kept lines of a document as booleans."""
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[:n_lines].astype(bool)


def line_keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``(id, h, bitmap, n_gone)`` for each document that loses lines; others have no row.

    Keys of ``min_chars`` code points or more that occur in ``min_docs`` different ids or more lose all lines
    except those of the largest id. Null ids count as one document, below all others. Rows with one id and equal text share a bitmap; ``h`` is
    xxhash64 of the text. The bitmap covers lines 0..last line that goes; later lines stay."""
    lines = materialize(line_rows(docs, id_col, text_col, min_chars), "lines")  # read twice: for the bounds of the ranges, and to be dealt
    order = [F.col("hi"), F.col("lo"), F.col("id").desc_nulls_last()]
    dealt = lines.repartitionByRange(*order).sortWithinPartitions(*order, "h", "pos")
    found = materialize(dealt.mapInArrow(_stream(min_docs), _DECIDED), "runs")
    runs = found.where("kind = 1").groupBy("hi", "lo").agg(F.sum("n").alias("docs"), F.max("id").alias("top")).where(F.col("docs") >= min_docs)
    runs = materialize(runs, "open")  # two runs a partition and one a batch at most: its known size lets the planner broadcast it, so that a hot run is not shuffled
    late = found.where("kind = 2").join(runs, ["hi", "lo"]).where(~F.col("id").eqNullSafe(F.col("top"))).select("id", "h", "pos")
    gone = found.where("kind = 0").select("id", "h", "pos").union(late)

    @F.pandas_udf("binary")
    def pack(p):
        return p.map(lambda a: _bitmap(int(a.max()) + 1, a))

    return gone.groupBy("id", "h").agg(F.array_sort(F.collect_set("pos")).alias("p")).select("id", "h", pack("p").alias("bitmap"), F.size("p").cast("long").alias("n_gone"))


def _kept(batches):
    for pdf in batches:
        out = []
        for text, bitmap in zip(pdf.t, pdf.bitmap):
            if bitmap is None:
                out.append(text)
                continue
            lines = text.split("\n")
            keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))
            out.append("\n".join(x for i, x in enumerate(lines) if i >= len(keep) or keep[i]))
        pdf["kept"] = out
        yield pdf[["id", "n_lines", "n_gone", "kept"]]


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """One row per document: ``id, n_lines, n_gone, kept`` (the text that stays).

    Null and empty texts are one empty line. An empty table gives an empty result; other columns of
    ``docs`` play no part, whatever their names."""
    bitmaps = line_keep_bitmaps(docs, id_col, text_col, min_chars, min_docs)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.withColumn("h", F.xxhash64("t"))
    b = bitmaps.select(F.col("id").alias("bid"), F.col("h").alias("bh"), "bitmap", "n_gone").hint("shuffle_hash")
    both = rows.join(b, rows.id.eqNullSafe(F.col("bid")) & (rows.h == F.col("bh")), "left")
    both = both.select("id", "t", "bitmap", F.coalesce("n_gone", F.lit(0)).cast("long").alias("n_gone"),
                       (F.length("t") - F.length(F.replace("t", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"))
    return both.mapInPandas(_kept, "id long, n_lines long, n_gone long, kept string")


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    d = dedup_lines(docs)
    return d.select(F.col("id").alias("doc_id"), "n_lines", F.col("n_gone").alias("n_dropped"), F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


#: DuckDB; the whole-table statement of the same rule.
OP8_SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT doc_id, pos, line,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), hot AS (
  SELECT k, max(doc_id) AS top FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM (SELECT y.doc_id, y.pos, y.line, h.k IS NOT NULL AND y.doc_id <> h.top AS gone FROM keyed y LEFT JOIN hot h ON y.k = h.k)
GROUP BY doc_id
"""
