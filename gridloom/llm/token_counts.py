"""Exact token counts of all prefixes by dynamic programming.

A text is cut into pieces as its tokenizer does. Inside a piece, a table holds for each prefix the number of its tokens and its last token: the last token of
an encoding is the one suffix that is a token and forms a valid pair with the last token of the rest, so a prefix costs a few look-ups and nothing is
encoded again. Running sums over the pieces give one table with the exact count of every prefix of the original text, in code points; the count of the text is
its last entry, and the longest prefix within a budget is read off it. Tables of pieces are cached per worker. Long texts are read in stretches.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import table

#: Entries of a worker's caches and code points of a cached piece; a full cache is emptied, so its size is bounded and results do not change.
CACHE, CACHED_CHARS = 400_000, 64
#: Code points of a stretch of a text, of a shorter one near the budget, and of a word whose inner prefixes are counted one by one (see :meth:`PrefixCounter._odd_word`).
STRETCH, NEAR, ODD_WORD = 1 << 13, 256, 512


def _byte_symbols() -> list[str]:
    """Byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for code points from 256 on."""
    shown = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class _Made(dict):
    """What ``make`` gives for a piece, made when first asked for."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, piece: str):
        if len(self) >= CACHE:
            self.clear()
        found = self.make(piece)
        if len(piece) <= CACHED_CHARS:
            self[piece] = found
        return found


class PrefixCounter:
    """Token counts of a BPE tokenizer file whose pieces end in a word-end symbol."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.rank = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(model["merges"])}
        self.longest = max(map(len, self.vocab))
        steps = spec["pre_tokenizer"]["pretokenizers"]
        self.piece = regex.compile(steps[0]["pattern"]["Regex"])
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.mark = os.path.commonprefix(special)  # no special token where this is not found
        self.tail = regex.compile(r"[^\s\p{L}\p{N}]*\Z")
        self.symbols = dict(enumerate(_byte_symbols()))
        self._pair: dict[int, bool] = {}
        self._seen: dict[str, tuple[int, str]] = {}
        self.counts, self.tables = _Made(self.piece_count), _Made(self.inner_counts)
        made = {}
        for (l, r), n in self.rank.items():
            made.setdefault(l + r, (l, r, n))
        self._made = made
        self._own: dict[str, bool] = {}
        self._edges: tuple[dict, dict] = ({}, {})

    def normal(self, text: str) -> str:
        """NFC, then lower case character by character (a final sigma has no form of its own)."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def _merged(self, token: str) -> bool:
        """The token is what the merges make of its own symbols."""
        ok = self._own.get(token)
        if ok is None:
            body = token.removesuffix(self.end) if self.end else token
            s = list(body)
            if s and body != token:
                s[-1] += self.end
            while len(s) > 1:
                at = min(range(len(s) - 1), key=lambda i: self.rank.get((s[i], s[i + 1]), 1 << 60))
                if (s[at], s[at + 1]) not in self.rank:
                    break
                s[at : at + 2] = [s[at] + s[at + 1]]
            ok = self._own[token] = s == [token]
        return ok

    def _edge(self, token: str, side: int) -> list[tuple[str, int]]:
        """The symbols that stand at one edge of a token while it is merged, each with the rank of the merge that takes it."""
        known = self._edges[side].get(token)
        if known is None:
            known, taken, t = [(token, 1 << 60)], 0, token
            while t in self._made:
                taken = self._made[t][2]
                t = self._made[t][side]
                known.append((t, taken))
            self._edges[side][token] = known
        return known

    def _valid(self, a: str, b: str) -> bool:
        """Tokens a, b (a may be empty) stay two tokens side by side: no merge joins symbols at their common edge before both are taken
        from inside. Of equal ranks the left merge comes first."""
        if not a:
            return self._merged(b)
        key = (self.vocab[a] << 20) + self.vocab[b]
        known = self._pair.get(key)
        if known is None:
            if len(self._pair) >= CACHE:
                self._pair.clear()
            known = self._merged(b)
            if known:
                right, left, rank = self._edge(a, 1), self._edge(b, 0), self.rank
                known = not any((r := rank.get((x, y))) is not None and r < m and r <= n for x, m in right for y, n in left)
            self._pair[key] = known
        return known

    def _last(self, s: str, i: int, end: str, last: list[str]) -> int:
        """Where the last token of the first ``i`` symbols begins, if they end with ``end``."""
        vocab, valid = self.vocab, self._valid
        for j in range(max(0, i - self.longest), i):
            t = s[j:i] + end
            if t in vocab and valid(last[j], t):
                return j
        raise ValueError("the vocabulary lacks a byte")

    def _begin(self, s: str) -> tuple[list[int], list[str]]:
        """For each prefix of the symbols ``s``, as the beginning of a longer piece: its tokens and its last token. Prefixes that pieces have in common are worked out once."""
        count, last, seen = [0], [""], self._seen
        for i in range(1, len(s) + 1):
            known = seen.get(s[:i]) if i <= CACHED_CHARS else None
            if known is None:
                j = self._last(s, i, "", last)
                known = (count[j] + 1, s[j:i])
                if i <= CACHED_CHARS:
                    if len(seen) >= CACHE:
                        seen.clear()
                    seen[s[:i]] = known
            count.append(known[0])
            last.append(known[1])
        return count, last

    def _symbols(self, piece: str) -> str:
        return piece.encode().decode("latin-1").translate(self.symbols)

    def piece_count(self, piece: str) -> int:
        """Tokens of a normalised piece."""
        s = self._symbols(piece)
        count, last = self._begin(s[:-1])
        return count[self._last(s, len(s), self.end, last)] + 1

    def inner_counts(self, piece: str) -> np.ndarray:
        """Tokens of each prefix of a normalised piece, by code points 1..len. A prefix that is cut into other pieces (of a contraction) is the sum of those."""
        s = self._symbols(piece)
        count, last = self._begin(s)
        ends = range(1, len(s) + 1) if piece.isascii() else np.cumsum([len(c.encode()) for c in piece]).tolist()
        out = np.array([count[self._last(s, i, self.end, last)] + 1 for i in ends], np.int32)
        if piece[0] == "'":
            for k in range(1, len(piece)):
                parts = self.piece.findall(piece[:k])
                if parts != [piece[:k]]:
                    out[k - 1] = sum(self.counts[p] for p in parts)
        return out

    def _parts(self, text: str) -> list[tuple[str, bool]]:
        """Stretches between special tokens, and these."""
        if self.special is None or self.mark not in text:
            return [(text, False)]
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [(text[at : m.start()], False), (m.group(), True)]
            at = m.end()
        return [*out, (text[at:], False)]

    def _plain(self, text: str) -> int:
        """Tokens of a text without special tokens."""
        return sum(map(self.counts.__getitem__, self.piece.findall(self.normal(text))))

    def count(self, text: str) -> int:
        return sum(1 if special else self._plain(part) for part, special in self._parts(text))

    def _normal_counts(self, normal: str) -> np.ndarray:
        """Tokens of each prefix of a normalised text, by code points 0..len. What stands outside of pieces is white space and adds none."""
        pieces = self.piece.findall(normal)
        if not pieces:
            return np.zeros(len(normal) + 1, np.int64)
        tables = list(map(self.tables.__getitem__, pieces))
        size, last = np.fromiter(map(len, pieces), np.int64, len(pieces)), np.fromiter((t[-1] for t in tables), np.int64, len(tables))
        inside = np.concatenate(tables) + np.repeat(np.cumsum(last) - last, size)
        point = np.frombuffer(normal.encode("utf-32-le", "surrogatepass"), np.uint32)
        shown = ~_SPACE[np.minimum(point, len(_SPACE) - 1)]
        return np.concatenate([[0], inside])[np.concatenate([[0], np.cumsum(shown)])]

    def _odd_word(self, word: str) -> np.ndarray:
        """The same for a word that changes its length when it is normalised. Each prefix of a short word is counted by itself; in one above ODD_WORD code points, a prefix
        that ends inside a composed character counts as the one that ends with it."""
        if len(word) <= ODD_WORD:
            return np.array([self._plain(word[:i]) for i in range(len(word) + 1)], np.int64)
        clusters = _CLUSTER.findall(word)
        normal = [self.normal(c) for c in clusters]
        if "".join(normal) != self.normal(word):
            clusters, normal = [word], [self.normal(word)]
        table = self._normal_counts("".join(normal))
        ends = table[np.cumsum([len(c) for c in normal])]
        return np.concatenate([[0], np.repeat(ends, [len(c) for c in clusters])])

    def _part_counts(self, part: str) -> np.ndarray:
        """Tokens of each prefix of a text without special tokens, by its own code points 0..len."""
        if unicodedata.is_normalized("NFC", part) and len(part.lower()) == len(part):
            return self._normal_counts(self.normal(part))
        out, base = [np.zeros(1, np.int64)], 0
        for m in _WORD.finditer(part):
            w = m.group()
            same = unicodedata.is_normalized("NFC", w) and len(w.lower()) == len(w)
            out.append(base + (self._normal_counts(self.normal(w)) if same else self._odd_word(w))[1:])
            base = int(out[-1][-1])
        return np.concatenate(out)

    def prefix_counts(self, text: str) -> np.ndarray:
        """Tokens of each prefix of a text, by its code points 0..len."""
        out, base, tail, tail_base = [np.zeros(1, np.int64)], 0, "", 0
        for part, special in self._parts(text):
            if special:  # a part of it is plain text, and may go on with the marks before it
                out.append(np.array([*(tail_base + self._plain(tail + part[:i]) for i in range(1, len(part))), base + 1], np.int64))
                base += 1
                tail, tail_base = "", base
            elif part:
                t = self._part_counts(part)
                tail = self.tail.search(part).group()
                tail_base = base + int(t[len(part) - len(tail)])
                out.append(base + t[1:])
                base = int(out[-1][-1])
        return np.concatenate(out)

    def stretches(self, text: str, size: int = STRETCH) -> Iterator[tuple[int, str]]:
        """(code points before it, text) of stretches of about ``size`` code points, cut before white space, where no piece and no special token is cut."""
        lo = 0
        while lo < len(text) or not lo:
            m = _GAP.search(text, lo + size)
            hi = m.start() if m else len(text)
            yield lo, text[lo:hi]
            lo = hi or 1

    def table(self, text: str) -> Iterator[tuple[int, np.ndarray]]:
        """(code points of the first, tokens of each) of the prefixes of a text, by stretches; the first begins with the empty prefix."""
        base = 0
        for lo, part in self.stretches(text):
            t = self.prefix_counts(part) + base
            base = int(t[-1])
            yield (lo + 1, t[1:]) if lo else (0, t)

    def measure(self, text: str, budget: int, size: int = STRETCH) -> tuple[int, int]:
        """Tokens of the text, and the code points of its longest prefix that takes ``budget`` tokens at most. Stretches are summed by piece; the one that passes the budget is
        looked at in shorter ones, and the last of those by its table."""
        n, fit, passed = 0, len(text), False
        for lo, part in self.stretches(text, size):
            k = self.count(part)
            if n + k > budget and not passed:  # a prefix that ends behind it never takes fewer tokens than this stretch
                passed = True
                fit = lo + (self.measure(part, budget - n, NEAR)[1] if size > NEAR else int(np.flatnonzero(self.prefix_counts(part) <= budget - n)[-1]))
            n += k
        return n, fit


_CLUSTER, _WORD, _GAP = regex.compile(r"\X"), regex.compile(r"\s*\S+|\s+"), regex.compile(r"\s")
#: White space by code point; none lies at the end of the table or above it.
_SPACE = np.array([bool(_GAP.match(chr(i))) for i in range(0x3002)])


@lru_cache(maxsize=4)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", budget: int = 2048) -> DataFrame:
    """``id, n_bytes, n_tokens, fit_chars`` per row of ``docs``; ``vocabulary`` is the tokenizer file's path on every machine.

    ``fit_chars`` is the longest prefix of the text within ``budget`` tokens, in its own code points: ``substring(text, 1, fit_chars)`` keeps to the budget. Null and empty texts have no token. Very long
    texts are read in whole, stretch by stretch. All rows are kept, repeated rows and null ids too; an empty table gives an empty result; other columns play no part."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = counter(vocabulary)
        for pdf in batches:
            found = [c.measure(t, budget) for t in pdf.t]
            yield pd.DataFrame({"id": pdf.id.astype("Int64"), "n_bytes": pdf.n_bytes, "n_tokens": [n for n, _ in found], "fit_chars": [k for _, k in found]})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.withColumn("n_bytes", F.octet_length("t").cast("long"))
    return rows.mapInPandas(run, "id long, n_bytes long, n_tokens long, fit_chars long")


def prefix_table(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, start, tokens``: the table of each text, to be stored: the exact count of every prefix, those of ``start`` code points and more in order. A text has one row for each stretch of it; the
    first begins with the empty prefix. Odd rows as in :func:`token_counts`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = counter(vocabulary)
        for pdf in batches:
            for i, t in zip(pdf.id.astype("Int64"), pdf.t):
                for start, counts in c.table(t or ""):
                    yield pd.DataFrame({"id": pd.array([i], "Int64"), "start": [start], "tokens": [counts]})

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInPandas(run, "id long, start long, tokens array<long>")


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"), "fit_chars")
