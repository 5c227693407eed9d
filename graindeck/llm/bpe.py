"""Byte-level BPE: a backtracking encoder and an offset-table decoder.

Encoding finds, by an Aho-Corasick automaton, every vocabulary token that starts at each byte of a pre-token, takes
the longest, and checks each neighbouring pair against a table of compatible pairs. A pair is compatible if merging its
joined bytes by rank gives the same pair again; a sequence whose neighbours are all compatible is the encoding, and no
prefix of a text has two, so a position that failed once is never tried again and the work is linear. Decoding gathers
bytes from one blob by an offset table.

Nulls: a null text counts as the empty one, which has no tokens. The texts of special tokens in a document become those
tokens. Other columns pass through; columns with the names of the results are replaced.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
import json
import re
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from .common import table, unused

#: The pre-tokenizer's fixed pattern (byte-level BPE); white space is Unicode's property.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Pieces, and pairs of tokens, that a Python worker remembers before it starts anew.
REMEMBERED = 200_000
NEVER = 1 << 60
#: Texts whose results a worker holds at once.
ROWS = 1000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: printable ones for themselves, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    letters.update({chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))})
    return letters


class Tokenizer(dict):
    """Maps a piece between spaces to its ids, packed as little-endian unsigned 32-bit integers; a missing one is encoded."""

    def __init__(self, path: str):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letter, model = byte_letters(), spec["model"]
        raw = {bytes(letter[c] for c in token): i for token, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or ()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, int] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = (bytes(letter[c] for c in x) for x in (pair if isinstance(pair, list) else pair.split(" ")))
            whole, pair_ids = raw[a + b], (raw[a], raw[b])
            self.rank.setdefault(pair_ids, r)
            if whole not in self.made:
                self.made[whole], self.halves[whole] = r, pair_ids
        self.automaton = ahocorasick.Automaton()
        for b, i in raw.items():
            if len(b) == 1 or i in self.made:
                self.automaton.add_word(b.decode("latin-1"), (len(b), i))
        self.automaton.make_automaton()
        count = 1 + max([*raw.values(), *self.special.values()])
        by_id: list[bytes] = [b""] * count
        for b, i in raw.items():
            by_id[i] = b
        for t, i in self.special.items():
            by_id[i] = t.encode()
        self.blob = np.frombuffer(b"".join(by_id), np.uint8)
        self.offset = np.zeros(count + 1, np.int64)
        np.cumsum([len(b) for b in by_id], out=self.offset[1:])
        self.pattern = regex.compile(PRETOKEN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.edges: dict[int, list[tuple[int, int]]] = {}
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, list[int]] = {}
        self.inner_space = re.compile(r" (?=\s|\Z)").search
        self.starts_anew = re.compile(r"(?= \S)")

    def forget(self) -> None:
        """Gives back what was remembered of a task's texts: a worker outlives its task, and waits with all it holds."""
        self.clear()
        self.known.clear()
        self.pairs.clear()
        given_back()

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The pieces at one end (0 or 1) of a token as merging builds it: each with the rank of the merge that takes it up."""
        if (made := self.edges.get(2 * token + side)) is not None:
            return made
        steps, taken = [(token, NEVER)], token
        while taken in self.halves:
            steps.append((self.halves[taken][side], self.made[taken]))
            taken = self.halves[taken][side]
        self.edges[2 * token + side] = steps[::-1]
        return steps[::-1]

    def _compatible(self, left: int, right: int) -> bool:
        """Whether no merge ever joins the end of left to the start of right: both edges are replayed by rank."""
        a, b, i, j, rank = self._edge(left, 1), self._edge(right, 0), 0, 0, self.rank
        while True:
            (x, x_goes), (y, y_goes) = a[i], b[j]
            across = rank.get((x, y), NEVER)
            if across < x_goes and across <= y_goes:
                return False
            if x_goes < y_goes:
                i += 1
            elif y_goes < x_goes:
                j += 1
            elif x_goes == NEVER:
                return True
            else:
                i, j = i + 1, j + 1

    def pieces(self, raw: bytes) -> list[int]:
        """The ids of one pre-token."""
        n, found = len(raw), [[] for _ in raw]
        for end, token in self.automaton.iter(raw.decode("latin-1")):  # ends ascend, so each start's longest comes last
            found[end + 1 - token[0]].append(token)
        if found[0] and found[0][-1][0] == n:
            return [found[0][-1][1]]
        pairs, failed, out, at, last = self.pairs, bytearray(n + 1), [], 0, -1
        here = found[0]
        k = len(here)
        while at < n:
            while k:
                k -= 1
                size, token = here[k]
                if failed[at + size]:
                    continue
                if last >= 0:
                    fits = pairs.get(pair := last << 20 | token)
                    if fits is None:
                        if len(pairs) >= REMEMBERED:
                            pairs.clear()
                        fits = pairs[pair] = self._compatible(last, token)
                    if not fits:
                        continue
                out.append((at, k, here))
                at, last = at + size, token
                if at < n:
                    here = found[at]
                    k = len(here)
                break
            else:
                failed[at] = 1
                at, k, here = out.pop()
                last = out[-1][2][out[-1][1]][1] if out else -1
        return [here[k][1] for _, k, here in out]

    def __missing__(self, piece: str) -> bytes:
        """The packed ids of a space and a piece without spaces."""
        if len(self) >= REMEMBERED:
            self.clear()
        packed = self.plain(" " + piece)
        if len(piece) <= 48:
            self[piece] = packed
        return packed

    def plain(self, text: str) -> bytes:
        ids: list[int] = []
        known = self.known
        for pretoken in self.pattern.findall(text):
            part = known.get(pretoken)
            if part is None:
                part = self.pieces(pretoken.encode("utf-8", "surrogatepass"))
                if len(known) >= REMEMBERED:
                    known.clear()
                if len(pretoken) <= 48:
                    known[pretoken] = part
            ids += part
        return array("I", ids).tobytes()

    def _encode(self, text: str) -> bytes:
        """A space before anything but white space always starts a pre-token, so what such spaces part is encoded alone."""
        if self.inner_space(text):
            return self.plain(text) if len(text) < 200 else b"".join(map(self.plain, self.starts_anew.split(text)))
        first, *rest = text.split(" ")
        return self.plain(first) + b"".join(map(self.__getitem__, rest))

    def encode(self, text: str) -> bytes:
        """The packed ids of a whole text."""
        if self.cut is None or not any(s in text for s in self.special):
            return self._encode(text)
        return b"".join(array("I", [self.special[part]]).tobytes() if part in self.special else self._encode(part) for part in self.cut.split(text))

    def decode(self, packed: bytes) -> str:
        """The text of packed ids, all at once by the offset table."""
        ids = np.frombuffer(packed, "<u4")
        size = self.offset[ids + 1] - self.offset[ids]
        ends = np.cumsum(size)
        index = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.offset[ids] - (ends - size), size)
        return self.blob[index].tobytes().decode("utf-8", "replace")


@lru_cache(4)
def tokenizer(path: str) -> Tokenizer:
    assert sys.byteorder == "little" and array("I").itemsize == 4
    made = Tokenizer(path)
    gc.collect()
    gc.freeze()  # its tables live as long as the worker; what reading the file took goes back
    given_back()
    return made


def given_back() -> None:
    """Returns freed memory to the system, where its library can."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """df with the token ids of each text, as an array of integers."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = tokenizer(path)
        for s in batches:
            yield pd.Series([np.frombuffer(t.encode(x or ""), "<u4").astype(np.int32) for x in s])

    return df.withColumn(ids, run(F.col(text)))


def decode(df: DataFrame, path: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """df with the text of each array of token ids; null ids count as none."""

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = tokenizer(path)
        for s in batches:
            yield pd.Series([t.decode(b"" if x is None else np.asarray(x, "<u4").tobytes()) for x in s], dtype=object)

    return df.withColumn(text, run(F.col(ids)))


def round_trip(df: DataFrame, path: str, text: str = "text", packed: str | None = None) -> DataFrame:
    """df with n_tokens, ids_sha256 and decoded_sha256 of each text: encoded, then decoded from those ids.

    packed: a column for the ids, as little-endian unsigned 32-bit integers."""
    out = ["n_tokens", "ids_sha256", "decoded_sha256", *([packed] if packed else [])]

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string" + (f", {packed} binary" if packed else ""))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        t = tokenizer(path)
        for s in (b.iloc[i : i + ROWS] for b in batches for i in range(0, max(1, len(b)), ROWS)):  # few results at a time
            ids = [t.encode(x or "") for x in s]
            done = {
                "n_tokens": np.array([len(x) // 4 for x in ids], np.int64),
                "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(t.decode(x).encode()).hexdigest() for x in ids],
            }
            yield pd.DataFrame(done | ({packed: ids} if packed else {}))
        t.forget()

    kept = [c for c in df.columns if c not in out]
    (made,) = unused(df, "_bpe")
    return df.select(*kept, run(F.col(text)).alias(made)).select(*kept, *(F.col(f"{made}.{c}") for c in out))


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op7(spark, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary()).drop("text")
