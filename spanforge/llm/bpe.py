"""Byte-level BPE: exact linear-time encoding by backtracking, table decoding.

Encoding.  Text is cut into pre-tokens (the published GPT-2 split pattern).  In a
pre-token an Aho-Corasick automaton over all token strings gives the longest
token starting at each byte.  A left-to-right walk takes that token whenever it
may stand beside its predecessor; if not it tries the next shorter token, and if
none is left it takes the last token back.  A byte position that was given up is
never entered again, hence linear time.  Two tokens may stand side by side iff
merging by rank would never join across their border; that is decided by
undoing merges on both sides and remembered in a pair table.  A sequence whose
neighbours are all compatible is the one that the merges give.

Decoding.  One byte string holds all tokens, an offset table says where each
begins; ids are decoded by one gather.

Cases.  Null text encodes as the empty text: no ids.  Empty text: no ids.  Added
tokens in a text (``<|endoftext|>``) get their own id.  Repeated rows repeat.
Extra columns are dropped by the digest, kept by ``encode``.  Ids that the
vocabulary lacks are skipped by decoding, as are nulls.  Bytes that aren't UTF-8
decode to U+FFFD.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import sys
import unicodedata

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, per_worker

#: Fixed value: the published GPT-2 pre-token pattern.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The published byte-to-letter rule: printable Latin-1 stands for itself, the rest follows from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.cache
def late_letters() -> str:
    """Ranges, for a character class, of the letters and numbers that Unicode 15.1 hasn't assigned.

    The tokenizers library doesn't know them yet, the ``regex`` module does; this
    Python's own table is of that version.
    """
    import regex

    free = "".join(c for c in map(chr, range(0x80, sys.maxunicode + 1)) if unicodedata.category(c) == "Cn")
    codes = list(map(ord, regex.findall(r"[\p{L}\p{N}]", free)))
    starts = [c for i, c in enumerate(codes) if not i or codes[i - 1] != c - 1]
    ends = [c for i, c in enumerate(codes) if i + 1 == len(codes) or codes[i + 1] != c + 1]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends, strict=True))


def older_split(late: str):
    """The split pattern's ``findall`` with the letters of ``late`` taken for neither letters nor numbers."""
    import regex

    older = SPLIT.replace(r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]||[{late}]]").replace(r"?\p{L}+", rf"?[\p{{L}}--[{late}]]+").replace(r"?\p{N}+", rf"?[\p{{N}}--[{late}]]+")
    return regex.compile(older, regex.V1).findall


class Codec:
    """Encoder and decoder for one tokenizer file (the ``tokenizers`` JSON form).

    ``late``: letters and numbers to take for neither, see ``late_letters``.
    """

    #: Strings remembered, and the longest of them in characters; the memory is emptied when it is full, so it stays below about 80 MB.
    REMEMBER, LONGEST = 300_000, 32

    def __init__(self, raw: bytes, late: str = ""):
        import ahocorasick
        import regex

        spec = json.loads(raw)
        letters = byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.rank = {}
        self.halves = {}
        self.joined = {}
        for at, (a, b) in enumerate(pairs):
            whole = vocab[a + b]
            self.joined[vocab[a], vocab[b]] = (at, whole)
            if whole not in self.rank:
                self.rank[whole], self.halves[whole] = at, (vocab[a], vocab[b])
        by_bytes = {as_bytes(s): i for s, i in vocab.items()}
        self.single = {b[0]: i for b, i in by_bytes.items() if len(b) == 1}
        self.trie = ahocorasick.Automaton()
        for b, i in by_bytes.items():
            if len(b) == 1 or i in self.rank:
                self.trie.add_word(b.decode("latin-1"), (len(b), i))
        self.trie.make_automaton()
        self.length = {i: len(b) for b, i in by_bytes.items()}
        usable = {b: i for b, i in by_bytes.items() if len(b) == 1 or i in self.rank}
        self.shorter = {i: next((usable[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in usable), -1) for b, i in usable.items()}
        self.compatible: dict[tuple[int, int], bool] = {}
        self.split = regex.compile(SPLIT).findall
        self.late = re.compile(f"[{late}]").search if late else None
        if late:
            self.split_older = older_split(late)
        self.special = re.compile("|".join(re.escape(s) for s in sorted(self.added, key=len, reverse=True))) if self.added else None
        # offset table over every id, added tokens included
        strings = {i: b for b, i in by_bytes.items()} | {i: s.encode() for s, i in self.added.items()}
        n = max(strings) + 1
        sizes = np.array([len(strings.get(i, b"")) for i in range(n)], np.int64)
        self.at, self.size = np.concatenate([[0], np.cumsum(sizes)])[:-1], sizes
        self.blob = np.frombuffer(b"".join(strings.get(i, b"") for i in range(n)), np.uint8)
        self.decimal = [str(i) for i in range(n)]
        codec = self

        four = [i.to_bytes(4, "little") for i in range(n)]
        self.packed = packed = lambda ids: b"".join([four[i] for i in ids])

        class Pretokens(dict):
            def __missing__(self, word: str) -> bytes:
                out = packed(codec._word(word.encode()))
                if len(word) <= codec.LONGEST:
                    self[word] = out
                return out

        class Units(dict):
            """Keys: what stands between two spaces; values: ids as bytes, the leading space included."""

            def __missing__(self, unit: str) -> bytes:
                if unit.isalpha():
                    out = packed(codec._word(b" " + unit.encode()))
                    if len(unit) <= codec.LONGEST:
                        self[unit] = out
                    return out
                if unit[-1:] in (".", ",") and unit[:-1].isalpha():  # a word and its comma are two pre-tokens
                    return self[unit[:-1]] + pretokens[unit[-1]]
                return b"".join(map(pretokens.__getitem__, codec.split(" " + unit)))

        self.units, self.pretokens = Units(), (pretokens := Pretokens())

    # -- merges ---------------------------------------------------------------
    def may_follow(self, left: int, right: int) -> bool:
        key = (left, right)
        known = self.compatible.get(key)
        if known is None:
            if len(self.compatible) > 2_000_000:
                self.compatible.clear()
            known = self.compatible[key] = self._border_holds(left, right)
        return known

    def _border_holds(self, left: int, right: int) -> bool:
        """Undo the later merge of either side until a merge across the border would have come first, or none is left.

        ``bound`` is the rank before which a merge across must happen to win: the
        merge just undone on the left wins a tie, one on the right loses it.
        """
        bound, rank = 1 << 62, self.rank
        while True:
            across = self.joined.get((left, right))
            if across is not None and across[0] < bound:
                return False
            r_left, r_right = rank.get(left, -1), rank.get(right, -1)
            if r_left < 0 and r_right < 0:
                return True
            if r_left > r_right:
                bound, left = r_left, self.halves[left][1]
            else:
                bound, right = r_right + 1, self.halves[right][0]

    def _word(self, data: bytes) -> list[int]:
        n = len(data)
        if n == 1:
            return [self.single[data[0]]]
        longest: list[int] = [0] * n
        for end, (size, i) in self.trie.iter(data.decode("latin-1")):
            longest[end - size + 1] = i
        token, length = longest[0], self.length
        if length[token] == n:
            return [token]
        compatible, shorter, may_follow = self.compatible, self.shorter, self.may_follow
        closed = set()
        out: list[int] = []
        pos = 0
        last = -1
        while True:
            end = pos + length[token]
            if end not in closed:
                fits = True if last < 0 else compatible.get((last, token))
                if fits is None:
                    fits = may_follow(last, token)
                if fits:
                    out.append(token)
                    if end == n:
                        return out
                    pos, last, token = end, token, longest[end]
                    continue
            token = shorter[token]
            while token < 0:  # nothing fits here: give the position up
                closed.add(pos)
                token = out.pop()
                pos -= length[token]
                token = shorter[token]
                last = out[-1] if out else -1

    # -- texts ----------------------------------------------------------------
    #: A space before white space or the end isn't the start of a pre-token.
    _odd = re.compile(r" (?:\s|\Z)").search

    def _plain(self, text: str) -> bytes:
        if self.late and not text.isascii() and self.late(text):
            return b"".join([self.packed(self._word(w.encode())) for w in self.split_older(text)])
        if self._odd(text):
            # keep the spaces that open a word apart from those that don't
            units = re.split(r" (?=\S)", text)
        else:
            units = text.split(" ")
        if len(self.units) + len(self.pretokens) > self.REMEMBER:
            self.units.clear()
            self.pretokens.clear()
        head = b"".join(map(self.pretokens.__getitem__, self.split(units[0])))
        return head + b"".join(map(self.units.__getitem__, units[1:]))

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text as uint32; none for null."""
        if not text:
            return np.empty(0, np.uint32)
        if self.special is None or not any(s in text for s in self.added):
            return np.frombuffer(self._plain(text), "<u4")
        parts, at = [], 0
        for m in self.special.finditer(text):
            if m.start() > at:
                parts.append(self._plain(text[at : m.start()]))
            parts.append(np.array([self.added[m[0]]], "<u4").tobytes())
            at = m.end()
        if at < len(text):
            parts.append(self._plain(text[at:]))
        return np.frombuffer(b"".join(parts), "<u4")

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        ids = np.asarray(ids, np.int64)
        ids = ids[(ids >= 0) & (ids < len(self.size))]
        if not len(ids):
            return b""
        sizes = self.size[ids]
        ends = np.cumsum(sizes)
        index = np.repeat((self.at[ids] - ends + sizes).astype(np.int32), sizes)
        index += np.arange(ends[-1], dtype=np.int32)
        return self.blob[index].tobytes()

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def shared_codec(spark, path: str | None):
    """A function that gives each worker its codec; the file is read on the driver, 2 MB are broadcast."""
    with open(path or default_path(), "rb") as f:
        raw = f.read()
    sent, key, late = spark.sparkContext.broadcast(raw), ("codec", hashlib.md5(raw).hexdigest()), late_letters()
    return lambda: per_worker(key, lambda: Codec(sent.value, late))


def encode(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` with a column ``ids`` array<int>: the ids of ``text`` (empty for null); a column of that name is an error."""
    if "ids" in docs.columns:
        raise ValueError("there is a column ids already")
    codec = shared_codec(docs.sparkSession, path)
    from pyspark.sql.types import ArrayType, IntegerType

    @F.pandas_udf(ArrayType(IntegerType()))
    def ids(texts):
        own = codec()
        return texts.map(lambda t: own.encode(t).astype(np.int32)) if len(texts) else texts

    return docs.withColumn("ids", ids(F.coalesce(F.col(text), F.lit(""))))


def decode(tokens: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """``tokens`` with a column ``decoded``: the text of ``ids`` (empty for null); a column of that name is an error."""
    if "decoded" in tokens.columns:
        raise ValueError("there is a column decoded already")
    codec = shared_codec(tokens.sparkSession, path)

    @F.pandas_udf("string")
    def text(arrays):
        own = codec()
        return arrays.map(lambda a: own.decode([i for i in a if i is not None and i == i]))

    return tokens.withColumn("decoded", text(F.coalesce(F.col(ids), F.array().cast("array<int>"))))


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode and decode every text; per document the count and hashes of ids and decoded text.

    One pass without a shuffle: ids stay in the worker instead of crossing to the JVM.
    """
    codec = shared_codec(docs.sparkSession, path)

    def work(rows: dict) -> dict:
        own = codec()
        counts, ids_hash, text_hash = [], [], []
        names = own.decimal.__getitem__
        for text in rows["text"]:
            ids = own.encode(text)
            counts.append(len(ids))
            ids_hash.append(hashlib.sha256(",".join(map(names, ids.tolist())).encode()).hexdigest())
            data = own.decode_bytes(ids)
            try:
                data.decode("utf-8")
            except UnicodeDecodeError:
                data = data.decode("utf-8", "replace").encode()
            text_hash.append(hashlib.sha256(data).hexdigest())
        return {"doc_id": rows["doc_id"], "n_tokens": counts, "ids_sha256": ids_hash, "decoded_sha256": text_hash}

    return map_rows(docs, ["doc_id", "text"], "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", work)
