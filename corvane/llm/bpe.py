"""Operator 8: byte-level BPE encoding and decoding in batched numpy merge rounds.

Words (pre-tokens) of many documents are encoded together: one flat symbol array, the rank of each neighbouring pair by
binary search over the sorted pair keys, and in each round every word merges all places of its own lowest-ranked pair.
Encodings of words are kept in a table of bounded size; a word met again costs one look-up.

Null and empty texts have no ids; the decoded text is empty.  Repeated rows give repeated rows; an empty table gives an
empty one; other columns are ignored.  Lone surrogates can't occur in Spark strings.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F

from .sparkutil import prepare

#: Pieces whose encodings a worker keeps; beyond that it starts anew.
KEEP_WORDS = 400_000
_NONE = np.iinfo(np.int64).max


def _byte_chars() -> dict[str, int]:
    """The public byte-to-character rule of byte-level BPE vocabularies: printable bytes stand for themselves, others follow from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


def _known(d: dict) -> None:
    """Raises where a vocabulary asks for steps that the codec doesn't take, rather than give other ids."""
    pre, model = d.get("pre_tokenizer") or {}, d["model"]
    plain = d.get("normalizer") is None and model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or (d.get("decoder") or {}).get("type") != "ByteLevel":
        raise ValueError("not a plain byte-level BPE vocabulary")
    if any(t.get(k) for t in d.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added tokens must be taken as they are")


class Codec:
    """Encoder and decoder of one vocabulary (the tokenizers library's JSON)."""

    #: The pre-token pattern of the vocabulary's ByteLevel step (a fixed value).
    PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, spec: str):
        d = json.loads(spec)
        _known(d)
        chars, vocab = _byte_chars(), d["model"]["vocab"]
        raw = {t: bytes(chars[c] for c in t) if all(c in chars for c in t) else t.encode() for t in vocab}
        self.special = {t["content"]: t["id"] for t in d.get("added_tokens", [])}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.pieces = [b""] * size
        for t, i in vocab.items():
            self.pieces[i] = raw[t]
        for t, i in self.special.items():
            self.pieces[i] = t.encode()
        self.first = np.zeros(256, np.int64)
        for c, b in chars.items():
            self.first[b] = vocab[c]
        merges = [m.split(" ") if isinstance(m, str) else m for m in d["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made  # made: by rank
        self.words = regex.compile(self.PATTERN)
        self.double = regex.compile(r"\s(?= )")
        names = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.kept: dict[str, bytes] = {}

    def _ranks(self, sym: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The ranks of the pairs that begin at these places; the greatest integer where two symbols are no pair."""
        nxt = np.minimum(at + 1, len(sym) - 1)
        key = sym[at] << 32 | sym[nxt]
        k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[k] == key) & (word[at] == word[nxt]) & (nxt > at), self.ranks[k], _NONE)

    def encode_words(self, words: list[bytes]) -> tuple[bytes, list[int]]:
        """The ids of all words in a row, and where each word's end, in bytes."""
        raw = np.frombuffer(b"".join(words), np.uint8)
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        sym, done = self.first[raw], []
        rank = self._ranks(sym, word, np.arange(len(sym)))
        while len(sym):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            low = np.minimum.reduceat(rank, starts)
            low = np.repeat(low, np.diff(np.append(starts, len(sym))))
            going = low < _NONE
            if not going.all():
                done.append((word[~going], sym[~going]))
                sym, word, rank, low = sym[going], word[going], rank[going], low[going]
            if not len(sym):
                break
            hit = np.flatnonzero(rank == low)
            # of overlapping places of one pair, the first, third, ... of a run merge
            fresh = np.append(True, (hit[1:] != hit[:-1] + 1) | (word[hit[1:]] != word[hit[:-1]]))
            nth = np.arange(len(hit)) - np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
            hit = hit[nth % 2 == 0]
            sym[hit] = self.made[low[hit]]
            stay = np.ones(len(sym), bool)
            stay[hit + 1] = False
            sym, word, rank = sym[stay], word[stay], rank[stay]
            hit = hit - np.arange(len(hit))
            near = np.concatenate([hit, np.maximum(hit - 1, 0)])
            rank[near] = self._ranks(sym, word, near)
        if not done:
            return b"", [0] * len(words)
        word, sym = (np.concatenate(x) for x in zip(*done))
        ends = np.cumsum(np.bincount(word, minlength=len(words))) * 4
        return sym[np.argsort(word, kind="stable")].astype("<u4").tobytes(), ends.tolist()

    def learn(self, pieces: set[str]) -> None:
        """Enter the encodings of pieces of text; a full table is emptied first."""
        new = [p for p in pieces if p not in self.kept]
        if len(self.kept) + len(new) > KEEP_WORDS:
            self.kept.clear()
            new = list(pieces)
        findall = self.words.findall
        for k in range(0, len(new), 50_000):
            part = new[k : k + 50_000]
            split = [(p,) if (p[1:] or p).isalpha() and (p[0] == " " or p[0].isalpha()) else findall(p) for p in part]
            words = list({w for ws in split for w in ws})
            raw, ends = self.encode_words([w.encode() for w in words])
            ids = dict(zip(words, [raw[a:b] for a, b in zip([0, *ends], ends)]))
            self.kept.update([(p, ids[ws[0]] if len(ws) == 1 else b"".join([ids[w] for w in ws])) for p, ws in zip(part, split)])

    def pieces_of(self, text: str) -> list[str]:
        """A split of a text at places where words always end: before a space that follows no other white space."""
        if not text:
            return []
        if text[0] == " " or self.double.search(text):
            return self.words.findall(text)
        head, *rest = text.split(" ")
        return [head, *map(" ".__add__, rest)]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian 32-bit integers."""
        split = []
        for text in texts:
            parts = self.cut.split(text) if self.cut else [text]
            split.append([part if part in self.special else self.pieces_of(part) for part in parts])
        self.learn(set().union(*(part for parts in split for part in parts if isinstance(part, list))))
        kept = self.kept
        return [b"".join(self.special[part].to_bytes(4, "little") if isinstance(part, str) else b"".join(map(kept.__getitem__, part)) for part in parts) for parts in split]

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(2)
def codec(name: str) -> Codec:
    """The codec of a vocabulary file that the driver has given to the cluster."""
    with open(SparkFiles.get(name), encoding="utf-8") as f:
        return Codec(f.read())


def give(df: DataFrame, path: str) -> str:
    """Ship the vocabulary file to the executors (also to those that join later)."""
    df.sparkSession.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def encode(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document, and the ids themselves with keep_ids; no shuffle."""
    prepare(docs.sparkSession)
    name = give(docs, path)
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    fields += [("ids", pa.list_(pa.int32()))] * keep_ids
    schema = pa.schema(fields)

    def run(batches):
        c = codec(name)
        for b in batches:
            rows: list[list] = [[] for _ in fields]
            coded = c.encode_many([t or "" for t in b.column(1).to_pylist()])
            for doc, ids in zip(b.column(0), coded):
                back = c.decode(ids)
                row = [doc.as_py(), len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back.encode("utf-8", "replace")).hexdigest()]
                for col, v in zip(rows, row + ([np.frombuffer(ids, "<i4")] if keep_ids else [])):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(rows, schema)], schema=schema)

    sql = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, sql)


def decode(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """The table with a column decoded: the text of an array of ids (null: null)."""
    name = give(df, path)
    @F.pandas_udf("string")
    def text(col: pd.Series) -> pd.Series:
        c = codec(name)
        return col.map(lambda v: None if v is None else c.decode(np.asarray(v, "<u4").tobytes()))

    return df.withColumn("decoded", text(ids))
