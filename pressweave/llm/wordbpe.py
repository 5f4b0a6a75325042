"""Word BPE encoding and decoding with batched merge rounds.

The symbols of many words stand in one flat array. Each round looks all neighbouring pairs up by binary
search over the sorted pair keys, takes every word's lowest rank, merges all places of that pair and drops
finished words. Words are independent of each other, so every distinct word of a slice is encoded once and
documents are put together by gathering.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import Memo, flat, gather, map_slices, pick, starts_of, words_of

NONE = np.int64(1) << 40
WORDS_AT_ONCE = 100_000
#: Words, pairs and ids of a slice take some forty times its bytes, so slices are small; so is what a worker remembers.
SLICE = 1 << 20
REMEMBERED = 100_000


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stays, the rest moves past 255."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in keep:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


class WordBpe:
    """A vocabulary file with word ends (``end_of_word_suffix``), lower case and dropped white space."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        letters = byte_letters()
        self.inner = np.array([vocab.get(c, -1) for c in letters], dtype=np.int64)
        self.final = np.array([vocab.get(c + end, -1) for c in letters], dtype=np.int64)
        keys, ranks, made = [], [], []
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            keys.append(vocab[a] << 32 | vocab[b])
            ranks.append(rank)
            made.append(vocab[a + b])
        order = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
        self.keys = np.array(keys, dtype=np.int64)[order]
        self.ranks = np.array(ranks, dtype=np.int64)[order]
        self.made = np.array(made, dtype=np.int64)[np.argsort(np.array(ranks), kind="stable")]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = regex.compile(pattern).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split
        names = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for word, i in [*vocab.items(), *self.special.items()]:
            names[i] = word + " "
        self.names = pa.array(names, type=pa.string())
        self.coded = Memo(self.encode_words, REMEMBERED)

    def normal(self, word: str) -> str:
        """NFC and letter-wise lower case (a final sigma has no form of its own)."""
        if word.isascii():
            return word.lower()
        return unicodedata.normalize("NFC", word).replace("Σ", "σ").lower()

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, offsets)`` of normalised pieces."""
        data, off = flat(pa.array(words, type=pa.string()))
        sym = self.inner[data]
        last = off[1:] - 1
        sym[last] = self.final[data[last]]
        owner = np.repeat(np.arange(len(words)), np.diff(off))
        done_sym, done_owner = [], []
        while len(sym):
            pair = sym[:-1] << 32 | sym[1:]
            at = np.searchsorted(self.keys, pair)
            at[at == len(self.keys)] = 0
            rank = np.where((self.keys[at] == pair) & (owner[:-1] == owner[1:]), self.ranks[at], NONE)
            rank = np.append(rank, NONE)
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            lowest = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(owner)))
            low = np.repeat(lowest, size)
            over = low == NONE
            if over.any():
                done_sym.append(sym[over])
                done_owner.append(owner[over])
                go = ~over
                sym, owner, rank, low = sym[go], owner[go], rank[go], low[go]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == low)
            # in a run of overlapping places (aaa) every second one merges, from the left
            begins = np.append(True, hit[1:] != hit[:-1] + 1)
            run = np.maximum.accumulate(np.where(begins, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            sym[hit] = self.made[rank[hit]]
            keep = np.ones(len(sym), dtype=bool)
            keep[hit + 1] = False
            sym, owner = sym[keep], owner[keep]
        if not done_sym:
            return np.zeros(0, dtype=np.int64), np.zeros(len(words) + 1, dtype=np.int64)
        sym, owner = np.concatenate(done_sym), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return sym[order], starts_of(np.bincount(owner, minlength=len(words)))

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, offsets)`` of white-space-free words as they stand in texts."""
        number: dict[str, int] = {}
        plan, sizes = [], []
        for word in words:
            n = 0
            for part in self.cut(word) if "<|" in word else (word,):
                if part in self.special:
                    plan.append(-self.special[part] - 1)
                    n += 1
                elif part:
                    for piece in self.split(self.normal(part)):
                        plan.append(number.setdefault(piece, len(number)))
                        n += 1
            sizes.append(n)
        pieces = list(number)
        ids, ends = [], [np.zeros(1, dtype=np.int64)]
        for i in range(0, len(pieces), WORDS_AT_ONCE):
            some, off = self.merge(pieces[i:i + WORDS_AT_ONCE])
            ends.append(off[1:] + ends[-1][-1])
            ids.append(some)
        specials = np.array(sorted(self.special.values()), dtype=np.int64)  # a special token is a piece of one id
        base = ends[-1] if len(ends) == 1 else np.concatenate(ends)
        off = np.concatenate([base, base[-1] + 1 + np.arange(len(specials))])
        ids = np.concatenate([*ids, specials])
        plan = np.array(plan, dtype=np.int64)
        if len(specials):
            plan = np.where(plan < 0, len(pieces) + np.searchsorted(specials, -plan - 1), plan)
        out, got = gather(ids, off, plan)
        return out, starts_of(np.diff(starts_of(got)[starts_of(np.array(sizes, dtype=np.int64))]))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, offsets)`` of whole texts."""
        words, counts = words_of(texts)
        coded = words.dictionary_encode()
        ids, off = self.coded(coded.dictionary.to_pylist())
        out, sizes = gather(ids, off, np.asarray(coded.indices))
        return out, starts_of(sizes)[starts_of(counts)]

    def decode(self, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """The token texts with a space after each, and where each token's text begins."""
        taken = self.names.take(pa.array(ids))
        data, off = flat(taken)
        return memoryview(np.ascontiguousarray(data)), off


_LOADED: dict[str, WordBpe] = {}


def loaded(path: str) -> WordBpe:
    """One vocabulary per worker process."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def _spans(off: np.ndarray):
    return zip(off[:-1].tolist(), off[1:].tolist())


def encode_documents(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, ids)``, ids as an array of ints. Null and empty texts have no ids; repeated rows stay."""
    def body(part, texts):
        ids, off = loaded(vocabulary).encode(texts)
        lists = pa.ListArray.from_arrays(pa.array(off, type=pa.int32()), pa.array(ids, type=pa.int32()))
        return {"doc_id": part.column("doc_id"), "ids": lists}
    return map_slices(pick(docs, doc_id, text), body, "doc_id bigint, ids array<int>", limit=SLICE)


def decode_documents(coded: DataFrame, vocabulary: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``(doc_id, text)`` with the token texts joined by a space; null or empty ids give an empty text."""
    def run(batches):
        for batch in batches:
            lists = batch.column("ids")
            values, names = lists.flatten(), loaded(vocabulary)
            counts = np.array([len(x) if x is not None else 0 for x in lists], dtype=np.int64)
            data, starts = names.decode(np.asarray(values, dtype=np.int64))
            cut = starts[starts_of(counts)]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"),
                "text": pa.array([bytes(data[a:max(a, b - 1)]).decode() for a, b in _spans(cut)], type=pa.string())})
    return coded.selectExpr(f"cast(`{doc_id}` as bigint) doc_id", f"`{ids}` ids").mapInArrow(run, "doc_id bigint, text string")


def round_trip(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids])``: digests of the ids and of the text decoded from them.

    Null and empty texts have no ids and decode to an empty text; repeated rows stay; an empty table gives none.
    """
    def body(part, texts):
        bpe = loaded(vocabulary)
        ids, off = bpe.encode(texts)
        raw = memoryview(ids.astype("<u4").tobytes())
        data, starts = bpe.decode(ids)
        cut = starts[off]
        lists = {"ids": pa.ListArray.from_arrays(pa.array(off, type=pa.int32()), pa.array(ids, type=pa.int32()))} if with_ids else {}
        return {
            "doc_id": part.column("doc_id"),
            "n_tokens": pa.array(np.diff(off)),
            "ids_sha256": [hashlib.sha256(raw[4 * a:4 * b]).hexdigest() for a, b in _spans(off)],
            "decoded_sha256": [hashlib.sha256(data[a:max(a, b - 1)]).hexdigest() for a, b in _spans(cut)], **lists}
    return map_slices(pick(docs, doc_id, text), body, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
                      + (", ids array<int>" if with_ids else ""), limit=SLICE)
