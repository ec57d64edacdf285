"""Ids of whole texts by a tokenizers file whose pre-tokenizer drops white space (so no token crosses it).

Texts are cut at ASCII white space; each distinct word of a batch is taken once. Words of ASCII and Latin-1 letters are
lower-cased and split into parts for a whole array at a time, and a part new to the worker goes through the tokenizer's model
alone; other words go through the whole tokenizer. Both keep what they have met, bounded by pieces and bytes. The file's added tokens
are found first, in the text as it is and wherever they stand, as the library does; what lies between them is encoded as texts are.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from dolomite.llm.wordcache import Coded, WordCache, flattened, gathered

# The normaliser and splitting pattern for which the short way below holds.
NORMALISER = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Words of ASCII (but the mark below) and Latin-1 letters alone, which composition leaves as they are, and the same split of them.
MARK = "\x01"
SIMPLE = r"^[\x00\x02-\x7fÀ-ÖØ-öø-ÿ]*$"
SIMPLE_SPLIT = r"('s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9\t-\r ]+)"


def byte_letters() -> dict[int, str]:
    """The letter that byte-level models write for each byte: printable ones as they are, the others from 256 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        self.short = [x["type"] for x in (said["normalizer"] or {}).get("normalizers", [])] == NORMALISER and [x.get("pattern", {}).get("Regex", x["type"]) for x in said["pre_tokenizer"].get("pretokenizers", [])] == [SPLIT, "ByteLevel"]
        added = said.get("added_tokens") or []
        self.added = {x["content"]: x["id"] for x in added if x["content"]}
        #: Whether all of them are found by their plain string; else every text goes whole through the tokenizer.
        self.by_string = not any(x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"] for x in added)
        self.marks = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.largest = max(self.tokenizer.get_vocab(with_added_tokens=True).values(), default=0)
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.parts, self.others = WordCache(self.by_model), WordCache(self.by_tokenizer)

    def by_model(self, parts: list[str]) -> Coded:
        tokenize, letters = self.model.tokenize, self.letters
        return flattened([[x.id for x in tokenize(p if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(letters))] for p in parts])

    def by_tokenizer(self, words: list[str]) -> Coded:
        return flattened([x.ids for i in range(0, len(words), 20_000) for x in self.tokenizer.encode_batch_fast(words[i : i + 20_000], add_special_tokens=False)])

    def many(self, words: pa.Array) -> Coded:
        """Ids of distinct words without ASCII white space."""
        simple = pc.match_substring_regex(words, SIMPLE) if self.short else pa.array(np.zeros(len(words), bool))
        low = pc.utf8_lower(words.filter(simple))
        split = pc.split_pattern(pc.replace_substring_regex(low, SIMPLE_SPLIT, rf"\1{MARK}"), MARK)
        a, cuts = self.parts.encode(split.flatten(), np.asarray(split.offsets) - split.offsets[0].as_py())
        rest = words.filter(pc.invert(simple))
        b, ends = self.others.encode(rest, np.arange(len(rest) + 1))
        on = np.asarray(simple)
        start, size = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        start[on], size[on] = cuts[:-1], np.diff(cuts)
        start[~on], size[~on] = len(a) + ends[:-1], np.diff(ends)
        return np.concatenate([a, b]), start, size


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def token_ids(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids and bounds of a string array's texts (null: empty)."""
    own, texts = encoder(path), pc.fill_null(texts.cast(pa.large_string()), "")
    if not own.by_string:
        flat, start, size = flattened([x.ids for x in own.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)])
        return flat, np.append(start, len(flat))
    marked = np.zeros(len(texts), bool)
    for mark in own.added:
        marked |= np.asarray(pc.match_substring(texts, mark))
    if not marked.any():
        return plain_ids(texts, path)
    pieces, after, first = [], [], []
    for text, has in zip(texts.to_pylist(), marked, strict=True):
        first.append(len(pieces))
        parts = own.marks.split(text) if has else [text]
        pieces += parts[::2]
        after += [own.added[x] for x in parts[1::2]] + [-1]
    ids, ends = plain_ids(pa.array(pieces, pa.large_string()), path)
    mark = np.array(after)
    ids = np.insert(ids, ends[1:][mark >= 0], mark[mark >= 0])
    ends = ends + np.concatenate([[0], np.cumsum(mark >= 0)])
    return ids, ends[[*first, len(pieces)]]


def plain_ids(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The same of texts without added tokens."""
    lists = pc.ascii_split_whitespace(texts)
    bounds = np.asarray(lists.offsets)
    coded = lists.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
    flat, start, size = encoder(path).many(coded.dictionary)
    each = np.asarray(coded.indices)
    ids, ends = gathered(flat, start[each], size[each])
    return ids, np.concatenate([[0], ends])[bounds - bounds[0]]
