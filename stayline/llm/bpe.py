"""Byte-level BPE with word ends: encoding by forced boundaries, and decoding.

The vocabulary file of a public tokenizer is read on the driver (a few megabytes) and sent
to the tasks. A pair of neighbouring bytes that occurs inside no token of the vocabulary
can never be merged over, so it marks a certain cut. Words are cut there, the fragments
are encoded independently by the merge list, and their ids concatenated. Fragments and
words that come again are looked up; both look-up tables are bounded.

Defined results: a null text counts as empty and has no ids; texts of any length are
encoded whole; a special token's string in a text becomes that token, as the library does
it; ids outside the vocabulary decode to nothing. Repeated rows and empty tables go
through; input columns are carried in ``row``. Characters that newer versions of Unicode
added may be classed differently than in the library's tables.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from stayline.llm.common import as_row

_WORDS, _FRAGMENTS = 1 << 19, 1 << 17
_SHORT = 48
_BATCH = 512
_ID_BITS = 24
_ID_MASK, _NO_MERGE = (1 << _ID_BITS) - 1, 1 << 62


def byte_letters() -> list[str]:
    """The printable letter of each byte: its own where it has one, else the next free
    one from U+0100 on."""
    own = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class _Bounded(dict):
    """Answers by key, worked out when missing. When ``most`` are held they become the old
    ones; those asked for again are taken over, the rest is forgotten."""

    def __init__(self, work_out, most: int):
        super().__init__()
        self.work_out, self.most, self.old = work_out, most, {}

    def __missing__(self, key):
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        self[key] = value = self.work_out(key) if value is None else value
        return value


class Bpe:
    """A tokenizer file of the form: NFC, lower case, split by a pattern, byte letters, BPE
    with a suffix on a word's last byte, no decoder."""

    def __init__(self, spec: dict):
        self.spec = spec
        steps = [x["type"] for x in self.spec["normalizer"]["normalizers"]]
        split, level = self.spec["pre_tokenizer"]["pretokenizers"]
        plain = steps == ["NFC", "Replace", "Lowercase"] and split["invert"] and not level["use_regex"]
        if not plain or self.spec["decoder"] is not None or not self.spec["model"]["end_of_word_suffix"]:
            raise ValueError("a tokenizer of another form")

    @staticmethod
    def read(path: str) -> Bpe:
        with open(path, encoding="utf-8") as file:
            return Bpe(json.load(file))

    @cached_property
    def tokens(self) -> list[str]:
        """Token strings by id."""
        known = {**self.spec["model"]["vocab"], **{x["content"]: x["id"] for x in self.spec["added_tokens"]}}
        out = [""] * (max(known.values()) + 1)
        for token, number in known.items():
            out[number] = token
        return out

    @cached_property
    def _gapless(self) -> bool:
        return all(self.tokens)

    @cached_property
    def _start(self) -> tuple[list[int], list[int]]:
        """Id of each byte inside a word and at its end."""
        vocab, end = self.spec["model"]["vocab"], self.spec["model"]["end_of_word_suffix"]
        letters = byte_letters()
        return [vocab[x] for x in letters], [vocab[x + end] for x in letters]

    @cached_property
    def _merges(self) -> dict[tuple[int, int], int]:
        """(left id, right id) to the rank of the merge and, in the low bits, its id."""
        vocab, out = self.spec["model"]["vocab"], {}
        for rank, pair in enumerate(self.spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            out[vocab[left], vocab[right]] = rank << _ID_BITS | vocab[left + right]
        return out

    @cached_property
    def inside(self) -> tuple[frozenset[tuple[int, int]], frozenset[tuple[int, int]]]:
        """(byte, next byte) for all neighbours inside tokens: within a word, at its end."""
        byte = {x: b for b, x in enumerate(byte_letters())}
        end, within, ending = self.spec["model"]["end_of_word_suffix"], set(), set()
        for token in self.spec["model"]["vocab"]:
            last = token.endswith(end) and token != end
            data = [byte[x] for x in (token[:-len(end)] if last else token)]
            pairs = list(zip(data, data[1:]))
            if last and pairs:
                ending.add(pairs.pop())
            within.update(pairs)
        return frozenset(within), frozenset(ending)

    def fragments(self, word: bytes) -> list[tuple[bytes, bool]]:
        """``word`` cut at all certain cuts; the flag marks its end."""
        within, ending = self.inside
        begin, last, out = 0, len(word) - 1, []
        if within.issuperset(zip(word[:-2], word[1:-1])) and (last < 1 or (word[-2], word[-1]) in ending):
            return [(word, True)]
        for i, pair in enumerate(zip(word, word[1:])):
            if pair not in (ending if i + 1 == last else within):
                out.append((word[begin:i + 1], False))
                begin = i + 1
        return [*out, (word[begin:], True)]

    def _merged(self, fragment: tuple[bytes, bool]) -> tuple[int, ...]:
        data, ends = fragment
        inner, final = self._start
        ids = [inner[b] for b in data]
        if ends:
            ids[-1] = final[data[-1]]
        return tuple(self._merge_short(ids) if len(ids) <= _SHORT else self._merge_long(ids))

    def _merge_short(self, ids: list[int]) -> list[int]:
        merges = self._merges
        found = [merges.get(pair, _NO_MERGE) for pair in zip(ids, ids[1:])]
        while found and (best := min(found)) != _NO_MERGE:
            i = found.index(best)  # the leftmost of equal pairs
            ids[i:i + 2] = [best & _ID_MASK]
            del found[i]
            if i:
                found[i - 1] = merges.get((ids[i - 1], ids[i]), _NO_MERGE)
            if i < len(found):
                found[i] = merges.get((ids[i], ids[i + 1]), _NO_MERGE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same order of merges, from a heap over a linked list."""
        merges, count = self._merges, len(ids)
        following, previous = list(range(1, count + 1)), list(range(-1, count - 1))
        heap = []

        def offer(i: int) -> None:
            if 0 <= i and (j := following[i]) < count and (m := merges.get((ids[i], ids[j]))):
                heapq.heappush(heap, (m, i, ids[i], ids[j]))

        for i in range(count):
            offer(i)
        while heap:
            merge, i, left, right = heapq.heappop(heap)
            j = following[i]
            if j >= count or ids[i] != left or ids[j] != right:
                continue
            ids[i], ids[j], following[i] = merge & _ID_MASK, -1, following[j]
            if following[i] < count:
                previous[following[i]] = i
            offer(previous[i])
            offer(i)
        return [x for x in ids if x >= 0]

    @cached_property
    def _known_fragments(self) -> _Bounded:
        return _Bounded(self._merged, _FRAGMENTS)

    def _encode_word(self, word: str) -> bytes:
        """The ids as 32-bit numbers: compact to hold, and quick to join."""
        parts, known = self.fragments(word.encode()), self._known_fragments
        if len(parts) == 1:  # the word itself is looked up already
            return array("i", self._merged(parts[0])).tobytes()
        return array("i", chain.from_iterable(known[x] for x in parts)).tobytes()

    @cached_property
    def _known_words(self) -> _Bounded:
        return _Bounded(self._encode_word, _WORDS)

    @cached_property
    def _pattern(self) -> regex.Pattern:
        return regex.compile(self.spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])

    @cached_property
    def _narrow_pattern(self) -> re.Pattern:
        """The same for texts of characters below U+0100, with the classes written out."""
        pattern = self._pattern.pattern
        for name in (r"\p{L}", r"\p{N}", r"\s"):
            members = [chr(c) for c in range(256) if regex.fullmatch(name, chr(c))]
            pattern = pattern.replace(name, "".join(map(re.escape, members)))
        return re.compile(pattern)

    @cached_property
    def _special(self) -> tuple[regex.Pattern, dict[str, int]]:
        ids = {x["content"]: x["id"] for x in self.spec["added_tokens"]}
        longest = sorted(ids, key=len, reverse=True)
        return regex.compile("(" + "|".join(map(regex.escape, longest)) + ")"), ids

    def _plain(self, text: str) -> bytes:
        try:
            text.encode("latin-1")  # such texts are in NFC
            pattern = self._narrow_pattern
        except UnicodeEncodeError:
            # Each character is lower-cased by itself: no final form of sigma.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            pattern = self._pattern
        return b"".join(map(self._known_words.__getitem__, pattern.findall(text.lower())))

    def encode_array(self, text: str) -> np.ndarray:
        pattern, special = self._special
        data = self._plain(text) if not any(x in text for x in special) else b"".join(
            # Ordinary, special, ordinary, ...
            array("i", [special[x]]).tobytes() if i % 2 else self._plain(x) for i, x in enumerate(pattern.split(text))
        )
        return np.frombuffer(data, np.int32)

    def encode(self, text: str) -> list[int]:
        return self.encode_array(text).tolist()

    def decode(self, ids: list[int]) -> str:
        tokens = self.tokens
        if ids and not (min(ids) >= 0 and max(ids) < len(tokens) and self._gapless):
            ids = [i for i in ids if 0 <= i < len(tokens) and tokens[i]]
        return " ".join(map(tokens.__getitem__, ids))


def _column(values: list, kind: pa.DataType) -> pa.Array:
    if not pa.types.is_list(kind):
        return pa.array(values, kind)
    ends = np.cumsum([0, *map(len, values)])
    flat = np.concatenate([np.empty(0, np.int32), *values])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat), type=kind)


def _mapped(df: DataFrame, value: Column, carry: list[str] | None, tokenizer: Bpe, fresh: list[tuple[str, str]], work) -> DataFrame:
    """``row`` (see ``as_row``) and fresh columns that ``work`` makes of one value."""
    names = [n for n, _ in fresh]
    given = df.select(as_row(df, carry), value.alias("given"))
    made = StructType.fromDDL(", ".join(f"{name} {kind}" for name, kind in fresh))
    schema = StructType([given.schema["row"], *made])
    arrow = to_arrow_schema(schema)
    # A worker's copy also keeps the tables it builds, so its next tasks find them.
    shared = df.sparkSession.sparkContext.broadcast({"spec": tokenizer.spec})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        if "ready" not in own:
            own["ready"] = Bpe(own["spec"])
        for whole in batches:
            for at in range(0, whole.num_rows, _BATCH):
                batch = whole.slice(at, _BATCH)
                done = [work(own["ready"], x.as_py()) for x in batch.column(1)]
                columns = [_column([d[i] for d in done], arrow.field(n).type) for i, n in enumerate(names)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], schema=arrow)

    return given.mapInArrow(run, schema)


def encoded(docs: DataFrame, tokenizer: Bpe, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``row`` and the token ``ids`` of ``text``."""
    return _mapped(docs, F.col(f"`{text}`"), carry, tokenizer, [("ids", "array<int>")], lambda t, x: (t.encode_array(x or ""),))


def decoded(docs: DataFrame, tokenizer: Bpe, ids: str = "ids", carry: list[str] | None = None) -> DataFrame:
    """``row`` and ``decoded``, the text that ``ids`` stand for."""
    return _mapped(docs, F.col(f"`{ids}`"), carry, tokenizer, [("decoded", "string")], lambda t, x: (t.decode(x or []),))


def there_and_back(docs: DataFrame, tokenizer: Bpe, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``row``, ``ids`` and what they decode to (``decoded``), in one pass."""
    def work(t: Bpe, x: str | None) -> tuple[np.ndarray, str]:
        ids = t.encode_array(x or "")
        return ids, t.decode(ids.tolist())

    return _mapped(docs, F.col(f"`{text}`"), carry, tokenizer, [("ids", "array<int>"), ("decoded", "string")], work)
