"""Token ids of a public tokenizer, by way of distinct segments of a batch of texts.

The byte-level pre-tokenizer never lets a token span a space that follows a non-blank,
nor a line feed between two non-blanks, so a text may be cut there and its segments
encoded on their own. Segments are found and told apart in arrays, each distinct one of
a batch is looked up or encoded once, and a worker keeps the ids of those it has met
before. Files of another kind (other pre-tokenizers, normalizers) encode whole texts.
"""
from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A cache of this many segments becomes the old one, and a new one begins.
MOST_KEPT = 120_000
#: Bytes that tell which segments were met once, by a digest; most never come again.
_MET = 1 << 21
#: Bytes of texts whose segments are told apart at a time.
_SPAN = 2 << 20
#: Words that the model encodes at a time.
_JOINED = 64
#: Segments of more bytes are told apart by Python's hash.
_SHORT = 32
#: Latin letters, after a space or not.
_WORD = re.compile(" ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f]+")
#: Bytes of Latin letters (U+00C0 to U+023F, two signs among them); of ASCII letters and
#: digits; of marks but the apostrophe, which begins contractions.
_LETTER, _PLAIN, _MARK = (np.zeros(256, bool) for _ in range(3))
_LETTER[[b for b in range(128) if chr(b).isalpha()] + [*range(0x80, 0xC0), *range(0xC3, 0xC9)]] = True
_PLAIN[[b for b in range(128) if chr(b).isalnum()]] = True
_MARK[[b for b in range(33, 127) if not chr(b).isalnum() and b != 39]] = True


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_names() -> dict[int, str]:
    """What byte-level vocabularies call each byte: printable Latin-1 characters stand
    for themselves, all others for 256 and on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def _may_cut(tokenizer) -> bool:
    """Whether the file is of the kind whose texts may be cut into segments."""
    made = json.loads(tokenizer.to_str())
    before, model = made["pre_tokenizer"] or {}, made["model"]
    return (
        before.get("type") == "ByteLevel"
        and before.get("use_regex", True)
        and not before.get("add_prefix_space")
        and not made["normalizer"]
        and model["type"] == "BPE"
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        and not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in made["added_tokens"])
    )


def _solid_before(b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends before each place is surely no blank."""
    one, two, three = (np.where(at >= k, b[np.maximum(at - k, 0)], 32) for k in (1, 2, 3))
    ascii_ = (one > 32) & (one < 127)
    lead = np.where(two >= 0xC0, two, np.where(three >= 0xC0, three, 0xF0))
    return ascii_ | (one >= 0x80) & (lead != 0xC2) & (lead != 0xE1) & (lead != 0xE2) & (lead != 0xE3)


def _solid_after(b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that begins behind each place is surely no blank."""
    own = b[np.minimum(at + 1, len(b) - 1)]
    solid = (own > 32) & (own < 127) | (own >= 0xC3) & (own != 0xE1) & (own != 0xE2) & (own != 0xE3)
    return (at + 1 < len(b)) & solid


def segments(b: np.ndarray, starts: np.ndarray, at_marks: bool) -> np.ndarray:
    """Places in ``b``, texts that begin at ``starts``, where segments begin; with
    ``at_marks`` also between a letter or digit and a mark."""
    spaces, feeds = np.flatnonzero(b == 32), np.flatnonzero(b == 10)
    spaces = spaces[_solid_before(b, spaces)]
    feeds = feeds[_solid_before(b, feeds) & _solid_after(b, feeds)]
    edge = np.zeros(len(b) + 1, bool)
    for places in (starts, spaces, feeds, feeds + 1):
        edge[places] = True
    if at_marks:
        marks = np.flatnonzero(_MARK[b])
        one, two = b[np.maximum(marks - 1, 0)], b[np.maximum(marks - 2, 0)]
        latin = (two == 0xC3) & (one >= 0x80) & (one != 0x97) & (one != 0xB7)
        edge[marks[_PLAIN[one] | latin]] = True
    return np.flatnonzero(edge[:-1])


_SEED = np.uint64(int.from_bytes(os.urandom(8), "little") | 1)


def _digests(b: np.ndarray, first: np.ndarray, size: np.ndarray, raw: bytes) -> np.ndarray:
    """A digest of each segment, with a seed of this process."""
    out = size.astype(np.uint64) * _SEED
    active = np.flatnonzero(size <= _SHORT)
    for j in range(_SHORT):
        active = active[size[active] > j]
        if not len(active):
            break
        x = (out[active] ^ b[first[active] + j]) * _SEED
        out[active] = x ^ (x >> np.uint64(29))
    for i in np.flatnonzero(size > _SHORT).tolist():
        out[i] = np.uint64(hash(raw[first[i] : first[i] + size[i]]) & 0xFFFFFFFFFFFFFFFF)
    return out


class Encoder:
    """Encodes texts with a file of the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        self._cut = _may_cut(self._tokenizer)
        self._names = _byte_names()
        self._space = self._names[32]
        self._code = "H" if self._tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self._kind = np.dtype(self._code)
        self._new: dict[bytes, bytes] = {}
        self._old: dict[bytes, bytes] = {}
        self._added = [t.content.encode() for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._met = bytearray(_MET)
        names = self._tokenizer.get_vocab()
        #: Which ids begin with a space. Where no token of letters has one behind a letter, no
        #: merge crosses the space before a word, and many words can be encoded as one.
        self._begins = np.zeros(max(names.values(), default=0) + 1, bool)
        self._begins[[i for t, i in names.items() if t.startswith(self._space)]] = True
        letter = "[" + "".join(self._names[i] for i in np.flatnonzero(_LETTER)) + "]"
        self._joins = self._cut and not any(re.fullmatch(f"({self._space}|{letter})*{letter}{self._space}({self._space}|{letter})*", t) for t in names)

    def _packed(self, ids: list[int]) -> bytes:
        return array(self._code, ids).tobytes()

    def _learn(self, key: bytes) -> bytes:
        """The ids of a segment. Letters alone are one word of the model."""
        if (key[1:] if key[0] == 32 else key).isalpha() and self._cut:  # letters stand for themselves
            segment = key.decode("latin-1")
            named = self._space + segment[1:] if key[0] == 32 else segment
        else:
            segment = key.decode("utf-8", "surrogatepass")
            if not self._cut or not _WORD.fullmatch(segment):
                return self._packed(self._tokenizer.encode(segment, add_special_tokens=False).ids)
            named = key.decode("latin-1").translate(self._names)
        return self._packed([t.id for t in self._model.tokenize(named)])

    def _learned(self, keys: list[bytes], plain: list[bool]) -> list[bytes]:
        """The ids of segments, those that are plain by many at a time."""
        out = [b""] * len(keys)
        for i, p in enumerate(plain):
            if not p:
                out[i] = self._learn(keys[i])
        words = [i for i, p in enumerate(plain) if p]
        for at in range(0, len(words), _JOINED):
            own = words[at : at + _JOINED]
            named = b"".join([keys[i] for i in own]).decode("latin-1").translate(self._names)
            ids = np.array([t.id for t in self._model.tokenize(named)], self._kind)
            first = np.flatnonzero(self._begins[ids])
            raw, edges = ids.tobytes(), (np.append(first, len(ids)) * ids.itemsize).tolist()
            if len(first) != len(own):  # a file in which a space stands in no token
                for i in own:
                    out[i] = self._learn(keys[i])
                continue
            for i, a, z in zip(own, edges, edges[1:]):
                out[i] = raw[a:z]
        return out

    def _found(self, keys: list[bytes], plain: np.ndarray) -> list[bytes]:
        """The ids of distinct segments; those met before are kept. ``plain``: whether one is
        Latin letters after a space, in a file that lets many be encoded as one."""
        new, old, met = self._new, self._old, self._met
        parts = list(map(new.get, keys))
        missed = [i for i, part in enumerate(parts) if part is None]
        unknown = []
        for i in missed:
            part = old.get(keys[i])
            if part is None:
                unknown.append(i)
            else:
                new[keys[i]] = parts[i] = part
        for i, part in zip(unknown, self._learned([keys[i] for i in unknown], plain[unknown].tolist())):
            parts[i], place = part, hash(keys[i]) % _MET
            if met[place]:
                new[keys[i]] = part
            else:
                met[place] = 1
        if len(new) > MOST_KEPT:
            self._old, self._new, self._met = new, {}, bytearray(_MET)
        return parts

    def _encode(self, raw: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends = np.cumsum(sizes)
        b, starts = np.frombuffer(raw, np.uint8), (ends - sizes)[sizes > 0]
        first = segments(b, starts, not any(t in raw for t in self._added)) if self._cut else starts
        size = np.diff(np.append(first, len(b)))
        _, at, which = np.unique(_digests(b, first, size, raw), return_index=True, return_inverse=True)
        other = np.zeros(len(b) + 1, np.int32)
        np.cumsum(~_LETTER[b], out=other[1:])
        if len(b) > 1:  # the two signs among the letters
            other[2:] += np.cumsum((b[:-1] == 0xC3) & ((b[1:] == 0x97) | (b[1:] == 0xB7)), dtype=np.int32)
        own, end = first[at], first[at] + size[at]
        plain = (b[own] == 32) & (size[at] > 1) & (other[end] == other[np.minimum(own + 1, end)]) & self._joins
        parts = self._found([raw[a:z] for a, z in zip(own.tolist(), end.tolist())], plain)
        held = np.fromiter(map(len, parts), np.int64, len(parts)) // self._kind.itemsize
        flat = np.frombuffer(b"".join(parts), self._kind)
        counts = held[which]
        before = np.zeros(len(which) + 1, np.int64)
        np.cumsum(counts, out=before[1:])
        place = np.repeat((np.cumsum(held) - held)[which] - before[:-1], counts) + np.arange(before[-1])
        return flat[place].astype(np.uint32), np.diff(before[np.append(0, np.searchsorted(first, ends))])

    def encode(self, texts: list[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other (uint32), and the number of ids of each text."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ids, counts, at = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], 0
        ends = np.cumsum(sizes)
        while at < len(sizes):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _SPAN, side="right")))
            raw = b"".join(x for x in column.slice(at, end - at).cast(pa.binary()).to_pylist() if x)
            for out, found in zip((ids, counts), self._encode(raw, sizes[at:end]) if raw else (ids[0], np.zeros(end - at, np.int64))):
                out.append(found)
            at = end
        return np.concatenate(ids), np.concatenate(counts)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def release() -> None:
    """Forgets the encoders of this worker, whose caches other operators have no use for."""
    _ENCODERS.clear()
