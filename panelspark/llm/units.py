"""Cutting text where a byte-level BPE pattern always cuts, and encoding each distinct piece once a worker.

The public pattern puts a single space before a word into that word's token and nothing else crosses it, so the place before a
space that stands between two other characters is a token border; so are both sides of a newline that stands alone, and the
place between letters and the marks that end a piece. Encoding the pieces and joining the ids is encoding the text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import hold

_RUN = re.compile(r"\s\s")
_BORDER = re.compile(r"(?<=\S)(?= \S)")
#: Marks that end a word as a piece of their own: all of ASCII but the apostrophe, which opens endings such as 's.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def units(text: str) -> list[str]:
    """Pieces of text, in order, that a byte-level BPE encodes independently. Empty text: none."""
    if not text:
        return []
    if text[-1] != " " and text[0] != " " and _RUN.search(text) is None:
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]]
    return _BORDER.split(text)


class Cache:
    """bytes of ids by piece, about ``most`` short pieces; what has not been met since the younger half began goes when that is full, which costs time and nothing else.

    A key is a word that has a space before it, a newline, or BARE and a piece as it stands. The words of a batch are split and told apart by Arrow; only the distinct ones are looked up.
    """

    BARE = "\x01"

    def __init__(self, encode: Callable[[list[str]], Iterable[bytes]], encode_words: Callable[[list[str], bool], list[bytes]], most: int = 400_000, longest: int = 64):
        self.encode, self.encode_words, self.most, self.longest = encode, encode_words, most, longest
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _simple(self, t: str) -> bool:
        """Whether every space of t stands between two other characters, so that splitting at spaces and newlines gives its pieces."""
        return t[-1] != " " and t[0] != " " and _RUN.search(t) is None and self.BARE not in t

    def texts(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, 4 little-endian bytes an id."""
        bare = self.BARE
        plain = [f"{bare}{t}" if t and self._simple(t) else "" for t in texts]
        spaced = pc.replace_substring(pa.array(plain, pa.large_string()), "\n", f" \n {bare}")  # a text's end after a newline is a lone BARE
        words = pc.split_pattern(spaced, " ")
        odd = [[bare + u for u in _BORDER.split(t)] if t and not p else [] for t, p in zip(texts, plain)]
        flat, ends = words.flatten(), words.offsets.to_numpy()[1:]
        told = pa.concat_arrays([flat, pa.array([k for ks in odd for k in ks], pa.large_string())]).dictionary_encode()
        found = pa.array(self._look_up(told.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(told.indices)
        _, starts, data = found.buffers()
        at, data = np.frombuffer(starts, np.int64, len(found) + 1).tolist(), memoryview(data or b"")
        out, first, rest = [], 0, len(flat)
        for p, end, ks in zip(plain, ends.tolist(), odd):
            out.append(bytes(data[at[first] : at[end]]) if p else bytes(data[at[rest] : at[rest + len(ks)]]))
            first, rest = end, rest + len(ks)
        return out

    def _look_up(self, keys: list[str]) -> list[bytes]:
        """Ids of distinct keys, learned where they are new. Long keys are not kept."""
        if len(self.known) > self.most // 2:
            self.known, self.older = {}, self.known
        known = self.known
        ids = list(map(known.get, keys))
        at = [i for i, v in enumerate(ids) if v is None]
        for i, v in zip(at, map(self.older.get, [keys[i] for i in at])):
            if v is not None:
                known[keys[i]] = ids[i] = v
        at = [i for i in at if ids[i] is None]
        self._learn([keys[i] for i in at])
        for i in at:
            ids[i] = known[keys[i]]
            if len(keys[i]) > self.longest:
                del known[keys[i]]
        return ids

    def _learn(self, missing: list[str]) -> None:
        known, bare = self.known, self.BARE
        plain, opening, marked, odd, more = [], [], [], [], set()
        for w in missing:
            if w.isalpha():
                plain.append(w)
                continue
            body = w.rstrip(_MARKS)
            if body.isalpha():
                marked.append((w, body, bare + w[len(body) :]))
            elif body[:1] == bare and body[1:].isalpha():
                if body == w:
                    opening.append(w)
                else:
                    marked.append((w, body, bare + w[len(body) :]))
            elif w == bare or not w:
                known[w] = b""
            else:
                odd.append(w)
        here = {*plain, *opening}
        for _, body, tail in marked:
            if body not in known and body not in here:
                here.add(body)
                (opening if body[0] == bare else plain).append(body)
            more.add(tail)
        odd += more.difference(known, odd)
        known.update(zip(plain, self.encode_words(plain, False)))
        known.update(zip(opening, self.encode_words([w[1:] for w in opening], True)))
        known.update(zip(odd, self.encode([k[1:] if k[0] == bare else k if k == "\n" else " " + k for k in odd])))
        for w, body, tail in marked:
            known[w] = known[body] + known[tail]


def tokenizer_cache(json_text: str, most: int = 400_000) -> Cache:
    """The worker's cache for a tokenizers JSON, of about ``most`` pieces; workers live on between tasks."""

    def make() -> Cache:
        import gc
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        gc.freeze()  # what stays: else the collector walks the cache again and again
        gc.set_threshold(200_000, 50, 1000)
        from tokenizers import Tokenizer

        tok = Tokenizer.from_str(json_text)
        tok.encode_special_tokens = True  # their strings in a text are ordinary text

        def encode(us: list[str]) -> Iterable[bytes]:
            for at in range(0, len(us), 20_000):
                for e in tok.encode_batch_fast(us[at : at + 20_000], add_special_tokens=False):
                    yield np.array(e.ids, "<u4").tobytes()

        vocabulary = tok.get_vocab()
        opens = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that begin with a space: here, the first of each word
        for token, i in vocabulary.items():
            opens[i] = token.startswith("\u0120")

        newline = vocabulary["\u010a"]

        def encode_words(words: list[str], bare: bool) -> list[bytes]:
            """Words of letters, some dozens in one text. Each after a space: its ids begin with the one that holds the space; bare: after a newline, whose id stands between them."""
            out: list[bytes] = []
            batches = [words[at : at + 50] for at in range(0, len(words), 50)]
            for some, e in zip(batches, tok.encode_batch_fast(["\n" + "\n".join(b) if bare else " " + " ".join(b) for b in batches], add_special_tokens=False)):
                ids = np.array(e.ids, "<u4")
                starts = np.flatnonzero(ids == newline if bare else opens[ids])
                if len(starts) == len(some):
                    raw, at, skip = ids.tobytes(), [*(4 * starts).tolist(), 4 * len(ids)], 4 * bare
                    out += [raw[a + skip : z] for a, z in zip(at, at[1:])]
                else:
                    out += encode([w if bare else " " + w for w in some])
            return out

        return Cache(encode, encode_words, most)

    return hold("tokens", (hash(json_text), most), make)


def slices(batch, column: str, most_bytes: int = 4_000_000):
    """Parts of an Arrow batch of about most_bytes of text; a longer text is a part of its own."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    at = held = 0
    for i, n in enumerate(sizes):
        if i > at and held + n > most_bytes:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    if len(sizes) > at:
        yield batch.slice(at)
