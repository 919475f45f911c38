"""BPE encoding and decoding by forced-boundary splitting.

A pair of neighbouring byte symbols that stands inside no vocabulary token can never be joined by a merge, nor can any
longer token span it: between its two symbols there is a certain cut. Words are cut there, the fragments are encoded
independently (each distinct one once per worker), and their ids are concatenated.

Rows: a null text counts as empty (no ids); an empty text has no ids; texts of any length are encoded whole, long
fragments with a heap in n log n; repeated rows give repeated results; an empty table gives an empty one; other columns
are passed through by `encode`, under whatever name they have.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType
from tokenizers import Tokenizer

from .common import extended, table

#: Entries of a worker's word and fragment caches, and the longest string that they keep: together a bound on memory.
CACHE_ENTRIES, CACHE_LENGTH = 400_000, 40
#: Symbols up to which the plain merge loop is used.
SHORT = 40
#: Above every merge's rank.
NEVER = 1 << 62


@lru_cache(maxsize=1)
def newer_characters() -> re.Pattern:
    """Code points that Python's Unicode data don't know; letters and cases among them are left to the library."""
    unknown = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cn"]
    starts = [c for i, c in enumerate(unknown) if not i or unknown[i - 1] != c - 1]
    ends = [c for i, c in enumerate(unknown) if i + 1 == len(unknown) or unknown[i + 1] != c + 1]
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends, strict=True)) + "]")


def byte_alphabet() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte: printable Latin-1 bytes stand for
    themselves, the others take code points from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in printable)
    spare = {b: 256 + i for i, b in enumerate(rest)}
    return [chr(spare.get(b, b)) for b in range(256)]


def is_latin1(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class _Words(dict):
    """Word -> its ids as bytes. Full or long ones are computed and not kept."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(word)
        if len(word) <= CACHE_LENGTH:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[word] = ids
        return ids


class ForcedBoundaryBPE:
    """A byte-level BPE vocabulary of the `tokenizers` JSON form."""

    def __init__(self, spec: dict):
        model = spec["model"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("only plain byte-level BPE vocabularies are read")
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.tokens = {i: t for t, i in self.vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.steps, self.pattern = self._normal_steps(spec["normalizer"]), self._split_pattern(spec["pre_tokenizer"])
        self.library, self.newer = Tokenizer.from_str(json.dumps(spec)), newer_characters()
        if spec.get("decoder") is not None:
            raise ValueError("only vocabularies without a decoder are decoded")
        alphabet = byte_alphabet()
        self.alphabet = {b: c for b, c in enumerate(alphabet)}
        self.to_symbols = {b: self.vocab.get(c, -1) for b, c in enumerate(alphabet)}
        self.to_last = {b: self.vocab.get(c + self.suffix, -1) for b, c in enumerate(alphabet)}
        # left id << 24 | right id -> rank << 24 | joined id
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[self.vocab[left] << 24 | self.vocab[right]] = rank << 24 | self.vocab[left + right]
        # Pairs of bytes that stand side by side inside some token; a pair's second byte may be the word's last.
        back = {c: b for b, c in enumerate(alphabet)}
        inside, inside_last = np.zeros((256, 256), bool), np.zeros((256, 256), bool)
        for token in self.vocab:
            last = bool(self.suffix) and token.endswith(self.suffix)
            body = [back.get(c) for c in (token[: -len(self.suffix)] if last else token)]
            for i, (x, y) in enumerate(zip(body, body[1:], strict=False)):
                if x is not None and y is not None:
                    (inside_last if last and i == len(body) - 2 else inside)[x, y] = True
        self.cut, self.cut_last = (~inside).tobytes(), (~inside_last if self.suffix else ~inside).tobytes()
        self.fragments: dict[tuple[bytes, bool], bytes] = {}
        self.words = _Words(self._encode_word)

    @staticmethod
    def _normal_steps(spec: dict | None) -> list:
        steps = []
        for part in spec["normalizers"] if spec and spec["type"] == "Sequence" else [spec] if spec else []:
            if part["type"] in ("NFC", "NFD", "NFKC", "NFKD"):
                steps.append(lambda t, form=part["type"]: t if unicodedata.is_normalized(form, t) else unicodedata.normalize(form, t))
            elif part["type"] == "Replace":
                if "Regex" in part["pattern"]:
                    steps.append(lambda t, p=regex.compile(part["pattern"]["Regex"]), c=part["content"]: p.sub(c, t))
                else:
                    steps.append(lambda t, p=part["pattern"]["String"], c=part["content"]: t.replace(p, c))
            elif part["type"] == "Lowercase":
                steps.append(lambda t: t.replace("Σ", "σ").lower())  # letter by letter: no final sigma
            else:
                raise ValueError(f"normalizer {part['type']} is not known")
        return steps

    @staticmethod
    def _split_pattern(spec: dict):
        parts = spec["pretokenizers"] if spec["type"] == "Sequence" else [spec]
        split = [p for p in parts if p["type"] == "Split"]
        level = [p for p in parts if p["type"] == "ByteLevel"]
        if len(split) != 1 or not split[0]["invert"] or split[0]["behavior"] != "Removed" or len(level) != 1 or level[0]["add_prefix_space"] or level[0]["use_regex"]:
            raise ValueError("only vocabularies that keep the matches of one pattern are read")
        return regex.compile(split[0]["pattern"]["Regex"])

    # encoding

    def pieces(self, text: str) -> Iterator[tuple[str, int | None]]:
        """Runs of plain text, and special tokens with their ids."""
        at = 0
        for m in self.split_special.finditer(text) if self.split_special else ():
            if m.start() > at:
                yield text[at : m.start()], None
            yield m[0], self.special[m[0]]
            at = m.end()
        if at < len(text):
            yield text[at:], None

    def encode(self, text: str | None) -> np.ndarray:
        out = []
        for piece, special in self.pieces(text or ""):
            if special is not None:
                out.append(np.uint32(special).tobytes())
                continue
            out.extend(map(self.words.__getitem__, self.split_words(piece)))
        return np.frombuffer(b"".join(out), dtype="<u4")

    def split_words(self, piece: str) -> list[str]:
        if not is_latin1(piece) and self.newer.search(piece):
            back = {c: b for b, c in self.alphabet.items()}
            split = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(piece))
            return [bytes(back[c] for c in w).decode("utf-8") for w, _ in split]
        for step in self.steps:
            piece = step(piece)
        return self.pattern.findall(piece)

    def _encode_word(self, word: str) -> bytes:
        raw = word.encode("utf-8")
        bounds = self.fragment_bounds(raw)
        if len(bounds) == 1:
            return self._encode_symbols(raw, True)  # the word cache keeps it
        return b"".join(self._encode_fragment(raw[a:b], b == len(raw)) for a, b in bounds)

    def fragment_bounds(self, raw: bytes) -> list[tuple[int, int]]:
        """Where a word's bytes are certain to be cut."""
        n, cut = len(raw), self.cut
        at = [i for i in range(1, n - 1) if cut[raw[i - 1] << 8 | raw[i]]]
        if n > 1 and self.cut_last[raw[-2] << 8 | raw[-1]]:
            at.append(n - 1)
        return list(zip([0, *at], [*at, n], strict=True))

    def _encode_fragment(self, raw: bytes, last: bool) -> bytes:
        if (ids := self.fragments.get((raw, last))) is None:
            ids = self._encode_symbols(raw, last)
            if len(raw) <= CACHE_LENGTH:
                if len(self.fragments) >= CACHE_ENTRIES:
                    self.fragments.clear()
                self.fragments[raw, last] = ids
        return ids

    def _encode_symbols(self, raw: bytes, last: bool) -> bytes:
        symbols = [self.to_symbols[b] for b in raw]
        if last and self.suffix:
            symbols[-1] = self.to_last[raw[-1]]
        symbols = [s for s in symbols if s >= 0]  # a byte without a token is passed over: there is no unknown token
        ids = self._merge(symbols) if len(symbols) <= SHORT else self._merge_long(symbols)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _merge(self, s: list[int]) -> list[int]:
        get = self.merges.get
        best = [get(a << 24 | b, NEVER) for a, b in zip(s, s[1:], strict=False)]
        while best and (m := min(best)) < NEVER:
            i = best.index(m)
            s[i] = m & 0xFFFFFF
            del s[i + 1], best[i]
            if i:
                best[i - 1] = get(s[i - 1] << 24 | s[i], NEVER)
            if i < len(best):
                best[i] = get(s[i] << 24 | s[i + 1], NEVER)
        return s

    def _merge_long(self, s: list[int]) -> list[int]:
        get, n = self.merges.get, len(s)
        left, right, alive = [*range(-1, n - 1)], [*range(1, n + 1)], [True] * n
        heap = [(m >> 24, i, m, s[i], s[i + 1]) for i in range(n - 1) if (m := get(s[i] << 24 | s[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, m, a, b = heapq.heappop(heap)
            if not alive[i] or s[i] != a or (j := right[i]) >= n or s[j] != b:
                continue
            s[i], alive[j], right[i] = m & 0xFFFFFF, False, right[j]
            if right[i] < n:
                left[right[i]] = i
                if (m := get(s[i] << 24 | s[right[i]])) is not None:
                    heapq.heappush(heap, (m >> 24, i, m, s[i], s[right[i]]))
            if left[i] >= 0 and (m := get(s[left[i]] << 24 | s[i])) is not None:
                heapq.heappush(heap, (m >> 24, left[i], m, s[left[i]], s[i]))
        return [x for x, on in zip(s, alive, strict=True) if on]

    # decoding

    def decode(self, ids: Iterable[int]) -> str:
        """The tokens' strings between spaces: this vocabulary's file names no decoder."""
        return " ".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def _vocabulary(spec: str) -> ForcedBoundaryBPE:
    return ForcedBoundaryBPE(json.loads(spec))


def load(path: str) -> ForcedBoundaryBPE:
    with open(path, encoding="utf-8") as f:
        return ForcedBoundaryBPE(json.load(f))


def encode(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """df with the ids of its texts, as an array column, which replaces one of that name. vocabulary: path of a `tokenizers` JSON file on the driver."""
    return _mapped(df.drop(ids), vocabulary, [(ids, "array<bigint>", pa.list_(pa.int64()))], lambda v, texts: [[v.encode(t).tolist() for t in texts]], [text], keep=True)


def decode(df: DataFrame, vocabulary: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """df with the decoded ids, as a string column, which replaces one of that name; null ids count as none."""
    return _mapped(df.drop(text), vocabulary, [(text, "string", pa.string())], lambda v, lists: [[v.decode(x or ()) for x in lists]], [ids], keep=True)


def round_trip(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes and decodes in one pass; per row the key, the number of ids, and digests of the ids and of the decoded text."""

    def run(v, texts):
        n, ids_digest, text_digest = [], [], []
        for t in texts:
            x = v.encode(t)
            n.append(len(x))
            ids_digest.append(hashlib.sha256(x.tobytes()).hexdigest())
            text_digest.append(hashlib.sha256(v.decode(x.tolist()).encode("utf-8")).hexdigest())
        return [n, ids_digest, text_digest]

    out = [("n_tokens", "bigint", pa.int64()), ("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())]
    return _mapped(df.select(key, text), vocabulary, out, run, [text], keep=False)


def _mapped(df: DataFrame, vocabulary: str, out: list, run, of: list[str], keep: bool) -> DataFrame:
    with open(vocabulary, encoding="utf-8") as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())  # the file's size, a few MB, bounds it
    kept = [f for f in df.schema.fields if keep or f.name not in of]
    schema = extended(StructType(kept), ", ".join(f"`{n}` {t}" for n, t, _ in out))

    def batches(it):
        v = _vocabulary(spec.value)
        for whole in it:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                made = run(v, b.column(b.schema.get_field_index(of[0])).to_pylist())
                columns = [b.column(b.schema.get_field_index(f.name)) for f in kept] + [pa.array(x, t) for x, (_, _, t) in zip(made, out, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in kept] + [n for n, _, _ in out])

    return df.mapInArrow(batches, schema)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
