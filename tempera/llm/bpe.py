"""BPE encoding and decoding with a public vocabulary, exact to the id.

The encoding of every prefix of a piece ends with one token only. An automaton over the vocabulary
lists the tokens that end at each place; of these the right one is the one that may follow the last
token of the prefix before it: merging the symbols of the two alone gives back just these two. Each
prefix stores its last token, and the back-pointers from the end give the ids. No merge is ever
replayed over a whole text, and a piece of any length takes time in proportion to it.

Normalising (NFC, lower case) and cutting into pieces follow the vocabulary file. Plain Latin text,
where all versions of Unicode agree, is cut by white space and the file's pattern; for any other
text the file's own normaliser and splitter run.

Defined cases: a null or empty text has no ids and decodes to an empty text; strings of special
tokens inside a text become their ids; repeated rows are rows of their own; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tempera.llm.common import CACHES, mapped

#: The characters that stand for bytes in byte-level vocabularies are those of the
#: printable ranges below; the other bytes follow from 256 on.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_PLAIN = re.compile("[\t\n\r -~¡-įı-ſ]*")  # no combining marks, one kind of case
_FINAL = 0x400  # added to the character that ends a piece
CACHED_CHUNK, CACHED_CHUNKS = 64, 200_000  # longest chunk and most chunks that a worker remembers


def _byte_chars() -> list[str]:
    others = iter(range(256, 512))
    return [chr(b) if b in set(_PRINTABLE) else chr(next(others)) for b in range(256)]


class Tokenizer:
    """A vocabulary file of byte-level BPE whose pieces may end with a suffix of their own."""

    def __init__(self, path: str):
        import ahocorasick
        import regex
        from tokenizers import Tokenizer as Library
        from tokenizers import pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"]["pretokenizers"][0]
        self.suffix, vocab = model["end_of_word_suffix"] or "", model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.texts = {i: t for t, i in (vocab | self.special).items()}
        self.symbols = {i: self._symbols(t) for t, i in vocab.items()}
        of = {s: i for i, s in self.symbols.items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merges = {(a := self._symbols(x), b := self._symbols(y)): (rank, a + b) for rank, (x, y) in enumerate(pairs)}
        self.automaton = ahocorasick.Automaton()
        for s, i in of.items():
            self.automaton.add_word(s, (i, len(s)))
        self.automaton.make_automaton()
        self.bytes = [*_byte_chars()]
        self.piece = regex.compile(split["pattern"]["Regex"])
        library = Library.from_file(path)
        self.normalise = library.normalizer.normalize_str
        from tokenizers import Regex

        self.split = pre_tokenizers.Split(Regex(split["pattern"]["Regex"]), "removed", invert=True).pre_tokenize_str
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.follows: dict[tuple[int, int], bool] = {}
        self.chunks: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _symbols(self, token: str) -> str:
        """A token as characters, its last one marked where the token ends a piece."""
        if self.suffix and token.endswith(self.suffix):
            body = token[: -len(self.suffix)]
            return body[:-1] + chr(ord(body[-1]) + _FINAL)
        return token

    def _merged(self, symbols: str) -> list[str]:
        """Plain BPE of a few symbols: the least rank first, the leftmost of equals."""
        parts = list(symbols)
        while True:
            ranked = [(m[0], i) for i in range(len(parts) - 1) if (m := self.merges.get((parts[i], parts[i + 1])))]
            if not ranked:
                return parts
            i = min(ranked)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def compatible(self, a: int, b: int) -> bool:
        """Whether token b may stand right after token a, or at the start (a = -1)."""
        x, y = self.symbols.get(a, ""), self.symbols[b]
        if len(self.follows) >= 2 * CACHED_CHUNKS:
            self.follows.clear()
        found = self.follows[a, b] = self._merged(x + y) == ([x, y] if x else [y])
        return found

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one piece, by its prefixes."""
        chars = [self.bytes[b] for b in piece.encode()]
        if self.suffix:
            chars[-1] = chr(ord(chars[-1]) + _FINAL)
        last = [-2] * (len(chars) + 1)  # the last token of each prefix; -2: not known
        last[0] = -1
        follows = self.follows
        for end, (token, length) in self.automaton.iter("".join(chars)):
            if last[end + 1] != -2 or (before := last[end + 1 - length]) == -2:
                continue
            fits = follows.get((before, token))
            if fits or (fits is None and self.compatible(before, token)):
                last[end + 1] = token
        ids, at = [], len(chars)
        while at:
            ids.append(last[at])
            at -= len(self.symbols[last[at]])
        return ids[::-1]

    def _packed(self, pieces: list[str]) -> bytes:
        """The ids of pieces as bytes; short pieces are remembered."""
        known, out = self.pieces, []
        for p in pieces:
            found = known.get(p)
            if found is None:
                found = array("I", self.encode_piece(p)).tobytes()
                if len(p) <= CACHED_CHUNK:
                    if len(known) >= CACHED_CHUNKS:
                        known.clear()
                    known[p] = found
            out.append(found)
        return b"".join(out)

    def _chunk(self, chunk: str) -> bytes:
        found = self._packed(self.piece.findall(chunk))
        if len(chunk) <= CACHED_CHUNK:
            if len(self.chunks) >= CACHED_CHUNKS:
                self.chunks.clear()
            self.chunks[chunk] = found
        return found

    def _plain(self, text: str) -> list[bytes]:
        if not _PLAIN.fullmatch(text):
            return [self._packed([p for p, _ in self.split(self.normalise(text))])]
        known = self.chunks
        return [known[c] if c in known else self._chunk(c) for c in text.lower().split()]

    def encode(self, text: str | None) -> np.ndarray:
        text, parts = text or "", []
        if self.cut and "<" in text:
            for k, part in enumerate(self.cut.split(text)):
                parts += [np.uint32(self.special[part]).tobytes()] if k % 2 else self._plain(part)
        else:
            parts = self._plain(text)
        return np.frombuffer(b"".join(parts), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """The file names no decoder: the tokens, special ones too, with a space between."""
        return " ".join(map(self.texts.__getitem__, ids.tolist()))


_LOADED: dict[str, Tokenizer] = {}
CACHES.append(_LOADED.clear)


def tokenizer(path: str) -> Tokenizer:
    """The vocabulary at ``path``, loaded once a worker."""
    if path not in _LOADED:
        _LOADED[path] = Tokenizer(path)
    return _LOADED[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_documents(docs: DataFrame, path: str | None = None, digests: bool = False) -> DataFrame:
    """Ids and decoded text of every whole text: ``doc_id, n_tokens, ids, decoded``; with
    ``digests`` their hashes in their place (``ids_sha256`` of the ids as little-endian unsigned
    32-bit integers, ``decoded_sha256`` of the text in UTF-8), so that neither leaves the task."""
    path = path or default_path()
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), *([("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] if digests else [("ids", pa.list_(pa.int32())), ("decoded", pa.string())])])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = t.encode(text.as_py())
                decoded = t.decode(ids)
                if digests:
                    out.append((doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
                else:
                    out.append((doc_id, len(ids), ids.astype(np.int32), decoded))
            columns = zip(*out, strict=True) if out else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    kinds = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string")
    return mapped(docs.select("doc_id", "text"), encode, kinds)
