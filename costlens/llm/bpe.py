"""BPE encoding and decoding as streaming transducers.

Encoding: for each prefix of a piece the last token of its encoding is unique: the longest token ending there that the
merge list keeps apart from the last token of what precedes it. A longer prefix reaches back no further than the
longest token, so that length in symbols is the merge list's sufficient lookahead: what the encodings of all prefixes
within the lookahead have in common is final and is emitted, and the state stays a few lookaheads long.
Decoding: ids become bytes and a UTF-8 state machine makes text of them, holding back an unfinished character.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from costlens.llm.common import as_bytes

END = "</w>"
#: Unicode white space. str.split() also splits at the four separators of ODD, so texts holding those take the pattern.
WHITE = regex.compile("[\t-\r \x85\xa0  -     　]+")
ODD = regex.compile(r"[\x1c-\x1f]")
#: Characters of a text that are encoded, and ids that are decoded, at once.
STEP = 1 << 16


def byte_symbols() -> list[str]:
    """The visible character that stands for each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest for code points from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class _Words(dict):
    """Encoded words; forgets all when full, so memory is constant."""

    def __init__(self, encode, size: int):
        super().__init__()
        self.encode, self.size = encode, size

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(word)
        if len(word) <= 64:
            if len(self) >= self.size:
                self.clear()
            self[word] = ids
        return ids


class Bpe:
    """A tokenizer file (byte-level BPE with word ends) as tables."""

    def __init__(self, path: str, cache_size: int = 400_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model.get("end_of_word_suffix") != END:
            raise ValueError("a vocabulary with word ends is expected")
        vocab: dict[str, int] = model["vocab"]
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_at = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.piece = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.symbols = byte_symbols()
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}  # the two tokens whose merge makes a token
        self.made: dict[int, int] = {}  # the rank of that merge
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            pair, new = (vocab[a], vocab[b]), vocab[a + b]
            self.rank[pair] = r
            if new not in self.parts and self._apart(*pair, made=True):
                self.parts[new], self.made[new] = pair, r
        # A word end is written as one newline, which is no symbol, after the last symbol.
        single = set(self.symbols)
        self.tokens: dict[str, int] = {}
        for t, i in vocab.items():
            body = t[: -len(END)] if t.endswith(END) else t
            if i in self.parts or body in single:
                self.tokens[body + "\n" * t.endswith(END)] = i
        #: The sufficient lookahead, in symbols.
        self.lookahead = max(len(t.rstrip("\n")) for t in self.tokens)
        self._known: dict[int, bool] = {}
        self._prefixes: dict[str, tuple[int, int]] = {}
        # Tokens by their symbols from the last to the first, those of a word's end apart; "" leads to the id.
        self._ends: tuple[dict, dict] = ({}, {})
        for t, i in self.tokens.items():
            node = self._ends[t[-1] == "\n"]
            for c in reversed(t.rstrip("\n")):
                node = node.setdefault(c, {})
            node[""] = i
        self.words = _Words(self._word, cache_size)
        names = {i: t for t, i in (vocab | self.special).items()}
        self.names = [names.get(i, "").encode() for i in range(max(names) + 1)]
        self.separator = b" " if spec.get("decoder") is None else b""
        if spec.get("decoder"):
            raise ValueError("a file without a decoder is expected")

    def _apart(self, a: int, b: int, made: bool = False) -> bool:
        """Whether token a before token b stay two tokens. The merges that made both are undone, latest first; an earlier merge across the border at any time would have come before. made: a and b's own merge is left out."""
        bound, first = (len(self.rank) + 1, 1), made
        while True:
            r = self.rank.get((a, b))
            if r is not None and not first and (r, 0) < bound:
                return False
            first = False
            ra, rb = self.made.get(a, -1), self.made.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:  # at one rank the left merge comes first, so it wins over the pair across on its right
                bound, a = (ra, 0), self.parts[a][1]
            else:
                bound, b = (rb, 1), self.parts[b][0]

    def apart(self, a: int, b: int) -> bool:
        """_apart, remembered."""
        if (known := self._known.get(a << 20 | b)) is None:
            if len(self._known) >= 1_000_000:
                self._known.clear()
            known = self._known[a << 20 | b] = self._apart(a, b)
        return known

    def _last(self, text: str, end: bool, last: list[int]) -> tuple[int, int]:
        """Size and id of the last token of the prefix that text ends; end: at the piece's end; last: the last tokens of all shorter prefixes."""
        node, at, found = self._ends[end], len(text), []
        while at:
            at -= 1
            node = node.get(text[at])
            if node is None:
                break
            if (t := node.get("")) is not None:
                found.append((at, t))
        width, n, known = len(text), len(last), self._known
        for at, t in reversed(found):
            k = width - at
            if k > n:
                continue
            p = last[n - k]
            if p < 0 or ((ok := known.get(p << 20 | t)) is None and self.apart(p, t)) or ok:
                return k, t
        raise ValueError("each symbol is a token")

    def _short(self, symbols: str) -> list[int]:
        """Ids of a piece not longer than the lookahead, for which nothing is final before its end. Prefixes are remembered."""
        memo, last, size = self._prefixes, [-1], [0]
        for n in range(1, len(symbols)):
            head = symbols[:n]
            if (v := memo.get(head)) is None:
                if len(memo) >= 500_000:
                    memo.clear()
                v = memo[head] = self._last(head, False, last)
            size.append(v[0])
            last.append(v[1])
        k, t = self._last(symbols, True, last)
        size.append(k)
        last.append(t)
        return self._back(size, last, len(symbols))

    def stream(self, symbols: Iterable[str]) -> Iterator[int]:
        """Ids of one piece, given symbol by symbol (the last with its word end), each as soon as it is final."""
        look = self.lookahead
        text = ""  # the last symbols
        size, last = [0], [-1]  # of each prefix from the last final border on: its last token's length, and that token
        for s in symbols:
            text = (text + s[0])[-look:]
            n = len(size)
            k, t = self._last(text, len(s) > 1, last)
            size.append(k)
            last.append(t)
            if n > 4 * look:
                live = set(range(n + 1 - look, n + 1))
                while len(live) > 1:
                    top = max(live)
                    live.remove(top)
                    live.add(top - size[top])
                border = live.pop()
                yield from self._back(size, last, border)
                size, last = size[border:], last[border:]
                size[0] = 0
        yield from self._back(size, last, len(size) - 1)

    @staticmethod
    def _back(size: list[int], last: list[int], at: int) -> list[int]:
        out = []
        while at > 0:
            out.append(last[at])
            at -= size[at]
        return out[::-1]

    def _word(self, word: str) -> bytes:
        """Ids of a normalised text without white space, as little-endian 32-bit integers."""
        ids: list[int] = []
        for piece in (word,) if word.isalpha() else self.piece.findall(word):
            s = piece if piece.isascii() and piece.isprintable() else "".join([self.symbols[b] for b in piece.encode()])
            ids += self._short(s) if len(s) <= self.lookahead else self.stream([*s[:-1], s[-1] + "\n"])
        return pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> Iterator[bytes]:
        """Ids of a text, as little-endian 32-bit integers, portion by portion; special tokens in the text become theirs."""
        if self.special_at and "<" in text and self.special_at.search(text):
            for k, part in enumerate(self.special_at.split(text)):
                if k % 2:
                    yield np.array([self.special[part]], "<u4").tobytes()
                else:
                    yield from self._plain(part)
        else:
            yield from self._plain(text)

    def _plain(self, text: str) -> Iterator[bytes]:
        """A text without special tokens. Portions end before white space, which no word and no normalisation crosses; a longer word is a portion of its own."""
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > STEP and (gap := WHITE.search(text, at + STEP)):
                end = gap.start()
            part, at = text[at:end], end
            if not part.isascii():
                part = unicodedata.normalize("NFC", part)
            # One character at a time where lower() looks at the neighbours.
            low = "".join(c.lower() for c in part) if "Σ" in part else part.lower()
            words = [w for w in WHITE.split(low) if w] if ODD.search(low) else low.split()
            yield b"".join(map(self.words.__getitem__, words))

    def decode(self, ids: Iterable[np.ndarray]) -> Iterator[str]:
        """The text of ids that come in portions, each portion as far as its characters are whole."""
        machine, begun = codecs.getincrementaldecoder("utf-8")("replace"), False
        for portion in ids:
            for lo in range(0, len(portion), STEP):
                part = self.separator.join(map(self.names.__getitem__, portion[lo : lo + STEP].tolist()))
                yield machine.decode((self.separator if begun else b"") + part)
                begun = True
        yield machine.decode(b"", True)


_loaded: dict[str | None, Bpe] = {}


def tokenizer(path: str | None) -> Bpe:
    """Once for each Python worker, which also finds the default file where it runs."""
    if path not in _loaded:
        _loaded[path] = Bpe(path or default_path())
    return _loaded[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_column(docs: DataFrame, path: str | None = None, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """All rows and columns of docs and the ids of the whole text as array<int> (replacing a column of that name); null is the empty text, which has none; repeated rows stay."""
    keep = [c for c in docs.columns if c != ids]
    source = docs.select(*[f"`{c}`" for c in keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for b in batches:
            found = [b"".join(bpe.encode(t.decode())) for t in as_bytes(b.column(text))]
            offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in found]))).astype(np.int32)
            flat = pa.array(np.frombuffer(b"".join(found), "<i4"), pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(offsets), flat)], [*b.schema.names, ids])

    return source.mapInArrow(run, StructType([*source.schema, StructField(ids, ArrayType(IntegerType()))]))


def decode_column(docs: DataFrame, path: str | None = None, ids: str = "token_ids", text: str = "text") -> DataFrame:
    """All rows and columns of docs and the text of its ids (replacing a column of that name); null ids give the empty text."""
    keep = [c for c in docs.columns if c != text]
    source = docs.select(*[f"`{c}`" for c in keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for b in batches:
            out = ["".join(bpe.decode([np.array(x or [], np.int64)])) for x in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [*b.schema.names, text])

    return source.mapInArrow(run, StructType([*source.schema, StructField(text, StringType())]))


def digests(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per row: doc_id, n_tokens, ids_sha256, decoded_sha256 of whole texts encoded and decoded again, and with_ids token_ids.

    Null is the empty text, which has no token; repeated rows give a row each. A text's ids and decoded text are digested
    portion by portion and not held, however long it is, but with_ids.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for b in batches:
            found, n, of_ids, of_text = [], [], [], []
            for t in as_bytes(b.column("text")):
                ids, decoded, count = hashlib.sha256(), hashlib.sha256(), 0

                def portions(t: bytes = t, ids=ids) -> Iterator[np.ndarray]:
                    nonlocal count
                    for part in bpe.encode(t.decode()):
                        ids.update(part)
                        count += len(part) // 4
                        if with_ids:
                            found.append(part)
                        yield np.frombuffer(part, "<u4")

                for part in bpe.decode(portions()):
                    decoded.update(part.encode())
                n.append(count), of_ids.append(ids.hexdigest()), of_text.append(decoded.hexdigest())
            out = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
            if with_ids:
                edges = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(edges), pa.array(np.frombuffer(b"".join(found), "<i4"), pa.int32())))
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["token_ids"] * with_ids])

    return source.mapInArrow(run, f"doc_id {dict(source.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the text that they decode to, as digests."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op8_bpe": op8_bpe}
SQL: dict[str, str] = {}
