"""10. BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a word the last token of its encoding is unique, and the encoding is the chain
of back-pointers from the whole word. An automaton over the vocabulary gives all tokens that end at
a position; the one that is the last token there is the one compatible with the last token of the
prefix it leaves: the pair stays as it is when its two strings are encoded together. Compatibility
is tested by undoing the two tokens' merges in reverse order and looking for an earlier merge across
their border. No list of symbols is ever merged, and a word of any length takes time in proportion to
its length and the number of tokens that match there.

Words are cut as the vocabulary file says (NFC, white space collapsed, lower case by character, its
split pattern); special tokens in a text are taken as such. Words repeat, so each worker remembers
up to 200,000 words that came up more than once.

Defined cases: null text is empty and has no ids; every row is encoded by itself, repeated rows
included; an empty table gives no rows; decoding null ids gives the empty text; extra columns are
carried, columns named like a result are replaced. Text with characters that Unicode tables may class differently is
normalised and cut into words by the library of the vocabulary file, so that its classes hold.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpus_context.llm.common import AgingMemo, UnstableCharacters, releasing, small_batches, texts_of, unstable_characters

_END = "\0"  # stands for the end-of-word suffix, which then is one character
_FLUSH = 4 << 20  # ids of a batch handed back at a time


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where it
    is printable in Latin-1, else the next code point from 256 on."""
    shown = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class PrefixBpe:
    """Encoder and decoder of one vocabulary file (its JSON text); ``unstable`` is a pattern for the characters whose
    class is asked from the library."""

    def __init__(self, spec: str, unstable: str | None = None):
        import ahocorasick

        self.spec, self.library = spec, None
        self.unstable = UnstableCharacters(unstable)
        self.shown = token_strings(spec)
        j = json.loads(spec)
        model, self.special = j["model"], {t["content"]: t["id"] for t in j["added_tokens"]}
        suffix = model["end_of_word_suffix"]
        kinds = [n["type"] for n in j["normalizer"]["normalizers"]], j["pre_tokenizer"]["pretokenizers"][0]["type"]
        if kinds != (["NFC", "Replace", "Lowercase"], "Split") or not suffix or j["decoder"] is not None:
            raise ValueError("this vocabulary's normaliser, splitter or decoder is not supported")
        pattern = j["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = regex.compile(pattern)
        self.ascii_pattern = re.compile(pattern.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9"), re.ASCII)  # of lower case
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        vocab = model["vocab"]
        self.chars = byte_characters()
        self.bytes = {c: b for b, c in enumerate(self.chars)}
        mark = lambda t: t[: -len(suffix)] + _END if t.endswith(suffix) else t
        self.merge: dict[tuple[int, int], int] = {}  # pair -> rank
        self.parts: dict[int, tuple[int, int, int]] = {}  # token -> (rank, left, right)
        for rank, (left, right) in enumerate(model["merges"]):
            a, b, t = vocab[left], vocab[right], vocab[left + right]
            if t in self.parts:
                raise ValueError("a token is made by two merges")
            self.merge[a, b], self.parts[t] = rank, (rank, a, b)
        self.matches = ahocorasick.Automaton()
        for t, i in vocab.items():
            made = self.parts.get(i)
            if made is None or self._stays(made[1], made[2], made[0]):  # others never end an encoding
                self.matches.add_word(mark(t), (i, len(mark(t))))
        self.matches.make_automaton()
        self.pair = AgingMemo(lambda ab: self._stays(ab >> 32, ab & 0xFFFFFFFF), 400_000)
        self.word = AgingMemo(lambda w: self._with_strings(self.encode_word(w)), 200_000)

    def _stays(self, a: int, b: int, limit: float = float("inf")) -> bool:
        """Whether no merge across the border of tokens ``a`` and ``b`` comes before merge ``limit``, nor
        before the merges that made them. Of equal ranks the left merge comes first."""
        base, own = (-1, 0, 0), False
        while True:
            across = self.merge.get((a, b))
            if across is not None and (across < limit or own and across == limit):
                return False
            of_a, of_b = self.parts.get(a, base), self.parts.get(b, base)
            if of_a[0] < 0 and of_b[0] < 0:
                return True
            if of_a[0] > of_b[0]:
                limit, a, own = of_a[0], of_a[2], False
            else:
                limit, b, own = of_b[0], of_b[1], True

    def encode_word(self, word: str) -> list[int]:
        text = "".join(map(self.chars.__getitem__, word.encode("utf-8", "surrogatepass"))) + _END
        n, pair = len(text), self.pair
        last = [-1] * (n + 1)  # last token of the prefix of each length
        size = [0] * (n + 1)
        for end, (token, length) in self.matches.iter(text):
            end += 1
            if last[end] < 0:
                left = end - length
                if left == 0 or last[left] >= 0 and pair[last[left] << 32 | token]:
                    last[end], size[end] = token, length
        ids, at = [], n
        while at:
            ids.append(last[at])
            at -= size[at]
        return ids[::-1]

    def _with_strings(self, ids: list[int]) -> tuple[tuple[int, ...], str, str]:
        return tuple(ids), " ".join(map(str, ids)), self.decode(ids)

    def words(self, text: str) -> list[str]:
        """The normalised words of a text without special tokens."""
        if text.isascii():
            return self.ascii_pattern.findall(text.lower())
        if not self.unstable(text):  # lower case by character: a final sigma is like any other
            return self.pattern.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.spec)
        cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(self.bytes.__getitem__, w)).decode("utf-8", "surrogatepass") for w, _ in cut]

    def pieces(self, text: str) -> list[tuple[tuple[int, ...], str, str]]:
        """Of each word of the text, and each special token: its ids, these as decimals and their decoded text."""
        out = []
        for part in self.special_split.split(text) if "<|" in text else [text]:
            if part in self.special:
                out.append(self._with_strings([self.special[part]]))
            else:
                out.extend(map(self.word.__getitem__, self.words(part)))
        return out

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(p[0] for p in self.pieces(text)))

    def decode(self, ids) -> str:
        return " ".join(map(self.shown.__getitem__, ids))

    def trim(self) -> None:
        for memo in (self.word, self.pair):
            memo.trim()


def token_strings(spec: str) -> dict[int, str]:
    """The text that each id stands for."""
    j = json.loads(spec)
    return {i: t for t, i in j["model"]["vocab"].items()} | {t["id"]: t["content"] for t in j["added_tokens"]}


_LOADED: dict[str, PrefixBpe] = {}


def load(spec: str, unstable: str | None = None) -> PrefixBpe:
    if spec not in _LOADED:
        _LOADED.clear()
        _LOADED[spec] = PrefixBpe(spec, unstable)
    return _LOADED[spec]


def _with_result(batch: pa.RecordBatch, start: int, stop: int, name: str, values: pa.Array) -> pa.RecordBatch:
    part = batch.slice(start, stop - start)
    return pa.RecordBatch.from_arrays([*part.columns, values], [*batch.schema.names, name])


def _mapped(df: DataFrame, column: str, result: str, result_type: T.DataType, fn) -> DataFrame:
    kept = df.select(*[f"`{c}`" for c in df.columns if c.lower() != result.lower() or c == column])
    if column.lower() == result.lower():
        raise ValueError("the result needs a name of its own")
    return kept.mapInArrow(releasing(fn), T.StructType([*kept.schema.fields, T.StructField(result, result_type)]))


def encode(df: DataFrame, vocabulary: str, text_col: str = "text", result: str = "ids") -> DataFrame:
    """``df`` with the ids (array<int>) of ``text_col``; ``vocabulary`` is the file's path on the driver."""
    small_batches(df.sparkSession)
    with open(vocabulary, encoding="utf-8") as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())
    unstable = unstable_characters()

    def run(batches):
        bpe = load(spec.value, unstable)
        for batch in batches:
            lists, start, held = [], 0, 0
            for i, v in enumerate(batch.column(text_col)):
                ids = np.fromiter(bpe.encode(v.as_py() or ""), np.int32)
                lists.append(ids)
                held += len(ids)
                bpe.trim()
                if held > _FLUSH or i == batch.num_rows - 1:
                    offsets = np.cumsum([0, *map(len, lists)], dtype=np.int32)
                    values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists)))
                    yield _with_result(batch, start, i + 1, result, values)
                    lists, start, held = [], i + 1, 0

    return _mapped(df, text_col, result, T.ArrayType(T.IntegerType()), run)


def decode(df: DataFrame, vocabulary: str, ids_col: str = "ids", result: str = "decoded") -> DataFrame:
    """``df`` with the text that the ids in ``ids_col`` stand for, as the library writes it."""
    with open(vocabulary, encoding="utf-8") as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        shown = token_strings(spec.value)
        for batch in batches:
            texts, start, held = [], 0, 0
            for i, v in enumerate(batch.column(ids_col)):
                ids = v.values.to_numpy(zero_copy_only=False).tolist() if v.is_valid else []
                texts.append(" ".join(map(shown.__getitem__, ids)))
                held += len(ids)
                if held > _FLUSH or i == batch.num_rows - 1:
                    yield _with_result(batch, start, i + 1, result, pa.array(texts, pa.string()))
                    texts, start, held = [], i + 1, 0

    return _mapped(df, ids_col, result, T.StringType(), run)


def digests(df: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """``df``, without its text, with n_tokens, ids_sha256 (of the decimal ids) and decoded_sha256 of each text encoded and
    decoded again. One pass: neither the ids nor the decoded texts leave the worker."""
    small_batches(df.sparkSession)
    with open(vocabulary, encoding="utf-8") as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())
    unstable, results = unstable_characters(), ("n_tokens", "ids_sha256", "decoded_sha256")
    kept = [c for c in df.columns if c.lower() not in (*results, text_col.lower())]

    def sha(parts):
        return hashlib.sha256(" ".join(parts).encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches):
        bpe = load(spec.value, unstable)
        for batch in batches:
            rows = []
            for text in texts_of(batch, "_text"):
                found = bpe.pieces(text)
                rows.append((sum(len(p[0]) for p in found), sha([p[1] for p in found]), sha([p[2] for p in found])))
                bpe.trim()
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.string(), pa.string()))] if rows else [
                pa.nulls(0, k) for k in (pa.int64(), pa.string(), pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns], [*kept, *results])

    texts = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").alias("_text"))
    schema = T.StructType([*texts.schema.fields[:-1], *(T.StructField(c, t) for c, t in zip(results, (T.LongType(), T.StringType(), T.StringType())))])
    return texts.mapInArrow(releasing(run), schema)
