"""BPE encoding and decoding by a prefix-sharing trie.

The distinct words of a slice of documents are walked in sorted order, which is the depth-first order of
their trie. Each trie node keeps one state, the last token of the encoding of its prefix: the encoding of a
prefix is the unique sequence of tokens whose neighbours all stand beside each other under the merge rules,
so the last token of a prefix follows from the states of shorter prefixes. A prefix shared by many
words is therefore encoded once. The end of a word is a symbol of its own (last byte plus end mark), as the merge
rules of such vocabularies demand.

Null texts count as empty, empty texts give no token, repeated rows are encoded one by one, and extra
columns are ignored or kept as the functions say.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tideline.llm.shared import slices

#: Characters per slice, stretches between white space and words that are kept with their encodings, and pairs whose verdict is kept: they bound memory only.
SLICE_CHARS, CHUNKS_KEPT, WORDS_KEPT, PAIRS_KEPT = 2_000_000, 300_000, 500_000, 500_000
#: White space by the Unicode property, which the vocabulary's splitter goes by; Python's own has \x1c to \x1f too.
BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_symbols() -> dict[str, int]:
    """The printable characters that byte-level vocabularies write bytes with, by the published rule: printable Latin-1 stands for itself, the rest follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=1)
def letters_and_numbers() -> tuple[str, str]:
    """Character classes (without brackets) of the Latin letters and numbers, up to U+024F."""
    found = {"L": [], "N": []}
    for c in range(0x250):
        kind = unicodedata.category(chr(c))[0]
        if kind in found:
            found[kind].append(f"\\u{c:04x}")
    return "".join(found["L"]), "".join(found["N"])


class TrieBPE:
    """A word-level BPE vocabulary (a tokenizers file with an end-of-word suffix)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, self.end = model["vocab"], model["end_of_word_suffix"]
        self.tokens = {i: t for t, i in vocab.items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        # A token as a string over 512 symbols: 0..255 bytes, 256..511 bytes that end a word.
        form: dict[int, str] = {}
        for c, b in byte_symbols().items():
            form[vocab[c]] = chr(b)
            form[vocab[c + self.end]] = chr(256 + b)
        self.pair: dict[tuple[int, int], int] = {}
        rank: dict[int, int] = {i: -1 for i in form}
        parts: dict[int, tuple[int, int]] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            i, j = vocab[a], vocab[b]
            new = vocab[a + b]
            self.pair[i, j] = r
            if new not in form:
                form[new], rank[new], parts[new] = form[i] + form[j], r, (i, j)
        self.ids = {s: i for i, s in form.items()}
        # The longest token by its last two symbols: no longer suffix of a prefix needs a look.
        self.reach: dict[str, int] = {}
        for x in self.ids:
            self.reach[x[-2:]] = max(self.reach.get(x[-2:], 1), len(x))
        later = len(model["merges"])
        # What stands at a token's right or left edge while it grows: (token, rank it is made at, rank it is used up at).
        self.right, self.left = {}, {}
        for i in form:
            for spine, side in ((self.right, 1), (self.left, 0)):
                out, at, until = [], i, later
                while True:
                    out.append((at, rank[at], until))
                    if at not in parts:
                        break
                    until, at = rank[at], parts[at][side]
                spine[i] = out
        # Texts of later characters than Latin ones are normalised and split by the library: Unicode versions class them differently
        library = Tokenizer.from_file(path)
        self.normalise, self.pieces_of, self.latin = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str, re.compile("[\0-\u0233]*").fullmatch  # those from U+0234 on have lower cases elsewhere
        self.byte_of = {ord(c): b for c, b in byte_symbols().items()}
        self.beside: dict[int, bool] = {}
        self.words: dict[str, tuple[str, str]] = {}
        self.known: dict[str, tuple[str, str]] = {}  # by stretch between white space
        letter, number = letters_and_numbers()
        self.split = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{BLANK}{letter}{number}]+")
        self.marks = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        # str.split() takes these four as white space, the vocabulary's splitter doesn't
        self.odd, self.blank = re.compile("[\x1c-\x1f]"), re.compile(f"[{BLANK}]+")

    def stand_beside(self, a: int, b: int) -> bool:
        """Whether tokens a and b stay apart: no merge over their border is due while both its sides are there."""
        key = a << 20 | b
        known = self.beside.get(key)
        if known is None:
            known, pair = True, self.pair
            for x, made_x, used_x in self.right[a]:
                for y, made_y, used_y in self.left[b]:
                    r = pair.get((x, y))
                    # at equal ranks the leftmost pair merges first
                    if r is not None and made_x < r < used_x and made_y < r <= used_y:
                        known = False
                        break
                if not known:
                    break
            if len(self.beside) >= PAIRS_KEPT:
                self.beside.clear()
            self.beside[key] = known
        return known

    def encode_words(self, words) -> dict[str, list[int]]:
        """Token ids of distinct words, given and returned as strings over the 512 symbols."""
        out: dict[str, list[int]] = {}
        ids, reach, known, beside = self.ids, self.reach, self.beside, self.stand_beside
        state: list[tuple[int, int]] = [(-1, 0)]  # by depth: last token, and the depth before it
        before = ""
        for word in sorted(words):
            shared = 0
            for x, y in zip(before, word, strict=False):
                if x != y:
                    break
                shared += 1
            del state[shared + 1 :]
            for depth in range(shared + 1, len(word) + 1):
                start = max(0, depth - reach.get(word[max(0, depth - 2) : depth], 1))
                while True:
                    token = ids.get(word[start:depth])
                    if token is not None:
                        if not start:
                            break
                        last = state[start][0]
                        apart = known.get(last << 20 | token)
                        if beside(last, token) if apart is None else apart:
                            break
                    start += 1
                state.append((token, start))
            before = word
            found, depth = [], len(word)
            while depth:
                token, depth = state[depth]
                found.append(token)
            found.reverse()
            out[word] = found
        return out

    def learn(self, chunks: set[str]) -> None:
        """Keeps the ids and tokens of chunks, texts without white space; words that several chunks share are encoded once."""
        if len(self.words) > WORDS_KEPT:
            self.words.clear()
        pieces: dict[str, list[str]] = {}
        words, known = self.words, self.known
        new: set[str] = set()
        for chunk in chunks:
            if chunk.isascii():
                made = self.split.findall(chunk.lower())
            elif self.latin(chunk):
                made = self.split.findall(unicodedata.normalize("NFC", chunk).lower())
            else:
                made = [bytes(self.byte_of[ord(c)] for c in p).decode() for p, _ in self.pieces_of(self.normalise(chunk))]
            if len(made) == 1 and made[0] in words:
                known[chunk] = words[made[0]]
            else:
                pieces[chunk] = made
                new.update(made)
        forms = {}
        for word in new - words.keys():
            raw = word.encode().decode("latin-1")
            forms[raw[:-1] + chr(256 + ord(raw[-1]))] = word
        tokens = self.tokens
        for form, ids in self.encode_words(forms).items():
            words[forms[form]] = (" ".join(map(str, ids)), " ".join([tokens[i] for i in ids]))
        for chunk, made in pieces.items():
            if len(made) == 1:
                known[chunk] = words[made[0]]
            else:
                a, b = zip(*[words[w] for w in made], strict=True)
                known[chunk] = (" ".join(a), " ".join(b))

    def chunks(self, text: str) -> list[str]:
        if self.odd.search(text):
            return [x for x in self.blank.split(text) if x]
        return text.split()

    def encode_texts(self, texts: list[str | None]):
        """For each text its ids and its decoded text: decimal ids, and tokens, each joined by a space."""
        for run in slices(texts, SLICE_CHARS):
            parts = []
            for text in run:
                if text and self.marks and "<|" in text and self.marks.search(text):
                    parts.append([(x, True) if x in self.special else (x, False) for x in self.marks.split(text)])
                else:
                    parts.append([(text or "", False)])
            split = [[x if mark else self.chunks(x) for x, mark in part] for part in parts]
            if len(self.known) > CHUNKS_KEPT:
                self.known.clear()
            new = set()
            for part in split:
                for x in part:
                    if type(x) is list:
                        new.update(x)
            new -= self.known.keys()
            self.learn(new)
            get = self.known.__getitem__
            for part in split:
                ids, decoded = [], []
                for x in part:
                    if type(x) is list:
                        if x:
                            a, b = zip(*map(get, x), strict=True)
                            ids.extend(a)
                            decoded.extend(b)
                    else:
                        ids.append(str(self.special[x]))
                        decoded.append(x)
                yield " ".join(ids), " ".join(decoded)


@lru_cache(maxsize=2)
def encoder(path: str) -> TrieBPE:
    """One per worker process."""
    return TrieBPE(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string) of each row's whole text."""

    def run(batches):
        bpe = encoder(path)
        for batch in batches:
            found = list(bpe.encode_texts(batch.column(1).to_pylist()))
            ids = [[int(x) for x in a.split()] for a, _ in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([b for _, b in found], pa.string())], names=["id", "ids", "decoded"])

    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return plain.mapInArrow(run, f"id {plain.schema['id'].dataType.simpleString()}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """Adds the decoded text of an array of ids (null: null): tokens joined by a space, as a vocabulary file without a decoder says."""

    @F.pandas_udf("string")
    def joined(ids):
        tokens = encoder(path).tokens
        return ids.map(lambda x: None if x is None else " ".join(tokens[int(i)] for i in x))

    return encoded.withColumn(into, joined(ids_col))


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): as encode(), but only digests leave the worker."""

    def run(batches):
        bpe = encoder(path)
        for batch in batches:
            n, a, b = [], [], []
            for ids, decoded in bpe.encode_texts(batch.column(1).to_pylist()):
                n.append(ids.count(" ") + 1 if ids else 0)
                a.append(hashlib.sha256(ids.encode()).hexdigest())
                b.append(hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return plain.mapInArrow(run, f"id {plain.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
