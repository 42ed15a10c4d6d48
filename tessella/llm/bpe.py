"""Operator 5: BPE encoding and decoding by speculation and verification.

The vocabulary's words end in a marker and texts never join words over white space, so the unit of work is the distinct
white-space chunk of a task, and inside it the distinct word; both are remembered in bounded tables. A chunk is normalised and cut into words (Latin-1 here, others by the library's normaliser and cutter); for each word greedy longest match proposes
tokens. A proposal is the BPE result exactly if every proposed token is the result for its own string and no merge
crosses a border between two neighbours. Both are tested with numpy for all pairs of a batch at once: a crossing merge
(x, y) needs x on the right spine of the left token and y on the left spine of the right token, both still alive when
the rank of (x, y) comes up. Only words that fail are merged. Proposing and merging take the words of a batch together too: they
walk a trie of the vocabulary side by side, and words of equal length make one merge each a round, so that they stay of equal length.

The tokenizer file is read on the driver; its tables have the size of the vocabulary and travel with the task.

Edge cases: a null or empty text has no tokens and decodes to an empty string; the strings of the added tokens are
those tokens wherever they stand, as in the library; texts are taken whole, bytes that are no UTF-8 as U+FFFD; a word of any
length is merged in n log n steps; repeated rows are encoded one by one; an empty
table gives an empty result; extra columns pass through `encode` and `decode` unless they have the output's name.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tessella.llm.common import texts
from tessella.runtime import ship_package

#: Distinct chunks, and distinct words, in a half of a task's memory; those of the older half go if nobody asks for them.
MEMORY = 150_000
#: Symbols beyond which a word is taken by itself and merged with a heap.
LONG_WORD = 64
#: Characters of texts whose chunks are learnt together.
GROUP_CHARS = 2_000_000
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
_ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Letters, numbers and white space of Latin-1, which are the same in all versions of Unicode and in normal form.
LATIN_LETTERS, LATIN_NUMBERS, LATIN_SPACE = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"
_BEYOND = re.compile("[^\x00-\xff]")


def _byte_chars() -> list[str]:
    """Byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for U+0100 and up, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Bpe:
    """Vocabulary, merges and the compatibility test. Built from the text of a tokenizer file."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {p: r for r, p in enumerate(pairs)}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.tokens = [""] * (max([*self.vocab.values(), *self.added.values()]) + 1)
        for t, i in [*self.vocab.items(), *self.added.items()]:
            self.tokens[i] = t
        self._added_re = re.compile("(" + "|".join(sorted(map(re.escape, self.added), key=len, reverse=True)) + ")") if self.added else None
        # Words are cut by the library's own Unicode tables, so that its version decides on letters, numbers and lower case.
        library = Tokenizer.from_str(source)
        self._normal, self._cut = library.normalizer, library.pre_tokenizer
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self._word_re = re.compile(pattern.replace(r"\p{L}", LATIN_LETTERS).replace(r"\p{N}", LATIN_NUMBERS).replace(r"\s", LATIN_SPACE))
        shown = _byte_chars()
        self._latin = {i: "".join(shown[b] for b in chr(i).encode()) for i in range(256)}
        self.longest = max(map(len, self.vocab))
        n = len(self.tokens)
        self.left, self.right = np.full(n, -1), np.full(n, -1)
        self.birth = np.full(n, -1)
        codes = []
        for r, (a, b) in enumerate(pairs):
            i, j, k = self.vocab[a], self.vocab[b], self.vocab[a + b]
            codes.append(i * n + j)
            if self.birth[k] < 0:
                self.left[k], self.right[k], self.birth[k] = i, j, r
        # For merging a long word: the rank of a pair of ids, and what it makes.
        self._pair = {c: r for r, c in reversed(list(enumerate(codes)))}
        self._made = [self.vocab[a + b] for a, b in pairs]
        self._makes = np.array(self._made, np.int32)
        # The longest token without end marker for each two first characters bounds the search for the longest match.
        self._reach: dict[str, int] = {}
        for t in self.vocab:
            if not (self.end and t.endswith(self.end)):
                self._reach[t[:2]] = max(self._reach.get(t[:2], 1), len(t))
        order = np.argsort(codes)
        self._codes, self._ranks, self._n = np.asarray(codes)[order], order, n
        self.own = self._own()
        # The id of each byte's character, inside a word and at its end, by code point; and its number in the trie.
        self._inside, self._final, self._letter = (np.zeros(0x200, np.int32) for _ in range(3))
        for i, c in enumerate(_byte_chars()):
            self._inside[ord(c)], self._final[ord(c)], self._letter[ord(c)] = self.vocab[c], self.vocab[c + self.end], i
        self._plant()

    def _plant(self) -> None:
        """The trie of the vocabulary: sorted edges (node * 256 + letter), and the tokens of a node inside a word and at its end."""
        edges: dict[int, int] = {}
        here: list[tuple[int, int]] = []
        last: list[tuple[int, int]] = []
        letter = {c: i for i, c in enumerate(_byte_chars())}
        for t, i in self.vocab.items():
            ends = bool(self.end) and t.endswith(self.end)
            node = 0
            for c in t[: -len(self.end)] if ends else t:
                node = edges.setdefault(node * 256 + letter[c], len(edges) + 1)
            if ends or not self.end:
                last.append((node, i))
            if not ends:
                here.append((node, i))
        codes, nodes = np.array(list(edges), np.int32), np.array(list(edges.values()), np.int32)
        order = np.argsort(codes)
        self._edges, self._child = codes[order], nodes[order]
        self._token = np.full((2, len(edges) + 1), -1, np.int32)
        for row, found in enumerate((here, last)):
            self._token[row, [n for n, _ in found]] = [i for _, i in found]

    def crossing(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | int) -> np.ndarray:
        """Whether some merge of rank below limit joins a symbol of a to a symbol of b."""
        never = len(self.rank) + 1
        bad = np.zeros(len(a), bool)
        x, dies_x = a.copy(), np.full(len(a), never)
        while (on := x >= 0).any():
            y, dies_y = np.where(on, b, -1), np.full(len(a), never)
            while len(i := np.flatnonzero((y >= 0) & ~bad)):
                code = x[i] * self._n + y[i]
                at = np.minimum(np.searchsorted(self._codes, code), len(self._codes) - 1)
                r = self._ranks[at]
                lim = limit[i] if isinstance(limit, np.ndarray) else limit
                bad[i] |= (self._codes[at] == code) & (r < dies_x[i]) & (r <= dies_y[i]) & (r < lim)
                dies_y = np.where(y >= 0, self.birth[y], dies_y)
                y = np.where(y >= 0, self.left[y], -1)
            dies_x = np.where(x >= 0, self.birth[x], dies_x)
            x = np.where((x >= 0) & ~bad, self.right[x], -1)
        return bad

    def _own(self) -> np.ndarray:
        """Which tokens are the BPE result for their own string: both parts are, and no earlier merge crosses between them."""
        own = np.ones(self._n, bool)
        made = np.flatnonzero(self.birth >= 0)
        crossed = np.zeros(self._n, bool)
        crossed[made] = self.crossing(self.left[made], self.right[made], self.birth[made])
        for t in made[np.argsort(self.birth[made])]:
            own[t] = own[self.left[t]] and own[self.right[t]] and not crossed[t]
        return own

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of merging a with b, or the number of merges if there is none."""
        code = a.astype(np.int64) * self._n + b
        at = np.minimum(np.searchsorted(self._codes, code), len(self._codes) - 1)
        return np.where(self._codes[at] == code, self._ranks[at], len(self._codes)).astype(np.int32)

    def _merge_equal(self, ids: np.ndarray) -> list[bytes]:
        """The exact results for words of one length, a row of symbols each. Each round every word makes its merge of the lowest rank,
        of equal ranks the leftmost; words without any are done."""
        out, row = [b""] * len(ids), np.arange(len(ids))
        ranks = self._rank(ids[:, :-1], ids[:, 1:])
        while len(row):
            place = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(row), np.int64)
            best = ranks[np.arange(len(row)), place] if ranks.shape[1] else np.full(len(row), len(self._codes))
            on = best < len(self._codes)
            done, width = ids[~on].astype("<u4").tobytes(), 4 * ids.shape[1]
            for k, i in enumerate(row[~on].tolist()):
                out[i] = done[k * width : (k + 1) * width]
            ids, ranks, row, place, best = ids[on], ranks[on], row[on], place[on], best[on]
            if not len(row):
                break
            ids[np.arange(len(row)), place] = self._makes[best]
            column, at = np.arange(ids.shape[1] - 1), place[:, None]
            ids = np.take_along_axis(ids, column + (column > at), axis=1)
            ranks = np.take_along_axis(ranks, column[:-1] + (column[:-1] >= at), axis=1)
            i = np.flatnonzero(place > 0)
            ranks[i, place[i] - 1] = self._rank(ids[i, place[i] - 1], ids[i, place[i]])
            i = np.flatnonzero(place < ranks.shape[1])
            ranks[i, place[i]] = self._rank(ids[i, place[i]], ids[i, place[i] + 1])
        return out

    def merge(self, word: str) -> list[int]:
        """The exact result: the lowest rank first, of equal ranks the leftmost."""
        return self._merge_long([*map(self.vocab.__getitem__, word[:-1]), self.vocab[word[-1] + self.end]])

    def _merge_long(self, ids: list[int]) -> list[int]:
        """With a heap of (rank, place) over linked symbols: n log n steps for a word of n symbols."""
        n, size, rank, made = self._n, len(ids), self._pair.get, self._made
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        heap = [r * size + i for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if (r := rank(a * n + b)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = divmod(heapq.heappop(heap), size)
            j = after[i]
            if ids[i] < 0 or j == size or rank(ids[i] * n + ids[j]) != r:
                continue  # one of the two has been merged since
            ids[i], ids[j], k = made[r], -1, after[j]
            after[i] = k
            if k < size:
                before[k] = i
                if (new := rank(ids[i] * n + ids[k])) is not None:
                    heapq.heappush(heap, new * size + i)
            if (h := before[i]) >= 0 and (new := rank(ids[h] * n + ids[i])) is not None:
                heapq.heappush(heap, new * size + h)
        return [t for t in ids if t >= 0]

    def propose(self, word: str) -> list[int]:
        """Greedy longest match; the last token carries the end marker."""
        out, i, n, vocab, end, reach = [], 0, len(word), self.vocab, self.end, self._reach
        while i < n:
            if n - i < self.longest and (t := vocab.get(word[i:] + end)) is not None:
                out.append(t)
                break
            for j in range(min(n - 1, i + reach.get(word[i : i + 2], 1)), i, -1):
                if (t := vocab.get(word[i:j])) is not None:
                    out.append(t)
                    i = j
                    break
        return out

    def _propose_all(self, letters: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """propose for all words at once: at each letter the id of the token that starts there, else -1. ends: where words end."""
        out = np.full(len(letters), -1, np.int32)
        at = np.concatenate([[0], ends[:-1]])
        while len(at):
            found, upto = np.full(len(at), -1, np.int32), at.copy()
            who, node, i = np.arange(len(at)), np.zeros(len(at), np.int32), at
            while len(who):
                code = node * 256 + letters[i]
                edge = np.minimum(np.searchsorted(self._edges, code), len(self._edges) - 1)
                on = self._edges[edge] == code
                who, node, i = who[on], self._child[edge[on]], i[on] + 1
                final = i == ends[who]
                token = self._token[final.astype(np.int8), node]
                hit = token >= 0
                found[who[hit]], upto[who[hit]] = token[hit], i[hit]
                who, node, i = who[~final], node[~final], i[~final]
            out[at] = found
            more = upto < ends
            at, ends = upto[more], ends[more]
        return out

    def _proposals(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Proposed ids of all words, one after the other, and how many each word has."""
        points = np.frombuffer("".join(words).encode("utf-16-le"), "<u2")  # byte characters stand below U+0200
        ends = np.cumsum([len(w) for w in words])
        tokens = self._propose_all(self._letter[points], ends)
        starts = tokens >= 0
        return tokens[starts].astype(np.int64), np.add.reduceat(starts, np.concatenate([[0], ends[:-1]]), dtype=np.int64)

    def words(self, words: list[str]) -> list[bytes]:
        """Token ids of byte-level words, each as little-endian unsigned 32-bit integers."""
        short = [w for w in words if len(w) <= LONG_WORD]
        flat, sizes = self._proposals(short) if short else (np.empty(0, np.int64), np.empty(0, np.int64))
        long = [self.propose(w) for w in words if len(w) > LONG_WORD]
        # Long words stand behind the short ones.
        flat = np.concatenate([flat, *[np.array(f, np.int64) for f in long]])
        sizes = np.concatenate([sizes, np.array([len(f) for f in long], np.int64)])
        owner = np.repeat(np.arange(len(words)), sizes)
        fail = np.zeros(len(words), bool)
        fail[owner[~self.own[flat]]] = True
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, back = np.unique(flat[inside] * self._n + flat[inside + 1], return_inverse=True)
        bad = self.crossing(pairs // self._n, pairs % self._n, len(self.rank) + 1)
        fail[owner[inside][bad[back]]] = True
        data, cuts = flat.astype("<u4").tobytes(), (4 * np.concatenate([[0], np.cumsum(sizes)])).tolist()
        found = [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        by_length: dict[int, list[int]] = {}
        for i in np.flatnonzero(fail[: len(short)]).tolist():
            by_length.setdefault(len(short[i]), []).append(i)
        for n, which in by_length.items():
            points = np.frombuffer("".join([short[i] for i in which]).encode("utf-16-le"), "<u2").reshape(-1, n)
            ids = self._inside[points]
            ids[:, -1] = self._final[points[:, -1]]
            for i, merged in zip(which, self._merge_equal(ids), strict=True):
                found[i] = merged
        if not long:
            return found
        exact = iter([np.array(self.merge(w), "<u4").tobytes() if bad else f for w, f, bad in zip([w for w in words if len(w) > LONG_WORD], found[len(short) :], fail[len(short) :], strict=True)])
        near = iter(found)
        return [next(near) if len(w) <= LONG_WORD else next(exact) for w in words]

    def split(self, chunk: str) -> list[str]:
        """The byte-level words of a chunk without white space."""
        if chunk.isascii() and chunk.isalpha():
            return [chunk.lower()]
        if not _BEYOND.search(chunk):
            words = self._word_re.findall(chunk.lower())
            # Printable ASCII: each byte stands for itself.
            return words if chunk.isascii() and chunk.isprintable() else [w.translate(self._latin) for w in words]
        return [w for w, _ in self._cut.pre_tokenize_str(self._normal.normalize_str(chunk))]

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens joined by blanks, as the library does for files without a decoder."""
        return " ".join([self.tokens[i] for i in ids])


class Memory:
    """Ids, as bytes, of the keys asked for lately. A full young half becomes the old one, whose keys move back on demand."""

    def __init__(self):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def missing(self, keys: set[str]) -> list[str]:
        """The keys not known; the others are in the young half from here to the next call."""
        if len(self.young) > MEMORY:
            self.young, self.old = {}, self.young
        out = []
        for k in keys.difference(self.young):
            if (ids := self.old.get(k)) is None:
                out.append(k)
            else:
                self.young[k] = ids
        return out


class Encoder:
    """Encodes texts one after the other and remembers chunks and words it has seen: a word stands in many chunks."""

    def __init__(self, bpe: Bpe):
        self.bpe, self.chunks, self.words = bpe, Memory(), Memory()

    def _learn_words(self, words: set[str]) -> None:
        new = self.words.missing(words)
        if new:
            self.words.young.update(zip(new, self.bpe.words(new), strict=True))

    @staticmethod
    def _chunks(text: str) -> list[str]:
        return [c for c in _SPACE.split(text) if c] if _ODD_SPACE.search(text) else text.split()

    def _know(self, chunks: set[str]) -> None:
        new = self.chunks.missing(chunks)
        cut = [self.bpe.split(c) for c in new]
        self._learn_words({w for ws in cut for w in ws})
        ids = self.words.young.__getitem__
        for c, ws in zip(new, cut, strict=True):
            self.chunks.young[c] = b"".join(map(ids, ws))

    def encode_all(self, docs: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of one text after the other; new chunks are learnt for some texts at a time."""
        at = 0
        while at < len(docs):
            group, size = [], 0
            while at < len(docs) and size < GROUP_CHARS:
                group.append(docs[at] or "")
                size += len(group[-1])
                at += 1
            parts = [self._parts(t) for t in group]
            self._know({c for ps in parts for p in ps if isinstance(p, list) for c in p})
            for ps in parts:
                yield np.frombuffer(b"".join([p if isinstance(p, bytes) else b"".join(map(self.chunks.young.__getitem__, p)) for p in ps]), "<u4")

    def _parts(self, text: str) -> list[list[str] | bytes]:
        """Lists of chunks, and the ids of added tokens between them."""
        added = self.bpe._added_re
        if added is None or not added.search(text):
            return [self._chunks(text)]
        return [np.array([self.bpe.added[p]], "<u4").tobytes() if i % 2 else self._chunks(p) for i, p in enumerate(added.split(text))]

    def encode(self, text: str | None) -> np.ndarray:
        """Token ids as little-endian unsigned 32-bit integers."""
        return next(self.encode_all([text]))


_KEPT: dict[int, Encoder] = {}


def load(source: str) -> Encoder:
    """The encoder for a tokenizer file's text, kept in a process from task to task."""
    key = hash(source)
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Encoder(Bpe(source))
    return _KEPT[key]


def read_tokenizer(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _without(docs: DataFrame, names: list[str]) -> DataFrame:
    low = {n.lower() for n in names}
    return docs.select(*[docs[f"`{c}`"] for c in docs.columns if c.lower() not in low])


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with their token ids in an array<int> column."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(read_tokenizer(path))  # the size of the vocabulary
    base = _without(docs, [ids])
    place = base.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(shared.value)
        for batch in batches:
            found = [ids.astype(np.int32) for ids in encoder.encode_all(texts(batch.column(place)))]
            ends = np.cumsum([0, *map(len, found)])
            column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found) if found else np.empty(0, np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, ids])

    return base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with the text of its ids; null ids give an empty text."""
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(read_tokenizer(path))
    base = _without(df, [decoded])
    place = base.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(shared.value).bpe
        for batch in batches:
            found = [bpe.decode(x or ()) for x in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, decoded])

    return base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField(decoded, T.StringType())]))


def digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoding and decoding in one pass, without keeping either."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(read_tokenizer(path))
    base = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(shared.value)
        bpe = encoder.bpe
        for batch in batches:
            n, a, b = [], [], []
            for ids in encoder.encode_all(texts(batch.column(1))):
                n.append(len(ids))
                a.append(hashlib.sha256(ids.tobytes()).hexdigest())
                b.append(hashlib.sha256(bpe.decode(ids.tolist()).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    fields = [base.schema.fields[0], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return base.mapInArrow(run, T.StructType(fields))
