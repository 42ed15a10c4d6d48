"""Operator 1: language-model scores from sharded Elias-Fano n-gram tries.

The model is learnt from the training documents and scores all of them. Probabilities interpolate down the orders,

    p_k(w | C) = count(C w) / (count(C) + mu_k)  +  mu_k / (count(C) + mu_k) * p_{k-1}(w | shorter C),

which sums to one over words; p_1 is the add-0.1 unigram estimate. A trie holds both factors, quantised: the first one at
the n-gram (`takes`), the second one at its context (`leaves`).

Neither vocabulary nor model ever stands in one place. Documents are cut into blocks, and words and n-grams are dealt
into shards whose number follows the number of training tokens. A block asks each shard, in one message, for the distinct
words (first service) or n-grams (second service) that it has there, and says how often it has them in training
documents; the shard sums all messages, builds its part of the vocabulary or its trie, and answers each message in the
order of its entries. Every n-gram is looked up in the trie by context-relative successor search. A message has each
entry once, however common it is. Contexts whose last word makes up more than half a shard's share are dealt over
several shards by the word that follows; their totals go to each of these.

The tables are read again rather than recomputed if an executor is lost.

Edge cases: a null or empty text is the end token alone; a null id is text '' for the split; a corpus without training
documents gives every token probability one in the base model and p_1 = 1; very long texts make large blocks of their own;
repeated rows count and are scored one by one; an empty table gives an empty result; extra columns take no part; words are bytes, so texts need be no valid UTF-8.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import bucketed, raw_texts, write_table
from tessella.llm.eliasfano import NONE, Trie, dequantise
from tessella.runtime import ship_package

#: Tokens of a block (at least one document), training tokens for each shard, interpolation masses by order.
BLOCK_TOKENS, SHARD_TOKENS = 1_200_000, 800_000
MASS = {2: 30.0, 3: 4.0}
END, BEGIN = b"\n", b" "  # no word holds white space
_ROW = "block long, shard int, kind int, body binary"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed byte planes: the high bytes of small numbers cost next to nothing."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        small = next((t for t in (np.uint8, np.uint16, np.uint32) if a.dtype.kind in "iu" and a.dtype.itemsize > np.dtype(t).itemsize and (not a.size or (a.min() >= 0 and a.max() <= np.iinfo(t).max))), a.dtype)
        b = a.astype(small)
        planes = b.reshape(-1).view(np.uint8).reshape(-1, b.dtype.itemsize).T
        out.append((a.shape, a.dtype.str, b.dtype.str, planes.tobytes()))
    return zstandard.ZstdCompressor(3).compress(pickle.dumps(out, 5))


def unpack(body: bytes) -> list[np.ndarray]:
    out = []
    for shape, dtype, stored, planes in pickle.loads(zstandard.ZstdDecompressor().decompress(body)):
        size = np.dtype(stored).itemsize
        flat = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, -1).T).reshape(-1).view(stored)
        out.append(flat.astype(dtype).reshape(shape))
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * _MIX
    return x ^ (x >> np.uint64(32))


def _table(rows: list[tuple]) -> pa.Table:
    kinds = (("block", pa.int64()), ("shard", pa.int32()), ("kind", pa.int32()), ("body", pa.binary()))
    return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(kinds)})


def held_out(doc_id: object) -> bool:
    """crc32 of the id as text is divisible by 10."""
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 == 0


def blocks(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows (block, ids, sizes, held, words, counts, body): body has the local word numbers of all texts one after the other.

    words are the block's distinct words, in ascending order; counts are theirs in its training documents.
    """
    base = docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("text"))
    schema = f"block long, ids array<{base.schema['doc_id'].dataType.simpleString()}>, sizes array<int>, held array<boolean>, words binary, counts binary, body binary, trained long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        ids: list = []
        sizes: list[int] = []
        held: list[bool] = []
        tokens: list[bytes] = []

        def block() -> pa.RecordBatch:
            nonlocal made, tokens
            coded = pa.array(tokens, pa.binary()).dictionary_encode()
            order = pc.sort_indices(coded.dictionary).to_numpy()
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            local = rank[coded.indices.to_numpy()]
            learn = np.repeat(~np.array(held, bool), sizes)
            counts = np.bincount(local[learn], minlength=len(order))
            row = {
                "block": [(part << 32) + made], "ids": [list(ids)], "sizes": [list(sizes)], "held": [list(held)],
                "words": [zstandard.compress(b" ".join(coded.dictionary.take(pa.array(order)).to_pylist()))], "counts": [pack(counts)], "body": [pack(local)], "trained": [int(learn.sum())],
            }
            made += 1
            for x in (ids, sizes, held):
                x.clear()
            tokens = []
            return pa.RecordBatch.from_pydict(row, schema=arrow)

        arrow = None
        for batch in batches:
            if arrow is None:
                kind = batch.schema.field(0).type
                arrow = pa.schema([("block", pa.int64()), ("ids", pa.list_(kind)), ("sizes", pa.list_(pa.int32())), ("held", pa.list_(pa.bool_())), ("words", pa.binary()), ("counts", pa.binary()), ("body", pa.binary()), ("trained", pa.int64())])
            for i, t in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)), strict=True):
                words = (t or b"").lower().split()  # bytes: A-Z and ASCII white space only
                ids.append(i)
                held.append(held_out(i))
                sizes.append(len(words) + 1)
                tokens += words
                tokens.append(END)
                if len(tokens) >= BLOCK_TOKENS:
                    yield block()
        if ids:
            yield block()

    return base.mapInArrow(run, schema)


def _split_words(body: bytes) -> list[bytes]:
    return zstandard.decompress(body).split(b" ")


def _word_shards(words: list[bytes], shards: int) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.int64, len(words)) * 2654435761 % (1 << 32) * shards >> 32


def _ask_words(cut: DataFrame, shards: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words, counts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                ws, (c,) = _split_words(words), unpack(counts)
                at = _word_shards(ws, shards)
                rows = []
                for s, i in _slices(at, shards):
                    rows.append((block, s, 0, pickle.dumps((zstandard.compress(pickle.dumps([ws[j] for j in i], 5)), pack(c[i])), 5)))
                yield from _table(rows).to_batches()

    return cut.select("block", "words", "counts").mapInArrow(run, _ROW)


def _serve_words(asked: DataFrame, shards: int) -> DataFrame:
    """Answers (block, shard, 1, [numbers, counts]) and one row (distinct training words, shard, 2, nothing) for each shard.

    A word's number is its rank by count in its shard times the number of shards plus the shard: frequent words are small.
    """

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        blocks_ = table.column("block").to_pylist()
        bodies = [pickle.loads(b) for b in table.column("body").to_pylist()]
        lists = [pickle.loads(zstandard.decompress(w)) for w, _ in bodies]
        sizes = [len(x) for x in lists]
        coded = pa.array([w for x in lists for w in x], pa.binary()).dictionary_encode()
        local = coded.indices.to_numpy()
        counts = np.bincount(local, weights=np.concatenate([unpack(c)[0] for _, c in bodies]), minlength=len(coded.dictionary)).astype(np.int64)
        order = pc.sort_indices(pa.table({"n": counts, "w": coded.dictionary}), [("n", "descending"), ("w", "ascending")]).to_numpy()
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order)) * shards + shard
        ends = np.cumsum([0, *sizes])
        rows = [(b, shard, 1, pack(number[local[lo:hi]], counts[local[lo:hi]])) for b, lo, hi in zip(blocks_, ends, ends[1:], strict=False)]
        return _table([*rows, (int((counts > 0).sum()), shard, 2, b"")])

    return asked.groupBy("shard").applyInArrow(run, _ROW)


def _numbered(part: dict, answers: list[tuple], shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Global numbers and counts of a block's words."""
    at = _word_shards(_split_words(part["words"]), shards)
    number, count, of = np.empty(len(at), np.int64), np.empty(len(at), np.int64), dict(answers)
    for s, i in _slices(at, shards):
        number[i], count[i] = unpack(of[s])
    return number, count


class _BlockGrams:
    """A block's token sequence with global numbers, and its distinct n-grams of each order.

    Numbers are shifted by one: 0 is the begin token.
    """

    def __init__(self, part: dict, number: np.ndarray, count: np.ndarray, total: int, shards: int, order: int):
        (local,) = unpack(part["body"])
        sizes = np.array(part["sizes"], np.int64)
        self.sizes, self.held = sizes, np.array(part["held"], bool)
        self.count = count[local]
        starts = np.cumsum(sizes) - sizes
        doc = np.repeat(np.arange(len(sizes)), sizes)
        token = number[local] + 1
        offset = np.arange(len(token)) - starts[doc]
        learn = ~self.held[doc]
        self.learn, self.order, self.shards = learn, order, shards
        # A word takes part in a hot context if its share exceeds half a shard; it is then dealt over so many shards.
        word_salts = np.maximum(1, 2 * shards * count // max(total, 1))
        salts = word_salts[local]
        begin_salts = salts[-1]  # a text ends as often as it begins, and every block has an end token
        self.grams: dict[int, tuple] = {}
        self.contexts: dict[int, tuple] = {}
        back = [token]
        back_salts = [salts]
        for k in range(1, order):
            shifted = np.where(offset >= k, np.roll(token, k), 0)
            back.append(shifted)
            back_salts.append(np.where(offset >= k, np.roll(salts, k), begin_salts))
        width, below = int(token.max(initial=0)) + 1, None
        for k in range(2, order + 1):
            # The context of a k-gram is the (k - 1)-gram one place before it, whose rank is known.
            # Begin tokens alone come first, in the order of rows as well.
            context = back[1] if below is None else np.where(offset >= 1, np.roll(below, 1) + 1, 0)
            first, inverse = _ranked(context * width + token)
            rows = np.stack([back[j][first] for j in range(k - 1, -1, -1)], 1)
            n = np.bincount(inverse[learn], minlength=len(rows))
            salt = np.minimum.reduce([back_salts[j][first] for j in range(1, k)])
            self.grams[k] = (rows, inverse, n, salt)
            self.contexts[k] = self._contexts(k)
            below = inverse
        del self.learn

    def messages(self, places_only: bool = False) -> Iterator[tuple[int, dict[int, tuple]]]:
        """For each shard and order: places of the n-grams and of the contexts, then context rows and their totals, and the
        n-grams as (context place, word, count)."""
        parts: dict[int, dict[int, tuple]] = {}
        for k, (rows, _, n, salt) in self.grams.items():
            context, of, total, c_salt, home = self.contexts[k]
            target = (home[of] + (_mixed(rows[:, -1]) % salt.astype(np.uint64)).astype(np.int64)) % self.shards
            order = _by_shard(target, self.shards)
            # Contexts stand with their totals in every shard that may hold a part of them.
            spread = np.minimum(c_salt, self.shards)
            c_at = np.repeat(np.arange(len(context)), spread)
            c_target = (home[c_at] + np.arange(len(c_at)) - np.repeat(np.cumsum(spread) - spread, spread)) % self.shards
            c_order = _by_shard(c_target, self.shards)
            asked, c_cuts = np.unique(c_target[c_order], return_index=True)  # only shards that get something; n-grams go where their contexts go
            cuts, c_cuts = np.searchsorted(target[order], [*asked, self.shards]), [*c_cuts, len(c_order)]
            for x, s in enumerate(asked.tolist()):
                i, j = order[cuts[x] : cuts[x + 1]], c_at[c_order[c_cuts[x] : c_cuts[x + 1]]]
                parts.setdefault(s, {})[k] = (i, j) if places_only else (i, j, context[j], total[j], np.searchsorted(j, of[i]), rows[i, -1], n[i])
        yield from sorted(parts.items())

    def _contexts(self, k: int) -> tuple:
        rows, _, n, salt = self.grams[k]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:, :-1] != rows[:-1, :-1]).any(axis=1)
        of = np.cumsum(new) - 1
        context = rows[new, :-1]
        h = np.full(len(context), k, np.uint64)
        for c in range(context.shape[1]):
            h = _mixed(h ^ context[:, c].astype(np.uint64))
        home = (h % np.uint64(self.shards)).astype(np.int64)
        return context, of, np.bincount(of, weights=n, minlength=len(context)).astype(np.int64), salt[new], home


def _ranked(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each distinct value, in ascending order of values, and each value's rank."""
    order = np.argsort(code)
    ordered = code[order]
    new = np.ones(len(code), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    rank = np.empty(len(code), np.int64)
    rank[order] = np.cumsum(new) - 1
    return order[new], rank


def _by_shard(target: np.ndarray, shards: int) -> np.ndarray:
    """Stable order by shard; 16-bit keys take the radix sort."""
    return np.argsort(target.astype(np.uint16) if shards <= 1 << 16 else target, kind="stable")


def _slices(target: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard that is a target, and the places where it is, after one sort."""
    order = _by_shard(target, shards)
    found, first = np.unique(target[order], return_index=True)
    yield from zip(found.tolist(), np.split(order, first[1:]), strict=False)


def _distinct_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct rows and each row's place among them."""
    if not len(rows):
        return rows, np.empty(0, np.int64)
    width = int(rows.max()) + 1
    code = rows[:, 0]
    for c in range(1, rows.shape[1]):
        if int(code.max()) >= (1 << 62) // width:
            code = _ranked(code)[1]
        code = code * width + rows[:, c]
    first, rank = _ranked(code)
    return rows[first], rank


def _ask_grams(cut: DataFrame, words: DataFrame, shards: int, total: int, order: int) -> DataFrame:
    def run(own: pa.Table, answers: pa.Table) -> pa.Table:
        part, words, _ = _gathered(own, answers)
        block = _BlockGrams(part, *_numbered(part, words, shards), total, shards, order)
        rows = []
        for s, by_order in block.messages():
            arrays = [np.array(sorted(by_order))]
            for k in sorted(by_order):
                _, _, context, n_context, of, word, n = by_order[k]
                steps = np.diff(context[:, 0], prepend=0)
                arrays += [steps, context[:, 1:], n_context, np.diff(of, prepend=0), word, n]
            rows.append((part["block"], s, 3, pack(*arrays)))
        return _table(rows)

    return cut.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(run, _ROW)


def _serve_grams(asked: DataFrame) -> DataFrame:
    """Builds a shard's trie from all messages and answers each: leaves of its contexts, takes of its n-grams, by order."""

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        blocks_ = table.column("block").to_pylist()
        asked_: list[dict[int, tuple]] = []
        for body in table.column("body").to_pylist():
            arrays = unpack(body)
            by = {}
            for i, k in enumerate(arrays[0].tolist()):
                steps, rest, n_context, of, word, n = arrays[1 + 6 * i : 7 + 6 * i]
                context = np.concatenate([np.cumsum(steps)[:, None], rest], 1)
                of = np.cumsum(of)
                by[k] = (context, n_context, np.concatenate([context[of], word[:, None]], 1), n, of)
            asked_.append(by)
        grams, contexts, plans, width = {}, {}, {}, 1
        for k in sorted({k for by in asked_ for k in by}):
            have = [(i, by[k]) for i, by in enumerate(asked_) if k in by]
            c_rows, c_back = _distinct_rows(np.concatenate([x[0] for _, x in have]))
            total = np.bincount(c_back, weights=np.concatenate([x[1] for _, x in have]), minlength=len(c_rows))
            g_rows, g_back = _distinct_rows(np.concatenate([x[2] for _, x in have]))
            count = np.bincount(g_back, weights=np.concatenate([x[3] for _, x in have]), minlength=len(g_rows))
            c_of = np.empty(len(g_rows), np.int64)
            shift = np.cumsum([0, *[len(x[0]) for _, x in have]])
            c_of[g_back] = c_back[np.concatenate([x[4] + d for (_, x), d in zip(have, shift, strict=False)])]
            mass = MASS[k]
            seen, known = count > 0, total > 0
            grams[k] = (g_rows[seen], (count / (total[c_of] + mass))[seen])
            contexts[k] = (c_rows[known], (mass / (total + mass))[known])
            plans[k] = (have, c_rows, c_back, g_rows, g_back)
            width = max(width, int(g_rows.max(initial=0)) + 1, int(c_rows.max(initial=0)) + 1)
        trie = Trie(grams, contexts, width)
        answers: list[dict[int, tuple]] = [{} for _ in asked_]
        for k, (have, c_rows, c_back, g_rows, g_back) in plans.items():
            leaves, takes = trie.leaves(c_rows)[c_back], trie.takes(g_rows)[g_back]
            c_ends, g_ends = np.cumsum([0, *[len(x[0]) for _, x in have]]), np.cumsum([0, *[len(x[2]) for _, x in have]])
            for (i, _), a, b, c, d in zip(have, c_ends, c_ends[1:], g_ends, g_ends[1:], strict=False):
                answers[i][k] = (leaves[a:b], takes[c:d])
        return _table([(b, shard, 4, pack(*[x for k in sorted(a) for x in a[k]])) for b, a in zip(blocks_, answers, strict=True)])

    return asked.groupBy("shard").applyInArrow(run, _ROW)


def _gathered(own: pa.Table, answers: pa.Table) -> tuple[dict, list[tuple], list[tuple]]:
    """A block's own row, its word answers and its n-gram answers by shard."""
    words, grams = [], []
    for shard, kind, body in zip(*(answers.column(c).to_pylist() for c in ("shard", "kind", "body")), strict=True):
        (words if kind == 1 else grams).append((shard, body))
    return own.to_pylist()[0], words, sorted(grams)


def score(docs: DataFrame, order: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    ship_package(docs.sparkSession)
    spark = docs.sparkSession
    # Blocks are bucketed by block: what is brought to them is shuffled, they are not.
    cut = bucketed(blocks(docs, doc_id, text), "lm_blocks", "block", int(spark.conf.get("spark.sql.shuffle.partitions")), "none", False)
    total = cut.agg(F.sum("trained")).first()[0] or 0
    shards = max(4, -(-total // SHARD_TOKENS))
    answers = write_table(_serve_words(_ask_words(cut, shards), shards), "words")
    distinct = answers.where("kind = 2").agg(F.sum("block")).first()[0] or 0
    words = answers.where("kind = 1")
    parts = cut.select("block", "ids", "sizes", "held", "words", "body")
    grams = write_table(_serve_grams(_ask_grams(parts, words, shards, total, order)), "grams")
    id_type = cut.schema["ids"].dataType.elementType.simpleString()
    bottom = total + 0.1 * (distinct + 1)

    def run(mine: pa.Table, answers: pa.Table) -> pa.Table:
        part, own, found = _gathered(mine, answers)
        block = _BlockGrams(part, *_numbered(part, own, shards), total, shards, order)
        base = (block.count + 0.1) / bottom
        p = base
        bodies = {s: unpack(b) for s, b in found}
        takes = {k: np.full(len(rows), NONE) for k, (rows, _, _, _) in block.grams.items()}
        leaves = {k: np.full(len(block.contexts[k][0]), NONE) for k in block.grams}
        for s, by in block.messages(places_only=True):
            for i, k in enumerate(sorted(by)):
                g, c = by[k][:2]
                leaves[k][c], takes[k][g] = bodies[s][2 * i], bodies[s][2 * i + 1]
        for k in sorted(block.grams):
            _, inverse, _, _ = block.grams[k]
            left = np.where(leaves[k] == NONE, 1.0, dequantise(leaves[k]))[block.contexts[k][1]]
            p = dequantise(takes[k])[inverse] + left[inverse] * p
        starts = np.cumsum(block.sizes) - block.sizes
        add = lambda x: np.add.reduceat(x, starts)
        return pa.table({
            "doc_id": part["ids"], "held_out": part["held"], "n_tokens": pa.array(block.sizes, pa.int64()), "n_known": pa.array(add((block.count > 0).astype(np.int64)), pa.int64()),
            "train_tokens": pa.array(np.full(len(starts), total), pa.int64()), "base_score": add(np.log10(base)), "score": add(np.log10(p)),
        })

    schema = f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return parts.groupBy("block").cogroup(words.unionByName(grams).groupBy("block")).applyInArrow(run, schema)
