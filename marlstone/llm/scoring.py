"""Language-model scoring with a weighted backoff automaton.

States are the histories of up to ORDER - 1 tokens that were seen in training, the start of a text counting as a token, and
the root, which is the empty history. State h has an arc for every word w that followed it, weighing log10 P(w | h), to the
longest history that ends hw and is a state; and a failure arc to the history without its first token, weighing the log10
of the share that P leaves to it. P(w | h) = (c(hw) + k P(w | h without its first token)) / (c(h) + k), so that a word
that never followed h weighs what the failure arc and the shorter history say. The root has an arc for every word: the
unigram with 0.1 added. A text is one walk from the start's state, left to right, that carries its state and adds up weights.
k is chosen by the likelihood of the training text with each token left out of its own counts; the walk adds up the
weights under all k that are tried, as the way that it takes doesn't depend on k.

Counts are too large for one place, so documents lie in blocks and n-grams in key ranges. A block asks each range once for
its distinct n-grams, sorted, with its own training counts; the range adds up what all blocks say and answers each in the
same order. With that a block builds the part of the automaton that its texts can reach. Blocks talk to all ranges, so
messages grow as their product: at a given size of blocks and ranges, with the square of the input.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, Scratch, combine, hash_words, session, shuffle_width, table
from .language import held_out

END, START = np.uint64(0x9AE16A3B2F90404F), np.uint64(0xC949C7DEFEED1E57)
#: Tokens in the longest n-grams.
ORDER = 3
#: Bytes of text in a block, and distinct n-grams in a key range, about.
BLOCK_BYTES, RANGE_KEYS = 4 << 20, 2 << 20
#: Bytes of text whose answers lie in a file with as much as a thin row has.
ANSWERED = 1 << 9
#: Added to every unigram count; the values of k that are tried after one token, and how many times less k is after each further one.
ADD, BACKOFF, LESS = 0.1, (32.0, 256.0, 2048.0, 16384.0), 4.0
#: Tokens of a text that are walked one after the other; the parts of a longer text are walked side by side.
LANE = 512
#: Steps whose probabilities are multiplied before their logarithm is taken; 16 of at most ORDER weights above 1e-5 each stay far above 1e-308.
FEW = 16


class Tokens:
    """Tokens of several texts, each text ended by END: the text and the place in it of each."""

    def __init__(self, texts: list[str | None]):
        out = []
        for words in hash_words(texts, BLANKS):
            token = np.insert(words.hashes, words.bounds[1:], END)
            n = np.diff(words.bounds) + 1
            place = np.arange(len(token)) - np.repeat(np.cumsum(n) - n, n)
            out.append((token, words.first + np.repeat(np.arange(len(words)), n), place))
        parts = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.token, self.text, self.place = parts

    def has(self, n: int) -> np.ndarray:
        """The tokens at which an n-gram ends: those with n - 1 tokens before them, the start counting as one."""
        return np.flatnonzero(self.place >= n - 2)

    def keys(self, n: int) -> np.ndarray:
        """A hash of each n-gram, in the order of has."""
        if n == 1:
            return self.token
        columns = [self.token]
        for back in range(1, n):
            before = np.concatenate([np.full(min(back, len(self.token)), START), self.token[:-back]])
            columns.append(np.where(self.place < back, START, before))
        return combine(*columns[::-1])[self.has(n)]


def distinct_keys(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, a place of each, and the number of the key at each place."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    back = np.empty(len(keys), np.int64)
    back[order] = np.cumsum(new) - 1
    return ordered[new], order[new], back


def cuts(keys: np.ndarray, bits: int, ranges: int) -> np.ndarray:
    """Where each range begins in sorted keys."""
    return np.searchsorted(keys, np.array([-(-(k << bits) // ranges) for k in range(1, ranges)], np.uint64)).tolist()


def shrink(values: np.ndarray) -> bytes:
    """Unsigned numbers in the fewest whole bytes each that hold the largest; the width goes first."""
    v = np.ascontiguousarray(values, np.uint64)
    width = max(1, (int(v.max()).bit_length() + 7) // 8) if len(v) else 1
    return bytes([width]) + v.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def grow(data: bytes) -> np.ndarray:
    width = data[0]
    raw = np.frombuffer(data, np.uint8, offset=1).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.view(np.uint64).ravel()


_ROWS = ["id", "text", "held_out"]


def _blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """block, blob: rows of docs (id, text, held_out) that follow each other, compressed; each row is a block of about block_bytes of
    text, with a number of its own."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, size, block = [], 0, TaskContext.get().partitionId() << 32

        def done() -> pa.RecordBatch:
            out = io.BytesIO()
            with pa.ipc.new_stream(out, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                for x in held:
                    w.write_batch(x)
            return pa.record_batch([pa.array([block]), pa.array([out.getvalue()], pa.binary())], ["block", "blob"])

        for b in batches:
            ends = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
            lo = 0
            while lo < len(b):
                before = int(ends[lo - 1]) if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, before + block_bytes - size, "right")))
                held.append(b.slice(lo, hi - lo))
                size += int(ends[hi - 1]) - before
                lo = hi
                if size >= block_bytes or lo < len(b):
                    yield done()
                    held, size, block = [], 0, block + 1
        if held:
            yield done()

    return docs.select(*_ROWS).mapInArrow(pack, "block long, blob binary")


def _rows(blob: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(blob.as_buffer()).read_all()


def _ask(n: int, ranges: int):
    """Each block's distinct n-grams and training counts, by range."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = _rows(blob)
                tokens = Tokens(rows.column("text").to_pylist())
                keys, _, back = distinct_keys(tokens.keys(n))
                trains = ~rows.column("held_out").to_numpy()[tokens.text[tokens.has(n)]]
                counts = np.bincount(back[trains], minlength=len(keys))
                at = [0, *cuts(keys, 64, ranges), len(keys)]
                full = [(r, lo, hi) for r, (lo, hi) in enumerate(zip(at[:-1], at[1:], strict=True)) if hi > lo]
                cols = (
                    (pa.int64(), [block] * len(full)), (pa.int32(), [r for r, _, _ in full]),
                    (pa.binary(), [shrink(np.diff(keys[lo:hi], prepend=np.uint64(0))) for _, lo, hi in full]), (pa.binary(), [shrink(counts[lo:hi]) for _, lo, hi in full]),
                )
                yield pa.record_batch([pa.array(x, t) for t, x in cols], ["block", "range", "keys", "counts"])

    return ask


def _answer(n: int):
    """Total training counts in each block's own order; and, as block -1, how many tokens and distinct n-grams were counted."""

    def answer(key: tuple, asked: pa.Table) -> pa.Table:
        keys = [np.cumsum(grow(x.as_buffer().to_pybytes())) for x in asked.column("keys")]
        counts = np.concatenate([grow(x.as_buffer().to_pybytes()) for x in asked.column("counts")])
        distinct, back = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(back, weights=counts, minlength=len(distinct)).astype(np.int64)
        mine = np.split(total[back], np.cumsum([len(k) for k in keys])[:-1])
        rows = [(b, n, key[0].as_py(), shrink(t), None, None) for b, t in zip(asked.column("block").to_pylist(), mine, strict=True)]
        rows.append((-1, n, key[0].as_py(), None, int(total.sum()), int((total > 0).sum())))
        types = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
        return pa.table({c: pa.array(x, t) for c, t, x in zip(("block", "grams", "range", "counts", "tokens", "distinct"), types, zip(*rows, strict=True), strict=True)})

    return answer


class Automaton:
    """The states and arcs that some texts can reach, from the counts of all their n-grams.

    grams[n - 1][i] is the number among the distinct n-grams of the one that ends at token i, or -1; first is a token at which
    each ends. State numbers: 0 is the root, 1 the start, then histories of one token, of two, and so on. Arc numbers: n-grams in
    the same order. Weights have a column for each k.
    """

    def __init__(self, tokens: Tokens, grams: list[np.ndarray], first: list[np.ndarray], counts: list[np.ndarray], total: int, distinct: int, starts: int):
        self.tokens, self.grams, self.order, self.starts, self.counts = tokens, grams, len(grams), float(starts), [c.astype(np.float64) for c in counts]
        self.k = np.array([[b / LESS**n for b in BACKOFF] for n in range(self.order - 1)])
        self.all = total + ADD * (distinct + 1)
        self.state_at = np.cumsum([2, *map(len, counts[:-1])])
        self.arc_at = np.cumsum([0, *map(len, counts)])
        self.level, self.fail, self.known = (np.zeros(self.state_at[-1], t) for t in (np.int8, np.int64, np.float64))
        self.level[1], self.known[1] = min(1, self.order - 1), self.starts
        self.seen, self.weight = np.ones(self.arc_at[-1], bool), np.zeros((self.arc_at[-1], len(BACKOFF)))
        p = np.repeat(self.root(self.counts[0])[:, None], len(BACKOFF), 1)  # the root knows every word
        for n in range(1, self.order + 1):
            c, at = self.counts[n - 1], first[n - 1]
            arcs = slice(self.arc_at[n - 1], self.arc_at[n])
            if n > 1:
                k = self.k[n - 2]
                p = (c[:, None] + k * p[grams[n - 2][at]]) / (self._history(n, at)[:, None] + k)
                self.seen[arcs] = c > 0
            self.weight[arcs] = p
            if n < self.order:
                states = slice(self.state_at[n - 1], self.state_at[n])
                self.level[states], self.known[states] = n, c
                if n > 1:  # what is left without the first token ends at the same place
                    self.fail[states] = self.state_at[n - 2] + grams[n - 2][at]

    def root(self, count: np.ndarray) -> np.ndarray:
        return (count + ADD) / self.all

    def _history(self, n: int, at: np.ndarray) -> np.ndarray:
        """How often the first n - 1 tokens of the n-grams that end at the tokens were a history."""
        before = self.counts[n - 2][self.grams[n - 2][np.maximum(at - 1, 0)]]
        return np.where(self.tokens.place[at] == 0, self.starts, before) if n == 2 else before

    def left_out(self, mine: np.ndarray) -> np.ndarray:
        """For each k the log-probability of the tokens of mine (a flag for each), each left out of its own counts."""
        out = np.zeros(len(BACKOFF))
        place = self.tokens.place
        for n in range(min(2, self.order), self.order + 1):
            longest = mine & (place >= n - 2 if n == self.order else place == n - 2)
            ids = self.grams[n - 1][longest]
            kinds, one, times = np.unique(ids, return_index=True, return_counts=True)
            at = np.flatnonzero(longest)[one]
            p = np.repeat(self.root(np.maximum(self.counts[0][self.grams[0][at]] - 1, 0))[:, None], len(BACKOFF), 1)
            for m in range(2, n + 1):
                c, h = self.counts[m - 1][self.grams[m - 1][at]], self._history(m, at)
                p = (np.maximum(c - 1, 0)[:, None] + self.k[m - 2] * p) / (np.maximum(h - 1, 0)[:, None] + self.k[m - 2])
            out += times @ np.log10(p)
        return out

    def after(self, at: np.ndarray) -> np.ndarray:
        """The state after each token: the longest history that ends there and was seen, which is where any walk arrives."""
        out = np.zeros(len(at), np.int64)
        for n in range(1, self.order):
            gram = self.grams[n - 1][at]
            state = self.state_at[n - 1] + np.maximum(gram, 0)
            longer = (gram >= 0) & (self.known[state] > 0)
            out[longer] = state[longer]
        return out

    def walk(self, texts: int) -> np.ndarray:
        """The log-probability of each text for each k. All texts, long ones in parts, are walked side by side, a token a step."""
        place = self.tokens.place
        start = np.flatnonzero(place % LANE == 0)
        n = np.diff(np.append(start, len(place)))
        longest = np.argsort(-n, kind="stable")
        start, n = start[longest], n[longest]
        state = np.where(place[start] == 0, int(self.order > 1), self.after(np.maximum(start - 1, 0)))
        sums, chance = np.zeros((len(start), len(BACKOFF))), np.ones((len(start), len(BACKOFF)))
        for step in range(int(n[0]) if len(n) else 0):
            going = int(np.searchsorted(-n, -step, "left"))
            state[:going] = self._step(start[:going] + step, state[:going], chance[:going])
            if step % FEW == FEW - 1:  # before the product gets too small for a number
                sums[:going] += np.log10(chance[:going])
                chance[:going] = 1.0
        sums += np.log10(chance)
        out = np.zeros((texts, len(BACKOFF)))
        order = np.argsort(start, kind="stable")  # parts of a text in their order, so that equal texts add up alike
        np.add.at(out, self.tokens.text[start[order]], sums[order])
        return out

    def _step(self, at: np.ndarray, state: np.ndarray, chance: np.ndarray) -> np.ndarray:
        """The states after one more token each: failure arcs while a state has no arc for it, then the arc. Their weights, as
        probabilities, are multiplied into chance."""
        state, left, out = state.copy(), np.arange(len(at)), np.zeros(len(at), np.int64)
        for n in range(self.order, 0, -1):  # an arc from a history of n - 1 tokens is an n-gram
            here = self.level[state[left]] == n - 1
            lane = left[here]
            arc = self.arc_at[n - 1] + self.grams[n - 1][at[lane]]
            has = self.seen[arc]
            goes, falls = lane[has], lane[~has]
            chance[goes] *= self.weight[arc[has]]
            if len(falls):
                chance[falls] *= self.k[n - 2] / (self.known[state[falls]][:, None] + self.k[n - 2])
                state[falls] = self.fail[state[falls]]
                left = np.concatenate([left[~here], falls])
            else:
                left = left[~here]
            m = min(n, self.order - 1)
            if m:  # to the n-gram as a history, without its first token where that is too long; a word never seen leads to the root
                to = self.state_at[m - 1] + self.grams[m - 1][at[goes]]
                out[goes] = np.where(self.known[to] > 0, to, 0)
        return out


def _score(id_col: str, order: int, ranges: int, total: int, distinct: int, starts: int):
    def score(block: pa.Table, answers: pa.Table) -> pa.Table:
        block = pa.concat_tables([_rows(x) for x in block.column("blob")])
        tokens = Tokens(block.column("text").to_pylist())
        said = {(o, r): c for o, r, c in zip(answers.column("grams").to_pylist(), answers.column("range").to_pylist(), answers.column("counts"), strict=True)}
        grams, first, counts = [], [], []
        for n in range(1, order + 1):
            has = tokens.has(n)
            _, one, back = distinct_keys(tokens.keys(n))
            gram = np.full(len(tokens.token), -1, np.int32)
            gram[has] = back
            got = [grow(said[n, r].as_buffer().to_pybytes()) for r in range(ranges) if (n, r) in said]
            grams.append(gram), first.append(has[one]), counts.append(np.concatenate(got) if got else np.zeros(0, np.uint64))
        auto = Automaton(tokens, grams, first, counts, total, distinct, starts)
        size, word = len(block), auto.counts[0][grams[0]]
        add = lambda x: np.bincount(tokens.text, weights=x, minlength=size)
        out = block.column("held_out").to_numpy()
        cols = {id_col: block.column("id"), "held_out": block.column("held_out"), "n_tokens": np.bincount(tokens.text, minlength=size), "n_known": add(word > 0).astype(np.int64), "base_score": add(np.log10(word + ADD) - np.log10(auto.all))}
        sums, left_out = auto.walk(size), auto.left_out(~out[tokens.text])
        for i in range(len(BACKOFF)):
            cols[f"score_{i}"] = sums[:, i]
            cols[f"left_out_{i}"] = np.concatenate([left_out[i : i + 1], np.zeros(max(0, size - 1))])[:size]  # the block's, in its first row
        return pa.table(cols)

    return score


def score_texts(docs: DataFrame, out, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, order: int = ORDER) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    out: a boolean column, true for rows to be left out of training. A null or empty text is its end token alone; a very long one
    is in one block, as a whole. Equal texts get equal scores up to the order of addition; repeated rows and null ids are
    scored like others; without training rows every token is unknown. An empty table gives no rows; other columns of the input
    aren't carried, whatever their names.
    """
    spark = session(docs)
    scratch = Scratch(spark, "scoring")
    kind = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(out, F.lit(True)).alias("held_out"))
    lim = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(1).cast("long")).alias("b"), F.count_if(~F.col("held_out")).alias("starts"), F.count("*").alias("n")).first()
    ranges = max(shuffle_width(spark) // 2, -(-(lim.b or 0) // (6 * RANGE_KEYS)), 1)
    packed = scratch.write(_blocks(docs, block_bytes), "blocks")
    answers = None
    for n in range(1, order + 1):  # one after the other, so that only one length's keys lie on the disks
        asked = packed.mapInArrow(_ask(n, ranges), "block long, range int, keys binary, counts binary")
        said = asked.groupBy("range").applyInArrow(_answer(n), "block long, grams int, range int, counts binary, tokens long, distinct long")
        said = scratch.write(said, f"answers-{n}", rows=(lim.b or 0) // ANSWERED, costly=True, large=True)
        answers = said if answers is None else answers.unionByName(said)
    total = answers.where("block = -1 and grams = 1").agg(F.sum("tokens").alias("n"), F.sum("distinct").alias("v")).first()
    schema = f"{id_col} {kind}, held_out boolean, n_tokens long, n_known long, base_score double, " + ", ".join(f"score_{i} double, left_out_{i} double" for i in range(len(BACKOFF)))
    score = _score(id_col, order, ranges, total.n or 0, total.v or 0, lim.starts)
    scored = packed.groupBy("block").cogroup(answers.where("block >= 0").groupBy("block")).applyInArrow(score, schema)
    scored = scratch.write(scored, "scored", rows=lim.n, costly=True)
    scratch.keep_only(scored)
    left_out = scored.agg(*[F.sum(f"left_out_{i}").alias(f"s{i}") for i in range(len(BACKOFF))]).first()
    best = max(range(len(BACKOFF)), key=lambda i: left_out[i] or 0.0)
    return scored.select(id_col, "held_out", "n_tokens", "n_known", F.lit(total.n or 0).cast("long").alias("train_tokens"), "base_score", F.col(f"score_{best}").alias("score"))


def op10_backoff_scoring(spark, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), held_out(modulus=10, fold=0))


QUERIES = {"op10_backoff_scoring": op10_backoff_scoring}
