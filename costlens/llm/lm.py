"""LM scoring by a weighted backoff automaton.

The model interpolates n-gram counts up to ORDER with Dirichlet weights over add-half unigrams:
p(w|h) = (c(hw) + m p(w|h')) / (c(h) + m), where h' is h without its first word. As an automaton: a state for each
n-gram of up to ORDER-1 tokens that training texts continue, the root for the empty one; from state h an arc for each
token seen after it, with weight log p(w|h), to the longest suffix of hw that is a state; and a failure arc to h' with
weight log m/(c(h)+m), taken where no arc has the token. A text is one walk from the root, left to right, ended by the
end token, which carries the state and adds up weights. The state before a token is the longest known suffix of the
ORDER-1 tokens before it, so the walks of all texts of a batch advance as arrays, one failure level after another.

Counts cover all training documents and grow with them, so no task ever holds the whole automaton. Batches of documents
ask ranges of n-gram hashes for the counts of their n-grams (costlens.llm.exchange); the answers make the part of the
automaton that the batch's walks can reach. Words and pairs are asked first. An n-gram one longer is asked only if both
n-grams it consists of occur in other batches too: otherwise no other batch has it, and its own count is the whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from costlens.llm.common import ASCII_LOWER, GRAM, SPACE, U64, as_bytes, held_out, joined, mix, per_document, prefix_sums, slices, spans_hash, tokens
from costlens.llm.exchange import Found, Plan, Run, run_of

#: The end token: no word's hash but by chance of 2**-64.
END = U64(0x5DEECE66D5DEECE6)
HALF = 0.5
ORDER = 3
#: Dirichlet mass m of the model of the next lower order, for pairs and for longer n-grams.
PAIR_MASS, MASS = 32.0, 4.0
_TAG = U64(7)


def token_stream(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's words followed by one end, and each text's first token (one more entry)."""
    hashes, counts = [np.empty(0, U64)], [np.zeros(1, np.int64)]
    for lo, hi in slices(texts):
        buf, off = joined(texts[lo:hi])
        buf = ASCII_LOWER[buf]
        start, end, first = tokens(buf, off, ~SPACE)
        h = spans_hash(prefix_sums(buf), start, end)
        hashes.append(np.insert(h, first[1:], END))
        counts.append(np.diff(first) + 1)
    return np.concatenate(hashes), np.cumsum(np.concatenate(counts))


class Walks:
    """The texts of a batch, and for the n-gram that ends at each token the automaton's count, count[n], and whether other batches have it too, shared[n]."""

    def __init__(self, docs: pa.Table, order: int):
        self.h, self.first = token_stream(as_bytes(docs.column("text")))
        self.order, self.size = order, len(self.h)
        self.lengths = np.diff(self.first)
        self.trains = np.repeat(~np.asarray(docs.column("held_out").to_numpy(zero_copy_only=False), bool), self.lengths)
        nth = np.arange(self.size, dtype=np.int32) - np.repeat(self.first[:-1].astype(np.int32), self.lengths)
        self.nth = np.minimum(nth, order).astype(np.int8)
        self.count = [np.zeros(self.size, np.int64) for _ in range(order + 1)]
        self.shared = [np.zeros(self.size, bool) for _ in range(order + 1)]
        self.key, self.last = self.h, 1

    def keys(self, n: int) -> np.ndarray:
        """Keys of the n-grams that end at each token; those that begin before the text are meaningless. Asked for in the order of n."""
        while self.last < n:
            longer = self.key.copy()
            longer[1:] = mix(self.key[:-1] * GRAM + self.h[1:])
            self.key, self.last = longer, self.last + 1
        return (self.key & ~_TAG) | U64(n)

    def start(self, found: Found | None) -> Run:
        """The question for words and pairs, or with an answer their counts."""
        at = np.flatnonzero(self.nth >= 1)
        run, place, _ = run_of(np.concatenate([self.keys(1), self.keys(2)[at]]), np.concatenate([self.trains, self.trains[at]]))
        if found is not None:
            for values, to in ((~found.alone[place], self.shared), (found.values[place], self.count)):
                to[1], to[2][at] = values[: self.size], values[self.size :]
        return run

    def longer(self, n: int, found: Found | None) -> Run:
        """The question for n-grams of n tokens, or with an answer their counts."""
        at = np.flatnonzero(self.nth >= n - 1)
        keys = self.keys(n)
        both = self.shared[n - 1][at] & self.shared[n - 1][at - 1]
        ask, rest = at[both], at[~both]
        run, place, _ = run_of(keys[ask], self.trains[ask])
        if found is not None:
            self.count[n][ask], self.shared[n][ask] = found.values[place], ~found.alone[place]
            own, place, _ = run_of(keys[rest], self.trains[rest])
            self.count[n][rest] = own.counts[place]
        return run

    def learn(self, found: dict[int, Found]) -> Run:
        """Takes all answers there are; returns the next question."""
        run = self.start(found.get(0))
        for n in range(3, self.order + 1):
            if n - 3 in found:
                run = self.longer(n, found.get(n - 2))
        return run

    def weights(self, n_train: int, n_distinct: int) -> tuple[np.ndarray, np.ndarray]:
        """log10 of the unigram probability of each token, and of the weights of the walk's arcs at each token."""
        p = (self.count[1] + HALF) / (n_train + HALF * (n_distinct + 1))
        base = np.log10(p)
        step, probability = base.copy(), p
        for n in range(2, self.order + 1):
            # Before each token stands the state of the n-1 tokens before it, if it is one; its arc has the token or fails over to the state of n-2 tokens, whose weight step has.
            history = np.zeros(self.size, np.int64)
            history[1:] = self.count[n - 1][:-1]
            state = (history > 0) & (self.nth >= n - 1)
            mass = PAIR_MASS if n == 2 else MASS
            arc = (self.count[n] + mass * probability) / (history + mass)
            fail = np.log10(mass / (history + mass)) + step
            step = np.where(state, np.where(self.count[n] > 0, np.log10(arc), fail), step)
            probability = np.where(state, arc, probability)
        return base, step


def _totals(run: Run) -> np.ndarray:
    """Tokens and distinct tokens of the training texts, in one range."""
    words = run.counts[(run.keys & _TAG) == U64(1)]
    return np.array([words.sum(), (words > 0).sum()], np.int64)


def _sums(v: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(v, first[:-1]) if len(v) else np.zeros(len(first) - 1)


def score(docs: DataFrame, held: Column, doc_id: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """One row per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    held: boolean column, true for rows that are scored but not learned from. Tokens are runs of non-blank bytes with
    A-Z lower-cased, and one end a text, so null and empty texts have one token. A text of any length is one walk.
    Repeated rows count and score each. Without training rows all tokens are unknown and both scores are that of the
    add-half model of nothing. N-grams are known by 61 bits of hash: of 10**13 different ones a few millions share a
    count with another.
    """
    if order < 2:
        raise ValueError("the order is 2 at least")
    columns = {"doc_id": F.col(doc_id), "text": F.coalesce(F.col(text), F.lit("")), "held_out": held}
    plan = Plan(docs, columns, text, bytes_per_text_byte=1.3)
    question = lambda table, found: Walks(table, order).learn(found)
    answers = plan.ask(question, 0, totals=_totals)
    for step in range(1, order - 1):
        answers = answers.unionByName(plan.ask(question, step, before=answers))
    kind = docs.select(F.col(doc_id)).dtypes[0][1]
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def walk(table: pa.Table, found: dict[int, Found]) -> pa.Table:
        if not table.num_rows:
            return pa.table([pa.array([], t) for t in (table.schema.field("doc_id").type, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())], names=names)
        x = Walks(table, order)
        x.learn(found)
        n, distinct = found[0].totals.tolist()
        base, step = x.weights(n, distinct)
        known = per_document((x.count[1] > 0).astype(np.int64), x.first)
        return pa.table(
            [
                table.column("doc_id"), table.column("held_out"), pa.array(x.lengths), pa.array(known), pa.array(np.full(len(table), n, np.int64)),
                pa.array(_sums(base, x.first)), pa.array(_sums(step, x.first))
            ],
            names=names
        )

    return plan.finish(answers, walk, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and backoff scores of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, held_out("doc_id", 5, 1))


QUERIES = {"op3_lm_score": op3_lm_score}
SQL: dict[str, str] = {}
